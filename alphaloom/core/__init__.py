"""Conventions every operator is built from: panels, scans, ranks, draws."""
from .expr import (
    bias_corrected_kurtosis,
    bias_corrected_skew,
    clip,
    correlation,
    full_frame,
    ratio,
    sharpe,
    valid_frame,
)
from .panel import Frame, Panel
from .ranks import group_quantiles, tally
from .scan import cumulative, numbered
from .draws import uniforms

__all__ = [
    "Frame",
    "Panel",
    "bias_corrected_kurtosis",
    "bias_corrected_skew",
    "clip",
    "correlation",
    "cumulative",
    "full_frame",
    "group_quantiles",
    "numbered",
    "ratio",
    "sharpe",
    "tally",
    "uniforms",
    "valid_frame",
]
