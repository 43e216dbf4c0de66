"""What a feature is: a builder of one column over a frame it does not own."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from ..core.panel import Frame, Panel

Builder = Callable[[Frame], Column]


@dataclass(frozen=True)
class Feature:
    """`build` makes the value from a frame; `pre` names inner window columns it
    reads (window functions do not nest).  `back` / `ahead` say how many rows the
    windows reach, `needs` which columns must exist."""

    build: Builder
    needs: tuple[str, ...] = ()
    back: int = 0
    ahead: int = 0
    pre: dict[str, Builder] = field(default_factory=dict)


def require(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)


def apply_features(frame: Frame, features: dict[str, Feature]) -> Frame:
    """Add all features in two projections, so windows of one partition share
    one exchange and one sort."""
    pre = {n: b for f in features.values() for n, b in f.pre.items()}
    df = frame.df
    if pre:
        df = df.withColumns({n: b(frame) for n, b in pre.items()})
    df = df.withColumns({n: f.build(frame) for n, f in features.items()}).drop(*pre)
    return frame.with_df(df)


def add_features(panel: Panel, features: dict[str, Feature]) -> DataFrame:
    """Panel rows plus one column per feature."""
    missing = sorted({c for f in features.values() for c in f.needs} - set(panel.df.columns))
    require(not missing, f"missing input columns: {missing}")
    frame = panel.frame(
        back=max((f.back for f in features.values()), default=0),
        ahead=max((f.ahead for f in features.values()), default=0),
    )
    return apply_features(frame, features).core()


def add_feature_panel(panel: Panel, features: dict[str, Feature]) -> Panel:
    return panel.with_df(add_features(panel, features))
