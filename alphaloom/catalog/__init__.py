"""All registered queries."""
from . import backtests, chance, features, running, tables, validation  # noqa: F401
from .base import REGISTRY

__all__ = ["REGISTRY"]
