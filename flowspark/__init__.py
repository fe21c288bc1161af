"""An analytics engine for semi-structured event data on PySpark."""

from .plans.compiler import transform
from .plans.engine import Engine, Result

__all__ = ["Engine", "Result", "transform"]
