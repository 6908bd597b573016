"""Territorial indicators over census-style tables, as Spark DataFrame operators."""

from comarca.spec import IndicatorSpec

__all__ = ["IndicatorSpec"]
