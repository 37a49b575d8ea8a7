"""Pipelines built from the operators."""

from .clean import clean_attributes, clean_facts, clean_prices
from .pipelines import (
    bucket_drift,
    class_drift,
    correlation_lines,
    ratio_extremes,
    with_ratios,
)
from .study import Study

__all__ = [
    "Study",
    "bucket_drift",
    "class_drift",
    "clean_attributes",
    "clean_facts",
    "clean_prices",
    "correlation_lines",
    "ratio_extremes",
    "with_ratios",
]
