"""Spreadsheet-style pivots, drill-down and soft deletion as Spark DataFrame jobs."""

from pivotlake.errors import DefinitionError, PivotError
from pivotlake.plans.compile import PivotResult, pivot
from pivotlake.spec import Display, Measure, PivotSpec, Rule, Totals

__all__ = [
    "DefinitionError",
    "Display",
    "Measure",
    "PivotError",
    "PivotResult",
    "PivotSpec",
    "Rule",
    "Totals",
    "pivot",
]
