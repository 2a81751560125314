"""Writing results: extracts, exported views and tab-separated text."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, functions as F, types as T

from pivotlake.functions.names import q
from pivotlake.operators.view import tab_separated

_PRIMITIVE = (T.BooleanType, T.NumericType, T.StringType)


def extract_name(now: datetime) -> str:
    return now.strftime("Pivot_Drilldown_%Y-%m-%d_%H-%M")


def extract_frame(rows: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Raw rows in the engine's column order; primitives stay, the rest becomes text."""
    out = []
    types = {f.name: f.dataType for f in rows.schema.fields}
    for c in columns or rows.columns:
        col = q(c)
        if isinstance(types[c], (T.TimestampType, T.TimestampNTZType)):
            col = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")
        elif not isinstance(types[c], _PRIMITIVE):
            col = col.cast("string")
        out.append(col.alias(c))
    return rows.select(*out)


def write_extract(rows: DataFrame, folder: str, now: datetime, fmt: str = "csv") -> str:
    """Write the raw rows behind a selection; every executor writes its own part."""
    path = f"{folder.rstrip('/')}/{extract_name(now)}"
    frame = extract_frame(rows)
    writer = frame.write.mode("errorifexists")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)
    return path


def write_view(view: DataFrame, path: str) -> None:
    """Write an exported view (see ``export_frame``) as CSV, the total line last."""
    body = view.drop("line") if "line" in view.columns else view
    body.write.mode("errorifexists").option("header", True).option("emptyValue", "").csv(path)


def write_tab_separated(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    tab_separated(df, columns).write.mode("errorifexists").text(path)
