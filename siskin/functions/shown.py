"""Result writers: rows as text, string vectors, tables and HTML."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: how a NULL of each type is shown
NULLS = ((T.StringType, "varlen_null"), (T.BooleanType, "boolean_null"), (T.FractionalType, "decimal_null"), (T.IntegralType, "integer_null"), (T.ArrayType, "vector_null"), (T.TimestampType, "timestamp_null"), (T.TimestampNTZType, "timestamp_null"))


def cell(value, kind: T.DataType) -> str:
    if value is None:
        return next((text for t, text in NULLS if isinstance(kind, t)), "integer_null")
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value:f}"
    if isinstance(value, list):
        return "[" + ",".join(cell(x, T.DoubleType()) for x in value) + "]"
    return str(value)


def lines(df: DataFrame, separator: str = " ") -> DataFrame:
    """One column, line: each row's cells as text, made where the rows are."""

    def told(name: str, kind: T.DataType) -> Column:
        null = F.lit(next((text for t, text in NULLS if isinstance(kind, t)), "integer_null"))
        c = F.col(f"`{name}`")
        if isinstance(kind, T.FractionalType):
            return F.when(c.isNull(), null).otherwise(F.format_string("%.6f", c.cast("double"))) if not isinstance(kind, T.DecimalType) else F.coalesce(c.cast("string"), null)
        if isinstance(kind, T.ArrayType):
            return F.coalesce(F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.format_string("%.6f", x.cast("double"))), ","), F.lit("]")), null)
        return F.coalesce(c.cast("string"), null)

    return df.select(F.concat_ws(separator, *(told(f.name, f.dataType) for f in df.schema)).alias("line"))


def vectors(df: DataFrame) -> list[list[str]]:
    """All cells as text. Rows come to the driver: this shows results, it does not process them."""
    kinds = [f.dataType for f in df.schema]
    return [[cell(v, k) for v, k in zip(row, kinds, strict=True)] for row in df.collect()]


def text(df: DataFrame, separator: str = " ") -> str:
    return "\n".join(separator.join(row) for row in vectors(df))


def grid(df: DataFrame) -> str:
    rows = [df.columns, *vectors(df)]
    widths = [max(len(r[i]) for r in rows) for i in range(len(df.columns))]
    line = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    shown = ["|" + "|".join(f" {c.ljust(w)} " for c, w in zip(r, widths, strict=True)) + "|" for r in rows]
    return "\n".join([line, shown[0], line, *shown[1:], line])


def as_html(df: DataFrame) -> str:
    row = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{html.escape(c)}</{tag}>" for c in cells) + "</tr>"
    return "<table>" + row(df.columns, "th") + "".join(row(r, "td") for r in vectors(df)) + "</table>"
