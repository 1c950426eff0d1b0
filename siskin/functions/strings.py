"""Case functions that take one string and nothing else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


class ArgumentError(TypeError):
    """A function was given the wrong number or type of arguments."""


def _one_string(df: DataFrame, name: str, columns: tuple) -> Column:
    if len(columns) != 1:
        raise ArgumentError(f"{name} takes one argument, not {len(columns)}")
    c = F.col(columns[0]) if isinstance(columns[0], str) else columns[0]
    if not isinstance(df.select(c).schema[0].dataType, StringType):
        raise ArgumentError(f"{name} takes a string")
    return c


def lower(df: DataFrame, *columns: str | Column) -> Column:
    return F.lower(_one_string(df, "lower", columns))


def upper(df: DataFrame, *columns: str | Column) -> Column:
    return F.upper(_one_string(df, "upper", columns))
