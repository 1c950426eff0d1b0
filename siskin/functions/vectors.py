"""Vectors: arrays of doubles of one declared length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector(*elements: float | Column, length: int | None = None) -> Column:
    """array<double> of the elements; a declared length must be theirs."""
    if length is not None and length != len(elements):
        raise ValueError(f"a vector of {length} was declared, {len(elements)} elements given")
    return F.array(*((e if isinstance(e, Column) else F.lit(float(e))).cast("double") for e in elements))
