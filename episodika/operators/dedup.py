"""Duplicate removal with map-side combining, so a body copied into a third of all rows is no hot spot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def keep_one(df: DataFrame, keys: Sequence[Column | str], better: Column, position: str | None = None) -> DataFrame:
    """The row with the largest ``better`` per key. With ``position`` that column becomes the smallest of the group.

    Keys that are long texts are grouped by their digest, which is what gets shuffled.
    """
    named = [F.col(k) if isinstance(k, str) else k for k in keys]
    keyed = df.select("*", *[k.alias(f"_k{i}") for i, k in enumerate(named)])
    names = [f"_k{i}" for i in range(len(named))]
    row = F.max_by(F.struct(*df.columns), better).alias("row")
    extra = [] if position is None else [F.min(position).alias("first_position")]
    best = keyed.groupBy(*names).agg(row, *extra)
    out = [
        F.col("first_position").alias(c) if c == position else F.col(f"row.{c}").alias(c) for c in df.columns
    ]
    return best.select(*out)


def digest(text: Column | str) -> Column:
    return F.sha2(F.col(text) if isinstance(text, str) else text, 256)
