"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ``[\x20\x09-\x0D]``
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: Column | str) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is.

    ``lower`` is the same for texts without other characters, and many times faster than ``translate``.
    """
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def as_text(id: str) -> Column:
    """The id for a way through pandas, which would round large integers beside a null; ``from_text`` is the way back."""
    return F.col(id).cast("string").alias("doc_id")


def from_text(df: DataFrame, kind: str) -> DataFrame:
    """``df`` with ``doc_id`` in the type it had before ``as_text``."""
    return df.withColumn("doc_id", F.col("doc_id").cast(kind))


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns called c0, c1, ... and those names by the old ones, so that no inner name can clash."""
    names = {name: f"c{i}" for i, name in reversed(list(enumerate(df.columns)))}
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), names


def replace_columns(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with these columns; a column of the same name, whatever its case, gives way."""
    taken = {name.lower() for name in columns}
    kept = [F.col(f"`{name}`") for name in df.columns if name.lower() not in taken]
    return df.select(*kept, *[value.alias(name) for name, value in columns.items()])
