"""Tables as parquet folders cut into buckets by key: a change rewrites the buckets it touches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

BUCKET = "_bucket"


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The stored rows with the bucket they lie in; none where nothing was written yet."""
    with_bucket = T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], with_bucket)
    return spark.read.schema(with_bucket).parquet(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows stored under ``path``; none where nothing was written yet."""
    return _stored(spark, path, schema).drop(BUCKET)


def typed(df: DataFrame, schema: T.StructType, fill: bool = False) -> DataFrame:
    """The columns of ``schema`` that ``df`` has, in the schema's types; ``fill`` adds the others as NULL."""
    own = {c.lower() for c in df.columns}
    value = lambda f: F.col(f.name) if f.name.lower() in own else F.lit(None)
    return df.select(*[value(f).cast(f.dataType).alias(f.name) for f in schema if fill or f.name.lower() in own])


def change_table(
    spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], changes: DataFrame, plan: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = 64
) -> None:
    """Applies ``plan(stored rows, changes)`` to the buckets that hold a changed key; the others are not read or written.

    Changes get the stored types first: a key's bucket depends on its type. Spark replaces the written buckets when the job commits, so a
    failed change leaves the old rows. ``plan`` must give the same rows when the same changes come again. Columns are added, never
    dropped; missing ones become NULL.
    """
    bucket = F.pmod(F.hash(*keys), F.lit(buckets)).cast("int")
    changes = typed(changes, schema)
    touched = [row[0] for row in changes.select(bucket).distinct().collect()]  # at most ``buckets`` numbers
    if not touched:
        return
    stored = _stored(spark, path, schema).filter(F.col(BUCKET).isin(touched)).drop(BUCKET)
    rows = typed(plan(stored, changes), schema, fill=True).withColumn(BUCKET, bucket)
    rows.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def copy_tables(tables: dict[str, DataFrame], ids: DataFrame, target: str, key: str = "series_id", skip: dict[str, Sequence[str]] | None = None) -> None:
    """Copies the rows of the listed ids of several tables into one folder each."""
    for name, df in tables.items():
        rows = df.join(ids.select(key), key, "left_semi").drop(*(skip or {}).get(name, ()))
        rows.write.mode("overwrite").parquet(f"{target.rstrip('/')}/{name}")


def violations(df: DataFrame, keys: Sequence[str], not_null: Sequence[str] = (), checks: dict[str, str] | None = None) -> DataFrame:
    """Broken constraints as rows (constraint, n); empty when all hold. The engine does not enforce them, tests do."""
    repeated = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("n"))
    counts = df.agg(
        *[F.count_if(F.col(c).isNull()).alias(f"{c} not null") for c in not_null],
        *[F.count_if(~F.coalesce(F.expr(e), F.lit(True))).alias(n) for n, e in (checks or {}).items()],
        F.lit(0).alias("_"),
    )
    names = [c for c in counts.columns if c != "_"]
    pairs = F.array(*[F.struct(F.lit(n).alias("constraint"), F.col(n).cast("long").alias("n")) for n in names]) if names else None
    out = repeated.select(F.lit("unique key").alias("constraint"), "n")
    if pairs is not None:
        out = out.unionByName(counts.select(F.explode(pairs).alias("x")).select("x.constraint", "x.n"))
    return out.filter(F.col("n") > 0)


def missing_parents(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Child rows whose parent is gone."""
    return children.filter(F.col(key).isNotNull()).join(parents.select(key), key, "left_anti")
