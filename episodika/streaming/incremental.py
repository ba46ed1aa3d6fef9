"""Incremental runs on Structured Streaming: new files in, keyed tables out, with the same result when a batch comes again."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from episodika.operators import merge
from episodika.sources.tables import change_table, typed

# Fixed value: a source is left alone after this many failures in a row.
MAX_ERRORS_IN_A_ROW = 8


def changes_from(spark: SparkSession, folder: str, schema: T.StructType, pattern: str | None = None, files_per_batch: int = 1_000) -> DataFrame:
    """Files of a folder as a stream; the checkpoint of the query remembers which were read."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(folder)


def run_available(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Processes everything that has arrived since the last run, then stops."""
    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def upsert_into(
    spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], order: Sequence[str], columns: Sequence[str] | None = None, buckets: int = 64
) -> Callable[[DataFrame, int], None]:
    """Batch step: the last change of each key is merged into the table stored under ``path``.

    A change loses against a stored one that is newer by ``order``, so a batch that comes again, files that come late and several
    streams into one table, each with its own batch numbers, all end in the same rows. Only buckets with a changed key are rewritten.
    """
    def merged(stored: DataFrame, last: DataFrame) -> DataFrame:
        both = stored.select(*keys, F.struct(*order).alias("_at"))
        fresh = last.join(both, list(keys), "left").filter(F.col("_at").isNull() | (F.struct(*order) >= F.col("_at"))).drop("_at")
        return merge.upsert(stored, fresh, keys, columns)

    def apply(batch: DataFrame, batch_id: int) -> None:
        # in the stored types, or keys that become equal would count as two
        last = merge.latest_per_key(typed(batch, schema), keys, order)
        change_table(spark, path, schema, keys, last, merged, buckets)

    return apply


def chunk_step(spark: SparkSession, path: str, schema: T.StructType, order: Sequence[str], buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """Batch step for chunks: changed texts lose their vector and wait for the next embedding run."""
    def apply(batch: DataFrame, batch_id: int) -> None:
        kept = batch.withColumn("chunk_id", F.col("chunk_id").cast(schema["chunk_id"].dataType))
        last = merge.latest_per_key(kept, ["chunk_id"], order)
        last = last.select(*[f.name for f in schema if f.name != "embedding"])
        change_table(spark, path, schema, ["chunk_id"], last, merge.upsert_chunks, buckets)

    return apply


def process(items: DataFrame, work: Callable[[dict], tuple[str, str | None]], key: str, source: str, fetched_at) -> DataFrame:
    """Ledger rows of a work list: (key, source, status, detail, fetched_at). A failing item becomes an ``error`` row."""
    schema = f"{key} string, status string, detail string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for item in frame.to_dict("records"):
                try:
                    status, detail = work(item)
                except Exception as problem:  # one bad item must not stop the others
                    status, detail = "error", f"{type(problem).__name__}: {problem}"
                rows.append((str(item[key]), status, detail))
            yield pd.DataFrame(rows, columns=[key, "status", "detail"])

    done = items.mapInPandas(run, schema)
    return done.withColumn("source", F.lit(source)).withColumn("fetched_at", F.lit(fetched_at).cast("timestamp"))


def must_stop(ledger: DataFrame, source: str, limit: int = MAX_ERRORS_IN_A_ROW) -> bool:
    """True when the latest tries of a source all failed; checked between batches."""
    last = ledger.filter(F.col("source") == source).orderBy(F.col("fetched_at").desc()).limit(limit)
    row = last.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "error").alias("bad")).first()
    return row["n"] == limit and row["bad"] == limit
