"""Vectors kept by content: a text that was encoded once with a model is never encoded again, whichever chunk or method it stands in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from episodika.config import DEFAULTS, Settings
from episodika.plans.embedding import Encoder, encode_texts

SCHEMA = "key string, embedding array<float>"


def content_key(model: str, text: Column | str) -> Column:
    """Digest of the model's name and the text; the name's length stands before it, so that no two pairs run into one."""
    text = F.col(text) if isinstance(text, str) else text
    return F.sha2(F.concat(F.lit(f"{len(model)}:{model}:"), F.coalesce(text, F.lit(""))), 256)


def keyed(texts: DataFrame, model: str) -> DataFrame:
    """``texts`` with the ``_key`` of their text; one that they bring stays, so that who keeps it need not carry texts further."""
    return texts if "_key" in texts.columns else texts.withColumn("_key", content_key(model, "text"))


def stored(spark: SparkSession, path: str) -> DataFrame:
    """key, embedding: everything that was encoded so far; a key written by two runs at once counts once."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(path).dropDuplicates(["key"])


def encode_missing(texts: DataFrame, path: str, model: str, make_encoder: Callable[[], Encoder], settings: Settings = DEFAULTS) -> int:
    """Encodes the distinct texts (column text) that the store lacks and appends them; how many there were.

    Texts move once: the search for copies spreads them by key. They are sorted by length inside a task, so that alike texts make up a batch.
    """
    spark = texts.sparkSession
    wanted = keyed(texts, model).select(F.col("_key").alias("key"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["key"])
    todo = wanted.join(stored(spark, path).select("key"), "key", "left_anti")
    before = stored(spark, path).count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            if batch.num_rows:
                encoder = encoder or make_encoder()
                vectors = encode_texts(encoder, batch["text"].to_pylist(), settings.passage_prefix, settings)
                yield pa.record_batch([batch["key"], pa.array(list(vectors), pa.list_(pa.float32()))], names=["key", "embedding"])

    todo.sortWithinPartitions(F.length("text")).mapInArrow(run, SCHEMA).write.mode("append").parquet(path)
    return stored(spark, path).count() - before


def with_vectors(texts: DataFrame, path: str, model: str) -> DataFrame:
    """``texts`` with the stored ``embedding`` of their text or ``_key``; NULL where it was not encoded."""
    known = stored(texts.sparkSession, path).withColumnRenamed("key", "_key")
    return keyed(texts, model).join(known, "_key", "left").drop("_key")
