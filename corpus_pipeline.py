"""Cleaning a corpus: ``STAGES`` over ``documents``, each written as Parquet and read again for the next.

All stages but the last return the columns of documents. No stage looks at another table, and each judges all rows it gets.

Defined cases: further columns come through unchanged, whatever their names. Rows that repeat id and text are one document to the
near-duplicate stage, which keeps one of them, and separate rows to the others. A null id is an id like any other; of a group of near
duplicates a document with an id stays before one without. An empty table gives empty results in every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from episodika.llm import langid, line_dedup as lines, near_dedup, packing, secrets
from episodika.llm.common import numbered, whole
from episodika.session import shared_folder


def _as_documents(df: DataFrame, docs: DataFrame, **values) -> DataFrame:
    """The columns of ``docs`` from ``df``, whose columns are numbered; ``values`` replace some, and the length of the text is brought up to date."""
    text = values.get("text", F.col(numbered(docs)[1]["text"]))
    values = {"n_chars": F.length(whole(text)), **values}
    value = lambda i, c: values.get(c, F.col(f"c{i}"))
    return df.select(*[value(i, c).cast(kind).alias(c) for i, (c, kind) in enumerate(docs.dtypes)])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is told apart, their ``lang`` set to it; letterless and undecided ones go."""
    base, at = numbered(docs)
    row = F.xxhash64(whole(at["text"]))
    rows = langid.document_rows(docs).withColumn("row", F.xxhash64(whole("text")))
    decided = langid.languages(rows, langid.fit_text(docs)).where("kept")
    decided = decided.groupBy("doc_id", "row").agg(F.max("language").alias("language"))
    kept = base.withColumn("own", row).join(decided, F.col(at["doc_id"]).eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("row")))
    return _as_documents(kept, docs, lang=F.col("language"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines shared by many documents stay in one of them only."""
    kept = lines.line_dedup(docs)
    return _as_documents(numbered(kept)[0], docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document stays: that with the group's smallest id, and of several with it the smallest hash."""
    base, at = numbered(docs)
    base = base.withColumn("own", F.struct(F.col(at["doc_id"]).isNull().alias("none"), F.col(at["doc_id"]).alias("id"), F.xxhash64(whole(at["text"])).alias("row")))
    found = near_dedup.near_duplicates(base, text=at["text"], id="own").where(F.col("doc_id") == F.col("component_id"))
    found = found.groupBy(F.col("doc_id.none").alias("none"), F.col("doc_id.id").alias("id"), F.col("doc_id.row").alias("row")).agg(F.count(F.lit(1)).alias("copies"))
    same = F.col(at["doc_id"]).eqNullSafe(F.col("id")) & (F.col("own.row") == F.col("row"))
    kept = base.join(found, same)
    # rows that repeat id and text: hardly ever any, so that texts are not compared for it
    one = kept.where("copies = 1").unionByName(kept.where("copies > 1").dropDuplicates(["id", "row"]))
    return _as_documents(one, docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are blotted out; every document stays."""
    base, at = numbered(docs)
    found = secrets.scan_secrets(base, text=at["text"], id=at["doc_id"])
    return _as_documents(found, docs, text=secrets.redacted(F.col(at["text"]), F.col("spans")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in windows."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup_stage), ("secret_scans", secret_scans),
    ("packing", pack),
]

#: hashing, tokenizers and windows filled in order are not SQL; tests compare with a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        result = stage(spark, docs, sf_dir)
        result.write.parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
    return docs
