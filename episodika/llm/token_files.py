"""Token ids of documents in Parquet files that can be read in part.

Documents are range-partitioned and sorted by id, encoded where they are, and written with their token list and metadata side by
side: the list dictionary-coded (few distinct ids against many) or delta-coded, ids and lengths delta-coded, row groups and
pages of set sizes, with page indexes. A reader of metadata does not touch the lists; a reader of a range of ids skips row groups by
their bounds and pages by the index.

A folder holds ``tokens`` (shard, doc_id, at: ids before it in its shard, n_tokens, ids) and ``shards`` (shard, before: ids in all
earlier shards, n_docs, n_tokens, low, high): a row for each task that wrote, from metadata alone. A document's place in the
whole is ``before + at``, so nothing is written twice for it.

Defined cases: a null text is an empty text, the end id alone. Order: null ids first, then ascending ids; rows that repeat an id by
the hash of their text. Rows that repeat both come once per row; a hot id is split over tasks by hash and place in the input.
Other columns are not looked at. Empty table: an empty folder that reads as no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from episodika.llm.bpe import encode
from episodika.llm.common import whole
from episodika.llm.tokens import vocabulary_path

END_ID = 0
#: bytes of a row group and of a page, rows of a page at most
ROW_GROUP, PAGE, PAGE_ROWS = 32 << 20, 256 << 10, 2_000
#: tokens that a task gathers before it hands them on
HELD = 1 << 20
ENCODINGS = ("dictionary", "delta")


def writer_options(encoding: str = "dictionary", row_group: int = ROW_GROUP, page: int = PAGE, page_rows: int = PAGE_ROWS) -> dict[str, str]:
    """Options of Spark's Parquet writer. Without a dictionary, pages of version 2 hold integers as deltas."""
    if encoding not in ENCODINGS:
        raise ValueError(f"encoding is one of {', '.join(ENCODINGS)}")
    return {
        "parquet.writer.version": "v2", "parquet.enable.dictionary": "false",
        "parquet.enable.dictionary#ids.list.element": str(encoding == "dictionary").lower(), "parquet.dictionary.page.size": str(1 << 20),
        "parquet.block.size": str(row_group), "parquet.page.size": str(page), "parquet.page.row.count.limit": str(page_rows),
    }


def write_tokens(
    docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, encoding: str = "dictionary", row_group: int = ROW_GROUP,
    page: int = PAGE, page_rows: int = PAGE_ROWS, text: str = "text", id: str = "doc_id",
) -> None:
    """Writes the folder ``path``, which all machines must share."""
    vocabulary = vocabulary or vocabulary_path("byte_bpe_50k.json")
    base = docs.select(F.col(id).alias("doc_id"), whole(text).alias("text"))
    base = base.select("doc_id", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("place"), "text")
    kind = dict(base.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, at = TaskContext.get().partitionId(), 0

        def rows(keys: pa.Array, lists: list[np.ndarray], first: int) -> pa.RecordBatch:
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            ids = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(np.concatenate(lists).astype(np.int32)))
            columns = [pa.array(np.full(len(lists), shard, np.int32)), keys, pa.array(first + bounds[:-1]), pa.array(sizes), ids]
            return pa.record_batch(columns, names=["shard", "doc_id", "at", "n_tokens", "ids"])

        for batch in batches:
            lists, begin, held = [], 0, 0
            for i, content in enumerate(batch["text"]):
                lists.append(np.append(encode(content.as_py(), vocabulary), np.uint32(end_id)))
                held += len(lists[-1])
                if held >= HELD or i + 1 == batch.num_rows:
                    yield rows(batch["doc_id"].slice(begin, len(lists)), lists, at)
                    at, begin, lists, held = at + held, i + 1, [], 0

    order = [F.asc_nulls_first("doc_id"), F.col("tie"), F.col("place")]
    ordered = base.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    coded = ordered.mapInArrow(run, f"shard int, doc_id {kind}, at long, n_tokens long, ids array<int>")
    coded.write.options(**writer_options(encoding, row_group, page, page_rows)).parquet(f"{path}/tokens")
    written = docs.sparkSession.read.schema(coded.schema).parquet(f"{path}/tokens")
    shards = written.groupBy("shard").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")
    )
    # a row for each task that wrote, so one task may add them up
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards.withColumn("before", F.coalesce(before, F.lit(0).cast("long"))).write.parquet(f"{path}/shards")


def read_tokens(spark: SparkSession, path: str, low=None, high=None, ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and, if asked for, ``ids``; of documents from ``low`` to ``high``."""
    tokens, shards = spark.read.parquet(f"{path}/tokens"), spark.read.parquet(f"{path}/shards").select("shard", "before")
    for bound, inside in ((low, F.col("doc_id") >= low), (high, F.col("doc_id") <= high)):
        if bound is not None:
            tokens = tokens.where(inside)
    columns = ["doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", *["ids"] * ids]
    return tokens.join(shards, "shard").select(*columns)


def checksums(tokens: DataFrame) -> DataFrame:
    """The other columns of ``tokens`` with ``ids_crc32``: of the ids as little-endian unsigned 32-bit integers."""
    others = [(name, kind) for name, kind in tokens.dtypes if name != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = memoryview(batch["ids"].flatten().to_numpy(zero_copy_only=False).astype("<i4", copy=False)).cast("B")
            ends = 4 * np.cumsum(batch["ids"].value_lengths().to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros(0, np.int64)
            crcs, at = [], 0
            for end in ends.tolist():
                crcs.append(zlib.crc32(flat[at:end]))
                at = end
            yield pa.record_batch([*[batch[name] for name, _ in others], pa.array(crcs, pa.int64())], names=[*[name for name, _ in others], "ids_crc32"])

    return tokens.mapInArrow(run, ", ".join(f"`{name}` {kind}" for name, kind in others) + ", ids_crc32 long")
