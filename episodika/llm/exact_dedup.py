"""Exact duplicates through an extendible-hash index kept as files in the shared folder.

1. The directory is made from hashes alone. It starts at the depth that their number asks for; every bucket that holds more than
   ``capacity`` distinct hashes is split in two, round by round, until none is overfull or all 64 bits are used. A round
   reads only the hashes of overfull buckets and its slots are written, so no plan grows with the rounds.
2. Partial groups are inserted by slot: each task combines its own copies first, so a text that a third of all rows share is one row of
   each task. The owner of a slot's rows compares texts of one hash byte by byte: equal ones become one entry, others chain.
3. Entries are written in key order - a bucket, being a prefix of bits, is one key range of the files - with their place in the chain.
4. Every document reads its entry from the index by slot, hash and digest: the entry says which row stays and how large the group is.

No text is written or moved twice. Defined cases: a null text is an empty text; of rows with the same text the largest
``doc_id`` stays (nulls are smaller than all; rows that repeat both id and text are all marked as kept). Empty table: empty
result. Other columns are not looked at.
"""

from __future__ import annotations

import functools
import math
import uuid

from pyspark.sql import Column, DataFrame, Window, functions as F

from episodika.llm.common import ascii_lower, whole
from episodika.session import cut_lineage, shared_folder

#: entries that a bucket may hold
CAPACITY = 1 << 14
BITS = 64


def _bucket(depth: int, hash: str = "hash") -> Column:
    """The slot of a hash at a depth; slots of different depths never meet: a leading 1 marks where the bits begin."""
    if depth == 0:
        return F.lit(1).cast("long")
    bits = F.expr(f"shiftrightunsigned({hash}, {BITS - depth})")
    # at full depth there is no bit left for the mark, nor any other depth that could have the same number by chance
    return bits if depth == BITS else bits + F.lit(1 << depth if depth < 63 else -(1 << 63))


def directory(hashes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """bucket, depth, n (its distinct hashes): slots that cover all ``hashes`` (distinct, column hash) and hold at most ``capacity``.

    Two numbers of a round come to the driver: how many hashes there are, and how many buckets are too full.
    """
    live = cut_lineage(hashes.select("hash"))
    depth = min(BITS, max(0, math.ceil(math.log2(max(1, live.count()) / capacity))))
    settled = []
    while True:
        slots = cut_lineage(live.groupBy(_bucket(depth).alias("bucket")).agg(F.count(F.lit(1)).alias("n")))
        full = F.col("n") > (capacity if depth < BITS else 1 << 62)
        settled.append(slots.where(~full).select("bucket", F.lit(depth).alias("depth"), "n"))
        overfull = slots.where(full).select("bucket")
        if overfull.isEmpty():
            return functools.reduce(DataFrame.unionByName, settled)
        live = cut_lineage(live.join(overfull, _bucket(depth) == overfull["bucket"], "left_semi"))
        depth += 1


def place(entries: DataFrame, slots: DataFrame) -> DataFrame:
    """``entries`` (any columns with hash) with the bucket and depth of the slot that covers them."""
    depths = [row[0] for row in slots.select("depth").distinct().collect()]  # numbers from 0 to 64
    every = F.array(*[F.struct(F.lit(d).alias("depth"), _bucket(d).alias("bucket")) for d in sorted(depths)]) if depths else F.array().cast("array<struct<depth:int,bucket:bigint>>")
    tried = entries.select("*", F.explode(every).alias("_at")).select("*", "_at.*").drop("_at")
    return tried.join(slots.select("depth", "bucket"), ["depth", "bucket"])


def insert(hashed: DataFrame, depth: int) -> DataFrame:
    """slot, hash, digest, keep_id, group_size: entries of the rows (doc_id, norm, hash), texts of one hash compared as bytes."""
    groups = hashed.groupBy(_bucket(depth).alias("slot"), "hash", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return groups.select("slot", "hash", F.unhex(F.sha2("norm", 256)).alias("digest"), "keep_id", "group_size")


def write_index(entries: DataFrame, slots: DataFrame, path: str) -> DataFrame:
    """``entries`` with their bucket and place in the chain of their hash, written under ``path`` in key order."""
    chain = F.row_number().over(Window.partitionBy("bucket", "hash").orderBy("digest"))
    chained = place(entries, slots).repartitionByRange("bucket", "hash").withColumn("chain", chain)
    chained.sortWithinPartitions("bucket", "hash", "chain").write.parquet(path)
    return entries.sparkSession.read.schema(chained.schema).parquet(path)


def exact_dedup(docs: DataFrame, text: str = "text", id: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, bucket."""
    norm = ascii_lower(whole(text))
    hashed = docs.select(F.col(id).alias("doc_id"), norm.alias("norm")).withColumn("hash", F.xxhash64("norm"))
    slots = cut_lineage(directory(hashed.select("hash").distinct(), capacity))
    deepest = slots.agg(F.max("depth")).first()[0] or 0
    path = f"{shared_folder(docs.sparkSession).rstrip('/')}/index-{uuid.uuid4().hex}"
    index = write_index(insert(hashed, deepest), slots, path)
    probes = hashed.select("doc_id", _bucket(deepest).alias("slot"), "hash", F.unhex(F.sha2("norm", 256)).alias("digest"))
    found = probes.join(index, ["slot", "hash", "digest"])
    return found.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), "bucket",
    )
