"""The trie of conversation prefixes: a node for each distinct sequence of first turns, with sums over its subtree.

1. Turns become (conversation, place, digest of role and text, words). Places come from range-partitioned, sorted turns, so one
   conversation may span many tasks. Each conversation is rebuilt: a head taken from the first of its block of ids, then its own.
2. Sequences are cut into blocks of ``WIDTH`` turns; a block knows the rolling hash of all turns before it, so no row and no matrix
   grows with a conversation. Blocks are range-partitioned by (block, hash before, turns, conversation) into shards of a set size.
3. In a shard digests become dense ids and the blocks a padded matrix, ordered by ``numpy.lexsort``. A mask marks where a column
   differs from the row above; OR-accumulated over the columns it marks where nodes start, and ``reduceat`` over those starts adds
   up every depth: members, children, leaves, saved tokens, the ends.
4. Nodes that the shard's first or last row passes, and nodes whose conversations go on in another block, are open: their
   parts are added up by Spark. Open nodes are few - at most two paths for each shard besides long conversations - and
   form a tree of their own; sums over its subtrees come from jumps whose length doubles with each round.

A hash of a node's ends needs its members in order; where they lie in several shards they are streamed through one task as pieces of
bounded size, as SHA-256 has no parts to add up.

Defined cases: null role or text is empty. Null turns come first; turns of one number are ordered by their digest; rows that repeat
everything are turns of their own. A null ``conv_id`` is a conversation without a head of its own, the smallest, written as nothing; a node's
``conv_id`` is its smallest one that is not null. For negative ids ``c % block`` is not negative. Further columns are not looked at. Empty
table: empty result, without a root. Digests (MD5) and pairs of 64-bit hashes are taken as equal content.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from episodika.llm.common import whole
from episodika.session import cut_lineage

#: turns in a block; bytes of digests in a shard; ids in a piece of a node's ends
WIDTH, SHARD_BYTES, PIECE = 64, 16 << 20, 8192
#: contract of the query: conversations share a head with the first of twenty, of up to three turns
FAMILY, HEADS = 20, 4
NO_ENDS = hashlib.sha256(b"").hexdigest()
_NONE = np.iinfo(np.int64).max
_CONV = ["known", "conv"]


def ranked_turns(conversations: DataFrame) -> DataFrame:
    """known, conv, rank (from 1), key (digest in hex), words: one row per turn."""
    role, text = whole("role"), whole("text")
    turns = conversations.select(
        F.col("conv_id").isNotNull().alias("known"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0).cast("long")).alias("conv"), "turn",
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("key"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"), F.monotonically_increasing_id().alias("place"),
    )
    order = ["known", "conv", F.asc_nulls_first("turn"), "key", "place"]
    schema = "known boolean, conv long, key string, words long, task int, rank long"

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last, held = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            known, conv = (batch[c].to_numpy(zero_copy_only=False) for c in _CONV)
            starts = np.flatnonzero(np.r_[last != (known[0], conv[0]), (known[1:] != known[:-1]) | (conv[1:] != conv[:-1])])
            begins = np.zeros(len(conv), np.int64)
            begins[starts] = starts
            rank = np.arange(1, len(conv) + 1) - np.maximum.accumulate(begins)
            rank[: starts[0] if len(starts) else len(rank)] += held
            last, held = (known[-1], conv[-1]), int(rank[-1])
            yield pa.record_batch([*[batch[c] for c in ("known", "conv", "key", "words")], pa.array(np.full(len(conv), task, np.int32)), pa.array(rank)], names=["known", "conv", "key", "words", "task", "rank"])

    rows = turns.repartitionByRange(*order).sortWithinPartitions(*order).drop("turn", "place").mapInArrow(number, schema)
    rows = cut_lineage(rows)
    # what the earlier tasks hold of a conversation; one row for each conversation and task
    before = F.sum("n").over(Window.partitionBy(*_CONV).orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    parts = rows.groupBy(*_CONV, "task").agg(F.count(F.lit(1)).alias("n")).withColumn("before", before).where("before is not null").drop("n")
    joined = rows.join(parts, [*_CONV, "task"], "left")
    return joined.select(*_CONV, (F.col("rank") + F.coalesce("before", F.lit(0))).alias("rank"), "key", "words")


def rebuilt_turns(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """known, conv, total, pos (from 1), key, words: turns after rebuilding; one row with a null ``pos`` for a conversation without any.

    The first h turns, h below ``heads`` by the hash of the id, are those of the conversation ``conv - conv % family``.
    """
    h = F.when(F.col("known"), F.crc32(F.col("conv").cast("string").cast("binary")) % heads).otherwise(0).cast("long")
    base = F.col("conv") - F.pmod("conv", F.lit(family))
    first = turns.where(F.col("known") & (F.pmod("conv", F.lit(family)) == 0) & (F.col("rank") < heads))
    first = first.groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(F.struct("rank", "key", "words"))).alias("head"))
    convs = turns.groupBy(*_CONV).agg(F.count(F.lit(1)).alias("own")).withColumns({"h": h, "base": F.when(F.col("known"), base)})
    convs = convs.join(first, "base", "left").withColumn("head", F.when(F.col("h") > 0, F.slice("head", F.lit(1), F.greatest("h", F.lit(1)).cast("int"))))
    n_head = F.coalesce(F.when(F.col("head").isNotNull(), F.size("head")), F.lit(0)).cast("long")
    convs = convs.withColumn("n_head", n_head).withColumn("total", F.col("n_head") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    convs = cut_lineage(convs.select(*_CONV, "h", "n_head", "total", "head"))
    out = [*_CONV, "total", "pos", "key", "words"]
    taken = convs.where("n_head > 0").select(*_CONV, "total", F.explode("head").alias("x")).select(*_CONV, "total", F.col("x.rank").alias("pos"), "x.key", "x.words")
    own = turns.join(convs.drop("head"), _CONV).where("rank > h").withColumn("pos", F.col("rank") - F.col("h") + F.col("n_head"))
    none = convs.where("total = 0").select(*_CONV, "total", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("long").alias("words"))
    return taken.select(out).unionByName(own.select(out)).unionByName(none)


def blocks_of(turns: DataFrame, width: int = WIDTH) -> DataFrame:
    """known, conv, total, block, seq (digests end to end), words, p1, p2 (hash of the turns before), q1, q2 (and of this block's)."""
    block = F.coalesce(F.floor((F.col("pos") - 1) / width), F.lit(0)).cast("long")
    said = F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "key", "words"))))
    rows = turns.groupBy(*_CONV, "total", block.alias("block")).agg(said.alias("said"))
    seq = F.unhex(F.array_join(F.transform("said", lambda s: s["key"]), ""))
    rows = rows.select(*_CONV, "total", "block", seq.alias("seq"), F.transform("said", lambda s: s["words"]).alias("words"))
    rows = cut_lineage(rows.withColumns({"s1": F.xxhash64("block", "seq"), "s2": F.xxhash64(F.lit("second"), "block", "seq")}))
    # only conversations of several blocks have turns before one: light rows, one for each block
    earlier = Window.partitionBy(*_CONV).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    prefix = rows.where(F.col("total") > width).select(*_CONV, "block", *[F.coalesce(F.bit_xor(s).over(earlier), zero).alias(p) for s, p in (("s1", "p1"), ("s2", "p2"))])
    joined = rows.join(prefix, [*_CONV, "block"], "left").withColumns({p: F.coalesce(p, zero) for p in ("p1", "p2")})
    return joined.select(*_CONV, "total", "block", "seq", "words", "p1", "p2", *[F.col(p).bitwiseXOR(F.col(s)).alias(q) for p, s, q in (("p1", "s1", "q1"), ("p2", "s2", "q2"))])


#: kinds of rows a shard gives: whole nodes, whole nodes below an open one, parts of open nodes, ends of open nodes
NODE, BELOW, OPEN, ENDS = range(4)
_OUT = {
    "kind": pa.int32(), "key": pa.binary(), "parent": pa.binary(), "conv_id": pa.int64(), "depth": pa.int64(), "parent_conv_id": pa.int64(), "n_convs": pa.int64(),
    "n_children": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "words": pa.int64(), "ends": pa.string(),
}
_SCHEMA = "kind int, key binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, words long, ends string"
_TOP = struct.Struct(">qqq")


class Shard:
    """The padded matrix of a shard's blocks, in order, and the nodes in it."""

    def __init__(self, rows: pa.Table, width: int):
        self.width, self.n = width, rows.num_rows
        column = lambda name: rows[name].combine_chunks().to_numpy(zero_copy_only=False)
        self.seq = rows["seq"].to_pylist()
        lengths = np.fromiter(map(len, self.seq), np.int64, self.n) // 16
        used = int(lengths.max(initial=0))
        keys = np.frombuffer(b"".join(self.seq), ">u8").reshape(-1, 2).astype(np.uint64)
        by_key = np.lexsort((keys[:, 1], keys[:, 0]))
        fresh = np.r_[True, (keys[by_key][1:] != keys[by_key][:-1]).any(axis=1)] if len(keys) else np.zeros(0, bool)
        ids = np.empty(len(keys), np.int64)
        ids[by_key] = np.cumsum(fresh)  # dense, from 1, in the order of the digests; 0 pads
        inside = np.arange(used) < lengths[:, None]
        matrix, words = np.zeros((self.n, used), np.int64), np.zeros((self.n, used), np.int64)
        matrix[inside] = ids
        words[inside] = rows["words"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        block, p1, p2, q1, q2, conv, total = (column(c) for c in ("block", "p1", "p2", "q1", "q2", "conv", "total"))
        known = column("known")
        self.order = np.lexsort((conv, known, *matrix.T[::-1], p2, p1, block))
        self.matrix, self.words, self.lengths = matrix[self.order], words[self.order], lengths[self.order]
        self.block, self.p1, self.p2, self.q1, self.q2 = (x[self.order] for x in (block, p1, p2, q1, q2))
        self.conv, self.known = conv[self.order], known[self.order]
        self.goes_on = total[self.order] > (self.block + 1) * width
        self.low = np.where(self.known, self.conv, _NONE)
        group = np.r_[True, (self.block[1:] != self.block[:-1]) | (self.p1[1:] != self.p1[:-1]) | (self.p2[1:] != self.p2[:-1])]
        self.tops = np.flatnonzero(group)
        change = np.ones((self.n, used), bool)
        change[1:] = self.matrix[1:] != self.matrix[:-1]
        if used:
            change[:, 0] |= group
        self.starts = np.logical_or.accumulate(change, axis=1)
        self.text = [str(c) if k else "" for c, k in zip(self.conv.tolist(), self.known.tolist(), strict=True)]

    def top_key(self, row: int) -> bytes:
        return _TOP.pack(int(self.block[row]), int(self.p1[row]), int(self.p2[row]))

    def key(self, row: int, column: int) -> bytes:
        """Of the node of the row's first ``column + 1`` turns in its block; the last one is the top of the next block."""
        if column < 0:
            return self.top_key(row)
        if column == self.width - 1:
            return _TOP.pack(int(self.block[row]) + 1, int(self.q1[row]), int(self.q2[row]))
        return hashlib.md5(self.top_key(row) + self.seq[self.order[row]][: 16 * (column + 1)]).digest()

    def _pieces(self, key: bytes, rows: np.ndarray) -> dict:
        """Ids that end at an open node, as rows of kind ENDS; ``conv_id`` and ``words`` order them."""
        at = range(0, len(rows), PIECE)
        return {
            "kind": [ENDS] * len(at), "key": [key] * len(at), "conv_id": [int(self.conv[rows[i]]) for i in at],
            "words": [int(self.known[rows[i]]) for i in at], "ends": [",".join([self.text[r] for r in rows[i : i + PIECE].tolist()]) for i in at],
        }

    def nodes(self) -> Iterator[dict]:
        """Columns of rows, from the deepest turn of the blocks up to their tops."""
        n, used = self.n, self.matrix.shape[1]
        leaves, saved = np.zeros(n, np.int64), np.zeros(n, np.int64)  # of the closed nodes met so far, at the row they start in
        closed_below = np.zeros(n, np.int64)  # closed nodes that start one column further
        for j in range(used - 1, -1, -1):
            run = np.flatnonzero(self.starts[:, j])
            count = np.diff(np.r_[run, n])
            real = self.matrix[run, j] != 0
            is_open = (run == 0) | (run + count == n) | np.logical_or.reduceat(self.goes_on, run)
            children = np.add.reduceat(closed_below, run)
            closed = real & ~is_open
            saved[run[closed]] += (count[closed] - 1) * self.words[run[closed], j]
            leaves[run[closed]] += children[closed] == 0
            all_saved, all_leaves, low = np.add.reduceat(saved, run), np.add.reduceat(leaves, run), np.minimum.reduceat(self.low, run)
            # what lies below an open node is its own; nodes above it are open too and get it from the sums over open nodes
            taken = np.repeat(real & is_open, count)
            saved[taken], leaves[taken] = 0, 0
            closed_below = np.zeros(n, np.int64)
            closed_below[run[closed]] = 1
            ending = (self.lengths == j + 1) & ~self.goes_on
            n_ends = np.add.reduceat(ending.astype(np.int64), run)
            # the run of the column before that each run lies in
            upper = np.flatnonzero(self.starts[:, j - 1]) if j else self.tops
            above = np.searchsorted(upper, run, "right") - 1
            upper_count = np.diff(np.r_[upper, n])
            upper_open = (upper == 0) | (upper + upper_count == n) | np.logical_or.reduceat(self.goes_on, upper) if j else np.ones(len(upper), bool)
            upper_low = np.minimum.reduceat(self.low, upper)
            keys = {i: self.key(int(upper[i]), j - 1) for i in np.unique(above[real]).tolist() if upper_open[i]}
            depth = self.block * self.width + j + 1
            for kind, some in ((NODE, closed & ~upper_open[above]), (BELOW, closed & upper_open[above]), (OPEN, real & is_open)):
                some = np.flatnonzero(some)
                if not len(some):
                    continue
                at = run[some]
                out = {
                    "kind": np.full(len(some), kind, np.int32), "conv_id": pa.array(low[some], mask=low[some] == _NONE), "depth": depth[at], "n_convs": count[some],
                    "n_children": children[some], "n_leaves": all_leaves[some], "saved_tokens": all_saved[some], "words": self.words[at, j],
                }
                if kind == NODE:
                    parent = upper_low[above[some]]
                    out["parent_conv_id"] = pa.array(parent, mask=parent == _NONE)
                else:
                    out["parent"] = [keys[i] for i in above[some].tolist()]
                if kind == OPEN:
                    out["key"] = [self.key(int(r), j) for r in at.tolist()]
                else:
                    out["ends"] = [
                        hashlib.sha256(",".join(self.text[r : r + k]).encode()).hexdigest() if k else NO_ENDS for r, k in zip(at.tolist(), n_ends[some].tolist(), strict=True)
                    ]  # members that end at a closed node come first in its run
                yield out
                if kind == OPEN:
                    for i, key in zip(some.tolist(), out["key"], strict=True):
                        if n_ends[i]:
                            rows = np.arange(run[i], run[i] + count[i])
                            yield self._pieces(key, rows[ending[rows]])
        count = np.diff(np.r_[self.tops, n])
        root = self.block[self.tops] == 0
        low = np.minimum.reduceat(self.low, self.tops)
        # above the first block the node itself comes with the block before, only the sums below it are added here
        yield {
            "kind": np.full(len(count), OPEN, np.int32), "key": [self.top_key(int(r)) for r in self.tops], "conv_id": pa.array(low, mask=~root | (low == _NONE)),
            "depth": self.block[self.tops] * self.width, "n_convs": np.where(root, count, 0), "n_children": np.add.reduceat(closed_below, self.tops),
            "n_leaves": np.add.reduceat(leaves, self.tops), "saved_tokens": np.add.reduceat(saved, self.tops), "words": np.zeros(len(count), np.int64),
        }
        without = np.flatnonzero((self.lengths == 0) & ~self.goes_on)
        if len(without):
            yield self._pieces(self.top_key(int(without[0])), without)


def shard_nodes(blocks: DataFrame, width: int = WIDTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Rows of all kinds from every shard of ``blocks``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if held:
            for columns in Shard(pa.Table.from_batches(held), width).nodes():
                size = len(columns["kind"])
                yield pa.record_batch(
                    [pa.array(columns[c], kind) if c in columns else pa.nulls(size, kind) for c, kind in _OUT.items()], names=list(_OUT)
                )

    # 16 bytes of digest and 8 of words for each turn, some 64 for each block
    total = blocks.agg(F.sum(F.octet_length("seq") * 1.5 + 64)).first()[0] or 0
    shards = max(1, math.ceil(total / shard_bytes))
    return blocks.repartitionByRange(shards, "block", "p1", "p2", "seq", "known", "conv").mapInArrow(run, _SCHEMA)


def _subtrees(nodes: DataFrame) -> DataFrame:
    """``nodes`` (key, parent, depth, n_leaves, saved_tokens, ...) with both sums over all nodes below.

    In round k a node has the sums of what lies less than 2^k steps below it, and its jump is 2^k steps above.
    """
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    sums = ["n_leaves", "saved_tokens"]
    state = nodes.select("key", F.col("parent").alias("jump"), *sums)
    for _ in range(int(deepest).bit_length()):
        gained = state.where("jump is not null").groupBy(F.col("jump").alias("at")).agg(*[F.sum(c).alias(f"more_{c}") for c in sums])
        jumps = state.select(F.col("key").alias("over"), F.col("jump").alias("further"))
        state = state.join(gained, F.col("key") == F.col("at"), "left").join(jumps, F.col("jump") == F.col("over"), "left").select(
            "key", F.col("further").alias("jump"), *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in sums]
        )
        state = cut_lineage(state)
    return nodes.drop(*sums).join(state.drop("jump"), "key")


def _hashed_ends(pieces: DataFrame) -> DataFrame:
    """key, ends: SHA-256 of each key's pieces in order, comma-joined; a task holds one piece at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, done = None, None, []
        for batch in batches:
            for key, ids in zip(batch["key"].to_pylist(), batch["ends"], strict=True):
                if key != last:
                    if state is not None:
                        done.append((last, state.hexdigest()))
                    last, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.as_py().encode())
        if state is not None:
            done.append((last, state.hexdigest()))
        yield pa.record_batch([pa.array([k for k, _ in done], pa.binary()), pa.array([e for _, e in done], pa.string())], names=["key", "ends"])

    # ``words`` is 0 for the conversation without an id, which comes first
    ordered = pieces.repartition("key").sortWithinPartitions("key", "words", "conv_id").select("key", "ends")
    return ordered.mapInArrow(run, "key binary, ends string")


def prefix_trie(conversations: DataFrame, family: int = FAMILY, heads: int = HEADS, width: int = WIDTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row per node."""
    turns = cut_lineage(ranked_turns(conversations))
    blocks = cut_lineage(blocks_of(rebuilt_turns(turns, family, heads), width))
    rows = cut_lineage(shard_nodes(blocks, width, shard_bytes))
    parts = rows.where(F.col("kind") == OPEN).groupBy("key").agg(
        F.max("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.max("words").alias("words"),
    )
    parts = cut_lineage(parts)
    inner = parts.where("parent is not null").groupBy(F.col("parent").alias("at")).agg(F.count(F.lit(1)).alias("n_open"))
    nodes = parts.join(inner, F.col("key") == F.col("at"), "left").withColumn("n_children", F.col("n_children") + F.coalesce("n_open", F.lit(0)))
    nodes = nodes.withColumns({
        "n_leaves": F.col("n_leaves") + (F.col("n_children") == 0).cast("long"), "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words"),
    }).drop("at", "n_open", "words")
    nodes = cut_lineage(nodes)
    open_nodes = _subtrees(nodes)
    names = cut_lineage(nodes.select(F.col("key").alias("of"), F.col("conv_id").alias("parent_conv_id")))
    ends = _hashed_ends(rows.where(F.col("kind") == ENDS)).withColumnRenamed("key", "ended")
    open_nodes = open_nodes.join(ends, F.col("key") == F.col("ended"), "left").join(names, F.col("parent") == F.col("of"), "left")
    below = rows.where(F.col("kind") == BELOW).drop("parent_conv_id").join(names, F.col("parent") == F.col("of"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256")]
    return rows.where(F.col("kind") == NODE).select(columns).unionByName(below.select(columns)).unionByName(open_nodes.select(columns))
