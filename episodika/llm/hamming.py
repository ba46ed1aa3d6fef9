"""Fingerprints within a Hamming radius of each other, found through tables of masked bits.

A table is a bit mask; fingerprints that agree on all masked bits share a bucket. ``block_masks`` leaves out one more block
of bits than the radius has, each block a table of its own; ``covering_masks`` is the structured family of covering hashing.
Both guarantee that every pair within the radius meets in some table, so the search is exact.

``links`` cuts a bucket into cells of about ``CELL`` fingerprints squared: each cell is compared in one array operation, and a bucket
with a third of all fingerprints is many cells on many tasks. ``neighbour_counts`` goes by pairs of blocks, so that what is compared
stays small however many fingerprints there are: it cuts one block more than the radius needs, sorts by one block and, inside a bucket,
by a second. What a cell or bucket returns is at most in proportion to its members - counts or a spanning forest - never its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from episodika.session import cut_lineage

#: fingerprints on each side of a cell
CELL = 2048
#: members of a bucket that are compared as they are, and that one task holds; larger buckets are cut by a second block on many tasks
FEW, LARGE = 64, 1 << 16

Masks = list[list[int]]


def block_masks(bits: int, radius: int) -> Masks:
    """radius + 1 blocks of bits: a pair within the radius leaves one untouched. One list of 64-bit words per table."""
    edges = [bits * i // (radius + 1) for i in range(radius + 2)]
    return [_words((1 << high) - (1 << low), bits) for low, high in zip(edges, edges[1:], strict=False)]


def covering_masks(bits: int, radius: int) -> Masks:
    """Every bit gets a non-zero vector of radius + 1 bits, all equally often; table v masks the bits whose vector has odd overlap with v.

    The vectors of at most ``radius`` differing bits span less than the whole space, so some v is orthogonal to all of them:
    the pair agrees on that table's bits.
    """
    vectors = range(1, 1 << (radius + 1))
    own = [vectors[i % len(vectors)] for i in range(bits)]
    return [_words(sum(1 << i for i in range(bits) if (own[i] & v).bit_count() % 2), bits) for v in vectors]


def _words(mask: int, bits: int) -> list[int]:
    """Signed 64-bit words, lowest first."""
    parts = [(mask >> at) & ((1 << 64) - 1) for at in range(0, bits, 64)]
    return [p - (1 << 64) if p >> 63 else p for p in parts]


def _keyed(fingerprints: DataFrame, columns: list[str], masks: Masks) -> DataFrame:
    """columns, table, bucket: a row for each table."""
    keys = [F.xxhash64(F.lit(t), *[F.col(c).bitwiseAND(F.lit(m)) for c, m in zip(columns, mask, strict=True)]) for t, mask in enumerate(masks)]
    return fingerprints.select(*columns, F.posexplode(F.array(*keys)).alias("table", "bucket"))


def _cut(keyed: DataFrame, columns: list[str], cell: int) -> DataFrame:
    """Rows of all cells with something to compare, sorted by cell inside each partition."""
    crowded = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sides = F.ceil(F.col("n") / cell).cast("int")
    rows = keyed.join(crowded, "bucket").withColumn("sides", sides)
    rows = rows.withColumn("own", F.pmod(F.xxhash64(F.lit("cell"), *columns), F.col("sides")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    rows = rows.select("bucket", "table", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", *columns)
    return rows.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "own", *columns)


def cells(fingerprints: DataFrame, columns: list[str], masks: Masks, cell: int = CELL) -> DataFrame:
    """Rows of all cells of all tables; ``fingerprints`` are distinct."""
    return _cut(_keyed(fingerprints, columns, masks), columns, cell)


def _close(words: np.ndarray, own: np.ndarray, radius: int) -> np.ndarray:
    """Boolean matrix of the pairs to report: within the radius, across the two sides of a cell that has two."""
    distance = np.zeros((len(words), len(words)), np.uint16)
    for w in words.T:
        distance += np.bitwise_count(w[:, None] ^ w[None, :])
    near = distance <= radius
    if own[0] != own[-1]:
        near &= own[:, None] != own[None, :]
    np.fill_diagonal(near, False)
    return near


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges from the first member of every connected part to its others."""
    unseen, edges = near.any(axis=0), []
    while unseen.any():
        first = int(unseen.argmax())
        part = np.zeros(len(near), bool)
        part[first], frontier = True, np.array([first])
        while len(frontier):
            new = near[frontier].any(axis=0) & ~part
            part |= new
            frontier = np.flatnonzero(new)
        unseen &= ~part
        edges += [(first, int(i)) for i in np.flatnonzero(part) if i != first]
    return edges


def _each_cell(batches: Iterator[pd.DataFrame], columns: list[str], answer: Callable) -> Iterator[pd.DataFrame]:
    """Calls ``answer(words, own, table)`` for every run of rows of one cell; a run that a batch cuts is carried on."""
    carried = None
    for batch in batches:
        rows = batch if carried is None else pd.concat([carried, batch], ignore_index=True)
        ids = rows[["bucket", "low", "high", "table"]].to_numpy()
        if not len(ids):
            continue
        starts = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]).any(axis=1)])
        words, own = rows[columns].to_numpy(np.int64).view(np.uint64), rows["own"].to_numpy()
        found = [answer(words[a:b], own[a:b], int(ids[a, 3])) for a, b in zip(starts[:-1], starts[1:], strict=True) if b > a + 1]
        carried = rows.iloc[starts[-1] :]
        yield from (x for x in found if x is not None)
    if carried is not None and len(carried) > 1:
        last = answer(carried[columns].to_numpy(np.int64).view(np.uint64), carried["own"].to_numpy(), int(carried["table"].iloc[0]))
        if last is not None:
            yield last


def links(fingerprints: DataFrame, column: str, masks: Masks, radius: int) -> DataFrame:
    """(a, b): edges that connect exactly what pairs within the radius connect; at most one per member of a cell."""

    def forest(words: np.ndarray, own: np.ndarray, table: int) -> pd.DataFrame | None:
        edges = _forest(_close(words, own, radius))
        if not edges:
            return None
        values = words[:, 0].view(np.int64)
        a, b = np.array(edges).T
        return pd.DataFrame({"a": values[a], "b": values[b]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _gathered(_each_cell(batches, [column], forest))

    return cells(fingerprints, [column], masks).mapInPandas(run, "a long, b long").distinct()


class Blocks:
    """Compares fingerprints that agree on one block; a pair counts in the first block, and the first second block, that it agrees on."""

    def __init__(self, masks: Masks, radius: int, few: int = FEW):
        self.masks, self.radius, self.few = np.array(masks, np.int64).view(np.uint64), radius, few

    def _near(self, left: np.ndarray, right: np.ndarray, table: np.ndarray, second: int | None = None) -> np.ndarray:
        """Which of the pairs (rows of ``left`` and ``right``, in ``table``) are to be counted here."""
        diff = left ^ right
        near = np.flatnonzero(np.bitwise_count(diff).sum(axis=1, dtype=np.int64) <= self.radius)
        diff, at = diff[near], table[near]
        ok = np.ones(len(near), bool)
        for t, mask in enumerate(self.masks):
            agree = ~(diff & mask).any(axis=1)
            ok &= ~(agree & (t < at))
            if second is not None and t < second:
                ok &= ~(agree & (t != at))
        return near[ok]

    def small(self, words: np.ndarray, table: np.ndarray, bucket: np.ndarray, n: np.ndarray) -> None:
        """Adds to ``n`` the neighbours inside runs of equal ``bucket``, all runs at once: every row meets the one 1, 2, ... places on."""
        for step in range(1, len(bucket)):
            first = np.flatnonzero(bucket[:-step] == bucket[step:])
            if not len(first):
                break
            hit = first[self._near(words[first], words[first + step], table[first])]
            np.add.at(n, hit, 1)
            np.add.at(n, hit + step, 1)

    def large(self, words: np.ndarray, table: int) -> np.ndarray:
        """Neighbours of each member of one bucket, met by a second block where that leaves less to compare."""
        runs = []
        for t, mask in enumerate(self.masks):
            if t != table:
                order = np.lexsort((words & mask).T)
                own = (words & mask)[order]
                starts = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]).any(axis=1)])
                runs.append((t, order, starts, np.diff(np.r_[starts, len(order)])))
        if sum(int((sizes.astype(np.int64) ** 2).sum()) for *_, sizes in runs) >= len(words) ** 2:
            return self._all(words, table, None)
        n = np.zeros(len(words), np.int64)
        for t, order, starts, sizes in runs:
            for begin, size in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
                members = order[begin : begin + size]
                n[members] += self._all(words[members], table, t)
        return n

    def _all(self, words: np.ndarray, table: int, second: int | None) -> np.ndarray:
        n = np.zeros(len(words), np.int64)
        rows = max(1, CELL * CELL // max(1, len(words)) // 4)
        for a in range(0, len(words), rows):
            left = words[a : a + rows]
            x, y = np.nonzero(np.arange(a, a + len(left))[:, None] < np.arange(len(words))[None, :])
            hit = self._near(left[x], words[y], np.full(len(x), table), second)
            np.add.at(n, x[hit] + a, 1)
            np.add.at(n, y[hit], 1)
        return n

    def counts(self, words: np.ndarray, table: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Neighbours of each row inside its bucket; rows are sorted by bucket."""
        n, starts = np.zeros(len(bucket), np.int64), np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        sizes = np.diff(np.r_[starts, len(bucket)])
        some = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= self.few), sizes))
        if len(some):
            own = np.zeros(len(some), np.int64)
            self.small(words[some], table[some], bucket[some], own)
            n[some] = own
        for begin, size in zip(starts[sizes > self.few].tolist(), sizes[sizes > self.few].tolist(), strict=True):
            n[begin : begin + size] = self.large(words[begin : begin + size], int(table[begin]))
        return n


def neighbour_counts(fingerprints: DataFrame, columns: list[str], bits: int, radius: int, large: int = LARGE, few: int = FEW) -> DataFrame:
    """Each fingerprint that has any with the number of others within the radius; ``fingerprints`` are distinct.

    Of ``radius + 2`` blocks a pair within the radius leaves two untouched: it meets in the bucket of the one and, there, of the other.
    """
    masks = block_masks(bits, radius + 1)
    keyed = _keyed(fingerprints, columns, masks)
    over = cut_lineage(keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > large).select("bucket"))
    schema = ", ".join(f"{c} long" for c in columns) + ", n long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _gathered(_each_bucket(batches, columns, Blocks(masks, radius, few)))

    rows = keyed.join(over, "bucket", "left_anti").repartition("bucket").sortWithinPartitions("bucket")
    found = rows.mapInPandas(run, schema)
    if not over.isEmpty():
        found = found.unionByName(_by_second_block(keyed.join(over, "bucket", "left_semi"), columns, masks, radius, schema))
    return found.groupBy(*columns).agg(F.sum("n").alias("n_links"))


def _by_second_block(keyed: DataFrame, columns: list[str], masks: Masks, radius: int, schema: str) -> DataFrame:
    """Counts from buckets that no task should hold, cut by a second block first and into cells then."""
    of = np.array(masks, np.int64).view(np.uint64)
    width = len(masks)
    again = [
        F.struct(F.lit(t).alias("second"), F.xxhash64(F.lit("pair"), "bucket", F.lit(t), *[F.col(c).bitwiseAND(F.lit(m)) for c, m in zip(columns, mask, strict=True)]).alias("pair"))
        for t, mask in enumerate(masks)
    ]
    pairs = keyed.select(*columns, "table", F.explode(F.array(*again)).alias("x")).where("x.second <> table")
    pairs = pairs.select(*columns, (F.col("table") * width + F.col("x.second")).alias("table"), F.col("x.pair").alias("bucket"))

    def count(words: np.ndarray, own: np.ndarray, code: int) -> pd.DataFrame | None:
        near = _close(words, own, radius)
        table, second = divmod(code, width)
        for t in range(max(table, second)):
            if (t < table or t < second) and t != table and near.any():
                masked, same = words & of[t], np.ones_like(near)
                for w in masked.T:
                    same &= w[:, None] == w[None, :]
                near &= ~same
        n = near.sum(axis=1)
        return pd.DataFrame(words.view(np.int64)[n > 0], columns=columns).assign(n=n[n > 0]) if n.any() else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _gathered(_each_cell(batches, columns, count))

    return _cut(pairs, columns, CELL).mapInPandas(run, schema)


def _each_bucket(batches: Iterator[pd.DataFrame], columns: list[str], blocks: Blocks) -> Iterator[pd.DataFrame]:
    """Counts of whole buckets; one that a batch cuts is carried on."""
    carried = None
    for batch in batches:
        rows = batch if carried is None else pd.concat([carried, batch], ignore_index=True)
        if not len(rows):
            continue
        bucket = rows["bucket"].to_numpy()
        last = int(np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])[-1])
        carried = rows.iloc[last:]
        yield _counted(rows.iloc[:last], columns, blocks)
    if carried is not None:
        yield _counted(carried, columns, blocks)


def _counted(rows: pd.DataFrame, columns: list[str], blocks: Blocks) -> pd.DataFrame:
    words = rows[columns].to_numpy(np.int64)
    n = blocks.counts(words.view(np.uint64), rows["table"].to_numpy(np.int64), rows["bucket"].to_numpy())
    return pd.DataFrame(words[n > 0], columns=columns).assign(n=n[n > 0])


def _gathered(frames: Iterator[pd.DataFrame], rows: int = 20_000) -> Iterator[pd.DataFrame]:
    """Few larger frames in place of many small ones."""
    held, n = [], 0
    for frame in frames:
        held.append(frame)
        n += len(frame)
        if n >= rows:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)
