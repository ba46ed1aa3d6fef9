"""Words that are spellings of one another: one code point inserted, deleted or replaced, found on sorted permuterm rotations.

1. Words are counted over all documents: a task counts in a dictionary of bounded size, Spark adds the counts up.
2. Every word, its end marked, is rotated to every place. The rotation that begins after an edited code point ends with it, so
   what stands before that end - the prefix - is the word without it. Each rotation is laid down twice: as prefix and edited code
   point (a replacement, or a deletion from the longer word), and whole (the shorter word, at the place of the insertion).
3. Rotations are range-partitioned and sorted. The words of one prefix stand together: at most one whole word, and one word for
   each code point of the alphabet, so a group is small however common its words are. A scan emits for each word of a
   group how many neighbours it has there and the best of them, never the pairs.
4. The best neighbours make a forest of forms; roots are found by doubling the steps.

A pair that differs by one of several equal code points in a row (``aab``, ``ab``) meets once: only the first of them is edited.

Defined cases: a null text has no words, a null ``doc_id`` is written as nothing before the colon. Repeated rows count once for each
row. Ties between forms go to the smallest in code-point order. Other columns are not looked at. Empty table: empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from episodika.llm.common import whole
from episodika.session import cut_lineage

# --- fixed values ---------------------------------------------------------------------------------------------------
LETTERS = r"A-Za-zÀ-ÿ"
MIN_CHARS, MIN_COUNT, RATIO, EDIT_EVERY = 7, 2, 10, 31
# --- end of fixed values --------------------------------------------------------------------------------------------

#: end of a word in a rotation; no letter
END = "\0"
#: distinct words a task counts before it hands them on
HELD = 200_000


def word_counts(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, edit_every: int | None = EDIT_EVERY, text: str = "text", id: str = "doc_id"
) -> DataFrame:
    """word, n: runs of letters, A-Z lower-cased, of at least ``min_chars`` code points and ``min_count`` occurrences.

    A run whose hash with its document's id is divisible by ``edit_every`` loses one code point before it is counted.
    """
    # shorter runs give no word, with or without the edit
    runs = re.compile(f"[{LETTERS}]{{{min_chars},}}").findall
    base = docs.select(F.col(id).cast("string").alias("doc"), whole(text).alias("text"))
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], schema=schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc, content in zip(batch["doc"].to_pylist(), batch["text"], strict=True):
                own = Counter(runs(content.as_py().encode().lower().decode()))  # of bytes: A-Z only
                if edit_every:
                    head = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                    for run in list(own):
                        h = zlib.crc32(run.encode(), head)
                        if h % edit_every == 0:
                            at, n = h % len(run), own.pop(run)
                            held[run[:at] + run[at + 1 :]] += n
                held.update(own)
                if len(held) > HELD:
                    yield rows(held)
                    held = Counter()
        if held:
            yield rows(held)

    counted = base.mapInArrow(count, "word string, n long").where(F.length("word") >= min_chars)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def rotations(words: DataFrame) -> DataFrame:
    """prefix, edited (a code point, 0: the rotation is the whole word), first (of equal code points in a row), n."""
    at, word = F.col("at"), F.col("word")
    part = lambda start, length=None: F.substr(word, start, F.lit(1 << 30) if length is None else length)
    placed = words.withColumn("at", F.explode(F.sequence(F.lit(0), F.length("word"))))
    entire = F.struct(F.concat(part(at + 1), F.lit(END), part(F.lit(1), at)).alias("prefix"), F.lit(0).alias("edited"), F.lit(True).alias("first"))
    skipped = F.struct(
        F.concat(part(at + 2), F.lit(END), part(F.lit(1), at)).alias("prefix"), F.ascii(part(at + 1, F.lit(1))).alias("edited"),
        ((at == 0) | (part(at, F.lit(1)) != part(at + 1, F.lit(1)))).alias("first"),
    )
    # past the last code point nothing is edited
    both = F.when(at < F.length("word"), F.array(entire, skipped)).otherwise(F.array(entire))
    return placed.select(F.explode(both).alias("r"), "n").select("r.prefix", "r.edited", "r.first", "n")


def _word(prefix: str, edited: int) -> str:
    after, _, before = prefix.partition(END)
    return before + (chr(edited) if edited else "") + after


def _scan(prefix: pa.Array, edited: np.ndarray, first: np.ndarray, n: np.ndarray, group: np.ndarray) -> pa.RecordBatch | None:
    """For rows of whole groups, each of at least two: word, neighbours in its group, the best of them."""
    names = [_word(p, e) for p, e in zip(prefix.to_pylist(), edited.tolist(), strict=True)]
    size = len(names)
    number, best = np.zeros(size, np.int64), np.full(size, -1, np.int64)
    # words with an edited code point, the commonest first, equals by code point, which is the order of the words themselves
    skipped = np.flatnonzero(edited > 0)
    skipped = skipped[np.lexsort((edited[skipped], -n[skipped], group[skipped]))]
    starts = np.flatnonzero(np.r_[True, group[skipped][1:] != group[skipped][:-1]]) if len(skipped) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(skipped)])
    number[skipped] = np.repeat(sizes, sizes) - 1
    several = np.repeat(sizes, sizes) > 1
    best[skipped[several]] = np.repeat(skipped[starts], sizes)[several]
    top = starts[sizes > 1]
    best[skipped[top]] = skipped[top + 1]
    # the whole word of a group meets those whose edited code point is the first of its kind in a row
    owner = np.full(int(group[-1]) + 1, -1, np.int64)
    entire = np.flatnonzero(edited == 0)
    owner[group[entire]] = entire
    meeting = skipped[first[skipped] & (owner[group[skipped]] >= 0)]
    if len(meeting):
        mine = owner[group[meeting]]
        begins = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
        number[mine[begins]] = np.diff(np.r_[begins, len(mine)])
        best[mine[begins]] = meeting[begins]
        number[meeting] += 1
        for i, w in zip(meeting.tolist(), mine.tolist(), strict=True):
            b = best[i]
            if b < 0 or n[w] > n[b] or (n[w] == n[b] and names[w] < names[b]):
                best[i] = w
    found = np.flatnonzero(number)
    if not len(found):
        return None
    at = best[found]
    return pa.record_batch(
        [pa.array([names[i] for i in found.tolist()]), pa.array(number[found]), pa.array(-n[at]), pa.array([names[i] for i in at.tolist()])],
        names=["word", "n_near", "less", "near"],
    )


def neighbours(words: DataFrame) -> DataFrame:
    """word, n_near, near (the commonest neighbour), near_n: words that have neighbours."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if carried is None else pa.concat_tables([carried, pa.Table.from_batches([batch])])
            if not rows.num_rows:
                continue
            rows = rows.combine_chunks()
            prefix = rows["prefix"].chunk(0)
            starts = np.flatnonzero(np.r_[True, pc.not_equal(prefix.slice(1), prefix.slice(0, len(prefix) - 1)).to_numpy(zero_copy_only=False)])
            carried = rows.slice(int(starts[-1]))  # the last group may go on in the next batch
            out = groups(rows, starts)
            if out is not None:
                yield out
        if carried is not None:
            out = groups(carried, np.array([0, carried.num_rows]))
            if out is not None:
                yield out

    def groups(rows: pa.Table, bounds: np.ndarray) -> pa.RecordBatch | None:
        sizes = np.diff(bounds)
        group = np.repeat(np.arange(len(sizes)), sizes)
        crowded = np.flatnonzero(np.repeat(sizes > 1, sizes))
        if not len(crowded):
            return None
        some = rows.take(pa.array(crowded)).combine_chunks()
        column = lambda name: some[name].chunk(0).to_numpy(zero_copy_only=False)
        return _scan(some["prefix"].chunk(0), column("edited"), column("first"), column("n"), group[crowded])

    ordered = rotations(words).repartitionByRange("prefix").sortWithinPartitions("prefix", "edited")
    found = ordered.mapInArrow(scan, "word string, n_near long, less long, near string")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "near")).alias("best"))
    return best.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))


def roots(forms: DataFrame, longest: int) -> DataFrame:
    """word, root from (word, form): the end of each word's chain of at most ``longest`` forms, the steps doubled in each round."""
    reached = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(1, math.ceil(math.log2(max(2, longest))))):
        further = reached.select(F.col("word").alias("at"), F.col("root").alias("further"))
        reached = reached.join(further, F.col("root") == F.col("at"), "left").select("word", F.coalesce("further", "root").alias("root"))
        reached = cut_lineage(reached)
    return reached


def spelling_variants(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = RATIO, edit_every: int | None = EDIT_EVERY, text: str = "text", id: str = "doc_id"
) -> DataFrame:
    """word, form, root, n, n_near, form_n: ``form`` is the commonest neighbour if it is ``ratio`` times as common."""
    if ratio <= 1:
        raise ValueError("forms must be commoner than their words")
    words = cut_lineage(word_counts(docs, min_chars, min_count, edit_every, text, id))
    near = neighbours(words).withColumnRenamed("word", "w")
    has = F.col("near_n") >= ratio * F.col("n")
    formed = words.join(near, F.col("word") == F.col("w"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("near")).alias("form"), F.when(has, F.col("near_n")).alias("form_n")
    )
    formed = cut_lineage(formed)
    most = formed.agg(F.max("n")).first()[0] or 1
    # every form is ``ratio`` times as common as the word before it
    ends = roots(formed.where("form is not null"), 1 + int(math.log(most, ratio))).withColumnRenamed("word", "w")
    return formed.join(ends, F.col("word") == F.col("w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
