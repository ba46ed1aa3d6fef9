"""Document fingerprints by SimHash over weighted terms, compared with an edited text and the next document's.

Terms are words and pairs of neighbouring words, A-Z lower-cased; a term that occurs c times weighs 1 + ln c, a single word
half of that. Each term's hash votes on ``BITS`` signed bits. The likeness of two fingerprints is the share of equal bits.

The next document by descending id is the next row of a range-partitioned, sorted stream; texts move once. A task
holds one row back until its successor comes; the first and last rows of the tasks, two for each task, are written out and
meet in a join.

``near_links`` finds all fingerprints within a radius by permuted block tables, keyed by pairs of blocks (``hamming.neighbour_counts``).

Defined cases: a null text is an empty text, whose fingerprint is all zeros. Rows that repeat an id follow each other by
descending text. Null ids come last. Equal texts have equal fingerprints. Other columns are not looked at. Empty table: empty
result; a single document is its own next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from episodika.llm.common import as_text, from_text, whole
from episodika.llm.hamming import neighbour_counts
from episodika.session import cut_lineage

#: the radius is the same share of the bits as near_dedup's 3 of 64; README has what it finds
BITS, RADIUS = 256, 12
#: terms whose bits are laid out at once
CHUNK = 1 << 14
_SPREAD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str) -> np.ndarray:
    """BITS / 64 words of 64 bits."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(BITS // 64, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    single = np.fromiter(map(digest, words), np.uint64, len(words))
    double = _mixed(single[:-1] * np.uint64(0x9E3779B97F4A7C15) + single[1:])
    votes, total = np.zeros(BITS, np.float64), 0.0
    for hashes, weight in ((single, 0.5), (double, 1.0)):
        terms, counts = np.unique(hashes, return_counts=True)
        weights = (weight * (1 + np.log(counts))).astype(np.float32)
        for at in range(0, len(terms), CHUNK):
            spread = _mixed(terms[at : at + CHUNK, None] + _SPREAD)
            bits = np.unpackbits(spread.view(np.uint8).reshape(len(spread), -1), axis=1)
            votes += weights[at : at + CHUNK] @ bits.astype(np.float32)
        total += float(weights.sum(dtype=np.float64))
    return np.packbits(votes * 2 > total).view(np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return 1 - int(np.bitwise_count(a ^ b).sum()) / BITS


def _hex(words: np.ndarray) -> str:
    return words.astype(">u8").tobytes().hex()


def edited_text(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many of the next text, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_WORDS = [f"f{i}" for i in range(BITS // 64)]


def _compared(text: str, mark: np.ndarray, following: str, following_mark: np.ndarray) -> tuple:
    edited = edited_text(text, following)
    edited_mark = fingerprint(edited) if edited != text else mark
    return (
        len(text), hashlib.sha256(edited.encode()).hexdigest(), _hex(mark), _hex(edited_mark), likeness(mark, edited_mark),
        likeness(mark, following_mark), *mark.view(np.int64).tolist(),
    )


def compare_documents(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and the words f0, f1, ..."""
    base = docs.select(F.col(id).alias("doc_id"), whole(text).alias("text"))
    kind = dict(base.dtypes)["doc_id"]
    words = ", ".join(f"{w} long" for w in _WORDS)
    result = f"doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, {words}"
    columns = ["doc_id", *_OUT, *_WORDS]

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, held, edge = TaskContext.get().partitionId(), None, []
        for batch in batches:
            done = []
            for key, content in zip(batch["doc_id"], batch["text"], strict=True):
                mark = fingerprint(content)
                if held is None:
                    edge.append((key, content, "first"))
                else:
                    done.append((held[0], *_compared(held[1], held[2], content, mark)))
                held = (key, content, mark)
            if done:
                yield pd.DataFrame(done, columns=columns, dtype="object").assign(text=None, edge=None, task=None)
        if held is not None:
            edge.append((held[0], held[1], "last"))
            none = [None] * (len(columns) - 1)
            yield pd.DataFrame([(k, *none, t, e, task) for k, t, e in edge], columns=[*columns, "text", "edge", "task"], dtype="object")

    def across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(
                [(k, *_compared(a, fingerprint(a), b, fingerprint(b))) for k, a, b in zip(batch["doc_id"], batch["text"], batch["following"], strict=True)], columns=columns
            )

    order = F.desc_nulls_last("doc_id")
    ranged = base.repartitionByRange(order).sortWithinPartitions(order, F.desc("text")).select(as_text("doc_id"), "text")
    rows = cut_lineage(ranged.mapInPandas(stream, f"{result}, text string, edge string, task int"))
    firsts = rows.where("edge = 'first'").select(F.col("task").alias("at"), F.col("text").alias("following"))
    # tasks that had rows, each with the one after it; the last is followed by the first
    tasks = firsts.select("at").withColumn("next", F.lead("at").over(Window.orderBy("at")))
    tasks = tasks.withColumn("next", F.coalesce("next", F.min("at").over(Window.partitionBy())))
    edges = rows.where("edge = 'last'").select("doc_id", "text", "task").join(tasks, F.col("task") == F.col("at")).drop("at")
    edges = edges.join(firsts, F.col("next") == F.col("at")).select("doc_id", "text", "following")
    return from_text(rows.where("edge is null").select(*columns).unionByName(edges.mapInPandas(across, result)), kind)


def near_links(compared: DataFrame, radius: int = RADIUS) -> DataFrame:
    """f0, f1, ..., class_id (smallest id with this fingerprint), n_links (other fingerprints within the radius)."""
    classes = compared.groupBy(*_WORDS).agg(F.min("doc_id").alias("class_id"))
    counts = neighbour_counts(classes.select(*_WORDS), _WORDS, BITS, radius)
    return classes.join(counts, _WORDS, "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))


def document_fingerprints(docs: DataFrame, radius: int = RADIUS, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, class_id, n_links."""
    compared = cut_lineage(compare_documents(docs, text, id))
    linked = cut_lineage(near_links(compared, radius))  # on its own the join can split fingerprints that very many copies share
    return compared.join(linked, _WORDS).select("doc_id", *_OUT, "class_id", "n_links")
