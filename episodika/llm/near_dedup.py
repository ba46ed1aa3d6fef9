"""Near duplicates by SimHash: 64-bit fingerprints of word shingles, linked when few bits differ.

Fingerprints within the radius are found by covering locality-sensitive hashing (``hamming.covering_masks``): no pair
is missed. Copies share one fingerprint and are one node; each cell of a bucket gives a spanning forest, and components
are found on those edges.

Defined cases: a null text is an empty text; a text without words has fingerprint zero and links like any other. A null
``doc_id`` takes part, and a component's id is its smallest id that is not null. Repeated rows are copies. Other columns are not
looked at. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from episodika.llm.common import whole
from episodika.llm.components import components
from episodika.llm.hamming import covering_masks, links
from episodika.session import cut_lineage

BITS, RADIUS, WORDS, SEED = 64, 3, 3, 42
#: shingles whose bits are laid out at once
CHUNK = 1 << 15


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """A bit is 1 if set in over half the hashes of the shingles, repeats included; signed 64 bits."""
    tokens = text.encode().lower().split()  # of bytes: A-Z and the six ASCII blanks only
    if not tokens:
        return 0
    joined, size = b" ".join(tokens), min(words, len(tokens))
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    starts = np.cumsum(lengths + 1) - lengths - 1
    begins, ends = starts[: len(tokens) - size + 1].tolist(), (starts + lengths)[size - 1 :].tolist()
    digest, votes = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(begins), CHUNK):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(begins[at : at + CHUNK], ends[at : at + CHUNK], strict=True)], "<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(begins)).view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, print (64 bits as a long)."""
    kind = dict(docs.dtypes)[id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = pa.array([fingerprint(t.as_py()) for t in batch["text"]], pa.int64())
            yield pa.record_batch([batch["doc_id"], prints], names=["doc_id", "print"])

    base = docs.select(F.col(id).alias("doc_id"), whole(text).alias("text"))
    return base.mapInArrow(run, f"doc_id {kind}, print long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, print, component_id: one row per row of ``docs``."""
    prints = cut_lineage(fingerprints(docs, text, id))
    nodes = prints.groupBy("print").agg(F.min("doc_id").alias("low"))
    edges = links(nodes.select("print"), "print", covering_masks(BITS, radius), radius)
    roots = cut_lineage(components(edges).withColumnRenamed("node", "print"))
    lows = nodes.join(roots, "print").groupBy("root").agg(F.min("low").alias("component_low"))
    linked = roots.join(lows, "root").select("print", "component_low")
    known = nodes.join(linked, "print", "left").select("print", F.coalesce("component_low", "low").alias("component_id"))
    known = cut_lineage(known)  # on its own the last join can split the prints that very many copies share
    return prints.join(known, "print").select("doc_id", "print", "component_id")
