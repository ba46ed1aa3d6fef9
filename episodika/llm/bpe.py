"""Byte-level BPE encoding and decoding of whole texts, long ones in parallel.

A long text is halved until its leaves are short; leaves of all texts are dealt over the tasks and encoded on their own. Then the
halves are joined pair by pair, up to the whole: around each join a window of tokens from both sides is encoded
anew and grows until its outer quarters are exactly the tokens that the two sides have there. Tokens beyond the window
then stand next to the same neighbours as before, and a sequence of byte pairs merged by rank is right when every two neighbours are right
together. A window that reaches both ends is an encoding of the whole, so the search always ends.

Inside a leaf words met before are not encoded again. A leaf with unusual characters is first cut before each blank that a
visible character follows: the tokenizer cuts there whatever surrounds the place.

Defined cases: a null text is an empty text, with no tokens. Rows that repeat an id are told apart by the digest of their
text; rows that repeat both come once per row. Columns other than id and text are not looked at. Empty table: empty result.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from episodika.llm.common import as_text, from_text, whole
from episodika.llm.tokens import LETTERS, Encoder, byte_stand_ins, gather, load, vocabulary_path

#: longest text, in code points, that one call encodes; longer ones are halved
LEAF = 1 << 14
#: first window around a join, in tokens of each side; longer than any special token
WINDOW = 16

#: fixed value: the vocabulary's pattern of words
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+"
_CUT = re.compile(r"(?= \S)")


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path, WORD, _CUT.split, lower=False)


@functools.lru_cache(maxsize=2)
def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all tokens end to end, where each starts, how long it is."""
    stands = {c: b for b, c in enumerate(byte_stand_ins())}
    vocabulary = load(path).get_vocab(with_added_tokens=True)
    table = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        table[i] = bytes(stands[c] for c in token)
    lengths = np.fromiter(map(len, table), np.int64, len(table))
    return np.frombuffer(b"".join(table), np.uint8), np.cumsum(lengths) - lengths, lengths


def decode(ids: np.ndarray, path: str) -> bytes:
    """UTF-8 of the ids' text; bytes that are no UTF-8 become replacement marks."""
    flat, starts, lengths = _token_bytes(path)
    raw = gather(flat, starts[ids], lengths[ids]).tobytes()
    return raw.decode("utf-8", "replace").encode()


def encode(text: str, path: str) -> np.ndarray:
    return _encoder(path).encode(text)


def join(left: np.ndarray, right: np.ndarray, path: str, window: int = WINDOW) -> np.ndarray:
    """Ids of the text that ``left`` and ``right`` encode the two halves of."""
    flat, starts, lengths = _token_bytes(path)
    inner = lambda i: (flat[starts[i]] & 0xC0) == 0x80 if lengths[i] else False  # noqa: E731 - begins inside a character
    while len(left) and len(right):
        a, b = max(0, len(left) - window), min(len(right), window)
        # windows begin and end between characters, and not at an apostrophe, which could begin another word form
        while a and (inner(left[a]) or flat[starts[left[a]]] == 0x27):
            a -= 1
        while b < len(right) and inner(right[b]):
            b += 1
        middle = np.concatenate([left[a:], right[:b]])
        again = encode(gather(flat, starts[middle], lengths[middle]).tobytes().decode(), path)
        head, tail = min(len(left) - a, window // 4), min(b, window // 4)
        same_head = a == 0 or np.array_equal(again[:head], left[a : a + head])
        same_tail = b == len(right) or np.array_equal(again[len(again) - tail :], right[b - tail : b])
        if same_head and same_tail and (len(again) >= head + tail or (a == 0 and b == len(right))):
            return np.concatenate([left[:a], again, right[b:]])
        window *= 2
    return np.concatenate([left, right])


def join_tree(leaves: list[np.ndarray], path: str) -> np.ndarray:
    while len(leaves) > 1:
        leaves = [join(*pair, path) if len(pair) == 2 else pair[0] for pair in (leaves[i : i + 2] for i in range(0, len(leaves), 2))]
    return leaves[0]


def halves(text: str, leaf: int) -> list[str]:
    """Equal parts, a power of two of them, of at most ``leaf`` characters."""
    n = 1
    while -(-len(text) // n) > leaf:
        n *= 2
    size = max(1, -(-len(text) // n))
    return [text[i : i + size] for i in range(0, len(text), size)] or [""]


def _digests(ids: np.ndarray, path: str) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decode(ids, path)).hexdigest()


def _packed(ids: np.ndarray) -> bytes:
    return ids.astype("<u4").tobytes()


def encode_documents(
    docs: DataFrame, path: str | None = None, leaf: int = LEAF, ids: bool = True, text: str = "text", id: str = "doc_id"
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ``ids`` (little-endian unsigned 32-bit integers)."""
    path = path or vocabulary_path("byte_bpe_50k.json")
    kind = dict(docs.dtypes)[id]
    base = docs.select(as_text(id), whole(text).alias("text"))
    result = "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * ids

    def rows(keys: list, encoded: list[np.ndarray]) -> pd.DataFrame:
        out = pd.DataFrame([(k, *_digests(e, path)) for k, e in zip(keys, encoded, strict=True)], columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        out["doc_id"] = pd.Series(keys, dtype="object")
        if ids:
            out["ids"] = [_packed(e) for e in encoded]
        return out

    def whole_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield rows(batch["doc_id"].tolist(), [encode(t, path) for t in batch["text"]])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, content, copies in zip(batch["doc_id"], batch["text"], batch["copies"], strict=True):
                leaves, digest = halves(content, leaf), hashlib.sha256(content.encode()).hexdigest()[:32]
                for at in range(0, len(leaves), 64):
                    some = leaves[at : at + 64]
                    yield pd.DataFrame({"doc_id": pd.Series([key] * len(some), dtype="object"), "copies": copies, "row": digest, "nth": range(at, at + len(some)), "leaf": some})

    def encode_leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(ids=[_packed(encode(t, path)) for t in batch["leaf"]])[["doc_id", "copies", "row", "nth", "ids"]]

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        leaves = [np.frombuffer(x, "<u4") for x in group.sort_values("nth")["ids"]]
        return rows(group["doc_id"].tolist()[:1], [join_tree(leaves, path)]).assign(copies=group["copies"].iloc[0])

    long = F.length("text") > leaf
    short_rows = base.where(~long).mapInPandas(whole_texts, result)
    # a long text that many rows repeat under one id is encoded once: copies are counted here and come back at the end
    copies = base.where(long).groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("copies"))
    leaves = copies.mapInPandas(cut, "doc_id string, copies long, row string, nth long, leaf string")
    leaves = leaves.repartition("row", "nth").mapInPandas(encode_leaves, "doc_id string, copies long, row string, nth long, ids binary")
    whole_rows = leaves.groupBy("doc_id", "row", "copies").applyInPandas(joined, f"{result}, copies long")
    again = whole_rows.withColumn("copies", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies")
    return from_text(short_rows.unionByName(again), kind)
