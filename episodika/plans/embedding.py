"""Turning texts into unit vectors with an injected model, only where a vector is missing."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from episodika.config import DEFAULTS, Settings
from episodika.functions import text as t

Encoder = Callable[[list[str]], np.ndarray]


def batches_of(texts: Sequence[str], size: int, max_chars: int) -> Iterator[list[int]]:
    """Index batches over texts sorted by length; the longest text of a batch limits how many go together."""
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    start = 0
    while start < len(order):
        stop = start + 1
        while stop < len(order) and stop - start < max(1, min(size, max_chars // max(len(texts[order[stop]]), 1))):
            stop += 1
        yield order[start:stop]
        start = stop


def unit(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return (rows / np.where(length > 0, length, 1.0)).astype(np.float32)


def encode_texts(encoder: Encoder, texts: Sequence[str], prefix: str, settings: Settings = DEFAULTS) -> np.ndarray:
    out: np.ndarray | None = None
    for index in batches_of(texts, settings.batch_size, settings.max_batch_chars):
        part = unit(np.asarray(encoder([prefix + texts[i] for i in index])))
        if out is None:
            out = np.zeros((len(texts), part.shape[1]), dtype=np.float32)
        out[index] = part
    return out if out is not None else np.zeros((0, settings.embedding_dim), dtype=np.float32)


def missing_vectors(chunks: DataFrame, types: Iterable[str] | None = None) -> DataFrame:
    rows = chunks.filter(F.col("embedding").isNull())
    return rows if types is None else rows.filter(F.col("type").isin(list(types)))


def embed(chunks: DataFrame, make_encoder: Callable[[], Encoder], types: Iterable[str] | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """(chunk_id, embedding) for the chunks without a vector. The model is loaded once per Python worker.

    Rows are spread by id, so long texts do not gather, and sorted by length within a partition to batch alike texts.
    """
    todo = missing_vectors(chunks, types).select("chunk_id", "text")
    todo = todo.repartition("chunk_id").sortWithinPartitions(F.length("text"))
    schema = T.StructType([T.StructField("chunk_id", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in rows:
            if batch.num_rows == 0:
                continue
            encoder = encoder or make_encoder()
            vecs = encode_texts(encoder, batch.column("text").to_pylist(), settings.passage_prefix, settings)
            yield pa.RecordBatch.from_arrays(
                [batch.column("chunk_id").cast(pa.string()), pa.array(list(vecs), pa.list_(pa.float32()))], names=["chunk_id", "embedding"]
            )

    return todo.mapInArrow(run, schema)


def with_new_vectors(chunks: DataFrame, fresh: DataFrame) -> DataFrame:
    """Chunks with the fresh vectors filled in."""
    joined = chunks.join(fresh.withColumnRenamed("embedding", "_fresh"), "chunk_id", "left")
    return joined.withColumn("embedding", F.coalesce("embedding", "_fresh")).drop("_fresh").select(*chunks.columns)


def check_dimension(chunks: DataFrame, dim: int) -> DataFrame:
    """Rows whose vector has another length than the model's; must be empty."""
    return chunks.filter(F.col("embedding").isNotNull() & (F.size("embedding") != int(dim)))


def semantic_pieces(df: DataFrame, text: str, make_encoder: Callable[[], Encoder], min_chars: int = 200) -> DataFrame:
    """Cuts each text into as many pieces as its paragraphs give, where neighbouring sentences differ most.

    Cuts are tried from the largest drop on; one that would leave a piece shorter than ``min_chars`` is skipped.
    """
    prepared = df.withColumn("_s", t.sentences(text)).withColumn("_n", F.size(t.paragraphs(text)))
    schema = T.StructType([*df.schema.fields, T.StructField("pieces", T.ArrayType(T.StringType()))])
    carried, names = list(df.columns), list(schema.names)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in rows:
            if batch.num_rows == 0:
                continue
            encoder = encoder or make_encoder()
            pieces = [_cut(s or [], n, encoder, min_chars) for s, n in zip(batch.column("_s").to_pylist(), batch.column("_n").to_pylist())]
            columns = [batch.column(name) for name in carried]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(pieces, pa.list_(pa.string()))], names=names)

    return prepared.mapInArrow(run, schema)


def _cut(sentences: list[str], n: int, encoder: Encoder, min_chars: int) -> list[str]:
    if n <= 1 or len(sentences) <= 1:
        return [" ".join(sentences)]
    vecs = unit(np.asarray(encoder(sentences))).astype(np.float64)
    drop = 1 - (vecs[:-1] * vecs[1:]).sum(axis=1)
    ends = np.cumsum([len(s) + 1 for s in sentences])
    cuts: list[int] = []
    for i in np.argsort(-drop, kind="stable"):
        tried = sorted([*cuts, int(i)])
        edges = np.concatenate([[0], ends[tried], [ends[-1]]])
        if np.diff(edges).min() >= min_chars:
            cuts = tried
        if len(cuts) == n - 1:
            break
    edges = [0, *[c + 1 for c in cuts], len(sentences)]
    return [" ".join(sentences[a:b]) for a, b in zip(edges, edges[1:])]
