"""Gated vector search: exact top-k, top-k per series, many queries at once, and a pruned cell index."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from episodika.config import DEFAULTS
from episodika.operators.gate import Watched, narrowed, visible
from episodika.session import cut_lineage


def cosine(vector: Column | str, query: Sequence[float]) -> Column:
    """Cosine similarity to a fixed query, in double precision, one matrix product per Arrow batch.

    NULL where undefined: a NULL or zero vector, or one of another length than the query.
    """
    q = np.asarray([float(x) for x in query], dtype=np.float64)
    norm = float(np.sqrt(q @ q))
    if norm == 0.0:
        return F.lit(None).cast("double")
    unit = q / norm
    return _batch_cosine(unit)(F.col(vector) if isinstance(vector, str) else vector)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of one length as rows; callers leave out the others with :func:`fitting`."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, dim).astype(np.float64)


def fitting(column: pa.Array, dim: int) -> pa.Array:
    """Which vectors have the query's length; others, like missing ones, have no score."""
    return pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)


def _batch_cosine(unit: np.ndarray):
    dim = len(unit)

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        fits = fitting(column, dim)
        known, out = fits.to_numpy(zero_copy_only=False), np.full(len(column), np.nan)
        if known.any():
            rows = _matrix(column.filter(fits), dim)
            length = np.sqrt((rows * rows).sum(axis=1))
            with np.errstate(divide="ignore", invalid="ignore"):
                out[known] = np.where(length > 0, rows @ unit / length, np.nan)
        return pa.array(out, mask=np.isnan(out))

    return score


def search(
    chunks: DataFrame,
    query: Sequence[float],
    *,
    watched: Watched,
    unrecorded: int = 0,
    series_id: str | None = None,
    types: Iterable[str] | None = DEFAULTS.chunk_types,
    k: int = DEFAULTS.top_k,
) -> DataFrame:
    """Exact gated top-k by cosine similarity; ``score`` is added, ties fall to the smaller chunk id."""
    return (
        _scored(chunks, query, watched, unrecorded, None if series_id is None else [series_id], types)
        .orderBy(F.col("score").desc(), F.col("chunk_id").asc())
        .limit(int(k))
    )


def _scored(chunks, query, watched, unrecorded, series_ids, types) -> DataFrame:
    rows = narrowed(chunks, series_ids=series_ids, types=types).filter(F.col("embedding").isNotNull())
    rows = visible(rows, watched=watched, unrecorded=unrecorded)
    return rows.withColumn("score", cosine("embedding", query)).filter(F.col("score").isNotNull()).drop("embedding")


def search_per_series(
    chunks: DataFrame,
    query: Sequence[float],
    *,
    watched: Watched,
    unrecorded: int = 0,
    series: DataFrame | None = None,
    types: Iterable[str] | None = DEFAULTS.chunk_types,
    k: int = 20,
) -> DataFrame:
    """Best ``k`` of every series, optionally of the series in a (small or large) frame only.

    The rank filter lets Spark cut each map task to ``k`` rows per series before the shuffle, so a series holding a third
    of all chunks costs no more than any other.
    """
    rows = _scored(chunks, query, watched, unrecorded, None, types)
    if series is not None:
        rows = rows.join(series.select("series_id").distinct(), "series_id", "left_semi")
    rank = F.row_number().over(W.partitionBy("series_id").orderBy(F.col("score").desc(), F.col("chunk_id").asc()))
    return rows.withColumn("rank_in_series", rank).filter(F.col("rank_in_series") <= int(k))


def question_blocks(questions: DataFrame, columns: Sequence[str], block: int) -> Iterator[list[tuple]]:
    """Rows of a table of questions in lists of at most ``block``; the driver holds one list at a time."""
    held: list[tuple] = []
    for row in questions.select(*columns).toLocalIterator():
        held.append(tuple(row))
        if len(held) == block:
            yield held
            held = []
    if held:
        yield held


def search_many(
    chunks: DataFrame,
    queries: DataFrame | Sequence[tuple[str, Sequence[float]]],
    *,
    watched: Watched,
    unrecorded: int = 0,
    types: Iterable[str] | None = DEFAULTS.chunk_types,
    k: int = DEFAULTS.top_k,
    block: int = 1_024,
) -> DataFrame:
    """Top-k of many queries - a table (query_id, vector) of any size, or a list - in one pass over the vectors for each block of them.

    Queries travel in blocks of bounded size, and each block's result is written before the next one is asked; each Arrow batch is scored against a block with one matrix product. A task keeps the best
    ``k`` rows per query over all its batches (and ties with the last), so what is shuffled is tasks times queries times k.
    """
    rows = narrowed(chunks, types=types).filter(F.col("embedding").isNotNull())
    rows = visible(rows, watched=watched, unrecorded=unrecorded).select("chunk_id", "series_id", "abs_ep", "embedding")
    schema = "query_id string, chunk_id string, series_id string, abs_ep int, score double"
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("chunk_id").asc()))
    if isinstance(queries, DataFrame):
        blocks = question_blocks(queries, ["query_id", "vector"], block)
    else:
        blocks = (list(queries[start : start + block]) for start in range(0, len(queries), block))
    parts = []
    for own in blocks:
        matrix = np.asarray([[float(x) for x in v] for _, v in own], dtype=np.float64)
        matrix /= np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
        best = rows.mapInArrow(_local_top_k([str(n) for n, _ in own], matrix, int(k)), schema)
        best = best.withColumn("rank", rank).filter(F.col("rank") <= int(k))
        # a full block is followed by others, whose vectors should not all wait in one plan
        parts.append(cut_lineage(best) if len(own) == block else best)
    if not parts:
        return chunks.sparkSession.createDataFrame([], schema + ", rank int")
    return functools.reduce(DataFrame.unionByName, parts)


def _local_top_k(names: list[str], matrix: np.ndarray, k: int):
    dim, columns = matrix.shape[1], ["chunk_id", "series_id", "abs_ep"]
    kinds = [pa.string(), pa.string(), pa.int32()]

    def best(scores: np.ndarray) -> np.ndarray:
        """Places of the k best, with every one tied with the k-th: the final ranking breaks the tie by id."""
        if len(scores) <= k:
            return np.arange(len(scores))
        return np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, pa.Table]] = [(np.zeros(0), pa.table([pa.array([], t) for t in kinds], columns))] * len(names)
        for batch in batches:
            batch = batch.filter(fitting(batch.column("embedding"), dim))
            if batch.num_rows == 0:
                continue
            vectors = _matrix(batch.column("embedding"), dim)
            length = np.sqrt((vectors * vectors).sum(axis=1))
            defined = length > 0
            rows = pa.table([batch.column(c).cast(t) for c, t in zip(columns, kinds, strict=True)], columns).filter(pa.array(defined))
            similarities = matrix @ (vectors[defined] / length[defined, None]).T
            for q, scores in enumerate(similarities):
                old, kept = held[q]
                chosen = best(scores)
                if len(old) >= k:  # only rows that reach the worst one held can matter
                    chosen = chosen[scores[chosen] >= old.min()]
                if len(chosen):
                    both = np.concatenate([old, scores[chosen]])
                    keep = best(both)
                    held[q] = both[keep], pa.concat_tables([kept, rows.take(pa.array(chosen))]).take(pa.array(keep)).combine_chunks()
        for name, (scores, rows) in zip(names, held, strict=True):
            if len(scores):
                for part in rows.append_column("score", pa.array(scores)).add_column(0, "query_id", pa.array([name] * len(scores), pa.string())).to_batches():
                    yield part

    return run


# ---------------------------------------------------------------- pruned search over cells


def build_cells(chunks: DataFrame, centres: Sequence[Sequence[float]]) -> DataFrame:
    """Adds ``cell`` (nearest centre) and ``cell_angle`` (angle to it). Written ``partitionBy("cell")`` a search reads few cells."""
    unit = np.asarray([[float(x) for x in c] for c in centres], dtype=np.float64)
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    dim = unit.shape[1]

    @F.arrow_udf("struct<cell:int,cell_angle:double>")
    def nearest(column: pa.Array) -> pa.Array:
        vectors = _matrix(column, dim)
        length = np.sqrt((vectors * vectors).sum(axis=1))
        sims = (vectors / np.where(length > 0, length, 1.0)[:, None]) @ unit.T
        cell = sims.argmax(axis=1)
        angle = np.arccos(np.clip(sims[np.arange(len(cell)), cell], -1.0, 1.0))
        return pa.StructArray.from_arrays(
            [pa.array(cell.astype(np.int32)), pa.array(angle)], names=["cell", "cell_angle"]
        )

    placed = chunks.filter(F.size("embedding") == dim).withColumn("_cell", nearest("embedding"))
    return placed.select(*chunks.columns, "_cell.cell", "_cell.cell_angle")


def cell_radii(cells: DataFrame) -> dict[int, tuple[float, int]]:
    """Largest angle and row count per cell: one row per centre, a size fixed when the index is built."""
    stats = cells.groupBy("cell").agg(F.max("cell_angle").alias("r"), F.count("*").alias("n"))
    return {row["cell"]: (float(row["r"]), int(row["n"])) for row in stats.collect()}


def search_cells(
    cells: DataFrame,
    centres: Sequence[Sequence[float]],
    radii: dict[int, tuple[float, int]],
    query: Sequence[float],
    *,
    watched: Watched,
    unrecorded: int = 0,
    types: Iterable[str] | None = DEFAULTS.chunk_types,
    k: int = DEFAULTS.top_k,
    probe: int = 4,
) -> DataFrame:
    """Top-k through the cell index, equal to the exact search.

    Angles obey the triangle inequality, so no vector of a cell is closer than ``angle(query, centre) - radius``. The
    nearest ``probe`` cells give a k-th best angle under the gate; every cell that could still beat it is then read too.
    When the gate leaves fewer than ``k`` rows in the probed cells all cells are read, so filters never cost results.
    """
    q = np.asarray([float(x) for x in query], dtype=np.float64)
    q /= math.sqrt(float(q @ q))
    unit = np.asarray([[float(x) for x in c] for c in centres], dtype=np.float64)
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    angles = np.arccos(np.clip(unit @ q, -1.0, 1.0))
    bounds = sorted((float(angles[c]) - radii[c][0], c) for c in radii)
    first = [c for _, c in bounds[: int(probe)]]

    def within(ids: list[int]) -> DataFrame:
        return search(
            cells.filter(F.col("cell").isin(ids)), query, watched=watched, unrecorded=unrecorded, types=types, k=k
        )

    found = within(first).agg(F.count("*").alias("n"), F.min("score").alias("worst")).first()
    if found["n"] < int(k):
        wanted = [c for _, c in bounds]
    else:
        reach = math.acos(max(-1.0, min(1.0, found["worst"]))) + 1e-9
        wanted = [c for bound, c in bounds if bound <= reach]
    return within(sorted(set(wanted) | set(first))).drop("cell", "cell_angle")
