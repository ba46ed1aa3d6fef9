"""The visibility rule every reading operator applies before scoring, ordering, limiting or counting.

A row with ``abs_ep = n`` is visible only to a viewer whose position in that series is at least ``n``; a row without
``abs_ep`` is always visible. Series without a record count as watched up to ``unrecorded``.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# Fixed value: "the whole series was watched".
ALL_EPISODES = 1_000_000

Watched = Mapping[str, int] | DataFrame


def visible(chunks: DataFrame, *, watched: Watched, unrecorded: int = 0) -> DataFrame:
    """Rows of ``chunks`` (series_id, abs_ep, ...) this viewer may see. ``watched`` is mandatory.

    A frame that holds a series several times counts with the furthest position, NULL positions count as no record.
    """
    if watched is None:
        raise TypeError("watched (position per series) must be given")
    unrecorded = int(unrecorded)
    ep = F.col("abs_ep")
    if not isinstance(watched, DataFrame):
        # The bound follows from the exact condition and, unlike it, can be pushed into the parquet scan.
        chunks = chunks.filter(ep.isNull() | (ep <= F.lit(max([unrecorded, *map(int, watched.values())]))))
        if not watched:
            return chunks
    positions = _positions(chunks, watched)
    joined = chunks.join(positions, "series_id", "left").filter(ep.isNull() | (ep <= F.coalesce("_seen", F.lit(unrecorded))))
    return joined.select(*chunks.columns)


def _positions(rows: DataFrame, watched: Watched) -> DataFrame:
    """One row per series: series_id, _seen. A mapping becomes a local relation, whose size the planner knows."""
    if not isinstance(watched, DataFrame):
        table = pa.table({"series_id": pa.array(map(str, watched), pa.string()), "_seen": pa.array(map(int, watched.values()), pa.int32())})
        return rows.sparkSession.createDataFrame(table)
    return watched.groupBy("series_id").agg(F.max(F.col("seen_ep").cast("int")).alias("_seen"))


def narrowed(chunks: DataFrame, *, series_ids: Iterable[str] | None = None, types: Iterable[str] | None = None) -> DataFrame:
    """Optional narrowing where None means "no filter"; both predicates reach the scan."""
    if series_ids is not None:
        chunks = chunks.filter(F.col("series_id").isin([str(s) for s in series_ids]))
    if types is not None:
        chunks = chunks.filter(F.col("type").isin([str(t) for t in types]))
    return chunks


def read_range(
    chunks: DataFrame,
    series_id: str,
    *,
    seen_ep: int,
    types: Iterable[str],
    from_ep: int = 1,
    include_episode_free: bool = False,
    only_eps: Iterable[int] | None = None,
) -> DataFrame:
    """Chunks of one series between ``from_ep`` and ``seen_ep`` in episode order, episode-free rows first when asked for."""
    if seen_ep is None:
        raise TypeError("seen_ep (last episode watched) must be given")
    ep = F.col("abs_ep")
    wanted: Column = ep.between(int(from_ep), int(seen_ep))
    if include_episode_free:
        wanted = wanted | ep.isNull()
    rows = narrowed(chunks, series_ids=[series_id], types=types).filter(wanted)
    if only_eps is not None:
        rows = rows.filter(ep.isin([int(n) for n in only_eps]))
    return rows.orderBy(ep.asc_nulls_first(), "chunk_id")


def leaks(result: DataFrame, *, watched: Watched, unrecorded: int = 0) -> DataFrame:
    """Rows of a result the viewer may not see; must be empty. The complement of :func:`visible`, for assertions."""
    if watched is None:
        raise TypeError("watched (position per series) must be given")
    return (
        result.join(_positions(result, watched), "series_id", "left")
        .filter(F.col("abs_ep") > F.coalesce("_seen", F.lit(int(unrecorded))))
        .drop("_seen")
    )
