"""Building series and entries from a catalogue and a cross-catalogue id map, and the rollups that follow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from episodika.functions.text import source_id
from episodika.operators.align import order_entries

# Hosts of the two id systems.
HOST_A, HOST_B = "anilist.co", "myanimelist.net"
UPCOMING = "UPCOMING"


def with_ids(catalogue: DataFrame) -> DataFrame:
    """Adds the numeric ids found in the source addresses."""
    return catalogue.withColumn("id_a", source_id(F.col("sources"), HOST_A)).withColumn(
        "id_b", source_id(F.col("sources"), HOST_B)
    )


def seed_entries(catalogue: DataFrame, id_map: DataFrame, types: Sequence[str], most_listed: int | None = None) -> DataFrame:
    """Entries with their series id, before ordering. ``most_listed`` shortens the lists of synonyms and tags; None keeps all.

    ``catalogue``: title, type, status, sources, synonyms, tags, year, season_of_year, episodes.
    ``id_map``: id_a, id_b, tv_id, tvdb_id, tmdb_season, tmdb_offset, tvdb_season, tvdb_offset. The first id decides the
    mapping, the second is the fallback; a row known by the second id only is dropped when the catalogue already has the
    entry it maps to.
    """
    known = with_ids(catalogue)
    rows = known.filter(F.col("type").isin(list(types)) & (F.col("status") != UPCOMING))
    rows = rows.filter(F.col("id_a").isNotNull() | F.col("id_b").isNotNull())
    mapped = F.struct(*[F.col(c) for c in id_map.columns])
    by_a = id_map.filter("id_a IS NOT NULL").groupBy("id_a").agg(F.max_by(mapped, F.coalesce("id_b", F.lit(0))).alias("map_a"))
    by_b = id_map.filter("id_b IS NOT NULL").groupBy("id_b").agg(F.max_by(mapped, F.coalesce("id_a", F.lit(0))).alias("map_b"))
    rows = rows.join(by_a, "id_a", "left").join(by_b, "id_b", "left").withColumn("m", F.coalesce("map_a", "map_b"))

    present = known.filter("id_a IS NOT NULL").select(F.col("id_a").alias("m_id")).distinct().withColumn("present", F.lit(True))
    rows = rows.withColumn("m_id", F.when(F.col("id_a").isNull(), F.col("m.id_a"))).join(present, "m_id", "left")
    rows = rows.filter(F.col("present").isNull())

    def listed(name: str) -> Column:
        values = F.coalesce(name, F.array().cast("array<string>"))
        return (values if most_listed is None else F.slice(values, 1, most_listed)).alias(name)

    key = F.when(F.col("id_a").isNotNull(), F.concat(F.lit("anilist:"), "id_a")).otherwise(F.concat(F.lit("mal:"), "id_b"))
    tv = F.nullif(F.col("m.tv_id"), F.lit(0))
    in_main_line = tv.isNotNull() & (F.coalesce(F.col("m.tmdb_season"), F.lit(-1)) != 0)
    return rows.select(
        key.alias("entry_key"),
        F.when(in_main_line, F.concat(F.lit("tmdb:"), tv)).otherwise(F.concat(F.lit("entry:"), key)).alias("series_id"),
        "id_a", "id_b", "type", "status", "title",
        listed("synonyms"),
        listed("tags"),
        "year", "season_of_year", F.nullif("episodes", F.lit(0)).alias("episodes"),
        F.col("m.tmdb_season").alias("tmdb_season"), F.col("m.tmdb_offset").alias("tmdb_offset"),
        F.col("m.tvdb_season").alias("tvdb_season"), F.col("m.tvdb_offset").alias("tvdb_offset"),
        F.col("m.tvdb_id").alias("tvdb_id"), tv.alias("tmdb_id"),
    )


def seed(catalogue: DataFrame, id_map: DataFrame, types: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(series, entries): entries ordered with running offsets, series with values of their first entries."""
    entries = order_entries(seed_entries(catalogue, id_map, types))
    return series_of(entries), entries.drop("tvdb_id", "tmdb_id")


def series_of(entries: DataFrame) -> DataFrame:
    first = F.min_by(F.struct("title", "tmdb_id"), "order_in_series").alias("first")
    tvdb = F.min_by("tvdb_id", F.when(F.coalesce("tvdb_id", F.lit(0)) != 0, F.col("order_in_series"))).alias("tvdb_id")
    rows = entries.groupBy("series_id").agg(
        first, tvdb, F.sum(F.coalesce("episodes", F.lit(0))).cast("int").alias("total_episodes")
    )
    return rows.select("series_id", "first.title", "first.tmdb_id", "tvdb_id", "total_episodes")


def rollup(entries: DataFrame) -> DataFrame:
    """Popularity, next air time and the last known airing status per series; map-side combined, safe for a huge series."""
    known = F.when(F.col("airing_status").isNotNull(), F.col("order_in_series"))
    return entries.groupBy("series_id").agg(
        F.max("popularity").alias("popularity"),
        F.min("next_episode_at").alias("next_episode_at"),
        F.max_by("airing_status", known).alias("status"),
    )


def refreshed_totals(series: DataFrame, episodes: DataFrame) -> DataFrame:
    """``total_episodes`` raised to the last episode actually received."""
    last = episodes.groupBy("series_id").agg(F.max("abs_ep").alias("_last"))
    return (
        series.join(last, "series_id", "left")
        .withColumn("total_episodes", F.greatest("total_episodes", "_last"))
        .drop("_last")
    )


def work_list(
    series: DataFrame,
    ledger: DataFrame,
    source: str,
    *,
    where: Column | None = None,
    series_id: str | None = None,
    redo: bool = False,
    top: int | None = None,
) -> DataFrame:
    """Series still to process for a source, most popular first: no ledger row yet, or the last try failed.

    With ``top`` the most popular series are taken first and what is done is removed afterwards.
    """
    rows = series
    if top is not None and series_id is None:
        rows = rows.orderBy(F.col("popularity").desc_nulls_last(), "series_id").limit(int(top))
    if where is not None:
        rows = rows.filter(where)
    if series_id is not None:
        rows = rows.filter(F.col("series_id") == series_id)
    if not redo:
        done = ledger.filter((F.col("source") == source) & (F.col("status") != "error")).select("series_id")
        rows = rows.join(done, "series_id", "left_anti")
    return rows.orderBy(F.col("popularity").desc_nulls_last(), "series_id")


def id_batches(ids: DataFrame, column: str, size: int = 50, width: int = 1_000_000) -> DataFrame:
    """Ids in ascending order cut into requests of ``size``: (batch, ids)."""
    from episodika.operators.sequence import exclusive_sum

    rows = ids.select(column).distinct().withColumn("_all", F.lit(1))
    bucket = F.floor(F.col(column) / width)
    rows = exclusive_sum(rows, "_all", [F.col(column)], F.lit(1), "_n", bucket)
    rows = rows.withColumn("batch", F.floor(F.col("_n") / size))
    return rows.groupBy("batch").agg(F.array_sort(F.collect_list(column)).alias("ids"))
