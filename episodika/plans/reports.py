"""Progress, readiness and coverage reports. Aggregates are taken per table first, then joined, so nothing fans out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from episodika.config import DEFAULTS

LONG_PLOT = DEFAULTS.min_plot_chars
# Sources whose progress is shown and the condition that makes a series a target of one.
SOURCES = ("tvmaze", "tmdb", "jikan", "characters", "chunks")
SCOPES = {"tvmaze": "tvdb_id IS NOT NULL", "tmdb": "tmdb_id IS NOT NULL"}


def long_plot() -> Column:
    return F.length("plot") >= LONG_PLOT


def totals(series: DataFrame) -> DataFrame:
    return series.agg(
        F.count("*").alias("series"), F.sum("total_episodes").alias("episodes"), F.count("popularity").alias("with_popularity")
    )


def most_popular(series: DataFrame, n: int) -> DataFrame:
    return series.orderBy(F.col("popularity").desc_nulls_last(), "series_id").limit(int(n))


def progress(series: DataFrame, ledger: DataFrame, top: int | None = None, sources: Sequence[str] = SOURCES, scopes: Mapping[str, str] = SCOPES) -> DataFrame:
    """One row per source: target, ok, empty, error, last fetch. All sources in a single grouped pass."""
    base = series if top is None else most_popular(series, top)
    each = base.withColumn("source", F.explode(F.array(*[F.lit(s) for s in sources])))
    is_target = F.lit(True)
    for source, condition in scopes.items():
        is_target = F.when(F.col("source") == source, F.expr(condition)).otherwise(is_target)
    joined = each.join(ledger.select("series_id", "source", "status", "fetched_at"), ["series_id", "source"], "left")
    rows = joined.groupBy("source").agg(
        F.count_if(is_target).alias("target"),
        F.count_if(F.col("status") == "ok").alias("ok"),
        F.count_if(F.col("status") == "empty").alias("empty"),
        F.count_if(F.col("status") == "error").alias("error"),
        F.max("fetched_at").alias("last"),
    )
    return rows.withColumn("share", (F.col("ok") + F.col("empty")) / F.nullif("target", F.lit(0)))


def collected(episodes: DataFrame) -> DataFrame:
    """What the episode table holds; ``filler`` counts known values, true or false."""
    return episodes.agg(
        F.count("*").alias("episodes"),
        F.count("title_en").alias("english_titles"),
        F.count("overview_ko").alias("korean_overviews"),
        F.count("filler").alias("filler_known"),
        F.count_if(long_plot()).alias("long_plots"),
    )


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("type").agg(F.count("*").alias("chunks"), F.count("embedding").alias("embedded"))


def readiness(series: DataFrame, episodes: DataFrame, share: float = DEFAULTS.ready_fill) -> DataFrame:
    summary = F.coalesce("summary_en", "overview_ko", "overview_en", "synopsis_en").isNotNull()
    ep = episodes.groupBy("series_id").agg(F.count_if(summary).alias("summaries"), F.count_if(long_plot()).alias("plots"))
    need = share * F.nullif("total_episodes", F.lit(0))
    return series.join(ep, "series_id", "left").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("tmdb_id").isNotNull() | F.col("tvdb_id").isNotNull()).alias("linked"),
        F.count_if(F.col("summaries") >= need).alias("episode_ready"),
        F.count_if(F.col("plots") >= need).alias("detail_ready"),
    )


def detail(series: DataFrame, episodes: DataFrame, chunks: DataFrame, ledger: DataFrame, source: str = "fandom") -> DataFrame:
    """Per series with a ledger row of the source: plots, mean plot length, source chapters, arcs, scene chunks."""
    ep = episodes.groupBy("series_id").agg(
        F.count_if(long_plot()).alias("plots"),
        F.round(F.avg(F.length("plot"))).alias("mean_length"),
        F.count("chapters").alias("chapters"),
        F.count("arc").alias("arcs"),
    )
    scenes = chunks.filter(F.col("type") == "event").groupBy("series_id").agg(F.count("*").alias("scenes"))
    rows = ledger.filter(F.col("source") == source).select("series_id", "detail").join(series, "series_id")
    rows = rows.join(ep, "series_id", "left").join(scenes, "series_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select(
        "series_id",
        F.coalesce("title_ko", "title").alias("name"),
        "total_episodes",
        zero("plots"), F.col("mean_length"), zero("chapters"), zero("arcs"), zero("scenes"), "detail",
        (F.coalesce("plots", F.lit(0)) / F.nullif("total_episodes", F.lit(0))).alias("fill"),
    )


def coverage(series: DataFrame, episodes: DataFrame, characters: DataFrame, streaming: DataFrame, ledger: DataFrame, top: int) -> DataFrame:
    """Top-n series by popularity with what each source contributed. The n ids narrow every other table first."""
    chosen = most_popular(series, top)
    ids = chosen.select("series_id")
    ep = episodes.join(ids, "series_id", "left_semi").groupBy("series_id").agg(
        F.count("summary_en").alias("summaries"),
        F.count("overview_ko").alias("korean"),
        F.count("filler").alias("filler_known"),
        F.count_if(long_plot()).alias("plots"),
    )
    people = characters.join(ids, "series_id", "left_semi").groupBy("series_id").agg(F.count("*").alias("characters"))
    providers = (
        streaming.join(ids, "series_id", "left_semi")
        .select("series_id", F.explode("flatrate").alias("p"))
        .groupBy("series_id")
        .agg(F.array_join(F.array_sort(F.collect_set("p")), ", ").alias("providers"))
    )
    failed = (
        ledger.filter(F.col("status") == "error")
        .join(ids, "series_id", "left_semi")
        .groupBy("series_id")
        .agg(F.array_join(F.array_sort(F.collect_list("source")), ",").alias("failed"))
    )
    rows = chosen
    for part in (ep, people, providers, failed):
        rows = rows.join(part, "series_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select(
        "series_id", F.coalesce("title_ko", "title").alias("name"), "total_episodes", "popularity",
        zero("summaries"), zero("korean"), zero("filler_known"), zero("plots"), zero("characters"), "providers", "failed",
    ).orderBy(F.col("popularity").desc_nulls_last(), "series_id")


def service_ids(series: DataFrame, episodes: DataFrame, fill: float = DEFAULTS.min_plot_fill) -> DataFrame:
    """Series whose long plots cover enough of the known episodes to be served."""
    ep = episodes.groupBy("series_id").agg(F.count_if(long_plot()).alias("plots"), F.count("*").alias("n"))
    rows = series.join(ep, "series_id").filter(F.col("plots") >= fill * F.greatest("total_episodes", "n"))
    return rows.select("series_id")


def as_markdown(rows: DataFrame, limit: int = 1_000) -> str:
    """Report text of a bounded report frame; more rows than ``limit`` are an error, never a silent cut."""
    data = rows.take(limit + 1)
    if len(data) > limit:
        raise ValueError(f"more than {limit} rows where a bounded report is expected")
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v) for v in row) + " |" for row in data]
    return "\n".join(lines) + "\n"
