"""Finding a series and an episode from remembered clues.

The language-model steps stay outside: clues arrive as vectors and words, and the judge's verdict is checked by
``episodika.functions.ground``. Everything read goes through the gate.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

from episodika.config import DEFAULTS, Settings
from episodika.operators import fusion, keywords, vectors
from episodika.operators.gate import ALL_EPISODES, Watched, narrowed, visible


@dataclass(frozen=True)
class Found:
    series_ids: list[str]
    episodes: DataFrame
    extras: DataFrame
    first_list: DataFrame | None
    named: bool


def candidate_lists(chunks, query_vectors, terms, scope, settings, analyzer):
    """Global hit lists of the first step: scenes, profiles by vector, profiles by words."""
    scenes = [vectors.search(chunks, v, types=settings.chunk_types, k=settings.pool, **scope) for v in query_vectors]
    looks = [vectors.search(chunks, v, types=settings.profile_types, k=settings.pool, **scope) for v in query_vectors]
    words = keywords.search(
        chunks, terms, series_ids=None, types=settings.profile_types, k=settings.pool, analyzer=analyzer, **scope
    )
    return scenes, looks, words


def find(
    chunks: DataFrame,
    query_vectors: Sequence[Sequence[float]],
    terms: Sequence[str],
    *,
    watched: Watched,
    named: Sequence[str] = (),
    guessed: Sequence[str] = (),
    settings: Settings = DEFAULTS,
    analyzer: str = "english",
) -> Found:
    """Candidate series, then the fused episodes inside them.

    Only the ids of at most ``max_series`` candidates come to the driver, so the second step filters the chunk table by
    literal ids and prunes partitions.
    """
    scope = dict(watched=watched, unrecorded=ALL_EPISODES)
    if named:
        series_ids, first_list = [str(named[0])], None
    else:
        scenes, looks, words = candidate_lists(chunks, query_vectors, terms, scope, settings, analyzer)
        columns = ["chunk_id", "series_id", "type", "abs_ep", "score"]
        scenes, looks = ([fusion.pin(h.select(*columns)) for h in lists] for lists in (scenes, looks))
        words = fusion.pin(words.select(*columns))
        order = fusion.rank_series(scenes + looks + [words] * len(scenes)).limit(settings.max_series)
        found = [row["series_id"] for row in order.collect()]
        series_ids = list(dict.fromkeys([*guessed, *found]))[: settings.max_series]
        first_list = scenes[0] if scenes else None
    inside = narrowed(chunks, series_ids=series_ids)
    dense = [
        vectors.search_per_series(inside, v, types=settings.chunk_types, k=20, **scope).drop("rank_in_series")
        for v in query_vectors
    ]
    words = keywords.search(chunks, terms, series_ids=series_ids, types=["event"], k=30, analyzer=analyzer, **scope)
    episodes = fusion.fuse_episodes(dense, words)
    return Found(series_ids, episodes, _extras(chunks, query_vectors, terms, series_ids, scope, settings, analyzer), first_list, bool(named))


def _extras(chunks, query_vectors, terms, series_ids, scope, settings, analyzer) -> DataFrame:
    """Two best profile rows per candidate series by words and two by vector, each row once."""
    columns = ["chunk_id", "series_id", "type", "abs_ep"]
    by_words = [
        keywords.search(
            chunks, terms, series_ids=[sid], types=settings.profile_types, k=2, analyzer=analyzer, **scope
        ).select(*columns)
        for sid in series_ids
    ]
    near = vectors.search_per_series(
        narrowed(chunks, series_ids=series_ids), query_vectors[-1], types=settings.profile_types, k=2, **scope
    ).select(*columns)
    for frame in by_words:
        near = near.unionByName(frame)
    return near.distinct()


def evidence(episodes: DataFrame, chunks: DataFrame, *, watched: Watched, settings: Settings = DEFAULTS) -> DataFrame:
    """Whole plots of the leading episodes, read again under the gate; episodes without one keep their hit."""
    top = episodes.limit(settings.judge_chunks)
    plots = visible(
        chunks.filter(F.col("type") == "plot"), watched=watched, unrecorded=ALL_EPISODES
    ).select("series_id", "abs_ep", F.col("chunk_id").alias("plot_id"), F.col("text").alias("plot"))
    joined = top.join(plots, ["series_id", "abs_ep"], "left")
    return joined.withColumn("shown", F.substring("plot", 1, settings.judge_chunk_chars)).drop("plot")


def result_rows(found: Found, *, settings: Settings = DEFAULTS) -> DataFrame:
    return fusion.decide(
        found.episodes, found.first_list, named=found.named, min_score=settings.min_score, margin=settings.margin
    )


def limits_of(series_ids: Sequence[str], watched: Mapping[str, int]) -> dict[str, int]:
    """Positions that narrowed the search, to be told to the viewer."""
    return {sid: watched[sid] for sid in series_ids if sid in watched}


def verdict_of(results: DataFrame, gold: DataFrame) -> DataFrame:
    """Verdict per question from result rows (question_id, status, position, series_id, abs_ep) and gold episodes."""
    first = results.filter("position = 1").select(
        "question_id", "status", F.col("series_id").alias("first_series"), F.col("abs_ep").alias("first_ep")
    )
    right = (
        results.join(gold, ["question_id", "series_id", "abs_ep"], "left_semi").select("question_id").distinct()
        .withColumn("has_gold", F.lit(True))
    )
    exact = gold.select("question_id", F.col("series_id").alias("first_series"), F.col("abs_ep").alias("first_ep"))
    exact = exact.distinct().withColumn("exact", F.lit(True))
    homes = gold.select("question_id", F.col("series_id").alias("home")).distinct()
    homes = homes.withColumn("n", F.row_number().over(W.partitionBy("question_id").orderBy("home"))).filter("n = 1")
    joined = (
        first.join(exact, ["question_id", "first_series", "first_ep"], "left")
        .join(right, "question_id", "left")
        .join(homes.drop("n"), "question_id", "left")
    )
    verdict = (
        F.when((F.col("status") == "episode") & F.col("exact"), "episode right")
        .when(F.col("status") == "episode", "episode wrong")
        .when((F.col("status") == "series") & (F.col("first_series") == F.col("home")), "series right")
        .when(F.col("status") == "series", "series wrong")
        .when((F.col("status") == "ambiguous") & F.col("has_gold"), "asked back, answer among candidates")
        .when(F.col("status") == "ambiguous", "asked back, answer missing")
        .otherwise("not found")
    )
    return joined.select("question_id", verdict.alias("verdict"))
