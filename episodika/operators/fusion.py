"""Merging ranked hit lists and deciding without a language model.

Hit lists are results of top-k searches, so every frame here has at most a few hundred rows whatever the corpus size.
Each list is a frame with chunk_id, series_id, type, abs_ep, score.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from episodika.config import DEFAULTS

RRF_K = DEFAULTS.rrf_k


MAX_HITS = 10_000


def pin(hits: DataFrame, max_rows: int = MAX_HITS) -> DataFrame:
    """A bounded result computed once and kept as a local relation, so that later steps do not repeat the search.

    More rows than a hit list can have is an error, never a silent cut.
    """
    rows = hits.limit(max_rows + 1).toArrow()  # one row more than allowed shows that there are too many
    if rows.num_rows > max_rows:
        raise ValueError(f"more than {max_rows} rows where a bounded hit list is expected")
    # one partition: windows, groupings and joins over these few rows then need no shuffle at all
    return hits.sparkSession.createDataFrame(rows, hits.schema).coalesce(1)


def ranked(hits: DataFrame) -> DataFrame:
    """Adds the 0-based position by score (ties by chunk id) to a top-k result."""
    order = W.orderBy(F.col("score").desc(), F.col("chunk_id").asc())
    return hits.withColumn("position", F.row_number().over(order) - 1)


def _stack(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames).coalesce(1)


def _numbered(lists: Sequence[DataFrame], columns: Sequence[str]) -> DataFrame:
    return _stack([ranked(h).select(*columns, "position").withColumn("list_no", F.lit(i)) for i, h in enumerate(lists)])


def rank_series(lists: Sequence[DataFrame]) -> DataFrame:
    """Series by reciprocal rank summed over every hit of every list; ties in order of first appearance."""
    hits = _numbered(lists, ["series_id"])
    return (
        hits.groupBy("series_id")
        .agg(
            F.sum(1.0 / (RRF_K + F.col("position"))).alias("rrf"),
            F.min(F.col("list_no") * 1_000_000 + F.col("position")).alias("first_seen"),
        )
        .orderBy(F.col("rrf").desc(), F.col("first_seen").asc())
    )


def fuse_episodes(dense: Sequence[DataFrame], keyword: DataFrame | None = None) -> DataFrame:
    """Hits of several searches merged per (series, episode).

    An episode takes part in a list once, at the rank of its best hit among the distinct episodes of that list. Dense
    lists weigh 1 each, the keyword list as much as all dense lists together. Hits without an episode are skipped.
    """
    columns = ["chunk_id", "series_id", "type", "abs_ep", "score"]
    lists = list(dense) + ([keyword] if keyword is not None else [])
    hits = _numbered(lists, columns).filter(F.coalesce("abs_ep", F.lit(0)) != 0)
    is_dense = F.col("list_no") < len(dense)
    weight = F.when(is_dense, F.lit(1.0)).otherwise(F.lit(float(max(len(dense), 1))))

    best = hits.groupBy("list_no", "series_id", "abs_ep").agg(
        F.min("position").alias("position"), F.min_by("chunk_id", "position").alias("chunk_id")
    )
    place = F.row_number().over(W.partitionBy("list_no").orderBy("position")) - 1
    parts = best.withColumn("place", place).groupBy("series_id", "abs_ep").agg(
        F.sum(weight / (RRF_K + F.col("place"))).alias("rrf"),
        F.max_by("chunk_id", F.when(is_dense, F.col("list_no") + 1).otherwise(F.lit(0))).alias("chunk_id"),
        F.min(F.col("list_no") * 1_000_000 + F.col("position")).alias("first_seen"),
    )
    totals = hits.groupBy("series_id", "abs_ep").agg(
        F.max(F.when(is_dense, F.col("score"))).alias("score"),
        F.count_distinct(F.when(F.col("type") == "event", F.col("chunk_id"))).alias("scenes"),
    )
    return parts.join(totals, ["series_id", "abs_ep"]).orderBy(*fusion_order())


def fusion_order() -> list[Column]:
    return [
        F.col("rrf").desc(),
        F.col("scenes").desc(),
        F.coalesce("score", F.lit(0.0)).desc(),
        F.col("first_seen").asc(),
    ]


def decide_many(
    questions: DataFrame, episodes: DataFrame, heads: DataFrame, *, min_score: float = DEFAULTS.min_score, margin: float = DEFAULTS.margin
) -> DataFrame:
    """Verdicts of any number of questions from scores alone: rows (question_id, status, position, series_id, abs_ep, score).

    ``questions``: question_id, named. ``episodes``: fused episodes with question_id. ``heads``: question_id, series_id of the first five
    global hits. A question without a verdict has one row "none" with NULLs.

    none: no episode with a similarity, or the leader below ``min_score``. ambiguous series: no title was named and the
    leader's series holds fewer than three of the first five global hits; up to three series by their best episode.
    ambiguous episodes: the runner-up of the same series is closer than ``margin``; up to three. Otherwise episode.
    """
    asked = W.partitionBy("question_id")
    place = F.row_number().over(asked.orderBy(*fusion_order()))
    eps = episodes.filter(F.col("score").isNotNull()).select("question_id", "series_id", "abs_ep", "score", place.alias("place"))
    own = W.partitionBy("question_id", "series_id").orderBy("place")
    eps = eps.withColumns({"rival": F.row_number().over(own), "next_score": F.lead("score").over(own)})
    held = heads.groupBy("question_id", "series_id").agg(F.count("*").alias("held"))
    eps = eps.join(held, ["question_id", "series_id"], "left").join(questions, "question_id")
    status = (
        F.when(F.col("score") < min_score, "none")
        .when(~F.col("named") & (F.coalesce("held", F.lit(0)) < 3), "series")
        .when(F.coalesce(F.col("score") - F.col("next_score") < margin, F.lit(False)), "episodes")
        .otherwise("episode")
    )
    # the leader's row knows the verdict; every row of the question is told
    top = F.max(F.when(F.col("place") == 1, F.struct(status.alias("status"), "series_id"))).over(asked)
    eps = eps.withColumn("top", top)
    leader = F.row_number().over(W.partitionBy("question_id", "rival").orderBy(F.col("score").desc(), "place"))
    eps = eps.withColumn("leader", leader)
    position = (
        F.when((F.col("top.status") == "series") & (F.col("rival") == 1), F.col("leader"))
        .when((F.col("top.status") == "episodes") & (F.col("series_id") == F.col("top.series_id")), F.col("rival"))
        .when((F.col("top.status") == "episode") & (F.col("place") == 1), F.lit(1))
    )
    chosen = eps.withColumn("position", position.cast("int")).filter("position <= 3").select(
        "question_id", F.when(F.col("top.status") == "episode", "episode").otherwise("ambiguous").alias("status"), "position", "series_id",
        F.when(F.col("top.status") != "series", F.col("abs_ep")).alias("abs_ep"), "score",
    )
    return questions.select("question_id").join(chosen, "question_id", "left").withColumns(
        {"status": F.coalesce("status", F.lit("none")), "position": F.coalesce("position", F.lit(1))}
    )


def decide(
    episodes: DataFrame, first_list: DataFrame | None, *, named: bool = False, min_score: float = DEFAULTS.min_score, margin: float = DEFAULTS.margin
) -> DataFrame:
    """The verdict of one question: rows (status, position, series_id, abs_ep, score); see :func:`decide_many`."""
    question = F.lit("q").alias("question_id")
    asked = episodes.sparkSession.range(1).select(question, F.lit(bool(named)).alias("named"))
    heads = asked.select("question_id", F.lit(None).cast("string").alias("series_id")).filter("false")
    if first_list is not None:
        heads = ranked(first_list).filter("position < 5").select(question, "series_id")
    return decide_many(asked, episodes.select(question, "*"), heads, min_score=min_score, margin=margin).drop("question_id")
