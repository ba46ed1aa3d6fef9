"""Retrieval evaluation: ranks of gold episodes, hit rates, paired comparison, question sampling."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from episodika.operators import vectors
from episodika.session import cut_lineage

# Lengths of a scene worth asking about and the default sample per series.
SCENE_CHARS = (400, 900)
PER_SERIES = 12
#: questions asked at once
BLOCK = 512


def rank_in_hits(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """Rank of the first gold episode and of the gold series in top-k lists (query_id, series_id, abs_ep, rank).

    Hits are folded to distinct episodes in order of appearance first. NULL where the list does not hold it.
    """
    eps = hits.filter(F.coalesce("abs_ep", F.lit(0)) != 0).groupBy("query_id", "series_id", "abs_ep").agg(F.min("rank").alias("at"))
    by_query = W.partitionBy("query_id").orderBy("at")
    eps = eps.withColumn("place", F.row_number().over(by_query))
    shows = eps.groupBy("query_id", "series_id").agg(F.min("at").alias("at")).withColumn("show", F.row_number().over(by_query))
    hit = eps.join(gold, ["query_id", "series_id", "abs_ep"]).groupBy("query_id").agg(F.min("place").alias("episode_rank"))
    home = gold.select("query_id", "series_id").distinct()
    show = shows.join(home, ["query_id", "series_id"]).groupBy("query_id").agg(F.min("show").alias("series_rank"))
    return gold.select("query_id").distinct().join(hit, "query_id", "left").join(show, "query_id", "left")


def exact_ranks(chunks: DataFrame, questions: DataFrame, block: int = BLOCK) -> DataFrame:
    """Exact ranks of gold among all episodes: query_id, in_series, global, series.

    ``questions``: query_id, series_id, gold (array of episodes), vector - a table of any size, asked in blocks. An episode scores as its
    best chunk and its rank is one more than the number of better episodes. A question whose gold has no scored chunk has NULL ranks.

    The chunks of an episode are brought together once; then each block takes two passes. The first finds the best score of the gold
    episodes and of their series, the second counts, per question and series, the episodes that beat the gold. What leaves a task is at
    most a row for each question and series, never a chunk or an episode.
    """
    spark = chunks.sparkSession
    rows = chunks.filter(F.coalesce("abs_ep", F.lit(0)) != 0).select(F.col("series_id").cast("string"), F.col("abs_ep").cast("int"), "embedding")
    rows = cut_lineage(rows.repartition("series_id", "abs_ep").sortWithinPartitions("series_id", "abs_ep"))
    parts = [cut_lineage(_block_ranks(rows, own)) for own in vectors.question_blocks(questions, ["query_id", "series_id", "gold", "vector"], block)]
    if not parts:
        return spark.createDataFrame([], "query_id string, in_series int, global int, series int")
    return functools.reduce(DataFrame.unionByName, parts)


def _block_ranks(rows: DataFrame, questions: list[tuple]) -> DataFrame:
    spark = rows.sparkSession
    names, home = [str(q) for q, *_ in questions], [s for _, s, _, _ in questions]
    matrix = np.asarray([[float(x) for x in v] for *_, v in questions])
    matrix /= np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    gold: dict[tuple[str, int], list[int]] = {}
    at_home: dict[str, list[int]] = {}
    for n, (_, series, episodes, _) in enumerate(questions):
        at_home.setdefault(series, []).append(n)
        for episode in episodes or []:
            if episode is not None:
                gold.setdefault((series, int(episode)), []).append(n)
    rows = rows.filter(F.size("embedding") == matrix.shape[1])

    def episodes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[int], np.ndarray]]:
        """Series, numbers and best scores (questions x episodes) of whole episodes; one that a batch cuts goes on in the next."""
        carried = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if carried is None else pa.concat_tables([carried, pa.Table.from_batches([batch])])
            if not table.num_rows:
                continue
            series, number = table["series_id"].to_pylist(), table["abs_ep"].to_pylist()
            starts = [0] + [i for i in range(1, len(series)) if (series[i], number[i]) != (series[i - 1], number[i - 1])]
            carried = table.slice(starts[-1])
            if len(starts) > 1:
                yield best(table.slice(0, starts[-1]), series, number, starts[:-1])
        if carried is not None:
            yield best(carried, carried["series_id"].to_pylist(), carried["abs_ep"].to_pylist(), [0])

    def best(table: pa.Table, series: list[str], number: list[int], starts: list[int]) -> tuple[list[str], list[int], np.ndarray]:
        vecs = vectors._matrix(table["embedding"].combine_chunks(), matrix.shape[1])
        length = np.sqrt((vecs * vecs).sum(axis=1))
        sims = matrix @ np.where(length > 0, vecs.T / np.where(length > 0, length, 1.0), np.nan)
        # a vector without direction scores nothing
        sims = np.where(np.isnan(sims), -np.inf, sims)
        return [series[i] for i in starts], [number[i] for i in starts], np.maximum.reduceat(sims, starts, axis=1)

    def own_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit, own = np.full(len(names), -np.inf), np.full(len(names), -np.inf)
        for series, number, scores in episodes(batches):
            for e, (s, n) in enumerate(zip(series, number, strict=True)):
                for into, asked in ((own, at_home.get(s)), (hit, gold.get((s, n)))):
                    if asked:
                        into[asked] = np.maximum(into[asked], scores[asked, e])
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(hit), pa.array(own)], names=["query_id", "gold", "own"])

    found = rows.mapInArrow(own_scores, "query_id string, gold double, own double").groupBy("query_id").agg(F.max("gold").alias("gold"), F.max("own").alias("own"))
    known = {r["query_id"]: (r["gold"], r["own"]) for r in found.collect() if r["gold"] > float("-inf")}  # at most a block
    floor = np.array([known[q][0] if q in known else np.inf for q in names])

    def better(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for series, _, scores in episodes(batches):
            # episodes are sorted by series
            cuts = [0] + [i for i in range(1, len(series)) if series[i] != series[i - 1]]
            n, top = np.add.reduceat((scores > floor[:, None]).astype(np.int64), cuts, axis=1), np.maximum.reduceat(scores, cuts, axis=1)
            q, s = np.nonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[i] for i in q], pa.string()), pa.array([series[cuts[i]] for i in s], pa.string()), pa.array(n[q, s]), pa.array(top[q, s])],
                names=["query_id", "series_id", "n", "top"],
            )

    asked = spark.createDataFrame([(q, s, known[q][1] if q in known else None, q in known) for q, s in zip(names, home, strict=True)], "query_id string, home string, own double, found boolean")
    beaten = rows.mapInArrow(better, "query_id string, series_id string, n long, top double").groupBy("query_id", "series_id").agg(F.sum("n").alias("n"), F.max("top").alias("top"))
    counts = beaten.join(asked, "query_id").groupBy("query_id").agg(
        F.sum(F.when(F.col("series_id") == F.col("home"), F.col("n"))).alias("inside"), F.sum("n").alias("all"),
        F.count_if((F.col("series_id") != F.col("home")) & (F.col("top") > F.col("own"))).alias("shows"),
    )
    place = lambda c: F.when(F.col("found"), (F.coalesce(c, F.lit(0)) + 1).cast("int"))
    return asked.join(counts, "query_id", "left").select(
        "query_id", place("inside").alias("in_series"), place("all").alias("global"), place("shows").alias("series")
    )


def summarize(ranks: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    """n, share of gold within the first 1, 3 and 8, and mean reciprocal rank; a missing rank is a miss."""
    within = lambda k: F.round(F.avg(F.coalesce(F.col("rank") <= k, F.lit(False)).cast("int")), 6)
    return ranks.groupBy(*by).agg(
        F.count("*").alias("n"), within(1).alias("hit1"), within(3).alias("hit3"), within(8).alias("hit8"),
        F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"),
    )


def paired(ranks: DataFrame, a: str, b: str) -> DataFrame:
    """On the same questions: how often ``a`` ranks the gold higher than ``b``, lower, or alike."""
    x = ranks.filter(F.col("method") == a).select("query_id", F.coalesce("rank", F.lit(1_000_000)).alias("x"))
    y = ranks.filter(F.col("method") == b).select("query_id", F.coalesce("rank", F.lit(1_000_000)).alias("y"))
    return x.join(y, "query_id").agg(
        F.count_if(F.col("x") < F.col("y")).alias("win"), F.count_if(F.col("x") > F.col("y")).alias("lose"),
        F.count_if(F.col("x") == F.col("y")).alias("tie"),
    )


def verdicts(rows: DataFrame, by: str = "style") -> DataFrame:
    """Histogram of verdicts per group with the mean seconds of the group, and over all as group ``all``."""
    both = rows.withColumn("_group", F.explode(F.array(F.lit("all"), F.col(by))))
    total = both.groupBy("_group").agg(F.round(F.avg("seconds"), 2).alias("mean_seconds"), F.count("*").alias("n"))
    counts = both.groupBy("_group", "verdict").agg(F.count("*").alias("questions"))
    return counts.join(total, "_group").withColumnRenamed("_group", "group")


def sample_questions(chunks: DataFrame, seed: int = 7, per_series: int = PER_SERIES) -> DataFrame:
    """Scenes of fitting length from ``per_series`` distinct episodes of every series, chosen by a seeded digest.

    The draw does not depend on partitioning; rank filters cut each task to what it can contribute before the shuffle.
    """
    scenes = chunks.filter((F.col("type") == "event") & F.col("abs_ep").isNotNull() & F.length("text").between(*SCENE_CHARS))
    draw = lambda *parts: F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(p).cast("string") for p in parts]))
    one = F.row_number().over(W.partitionBy("series_id", "abs_ep").orderBy(draw("chunk_id"), "chunk_id"))
    scenes = scenes.withColumn("_one", one).filter(F.col("_one") == 1)
    some = F.row_number().over(W.partitionBy("series_id").orderBy(draw("series_id", "abs_ep"), "abs_ep"))
    return scenes.withColumn("_some", some).filter(F.col("_some") <= int(per_series)).drop("_one", "_some")
