"""Ways of cutting plots into chunks, compared on the same questions from texts to paired ranks."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from episodika.functions import text as t
from episodika.plans import evaluate, vector_store
from episodika.plans.embedding import Encoder, semantic_pieces
from episodika.session import cut_lineage

# The methods, and the labels that stand between an episode's head and its text.
METHODS = ("paragraph", "overlap", "semantic", "fixed", "plot")
SCENE, PLOT = " 장면", " 줄거리"


def pieces_of(plots: DataFrame, make_encoder: Callable[[], Encoder], methods: Sequence[str] = METHODS) -> DataFrame:
    """(method, series_id, abs_ep, text) of ``plots`` (series_id, abs_ep, head, plot): a row per piece, each under its episode's head."""
    rows = plots.select("series_id", "abs_ep", "head", "plot")
    if "semantic" in methods:
        rows = semantic_pieces(rows, "plot", make_encoder)
    cut = {
        "paragraph": lambda: t.paragraphs("plot"), "overlap": lambda: t.overlapping_pieces(t.paragraphs("plot")),
        "semantic": lambda: F.col("pieces"), "fixed": lambda: t.fixed_pieces("plot"), "plot": lambda: F.array("plot"),
    }
    # a plot is cut by all methods in its own row: it is read once, and its like pieces stay together
    of = lambda method: lambda piece: F.struct(F.lit(method).alias("method"), piece.alias("piece"))
    made = F.concat(*[F.transform(cut[method](), of(method)) for method in methods])
    rows = rows.select("series_id", "abs_ep", "head", F.explode(made).alias("x"))
    label = F.when(F.col("x.method") == "plot", PLOT).otherwise(SCENE)
    return rows.select("x.method", "series_id", "abs_ep", F.concat("head", label, F.lit("\n"), "x.piece").alias("text"))


def compare(plots: DataFrame, questions: DataFrame, store: str, model: str, make_encoder: Callable[[], Encoder], methods: Sequence[str] = METHODS) -> DataFrame:
    """(method, query_id, in_series, global, series): exact ranks of every question's gold episode with each method.

    ``questions``: query_id, series_id, gold (array of episodes), text. Texts are encoded through the content-addressed ``store``: a piece
    that two methods share, or that an earlier run had, is encoded once. Behind the encoder only its key goes on, not the text.
    """
    pieces = cut_lineage(vector_store.keyed(pieces_of(plots, make_encoder, methods), model), "zstd")
    texts = pieces.select("_key", "text").unionByName(vector_store.keyed(questions.select("text"), model))
    vector_store.encode_missing(texts, store, model, make_encoder)
    chunks = cut_lineage(vector_store.with_vectors(pieces.drop("text"), store, model))
    asked = cut_lineage(vector_store.with_vectors(questions, store, model).withColumnRenamed("embedding", "vector").drop("text"))
    parts = [evaluate.exact_ranks(chunks.filter(F.col("method") == m), asked).withColumn("method", F.lit(m)) for m in methods]
    return functools.reduce(DataFrame.unionByName, parts).select("method", "query_id", "in_series", "global", "series")


def summary(ranks: DataFrame) -> DataFrame:
    """Per method: n, share of gold among the first 1, 3 and 8 of its series, mean reciprocal rank, series first, episode among the first 8 of all."""
    share = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("int")), 6)
    return ranks.groupBy("method").agg(
        F.count("*").alias("n"), *[share(F.col("in_series") <= k).alias(f"hit{k}") for k in (1, 3, 8)],
        F.round(F.avg(F.coalesce(1 / F.col("in_series"), F.lit(0.0))), 6).alias("mrr"), share(F.col("series") == 1).alias("series_first"), share(F.col("global") <= 8).alias("global8"),
    )
