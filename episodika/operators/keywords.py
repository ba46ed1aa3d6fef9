"""Gated keyword search: the score of a row is the summed rarity (IDF) of the distinct query stems it contains.

Rarity is computed over the rows the viewer may see, so a hidden episode cannot influence a visible score.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from episodika.functions.stem import STOP_WORDS, english_stems, is_stop_word, stem, word_stem
from episodika.operators.gate import Watched, narrowed, visible

# Fixed value: what counts as a word of the question.
QUERY_WORD = r"[A-Za-z0-9]{2,}"
DOCUMENT_WORD = r"[\p{L}\p{N}]+"

#: rows whose postings make one file at most, on average
CHUNKS_PER_FILE = 5_000


def query_words(texts: Iterable[str]) -> list[str]:
    """Distinct lower-case words of the question texts in order of appearance."""
    return list(dict.fromkeys(w.lower() for text in texts for w in re.findall(QUERY_WORD, text)))


def document_words(text: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(DOCUMENT_WORD), F.lit(0)))


def simple_terms(texts: Iterable[str]) -> list[str]:
    return [w for w in query_words(texts) if w not in STOP_WORDS]


def stemmed_terms(texts: Iterable[str]) -> list[str]:
    return list(dict.fromkeys(stem(w) for w in query_words(texts) if w not in STOP_WORDS))


ANALYZERS: dict[str, tuple[Callable[[Iterable[str]], list[str]], Callable[[Column | str], Column]]] = {
    "simple": (simple_terms, document_words),
    "english": (stemmed_terms, english_stems),
}


def ranking() -> list[Column]:
    """Best score first, ties by chunk id. Sums of the same weights in another order differ in their last bits; nine decimals make them ties."""
    return [F.round("score", 9).desc(), F.col("chunk_id").asc()]


def idf(total: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (total - df + F.lit(0.5)) / (df + F.lit(0.5)))


def search(
    chunks: DataFrame,
    texts: Iterable[str],
    *,
    watched: Watched,
    unrecorded: int = 0,
    series_ids: Iterable[str] | None,
    types: Iterable[str],
    k: int = 20,
    analyzer: str = "english",
) -> DataFrame:
    """Top-k rows by summed rarity, ties by chunk id.

    Stems are made in Python, of one word a row, so that no batch there holds whole texts; only words with a wanted stem are shuffled.
    Plain words need two scans and no shuffle of the rows: the first counts visible rows and rows per query term (partial aggregation
    over at most ``len(terms) + 1`` keys), the second scores each row in place and keeps ``k``.
    """
    to_terms, to_words = ANALYZERS[analyzer]
    terms = to_terms(texts)
    series_ids = None if series_ids is None else list(series_ids)
    rows = visible(narrowed(chunks, series_ids=series_ids, types=types), watched=watched, unrecorded=unrecorded)
    if not terms or series_ids == []:
        return rows.withColumn("score", F.lit(None).cast("double")).filter(F.lit(False))
    if analyzer == "english":
        words = rows.select("chunk_id", F.explode(document_words("text")).alias("word")).filter(~is_stop_word(F.col("word")))
        hits = words.select("chunk_id", word_stem("word").alias("term")).filter(F.col("term").isin(terms)).distinct()
        return _best(hits, rows.agg(F.count("*")).scalar(), rows, k)
    wanted = F.array(*[F.lit(t) for t in terms])
    matched = F.array_intersect(to_words("text"), wanted)

    counted = rows.select(F.explode(F.concat(F.array(F.lit(None).cast("string")), matched)).alias("term"))
    counts = counted.groupBy("term").agg(F.count("*").alias("n"))
    # at most one entry per query term: bounded by the question, not by the corpus
    table = counts.agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce("term", F.lit("")), "n"))).alias("m"))
    scored = (
        rows.withColumn("_matched", matched)
        .filter(F.size("_matched") > 0)
        .withColumn("_n", table.scalar())
        .withColumn(
            "score",
            F.aggregate(
                "_matched", F.lit(0.0), lambda s, t: s + idf(F.col("_n")[""].cast("double"), F.col("_n")[t].cast("double"))
            ),
        )
    )
    return scored.drop("_matched", "_n").orderBy(*ranking()).limit(int(k))


def _best(hits: DataFrame, total: Column, chunks: DataFrame, k: int) -> DataFrame:
    """The ``k`` best ``chunks`` from (chunk_id, term) pairs; ``total``: how many rows there are in all."""
    weights = hits.groupBy("term").agg(F.count("*").cast("double").alias("df"))
    weights = weights.select("term", idf(total.cast("double"), F.col("df")).alias("weight"))
    best = (
        hits.join(weights, "term")
        .groupBy("chunk_id")
        .agg(F.sum("weight").alias("score"))
        .orderBy(*ranking())
        .limit(int(k))
    )
    return chunks.join(best, "chunk_id").orderBy(*ranking())


# ---------------------------------------------------------------- inverted index


def build_postings(chunks: DataFrame, analyzer: str = "english") -> DataFrame:
    """One row per (term, chunk) with the columns the gate needs.

    Write it range-partitioned by (term, chunk_id): a frequent term then spreads over many files and a search reads the
    row groups of its own terms only.
    """
    _, to_words = ANALYZERS[analyzer]
    words = chunks.select("chunk_id", "series_id", "type", "abs_ep", F.explode(to_words("text")).alias("term"))
    if analyzer == "english":
        words = words.filter(F.col("term") != "")
    return words


def write_postings(postings: DataFrame, path: str, partitions: int) -> None:
    (
        postings.repartitionByRange(int(partitions), "term", "chunk_id")
        .sortWithinPartitions("term", "chunk_id")
        .write.mode("overwrite")
        .parquet(path)
    )


def write_index(chunks: DataFrame, path: str, partitions: int, analyzer: str = "english") -> None:
    """Postings of ``chunks`` under ``path`` with the number of rows of each (series, type, episode), which weights need; stems are made once, here.

    ``partitions`` is the least number of files; there are more of them with more rows, so that none is sorted as a large whole.
    """
    partitions = max(int(partitions), -(-chunks.count() // CHUNKS_PER_FILE))
    write_postings(build_postings(chunks, analyzer), f"{path}/postings", partitions)
    chunks.groupBy("series_id", "type", "abs_ep").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/sizes")


def search_index(
    spark: SparkSession,
    path: str,
    texts: Iterable[str],
    *,
    watched: Watched,
    unrecorded: int = 0,
    series_ids: Iterable[str] | None,
    types: Iterable[str],
    k: int = 20,
    analyzer: str = "english",
) -> DataFrame:
    """chunk_id, series_id, type, abs_ep, score of the best chunks from the stored index; row groups of other terms are not read, nor any text."""
    terms = ANALYZERS[analyzer][0](texts)
    scope = dict(watched=watched, unrecorded=unrecorded)
    narrow = dict(series_ids=None if series_ids is None else list(series_ids), types=list(types))
    hits = visible(narrowed(spark.read.parquet(f"{path}/postings").filter(F.col("term").isin(terms)), **narrow), **scope)
    total = visible(narrowed(spark.read.parquet(f"{path}/sizes"), **narrow), **scope).agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    weights = hits.groupBy("term").agg(F.count("*").cast("double").alias("df"))
    weights = weights.select("term", idf(total.cast("double"), F.col("df")).alias("weight"))
    best = hits.join(weights, "term").groupBy("chunk_id", "series_id", "type", "abs_ep").agg(F.sum("weight").alias("score"))
    return best.orderBy(*ranking()).limit(int(k))


def search_postings(
    postings: DataFrame,
    chunks: DataFrame,
    texts: Iterable[str],
    *,
    watched: Watched,
    unrecorded: int = 0,
    series_ids: Iterable[str] | None,
    types: Iterable[str],
    k: int = 20,
    analyzer: str = "english",
) -> DataFrame:
    """The same result read from the index; texts are fetched for the ``k`` winners only."""
    terms = ANALYZERS[analyzer][0](texts)
    scope = dict(watched=watched, unrecorded=unrecorded)
    narrow = dict(series_ids=None if series_ids is None else list(series_ids), types=list(types))
    hits = visible(narrowed(postings.filter(F.col("term").isin(terms)), **narrow), **scope)
    total = visible(narrowed(chunks.select("series_id", "type", "abs_ep"), **narrow), **scope).agg(F.count("*")).scalar()
    return _best(hits, total, chunks, k)
