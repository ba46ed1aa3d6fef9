"""Title index, mentions, lookups and tag overlap."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from episodika.functions.text import episode_label, norm_name

# Shortest names looked for inside a text, and limits of the fuzzy lookup.
HANGUL = r"[가-힣]"
MIN_HANGUL, MIN_OTHER = 2, 5
MIN_QUERY, MIN_INSIDE_QUERY, MIN_NAME_INSIDE = 2, 3, 4


#: characters of names in one automaton; a few hundred bytes each in a worker
SHARD_CHARS = 2_000_000


def title_index(series: DataFrame, entries: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(name, series_id, popularity, is_main): normalised names of every series, each once.

    Main names are the display titles, the English title of the first entry and curated aliases.
    """
    def names(df: DataFrame, titles: Column, main: Column) -> DataFrame:
        return df.select("series_id", F.explode(titles).alias("raw"), main.alias("is_main"))

    none = F.array().cast("array<string>")
    parts = [
        names(series, F.array("title_ko", "title"), F.lit(True)),
        names(series, F.concat(F.array("title_original"), F.coalesce("alt_titles", none)), F.lit(False)),
        names(entries, F.array("title_en"), F.col("order_in_series") == 1),
        names(entries, F.concat(F.array("title"), F.coalesce("synonyms", none)), F.lit(False)),
    ]
    if aliases is not None:
        parts.append(names(aliases.join(series.select("series_id"), "series_id", "left_semi"), F.array("alias"), F.lit(True)))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = rows.withColumn("name", norm_name("raw")).filter(F.col("name") != "")
    rows = rows.groupBy("name", "series_id").agg(F.max("is_main").alias("is_main"))
    popularity = series.select("series_id", F.coalesce("popularity", F.lit(0)).alias("popularity"))
    return rows.join(popularity, "series_id", "left").select(
        "name", "series_id", F.coalesce("popularity", F.lit(0)).alias("popularity"), "is_main"
    )


def _searchable(index: DataFrame) -> DataFrame:
    shortest = F.when(F.col("name").rlike(HANGUL), MIN_HANGUL).otherwise(MIN_OTHER)
    return index.filter(F.col("is_main") & (F.length("name") >= shortest))


def _shards(names: DataFrame, chars: int) -> Iterator[list[str]]:
    """The names in lists of at most ``chars`` characters together; the driver holds one list at a time."""
    held, size = [], 0
    for row in names.toLocalIterator():
        if held and size + len(row["name"]) > chars:
            yield held
            held, size = [], 0
        held.append(row["name"])
        size += len(row["name"])
    if held:
        yield held


@functools.lru_cache(maxsize=2)
def _automaton(names: tuple[str, ...]):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for name in names:
        automaton.add_word(name, name)
    automaton.make_automaton()
    return automaton


def names_in(texts: DataFrame, names: DataFrame, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(text_id, name): every distinct name of ``names`` (name) that stands in a text (text_id, hay).

    Names go to the tasks in shards of bounded size, each one automaton; a task reads every text once for a shard and all its names
    at once. What leaves it is a row for each name found, so nothing grows with texts times names or with characters.
    """
    context = texts.sparkSession.sparkContext
    kind = dict(texts.dtypes)["text_id"]
    parts = []
    for shard in _shards(names.select("name").distinct(), shard_chars):
        sent = context.broadcast(tuple(shard))

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(sent.value)
            for batch in batches:
                found = [sorted({name for _, name in automaton.iter(hay.as_py())}) for hay in batch["hay"]]
                at = np.repeat(np.arange(len(found)), [len(f) for f in found])
                ids = batch["text_id"].take(pa.array(at, pa.int64()))
                yield pa.record_batch([ids, pa.array([n for f in found for n in f], pa.string())], names=["text_id", "name"])

        parts.append(texts.select("text_id", "hay").mapInArrow(scan, f"text_id {kind}, name string"))
    if not parts:
        return texts.select("text_id", F.lit(None).cast("string").alias("name")).filter(F.lit(False))
    return functools.reduce(DataFrame.unionByName, parts)


def mentions(texts: DataFrame, index: DataFrame) -> DataFrame:
    """Series whose name stands in a text: (text_id, series_id, name, popularity), longest names only.

    A name inside a longer name found in the same text is dropped.
    """
    names = _searchable(index).select("name", "series_id", "popularity")
    hay = texts.select("text_id", norm_name("text").alias("hay")).filter(F.length("hay") >= MIN_HANGUL)
    found = (
        names_in(hay, names)
        .join(names, "name")
        .groupBy("text_id", "series_id")
        .agg(F.max(F.struct(F.length("name").alias("n"), F.col("popularity"), F.col("name"))).alias("best"))
    )
    return longest_only(found)


def longest_only(found: DataFrame) -> DataFrame:
    """Drops names contained in a longer name of the same text; a text holds few distinct names, compared as one array."""
    names = found.groupBy("text_id").agg(F.collect_set("best.name").alias("names"))
    kept = found.join(names, "text_id").filter(
        ~F.exists("names", lambda other: (other != F.col("best.name")) & other.contains(F.col("best.name")))
    )
    return kept.select(
        "text_id", "series_id", F.col("best.name").alias("name"), F.col("best.popularity").alias("popularity")
    )


def mentioned_in(index: DataFrame, text: str) -> DataFrame:
    """Series named in one message, longest name first."""
    session = index.sparkSession
    one = session.createDataFrame([(0, text)], "text_id int, text string").select(norm_name("text").alias("hay"))
    hay = one.first()["hay"]
    found = (
        _searchable(index)
        .filter(F.lit(hay).contains(F.col("name")))
        .groupBy(F.lit(0).alias("text_id"), "series_id")
        .agg(F.max(F.struct(F.length("name").alias("n"), F.col("popularity"), F.col("name"))).alias("best"))
    )
    return longest_only(found).orderBy(F.length("name").desc(), F.col("popularity").desc(), F.col("name").desc())


def find_series(index: DataFrame, title: str, limit: int = 3) -> DataFrame:
    """Series for one title: equal names before containing ones, then popularity."""
    session = index.sparkSession
    want = session.createDataFrame([(title,)], "t string").select(norm_name("t").alias("t")).first()["t"]
    name = F.col("name")
    if len(want) < MIN_QUERY:
        rank = F.lit(None).cast("int")
    else:
        inside = name.contains(want) | ((F.length(name) >= MIN_NAME_INSIDE) & F.lit(want).contains(name))
        rank = F.when(name == want, 2)
        if len(want) >= MIN_INSIDE_QUERY:
            rank = rank.when(inside, 1)
    hits = index.withColumn("rank", rank).filter(F.col("rank").isNotNull())
    best = hits.groupBy("series_id").agg(F.max(F.struct("rank", "popularity")).alias("best"))
    return best.select("series_id", "best.rank", "best.popularity").orderBy(
        F.col("rank").desc(), F.col("popularity").desc(), "series_id"
    ).limit(int(limit))


def list_series(series: DataFrame, index: DataFrame | None = None, query: str | None = None, limit: int = 50) -> DataFrame:
    """Choice list by popularity, or the series a query names."""
    rows = series.select(
        "series_id", F.coalesce("title_ko", "title").alias("name"), "title", "total_episodes", "poster_url", "popularity"
    )
    if not query:
        return rows.orderBy(F.col("popularity").desc_nulls_last(), "series_id").limit(int(limit))
    matched = find_series(index, query, limit).select("series_id", "rank", F.col("popularity").alias("index_popularity"))
    return rows.join(matched, "series_id").orderBy(F.col("rank").desc(), F.col("index_popularity").desc(), "series_id")


def series_info(series: DataFrame, series_id: str) -> DataFrame:
    return series.filter(F.col("series_id") == series_id).withColumn("name", F.coalesce(F.nullif("title_ko", F.lit("")), "title"))


def episodes_of(episodes: DataFrame, series_id: str, abs_eps: Iterable[int]) -> DataFrame:
    """Names of the asked episodes with their label; no plot text is read."""
    title = F.coalesce(*[F.nullif(c, F.lit("")) for c in ("title_ko", "title_en", "fandom_title")])
    rows = episodes.filter((F.col("series_id") == series_id) & F.col("abs_ep").isin([int(n) for n in abs_eps]))
    return rows.withColumn("label", episode_label(F.col("tmdb_season"), F.col("tmdb_number"), F.col("abs_ep"), title))


def streaming_of(streaming: DataFrame, seasons: DataFrame, series_id: str) -> DataFrame:
    """Providers per season; a nameless season is called by its number."""
    rows = streaming.filter(F.col("series_id") == series_id)
    names = seasons.select("series_id", "tmdb_season", "name_ko")
    # Fixed format of a season name.
    fallback = F.concat(F.col("tmdb_season").cast("string"), F.lit("기"))
    return (
        rows.join(names, ["series_id", "tmdb_season"], "left")
        .select("tmdb_season", F.coalesce("season_name", "name_ko", fallback).alias("name"), F.col("flatrate").alias("providers"), "checked_at", "link")
        .orderBy("tmdb_season")
    )


def cards_of(characters: DataFrame, series_id: str, ids: DataFrame) -> DataFrame:
    return characters.filter(F.col("series_id") == series_id).join(ids.select("char_id").distinct(), "char_id", "left_semi")


def overlap(genres: Column, tags: Column, want_genres: Sequence[str], want_tags: Sequence[str]) -> Column:
    """Twice the genres plus the tags of a row found in the wanted lists, repeated values counted."""
    g, t = ([x.lower() for x in xs] for xs in (want_genres, want_tags))
    count = lambda col, want: F.size(F.filter(col, lambda x: F.lower(x).isin(want))) if want else F.lit(0)
    none = F.array().cast("array<string>")
    return 2 * count(F.coalesce(genres, none), g) + count(F.coalesce(tags, none), t)


def similar_by_tags(
    series: DataFrame,
    entries: DataFrame,
    genres: Sequence[str],
    tags: Sequence[str],
    exclude: DataFrame | None = None,
    limit: int = 30,
) -> DataFrame:
    """Series by overlap of their first entry, then score, then popularity."""
    first = entries.filter(F.col("order_in_series") == 1).select("series_id", "genres", "tags", "average_score")
    rows = series.join(first, "series_id")
    if exclude is not None:
        rows = rows.join(exclude.select("series_id"), "series_id", "left_anti")
    rows = rows.withColumn("overlap", overlap(F.col("genres"), F.col("tags"), genres, tags))
    return rows.orderBy(
        F.col("overlap").desc(),
        F.col("average_score").desc_nulls_last(),
        F.col("popularity").desc_nulls_last(),
        F.col("series_id").asc(),
    ).limit(int(limit))


def first_of_group(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per group; Spark cuts each task to one row per group before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")
