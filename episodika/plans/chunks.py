"""Building the retrievable chunks of seven types, each with its visibility rule in ``abs_ep``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from episodika.functions.text import clean_plot, paragraphs
from episodika.operators.merge import sync_delete, upsert_chunks
from episodika.plans.tidy import tidy

# ---- Fixed values: licenses, kinds of wiki pages, safe sections, layout words and limits ----------------------------
LICENSES = {
    "anilist": ("AniList", "AniList API Terms"),
    "tvmaze": ("TVmaze", "CC BY-SA 4.0"),
    "tmdb": ("TMDB", "TMDB API Terms (비상업, 로고·고지 필요)"),
    "justwatch": ("JustWatch via TMDB", "JustWatch 출처 표기 필수"),
    "jikan": ("MyAnimeList via Jikan", "MyAnimeList 이용약관"),
    "fandom": ("Fandom", "CC BY-SA 3.0"),
}
WIKI_KINDS = {"character": "캐릭터", "ability": "능력·기술", "item": "물건·장비", "location": "장소", "group": "조직·집단"}
SAFE_SECTION = r"(?i)^(appearance|description|overview|characteristics|design)\b"
MIN_PIECE = 80
# -----------------------------------------------------------------------------------------------------------------------

COLUMNS = ["series_id", "seq", "chunk_id", "type", "abs_ep", "tmdb_season", "filler", "text", "sources"]


def source(name: str, url: Column) -> Column:
    shown, license_ = LICENSES[name]
    return F.struct(F.lit(shown).alias("name"), F.lit(license_).alias("license"), url.cast("string").alias("url"))


def _has(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def _lines(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), "\n")


def _listed(label: str, values: Column) -> Column:
    return F.concat(F.lit(label), F.array_join(F.array_distinct(values), ", "))


def _list(c: str, n: int | None = None) -> Column:
    values = F.coalesce(F.col(c), F.array().cast("array<string>"))
    return values if n is None else F.slice(values, 1, n)


def _name() -> Column:
    return F.coalesce(F.nullif("title_ko", F.lit("")), F.col("title"))


def _shape(df: DataFrame, **columns: Column) -> DataFrame:
    none = {"tmdb_season": F.lit(None).cast("int"), "filler": F.lit(None).cast("boolean"), "abs_ep": F.lit(None).cast("int")}
    return df.select(*[{**none, **columns}[c].alias(c) if c in {**none, **columns} else F.col(c) for c in COLUMNS])


def summary_chunks(series: DataFrame, entries: DataFrame, most_listed: int | None = None) -> DataFrame:
    """One introduction per entry; later seasons are visible after the seasons before them."""
    s = series.select(
        "series_id", _name().alias("name"), "overview_ko", "tagline_ko", "alt_titles", "genres_ko", "keywords", "tmdb_id"
    )
    rows = entries.join(s, "series_id")
    first = F.col("order_in_series") == 1
    overview = F.when(first, F.col("overview_ko"))
    year = F.coalesce("year", F.lit(0))
    head = F.concat(F.col("name"), F.lit(" — "), F.col("title"), F.when(year != 0, F.concat(F.lit(" ("), "year", F.lit(")"))).otherwise(F.lit("")))
    english = F.when(_has("title_en"), F.array("title_en")).otherwise(F.array().cast("array<string>"))
    tagged = (F.size(_list("genres")) + F.size(_list("tags")) + F.size(_list("genres_ko"))) > 0
    text = _lines(
        head,
        _listed("다른 이름: ", F.concat(english, _list("alt_titles", most_listed), _list("synonyms", most_listed))),
        F.when(tagged, _listed("장르: ", F.concat(_list("genres_ko"), _list("genres"), _list("tags", most_listed)))),
        F.when(first & (F.size(_list("keywords")) > 0), F.concat(F.lit("키워드: "), F.array_join(_list("keywords", most_listed), ", "))),
        F.when(first, F.col("tagline_ko")),
        overview,
        F.col("description"),
    )
    told = _has("description") | (F.size(_list("synonyms")) > 0) | (F.coalesce(overview, F.lit("")) != "")
    by_id = source("anilist", F.when(F.col("id_a").isNotNull(), F.concat(F.lit("https://anilist.co/anime/"), "id_a")))
    shown = source("tmdb", F.concat(F.lit("https://www.themoviedb.org/tv/"), "tmdb_id"))
    return _shape(
        rows.filter(told),
        seq=F.col("order_in_series").cast("long"),
        chunk_id=F.concat("series_id", F.lit(":summary:"), "entry_key"),
        type=F.lit("summary"),
        abs_ep=F.when(~first, F.col("abs_offset")).cast("int"),
        tmdb_season=F.col("tmdb_season"),
        text=text,
        sources=F.when(F.coalesce(overview, F.lit("")) != "", F.array(by_id, shown)).otherwise(F.array(by_id)),
    )


def character_chunks(series: DataFrame, characters: DataFrame, entries: DataFrame) -> DataFrame:
    """Visible from the debut if it is known and not the first episode, else from the start of the first season seen in."""
    s = series.select("series_id", _name().alias("show"))
    e = entries.select(F.col("entry_key").alias("first_entry"), "abs_offset")
    rows = characters.filter(F.col("description").isNotNull()).join(e, "first_entry").join(s, "series_id")
    debut = F.nullif("first_abs_ep", F.lit(0))
    visible = F.when(debut.isNotNull(), F.when(debut > 1, debut)).otherwise(F.nullif("abs_offset", F.lit(0)))
    native = F.when(_has("name_native"), F.concat(F.lit(" ("), "name_native", F.lit(")"))).otherwise(F.lit(""))
    return _shape(
        rows,
        seq=F.lit(1_000_000_000) + F.col("char_id"),
        chunk_id=F.concat("series_id", F.lit(":char:"), "char_id"),
        type=F.lit("character"),
        abs_ep=visible.cast("int"),
        text=F.concat("show", F.lit(" 캐릭터 "), "name", native, F.lit(" ["), "role", F.lit("]\n"), "description"),
        sources=F.array(source("anilist", F.concat(F.lit("https://anilist.co/character/"), "char_id"))),
    )


def episode_heads(series: DataFrame, episodes: DataFrame) -> DataFrame:
    s = series.select("series_id", _name().alias("show"), "tmdb_id")
    rows = episodes.join(s, "series_id")
    season = F.when(
        F.coalesce("tmdb_season", F.lit(0)) != 0, F.format_string("%d기 %d화 ", "tmdb_season", "tmdb_number")
    ).otherwise(F.lit(""))
    title = F.coalesce(*[F.nullif(c, F.lit("")) for c in ("title_ko", "title_en", "fandom_title")])
    rows = rows.withColumn("head", F.concat("show", F.lit(" "), season, F.format_string("(전체 %d화)", "abs_ep")))
    mark = F.when(title.isNotNull(), F.concat(F.lit(" 〈"), title, F.lit("〉"))).otherwise(F.lit(""))
    return rows.withColumn("titled", F.concat("head", mark))


def episode_chunks(rows: DataFrame) -> DataFrame:
    """Titles and short summaries of an episode, equal lines once."""
    english = F.coalesce(F.nullif("summary_en", F.lit("")), F.col("overview_en"))
    second = F.coalesce(F.nullif("title_en", F.lit("")), F.col("fandom_title"))
    parts = F.array("head", "title_ko", second, "overview_ko", english, "synopsis_en")
    text = F.array_join(F.array_distinct(F.filter(parts, lambda x: x.isNotNull() & (x != ""))), "\n")
    tmdb = _has("overview_ko") | (_has("overview_en") & ~_has("summary_en"))
    sources = F.array_compact(
        F.array(
            F.when(_has("summary_en"), source("tvmaze", F.col("tvmaze_url"))),
            F.when(tmdb, source("tmdb", F.concat(F.lit("https://www.themoviedb.org/tv/"), "tmdb_id"))),
            F.when(_has("synopsis_en"), source("fandom", F.col("fandom_url"))),
        )
    )
    return _shape(
        rows.filter(_has("overview_ko") | (F.coalesce(english, F.lit("")) != "") | _has("synopsis_en")),
        seq=F.lit(2_000_000_000_000) + F.col("abs_ep").cast("long") * 1_000_000,
        chunk_id=F.concat("series_id", F.lit(":ep:"), "abs_ep"),
        type=F.lit("episode"), abs_ep=F.col("abs_ep"), tmdb_season=F.col("tmdb_season"), filler=F.col("filler"),
        text=text, sources=sources,
    )


def plot_chunks(rows: DataFrame) -> DataFrame:
    """The plot in two sizes out of one pass: whole (``plot``) and in pieces of about 700 characters (``event``)."""
    # exploded from an array of one, so that the filter is not pushed under it, and under a shuffle, and the plot cleaned twice
    plots = rows.withColumn("_plot", F.explode(F.array(clean_plot("plot")))).filter(F.col("_plot") != "")
    whole = F.array(F.struct(F.lit("plot").alias("type"), F.lit(0).alias("i"), F.col("_plot").alias("body")))
    scenes = F.transform(paragraphs("_plot"), lambda p, i: F.struct(F.lit("event").alias("type"), (i + 1).alias("i"), p.alias("body")))
    each = plots.withColumn("c", F.explode(F.concat(whole, scenes)))
    is_plot = F.col("c.type") == "plot"
    return _shape(
        each,
        seq=F.lit(2_000_000_000_000) + F.col("abs_ep").cast("long") * 1_000_000 + F.lit(1) + F.col("c.i"),
        chunk_id=F.when(is_plot, F.concat("series_id", F.lit(":plot:"), "abs_ep")).otherwise(
            F.concat("series_id", F.lit(":event:"), "abs_ep", F.lit(":"), F.col("c.i"))
        ),
        type=F.col("c.type"), abs_ep=F.col("abs_ep"), tmdb_season=F.col("tmdb_season"), filler=F.col("filler"),
        text=F.concat("titled", F.when(is_plot, " 줄거리\n").otherwise(" 장면\n"), F.col("c.body")),
        sources=F.array(source("fandom", F.col("fandom_url"))),
    )


def streaming_chunks(series: DataFrame, streaming: DataFrame) -> DataFrame:
    s = series.select("series_id", _name().alias("show"))
    rows = streaming.filter(F.size(_list("flatrate")) > 0).join(s, "series_id")
    season = F.coalesce(F.nullif("season_name", F.lit("")), F.concat(F.col("tmdb_season").cast("string"), F.lit("기")))
    return _shape(
        rows,
        seq=F.lit(4_000_000_000_000_000) + F.col("tmdb_season"),
        chunk_id=F.concat("series_id", F.lit(":streaming:s"), "tmdb_season"),
        type=F.lit("streaming"), tmdb_season=F.col("tmdb_season"),
        text=F.concat("show", F.lit(" "), season, F.lit(" 국내 시청처: "), F.array_join("flatrate", ", "), F.lit(" (확인일 "), F.col("checked_at").cast("string"), F.lit(")")),
        sources=F.array(source("justwatch", F.col("link"))),
    )


def _page_key(title: Column) -> Column:
    return F.lower(F.trim(F.replace(title, F.lit("_"), F.lit(" "))))


def wiki_chunks(series: DataFrame, wikis: DataFrame, episodes: DataFrame, pages: DataFrame, most_pieces: int | None = None) -> DataFrame:
    """Characters and terms of the wiki, from the episode whose page first links them; pages nobody links stay out.

    ``wikis``: series_id, wiki. ``pages``: wiki, title, kind, sections array<struct<title,text>>, links. ``most_pieces`` keeps the first pieces
    of a page only; None keeps all.
    """
    owned = episodes.filter(F.col("fandom_url").isNotNull()).select(
        "series_id", "abs_ep", F.replace(F.split_part("fandom_url", F.lit("/wiki/"), F.lit(2)), F.lit("_"), F.lit(" ")).alias("title")
    )
    linked = owned.join(wikis, "series_id").join(pages.select("wiki", "title", "links"), ["wiki", "title"])
    debut = (
        linked.select("series_id", "wiki", "abs_ep", F.explode("links").alias("link"))
        .groupBy("series_id", "wiki", _page_key(F.col("link")).alias("key"))
        .agg(F.min("abs_ep").alias("debut"))
    )
    kinds = pages.filter(F.col("kind").isin(*WIKI_KINDS)).withColumn("key", _page_key(F.col("title")))
    rows = kinds.join(debut, ["wiki", "key"]).join(series.select("series_id", _name().alias("show")), "series_id")
    safe = F.filter(
        "sections", lambda x: x["title"].rlike(SAFE_SECTION) | ((x["title"] == "_lead") & (F.col("kind") != "character"))
    )
    cut = F.flatten(F.transform(safe, lambda x: F.transform(paragraphs(x["text"]), lambda p: F.struct(x["title"].alias("section"), p.alias("body")))))
    rows = rows.select("*", F.posexplode(cut if most_pieces is None else F.slice(cut, 1, most_pieces)).alias("i", "piece")).filter(F.length("piece.body") >= MIN_PIECE)
    kind_name = F.create_map(*[F.lit(x) for pair in WIKI_KINDS.items() for x in pair])[F.col("kind")]
    section = F.when(F.col("piece.section") == "_lead", "").otherwise(F.concat(F.lit(" — "), F.col("piece.section")))
    url = F.concat(F.lit("https://"), "wiki", F.lit(".fandom.com/wiki/"), F.replace("title", F.lit(" "), F.lit("_")))
    return _shape(
        rows,
        seq=F.lit(5_000_000_000_000_000) + F.abs(F.xxhash64("title") % 1_000_000_000_000) * 1_000 + F.least("i", F.lit(999)),
        chunk_id=F.concat("series_id", F.lit(":wiki:"), "title", F.lit(":"), F.col("i") + 1),
        type=F.when(F.col("kind") == "character", "character").otherwise("terminology"),
        abs_ep=F.when(F.col("debut") > 1, F.col("debut")).cast("int"),
        text=F.concat("show", F.lit(" "), kind_name, F.lit(" "), "title", section, F.lit("\n"), F.col("piece.body")),
        sources=F.array(source("fandom", url)),
    )


def build_chunks(
    series: DataFrame,
    entries: DataFrame,
    characters: DataFrame,
    episodes: DataFrame,
    streaming: DataFrame,
    wikis: DataFrame | None = None,
    pages: DataFrame | None = None,
    most_listed: int | None = None,
    most_pieces: int | None = None,
) -> DataFrame:
    """All chunks of all series, tidied. ``most_listed`` and ``most_pieces`` shorten lists of names and wiki pages; None keeps all."""
    heads = episode_heads(series, episodes)
    parts = [
        summary_chunks(series, entries, most_listed),
        character_chunks(series, characters, entries),
        episode_chunks(heads),
        plot_chunks(heads),
        streaming_chunks(series, streaming),
    ]
    if wikis is not None and pages is not None:
        parts.append(wiki_chunks(series, wikis, episodes, pages, most_pieces))
    return tidy(reduce(DataFrame.unionByName, parts)).drop("seq")


def refresh(stored: DataFrame, built: DataFrame) -> DataFrame:
    """Stored chunks after a rebuild: vanished ones deleted, changed texts lose their vector, the rest keeps it."""
    kept = sync_delete(stored, built, "chunk_id", "series_id")
    return upsert_chunks(kept, built)
