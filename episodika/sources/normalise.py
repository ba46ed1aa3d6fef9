"""Landed JSON of the outside sources as rows of the stored tables: nested schemas are declared, nothing is inferred.

Choices inside one document - the most present cast, the best trailer, a person's main role - are made inside its arrays, so
credits never leave their row to be sorted. A body that is no JSON gives NULL and no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from episodika.functions.text import as_date, clean_html, image_url, names_of, strip

# ---- Fixed values: fields of the sources, preferred countries, languages and picture sizes ---------------------------
_NAMED = "array<struct<name:string>>"
SHOW = (
    "name string, original_name string, overview string, tagline string, poster_path string, backdrop_path string, first_air_date string, last_air_date string, "
    "vote_average double, vote_count int, homepage string, origin_country array<string>, genres " + _NAMED + ", networks " + _NAMED + ", production_companies " + _NAMED + ", "
    "keywords struct<results:" + _NAMED + ">, alternative_titles struct<results:array<struct<iso_3166_1:string,title:string>>>, "
    "content_ratings struct<results:array<struct<iso_3166_1:string,rating:string>>>, external_ids struct<imdb_id:string>, "
    "videos struct<results:array<struct<key:string,site:string,type:string,iso_639_1:string,official:boolean>>>, "
    "aggregate_credits struct<cast:array<struct<id:bigint,name:string,profile_path:string,total_episode_count:int,roles:array<struct<character:string,episode_count:int>>>>>, "
    "seasons array<struct<season_number:int,name:string,overview:string,air_date:string,poster_path:string,episode_count:int>>"
)
SEASON = (
    "name string, overview string, air_date string, poster_path string, episodes array<struct<episode_number:int,name:string,overview:string,air_date:string,"
    "still_path:string,runtime:int,vote_average:double>>"
)
PROVIDERS = "results map<string,struct<link:string,flatrate:array<struct<provider_name:string>>>>"
EPISODES = "array<struct<season:int,number:int,type:string,name:string,airdate:string,summary:string,url:string>>"
EDGES = (
    "data struct<Media:struct<characters:struct<edges:array<struct<role:string,node:struct<id:bigint,gender:string,name:struct<full:string,native:string>,"
    "image:struct<large:string>,description:string>>>>>>"
)
MEDIA = (
    "data struct<Page:struct<media:array<struct<id:bigint,popularity:int,averageScore:int,genres:array<string>,title:struct<english:string,native:string>,"
    "coverImage:struct<large:string>,description:string,status:string,nextAiringEpisode:struct<airingAt:bigint>,"
    "recommendations:struct<nodes:array<struct<rating:int,mediaRecommendation:struct<id:bigint>>>>>>>>"
)
TITLE_COUNTRIES, RATING_COUNTRY, LANGUAGE = ("KR", "JP", "US"), "KR", "ko"
VOICE = " (voice)"
MOST_TITLES, MOST_CAST = 20, 40
# --------------------------------------------------------------------------------------------------------------------


def _listed(items: Column, kind: str) -> Column:
    return F.coalesce(items, F.array().cast(kind))


def _text(value: Column) -> Column:
    """Without blanks around it; NULL when nothing is left."""
    return F.nullif(strip(F.coalesce(value, F.lit(""))), F.lit(""))


def _first(items: Column, fits) -> Column:
    return F.get(F.filter(items, fits), F.lit(0))


def parsed(raw: DataFrame, schema: str, body: str = "body") -> DataFrame:
    """``raw`` with its JSON text replaced by ``doc``."""
    return raw.withColumn("doc", F.from_json(body, schema)).drop(body)


def best_video(videos: Column, site: str = "YouTube") -> Column:
    """Key of the first trailer in the preferred language that is official, as far as there is one, in that order; NULL without any video."""
    own = F.filter(videos, lambda v: v["site"] == site)
    ranked = F.transform(
        own, lambda v, i: F.struct(
            (F.coalesce(v["type"], F.lit("")) != "Trailer").alias("other"), (F.coalesce(v["iso_639_1"], F.lit("")) != LANGUAGE).alias("foreign"),
            (~F.coalesce(v["official"], F.lit(False))).alias("unofficial"), i.alias("place"), v["key"].alias("key"),
        )
    )
    return F.array_min(ranked)["key"]


def show_details(shows: DataFrame, most_titles: int | None = MOST_TITLES) -> DataFrame:
    """Columns of ``series`` from (series_id, doc) of ``SHOW``."""
    d = lambda name: F.col(f"doc.{name}")
    titles = F.array_distinct(F.transform(
        F.filter(_listed(d("alternative_titles.results"), "array<struct<iso_3166_1:string,title:string>>"), lambda t: t["iso_3166_1"].isin(*TITLE_COUNTRIES) & (F.coalesce(t["title"], F.lit("")) != "")),
        lambda t: t["title"],
    ))
    rating = _first(d("content_ratings.results"), lambda r: (r["iso_3166_1"] == RATING_COUNTRY) & (F.coalesce(r["rating"], F.lit("")) != ""))["rating"]
    video = best_video(d("videos.results"))
    return shows.select(
        "series_id", d("name").alias("title_ko"), d("original_name").alias("title_original"), _text(d("overview")).alias("overview_ko"), _text(d("tagline")).alias("tagline_ko"),
        image_url(d("poster_path"), "w500").alias("poster_url"), image_url(d("backdrop_path"), "w1280").alias("backdrop_url"), names_of(_listed(d("genres"), _NAMED)).alias("genres_ko"),
        names_of(_listed(d("keywords.results"), _NAMED)).alias("keywords"), (titles if most_titles is None else F.slice(titles, 1, most_titles)).alias("alt_titles"),
        as_date(d("first_air_date")).alias("first_air_date"), as_date(d("last_air_date")).alias("last_air_date"), F.nullif(d("vote_average"), F.lit(0.0)).alias("vote_average"),
        d("vote_count").alias("vote_count"), rating.alias("content_rating_kr"), F.when(video.isNotNull(), F.concat(F.lit("https://www.youtube.com/watch?v="), video)).alias("trailer_url"),
        names_of(_listed(d("networks"), _NAMED)).alias("networks"), names_of(_listed(d("production_companies"), _NAMED)).alias("studios"),
        _listed(d("origin_country"), "array<string>").alias("origin_country"), F.nullif(d("homepage"), F.lit("")).alias("homepage"), d("external_ids.imdb_id").alias("imdb_id"),
    )


def voice_cast(shows: DataFrame, most: int | None = MOST_CAST) -> DataFrame:
    """series_id, person, name, character, episode_count, profile_url: the cast with the most episodes, in the source's order where equal.

    A person's character is that of the role with the most episodes, the first of equal ones. ``most`` None keeps the whole cast.
    """
    count = lambda c: F.coalesce(c, F.lit(0))
    ranked = F.array_sort(F.transform("doc.aggregate_credits.cast", lambda c, i: F.struct((-count(c["total_episode_count"])).alias("less"), i.alias("place"), c.alias("c"))))
    chosen = ranked if most is None else F.slice(ranked, 1, most)
    rows = shows.select("series_id", F.explode(chosen).alias("x")).select("series_id", "x.place", "x.c.*")
    roles = F.transform("roles", lambda r, i: F.struct((-count(r["episode_count"])).alias("less"), i.alias("place"), r["character"].alias("character")))
    character = F.replace(F.array_min(roles)["character"], F.lit(VOICE), F.lit(""))
    # a person named twice keeps the first row
    first = rows.groupBy("series_id", F.col("id").alias("person")).agg(F.min(F.struct(
        (-count(F.col("total_episode_count"))).alias("less"), "place", "name", F.nullif(character, F.lit("")).alias("character"),
        F.col("total_episode_count").alias("episode_count"), image_url("profile_path", "w185").alias("profile_url"),
    )).alias("r"))
    return first.select("series_id", "person", "r.name", "r.character", "r.episode_count", "r.profile_url")


def seasons(shows: DataFrame, bodies: DataFrame) -> DataFrame:
    """Rows of ``seasons``: what the show lists, each filled from its own document (series_id, season, doc of ``SEASON``) first."""
    listed = shows.select("series_id", F.explode("doc.seasons").alias("m")).select("series_id", F.col("m.season_number").alias("season"), "m").filter("season > 0")
    rows = listed.join(bodies, ["series_id", "season"], "left")
    both = lambda name: F.coalesce(F.nullif(F.col(f"doc.{name}"), F.lit("")), F.col(f"m.{name}"))
    episodes = F.nullif(F.coalesce(F.size("doc.episodes"), F.lit(0)), F.lit(0))
    return rows.select(
        "series_id", F.col("season").alias("tmdb_season"), both("name").alias("name_ko"), _text(both("overview")).alias("overview_ko"), as_date(both("air_date")).alias("air_date"),
        image_url(both("poster_path"), "w500").alias("poster_url"), F.coalesce(F.when(episodes > 0, episodes), F.col("m.episode_count")).alias("episode_count"),
    )


def _episodes(bodies: DataFrame, name: str) -> DataFrame:
    """series_id, season, number and ``name``, a struct of the episode; of several with one number the last in the list."""
    rows = bodies.select("series_id", "season", F.posexplode_outer("doc.episodes").alias("place", "e")).filter("e IS NOT NULL")
    return rows.groupBy("series_id", "season", F.col("e.episode_number").alias("number")).agg(F.max_by("e", "place").alias(name))


def bilingual_episodes(first: DataFrame, second: DataFrame) -> DataFrame:
    """Episodes of both languages' season documents (series_id, season, doc), joined on their number; either side may lack one or all.

    series_id, season, number, title_ko, title_en, overview_ko, overview_en, airdate, still_url, runtime, rating.
    """
    rows = _episodes(first, "a").join(_episodes(second, "b"), ["series_id", "season", "number"], "full")
    either = lambda name: F.coalesce(f"a.{name}", f"b.{name}")
    return rows.select(
        "series_id", "season", "number", F.col("a.name").alias("title_ko"), F.nullif(F.col("b.name"), F.lit("")).alias("title_en"), _text(F.col("a.overview")).alias("overview_ko"),
        _text(F.col("b.overview")).alias("overview_en"), as_date(either("air_date")).alias("airdate"), image_url(either("still_path"), "w300").alias("still_url"),
        either("runtime").alias("runtime"), F.nullif(either("vote_average"), F.lit(0.0)).alias("rating"),
    )


def providers(bodies: DataFrame, country: str = RATING_COUNTRY) -> DataFrame:
    """series_id, season, flatrate, link: where a season can be watched in one country."""
    own = F.try_element_at("doc.results", F.lit(country))
    names = F.transform(_listed(own["flatrate"], "array<struct<provider_name:string>>"), lambda p: p["provider_name"])
    return bodies.select("series_id", "season", names.alias("flatrate"), own["link"].alias("link"))


def regular_episodes(lists: DataFrame) -> DataFrame:
    """Regular, numbered episodes of (series_id, doc of ``EPISODES``) with ``place``, their order by season and number."""
    kept = F.filter("doc", lambda e: (F.coalesce(e["type"], F.lit("regular")) == "regular") & (F.coalesce(e["number"], F.lit(0)) != 0))
    ordered = F.array_sort(F.transform(kept, lambda e, i: F.struct(e["season"].alias("season"), e["number"].alias("number"), i.alias("i"), e.alias("e"))))
    rows = lists.select("series_id", F.posexplode(ordered).alias("place", "x"))
    return rows.select(
        "series_id", "place", "x.season", "x.number", F.col("x.e.name").alias("title_en"), as_date(F.col("x.e.airdate")).alias("airdate"),
        F.nullif(clean_html("x.e.summary"), F.lit("")).alias("summary_en"), F.col("x.e.url").alias("tvmaze_url"),
    )


def characters(pages: DataFrame) -> DataFrame:
    """Rows of ``characters`` from (series_id, order_in_series, entry_key, doc of ``EDGES``), as if entries were read in order.

    The first entry that names a character stays its first; a main role is never lost, other roles and the picture are the last entry's, a
    description the last that there is.
    """
    rows = pages.select("series_id", "order_in_series", "entry_key", F.posexplode("doc.data.Media.characters.edges").alias("i", "e"))
    at, text = F.struct("order_in_series", "i"), F.nullif(clean_html("e.node.description"), F.lit(""))
    rows = rows.select("series_id", F.col("e.node.id").alias("char_id"), "entry_key", "e", at.alias("at"), text.alias("text"))
    last = lambda value: F.max_by(value, "at")
    return rows.groupBy("series_id", "char_id").agg(
        F.min_by("e.node.name.full", "at").alias("name"), F.min_by("e.node.name.native", "at").alias("name_native"),
        F.when(F.bool_or(F.coalesce(F.col("e.role") == "MAIN", F.lit(False))), "MAIN").otherwise(last("e.role")).alias("role"), F.min_by("e.node.gender", "at").alias("gender"),
        last("e.node.image.large").alias("image_url"), F.max_by("text", F.when(F.col("text").isNotNull(), F.col("at"))).alias("description"), F.min_by("entry_key", "at").alias("first_entry"),
    )


def media_details(pages: DataFrame) -> DataFrame:
    """Facts about entries from (doc of ``MEDIA``): id, popularity, genres, titles, status, ``next_episode_at``, recommendations with a rating above 0."""
    rows = pages.select(F.explode("doc.data.Page.media").alias("m"))
    good = F.filter("m.recommendations.nodes", lambda n: n["mediaRecommendation"]["id"].isNotNull() & (F.coalesce(n["rating"], F.lit(0)) > 0))
    return rows.select(
        "m.id", F.coalesce("m.popularity", F.lit(0)).alias("popularity"), F.col("m.averageScore").alias("average_score"), _listed(F.col("m.genres"), "array<string>").alias("genres"),
        F.col("m.title.english").alias("title_en"), F.col("m.title.native").alias("title_native"), F.col("m.coverImage.large").alias("cover_url"),
        clean_html("m.description").alias("description"), F.col("m.status").alias("airing_status"), F.timestamp_seconds("m.nextAiringEpisode.airingAt").alias("next_episode_at"),
        _listed(F.transform(good, lambda n: n["mediaRecommendation"]["id"]), "array<bigint>").alias("recommendations"),
    )


def ids_of_series(entries: DataFrame) -> DataFrame:
    """series_id, ids: all entry keys, then all ids of the second system with its prefix; an entry without one leaves a NULL in its place.

    NULLs stay: each is wrapped, as a collected list drops them bare.
    """
    order = F.coalesce("order_in_series", F.lit(0))
    second = F.when(F.col("id_b").isNotNull(), F.concat(F.lit("mal:"), "id_b"))
    rows = entries.groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), "entry_key", second.alias("second")))).alias("x"))
    return rows.select("series_id", F.concat(F.transform("x", lambda v: v["entry_key"]), F.transform("x", lambda v: v["second"])).alias("ids"))
