"""Columns, keys and value checks of the stored tables.

Spark does not enforce keys; ``episodika.sources.tables.violations`` reports what breaks them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession, types as T

SOURCES = "array<struct<name:string,license:string,url:string>>"


@dataclass(frozen=True)
class TableSpec:
    columns: str
    keys: tuple[str, ...]
    not_null: tuple[str, ...] = ()
    checks: dict[str, str] = field(default_factory=dict)
    partition_by: tuple[str, ...] = ()
    sort_by: tuple[str, ...] = ()


# The data model.
TABLES = {
    "series": TableSpec(
        "series_id string, title string, title_ko string, title_original string, alt_titles array<string>, tmdb_id bigint, "
        "tvdb_id bigint, tvmaze_id bigint, total_episodes int, popularity int, status string, next_episode_at timestamp, "
        "overview_ko string, tagline_ko string, poster_url string, genres_ko array<string>, keywords array<string>, "
        "first_air_date date, last_air_date date, vote_average float, vote_count int",
        ("series_id",), ("series_id", "title"),
    ),
    "entries": TableSpec(
        "entry_key string, series_id string, order_in_series int, abs_offset int, id_a bigint, id_b bigint, type string, "
        "status string, title string, title_en string, title_native string, synonyms array<string>, tags array<string>, "
        "genres array<string>, year int, season_of_year string, episodes int, tmdb_season int, tmdb_offset int, "
        "tvdb_season int, tvdb_offset int, popularity int, average_score int, airing_status string, "
        "next_episode_at timestamp, description string, recommendations array<int>",
        ("entry_key",), ("series_id", "order_in_series", "abs_offset"), sort_by=("series_id", "order_in_series"),
    ),
    "episodes": TableSpec(
        "series_id string, abs_ep int, entry_key string, entry_ep int, tmdb_season int, tmdb_number int, title_ko string, "
        "title_en string, fandom_title string, airdate date, overview_ko string, overview_en string, summary_en string, "
        "synopsis_en string, plot string, filler boolean, recap boolean, arc string, chapters string, "
        "characters array<string>, fandom_url string, tvmaze_url string, still_url string, runtime int, rating float",
        ("series_id", "abs_ep"), ("series_id", "abs_ep"), {"abs_ep from 1": "abs_ep >= 1"}, sort_by=("series_id", "abs_ep"),
    ),
    "characters": TableSpec(
        "series_id string, char_id bigint, name string, name_native string, role string, gender string, image_url string, "
        "description string, first_entry string, first_abs_ep int",
        ("series_id", "char_id"), ("name",),
    ),
    "streaming": TableSpec(
        "series_id string, tmdb_season int, season_name string, flatrate array<string>, link string, checked_at date",
        ("series_id", "tmdb_season"),
    ),
    "seasons": TableSpec(
        "series_id string, tmdb_season int, name_ko string, overview_ko string, air_date date, poster_url string, episode_count int",
        ("series_id", "tmdb_season"),
    ),
    "voice_cast": TableSpec(
        "series_id string, tmdb_person bigint, name string, character string, episode_count int, profile_url string",
        ("series_id", "tmdb_person"),
    ),
    "wiki_pages": TableSpec(
        "wiki string, title string, kind string, infobox_name string, infobox map<string,string>, "
        "sections array<struct<title:string,text:string>>, links array<string>, wikitext string, fetched_at timestamp",
        ("wiki", "title"), ("kind",), sort_by=("wiki", "title"),
    ),
    "chunks": TableSpec(
        f"chunk_id string, series_id string, type string, abs_ep int, tmdb_season int, filler boolean, text string, "
        f"sources {SOURCES}, embedding array<float>",
        ("chunk_id",), ("series_id", "type", "text"),
        {
            "known type": "type IN ('summary', 'character', 'terminology', 'episode', 'plot', 'event', 'streaming')",
            "abs_ep from 1": "abs_ep >= 1",
        },
        partition_by=("type",), sort_by=("series_id", "abs_ep"),
    ),
    "fetch_log": TableSpec(
        "series_id string, source string, status string, detail string, fetched_at timestamp",
        ("series_id", "source"), ("status",), {"known status": "status IN ('ok', 'empty', 'error')"},
    ),
    "raw": TableSpec("source string, key string, data string, fetched_at timestamp", ("source", "key")),
    "watch_records": TableSpec(
        "user_id string, series_id string, seen_ep int, rating float, updated_at timestamp",
        ("user_id", "series_id"), ("seen_ep", "updated_at"),
        {"seen_ep from 0": "seen_ep >= 0", "rating in range": "rating BETWEEN 0.5 AND 5"},
    ),
}


def schema_of(spark: SparkSession, name: str) -> T.StructType:
    return spark.createDataFrame([], TABLES[name].columns).schema
