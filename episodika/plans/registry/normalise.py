"""Nested JSON made of the tables, read back by the source normalisers."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodika.plans.derived import table
from episodika.plans.registry.base import query
from episodika.sources import normalise as n


def as_json(df, keys, **fields):
    """(keys, body): one JSON text per row, NULL fields left out as sources do."""
    return df.select(*keys, F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])).alias("body"))


def season_bodies(spark, sf_dir, language):
    """Lines as episodes: the supplier's line numbers are its seasons. Some episodes exist in one language only, season 7 has no English document."""
    line = table(spark, sf_dir, "lineitem")
    korean = language == "ko"
    own = line.filter("l_orderkey % 3 <> 0" if korean else "l_orderkey % 4 <> 0 AND l_linenumber <> 7")
    text = F.when(F.col("l_orderkey") % 5 != 0, F.concat(F.lit(f" {language} "), F.col("l_partkey").cast("string"), F.lit(" ")))
    name = F.concat(F.lit(f"{language}-"), "l_orderkey") if korean else F.when(F.col("l_orderkey") % 7 != 0, F.concat(F.lit("en-"), "l_orderkey")).otherwise("")
    # the first fields only order the list: of two episodes with one number the last counts
    episode = F.struct(
        "l_orderkey", "l_partkey", "l_quantity", F.col("l_shipdate").alias("day"), F.col("l_orderkey").cast("int").alias("episode_number"), name.alias("name"), text.alias("overview"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("air_date"),
        F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("/p"), "l_partkey")).alias("still_path"), F.col("l_quantity").cast("int").alias("runtime"), (F.col("l_quantity") - 1).alias("vote_average"),
    )
    rows = own.groupBy(F.col("l_suppkey").alias("series_id"), F.col("l_linenumber").alias("season")).agg(F.sort_array(F.collect_list(episode)).alias("episodes"))
    return n.parsed(as_json(rows, ["series_id", "season"], name=F.lit(f"{language} season"), episodes=F.col("episodes")), n.SEASON)


@query(
    "show_seasons_bilingual",
    """SELECT l_suppkey AS series_id, l_linenumber AS season, CAST(l_orderkey AS INTEGER) AS number, CASE WHEN ko THEN 'ko-' || l_orderkey END AS title_ko,
      CASE WHEN en AND l_orderkey % 7 <> 0 THEN 'en-' || l_orderkey END AS title_en, CASE WHEN ko AND l_orderkey % 5 <> 0 THEN 'ko ' || l_partkey END AS overview_ko,
      CASE WHEN en AND l_orderkey % 5 <> 0 THEN 'en ' || l_partkey END AS overview_en, CAST(l_shipdate AS DATE) AS airdate,
      CASE WHEN l_partkey % 2 = 0 THEN 'https://image.tmdb.org/t/p/w300/p' || l_partkey END AS still_url, CAST(l_quantity AS INTEGER) AS runtime, nullif(l_quantity - 1, 0) AS rating
    FROM (SELECT *, l_orderkey % 3 <> 0 AS ko, l_orderkey % 4 <> 0 AND l_linenumber <> 7 AS en FROM lineitem
      QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_linenumber, l_orderkey ORDER BY l_partkey DESC, l_quantity DESC, l_shipdate DESC) = 1) WHERE ko OR en""",
)
def show_seasons_bilingual(spark, sf_dir):
    return n.bilingual_episodes(season_bodies(spark, sf_dir, "ko"), season_bodies(spark, sf_dir, "en"))


def shows(spark, sf_dir):
    """Suppliers as shows whose cast are parts; each return flag of a part is a role."""
    line = table(spark, sf_dir, "lineitem")
    roles = line.groupBy("l_suppkey", "l_partkey", "l_returnflag").agg(F.count("*").cast("int").alias("episode_count"))
    role = F.struct("l_returnflag", F.concat(F.lit("Role "), "l_returnflag", F.lit(" (voice)")).alias("character"), "episode_count")
    people = roles.groupBy("l_suppkey", "l_partkey").agg(F.sort_array(F.collect_list(role)).alias("roles"), F.sum("episode_count").cast("int").alias("total_episode_count"))
    person = F.struct(
        F.col("l_partkey").alias("id"), F.concat(F.lit("Person "), "l_partkey").alias("name"), F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("/f"), "l_partkey")).alias("profile_path"),
        "total_episode_count", F.transform("roles", lambda r: F.struct(r["character"].alias("character"), r["episode_count"].alias("episode_count"))).alias("roles"),
    )
    cast = people.groupBy("l_suppkey").agg(F.sort_array(F.collect_list(person)).alias("cast"))
    return n.parsed(as_json(cast, [F.col("l_suppkey").alias("series_id")], name=F.lit("Show"), aggregate_credits=F.struct("cast")), n.SHOW)


@query(
    "top_cast_roles",
    """WITH r AS (SELECT l_suppkey, l_partkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2, 3),
    p AS (SELECT l_suppkey, l_partkey, sum(n) AS total, arg_min('Role ' || l_returnflag, (-n, l_returnflag)) AS role FROM r GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY total DESC, l_partkey) AS place FROM p)
    SELECT l_suppkey AS series_id, l_partkey AS person, 'Person ' || l_partkey AS name, role AS character, CAST(total AS INTEGER) AS episode_count,
      CASE WHEN l_partkey % 3 = 0 THEN 'https://image.tmdb.org/t/p/w185/f' || l_partkey END AS profile_url FROM k WHERE place <= 40""",
)
def top_cast_roles(spark, sf_dir):
    return n.voice_cast(shows(spark, sf_dir))


@query(
    "trailer_choice",
    """WITH v AS (SELECT user_id, event_id, event_type <> 'click' AS tube, event_type = 'purchase' AS trailer, event_id % 3 = 0 AS korean, event_id % 4 = 0 AS official FROM events),
    b AS (SELECT user_id, arg_min(event_id, (NOT trailer, NOT korean, NOT official, event_id)) AS best FROM v WHERE tube GROUP BY 1)
    SELECT u.user_id AS series_id, 'https://www.youtube.com/watch?v=v' || best AS trailer_url FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN b ON b.user_id = u.user_id""",
)
def trailer_choice(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    video = F.struct(
        "event_id", F.concat(F.lit("v"), "event_id").alias("key"), F.when(F.col("event_type") == "click", "Vimeo").otherwise("YouTube").alias("site"),
        F.when(F.col("event_type") == "purchase", "Trailer").otherwise("Clip").alias("type"), F.when(F.col("event_id") % 3 == 0, "ko").when(F.col("event_id") % 3 == 1, "en").alias("iso_639_1"),
        (F.col("event_id") % 4 == 0).alias("official"),
    )
    per = e.groupBy(F.col("user_id").alias("series_id")).agg(F.sort_array(F.collect_list(video)).alias("results"))
    docs = n.parsed(as_json(per, ["series_id"], videos=F.struct("results")), n.SHOW)
    return n.show_details(docs).select("series_id", "trailer_url")


@query(
    "regular_episode_order",
    """WITH e AS (SELECT l_suppkey AS series_id, l_linenumber AS season, CAST(l_orderkey % 50 AS INTEGER) AS number, l_orderkey, l_partkey FROM lineitem
      WHERE l_returnflag <> 'A' AND l_orderkey % 50 <> 0)
    SELECT series_id, CAST(row_number() OVER (PARTITION BY series_id ORDER BY season, number, l_orderkey, l_partkey) - 1 AS INTEGER) AS place, season, number,
      'Ep ' || l_orderkey AS title_en, 'About ' || l_partkey || ' & more' AS summary_en FROM e""",
)
def regular_episode_order(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    episode = F.struct(
        "l_orderkey", "l_partkey", F.col("l_linenumber").alias("season"), F.when(F.col("l_orderkey") % 50 != 0, (F.col("l_orderkey") % 50).cast("int")).alias("number"),
        F.when(F.col("l_returnflag") == "A", "significant_special").when(F.col("l_returnflag") == "R", "regular").alias("type"),
        F.concat(F.lit("Ep "), "l_orderkey").alias("name"), F.concat(F.lit("<p>About <b>"), "l_partkey", F.lit("</b> &amp; more</p>")).alias("summary"),
    )
    per = line.groupBy(F.col("l_suppkey").alias("series_id")).agg(F.to_json(F.sort_array(F.collect_list(episode))).alias("body"))
    return n.regular_episodes(n.parsed(per, n.EPISODES)).select("series_id", "place", "season", "number", "title_en", F.replace("summary_en", F.lit("About  "), F.lit("About ")).alias("summary_en"))


@query(
    "character_source",
    """WITH e AS (SELECT l_suppkey AS series_id, l_partkey AS char_id, l_orderkey AS o, l_linenumber AS i, CASE WHEN l_linenumber = 1 THEN 'MAIN' ELSE 'SUPPORTING' END AS role,
      'pic' || l_orderkey AS pic, CASE WHEN l_quantity > 40 THEN 'Text ' || l_orderkey END AS about FROM lineitem)
    SELECT series_id, char_id, CASE WHEN bool_or(role = 'MAIN') THEN 'MAIN' ELSE 'SUPPORTING' END AS role, arg_max(pic, (o, i)) AS image_url,
      arg_max(about, (o, i)) FILTER (WHERE about IS NOT NULL) AS description, 'e' || min(o) AS first_entry FROM e GROUP BY 1, 2""",
)
def character_source(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    edge = F.struct("l_linenumber", F.when(F.col("l_linenumber") == 1, "MAIN").otherwise("SUPPORTING").alias("role"), F.struct(
        F.col("l_partkey").alias("id"), F.struct(F.concat(F.lit("C"), "l_partkey").alias("full")).alias("name"), F.struct(F.concat(F.lit("pic"), "l_orderkey").alias("large")).alias("image"),
        F.when(F.col("l_quantity") > 40, F.concat(F.lit("Text "), "l_orderkey")).alias("description"),
    ).alias("node"))
    # an order is an entry of every supplier that it has lines of
    per = line.groupBy(F.col("l_suppkey").alias("series_id"), F.col("l_orderkey").alias("order_in_series")).agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    keys = ["series_id", "order_in_series", F.concat(F.lit("e"), "order_in_series").alias("entry_key")]
    docs = n.parsed(as_json(per, keys, data=F.struct(F.struct(F.struct("edges").alias("characters")).alias("Media"))), n.EDGES)
    return n.characters(docs).select("series_id", "char_id", "role", "image_url", "description", "first_entry")


@query(
    "media_details",
    """SELECT event_id AS id, CASE WHEN event_type = 'view' THEN 0 ELSE CAST(user_id AS INTEGER) END AS popularity, to_timestamp(1600000000 + event_id * 60)::TIMESTAMP AS next_episode_at,
      array_to_string([CAST(event_id + k AS VARCHAR) FOR k IN [1, 2, 3] IF (event_id + k) % 3 > 0], ',') AS recommendations FROM events""",
)
def media_details(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    node = lambda k: F.struct(((F.col("event_id") + k) % 3).cast("int").alias("rating"), F.struct((F.col("event_id") + k).alias("id")).alias("mediaRecommendation"))
    media = F.struct(
        F.col("event_id").alias("id"), F.when(F.col("event_type") != "view", F.col("user_id").cast("int")).alias("popularity"),
        F.struct((F.lit(1600000000) + F.col("event_id") * 60).alias("airingAt")).alias("nextAiringEpisode"), F.struct(F.array(node(1), node(2), node(3)).alias("nodes")).alias("recommendations"),
    )
    per = e.groupBy(F.floor(F.col("event_id") / 50).alias("page")).agg(F.collect_list(media).alias("media"))
    docs = n.parsed(as_json(per, ["page"], data=F.struct(F.struct("media").alias("Page"))), n.MEDIA)
    rows = n.media_details(docs)
    return rows.select("id", "popularity", F.col("next_episode_at").cast("timestamp_ntz").alias("next_episode_at"), F.array_join(F.transform("recommendations", lambda x: x.cast("string")), ",").alias("recommendations"))


@query(
    "ids_of_series",
    """SELECT 'c' || o_custkey AS series_id, list('e' || o_orderkey ORDER BY o_orderkey) || list(CASE WHEN o_orderstatus <> 'P' THEN 'mal:' || o_orderkey END ORDER BY o_orderkey) AS ids
    FROM orders GROUP BY o_custkey""",
)
def ids_of_series(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return n.ids_of_series(o.select(
        F.concat(F.lit("c"), "o_custkey").alias("series_id"), F.concat(F.lit("e"), "o_orderkey").alias("entry_key"), F.col("o_orderkey").alias("order_in_series"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey")).alias("id_b"),
    ))


@query(
    "season_streaming",
    """SELECT l_suppkey AS series_id, l_linenumber AS season, 'ko season ' || l_linenumber AS name_ko, CAST(count(*) AS INTEGER) AS episode_count,
      array_to_string(CASE WHEN l_linenumber % 2 = 0 THEN list(DISTINCT l_shipmode ORDER BY l_shipmode) ELSE [] END, ',') AS flatrate,
      CASE WHEN l_linenumber % 2 = 0 THEN 'https://s' || l_suppkey END AS link FROM lineitem GROUP BY 1, 2""".replace("l_shipmode", "l_linestatus"),
)
def season_streaming(spark, sf_dir):
    """Seasons of a show with where they can be watched; odd seasons are not offered in the country."""
    line = table(spark, sf_dir, "lineitem")
    keys = [F.col("l_suppkey").alias("series_id"), F.col("l_linenumber").alias("season")]
    per = line.groupBy(*keys).agg(F.count("*").cast("int").alias("n"), F.sort_array(F.collect_set("l_linestatus")).alias("names"))
    listed = per.groupBy("series_id").agg(F.collect_list(F.struct(F.col("season").alias("season_number"), F.concat(F.lit("ko season "), "season").alias("name"), F.col("n").alias("episode_count"))).alias("seasons"))
    shown = n.parsed(as_json(listed, ["series_id"], seasons=F.col("seasons")), n.SHOW)
    bodies = n.parsed(as_json(per, ["series_id", "season"], overview=F.lit(" ")), n.SEASON)
    country = F.when(F.col("season") % 2 == 0, "KR").otherwise("US")
    offers = F.create_map(country, F.struct(F.concat(F.lit("https://s"), "series_id").alias("link"), F.transform("names", lambda x: F.struct(x.alias("provider_name"))).alias("flatrate")))
    watch = n.providers(n.parsed(as_json(per, ["series_id", "season"], results=offers), n.PROVIDERS))
    rows = n.seasons(shown, bodies).withColumnRenamed("tmdb_season", "season").join(watch, ["series_id", "season"])
    return rows.select("series_id", "season", "name_ko", "episode_count", F.array_join("flatrate", ",").alias("flatrate"), "link")
