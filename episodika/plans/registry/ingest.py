"""Seeding, season alignment, date matching and work lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodika.operators import align
from episodika.plans import seed
from episodika.plans.derived import ENTRIES_SQL, LISTED_SQL, listed_episodes, raw_entries, table
from episodika.plans.registry.base import query
from episodika.session import cut_lineage


def entries(spark, sf_dir):
    return align.order_entries(raw_entries(spark, sf_dir))


WITH_ENTRIES = "WITH RECURSIVE " + ENTRIES_SQL


@query("season_order_offsets", WITH_ENTRIES + " SELECT series_id, entry_key, order_in_series, abs_offset FROM entries")
def season_order_offsets(spark, sf_dir):
    return entries(spark, sf_dir).select("series_id", "entry_key", "order_in_series", "abs_offset")


SLOTS_SQL = """s0 AS (SELECT *, row_number() OVER (PARTITION BY series_id, tmdb_season ORDER BY order_in_series) AS rn
                      FROM entries WHERE coalesce(tmdb_season, 0) <> 0),
slots AS (
  SELECT series_id, tmdb_season, entry_key, order_in_series, abs_offset, rn, coalesce(tmdb_offset, 0) AS start_,
         CASE WHEN coalesce(episodes, 0) <> 0 THEN coalesce(tmdb_offset, 0) + episodes END AS end_,
         coalesce(tmdb_offset, 0) + coalesce(episodes, 0) AS furthest
  FROM s0 WHERE rn = 1
  UNION ALL
  SELECT s.series_id, s.tmdb_season, s.entry_key, s.order_in_series, s.abs_offset, s.rn,
         coalesce(s.tmdb_offset, r.furthest),
         CASE WHEN coalesce(s.episodes, 0) <> 0 THEN coalesce(s.tmdb_offset, r.furthest) + s.episodes END,
         greatest(r.furthest, coalesce(s.tmdb_offset, r.furthest) + coalesce(s.episodes, 0))
  FROM slots r JOIN s0 s ON s.series_id = r.series_id AND s.tmdb_season = r.tmdb_season AND s.rn = r.rn + 1)"""


@query(
    "season_slots",
    WITH_ENTRIES + ", " + SLOTS_SQL
    + ' SELECT series_id, tmdb_season AS season, entry_key, CAST(start_ AS INTEGER) AS slot_start, CAST(end_ AS INTEGER) AS slot_end FROM slots',
)
def season_slots(spark, sf_dir):
    slots = align.season_slots(entries(spark, sf_dir), "tmdb")
    return slots.select("series_id", "season", "entry_key", F.col("start").alias("slot_start"), F.col("end").alias("slot_end"))


EPISODE_ORDER = ["airdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]

NUMBERED_SQL = LISTED_SQL + """,
numbered AS (SELECT *, row_number() OVER (PARTITION BY series_id, season ORDER BY airdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k,
                    row_number() OVER (PARTITION BY series_id ORDER BY airdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS n
             FROM listed)"""

OWNER_SQL = """lasts AS (SELECT series_id, max(order_in_series) AS last_order FROM entries GROUP BY 1),
candidates AS (
  SELECT p.*, e.entry_key, e.abs_offset, e.episodes, e.status, e.order_in_series,
         row_number() OVER (PARTITION BY p.series_id, p.n ORDER BY e.order_in_series DESC) AS pick
  FROM numbered p JOIN entries e ON e.series_id = p.series_id AND e.abs_offset < p.n),
owned AS (
  SELECT c.*, n - abs_offset AS entry_ep FROM candidates c JOIN lasts USING (series_id)
  WHERE pick = 1 AND NOT (coalesce(episodes, 0) <> 0 AND n > abs_offset + episodes
                          AND NOT (order_in_series = last_order AND status = 'ONGOING')))"""


@query(
    "owner_asof",
    WITH_ENTRIES + ", " + NUMBERED_SQL + ", " + OWNER_SQL
    + " SELECT series_id, CAST(n AS INTEGER) AS abs_ep, entry_key, CAST(entry_ep AS INTEGER) AS entry_ep FROM owned",
)
def owner_asof(spark, sf_dir):
    order = [F.col(c) for c in EPISODE_ORDER]
    points = align.number_from_one(listed_episodes(spark, sf_dir), {"n": "series_id"}, order, F.trunc("airdate", "quarter"))
    points = cut_lineage(points.select("series_id", F.col("n").cast("int").alias("abs_ep")))
    return align.owner_of(points, entries(spark, sf_dir))


@query(
    "map_episodes",
    WITH_ENTRIES + ", " + SLOTS_SQL + ", " + NUMBERED_SQL + ", " + OWNER_SQL
    + """, hits AS (SELECT p.*, s.entry_key, s.abs_offset + p.k - s.start_ AS abs_ep, p.k - s.start_ AS entry_ep,
               row_number() OVER (PARTITION BY p.series_id, p.n ORDER BY s.order_in_series) AS pick
        FROM numbered p JOIN slots s ON s.series_id = p.series_id AND s.tmdb_season = p.season
             AND s.start_ < p.k AND (s.end_ IS NULL OR p.k <= s.end_)),
    by_season AS (SELECT * FROM hits WHERE pick = 1),
    counts AS (SELECT l.series_id, l.listed, coalesce(s.c, 0) AS placed, coalesce(o.c, 0) AS ordered, t.total, t.airing
      FROM (SELECT series_id, count(*) AS listed FROM numbered GROUP BY 1) l
      LEFT JOIN (SELECT series_id, count(*) AS c FROM by_season GROUP BY 1) s USING (series_id)
      LEFT JOIN (SELECT series_id, count(*) AS c FROM owned GROUP BY 1) o USING (series_id)
      JOIN (SELECT series_id, sum(coalesce(episodes, 0)) AS total,
                   arg_max(coalesce(episodes, 0) = 0 OR status = 'ONGOING', order_in_series) AS airing FROM entries GROUP BY 1) t USING (series_id)),
    chosen AS (SELECT series_id, CASE WHEN placed < 0.9 * listed AND (listed <= total OR airing) AND ordered > placed
                                      THEN 'order' ELSE 'season' END AS method FROM counts)
    SELECT b.series_id, l_orderkey, l_linenumber, l_partkey, CAST(abs_ep AS INTEGER) AS abs_ep, entry_key,
           CAST(entry_ep AS INTEGER) AS entry_ep, method
    FROM by_season b JOIN chosen c ON c.series_id = b.series_id AND method = 'season'
    UNION ALL
    SELECT o.series_id, l_orderkey, l_linenumber, l_partkey, CAST(n AS INTEGER), entry_key, CAST(entry_ep AS INTEGER), method
    FROM owned o JOIN chosen c ON c.series_id = o.series_id AND method = 'order'""",
)
def map_episodes(spark, sf_dir):
    mapped = align.map_episodes(
        entries(spark, sf_dir), "tmdb", listed_episodes(spark, sf_dir), EPISODE_ORDER, F.trunc("airdate", "quarter")
    )
    return mapped.select("series_id", "l_orderkey", "l_linenumber", "l_partkey", "abs_ep", "entry_key", "entry_ep", "method")


def near_sql(direction: str) -> str:
    return (
        "WITH " + ENTRIES_SQL + ", " + LISTED_SQL
        + f""", by_day AS (SELECT series_id, airdate, CASE WHEN count(*) = 1 THEN min(order_in_series) END AS only FROM entries GROUP BY 1, 2),
    days AS (SELECT DISTINCT series_id, l_orderkey AS item, airdate AS day FROM listed),
    found AS (
      SELECT d.*, x.airdate IS NOT NULL AS same_day, x.only AS exact, b.only AS before, a.only AS after
      FROM days d LEFT JOIN by_day x ON x.series_id = d.series_id AND x.airdate = d.day
      LEFT JOIN by_day b ON b.series_id = d.series_id AND b.airdate = d.day - 1
      LEFT JOIN by_day a ON a.series_id = d.series_id AND a.airdate = d.day + 1),
    settled AS (
      SELECT *, CASE WHEN same_day THEN exact ELSE coalesce(before, after) END AS n,
             row_number() OVER (PARTITION BY series_id, item ORDER BY day {direction}) AS pick
      FROM found WHERE same_day OR (before IS NULL) <> (after IS NULL) OR before = after)
    SELECT series_id, item, CAST(n AS INTEGER) AS abs_ep FROM settled WHERE pick = 1 AND n IS NOT NULL"""
    )


def near(latest: bool):
    def run(spark, sf_dir):
        days = listed_episodes(spark, sf_dir).select("series_id", F.col("l_orderkey").alias("item"), F.col("airdate").alias("day"))
        aired = entries(spark, sf_dir).select("series_id", F.col("order_in_series").alias("abs_ep"), "airdate")
        return align.near_dates(days, aired, latest)

    return run


query("near_date_join", near_sql("ASC"))(near(False))
query("near_date_join_latest", near_sql("DESC"))(near(True))


@query(
    "series_rollup",
    "WITH " + ENTRIES_SQL
    + """, e AS (SELECT *, CASE WHEN episodes > 2 THEN status END AS airing_status,
                 CASE WHEN status = 'ONGOING' THEN airdate END AS next_episode_at FROM entries)
    SELECT series_id, max(popularity) AS popularity, min(next_episode_at) AS next_episode_at,
           arg_max(airing_status, order_in_series) FILTER (WHERE airing_status IS NOT NULL) AS status FROM e GROUP BY series_id""",
)
def series_rollup(spark, sf_dir):
    rows = entries(spark, sf_dir)
    rows = rows.withColumn("airing_status", F.when(F.col("episodes") > 2, F.col("status")))
    rows = rows.withColumn("next_episode_at", F.when(F.col("status") == "ONGOING", F.col("airdate")))
    return seed.rollup(rows)


@query(
    "refresh_totals",
    "WITH " + ENTRIES_SQL + ", " + LISTED_SQL
    + """, s AS (SELECT series_id, sum(coalesce(episodes, 0)) AS total FROM entries GROUP BY 1),
    l AS (SELECT series_id, max(l_linenumber * 9) AS last FROM listed GROUP BY 1)
    SELECT series_id, CAST(greatest(total, last) AS BIGINT) AS total_episodes FROM s LEFT JOIN l USING (series_id)""",
)
def refresh_totals(spark, sf_dir):
    series = raw_entries(spark, sf_dir).groupBy("series_id").agg(
        F.sum(F.coalesce("episodes", F.lit(0))).alias("total_episodes")
    )
    got = listed_episodes(spark, sf_dir).select("series_id", (F.col("l_linenumber") * 9).cast("long").alias("abs_ep"))
    return seed.refreshed_totals(series, got)


CATALOGUE_SQL = """cat AS (
  SELECT p_partkey, p_name AS title, CASE p_type WHEN 'PROMO' THEN 'MOVIE' WHEN 'SMALL' THEN 'OVA' ELSE 'TV' END AS type,
         CASE WHEN p_size < 5 THEN 'UPCOMING' ELSE 'FINISHED' END AS status,
         CASE WHEN p_brand <> 'Brand#1' AND p_size <> 7 THEN p_partkey + 1 END AS id_a,
         CASE WHEN p_size <> 9 THEN p_partkey + 1000 END AS id_b,
         1990 + p_size AS year, CASE WHEN p_size > 20 THEN p_size END AS episodes FROM part),
id_map AS (
  SELECT o_orderkey AS id_a, o_orderkey + 990 AS id_b, CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS tv_id,
         CASE WHEN o_orderstatus = 'F' THEN o_custkey + 5 END AS tvdb_id,
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS tmdb_season FROM orders),
j AS (SELECT c.*, CASE WHEN a.id_a IS NOT NULL THEN a.id_a ELSE b.id_a END AS m_id,
             CASE WHEN a.id_a IS NOT NULL THEN a.tv_id ELSE b.tv_id END AS tv_id,
             CASE WHEN a.id_a IS NOT NULL THEN a.tvdb_id ELSE b.tvdb_id END AS tvdb_id,
             CASE WHEN a.id_a IS NOT NULL THEN a.tmdb_season ELSE b.tmdb_season END AS tmdb_season
      FROM cat c LEFT JOIN id_map a ON a.id_a = c.id_a LEFT JOIN id_map b ON b.id_b = c.id_b
      WHERE type IN ('TV', 'OVA') AND status <> 'UPCOMING' AND (c.id_a IS NOT NULL OR c.id_b IS NOT NULL)),
k AS (SELECT *, CASE WHEN id_a IS NOT NULL THEN 'anilist:' || id_a ELSE 'mal:' || id_b END AS entry_key FROM j
      WHERE NOT (id_a IS NULL AND m_id IS NOT NULL AND m_id IN (SELECT id_a FROM cat WHERE id_a IS NOT NULL))),
e AS (SELECT *, CASE WHEN coalesce(tv_id, 0) <> 0 AND coalesce(tmdb_season, -1) <> 0 THEN 'tmdb:' || tv_id
                     ELSE 'entry:' || entry_key END AS series_id FROM k),
entries AS (SELECT *, row_number() OVER w AS order_in_series,
   coalesce(sum(episodes) OVER (PARTITION BY series_id ORDER BY year, CASE WHEN coalesce(tmdb_season, 0) = 0 THEN 999 ELSE tmdb_season END, title, entry_key
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS abs_offset FROM e
   WINDOW w AS (PARTITION BY series_id ORDER BY year, CASE WHEN coalesce(tmdb_season, 0) = 0 THEN 999 ELSE tmdb_season END, title, entry_key))"""


def catalogue(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    at = lambda host, key: F.concat(F.lit(f"https://{host}/anime/"), key)
    return p.select(
        F.col("p_name").alias("title"),
        F.when(F.col("p_type") == "PROMO", "MOVIE").when(F.col("p_type") == "SMALL", "OVA").otherwise("TV").alias("type"),
        F.when(F.col("p_size") < 5, "UPCOMING").otherwise("FINISHED").alias("status"),
        F.array_compact(
            F.array(
                F.lit("https://example.org/x"),
                F.when((F.col("p_brand") != "Brand#1") & (F.col("p_size") != 7), at(seed.HOST_A, F.col("p_partkey") + 1)),
                F.when(F.col("p_size") != 9, at(seed.HOST_B, F.col("p_partkey") + 1000)),
            )
        ).alias("sources"),
        F.array("p_brand").alias("synonyms"),
        F.split("p_name", " ").alias("tags"),
        (F.col("p_size") + 1990).alias("year"),
        F.lit(None).cast("string").alias("season_of_year"),
        F.when(F.col("p_size") > 20, F.col("p_size")).alias("episodes"),
    )


def id_map(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    none = F.lit(None).cast("int")
    return o.select(
        F.col("o_orderkey").alias("id_a"),
        (F.col("o_orderkey") + 990).alias("id_b"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("tv_id"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_custkey") + 5).alias("tvdb_id"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("tmdb_season"),
        none.alias("tmdb_offset"), none.alias("tvdb_season"), none.alias("tvdb_offset"),
    )


@query(
    "seed_entries",
    "WITH " + CATALOGUE_SQL + """ SELECT series_id, entry_key, title, year, CAST(episodes AS INTEGER) AS episodes,
    CAST(order_in_series AS INTEGER) AS order_in_series, CAST(abs_offset AS INTEGER) AS abs_offset FROM entries""",
)
def seed_entries(spark, sf_dir):
    _, rows = seed.seed(catalogue(spark, sf_dir), id_map(spark, sf_dir), ["TV", "OVA"])
    return rows.select("series_id", "entry_key", "title", "year", "episodes", "order_in_series", "abs_offset")


@query(
    "seed_series",
    "WITH " + CATALOGUE_SQL + """ SELECT series_id, arg_min(title, order_in_series) AS title,
    first(tv_id ORDER BY order_in_series) AS tmdb_id,
    arg_min(tvdb_id, order_in_series) FILTER (WHERE coalesce(tvdb_id, 0) <> 0) AS tvdb_id,
    CAST(sum(coalesce(episodes, 0)) AS INTEGER) AS total_episodes FROM entries GROUP BY series_id""",
)
def seed_series(spark, sf_dir):
    return seed.seed(catalogue(spark, sf_dir), id_map(spark, sf_dir), ["TV", "OVA"])[0]


@query(
    "id_request_batches",
    """WITH n AS (SELECT p_partkey, (row_number() OVER (ORDER BY p_partkey) - 1) // 50 AS batch FROM part)
    SELECT CAST(batch AS BIGINT) AS batch, count(*) AS n, min(p_partkey) AS first_id, max(p_partkey) AS last_id FROM n GROUP BY 1""",
)
def id_request_batches(spark, sf_dir):
    rows = seed.id_batches(table(spark, sf_dir, "part"), "p_partkey", width=100_000)
    return rows.select(
        "batch", F.size("ids").cast("long").alias("n"), F.array_min("ids").alias("first_id"), F.array_max("ids").alias("last_id")
    )


LEDGER_SQL = """series AS (SELECT 'd' || doc_id AS series_id, n_chars AS popularity FROM documents),
ledger AS (SELECT 'd' || doc_id AS series_id, 'fetch' AS source,
           CASE WHEN toxic = 1 THEN 'error' WHEN quality = 1 THEN 'ok' ELSE 'empty' END AS status FROM labels)"""


def series_and_ledger(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("series_id"), F.col("n_chars").alias("popularity"))
    ledger = table(spark, sf_dir, "labels").select(
        F.concat(F.lit("d"), "doc_id").alias("series_id"),
        F.lit("fetch").alias("source"),
        F.when(F.col("toxic") == 1, "error").when(F.col("quality") == 1, "ok").otherwise("empty").alias("status"),
    )
    return d, ledger


@query(
    "fetch_resume",
    "WITH " + LEDGER_SQL + """ SELECT s.series_id, popularity FROM series s LEFT JOIN ledger l
    ON l.series_id = s.series_id AND l.source = 'fetch' WHERE l.status IS NULL OR l.status = 'error'""",
)
def fetch_resume(spark, sf_dir):
    series, ledger = series_and_ledger(spark, sf_dir)
    return seed.work_list(series, ledger, "fetch")


@query(
    "fetch_resume_top_first",
    "WITH " + LEDGER_SQL + """, top AS (SELECT * FROM series ORDER BY popularity DESC NULLS LAST, series_id LIMIT 100)
    SELECT s.series_id, popularity FROM top s LEFT JOIN ledger l ON l.series_id = s.series_id AND l.source = 'fetch'
    WHERE l.status IS NULL OR l.status = 'error'""",
)
def fetch_resume_top_first(spark, sf_dir):
    series, ledger = series_and_ledger(spark, sf_dir)
    return seed.work_list(series, ledger, "fetch", top=100)


@query(
    "number_with_nulls",
    """WITH o AS (SELECT CASE WHEN o_custkey % 7 <> 0 THEN o_custkey END AS series_id, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) END AS day, o_orderkey FROM orders)
    SELECT o_orderkey, row_number() OVER w AS n, max(o_orderkey) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM o
    WINDOW w AS (PARTITION BY series_id ORDER BY day NULLS FIRST, o_orderkey)""",
)
def number_with_nulls(spark, sf_dir):
    """Rows without a series are one group, rows without a date come first; none is lost and no number left out."""
    from episodika.operators.sequence import running_max

    o = table(spark, sf_dir, "orders").select(
        F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")).alias("series_id"),
        F.when(F.col("o_orderkey") % 5 != 0, F.to_date("o_orderdate")).alias("day"), "o_orderkey",
    )
    order, bucket = [F.col("day"), F.col("o_orderkey")], F.trunc("day", "quarter")
    rows = align.number_from_one(o, {"n": "series_id"}, order, bucket)
    return running_max(rows, "series_id", order, F.col("o_orderkey"), "top", bucket).select("o_orderkey", "n", "top")
