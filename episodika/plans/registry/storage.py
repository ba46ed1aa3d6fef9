"""Keyed writes, records and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodika.operators import merge
from episodika.plans import records, reports
from episodika.plans.derived import table
from episodika.plans.registry.base import query

CUT = "TIMESTAMP '2024-01-10 00:00:00'"
CHANGES_SQL = f"""ev AS (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events),
old_rows AS (SELECT user_id, event_type, arg_max(value, event_id) AS value, arg_max(k, event_id) AS k, count(*) AS n,
             max(event_id) AS last_id FROM ev WHERE ts < {CUT} GROUP BY 1, 2),
new_rows AS (SELECT user_id, event_type, arg_max(value, event_id) AS value, arg_max(k, event_id) AS k, count(*) AS n,
             max(event_id) AS last_id FROM ev WHERE ts >= {CUT} GROUP BY 1, 2)"""


def events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def change_sides(spark, sf_dir):
    e = events(spark, sf_dir)

    def rows(part):
        return part.groupBy("user_id", "event_type").agg(
            F.max_by("value", "event_id").alias("value"),
            F.max_by("k", "event_id").alias("k"),
            F.count("*").alias("n"),
            F.max("event_id").alias("last_id"),
        )

    cut = F.expr("TIMESTAMP_NTZ '2024-01-10 00:00:00'")
    return rows(e.filter(F.col("ts") < cut)), rows(e.filter(F.col("ts") >= cut))


KEYS = ["user_id", "event_type"]


@query(
    "upsert_owned_columns",
    "WITH " + CHANGES_SQL + """ SELECT user_id, event_type, CASE WHEN n.last_id IS NOT NULL THEN n.value ELSE o.value END AS value,
    coalesce(o.k, n.k) AS k, coalesce(o.n, n.n) AS n, CASE WHEN n.last_id IS NOT NULL THEN n.last_id ELSE o.last_id END AS last_id
    FROM old_rows o FULL JOIN new_rows n USING (user_id, event_type)""",
)
def upsert_owned_columns(spark, sf_dir):
    old, new = change_sides(spark, sf_dir)
    return merge.upsert(old, new, KEYS, ["value", "last_id"])


@query(
    "upsert_merge_rules",
    "WITH " + CHANGES_SQL + """, o AS (SELECT user_id, event_type, CASE WHEN value > 20 THEN 'MAIN' ELSE 'SUPPORTING' END AS role,
       CASE WHEN k > 50 THEN 'd' || k END AS description, last_id AS image, k AS kept FROM old_rows),
    n AS (SELECT user_id, event_type, CASE WHEN value > 20 THEN 'MAIN' ELSE 'SUPPORTING' END AS role,
       CASE WHEN k > 50 THEN 'd' || k END AS description, last_id AS image, k AS kept FROM new_rows)
    SELECT user_id, event_type, CASE WHEN o.role = 'MAIN' THEN 'MAIN' ELSE coalesce(n.role, o.role) END AS role,
           coalesce(n.description, o.description) AS description, coalesce(n.image, o.image) AS image,
           coalesce(o.kept, n.kept) AS kept
    FROM o FULL JOIN n USING (user_id, event_type)""",
)
def upsert_merge_rules(spark, sf_dir):
    def shape(df):
        return df.select(
            *KEYS,
            F.when(F.col("value") > 20, "MAIN").otherwise("SUPPORTING").alias("role"),
            F.when(F.col("k") > 50, F.concat(F.lit("d"), "k")).alias("description"),
            F.col("last_id").alias("image"),
            F.col("k").alias("kept"),
        )

    old, new = (shape(x) for x in change_sides(spark, sf_dir))
    rules = {"role": merge.sticky("MAIN"), "description": merge.new_if_given, "kept": merge.keep_first}
    return merge.upsert(old, new, KEYS, rules=rules)


@query(
    "upsert_fill_null",
    "WITH " + CHANGES_SQL + """, o AS (SELECT user_id, event_type, CASE WHEN k > 40 THEN k END AS k, n FROM old_rows)
    SELECT user_id, event_type, coalesce(o.k, n.k) AS k, coalesce(o.n, n.n) AS n
    FROM o FULL JOIN (SELECT user_id, event_type, k, n FROM new_rows) n USING (user_id, event_type)""",
)
def upsert_fill_null(spark, sf_dir):
    old, new = (x.select(*KEYS, "k", "n") for x in change_sides(spark, sf_dir))
    old = old.withColumn("k", F.when(F.col("k") > 40, F.col("k")))
    return merge.upsert(old, new, KEYS, rules={"k": merge.fill_if_null, "n": merge.keep_first})


@query(
    "upsert_keep_vector",
    """WITH t AS (SELECT d.doc_id, d.text, d.source, e.label FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id),
    s AS (SELECT doc_id, CASE WHEN lang = 'fr' THEN text || ' changed' ELSE text END AS text, source FROM documents WHERE n_chars > 800)
    SELECT coalesce(s.doc_id, t.doc_id) AS doc_id, md5(coalesce(s.text, t.text)) AS digest, coalesce(s.source, t.source) AS source,
           CASE WHEN s.doc_id IS NULL OR s.text = t.text THEN label END AS label
    FROM t FULL JOIN s ON s.doc_id = t.doc_id""",
)
def upsert_keep_vector(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label", "embedding")
    target = d.join(e, "doc_id").select(
        F.col("doc_id").alias("chunk_id"), "text", "source", F.struct("label", "embedding").alias("embedding")
    )
    text = F.when(F.col("lang") == "fr", F.concat("text", F.lit(" changed"))).otherwise(F.col("text"))
    source = d.filter("n_chars > 800").select(F.col("doc_id").alias("chunk_id"), text.alias("text"), "source")
    merged = merge.upsert_chunks(target, source)
    return merged.select(
        F.col("chunk_id").alias("doc_id"), F.md5("text").alias("digest"), "source", F.col("embedding.label").alias("label")
    )


@query(
    "insert_missing",
    "WITH " + CHANGES_SQL + """ SELECT * FROM old_rows UNION ALL
    SELECT * FROM new_rows n WHERE NOT EXISTS (SELECT 1 FROM old_rows o WHERE o.user_id = n.user_id AND o.event_type = n.event_type)""",
)
def insert_missing(spark, sf_dir):
    old, new = change_sides(spark, sf_dir)
    return merge.insert_missing(old, new, KEYS)


@query(
    "sync_delete",
    """WITH cur AS (SELECT doc_id, source FROM documents WHERE n_chars > 2000 AND lang <> 'de' AND source <> 'src4')
    SELECT doc_id, source FROM documents d WHERE source NOT IN (SELECT source FROM cur) OR doc_id IN (SELECT doc_id FROM cur)""",
)
def sync_delete(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", "lang")
    current = d.filter("n_chars > 2000 AND lang <> 'de' AND source <> 'src4'")
    return merge.sync_delete(d.select("doc_id", "source"), current, "doc_id", "source")


@query(
    "orphan_delete",
    "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
)
def orphan_delete(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return merge.drop_orphans(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), orders, "c_custkey")


@query(
    "clear_and_rewrite",
    "WITH " + CHANGES_SQL + """, t AS (SELECT user_id, event_type, k AS plot, CASE WHEN n > 3 THEN n END AS title, last_id AS url FROM old_rows),
    s AS (SELECT user_id, event_type, k AS plot, last_id AS url FROM new_rows WHERE value > 5)
    SELECT user_id, event_type, s.plot, t.title, s.url FROM t FULL JOIN s USING (user_id, event_type)
    WHERE s.url IS NOT NULL OR t.title IS NOT NULL""",
)
def clear_and_rewrite(spark, sf_dir):
    old, new = change_sides(spark, sf_dir)
    target = old.select(*KEYS, F.col("k").alias("plot"), F.when(F.col("n") > 3, F.col("n")).alias("title"), F.col("last_id").alias("url"))
    source = new.filter("value > 5").select(*KEYS, F.col("k").alias("plot"), F.col("last_id").alias("url"))
    return merge.clear_and_rewrite(target, source, KEYS, ["plot", "url"], ["url", "title"])


@query(
    "replace_groups",
    "WITH " + CHANGES_SQL + """, s AS (SELECT * FROM new_rows WHERE k > 30)
    SELECT * FROM old_rows WHERE user_id NOT IN (SELECT user_id FROM s) UNION ALL SELECT * FROM s""",
)
def replace_groups(spark, sf_dir):
    old, new = change_sides(spark, sf_dir)
    return merge.replace_groups(old, new.filter("k > 30"), "user_id")


@query(
    "latest_change_per_key",
    "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2",
)
def latest_change_per_key(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return merge.latest_per_key(e, KEYS, ["ts", "event_id"]).select(*KEYS, "event_id", "value")


# ---------------------------------------------------------------- records

RECORDS_SQL = """s AS (SELECT 'n' || n_nationkey AS series_id, n_name AS title, CASE WHEN n_regionkey > 1 THEN 'K ' || n_name END AS title_ko,
         CASE WHEN n_nationkey > 4 THEN n_nationkey * 5 END AS total_episodes FROM nation),
c AS (SELECT 'u' || user_id AS user_id, 'n' || (event_id % 27) AS series_id, CAST(json_extract(props, '$.k') AS INTEGER) - 1 AS seen_ep,
             CASE WHEN event_type <> 'view' THEN round(value / 4, 1) END AS rating, ts AS updated_at, event_id AS change_id FROM events),
checked AS (SELECT c.*, CASE WHEN s.series_id IS NULL THEN 'unknown series' WHEN seen_ep IS NULL OR seen_ep < 0 THEN 'position'
      WHEN coalesce(total_episodes, 0) > 0 AND seen_ep > total_episodes THEN 'position'
      WHEN rating IS NOT NULL AND NOT rating BETWEEN 0.5 AND 5 THEN 'rating' END AS problem
   FROM c LEFT JOIN s USING (series_id)),
saved AS (SELECT user_id, series_id, arg_max(seen_ep, (updated_at, change_id)) AS seen_ep,
          arg_max(rating, (updated_at, change_id)) FILTER (WHERE rating IS NOT NULL) AS rating, max(change_id) AS last_change
   FROM checked WHERE problem IS NULL GROUP BY 1, 2)"""


def record_inputs(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    series = n.select(
        F.concat(F.lit("n"), "n_nationkey").alias("series_id"),
        F.col("n_name").alias("title"),
        F.when(F.col("n_regionkey") > 1, F.concat(F.lit("K "), "n_name")).alias("title_ko"),
        F.when(F.col("n_nationkey") > 4, F.col("n_nationkey") * 5).alias("total_episodes"),
        F.lit(None).cast("string").alias("poster_url"),
    )
    e = events(spark, sf_dir)
    changes = e.select(
        F.concat(F.lit("u"), "user_id").alias("user_id"),
        # every change goes to one of 27 series ids, two of which are not in the catalogue
        F.concat(F.lit("n"), F.col("event_id") % 27).alias("series_id"),
        (F.col("k") - 1).alias("seen_ep"),
        F.when(F.col("event_type") != "view", F.round(F.col("value") / 4, 1)).alias("rating"),
        F.col("ts").alias("updated_at"),
        F.col("event_id").alias("change_id"),
    )
    empty = changes.drop("change_id").filter(F.lit(False))
    return empty, changes, series


@query(
    "record_validation",
    "WITH " + RECORDS_SQL + " SELECT coalesce(problem, 'fine') AS verdict, count(*) AS n, count(DISTINCT user_id) AS users FROM checked GROUP BY 1",
)
def record_validation(spark, sf_dir):
    _, changes, series = record_inputs(spark, sf_dir)
    rows = records.checked(changes, series).withColumn("verdict", F.coalesce("problem", F.lit("fine")))
    return rows.groupBy("verdict").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query(
    "record_upsert",
    "WITH " + RECORDS_SQL + " SELECT user_id, series_id, seen_ep, round(rating, 2) AS rating FROM saved",
)
def record_upsert(spark, sf_dir):
    rows = records.save(*record_inputs(spark, sf_dir))
    return rows.select("user_id", "series_id", "seen_ep", F.round("rating", 2).alias("rating"))


@query(
    "record_with_previous",
    "WITH " + RECORDS_SQL + """, b AS (SELECT k.*, e.event_type IN ('view', 'click') AS early FROM checked k JOIN events e ON e.event_id = k.change_id WHERE problem IS NULL),
    t AS (SELECT early, user_id, series_id, arg_max(seen_ep, (updated_at, change_id)) AS seen_ep, arg_max(rating, (updated_at, change_id)) FILTER (WHERE rating IS NOT NULL) AS rating FROM b GROUP BY 1, 2, 3)
    SELECT n.user_id, n.series_id, n.seen_ep, round(coalesce(n.rating, o.rating), 2) AS rating, o.seen_ep AS previous_seen_ep, round(o.rating, 2) AS previous_rating
    FROM t n LEFT JOIN t o ON o.early AND o.user_id = n.user_id AND o.series_id = n.series_id WHERE NOT n.early""",
)
def record_with_previous(spark, sf_dir):
    """Two batches of changes: what the second one leaves, beside what the first one had left."""
    empty, changes, series = record_inputs(spark, sf_dir)
    kinds = events(spark, sf_dir).select(F.col("event_id").alias("change_id"), "event_type")
    early = F.col("event_type").isin("view", "click")
    both = changes.join(kinds, "change_id")
    stored = records.save(empty, both.filter(early).drop("event_type"), series)
    rows = records.save_with_previous(stored, both.filter(~early).drop("event_type"), series)
    return rows.withColumns({c: F.round(c, 2) for c in ("rating", "previous_rating")})


@query(
    "record_list",
    "WITH " + RECORDS_SQL + """ SELECT user_id, series_id, coalesce(title_ko, title) AS name, seen_ep, total_episodes
    FROM saved LEFT JOIN s USING (series_id) WHERE user_id = 'u7'""",
)
def record_list(spark, sf_dir):
    empty, changes, series = record_inputs(spark, sf_dir)
    rows = records.listed(records.save(empty, changes, series), series, "u7")
    return rows.select("user_id", "series_id", "name", "seen_ep", "total_episodes")


@query(
    "record_delete",
    "WITH " + RECORDS_SQL + " SELECT user_id, count(*) AS n FROM saved WHERE NOT (user_id = 'u7' AND series_id = 'n9') GROUP BY 1",
)
def record_delete(spark, sf_dir):
    kept, _ = records.delete(records.save(*record_inputs(spark, sf_dir)), "u7", "n9")
    return kept.groupBy("user_id").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- reports

REPORT_SQL = """series AS (SELECT 'c' || c_custkey AS series_id, c_name AS title,
    CASE WHEN c_mktsegment <> 'BUILDING' THEN 'K ' || c_name END AS title_ko,
    CASE WHEN c_acctbal > 0 THEN CAST(round(c_acctbal) AS BIGINT) END AS popularity,
    CASE WHEN c_nationkey <> 3 THEN c_nationkey * 2 ELSE 0 END AS total_episodes,
    CASE WHEN c_nationkey < 20 THEN c_custkey END AS tmdb_id, CASE WHEN c_nationkey > 10 THEN c_custkey END AS tvdb_id FROM customer),
episodes AS (SELECT 'c' || o_custkey AS series_id, CASE WHEN l_returnflag <> 'N' THEN 'title' END AS title_en,
    CASE WHEN l_returnflag = 'A' THEN 'ko' END AS overview_ko, CASE WHEN l_linenumber < 4 THEN 'en' END AS summary_en,
    CASE WHEN l_linenumber = 5 THEN 'en' END AS overview_en, CASE WHEN l_linenumber = 6 THEN 'en' END AS synopsis_en,
    CASE WHEN l_linestatus = 'F' THEN l_quantity > 25 END AS filler,
    CASE WHEN l_quantity > 5 THEN repeat('p', CAST(l_quantity * 25 AS INTEGER)) END AS plot,
    CASE WHEN l_tax > 0.04 THEN 'ch' END AS chapters, CASE WHEN l_discount > 0.05 THEN 'arc' END AS arc
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
log0 AS (SELECT 'c' || o_custkey AS series_id, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'tvmaze' WHEN '2' THEN 'tmdb'
      WHEN '3' THEN 'jikan' WHEN '4' THEN 'characters' ELSE 'fandom' END AS source,
      CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'empty' ELSE 'error' END AS status,
      o_orderdate AS fetched_at, o_orderkey FROM orders),
ledger AS (SELECT series_id, source, arg_max(status, (fetched_at, o_orderkey)) AS status, max(fetched_at) AS fetched_at,
      'order ' || arg_max(o_orderkey, (fetched_at, o_orderkey)) AS detail FROM log0 GROUP BY 1, 2),
characters AS (SELECT 'c' || user_id AS series_id, event_id FROM events),
streaming AS (SELECT 'c' || o_custkey AS series_id, o_orderstatus AS a, o_orderpriority AS b FROM orders)"""


def report_tables(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    series = c.select(
        F.concat(F.lit("c"), "c_custkey").alias("series_id"),
        F.col("c_name").alias("title"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.concat(F.lit("K "), "c_name")).alias("title_ko"),
        F.when(F.col("c_acctbal") > 0, F.round("c_acctbal").cast("bigint")).alias("popularity"),
        F.when(F.col("c_nationkey") != 3, F.col("c_nationkey") * 2).otherwise(0).alias("total_episodes"),
        F.when(F.col("c_nationkey") < 20, F.col("c_custkey")).alias("tmdb_id"),
        F.when(F.col("c_nationkey") > 10, F.col("c_custkey")).alias("tvdb_id"),
    )
    o = table(spark, sf_dir, "orders")
    sid = F.concat(F.lit("c"), "o_custkey").alias("series_id")
    lines = table(spark, sf_dir, "lineitem").join(
        o.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey"
    )
    episodes = lines.select(
        sid,
        F.when(F.col("l_returnflag") != "N", "title").alias("title_en"),
        F.when(F.col("l_returnflag") == "A", "ko").alias("overview_ko"),
        F.when(F.col("l_linenumber") < 4, "en").alias("summary_en"),
        F.when(F.col("l_linenumber") == 5, "en").alias("overview_en"),
        F.when(F.col("l_linenumber") == 6, "en").alias("synopsis_en"),
        F.when(F.col("l_linestatus") == "F", F.col("l_quantity") > 25).alias("filler"),
        F.when(F.col("l_quantity") > 5, F.repeat(F.lit("p"), (F.col("l_quantity") * 25).cast("int"))).alias("plot"),
        F.when(F.col("l_tax") > 0.04, "ch").alias("chapters"),
        F.when(F.col("l_discount") > 0.05, "arc").alias("arc"),
    )
    digit = F.substring("o_orderpriority", 1, 1)
    source = F.when(digit == "1", "tvmaze").when(digit == "2", "tmdb").when(digit == "3", "jikan").when(digit == "4", "characters")
    status = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "empty").otherwise("error")
    log = o.select(sid, source.otherwise("fandom").alias("source"), status.alias("status"), F.col("o_orderdate").alias("fetched_at"), "o_orderkey")
    ledger = merge.latest_per_key(log, ["series_id", "source"], ["fetched_at", "o_orderkey"]).withColumn(
        "detail", F.concat(F.lit("order "), "o_orderkey")
    )
    characters = table(spark, sf_dir, "events").select(F.concat(F.lit("c"), "user_id").alias("series_id"))
    streaming = o.select(sid, F.array("o_orderstatus", "o_orderpriority").alias("flatrate"))
    return dict(series=series, episodes=episodes, ledger=ledger, characters=characters, streaming=streaming)


@query("report_totals", "WITH " + REPORT_SQL + " SELECT count(*) AS series, sum(total_episodes) AS episodes, count(popularity) AS with_popularity FROM series")
def report_totals(spark, sf_dir):
    return reports.totals(report_tables(spark, sf_dir)["series"])


def progress_sql(base: str) -> str:
    return "WITH " + REPORT_SQL + f""", top AS ({base}),
    src AS (SELECT unnest(['tvmaze', 'tmdb', 'jikan', 'characters', 'chunks']) AS source),
    j AS (SELECT src.source, top.*, l.status, l.fetched_at FROM top CROSS JOIN src LEFT JOIN ledger l
          ON l.series_id = top.series_id AND l.source = src.source),
    p AS (SELECT source, count(*) FILTER (WHERE CASE source WHEN 'tvmaze' THEN tvdb_id IS NOT NULL
            WHEN 'tmdb' THEN tmdb_id IS NOT NULL ELSE TRUE END) AS target,
      count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'empty') AS empty,
      count(*) FILTER (WHERE status = 'error') AS error, CAST(max(fetched_at) AS DATE) AS last FROM j GROUP BY source)
    SELECT *, round((ok + empty) / nullif(target, 0)::DOUBLE, 6) AS share FROM p"""


def progress(top):
    def run(spark, sf_dir):
        t = report_tables(spark, sf_dir)
        rows = reports.progress(t["series"], t["ledger"], top)
        return rows.withColumn("last", F.to_date("last")).withColumn("share", F.round("share", 6))

    return run


query("progress_report", progress_sql("SELECT * FROM series"))(progress(None))
query("progress_report_top", progress_sql("SELECT * FROM series ORDER BY popularity DESC NULLS LAST, series_id LIMIT 300"))(progress(300))


@query(
    "collected_counts",
    "WITH " + REPORT_SQL + """ SELECT count(*) AS episodes, count(title_en) AS english_titles, count(overview_ko) AS korean_overviews,
    count(filler) AS filler_known, count(*) FILTER (WHERE length(plot) >= 500) AS long_plots FROM episodes""",
)
def collected_counts(spark, sf_dir):
    return reports.collected(report_tables(spark, sf_dir)["episodes"])


@query(
    "chunk_counts",
    """SELECT lang AS type, count(*) AS chunks, count(vec_id) AS embedded FROM documents LEFT JOIN embeddings ON vec_id = doc_id GROUP BY 1""",
)
def chunk_counts(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("embedding"))
    chunks = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("type")).join(e, "doc_id", "left")
    return reports.chunk_counts(chunks)


@query(
    "readiness_tiers",
    "WITH " + REPORT_SQL + """, ep AS (SELECT series_id, count(*) FILTER (WHERE summary_en IS NOT NULL OR overview_ko IS NOT NULL
        OR overview_en IS NOT NULL OR synopsis_en IS NOT NULL) AS summ, count(*) FILTER (WHERE length(plot) >= 500) AS plot FROM episodes GROUP BY 1)
    SELECT count(*) AS total, count(*) FILTER (WHERE tmdb_id IS NOT NULL OR tvdb_id IS NOT NULL) AS linked,
      count(*) FILTER (WHERE summ >= 0.9 * nullif(total_episodes, 0)) AS episode_ready,
      count(*) FILTER (WHERE plot >= 0.9 * nullif(total_episodes, 0)) AS detail_ready FROM series LEFT JOIN ep USING (series_id)""",
)
def readiness_tiers(spark, sf_dir):
    t = report_tables(spark, sf_dir)
    return reports.readiness(t["series"], t["episodes"])


@query(
    "series_detail_report",
    "WITH " + REPORT_SQL + """, sc AS (SELECT 'c' || doc_id AS series_id, count(*) AS scenes FROM documents WHERE lang = 'en' GROUP BY 1)
    SELECT s.series_id, coalesce(title_ko, title) AS name, total_episodes, count(*) FILTER (WHERE length(plot) >= 500) AS plots,
      round(avg(length(plot))) AS mean_length, count(chapters) AS chapters, count(arc) AS arcs, coalesce(any_value(scenes), 0) AS scenes, l.detail
    FROM ledger l JOIN series s USING (series_id) LEFT JOIN episodes e USING (series_id) LEFT JOIN sc USING (series_id)
    WHERE l.source = 'fandom' GROUP BY s.series_id, title_ko, title, total_episodes, l.detail""",
)
def series_detail_report(spark, sf_dir):
    t = report_tables(spark, sf_dir)
    d = table(spark, sf_dir, "documents")
    chunks = d.select(F.concat(F.lit("c"), "doc_id").alias("series_id"), F.when(F.col("lang") == "en", "event").otherwise("plot").alias("type"))
    return reports.detail(t["series"], t["episodes"], chunks, t["ledger"]).drop("fill")


@query(
    "coverage_report",
    "WITH " + REPORT_SQL + """ SELECT s.series_id, coalesce(title_ko, title) AS name, total_episodes, popularity,
      count(summary_en) AS summaries, count(overview_ko) AS korean, count(filler) AS filler_known,
      count(*) FILTER (WHERE length(plot) >= 500) AS plots,
      (SELECT count(*) FROM characters c WHERE c.series_id = s.series_id) AS characters,
      (SELECT string_agg(p, ', ' ORDER BY p) FROM (SELECT DISTINCT unnest([a, b]) AS p FROM streaming st WHERE st.series_id = s.series_id)) AS providers,
      (SELECT string_agg(source, ',' ORDER BY source) FROM ledger f WHERE f.series_id = s.series_id AND f.status = 'error') AS failed
    FROM series s LEFT JOIN episodes e USING (series_id) GROUP BY s.series_id, title_ko, title, total_episodes, popularity
    ORDER BY popularity DESC NULLS LAST, s.series_id LIMIT 100""",
)
def coverage_report(spark, sf_dir):
    return reports.coverage(top=100, **report_tables(spark, sf_dir))


@query(
    "service_copy",
    "WITH " + REPORT_SQL + """, ids AS (SELECT s.series_id FROM series s JOIN episodes e USING (series_id) GROUP BY s.series_id, total_episodes
      HAVING count(*) FILTER (WHERE length(plot) >= 500) >= 0.6 * greatest(total_episodes, count(*)))
    SELECT series_id, title_en, filler, length(plot) AS n, CAST(NULL AS VARCHAR) AS added FROM episodes WHERE series_id IN (SELECT series_id FROM ids)""",
)
def service_copy(spark, sf_dir):
    t = report_tables(spark, sf_dir)
    ids = reports.service_ids(t["series"], t["episodes"], 0.6)
    rows = merge.copy_by_ids(t["episodes"], ids, ["series_id", "title_en", "filler", "plot", "added", "wikitext"], skip=["wikitext"])
    return rows.select("series_id", "title_en", "filler", F.length("plot").cast("long").alias("n"), F.col("added").cast("string").alias("added"))
