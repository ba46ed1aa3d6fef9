"""Titles, lookups, reviews, the dictionary and recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodika.functions import text as t
from episodika.operators import catalog
from episodika.plans import reading
from episodika.plans.derived import MEDIA_CHUNKS_SQL, TEXT_CHUNKS_SQL, documents, media_chunks, table, text_chunks, vector_of
from episodika.plans.registry.base import query
from episodika.plans.registry.retrieval import sim
from episodika.plans.registry.texts import sql_paragraphs, sql_strip

NORM = r"regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}\p{{M}}]+', '', 'g')"
INDEX_SQL = f"""names AS (
  SELECT {NORM.format(x='p_name')} AS name, 'a:' || p_name AS series_id, count(*) AS popularity, TRUE AS is_main FROM part GROUP BY p_name
  UNION ALL SELECT {NORM.format(x="p_name || ' ' || p_type")}, 'b:' || p_name || ' ' || p_type, count(*), TRUE FROM part GROUP BY p_name, p_type
  UNION ALL SELECT {NORM.format(x="p_name || ' ' || p_brand")}, 'b:' || p_name || ' ' || p_type, count(*), FALSE FROM part GROUP BY p_name, p_type, p_brand)"""


def name_index(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    two = F.concat("p_name", F.lit(" "), "p_type")
    a = p.groupBy("p_name").agg(F.count("*").alias("popularity")).select(
        t.norm_name("p_name").alias("name"), F.concat(F.lit("a:"), "p_name").alias("series_id"), "popularity", F.lit(True).alias("is_main")
    )
    b = p.groupBy("p_name", "p_type").agg(F.count("*").alias("popularity")).select(
        t.norm_name(two).alias("name"), F.concat(F.lit("b:"), two).alias("series_id"), "popularity", F.lit(True).alias("is_main")
    )
    c = p.groupBy("p_name", "p_type", "p_brand").agg(F.count("*").alias("popularity")).select(
        t.norm_name(F.concat("p_name", F.lit(" "), "p_brand")).alias("name"),
        F.concat(F.lit("b:"), two).alias("series_id"), "popularity", F.lit(False).alias("is_main"),
    )
    return a.unionByName(b).unionByName(c)


@query(
    "mention_join_longest",
    f"""WITH {INDEX_SQL}, texts AS (SELECT l_orderkey AS text_id,
      {NORM.format(x="string_agg(CASE WHEN l_quantity > 25 THEN p_name || ' ' || p_type ELSE 'Saw ' || p_name || '!' END, ' and ' ORDER BY CASE WHEN l_quantity > 25 THEN p_name || ' ' || p_type ELSE 'Saw ' || p_name || '!' END)")} AS hay
      FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
    f AS (SELECT text_id, series_id, max((length(name), popularity, name)) AS best FROM texts JOIN names ON is_main AND length(name) >= 5 AND contains(hay, name) GROUP BY 1, 2),
    u AS (SELECT text_id, series_id, best[3] AS name, best[2] AS popularity FROM f)
    SELECT text_id, series_id, name, popularity FROM u WHERE NOT EXISTS (SELECT 1 FROM u o WHERE o.text_id = u.text_id AND o.name <> u.name AND contains(o.name, u.name))""",
)
def mention_join_longest(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type")
    said = F.when(F.col("l_quantity") > 25, F.concat("p_name", F.lit(" "), "p_type")).otherwise(F.concat(F.lit("Saw "), "p_name", F.lit("!")))
    texts = lines.join(p, "l_partkey").groupBy(F.col("l_orderkey").alias("text_id")).agg(
        F.array_join(F.array_sort(F.collect_list(said)), " and ").alias("text")
    )
    return catalog.mentions(texts, name_index(spark, sf_dir))


def fuzzy_sql(want: str) -> str:
    return f"""WITH {INDEX_SQL}, h AS (SELECT series_id, popularity, CASE WHEN name = '{want}' THEN 2 WHEN contains(name, '{want}')
      OR (length(name) >= 4 AND contains('{want}', name)) THEN 1 END AS rank FROM names),
    b AS (SELECT series_id, max((rank, popularity)) AS best FROM h WHERE rank IS NOT NULL GROUP BY 1)
    SELECT series_id, best[1] AS rank, best[2] AS popularity FROM b ORDER BY best DESC, series_id LIMIT 10"""


@query("fuzzy_title", fuzzy_sql("redwidget"))
def fuzzy_title(spark, sf_dir):
    return catalog.find_series(name_index(spark, sf_dir), "Red Widget!", 10)


@query("fuzzy_title_inside_query", fuzzy_sql("bluebolteconomyseason2"))
def fuzzy_title_inside_query(spark, sf_dir):
    return catalog.find_series(name_index(spark, sf_dir), "blue bolt ECONOMY season 2", 10)


@query(
    "mentioned_series",
    f"""WITH {INDEX_SQL}, f AS (SELECT series_id, max((length(name), popularity, name)) AS best FROM names
      WHERE is_main AND length(name) >= 5 AND contains('istartedbluebolteconomyandthensmallring', name) GROUP BY 1),
    u AS (SELECT series_id, best[3] AS name, best[2] AS popularity FROM f)
    SELECT series_id, name, popularity FROM u WHERE NOT EXISTS (SELECT 1 FROM u o WHERE o.name <> u.name AND contains(o.name, u.name))""",
)
def mentioned_series(spark, sf_dir):
    rows = catalog.mentioned_in(name_index(spark, sf_dir), "I started Blue Bolt: ECONOMY, and then small-ring.")
    return rows.select("series_id", "name", "popularity")


@query(
    "list_series",
    """SELECT 'c' || c_custkey AS series_id, CASE WHEN c_nationkey > 9 THEN 'K ' || c_name ELSE c_name END AS name,
    CASE WHEN c_acctbal > 0 THEN c_acctbal END AS popularity FROM customer
    ORDER BY CASE WHEN c_acctbal > 0 THEN c_acctbal END DESC NULLS LAST, 'c' || c_custkey LIMIT 50""",
)
def list_series(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), "c_custkey").alias("series_id"), F.col("c_name").alias("title"),
        F.when(F.col("c_nationkey") > 9, F.concat(F.lit("K "), "c_name")).alias("title_ko"),
        F.lit(None).cast("int").alias("total_episodes"), F.lit(None).cast("string").alias("poster_url"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("popularity"),
    )
    return catalog.list_series(c).select("series_id", "name", "popularity")


@query(
    "episode_labels",
    """SELECT l_orderkey AS abs_ep, CASE WHEN l_linenumber < 5 THEN l_linenumber || '기 ' || CAST(l_partkey AS INTEGER) || '화 ' ELSE '' END
      || '(전체 ' || l_orderkey || '화)' || CASE WHEN l_returnflag = 'N' THEN '' ELSE ' 〈' || l_returnflag || l_linestatus || '〉' END AS label FROM lineitem""",
)
def episode_labels(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    title = F.when(F.col("l_returnflag") != "N", F.concat("l_returnflag", "l_linestatus"))
    season = F.when(F.col("l_linenumber") < 5, F.col("l_linenumber"))
    label = t.episode_label(season, F.col("l_partkey"), F.col("l_orderkey"), title)
    return line.select(F.col("l_orderkey").alias("abs_ep"), label.alias("label"))


@query(
    "streaming_seasons",
    """SELECT CAST(n_nationkey AS INTEGER) AS tmdb_season, coalesce(CASE WHEN n_nationkey < 8 THEN n_name END, CASE WHEN n_nationkey < 16 THEN r_name END, n_nationkey || '기') AS name,
      n_name || ',' || n_regionkey AS providers FROM nation LEFT JOIN region ON r_regionkey = n_regionkey AND n_nationkey < 20""",
)
def streaming_seasons(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    streaming = n.select(
        F.lit("x").alias("series_id"), F.col("n_nationkey").alias("tmdb_season"), F.when(F.col("n_nationkey") < 8, F.col("n_name")).alias("season_name"),
        F.array("n_name", F.col("n_regionkey").cast("string")).alias("flatrate"), F.lit(None).alias("checked_at"), F.lit(None).alias("link"),
    )
    r = table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    seasons = n.filter("n_nationkey < 16").join(r, "n_regionkey").select(
        F.lit("x").alias("series_id"), F.col("n_nationkey").alias("tmdb_season"), F.col("r_name").alias("name_ko")
    )
    rows = catalog.streaming_of(streaming, seasons, "x")
    return rows.select("tmdb_season", "name", F.array_join("providers", ",").alias("providers"))


# ---- tags and recommendations ---------------------------------------------------------------------------------------
WANT_GENRES, WANT_TAGS = ["PROMO", "brand#3", "Brand#7"], ["Ring", "red", "BOLT"]


def part_series(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    series = p.select(F.concat(F.lit("p"), "p_partkey").alias("series_id"), F.col("p_retailprice").alias("popularity"))
    entries = p.select(
        F.concat(F.lit("p"), "p_partkey").alias("series_id"), F.lit(1).alias("order_in_series"), F.array("p_type", "p_brand", "p_type").alias("genres"),
        F.split("p_name", " ").alias("tags"), F.when(F.col("p_size") > 5, F.col("p_size")).alias("average_score"),
    )
    return series, entries


@query(
    "tag_overlap_topk",
    """WITH x AS (SELECT 'p' || p_partkey AS series_id, p_retailprice AS popularity, CASE WHEN p_size > 5 THEN p_size END AS average_score,
      2 * len(list_filter([p_type, p_brand, p_type], lambda g: lower(g) IN ('promo', 'brand#3', 'brand#7')))
        + len(list_filter(string_split(p_name, ' '), lambda g: lower(g) IN ('ring', 'red', 'bolt'))) AS overlap FROM part WHERE p_size <> 11)
    SELECT series_id, CAST(overlap AS INTEGER) AS overlap, average_score FROM x
    ORDER BY overlap DESC, average_score DESC NULLS LAST, popularity DESC NULLS LAST, series_id LIMIT 30""",
)
def tag_overlap_topk(spark, sf_dir):
    series, entries = part_series(spark, sf_dir)
    exclude = table(spark, sf_dir, "part").filter("p_size = 11").select(F.concat(F.lit("p"), "p_partkey").alias("series_id"))
    rows = catalog.similar_by_tags(series, entries, WANT_GENRES, WANT_TAGS, exclude)
    return rows.select("series_id", "overlap", "average_score")


@query(
    "recommend_pool",
    """WITH summaries AS (SELECT 'p' || doc_id AS series_id, doc_id, CASE WHEN lang = 'fr' THEN 3 END AS abs_ep, text FROM documents),
    watched AS (SELECT DISTINCT 'p' || user_id AS series_id FROM events WHERE value > 50),
    x AS (SELECT 'p' || p_partkey AS series_id, p_retailprice AS popularity, CASE WHEN p_size > 5 THEN p_size END AS average_score,
      2 * len(list_filter([p_type, p_brand, p_type], lambda g: lower(g) IN ('promo', 'brand#3', 'brand#7')))
        + len(list_filter(string_split(p_name, ' '), lambda g: lower(g) IN ('ring', 'red', 'bolt'))) AS overlap FROM part),
    pool AS (SELECT * FROM x WHERE series_id NOT IN (SELECT series_id FROM watched)
      ORDER BY overlap DESC, average_score DESC NULLS LAST, popularity DESC NULLS LAST, series_id LIMIT 120)
    SELECT pool.series_id, CAST(overlap AS INTEGER) AS overlap, md5(text) AS intro FROM pool JOIN summaries s USING (series_id)
    WHERE overlap > 0 AND abs_ep IS NULL""",
)
def recommend_pool(spark, sf_dir):
    series, entries = part_series(spark, sf_dir)
    chunks = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("p"), "doc_id").alias("series_id"), F.lit("summary").alias("type"), F.when(F.col("lang") == "fr", 3).alias("abs_ep"),
        F.col("doc_id").cast("string").alias("chunk_id"), "text",
    )
    watched = table(spark, sf_dir, "events").filter("value > 50").select(F.concat(F.lit("p"), "user_id").alias("series_id"))
    rows = reading.recommend(series, entries, chunks, WANT_GENRES, WANT_TAGS, watched=watched, count=30)
    return rows.select("series_id", "overlap", F.md5("intro").alias("intro"))


@query(
    "series_lookup",
    "SELECT 'c' || c_custkey AS series_id, CASE WHEN c_mktsegment = 'BUILDING' THEN c_name ELSE 'K ' || c_name END AS name FROM customer WHERE c_custkey = 7",
)
def series_lookup(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    series = c.select(F.concat(F.lit("c"), "c_custkey").alias("series_id"), F.col("c_name").alias("title"), F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.concat(F.lit("K "), "c_name")).alias("title_ko"))
    return catalog.series_info(series, "c7").select("series_id", "name")


@query(
    "episode_lookup",
    """SELECT o_orderkey, CASE WHEN o_orderpriority <> '3-MEDIUM' THEN substr(o_orderpriority, 1, 1) || '기 ' || o_orderkey % 100 || '화 ' ELSE '' END || '(전체 ' || o_orderkey % 1000 || '화)'
      || CASE WHEN o_orderkey % 2 = 0 THEN ' 〈Order ' || o_orderkey || '〉' WHEN o_orderkey % 3 > 0 THEN ' 〈F ' || o_orderkey || '〉' ELSE '' END AS label
    FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 1000 % 3 = 0""",
)
def episode_lookup(spark, sf_dir):
    key = F.col("o_orderkey")
    episodes = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderstatus").alias("series_id"), (key % 1000).cast("int").alias("abs_ep"),
        F.when(F.col("o_orderpriority") != "3-MEDIUM", F.substring("o_orderpriority", 1, 1).cast("int")).alias("tmdb_season"), (key % 100).cast("int").alias("tmdb_number"),
        F.lit("").alias("title_ko"), F.when(key % 2 == 0, F.concat(F.lit("Order "), key)).alias("title_en"), F.when(key % 3 > 0, F.concat(F.lit("F "), key)).alias("fandom_title"),
    )
    return catalog.episodes_of(episodes, "F", range(0, 1000, 3)).select("o_orderkey", "label")


# ---- reviews --------------------------------------------------------------------------------------------------------
def summary_sql(series_id: str, seen: int, budget: int) -> str:
    return f"""WITH {TEXT_CHUNKS_SQL}, r AS (SELECT * FROM chunks WHERE series_id = '{series_id}' AND type IN ('episode', 'plot') AND abs_ep BETWEEN 1 AND {seen}),
    f AS (SELECT CASE WHEN coalesce(sum(length(text)) FILTER (WHERE type = 'plot'), 0) <= {budget} THEN 'plot' ELSE 'episode' END AS prefer FROM r),
    p AS (SELECT *, row_number() OVER (PARTITION BY abs_ep ORDER BY (type = prefer) DESC, chunk_id) AS pick FROM r, f)
    SELECT chunk_id, type, abs_ep, CAST(greatest(200, {budget} // count(*) OVER ()) AS INTEGER) AS chars FROM p WHERE pick = 1"""


def summary(series_id: str, seen: int, budget: int):
    def run(spark, sf_dir):
        rows = reading.summary_context(text_chunks(spark, sf_dir), series_id, seen_ep=seen, budget=budget)
        return reading.assert_visible(rows, seen).select("chunk_id", "type", "abs_ep", "chars")

    return run


query("review_summary", summary_sql("src3", 45, 60_000))(summary("src3", 45, 60_000))
query("review_summary_tight_budget", summary_sql("src0", 40, 3_000))(summary("src0", 40, 3_000))


def last_sql(series_id: str, seen: int) -> str:
    return f"""WITH {TEXT_CHUNKS_SQL}, r AS (SELECT * FROM chunks WHERE series_id = '{series_id}' AND type IN ('episode', 'plot') AND abs_ep BETWEEN {seen - 2} AND {seen}),
    plots AS (SELECT * FROM r WHERE abs_ep = {seen} AND type = 'plot'),
    p AS (SELECT *, row_number() OVER (PARTITION BY abs_ep ORDER BY (type = 'episode') DESC, chunk_id) AS pick FROM r),
    o AS (SELECT chunk_id, type, abs_ep FROM p WHERE pick = 1 AND (abs_ep <> {seen} OR NOT EXISTS (SELECT 1 FROM plots))
          UNION ALL SELECT chunk_id, type, abs_ep FROM plots)
    SELECT *, CASE WHEN type = 'plot' THEN 60000 ELSE 1500 END AS chars FROM o"""


def last(series_id: str, seen: int):
    def run(spark, sf_dir):
        return reading.last_context(text_chunks(spark, sf_dir), series_id, seen_ep=seen).select("chunk_id", "type", "abs_ep", "chars")

    return run


query("review_last", last_sql("src4", 1))(last("src4", 1))
query("review_last_without_plot", last_sql("src8", 3))(last("src8", 3))


def of_record(series_id: str, seen_ep: int, total: int, budget: int, mode: str):
    """A review by the viewer's record, which lies beyond the known total."""

    def run(spark, sf_dir):
        chunks = text_chunks(spark, sf_dir)
        series = chunks.select("series_id").distinct().withColumn("total_episodes", F.lit(total))
        records = series.select(F.lit("u").alias("user_id"), "series_id", F.lit(seen_ep).alias("seen_ep"))
        said, rows = reading.review(chunks, series, records, series_id, user_id="u", mode=mode, budget=budget)
        return rows.select("chunk_id", "type", "abs_ep", "chars", F.lit(said["seen_ep"]).alias("seen_ep"))

    return run


query("review_capped_by_total", f"SELECT *, 30 AS seen_ep FROM ({summary_sql('src2', 30, 20_000)})")(of_record("src2", 999, 30, 20_000, "인물 관계"))
query("review_last_by_record", f"SELECT *, 4 AS seen_ep FROM ({last_sql('src5', 4)})")(of_record("src5", 9, 4, 60_000, "마지막 화"))


@query(
    "review_ask",
    f"""WITH {MEDIA_CHUNKS_SQL}, s AS (SELECT *, {sim(0)} AS score FROM chunks WHERE series_id = 'src6' AND type = 'event' AND embedding IS NOT NULL AND abs_ep <= 20),
    hits AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS place FROM s ORDER BY place LIMIT 8),
    top AS (SELECT abs_ep, min(place) AS place FROM hits GROUP BY 1 ORDER BY 2 LIMIT 3),
    plots AS (SELECT chunk_id, type, abs_ep FROM chunks WHERE series_id = 'src6' AND type = 'plot' AND abs_ep IN (SELECT abs_ep FROM top) AND abs_ep <= 20),
    o AS (SELECT * FROM plots UNION ALL SELECT chunk_id, type, abs_ep FROM hits WHERE abs_ep NOT IN (SELECT abs_ep FROM plots))
    SELECT *, CAST(60000 // count(*) OVER () AS INTEGER) AS chars FROM o""",
)
def review_ask(spark, sf_dir):
    rows = reading.ask_context(media_chunks(spark, sf_dir), "src6", vector_of(spark, sf_dir, 0), seen_ep=20)
    return rows.select("chunk_id", "type", "abs_ep", "chars")


# ---- dictionary -----------------------------------------------------------------------------------------------------
DICTIONARY_SQL = f"""pieces AS (SELECT doc_id, source, lang, n_chars, unnest({sql_paragraphs('text')}) AS piece,
    generate_subscripts({sql_paragraphs('text')}, 1) AS i FROM documents WHERE lang IN ('de', 'fr')),
dchunks AS (SELECT source || ':char:' || doc_id AS chunk_id, source AS series_id, 'character' AS type,
      CASE WHEN n_chars > 900 THEN CAST(doc_id // 20 AS INTEGER) END AS abs_ep, 'Head ' || doc_id || chr(10) || text AS text FROM documents WHERE lang IN ('en', 'es')
    UNION ALL SELECT source || ':wiki:Page: ' || doc_id || ':' || i, source, CASE lang WHEN 'de' THEN 'terminology' ELSE 'character' END,
      CASE WHEN n_chars > 900 THEN CAST(doc_id // 20 AS INTEGER) END, 'Head' || chr(10) || piece FROM pieces)"""


@query(
    "dictionary",
    f"""WITH {DICTIONARY_SQL}, r AS (SELECT * FROM dchunks WHERE series_id = 'src5' AND (abs_ep BETWEEN 1 AND 30 OR abs_ep IS NULL)),
    p AS (SELECT 'character' AS kind, coalesce(c_name, split_part(text, chr(10), 1)) AS name, substr(text, strpos(text, chr(10)) + 1) AS text, abs_ep AS first_ep,
      CASE WHEN c_acctbal > 0 THEN 'MAIN' WHEN c_acctbal <= 0 THEN 'SUPPORTING' END AS role
      FROM r LEFT JOIN customer ON c_custkey = CAST(split_part(chunk_id, ':', 3) AS BIGINT) WHERE chunk_id LIKE 'src5:char:%'),
    w AS (SELECT regexp_extract(chunk_id, '^src5:wiki:(.*):[^:]*$', 1) AS name, first(type ORDER BY chunk_id) AS type, first(abs_ep ORDER BY chunk_id) AS first_ep,
      string_agg(substr(text, strpos(text, chr(10)) + 1), chr(10) ORDER BY chunk_id) AS text FROM r WHERE chunk_id LIKE 'src5:wiki:%' GROUP BY 1),
    o AS (SELECT * FROM p UNION ALL SELECT CASE WHEN type = 'character' THEN 'appearance' ELSE 'term' END, name, {sql_strip('text')}, first_ep, NULL FROM w)
    SELECT kind, name, md5(text) AS digest, first_ep, role FROM o""",
)
def dictionary(spark, sf_dir):
    d = documents(spark, sf_dir)
    ep = F.when(F.col("n_chars") > 900, F.floor(F.col("doc_id") / 20).cast("int")).alias("abs_ep")
    source = F.array(F.struct(F.lit("src").alias("name"), F.lit("CC").alias("license"), F.lit(None).cast("string").alias("url"))).alias("sources")
    people = d.filter("lang IN ('en', 'es')").select(
        F.concat("source", F.lit(":char:"), "doc_id").alias("chunk_id"), F.col("source").alias("series_id"), F.lit("character").alias("type"), ep,
        F.concat(F.lit("Head "), "doc_id", F.lit("\n"), "text").alias("text"), source,
    )
    pages = d.filter("lang IN ('de', 'fr')").select("*", F.posexplode(t.paragraphs("text")).alias("i", "piece")).select(
        F.concat("source", F.lit(":wiki:Page: "), "doc_id", F.lit(":"), F.col("i") + 1).alias("chunk_id"), F.col("source").alias("series_id"),
        F.when(F.col("lang") == "de", "terminology").otherwise("character").alias("type"), ep, F.concat(F.lit("Head\n"), "piece").alias("text"), source,
    )
    cards = table(spark, sf_dir, "customer").select(
        F.lit("src5").alias("series_id"), F.col("c_custkey").alias("char_id"), F.col("c_name").alias("name"),
        F.when(F.col("c_acctbal") > 0, "MAIN").otherwise("SUPPORTING").alias("role"), F.lit(None).cast("string").alias("image_url"),
    )
    rows = reading.dictionary(people.unionByName(pages), cards, "src5", seen_ep=30)
    return rows.select("kind", "name", F.md5("text").alias("digest"), "first_ep", "role")
