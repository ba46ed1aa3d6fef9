"""Evaluation, embedding and incremental runs."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F, types as T

from episodika.operators import vectors
from episodika.operators.gate import ALL_EPISODES
from episodika.plans import chunkers, embedding, evaluate, vector_store
from episodika.plans.derived import TEXT_CHUNKS_SQL, VECTOR_CHUNKS_SQL, documents, table, text_chunks, vector_chunks
from episodika.plans.registry.base import query
from episodika.plans.registry.retrieval import QUESTIONS_SQL
from episodika.session import shared_folder
from episodika.sources.landing import after_mark, first_writer, items_of, json_document, resume_after
from episodika.sources.tables import read_table
from episodika.streaming import incremental

GOLD_SQL = f"""{VECTOR_CHUNKS_SQL}, {QUESTIONS_SQL},
gold AS (SELECT CAST(q.label AS VARCHAR) AS query_id, 's' || q.label AS series_id, arg_max(abs_ep, c.vec_id) FILTER (WHERE abs_ep IS NOT NULL) AS gold_ep, any_value(q) AS q
  FROM questions q JOIN chunks c ON c.series_id = 's' || q.label GROUP BY q.label),
scored AS (SELECT g.query_id, g.series_id AS home, g.gold_ep, c.series_id, c.abs_ep, c.type, c.chunk_id, list_cosine_similarity(c.embedding, g.q) AS score
  FROM gold g, chunks c WHERE c.abs_ep IS NOT NULL)"""


def questions(spark, sf_dir):
    """First vector of every label as question, the episode of its last one as gold: query_id, series_id, gold, vector."""
    rows = vector_chunks(spark, sf_dir).groupBy("series_id").agg(
        F.min_by("embedding", "vec_id").alias("v"),
        F.max_by("abs_ep", F.when(F.col("abs_ep").isNotNull(), F.col("vec_id"))).alias("ep"),
    )
    return rows.select(F.substring("series_id", 2, 99).alias("query_id"), "series_id", F.array("ep").alias("gold"), F.col("v").alias("vector"))


@query(
    "exact_gold_ranks",
    "WITH " + GOLD_SQL + """, e AS (SELECT query_id, home, gold_ep, series_id, abs_ep, max(score) AS score FROM scored GROUP BY ALL),
    b AS (SELECT query_id, max(score) FILTER (WHERE series_id = home AND abs_ep = gold_ep) AS gold, max(score) FILTER (WHERE series_id = home) AS own FROM e GROUP BY 1)
    SELECT query_id, CAST(1 + count(*) FILTER (WHERE series_id = home AND score > gold) AS INTEGER) AS in_series,
      CAST(1 + count(*) FILTER (WHERE score > gold) AS INTEGER) AS "global",
      CAST(1 + count(DISTINCT CASE WHEN series_id <> home AND score > own THEN series_id END) AS INTEGER) AS series FROM e JOIN b USING (query_id) GROUP BY query_id""",
)
def exact_gold_ranks(spark, sf_dir):
    return evaluate.exact_ranks(vector_chunks(spark, sf_dir), questions(spark, sf_dir))


def list_ranks(spark, sf_dir, types):
    asked = questions(spark, sf_dir)
    hits = vectors.search_many(
        vector_chunks(spark, sf_dir), asked, watched={}, unrecorded=ALL_EPISODES, types=types, k=60
    )
    gold = asked.select("query_id", "series_id", F.explode("gold").alias("abs_ep"))
    return evaluate.rank_in_hits(hits, gold)


def ranks_sql(method: str, where: str) -> str:
    return f"""{method}_h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM
      (SELECT g.query_id, g.series_id AS home, g.gold_ep, c.series_id, c.abs_ep, c.chunk_id, list_cosine_similarity(c.embedding, g.q) AS score FROM gold g, chunks c WHERE {where})),
    {method}_e AS (SELECT query_id, home, gold_ep, series_id, abs_ep, min(rank) AS at_ FROM {method}_h WHERE rank <= 60 AND abs_ep IS NOT NULL GROUP BY ALL),
    {method}_p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY at_) AS place FROM {method}_e),
    {method}_s AS (SELECT query_id, home, series_id, row_number() OVER (PARTITION BY query_id ORDER BY min(at_)) AS place FROM {method}_e GROUP BY query_id, home, series_id),
    {method} AS (SELECT '{method}' AS method, g.query_id, min(p.place) AS rank, min(s.place) AS series_place FROM gold g LEFT JOIN {method}_p p ON p.query_id = g.query_id AND p.series_id = g.series_id AND p.abs_ep = g.gold_ep
      LEFT JOIN {method}_s s ON s.query_id = g.query_id AND s.series_id = g.series_id GROUP BY 2)"""


RANKS_SQL = "WITH " + GOLD_SQL + ", " + ranks_sql("event", "c.type = 'event'") + ", " + ranks_sql("every", "TRUE") + ", r AS (SELECT * FROM event UNION ALL SELECT * FROM every)"


def all_ranks(spark, sf_dir):
    a = list_ranks(spark, sf_dir, ["event"]).withColumn("method", F.lit("event"))
    b = list_ranks(spark, sf_dir, None).withColumn("method", F.lit("every"))
    return a.unionByName(b).withColumnRenamed("episode_rank", "rank")


@query("ranks_in_hit_lists", RANKS_SQL + " SELECT method, query_id, CAST(rank AS INTEGER) AS rank, CAST(series_place AS INTEGER) AS series_rank FROM r")
def ranks_in_hit_lists(spark, sf_dir):
    return all_ranks(spark, sf_dir).select("method", "query_id", "rank", "series_rank")


@query(
    "hit_rates",
    RANKS_SQL + """ SELECT method, count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS hit1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0 END), 6) AS hit3,
    round(avg(CASE WHEN rank <= 8 THEN 1.0 ELSE 0 END), 6) AS hit8, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM r GROUP BY method""",
)
def hit_rates(spark, sf_dir):
    return evaluate.summarize(all_ranks(spark, sf_dir))


@query(
    "paired_wins",
    RANKS_SQL + """, p AS (SELECT coalesce(a.rank, 1000000) AS x, coalesce(b.rank, 1000000) AS y FROM event a JOIN every b USING (query_id))
    SELECT count(*) FILTER (WHERE x < y) AS win, count(*) FILTER (WHERE x > y) AS lose, count(*) FILTER (WHERE x = y) AS tie FROM p""",
)
def paired_wins(spark, sf_dir):
    return evaluate.paired(all_ranks(spark, sf_dir), "event", "every")


@query(
    "verdict_histogram",
    """WITH r AS (SELECT event_type AS style, CASE WHEN value > 20 THEN 'right' WHEN value > 5 THEN 'asked back' ELSE 'wrong' END AS verdict, value AS seconds FROM events),
    b AS (SELECT style AS grp, verdict, seconds FROM r UNION ALL SELECT 'all', verdict, seconds FROM r),
    t AS (SELECT grp, round(avg(seconds), 2) AS mean_seconds, count(*) AS n FROM b GROUP BY 1)
    SELECT grp AS "group", verdict, count(*) AS questions, any_value(mean_seconds) AS mean_seconds, any_value(n) AS n FROM b JOIN t USING (grp) GROUP BY 1, 2""",
)
def verdict_histogram(spark, sf_dir):
    verdict = F.when(F.col("value") > 20, "right").when(F.col("value") > 5, "asked back").otherwise("wrong")
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("style"), verdict.alias("verdict"), F.col("value").alias("seconds"))
    return evaluate.verdicts(e)


@query(
    "question_sample",
    f"""WITH {TEXT_CHUNKS_SQL}, s AS (SELECT * FROM chunks WHERE type = 'event' AND abs_ep IS NOT NULL AND length(text) BETWEEN 400 AND 900),
    o AS (SELECT *, row_number() OVER (PARTITION BY series_id, abs_ep ORDER BY md5('7:' || chunk_id), chunk_id) AS one FROM s),
    p AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY md5('7:' || series_id || ':' || abs_ep), abs_ep) AS some_ FROM o WHERE one = 1)
    SELECT series_id, abs_ep, chunk_id FROM p WHERE some_ <= 12""",
)
def question_sample(spark, sf_dir):
    return evaluate.sample_questions(text_chunks(spark, sf_dir)).select("series_id", "abs_ep", "chunk_id")


# ---- embedding ------------------------------------------------------------------------------------------------------
def letter_encoder():
    """A stand-in model with a known answer: how often each vowel occurs."""
    return lambda texts: np.array([[text.count(v) for v in "aeiou"] for text in texts], dtype=np.float64)


def _count(v: str) -> str:
    return f"CAST(length(text) - length(replace(text, '{v}', '')) AS DOUBLE)"


@query(
    "incremental_embedding",
    f"""WITH v AS (SELECT doc_id, [{', '.join(_count(v) for v in 'aeiou')}] AS x FROM documents LEFT JOIN embeddings ON vec_id = doc_id WHERE vec_id IS NULL AND lang IN ('en', 'de')),
    u AS (SELECT doc_id, x, sqrt(list_sum(list_transform(x, lambda y: y * y))) AS n FROM v)
    SELECT CAST(doc_id AS VARCHAR) AS chunk_id, round(CASE WHEN n > 0 THEN x[1] / n ELSE 0 END, 4) AS a, round(CASE WHEN n > 0 THEN x[5] / n ELSE 0 END, 4) AS u FROM u""",
)
def incremental_embedding(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    chunks = table(spark, sf_dir, "documents").join(e, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("chunk_id"), F.col("lang").alias("type"), "text", "embedding"
    )
    fresh = embedding.embed(chunks, letter_encoder, ["en", "de"])
    value = lambda i, name: F.round(F.col("embedding")[i].cast("double"), 4).alias(name)
    return fresh.select("chunk_id", value(0, "a"), value(4, "u"))


@query(
    "content_addressed_vectors",
    f"""WITH u AS (SELECT doc_id, [{', '.join(_count(v) for v in 'aeiou')}] AS x FROM documents), s AS (SELECT doc_id, x, sqrt(list_sum(list_transform(x, lambda y: y * y))) AS n FROM u),
    d AS (SELECT count(DISTINCT coalesce(text, '')) AS first_run FROM documents)
    SELECT doc_id, round(CASE WHEN n > 0 THEN x[1] / n ELSE 0 END, 4) AS a, round(CASE WHEN n > 0 THEN x[5] / n ELSE 0 END, 4) AS u, first_run, 0 AS second_run FROM s, d""",
)
def content_addressed_vectors(spark, sf_dir):
    """Every distinct text is encoded once; a second run over the same texts, under other ids, encodes nothing."""
    store = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    first = vector_store.encode_missing(d, store, "vowels", letter_encoder)
    second = vector_store.encode_missing(d.withColumn("doc_id", -F.col("doc_id")), store, "vowels", letter_encoder)
    value = lambda i, name: F.round(F.col("embedding")[i].cast("double"), 4).alias(name)
    return vector_store.with_vectors(d, store, "vowels").select("doc_id", value(0, "a"), value(4, "u"), F.lit(first).alias("first_run"), F.lit(second).alias("second_run"))


@query(
    "vectors_filled_in",
    f"""WITH u AS (SELECT doc_id, [{', '.join(_count(v) for v in 'aeiou')}] AS x FROM documents), s AS (SELECT doc_id, x, sqrt(list_sum(list_transform(x, lambda y: y * y))) AS n FROM u)
    SELECT s.doc_id, round(CASE WHEN vec_id IS NOT NULL THEN CAST(embedding[1] AS DOUBLE) WHEN n > 0 THEN x[1] / n ELSE 0 END, 4) AS first FROM s LEFT JOIN embeddings ON vec_id = doc_id""",
)
def vectors_filled_in(spark, sf_dir):
    """Chunks after an embedding run: stored vectors stay, missing ones are filled in."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    chunks = table(spark, sf_dir, "documents").join(e, "doc_id", "left").select("doc_id", F.col("doc_id").cast("string").alias("chunk_id"), F.lit("event").alias("type"), "text", "embedding")
    rows = embedding.with_new_vectors(chunks, embedding.embed(chunks, letter_encoder))
    return rows.select("doc_id", F.round(F.col("embedding")[0].cast("double"), 4).alias("first"))


@query("landed_items", "SELECT doc_id, lang, source FROM documents")
def landed_items(spark, sf_dir):
    """JSON documents, one of each source, read back as their items."""
    folder = f"{shared_folder(spark)}/landed-{uuid.uuid4().hex}"
    d = table(spark, sf_dir, "documents").select("source", F.struct("doc_id", "lang").alias("item"))
    d.groupBy("source").agg(F.collect_list("item").alias("data")).write.partitionBy("source").json(folder)
    landed = json_document(spark, folder, T.StructType.fromDDL("data array<struct<doc_id:long,lang:string>>, source string"))
    return items_of(landed.withColumn("data", F.transform("data", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["lang"].alias("lang"), F.col("source").alias("source")))))


@query("directory_map", "SELECT p_brand, arg_min(p_name, p_partkey) AS p_name FROM part GROUP BY 1")
def directory_map(spark, sf_dir):
    return first_writer(table(spark, sf_dir, "part"), "p_brand", "p_name", "p_partkey")


# no SQL check: one of the five methods chooses cuts one after the other; a test compares ranks with brute force
@query("chunker_comparison")
def chunker_comparison(spark, sf_dir):
    """Scenes of the sample as questions, the texts of all English documents as plots."""
    store = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    scenes = text_chunks(spark, sf_dir).filter("type = 'event'")
    plots = scenes.groupBy("series_id", "abs_ep").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"]), "\n").alias("plot"))
    plots = plots.withColumn("head", F.concat("series_id", F.lit(" "), "abs_ep"))
    asked = evaluate.sample_questions(scenes).select(F.col("chunk_id").alias("query_id"), "series_id", F.array("abs_ep").alias("gold"), F.substring("text", 1, 200).alias("text"))
    return chunkers.summary(chunkers.compare(plots, asked, store, "vowels", letter_encoder))


# no SQL check: cuts are chosen one after the other; a test compares with hand-made sentences
@query("chunk_semantic")
def chunk_semantic(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", "text")
    rows = embedding.semantic_pieces(d, "text", letter_encoder)
    return rows.select("doc_id", F.posexplode("pieces").alias("i", "piece")).select("doc_id", "i", F.length("piece").alias("n"))


# ---- incremental runs -----------------------------------------------------------------------------------------------
EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
    ]
)


@query(
    "stream_incremental_upsert",
    "SELECT user_id, event_type, max(event_id) AS event_id, round(arg_max(value, (ts, event_id)), 4) AS value FROM events GROUP BY 1, 2",
)
def stream_incremental_upsert(spark, sf_dir):
    folder = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    stored = T.StructType([f for f in EVENT_SCHEMA.fields if f.name != "props"])
    stream = incremental.changes_from(spark, sf_dir, EVENT_SCHEMA, "events.parquet")
    apply = incremental.upsert_into(spark, f"{folder}/table", stored, ["user_id", "event_type"], ["ts", "event_id"])
    incremental.run_available(stream, apply, f"{folder}/checkpoint")
    # a second run finds nothing new and leaves the table as it is
    incremental.run_available(stream, apply, f"{folder}/checkpoint")
    return read_table(spark, f"{folder}/table", stored).select("user_id", "event_type", "event_id", F.round("value", 4).alias("value"))


@query(
    "stream_two_sources",
    """WITH changes AS (SELECT user_id AS k, event_id AS stamp, value FROM events UNION ALL SELECT o_custkey, o_orderkey, o_totalprice FROM orders)
    SELECT k, max(stamp) AS stamp, round(arg_max(value, (stamp, value)), 4) AS value FROM changes WHERE k IS NOT NULL GROUP BY k""",
)
def stream_two_sources(spark, sf_dir):
    """Two sources write to one table; both begin with a batch of number 0."""
    folder = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    schema = T.StructType.fromDDL("k long, stamp long, value double")
    apply = incremental.upsert_into(spark, f"{folder}/table", schema, ["k"], ["stamp", "value"], buckets=8)
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("stamp"), F.col("value").cast("double"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("stamp"), F.col("o_totalprice").cast("double").alias("value"))
    for source in (events, orders):
        apply(source.filter("k IS NOT NULL"), 0)
    return read_table(spark, f"{folder}/table", schema).select("k", "stamp", F.round("value", 4).alias("value"))


@query(
    "stream_key_types",
    """WITH changes AS (SELECT CAST(o_custkey AS VARCHAR) AS name, CAST(o_orderdate AS DATE) AS day, o_orderkey AS stamp, o_totalprice AS value FROM orders
      UNION ALL SELECT CAST(user_id AS VARCHAR), CAST(ts AS DATE), event_id, value FROM events)
    SELECT name, day, max(stamp) AS stamp, round(arg_max(value, (stamp, value)), 4) AS value FROM changes WHERE name IS NOT NULL AND day IS NOT NULL GROUP BY name, day""",
)
def stream_key_types(spark, sf_dir):
    """Changes whose keys have other types than the table's: integers for text, times for days."""
    folder = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    schema = T.StructType.fromDDL("name string, day date, stamp long, value double")
    apply = incremental.upsert_into(spark, f"{folder}/table", schema, ["name", "day"], ["stamp", "value"], buckets=16)
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("name"), F.col("o_orderdate").alias("day"), F.col("o_orderkey").alias("stamp"), F.col("o_totalprice").alias("value"))
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("int").alias("name"), F.col("ts").alias("day"), F.col("event_id").cast("int").alias("stamp"), F.col("value").alias("value"))
    for source in (orders, events):
        apply(source.filter("name IS NOT NULL AND day IS NOT NULL"), 0)
    return read_table(spark, f"{folder}/table", schema).select("name", "day", "stamp", F.round("value", 4).alias("value"))


@query(
    "scan_resume",
    """WITH m AS (SELECT lang AS wiki, max(source || ' ' || doc_id) AS mark FROM documents WHERE source < 'src4' GROUP BY 1)
    SELECT lang AS wiki, source || ' ' || doc_id AS title FROM documents d LEFT JOIN m ON m.wiki = d.lang WHERE mark IS NULL OR replace(source || ' ' || doc_id, ' ', '_') > replace(mark, ' ', '_')""",
)
def scan_resume(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("wiki"), F.concat("source", F.lit(" "), "doc_id").alias("title"))
    marks = resume_after(d.filter("title < 'src4'"))
    return after_mark(d, marks)
