"""Gated vector, keyword and range retrieval, fusion and the decision rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodika.operators import gate, keywords, vector_index, vectors
from episodika.operators.gate import ALL_EPISODES
from episodika.plans.derived import (
    TEXT_CHUNKS_SQL,
    TEXT_WATCHED,
    VECTOR_CHUNKS_SQL,
    VECTOR_WATCHED,
    gated_sql,
    table,
    text_chunks,
    text_of,
    vector_chunks,
    vector_of,
)
from episodika.plans.registry.base import query
from episodika.session import stored_once


def score6(name: str = "score"):
    return F.round(name, 6).alias(name)


def vgate(unrecorded: int, extra: str = "TRUE") -> str:
    return gated_sql(unrecorded, extra, VECTOR_WATCHED, VECTOR_CHUNKS_SQL)


def tgate(unrecorded: int, extra: str = "TRUE") -> str:
    return gated_sql(unrecorded, extra, TEXT_WATCHED, TEXT_CHUNKS_SQL)


def sim(vec_id: int) -> str:
    return (
        "list_cosine_similarity(embedding, "
        f"(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = {vec_id}))"
    )


@query(
    "gated_vector_topk",
    vgate(0, "c.type IN ('event')")
    + f""" SELECT chunk_id, series_id, abs_ep, round({sim(0)}, 6) AS score FROM g
    ORDER BY {sim(0)} DESC, chunk_id LIMIT 10""",
)
def gated_vector_topk(spark, sf_dir):
    hits = vectors.search(vector_chunks(spark, sf_dir), vector_of(spark, sf_dir, 0), watched=VECTOR_WATCHED, k=10)
    return hits.select("chunk_id", "series_id", "abs_ep", score6())


@query(
    "gated_vector_topk_all_types",
    vgate(ALL_EPISODES)
    + f""" SELECT chunk_id, series_id, type, abs_ep, round({sim(1)}, 6) AS score FROM g
    ORDER BY {sim(1)} DESC, chunk_id LIMIT 30""",
)
def gated_vector_topk_all_types(spark, sf_dir):
    hits = vectors.search(
        vector_chunks(spark, sf_dir),
        vector_of(spark, sf_dir, 1),
        watched=VECTOR_WATCHED,
        unrecorded=ALL_EPISODES,
        types=None,
        k=30,
    )
    return hits.select("chunk_id", "series_id", "type", "abs_ep", score6())


@query(
    "gated_vector_topk_in_series",
    vgate(ALL_EPISODES, "c.series_id = 's3' AND c.type IN ('event', 'plot')")
    + f""" SELECT chunk_id, series_id, type, abs_ep, round({sim(2)}, 6) AS score FROM g
    ORDER BY {sim(2)} DESC, chunk_id LIMIT 20""",
)
def gated_vector_topk_in_series(spark, sf_dir):
    hits = vectors.search(
        vector_chunks(spark, sf_dir),
        vector_of(spark, sf_dir, 2),
        watched=VECTOR_WATCHED,
        unrecorded=ALL_EPISODES,
        series_id="s3",
        types=["event", "plot"],
        k=20,
    )
    return hits.select("chunk_id", "series_id", "type", "abs_ep", score6())


@query(
    "gated_vector_topk_watched_table",
    f"""WITH {VECTOR_CHUNKS_SQL},
    watched AS (SELECT 's' || n_regionkey AS series_id, CAST(max(n_nationkey) AS INTEGER) AS seen_ep FROM nation GROUP BY 1)
    SELECT chunk_id, c.series_id, abs_ep, round({sim(4)}, 6) AS score
    FROM chunks c LEFT JOIN watched w ON w.series_id = c.series_id
    WHERE type = 'event' AND (abs_ep IS NULL OR abs_ep <= coalesce(w.seen_ep, 0))
    ORDER BY {sim(4)} DESC, chunk_id LIMIT 15""",
)
def gated_vector_topk_watched_table(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    watched = nation.groupBy(F.concat(F.lit("s"), "n_regionkey").alias("series_id")).agg(
        F.max("n_nationkey").alias("seen_ep")
    )
    hits = vectors.search(vector_chunks(spark, sf_dir), vector_of(spark, sf_dir, 4), watched=watched, k=15)
    return hits.select("chunk_id", "series_id", "abs_ep", score6())


@query(
    "vector_topk_per_series",
    vgate(ALL_EPISODES, "c.type = 'event'")
    + f""", s AS (SELECT chunk_id, series_id, abs_ep, {sim(3)} AS score FROM g),
    r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY score DESC, chunk_id) AS rank_in_series FROM s)
    SELECT series_id, chunk_id, abs_ep, CAST(rank_in_series AS INTEGER) AS rank_in_series, round(score, 6) AS score
    FROM r WHERE rank_in_series <= 20""",
)
def vector_topk_per_series(spark, sf_dir):
    hits = vectors.search_per_series(
        vector_chunks(spark, sf_dir),
        vector_of(spark, sf_dir, 3),
        watched=VECTOR_WATCHED,
        unrecorded=ALL_EPISODES,
        k=20,
    )
    return hits.select("series_id", "chunk_id", "abs_ep", "rank_in_series", score6())


def label_questions(spark, sf_dir):
    """The first stored vector of every label as a question: query_id, vector."""
    e = table(spark, sf_dir, "embeddings")
    return e.groupBy(F.col("label").cast("string").alias("query_id")).agg(F.min_by("embedding", "vec_id").alias("vector"))


QUESTIONS_SQL = """questions AS (
  SELECT label, min(vec_id) AS vec_id, CAST(arg_min(embedding, vec_id) AS DOUBLE[]) AS q FROM embeddings GROUP BY label)"""


@query(
    "vector_topk_batch",
    vgate(ALL_EPISODES)
    + f""", {QUESTIONS_SQL},
    s AS (SELECT q.label, g.chunk_id, g.abs_ep, list_cosine_similarity(g.embedding, q.q) AS score FROM questions q, g),
    r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, chunk_id) AS rank FROM s)
    SELECT CAST(label AS VARCHAR) AS query_id, chunk_id, abs_ep, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score
    FROM r WHERE rank <= 25""",
)
def vector_topk_batch(spark, sf_dir):
    hits = vectors.search_many(
        vector_chunks(spark, sf_dir), label_questions(spark, sf_dir), watched=VECTOR_WATCHED, unrecorded=ALL_EPISODES, types=None, k=25
    )
    return hits.select("query_id", "chunk_id", "abs_ep", "rank", score6())


@query(
    "vector_topk_cells",
    vgate(0, "c.type = 'event'")
    + f""" SELECT chunk_id, series_id, abs_ep, round({sim(5)}, 6) AS score FROM g
    ORDER BY {sim(5)} DESC, chunk_id LIMIT 10""",
)
def vector_topk_cells(spark, sf_dir):
    chunks = vector_chunks(spark, sf_dir)
    centres = vector_index.choose_centres(chunks, 10)
    cells = vectors.build_cells(chunks, centres)
    hits = vectors.search_cells(
        cells, centres, vectors.cell_radii(cells), vector_of(spark, sf_dir, 5), watched=VECTOR_WATCHED, k=10
    )
    return hits.select("chunk_id", "series_id", "abs_ep", score6())


@query(
    "vector_topk_stored",
    vgate(0, "c.type = 'event'")
    + f""" SELECT chunk_id, series_id, abs_ep, round({sim(5)}, 6) AS score FROM g
    ORDER BY {sim(5)} DESC, chunk_id LIMIT 10""",
)
def vector_topk_stored(spark, sf_dir):
    """Through an index on disk, made in two additions the first time and read by later calls."""
    chunks = vector_chunks(spark, sf_dir)

    def write(path):
        vector_index.create(chunks.filter("vec_id % 3 <> 0"), path, vector_index.choose_centres(chunks, 32))
        vector_index.add(chunks, path)
        vector_index.add(chunks, path)  # comes again and changes nothing

    path = stored_once(spark, "vector-index", sf_dir, write)
    hits = vector_index.search(spark, path, vector_of(spark, sf_dir, 5), watched=VECTOR_WATCHED, k=10)
    return hits.select("chunk_id", "series_id", "abs_ep", score6())


@query(
    "gated_range_read",
    f"""WITH {TEXT_CHUNKS_SQL}
    SELECT chunk_id, type, abs_ep, length(text) AS n_chars, md5(text) AS digest FROM chunks
    WHERE series_id = 'src3' AND type IN ('event', 'plot', 'character')
      AND ((abs_ep BETWEEN 3 AND 40) OR abs_ep IS NULL)""",
)
def gated_range_read(spark, sf_dir):
    rows = gate.read_range(
        text_chunks(spark, sf_dir),
        "src3",
        seen_ep=40,
        from_ep=3,
        types=["event", "plot", "character"],
        include_episode_free=True,
    )
    return rows.select("chunk_id", "type", "abs_ep", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


@query(
    "gate_completeness",
    tgate(0) + " SELECT series_id, type, count(*) AS visible, max(abs_ep) AS last_ep, CAST(0 AS BIGINT) AS leaked FROM g GROUP BY 1, 2",
)
def gate_completeness(spark, sf_dir):
    rows = gate.visible(text_chunks(spark, sf_dir), watched=TEXT_WATCHED)
    hidden = gate.leaks(rows, watched=TEXT_WATCHED).groupBy("series_id", "type").agg(F.count("*").alias("leaked"))
    counts = rows.groupBy("series_id", "type").agg(F.count("*").alias("visible"), F.max("abs_ep").alias("last_ep"))
    return counts.join(hidden, ["series_id", "type"], "left").select(
        "series_id", "type", "visible", "last_ep", F.coalesce("leaked", F.lit(0)).cast("long").alias("leaked")
    )


STOP_SQL = ", ".join(f"'{w}'" for w in sorted(keywords.STOP_WORDS))


def keyword_sql(gated: str, item_id: int, k: int, columns: str = "chunk_id, series_id, abs_ep") -> str:
    return (
        gated
        + f""", terms AS (
      SELECT DISTINCT t FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]{{2,}}')) AS t
                              FROM benchmark WHERE item_id = {item_id}) WHERE t NOT IN ({STOP_SQL})),
    words AS (SELECT chunk_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'))) AS t FROM g),
    hits AS (SELECT w.chunk_id, w.t FROM words w JOIN terms USING (t)),
    idf AS (SELECT t, ln(1 + ((SELECT count(*) FROM g) - count(*) + 0.5) / (count(*) + 0.5)) AS weight FROM hits GROUP BY t),
    scored AS (SELECT chunk_id, sum(weight) AS score FROM hits JOIN idf USING (t) GROUP BY chunk_id),
    best AS (SELECT g.*, score FROM scored JOIN g USING (chunk_id) ORDER BY round(score, 9) DESC, chunk_id LIMIT {k})
    SELECT {columns}, round(score, 6) AS score FROM best"""
    )


@query("keyword_idf_topk", keyword_sql(tgate(ALL_EPISODES, "c.type IN ('event', 'plot')"), 0, 20))
def keyword_idf_topk(spark, sf_dir):
    hits = keywords.search(
        text_chunks(spark, sf_dir),
        [text_of(spark, sf_dir, 0)],
        watched=TEXT_WATCHED,
        unrecorded=ALL_EPISODES,
        series_ids=None,
        types=["event", "plot"],
        analyzer="simple",
    )
    return hits.select("chunk_id", "series_id", "abs_ep", score6())


@query("keyword_idf_gated_statistics", keyword_sql(tgate(0, "c.type IN ('event', 'character', 'episode')"), 2, 20))
def keyword_idf_gated_statistics(spark, sf_dir):
    hits = keywords.search(
        text_chunks(spark, sf_dir),
        [text_of(spark, sf_dir, 2)],
        watched=TEXT_WATCHED,
        series_ids=None,
        types=["event", "character", "episode"],
        analyzer="simple",
    )
    return hits.select("chunk_id", "series_id", "abs_ep", score6())


@query(
    "keyword_idf_postings",
    keyword_sql(tgate(ALL_EPISODES, "c.type IN ('event', 'plot') AND c.series_id IN ('src0', 'src2', 'src5', 'src9')"), 1, 20),
)
def keyword_idf_postings(spark, sf_dir):
    chunks = text_chunks(spark, sf_dir)
    hits = keywords.search_postings(
        keywords.build_postings(chunks, "simple"),
        chunks,
        [text_of(spark, sf_dir, 1)],
        watched=TEXT_WATCHED,
        unrecorded=ALL_EPISODES,
        series_ids=["src0", "src2", "src5", "src9"],
        types=["event", "plot"],
        analyzer="simple",
    )
    return hits.select("chunk_id", "series_id", "abs_ep", score6())


#: all words of the texts that have the stems of these questions' words; pinned, as SQL cannot stem
STEMS = {
    "thin": ["thin", "thinly", "thinlyed", "thinlying"], "thea": ["thea", "theaed", "theaedly", "theaing", "theaingly"],
    "onr": ["onr", "onre", "onrely", "onreing", "onreingly", "onrelying"], "thti": ["thti", "thtied", "thtiedly", "thties", "thtiing", "thtiingly"],
}
STEM_QUESTION = ["Thinly, the theaing of it", "onrely thtied"]


def stemmed_sql(gated: str, k: int) -> str:
    words = ", ".join(f"('{w}', '{s}')" for s, ws in STEMS.items() for w in ws)
    return f"""{gated}, stems(word, stem) AS (VALUES {words}),
    m AS (SELECT DISTINCT chunk_id, stem FROM (SELECT chunk_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS word FROM g) JOIN stems USING (word)),
    n AS (SELECT count(*) AS total FROM g), d AS (SELECT stem, count(*) AS df FROM m GROUP BY 1),
    s AS (SELECT chunk_id, sum(ln(1 + (total - df + 0.5) / (df + 0.5))) AS score FROM m JOIN d USING (stem), n GROUP BY 1)
    SELECT s.chunk_id, series_id, abs_ep, round(score, 6) AS score FROM s JOIN g ON g.chunk_id = s.chunk_id ORDER BY s.score DESC, s.chunk_id LIMIT {k}"""


@query("keyword_stemmed_words", stemmed_sql(tgate(ALL_EPISODES, "c.type IN ('event', 'plot')"), 25))
def keyword_stemmed_words(spark, sf_dir):
    hits = keywords.search(text_chunks(spark, sf_dir), STEM_QUESTION, watched=TEXT_WATCHED, unrecorded=ALL_EPISODES, series_ids=None, types=["event", "plot"], k=25)
    return hits.select("chunk_id", "series_id", "abs_ep", score6())


@query("keyword_stored_index", stemmed_sql(tgate(ALL_EPISODES, "c.type IN ('event', 'plot')"), 25))
def keyword_stored_index(spark, sf_dir):
    """Through postings on disk, made the first time and read by later calls."""
    path = stored_once(spark, "keyword-index", sf_dir, lambda path: keywords.write_index(text_chunks(spark, sf_dir), path, 16))
    hits = keywords.search_index(spark, path, STEM_QUESTION, watched=TEXT_WATCHED, unrecorded=ALL_EPISODES, series_ids=None, types=["event", "plot"], k=25)
    return hits.select("chunk_id", "series_id", "abs_ep", score6())


# no SQL check: stems of a whole passage; ``keyword_stemmed_words`` has the check by pinned stems
@query("keyword_stemmed_topk")
def keyword_stemmed_topk(spark, sf_dir):
    hits = keywords.search(
        text_chunks(spark, sf_dir),
        [text_of(spark, sf_dir, 0)],
        watched=TEXT_WATCHED,
        unrecorded=ALL_EPISODES,
        series_ids=None,
        types=["event"],
    )
    return hits.select("chunk_id", "series_id", "abs_ep", score6())


@query(
    "gate_repeated_watched",
    f"""WITH {VECTOR_CHUNKS_SQL}, seen AS (SELECT 's' || label AS series_id, max(vec_id % 37) AS seen_ep FROM embeddings WHERE label <> 3 GROUP BY 1)
    SELECT chunk_id, abs_ep FROM chunks LEFT JOIN seen USING (series_id) WHERE abs_ep IS NULL OR abs_ep <= coalesce(seen_ep, 1)""",
)
def gate_repeated_watched(spark, sf_dir):
    """A record table that holds every series many times: the furthest position counts and no chunk comes twice."""
    e = table(spark, sf_dir, "embeddings").filter("label <> 3")
    seen = e.select(F.concat(F.lit("s"), "label").alias("series_id"), (F.col("vec_id") % 37).cast("int").alias("seen_ep"))
    return gate.visible(vector_chunks(spark, sf_dir), watched=seen, unrecorded=1).select("chunk_id", "abs_ep")


@query(
    "vector_topk_1024",
    f"""WITH {VECTOR_CHUNKS_SQL}, q AS (SELECT list_transform(embedding, lambda x: x) AS v FROM chunks WHERE vec_id = 5),
    s AS (SELECT chunk_id, list_cosine_similarity(embedding, (SELECT v FROM q)) AS score FROM chunks WHERE type = 'event' AND vec_id % 11 <> 0)
    SELECT chunk_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, chunk_id LIMIT 30""",
)
def vector_topk_1024(spark, sf_dir):
    """Vectors as long as the product's, made of repeats of the stored ones, which leaves angles as they are; a few have lost their last value."""
    chunks = vector_chunks(spark, sf_dir)
    long = F.flatten(F.array_repeat("embedding", 1024 // 64))
    chunks = chunks.withColumn("embedding", F.when(F.col("vec_id") % 11 == 0, F.slice(long, 1, 1023)).otherwise(long))
    hits = vectors.search(chunks, vector_of(spark, sf_dir, 5) * 16, watched={}, unrecorded=ALL_EPISODES, types=["event"], k=30)
    return hits.select("chunk_id", F.round("score", 6).alias("score"))
