"""Fusion of hit lists, the decision rule and the whole find plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodika.operators import fusion, keywords, vectors
from episodika.operators.gate import ALL_EPISODES
from episodika.plans import find as find_plan
from episodika.plans.derived import (
    MEDIA_CHUNKS_SQL,
    TEXT_WATCHED,
    VECTOR_WATCHED,
    gated_sql,
    media_chunks,
    text_of,
    vector_chunks,
    vector_of,
)
from episodika.plans.registry.base import query
from episodika.plans.registry.retrieval import STOP_SQL, sim, vgate


def mgate() -> str:
    return gated_sql(ALL_EPISODES, "TRUE", TEXT_WATCHED, MEDIA_CHUNKS_SQL)


def dense_list(name: str, vec_id: int, where: str = "type = 'event'", k: int = 30) -> str:
    """Top-k list with its 0-based position."""
    return f"""{name} AS (SELECT chunk_id, series_id, type, abs_ep, score, row_number() OVER (ORDER BY score DESC, chunk_id) - 1 AS position
      FROM (SELECT *, {sim(vec_id)} AS score FROM g WHERE embedding IS NOT NULL AND {where}) ORDER BY score DESC, chunk_id LIMIT {k})"""


def word_list(name: str, item_id: int, where: str, k: int) -> str:
    return f"""{name}_docs AS (SELECT * FROM g WHERE {where}),
    {name}_terms AS (SELECT DISTINCT t FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]{{2,}}')) AS t
        FROM benchmark WHERE item_id = {item_id}) WHERE t NOT IN ({STOP_SQL})),
    {name}_hits AS (SELECT chunk_id, t FROM (SELECT chunk_id,
        unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'))) AS t FROM {name}_docs) JOIN {name}_terms USING (t)),
    {name}_idf AS (SELECT t, ln(1 + ((SELECT count(*) FROM {name}_docs) - count(*) + 0.5) / (count(*) + 0.5)) AS weight
        FROM {name}_hits GROUP BY t),
    {name}_best AS (SELECT chunk_id, round(sum(weight), 9) AS score FROM {name}_hits JOIN {name}_idf USING (t)
        GROUP BY chunk_id ORDER BY 2 DESC, 1 LIMIT {k}),
    {name} AS (SELECT d.chunk_id, d.series_id, d.type, d.abs_ep, b.score,
        row_number() OVER (ORDER BY b.score DESC, d.chunk_id) - 1 AS position FROM {name}_best b JOIN {name}_docs d USING (chunk_id))"""


def lists_of(spark, sf_dir):
    chunks = media_chunks(spark, sf_dir)
    scope = dict(watched=TEXT_WATCHED, unrecorded=ALL_EPISODES)
    columns = ["chunk_id", "series_id", "type", "abs_ep", "score"]
    dense = [
        fusion.pin(vectors.search(chunks, vector_of(spark, sf_dir, v), k=30, **scope).select(*columns)) for v in (1, 6)
    ]
    words = keywords.search(
        chunks, [text_of(spark, sf_dir, 0)], series_ids=None, types=["event"], k=30, analyzer="simple", **scope
    )
    # both sides order by a score rounded alike, so equal sums tie by id on both
    return dense, fusion.pin(words.select(*columns).withColumn("score", F.round("score", 9)))


LISTS_SQL = mgate() + ", " + dense_list("d0", 1) + ", " + dense_list("d1", 6) + ", " + word_list("w", 0, "type = 'event'", 30)


@query(
    "series_rrf",
    LISTS_SQL
    + """, h AS (SELECT 0 AS list_no, * FROM d0 UNION ALL SELECT 1, * FROM d1 UNION ALL SELECT 2, * FROM w)
    SELECT series_id, round(sum(1.0 / (60 + position)), 6) AS rrf FROM h GROUP BY series_id""",
)
def series_rrf(spark, sf_dir):
    dense, words = lists_of(spark, sf_dir)
    return fusion.rank_series([*dense, words]).select("series_id", F.round("rrf", 6).alias("rrf"))


FUSION_SQL = """, h AS (SELECT 0 AS list_no, 1.0 AS weight, * FROM d0 UNION ALL SELECT 1, 1.0, * FROM d1
                UNION ALL SELECT 2, 2.0, * FROM w),
    h2 AS (SELECT * FROM h WHERE abs_ep IS NOT NULL),
    b AS (SELECT list_no, weight, series_id, abs_ep, min(position) AS position FROM h2 GROUP BY ALL),
    p AS (SELECT *, row_number() OVER (PARTITION BY list_no ORDER BY position) - 1 AS place FROM b),
    r AS (SELECT series_id, abs_ep, sum(weight / (60 + place)) AS rrf, min(list_no * 1000000 + position) AS first_seen
          FROM p GROUP BY ALL),
    t AS (SELECT series_id, abs_ep, max(CASE WHEN list_no < 2 THEN score END) AS score,
                 count(DISTINCT CASE WHEN type = 'event' THEN chunk_id END) AS scenes FROM h2 GROUP BY ALL)"""


@query(
    "episode_fusion",
    LISTS_SQL + FUSION_SQL
    + " SELECT series_id, abs_ep, round(rrf, 6) AS rrf, round(score, 6) AS score, scenes FROM r JOIN t USING (series_id, abs_ep)",
)
def episode_fusion(spark, sf_dir):
    dense, words = lists_of(spark, sf_dir)
    eps = fusion.fuse_episodes(dense, words)
    return eps.select("series_id", "abs_ep", F.round("rrf", 6).alias("rrf"), F.round("score", 6).alias("score"), "scenes")


def decision_sql(vec_id: int, min_score: float, margin: float) -> str:
    return (
        vgate(ALL_EPISODES)
        + ", " + dense_list("d0", vec_id) + f""",
    e AS (SELECT series_id, abs_ep, min(position) AS position, max(score) AS score, count(DISTINCT chunk_id) AS scenes
          FROM d0 WHERE abs_ep IS NOT NULL GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (ORDER BY position) AS place,
                 row_number() OVER (PARTITION BY series_id ORDER BY position) AS in_series,
                 lead(score) OVER (PARTITION BY series_id ORDER BY position) AS next_score FROM e),
    l AS (SELECT o.*, (SELECT count(*) FROM d0 x WHERE x.position < 5 AND x.series_id = o.series_id) AS head FROM o WHERE place = 1),
    v AS (SELECT series_id AS top_series, CASE WHEN score < {min_score} THEN 'none' WHEN head < 3 THEN 'ambiguous_series'
            WHEN score - next_score < {margin} THEN 'ambiguous_episode' ELSE 'episode' END AS status FROM l),
    c AS (SELECT status, row_number() OVER (ORDER BY score DESC, place) AS position, series_id, NULL AS abs_ep, score FROM o, v
            WHERE status = 'ambiguous_series' AND in_series = 1
          UNION ALL SELECT status, in_series, series_id, abs_ep, score FROM o, v
            WHERE status = 'ambiguous_episode' AND series_id = top_series
          UNION ALL SELECT status, 1, series_id, abs_ep, score FROM o, v WHERE status = 'episode' AND place = 1),
    f AS (SELECT CASE WHEN status LIKE 'ambiguous%' THEN 'ambiguous' ELSE status END AS status,
                 CAST(position AS INTEGER) AS position, series_id, CAST(abs_ep AS INTEGER) AS abs_ep, round(score, 6) AS score
          FROM c WHERE position <= 3)
    SELECT * FROM f UNION ALL SELECT 'none', 1, NULL, NULL, NULL WHERE NOT EXISTS (SELECT 1 FROM f)"""
    )


def decision(vec_id: int, min_score: float, margin: float):
    def run(spark, sf_dir):
        first = vectors.search(
            vector_chunks(spark, sf_dir),
            vector_of(spark, sf_dir, vec_id),
            watched=VECTOR_WATCHED,
            unrecorded=ALL_EPISODES,
            k=30,
        )
        first = fusion.pin(first)
        rows = fusion.decide(fusion.fuse_episodes([first]), first, min_score=min_score, margin=margin)
        return rows.select("status", "position", "series_id", "abs_ep", F.round("score", 6).alias("score"))

    return run


for _name, _args in {
    "decision_episode_or_ambiguous": (8, 0.5, 0.02),
    "decision_wide_margin": (8, 0.5, 0.9),
    "decision_not_found": (8, 1.5, 0.02),
}.items():
    query(_name, decision_sql(*_args))(decision(*_args))


@query("find_from_clues")
def find_from_clues(spark, sf_dir):
    found = find_plan.find(
        media_chunks(spark, sf_dir),
        [vector_of(spark, sf_dir, 1), vector_of(spark, sf_dir, 6)],
        [text_of(spark, sf_dir, 0)],
        watched=TEXT_WATCHED,
    )
    return find_plan.result_rows(found)


@query(
    "find_evidence",
    LISTS_SQL + FUSION_SQL
    + """, top AS (SELECT * FROM r JOIN t USING (series_id, abs_ep)
                  ORDER BY rrf DESC, scenes DESC, coalesce(score, 0) DESC, first_seen LIMIT 8)
    SELECT top.series_id, top.abs_ep, p.chunk_id AS plot_id, md5(substr(p.text, 1, 8000)) AS digest
    FROM top LEFT JOIN g p ON p.series_id = top.series_id AND p.abs_ep = top.abs_ep AND p.type = 'plot'""",
)
def find_evidence(spark, sf_dir):
    dense, words = lists_of(spark, sf_dir)
    rows = find_plan.evidence(
        fusion.fuse_episodes(dense, words), media_chunks(spark, sf_dir).drop("embedding"), watched=TEXT_WATCHED
    )
    return rows.select("series_id", "abs_ep", "plot_id", F.md5("shown").alias("digest"))
