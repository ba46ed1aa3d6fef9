"""Indexes kept as files: equal to the search without them, added to in place, and read in part."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from episodika.operators import keywords, vector_index, vectors
from episodika.operators.gate import ALL_EPISODES

SCHEMA = "chunk_id string, series_id string, type string, abs_ep int, text string, embedding array<float>"
WORDS = ["boulder", "boulders", "titan", "running", "runs", "late", "scene", "the", "island", "islands"]


def rows(n, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        centre = i % 12
        v = [r.gauss(0, 0.05) + (j == centre) for j in range(12)]
        out.append((f"c{i:04}", f"s{i % 3}", r.choice(["event", "plot"]), r.choice([None, *range(1, 9)]), " ".join(r.choice(WORDS) for _ in range(6)), None if i % 17 == 0 else v))
    return out


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(rows(600), SCHEMA).cache()


def files_read(df):
    """Files that the largest scan of an executed query read."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        if name == "FileSourceScanExec":
            found.append(node.metrics().apply("numFiles").value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(plan)
    return max(found)


def test_stored_vectors_equal_the_exact_search(spark, chunks, tmp_path):
    path = str(tmp_path / "index")
    vector_index.create(chunks.filter("chunk_id < 'c0400'"), path, vector_index.choose_centres(chunks, 16))
    for _ in range(2):
        vector_index.add(chunks, path)
    stored = spark.read.parquet(f"{path}/cells")
    assert stored.count() == stored.select("chunk_id").distinct().count() == sum(r[5] is not None for r in rows(600))
    assert sum(n for _, n in vector_index.radii_of(spark, path).values()) == stored.count()
    held = len(set(stored.inputFiles()))
    for centre, watched in ((3, {"s0": 4}), (7, {}), (0, {"s1": 8, "s2": 2})):
        query = [float(j == centre) for j in range(12)]
        scope = dict(watched=watched, unrecorded=2, types=["event", "plot"], k=7)
        want = [(r["chunk_id"], round(r["score"], 9)) for r in vectors.search(chunks, query, **scope).collect()]
        found = vector_index.search(spark, path, query, **scope)
        assert [(r["chunk_id"], round(r["score"], 9)) for r in found.collect()] == want
        assert files_read(found) < held / 2


def test_stored_postings_equal_the_direct_search(spark, chunks, tmp_path):
    path = str(tmp_path / "words")
    keywords.write_index(chunks, path, 6)
    for series, watched in ((None, {"s0": 4}), (["s1", "s2"], {})):
        scope = dict(watched=watched, unrecorded=3, series_ids=series, types=["event"], k=15)
        want = [(r["chunk_id"], round(r["score"], 9)) for r in keywords.search(chunks, ["running boulders late"], **scope).collect()]
        found = keywords.search_index(spark, path, ["running boulders late"], **scope)
        assert [(r["chunk_id"], round(r["score"], 9)) for r in found.collect()] == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "In(term" in plan and "text" not in plan.split("ReadSchema")[1]
    assert keywords.search_index(spark, path, ["nothing here"], watched={}, unrecorded=ALL_EPISODES, series_ids=None, types=["event"]).isEmpty()


def test_no_whole_text_goes_through_the_stemmer(chunks):
    found = keywords.search(chunks, ["running boulders late"], watched={}, unrecorded=ALL_EPISODES, series_ids=None, types=["event"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "word_stem(word" in plan and "english_stems" not in plan


def test_files_of_postings_grow_with_the_rows(spark, chunks, tmp_path, monkeypatch):
    monkeypatch.setattr(keywords, "CHUNKS_PER_FILE", 5)
    keywords.write_index(chunks, str(tmp_path / "grown"), 2)
    files = len(spark.read.parquet(f"{tmp_path}/grown/postings").inputFiles())
    assert files > 2 and files >= chunks.count() // 5 // 2
