"""Nothing beyond the watched position, and everything up to it, for every reading function."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodika.operators import gate, keywords, vectors
from episodika.operators.gate import ALL_EPISODES
from episodika.plans import reading

SCHEMA = "chunk_id string, series_id string, type string, abs_ep int, text string, embedding array<float>"
DIM = 130


def axis(n):
    v = [0.0] * DIM
    v[n % DIM] = 1.0
    return v


@pytest.fixture(scope="module")
def chunks(spark):
    rows = []
    for series, episodes, shift in (("A", 10, 0), ("B", 5, 100)):
        for ep in range(1, episodes + 1):
            body = f"head\nSECRET-{series}-{ep} boulder {'titans ' * (ep % 2)}scene text number{ep}"
            rows.append((f"{series}:plot:{ep}", series, "plot", ep, body, axis(ep + shift)))
            rows.append((f"{series}:ep:{ep}", series, "episode", ep, body, axis(ep + shift)))
            for i in (1, 2):
                rows.append((f"{series}:event:{ep}:{i}", series, "event", ep, body, axis(ep + shift)))
        rows.append((f"{series}:summary:s1", series, "summary", None, "head\nintro of the show", None))
        rows.append((f"{series}:char:1", series, "character", None, "head\nlead person", None))
        rows.append((f"{series}:char:2", series, "character", 4, "head\nlate person", None))
    return spark.createDataFrame(rows, SCHEMA).cache()


def leaked(rows, watched, default=0):
    return [r for r in rows if r["abs_ep"] is not None and r["abs_ep"] > watched.get(r["series_id"], default)]


@pytest.mark.parametrize("seen", [0, 1, 4, 5, 9, 10])
def test_vector_search_is_gated_and_complete(chunks, seen):
    rng = random.Random(seen)
    query = [rng.uniform(-1, 1) for _ in range(DIM)]
    rows = vectors.search(chunks, query, watched={"A": seen}, types=["plot", "event"], k=1000).collect()
    assert not leaked(rows, {"A": seen})
    assert sum(r["type"] == "plot" for r in rows) == seen
    assert sum(r["type"] == "event" for r in rows) == 2 * seen


@pytest.mark.parametrize("seen", [0, 4, 10])
def test_watched_frame_gives_the_same_rows_as_the_map(spark, chunks, seen):
    frame = spark.createDataFrame([("A", seen)], "series_id string, seen_ep int")
    a = {r["chunk_id"] for r in gate.visible(chunks, watched=frame).collect()}
    b = {r["chunk_id"] for r in gate.visible(chunks, watched={"A": seen}).collect()}
    assert a == b and gate.leaks(gate.visible(chunks, watched=frame), watched=frame).isEmpty()


def test_gate_argument_is_mandatory(chunks):
    with pytest.raises(TypeError):
        gate.visible(chunks)
    for call in (
        lambda: gate.visible(chunks, watched=None),
        lambda: vectors.search(chunks, axis(1), watched=None),
        lambda: keywords.search(chunks, ["boulder"], watched=None, series_ids=None, types=["event"]),
        lambda: gate.read_range(chunks, "A", seen_ep=None, types=["plot"]),
    ):
        with pytest.raises(TypeError):
            call()


def test_hidden_rows_do_not_influence_keyword_scores(chunks):
    few = keywords.search(chunks, ["boulder titan"], watched={"A": 3}, series_ids=["A"], types=["event"], k=50).collect()
    assert {r["abs_ep"] for r in few} == {1, 2, 3}
    # of six visible rows all hold "boulder" and four hold the stem of "titans"
    weight = lambda df: float(np.log(1 + (6 - df + 0.5) / (df + 0.5)))
    by_id = {r["chunk_id"]: r["score"] for r in few}
    assert by_id["A:event:1:1"] == pytest.approx(weight(6) + weight(4))
    assert by_id["A:event:2:1"] == pytest.approx(weight(6))
    assert [r["chunk_id"] for r in few] == sorted(by_id, key=lambda c: (-by_id[c], c))


def test_keyword_search_without_words_or_series_is_empty(chunks):
    assert keywords.search(chunks, ["the of"], watched={}, series_ids=None, types=["event"]).isEmpty()
    assert keywords.search(chunks, ["boulder"], watched={}, unrecorded=9, series_ids=[], types=["event"]).isEmpty()


def test_postings_give_the_same_result(chunks):
    scope = dict(watched={"A": 7}, unrecorded=2, series_ids=None, types=["event", "character"])
    direct = keywords.search(chunks, ["titan scene late"], k=8, **scope).collect()
    index = keywords.build_postings(chunks)
    through = keywords.search_postings(index, chunks, ["titan scene late"], k=8, **scope).collect()
    assert [(r["chunk_id"], round(r["score"], 9)) for r in direct] == [(r["chunk_id"], round(r["score"], 9)) for r in through]


def test_predictable_ranks_unrecorded_series_and_null_vectors(chunks):
    rows = vectors.search(chunks, axis(103), watched={"A": 2}, unrecorded=ALL_EPISODES, k=3).collect()
    assert [r["chunk_id"] for r in rows][:2] == ["B:event:3:1", "B:event:3:2"]
    assert rows[0]["score"] == pytest.approx(1.0)
    assert vectors.search(chunks, axis(1), watched={}, types=["summary"], k=5).isEmpty()


def test_many_queries_equal_single_searches(chunks):
    queries = [(f"q{n}", axis(n)) for n in (1, 5, 103)]
    many = vectors.search_many(chunks, queries, watched={"A": 6}, unrecorded=3, types=None, k=4, block=2).collect()
    for name, q in queries:
        one = vectors.search(chunks, q, watched={"A": 6}, unrecorded=3, types=None, k=4).collect()
        got = sorted((r for r in many if r["query_id"] == name), key=lambda r: r["rank"])
        assert [r["chunk_id"] for r in got] == [r["chunk_id"] for r in one]


def test_cell_search_equals_exact_search(spark):
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(400, 16))
    rows = [(f"c{i:03}", f"s{i % 4}", "event", i % 30 + 1, "t", [float(x) for x in v]) for i, v in enumerate(vecs)]
    chunks = spark.createDataFrame(rows, SCHEMA)
    centres = [r[5] for r in rows[:12]]
    cells = vectors.build_cells(chunks, centres).cache()
    radii = vectors.cell_radii(cells)
    for seen in (2, 30):
        for n in (0, 17):
            q = [float(x) for x in rng.normal(size=16)]
            scope = dict(watched={"s1": seen}, unrecorded=5 * n, k=7)
            a = vectors.search(chunks, q, **scope).collect()
            b = vectors.search_cells(cells, centres, radii, q, probe=2, **scope).collect()
            assert [r["chunk_id"] for r in a] == [r["chunk_id"] for r in b]


@pytest.mark.parametrize("seen", [1, 3, 5, 10])
def test_reviews_and_dictionary_stay_behind_the_position(spark, chunks, seen):
    people = spark.createDataFrame([], "series_id string, char_id long, name string, role string, image_url string")
    rows = chunks.withColumn("sources", F.array().cast("array<struct<name:string,license:string,url:string>>"))
    for context in (
        reading.summary_context(rows, "A", seen_ep=seen),
        reading.last_context(rows, "A", seen_ep=seen),
        reading.ask_context(rows, "A", axis(2), seen_ep=seen),
    ):
        found = reading.assert_visible(context, seen).collect()
        assert found and not leaked(found, {"A": seen})
    names = {r["text"] for r in reading.dictionary(rows, people, "A", seen_ep=seen).collect()}
    assert ("late person" in names) == (seen >= 4) and "lead person" in names
    assert {r["abs_ep"] for r in reading.summary_context(rows, "A", seen_ep=seen).collect()} == set(range(1, seen + 1))


def test_run_time_check_fails_on_a_leak(chunks):
    with pytest.raises(Exception, match="beyond the watched position"):
        reading.assert_visible(chunks, 3).select("abs_ep").collect()


def test_equal_keyword_scores_are_ties_whatever_the_order_of_the_words(spark):
    words = ["alpha", "beta", "gamma"]
    texts = [" ".join(p) for p in itertools.permutations(words)] + ["beta"] * 0 + ["gamma"] * 2
    rows = [(f"{i:02}", "A", "event", 1, text) for i, text in enumerate(texts)] + [(f"x{i:02}", "A", "event", 1, text) for i, text in enumerate(reversed(texts[:6]))]
    df = spark.createDataFrame(rows, "chunk_id string, series_id string, type string, abs_ep int, text string").cache()
    scope = dict(watched={"A": 9}, series_ids=None, types=["event"], k=12, analyzer="simple")
    for found in (keywords.search(df, [" ".join(words)], **scope), keywords.search_postings(keywords.build_postings(df, "simple"), df, [" ".join(words)], **scope)):
        assert [r["chunk_id"] for r in found.collect()] == sorted(r[0] for r in rows if len(r[4]) > 5)
