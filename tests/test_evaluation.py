"""Ranks over tables of questions and the comparison of chunkers, against plain versions."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from episodika.plans import chunkers, evaluate, vector_store


def plain_ranks(chunks, questions):
    out = {}
    unit = lambda v: np.asarray(v, np.float64) / np.linalg.norm(v)
    for name, home, gold, vector in questions:
        best = {}
        for series, episode, v in chunks:
            if episode and v is not None and any(v):
                best[series, episode] = max(best.get((series, episode), -9), float(unit(v) @ unit(vector)))
        own = [s for (series, e), s in best.items() if series == home and e in gold]
        if not own:
            out[name] = (None, None, None)
            continue
        top = max(own)
        home_top = max(s for (series, _), s in best.items() if series == home)
        shows = {series for (series, _), s in best.items() if series != home and s > home_top}
        out[name] = (1 + sum(s > top for (series, _), s in best.items() if series == home), 1 + sum(s > top for s in best.values()), 1 + len(shows))
    return out


def test_ranks_in_blocks_of_questions(spark):
    r = random.Random(4)
    vec = lambda: [r.gauss(0, 1) for _ in range(6)]
    chunks = [(f"s{r.randrange(4)}", r.choice([None, 0, *range(1, 9)]), vec() if r.random() > 0.05 else None) for _ in range(400)] + [("s0", 3, [0.0] * 6), ("s9", 1, [1.0] * 5)]
    questions = [(f"q{i}", f"s{i % 5}", [1 + i % 8, 2], vec()) for i in range(23)]
    c = spark.createDataFrame(chunks, "series_id string, abs_ep int, embedding array<double>").repartition(5)
    q = spark.createDataFrame(questions, "query_id string, series_id string, gold array<int>, vector array<double>")
    want = plain_ranks([x for x in chunks if x[0] != "s9"], questions)
    for block in (512, 7, 1):
        got = {x.query_id: (x.in_series, x["global"], x.series) for x in evaluate.exact_ranks(c, q if block > 1 else q.limit(2), block).collect()}
        assert got == (want if block > 1 else {k: want[k] for k in got}) and len(got) == (23 if block > 1 else 2)
    assert evaluate.exact_ranks(c, q.limit(0)).count() == 0


def test_chunkers_on_the_same_questions(spark, tmp_path):
    def letters():  # inside the test: tasks get its code, not this module's name
        return lambda texts: np.array([[1.0 + text.count(v) for v in "aeioubcdfg"] for text in texts], dtype=np.float64)

    r = random.Random(5)
    word = lambda: "".join(r.choice("aeioubcdfg") for _ in range(5))
    plots = [(f"s{i % 2}", i // 2 + 1, f"S{i % 2} {i // 2 + 1}", "\n".join(". ".join(" ".join(word() for _ in range(12)) for _ in range(6)) + "." for _ in range(4))) for i in range(12)]
    questions = [(f"q{i}", s, [e], plot[100:400]) for i, (s, e, _, plot) in enumerate(plots)]
    p = spark.createDataFrame(plots, "series_id string, abs_ep int, head string, plot string")
    q = spark.createDataFrame(questions, "query_id string, series_id string, gold array<int>, text string")
    store = str(tmp_path / "store")
    ranks = chunkers.compare(p, q, store, "m", letters)
    pieces = chunkers.pieces_of(p, letters).collect()
    assert {x.method for x in pieces} == set(chunkers.METHODS) and all(x.text.split("\n")[0].endswith((chunkers.SCENE, chunkers.PLOT)) for x in pieces)
    model = letters()
    asked = [(n, s, g, model([text])[0]) for n, s, g, text in questions]
    for method in chunkers.METHODS:
        want = plain_ranks([(x.series_id, x.abs_ep, model([x.text])[0]) for x in pieces if x.method == method], asked)
        assert {x.query_id: (x.in_series, x["global"], x.series) for x in ranks.filter(F.col("method") == method).collect()} == want
    assert {x.method: x.n for x in chunkers.summary(ranks).collect()} == dict.fromkeys(chunkers.METHODS, 12)
    # everything is stored: nothing is encoded again, and another model's vectors are others
    texts = chunkers.pieces_of(p, letters).select("text")
    assert vector_store.encode_missing(texts, store, "m", letters) == 0
    assert vector_store.encode_missing(texts.limit(3), store, "other", letters) == texts.limit(3).distinct().count()
    assert vector_store.with_vectors(texts, store, "m").filter("embedding IS NULL").count() == 0


def test_texts_go_no_further_than_the_encoder(spark, tmp_path):
    def letters():
        return lambda texts: np.array([[1.0 + text.count("a"), 1.0] for text in texts], dtype=np.float64)

    plots = spark.createDataFrame([("s", 1, "S 1", "a b. c d."), ("s", 2, "S 2", "")], "series_id string, abs_ep int, head string, plot string")
    pieces = chunkers.pieces_of(plots, letters)
    assert "Union" not in pieces._jdf.queryExecution().optimizedPlan().toString()
    rows = vector_store.keyed(pieces, "m")
    assert vector_store.encode_missing(rows, str(tmp_path / "store"), "m", letters) == pieces.select("text").distinct().count()
    found = vector_store.with_vectors(rows.drop("text"), str(tmp_path / "store"), "m")
    assert "text" not in found.columns and found.filter("embedding IS NOT NULL").count() == pieces.count()
