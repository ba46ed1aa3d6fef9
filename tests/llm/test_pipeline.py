"""The pipeline, stage by stage, against plain versions of what each stage decides."""

from __future__ import annotations

import os
from collections import Counter

import corpus_pipeline
import plain
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from episodika.llm import queries as llm_queries

SF_DIR = "/root/testdata/sf0.001"


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.dtypes
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "near_dedup", "secret_scans", "packing"]
    before = texts(docs)
    docs = stages["language_id"](spark, docs, SF_DIR).cache()
    assert docs.dtypes == columns and texts(docs) == {d: t for d, t in before.items() if any(c.isalpha() for c in t)}
    before = texts(docs)
    docs = stages["line_dedup"](spark, docs, SF_DIR).cache()
    after = texts(docs)
    assert docs.dtypes == columns
    assert sorted((d, plain.sha(t)) for d, t in after.items()) == sorted((r[0], r[3]) for r in plain.line_dedup(list(before.items())))
    docs = stages["near_dedup"](spark, docs, SF_DIR).cache()
    want = {d for d, _, c in plain.components(list(after.items())) if d == c}
    assert docs.dtypes == columns and set(texts(docs)) == want and len(want) < len(after)
    docs = stages["secret_scans"](spark, docs, SF_DIR).cache()
    clean = {d for d in want if not sum(plain.base_secrets(after[d])[0])}
    found = texts(docs)
    assert docs.dtypes == columns and set(found) == want and all(not sum(plain.base_secrets(t)[0]) for t in found.values())
    assert sum(found[d] != after[d] for d in clean) == 0
    pieces = stages["packing"](spark, docs, SF_DIR).collect()
    t = plain.tokenizer("word_bpe_49k.json")
    assert Counter({r.doc_id: 0 for r in pieces}).keys() == found.keys()
    for d, text in found.items():
        assert sum(r.length for r in pieces if r.doc_id == d) == len(t.encode(text, add_special_tokens=False).ids) + 1


BIG = 2**60 + 1
ODD = [
    (1, "The river ran by the old stones and the people went home in the evening."), (1, "Another text of the same id, about boats and the sea and the long winter."),
    (None, "The river ran by the old stones and the people went home in the evening."), (None, None), (3, ""), (3, ""), (BIG, "Ships with password=hunter2hunter2 in them sail on."),
    (BIG + 2, "Nobody knows why the mountain has that name, but it is an old one."), (None, "Nobody knows why the mountain has that name, but it is an old one."),
    (7, "A long day. " * 8000), (8, "repeated rows of a text that is here twice"), (8, "repeated rows of a text that is here twice"),
]
EXTRA = "row own _doc _own _row _language n_lines keep_runs spans language kept hash c0 c1 copies none id print".split()


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_rows(spark, name):
    """Null, repeated and large ids, empty and long texts, columns called like inner ones: other columns come as they were."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    plain_docs = spark.createDataFrame([(d, t, "en", None if i % 2 else "s", -1) for i, (d, t) in enumerate(ODD)], schema)
    docs = plain_docs.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce("text", F.lit("")).substr(1, 9)).alias(c) for c in EXTRA]).cache()
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, "")
    empty = stage(spark, docs.limit(0), "")
    assert empty.columns == out.columns and empty.count() == 0
    rows = out.collect()
    if name == "packing":
        assert {r.doc_id for r in rows} == {d for d, _ in ODD}
        t = plain.tokenizer("word_bpe_49k.json")
        assert sum(r.length for r in rows) == sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x in ODD)
        return
    assert out.dtypes == docs.dtypes
    texts = {(d, t or "") for d, t in ODD}  # a null text comes out of line dedup as an empty one
    for r in rows:
        assert r.n_chars == len(r.text or "") and r.doc_id in {d for d, _ in ODD}
        if name != "secret_scans" or r.doc_id != BIG:
            assert (r.doc_id, r.text or "") in texts
            assert all(r[c] == f"{c}:{(r.text or '')[:9]}" for c in EXTRA)
    said = Counter((r.doc_id, r.text) for r in rows)
    if name in ("line_dedup", "secret_scans"):
        assert sum(said.values()) == len(ODD) and (name == "line_dedup" or not any("hunter2hunter2" in (t or "") for _, t in said))
    if name == "language_id":
        assert all(any(c.isalpha() for c in t or "") for _, t in said) and said[8, ODD[-1][1]] in (0, 2)
    if name == "near_dedup":
        want = {}
        for d, t in ODD:
            mark = plain.simhash(t)
            want[mark] = min([want[mark], (d is None, d or 0, d)] if mark in want else [(d is None, d or 0, d)])
        assert len(rows) == len(want) and Counter(r.doc_id for r in rows) == Counter(d for *_, d in want.values())


def test_run(spark):
    assert corpus_pipeline.run(spark, SF_DIR).count() > 0


@pytest.mark.parametrize("gone", [True, False])
def test_entry_without_this_part(gone, tmp_path):
    """Without the subpackage and the pipeline the other queries are still there."""
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    block = "import sys; sys.modules['episodika.llm'] = None;" if gone else ""
    if gone:
        block = "import importlib.abc, sys\nclass No(importlib.abc.MetaPathFinder):\n    def find_spec(self, name, *a):\n        if name in ('corpus_pipeline', 'episodika.llm'): raise ModuleNotFoundError(name, name=name)\nsys.meta_path.insert(0, No())\n"
    out = subprocess.run([sys.executable, "-c", block + "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"], cwd=root, capture_output=True, text=True, check=True)
    assert out.stdout.split()[-1] == str(not gone)
    assert len(entry.queries()) - int(out.stdout.split()[-2]) == (len(llm_queries.QUERIES) + 1 if gone else 0)
