"""Prefix tries, token files and spelling variants against plain versions, on rows that are easy to get wrong."""

from __future__ import annotations

import glob
import random
import zlib

import numpy as np
import plain
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from episodika.llm import prefix_trie, token_files, variants

BIG = 2**60 + 1


def turns(seed: int = 3) -> list[tuple]:
    r, rows = random.Random(seed), []
    for conv in [None, -3, -20, 0, 1, 2, 3, 5, 20, 21, 22, 23, 24, 40, 41, 43, 59, BIG, BIG + 19, *range(100, 150)]:
        for t in range(r.choice([1, 1, 2, 3, 9])):
            rows.append((conv, None if r.random() < 0.1 else t, r.choice([None, "u", "a"]), r.choice(["x y", "x", " ", None, "z  w q"])))
    rows += [(41, t, "u", "x") for t in range(40)] + [(43, t, "u", "x") for t in range(37)] + [(43, 37, "u", "q")]
    return rows + [(200, 0, "u", "same")] * 3 + [(220 + i, t, "u", "copy") for i in range(30) for t in range(5)] + [(BIG, 99, "a", "word " * 30_000)]


def trie_rows(df):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert df.columns == columns
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def conversations(spark):
    return spark.createDataFrame(turns(), "conv_id long, turn long, role string, text string").repartition(5).cache()


@pytest.mark.parametrize("options", [{}, {"width": 2}, {"width": 3, "shard_bytes": 500}, {"shard_bytes": 300}])
def test_trie(conversations, options):
    """Matrices narrower than conversations, shards of a few rows: the same trie."""
    want = plain.trie(turns())
    assert trie_rows(prefix_trie.prefix_trie(conversations, **options)) == want


def test_trie_other_columns_and_empty(spark, conversations):
    extra = conversations.limit(60).withColumns({c: F.lit("x") for c in ("known", "conv", "rank", "key", "words", "total", "block", "kind", "depth", "place")})
    want = plain.trie([tuple(r)[:4] for r in extra.collect()])
    assert trie_rows(prefix_trie.prefix_trie(extra)) == want
    assert trie_rows(prefix_trie.prefix_trie(conversations.limit(0))) == []
    none = spark.createDataFrame([(None, None, None, None)] * 2, conversations.schema)
    assert trie_rows(prefix_trie.prefix_trie(none)) == plain.trie([(None, None, None, None)] * 2)


def test_trie_pieces_of_ends(conversations, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    assert trie_rows(prefix_trie.prefix_trie(conversations, shard_bytes=700)) == plain.trie(turns())


TEXTS = [(4, "A first text."), (2, None), (9, ""), (7, "é漢字 " * 400), (None, "null id"), (None, "null id"), (BIG, "one"), (BIG, "two"), (BIG, "two"), (-5, "a" * 30_000), (3, "x\ny <|endoftext|>")]


def read_back(spark, path, **options):
    return [tuple(r) for r in token_files.checksums(token_files.read_tokens(spark, path, **options)).orderBy("start").collect()]


def test_token_files(spark, tmp_path):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3).withColumns({"ids": F.lit(1), "shard": F.lit("s"), "at": F.lit(2), "place": F.lit(3)})
    token_files.write_tokens(docs, f"{tmp_path}/a")
    got, t, want, at = read_back(spark, f"{tmp_path}/a"), plain.tokenizer("byte_bpe_50k.json"), [], 0
    texts = {}
    for doc, text in TEXTS:
        texts.setdefault(doc, []).append([*t.encode(text or "", add_special_tokens=False).ids, 0])
    assert [r[0] for r in got] == sorted([d for d, _ in TEXTS], key=lambda d: (d is not None, d or 0))
    for doc, start, n, crc in got:
        match = next(ids for ids in texts[doc] if zlib.crc32(np.array(ids, "<u4").tobytes()) == crc)
        texts[doc].remove(match)
        assert (start, n) == (at, len(match))
        at += n
    # a part of the documents has the same places, metadata needs no lists
    assert read_back(spark, f"{tmp_path}/a", low=3, high=9) == [r for r in got if r[0] is not None and 3 <= r[0] <= 9]
    meta = token_files.read_tokens(spark, f"{tmp_path}/a", ids=False)
    assert "ids" not in meta._jdf.queryExecution().executedPlan().toString() and meta.count() == len(TEXTS)
    token_files.write_tokens(docs.limit(0), f"{tmp_path}/none")
    assert read_back(spark, f"{tmp_path}/none") == []


@pytest.mark.parametrize("encoding", token_files.ENCODINGS)
def test_token_file_layout(spark, tmp_path, encoding):
    said = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(120)), lambda i: F.md5(F.concat_ws(".", F.col("id"), i)).substr(1, 6)), " ")
    docs = spark.range(1500).select(F.col("id").alias("doc_id"), said.alias("text"))
    token_files.write_tokens(docs, f"{tmp_path}/t", encoding=encoding, row_group=1 << 16, page=1 << 12, page_rows=20)
    groups = [f.row_group(i) for p in glob.glob(f"{tmp_path}/t/tokens/*.parquet") for f in [pq.ParquetFile(p).metadata] for i in range(f.num_row_groups)]
    assert len(groups) > 2
    for group in groups:
        columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
        assert all(c.has_offset_index and c.has_column_index for c in columns.values())
        assert columns["doc_id"].encodings == ("DELTA_BINARY_PACKED",)
        assert ("RLE_DICTIONARY" in columns["ids.list.element"].encodings) == (encoding == "dictionary")
    assert [r[0] for r in read_back(spark, f"{tmp_path}/t", low=100, high=120)] == list(range(100, 121))
    with pytest.raises(ValueError):
        token_files.writer_options("plain")


def variant_rows(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return {r.word: tuple(r)[1:] for r in df.collect()}


WORDS = ["aabcdefg", "abcdefg", "aaabcdefg", "abcdefgg", "abcdefh", "Àbcdefg", "àbcdefg", "zabcdefg", "abcdeffg", "bcdefgh", "other"]


def spelled(seed: int = 5) -> list[tuple]:
    r = random.Random(seed)
    rows = [(i, " ".join(r.choice(WORDS) for _ in range(40)) + f" Abcdefg,abcDEFG\n{i}") for i in range(40)]
    rows += [(50 + i, "chainzzz " * 500 + "chainzzy " * 14 + "chainzyy ") for i in range(3)]
    return rows + [(None, "ABCDEFG abcdefg"), (None, None), (BIG, ""), (90, "漢字abcdefg漢 x" + "abcdefgh" * 3000), (90, "twofold twofold"), (90, "twofold twofold")]


def test_variants(spark):
    docs = spark.createDataFrame(spelled(), "doc_id long, text string").repartition(4)
    want = plain.variants(spelled())
    assert variant_rows(variants.spelling_variants(docs)) == want
    assert any(v[0] and v[0] != v[1] for v in want.values()) and any(v[3] > 4 for v in want.values())
    clashing = docs.withColumns({c: F.lit("x") for c in ("word", "n", "doc", "prefix", "edited", "first", "at", "near")})
    assert variant_rows(variants.spelling_variants(clashing)) == want
    assert variant_rows(variants.spelling_variants(docs.limit(0))) == {}
    plainly = variant_rows(variants.spelling_variants(docs, min_chars=5, min_count=1, ratio=3, edit_every=None))
    assert plainly == plain.variants(spelled(), 5, 1, 3, 10**12)
    with pytest.raises(ValueError):
        variants.spelling_variants(docs, ratio=1)


def test_variants_scan_across_batches(spark):
    """Groups that a batch cuts go on in the next one; words of one letter's place are all neighbours."""
    letters = [chr(c) for c in (*range(97, 123), *range(0xE0, 0xF7))]
    docs = spark.createDataFrame([(1, " ".join(f"mid{c}word {c}fronted " * (2 + i) for i, c in enumerate(letters)))], "doc_id long, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = variant_rows(variants.spelling_variants(docs, edit_every=None))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == plain.variants([(r.doc_id, r.text) for r in docs.collect()], every=10**12)
