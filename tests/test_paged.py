"""Pages by continuation tokens: each once, whether the read was stopped or not."""

from __future__ import annotations

import pytest

from episodika.streaming.paged import _Pages, paged_stream, read_pages

PAGES = {None: ([(1, "a"), (2, "b")], "t1"), "t1": ([], "t2"), "t2": ([(3, "c")], "t3"), "t3": ([(4, "d"), (5, "e")], "t4"), "t4": ([(6, "f")], None)}


def test_offsets_are_tokens():
    asked = []
    reader = _Pages(lambda token: (asked.append(token), PAGES[token])[1], 2)
    rows, at = reader.read(reader.initialOffset())
    assert list(rows) == [(1, "a"), (2, "b")] and at == {"page": 2, "token": "t2", "last": False}
    assert list(reader.readBetweenOffsets(at, {"page": 4, "token": "t4", "last": False})) == [(3, "c"), (4, "d"), (5, "e")]
    rows, at = reader.read({"page": 4, "token": "t4", "last": False})
    assert list(rows) == [(6, "f")] and at["last"] and list(reader.read(at)[0]) == [] and reader.read(at)[1] == at
    assert asked == [None, "t1", "t2", "t3", "t4"]


def test_a_stopped_read_goes_on_where_it_was(spark, tmp_path):
    pages = dict(PAGES)

    def fetch(token):
        return pages[token]

    stream = paged_stream(spark, "wiki_pages_api", "n int, title string", fetch, pages_per_batch=2)
    out, failing = str(tmp_path / "out"), [True]

    def write(batch, number):
        if number == 1 and failing:
            failing.clear()
            raise RuntimeError("stopped")
        # the batch's number makes a repeated batch replace itself
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with pytest.raises(Exception):
        read_pages(stream, write, str(tmp_path / "checkpoint"))
    assert read_pages(stream, write, str(tmp_path / "checkpoint")) >= 1
    rows = sorted((r.n, r.title) for r in spark.read.parquet(out).collect())
    assert rows == [(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "e"), (6, "f")]
    assert read_pages(stream, write, str(tmp_path / "checkpoint")) == 0
