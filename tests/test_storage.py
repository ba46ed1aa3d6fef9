"""Keyed changes, records, landed sources, tables and incremental runs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F, types as T

from episodika.operators import catalog, merge
from episodika.plans import chunks, records, reports, seed
from episodika.sources import landing, tables
from episodika.streaming import incremental

NOW = dt.datetime(2026, 10, 1)


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_vector_lives_as_long_as_its_text(spark):
    old = spark.createDataFrame([("a", "one", [1.0]), ("b", "two", [2.0]), ("c", "kept", [3.0])], "chunk_id string, text string, embedding array<float>")
    new = spark.createDataFrame([("a", "one"), ("b", "changed"), ("d", "new")], "chunk_id string, text string")
    assert rows_of(merge.upsert_chunks(old, new), "chunk_id") == [("a", "one", [1.0]), ("b", "changed", None), ("c", "kept", [3.0]), ("d", "new", None)]


def test_refresh_drops_vanished_chunks_of_rebuilt_series_only(spark):
    schema = "series_id string, chunk_id string, text string, embedding array<float>"
    old = spark.createDataFrame([("S", "a", "one", [1.0]), ("S", "gone", "x", [1.0]), ("T", "t", "other", [2.0])], schema)
    built = spark.createDataFrame([("S", "a", "one"), ("S", "b", "new")], "series_id string, chunk_id string, text string")
    once = chunks.refresh(old, built)
    assert [r["chunk_id"] for r in once.orderBy("chunk_id").collect()] == ["a", "b", "t"]
    assert rows_of(chunks.refresh(once, built), "chunk_id") == rows_of(once, "chunk_id")


@pytest.fixture
def catalogue(spark):
    series = spark.createDataFrame([("A", "Show A", "가", 10, None), ("B", "Show B", None, 5, None)], "series_id string, title string, title_ko string, total_episodes int, poster_url string")
    empty = spark.createDataFrame([], "user_id string, series_id string, seen_ep int, rating float, updated_at timestamp")
    return series, empty


def test_records(spark, catalogue):
    series, empty = catalogue
    r = records.save_one(empty, series, "u", "A", 3, 4.5, at=NOW)
    r = records.save_one(r, series, "u", "A", 5, at=NOW + dt.timedelta(days=1))
    r = records.save_one(r, series, "u", "B", 0, at=NOW + dt.timedelta(days=2))
    assert records.get(r, series, "u", "A")["seen_ep"] == 5 and records.get(r, series, "u", "A")["rating"] == 4.5
    assert [x["series_id"] for x in records.listed(r, series, "u").collect()] == ["B", "A"]
    assert {x["series_id"]: x["seen_ep"] for x in records.watched_map(r, "u").collect()} == {"A": 5, "B": 0}
    assert records.watched_map(r, "someone").isEmpty() and records.get(r, series, "u", "Z") is None
    left, existed = records.delete(r, "u", "A")
    assert existed and left.count() == 1 and not records.delete(left, "u", "A")[1]


@pytest.mark.parametrize("seen, rating", [(-1, None), (11, None), (2.5, None), (None, None), (True, None), (3, 6.0), (3, 0.1)])
def test_bad_records_are_refused(spark, catalogue, seen, rating):
    series, empty = catalogue
    with pytest.raises(ValueError):
        records.save_one(empty, series, "u", "A", seen, rating, at=NOW)


def test_records_of_unknown_series_are_refused(spark, catalogue):
    with pytest.raises(records.UnknownSeries):
        records.save_one(catalogue[1], catalogue[0], "u", "Z", 1, at=NOW)


def test_fetching_goes_through_the_cache(spark):
    raw = spark.createDataFrame([("api", "1", '{"a": 1}', NOW)], landing.RAW_SCHEMA)
    wanted = spark.createDataFrame([("api", str(i), f"https://h.org/{i}") for i in range(1, 6)], "source string, key string, url string")

    def fetch(source, url):
        n = int(url.rsplit("/", 1)[1])
        if n == 1:
            raise AssertionError("cached requests must not be fetched")
        return {2: (200, '{"a": 2}', None), 3: (404, None, None), 4: (503, None, 0.0), 5: (403, None, None)}[n]

    answers = landing.fetch_through(wanted, raw, fetch, sleep=lambda s: None)
    cache = landing.remember(raw, answers, NOW)
    assert rows_of(answers.select("key", "status", "error"), "key") == [("2", 200, None), ("3", 404, None), ("4", 503, "status 503"), ("5", 403, "status 403")]
    assert rows_of(cache.select("key", "data"), "key") == [("1", '{"a": 1}'), ("2", '{"a": 2}'), ("3", None)]
    assert rows_of(landing.pages_of(cache, "api", "a int").select("body.a"), "a") == [(1,), (2,)]
    assert [r["key"] for r in landing.to_fetch(wanted, cache).orderBy("key").collect()] == ["4", "5"]


def test_categories_open_level_by_level(spark):
    tree = spark.createDataFrame([("Episodes", "S1"), ("Episodes", "S2"), ("S1", "S1a")], "parent string, child string")
    members = spark.createDataFrame([("Episodes", "p0"), ("S1", "p1"), ("S2", "p2"), ("S1a", "p3")], "category string, title string")
    titles = lambda n: sorted(r["title"] for r in landing.category_pages(tree, members, "Episodes", n).collect())
    assert titles(2) == ["p0"] and titles(6) == ["p0", "p1", "p2"] and titles(50) == titles(None) == ["p0", "p1", "p2", "p3"]


def test_a_change_rewrites_its_buckets_or_nothing(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType()), T.StructField("later", T.StringType())])
    path = str(tmp_path / "t")
    read = lambda: rows_of(tables.read_table(spark, path, schema), "k")
    assert read() == []
    add = lambda stored, changes: stored.unionByName(changes, allowMissingColumns=True)
    tables.change_table(spark, path, schema, ["k"], spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), add, buckets=4)
    with pytest.raises(Exception):
        fail = lambda stored, changes: stored.withColumn("v", F.raise_error(F.lit("boom")))
        tables.change_table(spark, path, schema, ["k"], spark.createDataFrame([(1, "x")], "k long, v string"), fail, buckets=4)
    assert read() == [(1, "a", None), (2, "b", None)]
    tables.change_table(spark, path, schema, ["k"], spark.createDataFrame([], "k long, v string"), add, buckets=4)
    assert read() == [(1, "a", None), (2, "b", None)]
    broken = tables.violations(spark.createDataFrame([(1, -1), (1, None)], "k int, v int"), ["k"], ["v"], {"v positive": "v >= 0"})
    assert {r["constraint"]: r["n"] for r in broken.collect()} == {"unique key": 1, "v not null": 1, "v positive": 1}


@pytest.mark.parametrize("stored,given,key", [("long", "int", "id"), ("string", "long", "id"), ("date", "timestamp", "timestampadd(DAY, CAST(id AS INT), TIMESTAMP '2020-01-01 13:00:00')")])
def test_keys_of_other_types_lose_no_rows(spark, tmp_path, stored, given, key):
    schema = T.StructType.fromDDL(f"k {stored}, at long")
    path = str(tmp_path / "t")
    apply = incremental.upsert_into(spark, path, schema, ["k"], ["at"], buckets=16)
    keyed = lambda n, kind, at: spark.range(n).select(F.expr(key).cast(kind).alias("k"), F.lit(at).alias("at"))
    apply(keyed(200, stored, 1), 0)
    apply(keyed(10, given, 2), 0)
    apply(keyed(10, given, 2), 0)
    rows = tables.read_table(spark, path, schema)
    assert rows.count() == rows.select("k").distinct().count() == 200 and rows.where("at = 2").count() == 10


def test_a_change_reads_only_its_buckets(spark, tmp_path):
    schema = T.StructType.fromDDL("k long, v string")
    path, seen = str(tmp_path / "t"), []
    add = lambda stored, changes: stored.join(changes, "k", "left_anti").unionByName(changes)
    tables.change_table(spark, path, schema, ["k"], spark.range(100).select(F.col("id").alias("k"), F.lit("a").alias("v")), add, buckets=16)

    def look(stored, changes):
        seen.append(stored._jdf.queryExecution().executedPlan().toString())
        return add(stored, changes)

    tables.change_table(spark, path, schema, ["k"], spark.createDataFrame([(1, "b")], "k int, v string"), look, buckets=16)
    assert "_bucket" in seen[0].split("PartitionFilters: [")[1].split("]")[0]
    assert tables.read_table(spark, path, schema).count() == 100


def test_streamed_changes_end_in_the_same_table_in_any_order(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("at", T.LongType()), T.StructField("v", T.StringType())])
    first = spark.createDataFrame([(1, 5, "new"), (2, 1, "b")], schema)
    late = spark.createDataFrame([(1, 2, "late"), (2, 3, "c"), (3, 1, "d")], schema)
    results = []
    for name, order in (("x", (first, late)), ("y", (late, first))):
        folder = tmp_path / name
        apply = incremental.upsert_into(spark, str(folder / "table"), schema, ["k"], ["at"], buckets=4)
        for part in order:
            part.coalesce(1).write.mode("append").parquet(str(folder / "in"))
            stream = incremental.changes_from(spark, str(folder / "in"), schema)
            incremental.run_available(stream, apply, str(folder / "checkpoint"))
        apply(late, 0)
        # another stream with a batch of the same number
        apply(spark.createDataFrame([(4, 1, "other")], schema), 0)
        results.append(rows_of(tables.read_table(spark, str(folder / "table"), schema), "k"))
    assert results[0] == results[1] == [(1, 5, "new"), (2, 3, "c"), (3, 1, "d"), (4, 1, "other")]


def test_one_bad_item_does_not_stop_the_others(spark):
    def work(item):
        if item["series_id"] == "b":
            raise ValueError("no data")
        return ("ok", "fine")

    items = spark.createDataFrame([("a",), ("b",), ("c",)], "series_id string")
    ledger = incremental.process(items, work, "series_id", "src", NOW)
    assert rows_of(ledger.select("series_id", "status", "detail"), "series_id") == [("a", "ok", "fine"), ("b", "error", "ValueError: no data"), ("c", "ok", "fine")]
    series = items.withColumn("popularity", F.lit(1))
    assert [r["series_id"] for r in seed.work_list(series, ledger, "src").collect()] == ["b"]
    assert not incremental.must_stop(ledger, "src") and incremental.must_stop(ledger.filter("status = 'error'"), "src", 1)


def test_catalogue_lookups(spark):
    series = spark.createDataFrame(
        [("A", "Attack", "진격의 거인", None, ["AoT"], 9), ("B", "Giant", "거인", None, [], 5), ("K", "K", None, None, [], 1)],
        "series_id string, title string, title_ko string, title_original string, alt_titles array<string>, popularity int")
    entries = spark.createDataFrame([("A", 1, "Attack", "Attack on Titan", ["AOT2"]), ("B", 1, "Giant", None, []), ("K", 1, "K", None, [])],
                                    "series_id string, order_in_series int, title string, title_en string, synonyms array<string>")
    aliases = spark.createDataFrame([("진격", "A"), ("없음", "Z")], "alias string, series_id string")
    index = catalog.title_index(series, entries, aliases)
    found = lambda text: [r["series_id"] for r in catalog.mentioned_in(index, text).collect()]
    assert found("진격의 거인 봤어") == ["A"] and found("거인 봤어") == ["B"] and found("attack on titan!") == ["A"] and found("OK") == []
    best = lambda q: [r["series_id"] for r in catalog.find_series(index, q).collect()]
    assert best("attack")[0] == "A" and best("거인")[0] == "B" and best("k") == [] and best("zzz") == []
    texts = spark.createDataFrame([(1, "진격의 거인과 거인"), (2, "거인만"), (3, "attack on titan giant"), (4, "none")], "text_id int, text string")
    got = {(r["text_id"], r["series_id"]) for r in catalog.mentions(texts, index).collect()}
    assert got == {(1, "A"), (2, "B"), (3, "A"), (3, "B")}


def test_reports_render(spark):
    df = spark.createDataFrame([("a", 1), ("b", None)], "name string, n int")
    assert reports.as_markdown(df) == "| name | n |\n| --- | --- |\n| a | 1 |\n| b |  |\n"


def test_every_table_has_its_keys_and_checks(spark):
    from episodika.schema import TABLES, schema_of

    assert len(TABLES) == 12
    for name, spec in TABLES.items():
        names = set(schema_of(spark, name).names)
        assert {*spec.keys, *spec.not_null, *spec.partition_by, *spec.sort_by} <= names
    spec = TABLES["watch_records"]
    rows = spark.createDataFrame([("u", "A", -1, 6.0, NOW), ("u", "A", 2, None, NOW)], spec.columns)
    broken = {r["constraint"]: r["n"] for r in tables.violations(rows, spec.keys, spec.not_null, spec.checks).collect()}
    assert broken == {"unique key": 1, "seen_ep from 0": 1, "rating in range": 1}


def test_names_are_found_in_shards_of_any_size(spark):
    names = ["redboulder", "boulder", "bouldering", "두산", "산", "titanfall", "fall", "missing", "aaaa", "aaaaa"]
    texts = {1: "the redbouldering of titanfall", 2: "aaaaaa", 3: "", 4: "백두산 천지", 5: "nothing", None: "boulder"}
    df = spark.createDataFrame(list(texts.items()), "text_id long, hay string")
    listed = spark.createDataFrame([(n,) for n in names * 2], "name string")
    want = sorted(((t, n) for t, hay in texts.items() for n in names if n in hay), key=str)
    for chars in (10_000, 12, 1):
        assert sorted(map(tuple, catalog.names_in(df, listed, chars).collect()), key=str) == want
    assert catalog.names_in(df, listed.limit(0)).count() == 0


def test_copied_rows_are_not_sorted(spark):
    source = spark.createDataFrame([(s, "x" * 9) for s in "aabc"], "series_id string, plot string")
    ids = spark.createDataFrame([("a",), ("a",), ("c",)], "series_id string")
    copied = merge.copy_by_ids(source, ids, ["series_id", "plot", "added"])
    plan = copied._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Sort" not in plan.replace("SortAggregate", "")
    assert sorted(r["series_id"] for r in copied.collect()) == ["a", "a", "c"]
