"""Reading landed files and fetching through a response cache.

Nothing here opens a connection by itself: live fetching runs an injected function inside the tasks.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from episodika.operators.merge import upsert
from episodika.session import cut_lineage

RAW_SCHEMA = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("data", T.StringType()),
        T.StructField("fetched_at", T.TimestampType()),
    ]
)

# Statuses that are retried, how often, and the longest wait between tries in seconds.
RETRIED = (429, 500, 502, 503, 504)
TRIES = 4
MAX_WAIT = 90

Fetch = Callable[[str, str], tuple[int, str | None, float | None]]


def json_document(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A downloaded JSON file, or many of them."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def items_of(document: DataFrame, array: str = "data") -> DataFrame:
    """One row per element of the document's list, its fields as columns."""
    return document.select(F.explode(array).alias("item")).select("item.*")


def raw_responses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RAW_SCHEMA).parquet(path)


def pages_of(raw: DataFrame, source: str, schema: str, key_prefix: str = "") -> DataFrame:
    """Cached responses of a source parsed with a schema; a cached "not there" (null body) yields no row."""
    rows = raw.filter((F.col("source") == source) & F.col("key").startswith(key_prefix) & F.col("data").isNotNull())
    return rows.select("key", F.from_json("data", schema).alias("body"))


def to_fetch(wanted: DataFrame, raw: DataFrame, refresh: bool = False) -> DataFrame:
    """Requests (source, key, url) not yet answered from the cache."""
    rows = wanted.dropDuplicates(["source", "key"])
    return rows if refresh else rows.join(raw.select("source", "key"), ["source", "key"], "left_anti")


def fetch_through(wanted: DataFrame, raw: DataFrame, fetch: Fetch, *, sleep: Callable[[float], None], partitions: int = 1, refresh: bool = False) -> DataFrame:
    """Answers of the missing requests: source, key, data, status, error. Requests of one host share a task.

    ``fetch(source, url)`` returns (status, body, retry_after). 404 is an answer too (no body, remembered); a status
    worth retrying is tried again after the wait the server names or a growing one; what still fails is an error row.
    """
    todo = to_fetch(wanted, raw, refresh).withColumn("host", F.try_parse_url("url", F.lit("HOST")))
    schema = "source string, key string, data string, status int, error string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(r.source, r.key, *_attempt(fetch, r.source, r.url, sleep)) for r in frame.itertuples()]
            yield pd.DataFrame(rows, columns=["source", "key", "data", "status", "error"])

    return todo.repartition(int(partitions), "host").select("source", "key", "url").mapInPandas(run, schema)


def _attempt(fetch: Fetch, source: str, url: str, sleep) -> tuple[str | None, int, str | None]:
    status, error = 0, None
    for n in range(TRIES):
        try:
            status, body, wait = fetch(source, url)
        except OSError as problem:
            status, body, wait, error = 0, None, None, f"{type(problem).__name__}: {problem}"
        if status == 200:
            return body, 200, None
        if status == 404:
            return None, 404, None
        if status and status not in RETRIED:
            break
        if n + 1 < TRIES:
            sleep(min(MAX_WAIT, wait if wait is not None else 2.0**n))
    return None, status, error or f"status {status}"


def remember(raw: DataFrame, answers: DataFrame, fetched_at) -> DataFrame:
    """The cache with new answers; failures are not remembered."""
    good = answers.filter(F.col("error").isNull()).select("source", "key", "data", F.lit(fetched_at).cast("timestamp").alias("fetched_at"))
    return upsert(raw, good, ["source", "key"])


def resume_after(pages: DataFrame) -> DataFrame:
    """Last title received per wiki in the order the wiki lists titles, to continue a full scan behind it."""
    return pages.groupBy("wiki").agg(F.max_by("title", F.replace("title", F.lit(" "), F.lit("_"))).alias("title"))


def after_mark(listing: DataFrame, marks: DataFrame) -> DataFrame:
    """Titles of a listing that come behind the mark of their wiki."""
    joined = listing.join(marks.withColumnRenamed("title", "_mark"), "wiki", "left")
    key = lambda c: F.replace(c, F.lit(" "), F.lit("_"))
    return joined.filter(F.col("_mark").isNull() | (key("title") > key("_mark"))).drop("_mark")


def category_pages(
    tree: DataFrame, members: DataFrame, root: str, expected: int | None = None, max_depth: int | None = None, max_categories: int | None = None
) -> DataFrame:
    """Pages of a category and of all categories below it, opened level by level.

    ``tree``: parent, child. ``members``: category, title. With ``expected`` the descent ends once half as many pages are
    found; ``max_depth`` and ``max_categories`` bound it; None leaves it complete.
    """
    opened = tree.sparkSession.createDataFrame([(root, 0)], "category string, depth int")
    for depth in itertools.count(1) if max_depth is None else range(1, max_depth + 1):
        if expected is not None:
            found = members.join(opened.select("category"), "category", "left_semi").select("title").distinct()
            if found.limit(max(1, -(-expected // 2))).count() * 2 >= expected:
                break
        level = opened.filter(F.col("depth") == depth - 1).select(F.col("category").alias("parent"))
        below = tree.join(level, "parent").select(F.col("child").alias("category")).distinct()
        below = below.join(opened.select("category"), "category", "left_anti").orderBy("category")
        if max_categories is not None:
            below = below.limit(max(max_categories - opened.count(), 0))
        if below.isEmpty():
            break
        opened = cut_lineage(opened.unionByName(below.withColumn("depth", F.lit(depth))))
    return members.join(opened.select("category"), "category", "left_semi")


def first_writer(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Directory map where the first entry of a key wins."""
    return rows.groupBy(key).agg(F.min_by(value, order).alias(value))
