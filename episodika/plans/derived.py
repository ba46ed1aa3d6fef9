"""Domain tables derived by Spark from the driver's tables, with the same definitions as SQL for the checks.

Every derivation is a projection (no shuffle), so queries over them scan exactly what they use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """A table spread by key over tasks before heavy per-row work: its files may be few and their rows uneven.

    With a number of partitions, or adaptive execution would put small rows with heavy work ahead of them back into one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages"), "page_id")


# Viewers used by the registered queries: position per series.
VECTOR_WATCHED = {"s0": 5, "s1": 20, "s2": 0, "s3": 50, "s4": 12, "s7": 33}
TEXT_WATCHED = {"src0": 10, "src1": 0, "src2": 25, "src3": 50, "src4": 7, "src11": 31}


def values_sql(watched: dict[str, int]) -> str:
    rows = ", ".join(f"('{k}', {v})" for k, v in watched.items())
    return f"watched(series_id, seen_ep) AS (VALUES {rows})"


def vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    kind = F.when(F.col("embedding")[0] >= 0, "event").otherwise("plot")
    return e.select(
        F.concat(F.lit("s"), F.col("label"), F.lit(":"), kind, F.lit(":"), F.col("vec_id")).alias("chunk_id"),
        F.concat(F.lit("s"), F.col("label")).alias("series_id"),
        kind.alias("type"),
        F.when(F.col("embedding")[1] <= 0.2, F.floor(F.col("vec_id") / 10).cast("int") + 1).alias("abs_ep"),
        "embedding",
        "vec_id",
    )


VECTOR_CHUNKS_SQL = """chunks AS (
  SELECT 's' || label || ':' || CASE WHEN embedding[1] >= 0 THEN 'event' ELSE 'plot' END || ':' || vec_id AS chunk_id,
         's' || label AS series_id,
         CASE WHEN embedding[1] >= 0 THEN 'event' ELSE 'plot' END AS type,
         CASE WHEN embedding[2] <= 0.2 THEN CAST(1 + vec_id // 10 AS INTEGER) END AS abs_ep,
         CAST(embedding AS DOUBLE[]) AS embedding, vec_id
  FROM embeddings)"""


def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    # one chunk type per language: event, plot, episode, character
    kind = (
        F.when(F.col("lang") == "en", "event")
        .when(F.col("lang") == "fr", "plot")
        .when(F.col("lang") == "de", "episode")
        .otherwise("character")
    )
    return d.select(
        F.concat("source", F.lit(":"), kind, F.lit(":"), F.col("doc_id")).alias("chunk_id"),
        F.col("source").alias("series_id"),
        kind.alias("type"),
        F.when(F.col("lang") != "es", F.floor(F.col("doc_id") / 20).cast("int") + 1).alias("abs_ep"),
        "text",
        "doc_id",
    )


TEXT_CHUNKS_SQL = """chunks AS (
  SELECT source || ':' || CASE lang WHEN 'en' THEN 'event' WHEN 'fr' THEN 'plot' WHEN 'de' THEN 'episode'
                                    ELSE 'character' END || ':' || doc_id AS chunk_id,
         source AS series_id,
         CASE lang WHEN 'en' THEN 'event' WHEN 'fr' THEN 'plot' WHEN 'de' THEN 'episode' ELSE 'character' END AS type,
         CASE WHEN lang <> 'es' THEN CAST(1 + doc_id // 20 AS INTEGER) END AS abs_ep,
         text, doc_id
  FROM documents)"""


def gated_sql(unrecorded: int, extra: str = "TRUE", watched: dict[str, int] | None = None, chunks_sql: str = "") -> str:
    """Common table expressions ``chunks``, ``watched`` and the gated rows ``g``."""
    return f"""WITH {chunks_sql}, {values_sql(watched or {})},
g AS (SELECT c.* FROM chunks c LEFT JOIN watched w ON w.series_id = c.series_id
      WHERE (c.abs_ep IS NULL OR c.abs_ep <= coalesce(w.seen_ep, {unrecorded})) AND {extra})"""


def vector_of(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    """One stored vector as the question; a single row read by key."""
    row = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row["embedding"]]


def text_of(spark: SparkSession, sf_dir: str, item_id: int) -> str:
    """One stored passage as the question; a single row read by key."""
    return table(spark, sf_dir, "benchmark").filter(F.col("item_id") == item_id).select("text").first()["text"]


def media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text chunks with the stored vector of the same number, where there is one."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return text_chunks(spark, sf_dir).join(e, "doc_id", "left")


MEDIA_CHUNKS_SQL = TEXT_CHUNKS_SQL.replace("chunks AS (", "text_chunks AS (", 1) + """,
chunks AS (SELECT t.*, CAST(e.embedding AS DOUBLE[]) AS embedding FROM text_chunks t
           LEFT JOIN embeddings e ON e.vec_id = t.doc_id)"""


def raw_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as entries of the series of their customer; an entry has as many episodes as the order has lines."""
    o = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("int").alias("episodes"))
    quarter = F.quarter("o_orderdate")
    season_name = F.element_at(F.array(*[F.lit(x) for x in ("WINTER", "SPRING", "SUMMER", "FALL")]), quarter)
    return o.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.concat(F.lit("c"), "o_custkey").alias("series_id"),
        F.concat(F.lit("e"), "o_orderkey").alias("entry_key"),
        F.concat(F.lit("Order "), "o_orderkey").alias("title"),
        F.year("o_orderdate").alias("year"),
        season_name.alias("season_of_year"),
        "episodes",
        F.when(F.col("o_orderstatus") == "O", "ONGOING").otherwise("FINISHED").alias("status"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("tmdb_season"),
        F.when(F.col("o_orderstatus") == "P", quarter * 3).alias("tmdb_offset"),
        F.round("o_totalprice").cast("bigint").alias("popularity"),
        F.to_date("o_orderdate").alias("airdate"),
        "o_orderkey",
    )


ENTRIES_SQL = """raw_entries AS (
  SELECT 'c' || o_custkey AS series_id, 'e' || o_orderkey AS entry_key, 'Order ' || o_orderkey AS title,
         CAST(year(o_orderdate) AS INTEGER) AS year, CAST(quarter(o_orderdate) AS INTEGER) AS quarter,
         (SELECT CAST(nullif(count(*), 0) AS INTEGER) FROM lineitem WHERE l_orderkey = o_orderkey) AS episodes,
         CASE WHEN o_orderstatus = 'O' THEN 'ONGOING' ELSE 'FINISHED' END AS status,
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS tmdb_season,
         CASE WHEN o_orderstatus = 'P' THEN CAST(quarter(o_orderdate) * 3 AS INTEGER) END AS tmdb_offset,
         CAST(round(o_totalprice) AS BIGINT) AS popularity, CAST(o_orderdate AS DATE) AS airdate, o_orderkey
  FROM orders),
entries AS (
  SELECT *, CAST(row_number() OVER w AS INTEGER) AS order_in_series,
         CAST(coalesce(sum(episodes) OVER (PARTITION BY series_id ORDER BY year, quarter, tmdb_season,
              coalesce(tmdb_offset, 0), title, entry_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS abs_offset
  FROM raw_entries
  WINDOW w AS (PARTITION BY series_id ORDER BY year, quarter, tmdb_season, coalesce(tmdb_offset, 0), title, entry_key))"""


def listed_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as the episode list of an outside source, by outside season."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_suppkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return lines.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(F.lit("c"), "o_custkey").alias("series_id"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("season"),
        F.to_date("l_shipdate").alias("airdate"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
    )


LISTED_SQL = """listed AS (
  SELECT 'c' || o_custkey AS series_id, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS season,
         CAST(l_shipdate AS DATE) AS airdate, l_orderkey, l_linenumber, l_partkey, l_suppkey
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""
