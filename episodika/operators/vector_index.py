"""A vector index kept as files: cells as folders, their radii as a small table that grows with every addition.

``{path}/cells/cell=N`` holds the vectors next to centre N with the columns the gate needs, ``{path}/radii`` a row for each cell
and addition (largest angle, rows), ``{path}/centres`` the centres. Nothing is rewritten: an addition appends, and a cell's radius is
the largest of its rows. A search reads the two small tables, then only the folders of cells that can hold a better vector.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from episodika.config import DEFAULTS
from episodika.operators import vectors
from episodika.operators.gate import Watched

#: what is stored of a chunk
COLUMNS = ["chunk_id", "series_id", "type", "abs_ep", "embedding"]


def choose_centres(chunks: DataFrame, number: int) -> list[list[float]]:
    """``number`` stored vectors spread by the hash of their id: a bounded sample, the same for the same rows."""
    rows = chunks.filter(F.col("embedding").isNotNull()).select("embedding", F.xxhash64("chunk_id").alias("h")).orderBy("h").limit(int(number))
    return [[float(x) for x in row["embedding"]] for row in rows.select("embedding").collect()]


def create(chunks: DataFrame, path: str, centres: Sequence[Sequence[float]]) -> None:
    """A new index of ``chunks`` around ``centres``, which stay as they are for all later additions."""
    spark = chunks.sparkSession
    rows = [(n, [float(x) for x in c]) for n, c in enumerate(centres)]
    spark.createDataFrame(rows, "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    _append(chunks, path, centres)


def add(chunks: DataFrame, path: str) -> None:
    """Appends the chunks whose id is not in the index yet, so an addition that comes again changes nothing."""
    known = chunks.sparkSession.read.parquet(f"{path}/cells").select("chunk_id")
    _append(chunks.join(known, "chunk_id", "left_anti"), path, centres_of(chunks.sparkSession, path))


def _append(chunks: DataFrame, path: str, centres: Sequence[Sequence[float]]) -> None:
    placed = vectors.build_cells(chunks.filter(F.col("embedding").isNotNull()).select(*COLUMNS), centres)
    part = F.pmod(F.xxhash64("chunk_id"), F.lit(8))  # a full cell is several files, written by several tasks
    placed.repartition("cell", part).write.mode("append").partitionBy("cell").parquet(f"{path}/cells")
    # radii of the whole cells: read from what was written, so that a failed addition leaves none behind that is too small
    stored = chunks.sparkSession.read.parquet(f"{path}/cells").groupBy("cell").agg(F.max("cell_angle").alias("radius"), F.count("*").alias("n"))
    stored.coalesce(1).write.mode("append").parquet(f"{path}/radii")


def centres_of(spark: SparkSession, path: str) -> list[list[float]]:
    """As many rows as the index was made with."""
    return [list(row["centre"]) for row in spark.read.parquet(f"{path}/centres").orderBy("cell").collect()]


def radii_of(spark: SparkSession, path: str) -> dict[int, tuple[float, int]]:
    """Radius and rows of each cell that holds any; at most a number for each centre."""
    rows = spark.read.parquet(f"{path}/radii").groupBy("cell").agg(F.max("radius").alias("r"), F.max("n").alias("n"))
    return {row["cell"]: (float(row["r"]), int(row["n"])) for row in rows.collect()}


def search(
    spark: SparkSession, path: str, query: Sequence[float], *, watched: Watched, unrecorded: int = 0, types: Iterable[str] | None = DEFAULTS.chunk_types,
    k: int = DEFAULTS.top_k, probe: int = 4,
) -> DataFrame:
    """Top-k of the stored vectors, equal to the exact search; only folders of cells that can matter are read."""
    cells = spark.read.parquet(f"{path}/cells")
    return vectors.search_cells(
        cells, centres_of(spark, path), radii_of(spark, path), query, watched=watched, unrecorded=unrecorded, types=types, k=k, probe=probe
    )
