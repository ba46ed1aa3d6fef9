"""Lines that many documents share, dropped from all but one.

Hashes of the lines are range-partitioned by (hash, salt of the document) and sorted by document and position inside. A
streaming window meets each document's first line of a hash; these first occurrences, combined inside the task, give the
number of documents and the one that keeps the line. A line that a third of all documents hold is spread over its salts.
Only hashes and positions move; the answer for a document is its keep bitmap, run-length coded.

Defined cases: a null or empty text is one empty line. Rows of one ``doc_id`` are one document when lines are counted, and
rows with the largest ``doc_id`` holding a line all keep it; a null ``doc_id`` is a document smaller than all others. Lines
repeated inside the keeping document all stay. Further columns are kept; in ``line_keep_runs`` columns called like a result give way
to it, in ``line_dedup`` all columns are as they came.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from episodika.llm.common import BLANKS, ascii_lower, numbered, replace_columns, whole
from episodika.session import cut_lineage

#: parts into which the lines of one hash are dealt, by document
SALTS = 256


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def keep_flags(runs: Column) -> Column:
    """One boolean per line from run lengths that begin with kept lines."""
    return F.flatten(F.transform(runs, lambda n, i: F.array_repeat(i % 2 == 0, n)))


def kept_text(text: Column, runs: Column) -> Column:
    lines = F.arrays_zip(F.split(whole(text), "\n", -1).alias("line"), keep_flags(runs).alias("keep"))
    return F.array_join(F.transform(F.filter(lines, lambda x: x["keep"]), lambda x: x["line"]), "\n")


def _runs(dropped: Column, n_lines: Column) -> Column:
    """Sorted positions of dropped lines as run lengths: kept, dropped, kept, ..."""
    starts = F.filter(dropped, lambda p, i: (i == 0) | (F.get(dropped, i - 1) != p - 1))
    ends = F.transform(
        F.filter(dropped, lambda p, i: (i == F.size(dropped) - 1) | (F.get(dropped, i + 1) != p + 1)), lambda p: p + 1
    )
    bounds = F.array_sort(F.concat(F.array(F.lit(0)), starts, ends, F.array(n_lines)))
    return F.transform(F.slice(bounds, F.lit(1), F.size(bounds) - 1), lambda b, i: F.get(bounds, i + 1) - b)


def line_keep_runs(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, text: str = "text", id: str = "doc_id") -> DataFrame:
    """All columns of ``docs`` with ``n_lines``, ``n_dropped`` (long) and ``keep_runs`` (array of run lengths)."""
    base = replace_columns(docs, _row=F.xxhash64(whole(text)))
    lines = base.select(F.col(id).alias("doc"), F.col("_row").alias("row"), F.posexplode(F.split(whole(text), "\n", -1)).alias("pos", "line"))
    keys = lines.select("doc", "row", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    keys = keys.select("doc", "row", "pos", F.unhex(F.md5("key")).alias("hash"), F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int").alias("salt"))
    keys = cut_lineage(keys)  # texts are cut into lines once; hashes are sampled, sorted and joined from here
    ranged = keys.repartitionByRange("hash", "salt")
    stream = Window.partitionBy("hash", "salt").orderBy(F.desc_nulls_last("doc"), "pos")
    firsts = ranged.select(
        "hash", "doc", ((F.row_number().over(stream) == 1) | ~F.lag("doc").over(stream).eqNullSafe(F.col("doc"))).alias("first")
    ).where("first")
    repeated = firsts.groupBy("hash").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("keeper")).where(F.col("n_docs") >= min_docs)
    repeated = cut_lineage(repeated.select("hash", "keeper"))  # on its own the join can split a line that very many documents hold
    dropped = keys.join(repeated, "hash").where(~F.col("doc").eqNullSafe(F.col("keeper")))
    dropped = dropped.groupBy("doc", "row").agg(F.sort_array(F.collect_set("pos")).alias("_dropped"))
    dropped = dropped.withColumnsRenamed({"doc": "_doc", "row": "_drow"})
    joined = base.join(dropped, base[id].eqNullSafe(dropped["_doc"]) & (base["_row"] == dropped["_drow"]), "left")
    n_lines = F.size(F.split(whole(text), "\n", -1))
    positions = F.coalesce("_dropped", F.array().cast("array<int>"))
    out = replace_columns(
        joined, n_lines=n_lines.cast("long"), n_dropped=F.size(positions).cast("long"), keep_runs=_runs(positions, n_lines)
    )
    return out.drop("_row", "_doc", "_drow", "_dropped")


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``docs`` with the dropped lines taken out of ``text``; columns as they came."""
    plain, at = numbered(docs)
    marked = line_keep_runs(plain, min_chars, min_docs, at[text], at[id])
    marked = marked.withColumn(at[text], kept_text(F.col(at[text]), F.col("keep_runs")))
    return marked.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
