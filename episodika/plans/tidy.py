"""Tidying chunk rows: clean bodies, drop empty ones, keep one of several equal bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from episodika.functions import text as t
from episodika.operators.dedup import digest, keep_one

# Chunk types that are only cleaned, and the title mark of an untitled episode.
CLEAN_ONLY = ("summary", "streaming")
UNTITLED = r"(?iU) 〈" + t.EPISODE_NAME + r"〉"


def tidy_body(kind: Column, body: Column) -> Column:
    lines = F.split(t.clean_markup(body), "\n", -1)
    kept = F.filter(lines, lambda x: ~t.is_placeholder(x) & ~((kind == "episode") & t.is_episode_name(x)))
    return F.array_join(kept, "\n")


def tidy(chunks: DataFrame) -> DataFrame:
    """``chunks``: series_id, seq, chunk_id, type, abs_ep, text, ... Bodies equal within (series, type) leave one row.

    That row is the one of the latest episode, so a shared text never becomes visible too early; on equal episodes the
    earlier row stays. It takes the place (``seq``) of the first. Character rows are never merged.
    """
    kind = F.col("type")
    whole = kind.isin(*CLEAN_ONLY)
    # exploded from an array of one, so that the filter below is not pushed under it and the body computed twice
    rows = chunks.withColumn("_body", F.explode(F.array(F.when(~whole, tidy_body(kind, t.body_of("text"))))))
    least = F.when(kind == "episode", t.MIN_BODY["episode"]).otherwise(t.MIN_BODY["other"])
    rows = rows.filter(whole | t.at_least("_body", least))
    head = F.regexp_replace(t.head_of("text"), UNTITLED, "")
    rows = rows.withColumn(
        "text", F.when(whole, t.clean_markup("text")).otherwise(F.concat(head, F.lit("\n"), F.col("_body")))
    )
    # rows that are never merged get a key of their own
    own = F.when(whole | (kind == "character"), F.col("chunk_id")).otherwise(F.lit(""))
    body_key = F.when(whole | (kind == "character"), F.lit("")).otherwise(digest("_body"))
    better = F.struct(F.coalesce("abs_ep", F.lit(0)), -F.col("seq"))
    return keep_one(rows, ["series_id", "type", own, body_key], better, "seq").select(*chunks.columns)
