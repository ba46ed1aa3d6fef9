"""Deterministic rules of the conversation: which numbers, ratings and titles a message really says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from episodika.functions.text import norm_name, strip

# ---- Fixed values: notations and limits ---------------------------------------------------------------------------
SEASON_NOTATION = r"(?i)\d+\s*(기|시즌|season|쿨)|(시즌|season)\s*\d+"
UP_TO = r"(\d+)\s*화?\s*까지"
NICKNAME = r"[0-9A-Za-z가-힣_-]{2,20}"
TEXT_LIMITS = (1, 1000)
HISTORY_LIMIT = 20
LIST_LIMITS = (1, 200)
# --------------------------------------------------------------------------------------------------------------------


def episode_numbers(text: Column) -> Column:
    """Numbers before "up to" if there are any, otherwise every number of the text."""
    anchored = F.regexp_extract_all(text, F.lit(UP_TO), F.lit(1))
    return F.when(F.size(anchored) > 0, anchored).otherwise(F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0)))


def says_season(text: Column) -> Column:
    return text.rlike(SEASON_NOTATION)


def rating_said(rating: Column, text: Column) -> Column:
    """The number stands right next to the word for points or stars."""
    whole = rating == F.floor(rating)
    forms = F.when(whole, F.concat(rating.cast("bigint").cast("string"), F.lit(r"(?:\.0)?"))).otherwise(
        F.replace(rating.cast("double").cast("string"), F.lit("."), F.lit(r"\."))
    )
    pattern = F.concat(F.lit(r"(?<![\d.])"), forms, F.lit(r"\s*점|별\s*"), forms, F.lit(r"(?![\d.])"))
    return F.coalesce(F.regexp_like(text, pattern), F.lit(False))


def mentions(name: Column, text: Column) -> Column:
    key = norm_name(name)
    return (key != "") & norm_name(text).contains(key)


def user_id_of(header: Column) -> Column:
    """User id of a nickname header: ``local`` without one, NULL for a bad one."""
    name = strip(F.try_url_decode(header))
    return F.when(header.isNull(), F.lit("local")).when(
        name.rlike(r"\A(?:" + NICKNAME + r")\z"), F.concat(F.lit("user:"), name)
    )


def text_ok(text: Column) -> Column:
    return F.coalesce(F.length(text).between(*TEXT_LIMITS), F.lit(False))


def last_turns(turns: DataFrame) -> DataFrame:
    """Per conversation the last assistant turn and the user turn before it; map-side combined."""
    said = F.struct("turn", "text")
    last = turns.groupBy("conv_id").agg(F.max(F.when(F.col("role") == "assistant", F.col("turn"))).alias("assistant_turn"))
    joined = turns.join(last, "conv_id")
    before = (F.col("role") == "user") & (F.col("turn") < F.col("assistant_turn"))
    rows = joined.groupBy("conv_id").agg(
        F.max("assistant_turn").alias("assistant_turn"),
        F.max(F.when(F.col("turn") == F.col("assistant_turn"), F.col("text"))).alias("assistant_text"),
        F.max(F.when(before, said)).alias("before"),
    )
    return rows.select(
        "conv_id", "assistant_turn", "assistant_text",
        F.col("before.turn").alias("user_turn"), F.col("before.text").alias("user_text"),
    )


def save_allowed(message: Column, clarified: Column, seen_ep: Column, known: Column, candidates: Column, named: Column) -> Column:
    """Why a position is not saved; NULL when it may be. ``clarified`` is the message a follow-up question referred to."""
    number = seen_ep.cast("string")
    said = F.array_contains(episode_numbers(message), number) | F.coalesce(
        F.array_contains(episode_numbers(clarified), number), F.lit(False)
    )
    return (
        F.when(~known, "unknown id")
        .when((candidates >= 2) & ~named, "several candidates")
        .when(~said, "number not said")
        .when(says_season(message), "season notation")
    )
