"""Viewer records: position and rating per (user, series)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from episodika.operators import merge

# The rating scale.
MIN_RATING, MAX_RATING = 0.5, 5.0


class UnknownSeries(ValueError):
    """A series id that is not in the catalogue."""


def problem(seen_ep: Column, rating: Column, total: Column, known: Column) -> Column:
    """Why a change is refused; NULL when it is fine. A total of 0 or NULL sets no upper limit."""
    whole = seen_ep.cast("double") == F.floor(seen_ep.cast("double"))
    return (
        F.when(~known, "unknown series")
        .when(seen_ep.isNull() | ~whole | (seen_ep < 0), "position")
        .when((F.coalesce(total, F.lit(0)) > 0) & (seen_ep > total), "position")
        .when(rating.isNotNull() & ~rating.between(MIN_RATING, MAX_RATING), "rating")
    )


def checked(changes: DataFrame, series: DataFrame) -> DataFrame:
    """Changes (user_id, series_id, seen_ep, rating, updated_at) with a ``problem`` column."""
    totals = series.select("series_id", "total_episodes").withColumn("_known", F.lit(True))
    joined = changes.join(totals, "series_id", "left")
    why = problem(F.col("seen_ep"), F.col("rating"), F.col("total_episodes"), F.coalesce("_known", F.lit(False)))
    return joined.withColumn("problem", why).drop("_known", "total_episodes")


def collapse(changes: DataFrame) -> DataFrame:
    """Several changes of one record in one: last position, last rating given, last time."""
    at = F.struct("updated_at", "change_id")
    return changes.groupBy("user_id", "series_id").agg(
        F.max_by("seen_ep", at).alias("seen_ep"),
        F.max_by("rating", F.when(F.col("rating").isNotNull(), at)).alias("rating"),
        F.max("updated_at").alias("updated_at"),
    )


def save(records: DataFrame, changes: DataFrame, series: DataFrame) -> DataFrame:
    """Valid changes applied; a missing rating keeps the one given before."""
    valid = checked(changes, series).filter(F.col("problem").isNull())
    return merge.upsert(records, collapse(valid), ["user_id", "series_id"], rules={"rating": merge.new_if_given})


def save_with_previous(records: DataFrame, changes: DataFrame, series: DataFrame) -> DataFrame:
    """What each valid change leaves in the record, beside what was there before: user_id, series_id, seen_ep, rating, previous_seen_ep, previous_rating.

    Several changes of one record are one; a record that is new has no previous values.
    """
    new = collapse(checked(changes, series).filter(F.col("problem").isNull()))
    old = records.select("user_id", "series_id", F.col("seen_ep").alias("previous_seen_ep"), F.col("rating").alias("previous_rating"))
    kept = F.coalesce("rating", "previous_rating").alias("rating")
    return new.join(old, ["user_id", "series_id"], "left").select("user_id", "series_id", "seen_ep", kept, "previous_seen_ep", "previous_rating")


def save_one(records: DataFrame, series: DataFrame, user_id: str, series_id: str, seen_ep, rating=None, *, at) -> DataFrame:
    """One record with the refusals raised; ``at`` is the time of the change."""
    if isinstance(seen_ep, bool) or not isinstance(seen_ep, int):
        raise ValueError(f"the position must be a whole number: {seen_ep!r}")
    spark = records.sparkSession
    change = spark.createDataFrame(
        [(user_id, series_id, seen_ep, None if rating is None else float(rating), at, 0)],
        "user_id string, series_id string, seen_ep int, rating float, updated_at timestamp, change_id long",
    )
    why = checked(change, series).first()["problem"]
    if why == "unknown series":
        raise UnknownSeries(series_id)
    if why:
        raise ValueError(f"refused: {why}")
    return save(records, change, series)


def delete(records: DataFrame, user_id: str, series_id: str) -> tuple[DataFrame, bool]:
    """(records without that one, whether it existed)."""
    it = (F.col("user_id") == user_id) & (F.col("series_id") == series_id)
    return records.filter(~it), not records.filter(it).isEmpty()


def listed(records: DataFrame, series: DataFrame, user_id: str | None = None) -> DataFrame:
    """Records with display name and total, newest first; records of vanished series stay."""
    rows = records if user_id is None else records.filter(F.col("user_id") == user_id)
    info = series.select("series_id", F.coalesce("title_ko", "title").alias("name"), "total_episodes", "poster_url")
    return rows.join(info, "series_id", "left").orderBy(F.col("updated_at").desc(), "series_id")


def get(records: DataFrame, series: DataFrame, user_id: str, series_id: str) -> dict | None:
    row = listed(records.filter(F.col("series_id") == series_id), series, user_id).first()
    return None if row is None else row.asDict()


def watched_map(records: DataFrame, user_id: str) -> DataFrame:
    """The viewer's positions, ready for the ``watched`` argument of every search."""
    return records.filter(F.col("user_id") == user_id).select("series_id", "seen_ep")
