"""Keyed changes to tables stored as plain files: each function returns the new table as one plan.

Keys are unique in target and source, so every join here is an equi-join without fan-out.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

Rule = Callable[[Column, Column], Column]


def _sides(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    old = target.select(*keys, F.struct(*[c for c in target.columns if c not in keys]).alias("old"))
    new = source.select(*keys, F.struct(*[c for c in source.columns if c not in keys]).alias("new"))
    return old.join(new, list(keys), "full")


def upsert(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str] | None = None,
    rules: Mapping[str, Rule] | None = None,
) -> DataFrame:
    """Insert new keys and update known ones.

    Only ``columns`` (default: all the source has) change for a known key, so several sources can each own some columns.
    ``rules`` replace plain overwriting per column: ``rule(old, new)``.
    """
    rules = dict(rules or {})
    given = [c for c in source.columns if c not in keys]
    owned = list(columns) if columns is not None else given
    known, arrived = F.col("old").isNotNull(), F.col("new").isNotNull()
    out = []
    for name in [c for c in target.columns if c not in keys]:
        old = F.col(f"old.{name}")
        if name not in given:
            out.append(old.alias(name))
            continue
        new = F.col(f"new.{name}")
        updated = rules[name](old, new) if name in rules else (new if name in owned else old)
        out.append(F.when(known & arrived, updated).when(arrived, new).otherwise(old).alias(name))
    return _sides(target, source, keys).select(*keys, *out)


def keep_first(old: Column, new: Column) -> Column:
    return old


def fill_if_null(old: Column, new: Column) -> Column:
    return F.coalesce(old, new)


def new_if_given(old: Column, new: Column) -> Column:
    return F.coalesce(new, old)


def sticky(value: str) -> Rule:
    """Once a column has this value it keeps it."""
    return lambda old, new: F.when(old == value, F.lit(value)).otherwise(new)


def upsert_chunks(target: DataFrame, source: DataFrame) -> DataFrame:
    """Chunk upsert that keeps a vector exactly as long as its text is unchanged: one full join on the id."""
    given = [c for c in target.columns if c in source.columns and c not in ("chunk_id", "embedding")]
    old = target.select("chunk_id", F.struct(*[c for c in target.columns if c != "chunk_id"]).alias("old"))
    new = source.select("chunk_id", F.struct(*given).alias("new"))
    arrived = F.col("new").isNotNull()
    same = F.col("new.text").eqNullSafe(F.col("old.text"))
    out = [F.when(arrived, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) if c in given else F.when(~arrived, F.col(f"old.{c}")).alias(c) for c in target.columns if c not in ("chunk_id", "embedding")]
    vector = F.when(~arrived | same, F.col("old.embedding")).alias("embedding")
    return old.join(new, "chunk_id", "full").select("chunk_id", *out, vector).select(*target.columns)


def insert_missing(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of unknown keys are added, the rest of the source is ignored; of rows that repeat a key the smallest is taken."""
    rest = [c for c in source.columns if c not in keys]
    one = source.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]) if rest else source.distinct()
    fresh = one.join(target.select(*keys), list(keys), "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def sync_delete(target: DataFrame, current: DataFrame, key: str, scope: str) -> DataFrame:
    """Drops rows whose key left the current list, within the scopes that list covers."""
    covered = current.select(scope).distinct().withColumn("_covered", F.lit(True))
    present = current.select(key).distinct().withColumn("_present", F.lit(True))
    marked = target.join(covered, scope, "left").join(present, key, "left")
    return marked.filter(F.col("_covered").isNull() | F.col("_present").isNotNull()).select(*target.columns)


def drop_orphans(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Parents that still have a child."""
    return parents.join(children.select(key), key, "left_semi")


def clear_and_rewrite(
    target: DataFrame, source: DataFrame, keys: Sequence[str], owned: Sequence[str], evidence: Sequence[str]
) -> DataFrame:
    """Empties the owned columns everywhere, writes them anew, and drops rows left without any evidence column."""
    cleared = target.withColumns({c: F.lit(None).cast(target.schema[c].dataType) for c in owned})
    merged = upsert(cleared, source, keys, owned)
    return merged.filter(F.coalesce(*[F.col(c).cast("string") for c in evidence]).isNotNull())


def replace_groups(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """All rows of a key that occurs in the source are replaced by the source's rows."""
    kept = target.join(source.select(key).distinct(), key, "left_anti")
    return kept.unionByName(source.select(*target.columns))


def latest_per_key(changes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last change per key; combined on the map side, so a key holding most changes is no hot spot."""
    rest = [c for c in changes.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("last")
    return changes.groupBy(*keys).agg(last).select(*keys, *[F.col(f"last.{c}").alias(c) for c in rest])


def copy_by_ids(source: DataFrame, ids: DataFrame, columns: Sequence[str], key: str = "series_id", skip: Sequence[str] = ()) -> DataFrame:
    """Rows of the listed ids with the columns of the destination, aligned by name; columns the source lacks are NULL.

    The ids are hashed, as the rows, which hold whole texts, would else be sorted.
    """
    wanted = [c for c in columns if c not in skip]
    return source.join(ids.select(key).hint("shuffle_hash"), key, "left_semi").select(
        *[F.col(c) if c in source.columns else F.lit(None).alias(c) for c in wanted]
    )
