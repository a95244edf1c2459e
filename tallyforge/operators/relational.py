"""Relational building blocks with stated tie rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a stated order (dropDuplicates would keep any)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def latest_as_of(df: DataFrame, keys: Sequence[str], day: Column, cutoff: Column, order: Sequence[Column]) -> DataFrame:
    """Last row on or before the cutoff per key; of rows on the same day the first in `order`."""
    return keep_first(df.where(day <= cutoff), keys, [day.desc(), *order])


def next_after(df: DataFrame, keys: Sequence[str], day: Column, cutoff: Column) -> DataFrame:
    """All rows on the first day after the cutoff per key, ties included."""
    later = df.where(day > cutoff)
    rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy(day))
    return later.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def share_of_group(value: Column, *keys: str) -> Column:
    """A value's share of its group; null for an empty or zero group."""
    return value / F.nullif(F.sum(value).over(Window.partitionBy(*keys)), F.lit(0.0))


def two_way_difference(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys only in new (`added`) and only in old (`removed`)."""
    a, b = old.select(*keys).distinct(), new.select(*keys).distinct()
    return b.join(a, list(keys), "left_anti").withColumn("change", F.lit("added")).unionByName(a.join(b, list(keys), "left_anti").withColumn("change", F.lit("removed")))


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], update: Sequence[str] | None = None) -> DataFrame:
    """Merge by key: new keys are added; of known ones only the columns in `update` (None: all, (): none) are replaced.

    A null in the source keeps the target's value. Both sides have one row per key and the same columns.
    """
    columns = [c for c in target.columns if c not in keys]
    update = columns if update is None else update
    joined = target.withColumn("_old", F.lit(True)).alias("t").join(source.select(*target.columns).alias("s"), list(keys), "full_outer")
    old = F.col("t._old")
    merged = [
        (F.coalesce(F.col(f"s.{c}"), F.col(f"t.{c}")) if c in update else F.when(old, F.col(f"t.{c}")).otherwise(F.col(f"s.{c}"))).alias(c)
        for c in columns
    ]
    return joined.select(*keys, *merged)


def replace_slice(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The target with every slice that the source has rows of replaced by these rows. A null key is a slice of its own. Doing it twice changes nothing."""
    slices = source.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return target.join(slices, same, "left_anti").unionByName(source.select(*target.columns))


def repeated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows beyond the first of their key, as one row (n_broken); nulls count as a value."""
    return df.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_broken"))


def dangling(child: DataFrame, parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the child whose key the parent lacks, as one row (n_broken); a null key is dangling. The child's rows are counted per key before they meet the parent."""
    counts = child.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(parent.select(*keys).distinct(), list(keys), "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_broken"))


def delete_in(target: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of the target whose key columns are not among the keys."""
    return target.join(keys, keys.columns, "left_anti")


def islands(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """Add `island`, the number of the run of equal values in order, and `streak`, the place in the run (from 1)."""
    run = Window.partitionBy(*keys).orderBy(*order)
    changed = F.when(F.col(value).eqNullSafe(F.lag(value).over(run)) & (F.row_number().over(run) > 1), 0).otherwise(1)
    numbered = df.withColumn("_changed", changed).withColumn("island", F.sum("_changed").over(run)).drop("_changed")
    return numbered.withColumn("streak", F.row_number().over(Window.partitionBy(*keys, "island").orderBy(*order)))


def shared_pairs(edges: DataFrame, vertex: str, code: str, at_least: int) -> DataFrame:
    """Pairs of codes that share vertices: (a, b, n_shared), a < b. Meant for vertices with few codes each."""
    e = edges.select(F.col(vertex).alias("v"), F.col(code).alias("c")).where("v IS NOT NULL AND c IS NOT NULL").distinct()
    x, y = e.select("v", F.col("c").alias("a")), e.select("v", F.col("c").alias("b"))
    return x.join(y, "v").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_shared")).where(F.col("n_shared") >= at_least)


def prorata(known: DataFrame, loose: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Known values plus their share of a loose amount per group; loose amounts of unknown groups are lost."""
    extra = loose.groupBy(*keys).agg(F.sum(value).alias("_loose"))
    share = share_of_group(F.col(value).cast("double"), *keys)
    return known.withColumn("_share", share).join(extra, list(keys), "left").withColumn(value, F.col(value) + F.coalesce(F.col("_loose") * F.col("_share"), F.lit(0.0))).drop("_share", "_loose")
