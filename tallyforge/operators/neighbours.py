"""Predecessor and successor of each row in its group, without one task per group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def neighbours(df: DataFrame, key: str, order: str, prev: str, following: str, blocks: int = 256) -> DataFrame:
    """Add the previous and next value of the integral column `order` within `key`; rows are distinct in (key, order).

    The values are cut into blocks at about equal ranks, so that a key with a third of all rows is spread over as
    many windows, wherever its values lie; only each block's edges (at most `blocks` rows a key) meet in one window to
    bridge the cuts. Rows with a null key or order are dropped. An empty input gives an empty result.
    """
    df = df.where(F.col(key).isNotNull() & F.col(order).isNotNull())
    ranks = [k / blocks for k in range(1, blocks)]
    cuts = df.agg(F.percentile_approx(order, ranks, 20 * blocks).alias("cuts")).first().cuts if ranks else []  # fewer than `blocks` values
    marks = F.array(*[F.lit(c) for c in sorted(set(cuts or []))])
    cut = df.withColumn("_block", F.size(F.filter(marks, lambda c: c <= F.col(order))))
    edges = cut.groupBy(key, "_block").agg(F.min(order).alias("_first"), F.max(order).alias("_last"))
    across = Window.partitionBy(key).orderBy("_block")
    edges = edges.select(key, "_block", F.lag("_last").over(across).alias("_before"), F.lead("_first").over(across).alias("_after"))
    inside = Window.partitionBy(key, "_block").orderBy(order)
    rows = cut.withColumn("_lag", F.lag(order).over(inside)).withColumn("_lead", F.lead(order).over(inside))
    return (
        rows.join(edges, [key, "_block"])
        .withColumn(prev, F.coalesce("_lag", "_before"))
        .withColumn(following, F.coalesce("_lead", "_after"))
        .select(*df.columns, prev, following)
    )
