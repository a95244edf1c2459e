"""Added, removed and changed records between consecutive full snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.operators.neighbours import neighbours
from tallyforge.session import broadcast_if_small

KEY = ["title", "poll_id", "party_code"]
#: Rounding noise: values that differ by no more are the same.
TOLERANCE = 0.01
BROADCAST_REVISIONS = 100_000


def revision_order(pages: DataFrame) -> DataFrame:
    """Distinct revisions with their neighbours: (title, revid, prev_revid, next_revid). Rows delivered twice count once."""
    return neighbours(pages.select("title", "revid").distinct(), "title", "revid", "prev_revid", "next_revid")


def _rows(shares: DataFrame, revisions: DataFrame, tolerance: float) -> DataFrame:
    """Distinct snapshot rows with their place in the island; a new island starts after a gap or a real change of the value."""
    values = (
        shares.where("poll_id IS NOT NULL AND party_code IS NOT NULL").select(*KEY, "revid", "pct_reported")
        .join(broadcast_if_small(revisions, BROADCAST_REVISIONS), ["title", "revid"])
        .repartition(*[F.col(k) for k in KEY])
        .groupBy(*KEY, "revid", "prev_revid", "next_revid").agg(F.min("pct_reported").alias("pct"))
        .withColumn("row_hash", F.xxhash64("pct"))
    )
    run = Window.partitionBy(*KEY).orderBy("revid")
    before = F.lag(F.struct("revid", "pct", "row_hash")).over(run)
    near = F.coalesce(F.abs(F.col("pct") - F.col("before.pct")) <= F.lit(tolerance), F.lit(False))
    same = (F.col("row_hash") == F.col("before.row_hash")) | near
    adjacent = F.coalesce(F.col("before.revid") == F.col("prev_revid"), F.lit(False))
    return values.withColumn("before", before).withColumn("starts", ~(adjacent & F.coalesce(same, F.lit(False))))


def validity_intervals(shares: DataFrame, pages: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Maximal runs of neighbouring revisions with one value: (key, valid_from, last_revid, valid_to, pct, before_first).

    valid_to is the first revision without the value, null while the run lasts to the title's last revision;
    before_first is the revision before valid_from, null at the title's first.
    """
    rows = _rows(shares, revision_order(pages), tolerance)
    numbered = rows.withColumn("island", F.sum(F.col("starts").cast("int")).over(Window.partitionBy(*KEY).orderBy("revid").rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*KEY, "island").agg(
        F.min("revid").alias("valid_from"), F.max("revid").alias("last_revid"), F.max_by("next_revid", "revid").alias("valid_to"), F.min_by("pct", "revid").alias("pct"), F.min_by("prev_revid", "revid").alias("before_first")
    ).drop("island")


def change_events(shares: DataFrame, pages: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Change events between neighbouring revisions: (title, revid, poll_id, party_code, change_kind).

    An interval that starts where another one of its key ends is a change, any other start an addition
    unless it is the title's first revision; an end where no interval starts is a removal, even at a
    revision with an empty table. Repeated rows count once; of different values for one key and
    revision the smallest counts; rows of unknown revisions, and rows without a key, are left out. A null
    value differs from any number and equals null.
    """
    run = Window.partitionBy(*KEY).orderBy("valid_from")
    spans = validity_intervals(shares, pages, tolerance).select(*KEY, "valid_from", "valid_to", "before_first", F.lag("valid_to").over(run).alias("ended"), F.lead("valid_from").over(run).alias("follows"))
    start = F.when(F.col("valid_from") == F.col("ended"), "changed").when(F.col("before_first").isNotNull(), "added")
    end = F.when(F.col("valid_to").isNotNull() & ~F.col("valid_to").eqNullSafe(F.col("follows")), "removed")
    events = F.array(F.struct(F.col("valid_from").alias("revid"), start.alias("change_kind")), F.struct(F.col("valid_to").alias("revid"), end.alias("change_kind")))
    return spans.select(*KEY, F.explode(events).alias("e")).where("e.change_kind IS NOT NULL").select("title", "e.revid", "poll_id", "party_code", "e.change_kind")
