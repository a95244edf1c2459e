"""Watching pages for new revisions: two gates, guards that stop a batch before it writes, and scoped replacement.

State is a log of versions (see state.py): a batch writes what it changes and reads the earlier versions of its own pages only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.text import is_blank
from tallyforge.streaming.state import latest_version, read_versions, write_version

_PAGES = "title string, revid long, fetched_at timestamp_ntz, html string, n_changes long"
_SEEN = "title string, revid long"
_ROWS = "title string, poll_id string, party_code string, revid long, pct double, gone boolean"
_PLAN = "title string, poll_id string, party_code string, revid long, pct double, change string"
#: A page that loses more polls than this at once, or a poll whose shares add up to less or more than this, stops the batch.
MAX_REMOVED, TOTALS = 5, (85.0, 110.0)


class GuardViolation(RuntimeError):
    """A batch that must not be written."""


def _latest(versions: DataFrame, *keys: str) -> DataFrame:
    """The row of the highest revision of each key."""
    rest = [c for c in versions.columns if c not in keys]
    return versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), "revid").alias("k")).select(*keys, "k.*")


def process(folder: str, max_blank: float = 0.5) -> Callable[[DataFrame, int], None]:
    """The foreachBatch function: the newest revision of each title in the batch replaces an older one in the state.

    First gate: only revisions above the known one. Second gate: a revision with the same text moves the state but counts
    as no change. Titles not in the batch keep their row. More than max_blank of the batch's newest
    revisions without text stop the batch before anything is written.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = batch.where("title IS NOT NULL AND revid IS NOT NULL").groupBy("title").agg(F.max(F.struct("revid", "fetched_at", "html")).alias("n"))
        total, blank = newest.agg(F.count(F.lit(1)), F.count_if(is_blank(F.col("n.html")))).first()
        if total and blank / total > max_blank:
            raise GuardViolation(f"{blank} of {total} pages are empty")
        known = read_versions(spark, f"{folder}/pages", batch_id, _PAGES).join(newest.select("title"), "title", "left_semi")
        before = _latest(known, "title").select("title", F.col("revid").alias("old_revid"), F.col("html").alias("old_html"), F.col("n_changes").alias("old_changes"))
        due = newest.join(before, "title", "left").where("old_revid IS NULL OR n.revid > old_revid")
        changed = F.col("old_revid").isNull() | ~F.col("n.html").eqNullSafe(F.col("old_html"))
        state = due.select("title", "n.revid", "n.fetched_at", "n.html", (F.coalesce("old_changes", F.lit(0)) + changed.cast("long")).alias("n_changes"))
        write_version(state, f"{folder}/pages", batch_id + 1)

    return run


def watch(stream: DataFrame, folder: str, max_blank: float = 0.5) -> DataFrame:
    """State of all pages after the batches available now."""
    spark = stream.sparkSession
    _run(stream, folder, process(folder, max_blank))
    return _latest(read_versions(spark, f"{folder}/pages", latest_version(spark, f"{folder}/pages"), _PAGES), "title")


def _run(stream: DataFrame, folder: str, batch: Callable[[DataFrame, int], None]) -> None:
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def process_tables(shares: DataFrame, folder: str, force: bool = False, dry_run: bool = False, max_removed: int = MAX_REMOVED, totals: tuple[float, float] = TOTALS) -> Callable[[DataFrame, int], None]:
    """The foreachBatch function over page revisions whose tables stand in shares (title, revid, poll_id, party_code, pct_reported).

    First gate: of each title only the newest revision of the batch, and only above the known one, is read. Second gate: the difference of
    keys in both directions and of values is all that is written. Only pages that are read again may lose rows; all others
    keep theirs. A revision is recorded even if it changes nothing. A known page that loses more than max_removed polls, or an added or
    changed poll whose shares add up to less or more than totals, stops the batch before anything is written, unless forced. A
    dry run writes the changes it would make under plan, and nothing else. Rows without a key are left out; of repeated rows the least value counts.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = batch.where("title IS NOT NULL AND revid IS NOT NULL").groupBy("title").agg(F.max("revid").alias("revid"))
        seen = read_versions(spark, f"{folder}/seen", batch_id, _SEEN).groupBy("title").agg(F.max("revid").alias("known"))
        due = newest.join(seen, "title", "left").where("known IS NULL OR revid > known")
        page = shares.where("poll_id IS NOT NULL AND party_code IS NOT NULL").join(due.select("title", "revid"), ["title", "revid"])
        page = page.groupBy("title", "poll_id", "party_code").agg(F.min("pct_reported").alias("new_pct"), F.lit(True).alias("new"))
        old = read_versions(spark, f"{folder}/rows", batch_id, _ROWS).join(due.select("title"), "title", "left_semi")
        old = _latest(old, "title", "poll_id", "party_code").where("NOT gone").select("title", "poll_id", "party_code", F.col("pct").alias("old_pct"), F.lit(True).alias("old"))
        change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~F.col("old_pct").eqNullSafe(F.col("new_pct")), "changed")
        both = page.join(old, ["title", "poll_id", "party_code"], "full_outer").withColumn("change", change)
        plan = both.join(due.select("title", "revid"), "title").select("title", "poll_id", "party_code", "revid", F.col("new_pct").alias("pct"), "change")
        write_version(plan.where("change IS NOT NULL"), f"{folder}/plan", batch_id + 1)  # no part of the state
        if dry_run:
            return
        planned = spark.read.schema(_PLAN).parquet(f"{folder}/plan/version={batch_id + 1}")
        if not force:
            lost = planned.where("change = 'removed'").groupBy("title").agg(F.countDistinct("poll_id").alias("n")).where(F.col("n") > max_removed)
            touched = planned.where("change <> 'removed'").select("title", "poll_id").distinct()
            sums = page.join(touched, ["title", "poll_id"], "left_semi").groupBy("title", "poll_id").agg(F.sum("new_pct").alias("n")).where(~F.col("n").between(*totals))
            for what, broken in (("loses polls", lost), ("has a poll with a wrong sum", sums)):
                if worst := broken.orderBy(F.col("n").desc(), "title").select("title", "n").first():
                    raise GuardViolation(f"{worst.title} {what}: {worst.n:g}")
        write_version(planned.select("title", "poll_id", "party_code", "revid", "pct", (F.col("change") == "removed").alias("gone")), f"{folder}/rows", batch_id + 1)
        write_version(due.select("title", "revid"), f"{folder}/seen", batch_id + 1)

    return run


def watch_tables(stream: DataFrame, shares: DataFrame, folder: str, **options) -> DataFrame:
    """The current table of every page after the batches available now: (title, poll_id, party_code, revid of the last change, pct)."""
    spark = stream.sparkSession
    _run(stream, folder, process_tables(shares, folder, **options))
    rows = read_versions(spark, f"{folder}/rows", latest_version(spark, f"{folder}/rows"), _ROWS)
    return _latest(rows, "title", "poll_id", "party_code").where("NOT gone").drop("gone")
