"""Late polls as a stream: per-poll state, and signed changes of the weekly figures from every micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.late import deliveries, net_changes, signed_parts
from tallyforge.streaming.state import latest_version, path_of, read_versions, write_version

_POLLS = "poll_id string, first decimal(38,0), last decimal(38,0)"
_WEEKS = "period_start date, n_polls long, sample_sum long, version long"
_DELTAS = "period_start date, version long, sign int, n_polls long, sample_sum long"


def process(folder: str):
    """The foreachBatch function: adds a batch to the state under `folder` and writes the batch's change log.

    State is a log of versions: a batch writes the polls and weeks that it changes, and nothing else. A poll's state is the least
    `first` and the greatest `last` of its versions, a week's the one of its highest version, so that no version is ever rewritten.
    A batch reads the earlier versions of its own polls only. A poll whose state changes takes its old part back and adds
    the new one; each week that changes emits its old figures with sign -1 and its new ones with sign 1.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = deliveries(batch, "poll_id")
        known = read_versions(spark, f"{folder}/polls", batch_id, _POLLS).join(fresh.select("poll_id"), "poll_id", "left_semi")
        old = known.groupBy("poll_id").agg(F.min("first").alias("old_first"), F.max("last").alias("old_last"))
        both = fresh.join(old, "poll_id", "left")
        now = both.withColumns({"first": F.least("first", "old_first"), "last": F.greatest("last", "old_last")})
        moved = now.where(~(F.col("first").eqNullSafe(F.col("old_first")) & F.col("last").eqNullSafe(F.col("old_last"))))
        write_version(moved.select("poll_id", "first", "last"), f"{folder}/polls", batch_id + 1)
        change = net_changes(signed_parts(now, "poll_id"), "period_start")
        weeks = weekly_state(read_versions(spark, f"{folder}/weeks", batch_id, _WEEKS))
        after = change.join(weeks, "period_start", "left").select(
            "period_start", F.coalesce("n_polls", F.lit(0)).alias("old_n"), F.coalesce("sample_sum", F.lit(0)).alias("old_s"), (F.coalesce("version", F.lit(0)) + 1).alias("version"), "n", "s"
        )
        signed = F.array(
            F.struct(F.lit(-1).alias("sign"), F.col("old_n").alias("n_polls"), F.col("old_s").alias("sample_sum")),
            F.struct(F.lit(1).alias("sign"), (F.col("old_n") + F.col("n")).alias("n_polls"), (F.col("old_s") + F.col("s")).alias("sample_sum")),
        )
        log = after.select("period_start", "version", F.explode(signed).alias("d")).select("period_start", "version", "d.*").where("sign = 1 OR version > 1")
        write_version(log, f"{folder}/deltas", batch_id + 1)
        changed = spark.read.schema(_DELTAS).parquet(path_of(f"{folder}/deltas", batch_id + 1)).where("sign = 1")
        write_version(changed.select("period_start", "n_polls", "sample_sum", "version"), f"{folder}/weeks", batch_id + 1)

    return run


def weekly_state(weeks: DataFrame) -> DataFrame:
    """The latest version of each week: (period_start, n_polls, sample_sum, version)."""
    latest = weeks.groupBy("period_start").agg(*[F.max_by(c, "version").alias(c) for c in ("n_polls", "sample_sum")], F.max("version").alias("last_version"))
    return latest.withColumnRenamed("last_version", "version")


def run_available(stream: DataFrame, folder: str) -> int:
    """Process all that is there and return how many batches the state has seen."""
    query = stream.writeStream.foreachBatch(process(folder)).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return latest_version(stream.sparkSession, f"{folder}/weeks")


def weekly(stream: DataFrame, folder: str) -> DataFrame:
    """Weekly figures after all available batches."""
    spark = stream.sparkSession
    n = run_available(stream, folder)
    return weekly_state(read_versions(spark, f"{folder}/weeks", n, _WEEKS))


def change_log(stream: DataFrame, folder: str) -> DataFrame:
    """The signed changes of all batches."""
    spark = stream.sparkSession
    n = run_available(stream, folder)
    return read_versions(spark, f"{folder}/deltas", n, _DELTAS)
