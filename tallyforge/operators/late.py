"""Late and out-of-order events: per-period aggregates corrected by retraction until a cut-off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Days after the period's start from which an event is late, and from which it is refused.
LATE_DAYS = 14
CUTOFF_DAYS = 49

# A delivery as one number, so that the first and the last of many are found by a hash aggregate of fixed width: microseconds of
# the arrival, day of the event, sample size (null below all others), each moved up to be above 0.
_WIDE = "DECIMAL(38,0)"
_MICROS, _DAYS, _SAMPLE = 10**17, 10**6, 2**31 + 1
_TIME, _DAY = 10**18, 10**11


def _packed() -> Column:
    micros = "(datediff(to_date(scraped_at), DATE'1970-01-01') * 86400L + hour(scraped_at) * 3600 + minute(scraped_at) * 60) * 1000000L + CAST(extract(SECOND FROM scraped_at) * 1000000 AS BIGINT)"
    return F.expr(
        f"CAST({micros} + {_MICROS}L AS {_WIDE}) * {_TIME}BD + CAST((datediff(poll_date, DATE'1970-01-01') + {_DAYS}L) * {_DAY}L + coalesce(sample_size + {_SAMPLE}L, 0L) AS {_WIDE})"
    )


def _unpacked(df: DataFrame, e: str) -> DataFrame:
    """The packed delivery of a column as columns: e_start, the start of the period, e_age, days to the arrival, and e_sample. Null gives nulls."""
    parts = df.withColumns({f"{e}_hi": F.expr(f"{e} div {_TIME}BD - {_MICROS}L"), f"{e}_lo": F.expr(f"CAST({e} % {_TIME}BD AS BIGINT)")})
    start = F.trunc(F.expr(f"date_add(DATE'1970-01-01', CAST({e}_lo div {_DAY}L - {_DAYS}L AS INT))"), "week")
    arrived = F.expr(f"date_add(DATE'1970-01-01', CAST(floor({e}_hi / 86400000000D) AS INT))")
    return parts.withColumn(f"{e}_start", start).withColumns({f"{e}_age": F.datediff(arrived, F.col(f"{e}_start")), f"{e}_sample": F.expr(f"CAST(nullif({e}_lo % {_DAY}L, 0L) - {_SAMPLE}L AS INT)")})


def deliveries(polls: DataFrame, *keys: str) -> DataFrame:
    """The first delivery and the last one before the cut-off, packed, of each group of rows: (keys, first, last)."""
    events = polls.where("poll_id IS NOT NULL AND poll_date IS NOT NULL AND scraped_at IS NOT NULL").withColumn("e", _packed())
    in_time = F.datediff(F.to_date("scraped_at"), F.trunc("poll_date", "week")) < CUTOFF_DAYS
    return events.groupBy(*keys).agg(F.min("e").alias("first"), F.max(F.when(in_time, F.col("e"))).alias("last"))


def signed_parts(states: DataFrame, *keys: str) -> DataFrame:
    """From the state of polls before (old_first, old_last; null if there was none) and after (first, last) the signed changes of their parts."""
    moved = states.where(~(F.col("first").eqNullSafe(F.col("old_first")) & F.col("last").eqNullSafe(F.col("old_last"))))
    both = F.array(F.struct(F.lit(-1).alias("sign"), F.col("old_first").alias("first"), F.col("old_last").alias("last")), F.struct(F.lit(1).alias("sign"), "first", "last"))
    signed = moved.select(*keys, F.explode(both).alias("d")).select(*keys, "d.*").where("first IS NOT NULL")
    told = _unpacked(_unpacked(signed, "first"), "last")
    outcome = F.when(F.col("first_age") >= CUTOFF_DAYS, "refused").when(F.col("first_age") >= LATE_DAYS, "corrects").otherwise("on_time")
    taken = F.col("first_age") < CUTOFF_DAYS
    return told.select(
        *keys, "sign", F.col("first_start").alias("period"), outcome.alias("outcome"), F.when(taken, F.col("last_start")).otherwise(F.col("first_start")).alias("period_start"),
        F.when(taken, 1).otherwise(0).alias("n_polls"), F.when(taken, F.col("last_sample")).alias("sample_size"),
    )


def poll_log(polls: DataFrame) -> DataFrame:
    """Signed changes of each poll's part in the figures: (poll_id, load_id, sign, period, outcome, period_start, n_polls, sample_size).

    Loads are taken in the order of load_id; the state of a poll is its earliest arrival so far, which decides its
    fate (`on_time`, `corrects` or `refused`) and period, and its last delivery so far that came before the cut-off, which gives its part. A load
    that changes the state takes the old part back (sign -1) and adds the new one (sign 1). A refused poll's part is 0 polls.
    Rows with a null poll_id, poll_date or scraped_at carry no event and are left out; those with a null load_id came before all
    loads. Of deliveries at the same instant the earlier poll_date, then the smaller sample (null least), is the earlier one. Repeated rows change nothing.

    Deliveries are reduced per poll and load before they meet, so that a poll holds at most a row for each load, however often it is delivered.
    """
    loads = deliveries(polls.withColumn("load_id", F.coalesce("load_id", F.lit(-1))), "poll_id", "load_id")
    order = Window.partitionBy("poll_id").orderBy("load_id")
    now, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    steps = loads.select(
        "poll_id", "load_id", F.min("first").over(before).alias("old_first"), F.max("last").over(before).alias("old_last"), F.min("first").over(now).alias("first"), F.max("last").over(now).alias("last")
    )
    return signed_parts(steps, "poll_id", "load_id")


def late_polls(log: DataFrame) -> DataFrame:
    """The late polls with their fate, (poll_id, period, outcome): what is left of the polls' signed changes when they are added up."""
    left = log.groupBy("poll_id", "period", "outcome").agg(F.sum("sign").alias("n")).where("n > 0 AND outcome <> 'on_time'")
    return left.select("poll_id", F.date_format("period", "yyyy-MM-dd").alias("period"), "outcome")


def net_changes(log: DataFrame, *keys: str) -> DataFrame:
    """What signed parts change in all, (keys, n, s), where they change anything."""
    size = F.coalesce(F.sum(F.col("sign") * F.col("sample_size").cast("long")), F.lit(0))
    return log.groupBy(*keys).agg(F.sum(F.col("sign") * F.col("n_polls")).alias("n"), size.alias("s")).where("n <> 0 OR s <> 0")


def versions(log: DataFrame) -> DataFrame:
    """State of each period after each load that changed it: (period_start, version, load_id, n_polls, sample_sum and both before it).

    Changes are summed per period and load before they meet, so that a period holds at most a row for each load.
    """
    net = net_changes(log, "period_start", "load_id")
    order = Window.partitionBy("period_start").orderBy("load_id")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    return net.select(
        "period_start", (F.row_number().over(order) - 1).alias("version"), "load_id", F.sum("n").over(so_far).alias("n_polls"), F.sum("s").over(so_far).alias("sample_sum"),
        (F.sum("n").over(so_far) - F.col("n")).alias("old_n"), (F.sum("s").over(so_far) - F.col("s")).alias("old_s"),
    )


def deltas(log: DataFrame) -> DataFrame:
    """The change log of the periods: for each version its new aggregate (sign 1) and, but for the first, the old one taken back (sign -1)."""
    both = F.array(
        F.struct(F.lit(-1).alias("sign"), F.col("old_n").alias("n_polls"), F.col("old_s").alias("sample_sum")),
        F.struct(F.lit(1).alias("sign"), F.col("n_polls"), F.col("sample_sum")),
    )
    return (
        versions(log).select("period_start", "version", "load_id", F.explode(both).alias("d"))
        .select("period_start", "version", "load_id", "d.sign", "d.n_polls", "d.sample_sum").where("sign = 1 OR version > 0")
    )


def apply_deltas(changes: DataFrame, *keys: str) -> DataFrame:
    """Downstream aggregate of the change log: adding signed rows gives the corrected figures at any level."""
    return changes.groupBy(*keys).agg(F.sum(F.col("sign") * F.col("n_polls")).alias("n_polls"), F.sum(F.col("sign") * F.col("sample_sum")).alias("sample_sum"), F.max("version").alias("version"))
