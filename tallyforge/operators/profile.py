"""Column profiles per load from mergeable states, with constraint checks and drift between loads."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window

from tallyforge.session import broadcast_if_small, checkpoint
from tallyforge.streaming.state import latest_version, path_of, write_version

LOAD = ["table_name", "column_name", "feed", "load_id"]
#: A null rate may move by this much from the load before; a median by this share of the one before; a distribution by this distance.
NULL_RATE_STEP, MEDIAN_STEP, DISTRIBUTION_STEP = 0.2, 0.4, 0.5
#: Control limits: so many standard deviations around the mean of the feed's earlier loads, of which there must be so many.
CONTROL_SIGMAS, CONTROL_LOADS = 3.0, 8
#: Bins of the allowed range of a number, and the most rows of middle bins (two for each load) that are broadcast; more are joined by shuffle.
BINS, MIDDLE_BINS = 256, 200_000
#: Binary logarithm of the registers of a sketch of distinct values.
SKETCH_BITS = 12


@dataclass(frozen=True)
class Check:
    """A declared column: numbers have bounds (allowed themselves), texts a pattern that the whole value must match. A plain one is only counted."""

    table_name: str
    column_name: str
    low: float | None = None
    high: float | None = None
    pattern: str | None = None
    plain: bool = False  # nothing is asked of it
    text: bool = False

    @property
    def numeric(self) -> bool:
        return self.pattern is None and not self.text


# The declared columns with their bounds and ratings.
POLL_CHECKS = (
    Check("polls", "sample_size", 100, 20000),
    Check("polls", "firm_rating", pattern=r"^(A\+|A|A-|B\+|B|B-|C\+|C|C-|D|NC)\z"),
)
SHARE_CHECKS = (Check("poll_shares", "pct_reported", 0, 100),)


def every_column(df: DataFrame, table_name: str, declared: Sequence[Check] = ()) -> list[Check]:
    """A check for every column of a table but the keys of its loads: the declared ones, and counts and ranges alone for the others."""
    named = {c.column_name: c for c in declared if c.table_name == table_name}
    return [named.get(name, Check(table_name, name, plain=True, text=not isinstance(kind, NumericType))) for name, kind in ((f.name, f.dataType) for f in df.schema) if name not in ("feed", "load_id")]


@dataclass(frozen=True)
class States:
    """Mergeable states of the loads of a table: counts and ranges per column, and the distribution of the columns that are watched for shifts."""

    metrics: DataFrame
    parts: DataFrame


_COUNTS = ("n_rows", "n_null", "n_out_of_range", "n_malformed")


def _placed(df: DataFrame) -> DataFrame:
    return df.where("feed IS NOT NULL AND load_id IS NOT NULL")


def _bin(check: Check) -> Column:
    return F.floor((F.col(check.column_name).cast("double") - check.low) / (check.high - check.low) * BINS).cast("int")


def metric_states(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """All checks of a table compiled into one aggregate over one scan: a row per load, laid out as one per column and load.

    Counts of rows, nulls, values out of range (NaN is one) and malformed values, least and greatest value. Columns not checked are not read.
    Loads with a null feed or load_id have no place in a sequence and are left out.
    """
    aggregates = [F.count(F.lit(1)).alias("n")]
    for k, c in enumerate(checks):
        value = F.col(c.column_name)
        number = value.cast("double") if c.numeric else F.lit(None).cast("double")
        out, bad = F.lit(0).cast("long"), F.lit(0).cast("long")
        if c.numeric and not c.plain:
            out = F.count_if(~number.between(c.low, c.high))
        if c.pattern is not None:
            bad = F.count_if(~F.rlike(value.cast("string"), F.lit(c.pattern)))
        aggregates += [F.count(value).alias(f"present{k}"), out.alias(f"out{k}"), bad.alias(f"bad{k}"), F.min(number).alias(f"min{k}"), F.max(number).alias(f"max{k}")]
    columns = F.array(*[
        F.struct(
            F.lit(c.table_name).alias("table_name"), F.lit(c.column_name).alias("column_name"), F.col("n").alias("n_rows"), (F.col("n") - F.col(f"present{k}")).alias("n_null"),
            F.col(f"out{k}").alias("n_out_of_range"), F.col(f"bad{k}").alias("n_malformed"), F.col(f"min{k}").alias("min_value"), F.col(f"max{k}").alias("max_value"),
        )
        for k, c in enumerate(checks)
    ])
    wide = _placed(df).groupBy("feed", "load_id").agg(*aggregates)
    return wide.select("feed", "load_id", F.explode(columns).alias("c")).select("c.table_name", "c.column_name", "feed", "load_id", *[f"c.{x}" for x in (*_COUNTS, "min_value", "max_value")])


def part_states(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """Distribution of each watched column per load: (load, bin, txt, n), rows per bin of the allowed range for numbers, per value for texts."""
    cells = [
        F.struct(
            F.lit(c.table_name).alias("table_name"), F.lit(c.column_name).alias("column_name"),
            F.when(F.col(c.column_name).cast("double").between(c.low, c.high), _bin(c)).alias("bin") if c.numeric else F.lit(None).cast("int").alias("bin"),
            F.lit(None).cast("string").alias("txt") if c.numeric else F.col(c.column_name).cast("string").alias("txt"),
        )
        for c in checks if not c.plain
    ]
    if not cells:
        return df.sparkSession.createDataFrame([], "table_name string, column_name string, feed string, load_id long, bin int, txt string, n long")
    rows = _placed(df).select("feed", "load_id", F.explode(F.array(*cells)).alias("c")).where("c.bin IS NOT NULL OR c.txt IS NOT NULL")
    return rows.groupBy("c.table_name", "c.column_name", "feed", "load_id", "c.bin", "c.txt").agg(F.count(F.lit(1)).alias("n"))


def load_states(df: DataFrame, checks: Sequence[Check]) -> States:
    """The states of all loads of a table."""
    return States(metric_states(df, checks), part_states(df, checks))


def merge_states(a: States, b: States) -> States:
    """The states of both parts together: counts add up, ranges widen. Parts may share loads."""
    metrics = a.metrics.unionByName(b.metrics).groupBy(*LOAD).agg(*[F.sum(c).alias(c) for c in _COUNTS], F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"))
    return States(metrics, a.parts.unionByName(b.parts).groupBy(*LOAD, "bin", "txt").agg(F.sum("n").alias("n")))


def update_states(df: DataFrame, checks: Sequence[Check], folder: str) -> States:
    """The states kept under a folder, with those of loads that are not there yet. Only the new loads are read; each call adds one version.

    Version n of the distributions is of the loads of version n of the metrics; a call that ended between the two is made up for by the next.
    """
    spark = df.sparkSession
    metrics, parts = f"{folder}/metrics", f"{folder}/parts"
    n = latest_version(spark, metrics)
    if latest_version(spark, parts) < n:
        left = spark.read.parquet(path_of(metrics, n)).select("load_id").distinct()
        write_version(part_states(df.join(left, "load_id", "left_semi"), checks), parts, n)
    fresh = df.join(_kept(spark, metrics, n).select("load_id").distinct(), "load_id", "left_anti") if n else df
    write_version(metric_states(fresh, checks), metrics, n + 1)
    write_version(part_states(fresh, checks), parts, n + 1)
    return States(_kept(spark, metrics, n + 1), _kept(spark, parts, n + 1))


def _kept(spark: SparkSession, folder: str, n: int) -> DataFrame:
    paths = [path_of(folder, i) for i in range(1, n + 1)]
    return spark.read.schema(spark.read.parquet(paths[0]).schema).parquet(*paths)


def medians(parts: DataFrame, df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """Exact median of the values in range per load (of two middle ones, their mean): (load, median).

    The counts per bin tell the bins with the middle ranks; then only the values of those bins, one in BINS of
    the allowed range, are read again, counted and put in order.
    """
    load = Window.partitionBy(*LOAD)
    ranked = parts.where("bin IS NOT NULL").select(
        *LOAD, "bin", (F.sum("n").over(load.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("below"), F.col("n").alias("bin_n"), F.sum("n").over(load).alias("total")
    )
    first, second = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    holds = lambda rank, below, n: (below < rank) & (rank <= below + n)
    middle = checkpoint(ranked.where(holds(first, F.col("below"), F.col("bin_n")) | holds(second, F.col("below"), F.col("bin_n"))))
    found = []
    for c in checks:
        if c.numeric and not c.plain:
            num = F.col(c.column_name).cast("double")
            values = _placed(df).where(num.between(c.low, c.high)).select("feed", "load_id", _bin(c).alias("bin"), num.alias("num"))
            bins = middle.where((F.col("table_name") == c.table_name) & (F.col("column_name") == c.column_name))
            found.append(values.join(broadcast_if_small(bins, MIDDLE_BINS), ["feed", "load_id", "bin"]).groupBy(*LOAD, "bin", "below", "total", "num").agg(F.count(F.lit(1)).alias("n")))
    if not found:
        return middle.select(*LOAD, F.lit(None).cast("double").alias("median"))
    inside = Window.partitionBy(*LOAD, "bin").orderBy("num").rowsBetween(Window.unboundedPreceding, 0)
    upto = functools.reduce(DataFrame.unionByName, found).withColumn("upto", F.col("below") + F.sum("n").over(inside))
    at = lambda rank: F.max(F.when(holds(rank, F.col("upto") - F.col("n"), F.col("n")), F.col("num")))
    return upto.groupBy(*LOAD).agg(((at(first) + at(second)) / 2).alias("median"))


def distances(parts: DataFrame, loads: DataFrame) -> DataFrame:
    """Half the sum of absolute differences between a text column's value shares and those of the load before: (load, distance).

    Every share is sent once to its own load and once, negated, to the next one; adding them needs no join of loads.
    """
    shares = parts.where("txt IS NOT NULL").join(loads.select(*LOAD, "next_load", "present"), LOAD)
    share = F.col("n") / F.col("present")
    ends = F.array(F.struct(F.col("load_id").alias("load_id"), share.alias("part"), F.lit(1).alias("own")), F.struct(F.col("next_load").alias("load_id"), (-share).alias("part"), F.lit(0).alias("own")))
    sent = shares.select("table_name", "column_name", "feed", "txt", F.explode(ends).alias("e")).select("table_name", "column_name", "feed", "txt", "e.*").where("load_id IS NOT NULL")
    return (
        sent.groupBy(*LOAD, "txt").agg(F.sum("part").alias("part"), F.max("own").alias("own"), F.min("own").alias("other"))
        .groupBy(*LOAD).agg((F.sum(F.abs("part")) / 2).alias("distance"), F.max("own").alias("own"), F.min("other").alias("other"))
        .where("own = 1 AND other = 0").select(*LOAD, "distance")
    )


def load_profile(states: States, df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """One row per column and load: counts, null rate, range, median and distance, and the figures of the load before.

    df is what the states were made of; of it only the values around the medians are read. The windows run over one row per load.
    """
    series = Window.partitionBy("table_name", "column_name", "feed").orderBy("load_id")
    loads = states.metrics.withColumns({"present": F.col("n_rows") - F.col("n_null"), "null_rate": F.col("n_null") / F.col("n_rows"), "next_load": F.lead("load_id").over(series)})
    loads = loads.join(medians(states.parts, df, checks), LOAD, "left").join(distances(states.parts, loads), LOAD, "left")
    return loads.withColumns({f"prev_{short}": F.lag(name).over(series) for short, name in (("rows", "n_rows"), ("null", "n_null"), ("median", "median"))})


def distinct_counts(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """Distinct values of each column in all loads together, from mergeable sketches per load: (table_name, column_name, n_distinct), within some 2 per cent."""
    sketches = df.groupBy("load_id").agg(*[F.hll_sketch_agg(F.col(c.column_name).cast("string"), F.lit(SKETCH_BITS)).alias(f"s{k}") for k, c in enumerate(checks)])
    columns = F.array(*[F.struct(F.lit(c.table_name).alias("table_name"), F.lit(c.column_name).alias("column_name"), F.col(f"s{k}").alias("s")) for k, c in enumerate(checks)])
    return sketches.select(F.explode(columns).alias("c")).groupBy("c.table_name", "c.column_name").agg(F.hll_sketch_estimate(F.hll_union_agg("c.s")).alias("n_distinct"))


def findings(profile: DataFrame) -> DataFrame:
    """Findings per column and load: (table_name, column_name, load_id, finding).

    null_rate (compared in whole numbers, so that exactly the limit is no finding), range, pattern and shift; the
    first load of a feed has no null_rate or shift, nor has a load without values a shift.
    """
    moved = F.abs(F.col("n_null") * F.col("prev_rows") - F.col("prev_null") * F.col("n_rows")) * F.lit(round(1 / NULL_RATE_STEP)) > F.col("n_rows") * F.col("prev_rows")
    off = F.abs(F.col("median") - F.col("prev_median")) > F.lit(MEDIAN_STEP) * F.col("prev_median")
    kinds = F.array(
        F.when(moved, "null_rate"), F.when(F.col("n_out_of_range") > 0, "range"), F.when(F.col("n_malformed") > 0, "pattern"),
        F.when(F.coalesce(off, F.lit(False)) | F.coalesce(F.col("distance") > DISTRIBUTION_STEP, F.lit(False)), "shift"),
    )
    return profile.select("table_name", "column_name", "load_id", F.explode(F.array_compact(kinds)).alias("finding"))


def with_control_limits(profile: DataFrame) -> DataFrame:
    """The profile with control limits on the null rate and the median from the feed's earlier loads, and whether they are broken.

    The window runs over one summary row per load, not over data rows.
    """
    history = Window.partitionBy("table_name", "column_name", "feed").orderBy("load_id").rowsBetween(Window.unboundedPreceding, -1)
    for metric in ("null_rate", "median"):
        mean, spread = F.avg(metric).over(history), F.stddev_samp(metric).over(history)
        broken = (F.count(metric).over(history) >= CONTROL_LOADS) & (F.abs(F.col(metric) - mean) > CONTROL_SIGMAS * spread + 1e-9)
        profile = profile.withColumn(f"{metric}_mean", mean).withColumn(f"{metric}_alarm", F.coalesce(broken, F.lit(False)))
    return profile
