"""Catalogue: Gaussian-process trends of the coordinates per region."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import composition as comp
from tallyforge.functions import timeaxis
from tallyforge.operators import gp
from tallyforge.plans import tables as t
from tallyforge.plans.registry import Catalogue
from tallyforge.plans.surveys import CAMPAIGNS, CHANGEPOINTS

CATALOGUE = Catalogue()
query = CATALOGUE.query

SERIES = ["region_code", "coord"]
BIN_DAYS = 7


def _with_axis(df: DataFrame) -> DataFrame:
    day = F.date_from_unix_date("bin_day")
    return df.withColumn("regime", timeaxis.regime_index(day, CHANGEPOINTS)).withColumn("campaign", timeaxis.window_days(day, CAMPAIGNS))


def _observations(spark: SparkSession, folder: str) -> DataFrame:
    """Coordinates of each region per bin, with their sampling variance as noise."""
    sized = t.compositions(spark, folder).join(t.polls(spark, folder).where("sample_size > 0").select("poll_id", "region_code", "poll_date", "sample_size"), "poll_id")
    coords, variances = comp.ilr(t.columns(t.PARTS)), comp.ilr_sampling_variance(t.columns(t.PARTS), F.col("sample_size"))
    long = F.explode(F.array(*[F.struct(F.lit(c).alias("coord"), z.alias("z"), v.alias("v")) for c, z, v in zip(t.COORDS, coords, variances)]))
    obs = sized.select("region_code", "poll_date", long.alias("e")).select("region_code", "poll_date", "e.*").where("region_code IS NOT NULL")
    return _with_axis(gp.binned(obs, SERIES, "poll_date", "z", "v", BIN_DAYS))


@query()
def gp_grid(spark: SparkSession, folder: str) -> DataFrame:
    lml = gp.two_stage_grid(_observations(spark, folder), SERIES)
    return gp.ensemble(lml, SERIES).withColumns({"lml": F.round("lml", 4), "weight": F.round("weight", 6)})


@query()
def gp_trend(spark: SparkSession, folder: str) -> DataFrame:
    obs = _observations(spark, folder)
    members = gp.ensemble(gp.two_stage_grid(obs, SERIES), SERIES)
    targets = _with_axis(obs.select("bin_day").distinct())
    return gp.trend(obs, members, targets, SERIES).withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 6)})


def _scored(tasks: DataFrame, models: DataFrame) -> DataFrame:
    table = gp.scores(gp.held_out(tasks, SERIES, models), [*SERIES, "kernel"])
    return table.withColumns({c: F.round(c, 6) for c in ("mae", "lpd", "coverage90", "crps")})


@query()
def gp_sequential(spark: SparkSession, folder: str) -> DataFrame:
    """Each bin foretold from the past alone, under three kernels whose cells are searched anew whenever the past has doubled."""
    tasks = gp.sequential_tasks(_observations(spark, folder), SERIES)
    return _scored(tasks, gp.chosen(tasks, SERIES, gp.doubling()))


@query()
def gp_folds(spark: SparkSession, folder: str) -> DataFrame:
    """Bins foretold from the other folds, under three kernels whose cells are searched on those."""
    tasks = gp.fold_tasks(_observations(spark, folder), SERIES)
    return _scored(tasks, gp.chosen(tasks, SERIES))
