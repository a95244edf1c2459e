"""Shared inputs of the catalogue: one row per poll, its parts side by side, and results per riding, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import composition as comp
from tallyforge.functions.text import is_blank, name_key, riding_code
from tallyforge.session import read_table

# The parties in canonical order, the residual one last.
PARTIES = ["ALB", "LPN", "MVT", "PRN", "UCD", "AUTRES"]
PARTS = [p.lower() for p in PARTIES]
COORDS = [f"z{i}" for i in range(1, len(PARTIES))]
DELTA = (1 / len(PARTIES)) ** 2


def polls(spark: SparkSession, folder: str) -> DataFrame:
    """One row per poll_id: its first delivery."""
    fields = ["scraped_at", "load_id", "sample_size", "poll_date", "firm", "region_code"]
    first = read_table(spark, folder, "polls").groupBy("poll_id").agg(F.min(F.struct(*fields)).alias("e"))
    return first.select("poll_id", *[f"e.{f}" for f in fields])


def cells(spark: SparkSession, folder: str) -> DataFrame:
    """One share per poll and party, the last delivered (of several in one load the largest); values outside 0 to 100 are no measurement.

    Two aggregates over fixed-width values: first per load, with a combine before the shuffle, then the latest load.
    """
    valid = read_table(spark, folder, "poll_shares").where("pct_reported BETWEEN 0 AND 100")
    loads = valid.groupBy("poll_id", "party_code", F.coalesce("load_id", F.lit(-1)).alias("load_id")).agg(F.max("pct_reported").alias("pct"))
    return loads.groupBy("poll_id", "party_code").agg((F.max_by("pct", "load_id") / 100).alias("x"))


def wide(spark: SparkSession, folder: str) -> DataFrame:
    """Parts of each poll side by side, null where unmeasured: one aggregation of the cells, no pivot pass for the values."""
    part = lambda p: F.max(F.when(F.col("party_code") == p, F.col("x")))
    return cells(spark, folder).groupBy("poll_id").agg(*[part(p).alias(p.lower()) for p in PARTIES]).where(F.coalesce(*PARTS).isNotNull())


def columns(names: list[str]) -> list[Column]:
    return [F.col(n) for n in names]


def named(values: list[Column], names: list[str], digits: int | None = None) -> list[Column]:
    """Values under their names, rounded where digits are given; a rounded zero has no sign."""
    return [(v if digits is None else F.round(v, digits) + F.lit(0.0)).alias(n) for v, n in zip(values, names)]


def compositions(spark: SparkSession, folder: str) -> DataFrame:
    """Closed parts without zeros of each poll that reports anything above zero."""
    w = wide(spark, folder).where(comp.total([F.coalesce(F.col(p), F.lit(0.0)) for p in PARTS]) > 0)
    return w.select("poll_id", *named(comp.zero_replaced(columns(PARTS)), PARTS))


def coordinates(spark: SparkSession, folder: str) -> DataFrame:
    """Isometric log-ratio coordinates of each poll."""
    return compositions(spark, folder).select("poll_id", *named(comp.ilr(columns(PARTS)), COORDS))


def results(spark: SparkSession, folder: str) -> DataFrame:
    """Votes with the riding's key; unknown parties count as the residual one, rows without a riding or votes are left out."""
    party = F.when(F.col("party_code").isin(PARTIES), F.col("party_code")).otherwise("AUTRES")
    return read_table(spark, folder, "qc_byelections").where(~is_blank(F.col("riding_code")) & F.col("votes").isNotNull()).select(
        "boundary_year", "election_date", name_key(riding_code(F.col("riding_code"))).alias("riding"), party.alias("party"), F.col("votes").cast("double").alias("votes")
    ).where("riding <> ''")


def ridings(spark: SparkSession, folder: str, *keys: str) -> DataFrame:
    """Closed parts without zeros of the votes per key; keys without votes are dropped."""
    keys = keys or ("boundary_year", "riding")
    sums = results(spark, folder).groupBy(*keys).agg(*[F.sum(F.when(F.col("party") == p, F.col("votes"))).alias(p.lower()) for p in PARTIES], F.sum("votes").alias("n_votes"))
    return sums.where("n_votes > 0").select(*keys, "n_votes", *named(comp.zero_replaced(columns(PARTS)), PARTS))


# SQL twins.
_PARTS_SQL = ", ".join(f"max(x) FILTER (party_code = '{p}') AS {p.lower()}" for p in PARTIES)
_SUM = " + ".join(f"coalesce({p}, 0)" for p in PARTS)
_ZEROS = " + ".join(f"(CASE WHEN coalesce({p}, 0) = 0 THEN 1 ELSE 0 END)" for p in PARTS)


def replaced_sql(extra: str, source: str) -> str:
    part = lambda p: f"CASE WHEN coalesce({p}, 0) = 0 THEN 1e0 / 36 ELSE {p} / ({_SUM}) * (1 - ({_ZEROS}) / 36e0) END AS {p}"
    return f"SELECT {extra}, {', '.join(part(p) for p in PARTS)} FROM {source} WHERE {_SUM} > 0"


def ilr_sql(prefix: str = "", names: list[str] = PARTS) -> list[str]:
    out = []
    for i in range(1, len(names)):
        logs = " + ".join(f"ln({prefix}{p})" for p in names[:i])
        out.append(f"sqrt({i}e0 / {i + 1}) * (({logs}) / {i} - ln({prefix}{names[i]}))")
    return out


POLL_SQL = """poll AS (SELECT * FROM polls QUALIFY row_number() OVER (PARTITION BY poll_id ORDER BY scraped_at NULLS FIRST, load_id NULLS FIRST, sample_size NULLS FIRST,
  poll_date NULLS FIRST, firm NULLS FIRST, region_code NULLS FIRST) = 1)"""
CELL_SQL = """cell AS (SELECT poll_id, party_code, pct_reported / 100 AS x FROM poll_shares WHERE pct_reported BETWEEN 0 AND 100
  QUALIFY row_number() OVER (PARTITION BY poll_id, party_code ORDER BY load_id DESC, feed DESC, pct_reported DESC) = 1)"""
WIDE_SQL = f"{CELL_SQL}, wide AS (SELECT poll_id, {_PARTS_SQL} FROM cell GROUP BY poll_id HAVING bool_or(party_code IN ('ALB','LPN','MVT','PRN','UCD','AUTRES')))"
COMP_SQL = f"{WIDE_SQL}, comp AS ({replaced_sql('poll_id', 'wide')})"
COORD_SQL = f"{COMP_SQL}, coord AS (SELECT poll_id, {', '.join(f'{e} AS {n}' for e, n in zip(ilr_sql(), COORDS))} FROM comp)"
_KEY = "regexp_replace(strip_accents(lower(CASE WHEN regexp_full_match(trim(riding_code), '[0-9]+(\\.[0-9]*)?') THEN regexp_extract(trim(riding_code), '^[0-9]+') ELSE riding_code END)), '[^a-z0-9]', '', 'g')"
RESULT_SQL = f"""result AS (SELECT boundary_year, election_date, {_KEY} AS riding,
  CASE WHEN party_code IN ('ALB','LPN','MVT','PRN','UCD','AUTRES') THEN party_code ELSE 'AUTRES' END AS party, CAST(votes AS DOUBLE) AS votes
  FROM qc_byelections WHERE trim(riding_code) <> '' AND votes IS NOT NULL)"""


def riding_sql(name: str, keys: str) -> str:
    sums = ", ".join(f"sum(votes) FILTER (party = '{p}') AS {p.lower()}" for p in PARTIES)
    return f"{name}_sum AS (SELECT {keys}, sum(votes) AS n_votes, {sums} FROM result GROUP BY {keys} HAVING sum(votes) > 0), {name} AS ({replaced_sql(keys + ', n_votes', name + '_sum')})"
