"""Catalogue: polls as compositions, scores, house effects and their time axis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.functions import composition as comp
from tallyforge.functions import stats, timeaxis
from tallyforge.functions.text import collapse_spaces, locale_number, name_key, poll_id
from tallyforge.operators import parsing, relational
from tallyforge.plans import tables as t
from tallyforge.plans.problems import PARSE_SQL, SHARES_SQL, VALID_SQL
from tallyforge.plans.registry import Catalogue
from tallyforge.session import checkpoint, read_table

CATALOGUE = Catalogue()
query = CATALOGUE.query

# Boundaries of the time axis.
CHANGEPOINTS = ["2016-06-01", "2020-03-15"]
CAMPAIGNS = [("2014-03-05", "2014-04-07"), ("2018-08-23", "2018-10-01"), ("2022-08-28", "2022-10-03")]
CYCLES = [("2014-04-07", "2014"), ("2018-10-01", "2018"), ("2022-10-03", "2022")]
SHRINK = 5.0

_R = lambda e, n, d=6: f"round({e}, {d}) + 0e0 AS {n}"
_WEEK_RES = f"""{t.POLL_SQL}, {t.CELL_SQL},
obs AS (SELECT c.poll_id, c.party_code, c.x, p.firm, p.sample_size, CAST(date_trunc('week', p.poll_date) AS DATE) AS week FROM cell c JOIN poll p USING (poll_id) WHERE p.poll_date IS NOT NULL),
wk AS (SELECT week, party_code, avg(x) AS m, count(*) AS n FROM obs GROUP BY 1, 2),
res AS (SELECT o.*, o.x - wk.m AS r, wk.n AS week_n FROM obs o JOIN wk USING (week, party_code))"""


def _residuals(spark: SparkSession, folder: str) -> DataFrame:
    """Shares with their difference from the week's mean of the party; weeks are pre-aggregated, not windowed."""
    obs = t.cells(spark, folder).join(t.polls(spark, folder).where("poll_date IS NOT NULL"), "poll_id").withColumn("week", F.trunc("poll_date", "week"))
    weekly = obs.groupBy("week", "party_code").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("week_n"))
    return obs.join(weekly, ["week", "party_code"]).withColumn("r", F.col("x") - F.col("m"))


@query(f"WITH {t.WIDE_SQL} SELECT * FROM wide")
def poll_pivot_wide(spark: SparkSession, folder: str) -> DataFrame:
    return t.wide(spark, folder)


@query("SELECT poll_id, load_id, round(sum(pct_reported), 4) AS total FROM poll_shares GROUP BY 1, 2 HAVING sum(pct_reported) NOT BETWEEN 85 AND 110")
def share_sum_guard(spark: SparkSession, folder: str) -> DataFrame:
    sums = read_table(spark, folder, "poll_shares").groupBy("poll_id", "load_id").agg(F.sum("pct_reported").alias("total"))
    return sums.where("total NOT BETWEEN 85 AND 110").withColumn("total", F.round("total", 4))


@query(f"WITH {t.COMP_SQL} SELECT poll_id, {', '.join(_R(p, p, 9) for p in t.PARTS)} FROM comp")
def closure_zero_replaced(spark: SparkSession, folder: str) -> DataFrame:
    return t.compositions(spark, folder).select("poll_id", *t.named(t.columns(t.PARTS), t.PARTS, 9))


_MEANLN = "(" + " + ".join(f"ln({p})" for p in t.PARTS) + ") / 6"


@query(f"WITH {t.COMP_SQL} SELECT poll_id, {', '.join(_R(f'ln({p}) - {_MEANLN}', p) for p in t.PARTS)} FROM comp")
def clr_coords(spark: SparkSession, folder: str) -> DataFrame:
    return t.compositions(spark, folder).select("poll_id", *t.named(comp.clr(t.columns(t.PARTS)), t.PARTS, 6))


@query(f"WITH {t.COORD_SQL} SELECT poll_id, {', '.join(_R(c, c) for c in t.COORDS)} FROM coord")
def ilr_coords(spark: SparkSession, folder: str) -> DataFrame:
    return t.coordinates(spark, folder).select("poll_id", *t.named(t.columns(t.COORDS), t.COORDS, 6))


@query(f"WITH {t.COMP_SQL} SELECT poll_id, {', '.join(_R(p, p, 9) for p in t.PARTS)} FROM comp")
def ilr_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    return t.coordinates(spark, folder).select("poll_id", *t.named(comp.ilr_inverse(t.columns(t.COORDS)), t.PARTS, 9))


def _variance_sql() -> list[str]:
    rows = []
    for i in range(1, 6):
        terms = [f"{1 / (i * (i + 1))!r} / greatest({p}, 1e-6)" for p in t.PARTS[:i]] + [f"{i / (i + 1)!r} / greatest({t.PARTS[i]}, 1e-6)"]
        rows.append(f"({' + '.join(terms)}) / sample_size")
    return rows


@query(f"WITH {t.COMP_SQL}, {t.POLL_SQL} SELECT poll_id, {', '.join(_R(e, c, 9) for e, c in zip(_variance_sql(), t.COORDS))} FROM comp JOIN poll USING (poll_id) WHERE sample_size > 0")
def ilr_sampling_variance(spark: SparkSession, folder: str) -> DataFrame:
    sized = t.compositions(spark, folder).join(t.polls(spark, folder).where("sample_size > 0").select("poll_id", "sample_size"), "poll_id")
    return sized.select("poll_id", *t.named(comp.ilr_sampling_variance(t.columns(t.PARTS), F.col("sample_size")), t.COORDS, 9))


@query(f"""WITH {t.POLL_SQL}, med AS (SELECT region_code, sample_size AS m FROM poll WHERE sample_size > 0
  QUALIFY row_number() OVER (PARTITION BY region_code ORDER BY sample_size, poll_id) - 1 = count(*) OVER (PARTITION BY region_code) // 2)
  SELECT poll_id, round(sqrt(CASE WHEN sample_size > 0 THEN sample_size ELSE m END), 6) AS weight FROM poll JOIN med USING (region_code)""")
def sample_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Root of the sample size; missing ones take their region's upper median, found from counts per size."""
    p = t.polls(spark, folder)
    counts = p.where("sample_size > 0").groupBy("region_code", "sample_size").agg(F.count(F.lit(1)).alias("n"))
    region = Window.partitionBy("region_code")
    upto = F.sum("n").over(region.orderBy("sample_size").rowsBetween(Window.unboundedPreceding, 0))
    rank = F.floor(F.sum("n").over(region) / 2) + 1
    medians = counts.withColumn("upto", upto).withColumn("rank", rank).where("upto - n < rank AND rank <= upto").select("region_code", F.col("sample_size").alias("m"))
    return p.join(medians, "region_code").select("poll_id", F.round(F.sqrt(F.when(F.col("sample_size") > 0, F.col("sample_size")).otherwise(F.col("m"))), 6).alias("weight"))


def _quantile_sql(p: int) -> str:
    return f"CAST(list_sort(list(sample_size))[1 + CAST(floor({p / 100} * (count(*) - 1)) AS BIGINT)] AS BIGINT) AS p{p:02d}"


@query(f"WITH {t.POLL_SQL} SELECT region_code, {_quantile_sql(5)}, {_quantile_sql(50)}, {_quantile_sql(95)}, CAST(list_sort(list(sample_size))[1 + count(*) // 2] AS BIGINT) AS upper_median FROM poll WHERE sample_size IS NOT NULL GROUP BY region_code")
def floor_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    """Floor-rank quantiles and upper median of the sample sizes, from counts per value, so that a large region is no large group."""
    counts = t.polls(spark, folder).where("sample_size IS NOT NULL").groupBy("region_code", "sample_size").agg(F.count(F.lit(1)).alias("n"))
    region = Window.partitionBy("region_code")
    counts = counts.withColumn("upto", F.sum("n").over(region.orderBy("sample_size").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(region))
    at = lambda rank: F.max(F.when((F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto")), F.col("sample_size"))).cast("long")
    quantiles = [at(F.floor(F.lit(p / 100) * (F.col("total") - 1))).alias(f"p{p:02d}") for p in (5, 50, 95)]
    return counts.groupBy("region_code").agg(*quantiles, at(F.floor(F.col("total") / 2)).alias("upper_median"))


@query(f"""WITH {t.CELL_SQL}, h AS (SELECT party_code, CAST(floor(x * 100) AS BIGINT) AS bin, count(*) AS n FROM cell GROUP BY 1, 2)
  SELECT party_code, bin, n, round(n / sum(n) OVER (PARTITION BY party_code), 6) AS prob, round(n / max(n) OVER (PARTITION BY party_code), 6) AS height FROM h""")
def histogram_height(spark: SparkSession, folder: str) -> DataFrame:
    h = t.cells(spark, folder).groupBy("party_code", F.floor(F.col("x") * 100).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    party = Window.partitionBy("party_code")
    return h.select("party_code", "bin", "n", F.round(F.col("n") / F.sum("n").over(party), 6).alias("prob"), F.round(F.col("n") / F.max("n").over(party), 6).alias("height"))


@query(f"""WITH {t.WIDE_SQL}, long AS (SELECT poll_id, party_code, x, list_position(['ALB','LPN','MVT','PRN','UCD','AUTRES'], party_code) AS ord FROM cell),
  r AS (SELECT *, row_number() OVER (PARTITION BY poll_id ORDER BY x DESC, ord) AS rk FROM long WHERE ord IS NOT NULL AND ord > 0)
  SELECT a.poll_id, a.party_code AS leader, b.party_code AS runner_up, round(a.x - b.x, 6) AS margin FROM r a LEFT JOIN r b ON b.poll_id = a.poll_id AND b.rk = 2 WHERE a.rk = 1""")
def runner_up_margin(spark: SparkSession, folder: str) -> DataFrame:
    """First argmax and the next party: a poll's six parts are sorted within its row."""
    parts = [F.struct(F.coalesce(F.col(p.lower()), F.lit(-1.0)).alias("x"), F.lit(-i).alias("o"), F.lit(p).alias("party")) for i, p in enumerate(t.PARTIES)]
    ranked = t.wide(spark, folder).withColumn("s", F.sort_array(F.filter(F.array(*parts), lambda e: e["x"] >= 0), asc=False))
    return ranked.select("poll_id", F.get("s", F.lit(0))["party"].alias("leader"), F.get("s", F.lit(1))["party"].alias("runner_up"), F.round(F.get("s", F.lit(0))["x"] - F.get("s", F.lit(1))["x"], 6).alias("margin"))


@query(f"""WITH {t.WIDE_SQL}, long AS (SELECT poll_id, party_code, x, list_position(['ALB','LPN','MVT','PRN','UCD','AUTRES'], party_code) AS ord FROM cell),
  r AS (SELECT *, row_number() OVER (PARTITION BY poll_id ORDER BY x DESC, ord) AS rk FROM long WHERE ord > 0)
  SELECT a.poll_id, a.party_code AS leader, b.party_code AS runner_up, round(a.x - b.x, 6) AS margin FROM r a JOIN r b ON b.poll_id = a.poll_id AND b.rk = 2 WHERE a.rk = 1 ORDER BY round(a.x - b.x, 6), a.poll_id LIMIT 20""")
def watchlist_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 closest polls: the limit is the feature."""
    return runner_up_margin(spark, folder).where("margin IS NOT NULL").orderBy("margin", "poll_id").limit(20)


_AS_OF, _CUTOFF = "2022-10-03", "2014-04-07"


@query(f"""WITH {t.POLL_SQL} SELECT firm, poll_id, poll_date FROM poll WHERE poll_date <= DATE '{_AS_OF}'
  QUALIFY row_number() OVER (PARTITION BY firm ORDER BY poll_date DESC, scraped_at, load_id, poll_id) = 1""")
def latest_per_key(spark: SparkSession, folder: str) -> DataFrame:
    """As-of lookup as an aggregate: the largest day, then the first arrival, wins without sorting a firm's polls."""
    p = t.polls(spark, folder).where(F.col("poll_date") <= F.lit(_AS_OF).cast("date"))
    best = p.groupBy("firm").agg(F.min(F.struct((-F.unix_date("poll_date")).alias("back"), "scraped_at", "load_id", "poll_id", "poll_date")).alias("b"))
    return best.select("firm", "b.poll_id", "b.poll_date")


@query(f"""WITH {t.POLL_SQL} SELECT firm, poll_id, poll_date FROM poll WHERE poll_date > DATE '{_CUTOFF}' QUALIFY dense_rank() OVER (PARTITION BY firm ORDER BY poll_date) = 1""")
def next_after_cutoff(spark: SparkSession, folder: str) -> DataFrame:
    later = t.polls(spark, folder).where(F.col("poll_date") > F.lit(_CUTOFF).cast("date"))
    first = later.groupBy("firm").agg(F.min("poll_date").alias("poll_date"))
    return later.join(first, ["firm", "poll_date"], "left_semi").select("firm", "poll_id", "poll_date")


def _cps_sql(day: str) -> str:
    return "CAST(" + " + ".join(f"(CASE WHEN {day} >= DATE '{c}' THEN 1 ELSE 0 END)" for c in CHANGEPOINTS) + " AS INTEGER)"


def _camp_sql(day: str) -> str:
    return "CAST(" + " + ".join(f"greatest(0, least({day}, DATE '{b}') - DATE '{a}')" for a, b in CAMPAIGNS) + " AS INTEGER)"


@query(f"""WITH {t.POLL_SQL} SELECT poll_id, {_cps_sql('poll_date')} AS regime, {_camp_sql('poll_date')} AS campaign_days,
  CASE {' '.join(f"WHEN poll_date <= DATE '{e}' THEN '{c}'" for e, c in CYCLES)} ELSE '2026' END AS cycle FROM poll WHERE poll_date IS NOT NULL""")
def time_axis(spark: SparkSession, folder: str) -> DataFrame:
    day = F.col("poll_date")
    return t.polls(spark, folder).where("poll_date IS NOT NULL").select(
        "poll_id", timeaxis.regime_index(day, CHANGEPOINTS).alias("regime"), timeaxis.window_days(day, CAMPAIGNS).alias("campaign_days"), timeaxis.cycle_of(day, CYCLES, "2026").alias("cycle")
    )


@query(f"""WITH {t.POLL_SQL}, d AS (SELECT DISTINCT CAST(date_trunc('week', poll_date) AS DATE) AS week FROM poll WHERE poll_date IS NOT NULL),
  e AS (SELECT week, {_cps_sql('week')} AS g, (week - DATE '2011-01-03') + 3 * {_camp_sql('week')} AS w FROM d)
  SELECT a.week AS week_a, b.week AS week_b, round((1 + sqrt(3e0) * abs(a.w - b.w) / 75) * exp(-sqrt(3e0) * abs(a.w - b.w) / 75) * power(0.4e0, abs(a.g - b.g)), 6) AS k
  FROM e a JOIN e b ON b.week BETWEEN a.week AND a.week + 84""")
def kernel_band(spark: SparkSession, folder: str) -> DataFrame:
    """Matern-3/2 kernel with regimes on the campaign clock, for weeks up to 12 apart: a band join by exploded offsets, not a cross join."""
    day = F.col("week")
    clock = timeaxis.dilated_days(day, F.lit("2011-01-03").cast("date"), CAMPAIGNS, 4.0)
    e = t.polls(spark, folder).where("poll_date IS NOT NULL").select(F.trunc("poll_date", "week").alias("week")).distinct().select("week", timeaxis.regime_index(day, CHANGEPOINTS).alias("g"), clock.alias("w"))
    ahead = e.withColumn("week_b", F.explode(F.transform(F.sequence(F.lit(0), F.lit(12)), lambda i: F.date_add(F.col("week"), i * 7))))
    b = e.select(F.col("week").alias("week_b"), F.col("g").alias("gb"), F.col("w").alias("wb"))
    s = F.sqrt(F.lit(3.0)) * F.abs(F.col("w") - F.col("wb")) / 75
    return ahead.join(b, "week_b").select(F.col("week").alias("week_a"), "week_b", F.round((1 + s) * F.exp(-s) * F.pow(F.lit(0.4), F.abs(F.col("g") - F.col("gb"))), 6).alias("k"))


_HOUSE_SQL = f"""WITH {_WEEK_RES},
raw AS (SELECT firm, party_code, sum(w * r) / sum(w) AS e, count(*) AS n FROM (SELECT *, sqrt(CASE WHEN sample_size > 0 THEN sample_size ELSE 1000 END) AS w FROM res) GROUP BY 1, 2),
shr AS (SELECT firm, party_code, n, e * n / (n + {SHRINK}) AS e FROM raw),
cen AS (SELECT party_code, sum(n * e) / sum(n) AS c FROM shr GROUP BY 1)"""


@query(_HOUSE_SQL + " SELECT firm, party_code, n, round(e - c, 6) AS effect FROM shr JOIN cen USING (party_code)")
def house_effects(spark: SparkSession, folder: str) -> DataFrame:
    """Firms' mean residuals, weighted by precision, shrunk by n / (n + 5) and centred per party."""
    w = F.sqrt(F.when(F.col("sample_size") > 0, F.col("sample_size")).otherwise(1000))
    raw = checkpoint(_residuals(spark, folder).groupBy("firm", "party_code").agg((F.sum(w * F.col("r")) / F.sum(w)).alias("e"), F.count(F.lit(1)).alias("n")))  # read twice
    shrunk = raw.withColumn("e", F.col("e") * F.col("n") / (F.col("n") + SHRINK))
    centre = shrunk.groupBy("party_code").agg((F.sum(F.col("n") * F.col("e")) / F.sum("n")).alias("c"))
    return shrunk.join(centre, "party_code").select("firm", "party_code", "n", F.round(F.col("e") - F.col("c"), 6).alias("effect"))


@query(f"""WITH {_WEEK_RES}, v AS (SELECT party_code, avg(r * r) AS v FROM res WHERE week_n > 1 GROUP BY 1),
  f AS (SELECT firm, count(*) AS n, avg(r * r / v) AS ratio FROM res JOIN v USING (party_code) WHERE week_n > 1 AND v > 0 GROUP BY 1),
  m AS (SELECT firm, n, greatest(0.5e0, least(2.5e0, sqrt((n * ratio + {SHRINK}) / (n + {SHRINK})))) AS m FROM f)
  SELECT firm, n, round(m / (SELECT sum(n * m) / sum(n) FROM m), 6) AS multiplier FROM m""")
def firm_noise(spark: SparkSession, folder: str) -> DataFrame:
    """Noise multipliers of firms: chi-square ratio, shrunk to 1, within 0.5 and 2.5, with a mean of 1."""
    res = checkpoint(_residuals(spark, folder).where("week_n > 1").select("firm", "party_code", "r"))
    v = res.groupBy("party_code").agg(F.avg(F.col("r") * F.col("r")).alias("v")).where("v > 0")
    f = res.join(v, "party_code").groupBy("firm").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("r") * F.col("r") / F.col("v")).alias("ratio"))
    m = f.withColumn("m", F.greatest(F.lit(0.5), F.least(F.lit(2.5), F.sqrt((F.col("n") * F.col("ratio") + SHRINK) / (F.col("n") + SHRINK)))))
    m = checkpoint(m)  # a row per firm, read twice
    mean = m.agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean")).scalar()
    return m.select("firm", "n", F.round(F.col("m") / mean, 6).alias("multiplier"))


@query(f"""WITH {t.COORD_SQL}, {t.POLL_SQL}, o AS (SELECT firm, z1, z2, z3, z4, z5 FROM coord JOIN poll USING (poll_id)),
  b AS (SELECT firm, {', '.join(f'avg({c}) AS b_{c}' for c in t.COORDS)} FROM o GROUP BY firm), g AS (SELECT {', '.join(f'avg({c}) AS g_{c}' for c in t.COORDS)} FROM o)
  SELECT coord.poll_id, {', '.join(f'round({c} - 0.5 * (b_{c} - g_{c}), 6) AS {c}' for c in t.COORDS)} FROM coord JOIN poll USING (poll_id) JOIN b USING (firm), g""")
def debiased_coords(spark: SparkSession, folder: str) -> DataFrame:
    """Half of each firm's mean departure taken off its polls, in coordinates."""
    o = t.coordinates(spark, folder).join(t.polls(spark, folder).select("poll_id", "firm"), "poll_id")
    o = checkpoint(o)
    firms = o.groupBy("firm").agg(*[F.avg(c).alias(f"m_{c}") for c in t.COORDS], *[F.sum(c).alias(f"s_{c}") for c in t.COORDS], F.count(F.lit(1)).alias("n"))
    everyone = Window.partitionBy(F.lit(0))  # over one row per firm
    bias = firms.select("firm", *[(F.col(f"m_{c}") - F.sum(f"s_{c}").over(everyone) / F.sum("n").over(everyone)).alias(f"b_{c}") for c in t.COORDS])
    return o.join(bias, "firm").select("poll_id", *[F.round(F.col(c) - 0.5 * F.col(f"b_{c}"), 6).alias(c) for c in t.COORDS])


_SCALES = [0.005, 0.01, 0.02, 0.04, 0.08]


@query(f"""WITH {_WEEK_RES}, l AS (SELECT party_code, s, sum(-0.5 * r * r / (s * s) - ln(s)) AS lml FROM res, (SELECT unnest([{', '.join(f'{s}e0' for s in _SCALES)}]) AS s) GROUP BY 1, 2),
  w AS (SELECT party_code, s, lml, exp(lml - max(lml) OVER (PARTITION BY party_code)) AS e FROM l), n AS (SELECT *, e / sum(e) OVER (PARTITION BY party_code) AS rel FROM w)
  SELECT party_code, s AS scale, round(lml, 3) AS lml, round(e / sum(e) OVER (PARTITION BY party_code), 6) AS weight FROM n WHERE rel >= 1e-3""")
def ensemble_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Likelihood weights of noise scales, those below 1/1000 dropped and the rest made to sum to 1; sufficient statistics make the likelihoods."""
    s = _residuals(spark, folder).groupBy("party_code").agg(F.sum(F.col("r") * F.col("r")).alias("ss"), F.count(F.lit(1)).alias("n"))
    grid = s.withColumn("scale", F.explode(F.array(*[F.lit(x) for x in _SCALES]))).withColumn("lml", -0.5 * F.col("ss") / (F.col("scale") * F.col("scale")) - F.col("n") * F.log("scale"))
    party = Window.partitionBy("party_code")
    kept = grid.withColumn("e", F.exp(F.col("lml") - F.max("lml").over(party))).withColumn("rel", F.col("e") / F.sum("e").over(party)).where("rel >= 1e-3")
    return kept.select("party_code", "scale", F.round("lml", 3).alias("lml"), F.round(F.col("e") / F.sum("e").over(party), 6).alias("weight"))


_SCORE_SQL = f"WITH {_WEEK_RES}, s AS (SELECT party_code, stddev_samp(r) AS sd FROM res WHERE week_n > 1 GROUP BY 1), z AS (SELECT res.*, s.sd, res.r / s.sd AS z FROM res JOIN s USING (party_code) WHERE week_n > 1 AND sd > 0)"


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    res = checkpoint(_residuals(spark, folder).where("week_n > 1").select("party_code", "r"))
    sd = res.groupBy("party_code").agg(F.stddev_samp("r").alias("sd")).where("sd > 0")
    return res.join(sd, "party_code").withColumn("z", F.col("r") / F.col("sd"))


@query(_SCORE_SQL + """ SELECT party_code, count(*) AS n, round(avg(abs(r)), 6) AS mae, round(sqrt(avg(r * r)), 6) AS rms, round(stddev_pop(r), 6) AS sd_pop, round(avg(CASE WHEN abs(z) <= 1.6449 THEN 1e0 ELSE 0 END), 6) AS coverage90 FROM z GROUP BY 1""")
def error_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).groupBy("party_code").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs("r")), 6).alias("mae"), F.round(F.sqrt(F.avg(F.col("r") * F.col("r"))), 6).alias("rms"),
        F.round(F.stddev_pop("r"), 6).alias("sd_pop"), F.round(F.avg((F.abs("z") <= 1.6449).cast("double")), 6).alias("coverage90"),
    )


_T = "1 / (1 + 0.3275911 * abs(z / sqrt(2e0)))"
_PHI = f"(1 + sign(z) * (1 - ((((1.061405429 * ({_T}) - 1.453152027) * ({_T}) + 1.421413741) * ({_T}) - 0.284496736) * ({_T}) + 0.254829592) * ({_T}) * exp(-z * z / 2))) / 2"


@query(_SCORE_SQL + f", p AS (SELECT party_code, {_PHI} AS pit FROM z) SELECT party_code, CAST(least(9, floor(round(pit, 6) * 10)) AS BIGINT) AS decile, count(*) AS n FROM p GROUP BY 1, 2")
def pit_deciles(spark: SparkSession, folder: str) -> DataFrame:
    pit = stats.normal_cdf(F.col("z"))
    return _scored(spark, folder).groupBy("party_code", F.least(F.lit(9).cast("long"), F.floor(F.round(pit, 6) * 10)).alias("decile")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_WEEK_RES}, v AS (SELECT week, party_code, x, row_number() OVER (PARTITION BY week, party_code ORDER BY x, poll_id) AS i, count(*) OVER (PARTITION BY week, party_code) AS n, avg(x) OVER (PARTITION BY week, party_code) AS y FROM res)
  SELECT week, party_code, round(avg(abs(x - y)) - sum(x * (2 * i - n - 1)) / (max(n) * max(n)), 9) AS crps FROM v GROUP BY 1, 2""")
def crps_weekly(spark: SparkSession, folder: str) -> DataFrame:
    """Continuous ranked probability score of a week's polls against their mean, from ranks of counted values."""
    obs = _residuals(spark, folder)
    counted = obs.groupBy("week", "party_code", "x", "m", "week_n").agg(F.count(F.lit(1)).alias("c"))
    group = Window.partitionBy("week", "party_code")
    upto = F.sum("c").over(group.orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    # ranks of equal values add up to c times their middle rank
    spread = F.sum(F.col("c") * F.col("x") * (2 * (F.col("upto") - (F.col("c") - 1) / 2) - F.col("week_n") - 1))
    return counted.withColumn("upto", upto).groupBy("week", "party_code").agg(
        F.round(F.sum(F.col("c") * F.abs(F.col("x") - F.col("m"))) / F.max("week_n") - spread / (F.max("week_n") * F.max("week_n")), 9).alias("crps")
    )


@query(f"""WITH {_WEEK_RES}, f AS (SELECT r.party_code, CAST(least(9, floor(round(wk.m, 9) * 20)) AS BIGINT) AS bin, wk.m, r.x FROM res r JOIN wk USING (week, party_code))
  SELECT party_code, bin, count(*) AS n, round(avg(m), 9) AS forecast, round(avg(x), 9) AS observed, round(avg((m - x) * (m - x)), 8) AS brier FROM f GROUP BY 1, 2""")
def reliability_bins(spark: SparkSession, folder: str) -> DataFrame:
    bins = F.least(F.lit(9).cast("long"), F.floor(F.round("m", 9) * 20)).alias("bin")
    return _residuals(spark, folder).groupBy("party_code", bins).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("m"), 9).alias("forecast"), F.round(F.avg("x"), 9).alias("observed"), F.round(F.avg((F.col("m") - F.col("x")) * (F.col("m") - F.col("x"))), 8).alias("brier")
    )


@query(f"WITH {t.COORD_SQL} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr, round(covar_samp({a}, {b}), 6) AS cov FROM coord" for i, a in enumerate(t.COORDS) for b in t.COORDS[i + 1 :]))
def corr_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """All correlations in one pass over the coordinates."""
    pairs = [(a, b) for i, a in enumerate(t.COORDS) for b in t.COORDS[i + 1 :]]
    one = t.coordinates(spark, folder).agg(*[F.corr(a, b).alias(f"r_{a}_{b}") for a, b in pairs], *[F.covar_samp(a, b).alias(f"c_{a}_{b}") for a, b in pairs])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.col(f"r_{a}_{b}"), 6).alias("corr"), F.round(F.col(f"c_{a}_{b}"), 6).alias("cov")) for a, b in pairs])
    return one.select(F.explode(rows).alias("e")).select("e.*")


@query(f"WITH {t.COORD_SQL}, s AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}' for c in t.COORDS)} FROM coord) SELECT poll_id, {', '.join(f'round(({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END, 6) AS {c}' for c in t.COORDS)} FROM coord, s")
def standardised_coords(spark: SparkSession, folder: str) -> DataFrame:
    z = checkpoint(t.coordinates(spark, folder))
    moments = z.agg(F.struct(*[F.avg(c).alias(f"m_{c}") for c in t.COORDS], *[F.stddev_samp(c).alias(f"s_{c}") for c in t.COORDS]).alias("m")).scalar()
    scale = lambda c: F.coalesce(F.nullif(moments[f"s_{c}"], F.lit(0.0)), F.lit(1.0))
    return z.select("poll_id", *[F.round((F.col(c) - moments[f"m_{c}"]) / scale(c), 6).alias(c) for c in t.COORDS])


@query(f"""WITH {t.POLL_SQL}, {t.CELL_SQL} SELECT poll_date AS date, party_code, round(avg(x), 9) AS share, count(*) AS n FROM cell JOIN poll USING (poll_id)
  WHERE poll_date >= DATE '2018-01-01' AND region_code = 'National' GROUP BY 1, 2""")
def trend_series(spark: SparkSession, folder: str) -> DataFrame:
    """Range-filtered daily series in long form: the wide parts are unpivoted."""
    p = t.polls(spark, folder).where("region_code = 'National'").where(F.col("poll_date") >= F.lit("2018-01-01").cast("date")).select("poll_id", "poll_date")
    return t.cells(spark, folder).join(p, "poll_id").groupBy(F.col("poll_date").alias("date"), "party_code").agg(F.round(F.avg("x"), 9).alias("share"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {t.POLL_SQL}, {t.CELL_SQL} SELECT p.poll_id, p.region_code, p.firm, p.poll_date, p.sample_size, c.party_code, round(c.x * 100, 4) AS pct FROM poll p JOIN cell c USING (poll_id) WHERE p.region_code = 'National' AND p.sample_size IS NOT NULL""")
def poll_export(spark: SparkSession, folder: str) -> DataFrame:
    p = t.polls(spark, folder).where("region_code = 'National' AND sample_size IS NOT NULL")
    return p.join(t.cells(spark, folder), "poll_id").select("poll_id", "region_code", "firm", "poll_date", "sample_size", "party_code", F.round(F.col("x") * 100, 4).alias("pct"))


@query(f"""WITH {t.POLL_SQL} SELECT poll_id, region_code, 'national' AS kind FROM poll WHERE region_code = 'National' UNION ALL SELECT poll_id, region_code, 'regional' FROM poll WHERE region_code IN ('MTL', 'QC', 'REG')""")
def stacked_observations(spark: SparkSession, folder: str) -> DataFrame:
    p = t.polls(spark, folder)
    kind = lambda where, name: p.where(where).select("poll_id", "region_code", F.lit(name).alias("kind"))
    return kind("region_code = 'National'", "national").unionByName(kind("region_code IN ('MTL', 'QC', 'REG')", "regional"))


@query("""SELECT poll_id, substr(sha1(coalesce(jurisdiction_code, '') || '|' || coalesce(region_code, '') || '|' || coalesce(firm, '') || '|' || coalesce(CAST(poll_date AS VARCHAR), '') || '|' || coalesce(CAST(sample_size AS VARCHAR), '')), 1, 16) AS content_id, load_id FROM polls""")
def poll_id_hash(spark: SparkSession, folder: str) -> DataFrame:
    parts = [F.col(c) for c in ("jurisdiction_code", "region_code", "firm", "poll_date", "sample_size")]
    return read_table(spark, folder, "polls").select("poll_id", poll_id(*parts).alias("content_id"), "load_id")


@query("SELECT firm, regexp_replace(strip_accents(lower(firm)), '[^a-z0-9]', '', 'g') AS key, count(*) AS n FROM polls GROUP BY 1, 2")
def name_keys(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "polls").groupBy("firm").agg(F.count(F.lit(1)).alias("n")).select("firm", name_key(F.col("firm")).alias("key"), "n")


@query(PARSE_SQL + f"""SELECT line_id, trim(regexp_replace(regexp_replace(g[2], '\\[[^\\]]*\\]|\\*', '', 'g'), '[\\s\\x{{00a0}}\\x{{2009}}\\x{{202f}}]+', ' ', 'g')) AS firm, {SHARES_SQL} FROM c WHERE {VALID_SQL}""")
def number_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Shares typed with signs, notes and decimal commas, from the strictly loaded records, with cleaned firm names."""
    return parsing.strict_load(read_table(spark, folder, "poll_rows_raw")).select("line_id", collapse_spaces(F.col("firm")).alias("firm"), *[F.col(c) for c in parsing.FIELDS[3:8]])


_OLD, _NEW = "load_id % 100 <= 4", "load_id % 100 > 4"


@query(f"""WITH a AS (SELECT DISTINCT poll_id FROM polls WHERE {_OLD}), b AS (SELECT DISTINCT poll_id FROM polls WHERE {_NEW})
  SELECT poll_id, 'added' AS change FROM b WHERE poll_id NOT IN (SELECT poll_id FROM a) UNION ALL SELECT poll_id, 'removed' FROM a WHERE poll_id NOT IN (SELECT poll_id FROM b)""")
def two_way_diff(spark: SparkSession, folder: str) -> DataFrame:
    p = read_table(spark, folder, "polls")
    return relational.two_way_difference(p.where(_OLD), p.where(_NEW), ["poll_id"])


@query(f"""WITH o AS (SELECT poll_id, max(sample_size) AS sample_size, min(firm) AS firm FROM polls WHERE {_OLD} GROUP BY 1), n AS (SELECT poll_id, max(sample_size) AS sample_size, min(firm) AS firm FROM polls WHERE {_NEW} GROUP BY 1)
  SELECT poll_id, coalesce(n.sample_size, o.sample_size) AS sample_size, CASE WHEN o.poll_id IS NOT NULL THEN o.firm ELSE n.firm END AS firm FROM o FULL JOIN n USING (poll_id)""")
def upsert_partial(spark: SparkSession, folder: str) -> DataFrame:
    p = read_table(spark, folder, "polls")
    one = lambda where: p.where(where).groupBy("poll_id").agg(F.max("sample_size").alias("sample_size"), F.min("firm").alias("firm"))
    return relational.upsert(one(_OLD), one(_NEW), ["poll_id"], ["sample_size"])


@query("SELECT poll_id, party_code, load_id, feed, pct_reported FROM poll_shares WHERE poll_id NOT IN (SELECT poll_id FROM polls WHERE region_code = 'National' AND poll_id IS NOT NULL)")
def delete_in(spark: SparkSession, folder: str) -> DataFrame:
    keys = read_table(spark, folder, "polls").where("region_code = 'National'").select("poll_id").distinct()
    return relational.delete_in(read_table(spark, folder, "poll_shares"), keys).select("poll_id", "party_code", "load_id", "feed", "pct_reported")


@query(f"WITH {t.WIDE_SQL}, k AS (SELECT *, coalesce(alb,0)+coalesce(lpn,0)+coalesce(mvt,0)+coalesce(prn,0)+coalesce(ucd,0) AS s FROM wide) SELECT poll_id, {', '.join(f'round({p} / s, 6) AS {p}' for p in t.PARTS[:5])} FROM k WHERE s > 0")
def main_parts_closed(spark: SparkSession, folder: str) -> DataFrame:
    """Sub-composition of the five named parties; unmeasured ones stay null."""
    s = comp.total([F.coalesce(F.col(p), F.lit(0.0)) for p in t.PARTS[:5]])
    return t.wide(spark, folder).where(s > 0).select("poll_id", *[F.round(F.col(p) / s, 6).alias(p) for p in t.PARTS[:5]])


_FOLDS = 5


@query(f"""WITH {t.POLL_SQL} SELECT poll_id, CAST((ascii(substr(sha1(poll_id), 1, 1)) * 31 + ascii(substr(sha1(poll_id), 2, 1))) % {_FOLDS} AS INTEGER) AS fold FROM poll""")
def fold_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Fold of each poll from its id's hash: the same on any run and partitioning, without ordering all polls."""
    digest = F.sha1("poll_id")
    number = F.ascii(F.substring(digest, 1, 1)) * 31 + F.ascii(F.substring(digest, 2, 1))
    return t.polls(spark, folder).select("poll_id", (number % _FOLDS).alias("fold"))


@query(f"""WITH {t.POLL_SQL}, {t.WIDE_SQL}, busy AS (SELECT firm FROM poll GROUP BY firm ORDER BY count(*) DESC, firm LIMIT 1),
  j AS (SELECT wide.*, alb + CASE WHEN firm IN (SELECT firm FROM busy) THEN 0.02e0 ELSE 0 END AS alb2 FROM wide JOIN poll USING (poll_id) WHERE alb IS NOT NULL AND alb < 0.9)
  SELECT poll_id, round(alb2, 9) AS alb, {', '.join(f'round({p} * (1 - alb2) / (1 - alb), 9) AS {p}' for p in t.PARTS[1:])} FROM j""")
def bias_injection(spark: SparkSession, folder: str) -> DataFrame:
    """Two points added to one part for the busiest firm, the other parts shrunk to make room: a synthetic bias with a known answer."""
    p = t.polls(spark, folder)
    busiest = p.groupBy("firm").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "firm").limit(1).select("firm").scalar()
    biased = F.when(F.col("firm") == busiest, F.col("alb") + 0.02).otherwise(F.col("alb"))
    joined = t.wide(spark, folder).join(p.select("poll_id", "firm"), "poll_id").where("alb < 0.9").withColumn("alb2", biased)
    room = (1 - F.col("alb2")) / (1 - F.col("alb"))
    return joined.select("poll_id", F.round("alb2", 9).alias("alb"), *[F.round(F.col(c) * room, 9).alias(c) for c in t.PARTS[1:]])


@query(f"""WITH {t.POLL_SQL}, {t.COMP_SQL}, b AS (SELECT firm, {', '.join(f'avg(ln({p})) AS l_{p}' for p in t.PARTS)} FROM comp JOIN poll USING (poll_id) GROUP BY firm),
  g AS (SELECT {', '.join(f'avg(ln({p})) AS g_{p}' for p in t.PARTS)} FROM comp),
  f AS (SELECT comp.poll_id, {', '.join(f'{p} * exp(0.5e0 * (g_{p} - l_{p})) AS {p}' for p in t.PARTS)} FROM comp JOIN poll USING (poll_id) JOIN b USING (firm), g)
  SELECT poll_id, {', '.join(f"round({p} / ({' + '.join(t.PARTS)}), 9) AS {p}" for p in t.PARTS)} FROM f""")
def part_reweighting(spark: SparkSession, folder: str) -> DataFrame:
    """Every part times a factor of its firm, closed again, as turnout factors are applied: half the mean log gap to all firms."""
    every = t.compositions(spark, folder)
    c = checkpoint(every.join(t.polls(spark, folder).select("poll_id", "firm"), "poll_id"))
    everyone = every.agg(F.struct(*[F.avg(F.log(p)).alias(p) for p in t.PARTS]).alias("m")).scalar()
    own = c.groupBy("firm").agg(*[F.avg(F.log(p)).alias(f"l_{p}") for p in t.PARTS])
    moved = c.join(own, "firm").select("poll_id", *[(F.col(p) * F.exp(0.5 * (everyone[p] - F.col(f"l_{p}")))).alias(p) for p in t.PARTS])
    return moved.select("poll_id", *t.named(comp.closure(t.columns(t.PARTS)), t.PARTS, 9))


@query(f"""WITH {t.POLL_SQL}, m AS (SELECT firm, date_trunc('month', poll_date) AS month, count(*) AS n FROM poll WHERE poll_date IS NOT NULL GROUP BY 1, 2)
  SELECT CAST(month AS DATE) AS month, count(*) AS firms, CAST(sum(n) AS BIGINT) AS polls, CAST(max(n) AS BIGINT) AS busiest FROM m GROUP BY 1""")
def firms_per_month(spark: SparkSession, folder: str) -> DataFrame:
    m = t.polls(spark, folder).where("poll_date IS NOT NULL").groupBy("firm", F.trunc("poll_date", "month").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return m.groupBy("month").agg(F.count(F.lit(1)).alias("firms"), F.sum("n").alias("polls"), F.max("n").alias("busiest"))
