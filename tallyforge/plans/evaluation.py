"""Catalogue: forecasts against results, final polls, persistence, mandates and differences between regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.functions import composition as comp
from tallyforge.functions import stats
from tallyforge.operators import regression, relational
from tallyforge.plans import elections as e
from tallyforge.plans import tables as t
from tallyforge.plans.registry import Catalogue
from tallyforge.session import checkpoint

CATALOGUE = Catalogue()
query = CATALOGUE.query

# Election days with the map they were held on, the days a final poll may lie back, and the grid of shrinkage.
ELECTIONS = [("2014-04-07", "2011"), ("2018-10-01", "2017"), ("2022-10-03", "2017")]
FINAL_DAYS = 60
LAMBDAS = [0.0, 0.25, 0.5, 0.75, 1.0]
REST_FLOOR = 0.002
BANDS = 3


def _suffixed(df: DataFrame, prefix: str, names: list[str], *keys: str) -> DataFrame:
    return df.select(*keys, *[F.col(n).alias(f"{prefix}_{n}") for n in names])


def _long(df: DataFrame, *keys: str) -> DataFrame:
    """One row per part: (keys, party_code, x)."""
    parts = F.explode(F.array(*[F.struct(F.lit(p).alias("party_code"), F.col(p.lower()).alias("x")) for p in t.PARTIES]))
    return df.select(*keys, parts.alias("_p")).select(*keys, "_p.*")


_LONG_PROV = "actual AS (" + " UNION ALL ".join(f"SELECT boundary_year, '{p}' AS party_code, {p.lower()} AS actual FROM prov" for p in t.PARTIES) + ")"
_DAYS = "days(day, boundary_year) AS (VALUES " + ", ".join(f"(DATE '{d}', '{m}')" for d, m in ELECTIONS) + ")"


@query(f"""WITH {t.POLL_SQL}, {t.CELL_SQL}, {e._RID}, {_LONG_PROV}, {_DAYS},
  fin AS (SELECT day, boundary_year, firm, poll_id FROM poll JOIN days ON poll_date <= day AND poll_date > day - {FINAL_DAYS}
    QUALIFY row_number() OVER (PARTITION BY day, firm ORDER BY poll_date DESC, scraped_at NULLS FIRST, load_id NULLS FIRST, poll_id) = 1),
  err AS (SELECT CAST(day AS VARCHAR) AS election, party_code, x - actual AS r FROM fin JOIN cell USING (poll_id) JOIN actual USING (boundary_year, party_code))
  SELECT election, party_code, count(*) AS n, round(avg(r), 6) AS bias, round(avg(abs(r)), 6) AS mae, round(stddev_pop(r), 6) AS sd FROM err GROUP BY 1, 2""")
def final_poll_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Errors of each firm's last poll before an election against the result on its map. A poll is tied to its election by arithmetic, not by a range join."""
    day = F.coalesce(*[F.when((F.col("poll_date") <= F.lit(d).cast("date")) & (F.datediff(F.lit(d).cast("date"), "poll_date") < FINAL_DAYS), F.lit(d)) for d, _ in ELECTIONS])
    near = t.polls(spark, folder).withColumn("election", day).where("election IS NOT NULL")
    final = near.groupBy("election", "firm").agg(F.min(F.struct((-F.unix_date("poll_date")).alias("back"), "scraped_at", "load_id", "poll_id")).alias("b"))
    maps = F.create_map(*[F.lit(x) for pair in ELECTIONS for x in pair])
    final = final.select("election", maps[F.col("election")].alias("boundary_year"), F.col("b.poll_id").alias("poll_id"))
    actual = _long(t.ridings(spark, folder, "boundary_year"), "boundary_year").withColumnRenamed("x", "actual")
    r = F.col("x") - F.col("actual")
    errors = final.join(t.cells(spark, folder), "poll_id").join(actual, ["boundary_year", "party_code"])
    return errors.groupBy("election", "party_code").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(r), 6).alias("bias"), F.round(F.avg(F.abs(r)), 6).alias("mae"), F.round(F.stddev_pop(r), 6).alias("sd")
    )


_SWUNG_NEXT = e._swing_sql() + ", fc AS (SELECT nxt.after_year, s.* FROM swung s JOIN nxt USING (boundary_year))"


def _forecasts(spark: SparkSession, folder: str) -> DataFrame:
    return e._next_map(e._swung(spark, folder))


@query(_SWUNG_NEXT + f""", fw AS (SELECT *, {e._WINNER} AS winner FROM fc), aw AS (SELECT *, {e._WINNER} AS winner FROM rid)
  SELECT a.boundary_year, count(*) AS n, count(*) FILTER (f.winner = a.winner) AS hits,
    round(avg(({' + '.join(f'abs(f.{p} - a.{p})' for p in t.PARTS)}) / 6), 6) AS mae,
    round(avg({' + '.join(f"power(f.{p} - CASE WHEN a.winner = '{p.upper()}' THEN 1 ELSE 0 END, 2)" for p in t.PARTS)}), 6) AS brier
  FROM fw f JOIN aw a ON a.boundary_year = f.after_year AND a.riding = f.riding GROUP BY 1""")
def swing_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Swung ridings against the next map's results: winners hit, mean error and multi-class Brier score."""
    forecast = e._winner(_forecasts(spark, folder)).select(F.col("after_year").alias("boundary_year"), "riding", F.col("winner").alias("f_winner"), *[F.col(p).alias(f"f_{p}") for p in t.PARTS])
    both = e._winner(t.ridings(spark, folder)).join(forecast, ["boundary_year", "riding"])
    gaps = comp.total([F.abs(F.col(f"f_{p}") - F.col(p)) for p in t.PARTS]) / len(t.PARTS)
    won = lambda p: (F.col("winner") == p.upper()).cast("double")
    brier = comp.total([F.pow(F.col(f"f_{p}") - won(p), F.lit(2.0)) for p in t.PARTS])
    return both.groupBy("boundary_year").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("winner") == F.col("f_winner")).alias("hits"), F.round(F.avg(gaps), 6).alias("mae"), F.round(F.avg(brier), 6).alias("brier")
    )


def _true_total_sql() -> str:
    raw = ", ".join(f"f.{p} * a.{p} / m.{p} AS e_{p}" for p in t.PARTS)
    whole = " + ".join(f"e_{p}" for p in t.PARTS)
    return (
        f"{_SWUNG_NEXT}, m AS (SELECT after_year, {', '.join(f'avg({p}) AS {p}' for p in t.PARTS)} FROM fc GROUP BY 1), "
        f"x AS (SELECT f.after_year AS boundary_year, f.riding, {raw} FROM fc f JOIN m USING (after_year) JOIN prov a ON a.boundary_year = f.after_year) "
        f"SELECT boundary_year, riding, {', '.join(f'round(e_{p} / ({whole}), 6) AS {p}' for p in t.PARTS)} FROM x"
    )


@query(_true_total_sql())
def counterfactual_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Forecasts of the ridings moved by the gap between the true total and their own mean, so that only the spread between ridings is left to err."""
    fc = _forecasts(spark, folder)
    mean = fc.groupBy("after_year").agg(*[F.avg(p).alias(f"m_{p}") for p in t.PARTS])
    actual = _suffixed(t.ridings(spark, folder, "boundary_year").withColumnRenamed("boundary_year", "after_year"), "a", t.PARTS, "after_year")
    moved = comp.swung(t.columns(t.PARTS), [F.col(f"m_{p}") for p in t.PARTS], [F.col(f"a_{p}") for p in t.PARTS])
    return fc.join(mean, "after_year").join(actual, "after_year").select(F.col("after_year").alias("boundary_year"), "riding", *t.named(moved, t.PARTS, 6))


_ORD = f"list_position([{', '.join(f"'{p}'" for p in t.PARTIES)}], party)"


@query(f"""WITH {e._WINS}, nat AS (SELECT election_date, min(boundary_year) AS boundary_year FROM win GROUP BY 1),
  seats AS (SELECT election_date, party, count(*) AS n FROM win JOIN nat USING (election_date, boundary_year) GROUP BY 1, 2),
  gov AS (SELECT election_date, party FROM seats QUALIFY row_number() OVER (PARTITION BY election_date ORDER BY n DESC, {_ORD}) = 1),
  c AS (SELECT *, CASE WHEN party = lag(party) OVER (ORDER BY election_date) THEN 0 ELSE 1 END AS changed, lead(party) OVER (ORDER BY election_date) AS following FROM gov),
  i AS (SELECT *, sum(changed) OVER (ORDER BY election_date) AS island FROM c),
  s AS (SELECT *, row_number() OVER (PARTITION BY island ORDER BY election_date) AS streak FROM i)
  SELECT CAST(least(streak, {BANDS}) AS INTEGER) AS band, count(*) AS n, count(*) FILTER (following = party) AS reelected FROM s WHERE following IS NOT NULL GROUP BY 1""")
def mandate_bands(spark: SparkSession, folder: str) -> DataFrame:
    """How often the party with most seats stays, by the number of its terms in a row. Only one row per election day meets in the window."""
    wins = e._wins(spark, folder)
    native = wins.groupBy("election_date").agg(F.min("boundary_year").alias("boundary_year"))
    seats = wins.join(native, ["election_date", "boundary_year"], "left_semi").groupBy("election_date", "party").agg(F.count(F.lit(1)).alias("n"))
    place = F.array_position(F.array(*[F.lit(p) for p in t.PARTIES]), F.col("party"))
    holders = seats.groupBy(F.lit("all").alias("house"), "election_date").agg(stats.first_argmax(F.col("party"), F.col("n"), place).alias("party"))
    terms = relational.islands(holders, ["house"], "party", ["election_date"])
    terms = terms.withColumn("following", F.lead("party").over(Window.partitionBy("house").orderBy("election_date"))).where("following IS NOT NULL")
    return terms.groupBy(F.least(F.col("streak"), F.lit(BANDS)).cast("int").alias("band")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("following") == F.col("party")).alias("reelected"))


@query(f"""WITH {e._WINS}, sh AS (SELECT boundary_year, riding, election_date, party, v / nullif(sum(v) OVER (PARTITION BY boundary_year, riding, election_date), 0) AS share FROM w),
  h AS (SELECT boundary_year, riding, election_date, lag(election_date) OVER o AS before, lag(party) OVER o AS holder FROM win WINDOW o AS (PARTITION BY boundary_year, riding ORDER BY election_date))
  SELECT h.boundary_year, h.riding, h.election_date, h.holder, round(coalesce(a.share, 0) - coalesce(b.share, 0), 6) AS swing FROM h
  LEFT JOIN sh a ON a.boundary_year = h.boundary_year AND a.riding = h.riding AND a.election_date = h.election_date AND a.party = h.holder
  LEFT JOIN sh b ON b.boundary_year = h.boundary_year AND b.riding = h.riding AND b.election_date = h.before AND b.party = h.holder WHERE h.holder IS NOT NULL""")
def holder_swing(spark: SparkSession, folder: str) -> DataFrame:
    """Change of the share of the party that holds a riding since it won it; a party that does not run again has 0."""
    keys = ["boundary_year", "riding", "election_date"]
    votes = t.results(spark, folder).groupBy(*keys, "party").agg(F.sum("votes").alias("v"))
    tally = votes.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("party", "v"))).alias("votes"), F.nullif(F.sum("v"), F.lit(0.0)).alias("total"))  # six parties at most
    best = F.array_max(F.transform(F.map_entries("votes"), lambda x: F.struct(x["value"].alias("v"), (-F.array_position(F.array(*[F.lit(p) for p in t.PARTIES]), x["key"])).alias("o"), x["key"].alias("party"))))
    past = Window.partitionBy("boundary_year", "riding").orderBy("election_date")
    held = tally.withColumn("best", best["party"]).select(
        *keys, "votes", "total", F.lag("best").over(past).alias("holder"), F.lag("votes").over(past).alias("votes0"), F.lag("total").over(past).alias("total0")
    ).where("holder IS NOT NULL")
    share = lambda v, n: F.coalesce(F.try_element_at(v, F.col("holder")) / F.col(n), F.lit(0.0))
    return held.select(*keys, "holder", F.round(share(F.col("votes"), "total") - share(F.col("votes0"), "total0"), 6).alias("swing"))


_WEEK = f"""{t.POLL_SQL}, {t.CELL_SQL}, wk AS (SELECT CAST(date_trunc('week', poll_date) AS DATE) AS week, region_code, party_code, avg(x) AS m
  FROM cell JOIN poll USING (poll_id) WHERE poll_date IS NOT NULL AND region_code IS NOT NULL GROUP BY 1, 2, 3)"""


def _weekly(spark: SparkSession, folder: str) -> DataFrame:
    """Mean share per week, region and party."""
    dated = t.polls(spark, folder).where("poll_date IS NOT NULL AND region_code IS NOT NULL").select("poll_id", "region_code", F.trunc("poll_date", "week").alias("week"))
    return t.cells(spark, folder).join(dated, "poll_id").groupBy("week", "region_code", "party_code").agg(F.avg("x").alias("m"))


@query(f"""WITH {_WEEK} SELECT r.region_code, party_code, count(*) AS n, round(avg(ln(r.m / n.m)), 6) AS gradient, round(stddev_pop(ln(r.m / n.m)) / sqrt(count(*)), 6) AS se
  FROM wk r JOIN wk n USING (week, party_code) WHERE r.region_code <> 'National' AND n.region_code = 'National' AND r.m > 0 AND n.m > 0 GROUP BY 1, 2""")
def region_gradient(spark: SparkSession, folder: str) -> DataFrame:
    """Mean log-ratio of a region's share to the whole's in the same week, with its standard error."""
    w = _weekly(spark, folder).where("m > 0")
    whole = w.where("region_code = 'National'").select("week", "party_code", F.col("m").alias("m0"))
    ratio = F.log(F.col("m") / F.col("m0"))
    return w.where("region_code <> 'National'").join(whole, ["week", "party_code"]).groupBy("region_code", "party_code").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(ratio), 6).alias("gradient"), F.round(F.stddev_pop(ratio) / F.sqrt(F.count(F.lit(1))), 6).alias("se")
    )


@query(f"""WITH {_WEEK}, d AS (SELECT a.region_code, a.party_code, (a.m - b.m) / 14 AS slope, (c.m - a.m) / 14 AS onward FROM wk a
    JOIN wk b ON b.region_code = a.region_code AND b.party_code = a.party_code AND b.week = a.week - 14 JOIN wk c ON c.region_code = a.region_code AND c.party_code = a.party_code AND c.week = a.week + 14)
  SELECT region_code, party_code, count(*) AS n, round(sum(slope * onward) / nullif(sum(slope * slope), 0), 6) AS rho FROM d GROUP BY 1, 2""")
def momentum(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a fortnight's slope goes on in the next: three weeks meet by moving their key in one aggregation, without a self join."""
    w = _weekly(spark, folder)
    shift = F.explode(F.array(*[F.struct(F.date_add("week", 14 * i).alias("at"), F.lit(i).alias("i")) for i in (-1, 0, 1)]))
    at = lambda i: F.max(F.when(F.col("s.i") == i, F.col("m")))
    three = w.select("region_code", "party_code", "m", shift.alias("s")).groupBy("region_code", "party_code", F.col("s.at").alias("week")).agg(at(1).alias("b"), at(0).alias("a"), at(-1).alias("c"))
    slope, onward = (F.col("a") - F.col("b")) / 14, (F.col("c") - F.col("a")) / 14
    return three.where("a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL").groupBy("region_code", "party_code").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(slope * onward) / F.nullif(F.sum(slope * slope), F.lit(0.0)), 6).alias("rho")
    )


@query(f"""WITH {t.POLL_SQL}, {t.CELL_SQL} SELECT CAST(date_trunc('week', poll_date) AS DATE) AS week, party_code, count(*) AS n, round(sum(x * sample_size) / sum(sample_size), 6) AS share
  FROM cell JOIN poll USING (poll_id) WHERE poll_date IS NOT NULL AND region_code IN ('MTL', 'QC') AND sample_size > 0 GROUP BY 1, 2""")
def merged_strata(spark: SparkSession, folder: str) -> DataFrame:
    """Two strata as one region, weighted by their samples."""
    strata = t.polls(spark, folder).where("poll_date IS NOT NULL AND region_code IN ('MTL', 'QC') AND sample_size > 0")
    joined = t.cells(spark, folder).join(strata, "poll_id")
    return joined.groupBy(F.trunc("poll_date", "week").alias("week"), "party_code").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("x") * F.col("sample_size")) / F.sum("sample_size"), 6).alias("share")
    )


_REST = f"greatest(coalesce(prn, 0) + coalesce(ucd, 0) + coalesce(autres, 0), {REST_FLOOR})"


@query(f"""WITH {t.WIDE_SQL}, s AS (SELECT poll_id, alb, lpn, mvt, {_REST} AS rest FROM wide WHERE alb > 0 AND lpn > 0 AND mvt > 0)
  SELECT poll_id, {', '.join(f'round({p} / (alb + lpn + mvt + rest), 9) AS {p}' for p in ('alb', 'lpn', 'mvt', 'rest'))} FROM s""")
def amalgamated_parts(spark: SparkSession, folder: str) -> DataFrame:
    """A sub-composition: three parts and the rest as one, with a floor."""
    w = t.wide(spark, folder).where("alb > 0 AND lpn > 0 AND mvt > 0")
    rest = F.greatest(comp.total([F.coalesce(F.col(p), F.lit(0.0)) for p in ("prn", "ucd", "autres")]), F.lit(REST_FLOOR))
    return w.select("poll_id", *t.named(comp.closure([F.col("alb"), F.col("lpn"), F.col("mvt"), rest]), ["alb", "lpn", "mvt", "rest"], 9))


@query(f"""WITH {e._DEP}, pr AS (SELECT a.boundary_year, {' + '.join(f'a.{c} * a.{c}' for c in t.COORDS)} AS aa, {' + '.join(f'a.{c} * b.{c}' for c in t.COORDS)} AS ab, {' + '.join(f'b.{c} * b.{c}' for c in t.COORDS)} AS bb
    FROM dev a JOIN nxt USING (boundary_year) JOIN dev b ON b.boundary_year = nxt.after_year AND b.riding = a.riding),
  g AS (SELECT unnest([{', '.join(f'{x}e0' for x in LAMBDAS)}]) AS lambda_)
  SELECT boundary_year, lambda_ AS "lambda", count(*) AS n, round((sum(bb) - 2 * lambda_ * sum(ab) + lambda_ * lambda_ * sum(aa)) / (5 * count(*)), 6) AS mse FROM pr, g GROUP BY 1, 2""")
def shrink_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Error of a riding's deviation foretold as lambda times its last one, over a grid: three sums per map serve every lambda."""
    dev = e._deviations(spark, folder)
    after = _suffixed(dev.withColumnRenamed("boundary_year", "after_year"), "b", t.COORDS, "after_year", "riding")
    pairs = e._next_map(dev).join(after, ["after_year", "riding"])
    dot = lambda x, y: F.sum(comp.total([F.col(x + c) * F.col(y + c) for c in t.COORDS]))
    sums = pairs.groupBy("boundary_year").agg(F.count(F.lit(1)).alias("n"), dot("", "").alias("aa"), dot("", "b_").alias("ab"), dot("b_", "b_").alias("bb"))
    grid = sums.withColumn("lambda", F.explode(F.array(*[F.lit(x) for x in LAMBDAS])))
    mse = (F.col("bb") - 2 * F.col("lambda") * F.col("ab") + F.col("lambda") * F.col("lambda") * F.col("aa")) / (len(t.COORDS) * F.col("n"))
    return grid.select("boundary_year", "lambda", "n", F.round(mse, 6).alias("mse"))


@query(f"""WITH {t.CELL_SQL}, {e._RID}, {_LONG_PROV}, h AS (SELECT party_code, CAST(floor(round(x * 100, 9)) AS BIGINT) AS bin, count(*) AS n FROM cell GROUP BY 1, 2)
  SELECT boundary_year, party_code, round((sum(CASE WHEN bin < floor(actual * 100) THEN n ELSE 0 END) + 0.5 * sum(CASE WHEN bin = floor(actual * 100) THEN n ELSE 0 END)) / sum(n), 6) AS position
  FROM h JOIN actual USING (party_code) GROUP BY 1, 2""")
def mid_quantile(spark: SparkSession, folder: str) -> DataFrame:
    """Where a result lies in the histogram of a party's polls, half of its own bin counted: at most 101 bins a party meet the maps."""
    h = t.cells(spark, folder).groupBy("party_code", F.floor(F.round(F.col("x") * 100, 9)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    actual = _long(t.ridings(spark, folder, "boundary_year"), "boundary_year").select("boundary_year", "party_code", F.floor(F.col("x") * 100).alias("own"))
    place = F.when(F.col("bin") < F.col("own"), F.col("n").cast("double")).when(F.col("bin") == F.col("own"), F.col("n") * 0.5).otherwise(0.0)
    return h.join(actual, "party_code").groupBy("boundary_year", "party_code").agg(F.round(F.sum(place) / F.sum("n"), 6).alias("position"))


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS v, l_suppkey AS c FROM lineitem), p AS (SELECT a.c AS a, b.c AS b FROM e a JOIN e b ON a.v = b.v AND a.c < b.c GROUP BY 1, 2 HAVING count(*) >= 2),
  x AS (SELECT s.s_acctbal AS x, u.s_acctbal AS y FROM p JOIN supplier s ON s.s_suppkey = a JOIN supplier u ON u.s_suppkey = b), d AS (SELECT x, y FROM x UNION ALL SELECT y, x FROM x)
  SELECT CAST(count(*) // 2 AS BIGINT) AS n_pairs, round(corr(x, y), 6) AS r FROM d""")
def neighbour_corr(spark: SparkSession, folder: str) -> DataFrame:
    """Correlation of a value between adjacent suppliers, each pair counted both ways, from sums over the pairs."""
    value = t.read_table(spark, folder, "supplier").select("s_suppkey", "s_acctbal")
    pairs = e.adjacency_pairs(spark, folder)
    ends = pairs.join(value.toDF("a", "x"), "a").join(value.toDF("b", "y"), "b")
    both = ends.select(F.explode(F.array(F.struct(F.col("x").alias("p"), F.col("y").alias("q")), F.struct(F.col("y").alias("p"), F.col("x").alias("q")))).alias("d")).select("d.*")
    return both.agg(F.floor(F.count(F.lit(1)) / 2).alias("n_pairs"), F.round(F.corr("p", "q"), 6).alias("r"))


@query()
def riding_holdout_r2(spark: SparkSession, folder: str) -> DataFrame:
    """How well a riding's deviation on the next map follows from its coordinates and votes on this one, on held-out halves."""
    dev = e._deviations(spark, folder)
    votes = t.ridings(spark, folder).select("boundary_year", "riding", F.log("n_votes").alias("log_votes"))
    after = _suffixed(dev.withColumnRenamed("boundary_year", "after_year"), "b", t.COORDS, "after_year", "riding")
    pairs = e._next_map(dev.join(votes, ["boundary_year", "riding"])).join(after, ["after_year", "riding"])
    pairs = checkpoint(pairs.select("riding", *t.COORDS, "log_votes", *[f"b_{c}" for c in t.COORDS]))  # read by the fit and by its check
    table = regression.holdout_r2(pairs, "riding", [*t.COORDS, "log_votes"], [f"b_{c}" for c in t.COORDS])
    return table.withColumns({"r2": F.round("r2", 6), "r2_sd": F.round("r2_sd", 6)})
