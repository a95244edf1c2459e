"""Catalogue: riding results, swing, departures between maps, simulation and its summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.functions import composition as comp
from tallyforge.functions import rng, stats
from tallyforge.functions.text import is_blank, name_key, riding_code
from tallyforge.operators import montecarlo as mc
from tallyforge.operators import relational
from tallyforge.plans import tables as t
from tallyforge.plans.registry import Catalogue
from tallyforge.session import read_table

CATALOGUE = Catalogue()
query = CATALOGUE.query

# The maps in order.
MAPS = ["1992", "2001", "2011", "2017", "2026"]
OPEN_SEAT_FACTOR, MAX_SHIFT, BLEND = 0.118, 0.35, 0.5
N_DRAWS = 5000
#: Queries whose SQL is too slow on whole tables at so many draws; the tests compare them on the smallest ones.
SLOW_SQL = {"seat_sim_counts", "win_probs", "seat_hist", "medoid_draw", "government_scenarios", "gallagher_index"}

_RID = f"{t.RESULT_SQL}, {t.riding_sql('rid', 'boundary_year, riding')}, {t.riding_sql('prov', 'boundary_year')}"
_NEXT = "nxt(boundary_year, after_year) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in zip(MAPS, MAPS[1:])) + ")"
_rounded = lambda names, d=6: ", ".join(f"round({n}, {d}) + 0e0 AS {n}" for n in names)
_clr = lambda alias, p: f"(ln({alias}.{p}) - (" + " + ".join(f"ln({alias}.{q})" for q in t.PARTS) + ") / 6)"


def _next_map(df: DataFrame) -> DataFrame:
    """Add the map that follows."""
    pairs = [x for a, b in zip(MAPS, MAPS[1:]) for x in (F.lit(a), F.lit(b))]
    return df.withColumn("after_year", F.create_map(*pairs)[F.col("boundary_year")])


@query(f"WITH {t.RESULT_SQL} SELECT boundary_year, riding, party, sum(votes) AS votes, round(sum(votes) / nullif(sum(sum(votes)) OVER (PARTITION BY boundary_year, riding), 0), 6) AS share FROM result GROUP BY 1, 2, 3")
def riding_shares(spark: SparkSession, folder: str) -> DataFrame:
    v = t.results(spark, folder).groupBy("boundary_year", "riding", "party").agg(F.sum("votes").alias("votes"))
    return v.select("boundary_year", "riding", "party", "votes", F.round(relational.share_of_group(F.col("votes"), "boundary_year", "riding"), 6).alias("share"))


@query(f"WITH {_RID} SELECT boundary_year, {_rounded(t.PARTS)} FROM prov")
def province_shares(spark: SparkSession, folder: str) -> DataFrame:
    return t.ridings(spark, folder, "boundary_year").select("boundary_year", *t.named(t.columns(t.PARTS), t.PARTS, 6))


_REGION = "reg AS (SELECT boundary_year, regexp_replace(strip_accents(lower(riding_name)), '[^a-z0-9]', '', 'g') AS riding, min(region_code) AS region FROM qc_riding_names GROUP BY 1, 2)"


def _regions(spark: SparkSession, folder: str) -> DataFrame:
    names = read_table(spark, folder, "qc_riding_names")
    return names.groupBy("boundary_year", name_key(F.col("riding_name")).alias("riding")).agg(F.min("region_code").alias("region"))


@query(f"""WITH {t.RESULT_SQL}, {_REGION}, v AS (SELECT boundary_year, coalesce(region, '?') AS region, sum(votes) AS votes FROM result LEFT JOIN reg USING (boundary_year, riding) GROUP BY 1, 2)
  SELECT boundary_year, region, votes, round(votes / nullif(sum(votes) OVER (PARTITION BY boundary_year), 0), 6) AS weight FROM v""")
def region_weights(spark: SparkSession, folder: str) -> DataFrame:
    v = t.results(spark, folder).groupBy("boundary_year", "riding").agg(F.sum("votes").alias("votes")).join(_regions(spark, folder), ["boundary_year", "riding"], "left")
    v = v.groupBy("boundary_year", F.coalesce("region", F.lit("?")).alias("region")).agg(F.sum("votes").alias("votes"))
    return v.withColumn("weight", F.round(relational.share_of_group(F.col("votes"), "boundary_year"), 6))


def _swing_sql() -> str:
    raw = ", ".join(f"exp({_clr('r', p)} + {_clr('b', p)} - {_clr('a', p)}) AS e_{p}" for p in t.PARTS)
    whole = " + ".join(f"e_{p}" for p in t.PARTS)
    return (
        f"WITH {_RID}, {_NEXT}, sw AS (SELECT r.boundary_year, r.riding, {raw} FROM rid r JOIN nxt USING (boundary_year) JOIN prov a ON a.boundary_year = r.boundary_year JOIN prov b ON b.boundary_year = nxt.after_year), "
        f"swung AS (SELECT boundary_year, riding, {', '.join(f'e_{p} / ({whole}) AS {p}' for p in t.PARTS)} FROM sw)"
    )


def _swung(spark: SparkSession, folder: str) -> DataFrame:
    """Each riding moved by its map's swing to the next map's province-wide result: two equi-joins on the map."""
    prov = t.ridings(spark, folder, "boundary_year").drop("n_votes")
    before = prov.select("boundary_year", *[F.col(p).alias(f"a_{p}") for p in t.PARTS])
    after = prov.select(F.col("boundary_year").alias("after_year"), *[F.col(p).alias(f"b_{p}") for p in t.PARTS])
    joined = _next_map(t.ridings(spark, folder)).join(before, "boundary_year").join(after, "after_year")
    moved = comp.swung(t.columns(t.PARTS), [F.col(f"a_{p}") for p in t.PARTS], [F.col(f"b_{p}") for p in t.PARTS])
    return joined.select("boundary_year", "riding", *t.named(moved, t.PARTS))


@query(_swing_sql() + f" SELECT boundary_year, riding, {_rounded(t.PARTS)} FROM swung")
def uniform_swing(spark: SparkSession, folder: str) -> DataFrame:
    return _swung(spark, folder).select("boundary_year", "riding", *t.named(t.columns(t.PARTS), t.PARTS, 6))


_BEST = "greatest(" + ", ".join(f"round({p}, 9)" for p in t.PARTS) + ")"
_WINNER = "CASE " + " ".join(f"WHEN round({p}, 9) = {_BEST} THEN '{p.upper()}'" for p in t.PARTS) + " END"


def _winner(df: DataFrame) -> DataFrame:
    """First part of the largest share."""
    shares = [F.round(F.col(p), 9) for p in t.PARTS]
    best = F.greatest(*shares)
    return df.withColumn("winner", F.coalesce(*[F.when(s == best, F.lit(p.upper())) for p, s in zip(t.PARTS, shares)]))


@query(_swing_sql() + f" SELECT boundary_year, {_WINNER} AS party, count(*) AS seats FROM swung GROUP BY 1, 2")
def seat_projection(spark: SparkSession, folder: str) -> DataFrame:
    """Flagship: who wins each riding after a uniform log-ratio swing, and how many seats per party."""
    return _winner(_swung(spark, folder)).groupBy("boundary_year", F.col("winner").alias("party")).agg(F.count(F.lit(1)).alias("seats"))


def _perturb_sql(factor: str, source: str) -> str:
    scaled = [f"{p} * (CASE WHEN {_WINNER} = '{p.upper()}' THEN {factor} ELSE 1 END)" for p in t.PARTS]
    return f"SELECT boundary_year, riding, {', '.join(f'round(({s}) / ({" + ".join(scaled)}), 6) AS {p}' for s, p in zip(scaled, t.PARTS))} FROM {source}"


_OPEN = """open AS (SELECT DISTINCT regexp_replace(strip_accents(lower(riding_name)), '[^a-z0-9]', '', 'g') AS riding FROM qc_incumbents WHERE elected_with_note = 'ne se represente pas' AND trim(riding_name) <> '')"""


@query(f"WITH {_RID}, {_OPEN}, hit AS (SELECT rid.* FROM rid SEMI JOIN open USING (riding)) " + _perturb_sql("exp(-0.118)", "hit"))
def open_seat_penalty(spark: SparkSession, folder: str) -> DataFrame:
    """Winner's part divided by e^0.118 where the sitting member does not run again: a semi join and one perturbation."""
    incumbents = read_table(spark, folder, "qc_incumbents").where("elected_with_note = 'ne se represente pas'").where(~is_blank(F.col("riding_name")))
    hit = _winner(t.ridings(spark, folder).join(incumbents.select(name_key(F.col("riding_name")).alias("riding")).distinct(), "riding", "left_semi"))
    scaled = [F.col(p) * F.when(F.col("winner") == p.upper(), F.exp(F.lit(-OPEN_SEAT_FACTOR))).otherwise(1.0) for p in t.PARTS]
    return hit.select("boundary_year", "riding", *t.named(comp.closure(scaled), t.PARTS, 6))


def _coord_sql(source: str, keys: str, out: str) -> str:
    return f"{out} AS (SELECT {keys}, {', '.join(f'{e} AS {c}' for e, c in zip(t.ilr_sql(), t.COORDS))} FROM {source})"


_DEP = f"""{_RID}, {_NEXT}, {_coord_sql('rid', 'boundary_year, riding', 'rz')}, {_coord_sql('prov', 'boundary_year', 'pz')},
dev AS (SELECT rz.boundary_year, riding, {', '.join(f'rz.{c} - pz.{c} AS {c}' for c in t.COORDS)} FROM rz JOIN pz USING (boundary_year)),
step AS (SELECT a.boundary_year, a.riding, {', '.join(f'b.{c} - a.{c} AS {c}' for c in t.COORDS)} FROM dev a JOIN nxt USING (boundary_year) JOIN dev b ON b.boundary_year = nxt.after_year AND b.riding = a.riding),
mid AS (SELECT boundary_year, {', '.join(f'avg({c}) AS m_{c}' for c in t.COORDS)} FROM step GROUP BY 1),
dep AS (SELECT boundary_year, riding, {', '.join(f'{c} - m_{c} AS {c}' for c in t.COORDS)} FROM step JOIN mid USING (boundary_year))"""


def _deviations(spark: SparkSession, folder: str) -> DataFrame:
    """Ridings' coordinates less their province's."""
    z = lambda df: comp.ilr(t.columns(t.PARTS))
    rid = t.ridings(spark, folder)
    rid = rid.select("boundary_year", "riding", *t.named(z(rid), t.COORDS))
    prov = t.ridings(spark, folder, "boundary_year")
    prov = prov.select("boundary_year", *t.named(z(prov), [f"p_{c}" for c in t.COORDS]))
    return rid.join(prov, "boundary_year").select("boundary_year", "riding", *[(F.col(c) - F.col(f"p_{c}")).alias(c) for c in t.COORDS])


def _departures(spark: SparkSession, folder: str) -> DataFrame:
    """Change of the deviation from one map to the next, centred per pair of maps."""
    dev = _deviations(spark, folder)
    after = dev.select(F.col("boundary_year").alias("after_year"), "riding", *[F.col(c).alias(f"b_{c}") for c in t.COORDS])
    step = _next_map(dev).join(after, ["after_year", "riding"]).select("boundary_year", "riding", *[(F.col(f"b_{c}") - F.col(c)).alias(c) for c in t.COORDS])
    mid = step.groupBy("boundary_year").agg(*[F.avg(c).alias(f"m_{c}") for c in t.COORDS])
    return step.join(mid, "boundary_year").select("boundary_year", "riding", *[(F.col(c) - F.col(f"m_{c}")).alias(c) for c in t.COORDS])


@query(f"WITH {_DEP} SELECT boundary_year, riding, {_rounded(t.COORDS)} FROM dep")
def departure_centred(spark: SparkSession, folder: str) -> DataFrame:
    return _departures(spark, folder).select("boundary_year", "riding", *t.named(t.columns(t.COORDS), t.COORDS, 6))


_PAIRED = f"{_DEP}, pr AS (SELECT a.riding, {', '.join(f'a.{c} AS a_{c}, b.{c} AS b_{c}' for c in t.COORDS)} FROM dep a JOIN nxt USING (boundary_year) JOIN dep b ON b.boundary_year = nxt.after_year AND b.riding = a.riding)"


@query(f"WITH {_PAIRED} " + " UNION ALL ".join(f"SELECT '{c}' AS coord, count(*) AS n, round(sum(a_{c} * b_{c}) / nullif(sum(a_{c} * a_{c}), 0), 6) AS rho, round(1 - sum((b_{c} - a_{c}) * (b_{c} - a_{c})) / nullif(sum(b_{c} * b_{c}), 0), 6) AS r2 FROM pr HAVING count(*) > 0" for c in t.COORDS))
def pooled_persistence(spark: SparkSession, folder: str) -> DataFrame:
    """Slope through the origin of a riding's departure on its previous one, and the fit against no change, per coordinate."""
    dep = _departures(spark, folder)
    after = dep.select(F.col("boundary_year").alias("after_year"), "riding", *[F.col(c).alias(f"b_{c}") for c in t.COORDS])
    pairs = _next_map(dep).join(after, ["after_year", "riding"])
    ends = F.explode(F.array(*[F.struct(F.lit(c).alias("coord"), F.col(c).alias("a"), F.col(f"b_{c}").alias("b")) for c in t.COORDS]))
    long = pairs.select(ends.alias("e")).select("e.*")
    a, b = F.col("a"), F.col("b")
    return long.groupBy("coord").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(a * b) / F.nullif(F.sum(a * a), F.lit(0.0)), 6).alias("rho"), F.round(1 - F.sum((b - a) * (b - a)) / F.nullif(F.sum(b * b), F.lit(0.0)), 6).alias("r2")
    )


@query(f"WITH {_DEP} SELECT boundary_year, riding, {', '.join(f'round(rz.{c} + greatest(-0.35, least(0.35, dep.{c})), 6) AS {c}' for c in t.COORDS)} FROM rz JOIN dep USING (boundary_year, riding)")
def clamp_shift(spark: SparkSession, folder: str) -> DataFrame:
    """Ridings moved by their clamped departure, checked in coordinates after the way back through shares."""
    dep = _departures(spark, folder).select("boundary_year", "riding", *[F.col(c).alias(f"d_{c}") for c in t.COORDS])
    joined = t.ridings(spark, folder).join(dep, ["boundary_year", "riding"])
    moved = joined.select("boundary_year", "riding", *t.named(comp.shifted(t.columns(t.PARTS), [F.col(f"d_{c}") for c in t.COORDS], MAX_SHIFT), t.PARTS))
    return moved.select("boundary_year", "riding", *t.named(comp.ilr(t.columns(t.PARTS)), t.COORDS, 6))


_BYDEV = f"""{_DEP}, {t.riding_sql('elec', 'boundary_year, riding, election_date')}, {_coord_sql('elec', 'boundary_year, riding, election_date', 'ez')},
last AS (SELECT * FROM ez QUALIFY row_number() OVER (PARTITION BY boundary_year, riding ORDER BY election_date DESC) = 1),
bdev AS (SELECT boundary_year, riding, {', '.join(f'last.{c} - rz.{c} AS {c}' for c in t.COORDS)} FROM last JOIN rz USING (boundary_year, riding))"""


@query(f"WITH {_BYDEV} SELECT coalesce(d.boundary_year, b.boundary_year) AS boundary_year, coalesce(d.riding, b.riding) AS riding, {', '.join(f'round(0.5 * coalesce(d.{c}, 0) + 0.5 * coalesce(b.{c}, 0), 6) AS {c}' for c in t.COORDS)} FROM dep d FULL JOIN bdev b ON d.boundary_year = b.boundary_year AND d.riding = b.riding")
def byelection_blend(spark: SparkSession, folder: str) -> DataFrame:
    """Half the departure between maps, half the last election's difference from the riding's record: a full outer blend."""
    elections = t.ridings(spark, folder, "boundary_year", "riding", "election_date")
    z = elections.select("boundary_year", "riding", "election_date", *t.named(comp.ilr(t.columns(t.PARTS)), t.COORDS))
    last = z.groupBy("boundary_year", "riding").agg(F.max(F.struct("election_date", *t.COORDS)).alias("e")).select("boundary_year", "riding", *[F.col(f"e.{c}").alias(f"e_{c}") for c in t.COORDS])
    rid = t.ridings(spark, folder)
    own = rid.select("boundary_year", "riding", *t.named(comp.ilr(t.columns(t.PARTS)), t.COORDS))
    bdev = last.join(own, ["boundary_year", "riding"]).select("boundary_year", "riding", *[(F.col(f"e_{c}") - F.col(c)).alias(f"b_{c}") for c in t.COORDS])
    blend = lambda c: F.round(BLEND * F.coalesce(F.col(c), F.lit(0.0)) + (1 - BLEND) * F.coalesce(F.col(f"b_{c}"), F.lit(0.0)), 6).alias(c)
    return _departures(spark, folder).join(bdev, ["boundary_year", "riding"], "full_outer").select("boundary_year", "riding", *[blend(c) for c in t.COORDS])


_WINS = f"""{t.RESULT_SQL}, w AS (SELECT boundary_year, riding, election_date, party, sum(votes) AS v, list_position([{', '.join(f"'{p}'" for p in t.PARTIES)}], party) AS ord FROM result GROUP BY ALL),
win AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY boundary_year, riding, election_date ORDER BY v DESC, ord) = 1)"""


def _wins(spark: SparkSession, folder: str) -> DataFrame:
    order = F.array_position(F.array(*[F.lit(p) for p in t.PARTIES]), F.col("party"))
    votes = t.results(spark, folder).groupBy("boundary_year", "riding", "election_date", "party").agg(F.sum("votes").alias("v"))
    return votes.groupBy("boundary_year", "riding", "election_date").agg(stats.first_argmax(F.col("party"), F.col("v"), order).alias("party"))


@query(f"WITH {_WINS} SELECT boundary_year, riding, election_date, party FROM win")
def first_argmax(spark: SparkSession, folder: str) -> DataFrame:
    return _wins(spark, folder)


@query(f"""WITH {_WINS}, c AS (SELECT *, CASE WHEN party IS NOT DISTINCT FROM lag(party) OVER o AND row_number() OVER o > 1 THEN 0 ELSE 1 END AS changed FROM win WINDOW o AS (PARTITION BY boundary_year, riding ORDER BY election_date)),
  i AS (SELECT *, sum(changed) OVER (PARTITION BY boundary_year, riding ORDER BY election_date) AS island FROM c)
  SELECT boundary_year, riding, election_date, party, CAST(island AS BIGINT) AS island, row_number() OVER (PARTITION BY boundary_year, riding, island ORDER BY election_date) AS streak FROM i""")
def streaks(spark: SparkSession, folder: str) -> DataFrame:
    return relational.islands(_wins(spark, folder), ["boundary_year", "riding"], "party", ["election_date"])


@query(f"""WITH {t.RESULT_SQL}, {t.riding_sql('e', 'boundary_year, election_date')}, l AS (SELECT boundary_year, election_date, {', '.join(f'{p} - lag({p}) OVER o AS {p}' for p in t.PARTS)} FROM e WINDOW o AS (PARTITION BY boundary_year ORDER BY election_date))
  SELECT boundary_year, election_date, {_rounded(t.PARTS)} FROM l WHERE alb IS NOT NULL""")
def lag_swing(spark: SparkSession, folder: str) -> DataFrame:
    before = Window.partitionBy("boundary_year").orderBy("election_date")
    e = t.ridings(spark, folder, "boundary_year", "election_date")
    moved = e.select("boundary_year", "election_date", *[(F.col(p) - F.lag(p).over(before)).alias(p) for p in t.PARTS]).where("alb IS NOT NULL")
    return moved.select("boundary_year", "election_date", *t.named(t.columns(t.PARTS), t.PARTS, 6))


@query(f"""WITH {_WINS}, {_REGION} SELECT boundary_year, coalesce(region, '?') AS region, party, count(*) AS wins, count(DISTINCT riding) AS ridings FROM win LEFT JOIN reg USING (boundary_year, riding) GROUP BY 1, 2, 3""")
def wins_by_region(spark: SparkSession, folder: str) -> DataFrame:
    w = _wins(spark, folder).join(_regions(spark, folder), ["boundary_year", "riding"], "left")
    return w.groupBy("boundary_year", F.coalesce("region", F.lit("?")).alias("region"), "party").agg(F.count(F.lit(1)).alias("wins"), F.countDistinct("riding").alias("ridings"))


@query("""WITH n AS (SELECT boundary_year, riding_code, min(riding_name) AS name FROM qc_riding_names GROUP BY 1, 2)
  SELECT b.row_id, coalesce(n.name, b.riding_code) AS riding_name FROM qc_byelections b LEFT JOIN n ON n.boundary_year = b.boundary_year AND n.riding_code = CASE WHEN regexp_full_match(trim(b.riding_code), '[0-9]+(\\.[0-9]*)?') THEN regexp_extract(trim(b.riding_code), '^[0-9]+') ELSE trim(b.riding_code) END""")
def code_to_name(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers to names on their map, with the value itself where none fits."""
    names = read_table(spark, folder, "qc_riding_names").groupBy("boundary_year", F.col("riding_code").alias("code")).agg(F.min("riding_name").alias("name"))
    b = read_table(spark, folder, "qc_byelections").withColumn("code", riding_code(F.col("riding_code")))
    return b.join(names, ["boundary_year", "code"], "left").select("row_id", F.coalesce("name", "riding_code").alias("riding_name"))


_K = "regexp_replace(strip_accents(lower({0})), '[^a-z0-9]', '', 'g')"


@query(f"""WITH i AS (SELECT {_K.format('riding_name')} AS riding, current_party AS party, max(scraped_at) AS seen, count(*) AS n FROM qc_incumbents WHERE trim(riding_name) <> '' GROUP BY 1, 2)
  SELECT l.row_id, l.party_code, l.leader_name, i.n AS incumbent_rows FROM qc_leaders l LEFT JOIN i ON i.riding = {_K.format('l.riding_name')} AND i.party = l.current_party""")
def leaders_join(spark: SparkSession, folder: str) -> DataFrame:
    """Leaders with the incumbents of their riding and party: a left join on two keys against pre-aggregated rows."""
    i = read_table(spark, folder, "qc_incumbents").where(~is_blank(F.col("riding_name"))).groupBy(name_key(F.col("riding_name")).alias("riding"), F.col("current_party").alias("party")).agg(F.count(F.lit(1)).alias("incumbent_rows"))
    leaders = read_table(spark, folder, "qc_leaders").withColumn("riding", name_key(F.col("riding_name"))).withColumn("party", F.col("current_party"))
    return leaders.join(i, ["riding", "party"], "left").select("row_id", "party_code", "leader_name", "incumbent_rows")


@query(f"""WITH {t.RESULT_SQL}, {_REGION}, k AS (SELECT boundary_year, riding, party, sum(votes) AS votes FROM result GROUP BY ALL),
  known AS (SELECT k.*, region FROM k JOIN reg USING (boundary_year, riding)), loose AS (SELECT boundary_year, party, sum(votes) AS loose FROM k ANTI JOIN reg USING (boundary_year, riding) GROUP BY 1, 2)
  SELECT boundary_year, riding, party, round(votes + coalesce(loose * votes / nullif(sum(votes) OVER (PARTITION BY boundary_year, party), 0), 0), 4) AS votes FROM known LEFT JOIN loose USING (boundary_year, party)""")
def prorata_alloc(spark: SparkSession, folder: str) -> DataFrame:
    """Votes of ridings that no list has, spread over the listed ones of the map in proportion."""
    k = t.results(spark, folder).groupBy("boundary_year", "riding", "party").agg(F.sum("votes").alias("votes"))
    regions = _regions(spark, folder)
    known, loose = k.join(regions.drop("region"), ["boundary_year", "riding"], "left_semi"), k.join(regions, ["boundary_year", "riding"], "left_anti")
    return relational.prorata(known, loose, ["boundary_year", "party"], "votes").withColumn("votes", F.round("votes", 4))


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS v, l_suppkey AS c FROM lineitem) SELECT a.c AS a, b.c AS b, count(*) AS n_shared FROM e a JOIN e b ON a.v = b.v AND a.c < b.c GROUP BY 1, 2 HAVING count(*) >= 2""")
def adjacency_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers adjacent by at least two shared orders; an order has at most a few lines."""
    return relational.shared_pairs(read_table(spark, folder, "lineitem"), "l_orderkey", "l_suppkey", 2)


@query(f"""WITH {t.POLL_SQL}, w AS (SELECT CAST(date_trunc('week', poll_date) AS DATE) AS week, count(*) AS n FROM poll WHERE poll_date IS NOT NULL GROUP BY 1)
  SELECT week, n, round(percent_rank() OVER (ORDER BY n), 6) AS rank, coalesce(week - lag(week) OVER (ORDER BY week), 0) AS gap, CAST(sum(greatest(gap0 - 7, 0)) OVER (ORDER BY week) AS BIGINT) AS shift FROM (SELECT *, coalesce(week - lag(week) OVER (ORDER BY week), 0) AS gap0 FROM w)""")
def gap_shift(spark: SparkSession, folder: str) -> DataFrame:
    """Percent ranks, gaps and their running excess over the weeks, which the calendar bounds."""
    weekly = t.polls(spark, folder).where("poll_date IS NOT NULL").groupBy(F.trunc("poll_date", "week").alias("week")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy("week")
    gaps = weekly.withColumn("rank", F.round(F.percent_rank().over(Window.orderBy("n")), 6)).withColumn("gap", F.coalesce(F.datediff("week", F.lag("week").over(order)), F.lit(0)).cast("long"))
    return gaps.withColumn("shift", F.sum(F.greatest(F.col("gap") - 7, F.lit(0))).over(order))


def mulberry_sql(seed: int, source: str, call: str, out: str) -> str:
    """CTEs that give u for each call of a stream."""
    w = 4294967295
    return f"""{out}0 AS (SELECT *, CAST(({seed} + CAST({call} AS HUGEINT) * 1831565813) % 4294967296 AS BIGINT) AS t FROM {source}),
{out}1 AS (SELECT *, CAST((CAST(xor(t, t >> 15) AS HUGEINT) * (t | 1)) % 4294967296 AS BIGINT) AS a FROM {out}0),
{out}2 AS (SELECT *, xor(a, (a + CAST((CAST(xor(a, a >> 7) AS HUGEINT) * (a | 61)) % 4294967296 AS BIGINT)) & {w}) AS b FROM {out}1),
{out} AS (SELECT *, xor(b, b >> 14) / 4294967296e0 AS u FROM {out}2)"""


@query(f"WITH src AS (SELECT event_id FROM events WHERE event_id IS NOT NULL), {mulberry_sql(1, 'src', 'event_id + 1', 'm')} SELECT event_id, round(u, 10) AS u FROM m")
def mulberry_stream(spark: SparkSession, folder: str) -> DataFrame:
    """One call per event, numbered by the event."""
    return read_table(spark, folder, "events").where("event_id IS NOT NULL").select("event_id", F.round(rng.uniform(1, F.col("event_id") + 1), 10).alias("u"))


@query(f"""WITH src AS (SELECT event_id, unnest([1, 2]) AS half FROM events WHERE event_id IS NOT NULL), {mulberry_sql(7, 'src', 'event_id * 2 + half', 'm')}
  SELECT event_id, round(sqrt(-2 * ln(CASE WHEN u1 = 0 THEN 1e-10 ELSE u1 END)) * cos(2 * pi() * u2), 6) AS z FROM (SELECT event_id, max(u) FILTER (half = 1) AS u1, max(u) FILTER (half = 2) AS u2 FROM m GROUP BY 1)""")
def box_muller(spark: SparkSession, folder: str) -> DataFrame:
    base = F.col("event_id") * 2
    return read_table(spark, folder, "events").where("event_id IS NOT NULL").select("event_id", F.round(rng.normal(rng.uniform(7, base + 1), rng.uniform(7, base + 2)), 6).alias("z"))


def _simulation(spark: SparkSession, folder: str) -> DataFrame:
    """Ridings of each map with order, regions and residual pools, simulated."""
    by_map = Window.partitionBy("boundary_year")
    rid = t.ridings(spark, folder).join(_regions(spark, folder), ["boundary_year", "riding"], "left")
    labels = rid.where("region IS NOT NULL").select("boundary_year", "region").distinct()
    labels = labels.withColumn("region_ord", F.row_number().over(by_map.orderBy("region")) - 1).withColumn("n_regions", F.count(F.lit(1)).over(by_map))
    counts = labels.groupBy("boundary_year").agg(F.max("n_regions").alias("n_regions"))
    rid = rid.join(labels.drop("n_regions"), ["boundary_year", "region"], "left").join(counts, "boundary_year", "left")
    rid = rid.withColumn("n_regions", F.coalesce("n_regions", F.lit(0))).withColumn("region_ord", F.coalesce("region_ord", F.lit(0)))
    rid = rid.withColumn("ord", F.row_number().over(by_map.orderBy("riding")) - 1).withColumn("n_ridings", F.count(F.lit(1)).over(by_map))
    pool = _departures(spark, folder).withColumn("idx", (F.row_number().over(by_map.orderBy("riding")) - 1).cast("long")).withColumn("n_residuals", F.count(F.lit(1)).over(by_map))
    pool = pool.select("boundary_year", "idx", "n_residuals", *[F.col(c).alias(f"r{i + 1}") for i, c in enumerate(t.COORDS)])
    return mc.simulate(rid, pool, t.PARTS, "boundary_year", N_DRAWS)


def _sim_sql() -> str:
    normal = lambda a, b: f"sqrt(-2 * ln(CASE WHEN {a} = 0 THEN 1e-10 ELSE {a} END)) * cos(2 * pi() * {b})"
    moved = [f"rz.{c} + 0.1 * s{j} + CASE WHEN i.region IS NULL THEN 0 ELSE 0.05 * g{j} END + coalesce(d.{c}, 0)" for j, c in enumerate(t.COORDS)]
    basis = comp.basis(6)
    expo = [" + ".join(f"({basis[c][j]!r}) * y{c}" for c in range(5)) for j in range(6)]
    joins = "".join(
        f" JOIN m s{j}a ON s{j}a.boundary_year = i.boundary_year AND s{j}a.call = i.base + {2 * j + 1} JOIN m s{j}b ON s{j}b.boundary_year = i.boundary_year AND s{j}b.call = i.base + {2 * j + 2}"
        for j in range(5)
    )
    return f"""WITH {_DEP}, {_REGION},
lab AS (SELECT boundary_year, region, row_number() OVER (PARTITION BY boundary_year ORDER BY region) - 1 AS region_ord, count(*) OVER (PARTITION BY boundary_year) AS n_regions FROM (SELECT DISTINCT boundary_year, region FROM rid JOIN reg USING (boundary_year, riding) WHERE region IS NOT NULL)),
nreg AS (SELECT boundary_year, max(n_regions) AS n_regions FROM lab GROUP BY 1),
inf AS (SELECT rid.boundary_year, riding, reg.region, coalesce(region_ord, 0) AS region_ord, coalesce(nreg.n_regions, 0) AS n_regions, row_number() OVER (PARTITION BY rid.boundary_year ORDER BY riding) - 1 AS ord, count(*) OVER (PARTITION BY rid.boundary_year) AS n_ridings
  FROM rid LEFT JOIN reg USING (boundary_year, riding) LEFT JOIN lab ON lab.boundary_year = rid.boundary_year AND lab.region = reg.region LEFT JOIN nreg ON nreg.boundary_year = rid.boundary_year),
i AS (SELECT *, draw * (10 + 10 * n_regions + n_ridings) AS base FROM inf, (SELECT unnest(range({N_DRAWS})) AS draw)),
src AS (SELECT DISTINCT boundary_year, unnest(range(base + 1, base + 11 + 10 * n_regions + n_ridings)) AS call FROM (SELECT DISTINCT boundary_year, base, n_regions, n_ridings FROM i)),
{mulberry_sql(1, 'src', 'call', 'm')},
pool AS (SELECT *, row_number() OVER (PARTITION BY boundary_year ORDER BY riding) - 1 AS idx, count(*) OVER (PARTITION BY boundary_year) AS n FROM dep),
shock AS (SELECT d.boundary_year, d.draw, {', '.join(f"max({normal('a.u', 'b.u')}) FILTER (j = {j}) AS s{j}" for j in range(5))} FROM (SELECT DISTINCT boundary_year, draw, base, unnest(range(5)) AS j FROM i) d
  JOIN m a ON a.boundary_year = d.boundary_year AND a.call = d.base + 2 * j + 1 JOIN m b ON b.boundary_year = d.boundary_year AND b.call = d.base + 2 * j + 2 GROUP BY 1, 2),
regs AS (SELECT d.boundary_year, d.draw, d.region_ord, {', '.join(f"max({normal('a.u', 'b.u')}) FILTER (j = {j}) AS g{j}" for j in range(5))} FROM (SELECT DISTINCT boundary_year, draw, base, region_ord, unnest(range(5)) AS j FROM i WHERE region IS NOT NULL) d
  JOIN m a ON a.boundary_year = d.boundary_year AND a.call = d.base + 10 + 10 * region_ord + 2 * j + 1 JOIN m b ON b.boundary_year = d.boundary_year AND b.call = d.base + 10 + 10 * region_ord + 2 * j + 2 GROUP BY 1, 2, 3),
pick AS (SELECT i.boundary_year, i.draw, i.riding, floor(m.u * p.n) AS idx FROM i JOIN m ON m.boundary_year = i.boundary_year AND m.call = i.base + 10 + 10 * i.n_regions + i.ord + 1 JOIN (SELECT boundary_year, max(n) AS n FROM pool GROUP BY 1) p ON p.boundary_year = i.boundary_year),
y AS (SELECT i.boundary_year, i.draw, i.riding, {', '.join(f'{e} AS y{j}' for j, e in enumerate(moved))} FROM i JOIN rz USING (boundary_year, riding) JOIN shock ON shock.boundary_year = i.boundary_year AND shock.draw = i.draw
  LEFT JOIN regs ON regs.boundary_year = i.boundary_year AND regs.draw = i.draw AND regs.region_ord = i.region_ord
  LEFT JOIN pick ON pick.boundary_year = i.boundary_year AND pick.draw = i.draw AND pick.riding = i.riding LEFT JOIN pool d ON d.boundary_year = i.boundary_year AND d.idx = pick.idx),
x AS (SELECT boundary_year, draw, riding, {', '.join(f'{e} AS {p}' for e, p in zip(expo, t.PARTS))} FROM y),
won AS (SELECT boundary_year, draw, riding, CASE {' '.join(f"WHEN {p} = greatest({', '.join(t.PARTS)}) THEN '{p.upper()}'" for p in t.PARTS)} END AS winner FROM x),
seats AS (SELECT boundary_year, draw, {', '.join(f"count(*) FILTER (winner = '{p.upper()}') AS {p}" for p in t.PARTS)} FROM won GROUP BY 1, 2)"""


@query(_sim_sql() + " SELECT * FROM seats")
def seat_sim_counts(spark: SparkSession, folder: str) -> DataFrame:
    return mc.seat_counts(_simulation(spark, folder), "boundary_year", t.PARTIES)


@query(_sim_sql() + f" SELECT boundary_year, riding, winner AS party, round(count(*) / {N_DRAWS}e0, 6) AS p FROM won GROUP BY 1, 2, 3")
def win_probs(spark: SparkSession, folder: str) -> DataFrame:
    return mc.win_probabilities(_simulation(spark, folder), "boundary_year", N_DRAWS).withColumn("p", F.round("p", 6))


_LONG = "long AS (" + " UNION ALL ".join(f"SELECT boundary_year, draw, '{p}' AS party, {p.lower()} AS seats FROM seats" for p in t.PARTIES) + ")"


@query(_sim_sql() + f", {_LONG}, h AS (SELECT boundary_year, party, seats, count(*) AS n FROM long GROUP BY 1, 2, 3) SELECT boundary_year, party, seats, n, round(n / sum(n) OVER w, 6) AS prob, round(n / max(n) OVER w, 6) AS height FROM h WINDOW w AS (PARTITION BY boundary_year, party)")
def seat_hist(spark: SparkSession, folder: str) -> DataFrame:
    return mc.seat_distribution(seat_sim_counts(spark, folder), "boundary_year", t.PARTIES).withColumns({"prob": F.round("prob", 6), "height": F.round("height", 6)})


@query(_sim_sql() + f", l1 AS (SELECT a.boundary_year, a.draw, sum({' + '.join(f'abs(a.{p} - b.{p})' for p in t.PARTS)}) AS distance FROM seats a JOIN seats b ON a.boundary_year = b.boundary_year GROUP BY 1, 2) SELECT boundary_year, seats.draw, {', '.join(t.PARTS)}, CAST(distance AS BIGINT) AS distance FROM seats JOIN l1 USING (boundary_year, draw) QUALIFY row_number() OVER (PARTITION BY boundary_year ORDER BY distance, draw) = 1")
def medoid_draw(spark: SparkSession, folder: str) -> DataFrame:
    return mc.medoid(seat_sim_counts(spark, folder), "boundary_year", t.PARTIES)


@query(_sim_sql() + f""", {_LONG}, rk AS (SELECT l.*, row_number() OVER (PARTITION BY boundary_year, draw ORDER BY seats DESC, list_position([{', '.join(f"'{p}'" for p in t.PARTIES)}], party)) AS k, list_position([{', '.join(f"'{p}'" for p in t.PARTIES)}], party) AS o, sum(seats) OVER (PARTITION BY boundary_year, draw) // 2 + 1 AS th FROM long l WHERE seats > 0),
  ld AS (SELECT * FROM rk WHERE k = 1), c AS (SELECT ld.boundary_year, ld.draw, ld.party AS leader, ld.seats >= ld.th AS maj, o2.party AS opposition, o2.seats AS os, ld.seats AS ls, ld.th,
    (SELECT arg_min(r.party, r.seats * 100 + r.o) FROM rk r WHERE r.boundary_year = ld.boundary_year AND r.draw = ld.draw AND r.k >= 3 AND r.seats >= ld.th - ld.seats) AS b FROM ld LEFT JOIN rk o2 ON o2.boundary_year = ld.boundary_year AND o2.draw = ld.draw AND o2.k = 2),
  d AS (SELECT boundary_year, draw, CASE WHEN maj THEN 'majority' ELSE 'minority' END AS type, leader, CASE WHEN NOT maj THEN b END AS balance, (NOT maj AND b IS NULL AND coalesce(ls + os >= th, false)) AS needs_opposition, opposition FROM c)
  SELECT boundary_year, type, leader, balance, needs_opposition, count(*) AS n, arg_min(coalesce(opposition, '-'), draw) AS opposition, round(count(*) / sum(count(*)) OVER (PARTITION BY boundary_year), 6) AS probability FROM d GROUP BY 1, 2, 3, 4, 5""")
def government_scenarios(spark: SparkSession, folder: str) -> DataFrame:
    s = mc.scenarios(seat_sim_counts(spark, folder), "boundary_year", t.PARTIES)
    return s.withColumn("probability", F.round("probability", 6)).withColumn("opposition", F.coalesce("opposition", F.lit("-")))


@query(_sim_sql() + f", v AS (SELECT * FROM prov) SELECT s.boundary_year, s.draw, round(sqrt(({' + '.join(f'(v.{p} - s.{p} / n) * (v.{p} - s.{p} / n)' for p in t.PARTS)}) / 2) * 100, 6) AS gallagher FROM (SELECT *, {' + '.join(t.PARTS)} AS n FROM seats) s JOIN v USING (boundary_year)")
def gallagher_index(spark: SparkSession, folder: str) -> DataFrame:
    prov = t.ridings(spark, folder, "boundary_year").select("boundary_year", *[F.col(p).alias(f"v_{p}") for p in t.PARTS])
    seats = seat_sim_counts(spark, folder).join(prov, "boundary_year")
    house = comp.total(t.columns(t.PARTS))
    index = mc.gallagher([F.col(f"v_{p}") for p in t.PARTS], [F.col(p) / house for p in t.PARTS]) * 100
    return seats.select("boundary_year", "draw", F.round(index, 6).alias("gallagher"))
