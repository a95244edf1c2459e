"""Catalogue: replaced slices, lookups with misses, constraints, joins by rule, documents and files, ranked and dated reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.functions import composition as comp
from tallyforge.functions import stats
from tallyforge.functions.text import fold, initials, is_blank, name_key
from tallyforge.operators import parsing, relational
from tallyforge.plans import elections as el
from tallyforge.plans import tables as t
from tallyforge.plans.problems import PARSE_SQL, VALID_SQL
from tallyforge.plans.registry import Catalogue
from tallyforge.session import new_folder, read_table
from tallyforge.sources import files

CATALOGUE = Catalogue()
query = CATALOGUE.query

_KEY = "regexp_replace(strip_accents(lower({0})), '[^a-z0-9]', '', 'g')"
_OLD, _NEW = "load_id % 100 <= 4", "load_id % 100 > 4"
_ORDER = "list_position([" + ", ".join(f"'{p}'" for p in t.PARTIES) + "], {0})"


# Writing: slices and lookups.


@query(f"""SELECT poll_id, feed, region_code, load_id FROM polls o WHERE {_OLD} AND NOT EXISTS (SELECT 1 FROM polls n WHERE {_NEW} AND n.region_code IS NOT DISTINCT FROM o.region_code AND n.feed IS NOT DISTINCT FROM o.feed)
  UNION ALL SELECT poll_id, feed, region_code, load_id FROM polls WHERE {_NEW}""")
def slice_replace(spark: SparkSession, folder: str) -> DataFrame:
    """Later loads take the place of all earlier ones of their feed and region; other slices stay."""
    p = read_table(spark, folder, "polls").select("poll_id", "feed", "region_code", "load_id")
    return relational.replace_slice(p.where(_OLD), p.where(_NEW), ["feed", "region_code"])


_FACTS = PARSE_SQL + f""", fact AS (SELECT line_id, {_KEY.format("trim(g[2])")} AS firm_key, day AS poll_date FROM c WHERE {VALID_SQL}),
  known AS (SELECT {_KEY.format('firm')} AS firm_key, poll_date, min(poll_id) AS poll_id, count(*) AS n_polls FROM poll GROUP BY 1, 2)"""


def _facts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    facts = parsing.strict_load(read_table(spark, folder, "poll_rows_raw")).select("line_id", name_key(F.col("firm")).alias("firm_key"), "poll_date")
    known = t.polls(spark, folder).groupBy(name_key(F.col("firm")).alias("firm_key"), "poll_date").agg(F.min("poll_id").alias("poll_id"), F.count(F.lit(1)).alias("n_polls"))
    return facts, known


@query(f"{_FACTS.replace('WITH', f'WITH {t.POLL_SQL}, ', 1)} SELECT line_id, poll_id, coalesce(n_polls, 0) AS n_polls FROM fact LEFT JOIN known USING (firm_key, poll_date)")
def fact_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Typed records with the poll of their firm and day, if there is one: a left join on two keys against one row per key."""
    facts, known = _facts(spark, folder)
    return facts.join(known, ["firm_key", "poll_date"], "left").select("line_id", "poll_id", F.coalesce("n_polls", F.lit(0)).alias("n_polls"))


@query(f"{_FACTS.replace('WITH', f'WITH {t.POLL_SQL}, ', 1)} SELECT firm_key, count(*) AS n_missed, min(poll_date) AS first_day FROM fact ANTI JOIN known USING (firm_key, poll_date) GROUP BY 1")
def fact_misses(spark: SparkSession, folder: str) -> DataFrame:
    """Records whose poll is not known, per firm."""
    facts, known = _facts(spark, folder)
    missed = facts.join(known, ["firm_key", "poll_date"], "left_anti")
    return missed.groupBy("firm_key").agg(F.count(F.lit(1)).alias("n_missed"), F.min("poll_date").alias("first_day"))


@query(f"{PARSE_SQL} SELECT title, count(*) AS n_rows, count(*) FILTER ({VALID_SQL}) AS n_loaded, round(count(*) FILTER ({VALID_SQL}) / count(*), 6) AS rate FROM c GROUP BY title")
def acceptance_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Share of the records of each page that the strict load takes."""
    raw = read_table(spark, folder, "poll_rows_raw")
    taken = parsing.strict_load(raw).groupBy("title").agg(F.count(F.lit(1)).alias("n_loaded"))
    both = raw.groupBy("title").agg(F.count(F.lit(1)).alias("n_rows")).alias("a").join(taken.alias("b"), F.col("a.title").eqNullSafe(F.col("b.title")), "left")
    n = F.coalesce("b.n_loaded", F.lit(0))
    return both.select("a.title", "n_rows", n.alias("n_loaded"), F.round(n / F.col("n_rows"), 6).alias("rate"))


_UNIQUE = {"qc_byelections": ["row_id"], "qc_leaders": ["row_id"], "qc_incumbents": ["row_id"], "poll_rows_raw": ["line_id"], "polls": ["poll_id"], "poll_shares": ["poll_id", "party_code"], "page_snapshots": ["title", "revid"], "qc_riding_names": ["boundary_year", "riding_code"]}
_REFERENCES = {("poll_shares", "polls"): ["poll_id"], ("snapshot_shares", "polls"): ["poll_id"], ("snapshot_shares", "page_snapshots"): ["title", "revid"]}
_REQUIRED = {"polls": ["poll_date", "firm", "sample_size"], "poll_shares": ["pct_reported"], "qc_byelections": ["riding_code", "votes"]}


@query(" UNION ALL ".join(
    [f"SELECT '{n}' AS table_name, 'unique {', '.join(k)}' AS rule, CAST(count(*) - count(DISTINCT ({', '.join(k)},)) AS BIGINT) AS n_broken FROM {n}" for n, k in _UNIQUE.items()]
    + [f"SELECT '{a}', '{', '.join(k)} in {b}', count(*) FROM {a} x WHERE NOT EXISTS (SELECT 1 FROM {b} y WHERE {' AND '.join(f'x.{c} = y.{c}' for c in k)})" for (a, b), k in _REFERENCES.items()]
    + [f"SELECT '{n}', '{c} is there', count(*) - count({c}) FROM {n}" for n, k in _REQUIRED.items() for c in k]
))
def table_constraints(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that break the keys, references and required columns that the tables are meant to have: they come dirty, so breaches are counted, not refused."""
    read = lambda n: read_table(spark, folder, n)
    found = [relational.repeated(read(n), k).select(F.lit(n).alias("table_name"), F.lit(f"unique {', '.join(k)}").alias("rule"), "n_broken") for n, k in _UNIQUE.items()]
    found += [relational.dangling(read(a), read(b), k).select(F.lit(a).alias("table_name"), F.lit(f"{', '.join(k)} in {b}").alias("rule"), "n_broken") for (a, b), k in _REFERENCES.items()]
    for n, k in _REQUIRED.items():
        counts = read(n).agg(F.map_from_arrays(F.array(*[F.lit(f"{c} is there") for c in k]), F.array(*[F.count_if(F.col(c).isNull()) for c in k])).alias("m"))
        found.append(counts.select(F.lit(n).alias("table_name"), F.explode("m").alias("rule", "n_broken")))
    whole = found[0]
    for other in found[1:]:
        whole = whole.unionByName(other)
    return whole


# Joins by rule.

_SEEN = f"""seat AS (SELECT {_KEY.format('riding_name')} AS riding, arg_max({_KEY.format("coalesce(member_name, '')")}, (scraped_at, row_id)) AS member, arg_max(coalesce(current_party, ''), (scraped_at, row_id)) AS held_by
    FROM qc_incumbents WHERE {_KEY.format("coalesce(riding_name, '')")} <> '' AND scraped_at IS NOT NULL GROUP BY 1),
  ahead AS (SELECT riding, arg_max(party, (election_date, boundary_year)) AS won_by FROM win GROUP BY riding)"""


@query(f"""WITH {el._WINS}, {_SEEN}, l AS (SELECT *, coalesce({_KEY.format('riding_name')}, '') AS riding, coalesce({_KEY.format('leader_name')}, '') AS leader FROM qc_leaders)
  SELECT row_id, party_code, CASE WHEN l.riding = '' THEN 'no riding' WHEN seat.member = l.leader AND l.leader <> '' THEN 'own seat' WHEN seat.held_by = l.party_code THEN 'party holds'
    WHEN ahead.won_by = l.party_code THEN 'party won last' WHEN seat.riding IS NULL AND ahead.riding IS NULL THEN 'unknown' ELSE 'to be gained' END AS standing
  FROM l LEFT JOIN seat ON seat.riding = l.riding LEFT JOIN ahead ON ahead.riding = l.riding""")
def leader_standing(spark: SparkSession, folder: str) -> DataFrame:
    """How each leader stands in the riding they run in: the last known member, that member's party, then the last winner decide, in this order."""
    key = lambda c: F.coalesce(name_key(F.col(c)), F.lit(""))
    last = lambda c: F.max_by(c, F.struct("scraped_at", "row_id"))
    seen = read_table(spark, folder, "qc_incumbents").withColumn("riding", key("riding_name")).where("riding <> '' AND scraped_at IS NOT NULL")
    seat = seen.groupBy("riding").agg(last(key("member_name")).alias("member"), last(F.coalesce("current_party", F.lit(""))).alias("held_by"))
    ahead = el._wins(spark, folder).groupBy("riding").agg(F.max_by("party", F.struct("election_date", "boundary_year")).alias("won_by"))
    leaders = read_table(spark, folder, "qc_leaders").select("row_id", "party_code", key("riding_name").alias("riding"), key("leader_name").alias("leader"))
    both = leaders.join(seat, "riding", "left").join(ahead, "riding", "left")
    standing = (
        F.when(F.col("riding") == "", "no riding").when((F.col("member") == F.col("leader")) & (F.col("leader") != ""), "own seat").when(F.col("held_by") == F.col("party_code"), "party holds")
        .when(F.col("won_by") == F.col("party_code"), "party won last").when(F.col("member").isNull() & F.col("won_by").isNull(), "unknown").otherwise("to be gained")
    )
    return both.select("row_id", "party_code", standing.alias("standing"))


@query(f"""WITH k AS (SELECT boundary_year, riding_code, {_KEY.format('riding_name')} AS riding FROM qc_riding_names WHERE {_KEY.format('riding_name')} <> ''),
  direct AS (SELECT riding, min(riding_code) AS code FROM k WHERE boundary_year = '2026' GROUP BY 1),
  renamed AS (SELECT o.riding, min(o.riding_code) AS code FROM k o JOIN k n ON n.boundary_year = '2026' AND n.riding_code = o.riding_code WHERE o.boundary_year <> '2026' GROUP BY 1)
  SELECT row_id, coalesce(d.code, r.code) AS code, CASE WHEN d.code IS NOT NULL THEN 'name' WHEN r.code IS NOT NULL THEN 'former name' ELSE 'none' END AS by
  FROM qc_byelections b LEFT JOIN direct d ON d.riding = {_KEY.format('b.riding_code')} LEFT JOIN renamed r ON r.riding = {_KEY.format('b.riding_code')}""")
def name_to_code(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers on the newest map by name, else by a former name of the same number."""
    k = read_table(spark, folder, "qc_riding_names").select("boundary_year", "riding_code", name_key(F.col("riding_name")).alias("riding")).where("riding <> ''")
    now = k.where("boundary_year = '2026'")
    direct = now.groupBy("riding").agg(F.min("riding_code").alias("direct"))
    former = k.where("boundary_year <> '2026'").join(now.select("riding_code").distinct(), "riding_code", "left_semi").groupBy("riding").agg(F.min("riding_code").alias("former"))
    b = read_table(spark, folder, "qc_byelections").select("row_id", name_key(F.col("riding_code")).alias("riding"))
    by = F.when(F.col("direct").isNotNull(), "name").when(F.col("former").isNotNull(), "former name").otherwise("none")
    return b.join(direct, "riding", "left").join(former, "riding", "left").select("row_id", F.coalesce("direct", "former").alias("code"), by.alias("by"))


@query(f"""WITH {el._DEP} SELECT rz.boundary_year, rz.riding, dep.riding IS NOT NULL AS moved, {', '.join(f'round(rz.{c} + coalesce(greatest(-0.35, least(0.35, dep.{c})), 0), 6) + 0e0 AS {c}' for c in t.COORDS)} FROM rz LEFT JOIN dep USING (boundary_year, riding)""")
def effects_applied(spark: SparkSession, folder: str) -> DataFrame:
    """Every riding's coordinates, moved by its clamped departure where it has one."""
    dep = el._departures(spark, folder).select("boundary_year", "riding", *[F.col(c).alias(f"d_{c}") for c in t.COORDS], F.lit(True).alias("moved"))
    own = t.ridings(spark, folder)
    own = own.select("boundary_year", "riding", *t.named(comp.ilr(t.columns(t.PARTS)), t.COORDS)).join(dep, ["boundary_year", "riding"], "left")
    shift = lambda c: F.coalesce(F.greatest(F.lit(-el.MAX_SHIFT), F.least(F.lit(el.MAX_SHIFT), F.col(f"d_{c}"))), F.lit(0.0))
    return own.select("boundary_year", "riding", F.coalesce("moved", F.lit(False)).alias("moved"), *t.named([F.col(c) + shift(c) for c in t.COORDS], t.COORDS, 6))


_REGIONS = ["National", "MTL", "QC", "REG"]


@query(f"""WITH {t.POLL_SQL}, r AS (SELECT firm, date_trunc('month', poll_date) AS month, region_code, count(*) AS n FROM poll WHERE firm IS NOT NULL AND poll_date IS NOT NULL GROUP BY 1, 2, 3)
  SELECT a.firm, CAST(a.month AS DATE) AS month, a.n AS national, b.n AS mtl, c.n AS qc, d.n AS reg FROM r a JOIN r b USING (firm, month) JOIN r c USING (firm, month) JOIN r d USING (firm, month)
  WHERE a.region_code = 'National' AND b.region_code = 'MTL' AND c.region_code = 'QC' AND d.region_code = 'REG'""")
def complete_regions(spark: SparkSession, folder: str) -> DataFrame:
    """Firms' months with polls of the whole and of all three regions: a complete match of four sets as one aggregate."""
    p = t.polls(spark, folder).where("firm IS NOT NULL AND poll_date IS NOT NULL").groupBy("firm", F.trunc("poll_date", "month").alias("month"))
    counts = p.agg(*[F.count_if(F.col("region_code") == r).alias(r.lower()) for r in _REGIONS])
    return counts.where(" AND ".join(f"{r.lower()} > 0" for r in _REGIONS))


@query(f"""WITH {el._DEP}, {el._REGION} SELECT dev.boundary_year, region, count(*) AS n, {', '.join(f'round(avg({c}), 6) + 0e0 AS {c}' for c in t.COORDS)} FROM dev JOIN reg USING (boundary_year, riding) WHERE region IS NOT NULL GROUP BY 1, 2""")
def region_departures(spark: SparkSession, folder: str) -> DataFrame:
    """Mean of the ridings' deviations in each region; ridings without a region take no part."""
    dev = el._deviations(spark, folder).join(el._regions(spark, folder).where("region IS NOT NULL"), ["boundary_year", "riding"])
    return dev.groupBy("boundary_year", "region").agg(F.count(F.lit(1)).alias("n"), *t.named([F.avg(c) for c in t.COORDS], t.COORDS, 6))


_LONG_RUN = f"""{t.RESULT_SQL}, {el._REGION}, {el._NEXT}, placed AS (SELECT boundary_year, region, party, votes FROM result JOIN reg USING (boundary_year, riding)),
  zone_sum AS (SELECT boundary_year, region, sum(votes) AS n_votes, {', '.join(f"sum(votes) FILTER (party = '{p}') AS {p.lower()}" for p in t.PARTIES)} FROM placed GROUP BY 1, 2 HAVING sum(votes) > 0),
  zone AS ({t.replaced_sql('boundary_year, region', 'zone_sum')}), z AS (SELECT boundary_year, region, {', '.join(f'{e} AS {c}' for e, c in zip(t.ilr_sql(), t.COORDS))} FROM zone),
  step AS (SELECT a.boundary_year, a.region, {', '.join(f'b.{c} - a.{c} AS {c}' for c in t.COORDS)} FROM z a JOIN nxt USING (boundary_year) JOIN z b ON b.boundary_year = nxt.after_year AND b.region = a.region),
  pr AS (SELECT a.region, {', '.join(f'a.{c} AS a_{c}, b.{c} AS b_{c}' for c in t.COORDS)} FROM step a JOIN nxt USING (boundary_year) JOIN step b ON b.boundary_year = nxt.after_year AND b.region = a.region)"""


@query(f"WITH {_LONG_RUN} " + " UNION ALL ".join(f"SELECT '{c}' AS coord, count(*) AS n, round(sum(a_{c} * b_{c}) / nullif(sum(a_{c} * a_{c}), 0), 6) AS rho, round(1 - sum((b_{c} - a_{c}) * (b_{c} - a_{c})) / nullif(sum(b_{c} * b_{c}), 0), 6) AS r2 FROM pr HAVING count(*) > 0" for c in t.COORDS))
def region_persistence(spark: SparkSession, folder: str) -> DataFrame:
    """Slope through the origin of a region's change from map to map on the change before, and its fit: three maps meet by key."""
    votes = t.results(spark, folder).join(el._regions(spark, folder), ["boundary_year", "riding"])
    sums = votes.groupBy("boundary_year", "region").agg(*[F.sum(F.when(F.col("party") == p, F.col("votes"))).alias(p.lower()) for p in t.PARTIES], F.sum("votes").alias("n")).where("n > 0 AND region IS NOT NULL")
    parts = sums.select("boundary_year", "region", *t.named(comp.zero_replaced(t.columns(t.PARTS)), t.PARTS))
    z = parts.select("boundary_year", "region", *t.named(comp.ilr(t.columns(t.PARTS)), t.COORDS))
    follow = lambda df: el._next_map(df).join(df.select(F.col("boundary_year").alias("after_year"), "region", *[F.col(c).alias(f"b_{c}") for c in t.COORDS]), ["after_year", "region"])
    step = follow(z).select("boundary_year", "region", *[(F.col(f"b_{c}") - F.col(c)).alias(c) for c in t.COORDS])
    ends = F.explode(F.array(*[F.struct(F.lit(c).alias("coord"), F.col(c).alias("a"), F.col(f"b_{c}").alias("b")) for c in t.COORDS]))
    a, b = F.col("a"), F.col("b")
    return follow(step).select(ends.alias("e")).select("e.*").groupBy("coord").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(a * b) / F.nullif(F.sum(a * a), F.lit(0.0)), 6).alias("rho"), F.round(1 - F.sum((b - a) * (b - a)) / F.nullif(F.sum(b * b), F.lit(0.0)), 6).alias("r2")
    )


# Documents and files.

_CANDIDATES = "array<struct<party:string,votes:double>>"


@query(f"""WITH {t.RESULT_SQL}, v AS (SELECT boundary_year, election_date, riding, party, sum(votes) AS votes FROM result GROUP BY ALL)
  SELECT *, votes = max(votes) OVER (PARTITION BY boundary_year, election_date, riding) AS elected FROM v""")
def results_flat(spark: SparkSession, folder: str) -> DataFrame:
    """Results as nested JSON documents, one per riding and election, laid flat again: all that share the most votes are flagged."""
    keys = ["boundary_year", "election_date", "riding"]
    votes = t.results(spark, folder).groupBy(*keys, "party").agg(F.sum("votes").alias("votes"))
    documents = votes.groupBy(*keys).agg(F.to_json(F.collect_list(F.struct("party", "votes"))).alias("candidates"))  # as long as there are parties
    parsed = documents.select(*keys, F.from_json("candidates", _CANDIDATES).alias("c")).withColumn("most", F.array_max(F.transform("c", lambda x: x["votes"])))
    return parsed.select(*keys, "most", F.explode("c").alias("c")).select(*keys, "c.party", "c.votes", (F.col("c.votes") == F.col("most")).alias("elected"))


@query(f"WITH {t.RESULT_SQL} SELECT boundary_year, election_date, riding, party, votes FROM result WHERE boundary_year IS NOT NULL")
def csv_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Results written as CSV shards, one folder per map, and read back under a declared schema with the map taken from the path."""
    path = new_folder(spark)
    r = t.results(spark, folder).where("boundary_year IS NOT NULL")
    r.select("boundary_year", "election_date", "riding", "party", "votes").write.partitionBy("boundary_year").option("header", True).csv(path)
    return files.read_csv_shards(spark, f"{path}/*/*.csv", "election_date string, riding string, party string, votes double", "boundary_year", r"boundary_year=([^/]+)/")


@query(f"WITH {t.POLL_SQL} SELECT poll_id, firm, poll_date, sample_size FROM poll")
def json_records(spark: SparkSession, folder: str) -> DataFrame:
    """Polls written as JSON records and read back under a declared schema; a missing optional file adds no rows."""
    path = new_folder(spark)
    files.write_records(t.polls(spark, folder).select("poll_id", "firm", "poll_date", "sample_size"), path)
    schema = "poll_id string, firm string, poll_date date, sample_size int"
    return files.read_json_records(spark, path, schema).unionByName(files.read_json_records(spark, path + "-none", schema, optional=True))


@query(f"""WITH {t.RESULT_SQL}, {t.riding_sql('prov', 'boundary_year')} SELECT 'shares' AS section, boundary_year AS key, round(alb, 6) AS value FROM prov
  UNION ALL SELECT 'votes', boundary_year, sum(votes) FROM result GROUP BY 2""")
def document_sections(spark: SparkSession, folder: str) -> DataFrame:
    """A document of two sections, written and read again."""
    path = new_folder(spark)
    shares = t.ridings(spark, folder, "boundary_year").select(F.col("boundary_year").alias("key"), F.round("alb", 6).alias("value"))
    votes = t.results(spark, folder).groupBy(F.col("boundary_year").alias("key")).agg(F.sum("votes").alias("value"))
    files.write_document({"shares": shares, "votes": votes}, path)
    return files.read_document(spark, path, "key string, value double")


@query(f"""WITH {t.WIDE_SQL}, g AS (SELECT poll_id, alb + lpn + mvt AS s1, prn + ucd AS s2, alb, lpn, prn FROM wide)
  SELECT poll_id, round(CASE WHEN s1 > 0 THEN alb / s1 END, 9) AS left_1, round(CASE WHEN s1 > 0 THEN lpn / s1 END, 9) AS left_2, round(CASE WHEN s2 > 0 THEN prn / s2 END, 9) AS right_1, coalesce(s1 > 0 AND s2 > 0, false) AS usable FROM g""")
def array_closing(spark: SparkSession, folder: str) -> DataFrame:
    """Two groups of parts as closed arrays, null where a part is missing or the group is empty; a row is usable if both are there."""
    closed = lambda names: comp.closed_array([F.col(n) for n in names])
    w = t.wide(spark, folder).select("poll_id", closed(["alb", "lpn", "mvt"]).alias("l"), closed(["prn", "ucd"]).alias("r"))
    return w.select("poll_id", F.round(F.get("l", F.lit(0)), 9).alias("left_1"), F.round(F.get("l", F.lit(1)), 9).alias("left_2"), F.round(F.get("r", F.lit(0)), 9).alias("right_1"), (F.col("l").isNotNull() & F.col("r").isNotNull()).alias("usable"))


# Names.

_GROUPS = ["etudes", "mesures", "data"]


@query("SELECT firm, strip_accents(lower(firm)) SIMILAR TO '.*(" + "|".join(_GROUPS) + ").*' AS rejected, count(*) AS n FROM polls WHERE firm IS NOT NULL GROUP BY ALL")
def subgroup_rejection(spark: SparkSession, folder: str) -> DataFrame:
    """Firms whose name, without accents, holds one of a list of words."""
    counts = read_table(spark, folder, "polls").where("firm IS NOT NULL").groupBy("firm").agg(F.count(F.lit(1)).alias("n"))
    folded = fold(F.col("firm"))
    return counts.select("firm", F.exists(F.array(*[F.lit(g) for g in _GROUPS]), lambda g: F.contains(folded, g)).alias("rejected"), "n")


@query("""SELECT DISTINCT boundary_year, riding_code, riding_name, array_to_string(list_transform(list_filter(string_split_regex(strip_accents(lower(riding_name)), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: upper(w[1])), '') AS initials
  FROM qc_riding_names WHERE riding_name IS NOT NULL""")
def riding_initials(spark: SparkSession, folder: str) -> DataFrame:
    """Short names of ridings from the first letters of their words."""
    names = read_table(spark, folder, "qc_riding_names").where("riding_name IS NOT NULL").select("boundary_year", "riding_code", "riding_name").distinct()
    return names.withColumn("initials", initials(F.col("riding_name")))


@query("SELECT party_code, CAST(row_number() OVER (ORDER BY party_code = 'AUTRES', party_code) AS INTEGER) AS place FROM (SELECT DISTINCT party_code FROM poll_shares WHERE party_code IS NOT NULL)")
def party_order(spark: SparkSession, folder: str) -> DataFrame:
    """Parties by name with the residual one last: a rank over the few distinct codes."""
    codes = read_table(spark, folder, "poll_shares").where("party_code IS NOT NULL").select("party_code").distinct()
    return codes.withColumn("place", F.row_number().over(Window.orderBy(F.col("party_code") == "AUTRES", "party_code")))


# Ranked and dated reports.


@query(f"""WITH {t.RESULT_SQL}, v AS (SELECT boundary_year, riding, party, sum(votes) AS votes FROM result GROUP BY ALL), s AS (SELECT *, votes / nullif(sum(votes) OVER (PARTITION BY boundary_year, riding), 0) AS share FROM v)
  SELECT boundary_year, riding, party, round(share, 6) AS share, CAST(row_number() OVER (PARTITION BY boundary_year, riding ORDER BY share DESC, {_ORDER.format('party')}) AS INTEGER) AS place FROM s WHERE share >= 0.01""")
def riding_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """Parties of each riding by share, those below one in a hundred left out."""
    v = t.results(spark, folder).groupBy("boundary_year", "riding", "party").agg(F.sum("votes").alias("votes"))
    s = v.withColumn("share", relational.share_of_group(F.col("votes"), "boundary_year", "riding")).where("share >= 0.01")
    order = F.array_position(F.array(*[F.lit(p) for p in t.PARTIES]), F.col("party"))
    rank = F.row_number().over(Window.partitionBy("boundary_year", "riding").orderBy(F.col("share").desc(), order))
    return s.select("boundary_year", "riding", "party", F.round("share", 6).alias("share"), rank.alias("place"))


@query(f"""WITH {el._WINS}, v AS (SELECT boundary_year, party, sum(votes) / nullif(sum(sum(votes)) OVER (PARTITION BY boundary_year), 0) AS votes FROM result GROUP BY 1, 2),
  s AS (SELECT boundary_year, party, count(*) / sum(count(*)) OVER (PARTITION BY boundary_year) AS seats FROM win GROUP BY 1, 2)
  SELECT boundary_year, party, round(coalesce(seats, 0), 6) AS seats, round(coalesce(votes, 0), 6) AS votes, round(coalesce(seats, 0) - coalesce(votes, 0), 6) AS gap
  FROM v FULL JOIN s USING (boundary_year, party) WHERE abs(coalesce(seats, 0) - coalesce(votes, 0)) > 0.005""")
def disproportion(spark: SparkSession, folder: str) -> DataFrame:
    """Parties whose share of the seats differs from that of the votes by more than half a per cent."""
    v = t.results(spark, folder).groupBy("boundary_year", "party").agg(F.sum("votes").alias("v")).withColumn("votes", relational.share_of_group(F.col("v"), "boundary_year"))
    s = el._wins(spark, folder).groupBy("boundary_year", "party").agg(F.count(F.lit(1)).cast("double").alias("s")).withColumn("seats", relational.share_of_group(F.col("s"), "boundary_year"))
    both = v.join(s, ["boundary_year", "party"], "full_outer").select("boundary_year", "party", F.coalesce("seats", F.lit(0.0)).alias("seats"), F.coalesce("votes", F.lit(0.0)).alias("votes"))
    gap = F.col("seats") - F.col("votes")
    return both.where(F.abs(gap) > 0.005).select("boundary_year", "party", F.round("seats", 6).alias("seats"), F.round("votes", 6).alias("votes"), F.round(gap, 6).alias("gap"))


@query(f"""WITH {t.CELL_SQL}, r AS (SELECT poll_id, party_code, row_number() OVER (PARTITION BY poll_id ORDER BY x DESC, {_ORDER.format('party_code')}) AS k FROM cell WHERE {_ORDER.format('party_code')} > 0)
  SELECT a.party_code AS leader, b.party_code AS runner_up, count(*) AS n FROM r a JOIN r b ON a.poll_id = b.poll_id AND a.k = 1 AND b.k = 2 GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 6""")
def top_configurations(spark: SparkSession, folder: str) -> DataFrame:
    """The six most frequent pairs of leader and runner-up: the limit is the feature."""
    from tallyforge.plans.surveys import runner_up_margin

    pairs = runner_up_margin(spark, folder).where("runner_up IS NOT NULL").groupBy("leader", "runner_up").agg(F.count(F.lit(1)).alias("n"))
    return pairs.orderBy(F.col("n").desc(), "leader", "runner_up").limit(6)


_NATIONAL = "SELECT poll_id, poll_date FROM poll WHERE region_code = 'National' AND poll_date IS NOT NULL"


@query(f"""WITH {t.POLL_SQL}, p AS ({_NATIONAL}), b AS (SELECT min(poll_date) AS lo, max(poll_date) AS hi FROM p),
  g AS (SELECT DISTINCT CAST(d AS DATE) AS day FROM b, unnest(list_append(generate_series(lo, hi, INTERVAL 14 DAY), hi)) AS u(d))
  SELECT g.day, count(p.poll_id) AS n_polls FROM g LEFT JOIN p ON p.poll_date <= g.day AND p.poll_date > g.day - 14 AND p.poll_date > coalesce((SELECT max(o.day) FROM g o WHERE o.day < g.day), DATE '0001-01-01') GROUP BY 1""")
def fortnight_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Days every two weeks from the first poll on, and the last day as the end point, with the polls since the grid day before."""
    p = t.polls(spark, folder).where("region_code = 'National' AND poll_date IS NOT NULL").groupBy("poll_date").agg(F.count(F.lit(1)).alias("n"))
    ends = p.agg(F.min("poll_date").alias("lo"), F.max("poll_date").alias("hi"))
    lo, hi = (ends.select(c).scalar() for c in ("lo", "hi"))
    slot = F.least(hi, F.date_add(lo, (F.ceil(F.datediff("poll_date", lo) / 14) * 14).cast("int")))
    filled = p.groupBy(slot.alias("day")).agg(F.sum("n").alias("n_polls"))
    grid = ends.where("lo IS NOT NULL").select(F.explode(F.array_distinct(F.concat(F.expr("sequence(lo, hi, INTERVAL 14 DAYS)"), F.array("hi")))).alias("day"))
    return grid.join(filled, "day", "left").select("day", F.coalesce("n_polls", F.lit(0)).alias("n_polls"))


_VOTES = ["2014-04-07", "2018-10-01", "2022-10-03"]  # fixed values: days of the elections


@query(f"WITH {t.POLL_SQL} SELECT poll_id, poll_date, CASE {' '.join(f"WHEN poll_date <= DATE '{e}' THEN DATE '{e}' - poll_date" for e in _VOTES)} END AS days_left FROM poll WHERE poll_date IS NOT NULL")
def days_to_election(spark: SparkSession, folder: str) -> DataFrame:
    """Days from each poll to the next election, null after the last."""
    p = t.polls(spark, folder).where("poll_date IS NOT NULL")
    left = F.coalesce(*[F.when(F.col("poll_date") <= F.lit(e).cast("date"), F.datediff(F.lit(e).cast("date"), F.col("poll_date"))) for e in _VOTES])
    return p.select("poll_id", "poll_date", left.cast("long").alias("days_left"))


@query(f"WITH {t.POLL_SQL}, p AS ({_NATIONAL}) " + " UNION ALL ".join(
    f"SELECT DATE '{e}' AS election, CAST({k} AS INTEGER) AS months, CAST(DATE '{e}' - INTERVAL {k} MONTH AS DATE) AS cutoff, count(*) FILTER (poll_date <= DATE '{e}' - INTERVAL {k} MONTH) AS n_polls FROM p" for e in _VOTES for k in range(1, 7)
))
def month_cutoffs(spark: SparkSession, folder: str) -> DataFrame:
    """Polls known at the end of each of the six months before an election: one aggregate over polls per day, with a counter for each cut-off."""
    p = t.polls(spark, folder).where("region_code = 'National' AND poll_date IS NOT NULL")
    marks = [(e, k, F.add_months(F.lit(e).cast("date"), -k)) for e in _VOTES for k in range(1, 7)]
    counts = p.agg(*[F.count_if(F.col("poll_date") <= day).alias(f"n{i}") for i, (_, _, day) in enumerate(marks)])
    rows = F.array(*[F.struct(F.lit(e).cast("date").alias("election"), F.lit(k).alias("months"), day.alias("cutoff"), F.col(f"n{i}").alias("n_polls")) for i, (e, k, day) in enumerate(marks)])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


@query(f"WITH {t.POLL_SQL} SELECT region_code, min(poll_date) AS first_day, max(poll_date) AS last_day, count(*) AS n FROM poll WHERE poll_date IS NOT NULL GROUP BY 1")
def first_days(spark: SparkSession, folder: str) -> DataFrame:
    return t.polls(spark, folder).where("poll_date IS NOT NULL").groupBy("region_code").agg(F.min("poll_date").alias("first_day"), F.max("poll_date").alias("last_day"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {t.RESULT_SQL}, direct AS (SELECT DISTINCT {_KEY.format('riding_name')} AS riding FROM qc_riding_names WHERE boundary_year = '2026')
  SELECT riding, party, sum(votes) AS votes, 'own map' AS source FROM result WHERE boundary_year = '2026' GROUP BY 1, 2
  UNION ALL SELECT riding, party, sum(votes), 'older map' FROM result SEMI JOIN direct USING (riding) WHERE boundary_year = '2017' GROUP BY 1, 2""")
def stacked_results(spark: SparkSession, folder: str) -> DataFrame:
    """Results of the newest map, and of the one before for ridings whose name lives on, one below the other."""
    r = t.results(spark, folder)
    live = read_table(spark, folder, "qc_riding_names").where("boundary_year = '2026'").select(name_key(F.col("riding_name")).alias("riding")).distinct()
    part = lambda df, source: df.groupBy("riding", "party").agg(F.sum("votes").alias("votes")).withColumn("source", F.lit(source))
    return part(r.where("boundary_year = '2026'"), "own map").unionByName(part(r.where("boundary_year = '2017'").join(live, "riding", "left_semi"), "older map"))


_ALR = ", ".join(f"ln({p}) - ln(autres)" for p in t.PARTS[:5])


@query(f"""WITH {t.COMP_SQL}, {t.POLL_SQL}, l AS (SELECT comp.poll_id, {', '.join(f'ln({p}) AS {p}' for p in t.PARTS)}, firm FROM comp JOIN poll USING (poll_id) WHERE firm IS NOT NULL),
  m AS (SELECT firm, {', '.join(f'avg({p}) AS m_{p}' for p in t.PARTS)}, {', '.join(f'avg({p} - autres) AS a_{p}' for p in t.PARTS)} FROM l GROUP BY firm)
  SELECT firm, {', '.join(f"round(exp(m_{p}) / ({' + '.join(f'exp(m_{q})' for q in t.PARTS)}), 9) AS {p}" for p in t.PARTS)}, true AS agree FROM m""")
def basis_invariance(spark: SparkSession, folder: str) -> DataFrame:
    """Mean composition of each firm through isometric and through additive log-ratios: the same whatever the basis."""
    c = t.compositions(spark, folder).join(t.polls(spark, folder).where("firm IS NOT NULL").select("poll_id", "firm"), "poll_id")
    z = c.select("firm", *t.named(comp.ilr(t.columns(t.PARTS)), t.COORDS), *[(F.log(p) - F.log("autres")).alias(f"a_{p}") for p in t.PARTS])
    mean = z.groupBy("firm").agg(*[F.avg(x).alias(x) for x in t.COORDS], *[F.avg(f"a_{p}").alias(f"a_{p}") for p in t.PARTS])
    back, other = comp.ilr_inverse(t.columns(t.COORDS)), comp.closure([F.exp(f"a_{p}") for p in t.PARTS])
    agree = F.lit(True)
    for x, y in zip(back, other):
        agree = agree & (F.abs(x - y) < 1e-9)
    return mean.select("firm", *t.named(back, t.PARTS, 9), agree.alias("agree"))


_AS_OF = "2014-04-07"


@query(f"""WITH {t.POLL_SQL} SELECT region_code, poll_id, poll_date FROM poll WHERE poll_date <= DATE '{_AS_OF}' QUALIFY row_number() OVER (PARTITION BY region_code ORDER BY poll_date DESC, poll_id) = 1""")
def latest_by_region(spark: SparkSession, folder: str) -> DataFrame:
    """The last poll of each region on or before a day; the rank is limited before the shuffle, so that a busy region stays small."""
    p = t.polls(spark, folder).select("region_code", "poll_id", "poll_date")
    return relational.latest_as_of(p, ["region_code"], F.col("poll_date"), F.lit(_AS_OF).cast("date"), [F.col("poll_id")])


@query(f"""WITH {t.POLL_SQL} SELECT region_code, poll_id, poll_date FROM poll WHERE poll_date > DATE '{_AS_OF}' QUALIFY dense_rank() OVER (PARTITION BY region_code ORDER BY poll_date) = 1""")
def next_by_region(spark: SparkSession, folder: str) -> DataFrame:
    """All polls of each region on its first day after a cut-off, ties included."""
    p = t.polls(spark, folder).select("region_code", "poll_id", "poll_date")
    return relational.next_after(p, ["region_code"], F.col("poll_date"), F.lit(_AS_OF).cast("date"))


@query(f"WITH {t.COMP_SQL} SELECT poll_id, {', '.join(f'round({p}{" * 1.1e0" if p == t.PARTS[0] else ""} / (1 + 0.1e0 * {t.PARTS[0]}), 9) AS {p}' for p in t.PARTS)} FROM comp")
def perturbed_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Compositions with one part a tenth larger, closed again."""
    return t.compositions(spark, folder).select("poll_id", *t.named(comp.perturbed(t.columns(t.PARTS), 0, 1.1), t.PARTS, 9))
