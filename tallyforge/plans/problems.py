"""Queries of the general data-quality problems: pN_ names, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import changes, late, orphans, parsing, profile
from tallyforge.session import new_folder, read_table


def _references(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    refs = orphans.riding_references(*[read_table(spark, folder, t) for t in ("qc_byelections", "qc_leaders", "qc_incumbents")])
    return refs, orphans.riding_listings(read_table(spark, folder, "qc_riding_names"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.orphan_rows(*_references(spark, folder))


def p1_counts(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.orphan_counts(*_references(spark, folder))


_DECLARED = {"polls": profile.POLL_CHECKS, "poll_shares": profile.SHARE_CHECKS}


def _profile(spark: SparkSession, folder: str, every: bool) -> DataFrame:
    """Profiles of the declared columns, or of every column, of both tables."""
    found = []
    for table, declared in _DECLARED.items():
        df = read_table(spark, folder, table)
        checks = profile.every_column(df, table, declared) if every else declared
        states = profile.update_states(df, checks, f"{new_folder(spark)}/{table}")  # kept where a later run could add its loads
        found.append(profile.load_profile(states, df, checks))
    return found[0].unionByName(found[1])


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return profile.findings(_profile(spark, folder, False))


def p2_profile(spark: SparkSession, folder: str) -> DataFrame:
    limits = profile.with_control_limits(_profile(spark, folder, True))
    return limits.select(
        "table_name", "column_name", "feed", "load_id", "n_rows", "n_null", "n_out_of_range", "n_malformed",
        F.round("min_value", 6).alias("min_value"), F.round("max_value", 6).alias("max_value"), F.round("median", 6).alias("median"), F.round("distance", 6).alias("distance"), "null_rate_alarm", "median_alarm",
    )


def p2_distinct(spark: SparkSession, folder: str) -> DataFrame:
    tables = [(t, read_table(spark, folder, t)) for t in _DECLARED]
    first, second = (profile.distinct_counts(df, profile.every_column(df, t)) for t, df in tables)
    return first.unionByName(second)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return late.late_polls(late.poll_log(read_table(spark, folder, "polls")))


def p3_deltas(spark: SparkSession, folder: str) -> DataFrame:
    return late.deltas(late.poll_log(read_table(spark, folder, "polls")))


def p3_weekly(spark: SparkSession, folder: str) -> DataFrame:
    return late.apply_deltas(p3_deltas(spark, folder), "period_start")


def p3_monthly(spark: SparkSession, folder: str) -> DataFrame:
    months = p3_deltas(spark, folder).withColumn("month_start", F.trunc("period_start", "month"))
    return late.apply_deltas(months, "month_start").drop("version")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return changes.change_events(read_table(spark, folder, "snapshot_shares"), read_table(spark, folder, "page_snapshots"))


def p5_intervals(spark: SparkSession, folder: str) -> DataFrame:
    spans = changes.validity_intervals(read_table(spark, folder, "snapshot_shares"), read_table(spark, folder, "page_snapshots"))
    return spans.drop("before_first").withColumn("pct", F.round("pct", 2))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return parsing.rejected(read_table(spark, folder, "poll_rows_raw"))


def p6_loaded(spark: SparkSession, folder: str) -> DataFrame:
    return parsing.strict_load(read_table(spark, folder, "poll_rows_raw"))


QUERIES = {f.__name__: f for f in (p1_found, p1_counts, p2_found, p2_profile, p2_distinct, p3_found, p3_deltas, p3_weekly, p3_monthly, p5_found, p5_intervals, p6_found, p6_loaded)}

_FOLD = "regexp_replace(strip_accents(lower({0})), '[^a-z0-9]', '', 'g')"
_ORPHANS = f"""
WITH refs AS (
  SELECT 'qc_byelections' AS table_name, row_id, boundary_year AS scope,
         CASE WHEN regexp_matches(trim(riding_code), '^[0-9]') THEN 'c:' || regexp_extract(trim(riding_code), '^[0-9]+') ELSE 'n:' || {_FOLD.format('riding_code')} END AS k,
         CAST(election_date AS DATE) AS d
  FROM qc_byelections WHERE trim(riding_code) <> ''
  UNION ALL SELECT 'qc_leaders', row_id, '*', 'n:' || {_FOLD.format('riding_name')}, CAST(scraped_at AS DATE) FROM qc_leaders WHERE trim(riding_name) <> ''
  UNION ALL SELECT 'qc_incumbents', row_id, '*', 'n:' || {_FOLD.format('riding_name')}, CAST(scraped_at AS DATE) FROM qc_incumbents WHERE trim(riding_name) <> ''),
names AS (
  SELECT boundary_year AS scope, 'c:' || riding_code AS k, listed_on, delisted_on FROM qc_riding_names
  UNION ALL SELECT boundary_year, 'n:' || {_FOLD.format('riding_name')}, listed_on, delisted_on FROM qc_riding_names
  UNION ALL SELECT '*', 'n:' || {_FOLD.format('riding_name')}, listed_on, delisted_on FROM qc_riding_names),
orphan AS (
  SELECT table_name, strftime(d, '%Y-%m') AS period, row_id, scope, k FROM refs r
  WHERE NOT EXISTS (SELECT 1 FROM names n WHERE n.scope = r.scope AND n.k = r.k AND n.listed_on <= r.d AND (n.delisted_on IS NULL OR r.d < n.delisted_on)))
"""
_LATE = """
WITH e AS (
  SELECT poll_id, arg_min(poll_date, scraped_at) AS d, min(scraped_at) AS a, arg_min(sample_size, (scraped_at, coalesce(sample_size, -9999999))) AS s
  FROM polls WHERE poll_date IS NOT NULL AND scraped_at IS NOT NULL GROUP BY poll_id),
aged AS (SELECT poll_id, CAST(date_trunc('week', d) AS DATE) AS m, CAST(a AS DATE) - CAST(date_trunc('week', d) AS DATE) AS age, s FROM e)
"""
_STEPS = """
WITH d AS (SELECT poll_id, coalesce(load_id, -1) AS load_id, date_trunc('week', poll_date) AS m, {'a': scraped_at, 'd': poll_date, 's': coalesce(sample_size, -9999999)} AS e
           FROM polls WHERE poll_id IS NOT NULL AND poll_date IS NOT NULL AND scraped_at IS NOT NULL),
st AS (SELECT DISTINCT poll_id, load_id, min(e) OVER w AS f, max(CASE WHEN CAST(e.a AS DATE) - CAST(m AS DATE) < 49 THEN e END) OVER w AS l FROM d WINDOW w AS (PARTITION BY poll_id ORDER BY load_id)),
parts AS (SELECT poll_id, load_id, CASE WHEN CAST(f.a AS DATE) - CAST(date_trunc('week', f.d) AS DATE) < 49 THEN l END AS p FROM st),
moves AS (SELECT load_id, p, lag(p) OVER (PARTITION BY poll_id ORDER BY load_id) AS q FROM parts),
signed AS (SELECT load_id, p, 1 AS sign FROM moves WHERE p IS NOT NULL UNION ALL SELECT load_id, q, -1 FROM moves WHERE q IS NOT NULL),
kept AS (SELECT CAST(date_trunc('week', p.d) AS DATE) AS m, load_id AS step, sum(sign) AS n, sum(sign * CASE WHEN p.s > -9999999 THEN p.s ELSE 0 END) AS s FROM signed GROUP BY 1, 2),
v AS (SELECT m, step, row_number() OVER w - 1 AS version, sum(n) OVER w AS n, sum(s) OVER w AS s, sum(n) OVER w - n AS n0, sum(s) OVER w - s AS s0
      FROM kept WHERE n <> 0 OR s <> 0 WINDOW w AS (PARTITION BY m ORDER BY step))
"""
_CHANGES = """
WITH rv AS (SELECT title, revid, lag(revid) OVER w AS prev, lead(revid) OVER w AS nxt FROM (SELECT DISTINCT title, revid FROM page_snapshots) WINDOW w AS (PARTITION BY title ORDER BY revid)),
s AS (SELECT title, revid, poll_id, party_code, min(pct_reported) AS v FROM snapshot_shares GROUP BY ALL),
r AS (SELECT s.*, rv.prev, rv.nxt FROM s JOIN rv USING (title, revid))
"""
_RUN = "(PARTITION BY title, poll_id, party_code ORDER BY revid)"
_INTERVALS = _CHANGES + f""", k AS (SELECT *, CASE WHEN lag(revid) OVER w = prev AND (v IS NOT DISTINCT FROM lag(v) OVER w OR abs(v - lag(v) OVER w) <= 0.01) THEN 0 ELSE 1 END AS st
  FROM r WHERE poll_id IS NOT NULL AND party_code IS NOT NULL WINDOW w AS {_RUN}), i AS (SELECT *, sum(st) OVER {_RUN} AS island FROM k)
SELECT title, poll_id, party_code, min(revid) AS valid_from, max(revid) AS last_revid, first(nxt ORDER BY revid DESC) AS valid_to, round(first(v ORDER BY revid), 2) AS pct FROM i GROUP BY title, poll_id, party_code, island"""
_MOVED = "((b.v IS NULL) <> (a.v IS NULL) OR abs(b.v - a.v) > 0.01)"
_PIECE = '(?:"(?:[^"]|"")*"|[^",]*)'
_PARSE = f"""
WITH q AS (
  SELECT line_id, title, raw_line, regexp_full_match(raw_line, '{_PIECE}(?:,{_PIECE})*', 's') AS quoted,
         regexp_extract_all(raw_line || ',', '({_PIECE}),', 1, 's') AS f FROM poll_rows_raw),
u AS (SELECT *, list_transform(f, lambda x: CASE WHEN x[1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END) AS g FROM q),
d AS (SELECT *, trim(regexp_replace(strip_accents(lower(regexp_replace(g[1], '\\[[^\\]]*\\]', '', 'g'))), '[\\s\\x{{00a0}}\\x{{2009}}\\x{{202f}}]+', ' ', 'g')) AS t,
             regexp_replace(g[3], '[\\s\\x{{00a0}}\\x{{2009}}\\x{{202f}}]+', '', 'g') AS z FROM u),
m AS (SELECT *, regexp_extract(t, '^([0-9]{{1,2}}) ([a-z]+) ([0-9]{{4}})$', ['dd', 'mm', 'yy']) AS p FROM d),
c AS (SELECT *, CASE WHEN regexp_full_match(t, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN try_cast(t AS DATE)
                     ELSE try_cast(p.yy || '-' || list_position(['janvier','fevrier','mars','avril','mai','juin','juillet','aout','septembre','octobre','novembre','decembre'], p.mm) || '-' || p.dd AS DATE) END AS day FROM m)
"""

VALID_SQL = "coalesce(quoted AND len(f) = 9 AND day IS NOT NULL AND (z = '' OR (regexp_full_match(z, '[0-9]+') AND NOT regexp_full_match(z, '0+'))), false)"
PARSE_SQL = _PARSE
_NUMBER = r"try_cast(replace(regexp_replace(regexp_replace({0}, '\[[^\]]*\]', '', 'g'), '[\s\x{{00a0}}\x{{2009}}\x{{202f}}%±]', '', 'g'), ',', '.') AS DOUBLE)"
SHARES_SQL = ", ".join(f"{_NUMBER.format(f'g[{i + 1}]')} AS {parsing.FIELDS[i]}" for i in range(3, 8))

ORACLE = {
    "p1_found": _ORPHANS + "SELECT table_name, period, row_id FROM orphan",
    "p1_counts": _ORPHANS + "SELECT table_name, period, count(*) AS n_rows, count(DISTINCT (scope, k)) AS n_keys FROM orphan GROUP BY 1, 2",
    "p3_found": _LATE + "SELECT poll_id, strftime(m, '%Y-%m-%d') AS period, CASE WHEN age >= 49 THEN 'refused' ELSE 'corrects' END AS outcome FROM aged WHERE age >= 14",
    "p3_deltas": _STEPS + """SELECT m AS period_start, version, step AS load_id, 1 AS sign, CAST(n AS BIGINT) AS n_polls, CAST(s AS BIGINT) AS sample_sum FROM v
        UNION ALL SELECT m, version, step, -1, CAST(n0 AS BIGINT), CAST(s0 AS BIGINT) FROM v WHERE version > 0""",
    "p3_weekly": _STEPS + "SELECT m AS period_start, CAST(arg_max(n, version) AS BIGINT) AS n_polls, CAST(arg_max(s, version) AS BIGINT) AS sample_sum, max(version) AS version FROM v GROUP BY m",
    "p3_monthly": _STEPS + """SELECT CAST(date_trunc('month', m) AS DATE) AS month_start, CAST(sum(n) AS BIGINT) AS n_polls, CAST(sum(s) AS BIGINT) AS sample_sum FROM kept GROUP BY 1""",
    "p5_found": _CHANGES + f"""SELECT a.title, a.revid, a.poll_id, a.party_code, CASE WHEN b.title IS NULL THEN 'added' ELSE 'changed' END AS change_kind
        FROM r a LEFT JOIN s b ON b.title = a.title AND b.revid = a.prev AND b.poll_id = a.poll_id AND b.party_code = a.party_code
        WHERE a.prev IS NOT NULL AND (b.title IS NULL OR {_MOVED})
        UNION ALL SELECT a.title, a.nxt, a.poll_id, a.party_code, 'removed' FROM r a
        LEFT JOIN s b ON b.title = a.title AND b.revid = a.nxt AND b.poll_id = a.poll_id AND b.party_code = a.party_code WHERE a.nxt IS NOT NULL AND b.title IS NULL""",
    "p6_found": _PARSE + """SELECT line_id, CASE WHEN NOT quoted THEN 'quoting' WHEN len(f) <> 9 THEN 'column_count' WHEN day IS NULL THEN 'poll_date' ELSE 'sample_size' END AS reason
        FROM c WHERE NOT """ + VALID_SQL,
    "p6_loaded": _PARSE + f"SELECT line_id, title, day AS poll_date, trim(g[2]) AS firm, try_cast(nullif(z, '') AS BIGINT) AS sample_size, {SHARES_SQL}, g[9] AS note FROM c WHERE {VALID_SQL}",
}
ORACLE["p5_intervals"] = _INTERVALS
_STATES = """
WITH cells AS (
  SELECT 'polls' AS table_name, 'sample_size' AS column_name, feed, load_id, CAST(sample_size AS DOUBLE) AS num, NULL AS txt, 100 AS lo, 20000 AS hi FROM polls
  UNION ALL SELECT 'polls', 'firm_rating', feed, load_id, NULL, firm_rating, NULL, NULL FROM polls
  UNION ALL SELECT 'poll_shares', 'pct_reported', feed, load_id, pct_reported, NULL, 0, 100 FROM poll_shares),
loads AS (
  SELECT table_name, column_name, feed, load_id, count(*) AS n_rows, count(*) FILTER (num IS NULL AND txt IS NULL) AS n_null,
         count(*) FILTER (num < lo OR num > hi) AS n_out, count(*) FILTER (txt NOT IN ('A+','A','A-','B+','B','B-','C+','C','C-','D','NC')) AS n_bad,
         median(num) FILTER (num BETWEEN lo AND hi) AS med, count(txt) AS n_txt FROM cells GROUP BY ALL),
seq AS (SELECT *, lag(load_id) OVER w AS prev, lag(n_rows) OVER w AS n_rows0, lag(n_null) OVER w AS n_null0, lag(med) OVER w AS med0, lag(n_txt) OVER w AS n_txt0
        FROM loads WINDOW w AS (PARTITION BY table_name, column_name, feed ORDER BY load_id)),
shares AS (SELECT feed, load_id, txt, count(*) AS n FROM cells WHERE txt IS NOT NULL GROUP BY ALL),
vals AS (SELECT s.feed, s.load_id, s.prev, s.n_txt, s.n_txt0, v.txt FROM seq s JOIN (SELECT DISTINCT feed, txt FROM shares) v USING (feed) WHERE s.column_name = 'firm_rating' AND s.n_txt > 0 AND s.n_txt0 > 0),
dist AS (SELECT x.feed, x.load_id, sum(abs(coalesce(a.n, 0) / x.n_txt - coalesce(b.n, 0) / x.n_txt0)) / 2 AS tv FROM vals x
         LEFT JOIN shares a ON a.feed = x.feed AND a.load_id = x.load_id AND a.txt = x.txt LEFT JOIN shares b ON b.feed = x.feed AND b.load_id = x.prev AND b.txt = x.txt GROUP BY ALL)
"""
ORACLE["p2_found"] = _STATES + """SELECT table_name, column_name, load_id, 'null_rate' AS finding FROM seq WHERE 5 * abs(n_null * n_rows0 - n_null0 * n_rows) > n_rows * n_rows0
  UNION ALL SELECT table_name, column_name, load_id, 'range' FROM seq WHERE n_out > 0
  UNION ALL SELECT table_name, column_name, load_id, 'pattern' FROM seq WHERE n_bad > 0
  UNION ALL SELECT table_name, column_name, load_id, 'shift' FROM seq WHERE abs(med - med0) > 0.4 * med0
  UNION ALL SELECT 'polls', 'firm_rating', load_id, 'shift' FROM dist WHERE tv > 0.5"""
_PLAIN = {
    "polls": ("poll_id", "jurisdiction_code", "region_code", "firm", "poll_date", "is_rolling", "general_election", "source_url", "scraped_at"),
    "poll_shares": ("poll_id", "party_code"),
}
ORACLE["p2_profile"] = _STATES + ", plain AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, feed, load_id, count(*) AS n_rows, count(*) - count({c}) AS n_null FROM {t} WHERE feed IS NOT NULL AND load_id IS NOT NULL GROUP BY ALL"
    for t, columns in _PLAIN.items() for c in columns
) + """),
ranges AS (SELECT table_name, column_name, feed, load_id, min(num) AS lo, max(num) AS hi FROM cells GROUP BY ALL),
merged AS (
  SELECT l.table_name, l.column_name, l.feed, l.load_id, l.n_rows, l.n_null, l.n_out, l.n_bad, r.lo, r.hi, l.med, d.tv
  FROM loads l JOIN ranges r USING (table_name, column_name, feed, load_id) LEFT JOIN dist d ON l.column_name = 'firm_rating' AND d.feed = l.feed AND d.load_id = l.load_id
  WHERE l.feed IS NOT NULL AND l.load_id IS NOT NULL
  UNION ALL SELECT table_name, column_name, feed, load_id, n_rows, n_null, 0, 0, NULL, NULL, NULL, NULL FROM plain)
SELECT table_name, column_name, feed, load_id, n_rows, n_null, n_out AS n_out_of_range, n_bad AS n_malformed, round(lo, 6) AS min_value, round(hi, 6) AS max_value, round(med, 6) AS median, round(tv, 6) AS distance,
  coalesce(count(n_null) OVER w >= 8 AND abs(n_null / n_rows - avg(n_null / n_rows) OVER w) > 3 * stddev_samp(n_null / n_rows) OVER w + 1e-9, false) AS null_rate_alarm,
  coalesce(count(med) OVER w >= 8 AND abs(med - avg(med) OVER w) > 3 * stddev_samp(med) OVER w + 1e-9, false) AS median_alarm
FROM merged WINDOW w AS (PARTITION BY table_name, column_name, feed ORDER BY load_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
