"""General problems on small fixtures: edge cases and brute force."""

import datetime as dt
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import changes, late, orphans, parsing, profile
from tallyforge.operators.neighbours import neighbours
from tallyforge.streaming import late as late_stream

D = dt.date
T = dt.datetime


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(x is not None, str(x)) for x in r])


BY = "row_id long, election_date string, boundary_year string, riding_code string, party_code string, votes long, day string"
LEAD = "row_id long, party_code string, leader_name string, riding_name string, riding_source string, current_party string, scraped_at timestamp_ntz, scope string"
INC = "row_id long, riding_name string, member_name string, current_party string, elected_with_note string, scraped_at timestamp_ntz, ref_key int"
NAMES = "boundary_year string, riding_code string, riding_name string, region_code string, listed_on date, delisted_on date"


def orphan_input(spark):
    names = spark.createDataFrame(
        [("2017", "10", "Île-d'Été", "MTL", D(2017, 1, 1), D(2025, 1, 1)), ("2017", "10", "Île-d'Été", "MTL", D(2017, 1, 1), D(2025, 1, 1)), ("2026", "197", "Mont Noir", "REG", D(2025, 1, 1), None),
         (None, None, None, None, None, None)], NAMES)
    by = spark.createDataFrame(
        [(1, "2018-05-05", "2017", " ILE D ETE ", "A", 1, "x"), (2, "2018-05-05", "2026", "Île-d'Été", "A", 1, "x"), (3, "2026-02-02", "2026", "197.0", "A", 1, "x"), (4, "2026-02-02", "2026", "198", "A", 1, "x"),
         (5, "2026-02-02", "2026", None, None, None, None), (6, "2026-02-02", "2026", "  ", "A", 1, "x"), (7, "2025-01-01", "2017", "Île-d'Été", "A", 1, "x"), (8, "n/a", "2017", "Île-d'Été", "A", 1, "x"), (4, "2026-02-02", "2026", "198", "A", 1, "x")], BY)
    leaders = spark.createDataFrame([(1, "A", "x", "Mont–Noir", "s", "A", T(2026, 1, 1), "z"), (2, "A", "x", "Mont–Noir", "s", "A", T(2024, 12, 31, 23, 59), "z"), (3, None, None, "—", None, None, None, None)], LEAD)
    incumbents = spark.createDataFrame([(9, "Île-d'Été", None, "A", None, T(2020, 1, 1), 1), (10, "Ile-d'Eté x", None, "A", None, T(2020, 1, 1), 1), (11, None, None, None, None, None, None)], INC)
    return names, by, leaders, incumbents


def test_orphans_keep_duplicates_and_skip_blanks(spark):
    names, by, leaders, incumbents = orphan_input(spark)
    refs, listed = orphans.riding_references(by, leaders, incumbents), orphans.riding_listings(names)
    expected = [("qc_byelections", "2018-05", 2), ("qc_byelections", "2025-01", 7), ("qc_byelections", "2026-02", 4), ("qc_byelections", "2026-02", 4), ("qc_byelections", None, 8),
                ("qc_incumbents", "2020-01", 10), ("qc_leaders", "2024-12", 2), ("qc_leaders", None, 3)]
    assert rows(orphans.orphan_rows(refs, listed)) == sorted(expected, key=lambda r: [(x is not None, str(x)) for x in r])
    assert sum(r.n_rows for r in orphans.orphan_counts(refs, listed).collect()) == len(expected)


def test_orphans_of_empty_tables(spark):
    names, by, leaders, incumbents = orphan_input(spark)
    none = orphans.riding_references(by.limit(0), leaders.limit(0), incumbents.limit(0))
    assert orphans.orphan_rows(none, orphans.riding_listings(names)).count() == 0
    refs = orphans.riding_references(by, leaders, incumbents)
    assert orphans.orphan_rows(refs, orphans.riding_listings(names.limit(0))).count() == refs.count()


def test_orphans_with_a_hot_key_equal_brute_force(spark):
    rng = random.Random(3)
    listed = {("2017", f"R{i}"): (D(2000 + i % 9, 1, 1), None if i % 3 else D(2010, 6, 1)) for i in range(40)}
    names = spark.createDataFrame([(m, str(i), k, "MTL", a, b) for i, ((m, k), (a, b)) in enumerate(listed.items())], NAMES)
    data = [(i, str(D(1999, 1, 1) + dt.timedelta(rng.randrange(5000))), "2017", "R1" if rng.random() < 0.4 else f"R{rng.randrange(60)}", "A", 1, "") for i in range(3000)]
    by = spark.createDataFrame(data, BY)
    empty = orphan_input(spark)
    refs = orphans.riding_references(by, empty[2].limit(0), empty[3].limit(0))
    found = {r.row_id for r in orphans.orphan_rows(refs, orphans.riding_listings(names)).collect()}
    ok = lambda d, k: ("2017", k) in listed and listed["2017", k][0] <= d and (listed["2017", k][1] is None or d < listed["2017", k][1])
    assert found == {r[0] for r in data if not ok(D.fromisoformat(r[1]), r[3])}


@pytest.mark.parametrize("blocks", [1, 3, 256])
def test_neighbours_equal_sorting(spark, blocks):
    rng = random.Random(5)
    data = {("a" if rng.random() < 0.7 else rng.choice("bcd"), rng.randrange(10_000)) for _ in range(400)}
    df = spark.createDataFrame([*data, (None, 3), ("a", None)], "k string, o long")
    expected = set()
    for key in "abcd":
        seq = sorted(o for k, o in data if k == key)
        expected |= {(key, o, seq[i - 1] if i else None, seq[i + 1] if i + 1 < len(seq) else None) for i, o in enumerate(seq)}
    assert {tuple(r) for r in neighbours(df, "k", "o", "p", "n", blocks).collect()} == expected
    assert neighbours(df.limit(0), "k", "o", "p", "n").count() == 0


POLLS = "feed string, load_id long, sample_size int, firm_rating string, num double, c string"
SHARES = "feed string, load_id long, pct_reported double"


def test_profile_findings_equal_brute_force(spark):
    rng = random.Random(7)
    data = []
    for feed in ("f", "g"):
        for load in range(1, 9):
            shift = rng.choice([1, 1, 2])
            nulls = rng.choice([0.1, 0.1, 0.5])
            for _ in range(rng.choice([1, 5, 40])):
                size = None if rng.random() < nulls else rng.choice([int(800 * shift * rng.uniform(0.8, 1.2)), 99, 100, 20000, 20001] if rng.random() < 0.1 else [int(800 * shift * rng.uniform(0.8, 1.2))])
                data.append((feed, load * 10 + (feed == "g"), size, rng.choice([None, "A", "A", "B+", "NC"] if rng.random() < 0.98 else ["a+"]), 1.0, "x"))
    data += [(None, 5, 1, "A", 1.0, "x"), ("f", None, 1, "A", 1.0, "x")]
    df = spark.createDataFrame(data, POLLS)
    states = profile.load_states(df, profile.POLL_CHECKS)
    found = {tuple(r)[1:] for r in profile.findings(profile.load_profile(states, df, profile.POLL_CHECKS)).collect()}
    expected = set()
    for feed in ("f", "g"):
        loads = sorted({r[1] for r in data if r[0] == feed and r[1] is not None})
        for prev, load in zip([None, *loads], loads):
            now = [r for r in data if r[:2] == (feed, load)]
            old = [r for r in data if r[:2] == (feed, prev)] if prev else None
            for col, name in ((2, "sample_size"), (3, "firm_rating")):
                n0, o0 = sum(r[col] is None for r in now), old and sum(r[col] is None for r in old)
                if old and 5 * abs(n0 * len(old) - o0 * len(now)) > len(now) * len(old):
                    expected.add((name, load, "null_rate"))
            med = lambda rs: (lambda v: (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2 if v else None)(sorted(r[2] for r in rs if r[2] is not None and 100 <= r[2] <= 20000))
            if any(r[2] is not None and not 100 <= r[2] <= 20000 for r in now):
                expected.add(("sample_size", load, "range"))
            if any(r[3] is not None and r[3] not in "A+ A A- B+ B B- C+ C C- D NC".split() for r in now):
                expected.add(("firm_rating", load, "pattern"))
            if old and med(now) is not None and med(old) is not None and abs(med(now) - med(old)) > 0.4 * med(old):
                expected.add(("sample_size", load, "shift"))
            a, b = [r[3] for r in now if r[3] is not None], old and [r[3] for r in old if r[3] is not None]
            if a and b and sum(abs(a.count(v) / len(a) - b.count(v) / len(b)) for v in {*a, *b}) / 2 > 0.5:
                expected.add(("firm_rating", load, "shift"))
    assert found == expected


def test_states_merge_and_nan_is_out_of_range(spark):
    df = spark.createDataFrame([("f", 1, float("nan")), ("f", 1, 50.0), ("f", 1, None), ("f", 2, 100.0), ("f", 2, 0.0)], SHARES)
    whole = profile.load_states(df, profile.SHARE_CHECKS)
    pieces = [profile.load_states(df.where(x), profile.SHARE_CHECKS) for x in ("pct_reported = 50", "NOT pct_reported <=> 50")]  # of one load
    parts = profile.merge_states(*pieces)
    for a, b in ((whole.metrics, parts.metrics), (whole.parts, parts.parts)):
        assert str(rows(a)) == str(rows(b.select(*a.columns)))  # as text, since NaN equals nothing
    assert {tuple(r)[2:] for r in profile.findings(profile.load_profile(whole, df, profile.SHARE_CHECKS)).collect()} == {(1, "range"), (2, "null_rate")}
    none = df.limit(0)
    assert profile.load_profile(profile.load_states(none, profile.SHARE_CHECKS), none, profile.SHARE_CHECKS).count() == 0


def test_only_new_loads_are_read(spark, tmp_path):
    df = spark.createDataFrame([("f", i % 4, float(i), None if i % 3 else "A", 1.0, "x") for i in range(40)], "feed string, load_id long, sample_size double, firm_rating string, num double, c string")
    first = profile.update_states(df.where("load_id < 2"), profile.POLL_CHECKS, str(tmp_path))
    assert first.metrics.count() == 4
    changed = df.withColumn("sample_size", F.when(F.col("load_id") < 2, -1.0).otherwise(F.col("sample_size")))  # known loads must not be read again
    both, whole = profile.update_states(changed, profile.POLL_CHECKS, str(tmp_path)), profile.load_states(df, profile.POLL_CHECKS)
    for _ in range(2):
        for a, b in ((both.metrics, whole.metrics), (both.parts, whole.parts)):
            assert rows(a.select(*b.columns)) == rows(b)
        both = profile.update_states(df, profile.POLL_CHECKS, str(tmp_path))


def test_every_column_is_profiled(spark):
    df = spark.createDataFrame([("f", 1, i % 7 if i % 2 else None, None, float(i), str(i)) for i in range(500)], POLLS)
    checks = profile.every_column(df, "polls", profile.POLL_CHECKS)
    metrics = {r.column_name: r for r in profile.metric_states(df, checks).collect()}
    assert set(metrics) == {"sample_size", "firm_rating", "num", "c"} and metrics["num"].max_value == 499 and metrics["sample_size"].n_null == 250 and metrics["firm_rating"].n_null == 500
    n = {r.column_name: r.n_distinct for r in profile.distinct_counts(df, checks).collect()}
    assert n["sample_size"] == 7 and n["firm_rating"] == 0 and abs(n["c"] - 500) < 25


LATE = "poll_id string, poll_date date, scraped_at timestamp_ntz, sample_size int, load_id long, e int"


def late_rows():
    rng = random.Random(11)
    out = []
    for i in range(400):
        day = D(2020, 1, 6) + dt.timedelta(rng.randrange(40))
        for _ in range(rng.choice([1, 1, 1, 2])):
            out.append((f"p{i}", day, T(day.year, day.month, day.day) + dt.timedelta(days=rng.choice([1, 2, 15, 30, 48, 49, 90]), hours=rng.randrange(24)), rng.choice([None, 500, 1000]), rng.randrange(5), 0))
    return [*out, ("x", None, T(2020, 1, 1), 1, 1, 0), ("y", D(2020, 1, 6), None, 1, 1, 0), (None, D(2020, 1, 6), T(2020, 1, 7), 1, 1, 0)]


def late_expected():
    """The first delivery of each poll, and the last one less than 49 days after its week's Monday."""
    first, last = {}, {}
    for p, day, at, size, *_ in late_rows():
        if p and day and at:
            key = (at, day, -1 if size is None else size)
            first[p] = min(first.get(p, key), key)
            if (at.date() - (day - dt.timedelta(day.weekday()))).days < 49:
                last[p] = max(last.get(p, key), key)
    return first, last


def test_late_polls_and_their_deltas(spark):
    polls = spark.createDataFrame(late_rows(), LATE)
    expected, weekly = set(), defaultdict(lambda: [0, 0])
    first, last = late_expected()
    for p, (at, day, _) in first.items():
        monday = day - dt.timedelta(day.weekday())
        age = (at.date() - monday).days
        if age >= 14:
            expected.add((p, str(monday), "refused" if age >= 49 else "corrects"))
        if age < 49:
            day, size = last[p][1:]
            weekly[day - dt.timedelta(day.weekday())][0] += 1
            weekly[day - dt.timedelta(day.weekday())][1] += max(size, 0)
    polled = late.poll_log(polls)
    assert {tuple(r) for r in late.late_polls(polled).collect()} == expected
    taken_back = polled.where("sign = -1")
    assert taken_back.count() > 10 and taken_back.where("outcome = 'refused'").count() > 0
    log = late.deltas(polled)
    figures = {r.period_start: [r.n_polls, r.sample_sum] for r in late.apply_deltas(log, "period_start").collect()}
    assert figures == dict(weekly)
    assert late.poll_log(polls.union(polls)).exceptAll(polled).count() == 0 and late.poll_log(polls.limit(0)).count() == 0
    early = spark.createDataFrame([("p", D(1900, 1, 1), T(1900, 1, 2, 3, 4, 5), None, None, 0), ("p", D(1900, 1, 1), T(1900, 1, 2, 3, 4, 5), -7, 3, 0)], LATE)
    assert rows(late.poll_log(early).select("load_id", "sign", "period", "outcome", "n_polls", "sample_size")) == sorted([(-1, 1, D(1900, 1, 1), "on_time", 1, None), (3, -1, D(1900, 1, 1), "on_time", 1, None), (3, 1, D(1900, 1, 1), "on_time", 1, -7)], key=str)
    by_period = defaultdict(list)
    for r in sorted(log.collect(), key=lambda r: (r.period_start, r.version, r.sign)):
        by_period[r.period_start].append((r.version, r.sign, r.n_polls, r.sample_sum))
    for seq in by_period.values():  # each retraction takes back what the version before had put
        for (v, sign, *old), (w, s, *_) in zip(seq[1::2], seq[2::2]):
            assert (sign, s, w) == (-1, 1, v)
        assert all(seq[i][2:] == seq[i - 1][2:] for i in range(1, len(seq), 2))


def test_late_stream_in_any_order_equals_batch(spark, tmp_path):
    data = late_rows()
    random.Random(1).shuffle(data)
    for i in range(4):
        spark.createDataFrame(data[i::4], LATE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(LATE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    weekly = late_stream.weekly(stream, str(tmp_path / "state")).where("n_polls > 0").select("period_start", "n_polls", "sample_sum")
    batch = late.apply_deltas(late.deltas(late.poll_log(spark.createDataFrame(data, LATE))), "period_start").select("period_start", "n_polls", "sample_sum")
    assert rows(weekly) == rows(batch)
    log = late_stream.change_log(stream, str(tmp_path / "state"))
    assert rows(late.apply_deltas(log, "period_start").where("n_polls > 0").select("period_start", "n_polls", "sample_sum")) == rows(batch)


SNAP = "title string, revid long, poll_id string, firm string, party_code string, pct_reported double, island int, e string"
PAGES = "title string, revid long, fetched_at timestamp_ntz, html string"


def test_changes_equal_brute_force(spark):
    rng = random.Random(13)
    pages, snaps = [], []
    for title in ("t", "u"):
        revs = sorted(rng.sample(range(1000), 12))
        for r in revs:
            pages += [(title, r, T(2020, 1, 1), "")] * rng.choice([1, 2])
            if rng.random() < 0.15:
                continue
            for p in range(5):
                if rng.random() < 0.8:
                    row = (title, r, f"p{p}", "f", "A", rng.choice([None, 10.0, 10.009, 10.02, 11.0]), 1, "x")
                    snaps += [row] * rng.choice([1, 1, 2])
    snaps += [("t", 5000, "p1", "f", "A", 1.0, 1, "x"), ("t", None, "p1", "f", "A", 1.0, 1, "x"), ("t", pages[0][1], None, "f", None, 1.0, 1, "x")]
    found = rows(changes.change_events(spark.createDataFrame(snaps, SNAP), spark.createDataFrame(pages, PAGES)))
    expected = []
    for title in ("t", "u"):
        revs = sorted({r[1] for r in pages if r[0] == title})
        table = {r: {(s[2], s[4]): s[5] for s in snaps if s[:2] == (title, r) and s[2]} for r in revs}
        for a, b in zip(revs, revs[1:]):
            for key in {*table[a], *table[b]}:
                if key not in table[a] or key not in table[b]:
                    expected.append((title, b, *key, "added" if key in table[b] else "removed"))
                else:
                    x, y = table[a][key], table[b][key]
                    if (x is None) != (y is None) or (x is not None and abs(x - y) > 0.01):
                        expected.append((title, b, *key, "changed"))
    assert found == sorted(expected, key=lambda r: [(x is not None, str(x)) for x in r])
    spans = changes.validity_intervals(spark.createDataFrame(snaps, SNAP), spark.createDataFrame(pages, PAGES)).collect()
    starts = sum(1 for s in spans if s.valid_from != min(r[1] for r in pages if r[0] == s.title))
    assert starts == sum(1 for e in expected if e[-1] != "removed")
    assert changes.change_events(spark.createDataFrame([], SNAP), spark.createDataFrame(pages, PAGES)).count() == 0


RAW = "line_id long, title string, raw_line string, reason string, _fields int"
OK = "2020-01-31,Firme,1000,1,2,3,4,5,note"
CASES = {
    OK: None,
    '"31 Janvier  2020[note 3]","Firme ""X"", fils"," 1 000 ",1,2,3,4,5,"a\nb"': None,
    "1 AOUT 2020,F,,1,2,3,4,5,": None,
    "12 décembre 2020[1] ,F, ,1,2,3,4,5,": None,
    "2020-01-31,F,1000,1,2,3,4,5": "column_count",
    "2020-01-31,F,1000,1,2,3,4,5,a,b": "column_count",
    "": "column_count",
    None: "column_count",
    '2020-01-31,F "x",1000,1,2,3,4,5,n': "quoting",
    '2020-01-31,"F,1000,1,2,3,4,5,n': "quoting",
    '2020-01-31, "F",1000,1,2,3,4,5,n': "quoting",
    '2020-01-31,"F"x,1000,1,2,3,4,5': "quoting",
    '2020-01-31,"F" "x",1000,1,2,3,4,5,n': "quoting",
    '2020-01-31,"",1000,1,2,3,4,5,""""': None,
    "2020-02-30,F,1000,1,2,3,4,5,n": "poll_date",
    "30 février 2020,F,1000,1,2,3,4,5,n": "poll_date",
    "31 janv 2020,F,1000,1,2,3,4,5,n": "poll_date",
    "31 janvier 20,F,1000,1,2,3,4,5,n": "poll_date",
    "2020-1-31,F,x,1,2,3,4,5,n": "poll_date",
    ",F,1000,1,2,3,4,5,n": "poll_date",
    "2020-01-31,F,0,1,2,3,4,5,n": "sample_size",
    "2020-01-31,F,000,1,2,3,4,5,n": "sample_size",
    "2020-01-31,F,-5,1,2,3,4,5,n": "sample_size",
    "2020-01-31,F,1000.5,1,2,3,4,5,n": "sample_size",
    "2020-01-31,F,n/d,1,2,3,4,5,n": "sample_size",
    '2020-01-31,"' + 'x""' * 50_000 + '",1000,1,2,3,4,5,n': None,
    "2020-01-31,F,1000,1,2,3,4,5," + "," * 50_000: "column_count",
}


def test_strict_load_and_reasons(spark):
    lines = list(CASES)
    raw = spark.createDataFrame([(i, "t", s, "x", 1) for i, s in enumerate(lines)], RAW)
    assert {lines[r.line_id]: r.reason for r in parsing.rejected(raw).collect()} == {k: v for k, v in CASES.items() if v}
    loaded = {lines[r.line_id]: r for r in parsing.strict_load(raw).collect()}
    assert set(loaded) == {k for k, v in CASES.items() if not v}
    second = loaded[lines[1]]
    assert (second.poll_date, second.firm, second.sample_size, second.note) == (D(2020, 1, 31), 'Firme "X", fils', 1000, "a\nb")
    assert loaded[lines[2]].sample_size is None and loaded[OK].LPN == 5.0
    assert parsing.rejected(raw.limit(0)).count() == 0


def test_quoting_equals_a_state_machine(spark):
    def quoted(line):
        return re.fullmatch(r'(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*', line, re.S) is not None

    rng = random.Random(17)
    lines = ["".join(rng.choice('a",,"\n') for _ in range(rng.randrange(12))) for _ in range(800)]
    df = spark.createDataFrame([(s,) for s in lines], "raw_line string").withColumn("p", parsing._pieces(F.col("raw_line")))
    for r in df.select("raw_line", parsing.well_quoted(F.col("p")).alias("ok"), parsing.fields(F.col("p")).alias("f")).collect():
        assert r.ok == quoted(r.raw_line), r.raw_line
        if r.ok:
            parts = re.findall(r'("(?:[^"]|"")*"|[^",]*),', r.raw_line + ",", re.S)
            assert r.f == [x[1:-1].replace('""', '"') if x[:1] == '"' else x for x in parts]
