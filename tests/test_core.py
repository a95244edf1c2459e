"""Expressions, relational operators, simulation, trends, sources and streams against hand-made and brute-force results."""

import math
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.functions import composition as comp
from tallyforge.functions import rng, stats, text, timeaxis
from tallyforge.operators import gp, montecarlo, regression, relational
from tallyforge.sources import files, pages
from tallyforge.streaming import watch


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def lits(values):
    return [F.lit(v) if v is not None else F.lit(None).cast("double") for v in values]


def test_generator_starts_like_the_published_stream(spark):
    calls = [r[0] for r in spark.range(1, 5).orderBy("id").select(rng.uniform(1, F.col("id"))).collect()]
    assert calls == [0.6270739405881613, 0.002735721180215478, 0.5274470399599522, 0.9810509674716741]
    staged = rng.with_uniforms(spark.range(1, 5), 1, {"u": F.col("id")}).orderBy("id").collect()
    assert [r.u for r in staged] == calls


def test_zero_and_unmeasured_parts_get_the_same_small_share(spark):
    got = one(spark, *comp.zero_replaced(lits([0.5, 0.5, None, 0.0])))
    assert got == pytest.approx((0.4375, 0.4375, 0.0625, 0.0625))
    assert one(spark, *comp.closure(lits([0.0, 0.0]))) == (None, None)


def test_coordinates_keep_lengths_and_go_back(spark):
    gen = np.random.default_rng(9)
    parts = gen.uniform(0.01, 1, (50, 4))
    names, coords = list("abcd"), ["z1", "z2", "z3"]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(parts)], "i int, a double, b double, c double, d double")
    cols = lambda ns: [F.col(n) for n in ns]
    df = df.withColumns(dict(zip(coords, comp.ilr(cols(names))))).withColumns({f"c_{n}": c for n, c in zip(names, comp.clr(cols(names)))})
    df = df.withColumns({f"b_{n}": c for n, c in zip(names, comp.ilr_inverse(cols(coords)))}).withColumns({f"s_{n}": c for n, c in zip(names, comp.swung(cols(names), cols(names), cols(names)))})
    for r in df.collect():
        shares = parts[r.i] / parts[r.i].sum()
        assert [r[f"b_{n}"] for n in names] == pytest.approx(shares) == [r[f"s_{n}"] for n in names]
        assert sum(r[z] ** 2 for z in coords) == pytest.approx(sum(r[f"c_{n}"] ** 2 for n in names))


@settings(max_examples=20, deadline=None)
@given(st.lists(st.floats(0.01, 1), min_size=2, max_size=8))
def test_contrasts_keep_lengths(parts):
    logs = np.log(parts)
    assert np.linalg.norm(np.array(comp.basis(len(parts))) @ logs) == pytest.approx(np.linalg.norm(logs - logs.mean()), abs=1e-9)


def test_basis_is_orthonormal_and_sums_to_zero():
    v = np.array(comp.basis(6))
    assert np.allclose(v @ v.T, np.eye(5)) and np.allclose(v.sum(1), 0)


def test_perturbation_and_clamped_shift(spark):
    assert one(spark, *comp.perturbed(lits([0.5, 0.5]), 0, 3.0)) == pytest.approx((0.75, 0.25))
    far = one(spark, *comp.ilr(comp.shifted(lits([0.5, 0.5]), [F.lit(9.0)])))
    assert far == pytest.approx((0.35,))


def test_names_numbers_and_dates(spark):
    assert one(spark, text.name_key(F.lit("L’Île–d'Œuvre  (Été)"))) == ("liledoeuvreete",)
    assert one(spark, text.riding_code(F.lit(" 197.0 ")), text.riding_code(F.lit("Mont 1"))) == ("197", "Mont 1")
    assert one(spark, text.locale_number(F.lit("1 234,5 %[2]")), text.locale_number(F.lit("–"))) == (1234.5, None)
    assert one(spark, text.is_blank(F.lit("   ")), text.is_blank(F.lit(None).cast("string")), text.is_blank(F.lit("x"))) == (True, True, False)
    assert [str(x) for x in one(spark, text.french_date(F.lit("29 FÉVRIER 2024[a]")), text.french_date(F.lit("29 fevrier 2023")))] == ["2024-02-29", "None"]
    assert one(spark, text.poll_id(F.lit("a"), F.lit(None).cast("string")))[0] == __import__("hashlib").sha1(b"a|").hexdigest()[:16]


def test_time_axis(spark):
    day = F.lit("2018-09-02").cast("date")
    got = one(spark, timeaxis.regime_index(day, ["2016-06-01", "2018-09-02", "2020-01-01"]), timeaxis.window_days(day, [("2014-03-05", "2014-04-07"), ("2018-08-23", "2018-10-01")]), timeaxis.cycle_of(day, [("2014-04-07", "a"), ("2018-10-01", "b")], "c"))
    assert got == (2, 33 + 10, "b")


def test_first_argmax_and_normal_distribution(spark):
    ties = spark.createDataFrame([("b", 2.0, 1), ("a", 2.0, 2), ("c", 1.0, 0)], "l string, v double, o int")
    assert ties.agg(stats.first_argmax(F.col("l"), F.col("v"), F.col("o")).alias("x")).first().x == "b"
    assert one(spark, stats.normal_cdf(F.lit(1.6449)))[0] == pytest.approx(0.95, abs=1e-4)


def test_upsert_policies_and_difference(spark):
    t = spark.createDataFrame([(1, 10, "a"), (2, 20, "b")], "k int, x int, y string")
    s = spark.createDataFrame([(2, None, "z"), (3, 30, "c")], "k int, x int, y string")
    got = lambda u: sorted(map(tuple, relational.upsert(t, s, ["k"], u).collect()))
    assert got(None) == [(1, 10, "a"), (2, 20, "z"), (3, 30, "c")]
    assert got(["x"]) == [(1, 10, "a"), (2, 20, "b"), (3, 30, "c")]
    assert got([]) == [(1, 10, "a"), (2, 20, "b"), (3, 30, "c")]
    assert sorted(map(tuple, relational.two_way_difference(t, s, ["k"]).collect())) == [(1, "removed"), (3, "added")]
    assert relational.delete_in(t, s.select("k")).first().k == 1


def test_as_of_next_islands_pairs_and_prorata(spark):
    d = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 3, "z"), ("a", 5, "w"), ("a", 5, "v")], "f string, d int, p string")
    assert [r.p for r in relational.latest_as_of(d, ["f"], F.col("d"), F.lit(4), [F.col("p")]).collect()] == ["y"]
    assert sorted(r.p for r in relational.next_after(d, ["f"], F.col("d"), F.lit(3)).collect()) == ["v", "w"]
    runs = spark.createDataFrame([("g", i, v) for i, v in enumerate([None, None, "a", "a", "b", "a"])], "g string, o int, v string")
    assert [(r.island, r.streak) for r in relational.islands(runs, ["g"], "v", ["o"]).orderBy("o").collect()] == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (4, 1)]
    edges = spark.createDataFrame([(v, c) for v in (1, 2) for c in "ab"] + [(3, "a"), (1, "a"), (3, "c"), (None, "c")], "v int, c string")
    assert [tuple(r) for r in relational.shared_pairs(edges, "v", "c", 2).collect()] == [("a", "b", 2)]
    known = spark.createDataFrame([("m", "r1", 30.0), ("m", "r2", 10.0), ("n", "r3", 5.0)], "m string, r string, v double")
    loose = spark.createDataFrame([("m", 8.0), ("o", 1.0)], "m string, v double")
    assert sorted((r.r, r.v) for r in relational.prorata(known, loose, ["m"], "v").collect()) == [("r1", 36.0), ("r2", 12.0), ("r3", 5.0)]


PARTIES = ["A", "B", "C"]


def test_simulation_summaries_equal_brute_force(spark):
    gen = np.random.default_rng(3)
    counts = [("m", i, *map(int, x)) for i, x in enumerate(gen.multinomial(9, [0.4, 0.35, 0.25], 60))] + [("m", 60, 4, 4, 1), ("m", 61, 4, 3, 2)]
    df = spark.createDataFrame(counts, "g string, draw int, a long, b long, c long")
    vectors = np.array([c[2:] for c in counts])
    sums = np.abs(vectors[:, None] - vectors[None]).sum((1, 2))
    best = montecarlo.medoid(df, "g", PARTIES).first()
    assert (best.draw, best.distance) == (int(sums.argmin()), int(sums.min()))
    hist = montecarlo.seat_distribution(df, "g", PARTIES).collect()
    assert sum(h.prob for h in hist) == pytest.approx(3) and max(h.height for h in hist) == 1
    found = {(r.type, r.leader, r.balance, r.needs_opposition): (r.n, r.opposition) for r in montecarlo.scenarios(df, "g", PARTIES).collect()}
    expected = {}
    for _, _, *seats in counts:
        ranked = [(p, s) for p, s in sorted(zip(PARTIES, seats), key=lambda x: -x[1]) if s]
        second = ranked[1][0] if len(ranked) > 1 else None
        if ranked[0][1] >= 5:
            key = ("majority", ranked[0][0], None, False)
        else:
            makers = sorted((s, PARTIES.index(p), p) for p, s in ranked[2:] if s >= 5 - ranked[0][1])
            key = ("minority", ranked[0][0], makers[0][2] if makers else None, not makers and ranked[0][1] + ranked[1][1] >= 5)
        n, first = expected.get(key, (0, second))
        expected[key] = (n + 1, first)
    assert found == expected


def test_simulation_is_the_same_on_any_partitioning(spark):
    ridings = spark.createDataFrame([("m", f"r{i}", None if i == 4 else "xy"[i % 2], i, i % 2, 5, 2, 0.3, 0.3, 0.4) for i in range(5)], "g string, riding string, region string, ord int, region_ord int, n_ridings long, n_regions long, a double, b double, c double")
    residuals = spark.createDataFrame([("m", i, 3, 0.1 * i, -0.1) for i in range(3)], "g string, idx long, n_residuals long, r1 double, r2 double")
    run = lambda r: sorted(map(str, montecarlo.simulate(r, residuals, ["a", "b", "c"], "g", 20).collect()))
    first = run(ridings)
    assert len(first) == 100 and first == run(ridings.repartition(7))
    seats = montecarlo.seat_counts(montecarlo.simulate(ridings, residuals.limit(0), ["a", "b", "c"], "g", 20), "g", PARTIES)
    assert all(r.a + r.b + r.c == 5 for r in seats.collect())


def test_process_fit_equals_the_inverse():
    x = np.array([[0.0, 0, 0], [5, 0, 0], [9, 1, 2]])
    y, noise = np.array([1.0, 2.0, 4.0]), np.array([0.1, 0.2, 0.3])
    kernel = lambda a, b: gp.changepoint_kernel(a, b, 10, 0.5, 3)
    low, alpha, lml, mean, scale = gp.fit(x, y, noise, kernel)
    k = kernel(x, x) + np.diag(noise)
    z = (y - y.mean()) / y.std()
    assert lml == pytest.approx(-0.5 * z @ np.linalg.inv(k) @ z - 0.5 * math.log(np.linalg.det(k)) - 1.5 * math.log(2 * math.pi))
    new = np.array([[7.0, 1, 1]])
    cross = kernel(new, x)
    m, s = gp.predict(low, alpha, mean, scale, cross, np.ones(1))
    assert m[0] == pytest.approx(y.mean() + y.std() * (cross @ np.linalg.inv(k) @ z)[0])
    assert s[0] == pytest.approx(y.std() * math.sqrt(1 - (cross @ np.linalg.inv(k) @ cross.T)[0, 0]))


def test_regional_kernel_is_a_valid_covariance():
    gen = np.random.default_rng(1)
    days, kind = gen.uniform(0, 100, 20), gen.integers(-1, 3, 20)
    r = np.exp(-np.abs(days[:, None] - days) / 30)
    k = gp.regional_kernel(days, kind, days, kind, {0: 0.5, 1: 0.3, 2: 0.2}, r, 0.5 * r)
    assert np.allclose(k, k.T) and np.linalg.eigvalsh(k).min() > -1e-9


def test_trend_follows_its_data_and_weights_add_up(spark):
    obs = spark.createDataFrame([("s", 7 * i, 0, 0, math.sin(i / 8), 0.01) for i in range(60)], "s string, bin_day int, regime int, campaign int, y double, v double")
    lml = gp.two_stage_grid(obs, ["s"], [20, 100], [0.01, 0.1], [1.0], [1])
    members = gp.ensemble(lml, ["s"])
    assert members.agg(F.sum("weight")).first()[0] == pytest.approx(1)
    line = gp.trend(obs, members, obs.select("bin_day", "regime", "campaign"), ["s"]).orderBy("bin_day").collect()
    assert max(abs(r["mean"] - math.sin(r.bin_day / 56)) for r in line) < 0.1
    assert gp.two_stage_grid(obs.limit(0), ["s"], [20], [0.1], [1.0], [1]).count() == 0


def test_slices_constraints_and_closed_arrays(spark):
    old = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), ("b", 4)], "k string, v int")
    new = spark.createDataFrame([("a", 9), (None, 8), ("c", 7)], "k string, v int")
    once = relational.replace_slice(old, new, ["k"])
    assert sorted(map(str, once.collect())) == sorted(map(str, relational.replace_slice(once, new, ["k"]).collect()))
    assert sorted(r.v for r in once.collect()) == [4, 7, 8, 9] and relational.replace_slice(old.limit(0), new, ["k"]).count() == 3
    assert relational.repeated(old, ["k"]).first().n_broken == 1 and relational.repeated(old.limit(0), ["k"]).first().n_broken == 0
    assert relational.dangling(old, new, ["k"]).first().n_broken == 2 and relational.dangling(old.limit(0), new, ["k"]).first().n_broken == 0
    parts = spark.createDataFrame([(1.0, 3.0), (0.0, 0.0), (None, 1.0)], "x double, y double")
    assert [r.c for r in parts.select(comp.closed_array([F.col("x"), F.col("y")]).alias("c")).collect()] == [[0.25, 0.75], None, None]


def test_pages_are_walked_in_order(spark):
    html = "<h2>A</h2><p>x&nbsp;y</p><h3>B</h3><table><tr><th>H</th></tr><tr><td>1<td><a href='http://u'>2</a></td></table><h2>C</h2><li>z"
    df = spark.createDataFrame([("t", 1, html, 1), ("t", 2, None, 1), ("t", 3, "", 1), ("t", 4, "<<p>" + "<b>" * 20000, 1)], "title string, revid long, html string, pos int")
    got = [tuple(r)[3:] for r in pages.blocks(df).where("revid = 1").orderBy("pos").collect()]
    assert got == [("A", "p", -1, -1, -1, "x y", None), ("A > B", "th", 0, 0, 0, "H", None), ("A > B", "td", 0, 1, 0, "1", None), ("A > B", "td", 0, 1, 1, "2", "http://u"), ("C", "li", -1, -1, -1, "z", None)]


def test_file_sources_and_document(spark, tmp_path):
    (tmp_path / "poll_24001.csv").write_text("a,b\n1,x\n")
    (tmp_path / "poll_24002.csv").write_text('a,b\n2,"y, z"\n')
    shards = files.read_csv_shards(spark, str(tmp_path / "*.csv"), "a int, b string", "fed")
    assert sorted(map(tuple, shards.collect())) == [(1, "x", "24001"), (2, "y, z", "24002")]
    assert files.read_json_records(spark, str(tmp_path / "none.json"), "a int", optional=True).count() == 0
    files.write_document({"s": shards, "big": spark.range(5)}, str(tmp_path / "doc"), max_rows=3)
    document = {r.section: r for r in spark.read.json(str(tmp_path / "doc" / "document")).collect()}
    assert len(document["s"].rows) == 2 and document["big"].rows is None and (document["big"].path, document["big"].n_rows) == ("big", 5) and os.path.isdir(tmp_path / "doc" / "big")
    files.write_document({"x": spark.range(2), "y": spark.range(5)}, str(tmp_path / "ids"), max_rows=3)
    assert sorted(map(tuple, files.read_document(spark, str(tmp_path / "ids"), "id long").select("section", "id").collect())) == [("x", 0), ("x", 1), *(("y", i) for i in range(5))]
    files.write_records(shards, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_watch_keeps_the_newest_and_guards_stop_before_writing(spark, tmp_path):
    import datetime as dt

    schema = "title string, revid long, fetched_at timestamp_ntz, html string"
    at = dt.datetime(2020, 1, 1)
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    put([("a", 1, at, "x"), ("b", 5, at, "y"), (None, 1, at, "z")])
    state = str(tmp_path / "state")
    assert watch.watch(stream(), state).count() == 2
    put([("a", 3, at, "x"), ("a", 2, at, "w")])
    assert watch.watch(stream(), state).count() == 2
    rows = {r.title: (r.revid, r.n_changes) for r in watch.watch(stream(), state).collect()}
    assert rows == {"a": (3, 1), "b": (5, 1)}
    put([("a", 9, at, None)])
    with pytest.raises(Exception, match="pages are empty"):
        watch.watch(stream(), state, max_blank=0.5)
    assert watch.latest_version(spark, state + "/pages") == 2


def test_table_watch_has_two_gates_scoped_removal_and_guards(spark, tmp_path):
    seen, shares = "title string, revid long", "title string, revid long, poll_id string, party_code string, pct_reported double"
    poll = lambda t, r, p, a: [(t, r, p, "X", a), (t, r, p, "Y", 100.0 - a)]
    table = poll("a", 1, "p1", 40.0) + poll("b", 1, "q1", 30.0) + poll("a", 2, "p1", 41.0) + poll("a", 2, "p2", 50.0) + poll("a", 2, "p2", 50.0)
    table += [x for i in range(8) for x in poll("c", 1, f"r{i}", 45.0)] + poll("c", 2, "r0", 45.0) + [("a", 3, "p1", "X", 41.0), ("a", 3, "p1", "Y", 9.0)]
    df = spark.createDataFrame(table, shares)
    state = str(tmp_path / "state")
    batch = lambda rows, n, **k: watch.process_tables(df, state, **k)(spark.createDataFrame(rows, seen), n)
    read = lambda: {(r.title, r.poll_id, r.party_code): r.pct for r in watch._latest(watch.read_versions(spark, f"{state}/rows", watch.latest_version(spark, f"{state}/rows"), watch._ROWS), "title", "poll_id", "party_code").where("NOT gone").collect()}
    batch([("a", 1), ("b", 1), ("c", 1), (None, 1)], 0)
    assert len(read()) == 20
    batch([("a", 2), ("a", 1)], 1)
    rows = read()
    assert rows["a", "p1", "X"] == 41.0 and len([k for k in rows if k[0] == "a"]) == 4 and ("b", "q1", "X") in rows  # b wasn't read, so it lost nothing
    for _ in range(2):  # a repeated batch changes nothing
        batch([("a", 1)], 2)
        assert read() == rows
    batch([("c", 2)], 3, dry_run=True)
    assert read() == rows and spark.read.parquet(f"{state}/plan/version=4").where("change = 'removed'").count() == 14
    with pytest.raises(watch.GuardViolation, match="c loses polls: 7"):
        batch([("c", 2)], 3)
    with pytest.raises(watch.GuardViolation, match="a has a poll with a wrong sum: 50"):
        batch([("a", 3)], 3)
    assert read() == rows
    batch([("c", 2), ("a", 3)], 3, force=True)
    assert read() == {("b", "q1", "X"): 30.0, ("b", "q1", "Y"): 70.0, ("c", "r0", "X"): 45.0, ("c", "r0", "Y"): 55.0, ("a", "p1", "X"): 41.0, ("a", "p1", "Y"): 9.0}


def test_poll_tables_of_pages(spark):
    head = "<tr><th>Date</th><th>Firme</th><th>Échantillon</th><th>ALB</th><th>PRN</th><th>LPN</th></tr>"
    row = lambda *cells: "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"
    good = row("7 mars 2021[1]", "Firme&nbsp;A*", "1&#8239;149", "34,5&nbsp;%", "28[b]", "–")
    table = f"<table>{head}{good}{row('Débat des chefs')}{row('2021-02-30', 'B', '900', '30', '31', '9')}{row('2021-03-09', 'C', '', '30', '–', '')}{row('2021-03-10', 'D &amp; fils', '', '0', '31', '')}</table>"
    html = f"<h2>Sondages</h2><h3>Ensemble</h3>{table}<h3>Par région</h3><table>{head}{good}</table><table><tr><th>x</th></tr><tr><td>1</td></tr></table>"
    df = spark.createDataFrame([("t", 1, html), ("u", 1, f"<h2>Z</h2><table>{head}{good}</table>"), ("v", 1, None)], "title string, revid long, html string")
    rows = pages.poll_tables(pages.blocks(df), ["ALB", "PRN", "LPN"], ["region"])
    got = {(r.title, r.firm): (str(r.poll_date), r.sample_size, r.shares) for r in rows.collect()}
    assert got == {("t", "Firme A"): ("2021-03-07", 1149, {"ALB": 34.5, "PRN": 28.0}), ("u", "Firme A"): ("2021-03-07", 1149, {"ALB": 34.5, "PRN": 28.0}), ("t", "D & fils"): ("2021-03-10", None, {"ALB": 0.0, "PRN": 31.0})}
    assert sorted((r.title, r.firm) for r in pages.first_seen(rows).collect()) == [("t", "D & fils"), ("t", "Firme A")]
    assert pages.poll_tables(pages.blocks(df.limit(0)), ["ALB"], []).count() == 0


def test_held_out_bins_are_foretold_from_the_others(spark):
    rng = np.random.default_rng(3)
    rows = [("s", int(7 * i), int(i > 6), 0, float(np.sin(i / 3) + rng.normal() / 10), 0.01 + 0.01 * (i % 3)) for i in range(12)]
    rows += [("short", 0, 0, 0, 1.0, 0.1)]
    obs = spark.createDataFrame(rows, "s string, bin_day int, regime int, campaign int, y double, v double")
    models = [("changepoint", 40.0, 0.2, 0.5, 2.0), ("two_scale", 40.0, 0.2, 0.5, 2.0), ("wiener", 40.0, 0.2, 1.0, 2.0)]
    tasks = gp.sequential_tasks(obs, ["s"], 8)
    found = {(r.kernel, r.bin_day): r for r in gp.held_out(tasks, ["s"], models).collect()}
    assert {k[1] for k in found} == {56, 63, 70, 77} and len(found) == 12
    data = np.array([r[1:] for r in rows[:-1]], dtype=float)
    for name, length, noise, rho, dilation in models:
        k = lambda a, b: gp.KERNELS[name](a, b, length, rho, dilation)  # noqa: B023, E731
        x, y, v = data[:10, :3], data[:10, 3], data[:10, 4]
        inverse = np.linalg.inv(k(x, x) + np.diag(noise * v / v.min()))
        new = data[10:11, :3]
        cross = k(new, x)
        mean = y.mean() + cross @ inverse @ (y - y.mean())
        var = y.std() ** 2 * (k(new, new) - cross @ inverse @ cross.T + noise * data[10, 4] / v.min())
        assert found[name, 70].mean == pytest.approx(float(mean[0]), abs=1e-6)
        assert found[name, 70].sd == pytest.approx(float(np.sqrt(var[0, 0])), abs=1e-6)
    folds = gp.fold_tasks(obs.where("s = 's'"), ["s"], 3).collect()
    assert sorted(o.bin_day for f in folds for o in f.test) == [r[1] for r in rows[:-1]]
    assert all(len(f.train) + len(f.test) == 12 for f in folds)
    table = gp.scores(gp.held_out(tasks, ["s"], models[:1]), ["s"]).collect()
    assert len(table) == 1 and table[0].n == 4 and table[0].crps > 0
    assert gp.held_out(gp.sequential_tasks(obs.limit(0), ["s"]), ["s"], models).count() == 0


def test_ridge_on_halves_equals_the_dense_solution(spark):
    gen = np.random.default_rng(5)
    x = gen.normal(size=(60, 2)) * [1, 20]
    y = 1 + x @ [0.5, -0.1] + gen.normal(size=60) / 5
    rows = [(f"k{i}", float(a), float(b), float(c), 7.0, "z") for i, ((a, b), c) in enumerate(zip(x, y))]
    df = spark.createDataFrame([*rows, ("k0", None, 1.0, 1.0, 7.0, "z"), (None, 1.0, 1.0, 1.0, 7.0, "z")], "id string, a double, b double, y double, c double, repeat string")
    features = ["a", "b", "c"]
    models = {r.repeat: r for r in regression.half_models(df, "id", features, ["y"], 4, 1.0).collect()}
    halves = df.dropna().select("id", *[regression.is_train(F.col("id"), F.lit(r), 1).alias(str(r)) for r in range(4)]).collect()
    fits = []
    for r, model in models.items():
        train = np.array([h[str(r)] for h in sorted(halves, key=lambda h: int(h.id[1:]))])
        full = np.column_stack([x, np.full(60, 7.0)])
        mean, sd = full[train].mean(0), np.array([*x[train].std(0, ddof=1), 1.0])
        z = (full - mean) / sd
        beta = np.linalg.solve(z[train].T @ z[train] + np.eye(3), z[train].T @ (y[train] - y[train].mean()))
        assert model.slope == pytest.approx((beta / sd).tolist(), abs=1e-8)
        held = ~train
        fits.append(1 - ((y[held] - y[train].mean() - z[held] @ beta) ** 2).sum() / ((y[held] - y[train].mean()) ** 2).sum())
    found = regression.holdout_r2(df, "id", features, ["y"], 4).first()
    assert found.repeats == 4 and found.r2 == pytest.approx(np.mean(fits)) and found.r2 > 0.9
    assert regression.holdout_r2(df.limit(0), "id", features, ["y"], 4).count() == 0
