"""Queries do the whole job: as many draws, cells, words and elections as their operators ask for."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import gp
from tallyforge.plans import elections, evaluation, trends

DATA = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@needs_tables
def test_simulation_runs_all_draws(spark):
    seats = elections.seat_sim_counts(spark, DATA).groupBy("boundary_year").agg(F.count("draw").alias("n"), F.min("draw").alias("first"), F.max("draw").alias("last")).collect()
    assert seats and {(r.n, r.first, r.last) for r in seats} == {(5000, 0, 4999)}


def test_trends_search_the_whole_grid_on_weekly_bins(spark, monkeypatch):
    asked = {}
    monkeypatch.setattr(gp, "_likelihoods", lambda packed, grid, keys, kernel: asked.setdefault(len(asked), grid).selectExpr("*", "-abs(noise - 0.5) * 100 AS lml"))
    weekly = spark.createDataFrame([("r", "z1", 7 * i, 0, 0, float(i % 3), 0.1) for i in range(12)], "region_code string, coord string, bin_day int, regime int, campaign int, y double, v double")
    monkeypatch.setattr(trends, "_observations", lambda spark, folder: weekly)
    trends.gp_grid(spark, "").collect()
    assert trends.BIN_DAYS == 7 and [asked[i].count() for i in (0, 1)] == [154, 280]


def test_shared_kernel_likelihoods_equal_the_fit():
    gen = np.random.default_rng(2)
    x = np.column_stack([np.arange(40) * 7.0, np.arange(40) // 20, np.minimum(np.arange(40), 9)])
    y, rel = gen.normal(size=40), gen.uniform(1, 3, 40)
    kernel = lambda a, b: gp.changepoint_kernel(a, b, 50, 0.4, 4)
    found = gp.log_likelihoods(y, [0.005 * rel, 2 * rel], kernel(x, x))
    assert found == pytest.approx([gp.fit(x, y, n * rel, kernel)[2] for n in (0.005, 2)])
    assert gp.log_likelihoods(y, [-5 * rel], kernel(x, x)) == [None]


def test_held_out_cells_are_chosen_from_the_grid_by_the_training_bins(spark):
    row = lambda i: (7 * i, 0, 0, float(np.sin(i / 3)), 0.01)
    obs = spark.createDataFrame([("s", *row(i)) for i in range(20)], "s string, bin_day int, regime int, campaign int, y double, v double")
    tasks = gp.sequential_tasks(obs, ["s"], 8)
    cells = gp.chosen(tasks, ["s"], gp.doubling(8), [20, 100], [0.01, 1], [0.4, 1.0], [1]).collect()
    assert len(cells) == 12 * 3 and len({(r.kernel, r.task) for r in cells}) == 36
    for r in cells:
        train = np.array([row(i) for i in range(8 if r.task < 16 else 16)])
        grid = [(length, noise) for length in (20.0, 100.0) for noise in (0.01, 1.0)]
        lml = lambda c: gp.fit(train[:, :3], train[:, 3], c[1] * np.ones(len(train)), lambda a, b: gp.KERNELS[r.kernel](a, b, c[0], 1.0, 1.0))[2]  # noqa: B023, E731
        assert (r.length, r.noise) == max(grid, key=lml)
    assert gp.held_out(tasks, ["s"], spark.createDataFrame(cells)).count() == 36


@needs_tables
def test_final_polls_of_every_election_are_scored(spark):
    found = {r.election for r in evaluation.final_poll_errors(spark, DATA.replace("sf0.001", "sf0.1")).collect()}
    assert found == {"2014-04-07", "2018-10-01", "2022-10-03"}
