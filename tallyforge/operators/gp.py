"""Gaussian-process trends over binned time: kernels and fits in numpy per grid cell, everything around them in Spark.

Observations are summed up per time bin first, so that a fit sees as many rows as the calendar has bins,
however many polls there are; bins carry their precision as noise. Each (series, grid cell) is one row of
work, spread over the cluster; no task sees more than one series.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.functions import rng, stats

# The grids of the search.
LENGTH_SCALES = [10, 20, 30, 50, 75, 110, 160, 230, 330, 470, 680, 1000, 1500, 2200]
NOISE_SCALES = [0.005, 0.01, 0.02, 0.05, 0.1, 0.25, 0.5, 1, 2, 4, 8]
RHOS = [0.15, 0.4, 0.7, 1.0]
DILATIONS = [1, 2, 4, 8, 16]
#: Noise scales within this of the best log likelihood go on to the second stage; members below this share of the weight are dropped.
KEEP_NATS, MIN_WEIGHT = 4.0, 1e-3
#: Variance share of the fast part in the kernel of two scales.
FAST_SHARE = 0.2


def changepoint_kernel(a: np.ndarray, b: np.ndarray, length: float, rho: float, dilation: float) -> np.ndarray:
    """Matern-3/2 on a clock that runs faster inside campaigns, times rho per regime apart. Rows are (day, regime, campaign days)."""
    dt = np.abs((a[:, 0][:, None] - b[:, 0]) + (dilation - 1) * (a[:, 2][:, None] - b[:, 2]))
    s = np.sqrt(3) * dt / length
    return (1 + s) * np.exp(-s) * rho ** np.abs(a[:, 1][:, None] - b[:, 1])


def _clock(x: np.ndarray, dilation: float) -> np.ndarray:
    return x[:, 0] + (dilation - 1) * x[:, 2]


def two_scale_kernel(a: np.ndarray, b: np.ndarray, length: float, rho: float, dilation: float) -> np.ndarray:
    """The changepoint kernel and a fast exponential one of a tenth of its length scale, which has FAST_SHARE of the variance."""
    dt = np.abs(_clock(a, dilation)[:, None] - _clock(b, dilation))
    return (1 - FAST_SHARE) * changepoint_kernel(a, b, length, rho, dilation) + FAST_SHARE * np.exp(-10 * dt / length)


def wiener_kernel(a: np.ndarray, b: np.ndarray, length: float, rho: float, dilation: float) -> np.ndarray:
    """A random walk on the campaign clock with a start of unit variance and one more unit per length scale; regimes play no part."""
    return 1 + np.maximum(np.minimum(_clock(a, dilation)[:, None], _clock(b, dilation)), 0) / length


KERNELS = {"changepoint": changepoint_kernel, "two_scale": two_scale_kernel, "wiener": wiener_kernel}


def regional_kernel(days_a: np.ndarray, kind_a: np.ndarray, days_b: np.ndarray, kind_b: np.ndarray, weights: dict[int, float], national: np.ndarray, regional: np.ndarray) -> np.ndarray:
    """Observations of a whole (kind -1) and its regions: national curve plus, between regions, w_r times or delta_rs times the regional one."""
    w = np.array([weights.get(int(k), 0.0) for k in np.concatenate([kind_a, kind_b])])
    wa, wb = w[: len(kind_a)], w[len(kind_a) :]
    na, nb = kind_a[:, None] < 0, kind_b[None, :] < 0
    total = sum(v * v for v in weights.values())
    factor = np.where(na & nb, total, np.where(na, wb[None, :], np.where(nb, wa[:, None], (kind_a[:, None] == kind_b[None, :]).astype(float))))
    return national + factor * regional


def fit(x: np.ndarray, y: np.ndarray, noise: np.ndarray, kernel) -> tuple[np.ndarray, np.ndarray, float, float, float]:
    """Cholesky factor, weights, log marginal likelihood, mean and scale of y (population sd, 1 if it is 0)."""
    mean, scale = float(y.mean()), float(y.std()) or 1.0
    z = (y - mean) / scale
    low = np.linalg.cholesky(kernel(x, x) + np.diag(noise) + 1e-10 * np.eye(len(x)))
    alpha = np.linalg.solve(low.T, np.linalg.solve(low, z))
    lml = -0.5 * z @ alpha - np.log(np.diag(low)).sum() - 0.5 * len(z) * np.log(2 * np.pi)
    return low, alpha, float(lml), mean, scale


def predict(low: np.ndarray, alpha: np.ndarray, mean: float, scale: float, cross: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior mean and sd (without observation noise) in units of y; cross is the kernel of new rows against the old."""
    v = np.linalg.solve(low, cross.T)
    return mean + scale * cross @ alpha, scale * np.sqrt(np.maximum(prior - (v * v).sum(0), 1e-12))


def binned(observations: DataFrame, series: Sequence[str], day: str, value: str, variance: str, days: int = 7) -> DataFrame:
    """Precision-weighted means per series and bin: (series, bin_day, y, v, n). Rows with a null or a variance not above 0 are left out."""
    ok = observations.where(F.col(day).isNotNull() & F.col(value).isNotNull() & (F.col(variance) > 0))
    number = (F.floor(F.unix_date(day) / days) * days).cast("int").alias("bin_day")
    w = 1 / F.col(variance)
    return ok.groupBy(*series, number).agg((F.sum(w * F.col(value)) / F.sum(w)).alias("y"), (1 / F.sum(w)).alias("v"), F.count(F.lit(1)).alias("n"))


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of heavy work over all cores; the number is given, as small rows would be put together again."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def _cells(observations: DataFrame, grid: DataFrame, series: Sequence[str]) -> DataFrame:
    """Each grid row with its series as arrays, one per bin; a series is as long as the calendar."""
    return _spread(grid.join(_packed(observations, series), list(series)), *series, "length", "noise", "rho", "dilation")


def _unpack(obs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = np.array([(o["bin_day"], o["regime"], o["campaign"], o["y"], o["v"]) for o in obs], dtype=float)
    x, y, v = rows[:, :3], rows[:, 3], rows[:, 4]
    x[:, 0] -= x[0, 0]
    return x, y, v / v.min()


def log_likelihoods(y: np.ndarray, noises: Sequence[np.ndarray], k: np.ndarray) -> list[float | None]:
    """Log marginal likelihood as in `fit` for each noise under one kernel matrix, None where it can't be factored.

    y is a further row of the matrix, so that its factor's last row is the solved vector.
    """
    n = len(y)
    z = (y - y.mean()) / (float(y.std()) or 1.0)
    out = []
    for noise in noises:
        whole = np.empty((n + 1, n + 1))
        whole[:n, :n] = np.where(k < 1e-30, 0.0, k)  # as good as nothing, but subnormal products are slow
        whole[range(n), range(n)] += noise + 1e-10
        whole[n, :n] = whole[:n, n] = z
        whole[n, n] = 1e300
        try:
            low = np.linalg.cholesky(whole)
        except np.linalg.LinAlgError:
            out.append(None)
            continue
        out.append(float(-0.5 * low[n, :n] @ low[n, :n] - np.log(np.diag(low)[:n]).sum() - 0.5 * n * np.log(2 * np.pi)))
    return out


def _likelihoods(packed: DataFrame, grid: DataFrame, keys: Sequence[str], kernel: str) -> DataFrame:
    """As `grid_likelihoods`, from packed series (keys, obs). The cells of one length scale are one row of work and share their kernel matrices."""
    columns = [*keys, "length", "noise", "rho", "dilation", "lml"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples():
                x, y, rel = _unpack(row.obs)
                noises = defaultdict(list)
                for c in row.cells:
                    noises[c["rho"], c["dilation"]].append(c["noise"])
                for (rho, dilation), some in noises.items():
                    k = KERNELS[kernel](x, x, row.length, rho, dilation)
                    for noise, lml in zip(some, log_likelihoods(y, [v * rel for v in some], k)):
                        if lml is not None:
                            out.append((*(getattr(row, c) for c in keys), row.length, noise, rho, dilation, lml))
            yield pd.DataFrame(out, columns=columns)

    kinds = dict(packed.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keys), "length double, noise double, rho double, dilation double, lml double"])
    work = grid.groupBy(*keys, "length").agg(F.collect_list(F.struct("noise", "rho", "dilation")).alias("cells"))  # as many as the grid has
    return _spread(work.join(packed, list(keys)), *keys, "length").mapInPandas(run, schema)


def grid_likelihoods(observations: DataFrame, grid: DataFrame, series: Sequence[str]) -> DataFrame:
    """Log marginal likelihood of each grid row: (series, length, noise, rho, dilation, lml); cells that can't be factored are left out.

    observations: (series, bin_day, regime, campaign, y, v); grid: (series, length, noise, rho, dilation).
    """
    return _likelihoods(_packed(observations, series), grid, series, "changepoint")


def _search(packed: DataFrame, keys: Sequence[str], lengths: Sequence[float], noises: Sequence[float], rhos: Sequence[float], dilations: Sequence[float], kernel: str = "changepoint") -> DataFrame:
    values = lambda xs: F.explode(F.array(*[F.lit(float(x)) for x in xs]))
    stationary = packed.select(*keys).withColumn("length", values(lengths)).withColumn("noise", values(noises)).withColumn("rho", F.lit(1.0)).withColumn("dilation", F.lit(1.0))
    first = _likelihoods(packed, stationary, keys, kernel).groupBy(*keys, "noise").agg(F.max("lml").alias("lml"))
    kept = first.withColumn("top", F.max("lml").over(Window.partitionBy(*keys))).where(F.col("lml") >= F.col("top") - KEEP_NATS).select(*keys, "noise")
    joint = kept.withColumn("length", values(lengths)).withColumn("rho", values(rhos)).withColumn("dilation", values(dilations))
    return _likelihoods(packed, joint, keys, kernel)


def two_stage_grid(
    observations: DataFrame, series: Sequence[str], lengths: Sequence[float] = LENGTH_SCALES, noises: Sequence[float] = NOISE_SCALES,
    rhos: Sequence[float] = RHOS, dilations: Sequence[float] = DILATIONS,
) -> DataFrame:
    """Stationary grid first, then the joint one for the noise scales that stay near the best: likelihoods of the joint grid."""
    return _search(_packed(observations, series), series, lengths, noises, rhos, dilations)


def ensemble(likelihoods: DataFrame, series: Sequence[str], lml: Column | None = None) -> DataFrame:
    """Likelihood weights per series, small ones dropped, the rest adding up to 1: the input with `weight`."""
    group = Window.partitionBy(*series)
    raw = likelihoods.withColumn("_l", lml if lml is not None else F.col("lml"))
    raw = raw.withColumn("_e", F.exp(F.col("_l") - F.max("_l").over(group)))
    kept = raw.withColumn("_rel", F.col("_e") / F.sum("_e").over(group)).where(F.col("_rel") >= MIN_WEIGHT)
    return kept.withColumn("weight", F.col("_e") / F.sum("_e").over(group)).drop("_l", "_e", "_rel")


def trend(observations: DataFrame, members: DataFrame, targets: DataFrame, series: Sequence[str]) -> DataFrame:
    """Mixture mean and sd of the ensemble at the target days: (series, bin_day, mean, sd).

    members: grid rows with weight; targets: (bin_day, regime, campaign), a calendar.
    """
    days = targets.groupBy().agg(F.array_sort(F.collect_list(F.struct("bin_day", "regime", "campaign"))).alias("days")).first()["days"]
    grid = np.array([(d["bin_day"], d["regime"], d["campaign"]) for d in days], dtype=float)  # as long as the calendar

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                x, y, rel = _unpack(row.obs)
                new = grid - np.array([float(row.obs[0]["bin_day"]), 0.0, 0.0])
                kernel = lambda a, b, r=row: changepoint_kernel(a, b, r.length, r.rho, r.dilation)
                low, alpha, _, mean, scale = fit(x, y, row.noise * rel, kernel)
                m, s = predict(low, alpha, mean, scale, kernel(new, x), np.ones(len(new)))
                yield pd.DataFrame({**{c: getattr(row, c) for c in series}, "bin_day": grid[:, 0].astype("int32"), "_w": row.weight, "_m": m, "_s": s})

    kinds = dict(observations.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in series), "bin_day int, _w double, _m double, _s double"])
    parts = _cells(observations, members, series).mapInPandas(run, schema)
    mean = F.sum(F.col("_w") * F.col("_m"))
    second = F.sum(F.col("_w") * (F.col("_s") * F.col("_s") + F.col("_m") * F.col("_m")))
    return parts.groupBy(*series, "bin_day").agg(mean.alias("mean"), second.alias("_second")).select(
        *series, "bin_day", "mean", F.sqrt(F.greatest(F.col("_second") - F.col("mean") * F.col("mean"), F.lit(1e-12))).alias("sd")
    )


def _packed(observations: DataFrame, series: Sequence[str]) -> DataFrame:
    rows = F.struct("bin_day", "regime", "campaign", "y", "v")
    return observations.groupBy(*series).agg(F.array_sort(F.collect_list(rows)).alias("obs"))  # as long as the calendar


def sequential_tasks(observations: DataFrame, series: Sequence[str], min_train: int = 8) -> DataFrame:
    """Leave-future-out splits: every bin after the first min_train is foretold from those before it. Shorter series have none.

    One row per series and split: (series, task, train, test).
    """
    cut = _packed(observations, series).where(F.size("obs") > min_train).withColumn("task", F.explode(F.sequence(F.lit(min_train), F.size("obs") - 1)))
    return cut.select(*series, "task", F.slice("obs", 1, F.col("task")).alias("train"), F.slice("obs", F.col("task") + 1, 1).alias("test"))


def fold_tasks(observations: DataFrame, series: Sequence[str], folds: int = 5, seed: int = 1) -> DataFrame:
    """Random folds of bins, each foretold from the others: (series, task, train, test). Splits with an empty side are left out."""
    fold = lambda o: F.floor(rng.uniform(seed, o["bin_day"].cast("long")) * folds).cast("int")
    cut = _packed(observations, series).withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    cut = cut.select(*series, "task", F.filter("obs", lambda o: fold(o) != F.col("task")).alias("train"), F.filter("obs", lambda o: fold(o) == F.col("task")).alias("test"))
    return cut.where("size(train) > 0 AND size(test) > 0")


def doubling(min_train: int = 8) -> Column:
    """The last task of `sequential_tasks`, at or before each, whose training part is min_train doubled some times."""
    refits = F.array(*[F.lit(min_train * 2**i) for i in range(24)])
    return F.array_max(F.filter(refits, lambda r: r <= F.col("task")))


def chosen(
    tasks: DataFrame, series: Sequence[str], refit: Column | None = None, lengths: Sequence[float] = LENGTH_SCALES, noises: Sequence[float] = NOISE_SCALES,
    rhos: Sequence[float] = RHOS, dilations: Sequence[float] = DILATIONS,
) -> DataFrame:
    """The likeliest cell of the two-stage grid for each split and kernel: (series, task, kernel, length, noise, rho, dilation).

    Only training bins are seen. refit: the task whose training part decides for a task, itself if not given. Regimes play
    no part in the random-walk kernel, which is searched at rho 1.
    """
    tasks = tasks.withColumn("refit", refit if refit is not None else F.col("task"))
    packed = tasks.where(F.col("task") == F.col("refit")).select(*series, "refit", F.col("train").alias("obs"))
    keys = [*series, "refit"]
    best = None
    for kernel in KERNELS:
        lml = _search(packed, keys, lengths, noises, [1.0] if kernel == "wiener" else rhos, dilations, kernel)
        one = lml.groupBy(*keys).agg(F.max(F.struct("lml", "length", "noise", "rho", "dilation")).alias("b")).withColumn("kernel", F.lit(kernel))
        best = one if best is None else best.unionByName(one)
    return tasks.select(*series, "task", "refit").join(best, keys).select(*series, "task", "kernel", "b.length", "b.noise", "b.rho", "b.dilation")


def held_out(tasks: DataFrame, series: Sequence[str], models: Sequence[tuple[str, float, float, float, float]] | DataFrame) -> DataFrame:
    """Predictions of the held-out bins: (series, kernel, task, bin_day, y, mean, sd), the sd with observation noise.

    tasks: as from `sequential_tasks` or `fold_tasks`; models: (kernel, length, noise, rho, dilation), one per kernel, or per split as from `chosen`.
    Splits that can't be factored are left out. Each (split, model) is one row of work.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                x, y, rel = _unpack(row.train)
                rows = np.array([(o["bin_day"], o["regime"], o["campaign"], o["y"], o["v"]) for o in row.test], dtype=float)
                new = rows[:, :3] - np.array([float(row.train[0]["bin_day"]), 0.0, 0.0])
                kernel = lambda a, b, r=row: KERNELS[r.kernel](a, b, r.length, r.rho, r.dilation)
                try:
                    low, alpha, _, mean, scale = fit(x, y, row.noise * rel, kernel)
                except np.linalg.LinAlgError:
                    continue
                m, s = predict(low, alpha, mean, scale, kernel(new, x), np.diag(kernel(new, new)))
                noise = row.noise * rows[:, 4] / min(o["v"] for o in row.train)
                yield pd.DataFrame({
                    **{c: getattr(row, c) for c in series}, "kernel": row.kernel, "task": row.task, "bin_day": rows[:, 0].astype("int32"),
                    "y": rows[:, 3], "mean": m, "sd": np.sqrt(s * s + scale * scale * noise),
                })

    kinds = dict(tasks.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in series), "kernel string, task int, bin_day int, y double, mean double, sd double"])
    names = ["kernel", "length", "noise", "rho", "dilation"]
    if isinstance(models, DataFrame):
        work = tasks.join(models, [*series, "task"])
    else:
        model = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, m)]) for m in models]))
        work = tasks.withColumn("_model", model).select(*tasks.columns, "_model.*")
    return _spread(work, *series, "kernel", "task").mapInPandas(run, schema)


def scores(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Held-out accuracy per key: (keys, n, mae, lpd, coverage90, crps), the last three for the normal predictive."""
    z = (F.col("y") - F.col("mean")) / F.col("sd")
    density = F.exp(-z * z / 2) / np.sqrt(2 * np.pi)
    crps = F.col("sd") * (z * (2 * stats.normal_cdf(z) - 1) + 2 * density - 1 / np.sqrt(np.pi))
    return predictions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("y") - F.col("mean"))).alias("mae"), F.avg(-z * z / 2 - F.log("sd") - 0.5 * np.log(2 * np.pi)).alias("lpd"),
        F.avg((F.abs(z) <= 1.6449).cast("double")).alias("coverage90"), F.avg(crps).alias("crps"),
    )
