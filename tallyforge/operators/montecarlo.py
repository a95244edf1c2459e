"""Monte Carlo seat simulation and its summaries, with counter-based draws that no retry or repartitioning can change."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.functions import composition as comp
from tallyforge.functions import rng


def simulate(
    ridings: DataFrame, residuals: DataFrame, parts: Sequence[str], group: str, n_draws: int, seed: int = 1,
    systemic_sd: float = 0.1, region_sd: float = 0.05, residual_scale: float = 1.0,
) -> DataFrame:
    """Winner of every riding in every draw: (group, draw, riding, region, winner).

    ridings: (group, riding, region, ord from 0, region_ord from 0, n_ridings, n_regions, parts); residuals: (group, idx from 0,
    n_residuals, r1 ... rk). A draw takes 2k calls for the common shock, 2k for each region and one for each riding,
    whose residual vector is picked whole. Draws are unfolded per riding, so work spreads over ridings and draws; of equal
    shares the first part wins. Ridings without residuals in their group get none; without a region, no regional shock.
    """
    k = len(parts) - 1
    coords = range(k)
    draws = F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1)))
    base = F.col("draw").cast("long") * (F.lit(2 * k) + 2 * k * F.col("n_regions") + F.col("n_ridings"))

    # the shocks are the same for all ridings of a region: they are drawn once and joined
    areas = ridings.select(group, "region", "region_ord", "n_regions", "n_ridings").distinct().withColumn("draw", draws).withColumn("base", base)
    first = lambda region: F.col("base") + (2 * k + 2 * k * F.col("region_ord") if region else 0)
    calls = {f"{kind}{j}{half}": first(kind == "g") + 2 * j + i + 1 for kind in "sg" for j in coords for i, half in enumerate("ab")}
    areas = rng.with_uniforms(areas, seed, calls)
    own = F.when(F.col("region").isNotNull(), F.lit(region_sd)).otherwise(F.lit(0.0))
    normal = lambda kind, j: rng.normal(F.col(f"{kind}{j}a"), F.col(f"{kind}{j}b"))
    areas = areas.select(group, F.col("region").alias("_region"), "draw", *[(normal("s", j) * systemic_sd + normal("g", j) * own).alias(f"shock{j}") for j in coords])

    pools = residuals.groupBy(group).agg(F.max("n_residuals").alias("pool"))
    drawn = ridings.withColumn("draw", draws).withColumn("base", base).withColumns({f"z{j}": z for j, z in enumerate(comp.ilr([F.col(p) for p in parts]))})
    drawn = rng.with_uniforms(drawn, seed, {"pick": F.col("base") + 2 * k + 2 * k * F.col("n_regions") + F.col("ord") + 1})
    drawn = drawn.join(pools, group, "left").withColumn("idx", F.floor(F.col("pick") * F.col("pool")))
    joined = drawn.join(residuals.drop("n_residuals"), [group, "idx"], "left").join(areas.withColumnRenamed(group, "_group"), (F.col(group) == F.col("_group")) & F.col("region").eqNullSafe(F.col("_region")) & (drawn["draw"] == areas["draw"])).drop(areas["draw"])
    joined = joined.withColumns({f"y{j}": F.col(f"z{j}") + F.col(f"shock{j}") + F.coalesce(F.col(f"r{j + 1}") * residual_scale, F.lit(0.0)) for j in coords})
    rows = comp.basis(len(parts))
    joined = joined.withColumns({f"l{i}": comp.total([F.lit(rows[j][i]) * F.col(f"y{j}") for j in coords if rows[j][i]]) for i in range(len(parts))})
    best = F.greatest(*[F.col(f"l{i}") for i in range(len(parts))])  # the order of log-ratios is that of shares
    winner = F.coalesce(*[F.when(F.col(f"l{i}") == best, F.lit(p.upper())) for i, p in enumerate(parts)])
    return joined.select(group, "draw", "riding", "region", winner.alias("winner"))


def seat_counts(winners: DataFrame, group: str, parties: Sequence[str]) -> DataFrame:
    """Seats per draw, dense: one column per party, zeros included."""
    return winners.groupBy(group, "draw").agg(*[F.sum((F.col("winner") == p).cast("long")).alias(p.lower()) for p in parties])


def long_counts(counts: DataFrame, group: str, parties: Sequence[str]) -> DataFrame:
    """(group, draw, party, ord, seats) from dense counts."""
    rows = F.array(*[F.struct(F.lit(p).alias("party"), F.lit(i).alias("ord"), F.col(p.lower()).alias("seats")) for i, p in enumerate(parties)])
    return counts.select(group, "draw", F.explode(rows).alias("e")).select(group, "draw", "e.*")


def win_probabilities(winners: DataFrame, group: str, n_draws: int) -> DataFrame:
    """(group, riding, party, p) of the parties that win a riding at least once."""
    return winners.groupBy(group, "riding", F.col("winner").alias("party")).agg((F.count(F.lit(1)) / n_draws).alias("p"))


def seat_distribution(counts: DataFrame, group: str, parties: Sequence[str]) -> DataFrame:
    """Histogram of seats per party: (group, party, seats, n, prob, height), height relative to the party's peak."""
    n = long_counts(counts, group, parties).groupBy(group, "party", "seats").agg(F.count(F.lit(1)).alias("n"))
    party = Window.partitionBy(group, "party")
    return n.withColumn("prob", F.col("n") / F.sum("n").over(party)).withColumn("height", F.col("n") / F.max("n").over(party))


def medoid(counts: DataFrame, group: str, parties: Sequence[str]) -> DataFrame:
    """The draw with the least total absolute distance in seats to all others, of equal ones the first: counts' columns and `distance`.

    The distance is a sum over parties, so each party's histogram, no wider than the house, stands in for all draws.
    """
    long = long_counts(counts, group, parties)
    bins = long.groupBy(group, "party", "seats").agg(F.count(F.lit(1)).alias("n"))
    table = bins.groupBy(group, "party").agg(F.collect_list(F.struct("seats", "n")).alias("bins"))  # as many entries as there are seat numbers
    cost = F.aggregate("bins", F.lit(0).cast("long"), lambda s, b: s + b["n"] * F.abs(b["seats"] - F.col("seats")))
    totals = long.join(table, [group, "party"]).withColumn("cost", cost).groupBy(group, "draw").agg(F.sum("cost").alias("distance"))
    best = totals.groupBy(group).agg(F.min(F.struct("distance", "draw")).alias("b")).select(group, "b.draw", "b.distance")
    return counts.join(best, [group, "draw"])


def scenarios(counts: DataFrame, group: str, parties: Sequence[str]) -> DataFrame:
    """Government scenarios, one per draw: (group, type, leader, balance, needs_opposition, opposition, n, probability).

    Majority, or minority with the smallest third party that makes one with the leader; where only the second
    party is large enough, needs_opposition. The opposition named is that of the class's first draw.
    """
    seats = [F.struct(F.col(p.lower()).alias("seats"), F.lit(-i).alias("o"), F.lit(p).alias("party")) for i, p in enumerate(parties)]
    ranked = F.sort_array(F.filter(F.array(*seats), lambda s: s["seats"] > 0), asc=False)
    df = counts.withColumn("r", ranked).withColumn("house", F.aggregate("r", F.lit(0).cast("long"), lambda a, s: a + s["seats"])).where(F.size("r") > 0)
    threshold = F.floor(F.col("house") / 2) + 1
    leader, second = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    needed = threshold - leader["seats"]
    third = F.array_sort(F.transform(F.filter(F.slice("r", 3, len(parties)), lambda s: s["seats"] >= needed), lambda s: F.struct(s["seats"].alias("seats"), (-s["o"]).alias("o"), s["party"].alias("party"))))
    majority = leader["seats"] >= threshold
    balance = F.when(~majority, F.get(third, F.lit(0))["party"])
    needs = ~majority & balance.isNull() & F.coalesce(leader["seats"] + second["seats"] >= threshold, F.lit(False))
    per_draw = df.select(group, "draw", F.when(majority, "majority").otherwise("minority").alias("type"), leader["party"].alias("leader"), balance.alias("balance"), needs.alias("needs_opposition"), second["party"].alias("opposition"))
    classes = per_draw.groupBy(group, "type", "leader", "balance", "needs_opposition").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("draw", "opposition"))["opposition"].alias("opposition"))
    return classes.withColumn("probability", F.col("n") / F.sum("n").over(Window.partitionBy(group)))


def gallagher(votes: Sequence[Column], seats: Sequence[Column]) -> Column:
    """Least-squares disproportion of two share vectors, in the shares' unit."""
    return F.sqrt(comp.total([(v - s) * (v - s) for v, s in zip(votes, seats)]) / 2)
