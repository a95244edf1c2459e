"""References to records that are missing, dropped or listed only later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.text import is_blank, name_key, riding_code, trim_spaces
from tallyforge.session import broadcast_if_small, checkpoint

KEY = ["scope", "ref_key"]

#: A key is heavy when it holds more than 1 / HEAVY_PARTS of all references: there are fewer than HEAVY_PARTS such keys.
HEAVY_PARTS = 64
#: Most rows that are broadcast for the heavy keys; beyond, they take the shuffle as well.
BROADCAST_ROWS = 200_000


def riding_references(byelections: DataFrame, leaders: DataFrame, incumbents: DataFrame) -> DataFrame:
    """All riding references as (table_name, row_id, scope, ref_key, day); null and blank references are none.

    By-elections refer within their own map, by number where the value starts with a digit; leaders and
    incumbents to any map, scope '*'. A row whose day is null or no date has a null day and matches nothing.
    """
    text = trim_spaces(F.col("riding_code"))
    by = byelections.where(~is_blank(F.col("riding_code"))).select(
        F.lit("qc_byelections").alias("table_name"), F.col("row_id").cast("long").alias("row_id"),
        F.coalesce(F.col("boundary_year").cast("string"), F.lit("")).alias("scope"),
        F.when(text.rlike("^[0-9]"), F.concat(F.lit("c:"), riding_code(text))).otherwise(F.concat(F.lit("n:"), name_key(text))).alias("ref_key"),
        trim_spaces(F.col("election_date")).try_cast("date").alias("day"),
    )
    parts = [by]
    for name, df in (("qc_leaders", leaders), ("qc_incumbents", incumbents)):
        parts.append(
            df.where(~is_blank(F.col("riding_name"))).select(
                F.lit(name).alias("table_name"), F.col("row_id").cast("long").alias("row_id"), F.lit("*").alias("scope"),
                F.concat(F.lit("n:"), name_key(F.col("riding_name"))).alias("ref_key"), F.to_date("scraped_at").alias("day"),
            )
        )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def riding_listings(names: DataFrame) -> DataFrame:
    """The listed periods as (scope, ref_key, valid_from, valid_to), once per map by name and number and once for any map."""
    name = F.concat(F.lit("n:"), name_key(F.col("riding_name")))
    code = F.concat(F.lit("c:"), riding_code(F.col("riding_code")))
    keys = F.array(
        F.struct(F.col("boundary_year").cast("string").alias("scope"), name.alias("ref_key")),
        F.struct(F.col("boundary_year").cast("string").alias("scope"), code.alias("ref_key")),
        F.struct(F.lit("*").alias("scope"), name.alias("ref_key")),
    )
    return (
        names.select(F.explode(keys).alias("k"), F.col("listed_on").alias("valid_from"), F.col("delisted_on").alias("valid_to"))
        .select("k.scope", "k.ref_key", "valid_from", "valid_to")
        .where("scope IS NOT NULL AND ref_key IS NOT NULL AND valid_from IS NOT NULL")
        .distinct()
    )


def _covered(days: DataFrame, listings: DataFrame, how: str) -> DataFrame:
    a, b = days.alias("a"), listings.alias("b")
    on = (
        (F.col("a.scope") == F.col("b.scope")) & (F.col("a.ref_key") == F.col("b.ref_key"))
        & (F.col("b.valid_from") <= F.col("a.day")) & (F.col("b.valid_to").isNull() | (F.col("a.day") < F.col("b.valid_to")))
    )
    return a.join(b, on, how)


def heavy_keys(usage: DataFrame) -> DataFrame:
    """The fewer than HEAVY_PARTS keys above their share of all references, from the counts per key."""
    total = usage.agg(F.sum("n")).scalar()
    return usage.groupBy(*KEY).agg(F.sum("n").alias("n")).where(F.col("n") * HEAVY_PARTS > total).select(*KEY)


def orphan_days(usage: DataFrame, heavy: DataFrame, listings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts of keys and days without a valid listing: those of heavy keys by a broadcast check, the rest by a shuffled anti join."""
    heavy = F.broadcast(heavy)  # fewer than HEAVY_PARTS rows by construction
    heavy_listings = broadcast_if_small(listings.join(heavy, KEY, "left_semi"), BROADCAST_ROWS)
    hot = _covered(usage.join(heavy, KEY, "left_semi"), heavy_listings, "left_anti")
    cold = _covered(usage.join(heavy, KEY, "left_anti"), listings, "left_anti")
    return hot, cold


def orphan_rows(refs: DataFrame, listings: DataFrame) -> DataFrame:
    """Every reference without a listing valid on its day: (table_name, period, row_id); period is null for a null day.

    The keys and days that the counts show as orphans go back to their rows, those of heavy keys by broadcast. References are worked
    out once and written, which costs less than to work out their keys three times. Duplicates each come out. Empty references or listings work: with no listing every reference is an orphan.
    """
    refs, listings = checkpoint(refs), checkpoint(listings)
    usage = checkpoint(refs.groupBy(*KEY, "day").agg(F.count(F.lit(1)).alias("n")))
    heavy = checkpoint(heavy_keys(usage))
    hot, cold = (part.select(*KEY, "day") for part in orphan_days(usage, heavy, listings))
    heavy = F.broadcast(heavy)

    def rows(part: DataFrame, days: DataFrame) -> DataFrame:
        a, b = part.alias("a"), days.alias("b")
        on = (F.col("a.scope") == F.col("b.scope")) & (F.col("a.ref_key") == F.col("b.ref_key")) & F.col("a.day").eqNullSafe(F.col("b.day"))
        return a.join(b, on, "left_semi")

    hot = broadcast_if_small(checkpoint(hot), BROADCAST_ROWS)
    found = rows(refs.join(heavy, KEY, "left_semi"), hot).unionByName(rows(refs.join(heavy, KEY, "left_anti"), cold))
    return found.select("table_name", F.date_format("day", "yyyy-MM").alias("period"), "row_id")


def orphan_counts(refs: DataFrame, listings: DataFrame) -> DataFrame:
    """Orphan references per table and month, from the pre-aggregated days alone: (table_name, period, n_rows, n_keys). References are read once."""
    usage = checkpoint(refs.groupBy("table_name", *KEY, "day").agg(F.count(F.lit(1)).alias("n")))
    hot, cold = orphan_days(usage, checkpoint(heavy_keys(usage)), listings)
    return (
        hot.unionByName(cold)
        .groupBy("table_name", F.date_format("day", "yyyy-MM").alias("period"), *KEY).agg(F.sum("n").alias("n"))
        .groupBy("table_name", "period").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"))
    )
