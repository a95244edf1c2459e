"""Strict loading of comma-separated records, with the rest diagnosed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.text import SPACES, french_date, locale_number, trim_spaces

# The nine fields of a poll record, in order.
FIELDS = ["poll_date", "firm", "sample_size", "PRN", "ALB", "UCD", "MVT", "LPN", "note"]

#: Stands for a separating comma once quoted text has been set apart; control characters of this kind inside text are dropped.
_MARK = "\u0001"


def _pieces(line: Column) -> Column:
    """The line cut at its quotes: pieces of even position lie outside quotes, of odd position inside."""
    return F.split(F.replace(F.coalesce(line, F.lit("")), F.lit(_MARK), F.lit("")), '"')


def _middle(pieces: Column) -> Column:
    """All pieces but the first and last; lambdas over it refer to nothing outside, which would be worked out anew for each piece."""
    return F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 2, F.lit(0)))


def well_quoted(pieces: Column) -> Column:
    """Quotes are paired, open right after a separator and close right before one, or are doubled inside a quoted field."""
    n = F.size(pieces)
    outside = F.filter(_middle(pieces), lambda p, i: i % 2 == 1)
    first, last = F.get(pieces, F.lit(0)), F.get(pieces, n - 1)
    return (n == 1) | (
        (n % 2 == 1) & ((first == "") | first.endswith(","))
        & ((last == "") | last.startswith(","))
        & F.forall(outside, lambda p: (p == "") | (p.startswith(",") & p.endswith(",")))
    )


def fields(pieces: Column) -> Column:
    """Field values of a well-quoted record: outer quotes off, doubled ones single, commas and line breaks inside kept."""
    apart = lambda p: F.replace(p, F.lit(","), F.lit(_MARK))
    middle = F.transform(_middle(pieces), lambda p, i: F.when(i % 2 == 0, p).when(p == "", F.lit('"')).otherwise(apart(p)))
    last = F.when(F.size(pieces) > 1, apart(F.element_at(pieces, -1))).otherwise("")
    return F.split(F.concat(apart(F.get(pieces, F.lit(0))), F.array_join(middle, ""), last), _MARK)


def valid_sample(text: Column) -> Column:
    """Blank, or a whole number above 0 in digits alone, spaces of any kind aside."""
    bare = F.regexp_replace(text, rf"[{SPACES}]+", "")
    return (bare == "") | (bare.rlike("^[0-9]+$") & ~bare.rlike("^0+$"))


def _parsed(raw: DataFrame) -> DataFrame:
    pieces = raw.withColumn("_pieces", _pieces(F.col("raw_line")))
    return pieces.withColumn("_quoted", well_quoted(F.col("_pieces"))).withColumn("_fields", fields(F.col("_pieces")))


def strict_load(raw: DataFrame) -> DataFrame:
    """Conforming records only, typed: line_id, title, then the nine fields; a blank sample is null.

    Shares that are no number (a dash) are null: they are no reason to refuse a record. Samples beyond a long are refused as invalid by nobody and load as null.
    """
    ok = F.col("_quoted") & (F.size("_fields") == len(FIELDS)) & french_date(F.get("_fields", F.lit(0))).isNotNull() & valid_sample(F.get("_fields", F.lit(2)))
    shares = [locale_number(F.get("_fields", F.lit(i))).alias(FIELDS[i]) for i in range(3, 8)]
    return _parsed(raw).where(F.coalesce(ok, F.lit(False))).select(
        "line_id", "title", french_date(F.get("_fields", F.lit(0))).alias("poll_date"), trim_spaces(F.get("_fields", F.lit(1))).alias("firm"),
        F.regexp_replace(F.get("_fields", F.lit(2)), rf"[{SPACES}]+", "").try_cast("long").alias("sample_size"),
        *shares, F.get("_fields", F.lit(8)).alias("note"),
    )


def rejected(raw: DataFrame) -> DataFrame:
    """Records that the strict load leaves, with the first reason that applies: (line_id, reason).

    Reasons in order: quoting, column_count, poll_date, sample_size. A null or empty line has one empty field: column_count.
    Records are told apart by line_id; the loaded ones are subtracted and only the remainder is diagnosed.
    """
    remainder = raw.join(strict_load(raw).select("line_id"), "line_id", "left_anti")
    reason = (
        F.when(~F.col("_quoted"), "quoting").when(F.size("_fields") != len(FIELDS), "column_count")
        .when(french_date(F.get("_fields", F.lit(0))).isNull(), "poll_date").otherwise("sample_size")
    )
    return _parsed(remainder).select("line_id", reason.alias("reason"))
