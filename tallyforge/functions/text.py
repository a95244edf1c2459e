"""String normalisers as Column expressions: no Python runs per row."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold_table() -> tuple[str, str]:
    """Lower-case accented Latin letters and their base letters, derived from the Unicode decompositions."""
    marked, plain = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        char = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if char == char.lower() and len(base) == 1 and base.isascii() and base != char:
            marked.append(char)
            plain.append(base)
    return "".join(marked), "".join(plain)


ACCENTED, PLAIN = _fold_table()

#: All kinds of white space, zero-width ones included, as a Java regex class body.
SPACES = r"\s\u0085\u00a0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"


def fold(text: Column) -> Column:
    """Lower case without accents; ligatures are spelled out."""
    lowered = F.translate(F.lower(text), ACCENTED, PLAIN)
    lowered = F.replace(F.replace(lowered, F.lit("œ"), F.lit("oe")), F.lit("æ"), F.lit("ae"))
    return F.regexp_replace(lowered, r"\p{M}+", "")


def name_key(text: Column) -> Column:
    """Join key of a name: case, accents, punctuation and spacing removed."""
    return F.regexp_replace(fold(text), r"[^\p{L}\p{N}]+", "")


def trim_spaces(text: Column) -> Column:
    """Trim every kind of white space, not only U+0020."""
    return F.regexp_replace(text, rf"^[{SPACES}]+|[{SPACES}]+$", "")


def is_blank(text: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return F.coalesce(F.length(trim_spaces(text)) == 0, F.lit(True))


def riding_code(text: Column) -> Column:
    """Numeric riding codes without their decimal tail; names pass unchanged."""
    trimmed = trim_spaces(text)
    return F.when(trimmed.rlike(r"^[0-9]+(\.[0-9]*)?$"), F.regexp_extract(trimmed, r"^([0-9]+)", 1)).otherwise(trimmed)


def locale_number(text: Column) -> Column:
    """Number typed by people: thin spaces, decimal comma, percent and plus-minus signs; null when none is left."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\[[^\]]*\]", ""), rf"[{SPACES}%±]", "")
    return F.replace(bare, F.lit(","), F.lit(".")).try_cast("double")


def poll_id(*parts: Column) -> Column:
    """Content hash of a poll: the first 16 hex digits of the SHA-1 of its parts, joined by a pipe; null counts as empty."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.substring(F.sha1(joined), 1, 16)


def collapse_spaces(text: Column) -> Column:
    """Footnote marks out, runs of white space to one blank."""
    return trim_spaces(F.regexp_replace(F.regexp_replace(text, r"\[[^\]]*\]|\*", ""), rf"[{SPACES}]+", " "))


def initials(text: Column) -> Column:
    """First letters of a name's words, in capitals, without accents."""
    words = F.filter(F.split(fold(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.upper(F.substring(w, 1, 1))), "")


# French month names without accents, in calendar order.
FRENCH_MONTHS = ["janvier", "fevrier", "mars", "avril", "mai", "juin", "juillet", "aout", "septembre", "octobre", "novembre", "decembre"]


def french_date(text: Column) -> Column:
    """A real day written yyyy-mm-dd or as day, French month, year; notes in brackets and outer spaces ignored. Null if it is none."""
    bare = fold(trim_spaces(F.regexp_replace(text, r"\[[^\]]*\]", "")))
    iso = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})$"
    words = rf"^([0-9]{{1,2}})[{SPACES}]+({'|'.join(FRENCH_MONTHS)})[{SPACES}]+([0-9]{{4}})$"
    month = F.array_position(F.array(*[F.lit(m) for m in FRENCH_MONTHS]), F.regexp_extract(bare, words, 2))
    date = F.when(
        bare.rlike(iso), bare
    ).when(
        bare.rlike(words),
        F.concat_ws("-", F.regexp_extract(bare, words, 3), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(bare, words, 1), 2, "0")),
    )
    return date.try_cast("date")
