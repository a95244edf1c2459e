"""HTML pages as rows: headings, paragraphs and table cells in document order."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.text import collapse_spaces, fold, french_date, is_blank, locale_number, poll_id
from tallyforge.operators.relational import keep_first

_BLOCKS = {"p", "li", "td", "th", "caption"}
_HEADINGS = {"h1", "h2", "h3", "h4"}


class _Walk(HTMLParser):
    """Collects blocks with the headings above them; a table cell has its table, row and column number."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[str, str, int, int, int, str]] = []
        self.heads: list[tuple[str, str]] = []
        self.open, self.text, self.href = "", [], None
        self.table, self.row, self.column = -1, -1, -1

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "table":
            self.table, self.row = self.table + 1, -1
        elif tag == "tr":
            self.row, self.column = self.row + 1, -1
        elif tag in _BLOCKS or tag in _HEADINGS:
            self.finish()
            self.open, self.text, self.href = tag, [], None
            self.column += tag in ("td", "th")
        elif tag == "a" and self.href is None:
            self.href = next((v for k, v in attrs if k == "href" and v and v.startswith("http")), None)

    def handle_data(self, data: str) -> None:
        if self.open:
            self.text.append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag == self.open or tag in ("tr", "table"):
            self.finish()

    def finish(self) -> None:
        """Close the open block."""
        if not self.open:
            return
        text, tag, self.open = " ".join("".join(self.text).split()), self.open, ""
        if tag in _HEADINGS:
            self.heads = [h for h in self.heads if h[0] < tag] + [(tag, text)]
        else:
            cell = tag in ("td", "th")
            self.rows.append((" > ".join(t for _, t in self.heads), tag, self.table if cell else -1, self.row if cell else -1, self.column if cell else -1, text, self.href))


def blocks(pages: DataFrame) -> DataFrame:
    """(title, revid, pos, section, tag, table, row, column, text, href) of every block of (title, revid, html).

    Whole pages are walked, batch by batch; broken markup gives what can be read of it, a null page nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["title", "revid", "pos", "section", "tag", "table", "row", "column", "text", "href"]
        for pdf in batches:
            out = []
            for title, revid, html in zip(pdf.title, pdf.revid, pdf.html):
                if not html:
                    continue
                walk = _Walk()
                walk.feed(html)
                walk.close()
                walk.finish()
                out += [(title, revid, i, *r) for i, r in enumerate(walk.rows)]
            yield pd.DataFrame(out, columns=names)

    return pages.select("title", "revid", "html").mapInPandas(run, "title string, revid long, pos int, section string, tag string, `table` int, row int, `column` int, text string, href string")


# What the columns of a table of polls are called, without case and accents.
_COLUMNS = {"date": "poll_date", "firme": "firm", "firm": "firm", "institut": "firm", "echantillon": "sample_size", "sample": "sample_size"}


def poll_tables(blocks: DataFrame, parties: list[str], set_aside: list[str]) -> DataFrame:
    """Polls in the tables of pages: (title, revid, table, row, section, poll_id, poll_date, firm, sample_size, shares).

    A table counts if its first row names a date, a firm and two parties at least, in any order; tables under a heading that holds one of the words in
    set_aside (breakdowns) don't. A row counts if its date can be read, it has a firm and two shares at least, so that rows of
    events fall away. Notes in brackets, stars, spaces of any kind, decimal commas and percent signs are no part of values; a dash is no share. The
    cells of a page meet in one group per row, never per page.
    """
    place = ["title", "revid", "table"]
    cells = blocks.where("table >= 0").select(*place, "row", "column", "section", "text")
    names = F.create_map(*[F.lit(x) for pair in (_COLUMNS | {p.lower(): p for p in parties}).items() for x in pair])
    heads = cells.where("row = 0").select(*place, "column", names[F.regexp_replace(fold(F.col("text")), r"[^a-z0-9]", "")].alias("name")).where("name IS NOT NULL")
    known = heads.groupBy(*place).agg(F.collect_set("name").alias("names")).where(F.array_contains("names", "poll_date") & F.array_contains("names", "firm"))
    known = known.where(F.size(F.array_intersect("names", F.array(*[F.lit(p) for p in parties]))) >= 2).select(*place)
    values = cells.where("row > 0").join(heads.join(known, place, "left_semi"), [*place, "column"])
    for word in set_aside:
        values = values.where(~F.contains(fold(F.col("section")), F.lit(word)))
    cell = lambda name: F.first(F.when(F.col("name") == name, F.col("text")), ignorenulls=True)
    measured = F.when(F.col("name").isin(parties), F.struct("name", locale_number(F.col("text")).alias("pct")))
    rows = values.groupBy(*place, "row").agg(
        F.min("section").alias("section"), french_date(cell("poll_date")).alias("poll_date"), collapse_spaces(cell("firm")).alias("firm"), locale_number(cell("sample_size")).cast("int").alias("sample_size"),
        F.filter(F.collect_list(measured), lambda s: s["pct"].isNotNull()).alias("s"),
    )
    valid = rows.where(F.col("poll_date").isNotNull() & ~is_blank(F.col("firm")) & (F.size("s") >= 2))
    return valid.select(*place, "row", "section", poll_id(F.col("firm"), F.col("poll_date"), F.col("sample_size")).alias("poll_id"), "poll_date", "firm", "sample_size", F.map_from_entries("s").alias("shares"))


def first_seen(polls: DataFrame) -> DataFrame:
    """Polls of several pages once each: the one of the first title, revision, table and row."""
    return keep_first(polls, ["poll_id"], [F.col(c) for c in ("title", "revid", "table", "row")])
