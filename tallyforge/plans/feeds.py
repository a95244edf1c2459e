"""Catalogue: pages and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.text import FRENCH_MONTHS, collapse_spaces
from tallyforge.plans import tables as t
from tallyforge.plans.registry import Catalogue
from tallyforge.session import new_folder, read_table
from tallyforge.sources import pages
from tallyforge.streaming import late, watch

CATALOGUE = Catalogue()
query = CATALOGUE.query


def _batches(df: DataFrame, order: str, batches: int = 4) -> DataFrame:
    """A table as a stream of so many batches, cut by a column."""
    path = new_folder(df.sparkSession)
    df.repartitionByRange(batches, order).write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("SELECT title, max(revid) AS revid FROM page_snapshots WHERE title IS NOT NULL GROUP BY title")
def stream_watch(spark: SparkSession, folder: str) -> DataFrame:
    """The newest revision of each page after all have come in four batches by time of fetching, which is not the order of revisions."""
    return watch.watch(_batches(read_table(spark, folder, "page_snapshots"), "fetched_at"), new_folder(spark)).select("title", "revid")


@query("""WITH l AS (SELECT title, max(revid) AS revid FROM page_snapshots WHERE title IS NOT NULL GROUP BY 1)
  SELECT title, poll_id, party_code, round(min(pct_reported), 6) AS pct FROM snapshot_shares JOIN l USING (title, revid) WHERE poll_id IS NOT NULL AND party_code IS NOT NULL GROUP BY 1, 2, 3""")
def stream_tables(spark: SparkSession, folder: str) -> DataFrame:
    """The tables of all pages after their revisions have come in four batches by time of fetching, only differences written, guards overridden since the tables come dirty."""
    stream = _batches(read_table(spark, folder, "page_snapshots").select("title", "revid", "fetched_at"), "fetched_at")
    rows = watch.watch_tables(stream, read_table(spark, folder, "snapshot_shares"), new_folder(spark), force=True)
    return rows.select("title", "poll_id", "party_code", F.round("pct", 6).alias("pct"))


_FIRM = "trim(regexp_replace(regexp_replace(firm, '\\[[^\\]]*\\]|\\*', '', 'g'), '[\\s\\x{00a0}\\x{2009}\\x{202f}]+', ' ', 'g'))"


@query(f"""WITH l AS (SELECT title, max(revid) AS revid FROM page_snapshots WHERE title IS NOT NULL GROUP BY 1),
  r AS (SELECT title, poll_id, min({_FIRM}) AS firm, party_code, min(pct_reported) AS pct FROM snapshot_shares JOIN l USING (title, revid) WHERE poll_id IS NOT NULL AND party_code IS NOT NULL GROUP BY 1, 2, 4),
  d AS (SELECT poll_id, min(poll_date) AS poll_date FROM polls GROUP BY 1),
  w AS (SELECT title, poll_id, min(r.firm) AS firm, min(poll_date) AS poll_date FROM r JOIN d USING (poll_id) WHERE poll_date IS NOT NULL GROUP BY 1, 2 HAVING count(pct) FILTER (party_code IN ('ALB','LPN','MVT','PRN','UCD','AUTRES')) >= 2 AND min(r.firm) <> '')
  SELECT title, w.firm, w.poll_date, party_code, pct FROM w JOIN r USING (title, poll_id) WHERE pct IS NOT NULL AND party_code IN ('ALB','LPN','MVT','PRN','UCD','AUTRES')""")
def page_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Polls read from tables: every page's newest table, rendered as HTML, parsed again with its headings, French dates and decimal commas."""
    newest = read_table(spark, folder, "page_snapshots").where("title IS NOT NULL").groupBy("title").agg(F.max("revid").alias("revid"))
    rows = read_table(spark, folder, "snapshot_shares").where("poll_id IS NOT NULL AND party_code IS NOT NULL").join(newest, ["title", "revid"])
    dates = read_table(spark, folder, "polls").groupBy("poll_id").agg(F.min("poll_date").alias("poll_date"))
    share = lambda p: F.coalesce(F.replace(F.min(F.when(F.col("party_code") == p, F.col("pct_reported"))).cast("string"), F.lit("."), F.lit(",")), F.lit("–"))
    wide = rows.groupBy("title", "revid", "poll_id").agg(F.min(collapse_spaces(F.col("firm"))).alias("firm"), *[share(p).alias(p) for p in t.PARTIES]).join(dates.where("poll_date IS NOT NULL"), "poll_id")
    month = F.element_at(F.array(*[F.lit(m) for m in FRENCH_MONTHS]), F.month("poll_date"))
    day = F.concat_ws("&nbsp;", F.dayofmonth("poll_date").cast("string"), month, F.year("poll_date").cast("string"))
    escaped = F.replace(F.replace(F.col("firm"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    line = F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", day, F.coalesce(escaped, F.lit("")), *[F.col(p) for p in t.PARTIES]), F.lit("</td></tr>"))
    head = "<h2>Sondages</h2><table><tr><th>Date</th><th>Firme</th>" + "".join(f"<th>{p}</th>" for p in t.PARTIES) + "</tr>"
    html = wide.groupBy("title", "revid").agg(F.concat(F.lit(head), F.array_join(F.collect_list(line), ""), F.lit("</table>")).alias("html"))  # one page's table
    found = pages.poll_tables(pages.blocks(html), t.PARTIES, ["region"])
    return found.select("title", "firm", "poll_date", F.explode("shares").alias("party_code", "pct"))


@query("""WITH e AS (SELECT poll_id, scraped_at AS a, date_trunc('week', poll_date) AS m, sample_size AS s,
      row_number() OVER (PARTITION BY poll_id ORDER BY scraped_at, poll_date, sample_size NULLS FIRST) AS k, CAST(scraped_at AS DATE) - CAST(date_trunc('week', poll_date) AS DATE) AS age, poll_date AS d
    FROM polls WHERE poll_id IS NOT NULL AND poll_date IS NOT NULL AND scraped_at IS NOT NULL),
  taken AS (SELECT m, s FROM e WHERE age < 49 AND poll_id IN (SELECT poll_id FROM e WHERE k = 1 AND age < 49) QUALIFY row_number() OVER (PARTITION BY poll_id ORDER BY k DESC) = 1)
  SELECT CAST(m AS DATE) AS period_start, count(*) AS n_polls, CAST(coalesce(sum(s), 0) AS BIGINT) AS sample_sum FROM taken GROUP BY 1""")
def stream_weekly(spark: SparkSession, folder: str) -> DataFrame:
    """Weekly figures after all polls have come in four batches by load: polls delivered again and late ones take old parts back."""
    polls = read_table(spark, folder, "polls").select("poll_id", "poll_date", "scraped_at", "sample_size", "load_id")
    return late.weekly(_batches(polls, "load_id"), new_folder(spark)).where("n_polls > 0").select("period_start", "n_polls", "sample_sum")


@query("""SELECT title, revid, regexp_extract(html, '<h2>([^<]*)</h2>', 1) AS section, try_cast(regexp_extract(html, '([0-9]+) sondage', 1) AS BIGINT) AS n_stated, count(*) AS n_rows FROM page_snapshots WHERE html IS NOT NULL AND html LIKE '%sondage%</p>%' GROUP BY ALL""")
def html_extract(spark: SparkSession, folder: str) -> DataFrame:
    """What each revision says of itself: its section and number of polls, from the walked page."""
    found = pages.blocks(read_table(spark, folder, "page_snapshots")).where("tag = 'p'")
    stated = F.regexp_extract("text", r"([0-9]+) sondage", 1).try_cast("long")
    return found.groupBy("title", "revid", "section", stated.alias("n_stated")).agg(F.count(F.lit(1)).alias("n_rows")).where("n_stated IS NOT NULL")


@query("""WITH b AS (SELECT title, revid, regexp_extract(html, '<h2>([^<]*)</h2>', 1) AS section, regexp_extract_all(html, '<p>(.*?)</p>', 1, 's') AS ps FROM page_snapshots WHERE html IS NOT NULL)
  SELECT title, revid, CAST(i - 1 AS INTEGER) AS pos, section, 'p' AS tag, trim(regexp_replace(replace(ps[i], '&nbsp;', ' '), '\\s+', ' ', 'g')) AS text FROM b, unnest(range(1, len(ps) + 1)) AS r(i)""")
def html_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Every block of every revision with the headings above it."""
    return pages.blocks(read_table(spark, folder, "page_snapshots")).select("title", "revid", "pos", "section", "tag", "text")
