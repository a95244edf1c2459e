"""Texts cut off by a field limit or a broken transfer, by a backward character n-gram model."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.session import checkpoint

#: Lengths of the final contexts, in characters; the longest one seen often enough decides.
ORDERS = (3, 5, 6, 7, 8, 10, 12, 15, 18, 22, 26, 32)
MIN_SEEN = 4
#: Texts that are worked on at once.
BATCH = 500
#: The filter that picks the places worth counting has so many bits for each context in question, within these bounds (at most 8 MB).
FILTER_SHARE, FILTER_BITS = 16, (1 << 16, 1 << 26)
#: Steps of the log-odds in which a language's threshold is sought, and how far from 0 a score may lie; scores beyond count as that far.
STEP, REACH = 0.25, 8.0
#: The scores of all texts count as so many of each language's own, and "goes on" must at least be as likely as "ends".
PRIOR_TEXTS, LEAST_THRESHOLD = 100.0, 0.0
#: A length is a field limit of its source if it is this much more frequent than the lengths below it, and seen so often.
LIMIT_RATIO, LIMIT_COUNT, LIMIT_SPAN = 8.0, 8, 40
#: What a mark of truncation adds to the log-odds: one that names it, or a mere ellipsis.
NAMED_MARK_ODDS, ELLIPSIS_ODDS = 8.0, 3.0

# Marks that sites and mail gateways put where they cut a text.
_MARKS = re.compile(
    r"\s*(?:(?:\.\.\.|…)?\s*[\[(](?:lire la suite|voir plus|suite|read more|see more|continue reading|more|truncated|message truncated|tronqué|message tronqué|leer más|ver más|truncado)[\])]"
    r"|…|[\[(](?:\.\.\.|…)[\])])\s*\Z",
    re.IGNORECASE,
)
_MARK_CHARS = 48  # more than the longest mark, and every mark ends in one of the characters below
_MARK_ENDS = (")", "]", "…")
_STOPS = ".!?…"
#: A text that ends in one of these, or in a symbol such as an emoji, is whole as it stands.
_CLOSED = re.compile(r"(?:[.!?)\]>»”\"*_~^=:;)]|[^\w\s,\ufffd&<\[({#/@+%$€'’\\|–—-])\s*\Z")
_OPEN_TAIL = re.compile(r"[:;=]\s*\Z")
_SMILEY = re.compile(r"[:;=]['-]?[)(DPp]\s*\Z|\^\^\s*\Z")
#: A name on a last line of its own, after a separator or a blank line.
_SIGNATURE = re.compile(r"\n(?P<rule>-- ?|_{3,}|)\n(?P<name>\S+)\s*\Z")
_B = 0x9E3779B97F4A7C15
_M = (1 << 64) - 1

# Kinds of endings: whole as it stands, to be judged by its context, cut for certain.
WHOLE, OPEN, BROKEN = 0, 1, 2


def unmarked(text: str) -> tuple[str, str | None]:
    """The text without final white space and a final mark of truncation, and that mark."""
    bare = text.rstrip()
    if bare.endswith(_MARK_ENDS) and (found := _MARKS.search(bare[-_MARK_CHARS:])):
        return bare[: len(bare) - len(found.group())].rstrip(), found.group().strip()
    return bare, None


def ending(text: str, author: str | None) -> tuple[str, float, int]:
    """The text without a final mark and white space, the log-odds the mark is worth, and the kind of ending."""
    bare, mark = unmarked(text)
    if not bare:
        return bare, 0.0, WHOLE
    if mark:
        return bare, ELLIPSIS_ODDS if mark == "…" else NAMED_MARK_ODDS, OPEN
    if bare[-1] == "\ufffd":
        return bare.rstrip("\ufffd"), NAMED_MARK_ODDS, BROKEN
    if _SMILEY.search(bare[-8:]) or (_CLOSED.search(bare[-8:]) and not _OPEN_TAIL.search(bare[-8:])):
        return bare, 0.0, WHOLE
    if sign := _SIGNATURE.search(bare, max(0, bare.rfind("\n", 0, bare.rfind("\n")))) if "\n" in bare else None:
        name = sign["name"]
        if author and author != name and author.startswith(name):
            return bare, 0.0, BROKEN
        if author == name or sign["rule"]:
            return bare, 0.0, WHOLE
    return bare, 0.0, OPEN


def _lower_table() -> np.ndarray:
    table = np.arange(1 << 16, dtype=np.uint32)
    for c in range(1 << 16):
        if len(low := chr(c).lower()) == 1:
            table[c] = ord(low)
    table[[9, 0xA0]] = 32
    table[48:58] = 48
    return table


_LOWER = _lower_table()


def simplify(text: str) -> np.ndarray:
    """The characters of a text in lower case, digits as one 0 and blanks as one; a line break with what quotes it as code 4, with a blank line as 3."""
    raw = np.frombuffer(text.replace("\r", "").replace("&nbsp;", " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = np.where(raw < 1 << 16, _LOWER[np.minimum(raw, (1 << 16) - 1)], raw)
    blank, line, zero = codes == 32, codes == 10, codes == 48
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(blank[1:] & blank[:-1] | zero[1:] & zero[:-1])
    loose = blank | line | (codes == 62)
    first = np.flatnonzero(loose & ~np.concatenate([[False], loose[:-1]]))
    if len(first):
        run = np.cumsum(np.bincount(first, minlength=len(codes))) - 1  # of loose characters
        lines = np.cumsum(line)
        before = lines[first] - line[first]
        n_lines = np.add.reduceat(line.astype(np.int32), first)
        inside = loose & (run >= 0)
        inside[inside] = lines[inside] > before[run[inside]]  # from the run's first line break on
        opens = np.flatnonzero(line)
        opens = opens[lines[opens] == before[run[opens]] + 1]
        keep[inside] = False
        keep[opens] = True
        codes[opens] = np.where(n_lines[run[opens]] > 1, 3, 4)
    return codes[keep]


@functools.lru_cache(2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, up to 2^bits of them."""
    with np.errstate(over="ignore"):
        both = [np.full(1 << bits, base & _M, dtype=np.uint64) for base in (_B, pow(_B, -1, 1 << 64))]
        for out in both:
            out[0] = 1
            np.multiply.accumulate(out, out=out)
    return both[0], both[1]


def hashes(places: np.ndarray, n: int, sums: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Hash of the n characters that end at each of the places, none of which may lie before n - 1. The lowest bit is free."""
    with np.errstate(over="ignore"):
        first = places + 1 - n
        h = (sums[places + 1] - sums[first]) * down[first]
        h = (h + np.uint64(n)) * np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ (h >> np.uint64(29))) & ~np.uint64(1)


#: What a character that follows a place says of it: an end (stops and blank lines), more text, or neither (line breaks, markup, closing marks).
_FOLLOWS = np.full(1 << 14, -1, np.int8)
_FOLLOWS[[3, *map(ord, _STOPS)]] = 1
_FOLLOWS[[4, *map(ord, '<[")»')]] = 0


def lay_out(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts, simplified and end to end: characters, what follows each (1 an end, -1 more text, 0 neither), place in its text, last places, and the sums and powers for hashes."""
    codes = simplify("".join("\u0002" + t.replace("\u0002", " ") for t in texts))
    starts = np.flatnonzero(codes == 2)
    lengths = np.diff(np.append(starts, len(codes)))
    ends = starts + lengths - 1
    following = np.zeros(len(codes), np.uint32)
    following[:-1] = codes[1:]
    what = _FOLLOWS[np.minimum(following, len(_FOLLOWS) - 1)]
    what[ends] = 1
    place = np.arange(len(codes), dtype=np.int32) - np.repeat(starts, lengths).astype(np.int32)
    codes[codes == 4] = 32
    with np.errstate(over="ignore"):
        up, down = _powers(max(1, len(codes).bit_length()))
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(7)) * up[: len(codes)], dtype=np.uint64, out=sums[1:])
    return codes, what, place, ends, sums, down


_FINAL = "doc_id long, source string, lang string, chars int, bytes int, odds double, kind int, own boolean, ctx array<long>"


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in (whole.iloc[k : k + 4 * BATCH] for whole in batches for k in range(0, len(whole), 4 * BATCH)):
        kept = [(i, e, text) for i, (author, text) in enumerate(zip(pdf.author, pdf.text)) if (e := ending(text, author))[2] != WHOLE]
        if not kept:
            continue
        _, _, place, ends, sums, down = lay_out([e[0] for _, e, _ in kept])
        table = np.zeros((len(kept), len(ORDERS)), np.uint64)
        for k, n in enumerate(ORDERS):
            long = place[ends] >= n - 1
            table[long, k] = hashes(ends[long], n, sums, down)
        size = (place[ends][:, None] >= np.array(ORDERS) - 1).sum(axis=1)
        base = pdf.iloc[[i for i, _, _ in kept]][["doc_id", "source", "lang", "chars", "bytes"]]
        yield base.assign(odds=[e[1] for _, e, _ in kept], kind=[e[2] for _, e, _ in kept], own=[e[0] == t.rstrip() for _, e, t in kept], ctx=[row[:m] for row, m in zip(table.view(np.int64), size)])


def final_contexts(docs: DataFrame) -> DataFrame:
    """Contexts, in several lengths, of all texts whose end does not show by itself that it is one: one row per such text.

    `own` says that the text's end itself was counted as an end when the corpus was.
    """
    columns = docs.where(F.length("text") > 0).select("doc_id", "source", "lang", "author", "text", F.length("text").alias("chars"), F.octet_length("text").alias("bytes"))
    return columns.mapInPandas(_contexts, _FINAL)


def context_filter(contexts: DataFrame) -> np.ndarray:
    """A bit per hash residue: which places of the corpus may matter. Sized by a count of the contexts within FILTER_BITS, built by a distributed bitwise or."""
    n = contexts.agg(F.sum(F.size("ctx")).alias("n")).first().n or 0
    size = min(FILTER_BITS[1], max(FILTER_BITS[0], 1 << (FILTER_SHARE * n).bit_length()))
    slot = F.pmod(F.shiftrightunsigned("c", 1), F.lit(size))
    words = (
        contexts.select(F.explode("ctx").alias("c")).select(slot.alias("slot"))
        .groupBy(F.floor(F.col("slot") / 32).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot % 32 AS INT))")).alias("bits"))
    )
    table = np.zeros(size // 32, np.uint32)
    rows = words.toPandas()  # at most FILTER_BITS / 32 rows
    table[rows.w.to_numpy(dtype=np.int64)] = rows.bits.to_numpy(dtype=np.int64).astype(np.uint32)
    return table


def count_contexts(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """How often each context is followed by an end and by more text, over all texts: (ctx, n_end, n_more).

    Every place of every text is looked at and combined per batch before the shuffle; the filter only drops
    places whose context ends no text in question. A place that matters to no short context matters to no longer one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def matching(texts: pd.Series, table: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        cleaned = [unmarked(t) for t in texts]
        _, what, place, ends, sums, down = lay_out([t for t, _ in cleaned])
        what[ends[[m is not None for _, m in cleaned]]] = 0
        at = np.flatnonzero(what)
        for n in ORDERS:
            at = at[place[at] >= n - 1]
            h = hashes(at, n, sums, down)
            slot = ((h >> np.uint64(1)) & np.uint64(32 * len(table) - 1)).astype(np.int64)
            hit = (table[slot >> 5] >> (slot & 31).astype(np.uint32)) & 1 == 1
            at, h = at[hit], h[hit]
            if not len(at):
                break
            yield n, h | (what[at] > 0).astype(np.uint64)  # the free bit says that an end follows

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: dict[int, list[np.ndarray]] = {n: [] for n in ORDERS}
            for k in range(0, len(pdf), BATCH):
                for n, h in matching(pdf.text.iloc[k : k + BATCH], shared.value):
                    seen[n].append(h)
            out = []
            for parts in seen.values():
                if parts:
                    h = np.sort(np.concatenate(parts))
                    first = np.flatnonzero(np.concatenate([[True], h[1:] >> np.uint64(1) != h[:-1] >> np.uint64(1)]))
                    n_end = np.add.reduceat((h & np.uint64(1)).astype(np.int64), first)
                    out.append(((h[first] & ~np.uint64(1)).view(np.int64), n_end, np.diff(np.append(first, len(h))) - n_end))
            if out:
                yield pd.DataFrame(dict(zip(("ctx", "n_end", "n_more"), map(np.concatenate, zip(*out)))))

    counts = docs.where(F.length("text") > 0).select("text").mapInPandas(count, "ctx long, n_end long, n_more long")
    return counts.groupBy("ctx").agg(F.sum("n_end").alias("n_end"), F.sum("n_more").alias("n_more"))


def field_limits(docs: DataFrame) -> DataFrame:
    """Lengths at which a source cuts: (source, measure, size, limit_odds), a length that stands out from the lengths below it.

    measure is `chars` or `bytes` (UTF-8). At most a row per source and length takes part.
    """
    sizes = F.array(F.struct(F.lit("chars").alias("measure"), F.length("text").alias("size")), F.struct(F.lit("bytes").alias("measure"), F.octet_length("text").alias("size")))
    counts = docs.where("text IS NOT NULL").select("source", F.explode(sizes).alias("s")).groupBy("source", "s.measure", "s.size").agg(F.count(F.lit(1)).alias("n"))
    below = Window.partitionBy("source", "measure").orderBy("size").rangeBetween(-LIMIT_SPAN - 3, -4)
    background = F.coalesce(F.sum("n").over(below), F.lit(0)) / LIMIT_SPAN
    odds = F.log((F.col("n") + 1) / (F.col("background") + 1))
    return (
        counts.withColumn("background", background).where((F.col("n") >= LIMIT_COUNT) & (F.col("n") >= LIMIT_RATIO * (F.col("background") + 0.25)))
        .select("source", "measure", "size", odds.alias("limit_odds"))
    )


def score(docs: DataFrame, column: str = "text") -> DataFrame:
    """Log-odds that each text in question goes on after its end: (doc_id, source, lang, odds, kind).

    The sum of what its longest well-known final context says (goes on against ends; its own end left out),
    of its mark and of its length. Texts that are null, empty or blank, or end in a stop, a closing mark or a symbol, are whole and left out.
    """
    docs = docs.withColumn("text", F.col(column)) if column != "text" else docs
    texts = checkpoint(final_contexts(docs)).withColumn("row", F.monotonically_increasing_id())
    counts = count_contexts(docs, context_filter(texts))
    counts = counts.where(F.col("n_end") + F.col("n_more") >= MIN_SEEN)  # the rest decides nothing
    n_end = F.greatest(F.col("n_end") - F.col("own").cast("int"), F.lit(0))
    known = (
        texts.select("row", "own", F.posexplode("ctx").alias("order", "ctx")).join(counts, "ctx").where(n_end + F.col("n_more") >= MIN_SEEN)
        .groupBy("row").agg(F.max_by(F.log((F.col("n_more") + 0.5) / (n_end + 0.5)), "order").alias("ctx_odds"))
    )
    limits = field_limits(docs)
    best = texts.join(known, "row", "left")
    for m, slack in (("chars", 0), ("bytes", 3)):  # a limit in bytes leaves up to 3 unused before a long character
        reach = F.explode(F.sequence(F.col("size") - slack, F.col("size"))).alias(m)
        best = best.join(limits.where(F.col("measure") == m).select("source", reach, "limit_odds").groupBy("source", m).agg(F.max("limit_odds").alias(f"{m}_odds")), ["source", m], "left")
    total = F.col("odds") + F.coalesce("ctx_odds", F.lit(0.0)) + F.greatest(F.coalesce("chars_odds", F.lit(0.0)), F.coalesce("bytes_odds", F.lit(0.0)))
    return best.select("doc_id", "source", "lang", total.alias("odds"), "kind")


def thresholds(scores: DataFrame, prior: float = PRIOR_TEXTS) -> DataFrame:
    """The log-odds from which a text of each language counts as cut: (lang, threshold).

    The step that parts a language's scores into two groups with the greatest variance between them, half-way up the empty
    steps around it. Scores of all texts of the column take part; those of all languages together stand in where a language has few.
    Works on a row per language and step. A null language is one of its own.
    """
    step = F.floor(F.greatest(F.lit(-REACH), F.least(F.lit(REACH), F.col("odds"))) / STEP).cast("int").alias("step")
    own = scores.groupBy("lang", step).agg(F.count(F.lit(1)).cast("double").alias("n"))
    pooled = own.groupBy("step").agg(F.sum("n").alias("n")).withColumn("n", F.lit(prior) * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))  # a row per step
    top = int(REACH / STEP)
    grid = own.select("lang").distinct().select("lang", F.explode(F.sequence(F.lit(-top), F.lit(top))).alias("step"))
    steps = own.unionByName(grid.join(pooled, "step").select("lang", "step", "n")).groupBy("lang", "step").agg(F.sum("n").alias("n"))
    up = Window.partitionBy("lang").orderBy("step")
    whole = Window.partitionBy("lang")
    below, below_sum = F.sum("n").over(up), F.sum(F.col("n") * F.col("step")).over(up)
    total, total_sum = F.sum("n").over(whole), F.sum(F.col("n") * F.col("step")).over(whole)
    between = below * (total - below) * F.pow(below_sum / below - (total_sum - below_sum) / (total - below), 2)
    cuts = steps.select("lang", F.col("step"), F.lead("step").over(up).alias("next"), F.when(below < total - 1e-9, between).alias("between"))
    best = cuts.where("next IS NOT NULL").groupBy("lang").agg(F.max_by(F.struct("step", "next"), F.struct("between", -F.col("step"))).alias("b"))
    middle = (F.col("b.step") + 1 + F.col("b.next")) / 2 * STEP
    return best.select("lang", F.greatest(F.lit(LEAST_THRESHOLD), middle).alias("threshold"))


def cut_texts(docs: DataFrame, column: str = "text") -> DataFrame:
    """The cut documents: (doc_id, source). Needs doc_id, author, lang, source and the text column; any may be null. A repeated row comes out as often as it is stored."""
    scores = checkpoint(score(docs, column))
    bar = thresholds(scores).withColumnRenamed("lang", "own_lang")
    odds = scores.join(bar, F.col("lang").eqNullSafe(F.col("own_lang")), "left")
    return odds.where((F.col("odds") > F.coalesce("threshold", F.lit(LEAST_THRESHOLD))) | (F.col("kind") == BROKEN)).select("doc_id", "source")


def cut_rates(docs: DataFrame, column: str = "text") -> DataFrame:
    """How often each source cuts: (source, n_texts, n_cut, rate); null and empty texts don't count."""
    texts = docs.where(F.length(column) > 0).groupBy("source").agg(F.count(F.lit(1)).alias("n_texts"))
    cut = cut_texts(docs, column).groupBy("source").agg(F.count(F.lit(1)).alias("n_cut"))
    joined = texts.alias("t").join(cut.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source")), "left")
    n = F.coalesce("c.n_cut", F.lit(0))
    return joined.select("t.source", "t.n_texts", n.alias("n_cut"), F.round(n / F.col("t.n_texts"), 6).alias("rate"))
