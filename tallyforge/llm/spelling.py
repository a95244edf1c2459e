"""Spellings of one name: sparse cosine join of character n-gram vectors, then average-linkage clustering."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.functions.text import SPACES, fold
from tallyforge.session import checkpoint

#: Length of the character n-grams.
NGRAM = 3
#: Least cosine of two spellings that are compared further, and the share of a vector's length that its index may leave out.
MIN_COSINE, INDEX_REST = 0.3, 0.2
#: Partners a spelling keeps, best first; None keeps all above MIN_COSINE, so that no link can be lost. Those above SURE_COSINE are kept beyond it, however many.
TOP_N, SURE_COSINE = None, 0.55
#: Least average likeness at which two groups of spellings are one name.
LINKAGE = 0.6
#: A word that stands last in so large a share of the names (by its first three letters) tells no name apart: there are at most 1 / COMMON_SHARE of them.
COMMON_SHARE = 0.01
#: Spellings of one group that one task pairs with all of these; more are spread over tasks.
PAIRED_AT_ONCE = 1_000
#: Most names in a block of the cosine join, each pair of blocks being a task, and the blocks that fewer names are cut into, as far as LEAST_NAMES names are in each.
BLOCK_NAMES, BLOCKS, LEAST_NAMES = 80_000, 8, 4_000
#: Pairs of names, and products of weights, that such a task holds at once.
CELLS, PRODUCTS = 250_000, 500_000
#: Components of likely pairs of so many names or fewer are linked whole, about BUCKET_ROWS rows of them in a task; larger ones are linked by joins.
COMPONENT_NAMES, BUCKET_ROWS = 200, 20_000

# Legal forms and joining words that belong to no name.
_EMPTY_WORDS = ["inc", "ltee", "ltd", "llc", "corp", "enr", "sa", "sarl", "cie", "co", "et", "and", "y"]


def form(name: Column) -> Column:
    """Words of a name in order: case, accents, punctuation, notes, remarks in brackets, sponsors and legal forms left out.

    A name written with a comma is turned round. Names that have no letter or digit, like null, give an empty form.
    """
    text = F.regexp_replace(fold(name), r"\[[^\]]*\]|\([^)]*\)", " ")
    text = F.regexp_replace(text, rf"[{SPACES}]/[{SPACES}].*$|[{SPACES}](?:pour|for|para)[{SPACES}].*$", "")
    text = F.regexp_replace(text, r"^([^,]*\w[^,]*),([^,]*\w[^,]*)$", "$2 $1")
    words = F.filter(F.split(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "), " "), lambda w: (w != "") & ~w.isin(_EMPTY_WORDS))
    return F.coalesce(F.array_join(words, " "), F.lit(""))


def common_endings(forms: DataFrame, share: float = COMMON_SHARE) -> list[str]:
    """First letters of the words that end many names of three words or more: fewer than 1 / share values."""
    words = F.split("form", " ")
    ends = forms.where(F.size(words) >= 3).groupBy(F.substring(F.element_at(words, -1), 1, 3).alias("stem")).agg(F.count(F.lit(1)).alias("n"))
    return sorted(r.stem for r in ends.where(F.col("n") >= F.lit(max(3.0, share * forms.count()))).collect())


def core(words: list[str], common: frozenset[str]) -> tuple[list[str], str]:
    """The words that tell a name apart, and where the common one stood: 'end', 'start' or ''."""
    if len(words) > 1 and words[-1][:3] in common:
        return words[:-1], "end"
    if len(words) > 2 and words[0][:3] in common:
        return words[1:], "start"
    return words, ""


def gram_counts(forms: DataFrame, common: list[str], n: int = NGRAM) -> DataFrame:
    """Character n-grams of the telling words, each word opened by a mark: (id, gram, tf).

    Each word adds its letters in alphabetical order and its consonants, which survive swapped letters and slips in vowels.
    """
    common_set = frozenset(common)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, text in zip(pdf.id, pdf.form):
                grams = Counter()
                for w in core(text.split(), common_set)[0]:
                    opened = "^" + w
                    grams.update(opened[k : k + n] for k in range(max(1, len(opened) - n + 1)))
                    grams.update(["@" + "".join(sorted(w)), "#" + "".join(c for c in w if c not in "aeiouy")])
                rows += [(i, g, c) for g, c in grams.items()]
            yield pd.DataFrame(rows, columns=["id", "gram", "tf"])

    return forms.select("id", "form").mapInPandas(run, "id long, gram string, tf int")


def vectors(grams: DataFrame, n_forms: int) -> DataFrame:
    """Unit vectors with inverse document frequencies: (id, gram, df, weight). Grams of one name alone tell nothing and are left out."""
    df = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    raw = grams.join(df, "gram").withColumn("raw", F.sqrt("tf") * F.log(1 + F.lit(n_forms) / F.col("df")))
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("id")))
    return raw.select("id", "gram", "df", (F.col("raw") / length).alias("weight"))


def spread() -> Column:
    """Slots over which the rows of a key are spread before they are paired: one for each PAIRED_AT_ONCE of them."""
    return F.ceil(F.count(F.lit(1)) / PAIRED_AT_ONCE)


def near_rows(counts: np.ndarray, gram: np.ndarray, weight: np.ndarray, split: int, min_cosine: float, rest: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows with at least min_cosine, one of the first `split` rows and one of the others (of any two rows if there are no others), in parts.

    Row after row, `counts` entries each, rarest first: gram is a number from 0, weight that of a unit vector. Weights are multiplied along the
    indexed entries; the entries left out are looked up for the pairs that may still reach min_cosine.
    """
    n, n_grams = len(counts), int(gram.max()) + 1 if len(gram) else 0
    ends = np.concatenate([[0], np.cumsum(counts)])
    row = np.repeat(np.arange(n), counts)
    square = np.concatenate([[0.0], np.cumsum(weight * weight)])
    indexed = 1 - (square[:-1] - square[ends[row]]) >= rest * rest
    tail = np.sqrt(np.bincount(row[~indexed], weights=weight[~indexed] ** 2, minlength=n))
    key = row * n_grams + gram
    order = np.argsort(key)
    sorted_key, sorted_weight, sorted_indexed = key[order], weight[order], indexed[order]

    def rest_of(own: np.ndarray, other: np.ndarray, among_indexed: bool) -> np.ndarray:
        """What the entries left out of each `own` row add to its product with `other`, over the latter's indexed entries alone or all."""
        number = tails[own]
        pair = np.repeat(np.arange(len(own)), number)
        e = tail_entry[np.arange(len(pair)) + np.repeat(tail_start[own] - np.cumsum(number) + number, number)]
        sought = other[pair] * n_grams + gram[e]
        at = np.minimum(np.searchsorted(sorted_key, sought), len(sorted_key) - 1)
        found = (sorted_key[at] == sought) & (sorted_indexed[at] | (not among_indexed))
        return np.bincount(pair[found], weights=(weight[e] * sorted_weight[at])[found], minlength=len(own))

    tail_entry = np.flatnonzero(~indexed)
    tails = np.bincount(row[tail_entry], minlength=n)
    tail_start = np.cumsum(tails) - tails
    same, entry = split == n, np.flatnonzero(indexed)
    listed = entry if same else entry[row[entry] >= split]
    listed = listed[np.argsort(gram[listed], kind="stable")]  # by gram, then row
    list_row, list_weight = row[listed], weight[listed]
    length = np.bincount(gram[listed], minlength=n_grams)
    start = np.cumsum(length) - length
    products = np.concatenate([[0], np.cumsum(np.bincount(row[entry], weights=length[gram[entry]], minlength=n))])
    entry_ends = np.concatenate([[0], np.cumsum(np.bincount(row[entry], minlength=n))])
    first = 0
    while first < split:
        low = first if same else split  # rows before it have met all others
        last = int(np.searchsorted(products, products[first] + PRODUCTS, "right")) - 1
        last = min(split, max(first + 1, min(last, first + CELLS // max(1, n - low))))
        e = entry[entry_ends[first] : entry_ends[last]]
        number = length[gram[e]]
        at = np.arange(number.sum()) + np.repeat(start[gram[e]] - np.cumsum(number) + number, number)
        cell = np.repeat((row[e] - first) * (n - low) - low, number) + list_row[at]
        part = np.bincount(cell, weights=np.repeat(weight[e], number) * list_weight[at], minlength=(last - first) * (n - low))
        near = np.flatnonzero(part >= min_cosine - rest - 1e-9)
        x, y, part = near // (n - low) + first, near % (n - low) + low, part[near]
        keep = (x < y) & (part + np.maximum(tail[x], tail[y]) >= min_cosine - 1e-9)
        x, y, part = x[keep], y[keep], part[keep]
        cosine = part + rest_of(x, y, False) + rest_of(y, x, True)
        keep = cosine >= min_cosine
        yield x[keep], y[keep], cosine[keep]
        if same:  # the lists go on without these rows
            gone = np.bincount(gram[e], minlength=n_grams)
            start, length = start + gone, length - gone
        first = last


def cosine_join(unit: DataFrame, min_cosine: float = MIN_COSINE, rest: float = INDEX_REST) -> DataFrame:
    """All pairs of vectors with at least min_cosine: (a, b, cosine), a < b; exact.

    Only a vector's rarer grams are indexed, down to a remainder of length `rest`: a pair above min_cosine has at
    least min_cosine - rest in its indexed grams, so that few pairs are worked out in full. Names that share a gram grow as
    the square of the names: they are met within a task, for each pair of blocks of names, and only pairs above min_cosine leave it.
    """
    entries = F.sort_array(F.collect_list(F.struct("df", "gram", "weight")))  # as many as the name has grams
    names = checkpoint(unit.groupBy("id").agg(entries.alias("v")).select("id", F.col("v.gram").alias("grams"), F.col("v.weight").alias("weights")))
    n = names.count()
    blocks = max(1, min(BLOCKS, n // LEAST_NAMES), -(-n // BLOCK_NAMES))
    own, other = F.col("own"), F.col("other")
    sent = names.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    sent = sent.select(F.least(own, other).alias("x"), F.greatest(own, other).alias("y"), (own > other).alias("second"), "id", "grams", "weights")

    def run(table: pa.Table) -> pa.Table:
        same = table["x"][0] == table["y"][0]
        table = table.sort_by("second")
        ids, split = table["id"].to_numpy(), len(table) if same else len(table) - pc.sum(table["second"]).as_py()
        gram = pc.dictionary_encode(pc.list_flatten(table["grams"]).combine_chunks())
        parts = near_rows(pc.list_value_length(table["grams"]).to_numpy().astype(np.int64), gram.indices.to_numpy().astype(np.int64), pc.list_flatten(table["weights"]).to_numpy(), split, min_cosine, rest)
        x, y, cosine = (np.concatenate(part) for part in zip((ids[:0], ids[:0], np.zeros(0)), *((ids[x], ids[y], c) for x, y, c in parts)))
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y), "cosine": cosine})

    tasks = blocks * (blocks + 1) // 2
    return sent.repartition(tasks, "x", "y").groupBy("x", "y").applyInArrow(run, "a long, b long, cosine double")


def top_partners(pairs: DataFrame, n: int | None = TOP_N, sure: float = SURE_COSINE) -> DataFrame:
    """Pairs among the n best of either partner, and all at or above `sure`, so that the cap loses no likely link; all pairs if n is None."""
    if n is None:
        return pairs
    ends = F.array(F.col("a"), F.col("b"))
    weak = pairs.where(F.col("cosine") < sure)
    order = Window.partitionBy("own").orderBy(F.col("cosine").desc(), "a", "b")
    best = weak.withColumn("own", F.explode(ends)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("a", "b", "cosine").distinct()
    return pairs.where(F.col("cosine") >= sure).unionByName(best)


def word_likeness(a: str, b: str) -> float:
    """1 less the share of letters that were dropped, added, changed or swapped with their neighbour."""
    if a == b:
        return 1.0
    if abs(len(a) - len(b)) > 3:
        return 0.0
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        before, row = row, new
    return 1 - row[-1] / max(len(a), len(b))


def _part_likeness(a: str, b: str) -> float:
    """Likeness of two words, one of which may be cut short or an initial."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if len(short) == 1:
        return 0.9 if long[0] == short else 0.0
    if len(short) >= 3 and len(short) < len(long) and long.startswith(short):
        return max(0.9, word_likeness(a, b))
    return word_likeness(a, b)


def _run_together(word: str, parts: list[str]) -> float:
    """Whether a word is made of the beginnings of two others, in either order."""
    for first, second in (parts, parts[::-1]):
        for i in range(3, len(word) - 1):
            if first.startswith(word[:i]) and second.startswith(word[i:]) and i >= 0.5 * len(first) and len(word) - i >= 0.5 * len(second):
                return 0.95
    return 0.0


def name_likeness(a: str, b: str, common: frozenset[str]) -> float:
    """Likeness of two forms by their telling words: what the least like pair of words allows.

    Words may stand in another order, be mistyped, cut short, initials, run together or left out; one
    name's first word, or its last one beside a common word, stands for the whole better than another.
    """
    (u, where_u), (w, where_w) = core(a.split(), common), core(b.split(), common)
    if len(u) > len(w):
        u, w, where_u, where_w = w, u, where_w, where_u
    if not u:
        return 0.0
    if len(u) == 1 and len(w) == 2 and len(u[0]) >= 6 and (joined := _run_together(u[0], w)):
        return joined
    free, scores, places = list(range(len(w))), [], []
    for x in sorted(u, key=len, reverse=True):
        score, place = max((_part_likeness(x, w[k]), -k) for k in free)
        free.remove(-place)
        scores.append(score)
        places.append(-place)
    worst = min(scores)
    if all(len(x) == 1 for x in u):
        return 0.0
    if len(u) == len(w):
        return worst
    if len(u) > 1:
        return 0.95 * worst
    typical = (places[0] == 0 and not where_u) or (places[0] == len(w) - 1 and where_u == "end")
    return worst * (0.85 if typical else 0.75)


def likenesses(pairs: DataFrame, forms: DataFrame, common: list[str]) -> DataFrame:
    """Pairs with their likeness, a mean of the cosine and the comparison of words: (a, b, s)."""
    common_set = frozenset(common)
    text = forms.select("id", "form")
    both = pairs.join(text.select(F.col("id").alias("a"), F.col("form").alias("fa")), "a").join(text.select(F.col("id").alias("b"), F.col("form").alias("fb")), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words = [name_likeness(x, y, common_set) for x, y in zip(pdf.fa, pdf.fb)]
            yield pd.DataFrame({"a": pdf.a, "b": pdf.b, "s": [0.15 * c + 0.85 * s for c, s in zip(pdf.cosine, words)]})

    return both.mapInPandas(run, "a long, b long, s double")


def components(pairs: DataFrame) -> DataFrame:
    """The least id that each id of (a, b) can be reached from: (id, component).

    Labels sink along the pairs to whole components, and jump along themselves, so that the rounds grow about as the logarithm of the longest path.
    """
    both = checkpoint(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = checkpoint(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        name = labels.select(F.col("id").alias("b"), F.col("component").alias("other"))
        sunk = both.join(name, "b").groupBy(F.col("a").alias("id")).agg(F.min("other").alias("other"))
        lower = checkpoint(labels.join(sunk, "id").select("id", F.col("component").alias("before"), F.least("component", "other").alias("b")))
        hooked = lower.where("b < before").groupBy(F.col("before").alias("id")).agg(F.min("b").alias("hook"))  # what a component's members have found sinks to its least id
        if hooked.isEmpty():
            return labels
        now = checkpoint(lower.join(hooked, "id", "left").select("id", F.least("b", "hook").alias("b")))
        jump = now.select(F.col("id").alias("b"), F.col("b").alias("other"))
        labels = checkpoint(now.join(jump, "b").select("id", F.least("b", "other").alias("component")))


def link(mass: dict[int, float], likeness: dict[tuple[int, int], float], threshold: float) -> dict[int, int]:
    """Average linkage of a few names, the most alike pair of groups first; of equal ones that of the smaller ids. A group is named by its least id."""
    total = {(i, j): s * mass[i] * mass[j] for (i, j), s in likeness.items()}
    mass, group = dict(mass), {i: i for i in mass}
    while total:
        avg, a, b = max((round(t / (mass[i] * mass[j]), 9), -i, -j) for (i, j), t in total.items())
        if avg < threshold:
            break
        a, b = -a, -b
        mass[a] += mass.pop(b)
        group = {i: a if c == b else c for i, c in group.items()}
        for i, j in [k for k in total if b in k]:
            t, other = total.pop((i, j)), i + j - b
            if other != a:
                key = min(a, other), max(a, other)
                total[key] = total.get(key, 0.0) + t
    return group


def average_linkage(nodes: DataFrame, pairs: DataFrame, threshold: float = LINKAGE, component_names: int = COMPONENT_NAMES) -> DataFrame:
    """Groups by average linkage: (id, cluster). nodes: (id, mass), pairs: (a, b, s) with a < b; absent pairs count as 0.

    A spelling weighs as much as its rows. Groups that hold no pair at or above the threshold never merge, so each connected
    component of such pairs is linked on its own: those of at most component_names names many to a task, larger ones by rounds of joins. Ties go to the smaller ids.
    """
    nodes, pairs = checkpoint(nodes.select("id", F.col("mass").cast("double").alias("mass"))), checkpoint(pairs.select("a", "b", "s"))
    member = components(pairs.where(F.col("s") >= threshold))
    sizes = member.groupBy("component").agg(F.count(F.lit(1)).alias("names"))
    placed = checkpoint(member.join(sizes, "component").join(nodes, "id"))
    a, b = (placed.select(F.col("id").alias(x), F.col("component").alias(f"c{x}"), "names") for x in "ab")
    inner = checkpoint(pairs.join(a, "a").join(b.drop("names"), "b").where("ca = cb").select(F.col("ca").alias("component"), "names", "a", "b", "s"))
    small, large = F.col("names") <= component_names, F.col("names") > component_names
    rows = placed.where(small).select("component", F.col("id").alias("a"), F.col("id").alias("b"), F.col("mass").alias("s")).unionByName(inner.where(small).drop("names"))
    buckets = max(1, rows.count() // BUCKET_ROWS)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in pdf.groupby("component", sort=False):
            mass, likeness = {}, {}
            for i, j, s in zip(part.a.tolist(), part.b.tolist(), part.s.tolist()):
                if i == j:
                    mass[i] = s
                else:
                    likeness[i, j] = s
            out += link(mass, likeness, threshold).items()
        return pd.DataFrame(out, columns=["id", "cluster"])

    linked = rows.groupBy(F.pmod(F.xxhash64("component"), F.lit(buckets))).applyInPandas(run, "id long, cluster long")
    rest = placed.where(large)
    if not rest.isEmpty():
        linked = linked.unionByName(linked_by_joins(rest.select("id", "mass"), inner.where(large).select("a", "b", "s"), threshold))
    return nodes.select("id").join(linked, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))


def linked_by_joins(nodes: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Average linkage whose groups may be of any size: (id, cluster).

    In each round all pairs of groups that are each other's nearest merge at once; for average linkage this gives the
    same groups as merging one pair at a time. It ends when nothing merges any more. No group meets in one task.
    """
    clusters = checkpoint(nodes.select("id", F.col("id").alias("cluster")))
    sizes = checkpoint(nodes.select(F.col("id").alias("c"), "mass"))

    def weighed(links: DataFrame, sizes: DataFrame) -> DataFrame:
        return links.join(sizes.select(F.col("c").alias("a"), F.col("mass").alias("ma")), "a").join(sizes.select(F.col("c").alias("b"), F.col("mass").alias("mb")), "b")

    links = checkpoint(weighed(pairs, sizes).select("a", "b", (F.col("s") * F.col("ma") * F.col("mb")).alias("total"), "ma", "mb"))
    while True:
        rated = links.select("a", "b", F.round(F.col("total") / (F.col("ma") * F.col("mb")), 9).alias("avg")).where(F.col("avg") >= threshold)
        ends = F.array(F.struct(F.col("a").alias("c"), F.col("b").alias("other")), F.struct(F.col("b").alias("c"), F.col("a").alias("other")))
        key = F.struct("avg", (-F.col("a")).alias("na"), (-F.col("b")).alias("nb"))
        best = rated.select(key.alias("k"), F.explode(ends).alias("e")).groupBy("e.c").agg(F.max(F.struct("k", "e.other")).alias("m")).select("c", "m.other")
        mutual = best.alias("x").join(best.alias("y"), (F.col("x.other") == F.col("y.c")) & (F.col("y.other") == F.col("x.c")) & (F.col("x.c") < F.col("x.other")))
        merges = checkpoint(mutual.select(F.col("x.other").alias("old"), F.col("x.c").alias("new")))
        if merges.isEmpty():
            return clusters

        def renamed(df: DataFrame, column: str, merges: DataFrame = merges) -> DataFrame:
            to = merges.select(F.col("old").alias(column), F.col("new").alias("_new"))
            return df.join(to, column, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")

        clusters = checkpoint(renamed(clusters, "cluster"))
        sizes = checkpoint(renamed(sizes, "c").groupBy("c").agg(F.sum("mass").alias("mass")))
        moved = renamed(renamed(links.select("a", "b", "total"), "a"), "b").where("a <> b")
        summed = moved.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("total").alias("total"))
        links = checkpoint(weighed(summed, sizes).select("a", "b", "total", "ma", "mb"))


def spellings(rows: DataFrame, column: str) -> DataFrame:
    """Every distinct stored value with its group: (value, form, cluster).

    Values whose forms agree are one spelling from the start. Null is no name; values without a letter or digit
    stay on their own. An empty table gives an empty result.
    """
    values = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).withColumn("form", form(F.col("value")))
    values = checkpoint(values.withColumn("form", F.when(F.col("form") == "", F.concat(F.lit("="), F.col("value"))).otherwise(F.col("form"))))
    forms = checkpoint(checkpoint(values.groupBy("form").agg(F.sum("n").alias("mass"))).withColumn("id", F.monotonically_increasing_id()))
    linkable = forms.where(~F.col("form").startswith("="))
    common = common_endings(linkable)
    unit = vectors(gram_counts(linkable, common), max(1, linkable.count()))
    pairs = likenesses(top_partners(cosine_join(unit)), linkable, common)
    clusters = average_linkage(forms.select("id", "mass"), pairs)
    return values.join(forms.select("form", "id"), "form").join(clusters, "id").select("value", "form", "cluster")


def linked_pairs(groups: DataFrame) -> DataFrame:
    """Each pair of different stored values of one group once, the smaller by code point first: (a, b). A large group's values are spread over tasks."""
    slots = groups.groupBy("cluster").agg(spread().alias("slots"))
    each = groups.select("cluster", "value").join(slots, "cluster")
    x = each.select("cluster", F.col("value").alias("a"), F.pmod(F.xxhash64("value"), F.col("slots")).alias("slot"))
    y = each.select("cluster", F.col("value").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)).alias("slot"))
    return x.join(y, ["cluster", "slot"]).where(F.col("a") < F.col("b")).select("a", "b")
