"""Evaluation passages inside a corpus: Wu-Manber search for item phrases, then alignment word by word."""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.session import checkpoint

#: Words of a search string and its least length in characters.
PHRASE_WORDS, PHRASE_CHARS = 3, 9
#: Characters of a block of the shift table.
BLOCK = 4
#: Places of the text that one lane of the search covers.
LANE = 256
#: Diagonals of document against item so near to each other are one band.
BAND = 16
#: A band's passage is aligned if search strings cover so many words of it beyond half of those between them, in halves of a word: below what
#: counts, since a mistyped word costs an alignment nothing but is covered by no search string.
COVER = 18
#: Words before the first and after the last of them that are aligned as well.
MARGIN = 20
#: Halves of a word: what an alignment gains by a word in common (one typing slip allowed), and pays for a changed or missing and for an added one.
COMMON, CHANGED, ADDED = 2, 10, 1
#: What an alignment must reach, and its words in common: 15 less about one in eight. Names put into stock sentences don't reach it.
LEAST, WORDS = 22, 13
#: A stretch of so many words in common counts as well, with one slip in between at most.
STRETCH = 15
#: Words of items that are searched for at once: what is sent to the executors. More take further passes over the corpus, with the same result.
BLOCK_WORDS = 400_000
#: Documents of one batch of the search, and cells of one row of the alignments that advance together.
BATCH, CELLS = 2_000, 1 << 15

_LETTERS = 38  # 0 a separator, then a-z, 0-9 and any other letter
_TAGS = re.compile(r"<[^<>\n]*>|\[/?[A-Za-z]+(?:=[^\[\]\n]*)?\]")
_DROP, _START = 255, 254
_BETWEEN = "\n\x1e"  # stands before each text; no entity and no markup reaches over it


def _class_table() -> np.ndarray:
    """Code of every character after compatibility decomposition: marks are dropped, other letters share one code."""
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x3000):
        kind = unicodedata.category(chr(c))
        table[c] = _DROP if kind[0] == "M" or kind == "Cf" else 37 if kind[0] in "LN" else 0
    table[0x3000:0xE000] = 37
    table[0xFE00:0xFE10] = table[0xFEFF] = _DROP
    table[0x1E] = _START
    for i in range(26):
        table[ord("a") + i] = 1 + i
    for i in range(10):
        table[ord("0") + i] = 27 + i
    return table


_TABLE = _class_table()
_ALPHABET = np.array([32, *range(97, 123), *range(48, 58), 42], np.uint8)


def normalise(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of letter codes with single separators, and the place where each text starts: a separator of its own.

    Case, accents, punctuation, markup, entities and line breaks leave no trace but a separator.
    """
    joined = "".join(_BETWEEN + t.replace("\x1e", " ") for t in texts)
    plain = unicodedata.normalize("NFKD", _TAGS.sub(" ", html.unescape(joined)).casefold())
    codes = _TABLE[np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    codes = codes[codes != _DROP]
    start = codes == _START
    codes[start] = 0
    keep = start.copy()
    keep[1:] |= (codes[1:] != 0) | (codes[:-1] != 0)
    return codes[keep], np.flatnonzero(start[keep])


def words_of(text: str) -> list[str]:
    """The normalised words of one text."""
    return _ALPHABET[normalise([text])[0]].tobytes().decode().split()


class Search:
    """Wu-Manber tables of many search strings and the occurrences of these in a batch of texts."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.m = min(map(len, strings))
        heads = np.array([list(s[: self.m]) for s in strings], np.int32)
        blocks = np.zeros((len(strings), self.m - BLOCK + 1), np.int32)
        for k in range(BLOCK):
            blocks = blocks * _LETTERS + heads[:, k : self.m - BLOCK + 1 + k]
        self.shift = np.full(_LETTERS**BLOCK, self.m - BLOCK + 1, np.uint8)
        for j in range(blocks.shape[1]):  # from the left, so that the least shift stays
            self.shift[blocks[:, j]] = blocks.shape[1] - 1 - j
        self.bucket = np.argsort(blocks[:, -1], kind="stable")  # strings by the suffix of their heads
        self.suffix = blocks[self.bucket, -1]
        self.prefix = blocks[:, 0]

    @staticmethod
    def _blocks(codes: np.ndarray) -> np.ndarray:
        """The block that ends at each place, as a number; places before the first full block hold 0."""
        out = np.zeros(len(codes), np.int32)
        wide = codes.astype(np.int32)
        for k in range(BLOCK):
            out[BLOCK - 1 :] = out[BLOCK - 1 :] * _LETTERS + wide[k : len(codes) - BLOCK + 1 + k]
        return out

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and number of each search string that occurs.

        The text is cut into lanes that advance together, each by the shift of the block it stands on. A shift of 0
        is a possible end of a string's head: its block is the suffix that selects the bucket, whose strings are tried by their prefix and then compared.
        """
        n = len(codes)
        if n < self.m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        blocks = self._blocks(codes)
        at = np.arange(0, n, LANE)
        stop = np.minimum(at + LANE, n)
        at = np.maximum(at, self.m - 1)
        ends = []
        while len(at):
            live = at < stop
            at, stop = at[live], stop[live]
            step = self.shift[blocks[at]]
            ends.append(at[step == 0])
            at = at + np.maximum(step, 1)
        end = np.concatenate(ends)
        first, last = (np.searchsorted(self.suffix, blocks[end], side) for side in ("left", "right"))
        times = last - first
        start = np.repeat(end - (self.m - 1), times)
        which = self.bucket[np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first, times)]
        alike = blocks[start + BLOCK - 1] == self.prefix[which]
        start, which = start[alike], which[alike]
        text = codes.tobytes()
        true = np.fromiter((text.startswith(self.strings[w], a) for a, w in zip(start.tolist(), which.tolist())), bool, len(start))
        return start[true], which[true]


def _slips(word: str) -> bool:
    return len(word) > 3 and not word.isdigit()


def _near(word: str) -> set[str]:
    """Keys that a word shares with those one typing slip away; short words and numbers allow no slip."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))} if _slips(word) else {word}


def align(passages: list[np.ndarray], items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the best local alignment of each passage with its item the score, in halves of a word, and the words in common; then the longest stretch.

    A passage is an array of words by the numbers of all item words each may be, filled up with -1; an item is the
    numbers of its words. All pairs advance together, word by word. A gap of more than 7 missing words costs more than a passage
    needs, so that no gap beyond that decides.
    """
    tall, wide, ways = max(map(len, passages)), max(map(len, items)), max(p.shape[1] for p in passages)
    kind, room = (np.int32, 1 << 11) if wide < 1 << 11 else (np.int64, 1 << 31)
    unit, common, changed, added = (kind(x * room) for x in (1, COMMON, CHANGED, ADDED))  # scores, with room for the count of words in common
    words = np.full((len(items), wide), -2, kind)
    text = np.full((tall, ways, len(passages), 1), -1, kind)
    for s, (passage, item) in enumerate(zip(passages, items)):
        words[s, : len(item)] = item
        text[: len(passage), : passage.shape[1], s, 0] = passage
    row, new, best, exact, new_exact, slip, new_slip, longest = (np.zeros((len(passages), wide + 1), kind) for _ in range(8))
    step, match, other = np.zeros(words.shape, kind), np.zeros(words.shape, bool), np.zeros(words.shape, bool)
    back = np.zeros_like(row)
    some = (text[:, 1:] >= 0).any(axis=(2, 3))
    for t in range(tall):  # past the end of a shorter passage nothing matches, so its best stays
        np.equal(words, text[t, 0], out=match)
        for k in np.flatnonzero(some[t]).tolist():
            match |= np.equal(words, text[t, k + 1], out=other)
        np.multiply(match, common + changed + kind(1), out=step)
        step += row[:, :-1]
        step -= changed
        np.subtract(row, added, out=new)
        np.maximum(new[:, 1:], step, out=new[:, 1:])
        np.multiply(new, new >= unit, out=new)
        for gap in (1, 2, 4):  # item words that are missing
            if wide > gap:
                np.subtract(new[:, :-gap], kind(gap) * changed, out=back[:, gap:])
                np.maximum(new[:, gap:], back[:, gap:], out=new[:, gap:])
        np.maximum(best, new, out=best)
        row, new = new, row
        np.multiply(exact[:, :-1] + kind(1), match, out=new_exact[:, 1:])  # words in common without a slip, then with one
        one = np.maximum(np.maximum(exact[:, :-1], exact[:, 1:]), new_exact[:, :-1])
        np.copyto(new_slip[:, 1:], np.where(match, slip[:, :-1] + (slip[:, :-1] > 0), one))
        np.maximum(longest, np.maximum(new_exact, new_slip), out=longest)
        exact, new_exact, slip, new_slip = new_exact, exact, new_slip, slip
    top = best.max(axis=1)
    return top // room, top % room, longest.max(axis=1)


class Items:
    """The texts of one block of items with their search strings, sent to every task."""

    def __init__(self, rows: list[tuple[int, list[str]]]):
        self.ids = [i for i, _ in rows]
        self.number: dict[str, int] = {}
        self.words = [np.array([self.number.setdefault(w, len(self.number)) for w in words], np.int32) for _, words in rows]
        self.loose: dict[str, list[int]] = defaultdict(list)
        for w, n in self.number.items():
            for key in _near(w):
                self.loose[key].append(n)
        phrases = defaultdict(list)
        for item, (_, words) in enumerate(rows):
            for k in range(len(words) - PHRASE_WORDS + 1):
                phrase = " ".join(words[k : k + PHRASE_WORDS])
                if len(phrase) + 2 >= PHRASE_CHARS:
                    phrases[phrase].append((item, k))
        letters = {chr(c): i for i, c in enumerate(_ALPHABET.tolist())}
        self.strings = [bytes(letters[c] for c in f" {p} ") for p in phrases]
        self.first = np.cumsum([0, *map(len, phrases.values())])  # of each search string among the places
        self.places = np.array([x for at in phrases.values() for x in at], np.int64).reshape(-1, 2)
        self.search: Search | None = None

    def may_be(self, word: str) -> list[int]:
        """The item words that a word of a document may stand for: itself and those one typing slip away."""
        own = [self.number[word]] if word in self.number else []
        return own + [n for n in {n for key in _near(word) for n in self.loose.get(key, ())} if n not in own] if _slips(word) else own

    def spans(self, starts: np.ndarray, word: np.ndarray, where: np.ndarray, which: np.ndarray) -> np.ndarray:
        """(text, item, first and last word) of each band of neighbouring diagonals of which search strings cover enough words."""
        times = self.first[which + 1] - self.first[which]
        at = np.repeat(where + 1, times)
        place = self.places[np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(self.first[which], times)]
        doc, at = np.searchsorted(starts, at, "right") - 1, word[at]
        item, diagonal = place[:, 0], at - place[:, 1]
        order = np.lexsort((at, diagonal, item, doc))
        doc, item, diagonal, at = doc[order], item[order], diagonal[order], at[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > BAND)
        first = np.flatnonzero(new)
        band = np.cumsum(new) - 1
        order = np.lexsort((at, band))  # now by place within a band
        at = at[order]
        ahead = np.zeros(len(at), np.int64)  # words since the search string before it, in the same band
        ahead[1:] = np.where(band[1:] == band[:-1], at[1:] - at[:-1], 0)
        gap = np.maximum(ahead - PHRASE_WORDS, 0)
        total = np.cumsum(COMMON * np.where(new, PHRASE_WORDS, np.minimum(ahead, PHRASE_WORDS)) - ADDED * gap)
        before = total - COMMON * np.where(new, PHRASE_WORDS, np.minimum(ahead, PHRASE_WORDS)) - (band << 40)
        most = np.maximum.reduceat(total - (np.minimum.accumulate(before) + (band << 40)), first) if len(first) else first
        found = np.stack([doc[first], item[first], np.minimum.reduceat(at, first), np.maximum.reduceat(at, first)], axis=1) if len(first) else np.zeros((0, 4), np.int64)
        return found[most >= COVER]

    def leaks(self, texts: list[str]) -> dict[tuple[int, int], float]:
        """(number of text, id of item) of every passage that counts, with its score in words."""
        if not self.strings or not texts:
            return {}
        if self.search is None:
            self.search = Search(self.strings)
        codes, starts = normalise(texts)
        where, which = self.search.find(codes)
        if not len(where):
            return {}
        begins = np.zeros(len(codes), bool)
        begins[1:] = (codes[1:] != 0) & (codes[:-1] == 0)
        word = np.cumsum(begins) - 1  # the number of the word at a place, over all texts; before a text's first word, that of the word before
        spans = self.spans(starts, word, where, which)
        letters, bounds, lead = _ALPHABET[codes].tobytes(), np.append(starts, len(codes)), word[starts] + 1
        cut: dict[int, np.ndarray] = {}
        known: dict[str, list[int]] = {}
        for doc in np.unique(spans[:, 0]).tolist():
            words = letters[bounds[doc] : bounds[doc + 1]].decode().split()
            for w in words:
                if w not in known:
                    known[w] = self.may_be(w)
            ways = max(len(known[w]) for w in words)
            cut[doc] = np.array([known[w] + [-1] * (ways - len(known[w])) for w in words], np.int32)
        found: dict[tuple[int, int], float] = {}
        pairs = [(doc, item, cut[doc][max(0, low - lead[doc] - MARGIN) : high - lead[doc] + PHRASE_WORDS + MARGIN]) for doc, item, low, high in spans.tolist()]
        pairs.sort(key=lambda p: len(p[2]))
        step = max(1, CELLS // max([1, *map(len, self.words)]))
        for k in range(0, len(pairs), step):
            part = pairs[k : k + step]
            scores, commons, stretches = align([p for _, _, p in part], [self.words[i] for _, i, _ in part])
            for (doc, item, _), score, common, stretch in zip(part, scores.tolist(), commons.tolist(), stretches.tolist()):
                if score >= LEAST and common >= WORDS or stretch >= STRETCH:
                    key = doc, self.ids[item]
                    found[key] = max(found.get(key, 0.0), score / 2)
        return found


def item_texts(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The different texts of the items, (text_id, words), and which items have them, (item_id, text_id).

    Items that agree word by word are one text, named by the least of their ids. Null texts and those of fewer than WORDS words are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"item_id": pdf.item_id, "words": [words_of(t) if t else [] for t in pdf.text]})

    cut = items.where("item_id IS NOT NULL").select("item_id", "text").mapInPandas(run, "item_id long, words array<string>").where(F.size("words") >= WORDS)
    named = cut.withColumn("key", F.sha2(F.array_join("words", " "), 256))
    named = checkpoint(named.join(named.groupBy("key").agg(F.min("item_id").alias("text_id")), "key").drop("key"))
    return named.where("item_id = text_id").dropDuplicates(["text_id"]).select("text_id", "words"), named.select("item_id", "text_id").distinct()


_FOUND = "doc_id long, text_id long, score double"


def leaks(docs: DataFrame, items: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Leaking documents with their items: (doc_id, item_id, score), once each; the score is words in common less what the slips cost.

    Every text is searched whole; null, empty and blank texts, and items of fewer than WORDS words, leak nothing.
    Repeated documents and repeated item texts all come out. Items are searched for in blocks of about block_words words, so that what is
    sent to the executors has a bound; the result is the same whatever the blocks and the other items.
    """
    spark = docs.sparkSession
    texts, members = item_texts(items)
    total = texts.agg(F.sum(F.size("words")).alias("n")).first().n or 0
    blocks = max(1, math.ceil(total / block_words))
    whole = spark.createDataFrame([], _FOUND)
    for b in range(blocks if total else 0):
        part = texts.where(F.pmod(F.xxhash64("text_id"), F.lit(blocks)) == b).collect()  # one block, of bounded size
        shared = spark.sparkContext.broadcast(Items([(r.text_id, r.words) for r in part]))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            block = shared.value
            for pdf in batches:
                pdf = pdf[pdf.text.notna()]
                for start in range(0, len(pdf), BATCH):
                    some = pdf.iloc[start : start + BATCH]
                    ids = some.doc_id.tolist()
                    found = block.leaks(some.text.tolist())
                    yield pd.DataFrame([(ids[doc], item, score) for (doc, item), score in found.items()], columns=["doc_id", "text_id", "score"])

        found = docs.select("doc_id", "text").mapInPandas(run, _FOUND)
        whole = whole.unionByName(found) if b else found
    best = whole.groupBy("doc_id", "text_id").agg(F.max("score").alias("score"))
    return best.join(members, "text_id").select("doc_id", "item_id", "score")


def leaked_items(found: DataFrame, items: DataFrame) -> DataFrame:
    """Report per item: (item_id, suite, split, n_docs), items that leak nowhere with 0."""
    counts = found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"))
    return items.select("item_id", "suite", "split").join(counts, "item_id", "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0)))
