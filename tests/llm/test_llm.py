"""Text problems on small fixtures: edge cases, exact round trips, brute force and accuracy on made cases."""

import base64
import os
import random
import re

import numpy as np
import pytest

from tallyforge.llm import cut, encode, leak, spelling

DOCS = "doc_id long, author string, lang string, source string, text string, odds double, n int"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, "ann", "en", "s", t, 0.0, 1) for i, t in enumerate(texts)], DOCS)


# token ids

VOCABULARY = os.path.join(encode.TOKENIZER_FOLDER, encode.VOCABULARY)
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="needs the vocabulary files")


@needs_vocabulary
def test_ids_equal_a_second_tokenizer_and_decode_back(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    other = tiktoken.Encoding("own", pat_str=encode.PRETOKEN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    texts = [None, "", " ", "Don't  stop\n\n now!", "é" * 9, "<|endoftext|>", "a" * 60_000, "  \t x  ", "日本語と 1234567890", "x\u0000y"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x2000), rng.randrange(0x1F300, 0x1F600)])) for _ in range(60)) for _ in range(200)]
    df = docs_of(spark, texts)
    ids = encode.encode(df)
    found = {r.doc_id: r.ids for r in ids.collect()}
    assert found == {i: other.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    back = {r.doc_id: r.text for r in encode.decode(ids).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert encode.encode(df.limit(0)).count() == 0 and encode.encode(df.union(df)).count() == 2 * len(texts)


# leaked passages

def word(rng):
    """An invented name; few of them are one slip apart."""
    return "".join(rng.choice("bcdfgjklmnprstvz") + rng.choice("aeiou") for _ in range(4)) + rng.choice("xnrs")


def item_text(rng):
    return ". ".join(f"Le greffier {word(rng).title()} a relu {rng.randrange(3000)} feuilles avant d'ouvrir la salle de {word(rng)} et la boîte du {word(rng)}" for _ in range(5))


def mutated(words, rng, rate):
    out = []
    for w in words:
        x = rng.random()
        if x >= rate:
            out.append(w)
        elif x < rate / 3 and len(w) > 3:
            out.append(w[:1] + w[2:])
        elif x < 2 * rate / 3:
            out.append("autre")
        else:
            out += [w, "vraiment"]
    return out


def test_leaks_are_found_through_slips_and_other_texts_are_not(spark):
    rng = random.Random(4)
    items = [(i, item_text(rng)) for i in range(30)]
    texts, expected = [None, "", "   ", "x" * 200_000, items[0][1][:60]], set()
    for i, text in items:
        words = text.split()
        k = rng.randrange(len(words) - 32)
        part = " ".join(mutated(words[k : k + 30], rng, 0.125))
        part = {0: part.upper(), 1: part.replace(" ", "\n> ", 3), 2: "<b>" + part.replace(" ", "&nbsp;", 2) + "</b>"}[i % 3]
        texts.append(f"{item_text(random.Random(1000 + i))} {part} suite du fil")
        expected.add((len(texts) - 1, i))
        texts.append(item_text(random.Random(2000 + i)))
        texts.append("Bon. " + " ".join(words[k : k + 6]) + " enfin " + " ".join(rng.sample(words, 8)))
    table = spark.createDataFrame([*items, (98, None), (99, "")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in leak.leaks(docs_of(spark, texts), table).collect()}
    assert len(found & expected) >= 29 and not found - expected
    assert leak.leaks(docs_of(spark, texts), table.limit(0)).count() == 0
    assert leak.leaks(docs_of(spark, []), table).count() == 0


def found_pairs(spark, texts, table, **kw):
    return {(r.doc_id, r.item_id) for r in leak.leaks(docs_of(spark, texts), table, **kw).collect()}


@pytest.mark.parametrize("hollow", ["", "   ", "...", "<p></p>", "\u0301", "\x1e"])
def test_texts_without_words_leak_nothing_wherever_they_stand(hollow):
    passage = "the clerk counted forty sheets before opening the blue envelope and then the mayor read every second one aloud"
    block = leak.Items([(7, leak.words_of(passage))])
    for texts in ([passage, hollow], [hollow, passage], [hollow, passage, hollow], [hollow], [passage, *[hollow] * 2001]):
        assert set(block.leaks(texts)) == {(i, 7) for i, t in enumerate(texts) if t == passage}


def test_blocks_copies_and_other_items_change_nothing(spark):
    rng = random.Random(8)
    items = [(i, item_text(rng)) for i in range(12)]
    texts = [" ".join(mutated(t.split()[5:40], rng, 0.1)) for _, t in items] + [t for _, t in items]
    schema = "item_id long, text string"
    alone = found_pairs(spark, texts, spark.createDataFrame(items, schema))
    assert {(12 + i, i) for i in range(12)} <= alone
    copies = spark.createDataFrame([(i + 100 * c, t) for i, t in items for c in range(4)], schema)
    expected = {(d, i + 100 * c) for d, i in alone for c in range(4)}
    assert found_pairs(spark, texts, copies) == expected
    assert found_pairs(spark, texts, copies, block_words=300) == expected
    assert found_pairs(spark, texts, copies, block_words=100) == expected


def test_stock_words_verbatim_and_through_long_markup_are_found(spark):
    rng = random.Random(9)
    vocabulary = [word(rng) for _ in range(24)]
    items = [(i, " ".join(rng.sample(vocabulary, 20))) for i in range(6)]
    words = items[0][1].split()
    changed = [*words[:7], "autre", *words[8:16]]
    markup = " ".join(words[:9]) + f'<a href="{"x" * 900}">' + " ".join(words[9:16]) + "</a>"
    texts = [items[0][1], " ".join(words[3:18]), " ".join(changed), markup, " ".join(words[:9]), " ".join(sorted(words))]
    assert found_pairs(spark, texts, spark.createDataFrame(items, "item_id long, text string")) == {(k, 0) for k in range(4)}


def test_long_passages_of_stock_words_are_leaks(spark):
    stock = "avant que la salle ouvre le greffier compte deux fois chaque feuille puis ferme la porte et range son livre dans une grande boite sous le banc".split()
    items = [(i, random.Random(i).sample(stock, len(stock))) for i in range(6)]  # every word stands in all items
    table = spark.createDataFrame([(i, " ".join(words)) for i, words in items], "item_id long, text string")
    own = items[0][1]
    texts = [[*own[:16]], [*own[:8], "autre", *own[9:16]], [*own[:8], "bon", *own[8:16]], own[:9], [*own[:7], "bon", "non", "si", *own[7:11]], random.Random(9).sample(stock, 20)]
    block = leak.Items(items)
    numbered = [np.array([[block.number.get(w, -1)] for w in t], np.int32) for t in texts[:5]]
    assert leak.align(numbered, [block.words[0]] * 5)[2].tolist() == [16, 15, 16, 9, 7]
    docs = spark.createDataFrame([(i, "fin. " + " ".join(t) + " zut") for i, t in enumerate(texts)], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leak.leaks(docs, table).collect()} == {(0, 0), (1, 0), (2, 0)}


def test_alignment_agrees_with_the_recurrence():
    rng = np.random.default_rng(3)
    for _ in range(60):
        item, text = rng.integers(0, 6, rng.integers(3, 30)), rng.integers(-1, 6, (rng.integers(3, 40), 2))
        last, best = [0] * (len(item) + 1), 0
        for a, b in text.tolist():
            row = [0] * (len(item) + 1)
            for j, w in enumerate(item.tolist(), 1):
                row[j] = max(0, last[j - 1] + (leak.COMMON if w in (a, b) else -leak.CHANGED), last[j] - leak.ADDED, row[j - 1] - leak.CHANGED)
            best, last = max(best, *row), row
        pads = [np.full((5, 1), -1, np.int32), text.astype(np.int32)]
        assert leak.align(pads, [np.arange(3, dtype=np.int32), item.astype(np.int32)])[0][1] == best


def test_search_finds_what_brute_force_finds():
    rng = random.Random(6)
    strings = list({bytes([0, *(rng.randrange(1, 4) for _ in range(rng.randrange(8, 14))), 0]) for _ in range(40)})
    body = bytes(rng.choice([0, 1, 2, 3]) for _ in range(30_000))
    for s in strings[:30]:
        k = rng.randrange(len(body) - 20)
        body = body[:k] + s + body[k + len(s) :]
    where, which = leak.Search(strings).find(np.frombuffer(body, np.uint8))
    expected = {(m.start(), i) for i, s in enumerate(strings) for m in re.finditer(b"(?=" + re.escape(s) + b")", body)}
    assert set(zip(where.tolist(), which.tolist())) == expected and len(expected) >= 20


# cut texts


def posts(rng, n):
    subjects = ["the late poll", "a rural sample", "this old thread", "the border count", "my spreadsheet", "the web panel"]
    verbs = ["mirrors", "hides", "settles", "follows", "breaks", "outlives"]
    tails = ["every spring", "once you reweight", "in both regions", "despite the rain"]
    out = []
    for _ in range(n):
        out.append(" ".join(f"{rng.choice(subjects)} {rng.choice(verbs)} {rng.choice(subjects)} {rng.choice(tails)}." for _ in range(rng.randrange(2, 7))))
    return out


def test_cut_posts_are_told_from_whole_ones(spark):
    rng = random.Random(8)
    whole = posts(rng, 1200)
    rows, truth = [], {}
    for i, text in enumerate(whole):
        kind = i % 6
        if kind == 0:
            text, truth[i] = text[: rng.randrange(20, len(text) - 1)].rstrip(), True
            if text[-1] == "." or text.endswith(("spring", "reweight", "regions", "rain")):
                truth.pop(i)
        elif kind == 1:
            text, truth[i] = text[:-1], False
        elif kind == 2:
            text, truth[i] = f"{text}\n--\nann", False
        elif kind == 3:
            text, truth[i] = text + " 😀", False
        else:
            truth[i] = False
        rows.append((i, "ann", "en", "s", text, 0.0, 1))
    rows += [(5000, None, None, None, None, None, None), (5001, "a", "en", "s", "", 0.0, 1), (5002, "a", "en", "s", " \n ", 0.0, 1), (5003, "a", None, None, "the web pan�", 0.0, 1), (5004, "ann", "en", "s", "ok.\n--\nan", 0.0, 1), (5005, "a", "en", "s", "the web panel mirr… [read more]", 0.0, 1)]
    df = spark.createDataFrame(rows, DOCS)
    found = {r.doc_id for r in cut.cut_texts(df).collect()}
    right = sum((i in found) == t for i, t in truth.items())
    assert right / len(truth) > 0.98, right / len(truth)
    assert {5003, 5004, 5005} <= found and not {5000, 5001, 5002} & found
    rates = {r.source: (r.n_texts, r.n_cut) for r in cut.cut_rates(df).collect()}
    assert sum(n for _, n in rates.values()) == len(found) and None in rates
    assert cut.cut_texts(df.limit(0)).count() == 0


def test_field_limits_stand_out(spark):
    rng = random.Random(9)
    texts = ["x" * rng.randrange(50, 101) for _ in range(300)] + ["x" * 101] * 90
    found = [tuple(r)[:3] for r in cut.field_limits(docs_of(spark, texts)).where("measure = 'chars'").collect()]
    assert ("s", "chars", 101) in found


def test_simplified_text_has_one_sign_for_each_gap():
    plain = lambda t: "".join(map(chr, cut.simplify(t)))
    assert plain("In 2024,  the\tÉTÉ\u00a0&nbsp;x") == "in 0, the été x"
    assert plain("a\n> b\r\n\n> > c > d\n>\n e 5>6") == "a\u0004b\u0003c > d\u0003e 0>0"
    assert plain("") == "" and plain("\n") == "\u0004" and plain(" \n\n") == " \u0003" and plain("😀 1\ud800") == "😀 0\ud800"


def test_counts_of_contexts_agree_with_brute_force(spark):
    rng = random.Random(5)
    texts = posts(rng, 60) + ["the web panel mir", None, "", "ab", "the rural sample hides the b", "le fil [lire la suite]"]
    docs = docs_of(spark, texts)
    contexts = cut.final_contexts(docs)
    counts = {r.ctx: (r.n_end, r.n_more) for r in cut.count_contexts(docs, cut.context_filter(contexts)).collect()}
    plain = lambda t: "\u0002" + "".join(map(chr, cut.simplify(t)))
    whole = [plain(t.split(" [")[0]) for t in texts if t]
    for r in contexts.collect():
        text = plain(cut.unmarked(texts[r.doc_id])[0])
        for n, ctx in zip(cut.ORDERS, r.ctx):
            ends = [(w, m.end()) for w in whole for m in re.finditer("(?<=" + re.escape(text[-n:]) + ")", w) if m.end() > n - 1]
            marked = text.endswith("le fil")
            end = sum(k == len(w) and not (marked and w.endswith("le fil")) or k < len(w) and w[k] in ".!?…\u0003" for w, k in ends)
            more = sum(k < len(w) and w[k] not in '.!?…\u0003\u0004<[(")»' for w, k in ends)
            assert counts.get(ctx, (0, 0)) == (end, more)
        assert len(r.ctx) == sum(len(text) >= n for n in cut.ORDERS)


def test_thresholds_part_each_language(spark):
    rng = random.Random(11)
    rows = [("en", rng.gauss(-5, 1)) for _ in range(300)] + [("en", rng.gauss(7, 1)) for _ in range(60)] + [("fr", rng.gauss(-2, 0.5)) for _ in range(300)] + [("fr", rng.gauss(8, 0.5)) for _ in range(300)] + [(None, -4.0), ("es", -3.0)]
    found = {r.lang: r.threshold for r in cut.thresholds(spark.createDataFrame(rows, "lang string, odds double")).collect()}
    assert set(found) == {"en", "fr", "es", None} and 0 <= found["en"] <= 4 and 0 <= found["fr"] <= 6 and found["es"] <= 5
    alone = cut.thresholds(spark.createDataFrame([("en", -4.0), ("en", -4.1), ("en", -6.0)], "lang string, odds double")).collect()
    assert [r.threshold for r in alone] == [cut.LEAST_THRESHOLD]
    assert cut.thresholds(spark.createDataFrame([], "lang string, odds double")).count() == 0


def test_window_hashes_tell_contexts_apart():
    codes, what, place, ends, sums, down = cut.lay_out(["abcabc", "zabc."])
    at = np.flatnonzero(place >= 3)
    h = dict(zip(at.tolist(), cut.hashes(at, 3, sums, down).tolist()))
    same = [i for i in h if h[i] == h[3]]
    assert "".join(map(chr, codes[1:4])) == "abc" and same == [3, 6, 11]
    assert what[11] == 1 and what[3] == -1 and what[6] == 1


# spellings

NAMES = {
    "Cucutru Luséstot Marketing": ["CUCUTRU LUSESTOT MARKETING", "Luséstot, Cucutru", "Cucutru", "Luséstot Marketing", "Cucutru-Luséstot Mktg", "Cucutru Lusétsot Marketing", "C. Luséstot Marketing", "Cucutlusés", "Cucutru Luséstot pour La Gazette", "Cucutru  Luséstot Marketing[2]"],
    "Sélutrun Cucutru Études": ["Sélutrun Cucutru", "Selutrun Cucutru Etudes (tél.)", "Sélutrn Cucutru Études"],
    "Dupocol Tobutut Data": ["Dupocol Tobutut DATA Inc", "Tobutut Dupocol Data"],
    "Dupocol Pugufon Data": ["Dupocol Pugu.", "dupocol pugufon data"],
    "Vizécos Bricufux Marketing": ["Vizécos Bricufux"],
    "Bapigrir Lubéjim Études": [], "Grozizir Grobriflas Data": ["Grozizir Grobriflas Data "], "Tibristis Clitudéx Marketing": [], "Jibritum Torostar Études": [], "Kalorét Zédroplal Data": [],
}


def test_spellings_of_one_firm_are_linked_and_others_are_not(spark):
    rows = [(firm, 1, "x") for firm in NAMES for _ in range(50)] + [(v, 1, "x") for variants in NAMES.values() for v in variants for _ in range(4)] + [(None, 1, "x"), ("", 1, "x"), ("?", 1, "x")]
    df = spark.createDataFrame(rows, "firm string, n int, value string")
    found = {(r.a, r.b) for r in spelling.linked_pairs(spelling.spellings(df, "firm")).collect()}
    expected = set()
    for firm, variants in NAMES.items():
        group = sorted([firm, *variants])
        expected |= {(a, b) for i, a in enumerate(group) for b in group[i + 1 :]}
    assert not found - expected
    assert len(found) >= 0.97 * len(expected), sorted(expected - found)
    assert spelling.spellings(df.limit(0), "firm").count() == 0


def test_cosine_join_equals_brute_force(spark, monkeypatch):
    rng = random.Random(12)
    vectors = {i: {g: rng.random() + 0.1 for g in rng.sample("abcdefghijkl", rng.randrange(1, 6))} for i in range(60)}
    df = {g: sum(g in v for v in vectors.values()) for g in "abcdefghijkl"}
    rows, unit = [], {}
    for i, v in vectors.items():
        length = sum(x * x for x in v.values()) ** 0.5
        unit[i] = {g: x / length for g, x in v.items()}
        rows += [(i, g, df[g], x) for g, x in unit[i].items()]
    table = spark.createDataFrame(rows, "id long, gram string, df long, weight double")
    found = {(r.a, r.b): r.cosine for r in spelling.cosine_join(table, 0.5, 0.3).collect()}
    monkeypatch.setattr(spelling, "PAIRED_AT_ONCE", 3)  # every gram is spread over slots
    assert {(r.a, r.b): r.cosine for r in spelling.cosine_join(table, 0.5, 0.3).collect()} == pytest.approx(found)
    dot = lambda a, b: sum(x * unit[b].get(g, 0) for g, x in unit[a].items())
    expected = {(a, b): dot(a, b) for a in unit for b in unit if a < b and dot(a, b) >= 0.5}
    assert found == pytest.approx(expected)


def test_cosine_join_of_blocks_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    raw = rng.random((70, 30)) * (rng.random((70, 30)) < 0.2)
    raw[:, 0] += 0.05  # one gram that all share
    unit = raw / np.sqrt((raw * raw).sum(1, keepdims=True))
    df = (raw > 0).sum(0)
    rows = [(i, f"g{g}", int(df[g]), float(unit[i, g])) for i in range(70) for g in range(30) if unit[i, g]]
    table = spark.createDataFrame(rows, "id long, gram string, df long, weight double")
    dot = unit @ unit.T
    expected = {(a, b): dot[a, b] for a in range(70) for b in range(a + 1, 70) if dot[a, b] >= 0.3}
    for block_names, cells in ((1_000, 250_000), (1_000, 100), (25, 100)):
        monkeypatch.setattr(spelling, "BLOCK_NAMES", block_names)
        monkeypatch.setattr(spelling, "CELLS", cells)
        assert {(r.a, r.b): r.cosine for r in spelling.cosine_join(table).collect()} == pytest.approx(expected)
    assert spelling.cosine_join(table.limit(0)).count() == 0


def test_cosine_join_shuffles_no_pairs_below_the_bound(spark):
    names = 900  # all share a gram, so 404,550 pairs meet; two and two are alike
    rows = [x for i in range(names) for x in ((i, f"own{i // 2}", 2, 0.97), (i, "all", names, (1 - 0.97**2) ** 0.5))]
    table = spark.createDataFrame(rows, "id long, gram string, df long, weight double")
    settle = lambda: spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    written = lambda: sum(x.totalShuffleWrite() for x in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().executorList(False)))
    settle()
    before = written()
    assert spelling.cosine_join(table).count() == names // 2
    settle()
    assert written() - before < 300_000  # bytes


def test_components_reach_along_paths_of_any_length(spark):
    ids = random.Random(3).sample(range(1000), 60)
    chain = [(min(x), max(x)) for x in zip(ids[:40], ids[1:40])]
    star = [(min(ids[40], i), max(ids[40], i)) for i in ids[41:]]
    found = {r.id: r.component for r in spelling.components(spark.createDataFrame([*chain, *star, chain[0]], "a long, b long")).collect()}
    assert found == {i: min(ids[:40]) for i in ids[:40]} | {i: min(ids[40:]) for i in ids[40:]}
    assert spelling.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pairs_of_a_spread_group_are_whole(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PAIRED_AT_ONCE", 4)
    groups = spark.createDataFrame([(i % 2, f"v{i:02}") for i in range(31)], "cluster long, value string")
    found = sorted((r.a, r.b) for r in spelling.linked_pairs(groups).collect())
    assert found == sorted((f"v{i:02}", f"v{j:02}") for i in range(31) for j in range(i + 2, 31, 2))


@pytest.mark.parametrize("component_names", [200, 5])
def test_average_linkage_equals_one_merge_at_a_time(spark, component_names):
    rng = random.Random(14)
    mass = {i: rng.randrange(1, 9) for i in range(25)}
    sims = {(a, b): round(rng.uniform(0.3, 1), 6) for a in mass for b in mass if a < b and rng.random() < 0.3}
    nodes = spark.createDataFrame(list(mass.items()), "id long, mass long")
    pairs = spark.createDataFrame([(a, b, s) for (a, b), s in sims.items()], "a long, b long, s double")
    found = {}
    for r in spelling.average_linkage(nodes, pairs, 0.6, component_names).collect():
        found.setdefault(r.cluster, set()).add(r.id)
    groups = [{i} for i in mass]
    while True:
        weigh = lambda g: sum(mass[i] for i in g)
        average = lambda g, h: sum(sims.get((min(a, b), max(a, b)), 0) * mass[a] * mass[b] for a in g for b in h) / weigh(g) / weigh(h)
        best = max(((average(g, h), i, j) for i, g in enumerate(groups) for j, h in enumerate(groups) if i < j), default=(0, 0, 0))
        if best[0] < 0.6:
            break
        groups[best[1]] |= groups.pop(best[2])
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, groups))
