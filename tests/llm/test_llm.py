"""The llm operators against plain Python, on small tables with nulls, empties, ties, repeats and clashing columns."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
pytest.importorskip("docloom.llm")

from tokenizers import Tokenizer  # noqa: E402

from docloom.llm import bpe, chat, decontam, html, langid, linededup, packing, quality, sigtree, tokenfiles, toxicity  # noqa: E402
from docloom.llm.shared import checkpoint_dir, components, settle  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [(900, None), (901, ""), (902, " \n\t "), (903, "one"), (904, "One"), (905, "a b"), (906, "x " * 30000), (907, "é×ß　１9७😀 don't  \n\n end\r\n"), (908, "stop <|endoftext|> here <|endoftext|>")]


def table(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    vocabulary = [f"w{k}" for k in range(300)]
    base = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([3, 9, 20, 60, 200]))) for _ in range(30)]
    out = []
    for i in range(200):
        w = rnd.choice(base).split()
        for _ in range(rnd.choice([0, 0, 1, 2, 5, 20])):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        out.append((i * 3, " ".join(w)))
    return out + ODD


# quality


def quality_model(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, rows):
    more = [*rows, (950, "a#b\na#b\n\n \na#b <x>|"), (951, "p q r p q r p")]
    df = table(spark, [(i, t, "en", i) for i, t in more], "doc_id long, text string, lang string, n_words long")
    got = {r.doc_id: r for r in quality.assess(df).collect()}
    for i, t in more:
        assert tuple(got[i][c] for c in quality.ADDED[:5]) == quality_model(t)
        w = quality_model(t)
        assert got[i].base_failed == (w[0] < 50 or 100 * w[4] > 50 * w[0])


def test_quality_rejects_shouting(spark):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    good = [(i, " ".join(rnd.choice(["the", "of", word(), word()]) for _ in range(300)), "en") for i in range(30)]
    bad = [(100, good[0][1].upper().replace(" ", "!! "), "en"), (101, None, None), (102, good[1][1], None)]
    got = {r.doc_id: r.kept for r in quality.assess(table(spark, good + bad, "doc_id long, text string, lang string")).collect()}
    assert all(got[i] for i, _, _ in good) and not got[100] and not got[101] and got[102]


def test_quality_rejects_menus_of_any_length(spark):
    """Words of menus: in long texts a smaller distance is too much than in short ones, and texts of 50 to 99 words are compared too."""
    rnd = random.Random(2)
    common = quality.COMMON_WORDS["en"].split()[:15]
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(4))
    prose = lambda n: " ".join(rnd.choice(common) if rnd.random() < 0.4 else word() for _ in range(n))
    menu = lambda n: " ".join(rnd.choice(common) if rnd.random() < 0.12 else word() for _ in range(n))
    good = [(i, prose(n), "en") for i, n in enumerate([60, 90, 150, 400, 900] * 12)]
    bad = [(100 + i, menu(n), "en") for i, n in enumerate([500, 900, 2000])] + [(110, " ".join(word() for _ in range(80)), "en")]
    got = {r.doc_id: r.kept for r in quality.assess(table(spark, good + bad, "doc_id long, text string, lang string")).collect()}
    assert all(got[i] for i, _, _ in good) and not any(got[i] for i, _, _ in bad)


def test_quality_without_language(spark):
    """Rows of null language are held against the closest words, those of a language without a list against its own."""
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(4))
    text = lambda common: " ".join(rnd.choice(common) if rnd.random() < 0.4 else word() for _ in range(300))
    lists = {k: quality.COMMON_WORDS[k].split()[:15] for k in ("en", "de")} | {"xx": ["oki", "uda", "a"]}
    good = [(i, text(lists[k]), k) for i, k in enumerate(["en", "de", "xx"] * 15)]
    good += [(200 + i, text(lists[k]), None) for i, k in enumerate(["en", "de"])]
    bad = [(i, " ".join(word() for _ in range(300)), None) for i in (300, 301)] + [(302, text(lists["en"]), "xx")]
    got = {r.doc_id: r for r in quality.assess(table(spark, good + bad, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].kept for i, _, k in good if k) and got[200].kept and got[201].kept
    assert got[302].word_distance > 0 and all(got[i].word_distance > got[200].word_distance for i in (300, 301))


CLASS_OF = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "\t\x0b\x0c ", "\n\r", ".,;:!?-", "'\"()[]"]


def class_of(c):
    """Latin letters of U+00C0 to U+00FF count with the small or the capital ones, other characters outside ASCII as another script's."""
    for k, chars in enumerate(CLASS_OF):
        if c in chars:
            return k
    if "\u00c0" <= c <= "\u00ff":
        return 0 if c >= "\u00df" else 1
    return 7 if c < "\x80" else 8


def js_model(p, q):
    if not sum(p) or not sum(q):
        return 0.0
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x > 0)
    return math.sqrt(max(0, kl(p) / 2 + kl(q) / 2))


def test_quality_distances_against_a_model(spark, rows):
    """Both distances, and the verdict, from the definitions: counts over all documents of a language, and the closest language without one."""
    rnd = random.Random(13)
    texts = [t for _, t in rows if t and len(t.split()) < 3000]
    lists = {"en": "the of and to", "de": "der die und in", "xx": "zz yy"}
    prose = lambda k: " ".join(rnd.choice(lists[k].split() + ["Wort", "été", "x9,", "(So)", "ж"]) + rnd.choice(["", ".", "!"]) for _ in range(rnd.choice([10, 60, 200, 400])))
    docs = [(i, prose(k) + rnd.choice(["", "\n" + rnd.choice(texts)]), k) for i, k in enumerate(["en", "de", "xx"] * 25)]
    docs += [(100 + i, t, rnd.choice([None, "fr", "en"])) for i, t in enumerate(texts[:40])] + [(200, None, "en"), (201, "", None), (202, "7 # 8", "de")]
    common = {k: v for k, v in lists.items() if k != "xx"}
    every = sorted({w for v in common.values() for w in v.split()})
    bare = lambda w: re.sub("[A-Z]", lambda m: m[0].lower(), w)
    words = lambda t: [w[:-1] if len(w) > 1 and w[-1] in ".,;:!?" else w for w in map(bare, re.findall(r"[^\x20\x09-\x0D]+", t or ""))]

    def made(t):
        classes, counts = [0] * 9, collections.Counter(words(t))
        for c in t or "":
            classes[class_of(c)] += 1
        return len(words(t)), classes, [counts[w] for w in every]

    total = {}
    for _, t, k in docs:
        if k:
            n, c, w = made(t)
            a = total.setdefault(k, [0, [0] * 9, [0] * len(every)])
            total[k] = [a[0] + n, [x + y for x, y in zip(a[1], c)], [x + y for x, y in zip(a[2], w)]]
    refs = {k: v for k, v in total.items() if v[0] >= 1000}
    assert set(refs) == {"en", "de", "xx"}

    def apart(n, w, k):
        mine = [j for j, x in enumerate(every) if k not in common or x in common[k].split()]
        pick = lambda size, v: [v[j] for j in mine] + [size - sum(v[j] for j in mine)]
        return js_model(pick(n, w), pick(refs[k][0], refs[k][2]))

    got = {r.doc_id: r for r in quality.assess(table(spark, docs, "doc_id long, text string, lang string"), common).collect()}
    for i, t, k in docs:
        n, c, w = made(t)
        cd = js_model(c, refs[k][1]) if k in refs else min(js_model(c, v[1]) for v in refs.values())
        wd = apart(n, w, k) if k in refs else min(apart(n, w, x) for x in refs)
        cd, wd = cd if sum(c) >= 200 else 0.0, wd if n >= 50 else 0.0
        assert got[i].class_distance == pytest.approx(cd, abs=1e-6) and got[i].word_distance == pytest.approx(wd, abs=1e-6), (i, t)
        q = quality_model(t)
        failed = q[0] < 50 or 100 * q[4] > 50 * q[0]
        assert got[i].kept == (not failed and cd <= 0.3 and wd <= 0.1 + 2 / math.sqrt(max(n, 1)))


def test_quality_of_nothing(spark):
    assert quality.assess(table(spark, [], "doc_id long, text string, lang string")).count() == 0


# lines


def test_lines(spark):
    rows = [(i, f"own {i}\n shared line \nfew" if i < 4 else f"own {i}\nshared line", f"s{i}") for i in range(12)]
    rows += [(20, None, "s1"), (21, "", None), (22, "shared line\nshared line", "s0")]
    got = {r.doc_id: r for r in linededup.remove_widespread(table(spark, rows, "doc_id long, text string, source string"), 10).collect()}
    assert got[0].text == "own 0\n shared line \nfew" and got[0].n_removed == 0
    assert got[1].text == "own 1\nfew" and got[5].text == "own 5"
    assert got[22].text == "" and got[22].n_removed == 2
    assert got[20].text is None and got[20].n_lines == 0 and got[21].text == ""


@pytest.mark.parametrize("sites", [8, 9, 10, 11, 40])
def test_line_threshold_is_exact(spark, sites):
    rows = [(i, "the same", f"s{i}") for i in range(sites)]
    df = table(spark, rows, "doc_id long, text string, source string")
    assert linededup.widespread(df, 10).count() == (sites >= 10)


def lines_model(rows, sites):
    """(n_lines, n_removed, text) of each row; rows of one id and text are one document, and no id has two texts here."""
    bare = lambda x: x.strip(" \t\r")
    docs = {(i is None, i or 0, t): set() for i, t, _ in rows if t is not None}
    on, places = collections.defaultdict(set), collections.defaultdict(set)
    for i, t, site in rows:
        for k, line in enumerate((t or "").split("\n") if t is not None else []):
            if bare(line):
                on[bare(line)].add(site or "")
                places[bare(line)].add((i is None, i or 0, t, k))
    order = lambda p: (p[0], p[1], p[2], p[3])
    for line, where in places.items():
        if len(on[line]) >= sites:
            for *doc, k in sorted(where, key=order)[1:]:
                docs[tuple(doc)].add(k)
    return [(0, 0, None) if t is None else (len(t.split("\n")), len(g := docs[i is None, i or 0, t]), "\n".join(x for k, x in enumerate(t.split("\n")) if k not in g)) for i, t, _ in rows]


def test_lines_against_a_model(spark):
    rnd = random.Random(4)
    some = [f"line {k}" for k in range(12)] + ["", "  ", "\tline 1 \r", "é"]
    rows = [(i, "\n".join(rnd.choice(some) for _ in range(rnd.randrange(7))), rnd.choice([None, *(f"s{k}" for k in range(9))])) for i in range(120)]
    rows += rows[:6] + [(None, "line 3\nline 4\nown", "s1"), (500, None, "s1"), (501, "", None), (502, "\n".join(f"line {k % 12}" if k % 3 else f"own {k}" for k in range(20_000)), "s2")]
    df = table(spark, [(*r, 7) for r in rows], "doc_id long, text string, source string, n_lines int")
    key = lambda r: tuple(map(str, r))
    for sites in (3, 7, 9):
        got = [(r.doc_id, r.n_lines, r.n_removed, r.text) for r in linededup.remove_widespread(df, sites).collect()]
        assert sorted(got, key=key) == sorted(((i, *x) for (i, _, _), x in zip(rows, lines_model(rows, sites))), key=key)
    assert linededup.remove_widespread(table(spark, [], "doc_id long, text string, source string")).count() == 0


# decontamination


def bm25_model(texts, items, threshold):
    """(doc, item): score of the best window, from the definition: every pair, no index."""
    split = lambda t: re.sub(r"[^0-9a-z\x80-\U0010ffff]", " ", (t or "").lower()).split(" ")
    words = lambda t: [w for w in split(t) if w]
    known = [(i, words(q) + words(a)) for i, q, a in items]
    known = [(i, w) for i, w in known if len(w) >= 4]
    n, mean = len(known), sum(len(w) for _, w in known) / max(len(known), 1)
    df = collections.Counter(t for _, w in known for t in set(w))
    out = {}
    for i, w in known:
        tf = collections.Counter(w)
        part = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t, c in tf.items()}
        step = 8
        while step < len(w):
            step *= 2
        for d, text in texts.items():
            t = words(text)
            for k in range(0, max(len(t), 1), step):
                score = sum(part[x] for x in set(t[k : k + 2 * step]) if x in part) / sum(part.values())
                if score >= threshold - 1e-9:
                    out[d, i] = max(score, out.get((d, i), 0))
    return out


def test_wand_finds_what_scoring_all_finds(spark, rows):
    items = [(i, *decontam.halves(t or "")) for i, t in rows[:40]]
    texts = dict(rows[30:120] + ODD)
    for threshold in (0.15, 0.3, 0.5):
        got = {(r.doc_id, r.item_id): r.score for r in decontam.matches(table(spark, list(texts.items())), items, threshold, 0, 0).collect()}
        want = bm25_model(texts, items, threshold)
        assert set(got) == set(want)
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_leaks(spark):
    item = "Who wrote the long book about the white whale at sea. Herman Melville did."
    docs = table(spark, [(1, f"before {item.upper()} after"), (2, "Who wrote the long book about the white whale at sea."), (3, None), (4, "")])
    got = decontam.find_leaks(docs, table(spark, [(7, item), (8, None), (9, "")], "item_id long, text string"))
    assert [(r.doc_id, r.item_id) for r in got.collect()] == [(1, 7)]
    assert decontam.find_leaks(docs, table(spark, [], "item_id long, text string")).count() == 0


def test_leaks_of_short_items(spark):
    docs = table(spark, [(1, "so Blue whale, it says; blue whale"), (2, "whale blue"), (3, "blue. WHALE"), (None, "blue whale"), (4, None)])
    got = decontam.find_leaks(docs, table(spark, [(7, "Blue whale."), (8, "42"), (9, None), (10, "?")], "item_id long, text string"))
    assert {(r.doc_id, r.item_id, r.word, r.kind, r.score, r.question, r.answer) for r in got.collect()} == {(i, 7, w, "run", None, None, None) for i, w in ((1, 1), (3, 0), (None, 0))}


def test_leaks_do_not_hang_on_shards(spark, rows, monkeypatch):
    items = table(spark, [(i, t) for i, t in rows[:40]], "item_id long, text string")
    docs = table(spark, rows[30:120] + ODD)
    find = lambda: sorted((r.doc_id or -1, r.item_id, r.kind, round(r.score or 0, 6)) for r in decontam.find_leaks(docs, items, 0.3, 0, 0).collect())
    whole = find()
    monkeypatch.setattr(decontam, "MAX_INDEX_WORDS", 400)
    assert find() == whole and whole


def test_leaks_of_long_items(spark):
    """An item has one verdict however long it is, a row a document, and doesn't widen the windows of shorter ones."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    items, docs = [], []
    for k, size in enumerate((2047, 2049, 2300)):
        whole = [word() for _ in range(size)]
        items.append((k, " ".join(whole[: size * 2 // 3]), " ".join(whole[size * 2 // 3 :])))
        held = {0: whole, 1: whole[: size // 3], 2: whole[size * 2 // 3 :], 3: whole[size // 4 :], 4: [w for n, w in enumerate(whole) if n % 3]}
        docs += [(10 * k + n, " ".join([word() for _ in range(50)] + w + [word() for _ in range(50)])) for n, w in held.items()]
    items.append((9, " ".join(word() for _ in range(10)), " ".join(word() for _ in range(5))))
    apart = items[3][1].split() + [word() for _ in range(60)] + items[3][2].split()
    docs += [(100, items[3][1] + " " + items[3][2]), (101, " ".join(apart)), (102, items[3][1] + " " + items[3][2]), (102, items[3][1] + " " + items[3][2])]
    got = decontam.find_leaks(table(spark, [(*d, 5) for d in docs], "doc_id long, text string, score int"), table(spark, items, "item_id long, question string, answer string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == sorted([(10 * k + n, k) for k in range(3) for n in (0, 3)] + [(100, 9), (102, 9), (102, 9)])


# signature trees


def jaccard_model(rows, n, percent):
    sets, up = {}, {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
        up[i] = i

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = list(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("n, percent, cell", [(3, 90, 400_000), (5, 80, 600)])
def test_jaccard(spark, rows, n, percent, cell):
    rows = [(i, t if len(t or "") < 1000 else t[:400]) for i, t in rows]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in sigtree.jaccard_components(table(spark, rows), n, percent, cell).collect()}
    assert got == jaccard_model(rows, n, percent)


@pytest.mark.parametrize("cell", [150, 900])
def test_jaccard_across_size_classes(spark, cell):
    rnd = random.Random(7)
    # chains that grow over many size classes, and texts that share only a passage with them
    base = [[f"{c}w{k}" for k in range(400)] for c in "abc"]
    rows = [(1000 * c + k, " ".join(base[c][: 20 + 4 * k])) for c in range(3) for k in range(40)]
    rows += [(5000 + k, " ".join(base[k % 3][:30] + [f"x{rnd.randrange(300)}" for _ in range(60)])) for k in range(60)]
    rows += [(6000 + k, rows[k * 2][1] + " tail") for k in range(50)] + [(7000 + k, rows[60][1]) for k in range(40)]
    rnd.shuffle(rows)
    for n, percent in ((3, 90), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in sigtree.jaccard_components(table(spark, rows), n, percent, cell).collect()}
        assert got == jaccard_model(rows, n, percent)


def test_jaccard_of_nothing(spark):
    assert sigtree.jaccard_components(table(spark, [])).count() == 0
    got = sigtree.jaccard_components(table(spark, [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (1, 1), (1, 1)]


def test_cells_part_at_shingles_that_few_have(spark):
    """Pipeline's disk: long texts that share a passage with a neighbour alone, through a chain of them, are no cell; near-copies stay one."""
    rnd = random.Random(3)
    word = lambda: f"w{rnd.randrange(10**9)}"
    passages = [[word() for _ in range(60)] for _ in range(61)]
    rows = [(k, " ".join([*passages[k], *(word() for _ in range(300)), *passages[k + 1]])) for k in range(60)]
    rows += [(100 + k, rows[7][1] + f" tail{k}") for k in range(3)] + [(200, "a b"), (201, ""), (202, " ".join(passages[0]))]
    for n, percent in ((3, 90), (5, 80)):
        members = table(spark, [(*r, 0) for r in rows], "id long, text string, cell long").repartition(3)
        got = {r.id: r.cell for r in sigtree.split_cells(members, n, percent, 4).collect()}
        assert got == dict.fromkeys((7, 100, 101, 102), 7)


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80)])
def test_cells_keep_links(spark, n, percent):
    """Whatever links stays in one cell: near-copies at the threshold, words that all have, rows of one id, a cell apart."""
    rnd = random.Random(n)
    rows = []
    for k in range(40):
        said = [f"w{rnd.randrange(60)}" for _ in range(rnd.randrange(1, 120))]
        for j in range(4):
            for _ in range(rnd.randrange(1 + len(said) // 20)):
                said[rnd.randrange(len(said))] = f"w{rnd.randrange(60)}"
            rows.append((4 * k + j, " ".join(said)))
    model = jaccard_model(rows, n, percent)
    assert len({c for _, c in model.values()}) < len(rows) - 20
    rows += [(3, " ".join(f"x{k}" for k in range(50)))]
    got = {r.id: r.cell for r in sigtree.split_cells(table(spark, [(*r, 5) for r in rows], "id long, text string, cell long").repartition(3), n, percent, 3).collect()}
    assert all(i in got and got[i] == got[c] for i, (_, c) in model.items() if i != c)
    far = sigtree.split_cells(table(spark, [(1, "a b c d e f", 1), (2, "a b c d e f", 2)], "id long, text string, cell long"), n, percent, 2)
    assert far.count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 200)] + [(500, 499), (499, 498), (7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(201)} == {0} and {got[k] for k in (498, 499, 500)} == {498}


# tokens


def test_ids_are_the_library_s(spark):
    rnd = random.Random(2)
    some = list("ab'.,!? \n\n  \t\r s't é×ß१9\u00a0\u3000\x1c\u0085–”😀ı") + ["don't ", "\r\n", "<|endoftext|>", " 12,345.6"]
    texts = ["".join(rnd.choice(some) for _ in range(rnd.randrange(50))) for _ in range(3000)] + [t or "" for _, t in ODD]
    for plain in (False, True):
        library = Tokenizer.from_file(PATH)
        if plain:
            library.encode_special_tokens = True
        ids, at = bpe.Encoder(PATH, plain).ids(pa.array(texts))
        want = library.encode_batch(texts, add_special_tokens=False)
        assert all(ids[a:b].tolist() == e.ids for a, b, e in zip(at[:-1], at[1:], want, strict=True))


LIBRARY = Tokenizer.from_file(PATH)


def reference_ids(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


@pytest.mark.parametrize("encoding", ["delta", "dictionary"])
def test_token_files(spark, rows, encoding):
    path = f"{checkpoint_dir(spark)}/files-{encoding}"
    tokenfiles.write(table(spark, rows), path, PATH, encoding=encoding)
    got = {r.doc_id: r for r in tokenfiles.digests(tokenfiles.read(spark, path)).join(tokenfiles.positions(spark, path), ["part", "row"]).collect()}
    start = 0
    for i, t in sorted(rows):
        ids = reference_ids(t)
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
    assert tokenfiles.read(spark, path, 900, 901).count() == 2
    empty = f"{path}-none"
    tokenfiles.write(table(spark, []), empty, PATH, encoding=encoding)
    assert tokenfiles.read(spark, empty).count() == 0
    # repeated rows, a null id and a column of the file's names
    odd = f"{path}-odd"
    tokenfiles.write(table(spark, [(3, "a b", 1), (3, "a b", 1), (None, "c", 1), (2, None, 1)], "doc_id long, text string, n_tokens int"), odd, PATH, encoding=encoding)
    back = tokenfiles.digests(tokenfiles.read(spark, odd)).join(tokenfiles.positions(spark, odd), ["part", "row"]).collect()
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in back) == sorted((i, len(reference_ids(t)), crc(reference_ids(t))) for i, t in ((3, "a b"), (3, "a b"), (-1, "c"), (2, "")))
    ends = sorted((r.start, r.start + r.n_tokens) for r in back)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))


def test_packing(spark, rows):
    pieces = settle(packing.cut_pieces(table(spark, rows), PATH, capacity=64))
    got = packing.place(pieces, capacity=64, shard_pieces=100).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, t in rows:
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        whole = [x for r in parts for x in r.ids]
        assert whole == reference_ids(t)
        assert all(r.length == 64 for r in parts[1:]) and all(r.ids_crc32 == crc(r.ids) for r in parts)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert len(by_sequence) <= 1.02 * sum(r.length for r in got) / 64 + 4
    # a hot group of one row, null ids and columns of the result's names: a place for each row all the same
    same = [(1, "two words")] * 900 + [(None, "x")] * 50 + [(2, "long " * 3000)] * 3
    pieces = settle(packing.cut_pieces(table(spark, same), PATH, keep_ids=False)).withColumn("offset", packing.F.lit("o")).withColumn("row", packing.F.lit(1))
    again = packing.place(pieces, shard_pieces=200).collect()
    spans = collections.defaultdict(list)
    for r in again:
        spans[r.sequence_id].append((r.offset, r.length))
    assert len(again) == 950 + 3 * 3 and all(r.row == 1 for r in again)
    for x in spans.values():
        x.sort()
        assert x[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(x, x[1:])) and sum(x[-1]) <= 1024
    assert packing.place(settle(packing.cut_pieces(table(spark, []), PATH))).count() == 0


def test_genes():
    rnd = random.Random(3)
    size = [rnd.randrange(1, 1024) for _ in range(600)]
    one, two = (packing.descending(size, 1024, random.Random(s), 0.2) for s in (1, 2))
    for bins in (one, packing.crossover(one, two, size, 1024, rnd), packing.mutate(one, size, 1024, rnd)):
        assert sorted(i for b in bins for i in b) == list(range(600))
        assert all(sum(size[i] for i in b) <= 1024 for b in bins)


# HTML

PAGE = """<!DOCTYPE html><title>no</title><style>p{}</style><body>Top<p>One <b>two</b>
three<p hidden>gone<p>Fo&amp;ur<br>five<ul><li>a<li>b<ol><li>x<li>y</ol></ul>
<table><tr><th>Name<th>N<tr><td>long name<td>1<tr><td colspan=2>both</table>
<pre>  keep
   this</pre><script>if (a</p>) x()</script><div style="display:none">no<p>no</div><div style="visibility: hidden">no<span style="visibility:visible">yes</span></div>
<details><summary>sum</summary>shut</details>end"""


def test_html():
    want = "Top\n\nOne two three\n\nFo&ur\nfive\n\n- a\n- b\n  1. x\n  2. y\n\nName       N\nlong name  1\nboth\n\n  keep\n   this\n\nyes\nsum\nend"
    assert html.visible_text(PAGE) == want


@pytest.mark.parametrize("page, want", [("", ""), ("a < b & c", "a < b & c"), ("<p>x</p></p>y", "x\n\ny"), ("<div>" * 5000 + "deep", "deep"), ("<td>stray", "stray"), ("</table></ul>x", "x"), ("<!-- x", ""), ("<script>x", "")])
def test_html_odd(page, want):
    assert html.visible_text(page) == want


@pytest.mark.parametrize(
    "page, want",
    [
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds", "so x=2 holds"),
        ("a<svg viewBox='0 0 9 9'><title>t</title>stray<path d='M0'/><defs><text>no</text></defs><text>North</text><g><text>So<tspan>uth</tspan></text></g></svg>b", "a\nNorth\nSouth\nb"),
        ("<svg/>after", "after"),
        ("<table><tr><td rowspan=2>a<td>b<td>c<tr><td>d<td>e<tr><td>f<td>g<td>h</table>", "a  b  c\n   d  e\nf  g  h"),
        ("<table><tr><td>k<td rowspan=0>x<td>1<tr><td>l<td>2<tbody><tr><td>m<td>y<td>3</table>", "k  x  1\nl     2\nm  y  3"),
        ("<table><tr><td rowspan=2>a<td>b<tr></tr><tr><td>c<td>d</table>", "a  b\nc  d"),
        ("<table><tr><td><p>one</p><p>two</p><pre>x\n\ny</pre></table>", "one\n\ntwo\n\nx\n\ny"),
        ("a<!-->b<!--->c<!-- x --!>d<!-- > -->e<!doctype x>f", "abcdef"),
        ("<dialog>no</dialog><dialog open>yes</dialog><ruby>字<rp>(</rp><rt>zi<rp>)</rp></ruby>", "yes\n字zi"),
        ("<ol><li value=5>a<li>b<li value=x>c</ol>", "5. a\n6. b\n7. c"),
        ("<ol reversed><li>a<li>b<ol><li>x</ol><!-- <li> --><li>c</ol><ol reversed start=9><li>d<li>e</ol>", "3. a\n2. b\n   1. x\n1. c\n\n9. d\n8. e"),
        ("<ol type=a start=26><li>z<li>aa<li type=I value=14>n</ol><ol type=A><li>x</ol><ol type=i start=0><li>x<li>y</ol>", "z. z\naa. aa\nXIV. n\n\nA. x\n\n0. x\ni. y"),
        ("<p style='display:none;display:block'>a<p style='display:block; display: none'>b<p style='display:none !important;display:block'>c<p style='display:none;display:nonsense'>d<p style='--display:none'>e", "a\n\ne"),
        ("<p hidden style='display:block'>a<p hidden>b<p style='visibility:hidden;visibility:visible'>c", "a\n\nc"),
        ("<table><tfoot><tr><td>sum<td>3<tbody><tr><td>a<td>1<thead><tr><th>k<th>n<tbody><tr><td>b<td>2<tfoot><tr><td>z<td>0</table>", "k    n\na    1\nb    2\nz    0\nsum  3"),
        ("<table><tr><td>日本<td>x<tr><td>abc<td>y<tr><td>é<td>z</table>", "日本  x\nabc   y\né     z"),
    ],
)
def test_html_whole(page, want):
    assert html.visible_text(page) == want


@pytest.mark.parametrize(
    "page",
    [
        "<" + "a" * 100_000, "<div>" * 20_000, '<a "x ' * 16_000, '<a x="y ' * 12_000, "<p><table><td>" + "<div>" * 18_000, "<table><td>x" * 8_000, "<blockquote>x" * 7_000, "<ul><li>x" * 10_000,
        "<table><tr>" + "<td colspan=1000>x" * 5_000, "<script>a>b" + "</script " * 10_000, "<!--" * 25_000, "<" * 100_000, "<table>" + "<td>x" * 20_000, "<table><tr>" + "<td rowspan=9>x" * 2_000 + "<tr><td>y" * 6_000,
        "<ol reversed>" * 8_000, "<ol reversed><!--" * 6_000, "<ol reversed><li" * 6_000, "<ol reversed><li>x" * 5_000,
    ],
    ids=range(18),
)
def test_html_hostile(page):
    """A page of 100 KB takes well under a second, whatever stands in it."""
    began = time.perf_counter()
    html.visible_text(page)
    assert time.perf_counter() - began < 2


def html_model(page):
    """Of pages of these few tags: blocks on lines of their own, paragraphs set off."""
    lines, now, gap, hidden = [], "", False, 0

    def flush():
        nonlocal now, gap
        if now.strip():
            if gap and lines:
                lines.append("")
            lines.append(" ".join(now.split()))
            gap = False
        now = ""

    for mark in re.findall(r"<[^>]*>|[^<]+", page):
        if mark in ("<script>", "</script>"):
            hidden += 1 if mark[1] != "/" else -1
        elif mark[0] != "<":
            now += "" if hidden else mark
        elif mark.strip("</>") in ("div", "p"):
            flush()
            gap = gap or mark.strip("</>") == "p"
    flush()
    return "\n".join(lines)


def test_html_against_a_model():
    rnd = random.Random(11)

    def piece(depth):
        kind = rnd.choice(["text", "b", "div", "div", "p", "script"] if depth else ["text", "b", "p"])
        if kind == "text":
            return rnd.choice(["one ", " two", "three\n", " "])
        if kind == "script":
            return "<script>var x</script>"
        inner = "".join(piece(depth - 1 if kind == "div" else 0) for _ in range(rnd.randrange(4))) if kind != "b" and depth else rnd.choice("xyz")
        return f"<{kind}>{inner if kind == 'div' else rnd.choice('xyz') + ' w '}</{kind}>"

    for _ in range(400):
        page = "".join(piece(4) for _ in range(5))
        assert html.visible_text(page) == html_model(page), page


def test_html_rows(spark):
    got = html.extract(table(spark, [(1, None, "old"), (2, "<p>x", "old")], "page_id long, html string, text string")).collect()
    assert [(r.page_id, r.text) for r in got] == [(1, ""), (2, "x")]
    assert html.extract(table(spark, [], "page_id long, html string")).count() == 0
    again = html.extract(table(spark, [(1, "<p>x"), (1, "<p>x"), (None, "<br>y " * 50_000)], "page_id long, html string")).collect()
    assert sorted(len(r.text) for r in again) == [1, 1, 100_000]


# language and toxicity


def test_language(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog are in the house", "en"), ("der Hund und die Katze sind in dem Haus", "de")] * 20)]
    profiles = langid.learn(table(spark, [*rows, (99, "zzz", None)], "doc_id long, text string, lang string"))
    assert sorted(profiles) == ["de", "en"]
    asked = [(1, "the house and the cat"), (2, "die Katze und der Hund"), (3, None), (4, "12 34 !"), (5, "")]
    got = {r.doc_id: r for r in langid.identify(table(spark, asked), profiles).collect()}
    assert [got[i].lang_pred for i in range(1, 6)] == ["en", "de", "und", "und", "und"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.learn(table(spark, [], "text string, lang string")) == {}


def language_model(learned, asked, size):
    """(lang_pred, score) by out-of-place distance of the most frequent n-grams, from the definition."""

    def ranked(texts):
        n = collections.Counter()
        for t in texts:
            s = " " + re.sub(r" +", " ", "".join(c if c.isalpha() else " " for c in (t or "").lower())) + " "
            s = re.sub(r" +", " ", s)
            if s.strip():
                n.update(s[k : k + m] for m in (1, 2, 3) for k in range(len(s) - m + 1) if s[k : k + m] != " ")
        value = lambda g: sum(ord(c) << (21 * k) for k, c in enumerate(g))
        return n, value

    profiles = {}
    for lang in sorted({x for _, x in learned if x}):
        n, value = ranked([t for t, x in learned if x == lang])
        signed = lambda g: value(g) - (1 << 64 if value(g) >> 63 else 0)
        profiles[lang] = {g: k for k, g in enumerate(sorted(n, key=lambda g: (-n[g], signed(g)))[:size])}
    out = []
    for t in asked:
        if not t or not any(c.isalpha() for c in t):
            out.append(("und", 0.0))
            continue
        n, value = ranked([t])
        own = sorted(n, key=lambda g: (-n[g], value(g)))[:size]
        d = {k: sum(abs(p[g] - r) if g in p else size for r, g in enumerate(own)) / len(own) / size for k, p in profiles.items()}
        best, nxt = sorted(d.values())[:2] if len(d) > 1 else (*d.values(), 1.0)
        out.append((min(d, key=lambda k: (d[k], k)), min(max(1 - best / nxt, 0), 1) if nxt > 0 else 0.0))
    return out


def test_language_against_a_model(spark):
    rnd = random.Random(10)
    said = {"en": "the house of the cat and a dog that was on it", "de": "das Haus der Katze und ein Hund, die für über es war", "ru": "дом кошки и собака, что была на нём", "el": "το σπίτι της γάτας και ένας σκύλος"}
    doc = lambda k: " ".join(rnd.choice(said[k].split()) for _ in range(rnd.choice([1, 5, 40, 300]))) + rnd.choice(["", " 12!", "\n\n"])
    learned = [(doc(k), k) for k in said for _ in range(12)]
    learned += learned[:5] + [(None, "en"), ("", "de"), ("zzz", None)]
    asked = [doc(k) for k in said for _ in range(10)] + ["x", "ß ẞ İ", None, "", "12 34", "the дом das", "a" * 100_000]
    asked += asked[:3]
    profiles = langid.learn(table(spark, [(t, x, 1) for t, x in learned], "text string, lang string, gram int"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(table(spark, [(i, t, "q") for i, t in enumerate(asked)], "doc_id long, text string, lang_pred string"), profiles).collect()}
    want = language_model(learned, asked, langid.PROFILE)
    for i, (lang, score) in enumerate(want):
        assert got[i][0] == lang and got[i][1] == pytest.approx(score, abs=1e-9), (i, asked[i])
    assert langid.identify(table(spark, []), profiles).count() == 0
    assert [tuple(r) for r in langid.identify(table(spark, [(None, "x"), (1, None)]), {}).collect()] == [(None, "und", 0.0), (1, "und", 0.0)]


def test_toxicity(spark):
    rnd = random.Random(4)
    plain = [f"word{k}" for k in range(60)]

    def doc(toxic):
        w = [rnd.choice(plain) for _ in range(40)]
        if toxic:
            for _ in range(4):
                w[rnd.randrange(40)] = rnd.choice(["nasty", "vile", "foul"])
        return " ".join(w)

    rows = [(i, doc(i % 5 == 0), int(i % 5 == 0)) for i in range(600)]
    model = toxicity.train(table(spark, [*rows, (-1, "x", None), (-2, None, 1)], "doc_id long, text string, label int"))
    new = [(i, doc(i % 2), i % 2) for i in range(100)]
    got = {r.doc_id: r.score for r in toxicity.score(table(spark, [(i, t) for i, t, _ in new] + ODD), model).collect()}
    assert sum((got[i] >= 0.5) == bool(y) for i, _, y in new) >= 95
    assert all(0 <= got[i] <= 1 for i, _ in ODD)


def test_toxicity_without_labels(spark):
    model = toxicity.train(table(spark, [], "doc_id long, text string, label int"))
    assert toxicity.score(table(spark, ODD), model).count() == len(ODD)


# chat


def test_chat(spark):
    rnd = random.Random(6)
    said = ["", "hi", "</s>[INST] ok [/INST]", "a\\b \\</s> [/INST]\n", "<<SYS>>\n<</SYS>>", "[ROLE]x[/ROLE]", "é\n\n 😀", "[OUT] x</s>\n"]
    convs = {c: [(rnd.choice(["user", "assistant", "system", "tool", "[ROLE]", ""]) if k else "user", rnd.choice(said) if k else "hi") for k in range(rnd.randrange(1, 7))] for c in range(80)}
    convs[100] = [("user", None), ("assistant", None), (None, "x")]
    rows = [(c, k, r, t, "other") for c, turns in convs.items() for k, (r, t) in enumerate(turns)]
    rnd.shuffle(rows)
    nodes, leaves = chat.prefix_tree(table(spark, rows, "conv_id long, turn long, role string, text string, path string"), PATH)
    got = {r.conv_id: r for r in chat.digests(nodes, leaves, PATH).collect()}
    whole = {r.conv_id: r for r in chat.read_back(nodes, leaves, PATH).collect()}
    for c, turns in convs.items():
        turns = [(r or "", t or "") for r, t in turns]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert [x[:2] for x in chat.parse(whole[c].formatted)] == turns and got[c].formatted_chars == len(whole[c].formatted)
        assert "".join(map(chat.unescape, whole[c].loss)) == loss
    chat_layout(nodes, leaves, {c: [(r or "", t or "") for r, t in turns] for c, turns in convs.items()})


def chat_layout(nodes, leaves, convs):
    """The written nodes are the different beginnings of conversations, once, depth-first, each with the intervals of its ancestors."""
    flat = {r.start: r for r in nodes.collect()}
    tok = bpe.encoder(PATH, True).tok
    at, by_start = 0, {}
    for start in sorted(flat):
        assert start == at
        at += len(flat[start].ids)
    starts = set()
    for r in leaves.collect():
        turns, above, position = convs[r.conv_id], [], 0
        assert len(r.spans) == len(turns)
        for k, (span, (role, text)) in enumerate(zip(r.spans, turns)):
            node = flat[span["from"]]
            assert tok.decode(node.ids) == "".join(chat.parts(role, text)) and span["to"] - span["from"] == len(node.ids) and node.depth == k
            assert by_start.setdefault(span["from"], turns[: k + 1]) == turns[: k + 1]
            assert node.position_ids == list(range(position, position + len(node.ids)))
            assert [x for a in node.ancestors for x in range(a["from"], a["to"])] == above
            above += range(span["from"], span["to"])
            position += len(node.ids)
            starts.add(span["from"])
        assert not k or r.spans[k]["from"] >= r.spans[k - 1]["to"]
    assert starts == set(flat) and len({tuple(t) for t in by_start.values()}) == len(by_start)
    # depth-first: what begins with a node's turns follows it on end
    inside = []
    for start in sorted(by_start):
        while inside and by_start[start][: len(inside[-1])] != inside[-1]:
            inside.pop()
        assert len(inside) == len(by_start[start]) - 1
        inside.append(by_start[start])


@pytest.mark.parametrize("ranges", ["1", "3", "9"])
def test_chat_ranges(spark, ranges):
    """The layout is whole however many ranges the paths are dealt into, and copies of a conversation are one path."""
    rnd = random.Random(8)
    convs = {c: [("user", rnd.choice("ab"))] + [(rnd.choice(["user", "assistant"]), rnd.choice("abc")) for _ in range(rnd.randrange(6))] for c in range(120)}
    convs |= {500 + c: convs[3] for c in range(40)}
    rows = [(c, k, r, t) for c, turns in convs.items() for k, (r, t) in enumerate(turns)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        nodes, leaves = chat.prefix_tree(table(spark, rows, "conv_id long, turn long, role string, text string"), PATH)
        chat_layout(nodes, leaves, convs)
        assert chat.digests(nodes, leaves, PATH).count() == len(convs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_chat_odd(spark):
    """A deep conversation has one interval above each turn; rows without an id are conversations; repeated rows are turns; a long text is whole."""
    deep = [(1, k, "user" if k % 2 else "assistant", f"turn {k}") for k in range(200)]
    odd = [(None, 0, "user", "x"), (None, 0, "user", "x"), (None, 1, "assistant", "<|endoftext|>"), (2, 0, "user", "same"), (2, 0, "user", "same"), (3, None, "assistant", "word " * 50000)]
    nodes, leaves = chat.prefix_tree(table(spark, deep + odd, "conv_id long, turn long, role string, text string"), PATH)
    assert max(len(r.ancestors) for r in nodes.collect()) == 1
    got = [tuple(r) for r in chat.digests(nodes, leaves, PATH).select("conv_id", "n_turns", "loss_chars").collect()]
    assert sorted(got, key=str) == sorted([(1, 200, sum(len(t) for _, k, _, t in deep if k % 2 == 0)), (2, 2, 0), (3, 1, 250000), (None, 1, 0), (None, 1, 0), (None, 1, 13)], key=str)


def test_no_chat(spark):
    nodes, leaves = chat.prefix_tree(table(spark, [], "conv_id long, turn long, role string, text string"), PATH)
    assert chat.digests(nodes, leaves, PATH).count() == 0 and chat.read_back(nodes, leaves, PATH).count() == 0


def test_toxicity_table_is_exact(spark):
    """The joined model: every word and pair with the different words before it, as plain Python counts them, however many there are."""
    rnd = random.Random(9)
    rows = [(i, " ".join(f"longish{rnd.randrange(120)}" for _ in range(120)), i % 2) for i in range(400)]
    three = {(h0, h, w, y) for _, t, y in rows for x in [t.split()] for h0, h, w in zip(["", "", *x], ["", *x], x)}
    after = collections.Counter((w, y) for h, w, y in {(h, w, y) for _, h, w, y in three})
    model = toxicity.train(table(spark, rows, "doc_id long, text string, label int"))
    got = {r.key: r for r in model.counts[0].collect()}
    names = sorted({w for w, _ in after})
    keys = toxicity.ta.signed(toxicity.words(pa.array(names))[0]).tolist()
    assert max(after.values()) > 85  # more than 64 cells can tell
    assert [(got[k].toxic, got[k].plain) for k in keys] == [(after[w, 1], after[w, 0]) for w in names]
    either = collections.Counter(w for h, w in {(h, w) for _, h, w, _ in three})
    assert [got[k].either for k in keys] == [either[w] for w in names]


def test_toxicity_joined_as_sent(spark, rows, monkeypatch):
    monkeypatch.setattr(toxicity, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(toxicity, "BUCKET_BYTES", 9000)
    labelled = [(i, t, i % 2) for i, t in rows]
    df = table(spark, labelled, "doc_id long, text string, label int")
    docs = table(spark, [*rows, (None, "w1 w2"), (None, "w1 w2"), (-5, "never seen before")])
    sent = toxicity.score(docs, toxicity.train(df))
    joined = toxicity.score(docs, toxicity.train(df, shipped_rows=-1), shipped_rows=-1)
    order = lambda d: sorted((-1 if r.doc_id is None else r.doc_id, r.score) for r in d.collect())
    a, b = order(sent), order(joined)
    assert [x[0] for x in a] == [x[0] for x in b] and [x[1] for x in a] == pytest.approx([x[1] for x in b])


def test_toxicity_copies_do_not_add_up(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(f"w{rnd.randrange(30)}" for _ in range(150)), int(i % 3 == 0)) for i in range(90)]
    copies = [*rows, *((1000 + i, rows[1][1], 0) for i in range(500))]
    a, b = (toxicity.train(table(spark, r, "doc_id long, text string, label int")) for r in (rows, copies))
    assert sorted(a.counts[0].collect()) == sorted(b.counts[0].collect()) and (a.counts[1] == b.counts[1]).all()
    assert sorted(a.pairs.collect()) == sorted(b.pairs.collect())


def kneser_ney_model(rows):
    """(ratio of a pair, ratio of a word) of class-conditional Kneser-Ney models, from the definition."""
    d, ds = toxicity.DISCOUNT, toxicity.SHARED_DISCOUNT
    three = {(f, h, w, y) for _, t, y in rows for x in [t.split()] for f, h, w in zip(["", "", *x], ["", *x], x)}
    two = collections.Counter((h, w, y) for _, h, w, y in three)
    one, after, taken = collections.Counter(), collections.Counter(), collections.Counter()
    for (h, w, y), c in two.items():
        one[w, y] += 1
        after[h, y] += c
        taken[h, y] += min(c, d)
    either = collections.Counter(w for _, w in {(h, w) for h, w, _ in two})
    seen = len(either)
    total, off = collections.Counter(), collections.Counter()
    for (w, y), c in one.items():
        total[y] += c
        off[y] += min(c, d)

    def low(w, y):
        shared = (max(either[w] - ds, 0) + ds * seen / (seen + 1)) / sum(either.values())
        return (one[w, y] - min(one[w, y], d) + (off[y] + 1) * shared) / (total[y] + 1)

    def high(h, w, y):
        return (two[h, w, y] - min(two[h, w, y], d) + (taken[h, y] + 1) * low(w, y)) / (after[h, y] + 1)

    return lambda h, w: math.log(high(h, w, 1) / high(h, w, 0)), lambda w: math.log(low(w, 1) / low(w, 0))


def test_toxicity_against_the_definition(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "BUCKET_BYTES", 4000)
    rnd = random.Random(12)
    rows = [(i, " ".join(rnd.choice([f"a{rnd.randrange(6)}", f"b{rnd.randrange(90)}", "bad" if i % 2 else "good"]) for _ in range(40)), i % 2) for i in range(60)]
    model = toxicity.train(table(spark, [*rows, *rows[:5]], "doc_id long, text string, label int"))
    of_pair, of_word = kneser_ney_model(rows)
    found = model.shipped().value
    key = lambda w: toxicity.words(pa.array([w]))[0] if w else toxicity.np.zeros(1, toxicity.np.uint64)
    kept = 0
    for h, w in {(h, w) for _, t, _ in rows for h, w in zip(["", *t.split()], t.split())} | {("never", "a1"), ("a1", "never"), ("never", "seen")}:
        r, low = toxicity.ratios(key(h), key(w), found)
        assert r[0] == pytest.approx(of_pair(h, w)) and low[0] == pytest.approx(of_word(w))
        kept += not math.isnan(found[1](toxicity.pair(key(h), key(w)))[0][0])
    assert kept > 20 and model.pairs.count() == kept


def test_toxicity_of_ordinary_words(spark):
    """Expressions made of ordinary words, and a word that begins like an ordinary one."""
    rnd = random.Random(6)

    def doc(kind):
        w = [rnd.choice(["green", "stones", "roll", "down", "hills", "interest", *(f"word{k}" for k in range(40))]) for _ in range(40)]
        for _ in range(4):
            w[(at := rnd.randrange(38)) : at + 2] = {0: rnd.choice([["stones", "green"], ["interest", "roll"]]), 1: ["green", "stones"], 2: ["interloper", "roll"]}[kind]
        return " ".join(w)

    rows = [(i, doc(k), int(k > 0)) for i in range(900) for k in [(0, 0, 1, 2)[i % 4]]]
    model = toxicity.train(table(spark, rows, "doc_id long, text string, label int"))
    new = [(i, doc(i % 3), int(i % 3 > 0)) for i in range(150)]
    got = {r.doc_id: r.score for r in toxicity.score(table(spark, [(i, t) for i, t, _ in new]), model).collect()}
    assert sum((got[i] >= 0.5) == bool(y) for i, _, y in new) >= 135
