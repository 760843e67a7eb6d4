"""Piece ids, collocations and whitening against the library, plain Python and exact fractions."""

import collections
import hashlib
import random
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
pytest.importorskip("docloom.llm")

import sentencepiece  # noqa: E402

from docloom.llm import phrases, pieces, whitening  # noqa: E402

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "   x", "one", "a▁b", "▁", "\n", "a\n\n b\t", "<0x0A></s><s><unk>", "a\x00b", "é×ß　１9７😀 don't  \r\n", "日本語のテキスト‍ 日本", "�", "x " * 30000, "ab" * 20000, " " * 3000,
    "q" * 50001, "stop. stop! STOP?", "مرحبا بالعالم", "🏳️‍🌈 flags", "x y z",
]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


# pieces


def test_pieces_are_the_librarys(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rnd = random.Random(3)
    alphabet = "aeinrst  .,'é日\n▁0"
    made = ["".join(rnd.choice(alphabet) for _ in range(rnd.choice([1, 3, 20, 300]))) for _ in range(300)]
    texts = [*ODD, *made, *made[:20]]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "no id")], "doc_id long, text string").selectExpr("*", "doc_id AS ids", "text AS decoded")
    got = {r.doc_id: r for r in pieces.encode(df, MODEL, decoded=True).collect()}
    assert len(got) == len(texts) + 1
    for i, t in [*enumerate(texts), (None, "no id")]:
        want = [*lib.encode(t or ""), 2]
        assert got[i].ids == want and got[i].n_tokens == len(want)
        assert got[i].decoded == lib.decode(want)
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(df, MODEL, end=False), MODEL).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in enumerate(texts))


def test_pieces_of_the_tables(spark):
    from docloom.llm.queries import queries

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries()["op11_sentencepiece"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = [*lib.encode(r.text or ""), 2]
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == (len(ids), digest(" ".join(map(str, ids))), digest(lib.decode(ids)))


def test_pieces_differing_from_the_library_raise():
    voc = pieces.Vocabulary(MODEL)
    voc.cost = {}
    with pytest.raises(AssertionError, match="agenda"):
        voc.ids(pa.array(["the"]))


def test_pieces_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pieces.encode(empty, MODEL, decoded=True).collect() == []
    assert pieces.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), MODEL).collect()[0].text is None


def test_vocabulary_of_another_kind(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto

    with open(MODEL, "rb") as f:
        model = proto.ModelProto.FromString(f.read())
    model.trainer_spec.byte_fallback = False
    path = tmp_path / "m.model"
    path.write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="byte_fallback"):
        pieces.Vocabulary(str(path))


# phrases


def phrase_model(docs, max_n, min_count, top):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in docs:
        lang = lang or "und"
        small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", small):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_n + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    often = {x: c for x, c in f.items() if c >= min_count and len(x[1]) > 1}
    out = collections.defaultdict(list)
    for (lang, p), a in often.items():
        inside = any(lang == m and len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (m, q), b in often.items())
        if inside:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        s, k = min(cuts)
        out[lang].append((-s, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, r, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items() for r, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)}


@pytest.fixture(scope="module")
def talk():
    rnd = random.Random(9)
    words = ["New", "york", "city", "of", "the", "é", "x-y", "日本", "THE", "a"]
    docs = []
    for i in range(300):
        w = []
        while len(w) < rnd.choice([0, 1, 4, 12, 60]):
            w += rnd.choice([["New", "York", "City"], ["in", "spite", "of", "the", "rain", "again"], [rnd.choice(words)], [rnd.choice(words) + rnd.choice(".,;:!?\n\r\v\f")], ["\t", rnd.choice(words)], ["a", "a", "a"]])
        docs.append((" ".join(w), rnd.choice(["en", "en", "de", None, "und"])))
    return [*docs, (None, "en"), (None, None), ("", "xx"), (" \t", "yy"), ("...", "zz"), *docs[:30], ("word " * 20000, "en"), ("a", "one")]


@pytest.mark.parametrize(("max_n", "min_count", "top"), [(5, 12, 2000), (3, 5, 7), (2, 1, 50)])
def test_collocations(spark, talk, max_n, min_count, top):
    df = spark.createDataFrame([(t, lang, 1, 2) for t, lang in talk], "text string, lang string, rank int, n int").repartition(7)
    rows = phrases.collocations(df, max_n, min_count, top).collect()
    assert {tuple(r) for r in rows} == phrase_model(talk, max_n, min_count, top) and len(rows) == len({(r.lang, r.rank) for r in rows})


def test_collocations_with_a_full_filter(spark, talk, monkeypatch):
    """A bitmap of few bits lets nearly all through, and the result is the same."""
    monkeypatch.setattr(phrases, "FILTER_BITS", 7)
    df = spark.createDataFrame(talk, "text string, lang string")
    assert {tuple(r) for r in phrases.collocations(df, 5, 12).collect()} == phrase_model(talk, 5, 12, 2000)


def test_scores_beyond_64_bits(spark):
    rows = [(10**12 + k, 10**16 + 7, 10**6 + k, 10**12 + 3) for k in range(5)] + [(100, 3 * 10**18, 100, 100), (7, 10**18, 7, 10**18)]
    df = spark.createDataFrame(rows, "a long, n long, l long, r long").select("*", phrases.score("a", "n", "l", "r").alias("s"))
    for r in df.where("a <> 100").collect():
        assert r.s == 1000 * r.a * r.n // (r.l * r.r)


def test_collocations_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []
    assert phrases.collocations(spark.createDataFrame([(None, None)], "text string, lang string")).collect() == []


# whitening


def exact(vectors):
    """n, deviations and covariance of x vectors, in fractions."""
    fit = sorted({tuple(v) for v in vectors})
    n, d = len(fit), len(fit[0])
    sums = [sum(v[k] for v in fit) for k in range(d)]
    y = [[n * v[k] - sums[k] for k in range(d)] for v in fit]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in y), n**3)) for j in range(d)] for i in range(d)])
    return n, sums, cov


def check_whitened(rows, given, top):
    """given: key to vector, or None where there must be no row."""
    good = {k: [int(np.floor(np.float64(c) * 256)) for c in v] for k, v in given.items() if v is not None}
    n, sums, cov = exact(good.values())
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:top], u[:, ::-1][:, :top]
    by = collections.defaultdict(dict)
    for r in rows:
        by[r.vec_id][r.component] = r
    assert set(by) == set(good)
    sign = {}
    for key, x in good.items():
        y = [n * a - s for a, s in zip(x, sums)]
        assert sorted(by[key]) == list(range(1, len(e) + 1))
        for c, r in by[key].items():
            want = float(np.dot([float(Fraction(v, n)) for v in y], u[:, c - 1]) / np.sqrt(e[c - 1]))
            if abs(want) > 0.1:
                sign.setdefault(c, np.sign(want * r.whitened))
            assert r.n == n and r.deviation == sum(v * v for v in y)
            assert abs(r.whitened - sign.get(c, 1) * want) < 1e-9 or abs(want) <= 0.1
            assert abs(r.explained - e[c - 1] / np.trace(cov)) < 1e-9 and r.identity_error < 1e-9


def test_whitening(spark):
    rnd = np.random.default_rng(4)
    base = rnd.normal(size=(400, 9)) @ np.diag([9, 5, 3, 2, 1, 0.5, 0.2, 0.1, 0.01]) @ rnd.normal(size=(9, 9))
    given = {k: [float(np.float32(c)) for c in v] for k, v in enumerate(base)}
    given |= {1000 + k: given[5] for k in range(200)} | {2000: [0.0] * 9, 2001: [-0.0] * 9}
    odd = {3000: None, 3001: [1.0] * 8 + [None], 3002: [1.0] * 8 + [float("nan")], 3003: [float("inf")] + [0.0] * 8, 3004: [-float("inf")] * 9}
    df = spark.createDataFrame([(k, v, 1, 0.5) for k, v in {**given, **odd}.items()], "vec_id long, embedding array<float>, n int, whitened double").repartition(6)
    check_whitened(whitening.whitened(df).collect(), given | {k: None for k in odd}, 4)
    check_whitened(whitening.whitened(df, top=2).collect(), given | {k: None for k in odd}, 2)


def test_whitening_of_large_entries(spark):
    """n * x passes 64 bits: limbs and Python integers still give exact sums."""
    rnd = random.Random(8)
    given = {k: [rnd.choice([-1, 1]) * rnd.random() * 2.0 ** rnd.choice([45, 46]), rnd.random() * 2.0**45, 1.0] for k in range(40)}
    df = spark.createDataFrame(list(given.items()), "vec_id long, embedding array<double>")
    x = {k: [int(np.floor(c * 256)) for c in v] for k, v in given.items()}
    n, sums, cov = exact(x.values())
    vectors = whitening.quantised(df, "embedding", "vec_id")
    found = whitening.sums_of(vectors.select("x"))
    assert found == {3: (n, sums)}
    g = whitening.products_of(vectors.select("x"), found)[3]
    y = [[n * v[k] - sums[k] for k in range(3)] for v in x.values()]
    assert g.tolist() == [[sum(r[i] * r[j] for r in y) for j in range(3)] for i in range(3)]
    rows = whitening.whitened(df, top=1).collect()
    e = np.linalg.eigvalsh(cov)
    assert all(abs(r.explained - e[-1] / e.sum()) < 1e-9 and r.identity_error < 1e-9 for r in rows)
    squares = {k: sum((n * a - s) ** 2 for a, s in zip(v, sums)) for k, v in x.items()}
    assert {r.vec_id: r.deviation for r in rows} == {k: s if s < 1 << 63 else None for k, s in squares.items()}


def test_gram_is_exact():
    rnd = np.random.default_rng(1)
    for high in (3, 1 << 19, 1 << 20, 1 << 41, 1 << 61):
        y = rnd.integers(-high, high, (whitening.BLOCK if high < 1 << 21 else 50, 4), endpoint=True)
        y[0] = high
        y[1] = -high
        plain = y.astype(object)
        assert whitening.gram(y).tolist() == (plain.T @ plain).tolist()


def test_whitening_without_variance(spark):
    one = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id or 0, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one) == [(k, c, 1, 0, 0.0, 0.0, 0.0) for k in (0, 1, 2) for c in (1, 2)]
    line = whitening.whitened(spark.createDataFrame([(k, [float(k), float(k), 0.0]) for k in range(10)], "vec_id long, embedding array<double>")).collect()
    assert {r.whitened for r in line if r.component > 1} == {0.0} and all(r.identity_error < 1e-9 for r in line)


def test_whitening_of_two_lengths_and_of_nothing(spark):
    rows = [(k, [float(k % 7), float(k % 5)]) for k in range(35)] + [(100 + k, [float(k), float(k * k), float(k % 3)]) for k in range(20)] + [(200, [])]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert collections.Counter(r.n for r in got) == {35: 70, 20: 60} and all(r.identity_error < 1e-9 for r in got)
    assert whitening.whitened(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    assert whitening.whitened(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect() == []


# packing, against exact optima


def fewest_bins(size, capacity):
    """Exactly, over all subsets."""
    n = len(size)
    best = [(0, 0)] + [None] * ((1 << n) - 1)
    for mask in range(1, 1 << n):
        options = []
        for k in range(n):
            if mask >> k & 1:
                bins, room = best[mask ^ (1 << k)]
                options.append((bins, room - size[k]) if room >= size[k] else (bins + 1, capacity - size[k]))
        best[mask] = min(options, key=lambda x: (x[0], -x[1]))
    return best[-1][0]


def test_islands_find_the_optimum_of_small_cases():
    from docloom.llm import packing

    rnd, over = random.Random(12), 0
    for _ in range(60):
        n = rnd.choice([8, 10, 11])
        size = [rnd.choice([rnd.randrange(200, 600), rnd.randrange(1, 1025), 512, 341]) for _ in range(n)]
        elites = []
        for seed in range(3):
            elites.append(packing.evolve(size, 1024, elites, seed, 12))
        found = min(map(len, elites))
        assert all(sum(size[i] for i in b) <= 1024 for b in elites[-1]) and found >= fewest_bins(size, 1024)
        over += found - fewest_bins(size, 1024)
    assert over <= 1  # of 292 sequences


def test_line_removal_takes_time_of_its_lines(spark):
    """Texts of very many lines that all are shared."""
    import time

    from docloom.llm import linededup

    lines = "\n".join(f"line {k} of all" for k in range(60_000))
    df = spark.createDataFrame([(d, lines, f"s{d}") for d in range(11)], "doc_id long, text string, source string").repartition(11)
    began = time.perf_counter()
    got = {r.doc_id: (r.n_lines, r.n_removed, len(r.text)) for r in linededup.remove_widespread(df).collect()}
    assert got == {0: (60_000, 0, len(lines)), **{d: (60_000, 60_000, 0) for d in range(1, 11)}} and time.perf_counter() - began < 60


def test_places_by_a_given_number(spark):
    from docloom.llm import packing

    rnd = random.Random(2)
    rows = [(k * 7 % 1000, rnd.choice([1024, 900, 300, 10, 1]), k) for k in range(700)]
    df = spark.createDataFrame(rows, "n long, length long, row long").repartition(5)
    got = packing.place(df, number="n", shard_pieces=200).collect()
    assert got[0].asDict().keys() == {"length", "row", "sequence_id", "offset"} and sorted(r.row for r in got) == list(range(700))
    used = collections.defaultdict(list)
    for r in got:
        used[r.sequence_id].append((r.offset, r.length))
    assert all(sorted(v)[0][0] == 0 and sum(n for _, n in v) <= 1024 and all(a[0] + a[1] == b[0] for a, b in zip(sorted(v), sorted(v)[1:])) for v in used.values())
