"""The pipeline's stages, in order, each against plain Python on what it was given."""

import collections
import random

import pytest

pytest.importorskip("docloom.llm")
pipeline = pytest.importorskip("corpus_pipeline")

from test_llm import jaccard_model, reference_ids  # noqa: E402


def test_stages(spark, tmp_path):
    rnd = random.Random(8)
    word = lambda: rnd.choice(["the", "of", "and"]) if rnd.random() < 0.3 else "".join(rnd.choice("aeioustrnl") for _ in range(6))
    text = lambda n: " ".join(word() for _ in range(n))
    item = text(20) + ". " + text(5) + "."
    base = [text(120) for _ in range(30)]
    docs = [(i, f"{t}\nAll rights kept here.", "en", f"s{i % 15}") for i, t in enumerate(base)]
    docs += [(100 + i, base[i] + " " + text(2), "en", "s1") for i in range(5)]
    docs += [(200, text(60) + " " + item + " " + text(60), "en", "s2"), (201, "too short", "en", "s2"), (202, None, None, None)]
    df = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in docs], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    given, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in pipeline.STAGES:
        stage(spark, given, str(tmp_path)).write.parquet(str(tmp_path / name))
        given = spark.read.parquet(str(tmp_path / name))
        seen[name] = given.collect()
    ids = lambda name: {r.doc_id for r in seen[name]}
    assert ids("quality_rules") == {i for i, _, _, _ in docs} - {201, 202}
    assert ids("line_dedup") == ids("quality_rules")
    lined = {r.doc_id: r.text for r in seen["line_dedup"]}
    assert [i for i, t in lined.items() if "All rights" in t] == [0] and all(lined[i] == base[i] for i in range(1, 30))
    groups = jaccard_model(list(lined.items()), 5, 80)
    assert ids("near_duplicates") == {g for _, g in groups.values()} and len(ids("near_duplicates")) == 31
    assert ids("decontamination") == ids("near_duplicates") - {200}
    parts = collections.defaultdict(list)
    for r in sorted(seen["best_fit_packing"], key=lambda r: r.piece):
        parts[r.doc_id] += r.ids
    assert dict(parts) == {r.doc_id: reference_ids(r.text) for r in seen["decontamination"]}


def test_decontamination_without_ids(spark, tmp_path):
    item = "Who wrote the long book about the white whale at sea. Herman Melville did."
    spark.createDataFrame([(1, item), (2, "clean"), (3, "clean text")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    # short items drop nothing; an id that is a text's hash is another document
    hashed = spark.sql("SELECT xxhash64(CAST(NULL AS STRING)) AS h").first().h
    docs = spark.createDataFrame([(hashed, item), (None, f"before {item} after"), (None, "clean text"), (5, item), (6, "clean text"), (None, None)], "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "0L AS n_chars")
    got = dict(pipeline.STAGES)["decontamination"](spark, docs, str(tmp_path)).collect()
    assert sorted(str((r.doc_id, r.text)) for r in got) == sorted(map(str, [(None, "clean text"), (6, "clean text"), (None, None)]))


KINDS = "doc_id long, text string, lang string, source string, n_chars long, key string, id long, cell int, n_shingles int"


def test_stages_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    given = spark.createDataFrame([], KINDS)
    for name, stage in pipeline.STAGES:
        stage(spark, given, str(tmp_path)).write.parquet(str(tmp_path / name))
        given = spark.read.parquet(str(tmp_path / name))
        assert given.count() == 0


def test_stages_of_odd_rows(spark, tmp_path):
    """Repeated rows, nulls anywhere, one id of two texts, a very long text and columns of the operators' names."""
    rnd = random.Random(3)
    text = lambda n: " ".join(rnd.choice(["the", "of", "and"]) if rnd.random() < 0.3 else "".join(rnd.choice("aeioustrnl") for _ in range(6)) for _ in range(n))
    a, b, c, long_ = text(90), text(90), text(90), text(40_000)
    rows = [(1, a, "en", "s"), (1, a, "en", "s"), (2, a, None, None), (3, b, "en", None), (3, c, "en", "s"), (None, b, None, "s"), (None, text(80), "en", "s"), (4, None, None, None), (5, long_, "en", "s"), (6, "", "en", "s")]
    rows += [(10 + k, text(100), "en", "s") for k in range(12)]
    spark.createDataFrame([(1, None), (None, ""), (2, text(12))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    given, kept = spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "k", 7, 7, 7) for r in rows], KINDS), {}
    for name, stage in pipeline.STAGES:
        stage(spark, given, str(tmp_path)).write.parquet(str(tmp_path / name))
        given = spark.read.parquet(str(tmp_path / name))
        kept[name] = collections.Counter((r.doc_id, r.text) for r in given.collect()) if name != "best_fit_packing" else given.collect()
        assert name == "best_fit_packing" or given.columns == pipeline.COLUMNS
    assert kept["quality_rules"] == collections.Counter((i, t) for i, t, _, _ in rows if t)
    assert kept["line_dedup"] == kept["quality_rules"]  # no line has ten sites
    # of equal texts the least id's stays, of equal rows one; a row without an id is no document's copy
    assert kept["near_duplicates"] == collections.Counter({(i, t): 1 for i, t, _, _ in rows if t and i != 2})
    assert kept["decontamination"] == kept["near_duplicates"]
    assert sum(r.length for r in kept["best_fit_packing"]) == sum(len(reference_ids(t)) * n for (_, t), n in kept["decontamination"].items())
