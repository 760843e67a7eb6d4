"""What a plan computes once: an expression that a lambda or a pushed filter repeats costs a row many times over."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom import catalog
from docloom.functions import dates, evidence, identifiers, mrz, text
from docloom.operators import analytics, classification, normalizers, rule_packs, sequences

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(("f", "most"), [(text.clean_value, 1), (text.is_missing_in_pages, 1), (dates.normalize_date, 2), (identifiers.canonical_document_number, 4), (identifiers.canonical_run, 4)], ids=lambda x: getattr(x, "__name__", str(x)))
def test_named_once_in_lambdas(spark, f, most):
    of = (lambda x: f(F.lit("CL"), x)) if f is identifiers.canonical_document_number else f
    made = plan(spark.range(1).select(F.array(F.col("id").cast("string")).alias("a")).select(F.transform("a", of).alias("x")))
    assert made.count("regexp_replace(") <= most


def test_sequence_reads_each_date_once(spark):
    rows = spark.createDataFrame([("1990-01-01", "2020-01-01", "2030-01-01")], "b string, i string, e string")
    df = rows.select(dates.sequence_valid("b", "i", "e").alias("x"))
    assert plan(df).count("regexp_replace(") <= 3 and df.first()["x"]


def test_confidence_looks_at_each_value_once(spark):
    df = spark.createDataFrame([("CL", "x")], "c string, v string")
    v = F.col("v")
    made = plan(df.select(evidence.license_confidence(F.col("c"), v, v, v, v, v, v, v, v, v).alias("x")))
    assert made.count("SIN ") <= 9 + 3  # nine values, and the three dates in their sequence


def test_candidates_are_made_outside_filters(spark):
    filters = [x for x in plan(catalog.queries()["field_candidates"](spark, SF)).split("\n") if "Filter" in x]
    assert not any("transform(" in x for x in filters)


def test_pairs_of_lines_are_made_outside_filters(spark):
    filters = [x for x in plan(catalog.queries()["kv_lead"](spark, SF)).split("\n") if "Filter" in x]
    assert not any("regexp_extract(" in x for x in filters)


def test_masks_are_put_on_once(spark):
    assert plan(catalog.queries()["redact_text"](spark, SF)).count("regexp_extract_all(") == len(text.IDENTIFYING)


@pytest.mark.parametrize("said", ["nada", "a@b.cc 12345678-9 y 12345678", None])
def test_masks_as_before(spark, said):
    got = spark.createDataFrame([(said,)], "t string").select(text.redact_inline("t").alias("x")).first()["x"]
    assert got == {"nada": "nada", "a@b.cc 12345678-9 y 12345678": "a@****cc 12******-9 y 12****78", None: None}[said]


def test_rule_packs_make_only_what_their_family_needs(spark):
    """a passport's or a license's rules never look at a back side, dates of an identity or a pack's own fields."""
    kind = "document_id int, family string, country string, variant string, pack_id string, holder_name string, issuer string, side string, profile string, values map<string,string>"
    said = {"domicilio": "x", "run": "12.345.678-5", "cuenta": "7", "fecha-de-emision": "2020-01-01", "numero": "1"}
    rows = spark.createDataFrame([(k, f, "CL", None, None, None, None, None, None, said) for k, f in enumerate(("passport", "identity"))], kind)
    passport, identity = rule_packs.prepared(rows).select("document_id", "n_back", "n_dates", "run", "number", "pack_holder").orderBy("document_id").collect()
    assert set(passport[1:]) == {None} and (identity.n_back, identity.n_dates, identity.run) == (1, 1, "12.345.678-5")


def test_check_digits_by_place(spark):
    """a character's value is looked up, not matched twice."""
    rows = spark.createDataFrame([("L898902C3",), ("<<Z9é",), ("",)], "t string").select(identifiers.mrz_digit("t").alias("x"))
    assert [r["x"] for r in rows.collect()] == [6, (35 + 9 * 7) % 10, 0] and "RLIKE" not in plan(rows)


def test_rows_are_dealt_whatever_the_splits(spark, tmp_path):
    """a row group is one task's, however many splits its file has."""
    from docloom.plans.registry import spread

    spark.range(100_000).coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = spark.read.parquet(str(tmp_path / "one"))
        assert rows.rdd.getNumPartitions() >= 8
        dealt = [r["n"] for r in spread(rows).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sum(dealt) == 100_000 and len(dealt) >= 24 and max(dealt) < 10_000
    for name in ("dominant_page", "date_sequence", "zone_identity"):
        assert "Repartition" in plan(catalog.queries()[name](spark, SF))


def test_gauges_read_records_once(spark):
    """F22"""
    df = catalog.queries()["metrics_text"](spark, SF)
    assert plan(df).count("parquet") == 2  # orders and lineitem
    assert plan(catalog.queries()["learning_loop_totals"](spark, SF)).count("parquet") == 2
    empty = analytics.gauges(catalog.queries()["document_signals"](spark, SF).limit(0).select(
        "*", *(F.lit(None).cast("string").alias(c) for c in ("status", "decision")), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("struct<status:string,queue:string,created_at:timestamp,next_retry_at:timestamp>").alias("job"),
    ), "2020-01-01 00:00:00")
    lines = [r["line"] for r in empty.orderBy("place").collect()]
    assert len(lines) == 23 and lines[0] == "ocr_documents_total 0"


def test_compatibility_digits_still_make_dates(spark):
    df = spark.createDataFrame([("²0/01/1990",), ("1 DE MAYO DE 1990",), ("1 de mayo",)], "t string")
    assert [r["x"] for r in df.select(dates.normalize_date("t").alias("x")).collect()] == ["1990-01-20", "1990-05-01", "1 de mayo"]


def test_keys_of_five_bytes():
    from docloom.llm import sigtree

    keys = np.array([0, 1, 255, 1 << 39, (1 << 40) - 1], np.uint64)
    assert len(sigtree._short(keys).tobytes()) == 5 * len(keys)
    assert (sigtree._long(sigtree._short(keys).tobytes()) == keys).all()


def test_rows_of_periods_without_folds(spark):
    """what lines give is compiled, not folded by interpreted lambdas; no line of a long row is left out."""
    lines = spark.range(100_003).select(F.lit(1).alias("doc_id"), F.col("id").alias("line_no"), F.when(F.col("id") == 0, "ENE-2024 1.000 2.000").when(F.col("id") == 100_002, "76.543.210-3 2024-02-03").otherwise("ACME").alias("line"))
    rows = sequences.period_rows(lines)
    assert "aggregate(" not in plan(rows) and "all_dates" not in plan(rows) and plan(rows).count("lambdafunction(") <= 40
    got = rows.select("employer", "employer_rut", "date", F.length("detail").alias("n")).first()
    assert tuple(got) == ("ACME", "76.543.210-3", "2024-02-03", len("ENE-2024 1.000 2.000") + 5 * 100_001 + 1 + len("76.543.210-3 2024-02-03"))


def test_rows_of_periods_as_folded(spark):
    """as the fold over the same lines gives them, whatever their order."""
    heads = ("ENE-2024 1.000 2.000 ACME 76.543.210-3 2024-02-03", "xx feb/2023 $0 $0 PERIODO SIN -", "MAR-2022", "Abr-2021 1.000.000 1.000 COD: 3", "may-2020 12.345.678-5 15 DE MAYO DE 2020", "JUN-2024- PERIODO SIN 12.345.678-5")
    more = (": -", " - cotización: ", "ACME\u00a0 S.A. -", "76.543.210-3", "el 2024/02/03", "²0/01/1990 x", "01 ENE 1990 y", "EMPRESA 1.234", "Cordialmente", "pie", "1 de Mayo de 1990", "12 13 2014", "RUT 1.234.567-k 03-04-2011")
    picks = np.random.default_rng(1).integers(0, 10**6, (400, 7))
    said = [(k, [(heads if (n == 1 or x % 5 == 0) else more)[x % (len(heads) if (n == 1 or x % 5 == 0) else len(more))] for n, x in enumerate(map(int, row))]) for k, row in enumerate(picks)]
    docs = spark.createDataFrame(said, "doc_id int, lines array<string>")
    names = ("period", "period_label", "date", "amount", "renta_amount", "pension_amount", "code", "employer", "employer_rut", "detail")
    folded = docs.select("doc_id", F.posexplode(normalizers.block_rows(normalizers.period_blocks(F.col("lines")))).alias("row", "r")).select("doc_id", (F.col("row") + 1).alias("row"), *(f"r.{n}" for n in names))
    rows = sequences.period_rows(docs.select("doc_id", F.posexplode("lines").alias("line_no", "line")))
    key = lambda r: (r["doc_id"], r["row"])
    assert sorted(map(tuple, rows.collect()), key=lambda r: r[:2]) == [tuple(r) for r in sorted(folded.collect(), key=key)]


def test_certificates_confidence_without_lambdas(spark):
    """F16: each value is looked at once, compiled; a value that stands for none counts for nothing, whatever its marks."""
    said = ["x", "", None, " - ", "no detectadó", "sin datos", "SINDATOS", "¨ Pending", "¨-¨", "nombre  por confirmar:", " NO DETECTADO"]
    df = spark.createDataFrame([(v,) for v in said], "v string").select("v", F.lit(0).alias("n"))
    v, n = F.col("v"), F.col("n")
    got = df.select("v", evidence.certificate_confidence(F.lit(0.0), v, v, v, v, v, v, n, n, n, n).alias("x"), F.when(evidence.has("v"), 0.7).otherwise(0.34).alias("y"))
    assert "lambdafunction(" not in plan(df.select(evidence.certificate_confidence(F.lit(0.0), v, v, v, v, v, v, n, n, n, n)))
    assert [r["x"] for r in got.collect()] == [r["y"] for r in got.collect()]


def test_values_once_by_position(spark):
    """The type of a value that is made once is derived once, not for every row."""
    assert "element_at(transform(" in plan(spark.range(1).select(text.let(F.col("id"), lambda x: x + x)))


@pytest.mark.parametrize("said", ["el 2024-01-02, 2024/01/02 y 03-04-2020 y 03/04-2020", "01 ENE 2024 02XYZ2020 03\n \tFEB\n2020", "01 02  2003 x 1 de mayo de 1990", "²0/01/1990 ² DE MAYO DE ²⁰²⁰ 14 de foo de 2020", "nada 12", "", None, "01  ENE 2020 99 99 9999"])
def test_dates_by_their_shapes(spark, said):
    t = F.col("t")
    found = [F.regexp_extract_all(t, F.lit(p), F.lit(0)) for p in evidence.DATES] + [F.regexp_extract_all(F.upper(text.strip_accents(t)), F.lit(evidence.LONG_DATE), F.lit(0))]
    row = spark.createDataFrame([(said,)], "t string").select(evidence.all_dates(t).alias("x"), F.array_distinct(F.transform(F.concat(*found), dates.normalize_date)).alias("y"), evidence.first_date("t").alias("f")).first()
    assert row["x"] == row["y"] and row["f"] == (row["y"][0] if row["y"] else None)


@pytest.mark.parametrize("said", ["a b", " a  b ", "a  b\tc", "  a\x1fb\n\nc:", "- a : ", "   ", "", None, "é　  x"])
def test_white_space_collapses_as_before(spark, said):
    row = spark.createDataFrame([(said,)], "t string").select(text.cleaned("t").alias("x"), F.btrim(F.regexp_replace("t", text.SPACE + "+", " "), F.lit(" :-")).alias("y")).first()
    assert row["x"] == row["y"]


def test_classified_step_by_step(spark):
    """scores are columns, which are compiled, not lambdas; as the column form gives them, zones of short texts included."""
    zone = "I<CHLB112223337S13<<<<<<<<<<<< 6505067M3101023CHL12345678<5<9 RAMOS<VIDAL<<EVA<LUZ<<<<<<<<<<<"
    said = ["", None, "cedula de identidad  nombres", zone, zone.replace(" ", "\n"), "I<CHL12345M1234567890123ABCDEFGHIJK<<ABCDE", "I«CHL" + "B" * 25 + "««" + "C" * 9, "licencia clase chile", "P<COLABC passport", "x" * 80]
    rows = spark.createDataFrame([(k, v, f, c) for k, v in enumerate(said) for f, c in (("auto", "XX"), ("identity", "cl"), (None, None))], "id int, text string, family string, country string")
    steps = classification.classify(rows)
    at_once = rows.select("id", "text", classification.classification(F.col("text"), F.col("family"), F.col("country")).alias("c")).select("id", "text", "c.*")
    assert sorted(map(str, steps.collect())) == sorted(map(str, at_once.collect())) and steps.columns == at_once.columns
    assert not any("lambdafunction(" in x and "family_hint" in x for x in plan(steps).split("\n"))
    for t in said:
        one = spark.createDataFrame([(t,)], "t string").select(mrz.parse_td1(F.coalesce("t", F.lit("")))["mrz"].alias("a"), mrz.parse_td1_if_any(F.col("t"))["mrz"].alias("b")).first()
        assert one["a"] == one["b"]


def test_fragments_in_columns(spark):
    """pieces of a zone as columns, compiled, are those of the struct."""
    said = ["NACIO EN: 2\nTEMUCO\nI <CHL B44555123 ruido\nCHL1234567<K", "INCHLB44555123\n660607 1M 320203 3CHL\nSOTO<<EVA<<<<<<<", "uno\nel nacio en\nCHL\n6606071<3202033CHL\n<<<<<<<<<<<<<<", "", None, "a:\n -\n«« ROJAS««LUZ MARIA"]
    rows = spark.createDataFrame(list(enumerate(said)), "id int, t string")
    steps, at_once = mrz.with_td1_fragments(rows, F.col("t")), rows.select("id", "t", mrz.parse_td1_fragments("t").alias("z")).select("id", "t", "z.*")
    assert sorted(map(str, steps.collect())) == sorted(map(str, at_once.collect())) and steps.columns == at_once.columns
    assert plan(catalog.queries()["zone_fragments"](spark, SF)).count("birth_place") == 0
