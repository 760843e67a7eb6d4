"""Literal goldens and small models of the operators."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions import dates, identifiers, mrz, scores, text
from docloom.operators import analytics, binding, jobs, matching, sequences


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("value, ok", [("12.345.678-5", True), ("12.345.678-K", False), ("", False), ("123456785", False), ("RUN 12345678 - 5", True), ("no detectado", False), (None, False), ("11.111.112-k", True)])
def test_run(spark, value, ok):
    """A verifier stands behind a hyphen: without one nothing checks."""
    assert one(spark, identifiers.run_valid(F.lit(value).cast("string"))) is ok


@pytest.mark.parametrize(
    "value, run",
    [("12345678-5", "12.345.678-5"), ("rut 1,234,567 - k", "1.234.567-K"), ("123456785", "123456785"), (" none : ", "none"), ("PENDING", None), (None, None), ("x 12.345.678-5 y", "12.345.678-5"), ("a-b", "a-b")],
)
def test_canonical_run(spark, value, run):
    assert one(spark, identifiers.canonical_run(F.lit(value).cast("string"))) == run


@pytest.mark.parametrize(
    "country, value, number",
    [
        ("pe", "DNI 12345678-9", "12345678"), ("PE", "1234.5678", "12345678"), ("PE", "123456789", "123456789"), ("CO", "1.234.567", "1234567"), ("CO", "12345", "12345"), ("CL", "serie b123.456.789", "B123.456.789"),
        ("CL", "A12345678", "A12.345.678"), ("CL", "AB1234567", "AB12.345.67"), ("CL", "12.345.678-5", "12.345.678-5"), ("CL", "No Detectado", None), ("XX", " - ", None), ("XX", "abc:", "abc"),
    ],
)
def test_document_numbers(spark, country, value, number):
    assert one(spark, identifiers.canonical_document_number(F.lit(country), F.lit(value))) == number


@pytest.mark.parametrize(
    "value, iso",
    [
        ("2024-02-31", "2024-02-31"), ("2024/03/05", "2024-03-05"), ("05/03/2024", "2024-03-05"), ("5/3/2024", "5/3/2024"), ("05.03.2024", "05.03.2024"), ("vence 05 03  2024 aqui", "2024-03-05"), ("05 mar 2024", "2024-03-05"),
        ("05MARZO2024", "2024-03-05"), ("05MARCH2024", "05MARCH2024"), ("05JAN2024", "05JAN2024"), ("Lima, 5 de marzo de 2024.", "2024-03-05"), ("5 de martes de 2024", "5 de martes de 2024"), (" soon: ", "soon"), (" - ", None), (None, None),
    ],
)
def test_dates(spark, value, iso):
    value = F.lit(value).cast("string")
    assert one(spark, dates.normalize_date(value)) == iso
    assert one(spark, dates.strict_date(value)) == (iso if iso and iso[:4] == "2024" else None)


@pytest.mark.parametrize("value, period", [("ENE-2024", "2024-01"), ("periodo set/2023 x", "2023-09"), ("SEPT-2023", None), ("ENE 2024", None), ("ENE-1999", None), ("x", None), (None, None)])
def test_periods(spark, value, period):
    assert one(spark, dates.normalize_period(F.lit(value).cast("string"))) == period


@pytest.mark.parametrize(
    "birth, issue, expiry, ok",
    [("1990-01-01", "2020-01-01", "2030-01-01", True), (None, None, None, False), ("1990-01-01", "no date", None, False), (None, "SIN FECHA", "2030-01-01", True), ("2020-01-01", "2020-01-01", None, False), ("1990-01-01", None, "1980-01-01", False), ("1990-02-31", None, None, False)],
)
def test_date_sequences(spark, birth, issue, expiry, ok):
    assert one(spark, dates.sequence_valid(*(F.lit(x).cast("string") for x in (birth, issue, expiry)))) is ok


def zone_digit(text):
    value = {c: k for k, c in enumerate("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")}
    return str(sum(value.get(c, 0) * (7, 3, 1)[k % 3] for k, c in enumerate(text)) % 10)


def test_zone_digits(spark):
    """Five check digits, the last over all that stands before it; a filler is none."""
    line = "L898902C36UTO7408122F1204159ZE184226B<<<<<1"
    whole = line + zone_digit(line)
    assert one(spark, identifiers.td3_valid(F.lit(whole)))
    for at in (9, 19, 27, 42, 43):
        assert not one(spark, identifiers.td3_valid(F.lit(whole[:at] + str((int(whole[at]) + 1) % 10) + whole[at + 1 :])))
    empty = "L898902C36UTO7408122F1204159<<<<<<<<<<<<<<<"
    assert not one(spark, identifiers.td3_valid(F.lit(empty + zone_digit(empty))))
    zero = empty[:42] + "0"
    assert one(spark, identifiers.td3_valid(F.lit(zero + zone_digit(zero))))


def test_inline_redaction(spark):
    said = "mail ana.perez@mail.example.org cuenta 1234-5678-123456789 rut 12.345.678-K dni 12345678, 1234567 y 12345678901 a@b"
    want = "mail an**********************rg cuenta 12***************89 rut 12********-K dni 12****78, 1234567 y 12345678901 a@b"
    assert one(spark, text.redact_inline(F.lit(said))) == want
    assert one(spark, text.safe_preview(F.lit(said), 9)) == "mail an**"
    assert one(spark, text.redact_inline(F.lit(None).cast("string"))) is None and one(spark, text.redact_inline(F.lit(""))) == ""


@pytest.mark.parametrize(
    "line, label, value",
    [("Nombre:  Ana María", "Nombre", "Ana María"), ("Año/mes = 2024", "Año/mes", "2024"), ("a: bc d", "", ""), ("Total 12345: x y", "", ""), ("Ελλ: x y", "", ""), ("Fecha:2024", "", ""), ("x: no", "", "")],
)
def test_inline_pairs(spark, line, label, value):
    a, b = text.key_value(F.lit(line))
    assert (one(spark, a), one(spark, b)) == (label, value)


def test_likes(spark):
    says = lambda f, *values: [one(spark, f(F.lit(v))) for v in values]
    assert says(text.label_like, "FECHA DE EMISION", "1234567890", "12345 abcdefgh", "", "x" * 49, "ÑÑÑ 1.-") == [True, False, False, False, False, True]
    assert says(text.value_like, "ab", "abc", "Abc", "abc d", "ab1") == [False, False, True, True, True]
    assert says(text.table_row_like, "ene 2024-01 1.234.567", "a b 12", "2024-01 1.234", "x 10-02-2024 y") == [True, False, False, True]


def test_pairs_of_lines(spark):
    rows = [(1, 1, 0, "NOMBRE"), (1, 1, 1, ""), (1, 1, 2, "Ana  Perez"), (1, 1, 3, "Rut: 1-9"), (1, 1, 4, "FECHA"), (1, 2, 5, "2024-01-01"), (1, 2, 6, "nombre: Zoe Soto"), (1, 2, 7, "Nombre: ZOE SOTO")]
    got = sequences.key_value_pairs(spark.createDataFrame(rows, "doc_id long, page int, line_no int, line string")).orderBy("place").collect()
    assert [(r.place, r.label, r.value) for r in got] == [(0, "NOMBRE", "Ana Perez"), (3, "Rut", "1-9"), (6, "Nombre", "ZOE SOTO")]


def test_value_types(spark):
    says = lambda f: [one(spark, f(F.lit(v))) for v in ("2024-01-02", "2024/01/02", "abcd-ef-gh", "1.234,5-", "x", "")]
    assert says(text.value_type) == ["date", "date", "date", "number", "text", "text"]
    assert says(text.record_value_type) == ["date", "text", "text", "number", "text", "text"]


def test_stable_ids_keep_uuids(spark):
    made = "abcdef01-2345-4678-9abc-000000000001"
    assert one(spark, text.stable_uuid(F.lit(made))) == made
    assert one(spark, text.stable_uuid(F.lit("x"))) == "11f6ad8e-c52a-5984-abaa-fd7c3b516503"


def test_text(spark):
    assert one(spark, text.slugify(F.lit("  Año Nuevo!  "))) == "ano-nuevo"
    assert one(spark, text.mask_ends(F.lit("ABCDEFGHIJ"))) == "AB******IJ"
    assert one(spark, text.mask_ends(F.lit("ABC"))) == "***"
    assert one(spark, text.clean_value(F.lit(" :- "))) is None
    assert one(spark, identifiers.mrz_digit(F.lit("520727"))) == 3


@given(st.text(max_size=40))
@settings(max_examples=20, deadline=None)
def test_slugify_is_idempotent(spark, value):
    s = one(spark, text.slugify(F.lit(value)))
    assert one(spark, text.slugify(F.lit(s))) == s


def test_percentile_is_floor_of_rank(spark):
    assert one(spark, scores.floor_percentile(F.array(F.lit(4800), F.lit(1200)), 0.9)) == 1200
    rows = spark.createDataFrame([(True, 1200.0), (True, 4800.0), (False, 1.0)], "terminal boolean, latency_ms double")
    r = analytics.latency(rows).first()
    assert (r.p50, r.p90, r.p99, r.mean) == (1200, 1200, 1200, 3000)


def test_cost(spark):
    assert one(spark, analytics.processing_cost(F.array(F.lit("rapidocr"), F.lit("google-documentai"), F.lit("google-documentai")), F.lit(1))) == pytest.approx(0.055)


def test_cheaper_strategy_wins(spark):
    rows = [("a", 0, 0.98, 0.9, 0.9, 0.08, 0.052), ("b", 1, 0.99, 0.92, 0.95, 0.05, 0.1)]
    df = spark.createDataFrame(rows, "strategy string, ord int, exact double, stp double, agreement double, review double, cost double")
    assert analytics.routing_scores(df).where("recommended").first()["strategy"] == "a"


CANDIDATE = "field_id long, ord long, source string, engine string, value string, raw_text string, score double, confidence double, selected boolean"


def adjudicated(spark, rows, critical=False, current=None, agreement=None, disagreement=False):
    c = spark.createDataFrame([(1, k, s, "e-" + s, v, None, score, conf, v == current) for k, (s, v, score, conf) in enumerate(rows)], CANDIDATE)
    fields = spark.createDataFrame([(1, current, critical)], "field_id long, current_value string, critical boolean")
    votes = spark.createDataFrame([(1, agreement, disagreement)] if agreement is not None else [], "field_id long, agreement_ratio double, disagreement boolean")
    r = matching.adjudicate(fields, c, votes).first()
    return r.abstained, r.selected_value, r.confidence


def test_adjudication(spark):
    # two sources agree, and lead by far
    assert adjudicated(spark, [("a", "X", 0.9, 0.96), ("b", "x", 0.9, 0.95), ("c", "Y", 0.9, 0.9)], critical=True, agreement=0.667) == (False, "X", 0.872)
    # one source of middling confidence is no evidence, however it leads: an abstention has a confidence
    assert adjudicated(spark, [("a", "X", 0.7, 0.75)], agreement=0.5) == (True, None, 0.75)
    # evidence without a lead
    assert adjudicated(spark, [("a", "X", 0.9, 0.97), ("b", "Y", 0.8, 0.9)], critical=True) == (True, None, 0.97)
    assert adjudicated(spark, [("a", "X", 0.9, 0.97), ("b", "Y", 0.8, 0.9)]) == (False, "X", 0.679)
    # the value that the field has, without a conflict
    assert adjudicated(spark, [("a", "X", 0.4, 0.5)], current="X", agreement=0.4)[:2] == (False, "X")
    assert adjudicated(spark, [("a", "X", 0.4, 0.5)], current="X", agreement=0.4, disagreement=True)[0]
    # a critical field's own value under a conflict needs agreement and confidence
    assert adjudicated(spark, [("a", "X", 0.9, 0.91), ("b", "Y", 0.85, 0.9)], current="X", critical=True, agreement=0.5, disagreement=True)[:2] == (False, "X")
    # nothing to go by
    assert adjudicated(spark, []) == (True, None, None) == adjudicated(spark, [("a", " - ", 0.9, 0.9)])


def test_groups_show_their_best(spark):
    rows = [(1, 0, "b", "e", "AB", None, 0.5, 0.99, False), (1, 1, "a", "e", "a.b", None, 0.9, 0.2, False), (1, 2, "a", "e", None, "A-B", 0.1, None, False), (1, 3, "c", "e", "", None, 1.0, 1.0, False)]
    r = matching.candidate_groups(spark.createDataFrame(rows, CANDIDATE)).collect()
    assert [(x.key, x.value, x.sources, x.score, x.confidence, x["rank"]) for x in r] == [("ab", "a.b", ["a", "b"], 1.5, 0.99, 1)]


def test_lines_keep_their_anchor(spark):
    tokens = [(1, k, 1, 0.0, y, 10.0) for k, y in enumerate([0.0, 8.0, 16.0, 17.0])]
    got = sequences.cluster_lines(spark.createDataFrame(tokens, "doc_id long, token_id long, page long, x double, y double, height double"))
    assert [r.line for r in got.orderBy("token_id").collect()] == [0, 0, 1, 1]


def test_segments_and_greedy_rows(spark):
    pages = [(1, 1, "identity", "CL", "p", "front", "a"), (1, 2, "identity", "CL", "q", "back", "b"), (1, 3, "passport", "CL", "p", "front", "a")]
    got = sequences.segment_pages(spark.createDataFrame(pages, "doc_id long, page long, family string, country string, base_pack string, side string, variant string"))
    assert [r.segment for r in got.orderBy("page").collect()] == [0, 0, 1]
    rows = [(1, 0, "expected", {"a": "1", "b": ""}), (1, 1, "expected", {"a": "2"}), (1, 2, "actual", {"a": "1", "b": "x"}), (1, 3, "actual", {"a": "3"})]
    r = sequences.greedy_rows(spark.createDataFrame(rows, "doc_id long, ord int, side string, cells map<string,string>")).first()
    assert (r.matched, r.missing, r.extra) == (1, 1, 1)


def test_empty_batch_is_completed(spark):
    items = spark.createDataFrame([("b", None, None)], "batch_id string, submission_id string, status string")
    assert jobs.batch_status(items).first()["status"] == "completed"


def test_replay_changes_nothing(spark):
    rows = spark.createDataFrame([(1, "k", 1), (2, "k", 2), (3, None, 3)], "id int, key string, at int")
    once = jobs.dedupe_first(rows, "key", "at", "id")
    again = jobs.dedupe_first(once.union(once), "key", "at", "id")
    assert sorted(r.id for r in once.collect()) == [1, 3]
    assert sorted(set(r.id for r in again.collect())) == [1, 3]


def test_store_and_metrics(spark, tmp_path):
    from docloom.sources import files

    (tmp_path / "s.json").write_text('{"batches": [{"id": "a", "n": 1}], "other": []}')
    assert [tuple(r) for r in files.json_store(spark, str(tmp_path / "s.json"), "batches", "id string, n int").collect()] == [("a", 1)]
    assert files.json_store(spark, str(tmp_path / "s.json"), "missing", "id string").count() == 0
    pages = files.text_pages(spark.createDataFrame([(1, "a\f \fb"), (2, "c")], "doc_id long, text string"))
    assert sorted((r.doc_id, r.page, r.text) for r in pages.collect()) == [(1, 0, "a"), (1, 1, "b"), (2, 0, "c")]


def test_stream_drops_what_comes_again(spark, tmp_path):
    from docloom.streaming import ledger

    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    events = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = ledger.deduped(events, late="60 days").writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("seen").count() == 1000


TD1 = "front\nINCHL1234567890<<<<<<<<<<<<<<<\n8001014M3001019CHL12345678<5<<4\nPEREZ<SOTO<<ANA<MARIA<<<<<<<<<\n"
TD3 = "x\nP<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<\nL898902C36UTO7408122F1204159ZE184226B<<<<<10\n"


@pytest.mark.parametrize("page, first", [(TD1, "ANA MARIA"), (TD1.replace("\n", " "), None)])
def test_identity_zone(spark, page, first):
    """In a text without breaks the fillers of the first line are the first shape of a third."""
    r = one(spark, mrz.parse_td1(F.lit(page)))
    assert (r.first_names, r.issuing_country, r.run, r.birth_date, r.sex) == (first, "CL", "12.345.678-5", "1980-01-01", "M")


@pytest.mark.parametrize("names, holder", [("IBCDE<<LUIS", "LUIS IBCDE"), ("AVILA<SOTO<<ANA", "ANA AVILA SOTO")])
def test_names_like_a_document_code(spark, names, holder):
    """only a first line has a document code to mend; a surname of its shape stays whole."""
    page = "\n".join(["INCHL1234567890<<<<<<<<<<<<<<<", "8001014M3001019CHL12345678<5<<4", names.ljust(30, "<")])
    r = one(spark, mrz.parse_td1(F.lit(page)))
    assert (r.holder_name, r.issuing_country) == (holder, "CL") and r.mrz.startswith("I<CHL")
    assert one(spark, mrz.parse_td1_fragments(F.lit("x\n" + names.ljust(20, "<")))).holder_name == holder


@pytest.mark.parametrize("page", [TD3, TD3.replace("\n", " ")])
def test_passport_zone(spark, page):
    r = one(spark, mrz.parse_td3(F.lit(page)))
    assert (r.holder_name, r.document_number, r.birth_date, r.nationality) == ("ANNA MARIA ERIKSSON", "L898902C3", "1974-08-12", "UTO")


@pytest.mark.parametrize("page", [None, "", "no zone\nhere"])
def test_no_zone(spark, page):
    page = F.lit(page).cast("string")
    assert set(one(spark, mrz.parse_td1(page))) == {None}
    assert set(one(spark, mrz.parse_td3(page))) == {None}


def test_century(spark):
    assert [one(spark, dates.mrz_date(F.lit(v))) for v in ("391231", "400101", "4001")] == ["2039-12-31", "1940-01-01", None]


def test_names_in_one_word(spark):
    given, rest = text.split_given_name(F.lit("MariaPerez"), ["MAR", "MARIA"])
    assert (one(spark, given), one(spark, rest)) == ("MARIA", "PEREZ")
    given, rest = text.split_given_name(F.lit("Mariape"), ["MAR", "MARIA"])
    assert (one(spark, given), one(spark, rest)) == ("MAR", "IAPE")
    assert one(spark, text.split_surnames(F.lit("PerezSotoXy"), ["PEREZ", "SOTO"])) == ["PEREZ", "SOTO", "XY"]
    assert one(spark, text.split_surnames(F.lit(""), ["PEREZ"])) == []


def test_keywords(spark):
    assert one(spark, binding.keywords(F.lit("account_run"), F.lit("Numero de la cuenta"))) == ["capitalizacion", "rut", "account", "run", "numero", "cuenta"]
    assert one(spark, binding.keywords(F.lit("x"), F.lit(None).cast("string"))) == []


def test_custom_fields(spark):
    kinds = "document_id long, text string, family string, supported boolean, known array<struct<label:string,value:string>>, pairs array<struct<label:string,value:string>>"
    docs = spark.createDataFrame([(1, "el 03/04/2024 por 1.234,5", "x", False, [("Cuenta numero", "77")], [("Fecha pago", "2024-01-02")]), (2, None, "y", True, None, None)], kinds)
    schema = {"cuenta": {"type": "number"}, "fecha_pago": {"type": "date"}, "dia": {"type": "date"}}
    got = {(r.document_id, r.field): (r.value, r.confidence) for r in binding.custom_fields(docs, schema).collect()}
    assert got[1, "cuenta"] == ("77", 0.82) and got[1, "fecha_pago"] == ("2024-01-02", 0.88) and got[1, "dia"] == ("2024-04-03", 0.56)
    assert {got[2, f] for f in schema} == {(None, 0.12)}
    assert binding.custom_fields(docs, {}).count() == 0


def test_new_tenants_once(spark):
    asked = spark.createDataFrame([(1, "new"), (2, "new "), (3, None)], "request_id long, tenant string")
    ids, made = binding.resolve_tenants(asked, spark.createDataFrame([("t0", "default-workspace")], "id string, slug string"))
    assert [r.slug for r in made.collect()] == ["new"]
    assert {r.request_id: r.tenant_id for r in ids.collect()} == {1: made.first().id, 2: made.first().id, 3: "t0"}


def test_confidence_reasons(spark):
    got = scores.confidence_reasons(F.lit(0.5), F.lit(None).cast("double"), F.lit(0.875), F.lit(None).cast("double"), F.lit(0.0))
    assert one(spark, got) == ["quality=0.50", "consensus=0.88"]


def test_missing_values(spark):
    says = lambda f, *a: [one(spark, f(F.lit(v).cast("string"), *a)) for v in (None, " pending ", "nombre por confirmar", "sin dato", "x")]
    assert says(text.is_missing) == [True, True, False, False, False]
    assert says(text.is_missing, text.MISSING_IN_RULES) == [True, True, True, False, False]
    assert says(text.is_missing_in_pages) == [True, False, True, True, False]


def test_pages_of_a_document(spark):
    """The front of an identity stands for it; a page that says little is taken with what the surest one says; both sides make one."""
    from docloom.operators import pages

    front, back = "REPUBLICA DE CHILE CEDULA DE IDENTIDAD RUN NOMBRES APELLIDOS REGISTRO CIVIL E IDENTIFICACION", "NACIO EN DOMICILIO COMUNA PROFESION CIRCUNSCRIPCION HUELLA INCHL"
    rows = [(1, 1, back), (1, 2, front), (2, 1, "FACTURA"), (2, 2, " \n"), (3, 1, "PASAPORTE PASSPORT"), (3, 2, "algo"), (4, 1, None)]
    got = {r.doc_id: r for r in pages.analyze(spark.createDataFrame(rows, "doc_id long, page int, text string"), F.lit("auto"), F.lit("XX")).collect()}
    assert sorted(got) == [1, 2, 3]
    assert (got[1].page, got[1].pack_id, got[1].side, got[1].both_sides, got[1].pages) == (2, "identity-cl-front", "front+back", True, 2)
    assert (got[2].pages, got[2].pack_id, got[2].supported, got[2].both_sides) == (1, "invoice-generic", False, False)
    assert (got[3].page, got[3].pack_id, got[3].pages) == (1, "passport-generic", 2)


def test_base_packs(spark):
    from docloom.functions.packs import base_pack

    assert [one(spark, base_pack(F.lit(x).cast("string"))) for x in ("identity-cl-front", "identity-cl-front-back", "x", "", None)] == ["identity-cl", "identity-cl-front", "x", None, None]


def test_files_and_rules(spark, tmp_path):
    from docloom.sources import files

    for name in ("a.PDF", "b.txt", "_skip.pdf", "sub/c.png"):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text("x")
    got = files.files(spark, str(tmp_path / "in"), suffixes=(".pdf", ".png"), without="_skip")
    assert [r.path.rsplit("/", 1)[1] for r in got.collect()] == ["a.PDF", "c.png"]
    assert files.files(spark, str(tmp_path / "in"), limit=1).count() == 1
    registry = spark.createDataFrame([("demo", None, 0), ("demo", "/m.jsonl", 1)], "name string, manifest string, place int")
    assert files.manifest_path(spark, "demo", registry) == "/m.jsonl" and files.manifest_path(spark, str(tmp_path), registry) == str(tmp_path)
    with pytest.raises(FileNotFoundError):
        files.manifest_path(spark, "other", registry)
    rules = lambda text: [tuple(r) for r in files.rule_table(spark, text, "family string, auto double", default=[{"family": "d"}]).orderBy("priority").collect()]
    assert rules('{"rules": [{"family": "a", "auto": 0.9}, {"auto": 0.5}]}') == [(0, "a", 0.9), (1, None, 0.5)]
    assert rules("{broken") == rules(None) == rules("[1]") == rules('{"rules": 3}') == [(0, "d", None)]
    (tmp_path / "audit.json").write_text('[{"id": "1", "action": "a.b", "payload": {"x": [1]}, "createdAt": "2024-01-02T03:04:05Z"}, {"id": "2"}]')
    log = files.audit_log(spark, str(tmp_path / "audit.json")).orderBy("id").collect()
    assert log[0].payload == '{"x": [1]}' or log[0].payload == '{"x":[1]}'
    assert str(log[0].created_at) == "2024-01-02 03:04:05" and log[1].action is None


def test_manifest_and_exports(spark, tmp_path):
    from docloom.sources import files

    (tmp_path / "m.jsonl").write_text('{"filename": "a", "split": "test", "expected_fields": {"x": "1"}}\n\n{"filename": "b"}\n')
    rows = files.manifest(spark, str(tmp_path / "m.jsonl")).orderBy("filename").collect()
    assert [(r.filename, r.split, r.expected_fields) for r in rows] == [("a", "test", {"x": "1"}), ("b", None, None)]
    out = spark.createDataFrame([("f", ["a", "b"], 'q"x'), ("g", None, "p,q")], "file string, issue_types array<string>, note string").coalesce(1)
    files.write_csv(out, str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "csv").glob("part*")))
    assert text == 'file,issue_types,note\nf,a|b,"q""x"\ng,,"p,q"\n'
    files.write_jsonl(out, str(tmp_path / "jsonl"))
    assert "".join(p.read_text() for p in (tmp_path / "jsonl").glob("part*")).splitlines()[1] == '{"file":"g","issue_types":null,"note":"p,q"}'
    files.write_lines(spark.createDataFrame([(2, "b"), (1, "a")], "place int, line string"), str(tmp_path / "lines"), "place")
    assert "".join(p.read_text() for p in (tmp_path / "lines").glob("part*")) == "a\nb\n"
    files.append_snapshot(spark.createDataFrame([(1, "x")], "n int, s string"), str(tmp_path / "snap"), "cost.day", "2024-01-01 00:00:00")
    files.append_snapshot(spark.createDataFrame([(2, None)], "n int, s string"), str(tmp_path / "snap"), "cost.day", "2024-01-02 00:00:00")
    back = spark.read.parquet(str(tmp_path / "snap")).orderBy("created_at").collect()
    assert [(r.action, r.payload) for r in back] == [("cost.day", '{"n":1,"s":"x"}'), ("cost.day", '{"n":2}')]


def test_certificate_rows(spark):
    page = [
        "Certificado", "ENE-2023 1.234.567 123.456 ABC", "Empresa Uno Ltda", "RUT 76.123.456-7 2023-02-10", "otra linea", "FEB/2023 $0 $0 PERIODO SIN", "cotización", "SEP-2023 1.000 Pan y Sal 12345678-5 05/10/2023", "03/11/2023", "Cordialmente", "lost", "DIC-2023 9.999.999",
    ]
    lines = spark.createDataFrame([(1, k, x) for k, x in enumerate(page)] + [(2, 0, "nothing")], "doc_id long, line_no int, line string")
    got = [tuple(r)[1:-1] for r in sequences.period_rows(lines).orderBy("row").collect()]
    assert got == [
        (1, "2023-01", "ENE-2023", "2023-02-10", "123.456", "1.234.567", "123.456", "ABC", "Empresa Uno Ltda", "76.123.456-7"),
        (2, "2023-02", "FEB/2023", None, "0", "0", "0", "PERIODO SIN cotización", None, None),
        (3, "2023-09", "SEP-2023", "2023-10-05", "1.000", "1.000", None, None, "PAN Y SAL", "12.345.678-5"),
        (4, "2023-12", "DIC-2023", None, "9.999.999", "9.999.999", None, None, None, None),
    ]
    assert sequences.period_rows(lines).where("row = 2").first().detail == "FEB/2023 $0 $0 PERIODO SIN cotización"


def test_neighbours(spark):
    lines = spark.createDataFrame([(1, k, x) for k, x in enumerate(["2024-01 a", "b", "TOTAL 3", "c", "2024-02 d", "2024-03 e", "f"])], "doc_id long, line_no int, line string")
    labels = spark.createDataFrame([(1, 3), (1, 6), (2, 0)], "doc_id long, line_no int")
    near = sequences.nearby(lines.where("line_no not in (2, 4)"), labels, 2)
    assert sorted((r.label_no, r.value) for r in near.collect()) == [(3, "2024-03 e"), (6, "2024-03 e")]


def test_work_cycles(spark, tmp_path):
    """A micro-batch goes whole to the handler."""
    from docloom.streaming import ledger

    spark.range(7).selectExpr("id AS job_id").write.parquet(str(tmp_path / "in"))
    seen = []
    jobs_ = spark.readStream.schema("job_id long").parquet(str(tmp_path / "in"))
    q = ledger.work_cycles(jobs_, lambda df, n: seen.append(sorted(r.job_id for r in df.collect())), str(tmp_path / "c"), "0 seconds")
    q.processAllAvailable()
    q.stop()
    assert seen == [list(range(7))]


def test_evaluation_of_nothing_and_as_json(spark):
    import json

    from docloom.operators import insights

    kinds = "family string, decision string, global_confidence double, exact_match_rate double, table_match_rate double"
    none = insights.evaluation_headline(spark.createDataFrame([], kinds)).first()
    assert tuple(none) == (0, 0, 0, 0, 0, 0, 0, 0)
    rows = spark.createDataFrame([("a", "reject", 0.5, 0.25, None), (None, "auto_accept", 1.0, 1.0, 0.5)], kinds)
    got = json.loads(insights.evaluation_json(rows, "family", "decision").first().summary)
    assert got["documents"] == 2 and got["confidence_exact_gap"] == 0.125 and [x["bucket"] for x in got["groups"]["by_family"]] == ["a", "unknown"]


def test_records_and_rows(spark):
    from docloom.operators import documents

    rows = spark.createDataFrame([(1, None, None, "x")], "document_id long, issue_ids array<string>, extra map<string,string>, page2_text string")
    record = documents.to_record(rows)
    assert record.columns == ["documentId", "issueIds", "extra", "page2Text"] and tuple(record.first()) == (1, [], {}, "x")
    assert documents.to_row(record).columns == rows.columns
    filled = documents.with_defaults(rows, status="uploaded", issue_ids=F.array(F.lit("a")), document_id=0).first()
    assert (filled.status, filled.issue_ids, filled.document_id) == ("uploaded", ["a"], 1)


RECORD = "document_id long, filename string, holder_name string, issuer string, fields array<struct<field_name:string,normalized:string,raw:string,evidence:string>>, sessions array<struct<status:string,edits:array<struct<field_name:string,previous:string,new:string>>>>, runs array<struct<engine:string,text:string,tokens:array<string>>>"


def test_payloads(spark):
    import json

    from docloom.operators import documents

    rows = [(1, "f.pdf", "Ana Perez", None, [("Run", "12.345 678-5", None, ""), ("nombre", "Ana  P", "x", "y"), ("otro", "z", None, None)], [("open", [("rut", "123", "12345678")])], [("e", "secret", ["t"])])]
    docs = spark.createDataFrame(rows, RECORD)
    shown = json.loads(documents.canonical_payload(docs, "2024-01-01").first().payload)
    assert shown["id"] == 1 and shown["holder_name"] == "Ana Perez" and shown["issuer"] is None and shown["fields"][0]["normalized"] == "12.345 678-5"
    hidden = json.loads(documents.canonical_payload(docs, "2024-01-01", redact=True).first().payload)
    assert hidden["holder_name"] == "A*** P***" and [f["normalized"] for f in hidden["fields"]] == ["12*******-5", "A*** P***", "z"]
    assert hidden["fields"][0]["evidence"] == "" and hidden["fields"][1]["raw"] == "x***" and hidden["sessions"][0]["edits"][0] == {"field_name": "rut", "previous": "***", "new": "12****78"}
    run = documents.redact_record(docs).first().runs[0]
    assert (run.text, run.tokens) == ("[REDACTED]", [])


def test_matches_by_form(spark):
    """no document's values are held against its tokens, or fields against its pairs, one by one."""
    tokens = spark.createDataFrame([("d", 1, "xx ABCD", 0.5), ("d", 2, "abcd-9", 0.9), ("d", 3, "ABCDEF", 0.9), ("d", 4, "abc", 1.0), ("d", 5, "Éwxyz", None), ("e", 6, "abcd", 1.0), ("d", 7, "ABCDEF", 0.9)], "document_id string, ord int, text string, confidence double")
    values = spark.createDataFrame([("d", "part", "a.bcd"), ("d", "whole", "0xxabcd0"), ("d", "same", "abcdef"), ("d", "none", "zzzzz"), ("d", "short", "abc"), ("d", "mark", "ewxy"), (None, "lost", "abcd")], "document_id string, field string, value string")
    matched = binding.match_tokens(values, tokens)
    assert {r.field: r.ord for r in matched.collect()} == {"part": 3, "whole": 1, "same": 3, "none": None, "short": None, "mark": 5, "lost": None}
    pairs = spark.createDataFrame([("d", 1, "Numero de", "77"), ("d", 2, "Numero", "12"), ("d", 3, "", "x"), ("d", 4, "Otro", "y12y"), ("e", 5, "Total", None)], "document_id string, ord int, label string, value string")
    fields = spark.createDataFrame(
        [("d", "a", "NUMERO", "1"), ("d", "numero", "q", "12"), ("d", "b", "numero de serie", "x9"), ("e", "total", "Suma", "5"), ("e", "c", "zz", "5"), ("d", "o", "o-t-r-o", "12"), (None, "n", "Numero", "1")],
        "document_id string, field string, label string, value string",
    )
    paired = binding.match_pairs(fields, pairs)
    assert {r.field: (r.tier, r.ord) for r in paired.collect()} == {"a": (0, 2), "numero": (0, 2), "b": (1, 1), "total": (0, 5), "c": (None, None), "o": (1, 3), "n": (None, None)}
    for df in (matched, paired):
        joins = [x for x in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join Inner" in x]
        assert joins and not any("Contains(" in x for x in joins)
