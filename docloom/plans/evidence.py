"""Queries over candidates, evidence scores, dates in texts and picture variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import evidence as E
from ..functions.text import let
from ..operators import candidates as C
from ..operators import pages as G
from ..sources.files import golden_fields
from .registry import load, query, spread

# a document's four runs find its field in one of six ways each; run 1 has a value of its own besides
_WAY = "(k * 31 + r * 17) % 6"


def _runs(spark, d):
    k, r = F.col("document_id"), F.col("ord")
    rows = load(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("ord"))
    way, digit, other = (k * 31 + r * 17) % 6, (k % 7).cast("string"), (k % 3).cast("string")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    token = lambda t, c: F.struct(t.alias("text"), F.lit(c).alias("confidence"), F.lit(2).alias("page"))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    tokens = F.when(way == 0, F.array(token(F.lit("no"), 0.99), token(text("abcd ", digit, "00"), 0.9))).when(way == 1, F.array(token(text("x-ABCD", digit, "00y"), 0.8), token(F.lit("ABCD"), 0.7))).otherwise(none("struct<text:string,confidence:double,page:int>"))
    pair = lambda label, v: F.array(F.struct(F.lit(label).alias("label"), v.alias("value"), F.lit(1).alias("page"), F.lit("line").alias("raw_line")))
    pairs = F.when(way == 2, pair("TOTAL a pagar", text("ABCD", digit, "00"))).when(way == 3, pair("Total", text("other", other))).otherwise(none("struct<label:string,value:string,page:int,raw_line:string>"))
    pages = F.when(way == 4, F.array(F.struct(F.lit(1).alias("page"), F.lit("nothing").alias("text")), F.struct(F.lit(3).alias("page"), text("es ab cd ", digit, "-00 .").alias("text")))).otherwise(none("struct<page:int,text:string>"))
    entry = lambda v: F.create_map(F.lit("monto"), v)
    values = F.when(way == 5, entry(text("ZZ", other))).when(r == 1, entry(F.lit("HH"))).otherwise(F.create_map().cast("map<string,string>"))
    return rows.select(
        "document_id", "ord", text("s", r.cast("string")).alias("source"), text("e", (r % 2).cast("string")).alias("engine"), ((k + r) % 5 > 0).alias("success"), F.when(r < 3, 0.5 + r / 10).alias("average_confidence"), F.lit("CL").alias("country"),
        F.lit(None).cast("string").alias("holder_name"), values.alias("values"), tokens.alias("tokens"), pairs.alias("pairs"), pages.alias("pages"),
    )


_FOUND = f"""o AS (SELECT o_orderkey AS k, r, {_WAY} AS way, CASE WHEN r < 3 THEN 0.5 + r / 10.0 END AS av, 'abcd' || (o_orderkey % 7) || '00' AS v FROM (SELECT o_orderkey, unnest([0, 1, 2, 3]) AS r, o_orderkey AS k FROM orders) WHERE (o_orderkey + r) % 5 > 0),
c AS (SELECT k, r, 0 AS n, CASE way WHEN 0 THEN 'abcd ' || (k % 7) || '00' WHEN 1 THEN 'x-ABCD' || (k % 7) || '00y' WHEN 2 THEN 'ABCD' || (k % 7) || '00' WHEN 3 THEN 'other' || (k % 3) WHEN 4 THEN 'ABCD-' || (k % 7) || '00' ELSE 'ZZ' || (k % 3) END AS value, CASE way WHEN 0 THEN 0.9 WHEN 1 THEN 0.8 ELSE av END AS conf, CASE way WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 4 THEN 3 ELSE 1 END AS page,
 CASE WHEN way < 2 THEN 'token' WHEN way < 4 THEN 'layout-pair' WHEN way = 4 THEN 'page-text' ELSE 'run-heuristic' END AS kind, v FROM o UNION ALL SELECT k, r, 1, 'HH', av, 1, 'run-heuristic', v FROM o WHERE r = 1 AND way <> 5),
s AS (SELECT *, regexp_replace(lower(value), '[^a-z0-9]', '', 'g') AS key FROM c),
t AS (SELECT *, key = v AS selected, round(least(1, 0.12 + CASE WHEN key = v THEN 0.55 WHEN contains(key, v) OR contains(v, key) THEN 0.36 ELSE 0.18 END + coalesce(conf, 0) * 0.2 + CASE kind WHEN 'layout-pair' THEN 0.08 WHEN 'page-text' THEN 0.04 WHEN 'run-heuristic' THEN 0.1 ELSE 0 END), 3) AS score FROM s)"""


@query(f"WITH {_FOUND} SELECT k AS document_id, 'monto' AS field, CAST(row_number() OVER (PARTITION BY k ORDER BY selected DESC, score DESC, coalesce(conf, 0) DESC, r, n) AS INT) AS rank, 's' || r AS source, 'e' || (r % 2) AS engine, value, CAST(page AS INT) AS page, kind AS match_type, selected, score::DOUBLE AS score, conf::DOUBLE AS confidence FROM t")
def field_candidates(spark, d):
    k = F.col("o_orderkey")
    fields = spread(load(spark, d, "orders").select("o_orderkey")).select(k.alias("document_id"), F.lit("monto").alias("field"), F.lit("Total a pagar").alias("label"), F.concat(F.lit("ABCD-"), (k % 7).cast("string"), F.lit("00")).alias("value"))
    return C.field_candidates(fields, _runs(spark, d)).drop("raw_text")


# evidence scores over flags: a value is there, or stands for a missing one

_BITS = ("ho", "nu", "bi", "iu", "ex", "se", "mz", "fi", "la", "ac")
_FLAGS = ", ".join(f"(o_orderkey * 11 // {2 ** n}) % 2 = 1 AS {b}" for n, b in enumerate(_BITS))
_SEQ = "CASE WHEN bi AND iu AND o % 3 = 0 THEN false WHEN NOT (bi OR iu OR ex) THEN false ELSE true END"
_I = lambda c: f"CAST({c} AS INT)"


@query(f"""WITH f AS (SELECT o_orderkey AS o, {_FLAGS} FROM orders), x AS (SELECT *, o % 4 AS n, {_SEQ} AS seq, CASE WHEN o % 2 = 0 THEN 'CL' ELSE 'PE' END AS c, o % 5 < 3 AS front, o % 5 > 1 AS back FROM f),
y AS (SELECT *, {_I('ho')} + {_I('nu')} + {_I('bi')} + CASE WHEN c = 'CL' AND front THEN {_I('ac')} + {_I('ex')} + {_I('se')} ELSE 0 END + CASE WHEN c = 'CL' AND back THEN {_I('ac')} + {_I('mz')} ELSE 0 END AS got, 3 + CASE WHEN c = 'CL' AND front THEN 2 + {_I('se')} ELSE 0 END + CASE WHEN c = 'CL' AND back THEN 2 ELSE 0 END AS asked FROM x)
SELECT o AS id, round(greatest(0.05, least(0.99, greatest(0.5, 0.34 + 0.08 * {_I('ho')} + 0.07 * {_I('fi')} + 0.07 * {_I('la')} + 0.05 * {_I('nu')} + 0.04 * {_I('iu')} + 0.05 * {_I('ac')} + least(0.08, 0.03 * n) + least(0.06, 0.02 * n) + least(0.08, 0.02 * n) + CASE WHEN n > 0 THEN least(0.14, 0.08 + 0.01 * n) ELSE 0 END))), 3)::DOUBLE AS certificate,
 round(greatest(0.05, least(0.99, 0.34 + 0.26 * got / asked + 0.1 * ({_I('bi')} + {_I('iu')} + {_I('ex')}) / 3 + CASE WHEN fi AND la THEN 0.06 WHEN ho THEN 0.04 ELSE 0 END + CASE WHEN c = 'CL' AND ac THEN 0.1 ELSE 0 END + CASE WHEN mz THEN 0.05 WHEN back THEN -0.02 ELSE 0 END + CASE WHEN seq THEN 0.03 ELSE 0 END + CASE WHEN c = 'PE' AND nu THEN 0.03 ELSE 0 END + CASE WHEN n > 0 THEN least(CASE WHEN back THEN 0.06 ELSE 0.04 END, 0.02 * n) ELSE 0 END)), 3)::DOUBLE AS identity,
 round(greatest(0.05, least(0.99, 0.36 + 0.28 * ({_I('ho')} + {_I('nu')} + {_I('bi')} + {_I('ex')}) / 4 + 0.04 * {_I('iu')} + 0.03 * {_I('fi')} + 0.02 * {_I('se')} + 0.02 * {_I('la')} + 0.08 * {_I('mz')} + 0.1 * {_I('ac')} + CASE WHEN seq THEN 0.03 ELSE 0 END)), 3)::DOUBLE AS passport,
 round(greatest(0.05, least(0.99, 0.38 + 0.27 * ({_I('ho')} + {_I('nu')} + {_I('ex')}) / 3 + 0.1 * ({_I('bi')} + {_I('iu')} + {_I('ex')}) / 3 + 0.03 * {_I('fi')} + 0.03 * {_I('la')} + 0.03 * {_I('mz')} + 0.02 * {_I('se')} + CASE WHEN c = 'CL' AND nu THEN 0.08 WHEN nu THEN 0.03 ELSE 0 END + CASE WHEN seq THEN 0.03 ELSE 0 END)), 3)::DOUBLE AS license FROM y""")
def evidence_scores(spark, d):
    o = F.col("o_orderkey")
    bit = {b: F.floor(o * 11 / 2**n) % 2 == 1 for n, b in enumerate(_BITS)}
    some = lambda b, v="x": F.when(bit[b], v).otherwise("no detectado")
    birth, issued, expiry = F.when(bit["bi"], F.when(o % 3 == 0, "2021-01-01").otherwise("1990-01-01")), F.when(bit["iu"], "2020-01-01"), F.when(bit["ex"], "2030-01-01")
    n, c, run = o % 4, F.when(o % 2 == 0, "CL").otherwise("PE"), some("ac", "12.345.678-5")
    rows = spread(load(spark, d, "orders").select("o_orderkey"))
    return rows.select(
        o.alias("id"), E.certificate_confidence(F.lit(0.5), some("ho"), some("fi"), some("la"), some("nu"), some("iu"), some("ac"), n, n, n, n).alias("certificate"),
        E.identity_confidence(c, some("ho"), some("nu"), run, some("fi"), some("la"), birth, issued, expiry, some("se"), some("mz"), n, o % 5 < 3, o % 5 > 1).alias("identity"),
        E.passport_confidence(some("ho"), some("nu"), birth, issued, expiry, some("fi"), some("se"), some("la"), some("mz"), bit["ac"]).alias("passport"),
        E.license_confidence(c, some("ho"), some("nu", "12.345.678-5"), birth, issued, expiry, some("fi"), some("la"), some("mz"), some("se")).alias("license"),
    )


@query("""WITH x AS (SELECT o_orderkey AS k, 0.3 + o_orderkey % 60 / 100.0 AS conf, o_orderkey % 4 AS n, least(o_orderkey % 3, o_orderkey % 4) AS got, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 0.97 WHEN 2 THEN 0.9 ELSE 0.7 END AS lo, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 3 THEN 0.76 ELSE 0.72 END AS av, CASE o_orderkey % 7 WHEN 0 THEN 0 WHEN 1 THEN 0.9 WHEN 2 THEN 0.75 WHEN 3 THEN 0.4 ELSE 0.6 END AS q, least(o_orderkey % 2 * 3, o_orderkey % 4) AS st FROM orders)
SELECT k AS id, round(greatest(0.05, least(0.99, CASE WHEN n > 0 THEN greatest(conf, 0.4 + 0.32 * got / n) ELSE conf END + CASE WHEN lo >= 0.95 THEN 0.05 WHEN lo >= 0.85 THEN 0.03 WHEN av >= 0.75 THEN 0.015 ELSE 0 END + CASE WHEN q >= 0.82 THEN 0.03 WHEN q >= 0.72 THEN 0.015 WHEN q <> 0 AND q < 0.45 THEN -0.02 ELSE 0 END + CASE WHEN n > 0 AND st = n THEN 0.03 ELSE 0 END + CASE WHEN k % 6 = 0 THEN 0.06 ELSE 0 END + CASE WHEN k % 8 = 0 THEN 0.08 ELSE 0 END + CASE WHEN k % 9 = 0 THEN 0.03 ELSE 0 END)), 3)::DOUBLE AS confidence FROM x""")
def recalibration(spark, d):
    k = F.col("o_orderkey")
    least = F.when(k % 5 == 1, 0.97).when(k % 5 == 2, 0.9).when(k % 5 > 2, 0.7)
    mean = F.when(k % 5 == 3, 0.76).when(k % 5 > 0, 0.72)
    quality = F.when(k % 7 == 0, 0.0).when(k % 7 == 1, 0.9).when(k % 7 == 2, 0.75).when(k % 7 == 3, 0.4).otherwise(0.6)
    c = E.recalibrated(0.3 + k % 60 / 100, k % 4, F.least(k % 3, k % 4), least, mean, quality, F.least(k % 2 * 3, k % 4), k % 6 == 0, k % 8 == 0, F.when(k % 9 == 0, True))
    return load(spark, d, "orders").select(k.alias("id"), c.alias("confidence"))


@query("""WITH x AS (SELECT o_orderkey AS k, o_orderdate AS a, o_orderdate + to_days(400) AS b, o_orderdate + to_days(4000) AS c FROM orders), t AS (SELECT k, list_distinct([strftime(c, '%Y-%m-%d'), strftime(a, '%Y-%m-%d'), strftime(b, '%Y-%m-%d')]) AS s, strftime(a, '%Y-%m-%d') AS a, strftime(b, '%Y-%m-%d') AS b, strftime(c, '%Y-%m-%d') AS c FROM x)
SELECT k AS id, CASE k % 3 WHEN 0 THEN c || ',' || b || ',' || a WHEN 1 THEN b || ',' || a ELSE a END AS dates, a AS birth, CASE k % 3 WHEN 0 THEN b END AS issued, CASE k % 3 WHEN 0 THEN c WHEN 1 THEN b END AS expiry,
 CASE k % 5 WHEN 0 THEN 'CHILENA' WHEN 1 THEN 'COLOMBIANA' WHEN 2 THEN 'PERUANA' WHEN 3 THEN 'USA' END AS nationality, CASE WHEN k % 2 = 0 THEN 'original,deglare' ELSE 'original,aggressive_rescue' END AS variants FROM t""")
def dates_in_text(spark, d):
    k, a = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    b, c = F.date_add(a, 400), F.date_add(a, 4000)
    # the long form comes last whatever its place, the ISO form first
    words = F.element_at(F.array(*map(F.lit, ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"))), F.month(a))
    long_ = F.concat(F.date_format(a, "d"), F.lit(" de "), words, F.lit(" de "), F.date_format(a, "yyyy"))
    text = F.concat(F.lit("el "), long_, F.when(k % 3 < 2, F.concat(F.lit(", "), F.date_format(b, "dd/MM/yyyy"), F.lit(" y "), F.date_format(b, "dd-MM-yyyy"))).otherwise(""), F.when(k % 3 == 0, F.concat(F.lit(" o "), F.date_format(c, "yyyy/MM/dd"))).otherwise(""))
    code = F.when(k % 5 == 0, "chl").when(k % 5 == 1, "??").when(k % 5 == 2, "PER").when(k % 5 == 3, " usa ")
    country = F.when(k % 5 == 3, "US").otherwise("CO")
    variants = F.transform(F.array(*map(F.lit, ("sharpen", "aggressive_rescue", "deglare", "original", "unknown"))), lambda p: F.struct(p.alias("profile"), F.when((p == "deglare") & (k % 2 == 1), 0.6).otherwise(0.9).alias("quality")))
    rows = load(spark, d, "orders").select(k.alias("id"), E.all_dates(text).alias("d"), E.nationality(code, country).alias("nationality"), F.array_join(E.first_variants(variants), ",").alias("variants"))
    none = F.lit(None).cast("string")
    return rows.select("id", F.array_join("d", ",").alias("dates"), E.by_position(F.col("d"), none, none, none).alias("p"), "nationality", "variants").select("id", "dates", "p.*", "nationality", "variants")


_FRONT = ("RUN 12.345.678-5", "12.345.678-5", "A12345678", "nada", "")
_BACK = ("rut 12345678-5 x", "Documento 9.999.999-9", "A12.345.678", "", "nada")
# what each of these says by itself, in order
_FRONT_IDS = (["12345678-5", "RUN12345678-5"], ["12345678-5"], ["A12345678"], ["NADA"], [])
_BACK_IDS = (["12345678-5", "RUT12345678-5X"], ["9.999.999-9", "D99999999"], ["A12345678"], [], ["NADA"])
_ids = lambda lists: "[" + ", ".join("[" + ", ".join(f"'{x}'" for x in r) + "]::VARCHAR[]" for r in lists) + "]"


@query(f"""WITH x AS (SELECT o_orderkey AS id, {_ids(_FRONT_IDS)}[o_orderkey % 5 + 1] AS f, {_ids(_BACK_IDS)}[(o_orderkey // 5) % 5 + 1] AS b FROM orders), s AS (SELECT *, list_filter(f, lambda e: list_contains(b, e))[1] AS shared FROM x)
SELECT id, array_to_string(f, ',') AS fronts, array_to_string(b, ',') AS backs, coalesce(shared, f[1]) AS front, coalesce(shared, b[1]) AS back, CASE WHEN shared IS NOT NULL THEN true WHEN len(f) > 0 AND len(b) > 0 THEN false END AS match FROM s""")
def cross_side(spark, d):
    k = F.col("o_orderkey")
    at = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % 5 + 1).cast("int"))
    rows = load(spark, d, "orders").select(k.alias("id"), G.identifiers(at(_FRONT, k), "CL").alias("f"), G.identifiers(at(_BACK, F.floor(k / 5)), "CL").alias("b"))
    return rows.select("id", F.array_join("f", ",").alias("fronts"), F.array_join("b", ",").alias("backs"), G.sides_agree(F.col("f"), F.col("b")).alias("s")).select("id", "fronts", "backs", "s.*")


@query("""WITH x AS (SELECT o_orderkey AS k FROM orders) SELECT k AS id, CASE k % 4 WHEN 0 THEN 'amount=' || k || ';document_family=' || CASE WHEN k % 3 = 0 THEN 'passport' ELSE 'certificate' END || ';rut=~' WHEN 1 THEN 'birth_date=~;document_family=passport;document_number=P' || k || ';holder_name=Ana Soto;mrz_line_1=L1;sex=F' WHEN 2 THEN 'address=calle 1;birth_date=~;document_family=driver_license;document_number=D' || k || ';holder_name=Luz;mrz_line_1=~;sex=~'
 ELSE 'birth_date=1990-01-01;document_family=identity;document_number=~;holder_name=~;mrz_line_1=~;sex=M' END AS fields FROM x""")
def golden_json(spark, d):
    k, s = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    v = lambda x: F.struct(x.alias("value"))
    listed = F.to_json(F.struct(F.when(k % 3 == 0, "passport").alias("family"), F.struct(s.alias("amount"), F.lit(None).cast("string").alias("rut")).alias("expected_fields")), {"ignoreNullFields": "false"})
    passport = F.to_json(F.struct(F.struct(v(F.concat(F.lit("P"), s)).alias("document_number"), v(F.lit("Ana")).alias("given_names"), v(F.lit("Soto")).alias("surnames"), v(F.lit("F")).alias("sex"), F.struct(F.struct(v(F.lit("L1")).alias("line_1")).alias("fields")).alias("mrz")).alias("fields")))
    licence = F.to_json(F.struct(F.struct(v(F.concat(F.lit("D"), s)).alias("document_id"), v(F.lit("Luz")).alias("first_name"), F.struct(F.struct(v(F.lit("calle 1")).alias("street")).alias("fields")).alias("address")).alias("fields")))
    card = F.lit('{"fields": {"date_of_birth": {"value": "1990-01-01"}, "sex": {"value": "M"}, "document_id": "no object"}}')
    text = F.when(k % 4 == 0, listed).when(k % 4 == 1, passport).when(k % 4 == 2, licence).otherwise(card)
    rows = spread(load(spark, d, "orders").select("o_orderkey")).select(k.alias("id"), golden_fields(text).alias("f"))
    keys = F.when(F.col("id") % 4 == 0, F.array(*map(F.lit, ("amount", "document_family", "rut")))).when(F.col("id") % 4 == 2, F.array(*map(F.lit, ("address", "birth_date", "document_family", "document_number", "holder_name", "mrz_line_1", "sex")))).otherwise(F.array(*map(F.lit, ("birth_date", "document_family", "document_number", "holder_name", "mrz_line_1", "sex"))))
    # a column that a lambda names is computed for each element, where it is folded into it
    listed = lambda f: F.array_join(F.transform(keys, lambda c: F.concat(c, F.lit("="), F.coalesce(F.try_element_at(f, c), F.lit("~")))), ";")
    return rows.select("id", let(F.col("f"), listed).alias("fields"))
