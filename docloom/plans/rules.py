"""Queries over report sections and rule packs, on documents made so that every rule holds for some and not for others."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.packs import PACKS
from ..operators import rule_packs as R
from ..operators import sections as S
from .registry import load, query, spread

# sections


def _sections(spark, d):
    """Four sections an order: pairs, a table of two columns, one across, and a text."""
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    kind = "array<array<string>>"
    section = lambda id_, title, variant, columns, rows, body: F.struct(F.lit(id_).alias("id"), F.lit(title).alias("title"), F.lit(variant).alias("variant"), columns.cast("array<string>").alias("columns"), rows.cast(kind).alias("rows"), body.cast("string").alias("body"))
    none = F.lit(None)
    pairs = F.array(F.array(F.lit("Número 1"), s(k)), F.array(F.lit("Titular")), F.array(F.lit(" Numero-1 "), F.when(k % 3 == 0, "again").otherwise("")), F.array().cast("array<string>"))
    campo = F.array(F.array(F.when(k % 2 == 0, "Total").otherwise("Monto"), s(k % 7)), F.array(F.lit("Titular"), F.lit("Ana")))
    cross = F.array(F.array(F.lit("ene"), s(k % 5), F.lit("x")), F.array(F.lit("feb"), s(k % 4)))
    return spread(load(spark, d, "orders").select("o_orderkey")).select(k.alias("document_id"), F.array(
        section("debug-a", "A", "pairs", none, pairs, none), section("b", "B", "table", F.array(F.lit("CAMPO"), F.lit("Valor")), campo, none),
        section("c", "C", "table", F.array(F.lit("Mes"), F.lit("Renta"), F.lit("Nota")), cross, none), section("d", "Notas finales", "text", none, none, F.when(k % 4 > 0, F.concat(F.lit("n"), s(k % 4))).otherwise("")),
    ).alias("sections"))


_SUM = "CASE WHEN k % 2 = 0 THEN 'Total' ELSE 'Monto' END"
_FLAT = {
    "rules": "'numero-1=' || CASE WHEN k % 3 = 0 THEN 'again' ELSE '' END || ';titular=Ana;' || lower({s}) || '=' || (k % 7) || ';c-ene-mes=ene;ene-renta=' || (k % 5) || ';ene-nota=x;c-feb-mes=feb;feb-renta=' || (k % 4) || ';feb-nota=' || CASE WHEN k % 4 > 0 THEN ';notas-finales=n' || (k % 4) ELSE '' END",
    "pipeline": "'numero-1=' || CASE WHEN k % 3 = 0 THEN 'again' ELSE '' END || ';titular=Ana;' || lower({s}) || '=' || (k % 7) || CASE WHEN k % 4 > 0 THEN ';notas-finales=n' || (k % 4) ELSE '' END",
    "integrity": "'número 1=' || k || ';titular=Ana;numero-1=' || CASE WHEN k % 3 = 0 THEN 'again' ELSE '' END || ';' || lower({s}) || '=' || (k % 7)",
    "router": "'Número 1=' || k || ';Titular=Ana; Numero-1 =' || CASE WHEN k % 3 = 0 THEN 'again' ELSE '' END || ';' || {s} || '=' || (k % 7) || CASE WHEN k % 4 > 0 THEN ';Notas finales=n' || (k % 4) ELSE '' END",
}


@query("SELECT k AS document_id, " + ", ".join(f"{sql.format(s=_SUM)} AS {mode}" for mode, sql in _FLAT.items()) + " FROM (SELECT o_orderkey AS k FROM orders)")
def flatten_sections(spark, d):
    shown = lambda mode: F.array_join(F.transform(F.map_entries(S.flatten(F.col("sections"), mode)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias(mode)
    return _sections(spark, d).select("document_id", *map(shown, _FLAT))


@query(f"""WITH o AS (SELECT o_orderkey AS k FROM orders), u AS (SELECT k, unnest([{{'section': 'b', 'label': {_SUM}, 'field_name': lower({_SUM}), 'value': CAST(k % 7 AS VARCHAR)}}, {{'section': 'b', 'label': 'Titular', 'field_name': 'titular', 'value': 'Ana'}}, {{'section': 'c', 'label': 'ene · Renta', 'field_name': 'ene-renta', 'value': CAST(k % 5 AS VARCHAR)}},
 {{'section': 'c', 'label': 'ene · Nota', 'field_name': 'ene-nota', 'value': 'x'}}, {{'section': 'c', 'label': 'feb · Renta', 'field_name': 'feb-renta', 'value': CAST(k % 4 AS VARCHAR)}}, {{'section': 'c', 'label': 'feb · Nota', 'field_name': 'feb-nota', 'value': ''}}] || CASE WHEN k % 4 > 0 THEN [{{'section': 'd', 'label': 'Notas finales', 'field_name': 'notas-finales', 'value': 'n' || (k % 4)}}] ELSE [] END) AS f FROM o)
SELECT k AS document_id, f.section AS section, f.label AS label, f.field_name AS field_name, f.value AS value FROM u""")
def unpivot_sections(spark, d):
    return S.unpivot(_sections(spark, d), ("layout-", "debug-")).drop("place")


_NAMES = ("Ana Perez", "NO DETECTADO", "cédula de identidad", "")


@query(f"""WITH o AS (SELECT o_orderkey AS k, [{", ".join(f"'{n}'" for n in _NAMES)}] AS n FROM orders), x AS (SELECT k, nullif(n[k % 4 + 1], '') AS direct, k % 3 > 0 AS first, k % 5 > 0 AS last, nullif(n[(k // 4) % 4 + 1], '') AS given FROM o)
SELECT k AS document_id, CASE WHEN given = 'Ana Perez' THEN given WHEN direct = 'Ana Perez' THEN direct WHEN first AND last THEN 'Luz Soto' WHEN direct IS NOT NULL THEN direct WHEN given IS NOT NULL THEN given WHEN first THEN 'Luz' WHEN last THEN 'Soto' END AS holder,
 CASE WHEN k % 5 > 0 THEN 'Soto' WHEN k % 3 > 0 THEN 'Luz' END AS found FROM x""")
def holder_names(spark, d):
    k = F.col("o_orderkey")
    at = lambda n: F.element_at(F.array(*map(F.lit, _NAMES)), (n % 4 + 1).cast("int"))
    entries = F.array(F.struct(F.lit("titular").alias("key"), at(k).alias("value")), F.struct(F.lit("Los Nombres").alias("key"), F.when(k % 3 > 0, " Luz:").otherwise("").alias("value")), F.struct(F.lit("surname").alias("key"), F.when(k % 5 > 0, "Soto").otherwise(" - ").alias("value")))
    rows = load(spark, d, "orders").select(k.alias("document_id"), F.map_from_entries(entries).alias("v"), at(F.floor(k / 4)).alias("given"))
    return rows.select("document_id", S.holder_name(F.col("v"), F.col("given")).alias("holder"), S.by_fragments(F.col("v"), ("sur", "NAME"), ("nombres",)).alias("found"))


# rule packs: documents by the digits of their key

_FIELD_ROWS = "(VALUES " + ", ".join(f"('{p.pack_id}', {n}, '{f.key}', {str(f.required).lower()}, {str(f.critical).lower()}, {p.thresholds.review_agreement}, [{', '.join(repr(k.replace('_', '-')) for k in (f.key, *f.aliases))}])" for p in PACKS for n, f in enumerate(p.fields)) + ") pf(pack, n, key, required, critical, review, aliases)"
_PACK_ROWS = "(VALUES " + ", ".join(f"('{p.pack_id}', {p.thresholds.auto_accept}, {p.thresholds.agreement}, {p.thresholds.warning}, {p.min_back_fields}, {sum(f.critical for f in p.fields)})" for p in PACKS) + ") pk(pack, p_auto, p_agreement, p_warning, min_back, n_critical)"

#: Of each digit: its place (divisor and base).
_DIGITS = {"c": (1, 4), "s": (3, 3), "pk": (5, 5), "nu": (2, 4), "ho": (7, 3), "ru": (4, 4), "bi": (6, 3), "iu": (8, 2), "ex": (9, 3), "se": (10, 2), "mz": (11, 2), "ba": (12, 4), "cm": (13, 4), "sg": (14, 5), "old": (15, 4), "pr": (16, 4), "te": (17, 3)}
_SQL_DIGITS = ", ".join(f"(o_orderkey * 7 // {a}) % {b} AS {n}" for n, (a, b) in _DIGITS.items())
_NUMERIC = "CAST(round(0.35 + (o_orderkey * 37 % 65) / 100.0, 2) AS DOUBLE) AS conf, CAST(round(0.5 + (o_orderkey % 50) / 100.0, 2) AS DOUBLE) AS cls"


def _digits(spark, d):
    k = F.col("o_orderkey")
    cols = {n: (F.floor(k * 7 / a) % b).cast("int") for n, (a, b) in _DIGITS.items()}
    return spread(load(spark, d, "orders").select("o_orderkey")).select(k.alias("document_id"), *(c.alias(n) for n, c in cols.items()), F.round(0.35 + (k * 37 % 65) / 100, 2).alias("confidence"), F.round(0.5 + (k % 50) / 100, 2).alias("classification_confidence"))


def _pick(name, *values):
    out = F.lit(values[-1])
    for n in range(len(values) - 1):
        out = F.when(F.col(name) == n, values[n]).otherwise(out)
    return out


def _case(name, *values):
    q = lambda v: "NULL" if v is None else f"'{v}'"
    return f"CASE {name} " + " ".join(f"WHEN {n} THEN {q(v)}" for n, v in enumerate(values[:-1])) + f" ELSE {q(values[-1])} END"


_COUNTRIES, _SIDES, _PROFILES = ("CL", "pe", "CO", "XX"), ("front", "back", "front+back"), ("strict", "balanced", "aggressive", None)
_HOLDERS, _RUNS, _BIRTHS, _EXPIRIES = ("Ana Perez", "NO DETECTADO", None), (None, "12.345.678-5", "12.345.678-9", "12345"), (None, "1990-01-01", "2025-01-01"), (None, "2030-01-01", "2019-01-01")


def _entries(**given):
    """Map of the values that aren't null."""
    rows = F.array(*(F.struct(F.lit(k.replace("_", "-")).alias("key"), v.alias("value")) for k, v in given.items()))
    return F.map_from_entries(F.filter(rows, lambda e: e["value"].isNotNull()))


def _document(rows, family, values, pack_id, **more):
    kind = f"array<{R.ISSUE}>"
    old = F.when(F.col("old") == 1, F.array(F.struct(F.lit("x").alias("id"), F.lit("typo").alias("type"), F.lit("name").alias("field"), F.lit("medium").alias("severity"))))
    old = old.when(F.col("old") == 2, F.array(F.struct(F.lit("rule-identity-missing-sex-front").alias("id"), F.lit("OLD").alias("type"), F.lit("sexo").alias("field"), F.lit("low").alias("severity")))).otherwise(F.array().cast(kind))
    signal = F.struct(F.when(F.col("sg") > 2, 0.9).otherwise(0.45).alias("agreement"), (F.col("sg") % 2 == 1).alias("disagreement"), F.when(F.col("sg") > 0, 2).otherwise(0).alias("candidates"), F.when(F.col("sg") == 4, 2).otherwise(1).alias("engines"))
    base = {
        "family": F.lit(family), "country": _pick("c", *_COUNTRIES), "variant": F.lit(None).cast("string"), "pack_id": pack_id, "holder_name": F.lit(None).cast("string"), "issuer": F.lit(None).cast("string"), "side": F.lit(None).cast("string"), "profile": _pick("pr", *_PROFILES),
        "tenant_id": F.when(F.col("te") == 0, "t"), "values": values, "issues": old, "signals": F.create_map(F.lit("document_number"), signal, F.lit("birth_date"), signal), "identifier_match": F.lit(None).cast("boolean"), "compared": F.lit(False),
    }
    return rows.withColumns(base | more)


def _shown(out):
    return out.select("document_id", "rule_pack_id", "decision", "review_required", F.array_join(F.transform("issues", lambda i: F.concat(i["id"], F.lit(":"), i["severity"])), ",").alias("issues"), "base_confidence", "auto_threshold", "minimum_agreement")


_IDENTITY_PACK = "CASE WHEN pk = 0 AND c < 3 THEN 'identity-' || lower(country) || '-' || replace(side, '+', '-') END"
_STEP = "CASE pr WHEN 0 THEN 0.02 WHEN 2 THEN -0.02 ELSE 0 END"
_SQL_IDENTITY = f"""o AS (SELECT o_orderkey AS id, {_SQL_DIGITS}, {_NUMERIC} FROM orders), a AS (SELECT *, {_case('c', *_COUNTRIES)} AS country, upper({_case('c', *_COUNTRIES)}) AS cc, {_case('s', *_SIDES)} AS side FROM o), b AS (SELECT *, {_IDENTITY_PACK} AS asked FROM a),
r AS (SELECT *, CASE WHEN asked IN ({', '.join(repr(p.pack_id) for p in PACKS)}) THEN asked WHEN c = 3 THEN 'identity-generic' ELSE 'identity-' || lower(cc) || '-front' END AS pack, s <> 1 AS front, s <> 0 AS back, ba > 0 AS b1, ba > 1 AS b2, ba > 2 AS b3 FROM b),
x AS (SELECT *, nu IN (0, 3) AS no_number, ho > 0 AS no_holder, ru = 0 AS no_run, bi = 0 AS no_birth, iu = 0 AS no_issue, ex = 0 AS no_expiry, se = 0 AS no_sex, mz = 0 AS no_mrz, cast(b1 AS INT) + cast(b2 AS INT) + cast(b3 AS INT) AS n_back, s = 2 AS both_sides, cm > 0 AS compared, CASE cm WHEN 1 THEN true WHEN 2 THEN false END AS match,
 cast(bi > 0 AS INT) + cast(iu > 0 AS INT) + cast(ex > 0 AS INT) AS n_dates, CASE WHEN sg > 2 THEN 0.9 ELSE 0.45 END AS ag, sg % 2 = 1 AS torn, sg > 0 AS asked_for, sg = 4 AS two FROM r),
v AS (SELECT *, list_filter([CASE WHEN NOT no_holder THEN 'nombre-completo' END, CASE WHEN NOT no_number THEN 'numero-de-documento' END, CASE WHEN NOT no_run THEN 'run' END, CASE WHEN NOT no_birth THEN 'fecha-de-nacimiento' END, CASE WHEN NOT no_issue THEN 'fecha-de-emision' END, CASE WHEN NOT no_expiry THEN 'fecha-de-vencimiento' END, CASE WHEN NOT no_sex THEN 'sexo' END, CASE WHEN NOT no_mrz THEN 'mrz' END, CASE WHEN b1 THEN 'domicilio' END, CASE WHEN b2 THEN 'estado-civil' END, CASE WHEN b3 THEN 'lugar-de-nacimiento' END], lambda e: e IS NOT NULL) AS has FROM x),
own AS (SELECT id, pf.*, CASE WHEN key IN ('document_number', 'birth_date') THEN torn ELSE false END AS torn_, CASE WHEN key IN ('document_number', 'birth_date') THEN ag ELSE 0 END AS ag_, CASE WHEN key IN ('document_number', 'birth_date') AND asked_for THEN ag END AS counted, CASE WHEN key IN ('document_number', 'birth_date') THEN ag >= 0.67 AND two ELSE false END AS strong, NOT list_has_any(aliases, has) AS gone, both_sides, match, compared FROM v JOIN {_FIELD_ROWS} ON pf.pack = v.pack),
oi AS (SELECT id, string_agg(i, ',' ORDER BY n) AS own_issues, count(*) FILTER (i LIKE '%:high') AS oh, count(*) FILTER (i LIKE '%:medium') AS om, count(*) FILTER (i LIKE '%:medium' AND i LIKE 'rule-pack-d%') AS og, count(*) FILTER (i LIKE '%:high' OR i NOT LIKE 'rule-pack-low%') AS ob FROM (SELECT id, n, CASE WHEN required AND gone THEN 'rule-pack-missing-' || key || CASE WHEN critical THEN ':high' ELSE ':medium' END WHEN NOT gone AND torn_ AND critical THEN 'rule-pack-disagreement-' || key || CASE WHEN ag_ < 0.5 THEN ':high' ELSE ':medium' END WHEN NOT gone AND torn_ AND ag_ < review THEN 'rule-pack-low-agreement-' || key || ':medium' END AS i FROM own) WHERE i IS NOT NULL GROUP BY 1),
oc AS (SELECT id, count(*) FILTER (critical AND gone) AS lost, count(*) FILTER (critical AND strong) AS strong, min(counted) FILTER (critical AND NOT (both_sides AND coalesce(match AND compared, false) AND key = 'holder_name')) AS least FROM own GROUP BY 1),
iss AS (SELECT *, [CASE WHEN old = 1 THEN 'x:medium' END, CASE WHEN old = 2 THEN CASE WHEN c = 0 AND s = 0 AND no_sex THEN 'rule-identity-missing-sex-front:medium' ELSE 'rule-identity-missing-sex-front:low' END END, CASE WHEN no_holder THEN 'rule-identity-missing-holder:high' END, CASE WHEN no_number THEN 'rule-identity-missing-document-number:high' END, CASE WHEN nu = 2 AND c = 1 THEN 'rule-identity-invalid-dni-pe:high' END, CASE WHEN nu = 2 AND c = 2 THEN 'rule-identity-invalid-cedula-co:high' END,
 CASE WHEN c = 0 AND front AND no_run THEN 'rule-identity-missing-run-cl:medium' END, CASE WHEN c = 0 AND front AND ru = 3 THEN 'rule-identity-invalid-run-cl:high' END, CASE WHEN c = 0 AND front AND ru = 2 THEN 'rule-identity-invalid-run-checksum-cl:high' END, CASE WHEN c = 0 AND back AND no_mrz THEN 'rule-identity-missing-mrz-cl:low' END, CASE WHEN front AND no_birth AND no_issue AND no_expiry THEN 'rule-identity-missing-dates:medium' END,
 CASE WHEN c = 0 AND s = 0 AND no_sex AND old <> 2 THEN 'rule-identity-missing-sex-front:medium' END, CASE WHEN c = 0 AND s = 0 AND no_issue THEN 'rule-identity-missing-issue-date-front:medium' END, CASE WHEN back AND n_back = 0 THEN 'rule-identity-missing-back-evidence:medium' END, CASE WHEN both_sides AND compared AND match = false THEN 'rule-identity-cross-side-identifier-mismatch:high' END, CASE WHEN both_sides AND compared AND match IS NULL THEN 'rule-identity-cross-side-identifier-missing:medium' END,
 CASE WHEN n_dates >= 2 AND iu = 1 AND ex = 2 THEN 'rule-identity-date-order:' || CASE WHEN s = 0 THEN 'medium' ELSE 'high' END END, CASE WHEN n_dates >= 2 AND iu = 1 AND bi = 2 THEN 'rule-identity-birth-after-issue:high' END] AS l FROM v),
j AS (SELECT iss.*, list_filter(l, lambda e: e IS NOT NULL) AS li, coalesce(own_issues, '') AS own_issues, coalesce(oh, 0) AS oh, coalesce(om, 0) AS om, coalesce(og, 0) AS og, coalesce(ob, 0) AS ob, coalesce(lost, 0) AS lost, coalesce(strong, 0) AS strong, coalesce(least, 1) AS least FROM iss LEFT JOIN oi USING (id) LEFT JOIN oc USING (id)),
m AS (SELECT j.*, pk.* EXCLUDE (pack), len(list_filter(li, lambda e: e LIKE '%:high')) + oh AS high, len(list_filter(li, lambda e: e LIKE '%:medium')) + om AS medium, len(list_filter(li, lambda e: e IN ('rule-identity-missing-run-cl:medium') AND j.pack IN ('identity-cl-front', 'identity-cl-front-back'))) + og AS grave, len(list_filter(li, lambda e: e LIKE '%:high' OR e IN ('rule-identity-missing-run-cl:medium', 'rule-identity-missing-dates:medium', 'rule-identity-missing-issue-date-front:medium'))) + ob AS blockers,
 greatest(0.82 * conf + 0.18 * cls, conf - 0.02) AS base FROM j JOIN {_PACK_ROWS} ON pk.pack = j.pack),
t AS (SELECT *, CASE pr WHEN 0 THEN 0.45 WHEN 2 THEN 0.34 ELSE 0.4 END AS t_reject, least(0.98, p_warning + {_STEP}) AS t_warning, least(0.99, p_auto + {_STEP}) AS t0, greatest(0, p_agreement + CASE pr WHEN 0 THEN 0.05 WHEN 2 THEN -0.05 ELSE 0 END) AS t_agreement, CASE pr WHEN 0 THEN 0.9 WHEN 2 THEN 0.8 ELSE 0.86 END AS t_cross FROM m),
w AS (SELECT *, greatest(0.84, round(t0 - CASE WHEN te = 0 THEN 0 ELSE CASE WHEN c = 0 AND ru = 1 THEN 0.03 ELSE 0 END + CASE WHEN n_critical > 0 AND strong = n_critical THEN 0.02 ELSE 0 END + CASE WHEN coalesce(compared AND match, false) THEN 0.01 ELSE 0 END END, 3)) AS t_auto FROM t)"""


@query(f"""WITH {_SQL_IDENTITY}, z AS (SELECT *, CASE WHEN conf < t_reject THEN 'reject' WHEN high > 0 THEN 'human_review' WHEN grave > 0 AND NOT both_sides THEN 'human_review' WHEN c < 3 AND lost = 0 AND (min_back = 0 OR n_back >= min_back) AND (NOT both_sides OR coalesce(compared AND match, false)) AND base >= t_auto AND least >= t_agreement AND blockers = 0 THEN 'auto_accept'
 WHEN medium > 0 AND base >= t_warning AND lost = 0 THEN 'accept_with_warning' WHEN both_sides AND n_back > 0 AND base >= t_cross THEN 'accept_with_warning' WHEN base >= t_warning AND c < 3 AND lost = 0 THEN 'accept_with_warning' ELSE 'human_review' END AS decision FROM w)
SELECT id AS document_id, pack AS rule_pack_id, decision, decision IN ('human_review', 'reject') AS review_required, array_to_string(li || CASE WHEN own_issues = '' THEN [] ELSE [own_issues] END, ',') AS issues, round(base, 6)::DOUBLE AS base_confidence, round(t_auto, 6)::DOUBLE AS auto_threshold, least::DOUBLE AS minimum_agreement FROM z""")
def rule_pack_identity(spark, d):
    rows = _digits(spark, d)
    good = F.when(F.col("c") == 0, "A12.345.678").otherwise("12345678")
    bad = F.when(F.col("c") == 1, "1234567").when(F.col("c") == 2, "12345").otherwise("xyz")
    number = F.when(F.col("nu") == 1, good).when(F.col("nu") == 2, bad).when(F.col("nu") == 3, "NO DETECTADO")
    values = _entries(
        nombre_completo=_pick("ho", *_HOLDERS), numero_de_documento=number, run=_pick("ru", *_RUNS), fecha_de_nacimiento=_pick("bi", *_BIRTHS), fecha_de_emision=F.when(F.col("iu") == 1, "2020-01-01"), fecha_de_vencimiento=_pick("ex", *_EXPIRIES),
        sexo=F.when(F.col("se") == 1, "F"), mrz=F.when(F.col("mz") == 1, "ZZZ"), domicilio=F.when(F.col("ba") > 0, "calle"), estado_civil=F.when(F.col("ba") > 1, "soltera"), lugar_de_nacimiento=F.when(F.col("ba") > 2, "Lima"),
    )
    side = _pick("s", *_SIDES)
    pack = F.when((F.col("pk") == 0) & (F.col("c") < 3), F.concat(F.lit("identity-"), F.lower(_pick("c", *_COUNTRIES)), F.lit("-"), F.replace(side, F.lit("+"), F.lit("-"))))
    docs = _document(rows, "identity", values, pack, side=side, compared=F.col("cm") > 0, identifier_match=F.when(F.col("cm") == 1, True).when(F.col("cm") == 2, False))
    return _shown(R.evaluate(docs))


_SQL_OLD = "CASE WHEN old = 1 THEN 'x:medium' END, CASE WHEN old = 2 THEN 'rule-identity-missing-sex-front:low' END"


@query(f"""WITH o AS (SELECT o_orderkey AS id, {_SQL_DIGITS}, {_NUMERIC} FROM orders), x AS (SELECT *, CASE WHEN c = 0 THEN 'certificate-cl-previsional' WHEN c = 1 THEN 'certificate-pe-laboral' WHEN c = 2 THEN 'certificate-co-laboral' ELSE 'certificate-generic' END AS pack, ho > 0 AS no_holder, se = 0 AS no_issuer, nu IN (0, 3) AS no_rut, iu = 0 AS no_issue, mz = 0 AS no_account, ex = 0 AS no_number FROM o),
own AS (SELECT id, list_filter([CASE WHEN c = 0 AND no_holder THEN 'rule-pack-missing-holder_name:high' END, CASE WHEN c = 0 AND no_rut THEN 'rule-pack-missing-rut:high' END, CASE WHEN c = 0 AND no_number THEN 'rule-pack-missing-certificate_number:high' END, CASE WHEN c = 0 AND no_issue THEN 'rule-pack-missing-issue_date:medium' END, CASE WHEN c = 0 AND no_account THEN 'rule-pack-missing-account:medium' END, CASE WHEN c = 0 AND no_issuer THEN 'rule-pack-missing-issuer:medium' END], lambda e: e IS NOT NULL) AS po FROM x),
i AS (SELECT x.*, list_filter([{_SQL_OLD}, CASE WHEN no_holder THEN 'rule-certificate-missing-holder:medium' END, CASE WHEN no_issuer THEN 'rule-certificate-missing-issuer:medium' END, CASE WHEN no_rut AND no_account AND no_number THEN 'rule-certificate-missing-identifiers:high' END, CASE WHEN c = 0 AND no_number THEN 'rule-certificate-missing-certificate-number:medium' END, CASE WHEN c = 0 AND no_issue THEN 'rule-certificate-missing-issue-date:medium' END, CASE WHEN c = 0 AND ba < 3 THEN 'rule-certificate-insufficient-contribution-rows:medium' END,
 CASE WHEN c = 0 AND nu <> 1 THEN 'rule-certificate-missing-rut-cl:medium' END, CASE WHEN ba = 0 AND nu <> 1 THEN 'rule-certificate-missing-amounts:medium' END, CASE WHEN iu = 0 THEN 'rule-certificate-missing-periods:low' END], lambda e: e IS NOT NULL) || po AS li FROM x JOIN own USING (id)),
m AS (SELECT *, 0.82 * conf + 0.18 * cls AS base, len(list_filter(li, lambda e: e LIKE '%:high')) AS high, len(list_filter(li, lambda e: e LIKE '%:medium')) AS medium, len(list_filter(li, lambda e: e LIKE '%:high' OR e LIKE 'rule-pack-%' OR e IN ('rule-certificate-missing-holder:medium', 'rule-certificate-missing-issuer:medium', 'rule-certificate-missing-certificate-number:medium', 'rule-certificate-missing-issue-date:medium', 'rule-certificate-missing-rut-cl:medium'))) AS blockers FROM i),
t AS (SELECT m.*, CASE pr WHEN 0 THEN 0.48 WHEN 2 THEN 0.36 ELSE 0.42 END AS t_reject, least(0.98, p_warning + {_STEP}) AS t_warning, least(0.99, p_auto + {_STEP}) AS t_auto FROM m JOIN {_PACK_ROWS} ON pk.pack = m.pack),
z AS (SELECT *, CASE WHEN conf < t_reject THEN 'reject' WHEN high > 0 THEN 'human_review' WHEN medium > 0 AND base < 0.8 THEN 'human_review' WHEN blockers = 0 AND base >= t_auto THEN 'auto_accept' WHEN base >= t_warning THEN 'accept_with_warning' ELSE 'human_review' END AS decision FROM t)
SELECT id AS document_id, pack AS rule_pack_id, decision, decision <> 'auto_accept' AS review_required, array_to_string(li, ',') AS issues, round(base, 6)::DOUBLE AS base_confidence, round(t_auto, 6)::DOUBLE AS auto_threshold FROM z""")
def rule_pack_certificate(spark, d):
    rut = F.when(F.col("nu") == 1, "12.345.678-5").when(F.col("nu") == 2, "sin guion").when(F.col("nu") == 3, "NO DETECTADO")
    parts = [F.when(F.col("ba") > n, F.lit(v)) for n, v in enumerate(("1.000", "2.000", "3.000"))]
    values = _entries(titular=_pick("ho", *_HOLDERS), emisor=F.when(F.col("se") == 1, "AFP"), rut=rut, numero_de_certificado=F.when(F.col("ex") > 0, "c1"), cuenta=F.when(F.col("mz") == 1, "77"), fecha_de_emision=F.when(F.col("iu") == 1, "2020-01-01"), a_renta_imponible=parts[0], b_fondo_pensiones=parts[1], c_rut_empleador=parts[2])
    return _shown(R.evaluate(_document(_digits(spark, d), "certificate", values, F.lit(None).cast("string")))).drop("minimum_agreement")


_ZONE = "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<\nL898902C36UTO7408122F1204159ZE184226B<<<<<1{}"


@query(f"""WITH o AS (SELECT o_orderkey AS id, {_SQL_DIGITS}, {_NUMERIC} FROM orders), x AS (SELECT *, c < 3 AS zone, c < 2 AS checks, ho = 2 AS no_holder, nu = 0 AS no_number, bi = 0 AS no_birth, ex = 0 AS no_expiry FROM o),
i AS (SELECT *, list_filter([{_SQL_OLD}, CASE WHEN no_holder THEN 'passport-missing-holder:medium' END, CASE WHEN no_number THEN 'passport-missing-document:high' END, CASE WHEN no_expiry THEN 'passport-missing-expiry:medium' END, CASE WHEN NOT zone THEN 'passport-missing-mrz:low' END, CASE WHEN no_birth THEN 'passport-missing-birth:low' END, CASE WHEN zone AND NOT checks THEN 'passport-invalid-mrz-checksum:high' END,
 CASE WHEN zone AND nu IN (2, 3) THEN 'passport-mrz-document-mismatch:high' END, CASE WHEN zone AND bi = 2 THEN 'passport-mrz-birth-mismatch:medium' END, CASE WHEN zone AND ex = 2 THEN 'passport-mrz-expiry-mismatch:high' END, CASE WHEN zone AND ho = 1 THEN 'passport-mrz-holder-mismatch:medium' END], lambda e: e IS NOT NULL) AS li, CASE WHEN zone THEN cast(nu = 1 AS INT) + cast(bi = 1 AS INT) + cast(ex = 1 AS INT) + cast(ho = 0 AS INT) ELSE 0 END AS hits FROM x),
m AS (SELECT *, greatest(0.82 * conf + 0.18 * cls, conf - 0.02) AS base, len(list_filter(li, lambda e: e LIKE '%:high')) AS high, len(list_filter(li, lambda e: e LIKE '%:medium')) AS medium, len(list_filter(li, lambda e: e LIKE '%:high' OR (e LIKE 'passport%:medium'))) AS blockers, CASE WHEN pr IN (1, 3) THEN 0.42 ELSE 0.36 END AS t_reject, CASE WHEN pr IN (1, 3) THEN 0.82 ELSE 0.76 END AS t_warning,
 greatest(0.88, round(CASE WHEN pr IN (1, 3) THEN 0.93 ELSE 0.9 END - CASE WHEN te = 0 THEN 0 ELSE CASE WHEN checks THEN 0.04 ELSE 0 END + CASE WHEN hits >= 3 THEN 0.03 ELSE 0 END END, 3)) AS t_auto FROM i)
SELECT id AS document_id, CASE WHEN conf < t_reject THEN 'reject' WHEN high > 0 THEN 'human_review' WHEN blockers = 0 AND base >= t_auto THEN 'auto_accept' WHEN base >= t_warning AND medium <= 1 THEN 'accept_with_warning' ELSE 'human_review' END AS decision, array_to_string(li, ',') AS issues, round(base, 6)::DOUBLE AS base_confidence, round(t_auto, 6)::DOUBLE AS auto_threshold FROM m""")
def rule_pack_passport(spark, d):
    line = _ZONE.split("\n")[1][:43]
    weigh = sum("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ".find(ch) * (7, 3, 1)[n % 3] for n, ch in enumerate(line) if ch != "<") % 10
    zone = F.when(F.col("c") < 2, _ZONE.format(weigh)).when(F.col("c") == 2, _ZONE.format((weigh + 1) % 10))
    values = _entries(
        nombre_completo=_pick("ho", "Anna María Eriksson", "Eva Eriksson", None), numero_de_documento=_pick("nu", None, "L898902C3", "X1234567", "AB1234567"), fecha_de_nacimiento=_pick("bi", None, "1974-08-12", "1974-08-13"), fecha_de_vencimiento=_pick("ex", None, "2012-04-15", "2030-01-01"), mrz=zone,
    )
    return _shown(R.evaluate(_document(_digits(spark, d), "passport", values, F.lit(None).cast("string")))).select("document_id", "decision", "issues", "base_confidence", "auto_threshold")


@query(f"""WITH o AS (SELECT o_orderkey AS id, {_SQL_DIGITS}, {_NUMERIC} FROM orders), i AS (SELECT *, CASE WHEN pk = 4 THEN [CASE WHEN old = 1 THEN 'x:medium' END, CASE WHEN old = 2 THEN 'rule-identity-missing-sex-front:low' END, 'rule-pack-unsupported-family:high'] ELSE [{_SQL_OLD}, CASE WHEN ho > 0 THEN 'driver-missing-holder:medium' END, CASE WHEN nu IN (0, 3) THEN 'driver-missing-document:high' END, CASE WHEN ex = 0 THEN 'driver-missing-expiry:low' END, CASE WHEN c = 0 AND nu = 2 THEN 'driver-invalid-id-checksum-cl:high' END] END AS l FROM o),
m AS (SELECT *, list_filter(l, lambda e: e IS NOT NULL) AS li, greatest(0.82 * conf + 0.18 * cls, conf - 0.02) AS base, len(list_filter(l, lambda e: e LIKE '%:high')) AS high, len(list_filter(l, lambda e: e LIKE '%:medium')) AS medium, len(list_filter(l, lambda e: e LIKE '%:high' OR e LIKE 'driver%:medium')) AS blockers, CASE WHEN pr IN (1, 3) THEN 0.4 ELSE 0.34 END AS t_reject, CASE WHEN pr IN (1, 3) THEN 0.8 ELSE 0.74 END AS t_warning,
 greatest(0.87, round(CASE WHEN pr IN (1, 3) THEN 0.92 ELSE 0.88 END - CASE WHEN te > 0 AND c = 0 AND nu = 1 THEN 0.03 ELSE 0 END, 3)) AS t_auto FROM i)
SELECT id AS document_id, CASE WHEN pk = 4 THEN 'invoice-generic' WHEN c = 0 THEN 'driver-license-cl-front' ELSE 'driver-license-generic' END AS rule_pack_id, CASE WHEN pk = 4 THEN 'human_review' WHEN conf < t_reject THEN 'reject' WHEN high > 0 THEN 'human_review' WHEN blockers = 0 AND base >= t_auto THEN 'auto_accept' WHEN base >= t_warning AND medium <= 1 THEN 'accept_with_warning' ELSE 'human_review' END AS decision, array_to_string(li, ',') AS issues FROM m""")
def rule_pack_license(spark, d):
    number = F.when(F.col("nu") == 1, "12.345.678-5").when(F.col("nu") == 2, "12.345.678-9").when(F.col("nu") == 3, "NO DETECTADO")
    values = _entries(nombre_completo=_pick("ho", *_HOLDERS), numero_de_documento=number, fecha_de_vencimiento=_pick("ex", *_EXPIRIES))
    docs = _document(_digits(spark, d), "driver_license", values, F.lit(None).cast("string")).withColumn("family", F.when(F.col("pk") == 4, "invoice").otherwise("driver_license"))
    return _shown(R.evaluate(docs)).select("document_id", "rule_pack_id", "decision", "issues")
