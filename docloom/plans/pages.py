"""Queries over lines and pages of documents, run scores and capped feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as C
from ..operators import analytics as A
from ..operators import pages as G
from ..operators import sequences as S
from ..operators.intake import feed
from .normalizers import _MONTHS, _SQL_ROWS, _cat, _iso, _list, _month, _rows
from .registry import LEDGER, ledger, load, query, spread


@query(f"""WITH {_SQL_ROWS}, x AS (SELECT *, {_list(_MONTHS)}[month(l)] AS mmm, {_iso('l')} AS iso, k % 2 = 0 AS even FROM o)
SELECT k AS doc_id, 1 AS row, strftime(l, '%Y-%m') AS period, mmm || '-' || year(l) AS period_label, iso AS date, CASE WHEN even THEN '100.' ELSE '1.000.' END || n3 AS amount, '1.000.' || n3 AS renta_amount, CASE WHEN even THEN '100.' || n3 END AS pension_amount, CASE WHEN NOT even THEN 'COTIZACION' END AS code,
 CASE WHEN even THEN 'ACME ' || (k % 7) ELSE 'EMPRESA ' || (k % 5) END AS employer, CASE WHEN even THEN '76.543.210-3' ELSE '77.111.222-3' END AS employer_rut, mmm || '-' || year(l) || ' 1.000.' || n3 || CASE WHEN even THEN ' 100.' || n3 || ' ACME ' || (k % 7) || ' 76.543.210-3 ' || iso ELSE ' COTIZACION EMPRESA ' || (k % 5) || ' 77.111.222-3 ' || iso END AS detail FROM x
UNION ALL SELECT k, 2, (year(l) + 1) || strftime(l, '-%m'), mmm || '-' || (year(l) + 1), NULL, '0', '0', '0', 'PERIODO SIN COTIZACION', NULL, NULL, mmm || '-' || (year(l) + 1) || ' $0 $0 PERIODO SIN COTIZACION' FROM x""")
def contribution_table(spark, d):
    k, c = F.col("k"), F.col
    label = lambda more: _cat(_month(c("l")), "-", (F.year("l") + more).cast("string"))
    iso = F.date_format("l", "yyyy-MM-dd")
    even = F.array(F.lit("CABECERA"), _cat(label(0), " 1.000.", c("n3"), " 100.", c("n3"), " ACME ", (k % 7).cast("string"), " 76.543.210-3 ", iso))
    odd = F.array(F.lit("CABECERA"), _cat(label(0), " 1.000.", c("n3"), " COTIZACION"), _cat("EMPRESA ", (k % 5).cast("string")), _cat("77.111.222-3 ", iso))
    tail = F.array(_cat(label(1), " $0 $0 PERIODO SIN"), F.lit("COTIZACION"), F.lit("CORDIALMENTE"), F.lit("pie"))
    lines = _rows(spark, d).select(k.alias("doc_id"), F.posexplode(F.concat(F.when(k % 2 == 0, even).otherwise(odd), tail)).alias("line_no", "line"))
    return S.period_rows(lines).withColumn("row", F.col("row").cast("int"))


@query("""WITH l AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, min(l_partkey) || ' ' || min(l_suppkey) AS line, max(l_returnflag) = 'R' AS label FROM lineitem GROUP BY 1, 2), x AS (SELECT a.doc_id, a.n AS label_no, b.line AS value, row_number() OVER (PARTITION BY a.doc_id, a.n ORDER BY abs(b.n - a.n), a.n - b.n) AS r
 FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.n <> a.n AND abs(b.n - a.n) <= 2 WHERE a.label AND NOT b.label) SELECT doc_id, CAST(label_no AS INT) AS label_no, value FROM x WHERE r = 1""")
def nearest_value(spark, d):
    text = F.concat_ws(" ", F.min("l_partkey").cast("string"), F.min("l_suppkey").cast("string"))
    rows = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("line_no")).agg(text.alias("line"), (F.max("l_returnflag") == "R").alias("label"))
    return S.nearby(rows.where("not label").drop("label"), rows.where("label").select("doc_id", "line_no"), 2)


_FRONT = "REPUBLICA DE CHILE CEDULA DE IDENTIDAD RUN NOMBRES APELLIDOS REGISTRO CIVIL E IDENTIFICACION"
_BACK = "NACIO EN DOMICILIO COMUNA PROFESION CIRCUNSCRIPCION HUELLA INCHL"


@query("""SELECT c_custkey AS doc_id, CASE c_custkey % 4 WHEN 1 THEN 1 ELSE 2 END AS pages, CASE c_custkey % 4 WHEN 2 THEN 1 ELSE 2 END AS page, CASE c_custkey % 4 WHEN 1 THEN 'identity-cl-back' WHEN 3 THEN 'passport-generic' ELSE 'identity-cl-front' END AS pack_id, CASE c_custkey % 4 WHEN 0 THEN 'front+back' WHEN 1 THEN 'back' WHEN 2 THEN 'front' END AS side,
 c_custkey % 4 = 0 AS both_sides, CASE c_custkey % 4 WHEN 3 THEN 0.6 ELSE 0.97 END::DOUBLE AS confidence FROM customer""")
def dominant_page(spark, d):
    k = F.col("c_custkey")
    text = lambda *cases: F.element_at(F.array(*map(F.lit, cases)), (k % 4 + 1).cast("int"))
    pages = spread(load(spark, d, "customer").select("c_custkey")).select(k.alias("doc_id"), F.posexplode(F.array(text(_BACK, " \n", _FRONT, "algo"), text(_FRONT, _BACK, _FRONT, "PASAPORTE PASSPORT"))).alias("page", "text")).withColumn("page", F.col("page") + 1)
    return G.analyze(pages, F.lit("auto"), F.lit("XX")).select("doc_id", F.col("pages").cast("int").alias("pages"), "page", "pack_id", "side", "both_sides", F.round("confidence", 6).alias("confidence"))


@query("""WITH x AS (SELECT l_orderkey AS document_id, l_linenumber AS n, l_discount * 10 AS c, l_tax * 12 AS t, l_partkey % 400 AS tokens, (l_suppkey * 97) % 9000 AS len, l_linenumber % 3 > 0 AS sup, l_linenumber <> 4 AS ok FROM lineitem)
SELECT document_id, CAST(n AS INT) AS run, CASE WHEN ok AND len > 0 THEN round(0.52 * c + CASE WHEN sup THEN 0.32 ELSE 0 END + 0.1 * t + 0.03 * least(tokens, 240) / 240 + 0.03 * least(len, 6000) / 6000, 6) ELSE 0 END::DOUBLE AS score FROM x""")
def run_scores(spark, d):
    rows = load(spark, d, "lineitem")
    s = C.ocr_run_score(F.col("l_discount") * 10, F.col("l_linenumber") % 3 > 0, F.col("l_tax") * 12, F.col("l_partkey") % 400, F.col("l_suppkey") * 97 % 9000, F.col("l_linenumber") != 4)
    return rows.select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").cast("int").alias("run"), F.round(s, 6).alias("score"))


@query("""WITH x AS (SELECT l_orderkey AS document_id, l_linenumber AS n, l_quantity / 50 AS tok, l_discount * 10 AS cand, l_tax * 12 AS agr, CASE WHEN l_linenumber % 3 = 0 THEN 0.9 ELSE 0 END AS adj, l_suppkey % 6 AS issues, l_partkey % 11 = 0 AS good, l_returnflag = 'R' AS crit FROM lineitem), y AS (SELECT *, greatest(0.66, tok, cand, 0.52 + 0.38 * agr, adj) - least(0.18, 0.05 * issues) AS s FROM x)
SELECT document_id, CAST(n AS INT) AS field, round(greatest(0.05, least(0.99, CASE WHEN good THEN greatest(s, 0.99) ELSE s END + CASE WHEN crit AND issues = 0 THEN 0.04 ELSE 0 END)), 5)::DOUBLE AS confidence FROM y""")
def field_confidences(spark, d):
    c = F.col
    s = C.field_confidence(c("l_quantity") / 50, c("l_discount") * 10, c("l_tax") * 12, F.when(c("l_linenumber") % 3 == 0, 0.9).otherwise(0.0), c("l_suppkey") % 6, c("l_partkey") % 11 == 0, c("l_returnflag") == "R")
    return load(spark, d, "lineitem").select(c("l_orderkey").alias("document_id"), c("l_linenumber").cast("int").alias("field"), F.round(s, 5).alias("confidence"))


FROM, TO, NEWEST = "2024-01-05 00:00:00", "2024-01-30 12:00:00", 500


@query(f"WITH {LEDGER}, n AS (SELECT * FROM ledger ORDER BY created_at DESC, event_id DESC LIMIT {NEWEST}) SELECT coalesce(family, 'unclassified') AS family, CAST(sum(units) AS BIGINT) AS documents FROM n WHERE terminal AND created_at BETWEEN TIMESTAMP '{FROM}' AND TIMESTAMP '{TO}' GROUP BY 1")
def capped_usage(spark, d):
    """The newest rows are fetched, then those of the dates counted: the cap is what is asked for here, and is off in ``usage_by_day``."""
    newest = feed(ledger(spark, d), NEWEST, tie="event_id")
    return A.usage_by(A.in_range(newest, FROM, TO), F.col("family"), "family")
