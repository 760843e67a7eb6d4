"""Queries over uploads, URLs, trials, stored rows and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intake as I
from .registry import load, query

_URLS = (
    "https://example.com/a", "http://example.com", "https://api.example.com:8443/x?y#z", "https://localhost/x", "https://10.0.0.7/", "https://172.20.1.1", "https://172.32.1.1/", "https://192.168.1.1", "https://169.254.169.254/latest", "https://[::1]/", "https://[fd00::1]/x",
    "https://db.internal/", "https://other.org/", "ftp://example.com/", "not a url", "", "https://user@example.com/", "https://badexample.com/", "HTTPS://EXAMPLE.COM", "https://printer.local",
)
_REFUSED = (None, "not_secure", None, "not_allowed", "not_allowed", "not_allowed", "not_allowed", "not_allowed", "not_allowed", "not_allowed", "not_allowed", "not_allowed", "not_allowed", "not_secure", "invalid", None, None, "not_allowed", None, "not_allowed")
_PRIVATE = (None, "not_secure", None, "private", "private", "private", None, "private", "private", "private", "private", "private", None, "not_secure", "invalid", None, None, None, None, "private")
_sql = lambda values: "[" + ", ".join("NULL" if v is None else "'" + v + "'" for v in values) + "]"
_at = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


@query(f"SELECT o_orderkey AS id, {_sql(_REFUSED)}[o_orderkey % {len(_URLS)} + 1] AS listed, {_sql(_PRIVATE)}[o_orderkey % {len(_URLS)} + 1] AS open FROM orders")
def url_policy(spark, d):
    k = F.col("o_orderkey")
    return load(spark, d, "orders").select(k.alias("id"), I.url_error(_at(_URLS, k), (" Example.com ",)).alias("listed"), I.url_error(_at(_URLS, k)).alias("open"))


_MIMES, _FILES = ("application/pdf", "image/png", "text/plain", "", "application/octet-stream"), ("a.pdf", "b.HEIC", "c.txt", "", "x.tif.zip", "y.TIFF")


@query(f"""WITH u AS (SELECT o_orderkey AS id, {_sql(_MIMES)}[o_orderkey % 5 + 1] AS m, {_sql(_FILES)}[(o_orderkey // 5) % 6 + 1] AS f, o_orderkey % 40 * 500000 AS size, o_orderkey % 97 * 1200000 AS batch, o_orderkey % 23 AS items FROM orders)
SELECT id, CASE WHEN NOT (m IN ('application/pdf', 'image/png') OR f IN ('a.pdf', 'b.HEIC', 'y.TIFF')) THEN 'unsupported_type' WHEN size > 15728640 THEN 'file_too_large' WHEN batch > 104857600 THEN 'batch_too_large' WHEN items > 20 THEN 'too_many_items' END AS error FROM u""")
def upload_policy(spark, d):
    k = F.col("o_orderkey")
    return load(spark, d, "orders").select(k.alias("id"), I.upload_error(_at(_MIMES, k), _at(_FILES, F.floor(k / 5)), k % 40 * 500000, k % 97 * 1200000, k % 23).alias("error"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'not_a_trial' WHEN c_custkey % 7 = 0 THEN 'expired' WHEN c_custkey % 4 = 0 THEN 'nothing_asked' WHEN c_custkey % 60 + c_custkey % 4 > CASE c_custkey % 3 WHEN 0 THEN 50 WHEN 1 THEN 1 ELSE 30 END THEN 'limit_reached' END AS error FROM customer""")
def trial_policy(spark, d):
    k = F.col("c_custkey")
    until = F.when(k % 7 == 0, F.lit("1998-01-01")).when(k % 7 == 1, F.lit(None)).otherwise("1999-01-01").cast("timestamp")
    limit = F.when(k % 3 == 1, 0).when(k % 3 == 2, 30)
    return load(spark, d, "customer").select(k.alias("id"), I.trial_error(F.when(k % 5 > 0, "trial"), until, limit, k % 60, k % 4, "1998-06-01").alias("error"))


@query("SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200")
def submission_feed(spark, d):
    rows = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), "o_orderpriority", F.col("o_orderdate").alias("created_at"), F.col("o_custkey").alias("client"))
    return I.feed(rows, 200, status="F", o_orderpriority="1-URGENT", client=None).select("id", "status")


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey = 7")
def point_lookup(spark, d):
    return I.lookup(load(spark, d, "customer"), "c_custkey", 7).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


@query("SELECT event_id AS id FROM (SELECT event_id, event_type || '.' || (user_id % 3) AS action, ts FROM events) e WHERE starts_with(action, 'click.1') ORDER BY ts DESC, event_id DESC LIMIT 50")
def audit_feed(spark, d):
    rows = load(spark, d, "events").select(F.col("event_id").alias("id"), F.concat_ws(".", "event_type", (F.col("user_id") % 3).cast("string")).alias("action"), F.col("ts").alias("created_at"))
    return I.audit_events(rows, "click.1", limit=50).select("id")


@query("SELECT event_id AS id FROM (SELECT event_id, ts FROM events UNION ALL SELECT -o_orderkey, CAST(o_orderdate AS TIMESTAMP) + to_years(30) FROM orders WHERE o_orderkey % 50 = 1) e ORDER BY ts DESC, event_id DESC LIMIT 5000")
def audit_log(spark, d):
    old = load(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("created_at"))
    new = load(spark, d, "orders").where("o_orderkey % 50 = 1").select((-F.col("o_orderkey")).alias("id"), (F.col("o_orderdate").cast("timestamp") + F.expr("interval 30 years")).alias("created_at"))
    return I.append_audit(old, new).select("id")


@query("SELECT n_name AS name, CASE WHEN n_nationkey = 3 THEN 'new' ELSE 'old' END AS manifest, CAST(CASE WHEN n_nationkey = 3 THEN 0 ELSE row_number() OVER (PARTITION BY n_nationkey = 3 ORDER BY n_nationkey) END AS INT) AS place FROM nation")
def registry_upsert(spark, d):
    rows = load(spark, d, "nation").select(F.col("n_name").alias("name"), F.lit("old").alias("manifest"), F.col("n_nationkey").cast("int").alias("place"))
    return I.upsert(rows, rows.where("place = 3").withColumn("manifest", F.lit("new")))


@query("SELECT l_orderkey AS document_id, l_linenumber AS ord, 'old' AS v FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0) UNION ALL SELECT o_orderkey, 0, 'new' FROM orders WHERE o_orderkey % 5 = 0")
def replaced_children(spark, d):
    old = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").cast("int").alias("ord"), F.lit("old").alias("v"))
    new = load(spark, d, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("document_id"), F.lit(0).alias("ord"), F.lit("new").alias("v"))
    return I.replace_children(old, new, "document_id")


_RESULTS = "r AS (SELECT o_orderkey % 11 > 0 AS ok, CASE o_orderkey % 4 WHEN 0 THEN 'auto_accept' WHEN 1 THEN 'human_review' WHEN 2 THEN 'reject' ELSE 'accept_with_warning' END AS decision, 'f' || (o_orderkey % 3) AS family, 'c' || (o_orderkey % 2) AS country, CASE WHEN o_orderkey % 7 > 0 THEN 0.5 + o_orderkey % 50 / 100.0 ELSE 0 END AS conf FROM orders)"


@query(f"""WITH {_RESULTS} SELECT 'total_files' AS what, NULL AS value, count(*)::DOUBLE AS n FROM r UNION ALL SELECT 'processed_ok', NULL, count(*) FILTER (ok) FROM r UNION ALL SELECT 'failed', NULL, count(*) FILTER (NOT ok) FROM r UNION ALL SELECT 'unsupported_or_review', NULL, count(*) FILTER (ok AND decision IN ('human_review', 'reject')) FROM r
UNION ALL SELECT 'average_confidence', NULL, round(avg(conf) FILTER (ok), 4) FROM r UNION ALL SELECT 'by_decision', decision, count(*) FROM r WHERE ok GROUP BY 2 UNION ALL SELECT 'by_family', family, count(*) FROM r WHERE ok GROUP BY 2 UNION ALL SELECT 'by_country', country, count(*) FROM r WHERE ok GROUP BY 2""")
def batch_summary(spark, d):
    k = F.col("o_orderkey")
    conf = F.when(k % 7 > 0, (0.5 + k % 50 / 100).cast("string")).otherwise("n/a")
    rows = load(spark, d, "orders").select(F.when(k % 11 > 0, "ok").otherwise("error").alias("status"), _at(("auto_accept", "human_review", "reject", "accept_with_warning"), k).alias("decision"), F.concat(F.lit("f"), (k % 3).cast("string")).alias("family"), F.concat(F.lit("c"), (k % 2).cast("string")).alias("country"), conf.alias("confidence"))
    return I.batch_summary(rows)


_PLACE = "((l_linenumber * 1000000 + l_partkey) * 100000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT)"


@query(f"""WITH p AS (SELECT l_orderkey AS document_id, {_PLACE} AS page, CASE WHEN l_quantity > 10 THEN l_quantity / 50.3117 END AS quality, CASE WHEN l_partkey % 3 > 0 THEN l_discount * 3.7119 END AS blur, l_tax * 4.13177 AS glare, 1 - l_tax * 1.03713 AS crop, 1 - l_discount * 2.91377 AS coverage, CASE l_suppkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 90 END AS orientation, ['blur', 'tilt', 'clean'][l_partkey % 3 + 1] AS c1, l_suppkey % 2 = 0 AS two FROM lineitem),
c AS (SELECT document_id, string_agg(c, ',' ORDER BY f) AS conditions FROM (SELECT document_id, c, min(page * 2 + n) AS f FROM (SELECT document_id, page, 0 AS n, c1 AS c FROM p UNION ALL SELECT document_id, page, 1, 'glare' FROM p WHERE two) GROUP BY 1, 2) GROUP BY 1),
a AS (SELECT document_id, round(avg(quality), 3) AS q, round(avg(blur), 3) AS blur, round(avg(glare), 3) AS glare, round(avg(crop), 3) AS crop, round(avg(coverage), 3) AS coverage, arg_min(orientation, page) FILTER (orientation IS NOT NULL) AS orientation FROM p GROUP BY 1)
SELECT document_id, round(greatest(0.05, least(coalesce(q, 0), 0.99)), 3)::DOUBLE AS score, blur, glare, crop, coverage, orientation, conditions, coalesce(nullif(array_to_string(list_filter([CASE WHEN coalesce(q, 0) < 0.55 THEN 'quality' END, CASE WHEN blur >= 0.3 THEN 'blur' END, CASE WHEN glare >= 0.24 THEN 'glare' END, CASE WHEN crop < 0.92 THEN 'crop' END, CASE WHEN coverage < 0.82 THEN 'coverage' END, CASE WHEN orientation <> 0 THEN 'orientation' END], lambda x: x IS NOT NULL), ','), ''), 'none') AS recommendations FROM a JOIN c USING (document_id)""")
def page_quality(spark, d):
    c = F.col
    place = ((c("l_linenumber").cast("long") * 1000000 + c("l_partkey")) * 100000 + c("l_suppkey")) * 100 + c("l_quantity").cast("long")
    tags = F.concat(F.array(_at(("blur", "tilt", "clean"), c("l_partkey"))), F.when(c("l_suppkey") % 2 == 0, F.array(F.lit("glare"))).otherwise(F.array().cast("array<string>")))
    pages = load(spark, d, "lineitem").select(
        c("l_orderkey").alias("document_id"), place.alias("page"), F.when(c("l_quantity") > 10, c("l_quantity") / 50.3117).alias("quality"), F.when(c("l_partkey") % 3 > 0, c("l_discount") * 3.7119).alias("blur"), (c("l_tax") * 4.13177).alias("glare"), (1 - c("l_tax") * 1.03713).alias("crop"), (1 - c("l_discount") * 2.91377).alias("coverage"),
        F.when(c("l_suppkey") % 4 == 0, 0).when(c("l_suppkey") % 4 == 1, 90).alias("orientation"), tags.alias("conditions"),
    )
    return I.page_quality(pages).withColumns({"conditions": F.array_join("conditions", ","), "recommendations": F.array_join("recommendations", ",")})


@query("SELECT CAST(sum(l_quantity) AS BIGINT) AS matches, CAST(sum(l_quantity + l_linenumber + 1) AS BIGINT) AS expected, round(sum(l_quantity) / sum(l_quantity + l_linenumber + 1), 6) AS rate FROM lineitem")
def match_rate(spark, d):
    rows = load(spark, d, "lineitem").select(F.col("l_quantity").cast("long").alias("matches"), F.col("l_linenumber").alias("mismatches"), F.lit(1).alias("missing"))
    return I.match_rate(rows).withColumn("rate", F.round("rate", 6))


@query("SELECT l_orderkey AS document_id, l_linenumber % 2 AS page, round(avg(CASE WHEN l_tax > 0.02 THEN 1 - l_discount END), 6) AS confidence, count(*) AS tokens FROM lineitem GROUP BY 1, 2")
def token_confidence(spark, d):
    rows = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), (F.col("l_linenumber") % 2).alias("page"), F.when(F.col("l_tax") > 0.02, 1 - F.col("l_discount")).alias("confidence"))
    return I.token_confidence(rows, "document_id", "page")


@query("""WITH t AS (SELECT o_orderkey AS k, n FROM orders, (VALUES (0), (1)) v(n) WHERE n < o_orderkey % 3), l AS (SELECT k, n, CASE WHEN k % 2 = 0 THEN '"Tabla, ' || n || '"' ELSE 'Tabla ' || n END || CASE WHEN n = 0 THEN chr(13) || chr(10) || 'a,b' ELSE '' END || chr(13) || chr(10) || k || ',"x""y"' || chr(13) || chr(10) || '1,' AS t FROM t)
SELECT k AS document_id, trim(string_agg(t, chr(13) || chr(10) || chr(13) || chr(10) ORDER BY n)) AS text FROM l GROUP BY 1""")
def tables_csv(spark, d):
    k, n = F.col("o_orderkey"), F.col("n")
    rows = load(spark, d, "orders").select("o_orderkey", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("n")).where("n < o_orderkey % 3")
    title = F.concat(F.when(k % 2 == 0, "Tabla, ").otherwise("Tabla "), n.cast("string"))
    cells = F.array(F.array(k.cast("string"), F.lit('x"y')), F.array(F.lit("1"), F.lit(None).cast("string")))
    return I.table_lines(rows.select(k.alias("document_id"), n.alias("ord"), title.alias("title"), F.when(n == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("headers"), cells.alias("rows")))
