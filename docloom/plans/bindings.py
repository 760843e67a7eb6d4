"""Queries of value binding, capture tags, zones, webhooks and jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import mrz as Z
from ..functions import scores as M
from ..operators import binding as B
from ..operators import jobs as J
from .registry import DOCS, JOBS, doc_records, jobs, load, query, spread

NOW = "1996-06-01 00:00:00"


@query("""WITH t AS (SELECT c_nationkey AS document_id, c_custkey AS ord, round(c_custkey % 10 / 10.0, 1)::DOUBLE AS confidence, 'ab' || (c_custkey % 31) || CASE WHEN c_custkey % 4 = 0 THEN 'x' ELSE '' END AS t FROM customer),
 v AS (SELECT s_nationkey AS document_id, s_suppkey AS field, 'ab' || (s_suppkey % 37) || CASE WHEN s_suppkey % 3 = 0 THEN 'xy' ELSE '' END AS v FROM supplier)
SELECT v.document_id, v.field, b.ord FROM v LEFT JOIN (SELECT field, arg_min(ord, (CASE WHEN t = v THEN 0 ELSE 1 END, CASE WHEN t = v THEN 0 ELSE -confidence END, CASE WHEN t = v THEN 0 ELSE -length(t) END, ord)) AS ord
 FROM v JOIN t USING (document_id) WHERE length(v) >= 4 AND length(t) >= 4 AND (contains(v, t) OR contains(t, v)) GROUP BY 1) b ON b.field = v.field""")
def token_match(spark, d):
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    tokens = load(spark, d, "customer").select(F.col("c_nationkey").alias("document_id"), c.alias("ord"), F.round(c % 10 / 10, 1).alias("confidence"), F.concat(F.lit("A.B "), (c % 31).cast("string"), F.when(c % 4 == 0, "-X").otherwise("")).alias("text"))
    values = load(spark, d, "supplier").select(F.col("s_nationkey").alias("document_id"), s.alias("field"), F.concat(F.lit("ab"), (s % 37).cast("string"), F.when(s % 3 == 0, "XY").otherwise("")).alias("value"))
    return B.match_tokens(values, tokens)


@query("""WITH p AS (SELECT c_nationkey AS document_id, c_custkey AS ord, 'label-' || (c_custkey % 13) AS pl, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'v' || (c_custkey % 7) END AS pv FROM customer),
 f AS (SELECT s_nationkey AS document_id, s_suppkey::VARCHAR AS field, CASE WHEN s_suppkey % 2 = 0 THEN 'label-' || (s_suppkey % 13) ELSE 'other-' || s_suppkey END AS fl, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'v' || (s_suppkey % 7) END AS fv FROM supplier),
 h AS (SELECT f.field, ord, CASE WHEN (pl = fl OR pl = f.field) AND (contains(pv, fv) OR contains(fv, pv)) THEN 0 WHEN contains(fl, pl) OR contains(pl, fl) OR contains(f.field, pl) THEN 1 WHEN fv <> '' AND contains(pv, fv) THEN 2 END AS tier FROM f JOIN p USING (document_id))
SELECT f.document_id, f.field, CAST(b.tier AS INT) AS tier, b.ord FROM f LEFT JOIN (SELECT field, min(tier) AS tier, arg_min(ord, (tier, ord)) AS ord FROM h WHERE tier IS NOT NULL GROUP BY 1) b ON b.field = f.field""")
def pair_match(spark, d):
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    pairs = load(spark, d, "customer").select(F.col("c_nationkey").alias("document_id"), c.alias("ord"), F.concat(F.lit("Label "), (c % 13).cast("string")).alias("label"), F.when(c % 5 > 0, F.concat(F.lit("V."), (c % 7).cast("string"))).alias("value"))
    label = F.when(s % 2 == 0, F.concat(F.lit("LABEL "), (s % 13).cast("string"))).otherwise(F.concat(F.lit("other "), s.cast("string")))
    fields = load(spark, d, "supplier").select(F.col("s_nationkey").alias("document_id"), s.cast("string").alias("field"), label.alias("label"), F.when(s % 4 > 0, F.concat(F.lit("v"), (s % 7).cast("string"))).alias("value"))
    return B.match_pairs(fields, pairs)


@query("""WITH f AS (SELECT c_nationkey AS folder, 'scan' || c_custkey || CASE c_custkey % 3 WHEN 0 THEN '.jpg' WHEN 1 THEN '.PDF' ELSE '.txt' END AS name FROM customer),
 r AS (SELECT c_nationkey AS folder, CASE WHEN c_custkey % 2 = 0 THEN 'JSON_' ELSE 'response_' END || 'scan' || c_custkey || '.jpg.json' AS reference, 'scan' || c_custkey || '.jpg' AS original, c_custkey AS k FROM customer)
SELECT folder, reference, CASE WHEN k % 3 = 0 THEN original WHEN k % 3 = 1 THEN 'scan' || k || '.PDF' END AS file FROM r""")
def source_files(spark, d):
    c, folder = F.col("c_custkey"), F.col("c_nationkey").alias("folder")
    base, rows = F.concat(F.lit("scan"), c.cast("string")), load(spark, d, "customer")
    files = rows.select(folder, F.concat(base, F.when(c % 3 == 0, ".jpg").when(c % 3 == 1, ".PDF").otherwise(".txt")).alias("name"))
    return B.source_files(rows.select(folder, F.concat(F.when(c % 2 == 0, "JSON_").otherwise("response_"), base, F.lit(".jpg.json")).alias("name")), files)


@query("""WITH r AS (SELECT c_custkey AS request_id, CASE c_custkey % 3 WHEN 0 THEN n_name WHEN 1 THEN 'new-' || (c_custkey % 10) ELSE 'default-workspace' END AS slug, n_nationkey FROM customer JOIN nation ON n_nationkey = c_nationkey), h AS (SELECT *, sha1(slug) AS h FROM r)
SELECT request_id, CASE WHEN request_id % 3 = 0 THEN 'tenant' || n_nationkey ELSE substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-a' || substr(h, 18, 3) || '-' || substr(h, 21, 12) END AS tenant_id FROM h""")
def tenant_resolve(spark, d):
    n, c = load(spark, d, "nation"), F.col("c_custkey")
    tenants = n.select(F.concat(F.lit("tenant"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("slug"))
    asked = F.when(c % 3 == 0, F.concat(F.lit(" "), "n_name")).when(c % 3 == 1, F.concat(F.lit("new-"), (c % 10).cast("string"))).otherwise(" ")
    requests = load(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(c.alias("request_id"), asked.alias("tenant"))
    return B.resolve_tenants(requests, tenants)[0]


@query(r"""WITH k AS (SELECT doc_id, regexp_extract(text, '-?\d{1,3}(?:[.,]\d{3})*(?:[.,]\d+)?|-?\d+(?:[.,]\d+)?', 0) AS num, lang FROM documents)
SELECT doc_id AS document_id, 'monto' AS field, CASE WHEN coalesce(lang, '') <> 'en' AND num <> '' THEN num END AS value, (CASE WHEN coalesce(lang, '') <> 'en' AND num <> '' THEN 0.56 ELSE 0.12 END)::DOUBLE AS confidence, 'text-fallback' AS source FROM k
UNION ALL SELECT doc_id, 'origen_doc', source, CASE WHEN source IS NULL THEN 0.88 WHEN lang = 'en' THEN 0.91 ELSE 0.88 END::DOUBLE, 'layout-key-value' FROM documents""")
def custom_fields(spark, d):
    pair = F.array(F.struct(F.lit("Origen doc").alias("label"), F.col("source").alias("value")))
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "text", F.lit("certificate").alias("family"), (F.coalesce("lang", F.lit("")) == "en").alias("supported"), F.lit(None).cast("array<struct<label:string,value:string>>").alias("known"), pair.alias("pairs"))
    return B.custom_fields(docs, {"monto": {"type": "number"}, "origen_doc": {"type": "string", "description": "Origen"}})


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN tags = '' THEN 'clean' ELSE tags END AS tags FROM (SELECT l_orderkey, l_linenumber, concat_ws('|', CASE WHEN q >= 0.86 AND b < 0.2 AND g < 0.18 AND c >= 0.95 THEN 'clean' END, CASE WHEN q < 0.8 THEN 'low_quality' END, CASE WHEN b >= 0.24 THEN 'blur' END,
 CASE WHEN g >= 0.24 THEN 'glare' END, CASE WHEN c < 0.94 OR v < 0.82 THEN 'cropped' END, CASE WHEN v < 0.58 THEN 'small_document_in_frame|needs_zoom_crop' END, CASE WHEN l_linenumber > 4 THEN 'tilt' END, CASE WHEN l_returnflag = 'R' THEN 'perspective' END,
 CASE WHEN q < 0.72 AND g < 0.18 THEN 'low_light' END, CASE WHEN q < 0.58 OR b >= 0.36 THEN 'extreme_low_quality' END) AS tags
 FROM (SELECT *, (l_partkey % 101) / 100.0 AS q, (l_suppkey % 5) / 10.0 AS b, (l_partkey % 7) / 20.0 AS g, (l_orderkey % 21 + 80) / 100.0 AS c, (l_orderkey % 10) / 10.0 AS v FROM lineitem) x) y""")
def capture_tags(spark, d):
    of = lambda c, n, by, plus=0: ((F.col(c) % n + plus) / by)
    tags = M.capture_conditions(of("l_partkey", 101, 100), of("l_suppkey", 5, 10), of("l_partkey", 7, 20), of("l_orderkey", 21, 100, 80), of("l_orderkey", 10, 10), F.when(F.col("l_linenumber") > 4, -2.5).otherwise(1.0), F.col("l_returnflag") == "R")
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(tags, "|").alias("tags"))


@query(f"WITH {DOCS} SELECT document_id, round(greatest(0.05, least(0.99, 0.96 - least(0.35, 0.09 * disagreements + 0.045 * low_agreement + 0.02 * abstained))), 3)::DOUBLE AS confidence FROM docs")
def validation_confidence(spark, d):
    return doc_records(spark, d).select("document_id", M.validation_confidence("disagreements", "low_agreement", "abstained").alias("confidence"))


def _mrz_text(spark, d):
    """A passport's and an identity card's zone in a page's text for each customer."""
    k, c = F.lpad(F.col("c_custkey").cast("string"), 7, "0"), F.translate(F.col("c_custkey").cast("string"), "0123456789", "ABCDEFGHIJ")
    td3 = F.concat(F.lit("Pasaporte\n"), F.rpad(F.concat(F.lit("P<CHL"), c, F.lit("<SOTO<<ANA<"), c), 44, "<"), F.lit("\n"), F.concat(F.lit("P"), k, F.lit("<4CHL8001014F3001019"), F.repeat(F.lit("<"), F.lit(14)), F.lit("00")), F.lit("\nfin"))
    td1 = F.concat(F.lit("Cedula\n1NPER"), F.rpad(F.concat(F.lit("1"), k), 25, "<"), F.lit("\n8501014M3105019PER"), F.repeat(F.lit("<"), F.lit(11)), F.lit("6\n"), F.rpad(F.concat(c, F.lit("<<LUIS")), 30, "<"))
    return spread(load(spark, d, "customer").select("c_custkey")).select("c_custkey", td3.alias("td3"), td1.alias("td1"))


_LETTERS = "translate(c_custkey::VARCHAR, '0123456789', 'ABCDEFGHIJ')"


@query(f"SELECT c_custkey, 'ANA ' || {_LETTERS} || ' ' || {_LETTERS} || ' SOTO' AS holder_name, 'P' || lpad(c_custkey::VARCHAR, 7, '0') AS document_number, '1980-01-01' AS birth_date, '2030-01-01' AS expiry_date, 'CHL' AS nationality FROM customer")
def zone_passport(spark, d):
    return _mrz_text(spark, d).select("c_custkey", Z.parse_td3("td3").alias("z")).select("c_custkey", *(f"z.{c}" for c in ("holder_name", "document_number", "birth_date", "expiry_date", "nationality")))


@query(f"SELECT c_custkey, 'LUIS ' || {_LETTERS} AS holder_name, '1' || lpad(c_custkey::VARCHAR, 7, '0') AS document_number, '1985-01-01' AS birth_date, '2031-05-01' AS expiry_date, 'M' AS sex, 'PE' AS issuing_country FROM customer")
def zone_identity(spark, d):
    return _mrz_text(spark, d).select("c_custkey", Z.parse_td1("td1").alias("z")).select("c_custkey", *(f"z.{c}" for c in ("holder_name", "document_number", "birth_date", "expiry_date", "sex", "issuing_country")))


@query(f"""WITH {JOBS}, alive AS (SELECT DISTINCT dedupe_key FROM jobs WHERE job_id % 5 = 0 AND status <> 'failed') SELECT arg_min(job_id, (created_at, job_id)) AS id, dedupe_key FROM jobs WHERE dedupe_key NOT IN (SELECT dedupe_key FROM alive) GROUP BY dedupe_key""")
def webhook_enqueue(spark, d):
    rows = jobs(spark, d).select(F.col("job_id").alias("id"), "dedupe_key", "created_at", F.when(F.col("status") == "failed", "dead_letter").otherwise("pending").alias("status"))
    return J.enqueue_webhooks(rows, rows.where("id % 5 = 0")).select("id", "dedupe_key")


@query(f"""WITH {JOBS}, x AS (SELECT *, status <> 'completed' AND (next_retry_at IS NULL OR next_retry_at <= TIMESTAMP '{NOW}') AS tried, job_id % 2 = 0 AS ok FROM jobs)
SELECT job_id AS id, CASE WHEN NOT tried THEN CASE WHEN status = 'completed' THEN 'delivered' ELSE 'pending' END WHEN ok THEN 'delivered' WHEN attempts + 1 >= 3 THEN 'dead_letter' ELSE 'pending' END AS status, CASE WHEN tried THEN attempts + 1 ELSE attempts END AS attempts FROM x""")
def webhook_deliver(spark, d):
    status = F.when(F.col("status") == "completed", "delivered").otherwise("pending").alias("status")
    rows = jobs(spark, d).select(F.col("job_id").alias("id"), status, "attempts", "max_attempts", "next_retry_at", F.when(F.col("job_id") % 2 == 0, 204).when(F.col("job_id") % 3 == 0, 500).alias("response_status"))
    return J.deliver(rows, NOW).select("id", "status", "attempts")


@query(f"""WITH {JOBS} SELECT job_id, coalesce(job_id % 3 = 0 AND CASE status WHEN 'queued' THEN true WHEN 'running' THEN lease_expires_at > TIMESTAMP '{NOW}' WHEN 'completed' THEN job_id % 9 = 0 ELSE false END, false) AS skip FROM jobs""")
def duplicate_queue(spark, d):
    k = F.col("job_id")
    rows = jobs(spark, d).withColumn("idempotency_key", F.when(k % 3 == 0, "a").otherwise("b")).withColumn("processed_at", F.when(k % 9 == 0, F.col("updated_at")))
    return rows.select("job_id", J.is_duplicate_job(F.lit("a"), NOW).alias("skip"))


@query("""WITH b AS (SELECT o_custkey AS batch_id, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'P') AS bad FROM orders GROUP BY 1),
 s AS (SELECT *, CASE WHEN bad = n THEN 'batch.failed' WHEN bad > 0 THEN 'batch.partial' ELSE 'batch.completed' END AS event_type FROM b WHERE done + bad = n)
SELECT batch_id, event_type, 'batch:' || batch_id || ':' || event_type AS dedupe_key FROM s WHERE batch_id % 4 > 0 AND batch_id % 7 > 0 AND NOT (batch_id % 5 = 0 AND event_type = 'batch.completed')""")
def batch_notices(spark, d):
    o, k = load(spark, d, "orders"), F.col("batch_id")
    items = o.select(F.col("o_custkey").alias("batch_id"), F.col("o_orderkey").alias("submission_id"), F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("running").alias("status"))
    told = F.when(k % 5 == 0, "batch.completed").alias("last_event")
    batches = items.groupBy("batch_id").agg(F.count("*").alias("n")).select(k, F.when(k % 4 > 0, F.col("n")).otherwise(F.col("n") + 1).alias("registered"), F.when(k % 7 > 0, "http://localhost/hook").alias("callback_url"), told, F.lit("delivered").alias("last_status"))
    return J.batch_notices(batches, items)
