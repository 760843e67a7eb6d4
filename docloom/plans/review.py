"""Queries over document records: signals, calibration, golden sets, statuses, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import documents as P
from ..operators.ranking import numbered
from .registry import load, query

NOW = "1998-06-01 00:00:00"
_FIELD_NAMES = ("run", "nombre-completo", "sexo", "fecha-de-emision", "otro")
_STATUS = ("uploaded", "processing", "completed", "review", "rejected", "completed", "completed")
_JOB = ("queued", "running", "failed", "completed")


def _pick(key, values):
    out = F.lit(values[-1])
    for k in range(len(values) - 1):
        out = F.when(key == k, values[k]).otherwise(out)
    return out


def _case(key, values):
    return f"CASE {key} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values[:-1])) + f" ELSE '{values[-1]}' END"


def _place():
    return ((F.col("l_linenumber").cast("long") * 1000000 + F.col("l_partkey")) * 100000 + F.col("l_suppkey")) * 100 + F.col("l_quantity").cast("long")


def records(spark, d):
    """Document records from ``orders``, their fields and edits from ``lineitem``; every column is a function of the row."""
    i, s = load(spark, d, "lineitem"), F.col("l_suppkey")
    text = F.when(s % 4 == 0, F.lit(None)).when(s % 4 == 1, "  ").otherwise(F.concat(F.lit(" v"), (s % 3).cast("string"), F.lit(",x ")))
    name = _pick(F.col("l_partkey") % 5, _FIELD_NAMES)
    new = F.when(F.col("l_linenumber") % 2 == 0, F.trim(text)).otherwise(F.concat(F.lit("n"), (s % 2).cast("string")))
    field = F.struct(
        _place().alias("ord"), name.alias("field_name"), F.initcap(name).alias("label"), text.alias("normalized"), F.when(F.col("l_linenumber") % 3 > 0, F.concat(F.lit("raw "), F.col("l_partkey").cast("string"))).alias("raw"),
        F.round(0.5 + F.col("l_tax"), 2).alias("confidence"), (F.col("l_linenumber") % 2 + 1).cast("int").alias("page"), F.concat(F.lit("e"), (s % 3).cast("string")).alias("engine"), F.lit(None).cast("string").alias("evidence"),
        F.when(F.col("l_quantity") <= 40, F.round(0.5 + F.col("l_discount") * 5, 2)).alias("agreement"), (F.col("l_tax") > 0.06).alias("disagreement"), F.when(F.col("l_linestatus") == "F", F.col("l_returnflag") == "R").alias("abstained"),
    )
    edit = F.struct(_place().alias("ord"), name.alias("field_name"), text.alias("previous"), new.alias("new"), F.lit("r").alias("reason"), F.col("l_shipdate").cast("timestamp").alias("created_at"))
    kids = i.groupBy(F.col("l_orderkey").alias("document_id")).agg(F.array_sort(F.collect_list(field)).alias("fs"), F.array_sort(F.collect_list(F.when(F.col("l_returnflag") == "R", edit))).alias("es"))
    k, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    after = lambda seconds: F.timestamp_seconds(F.unix_seconds(at) + seconds)
    job = F.struct(
        _pick(k % 4, _JOB).alias("status"), F.when(k % 7 == 0, "dlq").otherwise("main").alias("queue"), at.alias("created_at"), F.when(k % 3 > 0, after(k % 5 * 10)).alias("started_at"),
        F.when(k % 3 > 1, after(k % 9 * 7)).alias("finished_at"), F.when(k % 6 > 0, after(k % 6 * 864000)).alias("next_retry_at"),
    )
    text_of = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    docs = load(spark, d, "orders").select(
        k.alias("document_id"), k.alias("ord"), text_of("file-", k).alias("filename"), text_of("family", k % 4).alias("family"), _pick(k % 3, ("CL", "PE", "XX")).alias("country"), F.when(k % 5 > 0, text_of("v", k % 2)).alias("variant"),
        F.when(k % 6 > 0, text_of("pack-", k % 16)).alias("pack_id"), _pick(k % 5, P.DECISIONS).alias("decision"), _pick(k % 7, _STATUS).alias("status"), (k % 8 == 0).alias("review_required"),
        F.when(k % 11 > 0, F.round(0.5 + (k % 50) / 100, 2)).alias("confidence"), F.when(k % 4 > 0, at).alias("processed_at"), F.when(k % 9 == 0, at).alias("last_reviewed_at"), at.alias("updated_at"),
        F.when(k % 2 == 0, text_of("h", k)).alias("source_hash"), F.when(k % 3 == 1, "").when(k % 3 == 2, "<p>").alias("report_html"), F.filter(F.array(F.lit("s")), lambda x: k % 2 == 1).alias("sections"),
        F.when(k % 10 > 0, job).alias("job"), F.transform(F.filter(F.array(F.lit(0), F.lit(1)), lambda x: x < k % 3), lambda x: F.struct((k % 7 + 0.5).alias("duration_ms"))).alias("trace"),
        F.when(k % 5 > 0, text_of("s", k % 3)).alias("routing_strategy"), text_of("Ana Perez", k % 2).alias("holder_name"),
        F.transform(F.filter(F.array(F.lit("Run"), F.lit("sexo"), F.lit("x")), lambda x, p: p <= k % 4), lambda x: F.struct(F.concat(F.lit("i-"), x).alias("id"), x.alias("field"))).alias("issues"),
    )
    rows = docs.join(kids, "document_id", "left")
    session = F.struct(F.when(F.col("document_id") % 2 == 0, "completed").otherwise("open").alias("status"), F.col("updated_at"), F.transform("es", lambda e: e.dropFields("ord")).alias("edits"))
    has = (F.size("es") > 0) | (F.col("document_id") % 12 == 0)
    return rows.withColumn("sessions", F.when(has, F.array(session)).otherwise(F.filter(F.array(session), lambda x: F.lit(False)))).withColumn("fields", F.transform("fs", lambda f: f.dropFields("ord"))).drop("fs", "es")


#: No two lines of an order have one place.
_ORD = "((l_linenumber * 1000000 + l_partkey) * 100000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT)"
_NAME = _case("l_partkey % 5", _FIELD_NAMES)
_TEXT = "CASE l_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE ' v' || (l_suppkey % 3) || ',x ' END"
RECORDS = f"""f AS (SELECT l_orderkey AS document_id, {_ORD} AS ord, {_NAME} AS field_name, {_TEXT} AS normalized, CASE WHEN l_linenumber % 3 > 0 THEN 'raw ' || l_partkey END AS raw, round(0.5 + l_tax, 2) AS confidence, CAST(l_linenumber % 2 + 1 AS INT) AS page, 'e' || (l_suppkey % 3) AS engine,
 CASE WHEN l_quantity <= 40 THEN round(0.5 + l_discount * 5, 2) END AS agreement, l_tax > 0.06 AS disagreement, CASE WHEN l_linestatus = 'F' THEN l_returnflag = 'R' END AS abstained, nullif(trim({_TEXT}), '') AS value FROM lineitem),
e AS (SELECT l_orderkey AS document_id, {_ORD} AS ord, {_NAME} AS field_name, nullif(trim({_TEXT}), '') AS previous, nullif(CASE WHEN l_linenumber % 2 = 0 THEN trim({_TEXT}) ELSE 'n' || (l_suppkey % 2) END, '') AS new, l_shipdate AS created_at FROM lineitem WHERE l_returnflag = 'R'),
d AS (SELECT o_orderkey AS document_id, o_orderkey AS k, 'file-' || o_orderkey AS filename, 'family' || (o_orderkey % 4) AS family, {_case('o_orderkey % 3', ('CL', 'PE', 'XX'))} AS country, CASE WHEN o_orderkey % 5 > 0 THEN 'v' || (o_orderkey % 2) END AS variant,
 CASE WHEN o_orderkey % 6 > 0 THEN 'pack-' || (o_orderkey % 16) END AS pack_id, {_case('o_orderkey % 5', P.DECISIONS)} AS decision, {_case('o_orderkey % 7', _STATUS)} AS status, o_orderkey % 8 = 0 AS review_required, CASE WHEN o_orderkey % 11 > 0 THEN round(0.5 + (o_orderkey % 50) / 100.0, 2) END::DOUBLE AS confidence,
 o_orderkey % 4 > 0 AS processed, o_orderkey % 9 = 0 AS seen, o_orderdate AS made, CASE WHEN o_orderkey % 10 > 0 THEN {_case('o_orderkey % 4', _JOB)} END AS job, CASE WHEN o_orderkey % 10 > 0 THEN CASE WHEN o_orderkey % 7 = 0 THEN 'dlq' ELSE 'main' END END AS queue,
 CASE WHEN o_orderkey % 6 > 0 THEN o_orderdate + to_seconds(o_orderkey % 6 * 864000) END AS next_retry_at FROM orders),
fa AS (SELECT document_id, count(*) AS n_fields, count(agreement) AS consensus_fields, count(*) FILTER (agreement IS NOT NULL AND disagreement) AS disagreements, count(*) FILTER (agreement < 0.67) AS low_agreement, coalesce(avg(agreement), 0) AS agreement, sum(agreement) AS agreed, count(abstained) AS adjudications, count(*) FILTER (abstained) AS abstained FROM f GROUP BY 1),
ea AS (SELECT document_id, count(*) AS edits, count(DISTINCT field_name) AS edited, count(DISTINCT field_name) FILTER (previous IS DISTINCT FROM new) AS corrected FROM e GROUP BY 1),
s AS (SELECT d.*, coalesce(pack_id, family || '-' || country || '-' || coalesce(variant, 'generic')) AS pack_key, seen OR edits > 0 OR k % 12 = 0 AS reviewed, coalesce(corrected, 0) AS corrected, coalesce(edits, 0) AS edits, coalesce(edited, 0) AS edited, coalesce(n_fields, 0) AS n_fields, coalesce(consensus_fields, 0) AS consensus_fields,
 coalesce(disagreements, 0) AS disagreements, coalesce(low_agreement, 0) AS low_agreement, coalesce(agreement, 0) AS agreement, coalesce(agreed, 0) AS agreed, coalesce(adjudications, 0) AS adjudications, coalesce(abstained, 0) AS abstained FROM d LEFT JOIN fa USING (document_id) LEFT JOIN ea USING (document_id))"""
_REVIEWED = "(SELECT document_id FROM s WHERE coalesce(reviewed, false))"


def _signals(spark, d):
    return P.signals(records(spark, d))


@query(f"WITH {RECORDS} SELECT document_id, pack_key AS pack_id, coalesce(reviewed, false) AS reviewed, corrected, n_fields, consensus_fields, disagreements, low_agreement, round(agreement, 6) AS agreement, adjudications, abstained, edits, (edits > 0 OR k % 12 = 0) AND k % 2 = 0 AS review_completed FROM s")
def document_signals(spark, d):
    return _signals(spark, d).select("document_id", "pack_id", "reviewed", "corrected", "n_fields", "consensus_fields", "disagreements", "low_agreement", F.round("agreement", 6).alias("agreement"), "adjudications", "abstained", "edits", "review_completed")


_CAL = f"""{RECORDS}, b AS (SELECT pack_key, arg_min(family, k) AS family, arg_min(country, k) AS country, arg_min(coalesce(variant, '~'), k) AS variant, count(*) AS n, count(*) FILTER (reviewed) AS rv, count(*) FILTER (corrected > 0) AS co, count(*) FILTER (decision = 'auto_accept' AND corrected > 0) AS fa, count(*) FILTER (decision IN ('auto_accept', 'accept_with_warning')) AS st,
 count(*) FILTER (decision = 'human_review') AS hr, avg(coalesce(confidence, 0)) AS cf, sum(agreed) AS ag, sum(consensus_fields) AS cn, sum(disagreements) AS di, sum(abstained) AS ab, sum(adjudications) AS ad FROM s GROUP BY 1),
c AS (SELECT *, coalesce(co / nullif(rv, 0), 0) AS cr, coalesce(ag / nullif(cn, 0), 0) AS av, hr / n AS rr FROM b),
cal AS (SELECT pack_key AS pack_id, family, country, nullif(variant, '~') AS variant, n AS documents, rv AS reviewed, co AS corrected, fa AS false_accepts, round(st / n, 6) AS straight_through_rate, round(rr, 6) AS review_rate, round(cr, 6) AS correction_rate, round(cf, 6) AS confidence, round(av, 6) AS agreement,
 round(coalesce(di / nullif(cn, 0), 0), 6) AS disagreement_rate, round(coalesce(ab / nullif(ad, 0), 0), 6) AS abstention_rate, CASE WHEN rv < 5 THEN 'collect_more_samples' WHEN fa > 0 OR (cr > 0.18 AND av < 0.88) THEN 'tighten_auto_accept' WHEN rr > 0.55 AND cr < 0.08 AND av > 0.9 THEN 'reduce_review_threshold' ELSE 'stable' END AS recommendation FROM c)"""


@query(f"WITH {_CAL} SELECT * FROM cal")
def calibration_by_pack(spark, d):
    return A.calibration(_signals(spark, d))


_RANKED = "CASE recommendation WHEN 'tighten_auto_accept' THEN 1 WHEN 'collect_more_samples' THEN 2 WHEN 'reduce_review_threshold' THEN 3 ELSE 4 END, documents DESC, pack_id"


@query(f"WITH {_CAL} SELECT pack_id, recommendation, documents FROM cal ORDER BY {_RANKED} LIMIT 5")
def first_insights(spark, d):
    return A.insights(A.calibration(_signals(spark, d)), 5).select("pack_id", "recommendation", "documents")


_UP, _AG, _DN = (f"CASE recommendation WHEN 'tighten_auto_accept' THEN {a} WHEN 'reduce_review_threshold' THEN {b} ELSE 0 END" for a, b in ((0.02, -0.01), (0.05, -0.03), (0.01, -0.02)))


@query(f"""WITH {_CAL}, t AS (SELECT *, greatest(0.75, least(0.99, CASE WHEN confidence = 0 THEN 0.85 ELSE confidence END)) AS bc, greatest(0.55, least(0.99, CASE WHEN agreement = 0 THEN 0.85 ELSE agreement END)) AS ba FROM cal WHERE recommendation <> 'stable')
SELECT pack_id, family, country, recommendation, round(greatest(0.82, least(0.995, bc + 0.04 + {_UP})), 6)::DOUBLE AS auto_accept_confidence, round(greatest(0.6, least(0.99, ba + 0.02 + {_AG})), 6)::DOUBLE AS auto_accept_agreement, round(greatest(0.68, least(0.98, bc - 0.03 + {_DN})), 6)::DOUBLE AS accept_with_warning_confidence,
 round(greatest(0.45, least(0.92, ba - 0.15)), 6)::DOUBLE AS review_agreement, round(greatest(0.78, least(0.97, bc - 0.01)), 6)::DOUBLE AS cross_side_confidence FROM t""")
def threshold_recommendations(spark, d):
    return A.threshold_recommendation(A.calibration(_signals(spark, d)))


_SCORE = "18 * corrected + 8 * disagreements + 5 * low_agreement + 6 * abstained + CASE WHEN coalesce(confidence, 1) < 0.85 THEN 6 ELSE 0 END + CASE WHEN decision = 'human_review' THEN 8 ELSE 0 END + CASE WHEN decision = 'auto_accept' AND corrected > 0 THEN 20 ELSE 0 END"


@query(f"WITH {RECORDS}, q AS (SELECT document_id, {_SCORE} AS score FROM s) SELECT document_id, CAST(score AS BIGINT) AS score FROM q WHERE score > 0 ORDER BY score DESC, document_id LIMIT 25")
def learning_queue_topk(spark, d):
    return A.learning_queue(_signals(spark, d)).select("document_id", "score")


@query(f"WITH {_CAL} SELECT (SELECT count(*) FILTER (reviewed) FROM s) AS reviewed_documents, (SELECT least(count(*) FILTER ({_SCORE} > 0), 25) FROM s) AS queue_size, count(*) AS packs_tracked, CAST(sum(false_accepts) AS BIGINT) AS false_accept_corrections FROM cal")
def learning_loop_totals(spark, d):
    return A.learning_loop(_signals(spark, d))


_DUE = f"job = 'failed' AND (next_retry_at IS NULL OR next_retry_at <= TIMESTAMP '{NOW}')"
_SNAP = {
    "documents": "count(*)", **{f"status_{x}": f"count(*) FILTER (status = '{x}')" for x in P.STATUSES}, **{f"decision_{x}": f"count(*) FILTER (decision = '{x}')" for x in P.DECISIONS},
    "jobs": "count(job)", **{f"jobs_{x}": f"count(*) FILTER (job = '{x}')" for x in ("queued", "running", "failed")}, "jobs_dlq": "count(*) FILTER (queue = 'dlq')", "jobs_retry_due": f"count(*) FILTER ({_DUE})",
    "oldest_queued_minutes": f"round(date_diff('second', min(made) FILTER (job = 'queued'), TIMESTAMP '{NOW}') / 60.0, 2)::DOUBLE", "average_confidence": "round(sum(coalesce(confidence, 0)) / count(*), 6)", "average_agreement": "round(sum(agreed) / sum(consensus_fields), 6)",
    "disagreement_fields": "CAST(sum(disagreements) AS BIGINT)", "review_edits": "CAST(sum(edits) AS BIGINT)", "dataset_eligible": "count(*) FILTER (reviewed)", "review_coverage": "round(count(*) FILTER (reviewed) / count(*), 6)",
}


@query(f"WITH {RECORDS} SELECT " + ", ".join(f"{v} AS {k}" for k, v in _SNAP.items()) + " FROM s")
def ops_snapshot(spark, d):
    return A.ops_snapshot(_signals(spark, d), NOW)


_GAUGE_SQL = _SNAP | {"queue_size": f"(SELECT least(count(*) FILTER ({_SCORE} > 0), 100) FROM s)", "false_accept_corrections": "(SELECT CAST(sum(false_accepts) AS BIGINT) FROM cal)", "packs_needing_calibration": "(SELECT count(*) FILTER (recommendation <> 'stable') FROM cal)"}
_LINES = " UNION ALL ".join(f"SELECT {i} AS place, printf('ocr_{name} %{'d' if not k else f'.{k}f'}', {c}) AS line FROM g" for i, (name, c, k) in enumerate(A.GAUGES))


@query(f"WITH {_CAL}, g AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in _GAUGE_SQL.items()) + f" FROM s) {_LINES}")
def metrics_text(spark, d):
    return A.gauges(_signals(spark, d), NOW)


@query(f"""WITH {RECORDS}, n AS (SELECT l_orderkey AS document_id, CAST(sum(l_linenumber % 3) AS BIGINT) AS c FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1), r AS (SELECT family, n_fields, coalesce(c, 0) + edited AS t FROM s LEFT JOIN n USING (document_id))
SELECT family, count(*) AS documents, count(*) FILTER (t > 0) AS corrected_documents, CAST(sum(t) AS BIGINT) AS corrected_fields, CAST(sum(greatest(n_fields, 1)) AS BIGINT) AS total_fields, round(1 - sum(t) / sum(greatest(n_fields, 1)), 4) AS accuracy, round(count(*) FILTER (t > 0) / count(*), 4) AS correction_rate FROM r GROUP BY 1""")
def accuracy_by_family(spark, d):
    docs = records(spark, d).select("document_id", "family", F.coalesce(F.size("fields"), F.lit(0)).alias("n_fields"), F.size(F.array_distinct(F.transform(P.edits(), lambda e: e["field_name"]))).alias("edited"))
    asked = load(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), (-F.col("o_orderkey")).alias("submission_id"))
    told = load(spark, d, "lineitem").where("l_returnflag = 'N'").select((-F.col("l_orderkey")).alias("submission_id"), (F.col("l_linenumber") % 3).alias("n"))
    return A.accuracy(asked, docs, told)


@query(f"""WITH {RECORDS}, l AS (SELECT document_id, field_name, arg_max(coalesce(value, '~'), ord) AS v, min(ord) AS o FROM f GROUP BY 1, 2)
SELECT document_id, string_agg(field_name || '=' || v, ';' ORDER BY o) AS expected FROM l WHERE document_id IN {_REVIEWED} GROUP BY 1""")
def golden_set(spark, d):
    shown = F.array_join(F.transform(F.map_entries("expected"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("~")))), ";")
    return P.golden_set(records(spark, d)).where(F.size("expected") > 0).select("document_id", shown.alias("expected"))


_ACTUAL = """l AS (SELECT document_id, field_name, arg_max(coalesce(value, '~'), ord) AS expected, arg_min(coalesce(value, '~'), ord) AS own FROM f GROUP BY 1, 2 UNION ALL SELECT document_id, 'extra', 'n1', '~' FROM s WHERE reviewed)"""


def _golden(spark, d):
    """Reviewed records as golden entries, with one more field that no record has; records of even keys alone are there."""
    all_ = records(spark, d)
    golden = P.golden_set(all_).withColumn("expected", F.map_concat(F.coalesce("expected", F.create_map().cast("map<string,string>")), F.create_map(F.lit("extra"), F.lit("n1"))))
    return P.evaluate_golden(golden, all_.where("document_id % 2 = 0"))


_EVAL = f"""{RECORDS}, {_ACTUAL}, m AS (SELECT document_id, expected = CASE WHEN document_id % 2 = 0 THEN own ELSE '~' END AS hit FROM l WHERE document_id IN {_REVIEWED})"""


@query(f"WITH {_EVAL} SELECT document_id, CAST(count(*) FILTER (hit) AS INT) AS matched, CAST(count(*) AS INT) AS total, round(count(*) FILTER (hit) / count(*), 6) AS exact_match_rate FROM m GROUP BY 1")
def golden_evaluation(spark, d):
    return _golden(spark, d).select("document_id", "matched", "total", F.round("exact_match_rate", 6).alias("exact_match_rate"))


@query(f"WITH {_EVAL} SELECT count(DISTINCT document_id) AS documents, count(*) AS total_fields, count(*) FILTER (hit) AS exact_matches, round(count(*) FILTER (hit) / count(*), 6) AS exact_match_rate FROM m")
def golden_totals(spark, d):
    return P.golden_totals(_golden(spark, d)).withColumn("exact_match_rate", F.round("exact_match_rate", 6))


@query(f"""WITH {RECORDS}, x AS (SELECT document_id, string_agg(field_name || '>' || coalesce(new, '~'), ';' ORDER BY created_at, ord) AS edits FROM e GROUP BY 1), y AS (SELECT document_id, string_agg(coalesce(nullif(trim(coalesce(raw, normalized)), ''), '~'), ';' ORDER BY ord) AS source FROM f GROUP BY 1)
SELECT document_id, coalesce(source, '') AS source, coalesce(edits, '') AS edits, (s.edits > 0 OR k % 12 = 0) AND k % 2 = 0 AS review_completed FROM s LEFT JOIN y USING (document_id) LEFT JOIN x USING (document_id) WHERE reviewed""".replace("coalesce(edits, '') AS edits", "coalesce(x.edits, '') AS edits"))
def reviewed_examples(spark, d):
    joined = lambda c, f: F.coalesce(F.array_join(F.transform(c, f), ";"), F.lit(""))
    value = lambda v: F.coalesce(v, F.lit("~"))
    out = P.reviewed_examples(records(spark, d))
    return out.select("document_id", joined("source.fields", lambda f: value(f["value"])).alias("source"), joined("target.edits", lambda e: F.concat(e["field_name"], F.lit(">"), value(e["new"]))).alias("edits"), "review_completed")


_SEEN = "CASE WHEN status = 'review' OR review_required OR decision = 'human_review' THEN 'review' WHEN status = 'rejected' OR decision = 'reject' THEN 'rejected' ELSE 'completed' END"


@query(f"""WITH {RECORDS} SELECT document_id, CASE WHEN processed AND (decision <> 'pending' OR confidence IS NOT NULL) THEN {_SEEN} WHEN job = 'failed' THEN 'failed' WHEN job = 'queued' THEN 'queued' WHEN job = 'running' OR status = 'processing' THEN 'processing' ELSE {_SEEN} END AS status,
 CAST(CASE WHEN k % 10 > 0 AND k % 3 > 1 THEN greatest(0, 1000 * (k % 9 * 7 - k % 5 * 10)) WHEN k % 3 > 0 THEN floor((k % 3) * (k % 7 + 0.5) + 0.5) END AS BIGINT) AS latency_ms, document_id || ':' || coalesce(CASE WHEN k % 2 = 0 THEN 'h' || k END, 'no-hash') || ':' || family || ':' || country || ':' || coalesce(variant, 'no-variant') AS idempotency_key, CASE decision WHEN 'reject' THEN 'rejected' WHEN 'human_review' THEN 'review' ELSE 'completed' END AS decided FROM s""")
def submission_status(spark, d):
    return records(spark, d).select("document_id", P.submission_status().alias("status"), P.latency_ms().alias("latency_ms"), P.idempotency_key().alias("idempotency_key"), P.decision_status(F.col("decision")).alias("decided"))


@query(f"WITH {RECORDS} SELECT document_id, coalesce(reviewed, false) AS reviewed, review_required OR status = 'review' AS in_review_queue, k % 3 = 2 AS report_ready, decision <> 'pending' AS processed, processed AND decision <> 'pending' AND confidence IS NOT NULL AND n_fields > 0 AND k % 2 = 1 AS materialised FROM s")
def record_filters(spark, d):
    return records(spark, d).select("document_id", P.reviewed().alias("reviewed"), P.in_review_queue().alias("in_review_queue"), P.report_ready().alias("report_ready"), P.processed().alias("processed"), P.materialised().alias("materialised"))


@query(f"""WITH {RECORDS} SELECT document_id, k % 3 = 2 AND NOT old90 AS report, CASE WHEN edits > 0 OR k % 12 = 0 THEN CASE WHEN old180 THEN 0 ELSE 1 END ELSE 0 END AS sessions, (k % 3 = 2 AND old90) OR ((edits > 0 OR k % 12 = 0) AND old180) AS changed
FROM (SELECT *, made < TIMESTAMP '{NOW}' - to_days(90) AS old90, made < TIMESTAMP '{NOW}' - to_days(180) AS old180 FROM s)""")
def retention(spark, d):
    return P.retain(records(spark, d), NOW).select("document_id", P.report_ready().alias("report"), F.size("sessions").alias("sessions"), "changed")


@query(f"WITH {RECORDS} SELECT document_id, row_number() OVER (ORDER BY made DESC, k) AS place FROM s WHERE job IS NOT NULL")
def job_feed(spark, d):
    jobs = P.job_feed(records(spark, d)).select("document_id", (-F.unix_micros(F.col("job.created_at").cast("timestamp"))).alias("newest"), "ord")
    return numbered(jobs, [F.col("newest"), F.col("ord")]).select("document_id", (F.col("place") + 1).alias("place"))


@query(f"WITH {RECORDS}, w AS (SELECT * FROM s WHERE k % 20 < 3), r AS (SELECT 's' || (k % 3) AS x, min(k) AS o FROM w WHERE k % 5 > 0 GROUP BY 1) SELECT 7 AS requested, count(*) AS processed, count(*) FILTER (job = 'completed') AS completed, count(*) FILTER (job = 'failed') AS failed, count(*) FILTER (queue = 'dlq') AS sent_to_dlq, count(*) FILTER (decision = 'human_review') AS review, count(*) FILTER (decision = 'auto_accept') AS auto_accepted, count(*) FILTER (decision = 'accept_with_warning') AS accept_with_warning, (SELECT string_agg(x, ',' ORDER BY o) FROM r) AS routing_strategies FROM w")
def worker_summary(spark, d):
    return P.worker_summary(records(spark, d).where("document_id % 20 < 3"), 7)


def _cell(c):
    return f"CASE WHEN regexp_matches(coalesce(CAST({c} AS VARCHAR), ''), '[\",\\n]') THEN '\"' || replace({c}, '\"', '\"\"') || '\"' ELSE coalesce(CAST({c} AS VARCHAR), '') END"


@query(f"WITH {RECORDS} SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY ord) - 1 AS INT) AS place, document_id || ',file-' || document_id || ',,,' || field_name || ',' || upper(substr(field_name, 1, 1)) || substr(field_name, 2) || ',' || {_cell('normalized')} || ',' || coalesce(raw, '') || ',' || CAST(confidence AS VARCHAR) || ',' || page || ',' || engine || ',,,,,0,' || coalesce(CAST(agreement AS VARCHAR), '') || ',' || coalesce(CASE WHEN agreement IS NOT NULL THEN CAST(disagreement AS VARCHAR) END, '') AS line FROM f")
def field_export(spark, d):
    return P.field_csv_lines(records(spark, d))


_MASKED = "CASE WHEN length({v}) <= 4 THEN repeat('*', length({v})) ELSE substr({v}, 1, 2) || repeat('*', greatest(4, length({v}) - 4)) || right({v}, 2) END"
_HIDE = "CASE WHEN field_name = 'run' THEN {m} WHEN field_name = 'nombre-completo' THEN array_to_string(list_transform(list_filter(string_split({c}, ' '), lambda w: w <> ''), lambda w: substr(w, 1, 1) || '***'), ' ') ELSE {c} END"


def _hidden(c):
    bare = f"replace({c}, ' ', '')"
    return _HIDE.format(c=c, m=_MASKED.format(v=bare))


@query(f"WITH {RECORDS} SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY ord) - 1 AS INT) AS place, {_hidden('normalized')} AS value, {_hidden('raw')} AS raw FROM f")
def redacted_fields(spark, d):
    rows = P.redact_record(records(spark, d)).select("document_id", F.posexplode("fields").alias("place", "f"))
    return rows.select("document_id", "place", F.col("f.normalized").alias("value"), F.col("f.raw").alias("raw"))


@query(f"WITH {RECORDS}, n AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ord) AS rn FROM f WHERE field_name IN ('run', 'nombre-completo', 'sexo', 'fecha-de-emision')), g AS (SELECT document_id, string_agg(field_name, ',' ORDER BY ord) AS shown FROM n WHERE rn <= 12 GROUP BY 1) SELECT document_id, coalesce(shown, '') AS shown, CAST(least(k % 4 + 1, 3) AS INT) AS n_issues, CAST(k % 2 AS INT) AS n_sections FROM s LEFT JOIN g USING (document_id)")
def result_summary(spark, d):
    out = P.result_summary(records(spark, d))
    return out.select("document_id", F.coalesce(F.array_join(F.transform("key_fields", lambda f: f["field_name"]), ","), F.lit("")).alias("shown"), "n_issues", "n_sections")


@query(f"WITH {RECORDS} SELECT f.document_id, f.ord, CASE WHEN field_name = 'run' THEN 'i-Run' WHEN field_name = 'sexo' AND document_id % 4 >= 1 THEN 'i-sexo' ELSE '' END AS issues FROM f JOIN d USING (document_id)")
def linked_issues(spark, d):
    order = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), _place().alias("ord"), _pick(F.col("l_partkey") % 5, _FIELD_NAMES).alias("name"))
    named = records(spark, d).select("document_id", "issues")
    return order.join(named, "document_id").select("document_id", "ord", F.array_join(P.link_issues(F.initcap("name"), F.col("name"), F.col("issues")), ",").alias("issues"))


@query("SELECT l_orderkey AS document_id, l_linenumber AS ord, least(l_quantity, l_tax * 100) AS x, least(l_discount * 100, l_quantity) AS y, abs(l_quantity - l_tax * 100) AS width, abs(l_discount * 100 - l_quantity) AS height FROM lineitem")
def bounding_boxes(spark, d):
    q, t, e = F.col("l_quantity").cast("double"), F.col("l_tax") * 100, F.col("l_discount") * 100
    box = P.bounding_box(F.array(F.array(q, e), F.array(t, q)))
    return load(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("ord"), box.alias("b")).select("document_id", "ord", "b.*")
