"""Fleet analytics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import insights as N
from .registry import LEDGER, STRATEGIES, ledger, load, query, strategies

FROM, TO = "2024-01-05 00:00:00", "2024-01-25 12:00:00"
_RANGE = f"created_at BETWEEN TIMESTAMP '{FROM}' AND TIMESTAMP '{TO}'"


@query(f"WITH {LEDGER} SELECT strftime(created_at, '%Y-%m-%d') AS day, CAST(sum(units) AS BIGINT) AS documents FROM ledger WHERE terminal AND {_RANGE} GROUP BY 1")
def usage_by_day(spark, d):
    return A.usage_by(A.in_range(ledger(spark, d), FROM, TO), F.date_format("created_at", "yyyy-MM-dd"), "day")


@query(f"WITH {LEDGER} SELECT coalesce(family, 'unclassified') AS family, CAST(sum(units) AS BIGINT) AS documents FROM ledger WHERE terminal GROUP BY 1")
def usage_by_family(spark, d):
    return A.usage_by(ledger(spark, d), F.col("family"), "family")


@query(f"WITH {LEDGER} SELECT CAST(sum(units) FILTER (terminal) AS BIGINT) AS terminal_documents, CAST(sum(bytes) AS BIGINT) AS ingested_bytes, count(DISTINCT submission_id) AS submissions FROM ledger WHERE {_RANGE}")
def usage_totals(spark, d):
    return A.usage_totals(A.in_range(ledger(spark, d), FROM, TO))


_LAT = "list_sort(list(latency_ms))[CAST(floor((count(*) - 1) * {}) AS BIGINT) + 1]"
_LATENCY = f"{_LAT.format(0.5)} AS p50, {_LAT.format(0.9)} AS p90, {_LAT.format(0.99)} AS p99, CAST(floor(avg(latency_ms) + 0.5) AS BIGINT) AS mean, count(*) AS n"


@query(f"WITH {LEDGER} SELECT event_type, {_LATENCY} FROM ledger WHERE terminal AND latency_ms IS NOT NULL AND {_RANGE} GROUP BY 1")
def latency_percentiles(spark, d):
    return A.latency(A.in_range(ledger(spark, d), FROM, TO), "event_type")


_DEC = """count(*) FILTER (decision = 'auto_accept') AS auto_accept, count(*) FILTER (decision = 'accept_with_warning') AS accept_with_warning, count(*) FILTER (decision = 'human_review') AS human_review, count(*) FILTER (decision = 'reject') AS reject, count(*) AS total,
 round(count(*) FILTER (decision = 'auto_accept') / count(*), 6) AS straight_through_rate, round(count(*) FILTER (decision = 'human_review') / count(*), 6) AS review_rate, round(count(*) FILTER (decision = 'reject') / count(*), 6) AS reject_rate"""


@query(f"WITH {LEDGER} SELECT client, {_DEC} FROM ledger GROUP BY 1")
def decision_rates(spark, d):
    return A.decisions(ledger(spark, d), "client")


_PRICE = "CASE l_linenumber % 4 WHEN 0 THEN 0.0015 WHEN 1 THEN 0.05 WHEN 2 THEN 0.045 ELSE 0 END"


@query(f"SELECT document_id, round(sum(p) + 0.0035 * max(a), 6)::DOUBLE AS cost FROM (SELECT l_orderkey AS document_id, CAST({_PRICE} AS DOUBLE) AS p, count(*) FILTER (l_returnflag = 'A') AS n FROM lineitem GROUP BY 1, l_linenumber % 4, 2) x JOIN (SELECT l_orderkey AS k, count(*) FILTER (l_returnflag = 'A') AS a FROM lineitem GROUP BY 1) y ON x.document_id = y.k GROUP BY 1")
def cost_by_document(spark, d):
    i, e = load(spark, d, "lineitem"), F.col("l_linenumber") % 4
    engine = F.when(e == 0, "rapidocr").when(e == 1, "google-documentai").when(e == 2, "azure-document-intelligence").otherwise("unknown")
    docs = i.groupBy(F.col("l_orderkey").alias("document_id")).agg(F.array_sort(F.collect_set(engine)).alias("engines"), F.count_if(F.col("l_returnflag") == "A").alias("a"))
    return docs.select("document_id", A.processing_cost(F.col("engines"), F.col("a")).alias("cost"))


@query(f"SELECT CASE l_linenumber % 4 WHEN 0 THEN 'rapidocr' WHEN 1 THEN 'google-documentai' WHEN 2 THEN 'azure-document-intelligence' ELSE 'unknown' END AS engine, count(DISTINCT l_orderkey) AS documents, round(count(DISTINCT l_orderkey) * {_PRICE.replace('l_linenumber % 4', 'min(l_linenumber % 4)')}, 4)::DOUBLE AS cost FROM lineitem GROUP BY 1")
def cost_by_engine(spark, d):
    i, e = load(spark, d, "lineitem"), F.col("l_linenumber") % 4
    engine = F.when(e == 0, "rapidocr").when(e == 1, "google-documentai").when(e == 2, "azure-document-intelligence").otherwise("unknown")
    per = i.groupBy(engine.alias("engine")).agg(F.count_distinct("l_orderkey").alias("documents"))
    return per.select("engine", "documents", F.round(F.col("documents") * A.processing_cost(F.array("engine"), F.lit(0)), 4).alias("cost"))


@query(f"""WITH {STRATEGIES}, s AS (SELECT *, round(0.6 * exact + 0.2 * stp + 0.15 * agreement + 0.05 * (1 - review) - 0.12 * cost / max(cost) OVER (), 6) AS score FROM strat)
SELECT strategy, score, row_number() OVER (ORDER BY score DESC, ord) = 1 AS recommended FROM s""")
def routing_score(spark, d):
    return A.routing_scores(strategies(spark, d)).select("strategy", "score", "recommended")


@query(f"WITH {STRATEGIES} SELECT strategy, row_number() OVER (ORDER BY exact DESC, stp DESC, confidence DESC, strategy) AS rank FROM strat")
def leaderboard_rank(spark, d):
    return A.leaderboard(strategies(spark, d)).select("strategy", F.col("rank").cast("long").alias("rank"))


@query("SELECT l_suppkey % 7 AS strategy, l_returnflag AS pack, count(*) AS n, round(avg(l_discount), 6) AS review FROM lineitem GROUP BY GROUPING SETS ((1), (1, 2))")
def routing_grouping_sets(spark, d):
    rows = load(spark, d, "lineitem").select((F.col("l_suppkey") % 7).alias("strategy"), F.col("l_returnflag").alias("pack"), "l_discount")
    return A.benchmark(rows, "strategy", "pack", n=F.count("*"), review=F.round(F.avg("l_discount"), 6))


@query("""WITH r AS (SELECT o_custkey AS action, o_orderpriority AS key, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
SELECT action, key, max(v) FILTER (rn = 1) AS latest, max(v) FILTER (rn = 2) AS previous, round(max(v) FILTER (rn = 1) - max(v) FILTER (rn = 2), 6) AS change FROM r WHERE rn <= 2 GROUP BY 1, 2 HAVING count(*) = 2""")
def snapshot_diff(spark, d):
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("action"), F.col("o_orderpriority").alias("key"), F.col("o_totalprice").alias("v"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("id"))
    return A.snapshot_diff(o, "key", "v")


@query("SELECT CAST(o_orderkey AS BIGINT) AS volume, CAST(0.006875 AS DECIMAL(12,6)) AS unit_cost, CAST(round(o_orderkey * 0.006875, 2) AS DECIMAL(18,2)) AS monthly_cost FROM orders")
def monthly_cost(spark, d):
    shares = {"local": (0.5, 0.00375), "cloud": (0.1, 0.05)}
    return A.monthly_cost(load(spark, d, "orders").select(F.col("o_orderkey").alias("volume")), shares)


@query("""SELECT s.s_suppkey AS id, coalesce(n, 0) AS parts, coalesce(q, 0)::DOUBLE AS quantity FROM supplier s LEFT JOIN (SELECT l_suppkey, count(DISTINCT l_partkey) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY 1) x ON s.s_suppkey = x.l_suppkey""")
def hydrate_children(spark, d):
    kids = load(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))
    s = load(spark, d, "supplier")
    return s.join(kids, s["s_suppkey"] == kids["l_suppkey"], "left").select(F.col("s_suppkey").alias("id"), F.coalesce("n", F.lit(0)).alias("parts"), F.coalesce("q", F.lit(0.0)).alias("quantity"))


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def tenant_semi_join(spark, d):
    c, o = load(spark, d, "customer"), load(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_semi").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


_RESULTS = """r AS (SELECT CASE WHEN l_suppkey % 7 > 0 THEN 'f' || (l_suppkey % 3) END AS family, CASE WHEN l_partkey % 5 > 0 THEN 'c' || (l_partkey % 5) ELSE '' END AS capture_condition, ['auto_accept', 'accept_with_warning', 'human_review', 'reject'][l_linenumber % 4 + 1] AS decision, 1 - l_tax * 1.037 AS conf, l_discount * 9.13 AS exact, CASE WHEN l_linenumber > 2 THEN l_tax * 7.31 END AS tabled FROM lineitem)"""
_GROUP = """count(*) AS documents, round(avg(conf), 4) AS average_confidence, round(avg(exact), 4) AS exact_match_rate, round(avg(coalesce(tabled, 0)), 4) AS table_match_rate, count(*) FILTER (decision = 'accept_with_warning') AS accept_with_warning, count(*) FILTER (decision = 'human_review') AS human_review, count(*) FILTER (decision = 'auto_accept') AS auto_accept"""
_HEADLINE = """count(*) AS documents, round(avg(conf), 4) AS average_confidence, round(avg(exact), 4) AS average_exact_match_rate, round(avg(coalesce(tabled, 0)), 4) AS average_table_match_rate, round(avg(conf) - avg(exact), 4) AS confidence_exact_gap, round(count(*) FILTER (decision IN ('auto_accept', 'accept_with_warning')) / count(*), 4) AS straight_through_rate, round(count(*) FILTER (decision = 'human_review') / count(*), 4) AS review_rate, round(count(*) FILTER (decision = 'reject') / count(*), 4) AS reject_rate"""


def _results(spark, d):
    c = F.col
    text = lambda a, b: F.concat(F.lit(a), b.cast("string"))
    return load(spark, d, "lineitem").select(
        F.when(c("l_suppkey") % 7 > 0, text("f", c("l_suppkey") % 3)).alias("family"), F.when(c("l_partkey") % 5 > 0, text("c", c("l_partkey") % 5)).otherwise("").alias("capture_condition"),
        F.element_at(F.array(*map(F.lit, ("auto_accept", "accept_with_warning", "human_review", "reject"))), (c("l_linenumber") % 4 + 1).cast("int")).alias("decision"),
        (1 - c("l_tax") * 1.037).alias("global_confidence"), (c("l_discount") * 9.13).alias("exact_match_rate"), F.when(c("l_linenumber") > 2, c("l_tax") * 7.31).alias("table_match_rate"),
    )


@query(f"WITH {_RESULTS} " + " UNION ALL ".join(f"SELECT '{k}' AS dimension, coalesce(nullif({k}, ''), 'unknown') AS bucket, {_GROUP} FROM r GROUP BY 2" for k in ("family", "capture_condition", "decision")))
def grouped_eval(spark, d):
    return N.evaluation_groups(_results(spark, d), "family", "capture_condition", "decision")


@query(f"WITH {_RESULTS} SELECT {_HEADLINE} FROM r")
def evaluation_headline(spark, d):
    return N.evaluation_headline(_results(spark, d))


@query("""SELECT source, count(*) AS documents, string_agg(DISTINCT coalesce(lang, 'unknown'), ',' ORDER BY coalesce(lang, 'unknown')) AS capture_conditions, string_agg(DISTINCT CASE WHEN doc_id % 3 > 0 THEN 's' || (doc_id % 3) ELSE 'unspecified' END, ',' ORDER BY CASE WHEN doc_id % 3 > 0 THEN 's' || (doc_id % 3) ELSE 'unspecified' END) AS splits,
 'unspecified' AS benchmark_profiles, string_agg('f' || (doc_id % 4), ',' ORDER BY doc_id % 4) AS families, string_agg(CASE WHEN doc_id % 2 = 0 THEN 'CL' ELSE 'XX' END, ',' ORDER BY CASE WHEN doc_id % 2 = 0 THEN 'CL' ELSE 'XX' END) AS countries FROM documents GROUP BY 1""")
def registry_profile(spark, d):
    k = F.col("doc_id")
    text = lambda a, b: F.concat(F.lit(a), b.cast("string"))
    rows = load(spark, d, "documents").select("source", F.col("lang").alias("capture_condition"), F.when(k % 3 > 0, text("s", k % 3)).otherwise("").alias("split"), F.lit(None).cast("string").alias("benchmark_profile"), text("f", k % 4).alias("family"), F.when(k % 2 == 0, "CL").alias("country"))
    out = N.registry_profile(rows, "source")
    return out.withColumns({c: F.array_join(c, ",") for c in out.columns if c not in ("source", "documents")})


@query("SELECT l.quality, l.toxic, count(*) AS n, round(avg(d.n_chars), 4) AS mean_chars FROM labels l JOIN documents d USING (doc_id) GROUP BY 1, 2")
def review_outcomes(spark, d):
    return load(spark, d, "labels").join(load(spark, d, "documents"), "doc_id").groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))


_RUN_ENGINES = (" RapidOCR", "google-documentai", "azure-document-intelligence", "")
_COSTED = """l AS (SELECT DISTINCT l_orderkey AS k, CASE l_linenumber % 4 WHEN 0 THEN 'rapidocr' WHEN 1 THEN 'google-documentai' WHEN 2 THEN 'azure-document-intelligence' ELSE 's' || (l_suppkey % 2) END AS e FROM lineitem), p AS (SELECT *, CASE e WHEN 'rapidocr' THEN 0.0015 WHEN 'google-documentai' THEN 0.05 WHEN 'azure-document-intelligence' THEN 0.045 ELSE 0 END AS price, e IN ('google-documentai', 'azure-document-intelligence') AS premium FROM l),
d AS (SELECT o_orderkey AS k, 'pack-' || (o_orderkey % 9) AS pack, CASE WHEN o_orderkey % 5 > 0 THEN 's' || (o_orderkey % 3) ELSE 'unknown' END AS strategy, o_orderkey % 4 AS adj, o_orderkey % 7 < 3 AS straight, coalesce(c, 0) + 0.0035 * (o_orderkey % 4) AS cost, coalesce(premium, false) AS premium FROM orders LEFT JOIN (SELECT k, sum(price) AS c, bool_or(premium) AS premium FROM p GROUP BY 1) x ON x.k = o_orderkey WHERE o_orderkey % 7 > 0)"""
_SUMS = "count(*) AS documents, round(sum(cost), 6)::DOUBLE AS cost, round(sum(cost) / count(*), 6)::DOUBLE AS cost_per_document, CAST(sum(adj) AS BIGINT) AS adjudicated, count(*) FILTER (premium) AS escalations, round(count(*) FILTER (straight) / count(*), 6) AS straight_through_rate"


def _costed(spark, d):
    """Documents with their runs; every seventh is pending."""
    i = load(spark, d, "lineitem")
    run = F.struct(F.element_at(F.array(*map(F.lit, _RUN_ENGINES)), (F.col("l_linenumber") % 4 + 1).cast("int")).alias("engine"), F.concat(F.lit("S"), (F.col("l_suppkey") % 2).cast("string")).alias("source"))
    runs = i.groupBy("l_orderkey").agg(F.collect_list(run).alias("runs"))
    o, k = load(spark, d, "orders"), F.col("o_orderkey")
    text = lambda a, b: F.concat(F.lit(a), b.cast("string"))
    decision = F.when(k % 7 == 0, "pending").when(k % 7 == 1, "auto_accept").when(k % 7 == 2, "accept_with_warning").otherwise("human_review")
    rows = o.join(runs, o["o_orderkey"] == runs["l_orderkey"], "left")
    return rows.select(k.alias("document_id"), text("pack-", k % 9).alias("pack_id"), F.when(k % 5 > 0, text("s", k % 3)).alias("strategy"), decision.alias("decision"), (k % 4).alias("adjudicated"), F.coalesce("runs", F.array().cast("array<struct<engine:string,source:string>>")).alias("runs"))


@query(f"""WITH {_COSTED} SELECT 'total' AS what, NULL AS key, {_SUMS} FROM d UNION ALL SELECT 'pack', pack, {_SUMS} FROM d GROUP BY 2 UNION ALL SELECT 'strategy', strategy, {_SUMS} FROM d GROUP BY 2
UNION ALL SELECT 'engine', e, count(*), round(count(*) * min(price), 6)::DOUBLE, round(min(price), 6)::DOUBLE, NULL, NULL, NULL FROM p JOIN d ON d.k = p.k GROUP BY 2""")
def cost_insights(spark, d):
    return N.cost_insights(_costed(spark, d))


@query(f"WITH {_COSTED} SELECT pack AS key, round(sum(cost), 6)::DOUBLE AS cost FROM d GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def dearest_packs(spark, d):
    return N.dearest_packs(N.cost_insights(_costed(spark, d))).select("key", "cost")


_MEASURES = """count(*) AS documents, round(sum(matched) / sum(total), 6) AS exact_match_rate, round(count(*) FILTER (dec < 2) / count(*), 6) AS straight_through_rate, round(count(*) FILTER (dec = 2) / count(*), 6) AS review_rate, round(count(*) FILTER (dec = 3) / count(*), 6) AS reject_rate, round(avg(coalesce(conf, 0)), 6) AS average_confidence,
 round(sum(agreed) / sum(voted), 6) AS average_agreement, round(sum(dis) / sum(voted), 6) AS disagreement_rate, round(sum(cost), 4)::DOUBLE AS total_cost, round(sum(cost) / count(*), 6)::DOUBLE AS cost_per_document"""
_EVALUATED = "r AS (SELECT 's' || (l_suppkey % 4) AS strategy, 'p' || (l_partkey % 5) AS pack, l_linenumber % 5 AS dec, CASE WHEN l_tax > 0.01 THEN 1 - l_tax END AS conf, least(l_linenumber, 4) AS matched, 5 AS total, l_discount * 10 AS agreed, 1 + l_linenumber % 2 AS voted, l_linenumber % 2 AS dis, l_extendedprice / 100000 AS cost FROM lineitem)"


def _evaluated(spark, d):
    c, i = F.col, load(spark, d, "lineitem")
    text = lambda a, b: F.concat(F.lit(a), b.cast("string"))
    decision = F.element_at(F.array(*map(F.lit, ("auto_accept", "accept_with_warning", "human_review", "reject", "pending"))), (c("l_linenumber") % 5 + 1).cast("int"))
    return i.select(
        text("s", c("l_suppkey") % 4).alias("strategy"), text("p", c("l_partkey") % 5).alias("pack"), decision.alias("decision"), F.when(c("l_tax") > 0.01, 1 - c("l_tax")).alias("confidence"), F.least(c("l_linenumber"), F.lit(4)).alias("matched"), F.lit(5).alias("total"),
        (c("l_discount") * 10).alias("agreed"), (1 + c("l_linenumber") % 2).alias("voted"), (c("l_linenumber") % 2).alias("disagreements"), (c("l_extendedprice") / 100000).alias("cost"),
    )


@query(f"WITH {_EVALUATED} SELECT strategy, pack, {_MEASURES} FROM r GROUP BY GROUPING SETS ((strategy), (strategy, pack))")
def routing_benchmark(spark, d):
    return N.evaluated(_evaluated(spark, d), ["strategy"], ["strategy", "pack"])


@query(f"WITH {_EVALUATED}, m AS (SELECT strategy, {_MEASURES} FROM r GROUP BY 1) SELECT strategy, row_number() OVER (ORDER BY exact_match_rate DESC, straight_through_rate DESC, average_confidence DESC, strategy) AS rank, exact_match_rate, straight_through_rate, reject_rate, disagreement_rate FROM m")
def golden_leaderboard(spark, d):
    m = N.evaluated(_evaluated(spark, d), ["strategy"]).withColumnsRenamed({"exact_match_rate": "exact", "straight_through_rate": "stp", "average_confidence": "confidence"})
    return A.leaderboard(m).select("strategy", F.col("rank").cast("long").alias("rank"), F.col("exact").alias("exact_match_rate"), F.col("stp").alias("straight_through_rate"), "reject_rate", "disagreement_rate")


@query("""WITH s AS (SELECT o_custkey % 3 AS kind, o_custkey AS c, o_orderkey AS id, o_orderkey % 40 AS q, o_orderkey % 7 AS f, o_orderkey % 3 AS t, o_orderkey % 2 AS best, (o_orderkey % 50) / 100.0 AS x, (o_orderkey % 30) / 100.0 AS y, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders),
w AS (SELECT c, kind, max(q) FILTER (rn = 1) AS q1, max(q) FILTER (rn = 2) AS q2, max(f) FILTER (rn = 1) AS f1, max(f) FILTER (rn = 2) AS f2, max(t) FILTER (rn = 1) AS t1, max(t) FILTER (rn = 2) AS t2, max(best) FILTER (rn = 1) AS b1, max(best) FILTER (rn = 2) AS b2, max(x) FILTER (rn = 1) AS x1, max(x) FILTER (rn = 2) AS x2, max(y) FILTER (rn = 1) AS y1, max(y) FILTER (rn = 2) AS y2 FROM s WHERE rn <= 2 GROUP BY 1, 2 HAVING count(*) = 2)
SELECT 'learning_loop.' || c AS action, unnest(['queue_delta', 'false_accept_delta', 'tighten_delta']) AS metric, unnest([q1 - q2, f1 - f2, t1 - t2])::DOUBLE AS value, NULL AS text FROM w WHERE kind = 0
UNION ALL SELECT 'cost.' || c, unnest(['cost_per_document_delta', 'adjudicated_fields_delta', 'escalation_rate_delta']), unnest([round(x1 - x2, 6), f1 - f2, round(y1 - y2, 6)])::DOUBLE, NULL FROM w WHERE kind = 2
UNION ALL SELECT 'routing.' || c, unnest(['recommended', 'recommended_before', 'best_improvement', 'exact_match_delta', 'straight_through_delta', 'cost_delta']), unnest([NULL, NULL, NULL, CASE WHEN x1 - x2 >= y1 - y2 THEN round(x1 - x2, 6) ELSE round(y1 - y2, 6) END, CASE WHEN x1 - x2 >= y1 - y2 THEN round(y1 - y2, 6) ELSE round(x1 - x2, 6) END, CASE WHEN x1 - x2 >= y1 - y2 THEN round(y1 - y2, 6) ELSE 0 END])::DOUBLE, unnest(['b' || b1, 'b' || b2, CASE WHEN x1 - x2 >= y1 - y2 THEN 'a' ELSE 'b' END, NULL, NULL, NULL]) FROM w WHERE kind = 1""")
def snapshot_changes(spark, d):
    o, k = load(spark, d, "orders"), F.col("o_orderkey")
    x, y, kind = (k % 50) / 100, (k % 30) / 100, F.col("o_custkey") % 3
    loop = F.to_json(F.struct(F.struct(F.struct((k % 40).alias("queueSize"), (k % 7).alias("falseAcceptCorrections")).alias("totals"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(F.when(i < k % 3, "tighten_auto_accept").otherwise("stable").alias("recommendation"))).alias("calibrationInsights")).alias("snapshot")))
    result = lambda name, a, b, c: F.struct(F.lit(name).alias("strategy"), a.alias("exactMatchRate"), b.alias("straightThroughRate"), c.cast("double").alias("estimatedCostPerDocument"))
    routing = F.to_json(F.struct(F.struct(F.concat(F.lit("b"), (k % 2).cast("string")).alias("strategy")).alias("recommendedOverall"), F.array(result("a", x, y, y), result("b", y, x, F.lit(1.0))).alias("results")))
    cost = F.to_json(F.struct(F.struct(x.alias("estimatedCostPerDocument"), (k % 7).alias("totalOpenaiFields"), y.alias("premiumEscalationRate")).alias("totals")))
    name = F.concat(F.when(kind == 0, "learning_loop.").when(kind == 1, "routing.").otherwise("cost."), F.col("o_custkey").cast("string"))
    rows = o.select(name.alias("action"), F.when(kind == 0, loop).when(kind == 1, routing).otherwise(cost).alias("payload"), F.col("o_orderdate").alias("created_at"), k.alias("id"))
    return N.compare_snapshots(rows)


@query("SELECT l_orderkey AS document_id, 'stage' || (l_linenumber % 3) AS stage, CAST(date_diff('millisecond', min(l_shipdate) FILTER (l_suppkey % 2 = 0), max(l_shipdate) FILTER (l_suppkey % 2 = 1)) AS BIGINT) AS duration_ms FROM lineitem GROUP BY 1, 2")
def stage_trace(spark, d):
    c = F.col
    events = load(spark, d, "lineitem").select(c("l_orderkey").alias("document_id"), F.concat(F.lit("stage"), (c("l_linenumber") % 3).cast("string")).alias("stage"), F.when(c("l_suppkey") % 2 == 0, "start").otherwise("finish").alias("kind"), c("l_shipdate").cast("timestamp").alias("at"))
    return N.stage_trace(events).select("document_id", "stage", "duration_ms")
