"""Registration of queries, and the logical views over the physical tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt evenly, some tasks a core: for work that costs far more than moving its rows.

    A scan's splits say little of its rows: a row group is read by one task,
    however many splits its file has.
    """
    return rows.repartition(max(3 * rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()))


DECISION = {"purchase": "auto_accept", "click": "accept_with_warning", "view": "human_review", "error": "reject"}


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage events from ``events``: purchases and errors are terminal."""
    e = load(spark, sf_dir, "events")
    kind, u = F.col("event_type"), F.col("user_id") % 5
    decision = F.lit("pending")
    for k, v in DECISION.items():
        decision = F.when(kind == k, v).otherwise(decision)
    return e.select(
        "event_id", F.col("ts").alias("created_at"), F.col("user_id").alias("client"), "event_type", kind.isin("purchase", "error").alias("terminal"),
        F.col("value").alias("latency_ms"), F.get_json_object("props", "$.k").cast("long").alias("bytes"), F.lit(1).alias("units"),
        F.when(F.col("event_id") % 7 > 0, F.col("event_id") % 997).alias("submission_id"), decision.alias("decision"),
        F.when(u == 0, "identity").when(u == 1, "certificate").when(u == 2, "passport").when(u == 3, "driver-license").alias("family"),
    )


LEDGER = """ledger AS (SELECT event_id, ts AS created_at, user_id AS client, event_type, event_type IN ('purchase','error') AS terminal, value AS latency_ms,
 CAST(json_extract_string(props,'$.k') AS BIGINT) AS bytes, 1 AS units, CASE WHEN event_id % 7 > 0 THEN event_id % 997 END AS submission_id,
 CASE event_type WHEN 'purchase' THEN 'auto_accept' WHEN 'click' THEN 'accept_with_warning' WHEN 'view' THEN 'human_review' WHEN 'error' THEN 'reject' ELSE 'pending' END AS decision,
 CASE user_id % 5 WHEN 0 THEN 'identity' WHEN 1 THEN 'certificate' WHEN 2 THEN 'passport' WHEN 3 THEN 'driver-license' END AS family FROM events)"""


def doc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document records from ``orders``: status, decision, confidence and review signals are functions of the row."""
    o, k = load(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select(
        k.alias("document_id"), k.alias("ord"), F.concat_ws("-", F.lit("pack"), (k % 16).cast("string")).alias("pack_id"), F.concat(F.lit("family"), (k % 4).cast("string")).alias("family"),
        F.when(k % 11 > 0, F.round(0.5 + (k % 50) / 100, 2)).alias("confidence"), F.when(k % 3 == 0, "auto_accept").when(k % 3 == 1, "human_review").otherwise("reject").alias("decision"),
        (k % 2 == 0).alias("reviewed"), (k % 5 - 2).alias("c0"), (k % 7 + 1).alias("n_fields"), F.round(0.6 + (k % 40) / 100, 2).alias("agreement"),
        (k % 3).alias("disagreements"), (k % 4).alias("low_agreement"), (k % 2).alias("abstained"), "o_orderdate", "o_custkey",
        F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "F", "completed").otherwise("review").alias("status"),
    ).withColumn("corrected", F.greatest("c0", F.lit(0))).drop("c0")


DOCS = """docs AS (SELECT o_orderkey AS document_id, o_orderkey AS ord, 'pack-' || (o_orderkey % 16) AS pack_id, 'family' || (o_orderkey % 4) AS family,
 CASE WHEN o_orderkey % 11 > 0 THEN round(0.5 + (o_orderkey % 50) / 100.0, 2) END::DOUBLE AS confidence, CASE o_orderkey % 3 WHEN 0 THEN 'auto_accept' WHEN 1 THEN 'human_review' ELSE 'reject' END AS decision,
 o_orderkey % 2 = 0 AS reviewed, greatest(o_orderkey % 5 - 2, 0) AS corrected, o_orderkey % 7 + 1 AS n_fields, round(0.6 + (o_orderkey % 40) / 100.0, 2)::DOUBLE AS agreement,
 o_orderkey % 3 AS disagreements, o_orderkey % 4 AS low_agreement, o_orderkey % 2 AS abstained, o_orderdate, o_custkey,
 CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'completed' ELSE 'review' END AS status FROM orders)"""


def strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per routing strategy (seven, by ship key) measures from ``lineitem``."""
    i = load(spark, sf_dir, "lineitem").withColumn("s", (F.col("l_suppkey") % 7).cast("int"))
    return i.groupBy(F.concat(F.lit("strategy"), F.col("s").cast("string")).alias("strategy"), F.col("s").alias("ord")).agg(
        F.round(F.count_if(F.col("l_returnflag") == "N") / F.count("*"), 4).alias("exact"), F.round(F.count_if(F.col("l_linestatus") == "O") / F.count("*"), 4).alias("stp"),
        F.round(1 - F.avg("l_discount"), 4).alias("agreement"), F.round(F.avg("l_tax"), 4).alias("review"), F.round(F.avg("l_extendedprice") / 1000000, 4).alias("cost"), F.round(F.avg("l_quantity") / 50, 4).alias("confidence"),
    )


STRATEGIES = """strat AS (SELECT 'strategy' || (l_suppkey % 7) AS strategy, CAST(l_suppkey % 7 AS INT) AS ord, round(count(*) FILTER (l_returnflag = 'N') / count(*), 4) AS exact,
 round(count(*) FILTER (l_linestatus = 'O') / count(*), 4) AS stp, round(1 - avg(l_discount), 4) AS agreement, round(avg(l_tax), 4) AS review, round(avg(l_extendedprice) / 1000000, 4) AS cost, round(avg(l_quantity) / 50, 4) AS confidence
 FROM lineitem GROUP BY 1, 2)"""


MONTHS_SHORT = ("ENE", "FEB", "MAR", "ABR", "MAY", "JUN", "JUL", "AGO", "SEPT", "OCT", "NOV", "DIC")
MONTHS_LONG = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")


def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity numbers and dates in every layout that is told apart, built from ``orders``."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    body = F.lpad((k * 7919 % 100000000).cast("string"), 8, "1")
    verifier, v, n = F.substr(F.lit("0123456789K"), (k % 11 + 1).cast("int"), F.lit(1)), k % 8, k % 9
    part = lambda a, b: F.substr(body, F.lit(a), F.lit(b))
    raw = (
        F.when(v == 0, F.concat(part(1, 2), F.lit("."), part(3, 3), F.lit("."), part(6, 3), F.lit("-"), verifier)).when(v == 1, F.concat(F.lit(" run  "), body, F.lit(" - "), F.lower(verifier))).when(v == 2, F.concat(body, verifier))
        .when(v == 3, F.concat(F.lit("A"), body)).when(v == 4, F.concat(F.lit("AB"), part(1, 7))).when(v == 5, F.concat(F.lit(" DNI: "), body, F.lit(" x"))).when(v == 6, " no detectado -")
        .otherwise(F.concat(F.lit("serie a"), part(1, 2), F.lit("."), part(3, 3), F.lit("."), part(6, 3)))
    )
    month = lambda names: F.element_at(F.array(*map(F.lit, names)), F.month(d))
    shown = lambda f: F.date_format(d, f)
    date = (
        F.when(n == 0, shown("yyyy-MM-dd")).when(n == 1, shown("yyyy/MM/dd")).when(n == 2, shown("dd/MM/yyyy")).when(n == 3, shown("dd-MM-yyyy")).when(n == 4, F.concat(F.lit("el "), shown("dd MM  yyyy"), F.lit(" vence")))
        .when(n == 5, F.concat(shown("dd "), month(MONTHS_SHORT), shown(" yyyy"))).when(n == 6, F.concat(F.lit("Lima, "), shown("d"), F.lit(" de "), month(MONTHS_LONG), F.lit(" de "), shown("yyyy."))).when(n == 7, shown("dd.MM.yyyy")).otherwise(" sin fecha:")
    )
    period = F.concat(F.when(k % 2 == 0, "per. ").otherwise(""), month(MONTHS_SHORT), F.when(k % 3 == 0, "-").when(k % 3 == 1, "/").otherwise(" "), (F.year(d) + 20).cast("string"))
    return spread(load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")).select(k.alias("id"), F.when(k % 3 == 0, "cl").when(k % 3 == 1, "PE").otherwise("CO").alias("country"), body.alias("body"), raw.alias("raw"), date.alias("date_text"), period.alias("period"), shown("yyyy-MM-dd").alias("iso"), d.alias("made"))


IDS = """ids AS (SELECT o_orderkey AS id, o_orderkey % 3 AS c, o_orderkey % 8 AS v, o_orderkey % 9 AS n, lpad((o_orderkey * 7919 % 100000000)::VARCHAR, 8, '1') AS body, substr('0123456789K', CAST(o_orderkey % 11 + 1 AS INT), 1) AS verifier,
 strftime(o_orderdate, '%Y-%m-%d') AS iso, o_orderdate AS made FROM orders)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field candidates from ``lineitem``: an order is a field, its lines are what engines read; a candidate is selected if it has the field's value."""
    i = load(spark, sf_dir, "lineitem")
    said = F.concat_ws(" ", F.lit("Valor"), (F.col("l_partkey") % 3).cast("string"))
    value = F.when(F.col("l_quantity") < 4, F.lit(None)).when(F.col("l_quantity") < 6, " - ").when(F.col("l_linenumber") % 2 == 0, F.upper(said)).otherwise(said)
    raw = F.when(F.col("l_quantity") % 2 == 0, F.concat(F.lit("valor: "), (F.col("l_suppkey") % 3).cast("string")))
    place = ((F.col("l_linenumber").cast("long") * 1000000 + F.col("l_partkey")) * 100000 + F.col("l_suppkey")) * 100 + F.col("l_quantity").cast("long")
    rows = i.select(
        F.col("l_orderkey").alias("field_id"), place.alias("ord"), F.concat(F.lit("source"), (F.col("l_suppkey") % 4).cast("string")).alias("source"), F.concat(F.lit("engine"), (F.col("l_suppkey") % 2).cast("string")).alias("engine"), value.alias("value"), raw.alias("raw_text"),
        F.round(1 - F.col("l_discount") * F.col("l_linenumber"), 2).alias("score"), F.when(F.col("l_tax") < 0.07, F.round(0.6 + F.col("l_quantity") / 125, 3)).alias("confidence"),
    )
    wanted = fields(spark, sf_dir).select("field_id", F.regexp_replace(F.lower("current_value"), "[^a-z0-9]", "").alias("w"))
    return rows.join(wanted, "field_id").withColumn("selected", F.coalesce(F.regexp_replace(F.lower("value"), "[^a-z0-9]", "") == F.col("w"), F.lit(False))).drop("w")


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return load(spark, sf_dir, "orders").select(k.alias("field_id"), F.when(k % 5 > 0, F.concat(F.lit("VALOR-"), (k % 4).cast("string"))).alias("current_value"), (F.col("o_orderpriority") == "1-URGENT").alias("critical"))


_PLACE = "((l_linenumber * 1000000 + l_partkey) * 100000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT)"
CANDS = f"""fields AS (SELECT o_orderkey AS field_id, CASE WHEN o_orderkey % 5 > 0 THEN 'valor' || (o_orderkey % 4) END AS wanted, o_orderpriority = '1-URGENT' AS critical FROM orders),
cands AS (SELECT l_orderkey AS field_id, {_PLACE} AS ord, 'source' || (l_suppkey % 4) AS source, 'engine' || (l_suppkey % 2) AS engine, CASE WHEN l_quantity < 4 THEN NULL WHEN l_quantity < 6 THEN ' - ' WHEN l_linenumber % 2 = 0 THEN 'VALOR ' || (l_partkey % 3) ELSE 'Valor ' || (l_partkey % 3) END AS value,
 CASE WHEN l_quantity % 2 = 0 THEN 'valor: ' || (l_suppkey % 3) END AS raw_text, round(1 - l_discount * l_linenumber, 2) AS score, CASE WHEN l_tax < 0.07 THEN round(0.6 + l_quantity / 125, 3) END AS confidence FROM lineitem),
keyed AS (SELECT c.*, coalesce(value, raw_text) AS shown, regexp_replace(lower(coalesce(value, raw_text)), '[^a-z0-9]', '', 'g') AS key, coalesce(regexp_replace(lower(value), '[^a-z0-9]', '', 'g') = wanted, false) AS selected FROM cands c JOIN fields USING (field_id)),
best AS (SELECT *, row_number() OVER (PARTITION BY field_id, key ORDER BY selected DESC, score DESC, coalesce(confidence, 0) DESC, ord) AS nth FROM keyed WHERE key <> ''),
ss AS (SELECT field_id, key, string_agg(source, ',' ORDER BY f) AS sources, count(*) AS n_sources FROM (SELECT field_id, key, source, min(nth) AS f FROM best GROUP BY 1, 2, 3) GROUP BY 1, 2),
gs AS (SELECT field_id, key, round(sum(score), 4) AS score, max(coalesce(confidence, 0)) AS confidence, max(shown) FILTER (nth = 1) AS value, max(source) FILTER (nth = 1) AS source, max(engine) FILTER (nth = 1) AS engine, min(ord) AS first FROM best GROUP BY 1, 2),
groups AS (SELECT *, row_number() OVER (PARTITION BY field_id ORDER BY n_sources DESC, score DESC, confidence DESC, first) AS rank FROM gs JOIN ss USING (field_id, key)),
runs AS (SELECT o_orderkey AS field_id, o_orderkey % 4 AS n_runs FROM orders),
cons AS (SELECT field_id, n_runs AS engines_considered, count(DISTINCT key) FILTER (value IS NOT NULL OR raw_text IS NOT NULL) AS candidate_count, coalesce(string_agg(source, ',' ORDER BY score DESC, coalesce(confidence, 0) DESC, ord) FILTER (selected), '') AS supporting_engines,
 CASE WHEN n_runs > 0 THEN round(count(*) FILTER (selected) / n_runs, 3) ELSE 0 END AS agreement_ratio, n_runs > 1 AND count(DISTINCT key) FILTER (selected) > 1 AS disagreement FROM (SELECT * REPLACE (coalesce(key, '') AS key) FROM keyed) JOIN runs USING (field_id) GROUP BY 1, 2)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, d = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    return load(spark, sf_dir, "orders").select(
        k.alias("job_id"), F.when(k % 4 == 0, "queued").when(k % 4 == 1, "failed").when(k % 4 == 2, "completed").otherwise("running").alias("status"), (k % 5).alias("attempts"), F.lit(3).alias("max_attempts"),
        d.alias("created_at"), d.alias("updated_at"), F.when(k % 6 > 0, F.timestamp_seconds(F.unix_seconds(d) + (k % 6) * 864000)).alias("next_retry_at"), F.when(k % 3 == 0, F.timestamp_seconds(F.unix_seconds(d) + 120)).alias("lease_expires_at"),
        F.col("o_custkey").alias("client"), F.concat_ws(":", F.col("o_custkey").cast("string"), F.date_format(d, "yyyy-MM-dd")).alias("dedupe_key"),
    )


JOBS = """jobs AS (SELECT o_orderkey AS job_id, CASE o_orderkey % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'failed' WHEN 2 THEN 'completed' ELSE 'running' END AS status, o_orderkey % 5 AS attempts, 3 AS max_attempts, o_orderdate AS created_at, o_orderdate AS updated_at,
 CASE WHEN o_orderkey % 6 > 0 THEN o_orderdate + to_seconds(o_orderkey % 6 * 864000) END AS next_retry_at, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + to_seconds(120) END AS lease_expires_at, o_custkey AS client, o_custkey || ':' || strftime(o_orderdate, '%Y-%m-%d') AS dedupe_key FROM orders)"""
