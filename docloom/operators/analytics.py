"""Usage, latency, decisions, accuracy, cost, calibration and routing over fact tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import clamp, math_round, rate
from .ranking import bounds, percentiles

STATUSES = ("uploaded", "processing", "completed", "review", "rejected")
DECISIONS = ("auto_accept", "accept_with_warning", "human_review", "reject")
# Assumed unit prices in US dollars.
ENGINE_PRICES = {"rapidocr": 0.0015, "paddleocr": 0.002, "doctr": 0.003, "google-documentai": 0.05, "azure-document-intelligence": 0.045}
ADJUDICATED_FIELD_PRICE = 0.0035


def in_range(ledger: DataFrame, start: str, end: str) -> DataFrame:
    """Both ends included; a null time is outside."""
    return ledger.where(F.col("created_at").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def usage_totals(ledger: DataFrame) -> DataFrame:
    """Terminal documents, bytes over all events, distinct non-null submissions."""
    return ledger.agg(
        F.coalesce(F.sum(F.when(F.col("terminal"), F.col("units"))), F.lit(0)).cast("long").alias("terminal_documents"),
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("ingested_bytes"),
        F.count_distinct("submission_id").alias("submissions"),
    )


def usage_by(ledger: DataFrame, key: Column, name: str) -> DataFrame:
    """Terminal units of each key; a null key is unclassified."""
    return ledger.where("terminal").groupBy(F.coalesce(key, F.lit("unclassified")).alias(name)).agg(F.sum("units").cast("long").alias("documents"))


def latency(ledger: DataFrame, *by: str) -> DataFrame:
    """p50, p90, p99 as sorted[floor((n - 1) * r)] and the mean, halves up, of terminal latencies.

    Ranks come from counts of each value and of ranges of values, so that of a
    group only the ranges that hold a rank are sorted.
    """
    rows = ledger.where("terminal and latency_ms is not null and not isnan(latency_ms) and abs(latency_ms) < double('infinity')").withColumn("__one", F.lit(0))
    groups = ("__one", *by)
    counts = rows.groupBy(*groups, "latency_ms").agg(F.count("*").alias("c"))
    mean = math_round(F.sum(F.col("latency_ms") * F.col("c")) / F.sum("c")).cast("long")
    measures = mean.alias("mean"), F.sum("c").alias("n")
    whole = counts.groupBy(*groups).agg(*measures) if by else counts.agg(*measures).withColumn("__one", F.lit(0))  # without groups, a row for no rows too
    ranks = percentiles(counts, groups, "latency_ms", "c", {"p50": 0.5, "p90": 0.9, "p99": 0.99}, bounds(rows, [F.col("latency_ms")]))
    both = whole.alias("w").join(ranks.alias("r"), [F.col(f"w.{c}").eqNullSafe(F.col(f"r.{c}")) for c in groups], "left")  # a row a group
    return both.select(*(f"w.{c}" for c in by), "p50", "p90", "p99", "mean", "n")


def decisions(ledger: DataFrame, *by: str) -> DataFrame:
    """The four decisions, the total with all others in it, and three rates; no rows, rate 0."""
    n = {d: F.count_if(F.col("decision") == d) for d in DECISIONS}
    total = F.count("*")
    return ledger.groupBy(*by).agg(
        *(n[d].alias(d) for d in DECISIONS),
        total.alias("total"),
        F.round(rate(n["auto_accept"], total), 6).alias("straight_through_rate"),
        F.round(rate(n["human_review"], total), 6).alias("review_rate"),
        F.round(rate(n["reject"], total), 6).alias("reject_rate"),
    )


def accuracy(submissions: DataFrame, documents: DataFrame, corrections: DataFrame) -> DataFrame:
    """Per family of the record: fields, and corrected ones: a submission's corrections and its record's different edited names.

    submissions (submission_id, document_id), those without a record skipped;
    documents (document_id, family, n_fields, edited); corrections (submission_id, n), summed up before they are joined.
    """
    told = corrections.groupBy("submission_id").agg(F.sum("n").alias("c"))
    rows = submissions.join(documents, "document_id").join(told, "submission_id", "left")
    mine = F.coalesce("c", F.lit(0)) + F.col("edited")
    corrected, whole, touched = F.sum(mine), F.sum(F.greatest("n_fields", F.lit(1))), F.count_if(mine > 0)
    return rows.groupBy("family").agg(
        F.count("*").alias("documents"), touched.alias("corrected_documents"), corrected.alias("corrected_fields"), whole.alias("total_fields"),
        F.round(1 - rate(corrected, whole), 4).alias("accuracy"), F.round(rate(touched, F.count("*")), 4).alias("correction_rate"),
    )


def processing_cost(engines: Column, adjudicated: Column) -> Column:
    """Price of each distinct engine, unknown ones free, and of each adjudicated field."""
    price = F.create_map(*[F.lit(x) for kv in ENGINE_PRICES.items() for x in kv])
    each = F.transform(F.array_distinct(engines), lambda e: F.coalesce(F.element_at(price, F.lower(e)), F.lit(0.0)))
    return F.round(F.aggregate(each, F.lit(0.0), lambda a, x: a + x) + ADJUDICATED_FIELD_PRICE * adjudicated, 6)


def recommendation(reviewed: Column, false_accepts: Column, correction: Column, agreement: Column, review: Column) -> Column:
    return (
        F.when(reviewed < 5, "collect_more_samples")
        .when((false_accepts > 0) | ((correction > 0.18) & (agreement < 0.88)), "tighten_auto_accept")
        .when((review > 0.55) & (correction < 0.08) & (agreement > 0.9), "reduce_review_threshold")
        .otherwise("stable")
    )


def _pack_measures() -> dict[str, Column]:
    n, reviewed, changed = F.count("*"), F.count_if("reviewed"), F.col("corrected") > 0
    false_accepts, voted = F.count_if((F.col("decision") == "auto_accept") & changed), F.sum("consensus_fields")
    correction, agreement = rate(F.count_if(changed), reviewed), rate(F.sum(F.col("agreement") * F.col("consensus_fields")), voted)
    review = rate(F.count_if(F.col("decision") == "human_review"), n)
    return {
        "documents": n, "reviewed": reviewed, "corrected": F.count_if(changed), "false_accepts": false_accepts,
        "straight_through_rate": F.round(rate(F.count_if(F.col("decision").isin("auto_accept", "accept_with_warning")), n), 6), "review_rate": F.round(review, 6),
        "correction_rate": F.round(correction, 6), "confidence": F.round(F.avg(F.coalesce("confidence", F.lit(0.0))), 6), "agreement": F.round(agreement, 6),
        "disagreement_rate": F.round(rate(F.sum("disagreements"), voted), 6), "abstention_rate": F.round(rate(F.sum("abstained"), F.sum("adjudications")), 6),
        "recommendation": recommendation(reviewed, false_accepts, correction, agreement, review),
    }


def calibration(signals: DataFrame) -> DataFrame:
    """Twelve measures of each pack over ``documents.signals``, and what to do about it.

    Null confidence counts as 0; agreement is weighted by the fields with a
    consensus; family, country and variant are the pack's first record's.
    """
    of_first = lambda c: F.min_by(c, "ord").alias(c)
    return signals.groupBy("pack_id").agg(of_first("family"), of_first("country"), of_first("variant"), *(c.alias(k) for k, c in _pack_measures().items()))


# The order of insights.
INSIGHT_ORDER = ("tighten_auto_accept", "collect_more_samples", "reduce_review_threshold", "stable")


def insights(calibrated: DataFrame, top: int | None = None) -> DataFrame:
    """By what is to be done, then by the most documents; the first ``top``."""
    rank = F.array_position(F.array(*map(F.lit, INSIGHT_ORDER)), F.col("recommendation"))
    out = calibrated.orderBy(rank, F.desc("documents"), "pack_id")
    return out.limit(top) if top else out


def learning_loop(signals: DataFrame, top: int = 25) -> DataFrame:
    """One row of totals: reviewed records, the queue's length, packs, and corrections after an automatic accept."""
    groups = signals.groupingSets([["pack_id"], []], "pack_id").agg(
        F.grouping_id().alias("whole"), F.count_if("reviewed").alias("reviewed"), F.count_if(_queue_score() > 0).alias("queue"), _pack_measures()["false_accepts"].alias("false_accepts"),
    )
    whole = F.col("whole") == 1
    of_all = lambda c: F.coalesce(F.max(F.when(whole, F.col(c))), F.lit(0).cast("long"))
    return groups.agg(
        of_all("reviewed").alias("reviewed_documents"), F.least(of_all("queue"), F.lit(top).cast("long")).alias("queue_size"), F.count_if(~whole).alias("packs_tracked"), of_all("false_accepts").alias("false_accept_corrections"),
    )


# What a recommendation adds to automatic confidence, automatic agreement and confidence with a warning.
ADJUSTMENTS = {"tighten_auto_accept": (0.02, 0.05, 0.01), "reduce_review_threshold": (-0.01, -0.03, -0.02)}


def threshold_recommendation(insights: DataFrame) -> DataFrame:
    """The five thresholds of each pack that isn't stable, clamped; a zero average starts at 0.85."""
    started = lambda c: F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(0.85))
    confidence, agreement = clamp(started("confidence"), 0.75, 0.99), clamp(started("agreement"), 0.55, 0.99)

    def added(k: int) -> Column:
        out = F.lit(0.0)
        for name, by in ADJUSTMENTS.items():
            out = F.when(F.col("recommendation") == name, by[k]).otherwise(out)
        return out

    made = {
        "auto_accept_confidence": clamp(confidence + 0.04 + added(0), 0.82, 0.995), "auto_accept_agreement": clamp(agreement + 0.02 + added(1), 0.6, 0.99),
        "accept_with_warning_confidence": clamp(confidence - 0.03 + added(2), 0.68, 0.98), "review_agreement": clamp(agreement - 0.15, 0.45, 0.92), "cross_side_confidence": clamp(confidence - 0.01, 0.78, 0.97),
    }
    return insights.where("recommendation <> 'stable'").select("pack_id", "family", "country", "recommendation", *(F.round(c, 6).alias(k) for k, c in made.items()))


def routing_scores(results: DataFrame) -> DataFrame:
    """Weighted score of each strategy, cost against the dearest; the first of the best is recommended."""
    cost = F.coalesce(F.try_divide("cost", F.max("cost").over(Window.partitionBy())), F.lit(0.0))
    score = 0.6 * F.col("exact") + 0.2 * F.col("stp") + 0.15 * F.col("agreement") + 0.05 * (1 - F.col("review")) - 0.12 * cost
    scored = results.withColumn("score", F.round(score, 6))
    best = F.row_number().over(Window.orderBy(F.desc("score"), "ord")) == 1
    return scored.withColumn("recommended", best)


def leaderboard(results: DataFrame) -> DataFrame:
    """Rank is position: ties get different ranks, by strategy."""
    order = Window.orderBy(F.desc("exact"), F.desc("stp"), F.desc("confidence"), "strategy")
    return results.withColumn("rank", F.row_number().over(order))


def _queue_score() -> Column:
    c = F.coalesce("confidence", F.lit(1.0))
    score = 18 * F.col("corrected") + 8 * F.col("disagreements") + 5 * F.col("low_agreement") + 6 * F.col("abstained")
    score = score + F.when(c < 0.85, 6).otherwise(0) + F.when(F.col("decision") == "human_review", 8).otherwise(0)
    return (score + F.when((F.col("decision") == "auto_accept") & (F.col("corrected") > 0), 20).otherwise(0)).cast("long")


def learning_queue(documents: DataFrame, top: int = 25) -> DataFrame:
    """Documents most worth a review, by additive score above 0; null confidence counts as 1."""
    return documents.withColumn("score", _queue_score()).where("score > 0").orderBy(F.desc("score"), "ord").limit(top)


def benchmark(rows: DataFrame, strategy: str, pack: str, **measures: Column) -> DataFrame:
    """Measures of each strategy (pack null), and of each strategy and pack."""
    return rows.groupingSets([[strategy], [strategy, pack]], strategy, pack).agg(*(m.alias(name) for name, m in measures.items()))


def snapshot_diff(snapshots: DataFrame, key: str, value: str, action: str = "action") -> DataFrame:
    """Latest less previous snapshot of each action and key; an action with less than two has none."""
    w = Window.partitionBy(action, key).orderBy(F.desc("created_at"), F.desc("id"))
    two = snapshots.withColumn("rn", F.row_number().over(w)).where("rn <= 2")
    both = two.groupBy(action, key).agg(F.max(F.when(F.col("rn") == 1, F.col(value))).alias("latest"), F.max(F.when(F.col("rn") == 2, F.col(value))).alias("previous"), F.count("*").alias("n"))
    return both.where("n = 2").select(action, key, "latest", "previous", F.round(F.col("latest") - F.col("previous"), 6).alias("change"))


def _snapshot_measures(now: str) -> list[Column]:
    t, n, job = F.lit(now).cast("timestamp"), F.count("*"), F.col("job.status")
    waited = F.max(F.when(job == "queued", F.unix_millis(t) - F.unix_millis("job.created_at"))) / 60000
    due = (job == "failed") & (F.col("job.next_retry_at").isNull() | (F.col("job.next_retry_at") <= t))
    voted = F.sum("consensus_fields")
    return [
        n.alias("documents"),
        *(F.count_if(F.col("status") == s).alias(f"status_{s}") for s in STATUSES),
        *(F.count_if(F.col("decision") == x).alias(f"decision_{x}") for x in ("pending", *DECISIONS)),
        F.count_if(F.col("job").isNotNull()).alias("jobs"), *(F.count_if(job == s).alias(f"jobs_{s}") for s in ("queued", "running", "failed")),
        F.count_if(F.col("job.queue") == "dlq").alias("jobs_dlq"), F.count_if(due).alias("jobs_retry_due"), F.coalesce(F.round(waited, 2), F.lit(0.0)).alias("oldest_queued_minutes"),
        F.round(rate(F.sum(F.coalesce("confidence", F.lit(0.0))), n), 6).alias("average_confidence"), F.round(rate(F.sum(F.col("agreement") * F.col("consensus_fields")), voted), 6).alias("average_agreement"),
        F.coalesce(F.sum("disagreements"), F.lit(0)).cast("long").alias("disagreement_fields"), F.coalesce(F.sum("edits"), F.lit(0)).cast("long").alias("review_edits"),
        F.count_if("reviewed").alias("dataset_eligible"), F.round(rate(F.count_if("reviewed"), n), 6).alias("review_coverage"),
    ]


def ops_snapshot(signals: DataFrame, now: str) -> DataFrame:
    """One row on all records (``documents.signals``): statuses, decisions, jobs, means with a null confidence as 0, edits, coverage."""
    return signals.agg(*_snapshot_measures(now))


# The gauges and their order; the last part is the snapshot's column and its decimals.
GAUGES = (
    ("documents_total", "documents", 0), ("documents_uploaded", "status_uploaded", 0), ("documents_processing", "status_processing", 0), ("documents_completed", "status_completed", 0),
    ("documents_review", "status_review", 0), ("documents_rejected", "status_rejected", 0), ("decision_auto_accept", "decision_auto_accept", 0), ("decision_accept_with_warning", "decision_accept_with_warning", 0),
    ("decision_human_review", "decision_human_review", 0), ("decision_reject", "decision_reject", 0), ("jobs_total", "jobs", 0), ("jobs_failed", "jobs_failed", 0), ("jobs_dlq", "jobs_dlq", 0),
    ("jobs_retry_due", "jobs_retry_due", 0), ("jobs_oldest_queued_minutes", "oldest_queued_minutes", 2), ("review_edits_total", "review_edits", 0), ("dataset_eligible_documents", "dataset_eligible", 0),
    ("learning_queue_total", "queue_size", 0), ("false_accept_corrections_total", "false_accept_corrections", 0), ("packs_needing_calibration_total", "packs_needing_calibration", 0),
    ("average_confidence", "average_confidence", 6), ("average_field_agreement", "average_agreement", 6), ("disagreement_fields_total", "disagreement_fields", 0),
)


def gauges(signals: DataFrame, now: str) -> DataFrame:
    """(place, line): the 23 gauges of all records as metrics text.

    All records and each pack are groups of one aggregation, so that records are read once.
    """
    packs = _pack_measures()
    told = [packs[k].alias(f"pack_{k}") for k in ("false_accepts", "recommendation")]
    groups = signals.groupingSets([["pack_id"], []], "pack_id").agg(F.grouping_id().alias("whole"), F.least(F.count_if(_queue_score() > 0), F.lit(100)).alias("queue_size"), *told, *_snapshot_measures(now))
    whole = F.col("whole") == 1
    of_all = [F.coalesce(F.max(F.when(whole, F.col(c))), F.lit(0)).alias(c) for _, c, _ in GAUGES if c not in ("false_accept_corrections", "packs_needing_calibration")]
    row = groups.agg(*of_all, F.coalesce(F.sum(F.when(~whole, F.col("pack_false_accepts"))), F.lit(0)).alias("false_accept_corrections"), F.count_if(~whole & (F.col("pack_recommendation") != "stable")).alias("packs_needing_calibration"))
    lines = [F.format_string(f"ocr_{name} %d" if not k else f"ocr_{name} %.{k}f", F.col(c) if k else F.col(c).cast("long")) for name, c, k in GAUGES]
    return row.select(F.posexplode(F.array(*lines)).alias("place", "line"))


def monthly_cost(volumes: DataFrame, shares: dict[str, tuple[float, float]]) -> DataFrame:
    """Volume times the mix's average price, in decimals, half up."""
    unit = sum((F.lit(f"{s:.4f}").cast("decimal(10,4)") * F.lit(f"{p:.6f}").cast("decimal(10,6)") for s, p in shares.values()), F.lit("0").cast("decimal(10,4)"))
    return volumes.select("volume", F.round(unit, 6).cast("decimal(12,6)").alias("unit_cost"), F.round(F.col("volume").cast("decimal(12,0)") * unit, 2).cast("decimal(18,2)").alias("monthly_cost"))


