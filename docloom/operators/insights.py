"""What processing costs, how strategies and engines compare, and what changed between two snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import rate
from .analytics import ADJUDICATED_FIELD_PRICE, ENGINE_PRICES

# Engines whose use counts as an escalation.
PREMIUM = ("google-documentai", "azure-document-intelligence")


def engines(runs: Column) -> Column:
    """Different engines of an array of structs engine, source: small and trimmed, the source where there is no engine."""
    name = lambda r: F.lower(F.trim(F.coalesce(F.nullif(r["engine"], F.lit("")), r["source"], F.lit(""))))
    return F.filter(F.array_distinct(F.transform(runs, name)), lambda e: e != "")


def price(engine: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in ENGINE_PRICES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, engine), F.lit(0.0))


def costs(documents: DataFrame) -> DataFrame:
    """Documents (pack_id, family, strategy, decision, runs, adjudicated) that were processed, with their engines, cost and whether they were escalated."""
    e = F.col("engines")
    cost = F.aggregate(F.transform(e, price), F.lit(0.0), lambda a, x: a + x) + ADJUDICATED_FIELD_PRICE * F.col("adjudicated")
    return documents.where("decision <> 'pending'").withColumn("engines", engines(F.col("runs"))).withColumns({"cost": cost, "escalated": F.exists(e, lambda x: x.isin(*PREMIUM)), "straight": F.col("decision").isin("auto_accept", "accept_with_warning")})


def cost_insights(documents: DataFrame) -> DataFrame:
    """(what, key, documents, cost, cost_per_document, adjudicated, escalations, straight_through_rate): in all, by pack, by strategy (unknown without one) and by engine.

    The first three are sums of one pass over the documents; an engine's cost is its price for each document it read.
    """
    c = costs(documents).withColumn("strategy", F.coalesce("strategy", F.lit("unknown")))
    n, cost = F.count("*"), F.coalesce(F.sum("cost"), F.lit(0.0))
    what = F.when(F.grouping("pack_id") == 0, "pack").when(F.grouping("strategy") == 0, "strategy").otherwise("total")
    sets = c.groupingSets([["pack_id"], ["strategy"], []], "pack_id", "strategy").agg(
        what.alias("what"), n.alias("documents"), F.round(cost, 6).alias("cost"), F.round(rate(cost, n), 6).alias("cost_per_document"), F.coalesce(F.sum("adjudicated"), F.lit(0)).cast("long").alias("adjudicated"),
        F.count_if("escalated").alias("escalations"), F.round(rate(F.count_if("straight"), n), 6).alias("straight_through_rate"),
    )
    rows = sets.select("what", F.coalesce("pack_id", "strategy").alias("key"), "documents", "cost", "cost_per_document", "adjudicated", "escalations", "straight_through_rate")
    by_engine = c.select(F.explode("engines").alias("key")).groupBy("key").agg(n.alias("documents")).withColumn("cost", F.round(F.col("documents") * price(F.col("key")), 6))
    none = F.lit(None).cast("long")
    return rows.union(by_engine.select(F.lit("engine"), "key", "documents", "cost", F.round(F.col("cost") / F.col("documents"), 6), none, none, F.lit(None).cast("double")))


def dearest_packs(insights: DataFrame, top: int = 5) -> DataFrame:
    """The packs that cost most in all."""
    return insights.where("what = 'pack'").orderBy(F.desc("cost"), "key").limit(top)


def evaluated(rows: DataFrame, *sets: list[str]) -> DataFrame:
    """Measures of evaluated documents (decision, confidence, matched, total, agreed, voted, disagreements, cost) for each of these sets of columns, in one pass."""
    n, voted, total = F.count("*"), F.sum("voted"), F.sum("total")
    names = list(dict.fromkeys(c for s in sets for c in s))
    share = lambda *decisions: F.round(rate(F.count_if(F.col("decision").isin(*decisions)), n), 6)
    return rows.groupingSets([list(s) for s in sets], *names).agg(
        n.alias("documents"), F.round(rate(F.sum("matched"), total), 6).alias("exact_match_rate"), share("auto_accept", "accept_with_warning").alias("straight_through_rate"), share("human_review").alias("review_rate"), share("reject").alias("reject_rate"),
        F.round(F.avg(F.coalesce("confidence", F.lit(0.0))), 6).alias("average_confidence"), F.round(rate(F.sum("agreed"), voted), 6).alias("average_agreement"), F.round(rate(F.sum("disagreements"), voted), 6).alias("disagreement_rate"),
        F.round(F.sum("cost"), 4).alias("total_cost"), F.round(F.sum("cost") / n, 6).alias("cost_per_document"),
    )


# snapshots

LEARNING = "struct<snapshot:struct<totals:struct<queueSize:double,falseAcceptCorrections:double>,calibrationInsights:array<struct<recommendation:string>>>>"
ROUTING = "struct<recommendedOverall:struct<strategy:string>,results:array<struct<strategy:string,exactMatchRate:double,straightThroughRate:double,estimatedCostPerDocument:double>>>"
COSTS = "struct<totals:struct<estimatedCostPerDocument:double,totalOpenaiFields:double,premiumEscalationRate:double>>"


def last_two(records: DataFrame) -> DataFrame:
    """(action, latest, previous) payloads of each action with two snapshots at least."""
    w = Window.partitionBy("action").orderBy(F.desc("created_at"), F.desc("id"))
    two = records.withColumn("rn", F.row_number().over(w)).where("rn <= 2")
    pick = lambda n: F.max(F.when(F.col("rn") == n, F.col("payload")))
    return two.groupBy("action").agg(pick(1).alias("latest"), pick(2).alias("previous"), F.count("*").alias("n")).where("n = 2").drop("n")


def compare_snapshots(records: DataFrame) -> DataFrame:
    """(action, metric, value, text): what changed between an action's last two snapshots, by the kind its name says; any other action has none."""
    rows = last_two(records)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    metric = lambda name, value, text=None: F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value"), (F.lit(None).cast("string") if text is None else text).alias("text"))
    none = F.lit(None)

    def read(schema: str) -> tuple[Column, Column]:
        return F.from_json("latest", schema), F.from_json("previous", schema)

    a, b = read(LEARNING)
    tight = lambda s: zero(F.size(F.filter(s["snapshot"]["calibrationInsights"], lambda i: i["recommendation"] == "tighten_auto_accept")).cast("double"))
    of = lambda s, c: zero(s["snapshot"]["totals"][c])
    learning = F.array(metric("queue_delta", of(a, "queueSize") - of(b, "queueSize")), metric("false_accept_delta", of(a, "falseAcceptCorrections") - of(b, "falseAcceptCorrections")), metric("tighten_delta", tight(a) - tight(b)))

    c, d = read(ROUTING)
    known = F.transform(c["results"], lambda x, i: F.struct(x.alias("x"), F.element_at(F.filter(d["results"], lambda y: y["strategy"] == x["strategy"]), -1).alias("y"), (-i).alias("i")))
    change = lambda k, name: (k["x"][name] - k["y"][name]).alias(name)
    shifts = F.transform(F.filter(known, lambda k: k["y"].isNotNull()), lambda k: F.struct(change(k, "exactMatchRate"), k["i"].alias("i"), change(k, "straightThroughRate"), change(k, "estimatedCostPerDocument"), k["x"]["strategy"].alias("strategy")))
    best = F.array_max(shifts)
    routing = F.array(
        metric("recommended", none, c["recommendedOverall"]["strategy"]), metric("recommended_before", none, d["recommendedOverall"]["strategy"]), metric("best_improvement", none, best["strategy"]),
        metric("exact_match_delta", best["exactMatchRate"]), metric("straight_through_delta", best["straightThroughRate"]), metric("cost_delta", best["estimatedCostPerDocument"]),
    )

    e, g = read(COSTS)
    delta = lambda x: zero(e["totals"][x]) - zero(g["totals"][x])
    cost = F.array(metric("cost_per_document_delta", delta("estimatedCostPerDocument")), metric("adjudicated_fields_delta", delta("totalOpenaiFields")), metric("escalation_rate_delta", delta("premiumEscalationRate")))
    by_kind = F.when(F.col("action").contains("learning_loop"), learning).when(F.col("action").contains("routing"), routing).when(F.col("action").contains("cost"), cost)
    return rows.select("action", F.explode(by_kind).alias("m")).select("action", "m.metric", F.round("m.value", 6).alias("value"), "m.text")


def stage_trace(events: DataFrame) -> DataFrame:
    """(document_id, stage, started_at, finished_at, duration_ms) of stage events (document_id, stage, kind, at); a stage that hasn't ended has no duration."""
    at = lambda kind, f: f(F.when(F.col("kind") == kind, F.col("at")))
    rows = events.groupBy("document_id", "stage").agg(at("start", F.min).alias("started_at"), at("finish", F.max).alias("finished_at"))
    return rows.withColumn("duration_ms", F.unix_millis("finished_at") - F.unix_millis("started_at"))


# evaluations of manifest entries: (exact_match_rate, table_match_rate, global_confidence, decision) and whatever they are grouped by


def evaluation_groups(results: DataFrame, *keys: str) -> DataFrame:
    """(dimension, bucket, documents, means, three decision counts) for each key by itself, in one pass; a null or empty bucket is unknown."""
    named = results.withColumns({k: F.coalesce(F.nullif(F.col(k).cast("string"), F.lit("")), F.lit("unknown")) for k in keys if k != "decision"}).withColumn("d", F.col("decision"))
    dimension = F.lit(None).cast("string")
    for k in keys:
        dimension = F.when(F.grouping(k) == 0, k).otherwise(dimension)
    mean = lambda c: F.round(F.avg(F.coalesce(c, F.lit(0.0))), 4)
    sets = named.groupingSets([[k] for k in keys], *keys).agg(
        dimension.alias("dimension"), F.count("*").alias("documents"), mean("global_confidence").alias("average_confidence"), mean("exact_match_rate").alias("exact_match_rate"), mean("table_match_rate").alias("table_match_rate"),
        *(F.count_if(F.col("d") == x).alias(x) for x in ("accept_with_warning", "human_review", "auto_accept")),
    )
    return sets.select("dimension", F.coalesce(*keys).alias("bucket"), "documents", "average_confidence", "exact_match_rate", "table_match_rate", "accept_with_warning", "human_review", "auto_accept")


def evaluation_headline(results: DataFrame) -> DataFrame:
    """One row: means, how far confidence lies above what was right, and the shares of decisions; all 0 without results."""
    n = F.count("*")
    mean = lambda c: F.coalesce(F.avg(F.coalesce(c, F.lit(0.0))), F.lit(0.0))
    share = lambda *d: F.round(rate(F.count_if(F.col("decision").isin(*d)), n), 4)
    return results.agg(
        n.alias("documents"), F.round(mean("global_confidence"), 4).alias("average_confidence"), F.round(mean("exact_match_rate"), 4).alias("average_exact_match_rate"), F.round(mean("table_match_rate"), 4).alias("average_table_match_rate"),
        F.round(mean("global_confidence") - mean("exact_match_rate"), 4).alias("confidence_exact_gap"), share("auto_accept", "accept_with_warning").alias("straight_through_rate"), share("human_review").alias("review_rate"), share("reject").alias("reject_rate"),
    )


def evaluation_json(results: DataFrame, *keys: str) -> DataFrame:
    """(summary): the headline and the groups of each key, by bucket, as one JSON text."""
    groups = evaluation_groups(results, *keys)
    rows = groups.groupBy("dimension").agg(F.array_sort(F.collect_list(F.struct(*groups.columns[1:]))).alias("rows"))
    listed = rows.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("by_"), "dimension").alias("k"), F.col("rows").alias("v"))))).alias("groups"))
    return evaluation_headline(results).join(listed, F.lit(True)).select(F.to_json(F.struct("*")).alias("summary"))


def registry_profile(entries: DataFrame, *by: str) -> DataFrame:
    """Per dataset: entries, sorted different conditions, splits and profiles, and families and countries sorted but each as often as it comes."""
    named = lambda c, default: F.coalesce(F.nullif(c, F.lit("")), F.lit(default))
    different = lambda c, default: F.sort_array(F.collect_set(named(c, default)))
    return entries.groupBy(*by).agg(
        F.count("*").alias("documents"), different("capture_condition", "unknown").alias("capture_conditions"), different("split", "unspecified").alias("splits"), different("benchmark_profile", "unspecified").alias("benchmark_profiles"),
        F.sort_array(F.collect_list(named("family", "unknown"))).alias("families"), F.sort_array(F.collect_list(named("country", "XX"))).alias("countries"),
    )
