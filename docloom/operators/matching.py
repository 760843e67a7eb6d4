"""Rule matching, candidate consensus, adjudication and field comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import compact


#: Rules and packs are written by hand: they are read to the driver and become expressions of the row, and more than this is a mistake.
MAX_RULES = 2_000


def _read(rules: DataFrame, *order: str) -> list:
    rows = rules.orderBy(*order).limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    return rows


def _holds(rule, on: list[str]) -> Column:
    """A rule's null attribute matches anything."""
    return reduce(lambda a, b: a & b, (F.col(c) == F.lit(rule[c]) for c in on if rule[c] is not None), F.lit(True))


def first_match(documents: DataFrame, rules: DataFrame, on: list[str], key: str, value: str) -> DataFrame:
    """Value of the matching rule of the least priority; null without one."""
    out = F.lit(None).cast(dict(rules.dtypes)[value])
    for rule in reversed(_read(rules, "priority")):
        out = F.when(_holds(rule, on), F.lit(rule[value])).otherwise(out)
    return documents.select(key, out.alias(value))


def last_override(documents: DataFrame, rules: DataFrame, on: list[str], key: str, values: list[str]) -> DataFrame:
    """All matching rules folded in order of priority: of each value the last that isn't null."""
    rows, kinds = _read(rules, "priority"), dict(rules.dtypes)

    def last(v: str) -> Column:
        out = F.lit(None).cast(kinds[v])
        for rule in rows:
            if rule[v] is not None:
                out = F.when(_holds(rule, on), F.lit(rule[v])).otherwise(out)
        return out

    return documents.select(key, *(last(v).alias(v) for v in values))


def candidate_groups(candidates: DataFrame) -> DataFrame:
    """Candidates of a field by compact value or raw text, empty ones left out: what each group shows, and its rank.

    A group shows its best candidate, by (selected, score, confidence) and then
    place (ord); sources stand in that order. Groups rank by (sources, summed
    score, best confidence). Rows are dealt out once, by field.
    """
    shown = F.coalesce(F.nullif("value", F.lit("")), F.col("raw_text"))
    confidence = F.coalesce("confidence", F.lit(0.0))
    one = F.struct((~F.col("selected")).alias("a"), (-F.col("score")).alias("b"), (-confidence).alias("c"), "ord", "source", "engine", shown.alias("value"))
    keyed = candidates.withColumn("key", compact(shown)).where("key <> ''").repartition("field_id")
    groups = keyed.groupBy("field_id", "key").agg(F.array_sort(F.collect_list(one)).alias("g"), F.round(F.sum("score"), 4).alias("score"), F.max(confidence).alias("confidence"), F.min("ord").alias("first"))
    sources = F.array_distinct(F.transform("g", lambda x: x["source"]))
    rows = groups.select("field_id", "key", sources.alias("sources"), F.size(sources).alias("n_sources"), "score", "confidence", "first", *(F.col("g")[0][c].alias(c) for c in ("value", "source", "engine")))
    order = Window.partitionBy("field_id").orderBy(F.desc("n_sources"), F.desc("score"), F.desc("confidence"), "first")
    return rows.withColumn("rank", F.row_number().over(order))


def consensus(candidates: DataFrame, runs: DataFrame) -> DataFrame:
    """Of each field with candidates: successful runs (field_id, n_runs), different values, sources of selected candidates, their share, and whether they differ."""
    shown = F.coalesce(compact(F.coalesce(F.nullif("value", F.lit("")), F.col("raw_text"))), F.lit(""))
    given = F.coalesce(F.length("value") > 0, F.lit(False)) | F.coalesce(F.length("raw_text") > 0, F.lit(False))
    one = F.when(F.col("selected"), F.struct((-F.col("score")).alias("a"), (-F.coalesce("confidence", F.lit(0.0))).alias("b"), "ord", "source"))
    per = candidates.groupBy("field_id").agg(F.count_distinct(F.when(given, shown)).alias("candidate_count"), F.array_sort(F.collect_list(one)).alias("g"), F.count_distinct(F.when(F.col("selected") & given, shown)).alias("values"))
    rows = per.join(runs, "field_id")
    n = F.col("n_runs")
    share = F.when(n > 0, F.round(F.size("g") / n, 3)).otherwise(0.0)
    return rows.select("field_id", n.alias("engines_considered"), "candidate_count", F.transform("g", lambda x: x["source"]).alias("supporting_engines"), share.alias("agreement_ratio"), ((n > 1) & (F.col("values") > 1)).alias("disagreement"))


def adjudicate(fields: DataFrame, candidates: DataFrame, votes: DataFrame) -> DataFrame:
    """The first group's value where evidence is high and its score leads by enough, or it is what the field has without a conflict; else abstains.

    fields (field_id, current_value, critical); votes (field_id, agreement_ratio,
    disagreement), of which a field may have none. Evidence is high with two
    sources, an agreement of 0.67 or a confidence of 0.94; the lead is 0.12 for
    critical fields and 0.08 for others. An abstention has a confidence and
    sources too, unless there is no candidate.
    """
    g = candidate_groups(candidates).where("rank <= 2").groupBy("field_id")
    first = lambda c: F.max(F.when(F.col("rank") == 1, F.col(c))).alias(c)
    top = g.agg(*(first(c) for c in ("key", "value", "source", "engine", "score", "confidence", "sources")), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("score"))), F.lit(0.0)).alias("second"), (F.count("*") > 1).alias("rivals"))
    rows = fields.join(top, "field_id", "left").join(votes.select("field_id", "agreement_ratio", "disagreement"), "field_id", "left")
    agreement, critical = F.coalesce("agreement_ratio", F.lit(0.0)), F.coalesce("critical", F.lit(False))
    high = (F.size("sources") >= 2) | (agreement >= 0.67) | (F.col("confidence") >= 0.94)
    leads = F.col("score") - F.col("second") >= F.when(critical, 0.12).otherwise(0.08)
    same = F.coalesce((F.col("current_value") != "") & (compact("current_value") == F.col("key")), F.lit(False))
    taken = (high & leads) | (same & ~F.coalesce("disagreement", "rivals")) | (same & critical & (agreement >= 0.5) & (F.col("confidence") >= 0.9))
    taken = F.coalesce(taken, F.lit(False))
    unsure = F.least(F.greatest(F.col("confidence"), agreement), F.lit(1.0))
    sure = F.least(F.greatest(0.7 * F.col("confidence") + 0.3 * agreement, F.lit(0.0)), F.lit(1.0))
    pick = lambda c: F.when(taken, F.col(c))
    return rows.select(
        "field_id", (~taken).alias("abstained"), pick("value").alias("selected_value"), pick("source").alias("selected_source"), pick("engine").alias("selected_engine"),
        F.when(F.col("key").isNotNull(), F.round(F.when(taken, sure).otherwise(unsure), 3)).alias("confidence"), F.coalesce("sources", F.array().cast("array<string>")).alias("evidence_sources"),
    )


def best_run(runs: DataFrame) -> DataFrame:
    """Of each document the run of the highest (score, success, tokens, length); none at score 0."""
    best = runs.groupBy("document_id").agg(F.max(F.struct("score", "success", "tokens", "length", "engine")).alias("b"))
    return best.select("document_id", F.when(F.col("b.score") > 0, F.col("b.engine")).alias("engine"), "b.score")


def compare_fields(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """match, mismatch, missing, extra or both_missing of each expected field; fields only in actual are ignored."""
    rows = expected.join(actual, ["document_id", "field"], "left")
    e, a = F.nullif(compact("expected"), F.lit("")), F.nullif(compact("actual"), F.lit(""))
    status = F.when(e.isNull() & a.isNull(), "both_missing").when(e.isNull(), "extra").when(a.isNull(), "missing").when(e == a, "match").otherwise("mismatch")
    return rows.select("document_id", "field", status.alias("status"))


def shared_identifier(front: Column, back: Column) -> Column:
    """The first of front's that back has too; null without one."""
    return F.get(F.array_intersect(front, back), F.lit(0))
