"""Document records: review signals, statuses, golden sets, the learning loop and exports.

A record is a row with, beside plain columns, ``fields`` (array of structs field_name,
label, normalized, raw, confidence, page, engine, evidence, agreement, disagreement,
abstained, ...; a null agreement means no consensus, a null abstained no
adjudication), ``sessions`` (array of structs status, updated_at, edits) and
``job`` (struct of the latest job, or null). Arrays hold one document's children,
so functions over them stay inside the row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import math_round, rate
from ..functions.text import SPACE, let, mask_ends, redact_name, slugify

DECISIONS = ("pending", "auto_accept", "accept_with_warning", "human_review", "reject")
STATUSES = ("uploaded", "processing", "completed", "review", "rejected")


def normal(c: Column) -> Column:
    """Trimmed; empty is null."""
    return F.nullif(F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", ""), F.lit(""))


def last_wins(entries: Column) -> Column:
    """Map of structs (key, value): a key's last value, at the key's first place."""
    return let(entries, lambda e: let(F.array_distinct(e["key"]), lambda ks: F.map_from_arrays(ks, F.transform(ks, lambda k: F.element_at(F.filter(e, lambda x: x["key"] == k), -1)["value"]))))


# stored rows and records


def to_record(rows: DataFrame) -> DataFrame:
    """Columns in camel case, and an empty list or map for a null one."""
    return _filled(rows, lambda c: re.sub(r"_+([a-z0-9])", lambda m: m[1].upper(), c))


def to_row(records: DataFrame) -> DataFrame:
    """Columns in snake case, and an empty list or map for a null one."""
    return _filled(records, lambda c: re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", c).lower())


def _filled(rows: DataFrame, name) -> DataFrame:
    def value(c: str, kind: str) -> Column:
        empty = {"array": F.array, "map<st": F.create_map}.get(kind[:5] if kind.startswith("array") else kind[:6])
        return F.coalesce(F.col(f"`{c}`"), empty().cast(kind)) if empty else F.col(f"`{c}`")

    return rows.select(*(value(c, kind).alias(name(c)) for c, kind in rows.dtypes))


def with_defaults(rows: DataFrame, **defaults) -> DataFrame:
    """Columns that are missing or null get their default: a value or a column."""
    value = lambda v: v if isinstance(v, Column) else F.lit(v)
    return rows.withColumns({c: F.coalesce(F.col(c), value(v)) if c in rows.columns else value(v) for c, v in defaults.items()})


# signals


def reviewed() -> Column:
    return (F.coalesce(F.size("sessions"), F.lit(0)) > 0) | F.col("last_reviewed_at").isNotNull()


def edits() -> Column:
    """All edits of a record by time; of one time as they stand."""
    flat = F.flatten(F.transform("sessions", lambda s: s["edits"]))
    placed = F.transform(flat, lambda e, i: F.struct(e["created_at"].alias("at"), i.alias("i"), e.alias("e")))
    return F.transform(F.array_sort(placed), lambda x: x["e"])


def corrected_fields() -> Column:
    """Names of fields with an edit that changed the trimmed value."""
    changed = F.filter(edits(), lambda e: ~normal(e["previous"]).eqNullSafe(normal(e["new"])))
    return F.array_distinct(F.transform(changed, lambda e: e["field_name"]))


def pack_key() -> Column:
    return F.coalesce("pack_id", F.concat_ws("-", F.coalesce("family", F.lit("")), F.coalesce("country", F.lit("")), F.coalesce("variant", F.lit("generic"))))


def signals(documents: DataFrame) -> DataFrame:
    """One flat row for each record: what calibration, the learning queue and the metrics need of it."""
    many = lambda f: F.coalesce(F.size(F.filter("fields", f)), F.lit(0))
    voted = F.filter("fields", lambda x: x["agreement"].isNotNull())
    total = F.aggregate(voted, F.lit(0.0), lambda a, x: a + x["agreement"])
    n = many(lambda x: x["agreement"].isNotNull())
    return documents.select(
        "document_id", "ord", "family", "country", "variant", pack_key().alias("pack_id"), "decision", "status", "confidence", reviewed().alias("reviewed"),
        F.coalesce(F.size(corrected_fields()), F.lit(0)).alias("corrected"), F.coalesce(F.size("fields"), F.lit(0)).alias("n_fields"), n.alias("consensus_fields"),
        many(lambda x: x["agreement"].isNotNull() & x["disagreement"]).alias("disagreements"), many(lambda x: x["agreement"] < 0.67).alias("low_agreement"),
        rate(total, n).alias("agreement"), many(lambda x: x["abstained"].isNotNull()).alias("adjudications"), many(lambda x: x["abstained"]).alias("abstained"),
        F.coalesce(F.aggregate(F.transform("sessions", lambda s: F.size(s["edits"])), F.lit(0), lambda a, x: a + x), F.lit(0)).alias("edits"),
        F.coalesce(F.exists("sessions", lambda s: s["status"] == "completed"), F.lit(False)).alias("review_completed"), "job",
    )


# statuses, filters and keys


def submission_status() -> Column:
    """What a submitter sees of a record; a null document_id is one that is gone."""
    review = (F.col("status") == "review") | F.coalesce("review_required", F.lit(False)) | (F.col("decision") == "human_review")
    rejected = (F.col("status") == "rejected") | (F.col("decision") == "reject")
    done = F.col("processed_at").isNotNull() & ((F.col("decision") != "pending") | F.col("confidence").isNotNull())
    settled = F.when(review, "review").when(rejected, "rejected").otherwise("completed")
    return (
        F.when(F.col("document_id").isNull(), "failed").when(done, settled).when(F.col("job.status") == "failed", "failed").when(F.col("job.status") == "queued", "queued")
        .when((F.col("job.status") == "running") | (F.col("status") == "processing"), "processing").otherwise(settled)
    )


def decision_status(decision: Column) -> Column:
    """A record's status once it is decided."""
    return F.when(decision == "reject", "rejected").when(decision == "human_review", "review").otherwise("completed")


def latency_ms() -> Column:
    """From the job's start to its end, not below 0; else the rounded sum of the trace's durations; else null."""
    spent = F.unix_millis("job.finished_at") - F.unix_millis("job.started_at")
    took = F.when(spent.isNotNull(), F.greatest(F.lit(0), spent))
    traced = F.when(F.size("trace") > 0, math_round(F.aggregate("trace", F.lit(0.0), lambda a, x: a + x["duration_ms"])))
    return F.coalesce(took, traced).cast("long")


def idempotency_key() -> Column:
    return F.concat_ws(":", "document_id", F.coalesce("source_hash", F.lit("no-hash")), "family", "country", F.coalesce("variant", F.lit("no-variant")))


def in_review_queue() -> Column:
    return F.coalesce("review_required", F.lit(False)) | F.coalesce(F.col("status") == "review", F.lit(False))


def report_ready() -> Column:
    return F.coalesce(F.col("report_html") != "", F.lit(False))


def processed() -> Column:
    return F.col("decision") != "pending"


def materialised() -> Column:
    """Processed, decided, with a confidence, fields and sections."""
    held = F.col("processed_at").isNotNull() & (F.col("decision") != "pending") & F.col("confidence").isNotNull()
    return F.coalesce(held & (F.size("fields") > 0) & (F.size("sections") > 0), F.lit(False))


def retain(documents: DataFrame, now: str, report_days: int = 90, review_days: int = 180) -> DataFrame:
    """Without reports of records, and without sessions, strictly older than so many days; ``changed`` tells if anything went."""
    t = F.lit(now).cast("timestamp")
    old = lambda at, days: F.coalesce(F.unix_millis(t) - F.unix_millis(at.cast("timestamp")) > days * 86_400_000, F.lit(False))
    kept = F.filter("sessions", lambda s: ~old(s["updated_at"], review_days))
    gone = old(F.col("updated_at"), report_days) & report_ready()
    changed = gone | F.coalesce(F.size(kept) != F.size("sessions"), F.lit(False))
    return documents.withColumns({"changed": changed, "report_html": F.when(~gone, F.col("report_html")), "sessions": kept})


def job_feed(documents: DataFrame) -> DataFrame:
    """Records with a job, by the newest job; of one time as they stand."""
    return documents.where("job is not null").orderBy(F.desc("job.created_at"), "ord")


def worker_summary(documents: DataFrame, requested: int) -> DataFrame:
    """One row on the records a cycle has processed; strategies as they first come."""
    seen = F.array_sort(F.collect_list(F.when(F.col("routing_strategy") != "", F.struct("ord", "routing_strategy"))))
    count = lambda c: F.count_if(c)
    return documents.agg(
        F.lit(requested).alias("requested"), F.count("*").alias("processed"), count(F.col("job.status") == "completed").alias("completed"), count(F.col("job.status") == "failed").alias("failed"),
        count(F.col("job.queue") == "dlq").alias("sent_to_dlq"), count(F.col("decision") == "human_review").alias("review"), count(F.col("decision") == "auto_accept").alias("auto_accepted"),
        count(F.col("decision") == "accept_with_warning").alias("accept_with_warning"), F.array_join(F.array_distinct(F.transform(seen, lambda x: x["routing_strategy"])), ",").alias("routing_strategies"),
    )


# golden sets


def field_map() -> Column:
    """Trimmed values by field name; of a name the last."""
    return last_wins(F.transform("fields", lambda f: F.struct(f["field_name"].alias("key"), normal(f["normalized"]).alias("value"))))


def golden_set(documents: DataFrame) -> DataFrame:
    return documents.where(reviewed()).select("document_id", "filename", "family", "country", "variant", "pack_id", "decision", field_map().alias("expected"), F.col("last_reviewed_at").alias("reviewed_at"))


def reviewed_examples(documents: DataFrame) -> DataFrame:
    """Training examples of reviewed records: what was read, what it should be, and the edits by time."""
    source = F.transform("fields", lambda f: F.struct(f["field_name"].alias("field_name"), f["label"].alias("label"), normal(F.coalesce(f["raw"], f["normalized"])).alias("value"), f["page"].alias("page"), f["engine"].alias("engine"), f["evidence"].alias("evidence")))
    changes = F.transform(edits(), lambda e: F.struct(e["field_name"].alias("field_name"), normal(e["previous"]).alias("previous"), normal(e["new"]).alias("new"), e["reason"].alias("reason"), e["created_at"].alias("created_at")))
    done = F.coalesce(F.exists("sessions", lambda s: s["status"] == "completed"), F.lit(False))
    return documents.where(reviewed()).select(
        "document_id", "filename", "family", "country", "variant", "pack_id", "decision", done.alias("review_completed"), F.struct(source.alias("fields")).alias("source"),
        F.struct(field_map().alias("fields"), changes.alias("edits")).alias("target"), F.struct("processed_at", F.col("last_reviewed_at").alias("reviewed_at")).alias("metadata"),
    )


def evaluate_golden(golden: DataFrame, documents: DataFrame) -> DataFrame:
    """(document_id, matched, total, exact_match_rate, mismatches): expected fields against the record's.

    A field's actual value is that of its first occurrence; without one, of its
    last edit. A record that is gone has none. Equal also means both null.
    """
    actual = documents.select("document_id", F.col("fields").alias("a_fields"), edits().alias("a_edits"))
    rows = golden.select("document_id", "expected").join(actual, "document_id", "left")

    def value(name: Column) -> Column:
        own = F.filter("a_fields", lambda f: f["field_name"] == name)
        last = F.try_element_at(F.filter("a_edits", lambda e: e["field_name"] == name), F.lit(-1))
        return F.when(F.size(own) > 0, normal(F.get(own, F.lit(0))["normalized"])).otherwise(normal(last["new"]))

    checked = F.transform(F.map_entries("expected"), lambda e: F.struct(e["key"].alias("field_name"), normal(e["value"]).alias("expected"), value(e["key"]).alias("actual")))
    wrong = F.filter("checked", lambda c: ~c["expected"].eqNullSafe(c["actual"]))
    out = rows.select("document_id", checked.alias("checked"))
    n = F.size("checked")
    return out.select("document_id", (n - F.size(wrong)).alias("matched"), n.alias("total"), rate(n - F.size(wrong), n).alias("exact_match_rate"), wrong.alias("mismatches"))


def golden_totals(evaluated: DataFrame) -> DataFrame:
    m, n = F.coalesce(F.sum("matched"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))
    return evaluated.agg(F.count("*").alias("documents"), n.alias("total_fields"), m.alias("exact_matches"), rate(m, n).alias("exact_match_rate"))


# exports


def is_identifier(name: Column) -> Column:
    return name.rlike("(?i)rut|run|dni|cedula|cuenta|document")


def is_name(name: Column) -> Column:
    return name.rlike("(?i)name|nombre|titular|holder|issuer|emisor")


def redacted(name: Column, value: Column) -> Column:
    """A field's value as others may see it, by its field's name; empty and null stay."""
    hidden = F.when(is_identifier(name), mask_ends(F.regexp_replace(value, SPACE + "+", ""))).when(is_name(name), redact_name(value)).otherwise(value)
    return F.when(value == "", value).otherwise(hidden)


def redact_record(documents: DataFrame) -> DataFrame:
    """Holder and issuer as initials, and each field's value, raw text and evidence by the field's kind; runs without text or tokens; edits like their fields."""
    by_name = lambda f, *cs: f.withField(cs[0], redacted(f["field_name"], f[cs[0]])) if len(cs) == 1 else by_name(by_name(f, cs[0]), *cs[1:])
    out = documents.withColumn("fields", F.transform("fields", lambda f: by_name(f, "normalized", "raw", "evidence")))
    out = out.withColumn("sessions", F.transform("sessions", lambda s: s.withField("edits", F.transform(s["edits"], lambda e: by_name(e, "previous", "new")))))
    for c in ("holder_name", "issuer"):
        if c in documents.columns:
            out = out.withColumn(c, F.when(F.col(c) == "", F.col(c)).otherwise(redact_name(c)))
    if "runs" in documents.columns:
        out = out.withColumn("runs", F.transform("runs", lambda r: r.withField("text", F.lit("[REDACTED]")).withField("tokens", F.filter(r["tokens"], lambda t: F.lit(False)))))
    return out


def canonical_payload(documents: DataFrame, at: str, redact: bool = False) -> DataFrame:
    """(document_id, payload): the record's published columns as JSON."""
    shown = ["filename", "family", "country", "variant", "status", "decision", "issuer", "holder_name", "page_count", "confidence", "review_required", "assumptions", "fields", "issues", "sections", "sessions", "job"]
    base = redact_record(documents) if redact else documents
    return base.select("document_id", F.to_json(F.struct(F.col("document_id").alias("id"), *(c for c in shown if c in base.columns), F.lit(at).alias("generated_at")), {"ignoreNullFields": "false"}).alias("payload"))


FIELD_COLUMNS = (
    "document_id", "filename", "field_id", "section", "field_name", "label", "normalized_value", "raw_text", "confidence", "page_number", "engine",
    "validation_status", "review_status", "issue_ids", "evidence_text", "candidate_count", "agreement_ratio", "disagreement",
)


def csv_cell(c: Column) -> Column:
    """As text, null empty, quoted only around quotes, commas and line breaks."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(s.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def field_rows(documents: DataFrame, redact: bool = False) -> DataFrame:
    """A row of the 18 columns of FIELD_COLUMNS for each field of each record, and its place in the record."""
    base = redact_record(documents) if redact else documents
    rows = base.select("document_id", "filename", F.posexplode("fields").alias("place", "f"))
    shown = {"normalized_value": "normalized", "raw_text": "raw", "page_number": "page", "evidence_text": "evidence", "agreement_ratio": "agreement"}
    kinds = dict(rows.select("f.*").dtypes)

    def value(c: str) -> Column:
        name = shown.get(c, c)
        if c == "issue_ids":
            return F.array_join("f.issue_ids", "|") if "issue_ids" in kinds else F.lit("")
        if c == "candidate_count":
            return F.coalesce(F.size("f.candidates"), F.lit(0)) if "candidates" in kinds else F.lit(0)
        if c == "disagreement":
            return F.when(F.col("f.agreement").isNotNull(), F.col("f.disagreement"))
        return F.col(f"f.{name}") if name in kinds else F.lit(None).cast("string")

    return rows.select("place", *(F.col(c) if c in ("document_id", "filename") else value(c).alias(c) for c in FIELD_COLUMNS))


def field_csv_lines(documents: DataFrame, redact: bool = False) -> DataFrame:
    """(document_id, place, line): the lines of the field export, without its header."""
    return field_rows(documents, redact).select("document_id", "place", F.concat_ws(",", *(csv_cell(F.col(c)) for c in FIELD_COLUMNS)).alias("line"))


# The fields a result's summary shows.
KEY_FIELDS = ("nombre-completo", "nombres", "apellidos", "run", "numero-de-documento", "numero", "fecha-de-nacimiento", "fecha-de-emision", "fecha-de-vencimiento", "sexo", "nacionalidad", "lugar-de-nacimiento")


def result_summary(documents: DataFrame, key_fields: tuple[str, ...] = KEY_FIELDS, most: int = 12, issues: int = 6) -> DataFrame:
    """The first key fields and issues of a record, and how many of each it has."""
    keys = F.slice(F.filter("fields", lambda f: f["field_name"].isin(*key_fields)), 1, most)
    return documents.select(
        "document_id", submission_status().alias("submission_status"), "decision", "confidence",
        F.transform(keys, lambda f: F.struct(f["field_name"].alias("field_name"), f["label"].alias("label"), f["normalized"].alias("value"), f["confidence"].alias("confidence"), f["page"].alias("page"))).alias("key_fields"),
        F.slice("issues", 1, issues).alias("issues"), F.size("fields").alias("n_fields"), F.size("sections").alias("n_sections"), F.size("issues").alias("n_issues"),
    )


def link_issues(label: Column, field_name: Column, issues: Column) -> Column:
    """Ids of issues whose field's slug is that of the label or of the name."""
    return F.transform(F.filter(issues, lambda i: (slugify(i["field"]) == slugify(label)) | (slugify(i["field"]) == slugify(field_name))), lambda i: i["id"])


def bounding_box(polygon: Column) -> Column:
    """Least corner and extent of an array of points [x, y]; null without points."""
    x, y = F.transform(polygon, lambda p: p[0]), F.transform(polygon, lambda p: p[1])
    box = F.struct(F.array_min(x).alias("x"), F.array_min(y).alias("y"), (F.array_max(x) - F.array_min(x)).alias("width"), (F.array_max(y) - F.array_min(y)).alias("height"))
    return F.when(F.size(polygon) > 0, box)
