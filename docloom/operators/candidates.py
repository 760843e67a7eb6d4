"""What each successful run read for a field: candidates with their scores, one of a kind, the best first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import normalize_date
from ..functions.identifiers import canonical_document_number, canonical_run
from ..functions.text import MISSING_IN_RULES, compact, is_missing, let, slugify, some
from .sections import holder_name, is_placeholder

CANDIDATE = "struct<engine:string,source:string,value:string,raw_text:string,confidence:double,page:int,match_type:string>"
# Slugs of names and labels that a run's values are looked up by, each kind in its own way.
HOLDERS, HOLDER_LABELS = ("holder-name", "titular", "nombre-completo", "nombres", "apellidos", "apellido"), ("titular", "nombre-completo", "nombres", "apellidos")
NUMBERS, NUMBER_KEYS = ("document-number", "numero-de-documento", "numero", "dni", "cedula", "numero-de-identificacion"), ("numero-de-documento", "numero-de-identificacion", "numero", "dni", "cedula")
DATE_KEYS = (
    (("birth-date", "fecha-de-nacimiento"), ("fecha-de-nacimiento",)),
    (("issue-date", "fecha-de-emision", "fecha-de-expedicion"), ("fecha-de-emision", "fecha-de-expedicion")),
    (("expiry-date", "fecha-de-vencimiento", "fecha-de-expiracion", "fecha-de-caducidad"), ("fecha-de-vencimiento", "fecha-de-expiracion", "fecha-de-caducidad")),
)
BONUS = {"layout-pair": 0.08, "page-text": 0.04, "run-heuristic": 0.1}


def candidate_score(wanted: Column, found: Column, confidence: Column, match_type: Column) -> Column:
    """Of compact values: 0.12, then for an equal, a containing or another one, the confidence, and how it was found; an empty one is worth nothing."""
    near = (wanted != "") & (F.contains(wanted, found) | F.contains(found, wanted))
    s = 0.12 + F.when((wanted != "") & (wanted == found), 0.55).when(near, 0.36).otherwise(0.18)
    s = s + F.when(confidence.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)) * 0.2).otherwise(0.0)
    bonus = F.lit(0.0)
    for kind, points in BONUS.items():
        bonus = F.when(match_type == kind, points).otherwise(bonus)
    return F.when(found == "", 0.0).otherwise(F.round(F.least(F.lit(1.0), s + bonus), 3))


def from_values(run: Column, name: Column, label: Column) -> Column:
    """What a run's own values (a map by slug) say of a field, in the form of its kind; null without."""
    v = run["values"]
    first = lambda *keys: F.coalesce(*(some(F.try_element_at(v, F.lit(k))) for k in keys))
    given = lambda c: let(c, lambda x: F.when(~is_missing(x, MISSING_IN_RULES), x))
    holder = let(holder_name(v, run["holder_name"]), lambda h: F.when(~is_placeholder(h), h))
    out = given(F.coalesce(some(F.try_element_at(v, name)), F.try_element_at(v, label)))
    out = F.when(name == "mrz", given(F.try_element_at(v, F.lit("mrz")))).otherwise(out)
    out = F.when(name == "run", canonical_run(F.try_element_at(v, F.lit("run")))).otherwise(out)
    for names, keys in reversed(DATE_KEYS):
        out = F.when(name.isin(*names), normalize_date(first(*keys))).otherwise(out)
    out = F.when(name.isin(*NUMBERS), canonical_document_number(run["country"], first(*NUMBER_KEYS))).otherwise(out)
    out = F.when(name.isin(*HOLDERS) | label.isin(*HOLDER_LABELS), holder).otherwise(out)
    return F.when((F.size(v) > 0) | (F.coalesce(run["holder_name"], F.lit("")) != ""), out)


def _token(run: Column, v: Column) -> Column:
    """An equal token, the first; else of those that hold the value or are held by it, the most confident, then the longest, then the first."""
    equal = F.get(F.filter(run["tokens"], lambda t: t["c"] == v), F.lit(0))
    part = F.filter(F.transform(run["tokens"], lambda t, i: F.struct(t["confidence"].alias("confidence"), F.length(t["c"]).alias("n"), (-i).alias("i"), t.alias("t"))), lambda x: (x["n"] >= 4) & (F.contains(v, x["t"]["c"]) | F.contains(x["t"]["c"], v)))
    return F.when(F.length(v) >= 4, F.coalesce(equal, F.array_max(F.transform(part, lambda x: F.struct(x["confidence"], x["n"], x["i"], x["t"].alias("t"))))["t"]))


def _pair(run: Column, f: Column) -> Column:
    """A pair of the field's label whose value isn't at odds; else of a label like it; else of the value alone."""
    v, first = f["v"], lambda when: F.get(F.filter(run["pairs"], when), F.lit(0))
    named = first(lambda p: ((p["l"] == f["label_slug"]) | (p["l"] == f["name_slug"])) & ((v == "") | F.contains(p["c"], v) | F.contains(v, p["c"])))
    alike = first(lambda p: F.contains(f["label_slug"], p["l"]) | F.contains(p["l"], f["label_slug"]) | F.contains(f["name_slug"], p["l"]))
    return F.coalesce(named, alike, F.when(v != "", first(lambda p: F.contains(p["c"], v))))


def _of_run(run: Column, f: Column) -> Column:
    """A run's candidates for a field: what was matched, and what its own values say if that is something else."""
    hits = F.struct(_token(run, f["v"]).alias("token"), _pair(run, f).alias("pair"), F.when(F.length(f["v"]) >= 4, F.get(F.filter(run["pages"], lambda p: F.contains(p["c"], f["v"])), F.lit(0))).alias("page"), from_values(run, f["name_slug"], f["label_slug"]).alias("own"))

    def made(value: Column, raw: Column, confidence: Column, page: Column, kind: str) -> Column:
        return F.struct(run["engine"].alias("engine"), run["source"].alias("source"), value.alias("value"), raw.alias("raw_text"), confidence.cast("double").alias("confidence"), page.cast("int").alias("page"), F.lit(kind).alias("match_type"))

    def found(h: Column) -> Column:
        sure, one = run["average_confidence"], F.lit(1)
        own = made(h["own"], h["own"], sure, one, "run-heuristic")
        primary = (
            F.when(h["token"].isNotNull(), made(h["token"]["text"], h["token"]["text"], h["token"]["confidence"], h["token"]["page"], "token")).when(h["pair"].isNotNull(), made(h["pair"]["value"], h["pair"]["raw_line"], sure, h["pair"]["page"], "layout-pair"))
            .when(h["page"].isNotNull(), made(f["value"], f["value"], sure, h["page"]["page"], "page-text")).when(h["own"].isNotNull(), own)
        )
        other = lambda p: let(compact(h["own"]), lambda c: (c != "") & (c != F.coalesce(some(compact(p["value"])), compact(p["raw_text"]), F.lit(""))))
        more = lambda p: F.when(p.isNotNull() & h["own"].isNotNull() & other(p), own)
        return let(primary, lambda p: F.array_compact(F.array(p, more(p))))

    return let(hits, found)


def field_candidates(fields: DataFrame, runs: DataFrame) -> DataFrame:
    """(document_id, field, rank, engine, source, value, raw_text, confidence, page, match_type, selected, score) for fields (document_id, field, label, value).

    runs: (document_id, ord, source, engine, success, average_confidence, country, holder_name, values, tokens, pairs, pages), tokens of
    (text, confidence, page), pairs of (label, value, page, raw_line), pages of
    (page, text). A document's runs meet its fields in one join, and every field is
    matched in its row. Of one source, compact value and page the best-scored
    candidate stays; they rank by (selected, score, confidence), then as they came.
    """
    prepared = runs.where("success").select(
        "document_id", "ord", "source", "engine", "average_confidence", "country", "holder_name", "values",
        F.transform("tokens", lambda t: F.struct(t["text"].alias("text"), t["confidence"].cast("double").alias("confidence"), t["page"].cast("int").alias("page"), F.coalesce(compact(t["text"]), F.lit("")).alias("c"))).alias("tokens"),
        F.transform("pairs", lambda p: F.struct(p["value"].alias("value"), p["raw_line"].alias("raw_line"), p["page"].cast("int").alias("page"), slugify(p["label"]).alias("l"), F.coalesce(compact(p["value"]), F.lit("")).alias("c"))).alias("pairs"),
        F.transform("pages", lambda p: F.struct(p["page"].cast("int").alias("page"), F.coalesce(compact(p["text"]), F.lit("")).alias("c"))).alias("pages"),
    )
    of_document = prepared.groupBy("document_id").agg(F.collect_list(F.struct(*[c for c in prepared.columns if c != "document_id"])).alias("runs"))
    of_document = of_document.withColumn("runs", F.array_sort("runs", lambda a, b: F.when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0)))
    rows = fields.join(of_document, "document_id").withColumn("f", F.struct("value", F.coalesce(compact("value"), F.lit("")).alias("v"), slugify("label").alias("label_slug"), slugify("field").alias("name_slug")))
    rows = rows.withColumn("found", F.flatten(F.transform("runs", lambda r: _of_run(r, F.col("f")))))
    key = lambda c, s: F.when(s != "", s).otherwise(F.coalesce(compact(c["raw_text"]), F.lit(""))).alias("k")
    scored = lambda c, i, s: F.struct(i.alias("i"), key(c, s), candidate_score(F.col("f.v"), s, c["confidence"], c["match_type"]).alias("score"), ((s == F.col("f.v")) & (F.coalesce(F.col("value"), F.lit("")) != "")).alias("selected"), c.alias("c"))
    rows = rows.withColumn("keyed", F.transform("found", lambda c, i: let(F.coalesce(compact(c["value"]), F.lit("")), lambda s: scored(c, i, s))))
    same = lambda a, b: (a["c"]["source"] == b["c"]["source"]) & (a["k"] == b["k"]) & (a["c"]["page"] == b["c"]["page"])
    alike = lambda a: F.filter("keyed", lambda b: same(a, b))
    best = F.filter("keyed", lambda a: ~F.exists(alike(a), lambda b: (b["score"] > a["score"]) | ((b["score"] == a["score"]) & (b["i"] < a["i"]))))
    # of equal rank, the key that came first
    order = F.transform(best, lambda a: F.struct((~a["selected"]).alias("s"), (-a["score"]).alias("p"), (-F.coalesce(a["c"]["confidence"], F.lit(0.0))).alias("q"), F.array_min(F.transform(alike(a), lambda b: b["i"])).alias("i"), a.alias("a")))
    rows = rows.withColumn("ranked", F.array_sort(order))  # by its fields in turn; no two have the same i
    # behind an inner posexplode Spark tests the array's size further down, with all that makes the array in the test over and over
    out = rows.select("document_id", "field", F.posexplode_outer("ranked").alias("p", "x")).where("p is not null")
    return out.select("document_id", "field", (F.col("p") + 1).alias("rank"), "x.a.c.*", "x.a.selected", "x.a.score")

