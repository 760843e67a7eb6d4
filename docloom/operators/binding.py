"""Binding values to what was read: tokens, labelled pairs, files, tenants and fields of a caller's own schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import normalize_date
from ..functions.text import col, compact, let, slugify, stable_uuid

# Words that are no keywords, aliases by what a field is about, and patterns of plain text.
STOPWORDS = ("con", "de", "del", "el", "field", "holder", "la", "las", "los", "name", "nombre", "para", "schema", "titular", "with")
NUMBER = r"-?\d{1,3}(?:[.,]\d{3})*(?:[.,]\d+)?|-?\d+(?:[.,]\d+)?"
DATE = r"\b(?:\d{4}[-/]\d{2}[-/]\d{2}|\d{2}[-/]\d{2}[-/]\d{4})\b"
UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}$"
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".heic", ".heif", ".avif", ".pdf")


def _pieces(c: str, lengths: str) -> Column:
    """Different substrings of c that have one of the lengths."""
    at = lambda n: F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substr(F.col(c), i, n))
    return F.array_distinct(F.flatten(F.transform(F.filter(lengths, lambda n: n <= F.length(c)), at)))


def _lengths(rows: DataFrame, on: list[str], c: str) -> DataFrame:
    return rows.groupBy(*on).agg(F.collect_set(F.length(c)).alias("lengths"))


def holding(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """(on, a, rank): of each different a of (on, a) that holds any b of (on, b, rank), the least rank.

    Forms meet by hash, as pieces of the lengths that there are: work follows the
    rows and their lengths, not their pairs.
    """
    b = b.groupBy(*on, "b").agg(F.min("rank").alias("rank"))
    pieces = a.select(*on, "a").distinct().join(_lengths(b, on, "b"), on).select(*on, "a", F.explode(_pieces("a", "lengths")).alias("b"))
    return pieces.join(b, [*on, "b"]).groupBy(*on, "a").agg(F.min("rank").alias("rank"))


def held(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """As ``holding``, of each a that is inside any b."""
    a, b = a.select(*on, "a").distinct(), b.groupBy(*on, "b").agg(F.min("rank").alias("rank"))
    pieces = b.join(_lengths(a, on, "a"), on).select(*on, F.explode(_pieces("b", "lengths")).alias("a"), "rank")
    return a.join(pieces.groupBy(*on, "a").agg(F.min("rank").alias("rank")), [*on, "a"])


def match_tokens(values: DataFrame, tokens: DataFrame) -> DataFrame:
    """For each (document_id, field, value) the token (ord) of (document_id, ord, text, confidence) that it was read from; null without.

    An equal compact form comes first, the earliest. Else, one holding the other,
    the most confident, longest, earliest. Forms below four characters match nothing.
    """
    v = values.select("document_id", "field", compact("value").alias("v")).where(F.length("v") >= 4)
    t = tokens.select("document_id", "ord", "confidence", compact("text").alias("t")).where(F.length("t") >= 4)
    # equal forms meet by hash; only forms without one are looked for inside others
    equal = v.join(t.groupBy("document_id", F.col("t").alias("v")).agg(F.min("ord").alias("ord")), ["document_id", "v"]).groupBy("document_id", "field").agg(F.min("ord").alias("ord"))
    rest = v.join(equal, ["document_id", "field"], "left_anti").withColumnRenamed("v", "a")
    forms, on = t.select("document_id", F.col("t").alias("b"), F.struct((-F.col("confidence")).alias("confidence"), (-F.length("t")).alias("length"), "ord").alias("rank")), ["document_id"]
    found = rest.join(holding(rest, forms, on).unionByName(held(rest, forms, on)), ["document_id", "a"])
    part = found.groupBy("document_id", "field").agg(F.min("rank")["ord"].alias("ord"))
    return values.select("document_id", "field").join(equal.unionByName(part), ["document_id", "field"], "left")


def match_pairs(fields: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each (document_id, field, label, value) the pair (ord) of (document_id, ord, label, value) it belongs to, and the tier; null without.

    0: an equal label, values not at odds; 1: one label in the other; 2: the value alone.
    """
    f = fields.select("document_id", "field", slugify("label").alias("fl"), slugify("field").alias("fn"), F.coalesce(compact("value"), F.lit("")).alias("fv"))
    p = pairs.select("document_id", F.col("ord").alias("rank"), slugify("label").alias("pl"), F.coalesce(compact("value"), F.lit("")).alias("pv"))
    on, by_label = ["document_id"], ["document_id", "label"]
    # of a tier, what a field asks with, and the earliest pair of each such form
    named, of_label = f.select("document_id", "field", F.explode(F.array_distinct(F.array("fl", "fn"))).alias("label"), F.col("fv").alias("a")), p.select("document_id", F.col("pl").alias("label"), F.col("pv").alias("b"), "rank")
    first = named.join(holding(named, of_label, by_label).unionByName(held(named, of_label, by_label)), [*by_label, "a"])
    asks = lambda c: f.select("document_id", "field", F.col(c).alias("a"))
    labels, said, value = p.withColumnRenamed("pl", "b"), p.withColumnRenamed("pv", "b"), asks("fv").where("a <> ''")
    in_label = asks("fl").unionByName(asks("fn"))
    second = in_label.join(holding(in_label, labels, on), ["document_id", "a"]).unionByName(asks("fl").join(held(asks("fl"), labels, on), ["document_id", "a"]))
    third = value.join(held(value, said, on), ["document_id", "a"])
    tiers = [x.select("document_id", "field", F.lit(k).alias("tier"), F.col("rank").alias("ord")) for k, x in enumerate((first, second, third))]
    best = tiers[0].unionByName(tiers[1]).unionByName(tiers[2]).groupBy("document_id", "field").agg(F.min(F.struct("tier", "ord")).alias("best"))
    return fields.select("document_id", "field").join(best, ["document_id", "field"], "left").select("document_id", "field", "best.tier", "best.ord")


def source_files(references: DataFrame, files: DataFrame) -> DataFrame:
    """For each (folder, name) of references the file of (folder, name) it describes: of its own name, else the least image of its stem; null without."""
    name = F.col("name")
    bare = F.when(name.startswith("response_"), F.substr(name, F.lit(len("response_") + 1))).otherwise(F.regexp_replace(name, r"^(.*?)JSON_", "$1"))
    stem = lambda c: F.regexp_replace(c, r"(?<=.)\.[^.]*$", "")
    r = references.select("folder", name.alias("reference"), F.replace(bare, F.lit(".json"), F.lit("")).alias("original"))
    direct = files.select("folder", F.col("name").alias("original"), F.col("name").alias("direct")).distinct()
    image = files.where(F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1)).isin(*IMAGE_SUFFIXES))
    image = image.groupBy("folder", stem(F.col("name")).alias("stem")).agg(F.min("name").alias("by_stem"))
    out = r.join(direct, ["folder", "original"], "left").withColumn("stem", stem(F.col("original"))).join(image, ["folder", "stem"], "left")
    return out.select("folder", "reference", F.coalesce("direct", "by_stem").alias("file"))


def resolve_tenants(requests: DataFrame, tenants: DataFrame, default: str = "default-workspace") -> tuple[DataFrame, DataFrame]:
    """(request_id, tenant_id) of requests (request_id, tenant), and the tenants (id, slug) to make for them.

    An id first, then a slug; blank is the default's. A tenant's new id follows from its slug, so a replay makes none twice.
    """
    asked = requests.select("request_id", F.coalesce(F.nullif(F.trim("tenant"), F.lit("")), F.lit(default)).alias("asked"))
    by_id = tenants.select(F.col("id").alias("asked"), F.col("id").alias("by_id")).where(F.col("asked").rlike(UUID))
    by_slug = tenants.groupBy(F.col("slug").alias("asked")).agg(F.min("id").alias("by_slug"))
    found = asked.join(by_id, "asked", "left").join(by_slug, "asked", "left").withColumn("known", F.coalesce("by_id", "by_slug"))
    made = stable_uuid("asked")
    new = found.where("known is null").select(made.alias("id"), F.col("asked").alias("slug")).distinct()
    return found.select("request_id", F.coalesce("known", made).alias("tenant_id")), new


def _led_by(words: Column, when: Column, aliases: tuple[str, ...]) -> Column:
    return let(words, lambda w: F.when(when, F.concat(F.array_except(F.array(*map(F.lit, aliases)), w), w)).otherwise(w))


def keywords(field: Column | str, description: Column | str) -> Column:
    """At most eight words of a field's name and description, those it is also known by in front."""
    name, about = F.lower(col(field)), F.lower(F.coalesce(col(description), F.lit("")))
    words = F.flatten(F.array(*(F.split(c, "[^a-z0-9]+") for c in (name, about, F.replace(name, F.lit("_"), F.lit(" "))))))
    words = F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*STOPWORDS)))
    for when, aliases in (
        (name.contains("rut") | about.contains("rut") | name.contains("run"), ("run", "rut")),
        (name.contains("account") | name.contains("cuenta") | about.contains("capitalizacion"), ("account", "capitalizacion", "cuenta")),
        (name.contains("certificate") | name.contains("certificado") | about.contains("certificado"), ("certificate", "certificado")),
    ):
        words = _led_by(words, when, aliases)
    return F.slice(words, 1, 8)


def label_score(label: Column, value: Column, words: Column, weight: int) -> Column:
    """``weight`` for each keyword in the label and 1 for each in the value; 0 without one in the label."""
    hits = lambda c: let(slugify(c), lambda s: F.size(F.filter(words, lambda w: F.contains(s, w))))
    return let(hits(label), lambda n: F.when(n > 0, weight * n + hits(F.coalesce(value, F.lit("")))).otherwise(0))


def typed(value: Column, kind: Column) -> Column:
    """A date normalised, the first number, or the text; blank is null."""
    as_kind = lambda v: F.when(kind == "date", normalize_date(v)).when(kind == "number", F.coalesce(F.nullif(F.regexp_extract(v, NUMBER, 0), F.lit("")), v)).otherwise(v)
    return let(F.nullif(F.trim(value), F.lit("")), as_kind)


def custom_fields(docs: DataFrame, schema: dict[str, dict[str, str]]) -> DataFrame:
    """A row for each document and field of a caller's schema {field: {type, description}}.

    docs: (document_id, text, family, supported, known array<struct<label,value>>, pairs array<struct<label,value>>).
    The best known value by keywords, else the best pair, else for an unsupported
    document the first date or number of the text. Everything a field needs is in
    its document's row, so nothing is joined.
    """
    one = lambda k, v: F.struct(F.lit(k).alias("field"), F.lit((v.get("type") or "string").strip().lower()).alias("kind"), F.lit((v.get("description") or "").strip()).alias("about"))
    if not schema:
        return docs.select("document_id", *(F.lit(None).cast(t).alias(c) for c, t in (("field", "string"), ("value", "string"), ("confidence", "double"), ("source", "string")))).where("false")
    rows = docs.withColumn("f", F.explode(F.array(*(one(k, v) for k, v in schema.items())))).select("*", "f.field", "f.kind", "f.about").withColumn("words", keywords("field", "about"))

    def best(of: str, weight: int) -> Column:
        usable = F.filter(F.coalesce(F.col(of), F.lit([]).cast("array<struct<label:string,value:string>>")), lambda x: (weight == 4) | (F.trim(x["value"]) != ""))
        scored = F.transform(usable, lambda x, i: F.struct(label_score(x["label"], x["value"], F.col("words"), weight).alias("s"), (-i).alias("i"), x["label"].alias("label"), x["value"].alias("value")))
        return F.array_max(F.filter(scored, lambda x: x["s"] > 0))

    rows = rows.withColumn("k", best("known", 5)).withColumn("p", best("pairs", 4))
    own = lambda c: slugify(c) == slugify("field")
    number, date = F.nullif(F.regexp_extract("text", NUMBER, 0), F.lit("")), F.nullif(F.regexp_extract("text", DATE, 0), F.lit(""))
    plain = F.when(F.col("supported"), None).when(F.col("kind") == "date", let(date, normalize_date)).when(F.col("kind") == "number", number)
    known, pair = F.col("k").isNotNull(), F.col("p").isNotNull()
    value = F.when(known, typed(F.col("k.value"), F.col("kind"))).when(pair, typed(F.col("p.value"), F.col("kind"))).otherwise(plain)
    sure = F.when(known, F.when(own("k.label"), 0.91).otherwise(0.82)).when(pair, F.when(own("p.label"), 0.88).otherwise(0.74)).otherwise(F.when(plain.isNotNull(), 0.56).otherwise(0.12))
    lifted = F.col("supported") & (F.col("family") != "unclassified") & F.col("value").isNotNull()
    out = rows.select("document_id", "field", value.alias("value"), sure.alias("sure"), F.when(known, "supported-pack").when(pair, "layout-key-value").otherwise("text-fallback").alias("source"), "supported", "family")
    return out.select("document_id", "field", "value", F.when(lifted, F.least(F.lit(0.99), F.round(F.col("sure") + 0.03, 3))).otherwise(F.col("sure")).alias("confidence"), "source")
