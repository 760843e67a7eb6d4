"""A document's pages together: which one stands for it, which sides it has, and what identifiers both sides show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import mrz
from ..functions.identifiers import canonical_document_number, canonical_run, run_valid
from ..functions.text import let
from .classification import ENOUGH, classification

# What an identifier looks like in each country, and the words of lines that hold one.
PATTERNS = {"CL": r"\b(?:\d{1,2}\.?\d{3}\.?\d{3}|\d{7,8})-[\dkK]\b", "PE": r"\b\d{8}\b", "CO": r"\b\d{6,10}\b"}
HINTS = {"CL": ("RUN", "RUT", "NUMERO", "DOCUMENTO"), "PE": ("DNI", "NUMERO", "DOCUMENTO"), "CO": ("CEDULA", "IDENTIFICACION", "NUMERO", "DOCUMENTO")}


def analyze(pages: DataFrame, family: Column, country: Column) -> DataFrame:
    """(doc_id, pages, page, pack_id, family, country, variant, confidence, supported, side, both_sides) of pages (doc_id, page, text), blank ones left out.

    Pages without a sure pack are classified again with what the surest page of
    their document says, and keep what is better. The page that stands for the
    document is the front of an identity before others, a supported one before
    others, then the surest, then the first.
    """
    rows = pages.where(F.coalesce(F.trim(F.regexp_replace("text", r"\s+", " ")) != "", F.lit(False))).withColumn("c", classification(F.col("text"), family, country))
    of_document = Window.partitionBy("doc_id")
    seed = F.max(F.struct(F.col("c.confidence").alias("confidence"), (-F.col("page")).alias("p"), F.col("c.supported").alias("supported"), F.col("c.family").alias("family"), F.col("c.country").alias("country"))).over(of_document)
    rows = rows.withColumn("seed", seed)
    told = lambda name, asked: F.when(F.col("seed.supported"), F.col(f"seed.{name}")).otherwise(asked)
    rows = rows.withColumn("weak", ~(F.col("c.supported") & (F.col("c.confidence") >= ENOUGH))).withColumn("again", F.when(F.col("weak"), classification(F.col("text"), told("family", family), told("country", country))))
    rows = rows.withColumn("c", F.when(F.coalesce(F.col("again.confidence") > F.col("c.confidence"), F.lit(False)), F.col("again")).otherwise(F.col("c")))
    first = F.coalesce((F.col("c.family") == "identity") & (F.col("c.side") == "front"), F.lit(False))
    best = F.max(F.struct(first.alias("f"), F.col("c.supported").alias("s"), F.col("c.confidence").alias("confidence"), (-F.col("page")).alias("p"), F.col("c").alias("c")))
    names = lambda c: F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c))))
    per = rows.groupBy("doc_id").agg(F.count("*").alias("pages"), best.alias("b"), names("c.side").alias("sides"), names("c.family").alias("families"), names("c.country").alias("countries"))
    both = (F.array_join("sides", ",") == "back,front") & (F.size("families") == 1) & (F.size("countries") == 1)
    side = F.when(both, "front+back").when(F.size("sides") == 1, F.col("sides")[0]).otherwise(F.col("b.c.side"))
    return per.select("doc_id", "pages", (-F.col("b.p")).alias("page"), "b.c.pack_id", "b.c.family", "b.c.country", "b.c.variant", F.col("b.confidence").alias("confidence"), F.col("b.s").alias("supported"), side.alias("side"), both.alias("both_sides"))


def _bare(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"[.\s]", ""))


def _canonical(value: Column, country: str) -> Column:
    if country == "CL":
        serial = canonical_document_number(F.lit("CL"), value)
        return F.when(run_valid(value), _bare(canonical_run(value))).when(serial.rlike(r"^[A-Z]{1,2}\d{1,3}\.\d{3}\.\d{3}$"), _bare(serial))
    number = canonical_document_number(F.lit(country), value)
    return F.when(number.rlike(r"\p{Nd}"), number)


def identifiers(text: Column, country: str) -> Column:
    """Identifiers of a side's text, each once: those of a Chilean zone, of hinted lines, then any in the text. Of a Chilean side every line counts too."""
    pattern, hints = PATTERNS.get(country, PATTERNS["CO"]), HINTS.get(country, HINTS["CO"])
    lines = F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0b\f\x1c-\x1e\x{85}\x{2028}\x{2029}]")
    found = lambda c: F.nullif(F.regexp_extract(c, pattern, 0), F.lit(""))
    hinted = F.filter(lines, lambda x: F.upper(x).rlike("|".join(hints)))
    of_lines = F.flatten(F.transform(hinted, lambda x: F.array(F.coalesce(_canonical(found(x), country), found(x)), _canonical(x, country))))
    anywhere = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0)), lambda x: F.coalesce(_canonical(x, country), x))
    parts = [of_lines]
    if country == "CL":
        zone = let(mrz.parse_td1(F.coalesce(text, F.lit(""))), lambda z: F.array(_canonical(z["run"], "CL"), _bare(canonical_document_number(F.lit("CL"), z["document_number"]))))
        parts = [zone, of_lines, F.transform(lines, lambda x: _bare(canonical_document_number(F.lit("CL"), x)))]
    return F.array_distinct(F.filter(F.concat(*parts, anywhere), lambda x: F.coalesce(x != "", F.lit(False))))


def sides_agree(front: Column, back: Column) -> Column:
    """A struct of the identifier of either side, the first they share where they share one, and whether they agree: null if a side has none."""
    shared = F.get(F.array_intersect(front, back), F.lit(0))
    one = lambda side: F.coalesce(shared, F.get(side, F.lit(0)))
    return F.struct(one(front).alias("front"), one(back).alias("back"), F.when(shared.isNotNull(), True).when((F.size(front) > 0) & (F.size(back) > 0), False).alias("match"))
