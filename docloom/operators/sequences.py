"""Ordered operators: leads, anchored folds, stratified sampling, page segments, table rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import PERIOD, month_number
from ..functions.evidence import first_date
from ..functions.identifiers import RUN, canonical_run
from ..functions.text import SPACE, clean_value, key_value_pair, label_like, let, some, squeezed, strip_accents_of, value_like


def per_key(rows: DataFrame, ordered: int, f, schema: str) -> DataFrame:
    """``f`` over the sorted rows (tuples) of each value of the first column, which are sorted by the first ``ordered``.

    Rows are dealt by key and sorted by Spark; a task streams them and holds one
    key's rows, so many small groups cost no call of their own.
    """
    names = rows.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        columns = [c.split()[0] for c in schema.split(", ")]
        for frame in frames:
            out: list[tuple] = []
            for r in frame.itertuples(index=False, name=None):
                if held and r[0] != held[0][0]:
                    out += f(held)
                    held = []
                held.append(r)
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame(f(held) if held else [], columns=columns)

    return rows.repartition(names[0]).sortWithinPartitions(*names[:ordered]).mapInPandas(run, schema)


def line_table(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, line_no, line): a row for each line."""
    return docs.select("doc_id", F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def key_value_pairs(lines: DataFrame) -> DataFrame:
    """(doc_id, page, place, label, value, raw_line) of lines (doc_id, page, line_no, line), white space collapsed and empty ones left out.

    A line is a pair by itself (``label: value``), or its label, in capitals and of
    five words at most, is followed by a value on the next line of its page. Of
    the same page, label and value, whatever their case, the last stays, at the first one's place.
    """
    w = Window.partitionBy("doc_id").orderBy("line_no")
    rows = lines.withColumn("line", squeezed("line")).where("line <> ''")
    rows = rows.withColumn("next", F.when(F.lead("page").over(w) == F.col("page"), F.lead("line").over(w)))
    below = (F.size(F.split("line", " ")) <= 5) & (F.upper("line") == F.col("line")) & label_like("line") & value_like("next")
    made = lambda label, value, raw: F.struct(label.alias("label"), value.alias("value"), raw.alias("raw_line"))
    pick = lambda p: F.when(p["label"] != "", made(p["label"], p["value"], F.col("line"))).when(below, made(F.col("line"), F.col("next"), F.concat_ws(" -> ", "line", "next")))
    # behind a generator, so that the test isn't pushed below and the pair made once more for it
    pairs = rows.select("doc_id", "page", "line_no", F.explode_outer(F.array(let(key_value_pair("line"), pick))).alias("p")).where("p is not null").select("doc_id", "page", "line_no", "p.*")
    return pairs.groupBy("doc_id", "page", F.lower("label").alias("l"), F.lower("value").alias("v")).agg(F.min("line_no").alias("place"), *(F.max_by(c, "line_no").alias(c) for c in ("label", "value", "raw_line"))).drop("l", "v")


def latest(rows: DataFrame, key: str, order: str, tie: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order), F.desc(tie))
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def stratified_limit(rows: DataFrame, by: list[str], order: str, limit: int) -> DataFrame:
    """Round-robin over strata in order of their first row; the first ``limit``."""
    w = Window.partitionBy(*by)
    dealt = rows.withColumn("rn", F.row_number().over(w.orderBy(order))).withColumn("first_ord", F.min(order).over(w))
    # a row beyond the limit in its own stratum can't be among the first
    return dealt.where(F.col("rn") <= limit).orderBy("rn", "first_ord", order).limit(limit)


def cluster_lines(tokens: DataFrame) -> DataFrame:
    """Line number of each token (doc_id, token_id, page, x, y, height).

    Tokens go by page, centre, left edge. A new line starts where the page changes
    or the centre lies further from the line's first one than max(10, 0.75 times
    the document's upper median height). The anchor stays, so a lag won't do.
    """

    def run(rows: list[tuple]) -> list[tuple]:
        heights = sorted(r[5] for r in rows)
        reach = max(10.0, 0.75 * heights[len(heights) // 2])
        line, page, anchor, out = -1, None, 0.0, []
        for doc, page_now, y, _, token, _ in rows:
            if page_now != page or abs(y - anchor) > reach:
                line, page, anchor = line + 1, page_now, y
            out.append((doc, token, line))
        return out

    return per_key(tokens.select("doc_id", "page", "y", "x", "token_id", "height"), 5, run, "doc_id long, token_id long, line long")


def segment_pages(pages: DataFrame) -> DataFrame:
    """Segment of each page (doc_id, page, family, country, base_pack, side, variant).

    A page joins if family and country are those of the segment's first page, and
    so is its variant; or, of identities, its pack, or their sides are front and back.
    A document's pages are held by one task: they hang on the segment's first.
    """

    def run(rows: list[tuple]) -> list[tuple]:
        seg, head, out = -1, None, []
        for r in rows:
            doc, page, family, country, pack, side, variant = r
            alike = head is not None and (family, country) == head[2:4]
            same = alike and ((variant or "") == (head[6] or "") or family == "identity" and (bool(pack) and pack == head[4] or {side, head[5]} == {"front", "back"}))
            if not same:
                seg, head = seg + 1, r
            out.append((doc, page, seg))
        return out

    return per_key(pages.select("doc_id", "page", "family", "country", "base_pack", "side", "variant"), 2, run, "doc_id long, page long, segment long")


def segments(pages: DataFrame) -> DataFrame:
    """(doc_id, segment, first_page, last_page, n_pages, side, mixed): a document's segments, the side that their pages show together, and whether it has several."""
    rows = pages.join(segment_pages(pages), ["doc_id", "page"])
    sides = F.array_sort(F.collect_set(F.when(F.col("side") != "", F.col("side"))))
    side = F.when(sides == F.array(F.lit("back"), F.lit("front")), "front+back").when(F.size(sides) >= 1, F.min_by("side", F.when(F.col("side") != "", F.col("page"))))
    out = rows.groupBy("doc_id", "segment").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count("*").alias("n_pages"), side.alias("side"))
    return out.withColumn("mixed", F.count("*").over(Window.partitionBy("doc_id")) > 1)


def greedy_rows(rows: DataFrame) -> DataFrame:
    """Matched, missing and extra rows of each document's expected and actual tables (side, ord, cells map).

    An expected row's own non-empty cells decide; each takes the first actual row that fits and isn't taken.
    """

    def run(rows: list[tuple]) -> list[tuple]:
        expected = [dict(r[3]) for r in rows if r[2] == "expected"]
        actual = [dict(r[3]) for r in rows if r[2] == "actual"]
        free, matched = list(range(len(actual))), 0
        for e in expected:
            hit = next((k for k in free if all(actual[k].get(c) == v for c, v in e.items() if v)), None)
            if hit is not None:
                free.remove(hit)
                matched += 1
        return [(rows[0][0], matched, len(expected) - matched, len(free))]

    return per_key(rows.select("doc_id", "ord", "side", "cells"), 2, run, "doc_id long, matched long, missing long, extra long")


# Amounts and stored dates inside a certificate's line, and what stands behind its table.
AMOUNT, STORED_DATE = r"\b\d{1,3}(?:[.,]\d{3})+(?:[.,]\d{2})?\b", r"\b20\d{2}[-/]\d{2}[-/]\d{2}\b"
FOOTERS = ("LOS CODIGOS DE COTIZACION", "CORDIALMENTE", "SERVICIO DE INFORMACION", "PUEDES OBTENER EL MISMO CERTIFICADO")


def period_rows(lines: DataFrame) -> DataFrame:
    """Rows of a certificate's table from its lines (doc_id, line_no, line): (doc_id, row, period, period_label, date, amount, renta_amount, pension_amount, code, employer, employer_rut, detail).

    A line with a period opens a row, which takes the lines up to the next one or
    a footer; a running count tells rows apart. The opening line has amounts and a
    code, or an employer with a RUT; what it lacks comes from the lines below, in order.

    What a line may give is made of each line by itself, before lines are brought
    together: an empty text where it gives nothing. Lines below that have neither a
    RUT nor a date go on with a code of a period without payment, else the first is
    the employer.
    """
    w = Window.partitionBy("doc_id").orderBy("line_no")
    c, empty = F.col, F.lit("")
    rows = lines.withColumn("plain", F.upper(strip_accents_of("line"))).withColumn("opens", F.col("plain").rlike(PERIOD))
    rows = rows.withColumns({"head": F.when(c("opens"), c("line")), "top": F.when(c("opens"), c("plain")), "below": F.when(~c("opens"), c("line")), "kind": F.when(c("opens"), 1).when(c("plain").rlike("|".join(FOOTERS)), 0)})

    rows = rows.withColumn("found", F.array_distinct(F.regexp_extract_all("head", F.lit(AMOUNT), F.lit(0))))
    zeros = F.length("head") - F.length(F.replace("head", F.lit("$0"), empty)) >= 4
    rows = rows.withColumns({"amounts": F.when((F.size("found") == 0) & zeros, F.array(F.lit("0"), F.lit("0"))).otherwise(c("found")), "rest": F.regexp_extract("top", f"(?s)^.*?{PERIOD}(.*)$", 3)})
    for k in (0, 1):
        at = F.expr(f"instr(rest, get(amounts, {k}))")
        rows = rows.withColumn("rest", F.when(at > 0, F.substr("rest", at + F.length(F.get("amounts", F.lit(k))))).otherwise(c("rest")))
    # an opening line is looked at behind its amounts, another as a whole
    rows = rows.withColumn("code", clean_value("rest")).withColumn("said", F.when(c("opens"), c("code")).otherwise(c("line")))
    rows = rows.withColumn("found_rut", F.regexp_extract("said", RUN, 0)).withColumns({"rut": F.when(c("found_rut") != "", canonical_run("found_rut")), "date": first_date("said")})
    before = F.get(F.split("code", RUN, 2), F.lit(0))
    rows = rows.withColumn("named", F.when(c("opens") & c("rut").isNotNull(), clean_value(F.when(c("date").isNotNull(), F.replace(before, c("date"), F.lit(" "))).otherwise(before))))
    hidden = lambda x: F.contains(F.upper(strip_accents_of(x)), F.lit("PERIODO SIN"))
    rows = rows.withColumn("named", F.when(~hidden(c("named")), c("named"))).withColumn("code", F.when(c("named").isNull(), c("code")))

    bare = (c("found_rut") == "") & ~c("below").rlike(STORED_DATE)
    collapsed = F.rtrim(F.regexp_replace("below", SPACE + "+", " "), F.lit(" :-"))
    one, two = F.get("amounts", F.lit(0)), F.get("amounts", F.lit(1))
    period = F.concat_ws("-", F.regexp_extract("top", PERIOD, 2), month_number(F.regexp_extract("top", PERIOD, 1)))
    rows = rows.select(
        "doc_id", "line_no", "line", "opens", "kind", F.coalesce(F.when(c("opens"), c("named")).when(bare, clean_value("below")), empty).alias("employer"), F.coalesce(F.when(c("opens"), c("code")).when(bare, F.ltrim(collapsed)), empty).alias("code"),
        F.coalesce("rut", empty).alias("rut"), F.coalesce("date", empty).alias("date"), F.when(c("opens"), F.struct(period.alias("period"), F.regexp_extract("top", PERIOD, 0).alias("label"), one.alias("one"), two.alias("two"), F.coalesce(hidden(c("code")), F.lit(False)).alias("hidden"))).alias("h"),
    )
    rows = rows.withColumn("state", F.last("kind", True).over(w)).withColumn("row", F.sum(c("opens").cast("int")).over(w))
    blocks = rows.where("state = 1").groupBy("doc_id", "row").agg(F.sort_array(F.collect_list(F.struct("line_no", "line", "employer", "code", "rut", "date", "h"))).alias("l"))
    blocks = blocks.withColumn("h", c("l")[0]["h"])
    given = lambda name: F.array_remove(c(f"l.{name}"), empty)
    first = lambda name: F.get(given(name), F.lit(0))
    return blocks.select(
        "doc_id", "row", c("h.period").alias("period"), c("h.label").alias("period_label"), first("date").alias("date"), F.coalesce("h.two", "h.one").alias("amount"), c("h.one").alias("renta_amount"), c("h.two").alias("pension_amount"),
        F.when(c("h.hidden"), F.array_join(given("code"), " ")).otherwise(some(c("l")[0]["code"])).alias("code"), F.when(~c("h.hidden"), first("employer")).alias("employer"), first("rut").alias("employer_rut"), clean_value(F.array_join("l.line", " ")).alias("detail"),
    )


def nearby(lines: DataFrame, labels: DataFrame, distance: int) -> DataFrame:
    """Nearest value line within some lines of a label, below before above at the same distance."""
    span = F.explode(F.array(*[F.lit(d) for d in range(-distance, distance + 1) if d])).alias("step")
    want = labels.select("doc_id", F.col("line_no").alias("label_no"), span).withColumn("line_no", F.col("label_no") + F.col("step"))
    hit = want.join(lines, ["doc_id", "line_no"])
    return hit.groupBy("doc_id", "label_no").agg(F.min_by("line", F.struct(F.abs("step"), -F.sign("step"))).alias("value"))
