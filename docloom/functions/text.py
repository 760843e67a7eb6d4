"""String canonicalisation, predicates and masks as native columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F



def _without_marks() -> tuple[str, str]:
    """Characters below U+3000 that compatibility decomposition leaves as one other character; behind them, without a counterpart, the combining marks."""
    bare = {chr(k): "".join(x for x in unicodedata.normalize("NFKD", chr(k)) if not unicodedata.combining(x)) for k in range(0xA0, 0x3000)}
    one = {a: b for a, b in bare.items() if len(b) == 1 and a != b}
    return "".join(one) + "".join(a for a, b in bare.items() if not b and unicodedata.combining(a)), "".join(one.values())


ACCENTED, PLAIN = _without_marks()
#: White space in Unicode's sense, and what parts words in it; that it is none of the visible ASCII characters is looked at first.
SPACE = r"[[^\x21-\x7e]&&[\s\x{1c}-\x{1f}\x{85}\p{Z}]]"
#: White space that isn't one blank already, to be collapsed.
SPACES = rf" {SPACE}+|[[^\x20-\x7e]&&{SPACE}]{SPACE}*"
# Texts that stand for a missing value; in rules; and in pages' texts.
MISSING = ("", "-", "NO DETECTADO", "NO DETECTADA", "NO DETECTADOS", "NO DETECTADAS", "PENDING")
MISSING_IN_RULES = (*MISSING, "NOMBRE POR CONFIRMAR")
MISSING_IN_PAGES = ("", "-", "NO DETECTADO", "NO DETECTADA", "NO DETECTADOS", "NO DETECTADAS", "NOMBRE POR CONFIRMAR", "EMISOR POR CONFIRMAR", "REGISTRO / EMISOR POR CONFIRMAR")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, f) -> Column:
    """f(value), with value computed once a row however often f names it.

    By ``element_at``, which derives its type once: ``[0]`` does so for every row, by a walk over all of f.
    """
    return F.element_at(F.transform(F.array(value), f), 1)


def some(c: Column) -> Column:
    """The text, or null where it is empty; unlike nullif it names c once, which inside a lambda is how often c is computed, and has no lambda itself, so that c can be compiled."""
    return F.try_element_at(F.array_remove(F.array(c), F.lit("")), F.lit(1))


def strip_accents(c: Column | str) -> Column:
    """Without marks; characters that decompose into several, such as ligatures and fractions, stay as they are."""
    # a text of as many bytes as characters has none
    return let(col(c), lambda x: F.when(F.octet_length(x) > F.length(x), F.translate(x, ACCENTED, PLAIN)).otherwise(x))


def strip_accents_of(c: Column | str) -> Column:
    """``strip_accents`` of a column that stands there already: c is named several times, but Spark compiles this, while it interprets lambdas."""
    c = col(c)
    return F.when(F.octet_length(c) > F.length(c), F.translate(c, ACCENTED, PLAIN)).otherwise(c)


def slugify(c: Column | str) -> Column:
    return F.btrim(F.regexp_replace(F.lower(strip_accents(c)), r"[^\p{L}\p{N}]+", "-"), F.lit("-"))


def compact(c: Column | str) -> Column:
    """Equality key: letters and digits only, without marks, small."""
    return F.regexp_replace(F.lower(strip_accents(c)), r"[^\p{L}\p{N}]", "")


def cleaned(c: Column | str) -> Column:
    """White space collapsed, blanks, colons and dashes trimmed."""
    return F.btrim(F.regexp_replace(col(c), SPACES, " "), F.lit(" :-"))


def clean_value(c: Column | str) -> Column:
    """``cleaned``; empty is null."""
    return some(cleaned(c))


def is_missing(c: Column | str, values: tuple[str, ...] = MISSING) -> Column:
    return F.coalesce(F.upper(F.trim(col(c))).rlike(f"^(?:{'|'.join(values)})\\z"), F.lit(True))


def is_missing_in_pages(c: Column | str) -> Column:
    """Of the cleaned text without marks; also whatever begins with SIN, without, and a blank."""
    return missing_when_clean(clean_value(c))


def missing_when_clean(c: Column) -> Column:
    """``is_missing_in_pages`` of a text that is cleaned."""
    return let(strip_accents(c), lambda x: is_missing(x, MISSING_IN_PAGES) | F.coalesce(F.upper(x).startswith("SIN "), F.lit(True)))


def mask_ends(c: Column | str, first: int = 2, last: int = 2) -> Column:
    """Ends visible, at least four stars between; short values all stars."""
    c = col(c)
    stars = F.repeat(F.lit("*"), F.greatest(F.length(c) - first - last, F.lit(4)))
    return F.when(F.length(c) <= first + last, F.repeat(F.lit("*"), F.length(c))).otherwise(F.concat(F.left(c, F.lit(first)), stars, F.right(c, F.lit(last))))


def redact_name(c: Column | str) -> Column:
    """Initial and three stars for each word."""
    words = F.filter(F.split(F.trim(col(c)), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.left(w, F.lit(1)), F.lit("***"))), " ")


def keyword_present(text: Column | str, keyword: str) -> Column:
    """In the text as it is spaced, or with both compacted."""
    return F.lower(strip_accents(text)).contains(keyword.lower()) | compact(text).contains("".join(ch for ch in keyword.lower() if ch.isalnum()))


def squeezed(c: Column | str) -> Column:
    """White space collapsed and trimmed; null is empty."""
    return F.btrim(F.regexp_replace(F.coalesce(col(c), F.lit("")), SPACE + "+", " "), F.lit(" "))


def _count(c: Column, kind: str) -> Column:
    return F.length(F.regexp_replace(c, f"[^{kind}]", ""))


def label_like(c: Column | str) -> Column:
    """A line of at most 48 characters, four digits at most, and 0.45 of what isn't blank letters."""
    return let(squeezed(c), lambda x: F.length(x).between(1, 48) & (_count(x, r"\p{Nd}") <= 4) & (_count(x, r"\p{L}") >= 0.45 * F.length(F.replace(x, F.lit(" "), F.lit("")))))


def value_like(c: Column | str) -> Column:
    """Three characters or more with a digit, or two words, or a capital first."""
    return let(squeezed(c), lambda x: (F.length(x) > 2) & (x.rlike(r"\p{Nd}") | x.contains(" ") | x.rlike(r"^\p{Lu}")))


def table_row_like(c: Column | str) -> Column:
    """Three words or more, a date, period or grouped amount among them, and four digits at least."""
    found = r"\b(?:20\d{2}[-/]\d{2}(?:[-/]\d{2})?|\d{1,3}(?:[.,]\d{3})+(?:[.,]\d{2})?|\d{2}[-/]\d{2}[-/]\d{4})\b"
    return let(squeezed(c), lambda x: (F.size(F.split(x, " ")) >= 3) & x.rlike(found) & (_count(x, r"\p{Nd}") >= 4))


def lines(c: Column | str) -> Column:
    """Cleaned lines, empty ones dropped."""
    return F.filter(F.transform(F.split(col(c), "\n"), cleaned), lambda x: x != "")


def cells(c: Column | str) -> Column:
    """Cells of a laid-out row: split at two or more blanks, else at bars."""
    c = col(c)
    return F.when(c.rlike(r"\S\s{2,}\S"), F.split(F.trim(c), r"\s{2,}")).otherwise(F.transform(F.split(c, r"\|"), lambda x: F.trim(x)))


def value_type(c: Column | str) -> Column:
    """Of a pipeline's value: ten characters with separators in a date's places; digits and separators alone; else text."""
    c = col(c)
    return F.when(c.rlike(r"(?s)^.{4}[-/].{2}[-/].{2}$"), "date").when(c.rlike(r"^[\p{Nd},.-]+$"), "number").otherwise("text")


def record_value_type(c: Column | str) -> Column:
    """Of a stored record's value: only an ISO date is one."""
    c = col(c)
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), "date").when(c.rlike(r"^[\d.,-]+$"), "number").otherwise("text")


def stable_uuid(c: Column | str) -> Column:
    """A UUID as it stands; of any other seed SHA-1 in the shape of a version-5 UUID."""
    h = F.sha1(col(c).cast("binary"))
    part = lambda a, n: F.substr(h, F.lit(a), F.lit(n))
    made = F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(F.lit("a"), part(18, 3)), part(21, 12))
    return F.when(col(c).rlike(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"), col(c)).otherwise(made)


# Fixed value: an inline pair; a label has these characters alone.
INLINE_PAIR = r"^(?iu)([A-Z0-9ÁÉÍÓÚÜÑ./()\- ]{2,48}?)\s*[:=]\s+(.+)$"


def key_value(c: Column | str) -> tuple[Column, Column]:
    """Label and value of an inline ``label: value`` or ``label = value``, both of their likes; empty without one."""
    pair = key_value_pair(c)
    return pair["label"], pair["value"]


def key_value_pair(c: Column | str) -> Column:
    """``key_value`` as one struct, for those who need both."""
    label, value = (squeezed(F.regexp_extract(col(c), INLINE_PAIR, k)).alias(name) for k, name in ((1, "label"), (2, "value")))
    empty = F.struct(F.lit("").alias("label"), F.lit("").alias("value"))
    return let(F.struct(label, value), lambda s: F.when((s["label"] != "") & label_like(s["label"]) & value_like(s["value"]), s).otherwise(empty))


def gender(c: Column | str) -> Column:
    return let(F.upper(F.trim(strip_accents(c))), lambda x: F.when(x.isin("M", "MASCULINO", "MALE", "HOMBRE"), "M").when(x.isin("F", "FEMENINO", "FEMALE", "MUJER"), "F").when(x.isin("X"), "X"))


# What is masked inside a text, in this order.
IDENTIFYING = (r"\b[^\s@]+@[^\s@]+\.[^\s@]+\b", r"\b\d{4}-\d{4}-\d{8,}\b", r"\b(?:\d{1,2}\.?\d{3}\.?\d{3}|\d{7,8})-[\dkK]\b", r"\b\d{8,10}\b")


def redact_inline(c: Column | str) -> Column:
    """Mail addresses, account numbers, RUTs and runs of eight to ten digits, in that order, with two characters shown at either end."""
    def masked(pattern: str):
        found = lambda x: F.transform(F.regexp_extract_all(x, F.lit(f"(?U){pattern}"), F.lit(0)), lambda m: mask_ends(m))
        return lambda x: F.array_join(F.zip_with(F.split(x, f"(?U){pattern}"), found(x), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    c = col(c)
    for pattern in IDENTIFYING:
        c = let(c, masked(pattern))
    return c


def shortened(c: Column | str, limit: int = 160) -> Column:
    return F.substr(col(c), F.lit(1), F.lit(limit))


def safe_preview(c: Column | str, limit: int = 160) -> Column:
    return shortened(redact_inline(c), limit)


def split_given_name(c: Column | str, given: list[str]) -> tuple[Column, Column]:
    """(given name, rest) of names written as one word: the longest listed name it starts with, if more than two letters follow.

    Else the whole is the rest, from four letters up.
    """
    bare = F.regexp_replace(F.upper(strip_accents(c)), "[^A-Z]", "")
    listed = f"^({'|'.join(sorted(given, key=len, reverse=True))})(?=.{{3}})"
    behind = lambda b: let(F.length(F.regexp_extract(b, listed, 1)), lambda n: F.when(n > 0, F.substr(b, n + 1)).when(F.length(b) >= 4, b))
    return some(F.regexp_extract(bare, listed, 1)), let(bare, behind)


def split_surnames(c: Column | str, surnames: list[str]) -> Column:
    """Listed surnames, the longest first, as long as the word goes on with one; then what is left."""
    listed = "|".join(sorted(surnames, key=len, reverse=True))

    def parts(bare: Column) -> Column:
        whole = F.regexp_extract(bare, f"^((?:{listed})*+)", 1)
        return let(whole, lambda w: F.filter(F.concat(F.regexp_extract_all(w, F.lit(f"({listed})"), F.lit(1)), F.array(F.substr(bare, F.length(w) + 1))), lambda x: x != ""))

    return let(F.regexp_replace(F.upper(strip_accents(c)), "[^A-Z]", ""), parts)
