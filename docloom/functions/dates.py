"""Business dates stay strings: recognised shapes become yyyy-MM-dd, all else passes unchanged."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_value, col, let, missing_when_clean, strip_accents

# Names of months, whole words.
MONTHS = {
    "ENE": "01", "ENERO": "01", "FEB": "02", "FEBRERO": "02", "MAR": "03", "MARZO": "03", "ABR": "04", "ABRIL": "04", "MAY": "05", "MAYO": "05", "JUN": "06", "JUNIO": "06", "JUL": "07", "JULIO": "07",
    "AGO": "08", "AGOSTO": "08", "SEP": "09", "SEPT": "09", "SET": "09", "SEPTIEMBRE": "09", "OCT": "10", "OCTUBRE": "10", "NOV": "11", "NOVIEMBRE": "11", "DIC": "12", "DICIEMBRE": "12",
}
# The shapes of dates, in the order they are tried; day, month and year are groups.
ISO, DAY_FIRST, SPACED = r"^\d{4}[-/]\d{2}[-/]\d{2}$", r"^(\d{2})[-/](\d{2})[-/](\d{4})$", r"\b(\d{2})\s+(\d{2})\s+(\d{4})\b"
GLUED, LONG, PERIOD = r"^(\d{2})([A-Z]{3,5})(\d{4})$", r"(\d{1,2})\s+DE\s+([A-Z]{3,12})\s+DE\s+(\d{4})", r"\b(ENE|FEB|MAR|ABR|MAY|JUN|JUL|AGO|SEP|SET|OCT|NOV|DIC)[-/](20\d{2})\b"


def month_number(c: Column) -> Column:
    """Of a month's name in capitals; null if unknown."""
    return F.try_element_at(F.expr("map(" + ", ".join(f"'{k}', '{v}'" for k, v in MONTHS.items()) + ")"), c)


def normalize_date(c: Column | str) -> Column:
    """yyyy-MM-dd of a date that is the whole text, or of a spaced or long one inside it; else the text cleaned. No calendar check."""
    def found(text: Column) -> Column:
        ascii_, glued = text["a"], text["g"]
        part = lambda pattern, k, of: F.regexp_extract(of, pattern, k)
        built = lambda pattern, of, month: F.concat_ws("-", part(pattern, 3, of), month, F.lpad(part(pattern, 1, of), 2, "0"))
        short, long_ = month_number(part(GLUED, 2, glued)), month_number(part(LONG, 2, ascii_))
        return (
            F.when(ascii_.rlike(ISO), F.replace(ascii_, F.lit("/"), F.lit("-")))
            .when(ascii_.rlike(DAY_FIRST), built(DAY_FIRST, ascii_, part(DAY_FIRST, 2, ascii_)))
            .when(ascii_.rlike(SPACED), built(SPACED, ascii_, part(SPACED, 2, ascii_)))
            .when(short.isNotNull(), built(GLUED, glued, short))
            .when(long_.isNotNull(), built(LONG, ascii_, long_))
            .otherwise(text["c"])
        )

    # no shape has fewer than five digits
    shaped = lambda s, a: F.when(a.rlike(r"\d(?:\D*\d){4}"), let(F.struct(s.alias("c"), a.alias("a"), F.regexp_replace(a, r"\s+", "").alias("g")), found)).otherwise(s)
    return let(clean_value(c), lambda s: let(strip_accents(F.upper(s)), lambda a: shaped(s, a)))


def strict_date(c: Column | str) -> Column:
    # without digits there is no date to look for
    return let(col(c), lambda x: F.when(x.rlike(r"\d\d\D*\d\d"), let(normalize_date(x), lambda n: F.when(n.rlike(r"^\d{4}-\d{2}-\d{2}$"), n))))


def normalize_period(c: Column | str) -> Column:
    """yyyy-MM of the first MMM-yyyy or MMM/yyyy inside the text; null without one."""
    return let(F.upper(strip_accents(clean_value(c))), lambda x: F.when(x.rlike(PERIOD), F.concat_ws("-", F.regexp_extract(x, PERIOD, 2), month_number(F.regexp_extract(x, PERIOD, 1)))))


def sequence_valid(birth: Column | str, issue: Column | str, expiry: Column | str) -> Column:
    """Birth before issue before expiry, one at least; false if one that is there is no date."""
    date = lambda x: F.try_to_date(F.when(x.rlike(r"^(\d{4}-\d{2}-\d{2}|\d{8})$"), F.replace(x, F.lit("-"), F.lit(""))), "yyyyMMdd")
    read = lambda x: let(clean_value(x), lambda v: let(F.when(~missing_when_clean(v), v), lambda g: F.struct(g.isNotNull().alias("given"), date(g).alias("date"))))
    ok = lambda x, y: F.coalesce(x < y, F.lit(True))

    def holds(s: Column) -> Column:
        b, i, e = (s[k]["date"] for k in "bie")
        broken = (s["b"]["given"] & b.isNull()) | (s["i"]["given"] & i.isNull()) | (s["e"]["given"] & e.isNull())
        return ~broken & F.coalesce(b, i, e).isNotNull() & ok(b, i) & ok(i, e) & ok(b, e)

    return let(F.struct(read(birth).alias("b"), read(issue).alias("i"), read(expiry).alias("e")), holds)


def mrz_date(c: Column | str, pivot: int = 40) -> Column:
    """yyMMdd; years below the pivot are of 2000."""
    def full(c: Column) -> Column:
        year = F.substr(c, F.lit(1), F.lit(2))
        century = F.when(year.cast("int") < pivot, "20").otherwise("19")
        return F.when(c.rlike(r"^\d{6}$"), F.concat(century, year, F.lit("-"), F.substr(c, F.lit(3), F.lit(2)), F.lit("-"), F.substr(c, F.lit(5), F.lit(2))))

    return let(col(c), full)


def next_retry(at: Column | str, attempts: Column | str, base_seconds: int) -> Column:
    """Exponential: base * 2 ** max(0, attempts - 1) seconds on."""
    wait = base_seconds * F.pow(F.lit(2), F.greatest(F.lit(0), col(attempts) - 1))
    return F.timestamp_seconds(F.unix_seconds(col(at)) + wait.cast("long"))
