"""Identity numbers and check digits as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_value, col, is_missing, let, some, strip_accents


def run_digit(body: Column | str) -> Column:
    """Modulo-11 check character of a digit string: weights 2 to 7 from the right, 11 is 0, 10 is K."""
    digits = F.transform(F.split(F.reverse(col(body)), ""), lambda d: d.cast("int"))
    total = F.aggregate(F.transform(digits, lambda d, i: d * (i % 6 + 2)), F.lit(0), lambda a, x: a + x)
    return let(11 - total % 11, lambda rest: F.when(rest == 11, "0").when(rest == 10, "K").otherwise(rest.cast("string")))


# Fixed value: a RUN or RUT inside a text; its verifier stands behind a hyphen.
RUN = r"(?iU)(?:RUN|RUT)?\s*(\d{1,2}[.,]?\d{3}[.,]?\d{3}\s*-\s*[\dkK])"


def canonical_run(c: Column | str) -> Column:
    """Dots every three digits and a capital verifier, of the first number with a hyphen inside the text; without one it is only cleaned, and null if it stands for a missing value."""
    def dotted(found: Column) -> Column:
        digits, verifier = F.regexp_replace(F.substring_index(found, "-", 1), r"\D", ""), F.substring_index(found, "-", -1)
        return F.concat(F.regexp_replace(digits, r"(?<=\d)(?=(\d{3})+$)", "."), F.lit("-"), verifier)

    def of(cleaned: Column) -> Column:
        found = F.upper(F.regexp_replace(F.regexp_extract(strip_accents(cleaned), RUN, 1), r"\s+", ""))
        # there is none without a hyphen
        return F.when(~is_missing(cleaned), F.when(cleaned.contains("-"), let(found, lambda f: F.when(f != "", dotted(f)).otherwise(cleaned))).otherwise(cleaned))

    return let(clean_value(c), of)


def run_valid(c: Column | str) -> Column:
    """Whether the verifier behind the first hyphen is that of the digits before it."""
    return let(canonical_run(c), _run_holds)


def _run_holds(run: Column) -> Column:
    digits, verifier = F.regexp_replace(F.substring_index(run, "-", 1), r"\D", ""), F.regexp_extract(run, r"(?s)^[^-]*-(.+)$", 1)
    return F.coalesce((digits != "") & (verifier != "") & (run_digit(digits) == F.upper(verifier)), F.lit(False))


def mrz_value(ch: Column) -> Column:
    """0-9 as they are, A-Z from 10, filler 0."""
    return F.greatest(F.call_function("instr", F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ch) - 1, F.lit(0))


def mrz_digit(c: Column | str) -> Column:
    """Check digit with weights 7, 3, 1."""
    weight = lambda i: F.when(i % 3 == 0, 7).when(i % 3 == 1, 3).otherwise(1)
    total = F.aggregate(F.transform(F.split(col(c), ""), lambda ch, i: mrz_value(ch) * weight(i)), F.lit(0), lambda a, x: a + x)
    return total % 10


def td3_valid(second: Column | str) -> Column:
    """All five check digits of the second line of a TD3 zone."""
    def checks(s: Column) -> Column:
        part = lambda a, n: F.substr(s, F.lit(a), F.lit(n))
        # a filler is no check digit, not even of an empty personal number
        is_digit = lambda of, at: mrz_digit(of).cast("string") == part(at, 1)
        whole = F.concat(part(1, 10), F.lit(""), part(11, 3), part(14, 7), part(21, 1), part(22, 7), part(29, 15))
        return (F.length(s) == 44) & is_digit(part(1, 9), 10) & is_digit(part(14, 6), 20) & is_digit(part(22, 6), 28) & is_digit(part(29, 14), 43) & is_digit(whole, 44)

    return let(col(second), checks)


def canonical_document_number(country: Column | str, c: Column | str) -> Column:
    """PE: eight digits on end, else eight in all; CO: six to ten in all; CL: a serial with dots; else as cleaned, and null if it stands for a missing value."""

    def of_serial(serial: Column, cleaned: Column) -> Column:
        cut = lambda n: F.concat_ws(".", F.substr(serial, F.lit(1), F.lit(n)), F.substr(serial, F.lit(n + 1), F.lit(3)), F.substr(serial, F.lit(n + 4)))
        return F.when(serial.rlike(r"^[A-Z]\d{8}$"), cut(3)).when(serial.rlike(r"^[A-Z]{2}\d{7}$"), cut(4)).otherwise(cleaned)

    def found(s: Column) -> Column:
        of, cleaned, bare = s["of"], s["c"], s["b"]
        eight, dotted = F.regexp_extract(bare, r"(?<!\d)(\d{8})(?!\d)", 1), F.upper(F.regexp_extract(bare, r"(?i)\b[A-Z]{1,2}\d{1,3}\.\d{3}\.\d{3}\b", 0))
        digits, serial = F.regexp_replace(bare, r"[^\p{Nd}]", ""), F.upper(F.regexp_replace(bare, "[^A-Z0-9]", ""))
        digits_of = lambda low, high: let(digits, lambda d: F.when(F.length(d).between(low, high), d).otherwise(cleaned))
        return (
            F.when(of == "PE", let(eight, lambda e: F.when(e != "", e).otherwise(digits_of(8, 8))))
            .when(of == "CO", digits_of(6, 10))
            .when(of == "CL", let(dotted, lambda x: F.when(x != "", x).otherwise(let(serial, lambda y: of_serial(y, cleaned)))))
            .otherwise(cleaned)
        )

    of = F.upper(col(country)).alias("of")
    return let(clean_value(c), lambda x: F.when(~is_missing(x), let(F.struct(of, x.alias("c"), strip_accents(x).alias("b")), found)))


def passport_number(c: Column | str) -> Column:
    """The number inside the text, else the text cleaned and in capitals; null if it stands for a missing value."""
    found = lambda x: some(F.regexp_extract(F.upper(strip_accents(x)), r"\b([A-Z]{1,2}\d{7,8})\b", 1))
    return let(clean_value(c), lambda x: F.when(~is_missing(x), F.coalesce(found(x), F.upper(x))))
