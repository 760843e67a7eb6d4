"""Compatibility decomposition (NFKD) without marks, for every code point, as native columns."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

#: Hangul syllables decompose by arithmetic: 19 leading consonants, 21 vowels, 28 endings, of which the first is none.
HANGUL, _LEAD, _VOWEL, _TAIL = 0xAC00, 0x1100, 0x1161, 0x11A7
_COUNT = (19, 21, 28)


def _bare(k: int) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", chr(k)) if not unicodedata.combining(x))


@cache
def _tables() -> tuple[str, str, str, list[tuple[str, str]]]:
    """Characters that become one other and that one, those that vanish behind them; and, for each place, characters of several and what they have there."""
    one, gone, many = {}, [], {}
    for k in range(0x80, 0x110000):
        if 0xD800 <= k < 0xE000 or HANGUL <= k < HANGUL + 19 * 21 * 28:
            continue
        b = _bare(k)
        if not b:
            gone.append(chr(k))
        elif len(b) > 1:
            many[chr(k)] = b
        elif b != chr(k):
            one[chr(k)] = b
    longest = max(map(len, many.values()))
    places = []
    for n in range(longest):
        has = {c: b[n] for c, b in many.items() if len(b) > n}
        # a character that is over by now is named behind the others: translate drops it
        places.append(("".join(has) + "".join(c for c in many if c not in has), "".join(has.values())))
    return "".join(one) + "".join(gone), "".join(one.values()), "".join(many), places


def _ranges(chars: str) -> str:
    """The characters as a class of a regular expression."""
    codes, out = sorted(map(ord, chars)), []
    start = last = codes[0]
    for c in [*codes[1:], None]:
        if c is None or c != last + 1:
            out.append(f"\\x{{{start:X}}}-\\x{{{last:X}}}")
            start = c
        last = c
    return "[" + "".join(out) + "]"


def without_marks(c: Column | str) -> Column:
    """As ``strip_accents``, and characters that decompose into several, such as ligatures, fractions and syllables, as those; for inputs, once a row.

    Texts without such characters, nearly all, take one pass.
    """
    before, after, many, places = _tables()
    syllable = rf"[\x{{{HANGUL:X}}}-\x{{{HANGUL + 19 * 21 * 28 - 1:X}}}]"

    def spread(ch: Column) -> Column:
        s = F.ascii(ch) - HANGUL
        jamo = lambda first, n, k: F.substr(F.lit("".join(chr(first + j) for j in range(n))), k.cast("int") + 1, F.lit(1))
        tail = F.when(s % 28 > 0, jamo(_TAIL, 28, s % 28)).otherwise("")
        hangul = F.concat(jamo(_LEAD, 19, F.floor(s / 588)), jamo(_VOWEL, 21, F.floor(s % 588 / 28)), tail)
        return F.when(ch.rlike(syllable), hangul).when(ch.rlike(_ranges(many)), F.concat(*(F.translate(ch, a, b) for a, b in places))).otherwise(ch)

    c = col(c)
    whole = F.when(c.rlike(f"{_ranges(many)}|{syllable}"), F.array_join(F.transform(F.split(c, ""), spread), "")).otherwise(c)
    return F.translate(whole, before, after)
