"""Addresses read off a card's picture, put right as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

# Readings of the label, words that are set apart where they are glued together, and what may stand behind a house's number.
LABELS = ("DIRECCION", "DIRECOKON")
GLUED = {"CASAJ": "CASA J"}
SUFFIXES = ("CASA", "DEPTO", "DEPARTAMENTO", "OF", "J", "A", "B", "C")
#: A house's number has so many digits at most, and is below what may be a year.
DIGITS, YEARS = 5, 1900


def clean_address(c: Column | str, gazetteer: tuple[str, ...] = ()) -> Column:
    """Two words, a house's number and what follows it, of a text's first such run; null without one, and under eight characters.

    Capitals and digits stay, parted from each other. Names of ``gazetteer`` that have
    blanks get them back where they are written as one word, in its order.
    """
    text = F.regexp_replace(F.upper(col(c)), "[^A-Z0-9 ]+", " ")
    for label in LABELS:
        text = F.replace(text, F.lit(label), F.lit(" "))
    text = F.regexp_replace(F.regexp_replace(text, "([A-Z])([0-9])", "$1 $2"), "([0-9])([A-Z])", "$1 $2")
    text = F.btrim(F.regexp_replace(text, " +", " "))
    for name, apart in {**{n.replace(" ", ""): n for n in gazetteer if " " in n}, **GLUED}.items():
        text = F.replace(text, F.lit(name), F.lit(apart))

    def address(t: Column) -> Column:
        at = lambda i: F.get(t, i)
        house = lambda i: at(i).rlike(f"^[0-9]{{1,{DIGITS}}}$") & (at(i).cast("int") < YEARS) & at(i - 1).rlike("^[A-Z]+$") & at(i - 2).rlike("^[A-Z]+$")
        place = F.get(F.filter(F.sequence(F.lit(0), F.size(t)), lambda i: (i >= 2) & F.coalesce(house(i), F.lit(False))), F.lit(0))
        end = F.get(F.filter(F.sequence(F.lit(0), F.size(t)), lambda i: (i > place) & ~F.coalesce(at(i).isin(*SUFFIXES), F.lit(False))), F.lit(0))
        return F.when(place.isNotNull(), F.array_join(F.slice(t, place - 1, end - place + 2), " "))

    found = F.transform(F.array(F.split(text, " ")), address)[0]
    return F.when(F.length(found) >= 8, found)
