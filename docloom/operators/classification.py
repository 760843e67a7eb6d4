"""Which pack a text is of: cascades of hints, then a score for each pack, the best of which wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import mrz
from ..functions.packs import PACKS, Pack, requested_country, requested_family
from ..functions.text import SPACE, let

# Words that hint at a family, a country, or a side; the first group that has one in the text decides.
FAMILY_WORDS = (
    ("identity", ("NACIO EN", "DOMICILIO", "COMUNA", "PROFESION", "INCHL", "I<CHL", "NACICAN")),
    ("passport", ("PASSPORT", "PASAPORTE")),
    ("driver_license", ("LICENCIA", "CONDUC", "DRIVER LICENSE", "DRIVING LICENCE", "BREVETE", "PERMISO DE CONDUCIR")),
    ("invoice", ("FACTURA", "INVOICE", "RUC", "COMPROBANTE DE PAGO")),
    ("identity", ("CEDULA DE IDENTIDAD", "DOCUMENTO NACIONAL DE IDENTIDAD", "CEDULA DE CIUDADANIA", "DNI", "CUI", "NUIP")),
    ("certificate", ("CERTIFICADO", "CONSTANCIA LABORAL", "CERTIFICACION LABORAL", "COTIZACIONES", "AFP")),
)
CHILEAN = ("INCHL", "I<CHL", "NACICAN", "REPUBLICA DE CHILE", "REGISTRO CIVIL E IDENTIFICACION")
COUNTRY_WORDS = (
    ("CL", ("REPUBLICA DE CHILE", "REGISTRO CIVIL E IDENTIFICACION", "RUN")),
    ("PE", ("REPUBLICA DEL PERU", "REPUBLICA DEL PERO", "DOCUMENTO NACIONAL DE IDENTIDAD", "RENIEC", "CUI", "MIGRACIONES")),
    ("CO", ("REPUBLICA DE COLOMBIA", "REGISTRADURIA", "CEDULA DE CIUDADANIA", "NUIP", "COLOMBIA")),
)
SIDE_WORDS = (
    ("CL", "back", ("NACIO EN", "DOMICILIO", "COMUNA", "PROFESION", "CIRCUNSCRIPCION", "HUELLA")),
    ("CL", "front", ("NOMBRES", "APELLIDOS", "RUN", "SEXO", "FECHA DE NACIMIENTO")),
    ("PE", "back", ("DOMICILIO", "ESTADO CIVIL", "GRADO DE INSTRUCCION", "DONACION DE ORGANOS", "RESTRICCION")),
    ("PE", "front", ("NOMBRES", "APELLIDOS", "DNI", "FECHA DE NACIMIENTO")),
    ("CO", "back", ("LUGAR DE NACIMIENTO", "ESTATURA", "G.S. RH", "EXPEDICION")),
    ("CO", "front", ("NOMBRES", "APELLIDOS", "CEDULA", "NUIP")),
)
ZONE_COUNTRIES = {"CHL": "CL", "PER": "PE", "COL": "CO"}
ENOUGH, MOST = 0.48, 0.97


def spaced(text: Column) -> Column:
    """In capitals, with single blanks."""
    return F.btrim(F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), SPACE + "+", " "), F.lit(" "))


def bare(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Z0-9]+", "")


#: All keywords, each looked for once a text.
KEYWORDS = {k: n for n, k in enumerate(dict.fromkeys(k for words in (*(w for _, w in FAMILY_WORDS), CHILEAN, *(w for _, w in COUNTRY_WORDS), *(w for *_, w in SIDE_WORDS), *(p.keywords for p in PACKS)) for k in words))}


def _tests(r: str) -> str:
    """An array that says of each of KEYWORDS whether it is in the text as it is spaced, or with both bare."""
    return "array(" + ", ".join(_test(r, k) for k in KEYWORDS) + ")"


def _test(r: str, k: str) -> str:
    quoted = lambda k: "'" + k.replace("'", "\\'") + "'"
    return f"(contains({r}spaced, {quoted(k)}) OR contains({r}bare, {quoted(''.join(c for c in k if c.isascii() and c.isalnum()))}))"


def _found(read: Column) -> Column:
    return F.element_at(F.call_function("transform", F.array(read), F.expr(f"r -> {_tests('r.')}")), 1)


def present(t: Column, keyword: str) -> Column:
    """Whether a text, of which t has what was found, has the keyword."""
    return t["has"][KEYWORDS[keyword]]


def _any(t: Column, keywords: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (present(t, k) for k in keywords))


def _first(cases: list[tuple[Column, str]], otherwise: str | None) -> Column:
    out = F.lit(otherwise)
    for when, value in reversed(cases):
        out = F.when(when, value).otherwise(out)
    return out


def family_hint(t: Column) -> Column:
    zone = t["spaced"].rlike("<{4,}")
    cases = [(t["zone"].isNotNull(), "identity")] + [(_any(t, words) | zone if name == "passport" else _any(t, words), name) for name, words in FAMILY_WORDS]
    return _first(cases, "unclassified")


def country_hint(t: Column) -> Column:
    code = F.regexp_extract(t["spaced"], "P<([A-Z]{3})", 1)
    cases = [(t["issuer"] == c, c) for c in ("CL", "PE", "CO")] + [(_any(t, CHILEAN), "CL")] + [(code == long_, short) for long_, short in ZONE_COUNTRIES.items()]
    return _first(cases + [(_any(t, words), name) for name, words in COUNTRY_WORDS], "XX")


def side_hint(t: Column, family: Column, country: Column) -> Column:
    return F.when(family == "identity", _first([((country == c) & _any(t, words), side) for c, side, words in SIDE_WORDS], None))


def keywords_of(t: Column, p: Pack) -> Column:
    return sum((F.when(present(t, k), 1).otherwise(0) for k in p.keywords), F.lit(0))


def pack_score(many: Column, h: Column, p: Pack) -> Column:
    """From 0.22: what was asked for, the hints, the keywords (how many there are) and the side, in this order."""
    asked, country, family, place, side = h["asked_family"], h["asked_country"], h["family"], h["country"], h["side"]
    s = F.lit(0.22) + F.when(asked == "unclassified", 0.0).when(asked == p.family, 0.2).otherwise(-0.18)
    s = s + F.when(country == "XX", 0.0).when(country == p.country, 0.16).otherwise(0.08 if p.country == "XX" else -0.12)
    s = s + F.when(family == "unclassified", 0.0).when(family == p.family, 0.22).otherwise(-0.18)
    s = s + F.when(place == "XX", 0.0).when(place == p.country, 0.16).otherwise(0.08 if p.country == "XX" else 0.0)
    s = s + F.least(F.lit(0.4), 0.08 * many)
    if p.family == "identity":
        s = s + F.when((family == "unclassified") & (place == p.country) & (many > 0), 0.08).otherwise(0.0)
    return s + F.when(side.isNull(), 0.0).when(side == p.side, 0.12).otherwise(-0.08) if p.side else s


def hints(t: Column, asked_family: Column, asked_country: Column) -> Column:
    told = F.struct(family_hint(t).alias("family"), country_hint(t).alias("country"), requested_family(asked_family).alias("asked_family"), requested_country(asked_country).alias("asked_country"))
    return let(told, lambda h: F.struct(h["family"].alias("family"), h["country"].alias("country"), h["asked_family"].alias("asked_family"), h["asked_country"].alias("asked_country"), side_hint(t, h["family"], h["country"]).alias("side")))


#: What is told of each pack.
TOLD = ("pack_id", "family", "country", "variant", "side", "supported")


def scores(many: list[Column], h: Column) -> Column:
    """An array of each pack's score and place, negative; the best is the largest."""
    return F.array(*(F.struct(pack_score(n, h, p).alias("score"), F.lit(-k).alias("k")) for k, (n, p) in enumerate(zip(many, PACKS, strict=True))))


def told_of(best: Column) -> Column:
    """The best of ``scores`` with what is told of its pack."""
    packs = F.array(*(F.struct(*(F.lit(getattr(p, n)).cast("boolean" if n == "supported" else "string").alias(n) for n in TOLD)) for p in PACKS))
    return F.struct(best["score"].alias("score"), *(F.element_at(packs, 1 - best["k"])[n].alias(n) for n in TOLD))


def verdict(t: Column, h: Column, b: Column) -> Column:
    found = b["score"] >= ENOUGH
    place = F.when(b["country"] != "XX", b["country"]).when(h["asked_country"] != "XX", h["asked_country"]).otherwise(h["country"])
    guess = F.when(h["family"] != "unclassified", h["family"]).otherwise(h["asked_family"])
    where = F.when(h["country"] != "XX", h["country"]).otherwise(h["asked_country"])
    of = lambda c: F.when(found, b[c])
    unsure = F.when(t["spaced"] != "", 0.34).otherwise(0.18)
    return F.struct(
        of("pack_id").alias("pack_id"), F.when(found, b["family"]).otherwise(guess).alias("family"), F.when(found, place).otherwise(where).alias("country"), of("variant").alias("variant"), of("side").alias("side"),
        F.when(found, F.least(b["score"], F.lit(MOST))).otherwise(unsure).alias("confidence"), (found & b["supported"]).alias("supported"), h["family"].alias("family_hint"), h["country"].alias("country_hint"), h["side"].alias("side_hint"),
    )


def classification(text: Column, asked_family: Column, asked_country: Column) -> Column:
    """A struct of the pack (null below 0.48), its family, country, variant and side, the confidence, and the hints.

    All packs are scored in the row: nothing is joined or shuffled.
    """
    zone = mrz.parse_td1_if_any(text)
    read = let(F.struct(spaced(text).alias("spaced"), zone.alias("z")), lambda r: F.struct(r["spaced"].alias("spaced"), bare(r["spaced"]).alias("bare"), r["z"]["mrz"].alias("zone"), F.upper(r["z"]["issuing_country"]).alias("issuer")))
    read = let(read, lambda r: r.withField("has", _found(r)))
    return let(read, lambda t: let(hints(t, asked_family, asked_country), lambda h: let(F.array_max(scores([keywords_of(t, p) for p in PACKS], h)), lambda s: let(told_of(s), lambda b: verdict(t, h, b)))))


def classify(texts: DataFrame, text: str = "text", family: str = "family", country: str = "country") -> DataFrame:
    """``texts`` with the columns of ``classification``, the requested family and country replaced by what was found."""
    rows = texts.select(F.struct(*texts.columns).alias("of"), F.col(text).alias("text"), F.col(family).alias("asked_family"), F.col(country).alias("asked_country"))
    # step by step in columns, which Spark compiles, while it interprets lambdas
    rows = rows.withColumn("spaced", spaced(F.col("text"))).withColumn("bare", bare(F.col("spaced")))
    many = ", ".join(" + ".join(f"int({_test('', k)})" for k in p.keywords) for p in PACKS)
    rows = rows.withColumns({"has": F.expr(_tests("")), "many": F.expr(f"array({many})"), "z": mrz.parse_td1_if_any(F.col("text"))})
    rows = rows.withColumn("t", F.struct("spaced", "has", F.col("z.mrz").alias("zone"), F.upper("z.issuing_country").alias("issuer")))
    t, h = F.col("t"), F.col("h")
    rows = rows.withColumns({"family": family_hint(t), "country": country_hint(t)})
    rows = rows.withColumn("h", F.struct("family", "country", requested_family(F.col("asked_family")).alias("asked_family"), requested_country(F.col("asked_country")).alias("asked_country"), side_hint(t, F.col("family"), F.col("country")).alias("side")))
    rows = rows.withColumn("best", F.array_max(scores([F.col("many")[k] for k in range(len(PACKS))], h)))
    rows = rows.withColumn("best", told_of(F.col("best"))).withColumn("c", verdict(t, h, F.col("best")))
    keep = [f"of.`{c}`" for c in texts.columns if c not in (family, country)]
    return rows.select(*keep, "c.*")
