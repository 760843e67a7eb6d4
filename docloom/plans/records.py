"""Text, identifier, consensus, sequence, rule and job queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as E
from ..functions import identifiers as D
from ..functions import scores as M
from ..functions import text as T
from ..functions.packs import PACKS
from ..operators import classification as C
from ..operators import jobs as J
from ..operators import matching as X
from ..operators import sequences as S
from .registry import CANDS, DOCS, IDS, JOBS, candidates, doc_records, fields, identifiers, jobs, load, query, spread

NOW = "1996-06-01 00:00:00"
_SLUG = r"trim(regexp_replace(lower(strip_accents(text)), '[^\p{L}\p{N}]+', '-', 'g'), '-')"
_COMPACT = r"regexp_replace(lower(strip_accents(text)), '[^\p{L}\p{N}]', '', 'g')"


def _md5(c):
    return F.md5(c.cast("binary"))


@query(f"SELECT doc_id, md5({_SLUG}) AS slug FROM documents")
def slugify(spark, d):
    return load(spark, d, "documents").select("doc_id", _md5(T.slugify("text")).alias("slug"))


@query(f"SELECT doc_id, md5({_COMPACT}) AS compact FROM documents")
def compact(spark, d):
    return load(spark, d, "documents").select("doc_id", _md5(T.compact("text")).alias("compact"))


@query(r"SELECT doc_id, md5(nullif(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' :-'), '')) AS clean FROM documents")
def clean_value(spark, d):
    return load(spark, d, "documents").select("doc_id", _md5(T.clean_value("text")).alias("clean"))


@query("SELECT c_custkey AS id, substr(c_name, 1, 2) || repeat('*', greatest(length(c_name) - 4, 4)) || right(c_name, 2) AS masked FROM customer")
def mask_identifier(spark, d):
    return load(spark, d, "customer").select(F.col("c_custkey").alias("id"), T.mask_ends("c_name").alias("masked"))


@query("SELECT p_partkey AS id, array_to_string(list_transform(list_filter(string_split(trim(p_name), ' '), lambda w: w <> ''), lambda w: substr(w, 1, 1) || '***'), ' ') AS redacted FROM part")
def redact_name(spark, d):
    return load(spark, d, "part").select(F.col("p_partkey").alias("id"), T.redact_name("p_name").alias("redacted"))


_HIDE = "CASE WHEN length(m) <= 4 THEN repeat('*', length(m)) ELSE substr(m, 1, 2) || repeat('*', greatest(4, length(m) - 4)) || right(m, 2) END"
_SECRET = (r"\b[^\s@]+@[^\s@]+\.[^\s@]+\b", r"\b\d{4}-\d{4}-\d{8,}\b", r"\b(?:\d{1,2}\.?\d{3}\.?\d{3}|\d{7,8})-[\dkK]\b", r"\b\d{8,10}\b")
#: Between two matches the text is as it was; a match past the last piece is none.
_MASKS = "".join(f", t{k + 1} AS (SELECT doc_id, array_to_string(list_transform(list_zip(string_split_regex(x, '{p}'), regexp_extract_all(x, '{p}')), lambda z: coalesce(z[1], '') || coalesce(list_transform([z[2]], lambda m: {_HIDE})[1], '')), '') AS x FROM t{k})" for k, p in enumerate(_SECRET))


@query(f"WITH t0 AS (SELECT doc_id, text || ' x@y.zz 1234-5678-12345678 12.345.678-k 1234567-1 12345678 123456789 12345678901 a@b ' || doc_id * 100003 AS x FROM documents){_MASKS} SELECT doc_id, md5(x) AS redacted, substr(x, 1, 160) AS preview FROM t4")
def redact_text(spark, d):
    said = F.concat(F.col("text"), F.lit(" x@y.zz 1234-5678-12345678 12.345.678-k 1234567-1 12345678 123456789 12345678901 a@b "), (F.col("doc_id") * 100003).cast("string"))
    rows = load(spark, d, "documents").select("doc_id", T.redact_inline(said).alias("masked"))
    return rows.select("doc_id", _md5(F.col("masked")).alias("redacted"), T.shortened("masked").alias("preview"))


_RUN = "(11 - (" + " + ".join(f"CAST(substr(body, {9 - k}, 1) AS INT) * {(k - 1) % 6 + 2}" for k in range(1, 9)) + ") % 11)"
_RUN_DIGIT = f"CASE {_RUN} WHEN 11 THEN '0' WHEN 10 THEN 'K' ELSE CAST({_RUN} AS VARCHAR) END"


_DOTTED = "substr(body, 1, 2) || '.' || substr(body, 3, 3) || '.' || substr(body, 6, 3)"
_RAW = "CASE v WHEN 2 THEN body || verifier WHEN 3 THEN 'A' || body WHEN 4 THEN 'AB' || substr(body, 1, 7) WHEN 5 THEN 'DNI: ' || body || ' x' WHEN 7 THEN 'serie a' || " + _DOTTED + " END"


@query(f"WITH {IDS} SELECT id, {_RUN_DIGIT} AS digit, CASE WHEN v = 6 THEN NULL WHEN v < 2 THEN {_DOTTED} || '-' || verifier ELSE {_RAW} END AS run, v < 2 AND {_RUN_DIGIT} = verifier AS valid FROM ids")
def run_checksum(spark, d):
    return identifiers(spark, d).select("id", D.run_digit("body").alias("digit"), D.canonical_run("raw").alias("run"), D.run_valid("raw").alias("valid"))


_MRZ = "(" + " + ".join(f"CAST(substr(body, {k + 1}, 1) AS INT) * {(7, 3, 1)[k % 3]}" for k in range(8)) + ") % 10"


@query(f"WITH {IDS} SELECT id, {_MRZ} AS digit FROM ids")
def mrz_check_digit(spark, d):
    return identifiers(spark, d).select("id", D.mrz_digit("body").alias("digit"))


_DIGITS = "CASE v WHEN 4 THEN substr(body, 1, 7) WHEN 0 THEN body || replace(verifier, 'K', '') WHEN 1 THEN body || replace(verifier, 'K', '') WHEN 2 THEN body || replace(verifier, 'K', '') ELSE body END"
_CLEAN = f"CASE v WHEN 0 THEN {_DOTTED} || '-' || verifier WHEN 1 THEN 'run ' || body || ' - ' || lower(verifier) ELSE {_RAW} END"


@query(f"""WITH {IDS}, x AS (SELECT *, {_DIGITS} AS digits, {_CLEAN} AS clean FROM ids)
SELECT id, CASE WHEN v = 6 THEN NULL WHEN c = 1 THEN CASE WHEN v IN (1, 3, 5) OR length(digits) = 8 THEN body ELSE clean END WHEN c = 2 THEN digits
 ELSE CASE v WHEN 7 THEN 'A' || {_DOTTED} WHEN 3 THEN 'A' || {_DOTTED} WHEN 4 THEN 'AB' || substr(body, 1, 2) || '.' || substr(body, 3, 3) || '.' || substr(body, 6, 2) ELSE clean END END AS number FROM x""")
def doc_number_canonical(spark, d):
    return identifiers(spark, d).select("id", D.canonical_document_number("country", "raw").alias("number"))


@query(f"WITH {IDS} SELECT id, CASE WHEN n = 7 THEN strftime(made, '%d.%m.%Y') WHEN n = 8 THEN 'sin fecha' ELSE iso END AS date, CASE WHEN n < 7 THEN iso END AS strict FROM ids")
def date_normalise(spark, d):
    return identifiers(spark, d).select("id", E.normalize_date("date_text").alias("date"), E.strict_date("date_text").alias("strict"))


@query(f"WITH {IDS} SELECT id, CASE WHEN id % 3 < 2 AND month(made) <> 9 THEN (year(made) + 20) || strftime(made, '-%m') END AS period FROM ids")
def period_normalise(spark, d):
    return identifiers(spark, d).select("id", E.normalize_period("period").alias("period"))


@query(f"WITH {IDS} SELECT id, CASE WHEN id % 5 = 2 THEN false WHEN id % 5 = 4 THEN false ELSE id % 3 > 0 END AS valid FROM ids")
def date_sequence(spark, d):
    birth = F.when(F.col("id") % 5 == 1, F.lit(None)).when(F.col("id") % 5 == 2, "1990-02-31").when(F.col("id") % 5 == 3, "sin dato").when(F.col("id") % 5 == 4, F.col("iso")).otherwise("1980-01-01")
    rows = identifiers(spark, d).withColumn("end", F.date_format(F.date_add("made", (F.col("id") % 3).cast("int")), "yyyy-MM-dd"))
    return rows.select("id", E.sequence_valid(birth, "iso", "end").alias("valid"))


_LETTERS = r"length(regexp_replace({0}, '[^\p{{L}}]', '', 'g'))"
_NUMBERS = r"length(regexp_replace({0}, '[^\p{{Nd}}]', '', 'g'))"
_IS_LABEL = f"(length({{0}}) BETWEEN 1 AND 48 AND {_NUMBERS} <= 4 AND {_LETTERS} >= 0.45 * length(replace({{0}}, ' ', '')))"
_IS_VALUE = r"(length({0}) > 2 AND (regexp_matches({0}, '\p{{Nd}}') OR contains({0}, ' ') OR regexp_matches({0}, '^\p{{Lu}}')))"
_LINES = r"""raw AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents),
l AS (SELECT doc_id, line_no, trim(regexp_replace(CASE WHEN line_no % 3 = 0 THEN upper(replace(substr(line, 1, 30), 'ß', 's')) WHEN line_no % 3 = 1 THEN 'Total a pagar ' || line_no || ': ' || line ELSE line END, '\s+', ' ', 'g')) AS line, CASE WHEN line_no < 4 THEN 1 ELSE 2 END AS page FROM raw),
m AS (SELECT *, regexp_extract(line, '(?i)^([A-Z0-9ÁÉÍÓÚÜÑ./()\- ]{2,48}?)\s*[:=]\s+(.+)$', ['a', 'b']) AS p, CASE WHEN lead(page) OVER w = page THEN lead(line) OVER w END AS nxt FROM l WHERE line <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
i AS (SELECT *, trim(p.a) AS a, trim(p.b) AS b FROM m)"""


def _made_lines(spark, d):
    """Lines in capitals, with a pair inside, or as they are, by turns; on two pages."""
    rows, n = S.line_table(load(spark, d, "documents")), F.col("line_no")
    line = F.when(n % 3 == 0, F.upper(F.replace(F.left("line", F.lit(30)), F.lit("ß"), F.lit("s")))).when(n % 3 == 1, F.concat(F.lit("Total a pagar "), n.cast("string"), F.lit(": "), F.col("line"))).otherwise(F.col("line"))
    return rows.select("doc_id", F.when(n < 4, 1).otherwise(2).alias("page"), "line_no", line.alias("line"))


@query(f"WITH {_LINES} SELECT doc_id, count(*) FILTER (a <> '' AND {_IS_LABEL.format('a')} AND {_IS_VALUE.format('b')}) AS pairs FROM i GROUP BY 1")
def kv_inline(spark, d):
    return _made_lines(spark, d).withColumn("line", T.squeezed("line")).where("line <> ''").groupBy("doc_id").agg(F.count_if(T.key_value("line")[0] != "").alias("pairs"))


@query(f"""WITH {_LINES}, k AS (SELECT *, a <> '' AND {_IS_LABEL.format('a')} AND {_IS_VALUE.format('b')} AS inl FROM i), r AS (SELECT *, NOT inl AND nxt IS NOT NULL AND {_IS_LABEL.format('line')} AND {_IS_VALUE.format('nxt')} AND len(string_split(line, ' ')) <= 5 AND upper(line) = line AS low FROM k),
q AS (SELECT doc_id, page, line_no, CASE WHEN inl THEN a ELSE line END AS label, CASE WHEN inl THEN b ELSE nxt END AS value FROM r WHERE inl OR low)
SELECT doc_id, CAST(page AS INT) AS page, CAST(min(line_no) AS INT) AS place, arg_max(label, line_no) AS label, md5(arg_max(value, line_no)) AS value FROM q GROUP BY doc_id, page, lower(label), lower(value)""")
def kv_lead(spark, d):
    return S.key_value_pairs(_made_lines(spark, d)).select("doc_id", "page", "place", "label", _md5(F.col("value")).alias("value"))


@query(r"""SELECT doc_id, CAST(i - 1 AS INT) AS row, CAST(j - 1 AS INT) AS col, md5(trim(c)) AS cell FROM (SELECT doc_id, i, generate_subscripts(cs, 1) AS j, unnest(cs) AS c FROM (
 SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, string_split(unnest(string_split(text, chr(10))), '|') AS cs FROM documents) x WHERE len(cs) > 1) y""")
def cells_posexplode(spark, d):
    rows = S.line_table(load(spark, d, "documents")).select("doc_id", F.col("line_no").alias("row"), F.split("line", r"\|").alias("cs")).where(F.size("cs") > 1)
    return rows.select("doc_id", "row", F.posexplode("cs").alias("col", "c")).select("doc_id", "row", "col", _md5(F.btrim("c", F.lit(" "))).alias("cell"))


@query("SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' :-' || chr(9) || chr(13) || chr(11) || chr(12)) <> '')) AS n_lines, len(list_distinct(string_split(text, chr(10)))) AS n_different FROM documents")
def line_list(spark, d):
    return load(spark, d, "documents").select("doc_id", F.size(T.lines("text")).cast("long").alias("n_lines"), F.size(F.array_distinct(F.split("text", "\n"))).cast("long").alias("n_different"))


# phrases that reach every hint; a text is one of each list
_SAID = ("", "cedula de identidad", "Republica de Chile  RUN", "Republica del Peru dni", "REGISTRADURIA nuip apellidos", "pasaporte", "x P<COLABC", "<<<<< abc", "licencia de conducir", "factura ruc", "certificado afp cuenta", "nacio en comuna", "Domi cilio x", "constancia laboral colombia")
_MORE = ("", "nombres apellidos", "estatura g.s. rh", "estado civil restriccion", "numero de certificado rut", "I<CHL huella", "clase chile")
_ASKED, _WHERE = ("auto", "Identity", "passport", "", "certificate"), ("XX", "cl", "PE", " auto ", "CO", "AR")


def _sql_has(k):
    word, small = k.replace("'", "''"), "".join(c for c in k if c.isalnum())
    return f"(contains(sp, '{word}') OR contains(ba, '{small}'))"


def _sql_any(words):
    return "(" + " OR ".join(map(_sql_has, words)) + ")"


def _sql_score(p):
    many = " + ".join(f"CASE WHEN {_sql_has(k)} THEN 1 ELSE 0 END" for k in p.keywords)
    s = f"0.22::DOUBLE + CASE WHEN af = 'unclassified' THEN 0 WHEN af = '{p.family}' THEN 0.2 ELSE -0.18 END + CASE WHEN ac = 'XX' THEN 0 WHEN ac = '{p.country}' THEN 0.16 ELSE {0.08 if p.country == 'XX' else -0.12} END + CASE WHEN fh = 'unclassified' THEN 0 WHEN fh = '{p.family}' THEN 0.22 ELSE -0.18 END"
    s += f" + CASE WHEN ch = 'XX' THEN 0 WHEN ch = '{p.country}' THEN 0.16 ELSE {0.08 if p.country == 'XX' else 0} END + least(0.4, 0.08 * ({many}))"
    s += f" + CASE WHEN fh = 'unclassified' AND ch = '{p.country}' AND {many} > 0 THEN 0.08 ELSE 0 END" if p.family == "identity" else ""
    return s + (f" + CASE WHEN sh IS NULL THEN 0 WHEN sh = '{p.side}' THEN 0.12 ELSE -0.08 END" if p.side else "")


_FAMILY = "CASE " + " ".join(f"WHEN {_sql_any(w)}{' OR contains(sp, chr(60) || chr(60) || chr(60) || chr(60))' if n == 'passport' else ''} THEN '{n}'" for n, w in C.FAMILY_WORDS) + " ELSE 'unclassified' END"
_COUNTRY = f"CASE WHEN {_sql_any(C.CHILEAN)} THEN 'CL' WHEN contains(sp, 'P<CHL') THEN 'CL' WHEN contains(sp, 'P<PER') THEN 'PE' WHEN contains(sp, 'P<COL') THEN 'CO' " + " ".join(f"WHEN {_sql_any(w)} THEN '{n}'" for n, w in C.COUNTRY_WORDS) + " ELSE 'XX' END"
_SIDE = "CASE WHEN fh = 'identity' THEN CASE " + " ".join(f"WHEN ch = '{c}' AND {_sql_any(w)} THEN '{side}'" for c, side, w in C.SIDE_WORDS) + " END END"
_list = lambda values: "[" + ", ".join("'" + v + "'" for v in values) + "]"
_TEXTS = f"""raw AS (SELECT o_orderkey AS id, {_list(_SAID)}[CAST(o_orderkey % {len(_SAID)} + 1 AS INT)] || '  ' || {_list(_MORE)}[CAST((o_orderkey // 3) % {len(_MORE)} + 1 AS INT)] AS text, {_list(_ASKED)}[CAST((o_orderkey // 7) % {len(_ASKED)} + 1 AS INT)] AS f, {_list(_WHERE)}[CAST((o_orderkey // 2) % {len(_WHERE)} + 1 AS INT)] AS c FROM orders),
t AS (SELECT id, trim(regexp_replace(upper(text), '[ ]+', ' ', 'g')) AS sp, regexp_replace(upper(text), '[^A-Z0-9]+', '', 'g') AS ba, CASE WHEN lower(trim(f)) IN ('', 'auto', 'unclassified') THEN 'unclassified' ELSE lower(trim(f)) END AS af, CASE WHEN upper(trim(c)) IN ('', 'AUTO', 'XX') THEN 'XX' ELSE upper(trim(c)) END AS ac FROM raw),
h AS (SELECT *, {_FAMILY} AS fh, {_COUNTRY} AS ch FROM t), g AS (SELECT *, {_SIDE} AS sh FROM h)"""


@query(f"""WITH {_TEXTS}, s AS (SELECT id, sp, af, ac, fh, ch, sh, unnest([{', '.join(f"{{'score': {_sql_score(p)}, 'k': {k}, 'pack': '{p.pack_id}', 'family': '{p.family}', 'country': '{p.country}', 'side': '{p.side or ''}', 'ok': {str(p.supported).lower()}}}" for k, p in enumerate(PACKS))}]) AS p FROM g),
b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p.score DESC, p.k) AS rn FROM s)
SELECT id, CASE WHEN p.score >= 0.48 THEN p.pack END AS pack_id, CASE WHEN p.score >= 0.48 THEN p.family WHEN fh <> 'unclassified' THEN fh ELSE af END AS family, CASE WHEN p.score >= 0.48 THEN CASE WHEN p.country <> 'XX' THEN p.country WHEN ac <> 'XX' THEN ac ELSE ch END WHEN ch <> 'XX' THEN ch ELSE ac END AS country,
 CASE WHEN p.score >= 0.48 THEN nullif(p.side, '') END AS side, round(CASE WHEN p.score >= 0.48 THEN least(p.score, 0.97) WHEN sp <> '' THEN 0.34 ELSE 0.18 END, 6)::DOUBLE AS confidence, p.score >= 0.48 AND p.ok AS supported, fh AS family_hint, ch AS country_hint, sh AS side_hint FROM b WHERE rn = 1""")
def keyword_classify(spark, d):
    k = F.col("o_orderkey")
    at = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    rows = spread(load(spark, d, "orders").select("o_orderkey")).select(k.alias("id"), F.concat(at(_SAID, k), F.lit("  "), at(_MORE, F.floor(k / 3))).alias("text"), at(_ASKED, F.floor(k / 7)).alias("family"), at(_WHERE, F.floor(k / 2)).alias("country"))
    return C.classify(rows).select("id", "pack_id", "family", "country", "side", F.round("confidence", 6).alias("confidence"), "supported", "family_hint", "country_hint", "side_hint")


@query("""WITH r AS (SELECT l_orderkey AS document_id, round(1 - l_discount, 2) AS score, l_returnflag <> 'R' AS success, CAST(l_quantity AS INT) AS tokens, l_linenumber AS length, 'e' || l_linenumber AS engine FROM lineitem),
b AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, success DESC, tokens DESC, length DESC, engine DESC) AS rn FROM r) SELECT document_id, engine, score FROM b WHERE rn = 1""")
def best_run(spark, d):
    i = load(spark, d, "lineitem")
    return X.best_run(i.select(F.col("l_orderkey").alias("document_id"), F.round(1 - F.col("l_discount"), 2).alias("score"), (F.col("l_returnflag") != "R").alias("success"), F.col("l_quantity").cast("int").alias("tokens"), F.col("l_linenumber").alias("length"), F.concat(F.lit("e"), F.col("l_linenumber").cast("string")).alias("engine")))


@query(f"WITH {CANDS} SELECT field_id, key, sources, score, confidence, value, source, engine, CAST(rank AS INT) AS rank FROM groups")
def candidate_groups(spark, d):
    return X.candidate_groups(candidates(spark, d)).select("field_id", "key", F.array_join("sources", ",").alias("sources"), "score", "confidence", "value", "source", "engine", "rank")


def _runs(spark, d):
    return fields(spark, d).select("field_id", (F.col("field_id") % 4).alias("n_runs"))


@query(f"WITH {CANDS} SELECT * FROM cons")
def consensus(spark, d):
    return X.consensus(candidates(spark, d), _runs(spark, d)).withColumn("supporting_engines", F.array_join("supporting_engines", ","))


@query(f"""WITH {CANDS}, p AS (SELECT field_id, max(key) FILTER (rank = 1) AS key, max(value) FILTER (rank = 1) AS value, max(source) FILTER (rank = 1) AS source, max(engine) FILTER (rank = 1) AS engine, max(sources) FILTER (rank = 1) AS sources, max(n_sources) FILTER (rank = 1) AS ns, max(score) FILTER (rank = 1) - coalesce(max(score) FILTER (rank = 2), 0) AS margin, max(confidence) FILTER (rank = 1) AS conf, count(*) > 1 AS rivals FROM groups WHERE rank <= 2 GROUP BY 1),
t AS (SELECT f.*, p.* EXCLUDE (field_id), coalesce(agreement_ratio, 0) AS ag, coalesce(disagreement, rivals) AS dis, coalesce(wanted = key, false) AS same FROM fields f LEFT JOIN p USING (field_id) LEFT JOIN (SELECT * FROM cons WHERE field_id % 2 = 0) USING (field_id)),
u AS (SELECT *, coalesce(((ns >= 2 OR ag >= 0.67 OR conf >= 0.94) AND margin >= CASE WHEN critical THEN 0.12 ELSE 0.08 END) OR (same AND NOT dis) OR (same AND critical AND ag >= 0.5 AND conf >= 0.9), false) AS taken FROM t)
SELECT field_id, NOT taken AS abstained, CASE WHEN taken THEN value END AS selected_value, CASE WHEN taken THEN source END AS selected_source, CASE WHEN taken THEN engine END AS selected_engine, round(CASE WHEN key IS NULL THEN NULL WHEN taken THEN least(0.7 * conf + 0.3 * ag, 1) ELSE least(greatest(conf, ag), 1) END, 3) AS confidence, coalesce(sources, '') AS evidence_sources FROM u""")
def adjudicate(spark, d):
    votes = X.consensus(candidates(spark, d), _runs(spark, d)).where("field_id % 2 = 0")
    return X.adjudicate(fields(spark, d), candidates(spark, d), votes).withColumn("evidence_sources", F.array_join("evidence_sources", ","))


@query("""WITH e AS (SELECT l_orderkey AS document_id, l_linenumber AS field, CASE WHEN l_quantity > 5 THEN 'v' || (l_partkey % 3) ELSE '' END AS expected FROM lineitem), a AS (SELECT l_orderkey AS document_id, l_linenumber AS field, CASE WHEN l_quantity < 45 THEN 'V ' || (l_suppkey % 3) END AS actual FROM lineitem WHERE l_returnflag <> 'A')
SELECT document_id, field, CASE WHEN expected = '' AND coalesce(actual, '') = '' THEN 'both_missing' WHEN expected = '' THEN 'extra' WHEN actual IS NULL THEN 'missing' WHEN expected = lower(replace(actual, ' ', '')) THEN 'match' ELSE 'mismatch' END AS status FROM e LEFT JOIN a USING (document_id, field)""")
def field_compare_status(spark, d):
    i = load(spark, d, "lineitem").withColumnsRenamed({"l_orderkey": "document_id", "l_linenumber": "field"})
    e = i.select("document_id", "field", F.when(F.col("l_quantity") > 5, F.concat(F.lit("v"), (F.col("l_partkey") % 3).cast("string"))).otherwise("").alias("expected"))
    a = i.where("l_returnflag <> 'A'").select("document_id", "field", F.when(F.col("l_quantity") < 45, F.concat(F.lit("V "), (F.col("l_suppkey") % 3).cast("string"))).alias("actual"))
    return X.compare_fields(e, a)


@query("""SELECT n_name AS name, CASE WHEN n_regionkey = 3 THEN 'ensemble' WHEN n_name = 'CHINA' OR n_regionkey = 2 THEN 'local' ELSE 'hybrid' END AS strategy FROM nation""")
def first_match_rule(spark, d):
    rules = spark.createDataFrame([(1, 3, None, "ensemble"), (2, None, "CHINA", "local"), (3, 2, None, "local"), (9, None, None, "hybrid")], "priority int, n_regionkey int, n_name string, strategy string")
    docs = load(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").cast("int"), "n_name", F.col("n_name").alias("name"))
    return X.first_match(docs, rules, ["n_regionkey", "n_name"], "name", "strategy")


@query("""SELECT n_name AS name, (CASE WHEN n_name = 'FRANCE' THEN 0.99 WHEN n_regionkey = 3 THEN 0.95 ELSE 0.9 END)::DOUBLE AS auto_conf, (CASE WHEN n_regionkey = 3 THEN 0.8 ELSE 0.76 END)::DOUBLE AS warn_conf FROM nation""")
def last_override_rule(spark, d):
    rules = spark.createDataFrame([(1, None, None, 0.9, 0.76), (2, 3, None, 0.95, 0.8), (3, None, "FRANCE", 0.99, None)], "priority int, n_regionkey int, n_name string, auto_conf double, warn_conf double")
    docs = load(spark, d, "nation").select(F.col("n_regionkey").cast("int"), "n_name", F.col("n_name").alias("name"))
    return X.last_override(docs, rules, ["n_regionkey", "n_name"], "name", ["auto_conf", "warn_conf"])


@query("""WITH r AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS rn, min(doc_id) OVER (PARTITION BY lang, source) AS f FROM documents) SELECT doc_id, lang, source FROM r ORDER BY rn, f, doc_id LIMIT 100""")
def stratified_sample(spark, d):
    return S.stratified_limit(load(spark, d, "documents"), ["lang", "source"], "doc_id", 100).select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))


@query("SELECT o_custkey AS client, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS job_id FROM orders GROUP BY 1")
def latest_job(spark, d):
    return S.latest(load(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select(F.col("o_custkey").alias("client"), F.col("o_orderkey").alias("job_id"))


@query(f"WITH {JOBS} SELECT job_id FROM jobs WHERE status = 'failed' AND attempts < max_attempts AND (next_retry_at IS NULL OR next_retry_at <= TIMESTAMP '{NOW}')")
def due_retries(spark, d):
    return J.due_retries(jobs(spark, d), NOW).select("job_id")


@query(f"WITH {JOBS} SELECT job_id, attempts + 1 AS attempts, CASE WHEN attempts + 1 >= 3 THEN 'dlq' ELSE 'retry' END AS queue, CASE WHEN attempts + 1 < 3 THEN strftime(updated_at + to_seconds(CAST(60 * pow(2, greatest(0, attempts)) AS BIGINT)), '%Y-%m-%d %H:%M:%S') END AS next_retry_at FROM jobs")
def dlq(spark, d):
    return J.fail(jobs(spark, d)).withColumn("next_retry_at", F.date_format("next_retry_at", "yyyy-MM-dd HH:mm:ss"))


@query(f"""WITH {JOBS}, u AS (SELECT *, 0 AS turn FROM jobs WHERE status = 'queued' AND (lease_expires_at IS NULL OR lease_expires_at <= TIMESTAMP '{NOW}') UNION ALL SELECT *, 1 FROM jobs WHERE status = 'failed' AND attempts < max_attempts AND (next_retry_at IS NULL OR next_retry_at <= TIMESTAMP '{NOW}'))
SELECT job_id, turn FROM u ORDER BY turn, created_at, job_id LIMIT 500""")
def bag_union_queue(spark, d):
    return J.work_queue(jobs(spark, d), NOW, 500).select("job_id", "turn")


@query(f"""WITH {JOBS}, f AS (SELECT * FROM jobs ORDER BY created_at DESC, job_id DESC LIMIT 1000) SELECT job_id FROM f WHERE next_retry_at IS NULL OR next_retry_at <= TIMESTAMP '1998-07-01' ORDER BY created_at, job_id LIMIT 200""")
def due_webhooks(spark, d):
    return J.due_webhooks(jobs(spark, d), "1998-07-01 00:00:00", 200).select("job_id")


@query(f"WITH {JOBS} SELECT arg_min(job_id, (created_at, job_id)) AS job_id, dedupe_key FROM jobs GROUP BY dedupe_key")
def dedupe_ledger(spark, d):
    return J.dedupe_first(jobs(spark, d), "dedupe_key", "created_at", "job_id").select("job_id", "dedupe_key")


@query("""SELECT c_custkey AS batch_id, count(o_orderkey) AS items, CASE WHEN count(o_orderkey) = 0 THEN 'completed' WHEN count(*) FILTER (o_orderstatus = 'P') = count(o_orderkey) THEN 'failed' WHEN count(*) FILTER (o_orderstatus IN ('F', 'P')) = count(o_orderkey) THEN CASE WHEN count(*) FILTER (o_orderstatus = 'P') > 0 THEN 'partial' ELSE 'completed' END ELSE 'processing' END AS status
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def batch_status(spark, d):
    c, o = load(spark, d, "customer"), load(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("running")
    return J.batch_status(c.join(o, c["c_custkey"] == o["o_custkey"], "left").select(F.col("c_custkey").alias("batch_id"), F.col("o_orderkey").alias("submission_id"), status.alias("status")))


@query("SELECT c_custkey AS client, coalesce(n, 0) AS used, CAST(greatest(10 - coalesce(n, 0), 0) AS BIGINT) AS remaining, coalesce(n, 0) < 10 AS allowed FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def trial_quota(spark, d):
    return J.trial_quota(load(spark, d, "orders").select(F.col("o_custkey").alias("client")), load(spark, d, "customer").select(F.col("c_custkey").alias("client")), 10)


@query("""WITH f AS (SELECT l_orderkey AS k, l_partkey % 20 AS p, l_linenumber AS n, l_returnflag = 'N' AS front FROM lineitem)
SELECT a.k AS document_id, arg_min(a.p, (a.n, a.p)) AS shared FROM f a WHERE a.front AND EXISTS (SELECT 1 FROM f b WHERE b.k = a.k AND NOT b.front AND b.p = a.p) GROUP BY 1""")
def identifier_intersect(spark, d):
    i = load(spark, d, "lineitem")
    side = lambda c: F.array_sort(F.collect_list(F.when(c, F.struct("l_linenumber", (F.col("l_partkey") % 20).alias("p")))))
    both = i.groupBy(F.col("l_orderkey").alias("document_id")).agg(side(F.col("l_returnflag") == "N").alias("f"), side(F.col("l_returnflag") != "N").alias("b"))
    return both.select("document_id", X.shared_identifier(F.col("f.p"), F.col("b.p")).alias("shared")).where("shared is not null")


@query(f"""WITH {DOCS}, s AS (SELECT document_id, round(greatest(0.05, least(0.99, 0.74 + CASE WHEN reviewed THEN 0.12 ELSE -0.22 END + CASE WHEN abstained = 1 THEN 0.08 ELSE -0.20 END + CASE WHEN coalesce(confidence, 0) < 0.55 THEN -0.14 WHEN coalesce(confidence, 0) >= 0.82 THEN 0.04 ELSE 0 END + CASE WHEN agreement < 0.65 THEN -0.12 WHEN agreement >= 0.90 THEN 0.05 ELSE 0 END)), 6)::DOUBLE AS score FROM docs)
SELECT document_id, score, CASE WHEN score >= 0.82 THEN 'low' WHEN score >= 0.62 THEN 'medium' ELSE 'high' END AS risk FROM s""")
def integrity_score(spark, d):
    r = doc_records(spark, d)
    s = F.round(M.integrity(F.col("reviewed"), F.lit(None).cast("boolean"), F.col("abstained") == 1, F.coalesce("confidence", F.lit(0.0)), F.col("agreement")), 6)
    return r.select("document_id", s.alias("score")).withColumn("risk", M.risk_band("score"))


@query("SELECT id, CASE WHEN id % 3 = 0 THEN made ELSE substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-a' || substr(h, 18, 3) || '-' || substr(h, 21, 12) END AS uuid FROM (SELECT o_orderkey AS id, sha1(o_orderkey::VARCHAR) AS h, 'ABCDEF01-2345-4678-9abc-' || lpad(o_orderkey::VARCHAR, 12, '0') AS made FROM orders)")
def stable_ids(spark, d):
    k = F.col("o_orderkey").cast("string")
    seed = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("ABCDEF01-2345-4678-9abc-"), F.lpad(k, 12, "0"))).otherwise(k)
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), T.stable_uuid(seed).alias("uuid"))


@query("""SELECT conv_id, arg_max(text_hash, turn) AS last_text, count(*) AS edits FROM (SELECT conv_id, turn, md5(text) AS text_hash FROM conversations WHERE role = 'user') GROUP BY 1""")
def last_edit(spark, d):
    return load(spark, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.max_by(_md5(F.col("text")), "turn").alias("last_text"), F.count("*").alias("edits"))


_TOKEN = "l_orderkey AS doc_id, CAST(((l_linenumber * 1000000 + l_partkey) * 100000 + l_suppkey) * 100 + l_quantity AS BIGINT) AS token_id"


def _token_id():
    return (((F.col("l_linenumber").cast("long") * 1000000 + F.col("l_partkey")) * 100000 + F.col("l_suppkey")) * 100 + F.col("l_quantity").cast("long")).alias("token_id")


@query(f"""WITH RECURSIVE t AS (SELECT {_TOKEN}, l_linenumber % 2 AS page, l_quantity AS x, l_extendedprice / 1000 AS y, l_quantity / 5 AS h FROM lineitem), m AS (SELECT doc_id, greatest(10.0, 0.75 * list_sort(list(h))[len(list(h)) // 2 + 1]) AS tol FROM t GROUP BY 1),
n AS (SELECT t.*, tol, row_number() OVER (PARTITION BY doc_id ORDER BY page, y, x, token_id) AS i FROM t JOIN m USING (doc_id)),
f AS (SELECT doc_id, i, token_id, page, y AS anchor, 0 AS line FROM n WHERE i = 1 UNION ALL SELECT n.doc_id, n.i, n.token_id, n.page, CASE WHEN n.page <> f.page OR abs(n.y - f.anchor) > n.tol THEN n.y ELSE f.anchor END, CASE WHEN n.page <> f.page OR abs(n.y - f.anchor) > n.tol THEN f.line + 1 ELSE f.line END FROM f JOIN n ON n.doc_id = f.doc_id AND n.i = f.i + 1)
SELECT doc_id, token_id, CAST(line AS BIGINT) AS line FROM f""")
def line_cluster_fold(spark, d):
    i = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), _token_id(), (F.col("l_linenumber") % 2).alias("page"), F.col("l_quantity").cast("double").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_quantity") / 5).alias("height"))
    return S.cluster_lines(i).select("doc_id", "token_id", F.col("line").cast("long").alias("line"))


@query("""WITH RECURSIVE p AS (SELECT l_orderkey AS doc_id, CAST(((l_linenumber * 1000000 + l_partkey) * 100000 + l_suppkey) * 100 + l_quantity AS BIGINT) AS page, CASE WHEN l_partkey % 3 = 0 THEN 'passport' ELSE 'identity' END AS family, CASE l_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'p' || (l_suppkey % 4) END AS pack, CASE l_linenumber % 3 WHEN 0 THEN 'back' WHEN 1 THEN 'front' END AS side, CASE WHEN l_partkey % 5 > 0 THEN l_returnflag END AS variant FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS i FROM p),
f AS (SELECT doc_id, i, page, family AS hf, pack AS hp, side AS hs, variant AS hv, 0 AS segment, side FROM n WHERE i = 1 UNION ALL SELECT n.doc_id, n.i, n.page, CASE WHEN j THEN hf ELSE n.family END, CASE WHEN j THEN hp ELSE n.pack END, CASE WHEN j THEN hs ELSE n.side END, CASE WHEN j THEN hv ELSE n.variant END, CASE WHEN j THEN segment ELSE segment + 1 END, n.side FROM (SELECT n.*, f.hf, f.hp, f.hs, f.hv, f.segment, n.family = f.hf AND (coalesce(n.variant, '') = coalesce(f.hv, '') OR n.family = 'identity' AND coalesce(n.pack <> '' AND n.pack = f.hp OR list_sort([n.side, f.hs]) = ['back', 'front'], false)) AS j FROM f JOIN n ON n.doc_id = f.doc_id AND n.i = f.i + 1) n)
SELECT doc_id, CAST(segment AS BIGINT) AS segment, min(page) AS first_page, max(page) AS last_page, count(*) AS n_pages, CASE WHEN count(DISTINCT side) = 2 THEN 'front+back' ELSE max(side) END AS side, max(segment) > 0 AS several FROM f GROUP BY 1, 2""".replace(", max(segment) > 0 AS several FROM f", " FROM f"))
def page_segments(spark, d):
    c = F.col
    pack = F.when(c("l_suppkey") % 4 == 1, "").when(c("l_suppkey") % 4 > 1, F.concat(F.lit("p"), (c("l_suppkey") % 4).cast("string")))
    rows = load(spark, d, "lineitem").select(
        c("l_orderkey").alias("doc_id"), _token_id().alias("page"), F.when(c("l_partkey") % 3 == 0, "passport").otherwise("identity").alias("family"), F.lit("CL").alias("country"), pack.alias("base_pack"),
        F.when(c("l_linenumber") % 3 == 0, "back").when(c("l_linenumber") % 3 == 1, "front").alias("side"), F.when(c("l_partkey") % 5 > 0, c("l_returnflag")).alias("variant"),
    )
    return S.segments(rows).drop("mixed")


@query(f"""WITH RECURSIVE r AS (SELECT {_TOKEN}, l_linenumber % 2 = 0 AS expected, l_partkey % 5 AS part, CASE WHEN l_quantity > 25 THEN l_returnflag ELSE '' END AS flag FROM lineitem),
t AS (SELECT doc_id, coalesce(list({{'p': part, 'f': flag}} ORDER BY token_id) FILTER (expected), []) AS es, coalesce(list({{'p': part, 'f': flag}} ORDER BY token_id) FILTER (NOT expected), []) AS xs FROM r GROUP BY 1),
g AS (SELECT doc_id, es, xs, 1 AS i, []::BIGINT[] AS taken FROM t UNION ALL SELECT doc_id, es, xs, i + 1, taken || list_filter(range(1, len(xs) + 1), lambda k: NOT list_contains(taken, k) AND xs[k].p = es[i].p AND (es[i].f = '' OR xs[k].f = es[i].f))[1:1] FROM g WHERE i <= len(es))
SELECT doc_id, CAST(len(taken) AS BIGINT) AS matched, CAST(len(es) - len(taken) AS BIGINT) AS missing, CAST(len(xs) - len(taken) AS BIGINT) AS extra FROM g WHERE i = len(es) + 1""")
def greedy_row_match(spark, d):
    i = load(spark, d, "lineitem")
    cells = F.create_map(F.lit("part"), (F.col("l_partkey") % 5).cast("string"), F.lit("flag"), F.when(F.col("l_quantity") > 25, F.col("l_returnflag")).otherwise(""))
    return S.greedy_rows(i.select(F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_linenumber") % 2 == 0, "expected").otherwise("actual").alias("side"), _token_id().alias("ord"), cells.alias("cells")))
