"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, html, langid, linededup, packing, phrases, pieces, quality, sigtree, tokenfiles, toxicity, whitening
from .shared import checkpoint_dir, load, settle, ship_package

Query = Callable[[SparkSession, str], DataFrame]

#: Labels up to which the tasks get them whole; above, the join is dealt out by doc_id.
SENT_LABELS = 1_000_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality.assess(docs).select("doc_id", *quality.ADDED)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.remove_widespread(load(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sigtree.jaccard_components(load(spark, sf_dir, "documents"), n=3, percent=90)


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    pieces = settle(packing.cut_pieces(docs, tokenizer_path(), keep_ids=False))
    return packing.place(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html.extract(load(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    profiles = langid.learn(docs.where(~held_out()))
    found = langid.identify(docs, profiles)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{checkpoint_dir(spark)}/token-files-{uuid.uuid4().hex}"
    tokenfiles.write(load(spark, sf_dir, "documents"), path, tokenizer_path())
    rows = tokenfiles.digests(tokenfiles.read(spark, path)).join(tokenfiles.positions(spark, path), ["part", "row"])
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = load(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").union(extra)
    return chat.digests(*chat.prefix_tree(rows, tokenizer_path()), tokenizer_path())


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    labels = load(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    labels = F.broadcast(labels) if labels.count() <= SENT_LABELS else labels  # spares dealing out all texts
    model = toxicity.train(docs.where(~held_out()).select("doc_id", "text").join(labels, "doc_id"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.encode(load(spark, sf_dir, "documents"), piece_model_path(), decoded=True)
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return out.select("doc_id", "n_tokens", digest(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(load(spark, sf_dir, "documents"), max_n=5, min_count=100, top=2000)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(load(spark, sf_dir, "embeddings"), top=4)


_QUERIES: list[Query] = [op1_quality_rules, op2_line_dedup, op3_decontaminate, op4_jaccard_join, op5_pack, op6_html_text, op7_language, op8_token_files, op9_chat, op10_toxicity, op11_sentencepiece, op12_collocations, op13_whitening]


def queries() -> dict[str, Query]:
    def shipped(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return f(spark, sf_dir)

        return run

    return {f.__name__: shipped(f) for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2_SQL, "op4_jaccard_join": OP4_SQL, "op12_collocations": OP12_SQL}


#: Exact distinct counts for all lines, where the operator sketches.
OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, coalesce(source, '') AS source, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents
), keyed AS (
  SELECT doc_id, source, pos, line, trim(line, ' ' || chr(9) || chr(13)) AS k FROM lines
), wide AS (
  SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT source) >= 10
), hits AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS nth FROM keyed JOIN wide USING (k)
), gone AS (
  SELECT doc_id, pos FROM hits WHERE nth > 1
)
SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
       md5(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL), '')) AS text_md5
FROM keyed l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos
GROUP BY l.doc_id
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL
"""

#: All pairs that share a shingle, then components by fixed-point reachability.
OP4_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), shingles AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS s FROM words
), sizes AS (
  SELECT d.doc_id, count(s.s) AS n FROM documents d LEFT JOIN shingles s ON d.doc_id = s.doc_id GROUP BY d.doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
)
SELECT s.doc_id, s.n AS n_shingles, min(r.y) AS component_id FROM sizes s JOIN reach r ON r.x = s.doc_id GROUP BY s.doc_id, s.n
"""

#: Every run of words as a row, without the passes that leave rare ones out.
OP12_SQL = r"""
WITH pieces AS (
  SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)
), totals AS (
  SELECT lang, sum(len(w))::HUGEINT AS n FROM pieces GROUP BY lang
), grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM pieces, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k
), f AS (
  SELECT lang, k, phrase, count(*)::HUGEINT AS a FROM grams GROUP BY ALL HAVING count(*) >= 100
), inner_ AS (
  SELECT lang, a, unnest([array_to_string(string_split(phrase, ' ')[1:k - 1], ' '), array_to_string(string_split(phrase, ' ')[2:k], ' ')]) AS phrase FROM f WHERE k > 2
), kept AS (
  SELECT f.* FROM f WHERE k > 1 AND NOT EXISTS (SELECT 1 FROM inner_ i WHERE i.lang = f.lang AND i.phrase = f.phrase AND 100 * i.a >= 100 * f.a)
), cuts AS (
  SELECT lang, phrase, a, c, array_to_string(string_split(phrase, ' ')[1:c], ' ') AS x, array_to_string(string_split(phrase, ' ')[c + 1:k], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS c FROM kept)
), scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, c, p.a AS l, q.a AS r, n, 1000 * cuts.a * n // (p.a * q.a) AS score
  FROM cuts JOIN f p ON p.lang = cuts.lang AND p.phrase = x JOIN f q ON q.lang = cuts.lang AND q.phrase = y JOIN totals t ON t.lang = cuts.lang
), best AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) AS nth FROM scored
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM best WHERE nth = 1 QUALIFY rank <= 2000
"""
