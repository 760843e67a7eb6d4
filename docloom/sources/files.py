"""Scans and sinks: JSON stores, manifests, text pages, CSV exports, metrics text."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import let, some

MANIFEST = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("filename", "family", "country", "pack_id", "variant", "capture_condition", "side", "split", "source_dataset", "benchmark_profile")]
    + [T.StructField("condition_tags", T.ArrayType(T.StringType())), T.StructField("expected_fields", T.MapType(T.StringType(), T.StringType()))]
)


def json_store(spark: SparkSession, path: str, collection: str, schema: str) -> DataFrame:
    """One collection of a whole-file JSON store; a missing one has no rows."""
    rows = spark.read.schema(f"`{collection}` array<struct<{schema}>>").json(path, multiLine=True)
    return rows.select(F.explode(collection).alias("r")).select("r.*")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with a fixed schema; blank lines are skipped."""
    return spark.read.schema(MANIFEST).json(path)


def text_pages(docs: DataFrame) -> DataFrame:
    """Pages between form feeds, blank ones dropped; a text of one page has one."""
    pages = F.filter(F.split("text", "\f"), lambda p: F.trim(p) != "")
    return docs.select("doc_id", F.posexplode(F.when(F.size(pages) == 0, F.array("text")).otherwise(pages)).alias("page", "text"))


def files(spark: SparkSession, path: str, pattern: str = "*", suffixes: tuple[str, ...] = (), without: str | None = None, limit: int | None = None) -> DataFrame:
    """(path, length) under a folder, contents unread: of these suffixes, without names that begin with ``without``, sorted, the first ``limit``."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "length")
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    if suffixes:
        rows = rows.where(F.concat(F.lit("."), F.element_at(F.split(name, r"\."), -1)).isin(*(x.lower() for x in suffixes)))
    if without:
        rows = rows.where(~F.element_at(F.split("path", "/"), -1).startswith(without))
    rows = rows.orderBy("path")
    return rows.limit(limit) if limit else rows


AUDIT = "id string, action string, tenantId string, documentId string, payload string, createdAt string"


def audit_log(spark: SparkSession, path: str) -> DataFrame:
    """The records of a whole-file JSON audit log, payloads as JSON text."""
    rows = spark.read.schema(AUDIT).json(path, multiLine=True)
    return rows.select("id", "action", F.col("tenantId").alias("tenant_id"), F.col("documentId").alias("document_id"), "payload", F.to_timestamp("createdAt").alias("created_at"))


def manifest_path(spark: SparkSession, value: str, registry: DataFrame) -> str:
    """A path that is there as it stands; else the manifest of the first registered dataset of that name."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(value)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return value
    row = registry.where((F.col("name") == value) & (F.coalesce("manifest", F.lit("")) != "")).orderBy("place").first()
    if row is None:
        raise FileNotFoundError(f"no dataset manifest: {value}")
    return row["manifest"]


def rule_table(spark: SparkSession, text: str | None, schema: str, key: str = "rules", default: list | None = None) -> DataFrame:
    """The rules of a JSON configuration, in its order as ``priority``; the default's if there is no text or it is no JSON object with such a list."""
    names = [x.split()[0] for x in schema.split(", ")]
    try:
        found = json.loads(text or "")[key]
        rows = found if isinstance(found, list) else None
    except (ValueError, KeyError, TypeError):
        rows = None
    rows = (default or []) if rows is None else rows
    return spark.createDataFrame([(n, *(r.get(c) for c in names)) for n, r in enumerate(rows)], f"priority int, {schema}")


_PASSPORT = {"document_number": "document_number", "surnames": "surnames", "given_names": "given_names", "nationality": "nationality", "sex": "sex", "birth_date": "date_of_birth", "issue_date": "date_of_issue", "expiry_date": "date_of_expiry", "authority": "authority", "place_of_birth": "place_of_birth"}
_CARD = {"document_number": "document_id", "first_name": "first_name", "last_name": "last_name", "expiry_date": "expiry_date", "issued_date": "issued_date", "issuing_authority": "issuing_authority", "nationality": "nationality"}


def golden_fields(text: Column) -> Column:
    """Map of expected fields of a golden JSON text, whichever of its shapes it has: expected_fields as they are; a passport's, a licence's or a card's fields by name."""
    return let(text, _golden)


def _golden(text: Column) -> Column:
    at = lambda path: F.get_json_object(text, f"$.{path}")
    value = lambda name: at(f"fields.{name}.value")
    both = lambda a, b: some(F.concat_ws(" ", some(a), some(b)))
    made = lambda family, named: F.create_map(F.lit("document_family"), F.lit(family), *(x for k, c in named.items() for x in (F.lit(k), c)))
    given = F.from_json(at("expected_fields"), "map<string,string>")
    named = lambda g: F.try_element_at(g, F.lit("document_family"))
    family = lambda g: F.coalesce(named(g), some(at("family")), some(named(g)), F.lit("certificate"))
    listed = lambda g: F.map_concat(F.create_map(F.lit("document_family"), family(g)), F.map_filter(g, lambda k, v: k != "document_family"))
    passport = made("passport", {k: value(v) for k, v in _PASSPORT.items()} | {"holder_name": both(value("given_names"), value("surnames")), "mrz_line_1": at("fields.mrz.fields.line_1.value"), "mrz_line_2": at("fields.mrz.fields.line_2.value")})
    card = {k: value(v) for k, v in _CARD.items()} | {"holder_name": both(value("first_name"), value("last_name"))}
    street = at("fields.address.fields.street.value")
    licence = made("driver_license", card | {"category": value("category"), "address": street})
    identity = made("identity", card | {"birth_date": value("date_of_birth"), "sex": value("sex")})
    is_passport = at("fields.document_number").isNotNull() | at("fields.document_type").isNotNull()
    is_licence = F.coalesce(some(value("category")), some(street)).isNotNull()
    return let(given, lambda g: F.when(F.size(g) > 0, listed(g)).when(is_passport, passport).when(is_licence, licence).otherwise(identity))


def write_jsonl(rows: DataFrame, path: str) -> None:
    """A JSON object a line, nulls and all."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """Fields are quoted only where they must be; a list is joined by bars."""
    flat = [F.array_join(c, "|").alias(c) if t.startswith("array") else F.col(c) for c, t in rows.dtypes]
    rows.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_lines(lines: DataFrame, path: str, *order: str) -> None:
    """A text file of a column ``line`` in this order; one file, for exports of a document or a report."""
    lines.orderBy(*order).coalesce(1).select("line").write.mode("overwrite").text(path)


def append_snapshot(rows: DataFrame, path: str, action: str, at: str) -> None:
    """Each row as the JSON payload of an audit record."""
    rows.select(F.lit(action).alias("action"), F.to_json(F.struct("*")).alias("payload"), F.lit(at).cast("timestamp").alias("created_at")).write.mode("append").parquet(path)
