"""What is let in: uploads, URLs, trials; and look-ups, feeds and registries over stored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import numbered

# What may be uploaded, and how much of it.
MIME_TYPES = ("application/pdf", "image/jpeg", "image/png", "image/heic", "image/heif", "image/tiff")
SUFFIXES = (".pdf", ".jpg", ".jpeg", ".png", ".heic", ".heif", ".tif", ".tiff")
MAX_FILE, MAX_BATCH, MAX_ITEMS = 15 << 20, 100 << 20, 20
# Hosts that no outside address may have.
LOCAL_NAMES, LOCAL_SUFFIXES = ("localhost", "host.docker.internal"), (".local", ".internal", ".localhost")
LOCAL_ADDRESSES = ("169.254.169.254", "100.100.100.200", "127.0.0.1", "0.0.0.0", "::1")


def upload_error(mime: Column, filename: Column, size: Column, batch_size: Column, items: Column) -> Column:
    """Why a file isn't accepted: its kind, its size, its batch's size or number of items, in this order; null if it is."""
    kind = F.coalesce(F.nullif(mime, F.lit("")), F.lit("application/octet-stream"))
    name = F.lower(F.coalesce(filename, F.lit("")))
    known = kind.isin(*MIME_TYPES)
    for suffix in SUFFIXES:
        known = known | name.endswith(suffix)
    return F.when(~known, "unsupported_type").when(size > MAX_FILE, "file_too_large").when(batch_size > MAX_BATCH, "batch_too_large").when(items > MAX_ITEMS, "too_many_items")


def is_private_host(host: Column) -> Column:
    """Names and addresses of the machine itself or of a private network; an empty host counts as one."""
    h = F.lower(F.trim(host))
    v4 = h.rlike(r"^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$")
    private = h.rlike(r"^(10\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.|169\.254\.)")
    v6 = h.contains(":") & (h.startswith("fc") | h.startswith("fd") | h.startswith("fe80:"))
    named = h.isin(*LOCAL_NAMES)
    for suffix in LOCAL_SUFFIXES:
        named = named | h.endswith(suffix)
    return F.coalesce((h == "") | named | h.isin(*LOCAL_ADDRESSES) | (v4 & private) | v6, F.lit(True))


def url_error(url: Column, allowed: tuple[str, ...] = (), insecure: bool = False, private: bool = False) -> Column:
    """Why an outside URL is refused: invalid, not on the list, not secure, or private; null if it is let through, or there is none."""
    parts = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:@\s]+)(?::\d+)?(?:[/?#].*)?$"
    scheme, host = F.lower(F.regexp_extract(url, parts, 1)), F.lower(F.regexp_replace(F.regexp_extract(url, parts, 2), r"[\[\]]", ""))
    listed = F.lit(not allowed)
    for a in (x.strip().lower() for x in allowed if x.strip()):
        listed = listed | (host == a) | host.endswith("." + a)
    secure = (scheme == "https") | ((scheme == "http") if insecure else F.lit(False))
    out = F.when(host == "", "invalid").when(~listed, "not_allowed").when(~secure, "not_secure").when(F.lit(not private) & is_private_host(host), "private")
    return F.when(F.coalesce(url, F.lit("")) != "", out)


def trial_error(mode: Column, expires_at: Column, limit: Column, used: Column, asked: Column, now: str) -> Column:
    """Why a client's trial doesn't cover the documents asked for: no trial, over, nothing asked, or beyond its limit (50 unless set, 1 at least)."""
    most = F.greatest(F.lit(1), F.coalesce(limit, F.lit(50)))
    over = F.coalesce(expires_at < F.lit(now).cast("timestamp"), F.lit(False))
    return F.when(~F.coalesce(mode == "trial", F.lit(False)), "not_a_trial").when(over, "expired").when(asked <= 0, "nothing_asked").when(F.coalesce(used, F.lit(0)) + asked > most, "limit_reached")


# stored rows


def feed(rows: DataFrame, limit: int | None = None, order: str = "created_at", tie: str = "id", **equal) -> DataFrame:
    """Rows with these values, newest first, the first ``limit``; a value of None asks for nothing."""
    for name, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(name) == value)
    out = rows.orderBy(F.desc(order), F.desc(tie))
    return out.limit(limit) if limit else out


def lookup(rows: DataFrame, key: str, value) -> DataFrame:
    """The one row of a key, or none."""
    return rows.where(F.col(key) == value).limit(1)


def audit_events(records: DataFrame, prefix: str | None = None, document_id=None, limit: int = 100) -> DataFrame:
    """Audit records whose action begins with ``prefix``, case and all, newest first."""
    rows = records.where(F.col("action").startswith(prefix)) if prefix else records
    return feed(rows, max(1, limit), document_id=document_id)


def append_audit(records: DataFrame, added: DataFrame, keep: int = 5000) -> DataFrame:
    """The log with new records, newest first, cut to ``keep``: the local log's size is its feature."""
    return feed(records.unionByName(added), keep)


def upsert(registry: DataFrame, entry: DataFrame, key: str = "name", place: str = "place") -> DataFrame:
    """The registry without rows of the entry's names, and the entry before them."""
    rest = registry.join(entry.select(key).distinct(), key, "left_anti")
    first = entry.withColumn(place, F.lit(-1).cast(dict(registry.dtypes)[place]))
    both = first.select(*registry.columns).unionByName(rest.select(*registry.columns)).withColumnRenamed(place, "__old")
    return numbered(both, [F.col("__old"), F.col(key)], place).withColumn(place, F.col(place).cast(dict(registry.dtypes)[place])).select(*registry.columns)


def replace_children(stored: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """A child table after its parents in ``changed`` were written again: all their old rows go, the new ones stand."""
    return stored.join(changed.select(key).distinct(), key, "left_anti").unionByName(changed)


# summaries


def batch_summary(results: DataFrame) -> DataFrame:
    """(what, value, n): files, processed and failed ones, those for review, mean confidence, and counts by decision, family and country of processed ones.

    A confidence that is no number counts as 0.
    """
    ok = F.col("status") == "ok"
    mean = F.coalesce(F.avg(F.when(ok, F.coalesce(F.expr("try_cast(confidence as double)"), F.lit(0.0)))), F.lit(0.0))
    counts = {"total_files": F.count("*"), "processed_ok": F.count_if(ok), "failed": F.count_if(~ok), "unsupported_or_review": F.count_if(ok & F.col("decision").isin("human_review", "reject"))}
    row = results.agg(*(c.cast("double").alias(k) for k, c in counts.items()), F.round(mean, 4).alias("average_confidence"))
    totals = row.select(F.explode(F.array(*(F.struct(F.lit(k).alias("what"), F.lit(None).cast("string").alias("value"), F.col(k).alias("n")) for k in (*counts, "average_confidence")))).alias("r")).select("r.*")
    sets = results.where(ok).groupingSets([["decision"], ["family"], ["country"]], "decision", "family", "country")
    what = F.when(F.grouping("decision") == 0, "by_decision").when(F.grouping("family") == 0, "by_family").otherwise("by_country")
    by = sets.agg(what.alias("what"), F.count("*").cast("double").alias("n")).select("what", F.coalesce("decision", "family", "country").alias("value"), "n")
    return totals.unionByName(by)


def page_quality(pages: DataFrame) -> DataFrame:
    """Per document means of its pages' measures, nulls skipped, three decimals; the first orientation, conditions as they first come, and what to recommend.

    Recommendations are named by what they are about: quality, blur, glare, crop, coverage, orientation; or none.
    """
    mean = lambda c: F.round(F.avg(c), 3).alias(c)
    names = ("quality", "blur", "glare", "crop", "coverage")
    listed = F.array_sort(F.collect_list(F.struct("page", F.coalesce("conditions", F.array().cast("array<string>")).alias("c"))))
    per = pages.groupBy("document_id").agg(*map(mean, names), F.min_by("orientation", F.when(F.col("orientation").isNotNull(), F.col("page"))).alias("orientation"), F.array_distinct(F.flatten(F.transform(listed, lambda x: x["c"]))).alias("conditions"))
    average = F.coalesce("quality", F.lit(0.0))
    said = F.array_compact(F.array(F.when(average < 0.55, "quality"), F.when(F.col("blur") >= 0.3, "blur"), F.when(F.col("glare") >= 0.24, "glare"), F.when(F.col("crop") < 0.92, "crop"), F.when(F.col("coverage") < 0.82, "coverage"), F.when(F.col("orientation") != 0, "orientation")))
    score = F.round(F.greatest(F.lit(0.05), F.least(average, F.lit(0.99))), 3)
    return per.select("document_id", score.alias("score"), *names[1:], "orientation", "conditions", F.when(F.size(said) > 0, said).otherwise(F.array(F.lit("none"))).alias("recommendations"))


def match_rate(reports: DataFrame) -> DataFrame:
    """One row: matches among all that was expected."""
    m, n = F.sum("matches"), F.sum(F.col("matches") + F.col("mismatches") + F.col("missing"))
    return reports.agg(m.alias("matches"), n.alias("expected"), F.coalesce(F.try_divide(m, n), F.lit(0.0)).alias("rate"))


def token_confidence(tokens: DataFrame, *by: str) -> DataFrame:
    """Mean confidence of tokens, of a run or a page; tokens without one don't count, and a run without any has none."""
    return tokens.groupBy(*by).agg(F.round(F.avg("confidence"), 6).alias("confidence"), F.count("*").alias("tokens"))


def table_lines(tables: DataFrame) -> DataFrame:
    """(document_id, text) of tables (document_id, ord, title, headers, rows): titles, headers and rows as CSV lines, an empty one between tables."""
    cell = lambda c: F.when(c.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    line = lambda cells: F.array_join(F.transform(cells, lambda c: cell(F.coalesce(c, F.lit("")))), ",")
    head = F.when(F.size("headers") > 0, F.array(line(F.col("headers")))).otherwise(F.array().cast("array<string>"))
    body = F.concat(F.array(cell(F.col("title"))), head, F.transform("rows", line))
    per = tables.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.array_join(body, "\r\n").alias("t")))).alias("t"))
    return per.select("document_id", F.trim(F.array_join(F.transform("t", lambda x: x["t"]), "\r\n\r\n")).alias("text"))
