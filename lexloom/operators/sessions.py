"""Review sessions as tables: pages and cursors, job states, filters, counters, issues of any origin, and what a stored file is called.

A session's past is an append-only log; its state is the newest row by revision. No
table is ever changed in place, so a retried task or a second writer can't lose one.
"""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import between

TERMINAL = ("completed", "failed", "cancelled")
JOB_STATES = ("queued", "running", *TERMINAL)
REVIEW_LEVELS = ("review_required", "suggested_fix")
FILTERS = ("all", "accepted", "rejected", "pending", "safe", "review_required", "unsupported")


# Pages


def offset_page(rows: DataFrame, *order: Column, limit: int = 50, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of the order; the limit is held between 1 and 200, a negative offset is 0."""
    return rows.orderBy(*order).offset(max(0, int(offset))).limit(max(1, min(int(limit), 200)))


def cursor(*values: Column) -> Column:
    """Where a page ends, as text that is safe in a URL: base64 of a JSON list of strings."""
    listed = F.to_json(F.array(*[v.cast("string") for v in values]))
    return F.translate(F.regexp_replace(F.base64(F.encode(listed, "UTF-8")), "[\r\n]", ""), "+/", "-_")


def read_cursor(text: str, n: int = 2) -> list[str]:
    """The values of a cursor; ValueError if it is none."""
    try:
        found = json.loads(base64.urlsafe_b64decode(text.encode("ascii")).decode("utf-8"))
        if not isinstance(found, list) or len(found) != n or not all(isinstance(x, str) for x in found):
            raise ValueError
        return found
    except Exception:
        raise ValueError("invalid cursor") from None


def cursor_page(rows: DataFrame, order: str, key: str, limit: int = 50, after: str | None = None) -> DataFrame:
    """A page in descending (order, key) after a cursor, with ``next_cursor`` on its last row if more follow."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must be between 1 and 200")
    if after is not None:
        a, k = (F.lit(x) for x in read_cursor(after))
        a, k = a.cast(rows.schema[order].dataType), k.cast(rows.schema[key].dataType)
        rows = rows.where((F.col(order) < a) | ((F.col(order) == a) & (F.col(key) < k)))
    page = rows.orderBy(F.desc(order), F.desc(key)).limit(limit + 1)
    at = F.row_number().over(Window.orderBy(F.desc(order), F.desc(key)))  # of a page, not of the table
    page = page.withColumn("__n", at).withColumn("__more", F.lead(F.lit(True)).over(Window.orderBy(F.desc(order), F.desc(key))))
    out = page.where(F.col("__n") <= limit)
    return out.withColumn("next_cursor", F.when((F.col("__n") == limit) & F.col("__more"), cursor(F.col(order), F.col(key)))).drop("__n", "__more")


# Sessions and jobs


def latest(log: DataFrame, key: str, revision: str) -> DataFrame:
    """The newest row of each key."""
    fields = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*fields), revision).alias("__x")).select(key, "__x.*")


def current_sessions(log: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """The state of each session from its log (session_id, revision, updated_at, content, review_revision, ...), without deleted ones.

    ``review_current``: the review was made of this revision; an edit makes an older one invalid.
    """
    out = latest(log, "session_id", "revision")
    if deleted is not None:
        out = out.join(deleted.select("session_id").distinct(), "session_id", "left_anti")
    return out.withColumns({"content_sha256": F.sha2(F.coalesce("content", F.lit("")), 256), "review_current": F.coalesce(F.col("review_revision") == F.col("revision"), F.lit(False))})


def without_deleted(rows: DataFrame, deleted: DataFrame) -> DataFrame:
    """Rows of anything that hangs on a session, without those of deleted sessions."""
    return rows.join(deleted.select("session_id").distinct(), "session_id", "left_anti")


def job_states(events: DataFrame) -> DataFrame:
    """job_id, state, progress, started_at, completed_at, error, from a log (job_id, seq, at, state, progress, error).

    The last event tells the state and the error; the last progress that was told counts, held between 0 and 1;
    a job started at its first running event and ended at its last terminal one.
    """
    e = events.where(F.col("state").isin(*JOB_STATES))
    got = e.groupBy("job_id").agg(
        F.max_by("state", "seq").alias("state"), F.max_by(F.struct("error"), "seq")["error"].alias("error"),
        F.max_by("progress", F.when(F.col("progress").isNotNull(), F.col("seq"))).alias("progress"),
        F.min_by("at", F.when(F.col("state") == "running", F.col("seq"))).alias("started_at"), F.max_by("at", F.when(F.col("state").isin(*TERMINAL), F.col("seq"))).alias("completed_at"),
    )
    return got.select("job_id", "state", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("progress", F.lit(0.0)))).alias("progress"), "started_at", "completed_at", "error")


def decisions_allowed(decisions: DataFrame, sessions: DataFrame) -> DataFrame:
    """Decisions (session_id, revision, ...) with ``status``: ok, unknown_session, stale_revision or no_current_review."""
    s = sessions.select("session_id", F.col("revision").alias("__r"), "review_current")
    why = F.when(F.col("__r").isNull(), "unknown_session").when(F.col("revision") != F.col("__r"), "stale_revision").when(~F.col("review_current"), "no_current_review").otherwise("ok")
    return decisions.join(s, "session_id", "left").withColumn("status", why).drop("__r", "review_current")


# Items


def is_safe_edit() -> Column:
    return (F.col("kind") == "text_edit") & (F.col("correction_level") == "safe_auto_fix") & F.col("suggestion").isNotNull()


def filter_items(items: DataFrame, status: str = "all", severity: str | None = None, source_type: str | None = None, rule: str | None = None, search: str | None = None) -> DataFrame:
    """The review items that a view shows; texts are compared without regard to case, ``search`` looks into every text of an item."""
    if status not in FILTERS:
        raise ValueError(f"status must be one of {FILTERS}")
    level = F.col("correction_level")
    tests = {"all": F.lit(True), "safe": is_safe_edit(), "review_required": level.isin(*REVIEW_LEVELS), "unsupported": level == "unsupported"}
    out = items.where(tests[status] if status in tests else F.col("decision") == status)
    column = lambda n: F.col(n) if n in items.columns else F.lit(None).cast("string")
    for name, wanted in (("severity", severity), ("source_type", source_type), ("rule", rule)):
        if wanted is not None:
            out = out.where(F.lower(F.coalesce(column(name), F.lit(""))) == wanted.lower())
    if search and search.strip():
        texts = [F.nullif(column(n), F.lit("")) for n in ("code", "message", "original", "suggestion", "rule", "source_type", "provenance")]
        out = out.where(F.contains(F.lower(F.concat_ws("\n", *texts)), F.lit(search.strip().lower())))
    return out


def review_summary(items: DataFrame, *by: str) -> DataFrame:
    """Seven counters of review items, in all or by the given columns."""
    said = lambda d: F.count_if(F.col("decision") == d).alias(d)
    level = F.col("correction_level")
    return items.groupBy(*by).agg(F.count("*").alias("total"), said("accepted"), said("rejected"), said("pending"), F.count_if(is_safe_edit()).alias("safe_text_edits"), F.count_if(level.isin(*REVIEW_LEVELS)).alias("review_required"), F.count_if(level == "unsupported").alias("unsupported"))


_SOURCES = ("issues", "review_items", "findings", "deterministic_issues", "remaining_issues", "applied_edits")
_SAFE = ("safe_auto_fix", "safe", "high_confidence")


def normalize_issues(reviews: DataFrame) -> DataFrame:
    """Issues of reviews (session_id, text, review: JSON) of any make, in one form: session_id, id, start, end, original, replacement,
    issue_code, message, correction_level, safe_to_apply, provenance.

    Places are taken from start and end, from a span (object or list), or from where the original stands; issues
    without a place inside the text are left out. Of equal ids the first stays.
    """
    v = F.try_parse_json("review")
    lists = [F.coalesce(F.try_variant_get(v, f"$.{k}", "array<variant>"), F.array().cast("array<variant>")) for k in _SOURCES]
    rows = reviews.select("session_id", "text", F.posexplode_outer(F.concat(*lists)).alias("ix", "raw")).where("raw is not null")
    raw = F.col("raw")
    rows = rows.where(F.startswith(F.schema_of_variant(raw), F.lit("OBJECT")))
    kind = lambda path: F.schema_of_variant(F.try_variant_get(raw, path, "variant"))
    number = lambda path: F.try_variant_get(raw, path, "int")
    string = lambda path: F.when(kind(path) == "STRING", F.try_variant_get(raw, path, "string"))
    first = lambda *names: F.coalesce(*[string(f"$.{n}") for n in names])

    def place(name: str, at: int) -> Column:
        plain = F.when(kind(f"$.{name}").isNotNull(), number(f"$.{name}")).otherwise(number(f"$.{name}_offset"))
        inner = F.when(kind(f"$.span.{name}").isNotNull(), number(f"$.span.{name}")).when(kind(f"$.span.{name}_offset").isNotNull(), number(f"$.span.{name}_offset")).otherwise(plain)
        span = kind("$.span")
        listed = F.startswith(span, F.lit("ARRAY")) & kind("$.span[1]").isNotNull()
        return F.when(F.startswith(span, F.lit("OBJECT")), inner).when(listed, number(f"$.span[{at}]")).otherwise(plain)

    said = first("original", "citation", "source_text", "matched_text", "old_text")
    rows = rows.withColumns({"start": place("start", 0), "end": place("end", 1), "said": said})
    found = F.nullif(F.call_function("locate", F.col("said"), F.col("text")) - 1, F.lit(-1))
    rows = rows.withColumn("start", F.coalesce("start", F.when(F.col("said") != "", found))).withColumn("end", F.coalesce("end", F.col("start") + F.length("said")))
    rows = rows.where((F.col("start") >= 0) & (F.col("end") <= F.length("text")) & (F.col("end") >= F.col("start")))
    rows = rows.withColumn("original", F.coalesce("said", between(F.col("text"), F.col("start"), F.col("end"))))
    level = F.coalesce(first("correction_level", "level", "confidence"), F.lit("review"))
    rows = rows.withColumns({"replacement": first("replacement", "corrected", "corrected_text", "suggestion", "suggested_citation", "new_text"), "issue_code": first("issue_code", "code", "rule", "kind", "type"), "message": first("message", "explanation", "description", "reason"), "correction_level": level})
    flag = lambda n: F.coalesce(F.try_variant_get(raw, f"$.{n}", "boolean"), F.lit(False))
    safe = (flag("safe_to_apply") | flag("auto_fixable") | F.lower(F.col("correction_level")).isin(*_SAFE)) & F.col("replacement").isNotNull() & (between(F.col("text"), F.col("start"), F.col("end")) == F.col("original"))
    quoted = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.array(c)), r"(?s)\A\[(.*)\]\z", 1), F.lit("null"))
    json_or_null = lambda c: F.when(F.col(c).isNull(), F.lit("null")).otherwise(quoted(F.col(c)))
    identity = F.concat(F.lit("["), F.concat_ws(", ", F.col("start").cast("string"), F.col("end").cast("string"), *[json_or_null(c) for c in ("original", "replacement", "issue_code")], F.col("ix").cast("string")), F.lit("]"))
    given = F.try_variant_get(raw, "$.id", "string")
    rows = rows.withColumns({"safe_to_apply": safe, "id": F.coalesce(F.nullif(given, F.lit("")), F.substring(F.sha2(identity, 256), 1, 20)), "provenance": F.coalesce(string("$.provenance"), F.lit("deterministic_engine"))})
    w = Window.partitionBy("session_id", "id").orderBy("ix")
    rows = rows.withColumn("__n", F.row_number().over(w)).where("__n = 1")
    return rows.select("session_id", "id", "start", "end", "original", "replacement", "issue_code", "message", "correction_level", "safe_to_apply", "provenance")


def overlapping_issues(issues: DataFrame) -> DataFrame:
    """Issues (session_id, id, start, end) that begin before the one before them has ended: session_id, id, previous_id."""
    w = Window.partitionBy("session_id").orderBy("start", "end", "id")
    return issues.withColumns({"previous_id": F.lag("id").over(w), "__e": F.lag("end").over(w)}).where("start < __e").select("session_id", "id", "previous_id")


# Names and addresses


def safe_filename(name: Column) -> Column:
    """Letters, digits, dots, underscores and single hyphens, 100 at most."""
    kept = F.regexp_replace(F.trim(F.regexp_replace(name, "[^A-Za-z0-9._ -]+", "")), " ", "-")
    return F.substring(F.regexp_replace(kept, "-+", "-"), 1, 100)


def document_title(name: Column, fallback: str = "Untitled document") -> Column:
    """A title that can be a file's name: compatibility forms resolved, forbidden and control characters as spaces, no periods at the end, 160 characters at most."""
    from ..functions.udfs import nfkc

    plain = F.regexp_replace(F.regexp_replace(nfkc(F.coalesce(name, F.lit(""))), r'[<>:"/\\|?*\x00-\x1f]', " "), r"(?U)\s+", " ")
    short = F.trim(F.substring(F.regexp_replace(F.trim(plain), r"[. ]+$", ""), 1, 160))
    return F.when(short == "", F.lit(fallback)).otherwise(short)


def allowed_url(url: Column, hosts: tuple[str, ...]) -> Column:
    """The URL if it is https and its host is exactly one of ``hosts``; else null."""
    host = F.rtrim(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit("."))
    secure = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))) == "https"
    return F.when(F.coalesce(secure & host.isin(*hosts), F.lit(False)), url)


def absolute_url(url: Column, base: str) -> Column:
    u = F.coalesce(url, F.lit(""))
    return F.when(u == "", "").when(F.startswith(u, F.lit("http://")) | F.startswith(u, F.lit("https://")), u).otherwise(F.concat(F.lit(base.rstrip("/")), F.when(F.startswith(u, F.lit("/")), u).otherwise(F.concat(F.lit("/"), u))))


def export_summary(artifacts: DataFrame) -> DataFrame:
    """export_id, format, filename, media_type, size_bytes, sha256 of written files (export_id, format, filename, media_type, content)."""
    return artifacts.select("export_id", "format", safe_filename(F.col("filename")).alias("filename"), "media_type", F.length("content").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def workspace_payload(docs: DataFrame, issues: DataFrame, most_chars: int = 100_000, most_items: int = 500) -> DataFrame:
    """What a workspace shows of each document: text (cut at ``most_chars``), text_truncated, items (the first ``most_items`` by place), items_truncated, n_items.

    Only the items that are shown are gathered: places are ranked per document first. Items and their number come from one
    aggregation, so that ``issues`` are worked out once.
    """
    w = Window.partitionBy("doc_id").orderBy("start", "end", "code")
    ranked = issues.withColumn("__n", F.row_number().over(w))
    item = F.when(F.col("__n") <= most_items, F.struct("__n", F.struct("start", "end", "code", "suggestion").alias("item")))
    told = ranked.groupBy("doc_id").agg(F.collect_list(item).alias("x"), F.count("*").alias("n"))
    told = told.select("doc_id", F.when(F.size("x") > 0, F.transform(F.array_sort("x"), lambda x: x["item"])).alias("items"), "n")
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).join(told, "doc_id", "left")
    return df.select("doc_id", F.substring("t", 1, most_chars).alias("text"), (F.length("t") > most_chars).alias("text_truncated"), "items", (F.coalesce("n", F.lit(0)) > most_items).alias("items_truncated"), F.coalesce("n", F.lit(0)).alias("n_items"))
