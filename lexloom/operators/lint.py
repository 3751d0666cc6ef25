"""Formatting issues of citations, and the edits that can be made by themselves."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.spans import MARK, apply_edits, below, cut_at, let, pieces, rows_of, spans_at, within
from ..functions.tables import LINT_RULES
from .extract import canonical_reporter, neutralize, with_citations

ISSUE = "struct<start:int,end:int,code:string,severity:string,rule:string,original:string,suggestion:string,confidence:string,correction_level:string,message:string>"
RULES = {r[0]: r for r in LINT_RULES}


def _issue(code: str, mode: str, start: Column, end: Column, original: Column, confidence: str, suggestion: Column | None = None, message: Column | None = None) -> Column:
    _, _, blue, white, severity, text, auto = RULES[code]
    safe = auto and suggestion is not None and confidence == "high"
    return F.struct(
        start.alias("start"), end.alias("end"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(blue if mode == "bluepages" else white).alias("rule"), original.alias("original"),
        (suggestion if suggestion is not None else F.lit(None).cast("string")).alias("suggestion"), F.lit(confidence).alias("confidence"), F.lit("safe_auto_fix" if safe else "review_required").alias("correction_level"),
        (message if message is not None else F.lit(text)).alias("message"),
    ).cast(ISSUE)


def check_mode(mode: str) -> str:
    mode = mode.strip().lower()
    if mode not in ("bluepages", "whitepages"):
        raise ValueError("mode must be bluepages or whitepages")
    return mode


def _form(c: Column) -> Column:
    return F.rtrim(F.lower(F.coalesce(c["components"]["form"], c["text"])), F.lit("."))


#: The parts of citations that issues depend on.
PARTS = ("form", "pincite")


def with_issues(docs: DataFrame, mode: str = "bluepages", text_col: str = "text", parts: Iterable[str] | None = None) -> DataFrame:
    """``docs`` with ``citations`` (with all ``parts``, or those named) and ``issues`` (array of ISSUE by start, end, code). In-row: no shuffle."""
    mode = check_mode(mode)
    df = docs if "citations" in docs.columns else with_citations(docs, text_col, parts=parts)
    df = df.withColumn("__t", neutralize(F.coalesce(F.col(text_col), F.lit("")))).withColumn("__odd", F.contains("__t", F.lit(MARK)))
    t, odd, cites = F.col("__t"), F.col("__odd"), F.col("citations")
    spelled_by = {"__reporter": P.REPORTER, "__statute": P.STATUTE, "__regulation": P.REGULATION}
    df = df.withColumns({n: cut_at(t, odd, p, p.parts) for n, p in spelled_by.items()})
    df = df.withColumns({n: spans_at(n, t, odd, p, p.parts) for n, p in spelled_by.items()})
    df = df.withColumn("__short", F.filter(cites, lambda c: c["source_type"] == "short_form"))
    df = df.withColumn("__ids", F.when(F.size("__short") > 0, F.filter("__short", lambda c: _form(c) == "id")))
    none = F.array().cast(f"array<{ISSUE}>")
    some = lambda array, issues: F.when(F.size(array) > 0, issues).otherwise(none)

    def spelled(found: str, code: str, build) -> Column:
        p = spelled_by[found]
        right = F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), build(lambda n: F.get(s["groups"], F.lit(p.parts.index(n)))).alias("to")))
        wrong = let(right, lambda x: F.filter(x, lambda s: s["text"] != s["to"]))
        return F.when(F.col(found).isNotNull(), F.transform(wrong, lambda s: _issue(code, mode, s["start"], s["end"], s["text"], "high", s["to"]))).otherwise(none)

    def reporter(x):
        return F.concat(x("volume"), F.lit(" "), canonical_reporter(x("reporter")), F.lit(" "), x("page"))

    def code_form(code):
        return lambda x: F.concat(x("title"), F.lit(f" {code} "), x("symbol"), F.lit(" "), x("section"))

    ends = F.transform(F.filter(cites, lambda c: ~c["source_type"].isin("short_form", "internet")), lambda c: c["end"])
    ids = F.col("__ids")
    token = lambda c: F.regexp_extract(c["text"], r"(?iU)^id\.?", 0)
    small = F.transform(F.filter(ids, lambda c: (token(c) != "") & (token(c) != "Id.")), lambda c: _issue("SHORT_FORM_CAPITALIZATION", mode, c["start"], c["start"] + F.length(token(c)), token(c), "high", F.lit("Id.")))
    far = F.array(F.lit(-(1 << 30)))
    orphans = let(F.sort_array(F.concat(far, ends)), lambda known: F.filter(ids, lambda c: F.element_at(known, below(known, c["start"])) < c["start"] - P.ID_WINDOW))
    surface = lambda c: F.coalesce(F.nullif(F.regexp_extract(c["text"], r"^[A-Za-z]+\.?", 0), F.lit("")), F.lit("Id."))
    orphan = F.transform(orphans, lambda c: _issue("SHORT_FORM_ORPHAN_ID", mode, c["start"], c["end"], c["text"], "high", None, F.concat(F.lit("“"), surface(c), F.lit("” must unambiguously refer to the immediately preceding authority."))))
    loose = F.transform(F.filter("__short", lambda c: _form(c).isin("supra", "short_case", "reference")), lambda c: _issue("SHORT_FORM_UNRESOLVED", mode, c["start"], c["end"], c["text"], "high"))
    pin = F.transform(F.filter(cites, lambda c: (c["source_type"] == "case") & c["components"]["pincite"].isNull()), lambda c: _issue("CASE_PINCITE_REVIEW", mode, c["start"], c["end"], c["text"], "low"))
    groups = [
        spelled("__reporter", "REPORTER_ABBREVIATION", reporter),
        spelled("__statute", "STATUTE_CODE_ABBREVIATION", code_form("U.S.C.")),
        spelled("__regulation", "REGULATION_CODE_ABBREVIATION", code_form("C.F.R.")),
        some("__ids", small), some("__ids", orphan), some("__short", loose), some("citations", pin),
    ]
    if mode == "whitepages":
        near = lambda cut, c: F.lower(within(cut, c["start"] - 120, c["end"] + 160))
        bare = let(pieces(t), lambda cut: F.filter(cites, lambda c: (c["source_type"] == "internet") & ~F.contains(near(cut, c), F.lit("perma.cc")) & ~F.contains(near(cut, c), F.lit("on file with author"))))
        groups.append(F.transform(bare, lambda c: _issue("INTERNET_ARCHIVE_REVIEW", mode, c["start"], c["end"], c["text"], "medium")))
    # Structs sort by their fields in order: start, end, code. Equal ones then stand side by side.
    once = lambda x: F.filter(x, lambda i, k: (k == 0) | (i != F.element_at(x, F.greatest(k, F.lit(1)))))
    df = df.withColumn("issues", F.concat(*groups))
    return df.withColumn("issues", F.when(F.size("issues") > 1, let(F.sort_array("issues"), once)).otherwise(F.col("issues"))).drop("__t", "__odd", "__short", "__ids", *spelled_by)


def issue_rows(docs: DataFrame, mode: str = "bluepages", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    return rows_of(with_issues(docs, mode, text_col, PARTS), "issues", F.col(id_col).alias("doc_id"))


def suggestion_rows(docs: DataFrame, mode: str = "bluepages", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``issue_rows`` that have a suggestion. Only that of an id depends on citations: other texts are not searched for these."""
    t = neutralize(F.coalesce(F.col(text_col), F.lit("")))
    df = docs.withColumn("__c", F.when(F.rlike(t, F.lit(P.ODD_ID)), F.col(text_col)))
    df = with_issues(with_citations(df, "__c", parts=PARTS).drop("__c"), mode, text_col)
    return rows_of(df, "issues", F.col(id_col).alias("doc_id")).where("suggestion is not null")


def fix(docs: DataFrame, mode: str = "bluepages", text_col: str = "text") -> DataFrame:
    """``docs`` with ``issues``, ``fixed_text`` and ``applied`` (start, end, suggestion): safe edits from right to left, none into another."""
    df = with_issues(docs, mode, text_col)
    safe = F.filter("issues", lambda i: (i["correction_level"] == "safe_auto_fix") & i["suggestion"].isNotNull())
    edits = F.transform(safe, lambda i: F.struct(i["start"].alias("start"), i["end"].alias("end"), i["suggestion"].alias("suggestion")))
    df = df.withColumn("__done", apply_edits(F.coalesce(F.col(text_col), F.lit("")), edits))
    return df.withColumns({"fixed_text": F.col("__done.text"), "applied": F.col("__done.applied")}).drop("__done")


def remaining(fixed: DataFrame, mode: str = "bluepages", id_col: str = "doc_id") -> DataFrame:
    """Issues that stay after ``fix``; an unchanged text keeps its issues and is not analysed again."""
    again = fixed.select(F.col(id_col), F.col("issues").alias("__old"), F.when(F.size("applied") > 0, F.col("fixed_text")).alias("text"))
    again = with_issues(again, mode).withColumn("__left", F.when(F.col("text").isNull(), F.col("__old")).otherwise(F.col("issues")))
    return rows_of(again, "__left", F.col(id_col).alias("doc_id"))


def summary(docs: DataFrame, mode: str = "bluepages", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Counts per document: citations by source type, issues by severity, and how many can be fixed."""
    df = with_issues(docs, mode, text_col, PARTS)
    kinds = ("case", "statute", "regulation", "constitution", "journal_article", "short_form", "internet")
    count = lambda array, cond: F.size(F.filter(array, cond))
    equal = lambda field, value: lambda x: x[field] == value
    return df.select(
        F.col(id_col).alias("doc_id"), F.size("citations").alias("citation_count"), F.size("issues").alias("issue_count"),
        count("issues", lambda i: i["suggestion"].isNotNull() & (i["confidence"] == "high")).alias("autofixable_count"),
        *[count("citations", equal("source_type", k)).alias(f"n_{k}") for k in kinds],
        *[count("issues", equal("severity", s)).alias(f"n_{s}") for s in ("error", "warning", "info")],
        *[count("issues", equal("correction_level", s)).alias(f"n_{s}") for s in ("safe_auto_fix", "suggested_fix", "review_required", "unsupported")],
    )
