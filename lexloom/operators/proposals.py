"""Proposals of a model: strict parsing, reasons against them, and edits of those without any.

A model is a seam: a function from tasks to raw JSON (see ``plans.seams``). What it
says is data here, parsed with variants and checked in-row; nothing is trusted.
"""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import apply_edits, between
from ..functions.tables import FINDING_RULES, LINT_RULES

# Fields, vocabularies, words that carry no fact, and claims that no proposal may make.
REQUIRED = ("citation_text", "confidence", "end", "explanation", "facts_used", "issue_code", "missing_facts", "mode", "proposed_citation", "source_type", "start")
MODES = ("bluepages", "whitepages")
CONFIDENCE = ("low", "medium", "high")
SOURCE_TYPES = ("case", "statute", "regulation", "constitution", "journal_article", "book", "court_document", "internet", "short_form", "foreign_international_tribal", "ai_content", "archival", "unknown")
NO_FACT = ("and", "at", "in", "no", "nos", "of", "p", "pp", "re", "see", "the")
PROHIBITED = ("good law", "controlling authority", "binding authority", "precedential value", "precedential weight", "supports the proposition", "proves the proposition", "has positive treatment", "has no negative treatment")
CODES = tuple(r[0] for r in LINT_RULES) + tuple(r[0] for r in FINDING_RULES)
AUTOFIX = tuple(r[0] for r in LINT_RULES if r[6])

_NUMBERS = ("STRING", "BIGINT", "DOUBLE", "FLOAT")


def _reasons(*tests: tuple[Column, str | Column]) -> Column:
    """The names of the tests that hold, in order."""
    found = [F.when(F.coalesce(test, F.lit(False)), F.lit(name) if isinstance(name, str) else name) for test, name in tests]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def _values_ok(v: Column) -> Column:
    """Are all values of a variant object strings or numbers, and no key blank."""
    m = F.try_variant_get(v, "$", "map<string,variant>")
    kinds = F.transform(F.map_values(m), lambda x: F.schema_of_variant(x))
    fine = F.forall(kinds, lambda k: F.coalesce(k.isin(*_NUMBERS) | k.startswith("DECIMAL"), F.lit(False)))
    return fine & F.forall(F.map_keys(m), lambda k: F.trim(k) != "")


def parse_proposals(rows: DataFrame, raw_col: str = "raw") -> DataFrame:
    """``rows`` with ``proposal`` (a struct, null if it can't be used) and ``parse_errors``.

    A proposal is one JSON object with all fields of REQUIRED in their types; blank
    proposed citations are none; ``abstain`` must say whether there is none.
    """
    df = rows.withColumn("__v", F.try_parse_json(F.col(raw_col)))
    v = F.col("__v")
    get = lambda n, t="variant": F.try_variant_get(v, f"$.{n}", t)
    kind = lambda n: F.schema_of_variant(get(n))
    string = lambda n: F.when(kind(n) == "STRING", get(n, "string"))
    filled = lambda n: F.trim(F.coalesce(string(n), F.lit(""))) != ""
    whole = lambda n: F.when(kind(n) == "BIGINT", get(n, "bigint"))
    there = lambda n: kind(n).isNotNull() & (kind(n) != "VOID")
    strings = lambda n: F.coalesce(get(n, "array<string>"), F.array().cast("array<string>"))
    list_ok = lambda n: F.startswith(kind(n), F.lit("ARRAY")) & ((F.size(strings(n)) == 0) | ((kind(n) == "ARRAY<STRING>") & ~F.exists(strings(n), lambda x: x.isNull() | (F.trim(x) == ""))))
    low = lambda n: F.lower(F.trim(string(n)))
    is_object = F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))
    missing = F.filter(F.array(*[F.when(kind(n).isNull(), F.lit(n)) for n in REQUIRED]), lambda x: x.isNotNull())
    proposed = F.when(filled("proposed_citation"), string("proposed_citation"))
    none = proposed.isNull()
    abstain = F.when(kind("abstain") == "BOOLEAN", get("abstain", "boolean"))
    antecedent = there("antecedent_candidate")
    errors = _reasons(
        (v.isNull(), "invalid_json"),
        (v.isNotNull() & ~is_object, "not_an_object"),
        (is_object & (F.size(missing) > 0), F.concat(F.lit("missing_fields:"), F.array_join(missing, ","))),
    )
    typed = _reasons(
        (whole("start").isNull() | (whole("start") < 0), "invalid_start"),
        (whole("end").isNull() | (whole("end") <= F.coalesce(whole("start"), F.lit(0))), "invalid_end"),
        (~F.coalesce(low("mode").isin(*MODES), F.lit(False)), "invalid_mode"),
        (~F.coalesce(low("confidence").isin(*CONFIDENCE), F.lit(False)), "invalid_confidence"),
        (~F.coalesce(low("source_type").isin(*SOURCE_TYPES), F.lit(False)), "unsupported_source_type"),
        (there("proposed_citation") & (kind("proposed_citation") != "STRING"), "invalid_proposed_citation"),
        (~F.coalesce(list_ok("missing_facts"), F.lit(False)), "invalid_missing_facts"),
        (~F.coalesce(F.startswith(kind("facts_used"), F.lit("OBJECT")) & _values_ok(get("facts_used")), F.lit(False)), "invalid_facts_used"),
        (antecedent & ~F.coalesce(F.startswith(kind("antecedent_candidate"), F.lit("OBJECT")) & _values_ok(get("antecedent_candidate")), F.lit(False)), "invalid_antecedent_candidate"),
        (kind("abstain").isNotNull() & abstain.isNull(), "invalid_abstain"),
        (abstain.isNotNull() & (abstain != none), "abstain_mismatch"),
        (kind("retrieved_rule_chunk_ids").isNotNull() & ~F.coalesce(list_ok("retrieved_rule_chunk_ids"), F.lit(False)), "invalid_retrieved_rule_chunk_ids"),
        *[(~filled(n), f"invalid_{n}") for n in ("citation_text", "issue_code", "explanation")],
    )
    trimmed = lambda n: F.transform(strings(n), lambda x: F.trim(x))
    proposal = F.struct(
        string("citation_text").alias("citation_text"), whole("start").cast("int").alias("start"), whole("end").cast("int").alias("end"), low("source_type").alias("source_type"), low("mode").alias("mode"),
        F.upper(F.trim(string("issue_code"))).alias("issue_code"), F.trim(string("explanation")).alias("explanation"), low("confidence").alias("confidence"), proposed.alias("proposed_citation"),
        trimmed("missing_facts").alias("missing_facts"), get("facts_used", "map<string,string>").alias("facts_used"), F.when(antecedent, get("antecedent_candidate", "map<string,string>")).alias("antecedent_candidate"),
        none.alias("abstain"), trimmed("retrieved_rule_chunk_ids").alias("retrieved_rule_chunk_ids"),
    )
    df = df.withColumn("__e", errors).withColumn("parse_errors", F.when(F.size("__e") > 0, F.col("__e")).otherwise(typed))
    return df.withColumn("proposal", F.when(F.size("parse_errors") == 0, proposal)).drop("__v", "__e")


def material_tokens(text: Column) -> Column:
    """Distinct tokens of a-z and 0-9 (periods taken out) that carry a fact."""
    found = F.regexp_extract_all(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("."), F.lit("")), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(x) for x in NO_FACT]))


def validate_proposals(rows: DataFrame, threshold: str = "high", profiles: Collection[str] = MODES, codes: Collection[str] | None = CODES) -> DataFrame:
    """``rows`` with ``reasons`` against the proposal and ``valid`` (there is none).

    ``rows``: proposal (see ``parse_proposals``), text, expected_mode, and where they are known (else null)
    expected_source_type, expected_start, expected_end, issue_codes (what the rules found there: array<string>),
    chunk_ids (what was supplied: array<string>). A proposal that could not be parsed is not valid.
    """
    p, at = F.col("proposal"), {c: F.col(c) for c in rows.columns}
    known = lambda n: at.get(n, F.lit(None))
    rank = lambda c: F.array_position(F.array(*[F.lit(x) for x in CONFIDENCE]), c)
    said, proposed = F.lower(p["explanation"]), p["proposed_citation"]
    found = known("issue_codes").cast("array<string>")
    upper = F.filter(F.transform(found, lambda x: F.upper(F.trim(x))), lambda x: x != "")
    wrong_span = (p["end"] > F.length("text")) | (between(F.col("text"), p["start"], p["end"]) != p["citation_text"])
    off_task = (p["start"] != known("expected_start").cast("int")), (p["end"] != known("expected_end").cast("int"))
    reasons = _reasons(
        (p.isNull(), "invalid_model_output"),
        (p["mode"] != F.col("expected_mode"), "mode_mismatch"),
        (p["source_type"] != F.nullif(known("expected_source_type").cast("string"), F.lit("")), "source_type_mismatch"),
        (~p["mode"].isin(*profiles), "unsupported_rule_profile"),
        (F.lit(False) if codes is None else ~p["issue_code"].isin(*codes), "unknown_issue_code"),
        (wrong_span | F.col("text").isNull(), "source_span_mismatch"),
        (F.coalesce(off_task[0], F.lit(False)) | F.coalesce(off_task[1], F.lit(False)), "task_offset_mismatch"),
        (F.exists(F.array(*[F.lit(x) for x in PROHIBITED]), lambda x: F.contains(said, x)), "prohibited_legal_claim"),
        (proposed.isNotNull() & (F.size(F.array_except(material_tokens(proposed), material_tokens(p["citation_text"]))) > 0), "unsupported_material_facts"),
        (proposed.isNotNull() & (F.size(p["missing_facts"]) > 0), "missing_required_facts"),
        (rank(p["confidence"]) < rank(F.lit(threshold)), "below_auto_action_threshold"),
        ((F.size(upper) > 0) & ~F.array_contains(upper, p["issue_code"]), "deterministic_conflict"),
        (F.size(F.array_except(p["retrieved_rule_chunk_ids"], known("chunk_ids").cast("array<string>"))) > 0, "unattributed_rule_chunk"),
    )
    return rows.withColumn("reasons", reasons).withColumn("valid", F.size("reasons") == 0)


_EDIT = "array<struct<start:int,end:int,suggestion:string>>"


def apply_proposals(validated: DataFrame, docs: DataFrame, by: str = "doc_id") -> DataFrame:
    """doc_id, text, applied and skipped (start, end, suggestion, reasons) of each document.

    Valid proposals of high confidence go in from the right; one that overlaps an edit already made is skipped.
    """
    p = F.col("proposal")
    can = F.coalesce(F.col("valid") & (p["confidence"] == "high") & p["proposed_citation"].isNotNull(), F.lit(False))
    edit = F.struct(p["start"].alias("start"), p["end"].alias("end"), p["proposed_citation"].alias("suggestion"))
    told = F.struct(*[edit[n].alias(n) for n in ("start", "end", "suggestion")], F.col("reasons").alias("reasons"))
    per = validated.groupBy(by).agg(F.collect_list(F.when(can, edit)).alias("edits"), F.collect_list(F.when(~can, told)).alias("kept_out"))
    df = docs.select(by, F.coalesce("text", F.lit("")).alias("__t")).join(per, by, "left")
    edits = F.coalesce("edits", F.array().cast(_EDIT))
    df = df.withColumn("__done", apply_edits(F.col("__t"), edits)).withColumn("applied", F.col("__done.applied"))
    # Of two equal edits the second overlaps the first, so what was applied is taken out once each.
    clash = F.transform(F.array_except(edits, F.col("applied")), lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["suggestion"].alias("suggestion"), F.array(F.lit("overlapping_edit")).alias("reasons")))
    skipped = F.concat(F.coalesce("kept_out", F.array().cast("array<struct<start:int,end:int,suggestion:string,reasons:array<string>>>")), clash)
    return df.select(by, F.col("__done.text").alias("text"), "applied", F.array_sort(skipped, _by_place).alias("skipped"))


def _by_place(a: Column, b: Column) -> Column:
    start, end = F.coalesce(a["start"] - b["start"], F.lit(0)), F.coalesce(a["end"] - b["end"], F.lit(0))
    return F.when(start != 0, start).otherwise(end)


def hybrid_review(docs: DataFrame, tasks: DataFrame, generate: Callable[[DataFrame], DataFrame], apply: bool = False, chunk_ids: Column | None = None) -> DataFrame:
    """doc_id, status, fallback_reason, corrected_text, suggestions, rejected, applied for each document.

    ``tasks``: see ``context.citation_tasks``. ``generate`` adds ``raw`` (the model's answer, null if it failed).
    Only a proposal that repeats a safe edit of the rules is applied. status: no_citations; completed (all valid),
    partial (some), fallback (none; runtime_error if the model never answered, else invalid_model_output).
    """
    rows = generate(tasks.join(docs.select("doc_id", "text"), "doc_id"))
    rows = rows.withColumns({"expected_mode": F.col("mode"), "expected_source_type": F.col("source_type"), "expected_start": F.col("start"), "expected_end": F.col("end"), "issue_codes": F.transform("issues", lambda i: i["code"]), "chunk_ids": F.array().cast("array<string>") if chunk_ids is None else chunk_ids})
    checked = validate_proposals(parse_proposals(rows))
    p = F.col("proposal")

    def repeats(i):
        rest = F.substring(i["original"], F.length(p["citation_text"]) + 1, F.length(i["original"]))
        same = (i["suggestion"] == p["proposed_citation"]) | ((rest != "") & (i["suggestion"] == F.concat(p["proposed_citation"], rest)))
        return (i["code"] == p["issue_code"]) & same & (i["confidence"] == "high") & i["code"].isin(*AUTOFIX)

    checked = checked.withColumn("automatic", F.coalesce(F.col("valid") & F.exists("issues", repeats), F.lit(False)))
    reasons = F.when(F.col("raw").isNull(), F.array(F.lit("runtime_error"))).otherwise(F.col("reasons"))
    bad = F.struct("start", "end", "citation_text", reasons.alias("reasons"))
    good = F.struct(p["start"].alias("start"), p["end"].alias("end"), p["proposed_citation"].alias("suggestion"))
    per = checked.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.count_if("valid").alias("n_valid"), F.count_if(F.col("raw").isNull()).alias("n_failed"),
        F.collect_list(F.when(~F.col("valid"), bad)).alias("rejected"), F.collect_list(F.when(F.col("valid"), good)).alias("said"),
        F.collect_list(F.when(F.col("automatic") & p["proposed_citation"].isNotNull() & (p["confidence"] == "high"), good)).alias("edits"),
    )
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__t")).join(per, "doc_id", "left")
    edits = F.coalesce("edits", F.array().cast(_EDIT)) if apply else F.array().cast(_EDIT)
    df = df.withColumn("__done", apply_edits(F.col("__t"), edits))
    n, ok = F.coalesce("n", F.lit(0)), F.coalesce("n_valid", F.lit(0))
    status = F.when(n == 0, "no_citations").when((ok > 0) & (ok < n), "partial").when(ok > 0, "completed").otherwise("fallback")
    why = F.when(status == "fallback", F.when(F.col("n_failed") == n, "runtime_error").otherwise("invalid_model_output"))
    return df.select("doc_id", status.alias("status"), why.alias("fallback_reason"), F.col("__done.text").alias("corrected_text"), F.array_except(F.coalesce("said", F.array().cast(_EDIT)), F.col("__done.applied")).alias("suggestions"), "rejected", F.col("__done.applied").alias("applied"))
