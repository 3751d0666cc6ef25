"""More of the catalogue: proposals, guidance, evaluation, sessions and names, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import guidance, tables
from ..operators import context, evaluate, evidence, extract, findings, formats, graph, lint, proposals, reduce, resolve, retrieval, review, scoring, sessions
from ..operators import mode as modes
from ..sources import blocks, exports, files, sinks
from ..sources.briefs import briefs, orders
from . import seams
from .queries import _ALIAS_TEXT, _AT, _ISSUES, _NORMAL, _OCC, _PLAIN, _TYPE, _with, query


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


# Proposals

_RAW_OK = {"citation_text": "42 USC §1983", "start": 4, "end": 16, "source_type": "statute", "mode": "bluepages", "issue_code": "statute_code_abbreviation", "explanation": "Spacing and periods.", "confidence": "High", "proposed_citation": "42 U.S.C. § 1983", "missing_facts": [], "facts_used": {"title": 42}}


def _raws() -> list[tuple[str, str, str]]:
    """(raw, parse errors, reasons against it)."""
    import json

    def make(**kw):
        return json.dumps({**_RAW_OK, **kw})

    less = {k: v for k, v in _RAW_OK.items() if k not in ("mode", "end")}
    bad = "invalid_model_output"
    return [
        (make(), "", ""),
        ("{not json", "invalid_json", bad),
        ("[1, 2]", "not_an_object", bad),
        (json.dumps(less), "missing_fields:end,mode", bad),
        (make(start="4"), "invalid_start", bad),
        (make(start=True, confidence="sure"), "invalid_start,invalid_confidence", bad),
        (make(end=4), "invalid_end", bad),
        (make(proposed_citation=7), "invalid_proposed_citation", bad),
        (make(missing_facts=["year", " "]), "invalid_missing_facts", bad),
        (make(facts_used={"title": True}), "invalid_facts_used", bad),
        (make(abstain=True), "abstain_mismatch", bad),
        (make(proposed_citation=" ", missing_facts=["year"], abstain=True), "", ""),
        (make(mode="whitepages"), "", "mode_mismatch"),
        (make(source_type="case"), "", "source_type_mismatch"),
        (make(issue_code="NO_SUCH_CODE"), "", "unknown_issue_code,deterministic_conflict"),
        (make(start=5, end=17), "", "source_span_mismatch,task_offset_mismatch"),
        (make(explanation="This is good law."), "", "prohibited_legal_claim"),
        (make(proposed_citation="42 U.S.C. § 1984"), "", "unsupported_material_facts"),
        (make(missing_facts=["year"]), "", "missing_required_facts"),
        (make(confidence="low"), "", "below_auto_action_threshold"),
        (make(issue_code="CASE_PINCITE_REVIEW"), "", "deterministic_conflict"),
        (make(retrieved_rule_chunk_ids=["c9"]), "", "unattributed_rule_chunk"),
    ]


_N = len(_raws())
_EXPECTED = ", ".join(f"({i}, {_quoted(e)}, {_quoted(r)})" for i, (_, e, r) in enumerate(_raws()))


def _proposals(spark, d):
    k = F.element_at(F.array(*[F.lit(r) for r, _, _ in _raws()]), (F.col("o_orderkey") % _N + 1).cast("int"))
    text = F.lit("See 42 USC §1983 here.")
    rows = orders(spark, d).select(F.col("o_orderkey").alias("doc_id"), k.alias("raw"), text.alias("text"), F.lit("bluepages").alias("expected_mode"), F.lit("statute").alias("expected_source_type"), F.lit(4).alias("expected_start"), F.lit(16).alias("expected_end"), F.array(F.lit("STATUTE_CODE_ABBREVIATION")).alias("issue_codes"), F.array(F.lit("c1")).alias("chunk_ids"))
    return proposals.validate_proposals(proposals.parse_proposals(rows))


@query(f"SELECT o_orderkey AS doc_id, errors, reasons, reasons = '' AS valid FROM orders JOIN (VALUES {_EXPECTED}) e(k, errors, reasons) ON o_orderkey % {_N} = k")
def proposal_validation(spark, d):
    return _proposals(spark, d).select("doc_id", F.array_join("parse_errors", ",").alias("errors"), F.array_join("reasons", ",").alias("reasons"), "valid")


@query(f"SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % {_N} = 0 THEN 'See 42 U.S.C. § 1983 here.' ELSE 'See 42 USC §1983 here.' END AS text, cast(o_orderkey % {_N} = 0 AS BIGINT) AS n_applied, cast(o_orderkey % {_N} <> 0 AS BIGINT) AS n_skipped FROM orders")
def proposal_apply(spark, d):
    rows = _proposals(spark, d)
    return proposals.apply_proposals(rows, rows.select("doc_id", "text")).select("doc_id", "text", F.size("applied").alias("n_applied"), F.size("skipped").alias("n_skipped"))


def _answers(tasks):
    """A model that repeats the rules' suggestion for statutes, says nonsense for regulations and fails for the rest."""
    issue = F.try_element_at("issues", F.lit(1))
    known = {"citation_text": F.col("citation_text"), "start": F.col("start"), "end": F.col("end"), "source_type": F.col("source_type"), "mode": F.col("mode"), "issue_code": issue["code"], "explanation": F.lit("Periods and spacing."), "confidence": F.lit("high"), "proposed_citation": issue["suggestion"], "missing_facts": F.array().cast("array<string>"), "facts_used": F.create_map(F.lit("title"), F.coalesce(F.col("components")["title"], F.lit("0")))}
    said = F.to_json(F.struct(*[v.alias(n) for n, v in known.items()]))
    return tasks.withColumn("raw", F.when((F.col("source_type") == "statute") & issue.isNotNull(), said).when(F.col("source_type") == "regulation", "no json"))


@query(_with("SELECT b.doc_id, CASE WHEN n IS NULL THEN 'no_citations' WHEN good = n THEN 'completed' WHEN good > 0 THEN 'partial' ELSE 'fallback' END AS status, CASE WHEN n > 0 AND good = 0 THEN CASE WHEN said = 0 THEN 'runtime_error' ELSE 'invalid_model_output' END END AS fallback_reason, coalesce(good, 0) AS n_applied FROM briefs b LEFT JOIN (SELECT doc_id, count(*) AS n, count(*) FILTER (kind = 'statute_bad') AS good, count(*) FILTER (kind IN ('statute_bad', 'regulation', 'regulation_bad')) AS said FROM cites GROUP BY 1) USING (doc_id)"))
def hybrid_review(spark, d):
    b = briefs(spark, d)
    return proposals.hybrid_review(b, context.citation_tasks(b), _answers, apply=True).select("doc_id", "status", "fallback_reason", F.size("applied").alias("n_applied"))


@query(_with("SELECT doc_id, CASE WHEN n IS NULL THEN 'no_citations' ELSE 'fallback' END AS status FROM briefs LEFT JOIN (SELECT doc_id, count(*) AS n FROM cites GROUP BY 1) USING (doc_id)"))
def model_disabled(spark, d):
    b = briefs(spark, d)
    return proposals.hybrid_review(b, context.citation_tasks(b), seams.part("model", "disabled")).select("doc_id", "status")


# Guidance

_LIBRARY = [(f"rule-{i:02}", t, s, "both" if i % 3 else "bluepages", "all", ("short_forms", "internet_sources", "unclassified")[i % 3], ("general", "general_us", "california")[i % 3], "unknown") for i, (_, t, _, _, _, s, _) in enumerate(tables.LINT_RULES)]
_LIBRARY += [(f"source-{i:02}", s[0], s[3], "both" if i % 2 else "whitepages", s[0], "unclassified", "general", "2025") for i, s in enumerate(guidance.SOURCES)]
_LIB_SCHEMA = "chunk_id string, heading string, text string, mode string, source_type string, rule_family string, jurisdiction string, revision_date string"
_LIB_SQL = ", ".join("(" + ", ".join(_quoted(x) for x in r) + ")" for r in _LIBRARY)
_ASKED = {"mode": "CASE doc_id % 3 WHEN 0 THEN 'bluepages' WHEN 1 THEN 'whitepages' END", "source_type": "CASE WHEN doc_id % 5 = 0 THEN 'case' WHEN doc_id % 5 = 1 THEN '' END", "rule_family": "CASE WHEN doc_id % 7 = 0 THEN 'Short forms: Id.' WHEN doc_id % 7 = 1 THEN 'internet sources' WHEN doc_id % 7 = 2 THEN 'unclassified' END", "jurisdiction": "CASE WHEN doc_id % 4 = 0 THEN 'texas' WHEN doc_id % 4 = 1 THEN 'california' END", "revision_date": "CASE WHEN doc_id % 11 = 0 THEN '2025' END"}
_TOPIC = "CASE lower(trim(q.rule_family)) " + " ".join(f"WHEN {_quoted(k)} THEN {_quoted(v)}" for k, v in retrieval.FAMILY_TOPICS.items()) + " ELSE q.rule_family END"
_TOKENS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"


@query(f"WITH c(chunk_id, heading, text, mode, source_type, rule_family, jurisdiction, revision_date) AS (VALUES {_LIB_SQL}), l AS (SELECT *, {_TOKENS.format('heading || chr(32) || text')} AS t FROM c), q AS (SELECT doc_id, {_TOKENS.format('text')} AS w, {', '.join(f'{v} AS {k}' for k, v in _ASKED.items())} FROM documents), "
       f"s AS (SELECT doc_id AS query_id, chunk_id, round(len(list_intersect(t, w)) / sqrt(greatest(1, len(t) * len(w))), 8) AS score FROM q, l WHERE (coalesce(q.mode, '') = '' OR l.mode IN ('both', q.mode)) AND (coalesce(q.source_type, '') = '' OR l.source_type IN ('all', q.source_type)) AND (coalesce(q.rule_family, '') = '' OR l.rule_family = {_TOPIC}) AND (coalesce(q.jurisdiction, '') = '' OR l.jurisdiction IN ('general', 'general_us', q.jurisdiction)) AND (coalesce(q.revision_date, '') = '' OR l.revision_date = q.revision_date)) "
       "SELECT query_id, chunk_id, cast(round(score * 1e6) AS BIGINT) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 3")  # fmt: skip
def rules_for_documents(spark, d):
    docs = _table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), "text", *[F.expr(v).cast("string").alias(k) for k, v in _ASKED.items()])
    return retrieval.retrieve_rules(docs, spark.createDataFrame(_LIBRARY, _LIB_SCHEMA)).select("query_id", "chunk_id", F.round(F.col("score") * 1e6).cast("long").alias("score"), "rank")


@query("WITH f AS (SELECT l_orderkey AS doc_id, bool_or(l_returnflag = 'R') AS review_required, count(DISTINCT l_partkey % 5) AS families, bool_or(l_partkey % 5 < 2) AS signals FROM lineitem GROUP BY 1), g AS (SELECT o_orderkey AS doc_id, coalesce(review_required, false) AS review_required, o_orderkey % 5 = 0 AS ambiguous, coalesce(families, 0) AS families, o_orderkey % 7 = 0 AS mode_uncertain, coalesce(signals, false) AS signals FROM orders LEFT JOIN f ON doc_id = o_orderkey) SELECT *, review_required OR ambiguous OR families > 1 OR mode_uncertain OR signals AS wanted FROM g")
def guidance_gate(spark, d):
    docs = _table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"))
    mode = F.when(F.col("l_partkey") % 5 == 0, "signals").when(F.col("l_partkey") % 5 == 1, "parentheticals").otherwise((F.col("l_partkey") % 5).cast("string"))
    found = _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), mode.alias("family"), F.when(F.col("l_returnflag") == "R", "review_required").otherwise("suggested_fix").alias("correction_level"))
    resolved = docs.select("doc_id", F.when(F.col("doc_id") % 5 != 0, "a").alias("authority_id"))
    modes = docs.select("doc_id", F.when(F.col("doc_id") % 7 == 0, "low").otherwise("high").alias("confidence"))
    return retrieval.guidance_gate(docs, found, resolved, modes)


_FAMILY = ", ".join(f"({i}, {_quoted(f)}, {_quoted(s)}, {_quoted('; '.join(r))})" for i, (f, s, r) in enumerate(guidance.COVERAGE))


@query(f"""SELECT family, status, rules, count(o_orderkey) AS n_orders
FROM (VALUES {_FAMILY}) t(i, family, status, rules) LEFT JOIN orders ON o_custkey % {len(guidance.COVERAGE)} = i GROUP BY ALL""")
def rule_coverage(spark, d):
    """What the rules cover of each family of sources, with the orders that fall to the family."""
    family = F.element_at(F.array(*[F.lit(f) for f, _, _ in guidance.COVERAGE]), (F.col("o_custkey") % len(guidance.COVERAGE) + 1).cast("int"))
    asked = _table(spark, d, "orders").groupBy(family.alias("family")).agg(F.count("*").alias("n"))
    told = guidance.rule_coverage(spark).join(asked, "family", "left")
    return told.select("family", "status", F.array_join("implemented_rules", "; ").alias("rules"), F.coalesce("n", F.lit(0)).alias("n_orders"))


_PACK = [(k, "cast(NULL AS VARCHAR)", x) for k, xs in (("core", guidance.CORE), ("general", guidance.GENERAL), ("mode", guidance.MODES["whitepages"])) for x in xs]
_PACK += [("source", _quoted(s[0]), s[3]) for s in guidance.SOURCES if s[0] in ("case", "internet")]
_PACK_ROWS = ", ".join(f"('{k}', {t}, {_quoted(x)})" for k, t, x in _PACK)


@query(_with(f"""SELECT section, t.source_type, content, n_citations FROM (VALUES {_PACK_ROWS}) t(section, source_type, content)
LEFT JOIN (SELECT {_TYPE} AS source_type, count(*) AS n_citations FROM cites GROUP BY 1) n ON n.source_type = t.source_type"""))
def knowledge_pack(spark, d):
    """The guidance for two types of sources, with how often the briefs cite them."""
    cited = extract.citation_rows(briefs(spark, d)).groupBy("source_type").agg(F.count("*").alias("n_citations"))
    pack = guidance.knowledge_pack(spark, "whitepages", ["Website", "case_law", "nonsense"])
    return pack.join(cited, "source_type", "left").select("section", "source_type", "content", "n_citations")


@query("WITH p AS (SELECT a.vec_id, (a.vec_id % 97) / 97.0 AS lexical_score, CASE WHEN a.vec_id % 5 <> 0 THEN list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: cast(z[1] AS DOUBLE) * cast(z[2] AS DOUBLE))) END AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id // 2) SELECT vec_id, CASE WHEN similarity IS NULL THEN 'lexical_fallback_hybrid_unavailable' ELSE 'hybrid_local_embedding' END AS scorer, cast(round(100 * CASE WHEN similarity IS NULL THEN lexical_score ELSE round(0.5 * lexical_score + 0.5 * similarity, 4) END) AS BIGINT) AS score FROM p")
def hybrid_passage_scores(spark, d):
    e = _table(spark, d, "embeddings")
    pairs = e.withColumn("half", F.floor(F.col("vec_id") / 2)).join(e.select(F.col("vec_id").alias("half"), F.col("embedding").alias("query_vector")), "half")
    rows = pairs.select("vec_id", ((F.col("vec_id") % 97) / 97.0).alias("lexical_score"), F.when(F.col("vec_id") % 5 != 0, F.col("query_vector")).alias("query_vector"), F.col("embedding").alias("vector"))
    return evidence.hybrid_scores(rows).select("vec_id", "scorer", F.round(F.col("combined_score") * 100).cast("long").alias("score"))


# Evaluation

@query("""WITH r AS (SELECT o_orderkey % 9 <> 0 AS valid_json, o_orderkey % 8 <> 0 AS same_span, o_orderstatus AS g, CASE WHEN o_orderkey % 7 = 0 THEN 'F' ELSE o_orderstatus END AS f, o_orderkey % 6 = 0 AS none_e, o_orderkey % 10 = 0 AS none_p, o_orderkey % 4 = 0 AS off, o_orderkey % 50 = 0 AS facts, o_orderkey % 100 = 0 AS unsafe FROM orders),
l AS (SELECT DISTINCT g AS label FROM r UNION SELECT DISTINCT f FROM r),
s AS (SELECT label, count(*) FILTER (g = label AND f = label) AS tp, count(*) FILTER (g <> label AND f = label) AS fp, count(*) FILTER (g = label AND f <> label) AS fn FROM l, r GROUP BY label),
pr AS (SELECT coalesce(round(tp / nullif(tp + fp, 0), 6), 0) AS p, coalesce(round(tp / nullif(tp + fn, 0), 6), 0) AS r FROM s)
SELECT round(avg(cast(valid_json AS INT)), 6) AS valid_json_rate, round(avg(cast(same_span AS INT)), 6) AS citation_span_accuracy, round(count(*) FILTER (NOT none_e AND NOT none_p AND NOT off) / count(*) FILTER (NOT none_e), 6) AS exact_correction_accuracy,
 round(count(*) FILTER (none_e AND none_p) / count(*) FILTER (none_p), 6) AS abstention_precision, round(count(*) FILTER (none_e AND none_p) / count(*) FILTER (none_e), 6) AS abstention_recall, round(avg(cast(facts AS INT)), 6) AS hallucinated_fact_rate, round(avg(cast(unsafe AS INT)), 6) AS unsafe_auto_apply_rate,
 (SELECT round(avg(coalesce(round(2 * p * r / nullif(p + r, 0), 6), 0)), 6) FROM pr) AS issue_classification_macro_f1 FROM r""")
def prediction_rates(spark, d):
    k = F.col("o_orderkey")
    cite = lambda none, other: F.when(k % none != 0, F.when(F.lit(other) & (k % 4 == 0), "other").otherwise("same"))
    e = F.struct(F.lit(1).alias("start"), F.lit(9).alias("end"), F.col("o_orderstatus").alias("issue_code"), cite(6, False).alias("proposed_citation"))
    p = F.struct(F.when(k % 8 != 0, 1).alias("start"), F.lit(9).alias("end"), F.when(k % 7 == 0, "F").otherwise(F.col("o_orderstatus")).alias("issue_code"), cite(10, True).alias("proposed_citation"))
    return scoring.prediction_rates(_table(spark, d, "orders").select((k % 9 != 0).alias("valid_json"), (k % 50 == 0).alias("unsupported_facts"), (k % 100 == 0).alias("unsafe_applied"), e.alias("expected"), p.alias("predicted")))


@query("WITH r AS (SELECT CASE o_orderkey % 5 WHEN 0 THEN 'fix' WHEN 1 THEN 'extract' WHEN 2 THEN 'quote' WHEN 3 THEN 'rank' ELSE 'other' END AS task, CASE o_orderkey % 5 WHEN 4 THEN false ELSE o_custkey % 3 <> 0 END AS passed FROM orders) SELECT task, count(*) AS total, count(*) FILTER (passed) AS passed, round(count(*) FILTER (passed) / count(*), 4) AS accuracy FROM r GROUP BY GROUPING SETS ((task), ())")
def gold_accuracy(spark, d):
    k, good = F.col("o_orderkey") % 5, F.col("o_custkey") % 3 != 0
    text = "Under 42 USC §1983 he sued."
    rows = _table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(k == 0, "fix").when(k == 1, "extract").when(k == 2, "quote").when(k == 3, "rank").otherwise("other").alias("task"), F.lit(None).cast("string").alias("mode"), F.lit(text).alias("input"),
        F.when(good, "Under 42 U.S.C. § 1983 he sued.").otherwise(F.lit(text)).alias("expected"), F.when(good, F.array(F.lit("statute"))).otherwise(F.array(F.lit("case"))).alias("expected_source_types"),
        F.lit("plain words").alias("quote"), F.lit("It said plain words. Then more was said about cats.").alias("source"), F.when(good, F.array(F.lit("exact"), F.lit("normalized"))).otherwise(F.array(F.lit("absent"))).alias("expected_statuses"),
        F.lit("more about cats").alias("proposition"), F.when(good, "CATS").otherwise(F.lit("dogs")).alias("expected_contains"),
    )
    return scoring.task_accuracy(scoring.gold_rows(rows))


_FAM = [f for f in scoring.FAMILIES][:4]


def _evaluated(spark, d):
    """An evaluation table made from orders: what is expected and found differs by remainders of the key."""
    k = F.col("o_orderkey")
    cite = lambda t, s: F.struct(F.lit(t).alias("text"), F.lit(s).alias("source_type"))
    keep = lambda *xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    edit = F.struct(F.when(k % 40 == 0, 50).otherwise(4).alias("start"), F.when(k % 40 == 0, 60).otherwise(16).alias("end"), F.lit("42 USC §1983").alias("original"), F.when(k % 30 == 0, "42 U.S.C. § 1984").otherwise("42 U.S.C. § 1983").alias("suggestion"), F.when(k % 25 == 0, "suggested_fix").otherwise("safe_auto_fix").alias("correction_level"))
    return _table(spark, d, "orders").select(
        k.alias("doc_id"), F.lit("bluepages").alias("mode_expected"), F.when(k % 9 == 0, "whitepages").otherwise("bluepages").alias("mode_actual"),
        F.array(cite("a", "case"), cite("b", "statute"), cite("c", "short_form")).alias("expected"), keep(cite("a", "case"), F.when(k % 3 != 0, F.when(k % 7 == 0, cite("b", "regulation")).otherwise(cite("b", "statute"))), F.when(k % 11 == 0, cite("x", "case"))).alias("actual"),
        F.when(k % 3 == 0, 1).otherwise(2).alias("n_authorities"), (k % 3).cast("int").alias("expected_ambiguous"), (k % 2).cast("int").alias("n_ambiguous"), (k % 13 == 0).cast("int").alias("n_guesses"),
        keep(F.when(k % 2 == 0, F.lit(_FAM[0])), F.when(k % 5 == 0, F.lit(_FAM[1]))).alias("expected_families"), keep(F.when(k % 4 == 0, F.lit(_FAM[0])), F.when(k % 5 == 0, F.lit(_FAM[1])), F.when(k % 9 == 0, F.lit(_FAM[2]))).alias("actual_families"),
        F.when(k % 2 == 0, "fixed").alias("safe_fixed_text"), F.when(k % 8 == 0, "other").otherwise("fixed").alias("corrected_text"), F.array(edit).alias("edits"), F.array(F.struct(F.lit(4).alias("start"), F.lit(16).alias("end"))).alias("ranges"),
        F.when(k % 2 == 0, (k % 3).cast("int")).alias("n_chunks"), F.when(k % 2 == 0, F.least(k % 3, F.lit(1)).cast("int")).alias("n_faithful"), (k % 10).cast("double").alias("latency_ms"),
    )


_PER = "SELECT o_orderkey AS k, 1 + cast(k % 3 <> 0 AS INT) + cast(k % 11 = 0 AS INT) AS na, 1 + cast(k % 3 <> 0 AS INT) AS hit, 1 + cast(k % 3 <> 0 AND k % 7 <> 0 AS INT) AS typed, k % 3 AS we, k % 2 AS wa, cast(k % 2 = 0 AS INT) + cast(k % 5 = 0 AS INT) AS fe, cast(k % 4 = 0 AS INT) + cast(k % 5 = 0 AS INT) + cast(k % 9 = 0 AS INT) AS fa, cast(k % 4 = 0 AS INT) + cast(k % 5 = 0 AS INT) AS fh FROM orders"
_METRICS = f"""WITH p AS ({_PER}), m AS (SELECT count(*) AS document_count, sum(hit) / sum(na) AS citation_span_precision, sum(hit) / (3 * count(*)) AS citation_span_recall, sum(typed) / sum(hit) AS source_type_accuracy, count(*) FILTER (k % 9 <> 0) / count(*) AS document_mode_accuracy, count(*) FILTER (k % 3 <> 0) / count(*) AS authority_identity_accuracy,
 sum(least(we, wa)) / sum(we) AS ambiguity_detection_recall, sum(least(we, wa)) / sum(wa) AS abstention_precision, sum(fh) / sum(fa) AS issue_precision_by_family, sum(fh) / sum(fe) AS issue_recall_by_family, count(*) FILTER (k % 2 = 0 AND k % 8 <> 0) / count(*) FILTER (k % 2 = 0) AS safe_fix_precision, count(*) FILTER (k % 25 = 0) AS unsafe_automatic_edit_count,
 count(*) FILTER (k % 30 = 0) AS unsupported_fact_introduction_count, count(*) FILTER (k % 40 = 0) AS noncitation_prose_modification_count, count(*) FILTER (k % 13 = 0) AS unresolved_antecedent_guess_count, count(*) FILTER (k % 2 = 0 AND k % 3 > 0) / count(*) FILTER (k % 2 = 0) AS retrieval_recall_at_k,
 count(*) FILTER (k % 2 = 0 AND k % 3 > 0) / sum(k % 3) FILTER (k % 2 = 0) AS explanation_faithfulness, avg(k % 10) AS latency_ms FROM p)"""
_RATES = ("citation_span_precision", "citation_span_recall", "source_type_accuracy", "document_mode_accuracy", "authority_identity_accuracy", "ambiguity_detection_recall", "abstention_precision", "issue_precision_by_family", "issue_recall_by_family", "safe_fix_precision", "retrieval_recall_at_k", "explanation_faithfulness", "latency_ms")
_COUNTS = ("document_count", "unsafe_automatic_edit_count", "unsupported_fact_introduction_count", "noncitation_prose_modification_count", "unresolved_antecedent_guess_count")


@query(_METRICS + " SELECT " + ", ".join(f"cast(round({c} * 1e6) AS BIGINT) AS {c}" for c in _RATES) + ", " + ", ".join(_COUNTS) + " FROM m")
def system_metrics(spark, d):
    m = scoring.system_metrics(_evaluated(spark, d))
    return m.select(*[F.round(F.col(c) * 1e6).cast("long").alias(c) for c in _RATES], *_COUNTS)


@query(_METRICS + " SELECT safe_fix_precision >= 0.99 AS safe_fix_precision_at_least_0_99, unsafe_automatic_edit_count = 0 AS zero_unsafe_automatic_edits, true AS zero_local_mode_network_calls, false AS passed, 'document_structure_or_parsing,authority_identity,retrieval' AS failures, false AS retraining_recommended FROM m")
def release_gates(spark, d):
    m = scoring.system_metrics(_evaluated(spark, d))
    gates = scoring.release_gates(m).select("safe_fix_precision_at_least_0_99", "zero_unsafe_automatic_edits", "zero_local_mode_network_calls", "passed")
    told = scoring.failure_taxonomy(m).select(F.array_join(F.transform("failures", lambda x: x["class"]), ",").alias("failures"), "retraining_recommended")
    return gates.withColumn("failures", told.select("failures").scalar()).withColumn("retraining_recommended", told.select("retraining_recommended").scalar())


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a[0]}', '{'measured' if a[0] == 'deterministic_only' else 'not_run'}')" for a in scoring.ABLATIONS) + ") t(name, status)")
def ablation_matrix(spark, d):
    return scoring.ablation_matrix(spark, {"deterministic_only": scoring.system_metrics(_evaluated(spark, d))}).select("name", "status")


def _real(spark, d):
    k = F.col("o_orderkey")
    cite = lambda i: F.struct(F.lit("x").alias("text"), F.lit(i).alias("start"), F.lit(i + 5).alias("end"), F.lit("case").alias("source_type"))
    keep = lambda *xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    rows = _table(spark, d, "orders").select(
        k.alias("document_id"), F.lit("test").alias("split"), keep(F.when(k % 4 != 0, cite(1)), F.when(k % 4 > 1, cite(9))).alias("expected"), keep(F.when(k % 4 != 0, cite(1)), F.when(k % 5 == 0, cite(20))).alias("actual"),
        keep(F.when(k % 3 == 0, F.lit("A")), F.lit("")).alias("expected_codes"), keep(F.when(k % 6 == 0, F.lit("A"))).alias("actual_codes"), F.when(k % 7 == 0, "t").alias("safe_fixed_text"), F.when(k % 14 == 0, "t").alias("corrected_text"),
        F.array(F.struct(F.lit("safe_auto_fix").alias("correction_level"), F.when(k % 17 == 0, "low").otherwise("high").alias("confidence"), F.lit("s").alias("suggestion"))).alias("edits"),
        F.array(F.struct(F.lit(False).alias("guessed"), F.when(k % 19 == 0, "Guessed").otherwise("resolved").alias("resolution_status"))).alias("resolutions"),
        (k % 23 == 0).alias("verification_available"), F.lit(None).cast("boolean").alias("deep_review_available"), (k % 29 == 0).alias("source_overwritten"), F.lit(True).alias("export_valid"), F.when(k % 31 == 0, "invalid_docx").alias("error_code"),
    )
    return scoring.real_document_scores(rows)


_REAL = """WITH r AS (SELECT o_orderkey AS k, CASE WHEN k % 4 = 0 THEN CASE WHEN k % 5 = 0 THEN 0.0 ELSE 1.0 END WHEN k % 5 = 0 THEN 0.5 ELSE 1.0 END AS cp, CASE WHEN k % 4 > 1 THEN 0.5 ELSE 1.0 END AS cr, CASE WHEN k % 3 = 0 AND k % 6 <> 0 THEN 0.0 ELSE 1.0 END AS ip, CASE WHEN k % 3 = 0 AND k % 6 <> 0 THEN 0.0 ELSE 1.0 END AS ir FROM orders),
g AS (SELECT *, cp = 1 AND cr = 1 AND ip = 1 AND ir = 1 AND (k % 7 <> 0 OR k % 14 = 0) AND k % 17 <> 0 AND k % 19 <> 0 AND k % 23 <> 0 AND k % 29 <> 0 AND k % 31 <> 0 AS gate FROM r)"""


@query(_REAL + " SELECT k AS document_id, cast(100 * cp AS BIGINT) AS citation_precision, cast(100 * cr AS BIGINT) AS citation_recall, cast(100 * ip AS BIGINT) AS issue_precision, cast(100 * ir AS BIGINT) AS issue_recall, gate AS release_gate_passed FROM g")
def real_document_scores(spark, d):
    return _real(spark, d).select("document_id", *[F.round(F.col(c) * 100).cast("long").alias(c) for c in ("citation_precision", "citation_recall", "issue_precision", "issue_recall")], "release_gate_passed")


@query(_REAL + " SELECT count(*) AS document_count, cast(round(avg(cp) * 1e6) AS BIGINT) AS citation_precision, cast(round(avg(ir) * 1e6) AS BIGINT) AS issue_recall, count(*) FILTER (k % 17 = 0) AS unsafe_automatic_edits, count(*) FILTER (k % 29 = 0) AS source_overwrites, false AS release_gate_passed FROM g")
def real_document_summary(spark, d):
    s = scoring.real_document_summary(_real(spark, d))
    return s.select("document_count", *[F.round(F.col(c) * 1e6).cast("long").alias(c) for c in ("citation_precision", "issue_recall")], "unsafe_automatic_edits", "source_overwrites", "release_gate_passed")


@query("SELECT o_orderkey AS doc_id, CASE o_orderkey % 4 WHEN 0 THEN 'signals' WHEN 1 THEN 'short forms: Id.,pincites and quotations' WHEN 2 THEN 'short forms: cases,supra and hereinafter' ELSE '' END AS families FROM orders")
def expected_families(spark, d):
    k = F.col("o_orderkey") % 4
    explicit = F.when(k == 0, F.array(F.lit("signals")))
    features = F.when(k == 1, F.array(F.lit("quotation"), F.lit("ambiguous antecedent"))).when(k == 2, F.array(F.lit("supra"), F.lit("invalid short case"))).otherwise(F.array(F.lit("nothing")))
    return _table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.array_join(scoring.expected_families(explicit, features), ",").alias("families"))


@query(_with(f"SELECT {_TYPE} AS source_type, kind IN ('id', 'id_bad', 'supra') AS short, count(*) AS n, count(DISTINCT doc_id) AS n_documents FROM cites GROUP BY CUBE ({_TYPE}, kind IN ('id', 'id_bad', 'supra'))"))
def citation_cube(spark, d):
    c = extract.citation_rows(briefs(spark, d)).withColumn("short", F.col("source_type") == "short_form")
    return scoring.corpus_cube(c, "source_type", "short").select("source_type", "short", "n", "n_documents")


# Sessions


def _items(spark, d):
    return review.review_items(lint.issue_rows(briefs(spark, d)))


@query(_with(_ISSUES + f", i AS (SELECT code, suggestion, CASE WHEN suggestion IS NULL THEN 'pending' ELSE 'accepted' END AS decision FROM issues) SELECT count(*) AS total, count(*) FILTER (decision = 'accepted') AS accepted, 0::BIGINT AS rejected, count(*) FILTER (decision = 'pending') AS pending, count(suggestion) AS safe_text_edits, count(*) FILTER (suggestion IS NULL) AS review_required, 0::BIGINT AS unsupported FROM i"))
def review_counters(spark, d):
    return sessions.review_summary(_items(spark, d))


@query(_with(_ISSUES + "SELECT doc_id, cast(s AS BIGINT) AS start FROM issues WHERE code = 'REPORTER_ABBREVIATION'"))
def review_search(spark, d):
    return sessions.filter_items(_items(spark, d), "safe", severity="Error", search=" f.2D ").select("doc_id", "start")


_REVIEW_TEXT = "See 42 USC §1983 here."


def _review_json(k: int) -> str:
    import json

    one = {"start": 4, "end": 16, "original": "42 USC §1983", "replacement": "42 U.S.C. § 1983", "code": "C", "message": "m", "correction_level": "safe_auto_fix"}
    return json.dumps([
        {"issues": [one]},
        {"review_items": [{"span": [4, 16], "suggestion": "x", "level": "suggested", "rule": "R"}]},
        {"findings": [7, {"span": {"start": 4, "end_offset": 16}, "explanation": "e", "auto_fixable": True, "new_text": "y"}]},
        {"remaining_issues": [{"citation": "here", "id": "i9", "kind": "K"}], "issues": [{"start": 90, "end": 95}]},
        {"issues": [one, {**one, "id": "dup"}, {"id": "dup", "start": 0, "end": 3}]},
        {"applied_edits": [{"old_text": "absent words"}], "issues": "none"},
    ][k])


_SHA0 = "substr(sha256('[4, 16, \"42 USC §1983\", \"42 U.S.C. § 1983\", \"C\", 0]'), 1, 20)"
_NORMALISED = f"""(VALUES (0, {_SHA0}, 4, 16, '42 USC §1983', '42 U.S.C. § 1983', 'C', 'm', 'safe_auto_fix', true),
(1, substr(sha256('[4, 16, "42 USC §1983", "x", "R", 0]'), 1, 20), 4, 16, '42 USC §1983', 'x', 'R', NULL, 'suggested', false),
(2, substr(sha256('[4, 16, "42 USC §1983", "y", null, 1]'), 1, 20), 4, 16, '42 USC §1983', 'y', NULL, 'e', 'review', true),
(3, 'i9', 17, 21, 'here', NULL, 'K', NULL, 'review', false),
(4, {_SHA0}, 4, 16, '42 USC §1983', '42 U.S.C. § 1983', 'C', 'm', 'safe_auto_fix', true),
(4, 'dup', 4, 16, '42 USC §1983', '42 U.S.C. § 1983', 'C', 'm', 'safe_auto_fix', true)) t(k, id, s, e, original, replacement, issue_code, message, correction_level, safe_to_apply)"""


@query(f"SELECT o_orderkey AS session_id, id, cast(s AS BIGINT) AS start, cast(e AS BIGINT) AS \"end\", original, replacement, issue_code, message, correction_level, safe_to_apply FROM orders JOIN {_NORMALISED} ON o_orderkey % 6 = k")
def normalized_issues(spark, d):
    rows = orders(spark, d).select(F.col("o_orderkey").alias("session_id"), F.lit(_REVIEW_TEXT).alias("text"), F.element_at(F.array(*[F.lit(_review_json(k)) for k in range(6)]), (F.col("o_orderkey") % 6 + 1).cast("int")).alias("review"))
    return sessions.normalize_issues(rows).drop("provenance")


@query("SELECT o_orderkey, o_orderdate::TIMESTAMP AS o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 200 OFFSET 40")
def offset_page(spark, d):
    return sessions.offset_page(_table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("o_orderdate")), F.desc("o_orderdate"), F.col("o_orderkey"), limit=900, offset=40)


@query("SELECT user_id, event_id, CASE WHEN row_number() OVER (ORDER BY cast(event_id AS VARCHAR) DESC, user_id DESC) = 30 THEN translate(base64(encode('[\"' || event_id || '\",\"' || user_id || '\"]')), '+/', '-_') END AS next_cursor FROM (SELECT * FROM events WHERE cast(event_id AS VARCHAR) < '7' ORDER BY cast(event_id AS VARCHAR) DESC, user_id DESC LIMIT 30)")
def cursor_page(spark, d):
    import base64

    e = _table(spark, d, "events").select("user_id", F.col("event_id").cast("string").alias("event_id"))
    after = base64.urlsafe_b64encode(b'["7","0"]').decode()
    return sessions.cursor_page(e, "event_id", "user_id", 30, after).select("user_id", F.col("event_id").cast("long").alias("event_id"), "next_cursor")


_STATE = "CASE event_type WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'click' THEN 'queued' ELSE 'failed' END"


@query(f"WITH e AS (SELECT user_id AS job_id, event_id, ts, {_STATE} AS state, CASE WHEN event_id % 3 = 0 THEN value / 100 END AS progress FROM events) SELECT job_id, arg_max(state, event_id) AS state, cast(round(1e4 * greatest(0, least(1, coalesce(arg_max(progress, event_id) FILTER (progress IS NOT NULL), 0)))) AS BIGINT) AS progress, arg_min(ts, event_id) FILTER (state = 'running') AS started_at, arg_max(ts, event_id) FILTER (state IN ('completed', 'failed', 'cancelled')) AS completed_at FROM e GROUP BY 1")
def job_states(spark, d):
    e = _table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), F.expr(_STATE).alias("state"), F.when(F.col("event_id") % 3 == 0, F.col("value") / 100).alias("progress"), F.lit(None).cast("string").alias("error"))
    return sessions.job_states(e).select("job_id", "state", F.round(F.col("progress") * 1e4).cast("long").alias("progress"), "started_at", "completed_at")


@query("WITH s AS (SELECT user_id AS session_id, max(event_id) AS revision, arg_max(props, event_id) AS content, arg_max(event_id % 2 = 0, event_id) AS review_current FROM events GROUP BY 1) SELECT session_id, revision, sha256(coalesce(content, '')) AS content_sha256, review_current FROM s WHERE session_id % 10 <> 0")
def session_states(spark, d):
    e = _table(spark, d, "events")
    log = e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("revision"), F.col("props").alias("content"), F.when(F.col("event_id") % 2 == 0, F.col("event_id")).otherwise(F.col("event_id") - 1).alias("review_revision"))
    deleted = e.where("user_id % 10 = 0").select(F.col("user_id").alias("session_id"))
    return sessions.current_sessions(log, deleted).select("session_id", "revision", "content_sha256", "review_current")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'unknown_session' WHEN o_orderkey % 5 = 0 THEN 'stale_revision' WHEN o_orderkey % 7 = 0 THEN 'no_current_review' ELSE 'ok' END AS status FROM orders")
def decisions_allowed(spark, d):
    o = _table(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").alias("session_id"), F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(2).alias("revision"))
    s = o.where("o_orderkey % 3 <> 0").select("session_id", F.lit(2).alias("revision"), (F.col("o_orderkey") % 7 != 0).alias("review_current"))
    return sessions.decisions_allowed(o, s).select("o_orderkey", "status")


@query(_with(_ISSUES + ", n AS (SELECT doc_id, count(*) AS n FROM issues GROUP BY 1) SELECT doc_id, substr(text, 1, 120) AS text, length(text) > 120 AS text_truncated, coalesce(n, 0) > 2 AS items_truncated, least(coalesce(n, 0), 2) AS shown, coalesce(n, 0) AS n_items FROM briefs LEFT JOIN n USING (doc_id)"))
def workspace_payload(spark, d):
    b = briefs(spark, d)
    return sessions.workspace_payload(b, lint.issue_rows(b), 120, 2).select("doc_id", "text", "text_truncated", "items_truncated", F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("shown"), "n_items")


# Names, addresses, files

_NAME = "concat(' My: file*', page_id, '  --a/b?.txt ')"


@query("SELECT page_id, 'My-file' || page_id || '-ab.txt' AS filename, 'My file ' || page_id || ' --a b .txt' AS title FROM pages")
def file_names(spark, d):
    return _table(spark, d, "pages").select("page_id", sessions.safe_filename(F.expr(_NAME)).alias("filename"), sessions.document_title(F.expr(_NAME)).alias("title"))


_ADDRESS = "CASE page_id % 5 WHEN 0 THEN 'https://www.Example.org./x' WHEN 1 THEN 'http://www.example.org/x' WHEN 2 THEN 'https://www.example.org.evil.net/' WHEN 3 THEN 'https://example.org/a?b=1' ELSE '/path' END"


@query(f"SELECT page_id, CASE WHEN page_id % 5 IN (0, 3) THEN {_ADDRESS} END AS allowed, CASE WHEN page_id % 5 = 4 THEN 'https://example.org/path' ELSE {_ADDRESS} END AS absolute FROM pages")
def followed_urls(spark, d):
    u = F.expr(_ADDRESS)
    return _table(spark, d, "pages").select("page_id", sessions.allowed_url(u, ("example.org", "www.example.org")).alias("allowed"), sessions.absolute_url(u, "https://example.org/").alias("absolute"))


@query("SELECT cast(doc_id AS VARCHAR) AS export_id, 'document-' || doc_id || '.md' AS filename, cast(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size_bytes, sha256(coalesce(text, '')) AS sha256 FROM documents")
def export_files(spark, d):
    return sessions.export_summary(exports.export_artifacts(_table(spark, d, "documents"), "md")).select("export_id", "filename", F.col("size_bytes").cast("long").alias("size_bytes"), "sha256")


@query()
def export_pdf(spark, d):
    return sessions.export_summary(exports.export_artifacts(_table(spark, d, "documents"), "pdf")).select("export_id", "filename", "size_bytes", "sha256")


@query("WITH f AS (SELECT l_orderkey AS doc_id, l_linenumber AS page, l_suppkey, l_quantity AS y, 6 + l_partkey % 9 AS font FROM lineitem), m AS (SELECT *, median(font) OVER (PARTITION BY doc_id) AS mid FROM f) SELECT doc_id, page, CASE WHEN y < 15 AND font < 0.85 * mid THEN 'medium' WHEN y < 15 THEN 'low' END AS note FROM m")
def pdf_note_fragments(spark, d):
    f = _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line"), F.lit(1).alias("page"), F.lit(0.0).alias("x"), F.col("l_quantity").cast("double").alias("y"), (6 + F.col("l_partkey") % 9).cast("double").alias("font"), F.lit(100.0).alias("height"), F.lit("t").alias("text"))
    return files.pdf_notes(f).select("doc_id", F.col("line").alias("page"), "note")


@query("WITH t AS (SELECT o_orderpriority AS tier, count(*) AS n FROM orders GROUP BY 1) SELECT sum(n)::BIGINT AS citations, '| tier | n |' || chr(10) || '|-|-|' || chr(10) || string_agg('| ' || tier || ' | ' || n || ' |', chr(10) ORDER BY '| ' || tier || ' | ' || n || ' |') AS markdown FROM t")
def audit_report(spark, d):
    return sinks.audit_report(_table(spark, d, "orders").select(F.col("o_orderpriority").alias("tier"))).select("citations", "markdown")


@query("SELECT p_partkey AS id, m AS mode, '{\"document\":\"See ' || p_partkey || ' U.S. 1.\",\"citation_text\":\"' || p_partkey || ' U.S. 1\",\"start\":4,\"end\":' || (4 + length(p_partkey || ' U.S. 1')) || ',\"mode\":\"' || m || '\",\"source_type\":\"case\",\"issue_code\":\"X\"}' AS asked, CASE WHEN p_partkey % 2 = 0 THEN '{\"proposed_citation\":null,\"abstain\":true}' ELSE '{\"proposed_citation\":\"p\",\"abstain\":false}' END AS answer FROM part, (VALUES ('bluepages'), ('whitepages')) v(m)")
def training_records(spark, d):
    rows = _table(spark, d, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit(" U.S. 1")).alias("citation"), F.when(F.col("p_partkey") % 2 != 0, "p").alias("proposed"), F.lit("case").alias("source_type"), F.lit("X").alias("issue_code"), F.col("p_partkey").alias("group"))
    out = sinks.training_records(rows)
    return out.select(F.col("metadata.group").alias("id"), F.col("metadata.mode").alias("mode"), F.col("messages")[0]["content"].alias("asked"), F.col("messages")[1]["content"].alias("answer"))


@query("SELECT o_custkey AS key, max(o_orderdate)::TIMESTAMP AS fetched_at FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' - INTERVAL 400 DAY GROUP BY 1")
def fresh_lookups(spark, d):
    rows = _table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderdate").cast("timestamp").alias("fetched_at"), "o_orderkey")
    return context.latest_lookups(rows, F.lit("1998-01-01").cast("timestamp"), 400 * 86_400).select("key", "fetched_at")


# Text around citations


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'not_supplied' WHEN 1 THEN 'confirmed_by_page_marker' WHEN 2 THEN 'passage_found_page_unverified' ELSE 'unverifiable' END AS status FROM orders")
def pincite_statuses(spark, d):
    k = F.col("o_orderkey") % 4
    pin = F.when(k == 0, " ").when(k == 1, "12").otherwise("13")
    source = F.when(F.col("o_orderkey") % 8 == 1, "so it went [12] on").otherwise("and Page 12 follows; *123 too")
    return _table(spark, d, "orders").select("o_orderkey", retrieval.pincite_status(pin, source, F.when(k == 2, 0.2).otherwise(0.1)).alias("status"))


@query(r"SELECT doc_id, cast(len(w) AS BIGINT) AS n, sha256(array_to_string(list_sort(w), ' ')) AS sha FROM (SELECT doc_id, list_distinct(list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)), lambda x: length(x) > 2)) AS w FROM documents)")
def evidence_words(spark, d):
    w = retrieval.words_longer(F.col("text"))
    return _table(spark, d, "documents").select("doc_id", F.size(w).alias("n"), F.sha2(F.array_join(F.array_sort(w), " "), 256).alias("sha"))


@query(_with("SELECT doc_id, cast(seg_start AS BIGINT) AS start, 'cf' AS normalized, 'supportive' AS \"group\", false AS explained FROM placed WHERE kind = 'signal' UNION ALL SELECT doc_id, cast(seg_start + 18 AS BIGINT), 'see', 'supportive', false FROM placed WHERE kind = 'signal' UNION ALL SELECT doc_id, cast(seg_start AS BIGINT), 'see', 'supportive', false FROM placed WHERE kind = 'id_bad' UNION ALL SELECT doc_id, cast(c_end + 13 AS BIGINT), 'see', 'supportive', false FROM cites WHERE kind = 'string_cite'").replace("false", "NULL::BOOLEAN"))
def parsed_signals(spark, d):
    return findings.signals(briefs(spark, d)).select("doc_id", "start", "normalized", "group", F.lit(None).cast("boolean").alias("explained"))


_PAREN = "concat('Cf. A v. B, 1 U.S. 2 (', CASE o_orderkey % 3 WHEN 0 THEN 'noting the rule' WHEN 1 THEN '9th Cir. 1990' ELSE '1990' END, '). Then Roe v. Doe, 3 U.S. 4 (1991), Xe v. Ye, 5 U.S. 6 (1992) (open.')"


@query("SELECT o_orderkey AS doc_id, 'SIGNAL_PARENTHETICAL_REVIEW' AS code, 0::BIGINT AS start FROM orders WHERE o_orderkey % 3 <> 0")
def findings_signal_parenthetical(spark, d):
    docs = orders(spark, d).select(F.col("o_orderkey").alias("doc_id"), F.expr(_PAREN.replace(" (open.", ".")).alias("text"))
    return findings.signal_findings(docs).where("code = 'SIGNAL_PARENTHETICAL_REVIEW'").select("doc_id", "code", "start")


@query("WITH t AS (SELECT o_orderkey AS doc_id, length('Cf. A v. B, 1 U.S. 2 (' || CASE o_orderkey % 3 WHEN 0 THEN 'noting the rule' WHEN 1 THEN '9th Cir. 1990' ELSE '1990' END || '). Then ') AS n FROM orders) SELECT doc_id, 'CITATION_GROUP_SEPARATOR' AS code, n + length('Roe v. Doe, 3 U.S. 4 (1991)') AS start, '; ' AS suggestion FROM t UNION ALL SELECT doc_id, 'PARENTHETICAL_SYNTAX', n + length('Roe v. Doe, 3 U.S. 4 (1991), Xe v. Ye, 5 U.S. 6 (1992)'), NULL FROM t")
def findings_separators(spark, d):
    docs = orders(spark, d).select(F.col("o_orderkey").alias("doc_id"), F.expr(_PAREN).alias("text"))
    occ = graph.occurrences(docs, surroundings=("gap", "near")).select("doc_id", "ord", "form", "start", "end", "gap_comma", "paren_gap", "paren_open").persist()
    return findings.citation_syntax(docs, occ).select("doc_id", "code", "start", "suggestion")


# Graph


@query(_with(_OCC + ", r AS (SELECT doc_id, ord, min(s) OVER (PARTITION BY doc_id, authority_id) AS first_s FROM occ WHERE form = 'full') SELECT doc_id, cast(ord AS BIGINT) AS ord, 'resource-' || dense_rank() OVER (PARTITION BY doc_id ORDER BY first_s) AS resource_id FROM r"))
def citation_resources(spark, d):
    return graph.resources(graph.occurrences(briefs(spark, d), surroundings=False))


@query("SELECT o_orderkey AS doc_id, 'hereinafter_definition' AS edge_type, '0' AS source, 'Title' || o_orderkey % 9 AS alias FROM orders")
def definition_edges(spark, d):
    docs = orders(spark, d).select(F.col("o_orderkey").alias("doc_id"), F.expr(_ALIAS_TEXT.replace('\\"', '"')).alias("text"))
    facts = graph.with_occurrences(docs)
    return resolve.definition_edges(facts, graph.occurrence_rows(facts)).select("doc_id", "edge_type", "source", "alias")


_TWO_NOTES = "concat('Body.[1] More.[2]', chr(10), chr(10), '[1] 1 U.S.C. § 2; 3 U.S.C. § 4.', chr(10), chr(10), '[2] 5 U.S.C. § ', cast(o_orderkey % 90 + 1 as string), CASE WHEN o_orderkey % 2 = 0 THEN '; 6 U.S.C. § 7; 8 U.S.C. § 9.' ELSE '.' END)"


@query("SELECT o_orderkey AS doc_id, 'same_footnote' AS edge_type, s AS source, t AS target FROM orders, (VALUES ('0', '1', false), ('2', '3', true), ('2', '4', true), ('3', '4', true)) v(s, t, long) WHERE NOT long OR o_orderkey % 2 = 0")
def same_footnote_edges(spark, d):
    docs = orders(spark, d).select(F.col("o_orderkey").alias("doc_id"), F.expr(_TWO_NOTES).alias("text"))
    return graph.note_edges(graph.occurrences(docs))


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN '12-15' END AS pincite, '1990' AS year, 'Doe' AS guess FROM orders")
def journal_details(spark, d):
    docs = orders(spark, d).select(F.col("o_orderkey").alias("doc_id"), F.expr("concat('Jane Doe, Some Title, 9 Harv. L. Rev. 100', CASE WHEN o_orderkey % 3 = 0 THEN ', 12-15' ELSE '' END, ' (1990). As Doe, supra, said.')").alias("text"))
    c = extract.citation_rows(docs)
    j = c.where("source_type = 'journal_article'").select("doc_id", F.col("components")["pincite"].alias("pincite"), F.col("components")["year"].alias("year"))
    return j.join(c.where("source_type = 'short_form'").select("doc_id", F.col("components")["antecedent_guess"].alias("guess")), "doc_id")


@query("SELECT o_orderkey AS doc_id, '1 U.S.C. § ' || o_orderkey AS text FROM orders")
def hereinafter_trim(spark, d):
    return _table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), extract.trim_hereinafter(F.concat(F.lit("1 U.S.C. § "), F.col("o_orderkey").cast("string"), F.lit(' (Hereinafter “the Act”) '))).alias("text"))


@query(_with(_ISSUES + "SELECT b.doc_id, count(suggestion) AS n_safe_auto_fix, 0::BIGINT AS n_suggested_fix, count(code) FILTER (suggestion IS NULL) AS n_review_required, 0::BIGINT AS n_unsupported FROM briefs b LEFT JOIN issues USING (doc_id) GROUP BY 1"))
def correction_histogram(spark, d):
    return lint.summary(briefs(spark, d)).select("doc_id", "n_safe_auto_fix", "n_suggested_fix", "n_review_required", "n_unsupported")


# More of texts: scans, contexts, blocks


_SCANNED = "CASE kind WHEN 'statute_bad' THEN t || ' U.S.C. § ' || b WHEN 'invisible' THEN t || chr(8203) || 'U.S.C.' || chr(8203) || ' § ' || b WHEN 'regulation_bad' THEN t || ' C.F.R. §  § ' || b ELSE cite END"


@query(_with(f"SELECT doc_id, string_agg(lead || {_SCANNED} || tail, '' ORDER BY ord) AS corrected_text, count(*) FILTER (kind = 'statute_bad') AS n_usc_abbreviation, count(*) FILTER (kind = 'regulation_bad') AS n_cfr_abbreviation, 0::BIGINT AS n_id_short_form, cast(sum(CASE kind WHEN 'statute_bad' THEN 1 WHEN 'invisible' THEN 1 WHEN 'regulation_bad' THEN 2 ELSE 0 END) AS BIGINT) AS n_section_spacing FROM segs GROUP BY doc_id"))
def risk_scan(spark, d):
    return context.risk_scan(briefs(spark, d)).select("doc_id", "corrected_text", "n_usc_abbreviation", "n_cfr_abbreviation", "n_id_short_form", "n_section_spacing")


_FOCUS = r"""WITH t AS (SELECT doc_id, text, length(text) AS n, length(text) // 2 AS fs, length(text) // 2 + 10 AS fe, string_split_regex(text, '\n[ \t]*\n') AS parts, regexp_extract_all(text, '\n[ \t]*\n') AS gaps FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
s AS (SELECT *, list_transform(range(1, len(parts) + 1), lambda i: length(parts[i]) + coalesce(length(gaps[i]), 0)) AS sizes FROM t),
e AS (SELECT *, list_transform(range(1, len(sizes) + 1), lambda i: list_sum(sizes[1:i])) AS ends FROM s),
f AS (SELECT *, len(list_filter(ends, lambda x: x <= fs)) + 1 AS i FROM e),
g AS (SELECT *, i > len(parts) AS nowhere, CASE WHEN i > 1 THEN ends[i - 1] ELSE 0 END AS ps, ends[i] AS pe, CASE WHEN i > 2 THEN ends[i - 2] ELSE 0 END AS ws, ends[least(i + 1, len(ends))] AS we FROM f),
h AS (SELECT *, fs - ps AS lead, greatest(pe - fe, 0) AS tail, greatest(2400 - (fe - fs), 0) AS room FROM g),
k AS (SELECT *, least(lead, room // 2 + greatest(0, room // 2 - tail)) AS a FROM h),
m AS (SELECT *, least(tail, room - a) AS b FROM k),
r AS (SELECT *, CASE WHEN n <= 2400 OR nowhere THEN n WHEN we - ws <= 2400 THEN we - ws ELSE least(fe + b, n) - (fs - a) END AS kept FROM m),
z AS (SELECT *, n <= 2400 OR nowhere OR n - kept < 0.12 * n AS bypass FROM r)
SELECT doc_id, CASE WHEN bypass THEN 'bypass' WHEN we - ws <= 2400 THEN 'neighbours' ELSE 'cut' END AS strategy, cast(CASE WHEN bypass THEN 0 ELSE n - kept END AS BIGINT) AS saved_chars, cast(CASE WHEN bypass THEN n ELSE kept END AS BIGINT) AS n FROM z"""


@query(_FOCUS)
def focus_context(spark, d):
    texts = _table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = texts.select("doc_id", "text", F.floor(F.length("text") / 2).cast("int").alias("focus_start"), (F.floor(F.length("text") / 2) + 10).cast("int").alias("focus_end"))
    return reduce.focus_context(docs).select("doc_id", "strategy", "saved_chars", F.length("context").alias("n"))


@query(f"SELECT doc_id, sha256({_NORMAL.format('text')}) AS normal, sha256({_PLAIN.format(_NORMAL.format('text'))}) AS plain FROM documents")
def normalized_texts(spark, d):
    t = F.col("text")
    return _table(spark, d, "documents").select("doc_id", F.sha2(retrieval.normalize_text(t), 256).alias("normal"), F.sha2(retrieval.comparison_text(t), 256).alias("plain"))


_CLAIM = "concat('Alpha is one. Beta two! He said “quote number ', o_orderkey, '” and “second quote ', o_custkey, '” then “a third one here” and “the fourth of them”. Gamma ', o_orderkey, ' is three ')"


@query(f"SELECT o_orderkey, 'Gamma ' || o_orderkey || ' is three' AS proposition, 'second quote ' || o_custkey || '|a third one here|the fourth of them' AS quotes FROM orders")
def claims_before_citations(spark, d):
    docs = _table(spark, d, "orders").select("o_orderkey", F.expr(_CLAIM).alias("t"))
    at = F.length("t")
    return docs.select("o_orderkey", retrieval.proposition(F.col("t"), at).alias("proposition"), F.array_join(retrieval.nearby_quotes(F.col("t"), at), "|").alias("quotes"))


@query("SELECT o_orderkey AS id, 1::BIGINT AS rank, 'Beta ' || o_custkey || ' holds the office of keeper.' AS passage, 100::BIGINT AS score FROM orders")
def passage_ranking(spark, d):
    words = "alpha " * 80
    rows = orders(spark, d).select(F.col("o_orderkey").alias("id"), F.concat(F.lit("Beta "), F.col("o_custkey"), F.lit(" holds the office of keeper.")).alias("proposition"), F.concat(F.lit(f"Long {words}ends. "), F.lit(f"More {words}ends. "), F.lit("Beta "), F.col("o_custkey"), F.lit(" holds the office of keeper.")).alias("source"))
    ranked = evidence.rank_passages(rows, 1)
    return ranked.select("id", "rank", "passage", F.round(F.col("combined_score") * 100).cast("long").alias("score"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'normalized' ELSE 'not_supplied' END AS quotation_status, CASE o_orderkey % 2 WHEN 0 THEN 'confirmed_by_page_marker' ELSE 'not_supplied' END AS pincite_status, 'not_determined' AS conclusion FROM orders")
def case_evidence(spark, d):
    k = F.col("o_orderkey")
    said = F.when(k % 3 == 0, "It said “the court must hear them”. So ").when(k % 3 == 1, "It said “The court, must hear them”. So ").otherwise("It said nothing. So ")
    cites = _table(spark, d, "orders").select(k.alias("id"), said.alias("document"), F.length(said).alias("start"), F.when(k % 2 == 0, "7").alias("pincite"), (k % 4).alias("source_id"))
    sources = spark.createDataFrame([(i, "[7] In any case the court must hear them. Page 8 follows.") for i in range(4)], "source_id long, source_text string")
    return evidence.case_evidence(cites, sources).select("id", "quotation_status", "pincite_status", "conclusion")


_PROTECTED = "concat('Alpha beta ', o_orderkey % 400 + 10, ' U.S. ', o_custkey % 900 + 10, ' gamma delta omega supra end')"


@query("WITH t AS (SELECT o_orderkey AS doc_id, length(cast(o_orderkey % 400 + 10 AS VARCHAR) || ' U.S. ' || cast(o_custkey % 900 + 10 AS VARCHAR)) AS n FROM orders) SELECT doc_id, 11 AS start, cast(11 + n AS BIGINT) AS \"end\", 'page_marker+case_citation' AS reason FROM t UNION ALL SELECT doc_id, 11 + n + length(' gamma delta omega '), 11 + n + length(' gamma delta omega supra'), 'short_form' FROM t")
def protected_spans(spark, d):
    docs = _table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.expr(_PROTECTED).alias("t"))
    rows = docs.select("doc_id", F.explode(context.protected_ranges(F.col("t"))).alias("r"))
    return rows.select("doc_id", "r.start", "r.end", "r.reason")


@query("SELECT o_orderkey AS doc_id, pos::BIGINT AS pos, CASE WHEN o_orderkey % 2 = 0 THEN CASE pos WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 2 END ELSE CASE pos WHEN 0 THEN 1 WHEN 1 THEN 0 END END::BIGINT AS ix, pos = 0 AS matched FROM orders, (VALUES (0), (1), (2)) v(pos)")
def aligned_authorities(spark, d):
    o = _table(spark, d, "orders")
    cites = o.select(F.col("o_orderkey").alias("doc_id"), F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(t).alias("text")) for i, t in enumerate(("See 5 U.S. 6", "nothing", "none"))])).alias("c")).select("doc_id", "c.*")
    rows = [F.struct(F.lit(i).alias("ix"), F.array(F.lit(v)).alias("variants")) for i, v in enumerate(("1 U.S. 2", "5 u.s. 6", "x"))]
    known = o.select(F.col("o_orderkey").alias("doc_id"), F.explode(F.when(F.col("o_orderkey") % 2 == 0, F.array(*rows)).otherwise(F.array(*rows[:2]))).alias("a")).select("doc_id", "a.*")
    return context.align_authorities(cites, known).select("doc_id", "pos", "ix", "matched")


_UNRESOLVED = "concat('Id. at ', o_orderkey % 90 + 1, ' says so.', chr(10), 'Baxter, 5 U.S. at ', o_custkey % 90 + 1, ' agrees.', chr(10), 'Ortiz, supra, differs.')"


@query("SELECT o_orderkey AS doc_id, code, family, 'error' AS severity, 'review_required' AS correction_level, 'whitepages' AS mode FROM orders, (VALUES ('ID_AMBIGUOUS_ANTECEDENT', 'short forms: Id.'), ('SHORT_CASE_UNRESOLVED', 'short forms: cases'), ('SUPRA_AMBIGUOUS_ANTECEDENT', 'supra and hereinafter')) v(code, family)")
def document_findings(spark, d):
    docs = orders(spark, d).select(F.col("o_orderkey").alias("doc_id"), F.expr(_UNRESOLVED).alias("text"))
    facts = graph.with_occurrences(docs)
    occ = graph.occurrence_rows(facts).persist()
    found = findings.findings(docs, occ, resolve.resolutions(occ, resolve.alias_targets(facts, occ)), "whitepages")
    return found.select("doc_id", "code", "family", "severity", "correction_level", "mode")


@query(_with(f"SELECT doc_id, 'INTERNET_ARCHIVE_REVIEW' AS code, {_AT}, 'Rule 18' AS rule FROM cites WHERE kind = 'internet'"))
def lint_whitepages(spark, d):
    return lint.issue_rows(briefs(spark, d), "whitepages").where("code = 'INTERNET_ARCHIVE_REVIEW'").select("doc_id", "code", "start", "end", "rule")


@query(r"SELECT o_orderkey AS doc_id, ord::BIGINT AS ord, kind, CASE ord WHEN 0 THEN 'Head ' || o_orderkey WHEN 1 THEN 'A claim.[^a] More [site](https://x.org/' || o_orderkey || ') here.' WHEN 2 THEN 'https://x.org/' || o_orderkey WHEN 3 THEN 'quoted ' || o_custkey ELSE 'The note ' || o_orderkey END AS text, CASE WHEN ord = 4 THEN '1' END AS note_number FROM orders, (VALUES (0, 'heading'), (1, 'paragraph'), (2, 'hyperlink'), (3, 'block_quotation'), (4, 'footnote')) v(ord, kind)")
def markdown_blocks(spark, d):
    text = r"concat('# Head ', o_orderkey, '\n\nA claim.[^a] More [site](https://x.org/', o_orderkey, ') here.\n\n> quoted ', o_custkey, '\n\n[^a]: The note ', o_orderkey, '\n')"
    docs = orders(spark, d).select(F.col("o_orderkey").alias("doc_id"), F.expr(text).alias("text"))
    return blocks.markdown_rows(docs).select("doc_id", "ord", "kind", "text", "note_number")


_SENT = "concat('First one here. Second cites 42 U.S.C. § 5 there! It said “quoted ', o_orderkey, ' words” last.')"


@query("SELECT o_orderkey AS doc_id, text, has_citation FROM orders, LATERAL (SELECT 'First one here.' AS text, false AS has_citation UNION ALL SELECT 'Second cites 42 U.S.C.', true UNION ALL SELECT '§ 5 there!', false UNION ALL SELECT 'It said “quoted ' || o_orderkey || ' words” last.', false)")
def block_sentences(spark, d):
    docs = orders(spark, d).select(F.col("o_orderkey").alias("doc_id"), F.expr(_SENT).alias("text"))
    return blocks.sentence_rows(docs).select("doc_id", "text", "has_citation")


@query("SELECT o_orderkey AS doc_id, 58 AS start, cast(58 + length('“quoted ' || o_orderkey || ' words”') AS BIGINT) AS \"end\" FROM orders")
def block_quotations(spark, d):
    docs = orders(spark, d).select(F.col("o_orderkey").alias("doc_id"), F.expr(_SENT).alias("text"))
    return blocks.quotation_rows(docs).select("doc_id", "start", "end")


_MADE = {
    "journal_article": ({"author": "A. Doe", "title": "Some <Title>", "volume": "9", "journal": "Harv. L. Rev.", "first_page": "100", "pincite": "12", "year": "1990"}, "A. Doe, Some &lt;Title&gt;, 9 Harv. L. Rev. 100, 12 (1990)"),
    "regulation": ({"title": "8", "code": "cfr", "section": "§ 5.1", "year": "2020"}, "8 C.F.R. § 5.1 (2020)"),
    "constitution": ({"constitution": "U.S. Const.", "subdivision": "amend. XIV"}, "U.S. Const. amend. XIV"),
    "case": ({"case_name": "A v. B", "volume": "1", "reporter": "us", "first_page": "2", "year": "1990", "court": "9th Cir."}, "<i>A v. B</i>, 1 U.S. 2 (9th Cir. 1990)"),
}


@query("SELECT o_orderkey, kind, citation, status FROM orders, (VALUES " + ", ".join(f"('{k}', {_quoted(c)}, 'ok')" for k, (_, c) in _MADE.items()) + ", ('internet', NULL, 'missing_facts'), ('nonsense', NULL, 'unsupported_source_type')) v(kind, citation, status)")
def generated_html(spark, d):
    fields = {k: v for k, (v, _) in _MADE.items()} | {"internet": {"title": "T"}, "nonsense": {"title": "T"}}
    made = spark.createDataFrame([(k, v) for k, v in fields.items()], "kind string, fields map<string,string>")
    rows = _table(spark, d, "orders").select("o_orderkey").join(F.broadcast(made))
    return formats.generate(rows, type_col="kind", style="html").select("o_orderkey", "kind", "citation", "status")


@query("SELECT o_orderkey, CASE k WHEN 1 THEN 'markdown' WHEN 3 THEN 'pdf' WHEN 4 THEN NULL ELSE 'text' END AS source_format, CASE k WHEN 0 THEN 'plain ' || o_orderkey WHEN 1 THEN '# head' END AS text, CASE k WHEN 2 THEN 'empty_document' WHEN 3 THEN 'ocr_required' WHEN 4 THEN 'unsupported_document_type' WHEN 5 THEN 'invalid_text_encoding' END AS error_code FROM (SELECT o_orderkey, o_orderkey % 6 AS k FROM orders)")
def uploaded_files(spark, d):
    k = F.col("o_orderkey") % 6
    name = F.when(k == 0, "a.TXT").when(k == 1, "b.bin").when(k == 2, "c.txt").when(k == 3, "d.pdf").when(k == 4, "e.exe").otherwise("f.txt")
    data = F.when(k == 0, F.base64(F.encode(F.concat(F.lit("﻿plain "), F.col("o_orderkey")), "UTF-8"))).when(k == 1, F.base64(F.encode(F.lit("# head"), "UTF-8"))).when(k == 2, F.lit("")).when(k == 5, F.base64(F.unhex(F.lit("ff00fe")))).otherwise(F.base64(F.encode(F.lit("x"), "UTF-8")))
    rows = _table(spark, d, "orders").select("o_orderkey", name.alias("name"), F.when(k == 1, "text/markdown; charset=utf-8").alias("mime_type"), data.alias("data"))
    rows = files.from_base64(rows).withColumn("filename", F.concat(F.col("o_orderkey").cast("string"), F.lit("-"), F.col("name")))
    return files.load_documents(rows).select(F.split("filename", "-")[0].cast("long").alias("o_orderkey"), "source_format", "text", "error_code")


@query("SELECT p_partkey FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 3 <> 0 AND p_partkey % 5 NOT IN (0, 1)")
def rule_sources(spark, d):
    k = F.col("p_partkey")
    rows = _table(spark, d, "part").select(k, (k % 2 == 0).alias("included"), (k % 3 != 0).alias("redistribution_allowed"), F.when(k % 5 == 0, " Proprietary ").when(k % 5 != 1, "CC0").alias("license"))
    return files.rule_library(rows).select("p_partkey")


@query("SELECT o_orderkey, o_orderkey % 3 = 0 AS verified, o_orderkey % 3 = 1 AS ambiguous, CASE WHEN o_orderkey % 3 = 2 THEN '' ELSE 'A v. B|C v. D' END AS case_names, CASE WHEN o_orderkey % 3 = 2 THEN '' ELSE 'https://b.org/op/' || o_orderkey || '|https://x.org/y' END AS urls FROM orders")
def verification_results(spark, d):
    k = F.col("o_orderkey")
    one = lambda n, u: F.struct(F.lit(n).alias("case_name"), u.alias("absolute_url"))
    many = F.array(one("C v. D", F.lit("https://x.org/y")), one("A v. B", F.concat(F.lit("op/"), k)), one("C v. D", F.concat(F.lit("/op/"), k)), one("", F.lit(None).cast("string")))
    rows = _table(spark, d, "orders").select(k, F.when(k % 3 == 0, 200).when(k % 3 == 1, 300).otherwise(404).alias("status"), F.when(k % 3 != 2, many).alias("clusters"))
    return evaluate.verification_results(rows, "https://b.org").select("o_orderkey", "verified", "ambiguous", F.array_join("case_names", "|").alias("case_names"), F.array_join("urls", "|").alias("urls"))


@query("SELECT o_custkey AS key FROM (SELECT o_custkey, max(o_orderdate) AS t FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' - INTERVAL 4000 DAY GROUP BY 1) ORDER BY t DESC, o_custkey LIMIT 32")
def cached_lookups(spark, d):
    rows = _table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderdate").cast("timestamp").alias("fetched_at"))
    return context.lookup_cache(rows, F.lit("1998-01-01").cast("timestamp"), 4000 * 86_400).select("key")


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 4 = 0 THEN 'whitepages' ELSE 'bluepages' END AS mode FROM orders")
def academic_mode(spark, d):
    text = F.when(F.col("o_orderkey") % 4 == 0, "By Jane Doe\n\nThis article is for a law review.").otherwise("The plaintiff filed a motion in the district court.")
    return modes.document_mode(_table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))).select("doc_id", "mode")


# A wider grammar than the briefs': state reporters and codes, dates, years behind names


_V, _PG, _YR = "o_orderkey % 400 + 10", "o_custkey % 900 + 10", "1950 + o_orderkey % 60"
_REP = "CASE o_orderkey % 5 WHEN 0 THEN 'Cal. App. 4th' WHEN 1 THEN 'N.E.2d' WHEN 2 THEN 'So. 3d' WHEN 3 THEN 'Mass.' ELSE 'F. Supp. 2d' END"
_STATE_CASE = f"concat('As held, Smith & Sons v. Board of Trade, ', {_V}, ' ', {_REP}, ' ', {_PG}, CASE WHEN o_orderkey % 2 = 0 THEN concat(', ', {_PG} + 3) ELSE '' END, CASE o_orderkey % 3 WHEN 0 THEN concat(' (', {_YR}, ')') WHEN 1 THEN concat(' (9th Cir. ', {_YR}, ')') ELSE concat(' (June 24, ', {_YR}, ')') END, '. So it is.')"


@query(f"SELECT o_orderkey AS doc_id, 'Smith & Sons v. Board of Trade' AS case_name, cast({_V} AS VARCHAR) AS volume, {_REP} AS reporter, cast({_PG} AS VARCHAR) AS first_page, CASE WHEN o_orderkey % 2 = 0 THEN cast({_PG} + 3 AS VARCHAR) END AS pincite, CASE o_orderkey % 3 WHEN 2 THEN NULL ELSE cast({_YR} AS VARCHAR) END AS year, CASE o_orderkey % 3 WHEN 2 THEN cast({_YR} AS VARCHAR) END AS date_year, CASE o_orderkey % 3 WHEN 1 THEN '9th Cir.' END AS court FROM orders")
def extract_reported_cases(spark, d):
    docs = orders(spark, d).select(F.col("o_orderkey").alias("doc_id"), F.expr(_STATE_CASE).alias("text"))
    c = extract.citation_rows(docs).where("source_type = 'case'")
    return c.select("doc_id", *[F.col("components")[n].alias(n) for n in ("case_name", "volume", "reporter", "first_page", "pincite", "year", "date_year", "court")])


_STATE_LAW = f"concat('Under ', CASE o_orderkey % 3 WHEN 0 THEN 'Cal. Penal Code' WHEN 1 THEN 'N.Y. Gen. Laws' ELSE 'Tex. Stat. Ann.' END, CASE WHEN o_orderkey % 3 = 1 THEN concat(' ch. ', o_custkey % 90 + 1, ',') ELSE '' END, ' § ', {_V}, '.', {_PG}, CASE WHEN o_orderkey % 2 = 0 THEN concat(' (', {_YR}, ')') ELSE '' END, ' it is so.')"


@query(f"SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 'Cal. Penal Code' WHEN 1 THEN 'N.Y. Gen. Laws' ELSE 'Tex. Stat. Ann.' END AS code, CASE WHEN o_orderkey % 3 = 1 THEN cast(o_custkey % 90 + 1 AS VARCHAR) END AS chapter, ({_V}) || '.' || ({_PG}) AS section, CASE WHEN o_orderkey % 2 = 0 THEN cast({_YR} AS VARCHAR) END AS edition FROM orders")
def extract_state_statutes(spark, d):
    docs = orders(spark, d).select(F.col("o_orderkey").alias("doc_id"), F.expr(_STATE_LAW).alias("text"))
    c = extract.citation_rows(docs).where("source_type = 'statute'")
    return c.select("doc_id", *[F.col("components")[n].alias(n) for n in ("code", "chapter", "section", "edition")])


@query("SELECT o_orderkey AS doc_id, 'Doe v. Roe' AS case_name, cast(1950 + o_orderkey % 60 AS VARCHAR) AS inline_year, 'Cal. 4th' AS reporter FROM orders")
def extract_inline_years(spark, d):
    text = F.expr("concat('See Doe v. Roe (', 1950 + o_orderkey % 60, ') 5 Cal. 4th 100.')")
    c = extract.citation_rows(orders(spark, d).select(F.col("o_orderkey").alias("doc_id"), text.alias("text")))
    return c.where("source_type = 'case'").select("doc_id", *[F.col("components")[n].alias(n) for n in ("case_name", "inline_year", "reporter")])


_RULES = ", ".join([*[f"('{r[0]}', 'lint', '{r[4]}')" for r in tables.LINT_RULES], *[f"('{r[0]}', 'finding', '{r[2]}')" for r in tables.FINDING_RULES]])


@query(_with(_ISSUES + f"""SELECT code, kind, severity, coalesce(n, 0) AS n_issues FROM (VALUES {_RULES}) t(code, kind, severity)
LEFT JOIN (SELECT code, count(*) AS n FROM issues GROUP BY 1) USING (code)"""))
def explained_rules(spark, d):
    """Every rule, with the issues that it has in the briefs."""
    had = lint.issue_rows(briefs(spark, d)).groupBy("code").agg(F.count("*").alias("n"))
    return tables.explained_rules(spark).join(had, "code", "left").select("code", "kind", "severity", F.coalesce("n", F.lit(0)).alias("n_issues"))


@query("SELECT o_orderkey AS doc_id, 4::BIGINT AS blocks, 2::BIGINT AS paragraphs, 2::BIGINT AS footnotes, 3::BIGINT AS \"references\", cast(length('Body.[1] More.[2]' || chr(10) || chr(10) || 'Next ' || o_orderkey || '.[1]' || chr(10) || chr(10) || '[1] One.' || chr(10) || chr(10) || '[2] Two.') AS BIGINT) AS characters FROM orders")
def document_outline(spark, d):
    text = F.expr(r"concat('Body.[1] More.[2]\n\nNext ', o_orderkey, '.[1]\n\n[1] One.\n\n[2] Two.')")
    return blocks.outline(orders(spark, d).select(F.col("o_orderkey").alias("doc_id"), text.alias("text")))
