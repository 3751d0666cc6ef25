"""Evaluation of whole systems: rates of predictions, gold tasks, real documents, release gates and ablations.

Everything is sums over one row per document or task; sets of labels are arrays in
the row, so corpus totals are sums of their sizes and nothing is exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import FINDING_RULES
from . import evidence, lint
from .evaluate import label_scores
from .extract import with_citations

# The metrics of a system evaluation, and the systems that are compared.
METRICS = (
    "citation_span_precision", "citation_span_recall", "citation_span_f1", "source_type_accuracy", "document_mode_accuracy", "authority_identity_accuracy", "short_form_antecedent_accuracy", "ambiguity_detection_recall",
    "issue_precision_by_family", "issue_recall_by_family", "safe_fix_precision", "unsafe_automatic_edit_count", "unsupported_fact_introduction_count", "abstention_precision", "abstention_recall", "retrieval_recall_at_k",
    "reranker_accuracy", "explanation_faithfulness", "latency_ms", "peak_memory_mb", "cpu_performance", "gpu_performance",
)
#: name, needs a language model, retrieval, a reranker, a tagger, an embedding scorer.
ABLATIONS = (
    ("deterministic_only", False, False, False, False, False),
    ("deterministic_qwen", True, False, False, False, False),
    ("deterministic_retrieval", False, True, False, False, False),
    ("deterministic_qwen_retrieval", True, True, False, False, False),
    ("deterministic_qwen_retrieval_reranker", True, True, True, False, False),
    ("experimental_gliner", False, False, False, True, False),
    ("deterministic_hybrid_passage_scorer", False, False, False, False, True),
)
FAMILIES = tuple(dict.fromkeys(r[1] for r in FINDING_RULES))
#: Descriptive features of old evaluation rows, and the families they stand for.
FEATURE_FAMILIES = (
    (("invalid Id.", "ambiguous antecedent"), "short forms: Id."),
    (("invalid short case",), "short forms: cases"),
    (("invalid supra note", "supra"), "supra and hereinafter"),
    (("signal",), "signals"),
    (("quotation", "missing pincite"), "pincites and quotations"),
    (("archive review",), "internet sources"),
)


def _size(a: Column) -> Column:
    return F.coalesce(F.size(F.array_distinct(a)), F.lit(0))


def _shared(a: Column, b: Column) -> Column:
    return F.coalesce(F.size(F.array_intersect(a, b)), F.lit(0))


def rates(hit: Column, expected: Column, actual: Column, strict: bool = False) -> Column:
    """struct<precision,recall,f1> from three counts.

    Of an empty side, the other side decides (1 if both are empty, else 0); with ``strict`` precision
    without anything found is 0 unless nothing was expected, and recall without anything expected is 1.
    """
    empty_p = F.when((expected == 0) & (actual == 0), 1.0).otherwise(0.0) if strict else (expected == 0).cast("double")
    empty_r = F.lit(1.0) if strict else (actual == 0).cast("double")
    p, r = F.when(actual > 0, hit / actual).otherwise(empty_p), F.when(expected > 0, hit / expected).otherwise(empty_r)
    return F.struct(p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def set_rates(expected: Column, actual: Column, strict: bool = False) -> Column:
    """``rates`` of two arrays taken as sets; null is the empty set."""
    return rates(_shared(expected, actual), _size(expected), _size(actual), strict)


def ratio(a: Column, b: Column) -> Column:
    """a / b to six places, 0 if there is nothing."""
    return F.coalesce(F.round(F.try_divide(a.cast("double"), b), 6), F.lit(0.0))


def macro_f1(rows: DataFrame, expected: str, predicted: str) -> DataFrame:
    """One row: the mean F1 over the labels of either side, each step to six places."""
    s = label_scores(rows, expected, predicted).select("label", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("p"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("r"))
    return s.agg(F.coalesce(F.round(F.avg(ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r"))), 6), F.lit(0.0)).alias("macro_f1"))


def prediction_rates(rows: DataFrame) -> DataFrame:
    """One row of eight rates. ``rows``: valid_json, unsupported_facts, unsafe_applied, and structs expected and predicted
    (start, end, issue_code, proposed_citation); a null code counts as INVALID, a null citation as an abstention."""
    e, p, n = F.col("expected"), F.col("predicted"), F.count("*")
    flag = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    none_e, none_p = e["proposed_citation"].isNull(), p["proposed_citation"].isNull()
    same = e["start"].eqNullSafe(p["start"]) & e["end"].eqNullSafe(p["end"])
    hit = F.coalesce(e["proposed_citation"] == p["proposed_citation"], F.lit(False))
    out = rows.agg(
        ratio(flag("valid_json"), n).alias("valid_json_rate"), ratio(F.count_if(same), n).alias("citation_span_accuracy"),
        ratio(F.count_if(hit), F.count_if(~none_e)).alias("exact_correction_accuracy"),
        ratio(F.count_if(none_e & none_p), F.count_if(none_p)).alias("abstention_precision"), ratio(F.count_if(none_e & none_p), F.count_if(none_e)).alias("abstention_recall"),
        ratio(flag("unsupported_facts"), n).alias("hallucinated_fact_rate"), ratio(flag("unsafe_applied"), n).alias("unsafe_auto_apply_rate"),
    )
    label = lambda c: F.coalesce(F.nullif(c["issue_code"], F.lit("")), F.lit("INVALID"))
    macro = macro_f1(rows.select(label(e).alias("g"), label(p).alias("f")), "g", "f")
    return out.withColumn("issue_classification_macro_f1", macro.scalar())


def safety_rows(validated: DataFrame) -> DataFrame:
    """``validated`` (see proposals, with ``expected_valid``) with ``passed`` and ``unsafe_acceptance``; the gate is that all pass and none is unsafe."""
    p = F.col("proposal")
    unsafe = ~F.col("expected_valid") & F.col("valid") & (p["confidence"] == "high") & p["proposed_citation"].isNotNull()
    return validated.withColumns({"passed": F.col("valid") == F.col("expected_valid"), "unsafe_acceptance": F.coalesce(unsafe, F.lit(False))})


def gold_rows(gold: DataFrame) -> DataFrame:
    """``gold`` (id, task, mode, input, expected, expected_source_types, quote, source, expected_statuses, proposition, expected_contains) as id, task, passed.

    fix: equal texts; extract: equal lists of source types in order; quote: the status is one of the expected;
    rank: the best passage holds the text, in any case. An unknown task does not pass.
    """
    out = []
    for mode in ("bluepages", "whitepages"):
        same = F.coalesce(F.col("mode"), F.lit("bluepages")) == mode
        fixes = gold.where((F.col("task") == "fix") & same).withColumn("text", F.col("input"))
        out.append(lint.fix(fixes, mode).select("id", "task", F.coalesce(F.col("fixed_text") == F.col("expected"), F.lit(False)).alias("passed")))
    found = with_citations(gold.where("task = 'extract'").withColumn("text", F.col("input")))
    kinds = F.transform("citations", lambda c: c["source_type"])
    out.append(found.select("id", "task", (kinds == F.coalesce("expected_source_types", F.array().cast("array<string>"))).alias("passed")))
    quotes = gold.where("task = 'quote'")
    out.append(evidence.match_quotes(quotes).select("id", "status").join(quotes.select("id", "task", "expected_statuses"), "id").select("id", "task", F.array_contains("expected_statuses", F.col("status")).alias("passed")))
    ranks = gold.where("task = 'rank'")
    best = evidence.rank_passages(ranks.select("id", "proposition", "source"), 1).select("id", "passage")
    out.append(ranks.join(best, "id", "left").select("id", "task", F.contains(F.lower(F.coalesce("passage", F.lit(""))), F.lower("expected_contains")).alias("passed")))
    rest = gold.where(~F.coalesce(F.col("task").isin("fix", "extract", "quote", "rank"), F.lit(False)))
    out.append(rest.select("id", F.coalesce("task", F.lit("unknown")).alias("task"), F.lit(False).alias("passed")))
    whole = out[0]
    for df in out[1:]:
        whole = whole.unionByName(df)
    return whole


def task_accuracy(rows: DataFrame) -> DataFrame:
    """task, total, passed, accuracy (four places), and a row with task null for all tasks together."""
    out = rows.groupingSets([["task"], []], "task").agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"))
    return out.select("task", "total", "passed", F.coalesce(F.round(F.try_divide(F.col("passed").cast("double"), F.col("total")), 4), F.lit(0.0)).alias("accuracy"))


def expected_families(explicit: Column, features: Column) -> Column:
    """The expected issue families: the explicit ones, or (if null) those the features stand for."""
    said = [F.when(F.arrays_overlap(features, F.array(*[F.lit(x) for x in words])), F.lit(family)) for words, family in FEATURE_FAMILIES]
    return F.coalesce(explicit, F.filter(F.array(*said), lambda x: x.isNotNull()))


def adds_facts(original: Column, suggestion: Column) -> Column:
    """Does an edit bring in content that the original lacks; what only changes form (equal letters and digits) does not."""
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    tokens = lambda c: F.regexp_extract_all(F.replace(F.lower(c), F.lit("."), F.lit("")), F.lit("[a-z0-9]+"), F.lit(0))
    return (bare(suggestion) != bare(original)) & (F.size(F.array_except(tokens(suggestion), tokens(original))) > 0)


def system_metrics(rows: DataFrame) -> DataFrame:
    """One row: METRICS and the counts that the gates need, over one row per document:

    mode_expected, mode_actual; expected, actual (array<struct<text,source_type>>); n_authorities; expected_ambiguous, n_ambiguous, n_guesses;
    expected_families, actual_families; safe_fixed_text (null: not given), corrected_text; edits
    (array<struct<start,end,original,suggestion,correction_level>>), ranges (array<struct<start,end>> of citations);
    n_chunks, n_faithful (null: retrieval not run); latency_ms. What was not measured is null.
    """
    texts = lambda c: F.array_distinct(F.transform(F.col(c), lambda x: x["text"]))
    last = lambda c: F.map_from_entries(F.transform(texts(c), lambda t: F.struct(t, F.element_at(F.filter(F.col(c), lambda x: x["text"] == t), -1)["source_type"])))
    df = rows.withColumns({"e": last("expected"), "a": last("actual")})
    both = F.array_intersect(F.map_keys("e"), F.map_keys("a"))
    full = F.size(F.filter(F.map_values("e"), lambda x: x != "short_form"))
    count = lambda test: F.coalesce(F.size(F.filter("edits", test)), F.lit(0))
    outside = lambda x: ~F.exists("ranges", lambda r: (x["start"] < r["end"]) & (r["start"] < x["end"]))
    per = df.select(
        F.size("e").alias("ne"), F.size("a").alias("na"), F.size(both).alias("hit"), F.size(F.filter(both, lambda t: F.element_at("e", t) == F.element_at("a", t))).alias("typed"),
        (F.col("mode_expected") == F.col("mode_actual")).cast("int").alias("mode"), (full == F.col("n_authorities")).cast("int").alias("authority"),
        F.col("expected_ambiguous").alias("we"), F.col("n_ambiguous").alias("wa"), F.least("expected_ambiguous", "n_ambiguous").alias("wh"), F.col("n_guesses").alias("guesses"),
        _size(F.col("expected_families")).alias("fe"), _size(F.col("actual_families")).alias("fa"), _shared(F.col("expected_families"), F.col("actual_families")).alias("fh"),
        F.col("safe_fixed_text").isNotNull().cast("int").alias("sn"), F.coalesce(F.col("safe_fixed_text") == F.col("corrected_text"), F.lit(False)).cast("int").alias("sh"),
        count(lambda x: x["correction_level"] != "safe_auto_fix").alias("unsafe"), count(lambda x: adds_facts(x["original"], x["suggestion"])).alias("facts"), count(outside).alias("prose"),
        F.when(F.col("n_chunks").isNotNull() & (_size(F.col("expected_families")) > 0), F.col("n_chunks")).alias("chunks"), F.col("n_faithful").alias("faithful"), F.col("latency_ms").alias("latency"),
    )
    s, n = (lambda c: F.coalesce(F.sum(c), F.lit(0))), F.count("*")
    got = per.agg(
        *[s(c).alias(c) for c in ("ne", "na", "hit", "typed", "mode", "authority", "we", "wa", "wh", "guesses", "fe", "fa", "fh", "sn", "sh", "unsafe", "facts", "prose")],
        n.alias("n"), F.count("chunks").alias("rn"), F.count_if(F.col("chunks") > 0).alias("rh"), s("chunks").alias("xn"), s(F.when(F.col("chunks").isNotNull(), F.col("faithful"))).alias("xh"), F.avg("latency").alias("latency_ms"),
    )
    c = F.col
    part = lambda a, b, empty: F.when(c(b) > 0, c(a) / c(b)).otherwise(F.lit(empty) if isinstance(empty, float) else empty)
    span, issue = rates(c("hit"), c("ne"), c("na")), rates(c("fh"), c("fe"), c("fa"))
    ambiguous_r, ambiguous_p = part("wh", "we", (c("wa") == 0).cast("double")), part("wh", "wa", (c("we") == 0).cast("double"))
    none = F.lit(None).cast("double")
    return got.select(
        span["precision"].alias("citation_span_precision"), span["recall"].alias("citation_span_recall"), span["f1"].alias("citation_span_f1"), part("typed", "hit", 1.0).alias("source_type_accuracy"),
        part("mode", "n", 0.0).alias("document_mode_accuracy"), part("authority", "n", 1.0).alias("authority_identity_accuracy"), ambiguous_r.alias("short_form_antecedent_accuracy"), ambiguous_r.alias("ambiguity_detection_recall"),
        issue["precision"].alias("issue_precision_by_family"), issue["recall"].alias("issue_recall_by_family"), part("sh", "sn", 1.0).alias("safe_fix_precision"), c("unsafe").alias("unsafe_automatic_edit_count"),
        c("facts").alias("unsupported_fact_introduction_count"), ambiguous_p.alias("abstention_precision"), ambiguous_r.alias("abstention_recall"), part("rh", "rn", 1.0).alias("retrieval_recall_at_k"), none.alias("reranker_accuracy"),
        part("xh", "xn", 1.0).alias("explanation_faithfulness"), F.coalesce("latency_ms", F.lit(0.0)).alias("latency_ms"), none.alias("peak_memory_mb"), none.alias("cpu_performance"), none.alias("gpu_performance"),
        c("prose").alias("noncitation_prose_modification_count"), c("guesses").alias("unresolved_antecedent_guess_count"), c("n").alias("document_count"),
    )


def release_gates(metrics: DataFrame, network_calls: int = 0, reproducible: bool = True) -> DataFrame:
    """``metrics`` (see ``system_metrics``) as seven gates and ``passed``."""
    zero = lambda c: F.col(c) == 0
    gates = {
        "safe_fix_precision_at_least_0_99": F.col("safe_fix_precision") >= 0.99, "zero_unsafe_automatic_edits": zero("unsafe_automatic_edit_count"), "zero_unsupported_fact_introductions": zero("unsupported_fact_introduction_count"),
        "zero_noncitation_prose_modifications": zero("noncitation_prose_modification_count"), "zero_unresolved_antecedent_guesses": zero("unresolved_antecedent_guess_count"),
        "zero_local_mode_network_calls": F.lit(network_calls == 0), "reproducible_results": F.lit(reproducible),
    }
    out = metrics.select(*[g.alias(n) for n, g in gates.items()])
    passed = F.lit(True)
    for n in gates:
        passed = passed & F.col(n)
    return out.withColumn("passed", passed)


def failure_taxonomy(metrics: DataFrame, proposal_accuracy: float | None = None, keep: list[str] | None = None) -> DataFrame:
    """A row per row of metrics: the columns ``keep``, failures (class, owner), retraining_recommended (only for measured failures of proposals)."""
    bad = proposal_accuracy is not None and proposal_accuracy < 0.95
    row = lambda kind, owner: F.struct(F.lit(kind).alias("class"), F.lit(owner).alias("owner"))
    found = F.filter(F.array(
        F.when(F.col("citation_span_f1") < 0.99, row("document_structure_or_parsing", "deterministic_engine")),
        F.when(F.col("authority_identity_accuracy") < 0.99, row("authority_identity", "citation_graph")),
        F.when(F.col("retrieval_recall_at_k") < 0.95, row("retrieval", "reference_library")),
        F.when(F.lit(bad), row("proposal_generation", "qwen_adapter")),
    ), lambda x: x.isNotNull())
    return metrics.select(*(keep or []), found.alias("failures"), F.lit(bad).alias("retraining_recommended"))


def ablation_matrix(spark, measured: dict[str, DataFrame]) -> DataFrame:
    """A row per system of ABLATIONS: name, status (measured if its metrics are given, else not_run), reason, metrics (JSON)."""
    out = None
    for name, model, _, reranker, tagger, scorer in ABLATIONS:
        why = "needs a local language model" if model else "needs a local reranker" if reranker else "needs an entity tagger" if tagger else "needs a local embedding model" if scorer else "its metrics were not given"
        if name in measured:
            m = measured[name]
            row = m.select(F.lit(name).alias("name"), F.lit("measured").alias("status"), F.lit(None).cast("string").alias("reason"), F.to_json(F.struct(*[m[c] for c in m.columns]), {"ignoreNullFields": "false"}).alias("metrics"))
        else:
            row = spark.range(1).select(F.lit(name).alias("name"), F.lit("not_run").alias("status"), F.lit(why).alias("reason"), F.lit(None).cast("string").alias("metrics"))
        out = row if out is None else out.unionByName(row)
    return out


def real_document_scores(rows: DataFrame) -> DataFrame:
    """``rows`` with the scores of each document and ``release_gate_passed`` (eleven conditions).

    ``rows``: expected, actual (array<struct<text,start,end,source_type>>); expected_codes, actual_codes; safe_fixed_text, corrected_text;
    edits (array<struct<correction_level,confidence,suggestion>>); resolutions (array<struct<guessed,resolution_status>>);
    verification_available, deep_review_available, source_overwritten, export_valid, error_code.
    """
    cites, codes = set_rates(F.col("expected"), F.col("actual"), True), set_rates(F.filter("expected_codes", lambda x: x != ""), F.filter("actual_codes", lambda x: x != ""), True)
    yes = lambda c, d=False: F.coalesce(F.col(c), F.lit(d))
    safe = lambda x: F.coalesce((x["correction_level"] == "safe_auto_fix") & (x["confidence"] == "high") & x["suggestion"].isNotNull(), F.lit(False))
    guessed = lambda x: F.coalesce(x["guessed"], F.lit(False)) | F.coalesce(F.lower(x["resolution_status"]) == "guessed", F.lit(False))
    out = rows.withColumns({
        "citation_precision": cites["precision"], "citation_recall": cites["recall"], "issue_precision": codes["precision"], "issue_recall": codes["recall"],
        "expected_citations": _size(F.col("expected")), "detected_citations": _size(F.col("actual")), "unsafe_automatic_edits": F.coalesce(F.size(F.filter("edits", lambda x: ~safe(x))), F.lit(0)),
        "safe_fixed_text_match": F.when(F.col("safe_fixed_text").isNotNull(), F.coalesce("corrected_text", F.lit("")) == F.col("safe_fixed_text")),
        "unresolved_antecedent_guesses": F.coalesce(F.size(F.filter("resolutions", guessed)), F.lit(0)),
        "local_mode_network_calls": yes("verification_available").cast("int") + yes("deep_review_available").cast("int"),
    })
    gate = F.col("error_code").isNull() & F.coalesce("safe_fixed_text_match", F.lit(True)) & ~yes("source_overwritten") & yes("export_valid", True)
    for c in ("citation_precision", "citation_recall", "issue_precision", "issue_recall"):
        gate = gate & (F.col(c) == 1.0)
    for c in ("unsafe_automatic_edits", "unresolved_antecedent_guesses", "local_mode_network_calls"):
        gate = gate & (F.col(c) == 0)
    return out.withColumn("release_gate_passed", gate)


def real_document_summary(scores: DataFrame) -> DataFrame:
    """One row: macro averages and sums over documents; the gate holds if there are documents and all pass."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0)).alias(c)
    total = lambda c, n: F.coalesce(F.sum(c), F.lit(0)).alias(n)
    return scores.agg(
        F.count("*").alias("document_count"), *[mean(c) for c in ("citation_precision", "citation_recall", "issue_precision", "issue_recall")],
        *[total(c, c) for c in ("unsafe_automatic_edits", "unresolved_antecedent_guesses", "local_mode_network_calls")],
        F.count_if(F.coalesce("source_overwritten", F.lit(False))).alias("source_overwrites"), F.count_if(~F.coalesce("export_valid", F.lit(True))).alias("invalid_exports"), F.coalesce(F.bool_and("release_gate_passed"), F.lit(False)).alias("release_gate_passed"),
    )


def corpus_cube(citations: DataFrame, *by: str) -> DataFrame:
    """Counts over every subset of the given columns, with the exact number of documents and its sketch (an extension)."""
    return citations.cube(*by).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_documents"), F.approx_count_distinct("doc_id").alias("n_documents_sketch"), F.grouping_id().alias("level"))


