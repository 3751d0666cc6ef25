"""Evidence for a person to judge: quotations found in a source and ranked passages. No conclusion is drawn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import between, bound, let
from ..functions.udfs import nfkc, with_best_ratios
from .retrieval import comparison_text, dot, nearby_quotes, normalize_text, passages, pincite_status, proposition, quote_status, shared, words_longer

PARTIAL = 0.55


def _best_passages(rows: DataFrame, text: Column, found: Column, k: int, words: Column | None = None) -> DataFrame:
    """id, ``best``: the k passages (pos, passage, share, ratio, score) of the greatest scores, ties by place, and ``n_passages`` and ``n_compared``.

    score = 0.65 share + 0.35 ratio (to four places), or the ratio alone without ``words`` (those whose share in a passage counts).
    What a score is at least and at most follows from the share and the lengths, in the row: only passages that can come among the k best go to
    Python, which compares one only as long as it can still win.
    """
    ws, wr = (0.0, 1.0) if words is None else (0.65, 0.35)
    score = (lambda s, r: r) if words is None else (lambda s, r: F.round(0.65 * s + 0.35 * r, 4))

    def one(p, i, own):
        share = F.lit(0.0) if words is None else shared(own["words"], words_longer(p))
        # At most the shorter text is found in the longer one; equal texts have the ratio 1.
        most = lambda c: bound("if(x.n + x.m = 0, double(1), 2 * least(x.n, x.m) / (x.n + x.m))", n=own["n"], m=F.length(c))
        return let(comparison_text(p), lambda c: F.struct(i.alias("pos"), c.alias("plain"), most(c).alias("most"), share.alias("share"), p.alias("passage"), (c == own["q"]).alias("same")))

    own = F.struct(F.col("__q").alias("q"), F.length("__q").alias("n"), (F.array().cast("array<string>") if words is None else words).alias("words"))
    df = rows.select("id", text.alias("__q"), found.alias("__p"), *([] if words is None else [c for c in rows.columns if c != "id"]))
    df = df.select("id", "__q", let(own, lambda o: F.transform("__p", lambda p, i: one(p, i, o))).alias("__all"))
    least = F.sort_array(F.transform("__all", lambda a: ws * a["share"] + F.when(a["same"], wr).otherwise(0.0)), asc=False)
    can_win = let(F.try_element_at(least, F.lit(k)), lambda low: F.filter("__all", lambda a: F.coalesce(ws * a["share"] + wr * a["most"] + 2e-4 >= low, F.lit(True))))
    df = df.select("id", "__q", can_win.alias("__can"), F.size("__all").alias("n_passages"))
    df = with_best_ratios(df, "__q", "__can", "__r", k, ws, wr)
    told = let(F.struct(F.col("__can").alias("all"), F.col("__r").alias("r")), lambda x: F.transform(x["r"], lambda r: let(F.element_at(x["all"], r["i"] + 1), lambda c: F.struct((-score(c["share"], r["ratio"])).alias("key"), c["pos"].alias("pos"), c["passage"].alias("passage"), c["share"].alias("share"), r["ratio"].alias("ratio")))))
    best = F.transform(F.slice(F.array_sort(told), 1, k), lambda c: F.struct(c["pos"], c["passage"], c["share"], c["ratio"], (-c["key"]).alias("score")))
    return df.select("id", best.alias("best"), "n_passages", F.size("__r").alias("n_compared"))


def match_quotes(df: DataFrame, around: int = 80) -> DataFrame:
    """``df`` (id, quote, source) with status (exact, normalized, partial, absent, not_supplied), score and excerpt.

    The excerpt is the found text with ``around`` characters beside it (of the text that was compared), or the passage
    that matches in part. Only rows that need the sequence ratio go through Python.
    """
    base = df.select("id", nfkc(F.coalesce("quote", F.lit(""))).alias("quote"), nfkc(F.coalesce("source", F.lit(""))).alias("source"))
    base = base.withColumn("status", quote_status(F.col("quote"), F.col("source")))

    def excerpt(quote, source):
        at = F.call_function("locate", quote, source) - 1
        return between(source, at - around, at + F.length(quote) + around)

    found = F.when(F.col("status") == "exact", excerpt(normalize_text(F.col("quote")), normalize_text(F.col("source")))).when(F.col("status") == "normalized", excerpt(comparison_text(F.col("quote")), comparison_text(F.col("source")))).otherwise("")
    sure = base.where("status != 'compare'").select("id", "status", F.when(F.col("status") == "exact", 1.0).when(F.col("status") == "normalized", 0.98).otherwise(0.0).alias("score"), found.alias("excerpt"))
    rest = base.where("status = 'compare'").withColumn("q", comparison_text(F.col("quote")))
    target = F.greatest(F.lit(12), F.size(F.split("q", " ")) + 8)
    # Of equal ratios the first passage counts.
    found = _best_passages(rest, F.col("q"), passages(F.col("source"), target), 1)
    best = found.select("id", F.try_element_at("best", F.lit(1)).alias("b")).select("id", F.coalesce("b.ratio", F.lit(0.0)).alias("r"), F.col("b.passage").alias("p"))
    partial = F.col("r") >= PARTIAL
    rest = best.select("id", F.when(partial, "partial").otherwise("absent").alias("status"), F.round("r", 4).alias("score"), F.when(partial, F.col("p")).otherwise("").alias("excerpt"))
    return sure.unionByName(rest)


def hybrid_scores(rows: DataFrame, lexical_weight: float = 0.5) -> DataFrame:
    """``rows`` (lexical_score, query_vector, vector) with embedding_similarity, combined_score and scorer.

    Vectors are of length one, so their similarity is their dot product. Where a vector is missing the lexical score
    counts alone, and ``scorer`` says so.
    """
    sim = F.when(F.col("query_vector").isNotNull() & F.col("vector").isNotNull(), F.round(dot(F.col("query_vector"), F.col("vector")), 4))
    both = F.round(lexical_weight * F.col("lexical_score") + (1 - lexical_weight) * dot(F.col("query_vector"), F.col("vector")), 4)
    return rows.withColumns({"embedding_similarity": sim, "combined_score": F.when(sim.isNull(), F.col("lexical_score")).otherwise(both), "scorer": F.when(sim.isNull(), "lexical_fallback_hybrid_unavailable").otherwise("hybrid_local_embedding")})


def rank_passages(df: DataFrame, k: int = 3) -> DataFrame:
    """``df`` (id, proposition, source): id, rank, passage, token_overlap, sequence_similarity, combined_score.

    combined = 0.65 token overlap + 0.35 sequence similarity; ties keep the source's order. Rows without a passage or a proposition give none. Narrow: no shuffle.
    """
    found = _ranked_rows(df, k)
    rows = found.select("id", F.posexplode("best").alias("k", "b"))
    return rows.select("id", "b.passage", F.col("b.share").alias("token_overlap"), F.col("b.ratio").alias("sequence_similarity"), F.col("b.score").alias("combined_score"), (F.col("k") + 1).alias("rank"))


def _ranked_rows(df: DataFrame, k: int) -> DataFrame:
    return _best_passages(df.select("id", "proposition", "source"), comparison_text(F.col("proposition")), passages(F.col("source")), k, words_longer(F.col("proposition")))


def passage_costs(df: DataFrame, k: int = 3) -> DataFrame:
    """id, n_passages, n_compared: how many passages of each row reached the comparison that ``rank_passages`` makes."""
    return _ranked_rows(df, k).select("id", "n_passages", "n_compared")


def case_evidence(citations: DataFrame, sources: DataFrame) -> DataFrame:
    """Evidence for each citation (id, document, start, pincite, source_id) in its source (source_id, source_text).

    id, quotation_status, quotation_score (the best of up to three quotations before it), pincite_status,
    proposition, best_passage, best_score. The conclusion stays open.
    """
    j = citations.join(sources, "source_id")
    base = j.select("id", "pincite", F.col("source_text").alias("source"), proposition(F.col("document"), F.col("start")).alias("proposition"), nearby_quotes(F.col("document"), F.col("start")).alias("quotes"))
    quotes = base.select("id", F.posexplode("quotes").alias("k", "quote"), "source")
    found = match_quotes(quotes.select(F.concat_ws("#", F.col("id").cast("string"), F.col("k").cast("string")).alias("id"), "quote", "source"))
    keyed = quotes.select("id", F.concat_ws("#", F.col("id").cast("string"), F.col("k").cast("string")).alias("qid"))
    best = keyed.join(found.withColumnRenamed("id", "qid"), "qid").groupBy("id").agg(F.max_by("status", "score").alias("quotation_status"), F.max("score").alias("quotation_score"))
    ranked = rank_passages(base.select("id", "proposition", "source"), 1).select("id", F.col("passage").alias("best_passage"), F.col("combined_score").alias("best_score"))
    out = base.join(best, "id", "left").join(ranked, "id", "left")
    return out.select("id", F.coalesce("quotation_status", F.lit("not_supplied")).alias("quotation_status"), F.coalesce("quotation_score", F.lit(0.0)).alias("quotation_score"), pincite_status(F.col("pincite"), F.col("source"), F.coalesce("best_score", F.lit(0.0))).alias("pincite_status"), "proposition", "best_passage", "best_score", F.lit("not_determined").alias("conclusion"))
