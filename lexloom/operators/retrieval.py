"""Ranking of guidance chunks and of vectors for queries, the best ``k`` each.

Queries are a stated set: they are dealt into blocks of about ``BLOCK``, and a block
is what is broadcast. Chunks of a text search are scored where they are, and only
scores are shuffled, after local sums and a local top-k; vectors are dealt into groups.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.spans import any_of, between, bound, let, spans, strip

BLOCK = 2000
#: Rule chunks that are read as one array at a time.
LIBRARY = 5000

# Families of contextual rules, and the topics that guidance files group them into.
FAMILY_TOPICS = {
    "short forms: id.": "short_forms",
    "short forms: cases": "short_forms",
    "short forms: statutes and regulations": "short_forms",
    "supra and hereinafter": "short_forms",
    "signals": "signals_parentheticals",
    "parentheticals": "signals_parentheticals",
    "citation groups and ordering": "signals_parentheticals",
    "internet sources": "internet_sources",
}
METADATA = ("mode", "source_type", "rule_family", "jurisdiction", "revision_date")


def tokens(text: Column) -> Column:
    """Distinct runs of a-z and 0-9 in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))


def _blocks(queries: DataFrame, block: int) -> list[DataFrame]:
    """The queries in blocks of about ``block`` at most."""
    n = queries.count()
    deals = max(1, -(-n // block))
    return [queries if deals == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(deals)) == i) for i in range(deals)]


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def lexical_top_k(chunks: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK) -> DataFrame:
    """query_id, chunk_id, overlap, score, rank. ``chunks``: chunk_id, text; ``queries``: query_id, text. score = overlap / sqrt(|query| |chunk|).

    A block of queries is broadcast as (token, queries that hold it); its size is
    bounded by the block. A chunk's tokens look it up, and overlaps are summed
    where the chunk is before anything is shuffled.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    base = chunks.select("chunk_id", tokens(F.col("text")).alias("t")).select("chunk_id", F.size("t").alias("n"), F.explode_outer("t").alias("token")).where("token is not null")
    out = None
    for part in _blocks(queries.select("query_id", tokens(F.col("text")).alias("q")), block):
        lookup = part.select(F.struct("query_id", F.size("q").alias("m")).alias("q"), F.explode("q").alias("token")).groupBy("token").agg(F.collect_list("q").alias("qs"))
        hits = base.join(F.broadcast(lookup), "token").select("chunk_id", "n", F.explode("qs").alias("q"))
        hits = hits.groupBy("chunk_id", "q.query_id").agg(F.count("*").cast("int").alias("overlap"), F.max("n").alias("n"), F.max("q.m").alias("m"))
        hits = hits.select("query_id", "chunk_id", "overlap", (F.col("overlap") / F.sqrt(F.greatest(F.lit(1), F.col("m") * F.col("n")))).alias("score"))
        out = hits if out is None else out.unionByName(hits)
    return _ranked(out, k)


def topic(family: Column) -> Column:
    """The topic of a rule family; any other name stays."""
    known = F.create_map(*[F.lit(x) for kv in FAMILY_TOPICS.items() for x in kv])
    return F.coalesce(F.element_at(known, F.lower(F.trim(family))), family)


def metadata_fits(chunk: Column, query: Column) -> Column:
    """Does a chunk's metadata fit a query's; what a query leaves null or empty does not matter."""
    asked = lambda n: F.coalesce(query[n], F.lit("")) != ""
    any_of = lambda n, *free: ~asked(n) | chunk[n].isin(*free) | (chunk[n] == query[n])
    family = ~asked("rule_family") | (chunk["rule_family"] == topic(query["rule_family"]))
    return any_of("mode", "both") & any_of("source_type", "all") & family & any_of("jurisdiction", "general", "general_us") & (~asked("revision_date") | (chunk["revision_date"] == query["revision_date"]))


def retrieve_rules(queries: DataFrame, library: DataFrame, k: int = 3, most: int = LIBRARY) -> DataFrame:
    """query_id, chunk_id, score, rank: of the chunks whose metadata fits, the ``k`` best, also those without a common word.

    ``queries``: query_id, text and METADATA (null: any); ``library``: chunk_id, heading, text and METADATA. The
    library is read as arrays of at most about ``most`` chunks, one after the other, and only each query's best are kept.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    chunks = library.select("chunk_id", tokens(F.concat_ws(" ", "heading", "text")).alias("t"), *METADATA)
    deals = max(1, -(-chunks.count() // most))
    asked = queries.select("query_id", tokens(F.col("text")).alias("q"), F.struct(*METADATA).alias("m"))
    best = None
    for i in range(deals):
        part = chunks if deals == 1 else chunks.where(F.pmod(F.xxhash64("chunk_id"), F.lit(deals)) == i)
        rows = asked.withColumn("lib", part.agg(F.collect_list(F.struct(*chunks.columns))).scalar())
        score = lambda c: F.round(F.size(F.array_intersect(c["t"], F.col("q"))) / F.sqrt(F.greatest(F.lit(1), F.size("q") * F.size(c["t"]))), 8)
        ranked = F.array_sort(F.transform(F.filter("lib", lambda c: metadata_fits(c, F.col("m"))), lambda c: F.struct((-score(c)).alias("n"), c["chunk_id"].alias("chunk_id"))))
        hits = rows.select("query_id", F.explode_outer(F.slice(ranked, 1, k)).alias("h")).where("h is not null").select("query_id", "h.chunk_id", (-F.col("h.n")).alias("score"))
        best = hits if best is None else best.unionByName(hits)
    return _ranked(best, k)


def wants_guidance(review_required: Column, ambiguous: Column, families: Column, mode_uncertain: Column, signals: Column, uncommon_type: Column | bool = False, asked: Column | bool = False, lacks_context: Column | bool = False, confidence: Column | float = 1.0, threshold: float = 0.7) -> Column:
    """Is guidance worth fetching: any of nine reasons. ``families``: how many rule families have findings."""
    out = F.lit(False)
    for c in (review_required, ambiguous, families > 1, mode_uncertain, signals, uncommon_type, asked, lacks_context):
        out = out | F.coalesce(F.lit(c) if isinstance(c, bool) else c, F.lit(False))
    low = F.lit(confidence) if isinstance(confidence, float) else confidence
    return out | F.coalesce(low < threshold, F.lit(False))


def guidance_gate(docs: DataFrame, findings: DataFrame, resolutions: DataFrame, modes: DataFrame) -> DataFrame:
    """doc_id, review_required, ambiguous, families, mode_uncertain, signals, wanted for every document.

    ``findings``: doc_id, family, correction_level; ``resolutions``: doc_id, authority_id; ``modes``: doc_id, confidence.
    """
    f = findings.groupBy("doc_id").agg(F.bool_or(F.col("correction_level") == "review_required").alias("review_required"), F.countDistinct("family").alias("families"), F.bool_or(F.col("family").isin("signals", "parentheticals")).alias("signals"))
    r = resolutions.groupBy("doc_id").agg(F.bool_or(F.col("authority_id").isNull()).alias("ambiguous"))
    m = modes.groupBy("doc_id").agg(F.bool_or(F.col("confidence") == "low").alias("mode_uncertain"))
    df = docs.select("doc_id").join(f, "doc_id", "left").join(r, "doc_id", "left").join(m, "doc_id", "left")
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("review_required", "ambiguous", "mode_uncertain", "signals")}
    df = df.select("doc_id", flags["review_required"].alias("review_required"), flags["ambiguous"].alias("ambiguous"), F.coalesce("families", F.lit(0)).alias("families"), flags["mode_uncertain"].alias("mode_uncertain"), flags["signals"].alias("signals"))
    return df.withColumn("wanted", wants_guidance(F.col("review_required"), F.col("ambiguous"), F.col("families"), F.col("mode_uncertain"), F.col("signals")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_top_k(chunks: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK) -> DataFrame:
    """query_id, chunk_id, score, rank by dot product. ``chunks``: chunk_id, v; ``queries``: query_id, v (arrays of floats).

    Chunks are dealt into groups of about ``block``; each meets each block of queries in one task, which keeps the pairs that can
    be among a query's best ``k`` by a matrix product with an exact bound of its error. ``dot`` then gives their scores. The
    work is chunks x queries.
    """
    deals = max(1, -(-chunks.count() // block))
    group = F.pmod(F.xxhash64("chunk_id"), F.lit(deals)).alias("g")
    dealt = chunks.groupBy(group).agg(F.collect_list(F.struct("chunk_id", "v")).alias("cs"))
    out = None
    for part in _blocks(queries.select("query_id", F.col("v").alias("q")), block):
        asked = part.agg(F.collect_list(F.struct("query_id", "q")).alias("qs"))
        pairs = dealt.crossJoin(F.broadcast(asked)).withColumn("h", _nearest(k)(F.col("cs.v"), F.col("qs.q")))
        pairs = pairs.select(F.explode_outer(F.transform("h", lambda h: F.struct(F.get("cs", h["c"]).alias("c"), F.get("qs", h["q"]).alias("q")))).alias("x")).where("x is not null")
        hits = pairs.select("x.q.query_id", "x.c.chunk_id", dot(F.col("x.c.v"), F.col("x.q.q")).alias("score")).where("query_id is not null")
        out = hits if out is None else out.unionByName(hits)
    return _ranked(out, k)


def _nearest(k: int):
    """An Arrow UDF over rows of vectors and queries: the pairs (c, q) of their places that can be among a query's best ``k`` here.

    A vector that is null, of another length, or not finite makes a pair that no bound holds for, so all of its pairs are kept.
    """

    @F.pandas_udf("array<struct<c:int,q:int>>")
    def nearest(vs: pd.Series, qs: pd.Series) -> pd.Series:
        def matrix(rows, d):
            fit = np.array([x is not None and len(x) == d for x in rows], bool)
            out = np.zeros((len(rows), d))
            for i in np.flatnonzero(fit):
                out[i] = rows[i]
            sound = fit & (np.abs(out).max(axis=1, initial=0) < 1e150)  # false for nan and infinity, too
            out[~sound] = 0
            return out, sound

        def one(v, q):
            d = max((len(x) for x in q if x is not None), default=0)
            (a, a_ok), (b, b_ok) = matrix(v, d), matrix(q, d)
            s = a @ b.T
            # The error of a sum of d products in any order, twice: of this sum and of the one in ``dot``.
            slack = 4 * (d + 2) * np.finfo(float).eps * np.sqrt((a * a).sum(axis=1).max(initial=0)) * np.sqrt((b * b).sum(axis=1)) + 1e-300
            best = s[a_ok]
            least = np.partition(best, len(best) - k, axis=0)[len(best) - k] - slack if len(best) > k else np.full(len(q), -np.inf)
            c, j = np.nonzero((s >= least) | ~a_ok[:, None] | ~b_ok[None, :])
            return [{"c": int(x), "q": int(y)} for x, y in zip(c, j)]

        return pd.Series([one(v, q) for v, q in zip(vs, qs)])

    return nearest


def normalize_text(text: Column) -> Column:
    """Dashes to hyphens, white space collapsed and trimmed (see ``lexloom.functions.udfs.nfkc`` for compatibility forms)."""
    return F.trim(F.regexp_replace(F.translate(text, "—–", "--"), r"(?U)\s+", " "))


def comparison_text(text: Column) -> Column:
    """Words of a-z and 0-9 with one space between them. Dashes and white space are none of these, so the text needn't be in the form of ``normalize_text``."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def sentences(text: Column) -> Column:
    """Sentences in the form of ``normalize_text``; mostly there is nothing to change in one."""
    plain = F.when(any_of(text, "—–"), F.translate(text, "—–", "--")).otherwise(text)
    parts = F.split(plain, r"(?U)(?<=[.!?])\s+|\n+", -1)
    tidy = lambda x: F.trim(F.when(F.rlike(x, F.lit(r"(?U)[\s&&[^ ]]|  ")), F.regexp_replace(x, r"(?U)\s+", " ")).otherwise(x))
    return F.filter(F.transform(parts, tidy), lambda x: x != "")


def passages(text: Column, target_words: int | Column = 70) -> Column:
    """Windows of up to three sentences that end once they hold ``target_words`` words."""

    def window(counted, i):
        a, b, c = (F.get(counted, i + k if k else i) for k in range(3))
        full = lambda n: n >= target_words
        second = F.when(~F.coalesce(full(a["n"]), F.lit(False)), b["s"])
        third = F.when(~F.coalesce(full(a["n"]) | full(a["n"] + b["n"]), F.lit(False)), c["s"])
        return F.concat_ws(" ", F.when(~F.coalesce(full(F.lit(0)), F.lit(False)), a["s"]), second, third)

    counted = F.transform(sentences(text), lambda s: F.struct(s.alias("s"), F.size(F.split(s, " ")).alias("n")))
    return let(counted, lambda found: F.transform(found, lambda _, i: window(found, i)))


def proposition(text: Column, at: Column, most: int = 600) -> Column:
    """The last sentence of the ``most`` characters before a citation."""
    lead = strip(between(text, at - most, at))
    parts = F.filter(F.transform(F.split(lead, r"(?U)(?<=[.!?])\s+|\n+", -1), strip), lambda x: x != "")
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), lead)


def nearby_quotes(text: Column, at: Column, most: int = 800) -> Column:
    """The last three quotations of 8 to 500 characters before a citation."""
    found = F.transform(F.regexp_extract_all(between(text, at - most, at), F.lit('(?s)["“](.{8,500}?)["”]'), F.lit(1)), normalize_text)
    return F.slice(found, F.greatest(F.size(found) - 2, F.lit(1)), F.lit(3))


def words_longer(text: Column, n: int = 2) -> Column:
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda x: F.lower(x)), lambda x: F.length(x) > n))


def overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of the words longer than two letters."""
    return let(F.struct(words_longer(a).alias("x"), words_longer(b).alias("y")), lambda w: shared(w["x"], w["y"]))


def shared(x: Column, y: Column) -> Column:
    """Jaccard similarity of two arrays of distinct words; 0 if both are empty."""
    return bound("if(x.n + x.m = 0, double(0), x.both / (x.n + x.m - x.both))", n=F.size(x), m=F.size(y), both=F.size(F.array_intersect(x, y)))


def quote_status(quote: Column, source: Column) -> Column:
    """not_supplied, exact, normalized or compare (needs the sequence ratio, see ``evidence``)."""
    q, s = normalize_text(quote), normalize_text(source)
    cq, cs = comparison_text(quote), comparison_text(source)
    return F.when(F.coalesce(F.trim(quote), F.lit("")) == "", "not_supplied").when(F.contains(s, q), "exact").when((cq != "") & F.contains(cs, cq), "normalized").otherwise("compare")


def pincite_status(pincite: Column, source: Column, best_score: Column) -> Column:
    marker = F.concat(F.lit(r"(?iU)(?:\*|\bPage\s+|\[)\Q"), F.trim(pincite), F.lit(r"\E(?:\]|\b)"))
    return F.when(F.coalesce(F.trim(pincite), F.lit("")) == "", "not_supplied").when(F.rlike(source, marker), "confirmed_by_page_marker").when(best_score >= 0.18, "passage_found_page_unverified").otherwise("unverifiable")


def markdown_chunks(docs: DataFrame, text_col: str = "text", id_col: str = "filename") -> DataFrame:
    """Headed sections of guidance files: chunk_id (hash of file, heading and body), heading, text."""
    heads = spans(F.col(text_col), P.Pattern(r"(?m)^#{1,6}[ \t]+[^\n]+$"))
    pieces = F.transform(F.col("__h"), lambda h, i: F.struct(F.regexp_replace(h["text"], r"^#+[ \t]+", "").alias("heading"), strip(between(F.col(text_col), h["end"], F.coalesce(F.try_element_at(F.transform("__h", lambda x: x["start"]), i + 2), F.length(text_col)))).alias("text")))
    rows = docs.withColumn("__h", heads).select(F.col(id_col), F.explode_outer(pieces).alias("p")).where("p is not null")
    return rows.select(id_col, F.substring(F.sha2(F.concat_ws("\x1f", F.col(id_col), F.col("p.heading"), F.col("p.text")), 256), 1, 20).alias("chunk_id"), "p.heading", "p.text")
