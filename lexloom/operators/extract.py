"""Citations of a text: candidates by pattern, gates, and priorities.

All of it is in-row Catalyst work on arrays: one projection per document, no
shuffle. A candidate of a later pattern is dropped if it overlaps any citation
accepted before; matches of one pattern never overlap each other.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import tables
from ..functions.spans import FEW, MARK, any_of, below, cut_at, hit, in_order, let, pieces, rows_of, spans, spans_at, within, written

CITATION = "struct<start:int,end:int,text:string,source_type:string,components:map<string,string>>"

#: In order of priority.
SPECS = (("case", P.REPORTED_CASE), ("statute", P.STATE_LAW), ("case", P.CASE), ("statute", P.STATUTE), ("regulation", P.REGULATION), ("constitution", P.CONSTITUTION), ("journal_article", P.JOURNAL), ("short_form", P.SHORT_FORM), ("short_form", P.ID), ("internet", P.URL))


def neutralize(text: Column) -> Column:
    """Invisible characters as spaces; the length stays."""
    return F.when(any_of(text, P.INVISIBLE), F.translate(text, P.INVISIBLE, " " * len(P.INVISIBLE))).otherwise(text)


def id_gate(cut: Column, start: Column, end: Column, prior: Column) -> Column:
    """Does an id token stand where a citation can: with a pincite, after a signal, or at a sentence's start with a period or a prior citation. ``cut``: the text in pieces."""
    lead = within(cut, start - 60, start)
    pincite = F.rlike(within(cut, end, end + 40), F.lit(P.ID_PINCITE_AFTER))
    signal = F.rlike(lead, F.lit(P.SIGNAL_BEFORE_ID))
    boundary = (F.regexp_replace(lead, r"(?U)\s", "") == "") | F.rlike(lead, F.lit(P.SENTENCE_END_BEFORE))
    period = within(cut, end - 1, end) == "."
    return pincite | signal | (boundary & (period | prior))


def trim_hereinafter(text: Column) -> Column:
    """A citation's text without a definition of an alias at its end: that is a clause of its own."""
    return F.regexp_replace(text, P.TRAILING_HEREINAFTER, "")


#: What stands beside a match and belongs to it: pincite and year of an article, the name that a supra guesses at.
BESIDE = {P.JOURNAL: ("pincite", "year"), P.SHORT_FORM: ("antecedent_guess",)}


def _beside(cut: Column, s: Column, name: str) -> Column:
    if name == "antecedent_guess":
        return F.when(F.lower(s["text"]) == "supra", F.regexp_extract(within(cut, s["start"] - 40, s["start"]), P.NAME_BEFORE, 1)).otherwise("")
    return F.regexp_extract(within(cut, s["end"], s["end"] + 40), P.JOURNAL_AFTER, 1 if name == "pincite" else 2)


def _candidate(k: int):
    """A candidate of the k-th pattern: with where the match itself ends (``reach``; an address ends before its punctuation)."""
    of = (lambda text: f"rtrim('.,;:', {text})") if SPECS[k][1] is P.URL else (lambda text: text)
    return lambda start, text, groups: f"named_struct('start', {start}, 'end', {start} + length({of(text)}), 'reach', {start} + length({text}), 'text', {of(text)}, 'k', {k}, 'groups', {groups})"


def with_citations(docs: DataFrame, text_col: str = "text", out: str = "citations", parts: Iterable[str] | None = None) -> DataFrame:
    """``docs`` with an array of CITATION, ordered by (start, end).

    Accepted citations don't overlap, so a candidate is held against them; many of them are sorted, and searched in halves.
    ``parts``: the names that ``components`` should hold, if not all: what isn't asked for isn't worked out.
    """
    asked = None if parts is None else set(parts)
    want = lambda names: tuple(n for n in names if asked is None or n in asked)
    own, beside = [want(p.parts) for _, p in SPECS], [want(BESIDE.get(p, ())) for _, p in SPECS]
    t, odd, cut, acc = F.col("__t"), F.col("__odd"), F.col("__cut"), F.col("__acc")
    df = docs.withColumn("__t", neutralize(F.coalesce(F.col(text_col), F.lit("")))).withColumn("__odd", F.contains(t, F.lit(MARK)))
    df = df.withColumns({f"__m{k}": cut_at(t, odd, p, own[k]) for k, (_, p) in enumerate(SPECS)})
    df = df.withColumns({"__cut": pieces(t), **{f"__m{k}": spans_at(f"__m{k}", t, odd, p, own[k], _candidate(k)) for k, (_, p) in enumerate(SPECS)}})
    for k in (k for k, names in enumerate(beside) if names):
        more = lambda c: c.withField("groups", F.concat(c["groups"], F.array(*[_beside(cut, c, n) for n in beside[k]])))
        df = df.withColumn(f"__m{k}", F.when(F.col(f"__m{k}").isNotNull(), F.transform(f"__m{k}", more)))
    df = df.withColumn("__acc", F.coalesce("__m0", F.array().cast("array<struct<start:int,end:int,reach:int,text:string,k:int,groups:array<string>>>")))
    substantive = F.array(*[F.lit(k) for k, (kind, _) in enumerate(SPECS) if kind in P.SUBSTANTIVE])
    for k, (_, p) in enumerate(SPECS[1:], 1):
        new, gated = F.col(f"__m{k}"), p is P.ID
        ends = lambda: F.sort_array(F.concat(F.array(F.lit(-(1 << 30))), F.transform(F.filter(acc, lambda a: F.array_contains(substantive, a["k"])), lambda a: a["end"])))
        held = F.struct(in_order(acc).alias("spans"), *([ends().alias("ends")] if gated else []))

        def few(c):
            free = ~F.exists(acc, lambda a: (a["end"] > c["start"]) & (a["start"] < c["reach"]))
            prior = F.exists(acc, lambda a: a["end"].between(c["start"] - P.ID_WINDOW, c["start"]) & F.array_contains(substantive, a["k"]))
            return free & id_gate(cut, c["start"], c["end"], prior) if gated else free

        def many(x, c):
            free = ~hit(x["spans"], c["start"], c["reach"])
            return free & id_gate(cut, c["start"], c["end"], F.element_at(x["ends"], below(x["ends"], c["start"] + 1)) >= c["start"] - P.ID_WINDOW) if gated else free

        all_ = F.concat(acc, F.when(F.size(acc) <= FEW, F.filter(new, few)).otherwise(let(held, lambda x: F.filter(new, lambda c: many(x, c)))))
        # Most texts have no candidate of a pattern, and then nothing is searched.
        df = df.withColumn("__acc", F.when(new.isNull(), acc).otherwise(all_) if gated else F.when(new.isNull(), acc).when(F.size(acc) == 0, new).otherwise(all_))
    df = df.withColumn("__acc", F.when(F.size(acc) > 1, F.sort_array(acc)).otherwise(acc))
    names = F.array(*[F.array(*[F.lit(n) for n in own[k] + beside[k]]).cast("array<string>") for k in range(len(SPECS))])
    kinds = F.array(*[F.lit(kind) for kind, _ in SPECS])

    def citation(c):
        of = written("map_filter", F.map_from_arrays(F.get(names, c["k"]), c["groups"]), "(k, v) -> v != ''") if any(own) or any(beside) else F.create_map().cast("map<string,string>")
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), c["text"].alias("text"), F.get(kinds, c["k"]).alias("source_type"), of.alias("components"))

    return df.withColumn(out, F.transform(acc, citation)).drop("__t", "__odd", "__acc", "__cut", *[f"__m{k}" for k in range(len(SPECS))])


def matches(docs: DataFrame, p: P.Pattern, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row per match of one pattern: doc_id, start, end, text, and the named parts."""
    rows = rows_of(docs.withColumn("__m", spans(neutralize(F.col(text_col)), p)), "__m", F.col(id_col).alias("doc_id"))
    return rows.select("*", *[F.regexp_extract("text", p.regex, i + 1).alias(n) for i, n in enumerate(p.parts)])


def citation_rows(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", parts: Iterable[str] | None = None) -> DataFrame:
    """A row per citation: doc_id, occ, start, end, text, source_type, components (all ``parts``, or those named)."""
    return rows_of(with_citations(docs, text_col, parts=parts), "citations", F.col(id_col).alias("doc_id"), at="occ")


def canonical_reporter(reporter: Column) -> Column:
    return tables.canonical(reporter, tables.LINT_REPORTERS)


def counts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Words, citation-like strings and pages (500 words, one at least) of each text."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    words = F.regexp_count(t, F.lit(r"(?U)\b[\w’'-]+\b"))
    cites = F.regexp_count(t, F.lit(P.CITATION_HINT))
    return docs.select(F.col(id_col).alias("doc_id"), words.alias("words"), cites.alias("citations"), F.greatest(F.lit(1), F.ceil(words / 500)).cast("int").alias("pages"))


__all__ = ["CITATION", "SPECS", "canonical_reporter", "citation_rows", "counts", "id_gate", "matches", "neutralize", "with_citations"]
