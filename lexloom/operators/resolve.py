"""Antecedents of short forms. Ambiguity is never guessed away: a form resolves to one authority or to none.

All forms but ``Id.`` look at full citations only, so they are independent
equi-joins. ``Id.`` chains: within a run of ``Id.`` after another occurrence every
one resolves to that occurrence's authority until the first that is barred;
these are windows over islands, not a loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import PERMITTED_SUPRA
from ..functions.tables import squeezed
from .graph import norm
from .spanjoin import asof_join

RESULT = ["doc_id", "ord", "form", "authority_id", "method", "confidence", "reasons"]


def _c(name: str) -> Column:
    return F.col("components")[name]


def _decide(short: DataFrame, found: DataFrame, method: str, many: str, none: str | Column, confidence: str = "high", always: Column | None = None) -> DataFrame:
    """``found``: doc_id, ord, candidate (may be null). One distinct candidate resolves."""
    n = found.groupBy("doc_id", "ord").agg(F.collect_set("candidate").alias("cands"), *([F.max(always).alias("flag")] if always is not None else []))
    out = short.join(n, ["doc_id", "ord"], "left").withColumn("cands", F.coalesce("cands", F.array().cast("array<string>")))
    one, flag = F.size("cands") == 1, F.coalesce(F.col("flag"), F.lit(False)) if always is not None else F.lit(False)
    barred = F.when(flag, F.array(F.lit("source_type_does_not_permit_supra"))).otherwise(F.array().cast("array<string>"))
    why = F.when(one, F.array().cast("array<string>")).when(F.size("cands") > 1, F.array(F.lit(many))).otherwise(none if isinstance(none, Column) else F.array(F.lit(none)))
    return out.select("doc_id", "ord", "form", F.when(one, F.col("cands")[0]).alias("authority_id"), F.when(one, F.lit(method)).otherwise(F.lit("unresolved")).alias("method"), F.when(one, F.lit(confidence)).otherwise(F.lit("low")).alias("confidence"), F.array_distinct(F.concat(barred, why)).alias("reasons"))


def _full(occ: DataFrame, *kinds: str) -> DataFrame:
    out = occ.where("form = 'full'")
    out = out.where(F.col("source_type").isin(*kinds)) if kinds else out
    return out.withColumnsRenamed({"ord": "f_ord", "components": "f_components"})


def short_cases(occ: DataFrame) -> DataFrame:
    """By the first word of the name, volume and reporter of a prior full case."""
    short = occ.where("form = 'short_case'").select("doc_id", "ord", "form", F.split(norm(_c("name")), " ")[0].alias("word"), norm(_c("volume")).alias("volume"), squeezed(_c("reporter")).alias("reporter"))
    f = lambda n: F.col("f_components")[n]
    full = _full(occ, "case").select("doc_id", "f_ord", F.col("authority_id").alias("candidate"), norm(f("case_name")).alias("name"), norm(f("volume")).alias("volume"), squeezed(f("reporter")).alias("reporter"))
    found = short.join(full, ["doc_id", "volume", "reporter"]).where((F.col("f_ord") < F.col("ord")) & F.col("name").startswith(F.col("word")))
    return _decide(short, found, "prior_full_case_exact_components", "multiple_plausible_prior_cases", "no_legally_possible_prior_antecedent")


def later_cases(occ: DataFrame) -> DataFrame:
    """later_consistency_match edges: a short case without a prior match whose full citation comes later. They validate nothing."""
    short = occ.where("form = 'short_case'").select("doc_id", "ord", F.split(norm(_c("name")), " ")[0].alias("word"), norm(_c("volume")).alias("volume"), squeezed(_c("reporter")).alias("reporter"))
    f = lambda n: F.col("f_components")[n]
    full = _full(occ, "case").select("doc_id", "f_ord", norm(f("case_name")).alias("name"), norm(f("volume")).alias("volume"), squeezed(f("reporter")).alias("reporter"))
    same = short.join(full, ["doc_id", "volume", "reporter"]).where(F.col("name").startswith(F.col("word")))
    first = F.min("f_ord").over(Window.partitionBy("doc_id", "ord"))
    return same.withColumn("first", first).where("first > ord").select("doc_id", F.lit("later_consistency_match").alias("edge_type"), F.col("ord").cast("string").alias("source"), F.col("f_ord").cast("string").alias("target"))


def statutory_shorts(occ: DataFrame) -> DataFrame:
    """By the section (and the code, if the short form names it) of a prior full statute or regulation."""
    short = occ.where("form = 'statutory_short'").select("doc_id", "ord", "form", norm(_c("section")).alias("section"), squeezed(F.coalesce(_c("code"), F.lit(""))).alias("code"))
    f = lambda n: F.col("f_components")[n]
    full = _full(occ, "statute", "regulation").select("doc_id", "f_ord", F.col("authority_id").alias("candidate"), norm(f("section")).alias("section"), squeezed(f("code")).alias("f_code"))
    found = short.join(full, ["doc_id", "section"]).where("f_ord < ord and (code = '' or code = f_code)")
    return _decide(short, found, "prior_full_statutory_authority", "multiple_plausible_statutory_antecedents", "no_legally_possible_prior_antecedent")


def supra_notes(occ: DataFrame) -> DataFrame:
    """By the one permitted authority of the note that is referred to."""
    short = occ.where("form = 'supra_note'").select("doc_id", "ord", "form", _c("note").alias("note_number"))
    full = _full(occ).select("doc_id", "f_ord", "note_number", "authority_id", "source_type")
    ok = F.col("source_type").isin(*PERMITTED_SUPRA)
    found = short.join(full, ["doc_id", "note_number"]).where("f_ord < ord").select("doc_id", "ord", F.when(ok, F.col("authority_id")).alias("candidate"), (~ok).alias("barred"))
    return _decide(short, found, "single_permitted_authority_in_referenced_note", "referenced_note_has_multiple_authorities", "referenced_note_has_no_permitted_authority", always=F.col("barred"))


def supras(occ: DataFrame) -> DataFrame:
    """By the label's last word in the name, author or title of a prior full citation of a permitted type.

    A word that a name holds anywhere is a substring of one of its words, so only words that occur as labels
    in the document are looked for: first whether the name holds any of them, then one row per label it holds.
    """
    short = occ.where("form = 'supra'").select("doc_id", "ord", "form", F.element_at(F.split(norm(_c("label")), " "), -1).alias("word"))
    asked = short.groupBy("doc_id").agg(F.collect_set("word").alias("words"))
    full = _full(occ).select("doc_id", "f_ord", "authority_id", "source_type", norm(F.concat_ws(" ", "display", "author", "title")).alias("searchable"))
    held = full.join(asked, "doc_id").select("doc_id", "f_ord", "authority_id", "source_type", F.filter("words", lambda w: F.contains(F.col("searchable"), w)).alias("words")).where(F.size("words") > 0)
    ok = F.col("source_type").isin(*PERMITTED_SUPRA)
    found = short.join(held.select("doc_id", "f_ord", "authority_id", "source_type", F.explode("words").alias("word")), ["doc_id", "word"]).where("f_ord < ord").select("doc_id", "ord", F.when(ok, F.col("authority_id")).alias("candidate"), (~ok).alias("barred"))
    none = F.when(F.coalesce(F.col("flag"), F.lit(False)), F.array(F.lit("source_type_does_not_permit_supra"))).otherwise(F.array(F.lit("no_legally_possible_prior_antecedent")))
    out = _decide(short, found, "prior_full_supra_permitted_authority", "multiple_plausible_supra_antecedents", none, "medium", always=F.col("barred"))
    # Here a barred source is told only if it leaves no candidate.
    keep = F.when(F.col("authority_id").isNotNull(), F.array().cast("array<string>")).when(F.array_contains("reasons", "multiple_plausible_supra_antecedents"), F.array(F.lit("multiple_plausible_supra_antecedents"))).otherwise(F.col("reasons"))
    return out.withColumn("reasons", keep)


def _defined(docs_occ: DataFrame, occ: DataFrame, id_col: str) -> DataFrame:
    """Each definition of an alias with the last full citation (in logical order) that ends before it: doc_id, at, alias, authority_id, source."""
    defs = docs_occ.select(F.col(id_col).alias("doc_id"), F.explode_outer("definitions").alias("d")).where("d is not null").select("doc_id", F.col("d.start").alias("at"), F.col("d.alias").alias("alias"))
    full = occ.where("form = 'full'").select("doc_id", "ord", F.col("end").alias("f_end"), "authority_id")
    prior = asof_join(defs, full, ["doc_id"], "at", "f_end", rank=["ord"]).where("right_ord is not null")
    return prior.select("doc_id", "at", "alias", F.col("right_authority_id").alias("authority_id"), F.col("right_ord").alias("source"))


def alias_targets(docs_occ: DataFrame, occ: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, alias, authority_id, source: of each alias the last definition; it means the last full citation that ends before it. ``docs_occ``: from with_occurrences."""
    prior = _defined(docs_occ, occ, id_col).withColumn("alias", norm(F.col("alias")))
    return prior.groupBy("doc_id", "alias").agg(F.max_by(F.struct("authority_id", "source"), "at").alias("x")).select("doc_id", "alias", "x.authority_id", "x.source")


def definition_edges(docs_occ: DataFrame, occ: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """hereinafter_definition: from the last full citation that ends before a definition to its authority, with the alias."""
    prior = _defined(docs_occ, occ, id_col).dropDuplicates(["doc_id", "alias", "at"])
    return prior.select("doc_id", F.lit("hereinafter_definition").alias("edge_type"), F.col("source").cast("string").alias("source"), F.col("authority_id").alias("target"), "alias")


def hereinafters(occ: DataFrame, aliases: DataFrame) -> DataFrame:
    short = occ.where("form = 'hereinafter'").select("doc_id", "ord", "form", norm(_c("alias")).alias("alias"))
    found = short.join(aliases.select("doc_id", "alias", F.col("authority_id").alias("candidate")), ["doc_id", "alias"])
    return _decide(short, found, "prior_hereinafter_definition", "no_prior_hereinafter_definition", "no_prior_hereinafter_definition")


def id_chains(occ: DataFrame, others: DataFrame) -> DataFrame:
    """``Id.`` forms; ``others``: the results of all other short forms."""
    doc = Window.partitionBy("doc_id").orderBy("ord")
    o = occ.select("doc_id", "ord", "form", "note_id", "authority_id", "gap_clause", "gap_authority", "gap_paragraph", "gap_clean").join(others.select("doc_id", "ord", F.col("authority_id").alias("other")), ["doc_id", "ord"], "left")
    o = o.withColumn("effective", F.coalesce("authority_id", "other")).withColumn("is_id", F.col("form") == "id")
    # How many full citations form the group that ends right before: a link joins one to its successor.
    o = o.withColumns({"n_form": F.lead("form").over(doc), "n_note": F.lead("note_id").over(doc), "n_clean": F.lead("gap_clean").over(doc)})
    o = o.withColumn("link", (F.col("form") == "full") & F.col("note_id").eqNullSafe(F.col("n_note")) & F.coalesce("n_clean", F.lit(False)))
    o = o.withColumn("cut", F.sum((~F.col("link")).cast("int")).over(doc.rowsBetween(Window.unboundedPreceding, -1)))
    run = Window.partitionBy("doc_id", F.coalesce("cut", F.lit(0))).orderBy("ord")
    # Rows of a run are all links but the last; the last's group is the run's links and itself if it is full.
    o = o.withColumn("in_run", F.row_number().over(run) - 1)
    o = o.withColumn("group", F.col("in_run") + (F.col("form") == "full").cast("int"))
    o = o.withColumns({"p_group": F.lag("group").over(doc), "p_effective": F.lag("effective").over(doc)})
    many = F.coalesce(F.col("p_group"), F.lit(0)) > 1
    reasons = F.filter(F.array(
        F.when(F.col("ord") == 0, F.lit("no_immediately_preceding_authority")),
        F.when(F.col("gap_clause") & (F.col("ord") > 0), F.lit("intervening_citation_clause")),
        F.when(many, F.lit("preceding_citation_group_has_multiple_authorities")),
        F.when(F.col("gap_authority") & (F.col("ord") > 0), F.lit("intervening_authority_reference")),
        F.when(F.col("gap_paragraph") & (F.col("ord") > 0), F.lit("intervening_paragraph_break")),
    ), lambda x: x.isNotNull())
    o = o.withColumn("own", F.when(F.col("is_id"), reasons)).withColumn("island", F.sum((~F.col("is_id")).cast("int")).over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    isl = Window.partitionBy("doc_id", "island").orderBy("ord")
    base = F.first(F.when(~F.col("is_id"), F.col("effective"))).over(isl.rowsBetween(Window.unboundedPreceding, 0))
    o = o.withColumn("base", base).withColumn("barred", F.max((F.size(F.coalesce("own", F.array().cast("array<string>"))) > 0).cast("int")).over(isl.rowsBetween(Window.unboundedPreceding, 0)))
    o = o.withColumn("prior_barred", F.coalesce(F.max((F.size(F.coalesce("own", F.array().cast("array<string>"))) > 0).cast("int")).over(isl.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ok = F.col("base").isNotNull() & (F.col("barred") == 0)
    # Without an effective authority right before, that is a reason as well.
    without = F.col("base").isNull() | (F.col("prior_barred") == 1)
    why = F.when(ok, F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat("own", F.when(without, F.array(F.lit("no_immediately_preceding_authority"))).otherwise(F.array().cast("array<string>")))))
    return o.where("is_id").select("doc_id", "ord", "form", F.when(ok, F.col("base")).alias("authority_id"), F.when(ok, F.lit("immediately_preceding_single_authority")).otherwise(F.lit("unresolved")).alias("method"), F.when(ok, F.lit("high")).otherwise(F.lit("low")).alias("confidence"), why.alias("reasons"))


def resolutions(occ: DataFrame, aliases: DataFrame) -> DataFrame:
    """A row per short form: RESULT."""
    others = short_cases(occ)
    for df in (statutory_shorts(occ), supra_notes(occ), supras(occ), hereinafters(occ, aliases)):
        others = others.unionByName(df)
    return others.unionByName(id_chains(occ, others)).select(RESULT)


def antecedent_edges(resolved: DataFrame) -> DataFrame:
    return resolved.where("authority_id is not null").select("doc_id", F.concat("form", F.lit("_to_antecedent")).alias("edge_type"), F.col("ord").cast("string").alias("source"), F.col("authority_id").alias("target"))
