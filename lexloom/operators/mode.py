"""Is a document a filing (bluepages) or academic (whitepages)? Weighted evidence, told with the answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..sources.blocks import with_blocks


def _evidence(*items: tuple[Column, Column]) -> Column:
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), v) for c, v in items]), lambda x: x.isNotNull())


def document_mode(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", title_col: str | None = None, subject_col: str | None = None, type_col: str | None = None, explicit: str = "auto") -> DataFrame:
    """doc_id, mode, confidence, evidence, conflicts, confirm, blue_score, white_score, reason, status (``error`` for an unknown type)."""
    if explicit not in ("auto", "bluepages", "whitepages"):
        raise ValueError("explicit must be auto, bluepages or whitepages")
    text = F.coalesce(F.col(text_col), F.lit(""))
    title, subject = (F.col(c) if c else F.lit(None).cast("string") for c in (title_col, subject_col))
    kind = F.replace(F.replace(F.lower(F.trim(F.coalesce(F.col(type_col) if type_col else F.lit("auto"), F.lit("auto")))), F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_"))
    seen = F.concat_ws(" ", F.nullif(title, F.lit("")), F.nullif(subject, F.lit("")), F.substring(text, 1, 4000))
    df = with_blocks(docs, text_col).withColumns({"__kind": kind, "__seen": seen, "__notes": F.size(F.filter("blocks", lambda b: b["kind"] == "footnote")), "__inline": F.regexp_count(text, F.lit(P.CITATION_HINT))})
    k, notes, inline = F.col("__kind"), F.col("__notes"), F.col("__inline")
    blue = _evidence(
        (k.isin(*P.BLUE_TYPES), F.concat(F.lit("document_type:"), k)),
        (F.rlike("__seen", F.lit(P.FILING_WORDS)), F.lit("court_filing_language")),
        ((inline >= 2) & (notes == 0), F.concat(F.lit("inline_citations:"), inline.cast("string"))),
        (F.rlike(title, F.lit("(?i)brief|motion|memorandum")), F.lit("document_metadata_title")),
    )
    white = _evidence(
        (k.isin(*P.WHITE_TYPES), F.concat(F.lit("document_type:"), k)),
        (F.rlike("__seen", F.lit(P.ACADEMIC_WORDS)), F.lit("academic_language")),
        (F.rlike(F.substring(text, 1, 300), F.lit(P.BYLINE)), F.lit("author_byline")),
        (notes > 0, F.concat(F.lit("numbered_notes:"), notes.cast("string"))),
        (F.rlike(title, F.lit("(?i)article|review|paper|note")), F.lit("document_metadata_title")),
    )
    score = lambda e: F.aggregate(e, F.lit(0), lambda a, x: a + F.when(x.startswith("document_type:"), F.lit(2)).otherwise(F.lit(1)))
    df = df.withColumns({"__blue": blue, "__white": white}).withColumns({"blue_score": score(F.col("__blue")), "white_score": score(F.col("__white"))})
    academic = F.col("white_score") > F.col("blue_score")
    margin, best = F.abs(F.col("blue_score") - F.col("white_score")), F.greatest("blue_score", "white_score")
    if explicit == "auto":
        mode = F.when(academic, "whitepages").otherwise("bluepages")
        evidence, conflicts = F.when(academic, F.col("__white")).otherwise(F.col("__blue")), F.when(academic, F.col("__blue")).otherwise(F.col("__white"))
        confidence = F.when((margin >= 2) & (best >= 2), "high").when(margin >= 1, "medium").otherwise("low")
        confirm = (confidence == "low") | ((F.size(conflicts) > 0) & (margin <= 1))
    else:
        mode, evidence, confidence, confirm = F.lit(explicit), F.array(F.lit(f"explicit_mode:{explicit}")), F.lit("high"), F.lit(False)
        conflicts = F.col("__white") if explicit == "bluepages" else F.col("__blue")
    status = F.when((k == "auto") | k.isin(*P.BLUE_TYPES, *P.WHITE_TYPES), "ok").otherwise("error")
    reason = F.when(F.size(evidence) > 0, F.try_element_at(evidence, F.lit(1))).otherwise(F.lit("default_bluepages_due_to_insufficient_evidence"))
    return df.select(F.col(id_col).alias("doc_id"), mode.alias("mode"), confidence.alias("confidence"), evidence.alias("evidence"), conflicts.alias("conflicts"), confirm.alias("confirm"), "blue_score", "white_score", reason.alias("reason"), status.alias("status"))
