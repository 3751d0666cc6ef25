"""What a user can put in place of a built-in part: named functions from DataFrames to a DataFrame.

A part that calls a model is such a function too (a pandas UDF inside it); the rest
of the engine only sees the columns it returns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import context, evidence, findings, reduce, retrieval

Part = Callable[..., DataFrame]
KINDS = ("retriever", "reranker", "passage_scorer", "context_reducer", "model", "rule_family")

_parts: dict[tuple[str, str], Part] = {}


def register(kind: str, name: str, part: Part) -> Part:
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    _parts[kind, name] = part
    return part


def part(kind: str, name: str) -> Part:
    """The part of that name; KeyError with the known names if there is none."""
    if (kind, name) not in _parts:
        raise KeyError(f"no {kind} named {name}; known: {names(kind)}")
    return _parts[kind, name]


def names(kind: str) -> list[str]:
    return sorted(n for k, n in _parts if k == kind)


def disabled(tasks: DataFrame) -> DataFrame:
    """The model that answers nothing: every task falls back to the rules."""
    return tasks.withColumn("raw", F.lit(None).cast("string"))


def unchanged(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The reducer that leaves a text whole."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), t.alias("context"), F.lit("bypass").alias("strategy"), F.lit(0).alias("saved_chars"))


for _kind, _name, _part in (
    ("retriever", "lexical", retrieval.lexical_top_k), ("retriever", "rules", retrieval.retrieve_rules), ("retriever", "vector", retrieval.vector_top_k), ("reranker", "none", lambda ranked: ranked),
    ("passage_scorer", "lexical", evidence.rank_passages), ("passage_scorer", "hybrid", evidence.hybrid_scores), ("context_reducer", "focus", reduce.focus_context), ("context_reducer", "document", context.document_context),
    ("context_reducer", "none", unchanged), ("model", "disabled", disabled), ("rule_family", "signals", findings.signal_findings), ("rule_family", "citations", findings.citation_findings),
    ("rule_family", "short_forms", findings.short_form_findings), ("rule_family", "internet", findings.internet_findings), ("rule_family", "integrity", findings.bidi_findings),
):
    register(_kind, _name, _part)
