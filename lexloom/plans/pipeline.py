"""The whole review of a corpus: one call, lazily planned, in named stages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spans import rows_of
from ..operators import extract, findings, graph, lint, mode, resolve, retrieval, review


@dataclass
class CorpusReview:
    """DataFrames by stage; ``release`` gives the kept tables back."""

    citations: DataFrame
    issues: DataFrame
    fixed: DataFrame
    remaining: DataFrame
    modes: DataFrame
    occurrences: DataFrame
    authorities: DataFrame
    edges: DataFrame
    resolutions: DataFrame
    findings: DataFrame
    items: DataFrame
    parsed: DataFrame

    def release(self) -> None:
        self.occurrences.unpersist()
        self.parsed.unpersist()

    def retrieval_wanted(self) -> DataFrame:
        """doc_id, the reasons, and wanted: is guidance worth fetching (see ``retrieval.guidance_gate``)."""
        return retrieval.guidance_gate(self.modes.select("doc_id"), self.findings, self.resolutions, self.modes)


def review_corpus(docs: DataFrame, profile: str = "bluepages", text_col: str = "text", id_col: str = "doc_id") -> CorpusReview:
    """``docs``: id and text. Citations are parsed once, together with what lint and graph take from the text, into one kept table; everything else is derived from it."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    parsed = lint.fix(graph.with_occurrences(extract.with_citations(base)), profile).persist(StorageLevel.MEMORY_AND_DISK)
    occ = graph.occurrence_rows(parsed).persist(StorageLevel.MEMORY_AND_DISK)
    resolved = resolve.resolutions(occ, resolve.alias_targets(parsed, occ))
    edges = graph.neighbour_edges(occ)
    defined = resolve.definition_edges(parsed, occ).drop("alias")
    for more in (graph.sentence_edges(occ), graph.note_edges(occ), graph.context_edges(occ), resolve.later_cases(occ), defined, resolve.antecedent_edges(resolved)):
        edges = edges.unionByName(more)
    issues = rows_of(parsed, "issues", F.col("doc_id"))
    cites = rows_of(parsed, "citations", F.col("doc_id"), at="occ")
    fixed = parsed.select("doc_id", "text", "citations", "issues", "fixed_text", "applied")
    return CorpusReview(cites, issues, fixed, lint.remaining(fixed, profile), mode.document_mode(base), occ, graph.authorities(occ), edges, resolved, findings.findings(base, occ, resolved, profile), review.review_items(issues), parsed)
