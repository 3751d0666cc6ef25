"""Guidance by source type and mode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Source type, practitioner rule, academic rule, template, required facts.
SOURCES = (
    ("case", "B10", "Rule 10", "Case name, volume reporter first page, pincite (court year).", ("case name", "volume", "reporter", "first page", "year")),
    ("statute", "B12", "Rule 12", "Title code § section (edition or year when required).", ("code or session-law source", "section")),
    ("regulation", "B14", "Rule 14", "Title C.F.R. § section (year).", ("title", "code", "section", "year")),
    ("constitution", "B11", "Rule 11", "Constitution abbreviation art./amend. subdivision.", ("constitution", "article or amendment")),
    ("journal_article", "B16", "Rule 16", "Author, article title, volume journal first page, pincite (year).", ("author", "title", "volume", "journal", "first page", "year")),
    ("book", "B15", "Rule 15", "Author(s), title pincite (editor/translator, edition year as applicable).", ("author or institutional author", "title", "year")),
    ("court_document", "B17", "Rule 17", "Document title, pincite, case name, docket number (court filing date).", ("document title", "case or proceeding", "docket information", "date")),
    ("internet", "B18", "Rule 18", "Author, page title, website, publication/update date, URL, archive information.", ("page title", "URL")),
    ("ai_content", "B18", "Rule 18.3", "Model or system, provider, description of query/output, query date, permanent archive or on-file copy.", ("model", "provider", "date", "retrievable record")),
    ("archival", "B23", "Rule 23", "Author, document title, pincite (date) (repository, collection, location).", ("document identity", "date if known", "repository or custodian")),
    ("short_form", "B4", "Rule 4", "Id.; shortened case form; or permitted supra/hereinafter form with pincite.", ("unambiguous antecedent",)),
    ("foreign_international_tribal", "B20–B22", "Rules 20–22", "Use the source jurisdiction's preferred form, then the applicable general fallback.", ("jurisdiction or sovereign", "source type", "retrieval information")),
)


# Other names of source types, and which citation forms of each family the rules cover.
SOURCE_ALIASES = {"internet_url": "internet", "website": "internet", "case_law": "case", "periodical": "journal_article", "short_forms": "short_form", "statutes": "statute", "regulations": "regulation"}
COVERAGE = (
    ("cases", "partial", ("full form", "short form", "Id.", "pincites")),
    ("statutes", "partial", ("full form", "short form", "Id.")),
    ("regulations", "partial", ("full form", "short form", "Id.")),
    ("constitutions", "partial", ("recognition",)),
    ("administrative_decisions_and_register_materials", "unsupported", ()),
    ("books_and_treatises", "partial", ("supra", "hereinafter", "pincite review")),
    ("journal_articles", "partial", ("recognition", "supra", "supra note", "pincites")),
    ("newspapers_and_magazines", "unsupported", ()),
    ("court_and_docket_documents", "partial", ("supra", "hereinafter")),
    ("internet_sources_and_blogs", "partial", ("URL recognition", "Whitepages archive review")),
    ("archival_sources", "partial", ("supra", "hereinafter")),
    ("foreign_international_and_tribal", "unsupported", ()),
    ("ai_generated_materials", "unsupported", ()),
)

#: What holds for every citation, in any mode, and in one mode.
CORE = (
    "Change only how a citation is written; never add a name, number, date or page that the text does not give.",
    "A short form stands for one earlier authority. Where more than one fits, none is chosen.",
    "Whether an authority is still in force or supports a statement is for a person to judge.",
)
GENERAL = ("Local court rules and a journal's own style go before these summaries.", "Check every quoted word and page against the source.")
MODES = {
    "bluepages": ("Citations stand in the text, as sentences or clauses.", "Names of cases are underlined or in italics."),
    "whitepages": ("Citations stand in notes.", "An Id. or supra refers to notes by their number.", "Links need an archived copy or a copy on file."),
}


def knowledge_pack(spark: SparkSession, mode: str, source_types: list[str] | None = None) -> DataFrame:
    """Rows (section, source_type, rule, content, required_facts): core, general and mode guidance, then each wanted source type in order.

    Other names of source types are known; unknown ones are left out, but ValueError if none is left.
    """
    if mode not in MODES:
        raise ValueError("mode must be bluepages or whitepages")
    known = {s[0]: s for s in SOURCES}
    wanted = list(known)
    if source_types is not None:
        plain = [SOURCE_ALIASES.get(x.strip().lower(), x.strip().lower()) for x in source_types]
        wanted = list(dict.fromkeys(x for x in plain if x in known))
        if not wanted:
            raise ValueError(f"source types are {sorted(known)}")
    rows = [(k, None, None, line, None) for k, lines in (("core", CORE), ("general", GENERAL), ("mode", MODES[mode])) for line in lines]
    rows += [("source", x, known[x][1 if mode == "bluepages" else 2], known[x][3], list(known[x][4])) for x in wanted]
    return spark.createDataFrame(rows, "section string, source_type string, rule string, content string, required_facts array<string>")


def rule_coverage(spark: SparkSession) -> DataFrame:
    """family, status, implemented_rules: what the rules cover of each family of sources (a tested part, never all of a manual)."""
    return spark.createDataFrame([(f, s, list(r)) for f, s, r in COVERAGE], "family string, status string, implemented_rules array<string>")


def source_guidance(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b, c, d, list(e)) for a, b, c, d, e in SOURCES], "source_type string, bluepages_rule string, whitepages_rule string, template string, required_facts array<string>")


def with_guidance(rows: DataFrame, mode: str = "bluepages") -> DataFrame:
    """``rows`` with a ``source_type``, and the rule, template and required facts of it. The table is fixed and tiny, so it is broadcast."""
    g = source_guidance(rows.sparkSession).select("source_type", F.col(f"{mode}_rule").alias("rule"), "template", "required_facts")
    return rows.join(F.broadcast(g), "source_type", "left")
