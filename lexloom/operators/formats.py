"""Citations written from supplied facts. A missing fact is reported, never invented."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import CODES, REPORTERS, canonical
from .extract import with_citations

# Required facts by source type.
REQUIRED = {
    "case": ("case_name", "volume", "reporter", "first_page", "year"),
    "statute": ("title", "code", "section"),
    "regulation": ("title", "code", "section", "year"),
    "constitution": ("constitution", "subdivision"),
    "journal_article": ("author", "title", "volume", "journal", "first_page", "year"),
    "book": ("author", "title", "year"),
    "internet": ("title", "site", "url"),
    "court_document": ("document_title", "case_name", "docket_number"),
    "ai_content": ("model", "provider", "date"),
    "archival": ("author", "document_title", "date", "archive"),
}
STYLES = ("plain", "markdown", "html")


def generate(df: DataFrame, type_col: str = "source_type", fields_col: str = "fields", style: str = "plain") -> DataFrame:
    """``df`` with ``citation`` (null unless complete), ``missing`` (names of absent facts) and ``status``. ``fields``: map<string,string>."""
    if style not in STYLES:
        raise ValueError(f"style must be one of {STYLES}")
    kind = F.lower(F.trim(F.coalesce(F.col(type_col), F.lit(""))))
    kind = F.when(kind == "website", F.lit("internet")).otherwise(kind)
    df = df.withColumn("__kind", kind)

    def f(name):
        raw = F.trim(F.col(fields_col)[name])
        if style == "html":
            for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
                raw = F.replace(raw, F.lit(a), F.lit(b))
        return F.nullif(raw, F.lit(""))

    def italic(x):
        return x if style == "plain" else F.concat(F.lit("*" if style == "markdown" else "<i>"), x, F.lit("*" if style == "markdown" else "</i>"))

    def opt(before, x, after=""):
        return F.when(x.isNotNull(), F.concat(F.lit(before), x, F.lit(after))).otherwise(F.lit(""))

    def both(*xs):
        return F.nullif(F.concat_ws(" ", *xs), F.lit(""))

    c, sp, comma = F.concat, F.lit(" "), F.lit(", ")
    section = F.trim(F.regexp_replace(f("section"), "^[§ ]+", ""))
    code = c(f("title"), sp, canonical(f("code"), CODES), F.lit(" § "), section)
    on_file = F.lower(F.coalesce(F.col(fields_col)["on_file_with_author"], F.lit(""))).isin("true", "1", "yes")
    made = {
        "case": c(italic(f("case_name")), comma, f("volume"), sp, canonical(f("reporter"), REPORTERS), sp, f("first_page"), opt(", ", f("pincite")), F.lit(" ("), both(f("court"), f("year")), F.lit(")")),
        "statute": c(code, opt(" (", f("year"), ")")),
        "regulation": c(code, F.lit(" ("), f("year"), F.lit(")")),
        "constitution": c(f("constitution"), sp, f("subdivision")),
        "journal_article": c(f("author"), comma, f("title"), comma, f("volume"), sp, f("journal"), sp, f("first_page"), opt(", ", f("pincite")), F.lit(" ("), f("year"), F.lit(")")),
        "book": c(f("author"), comma, italic(f("title")), opt(" ", f("pincite")), F.lit(" ("), both(f("edition"), f("year")), F.lit(")")),
        "internet": c(opt("", f("author"), ", "), italic(f("title")), comma, f("site"), opt(" (", f("date"), ")"), comma, f("url"), F.when(f("archive_url").isNotNull(), c(F.lit(" [archived at "), f("archive_url"), F.lit("]"))).when(on_file, F.lit(" (on file with author)")).otherwise(F.lit(""))),
        "court_document": c(f("document_title"), comma, f("case_name"), F.lit(", No. "), f("docket_number"), opt(", ECF No. ", f("docket_entry")), opt(" (", both(f("court"), f("date")), ")")),
        "ai_content": c(f("model"), F.lit(" ("), f("provider"), F.lit("), "), F.coalesce(f("prompt_title"), F.lit("Response to author query")), F.lit(" ("), f("date"), F.lit(")"), F.when(f("archive_url").isNotNull(), c(comma, f("archive_url"))).otherwise(F.lit(" (on file with author)"))),
        "archival": c(f("author"), comma, f("document_title"), opt(", ", f("pincite")), F.lit(" ("), f("date"), F.lit(") (on file with "), F.concat_ws(", ", f("archive"), f("collection"), f("location")), F.lit(")")),
    }
    k, text, missing = F.col("__kind"), F.lit(None).cast("string"), F.array().cast("array<string>")
    for name, need in REQUIRED.items():
        gone = F.filter(F.array(*[F.when(f(n).isNull(), F.lit(n)) for n in need]), lambda x: x.isNotNull())
        if name == "ai_content":
            gone = F.concat(gone, F.when(f("archive_url").isNull() & ~on_file, F.array(F.lit("archive_url or on_file_with_author"))).otherwise(F.array().cast("array<string>")))
        text, missing = F.when(k == name, made[name]).otherwise(text), F.when(k == name, gone).otherwise(missing)
    df = df.withColumn("missing", missing)
    known = k.isin(*REQUIRED)
    ok = known & (F.size("missing") == 0)
    return df.withColumn("citation", F.when(ok, text)).withColumn("status", F.when(~known, "unsupported_source_type").when(ok, "ok").otherwise("missing_facts")).drop("__kind")


def convert(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", style: str = "plain") -> DataFrame:
    """doc_id, source_type, citation, missing, status for texts that hold exactly one citation but short forms; others get status ``not_one_citation``."""
    df = with_citations(docs, text_col)
    full = F.filter("citations", lambda c: ~c["source_type"].isin("short_form", "internet"))
    df = df.select(F.col(id_col).alias("doc_id"), F.size(full).alias("n"), F.try_element_at(full, F.lit(1)).alias("c"))
    part = lambda n: F.col("c.components")[n]
    both_ = F.coalesce(part("court_year"), F.lit(""))
    year = F.coalesce(part("year"), part("date_year"), part("inline_year"), F.regexp_extract(both_, r"(\d{4})\s*$", 1))
    court = F.coalesce(part("court"), F.trim(F.regexp_replace(both_, r"\d{4}\s*$", "")))
    fields = F.map_filter(F.map_concat(F.coalesce(F.map_filter("c.components", lambda k, v: ~k.isin("court_year", "symbol", "page", "year", "court", "date_year", "inline_year")), F.create_map().cast("map<string,string>")), F.create_map(F.lit("year"), year, F.lit("court"), court, F.lit("constitution"), F.when(F.col("c.source_type") == "constitution", F.lit("U.S. Const.")).otherwise(F.lit("")))), lambda _, v: v.isNotNull() & (v != ""))
    out = generate(df.withColumn("source_type", F.col("c.source_type")).withColumn("fields", fields), style=style)
    one = F.col("n") == 1
    return out.select("doc_id", F.when(one, F.col("source_type")).alias("source_type"), F.when(one, F.col("citation")).alias("citation"), F.when(one, F.col("missing")).otherwise(F.array().cast("array<string>")).alias("missing"), F.when(one, F.col("status")).otherwise(F.lit("not_one_citation")).alias("status"))


