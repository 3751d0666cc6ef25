"""Blocks of plain or Markdown-like text: paragraphs, notes, references, sentences, quotations.

In-row expressions: one projection per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.spans import SPAN, below, hit, in_order, let, rows_of, spans, strip

BLOCK = "struct<start:int,end:int,kind:string,block_id:string,note_id:string,note_number:string,text:string>"


def _block(start, end, kind, block_id, note_id, note_number, text) -> Column:
    return F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), block_id.alias("block_id"), note_id.alias("note_id"), note_number.alias("note_number"), text.alias("text")).cast(BLOCK)


def with_blocks(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``blocks`` (paragraphs and note definitions in order) and ``references`` (note markers outside definitions)."""
    text, none = F.coalesce(F.col(text_col), F.lit("")), F.lit(None).cast("string")
    # A text without an empty line is one paragraph.
    whole = F.regexp_extract(text, r"(?sU)\S(?:.*\S)?", 0)
    lone = let(F.struct(F.length(F.regexp_extract(text, r"(?U)\A\s*", 0)).alias("at"), whole.alias("x")), lambda w: F.when(w["x"] != "", F.array(F.struct(w["at"].alias("start"), (w["at"] + F.length(w["x"])).alias("end"), w["x"].alias("text")))).otherwise(F.array().cast(f"array<{SPAN}>")))
    df = docs.withColumn("__para", F.when(F.rlike(text, F.lit(r"(?U)\n\s*\n")), spans(text, P.PARAGRAPH)).otherwise(lone))
    para = F.col("__para")
    lead = lambda s, p: F.regexp_extract(s["text"], p, 0)
    marked = F.transform(para, lambda s: F.struct(s.alias("s"), lead(s, P.NUMBERED_NOTE).alias("num"), lead(s, P.MARKDOWN_NOTE).alias("md")))
    df = df.withColumn("__marked", marked)

    def one(x, i, marks):
        s = x["s"]
        num, md = F.length(x["num"]), F.length(x["md"])
        n = F.regexp_extract(s["text"], P.NUMBERED_NOTE, 1)
        name = F.regexp_extract(s["text"], P.MARKDOWN_NOTE, 1)
        order = below(marks, s["start"] + 1)
        cut = lambda k: F.substring(s["text"], k + 1, F.length(s["text"]))
        numbered = _block(s["start"] + num, s["end"], "footnote", F.concat(F.lit("footnote:"), n, F.lit(":p:0")), n, n, cut(num))
        markdown = _block(s["start"] + md, s["end"], "footnote", F.concat(F.lit("footnote:"), name, F.lit(":p:0")), name, order.cast("string"), cut(md))
        plain = _block(s["start"], s["end"], "paragraph", F.concat(F.lit("body:p:"), i.cast("string")), none, none, s["text"])
        return F.when(num > 0, numbered).when(md > 0, markdown).otherwise(plain)

    notes = F.filter(F.col("__marked"), lambda m: (F.length(m["num"]) > 0) | (F.length(m["md"]) > 0))

    def refs(p):
        name = lambda s: F.regexp_extract(s["text"], p.regex, 1)
        found = let(F.col("__notes"), lambda held: F.filter(spans(text, p), lambda s: ~hit(held, s["start"], s["start"] + 1)))
        return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), name(s).alias("note_id")))

    # Where the notes of Markdown's form begin, in order: they are numbered as they come.
    marks = F.transform(F.filter("__marked", lambda m: (F.length(m["num"]) == 0) & (F.length(m["md"]) > 0)), lambda m: m["s"]["start"])
    df = df.withColumns({"__notes": in_order(F.transform(notes, lambda m: m["s"])), "blocks": let(marks, lambda held: F.transform("__marked", lambda x, i: one(x, i, held)))})
    df = df.withColumn("references", F.concat(refs(P.NOTE_REFERENCE), refs(P.MARKDOWN_REFERENCE)))
    return df.drop("__para", "__marked", "__notes")


def block_rows(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, ord and the fields of BLOCK for paragraphs and notes."""
    return rows_of(with_blocks(docs, text_col), "blocks", F.col(id_col).alias("doc_id"), at="ord")


def outline(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, blocks, paragraphs, footnotes, references, characters of each text: one projection."""
    df = with_blocks(docs, text_col)
    count = lambda kind: F.size(F.filter("blocks", lambda b: b["kind"] == kind))
    return df.select(F.col(id_col).alias("doc_id"), F.size("blocks").alias("blocks"), count("paragraph").alias("paragraphs"), count("footnote").alias("footnotes"), F.size("references").alias("references"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("characters"))


def markdown_rows(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Blocks of Markdown in text order: headings, block quotations, paragraphs, note definitions (numbered as they come) and links."""
    text, none = F.coalesce(F.col(text_col), F.lit("")), F.lit(None).cast("string")
    part = lambda s, p, k: F.regexp_extract(s["text"], p.regex, k)
    lead = lambda x: F.length(x) - F.length(F.regexp_replace(x, r"(?U)\A\s+", ""))
    df = docs.withColumn("__n", spans(text, P.MARKDOWN_DEFINITION))

    def note(s, i):
        body, name = part(s, P.MARKDOWN_DEFINITION, 2), part(s, P.MARKDOWN_DEFINITION, 1)
        start = s["end"] - F.length(body) + lead(body)
        return _block(start, start + F.length(strip(body)), "footnote", F.concat(F.lit("footnote:"), name, F.lit(":p:0")), name, (i + 1).cast("string"), strip(body))

    body = let(in_order(F.col("__n")), lambda held: F.filter(spans(text, P.MARKDOWN_PARAGRAPH), lambda s: ~hit(held, s["start"], s["start"] + 1)))

    def block(s, i):
        head = F.length(F.regexp_extract(s["text"], P.HEADING_MARK, 0))
        quote = F.length(s["text"]) - F.length(F.regexp_replace(s["text"], r"\A[> ]+", ""))
        cut = F.when(s["text"].startswith("#"), head).when(s["text"].startswith(">"), quote).otherwise(F.lit(0))
        inner = F.substring(s["text"], cut + 1, F.length(s["text"]))
        kind = F.when(s["text"].startswith("#"), "heading").when(s["text"].startswith(">"), "block_quotation").otherwise("paragraph")
        name = F.concat(F.when(kind == "heading", "body:h:").when(kind == "block_quotation", "body:q:").otherwise("body:p:"), i.cast("string"))
        return F.struct((s["start"] + cut).alias("start"), s["end"].alias("end"), kind.alias("kind"), name.alias("block_id"), none.alias("note_id"), none.alias("note_number"), inner.alias("text")).cast(BLOCK)

    def link(s, i):
        return _block(s["start"], s["end"], "hyperlink", F.concat(F.lit("link:"), i.cast("string")), none, none, part(s, P.MARKDOWN_LINK, 2))

    all_ = F.array_sort(F.concat(F.transform("__n", note), F.transform(body, block), F.transform(spans(text, P.MARKDOWN_LINK), link)))
    return rows_of(df.withColumn("__m", all_), "__m", F.col(id_col).alias("doc_id"), at="ord")


def sentence_rows(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Sentences of each block: doc_id, block_id, start, end, text, has_citation."""
    blocks = block_rows(docs, text_col, id_col)
    raw = rows_of(blocks.withColumn("__s", spans(F.col("text"), P.SENTENCE)).withColumnsRenamed({"start": "__b", "text": "__x0", "end": "__e"}), "__s", F.col("doc_id"), F.col("block_id"), F.col("__b"))
    lead = F.length("text") - F.length(F.regexp_replace("text", r"(?U)^\s+", ""))
    value = F.regexp_replace(F.regexp_replace("text", r"(?U)^\s+", ""), r"(?U)\s+\z", "")
    out = raw.select("doc_id", "block_id", (F.col("__b") + F.col("start") + lead).alias("start"), value.alias("text")).where("text != ''")
    return out.select("doc_id", "block_id", "start", (F.col("start") + F.length("text")).alias("end"), "text", F.rlike("text", F.lit(P.CITATION_HINT)).alias("has_citation"))


def clause_rows(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Clauses that look like citations, in sentences that do: doc_id, block_id, sentence, clause, start, end, text.

    ``sentence`` numbers a block's sentences from 0 (white space alone is none), ``clause`` what a sentence's semicolons part.
    """
    lead = lambda x: F.length(x) - F.length(F.regexp_replace(x, r"(?U)^\s+", ""))
    blocks = block_rows(docs, text_col, id_col)
    blocks = blocks.withColumn("__s", F.filter(spans(F.col("text"), P.SENTENCE), lambda s: strip(s["text"]) != "")).withColumnsRenamed({"start": "__b", "text": "__x0", "end": "__e"})
    each = rows_of(blocks, "__s", F.col("doc_id"), F.col("block_id"), F.col("__b"), at="sentence")
    each = each.select("doc_id", "block_id", "sentence", (F.col("__b") + F.col("start") + lead(F.col("text"))).alias("__from"), strip(F.col("text")).alias("__text")).where(F.rlike("__text", F.lit(P.CITATION_HINT)))
    parts = rows_of(each.withColumn("__c", spans(F.col("__text"), P.Pattern("[^;]+"))), "__c", F.col("doc_id"), F.col("block_id"), F.col("sentence"), F.col("__from"), at="clause")
    start, value = F.col("__from") + F.col("start") + lead(F.col("text")), strip(F.col("text"))
    out = parts.select("doc_id", "block_id", "sentence", "clause", start.alias("start"), value.alias("text")).where(F.rlike("text", F.lit(P.CITATION_HINT)))
    return out.select("doc_id", "block_id", "sentence", "clause", "start", (F.col("start") + F.length("text")).alias("end"), "text")


def quotation_rows(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    blocks = block_rows(docs, text_col, id_col).withColumn("__q", spans(F.col("text"), P.QUOTATION)).withColumnsRenamed({"start": "__b", "text": "__x0", "end": "__e"})
    rows = rows_of(blocks, "__q", F.col("doc_id"), F.col("block_id"), F.col("__b"))
    return rows.select("doc_id", "block_id", (F.col("__b") + F.col("start")).alias("start"), (F.col("__b") + F.col("end")).alias("end"), "text")


def html_text(html: Column) -> Column:
    """Text of a page: scripts, styles and tags out, common entities decoded, white space collapsed."""
    bare = F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(bare, r"[ \t\n\r\f\x0b]+", " "))
