"""Uploaded files as documents: a router over ``binaryFile``, text decoding, and DOCX packages.

Problems are told in ``error_code``; one bad file never fails the job. Text goes
through Catalyst alone; only DOCX packages go through Python, a batch at a time.
"""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Limits, types and error codes.
MAX_BYTES = 15 * 1024 * 1024
MAX_PART = 50 * 1024 * 1024
DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
FORMATS = {"text/plain": "text", "text/markdown": "markdown", DOCX: "docx", "application/pdf": "pdf"}
SUFFIXES = {"txt": "text", "md": "markdown", "markdown": "markdown", "docx": "docx", "pdf": "pdf"}
ERRORS = ("empty_document", "document_too_large", "invalid_text_encoding", "invalid_docx", "ocr_required", "unsupported_document_type")

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_DC = "{http://purl.org/dc/elements/1.1/}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """filename, mime_type (unknown), length, content of the files under a path; the content of a file above the limit is null.

    The reader fails on files of 2 GB, so contents above the limit are never asked for: the filter on ``length`` goes to the listing.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    name = [F.element_at(F.split("path", "/"), -1).alias("filename"), F.lit(None).cast("string").alias("mime_type"), F.col("length")]
    small = files.where(F.col("length") <= MAX_BYTES).select(*name, "content")
    large = files.where(F.col("length") > MAX_BYTES).select(*name, F.lit(None).cast("binary").alias("content"))
    return small.unionByName(large)


def from_base64(rows: DataFrame, col: str = "data") -> DataFrame:
    """``rows`` with ``content`` decoded; too long a text is not decoded at all, bad base64 is null."""
    fits = F.length(col) <= MAX_BYTES * 4 / 3 + 8
    return rows.withColumn("content", F.when(fits, F.try_to_binary(F.col(col), F.lit("base64")))).withColumn("too_large", ~fits)


def source_format(filename: Column, mime: Column) -> Column:
    """A known MIME type counts more than the file's ending."""
    bare = F.lower(F.trim(F.split_part(F.coalesce(mime, F.lit("")), F.lit(";"), F.lit(1))))
    pick = lambda table, key: F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)
    suffix = F.lower(F.regexp_extract(filename, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(pick(FORMATS, bare), pick(SUFFIXES, suffix))


def docx_text(data: bytes) -> dict:
    """Text of a package in reading order (notes last, numbered from 1), its title, author and subject, and its links (text and address by the body's relationships); ``error`` if it can't be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = set(z.namelist())

            def xml(name):
                if z.getinfo(name).file_size > MAX_PART:
                    raise ValueError("part too large")
                raw = z.read(name)
                if b"<!DOCTYPE" in raw or b"<!ENTITY" in raw:
                    raise ValueError("document type declaration")
                return ET.fromstring(raw)

            notes: list[tuple[str, list[str]]] = []
            number: dict[tuple[str, str], str] = {}
            for kind in ("footnote", "endnote"):
                if f"word/{kind}s.xml" in names:
                    shown = [n for n in xml(f"word/{kind}s.xml").findall(f"{_W}{kind}") if int(n.get(f"{_W}id", "-1")) > 0]
                    for k, n in enumerate(shown, 1):
                        number[kind, n.get(f"{_W}id")] = str(k)
                        notes.append((str(k), [t for p in n.findall(f"{_W}p") if (t := _paragraph(p, {})).strip()]))
            rels = {r.get("Id"): r.get("Target") for r in xml("word/_rels/document.xml.rels") if r.get("TargetMode") == "External"} if "word/_rels/document.xml.rels" in names else {}
            parts, kinds, links = [], [], []
            body = xml("word/document.xml").find(f"{_W}body")
            for child in body if body is not None else ():
                if child.tag == f"{_W}p":
                    text = _paragraph(child, number)
                    style = child.find(f"{_W}pPr/{_W}pStyle")
                    if text:
                        parts.append(text)
                        kinds.append("heading" if style is not None and style.get(f"{_W}val", "").lower().startswith("heading") else "paragraph")
                elif child.tag == f"{_W}tbl":
                    rows = [["\n".join(_paragraph(p, {}) for p in cell.findall(f"{_W}p")) for cell in row.findall(f"{_W}tc")] for row in child.findall(f"{_W}tr")]
                    parts.append("\n".join("\t".join(r) for r in rows))
                    kinds.append("table")
            for link in body.iter(f"{_W}hyperlink") if body is not None else ():
                if link.get(f"{_R}id") in rels:
                    links.append({"text": _paragraph(link, number), "url": rels[link.get(f"{_R}id")]})
            for k, texts in notes:
                for t in texts:
                    parts.append(f"[{k}] {t}")
                    kinds.append("footnote")
            core = xml("docProps/core.xml") if "docProps/core.xml" in names else None
            meta = {n: core.findtext(f"{_DC}{t}") if core is not None else None for n, t in (("title", "title"), ("author", "creator"), ("subject", "subject"))}
            return {"text": "\n\n".join(parts), "kinds": kinds, "links": links, "error": None, **meta}
    except (zipfile.BadZipFile, KeyError, ValueError, ET.ParseError, RuntimeError):
        return {"text": None, "kinds": None, "links": None, "error": "invalid_docx", "title": None, "author": None, "subject": None}


def _paragraph(node, number: dict) -> str:
    out = []
    for e in node.iter():
        tag = e.tag.rpartition("}")[2]
        if tag in ("t", "delText") and e.text:
            out.append(e.text)
        elif tag == "tab" and e is not node:
            out.append("\t")
        elif tag in ("br", "cr"):
            out.append("\n")
        elif tag in ("footnoteReference", "endnoteReference"):
            i = e.get(f"{_W}id", "")
            out.append(f"[{number.get((tag[:-9], i), i)}]")
    return "".join(out)


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("kinds", T.ArrayType(T.StringType())), T.StructField("links", T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("url", T.StringType())]))), *(T.StructField(n, T.StringType()) for n in ("error", "title", "author", "subject"))]))
def _docx(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([docx_text(bytes(x)) if x is not None else {} for x in content], columns=["text", "kinds", "links", "error", "title", "author", "subject"])


def load_documents(files: DataFrame) -> DataFrame:
    """filename, source_format, text, title, author, subject, links, sha256, error_code. ``files``: filename, mime_type, content, and (as ``read_files`` gives it) length.

    PDF needs a parser that is not part of this library: such files get ``ocr_required``.
    """
    size = F.coalesce(*([F.col("length")] if "length" in files.columns else []), F.length("content"), F.lit(0))
    df = files.withColumn("source_format", source_format(F.col("filename"), F.col("mime_type"))).withColumn("__size", size)
    usable = (F.col("__size") > 0) & (F.col("__size") <= MAX_BYTES)
    # Only packages go through Python; all other rows take the other branch.
    package = F.coalesce(usable & (F.col("source_format") == "docx"), F.lit(False))
    read = df.where(package).withColumn("__x", _docx(F.col("content")))
    df = read.unionByName(df.where(~package).withColumn("__x", F.lit(None).cast(read.schema["__x"].dataType)))
    plain = F.col("source_format").isin("text", "markdown")
    raw = F.when(usable & plain & F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    text = F.coalesce(F.regexp_replace(raw, "^﻿", ""), F.col("__x.text"))
    error = (
        F.when(F.col("__size") == 0, "empty_document").when(F.col("__size") > MAX_BYTES, "document_too_large").when(F.col("source_format").isNull(), "unsupported_document_type").when(F.col("source_format") == "pdf", "ocr_required")
        .when(plain & raw.isNull(), "invalid_text_encoding").when(F.col("__x.error").isNotNull(), F.col("__x.error")).when(F.trim(F.regexp_replace(text, r"\s+", " ")) == "", "empty_document")
    )
    ok = error.isNull()
    return df.select("filename", "source_format", F.when(ok, text).alias("text"), "__x.title", "__x.author", "__x.subject", "__x.links", F.sha2("content", 256).alias("sha256"), error.alias("error_code"))


def pdf_notes(fragments: DataFrame) -> DataFrame:
    """``fragments`` (doc_id, page, x, y, font, height, text) with ``note`` confidence: low on the page and in small type, low only, or none."""
    mid = fragments.groupBy("doc_id", "page").agg(F.percentile("font", 0.5).alias("median"))
    j = fragments.join(mid, ["doc_id", "page"])
    low, small = F.col("y") < 0.15 * F.col("height"), F.col("font") < 0.85 * F.col("median")
    return j.withColumn("note", F.when(low & small, "medium").when(low, "low")).drop("median")


def read_jsonl(spark: SparkSession, path: str, schema: str, key: str | None = None, allowed: dict[str, tuple] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON lines (blank ones skipped), and the problems: lines that don't parse, values that aren't ``allowed`` in their column, keys that come twice."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select("value", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"))
    bad = rows.where(F.try_parse_json("value").isNull()).select(F.col("value").alias("what"), F.lit("invalid_json").alias("problem"))
    good = rows.where(F.try_parse_json("value").isNotNull()).select("r.*")
    for name, values in (allowed or {}).items():
        wrong = rows.where(F.try_parse_json("value").isNotNull() & ~F.coalesce(F.col(f"r.{name}").isin(*values), F.lit(False)))
        bad = bad.unionByName(wrong.select(F.col("value").alias("what"), F.lit(f"not_allowed:{name}").alias("problem")))
        good = good.where(F.coalesce(F.col(name).isin(*values), F.lit(False)))
    if key:
        twice = good.groupBy(key).count().where("count > 1").select(F.col(key).cast("string").alias("what"), F.lit("duplicate_key").alias("problem"))
        bad = bad.unionByName(twice)
    return good, bad


def rule_library(manifest: DataFrame) -> DataFrame:
    """Manifest rows that may be used: included, redistributable, with a licence that isn't proprietary."""
    licence = F.lower(F.trim(F.coalesce("license", F.lit(""))))
    return manifest.where(F.col("included") & F.col("redistribution_allowed") & (licence != "") & (licence != "proprietary"))
