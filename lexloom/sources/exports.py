"""Documents as files: text, Markdown, PDF, and DOCX packages with edits made in place.

Files are rows (filename, media_type, content), so a job writes millions of them as
one table; nothing is written to a worker's own disk.
"""

from __future__ import annotations

import io
import re
import textwrap
import zipfile
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.sessions import safe_filename
from .files import DOCX, MAX_PART
from .sinks import tracked_docx

MEDIA = {"txt": "text/plain", "md": "text/markdown", "pdf": "application/pdf", "docx": DOCX}
PAGE, MARGIN, SIZE, LEADING, WIDTH = (612, 792), 72, 11, 14, 86
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def pdf_pages(text: str) -> list[list[str]]:
    """Lines of each page: wrapped at WIDTH characters, as many as fit between the margins."""
    lines = [part for line in text.split("\n") for part in (textwrap.wrap(line, WIDTH, replace_whitespace=False, drop_whitespace=False) or [""])]
    most = (PAGE[1] - 2 * MARGIN) // LEADING
    return [lines[i : i + most] for i in range(0, len(lines), most)] or [[""]]


def make_pdf(text: str, title: str = "") -> bytes:
    """A PDF 1.4 file with one built-in font; what that font lacks is shown as a question mark."""

    def string(s: str) -> bytes:
        raw = s.encode("cp1252", "replace")
        return b"(" + re.sub(rb"([\\()])", rb"\\\1", raw) + b")"

    pages = pdf_pages(text)
    first = 4
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (first + 2 * i) for i in range(len(pages))) + b"] /Count %d >>" % len(pages),
        3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Times-Roman /Encoding /WinAnsiEncoding >>",
    }
    for i, lines in enumerate(pages):
        shown = b"BT /F1 %d Tf %d TL %d %d Td\n" % (SIZE, LEADING, MARGIN, PAGE[1] - MARGIN) + b"".join(string(x) + b" Tj T*\n" for x in lines) + b"ET"
        objects[first + 2 * i] = b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d %d] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (*PAGE, first + 2 * i + 1)
        objects[first + 2 * i + 1] = b"<< /Length %d >>\nstream\n" % len(shown) + shown + b"\nendstream"
    info = max(objects) + 1
    objects[info] = b"<< /Title " + string(title) + b" >>"
    out, places = io.BytesIO(), []
    out.write(b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n")
    for n in sorted(objects):
        places.append(out.tell())
        out.write(b"%d 0 obj\n" % n + objects[n] + b"\nendobj\n")
    at = out.tell()
    out.write(b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places))
    out.write(b"trailer\n<< /Size %d /Root 1 0 R /Info %d 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, info, at))
    return out.getvalue()


def _nodes(body) -> tuple[str, list[tuple[int, int, ET.Element]]]:
    """The text of a body's paragraphs (two line ends between those with text) and the place of each text node in it."""
    text, nodes = "", []
    for p in body.iter(f"{_W}p"):
        own = [t for t in p.iter(f"{_W}t") if t.text]
        if not own:
            continue
        text += "\n\n" if text else ""
        for t in own:
            nodes.append((len(text), len(text) + len(t.text), t))
            text += t.text
    return text, nodes


def patch_docx(data: bytes, edits: list[tuple[int, int, str, str]]) -> dict:
    """``content`` with edits (start, end, original, replacement) made inside the runs that hold them; ``error`` if one can't be.

    Places count in the text of the body's paragraphs. Formatting, notes, and every other part of the package stay as they are; the
    replacement takes the formatting of the run in which the edit begins. Overlapping or stale edits refuse the whole.
    """
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            infos = z.infolist()
            if any(i.file_size > MAX_PART for i in infos):
                return {"content": None, "error": "part_too_large"}
            parts = {i.filename: z.read(i) for i in infos}
        raw = parts["word/document.xml"]
        if b"<!DOCTYPE" in raw or b"<!ENTITY" in raw:
            return {"content": None, "error": "invalid_docx"}
        for prefix, uri in re.findall(rb'xmlns:([A-Za-z0-9]+)="([^"]+)"', raw):
            if not re.match(rb"ns\d+\Z", prefix):
                ET.register_namespace(prefix.decode(), uri.decode())
        root = ET.fromstring(raw)
        text, nodes = _nodes(root.find(f"{_W}body"))
    except (zipfile.BadZipFile, KeyError, ET.ParseError, RuntimeError, AttributeError):
        return {"content": None, "error": "invalid_docx"}
    edits = sorted(edits)
    if any(a[1] > b[0] for a, b in zip(edits, edits[1:])):
        return {"content": None, "error": "overlapping_edits"}
    if any(text[s:e] != original or "\n" in original for s, e, original, _ in edits):
        return {"content": None, "error": "stale_text"}
    for start, end, _, new in reversed(edits):
        held = [(a, b, t) for a, b, t in nodes if a < end and start < b]
        if not held:
            return {"content": None, "error": "stale_text"}
        for k, (a, b, t) in reversed(list(enumerate(held))):
            low, high = max(start, a) - a, min(end, b) - a
            t.text = t.text[:low] + (new if k == 0 else "") + t.text[high:]
            t.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
    parts["word/document.xml"] = ET.tostring(root, encoding="UTF-8", xml_declaration=True)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for i in infos:
            z.writestr(i, parts[i.filename])
    return {"content": out.getvalue(), "error": None}


@F.pandas_udf(T.StructType([T.StructField("content", T.BinaryType()), T.StructField("error", T.StringType())]))
def _patched(content: pd.Series, edits: pd.Series) -> pd.DataFrame:
    rows = [patch_docx(bytes(c), [(e["start"], e["end"], e["original"], e["suggestion"]) for e in (x if x is not None else [])]) if c is not None else {"content": None, "error": "empty_document"} for c, x in zip(content, edits)]
    return pd.DataFrame(rows, columns=["content", "error"])


def with_patched_docx(packages: DataFrame, content_col: str = "content", edits_col: str = "edits") -> DataFrame:
    """``packages`` with ``patched`` (content, error): edits is array<struct<start:int,end:int,original:string,suggestion:string>>."""
    return packages.withColumn("patched", _patched(F.col(content_col), F.col(edits_col)))


@F.pandas_udf(T.BinaryType())
def _pdf(text: pd.Series, title: pd.Series) -> pd.Series:
    return pd.Series([make_pdf(t or "", n or "") for t, n in zip(text, title)])


@F.pandas_udf(T.BinaryType())
def _docx(text: pd.Series) -> pd.Series:
    return pd.Series([tracked_docx(t or "", []) for t in text])


def export_artifacts(docs: DataFrame, format: str = "txt", text_col: str = "text", title_col: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """export_id, format, filename, media_type, content: a file per document. Text and Markdown stay in the JVM."""
    if format not in MEDIA:
        raise ValueError(f"format must be one of {sorted(MEDIA)}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    title = F.coalesce(F.col(title_col), F.lit("")) if title_col else F.lit("")
    content = {"txt": lambda: F.encode(text, "UTF-8"), "md": lambda: F.encode(text, "UTF-8"), "pdf": lambda: _pdf(text, title), "docx": lambda: _docx(text)}[format]()
    name = F.coalesce(F.nullif(safe_filename(title), F.lit("")), F.concat(F.lit("document-"), F.col(id_col).cast("string")))
    return docs.select(F.col(id_col).cast("string").alias("export_id"), F.lit(format).alias("format"), F.concat(name, F.lit(f".{format}")).alias("filename"), F.lit(MEDIA[format]).alias("media_type"), content.alias("content"))


def write_training(records: DataFrame, path: str) -> None:
    """Training records as JSON lines."""
    records.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def save_library(chunks: DataFrame, path: str) -> None:
    """A rule library (see ``retrieval.retrieve_rules``) as JSON lines, ordered by chunk_id within files."""
    chunks.sortWithinPartitions("chunk_id").write.mode("overwrite").json(path)


def load_library(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("chunk_id string, heading string, text string, mode string, source_type string, rule_family string, jurisdiction string, revision_date string").json(path)


def real_document_report(scores: DataFrame, summary: DataFrame, path: str) -> None:
    """The scores of real documents as JSON: numbers, flags and ids, never a text or a path."""
    keep = [f.name for f in scores.schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType)) or f.name in ("document_id", "split", "error_code")]
    scores.select(*keep).write.mode("errorifexists").json(f"{path}/documents")
    summary.write.mode("errorifexists").json(f"{path}/summary")
