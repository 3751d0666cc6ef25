"""Results written out: texts, DOCX with tracked changes, audit reports and training records."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import evaluate

_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
_RELS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'


def tracked_docx(text: str, edits: list[tuple[int, int, str]], author: str = "lexloom") -> bytes:
    """A package of the text with each edit as a tracked deletion and insertion."""
    runs, at = [], 0

    def run(t, tag="t"):
        return f'<w:r><w:{tag} xml:space="preserve">{escape(_clean(t))}</w:{tag}></w:r>' if t else ""

    for k, (start, end, new) in enumerate(sorted(edits)):
        runs.append(("keep", text[at:start]))
        runs.append(("edit", f'<w:del w:id="{2 * k + 1}" w:author="{author}">{run(text[start:end], "delText")}</w:del><w:ins w:id="{2 * k + 2}" w:author="{author}">{run(new)}</w:ins>'))
        at = end
    runs.append(("keep", text[at:]))
    body = "<w:p>"
    for kind, x in runs:
        body += x if kind == "edit" else "</w:p><w:p>".join(run(line) for line in x.split("\n"))
    xml = f'<?xml version="1.0" encoding="UTF-8"?><w:document {_NS}><w:body>{body}</w:p></w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in (("[Content_Types].xml", _TYPES), ("_rels/.rels", _RELS), ("word/document.xml", xml)):
            z.writestr(zipfile.ZipInfo(name), data)
    return out.getvalue()


def _clean(t: str) -> str:
    return re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", " ", t)


def package_report(data: bytes, most: int = 250 * 1024 * 1024) -> dict:
    """valid, errors, parts and bytes of a DOCX package: required parts, duplicate, unsafe or linked names, size,
    targets of relationships that are not there, and comments that are referred to but missing."""
    errors, texts = [], {}
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            infos = z.infolist()
            if sum(i.file_size for i in infos) <= most:
                texts = {i.filename: z.read(i).decode("utf-8", "replace") for i in infos if not i.flag_bits & 1 and i.filename.endswith((".rels", "document.xml", "comments.xml"))}
    except (zipfile.BadZipFile, RuntimeError, NotImplementedError):
        return {"valid": False, "errors": ["not_a_package"], "parts": 0, "bytes": 0}
    names = [i.filename for i in infos]
    errors += [f"missing:{n}" for n in ("[Content_Types].xml", "word/document.xml") if n not in names]
    errors += [f"duplicate:{n}" for n in sorted({n for n in names if names.count(n) > 1})]
    errors += [f"unsafe:{n}" for n in names if n.startswith("/") or ".." in n.split("/") or "\\" in n]
    errors += [f"encrypted:{i.filename}" for i in infos if i.flag_bits & 1]
    errors += [f"link:{i.filename}" for i in infos if (i.external_attr >> 16) & 0o170000 == 0o120000]
    for name in sorted(n for n in texts if n.endswith(".rels")):
        folder = name.rpartition("_rels/")[0]
        for rel in re.findall(r"<Relationship\b[^>]*>", texts[name]):
            target = re.search(r'\bTarget="([^"]*)"', rel)
            if target and 'TargetMode="External"' not in rel:
                path = target[1].lstrip("/") if target[1].startswith("/") else posixpath.normpath(folder + target[1])
                if path not in names:
                    errors.append(f"no_target:{path}")
    asked = set(re.findall(r'<w:commentReference\b[^>]*w:id="([^"]*)"', texts.get("word/document.xml", "")))
    there = set(re.findall(r'<w:comment\b[^>]*w:id="([^"]*)"', texts.get("word/comments.xml", "")))
    errors += [f"no_comment:{i}" for i in sorted(asked - there)]
    size = sum(i.file_size for i in infos)
    if size > most:
        errors.append("too_large")
    return {"valid": not errors, "errors": errors, "parts": len(names), "bytes": size}


@F.pandas_udf(T.StructType([T.StructField("valid", T.BooleanType()), T.StructField("errors", T.ArrayType(T.StringType())), T.StructField("parts", T.IntegerType()), T.StructField("bytes", T.LongType())]))
def _report(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([package_report(bytes(c) if c is not None else b"") for c in content], columns=["valid", "errors", "parts", "bytes"])


def with_package_report(packages: DataFrame, content_col: str = "content") -> DataFrame:
    return packages.withColumn("package", _report(F.col(content_col)))


@F.pandas_udf(T.BinaryType())
def _tracked(text: pd.Series, edits: pd.Series) -> pd.Series:
    return pd.Series([tracked_docx(t or "", [(e["start"], e["end"], e["suggestion"]) for e in (x if x is not None else [])]) for t, x in zip(text, edits)])


def with_tracked_docx(fixed: DataFrame, text_col: str = "text") -> DataFrame:
    """``fixed`` (see lint.fix) with ``docx``: the original text and its applied edits as tracked changes."""
    return fixed.withColumn("docx", _tracked(F.col(text_col), F.col("applied")))


def write_texts(df: DataFrame, path: str, text_col: str = "fixed_text", id_col: str = "doc_id") -> None:
    """JSON lines of id and text (a text may hold line ends, so lines of plain text would not do)."""
    df.select(id_col, text_col).write.mode("errorifexists").json(path)


def audit_report(tiers: DataFrame) -> DataFrame:
    """Counts of certification tiers and a Markdown table of them, in one row."""
    n = tiers.groupBy("tier").agg(F.count("*").alias("n"))
    line = F.concat(F.lit("| "), F.col("tier"), F.lit(" | "), F.col("n").cast("string"), F.lit(" |"))
    return n.agg(F.sum("n").alias("citations"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("tier", "n")))).alias("tiers"), F.concat(F.lit("| tier | n |\n|-|-|\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("markdown"))


def training_records(rows: DataFrame, modes: tuple[str, ...] = ("bluepages", "whitepages")) -> DataFrame:
    """Chat records from seed rows (citation, proposed, source_type, issue_code, group): one per mode, ``See X.`` as the document."""
    out = rows.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in modes])))
    user = F.to_json(F.struct(F.concat(F.lit("See "), F.col("citation"), F.lit(".")).alias("document"), F.col("citation").alias("citation_text"), F.lit(4).alias("start"), (F.lit(4) + F.length("citation")).alias("end"), "mode", "source_type", "issue_code"))
    answer = F.to_json(F.struct(F.col("proposed").alias("proposed_citation"), F.col("proposed").isNull().alias("abstain")), {"ignoreNullFields": "false"})
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return out.select(F.array(message("user", user), message("assistant", answer)).alias("messages"), F.struct("mode", "source_type", "group", F.col("proposed").isNull().alias("abstain")).alias("metadata"))


#: Sentences that a citation is put into, with what stands before it.
TEMPLATES = (("see", "See ", "."), ("holding", "That much was settled in ", " and has stood since."), ("contrast", "Contrast ", ", which turns on other facts."))


def training_set(seeds: DataFrame, seed: str, templates: tuple = TEMPLATES, modes: tuple[str, ...] = ("bluepages", "whitepages")) -> DataFrame:
    """Every seed (seed_id, citation, proposed, source_type, issue_code, group) in every template and mode: position, split, messages, metadata and the ids.

    Splits (80/10/10) go by group, so no group is in two of them; the order is a seeded shuffle of all records. Both
    follow from hashes, whatever the partitions. Write it with ``write_shuffled``.
    """
    forms = F.array(*[F.struct(F.lit(n).alias("template"), F.lit(a).alias("before"), F.lit(b).alias("after"), F.lit(m).alias("mode")) for n, a, b in templates for m in modes])
    out = evaluate.assign_splits(seeds, "group", seed).withColumn("f", F.explode(forms)).select("*", "f.*").drop("f")
    # Places first: messages are several times as long as what they are made of, and needn't be sorted.
    out = evaluate.hash_rank(out, ["seed_id", "template", "mode"], seed)
    document = F.concat("before", "citation", "after")
    start = F.length("before")
    user = F.to_json(F.struct(document.alias("document"), F.col("citation").alias("citation_text"), start.alias("start"), (start + F.length("citation")).alias("end"), "mode", "source_type", "issue_code"))
    answer = F.to_json(F.struct(F.col("proposed").alias("proposed_citation"), F.col("proposed").isNull().alias("abstain")), {"ignoreNullFields": "false"})
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    about = F.struct("mode", "source_type", "group", F.col("proposed").isNull().alias("abstain")).alias("metadata")
    return out.select("seed_id", "template", "mode", "split", F.array(message("user", user), message("assistant", answer)).alias("messages"), about, "position")


def write_shuffled(records: DataFrame, path: str, files: int = 1) -> None:
    """Records as JSON lines in the order of ``position``: ranges of it to files, each sorted, a folder a split."""
    dealt = records.repartitionByRange(files, "position").sortWithinPartitions("split", "position")
    dealt.select("split", "position", "messages", "metadata").write.mode("errorifexists").option("ignoreNullFields", "false").partitionBy("split").json(path)
