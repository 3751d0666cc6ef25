"""What a reviewer or a model is shown around citations, and the quick scan of a pasted text. All in-row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import Pattern
from ..functions.spans import apply_edits, between, let, rows_of, spans
from .lint import with_issues

# Patterns of the quick scan, of protected ranges, and of headings.
SCAN = (
    ("usc-abbreviation", Pattern(r"(?iuU)\b\d+\s+USC\b")),
    ("cfr-abbreviation", Pattern(r"(?iuU)\b\d+\s+CFR\b")),
    ("id-short-form", Pattern(r"(?imuU)(^|[.;:!?]\s+|\n\s*)id\.?(?=\s+(?:at\s+\d|¶\s*\d|§\s*\d))")),
    ("section-spacing", Pattern(r"(?U)\s*§\s*")),
)
PROTECTED = (
    ("case_citation", Pattern(r"(?iuU)\b\d{1,4}\s+(?:U\.S\.|S\.\s*Ct\.|L\.\s*Ed\.\s*2d|F\.\s?(?:2d|3d|4th)|F\.\s*Supp\.\s?(?:2d|3d)?|P\.\s?(?:2d|3d)|N\.E\.\s?(?:2d|3d)|S\.E\.\s?(?:2d)?|So\.\s?(?:2d|3d)|N\.W\.\s?(?:2d)?|A\.\s?(?:2d|3d)|Cal\.\s?(?:2d|3d|4th|5th|App\.)?)\s+\d{1,6}\b")),
    ("statute_or_regulation", Pattern(r"(?iuU)\b\d+\s+(?:U\.S\.C\.|C\.F\.R\.|Cal\.\s+[A-Za-z. ]+\s+Code)\s*§{1,2}\s*[\w.()\-–]+")),
    ("short_form", Pattern(r"(?iuU)\b(?:Id\.|Ibid\.|supra|infra|hereinafter|see\s+also|cf\.)\b")),
    ("court_and_year", Pattern(r"(?U)\((?:[A-Z][A-Za-z. ]+\s+)?(?:Cir\.|Ct\.|App\.|Sup\.\s*Ct\.)?\s*\d{4}\)")),
    ("page_marker", Pattern(r"(?U)(?<!\w)(?:at\s+)?\*?\d{1,6}(?:[–-]\d{1,6})?(?!\w)")),
    ("quotation", Pattern(r"[“\"](?:[^”\"\n]|\n(?!\n)){8,}[”\"]")),
    ("footnote_marker", Pattern(r"(?mdU)^(?:\[\^?\d+\]|\d+\.)\s+")),
    ("heading", Pattern(r"(?mdU)^(?:#{1,6}\s+.+|[IVXLC]+\.\s+.+|[A-Z]\.\s+.+|[A-Z][A-Z0-9 ,:'()\-]{5,})$")),
)
OMITTED = "\n\n[...]\n\n"


def risk_scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, findings (start, end, rule, replacement), corrected_text and a count per rule. The earliest finding wins, of equals the first rule."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def replacement(rule: str, x: Column) -> Column:
        if rule == "section-spacing":
            return F.lit(" § ")
        if rule == "id-short-form":
            return F.concat(F.regexp_extract(x, r"(?is)\A(.*?)id\.?\z", 1), F.lit("Id."))
        return F.regexp_replace(x, "(?i)USC" if rule.startswith("usc") else "(?i)CFR", "U.S.C." if rule.startswith("usc") else "C.F.R.")

    def found(k: int, rule: str, p: Pattern) -> Column:
        return F.transform(spans(text, p), lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("k"), s["end"].alias("end"), F.lit(rule).alias("rule"), s["text"].alias("original"), replacement(rule, s["text"]).alias("replacement")))

    all_ = F.filter(F.concat(*[found(k, r, p) for k, (r, p) in enumerate(SCAN)]), lambda x: x["original"] != x["replacement"])
    kind = "array<struct<start:int,k:int,end:int,rule:string,original:string,replacement:string>>"
    df = docs.withColumn("__f", F.array_sort(all_))
    # In order of start, only the last one taken can overlap the next.
    pick = F.aggregate("__f", F.array().cast(kind), lambda acc, x: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] > x["start"]), acc).otherwise(F.concat(acc, F.array(x))))
    df = df.withColumn("findings", pick)
    edits = F.transform("findings", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["replacement"].alias("suggestion")))
    count = lambda rule: F.size(F.filter("findings", lambda x: x["rule"] == rule))
    return df.select(F.col(id_col).alias("doc_id"), "findings", apply_edits(text, edits)["text"].alias("corrected_text"), *[count(r).alias("n_" + r.replace("-", "_")) for r, _ in SCAN])


def protected_ranges(text: Column, focus: Column | None = None) -> Column:
    """array<struct<start,end,reason>>: what must stay, merged where ranges overlap or touch; reasons joined by ``+``."""
    item = "struct<start:int,end:int,reason:string>"
    one = lambda reason, p: F.transform(spans(text, p), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(reason).alias("reason")).cast(item))
    all_ = [one(r, p) for r, p in PROTECTED]
    if focus is not None:
        all_.append(F.transform(focus, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("focus").alias("reason")).cast(item)))

    def add(acc, x):
        last = F.element_at(acc, -1)
        reason = F.when(F.array_contains(F.split(last["reason"], r"\+"), x["reason"]), last["reason"]).otherwise(F.concat(last["reason"], F.lit("+"), x["reason"]))
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), reason.alias("reason")).cast(item)
        return F.when((F.size(acc) > 0) & (x["start"] <= F.try_element_at(acc, F.lit(-1))["end"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(F.concat(*all_)), F.array().cast(f"array<{item}>"), add)


def document_context(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", budget: int = 12_000, neighbours: int = 1, least_saving: float = 0.12) -> DataFrame:
    """doc_id, context, status, sha256, kept (paragraphs), protected.

    Paragraphs with a protected range stay whatever the budget; their neighbours
    fill what is left, nearest first. A text without such paragraphs keeps its first
    three and its last.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.withColumn("__t", text).withColumn("protected", protected_ranges(F.col("__t")))
    t, n = F.col("__t"), F.length("__t")
    ends = F.transform(spans(t, Pattern(r"\n[ \t]*\n+")), lambda s: s["end"])
    df = df.withColumn("__b", F.array_distinct(F.concat(F.array(F.lit(0)), ends, F.array(n))))
    df = df.withColumn("__p", F.zip_with(F.slice("__b", F.lit(1), F.size("__b") - 1), F.slice("__b", F.lit(2), F.greatest(F.size("__b") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("start"), b.alias("end"))))
    hit = let(F.col("protected"), lambda kept: F.transform("__p", lambda p: F.exists(kept, lambda r: (r["start"] < p["end"]) & (p["start"] < r["end"]))))
    df = df.withColumn("__hit", hit)
    at = F.filter(F.transform("__hit", lambda h, i: F.when(h, i)), lambda x: x.isNotNull())
    df = df.withColumn("__at", at)
    far = lambda i: F.array_min(F.transform("__at", lambda a: F.abs(a - i)))
    size = F.size("__p")
    wanted = F.transform("__p", lambda p, i: F.struct(F.when(F.size("__at") > 0, far(i)).when((i < 3) | (i == size - 1), F.lit(0)).otherwise(F.lit(neighbours + 1)).alias("far"), i.alias("i"), (p["end"] - p["start"]).alias("n")))
    df = df.withColumn("__w", F.array_sort(F.filter(wanted, lambda w: w["far"] <= neighbours)))
    zero = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("keep"))
    fit = F.aggregate("__w", zero, lambda acc, w: F.when((w["far"] == 0) | (acc["n"] + w["n"] <= budget), F.struct((acc["n"] + w["n"]).alias("n"), F.concat(acc["keep"], F.array(w["i"])).alias("keep"))).otherwise(acc), lambda a: F.array_sort(a["keep"]))
    df = df.withColumn("__k", fit)
    part = lambda i: between(t, F.element_at(F.col("__p"), i + 1)["start"], F.element_at(F.col("__p"), i + 1)["end"])
    joined = F.aggregate("__k", F.struct(F.lit("").alias("x"), F.lit(-1).alias("last")), lambda acc, i: F.struct(F.concat(acc["x"], F.when((acc["last"] >= 0) & (i > acc["last"] + 1), F.lit(OMITTED)).otherwise(F.lit("")), part(i)).alias("x"), i.alias("last")), lambda a: a["x"])
    df = df.withColumn("__c", F.when(n > budget, joined))
    status = F.when(n == 0, "empty_input").when(n <= budget, "within_budget").when(1 - F.length("__c") / n < least_saving, "negligible_savings").otherwise("reduced")
    return df.select(F.col(id_col).alias("doc_id"), F.when(status == "reduced", F.col("__c")).otherwise(t).alias("context"), status.alias("status"), F.sha2(t, 256).alias("sha256"), F.when(status == "reduced", F.size("__k")).otherwise(size).alias("kept"), "protected")


def citation_tasks(docs: DataFrame, mode: str = "bluepages", text_col: str = "text", id_col: str = "doc_id", reach: int = 400) -> DataFrame:
    """A task per citation: its text, type, parts, the text around it and the issues that overlap it, and all of that as JSON."""
    df = with_issues(docs, mode, text_col)
    t = F.coalesce(F.col(text_col), F.lit(""))

    def task(c, known):
        issues = F.filter(known, lambda i: (i["start"] < c["end"]) & (c["start"] < i["end"]))
        low = F.greatest(c["start"] - reach, F.lit(0))
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), c["text"].alias("citation_text"), c["source_type"].alias("source_type"), c["components"].alias("components"), between(t, low, c["end"] + reach).alias("context"), low.alias("context_start"), issues.alias("issues"))

    rows = rows_of(df.withColumn("__task", let(F.col("issues"), lambda known: F.transform("citations", lambda c: task(c, known)))), "__task", F.col(id_col).alias("doc_id"), at="task")
    return rows.withColumn("mode", F.lit(mode)).withColumn("prompt", F.to_json(F.struct("citation_text", "components", "context", "context_start", "end", "issues", "mode", "source_type", "start")))


def align_authorities(citations: DataFrame, authorities: DataFrame) -> DataFrame:
    """Each citation (doc_id, pos, text) with the first unused authority (doc_id, ix, variants) one of whose variants it holds; else the first unused one; else null.

    Greedy in order of position, so it is a fold over a document's two lists, which
    a document's citations bound.
    """
    c = citations.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.lower("text").alias("text")))).alias("cs"))
    a = authorities.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ix", F.transform("variants", lambda v: F.lower(v)).alias("variants")))).alias("as"))
    item = "struct<pos:int,ix:int,matched:boolean>"
    unused = F.coalesce("as", F.array().cast("array<struct<ix:int,variants:array<string>>>"))
    zero = F.struct(unused.alias("left"), F.array().cast(f"array<{item}>").alias("out"))

    def add(acc, x):
        fits = F.filter(acc["left"], lambda y: F.exists(y["variants"], lambda v: (v != "") & F.contains(x["text"], v)))
        ix = F.coalesce(F.try_element_at(fits, F.lit(1))["ix"], F.try_element_at(acc["left"], F.lit(1))["ix"])
        one = F.struct(x["pos"].alias("pos"), ix.alias("ix"), (F.size(fits) > 0).alias("matched")).cast(item)
        return F.struct(F.filter(acc["left"], lambda y: ~y["ix"].eqNullSafe(ix)).alias("left"), F.concat(acc["out"], F.array(one)).alias("out"))

    df = c.join(a, "doc_id", "left").withColumn("out", F.aggregate("cs", zero, add, lambda s: s["out"]))
    return rows_of(df, "out", F.col("doc_id"))


def latest_lookups(lookups: DataFrame, now: Column, ttl_seconds: int = 3600) -> DataFrame:
    """Of each key the newest answer that is not older than the time to live (key, fetched_at, ...); of answers of one time always the same one."""
    w = Window.partitionBy("key").orderBy(F.desc("fetched_at"), F.xxhash64(*lookups.columns))
    fresh = lookups.where(F.col("fetched_at") >= now - F.make_interval(secs=F.lit(ttl_seconds)))
    return fresh.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def lookup_cache(lookups: DataFrame, now: Column, ttl_seconds: int = 3600, entries: int = 32) -> DataFrame:
    """What a cache of ``entries`` answers holds: of ``latest_lookups`` the newest, the oldest having made room."""
    return latest_lookups(lookups, now, ttl_seconds).orderBy(F.desc("fetched_at"), "key").limit(entries)
