"""Context reduction: the paragraphs around a focus, within a budget of characters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spans import between, merge_touching

OMITTED = "\n[...]\n"


def focus_context(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", focus_start: str = "focus_start", focus_end: str = "focus_end", most: int = 2400, least_saving: float = 0.12) -> DataFrame:
    """doc_id, context, ranges, strategy, saved_chars.

    Short texts pass through. Else the focus paragraph and its neighbours stay; if
    they exceed ``most``, the cut goes inside the focus paragraph, half of what the
    focus leaves before it and half after it, room unused on one side going to the
    other. A saving below ``least_saving`` is not worth it.
    """
    t, n = F.coalesce(F.col(text_col), F.lit("")), F.length(F.coalesce(F.col(text_col), F.lit("")))
    parts = F.split(t, r"\n[ \t]*\n", -1)
    gaps = F.regexp_extract_all(t, F.lit(r"\n[ \t]*\n"), F.lit(0))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def add(acc, x):
        # A paragraph owns the separator that follows it.
        end = acc["at"] + x
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), end.alias("end")))).alias("out"))

    sizes = F.transform(parts, lambda p, i: F.length(p) + F.coalesce(F.length(F.try_element_at(gaps, i + 1)), F.lit(0)))
    df = docs.withColumn("__p", F.aggregate(sizes, zero, add, lambda a: a["out"]))
    fs, fe = F.col(focus_start), F.col(focus_end)
    inside = F.try_element_at(F.filter(F.transform("__p", lambda p, i: F.struct(p["start"].alias("start"), p["end"].alias("end"), i.alias("i"))), lambda p: (p["start"] <= fs) & (fs < p["end"])), F.lit(1))
    df = df.withColumn("__f", inside)
    f = F.col("__f")
    near = F.slice("__p", F.greatest(f["i"], F.lit(1)), F.when(f["i"] > 0, 3).otherwise(2))
    wide = merge_touching(near)
    width = F.aggregate(near, F.lit(0), lambda a, p: a + p["end"] - p["start"])
    room = F.greatest(F.lit(most) - (fe - fs), F.lit(0))
    lead, tail = fs - f["start"], F.greatest(f["end"] - fe, F.lit(0))
    half = F.floor(room / 2).cast("int")
    a = F.least(lead, half + F.greatest(F.lit(0), half - tail))
    b = F.least(tail, room - a)
    cut = F.array(F.struct((fs - a).alias("start"), F.least(fe + b, n).alias("end")))
    ranges = F.when((n <= most) | f.isNull(), F.array(F.struct(F.lit(0).alias("start"), n.alias("end")))).when(width <= most, wide).otherwise(cut)
    df = df.withColumn("__r", ranges)
    kept = F.aggregate("__r", F.lit(0), lambda s, r: s + r["end"] - r["start"])
    bypass = (n <= most) | f.isNull() | ((n - kept) < least_saving * n)
    text = F.array_join(F.transform("__r", lambda r: between(t, r["start"], r["end"])), OMITTED)
    return df.select(F.col(id_col).alias("doc_id"), F.when(bypass, t).otherwise(text).alias("context"), F.when(bypass, F.array(F.struct(F.lit(0).alias("start"), n.alias("end")))).otherwise(F.col("__r")).alias("ranges"), F.when(bypass, "bypass").when(width <= most, "neighbours").otherwise("cut").alias("strategy"), F.when(bypass, 0).otherwise(n - kept).alias("saved_chars"))
