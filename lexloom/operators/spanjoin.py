"""Joins of two span tables, and as-of joins: near-linear work, no group in one task.

A span is half-open, [start, end), with whole numbers; spans belong together by key
columns (a document, say). Every span has a level, the least m with a length of at most 2^m. At level m
the axis is cut into bins of 2^m. Of two spans the longer one's level is the pair's: there the
longer one lies in two bins at most, and so does the shorter one. So a span goes to its bins at its own level and at
every higher one that the other side has, both sides meet by (keys, level, bin), and a
pair is told once, in the bin where the later of the two begins. Rows grow by a factor of the number of
levels (a logarithm of the longest span), whatever the lengths, and a long document's spans
are dealt over its bins.

Rows with a null key, start or end, or with end < start, match nothing. An empty span matches
where its place lies inside the other (strictly, for overlaps).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OVERLAPS, CONTAINS, WITHIN = "overlaps", "contains", "within"


def _level(start: Column, end: Column) -> Column:
    """The least m with end - start <= 2^m."""
    n = end.cast("long") - start.cast("long")
    return F.when(n <= 1, F.lit(0)).otherwise(F.length(F.bin(n - 1))).cast("int")


def _fits(kind: str, l: DataFrame | str = "l", r: DataFrame | str = "r") -> Column:
    a, b, c, d = F.col(f"{l}.start"), F.col(f"{l}.end"), F.col(f"{r}.start"), F.col(f"{r}.end")
    return {OVERLAPS: (a < d) & (c < b), CONTAINS: (a <= c) & (d <= b), WITHIN: (c <= a) & (b <= d)}[kind]


def _side(rows: DataFrame, keys: list[str], start: str, end: str, name: str) -> DataFrame:
    """One column per key, and the row, its span and its level as a struct."""
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    s, e = F.col(f"`{start}`").cast("long"), F.col(f"`{end}`").cast("long")
    out = rows.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], F.struct(s.alias("start"), e.alias("end"), _level(s, e).alias("level"), row.alias("row")).alias(name))
    for c in (*[f"k{i}" for i in range(len(keys))], f"{name}.start", f"{name}.end"):
        out = out.where(F.col(c).isNotNull())
    return out.where(F.col(f"{name}.end") >= F.col(f"{name}.start"))


def _binned(side: DataFrame, name: str, levels: list[int]) -> DataFrame:
    """A row per level from the span's own on, and per bin that the span touches there."""
    at = F.explode(F.filter(F.array(*map(F.lit, levels)), lambda m: m >= F.col(f"{name}.level")))
    cut = lambda x: F.floor(x / F.pow(F.lit(2.0), F.col("m"))).cast("long")
    leveled = side.withColumn("m", at)
    return leveled.withColumn("bin", F.explode(F.sequence(cut(F.col(f"{name}.start")), cut(F.col(f"{name}.end")))))


def span_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", kind: str = OVERLAPS, start: str = "start", end: str = "end") -> DataFrame:
    """Pairs of spans of equal keys: ``kind`` says what the left one does to the right one (overlaps, contains, within).

    how: inner and left give ``left``'s columns and, prefixed with ``right_``, those of ``right`` but its keys; semi and anti
    give rows of ``left`` with or without a match (a repeated row as often as it comes).
    """
    if how not in ("inner", "left", "semi", "anti") or kind not in (OVERLAPS, CONTAINS, WITHIN):
        raise ValueError(f"no join {how} {kind}")
    l, r = _side(left, keys, start, end, "l"), _side(right, keys, start, end, "r")
    # The levels there are: at most 64 numbers.
    has = lambda side, name: {x[0] for x in side.select(F.col(f"{name}.level").alias("m")).distinct().collect()}
    levels = sorted(has(l, "l") | has(r, "r"))
    by = [*[f"k{i}" for i in range(len(keys))], "m", "bin"]
    if how in ("semi", "anti"):
        # Whether a span matches depends on its key and place alone.
        l = l.select(*by[:-2], F.struct("l.start", "l.end", "l.level").alias("l")).distinct()
    later = F.floor(F.greatest("l.start", "r.start") / F.pow(F.lit(2.0), F.col("m"))).cast("long")
    pairs = _binned(l, "l", levels).join(_binned(r, "r", levels), by).where((F.greatest("l.level", "r.level") == F.col("m")) & (F.col("bin") == later) & _fits(kind))
    if how in ("semi", "anti"):
        found = pairs.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], F.col("l.start").alias("__start"), F.col("l.end").alias("__end")).distinct()
        same = [left[k] == found[k] for k in keys] + [left[start].cast("long") == found["__start"], left[end].cast("long") == found["__end"]]
        on = same[0]
        for c in same[1:]:
            on = on & c
        return left.join(found, on, f"left_{how}")
    others = [c for c in right.columns if c not in keys]
    row = [F.col(f"l.row.`{c}`").alias(c) for c in left.columns]
    inner = pairs.select(*row, *[F.col(f"r.row.`{c}`").alias(f"right_{c}") for c in others])
    if how == "inner":
        return inner
    alone = span_join(left, right, keys, "anti", kind, start, end)
    return inner.unionByName(alone.select(*[f"`{c}`" for c in left.columns], *[F.lit(None).cast(right.schema[c].dataType).alias(f"right_{c}") for c in others]))


def nested(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end", id_col: str = "id") -> DataFrame:
    """``spans`` with ``parent_id``: the shortest other span that holds it (of equal ones the one of the least id holds the others); null without one."""
    cols = [F.col(f"`{k}`") for k in keys]
    part = spans.select(*cols, F.col(start).alias("start"), F.col(end).alias("end"), F.col(id_col).alias("id"))
    pairs = span_join(part, part, keys, "inner", WITHIN)
    n = F.col("right_end") - F.col("right_start")
    real = pairs.where((F.col("id") != F.col("right_id")) & ((n > F.col("end") - F.col("start")) | (F.col("right_id") < F.col("id"))))
    # Of equal spans the nearest is the next lower id, so that they form a chain.
    order = F.struct(n.alias("n"), F.when(n == F.col("end") - F.col("start"), -F.col("right_id")).otherwise(F.col("right_id")).alias("t"))
    best = real.groupBy("id").agg(F.min_by("right_id", order).alias("parent_id"))
    return spans.join(best.withColumnRenamed("id", id_col), id_col, "left")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, rank: list[str] | None = None, width: int | None = None) -> DataFrame:
    """``left`` with the columns of that row of ``right`` (prefixed with ``right_``) that comes last at or before it, by keys.

    rank: what the last one is by: by default ``right_at``, then all other columns in order; given columns make it the greatest of them
    among the rows at or before. Both sides are one sorted table and the answer a running maximum over it: no
    candidate pairs. width: cuts the axis into bins of this length; then a hot key's rows are sorted bin by bin, and a small
    table carries each bin's greatest to the next ones. Null keys and places have no match.
    """
    others = [c for c in right.columns if c not in keys]
    rank = rank or [right_at, *[c for c in others if c != right_at]]
    value = F.struct(*[F.col(f"`{c}`").alias(f"r{i}") for i, c in enumerate(rank)], F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"))
    key = [F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)]
    ks = [f"k{i}" for i in range(len(keys))]
    bin_ = lambda at: F.floor(F.col(f"`{at}`") / width).cast("long") if width else F.lit(0).cast("long")
    kind = right.select(value.alias("v")).schema["v"].dataType
    row = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    l = left.select(*key, bin_(left_at).alias("bin"), F.col(f"`{left_at}`").alias("at"), F.lit(1).alias("side"), row.alias("row"), F.lit(None).cast(kind).alias("v"))
    some = right.where(F.col(f"`{right_at}`").isNotNull())
    for k in keys:
        some = some.where(F.col(f"`{k}`").isNotNull())
    r = some.select(*key, bin_(right_at).alias("bin"), F.col(f"`{right_at}`").alias("at"), F.lit(0).alias("side"), F.lit(None).cast(l.schema["row"].dataType).alias("row"), value.alias("v"))
    run = Window.partitionBy(*ks, "bin").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = l.unionByName(r).withColumn("best", F.max("v").over(run)).where("side = 1")
    if width:
        each = r.groupBy(*ks, "bin").agg(F.max("v").alias("v"))
        # One row a bin of a key that either side has.
        bins = l.select(*ks, "bin").distinct().join(each, [*ks, "bin"], "full")
        carried = bins.withColumn("before", F.max("v").over(Window.partitionBy(*ks).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))).select(*ks, "bin", "before")
        both = both.join(carried, [*ks, "bin"], "left").withColumn("best", F.greatest("best", "before"))
    fine = F.col("at").isNotNull()
    for k in ks:
        fine = fine & F.col(k).isNotNull()
    return both.select(*[F.col(f"row.`{c}`").alias(c) for c in left.columns], *[F.when(fine, F.col(f"best.row.`{c}`")).alias(f"right_{c}") for c in others])
