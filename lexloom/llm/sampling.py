"""Bounded samples of labelled rows, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import free

#: More classes than this are an error, since a model's size grows with them (none is dropped in silence).
MAX_CLASSES = 1000
#: Hashes of rows lie below this.
_RANGE = 1 << 62


def crc_mod(id_col: Column, n: int) -> Column:
    """crc32 of an id as text, modulo n; -1 for a null id."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(n)), F.lit(-1)).cast("int")


def class_sample(rows: DataFrame, class_col: str, key_cols: list[str], most: int, text_col: str | None = None, most_chars: int = 0) -> tuple[DataFrame, dict]:
    """At most ``most`` of the different rows (by class and ``key_cols``), and {class: (rows in all, rows in the sample)}.

    Each class gets an equal share (one row at least) and gives all its rows if it has
    fewer; its rows are taken in the order of a hash of their key columns, so the choice is the same on every run
    and whatever the partitions. Rows that repeat the key columns count once; null keys are keys like others. With ``text_col`` a class
    takes no further row once its texts have its share of ``most_chars`` characters (so it goes beyond that by one text at most).
    The sample is never empty where there are rows of a class. Rows without a class are left out.

    Only hashes below a limit that should hold four times the share are looked at; the limit is raised where it holds too
    few. (class, counts, hash) of at most MAX_CLASSES classes go to the driver.
    """
    counts = dict(map(tuple, rows.where(F.col(class_col).isNotNull()).groupBy(class_col).count().limit(MAX_CLASSES + 1).collect()))
    if len(counts) > MAX_CLASSES:
        raise ValueError(f"{class_col} has more than {MAX_CLASSES} values")
    if not counts:
        return rows.limit(0), {}
    share, chars = max(1, most // len(counts)), most_chars / len(counts)
    u = F.xxhash64(F.lit("sample"), *key_cols).bitwiseAND(F.lit(_RANGE - 1))
    per_class = lambda d: F.element_at(F.create_map(*[F.lit(x) for k, v in d.items() for x in (k, v)]), F.col(class_col))
    limit = {k: min(_RANGE, int(_RANGE * min(1.0, 4 * share / n)) + 1) for k, n in counts.items()}
    size = F.coalesce(F.length(text_col), F.lit(0)) if text_col else F.lit(0)
    done: dict = {}
    while limit:
        near = rows.where(F.col(class_col).isin(list(limit)) & (u < per_class(limit))).select(F.col(class_col).alias("k"), u.alias("u"), size.cast("long").alias("n"))
        one = near.groupBy("k", "u").agg(F.max("n").alias("n"))
        w = Window.partitionBy("k").orderBy("u")
        first = one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= share)
        before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        kept = first.withColumn("before", before).where(F.lit(not text_col) | (F.col("rank") == 1) | (F.col("before") < chars))
        found = {r["k"]: r for r in first.join(kept.select("k", "u", F.lit(True).alias("in")), ["k", "u"], "left").groupBy("k").agg(F.count("*").alias("seen"), F.count("in").alias("n"), F.max(F.when(F.col("in"), F.col("u"))).alias("last")).collect()}
        for k in list(limit):
            r = found.get(k)
            if limit[k] == _RANGE or (r and (r["seen"] >= share or r["n"] < r["seen"])):
                done[k] = r
                del limit[k]
        limit = {k: min(_RANGE, 16 * v) for k, v in limit.items()}
    cut = {k: r["last"] for k, r in done.items()}
    taken = rows.where(F.col(class_col).isin(list(cut)) & (u <= per_class(cut)))
    key = free(rows.columns, "key")[0]
    one = taken.groupBy(F.col(class_col), u.alias(key)).agg(F.first(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(rows.columns)])).alias("row"))
    return one.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(rows.columns)]), {k: (n, done[k]["n"]) for k, n in counts.items()}
