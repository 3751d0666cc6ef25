"""Metrics of extracted citations and labels against gold rows, certification tiers, and dataset splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sessions import absolute_url


def precision_recall(found: DataFrame, gold: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """Set precision, recall and F1 over rows named by ``keys``, for each group of ``by``. Of two empty sets all are 1."""
    by = by or []
    a = found.select(*keys).distinct().withColumn("__f", F.lit(1))
    b = gold.select(*keys).distinct().withColumn("__g", F.lit(1))
    j = a.join(b, keys, "full")
    hit, nf, ng = F.count_if(F.col("__f").isNotNull() & F.col("__g").isNotNull()), F.count("__f"), F.count("__g")
    m = j.groupBy(*by).agg(hit.alias("tp"), nf.alias("n_found"), ng.alias("n_gold"))
    p = F.when(F.col("n_found") > 0, F.col("tp") / F.col("n_found")).otherwise(F.when(F.col("n_gold") == 0, 1.0).otherwise(0.0))
    r = F.when(F.col("n_gold") > 0, F.col("tp") / F.col("n_gold")).otherwise(1.0)
    return m.withColumns({"precision": p, "recall": r}).withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def label_scores(rows: DataFrame, gold: str, found: str) -> DataFrame:
    """Per label: label, tp, fp, fn, f1 (their mean is the macro F1)."""
    g = rows.select(F.col(gold).alias("label"), (F.col(gold) == F.col(found)).cast("int").alias("tp"), F.lit(0).alias("fp"), (F.col(gold) != F.col(found)).cast("int").alias("fn"))
    f = rows.where(F.col(gold) != F.col(found)).select(F.col(found).alias("label"), F.lit(0).alias("tp"), F.lit(1).alias("fp"), F.lit(0).alias("fn"))
    out = g.unionByName(f).groupBy("label").agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn")])
    return out.withColumn("f1", F.when(F.col("tp") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0))


def verification_status(status: Column, clusters: Column) -> Column:
    """A lookup's answer: verified (200, one cluster), ambiguous (more), not_found (404 or none), unavailable."""
    return F.when((status == 200) & (clusters == 1), "verified").when((status.isin(200, 300)) & (clusters > 1), "ambiguous").when((status == 404) | ((status == 200) & (clusters == 0)), "not_found").otherwise("unavailable")


def verification_results(answers: DataFrame, base: str) -> DataFrame:
    """``answers`` (citation, status, clusters: array<struct<case_name,absolute_url>>) with verified (200), ambiguous (300), and the
    sorted distinct case_names and urls of the clusters; addresses without a host belong to ``base``."""
    names = F.array_sort(F.array_distinct(F.filter(F.transform("clusters", lambda c: c["case_name"]), lambda x: F.coalesce(x, F.lit("")) != "")))
    found = F.filter(F.transform("clusters", lambda c: c["absolute_url"]), lambda x: F.coalesce(x, F.lit("")) != "")
    urls = F.array_sort(F.array_distinct(F.transform(found, lambda x: absolute_url(x, base))))
    none = F.array().cast("array<string>")
    return answers.withColumns({"verified": F.coalesce(F.col("status") == 200, F.lit(False)), "ambiguous": F.coalesce(F.col("status") == 300, F.lit(False)), "case_names": F.coalesce(names, none), "urls": F.coalesce(urls, none)})


def certification_tiers(citations: DataFrame, lookups: DataFrame) -> DataFrame:
    """Tier of each citation: cases whose text is a lookup's key, or holds it, are source_matched if that was found.

    ``lookups``: key, found. Keys are matched by equality of volume, reporter and page
    (``cite_key``), so no pair of unlike strings is compared.
    """
    key = F.lower(F.trim(F.col("cite_key")))
    found = lookups.groupBy(F.lower(F.trim("key")).alias("k")).agg(F.max("found").alias("found"))
    j = citations.withColumn("k", key).join(found, "k", "left")
    tier = F.when(F.col("source_type") != "case", "mechanical_only").when(F.col("found").isNull(), "mechanical_only").when(F.col("found"), "source_matched").otherwise("source_not_matched")
    return j.withColumn("tier", tier).drop("k")


def assign_splits(rows: DataFrame, group: str, seed: str) -> DataFrame:
    """Groups ordered by sha256(seed:group); of every ten the first is test, the second validation, the others train.

    The rank of a group is its place in a global order: counts per hash prefix give
    each prefix its offset, ranks are taken within prefixes, so no task sorts all groups.
    """
    g = rows.select(group).distinct().withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(group).cast("string")), 256)).withColumn("prefix", F.substring("h", 1, 3))
    sizes = g.groupBy("prefix").agg(F.count("*").alias("n"))
    offsets = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("prefix", "before")
    rank = F.row_number().over(Window.partitionBy("prefix").orderBy("h")) - 1
    # At most 4096 prefixes, so this side is bounded.
    ranked = g.withColumn("r", rank).join(F.broadcast(offsets), "prefix").withColumn("pos", F.pmod(F.col("before") + F.col("r"), F.lit(10)))
    split = F.when(F.col("pos") == 0, "test").when(F.col("pos") == 1, "validation").otherwise("train")
    return rows.join(ranked.select(group, split.alias("split")), group)


def hash_rank(rows: DataFrame, key: list[str], seed: str, out: str = "position") -> DataFrame:
    """``rows`` with their place, from 0, in the order of sha256(seed:key): a seeded shuffle. Keys are strings joined by ``|``.

    As in ``assign_splits`` places come from counts per hash prefix, so rows are sorted a 4096th at a time. Rows of one key lie side by side.
    """
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.concat_ws("|", *[F.col(k).cast("string") for k in key])), 256)
    g = rows.withColumn("__h", h).withColumn("__p", F.substring("__h", 1, 3))
    sizes = g.groupBy("__p").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before")
    # At most 4096 prefixes, so this side is bounded.
    ranked = g.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy("__h")) - 1).join(F.broadcast(sizes.select("__p", before)), "__p")
    return ranked.withColumn(out, (F.col("__before") + F.col("__r")).cast("long")).drop("__h", "__p", "__r", "__before")


def quality_report(applied: DataFrame, citations: DataFrame) -> DataFrame:
    """Edits outside every citation's range, over all documents: n_edits, n_outside (a safe fixer has none)."""
    hit = applied.alias("a").join(citations.select("doc_id", F.col("start").alias("cs"), F.col("end").alias("ce")), "doc_id", "left").withColumn("inside", (F.col("start") < F.col("ce")) & (F.col("cs") < F.col("end")))
    per = hit.groupBy("doc_id", "start", "end").agg(F.max(F.coalesce("inside", F.lit(False))).alias("inside"))
    return per.agg(F.count("*").alias("n_edits"), F.count_if(~F.col("inside")).alias("n_outside"))
