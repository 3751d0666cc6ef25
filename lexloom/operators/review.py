"""Review items, decisions, export plans, and session state on append-only tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import between

def item_id(*values: Column) -> Column:
    """A stable id of what an item is, whatever else changes."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(v.cast("string"), F.lit("\x00")) for v in values]), 256)


def review_items(issues: DataFrame) -> DataFrame:
    """``issues`` (see lint.issue_rows) as items: item_id, kind, decision (safe edits start as accepted)."""
    safe = (F.col("correction_level") == "safe_auto_fix") & F.col("suggestion").isNotNull()
    kind = F.when(F.col("suggestion").isNotNull(), "text_edit").otherwise("annotation")
    out = issues.withColumn("item_id", item_id(F.col("doc_id"), F.col("code"), F.col("start"), F.col("end"), F.col("original"), F.col("suggestion")))
    out = out.withColumns({"kind": kind, "decision": F.when(safe, "accepted").otherwise("pending")})
    # An item that comes twice is one: the first in order stays.
    w = Window.partitionBy("item_id").orderBy("doc_id", "start", "end", "code")
    return out.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def decide(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions (item_id, decision, revision) laid over items: the last revision of each wins; ``reset`` gives the start state back."""
    last = decisions.groupBy("item_id").agg(F.max_by("decision", "revision").alias("new"))
    old = F.when((F.col("correction_level") == "safe_auto_fix") & F.col("suggestion").isNotNull(), "accepted").otherwise("pending")
    return items.join(last, "item_id", "left").withColumn("decision", F.when(F.col("new") == "reset", old).otherwise(F.coalesce("new", "decision"))).drop("new")


def export_plan(items: DataFrame, docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, status, exported_text: accepted edits of each document, refused as a whole if two overlap or the text has changed under one."""
    edits = items.where("decision = 'accepted' and kind = 'text_edit'").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "suggestion", "original"))).alias("edits"))
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(edits, "doc_id", "left")
    e = F.coalesce("edits", F.array().cast("array<struct<start:int,end:int,suggestion:string,original:string>>"))
    df = df.withColumn("e", e)
    stale = F.exists("e", lambda x: between(F.col("t"), x["start"], x["end"]) != x["original"])
    clash = F.exists(F.transform("e", lambda x, i: (i > 0) & (F.try_element_at(F.col("e"), F.greatest(i, F.lit(1)))["end"] > x["start"])), lambda x: x)
    text = F.aggregate(F.reverse("e"), F.col("t"), lambda t, x: F.concat(F.substring(t, F.lit(1), x["start"]), x["suggestion"], F.substring(t, x["end"] + 1, F.length(t))))
    df = df.withColumn("status", F.when(stale, "stale_text").when(clash, "overlapping_edits").otherwise("ok"))
    return df.select("doc_id", "status", F.size("e").alias("edits"), F.when(F.col("status") == "ok", text).alias("exported_text"))


def keyset_page(rows: DataFrame, order: str, key: str, limit: int, after: tuple | None = None) -> DataFrame:
    """A page in descending (order, key) after the given pair, with one row more than the limit to tell whether more follow."""
    limit = min(max(limit, 1), 200)
    if after is not None:
        a, k = F.lit(after[0]), F.lit(after[1])
        rows = rows.where((F.col(order) < a) | ((F.col(order) == a) & (F.col(key) < k)))
    return rows.orderBy(F.desc(order), F.desc(key)).limit(limit + 1)


#: What a session's log leads to; ``last_seq`` is that of the update that holds.
REVISION = "revision long, conflicts long, last_seq long, state string, content string"


def apply_revisions(events: DataFrame, state: DataFrame | None = None, key: str = "session_id") -> DataFrame:
    """Compare-and-set over an append-only log (session_id, seq, base_revision, state, content): session_id and REVISION.

    An update holds if its base is the number of updates that held before it; the others are conflicts. ``state``: what earlier
    events of these sessions led to. A session's log is folded in one row, of two numbers an event (a session bounds
    them); the content of the update that holds is then joined by its number. Of events that repeat a number the first in order counts first.
    """
    numbers = F.struct(F.col("seq").cast("long").alias("seq"), F.col("base_revision").cast("long").alias("base"))
    log = events.groupBy(key).agg(F.array_sort(F.collect_list(numbers)).alias("log"))
    old = (events.limit(0).select(key, *[F.lit(None).cast(t).alias(n) for n, t in (x.split() for x in REVISION.split(", "))]) if state is None else state.select(key, *[x.split()[0] for x in REVISION.split(", ")]))
    both = log.join(old, key, "left")
    zero = F.struct(F.coalesce("revision", F.lit(0)).cast("long").alias("revision"), F.coalesce("conflicts", F.lit(0)).cast("long").alias("conflicts"), F.lit(None).cast("long").alias("last"), F.lit(None).cast("long").alias("base"))

    def add(acc, e):
        ok = F.struct((acc["revision"] + 1).alias("revision"), acc["conflicts"].alias("conflicts"), e["seq"].alias("last"), e["base"].alias("base"))
        return F.when(e["base"] == acc["revision"], ok).otherwise(acc.withField("conflicts", acc["conflicts"] + 1))

    x = both.select(key, F.aggregate("log", zero, add).alias("x"), F.struct("last_seq", "state", "content").alias("old"))
    held = events.groupBy(key, F.col("seq").cast("long").alias("last"), F.col("base_revision").cast("long").alias("base")).agg(F.min(F.struct("state", "content")).alias("new"))
    x = x.select(key, "x.*", "old").join(held, [key, "last", "base"], "left")
    pick = lambda n: F.when(F.col("last").isNotNull(), F.col(f"new.{n}")).otherwise(F.col(f"old.{n}")).alias(n)
    return x.select(key, "revision", "conflicts", F.coalesce("last", F.col("old.last_seq")).alias("last_seq"), pick("state"), pick("content"))


def revisions(events: DataFrame) -> DataFrame:
    """``apply_revisions`` of a whole log with the hash of each content."""
    return apply_revisions(events).drop("last_seq").withColumn("content_sha256", F.sha2(F.coalesce("content", F.lit("")), 256))
