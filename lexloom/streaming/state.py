"""Streams with a state of their own: revisions and job states per key, and the graph of arriving documents.

Each micro-batch is one change of a ``KeyedTable`` (or one numbered folder), and batches are
applied once by their number: what a restarted query runs again adds nothing. The
state lives in the table, not in the query's checkpoint, so batch jobs read it as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import graph, resolve
from ..operators.review import REVISION, apply_revisions
from ..operators.sessions import JOB_STATES, TERMINAL
from ..sources.state import KeyedTable

JOBS = "job_id {}, seq long, state string, progress double, started_at timestamp, completed_at timestamp, error string"


def each_batch(events: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None], **trigger) -> StreamingQuery:
    """Runs ``apply(batch, number)`` on every micro-batch; by default on what is there, and ends."""
    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def revision_table(spark: SparkSession, path: str, key_type: str = "long", buckets: int = 64) -> KeyedTable:
    return KeyedTable(spark, path, f"session_id {key_type}, {REVISION}", ["session_id"], buckets)


def with_events(old: DataFrame, events: DataFrame) -> DataFrame:
    """Session states after further events; sessions without any stay."""
    kept = old.join(events.select("session_id").distinct(), "session_id", "left_anti")
    return kept.unionByName(apply_revisions(events, old))


def revise(table: KeyedTable, events: DataFrame, batch: int | None = None) -> bool:
    """Compare-and-set updates (session_id, seq, base_revision, state, content), in the order of seq within the batch."""
    return table.change(events.where("session_id is not null"), with_events, batch)


def revision_stream(events: DataFrame, table: KeyedTable, checkpoint: str, **trigger) -> StreamingQuery:
    return each_batch(events, checkpoint, lambda batch, n: revise(table, batch, n), **trigger)


def job_table(spark: SparkSession, path: str, key_type: str = "long", buckets: int = 64) -> KeyedTable:
    return KeyedTable(spark, path, JOBS.format(key_type), ["job_id"], buckets)


def with_job_events(old: DataFrame, events: DataFrame) -> DataFrame:
    """Job states after further events (job_id, seq, at, state, progress, error): all parts are greatest or least by seq, so old
    states and new events are rows of one aggregation. What came too late is older and changes nothing but the start."""
    e = events.where(F.col("state").isin(*JOB_STATES))
    row = lambda df, start, end, at: df.select("job_id", F.struct("seq", "state", "error").alias("s"), F.when(F.col("progress").isNotNull(), F.struct("seq", "progress")).alias("p"), start.alias("start"), end.alias("end"), at.alias("at"))
    new = row(e, F.when(F.col("state") == "running", F.col("at")), F.when(F.col("state").isin(*TERMINAL), F.col("at")), F.lit(1))
    both = row(old, F.col("started_at"), F.col("completed_at"), F.lit(0)).unionByName(new)
    got = both.groupBy("job_id").agg(F.max("s").alias("s"), F.max("p").alias("p"), F.min("start").alias("started_at"), F.max("end").alias("completed_at"))
    progress = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("p.progress", F.lit(0.0))))
    return got.select("job_id", "s.seq", "s.state", progress.alias("progress"), "started_at", "completed_at", "s.error")


def job_stream(events: DataFrame, table: KeyedTable, checkpoint: str, **trigger) -> StreamingQuery:
    return each_batch(events, checkpoint, lambda batch, n: table.change(batch.where("job_id is not null"), with_job_events, n), **trigger)


def graph_of(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """All edges of a batch of whole documents: doc_id, edge_type, source, target."""
    facts = graph.with_occurrences(docs)
    occ = graph.occurrence_rows(facts, id_col)
    aliases = resolve.alias_targets(facts, occ, id_col)
    edges = graph.neighbour_edges(occ).unionByName(graph.sentence_edges(occ)).unionByName(graph.note_edges(occ)).unionByName(graph.context_edges(occ))
    return edges.unionByName(resolve.definition_edges(facts, occ, id_col).drop("alias")).unionByName(resolve.antecedent_edges(resolve.resolutions(occ, aliases)))


def graph_stream(docs: DataFrame, out: str, checkpoint: str, id_col: str = "doc_id", **trigger) -> StreamingQuery:
    """The graph of documents as they arrive: each micro-batch writes its edges, and the ids of its documents, to the folders of its number, anew if it is run again."""

    def write(batch: DataFrame, n: int) -> None:
        batch.select(F.col(id_col).alias("doc_id")).distinct().write.mode("overwrite").parquet(f"{out}/documents/batch={n}")
        graph_of(batch, id_col).write.mode("overwrite").parquet(f"{out}/edges/batch={n}")

    return each_batch(docs, checkpoint, write, **trigger)


def current_graph(spark: SparkSession, out: str) -> DataFrame:
    """The edges of each document as its last batch gave them: a document that came again replaces its old edges."""
    last = spark.read.parquet(f"{out}/documents").groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{out}/edges").join(last, ["doc_id", "batch"]).drop("batch")
