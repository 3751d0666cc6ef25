"""Streaming forms of what is stateless per row, and event summaries with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.lint import fix


def fix_stream(docs: DataFrame, out: str, checkpoint: str, mode: str = "bluepages", id_col: str = "doc_id") -> StreamingQuery:
    """Fixes documents as they arrive (a streaming DataFrame of id and text) and appends parquet."""
    done = fix(docs, mode).select(id_col, "fixed_text", F.size("applied").alias("n_applied"), F.size("issues").alias("n_issues"))
    return done.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", ts: str = "ts", kind: str = "event_type", value: str = "value") -> DataFrame:
    """Counts and sums per tumbling window and event type; the watermark bounds the state of a stream and changes nothing in a batch."""
    w = events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), F.col(kind).alias("event_type"))
    return w.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def event_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", ts: str = "ts", user: str = "user_id") -> DataFrame:
    """Sessions of a user that end after a pause of ``gap``."""
    s = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("s"), F.col(user).alias("user_id"))
    return s.agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")
