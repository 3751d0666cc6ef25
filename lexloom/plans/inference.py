"""Model slots that run a model: batches in Arrow, loaded once a worker, with a time limit and a status per row.

A model is named by a function without arguments that loads it; what it returns is called with
a pyarrow RecordBatch of the input columns and gives one answer per row. A batch that fails or
takes too long is tried again row by row, so that one bad row costs no other its answer.

Status: ok, empty (the model gave null), failed (it raised, or gave too few answers; the message is in ``error``), timed_out. Rows
are never dropped. An answer that comes too late is not used; its thread ends when the model returns.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as TooLong

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

Load = Callable[[], Callable[[pa.RecordBatch], list]]

_loaded: dict[str, Callable] = {}


def _model(name: str, load: Load) -> Callable:
    if name not in _loaded:
        _loaded[name] = load()
    return _loaded[name]


class _Runner:
    """Calls a model with a time limit. A call that goes on keeps its thread; the next one gets a new one."""

    def __init__(self, model: Callable, seconds: float):
        self.model, self.seconds, self.pool = model, seconds, ThreadPoolExecutor(1)

    def __call__(self, batch: pa.RecordBatch) -> list:
        try:
            got = list(self.pool.submit(self.model, batch).result(timeout=self.seconds))
        except TooLong:
            self.pool.shutdown(wait=False)
            self.pool = ThreadPoolExecutor(1)
            raise
        if len(got) != batch.num_rows:
            raise ValueError(f"{len(got)} answers for {batch.num_rows} rows")
        return got

    def rows(self, batch: pa.RecordBatch) -> list[tuple]:
        """(answer, status, error) of each row."""
        try:
            return [(x, "empty" if x is None else "ok", None) for x in self(batch)]
        except Exception as e:  # whatever a model may raise is a status, not the job's end
            if batch.num_rows > 1:
                return [r for i in range(batch.num_rows) for r in self.rows(batch.slice(i, 1))]
            late = isinstance(e, TooLong)
            return [(None, "timed_out" if late else "failed", f"no answer in {self.seconds} s" if late else f"{type(e).__name__}: {e}"[:200])]


def with_answers(rows: DataFrame, name: str, load: Load, inputs: list[str], kind: str = "string", batch_rows: int = 256, seconds: float = 30.0, answer: str = "answer") -> DataFrame:
    """``rows`` with ``answer`` (of the given type), ``status`` and ``error``. ``name`` tells models apart within a worker."""
    fields = rows.schema.fields
    schema = T.StructType([*fields, T.StructField(answer, T.StructType.fromDDL(f"x {kind}").fields[0].dataType), T.StructField("status", T.StringType()), T.StructField("error", T.StringType())])
    if len({f.name.lower() for f in schema.fields}) < len(schema.fields):
        raise ValueError(f"{answer}, status and error must be new columns")
    at = [rows.columns.index(c) for c in inputs]

    def run(batches):
        runner = _Runner(_model(name, load), seconds)
        for whole in batches:
            for lo in range(0, whole.num_rows, batch_rows):
                batch = whole.slice(lo, batch_rows)
                got = runner.rows(pa.RecordBatch.from_arrays([batch.column(i) for i in at], inputs))
                kinds = (_arrow(kind), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([g[k] for g in got], t) for k, t in enumerate(kinds)]], schema.names)

    return rows.mapInArrow(run, schema)


def _arrow(kind: str) -> pa.DataType:
    return {"string": pa.string(), "double": pa.float64(), "long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[kind]


def reranker(name: str, load: Load, text: str = "text", query: str = "query_text", **options) -> Callable[[DataFrame], DataFrame]:
    """A part for the slot ``reranker``: (query_id, chunk_id, rank, query_text, text) ordered anew by the model's score, ties by the old rank.

    A query of which any row has no score keeps its old order: scores of a part of the rows can't be compared with those of none.
    """

    def part(ranked: DataFrame) -> DataFrame:
        told = with_answers(ranked, name, load, [query, text], "double", answer="model_score", **options)
        own = Window.partitionBy("query_id")
        whole = F.min((F.col("status") == "ok").cast("int")).over(own) == 1
        order = own.orderBy(F.when(F.col("whole"), -F.col("model_score")), "old_rank")
        out = told.withColumnRenamed("rank", "old_rank").withColumn("whole", whole)
        return out.withColumn("rank", F.row_number().over(order)).drop("whole")

    return part


def proposer(name: str, load: Load, prompt: str = "prompt", **options) -> Callable[[DataFrame], DataFrame]:
    """A part for the slot ``model``: tasks with ``raw``, the model's answer to the prompt (null if it gave none), and its status."""
    return lambda tasks: with_answers(tasks, name, load, [prompt], "string", answer="raw", **options)
