"""Product codes of vectors: Lloyd rounds per part, pruned by the triangle inequality (Elkan).

Vectors become integers (floor of ``scale`` times a component) and are cut into
``parts`` equal parts; each part position has a codebook of ``entries`` entries,
at first those of the rows with the least ids. A round assigns each part to its
nearest entry and moves every entry to the floor of its parts' mean; an entry without
parts stays.

A row keeps, per part, its entry, an upper bound of the distance to it, and a
lower bound of the distance to every entry. After a round the entries have moved:
the upper bound grows by the movement of the row's own entry, each lower bound shrinks by
that of its entry. An entry is passed over only if its lower bound, or half its
distance to the row's own entry, is strictly above the upper bound. All others are compared by
exact integer squared distances, with ties to the lower index, so pruning never
changes a result. Bounds are rounded outwards: upper ones to 4, lower ones to 2 bytes.

State is a table in the shared folder, written anew by each round and read by
the next; a task that is lost is worked out again from it. Codebooks (``parts`` x
``entries`` x width integers) and their sums per task are all that reaches the driver.

Defined results: rows whose vector is null, or holds a null or non-finite
component, are left out. Shorter vectors, and the last part if the width is no multiple
of ``parts``, end in zeros. Components beyond ``vectors.LIMIT`` count as the
limit. With fewer rows than entries a codebook has an entry per row. Rows that
repeat an id are coded one by one; among them (and null ids, which come last) the
first entries are taken in the order of their components. An empty table gives an
empty result. Other columns have no effect, unless they are named to be kept.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectors as V
from .scratch import Table, free

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows that are worked on at once in a task.
CHUNK = 4096
UP, DOWN = 1 + 1e-12, 1 - 1e-12


@dataclass(frozen=True)
class Codebooks:
    """entries: integers (parts, entries, width of a part)."""

    entries: np.ndarray

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The integer vectors that codes (rows, parts) stand for."""
        return self.entries[np.arange(self.entries.shape[0]), codes].reshape(len(codes), -1)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows (n, w) to entries (m, w)."""
    out = np.zeros((len(x), len(c)), np.int64)
    for i in range(x.shape[1]):
        d = x[:, i, None] - c[None, :, i]
        out += d * d
    return out


def lower(x: np.ndarray) -> np.ndarray:
    """Half floats that are at most x."""
    x = np.minimum(x * DOWN, 65000.0)
    h = x.astype(np.float16)
    return np.where(h.astype(np.float64) > x, np.nextafter(h, np.float16(0)), h)


def upper(x: np.ndarray) -> np.ndarray:
    """Floats that are at least x."""
    return np.nextafter((x * UP).astype(np.float32), np.float32(np.inf))


def assign_all(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entry, squared distance, upper bound and lower bounds of each row of one part, from all distances."""
    d = squared(x, c)
    own = d.argmin(1)  # the first of equal ones
    best = d[np.arange(len(x)), own]
    return own, best, upper(np.sqrt(best)), lower(np.sqrt(d))


def assign_pruned(x: np.ndarray, c: np.ndarray, moved: np.ndarray, own: np.ndarray, ub: np.ndarray, lb: np.ndarray, exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """As ``assign_all`` after the entries moved, and the number of distances that were worked out.

    ``exact``: squared distances are wanted for all rows, also for those that need no comparison (else -1).
    """
    n = len(x)
    ub = ub.astype(np.float64) + moved[own]
    lb = np.maximum(lb.astype(np.float64) - moved * UP, 0)
    half = np.sqrt(squared(c, c)) / 2 * DOWN
    np.fill_diagonal(half, np.inf)
    best = np.full(n, -1, np.int64)
    open_ = np.flatnonzero(ub >= half.min(1)[own]) if len(c) > 1 else np.empty(0, np.int64)
    tight = np.arange(n) if exact else open_
    best[tight] = ((x[tight] - c[own[tight]]) ** 2).sum(1)
    ub[tight] = np.sqrt(best[tight]) * UP
    lb[tight, own[tight]] = np.sqrt(best[tight])
    rival = (lb[open_] <= ub[open_, None]) & (half[own[open_]] <= ub[open_, None])
    row, entry = np.nonzero(rival)
    row = open_[row]
    d = ((x[row] - c[entry]) ** 2).sum(1)
    lb[row, entry] = np.sqrt(d)
    # The least (squared distance, index) of a row, its present entry included.
    order = np.lexsort((np.r_[entry, own[open_]], np.r_[d, best[open_]], np.r_[row, open_]))
    rows, dist, which = np.r_[row, open_][order], np.r_[d, best[open_]][order], np.r_[entry, own[open_]][order]
    first = np.ones(len(rows), bool)
    first[1:] = rows[1:] != rows[:-1]
    own = own.copy()
    own[rows[first]], best[rows[first]] = which[first], dist[first]
    ub[rows[first]] = np.sqrt(dist[first])
    return own, best, upper(ub), lower(lb), len(d) + len(tight)


def _binary(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as binaries."""
    x = np.ascontiguousarray(x)
    size = x[0].nbytes if len(x) else 0
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * np.int32(size)), pa.py_buffer(x)])


def _matrix(column: pa.Array, kind: type, shape: tuple[int, ...]) -> np.ndarray:
    """The opposite of ``_binary``."""
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]].view(kind).reshape(len(column), *shape) if len(column) else np.zeros((0, *shape), kind)


def _round(state: DataFrame, kept: str, books: np.ndarray, moved: np.ndarray | None, last: bool) -> DataFrame:
    """The state after an assignment: the first one (moved: None) from all distances, the later ones from bounds."""
    parts, m, w = books.shape

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(lo, CHUNK)
                q = _matrix(batch.column("q"), np.int32, (parts, w)).astype(np.int64)
                n = len(q)
                own, ub, lb, error = np.zeros((n, parts), np.uint8 if m <= 256 else np.int32), np.zeros((n, parts), np.float32), np.zeros((n, parts, m), np.float16), np.zeros(n, np.int64)
                worked = 0
                if moved is not None:
                    before = [_matrix(batch.column("own"), own.dtype, (parts,)), _matrix(batch.column("ub"), np.float32, (parts,)), _matrix(batch.column("lb"), np.float16, (parts, m))]
                for p in range(parts):
                    if moved is None:
                        own[:, p], best, ub[:, p], lb[:, p] = assign_all(q[:, p], books[p])
                        worked += n * m
                    else:
                        o, best, ub[:, p], lb[:, p], k = assign_pruned(q[:, p], books[p], moved[p], before[0][:, p].astype(np.int64), before[1][:, p], before[2][:, p], last)
                        own[:, p] = o
                        worked += k
                    error += best
                cols = [batch.column(i) for i in range(batch.schema.get_field_index("q"))]
                names = batch.schema.names[: len(cols)]
                if last:
                    yield pa.RecordBatch.from_arrays([*cols, _binary(own), pa.array(error)], [*names, "own", "error"])
                else:
                    done = np.zeros(n, np.int64)
                    done[:1] = worked
                    yield pa.RecordBatch.from_arrays([*cols, batch.column("q"), _binary(own), _binary(ub), _binary(lb), pa.array(done)], [*names, "q", "own", "ub", "lb", "worked"])

    return state.mapInArrow(run, f"{kept}, own binary, error long" if last else f"{kept}, q binary, own binary, ub binary, lb binary, worked long")


def _sums(state: DataFrame, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the parts of each entry (parts, entries, width) and their numbers (parts, entries)."""
    parts, m, w = shape

    def run(batches):
        total = np.zeros((parts, m, w + 1), np.int64)
        for batch in batches:
            q = _matrix(batch.column("q"), np.int32, (parts, w))
            own = _matrix(batch.column("own"), np.uint8 if m <= 256 else np.int32, (parts,))
            for p in range(parts):
                order = np.argsort(own[:, p], kind="stable")
                start = np.flatnonzero(np.r_[True, np.diff(own[order, p].astype(np.int64)) != 0]) if len(order) else order
                which = own[order[start], p]
                if len(order):
                    total[p, which, :w] += np.add.reduceat(q[order, p].astype(np.int64), start, axis=0)
                    total[p, which, w] += np.diff(np.r_[start, len(order)])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    got = V.add_up(state.select("q", "own").mapInArrow(run, "m binary"), (parts, m, w + 1), "int64")
    return got[:, :, :w], got[:, :, w]


def compress(rows: DataFrame, keep: list[str], id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[Table, Codebooks]:
    """(the columns ``keep``, own: a byte per part, error) of the usable rows, and the codebooks. Underscores come before ``own`` and ``error`` where ``keep`` has such names."""
    spark = rows.sparkSession
    taken = rows.where(V.usable(F.col(vector_col))).select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(id_col).alias("row_id"), F.col(vector_col).cast("array<double>").alias("v"))
    width = V.longest(taken, "v")[0]
    w = max(1, -(-width // parts))
    kept = ", ".join(f"k{i} {taken.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep)))

    def cut(batches):
        for batch in batches:
            q = V.integers(V.dense(batch.column("v"), parts * w), scale).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], _binary(q)], [*batch.schema.names[: len(keep)], "q"])

    n = F.transform(F.col("v"), lambda x: F.greatest(F.lit(-V.LIMIT), F.least(F.lit(V.LIMIT), F.floor(x * scale))).cast("long"))
    first = [r[0] for r in taken.select("row_id", n.alias("n")).orderBy(F.col("row_id").asc_nulls_last(), "n").limit(entries).select("n").collect()]
    books = np.zeros((parts, len(first), w), np.int64)
    for k, v in enumerate(first):
        books[:, k] = np.array(v + [0] * (parts * w - len(v)), np.int64).reshape(parts, w)
    cut_rows, state, moved = taken.mapInArrow(cut, f"{kept}, q binary"), None, None
    if not first:
        empty = spark.createDataFrame([], f"{kept}, own binary, error long")
        return Table(_named(empty, keep), "codes"), Codebooks(books)
    for _ in range(rounds):
        new = Table(_round(cut_rows if state is None else state.df, kept, books, moved, False), "elkan")
        if state is not None:
            state.drop()
        state = new
        sums, count = _sums(state.df, books.shape)
        mean = np.where(count[:, :, None] > 0, sums // np.maximum(count, 1)[:, :, None], books)
        moved, books = np.sqrt(((mean - books) ** 2).sum(2)) * UP, mean
    coded = _round(cut_rows if state is None else state.df, kept, books, moved, True)
    out = Table(_named(coded, keep), "codes")
    if state is not None:
        state.drop()
    return out, Codebooks(books)


def _named(df: DataFrame, keep: list[str]) -> DataFrame:
    own, error = free(keep, "own", "error")
    return df.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("own").alias(own), F.col("error").alias(error))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    coded, books = compress(rows, ["vec_id", "label"])
    # The sums are a small table of their own, so that Spark can split a hot label in the join.
    sums = Table(coded.df.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    out = coded.df.alias("c").join(sums.df.alias("s"), F.col("c.label").eqNullSafe(F.col("s.label")))
    return out.select("vec_id", F.lower(F.hex("own")).alias("code"), "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))


def _sql() -> str:
    """DuckDB: all distances of every round."""
    nearest = lambda book: f"(SELECT row, p, min(d) AS best FROM (SELECT row, p, {{'d': list_sum(list_transform(range(1, w + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))), 'k': k}} AS d FROM piece JOIN {book} USING (p)) GROUP BY row, p)"
    moved = lambda book: f"""(SELECT p, k, coalesce(m.c, b.c) AS c FROM {book} b LEFT JOIN (SELECT p, k, list(v ORDER BY i) AS c FROM
(SELECT p, best.k AS k, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS v FROM {nearest(book)} JOIN piece USING (row, p), unnest(range(1, w + 1)) u(i) GROUP BY ALL) GROUP BY p, k) m USING (p, k))"""  # noqa: E731
    return f"""WITH kept AS (SELECT *, row_number() OVER () AS row FROM (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
size AS (SELECT greatest(1, ceil(max(len(q)) / {PARTS}.0))::BIGINT AS w FROM kept),
piece AS MATERIALIZED (SELECT row, p, w, list_resize(q, {PARTS} * w, 0)[p * w + 1:p * w + w] AS x FROM kept, size, range({PARTS}) t(p)),
book0 AS MATERIALIZED (SELECT p, k, x AS c FROM piece JOIN (SELECT row, row_number() OVER (ORDER BY vec_id NULLS LAST, q) - 1 AS k FROM kept) USING (row) WHERE k < {ENTRIES}),
book1 AS MATERIALIZED {moved("book0")},
book2 AS MATERIALIZED {moved("book1")},
coded AS MATERIALIZED (SELECT row, string_agg(printf('%02x', best.k), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM {nearest("book2")} GROUP BY row)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
(SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) FROM book2) AS codebooks_sha256 FROM kept JOIN coded USING (row)"""


OP13_SQL = _sql()
