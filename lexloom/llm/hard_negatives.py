"""Hard negatives of anchors by exact integer inner products, found through a PCA rotation.

Vectors become integers (floor of ``scale`` times a component); a score is the
integer inner product of two rows. Higher scores come first, ties by smaller id.
An anchor's positives are its first ``positives`` other rows of the same label; for each
positive, the negatives are the first ``negatives`` rows of another label whose score lies between
``low`` and ``high`` hundredths of the positive's.

1. The second moments of all rows, summed task by task, give an orthogonal
   rotation that puts the directions of most energy first.
2. Anchors are dealt into blocks of at most ``block_rows`` rows; a block goes to all tasks, and
   each task runs over its own rows: products of the leading components are accumulated level
   by level for (rows x anchors), and the rest is bounded by the product of the residual norms and a
   slack for rounding. A pair goes as soon as its upper bound is below what the anchor
   has found already (its own block gives a start), or its lower bound is above the window.
3. What survives is scored by integer products. A task gives at most ``positives``
   (or, per positive, ``negatives``) rows per anchor, and these are merged by key.

The bounds never drop a row that counts: the slack covers the error of the rotation and of all
sums. Work is anchors x rows at worst; no pair leaves a task but those that a task
ranks first. Each block reads the rows twice (positives, then negatives within the
windows that they set) and appends its result to a table in the shared folder.

Defined results: rows whose id, label or vector is null, or whose vector holds a
null or non-finite component, take no part (a row without an id can't be named). Shorter
vectors end in zeros; components beyond ``vectors.LIMIT`` count as the limit. Rows that repeat
an id are rows of their own: each is an anchor and each may be a positive or a
negative of the others, an equal copy of the anchor too. A positive with a score of 0
has negatives of score 0, one below 0 has none. Labels are integers. Other columns have no effect.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import vectors as V
from .scratch import Table, new_path

POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 3, 50, 95, 256
#: Anchors that are sent to the tasks at once.
BLOCK_ROWS = 4096
#: Cells of a matrix (rows x anchors) in a task.
CELLS = 1 << 21
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


@dataclass(frozen=True)
class Rotation:
    """basis: orthogonal (width, width), leading directions first; ends: the component at which each level ends; slack: error of a rotated product per unit of both norms."""

    basis: np.ndarray
    ends: tuple[int, ...]
    slack: float

    @classmethod
    def of(cls, moments: np.ndarray) -> Rotation:
        width = len(moments)
        energy, basis = np.linalg.eigh(moments)
        energy, basis = np.maximum(energy[::-1], 0), np.ascontiguousarray(basis[:, ::-1])
        rest = 1 - np.cumsum(energy) / max(energy.sum(), 1e-300)
        ends = sorted({min(width, int((rest > 2.0**-k).sum()) + 1) for k in (1, 2, 3)} | {width})
        off = np.abs(basis.T @ basis - np.eye(width)).sum()
        return cls(basis, tuple(ends), float(off + 32 * (width + 8) * 2.0**-52))


@dataclass
class Side:
    """Integer rows with their rotated components, and the norm of what each level leaves."""

    ids: np.ndarray
    labels: np.ndarray
    q: np.ndarray
    rotated: np.ndarray
    rest: list[np.ndarray]
    norm: np.ndarray
    square: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, rotation: Rotation) -> Side:
        x = q.astype(np.float64)
        y = x @ rotation.basis
        rest = [np.sqrt((y[:, e:] ** 2).sum(1)) * (1 + 1e-9) for e in rotation.ends]
        return cls(ids, labels, q, y, rest, np.sqrt((x**2).sum(1)) * (1 + 1e-9), (q * q).sum(1))


class Best:
    """For each key the first ``k`` (score, id) found so far, with a mark."""

    def __init__(self, keys: int, k: int):
        self.k, self.waiting = k, []
        self.held = *(np.empty(0, np.int64) for _ in range(3)), np.empty(0, bool)
        self.last = np.full(keys, -np.inf)

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray, mark: np.ndarray) -> None:
        self.waiting.append((key, score, ids, mark))
        if sum(len(w[0]) for w in self.waiting) >= max(1 << 15, len(self.held[0])):
            self.settle()

    def settle(self) -> None:
        key, score, ids, mark = (np.concatenate(x) for x in zip(self.held, *self.waiting))
        self.waiting = []
        order = np.lexsort((ids, -score, key))
        key, score, ids, mark = key[order], score[order], ids[order], mark[order]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else key
        place = np.arange(len(key)) - np.repeat(start, np.diff(np.r_[start, len(key)]))
        at = place == self.k - 1
        self.last[key[at]] = np.maximum(self.last[key[at]], score[at])
        keep = place < self.k
        self.held = key[keep], score[keep], ids[keep], mark[keep]


def products(rows: np.ndarray, anchors: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer products of row i and anchor j of each pair."""
    out = np.empty(len(i), np.int64)
    step = max(1, (1 << 22) // max(1, rows.shape[1]))
    for a in range(0, len(i), step):
        out[a : a + step] = np.einsum("ij,ij->i", rows[i[a : a + step]], anchors[j[a : a + step]])
    return out


def bounded(x: Side, a: Side, rotation: Rotation, may: np.ndarray, floor: np.ndarray, ceiling: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, alive, low, high): bounds of the scores of the rows with a pair that may have a score from ``floor`` to ``ceiling`` of its anchor.

    may: pairs that count at all; alive, low, high: (rows, anchors).
    """
    rows, alive, total, start = np.arange(len(x.ids)), may, np.zeros(may.shape), 0
    for level, end in enumerate(rotation.ends):
        some = alive.any(1)
        if some.mean() < 0.75:
            rows, alive, total = rows[some], alive[some], total[some]
        if not len(rows):
            break
        total = total + x.rotated[rows, start:end] @ a.rotated[:, start:end].T
        gap = x.rest[level][rows, None] * a.rest[level] + rotation.slack * x.norm[rows, None] * a.norm
        alive = alive & (total + gap >= floor)
        if ceiling is not None:
            alive &= total - gap <= ceiling
        start = end
    if not len(rows):
        return rows, alive, total, total
    return rows, alive, total - gap, total + gap


def kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest of each column; -inf if there are fewer."""
    if len(values) < k:
        return np.full(values.shape[1], -np.inf)
    return np.partition(values, len(values) - k, axis=0)[len(values) - k]


def pieces(batch: pa.RecordBatch, width: int, step: int, scale: int, rotation: Rotation) -> Iterator[Side]:
    ids, labels, v = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
    for lo in range(0, batch.num_rows, step):
        yield Side.of(ids[lo : lo + step], labels[lo : lo + step], V.integers(V.dense(v.slice(lo, step), width), scale), rotation)


def scan_positives(sides: Iterator[Side], a: Side, rotation: Rotation, start: np.ndarray | None, k: int) -> Best:
    """The first k rows of each anchor's label, the anchor itself included and marked. start: a score that the k-th one has at least."""
    best = Best(len(a.ids), k)
    if start is not None:
        best.last = start.copy()
    for x in sides:
        rows, alive, low, high = bounded(x, a, rotation, x.labels[:, None] == a.labels, best.last, None)
        if not len(rows):
            continue
        if alive.sum() > 2 * k * len(a.ids):
            best.last = np.maximum(best.last, kth(np.where(alive, low, -np.inf), k))
            alive = alive & (high >= best.last)
        i, j = np.nonzero(alive)
        i = rows[i]
        score = products(x.q, a.q, i, j)
        best.add(j, score, x.ids[i], (x.ids[i] == a.ids[j]) & (score == a.square[j]) & (x.square[i] == a.square[j]))
    best.settle()
    return best


def scan_negatives(sides: Iterator[Side], a: Side, rotation: Rotation, least: np.ndarray, most: np.ndarray, k: int) -> Best:
    """The first k rows of other labels with a score from ``least`` to ``most``, both (anchors, positives); key: anchor * positives + positive."""
    n, per = least.shape
    best = Best(n * per, k)
    for x in sides:
        floor = np.maximum(least, best.last.reshape(n, per))
        rows, alive, low, high = bounded(x, a, rotation, x.labels[:, None] != a.labels, floor.min(1), most.max(1))
        if not len(rows):
            continue
        if alive.sum() > 2 * k * len(a.ids):
            wanted = np.zeros_like(alive)
            for p in range(per):
                inside = alive & (low >= least[:, p]) & (high <= most[:, p])
                floor[:, p] = np.maximum(floor[:, p], kth(np.where(inside, low, -np.inf), k))
                wanted |= alive & (high >= floor[:, p]) & (low <= most[:, p])
            best.last = np.maximum(best.last, np.where(least == MOST, -np.inf, floor).reshape(-1))
            alive = wanted
        i, j = np.nonzero(alive)
        i = rows[i]
        score = products(x.q, a.q, i, j)
        for p in range(per):
            fits = np.flatnonzero((score >= least[j, p]) & (score <= most[j, p]))
            best.add(j[fits] * per + p, score[fits], x.ids[i[fits]], np.zeros(len(fits), bool))
    best.settle()
    return best


def _first(found: DataFrame, key: str, score: str, row_id: str, k: int) -> DataFrame:
    """The first k rows of each key, with their rank; a task gives at most k rows a key."""
    w = Window.partitionBy(key).orderBy(F.desc(score), row_id)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. ``anchor``: a condition on ``rows``."""
    spark = rows.sparkSession
    ok = V.usable(F.col(vector_col)) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()
    taken = rows.where(ok).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    width, count = V.longest(taken, "v", F.count_if("anchor"))
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not width or not count:
        # Without a component every score is 0; a table of such vectors is searched as one of width 1.
        if not count:
            return spark.createDataFrame([], schema)
        width = 1

    def moments(batches):
        total = np.zeros((width, width))
        for batch in batches:
            q = V.integers(V.dense(batch.column(0), width), scale).astype(np.float64)
            total += q.T @ q
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    rotation = Rotation.of(V.add_up(taken.select("v").mapInArrow(moments, "m binary"), (width, width), "float64"))
    data = taken.select("id", "label", "v")
    anchors = Table(taken.where("anchor").select("id", "label", "v").repartition(-(-count // block_rows)), "anchors")
    path, waiting = new_path(spark, "negatives"), []

    def block() -> None:
        held = pa.Table.from_pylist(waiting, pa.schema([("id", pa.int64()), ("label", pa.int64()), ("v", pa.list_(pa.float64()))])).combine_chunks().to_batches()[0]
        a = next(pieces(held, width, len(waiting), scale, rotation))
        waiting.clear()
        step = max(64, CELLS // len(a.ids))
        start = scan_positives(pieces(held, width, step, scale, rotation), a, rotation, None, positives + 1).last

        def near(batches):
            best = scan_positives((x for b in batches for x in pieces(b, width, step, scale, rotation)), a, rotation, start, positives + 1)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in best.held], ["a", "score", "row_id", "own"])

        found = _first(data.mapInArrow(near, "a long, score long, row_id long, own boolean"), "a", "score", "row_id", positives + 1).collect()
        least, most = np.full((len(a.ids), positives), MOST), np.full((len(a.ids), positives), LEAST)
        of, number, own = np.zeros(least.shape, np.int64), [0] * len(a.ids), [False] * len(a.ids)
        score = np.zeros(least.shape, np.int64)
        for r in sorted(found, key=lambda r: (r["a"], r["rank"])):
            k = r["a"]
            if r["own"] and not own[k]:
                own[k] = True
            elif number[k] < positives:
                s = r["score"]
                at = k, number[k]
                of[at], score[at], least[at], most[at] = r["row_id"], s, -(-low * s // 100), high * s // 100
                number[k] += 1
        names = ["key", "anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"]

        def far(batches):
            best = scan_negatives((x for b in batches for x in pieces(b, width, step, scale, rotation)), a, rotation, least, most, negatives)
            key, s, ids, _ = best.held
            k, p = key // positives, key % positives
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, a.ids[k], of[k, p], ids, score[k, p], s)], names)

        out = _first(data.mapInArrow(far, ", ".join(f"{n} long" for n in names)), "key", "negative_score", "negative_id", negatives)
        out.select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score").write.mode("append").parquet(path)

    for r in anchors.df.toLocalIterator():
        waiting.append(r.asDict())
        if len(waiting) == block_rows:
            block()
    if waiting:
        block()
    anchors.drop()
    return spark.read.schema(schema).parquet(path)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 50 == 0)


#: DuckDB: the scores of all anchors and rows.
OP11_SQL = f"""WITH t AS (SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q FROM embeddings
WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.row AS anchor, a.vec_id AS anchor_id, x.vec_id, x.label = a.label AS same, list_sum(list_transform(range(1, least(len(a.q), len(x.q)) + 1), lambda i: a.q[i] * x.q[i]))::BIGINT AS score FROM t a JOIN t x ON a.row <> x.row WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS k FROM s WHERE same QUALIFY k <= {POSITIVES})
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor, k ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor) WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score QUALIFY rank <= {NEGATIVES}"""
