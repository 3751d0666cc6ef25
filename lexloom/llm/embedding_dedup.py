"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosine, distributed components.

1. Equal vectors become one item with its number of copies (combined before the shuffle).
2. An item gets a key of ``bits`` signs in each of ``tables`` tables, and a code of
   256 further signs. The number of bits follows the number of items, so that a bucket
   of unrelated items stays small; the number of tables follows from ``recall``: two vectors at the
   threshold share a bucket of some table with that probability, closer ones with a higher one.
3. Only keys and codes (32 bytes) are shuffled to the buckets. Items of a bucket whose codes
   differ in few enough signs (five standard deviations above the mean at the threshold) are
   candidates; a bucket gives each of its candidates the least item of their local component, its hub.
   No pair leaves a task.
4. The vectors of candidates alone go to their hubs, and all items of a hub are compared by
   exact cosine. A pair is counted at the least hub it shares. Buckets and hubs that are
   large are dealt into blocks, and each pair of blocks is a group of its own, so a task's memory is bounded.
5. Components come from star rounds over one edge per item and hub.

The work on a group of n different, mutually similar vectors grows with n squared, since
their exact numbers of links need every pair; copies cost nothing.

Defined results: vectors that are null, zero, or hold a null or non-finite component link with
nothing (0 links, a component of their own, kept). Shorter vectors end in zeros. Rows that
repeat a vector link with each other; rows that repeat an id are rows of their own. A
component's id is its least id that is not null; a row without an id is kept only where no row of its component has one. An empty table gives an empty
result. Other columns have no effect. Equal vectors are told by a 64-bit hash (a wrong match has odds of n^2 / 2^65).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bits, neardup
from . import kernel as K
from . import vectors as V
from .scratch import Table

THRESHOLD, RECALL, BUCKET, CODE = 0.9, 0.999, 64, 256
#: Items of a bucket, or components of vectors of a hub, that make a block.
ITEMS, BLOCK = 1 << 11, 1 << 21
#: Groups up to this size are compared many at once.
SMALL = 64


@dataclass(frozen=True)
class Hashing:
    width: int
    bits: int
    tables: int
    far: int
    seed: int = 12

    @classmethod
    def of(cls, width: int, items: int, threshold: float, recall: float, bucket: int) -> Hashing:
        differ = math.acos(threshold) / math.pi
        n = max(4, min(60, round(math.log2(max(items, 1) / bucket)) if items > bucket else 4))
        tables = math.ceil(math.log(1 - recall) / math.log(1 - (1 - differ) ** n))
        return cls(width, n, tables, math.ceil(CODE * differ + 5 * math.sqrt(CODE * differ * (1 - differ))))

    def planes(self) -> tuple[np.ndarray, np.ndarray]:
        rnd = np.random.default_rng(self.seed)
        code = rnd.normal(size=(self.width, CODE))
        return rnd.normal(size=(self.width, self.tables * self.bits)), code


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by their greatest absolute component, so that squares neither overflow nor vanish."""
    return x / np.abs(x).max(1, keepdims=True)


def keys(items: DataFrame, h: Hashing, codes: bool) -> DataFrame:
    """key, and with ``codes`` also id and code: a row for each item and table."""

    def run(batches):
        planes, code_planes = h.planes()
        weight = np.uint64(1) << np.arange(h.bits, dtype=np.uint64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                x = scaled(V.dense(batch.column(1).slice(lo, 2048), h.width))
                sign = (x @ planes > 0).reshape(len(x), h.tables, h.bits)
                key = K.mix(K.mix((sign * weight).sum(2, dtype=np.uint64)) + np.arange(h.tables, dtype=np.uint64)).view(np.int64).reshape(-1)
                if not codes:
                    yield pa.RecordBatch.from_arrays([pa.array(key)], ["key"])
                    continue
                code = np.repeat(np.packbits(x @ code_planes > 0, axis=1), h.tables, axis=0)
                ids = np.repeat(batch.column(0).slice(lo, 2048).to_numpy(), h.tables)
                ends = pa.py_buffer(np.arange(len(key) + 1, dtype=np.int32) * (CODE // 8))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids), pa.Array.from_buffers(pa.binary(), len(key), [None, ends, pa.py_buffer(code)])], ["key", "id", "code"])

    return items.select("id", "v").mapInArrow(run, "key long, id long, code binary" if codes else "key long")


def settle(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n places the first place of its component, given pairs of places."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def bucket_hubs(group: np.ndarray, own: np.ndarray, mixed: np.ndarray, ids: np.ndarray, code: np.ndarray, far: int) -> tuple[np.ndarray, np.ndarray]:
    """(id, hub) of the candidates. Rows are sorted by group and id; mixed: whether only pairs of different ``own`` are meant."""
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[start, len(group)])
    of = np.repeat(size, size)
    words = code.view(np.uint64)
    left, right = [], []
    for d in range(1, min(SMALL, size.max())):
        k = np.flatnonzero((of[:-d] <= SMALL) & (group[d:] == group[:-d]) & (~mixed[:-d] | (own[d:] != own[:-d])))
        near = np.bitwise_count(words[k] ^ words[k + d]).sum(1) <= far
        left.append(k[near])
        right.append(k[near] + d)
    none = np.empty(0, np.int64)
    label = settle(np.concatenate([none, *left]), np.concatenate([none, *right]), len(group))
    for s, n in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist()):
        sign = 1 - 2 * np.unpackbits(code[s : s + n], axis=1).astype(np.float32)
        near = sign @ sign.T >= CODE - 2 * far
        np.fill_diagonal(near, False)
        if mixed[s]:
            near &= own[s : s + n, None] != own[None, s : s + n]
        label[s : s + n] = s + neardup.roots(near)
    linked = np.bincount(label, minlength=len(label))[label] > 1
    return ids[linked], ids[label[linked]]


def hubs(items: DataFrame, h: Hashing, most: int) -> Table:
    """(id, hub) of all candidates."""
    large = Table(keys(items, h, False).groupBy("key").count().where(F.col("count") > most).select("key", F.ceil(F.col("count") / most).cast("int").alias("nb")), "large-buckets")
    each, zero = keys(items, h, True), F.lit(0).alias
    if large.df.isEmpty():
        dealt = each.select("key", zero("i"), zero("j"), zero("own"), "id", "code")
    else:
        hit = bits.has(bits.build(large.df, "key").df.scalar(), F.col("key"))
        some = each.where(hit).join(large.df, "key", "left").withColumn("nb", F.coalesce("nb", F.lit(1)))
        some = some.withColumn("own", F.pmod(F.xxhash64("id", F.lit("bucket")), F.col("nb")).cast("int"))
        some = some.select("*", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other"))
        some = some.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "code")
        dealt = each.where(~hit).select("key", zero("i"), zero("j"), zero("own"), "id", "code").unionByName(some)
    far = h.far

    def run(batches):
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            off = np.frombuffer(batch.column(5).buffers()[1], np.int32)[batch.column(5).offset :]
            code = np.frombuffer(batch.column(5).buffers()[2], np.uint8)[off[0] : off[batch.num_rows]].reshape(batch.num_rows, CODE // 8)
            new = [*(batch.column(k).to_numpy() for k in range(5)), code]
            rest = new if rest is None else [np.concatenate(x) for x in zip(rest, new)]
            key, i, j = rest[:3]
            change = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            if len(change):  # the last group may go on
                yield out([x[: change[-1]] for x in rest])
                rest = [x[change[-1] :] for x in rest]
        if rest is not None:
            yield out(rest)

    def out(rows):
        key, i, j, own, ids, code = rows
        group = np.cumsum(np.r_[False, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in bucket_hubs(group, own, i != j, ids, np.ascontiguousarray(code), far)], ["id", "hub"])

    grouped = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id")
    found = Table(grouped.mapInArrow(run, "id long, hub long").distinct(), "members")
    large.drop()
    return found


def cosines(x: np.ndarray, threshold: float) -> np.ndarray:
    """A symmetric boolean matrix: cosine of at least ``threshold`` (False on the diagonal)."""
    x = scaled(x)
    norm = np.sqrt((x * x).sum(1))
    unit = x / norm[:, None]
    out = np.empty((len(x), len(x)), bool)
    for a in range(0, len(x), 256):
        c = unit[a : a + 256] @ unit.T
        # Next to the threshold a pair is worked out by itself, so that its fate doesn't depend on its group.
        i, j = np.nonzero(np.abs(c - threshold) < 1e-9)
        lo, hi = np.minimum(i + a, j), np.maximum(i + a, j)
        c[i, j] = (x[lo] * x[hi]).sum(1) / (norm[lo] * norm[hi])
        out[a : a + 256] = c >= threshold
    np.fill_diagonal(out, False)
    return out


def link(routed: DataFrame, width: int, threshold: float) -> Table:
    """(id, links, root). routed: id, hubs, at, v, copies; links count copies."""
    each = routed.select("id", "hubs", "v", "copies", F.explode("at").alias("g"))
    each = each.select("id", "hubs", "v", "copies", F.col("g.hub").alias("hub"), F.col("g.own").alias("own"), F.explode(F.sequence(F.lit(0), F.col("g.nb") - 1)).alias("other"))
    each = each.select("hub", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", F.struct("v", "copies").alias("payload"), "hubs")

    def decode(column):
        x = V.dense(column.field("v"), width)
        copies = column.field("copies").to_numpy()
        return list(zip(x, copies))

    def run(batches):
        waiting, held = [], 0
        for g in neardup.groups(batches, decode, True):
            ids = np.concatenate(g.ids)
            if len(ids) < 2:
                continue
            hub, i, j = g.key
            own, copies = np.concatenate(g.own), np.array([c for _, c in g.sets])
            near = cosines(np.array([x for x, _ in g.sets]), threshold)
            if i != j:
                near &= own[:, None] != own[None, :]
            some = near.any(1)
            if not some.any():
                continue
            root = ids[neardup.roots(near)][some]
            met = neardup._met_before(g.hubs, hub)
            if met is not None:
                near &= ~met
            links = np.concatenate([near[a : a + 256] @ copies for a in range(0, len(near), 256)])
            waiting.append((ids[some], links[some].astype(np.int64), root))
            held += len(root)
            if held >= 1 << 14:
                yield neardup._links(waiting)
                waiting, held = [], 0
        if waiting:
            yield neardup._links(waiting)

    # Sorted by id too: the first item of a component is its least.
    grouped = each.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j", "id")
    return Table(grouped.mapInArrow(run, "id long, links long, root long"), "links")


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL, bucket: int = BUCKET, items_a_block: int = ITEMS) -> DataFrame:
    """One row per row of ``rows``: its id (named as there), n_links, component_id, kept."""
    v = F.col(vector_col)
    ok = V.usable(v) & F.coalesce(F.exists(v.cast("array<double>"), lambda x: x != 0), F.lit(False))
    src = rows.select(F.col(id_col).alias("row_id"), v.alias("v"), F.when(ok, F.xxhash64(v.cast("array<double>"))).alias("id"))
    items = Table(src.where("id is not null").groupBy("id").agg(F.first("v").alias("v"), F.count("*").alias("copies"), F.min("row_id").alias("least")), "vectors")
    width, n = V.longest(items.df, "v", F.count("*"))
    zero, out = F.lit(0).cast("long"), [F.col("row_id").alias(id_col), "n_links", "component_id", F.col("row_id").eqNullSafe(F.col("component_id")).alias("kept")]
    if not n:
        items.drop()
        return src.select("row_id", zero.alias("n_links"), F.col("row_id").alias("component_id")).select(*out)
    h = Hashing.of(width, n, threshold, recall, bucket)
    member = hubs(items.df, h, items_a_block)
    at = neardup.route(member.df, member.df.select("id").distinct().withColumn("size", F.lit(width)), BLOCK, items_a_block)
    member.drop()
    wanted = bits.build(at.df, "id")
    links = link(at.df.join(items.df.where(bits.has(wanted.df.scalar(), F.col("id"))).select("id", "v", "copies"), "id"), width, threshold)
    at.drop()
    root = neardup.components(links.df.select("id", "root"))
    near = links.df.groupBy("id").agg(F.sum("links").alias("links"))
    named = items.df.select("id", "copies", "least").join(near, "id", "left").join(root.df, "id", "left")
    some = Table(named.where("copies > 1 OR links IS NOT NULL").select("id", "least", (F.col("copies") - 1 + F.coalesce("links", zero)).alias("n_links"), F.coalesce("root", "id").alias("root")), "linked")
    # The least ids are a table of their own, so that Spark can split a hot component in the join.
    least = Table(some.df.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    info = Table(some.df.join(least.df, "root").select("id", "n_links", "component_id"), "infos")
    for t in (links, root, some, least, wanted, items):
        t.drop()
    hit = F.coalesce(F.col("id").isNotNull() & bits.has(bits.build(info.df, "id").df.scalar(), F.col("id")), F.lit(False))
    alone = src.where(~hit).select("row_id", zero.alias("n_links"), F.col("row_id").alias("component_id"))
    joined = src.where(hit).select("row_id", "id").join(info.df.withColumn("found", F.lit(True)), "id", "left")
    joined = joined.select("row_id", F.coalesce("n_links", zero).alias("n_links"), F.when(F.col("found"), F.col("component_id")).otherwise(F.col("row_id")).alias("component_id"))
    return alone.unionByName(joined).select(*out)


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: DuckDB: the cosines of all pairs, components by a recursive walk.
OP12_SQL = f"""WITH RECURSIVE t AS (SELECT row_number() OVER () AS row, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT row, vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM t WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
near AS MATERIALIZED (SELECT a.row AS a, b.row AS b, b.vec_id FROM ok a JOIN ok b ON a.row <> b.row
WHERE list_sum(list_transform(range(1, least(len(a.e), len(b.e)) + 1), lambda i: a.e[i] * b.e[i])) / (a.norm * b.norm) >= {THRESHOLD}),
walk AS (SELECT a, b, vec_id FROM near UNION SELECT walk.a, near.b, near.vec_id FROM walk JOIN near ON near.a = walk.b),
reached AS (SELECT a AS row, min(vec_id) AS least FROM walk GROUP BY a), counted AS (SELECT a AS row, count(*) AS n FROM near GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, least) AS component_id, vec_id IS NOT DISTINCT FROM least(vec_id, least) AS kept FROM t LEFT JOIN reached USING (row) LEFT JOIN counted USING (row)"""
