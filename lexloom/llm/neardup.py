"""Near-duplicate links between different items by MinHash bands, and their components.

An item is a distinct set of 64-bit shingle hashes, named by a 64-bit id.

1. Every item has ``bands`` bucket keys. The least id of a bucket is its hub.
   A bucket's least and greatest id and its size come from one aggregation with
   partial sums; a bucket of two is thereby complete, and larger ones are joined
   back (after a bounded bit table), where a skewed bucket is split by Spark.
2. An item goes to each of its hubs, with the list of its hubs. All items of one
   hub are compared there on their full sets, so every two items that share a
   bucket are compared. A pair is counted at its least common hub only. No pair
   leaves the task: it gives an item's number of links (where they are wanted), and
   one edge per item to the least item of its local component.
3. A hub with more than ``block`` shingles or ``ITEMS`` items is dealt into blocks
   (at most one an item), and each pair of blocks is a group of its own, so that
   neither the sets nor the matrix of a group are unbounded.
4. Components of the edges come from alternating large-star and small-star
   rounds, each written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bits
from . import kernel as K
from .scratch import Table

BLOCK = 1 << 17
ITEMS = 1 << 11
_A = (K.mix(np.arange(1, 513, dtype=K.U64) * K.U64(0xA24BAED4963EE407)) >> K.U64(32)).astype(np.uint32) | np.uint32(1)


def band_keys(hashes: np.ndarray, ptr: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(items, bands) bucket keys; ``ptr``: the first hash (of 64 or 32 bits) of each item, which has one at least."""
    h = hashes if hashes.dtype == np.uint32 else (hashes >> K.U64(32)).astype(np.uint32)
    out, tmp = np.zeros((len(ptr), bands), K.U64), np.empty_like(h)
    if not len(ptr):
        return out
    for b in range(bands):
        key = np.full(len(ptr), b + 1, K.U64)
        for r in range(rows):
            np.multiply(h, _A[b * rows + r], out=tmp)
            key = K.mix(key * K.U64(K._P) + np.minimum.reduceat(tmp, ptr))
        out[:, b] = key
    return out


def members(pairs: DataFrame) -> Table:
    """(id, hub) for every item and each of its hubs. ``pairs``: id, bucket; a pair may be there more than once."""
    found = Table(pairs.groupBy("bucket").agg(F.min("id").alias("hub"), F.max("id").alias("last"), F.count("*").alias("n")).where("hub != last"), "buckets")
    twos = found.df.where("n = 2").select(F.explode(F.array("hub", "last")).alias("id"), "hub")
    more = found.df.where("n > 2").select("bucket", "hub")
    if more.isEmpty():
        pairs_of = twos
    else:
        table = bits.build(more, "bucket")
        pairs_of = twos.unionByName(pairs.where(bits.has(table.df.scalar(), F.col("bucket"))).join(more, "bucket").select("id", "hub"))
    out = Table(pairs_of.distinct(), "members")
    found.drop()
    return out


def route(member: DataFrame, sizes: DataFrame, block: int = BLOCK, most: int = ITEMS) -> Table:
    """(id, hubs, at): where an item is compared; at: (hub, blocks of the hub, its own block). ``sizes``: id, size."""
    sized = member.join(sizes, "id")
    per = sized.groupBy("hub").agg(F.sum("size").alias("size"), F.count("*").alias("items"))
    nb = F.least(F.greatest(F.ceil(F.col("size") / block), F.ceil(F.col("items") / most)), F.col("items")).cast("int")
    # Only the few hubs that are dealt into blocks are joined back; all others have one block. They are a table of
    # their own, so that nothing in the join's stage needs the rows of a hub together and Spark can split a large one.
    large = Table(per.select("hub", nb.alias("nb")).where("nb > 1"), "large-hubs")
    own = F.pmod(F.xxhash64("id", F.lit("block")), F.col("nb")).cast("int")
    with_blocks = sized.join(large.df, "hub", "left").withColumn("nb", F.coalesce("nb", F.lit(1))).select("id", "hub", "nb", own.alias("own"))
    out = Table(with_blocks.groupBy("id").agg(F.array_sort(F.collect_list("hub")).alias("hubs"), F.collect_list(F.struct("hub", "nb", "own")).alias("at")), "routes")
    large.drop()
    return out


class Group:
    """The rows of one (hub, i, j), gathered over batches."""

    def __init__(self, key: tuple[int, int, int]):
        self.key, self.ids, self.own, self.sets, self.hubs = key, [], [], [], []


def groups(batches, decode: Callable[[pa.Array], list[np.ndarray]], counts: bool) -> Iterator[Group]:
    """Groups from batches that are sorted by hub, i and j; payloads are decoded a batch at a time."""
    held = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        hub, i, j, own, ids = (batch.column(k).to_numpy() for k in range(5))
        sets = decode(batch.column(5))
        if counts:
            lists = batch.column(6)
            off, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        change = (hub[1:] != hub[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), n]
        for a, b in zip(cuts[:-1], cuts[1:]):
            key = (int(hub[a]), int(i[a]), int(j[a]))
            if held is None or held.key != key:
                if held is not None:
                    yield held
                held = Group(key)
            held.ids.append(ids[a:b])
            held.own.append(own[a:b])
            held.sets += sets[a:b]
            if counts:
                held.hubs += [flat[off[k] : off[k + 1]] for k in range(a, b)]
    if held is not None:
        yield held


def _products(col: np.ndarray, who: np.ndarray, items: int, columns: int, exact: type) -> Iterator[np.ndarray]:
    """Matrices (items, items) whose sum counts the columns two items share; (col, who) is sorted by column."""
    width = max(64, min(columns, (1 << 22) // items))
    for lo in range(0, columns, width):
        a, b = np.searchsorted(col, [lo, lo + width])
        x = np.zeros((items, width), exact)
        x[who[a:b], col[a:b] - lo] = 1
        yield x @ x.T


def _shared(keys: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(column, item) pairs, sorted by column, of the keys that two or more items have; and the number of columns."""
    order = np.argsort(keys, kind="stable")
    h, who = keys[order], who[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    col = np.cumsum(new) - 1
    often = np.bincount(col, minlength=1) > 1
    keep = often[col]
    return (np.cumsum(often) - 1)[col[keep]], who[keep], int(often.sum())


def compare(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """A symmetric boolean matrix: Jaccard similarity of at least ``threshold`` (False on the diagonal).

    Memory: 5 bytes a pair of items (9 for sets beyond 2^23) and 32 a shingle.
    """
    m, size = len(sets), np.array([len(s) for s in sets], np.int64)
    exact = np.float32 if size.max() < 1 << 23 else np.float64
    col, who, columns = _shared(np.concatenate(sets), np.repeat(np.arange(m), size))
    inter = np.zeros((m, m), exact)
    for x in _products(col, who, m, columns, exact):
        inter += x
    out = np.empty((m, m), bool)
    for a in range(0, m, 256):
        n = np.rint(inter[a : a + 256].astype(np.float64))
        out[a : a + 256] = n >= threshold * (size[a : a + 256, None] + size[None, :] - n) - 1e-9
    np.fill_diagonal(out, False)
    return out


def near_pairs(pairs: list[tuple[np.ndarray, np.ndarray]], threshold: float) -> np.ndarray:
    """For each pair of sets, at once: Jaccard similarity of at least ``threshold``."""
    size = np.array([len(a) + len(b) for a, b in pairs], np.int64)
    which = np.repeat(np.arange(len(pairs)), size)
    keys = K.salted(np.concatenate([s for p in pairs for s in p]), which)
    order = np.argsort(keys)
    keys = keys[order]
    inter = np.bincount(which[order[1:][keys[1:] == keys[:-1]]], minlength=len(pairs))
    return inter >= threshold * (size - inter) - 1e-9


def roots(near: np.ndarray) -> np.ndarray:
    """For each item the first item of its component."""
    label, left = np.arange(len(near)), near.any(1)
    for first in np.flatnonzero(left).tolist():
        if not left[first]:
            continue
        edge = np.array([first])
        left[first] = False
        while len(edge):
            reached = np.zeros(len(near), bool)
            for a in range(0, len(edge), 256):
                reached |= near[edge[a : a + 256]].any(0)
            edge = np.flatnonzero(reached & left)
            left[edge] = False
            label[edge] = first
    return label


def _met_before(hubs: list[np.ndarray], hub: int) -> np.ndarray | None:
    """Which pairs share a hub below this one, where they are counted; None if no item has one."""
    lower = [x[x < hub] for x in hubs]
    if not any(map(len, lower)):
        return None
    col, who, columns = _shared(np.concatenate(lower), np.repeat(np.arange(len(lower)), [len(x) for x in lower]))
    met = np.zeros((len(hubs), len(hubs)), bool)
    for x in _products(col, who, len(hubs), columns, np.float32):
        met |= x > 0
    return met


def link(routed: DataFrame, threshold: float, decode: Callable[[pa.Array], list[np.ndarray]], counts: bool = True) -> Table:
    """(id, links, root). ``routed``: id, hubs, at, payload; ``decode`` turns a column of payloads into sorted sets of hashes.

    Without ``counts`` links are 0: only the components are wanted, and the lists of hubs are not sent.
    """
    extra = ["hubs"] if counts else []
    each = routed.select("id", *extra, "payload", F.explode("at").alias("g"))
    other = F.explode(F.sequence(F.lit(0), F.col("g.nb") - 1)).alias("other")
    each = each.select("id", *extra, "payload", F.col("g.hub").alias("hub"), F.col("g.own").alias("own"), other)
    each = each.select("hub", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "payload", *extra)

    def run(batches):
        out: list[tuple] = []
        twos, size = [], 0

        def pairs():
            for (ids, sets, hubs, hub), near in zip(twos, near_pairs([t[1] for t in twos], threshold)):
                if near:
                    fresh = not counts or _met_before(hubs, hub) is None or not _met_before(hubs, hub)[0, 1]
                    out.append((ids, np.full(2, int(counts and fresh), np.int64), np.full(2, ids.min())))
            twos.clear()

        for g in groups(batches, decode, counts):
            ids = np.concatenate(g.ids)
            if len(ids) < 2:
                continue
            hub, i, j = g.key
            if len(ids) == 2:
                own = np.concatenate(g.own)
                if i != j and own[0] == own[1]:
                    continue
                twos.append((ids, g.sets, g.hubs, hub))
                size += sum(map(len, g.sets))
                if size > 1 << 17:
                    pairs()
                    size = 0
            else:
                order = np.argsort(ids)
                ids = ids[order]
                near = compare([g.sets[k] for k in order.tolist()], threshold)
                if i != j:
                    own = np.concatenate(g.own)[order]
                    near &= own[:, None] != own[None, :]
                some = near.any(1)
                if not some.any():
                    continue
                root = ids[roots(near)][some]
                if counts:
                    met = _met_before([g.hubs[k] for k in order.tolist()], hub)
                    links = (near if met is None else near & ~met).sum(1)[some].astype(np.int64)
                else:
                    links = np.zeros(len(root), np.int64)
                out.append((ids[some], links, root))
            if len(out) >= 4096:
                yield _links(out)
                out.clear()
        if twos:
            pairs()
        if out:
            yield _links(out)

    grouped = each.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j")
    return Table(grouped.mapInArrow(run, "id long, links long, root long"), "links")


def _links(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["id", "links", "root"])


def components(edges: DataFrame) -> Table:
    """(id, root) for every id of the edges (id, root) but the roots themselves; root is the least id of its component.

    The least neighbours are a table of their own in each step: in the join's stage nothing needs the rows of an id
    together, so Spark can split an id with many neighbours.
    """
    table = Table(edges.where("id != root").select(F.greatest("id", "root").alias("u"), F.least("id", "root").alias("v")).distinct(), "edges")
    mark = lambda t: tuple(t.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    state = mark(table)
    while state[0]:
        both = table.df.union(table.df.select("v", "u"))
        low = Table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = Table(both.where("v > u").join(low.df, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        table.drop()
        low.drop()
        low = Table(large.df.groupBy("u").agg(F.min("v").alias("m")), "least")
        joined = large.df.join(low.df, "u")
        small = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.df.select("u", F.col("m").alias("v")))
        table = Table(small.distinct(), "edges")
        large.drop()
        low.drop()
        before, state = state, mark(table)
        if state == before:
            break
    table.df = table.df.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return table
