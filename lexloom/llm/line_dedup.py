"""Fuzzy line dedup: one line stays per component of similar lines.

Lines are split at \\n. A line's shingles are its runs of ``width`` characters (code
points); a shorter line is one shingle. Signatures, high-recall bands, exact
verification and components are those of ``neardup``; equal lines are one item
from the start. Of each component the first occurrence stays: the one of the
least doc_id, then of the least line number, then (where ids are null or repeat)
of the least hash of doc_id and text, so that one occurrence stays whatever the ids.

Defined results: a null text has no lines; lines without anything but white
space are layout and always stay. Rows without a doc_id come last in the order.
Rows that repeat doc_id and text get the same decision. A text that loses all
its lines becomes an empty text; its row stays unless ``drop_emptied`` is asked for.
Bytes that aren't UTF-8 count as U+FFFD. Columns of any other name pass through. Lines are told
apart by a 64-bit hash: among 10^9 different lines two are taken for equal with a
chance of 3%.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bits, neardup
from . import kernel as K
from .ngram_join import bands_for
from .scratch import Table, free

WIDTH, THRESHOLD, RECALL, ROWS = 7, 0.8, 0.99, 4
#: Bytes of text worked on at a time: small enough for the arrays to stay in a core's cache.
PIECE = 1 << 17
LAST = (1 << 63) - 1


#: A value per code point of the first plane; those beyond are worked out.
_POINT = K.mix(np.arange(1, (1 << 16) + 1, dtype=K.U64))


def points(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts of a piece as code points and their offsets; bytes that aren't UTF-8 count as U+FFFD."""
    if not len(data) or data.view(np.int8).min() >= 0:
        return off, data
    raw = data.tobytes()
    try:
        cp = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        return off - np.searchsorted(np.flatnonzero((data & 0xC0) == 0x80), off), cp
    except UnicodeDecodeError:
        each = [raw[a:b].decode("utf-8", "replace").encode("utf-32-le") for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
        return np.concatenate([[0], np.cumsum([len(x) // 4 for x in each])]).astype(np.int64), np.frombuffer(b"".join(each), np.uint32)


def point_prefix(cp: np.ndarray) -> np.ndarray:
    """Prefix hashes over code points."""
    if cp.dtype == np.uint8:
        return K.prefix(np.take(_POINT, cp), K._Q)
    v = np.take(_POINT, cp, mode="clip")
    far = np.flatnonzero(cp >= len(_POINT))
    v[far] = K.mix(cp[far].astype(K.U64) + K.U64(1))
    return K.prefix(v, K._Q)


class Lines:
    """Lines of a piece with something else than white space: their ids (a hash of their code points), places and numbers."""

    def __init__(self, off: np.ndarray, data: np.ndarray):
        self.off, self.cp = points(off, data)
        cp = self.cp
        self.prefix = point_prefix(cp)
        start, end, ptr = K.lines(self.off, cp)
        inside = ~((cp == 32) | (cp - cp.dtype.type(9) <= 4))
        # Behind a line that isn't empty there is nothing but line ends up to the next one.
        some = np.flatnonzero(end > start)
        at = some[np.bitwise_or.reduceat(inside.view(np.uint8), start[some]) > 0] if len(some) else some
        self.text = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))[at]
        self.number = at - ptr[self.text]
        self.count = np.diff(ptr)
        self.start, self.end = start[at], end[at]
        self.id = K.spans_hash(self.prefix, self.start, self.end, K._Q)

    def line(self, k: int) -> str:
        x = self.cp[self.start[k] : self.end[k]]
        return x.tobytes().decode("latin-1" if x.dtype == np.uint8 else "utf-32-le", "replace")

    def shingles(self, sel: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """32-bit shingle hashes of some lines (ascending), for signatures, and the first of each."""
        return windows(self.prefix, self.start[sel], self.end[sel], width, lambda x, n: (x >> K.U64(32)).astype(np.uint32))


def windows(pre: np.ndarray, start: np.ndarray, end: np.ndarray, width: int, finish) -> tuple[np.ndarray, np.ndarray]:
    """A hash per run of ``width`` code points of each line (the whole of a shorter line), and the first of each line. ``finish(x, length)``."""
    n, (_, down) = len(pre) - 1, K.powers(K._Q, len(pre))
    long = end - start >= width
    edge = np.zeros(n + 2, np.int8)
    edge[start[long]] += 1
    edge[end[long] - width + 1] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
    a, b = start[~long], end[~long]
    short = finish((pre[b] - pre[a]) * down[a], b - a)
    h = np.zeros(n + 1, short.dtype)
    if n >= width:
        h[: n - width + 1] = finish((pre[width:] - pre[:-width]) * down[: n - width + 1], width)
    inside[a] = True
    h[a] = short
    size = np.maximum(end - start - width + 1, 1)
    return h[inside], np.cumsum(size) - size


def _whole(x: np.ndarray, n) -> np.ndarray:
    more = n.astype(K.U64) * K.U64(K._Q) if isinstance(n, np.ndarray) else K.U64(n * K._Q & (1 << 64) - 1)
    return K.mix(x + more)


def line_sets(col: pa.Array, width: int) -> list[np.ndarray]:
    """The shingle sets (64-bit hashes) of a column of lines, none of them empty."""
    out = []
    for _, _, off, data in K.pieces(col, PIECE):
        off, cp = points(off, data)
        key, first = windows(point_prefix(cp), off[:-1], off[1:], width, _whole)
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(key)]):
            s = key[a:b]
            s.sort()
            new = s[1:] != s[:-1]
            out.append(s if new.all() else np.append(s[:1], s[1:][new]))
    return out


class Known:
    """Ids seen before, as far as a table of fixed size remembers them: one that is forgotten is only signed again."""

    def __init__(self, log_slots: int = 16):
        self.table, self.mask = np.zeros(1 << log_slots, K.U64), K.U64((1 << log_slots) - 1)

    def new(self, ids: np.ndarray) -> np.ndarray:
        at = (ids & self.mask).astype(np.int64)
        out = self.table[at] != ids
        self.table[at[out]] = ids[out]
        return out


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, doc (the order of rows), tkey (names doc_id and text), text."""
    return docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[id_col].cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(docs[id_col], docs[text_col]).alias("tkey"), docs[text_col].alias("text"))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


class Removed:
    """``lines``: (tkey, removed: array of (line, kept_doc, kept_line)) of the texts that lose a line; ``texts``: (doc_id, tkey, n_lines) of every row."""

    def __init__(self, lines: Table, texts: DataFrame):
        self.lines, self.texts = lines, texts


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS, block: int = neardup.BLOCK) -> Removed:
    """Reads every text twice: for ids and signatures of its lines, and for the lines that have candidates."""
    src, bands = _source(docs, id_col, text_col), bands_for(threshold, recall, rows)
    kind = docs.schema[id_col].dataType.simpleString()

    def sign(batches):
        """A row per text (line: number of lines), per line that isn't white (id), and per different line (size, buckets)."""
        names, known = ["doc_id", "doc", "tkey", "line", "id", "size", "buckets"], Known()
        for batch in batches:
            doc, tkey = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            no = lambda n, t: pa.nulls(n, t)
            lists = pa.list_(pa.int64())
            for lo, hi, off, data in K.pieces(batch.column(3), PIECE):
                x, n = Lines(off, data), hi - lo
                lines = np.where(batch.column(3).slice(lo, n).is_null().to_numpy(zero_copy_only=False), 0, x.count)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.array(doc[lo:hi]), pa.array(tkey[lo:hi]), pa.array(lines.astype(np.int32)), no(n, pa.int64()), no(n, pa.int64()), no(n, lists)], names)
                n = len(x.id)
                if not n:
                    continue
                yield pa.RecordBatch.from_arrays([no(n, batch.column(0).type), pa.array(doc[lo:hi][x.text]), pa.array(tkey[lo:hi][x.text]), pa.array(x.number.astype(np.int32)), _signed(x.id), no(n, pa.int64()), no(n, lists)], names)
                _, first = np.unique(x.id, return_index=True)
                sel = np.sort(first)
                sel = sel[known.new(x.id[sel])]
                n = len(sel)
                if not n:
                    continue
                shingle, ptr = x.shingles(sel, width)
                keys = neardup.band_keys(shingle, ptr, bands, rows)
                size = np.diff(np.append(ptr, len(shingle)))
                buckets = pa.ListArray.from_arrays(np.arange(0, (n + 1) * bands, bands, dtype=np.int32), _signed(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([no(n, batch.column(0).type), no(n, pa.int64()), no(n, pa.int64()), no(n, pa.int32()), _signed(x.id[sel]), pa.array(size), buckets], names)

    signed = Table(src.mapInArrow(sign, f"doc_id {kind}, doc long, tkey long, line int, id long, size long, buckets array<long>"), "lines")
    signs = signed.df.where("size is not null")
    occurrences = signed.df.where("id is not null and size is null").select("id", "doc", "tkey", "line")
    member = neardup.members(signs.select("id", F.explode("buckets").alias("bucket")))
    at = neardup.route(member.df, signs.groupBy("id").agg(F.max("size").alias("size")), block)
    member.drop()
    wanted = docs.sparkSession.sparkContext.broadcast(bits.local(at.df, "id"))

    def fetch(batches):
        known = Known(20)
        for batch in batches:
            for _, _, off, data in K.pieces(batch.column(0), PIECE):
                x = Lines(off, data)
                hit = np.flatnonzero(bits.test(wanted.value, x.id))
                hit = hit[np.unique(x.id[hit], return_index=True)[1]]
                hit = hit[known.new(x.id[hit])]
                yield pa.RecordBatch.from_arrays([_signed(x.id[hit]), pa.array([x.line(k) for k in hit.tolist()], pa.string())], ["id", "payload"])

    payload = src.select("text").mapInArrow(fetch, "id long, payload string").groupBy("id").agg(F.first("payload").alias("payload"))
    links = neardup.link(at.df.join(payload, "id").drop("hubs"), threshold, lambda col: line_sets(col, width), counts=False)
    at.drop()
    root = neardup.components(links.df.select("id", "root"))
    links.drop()

    # Lines of which some occurrence goes: those that occur again, and all of a component.
    grouped = root.df.unionByName(root.df.select(F.col("root").alias("id"), "root")).distinct()
    again = occurrences.groupBy("id").count().where("count > 1").select("id")
    decided = Table(again.join(grouped, "id", "full").select("id", F.coalesce("root", "id").alias("root")), "decided")
    root.drop()
    hit = bits.has(bits.build(decided.df, "id").df.scalar(), F.col("id"))
    seen = Table(occurrences.where(hit).join(decided.df, "id").select("root", F.struct("doc", "line", "tkey").alias("at")), "occurrences")
    decided.drop()
    # A table of its own: in the join's stage nothing needs the rows of a root together, so Spark can split a common line.
    kept = Table(seen.df.groupBy("root").agg(F.min("at").alias("kept")), "kept-lines")
    gone = seen.df.join(kept.df, "root").where("at != kept")
    removed = F.struct(F.col("at.line").alias("line"), F.col("kept.doc").alias("kept_doc"), F.col("kept.line").alias("kept_line"))
    out = Table(gone.groupBy(F.col("at.tkey").alias("tkey")).agg(F.array_sort(F.collect_set(removed)).alias("removed")), "removed-lines")
    seen.drop()
    kept.drop()
    return Removed(out, signed.df.where("id is null").select("doc_id", "tkey", F.col("line").cast("long").alias("n_lines")))


def cut_out(text: pa.Array, cut: pa.Array) -> pa.Array:
    """Texts without the lines whose numbers (from 0) are given; a text without a list as it is."""
    out = text.cast(pa.binary()).to_pylist()
    for i in np.flatnonzero(cut.is_valid().to_numpy(zero_copy_only=False)).tolist():
        if out[i] is not None:
            lines = out[i].split(b"\n")
            keep = np.ones(len(lines), bool)
            keep[cut[i].values.to_numpy()] = False
            out[i] = b"\n".join(compress(lines, keep.tolist()))
    return pa.array(out, pa.binary()).view(pa.string())


#: Marked so that a filter on its result doesn't make Spark work it out twice, in two Python workers a task.
without_lines = F.arrow_udf(cut_out, T.StringType()).asNondeterministic()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, drop_emptied: bool = False, **options) -> DataFrame:
    """``docs`` with the removed lines cut out of the text; all other columns as they are, but ``length_col`` of a changed text.

    ``drop_emptied``: rows that lose lines and have nothing but white space left go; rows that had nothing else from the start stay.
    """
    gone = removed_lines(docs, id_col, text_col, **options).lines
    key, cut = free(docs.columns, "tkey", "cut")
    keyed = docs.withColumn(key, F.xxhash64(docs[id_col], docs[text_col]))
    hit = bits.has(bits.build(gone.df, "tkey").df.scalar(), F.col(key))
    # Lines are numbered from 0; texts that miss the bit table lose nothing and skip the join.
    joined = keyed.where(hit).join(gone.df.select(F.col("tkey").alias(key), F.col("removed.line").alias(cut)), key, "left")
    changed = joined.withColumn(text_col, without_lines(F.col(text_col), F.col(cut)))
    if drop_emptied:
        changed = changed.where(F.col(cut).isNull() | F.col(text_col).rlike("[^\\x20\\x09-\\x0D]"))
    if length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        changed = changed.withColumn(length_col, F.when(F.col(cut).isNull(), F.col(length_col)).otherwise(F.length(text_col).cast(kind)))
    return keyed.where(~hit).select(docs.columns).unionByName(changed.select(docs.columns))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_removed, removed (line, and which line stands for it)."""
    found = removed_lines(docs, id_col, text_col, **options)
    out = found.texts.join(found.lines.df, "tkey", "left")
    return out.select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), "removed")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
