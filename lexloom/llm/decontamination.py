"""Benchmark decontamination by windows of words.

The benchmark's windows form a hash table that is broadcast: sorted hashes with
the place of their words in one byte buffer. What a table takes is bounded
before it is built (``block_bytes``): beyond it, items are dealt into blocks by
hash and each block scans the texts by itself, giving only the hit words and items of
texts that have any; the last pass joins those few back. One block is the usual
case. Hash hits are verified on the words themselves.

Words: A-Z is lower-cased, then ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``. A window is
13 consecutive words of an item; an item of fewer words, but not none, is one
window. A document word inside any occurrence of a window is hit.

Defined results: a null or empty text has no words and is clean; items without
words or without an id are left out; an id that comes twice counts once;
repeated document rows are judged alike. Other columns pass through untouched,
whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bits
from . import kernel as K
from .scratch import Table, free

WINDOW = 13
#: Bytes a table of windows may take (one item alone may take more).
BLOCK_BYTES = 64 << 20
#: Bytes a window takes beside its words: hash, start, end, item.
PER_WINDOW = 28
REPORT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>"


class Windows:
    """Windows of benchmark items by length: sorted hashes, and the place of their words and the items of each."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.items = sorted({i for i, _ in items})
        code = {x: i for i, x in enumerate(self.items)}
        text, rows = bytearray(), {}
        for item, raw in items:
            data = np.frombuffer(raw.encode(), np.uint8)
            w = K.Words(np.array([0, len(data)]), data, K.ALNUM, lower=True)
            if not len(w.start):
                continue
            size, low, n = min(window, len(w.start)), K.LOWER[data].tobytes(), w.end - w.start
            start = len(text) + np.cumsum(n + 1) - (n + 1)
            text += b" ".join(low[a:b] for a, b in zip(w.start.tolist(), w.end.tolist())) + b" "
            at, keys = K.windows(w.hashes(), w.ptr, size)
            rows.setdefault(size, []).append((keys, start[at], start[at + size - 1] + n[at + size - 1], np.full(len(at), code[item], np.int32)))
        self.text, self.by_size = bytes(text), {}
        for size, parts in sorted(rows.items()):
            keys, a, b, of = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((of, keys))
            keys, a, b, of = keys[order], a[order], b[order], of[order]
            new = np.ones(len(keys), bool)
            new[1:] = keys[1:] != keys[:-1]
            first, owner = np.flatnonzero(new), np.cumsum(new) - 1
            # Hashes under which there are different words: each occurrence is then looked at.
            unlike = {int(owner[k]) for k in np.flatnonzero(~new).tolist() if not self.same(a, b, k, int(first[owner[k]]))}
            self.by_size[size] = keys[first], np.append(first, len(keys)), a, b, of, unlike

    def same(self, a, b, i: int, j: int) -> bool:
        return self.text[a[i] : b[i]] == self.text[a[j] : b[j]]

    def scan(self, off: np.ndarray, data: np.ndarray) -> tuple[K.Words, np.ndarray, list[set[str]]]:
        """Words of a piece, which of them are hit, and the items of each text."""
        w = K.Words(off, data, K.ALNUM, lower=True)
        h, d, out = w.hashes(), np.zeros(len(w.start) + 1, np.int64), [set() for _ in range(len(off) - 1)]
        for size, (keys, ptr, a, b, of, unlike) in self.by_size.items():
            at, k = K.windows(h, w.ptr, size)
            sure = np.flatnonzero(K.member(k, keys))
            place = np.searchsorted(keys, k[sure])
            text = np.searchsorted(w.ptr, at[sure], "right") - 1
            told = set()
            for i, p, t in zip(at[sure].tolist(), place.tolist(), text.tolist()):
                words = b" ".join(K.LOWER[data[x:y]].tobytes() for x, y in zip(w.start[i : i + size], w.end[i : i + size]))
                some = range(ptr[p], ptr[p + 1]) if p in unlike else [ptr[p]]
                found = [x for x in some if self.text[a[x] : b[x]] == words]
                if not found:
                    continue
                d[i] += 1
                d[i + size] -= 1
                if p in unlike:
                    out[t].update(self.items[of[x]] for x in found)
                elif (t, p) not in told:
                    told.add((t, p))
                    out[t].update(self.items[x] for x in of[ptr[p] : ptr[p + 1]].tolist())
        return w, np.cumsum(d[:-1]) > 0, out


def _blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> list[DataFrame]:
    """The items in blocks whose tables are bounded: their text and PER_WINDOW bytes a word."""
    items = items.select(items[id_col].cast("string").alias("item"), items[text_col].alias("text")).where("item is not null and text is not null")
    words = F.regexp_count("text", F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"))
    sized = items.select(F.xxhash64("item", "text").alias("h"), (F.octet_length("text") + PER_WINDOW * words).cast("long").alias("size")).groupBy("h").agg(F.sum("size").alias("size"))
    total, largest = sized.agg(F.sum("size"), F.max("size")).first()
    n, most = max(1, -(-int(total or 0) // block_bytes)), max(block_bytes, int(largest or 0))
    while n > 1:
        n = n + n // 4 + 1
        if sized.groupBy(F.pmod("h", F.lit(n))).agg(F.sum("size").alias("size")).agg(F.max("size")).first()[0] <= most:
            break
    return [items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i) for i in range(n)]


def _hits(texts: DataFrame, table) -> DataFrame:
    """(a, b, spans, items) of the texts that the table hits; a and b name the text, spans are word ranges."""

    def run(batches):
        for batch in batches:
            for lo, hi, off, data in K.pieces(batch.column(2)):
                w, hit, items = table.value.scan(off, data)
                some = [r for r in range(hi - lo) if items[r]]
                if some:
                    spans = [np.flatnonzero(np.diff(np.concatenate([[0], hit[w.ptr[r] : w.ptr[r + 1]].astype(np.int8), [0]]))) for r in some]
                    rows = batch.slice(lo, hi - lo).take(pa.array(some))
                    yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(spans, pa.list_(pa.int64())), pa.array([sorted(items[r]) for r in some], pa.list_(pa.string()))], ["a", "b", "spans", "items"])

    return texts.mapInArrow(run, "a long, b long, spans array<long>, items array<string>").dropDuplicates(["a", "b"])


def scan_documents(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, mode: str = "report", id_col: str = "doc_id", floor: tuple[int, int] = (1, 20)) -> DataFrame:
    """``mode`` "report": id and REPORT; "documents": rows of ``docs`` that are not contaminated; "spans": all rows, hit words cut out of the text.

    A document is contaminated if it has a hit and floor[1] * hit words >= floor[0] * words.
    """
    if mode not in ("report", "documents", "spans"):
        raise ValueError(mode)
    spark, names, schema = docs.sparkSession, docs.columns, docs.schema
    at_text, at_id, width = names.index(text_col), names.index(id_col) if mode == "report" else 0, len(names)
    blocks = _blocks(items, item_id, item_text, block_bytes)
    tell = lambda block: spark.sparkContext.broadcast(Windows([(r.item, r.text) for r in block.collect()], window))
    if len(blocks) == 1:
        state, told = docs, tell(blocks[0])
    else:
        a, b = F.xxhash64(docs[text_col]), F.xxhash64(docs[text_col], F.lit("b"))
        texts = docs.select(a.alias("a"), b.alias("b"), docs[text_col].alias("text"))
        parts = []
        for block in blocks:
            table = tell(block)
            parts.append(Table(_hits(texts, table), "decontamination"))
            table.unpersist()
        found = parts[0].df
        for p in parts[1:]:
            found = found.unionByName(p.df)
        ka, kb, spans, told_items = free(names, "a", "b", "spans", "items")
        merged = Table(found.groupBy(F.col("a").alias(ka), F.col("b").alias(kb)).agg(F.flatten(F.collect_list("spans")).alias(spans), F.array_distinct(F.flatten(F.collect_list("items"))).alias(told_items)), "decontamination")
        for p in parts:
            p.drop()
        # Texts that miss the bit table have no hit and skip the join.
        keyed = docs.withColumns({ka: a, kb: b})
        hit = bits.has(bits.build(merged.df, ka).df.scalar(), F.col(ka))
        none = keyed.where(~hit).withColumns({spans: F.lit(None).cast("array<long>"), told_items: F.lit(None).cast("array<string>")})
        state, told = none.unionByName(keyed.where(hit).join(merged.df, [ka, kb], "left").select(none.columns)).drop(ka, kb), None

    def scan(rows, off, data):
        """Words of a piece, which are hit, and the items of each text."""
        if told is not None:
            return told.value.scan(off, data)
        w = K.Words(off, data, K.ALNUM, lower=True)
        d, items = np.zeros(len(w.start) + 1, np.int64), []
        for r, (spans, some) in enumerate(zip(rows.column(width).to_pylist(), rows.column(width + 1).to_pylist())):
            items.append(set(some or ()))
            if spans:
                np.add.at(d, w.ptr[r] + np.array(spans), np.tile([1, -1], len(spans) // 2))
        return w, np.cumsum(d[:-1]) > 0, items

    def run(batches):
        for batch in batches:
            for lo, hi, off, data in K.pieces(batch.column(at_text)):
                rows = batch.slice(lo, hi - lo)
                w, hit, items = scan(rows, off, data)
                n, n_hit = w.count, K.total(hit, w.ptr)
                bad = (n_hit > 0) & (floor[1] * n_hit >= floor[0] * n)
                if mode == "report":
                    ordered = [sorted(x) for x in items]
                    sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in ordered]
                    arrays = [rows.column(at_id), pa.array(n, pa.int64()), pa.array(n_hit), pa.array([len(x) for x in ordered], pa.int64()), pa.array(sha), pa.array(bad), pa.array(ordered, pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *(x.split()[0] for x in REPORT.split(", "))])
                elif mode == "documents":
                    yield pa.RecordBatch.from_arrays([c.filter(pa.array(~bad)) for c in rows.columns[:width]], names=[f"c{i}" for i in range(width)])
                else:
                    texts = rows.column(at_text).to_pylist()
                    for r in np.flatnonzero(n_hit).tolist():
                        keep = np.ones(off[r + 1] - off[r], bool)
                        for j in range(int(w.ptr[r]), int(w.ptr[r + 1])):
                            if hit[j]:
                                keep[w.start[j] - off[r] : w.end[j] - off[r]] = False
                        texts[r] = data[off[r] : off[r + 1]][keep].tobytes().decode()
                    columns = list(rows.columns[:width])
                    columns[at_text] = pa.array(texts, columns[at_text].type)
                    yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(width)])

    if mode == "report":
        return state.mapInArrow(run, f"doc_id {schema[id_col].dataType.simpleString()}, {REPORT}")
    return state.mapInArrow(run, "struct<" + ",".join(f"c{i}:{f.dataType.simpleString()}" for i, f in enumerate(schema.fields)) + ">").toDF(*names)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("items")


def _windows(table: str, key: str) -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return rf"SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{word}') AS w FROM {table}"


#: DuckDB: an item's windows as strings, joined with a document's windows of the same length.
OP7_SQL = rf"""WITH d AS ({_windows("documents", "doc_id")}), b AS ({_windows("benchmark", "cast(item_id AS VARCHAR) AS item")}),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item, w, least({WINDOW}, len(w)) AS n, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS i FROM b WHERE len(w) > 0 AND item IS NOT NULL)),
s AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, s WHERE len(w) >= n)),
h AS (SELECT doc_id, dw.n, i, item FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
k AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT doc_id, n, i FROM h)) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN k USING (doc_id) LEFT JOIN m USING (doc_id)"""
