"""N-gram Jaccard join of documents by MinHash banding.

Shingles are five consecutive words (runs of anything but space, tab and line
ends); a text of fewer words, but not none, is one shingle. Texts with equal
shingle sets are copies: one stands for all, so copies never meet as pairs.
Band and row counts are chosen for a target recall at the threshold. Candidate
pairs are verified on their full sets (see ``neardup``).

Defined results: a null or empty text has no words; it is in a class by itself,
has no links and is always kept. Rows of one doc_id are joined like any others.
The class id is the least doc_id of the class (null ids count only if there is
no other). Of rows with words that repeat doc_id and text, ``keep_one`` keeps the one whose columns come first in
order (nulls first; columns without an order by their JSON text); rows without words all stay, repeated or not. Columns of any other name pass through it. Where ids are null or repeat, unlike classes can share it, so a class
is told by its class_key, the least set id of its component. Shingle sets are told apart by a 64-bit hash: among 10^9 different
texts two are taken for copies with a chance of 3%.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bits, neardup
from . import kernel as K
from .scratch import Table, free

WIDTH, THRESHOLD, RECALL, ROWS = 5, 0.8, 0.999, 6


def bands_for(threshold: float, recall: float, rows: int) -> int:
    """The least number of bands of ``rows`` rows that finds a pair at the threshold with the recall."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))


def shingles(off: np.ndarray, data: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes in text order, and the first of each text (and the end)."""
    w = K.Words(off, data)
    h = w.hashes()
    at, key = K.windows(h, w.ptr, width)
    few = np.flatnonzero((w.count > 0) & (w.count < width))
    if len(few):
        pre = K.prefix(h, K._Q)
        short = K.spans_hash(pre, w.ptr[few], w.ptr[few + 1], K._Q)
        at, key = np.concatenate([at, w.ptr[few]]), np.concatenate([key, short])
        order = np.argsort(at)
        at, key = at[order], key[order]
    return key, np.searchsorted(at, w.ptr)


def sets_of(key: np.ndarray, ptr: np.ndarray) -> list[np.ndarray]:
    return [np.unique(key[a:b]) for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist())]


def set_id(s: np.ndarray) -> int:
    return int(K.mix(np.array([np.add.reduce(K.mix(s ^ K.U64(K._Q)), dtype=K.U64) + K.U64(len(s))]))[0])


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, tkey (names the row's id and text), id (of its shingle set), size, b0, b1, ..."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [f"b{i}" for i in range(bands)]

    def run(batches):
        for batch in batches:
            for lo, hi, off, data in K.pieces(batch.column(2)):
                key, ptr = shingles(off, data, width)
                sets = sets_of(key, ptr)
                size = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(size)
                rows_of = neardup.band_keys(key, ptr[:-1][some], bands, rows)
                full = np.zeros((hi - lo, bands), K.U64)
                full[some] = rows_of
                ids = np.array([set_id(s) for s in sets], K.U64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(ids.view(np.int64)), pa.array(size), *[pa.array(full[:, b].copy().view(np.int64)) for b in range(bands)]], ["doc_id", "tkey", "id", "size", *names])

    src = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(docs[id_col], docs[text_col]).alias("tkey"), docs[text_col].alias("text"))
    return src.mapInArrow(run, f"doc_id {kind}, tkey long, id long, size long, " + ", ".join(f"{n} long" for n in names))


def contents(docs: DataFrame, text_col: str, width: int, wanted: np.ndarray) -> DataFrame:
    """(id, payload) of the texts whose set passes the bit table, each set once per task and then once in all."""
    told = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for _, _, off, data in K.pieces(batch.column(0)):
                key, ptr = shingles(off, data, width)
                ids, out = [], []
                for s in sets_of(key, ptr):
                    if not len(s):
                        continue
                    i = set_id(s)
                    if i not in seen and bits.test(told.value, np.array([i], K.U64))[0]:
                        seen.add(i)
                        ids.append(i)
                        out.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, K.U64).view(np.int64)), pa.array(out, pa.binary())], ["id", "payload"])

    return docs.select(docs[text_col]).mapInArrow(run, "id long, payload binary").groupBy("id").agg(F.first("payload").alias("payload"))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS, block: int = neardup.BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, tkey, class_id, class_key, n_links, n_copies.

    class_key: names the class whatever the ids, null without words (a class by itself);
    n_links: different texts (shingle sets) that are similar to this one, null without words; n_copies: rows with this one's set.
    """
    bands = bands_for(threshold, recall, rows)
    sig = Table(signatures(docs, id_col, text_col, width, bands, rows), "signatures")
    worded = sig.df.where("size > 0")
    names = [f"b{i}" for i in range(bands)]
    one = worded.groupBy("id").agg(*[F.max(n).alias(n) for n in names])
    member = neardup.members(one.select("id", F.explode(F.array(*names)).alias("bucket")))
    sizes = worded.groupBy("id").agg(F.max("size").alias("size"))
    at = neardup.route(member.df, sizes, block)
    member.drop()
    sets = contents(docs, text_col, width, bits.local(at.df, "id"))
    links = neardup.link(at.df.join(sets, "id"), threshold, lambda col: [np.frombuffer(x.as_buffer(), K.U64) for x in col])
    at.drop()
    root = neardup.components(links.df.select("id", "root"))
    counts = worded.groupBy("id").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_copies"))
    near = links.df.groupBy("id").agg(F.sum("links").alias("n_links"))
    known = counts.join(near, "id", "left").join(root.df, "id", "left").withColumn("root", F.coalesce("root", "id"))
    named = Table(known, "classes")
    links.drop()
    root.drop()
    classes = named.df.groupBy("root").agg(F.min("first").alias("class_id"))
    info = named.df.join(classes, "root").select("id", "class_id", F.col("root").alias("class_key"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    rows_ = sig.df.select("doc_id", "tkey", "id", "size")
    some = rows_.where("size > 0").join(info, "id").select("doc_id", "tkey", "class_id", "class_key", "n_links", "n_copies")
    none = rows_.where("size = 0").select("doc_id", "tkey", F.col("doc_id").alias("class_id"), F.lit(None).cast("long").alias("class_key"), F.lit(None).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return some.unionByName(none)


def in_order(df: DataFrame) -> Column:
    """All columns as one value with an order; a column that has none (it holds a map or a variant) as JSON."""
    unordered = lambda t: "map<" in t or "variant" in t
    return F.struct(*[F.to_json(F.struct(F.col(f"`{f.name}`"))) if unordered(f.dataType.simpleString()) else F.col(f"`{f.name}`") for f in df.schema.fields])


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each class the one of the least doc_id (null ids last), and all without words.

    Rows with words that repeat doc_id and text are one: the first in the order of all their columns stays.
    Rows whose key misses the bit tables of removed and of repeated ones stay without a shuffle; only the others are joined or grouped.
    """
    found = Table(similar_documents(docs, id_col, text_col), "similar")
    worded = found.df.where("n_links is not null")
    kept = worded.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("class_key").agg(F.min("tkey").alias("stay"))
    # A row is removed if another one of its class stays.
    gone = Table(worded.join(kept, "class_key").where("tkey != stay").select("tkey").distinct(), "removed")
    repeated = Table(worded.groupBy("tkey").count().where("count > 1").select("tkey"), "repeated")
    found.drop()
    key, many = free(docs.columns, "tkey", "many")
    keyed = docs.withColumn(key, F.xxhash64(docs[id_col], docs[text_col]))
    hit = bits.has(bits.build(gone.df, "tkey").df.scalar(), F.col(key))
    stay = keyed.where(~hit).unionByName(keyed.where(hit).join(gone.df.withColumnRenamed("tkey", key), key, "left_anti").select(keyed.columns))
    if not repeated.df.isEmpty():
        hit = bits.has(bits.build(repeated.df, "tkey").df.scalar(), F.col(key))
        told = stay.where(hit).join(repeated.df.select(F.col("tkey").alias(key), F.lit(True).alias(many)), key, "left")
        one = told.where(F.col(many)).groupBy(key).agg(F.min_by(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]), in_order(docs)).alias("row"))
        one = one.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
        return stay.where(~hit).select(docs.columns).unionByName(told.where(F.col(many).isNull()).select(docs.columns)).unionByName(one)
    return stay.select(docs.columns)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("tkey", "class_key").fillna(0, ["n_links"])


#: DuckDB: all pairs of different shingle sets that share a shingle, compared on their full sets; classes by a recursive walk.
OP4_SQL = rf"""WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN NULL WHEN len(w) < {WIDTH} THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - {WIDTH - 2}), lambda i: array_to_string(w[i:i + {WIDTH - 1}], ' ')))) END AS s FROM t),
one AS (SELECT row_number() OVER (ORDER BY min(doc_id)) AS id, s, len(s) AS n, count(*) AS n_copies, min(doc_id) AS first FROM sets WHERE s IS NOT NULL GROUP BY s),
x AS (SELECT id, n, unnest(s) AS g FROM one),
pairs AS (SELECT a.id AS a, b.id AS b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb FROM x a JOIN x b ON a.g = b.g AND a.id <> b.id GROUP BY 1, 2),
near AS (SELECT a, b FROM pairs WHERE shared >= {THRESHOLD} * (na + nb - shared) - 1e-9),
walk AS (SELECT id AS a, id AS r FROM one UNION SELECT near.b, walk.r FROM walk JOIN near ON near.a = walk.a),
root AS (SELECT a AS id, min(r) AS root FROM walk GROUP BY 1),
class AS (SELECT root, min(first) AS class_id FROM root JOIN one USING (id) GROUP BY 1),
links AS (SELECT a AS id, count(*) AS n_links FROM near GROUP BY 1),
info AS (SELECT s, class_id, coalesce(n_links, 0) AS n_links, n_copies FROM one JOIN root USING (id) JOIN class USING (root) LEFT JOIN links USING (id))
SELECT doc_id, class_id, n_links, n_copies FROM sets JOIN info USING (s) UNION ALL SELECT doc_id, doc_id, 0, 1 FROM sets WHERE s IS NULL"""
