"""Packing token streams: concatenate and cut.

Pass 1 tokenises every text once and writes (partition, tokens before the
document in its partition, ids) to a table in the shared folder. Between the
passes only one total per partition goes to the driver; its prefix sums give
each partition a global offset. Pass 2 cuts the one long stream at multiples of
``length`` and writes a record per piece. Nothing is shuffled.

Ids are those of the given byte-level BPE file of ``tokenizers``. Texts of
plain Latin letters without very long runs go through ``tiktoken`` with the
same vocabulary, which gives equal ids (a test holds them against each other)
several times faster; every other text goes through ``tokenizers`` itself.

Defined results: a null or empty text is a document of one token, the end id.
Rows are packed as they stand, so repeated rows are packed twice. An empty
table gives no pieces. Only the last sequence can be shorter than ``length``.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .scratch import Table

LENGTH = 1024
END_ID = 0
#: Runs of one kind of character from this length on go through ``tokenizers``.
LONG_RUN = 400


class Encoder:
    """Ids of texts; made once per worker."""

    def __init__(self, json_path: str, ranks_path: str | None, pattern: str | None):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(json_path)
        self.fast, self.special = None, []
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
            self.fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str, plain: bool) -> np.ndarray:
        if plain and self.fast is not None and not any(s in text for s in self.special):
            return np.asarray(self.fast.encode_ordinary(text), np.uint32)
        return np.asarray(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


def plain_texts(off: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Texts without characters from U+0280 on and without long runs."""
    n = len(off) - 1
    plain, owner = np.ones(n, bool), lambda at: np.searchsorted(off, at, "right") - 1
    plain[owner(np.flatnonzero((data >= 0xCA) | (data == 0x85)))] = False
    # A long run has no change between space and other within LONG_RUN bytes.
    space = np.take(~K.SPACED, data)
    edge = np.zeros(len(data) + 1, bool)
    np.not_equal(space[1:], space[:-1], out=edge[1:-1])
    edge[off] = True
    change = np.flatnonzero(edge)
    plain[np.minimum(owner(change[:-1][np.diff(change) >= LONG_RUN]), n - 1)] = False
    return plain


def tokenise(docs: DataFrame, id_col: str, text_col: str, files: tuple[str, str | None, str | None], end_id: int) -> DataFrame:
    """Pass 1: (part, before, doc_id, doc_tokens, ids)."""

    def run(batches):
        enc, part, before = Encoder(*files), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for lo, hi, off, data in K.pieces(texts):
                plain = plain_texts(off, data)
                ids = [np.append(enc.encode(t, p), np.uint32(end_id)) for t, p in zip(texts.slice(lo, hi - lo).to_pylist(), plain)]
                n = np.array([len(x) for x in ids], np.int64)
                first = before + np.concatenate([[0], np.cumsum(n)[:-1]])
                before += int(n.sum())
                packed = [x.astype("<u2" if x.max() < 65536 else "<u4").tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(hi - lo, part, np.int32)), pa.array(first.astype(np.int64)), batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(packed, pa.binary())], ["part", "before", "doc_id", "doc_tokens", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col], docs[text_col]).mapInArrow(run, f"part int, before long, doc_id {kind}, doc_tokens long, ids binary")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, files: tuple[str, str | None, str | None] | None = None, with_ids: bool = False) -> DataFrame:
    """A boundary record per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ``ids`` on request)."""
    if files is None:
        import public_tokenizers as P

        files = (P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    stream = Table(tokenise(docs, id_col, text_col, files, end_id), "packing")
    totals = stream.df.groupBy("part").agg(F.sum("doc_tokens").alias("n")).orderBy("part").collect()
    parts = np.array([r.part for r in totals], np.int64)
    base = np.concatenate([[0], np.cumsum([r.n for r in totals])]).astype(np.int64)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column(3).to_numpy()
            g = base[np.searchsorted(parts, batch.column(0).to_numpy())] + batch.column(1).to_numpy()
            first, last = g // length, (g + n - 1) // length
            many = last - first + 1
            doc = np.repeat(np.arange(len(n)), many)
            seq = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
            start = np.maximum(seq * length - g[doc], 0)
            end = np.minimum((seq + 1) * length - g[doc], n[doc])
            crc, out_ids, held, k = [], [], None, -1
            for d, a, b in zip(doc.tolist(), start.tolist(), end.tolist()):
                if d != k:
                    raw, k = batch.column(4)[d].as_buffer(), d
                    held = np.frombuffer(raw, "<u2" if raw.size == 2 * n[d] else "<u4").astype("<u4")
                piece = held[a:b].tobytes()
                crc.append(zlib.crc32(piece))
                if with_ids:
                    out_ids.append(piece)
            arrays = [batch.column(2).take(pa.array(doc)), pa.array(start), pa.array(end - start), pa.array(crc, pa.int64()), pa.array(n[doc]), pa.array(seq), pa.array(g[doc] + start - seq * length)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(out_ids, pa.binary())] if with_ids else []), names + ["ids"] * with_ids)

    kind = docs.schema[id_col].dataType.simpleString()
    return stream.df.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
