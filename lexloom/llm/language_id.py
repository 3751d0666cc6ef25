"""Language identification with averaged subword embeddings and a linear softmax.

Features are the 3- and 4-byte pieces of a text in lower case, with everything
but letters turned into spaces, hashed into ``2 ** log_buckets`` rows of an
embedding table. The text's vector is their mean; a linear softmax over it is
trained together with the table by stochastic gradient descent in numpy. Because
the mean and the softmax's input are both linear, scoring uses one table of
(bucket, language) products and needs a sum per text.

Learning uses at most ``sample_rows`` labelled rows (equal shares per language; rows that repeat id and text
count once; whole texts, hashed on the executors), and no more of a language once its texts have its share of
``sample_chars`` characters: that bounds what reaches the driver. A fifth of them is kept out of
training for a temperature (by likelihood) and for the confidence below which a
text counts as ``rejected``.

Defined results: ``lang_pred`` is ``und`` with score 0 if the text is null or has no
letter, or if nothing was learned; else the likeliest learned language and its
calibrated probability. Null languages are not learned; more than 1,000 languages are an error. Rows are judged one by
one, so repeated rows and ties by another column have no effect; equal
probabilities go to the language that sorts first.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .sampling import class_sample, crc_mod


@dataclass(frozen=True)
class LanguageRules:
    sample_rows: int = 4000
    sample_chars: int = 16 << 20
    log_buckets: int = 15
    dim: int = 16
    steps: int = 20_000
    rate: float = 0.5
    wanted: float = 0.99
    seed: int = 11


@dataclass
class LanguageModel:
    langs: list[str]
    table: np.ndarray  # (buckets, languages) float32
    bias: np.ndarray
    temperature: float
    reject_below: float
    log_buckets: int


#: Letters keep their (lower-case) byte, bytes of non-ASCII characters stay, all others count as a space.
LETTER = np.full(256, 0x20, np.uint8)
for _a, _b in ((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    LETTER[_a : _b + 1] = K.LOWER[_a : _b + 1]


def subwords(off: np.ndarray, data: np.ndarray, log_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each piece, and the text of each (ascending)."""
    x = np.full(len(data) + 2 * (len(off) - 1) + 4, 0x20, np.uint8)
    # A space before and after each text, so that pieces at its ends are whole words' ends.
    n = np.diff(off)
    text = np.repeat(np.arange(len(n)), n)
    x[np.arange(len(data)) + 2 * text + 1] = np.take(LETTER, data)
    v = x.astype(np.uint32)
    three = v[:-3] | (v[1:-2] << np.uint32(8)) | (v[2:-1] << np.uint32(16))
    four = three | (v[3:] << np.uint32(24))
    owner = np.repeat(np.arange(len(n)), n + 2)
    shift = np.uint32(32 - log_buckets)
    end = off[1:] + 2 * np.arange(1, len(n) + 1)
    at = np.arange(len(owner))
    left = end[owner] - at if len(owner) else at
    spaces = np.uint32(0x202020)
    ok3, ok4 = (left >= 3) & (three[: len(owner)] != spaces), left >= 4
    ok4 &= (three[: len(owner)] != spaces) & (four[: len(owner)] >> np.uint32(8) != spaces)
    h3 = (three[: len(owner)][ok3] * np.uint32(0x9E3779B1)) >> shift
    h4 = (four[: len(owner)][ok4] * np.uint32(0x85EBCA6B) ^ np.uint32(0x5BD1E995)) >> shift
    o = np.concatenate([owner[ok3], owner[ok4]])
    order = np.argsort(o, kind="stable")
    return np.concatenate([h3, h4])[order], o[order]


def has_letter(off: np.ndarray, data: np.ndarray) -> np.ndarray:
    plain = K.total(np.take(K.byte_class((0x41, 0x5A), (0x61, 0x7A)), data), off) > 0
    for t in np.flatnonzero(~plain & (np.diff(off) > 0)).tolist():
        plain[t] = any(map(str.isalpha, data[off[t] : off[t + 1]].tobytes().decode()))
    return plain


def fit(docs: DataFrame, rules: LanguageRules = LanguageRules()) -> LanguageModel:
    """``docs``: doc_id, text, lang of the rows to learn from."""
    docs = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    chosen, counts = class_sample(docs, "lang", ["doc_id", "text"], rules.sample_rows, "text", rules.sample_chars)
    langs, buckets = sorted(counts), 1 << rules.log_buckets
    if not langs:
        return LanguageModel([], np.zeros((buckets, 0), np.float32), np.zeros(0), 1.0, 0.0, rules.log_buckets)

    def features(batches):
        for batch in batches:
            for lo, hi, off, data in K.pieces(batch.column(0)):
                h, o = subwords(off, data, rules.log_buckets)
                u, n = np.unique(o.astype(np.int64) * buckets + h, return_counts=True)
                cut = np.searchsorted(u, np.arange(hi - lo + 1) * buckets).astype(np.int32)
                kind = pa.int32()
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(cut), pa.array((u % buckets).astype(np.int32), kind)), pa.ListArray.from_arrays(pa.array(cut), pa.array(n.astype(np.int32), kind))], ["lang", "b", "n"])

    # Each character begins two pieces, and a text has as many different pieces as there are buckets at most.
    got = chosen.select("text", "lang").mapInArrow(features, "lang string, b array<int>, n array<int>").toArrow()
    code = {x: i for i, x in enumerate(langs)}
    y, rows = [], []
    for lang, b, n in zip(got.column(0).to_pylist(), got.column(1), got.column(2)):
        ids, count = b.values.to_numpy(), n.values.to_numpy().astype(np.float32)
        if len(ids):
            y.append(code[lang])
            rows.append((ids, count / count.sum()))
    # The order of arrival is not fixed; the order of training is.
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0].tobytes(), rows[i][1].tobytes(), y[i]))
    rng = np.random.default_rng(rules.seed)
    rng.shuffle(order)
    kept, train = order[: len(order) // 5], order[len(order) // 5 :]
    e = rng.uniform(-1, 1, (buckets, rules.dim)).astype(np.float32) / rules.dim
    w, bias = np.zeros((len(langs), rules.dim), np.float32), np.zeros(len(langs), np.float32)
    steps, step = rules.steps, 0
    for _ in range(-(-steps // max(1, len(train)))):
        rng.shuffle(train)
        for i in train:
            ids, share = rows[i]
            if step == steps:
                break
            rate = np.float32(rules.rate * (1 - step / steps))
            step += 1
            v = share @ e[ids]
            z = w @ v + bias
            p = np.exp(z - z.max())
            g = p / p.sum()
            g[y[i]] -= 1
            back = g @ w
            w -= rate * np.outer(g, v)
            bias -= rate * g
            # A bucket's share is small, so its row takes a step scaled to the text's size.
            e[ids] -= (rate * len(ids) ** 0.5 * share)[:, None] * back
    table = (e @ w.T).astype(np.float32)
    z = np.array([rows[i][1] @ table[rows[i][0]] + bias for i in kept]).reshape(len(kept), len(langs))
    truth = np.array([y[i] for i in kept], np.int64)
    best, temperature = np.inf, 1.0
    for t in np.geomspace(0.05, 20, 60):
        loss = -np.log(np.maximum(softmax(z / t)[np.arange(len(kept)), truth], 1e-12)).mean() if len(kept) else 0.0
        if loss < best:
            best, temperature = loss, float(t)
    p = softmax(z / temperature)
    sure = np.sort(p.max(1)[p.argmax(1) == truth]) if len(kept) else np.zeros(0)
    reject = float(sure[int(len(sure) * (1 - rules.wanted))]) if len(sure) else 0.0
    return LanguageModel(langs, table, bias, temperature, reject, rules.log_buckets)


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True)) if z.size else z
    return p / p.sum(1, keepdims=True) if z.size else p


def probabilities(off: np.ndarray, data: np.ndarray, m: LanguageModel) -> np.ndarray:
    """Calibrated probabilities (texts, languages)."""
    h, o = subwords(off, data, m.log_buckets)
    z, n = np.zeros((len(off) - 1, len(m.langs))), np.bincount(o, minlength=len(off) - 1)
    if len(h):
        ptr = np.concatenate([[0], np.cumsum(n)[:-1]])[n > 0]
        for k in range(len(m.langs)):  # a column at a time, which bounds the temporary arrays
            z[n > 0, k] = np.add.reduceat(np.take(m.table[:, k], h).astype(np.float64), ptr)
    return softmax((z / np.maximum(n, 1)[:, None] + m.bias) / m.temperature)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected. Narrow: no shuffle."""
    told = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = told.value
        for batch in batches:
            for lo, hi, off, data in K.pieces(batch.column(1)):
                known = has_letter(off, data) & (len(m.langs) > 0)
                best, score = np.zeros(hi - lo, np.int64), np.zeros(hi - lo)
                if m.langs:
                    p = probabilities(off, data, m)
                    best, score = p.argmax(1), np.where(known, np.clip(p.max(1), 0, 1), 0.0)
                lang = [m.langs[b] if k else "und" for b, k in zip(best.tolist(), known.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(lang, pa.string()), pa.array(score), pa.array(~known | (score < m.reject_below))], ["doc_id", "lang_pred", "score", "rejected"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col], docs[text_col]).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(crc_mod(F.col("doc_id"), 3) != 1))
    held = (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out")
    return predict(docs, model).select("doc_id", held, "lang_pred", "score", "rejected")
