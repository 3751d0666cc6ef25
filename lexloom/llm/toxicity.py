"""Toxic passages by maximum-scoring segments of token log-odds.

1. Log-odds of tokens between toxic and clean texts with an informative
   Dirichlet prior (a share of each token's own count). A token counts once for
   each pair of words around it, so copies of a text don't make its words terms
   and a repeated word doesn't outweigh others (in learning only; in the scan
   below every occurrence scores). Tokens whose z-score is above
   the one that ``false_terms`` of all tested tokens would reach by chance are
   terms with their log-odds as score; any other token
   scores the (negative) log-odds of not being a term.
2. A linear-time scan finds every maximal scoring segment of a text. A segment
   begins and ends at a term, so the scan steps from term to term.
3. Extreme values: a segment of score S in n tokens has the expected number
   E = K n exp(-lambda S) under the clean token distribution; lambda solves
   sum p exp(lambda s) = 1, K comes from the clean rows of the sample. The
   text's statistic, the sum of -ln E over its significant segments, is turned
   into a probability by a logistic fit on the sample.

Learning uses a bounded sample of labelled rows (``sample_rows`` at most, and no more
of a class once its texts have half of ``sample_chars`` characters); rows that repeat id and text count once there. Scoring reads
every whole text. Tokens are runs of ASCII letters and digits, folded to lower
case, and of all other non-ASCII characters.

Defined results: null and empty texts have no segments and get the score of
that statistic (0 terms). Without labels of both classes every score is the
share of toxic labels (0 without labels). A doc_id that is labelled twice is
toxic if any of its labels is. Labels other than 0 and 1 are left out. Rows are scored one by one, so
repeated rows and other columns have no effect. Every term counts; a model of more than ``max_terms`` is an error.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .sampling import class_sample, crc_mod
from .scratch import Table


@dataclass(frozen=True)
class ToxicityRules:
    sample_rows: int = 24_000
    sample_chars: int = 1 << 28
    max_terms: int = 1 << 20
    prior: float = 0.05
    false_terms: float = 0.5
    min_contexts: int = 3
    significant: float = 0.05
    cut: float = 0.3


@dataclass
class ToxicityModel:
    """terms: sorted token hashes; score: theirs; other: of any other token; the rest calibrates."""

    terms: np.ndarray
    score: np.ndarray
    other: float
    lam: float
    k: float
    a: float
    b: float
    significant: float

    def chance(self, stat: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a + self.b * stat, -30, 30)))


def maximal_segments(pos: list[int], score: list[float], other: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score), in linear time; every token between two terms scores ``other``."""
    kept: list[list] = []  # first, last, sum before, sum after
    run, prev = 0.0, -1
    for p, s in zip(pos, score):
        run += other * (p - prev - 1)
        prev = p
        before, run = run, run + s
        first, low = p, before
        while kept:
            # The nearest kept segment that starts lower; those above it can't be extended.
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= low:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= run:
                kept.append([first, p, low, run, j])
                break
            first, low = kept[j][0], kept[j][2]
            del kept[j:]
        else:
            kept.append([first, p, low, run, -1])
    return [(f, last, after - before) for f, last, before, after, _ in kept]


def contexts(h: np.ndarray, w: K.Words) -> np.ndarray:
    """A hash of each word with the words beside it in its text."""
    side = np.zeros(len(h) + 2, K.U64)
    side[1:-1] = h
    left, right = side[:-2].copy(), side[2:].copy()
    some = w.count > 0
    left[w.ptr[:-1][some]] = 0
    right[w.ptr[1:][some] - 1] = 0
    return K.mix(h ^ K.mix(left + K.U64(1)) ^ K.mix(K.mix(right + K.U64(2))))


def scan(off, data, m: ToxicityModel):
    """Words of a piece, and (text, first, last, score, E) of its maximal segments; every occurrence of a term scores."""
    w = K.Words(off, data, K.ALNUM, lower=True)
    h = w.hashes()
    at = np.flatnonzero(K.member(h, m.terms))
    if not len(at):
        return w, []
    s = m.score[np.searchsorted(m.terms, h[at])]
    text = np.searchsorted(w.ptr, at, "right") - 1
    found, cuts = [], np.flatnonzero(np.diff(text)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)]):
        t = int(text[a])
        n = int(w.count[t])
        for first, last, sc in maximal_segments((at[a:b] - w.ptr[t]).tolist(), s[a:b].tolist(), m.other):
            found.append((t, first, last, sc, m.k * n * math.exp(-m.lam * sc)))
    return w, found


def statistic(texts: int, found, significant: float) -> np.ndarray:
    x = np.zeros(texts)
    for t, _, _, _, e in found:
        if e < significant:
            x[t] += -math.log(max(e, 1e-300))
    return x


def fit(docs: DataFrame, labels: DataFrame, rules: ToxicityRules = ToxicityRules()) -> ToxicityModel:
    """``docs``: doc_id, text; ``labels``: doc_id, toxic; both only of rows to learn from."""
    labels = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen, marked = class_sample(labels, "toxic", ["doc_id"], rules.sample_rows)
    empty = ToxicityModel(np.zeros(0, K.U64), np.zeros(0), 0.0, 1.0, 1.0, -30.0, 0.0, rules.significant)
    if set(marked) != {0, 1}:
        return ToxicityModel(**vars(empty) | {"a": 30.0 if 1 in marked else -30.0})
    # The sample's size is bounded by sample_rows, so broadcasting it is safe at any scale. Many documents may share an id:
    # those that have a sampled label are sampled again, by id and text.
    named = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    chosen, texts = class_sample(named, "toxic", ["doc_id", "text"], rules.sample_rows, "text", rules.sample_chars)
    table = Table(chosen.select("text", "toxic"), "toxicity")
    weight = {k: n / kept * (texts[k][0] / texts[k][1] if k in texts else 1.0) for k, (n, kept) in marked.items()}

    def tokens(batches):
        for batch in batches:
            y = batch.column(1).to_numpy().astype(np.int64)
            for lo, hi, off, data in K.pieces(batch.column(0)):
                w = K.Words(off, data, K.ALNUM, lower=True)
                h = w.hashes()
                context = contexts(h, w)
                toxic = y[lo:hi][w.text]
                for flag in (1, 0):
                    at = np.flatnonzero(toxic == flag)
                    _, first = np.unique(context[at], return_index=True)
                    at = at[first]
                    yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(context[at].view(np.int64)), pa.array(np.full(len(at), flag, np.int64)), pa.array(np.full(len(at), 1 - flag, np.int64))], ["h", "x", "t", "c"])

    once = table.df.mapInArrow(tokens, "h long, x long, t long, c long").groupBy("h", "x").agg(F.max("t").alias("t"), F.max("c").alias("c"))
    counts = once.groupBy("h").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    nt, nc, tested = (float(x or 0) for x in counts.agg(F.sum("t"), F.sum("c"), F.count_if(F.col("t") >= rules.min_contexts)).first())
    z_min = NormalDist().inv_cdf(1 - min(0.4, rules.false_terms / max(tested, 1)))
    if not nt or not nc:
        table.drop()
        return ToxicityModel(**vars(empty) | {"a": math.log(marked[1][0] / marked[0][0])})
    prior = F.lit(rules.prior) * (F.col("t") + F.col("c"))
    t, c = F.col("t") + prior, F.col("c") + prior
    nt_, nc_ = nt + rules.prior * (nt + nc), nc + rules.prior * (nt + nc)
    delta = F.log(t / (F.lit(nt_) - t)) - F.log(c / (F.lit(nc_) - c))
    rows = (
        counts.where(F.col("t") >= rules.min_contexts)
        .select("h", "t", "c", delta.alias("delta"), (delta / F.sqrt(1 / t + 1 / c)).alias("z"))
        .where(F.col("z") >= z_min)
        .limit(rules.max_terms + 1)
        .collect()
    )
    if len(rows) > rules.max_terms:
        raise ValueError(f"more than {rules.max_terms} terms: a model must fit a worker")
    h = np.array([r.h for r in rows], np.int64).view(K.U64)
    order = np.argsort(h)
    score = np.array([r.delta for r in rows])[order]
    p_clean = np.array([(r.c + rules.prior * (r.t + r.c)) / nc_ for r in rows])[order]
    pt, pc = sum(r.t for r in rows) / nt, sum(r.c for r in rows) / nc
    # A rate of a tenth of a percent at least keeps the drift negative.
    other = math.log((1 - min(max(pt, 0.002), 0.5)) / (1 - min(pc, 0.001)))
    m = ToxicityModel(h[order], score, other, _lambda(p_clean, score, other), 1.0, 0.0, 0.0, rules.significant)

    def segments(batches):
        """Words and maximal segments of the clean texts."""
        n = e = 0
        for batch in batches:
            clean = batch.column(1).to_numpy() == 0
            for lo, hi, off, data in K.pieces(batch.column(0)):
                w, found = scan(off, data, m)
                n += int(w.count[clean[lo:hi]].sum())
                e += sum(1 for x in found if clean[lo + x[0]])
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([e])], ["n", "e"])

    low = math.exp(-m.lam * float(score.min())) if len(score) else 1.0
    n, e = (int(x or 0) for x in table.df.select("text", "toxic").mapInArrow(segments, "n long, e long").agg(F.sum("n"), F.sum("e")).first())
    m.k = (e + 0.5) / max(n * low, 1e-9)

    def statistics(batches):
        for batch in batches:
            for lo, hi, off, data in K.pieces(batch.column(0)):
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), pa.array(statistic(hi - lo, scan(off, data, m)[1], rules.significant))], ["y", "x"])

    # A label and a number for each text of the sample.
    seen = table.df.mapInArrow(statistics, "y int, x double").toArrow()
    table.drop()
    x, y = seen.column("x").to_numpy(), seen.column("y").to_numpy().astype(float)
    order = np.lexsort((x, y))  # the order of arrival is not fixed
    x, y = x[order], y[order]
    wt = np.where(y == 1, weight[1], weight[0])
    m.a, m.b = _logistic(x, y, wt)
    return m


def _lambda(p: np.ndarray, s: np.ndarray, other: float) -> float:
    """The positive root of sum p exp(lambda s) = 1."""
    f = lambda v: float((p * np.exp(np.minimum(v * s, 600))).sum() + (1 - p.sum()) * math.exp(v * other)) - 1
    if not len(p):
        return 1.0
    lo, hi = 1e-6, 1e-3
    while f(hi) < 0 and hi < 50:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return max(hi, 1e-3)


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression on one value, by Newton's method with a small ridge; the slope is not negative."""
    v = np.stack([np.ones_like(x), x], 1)
    beta = np.array([math.log((w @ y + 1) / (w @ (1 - y) + 1)), 0.0])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(v @ beta, -30, 30)))
        g = v.T @ (w * (y - p)) - np.array([0.0, 1e-3]) * beta
        hess = (v * (w * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ v + np.diag([1e-6, 1e-3])
        step = np.linalg.solve(hess, g)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), max(float(beta[1]), 0.0)


REPORT = "score double, predicted int, n_segments int, segments array<struct<first:long,last:long,score:double,expected:double>>"


def score_texts(docs: DataFrame, model: ToxicityModel, rules: ToxicityRules = ToxicityRules(), id_col: str = "doc_id", text_col: str = "text", drop: bool = False) -> DataFrame:
    """``drop``: the rows of ``docs`` that are not predicted toxic, as they are; else a report: doc_id and REPORT (word ranges of significant segments)."""
    told = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at_id, at_text = names.index(id_col), names.index(text_col)

    def run(batches):
        m = told.value
        for batch in batches:
            for lo, hi, off, data in K.pieces(batch.column(at_text)):
                rows = batch.slice(lo, hi - lo)
                _, found = scan(off, data, m)
                score = m.chance(statistic(hi - lo, found, m.significant))
                bad = score >= rules.cut
                if drop:
                    yield pa.RecordBatch.from_arrays([c.filter(pa.array(~bad)) for c in rows.columns], names=[f"c{i}" for i in range(len(names))])
                    continue
                segs = [[] for _ in range(hi - lo)]
                for t, first, last, sc, e in found:
                    if e < m.significant:
                        segs[t].append({"first": first, "last": last, "score": sc, "expected": e})
                kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))
                yield pa.RecordBatch.from_arrays([rows.column(at_id), pa.array(score), pa.array(bad.astype(np.int32)), pa.array([len(x) for x in segs], pa.int32()), pa.array(segs, kind)], ["doc_id", "score", "predicted", "n_segments", "segments"])

    if drop:
        fields = ",".join(f"c{i}:{f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
        return docs.mapInArrow(run, f"struct<{fields}>").toDF(*names)
    return docs.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, {REPORT}")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    learn = labels.where(crc_mod(F.col("doc_id"), 4) != 2)
    held = (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out")
    return score_texts(docs, fit(docs, learn)).select("doc_id", held, "score", "predicted", "n_segments", "segments")
