"""Language-model scoring by Brown's class-based bigrams.

    P(w | v) = P(class(w) | class(v)) * P(w | class(w))

1. All words of all training texts are counted (hashes, counted per partition
   before the shuffle).
2. Exchange clustering in two steps. First the ``head`` most frequent words, and
   all others in groups by their ending (``shapes``): their bigrams of the whole training
   data are counted in a dense matrix per task (units squared reach the driver),
   and each unit moves to the class that raises the class bigram likelihood most,
   until none moves (or, if given, ``sweeps`` are done).
3. Then every other of the ``known`` most frequent words by itself: its counts of
   classes to the left and to the right over all training texts (classes of step 2)
   stay in a table, blocks of words to a row. A sweep is one job over it: every second
   word (then the others) moves against the class tables of the sweep before, and the new
   tables are the sum of what moved, so the result is the same whatever the partitions. A sweep that would lower the
   likelihood is not taken, and fewer words move at once from then on. Sweeps go on until a turn of all words
   raises the likelihood by no more than ``rise`` of what the first one gained.
   Words rarer than those, seen or not, share the class of their ending.
4. Class transitions, counted over all training texts with the final classes, and
   word emissions, both with add-k smoothing; an emission
   has room for one unknown word per class. The counts behind emissions are
   those of step 1, for all words.

Scoring reads every text. Counts and classes of the ``known`` words are broadcast;
counts of rarer words go through a join on their hash.

Tokens: A-Z lower-cased, words ``[^\x20\x09-\x0D]+``, then one end token. Defined
results: a null or empty text is its end token alone; rows are scored one by one
(repeated rows alike); without training rows all counts are 0 and base_score is
0. Words are told apart by a 64-bit hash.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .sampling import crc_mod
from .scratch import Table

END = np.uint64(0x517CC1B727220A95)


@dataclass(frozen=True)
class ClassRules:
    head: int = 1024
    shapes: int = 256
    classes: int = 32
    sweeps: int | None = None
    known: int = 1 << 18
    smooth: float = 0.1
    rise: float = 0.01


#: Words of a block of the table of contexts.
BLOCK_WORDS = 256
#: Sweeps end when even one of so many parts of the words can't move together without a loss.
MOST_PARTS = 64


def sequence(off, data, shapes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes with an end after each text, the ending group of each, and the first token of each text."""
    w = K.Words(off, data, K.SPACED, lower=True)
    pre = K.prefix(np.take(K._BYTE_LOWER, data), K._P)
    h = K.spans_hash(pre, w.start, w.end, K._P)
    ending = (K.spans_hash(pre, np.maximum(w.start, w.end - 3), w.end, K._P) >> K.U64(32)) % K.U64(shapes)
    texts = len(off) - 1
    out, shape = np.full(len(h) + texts, END, K.U64), np.zeros(len(h) + texts, np.int64)
    at = np.arange(len(h)) + w.text
    out[at], shape[at] = h, ending.astype(np.int64)
    return out, shape, w.ptr[:-1] + np.arange(texts)


def _merge(parts: list[tuple]) -> tuple:
    h, s, n = (np.concatenate(x) for x in zip(*parts))
    u, first = np.unique(h, return_index=True)
    order = np.argsort(h)
    return u, s[first], np.add.reduceat(n[order], np.searchsorted(h[order], u)) if len(u) else n


def word_counts(texts: DataFrame, rules: ClassRules) -> DataFrame:
    """h, shape, n over all rows of ``texts`` (one text column)."""

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            for _, _, off, data in K.pieces(batch.column(0)):
                h, s, _ = sequence(off, data, rules.shapes)
                u, first, n = np.unique(h, return_index=True, return_counts=True)
                parts.append((u, s[first], n))
                size += len(u)
                if size > 1 << 20:
                    parts = [_merge(parts)]
                    size = len(parts[0][0])
                    if size > 1 << 19:
                        yield _counted(parts.pop())
                        size = 0
        if parts:
            yield _counted(_merge(parts))

    return texts.mapInArrow(run, "h long, shape int, n long").groupBy("h").agg(F.max("shape").alias("shape"), F.sum("n").alias("n"))


def _counted(x) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1].astype(np.int32)), pa.array(x[2].astype(np.int64))], ["h", "shape", "n"])


def unit_bigrams(texts: DataFrame, head: np.ndarray, unit: np.ndarray, rules: ClassRules) -> np.ndarray:
    """Counts (unit, next unit) over all rows; a text begins after an end token. ``head``: sorted hashes, ``unit``: theirs."""
    units = rules.head + rules.shapes

    def run(batches):
        m = np.zeros(units * units, np.int64)
        for batch in batches:
            for _, _, off, data in K.pieces(batch.column(0)):
                h, s, first = sequence(off, data, rules.shapes)
                u = s + rules.head
                at = np.flatnonzero(K.member(h, head))
                u[at] = unit[np.searchsorted(head, h[at])]
                before = np.empty_like(u)
                before[1:] = u[:-1]
                before[first] = 0
                m += np.bincount(before * units + u, minlength=units * units)
        at = np.flatnonzero(m)
        for i in range(0, len(at), 1 << 18):
            some = at[i : i + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(m[some])], ["cell", "n"])

    got = texts.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    m = np.zeros(units * units, np.int64)
    m[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return m.reshape(units, units)


def exchange(m: np.ndarray, classes: int, sweeps: int | None = None) -> np.ndarray:
    """A class for each unit; unit 0 (the end token) keeps class 0 for itself. Without ``sweeps`` it goes on until none moves."""
    units = len(m)
    freq = m.sum(1) + m.sum(0)
    order = np.argsort(-freq[1:], kind="stable") + 1
    c = np.zeros(units, np.int64)
    c[order] = 1 + np.arange(units - 1) % (classes - 1)
    to = np.zeros((units, classes))
    np.add.at(to.T, c, m.T)
    fro = np.zeros((classes, units))
    np.add.at(fro, c, m)
    big = np.zeros((classes, classes))
    np.add.at(big, c, to)
    f = lambda x: x * np.log(np.maximum(x, 1.0))
    out, inn = m.sum(1).astype(float), m.sum(0).astype(float)
    # Gains below what rounding can make up don't count, so every move raises the likelihood and the sweeps end.
    least = max(1e-9, 64 * np.finfo(float).eps * float(f(float(m.sum()))))
    for _ in count() if sweeps is None else range(sweeps):
        moved = 0
        for w in order:
            if not freq[w]:
                continue
            old, self_n = c[w], float(m[w, w])
            a, b = to[w].copy(), fro[:, w].copy()
            a[old] -= self_n
            b[old] -= self_n
            big[old] -= to[w]
            big[:, old] -= fro[:, w]
            big[old, old] += self_n
            fb = f(big)
            rows, cols = f(big + a) - fb, f(big + b[:, None]) - fb
            d = np.arange(classes)
            gain = rows.sum(1) + cols.sum(0) - rows[d, d] - cols[d, d] + f(big[d, d] + a + b + self_n) - fb[d, d]
            r, s = big.sum(1), big.sum(0)
            gain -= f(r + out[w]) - f(r) + f(s + inn[w]) - f(s)
            gain[0] = -np.inf
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + least:
                new = int(old)
            big[new] += a
            big[:, new] += b
            big[new, new] += self_n
            if new != old:
                moved += 1
                c[w] = new
                to[:, old] -= m[:, w]
                to[:, new] += m[:, w]
                fro[old] -= m[w]
                fro[new] += m[w]
        if not moved:
            break
    return c


def _classes(h: np.ndarray, shape: np.ndarray, words: np.ndarray, word_class: np.ndarray, group_class: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The class of each token; which tokens are among ``words``, and where there."""
    c = group_class[shape]
    at = np.flatnonzero(K.member(h, words))
    i = np.searchsorted(words, h[at])
    c[at] = word_class[i]
    c[h == END] = 0
    return c, at, i


def context_counts(texts: DataFrame, words: np.ndarray, wanted: np.ndarray, word_class: np.ndarray, group_class: np.ndarray, classes: int) -> Table:
    """(block, counts): for each block of ``words`` the counts (word, side, class) of the classes beside its ``wanted`` words."""
    wide = 2 * classes
    told = texts.sparkSession.sparkContext.broadcast((words, wanted, word_class, group_class))

    def count_task(batches):
        words, wanted, word_class, group_class = told.value
        acc = np.zeros(len(words) * wide, np.int32)
        for batch in batches:
            for _, _, off, data in K.pieces(batch.column(0)):
                h, s, first = sequence(off, data, len(group_class))
                c, at, i = _classes(h, s, words, word_class, group_class)
                some = wanted[i]
                at, i = at[some], i[some]
                before = np.empty_like(c)
                before[1:] = c[:-1]
                before[first] = 0
                # A word is never the last token of its text, so there is a class to its right.
                u, n = np.unique(np.concatenate([i * wide + before[at], i * wide + classes + c[at + 1]]), return_counts=True)
                acc[u] += n.astype(np.int32)
        cells = np.flatnonzero(acc)
        block = cells // (BLOCK_WORDS * wide)
        cut = np.flatnonzero(np.diff(block, prepend=-1, append=-1))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            yield pa.RecordBatch.from_arrays([pa.array(block[a : a + 1].astype(np.int32)), pa.array([(cells[a:b] % (BLOCK_WORDS * wide)).astype("<u4").tobytes()]), pa.array([acc[cells[a:b]].astype("<u4").tobytes()])], ["block", "cells", "n"])

    def add(batches):
        held, total = None, None
        for batch in batches:
            for block, cells, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if block != held:
                    if held is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([held], pa.int32()), pa.array([total.tobytes()])], ["block", "counts"])
                    held, total = block, np.zeros(BLOCK_WORDS * wide, "<i8")
                total[np.frombuffer(cells, "<u4")] += np.frombuffer(n, "<u4")
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held], pa.int32()), pa.array([total.tobytes()])], ["block", "counts"])

    parts = texts.mapInArrow(count_task, "block int, cells binary, n binary").repartition("block").sortWithinPartitions("block")
    return Table(parts.mapInArrow(add, "block int, counts binary"), "contexts")


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def likelihood(left: np.ndarray, right: np.ndarray) -> float:
    """What of the two-sided log likelihood depends on the classes; ``left``: (context, class), ``right``: (class, context)."""
    return float(_f(left).sum() - _f(left.sum(0)).sum() + _f(right).sum() - _f(right.sum(1)).sum())


def move(x: np.ndarray, c: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The best class of each word against fixed tables. ``x``: (words, side, class) counts; class 0 is the end token's alone."""
    a, b = x[:, 0].astype(float), x[:, 1].astype(float)
    na, nb, who = a.sum(1), b.sum(1), np.arange(len(c))
    to = (_f(left[None] + a[:, :, None]) - _f(left)[None]).sum(1) - (_f(left.sum(0)[None] + na[:, None]) - _f(left.sum(0))[None])
    to += (_f(right[None] + b[:, None, :]) - _f(right)[None]).sum(2) - (_f(right.sum(1)[None] + nb[:, None]) - _f(right.sum(1))[None])
    # What staying is worth: the loss of taking the word out of its class.
    la, lb = left[:, c].T, right[c]
    stay = (_f(la) - _f(la - a)).sum(1) - (_f(la.sum(1)) - _f(la.sum(1) - na)) + (_f(lb) - _f(lb - b)).sum(1) - (_f(lb.sum(1)) - _f(lb.sum(1) - nb))
    to[who, c] = stay
    to[:, 0] = -np.inf
    new = to.argmax(1)
    return np.where(to[who, new] > stay + 1e-9 * (1 + np.abs(stay)), new, c)


def moved(x: np.ndarray, old: np.ndarray, new: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Takes the words' counts from their old class to the new one in both tables."""
    at = np.flatnonzero(old != new)
    np.add.at(left.T, new[at], x[at, 0])
    np.subtract.at(left.T, old[at], x[at, 0])
    np.add.at(right, new[at], x[at, 1])
    np.subtract.at(right, old[at], x[at, 1])


def exchange_words(contexts: DataFrame, start: np.ndarray, big: np.ndarray, rules: ClassRules) -> np.ndarray:
    """A class for each word, from ``start`` on; ``big``: class bigrams under ``start``.

    A sweep moves one of ``parts`` interleaved parts of the words, each word against the tables as the sweep found them, so its result
    is the same however words lie in tasks. A sweep that would lower the likelihood is not taken; parts are then halved.
    """
    spark, k = contexts.sparkSession, rules.classes
    best, left, right = start, big.astype(float), big.astype(float)
    at, first, parts, done, gained = likelihood(left, right), None, 2, 0, 0.0
    limit = np.inf if rules.sweeps is None else rules.sweeps
    for sweep_no in count():
        if sweep_no >= limit or parts > MOST_PARTS:
            break
        told = spark.sparkContext.broadcast((best, left, right))

        def sweep(batches, told=told, parts=parts, part=done):
            c, left, right = told.value
            dl, dr = np.zeros((k, k)), np.zeros((k, k))
            for batch in batches:
                for block, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                    lo = block * BLOCK_WORDS
                    at = np.arange(lo + (part - lo) % parts, min(lo + BLOCK_WORDS, len(c)), parts)
                    x = np.frombuffer(raw.as_buffer(), "<i8").reshape(BLOCK_WORDS, 2, k)[at - lo]
                    old = c[at]
                    new = np.where(x.any((1, 2)), move(x, old, left, right), old)
                    moved(x, old, new, dl, dr)
                    to = np.flatnonzero(new != old)
                    if len(to):
                        yield pa.RecordBatch.from_arrays([pa.array([at[to].astype("<i4").tobytes()]), pa.array([new[to].astype("<i4").tobytes()]), pa.array([False])], ["a", "b", "tables"])
            yield pa.RecordBatch.from_arrays([pa.array([dl.tobytes()]), pa.array([dr.tobytes()]), pa.array([True])], ["a", "b", "tables"])

        # 8 bytes a word that moves and two tables a task come back. Counts are whole numbers, so their sums don't depend on the order.
        new, l, r = best.copy(), left.copy(), right.copy()
        for x in contexts.mapInArrow(sweep, "a binary, b binary, tables boolean").toArrow().to_pylist():
            if x["tables"]:
                l += np.frombuffer(x["a"]).reshape(k, k)
                r += np.frombuffer(x["b"]).reshape(k, k)
            else:
                new[np.frombuffer(x["a"], "<i4")] = np.frombuffer(x["b"], "<i4")
        told.unpersist()
        gain = likelihood(l, r) - at
        if gain < 0:
            parts, done, gained = parts * 2, 0, 0.0
            continue
        best, left, right, at = new, l, r, at + gain
        done, gained = done + 1, gained + gain
        if done == parts:  # every word had its turn
            first = first or gained
            if gained <= rules.rise * first:
                break
            done, gained = 0, 0.0
    return best


def class_bigrams(texts: DataFrame, words: np.ndarray, word_class: np.ndarray, group_class: np.ndarray, classes: int) -> np.ndarray:
    """Counts (class, next class) over all rows; a text begins after an end token."""
    told = texts.sparkSession.sparkContext.broadcast((words, word_class, group_class))

    def run(batches):
        m = np.zeros(classes * classes, np.int64)
        for batch in batches:
            for _, _, off, data in K.pieces(batch.column(0)):
                h, s, first = sequence(off, data, len(told.value[2]))
                c, _, _ = _classes(h, s, *told.value)
                before = np.empty_like(c)
                before[1:] = c[:-1]
                before[first] = 0
                m += np.bincount(before * classes + c, minlength=classes * classes)
        at = np.flatnonzero(m)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(m[at])], ["cell", "n"])

    got = texts.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    m = np.zeros(classes * classes, np.int64)
    m[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return m.reshape(classes, classes)


@dataclass
class ClassModel:
    total: int
    distinct: int
    words: np.ndarray  # sorted hashes of the most frequent words
    count_log: np.ndarray  # log10(count + smooth) of each
    word_class: np.ndarray  # class of each
    group_class: np.ndarray  # class of any other word, by its ending
    step: np.ndarray  # log10 of class transitions
    room: np.ndarray  # log10 of each class's emission denominator
    rules: ClassRules


def fit(train: DataFrame, rules: ClassRules, counts: Table) -> tuple[ClassModel, int]:
    """The model, and the count from which on words are in it. ``counts``: the written word_counts of ``train``."""
    table, k = counts.df, rules.classes
    total, distinct = (int(x or 0) for x in table.agg(F.sum("n"), F.count("*")).first())
    # The least count that leaves at most ``known`` words; there are few different counts.
    seen, cut = 0, 1
    for r in table.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
        seen += r[1]
        if seen > rules.known:
            cut = r[0] + 1
            break
    top = table.where((F.col("n") >= cut) | (F.col("h") == int(END.view(np.int64)))).toArrow()
    h = top.column("h").to_numpy().view(K.U64) if top.num_rows else np.zeros(0, K.U64)
    order = np.argsort(h)
    words, n, shape = h[order], top.column("n").to_numpy()[order], top.column("shape").to_numpy()[order].astype(np.int64)
    unit = rules.head + shape
    unit[words == END] = 0
    rank = np.lexsort((words, -n))
    rank = rank[words[rank] != END][: rules.head - 1]
    unit[rank] = 1 + np.arange(len(rank))
    is_head = unit < rules.head
    m = unit_bigrams(train, words[is_head], unit[is_head], rules)
    c = exchange(m, k, rules.sweeps)
    big = np.zeros((k, k), np.int64)
    np.add.at(big, (c[:, None], c[None, :]), m)
    group_class, word_class = c[rules.head :], c[unit]
    if not is_head.all():
        contexts = context_counts(train, words, ~is_head, word_class, group_class, k)
        word_class = exchange_words(contexts.df, word_class, big, rules)
        contexts.drop()
        big = class_bigrams(train, words, word_class, group_class, k)
    rare = np.zeros(rules.shapes, np.int64)
    for r in table.groupBy("shape").count().collect():
        rare[r[0]] = r[1]
    np.subtract.at(rare, shape, 1)
    v = np.bincount(word_class, minlength=k) + np.bincount(group_class, weights=rare, minlength=k)
    step = np.log10((big + rules.smooth) / (big.sum(1, keepdims=True) + rules.smooth * k))
    room = np.log10(big.sum(0) + rules.smooth * (v + 1))
    return ClassModel(total, distinct, words, np.log10(n + rules.smooth), word_class, group_class, step, room, rules), cut


def score_texts(docs: DataFrame, model: ClassModel, cut: int, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score for each row.

    Rows are told apart by their partition and place in it: ``docs`` must be read from files.
    """
    told = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        m, part, row = told.value, TaskContext.get().partitionId() << 40, 0
        r = m.rules
        for batch in batches:
            for lo, hi, off, data in K.pieces(batch.column(1)):
                h, s, first = sequence(off, data, r.shapes)
                c, at, i = _classes(h, s, m.words, m.word_class, m.group_class)
                logs, known = np.zeros(len(h)), np.zeros(len(h), bool)
                logs[at], known[at] = m.count_log[i], True
                before = np.empty_like(c)
                before[1:] = c[:-1]
                before[first] = 0
                texts, n = hi - lo, np.diff(np.append(first, len(h)))
                base = np.add.reduceat(logs, first)
                model_part = base + np.add.reduceat(m.step[before, c] - m.room[c], first)
                rows = part + row + np.arange(texts)
                row += texts
                yield pa.RecordBatch.from_arrays([pa.array(K.mix(rows.astype(K.U64)).view(np.int64)), pa.array(np.zeros(texts, np.int32)), pa.array(rows), batch.column(0).slice(lo, texts), pa.array(n), pa.array(np.add.reduceat(known.astype(np.int64), first)), pa.array(base), pa.array(model_part)], NAMES)
                rest = np.flatnonzero(~known)
                if not len(rest):
                    continue
                owner = np.repeat(np.arange(texts), n)[rest]
                order = np.lexsort((h[rest], owner))
                hh, oo = h[rest][order], owner[order]
                new = np.ones(len(hh), bool)
                new[1:] = (hh[1:] != hh[:-1]) | (oo[1:] != oo[:-1])
                start = np.flatnonzero(new)
                tf = np.diff(np.append(start, len(hh)))
                none = pa.nulls(len(start), pa.int64())
                floats = pa.nulls(len(start), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(hh[start].view(np.int64)), pa.array(tf.astype(np.int32)), pa.array(rows[oo[start]]), pa.nulls(len(start), batch.column(0).type), none, none, floats, floats], NAMES)

    NAMES = ["h", "tf", "row", "doc_id", "n_tokens", "n_known", "base", "model"]
    parts = docs.select(docs[id_col], docs[text_col]).mapInArrow(run, f"h long, tf int, row long, doc_id {kind}, n_tokens long, n_known long, base double, model double")
    rare = counts.where(F.col("n") < cut).select("h", "n")
    # Rows of texts carry tf 0 and a hash of their own, so that they spread and match nothing that counts.
    joined = parts.join(rare, "h", "left") if cut > 1 else parts.withColumn("n", F.lit(None).cast("long"))
    tail = F.coalesce(F.sum(F.when(F.col("tf") > 0, F.col("tf") * F.log10(F.coalesce(F.col("n"), F.lit(0)) + model.rules.smooth))), F.lit(0.0))
    denominator = np.log10(model.total + model.rules.smooth * (model.distinct + 1))
    whole = joined.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), (F.max("n_known") + F.coalesce(F.sum(F.when((F.col("tf") > 0) & (F.col("n") > 0), F.col("tf").cast("long"))), F.lit(0))).alias("n_known"), F.max("base").alias("base"), F.max("model").alias("model"), tail.alias("tail"))
    return whole.select("doc_id", "n_tokens", "n_known", (F.col("base") + F.col("tail") - F.col("n_tokens") * F.lit(float(denominator))).alias("base_score"), (F.col("model") + F.col("tail")).alias("score"))


def class_ngrams(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", rules: ClassRules = ClassRules(), written: bool = False) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity; learned from the rows where ``learn`` holds.

    ``written``: ``docs`` is read from files, so a task that is run again sees the same rows in the same order; else the
    ids and texts are written first.
    """
    train = docs.where(learn).select(docs[text_col])
    counts = Table(word_counts(train, rules), "word-counts")
    model, cut = fit(train, rules, counts)
    rows = docs.select(docs[id_col], docs[text_col])
    out = score_texts(rows if written else Table(rows, "texts").df, model, cut, counts.df, id_col, text_col)
    return out.select("doc_id", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def op5_class_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = class_ngrams(docs, crc_mod(F.col("doc_id"), 10) != 0, written=True)
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
