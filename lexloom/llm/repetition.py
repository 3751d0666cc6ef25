"""Quality rules by repetition coverage.

For every text: how many of its word characters lie inside n-grams that
occurred before in the same text, for several n, and inside lines that occurred
before. Hashes roll over word hashes in numpy; a text is never cut.

Defined results: a null or empty text has no words (all counts 0, fails the
base rule of ``min_words``). Rows are judged one by one, so repeated rows, ties
and extra columns have no effect. One text has to fit a worker's memory; about
100 bytes of working memory per byte of text are used, piece by piece.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass(frozen=True)
class RepetitionRules:
    """Limits of the verdict. ``coverage``: n-gram length -> largest share of word characters in repeated n-grams."""

    coverage: tuple[tuple[int, float], ...] = ((3, 0.35), (5, 0.20), (7, 0.18), (10, 0.15))
    line_share: float = 0.35
    line_chars: float = 0.25
    symbol_share: float = 0.10
    min_words: int = 10
    window: int = 5
    base_percent: int = 20


SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "n_lines long, dup_line_chars long, dup_ngram_chars array<long>"
)


def measure(off: np.ndarray, data: np.ndarray, rules: RepetitionRules) -> dict[str, np.ndarray]:
    """The columns of SCHEMA for the texts of one piece."""
    w = K.Words(off, data)
    h, chars, text, ptr, n = w.hashes(), w.chars(), w.text, w.ptr, w.count
    out = {"n_words": n, "word_chars": K.total(chars, ptr), "n_symbols": K.total(np.take(SYMBOLS, data), off)}

    at, key = K.windows(h, ptr, rules.window)
    again, _ = K.repeated(K.salted(key, text[at]))
    out["n_repeat_words"] = K.total(K.covered(len(h), at[again], rules.window), ptr)

    start, end, lptr = K.lines(off, data)
    lcount = np.diff(lptr)
    line_text = np.repeat(np.arange(len(lcount)), lcount)
    worded = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    some = np.flatnonzero(worded)
    _, later = K.repeated(K.salted(K.bytes_hash(data, start[some], end[some]), line_text[some]))
    dup = np.zeros(len(start), bool)
    dup[some] = later
    out["n_dup_lines"], out["n_lines"] = K.total(dup, lptr), K.total(worded, lptr)
    line_of_word = np.searchsorted(start, w.start, "right") - 1
    in_dup_line = dup[line_of_word] if len(line_of_word) else np.zeros(0, bool)
    out["dup_line_chars"] = K.total(np.where(in_dup_line, chars, 0), ptr)

    shares = []
    for size, _ in rules.coverage:
        at, key = K.windows(h, ptr, size)
        _, later = K.repeated(K.salted(key, text[at]))
        shares.append(K.total(np.where(K.covered(len(h), at[later], size), chars, 0), ptr))
    out["dup_ngram_chars"] = np.stack(shares, 1)

    out["base_failed"] = (n < rules.min_words) | (100 * out["n_repeat_words"] > rules.base_percent * n)
    wc = np.maximum(out["word_chars"], 1)
    bad = out["base_failed"] | (out["n_symbols"] > rules.symbol_share * wc)
    bad |= (out["n_dup_lines"] > rules.line_share * np.maximum(out["n_lines"], 1)) | (out["dup_line_chars"] > rules.line_chars * wc)
    for k, (_, most) in enumerate(rules.coverage):
        bad |= out["dup_ngram_chars"][:, k] > most * wc
    out["kept"] = ~bad
    return out


def repetition_coverage(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: RepetitionRules = RepetitionRules()) -> DataFrame:
    """One row per row of ``docs``: the id and the columns of SCHEMA. Narrow: no shuffle."""

    def run(batches):
        for batch in batches:
            ids, parts = batch.column(0), []
            for _, _, off, data in K.pieces(batch.column(1)):
                parts.append(measure(off, data, rules))
            if not parts:
                continue
            cols = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
            width = len(rules.coverage)
            grams = pa.ListArray.from_arrays(np.arange(0, (len(ids) + 1) * width, width, dtype=np.int32), pa.array(cols.pop("dup_ngram_chars").reshape(-1), pa.int64()))
            named = {k: pa.array(v, pa.bool_() if v.dtype == bool else pa.int64()) for k, v in cols.items()} | {"dup_ngram_chars": grams}
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([ids, *(named[k] for k in names)], ["doc_id", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col], docs[text_col]).mapInArrow(run, f"doc_id {kind}, {SCHEMA}")


def op2_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of SCHEMA, with a column per n-gram length in place of the array."""
    out = repetition_coverage(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    cover = [F.col("dup_ngram_chars")[i].alias(f"dup_chars_{n}") for i, (n, _) in enumerate(RepetitionRules().coverage)]
    return out.select(*[c for c in out.columns if c != "dup_ngram_chars"], *cover)


def _op2_sql(r: RepetitionRules = RepetitionRules()) -> str:
    """DuckDB: words with their place; a window's (by its 64-bit hash) earlier equals by row_number, what windows cover by a frame of as many words."""
    sizes = sorted({n for n, _ in r.coverage} | {r.window})
    leads = ", ".join(f"lead(word, {k}) OVER o AS l{k}" for k in range(1, sizes[-1]))
    grams = ", ".join(f"CASE WHEN l{n - 1} IS NOT NULL THEN hash(word, {', '.join(f'l{k}' for k in range(1, n))}) END AS g{n}" for n in sizes)
    flags = ", ".join(f"CASE WHEN g{n} IS NULL THEN 0 ELSE cast(row_number() OVER (PARTITION BY doc_id, g{n} ORDER BY i) > 1 AS INT) END AS later{n}" for n in sizes)
    spread = ", ".join(f"max(later{n}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c{n}" for n, _ in r.coverage)
    shares = ", ".join(f"coalesce(sum(length(word)) FILTER (c{n} = 1), 0)::BIGINT AS dup_chars_{n}" for n, _ in r.coverage)
    high = " OR ".join(f"coalesce(dup_chars_{n}, 0) > {m} * wc" for n, m in r.coverage)
    cols = ", ".join(f"coalesce(dup_chars_{n}, 0) AS dup_chars_{n}" for n, _ in r.coverage)
    word = r"[^\x20\x09-\x0D]+"
    return rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM t),
p AS (SELECT *, {leads} FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, i, word, {grams} FROM p),
f AS (SELECT doc_id, i, word, {flags}, CASE WHEN g{r.window} IS NULL THEN 0 ELSE cast(count(*) OVER (PARTITION BY doc_id, g{r.window}) > 1 AS INT) END AS again FROM g),
c AS (SELECT doc_id, word, {spread}, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {r.window - 1} PRECEDING AND CURRENT ROW) AS repeat FROM f),
a AS (SELECT doc_id, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars, sum(repeat)::BIGINT AS n_repeat_words, {shares} FROM c GROUP BY doc_id),
x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM t),
y AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) > 1 AS later FROM x WHERE regexp_matches(line, '{word}')),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (later) AS n_dup_lines, coalesce(sum(length(array_to_string(regexp_extract_all(line, '{word}'), ''))) FILTER (later), 0)::BIGINT AS dup_line_chars FROM y GROUP BY doc_id),
j AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(dup_line_chars, 0) AS dup_line_chars, {cols}, greatest(coalesce(word_chars, 0), 1) AS wc FROM t LEFT JOIN a USING (doc_id) LEFT JOIN l USING (doc_id)),
b AS (SELECT *, n_words < {r.min_words} OR 100 * n_repeat_words > {r.base_percent} * n_words AS base_failed FROM j)
SELECT * EXCLUDE (wc), NOT (base_failed OR n_symbols > {r.symbol_share} * wc OR n_dup_lines > {r.line_share} * greatest(n_lines, 1) OR dup_line_chars > {r.line_chars} * wc OR {high}) AS kept FROM b"""


OP2_SQL = _op2_sql()
