"""What Catalyst has no expression for, Arrow-batched: NFKC and sequence similarity."""

from __future__ import annotations

import heapq
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.arrow_udf(T.StringType())
def nfkc(s: pa.Array) -> pa.Array:
    return pc.utf8_normalize(s, "NFKC")


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp similarity."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def with_best_ratios(df: DataFrame, text: str, others: str, out: str, k: int, share_weight: float, ratio_weight: float) -> DataFrame:
    """``df`` with ``out``: the Ratcliff/Obershelp similarity (i, ratio) of ``text`` with those of ``others`` (plain, share, most: at least the ratio) that can be among the ``k`` best.

    The score is a weighted sum of share and ratio. Texts are compared in the order of what they can reach, until none that is left
    can reach the k-th best score (a ten-thousandth less counts as reaching it). Before a comparison the letters that both have in common, in any order,
    lower what can be reached; equal texts need none.
    """

    kind = pa.list_(pa.struct([("i", pa.int32()), ("ratio", pa.float64())]))

    def compared(x: str | None, ys: list[dict] | None) -> list[dict]:
        got, best = [], []
        if x is not None and ys is not None:
            reach = lambda y, most: share_weight * y["share"] + ratio_weight * most
            left = [(-reach(y, y["most"]), i, False) for i, y in enumerate(ys)]
            heapq.heapify(left)
            letters = {c: x.count(c) for c in set(x)}
            while left:
                most, i, sure = heapq.heappop(left)
                if len(best) == k and -most + 1e-4 < best[0]:
                    break
                y = ys[i]["plain"]
                n = len(x) + len(y)
                if x != y and not sure:
                    heapq.heappush(left, (-reach(ys[i], 2 * sum(min(m, y.count(c)) for c, m in letters.items()) / n), i, True))
                    continue
                r = 1.0 if x == y else SequenceMatcher(None, x, y).ratio()
                got.append({"i": i, "ratio": r})
                (heapq.heappush if len(best) < k else heapq.heappushpop)(best, reach(ys[i], r))
        return got

    at = df.columns.index(text), df.columns.index(others)

    def run(batches):
        for b in batches:
            found = [compared(x, ys) for x, ys in zip(b.column(at[0]).to_pylist(), b.column(at[1]).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], [*b.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("ratio", T.DoubleType())])))]))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("op", T.StringType()), *(T.StructField(n, T.IntegerType()) for n in ("i1", "i2", "j1", "j2"))])))
def sequence_opcodes(a: pd.Series, b: pd.Series) -> pd.Series:
    """The edits that turn one text into the other."""
    return pd.Series([None if x is None or y is None else [dict(zip(("op", "i1", "i2", "j1", "j2"), o)) for o in SequenceMatcher(None, x, y).get_opcodes()] for x, y in zip(a, b)])
