"""Synthetic briefs: citations written by one SQL text for Spark and DuckDB over ``lineitem``.

A brief is an order; each of its line items is a segment with a lead, a citation
and a tail. Where a citation starts and ends follows from the lengths, so SQL
can state the expected results without any pattern matching.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_T, _B, _V, _P, _Y = "cast(l_suppkey % 50 + 1 as string)", "cast((l_orderkey * 7 + l_partkey % 3) % 900 + 100 as string)", "cast((l_orderkey * 3 + l_partkey % 2) % 400 + 10 as string)", "cast(l_suppkey % 300 + 1 as string)", "cast(1900 + l_partkey % 99 as string)"
_N = "CASE l_suppkey % 6 WHEN 0 THEN 'Smith' WHEN 1 THEN 'Baxter' WHEN 2 THEN 'Doe' WHEN 3 THEN 'Ortiz' WHEN 4 THEN 'Chen' ELSE 'Ward' END"
_M = "CASE l_partkey % 5 WHEN 0 THEN 'Jones' WHEN 1 THEN 'State' WHEN 2 THEN 'Board' WHEN 3 THEN 'Cole' ELSE 'Union' END"

# Sections and volumes come from the order and a small remainder, so that a brief cites some authorities again.
#: kind -> (lead, citation, tail), each a list of SQL expressions that are concatenated.
KINDS: dict[str, tuple[list[str], list[str], list[str]]] = {
    "statute_bad": (["'Plaintiff relies on '"], [_T, "' USC §'", _B], ["' here. '"]),
    "statute": (["'The court applied '"], [_T, "' U.S.C. § '", _B], ["' today. '"]),
    "regulation_bad": (["'The agency read '"], [_T, "' cfr §§ '", _B], ["' broadly. '"]),
    "regulation": (["'The rule is '"], [_T, "' C.F.R. § '", _B], ["' as amended. '"]),
    "case": (["'\n'"], [_N, "' v. '", _M, "', '", _V, "' U.S. '", _B, "', '", _P, "' ('", _Y, "')'"], ["'. '"]),
    "case_bad": (["'\n'"], [_N, "' v. '", _M, "', '", _V, "' F. 2d '", _B, "' ('", _Y, "')'"], ["'. '"]),
    "id": (["''"], ["'Id.'"], ["' at '", _P, "'. '"]),
    "id_bad": (["'See '"], ["'id.'"], ["' at '", _P, "'. '"]),
    "word_id": (["'The stored id of the record stays put. '"], [], ["''"]),
    "journal": (["'\nDoe, Some Title, '"], [_T, "' Harv. L. Rev. '", _B], ["' (1990). '"]),
    "internet": (["'Available at '"], ["'https://example.org/x/'", _B], ["'. '"]),
    "constitution": (["'Under '"], ["'U.S. Const. amend. XIV, § '", "cast(l_partkey % 5 + 1 as string)"], ["' it holds. '"]),
    "supra": (["'\nDoe, '"], ["'supra'"], ["', at '", _P, "'. '"]),
    "short_case": (["'\n'", _N, "', '", _V, "' U.S. at '", _P, "'. '"], [], ["''"]),
    "section": (["'Under § '", _B, "' it follows. '"], [], ["''"]),
    "signal": (["'Cf the record and see the rest. '"], [], ["''"]),
    "quoted": (["'\nIt said “plain words” \n'"], [_N, "' v. '", _M, "', '", _V, "' U.S. '", _B, "' ('", _Y, "')'"], ["' (holding so). '"]),
    "prose": (["'In 2020 Congress amended the statute.\n\nA new part begins. '"], [], ["''"]),
    "invisible": (["'He cites '"], [_T, "'\u200bU.S.C.\u200b§ '", _B], ["' there. '"]),
    "string_cite": (["'Both '"], [_T, "' U.S.C. § '", _B], ["'; and so on (see the file. '"]),
}
NAMES = list(KINDS)
SOURCE_TYPE = {"statute_bad": "statute", "statute": "statute", "invisible": "statute", "string_cite": "statute", "regulation_bad": "regulation", "regulation": "regulation", "case": "case", "case_bad": "case", "quoted": "case", "id": "short_form", "id_bad": "short_form", "supra": "short_form", "journal": "journal_article", "internet": "internet", "constitution": "constitution"}


def _pick(i: int) -> str:
    cases = " ".join(f"WHEN {k} THEN {' || '.join(KINDS[n][i]) or chr(39) * 2}" for k, n in enumerate(NAMES))
    return f"CASE l_partkey % {len(NAMES)} {cases} END"


_KIND = f"CASE l_partkey % {len(NAMES)} " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(NAMES)) + " END"

#: A row per segment: doc_id, ord, kind, lead, cite, tail and the values they were made of.
SEGMENTS_SQL = f"""
SELECT l_orderkey AS doc_id,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS ord,
       {_KIND} AS kind, {_pick(0)} AS lead, {_pick(1)} AS cite, {_pick(2)} AS tail,
       {_T} AS t, {_B} AS b, {_V} AS v, {_P} AS p, {_Y} AS y, {_N} AS n, {_M} AS m
FROM lineitem
"""

#: DuckDB: segments with offsets, and whole briefs.
ORACLE_CTES = f"""
segs AS ({SEGMENTS_SQL}),
placed AS (SELECT *, cast(coalesce(sum(length(lead) + length(cite) + length(tail)) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS integer) AS seg_start FROM segs),
cites AS (SELECT *, cast(seg_start + length(lead) AS integer) AS c_start, cast(seg_start + length(lead) + length(cite) AS integer) AS c_end FROM placed WHERE cite <> ''),
briefs AS (SELECT doc_id, string_agg(lead || cite || tail, '' ORDER BY ord) AS text FROM segs GROUP BY doc_id)
"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SEGMENTS_SQL.replace("FROM lineitem", "FROM {lineitem}"), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: one row per order. Segments stand in the order of ``ord``; those that tie there are equal."""
    by = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    # A step of its own: what stands inside collect_list is interpreted.
    seg = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("doc_id"), *by, F.concat(*[F.expr(_pick(i)) for i in range(3)]).alias("x"))
    return seg.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct(*by, "x")))["x"], "").alias("text"))


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt over all tasks by a key, before much is made of few bytes.

    A narrow table is read as one or two parts, whatever its number of rows, and adaptive execution would put small parts together
    again if their number weren't given.
    """
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders that short texts are made of, over all tasks."""
    return spread(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey")
