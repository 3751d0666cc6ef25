"""The queries of the engine, each with DuckDB SQL for the same rows where SQL can state it.

Citation queries run over synthetic briefs (see ``sources.briefs``); their SQL
works from the lengths and values the briefs were made of, not from patterns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P
from ..functions import tables
from ..functions.spans import merge_touching, rows_of
from ..operators import context, evaluate, extract, findings, formats, graph, lint, mode, resolve, retrieval, review
from ..sources.blocks import block_rows, html_text
from ..sources.briefs import ORACLE_CTES, SOURCE_TYPE, briefs, orders, segments, spread
from ..streaming.review import event_sessions, event_windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _long(df: DataFrame) -> DataFrame:
    """Whole numbers as longs, so that both engines agree on types."""
    return df.select(*[F.col(f.name).cast("long").alias(f.name) if isinstance(f.dataType, (T.IntegerType, T.ShortType)) else F.col(f.name) for f in df.schema.fields])


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, d, f=f: _long(f(spark, d))
        if sql is not None:
            SQL[key] = sql
        return f

    return add


def _with(rest: str) -> str:
    return f"WITH {ORACLE_CTES} {rest}"


_CODE = "CASE kind WHEN 'statute_bad' THEN 'USC' WHEN 'regulation_bad' THEN 'cfr' WHEN 'regulation' THEN 'C.F.R.' ELSE 'U.S.C.' END"
_STATUTES, _REGS, _CASES = "('statute_bad','statute','invisible','string_cite')", "('regulation_bad','regulation')", "('case','case_bad','quoted')"
_TYPE = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SOURCE_TYPE.items()) + " END"
_AT = 'cast(c_start AS BIGINT) AS start, cast(c_end AS BIGINT) AS "end"'


# Extraction


def _law(kinds: str) -> str:
    return _with(f"SELECT doc_id, {_AT}, t AS title, {_CODE} AS code, b AS section FROM cites WHERE kind IN {kinds}")


@query(_law(_STATUTES))
def extract_statutes(spark, d):
    return extract.matches(briefs(spark, d), P.STATUTE).select("doc_id", "start", "end", "title", "code", "section")


@query(_law(_REGS))
def extract_regulations(spark, d):
    return extract.matches(briefs(spark, d), P.REGULATION).select("doc_id", "start", "end", "title", "code", "section")


@query(_with(f"SELECT doc_id, {_AT}, n || ' v. ' || m AS case_name, v AS volume, CASE kind WHEN 'case_bad' THEN 'F. 2d' ELSE 'U.S.' END AS reporter, b AS first_page, CASE kind WHEN 'case' THEN p ELSE '' END AS pincite FROM cites WHERE kind IN {_CASES}"))
def extract_cases(spark, d):
    return extract.matches(briefs(spark, d), P.CASE).select("doc_id", "start", "end", "case_name", "volume", "reporter", "first_page", "pincite")


@query(_with(f"SELECT doc_id, {_AT}, substr(cite, 13) AS subdivision FROM cites WHERE kind = 'constitution'"))
def extract_constitutions(spark, d):
    return extract.matches(briefs(spark, d), P.CONSTITUTION).select("doc_id", "start", "end", "subdivision")


@query(_with(f"SELECT doc_id, {_AT}, t AS volume, b AS page FROM cites WHERE kind = 'journal'"))
def extract_journals(spark, d):
    return extract.matches(briefs(spark, d), P.JOURNAL).select("doc_id", "start", "end", "volume", "page")


@query(_with(f"SELECT doc_id, {_AT}, cite AS text FROM cites WHERE kind = 'internet'"))
def extract_urls(spark, d):
    return extract.citation_rows(briefs(spark, d)).where("source_type = 'internet'").select("doc_id", "start", "end", "text")


@query(_with(f"SELECT doc_id, {_AT}, cite AS text FROM cites WHERE kind IN ('id', 'id_bad')"))
def extract_ids_gated(spark, d):
    return extract.citation_rows(briefs(spark, d)).where("lower(components['form']) = 'id'").select("doc_id", "start", "end", "text")


@query(_with(f"SELECT doc_id, {_AT}, replace(cite, chr(8203), ' ') AS text, {_TYPE} AS source_type FROM cites"))
def citations_priority_resolved(spark, d):
    return extract.citation_rows(briefs(spark, d)).select("doc_id", "start", "end", "text", "source_type")


@query(_with("SELECT doc_id, replace(text, chr(8203), ' ') AS text FROM briefs"))
def neutralize_invisible(spark, d):
    return briefs(spark, d).select("doc_id", extract.neutralize(F.col("text")).alias("text"))


_WORDS = r"\b[\w’''-]+\b"
_HINT = P.CITATION_HINT.replace("(?iuU)", "(?i)").replace("'", "''")


@query(_with(f"SELECT doc_id, cast(len(regexp_extract_all(text, '{_WORDS}')) AS BIGINT) AS words, cast(len(regexp_extract_all(text, '{_HINT}')) AS BIGINT) AS citations, cast(greatest(1, ceil(len(regexp_extract_all(text, '{_WORDS}')) / 500.0)) AS BIGINT) AS pages FROM briefs"))
def word_citation_counts(spark, d):
    return extract.counts(briefs(spark, d))


# Lint and fix

_ISSUES = f"""
, sub AS (SELECT *, max(CASE WHEN {_TYPE} NOT IN ('short_form', 'internet') THEN c_end END) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM cites),
issues AS (
  SELECT doc_id, 'STATUTE_CODE_ABBREVIATION' AS code, c_start AS s, c_end AS e, t || ' U.S.C. § ' || b AS suggestion FROM cites WHERE kind = 'statute_bad'
  UNION ALL SELECT doc_id, 'REGULATION_CODE_ABBREVIATION', c_start, c_end, t || ' C.F.R. §§ ' || b FROM cites WHERE kind = 'regulation_bad'
  UNION ALL SELECT doc_id, 'REPORTER_ABBREVIATION', c_start + length(n || ' v. ' || m || ', '), c_start + length(n || ' v. ' || m || ', ' || v || ' F. 2d ' || b), v || ' F.2d ' || b FROM cites WHERE kind = 'case_bad'
  UNION ALL SELECT doc_id, 'SHORT_FORM_CAPITALIZATION', c_start, c_end, 'Id.' FROM cites WHERE kind = 'id_bad'
  UNION ALL SELECT doc_id, 'SHORT_FORM_ORPHAN_ID', c_start, c_end, NULL FROM sub WHERE kind IN ('id', 'id_bad') AND NOT coalesce(prior < c_start AND c_start - prior <= 500, false)
  UNION ALL SELECT doc_id, 'SHORT_FORM_UNRESOLVED', c_start, c_end, NULL FROM cites WHERE kind = 'supra'
  UNION ALL SELECT doc_id, 'CASE_PINCITE_REVIEW', c_start, c_end, NULL FROM cites WHERE kind IN ('case_bad', 'quoted'))
"""


@query(_with(_ISSUES + 'SELECT doc_id, code, cast(s AS BIGINT) AS start, cast(e AS BIGINT) AS "end", suggestion FROM issues'))
def lint_issues(spark, d):
    return lint.issue_rows(briefs(spark, d)).select("doc_id", "code", "start", "end", "suggestion")


@query(_with(_ISSUES + "SELECT code, count(*) AS n FROM issues GROUP BY code"))
def issue_counts_by_code(spark, d):
    return lint.issue_rows(briefs(spark, d)).groupBy("code").agg(F.count("*").alias("n"))


_RULE_VALUES = ", ".join("(" + ", ".join(("true" if x else "false") if isinstance(x, bool) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in tables.LINT_RULES)


@query(_with(_ISSUES + f"SELECT r.severity, r.blue AS rule, count(*) AS n FROM issues i JOIN (VALUES {_RULE_VALUES}) r(code, title, blue, white, severity, description, auto) ON i.code = r.code GROUP BY ALL"))
def explain_issues(spark, d):
    rules = F.broadcast(tables.lint_rules(spark))
    joined = lint.issue_rows(briefs(spark, d)).select("code").join(rules, "code")
    return joined.groupBy("severity", F.col("bluepages_rule").alias("rule")).agg(F.count("*").alias("n"))


@query(_with(f"SELECT {_TYPE} AS source_type, count(*) AS n, count(DISTINCT doc_id) AS n_documents FROM cites GROUP BY 1"))
def summary_by_source_type(spark, d):
    return extract.citation_rows(briefs(spark, d)).groupBy("source_type").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_documents"))


@query(_with(_ISSUES + ", c AS (SELECT doc_id, count(*) AS n FROM cites GROUP BY 1), i AS (SELECT doc_id, count(*) AS n, count(*) FILTER (code <> 'CASE_PINCITE_REVIEW') AS errors, count(suggestion) AS fixable FROM issues GROUP BY 1) SELECT b.doc_id, coalesce(c.n, 0) AS citation_count, coalesce(i.n, 0) AS issue_count, coalesce(fixable, 0) AS autofixable_count, coalesce(errors, 0) AS n_error FROM briefs b LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)"))
def document_summary(spark, d):
    return lint.summary(briefs(spark, d)).select("doc_id", "citation_count", "issue_count", "autofixable_count", "n_error")


_FIXED = "CASE kind WHEN 'statute_bad' THEN t || ' U.S.C. § ' || b WHEN 'regulation_bad' THEN t || ' C.F.R. §§ ' || b WHEN 'case_bad' THEN replace(cite, 'F. 2d', 'F.2d') WHEN 'id_bad' THEN 'Id.' ELSE cite END"


@query(_with(f"SELECT doc_id, string_agg(lead || {_FIXED} || tail, '' ORDER BY ord) AS fixed_text, count(*) FILTER (kind IN ('statute_bad', 'regulation_bad', 'case_bad', 'id_bad')) AS n_applied FROM segs GROUP BY doc_id"))
def fix_documents(spark, d):
    return lint.fix(briefs(spark, d)).select("doc_id", "fixed_text", F.size("applied").alias("n_applied"))


@query(_with(_ISSUES + "SELECT code, count(*) AS n FROM issues WHERE suggestion IS NULL GROUP BY code"))
def remaining_issues(spark, d):
    return lint.remaining(lint.fix(briefs(spark, d))).groupBy("code").agg(F.count("*").alias("n"))


@query(_with("SELECT doc_id, cast(c_start AS BIGINT) AS start FROM (SELECT *, max(CASE WHEN " + _TYPE + " NOT IN ('short_form', 'internet') THEN c_end END) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM cites) WHERE kind IN ('id', 'id_bad') AND NOT coalesce(prior < c_start AND c_start - prior <= 500, false)"))
def orphan_ids(spark, d):
    return lint.issue_rows(briefs(spark, d)).where("code = 'SHORT_FORM_ORPHAN_ID'").select("doc_id", "start")


# Graph

_OCC = f"""
, secs AS (SELECT DISTINCT doc_id, b FROM cites WHERE kind IN {_STATUTES} OR kind IN {_REGS}),
raw_occ AS (
  SELECT doc_id, kind, c_start AS s, c_end AS e, 'full' AS form, {_TYPE} AS source_type, cite, t, b, v, p, n, m FROM cites WHERE kind NOT IN ('id', 'id_bad', 'supra')
  UNION ALL SELECT doc_id, kind, c_start, c_end + length(' at ' || p), 'id', 'short_form', cite, t, b, v, p, n, m FROM cites WHERE kind IN ('id', 'id_bad')
  UNION ALL SELECT doc_id, kind, seg_start + 1, c_end + length(', at ' || p), 'supra', 'short_form', cite, t, b, v, p, n, m FROM cites WHERE kind = 'supra'
  UNION ALL SELECT doc_id, kind, seg_start + 1, seg_start + 1 + length(n || ', ' || v || ' U.S. at ' || p), 'short_case', 'case', cite, t, b, v, p, n, m FROM placed WHERE kind = 'short_case'
  UNION ALL SELECT doc_id, kind, seg_start + 6, seg_start + 6 + length('§ ' || b), 'statutory_short', 'statute', cite, t, b, v, p, n, m FROM placed WHERE kind = 'section' AND EXISTS (SELECT 1 FROM secs WHERE secs.doc_id = placed.doc_id AND secs.b = placed.b)),
keyed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, e) - 1 AS ord,
  CASE WHEN form <> 'full' THEN NULL
       WHEN source_type IN ('statute', 'regulation') THEN concat('us', chr(31), lower({_CODE}), chr(31), t, chr(31), b, chr(31))
       WHEN source_type = 'case' THEN concat(lower(n || ' v. ' || m), chr(31), v, chr(31), CASE kind WHEN 'case_bad' THEN 'F2D' ELSE 'US' END, chr(31), b)
       WHEN source_type = 'journal_article' THEN concat('doe', chr(31), 'some title', chr(31), 'harv. l. rev.', chr(31), t, chr(31), b, chr(31), '1990')
       WHEN source_type = 'internet' THEN concat(lower(cite), chr(31), chr(31))
       ELSE lower(substr(cite, 13)) END AS k FROM raw_occ),
occ AS (SELECT *, CASE WHEN k IS NOT NULL THEN 'authority:' || source_type || ':' || substr(sha256(source_type || chr(31) || k), 1, 16) END AS authority_id FROM keyed)
"""


def _occ(spark, d) -> DataFrame:
    return graph.occurrences(briefs(spark, d)).persist()


def _held(spark, d, p: P.Pattern, *surroundings: str) -> DataFrame:
    """Occurrences of the briefs that can hold a match of a pattern, with the surroundings that are named."""
    return graph.occurrences(graph.holding(briefs(spark, d), p), surroundings=surroundings)


def _forms(spark, d, p: P.Pattern, *surroundings: str) -> DataFrame:
    """``_held`` with what antecedents are found by; it is read more than once."""
    return _held(spark, d, p, *surroundings).drop("start", "end", "text", "block_id", "year", "identity").persist()


@query(_with(_OCC + 'SELECT doc_id, cast(ord AS BIGINT) AS ord, cast(s AS BIGINT) AS start, cast(e AS BIGINT) AS "end", form, source_type, authority_id FROM occ'))
def graph_occurrences(spark, d):
    return graph.occurrences(briefs(spark, d), surroundings=False).select("doc_id", "ord", "start", "end", "form", "source_type", "authority_id")


@query(_with(_OCC + "SELECT doc_id, authority_id, source_type, count(*) AS n_occurrences FROM occ WHERE form = 'full' GROUP BY ALL"))
def authority_identity(spark, d):
    return graph.authorities(graph.occurrences(briefs(spark, d), surroundings=False)).select("doc_id", "authority_id", "source_type", "n_occurrences")


@query(_with(_OCC + "SELECT authority_id, source_type, count(DISTINCT doc_id) AS n_documents, count(*) AS n_occurrences FROM occ WHERE form = 'full' GROUP BY ALL"))
def authority_frequency(spark, d):
    return graph.authority_frequency(graph.occurrences(briefs(spark, d), surroundings=False))


@query(_with(_OCC + "SELECT authority_id, count(*) AS n_occurrences FROM occ WHERE form = 'full' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"))
def top_authorities(spark, d):
    return graph.top_cited(briefs(spark, d), 20)


@query(_with(_OCC + ", a AS (SELECT DISTINCT doc_id, authority_id FROM occ WHERE form = 'full') SELECT x.authority_id AS left_id, y.authority_id AS right_id, count(*) AS n_documents FROM a x JOIN a y ON x.doc_id = y.doc_id AND x.authority_id < y.authority_id GROUP BY ALL"))
def cocitation_pairs(spark, d):
    return graph.cocitation(graph.occurrences(briefs(spark, d), surroundings=False))


@query(_with(_OCC + ", l AS (SELECT *, lag(ord) OVER (PARTITION BY doc_id, authority_id ORDER BY ord) AS prev FROM occ WHERE form = 'full') SELECT doc_id, 'full_citation_to_authority' AS edge_type, cast(ord AS VARCHAR) AS source, authority_id AS target FROM l UNION ALL SELECT doc_id, 'prior_occurrence', cast(ord AS VARCHAR), cast(prev AS VARCHAR) FROM l WHERE prev IS NOT NULL UNION ALL SELECT doc_id, 'later_occurrence', cast(prev AS VARCHAR), cast(ord AS VARCHAR) FROM l WHERE prev IS NOT NULL UNION ALL SELECT doc_id, 'immediately_preceding_occurrence', cast(ord AS VARCHAR), cast(ord - 1 AS VARCHAR) FROM occ WHERE ord > 0"))
def neighbour_edges(spark, d):
    return graph.neighbour_edges(graph.occurrences(briefs(spark, d), surroundings=False))


@query(_with(_OCC + r", pairs AS (SELECT a.doc_id, a.ord AS source, b.ord AS target, substr(text, cast(a.e + 1 AS BIGINT), cast(greatest(b.s - a.e, 0) AS BIGINT)) AS gap FROM occ a JOIN occ b ON a.doc_id = b.doc_id AND b.s > a.s JOIN briefs t ON t.doc_id = a.doc_id) SELECT doc_id, unnest(['same_citation_sentence', 'same_citation_clause']) AS edge_type, cast(source AS VARCHAR) AS source, cast(target AS VARCHAR) AS target FROM pairs WHERE contains(gap, ';') AND NOT regexp_matches(gap, '\.\s+[A-Z]')"))
def same_sentence_edges(spark, d):
    return graph.sentence_edges(_held(spark, d, P.CLAUSE_EDGE, "breaks"))


@query(_with(_OCC + r""", f AS (SELECT o.*, substr(text, cast(greatest(s - 24, 0) + 1 AS BIGINT), cast(s - greatest(s - 24, 0) AS BIGINT)) AS p24, substr(text, cast(greatest(s - 180, 0) + 1 AS BIGINT), cast(s - greatest(s - 180, 0) AS BIGINT)) AS p180, substr(text, cast(e + 1 AS BIGINT), 180) AS x180 FROM occ o JOIN briefs USING (doc_id))
SELECT doc_id, 'signal_linked_to_citation_group' AS edge_type, cast(ord AS VARCHAR) AS source, cast(ord AS VARCHAR) AS target FROM f WHERE regexp_matches(p24, '(?i)\b(see also|see|cf\.|accord|but see|contra)\s*$')
UNION ALL SELECT doc_id, 'quotation_linked_to_authority', cast(ord AS VARCHAR), coalesce(authority_id, cast(ord AS VARCHAR)) FROM f WHERE regexp_matches(p180, '[“"][^”"]+[”"]\s*$')
UNION ALL SELECT doc_id, 'parenthetical_linked_to_authority', cast(ord AS VARCHAR), coalesce(authority_id, cast(ord AS VARCHAR)) FROM f WHERE regexp_matches(x180, '^\s*\([^)]{2,160}\)')"""))
def context_edges(spark, d):
    return graph.context_edges(_held(spark, d, P.CONTEXT_EDGE, "near"))


@query(_with(_OCC + ", found AS (SELECT o.doc_id, o.ord, f.authority_id FROM occ o JOIN occ f ON o.doc_id = f.doc_id AND f.ord < o.ord AND f.form = 'full' AND f.kind IN ('case', 'quoted') AND o.v = f.v AND o.n = f.n WHERE o.form = 'short_case'), c AS (SELECT doc_id, ord, count(DISTINCT authority_id) AS nk, min(authority_id) AS a FROM found GROUP BY ALL) SELECT o.doc_id, cast(o.ord AS BIGINT) AS ord, CASE WHEN nk = 1 THEN a END AS authority_id, CASE WHEN nk = 1 THEN '' WHEN nk > 1 THEN 'multiple_plausible_prior_cases' ELSE 'no_legally_possible_prior_antecedent' END AS reasons FROM occ o LEFT JOIN c USING (doc_id, ord) WHERE form = 'short_case'"))
def resolve_short_case(spark, d):
    return resolve.short_cases(_forms(spark, d, P.SHORT_CASE)).select("doc_id", "ord", "authority_id", F.array_join("reasons", ",").alias("reasons"))


@query(_with(_OCC + f", found AS (SELECT o.doc_id, o.ord, f.authority_id FROM occ o JOIN occ f ON o.doc_id = f.doc_id AND f.ord < o.ord AND f.form = 'full' AND (f.kind IN {_STATUTES} OR f.kind IN {_REGS}) AND o.b = f.b WHERE o.form = 'statutory_short'), c AS (SELECT doc_id, ord, count(DISTINCT authority_id) AS nk, min(authority_id) AS a FROM found GROUP BY ALL) SELECT o.doc_id, cast(o.ord AS BIGINT) AS ord, CASE WHEN nk = 1 THEN a END AS authority_id, CASE WHEN nk = 1 THEN '' WHEN nk > 1 THEN 'multiple_plausible_statutory_antecedents' ELSE 'no_legally_possible_prior_antecedent' END AS reasons FROM occ o LEFT JOIN c USING (doc_id, ord) WHERE form = 'statutory_short'"))
def resolve_statutory_short(spark, d):
    return resolve.statutory_shorts(_forms(spark, d, P.TWO_SECTIONS)).select("doc_id", "ord", "authority_id", F.array_join("reasons", ",").alias("reasons"))


@query(_with(_OCC + ", found AS (SELECT o.doc_id, o.ord, CASE WHEN f.kind = 'journal' THEN f.authority_id END AS a, f.kind <> 'journal' AS bar FROM occ o JOIN occ f ON o.doc_id = f.doc_id AND f.ord < o.ord AND f.form = 'full' AND (f.kind = 'journal' OR (f.source_type = 'case' AND contains(lower(f.n || ' v. ' || f.m), 'doe'))) WHERE o.form = 'supra'), c AS (SELECT doc_id, ord, count(DISTINCT a) AS nk, min(a) AS a, bool_or(bar) AS bar FROM found GROUP BY ALL) SELECT o.doc_id, cast(o.ord AS BIGINT) AS ord, CASE WHEN nk = 1 THEN a END AS authority_id, CASE WHEN nk = 1 THEN '' WHEN nk > 1 THEN 'multiple_plausible_supra_antecedents' WHEN bar THEN 'source_type_does_not_permit_supra' ELSE 'no_legally_possible_prior_antecedent' END AS reasons FROM occ o LEFT JOIN c USING (doc_id, ord) WHERE form = 'supra'"))
def resolve_supra(spark, d):
    return resolve.supras(_forms(spark, d, P.SUPRA, "beside")).select("doc_id", "ord", "authority_id", F.array_join("reasons", ",").alias("reasons"))


_ID = r"""
, others AS (
  SELECT o.doc_id, o.ord, CASE WHEN count(DISTINCT f.authority_id) = 1 THEN min(f.authority_id) END AS a FROM occ o JOIN occ f ON o.doc_id = f.doc_id AND f.ord < o.ord AND f.form = 'full'
    AND ((o.form = 'short_case' AND f.kind IN ('case', 'quoted') AND o.v = f.v AND o.n = f.n) OR (o.form = 'statutory_short' AND f.source_type IN ('statute', 'regulation') AND o.b = f.b) OR (o.form = 'supra' AND f.kind = 'journal')) GROUP BY ALL),
g AS (SELECT o.*, coalesce(o.authority_id, x.a) AS eff, lag(o.e) OVER w AS pe, lag(o.form) OVER w AS pf FROM occ o LEFT JOIN others x USING (doc_id, ord) WINDOW w AS (PARTITION BY o.doc_id ORDER BY o.ord)),
h AS (SELECT g.*, CASE WHEN pe IS NULL THEN '' ELSE substr(text, cast(pe + 1 AS BIGINT), cast(greatest(s - pe, 0) AS BIGINT)) END AS gap FROM g JOIN briefs USING (doc_id)),
q AS (SELECT *, NOT regexp_matches(gap, '\.\s+[A-Z]') AND NOT regexp_matches(gap, '[A-Za-z]{3,}') AS clean FROM h),
grp AS (SELECT a.doc_id, a.ord, (SELECT count(*) FROM q b WHERE b.doc_id = a.doc_id AND b.ord < a.ord AND b.form = 'full'
   AND NOT EXISTS (SELECT 1 FROM q c WHERE c.doc_id = a.doc_id AND c.ord > b.ord AND c.ord < a.ord AND (NOT c.clean OR (c.ord < a.ord - 1 AND c.form <> 'full')))) AS nk FROM q a WHERE form = 'id'),
bar AS (SELECT q.*, q.form = 'id' AND (q.ord = 0 OR contains(gap, ';') OR coalesce(nk, 0) > 1 OR regexp_matches(gap, '\bv\.\s|\b\d{1,4}\s+(?:(?:[A-Z]\.){1,3}|[A-Z][a-z]{0,3}\.)|§|\bsupra\b|\bId\.\B') OR contains(gap, chr(10) || chr(10))) AS dq FROM q LEFT JOIN grp USING (doc_id, ord)),
isl AS (SELECT *, sum(CASE WHEN form = 'id' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY ord) AS island FROM bar),
res AS (SELECT doc_id, ord, form, bool_or(dq) OVER i AS barred, first_value(CASE WHEN form <> 'id' THEN eff END) OVER i AS base FROM isl WINDOW i AS (PARTITION BY doc_id, island ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
"""


@query(_with(_OCC + _ID + "SELECT doc_id, cast(ord AS BIGINT) AS ord, CASE WHEN NOT barred THEN base END AS authority_id FROM res WHERE form = 'id'"))
def resolve_id_chain(spark, d):
    occ = _forms(spark, d, P.ID_FORM, "gap", "beside")
    others = resolve.short_cases(occ).unionByName(resolve.statutory_shorts(occ)).unionByName(resolve.supras(occ))
    return resolve.id_chains(occ, others).select("doc_id", "ord", "authority_id")


@query(_with(_OCC + _ID + "SELECT form || '_to_antecedent' AS edge_type, count(*) AS n FROM (SELECT form, CASE WHEN NOT barred THEN base END AS a FROM res WHERE form = 'id' UNION ALL SELECT form, x.a FROM occ JOIN others x USING (doc_id, ord)) WHERE a IS NOT NULL GROUP BY 1"))
def antecedent_edge_counts(spark, d):
    b = briefs(spark, d)
    occ = _occ(spark, d)
    return resolve.antecedent_edges(resolve.resolutions(occ, resolve.alias_targets(graph.with_occurrences(b), occ))).groupBy("edge_type").agg(F.count("*").alias("n"))


_NOTES_TEXT = "concat('Body claim.[', cast(o_custkey % 7 + 1 as string), '] Doe, supra note ', cast(o_custkey % 7 + 1 + cast(o_orderkey % 5 = 0 as int) as string), ', at 9.', chr(10), chr(10), '[', cast(o_custkey % 7 + 1 as string), '] Jane Doe, Some Title, ', cast(o_custkey % 60 + 1 as string), ' Harv. L. Rev. ', cast(o_orderkey % 800 + 1 as string), ' (1990)', CASE WHEN o_orderkey % 3 = 0 THEN concat('; John Roe, Other Title, 9 Yale L. J. ', cast(o_orderkey % 700 + 1 as string), ' (1991)') ELSE '' END, '.')"


@query("WITH o AS (SELECT o_orderkey AS doc_id, o_orderkey % 5 = 0 AS other, o_orderkey % 3 = 0 AS two FROM orders) SELECT doc_id, NOT other AND NOT two AS resolved, CASE WHEN other THEN 'referenced_note_has_no_permitted_authority' WHEN two THEN 'referenced_note_has_multiple_authorities' ELSE '' END AS reasons FROM o")
def resolve_supra_note(spark, d):
    docs = orders(spark, d).select(F.col("o_orderkey").alias("doc_id"), F.expr(_NOTES_TEXT).alias("text"))
    return resolve.supra_notes(graph.occurrences(docs).persist()).select("doc_id", F.col("authority_id").isNotNull().alias("resolved"), F.array_join("reasons", ",").alias("reasons"))


_ALIAS_TEXT = "concat('Jane Doe, Some Title, ', cast(o_custkey % 60 + 1 as string), ' Harv. L. Rev. ', cast(o_orderkey % 800 + 1 as string), ' (1990) (hereinafter \"Title', cast(o_orderkey % 9 as string), '\"). Then Title', cast(o_orderkey % 9 as string), ' says so', CASE WHEN o_orderkey % 4 = 0 THEN ' and Title' || cast(o_orderkey % 9 as string) || ' again' ELSE '' END, '.')"


@query("SELECT o_orderkey AS doc_id, count(*) AS n, count(*) AS n_resolved FROM (SELECT o_orderkey FROM orders UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 0) GROUP BY 1")
def resolve_hereinafter(spark, d):
    docs = orders(spark, d).select(F.col("o_orderkey").alias("doc_id"), F.expr(_ALIAS_TEXT.replace('\\"', '"')).alias("text"))
    facts = graph.with_occurrences(docs)
    occ = graph.occurrences(docs).persist()
    out = resolve.hereinafters(occ, resolve.alias_targets(facts, occ))
    return out.groupBy("doc_id").agg(F.count("*").alias("n"), F.count("authority_id").alias("n_resolved"))


# Findings, modes, blocks


@query(_with("SELECT doc_id, 'SIGNAL_PUNCTUATION' AS code, cast(seg_start AS BIGINT) AS start, cast(seg_start + 2 AS BIGINT) AS \"end\", 'Cf.' AS suggestion FROM placed WHERE kind = 'signal'"))
def findings_signal_punctuation(spark, d):
    return findings.signal_findings(briefs(spark, d)).where("code = 'SIGNAL_PUNCTUATION'").select("doc_id", "code", "start", "end", "suggestion")


@query(_with("SELECT doc_id, CASE kind WHEN 'quoted' THEN 'QUOTATION_PINCITE_REQUIRED' ELSE 'PROPOSITION_PINCITE_REVIEW' END AS code, " + _AT + " FROM cites WHERE kind IN ('case_bad', 'quoted', 'journal')"))
def findings_pincites(spark, d):
    return findings.pincite_findings(graph.occurrences(briefs(spark, d), surroundings=("near",))).select("doc_id", "code", "start", "end")


@query(_with("SELECT doc_id, 'WHITEPAGES_ARCHIVE_REVIEW' AS code, " + _AT + " FROM cites WHERE kind = 'internet'"))
def findings_archive(spark, d):
    return findings.internet_findings(_held(spark, d, P.URL, "near"), "whitepages").select("doc_id", "code", "start", "end")


@query(_with("SELECT doc_id, count(*) FILTER (kind = 'string_cite') AS unbalanced, cast(coalesce(sum(CASE kind WHEN 'case' THEN 1 WHEN 'case_bad' THEN 1 WHEN 'journal' THEN 1 WHEN 'quoted' THEN 2 END), 0) AS BIGINT) AS balanced FROM segs GROUP BY doc_id HAVING unbalanced + balanced > 0"))
def parenthetical_depth(spark, d):
    return findings.parentheticals(briefs(spark, d)).groupBy("doc_id").agg(F.count_if(~F.col("balanced")).alias("unbalanced"), F.count_if("balanced").alias("balanced"))


@query("SELECT o_orderkey AS doc_id, least(n, 20) + cast(n > 20 AS INTEGER) AS n FROM (SELECT o_orderkey, cast(o_custkey % 30 AS BIGINT) AS n FROM orders) WHERE n > 0")
def findings_bidi(spark, d):
    docs = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("doc_id"), F.expr("concat('a', repeat(concat('\u202e', 'b'), cast(o_custkey % 30 as int)))").alias("text"))
    return findings.bidi_findings(docs).groupBy("doc_id").agg(F.count("*").alias("n"))


_MODE_WORDS = P.FILING_WORDS.replace("(?iuU)", "(?i)")


@query(_with(f"SELECT doc_id, 'bluepages' AS mode, cast(b AS BIGINT) AS blue_score, CASE WHEN b >= 2 THEN 'high' WHEN b >= 1 THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT doc_id, cast(regexp_matches(substr(text, 1, 4000), '{_MODE_WORDS}') AS INTEGER) + cast(len(regexp_extract_all(text, '{_HINT}')) >= 2 AS INTEGER) AS b FROM briefs)"))
def document_mode(spark, d):
    return mode.document_mode(briefs(spark, d)).select("doc_id", "mode", "blue_score", "confidence")


@query(_with(r"SELECT doc_id, cast(i - 1 AS BIGINT) AS ord, trim(x, chr(10) || ' ') AS text FROM (SELECT doc_id, unnest(string_split_regex(trim(text, chr(10) || ' '), '\n\s*\n')) AS x, generate_subscripts(string_split_regex(trim(text, chr(10) || ' '), '\n\s*\n'), 1) AS i FROM briefs)"))
def text_blocks(spark, d):
    return block_rows(briefs(spark, d)).select("doc_id", "ord", "text")


_PAIRS = ", ".join(f"('{k}', '{v}')" for k, v in sorted(tables.jurisdiction_aliases().items()))


@query(f"WITH a(k, v) AS (VALUES {_PAIRS}), x AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'auto' WHEN 1 THEN ' ca ' WHEN 2 THEN 'New-York' ELSE c_mktsegment END AS i FROM customer) SELECT c_custkey, CASE WHEN lower(trim(i)) = 'auto' THEN 'federal' ELSE v END AS profile FROM x LEFT JOIN a ON a.k = replace(lower(trim(i)), '-', '_')")
def resolve_jurisdictions(spark, d):
    ident = F.expr("CASE c_custkey % 4 WHEN 0 THEN 'auto' WHEN 1 THEN ' ca ' WHEN 2 THEN 'New-York' ELSE c_mktsegment END")
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", tables.resolve_jurisdiction(ident).alias("profile"))


# Formats


@query(_with("SELECT doc_id, cast(ord AS BIGINT) AS ord, CASE WHEN kind IN ('statute_bad', 'statute', 'invisible', 'string_cite') THEN t || ' U.S.C. § ' || b WHEN kind = 'case' THEN n || ' v. ' || m || ', ' || v || ' U.S. ' || b || ', ' || p || ' (' || y || ')' WHEN kind = 'case_bad' THEN n || ' v. ' || m || ', ' || v || ' F.2d ' || b || ' (' || y || ')' WHEN kind = 'quoted' THEN n || ' v. ' || m || ', ' || v || ' U.S. ' || b || ' (' || y || ')' WHEN kind = 'constitution' THEN cite END AS citation, CASE WHEN kind LIKE 'regulation%' THEN 'year' WHEN kind = 'journal' THEN 'author,title,first_page,year' ELSE '' END AS missing FROM cites WHERE kind NOT IN ('id', 'id_bad', 'supra', 'internet')"))
def convert_citations(spark, d):
    seg = segments(spark, d).where("cite != '' and kind not in ('id', 'id_bad', 'supra', 'internet')").select(F.struct("doc_id", "ord").alias("doc_id"), F.col("cite").alias("text"))
    return formats.convert(seg).select("doc_id.doc_id", "doc_id.ord", "citation", F.array_join("missing", ",").alias("missing"))


@query("SELECT s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN s_name || ', *A Book* ' || cast(s_suppkey % 90 AS VARCHAR) || ' (2d ed. ' || cast(1950 + s_nationkey AS VARCHAR) || ')' END AS citation, CASE WHEN s_nationkey % 2 = 0 THEN 'ok' ELSE 'missing_facts' END AS status FROM supplier")
def generate_citations(spark, d):
    fields = F.create_map(F.lit("author"), F.col("s_name"), F.lit("title"), F.lit("A Book"), F.lit("pincite"), (F.col("s_suppkey") % 90).cast("string"), F.lit("edition"), F.lit("2d ed."), F.lit("year"), F.when(F.col("s_nationkey") % 2 == 0, (1950 + F.col("s_nationkey")).cast("string")).otherwise(F.lit("")))
    df = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", F.lit("book").alias("source_type"), fields.alias("fields"))
    return formats.generate(df, style="markdown").select("s_suppkey", "citation", "status")


# Retrieval and evidence


@query("WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents), q AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark), s AS (SELECT item_id AS query_id, doc_id AS chunk_id, len(list_intersect(t.w, q.w)) AS o, len(list_intersect(t.w, q.w)) / sqrt(greatest(1, len(t.w) * len(q.w))) AS score FROM t, q), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s WHERE o > 0) SELECT query_id, chunk_id, cast(o AS BIGINT) AS overlap, rank FROM r WHERE rank <= 5")
def lexical_retrieval_topk(spark, d):
    chunks = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text")
    items = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.lexical_top_k(chunks, items).select("query_id", "chunk_id", "overlap", "rank")


@query("WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda z: cast(z[1] AS DOUBLE) * cast(z[2] AS DOUBLE))) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) SELECT query_id, chunk_id, rank FROM r WHERE rank <= 5")
def embedding_topk(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return retrieval.vector_top_k(e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v")), e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))).select("query_id", "chunk_id", "rank")


@query(r"SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '" + '"' + r"'), '&#39;', ''''), '&amp;', '&'), '[ \t\n\r\f\x0b]+', ' ', 'g')) AS text FROM pages")
def html_to_text(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", html_text(F.col("html")).alias("text"))


_SENTENCES = r"list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(regexp_replace(translate(x, '—–', '--'), '\s+', ' ', 'g'))), lambda x: x <> '')"


@query(f"WITH s AS (SELECT doc_id, {_SENTENCES} AS s FROM documents), w AS (SELECT doc_id, s, list_transform(s, lambda x: len(string_split(x, ' '))) AS n FROM s), p AS (SELECT doc_id, list_transform(range(1, len(s) + 1), lambda i: s[i] || CASE WHEN n[i] < 70 AND i < len(s) THEN ' ' || s[i + 1] || CASE WHEN n[i] + n[i + 1] < 70 AND i + 1 < len(s) THEN ' ' || s[i + 2] ELSE '' END ELSE '' END) AS p FROM w) SELECT doc_id, cast(len(p) AS BIGINT) AS n_passages, sha256(array_to_string(p, chr(10))) AS sha FROM p")
def sliding_passages(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", retrieval.passages(F.col("text")).alias("p"))
    return docs.select("doc_id", F.size("p").alias("n_passages"), F.sha2(F.array_join("p", "\n"), 256).alias("sha"))


_NORMAL = r"trim(regexp_replace(translate({}, '—–', '--'), '\s+', ' ', 'g'))"
_PLAIN = r"trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g'))"
_QUOTE = "CASE doc_id % 4 WHEN 0 THEN substr(text, 11, 60) WHEN 1 THEN replace(substr(text, 11, 60), ' ', ' - ') WHEN 2 THEN ' ' ELSE 'no such words ' || substr(text, 1, 30) END"


@query(f"WITH q AS (SELECT doc_id, text, {_QUOTE} AS quote FROM documents), n AS (SELECT doc_id, quote, {_NORMAL.format('quote')} AS q, {_NORMAL.format('text')} AS s FROM q), c AS (SELECT *, {_PLAIN.format('q')} AS cq, {_PLAIN.format('s')} AS cs FROM n) SELECT doc_id, CASE WHEN trim(quote) = '' THEN 'not_supplied' WHEN contains(s, q) THEN 'exact' WHEN cq <> '' AND contains(cs, cq) THEN 'normalized' ELSE 'compare' END AS status FROM c")
def quote_status(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", retrieval.quote_status(F.expr(_QUOTE), F.col("text")).alias("status"))


@query()
def quote_match(spark, d):
    from ..operators.evidence import match_quotes

    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("source"), F.expr(_QUOTE).alias("quote"))
    return match_quotes(docs)


@query()
def passage_rank_ratio(spark, d):
    from ..operators.evidence import rank_passages

    docs = spread(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), "doc_id")
    return rank_passages(docs.select(F.col("doc_id").alias("id"), F.col("text").alias("source"), F.substring("text", 21, 80).alias("proposition")), 1)


# Intervals, review, evaluation


@query("WITH i AS (SELECT l_orderkey AS doc_id, cast(l_partkey % 200 AS BIGINT) AS s, cast(l_partkey % 200 + l_suppkey % 20 AS BIGINT) AS e FROM lineitem), o AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM i), g AS (SELECT *, sum(CASE WHEN m IS NULL OR s > m THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT doc_id, min(s) AS start, max(e) AS \"end\" FROM g GROUP BY doc_id, k")
def interval_merge(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    spans_ = li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_list(F.struct((F.col("l_partkey") % 200).cast("int").alias("start"), (F.col("l_partkey") % 200 + F.col("l_suppkey") % 20).cast("int").alias("end"))).alias("s"))
    return rows_of(spans_.withColumn("m", merge_touching(F.col("s"))), "m", F.col("doc_id"))


@query(_with(_ISSUES + "SELECT CASE WHEN suggestion IS NULL THEN 'annotation' ELSE 'text_edit' END AS kind, CASE WHEN suggestion IS NULL THEN 'pending' ELSE 'accepted' END AS decision, count(*) AS n FROM issues GROUP BY ALL"))
def review_items(spark, d):
    return review.review_items(lint.issue_rows(briefs(spark, d))).groupBy("kind", "decision").agg(F.count("*").alias("n"))


@query(_with(f"SELECT doc_id, 'ok' AS status, count(*) FILTER (kind IN ('statute_bad', 'regulation_bad', 'case_bad')) AS edits, string_agg(lead || CASE WHEN kind = 'id_bad' THEN cite ELSE {_FIXED} END || tail, '' ORDER BY ord) AS exported_text FROM segs GROUP BY doc_id"))
def apply_decisions(spark, d):
    b = briefs(spark, d)
    items = review.review_items(lint.issue_rows(b)).persist()
    # All capitalisation edits are rejected in a second revision, after being accepted in the first.
    ids = items.where("code = 'SHORT_FORM_CAPITALIZATION'").select("item_id")
    said = ids.select("item_id", F.lit("accepted").alias("decision"), F.lit(1).alias("revision")).unionByName(ids.select("item_id", F.lit("rejected").alias("decision"), F.lit(2).alias("revision")))
    return review.export_plan(review.decide(items, said), b)


@query("SELECT o_orderkey, cast(o_orderdate AS TIMESTAMP) AS o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' OR (o_orderdate = TIMESTAMP '1998-01-01' AND o_orderkey < 100) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 51")
def keyset_page(spark, d):
    import datetime

    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderdate")
    return review.keyset_page(orders, "o_orderdate", "o_orderkey", 50, (datetime.datetime(1998, 1, 1), 100))


@query("""WITH RECURSIVE e AS (SELECT user_id AS session_id, event_id % 3 AS base, event_type AS state, props AS content, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
f AS (SELECT session_id, r, cast(base = 0 AS BIGINT) AS revision, cast(base <> 0 AS BIGINT) AS conflicts, CASE WHEN base = 0 THEN state END AS state, CASE WHEN base = 0 THEN content END AS content FROM e WHERE r = 1
  UNION ALL SELECT e.session_id, e.r, f.revision + cast(e.base = f.revision AS BIGINT), f.conflicts + cast(e.base <> f.revision AS BIGINT), CASE WHEN e.base = f.revision THEN e.state ELSE f.state END, CASE WHEN e.base = f.revision THEN e.content ELSE f.content END FROM f JOIN e ON e.session_id = f.session_id AND e.r = f.r + 1)
SELECT session_id, revision, conflicts, state, content, sha256(coalesce(content, '')) AS content_sha256 FROM f QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY r DESC) = 1""")
def revision_cas(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    log = e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.pmod(F.col("event_id"), F.lit(3)).alias("base_revision"), F.col("event_type").alias("state"), F.col("props").alias("content"))
    return review.revisions(log)


@query(_with(f"SELECT {_TYPE} AS source_type, count(*) AS n_gold, count(*) AS tp, cast(1.0 AS DOUBLE) AS precision, cast(1.0 AS DOUBLE) AS recall FROM cites GROUP BY 1"))
def eval_precision_recall(spark, d):
    found = extract.citation_rows(briefs(spark, d), parts=()).select("doc_id", "start", "end", "source_type")
    seg = segments(spark, d)
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length(F.concat("lead", "cite", "tail"))).over(w), F.lit(0)) + F.length("lead")
    kinds = F.element_at(tables.as_map(SOURCE_TYPE), F.col("kind"))
    gold = seg.select("doc_id", "cite", at.alias("at"), kinds.alias("source_type")).where("cite != ''").select("doc_id", F.col("at").cast("int").alias("start"), (F.col("at") + F.length("cite")).cast("int").alias("end"), "source_type")
    return evaluate.precision_recall(found, gold, ["doc_id", "start", "end", "source_type"], ["source_type"]).select("source_type", "n_gold", "tp", "precision", "recall")


@query("WITH x AS (SELECT o_orderstatus AS g, CASE WHEN o_orderkey % 7 = 0 THEN 'F' ELSE o_orderstatus END AS f FROM orders), l AS (SELECT DISTINCT g AS label FROM x UNION SELECT DISTINCT f FROM x) SELECT label, (SELECT count(*) FROM x WHERE g = label AND f = label) AS tp, (SELECT count(*) FROM x WHERE g <> label AND f = label) AS fp, (SELECT count(*) FROM x WHERE g = label AND f <> label) AS fn FROM l")
def label_scores(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderstatus").alias("g"), F.when(F.col("o_orderkey") % 7 == 0, "F").otherwise(F.col("o_orderstatus")).alias("f"))
    return evaluate.label_scores(rows, "g", "f").select("label", "tp", "fp", "fn")


@query(_with(f"SELECT CASE WHEN {_TYPE} <> 'case' THEN 'mechanical_only' WHEN cast(v AS INTEGER) % 3 = 0 THEN 'source_matched' WHEN cast(v AS INTEGER) % 3 = 1 THEN 'source_not_matched' ELSE 'mechanical_only' END AS tier, count(*) AS n FROM cites WHERE {_TYPE} NOT IN ('short_form') GROUP BY 1"))
def certification_tiers(spark, d):
    cites = extract.citation_rows(briefs(spark, d)).where("source_type != 'short_form'").select("source_type", F.concat_ws(" ", F.col("components")["volume"], F.lower(F.col("components")["reporter"]), F.col("components")["first_page"]).alias("cite_key")).persist()
    vol = F.split("cite_key", " ")[0].cast("int") % 3
    lookups = cites.where("source_type = 'case'").select(F.col("cite_key").alias("key"), (vol == 0).alias("found"), vol.alias("k")).where("k < 2").distinct().drop("k")
    return evaluate.certification_tiers(cites, lookups).groupBy("tier").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CASE WHEN s = 200 AND c = 1 THEN 'verified' WHEN s IN (200, 300) AND c > 1 THEN 'ambiguous' WHEN s = 404 OR (s = 200 AND c = 0) THEN 'not_found' ELSE 'unavailable' END AS status FROM (SELECT o_orderkey, CASE o_custkey % 4 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 300 ELSE 503 END AS s, o_orderkey % 3 AS c FROM orders)")
def verification_classify(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    s = F.when(F.col("o_custkey") % 4 == 0, 200).when(F.col("o_custkey") % 4 == 1, 404).when(F.col("o_custkey") % 4 == 2, 300).otherwise(503)
    return o.select("o_orderkey", evaluate.verification_status(s, F.col("o_orderkey") % 3).alias("status"))


@query("WITH g AS (SELECT *, row_number() OVER (ORDER BY sha256('17:' || cast(p_partkey AS VARCHAR))) - 1 AS r FROM part) SELECT p_partkey, CASE r % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split FROM g")
def split_assignment(spark, d):
    return evaluate.assign_splits(spark.read.parquet(f"{d}/part.parquet").select("p_partkey"), "p_partkey", "17")


@query(_with(_ISSUES + f"SELECT c.doc_id, cast(c.c_start AS BIGINT) AS start, {_TYPE} AS source_type, count(i.code) AS n_issues FROM cites c LEFT JOIN issues i ON c.doc_id = i.doc_id AND i.s < c.c_end AND c.c_start < i.e GROUP BY ALL"))
def citation_tasks(spark, d):
    return context.citation_tasks(briefs(spark, d)).select("doc_id", "start", "source_type", F.size("issues").cast("long").alias("n_issues"))


@query()
def document_context(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return context.document_context(docs, budget=4000).select("doc_id", "status", "kept", F.length("context").alias("n"), "sha256")


# Events


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, cast(round(sum(value) * 100) AS BIGINT) AS cents FROM events GROUP BY ALL")
def events_windows(spark, d):
    return event_windows(spark.read.parquet(f"{d}/events.parquet")).select("window_start", "event_type", "n", F.round(F.col("total") * 100).cast("long").alias("cents"))


@query("WITH l AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, k")
def events_sessions(spark, d):
    return event_sessions(spark.read.parquet(f"{d}/events.parquet"))


from . import join_queries, review_queries  # noqa: E402,F401  (they add their queries)
