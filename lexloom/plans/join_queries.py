"""Queries of span and as-of joins, the stored index and keyed state over whole tables, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.patterns import Pattern
from ..functions.spans import rows_of, spans
from ..operators import formats, lint, retrieval, scoring
from ..operators.spanjoin import asof_join, nested, span_join
from ..sources import blocks, sinks
from ..sources.briefs import briefs, orders
from ..sources.paths import shared_path
from ..sources.rule_index import RuleIndex
from ..streaming.state import revise, revision_table
from . import inference, seams
from .queries import _ISSUES, SQL, _with, query

_SHIPMENTS = """s AS (SELECT l_suppkey, l_returnflag AS flag, date_diff('day', DATE '1990-01-01', cast(l_shipdate AS DATE)) AS a, date_diff('day', DATE '1990-01-01', cast(l_shipdate AS DATE)) + cast(l_quantity AS BIGINT) AS b FROM lineitem)"""


def _shipments(spark, d):
    day = F.date_diff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("long")
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", F.col("l_returnflag").alias("flag"), day.alias("start"), (day + F.col("l_quantity").cast("long")).alias("end"))
    return rows.where("flag = 'R'"), rows.where("flag <> 'R'")


@query(f"""WITH {_SHIPMENTS} SELECT x.l_suppkey, count(*) AS n_pairs, cast(sum(least(x.b, y.b) - greatest(x.a, y.a)) AS BIGINT) AS shared_days
FROM s x JOIN s y ON x.l_suppkey = y.l_suppkey AND x.flag = 'R' AND y.flag <> 'R' AND x.a < y.b AND y.a < x.b GROUP BY 1""")
def span_overlaps(spark, d):
    """Returned shipments under way together with others of their supplier."""
    pairs = span_join(*_shipments(spark, d), ["l_suppkey"])
    shared = F.least("end", "right_end") - F.greatest("start", "right_start")
    return pairs.groupBy("l_suppkey").agg(F.count("*").alias("n_pairs"), F.sum(shared).alias("shared_days"))


@query(f"""WITH {_SHIPMENTS} SELECT l_suppkey, count(*) AS n_alone, sum(b - a)::BIGINT AS days FROM s x WHERE flag = 'R' AND NOT EXISTS (SELECT 1 FROM s y
WHERE x.l_suppkey = y.l_suppkey AND y.flag <> 'R' AND y.a <= x.a AND x.b <= y.b) GROUP BY 1""")
def span_not_within(spark, d):
    """Returned shipments that no other shipment of their supplier covers."""
    alone = span_join(*_shipments(spark, d), ["l_suppkey"], "anti", "within")
    return alone.groupBy("l_suppkey").agg(F.count("*").alias("n_alone"), F.sum(F.col("end") - F.col("start")).alias("days"))


def _lines(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cut = lambda p: rows_of(docs.withColumn("x", spans(F.col("text"), Pattern(p))), "x", F.col("doc_id")).select("doc_id", "start", "end")
    return cut(r"[^\n]+"), cut(r"[0-9]+")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS n_lines, cast(sum(len(regexp_extract_all(line, '[0-9]+'))) AS BIGINT) AS n_numbers, count(*) FILTER (line SIMILAR TO '[^0-9]*') AS n_plain FROM l WHERE line <> '' GROUP BY 1""")
def numbers_in_lines(spark, d):
    """Numbers inside the lines of each document (left outer containment); lines without one count as plain."""
    lines, numbers = _lines(spark, d)
    each = span_join(lines, numbers, ["doc_id"], "left", "contains").groupBy("doc_id", "start").agg(F.count("right_start").alias("n"))
    return each.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum("n").alias("n_numbers"), F.count_if(F.col("n") == 0).alias("n_plain"))


@query("""WITH c AS (SELECT user_id, ts, max(event_id) AS click_id FROM events WHERE event_type = 'click' GROUP BY ALL)
SELECT e.event_id, c.click_id, epoch_us(c.ts) AS click_us FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN c ON e.user_id = c.user_id AND e.ts >= c.ts""")
def events_asof(spark, d):
    """The last click of its user at or before each error."""
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    errors, clicks = e.where("event_type = 'error'").drop("event_type"), e.where("event_type = 'click'").select("user_id", "us", F.col("event_id").alias("click_id"))
    found = asof_join(errors, clicks, ["user_id"], "us", "us", width=86_400_000_000)
    return found.select("event_id", F.col("right_click_id").alias("click_id"), F.col("right_us").alias("click_us"))


@query("""WITH s AS (SELECT o_orderkey AS id, o_custkey, date_diff('day', DATE '1990-01-01', cast(o_orderdate AS DATE)) AS a, date_diff('day', DATE '1990-01-01', cast(o_orderdate AS DATE)) + cast(floor(o_totalprice / 5000) AS BIGINT) AS b FROM orders),
p AS (SELECT x.id, y.id AS parent, row_number() OVER (PARTITION BY x.id ORDER BY y.b - y.a, CASE WHEN y.b - y.a = x.b - x.a THEN -y.id ELSE y.id END) AS k FROM s x JOIN s y ON x.o_custkey = y.o_custkey AND y.a <= x.a AND x.b <= y.b AND x.id <> y.id AND (y.b - y.a > x.b - x.a OR y.id < x.id))
SELECT id, parent AS parent_id FROM s LEFT JOIN (SELECT id, parent FROM p WHERE k = 1) USING (id)""")
def nested_spans(spark, d):
    """Of each order's period the shortest other one of the customer that holds it."""
    day = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("long")
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), "o_custkey", day.alias("start"), (day + F.floor(F.col("o_totalprice") / 5000)).alias("end"))
    return nested(o, ["o_custkey"]).select("id", "parent_id")


@query(SQL["lexical_retrieval_topk"])
def indexed_topk(spark, d):
    """The best documents of each benchmark item from a stored index over all documents."""
    chunks = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text")
    items = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    return RuleIndex.build(chunks, shared_path(spark, "index")).search(items).select("query_id", "chunk_id", "overlap", "rank")


@query("""WITH l AS (SELECT user_id AS session_id, event_id AS seq, event_id % 3 AS base, event_type AS state FROM events), r AS (
SELECT session_id, list(base ORDER BY seq) AS bases, list(seq ORDER BY seq) AS seqs, list(state ORDER BY seq) AS states FROM l GROUP BY 1),
f AS (SELECT session_id, states, len(bases) AS n, list_reduce(list_prepend({'r': 0::BIGINT, 'i': 0::BIGINT, 'b': 0::BIGINT}, list_transform(list_zip(range(1, len(bases) + 1), bases), lambda z: {'r': 0::BIGINT, 'i': z[1]::BIGINT, 'b': z[2]::BIGINT})), lambda a, x: CASE WHEN x.b = a.r THEN {'r': a.r + 1, 'i': x.i, 'b': 0::BIGINT} ELSE a END) AS x FROM r)
SELECT session_id, x.r AS revision, n - x.r AS conflicts, states[x.i] AS state FROM f""")
def revisions_by_batches(spark, d):
    """Compare-and-set revisions kept in a keyed table over several numbered batches: those of the whole log at once."""
    e = spark.read.parquet(f"{d}/events.parquet")
    log = e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.pmod("event_id", F.lit(3)).alias("base_revision"), F.col("event_type").alias("state"), F.col("props").alias("content"))
    ends = log.agg(F.expr("approx_percentile(seq, array(0.34, 0.67, 1.0))").alias("e"), F.max("seq").alias("m")).first()
    table, low = revision_table(spark, shared_path(spark, "revisions"), buckets=8), -1
    for batch, high in enumerate([*ends["e"][:2], ends["m"]]):
        revise(table, log.where((F.col("seq") > low) & (F.col("seq") <= high)), batch)
        low = high
    return table.read().select("session_id", "revision", "conflicts", "state")


def toy_ranker():
    """A stand-in for a model of its own weights: a linear score of a text's length and of how often it says e and a, in numpy."""
    weights = np.array([-1.0, 40.0, 20.0])

    def score(batch):
        features = np.array([[len(t or ""), (t or "").count("e"), (t or "").count("a")] for t in batch.column(1).to_pylist()], float).reshape(-1, 3)
        return (features @ weights).tolist()

    return score


_RANKED = SQL["lexical_retrieval_topk"]


@query(f"""WITH k AS ({_RANKED}), s AS (SELECT query_id, chunk_id, rank AS old_rank, -1.0 * length(text) + 40.0 * (length(text) - length(replace(text, 'e', ''))) + 20.0 * (length(text) - length(replace(text, 'a', ''))) AS score FROM k JOIN documents ON doc_id = chunk_id)
SELECT query_id, chunk_id, cast(score AS BIGINT) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old_rank) AS rank FROM s""")
def model_reranking(spark, d):
    """The best documents of each benchmark item, ordered anew by a model that runs on the executors."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text")
    items = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    ranked = retrieval.lexical_top_k(docs, items).join(docs, "chunk_id").join(items.select("query_id", F.col("text").alias("query_text")), "query_id")
    seams.register("reranker", "toy", inference.reranker("toy_ranker", toy_ranker))
    out = seams.part("reranker", "toy")(ranked.select("query_id", "chunk_id", "rank", "query_text", "text"))
    return out.select("query_id", "chunk_id", F.col("model_score").cast("long").alias("score"), "rank")


def toy_answers():
    """Counts a turn's words; it has nothing to say to a question and can't stand a turn of three lines."""

    def answer(batch):
        out = []
        for t in batch.column(0).to_pylist():
            if (t or "").count("\n") == 2:
                raise ValueError("three lines")
            out.append(None if "?" in (t or "?") else str(len(t.split(" "))))
        return out

    return answer


@query("""WITH t AS (SELECT *, length(text) - length(replace(text, chr(10), '')) = 2 AS bad, text IS NULL OR contains(text, '?') AS asks FROM conversations)
SELECT conv_id, turn, CASE WHEN bad THEN 'failed' WHEN asks THEN 'empty' ELSE 'ok' END AS status, CASE WHEN bad OR asks THEN NULL ELSE cast(len(string_split(text, ' ')) AS VARCHAR) END AS raw FROM t""")
def model_answers(spark, d):
    """A model's answers to every turn of the conversations, with what became of each row."""
    turns = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.col("text").alias("prompt"))
    return inference.proposer("toy_answers", toy_answers)(turns).select("conv_id", "turn", "status", "raw")


_TEMPLATES = ", ".join(f"('{n}', '{m}')" for n, _, _ in sinks.TEMPLATES for m in ("bluepages", "whitepages"))


@query(_with(_ISSUES + f""", seeds AS (SELECT doc_id, doc_id || ':' || s || ':' || code AS seed_id, suggestion FROM issues WHERE suggestion IS NOT NULL),
g AS (SELECT doc_id, (row_number() OVER (ORDER BY sha256('7:' || doc_id)) - 1) % 10 AS r FROM (SELECT DISTINCT doc_id FROM seeds))
SELECT seed_id, template, mode, CASE r WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split, suggestion AS proposed,
row_number() OVER (ORDER BY sha256('7:' || seed_id || '|' || template || '|' || mode)) - 1 AS position FROM seeds JOIN g USING (doc_id), (VALUES {_TEMPLATES}) t(template, mode)"""))
def training_order(spark, d):
    """Training records of every edit that the rules suggest for the briefs: templates, modes, splits by brief and a seeded order."""
    found = lint.suggestion_rows(briefs(spark, d))
    key = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("start").cast("string"), "code")
    seeds = found.select(key.alias("seed_id"), F.col("original").alias("citation"), F.col("suggestion").alias("proposed"), F.lit("case").alias("source_type"), F.col("code").alias("issue_code"), F.col("doc_id").alias("group")).persist()  # read for the splits and for the places
    made = sinks.training_set(seeds, "7")
    proposed = F.get_json_object(F.col("messages")[1]["content"], "$.proposed_citation")
    return made.select("seed_id", "template", "mode", "split", proposed.alias("proposed"), "position")


_CLAUSES = "concat('Plain words first. Alpha ', repeat(concat('see 42 USC §', o_orderkey % 90 + 10, '; '), cast(o_custkey % 4 AS int)), 'and no more', CASE WHEN o_orderkey % 3 = 0 THEN '; 14 USC §9' ELSE '' END, '. Next; with a pause.')"


@query("""WITH t AS (SELECT o_orderkey AS doc_id, o_custkey % 4 AS n, 'see 42 USC §' || (o_orderkey % 90 + 10) AS c, o_orderkey % 3 = 0 AS last FROM orders),
x AS (SELECT doc_id, i AS clause, CASE WHEN i = 0 THEN 19 ELSE 25 + i * (length(c) + 2) END AS start, CASE WHEN i = 0 THEN 'Alpha ' ELSE '' END || c AS text FROM t, range(4) r(i) WHERE i < n
UNION ALL SELECT doc_id, n + 1, 25 + n * (length(c) + 2) + length('and no more; '), '14 USC §9.' FROM t WHERE last)
SELECT doc_id, 1::BIGINT AS sentence, clause::BIGINT AS clause, start::BIGINT AS start, (start + length(text))::BIGINT AS "end", text FROM x""")
def citation_clauses(spark, d):
    """Clauses with citations in sentences of none to five of them."""
    docs = orders(spark, d).select(F.col("o_orderkey").alias("doc_id"), F.expr(_CLAUSES).alias("text"))
    return blocks.clause_rows(docs).select("doc_id", "sentence", "clause", "start", "end", "text")


@query("""WITH o AS (SELECT *, o_orderkey % 4 AS kind, 'T' || o_custkey AS t, cast(o_orderkey AS VARCHAR) AS n, o_custkey % 3 = 0 AS more, o_orderkey % 7 = 0 AS lacks, 1990 + o_orderkey % 30 AS y FROM orders)
SELECT o_orderkey, CASE WHEN lacks THEN 'missing_facts' ELSE 'ok' END AS status, CASE WHEN lacks THEN NULL WHEN kind = 0 THEN 'Brief of ' || t || ', ' || t || ' v. State, No. ' || n || CASE WHEN more THEN ', ECF No. ' || (o_custkey % 50) ELSE '' END || ' (D. Or. ' || y || ')'
WHEN kind = 1 THEN 'Model ' || n || ' (' || t || '), ' || CASE WHEN more THEN 'On ' || t ELSE 'Response to author query' END || ' (' || y || ')' || CASE WHEN more THEN ', https://kept.example/' || n ELSE ' (on file with author)' END
WHEN kind = 2 THEN t || ', Letter ' || n || CASE WHEN more THEN ', ' || (o_custkey % 50) ELSE '' END || ' (' || y || ') (on file with ' || 'City Archive' || CASE WHEN more THEN ', Box ' || n ELSE '' END || ')'
ELSE CASE WHEN more THEN t || ', ' ELSE '' END || 'Page ' || n || ', ' || t || '.org (' || y || '), https://x.example/' || n END AS citation FROM o""")
def formatted_sources(spark, d):
    """Filings, answers of models, archive papers and pages, with and without their optional facts; a seventh lacks the title or model."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    k, t, n = F.col("o_orderkey"), F.concat(F.lit("T"), F.col("o_custkey").cast("string")), F.col("o_orderkey").cast("string")
    more, lacks, y, place = F.col("o_custkey") % 3 == 0, k % 7 == 0, (1990 + k % 30).cast("string"), (F.col("o_custkey") % 50).cast("string")
    of = lambda **facts: F.map_filter(F.create_map(*[x for a, b in facts.items() for x in (F.lit(a), b)]), lambda _, v: v.isNotNull())
    say, need, maybe = (lambda a, x: F.concat(F.lit(a), x)), (lambda x: F.when(~lacks, x)), (lambda x: F.when(more, x))
    filing = of(document_title=need(say("Brief of ", t)), case_name=F.concat(t, F.lit(" v. State")), docket_number=n, docket_entry=maybe(place), court=F.lit("D. Or."), date=y)
    answer = of(model=need(say("Model ", n)), provider=t, prompt_title=maybe(say("On ", t)), date=y, archive_url=maybe(say("https://kept.example/", n)), on_file_with_author=F.lit("yes"))
    paper = of(author=t, document_title=need(say("Letter ", n)), pincite=maybe(place), date=y, archive=F.lit("City Archive"), location=maybe(say("Box ", n)))
    page = of(author=maybe(t), title=need(say("Page ", n)), site=F.concat(t, F.lit(".org")), date=y, url=say("https://x.example/", n))
    kind = F.element_at(F.array(*map(F.lit, ("court_document", "ai_content", "archival", "internet"))), (k % 4 + 1).cast("int"))
    facts = F.when(k % 4 == 0, filing).when(k % 4 == 1, answer).when(k % 4 == 2, paper).otherwise(page)
    return formats.generate(o.select("o_orderkey", kind.alias("source_type"), facts.alias("fields"))).select("o_orderkey", "status", "citation")


@query("""WITH m AS (SELECT s_suppkey, 0.95 + (s_suppkey % 7) / 100.0 AS f, 0.96 + (s_suppkey % 5) / 100.0 AS a, 0.92 + (s_suppkey % 11) / 100.0 AS r FROM supplier)
SELECT s_suppkey, array_to_string(list_filter([CASE WHEN f < 0.985 THEN 'document_structure_or_parsing:deterministic_engine' END, CASE WHEN a < 0.985 THEN 'authority_identity:citation_graph' END,
CASE WHEN r < 0.945 THEN 'retrieval:reference_library' END, 'proposal_generation:qwen_adapter'], lambda x: x IS NOT NULL), ' ') AS failures, true AS retraining_recommended FROM m""")
def failure_classes(spark, d):
    """What the failures of each supplier's made-up metrics are put down to."""
    k = F.col("s_suppkey")
    metrics = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", (0.955 + (k % 7) / 100).alias("citation_span_f1"), (0.965 + (k % 5) / 100).alias("authority_identity_accuracy"), (0.925 + (k % 11) / 100).alias("retrieval_recall_at_k"))
    out = scoring.failure_taxonomy(metrics, 0.9, keep=["s_suppkey"])
    return out.select("s_suppkey", F.array_join(F.transform("failures", lambda f: F.concat(f["class"], F.lit(":"), f["owner"])), " ").alias("failures"), "retraining_recommended")
