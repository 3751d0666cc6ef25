"""The citation graph: occurrences, authorities, edges and antecedents.

Everything that needs the text is computed in-row and kept as small facts per
occurrence. From there on the graph is windows and equi-joins keyed by
``doc_id``, with one shuffle of small rows; authorities are named by a hash of
what identifies them, so they can be joined across documents.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.spans import below, hit, in_order, let, named, pieces, rows_of, spans, there, within
from ..functions.tables import squeezed
from ..sources.blocks import with_blocks
from .extract import neutralize, with_citations

OCC = "struct<start:int,end:int,text:string,source_type:string,form:string,components:map<string,string>>"
FAR = 2147483647
#: What can be asked for about an occurrence's surroundings: where its sentence and clause end, the gap to the one before, the
#: texts at both sides, and those of its block (what stands beside an article is always worked out).
SURROUNDINGS = ("breaks", "gap", "near", "beside")


def norm(value: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)\s+", " ")))


def _occ(s: Column, source_type: str, form: str, components: Column) -> Column:
    return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), F.lit(source_type).alias("source_type"), F.lit(form).alias("form"), components.alias("components")).cast(OCC)


def _asked(surroundings: bool | Iterable[str]) -> set[str]:
    asked = set(SURROUNDINGS if surroundings is True else surroundings or ())
    if not asked <= set(SURROUNDINGS):
        raise ValueError(f"surroundings must be of {SURROUNDINGS}")
    return asked


def holding(docs: DataFrame, *any_of: P.Pattern, text_col: str = "text") -> DataFrame:
    """The documents whose text can hold a match of one of the patterns: the others have no row of a query that asks for such occurrences alone.

    The test is what every match fulfils, so it drops no match; each text that stays is worked on whole.
    """
    t = neutralize(F.coalesce(F.col(text_col), F.lit("")))
    return docs.where(reduce(Column.__or__, [F.lit(True) if there(t, p) is None else there(t, p) for p in any_of]))


def with_occurrences(docs: DataFrame, text_col: str = "text", surroundings: bool | Iterable[str] = True) -> DataFrame:
    """``docs`` with ``occurrences``: full citations and short forms with facts about their surroundings, in logical order.

    A citation in a note stands where the note is referred to. Without ``surroundings`` only what identifies an
    authority is worked out, and texts beside articles alone: fields that are made inside a lambda are not pruned by Catalyst.
    Some of SURROUNDINGS may be asked for by name.
    """
    asked = _asked(surroundings)
    df = with_blocks(docs if "citations" in docs.columns else with_citations(docs, text_col), text_col).withColumn("__t", neutralize(F.coalesce(F.col(text_col), F.lit(""))))
    t = F.col("__t")
    full = F.transform(F.filter("citations", lambda c: c["source_type"] != "short_form"), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["text"].alias("text"), c["source_type"].alias("source_type"), F.lit("full").alias("form"), c["components"].alias("components")).cast(OCC))
    df = df.withColumn("__acc", full)
    free = lambda new, held: let(held, lambda x: F.filter(new, lambda c: ~hit(x, c["start"], c["end"])))
    for p, kind, form in ((P.SUPRA_NOTE, "short_form", "supra_note"), (P.SHORT_CASE, "case", "short_case"), (P.ID_FORM, "short_form", "id"), (P.SUPRA, "short_form", "supra")):
        build = (lambda p, kind, form: lambda s: _occ(s, kind, form, named(s, p)))(p, kind, form)
        df = df.withColumn("__new", F.transform(spans(t, p, groups=bool(p.parts)), build))
        df = df.withColumn("__acc", F.when(F.size("__new") > 0, F.concat("__acc", free(F.col("__new"), in_order(F.col("__acc"))))).otherwise(F.col("__acc")))
    # Section symbols short for a statute cited in full somewhere in the text; these don't occupy their place.
    sections = F.transform(F.filter("__acc", lambda a: a["source_type"].isin("statute", "regulation") & (a["form"] == "full")), lambda a: norm(a["components"]["section"]))
    df = df.withColumns({"__sections": F.sort_array(F.array_distinct(sections)), "__held": in_order(F.col("__acc")), "__new": F.transform(spans(t, P.STATUTORY_SHORT, groups=True), lambda s: _occ(s, "statute", "statutory_short", named(s, P.STATUTORY_SHORT)))})
    is_known = lambda known, x: F.coalesce(F.try_element_at(known, below(known, x) + 1) == x, F.lit(False))
    short = let(F.col("__sections"), lambda known: F.filter(free(F.col("__new"), F.col("__held")), lambda c: is_known(known, norm(c["components"]["section"]))))
    df = df.withColumn("__short", F.when((F.size("__new") > 0) & (F.size("__sections") > 0), short).otherwise(F.array().cast(f"array<{OCC}>")))
    # Aliases, from their definition on.
    df = df.withColumn("definitions", F.transform(spans(t, P.HEREINAFTER), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.regexp_extract(s["text"], P.HEREINAFTER.regex, 1).alias("alias"))))

    def uses(d):
        found = spans(t, F.concat(F.lit(r"(?U)\b\Q"), d["alias"], F.lit(r"\E\b")))
        return F.transform(F.filter(found, lambda s: s["start"] >= d["end"]), lambda s: _occ(s, "short_form", "hereinafter", F.create_map(F.lit("alias"), d["alias"])))

    # What one alias has taken is not free for the next one's uses.
    empty = F.array().cast(f"array<{OCC}>")
    alias = F.aggregate("definitions", F.struct(F.col("__held").alias("held"), empty.alias("out")), lambda acc, d: let(free(uses(d), acc["held"]), lambda new: F.struct(F.array_sort(F.concat(acc["held"], F.transform(new, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"))))).alias("held"), F.concat(acc["out"], new).alias("out"))), lambda acc: acc["out"])
    df = df.withColumn("__acc", F.concat("__acc", "__short", F.when(F.size("definitions") > 0, alias).otherwise(empty)))
    breaks, semis = F.array().cast("array<struct<start:int,end:int>>"), F.array().cast("array<int>")
    if "breaks" in asked:
        breaks = F.transform(spans(t, P.Pattern(P.GAP_SENTENCE_BREAK)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
        semis = F.transform(spans(t, P.Pattern(";")), lambda s: s["start"])
    df = df.withColumn("__breaks", breaks).withColumn("__semis", semis)

    # What a lambda's body names twice is worked out twice, so blocks, markers and moves are bound once each.
    # Blocks lie apart and in order: only the last one that begins before an occurrence can hold it.
    df = df.withColumn("__refs", F.sort_array(F.transform("references", lambda r: F.struct(r["note_id"].alias("note_id"), r["start"].alias("start")))))

    def place(o, blocks, refs):
        lead = F.length(F.regexp_extract(o["text"], r"(?U)\A\s*", 0))
        start = o["start"]

        def inside(first):
            last = let(below(blocks, first + 1, "start"), lambda k: F.when(k > 0, F.try_element_at(blocks, F.greatest(k, F.lit(1)))))
            return let(last, lambda b: F.when((first < b["end"]) & (o["end"] <= b["end"]), b))

        def put(at):
            marker = F.when(at["note_id"].isNotNull(), let(F.try_element_at(refs, below(refs, at["note_id"], "note_id") + 1), lambda r: F.when(r["note_id"] == at["note_id"], r["start"])))
            moved = lambda m: F.struct(F.coalesce(m, start).alias("k0"), m.isNotNull().cast("int").alias("k1"), F.when(m.isNotNull(), start - at["start"]).otherwise(F.lit(0)).alias("k2"))
            rest = [start.alias("start"), o["end"].alias("end"), *[o[n].alias(n) for n in ("text", "source_type", "form", "components")], at["block_id"].alias("block_id"), at["start"].alias("block_start"), at["end"].alias("block_end"), at["note_id"].alias("note_id"), at["note_number"].alias("note_number")]
            return let(let(marker, moved), lambda k: F.struct(*[k[n].alias(n) for n in ("k0", "k1", "k2")], *rest))

        return let(let(start + lead, inside), put)

    # Maps can't be compared, so the order goes by the five numbers alone, and each finds its occurrence again.
    def ordered(all_):
        keys = F.transform(all_, lambda a, i: F.struct(*[a[n].alias(n) for n in ("k0", "k1", "k2", "start", "end")], i.alias("i")))
        return F.when(F.size(all_) > 1, F.transform(F.sort_array(keys), lambda k: F.get(all_, k["i"]))).otherwise(all_)

    around = F.struct(F.transform("blocks", lambda b: F.struct(*[b[n].alias(n) for n in ("start", "end", "block_id", "note_id", "note_number")])).alias("blocks"), F.col("__refs").alias("refs"))
    df = df.withColumn("__placed", let(around, lambda x: F.transform("__acc", lambda o: place(o, x["blocks"], x["refs"])))).withColumn("__placed", let(F.col("__placed"), ordered))

    def facts(o, i, x):
        breaks, semis, cut = x["breaks"], x["semis"], x["cut"]
        about = lambda value: value if "beside" in asked else F.when(o["source_type"] == "journal_article", value)
        prev = F.try_element_at(x["placed"], F.greatest(i, F.lit(1)))
        gap = F.when(i > 0, within(cut, prev["end"], o["start"])).otherwise(F.lit(""))
        low = F.when(o["block_start"].isNotNull(), F.greatest(o["block_start"], o["start"] - 180)).otherwise(o["start"])
        high = F.when(o["block_end"].isNotNull(), F.least(o["block_end"], o["end"] + 30)).otherwise(o["end"])
        return F.struct(
            *[o[n].alias(n) for n in ("start", "end", "text", "source_type", "form", "components", "block_id", "note_id", "note_number")],
            *([F.coalesce(F.try_element_at(breaks, below(breaks, o["end"], "start") + 1)["end"], F.lit(FAR)).alias("break_end"),
            F.coalesce(F.try_element_at(semis, below(semis, o["end"]) + 1), F.lit(FAR)).alias("semicolon")] if "breaks" in asked else []),
            *([gap.alias("gap")] if "gap" in asked else []),
            *([within(cut, o["start"] - 260, o["start"]).alias("lead"), within(cut, o["end"], o["end"] + 180).alias("tail")] if "near" in asked else []),
            about(within(cut, low, o["start"])).alias("block_lead"), about(within(cut, o["end"], high)).alias("block_tail"),
        )

    bound = F.struct(F.col("__breaks").alias("breaks"), F.col("__semis").alias("semis"), F.col("__placed").alias("placed"), pieces(t).alias("cut"))
    df = df.withColumn("occurrences", let(bound, lambda x: F.transform(x["placed"], lambda o, i: facts(o, i, x))))
    return df.drop(*[c for c in df.columns if c.startswith("__")])


def _key(o: DataFrame) -> tuple[Column, Column]:
    """What identifies a full citation's authority (an array), and its display name."""
    c = lambda n: F.col("components")[n]
    first = lambda *names: F.coalesce(*[F.nullif(c(n), F.lit("")) for n in names])
    case = F.array(norm(c("case_name")), norm(c("volume")), squeezed(F.coalesce(c("reporter"), F.lit(""))), norm(first("first_page", "page")))
    law = F.array(F.lit("us"), norm(c("code")), norm(c("title")), norm(c("section")), norm(c("edition")))
    journal = F.array(norm(F.col("author")), norm(F.col("title")), norm(c("journal")), norm(c("volume")), norm(c("page")), norm(F.col("year")))
    net = F.array(norm(F.col("text")), F.lit(""), F.lit(""))
    rest = F.transform(F.array_sort(F.map_keys("components")), lambda k: norm(F.element_at("components", k)))
    kind = F.col("source_type")
    key = F.when(kind == "case", case).when(kind.isin("statute", "regulation"), law).when(kind == "journal_article", journal).when(kind == "internet", net).otherwise(rest)
    low = F.array_join(key, "") == ""
    key = F.when(low, F.array(norm(F.col("text")), F.col("ord").cast("string"))).otherwise(key)
    display = F.when(kind == "case", F.coalesce(c("case_name"), F.col("text"))).when(kind == "journal_article", F.coalesce(F.nullif("title", F.lit("")), F.nullif("author", F.lit("")), F.col("text"))).otherwise(F.col("text"))
    return key, display


def _article(rows: DataFrame) -> list[Column]:
    return [F.regexp_extract("block_lead", P.ARTICLE_BEFORE, 1).alias("author"), F.regexp_extract("block_lead", P.ARTICLE_BEFORE, 2).alias("title"), F.regexp_extract("block_tail", P.YEAR_AFTER, 1).alias("year")]


def _facts(rows: DataFrame, asked: set[str]) -> DataFrame:
    """What the surroundings of each occurrence say, as flags and short strings; the surroundings themselves go."""
    of = lambda name, *facts: facts if name in asked else ()
    gap, lead, tail = F.col("gap"), F.col("lead"), F.col("tail")
    last = lambda n: F.substring(lead, F.greatest(F.length(lead) - n, F.lit(0)) + 1, F.lit(n))
    near = F.lower(F.concat(last(120), F.col("text"), tail))
    bare = F.regexp_replace(tail, r"(?U)^\s+", "")
    return rows.select(
        "doc_id", "ord", "start", "end", "text", "source_type", "form", "components", "block_id", "note_id", "note_number", *of("breaks", "break_end", "semicolon"),
        *of("gap", F.contains(gap, F.lit(";")).alias("gap_clause"), F.rlike(gap, F.lit(P.GAP_AUTHORITY)).alias("gap_authority"), F.contains(gap, F.lit("\n\n")).alias("gap_paragraph"),
        (~F.rlike(gap, F.lit(P.GAP_SENTENCE_BREAK)) & ~F.rlike(gap, F.lit(P.GAP_WORD))).alias("gap_clean"), F.rlike(gap, F.lit(r"(?U)^\s*,\s*\z")).alias("gap_comma")),
        *of("near", F.regexp_extract(last(24), P.EDGE_SIGNAL, 1).alias("signal"), F.rlike(last(180), F.lit(P.EDGE_QUOTE)).alias("quote_before"), F.rlike(tail, F.lit(P.EDGE_PARENTHETICAL)).alias("paren_after")),
        *_article(rows),
        *of("near", F.contains(F.trim(F.regexp_extract(lead, P.QUOTED_BEFORE, 1)), F.lit(" ")).alias("quotes_words"), (F.contains(near, F.lit("perma.cc")) | F.contains(near, F.lit("on file with author"))).alias("archived"),
        (F.length(tail) - F.length(bare)).alias("paren_gap"), bare.startswith("(").alias("paren_open")),
    )


def occurrences(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", surroundings: bool | Iterable[str] = True) -> DataFrame:
    """A row per occurrence: doc_id, ord (logical order), its facts, authority_id (of full citations), display, identity.

    Without ``surroundings`` the facts that edges and antecedents need are left out; some of SURROUNDINGS may be asked for by name.
    """
    return occurrence_rows(with_occurrences(docs, text_col, surroundings), id_col, surroundings)


def occurrence_rows(facts: DataFrame, id_col: str = "doc_id", surroundings: bool | Iterable[str] = True) -> DataFrame:
    """The rows of ``occurrences`` from texts that ``with_occurrences`` has parsed already."""
    rows = rows_of(facts, "occurrences", F.col(id_col).alias("doc_id"), at="ord")
    rows = _facts(rows, _asked(surroundings))
    key, display = _key(rows)
    full = F.col("form") == "full"
    rows = rows.withColumn("identity", F.when(full, key)).withColumn("display", F.when(full, display))
    name = named_by(F.col("source_type"), F.concat_ws("\x1f", F.col("source_type"), F.array_join("identity", "\x1f")))
    return rows.withColumn("authority_id", F.when(full, name))


def cited(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row per full citation: doc_id, source_type, key (a string of what identifies its authority, see ``named_by``).

    The same authorities as those of ``occurrences``, without the order and the short forms: these change no full citation. Blocks
    are looked for in texts with an article alone.
    """
    df = docs if "citations" in docs.columns else with_citations(docs, text_col)
    article = lambda c: c["source_type"] == "journal_article"
    df = with_blocks(df.withColumn("__at", F.when(F.exists("citations", article), F.coalesce(F.col(text_col), F.lit("")))), "__at").withColumn("__cut", pieces(neutralize(F.col("__at"))))

    def beside(c, x):
        inside = let(below(x["blocks"], c["start"] + 1, "start"), lambda k: F.when(k > 0, F.try_element_at(x["blocks"], F.greatest(k, F.lit(1)))))
        texts = lambda low, high: F.struct(within(x["cut"], low, c["start"]).alias("block_lead"), within(x["cut"], c["end"], high).alias("block_tail"))
        return let(inside, lambda b: F.when((c["start"] < b["end"]) & (c["end"] <= b["end"]), texts(F.greatest(b["start"], c["start"] - 180), F.least(b["end"], c["end"] + 30))))

    around = F.struct(F.transform("blocks", lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"))).alias("blocks"), F.col("__cut").alias("cut"))
    sides = F.when(F.col("__at").isNotNull(), let(around, lambda x: F.transform("citations", lambda c: F.when(article(c), beside(c, x)))))
    df = df.select(F.col(id_col).alias("doc_id"), "citations", sides.alias("__sides"))
    rows = df.select("doc_id", F.posexplode_outer("citations").alias("ord", "c"), "__sides").where("c.source_type != 'short_form'")
    side = F.get("__sides", F.col("ord"))
    rows = rows.select("doc_id", "ord", "c.text", "c.source_type", "c.components", *[F.coalesce(side[n], F.lit("")).alias(n) for n in ("block_lead", "block_tail")])
    rows = rows.select("*", *_article(rows))
    return rows.select("doc_id", "source_type", F.concat_ws("\x1f", "source_type", F.array_join(_key(rows)[0], "\x1f")).alias("key"))


def named_by(source_type: Column, key: Column) -> Column:
    """An authority's name."""
    return F.concat(F.lit("authority:"), source_type, F.lit(":"), F.substring(F.sha2(key, 256), 1, 16))


def top_cited(docs: DataFrame, n: int) -> DataFrame:
    """The authorities cited most: authority_id, n_occurrences. Counted by what identifies them, and named when counted."""
    rows = cited(docs).groupBy("source_type", "key").agg(F.count("*").alias("n"))
    total = rows.groupBy(named_by(F.col("source_type"), F.col("key")).alias("authority_id")).agg(F.sum("n").alias("n_occurrences"))
    return total.orderBy(F.desc("n_occurrences"), "authority_id").limit(n)


def authorities(occ: DataFrame) -> DataFrame:
    """An authority of a document by its first full citation: doc_id, authority_id, source_type, display, n_occurrences, first_ord."""
    return occ.where("form = 'full'").groupBy("doc_id", "authority_id").agg(F.first("source_type").alias("source_type"), F.min_by("display", "ord").alias("display"), F.count("*").alias("n_occurrences"), F.min("ord").alias("first_ord"))


def authority_frequency(occ: DataFrame) -> DataFrame:
    """Over all documents: authority_id, source_type, n_documents, n_occurrences."""
    return authorities(occ).groupBy("authority_id", "source_type").agg(F.count("*").alias("n_documents"), F.sum("n_occurrences").alias("n_occurrences"))


def resources(occ: DataFrame) -> DataFrame:
    """doc_id, ord, resource_id: full citations of one authority are one resource, numbered by where its first begins."""
    full = occ.where("form = 'full'").select("doc_id", "ord", "start", "authority_id")
    first = full.withColumn("at", F.min("start").over(Window.partitionBy("doc_id", "authority_id")))
    rank = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("at"))
    return first.select("doc_id", "ord", F.concat(F.lit("resource-"), rank).alias("resource_id"))


def cocitation(occ: DataFrame, most: int = 256) -> DataFrame:
    """Pairs of authorities and the number of documents that cite both.

    A document's authorities are one sorted array; each row pairs a run of ``most`` of them with the rest of the array, so
    one document's pairs spread over rows and are summed in part before the shuffle. The pairs themselves grow with the square of the
    authorities a document cites.
    """
    a = occ.where("form = 'full'").groupBy("doc_id").agg(F.array_sort(F.collect_set("authority_id")).alias("a"))
    runs = a.select("a", F.explode(F.sequence(F.lit(0), F.floor((F.size("a") - 1) / most).cast("int"))).alias("run"))
    left = runs.select("a", F.posexplode(F.slice("a", F.col("run") * most + 1, F.lit(most))).alias("i", "left_id"), "run")
    pairs = left.select("left_id", F.explode(F.slice("a", F.col("run") * most + F.col("i") + 2, F.size("a"))).alias("right_id"))
    return pairs.groupBy("left_id", "right_id").agg(F.count("*").alias("n_documents"))


def neighbour_edges(occ: DataFrame) -> DataFrame:
    """prior_occurrence, later_occurrence, immediately_preceding_occurrence and full_citation_to_authority."""
    same = Window.partitionBy("doc_id", "authority_id").orderBy("ord")
    me, full, before_ = F.col("ord").cast("string"), F.col("form") == "full", F.col("ord") > 0
    # The edges of an occurrence come from its row alone, so the occurrences are worked out once; only full citations have an authority.
    prev = F.when(full, F.lag("ord").over(same)).cast("string")
    edge = lambda there, kind, a, b: F.when(there, F.struct(F.lit(kind).alias("edge_type"), a.alias("source"), b.alias("target")))
    rows = occ.select("doc_id", "ord", "form", "authority_id").withColumn("prev", prev)
    there = F.col("prev").isNotNull()
    edges = F.array_compact(F.array(
        edge(full, "full_citation_to_authority", me, F.col("authority_id")),
        edge(there, "prior_occurrence", me, F.col("prev")),
        edge(there, "later_occurrence", F.col("prev"), me),
        edge(before_, "immediately_preceding_occurrence", me, (F.col("ord") - 1).cast("string")),
    ))
    return rows.select("doc_id", F.explode(edges).alias("e")).select("doc_id", "e.*")


def sentence_edges(occ: DataFrame) -> DataFrame:
    """same_citation_sentence and same_citation_clause: a semicolon and no sentence break between two occurrences (in text order).

    What an occurrence is joined with stands in one run of a document's occurrences in text order: it
    begins behind its semicolon and ends at the next sentence break. Both ends are found by binary
    search in the sorted starts, so the work is n log n and the edges.
    """
    x = F.struct("start", "ord", "semicolon", "break_end")
    docs = occ.groupBy("doc_id").agg(F.array_sort(F.collect_list(x)).alias("x"), F.array_sort(F.collect_list("start")).alias("starts"), F.bool_or(F.col("semicolon") < F.col("break_end")).alias("some")).where("some")
    bits = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])

    def below(at: Column) -> Column:
        """How many starts lie below a place."""
        return F.aggregate(bits, F.lit(0), lambda n, step: F.when(F.coalesce(F.try_element_at(F.col("starts"), n + step) < at, F.lit(False)), n + step).otherwise(n))

    def edges(o):
        low = below(F.greatest(o["semicolon"], o["start"]) + 1)
        run = F.slice(F.col("x"), low + 1, F.greatest(below(o["break_end"]) - low, F.lit(0)))
        return F.transform(F.filter(run, lambda t: t["ord"] != o["ord"]), lambda t: F.struct(o["ord"].alias("source"), t["ord"].alias("target")))

    found = F.flatten(F.transform(F.filter("x", lambda o: o["semicolon"] < o["break_end"]), edges))
    pairs = docs.select("doc_id", F.explode_outer(found).alias("e")).where("e is not null")
    return pairs.select("doc_id", F.explode(F.array(F.lit("same_citation_sentence"), F.lit("same_citation_clause"))).alias("edge_type"), F.col("e.source").cast("string").alias("source"), F.col("e.target").cast("string").alias("target"))


def note_edges(occ: DataFrame) -> DataFrame:
    """same_footnote: every two occurrences of one note, in logical order (all pairs, by definition; a note bounds them)."""
    a = occ.where("note_id is not null").select("doc_id", "note_id", F.col("ord").alias("source"))
    return a.join(a.withColumnRenamed("source", "target"), ["doc_id", "note_id"]).where("source < target").select("doc_id", F.lit("same_footnote").alias("edge_type"), F.col("source").cast("string"), F.col("target").cast("string"))


def context_edges(occ: DataFrame) -> DataFrame:
    """Signals, quotations and parentheticals beside an occurrence."""
    me, to = F.col("ord").cast("string"), F.coalesce("authority_id", F.col("ord").cast("string"))
    kinds = F.filter(F.array(
        F.when(F.col("signal") != "", F.struct(F.lit("signal_linked_to_citation_group").alias("edge_type"), me.alias("target"))),
        F.when(F.col("quote_before"), F.struct(F.lit("quotation_linked_to_authority").alias("edge_type"), to.alias("target"))),
        F.when(F.col("paren_after"), F.struct(F.lit("parenthetical_linked_to_authority").alias("edge_type"), to.alias("target"))),
    ), lambda x: x.isNotNull())
    return occ.select("doc_id", me.alias("source"), F.explode(kinds).alias("k")).select("doc_id", "k.edge_type", "source", "k.target")
