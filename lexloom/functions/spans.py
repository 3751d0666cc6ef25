"""Matches of a pattern with code-point offsets, as Catalyst expressions.

The pieces between matches (``split``) and the matches (``regexp_extract_all``)
alternate, so running sums of their lengths are the offsets. Lengths count code
points. No Python runs per row.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .patterns import Pattern

SPAN = "struct<start:int,end:int,text:string>"
#: Matches that are summed up at a time.
RUN = 64
#: Code points in a piece of a text that is cut once, so that a short part of it needn't be looked for from its beginning.
PIECE = 1024


def written(function: str, *args: Column | str) -> Column:
    """A call of a SQL function; a string is a SQL lambda over the function's own variables.

    A lambda that needs no other Column is written as text where it is used often: building an
    expression node by node from Python takes longer than most texts take to parse.
    """
    return F.call_function(function, *[F.expr(x) if isinstance(x, str) else x for x in args])


def bound(body: str, **values: Column) -> Column:
    """``body`` (SQL) over ``x``, a struct of the values, each worked out once."""
    one = F.call_function("named_struct", *[c for k, v in values.items() for c in (F.lit(k), v)])
    return F.element_at(written("transform", F.array(one), f"x -> {body}"), 1)


#: A character that no text should hold: around a match and each of its parts. A text with it is cut by the pattern itself.
MARK = "\uffff"
_STEP = "(g, m) -> named_struct('gap', length(g), 'len', length(m), 'text', m)"


def _placed(fields: str = "", kind: str = "") -> str:
    """SQL: the spans of ``steps``, with further ``fields`` of them.

    Appending copies an array, so many matches are summed up in runs, and the runs among themselves.
    """
    span = f"struct<start:int,end:int,text:string{kind}>"
    summed = """aggregate({steps}, named_struct('at', 0, 'out', cast(array() as array<%s>)),
      (acc, x) -> named_struct('at', acc.at + x.gap + x.len, 'out', concat(acc.out, array(named_struct('start', acc.at + x.gap, 'end', acc.at + x.gap + x.len, 'text', x.text%s)))){last})""" % (span, fields)
    return f"""if(size(steps) <= {RUN}, {summed.format(steps="steps", last=", acc -> acc.out")}, aggregate(
      transform(sequence(0, cast(floor((size(steps) - 1) / {RUN}) as int)), k -> {summed.format(steps=f"slice(steps, k * {RUN} + 1, {RUN})", last="")}),
      named_struct('at', 0, 'out', cast(array() as array<array<{span}>>)),
      (acc, r) -> named_struct('at', acc.at + r.at, 'out', concat(acc.out, array(transform(r.out, x -> named_struct('start', x.start + acc.at, 'end', x.end + acc.at, 'text', x.text{fields}))))),
      acc -> flatten(acc.out)))"""


def any_of(text: Column, strings) -> Column | None:
    """Does the text hold one of the strings: no pattern, and the text stays as it is stored."""
    out = None
    for x in strings:
        out = F.contains(text, F.lit(x)) if out is None else out | F.contains(text, F.lit(x))
    return out


def there(text: Column, p: Pattern) -> Column | None:
    """A cheap condition that every text with a match fulfils, if the pattern names one."""
    out = any_of(text, p.any_of)
    if p.needs:
        plain = not re.match(r"\(\?[a-zA-Z]*i", p.regex) or not re.search("[a-z]", p.needs)
        seen = F.contains(text, F.lit(p.needs)) if plain else F.rlike(text, F.lit(f"(?iu){re.escape(p.needs)}"))
        out = seen if out is None else out & seen
    if p.hint:
        seen = F.rlike(text, F.lit(p.hint))
        out = seen if out is None else out & seen
    return out


def _numbers(p: Pattern | Column, groups: bool | Sequence[str]) -> list[int]:
    """The numbers of the groups asked for: all, none, or those of some parts."""
    names = p.parts if groups is True else groups or ()
    return [p.parts.index(n) + 1 for n in names]


def _spelled(cut: str, n: int, groups: bool) -> tuple[str, str]:
    """SQL: the spans of a text that is cut at its marks, if there is one match, and if there are more."""
    fields, kind = (", 'groups', x.groups", ",groups:array<string>") if groups else ("", "")
    # The pieces come in turns: what lies before a match, the match, its parts.
    turn = n + 2
    part = lambda at: f", 'groups', slice({cut}, {at}, {n})" if groups else ""
    one = f"array(named_struct('start', length({cut}[0]), 'end', length({cut}[0]) + length({cut}[1]), 'text', {cut}[1]{part(3)}))"
    steps = f"transform(sequence(0, cast(size({cut}) / {turn} as int) - 1), i -> named_struct('gap', length({cut}[i * {turn}]), 'len', length({cut}[i * {turn} + 1]), 'text', {cut}[i * {turn} + 1]{part(f'i * {turn} + 3')}))"
    return one, f"element_at(transform(array({steps}), steps -> {_placed(fields, kind)}), 1)"


def _split(text: Column, regex: Column, numbers: list[int]) -> Column:
    """The text cut at marks around its matches and their groups: one piece if there is no match."""
    marks = MARK + "$0" + "".join(f"{MARK}${i}" for i in numbers) + MARK
    return F.call_function("split", F.regexp_replace(text, regex, F.lit(marks)), F.lit(MARK), F.lit(-1))


def _summed(text: Column, regex: Column, numbers: list[int] | None) -> Column:
    """Spans of a text that holds the mark itself: cut by the pattern."""
    fields, kind = (", 'groups', x.groups", ",groups:array<string>") if numbers is not None else ("", "")
    found = F.regexp_extract_all(text, regex, F.lit(0))
    gaps = F.slice(F.call_function("split", text, regex, F.lit(-1)), 1, F.size(found))
    if numbers is not None:
        groups = lambda m: F.array(*[F.call_function("regexp_extract", m, regex, F.lit(i)) for i in numbers]).cast("array<string>")
        steps = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("len"), m.alias("text"), groups(m).alias("groups")))
    else:
        steps = written("zip_with", gaps, found, _STEP)
    return F.element_at(written("transform", F.array(steps), f"steps -> {_placed(fields, kind)}"), 1)


def spans(text: Column, p: Pattern | Column, groups: bool = False) -> Column:
    """array<struct<start,end,text>>: half-open, from 0, in order. ``p`` may be a column of expressions. With ``groups`` also
    what the parts of the pattern have matched, as an array.

    The text is searched once: matches and their parts are put between marks, and the marks are a literal to split at
    (a regular expression would be compiled anew for each text). Mostly there is one match, whose place needs no sum.
    """
    regex = F.lit(p.regex) if isinstance(p, Pattern) else p
    numbers = _numbers(p, groups)
    none = F.array().cast(f"array<struct<start:int,end:int,text:string{',groups:array<string>' if groups else ''}>>")
    one, many = _spelled("cut", len(numbers), groups)
    quick = F.element_at(written("transform", F.array(_split(text, regex, numbers)), f"cut -> if(size(cut) = 1, null, if(size(cut) = {len(numbers) + 3}, {one}, {many}))"), 1)
    placed = F.when(F.contains(text, F.lit(MARK)), _summed(text, regex, numbers if groups else None)).otherwise(quick)
    hint = there(text, p) if isinstance(p, Pattern) else None
    return F.when(text.isNull() if hint is None else (text.isNull() | ~hint), none).otherwise(F.coalesce(placed, none))


def cut_at(text: Column, odd: Column, p: Pattern, parts: Sequence[str]) -> Column:
    """The first step of ``spans`` with some parts, as a column of its own: the text cut at its matches; null if it has none. ``odd``: does it hold the mark?

    What stands inside a lambda is interpreted. Kept as a column, the search and the places of few matches run as generated code.
    """
    hint = there(text, p)
    return F.when(~odd if hint is None else ~odd & hint, _split(text, F.lit(p.regex), _numbers(p, parts)))


#: As many matches are placed without a loop.
UNROLLED = 3


def spans_at(cut: str, text: Column, odd: Column, p: Pattern, parts: Sequence[str], shape=None) -> Column:
    """The second step: the spans, with ``groups``, from the column that ``cut_at`` has made; null if there is none.

    ``shape``: SQL of a span of another form from that of its start, text and groups.
    """
    shape = shape or (lambda start, text, groups: f"named_struct('start', {start}, 'end', {start} + length({text}), 'text', {text}, 'groups', {groups})")
    n, turn = len(parts), len(parts) + 2
    _, many = _spelled(cut, n, True)
    start = lambda i: " + ".join(f"length({cut}[{q * turn + g}])" for q in range(i + 1) for g in ((0, 1) if q < i else (0,)))
    match = lambda i: shape(start(i), f"{cut}[{i * turn + 1}]", f"slice({cut}, {i * turn + 3}, {n})" if n else "cast(array() as array<string>)")
    few = " ".join(f"WHEN {k * turn + 1} THEN array({', '.join(match(i) for i in range(k))})" for k in range(1, UNROLLED + 1))
    again = f"s -> {shape('s.start', 's.text', 's.groups')}"
    slow = F.when(odd, written("transform", _summed(text, F.lit(p.regex), _numbers(p, parts)), again))
    return F.when(F.col(cut).isNull(), slow).otherwise(F.expr(f"CASE size({cut}) WHEN 1 THEN null {few} ELSE transform({many}, {again}) END"))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once.

    A column that a lambda refers to once is put into the lambda by Catalyst and
    then worked out for every element; a lambda's own variable is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def rows_of(df: DataFrame, array: str, *keep: Column, at: str | None = None) -> DataFrame:
    """A row per element: the kept columns, the position (named ``at``) and the element's fields.

    An outer explode: from an inner one Catalyst infers a filter on the array and
    pushes it down, which repeats the whole in-row computation under the filter.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(at or "__at", "__x")).where(F.col("__x").isNotNull())
    return rows.select(*[c for c in rows.columns if c not in ("__x", "__at")], "__x.*")


def part(text: Column, p: Pattern, name: str) -> Column:
    """A named part of a match's text; an empty string if it took no part."""
    return F.regexp_extract(text, p.regex, p.parts.index(name) + 1)


def parts(text: Column, p: Pattern) -> Column:
    """All parts of a match's text that are not empty, by name."""
    if not p.parts:
        return F.create_map().cast("map<string,string>")
    all_ = F.create_map(*[x for n in p.parts for x in (F.lit(n), part(text, p, n))])
    return written("map_filter", all_, "(k, v) -> v != ''")


def named(s: Column, p: Pattern) -> Column:
    """All parts of a span with ``groups`` that are not empty, by name."""
    if not p.parts:
        return F.create_map().cast("map<string,string>")
    return written("map_filter", F.map_from_arrays(F.array(*[F.lit(n) for n in p.parts]), s["groups"]), "(k, v) -> v != ''")


def strip(x: Column) -> Column:
    """Without white space at both ends (``trim`` takes spaces alone)."""
    return F.regexp_replace(x, r"(?U)\A\s+|\s+\z", "")


def between(text: Column, start: Column, end: Column) -> Column:
    """text[start:end] with both ends inside the text; empty if end <= start."""
    low = F.greatest(start, F.lit(0))
    return F.substring(text, low + 1, F.greatest(end - low, F.lit(0)))


def before(text: Column, at: Column, n: int) -> Column:
    return between(text, at - n, at)


def after(text: Column, at: Column, n: int) -> Column:
    return between(text, at, at + n)


def pieces(text: Column) -> Column:
    """The text in pieces of PIECE code points, for ``within``."""
    return F.when(F.length(text).between(1, PIECE), F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))


_FIRST = f"cast(floor(greatest(x.a, 0) / {PIECE}) as int)"
_WITHIN = f"if(size(x.cut) = 1, substring(x.cut[0], greatest(x.a, 0) + 1, greatest(x.b - greatest(x.a, 0), 0)), substring(array_join(slice(x.cut, {_FIRST} + 1, greatest(cast(floor((x.b - 1) / {PIECE}) as int) - {_FIRST} + 1, 0)), ''), greatest(x.a, 0) - {_FIRST} * {PIECE} + 1, greatest(x.b - greatest(x.a, 0), 0)))"


def within(cut: Column, start: Column, end: Column) -> Column:
    """``between`` on a text in pieces: the work is that of the pieces it lies in, wherever they are."""
    return F.when(F.size(cut) == 1, between(F.get(cut, F.lit(0)), start, end)).otherwise(bound(_WITHIN, cut=cut, a=start, b=end))


#: Elements that are looked through one by one, which takes less than a search.
FEW = 16
#: A binary search in x.held, of fewer than 2^25 elements.
_BELOW = "aggregate(if(size(x.held) < 32, array(16, 8, 4, 2, 1), array(" + ", ".join(str(1 << k) for k in range(24, -1, -1)) + ")), 0, (n, step) -> if(coalesce(try_element_at(x.held, n + step){field} < x.at, false), n + step, n))"


def below(ordered: Column, at: Column, field: str | None = None) -> Column:
    """How many elements of a sorted array (of fewer than 2^25) lie below a value: a binary search."""
    name = f".{field}" if field else ""
    return bound(f"if(size(x.held) <= {FEW}, size(filter(x.held, h -> h{name} < x.at)), {_BELOW.format(field=name)})", held=ordered, at=at)


def in_order(items: Column) -> Column:
    """Start and end of disjoint spans, behind one that lies before all, for ``hit``: sorted if they are more than FEW."""
    first = F.expr("array(named_struct('start', -1, 'end', -1))")
    return bound(f"if(size(x.held) <= {FEW}, x.held, sort_array(x.held))", held=F.concat(first, written("transform", items, "x -> named_struct('start', x.start, 'end', x.end)")))


def hit(ordered: Column, start: Column, end: Column) -> Column:
    """Does [start, end) overlap one of the spans? Of those that begin before its end, the last one ends last."""
    few = F.exists(ordered, lambda h: (h["end"] > start) & (h["start"] < end))
    return F.when(F.size(ordered) <= FEW, few).otherwise(bound(f"element_at(x.held, {_BELOW.format(field='.start')}).end > x.a", held=ordered, a=start, at=end))


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def merge_touching(items: Column) -> Column:
    """Merges array<struct<start,end>> spans that overlap or touch."""
    kind = "array<struct<start:int,end:int>>"
    sorted_ = F.array_sort(F.transform(items, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))

    def add(acc, x):
        last = F.element_at(acc, -1)
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))
        return F.when((F.size(acc) > 0) & (x["start"] <= F.try_element_at(acc, F.lit(-1))["end"]), joined).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(sorted_, F.array().cast(kind), add)


def apply_edits(text: Column, edits: Column) -> Column:
    """struct<text, applied>: edits (start, end, suggestion, ...) from right to left; one that reaches into an edit already made is skipped."""
    kind = "array<struct<start:int,end:int,suggestion:string>>"

    def chosen(ordered):
        zero = F.struct(F.lit(2147483647).alias("bound"), F.array().cast(kind).alias("applied"))

        def add(acc, e):
            one = F.struct(e["start"].alias("start"), e["end"].alias("end"), e["suggestion"].alias("suggestion"))
            return F.when(e["end"] <= acc["bound"], F.struct(e["start"].alias("bound"), F.concat(F.array(one), acc["applied"]).alias("applied"))).otherwise(acc)

        # Mostly no edit reaches into the next one, and then all are made.
        apart = ~F.exists(F.transform(ordered, lambda e, i: e["end"] > F.coalesce(F.try_element_at(ordered, i + 2)["start"], F.lit(2147483647))), lambda x: x)
        plain = F.transform(ordered, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["suggestion"].alias("suggestion"))).cast(kind)
        return F.when(apart, plain).otherwise(F.aggregate(F.reverse(ordered), zero, add, lambda a: a["applied"]))

    def made(x):
        def new(e, i):
            return F.concat(within(x["cut"], F.when(i > 0, F.try_element_at(x["applied"], F.greatest(i, F.lit(1)))["end"]).otherwise(F.lit(0)), e["start"]), e["suggestion"])

        last = F.coalesce(F.try_element_at(x["applied"], F.lit(-1))["end"], F.lit(0))
        whole = F.concat(F.array_join(F.transform(x["applied"], new), ""), within(x["cut"], last, F.length(text)))
        return F.struct(F.when(F.size(x["applied"]) > 0, whole).otherwise(text).alias("text"), x["applied"].alias("applied"))

    done = let(F.struct(pieces(text).alias("cut"), let(F.sort_array(edits), chosen).alias("applied")), made)
    return F.when(F.size(edits) > 0, done).otherwise(F.struct(text.alias("text"), F.array().cast(kind).alias("applied")))
