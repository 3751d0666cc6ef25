"""URL filters by a Bloom filter cascade, with DataFrame functions only.

Keys of a url are its host, every parent domain of the host, and host + path.
Level 0 encodes the listed keys that occur among the corpus's keys; level 1
encodes the corpus's other keys that pass level 0; level 2 the listed keys that
pass level 1, and so on until no key passes wrongly. Over the corpus's complete
key universe membership is then exact: a key is listed if the first level that
rejects it is an odd one. Urls are tested without a join: a level is one row of
64-bit words, read as a scalar subquery.

A level is at most ``max_bits`` bits. More keys than fit are dealt into shards by
hash, each with its own cascade, and the urls' verdicts are written to the
shared folder between runs of ``max_shards`` shards, which bounds what one task
holds. The universe is tagged by one aggregation of (key, listed) over the union
of both sides, with partial sums before the shuffle, so hot hosts don't skew it.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case;
path: then up to ``?``, ``#`` or the end. Explicit rules (host, path) fit a host
and its subdomains if the path starts with the rule's; the longest wins over
all others and over the cascade.

Defined results: a url that is null or has no ``://`` has an empty host and path
and no keys, so it is allowed. Repeated urls are judged alike. Empty tables and
an empty list give "allow" for all. A listed null or empty key is left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Table


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The explicit rules of the query.
RULES = (Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/"))

#: The hosts that the query lists, each under example.com, example.net and example.org.
LISTED_NAMES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED_DOMAINS = ("example.com", "example.net", "example.org")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS_PER_KEY, HASHES = 10, 7


def url_host(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.concat(F.lit("x"), url), "://", 1))
    after = F.substring(url, F.length(rest) + 3, F.length(url))
    return F.coalesce(F.translate(F.regexp_extract(after, r"\A([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.concat(F.lit("x"), url), "://", 1))
    after = F.substring(url, F.length(rest) + 3, F.length(url))
    return F.coalesce(F.regexp_extract(after, r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def url_keys(host: Column, path: Column) -> Column:
    """The host, its parent domains, and host + path; none for an empty host."""
    parts = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.when(host != "", F.array_distinct(F.concat(parents, F.array(F.concat(host, path))))).otherwise(F.array().cast("array<string>"))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host) + len(r.path), len(r.host))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def places(key: Column, level: int, bits: int) -> list[Column]:
    """The bits of a key at a level (double hashing; 31-bit parts can't overflow)."""
    h = F.xxhash64(key, F.lit(level))
    a, b = F.shiftrightunsigned(h, 33), h.bitwiseAND(F.lit(0x7FFFFFFF))
    return [F.pmod(a + b * j, F.lit(bits)) for j in range(HASHES)]


def build_level(keys: DataFrame, level: int, bits: int) -> Table:
    """One row: the level's bits as an array of longs."""
    spark = keys.sparkSession
    bit = keys.select(F.explode(F.array(*places(F.col("key"), level, bits))).alias("p")).select(F.floor(F.col("p") / 64).cast("long").alias("w"), F.expr("shiftleft(1L, cast(pmod(p, 64) as int))").alias("b"))
    zero = spark.range(bits // 64).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("b"))
    words = bit.unionByName(zero).groupBy("w").agg(F.bit_or("b").alias("b"))
    return Table(words.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("words")), f"bloom-{level}")


def passes(key: Column, level: int, bits: int, words: Column) -> Column:
    """Are all bits of the key set."""
    out = F.lit(True)
    for p in places(key, level, bits):
        out = out & (F.call_function("shiftright", F.element_at(words, (F.floor(p / 64) + 1).cast("int")), F.pmod(p, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return out


class Cascade:
    """Levels over the listed keys of a universe (key, listed)."""

    def __init__(self, universe: DataFrame, max_levels: int = 60):
        self.levels: list[tuple[int, Table]] = []
        inside, outside, held = universe.where("listed").select("key"), universe.where("not listed").select("key"), []
        n = inside.count()
        while n:
            level = len(self.levels)
            if level == max_levels:
                raise RuntimeError("the cascade doesn't end; are two keys equal in both hashes?")
            bits = max(64, -(-n * BITS_PER_KEY // 64) * 64)
            table = build_level(inside, level, bits)
            self.levels.append((bits, table))
            wrong = Table(outside.where(passes(F.col("key"), level, bits, table.df.scalar())), f"false-{level}")
            inside, outside = wrong.df, inside
            held.append(wrong)
            n = inside.count()
        for t in held:
            t.drop()

    def filters(self) -> list[Column]:
        return [t.df.scalar() for _, t in self.levels]

    def listed(self, key: Column, words: list[Column]) -> Column:
        """Is a key of the universe listed; ``words``: the levels' words."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            out = F.when(~passes(key, level, self.levels[level][0], words[level]), F.lit(level % 2 == 1)).otherwise(out)
        return out


def filter_urls(pages: DataFrame, listed: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", max_bits: int = 1 << 26, max_shards: int = 4) -> DataFrame:
    """page_id, host, path, rule, verdict, listed (does the list hold one of the url's keys). ``listed``: one column of keys."""
    url = F.col("u")
    base = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("u")).select("page_id", url_host(url).alias("host"), url_path(url).alias("path"))
    keys = url_keys(F.col("host"), F.col("path"))
    marked = listed.select(listed[listed.columns[0]].cast("string").alias("key")).where("key is not null and key != ''").select("key", F.lit(True).alias("listed"), F.lit(False).alias("seen"))
    seen = base.select(F.explode(keys).alias("key")).select("key", F.lit(False).alias("listed"), F.lit(True).alias("seen"))
    universe = Table(seen.unionByName(marked).groupBy("key").agg(F.max("listed").alias("listed"), F.max("seen").alias("seen")).where("seen").select("key", "listed"), "universe")
    n = universe.df.where("listed").count()
    shards = max(1, -(-n * BITS_PER_KEY // max_bits))
    shard = lambda k: F.pmod(F.xxhash64(k, F.lit("shard")), F.lit(shards))
    out, table = base.withColumn("listed", F.lit(False)), None
    for first in range(0, shards, max_shards):
        for s in range(first, min(first + max_shards, shards)):
            cascade = Cascade(universe.df if shards == 1 else universe.df.where(shard(F.col("key")) == s))
            if not cascade.levels:
                continue
            names = [f"__w{i}" for i in range(len(cascade.levels))]
            out = out.withColumns(dict(zip(names, cascade.filters())))
            words = [F.col(x) for x in names]
            mine = (lambda k: F.lit(True)) if shards == 1 else (lambda k, s=s: shard(k) == s)
            out = out.withColumn("listed", F.col("listed") | F.exists(keys, lambda k: mine(k) & cascade.listed(k, words))).drop(*names)
        if first + max_shards < shards:
            before, table = table, Table(out, "url-verdicts")
            out = table.df
            if before:
                before.drop()
    universe.drop()
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "listed")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.range(1).select(F.explode(F.array(*[F.lit(f"{n}.{d}") for n in LISTED_NAMES for d in LISTED_DOMAINS])).alias("key"))
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), listed)


_LIST = ", ".join(f"'{n}.{d}'" for n in LISTED_NAMES for d in LISTED_DOMAINS)
_FITS = [(r, f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))") for r in sorted(RULES, key=lambda r: -len(r.text))]
OP3_SQL = f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM u),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
k AS (SELECT *, len(list_filter(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.') IN ({_LIST}))) > 0
             OR concat(host, path) IN ({_LIST}) AS hit FROM p)
SELECT page_id, host, path,
       CASE {" ".join(f"WHEN {f} THEN '{r.text}'" for r, f in _FITS)} END AS rule,
       CASE {" ".join(f"WHEN {f} THEN '{r.verdict}'" for r, f in _FITS)} WHEN hit AND host <> '' THEN 'block' ELSE 'allow' END AS verdict,
       hit AND host <> '' AS listed
FROM k
"""
