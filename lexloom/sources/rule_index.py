"""A stored inverted index over chunks: postings by token, length classes with their extremes, and a top-k that skips.

A chunk of n different tokens that shares o of them with a query of m scores o / sqrt(m n). With
o <= min(m, n) the score is at most sqrt(min(m, n) / max(m, n)): lengths alone bound it. Postings
lie in length classes (quarters of a power of two), and a small table tells the least and greatest length
and the number of postings of each (token, class).

A search first reads the postings of each query's rarest tokens (at least one, and as many as make up a share of all): the k-th best of those partial scores is a
score that the answer reaches at least. Then only classes whose bound isn't below it are read, for all of the query's
tokens. As the bound depends on the length alone, a chunk is read either with all of its shared tokens or not at
all, so the result is that of a whole scan.

Postings are files by a hash of the token (a search reads the buckets of its tokens only), dealt within a bucket by a
hash of the chunk, so a token that every chunk has is spread over files as well.

Chunks without tokens are stored, but never found; a chunk_id that comes twice is found twice. Nulls are empty texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.retrieval import BLOCK, _blocks, _ranked, tokens

#: ``probe``: the share of a query's postings, those of its rarest tokens, that a search reads first.
BUCKETS, PROBE = 64, 0.3


def bound(n_least: Column, n_most: Column, m: Column) -> Column:
    """The most that a chunk of so many tokens can score."""
    over, under = F.sqrt(m / n_least), F.sqrt(n_most / m)
    return F.when(n_least > m, over).when(n_most < m, under).otherwise(F.lit(1.0))


class RuleIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, chunks: DataFrame, path: str, text: Column | None = None, buckets: int = BUCKETS, chunks_a_file: int = 50_000) -> RuleIndex:
        """Stores ``chunks`` (chunk_id, text or ``text``, any other columns) and their index; an index at this path is replaced."""
        t = tokens(F.col("text") if text is None else text)
        chunks.write.mode("overwrite").parquet(f"{path}/chunks")
        stored = chunks.sparkSession.read.schema(chunks.schema).parquet(f"{path}/chunks")
        splits = max(1, -(-stored.count() // chunks_a_file))
        base = stored.select("chunk_id", t.alias("t")).select("chunk_id", F.size("t").alias("n"), F.explode_outer("t").alias("token")).where("token is not null")
        posting = base.select(F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int").alias("bucket"), "token", F.floor(F.log2("n") * 4).cast("int").alias("class"), "n", "chunk_id")
        dealt = posting.repartition(F.col("bucket"), F.pmod(F.xxhash64("chunk_id"), F.lit(splits)))
        dealt.sortWithinPartitions("bucket", "token", "class", "n").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        out = cls(chunks.sparkSession, path)
        told = out.postings().groupBy("bucket", "token", "class").agg(F.min("n").alias("n_least"), F.max("n").alias("n_most"), F.count("*").alias("postings"))
        told.repartition("bucket").sortWithinPartitions("token", "class").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/classes")
        chunks.sparkSession.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").json(f"{path}/about")
        return out

    def chunks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/chunks")

    def postings(self) -> DataFrame:
        kind = self.chunks().schema["chunk_id"].dataType.simpleString()
        return self.spark.read.schema(f"token string, class int, n int, chunk_id {kind}, bucket int").parquet(f"{self.path}/postings")

    def classes(self) -> DataFrame:
        return self.spark.read.schema("token string, class int, n_least int, n_most int, postings long, bucket int").parquet(f"{self.path}/classes")

    def _asked(self, queries: DataFrame) -> tuple[DataFrame, list[int]]:
        """(query_id, m, token, bucket) and the buckets of the tokens, of which there are as many as buckets at most."""
        buckets = self.spark.read.schema("buckets int").json(f"{self.path}/about").first()[0]
        q = queries.select("query_id", F.size("q").alias("m"), F.explode("q").alias("token")).withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int"))
        return q, sorted(r[0] for r in q.select("bucket").distinct().collect())

    def _needed(self, q: DataFrame, buckets: list[int], k: int, probe: float) -> DataFrame:
        """(query_id, m, token, bucket, class, postings, floor): the classes of each query that may hold one of its k best."""
        known = self.classes().where(F.col("bucket").isin(buckets)).join(q, ["bucket", "token"])
        rare = known.groupBy("query_id", "m", "bucket", "token").agg(F.sum("postings").alias("df"))
        w = Window.partitionBy("query_id").orderBy("df", "token")
        so_far, all_ = F.sum("df").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.sum("df").over(Window.partitionBy("query_id"))
        first = rare.withColumns({"__n": F.row_number().over(w), "__part": so_far / all_}).where((F.col("__n") == 1) | (F.col("__part") <= probe))
        some = self.postings().where(F.col("bucket").isin(buckets)).join(first.select("query_id", "m", "bucket", "token"), ["bucket", "token"])
        part = some.groupBy("query_id", "chunk_id").agg(F.count("*").alias("o"), F.max("n").alias("n"), F.max("m").alias("m"))
        scored = part.select("query_id", "chunk_id", (F.col("o") / F.sqrt(F.col("m") * F.col("n"))).alias("score"))
        floor = _ranked(scored, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        out = known.join(floor, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)) * (1 - 1e-9))
        return out.where(bound(F.col("n_least"), F.col("n_most"), F.col("m")) >= F.col("floor"))

    def search(self, queries: DataFrame, k: int = 5, block: int = BLOCK, probe: float = PROBE) -> DataFrame:
        """query_id, chunk_id, overlap, score, rank of the k best chunks with a common token. ``queries``: query_id, text."""
        if k <= 0:
            raise ValueError("k must be positive")
        out = None
        for part in _blocks(queries.select("query_id", tokens(F.col("text")).alias("q")), block):
            q, buckets = self._asked(part)
            need = self._needed(q, buckets, k, probe).select("query_id", "m", "bucket", "token", "class", "floor")
            hits = self.postings().where(F.col("bucket").isin(buckets)).join(need, ["bucket", "token", "class"]).where(bound(F.col("n"), F.col("n"), F.col("m")) >= F.col("floor"))
            hits = hits.groupBy("query_id", "chunk_id").agg(F.count("*").cast("int").alias("overlap"), F.max("n").alias("n"), F.max("m").alias("m"))
            hits = hits.select("query_id", "chunk_id", "overlap", (F.col("overlap") / F.sqrt(F.greatest(F.lit(1), F.col("m") * F.col("n")))).alias("score"))
            out = hits if out is None else out.unionByName(hits)
        return _ranked(out, k)

    def cost(self, queries: DataFrame, k: int = 5, probe: float = PROBE) -> DataFrame:
        """query_id, postings (of all its tokens) and postings_needed (of the classes that a search reads)."""
        q, buckets = self._asked(queries.select("query_id", tokens(F.col("text")).alias("q")))
        whole = self.classes().where(F.col("bucket").isin(buckets)).join(q, ["bucket", "token"]).groupBy("query_id").agg(F.sum("postings").alias("postings"))
        need = self._needed(q, buckets, k, probe).groupBy("query_id").agg(F.sum("postings").alias("postings_needed"))
        return whole.join(need, "query_id", "left").select("query_id", "postings", F.coalesce("postings_needed", F.lit(0)).alias("postings_needed"))
