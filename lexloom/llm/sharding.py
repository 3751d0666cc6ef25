"""Immutable shards with size-tiered compaction and a versioned manifest.

A store is a folder with ``data/<file>`` (parquet shards, never changed) and
``manifest/v<version>.json``. ``append`` writes an arrival as small shards and
commits a version that names them too. ``compact`` sorts shards into tiers by
size (each tier ``fan`` times the one below), merges runs of at least ``fan``
shards of a tier into files of at most about the target size, and commits a
version with the runs replaced. A merge reads its shards in one task per output
file, without a shuffle.

A commit writes its manifest under a name of its own and renames it to the next
version without overwriting, which fails if another writer was first; the loser
of two appends tries again on the new version, the loser of two compactions gives up
its output. This needs a file system with an atomic rename (HDFS, local disks); on an
object store without one, use a single writer. Readers see whole versions only, and a
version that a reader has planned on stays readable: nothing but ``vacuum`` deletes,
and it keeps versions for ``keep_seconds`` and files that no version names (a
writer's under way, or one's that died) for ``orphan_seconds``. A lost task is
written again by Spark's committer before any manifest names its file.

The manifest has one entry per file: at a target of 512 MB, 100 TB are about
200,000 entries. Rows keep all columns. Defined results: repeated rows, nulls, long and empty
texts are stored as they are; an empty arrival commits a version without new
shards; an empty store reads as an empty table. An arrival must have the store's
column names and types in their order (all columns can be null).
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import delete, filesystem, free, new_path


class Conflict(RuntimeError):
    """Another writer committed the version first."""


def nullable(schema: T.StructType) -> T.StructType:
    """The schema as files have it: every column, field and element can be null."""
    def of(t):
        if isinstance(t, T.StructType):
            return T.StructType([T.StructField(f.name, of(f.dataType)) for f in t.fields])
        if isinstance(t, T.ArrayType):
            return T.ArrayType(of(t.elementType))
        return T.MapType(of(t.keyType), of(t.valueType)) if isinstance(t, T.MapType) else t

    return of(schema)


@dataclass(frozen=True)
class Shard:
    file: str
    bytes: int
    rows: int
    level: int  # merges behind it


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, target_bytes: int = 512 << 20, small_bytes: int = 4 << 20, fan: int = 4, shard_rows: int = 0):
        self.spark, self.path = spark, path.rstrip("/")
        self.target, self.small, self.fan, self.shard_rows = target_bytes, small_bytes, fan, shard_rows

    # Manifest

    def _list(self, folder: str) -> list:
        fs, p = filesystem(self.spark, f"{self.path}/{folder}")
        return list(fs.listStatus(p)) if fs.exists(p) else []

    def version(self) -> int:
        names = [f.getPath().getName() for f in self._list("manifest")]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "shards": []}
        fs, p = filesystem(self.spark, f"{self.path}/manifest/v{version:010d}.json")
        stream = fs.open(p)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def shards(self, version: int | None = None) -> list[Shard]:
        return [Shard(**s) for s in self.manifest(version)["shards"]]

    def commit(self, base: int, shards: list[Shard], schema: str) -> int:
        """Version base + 1 with these shards; Conflict if it exists."""
        jvm = self.spark.sparkContext._jvm
        to = f"{self.path}/manifest/v{base + 1:010d}.json"
        text = json.dumps({"version": base + 1, "time": time.time(), "schema": json.loads(schema), "shards": [asdict(s) for s in shards]})
        fs, temp = filesystem(self.spark, f"{self.path}/manifest/.{uuid.uuid4().hex}.tmp")
        stream = fs.create(temp, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(temp, jvm.org.apache.hadoop.fs.Path(to), none)
        except Exception as e:  # py4j wraps Hadoop's FileAlreadyExistsException
            fs.delete(temp, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(to) from None
            raise
        return base + 1

    # Writing

    def _write(self, df: DataFrame, level: int, split: bool = True) -> list[Shard]:
        """New files of ``df``, moved under data/ with names of their own."""
        return self._write_parts(df, None, level, split).get(None, [])

    def _write_parts(self, df: DataFrame, column: str | None, level: int, split: bool = True) -> dict:
        """New files by the value of ``column``, in one job; the files don't hold that column."""
        folder = f"{self.path}/data/.{uuid.uuid4().hex}"
        writer = df.write.option("compression", "zstd")
        if self.shard_rows and split:
            writer = writer.option("maxRecordsPerFile", self.shard_rows)
        (writer if column is None else writer.partitionBy(column)).parquet(folder)
        fs, p = filesystem(self.spark, folder)
        parts = {None: folder} if column is None else {int(f.getPath().getName().partition("=")[2]): f.getPath().toString() for f in fs.listStatus(p) if "=" in f.getPath().getName()}
        rows, schema = {}, df.drop(column).schema if column else df.schema
        if any(f.getPath().getName().endswith(".parquet") for part in parts.values() for f in fs.listStatus(filesystem(self.spark, part)[1])):
            written = self.spark.read.schema(schema).parquet(*parts.values())
            # A task gives its files in different folders the same name.
            name = F.substring_index(written.metadataColumn("_metadata")["file_path"], "/", -2).alias("file")
            rows = {r[0]: r[1] for r in written.select(name).groupBy("file").count().collect()}
        out = {k: self._move(part, rows, level) for k, part in parts.items()}
        fs.delete(p, True)
        return out

    def _move(self, folder: str, rows: dict, level: int) -> list[Shard]:
        fs, p = filesystem(self.spark, folder)
        files, out = [f for f in fs.listStatus(p) if f.getPath().getName().endswith(".parquet")], []
        for f in sorted(files, key=lambda f: f.getPath().getName()):
            n = rows.get(f"{p.getName()}/{f.getPath().getName()}", 0)
            if n:
                new = f"{uuid.uuid4().hex}.parquet"
                fs.rename(f.getPath(), filesystem(self.spark, f"{self.path}/data/{new}")[1])
                out.append(Shard(new, int(f.getLen()), n, level))
        return out

    def _fits(self, manifest: dict, schema: T.StructType) -> None:
        if manifest["schema"] is not None and nullable(T.StructType.fromJson(manifest["schema"])) != schema:
            raise ValueError(f"the store holds {T.StructType.fromJson(manifest['schema']).simpleString()}, not {schema.simpleString()}")

    def append(self, df: DataFrame, tries: int = 20) -> int:
        schema = nullable(df.schema)
        self._fits(self.manifest(), schema)
        return self._add(self._write(df, 0), schema, tries)

    def append_arrivals(self, df: DataFrame, column: str, arrived=None, tries: int = 20) -> int:
        """Arrivals named by the integer ``column`` (not part of their rows): written by one job, then committed one by one in
        their order; ``arrived`` is called after each. The last version."""
        schema = nullable(df.drop(column).schema)
        self._fits(self.manifest(), schema)
        version = self.version()
        for k, new in sorted(self._write_parts(df, column, 0).items()):
            version = self._add(new, schema, tries)
            if arrived:
                arrived(k)
        return version

    def _add(self, new: list[Shard], schema: T.StructType, tries: int) -> int:
        try:
            for _ in range(tries):
                m = self.manifest()
                self._fits(m, schema)
                try:
                    return self.commit(m["version"], [Shard(**s) for s in m["shards"]] + new, schema.json())
                except Conflict:
                    continue
            raise Conflict(self.path)
        except (Conflict, ValueError):
            for s in new:
                delete(self.spark, f"{self.path}/data/{s.file}")
            raise

    def tier(self, size: int) -> int:
        t, edge = 0, self.small
        while size > edge:
            t, edge = t + 1, edge * self.fan
        return t

    def plan(self, shards: list[Shard]) -> list[list[Shard]]:
        """Runs to merge: of the shards below the target, ``fan`` or more of one tier, smallest first, at most the target in sum."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.bytes < self.target:
                tiers.setdefault(self.tier(s.bytes), []).append(s)
        out = []
        for _, group in sorted(tiers.items()):
            run, size = [], 0
            for s in sorted(group, key=lambda s: (s.bytes, s.file)):
                if run and size + s.bytes > self.target:
                    out.append(run)
                    run, size = [], 0
                run, size = [*run, s], size + s.bytes
            out.append(run)
        return [r for r in out if len(r) >= self.fan or (len(r) > 1 and sum(s.bytes for s in r) >= self.target // 2)]

    def compact(self, tries: int = 20) -> int:
        """Merges until no run is left (each round leaves fewer files); every round is one version. Conflict after ``tries`` lost races."""
        while True:
            m = self.manifest()
            shards = [Shard(**s) for s in m["shards"]]
            runs = self.plan(shards)
            if not runs:
                return m["version"]
            merged: list[Shard] = []
            schema = T.StructType.fromJson(m["schema"])
            frames = [self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{s.file}" for s in r]).coalesce(1) for r in runs]
            # One job for many runs: each is one task of the union.
            for i in range(0, len(frames), 64):
                whole = frames[i]
                for f in frames[i + 1 : i + 64]:
                    whole = whole.union(f)
                level = 1 + max(s.level for r in runs[i : i + 64] for s in r)
                merged += self._write(whole, level, split=False)
            gone = {s.file for r in runs for s in r}
            if sum(s.rows for s in merged) != sum(s.rows for r in runs for s in r):
                raise RuntimeError("a merge changed the number of rows")
            try:
                self.commit(m["version"], [s for s in shards if s.file not in gone] + merged, json.dumps(m["schema"]))
            except Conflict:
                for s in merged:
                    delete(self.spark, f"{self.path}/data/{s.file}")
                tries -= 1
                if not tries:
                    raise

    def vacuum(self, keep_seconds: float = 7 * 86_400, orphan_seconds: float = 86_400) -> int:
        """Deletes the versions that a later one replaced more than ``keep_seconds`` ago, the shards that only they name, and
        files that no version names from ``orphan_seconds`` after their last change on. Returns the number of files deleted."""
        now, found = time.time(), {}
        for f in self._list("manifest"):
            name = f.getPath().getName()
            if name.startswith("v") and name.endswith(".json"):
                found[int(name[1:-5])] = self.manifest(int(name[1:-5]))
        order = sorted(found)
        old = [v for v, after in zip(order, order[1:]) if now - found[after].get("time", 0) >= keep_seconds]
        named = {s["file"] for v in order if v not in set(old) for s in found[v]["shards"]}
        expired = {s["file"] for v in old for s in found[v]["shards"]} - named
        count = 0
        for f in self._list("data"):
            name = f.getPath().getName()
            if name in expired or (name not in named and now - f.getModificationTime() / 1000 >= orphan_seconds):
                delete(self.spark, f"{self.path}/data/{name}")
                count += 1
        for v in old:
            delete(self.spark, f"{self.path}/manifest/v{v:010d}.json")
        return count

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        if m["schema"] is None:
            return self.spark.createDataFrame([], T.StructType())
        schema = T.StructType.fromJson(m["schema"])
        if not m["shards"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{s['file']}" for s in m["shards"]])

    def located(self) -> DataFrame:
        """The rows of the last version and, as the last column, where each lies: a struct (file, rows, bytes, level, version, tier)
        named ``_shard``, with more underscores if that name is taken."""
        m = self.manifest()
        info = self.spark.createDataFrame([(s["file"], s["rows"], s["bytes"], s["level"], m["version"], self.tier(s["bytes"])) for s in m["shards"]], "file string, rows long, bytes long, level int, version long, tier int")
        rows = self.read(m["version"])
        place, key = free(rows.columns, "_shard", "_file")
        if not m["shards"]:
            return rows.withColumn(place, F.lit(None).cast(info.select(F.struct("*")).schema[0].dataType))
        keyed = rows.withColumn(key, rows.metadataColumn("_metadata")["file_name"])
        return keyed.join(info.select(F.col("file").alias(key), F.struct("*").alias(place)), key).drop(key)


def deal(docs: DataFrame, arrivals: int, column: str) -> DataFrame:
    """``docs`` with the number of an arrival: a task's rows go in runs to as many arrivals as it takes for the tasks to fill all
    (one, where there are more tasks than arrivals)."""
    rows, tasks = docs.count(), max(1, docs.rdd.getNumPartitions())
    runs = -(-arrivals // tasks)
    place = F.monotonically_increasing_id()
    run = F.least(F.floor(place.bitwiseAND(F.lit((1 << 33) - 1)) / F.lit(max(1, -(-rows // (tasks * runs))))), F.lit(runs - 1))
    return docs.withColumn(column, F.pmod(F.shiftright(place, 33) * runs + run, F.lit(arrivals)).cast("int"))


def op10_sharding(spark: SparkSession, sf_dir: str, arrivals: int = 16, shard_bytes: int = 8 << 20, target_bytes: int = 128 << 20) -> DataFrame:
    """Appends the table in ``arrivals`` portions, in shards of about ``shard_bytes`` at most, compacts after every
    four of them, and tells where each document lies: the shard with its rows, bytes, level (merges behind it) and tier, and the version."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    total = 0
    for f in docs.inputFiles():
        fs, path = filesystem(spark, f)
        total += int(fs.getFileStatus(path).getLen())
    store = ShardStore(spark, new_path(spark, "shards"), target_bytes=target_bytes, small_bytes=32 << 10, fan=4, shard_rows=max(1, docs.count() * shard_bytes // max(1, total)))
    column = free(docs.columns, "arrival")[0]

    def arrived(k: int) -> None:
        if k % 4 == 3 or k == arrivals - 1:
            store.compact()
            store.vacuum(keep_seconds=0, orphan_seconds=86_400)  # nobody else reads this store

    store.append_arrivals(deal(docs, arrivals, column), column, arrived)
    if not store.version():
        store.append(docs)
    at = store.located()
    return at.select("doc_id", *[F.col(f"{at.columns[-1]}.{a}").alias(b) for a, b in (("file", "shard"), ("rows", "shard_rows"), ("bytes", "shard_bytes"), ("level", "level"), ("version", "version"), ("tier", "tier"))])
