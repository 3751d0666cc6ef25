"""Keyed tables that change by batches: bucketed snapshots, a numbered manifest, batches that are applied once.

A table is a folder with ``data/v<version>/bucket=<n>`` (parquet, never changed) and
``manifest/v<version>.json``, which names for every bucket the version that last wrote it, and
the last batch. A change rewrites only the buckets whose keys it touches and then commits the next
manifest by a rename that fails if it exists; readers see whole versions. A batch whose number is not above the last
one's is not applied again, so a replayed micro-batch adds nothing. A task or driver that dies
before the commit leaves files that no manifest names. Needs a file system with an atomic rename.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Taken(Exception):
    """Another writer committed this version first."""


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


class KeyedTable:
    """Rows of a schema, one per key, in ``buckets`` by a hash of the key columns."""

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    # Versions

    def versions(self) -> list[int]:
        fs, p = _fs(self.spark, f"{self.path}/manifest")
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        found = self.versions()
        if version is None and not found:
            return {"version": 0, "batch": -1, "buckets": {}}
        fs, p = _fs(self.spark, f"{self.path}/manifest/v{found[-1] if version is None else version:010d}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, version: int, batch: int, buckets: dict) -> None:
        fs, temp = _fs(self.spark, f"{self.path}/manifest/.{uuid.uuid4().hex}.tmp")
        stream = fs.create(temp, False)
        try:
            stream.write(bytearray(json.dumps({"version": version, "batch": batch, "buckets": buckets}).encode()))
        finally:
            stream.close()
        jvm = self.spark.sparkContext._jvm
        to = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest/v{version:010d}.json")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(temp, to, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            fs.delete(temp, False)
            if "FileAlreadyExists" in str(e):
                raise Taken(to.toString()) from None
            raise

    # Rows

    def bucket_of(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _rows(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        named = [f"{self.path}/data/v{v:010d}/bucket={b}" for b, v in manifest["buckets"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(self.schema).parquet(*named) if named else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.manifest(version))

    def change(self, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], batch: int | None = None, tries: int = 20) -> bool:
        """Applies ``merge(rows, changes)`` to the buckets that ``changes`` (it has the key columns) touch; whether it did.

        ``batch``: a number; one that isn't above the last applied one does nothing. A lost race is tried again on the winner's version.
        """
        touched = sorted(r[0] for r in changes.select(self.bucket_of().alias("b")).distinct().collect())
        for _ in range(tries):
            m = self.manifest()
            if batch is not None and batch <= m["batch"]:
                return False
            version, buckets = m["version"] + 1, dict(m["buckets"])
            if touched:
                new = merge(self._rows(m, touched), changes).select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields])
                # A writer that loses the race has its own folder.
                folder = f"{self.path}/data/.{uuid.uuid4().hex}"
                new.withColumn("bucket", self.bucket_of()).repartition("bucket").write.partitionBy("bucket").parquet(folder)
                fs, p = _fs(self.spark, folder)
                written = {f.getPath().getName().partition("=")[2] for f in fs.listStatus(p) if "=" in f.getPath().getName()}
                buckets = {b: v for b, v in buckets.items() if int(b) not in touched} | {b: version for b in written}
            try:
                if touched:
                    to = _fs(self.spark, f"{self.path}/data/v{version:010d}")[1]
                    fs.mkdirs(_fs(self.spark, f"{self.path}/data")[1])
                    if fs.exists(to) and version not in self.versions():
                        fs.delete(to, True)  # of a writer that died before its commit
                    if fs.exists(to) or not fs.rename(p, to):
                        raise Taken(folder)
                self._commit(version, m["batch"] if batch is None else batch, buckets)
                return True
            except Taken:
                if touched:
                    fs.delete(p, True)
        raise Taken(self.path)

    def upsert(self, rows: DataFrame, batch: int | None = None, order: str | None = None) -> bool:
        """Rows by key: a new one replaces the old (of several new ones the greatest by ``order`` wins, and an old one that is greater stays)."""

        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            names = [f.name for f in self.schema.fields]
            both = old.select(*names, F.lit(0).alias("__new")).unionByName(new.select(*names, F.lit(1).alias("__new")))
            rank = F.struct(*([F.col(order)] if order else []), F.col("__new"))
            rest = [n for n in names if n not in self.keys]
            return both.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), rank).alias("__x")).select(*self.keys, "__x.*") if rest else both.select(*names).distinct()

        return self.change(rows, merge, batch)

    def delete(self, gone: DataFrame, batch: int | None = None) -> bool:
        """Removes the rows of the given keys."""
        return self.change(gone.select(*self.keys).distinct(), lambda old, keys: old.join(keys, self.keys, "left_anti"), batch)

    def vacuum(self, keep: int = 2) -> int:
        """Deletes all but the last ``keep`` versions and the folders that none of those name. Returns the number of folders deleted."""
        found = self.versions()
        named = {f"v{v:010d}/bucket={b}" for version in found[-keep:] for b, v in self.manifest(version)["buckets"].items()}
        fs, p = _fs(self.spark, f"{self.path}/data")
        count = 0
        for f in fs.listStatus(p) if fs.exists(p) else []:
            name = f.getPath().getName()
            if not name.startswith("v") or int(name[1:]) > (found[-1] if found else 0):
                continue
            for b in fs.listStatus(f.getPath()):
                if f"{name}/{b.getPath().getName()}" not in named and "=" in b.getPath().getName():
                    fs.delete(b.getPath(), True)
                    count += 1
        for v in found[:-keep]:
            fs.delete(_fs(self.spark, f"{self.path}/manifest/v{v:010d}.json")[1], False)
        return count


def cascade(tables: list[KeyedTable], column: str, gone: DataFrame, batch: int | None = None) -> None:
    """Deletes from every table the rows whose ``column`` is in ``gone``, the first table last, so that a run that breaks off can be done again."""
    ids = gone.select(column).where(F.col(column).isNotNull()).distinct()
    for t in reversed(tables):
        hit = t.read().join(ids, column, "left_semi").select(*t.keys)
        t.delete(hit, batch)


class CompactedLog:
    """An append-only log in numbered batches, with a snapshot of its fold: the latest state is the fold of the snapshot and the tail alone.

    ``fold(state, events)`` gives the new state rows of the keys in ``events``; ``state`` holds the old ones.
    """

    def __init__(self, spark: SparkSession, path: str, event_schema: str, state: KeyedTable, fold: Callable[[DataFrame, DataFrame], DataFrame]):
        self.spark, self.path, self.event_schema, self.state, self.fold = spark, path.rstrip("/"), event_schema, state, fold

    def _batches(self) -> list[int]:
        fs, p = _fs(self.spark, f"{self.path}/log")
        done = lambda f: fs.exists(_fs(self.spark, f"{f.getPath().toString()}/_SUCCESS")[1])
        return sorted(int(f.getPath().getName()[6:]) for f in fs.listStatus(p) if f.getPath().getName().startswith("batch=") and done(f)) if fs.exists(p) else []

    def append(self, events: DataFrame, batch: int) -> None:
        """Writes a batch; the same number again replaces it (a replay gives the same rows)."""
        fields = T.StructType.fromDDL(self.event_schema).fields
        if batch > self.state.manifest()["batch"]:
            events.select(*[F.col(f.name).cast(f.dataType) for f in fields]).write.mode("overwrite").parquet(f"{self.path}/log/batch={batch:010d}")

    def events(self, after: int = -1) -> DataFrame:
        named = [f"{self.path}/log/batch={b:010d}" for b in self._batches() if b > after]
        return self.spark.read.schema(self.event_schema).parquet(*named) if named else self.spark.createDataFrame([], self.event_schema)

    def latest(self) -> DataFrame:
        """The state: of keys in the tail the fold, of all others the snapshot."""
        m = self.state.manifest()
        tail, old = self.events(m["batch"]), self.state.read()
        keys = tail.select(*self.state.keys).distinct()
        names = [f.name for f in self.state.schema.fields]
        new = self.fold(old.join(keys, self.state.keys, "left_semi"), tail).select(*[F.col(f.name).cast(f.dataType) for f in self.state.schema.fields])
        return old.join(keys, self.state.keys, "left_anti").select(*names).unionByName(new)

    def compact(self, drop: bool = False) -> bool:
        """Takes the tail into the snapshot, rewriting the buckets it touches; whether there was one. ``drop``: the batches taken in go."""
        found, m = self._batches(), self.state.manifest()
        tail = [b for b in found if b > m["batch"]]
        did = bool(tail) and self.state.change(self.events(m["batch"]), self._merge, tail[-1])
        if drop:
            for b in self._batches():
                if b <= self.state.manifest()["batch"]:
                    fs, p = _fs(self.spark, f"{self.path}/log/batch={b:010d}")
                    fs.delete(p, True)
        return did

    def _merge(self, old: DataFrame, events: DataFrame) -> DataFrame:
        keys = events.select(*self.state.keys).distinct()
        new = self.fold(old.join(keys, self.state.keys, "left_semi"), events)
        names = [f.name for f in self.state.schema.fields]
        return old.join(keys, self.state.keys, "left_anti").select(*names).unionByName(new.select(*names))
