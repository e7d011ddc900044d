"""State of several tables and files in one folder, changed by commits.

    data/<run>/...     what a run wrote: tables in parts, and files
    commits/<n>.json   what counts after commit n: the folders of each part of each table, and the place of each file

A run writes only the parts that it changes, beside all others, and then adds one commit, by a rename that fails if
another run has taken the number. Until then nothing that counts has changed, so a run that fails anywhere leaves all
tables and files as they were, and what it wrote is removed. Rows stay with Spark; the driver holds names of parts,
so their number (buckets, days) has to be chosen small.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PART = "store_part"
BUCKETS = 64
NONE = "none"


class Conflict(Exception):
    """Another run has committed since this one began."""


class Files:
    """The few calls to the file system of a path that Spark has no reader or writer for."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm, self._gateway, self._conf = spark._jvm, spark.sparkContext._gateway, spark._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(self._conf)

    def path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        p = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self.path(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def rename(self, old: str, new: str, over: bool = False) -> None:
        """One step; without `over` it fails if the new name exists."""
        kind = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self._gateway.new_array(kind, int(over))
        if over:
            options[0] = kind.OVERWRITE
        old_path, new_path = (self.fs.makeQualified(self.path(p)) for p in (old, new))
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(old_path.toUri(), self._conf).rename(old_path, new_path, options)

    def remove(self, folder: str) -> None:
        self.fs.delete(self.path(folder), True)


class Store:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark, path)

    def commits(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names(f"{self.path}/commits") if n.endswith(".json") and n[:-5].isdigit()]

    def manifest(self, number: int) -> dict:
        """What counts after a commit; 0 is the state before the first."""
        return json.loads(self.files.read(f"{self.path}/commits/{number:012d}.json")) if number else {"tables": {}, "files": {}}

    def latest(self) -> int:
        return max(self.commits(), default=0)

    def read(self, table: str, schema: str, parts: Iterable[str] | None = None, manifest: dict | None = None) -> DataFrame:
        """The table, or some parts of it, as the newest commit (or a given one) has it; empty if there is none."""
        known = (manifest or self.manifest(self.latest()))["tables"].get(table, {})
        folders = [f"{self.path}/{f}" for p in (known if parts is None else parts) for f in known.get(p, [])]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def publish(self, out: str) -> None:
        """Copy the files of the newest commit to a folder under their names, each by a rename.

        What it does follows from the commit alone, so after a failure here it is called again.
        """
        for name, place in self.manifest(self.latest())["files"].items():
            new = f"{out}/.{name}-{uuid.uuid4().hex}"
            self.files.write(new, self.files.read(f"{self.path}/{place}"))
            self.files.rename(new, f"{out}/{name}", over=True)

    def vacuum(self, keep: int = 3) -> None:
        """Forget all but the newest commits, and what only the forgotten ones name. Runs under way keep what they wrote."""
        numbers = sorted(self.commits())
        old, kept = numbers[:-keep], numbers[-keep:]
        named = lambda ns: {f for n in ns for f in _folders(self.manifest(n))}
        gone = named(old) - named(kept)
        for n in old:  # first the commits, so that none names what is missing
            self.files.remove(f"{self.path}/commits/{n:012d}.json")
        for folder in gone:
            self.files.remove(f"{self.path}/{folder}")


def _folders(manifest: dict) -> set[str]:
    return {f for parts in manifest["tables"].values() for folders in parts.values() for f in folders} | set(manifest["files"].values())


class Change:
    """What one run does to a store, as a context: at its end all of it counts, or after an exception none of it."""

    def __init__(self, store: Store) -> None:
        self.store, self.base = store, store.latest()
        self.run = uuid.uuid4().hex
        self.before = store.manifest(self.base)
        self.after = json.loads(json.dumps(self.before))
        self._writes = 0

    def __enter__(self) -> Change:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            try:
                self._commit()
                return
            except BaseException:
                self._abort()
                raise
        self._abort()

    def read(self, table: str, schema: str, parts: Iterable[str] | None = None) -> DataFrame:
        """As it was when the run began."""
        return self.store.read(table, schema, parts, self.before)

    def put(self, table: str, rows: DataFrame, part: Column, over: Iterable[str] = ()) -> list[str]:
        """Write rows beside what their parts hold, or in the place of the parts named in `over`; the parts written.

        Names of parts consist of letters, digits and hyphens; rows without one are in `none`. A part of very many rows is written by several tasks.
        """
        self.drop(table, over)
        self._writes += 1
        folder = f"data/{self.run}/{table}-{self._writes}"
        rows.withColumn(PART, F.coalesce(part, F.lit(NONE))).hint("rebalance", PART).write.partitionBy(PART).parquet(f"{self.store.path}/{folder}")
        found = [n.partition("=")[2] for n in self.store.files.names(f"{self.store.path}/{folder}") if n.startswith(PART)]
        if bad := [p for p in found if not p.replace("-", "").isalnum()]:
            raise ValueError(f"names of parts are letters, digits and hyphens: {bad[:3]}")
        parts = self.after["tables"].setdefault(table, {})
        for p in found:
            parts.setdefault(p, []).append(f"{folder}/{PART}={p}")
        return found

    def drop(self, table: str, parts: Iterable[str]) -> None:
        for p in parts:
            self.after["tables"].get(table, {}).pop(p, None)

    def file(self, name: str, text: str) -> None:
        place = f"data/{self.run}/files/{name}"
        self.store.files.write(f"{self.store.path}/{place}", text)
        self.after["files"][name] = place

    def _commit(self) -> None:
        files, path = self.store.files, self.store.path
        new = f"{path}/commits/new-{self.run}"
        files.write(new, json.dumps(self.after))
        try:
            files.rename(new, f"{path}/commits/{self.base + 1:012d}.json")
        except Exception as e:
            files.remove(new)
            if self.store.latest() > self.base:
                raise Conflict(f"commit {self.base + 1} is another run's") from e
            raise

    def _abort(self) -> None:
        self.store.files.remove(f"{self.store.path}/data/{self.run}")


def bucket(key: str | Column, n: int = BUCKETS) -> Column:
    return F.concat(F.lit(f"{n}-"), F.pmod(F.xxhash64(key), F.lit(n)).cast("string"))


def update_buckets(change: Change, table: str, schema: str, rows: DataFrame, key: str, merge: Callable[[DataFrame, DataFrame], DataFrame], n: int = BUCKETS) -> list[str]:
    """Write merge(known, rows) over the buckets of the rows' keys alone; the buckets.

    merge gets what these buckets hold and the rows, and returns the buckets' new content. rows are read twice.
    """
    held = change.before["tables"].get(table, {})
    if other := [p for p in held if not p.startswith(f"{n}-")]:
        raise ValueError(f"{table} is kept in other buckets: {other[0]}")
    touched = sorted(r[0] for r in rows.select(bucket(key, n)).distinct().collect())  # n at most
    if touched:
        change.put(table, merge(change.read(table, schema, touched), rows), bucket(key, n), over=touched)
    return touched
