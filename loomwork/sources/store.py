"""Tables under one root, of which commits name a snapshot each: several change together or not at all.

A commit is a numbered manifest; the highest counts. It names, for each table, a folder of rows and the small folders of changes since, which
readers merge: the last change of a key counts. Data is written first and the manifest renamed into place last, so a writer that fails leaves
folders that nothing names, and a reader goes on with the commit that it began with. Two writers of the same table collide: one of them fails;
writers of different tables do not.
"""

from __future__ import annotations

import json
import uuid
from types import TracebackType

from pyspark.sql import DataFrame, SparkSession

from ..operators import incremental
from ..operators.retrieval import small

#: Folders of changes after which a table is written anew, and manifests that ``vacuum`` keeps.
COMPACTED, KEPT = 8, 2
_RETRIES = 5


class Store:
    """Parquet tables under a root that Hadoop's file systems reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        at = self._path("_commits")
        if not self._fs().exists(at):
            return []
        found = (s.getPath().getName() for s in self._fs().listStatus(at))
        return sorted(int(n) for n in found if n.isdigit())

    def _manifest(self, number: int) -> dict:
        return json.loads(self.spark.read.text(self._path("_commits", f"{number:012d}").toString()).head()[0])

    def head(self) -> tuple[int, dict]:
        """The number and the manifest of the commit that counts: ``tables`` and ``batches``. A manifest may go while it is read, where a vacuum
        came in between: then the next higher one is read."""
        for _ in range(_RETRIES):
            numbers = self._numbers()
            if not numbers:
                return 0, {"tables": {}, "batches": {}}
            if self._fs().exists(self._path("_commits", f"{numbers[-1]:012d}")):
                return numbers[-1], self._manifest(numbers[-1])
        raise OSError("commits come and go too often to be read")

    def current(self, name: str) -> str | None:
        """What names the state of a table; it differs after each change."""
        entry = self.head()[1]["tables"].get(name)
        return None if entry is None else "+".join([entry["base"], *(d["folder"] for d in entry["deltas"])])

    def read(self, name: str) -> DataFrame | None:
        return self._merged(name, self.head()[1]["tables"].get(name))

    def _merged(self, name: str, entry: dict | None) -> DataFrame | None:
        if entry is None:
            return None
        rows = self.spark.read.parquet(f"{self.root}/{name}/{entry['base']}")
        for d in entry["deltas"]:  # at most COMPACTED
            own = self.spark.read.parquet(f"{self.root}/{name}/{d['folder']}")
            if d["kind"] != "add":
                rows = rows.join(small(own.select(*d["key"])), d["key"], "left_anti").select(*rows.columns)
            rows = rows if d["kind"] == "delete" else rows.unionByName(own, allowMissingColumns=True)
        return rows

    def transaction(self) -> Transaction:
        return Transaction(self)

    def replace(self, name: str, df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
        """A commit of one table, written in folders by ``partition_by``."""
        with self.transaction() as t:
            t.replace(name, df, partition_by)
        return self.read(name)

    def upsert(self, name: str, df: DataFrame, key: list[str], order: str) -> DataFrame:
        """A commit of rows that replace those of their keys; of one key's the last by ``order``."""
        with self.transaction() as t:
            t.upsert(name, df, key, order)
        return self.read(name)

    def insert_new(self, name: str, df: DataFrame, key: str, order: str) -> DataFrame:
        """A commit of the rows whose keys the table has not; of one key's the first by ``order``."""
        old = self.read(name)
        own = incremental.first_wins((df if old is None else old).limit(0).select(*df.columns), df, key, order)
        with self.transaction() as t:
            t.add(name, own if old is None else own.join(old.select(key).distinct(), key, "left_anti"))
        return self.read(name)

    def vacuum(self, keep: int = KEPT) -> int:
        """Delete all but the last ``keep`` manifests, and the folders that none of those names; their number. Not while others write."""
        numbers, fs = self._numbers(), self._fs()
        named: set[tuple[str, str]] = set()
        for n in numbers[-keep:]:
            for name, e in self._manifest(n)["tables"].items():
                named |= {(name, e["base"]), *((name, d["folder"]) for d in e["deltas"])}
        for n in numbers[:-keep]:
            fs.delete(self._path("_commits", f"{n:012d}"), False)
        gone = 0
        for name in {name for n in numbers[-1:] for name in self._manifest(n)["tables"]}:
            for s in fs.listStatus(self._path(name)):
                if (name, s.getPath().getName()) not in named:
                    gone += fs.delete(s.getPath(), True)
        return gone

    def append(self, name: str, df: DataFrame) -> None:
        """For logs: rows are added to a folder of their own, outside commits."""
        df.write.mode("append").parquet(f"{self.root}/{name}-log")

    def log(self, name: str) -> DataFrame | None:
        at = self._path(f"{name}-log")
        return self.spark.read.parquet(at.toString()) if self._fs().exists(at) else None


class Transaction:
    """Changes of several tables that one manifest makes count, when the block ends without an exception. It reads its own changes."""

    def __init__(self, store: Store):
        self.store = store
        self.number, base = store.head()
        self.tables, self.batches = dict(base["tables"]), dict(base.get("batches", {}))
        self.changed: set[str] = set()
        self.stream: tuple[str, int] | None = None

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind: type[BaseException] | None, error: BaseException | None, trace: TracebackType | None) -> None:
        if kind is None and (self.changed or self.stream):
            self._commit()

    def read(self, name: str) -> DataFrame | None:
        return self.store._merged(name, self.tables.get(name))

    def _written(self, name: str, df: DataFrame, partition_by: tuple[str, ...] = ()) -> str:
        folder = uuid.uuid4().hex
        df.write.partitionBy(*partition_by).parquet(f"{self.store.root}/{name}/{folder}")
        self.changed.add(name)
        return folder

    def replace(self, name: str, df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
        self.tables[name] = {"base": self._written(name, df, partition_by), "deltas": []}
        return self.read(name)

    def _change(self, name: str, df: DataFrame, kind: str, key: list[str]) -> DataFrame:
        if len(self.tables[name]["deltas"]) >= COMPACTED:
            self.replace(name, self.read(name))
        entry = self.tables[name]
        self.tables[name] = {"base": entry["base"], "deltas": [*entry["deltas"], {"folder": self._written(name, df), "kind": kind, "key": key}]}
        return self.read(name)

    def upsert(self, name: str, df: DataFrame, key: list[str], order: str) -> DataFrame:
        """Rows that replace those of their keys, which are not null. They are written by themselves; after ``COMPACTED`` changes the table is
        written anew."""
        own = incremental.last_wins(df.limit(0), df, key, order)
        return self._change(name, own, "upsert", key) if name in self.tables else self.replace(name, own)

    def add(self, name: str, df: DataFrame) -> DataFrame:
        """Further rows."""
        return self._change(name, df, "add", []) if name in self.tables else self.replace(name, df)

    def delete(self, name: str, keys: DataFrame, key: list[str]) -> DataFrame | None:
        """The rows of ``keys`` go."""
        return self._change(name, keys.select(*key).distinct(), "delete", key) if name in self.tables else None

    def once(self, stream: str, batch: int) -> bool:
        """Whether ``batch`` of a stream is not in yet; if so, this transaction counts as its. A batch that comes again changes nothing."""
        if batch <= self.batches.get(stream, -1):
            return False
        self.stream = (stream, batch)
        self.batches[stream] = batch
        return True

    def _commit(self) -> None:
        fs = self.store._fs()
        for _ in range(_RETRIES):
            number, head = self.store.head()
            if number != self.number:
                # What others have changed since stays, unless it is the same.
                base = {} if not self.number else self.base_tables()
                clash = [n for n in self.changed if head["tables"].get(n) != base.get(n)]
                if clash or (self.stream and head.get("batches", {}).get(self.stream[0], -1) >= self.stream[1]):
                    raise OSError(f"{', '.join(sorted(clash)) or self.stream[0]} was written by another at the same time")
                tables = head["tables"] | {n: self.tables[n] for n in self.changed}
                batches = head.get("batches", {}) | ({self.stream[0]: self.stream[1]} if self.stream else {})
            else:
                tables, batches = self.tables, self.batches
            at, new = self.store._path("_commits", f"{number + 1:012d}"), self.store._path("_commits", f".{uuid.uuid4().hex}")
            out = fs.create(new, True)
            out.write(bytearray(json.dumps({"tables": tables, "batches": batches}).encode()))
            out.close()
            if not fs.exists(at) and fs.rename(new, at):
                return
            fs.delete(new, False)
        raise OSError("the store is written too often to be written to")

    def base_tables(self) -> dict:
        """The tables of the commit that this transaction began with."""
        return self.store._manifest(self.number)["tables"]


def write_jsonl(df: DataFrame, path: str, split: str | None = "split") -> None:
    """JSON lines, a folder a split."""
    (df.write.mode("overwrite").partitionBy(split) if split else df.write.mode("overwrite")).json(path)


def write_report(spark: SparkSession, path: str, report: dict) -> None:
    """One JSON document."""
    spark.createDataFrame([(json.dumps(report, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
