"""Tables that grow by runs: a manifest of committed runs over bucketed Parquet files.

Each run is a folder of Parquet files, bucketed and sorted by one key column,
under ``<path>/data``; every try to write a run has a folder of its own. What
counts as written is told by the manifest alone: numbered JSON files under
``<path>/manifest``, each with the table's columns, its number of buckets and the
whole list of committed runs. A new one is written aside and renamed to the next
number; if that number is there already, another writer was first and the
commit is tried again on top of it. So a run is there wholly or not at all:
files that a failed or repeated job left behind are in no manifest, and a run
that is committed already is not written twice.

Readers get a Spark table over the committed partitions, whose scan keeps the
buckets: grouping by the key, and joining on it, need no shuffle of the table.
``compact`` writes the rows worth keeping as one run that replaces the others.

Defined results: a table without runs, or whose runs are empty, reads as no rows
with the table's columns; a null key is in one bucket; repeated rows stay.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Files:
    """The few file operations a manifest needs, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm = spark.sparkContext._jvm
        self.fs = self.path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.root = self.fs.makeQualified(self.path(path)).toString().rstrip("/")

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def exists(self, p: str) -> bool:
        return self.fs.exists(self.path(p))

    def names(self, p: str) -> list[str]:
        return [x.getPath().getName() for x in self.fs.listStatus(self.path(p))] if self.exists(p) else []

    def read(self, p: str) -> str:
        s = self.fs.open(self.path(p))
        try:
            return bytes(s.readAllBytes()).decode()
        finally:
            s.close()

    def publish(self, p: str, text: str) -> bool:
        """Writes a file that appears whole; False if the name is taken."""
        aside = f"{p.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
        s = self.fs.create(self.path(aside), False)
        s.write(bytearray(text.encode()))
        s.close()
        if not self.exists(p) and self.fs.rename(self.path(aside), self.path(p)):
            return True
        self.fs.delete(self.path(aside), False)
        return False


@dataclass(frozen=True)
class RunTable:
    """``schema``: the columns as DDL, ``run_id`` not among them, ``key``: the bucketing column and
    ``buckets`` (the session's shuffle partitions): as a new table gets them; a table that is there
    keeps its own."""

    spark: SparkSession
    path: str
    schema: str
    key: str
    buckets: int | None = None

    @property
    def files(self) -> Files:
        return Files(self.spark, self.path)

    def manifest(self) -> tuple[int, dict]:
        """(number of the newest manifest, its content); before the first commit (0, no runs)."""
        f = self.files
        numbers = [int(n[:-5]) for n in f.names(f"{f.root}/manifest") if n.endswith(".json") and n[:-5].isdigit()]
        if not numbers:
            buckets = self.buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            return 0, {"schema": self.schema, "buckets": buckets, "runs": {}}
        return max(numbers), json.loads(f.read(f"{f.root}/manifest/{max(numbers):08d}.json"))

    def runs(self) -> dict[str, int]:
        """Committed runs and their rows."""
        return {r: x["rows"] for r, x in self.manifest()[1]["runs"].items()}

    def _commit(self, change: Callable[[dict], dict]) -> None:
        f = self.files
        while True:
            number, known = self.manifest()
            if f.publish(f"{f.root}/manifest/{number + 1:08d}.json", json.dumps(known | {"runs": change(known["runs"])})):
                return

    def _table(self) -> str:
        """The name of a Spark table over the files, made once a session; its partitions follow the manifest."""
        root, known = self.files.root, self.manifest()[1]
        schema, buckets = known["schema"], known["buckets"]
        name = f"lumenvec_runs_{hashlib.md5(f'{root}:{schema}:{buckets}'.encode()).hexdigest()}"
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(
                f"CREATE TABLE {name} ({schema}, run_id STRING) USING parquet PARTITIONED BY (run_id) "
                f"CLUSTERED BY ({self.key}) SORTED BY ({self.key}) INTO {buckets} BUCKETS LOCATION '{root}/data'"
            )
        return name

    def append(self, rows: DataFrame, run_id: str) -> int:
        """Writes and commits a run; returns its rows. A run that is committed already is left as it is."""
        if run_id in (done := self.runs()):
            return done[run_id]
        written = self._write(rows, run_id)
        self._commit(lambda runs: {run_id: written} | runs)  # whoever commits a run first has written it
        return self.runs()[run_id]

    def _write(self, rows: DataFrame, run_id: str) -> dict:
        name, root = self._table(), self.files.root
        buckets, folder = self.manifest()[1]["buckets"], f"{run_id}~{uuid.uuid4().hex}"
        columns = [F.col(f.name).cast(f.dataType) for f in self.spark.table(name).schema.fields[:-1]]
        view = f"rows_{uuid.uuid4().hex}"
        # The same hash as the buckets': each task writes one file.
        rows.select(*columns).repartition(buckets, self.key).createOrReplaceTempView(view)
        try:
            self.spark.sql(f"INSERT INTO {name} PARTITION (run_id = {_quoted(folder)}) SELECT * FROM {view}")
        finally:
            self.spark.catalog.dropTempView(view)
        there = f"{root}/data/run_id={_escaped(self.spark, folder)}"
        plain = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.spark.table(name).schema.fields[:-1])
        n = self.spark.read.schema(plain).parquet(there).count() if self.files.exists(there) else 0
        return {"folder": folder, "rows": n}

    def read(self) -> DataFrame:
        """The rows of all committed runs, with ``run_id``."""
        name = self._table()
        known = [r["partition"].removeprefix("run_id=") for r in self.spark.sql(f"SHOW PARTITIONS {name}").collect()]
        want = {_escaped(self.spark, x["folder"]): x["folder"] for x in self.manifest()[1]["runs"].values()}
        for escaped in set(known) - want.keys():
            self.spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION (run_id = {_quoted(_unescaped(self.spark, escaped))})")
        if missing := [f for e, f in want.items() if e not in known]:
            parts = " ".join(f"PARTITION (run_id = {_quoted(f)})" for f in missing)
            self.spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS {parts}")
        self.spark.catalog.refreshTable(name)
        return self.spark.table(name).withColumn("run_id", F.regexp_replace("run_id", "~[0-9a-f]{32}$", ""))

    def compact(self, kept: Callable[[DataFrame], DataFrame], run_id: str | None = None) -> int:
        """Replaces the runs committed so far by one run, ``kept`` of their rows, in the same
        buckets. Runs committed meanwhile stay. Old folders are left for the owner to remove."""
        before, run_id = set(self.runs()), run_id or f"compact-{uuid.uuid4().hex}"
        written = self._write(kept(self.read()), run_id)
        self._commit(lambda runs: {r: x for r, x in runs.items() if r not in before} | {run_id: written})
        return written["rows"]


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _escaped(spark: SparkSession, value: str) -> str:
    """A partition value as Spark names its folder."""
    return spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)


def _unescaped(spark: SparkSession, name: str) -> str:
    return spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(name)
