"""A store of several tables that change together, for streams that may stop at any point.

Every table is a folder of versions (``<table>/v=<n>``), written whole and never
changed. A commit is one small file, ``commits/<n>.json``, that names a version of
every table; it is written last and appears by one rename. Readers see the tables
of the highest commit, so a batch that stops between two tables changes nothing,
and its versions are written over when the batch comes again.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


class TableStore:
    """Tables below ``folder``, any file system that Spark writes to; renames there must be atomic. One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str, schemas: dict[str, str]) -> None:
        self.spark, self.folder, self.schemas = spark, folder.rstrip("/"), schemas
        self._jvm = spark.sparkContext._jvm

    def _fs(self):  # noqa: ANN202
        path = self._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def commits(self) -> list[int]:
        fs, path = self._fs(), self._path("commits")
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("_"))

    def state(self) -> dict:
        """The last commit: ``number``, ``batch`` (of the stream, or None) and ``versions`` by table."""
        done = self.commits()
        if not done:
            return {"number": 0, "batch": None, "versions": {}}
        return json.loads(self.spark.read.text(f"{self.folder}/commits/{done[-1]}.json", wholetext=True).first()[0])

    def read(self, name: str) -> DataFrame:
        """The table as of the last commit; empty before the first."""
        version = self.state()["versions"].get(name)
        if version is None:
            return self.spark.createDataFrame([], self.schemas[name])
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.folder}/{name}/v={version}")

    def commit(self, tables: dict[str, DataFrame], batch: int | None = None) -> bool:
        """Write new versions of ``tables`` and make all of them visible at once; tables not given stay.

        False, and nothing is written, if ``batch`` was committed before.
        """
        now = self.state()
        if batch is not None and now["batch"] is not None and batch <= now["batch"]:
            return False
        number = now["number"] + 1
        for name, rows in tables.items():
            self._write(name, rows, number)
        record = {"number": number, "batch": now["batch"] if batch is None else batch, "versions": now["versions"] | {n: number for n in tables}}
        fs = self._fs()
        fs.mkdirs(self._path("commits"))
        draft = self._path("commits", f"_{number}.json.tmp")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(record).encode()))
        out.close()
        target = self._path("commits", f"{number}.json")
        if fs.exists(target) or not fs.rename(draft, target):
            raise RuntimeError(f"commit {number} was made by another writer")
        return True

    def _write(self, name: str, rows: DataFrame, number: int) -> None:
        columns = self.spark.createDataFrame([], self.schemas[name]).columns
        rows.select(*columns).write.mode("overwrite").parquet(f"{self.folder}/{name}/v={number}")

    def expire(self, keep: int = 2) -> None:
        """Delete versions that none of the last ``keep`` commits names, and older commits."""
        fs, done = self._fs(), self.commits()
        held: dict[str, set] = {n: set() for n in self.schemas}
        for number in done[-keep:]:
            for name, v in json.loads(self.spark.read.text(f"{self.folder}/commits/{number}.json", wholetext=True).first()[0])["versions"].items():
                held.setdefault(name, set()).add(v)
        for number in done[:-keep]:
            fs.delete(self._path("commits", f"{number}.json"), False)
        for name, versions in held.items():
            path = self._path(name)
            for status in fs.listStatus(path) if fs.exists(path) else []:
                found = status.getPath().getName().removeprefix("v=")
                if found.isdigit() and int(found) not in versions and (not done or int(found) <= done[-1]):
                    fs.delete(status.getPath(), True)
