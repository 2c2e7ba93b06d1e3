"""Folders of tables with numbered commits: what a job has done so far, for the job that goes on."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Commits:
    """Numbered commits in a folder any executor and driver can reach: small JSON files, each renamed into place once its tables are written."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def last(self) -> dict | None:
        """The newest commit, None where there is none."""
        if not self._fs.exists(self._path(self.folder)):
            return None
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        done = sorted(n for n in names if n.startswith("commit-") and n.endswith(".json"))
        if not done:
            return None
        lines = self.spark.read.text(f"{self.folder}/{done[-1]}").collect()  # one short line
        return json.loads(lines[0][0])

    def write(self, df: DataFrame, by: str | None = None) -> str:
        """A table under a name of its own, in a folder for each value of by; no reader sees it until a commit names it."""
        name = f"table-{uuid.uuid4().hex}"
        (df.write.partitionBy(by) if by else df.write).parquet(f"{self.folder}/{name}")
        return name

    def folders(self, name: str) -> dict[str, str]:
        """The folders of a table written by a column, by value."""
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.folder}/{name}"))]
        return {f.split("=", 1)[1]: f"{name}/{f}" for f in found if "=" in f}

    def read(self, names: list[str], schema) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{n}" for n in names])

    def commit(self, state: dict) -> dict:
        """Publish a state as the next commit; an error if another run has published that number."""
        state = state | {"commit": state.get("commit", -1) + 1}
        name = f"commit-{state['commit']:09d}.json"
        draft = self._path(f"{self.folder}/.draft-{uuid.uuid4().hex}")
        self._fs.mkdirs(self._path(self.folder))
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(state), "utf8"))
        out.close()
        if self._fs.exists(self._path(f"{self.folder}/{name}")) or not self._fs.rename(draft, self._path(f"{self.folder}/{name}")):
            raise RuntimeError(f"{name} is there already: another run works on {self.folder}")
        return state
