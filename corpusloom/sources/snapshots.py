"""Tables of parts that change together: staged files, and one commit record that makes them the current ones.

A version is a small JSON text: for each table, the folder of every part (a month, a slice), and the last batch of every
stream that is in it. Files are written to new folders, which nothing reads before their version is committed, and the
record is renamed to its name in one step that fails if another writer was first. Readers keep the version they began with.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer committed this version first."""


class Snapshots:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, text: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(text)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        fs, folder = self._fs(), self._path(f"{self.root}/commits")
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def state(self, version: int | None = None) -> dict:
        """A version's record, the newest if none is named; before the first commit that of an empty version 0."""
        found = self.versions()
        if not found:
            return {"version": 0, "tables": {}, "batches": {}, "about": {}}
        stream = self._fs().open(self._path(f"{self.root}/commits/{found[-1] if version is None else version:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def new_folder(self, table: str) -> str:
        return f"{self.root}/{table}/{uuid.uuid4().hex}"

    def stage(self, df: DataFrame, table: str, part: str) -> dict[str, str]:
        """Write ``df`` in a folder for each value of ``part``, in its partitions' order: ``{value: folder}``, not yet visible."""
        folder = self.new_folder(table)
        df.write.partitionBy(part).parquet(folder)
        return self.parts_of(folder)

    def parts_of(self, folder: str) -> dict[str, str]:
        fs, at = self._fs(), self._path(folder)
        names = [f.getPath().getName() for f in fs.listStatus(at) if f.isDirectory()] if fs.exists(at) else []
        return {n.split("=", 1)[1]: f"{folder}/{n}" for n in names if "=" in n}

    def commit(self, state: dict) -> dict:
        """Make ``state`` the version after its own number. Raises ``Conflict`` if that version exists: begin again from ``state()``."""
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        state = {**state, "version": state["version"] + 1}
        fs, name = self._fs(), f"{self.root}/commits/{state['version']:012d}.json"
        draft = self._path(f"{self.root}/commits/.{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        out.close()
        options = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if ":" in self.root else fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(draft, self._path(name), options)
        except Exception as e:
            fs.delete(draft, False)
            if fs.exists(self._path(name)):
                raise Conflict(name) from e
            raise
        return state

    def read(self, table: str, schema, parts: list[str] | None = None, version: int | None = None) -> DataFrame:
        """The table's rows in a version; only the folders of ``parts``, if these are named, are listed or read."""
        folders = self.state(version)["tables"].get(table, {})
        chosen = [f for p, f in sorted(folders.items()) if parts is None or p in parts]
        if not chosen:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*chosen)


class Buckets:
    """A table of snapshots whose parts are bucketed by a key, for joins that don't move it."""

    def __init__(self, snapshots: Snapshots, name: str, part: str, key: str, buckets: int) -> None:
        self.snapshots, self.name, self.part, self.key, self.buckets = snapshots, name, part, key, buckets
        self.spark = snapshots.spark

    def stage(self, df: DataFrame) -> dict[str, str]:
        """Write ``df`` by part and bucket to new folders. Partitions that hold whole buckets give one file for each part and bucket."""
        folder, name = self.snapshots.new_folder(self.name), f"staged_{uuid.uuid4().hex}"
        df.write.format("parquet").partitionBy(self.part).bucketBy(self.buckets, self.key).sortBy(self.key).option("path", folder).saveAsTable(name)
        self.spark.sql(f"drop table {name}")  # the files stay: the table was external
        return self.snapshots.parts_of(folder)

    def table(self, state: dict, schema) -> DataFrame:
        """The version's table with its buckets. It is entered in the session's catalog, where its folders are its partitions."""
        folders = state["tables"].get(self.name, {})
        name = f"corpusloom_{self.name}_{uuid.uuid5(uuid.NAMESPACE_URL, self.snapshots.root).hex}_{state['version']}"
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
            self.spark.sql(
                f"create table {name} ({columns}) using parquet partitioned by (`{self.part}`) clustered by (`{self.key}`) sorted by (`{self.key}`) "
                f"into {self.buckets} buckets location '{self.snapshots.root}/{self.name}/none'"
            )
            entries = " ".join(f"partition (`{self.part}` = '{p}') location '{f}'" for p, f in sorted(folders.items()))
            if entries:
                self.spark.sql(f"alter table {name} add {entries}")
        return self.spark.table(name)


def part_of(key, parts: int):
    """A key's part: a number from its hash."""
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
