"""Tables that are written: intermediate ones in the shared folder, and state in versions that are published as a whole.

A version holds several tables. Their files are written first, by Spark's own committer, into a folder of the run's; then one small manifest is put in place under the next number, by
a rename that fails if that number is taken. A run that fails or is killed before leaves files that no manifest names: readers see the version before, or any they ask for. A run has
a name of the caller's (its start, say); committing the same run again returns its version and writes nothing, so a retried run counts once.
"""

from __future__ import annotations

import atexit
import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_settled: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset a temporary one, if all run on this machine (tests)."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.millrace.tables.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share (master {master})")
        folder = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.millrace.tables.dir", folder)
    return folder.rstrip("/")


class Folder:
    """A folder of a Hadoop file system, from the driver."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.path = self.jvm.org.apache.hadoop.fs.Path(path)
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path.getFileSystem(self.conf)

    def child(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.path, name)

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path)) if self.fs.exists(self.path) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.child(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def move(self, draft, target, overwrite: bool) -> None:
        """One rename within the file system; where the target is there, it replaces it or fails."""
        kinds = self.jvm.org.apache.hadoop.fs.Options.Rename
        how = self.gateway.new_array(kinds, 1)
        how[0] = kinds.OVERWRITE if overwrite else kinds.NONE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(draft, target, how)

    def put(self, name: str, text: str) -> bool:
        """A file put in place whole; false if one of that name is there already."""
        draft = self.child(f".{uuid.uuid4().hex}")
        out = self.fs.create(draft, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        try:
            self.move(draft, self.child(name), False)
            return True
        except Exception as e:
            self.fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise

    def delete(self, name: str | None = None) -> None:
        self.fs.delete(self.child(name) if name else self.path, True)


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that what is derived from it several times computes it once; deleted when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/millrace-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _settled:
        atexit.register(remove_settled)
    _settled.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def remove_settled() -> None:
    while _settled:
        spark, path = _settled.pop()
        try:
            Folder(spark, path).delete()
        except Exception:  # the session has already ended
            return


class NotCommitted(Exception):
    """Another run published the version this one was made for."""


class Versions:
    """Versions of a set of tables under ``root``: ``_versions/<number>.json`` names the run and each table's folder and schema."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.manifests = Folder(spark, f"{self.root}/_versions")
        self.manifests.fs.mkdirs(self.manifests.path)

    def numbers(self) -> list[int]:
        return [int(m[1]) for n in self.manifests.names() if (m := re.fullmatch(r"(\d{10})\.json", n))]

    def manifest(self, version: int) -> dict:
        return json.loads(self.manifests.read(f"{version:010d}.json"))

    def latest(self) -> int:
        """0 before the first."""
        return max(self.numbers(), default=0)

    def read(self, table: str, schema: StructType, version: int | None = None) -> DataFrame:
        """A table of a version, the latest by default; empty where the version, or the table in it, isn't there yet. Columns added to the schema since are null."""
        version = self.latest() if version is None else version
        own = self.manifest(version)["tables"].get(table) if version else None
        return self.spark.read.schema(schema).parquet(f"{self.root}/{own}") if own else self.spark.createDataFrame([], schema)

    def of_run(self, run: str) -> int | None:
        return next((v for v in reversed(self.numbers()) if self.manifest(v)["run"] == run), None)

    def commit(self, run: str, tables: dict[str, DataFrame], base: int) -> int:
        """The number of the version that ``run`` published: tables made from version ``base``, with those of ``base`` that aren't given carried over."""
        done = self.of_run(run)
        if done is not None:
            return done
        folder = f"data/{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{folder}/{name}")
        named = (self.manifest(base)["tables"] if base else {}) | {name: f"{folder}/{name}" for name in tables}
        return self.publish(run, folder, named, base)

    def publish(self, run: str, folder: str, named: dict[str, str], base: int) -> int:
        """Put the manifest after ``base`` in place, whose new files are in ``folder``; if that number is taken, they are deleted."""
        if not self.manifests.put(f"{base + 1:010d}.json", json.dumps({"run": run, "base": base, "tables": named})):
            Folder(self.spark, f"{self.root}/{folder}").delete()
            raise NotCommitted(f"version {base + 1} is taken; run {run} has to be made again from it")
        return base + 1

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete the manifests but the last ``keep``, and data folders that none of these names; run it while no run is under way. Returns the folders deleted."""
        numbers = self.numbers()
        for v in numbers[:-keep]:
            self.manifests.delete(f"{v:010d}.json")
        used = {path.split("/")[1] for v in numbers[-keep:] for path in self.manifest(v)["tables"].values()}
        data = Folder(self.spark, f"{self.root}/data")
        gone = [n for n in data.names() if n not in used]
        for n in gone:
            data.delete(n)
        return gone
