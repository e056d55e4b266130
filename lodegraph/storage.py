"""Tables on Parquet: versions that readers see as a whole, and written cuts of long plans."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def workspace(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` where it is set, else a temporary folder if all runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="lodegraph-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return _OWN[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that iterations keep short plans."""
    path = f"{workspace(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Catalog:
    """Named tables under a root, for one writer and any number of readers.

    A version is a numbered file under ``<name>/_versions`` that lists the folders of its rows.  It is written
    beside and renamed into place once its rows are there; readers take the greatest number.  So a crash
    leaves the version before, and readers of an old version keep their files.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, at: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self, name: str) -> list[int]:
        path, fs = self._fs(f"{self.root}/{name}/_versions")
        if not fs.exists(path):
            return []
        return sorted(int(n) for f in fs.listStatus(path) if (n := f.getPath().getName()).isdigit())

    def exists(self, name: str) -> bool:
        return bool(self.versions(name))

    def _folders(self, name: str) -> list[str]:
        path, fs = self._fs(f"{self.root}/{name}/_versions/{self.versions(name)[-1]:012d}")
        stream = fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode().split()
        finally:
            stream.close()

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.root}/{name}/{v}" for v in self._folders(name)])

    def _show(self, name: str, folders: list[str]) -> None:
        number = (self.versions(name) or [0])[-1] + 1
        final, fs = self._fs(f"{self.root}/{name}/_versions/{number:012d}")
        staged, _ = self._fs(f"{self.root}/{name}/_staged-{uuid.uuid4().hex}")
        out = fs.create(staged)
        out.write("\n".join(folders).encode())
        out.close()
        fs.mkdirs(final.getParent())
        if fs.exists(final) or not fs.rename(staged, final):
            raise RuntimeError(f"another writer made version {number} of {name}")

    def _rows(self, name: str, df: DataFrame) -> str:
        folder = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}/{folder}")
        return folder

    def replace(self, name: str, df: DataFrame) -> DataFrame:
        self._show(name, [self._rows(name, df)])
        return self.read(name)

    def upsert(self, name: str, rows: DataFrame, keys: list[str]) -> DataFrame:
        """Rows replace those of equal keys; among rows of equal keys the last one counts."""
        cols = rows.columns
        last = rows.withColumn("__n", F.monotonically_increasing_id()).groupBy(*keys).agg(F.max_by(F.struct(*cols), "__n").alias("__r")).select("__r.*")
        if not self.exists(name):
            return self.replace(name, last)
        old = self.read(name)
        last = written(last, "upsert")
        return self.replace(name, old.join(last.select(*keys), keys, "left_anti").select(*old.columns).unionByName(last, allowMissingColumns=True))

    def append(self, name: str, rows: DataFrame) -> DataFrame:
        """The rows are written beside the table's, which stay where they are."""
        self._show(name, [*(self._folders(name) if self.exists(name) else []), self._rows(name, rows)])
        return self.read(name)
