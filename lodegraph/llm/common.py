"""Shared helpers of the training-data operators.

Every operator takes and returns DataFrames.  Intermediate tables are written with
Spark's own writers into the folder named by ``spark.checkpoint.dir`` (shared by all
executors), so a lost executor costs a reread of a file and never a lost result.
"""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN: dict[str, str] = {}
_SCRATCH: list[list[str]] = []


def workspace(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only where none is configured and all runs on this machine."""
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


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Settled tables that are made inside are deleted at the end, but for those that are to be kept."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for at in _SCRATCH.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame, name: str, keep: bool = False, compression: str | None = None) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = f"{workspace(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])
    df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out.settled_at = path
    if _SCRATCH and not keep:
        _SCRATCH[-1].append(path)
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete settled tables that no later plan reads."""
    for t in tables:
        if (at := getattr(t, "settled_at", None)) is not None:
            path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(spark: SparkSession) -> int:
    """Number of partitions of a shuffle in this session."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while f"{name}__".lower() in taken or f"{name}___".lower() in taken:
        name += "_x"
    return f"{name}__"


def least_hashes(rows: DataFrame, n: int, most: int, id_col: str, *ties: str) -> DataFrame:
    """The ``most`` rows of least id hash, of about ``n`` rows.

    Rows above a bound that leaves twice as many as wanted are dropped where they are read, so what is
    sorted doesn't grow with the number of partitions; the bound is raised until enough rows are under it.
    """
    share, low = 2.0 * most / max(1, n), -(1 << 63)
    while True:
        under = rows if share >= 0.5 else rows.where(F.xxhash64(id_col) < F.lit(low + int(share * 2**64)))
        if share >= 0.5 or under.count() >= most:
            return under.orderBy(F.xxhash64(id_col), id_col, *ties).limit(most)
        share *= 4


def sliced_texts(column: pa.Array, most: int = 8_000_000) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of consecutive slices of about ``most`` bytes, nulls as empty texts.

    Only one slice at a time is turned into Python strings, whatever the Arrow batch holds.
    """
    if not len(column):
        return
    sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start = size = 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and size + n > most:
            yield start, [t or "" for t in column.slice(start, i - start).to_pylist()]
            start, size = i, 0
        size += n
    yield start, [t or "" for t in column.slice(start).to_pylist()]


def tidy() -> None:
    """Give freed memory back at the end of a task: Python workers are reused, and what they keep adds up."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
