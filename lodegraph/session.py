"""Session helpers: a tuned local session, and shipping of this package to executors."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_SHIPPED: set[str] = set()
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def local_session(cpus: int | str = "*", shuffle: int = 8, app: str = "lodegraph") -> SparkSession:
    """A session for one machine; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the executors unless their PYTHONPATH holds it already; whole texts travel to Python in
    small batches unless the session sets a size of its own."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, "300")
    paths = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    app = spark.sparkContext.applicationId
    if os.path.realpath(ROOT) in paths or app in _SHIPPED:
        return
    out = os.path.join(tempfile.mkdtemp(prefix="lodegraph-ship-"), "lodegraph_pkg.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(os.path.join(ROOT, "lodegraph")):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, ROOT))
        if os.path.exists(p := os.path.join(ROOT, "corpus_pipeline.py")):
            z.write(p, "corpus_pipeline.py")
    spark.sparkContext.addPyFile(out)
    _SHIPPED.add(app)


def shipped(f):
    @functools.wraps(f)
    def call(spark, sf_dir):
        ship(spark)
        return f(spark, sf_dir)

    return call
