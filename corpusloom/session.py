"""Session settings, and the package's way to the executors."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
_MADE: list[tuple[SparkSession, str]] = []


def build(app: str = "corpusloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this engine expects; conf overrides them."""
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**defaults, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, for checkpoints and written tables.

    A cluster names it in spark.checkpoint.dir; only where that is unset and
    everything runs in one process, as in tests, a temporary folder of this
    machine is used.
    """
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), "corpusloom-shared")
    return path


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


@atexit.register
def _clean() -> None:
    for spark, path in _MADE:
        with contextlib.suppress(Exception):  # the session may be gone
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the Python workers, once an application."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        root = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp()
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        target = os.path.join(folder, "corpusloom.zip")
        with zipfile.ZipFile(target, "w") as z:
            for at, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(at, name)
                        z.write(full, os.path.relpath(full, os.path.dirname(root)))
        sc.addPyFile(target)
        _SHIPPED.add(sc.applicationId)
    return spark


def bounded(spark: SparkSession) -> SparkSession:
    """Ships the package and bounds what one Arrow batch holds, so that a Python worker's memory does not follow the rows of its task."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return ship(spark)
