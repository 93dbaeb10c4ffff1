"""Session defaults, table access and shared scratch storage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a table counts as small enough to broadcast, and of a value of each type in memory (others count as text).
BROADCAST_BYTES = 32 << 20
_BYTES = {"boolean": 1, "int": 4, "float": 4, "bigint": 8, "double": 8, "timestamp": 8}


def build_session(master: str = "local[*]", app: str = "lodestone", **conf: str) -> SparkSession:
    """A session with the engine's defaults; further settings by keyword (dots written as ``__``)."""
    b = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once a context, so that Python workers can import it from anywhere."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    package = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="lodestone-ship-")) / f"{package.name}.zip"
    atexit.register(shutil.rmtree, at.parent, ignore_errors=True)
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(at))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; a temporary one only on a local master without it."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    at = tempfile.mkdtemp(prefix="lodestone-")
    spark.conf.set("spark.checkpoint.dir", f"file://{at}")
    atexit.register(shutil.rmtree, at, ignore_errors=True)
    return f"file://{at}"


def _remove(spark: SparkSession, at: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session is gone; the folder's owner clears it
        if at.startswith("file://"):
            shutil.rmtree(at[7:], ignore_errors=True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive the loss of executors.

    tidy: the shuffle files of a write go when it ends, not when the driver happens to collect its garbage.
    """

    def __init__(self, spark: SparkSession, name: str, tidy: bool = False):
        ship(spark)
        self.spark, self.tidy = spark, tidy
        self.root = f"{shared_dir(spark)}/lodestone-{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        if os.environ.get("LODESTONE_KEEP_SCRATCH") != "1":
            atexit.register(_remove, spark, self.root)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        at = self.path(name)
        before = self.spark.conf.get(_CLEANUP, "false")
        try:
            self.spark.conf.set(_CLEANUP, "true" if self.tidy else before)
            df.write.option("compression", codec).parquet(at)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self) -> None:
        _remove(self.spark, self.root)


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Marks a stored, narrow table for broadcast if a count shows that it takes at most ``most`` bytes; else leaves it to a shuffled join."""
    width = 40 + sum(_BYTES.get(f.dataType.simpleString(), 40) for f in df.schema)
    rows = max(1, most // width)
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
