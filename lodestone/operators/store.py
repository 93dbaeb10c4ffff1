"""A versioned chunk store on Parquet: append, update, delete, dedupe and compaction with atomic publication.

A version is a small JSON manifest that lists data folders by hash bucket of ``source``. Writers add files in a new folder and then
create the next manifest, whose name can only be created once; readers take the highest. Deletes and updates rewrite the buckets they
touch and leave the others as they are. Every row has ``seq``, a number that grows with ingestion within a source: "first seen" and
"keep the first" go by it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import text as tx
from ..session import broadcast_if_small

CHUNKS = "text string, vector array<float>, source string, chunk_index long, category string, doc_id string, ingested_at string, seq long"


class ConcurrentCommit(RuntimeError):
    """Another writer published a version first; nothing was changed."""


class Store:
    def __init__(self, spark: SparkSession, path: str, schema: str = CHUNKS, key: str = "source", buckets: int = EngineConfig.store_buckets):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = spark.createDataFrame([], schema).schema
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # versions

    def version(self) -> int:
        """The current version; 0 if the store doesn't exist."""
        at = self._path(f"{self.path}/versions")
        if not self._fs.exists(at):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def exists(self) -> bool:
        return self.version() > 0 and not self._manifest().get("dropped", False)

    def _manifest(self, version: int | None = None) -> dict:
        v = self.version() if version is None else version
        if v == 0:
            return {"parts": [], "seq_end": 0}
        stream = self._fs.open(self._path(f"{self.path}/versions/{v:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, base: int, manifest: dict) -> int:
        final = self._path(f"{self.path}/versions/{base + 1:012d}.json")
        temp = self._path(f"{self.path}/versions/_{uuid.uuid4().hex}")
        out = self._fs.create(temp, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(temp, final):
            self._fs.delete(temp, False)
            raise ConcurrentCommit(f"version {base + 1} exists")
        return base + 1

    def read(self, version: int | None = None) -> DataFrame:
        parts = self._manifest(version)["parts"]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{d}/bucket={b}" for d, b in parts])

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.coalesce(F.col(self.key).cast("string"), F.lit(""))), F.lit(self.buckets)).cast("int")

    def _write(self, df: DataFrame) -> list[list]:
        folder = uuid.uuid4().hex
        at = f"{self.path}/data/{folder}"
        # a bucket's rows may be many: they are spread over files by a second hash, not sent to one task
        spread = F.pmod(F.xxhash64(*[c for c in ("doc_id", "chunk_index", "seq") if c in self.schema.names]), F.lit(8))
        df.select(*self.schema.names).withColumn("bucket", self._bucket()).repartition(F.col("bucket"), spread).write.partitionBy("bucket").parquet(at)
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(at))]
        return [[folder, int(n[7:])] for n in sorted(found) if n.startswith("bucket=")]

    # changes

    def create(self) -> int:
        v = self.version()
        return v if self.exists() else self._publish(v, {"parts": [], "seq_end": 0})

    def _end(self, m: dict) -> int:
        """The number after the last; older manifests, which counted in steps of a fixed size, don't name it."""
        if "seq_end" in m:
            return m["seq_end"]
        parts = m["parts"]
        last = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{d}/bucket={b}" for d, b in parts]).agg(F.max("seq")).first()[0] if parts else None
        return 0 if last is None else last + 1

    def _add(self, df: DataFrame, first: int) -> tuple[list[list], int]:
        """Writes rows with a ``seq`` of their own, above all before: the parts, and the number after the last that was given.

        Rows are numbered in the order of the input's seq if it has one, over the whole input, so that no key's rows meet in one
        task. Numbers have gaps, as no task counts them all.
        """
        if "seq" in df.columns:
            df = df.orderBy("seq", *[c for c in (self.key, "doc_id", "chunk_index") if c in df.columns and c != "seq"])
        last = Observation(f"seq-{uuid.uuid4().hex}")
        rows = df.withColumn("seq", F.lit(first) + F.monotonically_increasing_id()).observe(last, F.max("seq").alias("last"))
        parts = self._write(rows)
        end = last.get["last"]
        return parts, first if end is None else end + 1

    def append(self, df: DataFrame, base: int | None = None) -> int:
        """Adds rows; seq is given here, in the order of the input's ``seq`` if it has one. Returns the version."""
        v = self.version() if base is None else base
        m = self._manifest(v)
        parts, end = self._add(df, self._end(m))
        return self._publish(v, {"parts": m["parts"] + parts, "seq_end": end})

    def replace(self, where: Column | None = None, added: DataFrame | None = None, by: Column | None = None, values: DataFrame | None = None) -> tuple[int, int]:
        """Takes out the rows for which ``where`` is true, or ``by`` is one of ``values`` (one column), and adds others, in one version: (version, rows taken out).

        Only buckets that hold such rows are rewritten. A null condition keeps its row.
        """
        v = self.version()
        m = self._manifest(v)

        def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
            if values is None:
                hit = F.coalesce(where, F.lit(False))
                return rows.filter(hit), rows.filter(~hit)
            asked = broadcast_if_small(values.toDF("_value").distinct())
            keyed = rows.withColumn("_value", by)
            return tuple(keyed.join(asked, "_value", how).select(*rows.columns) for how in ("left_semi", "left_anti"))

        hit = split(self.read(v))[0].groupBy(self._bucket().alias("b")).agg(F.count("*").alias("n")).collect()  # at most a row for each bucket
        touched = {r.b for r in hit}
        parts = [p for p in m["parts"] if p[1] not in touched]
        old = [p for p in m["parts"] if p[1] in touched]
        if old:
            rows = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{d}/bucket={b}" for d, b in old])
            parts += self._write(split(rows)[1])
        end = self._end(m)
        if added is not None:
            new, end = self._add(added, end)
            parts += new
        return self._publish(v, {"parts": parts, "seq_end": end}), sum(r.n for r in hit)

    def overwrite(self, df: DataFrame) -> int:
        """A version with these rows only, published once they are written."""
        v = self.version()
        parts, end = self._add(df, self._end(self._manifest(v)))
        return self._publish(v, {"parts": parts, "seq_end": end})

    def drop(self) -> int:
        v = self.version()
        return self._publish(v, {"parts": [], "seq_end": 0, "dropped": True})

    def compact(self) -> int:
        """Rewrites buckets that lie in several folders as one."""
        v = self.version()
        m = self._manifest(v)
        by: dict[int, int] = {}
        for _, b in m["parts"]:
            by[b] = by.get(b, 0) + 1
        many = [p for p in m["parts"] if by[p[1]] > 1]
        if not many:
            return v
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{d}/bucket={b}" for d, b in many])
        return self._publish(v, {"parts": [p for p in m["parts"] if by[p[1]] == 1] + self._write(rows), "seq_end": self._end(m)})

    def vacuum(self, keep: int = 2) -> int:
        """Deletes data folders that the last ``keep`` versions don't use; returns how many."""
        v = self.version()
        used = {d for k in range(max(1, v - keep + 1), v + 1) for d, _ in self._manifest(k)["parts"]}
        at = self._path(f"{self.path}/data")
        gone = [s.getPath() for s in self._fs.listStatus(at) if s.getPath().getName() not in used] if self._fs.exists(at) else []
        for p in gone:
            self._fs.delete(p, True)
        return len(gone)


def source_match(pattern: str, column: str = "source") -> Column:
    """Case-insensitive literal containment."""
    return F.contains(F.lower(column), F.lit(pattern.lower()))


def keep_first(rows: DataFrame, key: str = "doc_id", order: str = "seq") -> DataFrame:
    """The first row of each key; rows with a null or blank key are all kept."""
    w = Window.partitionBy(key).orderBy(order)
    keyed = rows.filter(F.trim(key) != "").withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    return keyed.unionByName(rows.filter(F.coalesce(F.trim(key), F.lit("")) == ""))


def purge_repeated(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Only rows whose key is met once; rows with a null or blank key are all kept."""
    many = rows.filter(F.trim(key) != "").groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key)
    return rows.join(many, key, "left_anti").select(*rows.columns)


def new_sources(scanned: DataFrame, stored: DataFrame, key: str = "source") -> DataFrame:
    """Scanned rows whose key isn't stored; null keys are new."""
    return scanned.join(stored.select(key).distinct(), key, "left_anti").select(*scanned.columns)


def changed_images(scanned: DataFrame, stored: DataFrame) -> DataFrame:
    """Scanned images (image_path, mtime_ns) that are new or whose time differs from the stored one."""
    have = stored.groupBy("image_path").agg(F.max("mtime_ns").alias("_stored"))
    return scanned.join(have, "image_path", "left").filter(~F.col("mtime_ns").eqNullSafe(F.col("_stored")) | F.col("_stored").isNull()).select(*scanned.columns)


def chunk_rows(chunks: DataFrame, category: Column | None = None, stamp: Column | None = None, vector: Column | None = None) -> DataFrame:
    """Store rows of chunks (source, chunk_index, text[, seq]): category by the path, fingerprint, time stamp and vector."""
    return chunks.select(
        "text", (vector if vector is not None else F.lit(None).cast("array<float>")).alias("vector"), "source", "chunk_index",
        (category if category is not None else tx.category_of(F.col("source"))).alias("category"), tx.fingerprint(F.col("source"), F.col("chunk_index"), F.col("text")).alias("doc_id"),
        (stamp if stamp is not None else tx.iso_stamp(F.current_timestamp())).alias("ingested_at"), *(["seq"] if "seq" in chunks.columns else []),
    )
