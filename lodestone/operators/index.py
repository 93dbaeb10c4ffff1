"""Persisted indexes: a postings table for full text, pivot cells for vectors, and both for a store that changes."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import EngineConfig
from ..functions import text as tx
from ..functions import vectors as vx
from . import ranking as rk
from .store import Store


def bm25_part(tf: Column, df: Column, n: Column, length: Column, mean: Column, c: EngineConfig) -> Column:
    """What a term adds to a row's BM25."""
    return F.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (c.bm25_k1 + 1) / (tf + c.bm25_k1 * (1 - c.bm25_b + c.bm25_b * length / mean))


class PostingsIndex:
    """(term, id, tf, len) bucketed by term, at ``path``; a query reads the buckets of its terms only, appends add files.

    Bucketing prunes by the term's hash: a search neither scans nor shuffles the whole index. Document statistics are kept as
    a row for each append, so that they needn't be counted again.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, c: EngineConfig = EngineConfig()):
        self.spark, self.path, self.buckets, self.c = spark, path.rstrip("/"), buckets, c
        self.name = "lodestone_postings_" + hashlib.sha256(self.path.encode()).hexdigest()[:16]
        if not spark.catalog.tableExists(self.name):
            spark.sql(f"CREATE TABLE {self.name} (term STRING, id BIGINT, tf BIGINT, len INT) USING parquet CLUSTERED BY (term) SORTED BY (term) INTO {buckets} BUCKETS LOCATION '{self.path}/postings'")

    def append(self, corpus: DataFrame) -> None:
        """Adds the rows (id, text) of a corpus; null texts count as empty documents."""
        t = corpus.select("id", tx.tokens(F.coalesce("text", F.lit(""))).alias("t"))
        tf = t.select("id", F.size("t").alias("len"), F.explode("t").alias("term")).groupBy("term", "id", "len").agg(F.count("*").alias("tf"))
        tf.select("term", "id", "tf", "len").repartition(self.buckets, "term").write.mode("append").format("parquet").bucketBy(self.buckets, "term").sortBy("term").option("path", f"{self.path}/postings").saveAsTable(self.name)
        t.agg(F.count("*").alias("docs"), F.sum(F.size("t")).cast("long").alias("tokens")).write.mode("append").parquet(f"{self.path}/statistics")

    def search(self, query: str, k: int) -> DataFrame:
        """(id, bm25) of the k best rows."""
        terms = list(dict.fromkeys(vx._WORD.findall(query.lower())))
        if not terms:
            return self.spark.createDataFrame([], "id long, bm25 double")
        s = self.spark.read.schema("docs long, tokens long").parquet(f"{self.path}/statistics").agg(F.sum("docs").alias("n"), (F.sum("tokens") / F.sum("docs")).alias("mean_len"))
        p = self.spark.table(self.name).filter(F.col("term").isin(*terms))
        df = p.groupBy("term").agg(F.count("*").alias("df"))  # a row for each query word
        x = p.join(F.broadcast(df), "term").crossJoin(F.broadcast(s))
        part = bm25_part(F.col("tf"), F.col("df"), F.col("n"), F.col("len"), F.col("mean_len"), self.c)
        return x.groupBy("id").agg(F.sum(part).alias("bm25")).orderBy(F.desc("bm25"), "id").limit(max(1, k))


def refined(x: np.ndarray, cells: int, dims: int, rounds: int = 5) -> np.ndarray:
    """Pivots out of a sample of unit vectors, after a few rounds of means."""
    p = x[:cells] if len(x) else np.eye(1, dims, dtype=np.float32)
    for _ in range(rounds if len(p) > 1 else 0):
        near = (x @ p.T).argmax(1)
        sums = np.zeros_like(p)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        p = np.where(size > 0, sums / np.maximum(size, 1e-9), p)
    return p


def cell_of(pivots: np.ndarray):
    """The nearest pivot of each unit vector."""

    @F.pandas_udf("int")
    def run(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()).astype(np.float32) if len(v) else np.zeros((0, pivots.shape[1]), np.float32)
        return pd.Series((x @ pivots.T).argmax(1).astype(np.int32))

    return run


def stored_pivots(spark: SparkSession, path: str) -> np.ndarray:
    return np.array([r.pivot for r in spark.read.parquet(path).orderBy("cell").collect()], np.float32)  # at most the sample's size


def nearest_cells(pivots: np.ndarray, q: np.ndarray, probes: int | None = None) -> list[int]:
    return [int(i) for i in np.argsort(-(pivots @ q), kind="stable")[: probes or int(np.ceil(2 * len(pivots) ** 0.5))]]


class CellIndex:
    """Vectors in cells around pivots, stored by cell: a query reads its nearest cells only.

    There are as many pivots as the root of the number of rows, 16 at least and ``sample`` at most, refined by a few rounds of means over
    a sample of at most ``sample`` rows. A search reads twice the root of the number of cells, so that its share of the rows falls as
    the table grows. Below c.ivf_min_rows rows there is one cell, and a search is exact.
    """

    def __init__(self, spark: SparkSession, path: str, dims: int, sample: int = 20_000, c: EngineConfig = EngineConfig()):
        self.spark, self.path, self.dims, self.sample, self.c = spark, path.rstrip("/"), dims, sample, c
        self.pivots: np.ndarray | None = None

    def build(self, corpus: DataFrame) -> None:
        rows = corpus.filter(vx.usable(F.col("vector"), self.dims)).select("id", vx.unit(F.col("vector")).alias("u"))
        n = rows.count()
        cells = 1 if n < self.c.ivf_min_rows else max(int(n**0.5), 16)
        share = min(1.0, 2 * self.sample / max(n, 1))
        kept = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000)).orderBy(F.xxhash64("id"), "id").limit(self.sample)
        x = np.array([r.u for r in kept.select("u").collect()], np.float32).reshape(-1, self.dims)
        self.pivots = refined(x, cells, self.dims)
        rows.withColumn("cell", cell_of(self.pivots)(F.col("u"))).repartition(F.col("cell"), F.pmod(F.xxhash64("id"), F.lit(1 + n // (cells * 1_000_000)))).write.mode("overwrite").partitionBy("cell").parquet(f"{self.path}/cells")
        self.spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(self.pivots)], "cell int, pivot array<float>").write.mode("overwrite").parquet(f"{self.path}/pivots")

    def search(self, query: list[float], k: int, probes: int | None = None) -> DataFrame:
        """(id, similarity) of the k nearest rows in the ``probes`` nearest cells, by default twice the root of their number."""
        if self.pivots is None:
            self.pivots = stored_pivots(self.spark, f"{self.path}/pivots")
        q = np.asarray(query, np.float64)
        q = q / np.linalg.norm(q)
        cells = nearest_cells(self.pivots, q, probes)
        x = self.spark.read.parquet(f"{self.path}/cells").filter(F.col("cell").isin(cells))
        return x.select("id", vx.dot(F.col("u"), F.array(*map(F.lit, q.tolist()))).alias("similarity")).orderBy(F.desc("similarity"), "id").limit(max(1, k))

    def search_many(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(query_id, id, similarity, rank): the same for each of a bounded table of queries (query_id, query_vector), a matrix product for each cell."""
        if self.pivots is None:
            self.pivots = stored_pivots(self.spark, f"{self.path}/pivots")
        names, q = rk.matrix(queries, "query_id", "query_vector")
        asked = [(n, c, v.tolist()) for n, v in zip(names, q) for c in nearest_cells(self.pivots, v, probes)]
        visits = self.spark.createDataFrame(asked, "query_id long, cell int, q array<double>")

        def compare(rows: pa.Table, visit: pa.Table) -> pa.Table:
            if not rows.num_rows or not visit.num_rows:
                return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})
            x, v = (np.asarray(pc.list_flatten(t.column(c)).to_numpy(), np.float64).reshape(t.num_rows, -1) for t, c in ((rows, "u"), (visit, "q")))
            s = v @ x.T
            ids, coarse = rows.column("id").to_numpy(), np.round(s, 9)
            least = np.partition(coarse, -k, axis=1)[:, -k][:, None] if s.shape[1] > k else -2
            i, j = np.nonzero(coarse >= least)
            return pa.table({"query_id": visit.column("query_id").to_numpy()[i], "id": ids[j], "similarity": s[i, j]})

        cells = self.spark.read.parquet(f"{self.path}/cells").select("cell", F.col("id").cast("long").alias("id"), F.col("u").cast("array<double>").alias("u"))
        found = cells.groupBy("cell").cogroup(visits.groupBy("cell")).applyInArrow(compare, "query_id long, id long, similarity double")
        best = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), "id")
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


class StoreIndex:
    """Postings and cells of a store's chunks, below the store's own folder.

    A store's data folders never change, and a version lists the folders and buckets that are alive. So each folder is indexed once, by
    ``refresh``, and a search passes over entries whose folder and bucket the version doesn't list: updates and deletions need no change
    to the index. Postings are partitioned by the term's hash, vectors by cell, so that a search reads the parts of its query only.
    """

    SLOTS = 64

    def __init__(self, store: Store, dims: int, c: EngineConfig = EngineConfig(), sample: int = 20_000):
        self.store, self.spark, self.dims, self.c, self.sample = store, store.spark, dims, c, sample
        self.path = f"{store.path}/index"

    def _slot(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.SLOTS)).cast("int")

    def _there(self, at: str) -> bool:
        return self.store._fs.exists(self.store._path(f"{self.path}/{at}"))

    def _live(self, version: int | None = None) -> DataFrame:
        """(folder, bucket) of a version: as many rows as its manifest has entries."""
        return self.spark.createDataFrame([(d, int(b)) for d, b in self.store._manifest(version)["parts"]], "folder string, bucket int")

    def _rows(self, folder: str) -> DataFrame:
        at = f"{self.store.path}/data/{folder}"
        schema = T.StructType([*self.store.schema.fields, T.StructField("bucket", T.IntegerType())])
        return self.spark.read.schema(schema).option("basePath", at).parquet(at).withColumn("id", row_id())

    def refresh(self) -> int:
        """Indexes the data folders that aren't; the number of them."""
        todo = [f for f in sorted({d for d, _ in self.store._manifest()["parts"]}) if not self._there(f"done/{f}")]
        if todo and not self._there("pivots/_SUCCESS"):
            self._fit()
        pivots = stored_pivots(self.spark, f"{self.path}/pivots") if todo else None
        for f in todo:
            rows = self._rows(f)
            t = rows.select("id", "bucket", tx.tokens(F.coalesce("text", F.lit(""))).alias("t")).withColumn("len", F.size("t"))
            tf = t.select("id", "bucket", "len", F.explode("t").alias("term")).groupBy("term", "id", "bucket", "len").agg(F.count("*").alias("tf")).withColumn("slot", self._slot(F.col("term")))
            # a frequent term's rows are spread by id
            tf.repartition(F.col("slot"), F.pmod(F.xxhash64("id"), F.lit(4))).sortWithinPartitions("slot", "term").write.mode("overwrite").partitionBy("slot").parquet(f"{self.path}/postings/folder={f}")
            t.groupBy("bucket").agg(F.count("*").alias("docs"), F.sum("len").cast("long").alias("tokens")).write.mode("overwrite").parquet(f"{self.path}/statistics/folder={f}")
            v = rows.filter(vx.usable(F.col("vector"), self.dims)).select("id", "bucket", vx.unit(F.col("vector")).alias("u"))
            v.withColumn("cell", cell_of(pivots)(F.col("u"))).repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{self.path}/cells/folder={f}")
            self.store._fs.mkdirs(self.store._path(f"{self.path}/done/{f}"))
        return len(todo)

    def _fit(self) -> None:
        """Pivots from a sample of the store's vectors; they stay until ``rebuild``."""
        rows = self.store.read().filter(vx.usable(F.col("vector"), self.dims)).select(row_id().alias("id"), vx.unit(F.col("vector")).alias("u"))
        n = rows.count()
        cells = 1 if n < self.c.ivf_min_rows else max(int(n**0.5), 16)
        share = min(1.0, 2 * self.sample / max(n, 1))
        kept = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000)).orderBy(F.xxhash64("id"), "id").limit(self.sample)
        pivots = refined(np.array([r.u for r in kept.select("u").collect()], np.float32).reshape(-1, self.dims), cells, self.dims)
        self.spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(pivots)], "cell int, pivot array<float>").write.mode("overwrite").parquet(f"{self.path}/pivots")

    def rebuild(self) -> int:
        """Fits the pivots anew and indexes all folders, for a store that has grown much."""
        self.store._fs.delete(self.store._path(self.path), True)
        return self.refresh()

    def vacuum(self) -> int:
        """Deletes what belongs to data folders that are gone; returns how many."""
        at = self.store._path(f"{self.path}/done")
        have = [s.getPath().getName() for s in self.store._fs.listStatus(at)] if self.store._fs.exists(at) else []
        gone = [f for f in have if not self.store._fs.exists(self.store._path(f"{self.store.path}/data/{f}"))]
        for f in gone:
            for part in (f"done/{f}", f"postings/folder={f}", f"statistics/folder={f}", f"cells/folder={f}"):
                self.store._fs.delete(self.store._path(f"{self.path}/{part}"), True)
        return len(gone)

    def _read(self, what: str, schema: str) -> DataFrame:
        """Entries of the folders and buckets that are alive."""
        live = self._live()
        folders = [r.folder for r in live.select("folder").distinct().collect()]  # of one version
        if not folders:
            return self.spark.createDataFrame([], schema + ", folder string")
        x = self.spark.read.schema(schema + ", folder string").option("basePath", f"{self.path}/{what}").parquet(*[f"{self.path}/{what}/folder={f}" for f in folders])
        return x.join(F.broadcast(live), ["folder", "bucket"], "left_semi")

    def text_hits(self, query: str, k: int, allowed: DataFrame | None = None) -> DataFrame:
        """(id, folder, bucket, bm25) of the k best rows, of those allowed (id) if given; statistics are the whole store's."""
        terms = list(dict.fromkeys(vx._WORD.findall(query.lower())))
        schema = "term string, id long, bucket int, len int, tf long, slot int"
        if not terms:
            return self.spark.createDataFrame([], "id long, folder string, bucket int, bm25 double")
        s = self._read("statistics", "bucket int, docs long, tokens long").agg(F.sum("docs").alias("n"), (F.sum("tokens") / F.sum("docs")).alias("mean_len"))
        slots = [r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "t string").select(self._slot(F.col("t"))).collect()]
        p = self._read("postings", schema).filter(F.col("slot").isin(slots) & F.col("term").isin(terms))
        df = p.groupBy("term").agg(F.count("*").alias("df"))  # a row for each query word
        p = p if allowed is None else p.join(allowed, "id", "left_semi")
        x = p.join(F.broadcast(df), "term").crossJoin(F.broadcast(s))
        part = bm25_part(F.col("tf"), F.col("df"), F.col("n"), F.col("len"), F.col("mean_len"), self.c)
        return x.groupBy("id", "folder", "bucket").agg(F.sum(part).alias("bm25")).orderBy(F.desc("bm25"), "id").limit(max(1, k))

    def vector_hits(self, query: list[float], k: int, allowed: DataFrame | None = None, probes: int | None = None) -> DataFrame:
        """(id, folder, bucket, distance) of the k nearest rows in the cells that are nearest, of those allowed (id) if given."""
        q = np.asarray(query, np.float64)
        q = q / np.linalg.norm(q)
        cells = nearest_cells(stored_pivots(self.spark, f"{self.path}/pivots"), q, probes)
        x = self._read("cells", "id long, bucket int, u array<double>, cell int").filter(F.col("cell").isin(cells))
        x = x if allowed is None else x.join(allowed, "id", "left_semi")
        return x.select("id", "folder", "bucket", (1 - vx.dot(F.col("u"), F.array(*map(F.lit, q.tolist())))).alias("distance")).orderBy("distance", "id").limit(max(1, k))

    def fetch(self, hits: DataFrame) -> DataFrame:
        """The store's rows (with id) of a bounded list of hits, which it keeps; only their folders and buckets are read."""
        parts = [(r.folder, r.bucket) for r in hits.select("folder", "bucket").distinct().collect()]  # at most a part for each hit
        if not parts:
            return self.spark.createDataFrame([], self.store.schema).withColumn("id", row_id()).join(hits.drop("folder", "bucket"), "id")
        rows = self.spark.read.schema(self.store.schema).parquet(*[f"{self.store.path}/data/{f}/bucket={b}" for f, b in parts]).withColumn("id", row_id())
        return rows.join(F.broadcast(hits.drop("folder", "bucket")), "id")


def row_id() -> Column:
    """The id of a store's row."""
    return F.xxhash64("source", "chunk_index", "seq")
