"""Problem 2: new batches against all history.

Method. Minwise hashing: a record's signature is the lowest value of its shingles under each of bands * rows functions; the keys of
its bands, each with a signature of 128 one-bit minwise values, lie in a table that is bucketed and sorted by the key. A delivery's
keys probe the buckets they hash to; one-bit signatures filter the collisions, the texts' exact Jaccard value decides, and the accepted
records' keys are appended.

Scale. The tables of keys, texts (by id) and doc_ids are bucketed and never shuffled again: only the delivery moves, to their buckets.
A delivery of few keys reads the buckets of these only. Equal shingle sets are stored once, so that a text that a third of the rows
repeat has one entry. ``compact`` puts the files of many deliveries together.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch, broadcast_if_small
from .near_duplicates import Likeness, verify
from .shingles import Block, blocks, mix


@dataclass(frozen=True)
class Bands:
    """bands * rows minwise functions: a pair of likeness s shares a band with the chance 1 - (1 - s**rows)**bands, 0.9994 at 0.6 and over 0.999999 at 0.8."""

    bands: int = 32
    rows: int = 3
    #: Of 128 one-bit values a pair of likeness s agrees in 64 + 64 s on average; for 0.6 the filter lies 4.4 standard deviations below.
    least_bits: int = 82


def minwise(b: Block, p: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (texts x bands) and one-bit signatures (texts x 2) of the texts with at least one shingle."""
    rng = np.random.default_rng(20_11)
    many = max(128, p.bands * p.rows)
    odd = rng.integers(0, 1 << 32, many, dtype=np.uint32) | np.uint32(1)
    flip = rng.integers(0, 1 << 32, many, dtype=np.uint32)
    v = mix(b.values.astype(np.uint64)).astype(np.uint32)
    starts = b.offsets[:-1][b.sizes > 0]
    keys = np.zeros((len(starts), p.bands), np.uint64)
    bits = np.zeros((len(starts), 2), np.uint64)
    for i in range(many):
        low = np.minimum.reduceat((v ^ flip[i]) * odd[i], starts).astype(np.uint64)
        band = i // p.rows
        if band < p.bands:
            keys[:, band] = mix(keys[:, band] * np.uint64(31) + low + np.uint64(band))
        if i < 128:
            bits[:, i // 64] |= ((low >> np.uint64(13)) & np.uint64(1)) << np.uint64(i % 64)
    return keys.astype(np.int64), bits.astype(np.int64)


def signatures(df: DataFrame, id_col: str, text_col: str, width: int, p: Bands) -> DataFrame:
    """(id, fp, n, bits, more, keys) of each record with at least one shingle."""

    def run(batches):
        for batch in batches:
            for part, texts in blocks(batch):
                b = Block(texts, width)
                full = b.sizes > 0
                if not full.any():
                    continue
                keys, bits = minwise(b, p)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), p.bands).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").filter(pa.array(full)), pa.array(b.fingerprints()[full]), pa.array(b.sizes[full].astype(np.int32)), pa.array(bits[:, 0]), pa.array(bits[:, 1]), lists],
                    names=["id", "fp", "n", "bits", "more", "keys"],
                )

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    return src.mapInArrow(run, "id long, fp long, n int, bits long, more long, keys array<long>")


def instant(ingested_at) -> F.Column:
    """The instant in a spelled time: digits are epoch seconds, times without an offset are UTC, anything else is null."""
    s = F.trim(ingested_at)
    zoned = F.when(s.rlike(r"(Z|[+-]\d\d:?\d\d)$"), s).otherwise(F.concat(s, F.lit("Z")))
    return F.when(s.rlike(r"^\d{1,12}$"), F.timestamp_seconds(s.try_cast("long"))).when(s != "", zoned.try_cast("timestamp"))


class HistoryIndex:
    """Band keys, texts and doc_ids of all accepted records, at ``path`` in shared storage; opened again by constructing it with the same path.

    Width, threshold, bands and the number of buckets are kept beside the tables: an index that exists is opened with its own
    buckets, and other parameters than its own are refused.
    """

    #: (columns, bucketed by) of each table
    TABLES = {"keys": ("key BIGINT, id BIGINT, n INT, bits BIGINT, more BIGINT", "key"), "texts": ("id BIGINT, text STRING", "id"), "doc_ids": ("doc_key STRING", "doc_key")}
    #: Values up to which a probe names them, so that other buckets aren't read.
    FEW = 4096

    def __init__(self, spark: SparkSession, path: str, likeness: Likeness = Likeness(), bands: Bands = Bands(), buckets: int = 200):
        self.spark, self.path, self.likeness, self.bands = spark, path.rstrip("/"), likeness, bands
        own = {"width": likeness.width, "threshold": likeness.threshold, "bands": bands.bands, "rows": bands.rows}
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/settings")
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            kept = max((json.loads(r.value) for r in spark.read.text(f"{self.path}/settings").collect()), key=lambda x: x["generation"])  # a line for each compaction
            if any(kept[k] != v for k, v in own.items()):
                raise ValueError(f"the index at {self.path} has other parameters: {kept}")
            self.settings = kept
        else:
            self._set(own | {"buckets": buckets, "generation": 0})
        self._open()

    def _set(self, settings: dict) -> None:
        self.spark.createDataFrame([(json.dumps(settings),)], "value string").coalesce(1).write.mode("append").text(f"{self.path}/settings")
        self.settings = settings

    def _name(self, table: str) -> str:
        return f"lodestone_{table}_{hashlib.sha256(self.path.encode()).hexdigest()[:16]}_{self.settings['generation']}"

    def _at(self, table: str) -> str:
        return f"{self.path}/{self.settings['generation']}/{table}"

    def _open(self) -> None:
        for table, (columns, by) in self.TABLES.items():
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {self._name(table)} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.settings['buckets']} BUCKETS LOCATION '{self._at(table)}'"
            )

    def _add(self, table: str, rows: DataFrame) -> None:
        by, n = self.TABLES[table][1], self.settings["buckets"]
        rows.repartition(n, by).write.mode("append").format("parquet").bucketBy(n, by).sortBy(by).option("path", self._at(table)).saveAsTable(self._name(table))

    def _read(self, table: str, values: DataFrame) -> DataFrame:
        """A table's rows, at least those of the values (one column) of its bucketing column: if they are few, of their buckets only."""
        by = self.TABLES[table][1]
        few = values.distinct().limit(self.FEW + 1).collect()
        rows = self.spark.table(self._name(table))
        return rows.filter(F.col(by).isin([r[0] for r in few])) if len(few) <= self.FEW else rows

    def compact(self) -> None:
        """Writes the tables anew, a sorted file for each bucket, and then goes over to these; the files before stay until they are deleted."""
        old = {t: self.spark.table(self._name(t)) for t in self.TABLES}
        before, self.settings = self.settings, self.settings | {"generation": self.settings["generation"] + 1}
        self._open()
        for t, rows in old.items():
            self._add(t, rows)
        self._set(self.settings)
        for t in self.TABLES:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(t).rsplit('_', 1)[0]}_{before['generation']}")

    def _entries(self, sigs: DataFrame) -> DataFrame:
        # the lowest id stands for all records with its set of shingles
        copies = sigs.groupBy("fp").agg(F.min("id").alias("id"))
        reps = sigs.join(copies.select("id"), "id", "left_semi")
        return reps.select(F.explode("keys").alias("key"), "id", "n", "bits", "more")

    def append(self, sigs: DataFrame, texts: DataFrame, doc_ids: DataFrame) -> None:
        """Adds records by their signatures and texts (id, text), and the spelled-down doc_ids (column doc_key)."""
        entries = Scratch(self.spark, "entries").save(self._entries(sigs), "entries")
        self._add("keys", entries)
        self._add("texts", texts.join(broadcast_if_small(entries.select("id").distinct()), "id", "left_semi"))
        self._add("doc_ids", doc_ids)

    def build(self, store: DataFrame, id_col: str = "row_id", text_col: str = "text", doc_col: str = "doc_id") -> None:
        """Adds a whole store of accepted records."""
        sigs = Scratch(self.spark, "history").save(signatures(store, id_col, text_col, self.likeness.width, self.bands), "signatures")
        self.append(sigs, _texts(store, id_col, text_col), doc_keys(store, doc_col).distinct())

    def _probe(self, mine: DataFrame, theirs: DataFrame, extra: str) -> DataFrame:
        t = self.likeness.threshold
        a, b = (x.select("key", *(F.col(c).alias(f"{s}_{c}") for c in ("id", "n", "bits", "more"))) for x, s in ((mine, "a"), (theirs, "b")))
        near = f"a_n >= {t} * b_n and b_n >= {t} * a_n and bit_count(a_bits ^ b_bits) + bit_count(a_more ^ b_more) <= {128 - self.bands.least_bits}"
        return a.join(b, "key").filter(f"{near} and {extra}").select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).distinct()

    def screen(self, delivery: DataFrame, order: list[str], id_col: str = "row_id", text_col: str = "text", doc_col: str = "doc_id") -> DataFrame:
        """(id, accepted) for each row of a delivery of one or several batches, and adds the accepted ones to the index.

        Rows are taken in the order of the columns ``order`` (which must be free of ties and hold nulls last by themselves). A row
        is rejected if a row accepted before, in the index or in the delivery, has its doc_id (null and blank ones don't count,
        letter case is ignored) or a text of the threshold's likeness. Ids must be unique over index and delivery. Texts without a
        shingle are like none. An empty delivery gives no rows.
        """
        scratch = Scratch(self.spark, "p2")
        rows = scratch.save(delivery.select(F.col(id_col).cast("long").alias("id"), F.struct(*order).alias("o"), doc_key(F.col(doc_col)).alias("doc_key")), "rows")
        sigs = scratch.save(signatures(delivery, id_col, text_col, self.likeness.width, self.bands), "signatures")
        mine = scratch.save(self._entries(sigs), "keys")
        old = self._probe(mine, self._read("keys", mine.select("key")), "true").withColumn("old", F.lit(True))
        new = self._probe(mine, mine, "a_id < b_id").withColumn("old", F.lit(False))
        candidates = scratch.save(old.unionByName(new), "candidates")
        new_texts = _texts(delivery, id_col, text_col)
        old_texts = self._read("texts", candidates.filter("old").select("b"))
        links = verify(candidates.filter("not old").select("a", "b"), new_texts, self.likeness, scratch).withColumn("old", F.lit(False))
        with_old = verify(candidates.filter("old").select("a", "b"), new_texts, self.likeness, scratch, old_texts).withColumn("old", F.lit(True))
        links = scratch.save(links.unionByName(with_old), "links")

        classes = sigs.select("id", "fp")
        linked = links.filter("old").select(F.col("a").alias("id")).join(classes, "id").select("fp").distinct()
        known = self._read("doc_ids", rows.select("doc_key").filter("doc_key is not null"))
        out = classes.join(linked, "fp", "left_semi").select("id").unionByName(rows.join(known, "doc_key", "left_semi").select("id")).distinct()
        rows_left = scratch.save(rows.join(out, "id", "left_anti"), "left")

        # A clique is a set of rows of which one at most can be accepted: one doc_id, one class, or two classes that are alike.
        left = rows_left.join(classes, "id", "left")
        fp = classes.select("id", F.col("fp"))
        edges = links.filter("not old").join(fp.withColumnsRenamed({"id": "a", "fp": "fa"}), "a").join(fp.withColumnsRenamed({"id": "b", "fp": "fb"}), "b")
        ends = edges.select(F.concat_ws("-", "a", "b").alias("clique"), F.explode(F.array("fa", "fb")).alias("fp"))
        cliques = (
            left.filter("doc_key is not null").select(F.concat(F.lit("d"), "doc_key").alias("clique"), "id", "o")
            .unionByName(left.filter("fp is not null").select(F.concat(F.lit("c"), F.col("fp").cast("string")).alias("clique"), "id", "o"))
            .unionByName(left.join(ends, "fp").select(F.concat(F.lit("e"), "clique").alias("clique"), "id", "o"))
        )
        shared = cliques.groupBy("clique").agg(F.count("*").alias("k")).filter("k > 1").select("clique")
        members = scratch.save(cliques.join(shared, "clique", "left_semi"), "cliques")
        late = self._later(members, scratch)
        result = scratch.save(rows.select("id").join(out.unionByName(late).withColumn("out", F.lit(True)), "id", "left").select("id", F.col("out").isNull().alias("accepted")), "result")
        kept = result.filter("accepted").select("id")
        self.append(sigs.join(kept, "id", "left_semi"), new_texts, rows.join(kept, "id", "left_semi").filter("doc_key is not null").select("doc_key").distinct())
        return result

    def _later(self, members: DataFrame, scratch: Scratch) -> DataFrame:
        """Ids of the rows that come after an accepted member of one of their cliques.

        In each round the rows that are first in all their cliques are accepted and the rest of these cliques is rejected.
        """
        gone = members.select("id").limit(0)
        while members.limit(1).count():
            first = members.groupBy("clique").agg(F.min("o").alias("first"))
            flagged = members.join(first, "clique").select("clique", "id", "o", (F.col("o") == F.col("first")).alias("is_first"))
            heads = scratch.save(flagged.groupBy("id").agg(F.min("is_first").alias("head")).filter("head").select("id"), "heads")
            hit = members.join(heads, "id", "left_semi").select("clique").distinct()
            rejected = scratch.save(members.join(hit, "clique", "left_semi").select("id").distinct().join(heads, "id", "left_anti"), "rejected")
            gone = gone.unionByName(rejected)
            members = scratch.save(members.join(heads.unionByName(rejected), "id", "left_anti"), "cliques")
        return gone


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def doc_key(col) -> F.Column:
    return F.when(F.trim(col) != "", F.lower(col))


def doc_keys(df: DataFrame, doc_col: str) -> DataFrame:
    return df.select(doc_key(F.col(doc_col)).alias("doc_key")).filter("doc_key is not null")
