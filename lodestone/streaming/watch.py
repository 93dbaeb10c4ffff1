"""File changes: filters, leading-edge debounce as batch and as stream, and applying them to a store."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import EXCLUDED_DIRS, TEXT_EXTENSIONS
from ..session import Scratch
from ..sources.files import extension, scan

KINDS = ("created", "modified", "moved")


def relevant(events: DataFrame, extensions: tuple[str, ...] = TEXT_EXTENSIONS) -> DataFrame:
    """Events to act on, with ``target`` (the file to index) and ``kind``: created, modified and moved ones of known file kinds.

    A move's target is its destination; without one it is left out. Excluded names count anywhere in the path. Both separators are
    the same; null paths, odd kinds and deletions are left out.
    """
    kind = F.lower(F.trim("change_kind"))
    target = F.replace(F.when(kind == "moved", F.nullif(F.trim("dest_path"), F.lit(""))).otherwise(F.col("file_path")), F.lit("\\"), F.lit("/"))
    out = events.withColumns({"kind": kind, "target": target}).filter(F.col("kind").isin(*KINDS) & F.col("target").isNotNull())
    keep = extension(F.col("target")).isin(*extensions)
    for name in EXCLUDED_DIRS:
        keep = keep & ~F.contains("target", F.lit(name))
    return out.filter(keep)


def debounce(events: DataFrame, seconds: float = 5.0, key: str = "target", at: str = "happened_at", order: str = "event_no") -> DataFrame:
    """Events accepted by a leading-edge debounce: those more than ``seconds`` after the last accepted one of their key; moves always.

    Moves leave the clock as it is. Events of a key are taken by time, then by number; without a time they are left out. Each
    partition is sorted and read once as a stream of Arrow batches that carries nothing but the last accepted time: a key with very
    many events takes no more memory than another.
    """
    wait = int(seconds * 1e6)

    def run(batches):
        name, last = None, None
        for b in batches:
            keep = []
            for k, x, kind in zip(b.column("_key").to_pylist(), b.column("_at").to_pylist(), b.column("kind").to_pylist()):
                if k != name:
                    name, last = k, None
                ok = kind == "moved" or last is None or x - last > wait
                if ok and kind != "moved":
                    last = x
                keep.append(ok)
            yield b.filter(pa.array(keep, pa.bool_())).select(names)

    names = events.columns
    rows = events.filter(F.col(at).isNotNull()).withColumns({"_key": F.col(key), "_at": F.unix_micros(F.col(at).cast("timestamp"))})
    return rows.repartition("_key").sortWithinPartitions("_key", "_at", order).mapInArrow(run, events.schema)


def debounce_stream(events: DataFrame, seconds: float = 5.0, key: str = "target", at: str = "happened_at", watermark: str | None = None, keep_seconds: int = 86_400) -> DataFrame:
    """The same on a stream: (target, kind, at) of accepted events, with a time of state for each key.

    Events of a key are taken in the order of their time within each trigger; one that is older than the last accepted event is
    dropped, as its burst is over. With a ``watermark`` (such as "10 minutes") a key's state goes once the watermark is
    ``keep_seconds`` past its last event; without one it stays.
    """
    out = T.StructType([T.StructField("target", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("at", T.TimestampType())])

    def run(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("at")
        last = state.get[0] if state.exists else None
        keep = []
        micros = rows["at"].astype("datetime64[us]").astype("int64")
        for x, kind in zip(micros, rows["kind"]):
            ok = kind == "moved" or last is None or x - last > seconds * 1e6
            if ok and kind != "moved":
                last = int(x)
            keep.append(ok)
        if last is not None:
            state.update((last,))
            if watermark is not None:
                state.setTimeoutTimestamp(max(int(micros.max() // 1000), state.getCurrentWatermarkMs()) + keep_seconds * 1000)
        yield rows[keep][["target", "kind", "at"]]

    x = events.select(F.col(key).alias("target"), "kind", F.col(at).cast("timestamp").alias("at")).filter("at is not null")
    x = x.withWatermark("at", watermark) if watermark is not None else x
    return x.groupBy("target").applyInPandasWithState(run, out, "last long", "append", "NoTimeout" if watermark is None else "EventTimeTimeout")


def changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """(file_path, change_kind, dest_path) between two listings (path, size, modified): created, modified, moved and deleted files.

    A file that is gone and one that is new with its size and time are a move; of several such ones the first by name go together.
    """
    old, new = (x.select("path", F.struct("size", "modified").alias(s)) for x, s in ((before, "was"), (now, "is")))
    both = old.join(new, "path", "full_outer")
    changed = both.filter(F.col("was").isNotNull() & F.col("is").isNotNull() & (F.col("was") != F.col("is"))).select(F.col("path").alias("file_path"), F.lit("modified").alias("change_kind"), F.lit(None).cast("string").alias("dest_path"))
    same = lambda c: F.row_number().over(Window.partitionBy(c).orderBy("path"))
    gone = both.filter("is is null").select(F.col("path").alias("file_path"), F.col("was").alias("file"), same("was").alias("k"))
    come = both.filter("was is null").select(F.col("path").alias("dest_path"), F.col("is").alias("file"), same("is").alias("k"))
    paired = gone.join(come, ["file", "k"], "full_outer")
    kind = F.when(F.col("file_path").isNull(), "created").when(F.col("dest_path").isNull(), "deleted").otherwise("moved")
    moved = paired.select(F.coalesce("file_path", "dest_path").alias("file_path"), kind.alias("change_kind"), F.when(kind == "moved", F.col("dest_path")).alias("dest_path"))
    return changed.unionByName(moved)


class Watcher:
    """Follows a folder: each ``step`` lists it, compares with the listing before and hands the accepted (target, kind, at) to ``apply``.

    Listings and the times of the last accepted events are tables in ``checkpoint``, one for each step, so that a watcher that is started
    again goes on where it was. Times older than the wait are dropped, so that they don't pile up. A failing ``apply`` is printed
    and the watcher goes on. With ``trailing`` a change within the wait isn't lost: it is found again once the wait is over.
    """

    LISTING = "path string, size long, modified timestamp"
    CLOCK = "target string, last timestamp"

    def __init__(self, spark: SparkSession, root: str, apply: Callable[[DataFrame], None], checkpoint: str, seconds: float = 5.0, trailing: bool = False, extensions: tuple[str, ...] = TEXT_EXTENSIONS):
        self.spark, self.root, self.apply, self.seconds, self.trailing, self.extensions = spark, root, apply, seconds, trailing, extensions
        self.checkpoint = checkpoint.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.checkpoint).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if self._last() < 0:  # what is there at the start is no change
            self._keep(0, self._listing(), spark.createDataFrame([], self.CLOCK))

    def _last(self) -> int:
        at = self._path(f"{self.checkpoint}/steps")
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        # a step counts once both of its tables are there
        return max((int(n) for n in names if self._fs.exists(self._path(f"{self.checkpoint}/steps/{n}/clock/_SUCCESS"))), default=-1)

    def _listing(self) -> DataFrame:
        return scan(self.spark, self.root, self.extensions, content=False).select("path", "size", "modified")

    def _keep(self, n: int, listing: DataFrame, clock: DataFrame) -> None:
        listing.write.mode("overwrite").parquet(f"{self.checkpoint}/steps/{n}/listing")
        clock.write.mode("overwrite").parquet(f"{self.checkpoint}/steps/{n}/clock")

    def step(self) -> int:
        """One comparison; the number of accepted events."""
        n = self._last()
        read = lambda what, schema: self.spark.read.schema(schema).parquet(f"{self.checkpoint}/steps/{n}/{what}")
        before, clock = read("listing", self.LISTING), read("clock", self.CLOCK)
        seen = F.lit(self.spark.sql("SELECT current_timestamp() AS t").first().t)
        scratch = Scratch(self.spark, "watch")
        try:
            now = scratch.save(self._listing(), "listing")
            events = relevant(changes(before, now), self.extensions).withColumn("at", seen).join(clock, "target", "left")
            waits = (F.col("kind") != "moved") & F.col("last").isNotNull() & (seen.cast("double") - F.col("last").cast("double") <= self.seconds)
            events = scratch.save(events.select("file_path", "target", "kind", "at", F.coalesce(waits, F.lit(False)).alias("waits")), "events")
            accepted = events.filter("not waits").select("target", "kind", "at")
            count = accepted.count()
            if count:
                try:
                    self.apply(accepted)
                except Exception as e:  # noqa: BLE001
                    print(f"watch: step {n + 1} failed: {e}")
            kept = now
            if self.trailing:  # the listing before stands for files whose change has to wait
                late = events.filter("waits").select(F.col("file_path").alias("path"))
                kept = now.join(late, "path", "left_anti").unionByName(before.join(late, "path", "left_semi"))
            times = accepted.filter("kind <> 'moved'").select("target", F.col("at").alias("last")).unionByName(clock).groupBy("target").agg(F.max("last").alias("last"))
            self._keep(n + 1, kept, times.filter(seen.cast("double") - F.col("last").cast("double") <= self.seconds))
        finally:
            scratch.drop()
        self._fs.delete(self._path(f"{self.checkpoint}/steps/{n - 1}"), True)
        return count


def watch(spark: SparkSession, root: str, apply: Callable[[DataFrame], None], checkpoint: str, seconds: float = 5.0, every: str = "5 seconds") -> StreamingQuery:
    """A stream that steps a watcher at every trigger; new, rewritten and moved files are followed, deleted ones aren't."""
    watcher = Watcher(spark, root, apply, f"{checkpoint.rstrip('/')}/files", seconds)
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(lambda batch, number: watcher.step()).option("checkpointLocation", f"{checkpoint.rstrip('/')}/clock").trigger(processingTime=every).start()


def event_counts(events: DataFrame) -> DataFrame:
    """(kind, n) of the raw kinds, spelled in lower case; null and blank ones as an empty name."""
    kind: Column = F.coalesce(F.lower(F.trim("change_kind")), F.lit(""))
    return events.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
