"""Bulk conversion and rebuilds: several roots, retries, a checkpoint table, cached conversions and exported Markdown."""

from __future__ import annotations

import os
import re
import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import chunking
from ..functions import text as tx
from ..session import Scratch
from ..sources import files as fs
from ..sources import readers
from . import manage as mg
from . import store as st

CHECKPOINT = "file_path string, status string, chunks long, error_text string, attempt int, updated_at timestamp"
# Fixed value: links to images of a converted document.
_IMAGE = re.compile(r"!\[([^\]]*)\]\((images/[^)]+)\)")


def convert(files: DataFrame, reader: Callable[[str, bytes], tuple[str, bool]] | None = None, attempts: int = 3, wait: float = 5.0, least: int = EngineConfig.min_doc_chars) -> DataFrame:
    """(file_path, source, text, markdown, status, error_text, attempt) of files (file_path, source, content).

    status is done, empty (less than ``least`` characters) or failed: a reader that raises is tried again, with a longer wait each
    time. A file's failure is a row, never a failed task; a task that is lost is run again by Spark.
    """
    read = reader or (lambda source, data: readers.extract(source, data))
    names = ["file_path", "source", "text", "markdown", "status", "error_text", "attempt"]
    types = [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.int32()]

    def one(source: str, data: bytes):
        error = ""
        for k in range(1, attempts + 1):
            try:
                text, markdown = read(source, data)
                return text, markdown, "done" if len(text) >= least else "empty", None, k
            except Exception as e:  # noqa: BLE001
                error = f"{type(e).__name__}: {e}"
                if k < attempts:
                    time.sleep(wait * k)
        return "", False, "failed", error, attempts

    def run(batches):
        for b in batches:
            paths, sources = b.column("file_path").to_pylist(), b.column("source").to_pylist()
            rows = [(p, s, *one(s, d or b"")) for p, s, d in zip(paths, sources, b.column("content").to_pylist())]
            cols = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return files.select("file_path", "source", "content").mapInArrow(run, "file_path string, source string, text string, markdown boolean, status string, error_text string, attempt int")


def uncached(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files (path, size, mtime_ns) without a conversion in the cache table (cache_key)."""
    keyed = files.withColumn("cache_key", tx.cache_key(F.col("path"), F.col("size"), F.col("mtime_ns")))
    return keyed.join(cache.select("cache_key").distinct(), "cache_key", "left_anti").select(*files.columns, "cache_key")


def renumber_images(text: str, existing: set[str], stem: str = "img") -> tuple[str, dict[str, str]]:
    """A Markdown text whose links to existing images are numbered in the order first met, and the new name of each; other links stay."""
    names: dict[str, str] = {}

    def put(m: re.Match) -> str:
        old = m[2]
        if old not in existing:
            return m[0]
        if old not in names:
            dot = old.rfind(".")
            names[old] = f"images/{stem}-{len(names) + 1:03d}{old[dot:] if dot > old.rfind('/') else ''}"
        return f"![{m[1]}]({names[old]})"

    return _IMAGE.sub(put, text), names


def export_markdown(texts: DataFrame, folder: str) -> DataFrame:
    """Writes each text (source, text) below a folder that all executors see, as Markdown under its source's name; the names written.

    Folders of a source stay, its ending becomes .md; a name that would lead out of the folder is left out.
    """
    root = os.path.abspath(fs.local_path(folder))

    def run(batches):
        for b in batches:
            names = []
            for source, text in zip(b.column("source").to_pylist(), b.column("text").to_pylist()):
                at = os.path.abspath(os.path.join(root, re.sub(r"\.[^./]*$", "", (source or "").replace("\\", "/")) + ".md"))
                if source and text is not None and at.startswith(root + os.sep):
                    os.makedirs(os.path.dirname(at), exist_ok=True)
                    with open(at + ".part", "w", encoding="utf-8") as f:
                        f.write(text)
                    os.replace(at + ".part", at)  # a task that runs again writes the same
                    names.append(os.path.relpath(at, root).replace(os.sep, "/"))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["name"])

    return Scratch(texts.sparkSession, "export").save(texts.select("source", "text").mapInArrow(run, "name string"), "names")


def rebuild(store: st.Store, roots: list[str], checkpoint: str, vector=None, reader=None, c: EngineConfig = EngineConfig(), dry_run: bool = False, wait: float = 5.0) -> DataFrame:
    """Indexes the files of several roots that the checkpoint at ``checkpoint`` hasn't as done or empty; failed ones are tried again.

    Gives the run's checkpoint rows, which are appended there; with ``dry_run`` the estimate instead, and nothing is written. Files
    are named root::path. ``vector`` makes a column of vectors from one of texts. The store has each fingerprint once afterwards.
    """
    spark = store.spark
    found = None
    for root in roots:
        one = fs.scan(spark, root, c=c).withColumn("file_path", F.concat(F.lit(root.rstrip("/") + "::"), "source"))
        found = one if found is None else found.unionByName(one)
    try:
        known = spark.read.schema(CHECKPOINT).parquet(checkpoint)
        known.limit(1).collect()
    except Exception:  # noqa: BLE001  no checkpoint yet
        known = spark.createDataFrame([], CHECKPOINT)
    todo = mg.pending_files(found, known)
    scratch = Scratch(spark, "rebuild")
    texts = scratch.save(convert(todo, reader, wait=wait, least=c.min_doc_chars), "texts")
    if dry_run:
        return mg.estimate(texts, chunk_size=c.chunk_size, min_chars=c.min_doc_chars)
    chunks = scratch.save(chunking.chunk_documents(texts.filter("status = 'done'"), markdown_col="markdown", c=c).withColumn("seq", F.col("chunk_index")), "chunks")
    have = store.read().select("doc_id").distinct()
    rows = st.chunk_rows(chunks, vector=None if vector is None else vector(F.col("text")))
    store.append(st.keep_first(rows.join(have, "doc_id", "left_anti")))
    counts = chunks.groupBy("source").agg(F.count("*").alias("chunks"))
    before = known.groupBy("file_path").agg(F.max("attempt").alias("_before"))
    run = texts.join(counts, "source", "left").join(before, "file_path", "left")
    run = run.select("file_path", "status", F.coalesce("chunks", F.lit(0).cast("long")).alias("chunks"), "error_text", (F.coalesce("_before", F.lit(0)) + F.col("attempt")).cast("int").alias("attempt"), F.current_timestamp().alias("updated_at"))
    run = scratch.save(run, "run")
    run.write.mode("append").parquet(checkpoint)
    return run
