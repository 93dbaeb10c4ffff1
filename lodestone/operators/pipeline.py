"""The two-phase job: PDFs become Markdown files, which are then indexed; and the split of oversized documents by pages."""

from __future__ import annotations

import hashlib
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..session import Scratch
from ..sources import files as fs
from . import rebuild as rb
from . import store as st

Reader = Callable[[str, bytes], tuple[str, bool]]
#: Exit codes: all went well; there was nothing to work on or with; some documents failed.
OK, NOTHING, FAILED = 0, 1, 2


def pending_documents(spark: SparkSession, root: str, markdown_dir: str, resume: bool, c: EngineConfig = EngineConfig()) -> tuple[DataFrame, int]:
    """The PDFs below a folder (or a single one) without a Markdown file of their name if ``resume``, and how many there are in all."""
    found = fs.scan(spark, root, (".pdf",), c)
    total = found.select("path").count()
    if resume:
        have = fs.scan(spark, markdown_dir, (".md",), c, content=False).select(F.regexp_replace("source", r"\.[^./]*$", "").alias("stem"))
        found = found.withColumn("stem", F.regexp_replace("source", r"\.[^./]*$", "")).join(have, "stem", "left_anti").drop("stem")
    return found.withColumn("file_path", F.col("path")), total


def convert_phase(spark: SparkSession, root: str, markdown_dir: str, reader: Reader, resume: bool = False, dry_run: bool = False, wait: float = 5.0, c: EngineConfig = EngineConfig()) -> dict:
    """Phase one. Documents that fail in parallel are tried once more, one after the other, in a single task."""
    began = time.monotonic()
    todo, total = pending_documents(spark, root, markdown_dir, resume, c)
    if dry_run:
        names = todo.select("source").orderBy("source")
        return {"documents": total, "pending": names.count(), "first": [r.source for r in names.limit(20).collect()], "dry_run": True}
    scratch = Scratch(spark, "convert")
    first = scratch.save(rb.convert(todo, reader, wait=wait, least=c.min_doc_chars), "first")
    failed = first.filter("status = 'failed'").select("file_path")
    again = scratch.save(rb.convert(todo.join(failed, "file_path", "left_semi").coalesce(1), reader, 1, wait, c.min_doc_chars), "again")
    every = first.join(again.select("file_path"), "file_path", "left_anti").select(*first.columns).unionByName(again)
    written = rb.export_markdown(every.filter("status = 'done'"), markdown_dir).count()
    bad = every.filter("status = 'failed'").select("source", "error_text").orderBy("source")
    out = {"documents": total, "done": written, "skipped": total - first.count(), "empty": every.filter("status = 'empty'").count(), "failed": bad.count()}
    out |= {"errors": [tuple(r) for r in bad.limit(5).collect()], "seconds": round(time.monotonic() - began, 1)}
    scratch.drop()
    return out


def run(store: st.Store, root: str, reader: Reader | None, markdown_dir: str = "", checkpoint: str = "", resume: bool = False, ingest: bool = True, dry_run: bool = False, vector=None, wait: float = 5.0, c: EngineConfig = EngineConfig()) -> tuple[dict, int]:
    """Both phases: a summary and an exit code. Without a reader or any document nothing is done."""
    spark = store.spark
    if reader is None:
        return {"error": "no converter"}, NOTHING
    target = markdown_dir or os.path.splitext(root.rstrip("/"))[0] + "_md"
    one = convert_phase(spark, root, target, reader, resume, dry_run, wait, c)
    if not one["documents"]:
        return {"error": f"no PDF below {root}"}, NOTHING
    summary = {"input": root, "markdown_dir": target, "convert": one, "ingest": None}
    if ingest and not dry_run:
        rows = rb.rebuild(store, [target], checkpoint or f"{store.path}/rebuilt", vector, c=c, wait=wait)
        summary["ingest"] = {r.status: r.n for r in rows.groupBy("status").agg(F.count("*").alias("n")).collect()}
    return summary, FAILED if one.get("failed") or (summary["ingest"] or {}).get("failed") else OK


def file_hash(path: str, block: int = 1 << 20) -> str:
    """SHA-256 of a file, read in blocks."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while data := f.read(block):
            h.update(data)
    return h.hexdigest()


def split_manifest(path: str, pages: int, size_of: Callable[[int, int], int], most_pages: int = 200, most_bytes: int = 200 * 1024 * 1024) -> dict:
    """How a document is to be cut: ranges of at most ``most_pages`` pages, halved until ``size_of(first, last)`` is within ``most_bytes``.

    A page that is too large by itself, and limits under 1, are errors.
    """
    if most_pages < 1 or most_bytes < 1:
        raise ValueError("limits must be at least 1")
    parts = [p for at in range(1, pages + 1, most_pages) for p in fs.fit_ranges(at, min(at + most_pages - 1, pages), size_of, most_bytes)]
    stem = os.path.splitext(os.path.basename(path))[0]
    segments = [
        {"segment": k, "name": f"{stem}.part-{k:04d}.pages-{a:04d}-{b:04d}.pdf", "page_start": a, "page_end": b, "page_count": b - a + 1, "size_bytes": size_of(a, b), "status": "pending"}
        for k, (a, b) in enumerate(parts, 1)
    ]
    return {"version": 1, "source_path": os.path.abspath(path), "source_sha256": file_hash(path), "total_pages": pages, "max_pages": most_pages, "max_bytes": most_bytes, "segments": segments}
