"""The engine's tools as methods of one object, and a small HTTP server for search and status."""

from __future__ import annotations

import json
import os
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import EngineConfig
from .functions import chunking
from .functions import text as tx
from .functions import vectors as vx
from .lifecycle import IdleUnloader
from .operators import images as im
from .operators import index as ix
from .operators import manage as mg
from .operators import rebuild as rb
from .operators import search as se
from .operators import store as st
from .session import Scratch
from .sources import files as fs
from .streaming import watch as wa

IMAGES = "image_path string, file_name string, source_doc string, caption string, mtime_ns long, vector array<float>, seq long"


class KnowledgeBase:
    """A chunk store, an image store and what can be done with them."""

    def __init__(self, spark: SparkSession, path: str, config: EngineConfig = EngineConfig(), embedder: vx.Embedder | None = None, scorer=None, pdf=(), image_embedder=None, image_text_embedder: vx.Embedder | None = None, progress=None, fallback_embedder: vx.Embedder | None = None):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config
        self.embedder = embedder or vx.HashingEmbedder(config.dims)
        #: image_embedder makes a column of vectors from one of paths; image_text_embedder is the same model's side for query texts
        self.scorer, self.pdf, self.image_embedder, self.image_text_embedder = scorer, list(pdf), image_embedder, image_text_embedder or self.embedder
        self.fallback_embedder = fallback_embedder
        self.models = IdleUnloader(config.idle_seconds)
        for name, model in (("embedder", self.embedder), ("reranker", scorer), ("images", image_embedder)):
            if hasattr(model, "unload"):
                self.models.register(name, model.unload)
        self.progress = progress or (lambda done, total: None)
        self.store = st.Store(spark, f"{self.path}/chunks", buckets=config.store_buckets)
        self.images = st.Store(spark, f"{self.path}/images", IMAGES, "image_path", config.store_buckets)
        self.index = ix.StoreIndex(self.store, config.dims, config)
        self._watching = None

    # reading

    def corpus(self) -> DataFrame:
        if not self.store.exists():
            raise ValueError("the knowledge base is empty")
        return self.store.read().withColumn("id", ix.row_id())

    def _search(self, query: str, limit: int, use_reranker: bool, source_filter: str, search_mode: str, category_filter: str) -> se.Found:
        corpus = self.corpus()
        self.models.touch()
        self.index.refresh()  # nothing to do unless another process has written
        return se.search(corpus, query, limit=limit, mode=search_mode, source_filter=source_filter, category_filter=category_filter, use_reranker=use_reranker, scorer=self.scorer, embedder=self.embedder, c=self.config, index=self.index)

    def search_knowledge(self, query: str, limit: int = 5, use_reranker: bool = True, source_filter: str = "", search_mode: str = "vector", snippet_mode: bool = True, category_filter: str = "") -> se.Found:
        """The rows found; ``snippet_mode`` is for ``rendered``, which shows the beginnings of texts or all of them."""
        found = self._search(query, min(max(limit, 1), 20), use_reranker, source_filter, search_mode, category_filter)
        found.snippet = snippet_mode
        return found

    def ask_knowledge(self, query: str, limit: int = 5, use_reranker: bool = True, source_filter: str = "", category_filter: str = "", search_mode: str = "hybrid") -> dict:
        found = self._search(query, min(max(limit, 1), 10), use_reranker, source_filter, search_mode, category_filter)
        items, block = se.evidence(found)
        found.close()
        return {"evidence": items, "evidence_block": block}

    def get_knowledge_status(self) -> dict:
        rows = self.store.read()
        s = mg.status(rows).first().asDict()
        return s | {"version": self.store.version(), "categories": {r.category: r.n for r in mg.category_counts(rows).collect()}, "embedder": type(self.embedder).__name__, "reranker": "lexical" if self.scorer is None else getattr(self.scorer, "__name__", "scorer"), "indexes": ["postings", "cells"] if self.store.exists() else [], "dims": self.config.dims, "images": self.images.read().count(), "watching": self._watching is not None}

    def list_documents(self, category_filter: str = "", limit: int = 50) -> DataFrame:
        return mg.listing(self.store.read(), category_filter, limit)

    def get_document(self, filepath: str) -> DataFrame:
        return mg.reassemble(self.store.read(), mg.casefold_match(filepath))

    def search_similar(self, filepath: str, max_results: int = 5, exclude_self: bool = False) -> DataFrame:
        source, text, _ = self._one(filepath)
        return se.similar(self.corpus(), text, self.embedder, max_results, source if exclude_self else None, self.config)

    # writing

    def _one(self, filepath: str, scan_dir: str = "") -> tuple[str, str, bool]:
        """(source, text, Markdown) of one file; source is its name, or its path below ``scan_dir``."""
        root = os.path.abspath(scan_dir) if scan_dir else ""
        full = os.path.abspath(filepath)
        source = os.path.relpath(full, root).replace(os.sep, "/") if root and full.startswith(root + os.sep) else os.path.basename(full)
        file = fs.scan(self.spark, full, c=self.config).withColumn("source", F.lit(source))
        row = fs.texts(file, self.pdf).first()
        if row is None:
            raise ValueError(f"{filepath} is missing, too large or of an unknown kind")
        if len(row.text) < self.config.min_doc_chars:
            raise ValueError(f"{filepath} holds too little text")
        return source, row.text, row.markdown

    def _rows(self, texts: DataFrame) -> DataFrame:
        chunks = chunking.chunk_documents(texts, markdown_col="markdown", c=self.config).withColumn("seq", F.col("chunk_index"))
        return st.chunk_rows(chunks, vector=vx.embed(F.col("text"), self.embedder, self.fallback_embedder))

    def _added(self, rows: DataFrame) -> int:
        saved = Scratch(self.spark, "add").save(rows, "rows")
        n = saved.count()
        if n:
            self.store.append(saved)
            self.index.refresh()
        return n

    def _export(self, texts: DataFrame, folder: str) -> None:
        """Writes the texts below a folder of this machine or a shared one, as Markdown under their own names."""
        if folder:
            rb.export_markdown(texts.filter(F.length("text") >= self.config.min_doc_chars), folder)

    def add_documents(self, scan_dir: str, reindex_all: bool = False, export_markdown_dir: str = "") -> dict:
        """Indexes the files below a folder that aren't stored; with ``reindex_all`` all, in place of what is stored once they are read."""
        found = fs.scan(self.spark, scan_dir, c=self.config)
        todo = found if reindex_all else st.new_sources(found, self.store.read())
        scratch = Scratch(self.spark, "add")
        texts = scratch.save(fs.texts(todo, self.pdf), "texts")
        total = texts.count()
        self.progress(0, total)
        self._export(texts, export_markdown_dir)
        rows = scratch.save(self._rows(texts), "rows")
        n = rows.count()
        if n and reindex_all:
            self.store.overwrite(rows)
        elif n:
            self.store.append(rows)
        self.index.refresh()
        self.progress(total, total)
        return {"chunks": n, "documents": rows.select("source").distinct().count()}

    def add_single_document(self, filepath: str, scan_dir: str = "", export_markdown_dir: str = "", allow_repeats: bool = False) -> int:
        one = self.spark.createDataFrame([self._one(filepath, scan_dir)], "source string, text string, markdown boolean")
        self._export(one, export_markdown_dir)
        rows = self._rows(one)
        if not allow_repeats:
            rows = rows.join(self.store.read().select("doc_id").distinct(), "doc_id", "left_anti")
        return self._added(rows)

    def update_document(self, filepath: str, substring: bool = False) -> dict:
        """Puts a file's text in place of what is stored of it, in one version; nothing is taken out if the file can't be read."""
        one = self._one(filepath)
        rows = Scratch(self.spark, "update").save(self._rows(self.spark.createDataFrame([one], "source string, text string, markdown boolean")), "rows")
        name = one[0]
        where = st.source_match(name) if substring else F.lower(tx.basename(F.col("source"))) == name.lower()
        sources = self.store.read().filter(where).select("source").distinct().count()
        _, gone = self.store.replace(where, rows)
        self.index.refresh()
        return {"sources": sources, "deleted": gone, "added": rows.count()}

    def update_documents(self, paths: list[str]) -> dict:
        """The same for several files by their names, in one version; files without enough text change nothing."""
        files = fs.read_files(self.spark, paths, c=self.config).withColumn("source", tx.basename(F.col("path")))
        texts = fs.texts(files, self.pdf).filter(F.length("text") >= self.config.min_doc_chars)
        scratch = Scratch(self.spark, "update")
        texts = scratch.save(texts, "texts")
        rows = scratch.save(self._rows(texts), "rows")
        gone = 0
        if rows.limit(1).count():
            _, gone = self.store.replace(by=F.lower(tx.basename(F.col("source"))), values=texts.select(F.lower("source")), added=rows)
            self.index.refresh()
        out = {"sources": texts.select("source").distinct().count(), "deleted": gone, "added": rows.count()}
        scratch.drop()
        return out

    def delete_documents(self, source_pattern: str = "", confirm_all: bool = False) -> dict:
        if confirm_all:
            n = self.store.read().count()
            self.store.drop()
            return {"deleted": n, "remaining": 0, "sources": []}
        if not source_pattern:
            return {"deleted": 0, "warning": "give a pattern, or confirm_all to delete everything"}
        where = st.source_match(source_pattern)
        names = [r.source for r in self.store.read().filter(where).select("source").distinct().orderBy("source").limit(10).collect()]
        _, gone = self.store.replace(where) if names else (0, 0)
        self.index.refresh()
        return {"deleted": gone, "remaining": self.store.read().count(), "sources": names}

    def dedupe(self, purge: bool = False) -> int:
        rows = self.store.read()
        kept = st.purge_repeated(rows) if purge else st.keep_first(rows)
        before, now = rows.count(), kept.count()
        if now < before:
            # only the buckets that hold a row too many are written again
            gone = rows.select(ix.row_id().alias("id")).exceptAll(kept.select(ix.row_id().alias("id")))
            self.store.replace(by=ix.row_id(), values=Scratch(self.spark, "dedupe").save(gone, "gone"))
            self.index.refresh()
        return before - now

    def ingest_url(self, url: str, html: str | None = None, source_is_url: bool = False) -> int:
        page = fs.pages(self.spark.createDataFrame([(url, html if html is not None else fs.fetch(url))], "url string, html string"))
        source = F.col("url") if source_is_url else tx.host_source(F.col("url"))
        texts = page.select(source.alias("source"), "text", F.lit(False).alias("markdown"))
        if texts.first().source is None:
            raise ValueError(f"not a web address: {url}")
        return self._added(self._rows(texts.filter(F.length("text") >= self.config.min_page_chars)))

    # images

    def ingest_images(self, scan_dir: str, rebuild: bool = False, keep_old: bool = False) -> int:
        """Adds new and changed images; a changed one's old row goes unless ``keep_old``."""
        if self.image_embedder is None:
            raise ValueError("an image embedder is needed")
        if rebuild and self.images.exists():
            self.images.drop()
        found = fs.scan_images(self.spark, scan_dir, self.config)
        todo = st.changed_images(found, self.images.read())
        rows = Scratch(self.spark, "images").save(todo.withColumns({"caption": F.lit(""), "vector": self.image_embedder(F.col("image_path"))}).filter("vector is not null"), "rows")
        n = rows.count()
        if n and keep_old:
            self.images.append(rows)
        elif n:
            self.images.replace(by=F.col("image_path"), values=rows.select("image_path"), added=rows)
        return n

    def search_images(self, query: str, limit: int = 8, source_filter: str = "") -> DataFrame:
        rows = self.images.read().withColumn("id", F.xxhash64("image_path", "seq"))
        return im.top_images(rows, [float(x) for x in self.image_text_embedder.encode([query])[0]], min(max(limit, 1), 20), source_filter)

    # watching

    def start_watcher(self, watch_dir: str = "", checkpoint: str = "") -> None:
        if self._watching is not None:
            raise RuntimeError("already watching")
        root = watch_dir or os.getcwd()
        if not os.path.isdir(fs.local_path(root)):
            raise ValueError(f"no such folder: {root}")

        def apply(batch: DataFrame) -> None:
            self.update_documents([r.target for r in batch.select("target").distinct().collect()])  # names of the files of one step

        self._watching = wa.watch(self.spark, root, apply, checkpoint or f"{self.path}/watcher", self.config.debounce_seconds)

    def stop_watcher(self) -> bool:
        query, self._watching = self._watching, None
        if query is None:
            return False
        query.stop()
        return True


#: A form that posts a search and lists what comes back.
PAGE = """<!doctype html><meta charset="utf-8"><title>Lodestone</title><form id="f"><input id="q" autofocus> <button>Search</button></form><p id="s"></p><ol id="r"></ol>
<script>
const status = () => fetch("/api/status").then(r => r.json()).then(s => document.getElementById("s").textContent = s.documents + " documents, " + s.rows + " chunks");
status(); setInterval(status, 60000);
document.getElementById("f").onsubmit = async e => {
  e.preventDefault();
  const got = await (await fetch("/api/search", {method: "POST", body: JSON.stringify({query: document.getElementById("q").value})})).json();
  document.getElementById("r").replaceChildren(...(got.results || [{source: "", text: got.error}]).map(x => {
    const li = document.createElement("li"); li.textContent = x.source + " - " + x.text.slice(0, 500); return li; }));
};
</script>"""


def serve(kb: KnowledgeBase, port: int = 8003) -> ThreadingHTTPServer:
    """A server on this machine: GET /api/status, POST /api/search {query, limit, mode, source_filter}; searches run one at a time."""
    lock = threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def _send(self, code: int, body: dict) -> None:
            data = json.dumps(body, default=str).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Cache-Control", "no-store")
            self.send_header("Access-Control-Allow-Origin", "*")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _page(self) -> None:
            data = PAGE.encode()
            self.send_response(200)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):  # noqa: N802
            if self.path == "/api/status":
                with lock:
                    self._send(200, {"ok": True, **kb.get_knowledge_status()})
            elif self.path == "/":
                self._page()
            else:
                self._send(404, {"ok": False})

        def do_POST(self):  # noqa: N802
            if self.path != "/api/search":
                return self._send(404, {"ok": False})
            try:
                asked = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)))
                query = str(asked.get("query", "")).strip()
            except (ValueError, AttributeError):
                return self._send(400, {"ok": False, "error": "malformed JSON"})
            if not query:
                return self._send(200, {"ok": False, "error": "the query is blank"})
            try:
                with lock:
                    found = kb.search_knowledge(query, min(max(int(asked.get("limit", 5)), 1), 30), source_filter=asked.get("source_filter", ""), search_mode=asked.get("mode", "hybrid"))
                    rows = found.collect()
                    found.close()
                self._send(200, {"ok": True, "results": rows, "trace": found.trace})
            except Exception as e:  # noqa: BLE001
                self._send(200, {"ok": False, "error": str(e)})

        def log_message(self, *a):
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
