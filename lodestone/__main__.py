"""Command line: python -m lodestone DB COMMAND [ARGUMENT] [options]; see --help."""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from .api import KnowledgeBase, serve
from .config import EngineConfig
from .functions import vectors as vx
from .operators import manage as mg
from .operators import pipeline as pl
from .operators import rebuild as rb
from .operators import search as se
from .operators.images import batch_queries
from .session import build_session

COMMANDS = {
    "search": "QUERY: the best chunks", "images": "QUERIES, set apart by ||: the best images", "status": "counts and settings", "list": "documents by their chunks", "report": "a text report",
    "add": "FOLDER: indexes what is new", "reindex": "FOLDER: indexes all, in place of what is stored", "update": "FILE", "delete": "PATTERN", "dedupe": "keeps the first of each fingerprint",
    "rebuild": "FOLDERS, set apart by commas, with a checkpoint", "pipeline": "FOLDER of PDFs: converts, then indexes", "serve": "the HTTP server",
}


def _named(name: str):
    """The object that module:attribute names."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def main(args: list[str] | None = None) -> int:
    a = argparse.ArgumentParser(prog="lodestone", formatter_class=argparse.RawDescriptionHelpFormatter, epilog="\n".join(f"{k}: {v}" for k, v in COMMANDS.items()))
    a.add_argument("db")
    a.add_argument("do", choices=COMMANDS)
    a.add_argument("argument", nargs="?", default="")
    a.add_argument("--limit", type=int, default=5)
    a.add_argument("--source", default="")
    a.add_argument("--mode", default="hybrid")
    a.add_argument("--full", action="store_true", help="whole texts in search results")
    a.add_argument("--port", type=int, default=8003)
    a.add_argument("--markdown-dir", default="")
    a.add_argument("--converter", default="", help="module:function, from (name, bytes) to (text, is Markdown)")
    a.add_argument("--resume", action="store_true")
    a.add_argument("--no-ingest", action="store_true")
    a.add_argument("--dry-run", action="store_true")
    x = a.parse_args(args)
    kb = KnowledgeBase(build_session(), x.db, EngineConfig.from_env())
    show = lambda v: print(json.dumps(v, ensure_ascii=False, default=str, indent=2))
    vector = lambda c: vx.embed(c, kb.embedder)
    if x.do == "search":
        print(se.rendered(kb.search_knowledge(x.argument, x.limit, source_filter=x.source, search_mode=x.mode, snippet_mode=not x.full), x.argument))
    elif x.do == "images":
        for q in batch_queries(x.argument):
            print(q, *(f"  {r.similarity:.4f} {r.image_path}" for r in kb.search_images(q, x.limit, x.source).collect()), sep="\n")
    elif x.do == "status":
        show(kb.get_knowledge_status())
    elif x.do == "list":
        show([r.asDict() for r in kb.list_documents(limit=x.limit).collect()])
    elif x.do == "report":
        print(mg.report(kb.store.read()))
    elif x.do in ("add", "reindex"):
        show(kb.add_documents(x.argument, x.do == "reindex", x.markdown_dir))
    elif x.do == "update":
        show(kb.update_document(x.argument))
    elif x.do == "delete":
        show(kb.delete_documents(x.argument))
    elif x.do == "dedupe":
        show({"removed": kb.dedupe()})
    elif x.do == "rebuild":
        rows = rb.rebuild(kb.store, x.argument.split(","), f"{kb.path}/rebuilt", vector, c=kb.config, dry_run=x.dry_run)
        show([r.asDict() for r in rows.collect()] if x.dry_run else [r.asDict() for r in mg.run_summary(rows).collect()])
    elif x.do == "pipeline":
        summary, code = pl.run(kb.store, x.argument, _named(x.converter) if x.converter else None, x.markdown_dir, f"{kb.path}/rebuilt", x.resume, not x.no_ingest, x.dry_run, vector, c=kb.config)
        show(summary)
        return code
    else:
        serve(kb, x.port).serve_forever()
    return 0


if __name__ == "__main__":
    sys.exit(main())
