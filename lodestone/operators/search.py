"""Search requests over a chunk corpus: modes, filters, fusion, reranking, traces and rendered results."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import text as tx
from ..functions.vectors import Embedder
from ..session import Scratch
from . import ranking as rk
from .index import StoreIndex


def search_mode(mode: str | None) -> str:
    """vector, text or hybrid: empty and unknown modes are vector, fts is text."""
    m = (mode or "vector").lower()
    return {"fts": "text"}.get(m, m if m in ("vector", "text", "hybrid") else "vector")


@dataclass
class Found:
    """rows in the order of rank, and how they were found."""

    rows: DataFrame
    trace: dict = field(default_factory=dict)
    scratch: Scratch | None = None
    snippet: bool = True

    def close(self) -> None:
        """Deletes what the search has stored; the rows can't be read any more."""
        if self.scratch is not None:
            self.scratch.drop()

    def collect(self) -> list[dict]:
        out = [r.asDict() for r in self.rows.orderBy("rank").collect()]
        self.trace["result_count"] = len(out)
        return out


def search(
    corpus: DataFrame, query: str, vector: list[float] | np.ndarray | None = None, limit: int = 20, mode: str = "vector", source_filter: str = "", category_filter: str = "",
    use_reranker: bool = True, scorer: rk.Scorer | None = None, embedder: Embedder | None = None, prefilter: bool = False, metric: str = "cosine", c: EngineConfig = EngineConfig(), index: StoreIndex | None = None,
) -> Found:
    """Text, source, chunk_index, category, relevance_score and distance of the best rows.

    text: BM25 within the filters. vector: the nearest rows, filtered afterwards unless ``prefilter``, so that fewer may be left. hybrid:
    both lists within the filters, fused by reciprocal ranks, or put in order by the reranker, whose failure falls back to fusion.
    Missing texts and sources are given as empty, missing indexes as 0. Text results carry their bm25 only. With an index of the
    corpus's store both lists come from it, and only rows that are found are read.
    """
    mode, limit = search_mode(mode), max(1, limit)
    trace = {"mode": mode, "limit": limit, "reranker": "none", "warning": "", "result_count": None}
    where = rk.filters(source_filter, category_filter)
    if vector is None and mode != "text":
        if embedder is None:
            raise ValueError("a vector or an embedder is needed for this mode")
        vector = embedder.encode([query])[0]
    vector = None if vector is None else [float(x) for x in vector]
    none = F.lit(None).cast("double")

    def near_rows(prefilter: bool) -> DataFrame:
        if index is None or metric != "cosine":
            return rk.top_vectors(corpus, vector, limit, metric, where, prefilter)
        allowed = corpus.filter(where).select("id") if where is not None and prefilter else None
        rows = index.fetch(scratch().save(index.vector_hits(vector, limit, allowed), "near-ids"))
        return rows.filter(where) if where is not None and not prefilter else rows

    def text_rows() -> DataFrame:
        if index is None:
            return rk.top_bm25(corpus, query, limit, c, where)
        allowed = None if where is None else corpus.filter(where).select("id")
        return index.fetch(scratch().save(index.text_hits(query, limit, allowed), "hit-ids"))

    made: list[Scratch] = []

    def scratch() -> Scratch:
        if not made:
            made.append(Scratch(corpus.sparkSession, "search"))
        return made[0]

    kept = ["id", "text", "source", "chunk_index", "category"]
    if mode == "vector":
        rows = near_rows(prefilter).withColumns({"relevance_score": none, "bm25": none})
        order = ["distance", "id"]
    elif mode == "text":
        rows = text_rows().withColumns({"relevance_score": none, "distance": none})
        order = [F.desc("bm25"), "id"]
    else:
        # two lists of at most ``limit`` rows are stored, so that the table is read for each once, whatever is done with them
        near = scratch().save(near_rows(True).select(*kept, "distance"), "near")
        hits = scratch().save(text_rows().select(*kept, "bm25"), "hits")
        lists = [rk.ranked(near, "distance", "id"), rk.ranked(hits, F.desc("bm25"), "id")]
        texts = near.select(kept).unionByName(hits.select(kept)).dropDuplicates(["id"])
        fused = rk.rrf(lists, c.rrf_k)
        trace["reranker"] = "rrf"
        if use_reranker:
            candidates = texts.join(rk.merged(*lists), "id").select("id", "position", "text")
            try:
                scored = rk.rerank(candidates, query, c, scorer).select("id", "score")
                if scorer is not None:  # a plug-in fails when it runs, so it runs here, on its bounded list
                    scored = scratch().save(scored, "scores")
                trace["reranker"] = "lexical" if scorer is None else getattr(scorer, "__name__", "scorer")
                fused = scored
            except Exception as e:  # noqa: BLE001
                trace["warning"] = f"reranker failed, ranks were fused: {type(e).__name__}"
        rows = texts.join(fused, "id").join(near.select("id", "distance"), "id", "left").join(hits.select("id", "bm25"), "id", "left")
        rows = rows.withColumnRenamed("score", "relevance_score").orderBy(F.desc("relevance_score"), "id").limit(limit)
        order = [F.desc("relevance_score"), "id"]
    # a window over the few rows left
    out = rows.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select(
        "rank", "id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("chunk_index", F.lit(0)).alias("chunk_index"),
        F.coalesce("category", F.lit("")).alias("category"), F.round("relevance_score", 4).alias("relevance_score"), F.round("distance", 4).alias("distance"), F.round("bm25", 4).alias("bm25"),
    )
    return Found(out, trace, made[0] if made else None)


def similar(corpus: DataFrame, text: str, embedder: Embedder, k: int = 5, exclude_source: str | None = None, c: EngineConfig = EngineConfig()) -> DataFrame:
    """Chunks nearest to the first c.similar_prefix characters of a text; the text's own source is left in unless it is excluded."""
    if len(text) < c.min_doc_chars:
        raise ValueError("the text is too short")
    k = min(max(k, 1), 20)
    where = None if exclude_source is None else ~F.col("source").eqNullSafe(F.lit(exclude_source))
    q = [float(x) for x in embedder.encode([text[: c.similar_prefix]])[0]]
    near = rk.top_vectors(corpus, q, k, where=where, prefilter=True)
    return near.select("id", "source", "chunk_index", F.round(1 - F.col("distance"), 4).alias("similarity"), tx.one_line(F.coalesce("text", F.lit(""))).alias("snippet"))


def evidence(found: Found) -> tuple[list[dict], str]:
    """Numbered evidence and its text block."""
    items = [{"cite": f"[{i}]", **{k: r[k] for k in ("source", "chunk_index", "category", "text")}} for i, r in enumerate(found.collect(), 1)]
    if not items:
        return items, "No evidence was found."
    return items, "\n\n".join(f"{e['cite']} source: {e['source']} (chunk #{e['chunk_index']})\n{e['text']}" for e in items)


def evidence_rows(rows: DataFrame) -> DataFrame:
    """(cite, source, chunk_index, category, text) of a ranked result."""
    return rows.select(F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("]")).alias("cite"), "source", "chunk_index", "category", "text")


def rendered(found: Found, query: str, snippet: bool | None = None) -> str:
    """A text of the results; texts are shown by their beginnings unless ``snippet`` is off."""
    snippet = found.snippet if snippet is None else snippet
    body = found.rows.withColumns({"name": tx.basename(F.col("source")), "shown": tx.snippet(F.col("text")) if snippet else F.col("text")})
    rows = body.orderBy("rank").collect()
    found.trace["result_count"] = len(rows)
    if not rows:
        return f"Nothing was found for '{query}'."
    t = found.trace
    head = f"{len(rows)} results for '{query}' (mode {t['mode']}, reranker {t['reranker']}{', ' + t['warning'] if t['warning'] else ''})"
    score = lambda r: f" score {r.relevance_score:.4f}" if r.relevance_score is not None else ""
    kind = lambda r: f" [{r.category}]" if r.category else ""
    return "\n\n".join([head, *(f"{r['rank']}. {r['name']} #{r.chunk_index}{score(r)}{kind(r)}\n   source: {r.source}\n   {r.shown}" for r in rows)])
