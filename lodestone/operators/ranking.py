"""Ranking: vector top-k, BM25, fusion and reranking, as plans over a corpus table.

A corpus has a unique ``id``, ``text``, ``source``, ``category``, ``chunk_index`` and ``vector``. Ties go to the lower id. A top-k is an
``orderBy().limit()``, which Spark plans as a bounded heap in each task, not as a sort of the table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import text as tx
from ..functions import vectors as vx

Scorer = Callable[[str, list[str]], list[float]]


def filters(source: str = "", category: str = "") -> Column | None:
    """Source containment (case-sensitive, % and _ are wildcards) and category equality, joined by AND; None without any."""
    out = None
    if source:
        out = tx.like_filter(F.col("source"), source)
    if category:
        same = F.col("category") == category
        out = same if out is None else out & same
    return out


def top_vectors(corpus: DataFrame, query: list[float], k: int, metric: str = "cosine", where: Column | None = None, prefilter: bool = False, largest: int = 0) -> DataFrame:
    """The k nearest rows with ``distance`` (cosine distance, or squared L2); filters apply to the k rows found unless ``prefilter``.

    Vectors that are null, of another length than the query, all zero or not finite are no candidates. k below 1 counts as 1.
    """
    k = max(1, k) if not largest else min(max(1, k), largest)
    q = F.array(*(F.lit(float(x)) for x in query))
    norm = float(np.linalg.norm(np.asarray(query, np.float64)))
    v = vx.doubles(F.col("vector"))
    if metric == "cosine":
        distance = 1 - vx.dot(v, q) / (F.sqrt(vx.dot(v, v)) * F.lit(norm))
    elif metric == "l2":
        distance = vx.squared_l2(F.col("vector"), q)
    else:
        raise ValueError(f"unknown metric {metric}")
    rows = corpus.filter(vx.usable(F.col("vector"), len(query)))
    if where is not None and prefilter:
        rows = rows.filter(where)
    out = rows.withColumn("distance", distance).orderBy("distance", "id").limit(k)
    return out.filter(where) if where is not None and not prefilter else out


def corpus_statistics(corpus: DataFrame, terms: list[str]) -> DataFrame:
    """One row: n documents, mean length in tokens, and for each term the number of documents that hold it."""
    t = corpus.select(tx.tokens(F.coalesce("text", F.lit(""))).alias("t"))
    holds = [F.sum(F.array_contains("t", w).cast("long")).alias(f"df{i}") for i, w in enumerate(terms)]
    return t.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("mean_len"), *holds)


def _is(word: str):
    return lambda x: x == word


def top_bm25(corpus: DataFrame, query: str, k: int | None, c: EngineConfig = EngineConfig(), where: Column | None = None, statistics: DataFrame | None = None) -> DataFrame:
    """Rows with at least one query word, by ``bm25``; filters apply before ranking, the statistics are the whole corpus's.

    Null texts count as empty documents. One pass gives the statistics (a row), a second the scores; nothing is shuffled but
    the top rows. A query without words gives no rows.
    """
    terms = list(dict.fromkeys(w.lower() for w in vx._WORD.findall(query.lower())))
    if not terms:
        return corpus.withColumn("bm25", F.lit(None).cast("double")).limit(0)
    stats = corpus_statistics(corpus, terms) if statistics is None else statistics
    t = tx.tokens(F.coalesce("text", F.lit("")))
    rows = corpus if where is None else corpus.filter(where)
    rows = rows.withColumn("_t", t).withColumns({"_len": F.size("_t"), **{f"_f{i}": F.size(F.filter("_t", _is(w))) for i, w in enumerate(terms)}})
    rows = rows.drop("_t").filter(" + ".join(f"_f{i}" for i in range(len(terms))) + " > 0").crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"_f{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (c.bm25_k1 + 1) / (tf + c.bm25_k1 * (1 - c.bm25_b + c.bm25_b * F.col("_len") / F.col("mean_len")))
    out = rows.withColumn("bm25", score).select(*corpus.columns, "bm25")
    return out if k is None else out.orderBy(F.desc("bm25"), "id").limit(max(1, k))


def ranked(df: DataFrame, *order: Column | str) -> DataFrame:
    """id and rank (from 1) of a bounded list."""
    return df.select("id", F.row_number().over(Window.orderBy(*order)).alias("rank"))


def rrf(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """(id, score): the sum of 1 / (k + rank) over lists of (id, rank)."""
    both = lists[0]
    for x in lists[1:]:
        both = both.unionByName(x)
    return both.groupBy("id").agg(F.sum(1 / (F.lit(float(k)) + F.col("rank"))).alias("score"))


def merged(vector_list: DataFrame, text_list: DataFrame) -> DataFrame:
    """(id, position): vector rows in their order, then rows that only the text list has."""
    both = vector_list.select("id", F.lit(0).alias("b"), "rank").unionByName(text_list.select("id", F.lit(1).alias("b"), "rank"))
    first = both.groupBy("id").agg(F.min(F.struct("b", "rank")).alias("o"))
    return first.select("id", F.row_number().over(Window.orderBy("o")).alias("position"))


def lexical_scorer(query: str, texts: list[str]) -> list[float]:
    """Share of the query's distinct words that a text holds."""
    asked = set(vx._WORD.findall(query.lower()))
    return [len(asked & set(vx._WORD.findall((t or "").lower()))) / len(asked) if asked else 0.0 for t in texts]


def lexical_score(query: str, text: Column) -> Column:
    """The same as an expression."""
    asked = sorted(set(vx._WORD.findall(query.lower())))
    if not asked:
        return F.lit(0.0)
    return F.size(F.array_intersect(F.array_distinct(tx.tokens(F.coalesce(text, F.lit("")))), F.array(*map(F.lit, asked)))) / float(len(asked))


def rerank(candidates: DataFrame, query: str, c: EngineConfig = EngineConfig(), scorer: Scorer | None = None) -> DataFrame:
    """Scores the first c.rerank_top rows by position on their first c.rerank_chars characters; the others get 0. candidates has id, position, text.

    Without a scorer the lexical expression is used, which stays in the JVM; a scorer runs by Arrow batches on the bounded list.
    """
    cut = F.substring(F.coalesce("text", F.lit("")), 1, c.rerank_chars)
    if scorer is None:
        score = lexical_score(query, cut)
    else:

        @F.pandas_udf("double")
        def run(s: pd.Series) -> pd.Series:
            return pd.Series(scorer(query, s.tolist()), dtype="float64")

        score = run(cut)
    head = candidates.filter(F.col("position") <= c.rerank_top).withColumn("score", score)
    return head.unionByName(candidates.filter(F.col("position") > c.rerank_top).withColumn("score", F.lit(0.0)))


def matrix(rows: DataFrame, id_col: str, vector_col: str, most: int = 20_000) -> tuple[list[int], np.ndarray]:
    """Ids and unit vectors of a bounded table; more than ``most`` rows are an error."""
    got = rows.select(F.col(id_col).alias("i"), vx.doubles(F.col(vector_col)).alias("v")).limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} query vectors: ask in parts")
    got.sort(key=lambda r: r.i)
    x = np.array([r.v for r in got], np.float64)
    return [r.i for r in got], x / np.linalg.norm(x, axis=1, keepdims=True) if len(got) else x


def vector_block(column: pa.Array) -> np.ndarray:
    """Rows of an array column of one length as unit vectors."""
    flat = np.asarray(pc.list_flatten(column).to_numpy(zero_copy_only=False), np.float64)
    x = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def batch_top(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, similarity, rank): the k most similar rows for each query of a bounded table (query_id, query_vector).

    Each Arrow batch is one matrix product with all queries and gives its own k best; a window ranks these. Vectors must be usable
    and of one length. Similarities are compared to nine places, ties go to the lower id.
    """
    names, q = matrix(queries, "query_id", "query_vector")
    shared = corpus.sparkSession.sparkContext.broadcast((np.array(names, np.int64), q))

    def run(batches):
        ids_q, m = shared.value
        for b in batches:
            if not b.num_rows or not len(ids_q):
                continue
            ids = b.column("id").to_numpy(zero_copy_only=False)
            for i, row in enumerate(m @ vector_block(b.column("vector")).T):
                coarse = np.round(row, 9)
                at = np.flatnonzero(coarse >= np.partition(coarse, -k)[-k]) if len(row) > k else np.arange(len(row))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), ids_q[i])), pa.array(ids[at]), pa.array(row[at])], names=["query_id", "id", "similarity"])

    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), "id")
    found = corpus.select(F.col("id").cast("long").alias("id"), vx.doubles(F.col("vector")).alias("vector")).mapInArrow(run, "query_id long, id long, similarity double")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
