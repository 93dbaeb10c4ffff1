"""The registered queries of the problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import Scratch, table
from . import history as hi
from . import languages as lg
from . import lookalikes as la
from . import mixing as mx
from . import near_duplicates as nd
from . import packing as pk
from . import scans as sc
from . import splitting as sp
from . import vectors as ve
from .tokens import token_counts


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs, members = nd.similar_pairs(table(spark, d, "my_docs"), params=nd.Likeness(width=4, threshold=0.6))
    return nd.all_pairs(pairs, members).select(F.col("a").alias("row_id_a"), F.col("b").alias("row_id_b"))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """Class of each text of my_docs at the operator's own parameters (five words, 0.8)."""
    pairs, members = nd.similar_pairs(table(spark, d, "my_docs"))
    return nd.groups(pairs, members).select(F.col("id").alias("row_id"), "group_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    forms = la.canonical(table(spark, d, "documents"), keep_text=False)
    return la.look_alike_pairs(forms).select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p9_canonical(spark: SparkSession, d: str) -> DataFrame:
    """The canonical form of every text of documents."""
    return la.canonical(table(spark, d, "documents")).select(F.col("id").alias("doc_id"), F.col("text").alias("canonical"), (F.col("raw") != F.col("form")).alias("changed"))


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of all my_docs rows over 800 characters."""
    return sp.split_oversized(table(spark, d, "my_docs")).withColumnRenamed("id", "row_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """hard: the fewest unnatural cuts, as the dynamic programme finds them for pieces without overlap and outer white space, aren't none."""
    pieces = sp.split_oversized(table(spark, d, "my_docs"), overlap=0, trimmed=True).select("id", F.col("cut").isin(*sp.UNNATURAL).alias("unnatural"))
    return pieces.groupBy(F.col("id").alias("row_id")).agg(F.when(F.max("unnatural"), "hard").otherwise("soft").alias("kind"))


def p6_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """The texts put together from their pieces, and whether these keep limit and overlap."""
    w = Window.partitionBy("row_id").orderBy("chunk_index")
    before = F.lag("text").over(w)
    x = p6_pieces(spark, d).withColumns({"fits": F.length("text") <= sp.LIMIT, "laps": before.isNull() | F.startswith("text", F.right(before, F.lit(sp.OVERLAP)))})
    fresh = F.when(F.col("chunk_index") == 0, F.col("text")).otherwise(F.substring("text", sp.OVERLAP + 1, sp.LIMIT))
    # the pieces of one text
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", fresh.alias("t"))))
    whole = F.array_join(F.transform(parts, lambda p: p.t), "")
    return x.groupBy("row_id").agg(F.md5(whole.cast("binary")).alias("digest"), F.min("fits").alias("fits"), F.min("laps").alias("laps"), (F.max("chunk_index") + 1 == F.count("*")).alias("in_order"))


_ARRIVAL = ["batch_no", "missing", "at", "row_id"]


def _history(spark: SparkSession, d: str) -> tuple[hi.HistoryIndex, DataFrame]:
    """An index of my_docs, and chunk_batches with the columns of its order."""
    index = hi.HistoryIndex(spark, Scratch(spark, "index").root, nd.Likeness(width=4, threshold=0.6), buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    index.build(table(spark, d, "my_docs"))
    at = hi.instant(F.col("ingested_at"))
    return index, table(spark, d, "chunk_batches").withColumns({"missing": at.isNull(), "at": F.coalesce(at, F.lit(0).cast("timestamp"))})


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """All batches as one delivery."""
    index, batches = _history(spark, d)
    return index.screen(batches, _ARRIVAL).filter("not accepted").select(F.col("id").alias("row_id"))


def p2_by_batch(spark: SparkSession, d: str) -> DataFrame:
    """The same rows, each batch a delivery of its own that is screened against what the ones before left in the index."""
    index, batches = _history(spark, d)
    out = spark.createDataFrame([], "row_id long")
    for r in batches.select("batch_no").distinct().orderBy("batch_no").collect():  # a row for each delivery
        out = out.unionByName(index.screen(batches.filter(F.col("batch_no") == r.batch_no), _ARRIVAL).filter("not accepted").select(F.col("id").alias("row_id")))
    return out


def _neighbours(spark: SparkSession, d: str, p: ve.Search) -> DataFrame:
    return ve.neighbours([("chunk", table(spark, d, "my_docs"), "row_id", "vector"), ("image", table(spark, d, "image_chunks"), "image_id", "vector")], p)


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar rows of every usable row of my_docs and image_chunks."""
    return _neighbours(spark, d, ve.ANY)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    near = _neighbours(spark, d, ve.Search(least=0.9))
    return near.select("tab", F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def p4_segments(spark: SparkSession, d: str) -> DataFrame:
    """Language and confidence of every single-language stretch of my_docs."""
    segs = lg.segments(table(spark, d, "my_docs"))
    return segs.select(F.col("id").alias("row_id"), "seg_no", "lang", F.round("confidence", 4).alias("confidence"), "words")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    segs = lg.segments(table(spark, d, "my_docs"))
    case = segs.filter("declared is null or n_segs > 1 or lang <> declared")
    return case.select(F.col("id").alias("row_id"), "seg_no", "lang")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return sc.repair(table(spark, d, "my_docs"))[0]


def p5_texts(spark: SparkSession, d: str) -> DataFrame:
    """The repaired texts of the my_docs rows that hold scanned pages."""
    return sc.repair(table(spark, d, "my_docs"))[1]


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Where each text of documents goes, in containers of 2,048 tokens."""
    return pk.containers(table(spark, d, "documents")).withColumnRenamed("id", "doc_id")


def p7_placed(spark: SparkSession, d: str) -> DataFrame:
    """Of each text: whether its pieces make it up once, whether it is split only if it has to be, and whether its containers keep the capacity."""
    docs = table(spark, d, "documents")
    placed = pk.containers(docs)
    load = placed.groupBy("container").agg(F.sum("tokens").alias("load"))
    own = token_counts(docs, "doc_id", "text").withColumnRenamed("tokens", "own")
    x = placed.join(load, "container").groupBy("id").agg(
        F.sum("tokens").alias("t"), F.count("*").alias("n"), F.max("piece").alias("last"), F.max(F.col("start") + F.col("tokens")).alias("end"), F.max("load").alias("load")
    )
    c = pk.Fill.capacity
    return x.join(own, "id").select(
        F.col("id").alias("doc_id"), ((F.col("t") == F.col("own")) & (F.col("end") == F.col("own")) & (F.col("last") == F.col("n") - 1)).alias("whole"),
        (F.col("n") == F.ceil(F.col("own") / c)).alias("split_as_needed"), (F.col("load") <= c).alias("fits"),
    )


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return pk.fill_report(pk.containers(table(spark, d, "documents")))


def _mix(spark: SparkSession, d: str, total: int | str = "available") -> tuple[DataFrame, DataFrame]:
    return mx.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), total_tokens=total)


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The documents drawn, with a row for each copy: as many tokens as the sources hold, sources at their repeats stay short."""
    return _mix(spark, d)[0].withColumnRenamed("id", "doc_id")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p8_shares_reached(spark: SparkSession, d: str) -> DataFrame:
    """The shares of the largest collection in which each source reaches its own: the scarcest source decides."""
    return _mix(spark, d, "reached")[1]


def p8_bounds(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of p8_shares: repeats are kept, and a source has its wanted tokens, within five standard deviations, or all that it may give."""
    r = _mix(spark, d)[1]
    most = F.col("max_repeats") * F.col("available")
    near = F.abs(F.col("tokens") - F.least("wanted", most)) <= 5 * F.col("spread") + 1
    return r.select("source", "target_share", "max_repeats", "docs", (F.col("copies") <= F.col("docs") * F.col("max_repeats")).alias("repeats_kept"), near.alias("share_kept"), (F.col("tokens") <= most).alias("within_stock"))
