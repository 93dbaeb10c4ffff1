"""Listings, counts, reports and reassembly over the chunk store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def document_counts(rows: DataFrame) -> DataFrame:
    """(source, chunks, category, first_seq) by source; the category is the first one seen that isn't null. Null sources are one document."""
    return rows.groupBy("source").agg(F.count("*").alias("chunks"), F.min_by(F.coalesce("category", F.lit("")), "seq").alias("category"), F.min("seq").alias("first_seq"))


def category_counts(rows: DataFrame) -> DataFrame:
    """(category, n) of categories that aren't blank, most first, then as first seen."""
    x = rows.filter(F.col("category") != "").groupBy("category").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))
    return x.orderBy(F.desc("n"), "first_seq").select("category", "n")


def listing(rows: DataFrame, category: str = "", limit: int = 50) -> DataFrame:
    """The documents with most chunks, of a category (letter case is ignored) if one is given; at most 200."""
    docs = document_counts(rows)
    if category:
        docs = docs.filter(F.lower("category") == category.lower())
    return docs.orderBy(F.desc("chunks"), "first_seq").limit(min(max(limit, 1), 200)).select("source", "chunks", "category")


def status(rows: DataFrame) -> DataFrame:
    """One row: rows, documents, rows with a vector, and the time of the last ingestion as spelled."""
    return rows.agg(
        F.count("*").alias("rows"), (F.count_distinct("source") + F.max(F.col("source").isNull().cast("int"))).cast("long").alias("documents"), F.count("vector").alias("with_vector"), F.max("ingested_at").alias("last_ingested")
    )


def reassemble(rows: DataFrame, matches: Column, most: int = 5) -> DataFrame:
    """(source, chunks, text) of the first ``most`` sources that match: chunks by index, then as ingested, one below the other.

    One document's text is put together in one task: documents, not sources such as web hosts, are meant.
    """
    some = rows.filter(matches).select("source").distinct().orderBy("source").limit(most)
    x = rows.join(F.broadcast(some), "source", "left_semi")
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "seq", F.coalesce("text", F.lit("")).alias("text"))))
    return x.groupBy("source").agg(F.count("*").alias("chunks"), F.array_join(F.transform(parts, lambda p: p.text), "\n").alias("text"))


def casefold_match(pattern: str, column: str = "source") -> Column:
    """Containment without regard to letter case, ß and ss being the same."""
    return F.contains(F.replace(F.lower(column), F.lit("ß"), F.lit("ss")), F.lit(pattern.casefold()))


def estimate(texts: DataFrame, text_col: str = "text", chunk_size: int = 800, min_chars: int = 20) -> DataFrame:
    """One row: files, files too short, characters, and the chunks to expect."""
    n = F.length(F.coalesce(text_col, F.lit("")))
    some = n >= min_chars
    chars = F.coalesce(F.sum(F.when(some, n)), F.lit(0))
    files = F.count(F.when(some, 1))
    return texts.agg(F.count("*").alias("files"), F.count(F.when(~some, 1)).alias("short"), chars.alias("chars"), (F.floor(chars / chunk_size) + files).alias("chunks"))


def latest_attempts(checkpoint: DataFrame) -> DataFrame:
    """The last row of each file of a rebuild's checkpoint: highest attempt, then latest; of equal ones any, as they say the same."""
    order = [F.desc_nulls_last("attempt"), F.desc_nulls_last("updated_at"), "status", F.desc_nulls_last("chunks")]
    w = Window.partitionBy("file_path").orderBy(*order)
    return checkpoint.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def pending_files(files: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Files (file_path) that the last attempt didn't finish; done and empty ones are finished."""
    done = latest_attempts(checkpoint).filter(F.col("status").isin("done", "empty")).select("file_path")
    return files.join(done, "file_path", "left_anti")


def run_summary(checkpoint: DataFrame) -> DataFrame:
    """(status, files, chunks) of the last attempts; null and negative counts count as 0."""
    good = F.when(F.col("chunks") > 0, F.col("chunks")).otherwise(0)
    return latest_attempts(checkpoint).groupBy("status").agg(F.count("*").alias("files"), F.sum(good).alias("chunks"))


def report(rows: DataFrame) -> str:
    """A text report: totals, categories by size, documents by name. Built from aggregates; documents are listed by the iterator, not collected."""
    s = status(rows).first()
    lines = ["# Knowledge base", "", f"Rows: {s.rows}", f"Documents: {s.documents}", "", "## Categories", ""]
    lines += [f"- {r.category}: {r.n}" for r in category_counts(rows).collect()]
    lines += ["", "## Documents", ""]
    lines += [f"- {r.source} ({r.chunks})" for r in document_counts(rows).orderBy("source").toLocalIterator()]
    return "\n".join(lines) + "\n"


def snippet_rows(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"name": tx.basename(F.col("source")), "snippet": tx.snippet(F.col("text"))})
