"""The text-to-image table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as vx
from . import ranking as rk


def source_filter(given: str) -> Column | None:
    """Path or parent folder contains the input; % is left out of it, _ is a wildcard."""
    x = given.replace("%", "")
    return (F.col("image_path").like(f"%{x}%") | F.col("source_doc").like(f"%{x}%")) if x else None


def top_images(images: DataFrame, query: list[float], k: int = 8, source: str = "") -> DataFrame:
    """The k images nearest to a query vector, filtered beforehand: similarity is cosine, at least 0, to four places."""
    rows = images.withColumnRenamed("image_id", "id") if "image_id" in images.columns else images
    near = rk.top_vectors(rows, query, min(max(k, 1), 50), where=source_filter(source), prefilter=True)
    return near.select("id", "image_path", "file_name", "source_doc", "caption", F.round(F.greatest(F.lit(0.0), 1 - F.coalesce("distance", F.lit(0.0))), 4).alias("similarity"))


def batch_queries(line: str) -> list[str]:
    """Queries of one line, set apart by double bars; blank ones are left out."""
    return [q.strip() for q in line.split("||") if q.strip()]


def best_labels(images: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, label, similarity): the most similar of a bounded table of labels (label, label_vector) for each image; ties go to the lower label."""
    names, q = rk.matrix(labels, "label", "label_vector")
    shared = images.sparkSession.sparkContext.broadcast((np.array(names, np.int64), q))

    def run(batches):
        ids, m = shared.value
        for b in batches:
            if b.num_rows and len(ids):
                sim = rk.vector_block(b.column("vector")) @ m.T
                best = np.round(sim, 9).argmax(1)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(ids[best]), pa.array(sim[np.arange(len(sim)), best])], names=["id", "label", "similarity"])

    return images.select(F.col("id").cast("long").alias("id"), vx.doubles(F.col("vector")).alias("vector")).mapInArrow(run, "id long, label long, similarity double")
