"""Sizes of texts in tokens of a public tokenizer (byte-level BPE ranks of tiktoken's file format)."""

from __future__ import annotations

import base64
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the tokenizer's vocabulary was made to cut texts before merging (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(2)
def _encoding(data: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("lodestone", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(texts: list[str | None], data: bytes) -> list[int]:
    enc = _encoding(data)
    return [len(enc.encode_ordinary(t)) if t else 0 for t in texts]


def token_counts(df: DataFrame, id_col: str, text_col: str, *keep: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, tokens, and the columns ``keep``) of every row; null and empty texts have 0 tokens. The tokenizer's file (under a MB) goes to each task."""
    shared = df.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())
    fields = [f for f in df.select(*keep).schema] if keep else []

    def run(batches):
        for b in batches:
            n = pa.array(count(b.column("text").to_pylist(), shared.value), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id"), n, *(b.column(c) for c in keep)], names=["id", "tokens", *keep])

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *keep)
    schema = "id long, tokens long" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in fields)
    return src.mapInArrow(run, schema)
