"""Problem 8: sources mixed to target weights.

Method. Tokens are summed by source; a source's rate is its share of the collection's size over its own tokens, at most its repeats;
each document is emitted floor(rate) times, and once more if a hash of its id and the seed, as a number in [0, 1), is under the
rate's fraction.

Scale. Two passes without a shuffle of texts: sums are made in the tasks first, the rates (a row for each target) go to all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .tokens import TOKENIZER, token_counts


def source_key(col) -> F.Column:
    """Source names without regard to letter case and outer blanks; blank ones are null."""
    return F.nullif(F.lower(F.trim(col)), F.lit(""))


def uniform(id_col, seed: int) -> F.Column:
    """A number in [0, 1) that depends on the id and the seed only."""
    return F.shiftrightunsigned(F.xxhash64(id_col, F.lit(seed)), 11) / F.lit(float(1 << 53))


def rates(sized: DataFrame, targets: DataFrame, total_tokens: int | str = "available") -> DataFrame:
    """(source, target_share, max_repeats, docs, available, wanted, rate) of each target.

    wanted is a target's share of the size asked for, targets without any tokens left out of the shares. "available" asks for as
    many tokens as all targets have: sources that can't reach their share stay at max_repeats and are reported as short, the
    others have theirs of that size. "reached" asks for the largest size at which every target with tokens reaches its share, and
    so the scarcest one decides for all. A number is the size in tokens.
    """
    t = targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats").filter("source is not null and target_share > 0")
    t = t.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    own = sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("available"))
    x = t.join(own, "source", "left").fillna(0, ["docs", "available"])
    here = x.filter("available > 0").agg(F.sum("target_share").alias("present"), F.min(F.col("max_repeats") * F.col("available") / F.col("target_share")).alias("reach"), F.sum("available").alias("stock"))
    total = F.col("stock").cast("double") if total_tokens == "available" else F.col("reach") * F.col("present") if total_tokens == "reached" else F.lit(float(total_tokens))
    # one row beside a row for each target
    x = x.crossJoin(F.broadcast(here)).withColumn("wanted", F.when(F.col("available") > 0, F.col("target_share") / F.col("present") * total).otherwise(F.lit(0.0)))
    rate = F.when(F.col("available") > 0, F.least(F.col("max_repeats").cast("double"), F.col("wanted") / F.col("available"))).otherwise(F.lit(0.0))
    return x.select("source", "target_share", "max_repeats", "docs", "available", "wanted", rate.alias("rate"))


def mix(
    docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", total_tokens: int | str = "available", seed: int = 0, tokenizer: str = TOKENIZER
) -> tuple[DataFrame, DataFrame]:
    """The collection (id, source, copy, tokens) and its report, a row for each target.

    report: source, target_share, max_repeats, docs, available, wanted (tokens that its share amounts to), rate, spread (standard
    deviation of its tokens, from the copies that a hash decides), copies, tokens, actual_share, short (the repeats kept it
    under its share). Documents of unlisted sources and those without tokens are left out. Targets without documents get nothing and
    are reported so; several rows for one source are added up. No targets or no documents give an empty collection.
    """
    scratch = Scratch(docs.sparkSession, "p8")
    named = docs.select(id_col, text_col, source_key(F.col(source_col)).alias("source"))
    listed = targets.select(source_key(F.col("source")).alias("source")).filter("source is not null").distinct()
    # sources outside the list are left out before their texts are read by the tokenizer; the list has a row for each target
    some = named.join(F.broadcast(listed), "source", "left_semi").filter(f"`{text_col}` is not null and `{text_col}` <> ''")
    sized = scratch.save(token_counts(some, id_col, text_col, "source", tokenizer=tokenizer).filter("tokens > 0"), "sizes")
    r = scratch.save(rates(sized, targets, total_tokens), "rates")
    x = sized.join(F.broadcast(r.select("source", "rate")), "source")
    copies = (F.floor("rate") + (uniform("id", seed) < F.col("rate") - F.floor("rate")).cast("long")).cast("int")
    drawn = x.withColumn("n", copies).filter("n > 0").select("id", "source", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"), "tokens")
    got = drawn.groupBy("source").agg(F.count("*").alias("copies"), F.sum("tokens").alias("tokens"))
    part = F.col("rate") - F.floor("rate")
    spread = x.groupBy("source").agg(F.sqrt(F.sum(F.col("tokens").cast("double") * F.col("tokens") * part * (1 - part))).alias("spread"))
    all_tokens = got.agg(F.sum("tokens").alias("all_tokens"))
    report = r.join(got, "source", "left").join(spread, "source", "left").crossJoin(F.broadcast(all_tokens)).fillna(0, ["copies", "tokens", "spread"])
    report = report.select(
        "source", "target_share", "max_repeats", "docs", "available", F.round("wanted", 2).alias("wanted"), F.round("rate", 6).alias("rate"), F.round("spread", 2).alias("spread"), "copies", "tokens",
        F.round(F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("actual_share"),
        ((F.col("rate") >= F.col("max_repeats")) & (F.col("wanted") > F.col("max_repeats") * F.col("available")) | (F.col("available") == 0)).alias("short"),
    )
    return drawn, report
