"""Problem 1: near-duplicate records, by bottom-k sketches.

Method. One hash function orders all shingles; a record's sketch is its lowest hashes. An inverted list for each of the ``keep``
lowest gives the records that overlap; overlaps are counted by pair. The sketch of the union, put together from the two records'
stored sketches of ``estimate`` values, estimates the likeness of the pairs that overlap enough; only for those that are left are
texts read, and the exact Jaccard value of the whole sets decides.

Scale. Records with equal shingle sets are one class and only its representative is compared. A value retained by more than ``hot``
representatives is looked up together with the shingle after it. Where that list is longer than ``hotter`` as well, the value is
common. A record of whose retained values at most a quarter are common does without their lists: with any record that is alike it
shares enough of the others, of which fewer are asked for then. A record with more is sketched again without common values. If so
much of it is common that this alone may make two records alike, it stays on the long lists as well: such records are a family whose
pairs are the result. No list is cut and nothing depends on the size of the table; lists are joined, never collected. As the pairs on
the lists grow faster than the table, they are worked off in rounds by the first record, each of so many pairs for a representative;
what a round or step leaves on disk, shuffle files too, goes when it ends.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch, broadcast_if_small
from .shingles import HASH_BITS, Block, blocks, mix

#: A round's pairs for each representative: on the lists, and of those whose texts are read. Rounds bound the disk, whatever the number of pairs.
PAIRS_AT_ONCE, TEXTS_AT_ONCE = 48, 2
#: Representatives that a table counts as at least, so that a small one isn't worked off in many rounds.
LEAST_RECORDS = 20_000


@dataclass(frozen=True)
class Likeness:
    """width: tokens in a shingle; threshold: least Jaccard value; keep: values with an inverted list; hot, hotter: longest lists by value and by context; estimate: values of the stored sketch."""

    width: int = 5
    threshold: float = 0.8
    keep: int = 20
    hot: int = 12
    hotter: int = 128
    estimate: int = 64

    def least_shared(self) -> str:
        """SQL: how many retained values a pair must share, by the sizes a_n and b_n of its sets.

        Sets within ``keep`` are retained whole, so that threshold * the larger size is a bound; one in four of it is asked
        for, as split lists may hide shared values. Larger sets share 3 with a chance of over 1 - 1e-4 at likeness 0.6.
        """
        return f"least(3, greatest(1, cast(floor(least(a_n, b_n, {self.keep}) * {self.threshold} / 4) as int)))"

    def deviation(self, likeness: float) -> float:
        """Standard deviation of a share that a stored sketch gives."""
        return math.sqrt(likeness * (1 - likeness) / self.estimate)

    def least_estimate(self) -> float:
        return self.threshold - 4.5 * self.deviation(self.threshold)

    def family_share(self) -> float:
        """Share of common values from which on these alone may make two records alike: 2 t / (1 + t) of each of two sets of one size."""
        whole = 2 * self.threshold / (1 + self.threshold)
        return whole - 3 * self.deviation(whole)


def sketches(df: DataFrame, p: Likeness) -> DataFrame:
    """(id, fp, n, vals, ctx, low) for each record (id, text[, without]) with at least one shingle.

    vals: the ``keep`` lowest hashes, ctx: each with the shingle after it; low: the ``estimate`` lowest, of each the upper 32 bits.
    Values whose upper bits are in a record's ``without`` are left out of its vals and low.
    """
    schema = "id long, fp long, n int, vals array<long>, ctx array<long>, low binary"
    width, keep, many = p.width, p.keep, p.estimate
    cut = np.uint64(HASH_BITS - 32)

    def run(batches):
        for batch in batches:
            for part, texts in blocks(batch):
                b = Block(texts, width, positions=True)
                among = None
                if "without" in part.schema.names:
                    lists = part.column("without")
                    rows = np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
                    out = (rows.astype(np.uint64) << np.uint64(32)) | pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.uint64)
                    among = ~np.isin((b.row.astype(np.uint64) << np.uint64(32)) | (b.values.astype(np.uint64) >> cut), out)
                at, offsets = b.lowest(keep, among)
                pos = b.at[at]
                v = b.values[at].astype(np.uint64)
                own, last = b.raw_row[pos], len(b.raw) - 1
                # the shingle a width further on in the same text, else as far back, else none
                beside = np.zeros(len(pos), np.uint64)
                for step in (-width, width):
                    q = np.clip(pos + step, 0, last)
                    there = (pos + step >= 0) & (pos + step <= last) & (b.raw_row[q] == own)
                    beside[there] = b.raw[q[there]]
                lowest, ends = b.lowest(many, among)
                data = (b.values[lowest].astype(np.uint64) >> cut).astype(np.uint32)
                low = pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((ends * 4).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
                offs = pa.array(offsets, pa.int32())
                two = (pa.ListArray.from_arrays(offs, pa.array(x.astype(np.int64))) for x in (v, mix(v * np.uint64(3) + mix(beside))))
                out = pa.RecordBatch.from_arrays([part.column("id"), pa.array(b.fingerprints()), pa.array(b.sizes.astype(np.int32)), *two, low], names=["id", "fp", "n", "vals", "ctx", "low"])
                yield out.filter(pa.array(b.sizes > 0))

    return df.mapInArrow(run, schema)


def _postings(sketch: DataFrame) -> DataFrame:
    x = sketch.select("id", "n", F.explode(F.arrays_zip("vals", "ctx")).alias("x"))
    return x.select("id", "n", F.col("x.vals").alias("v"), F.col("x.ctx").alias("c"))


def _split(postings: DataFrame, scratch: Scratch, p: Likeness) -> DataFrame:
    """The postings with hot (the value's list is long) and common (that of its context is, too)."""
    long1 = scratch.save(postings.groupBy("v").count().filter(F.col("count") > p.hot).select("v", F.lit(True).alias("hot")), "long-lists")
    x = postings.join(broadcast_if_small(long1), "v", "left")
    long2 = scratch.save(x.filter("hot").groupBy("c").count().filter(F.col("count") > p.hotter).select("c", F.lit(True).alias("common")), "longer-lists")
    x = x.join(broadcast_if_small(long2), "c", "left")
    return x.select("id", "n", "v", "c", F.coalesce("hot", F.lit(False)).alias("hot"), F.coalesce("common", F.lit(False)).alias("common"))


def _keys(own: DataFrame, texts: DataFrame, scratch: Scratch, p: Likeness) -> DataFrame:
    """(key, w, id, n): the lists that a record is on, each counting w towards the overlap that is asked for.

    A pair can only share as many common values as both have, so that of the two w the lower one counts: of at most two values
    left out nothing need be made up for; with up to four, two others are enough, with five one.
    """
    x = scratch.save(_split(_postings(own), scratch, p), "postings")
    # of records with common values: how many of the retained ones
    share = scratch.save(x.groupBy("id").agg(F.sum(F.col("common").cast("int")).alias("h"), F.count("*").alias("k")).filter("h > 0"), "shares")
    much = scratch.save(share.filter("4 * h > k").select("id"), "much-common")
    key, w = F.when(F.col("hot"), F.col("c")).otherwise(F.col("v")), F.when(F.col("hot"), 2).otherwise(1)
    weighed = x.filter(~F.col("common")).join(broadcast_if_small(share.select("id", "h")), "id", "left")
    first = weighed.select(key.alias("key"), (w + F.when(F.col("h") >= 5, 2).when(F.col("h") >= 3, 1).otherwise(0)).alias("w"), "id", "n")
    if not much.limit(1).count():
        return first
    # sketched again without the common ones of their lowest values: those with long lists, and those that many of these records have
    low = scratch.save(_lowest(own.join(broadcast_if_small(much), "id", "left_semi")), "lowest")
    many = low.groupBy("u").agg(F.count("*").alias("m")).filter(F.col("m") > p.hotter).select("u")
    common = scratch.save(x.filter("common").select(F.shiftright("v", HASH_BITS - 32).alias("u")).unionByName(many).distinct(), "common-values")
    held = low.join(common, "u").groupBy("id").agg(F.collect_list("u").alias("without"), F.first("k").alias("k"))  # at most p.estimate
    held = scratch.save(held, "held-common")
    again = scratch.save(sketches(texts.join(held.select("id", "without"), "id"), p), "sketched-again")
    y = _split(_postings(again), scratch, p).filter(~F.col("common"))
    # other lists than those of the first sketches; here one shared value is enough
    second = y.select(F.xxhash64(key, F.lit(2)).alias("key"), F.lit(3).alias("w"), "id", "n")
    family = held.filter(F.size("without") >= p.family_share() * F.col("k")).select("id")
    stay = x.filter("common").join(broadcast_if_small(scratch.save(family, "families")), "id", "left_semi").select(F.col("c").alias("key"), F.lit(3).alias("w"), "id", "n")
    return first.unionByName(second).unionByName(stay)


def _lowest(sketch: DataFrame) -> DataFrame:
    """(id, k, u): the k numbers of each stored sketch, a row for each."""

    def run(batches):
        for t in batches:
            data = t.column("low").to_pylist()
            k = np.fromiter((len(d) // 4 for d in data), np.int32, len(data))
            row = pa.array(np.repeat(np.arange(len(data)), k))
            u = np.frombuffer(b"".join(data), np.uint32).astype(np.int64)
            yield pa.RecordBatch.from_arrays([t.column("id").take(row), pa.array(np.repeat(k, k)), pa.array(u)], names=["id", "k", "u"])

    return sketch.select("id", "low").mapInArrow(run, "id long, k int, u long")


def similar_pairs(
    df: DataFrame, id_col: str = "row_id", text_col: str = "text", params: Likeness = Likeness(),
    at_once: float = PAIRS_AT_ONCE, texts_at_once: float = TEXTS_AT_ONCE, least_records: int = LEAST_RECORDS,
) -> tuple[DataFrame, DataFrame]:
    """Pairs of class representatives (rep_a < rep_b, likeness) and the membership (id, rep).

    A class is all records with one set of shingles; its representative is the lowest id. Records without a shingle (null, empty
    or short texts) are like none and in neither result. Ids must be unique; columns beside id and text are ignored. An empty
    table gives empty results. at_once, texts_at_once: pairs on the lists, and pairs whose texts are read, in a round, for each of the
    representatives, which count as ``least_records`` at least.
    """
    spark = df.sparkSession
    scratch, first, second, third, fourth = (Scratch(spark, name, tidy=True) for name in ("p1", "p1-sketches", "p1-postings", "p1-lists", "p1-candidates"))
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sk = first.save(sketches(texts, params), "sketches")
    reps = sk.groupBy("fp").agg(F.min("id").alias("rep"))
    members = scratch.save(sk.select("fp", "id").join(reps, "fp").select("id", "rep", "fp"), "members")
    copies = first.save(members.filter("id <> rep").select("id"), "copies")
    own = sk.join(broadcast_if_small(copies), "id", "left_anti")
    keyed = _keys(own, texts, second, params)
    low = third.save(own.select("id", "low"), "low")
    first.drop()
    # a list of one record gives no pair
    lists = third.save(keyed.withColumn("m", F.count("*").over(Window.partitionBy("key"))).filter("m > 1"), "lists")
    second.drop()
    records, on_lists = max(low.count(), least_records), (lists.agg(F.sum(F.col("m") - 1)).first()[0] or 0) // 2
    candidates = []
    for rows in _rounds(lists, "id", on_lists, at_once * records):
        now = Scratch(spark, "p1-round", tidy=True)
        shared = now.save(_overlaps(rows, lists, params), "overlaps")
        candidates.append(fourth.save(estimated(shared, low, params, now), "candidates"))
        now.drop()
    third.drop()
    candidates = reduce(DataFrame.unionByName, candidates)
    pairs = []
    for rows in _rounds(candidates, "a", candidates.count(), texts_at_once * records):
        now = Scratch(spark, "p1-round", tidy=True)
        found = verify(rows, texts, params, now)
        pairs.append(scratch.save(found.select(F.col("a").alias("rep_a"), F.col("b").alias("rep_b"), "likeness"), "pairs"))
        now.drop()
    fourth.drop()
    return reduce(DataFrame.unionByName, pairs), members.select("id", "rep")


def _rounds(df: DataFrame, col: str, n: int, most: float) -> list[DataFrame]:
    """The rows of df by a hash of ``col``, in as many parts as ``n`` has ``most``: together they are all rows, each once."""
    k = max(1, math.ceil(n / max(1, most)))
    return [df] if k == 1 else [df.filter(F.pmod(F.xxhash64(col), F.lit(k)) == i) for i in range(k)]


def _overlaps(rows: DataFrame, lists: DataFrame, p: Likeness) -> DataFrame:
    """(a, b) of the pairs, a among ``rows``, that share enough of their lists."""
    a, b = (d.select("key", F.col("w").alias(f"{x}_w"), F.col("id").alias(x), F.col("n").alias(f"{x}_n")) for d, x in ((rows, "a"), (lists, "b")))
    t = p.threshold
    return (
        a.join(b, "key")
        .filter(f"a < b and a_n >= {t} * b_n and b_n >= {t} * a_n")
        .groupBy("a", "b")
        .agg(F.sum(F.least("a_w", "b_w")).alias("c"), F.first("a_n").alias("a_n"), F.first("b_n").alias("b_n"))
        .filter(F.expr(f"c >= {p.least_shared()}"))
        .select("a", "b")
    )


def union_estimate(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """Share of the k lowest values of the union that both sides have; rows of sorted distinct 32-bit values, filled up with the highest 64-bit number."""
    none = np.iinfo(np.uint64).max
    both = np.sort(np.concatenate([x, y], 1), axis=1)
    twice = np.zeros(both.shape, bool)
    twice[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != none)
    first = ~twice & (both != none)
    rank = np.cumsum(first, axis=1)  # a second one has its first one's rank
    return (twice & (rank <= k)).sum(1) / np.maximum(1, (first & (rank <= k)).sum(1))


def estimated(pairs: DataFrame, sketch: DataFrame, p: Likeness, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) that the union's sketch doesn't rule out; it is put together from the records' stored sketches."""
    wanted = scratch.save(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")
    low = sketch.join(broadcast_if_small(wanted), "id", "left_semi").select("id", "low")
    least, k = p.least_estimate(), p.estimate

    def rows(column) -> np.ndarray:
        data = column.to_pylist()
        size = np.fromiter((len(d) // 4 for d in data), np.int64, len(data))
        out = np.full((len(data), k), np.iinfo(np.uint64).max, np.uint64)
        out[np.arange(k) < size[:, None]] = np.frombuffer(b"".join(data), np.uint32)
        return out

    def run(batches):
        for t in batches:
            keep = union_estimate(rows(t.column("x")), rows(t.column("y")), k) >= least
            yield t.select(["a", "b"]).filter(pa.array(keep))

    j = pairs.join(low.select(F.col("id").alias("a"), F.col("low").alias("x")), "a").join(low.select(F.col("id").alias("b"), F.col("low").alias("y")), "b")
    return j.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def verify(candidates: DataFrame, texts: DataFrame, p: Likeness, scratch: Scratch, others: DataFrame | None = None) -> DataFrame:
    """(a, b, likeness) of the candidates that reach the threshold, by the whole sets.

    texts (id, text) holds both sides, or the first if ``others`` holds the second. The texts themselves are joined to the pairs:
    they are smaller than their shingles.
    """
    j = candidates
    ids = {"a": [F.col("a")], "b": [F.col("b")]} if others is not None else dict.fromkeys("ab", [F.explode(F.array("a", "b"))])
    wanted = None
    for side, rows in (("a", texts), ("b", texts if others is None else others)):
        if side == "a" or others is not None:
            wanted = scratch.save(candidates.select(*ids[side]).toDF("id").distinct(), "wanted")
        some = rows.join(broadcast_if_small(wanted), "id", "left_semi")
        j = j.join(some.select(F.col("id").alias(side), F.col("text").alias(f"t{side}")), side)
    j = j.select("a", "b", "ta", "tb")
    return j.mapInArrow(lambda batches: (x for b in batches for x in _likeness(b, p)), "a long, b long, likeness double")


def _likeness(batch: pa.RecordBatch, p: Likeness):
    for part, texts in blocks(batch, "ta"):
        x, y = Block(texts, p.width), Block(part.column("tb").to_pylist(), p.width)
        n = len(texts)
        key = [(z.row << HASH_BITS) | z.values for z in (x, y)]
        common = np.bincount(x.row[np.isin(key[0], key[1], assume_unique=True)], minlength=n)
        likeness = common / np.maximum(1, x.sizes + y.sizes - common)
        keep = np.flatnonzero(likeness >= p.threshold - 1e-12)
        rows = pa.array(keep)
        yield pa.RecordBatch.from_arrays([part.column("a").take(rows), part.column("b").take(rows), pa.array(likeness[keep])], names=["a", "b", "likeness"])


def all_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b) with a < b: the pairs of records, classes written out. Only for collections whose classes are small."""
    m, w = (members.select(F.col("rep").alias(f"rep_{x}"), F.col("id").alias(x)) for x in "ab")
    same = m.join(w, F.col("rep_a") == F.col("rep_b")).filter("a < b").select("a", "b")
    cross = pairs.join(m, "rep_a").join(w, "rep_b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return same.unionByName(cross)


def groups(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(id, group_id): the connected groups of similar records; group_id is the lowest id. Records that are like none are their own group.

    Alternates the star operations of connected components (each vertex and its neighbours to the lowest neighbour) on
    edges between representatives until nothing changes; every round is written to the shared folder.
    """
    spark = pairs.sparkSession
    scratch = Scratch(spark, "groups", tidy=True)
    e = scratch.save(pairs.select(F.col("rep_a").alias("u"), F.col("rep_b").alias("v")), "edges")
    before = None
    while True:
        # large star: neighbours above a vertex go to the lowest vertex it sees
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a vertex and its lower neighbours go to the lowest of these
        lo = large.groupBy("u").agg(F.min("v").alias("m"))
        e = scratch.save(large.join(lo, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "stars")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before is not None and tuple(now) == before:
            break
        before = tuple(now)
    top = e.groupBy(F.col("u").alias("rep")).agg(F.min("v").alias("g"))
    return members.join(top, "rep", "left").select("id", F.coalesce("g", "rep").alias("group_id"))
