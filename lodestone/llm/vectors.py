"""Problem 3: the most similar vectors of every vector, by collision counting.

Method. Each vector has a code on each of several random projections. A query's window on a projection is centred on its own
value; a vector within the window collides, and one that collides on enough projections is a candidate. The windows start narrow
and are widened (virtual rehashing) up to the radius of the least similarity asked for; the arrays are sorted on the first
projection, so that a block of queries only sees a slice of them. Candidates are verified exactly.

Departure. Over a whole table, single-projection windows hold a fixed share of all rows and would pair all with all. So vectors are
first dealt to cells around pivots (a sample of the rows); a query visits the cells of its nearest pivots, and windows are opened
inside a cell only. There is a pivot for each ``cell`` rows, up to ``pivots`` of them (131 million rows at 500 a cell; a larger
table's cells grow, and are worked off in blocks). A row finds its nearest pivots by way of the centres of groups of pivots, which
are as many as the root of their number, so that its work grows with that root only.

Without a least similarity windows cut nothing off, as the fifth neighbour is often hardly nearer than the rest: a query is held
against all members of the cells that it visits, and they against it, and more cells are visited when there are more. It always
visits more than k cells, none of which is empty, so that k rows come out wherever the table has them.

Scale. A row travels as 64 one-byte components to a few cells; cells with too many rows are split in blocks. Of equal vectors only
the k + 1 lowest ids take part; the others get their neighbours from these.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import Scratch, broadcast_if_small
from .sampling import bounded_sample


@dataclass(frozen=True)
class Search:
    """k neighbours of at least ``least`` cosine (None: of any); cells of about ``cell`` rows, of which a row belongs to ``own`` and visits ``visit``.

    Without ``least``, ``visit`` is the number at 100 cells and grows with the 0.3rd power of the cells, over k at least.
    projections, need: number of windows and of collisions that make a candidate; pivots: bound of the sample.
    """

    k: int = 5
    least: float | None = 0.9
    dims: int = 64
    cell: int = 500
    own: int = 2
    visit: int = 8
    projections: int = 16
    need: int = 12
    pivots: int = 262_144
    block: int = 256

    def visits(self, cells: int) -> int:
        return min(cells, self.visit if self.least is not None else max(self.k + 1, math.ceil(self.visit * (cells / 100) ** 0.3)))


#: For the k most similar rows whatever their similarity.
ANY = Search(least=None, cell=2000, own=3)
#: Candidates that a cell gives beyond k, and how far below the k-th coded similarity they may be, as codes aren't exact.
SPARE, NEAR = 2, 0.008


def _usable(column: pa.ChunkedArray | pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the usable vectors of an array column, and these vectors."""
    rows = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), dims), False).to_numpy(zero_copy_only=False))
    x = np.asarray(pc.list_flatten(column.take(pa.array(rows))).cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)).reshape(-1, dims)
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    return rows[good], x[good]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # neither overflow nor underflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _bytes(x: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(x)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(data.shape[1] * data.itemsize), len(data), [None, pa.py_buffer(data.tobytes())]).cast(pa.binary())


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(-1, dims)


def prepare(df: DataFrame, id_col: str, vector_col: str, tab: str, p: Search) -> DataFrame:
    """(tab, id, digest, code, scale) of the usable vectors: of the right length, finite and not all zero. Codes are one byte a component."""

    def run(batches):
        for b in batches:
            rows, x = _usable(b.column("v"), p.dims)
            u = _unit(x)
            scale = np.abs(u).max(1) / 127
            code = np.rint(u / scale[:, None]).astype(np.int8)
            # to seven places: multiples of a vector are the same vector here
            digest = [xxhash.xxh3_64_intdigest(r.tobytes()) - (1 << 63) for r in np.rint(u * 1e7).astype(np.int32)]
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(rows)), pa.array(digest, pa.int64()), _bytes(code), pa.array(scale.astype(np.float32))],
                names=["id", "digest", "code", "scale"],
            )

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter("v is not null")
    return src.mapInArrow(run, "id long, digest long, code binary, scale float").select(F.lit(tab).alias("tab"), "*")


def _pivots(front: DataFrame, p: Search) -> dict[str, PivotGroups]:
    """A sample of each table, at most p.pivots vectors, so that a cell has about p.cell rows."""
    out = {}
    for tab, n in sorted((r.tab, r.n) for r in front.groupBy("tab").agg(F.count("*").alias("n")).collect()):
        many = max(1, min(p.pivots, n // p.cell))
        rows = bounded_sample(front.filter(F.col("tab") == tab), "id", many, n).select("code").collect()
        x = np.unique(np.frombuffer(b"".join(r.code for r in rows), np.int8).reshape(-1, p.dims), axis=0).astype(np.float32)
        out[tab] = PivotGroups(x / np.linalg.norm(x, axis=1, keepdims=True))
    return out


class PivotGroups:
    """Pivots in groups around some of them."""

    def __init__(self, pivots: np.ndarray):
        self.pivots, self.count = pivots, len(pivots)
        many = math.ceil(self.count**0.5)
        self.centres = pivots[:: max(1, self.count // many)][:many]
        near = np.concatenate([(pivots[at : at + 4096] @ self.centres.T).argmax(1) for at in range(0, self.count, 4096)] or [np.zeros(0, int)])
        self.members = [np.flatnonzero(near == g) for g in range(len(self.centres))]
        self.groups = [pivots[m] for m in self.members]
        #: groups that a row looks into: all of a few, then twice the root of their number
        self.looks = min(len(self.centres), max(16, math.ceil(2 * len(self.centres) ** 0.5)))

    def nearest(self, x: np.ndarray, visit: int) -> np.ndarray:
        """For each row the numbers of its ``visit`` nearest pivots, the nearest first, of those in the groups it looks into."""
        order = np.argsort(-(x @ self.centres.T), axis=1, kind="stable")[:, : self.looks]
        rows, pivots, sims = [], [], []
        for g in np.unique(order):
            mine = np.flatnonzero((order == g).any(1))
            s = x[mine] @ self.groups[g].T
            k = min(visit, s.shape[1])
            best = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < s.shape[1] else np.tile(np.arange(k), (len(mine), 1))
            rows.append(np.repeat(mine, k))
            pivots.append(self.members[g][best].ravel())
            sims.append(np.take_along_axis(s, best, 1).ravel())
        row, pivot, sim = (np.concatenate(z) for z in (rows, pivots, sims))
        place = np.lexsort((pivot, -sim, row))
        row, pivot = row[place], pivot[place]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        top = rank < visit
        out = np.zeros((len(x), visit), np.int64)
        out[row[top], rank[top]] = pivot[top]
        few = np.flatnonzero(np.bincount(row, minlength=len(x)) < visit)  # its groups hold too few: all are looked at
        if len(few):
            out[few] = np.argsort(-(x[few] @ self.pivots.T), axis=1, kind="stable")[:, :visit]
        return out


def _deal(front: DataFrame, pivots: dict[str, PivotGroups], p: Search) -> DataFrame:
    """(tab, cell, id, code, scale, member): each row to the cells that it visits, of which it is a member of the nearest."""
    shared = front.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        for b in batches:
            tabs = np.array(b.column("tab").to_pylist(), dtype=object)
            code = _matrix(b.column("code"), p.dims)
            for tab in sorted(set(tabs)):
                rows = np.flatnonzero(tabs == tab)
                pv = shared.value[tab]
                visit = p.visits(pv.count)
                for at in range(0, len(rows), 2048):
                    part = rows[at : at + 2048]
                    near = pv.nearest(code[part].astype(np.float32), visit)
                    take = pa.array(np.repeat(part, visit))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([tab] * len(take)), pa.array(near.ravel().astype(np.int32)), *(b.column(c).take(take) for c in ("id", "code", "scale")), pa.array(np.tile(np.arange(visit) < p.own, len(part)))],
                        names=["tab", "cell", "id", "code", "scale", "member"],
                    )

    return front.select("tab", "id", "code", "scale").mapInArrow(run, "tab string, cell int, id long, code binary, scale float, member boolean")


def _levels(p: Search) -> list[float]:
    """Radii of the windows: half, then all of the distance at the least similarity."""
    far = float(np.sqrt(2 - 2 * p.least))
    return [far / 2, far]


def count_collisions(q: np.ndarray, x: np.ndarray, p: Search) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (into q and x, rows of unit vectors) that collide on enough projections within the widest window that is needed."""
    a = np.random.default_rng(1618).standard_normal((p.dims, p.projections)).astype(np.float32)
    radius = _levels(p)[-1]
    unit = 2 * radius / 24  # two standard deviations of the widest window are 24 steps
    pq, px = (np.clip(np.rint(z @ a / unit), -127, 127).astype(np.int16) for z in (q, x))
    oq, ox = np.argsort(pq[:, 0], kind="stable"), np.argsort(px[:, 0], kind="stable")
    pq, px, sx = pq[oq], np.ascontiguousarray(px[ox].T.astype(np.int8)), px[ox, 0]
    out_q, out_x = [], []
    for at in range(0, len(pq), p.block):
        part = pq[at : at + p.block]
        found = np.zeros(len(part), np.int64)
        for level, r in enumerate(_levels(p)):
            w = int(round(24 * r / radius))
            todo = np.flatnonzero(found < p.k)  # the window is widened for queries that have too few so far
            if not len(todo):
                break
            sub = part[todo]
            lo, hi = np.searchsorted(sx, sub[:, 0].min() - w), np.searchsorted(sx, sub[:, 0].max() + w, "right")
            hits = np.zeros((len(sub), hi - lo), np.uint8)
            for i in range(p.projections):
                own = sub[:, i]
                low, high = np.clip(own - w, -128, 127).astype(np.int8)[:, None], np.clip(own + w, -128, 127).astype(np.int8)[:, None]
                row = px[i, lo:hi][None, :]
                hits += (row >= low) & (row <= high)
            i, j = np.nonzero(hits >= p.need)
            if level + 1 < len(_levels(p)):
                # only what verifies within the narrow radius ends the search for a query
                sim = np.einsum("ij,ij->i", q[oq[at + todo[i]]], x[ox[lo + j]])
                found[todo] += np.bincount(i, weights=sim >= 1 - r * r / 2, minlength=len(todo)).astype(np.int64) - 1
                done = found[todo][i] >= p.k
                i, j = i[done], j[done]
            out_q.append(oq[at + todo[i]])
            out_x.append(ox[lo + j])
    return (np.concatenate(out_q), np.concatenate(out_x)) if out_q else (np.zeros(0, int), np.zeros(0, int))


def _blocks(dealt: DataFrame, scratch: Scratch, p: Search) -> tuple[DataFrame, bool]:
    """The dealt rows with mp and qp, the block of members and of queries in their cell; whether members have a row of their own beside the query's."""
    sizes = dealt.groupBy("tab", "cell").agg(F.sum(F.col("member").cast("long")).alias("m"), F.count("*").alias("n"))
    # as many rows as there are pivots, which are bounded
    parts = scratch.save(sizes.select("tab", "cell", F.ceil(F.col("m") / (8 * p.cell)).cast("int").alias("ms"), F.ceil(F.col("n") / (32 * p.cell)).cast("int").alias("qs")), "blocks")
    x = dealt.join(F.broadcast(parts), ["tab", "cell"])
    own_m, own_q = (F.pmod(F.xxhash64("id", F.lit(s)), F.greatest(F.col(c), F.lit(1))).cast("int") for s, c in ((1, "ms"), (2, "qs")))

    def every(c):
        return F.sequence(F.lit(0), F.greatest(F.col(c), F.lit(1)) - 1)

    queries = x.select("tab", "cell", "id", "code", "scale", F.lit(False).alias("member"), F.explode(every("ms")).alias("mp"), own_q.alias("qp"))
    members = x.filter("member").select("tab", "cell", "id", "code", "scale", F.lit(True).alias("member"), own_m.alias("mp"), F.explode(every("qs")).alias("qp"))
    split = parts.filter("ms > 1 or qs > 1").limit(1).count() > 0
    if split:
        rows = queries.unionByName(members)
    else:  # one block a cell: a member row is also the query
        rows = x.select("tab", "cell", "id", "code", "scale", "member", F.lit(0).alias("mp"), F.lit(0).alias("qp"))
    return rows, split


def _candidates(dealt: DataFrame, scratch: Scratch, p: Search) -> DataFrame:
    """(tab, a, b), a < b: pairs that collide often enough and whose coded similarity isn't below the least by more than the codes' error."""
    rows, split = _blocks(dealt, scratch, p)

    def compare(t: pa.Table) -> pa.Table:
        member = t.column("member").to_numpy()
        ids, tab = t.column("id").to_numpy(), t.column("tab")[0].as_py()
        u = _matrix(t.column("code"), p.dims).astype(np.float32) * t.column("scale").to_numpy()[:, None]
        mi, qi = np.flatnonzero(member), np.flatnonzero(~member) if split else np.arange(len(ids))
        i, j = count_collisions(u[qi], u[mi], p)
        a, b = qi[i], mi[j]
        keep = ids[a] != ids[b]
        a, b = a[keep], b[keep]
        sim = np.einsum("ij,ij->i", u[a], u[b]) if len(a) else np.zeros(0)
        a, b = a[sim >= p.least - 0.015], b[sim >= p.least - 0.015]
        pairs = np.unique(np.stack([np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])], 1), axis=0)
        return pa.table({"tab": pa.array([tab] * len(pairs), pa.string()), "a": pairs[:, 0], "b": pairs[:, 1]})

    return rows.groupBy("tab", "cell", "mp", "qp").applyInArrow(compare, "tab string, a long, b long").distinct()


_NEAR = np.dtype([("id", "<i8"), ("sim", "<f4")])


def _best(a: np.ndarray, b: np.ndarray, sim: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, sim, rank) of the most similar b of each a, sorted; equal ones by b."""
    order = np.lexsort((b, -sim, a))
    a, b, sim = a[order], b[order], sim[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])  # the same pair has the same coded similarity, wherever it is met
    a, b, sim = a[new], b[new], sim[new]
    rank = np.arange(len(a)) - np.searchsorted(a, a)
    top = rank < keep
    return a[top], b[top], sim[top], rank[top]


def _kth(s: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest value of each row."""
    return np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] >= k else np.full(len(s), -8, np.float32)


def _packed(a: np.ndarray, sim: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions and a similarity to six places in one number each, which sorts by a, falling similarity and b."""
    return (a.astype(np.int64) << 41) | (np.rint(1e6 - sim * 1e6).astype(np.int64).clip(0, (1 << 21) - 1) << 20) | b


def _first(keys: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The keep first packed numbers of each a, sorted; their rank."""
    keys = np.sort(keys)
    a = keys >> 41
    start = np.flatnonzero(np.append(True, a[1:] != a[:-1])[: len(a)])
    rank = np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a))))
    return keys[rank < keep], rank[rank < keep]


def _unpacked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return keys >> 41, 1 - (keys >> 20 & ((1 << 21) - 1)) / 1e6, keys & ((1 << 20) - 1)


def most_similar(q: np.ndarray, x: np.ndarray, q_ids: np.ndarray, x_ids: np.ndarray, keep: int, block: int) -> tuple[np.ndarray, ...]:
    """(id, other, sim, rank): for each row of q the keep most similar of x, and for each of x those of q; rows with one id aren't compared."""
    oq, ox = np.argsort(q_ids), np.argsort(x_ids)  # positions in the order of the ids, so that ties go to the lower
    q, q_ids, x, x_ids = q[oq], q_ids[oq], x[ox], x_ids[ox]
    if max(len(q), len(x)) > 1 << 20:
        raise ValueError("a block of over a million rows")
    at_id = np.clip(np.searchsorted(x_ids, q_ids), 0, len(x) - 1)
    own = np.where(x_ids[at_id] == q_ids, at_id, -1)
    floor, seen, out = np.full(len(x), -8, np.float32), np.zeros(0, np.int64), []
    for at in range(0, len(q), block):
        s = q[at : at + block] @ x.T
        r = np.flatnonzero(own[at : at + block] >= 0)
        s[r, own[at + r]] = -9
        # values that can't be among the best aren't looked at: each side has keep better ones, but for the last place of six
        if not at:
            floor = _kth(np.ascontiguousarray(s[:256].T), keep) - np.float32(2e-6)
        low = _kth(s[:, :1024], keep) - np.float32(2e-6)
        for side, least in enumerate((low[:, None], floor)):
            hit = np.flatnonzero(s >= np.maximum(least, -8))
            i, j = np.divmod(hit, len(x))
            if side:
                seen, rank = _first(np.concatenate([seen, _packed(j, s.ravel()[hit], at + i)]), keep)
            else:
                out.append(_first(_packed(at + i, s.ravel()[hit], j), keep)[0])
        full = _unpacked(seen[rank == keep - 1])
        floor[full[0]] = full[1] - 2e-6
    (a, sim, b), (c, other, d) = _unpacked(np.concatenate(out)), _unpacked(seen)
    return _best(np.concatenate([q_ids[a], x_ids[c]]), np.concatenate([x_ids[b], q_ids[d]]), np.concatenate([sim, other]), keep)


def _nearest(dealt: DataFrame, rows: int, scratch: Scratch, p: Search) -> DataFrame:
    """(tab, a, b), a < b: each row with the k most similar of the cells that it visits or is visited in, and those that the codes can't tell from them."""
    blocks, split = _blocks(dealt, scratch, p)

    def compare(t: pa.Table) -> pa.Table:
        member, ids = t.column("member").to_numpy(), t.column("id").to_numpy()
        u = _matrix(t.column("code"), p.dims).astype(np.float32)
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        mi, qi = np.flatnonzero(member), np.flatnonzero(~member) if split else np.arange(len(ids))
        if not len(mi) or not len(qi):
            return pa.table({"tab": pa.array([], pa.string()), "id": pa.array([], pa.int64()), "near": pa.array([], pa.binary())})
        a, b, sim, rank = most_similar(u[qi], u[mi], ids[qi], ids[mi], p.k + SPARE, p.block)
        near = np.empty(len(b), _NEAR)
        near["id"], near["sim"] = b, sim
        first = np.flatnonzero(rank == 0)
        offsets = np.append(first, len(b)).astype(np.int32) * _NEAR.itemsize
        lists = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(near.tobytes())])
        return pa.table({"tab": pa.array([t.column("tab")[0].as_py()] * len(first), pa.string()), "id": a[first], "near": lists})

    near = blocks.groupBy("tab", "cell", "mp", "qp").applyInArrow(compare, "tab string, id long, near binary")

    def merge(t: pa.Table) -> pa.Table:
        lists = t.column("near").to_pylist()
        x = np.frombuffer(b"".join(lists), _NEAR)
        a, b, sim, rank = _best(np.repeat(t.column("id").to_numpy(), [len(y) // _NEAR.itemsize for y in lists]), x["id"], x["sim"], p.k + SPARE)
        kth = sim[np.maximum(np.arange(len(a)) - np.maximum(rank - p.k + 1, 0), 0)]
        keep = (rank < p.k) | (sim >= kth - NEAR)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[keep], axis=0)
        return pa.table({"tab": pa.array([t.column("tab")[0].as_py()] * len(pairs), pa.string()), "a": pairs[:, 0], "b": pairs[:, 1]})

    # about as many rows in each part, whatever the size of the table
    part = F.pmod(F.xxhash64("id"), F.lit(max(1, rows // 20_000)))
    return near.groupBy("tab", part.alias("part")).applyInArrow(merge, "tab string, a long, b long").distinct()


def neighbours(tables: list[tuple[str, DataFrame, str, str]], p: Search = Search()) -> DataFrame:
    """(tab, id, neighbour, similarity, rank): up to k most similar other rows of at least the least similarity, for every usable row. Without a least similarity k rows for each, if the table has them.

    tables: (name, table, id column, vector column) each, searched by itself. Similarity is the cosine, rounded to six decimals;
    between equal ones the lower id goes first. Rows whose vector is null, of another length, all zero or not finite have no
    row and are no neighbour. Ids must be unique in a table; other columns are ignored. Empty tables give no rows.
    """
    spark: SparkSession = tables[0][1].sparkSession
    scratch = Scratch(spark, "p3")
    coded = None
    for tab, df, id_col, vector_col in tables:
        one = prepare(df, id_col, vector_col, tab, p)
        coded = one if coded is None else coded.unionByName(one)
    coded = scratch.save(coded, "codes")
    ranked = Window.partitionBy("tab", "digest").orderBy("id")
    heads = scratch.save(coded.select("tab", "digest", "id").withColumn("place", F.row_number().over(ranked)).filter(F.col("place") <= p.k + 1), "heads")
    crowded = heads.filter(F.col("place") == p.k + 1).select("tab", "digest")
    behind = scratch.save(
        coded.select("tab", "digest", "id").join(crowded, ["tab", "digest"], "left_semi").join(heads.select("tab", "id"), ["tab", "id"], "left_anti"), "behind"
    )
    front = coded.join(broadcast_if_small(behind.select("tab", "id")), ["tab", "id"], "left_anti")
    dealt = _deal(front, _pivots(front, p), p)
    if p.least is None:  # many visits: dealt twice rather than stored
        candidates = scratch.save(_nearest(dealt, front.count(), scratch, p), "candidates")
    else:
        candidates = scratch.save(_candidates(scratch.save(dealt, "cells"), scratch, p), "candidates")
    pairs = scratch.save(_verified(tables, candidates, p), "pairs")
    both = pairs.select("tab", F.col("a").alias("id"), F.col("b").alias("neighbour"), "similarity").unionByName(pairs.select("tab", F.col("b").alias("id"), F.col("a").alias("neighbour"), "similarity"))
    # the rows behind see what the first row of their vector sees, and that row
    first = heads.filter("place = 1").join(crowded, ["tab", "digest"], "left_semi").select("tab", "digest", F.col("id").alias("head"))
    seen = first.join(both.withColumnRenamed("id", "head"), ["tab", "head"]).select("tab", "digest", "neighbour", "similarity").unionByName(
        first.select("tab", "digest", F.col("head").alias("neighbour"), F.lit(1.0).alias("similarity"))
    )
    top = Window.partitionBy("tab", "digest").orderBy(F.desc("similarity"), "neighbour")
    seen = seen.withColumn("r", F.row_number().over(top)).filter(F.col("r") <= p.k + 1).drop("r")
    both = both.unionByName(behind.join(seen, ["tab", "digest"]).filter("id <> neighbour").select("tab", "id", "neighbour", "similarity"))
    best = Window.partitionBy("tab", "id").orderBy(F.desc("similarity"), "neighbour")
    return both.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= p.k)


def _verified(tables, candidates: DataFrame, p: Search) -> DataFrame:
    """(tab, a, b, similarity) of the candidates, without those under the least similarity, from the vectors as stored."""
    vectors = None
    for tab, df, id_col, vector_col in tables:
        one = df.select(F.lit(tab).alias("tab"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v"))
        vectors = one if vectors is None else vectors.unionByName(one)
    wanted = Scratch(candidates.sparkSession, "p3").save(candidates.select("tab", F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")
    some = vectors.join(broadcast_if_small(wanted), ["tab", "id"], "left_semi")
    j = candidates.join(some.select("tab", F.col("id").alias("a"), F.col("v").alias("va")), ["tab", "a"]).join(some.select("tab", F.col("id").alias("b"), F.col("v").alias("vb")), ["tab", "b"])

    def run(batches):
        for t in batches:
            x, y = (_unit(np.asarray(pc.list_flatten(t.column(c)).to_numpy(zero_copy_only=False), np.float64).reshape(-1, p.dims)) for c in ("va", "vb"))
            sim = np.round(np.einsum("ij,ij->i", x, y), 6)
            out = pa.RecordBatch.from_arrays([t.column("tab"), t.column("a"), t.column("b"), pa.array(sim)], names=["tab", "a", "b", "similarity"])
            yield out if p.least is None else out.filter(pa.array(sim >= p.least))

    return j.select("tab", "a", "b", "va", "vb").mapInArrow(run, "tab string, a long, b long, similarity double")
