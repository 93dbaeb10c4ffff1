"""Vectors, packing and mixing."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import mixing as mx
from lodestone.llm import packing as pk
from lodestone.llm import vectors as ve
from lodestone.llm.tokens import token_counts


def brute(ids, x, k, least):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 6)
    np.fill_diagonal(s, -2)
    out = set()
    for i in range(len(ids)):
        js = [j for j in range(len(ids)) if s[i, j] >= least]
        for j in sorted(js, key=lambda j: (-s[i, j], ids[j]))[:k]:
            out.add((ids[i], ids[j]))
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(120, 64))
    x = np.concatenate([base, base[:60] + rng.normal(size=(60, 64)) * 0.2, base[:40] * 3.5, np.repeat(base[:1], 12, 0)]).astype(np.float32)
    ids = rng.permutation(len(x)).tolist()
    rows = [(int(i), [float(v) for v in r], "a") for i, r in zip(ids, x)]
    bad = [(1000, None, "a"), (1001, [0.0] * 64, "a"), (1002, [1.0] * 63, "a"), (1003, [float("nan")] * 64, "a"), (1004, [], "a"), (1005, [None] + [1.0] * 63, "a")]
    df = spark.createDataFrame(rows + bad, "row_id long, vector array<float>, code string")
    got = {(r.id, r.neighbour) for r in ve.neighbours([("t", df, "row_id", "vector")], ve.Search(cell=60)).collect()}
    want = brute(ids, x.astype(np.float64), 5, 0.9)
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)
    assert ve.neighbours([("t", df.limit(0), "row_id", "vector")]).count() == 0


def test_nearest_pivots_by_groups():
    rng = np.random.default_rng(7)
    unit = lambda n: (lambda z: z / np.linalg.norm(z, axis=1, keepdims=True))(rng.normal(size=(n, 16)).astype(np.float32))
    for n, visit in ((1, 1), (5, 5), (300, 8), (5000, 12)):
        groups, x = ve.PivotGroups(unit(n)), unit(400)
        got = groups.nearest(x, visit)
        want = np.argsort(-(x @ groups.pivots.T), axis=1)[:, :visit]
        assert all(len(set(r)) == visit for r in got) and (got[:, 0] == want[:, 0]).mean() > (0.9 if n > 1000 else 0.99)
        assert np.mean([len(set(a) & set(b)) / visit for a, b in zip(got, want)]) > (0.85 if n > 1000 else 0.99)
    same = ve.PivotGroups(np.repeat(unit(1), 40, 0))  # all in one group
    assert sorted(same.nearest(unit(3), 40)[0]) == list(range(40))


def test_split_cells(spark):
    rng = np.random.default_rng(5)
    x = (rng.normal(size=64) + rng.normal(size=(400, 64)) * 0.15).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "row_id long, vector array<float>")
    got = {(r.id, r.neighbour) for r in ve.neighbours([("t", df, "row_id", "vector")], ve.Search(cell=10, pivots=2)).collect()}
    want = brute(list(range(400)), x.astype(np.float64), 5, 0.9)
    assert len(got & want) >= 0.97 * len(want)


@pytest.mark.parametrize("p", [ve.ANY, ve.Search(least=None, cell=60, own=3), ve.Search(least=None, cell=10, own=3, pivots=4)])
def test_five_neighbours_for_every_row(spark, p):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(700, 64))
    x = np.concatenate([base, base[:50] + rng.normal(size=(50, 64)) * 0.2, np.repeat(base[:1], 12, 0)]).astype(np.float32)
    ids = rng.permutation(len(x)).tolist()
    df = spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x)] + [(1000, None), (1001, [0.0] * 64)], "row_id long, vector array<float>")
    got = [(r.id, r.neighbour) for r in ve.neighbours([("t", df, "row_id", "vector")], p).collect()]
    want = brute(ids, x.astype(np.float64), 5, -1)
    assert len(got) == len(set(got)) == len(want) == 5 * len(x)
    assert len(set(got) & want) >= 0.97 * len(want)


@pytest.mark.parametrize("seed", range(6))
def test_pack(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([rng.randint(1, 2047), rng.randint(1, 300)]) for _ in range(rng.choice([0, 1, 7, 300]))]
    bins = pk.pack(sizes)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and all(0 < sum(sizes[i] for i in b) <= 2048 for b in bins)
    assert len(bins) <= len(pk.best_fit(sizes, 2048))


def fewest_bins(sizes, capacity):
    """By dynamic programming over subsets: (bins, load of the last) is least."""
    best = {0: (0, capacity)}
    for mask in range(1, 1 << len(sizes)):
        best[mask] = min((n, load + s) if load + s <= capacity else (n + 1, s) for i, s in enumerate(sizes) if mask >> i & 1 for n, load in [best[mask ^ 1 << i]])
    return best[(1 << len(sizes)) - 1][0]


def test_bin_completion_beats_best_fit():
    rng = random.Random(0)
    fit = pack = want = 0
    for _ in range(150):
        sizes = [rng.randint(15, 70) for _ in range(rng.randint(5, 10))]
        p = pk.Fill(capacity=100)
        fit, pack, want = fit + len(pk.best_fit(sizes, 100)), pack + len(pk.pack(sizes, p)), want + fewest_bins(sizes, 100)
    assert want <= pack <= want + 1 and pack < fit


def test_completions_are_the_undominated_sets():
    rng = random.Random(3)
    for _ in range(300):
        items = [rng.randint(2, 14) for _ in range(rng.randint(0, 8))]
        space = rng.randint(1, 30)
        left = {k: items.count(k) for k in set(items)}
        got = list(pk.completions(sorted(left), left, space))
        sets = {tuple(sorted(c, reverse=True)) for n in range(len(items) + 1) for c in itertools.combinations(items, n) if sum(c) <= space}

        def worse(c):  # some of its items give way to one that is left out
            free = list(items)
            for x in c:
                free.remove(x)
            parts = [p for n in range(1, len(c) + 1) for p in itertools.combinations(c, n)]
            return any(sum(p) < x <= sum(p) + space - sum(c) or (sum(p) == x and len(p) > 1) for p in parts for x in free) or any(x <= space - sum(c) for x in free)

        want = {c for c in sets if not worse(c)}
        assert {tuple(c) for _, c in got} == want and len(got) == len(want)
        assert [w for w, _ in got] == sorted(w for w, _ in got) and all(w == space - sum(c) for w, c in got)


def test_fewest_containers_without_a_bound():
    rng = random.Random(1)
    for _ in range(100):
        sizes = [rng.randint(10, 70) for _ in range(rng.randint(3, 10))]
        assert len(pk.pack(sizes, pk.Fill(capacity=100, nodes=None))) == fewest_bins(sizes, 100)


def test_containers(spark):
    rows = [(1, "word " * 5000), (2, None), (3, ""), *((i, "a b c " * (i % 40 + 1)) for i in range(4, 200)), (4, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tokens", F.lit(-1))
    got = pk.containers(df, p=pk.Fill(capacity=128, group=50))
    sums = got.groupBy("container").agg(F.sum("tokens").alias("t")).collect()
    assert max(r.t for r in sums) <= 128
    total = token_counts(df, "doc_id", "text").agg(F.sum("tokens")).first()[0]
    report = pk.fill_report(got, 128).first()
    assert report.tokens == total == sum(r.t for r in sums) and report.used_share > 0.97
    one = got.filter("id = 1").orderBy("piece").collect()
    assert [r.piece for r in one] == list(range(len(one))) and all(r.tokens == 128 for r in one[:-1])
    assert got.filter("id <> 1").groupBy("id").count().filter("count > 2 or (id <> 4 and count > 1)").count() == 0
    assert pk.fill_report(pk.containers(df.limit(0))).first().containers == 0


def mixture(spark, total="available"):
    docs = [(i, "one two three four " * (i % 5 + 1), ["Big", " big", "small", "tiny", "other", None, ""][i % 7]) for i in range(7000)]
    docs = [d for d in docs if d[2] != "tiny" or d[0] < 200] + [(9001, None, "big"), (9002, "", "big")]
    t = [("big", 0.5, 1), ("SMALL ", 0.3, 4), ("tiny", 0.1, 3), ("none", 0.1, 2), (None, 0.0, 1)]
    d, m = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("tokens", F.lit(1)), spark.createDataFrame(t, "source string, target_share double, max_repeats int")
    return mx.mix(d, m, total_tokens=total)


def test_mix_reaches_its_shares(spark):
    drawn, report = mixture(spark, "reached")
    r = {x.source: x for x in report.collect()}
    assert set(r) == {"big", "small", "tiny", "none"} and r["none"].tokens == 0 and r["none"].short
    for s in ("big", "small", "tiny"):
        assert abs(r[s].actual_share - r[s].target_share / 0.9) < 0.12 and r[s].rate <= r[s].max_repeats
    assert drawn.groupBy("id").agg(F.max("copy").alias("c"), F.count("*").alias("n")).filter("c <> n").count() == 0
    assert {tuple(x) for x in drawn.collect()} == {tuple(x) for x in mixture(spark, "reached")[0].collect()}  # the seed decides


def test_mix_of_what_is_there(spark):
    drawn, report = mixture(spark)
    r = {x.source: x for x in report.collect()}
    stock = sum(x.available for x in r.values())
    assert r["tiny"].short and r["tiny"].copies == 3 * r["tiny"].docs and not r["small"].short
    for s in ("big", "small"):  # a scarce source doesn't make the others smaller
        assert abs(r[s].wanted - r[s].target_share / 0.9 * stock) < 1
        assert abs(r[s].tokens - min(r[s].wanted, r[s].available * r[s].max_repeats)) <= 5 * r[s].spread + 1
    assert drawn.groupBy("id", "source").count().join(report, "source").filter("count > max_repeats").count() == 0


def test_mix_keeps_the_repeats(spark):
    drawn, report = mixture(spark, total=1_000_000)
    r = {x.source: x for x in report.collect()}
    assert r["tiny"].short and r["tiny"].copies == 3 * r["tiny"].docs and r["big"].copies == r["big"].docs
    assert sum(x.tokens for x in r.values()) == drawn.agg(F.sum("tokens")).first()[0]


def test_mix_of_nothing(spark):
    d = spark.createDataFrame([], "doc_id long, text string, source string")
    t = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    drawn, report = mx.mix(d, t)
    assert drawn.count() == 0 and [tuple(x)[:2] for x in report.collect()] == [("a", 1.0)]
