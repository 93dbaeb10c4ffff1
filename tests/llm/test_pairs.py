"""Near-duplicates and the history index against brute force."""

import itertools
import os
import random
import re
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestone.llm import history as hi
from lodestone.llm import near_duplicates as nd
from lodestone.llm.shingles import tokens
from lodestone.session import Scratch, shared_dir

SCHEMA = "row_id long, text string, doc_id string, source string, likeness string"


def grams(text, width):
    t = tokens(text)
    return {tuple(t[i : i + width]) for i in range(len(t) - width + 1)}


def like(a, b, width):
    x, y = grams(a, width), grams(b, width)
    return len(x & y) / len(x | y) if x and y else 0.0


def corpus(seed=3, n=160):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + list("水文地质图层")
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.55:
            t = rng.choice(texts).split()
            for _ in range(rng.randrange(0, 4)):
                k = rng.randrange(len(t))
                t[k : k + 1] = rng.choice([[], [rng.choice(vocab)], [t[k], rng.choice(vocab)]])
            texts.append(" ".join(t) or "x")
        else:
            texts.append(" ".join(rng.choice(vocab) for _ in range(rng.choice([3, 8, 40, 90]))))
    return texts + [None, "", "  ", "one two", texts[0], texts[0].upper()]


@pytest.mark.parametrize("width,threshold,hot", [(4, 0.6, 12), (5, 0.8, 12), (4, 0.6, 2)])
def test_pairs_equal_brute_force(spark, width, threshold, hot):
    texts = corpus()
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    pairs, members = nd.similar_pairs(df, params=nd.Likeness(width=width, threshold=threshold, hot=hot))
    got = {tuple(r) for r in nd.all_pairs(pairs, members).collect()}
    want = {(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(texts), 2) if a and b and like(a, b, width) >= threshold}
    assert len(want) > 40
    if hot > 2:
        assert got == want
    else:  # every list is split: contexts may hide a few, nothing wrong is added
        assert got <= want and len(got) >= 0.95 * len(want)


def test_pairs_in_rounds_equal_brute_force(spark):
    texts = corpus(23)
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    pairs, members = nd.similar_pairs(df, params=nd.Likeness(width=4, threshold=0.6), at_once=10, texts_at_once=0.3, least_records=1)
    assert len({Path(f).parent for f in pairs.inputFiles()}) > 1
    got = [tuple(r) for r in nd.all_pairs(pairs, members).collect()]
    want = {(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(texts), 2) if a and b and like(a, b, 4) >= 0.6}
    assert len(want) > 40 and len(got) == len(want) and set(got) == want


def test_pairs_leave_nothing_but_results_on_disk(spark):
    """Of 1,500 records with 20 postings each, neither the shuffle files nor the tables of the steps stay."""
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(40)) for _ in range(1000)]
    texts += [" ".join(t.split()[1:]) for t in texts[:500]]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f: os.path.getsize(f) for f in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f and os.path.exists(f)}
    tables = lambda: {str(f.parent) for f in Path(shared_dir(spark).removeprefix("file://")).glob("lodestone-*/*/_SUCCESS")}
    before, had = shuffled(), tables()
    pairs, members = nd.similar_pairs(df, params=nd.Likeness(width=4, threshold=0.6))
    time.sleep(2)  # files are removed in the background
    assert sum(n for f, n in shuffled().items() if f not in before) < 200_000
    assert sorted(Path(t).name.split("-", 1)[1] for t in tables() - had) == ["members", "pairs"]
    assert pairs.count() == 500


def test_groups_are_connected_components(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.9), (5, 6, 0.9), (3, 9, 0.9)], "rep_a long, rep_b long, likeness double")
    members = spark.createDataFrame([(i, i) for i in range(1, 11)] + [(20, 6)], "id long, rep long")
    got = dict(nd.groups(pairs, members).collect())
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 4: 4, 5: 5, 6: 5, 20: 5, 7: 7, 8: 8, 10: 10}


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    pairs, members = nd.similar_pairs(df)
    assert pairs.count() == 0 and members.count() == 0 and nd.groups(pairs, members).count() == 0


def test_one_crowded_class(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(i, base if i % 2 else f"{base} tail{i} more{i}", None, None, None) for i in range(300)]
    pairs, members = nd.similar_pairs(spark.createDataFrame(rows, SCHEMA), params=nd.Likeness(width=4, threshold=0.6))
    ids = members.groupBy("rep").count().filter("count > 1").collect()
    assert [tuple(r) for r in ids] == [(1, 150)]
    reps = {0, *range(2, 300, 2), 1}
    assert pairs.count() == len(reps) * (len(reps) - 1) // 2


def screen_by_hand(store, rows, width, threshold):
    docs = {d.lower() for _, _, d in store if d and d.strip()}
    texts = [t for _, t, _ in store if t]
    out = set()
    for i, t, d in rows:
        key = d.lower() if d and d.strip() else None
        if (key and key in docs) or (t and any(like(t, x, width) >= threshold for x in texts)):
            out.add(i)
        else:
            texts += [t] if t else []
            docs |= {key} if key else set()
    return out


@pytest.mark.parametrize("one_by_one", [False, True])
def test_screen_equals_brute_force(spark, one_by_one):
    texts = corpus(11, 150)
    rng = random.Random(5)
    ids = [None, "", " ", *(f"Ab{i}" for i in range(90))]
    rows = [(i, t, rng.choice(ids).__str__().swapcase() if rng.random() < 0.5 else rng.choice(ids)) for i, t in enumerate(texts)]
    store, new = rows[:60], rows[60:]
    df = lambda x: spark.createDataFrame([(i, t, d, "s", "x", i) for i, t, d in x], SCHEMA + ", at long")
    index = hi.HistoryIndex(spark, Scratch(spark, "t").root, nd.Likeness(width=4, threshold=0.6), buckets=4)
    index.build(df(store))
    if one_by_one:
        got, kept = set(), list(store)
        for part in (new[:30], new[30:60], new[60:]):
            out = index.screen(df(part), ["at"]).filter("not accepted").collect()
            got |= {r.id for r in out}
            kept += [r for r in part if r[0] not in got]
        for t in index.TABLES:  # as another session finds it: all is known now, whatever buckets are asked for
            spark.sql(f"DROP TABLE {index._name(t)}")
        index = hi.HistoryIndex(spark, index.path, index.likeness, buckets=7)
        assert index.settings["buckets"] == 4
        index.compact()
        with pytest.raises(ValueError):
            hi.HistoryIndex(spark, index.path, nd.Likeness(width=5, threshold=0.6))
        again = index.screen(df(kept[60:]).withColumn("row_id", F.col("row_id") + 1000), ["at"])
        known = {i + 1000 for i, t, d in kept[60:] if grams(t or "", 4) or (d and d.strip())}
        assert {r.id for r in again.filter("not accepted").collect()} == known
    else:
        got = {r.id for r in index.screen(df(new), ["at"]).filter("not accepted").collect()}
    want = screen_by_hand(store, new, 4, 0.6)
    assert 20 < len(want) < len(new) and got == want


def test_screen_of_nothing(spark):
    df = spark.createDataFrame([], SCHEMA + ", at long")
    index = hi.HistoryIndex(spark, Scratch(spark, "t").root, buckets=2)
    index.build(df)
    assert index.screen(df, ["at"]).count() == 0


def test_a_small_delivery_reads_its_buckets_only(spark):
    """One row is screened although the files of all buckets but those of its keys are spoilt."""
    rows = [(i, " ".join(f"w{(i * 7919 + 31 * j) % 5003}" for j in range(30)), f"d{i}", "s", "x") for i in range(300)]
    index = hi.HistoryIndex(spark, Scratch(spark, "t").root, nd.Likeness(width=4, threshold=0.6), hi.Bands(bands=4), buckets=64)
    index.build(spark.createDataFrame(rows, SCHEMA))
    index.compact()
    one = spark.createDataFrame([(10**6, rows[5][1] + " more", None, "s", "x")], SCHEMA).withColumn("at", F.lit(1))
    keys = hi.signatures(one, "row_id", "text", 4, index.bands).select(F.explode("keys").alias("key"))
    own = {r[0] for r in keys.select(F.pmod(F.hash("key"), F.lit(64))).collect()}
    files = list(Path(index._at("keys").removeprefix("file://")).glob("*.parquet"))
    bucket = {f: int(re.search(r"_(\d{5})\.", f.name)[1]) for f in files}
    assert len(own) <= 4 and len(files) == len(set(bucket.values())) > 50
    for f in files:
        if bucket[f] not in own:
            f.with_name(f".{f.name}.crc").unlink(missing_ok=True)
            f.write_bytes(b"spoilt")
    assert not index.screen(one, ["at"]).first().accepted
    with pytest.raises(Exception, match="spoilt|Parquet|parquet"):
        spark.table(index._name("keys")).agg(F.max("n")).collect()


def test_instants(spark):
    given = ["2031-02-01T00:00:36Z", "2031-02-01T01:00:36+01:00", "2031-02-01 00:00:36", "1927670436", "2031-02-01T00:00:36.000Z", "", " ", None, "soon"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(given)], "i int, s string")
    got = [r.x for r in df.select("i", F.unix_micros(hi.instant(F.col("s"))).alias("x")).orderBy("i").collect()]
    assert got == [1927670436000000] * 5 + [None] * 4


@pytest.mark.parametrize("own", [400, 90, 40])
def test_boilerplate_is_no_likeness(spark, own):
    rng = random.Random(own)
    common = " ".join(f"b{i}" for i in range(60))
    texts = [f"{common} " + " ".join(f"u{i}x{j}" for j in range(own)) for i in range(200)]
    texts += [t.replace("x7 ", "y7 ") for t in texts[:30]] + [" ".join(f"u{i}x{j}" for j in range(own)) for i in range(5)]
    texts += [f"{common} " + " ".join(f"m{i}x{j}" for j in range(rng.randrange(4, 20))) for i in range(25)]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    pairs, members = nd.similar_pairs(df, params=nd.Likeness(width=4, threshold=0.6, hotter=64))
    got = {tuple(r) for r in nd.all_pairs(pairs, members).collect()}
    want = {(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(texts), 2) if like(a, b, 4) >= 0.6}
    assert len(want) > 60 and got == want


@pytest.mark.parametrize("period", [16, 18, 20])
def test_a_crowded_family(spark, period):
    """Filled-in forms: runs of words that all have, between slots that none has twice; the likeness comes from the form alone."""
    rng = random.Random(period)
    form = [f"f{i}" for i in range(160)]
    texts = []
    for i in range(400):
        t = list(form)
        for k in range(period // 2, len(t), period):
            t[k] = f"s{i}x{k}"
        texts.append(" ".join(t))
    texts += [" ".join(form[:40] + [f"o{i}x{j}" for j in range(120)]) for i in range(100)]  # the same words as a footer
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    pairs, members = nd.similar_pairs(df, params=nd.Likeness(width=4, threshold=0.6))
    got = {tuple(r) for r in nd.all_pairs(pairs, members).collect()}
    one = like(texts[0], texts[1], 4)
    assert (one >= 0.6) == (len(got) > 0) and len(got) in (0, 400 * 399 // 2)
    assert one >= 0.6 or period == 16


def test_union_estimate():
    import numpy as np

    rng = np.random.default_rng(2)
    none = np.iinfo(np.uint64).max
    for k in (4, 64):
        for _ in range(50):
            x, y = (np.sort(rng.choice(120, rng.integers(0, 100), replace=False)) for _ in "xy")
            row = lambda z: np.append(z[:k].astype(np.uint64), np.full(k - len(z[:k]), none))[None, :].astype(np.uint64)
            union = sorted(set(x) | set(y))[:k]
            want = sum(u in x and u in y for u in union) / max(1, len(union))
            assert abs(nd.union_estimate(row(x), row(y), k)[0] - want) < 1e-12
