"""Percentiles, top items, pairs and similar sets against brute force, with the awkward cases of each."""

import itertools
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from tokenloom.llm import cooccur, quantiles, setjoin, topn

NAN = float("nan")


# --- percentiles -----------------------------------------------------------------------------------------------------


@given(st.lists(st.floats(allow_nan=False, width=64), min_size=2, max_size=50))
def test_universe_keeps_order(xs):
    xs = np.sort(np.array(xs))
    codes = quantiles.to_universe(xs)
    assert (np.diff(codes) >= 0).all()
    assert (codes >= 0).all() and (codes < 2**quantiles.UNIVERSE_BITS).all()


def test_integers_come_back():
    x = np.arange(0, 65_536, dtype=float)
    assert (quantiles.from_universe(quantiles.to_universe(x)) == x).all()


def test_value_error():
    x = np.abs(np.random.default_rng(1).standard_cauchy(10_000)) + 1e-3
    back = quantiles.from_universe(quantiles.to_universe(x))
    assert (back <= x).all() and (back >= x * (1 - quantiles.VALUE_ERROR)).all()


@settings(deadline=None, max_examples=20)
@given(st.integers(1, 4), st.integers(0, 2**31))
def test_merged_digests_keep_the_rank_error(parts, seed):
    rng = np.random.default_rng(seed)
    factor, data = 240, [np.floor(rng.pareto(1.0, rng.integers(1, 8000)) * 50) for _ in range(parts)]
    added = Counter()
    for d in data:
        codes, n = np.unique(quantiles.to_universe(d), return_counts=True)
        level, prefix, count = quantiles.compress(np.zeros(len(codes), np.int64), codes, n, factor)
        assert count.sum() == len(d) and len(level) <= 3 * factor + quantiles.UNIVERSE_BITS
        for node in zip(level, prefix, count):
            added[node[:2]] += node[2]
    level, prefix = (np.array([k[i] for k in added]) for i in range(2))
    count = np.array(list(added.values()))
    high = ((prefix + 1) << level) - 1
    order = np.lexsort((level, high))
    every = np.sort(quantiles.to_universe(np.concatenate(data)))
    n = len(every)
    for share in (0.01, 0.5, 0.9, 1.0):
        code = high[order][min(np.searchsorted(np.cumsum(count[order]), max(1, math.ceil(share * n))), len(order) - 1)]
        low, up = np.searchsorted(every, code, "left"), np.searchsorted(every, code, "right")
        allowed = quantiles.UNIVERSE_BITS / factor * n + 1
        assert low - allowed <= share * n <= up + allowed


def test_percentiles_of_groups(spark):
    data = [("a", float(i)) for i in range(1, 101)] + [("b", 5.0)] * 3 + [(None, 7.0), ("a", None), ("a", NAN), ("c", None)]
    df = spark.createDataFrame(data, "g string, v double")
    nodes = quantiles.digest(df, ["g"], ["v"])
    got = {(r.g, r.percentile): (r.n, r.value) for r in quantiles.read_percentiles(nodes, ["g"], [0.5, 1.0]).collect()}
    assert got == {("a", 0.5): (100, 50.0), ("a", 1.0): (100, 100.0), ("b", 0.5): (3, 5.0), ("b", 1.0): (3, 5.0), (None, 0.5): (1, 7.0), (None, 1.0): (1, 7.0)}
    twice = quantiles.merge(nodes.unionByName(nodes), ["g"])
    assert {r.n for r in quantiles.read_percentiles(twice, ["g"], [0.5]).collect()} == {200, 6, 2}
    assert quantiles.read_percentiles(quantiles.digest(df.limit(0), ["g"], ["v"]), ["g"], [0.5]).count() == 0


@pytest.mark.parametrize("held", [quantiles.HELD_VALUES, 500])
def test_merged_trees_stay_small_and_within_the_bound(spark, monkeypatch, held):
    monkeypatch.setattr(quantiles, "HELD_VALUES", held)
    rng = np.random.default_rng(7)
    data = [("a" if i % 3 else None, float(x), float(np.floor(x))) for i, x in enumerate(rng.pareto(1.0, 40_000) * 100)]
    df = spark.createDataFrame(data, "g string, v double, w double").repartition(8)
    nodes = quantiles.digest(df, ["g"], ["v", "w"])
    again = quantiles.merge(nodes.unionByName(nodes), ["g"])
    assert again.count() <= nodes.count() and nodes.count() <= 4 * 3 * quantiles.FACTOR
    shares = [0.001, 0.1, 0.5, 0.9, 0.999]
    checked = quantiles.rank_check(df, ["g"], ["v", "w"], quantiles.read_percentiles(nodes, ["g"], shares)).collect()
    assert len(checked) == 20 and all(r.within for r in checked)
    twice = quantiles.rank_check(df.union(df), ["g"], ["v", "w"], quantiles.read_percentiles(again, ["g"], shares)).collect()
    assert len(twice) == 20 and all(r.within for r in twice)
    off = quantiles.read_percentiles(nodes, ["g"], shares).withColumn("value", F.col("value") * 1.1)
    assert not all(r.within for r in quantiles.rank_check(df, ["g"], ["v", "w"], off).collect())


# --- top items -------------------------------------------------------------------------------------------------------

_ITEM = "g long, s double, t string, i string, p long, s_bound double"


def _brute_top(data, n):
    by = defaultdict(set)
    for g, s, t, i, p, _ in data:
        if g is not None and s is not None and not math.isnan(s):
            by[g].add((-s, t is None, t or "", i, p))
    return sorted((g, k + 1, i, p) for g, items in by.items() for k, (_, _, _, i, p) in enumerate(sorted(items)[:n]))


@pytest.mark.parametrize("partitions", [1, 7])
def test_top_n(spark, rows, partitions):
    rng = np.random.default_rng(3)
    data = [
        (int(rng.integers(0, 5)) if rng.random() > 0.05 else None, [NAN, None, 0.0, -0.0, 1.5, 2.5, -3.0][rng.integers(0, 7)], ["é", "z", "𝄞", "", None][rng.integers(0, 5)], f"i{k % 400}", k % 400, 0.0)
        for k in range(2000)
    ]
    data = [(g, s, t, i, p, x) for (g, s, t, _, _, x), (i, p) in zip(data, ((f"i{k}", k) for k in range(2000)))]
    data += data[:300]  # delivered twice
    df = spark.createDataFrame(data, _ITEM).repartition(partitions)
    got = topn.top_n_per_group(df, "g", "s", ["t", "i", "p"], ["i", "p"], 3).select("g", "rank_no", "i", "p")
    assert rows(got) == sorted(_brute_top(data, 3), key=repr)
    assert topn.top_n_per_group(df.limit(0), "g", "s", ["t", "i", "p"], ["i", "p"], 3).count() == 0


@pytest.mark.parametrize(("kept", "sent"), [(topn.KEPT_ROWS, 0), (50, topn.SENT_BOUNDS), (50, 0)])
def test_top_n_of_many_groups(spark, rows, monkeypatch, kept, sent):
    monkeypatch.setattr(topn, "KEPT_ROWS", kept)
    monkeypatch.setattr(topn, "BUFFER_ROWS", 20)
    monkeypatch.setattr(topn, "SENT_BOUNDS", sent)
    rng = np.random.default_rng(8)
    data = [(0 if rng.random() < 0.4 else int(rng.integers(1, 400)), float(rng.integers(0, 9)), "t", f"i{k}", k, 0.0) for k in range(3000)]
    df = spark.createDataFrame(data, _ITEM).repartition(5)
    got = topn.top_n_per_group(df, "g", "s", ["t", "i", "p"], ["i", "p"], 3).select("g", "rank_no", "i", "p")
    assert rows(got) == sorted(_brute_top(data, 3), key=repr)


# --- pairs -----------------------------------------------------------------------------------------------------------


def _brute_pairs(data):
    records = {k: sorted({x for x in ids if x is not None}) for k, ids in data if ids}
    records = {k: v for k, v in records.items() if v}
    single, pair = Counter(), Counter()
    for ids in records.values():
        single.update(ids)
        pair.update(itertools.combinations(ids, 2))
    return sorted((a, b, n, single[a], single[b], len(records)) for (a, b), n in pair.items())


@pytest.mark.parametrize("large", [4, 256])
def test_pairs(spark, rows, large, monkeypatch):
    rng = np.random.default_rng(5)
    data = [(k, rng.integers(0, 30, rng.integers(0, 25)).tolist()) for k in range(200)]
    data += [(1000, None), (1001, []), (1002, [None, 3]), (1003, [None]), (1004, [2**40, 7, 7, None, -5]), (1005, list(range(60)))]
    data += data[:50]
    df = spark.createDataFrame(data, "k long, ids array<long>")
    each = cooccur.baskets(df, "ids", ["k"]).select("items", F.col("k").alias("record"))
    assert rows(cooccur.pair_counts(each, large)) == sorted(((a, b, n) for a, b, n, *_ in _brute_pairs(data)), key=repr)
    got = cooccur.associations(df, "ids", ["k"], 2, 1.5).select("feature_a", "feature_b", "n_ab", "n_a", "n_b", "n")
    assert rows(got) == sorted((r for r in _brute_pairs(data) if r[2] >= 2 and 2 * r[2] * r[5] >= 3 * r[3] * r[4]), key=repr)
    assert cooccur.associations(df.limit(0), "ids", ["k"]).count() == 0


def test_copies_of_a_large_basket_are_spread(spark):
    """Their chunks go to many tasks, though all have the same items."""
    df = spark.createDataFrame([(k, list(range(200))) for k in range(30)], "k long, ids array<long>").repartition(4)
    each = cooccur.baskets(df, "ids", ["k"]).select("items", F.col("k").alias("record"))
    seen = cooccur.chunk_rows(each, 20).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(seen) == 4 and max(r["count"] for r in seen) < 2 * 30 * 20 / 4
    assert {r.n_ab for r in cooccur.pair_counts(each, 20).collect()} == {30}


def test_counts_are_handed_on_in_parts(spark, rows, monkeypatch):
    df = spark.createDataFrame([(k, list(range(40))) for k in range(300)], "k long, ids array<long>").coalesce(1)
    monkeypatch.setattr(cooccur, "HELD_PAIRS", 1000)
    each = cooccur.baskets(df, "ids", ["k"]).select("items", F.col("k").alias("record"))
    assert {r.n_ab for r in cooccur.pair_counts(each).collect()} == {300}


# --- similar sets ----------------------------------------------------------------------------------------------------


def test_calibration():
    bits, segments, radius = setjoin.calibrate(100_000, 0.8)
    assert bits == 14 and (1 - 0.9**bits) ** segments <= setjoin.MISS
    assert 6 < radius < setjoin.CHECK_BITS // 2
    assert setjoin.calibrate(2**33, 0.8)[0] == 30


def _near_sets(seed, n):
    rng = np.random.default_rng(seed)
    data = []
    while len(data) < n:
        base = rng.choice(5000, rng.integers(3, 60), replace=False).tolist()
        data.append(base)
        for _ in range(rng.integers(0, 4)):
            other = list(base)
            for _ in range(rng.integers(0, 1 + len(base) // 8)):
                other[rng.integers(0, len(other))] = int(rng.integers(0, 5000))
            data.append(other[::-1] + [None, other[0]])
    return data


@pytest.mark.parametrize("seed", [1, 2])
def test_similar_sets(spark, rows, seed):
    data = _near_sets(seed, 400)
    data += [None, [], [None], [1, 2, 3, 4], [1, 2, 3, 4], [1, 2, 3, 4, 5]] + [[1, 2, 3, 4, 5]] * 3 + [[5, 4, 3, 2, 1, 1]]
    df = spark.createDataFrame([(i, ids, i) for i, ids in enumerate(data)], "id long, ids array<long>, class_id long")
    sets = {i: {x for x in s if x is not None} for i, s in enumerate(data) if s}
    sets = {i: s for i, s in sets.items() if len(s) >= 5}
    want = sorted(((i, j) for i, j in itertools.combinations(sets, 2) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])), key=repr)
    assert rows(setjoin.similar_pairs(df, "id", "ids", 5, 4, 5, len(data))) == want
    links = {r.id: (r.n_copies, r.n_links) for r in setjoin.record_links(df, "id", "ids", 5, 4, 5, len(data)).collect()}
    assert set(links) == set(sets)
    assert sum(c - 1 + k for c, k in links.values()) == 2 * len(want)
    assert setjoin.similar_pairs(df.limit(0), "id", "ids", 5, 4, 5, 0).count() == 0


@pytest.mark.parametrize("together", [1, 16])
def test_hot_segments_and_classes_are_cut(spark, rows, monkeypatch, together):
    rng = np.random.default_rng(4)
    data = [list(range(30)) for _ in range(40)]  # one set in 40 records
    for k in range(60):  # sets near to it and to each other, that share many segments
        data.append([*range(k % 3, 29), 1000 + k])
    data += _near_sets(9, 100)
    order = rng.permutation(len(data)).tolist()
    df = spark.createDataFrame([(i, data[i]) for i in order], "id long, ids array<long>")
    sets = {i: set(s) - {None} for i, s in enumerate(data)}
    sets = {i: s for i, s in sets.items() if len(s) >= 5}
    want = sorted(((i, j) for i, j in itertools.combinations(sets, 2) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])), key=repr)
    monkeypatch.setattr(setjoin, "SEEN_TOGETHER", together)
    assert rows(setjoin.similar_pairs(df, "id", "ids", 5, 4, 5, len(data), block=8)) == want
    links = {r.id: r.n_copies - 1 + r.n_links for r in setjoin.record_links(df, "id", "ids", 5, 4, 5, len(data), block=8).collect()}
    degree = Counter(x for pair in want for x in pair)
    assert links == {i: degree[i] for i in sets}


def test_similar_sets_of_two_tables(spark, rows):
    data = _near_sets(6, 300) + [[1, 2, 3, 4, 5]] * 6 + [None, [], [7, None]]
    left, right = ([(i, ids) for i, ids in enumerate(data) if i % 2 == k] for k in (0, 1))
    right.append((0, data[0]))  # keys may stand in both tables
    make = lambda part: spark.createDataFrame(part, "id long, ids array<long>")
    sets = lambda part: {i: set(s) - {None} for i, s in part if s}
    a, b = ({i: s for i, s in sets(p).items() if len(s) >= 5} for p in (left, right))
    want = sorted(((i, j) for i in a for j in b if 5 * len(a[i] & b[j]) >= 4 * len(a[i] | b[j])), key=repr)
    assert want and rows(setjoin.similar_between(make(left), make(right), "id", "ids", 5, 4, 5, len(data))) == want
    assert setjoin.similar_between(make(left), make(right).limit(0), "id", "ids", 5, 4, 5, len(data)).count() == 0


def test_similar_sets_send_nothing_that_grows(spark):
    """With Spark's own choice of joins left on, only tables of bounded size are broadcast."""
    df = spark.createDataFrame([(i, s) for i, s in enumerate(_near_sets(3, 50))], "id long, ids array<long>")
    plan = setjoin.similar_pairs(df, "id", "ids", 5, 4, 5, 50)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 6 and plan.count("BroadcastNestedLoopJoin") == 0
    assert plan.count("BroadcastHashJoin") == 2  # the hot segments, known to be few
