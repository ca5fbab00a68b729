"""Per-key results with heavy keys, with the awkward cases."""

import math
from collections import defaultdict

import pytest

from tokenloom.operators import skew
from tokenloom.operators.skew import heavy_key_report, heavy_keys, salted, salted_summary

NAN = float("nan")


def _data():
    data = [("hot", float(i % 7), i) for i in range(600)] + [(f"k{i % 90}", float(i), 1000 + i) for i in range(300)]
    data += [(None, 1.0, 5000 + i) for i in range(100)] + [("n", None, 6000), ("n", NAN, 6001), ("v", NAN, 6002), ("v", 2.0, 6003), ("", -1.0, 6004)]
    return data + data[:40]


def _frame(spark, data):
    return spark.createDataFrame([(*r, "clash", 7) for r in data], "k string, v double, i long, key string, _salt int")


@pytest.mark.parametrize("salts", [1, 8])
def test_summary(spark, salts):
    data = _data()
    by = defaultdict(list)
    for k, v, _ in data:
        if k is not None:
            by[k].append(v)
    got = {r.key: r for r in salted_summary(_frame(spark, data), "k", "v", ["i"], 0.02, salts).collect()}
    assert set(got) == set(by)
    for k, vs in by.items():
        real = [v for v in vs if v is not None and not math.isnan(v)]
        r = got[k]
        assert (r.n_rows, r.n_values, r.is_heavy) == (len(vs), len(real), 50 * len(vs) >= len(data))
        assert (r.min_value, r.max_value) == ((min(real), max(real)) if real else (None, None))
        assert r.mean_value == (pytest.approx(sum(real) / len(real)) if real else None)


def test_empty(spark):
    df = _frame(spark, _data()).limit(0)
    assert salted_summary(df, "k", "v", ["i"]).count() == 0
    assert heavy_keys(df, "k").count() == 0


def test_heavy_rows_are_spread_and_stay_put(spark):
    df = _frame(spark, _data()).drop("_salt")
    cut = salted(df, "k", heavy_keys(df, "k", 0.1), 8, ["i"])
    assert cut.where("k = 'hot'").select("_salt").distinct().count() == 8
    assert cut.where("k <> 'hot'").select("_salt").distinct().count() == 1
    assert cut.count() == df.count()


def test_report(spark, rows):
    df = spark.createDataFrame([("a", 1, i) for i in range(98)] + [(None, None, 98), ("b", 2, 99)], "s string, n long, i long")
    assert rows(heavy_key_report(df, ["s", "n"], 0.02, ["i"])) == [("n", "1"), ("s", "a")]
    assert rows(heavy_key_report(df, ["n"], 0.01, ["i"])) == [("n", "1"), ("n", "2")]
    with pytest.raises(ValueError):
        heavy_keys(df, "s", 0.0)


@pytest.mark.parametrize("salted_keys", [[], ["a", "b"]])
def test_report_is_decided_on_the_merged_counts(spark, rows, monkeypatch, salted_keys):
    monkeypatch.setattr(skew, "heavy_keys", lambda *_: spark.createDataFrame([(k, 0) for k in salted_keys], "key string, n_rows long"))
    df = spark.createDataFrame([("a", i) for i in range(98)] + [(None, 98), ("b", 99)], "s string, i long")
    assert rows(heavy_key_report(df, ["s"], 0.02, ["i"])) == [("s", "a")]
