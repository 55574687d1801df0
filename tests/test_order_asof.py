"""Ranks, quantiles, as-of joins, columns for very many stores, and bucketed tables."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from daygrid.operators import asof, baselines, boosting, encoding, models, order, ridge
from daygrid.plans import demand
from daygrid.sources import panel

from helpers import DATA

DAY = dt.date(2015, 1, 1)


def values(spark, n=4000, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(None if rng.random() < 0.05 else float(v), "ab"[int(k)]) for v, k in zip(np.floor(np.exp(rng.normal(2, 2, n))), rng.random(n) < 0.9)]
    return spark.createDataFrame([*rows, (-5.5, None), (7.0, None)], "v double, g string").repartition(5), pd.DataFrame(rows + [(-5.5, None), (7.0, None)], columns=["v", "g"])


def test_average_ranks_equal_pandas_on_ties(spark):
    df, pdf = values(spark)
    got = {r["value"]: (r["ties"], r["rank"]) for r in order.average_ranks(df, "v", "rank").collect()}
    known = pdf["v"].dropna()
    want = dict(zip(known, known.rank(method="average")))
    assert {v: r for v, (_, r) in got.items()} == want and sum(t for t, _ in got.values()) == len(known)
    plan = order.average_ranks(df, "v", "rank")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert order.average_ranks(df.limit(0), "v", "rank").collect() == []


@pytest.mark.parametrize("keys", [(), ("g",)])
def test_quantiles_equal_percentile(spark, keys):
    df, _ = values(spark)
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.975, "e": 1.0}
    want = df.groupBy(*keys).agg(*[F.percentile("v", F.lit(p)).alias(n) for n, p in probs.items()]).collect()
    got = order.quantiles(df, "v", probs, keys).collect()
    by = lambda rows: {tuple(r[k] for k in keys): [r[n] for n in probs] for r in rows}
    assert by(got).keys() == by(want).keys()
    for k, v in by(want).items():
        assert by(got)[k] == pytest.approx(v)
    empty = order.quantiles(df.limit(0), "v", probs, keys).collect()
    assert empty == [] if keys else [tuple(r) for r in empty] == [(None,) * 5]


def test_quantiles_of_too_many_groups_are_refused(spark, monkeypatch):
    monkeypatch.setattr(order, "MAX_TOTALS", 10)
    with pytest.raises(ValueError, match="ranges and groups"):
        order.quantiles(spark.range(50), "id", {"m": 0.5}, ("id",))


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("same_day", [False, True])
@pytest.mark.parametrize("tolerance", [None, 0, 1, 9])
def test_asof_by_brute_force(spark, forward, same_day, tolerance):
    """Ties, nulls in keys and days, keys without events, repeated rows, clashing names."""
    rng = np.random.default_rng(7)
    day = lambda: None if rng.random() < 0.05 else DAY + dt.timedelta(int(rng.integers(0, 60)))
    key = lambda n: None if rng.random() < 0.05 else int(rng.integers(0, n))
    left = [(key(6), day(), int(i)) for i in range(150)]
    right = [(key(4), day(), int(rng.integers(0, 5)), None if rng.random() < 0.2 else "x") for _ in range(60)]
    a = spark.createDataFrame([*left, left[0]], "k int, Date date, r int")
    b = spark.createDataFrame([*right, right[0]], "k int, Date date, v int, t string")
    got = asof.asof(a, b, ("k",), "Date", ("v", "t"), "n_", forward, tolerance, same_day).collect()
    sign, rank = (-1 if forward else 1), lambda r: (r[2], r[3] is not None, r[3] or "")

    def want(k, d):
        if k is None or d is None:
            return (None, None, None)
        near = [r for r in right if r[0] == k and r[1] is not None and (gap := sign * (d - r[1]).days) >= (0 if same_day else 1) and (tolerance is None or gap <= tolerance)]
        return max(near, key=lambda r: (sign * r[1].toordinal(), rank(r)))[1:] if near else (None, None, None)

    assert sorted(map(tuple, got), key=str) == sorted([(k, d, i, *want(k, d)) for k, d, i in [*left, left[0]]], key=str)


def test_asof_is_one_exchange(spark):
    a = spark.range(10).select(F.col("id").alias("k"), F.lit(DAY).alias("Date"))
    plan = asof.asof(a, a.withColumn("v", F.lit(1)), ("k",), "Date", ("v",), tolerance=5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def stores_of(spark, n, days=30):
    return spark.range(n * days).select((F.col("id") % n).cast("string").alias("store_id"), F.date_add(F.lit(DAY), F.floor(F.col("id") / n).cast("int")).alias("Date"), (F.pmod(F.hash("id"), F.lit(100)) / 100 + F.col("id") % n % 7).alias("target"))


def test_no_later_day_changes_a_mean(spark):
    rows = stores_of(spark, 5)
    late = F.col("Date") > F.lit(DAY + dt.timedelta(19))
    a = encoding.ordered_means(rows, "store_id").select("store_id", "Date", "key_mean")
    b = encoding.ordered_means(rows.withColumn("target", F.when(late, 1000.0).otherwise(F.col("target"))), "store_id").select("store_id", "Date", F.col("key_mean").alias("other"))
    both = a.join(b, ["store_id", "Date"]).toPandas()
    seen = pd.to_datetime(both["Date"]) <= pd.Timestamp(DAY + dt.timedelta(26))  # day 20 is known from day 27 on
    assert len(both) == 150 and np.allclose(both.loc[seen, "key_mean"].fillna(-1), both.loc[seen, "other"].fillna(-1))
    assert (both.loc[~seen, "other"] > 10).all()
    first = a.filter(F.col("Date") <= F.lit(DAY + dt.timedelta(6))).agg(F.count("key_mean")).first()[0]
    assert first == 0


def test_ridge_and_trees_with_20000_stores(spark):
    """A column a store would be 20,000; one mean and 16 hashed columns are 17, and the fits take them."""
    rows = encoding.hashed_columns(encoding.ordered_means(stores_of(spark, 20_000, 10), "store_id", alias="store_mean"), "store_id", 16, "h").persist()
    numeric = ["store_mean", *(f"h{i}" for i in range(16))]
    assert rows.filter("+".join(f"abs(h{i})" for i in range(16)) + " <> 1").isEmpty()
    train = rows.filter("store_mean is not null")
    fitted = models.make_ridge({}, numeric, [], alpha=1.0)(train)
    assert fitted.transform(train).agg(F.corr("__pred", "target")).first()[0] > 0.5
    trees = boosting.make_best_first({}, numeric, [], trees=3, leaves=8, rate=0.5)(train)
    assert trees.transform(train).agg(F.corr("__pred", "target")).first()[0] > 0.5
    with pytest.raises(ValueError, match="too many levels"):
        ridge.fit_family(rows, {"store_id": [str(i) for i in range(20_000)]}, [], ["store_id"])


def test_bucketed_panel_is_read_without_an_exchange_by_store(spark, tmp_path):
    p = demand.Panel(spark, str(DATA))
    table = panel.save_bucketed(p.calendar, "calendar_by_store", 4, str(tmp_path / "t"))
    try:
        scored = baselines.with_baselines(table)
        plan = scored._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Bucketed: true" in plan
        assert sorted(map(tuple, scored.select("Store", "Date", "lag_7", "median_7_28").collect())) == sorted(map(tuple, baselines.with_baselines(p.calendar).select("Store", "Date", "lag_7", "median_7_28").collect()))
    finally:
        spark.sql("drop table calendar_by_store")
