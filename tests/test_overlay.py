"""Features of many requests from one table equal those built on each request's own calendar."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegerType, StructField, StructType

from daygrid.operators import forecast
from daygrid.sources import panel

START = dt.date(2014, 11, 20)
STORES = "Store int, StoreType string, Assortment string, CompetitionDistance double, CompetitionOpenSinceMonth double, CompetitionOpenSinceYear double, Promo2 int, Promo2SinceWeek double, Promo2SinceYear double, PromoInterval string"
REQUESTS = StructType([StructField("Store", IntegerType()), StructField("origin", DateType())])


def day(i):
    return START + dt.timedelta(int(i))


def strange_history(seed, n=150):
    """Per store: gaps, anomalies, holidays, short and long closures, one that goes on to the end; store 3 starts late."""
    rng, out = np.random.default_rng(seed), []
    for store in (1, 2, 3):
        closed = rng.random(n) < 0.1
        for _ in range(7):
            a = int(rng.integers(0, n - 3))
            closed[a : a + int(rng.integers(2, 9))] = True
        closed[n - 2 :] = store == 2
        lost, holiday = rng.random(n) < 0.06, rng.choice(list("0abc"), n, p=[0.9, 0.05, 0.03, 0.02])
        for i in range(50 if store == 3 else 0, n):
            if not lost[i]:
                people = 0 if closed[i] or rng.random() < 0.04 else int(rng.integers(200, 900))
                out.append({"Store": store, "DayOfWeek": day(i).isoweekday(), "Date": day(i), "Sales": 9 * people, "Customers": people, "Open": int(not closed[i]), "Promo": int(rng.random() < 0.4), "StateHoliday": str(holiday[i]), "SchoolHoliday": int(rng.random() < 0.2)})
    return out


def planned(seed, n=150):
    """Plans behind the history and also on days of it, which must not count where the history has a row or the day lies before the origin."""
    rng = np.random.default_rng(seed + 100)
    return [{"Store": s, "DayOfWeek": day(i).isoweekday(), "Date": day(i), "Open": int(rng.random() < 0.6), "Promo": int(rng.random() < 0.5), "StateHoliday": str(rng.choice(list("0ab"))), "SchoolHoliday": 0} for s in (1, 2, 3) for i in range(n - 40, n + 9) if rng.random() < 0.95]


def as_rows(df):
    return sorted((tuple(repr(v) for v in r) for r in df.select(*sorted(df.columns)).collect()))


def test_overlay_equals_the_exact_form(spark):
    stores = spark.createDataFrame([(s, "abdc"[s - 1], "abca"[s - 1], 100.0 * s, 3.0, 2014.0, 1, 14.0, 2014.0, "Jan,Apr,Jul,Oct") for s in (1, 2, 3, 4)], STORES)
    for seed in (1, 2):
        history = spark.createDataFrame([tuple(r[c] for c in panel.HISTORY.names) for r in strange_history(seed)], panel.HISTORY)
        plan = spark.createDataFrame([tuple(r[c] for c in panel.PLAN.names) for r in planned(seed)], panel.PLAN)
        # Every third day; before the history, behind it, and a store without any.
        asked = spark.createDataFrame([(s, day(i)) for s in (1, 2, 3) for i in [-3, 1, *range(8, 149, 3), 149, 150, 151]] + [(4, day(60))], REQUESTS)
        a = forecast.request_features(asked, history, plan, stores)
        b = forecast.overlay_features(asked, history, plan, stores)
        assert a.columns == b.columns and a.dtypes == b.dtypes
        got, want = as_rows(b), as_rows(a)
        assert len(got) == 7 * asked.count() and got == want
        seen = b.agg(*[F.countDistinct(c) for c in ("days_since_reopen", "days_to_long_closure", "prev_holiday", "day_status")]).first()
        assert all(n >= 3 for n in seen)


def test_overlay_sees_no_later_day_and_needs_no_requests(spark):
    stores = spark.createDataFrame([(s, "a", "a", 100.0, 3.0, 2014.0, 0, None, None, None) for s in (1, 2, 3)], STORES)
    plan, origin = spark.createDataFrame([], panel.PLAN), day(100)
    asked = spark.createDataFrame([(1, origin), (2, origin)], REQUESTS)
    tables = []
    for factor in (1, 3):
        data = [r | {"Customers": r["Customers"] * (factor if r["Date"] >= origin else 1)} for r in strange_history(5)]
        tables.append(spark.createDataFrame([tuple(r[c] for c in panel.HISTORY.names) for r in data], panel.HISTORY))
    a, b = (as_rows(forecast.overlay_features(asked, t, plan, stores)) for t in tables)
    assert a == b and len(a) == 14
    assert forecast.overlay_features(asked.limit(0), tables[0], plan, stores).count() == 0


def test_overlay_windows_read_the_history_once(spark):
    """However many requests: one scan of the history for the table, and the requests' rows are bounded by their number."""
    stores = spark.createDataFrame([(s, "a", "a", 100.0, 3.0, 2014.0, 0, None, None, None) for s in (1, 2, 3)], STORES)
    history = spark.createDataFrame([tuple(r[c] for c in panel.HISTORY.names) for r in strange_history(6)], panel.HISTORY)
    asked = spark.createDataFrame([(s, day(i)) for s in (1, 2) for i in range(60, 120)], REQUESTS)
    text = forecast.overlay_features(asked, history, spark.createDataFrame([], panel.PLAN), stores)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("explode(sequence(date_sub") == 1 and text.lower().count("cartesian") == 0
    assert sum("Sales#" in line and "LogicalRDD" in line for line in text.splitlines()) <= 1
