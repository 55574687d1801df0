"""Files, run log, grids, ablation, importance."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from daygrid.operators import audit, forecast, models, scoring
from daygrid.operators import calendar as cal
from daygrid.operators import features as feats
from daygrid.sources import panel

from test_panel import START, STORE, STORE_SCHEMA, frame, rows

FOLDS = (("a", dt.date(2015, 4, 1), dt.date(2015, 4, 14)), ("b", dt.date(2015, 4, 15), dt.date(2015, 4, 28)))


def test_files(spark, tmp_path):
    history = frame(spark, rows(days=40))
    history.write.option("header", True).csv(str(tmp_path / "h.csv"))
    history.write.parquet(str(tmp_path / "h"))
    a, b = panel.load_history(spark, str(tmp_path / "h.csv")), panel.load_history(spark, str(tmp_path / "h"))
    assert sorted(a.collect()) == sorted(b.collect()) == sorted(history.collect())
    plan = history.drop("Sales", "Customers").withColumn("Open", F.lit(None).cast("int"))
    plan.write.parquet(str(tmp_path / "p"))
    assert panel.load_plan(spark, str(tmp_path / "p")).count() == 40
    stores = spark.createDataFrame(STORE, STORE_SCHEMA)
    panel.build_processed(history, plan, stores, stores, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/history")).count() == 40
    assert panel.check_tables({"h": history}, {"h": (["Store", "Nope"], 39), "s": ([], None)}) == ["h: missing columns Nope", "h: rows 40, 39 expected", "s: absent"]
    panel.log_run(spark, {"run": 1, "mape": 2.0}, str(tmp_path / "log"))
    panel.log_run(spark, {"run": 2, "wape": 3.0}, str(tmp_path / "log"))
    assert {tuple(r) for r in panel.runs(spark, str(tmp_path / "log")).select("run", "mape", "wape").collect()} == {(1, 2.0, None), (2, None, 3.0)}


@pytest.fixture(scope="module")
def tables(spark):
    stores = spark.createDataFrame(STORE, STORE_SCHEMA)
    calendar = cal.restore_calendar(frame(spark, rows()), START + dt.timedelta(119)).persist()
    return calendar, feats.build_features(calendar, stores).persist(), feats.category_levels(stores)


def test_grid_and_ablation(spark, tables):
    calendar, table, levels = tables
    numeric, categorical = ["lag_filled", "month"], ["DayOfWeek"]
    build = lambda n, c: models.make_ridge(levels, n, c)
    grid = models.grid_search(table, calendar, {f"alpha_{a}": models.make_ridge(levels, numeric, categorical, a) for a in (1.0, 1000.0)}, FOLDS).collect()
    assert len(grid) == 2 and grid[0]["mape"] <= grid[1]["mape"]
    out = models.ablation(table, calendar, build, {"lags": ["lag_filled"]}, numeric, categorical, FOLDS).collect()
    assert [r["model"] for r in out] == ["without:lags"]
    report = models.report(scoring.fold_scores(models.run_folds(table, calendar, build(numeric, categorical), "ridge", FOLDS)), {"alpha": "10"}).first()
    assert report["alpha"] == "10" and report["mape_ridge"] > 0


def test_trees_and_segments(spark, tables):
    calendar, table, levels = tables
    numeric, categorical = ["lag_filled", "Promo"], ["DayOfWeek"]
    make = models.make_trees(levels, numeric, categorical, trees=3, depth=3, min_rows=2)
    fitted = models.DemandModel(make, {"mid": models.make_ridge(levels, numeric, categorical)}).fit(scoring.training_rows(table, "2015-04-01"))
    shares = models.importance(fitted.shared, numeric, categorical)
    assert sum(shares.values()) == pytest.approx(100) and set(shares) == {*numeric, *categorical}
    assert models.importance_over_folds([fitted.shared, fitted.shared], numeric, categorical)["Promo"][1] == 0
    held = table.filter("Date >= '2015-04-01' and day_status = 'open'")
    own = fitted.own["mid"].transform(held).agg(F.sum("__pred")).first()[0]
    assert fitted.predict(held).agg(F.sum("rel")).first()[0] == pytest.approx(own)  # the only store is of that segment


def test_exact_and_one_pass_features_agree(spark, tables):
    calendar, table, _ = tables
    stores = spark.createDataFrame(STORE, STORE_SCHEMA)
    asked = spark.createDataFrame([(1, START + dt.timedelta(90))], "Store int, origin date")
    exact = forecast.request_features(asked, frame(spark, rows()), spark.createDataFrame([], panel.PLAN), stores).select("Date", "level", "lag_7", "lag_median").orderBy("Date").collect()
    one = forecast.one_pass_features(asked, calendar, stores).select("Date", "level", "lag_7", "lag_median").orderBy("Date").collect()
    assert exact == one and len(one) == 7


def test_effect_size_by_hand(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 2.0), ("b", 4.0), ("b", None)], "g string, v double")
    # ranks 1, 2.5, 2.5, 4; H = 12/20 * (3.5^2/2 + 6.5^2/2) - 15 = 1.35, over 1 - 6/60
    assert audit.epsilon_squared(df, "g", "v").first()["eps2"] == pytest.approx(1.35 / 0.9 / 3)
