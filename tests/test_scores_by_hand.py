"""Scores on a table small enough to add up by hand, against the definitions: three folds are averaged, the holdout is scored apart."""

import datetime as dt

import pytest

from daygrid.operators import baselines, scoring
from daygrid.plans import demand

from helpers import DATA

#: fold: (y, base, other) of each day.
DAYS = {
    "winter": [(100.0, 110.0, 100.0), (200.0, 160.0, 190.0)],  # base 10 % and 20 %: 15; other 0 and 5: 2.5
    "spring": [(50.0, 55.0, 60.0)],  # 10; 20
    "summer": [(80.0, 72.0, 80.0), (40.0, 40.0, 42.0)],  # 10 and 0: 5; 0 and 5: 2.5
}


@pytest.fixture(scope="module")
def pred(spark):
    rows = []
    for f, (fold, start, _) in enumerate(baselines.FOLDS):
        for k, (y, base, other) in enumerate(DAYS[fold]):
            for model, p in (("base", base), ("other", other)):
                rows.append((k, start + dt.timedelta(f), fold, model, y, p))
    return spark.createDataFrame(rows, "Store int, Date date, fold string, model string, y double, pred double")


def test_mean_is_over_three_folds(pred):
    got = {(r["model"], r["fold"]): r["mape"] for r in scoring.fold_scores(pred).collect()}
    assert got == pytest.approx({("base", "winter"): 15, ("base", "spring"): 10, ("base", "summer"): 5, ("base", "mean"): 10, ("other", "winter"): 2.5, ("other", "spring"): 20, ("other", "summer"): 2.5, ("other", "mean"): 25 / 3})
    mae = {(r["model"], r["fold"]): r["mae"] for r in scoring.fold_scores(pred).collect()}
    assert mae["base", "mean"] == pytest.approx((25 + 5 + 4) / 3)  # not the mean over days, 21.6


def test_two_better_folds_of_three_are_accepted(pred):
    row = scoring.compare_to_base(scoring.fold_scores(pred), "base").first()
    assert (row["model"], row["better"], row["accept"]) == ("other", 2, True) and row["mean_delta"] == pytest.approx(25 / 3 - 10)
    worse = pred.filter("fold <> 'winter' or model = 'base'").unionByName(pred.filter("fold = 'winter' and model = 'base'").replace("base", "other", "model"))
    row = scoring.compare_to_base(scoring.fold_scores(worse), "base").first()
    assert (row["better"], row["accept"]) == (1, False)


def test_gain_of_the_mean_is_a_gain_of_means(pred):
    got = {(r["fold"], r["metric"]): r["gain_pct"] for r in scoring.improvement(scoring.fold_scores(pred), "base").collect()}
    assert got["mean", "mape"] == pytest.approx((1 - 25 / 3 / 10) * 100) and got["spring", "mape"] == pytest.approx(-100)


def test_segment_mean_is_over_folds(spark, pred):
    segments = spark.createDataFrame([(0, "a"), (1, "b")], "Store int, segment string")
    got = {(r["model"], r["segment"]): r["mape"] for r in scoring.segment_mape(pred, segments).collect()}
    assert got["base", "a"] == pytest.approx(10) and got["base", "b"] == pytest.approx(10) and got["other", "b"] == pytest.approx(5)


def test_the_holdout_chooses_nothing(spark):
    assert {r["fold"] for r in baselines.folds(spark).collect()} == {f[0] for f in baselines.FOLDS}
    for name in ("baseline_scores_by_fold", "improvement_over_base"):
        assert "holdout" not in {r["fold"] for r in demand.QUERIES[name](spark, str(DATA)).collect()}
    assert demand.QUERIES["holdout_baseline_scores"](spark, str(DATA)).count() == 3
