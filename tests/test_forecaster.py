"""A forecaster saved and loaded with its segment models, the full report, exact resampling."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from daygrid.operators import boosting, forecaster, models, scoring
from daygrid.operators.features import category_levels
from daygrid.plans import demand

from helpers import DATA

NUMERIC, CATEGORICAL = ("Promo", "lag_filled"), ("DayOfWeek", "segment")


@pytest.fixture(scope="module")
def tables(spark):
    p = demand.Panel(spark, str(DATA))
    table = p.features.persist()
    return table, {c: v for c, v in category_levels(p.stores).items() if c in CATEGORICAL}


def test_saved_and_loaded_with_segment_models(spark, tables, tmp_path):
    """Of both kinds at once: shared trees, a segment's ridge and a segment's trees; the loaded unit forecasts the same."""
    table, levels = tables
    trees = boosting.make_best_first(levels, NUMERIC, CATEGORICAL, trees=5, leaves=6, min_rows=20)
    segments = [r[0] for r in table.select("segment").distinct().collect()]
    own = {segments[0]: models.make_ridge(levels, NUMERIC, CATEGORICAL)} | {s: trees for s in segments[1:]}
    fitted = models.DemandModel(trees, own, levels, NUMERIC, CATEGORICAL).fit(scoring.training_rows(table, "2015-06-20"))
    assert set(fitted.own) == set(segments)
    path = str(tmp_path / "f")
    forecaster.save_forecaster(fitted, {"train_end": "2015-06-19"}, path)
    loaded, about = forecaster.load_forecaster(spark, path, NUMERIC, CATEGORICAL, levels)
    assert about == {"train_end": "2015-06-19"} and set(loaded.own) == set(segments)
    held = table.filter("day_status = 'open' and Date >= '2015-06-20'")
    rows = lambda m: sorted(tuple(r) for r in m.forecast(held).select("Store", "Date", "forecast").collect())
    assert rows(loaded) == rows(fitted)
    again = models.DemandModel(models.make_ridge(levels, NUMERIC, CATEGORICAL), (), levels, NUMERIC, CATEGORICAL).fit(scoring.training_rows(table, "2015-06-20"))
    forecaster.save_forecaster(again, {"train_end": "x"}, path)
    loaded, about = forecaster.load_forecaster(spark, path, NUMERIC, CATEGORICAL, levels)
    assert about["train_end"] == "x" and loaded.own == {} and rows(loaded) == rows(again)
    for numeric, categorical, given, words in ((NUMERIC[:1], CATEGORICAL, levels, r"removed \['lag_filled'\]"), (NUMERIC[::-1], CATEGORICAL, levels, "order differs"), (NUMERIC, CATEGORICAL, levels | {"segment": ["x"]}, r"other levels: \['segment'\]")):
        with pytest.raises(ValueError, match=words):
            forecaster.load_forecaster(spark, path, numeric, categorical, given)
    with pytest.raises(ValueError, match="not fitted"):
        forecaster.save_forecaster(models.DemandModel(trees), {}, path)


def blocks_of(spark, n=900, seed=2):
    rng = np.random.default_rng(seed)
    rows = [(m, int(k % 30), int(k // 30), int(c), float(e), float(r)) for k in range(n) for c, e, r in [(rng.integers(1, 8), rng.random() * 40, rng.random())] for m in ("a", "b")]
    return spark.createDataFrame(rows, "model string, Store int, week int, n int, e double, r double")


@pytest.mark.parametrize("bucket_size", [4096, 50, 7])
def test_counts_of_a_draw_sum_to_the_blocks(spark, bucket_size):
    """With one day a block and an error of one, the weighted error of a draw is exact whatever is drawn; with days as errors, days are counted right."""
    blocks = blocks_of(spark).withColumn("n", F.lit(1)).withColumn("e", F.lit(1.0))
    got = scoring.multinomial_bootstrap(blocks, 40, bucket_size=bucket_size).toPandas()
    assert len(got) == 80 and np.allclose(got["mae"], 1)
    # A mean of 900 times an indicator of 30 blocks: counts of these are whole numbers, binomial(900, 1 / 30).
    some = blocks.withColumn("e", (F.col("Store") == 3).cast("double"))
    hits = scoring.multinomial_bootstrap(some, 400, bucket_size=bucket_size).filter("model = 'a'").toPandas()["mae"].to_numpy() * 900
    assert np.allclose(hits, np.round(hits)) and abs(hits.mean() - 30) < 4 * 5.4 / 20 and 4.6 < hits.std() < 6.2


def test_moments_agree_with_the_ordered_bootstrap(spark):
    blocks = blocks_of(spark, 300)
    a, b = scoring.bootstrap(blocks, 600).toPandas(), scoring.multinomial_bootstrap(blocks, 600, bucket_size=40).toPandas()
    for m in ("mae", "mape"):
        x, y = a.loc[a["model"] == "a", m], b.loc[b["model"] == "a", m]
        assert abs(x.mean() - y.mean()) < 5 * x.std() / np.sqrt(300) and 0.85 < y.std() / x.std() < 1.18
    both = b.pivot(index="draw", columns="model", values="mae")
    assert np.allclose(both["a"], both["b"])  # the same draws for both models
    again = scoring.multinomial_bootstrap(blocks.repartition(7), 600, bucket_size=40).toPandas()
    assert sorted(again["mae"].round(9)) == sorted(b["mae"].round(9))
