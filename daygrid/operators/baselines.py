"""Naive seasonal baselines on a calendar, by one window each over rows of the same weekday."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The validation folds and the holdout.
FOLDS = (("winter", dt.date(2014, 12, 6), dt.date(2015, 1, 16)), ("spring", dt.date(2015, 3, 28), dt.date(2015, 5, 8)), ("summer", dt.date(2015, 5, 9), dt.date(2015, 6, 19)))
HOLDOUT = ("holdout", dt.date(2015, 6, 20), dt.date(2015, 7, 31))
BASELINES = ("lag_7", "lag_14", "median_7_28")


def weekday_window(keys=("Store",)) -> Window:
    return Window.partitionBy(*keys, "DayOfWeek").orderBy("Date")


def fortnight_window(keys=("Store",)) -> Window:
    return Window.partitionBy(*keys, F.pmod(F.datediff("Date", F.lit(dt.date(1970, 1, 1))), F.lit(14))).orderBy("Date")


def same_weekday_history(calendar: DataFrame, max_weeks: int = 52, keys=("Store",)) -> DataFrame:
    """Store, Date, weeks back, value: the open values of the same weekday up to max_weeks earlier."""
    seen = F.when(F.col("day_status") == "open", F.struct("Date", F.col("Customers").alias("value")))
    past = F.collect_list(seen).over(weekday_window(keys).rowsBetween(-max_weeks, -1))
    rows = calendar.select(*keys, "Date", past.alias("past")).select(*keys, "Date", F.explode("past").alias("p"))
    return rows.select(*keys, "Date", (F.datediff("Date", "p.Date") / 7).cast("int").alias("weeks"), F.col("p.value").alias("value"))


def with_baselines(calendar: DataFrame, keys=("Store",), max_weeks: int = 52) -> DataFrame:
    """Adds lag_7 (nearest open same weekday), lag_14 (even weeks only), median_7_28 (median of four weeks, else lag_7), and the day and
    promotion that lag_7 and lag_14 come from."""
    value = F.when(F.col("day_status") == "open", F.struct("Date", F.col("Customers").cast("double").alias("v"), "Promo"))
    week, two = weekday_window(keys), fortnight_window(keys)
    # A store-only window first, so that the one exchange is by store.
    rows = calendar.withColumn("__first", F.min("Date").over(Window.partitionBy(*keys))).withColumn("__v", value)
    rows = rows.withColumn("__7", F.last("__v", ignorenulls=True).over(week.rowsBetween(-max_weeks, -1)))
    rows = rows.withColumn("__m", F.percentile(F.col("__v.v"), F.lit(0.5)).over(week.rowsBetween(-4, -1)))
    rows = rows.withColumn("__14", F.last("__v", ignorenulls=True).over(two.rowsBetween(-max_weeks // 2, -1)))
    return rows.select(
        *calendar.columns, F.col("__7.v").alias("lag_7"), F.col("__14.v").alias("lag_14"), F.coalesce("__m", "__7.v").alias("median_7_28"),
        F.col("__7.Date").alias("lag_7_day"), F.col("__14.Date").alias("lag_14_day"), F.col("__7.Promo").alias("lag_7_promo"), F.col("__14.Promo").alias("lag_14_promo"),
    )


def folds(spark: SparkSession, rows=FOLDS) -> DataFrame:
    """The periods as a table: the three validation folds unless told otherwise. The holdout takes no part in choices."""
    return spark.createDataFrame(list(rows), "fold string, start date, end date")


def in_folds(days: DataFrame, which: DataFrame) -> DataFrame:
    """Each day with the folds that hold it. The fold table is a handful of rows given by the caller."""
    return days.join(F.broadcast(which), F.col("Date").between(F.col("start"), F.col("end")))


def baseline_predictions(rows: DataFrame, which: DataFrame, names=BASELINES) -> DataFrame:
    """Store, Date, DayOfWeek, Promo, fold, start, model, y, pred on the open days of the folds. One row per day and baseline."""
    days = in_folds(rows.filter("day_status = 'open'"), which)
    source = {"lag_7": ("lag_7_day", "lag_7_promo"), "lag_14": ("lag_14_day", "lag_14_promo")}
    none = (F.lit(None).cast("date"), F.lit(None).cast("int"))
    each = [F.struct(F.lit(n).alias("model"), F.col(n).alias("pred"), (F.col(source[n][0]) if n in source else none[0]).alias("from_day"), (F.col(source[n][1]).cast("int") if n in source else none[1]).alias("from_promo")) for n in names]
    return days.select("Store", "Date", "DayOfWeek", F.col("Promo").cast("int").alias("Promo"), "fold", "start", F.col("Customers").cast("double").alias("y"), F.explode(F.array(*each)).alias("p")).select("*", "p.*").drop("p")


def source_weeks(pred: DataFrame) -> DataFrame:
    """How far back each baseline's value comes from: shares at the nearest week, within four, older, and stores with older."""
    weeks = F.datediff("Date", "from_day") / 7
    near = F.when(F.col("model") == "lag_14", 2).otherwise(1)
    rows = pred.filter("from_day is not null").withColumn("w", weeks).withColumn("near", near)
    share = lambda c: F.avg(c.cast("int"))
    return rows.groupBy("fold", "model").agg(share(F.col("w") == F.col("near")).alias("nearest"), share((F.col("w") > F.col("near")) & (F.col("w") <= 4)).alias("within_4"), share(F.col("w") > 4).alias("older"), F.count_distinct(F.when(F.col("w") > 4, F.col("Store"))).alias("stores_older"))


def promo_errors(pred: DataFrame) -> DataFrame:
    """Mean relative error and mean absolute relative error in % by fold, model and promotion, on the validation folds."""
    e = (F.col("pred") - F.col("y")) / F.col("y") * 100
    return pred.filter(F.col("fold") != HOLDOUT[0]).groupBy("fold", "model", "Promo").agg(F.avg(e).alias("bias_pct"), F.avg(F.abs(e)).alias("ape"))


def phase_errors(pred: DataFrame) -> DataFrame:
    """Per lag on the validation folds: the share in % of days whose source day had the same promotion state (a day without a source had not),
    and the absolute error in % on those days and on the others."""
    rows = pred.filter((F.col("fold") != HOLDOUT[0]) & F.col("model").isin("lag_7", "lag_14")).withColumn("same", F.coalesce(F.col("Promo") == F.col("from_promo"), F.lit(False)))
    ape = F.abs(F.col("pred") - F.col("y")) / F.col("y") * 100
    return rows.groupBy("model").agg((F.avg(F.col("same").cast("int")) * 100).alias("same_share"), F.avg(F.when(F.col("same"), ape)).alias("ape_same"), F.avg(F.when(~F.col("same"), ape)).alias("ape_other"))
