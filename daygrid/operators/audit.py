"""Audit of a raw panel and the profile of its stores."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import month_start
from .calendar import closure_runs, export_gaps, flag_runs
from .features import SEGMENTS
from .order import average_ranks, quantiles

TEST_START = dt.date(2015, 6, 20)
MIN_OPEN_DAYS = 120


def days_per_store(history: DataFrame) -> DataFrame:
    """Histogram of rows per store."""
    return history.groupBy("Store").count().groupBy(F.col("count").alias("days")).agg(F.count("*").alias("stores"))


def stores_per_day(history: DataFrame) -> DataFrame:
    return history.groupBy("Date").agg(F.count_distinct("Store").alias("stores"))


def coverage(history: DataFrame) -> DataFrame:
    """One row: stores, days, rows, full and partial days, fewest stores of a day, missing pairs, duplicates, wrong weekdays."""
    per_day = stores_per_day(history)
    stores = history.agg(F.count_distinct("Store")).first()[0]
    d = per_day.agg(F.count("*").alias("days"), F.count_if(F.col("stores") == stores).alias("full_days"), F.count_if(F.col("stores") < stores).alias("partial_days"), F.min("stores").alias("fewest"))
    pairs = history.groupBy("Store", "Date").count().agg(F.count("*").alias("pairs"), F.sum("count").alias("n_rows"))
    wrong = history.agg(F.count_if(F.col("DayOfWeek") != F.weekday("Date") + 1).alias("wrong_weekday"))
    one = d.crossJoin(pairs).crossJoin(wrong)  # three single rows
    return one.select(F.lit(stores).cast("long").alias("stores"), "days", "n_rows", "full_days", "partial_days", "fewest", (F.lit(stores) * F.col("days") - F.col("pairs")).alias("missing_pairs"), (F.col("n_rows") - F.col("pairs")).alias("duplicates"), "wrong_weekday")


def holdout_design(history: DataFrame, weeks: int = 6) -> DataFrame:
    """Holiday kinds in the last weeks of the data: rows, and the share of school holidays."""
    last = history.agg(F.max("Date")).first()[0]
    rows = history.filter(F.col("Date") > F.date_sub(F.lit(last), 7 * weeks))
    return rows.groupBy("StateHoliday").agg(F.count("*").alias("days"), F.avg("SchoolHoliday").alias("school_share"))


def null_report(df: DataFrame) -> DataFrame:
    """Columns with nulls: count and share."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns], F.count("*").alias("__n"))
    long = row.select("__n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in df.columns])).alias("p")).select("p.*", "__n")
    return long.filter("nulls > 0").select("column", "nulls", (F.col("nulls") / F.col("__n")).alias("share"))


def structural_nulls(stores: DataFrame) -> DataFrame:
    """Rules on nulls of the store dimension."""
    p2 = [F.col(c).isNull() for c in ("Promo2SinceWeek", "Promo2SinceYear", "PromoInterval")]
    all_null, any_null = p2[0] & p2[1] & p2[2], p2[0] | p2[1] | p2[2]
    m, y, d = (F.col(c).isNull() for c in ("CompetitionOpenSinceMonth", "CompetitionOpenSinceYear", "CompetitionDistance"))
    return stores.agg(F.bool_and(all_null == (F.col("Promo2") == 0)).alias("promo2_iff"), F.count_if(any_null & ~all_null).alias("promo2_partly"), F.bool_and(m == y).alias("date_together"), F.count_if(d).alias("no_distance"), F.count_if(~d & m).alias("distance_no_date"), F.count_if(d & ~m).alias("date_no_distance"))


def cross_tab(df: DataFrame, a: str, b: str, total: str = "all") -> DataFrame:
    """Counts with margins (long)."""
    return df.cube(a, b).agg(F.count("*").alias("n"), F.grouping(a).alias("ga"), F.grouping(b).alias("gb")).select(F.when(F.col("ga") == 1, total).otherwise(F.col(a)).alias(a), F.when(F.col("gb") == 1, total).otherwise(F.col(b)).alias(b), "n")


def describe(df: DataFrame, columns, points=(0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """count, mean, std, min, percentiles (linear between values) and max per column."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("p")).select("p.*")
    names = {f"p{round(100 * p):02d}": p for p in points}
    out = rows.groupBy("column").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    return out.join(quantiles(rows, "x", names, ("column",)), "column", "left").select("column", "n", "mean", "std", "min", *names, "max")


def competitor_opening(stores: DataFrame) -> DataFrame:
    return stores.withColumn("opened", month_start(F.col("CompetitionOpenSinceYear"), F.col("CompetitionOpenSinceMonth")))


def openings_by_month(stores: DataFrame, start=dt.date(2010, 1, 1), end=dt.date(2015, 7, 1)) -> DataFrame:
    """Competitor openings by month with zeros for months without any."""
    months = stores.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end), F.expr("interval 1 month"))).alias("month"))
    n = competitor_opening(stores).groupBy(F.col("opened").alias("month")).agg(F.count("*").alias("n"))
    return months.join(n, "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("openings"))


def openings_by_year(stores: DataFrame) -> DataFrame:
    return competitor_opening(stores).filter("opened is not null").groupBy(F.year("opened").alias("year")).agg(F.count("*").alias("openings"))


def competitor_windows(stores: DataFrame, start=dt.date(2013, 1, 1), train_end=dt.date(2015, 6, 19)) -> DataFrame:
    o = F.col("opened")
    kind = F.when(o.isNull(), "unknown").when(o <= F.lit(start), "before").when(o <= F.lit(train_end), "in_train").otherwise("after_train")
    return competitor_opening(stores).groupBy(kind.alias("opening")).agg(F.count("*").alias("stores"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts of the values, null included."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def distance_bins(stores: DataFrame) -> DataFrame:
    """Competition distance in ten bins per power of ten."""
    return stores.filter("CompetitionDistance > 0").groupBy(F.floor(F.log10("CompetitionDistance") * 10).cast("int").alias("bin")).agg(F.count("*").alias("stores"))


def profile(history: DataFrame, stores: DataFrame, test_start=TEST_START, n_long: int = 3) -> DataFrame:
    """One row per store. Guests, checks and anomalies come from days before the test, the schedule (closures, Sundays, open days) from all days.
    One grouped pass over the history, with closure runs and the dimension joined to it (both at most a few rows per store)."""
    train = F.col("Date") < F.lit(test_start)
    active = train & (F.col("Open") == 1) & (F.col("Customers") > 0)
    when = lambda c, x: F.when(c, F.col(x))
    train_end = test_start - dt.timedelta(1)
    year = lambda y: F.when(active & F.col("Date").between(F.lit(dt.date(y, 1, 1)), F.lit(train_end.replace(year=y))), F.col("Customers"))
    low, high = history.agg(F.min("Date"), F.max("Date")).first()
    before, last = test_start.year - 1, test_start.year
    per = history.groupBy("Store").agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("Open") == 0).alias("closed_days"),
        F.count_if(train & (F.col("Open") == 1) & (F.col("Customers") == 0)).alias("n_anomalies"),
        F.count_if((F.col("DayOfWeek") == 7) & (F.col("Open") == 1)).alias("sunday_open_days"),
        F.count_if(~train & (F.col("Open") == 1)).alias("open_days_test"),
        F.percentile(when(active, "Customers"), F.lit(0.5)).alias("guests_median"),
        (F.stddev_samp(when(active, "Customers")) / F.avg(when(active, "Customers"))).alias("guests_cv"),
        (F.sum(when(active, "Sales")) / F.sum(when(active, "Customers"))).alias("avg_check"),
        F.count(year(before)).alias(f"open_days_{before}"),
        F.count(year(last)).alias(f"open_days_{last}"),
        F.try_divide(F.avg(year(last)), F.avg(year(before))).alias("growth_ratio"),
    )
    long_runs = flag_runs(closure_runs(history), history, n_long, test_start).filter("is_long")
    closures = long_runs.groupBy("Store").agg(F.count("*").alias("n_long"), F.sum("days").alias("long_days"), F.bool_or("is_left_censored").alias("left"), F.bool_or("in_test").alias("test"))
    dim = competitor_opening(stores).withColumn("competitor_opened_in_train", F.coalesce((F.col("opened") > F.lit(low)) & (F.col("opened") <= F.lit(train_end)), F.lit(False)))
    rows = per.join(closures, "Store", "left").join(dim, "Store")
    zero = lambda c, name: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(name)
    no = lambda c, name: F.coalesce(F.col(c), F.lit(False)).alias(name)
    long_days = F.coalesce(F.col("long_days"), F.lit(0))
    missing = (F.lit((high - low).days + 1) - F.col("n_rows")).cast("long") if low else F.col("n_rows")
    return rows.select(
        "Store", "StoreType", "Assortment", "CompetitionDistance", "Promo2", "competitor_opened_in_train", missing.alias("missing_days"), zero("n_long", "n_long_closures"), zero("long_days", "long_closure_days"),
        ((F.col("closed_days") - long_days) / F.col("n_rows")).alias("share_regular_closed"), (long_days / F.col("n_rows")).alias("share_long_closed"),
        "n_anomalies", "sunday_open_days", "open_days_test", "guests_median", "guests_cv", "avg_check", f"open_days_{before}", f"open_days_{last}", (F.col("growth_ratio") - 1).alias("growth_raw"),
        (missing > 1).alias("has_export_gap"), (F.coalesce("n_long", F.lit(0)) > 0).alias("has_long_closure"), no("left", "has_left_censored"), no("test", "closed_in_test"), (F.col("sunday_open_days") > 0).alias("sunday_open"),
    ).withColumn("growth_yoy", F.when(F.least(f"open_days_{before}", f"open_days_{last}") >= MIN_OPEN_DAYS, F.col("growth_raw"))).withColumn("segment", F.coalesce(*[F.when(F.col("StoreType") == k, v) for k, v in SEGMENTS.items()]))


def network_series(history: DataFrame, window: int = 28, least: int = 20, test_start=TEST_START) -> DataFrame:
    """Mean guests of a stable set (stores without an export gap of more than a day, open days with guests before the test, Monday to Saturday,
    no holidays) per day with its 28-row rolling mean. One row per day, so the window needs no key."""
    gap_stores = export_gaps(history).filter("days > 1").select("Store").distinct()
    stable = history.filter((F.col("Date") < F.lit(test_start)) & (F.col("Open") == 1) & (F.col("Customers") > 0)).join(gap_stores, "Store", "left_anti")
    days = stable.filter((F.col("DayOfWeek") <= 6) & (F.col("StateHoliday") == "0")).groupBy("Date").agg(F.avg("Customers").alias("mean"))
    w = Window.orderBy("Date").rowsBetween(1 - window, 0)
    return days.select("Date", "mean", F.when(F.count("mean").over(w) >= least, F.avg("mean").over(w)).alias("rolling"))


def network_growth(history: DataFrame) -> DataFrame:
    """Growth of the stable set from January to 19 June 2014 to the same days of 2015."""
    s = network_series(history).filter((F.month("Date") < 6) | ((F.month("Date") == 6) & (F.dayofmonth("Date") <= 19)))
    mean = lambda y: F.avg(F.when(F.year("Date") == y, F.col("mean")))
    return s.agg((mean(2015) / mean(2014) - 1).alias("growth"))


def missing_growth(rows: DataFrame) -> DataFrame:
    """Stores without a growth figure, with their open days."""
    return rows.filter("growth_yoy is null").select("Store", "open_days_2014", "open_days_2015")


def mode_of(df: DataFrame, column: str) -> DataFrame:
    """The most frequent value; the smallest of several."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(1)


def below_mode(df: DataFrame, column: str) -> DataFrame:
    mode = mode_of(df, column).first()
    return df.filter(F.col(column) < (mode["value"] if mode else None)).select("Store", column)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    ra, rb = average_ranks(both, a, "ra"), average_ranks(both, b, "rb")
    rows = both.join(ra.select(F.col("value").alias(a), "ra"), a).join(rb.select(F.col("value").alias(b), "rb"), b)
    return rows.agg(F.corr("ra", "rb").alias("rho"))


def quantile_bin(df: DataFrame, column: str, bins: int, alias: str, missing: str | None = None) -> DataFrame:
    """Bins 1..n between exact quantiles, right-closed, the first with the least value; null stays null or takes a name."""
    row = quantiles(df, column, {f"q{i}": i / bins for i in range(1, bins)}).first()
    edges = [] if row is None or row[0] is None else list(row)
    place = F.lit(bins)
    for i in range(len(edges), 0, -1):
        place = F.when(F.col(column) <= edges[i - 1], i).otherwise(place)
    label = F.when(F.col(column).isNotNull(), place.cast("string"))
    return df.withColumn(alias, F.coalesce(label, F.lit(missing)) if missing else label)


def group_summary(rows: DataFrame, group: str, columns=("guests_median", "avg_check", "guests_cv")) -> DataFrame:
    """Medians, number of stores and share of all, by type or segment."""
    out = rows.groupBy(F.col(group).alias("group")).agg(F.count("*").alias("stores"), *[F.percentile(c, F.lit(0.5)).alias(c) for c in columns])
    return out.withColumn("share", F.col("stores") / F.sum("stores").over(Window.partitionBy()))


def epsilon_squared(df: DataFrame, group: str, value: str) -> DataFrame:
    """Effect size of a grouping: tie-corrected Kruskal-Wallis H over n - 1. Rows with a null are left out."""
    rows = df.filter(F.col(group).isNotNull() & F.col(value).isNotNull()).select(F.col(group).cast("string").alias("g"), F.col(value).alias("value"))
    ranks = average_ranks(rows, "value", "rank")
    sums = rows.join(ranks, "value").groupBy("g").agg(F.sum("rank").alias("r"), F.count("*").alias("k"))
    h = sums.agg(F.sum(F.col("r") * F.col("r") / F.col("k")).alias("s"), F.sum("k").alias("n"))
    t = F.col("ties")
    ties = ranks.agg(F.sum(t * t * t - t).alias("t"))
    n = F.col("n").cast("double")
    raw = (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / F.nullif(1 - F.col("t") / (n * n * n - n), F.lit(0.0))
    return h.crossJoin(ties).select(F.lit(group).alias("feature"), F.lit(value).alias("target"), F.try_divide(raw, n - 1).alias("eps2"))  # two single rows


def ecdf(df: DataFrame, group: str, value: str) -> DataFrame:
    rows = df.filter(F.col(value).isNotNull()).select(F.col(group).alias("group"), F.col(value).alias("value"))
    return rows.withColumn("share", F.cume_dist().over(Window.partitionBy("group").orderBy("value")))


def observation_summary(rows: DataFrame, group: str, value: Column | str) -> DataFrame:
    return rows.groupBy(F.col(group).alias("group")).agg(F.count("*").alias("stores"), F.min(value).alias("least"), F.max(value).alias("most"))
