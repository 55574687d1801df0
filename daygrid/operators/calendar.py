"""The full store-by-day calendar, closure runs and export gaps. All windows share one exchange by store."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

N_LONG = 3
STATUSES = ("open", "closed", "absent", "anomaly", "missing_export")
KNOWN = ("Sales", "Customers", "Open", "Promo", "StateHoliday", "SchoolHoliday")


def by(keys) -> Window:
    return Window.partitionBy(*keys).orderBy("Date")


def grid(days: DataFrame, start: Column, end: Column, keys=("Store",)) -> DataFrame:
    """Every day from start to end for each key; the known columns of added days are null. Each row is stretched over the gap behind it
    (the first also over the one before it), so there is no join."""
    w = by(keys)
    known = [c for c in days.columns if c not in (*keys, "Date", "DayOfWeek")]
    rows = days.filter(F.col("Date") <= end).withColumn("__next", F.lead("Date").over(w)).withColumn("__last", F.lag("Date").over(w))
    first = F.when(F.col("__last").isNull(), F.least(start, F.col("Date"))).otherwise(F.col("Date"))
    rows = rows.withColumn("__day", F.explode(F.sequence(first, F.coalesce(F.date_sub("__next", 1), end))))
    own = F.col("__day") == F.col("Date")
    return rows.select(*keys, F.col("__day").alias("Date"), (F.weekday("__day") + 1).alias("DayOfWeek"), *[F.when(own, F.col(c)).alias(c) for c in known])


def with_status(rows: DataFrame, n_long: int = N_LONG, keys=("Store",)) -> DataFrame:
    """day_status, closure_run_days, customers_clean, sales_clean on a grid."""
    closed = F.coalesce(F.col("Open") == 0, F.lit(False))
    rows = rows.withColumn("__closed", closed).withColumn("__turn", F.lag("__closed").over(by(keys)))
    rows = rows.withColumn("__run", F.sum(F.when(F.col("__closed") != F.col("__turn"), 1).otherwise(0)).over(by(keys)))
    days = F.count("*").over(Window.partitionBy(*keys, "__run"))
    rows = rows.withColumn("closure_run_days", F.when(F.col("__closed"), days).cast("int"))
    status = F.when(F.col("Open").isNull(), "missing_export").when(F.col("closure_run_days") >= n_long, "absent").when(F.col("__closed"), "closed").when(F.col("Customers") == 0, "anomaly").otherwise("open")
    rows = rows.withColumn("day_status", status)
    clean = lambda c: F.when(F.col("day_status").isin("open", "closed"), F.col(c).cast("double"))
    return rows.withColumn("customers_clean", clean("Customers")).withColumn("sales_clean", clean("Sales")).drop("__closed", "__turn", "__run")


def restore_calendar(history: DataFrame, end, n_long: int = N_LONG) -> DataFrame:
    """The calendar of all stores from the first day of the whole history to `end`, with day statuses."""
    first = history.agg(F.min("Date")).first()[0]
    return with_status(grid(history, F.lit(first), F.lit(end).cast("date")), n_long)


def period_days(calendar: DataFrame, start, end) -> DataFrame:
    """Open days of a closed interval."""
    return calendar.filter((F.col("day_status") == "open") & F.col("Date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def closure_runs(history: DataFrame) -> DataFrame:
    """Runs of closed days on the raw rows; a date jump ends a run too. Store, start, end, days, has_holiday."""
    closed = history.filter("Open = 0").withColumn("run", F.date_sub("Date", F.row_number().over(by(["Store"]))))
    return closed.groupBy("Store", "run").agg(F.min("Date").alias("start"), F.max("Date").alias("end"), F.count("*").cast("int").alias("days"), F.max(F.coalesce(F.col("StateHoliday"), F.lit("0")) != "0").alias("has_holiday")).drop("run")


def flag_runs(runs: DataFrame, history: DataFrame, n_long: int = N_LONG, test_start=dt.date(2015, 6, 20)) -> DataFrame:
    """Adds is_long, is_left_censored (starts on the first day of the data), in_test, not_finished (ends on its last day)."""
    low, high = history.agg(F.min("Date"), F.max("Date")).first()
    return runs.select("*", (F.col("days") >= n_long).alias("is_long"), (F.col("start") == F.lit(low)).alias("is_left_censored"), (F.col("end") >= F.lit(test_start)).alias("in_test"), (F.col("end") == F.lit(high)).alias("not_finished"))


def run_lengths(runs: DataFrame, clip: int = 31) -> DataFrame:
    return runs.groupBy(F.least("days", F.lit(clip)).alias("days")).agg(F.count("*").alias("runs"))


def long_closures_per_store(runs: DataFrame, stores: DataFrame, n_long: int = N_LONG) -> DataFrame:
    """Store, StoreType, n_long_closures; 0 for stores without one."""
    n = runs.filter(F.col("days") >= n_long).groupBy("Store").agg(F.count("*").alias("n"))
    return stores.join(n, "Store", "left").select("Store", "StoreType", F.coalesce("n", F.lit(0)).alias("n_long_closures"))


def long_closure_buckets(per_store: DataFrame) -> DataFrame:
    """Stores with 0, 1 and 2 or more long closures, with shares."""
    bucket = F.when(F.col("n_long_closures") >= 2, "2+").otherwise(F.col("n_long_closures").cast("string"))
    counts = per_store.groupBy(bucket.alias("closures")).agg(F.count("*").alias("stores"))
    return counts.withColumn("share", F.col("stores") / F.sum("stores").over(Window.partitionBy()))


def long_closure_share(per_store: DataFrame) -> DataFrame:
    return per_store.groupBy("StoreType").agg(F.avg((F.col("n_long_closures") > 0).cast("int")).alias("share"))


def export_gaps(history: DataFrame) -> DataFrame:
    """Missing spans: inner ones between rows, leading and trailing ones against the whole data's span. Store, kind, start, end, days."""
    low, high = history.agg(F.min("Date"), F.max("Date")).first()
    before = history.select("Store", "Date", F.lag("Date").over(by(["Store"])).alias("last"))
    inner = before.filter(F.datediff("Date", "last") > 1).select("Store", F.lit("inner").alias("kind"), F.date_add("last", 1).alias("start"), F.date_sub("Date", 1).alias("end"))
    span = history.groupBy("Store").agg(F.min("Date").alias("a"), F.max("Date").alias("b"))
    lead = span.filter(F.col("a") > F.lit(low)).select("Store", F.lit("leading").alias("kind"), F.lit(low).alias("start"), F.date_sub("a", 1).alias("end"))
    trail = span.filter(F.col("b") < F.lit(high)).select("Store", F.lit("trailing").alias("kind"), F.date_add("b", 1).alias("start"), F.lit(high).alias("end"))
    return inner.unionByName(lead).unionByName(trail).withColumn("days", F.datediff("end", "start") + 1)


def gap_groups(gaps: DataFrame) -> DataFrame:
    return gaps.groupBy("start", "end", "days").agg(F.count("*").alias("stores"))


def gap_border(history: DataFrame, gaps: DataFrame, around: int = 3) -> DataFrame:
    """Open share on the days before and after the longest gap, for stores with any gap of more than a day and without. Date, with_gap,
    without_gap."""
    top = gaps.orderBy(F.desc("days"), "start", "Store").limit(1).select(F.col("start").alias("s"), F.col("end").alias("e"))
    at = gaps.filter("days > 1").select("Store").distinct().withColumn("in_gap", F.lit(1))
    near = F.col("Date").between(F.date_sub("s", around), F.date_sub("s", 1)) | F.col("Date").between(F.date_add("e", 1), F.date_add("e", around))
    rows = history.join(F.broadcast(top), near).join(at, "Store", "left")
    share = lambda with_gap: F.avg(F.when(F.col("in_gap").isNotNull() if with_gap else F.col("in_gap").isNull(), F.col("Open")))
    return rows.groupBy("Date").agg(share(True).alias("with_gap"), share(False).alias("without_gap"))


def short_long_closures(runs: DataFrame, low: int = 3, high: int = 6) -> DataFrame:
    """Closures of 3 to 6 days with the names of their first and last day."""
    return runs.filter(F.col("days").between(low, high)).select("*", F.date_format("start", "EEEE").alias("start_day"), F.date_format("end", "EEEE").alias("end_day")).orderBy("start", "Store")
