"""Seven-day forecasts for many stores and start dates at once. A bad request becomes a row with an error, not an exception."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import baselines
from .calendar import N_LONG, grid, restore_calendar, with_status
from .features import HORIZON, MIN_LEVEL_DAYS, REOPEN_DAYS, build_features, event_features, lag_features, level_features, with_store

KEYS = ("Store", "origin")
DAY = ("Open", "Promo", "StateHoliday", "SchoolHoliday")
#: Days before the origin that the events of its week can depend on: the last day away, and enough before it to tell a long closure from a short one.
PAST_DAYS = REOPEN_DAYS + N_LONG


def coverage(history: DataFrame, plan: DataFrame, stores: DataFrame) -> DataFrame:
    """Per store: segment, first and last day of history, last planned day (null without a plan)."""
    h = history.groupBy("Store").agg(F.min("Date").alias("first_day"), F.max("Date").alias("last_day"))
    p = plan.groupBy("Store").agg(F.max("Date").alias("last_plan_day"))
    return stores.select("Store", "segment").join(h, "Store", "left").join(p, "Store", "left")


def week_plan(requests: DataFrame, history: DataFrame, plan: DataFrame) -> DataFrame:
    """Store, origin, Date and the plan of the day for each of seven days; history wins over the plan; days without a row stay null."""
    days = requests.select("Store", "origin", F.explode(F.sequence(F.lit(0), F.lit(HORIZON - 1))).alias("k")).select("Store", "origin", F.expr("date_add(origin, k)").alias("Date"))
    known = history.select("Store", "Date", *DAY, F.lit(0).alias("rank")).unionByName(plan.select("Store", "Date", *DAY, F.lit(1).alias("rank")))
    best = Window.partitionBy("Store", "Date").orderBy("rank")
    known = known.withColumn("place", F.row_number().over(best)).filter("place = 1").drop("place", "rank")
    return days.join(known, ["Store", "Date"], "left")


def check_requests(requests: DataFrame, history: DataFrame, plan: DataFrame) -> DataFrame:
    """restaurant, origin and the first error that holds (null for a good request)."""
    spans = history.groupBy("Store").agg(F.min("Date").alias("first_day"), F.max("Date").alias("last_day"))
    rows = requests.select(F.col("restaurant").alias("Store"), "origin").distinct()
    open_before = rows.join(history.filter("Open = 1 and Customers > 0").select("Store", "Date"), "Store").filter(F.col("Date") <= F.date_sub("origin", HORIZON)).groupBy("Store", "origin").agg(F.count("*").alias("n_open"))
    week = week_plan(rows, history, plan).groupBy("Store", "origin").agg(
        F.count_if(F.col("Open").isNull()).alias("gone"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("Open").isNull(), F.date_format("Date", "yyyy-MM-dd")))), ",").alias("gone_days"),
        F.count_if(~F.col("Open").isin(0, 1) | ~F.col("Promo").isin(0, 1) | ~F.col("SchoolHoliday").isin(0, 1) | ~F.col("StateHoliday").isin("0", "a", "b", "c")).alias("wrong"),
    )
    all_ = rows.join(spans, "Store", "left").join(open_before, ["Store", "origin"], "left").join(week, ["Store", "origin"], "left")
    error = (
        F.when(F.col("Store") <= 0, "store number must be positive")
        .when(F.col("last_day").isNull(), "unknown store")
        .when(F.col("origin") <= F.col("first_day"), "date before the history")
        .when(F.col("origin") > F.date_add("last_day", 1), "date after the history")
        .when(F.col("gone") > 0, F.concat(F.lit("no plan for "), F.col("gone_days")))
        .when(F.col("wrong") > 0, "plan values out of range")
        .when(F.coalesce("n_open", F.lit(0)) < MIN_LEVEL_DAYS, "history too short")
    )
    return all_.select(F.col("Store").alias("restaurant"), "origin", error.alias("error"))


def good(checked: DataFrame) -> DataFrame:
    return checked.filter("error is null").select(F.col("restaurant").alias("Store"), "origin")


def request_calendars(requests: DataFrame, history: DataFrame, plan: DataFrame) -> DataFrame:
    """The calendar of each (Store, origin): own history before the origin, then the plan's seven days without guests. Windows are
    keyed by (Store, origin), so a request costs its store's history once."""
    past = requests.join(history, "Store").filter(F.col("Date") < F.col("origin")).select(*KEYS, "Date", "Sales", "Customers", *DAY)
    week = week_plan(requests, history, plan).select(*KEYS, "Date", F.lit(None).cast("bigint").alias("Sales"), F.lit(None).cast("int").alias("Customers"), *DAY)
    rows = past.unionByName(week)
    first = F.min("Date").over(Window.partitionBy(*KEYS))
    rows = rows.withColumn("__start", first)
    out = grid(rows, F.col("__start"), F.date_add("origin", HORIZON - 1), KEYS)
    return with_status(out.drop("__start"), keys=KEYS)


def request_features(requests: DataFrame, history: DataFrame, plan: DataFrame, stores: DataFrame) -> DataFrame:
    """Features of the seven days of each request, exact: built on the request's own calendar. Costs the store's history for each
    request; `overlay_features` gives the same rows for many."""
    rows = build_features(request_calendars(requests, history, plan), stores, KEYS)
    return rows.filter(F.col("Date") >= F.col("origin"))


def one_pass_features(requests: DataFrame, calendar: DataFrame, stores: DataFrame) -> DataFrame:
    """For large backtests: one feature table of the whole calendar serves every origin. It differs from the exact form where the
    calendar knows more than the request did: holidays after the week, closures that go on after it, anomalies inside it, and the
    grid's start. Days that the calendar does not hold stay, with known = false and no features."""
    rows = build_features(calendar, stores).withColumn("known", F.lit(True))
    days = requests.select("Store", "origin", F.explode(F.sequence(F.col("origin"), F.date_add("origin", HORIZON - 1))).alias("Date"))
    return days.join(rows, ["Store", "Date"], "left").withColumn("known", F.coalesce("known", F.lit(False)))


def overlay_features(requests: DataFrame, history: DataFrame, plan: DataFrame, stores: DataFrame) -> DataFrame:
    """The rows of `request_features` at the cost of stores x days + requests. Levels and lags of a day of the week lie a week back at
    least, before every origin, so one table over the history's calendar holds them for all requests. What a request sees otherwise than the
    calendar (its plan, holidays up to the week's end, closures cut there, no anomalies inside the week) is computed again on
    PAST_DAYS + 7 days of each request. Requests are distinct, as `good` leaves them; none give no rows."""
    last = requests.agg(F.max("origin")).first()[0]
    if last is None:
        return request_features(requests, history, plan, stores)
    calendar = restore_calendar(history.select("Store", "Date", "Sales", "Customers", *DAY, F.lit(True).alias("__row")), F.date_add(F.lit(last), HORIZON - 1))
    past = lag_features(level_features(calendar))
    own = [c for c in past.columns if c not in calendar.columns and c not in ("target", "__log")]
    ahead = plan.dropDuplicates(["Store", "Date"]).select("Store", "Date", *[F.col(c).alias(f"__{c}") for c in DAY])
    days = requests.select(*KEYS, F.explode(F.sequence(F.date_sub("origin", PAST_DAYS), F.date_add("origin", HORIZON - 1))).alias("Date"))
    rows = days.join(past.select("Store", "Date", "Customers", "Sales", *DAY, "__row", *own), ["Store", "Date"], "left").join(ahead, ["Store", "Date"], "left")
    week = F.col("Date") >= F.col("origin")
    planned = [F.when(week & F.col("__row").isNull(), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in DAY]  # the history wins over the plan
    spent = [F.when(~week, F.col(c)).alias(c) for c in ("Sales", "Customers")]
    rows = rows.select(*KEYS, "Date", (F.weekday("Date") + 1).alias("DayOfWeek"), *planned, *spent, *own, F.lit(None).cast("double").alias("target"))
    return with_store(event_features(with_status(rows, keys=KEYS), KEYS).filter(week), stores, KEYS)


def with_plan(history: DataFrame, plan: DataFrame) -> DataFrame:
    """The calendar of the history with the planned days behind it (without guests)."""
    ahead = plan.join(history.select("Store", "Date"), ["Store", "Date"], "left_anti").select("Store", "Date", F.lit(None).cast("bigint").alias("Sales"), F.lit(None).cast("int").alias("Customers"), *DAY)
    rows = history.select("Store", "Date", "Sales", "Customers", *DAY).unionByName(ahead)
    first, last = rows.agg(F.min("Date"), F.max("Date")).first()
    return with_status(grid(rows, F.lit(first), F.lit(last)))


def baseline_weeks(requests: DataFrame, history: DataFrame, plan: DataFrame) -> DataFrame:
    """Store, origin, Date, DayOfWeek, the plan of the day, baseline_lag_7 (0 when closed), actual. The last open same weekday before a day of the
    week lies a week back at least, so before the origin: one table of lags serves all requests."""
    spent = with_plan(history, plan)
    known = F.when((F.col("day_status") == "open") & F.col("Customers").isNotNull(), F.col("Customers").cast("double"))
    week = baselines.weekday_window().rowsBetween(-52, -1)
    # A store-only window first, so that the one exchange is by store.
    rows = spent.withColumn("first", F.min("Date").over(Window.partitionBy("Store"))).withColumn("lag_7", F.last(known, ignorenulls=True).over(week)).select("Store", "Date", "lag_7")
    days = week_plan(requests, history, plan).join(rows, ["Store", "Date"], "left")
    actual = history.select("Store", "Date", F.col("Customers").alias("actual"))
    lag = F.when(F.col("Open") == 0, 0.0).otherwise(F.col("lag_7"))
    return days.select(*KEYS, "Date", (F.weekday("Date") + 1).alias("DayOfWeek"), *DAY, lag.alias("baseline_lag_7")).join(actual, ["Store", "Date"], "left").select(*KEYS, "Date", "DayOfWeek", *DAY, "baseline_lag_7", "actual")


def forecast_weeks(requests: DataFrame, history: DataFrame, plan: DataFrame, stores: DataFrame, predict) -> DataFrame:
    """The forecast table of all good requests. predict: features -> (Store, origin, Date, forecast) of open days, an error if
    one has no level; closed days get 0."""
    weeks = baseline_weeks(requests, history, plan)
    feats = overlay_features(requests, history, plan, stores).filter("day_status = 'open'")
    pred = predict(feats).select(*KEYS, "Date", "forecast")
    return weeks.join(pred, [*KEYS, "Date"], "left").withColumn("forecast", F.when(F.col("Open") == 0, 0.0).otherwise(F.col("forecast")))


def week_metrics(weeks: DataFrame, columns=("forecast", "baseline_lag_7")) -> DataFrame:
    """Per request MAE, MAPE and WAPE of each column on open days, only where every open day has a positive actual."""
    rows = weeks.filter("Open = 1")
    y = F.col("actual").cast("double")
    out: list[Column] = []
    for c in columns:
        e = F.abs(F.col(c) - y)
        out += [F.avg(e).alias(f"{c}_mae"), (F.avg(F.try_divide(e, y)) * 100).alias(f"{c}_mape"), (F.try_divide(F.sum(e), F.sum(y)) * 100).alias(f"{c}_wape")]
    full = rows.groupBy(*KEYS).agg(F.count("*").alias("days"), F.count_if(y > 0).alias("known"), *out)
    return full.filter("days = known").drop("known")
