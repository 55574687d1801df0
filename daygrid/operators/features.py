"""Leak-free features of a restored calendar: history up to t-7, or the known plan of day t. On the full grid a lag of k rows is k days.

Windows are keyed by store (or by a finer key that contains it), so all of them share the calendar's exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import easter, iso_monday, month_start
from .calendar import by

LEVEL_DAYS, MIN_LEVEL_DAYS, LEVEL_AGE_CAP = 24, 12, 28
HORIZON, HOLIDAY_WINDOW, REOPEN_DAYS = 7, 3, 13
LAG_WEEKS = (1, 2, 3, 4)
NO_EVENT = "none"
SEGMENTS = {"b": "high_traffic", "a": "mid", "c": "mid", "d": "high_check"}
LAGS = [f"lag_{7 * w}" for w in LAG_WEEKS]
BASE_NUMERIC = ["Promo", "level_age", "lag_filled", "lag_filled_weeks", "lag_median", "rel_364", *LAGS, *(f"promo_{x}" for x in LAGS)]
BASE_CATEGORICAL = ["DayOfWeek", "month", "segment", "next_holiday", "prev_holiday", "easter_day", "christmas_day", "carnival_day", "days_since_reopen", "days_to_long_closure"]
NUMERIC = [*BASE_NUMERIC, "day_of_month", "SchoolHoliday", "competition_open", "competition_distance_log", "promo2_active"]
CATEGORICAL = [*BASE_CATEGORICAL, "Assortment", "store_id"]
FEATURES = NUMERIC + CATEGORICAL
#: What models take unless told otherwise: all but promo2_active.
MODEL_NUMERIC = [c for c in NUMERIC if c != "promo2_active"]
EVENTS = ("next_holiday", "prev_holiday", "easter_day", "christmas_day", "carnival_day", "days_since_reopen", "days_to_long_closure")


def level_features(calendar: DataFrame, keys=("Store",)) -> DataFrame:
    """level: mean log of customers over the last 24 open days up to t-7 (12 at least), carried over gaps; level_age: days since the
    last of them, 28 at most; target: log customers of an open day less its level."""
    w = by(keys)
    is_open = F.col("day_status") == "open"
    rows = calendar.withColumn("__open", is_open).withColumn("__log", F.when(is_open, F.ln("Customers")))
    rows = rows.withColumn("__last_open", F.last(F.when(is_open, F.col("Date")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -HORIZON)))
    recent = Window.partitionBy(*keys, "__open").orderBy("Date").rowsBetween(1 - LEVEL_DAYS, 0)
    own = F.when(is_open & (F.count("__log").over(recent) >= MIN_LEVEL_DAYS), F.avg("__log").over(recent))
    rows = rows.withColumn("__own", own).withColumn("__late", F.lag("__own", HORIZON).over(w))
    rows = rows.withColumn("level", F.last("__late", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    age = F.datediff("Date", "__last_open")
    rows = rows.withColumn("level_age", F.when(age > LEVEL_AGE_CAP, LEVEL_AGE_CAP).otherwise(age).cast("double"))
    return rows.withColumn("target", F.col("__log") - F.col("level")).drop("__open", "__own", "__late", "__last_open")


def lag_features(rows: DataFrame, keys=("Store",)) -> DataFrame:
    """Same weekday one to four weeks back, less the level of day t; the first and the median of those known; 52 weeks back."""
    w = by(keys)
    lags = [(F.lag("__log", 7 * k).over(w) - F.col("level")).alias(f"lag_{7 * k}") for k in LAG_WEEKS]
    promo = [F.lag(F.col("Promo").cast("double"), 7 * k).over(w).alias(f"promo_lag_{7 * k}") for k in LAG_WEEKS]
    rows = rows.select("*", *lags, *promo, F.lag("target", 364).over(w).alias("rel_364"))
    names = [f"lag_{7 * k}" for k in LAG_WEEKS]
    weeks = F.coalesce(*[F.when(F.col(n).isNotNull(), F.lit(float(k))) for k, n in zip(LAG_WEEKS, names, strict=True)])
    known = F.array_sort(F.filter(F.array(*names), lambda x: x.isNotNull()))
    half = F.floor((F.size(known) - 1) / 2).cast("int")
    median = F.when(F.size(known) > 0, (F.get(known, half) + F.get(known, F.size(known) - 1 - half)) / 2)
    return rows.withColumn("lag_filled", F.coalesce(*names)).withColumn("lag_filled_weeks", weeks).withColumn("lag_median", median)


def event_features(rows: DataFrame, keys=("Store",), no_event: str = NO_EVENT) -> DataFrame:
    """Holidays around (nearest, within three days), Easter, carnival and Christmas days, days since a reopening (0 is the first day after the
    last day away, 13 the last) and to a long closure, all as labels."""
    w = by(keys)
    holiday = F.when(F.coalesce(F.col("StateHoliday"), F.lit("0")) != "0", F.struct("Date", F.col("StateHoliday").alias("kind")))
    rows = rows.withColumn("__holiday", holiday).select(
        "*",
        F.first("__holiday", ignorenulls=True).over(w.rowsBetween(0, HOLIDAY_WINDOW)).alias("__next"),
        F.last("__holiday", ignorenulls=True).over(w.rowsBetween(-HOLIDAY_WINDOW, -1)).alias("__prev"),
        F.last(F.when(F.col("day_status").isin("absent", "anomaly"), F.col("Date")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("__away"),
        F.first(F.when(F.col("day_status") == "absent", F.col("Date")), ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("__leaves"),
        F.datediff("Date", easter(F.year("Date"))).alias("__easter"),
    )
    between = lambda x, a, b: F.when(x.between(a, b), x)
    text = lambda x: F.coalesce(x.cast("string"), F.lit(no_event))
    named = lambda c, days: F.when(F.col(c).isNull(), no_event).otherwise(F.concat(F.col(f"{c}.kind"), F.lit("_"), days.cast("string")))
    md = F.date_format("Date", "MM-dd")
    return rows.select(
        "*",
        named("__next", F.datediff(F.col("__next.Date"), F.col("Date"))).alias("next_holiday"),
        named("__prev", F.datediff(F.col("Date"), F.col("__prev.Date"))).alias("prev_holiday"),
        text(between(F.col("__easter"), -7, 1)).alias("easter_day"),
        text(between(F.col("__easter") + 48, -4, 1)).alias("carnival_day"),
        F.when((md >= "12-01") | (md <= "01-06"), md).otherwise(no_event).alias("christmas_day"),
        text(between(F.datediff("Date", "__away") - 1, 0, REOPEN_DAYS)).alias("days_since_reopen"),
        text(between(F.datediff("__leaves", "Date"), 1, 7)).alias("days_to_long_closure"),
        F.month("Date").alias("month"),
        F.dayofmonth("Date").cast("double").alias("day_of_month"),
    ).drop("__holiday", "__next", "__prev", "__away", "__leaves", "__easter")


def store_features(rows: DataFrame, stores: DataFrame) -> DataFrame:
    """Segment, assortment, store id, competitor and second promotion as of the day. Stores without a dimension row are an error."""
    lost = rows.select("Store").distinct().join(stores, "Store", "left_anti").orderBy("Store").limit(5).collect()
    if lost:
        raise ValueError(f"stores without a dimension row: {[r[0] for r in lost]}")
    dim = stores.select(
        "Store", F.coalesce(*[F.when(F.col("StoreType") == k, v) for k, v in SEGMENTS.items()]).alias("segment"), "Assortment", "CompetitionDistance",
        month_start(F.col("CompetitionOpenSinceYear"), F.col("CompetitionOpenSinceMonth")).alias("__since"),
        F.when((F.col("Promo2") == 1) & F.col("Promo2SinceYear").isNotNull() & F.col("Promo2SinceWeek").isNotNull(), iso_monday(F.col("Promo2SinceYear"), F.col("Promo2SinceWeek"))).alias("__promo2"),
    )
    rows = rows.join(dim, "Store")  # one small row per store; Spark broadcasts it by its size
    opened = F.col("CompetitionDistance").isNotNull() & (F.col("__since").isNull() | (F.col("Date") >= F.col("__since")))
    return rows.select(
        "*",
        F.col("Store").cast("string").alias("store_id"),
        opened.cast("double").alias("competition_open"),
        F.when(opened, F.ln("CompetitionDistance")).alias("competition_distance_log"),
        F.coalesce((F.col("Date") >= F.col("__promo2")).cast("double"), F.lit(0.0)).alias("promo2_active"),
    ).drop("__since", "__promo2", "CompetitionDistance")


def build_features(calendar: DataFrame, stores: DataFrame, keys=("Store",), no_event: str = NO_EVENT) -> DataFrame:
    return with_store(event_features(lag_features(level_features(calendar, keys), keys), keys, no_event), stores, keys)


def with_store(rows: DataFrame, stores: DataFrame, keys=("Store",)) -> DataFrame:
    """Rows that have all other features get those of their store: the table that models take."""
    rows = store_features(rows, stores)
    extra = [k for k in keys if k != "Store"]
    return rows.select("Store", *extra, "Date", "DayOfWeek", *[F.col(c).cast("double").alias(c) for c in ("Promo", "SchoolHoliday")], "day_status", "level", "target", *[c for c in FEATURES if c not in ("Promo", "SchoolHoliday", "DayOfWeek")])


def category_levels(stores: DataFrame, no_event: str = NO_EVENT) -> dict[str, list[str]]:
    """Allowed values of each categorical feature, sorted. Only the stores' numbers are read; one row per store."""
    found = stores.agg(F.sort_array(F.collect_set("Store"))).first()[0]
    days = lambda a, b: [str(d) for d in range(a, b + 1)]
    xmas = [f"12-{d:02d}" for d in range(1, 32)] + [f"01-{d:02d}" for d in range(1, 7)]
    around = lambda first: [f"{k}_{d}" for k in "abc" for d in range(first, HOLIDAY_WINDOW + 1)]
    out = {"DayOfWeek": days(1, 7), "next_holiday": around(0) + [no_event], "prev_holiday": around(1) + [no_event], "easter_day": days(-7, 1) + [no_event], "carnival_day": days(-4, 1) + [no_event], "christmas_day": xmas + [no_event], "segment": list(set(SEGMENTS.values())), "days_since_reopen": days(0, 13) + [no_event], "days_to_long_closure": days(1, 7) + [no_event], "month": days(1, 12), "Assortment": list("abc"), "store_id": [str(s) for s in found]}
    return {k: sorted(v) for k, v in out.items()}


def unknown_levels(features: DataFrame, levels: dict[str, list[str]]) -> DataFrame:
    """feature, value, rows of values outside the lists; null is allowed."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in levels]))
    known = F.create_map(*[x for c, v in levels.items() for x in (F.lit(c), F.array(*map(F.lit, v)))])
    rows = features.select(pairs.alias("p")).select("p.*").filter("value is not null").groupBy("feature", "value").agg(F.count("*").alias("rows"))
    return rows.filter(~F.array_contains(F.element_at(known, F.col("feature")), F.col("value")))


def check_levels(features: DataFrame, levels: dict[str, list[str]]) -> DataFrame:
    bad = unknown_levels(features, levels).orderBy("feature", "value").limit(5).collect()
    if bad:
        raise ValueError("values outside the lists: " + ", ".join(f"{r['feature']}={r['value']}" for r in bad))
    return features


def check_features(features: DataFrame, numeric=tuple(MODEL_NUMERIC), categorical=tuple(CATEGORICAL)) -> DataFrame:
    """The frame, or an error for features that lack, are not numeric or hold infinity. Nulls are allowed."""
    kinds = dict(features.dtypes)
    lack = [n for n in (*numeric, *categorical) if n not in kinds]
    if lack:
        raise ValueError(f"features absent: {lack}")
    wrong = [n for n in numeric if kinds[n] not in ("double", "float", "int", "bigint")]
    if wrong:
        raise ValueError(f"features not numeric: {wrong}")
    bad = [r["feature"] for r in infinite_values(features, numeric).filter("rows > 0").orderBy("feature").collect()] if numeric else []
    if bad:
        raise ValueError(f"infinite values: {bad}")
    return features


def infinite_values(features: DataFrame, numeric=tuple(NUMERIC)) -> DataFrame:
    """feature, rows with infinity."""
    row = features.agg(*[F.count_if(F.abs(F.col(n)) == float("inf")).alias(n) for n in numeric])
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("rows")) for n in numeric])).alias("p")).select("p.*")


def open_before(rows: DataFrame, before) -> DataFrame:
    return rows.filter((F.col("day_status") == "open") & (F.col("Date") < F.lit(before).cast("date")))


def coverage(features: DataFrame, before, names=(*NUMERIC, "target")) -> DataFrame:
    """On open days before a date: per feature the share of nulls in % and the number of stores with a null."""
    pairs = open_before(features, before).select("Store", F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).isNull().alias("gone")) for n in names])).alias("p")).select("Store", "p.*")
    return pairs.groupBy("feature").agg((F.avg(F.col("gone").cast("int")) * 100).alias("null_pct"), F.count_distinct(F.when(F.col("gone"), F.col("Store"))).alias("stores"))


def level_ages(calendar: DataFrame, keys=("Store",)) -> DataFrame:
    """Days since the last open day up to t-7, without the cap that level_age has."""
    last = F.last(F.when(F.col("day_status") == "open", F.col("Date")), ignorenulls=True).over(by(keys).rowsBetween(Window.unboundedPreceding, -HORIZON))
    return calendar.select(*keys, "Date", "day_status", F.datediff("Date", last).alias("age"))


def level_age_bins(calendar: DataFrame, before) -> DataFrame:
    """Open days before a date by how old their level is."""
    age = F.col("age")
    bin_ = F.when(age.isNull(), "none").when(age <= 7, "7").when(age <= 14, "8-14").when(age <= 28, "15-28").when(age <= 60, "29-60").otherwise("over 60")
    return open_before(level_ages(calendar), before).groupBy(bin_.alias("bin")).agg(F.count("*").alias("days"))


def old_levels(calendar: DataFrame, before, over: int = 60) -> DataFrame:
    """Stores with open days whose level is older than that: days, their span and the ages."""
    rows = open_before(level_ages(calendar), before).filter(F.col("age") > over)
    return rows.groupBy("Store").agg(F.count("*").alias("days"), F.min("Date").alias("first_day"), F.max("Date").alias("last_day"), F.min("age").alias("least"), F.max("age").alias("most"))


def event_shares(features: DataFrame, before, no_event: str = NO_EVENT) -> DataFrame:
    """Share of open days before a date that lie in each event's window."""
    row = open_before(features, before).agg(*[F.avg((F.col(c) != no_event).cast("int")).alias(c) for c in EVENTS])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("event"), F.col(c).alias("share")) for c in EVENTS])).alias("p")).select("p.*")


def leak_audit(calendar: DataFrame, stores: DataFrame, origins, build=build_features) -> DataFrame:
    """Per origin: wipe the guests from it on, rebuild, and count per feature the rows of the seven days from it that differ (must be 0),
    and the later rows whose lag_7 differs (must not be 0, or the audit sees nothing)."""
    names = [*NUMERIC, "level"]
    whole, out = build(calendar, stores), None
    for origin in origins:
        day = F.lit(origin).cast("date")
        wiped = build(calendar.withColumn("Customers", F.when(F.col("Date") < day, F.col("Customers"))), stores)
        rows = whole.alias("a").join(wiped.alias("b"), ["Store", "Date"]).filter(F.col("Date") >= day)
        week = F.col("Date") <= F.date_add(day, HORIZON - 1)
        other = lambda n: ~F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}"))
        counts = rows.agg(F.count_if(week).alias("n_rows"), *[F.count_if(week & other(n)).alias(n) for n in names], F.count_if(~week & other("lag_7")).alias("later_lag_7"))
        counts = counts.select(day.alias("origin"), "*")
        out = counts if out is None else out.unionByName(counts)
    return out
