"""Registered queries of the panel operators over the derived fixture, each with its DuckDB text. Doubles are rounded to 6 digits."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, baselines, features, sampling, scoring
from ..operators import calendar as cal
from ..sources import panel
from . import fixture
from .oracle import cte, text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    return df.select([F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


class Panel:
    """The fixture's tables of one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.folder = f"{panel.work_folder(spark)}/panel-{uuid.uuid4().hex}"
        self.history = fixture.history(spark, sf_dir)

    @property
    def stores(self) -> DataFrame:
        return fixture.stores(self.spark, self.history)

    @property
    def plan(self) -> DataFrame:
        return fixture.plan(self.spark, self.history)

    @property
    def requests(self) -> DataFrame:
        return fixture.requests(self.spark, self.history)

    @property
    def calendar(self) -> DataFrame:
        return cal.restore_calendar(self.history, fixture.END)

    @property
    def features(self) -> DataFrame:
        return features.build_features(self.calendar, self.stores)

    def predicted(self, *periods) -> DataFrame:
        return baselines.baseline_predictions(baselines.with_baselines(self.calendar), baselines.folds(self.spark, periods))

    @property
    def pred(self) -> DataFrame:
        """Baselines on the three validation folds, by which models are chosen."""
        return self.predicted(*baselines.FOLDS)

    @property
    def held(self) -> DataFrame:
        """Baselines on the holdout, which chooses nothing."""
        return self.predicted(baselines.HOLDOUT)

    @property
    def profile(self) -> DataFrame:
        return audit.profile(self.history, self.stores)

    @property
    def pool(self) -> DataFrame:
        return sampling.eligible(self.profile)


def query(sql: str | None = None, *needs: str):
    def add(f: Callable[[Panel], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(Panel(spark, sf_dir)))
        if sql is not None:
            SQL[f.__name__] = text(sql, *needs)
        return f

    return add


FLAG_COLUMNS = ("has_export_gap", "has_long_closure", "competitor_opened_in_train", "has_left_censored", "has_anomaly")

# Sources and checks


@query("select s.Store, s.StoreType, s.Assortment, case when s.Store % 2 = 0 then 'even' end as reason from stores s", "stores")
def stores_with_selection(p: Panel) -> DataFrame:
    chosen = p.stores.filter("Store % 2 = 0").select("Store", "StoreType", F.lit("even").alias("reason"))
    return panel.with_selection(p.stores, chosen).select("Store", "StoreType", "Assortment", "reason")


@query("select * from history", "history")
def loaded_history(p: Panel) -> DataFrame:
    """The history written as a table and loaded back, checked."""
    path = f"{p.folder}/history"
    p.history.select(panel.HISTORY.names).write.parquet(path)
    return panel.load_history(p.spark, path)


@query("select 'history' as name, 'missing columns' as problem, 'Weather' as detail union all select 'plan', 'rows', count(*)::varchar || ', 5 expected' from plan union all select 'weather', 'absent', ''", "plan")
def raw_problems(p: Panel) -> DataFrame:
    return panel.raw_problems({"history": p.history, "stores": p.stores, "plan": p.plan}, {"history": ([*panel.HISTORY.names, "Weather"], None), "stores": (["Store"], None), "plan": (panel.PLAN.names, 5), "weather": (["Date"], None)})


@query(
    """select rule, cast(n as bigint) as count from (select
 count(*) filter (Date is null) as null_date, count(*) filter (DayOfWeek <> isodow(Date)) as day_of_week, count(*) filter (Open not in (0, 1) or Open is null) as Open,
 count(*) filter (Promo not in (0, 1) or Promo is null) as Promo, count(*) filter (SchoolHoliday not in (0, 1) or SchoolHoliday is null) as SchoolHoliday,
 count(*) filter (StateHoliday not in ('0', 'a', 'b', 'c') or StateHoliday is null) as StateHoliday, count(*) filter (Sales < 0 or Sales is null) as Sales, count(*) filter (Customers < 0 or Customers is null) as Customers,
 count(*) - count(distinct (Store, Date)) as duplicate
 from (select Store, DayOfWeek, Date, Sales, case when Store % 5 = 0 then -1 else Customers end as Customers, case when Store % 7 = 0 then 2 else Open end as Open, Promo, StateHoliday, SchoolHoliday from history union all select Store, DayOfWeek, Date, Sales, Customers, Open, Promo, 'x', SchoolHoliday from history where Date = date '2014-02-03'))
 unpivot (n for rule in (null_date, day_of_week, Open, Promo, SchoolHoliday, StateHoliday, Sales, Customers, duplicate))""",
    "history",
)
def history_violations(p: Panel) -> DataFrame:
    """Rule violations of a history with planted faults."""
    bad = p.history.withColumn("Customers", F.when(F.col("Store") % 5 == 0, -1).otherwise(F.col("Customers"))).withColumn("Open", F.when(F.col("Store") % 7 == 0, 2).otherwise(F.col("Open")))
    return panel.violations(bad.unionByName(p.history.filter("Date = '2014-02-03'").withColumn("StateHoliday", F.lit("x"))))


@query("select Store, DayOfWeek, Date, Open, Promo, StateHoliday, SchoolHoliday from plan where Store % 2 = 1", "plan")
def plan_of_selected(p: Panel) -> DataFrame:
    chosen = p.stores.filter("Store % 2 = 1")
    return panel.only_selected(panel.validate(p.plan, panel.PLAN.names, "plan", allow_missing_open=True), chosen).select(panel.PLAN.names)


@query(
    """select 'a' as run, fold, mape, cast(null as double) as mae from all_scores where model = 'lag_7' union all select 'b', fold, null, mae from all_scores where model = 'lag_14'""",
    "all_scores",
)
def run_log(p: Panel) -> DataFrame:
    """Two runs with other fields in one log."""
    s = scoring.fold_scores(p.pred)
    a = s.filter("model = 'lag_7'").select(F.lit("a").alias("run"), "fold", "mape")
    b = s.filter("model = 'lag_14'").select(F.lit("b").alias("run"), "fold", "mae")
    return panel.with_records(a, b)


SQL["run_log"] = SQL["run_log"].replace("fold, mape,", "fold, round(mape, 6) as mape,").replace("null, mae", "null, round(mae, 6)")


@query(
    """select Store, strftime(Date, '%d.%m.%Y') as date, dayname(Date) as day, case when Open = 1 then 'yes' else 'no' end as open, case when Promo = 1 then 'yes' else 'no' end as promo,
 cast(round(median_7_28) as integer) as forecast, cast(round(lag_7) as integer) as baseline_lag_7, cast(Customers as integer) as actual from based where Date between date '2015-07-11' and date '2015-07-17'""",
    "based",
)
def forecast_display(p: Panel) -> DataFrame:
    rows = baselines.with_baselines(p.calendar).filter("Date between '2015-07-11' and '2015-07-17'")
    return panel.forecast_display(rows.select("Store", "Date", "Open", "Promo", F.col("median_7_28").alias("forecast"), F.col("lag_7").alias("baseline_lag_7"), F.col("Customers").alias("actual")))


# Calendar


@query("select Store, Date, DayOfWeek, Sales, Customers, Open, Promo, StateHoliday, SchoolHoliday, closure_run_days, day_status, customers_clean, sales_clean from calendar", "calendar")
def restored_calendar(p: Panel) -> DataFrame:
    return p.calendar


@query("select Store, Date, Customers from calendar where day_status = 'open' and Date between date '2015-06-20' and date '2015-07-31'", "calendar")
def open_days_of_period(p: Panel) -> DataFrame:
    return cal.period_days(p.calendar, "2015-06-20", "2015-07-31").select("Store", "Date", "Customers")


@query("select day_status, count(*) as days from calendar group by 1", "calendar")
def status_counts(p: Panel) -> DataFrame:
    return p.calendar.groupBy("day_status").agg(F.count("*").alias("days"))


@query("select * from runs", "runs")
def closure_run_flags(p: Panel) -> DataFrame:
    return cal.flag_runs(cal.closure_runs(p.history), p.history)


@query("select least(days, 31) as days, count(*) as runs from raw_runs group by 1", "raw_runs")
def closure_run_lengths(p: Panel) -> DataFrame:
    return cal.run_lengths(cal.closure_runs(p.history))


@query("select * from per_store_long", "per_store_long")
def long_closures_per_store(p: Panel) -> DataFrame:
    return cal.long_closures_per_store(cal.closure_runs(p.history), p.stores)


@query("select case when n_long_closures >= 2 then '2+' else n_long_closures::varchar end as closures, count(*) as stores, round(count(*) / sum(count(*)) over (), 6) as share from per_store_long group by 1", "per_store_long")
def long_closure_buckets(p: Panel) -> DataFrame:
    return cal.long_closure_buckets(cal.long_closures_per_store(cal.closure_runs(p.history), p.stores))


@query("select StoreType, round(avg(case when n_long_closures > 0 then 1 else 0 end), 6) as share from per_store_long group by 1", "per_store_long")
def long_closure_share_by_type(p: Panel) -> DataFrame:
    return cal.long_closure_share(cal.long_closures_per_store(cal.closure_runs(p.history), p.stores))


@query("""select Store, kind, start, "end", days from gaps""", "gaps")
def export_gaps(p: Panel) -> DataFrame:
    return cal.export_gaps(p.history)


@query("""select start, "end", days, count(*) as stores from gaps group by 1, 2, 3""", "gaps")
def export_gap_groups(p: Panel) -> DataFrame:
    return cal.gap_groups(cal.export_gaps(p.history))


@query(
    """select h.Date, round(avg(case when h.Store in (select Store from gaps where days > 1) then Open end), 6) as with_gap, round(avg(case when h.Store not in (select Store from gaps where days > 1) then Open end), 6) as without_gap
 from history h, (select start as s, "end" as e from gaps order by days desc, start, Store limit 1) t where h.Date in (s - 3, s - 2, s - 1, e + 1, e + 2, e + 3) group by h.Date""",
    "gaps",
)
def export_gap_border(p: Panel) -> DataFrame:
    return cal.gap_border(p.history, cal.export_gaps(p.history))


@query("""select Store, start, "end", days, has_holiday, dayname(start) as start_day, dayname("end") as end_day from raw_runs where days between 3 and 6""", "raw_runs")
def short_long_closures(p: Panel) -> DataFrame:
    return cal.short_long_closures(cal.closure_runs(p.history))


# Audit and profile


@query("select days, count(*) as stores from (select Store, count(*) as days from history group by 1) group by 1", "history")
def rows_per_store(p: Panel) -> DataFrame:
    return audit.days_per_store(p.history)


@query(
    """select n as stores, count(*) as days, (select count(*) from history) as n_rows, count(*) filter (s = n) as full_days, count(*) filter (s < n) as partial_days, min(s) as fewest,
 n * count(*) - (select count(*) from (select distinct Store, Date from history)) as missing_pairs, (select count(*) from history) - (select count(*) from (select distinct Store, Date from history)) as duplicates,
 (select count(*) filter (DayOfWeek <> isodow(Date)) from history) as wrong_weekday
 from (select Date, count(distinct Store) as s from history group by 1) cross join (select count(distinct Store) as n from history) group by n""",
    "history",
)
def panel_coverage(p: Panel) -> DataFrame:
    return audit.coverage(p.history)


@query("select StateHoliday, count(*) as days, round(avg(SchoolHoliday), 6) as school_share from history where Date > (select max(Date) - 42 from history) group by 1", "history")
def holdout_design(p: Panel) -> DataFrame:
    return audit.holdout_design(p.history)


@query(
    """select * from (select c as "column", count(*) filter (v is null) as nulls, round(count(*) filter (v is null) / count(*), 6) as share from
 (select unnest(['CompetitionDistance', 'CompetitionOpenSinceMonth', 'CompetitionOpenSinceYear', 'Promo2SinceWeek', 'Promo2SinceYear', 'PromoInterval']) as c,
  unnest([CompetitionDistance::varchar, CompetitionOpenSinceMonth::varchar, CompetitionOpenSinceYear::varchar, Promo2SinceWeek::varchar, Promo2SinceYear::varchar, PromoInterval]) as v from stores) group by 1) where nulls > 0""",
    "stores",
)
def null_report(p: Panel) -> DataFrame:
    return audit.null_report(p.stores)


@query(
    """select bool_and((Promo2SinceWeek is null and Promo2SinceYear is null and PromoInterval is null) = (Promo2 = 0)) as promo2_iff,
 count(*) filter ((Promo2SinceWeek is null or Promo2SinceYear is null or PromoInterval is null) and not (Promo2SinceWeek is null and Promo2SinceYear is null and PromoInterval is null)) as promo2_partly,
 bool_and((CompetitionOpenSinceMonth is null) = (CompetitionOpenSinceYear is null)) as date_together, count(*) filter (CompetitionDistance is null) as no_distance,
 count(*) filter (CompetitionDistance is not null and CompetitionOpenSinceMonth is null) as distance_no_date, count(*) filter (CompetitionDistance is null and CompetitionOpenSinceMonth is not null) as date_no_distance from stores""",
    "stores",
)
def structural_nulls(p: Panel) -> DataFrame:
    return audit.structural_nulls(p.stores)


@query("select case when grouping(StoreType) = 1 then 'all' else StoreType end as StoreType, case when grouping(Assortment) = 1 then 'all' else Assortment end as Assortment, count(*) as n from stores group by cube (StoreType, Assortment)", "stores")
def type_by_assortment(p: Panel) -> DataFrame:
    return audit.cross_tab(p.stores, "StoreType", "Assortment")


@query(
    """select c as "column", count(x) as n, round(avg(x), 6) as mean, round(stddev_samp(x), 6) as std, min(x) as min, round(quantile_cont(x, 0.05), 6) as p05, round(quantile_cont(x, 0.25), 6) as p25, round(quantile_cont(x, 0.5), 6) as p50,
 round(quantile_cont(x, 0.75), 6) as p75, round(quantile_cont(x, 0.95), 6) as p95, max(x) as max from (select unnest(['Sales', 'Customers']) as c, unnest([Sales::double, Customers::double]) as x from history) group by 1""",
    "history",
)
def describe_history(p: Panel) -> DataFrame:
    return audit.describe(p.history, ["Sales", "Customers"])


@query("select year(since) as year, count(*) as openings from dim where since is not null group by 1", "dim")
def competitor_openings_by_year(p: Panel) -> DataFrame:
    return audit.openings_by_year(p.stores)


@query("select m::date as month, coalesce(n, 0) as openings from (select unnest(generate_series(date '2010-01-01', date '2015-07-01', interval 1 month)) as m) left join (select since, count(*) as n from dim group by 1) on since = m", "dim")
def competitor_openings_by_month(p: Panel) -> DataFrame:
    return audit.openings_by_month(p.stores)


@query("select case when since is null then 'unknown' when since <= date '2013-01-01' then 'before' when since <= date '2015-06-19' then 'in_train' else 'after_train' end as opening, count(*) as stores from dim group by 1", "dim")
def competitor_windows(p: Panel) -> DataFrame:
    return audit.competitor_windows(p.stores)


@query("select PromoInterval as value, count(*) as n from stores group by 1", "stores")
def promo_interval_counts(p: Panel) -> DataFrame:
    return audit.value_counts(p.stores, "PromoInterval")


@query("select cast(floor(log10(CompetitionDistance) * 10) as integer) as bin, count(*) as stores from stores where CompetitionDistance > 0 group by 1", "stores")
def distance_bins(p: Panel) -> DataFrame:
    return audit.distance_bins(p.stores)


# Features


@query(
    """select Store, Date, DayOfWeek, Promo, SchoolHoliday, day_status, round(level, 6) as level, round(target, 6) as target, level_age, round(lag_7, 6) as lag_7, round(lag_14, 6) as lag_14, round(lag_21, 6) as lag_21, round(lag_28, 6) as lag_28,
 promo_lag_7, promo_lag_14, promo_lag_21, promo_lag_28, round(lag_filled, 6) as lag_filled, lag_filled_weeks, round(lag_median, 6) as lag_median, round(rel_364, 6) as rel_364, month, day_of_month, next_holiday, prev_holiday,
 easter_day, carnival_day, christmas_day, days_since_reopen, days_to_long_closure, segment, Assortment, store_id, competition_open, round(competition_distance_log, 6) as competition_distance_log, promo2_active from features""",
    "features",
)
def feature_table(p: Panel) -> DataFrame:
    return p.features


@query(
    f"""select feature, round(avg(case when v is null then 1 else 0 end) * 100, 6) as null_pct, count(distinct case when v is null then Store end) as stores from (
 select Store, unnest({[*features.NUMERIC, 'target']}) as feature, unnest([{', '.join(f'{c}::double' for c in (*features.NUMERIC, 'target'))}]) as v
 from features where day_status = 'open' and Date < date '2015-06-20') group by 1""",
    "features",
)
def feature_coverage(p: Panel) -> DataFrame:
    return features.coverage(p.features, "2015-06-20")


cte("ages", ("leveled",), "select Store, Date, Date - last_open as age from leveled where day_status = 'open' and Date < date '2015-06-20'")


@query("select case when age is null then 'none' when age <= 7 then '7' when age <= 14 then '8-14' when age <= 28 then '15-28' when age <= 60 then '29-60' else 'over 60' end as bin, count(*) as days from ages group by 1", "ages")
def level_age_bins(p: Panel) -> DataFrame:
    return features.level_age_bins(p.calendar, "2015-06-20")


@query("select Store, count(*) as days, min(Date) as first_day, max(Date) as last_day, cast(min(age) as integer) as least, cast(max(age) as integer) as most from ages where age > 60 group by 1", "ages")
def old_levels(p: Panel) -> DataFrame:
    return features.old_levels(p.calendar, "2015-06-20")


@query(
    " union all ".join(f"select '{c}' as event, round(count(*) filter ({c} <> 'none') / count(*), 6) as share from features where day_status = 'open' and Date < date '2015-06-20'" for c in features.EVENTS),
    "features",
)
def event_shares(p: Panel) -> DataFrame:
    return features.event_shares(p.features, "2015-06-20")


@query("select 'christmas_day' as feature, strftime(Date, '%m-%d') || '!' as value, count(*) as rows from features where christmas_day <> 'none' and Store % 5 = 0 group by 2 union all select 'Assortment', 'x', count(*) from features where Store = 2", "features")
def unknown_levels(p: Panel) -> DataFrame:
    """Values outside the lists, of a table with planted ones."""
    planted = p.features.withColumn("christmas_day", F.when((F.col("christmas_day") != "none") & (F.col("Store") % 5 == 0), F.concat("christmas_day", F.lit("!"))).otherwise(F.col("christmas_day")))
    return features.unknown_levels(planted.withColumn("Assortment", F.when(F.col("Store") == 2, "x").otherwise(F.col("Assortment"))), features.category_levels(p.stores))


@query(" union all ".join(f"select '{c}' as feature, " + ("count(*) filter (lag_7 is not null and Store % 3 = 0)" if c == "lag_7" else "count(*) filter (false)") + " as rows from features" for c in features.NUMERIC), "features")
def infinite_features(p: Panel) -> DataFrame:
    """Infinite values by feature, of a table with planted ones."""
    return features.infinite_values(p.features.withColumn("lag_7", F.when(F.col("lag_7").isNotNull() & (F.col("Store") % 3 == 0), float("inf")).otherwise(F.col("lag_7"))))


ORIGINS = ("2014-12-06", "2015-03-28", "2015-05-09", "2015-06-20")


@query(
    " union all ".join(
        f"select date '{o}' as origin, count(*) filter (Date <= date '{o}' + 6) as n_rows, {', '.join(f'0 as {c}' for c in (*features.NUMERIC, 'level'))}, count(*) filter (Date > date '{o}' + 6 and lag_7 is not null) as later_lag_7 from features where Date >= date '{o}'"
        for o in ORIGINS
    ),
    "features",
)
def leak_audit(p: Panel) -> DataFrame:
    """No feature of a week changes when its guests are wiped; every later lag_7 loses its source."""
    return features.leak_audit(p.calendar.persist(), p.stores, ORIGINS)


@query("select Store, Date, round(target, 6) as target from features where Date < date '2015-06-20' and target is not null", "features")
def training_rows(p: Panel) -> DataFrame:
    return scoring.training_rows(p.features, "2015-06-20").select("Store", "Date", "target")


# Baselines and scores


@query("select model, fold, round(mae, 6) as mae, round(mape, 6) as mape, round(wape, 6) as wape from all_scores", "all_scores")
def baseline_scores_by_fold(p: Panel) -> DataFrame:
    """Calendar, baselines and their scores on the three folds, with the mean over them."""
    return scoring.fold_scores(p.pred)


@query("select model, round(avg(abs(pred - y)), 6) as mae, round(avg(abs(pred - y) / y) * 100, 6) as mape, round(sum(abs(pred - y)) / sum(y) * 100, 6) as wape from pred where fold = 'holdout' group by 1", "pred")
def holdout_baseline_scores(p: Panel) -> DataFrame:
    """The baselines on the holdout, apart from the folds."""
    return scoring.metrics(p.held, "model")


@query("select Store, Date, fold, model, y, round(pred, 6) as pred from pred", "pred")
def baseline_predictions(p: Panel) -> DataFrame:
    return p.pred.unionByName(p.held).select("Store", "Date", "fold", "model", "y", "pred")


@query("select a.Store, a.Date, k as weeks, b.Customers as value from calendar a, lateral (select unnest(range(1, 53)) as k) join calendar b on b.Store = a.Store and b.Date = a.Date - cast(7 * k as integer) where b.day_status = 'open'", "calendar")
def same_weekday_history(p: Panel) -> DataFrame:
    return baselines.same_weekday_history(p.calendar)


@query(
    """select fold, model, round(avg(case when w = n then 1 else 0 end), 6) as nearest, round(avg(case when w > n and w <= 4 then 1 else 0 end), 6) as within_4, round(avg(case when w > 4 then 1 else 0 end), 6) as older,
 count(distinct case when w > 4 then Store end) as stores_older from (select *, date_diff('day', from_day, Date) / 7 as w, case when model = 'lag_14' then 2 else 1 end as n from pred where from_day is not null) group by 1, 2""",
    "pred",
)
def baseline_source_weeks(p: Panel) -> DataFrame:
    return baselines.source_weeks(p.predicted(*baselines.FOLDS, baselines.HOLDOUT))


@query("select fold, model, Promo, round(avg(pred / y - 1) * 100, 6) as bias_pct, round(avg(abs(pred / y - 1)) * 100, 6) as ape from pred where fold in ('winter', 'spring', 'summer') group by 1, 2, 3", "pred")
def baseline_errors_by_promo(p: Panel) -> DataFrame:
    return baselines.promo_errors(p.pred)


@query(
    """select 'lag_' || w as model, round(avg(coalesce((s.Promo = b.Promo)::int, 0)) * 100, 6) as same_share, round(avg(abs(s.Customers - b.Customers) / b.Customers) filter (s.Promo = b.Promo) * 100, 6) as ape_same,
 round(avg(abs(s.Customers - b.Customers) / b.Customers) filter (s.Promo <> b.Promo) * 100, 6) as ape_other from (select unnest([7, 14]) as w) cross join calendar b join folds f on b.Date between f.start and f."end" and fold <> 'holdout' left join lateral (
 select Promo, Customers from calendar c where c.Store = b.Store and c.day_status = 'open' and c.Date < b.Date and c.Date >= b.Date - 364 and (b.Date - c.Date) % w = 0 order by c.Date desc limit 1) s on true where b.day_status = 'open' group by w""",
    "calendar",
    "folds",
)
def baseline_errors_by_phase(p: Panel) -> DataFrame:
    return baselines.phase_errors(p.pred)


@query(
    """select d.*, week_median, week_90 from (select model, round(avg(y), 6) as mean_y, round(quantile_cont(abs(pred - y), 0.5), 6) as median_error, round(quantile_cont(abs(pred - y), 0.9), 6) as error_90,
 round(avg(case when abs(pred - y) / y * 100 <= 5 then 1 else 0 end) * 100, 6) as within_5, round(avg(case when abs(pred - y) / y * 100 > 10 then 1 else 0 end) * 100, 6) as over_10,
 round(avg(case when abs(pred - y) / y * 100 > 20 then 1 else 0 end) * 100, 6) as over_20, round(sum(pred - y) / sum(y) * 100, 6) as bias_pct from pred where fold = 'holdout' group by 1) d
 join (select model, round(quantile_cont(abs(p - y) / y * 100, 0.5), 6) as week_median, round(quantile_cont(abs(p - y) / y * 100, 0.9), 6) as week_90 from (
 select model, Store, date_diff('day', date '2015-06-20', Date) // 7 as week, sum(y) as y, sum(pred) as p from pred where fold = 'holdout' group by 1, 2, 3) group by 1) w on w.model = d.model""",
    "pred",
)
def business_summary(p: Panel) -> DataFrame:
    return scoring.business_summary(p.held, "2015-06-20", "model")


@query(
    """select fold, count(*) filter (day_status = 'open') as open_days, count(distinct case when day_status = 'open' then Store end) as stores,
 coalesce(string_agg(distinct case when coalesce(StateHoliday, '0') <> '0' then Date::varchar end, ',' order by case when coalesce(StateHoliday, '0') <> '0' then Date::varchar end), '') as holidays
 from calendar join folds on Date between start and "end" group by 1""",
    "calendar",
    "folds",
)
def fold_description(p: Panel) -> DataFrame:
    return scoring.describe_folds(p.calendar, baselines.folds(p.spark, (*baselines.FOLDS, baselines.HOLDOUT)))


@query(
    """select s.model, round(avg(s.mape - b.mape), 6) as mean_delta, count(*) filter (s.mape < b.mape) as better, avg(s.mape - b.mape) < 0 and count(*) filter (s.mape < b.mape) >= 2 as accept
 from scores s join scores b on b.fold = s.fold and b.model = 'lag_7' where s.model <> 'lag_7' group by 1""",
    "scores",
)
def compare_to_base(p: Panel) -> DataFrame:
    return scoring.compare_to_base(scoring.fold_scores(p.pred), "lag_7")


@query(
    """select s.fold, s.model, u.metric, round((u.b - u.v) / u.b * 100, 6) as gain_pct from all_scores s join all_scores b on b.fold = s.fold and b.model = 'lag_7',
 lateral (select 'mae' as metric, s.mae as v, b.mae as b union all select 'mape', s.mape, b.mape union all select 'wape', s.wape, b.wape) u where s.model <> 'lag_7'""",
    "all_scores",
)
def improvement_over_base(p: Panel) -> DataFrame:
    return scoring.improvement(scoring.fold_scores(p.pred), "lag_7")


_boot = """blocks as (select model, Store, date_diff('day', date '2015-06-20', Date) // 7 as week, count(*) as n, sum(abs(pred - y)) as e, sum(abs(pred - y) / y) as r from pred where fold = 'holdout' group by 1, 2, 3),
 bk as (select Store, week, row_number() over (order by Store, week) - 1 as block, count(*) over () as b from (select distinct Store, week from blocks)),
 dr as (select draw, ('0x' || substr(md5('42|' || draw || '|' || slot), 1, 8))::bigint % b as block from (select unnest(range(2000)) as draw), (select block as slot, b from bk)),
 tm as (select draw, block, count(*) as t from dr group by 1, 2),
 boot as (select draw, model, sum(t * e) / sum(t * n) as mae, sum(t * r) / sum(t * n) * 100 as mape from blocks join bk using (Store, week) join tm using (block) group by 1, 2)"""


@query(None)
def bootstrap_draws(p: Panel) -> DataFrame:
    return scoring.bootstrap(scoring.block_sums(p.held, "2015-06-20"))


@query(None)
def bootstrap_gains(p: Panel) -> DataFrame:
    return scoring.bootstrap_gains(scoring.bootstrap(scoring.block_sums(p.held, "2015-06-20")), "median_7_28")


SQL["bootstrap_draws"] = text("", "pred").rstrip() + ",\n" + _boot + " select draw, model, round(mae, 6) as mae, round(mape, 6) as mape from boot"
SQL["bootstrap_gains"] = text("", "pred").rstrip() + ",\n" + _boot + """ select base, metric, round(quantile_cont(gain, 0.025), 6) as low, round(quantile_cont(gain, 0.975), 6) as high, round(avg(case when gain > 0 then 1 else 0 end), 6) as share from (
 select b.model as base, u.metric, (u.v - u.o) / u.v * 100 as gain from boot b join boot o on o.draw = b.draw and o.model = 'median_7_28', lateral (select 'mae' as metric, b.mae as v, o.mae as o union all select 'mape', b.mape, o.mape) u where b.model <> 'median_7_28') group by 1, 2"""


@query("select Store, model, round(avg(abs(pred - y) / y) * 100, 6) as mape, round(sum(pred - y) / sum(y) * 100, 6) as bias_pct from pred where fold = 'holdout' group by 1, 2", "pred")
def store_mape(p: Panel) -> DataFrame:
    return scoring.store_mape(p.held)


@query(
    """select count(*) as stores, round(avg(case when a < b then 1 else 0 end), 6) as share from (select Store, avg(abs(pred - y) / y) filter (model = 'median_7_28') as a, avg(abs(pred - y) / y) filter (model = 'lag_7') as b from pred where fold = 'holdout' group by 1)""",
    "pred",
)
def store_wins(p: Panel) -> DataFrame:
    return scoring.wins(p.held, "median_7_28", "lag_7")


@query(
    """select model, kind, cast(number as integer) as number, round(avg(abs(pred - y) / y) * 100, 6) as ape from (select *, unnest(['weekday', 'week']) as kind, unnest([DayOfWeek, date_diff('day', date '2015-06-20', Date) // 7]) as number from pred where fold = 'holdout') group by 1, 2, 3""",
    "pred",
)
def errors_by_weekday_and_week(p: Panel) -> DataFrame:
    return scoring.by_weekday_and_week(p.held, "2015-06-20")


@query("select model, segment, round(avg(m), 6) as mape from (select model, segment, fold, avg(abs(pred - y) / y) * 100 as m from pred join dim using (Store) where fold in ('winter', 'spring', 'summer') group by 1, 2, 3) group by 1, 2", "pred", "dim")
def segment_mape(p: Panel) -> DataFrame:
    return scoring.segment_mape(p.pred, p.profile)


@query(
    """select case when k = 1 then 'best' when k = n then 'worst' else 'median' end as kind, Store, round(m, 6) as mape from (select *, row_number() over (order by m, Store) as k, count(*) over () as n from (
 select Store, avg(abs(pred - y) / y) * 100 as m from pred where fold = 'holdout' and model = 'lag_7' group by 1)) where k = 1 or k = n or k = (n + 1) // 2""",
    "pred",
)
def store_extremes(p: Panel) -> DataFrame:
    return scoring.store_extremes(p.held, "lag_7")


@query("select Date, round(sum(pred - y) / sum(y) * 100, 6) as bias_pct, count(*) filter (abs(pred - y) / y > 0.2) as stores_off from pred where fold = 'holdout' and model = 'lag_7' group by 1", "pred")
def day_bias(p: Panel) -> DataFrame:
    return scoring.day_bias(p.held, "lag_7")


@query("select Date, round(sum(pred - y) / sum(y) * 100, 6) as bias_pct, count(*) filter (abs(pred - y) / y > 0.2) as stores_off from pred where fold = 'holdout' and model = 'lag_7' group by 1 order by abs(sum(pred - y) / sum(y)) desc, Date limit 6", "pred")
def worst_days(p: Panel) -> DataFrame:
    return scoring.worst_days(p.held, "lag_7")
