"""Registered queries on store profiles, sampling, models and weekly forecasts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import asof, audit, baselines, boosting, encoding, forecast, forecaster, models, order, ridge, sampling, scoring, statespace
from ..operators.features import BASE_CATEGORICAL, BASE_NUMERIC, CATEGORICAL, MODEL_NUMERIC, build_features, category_levels
from ..sources import panel
from . import fixture
from .demand import FLAG_COLUMNS, SQL, Panel, query
from .oracle import cte

cte("active", ("history",), "select * from history where Date <= date '2015-06-19' and Open = 1 and Customers > 0")
cte("long_runs", ("runs",), "select * from runs where is_long")
cte("profile", ("history", "active", "long_runs", "dim"), """
 with guests as (select Store, quantile_cont(Customers::double, 0.5) as guests_median, stddev_samp(Customers) / avg(Customers) as guests_cv, sum(Sales) / sum(Customers) as avg_check from active group by 1),
 w14 as (select Store, count(*) as n, avg(Customers) as m from active where Date >= date '2014-01-01' and Date <= date '2014-06-19' group by 1),
 w15 as (select Store, count(*) as n, avg(Customers) as m from active where Date >= date '2015-01-01' group by 1),
 shut as (select Store, count(*) as n, sum(days) as days from long_runs group by 1),
 closed as (select Store, count(*) as n from history where Open = 0 group by 1), size as (select Store, count(*) as n from history group by 1),
 odd as (select Store, count(*) as n from history where Date <= date '2015-06-19' and Open = 1 and Customers = 0 group by 1),
 sundays as (select Store, count(*) as n from history where Open = 1 and isodow(Date) = 7 group by 1), test as (select Store, sum(Open) as n from history where Date >= date '2015-06-20' group by 1),
 every as (select d.Store, StoreType, Assortment, CompetitionDistance, Promo2, segment, coalesce(since > (select min(Date) from history) and since <= date '2015-06-19', false) as competitor_opened_in_train,
  (select date_diff('day', min(Date), max(Date)) + 1 from history) - size.n as missing_days, coalesce(shut.n, 0) as n_long_closures, coalesce(shut.days, 0)::bigint as long_closure_days,
  (coalesce(closed.n, 0) - coalesce(shut.days, 0)) / size.n as share_regular_closed, coalesce(shut.days, 0) / size.n as share_long_closed, coalesce(odd.n, 0) as n_anomalies, coalesce(sundays.n, 0) as sunday_open_days,
  coalesce(test.n, 0)::bigint as open_days_test, guests_median, guests_cv, avg_check, coalesce(w14.n, 0) as open_days_2014, coalesce(w15.n, 0) as open_days_2015, w15.m / w14.m - 1 as growth_raw
  from dim d join size using (Store) left join guests using (Store) left join w14 using (Store) left join w15 using (Store) left join shut using (Store) left join closed using (Store) left join odd using (Store) left join sundays using (Store) left join test using (Store))
 select *, missing_days > 1 as has_export_gap, n_long_closures > 0 as has_long_closure, Store in (select Store from long_runs where is_left_censored) as has_left_censored,
  Store in (select Store from long_runs where in_test) as closed_in_test, sunday_open_days > 0 as sunday_open, case when open_days_2014 >= 120 and open_days_2015 >= 120 then growth_raw end as growth_yoy, n_anomalies > 0 as has_anomaly from every""")
cte("netseries", ("active", "gaps"), """
 select Date, m as mean, case when count(m) over w >= 20 then avg(m) over w end as rolling from (
  select Date, avg(Customers) as m from active where not exists (select 1 from gaps where gaps.Store = active.Store and gaps.days > 1) and isodow(Date) <> 7 and StateHoliday = '0' group by 1)
 window w as (order by Date rows between 27 preceding and current row)""")
cte("terc", ("profile",), "select quantile_cont(growth_yoy, 1.0 / 3) as a, quantile_cont(growth_yoy, 2.0 / 3) as b from profile where not closed_in_test")
cte("pool", ("profile", "terc"), "select p.*, case when growth_yoy is null then 'no data' when growth_yoy <= a then '1' when growth_yoy <= b then '2' else '3' end as growth_tercile from profile p cross join terc where not closed_in_test")
# The sample: mandatory flags one after another, then quotas by segment and, inside, by tercile.
cte("m0", ("pool",), "select *, md5('42|' || Store) as draw, cast(null as varchar) as reason from pool")
for _i, (_flag, _quota_) in enumerate(sampling.MANDATORY.items()):
    cte(f"m{_i + 1}", (f"m{_i}",), f"""
 select * replace (case when {_flag} and reason is null and row_number() over (partition by {_flag} and reason is null order by draw, Store) <= {_quota_} - count(*) filter ({_flag} and reason is not null) over () then 'mandatory:{_flag}' else reason end as reason) from m{_i}""")


def _quotas(total: str, minimum: int, by: str) -> str:
    """Largest remainder over rows (g, size) within `by`."""
    over = f"over (partition by {by})" if by else "over ()"
    rank = f"partition by {by + ', ' if by else ''}fixed is null"
    return f"""(with a as (select *, {total} * size / sum(size) {over} as share from src), b as (select *, case when share < {minimum} then least({minimum}, size) end as fixed from a),
 c as (select *, ({total} - coalesce(sum(fixed) {over}, 0)) * (case when fixed is null then size end) / sum(case when fixed is null then size end) {over} as exact from b),
 d as (select *, {total} - coalesce(sum(fixed) {over}, 0) - coalesce(sum(floor(exact)) {over}, 0) as lft from c)
 select *, cast(coalesce(fixed, floor(exact) + case when row_number() over ({rank} order by round(exact - floor(exact), 9) desc, g) <= lft then 1 else 0 end) as bigint) as quota from d)"""


_last = f"m{len(sampling.MANDATORY)}"
_size = "least(40, greatest(1, (select count(*) from pool) // 2))"
cte("segment_quota", (_last,), f"with src as (select segment as g, count(*) as size from {_last} group by 1) select g, size, quota from {_quotas(_size, 5, '')}")
cte("stratum_quota", ("segment_quota",), f"""
 with src as (select m.segment, growth_tercile as g, count(*) as size, count(reason) as had, any_value(q.quota) as total from {_last} m join segment_quota q on q.g = m.segment group by 1, 2)
 select segment, g, had, total, quota from {_quotas('total', 0, 'segment')}""")
cte("needs", ("stratum_quota",), """
 with units as (select segment, g, greatest(total - (select sum(had) from stratum_quota o where o.segment = q.segment), 0) as room, unnest(range(1, greatest(quota - had, 0)::bigint + 1)) as unit from stratum_quota q)
 select segment, g, count(*) as need from (select *, row_number() over (partition by segment order by unit, g desc) as turn from units) where turn <= room group by 1, 2""")
cte("sample", ("needs",), f"""
 select * from (select m.* replace (case when reason is null and row_number() over (partition by m.segment, growth_tercile, reason is null order by draw, Store) <= need then 'stratified' else reason end as reason)
 from {_last} m left join needs on needs.segment = m.segment and needs.g = m.growth_tercile) where reason is not null""")
_features = ["guests_median", "avg_check", "guests_cv", "growth_yoy", "log10_competition_distance", "Promo2", "competitor_opened_in_train", "has_export_gap", "has_long_closure", "sunday_open"] + [f"StoreType_{c}" for c in "abcd"] + [f"Assortment_{c}" for c in "abc"]
cte("frame", ("pool", "sample"), f"""
 select Store, segment, Store in (select Store from sample) as s, unnest({_features}) as feature, unnest([guests_median, avg_check, guests_cv, growth_yoy, log10(CompetitionDistance), Promo2::double, competitor_opened_in_train::int::double, has_export_gap::int::double, has_long_closure::int::double, sunday_open::int::double,
  {', '.join(f"(StoreType = '{c}')::int::double" for c in 'abcd')}, {', '.join(f"(Assortment = '{c}')::int::double" for c in 'abc')}]) as x from pool""")
_smd = "case when sqrt((coalesce(var_samp(x) filter (s), 0) + coalesce(var_samp(x), 0)) / 2) > 1e-12 then (avg(x) filter (s) - avg(x)) / sqrt((coalesce(var_samp(x) filter (s), 0) + coalesce(var_samp(x), 0)) / 2) else 0.0 end"
cte("core", ("frame",), f"select * from frame where segment <> 'high_traffic' and feature not in {sampling.BY_DESIGN}")
cte("sims", ("core",), f"""
 with n as (select count(distinct Store) filter (s) as n from core), k as (select Store, sim, row_number() over (partition by sim order by md5('42|' || sim || '|' || Store), Store) as k from (select distinct Store from core) cross join (select unnest(range(500)) as sim))
 select sim, feature, {_smd} as smd from (select c.feature, c.x, k.sim, k.k <= n.n as s from core c join k using (Store) cross join n) group by 1, 2""")
cte("good0", ("requests", "history", "plan"), "select distinct restaurant as Store, origin from requests")
cte("wk", ("good0",), """
 select r.Store, r.origin, r.origin + cast(k as integer) as Date, d.Open, d.Promo, d.StateHoliday, d.SchoolHoliday from good0 r cross join (select unnest(range(7)) as k)
 left join (select * from (select *, row_number() over (partition by Store, Date order by rk) as pl from (select Store, Date, Open, Promo, StateHoliday, SchoolHoliday, 0 as rk from history union all select Store, Date, Open, Promo, StateHoliday, SchoolHoliday, 1 from plan)) where pl = 1) d
 on d.Store = r.Store and d.Date = r.origin + cast(k as integer)""")
cte("checked", ("wk",), """
 select r.Store as restaurant, r.origin, case when r.Store <= 0 then 'store number must be positive' when s.b is null then 'unknown store' when r.origin <= s.a then 'date before the history' when r.origin > s.b + 1 then 'date after the history'
  when g.gone > 0 then 'no plan for ' || g.days when coalesce(n, 0) < 12 then 'history too short' end as error
 from good0 r left join (select Store, min(Date) as a, max(Date) as b from history group by 1) s on s.Store = r.Store
 left join (select r.Store, r.origin, count(*) as n from good0 r join history h on h.Store = r.Store and h.Date <= r.origin - 7 and h.Open = 1 and h.Customers > 0 group by 1, 2) o on o.Store = r.Store and o.origin = r.origin
 left join (select Store, origin, count(*) filter (Open is null) as gone, string_agg(case when Open is null then Date::varchar end, ',' order by Date) as days from wk group by 1, 2) g on g.Store = r.Store and g.origin = r.origin""")
cte("ok", ("checked",), "select restaurant as Store, origin from checked where error is null")
cte("weeks", ("ok", "wk"), """
 select w.Store, w.origin, w.Date, isodow(w.Date) as DayOfWeek, w.Open, w.Promo, w.StateHoliday, w.SchoolHoliday, case when w.Open = 0 then 0.0 else (
  select cast(h.Customers as double) from history h where h.Store = w.Store and h.Date < w.origin and h.Open = 1 and h.Customers > 0 and h.Date >= w.Date - 364 and (w.Date - h.Date) % 7 = 0 order by h.Date desc limit 1) end as baseline_lag_7, a.Customers as actual
 from wk w join ok on ok.Store = w.Store and ok.origin = w.origin left join history a on a.Store = w.Store and a.Date = w.Date""")



def kept(df: DataFrame) -> DataFrame:
    """A small table that several parts of a query read: cached in Spark, which drops it when the session or its cache is cleared."""
    return df.persist()


# Profile


@query(
    """select Store, StoreType, Assortment, CompetitionDistance, Promo2, competitor_opened_in_train, missing_days, n_long_closures, long_closure_days, round(share_regular_closed, 6) as share_regular_closed, round(share_long_closed, 6) as share_long_closed, n_anomalies, sunday_open_days, open_days_test,
 guests_median, round(guests_cv, 6) as guests_cv, round(avg_check, 6) as avg_check, open_days_2014, open_days_2015, round(growth_raw, 6) as growth_raw, has_export_gap, has_long_closure, has_left_censored, closed_in_test, sunday_open, round(growth_yoy, 6) as growth_yoy, segment from profile""",
    "profile",
)
def store_profile(p: Panel) -> DataFrame:
    return p.profile


@query("select Date, round(mean, 6) as mean, round(rolling, 6) as rolling from netseries", "netseries")
def network_series(p: Panel) -> DataFrame:
    return audit.network_series(p.history)


@query("select round(avg(mean) filter (year(Date) = 2015) / avg(mean) filter (year(Date) = 2014) - 1, 6) as growth from netseries where month(Date) < 6 or (month(Date) = 6 and day(Date) <= 19)", "netseries")
def network_growth(p: Panel) -> DataFrame:
    return audit.network_growth(p.history)


@query("select Store, open_days_2014, open_days_2015 from profile where growth_yoy is null", "profile")
def stores_without_growth(p: Panel) -> DataFrame:
    return audit.missing_growth(p.profile)


@query("select open_days_test as value, count(*) as n from profile group by 1 order by n desc, value limit 1", "profile")
def open_days_mode(p: Panel) -> DataFrame:
    return audit.mode_of(p.profile, "open_days_test")


@query("select Store, open_days_test from profile where open_days_test < (select v from (select open_days_test as v, count(*) as n from profile group by 1 order by n desc, v limit 1))", "profile")
def stores_below_mode(p: Panel) -> DataFrame:
    return audit.below_mode(p.profile, "open_days_test")


@query("select round(corr(ra, rb), 6) as rho from (select rank() over (order by guests_median) + (count(*) over (partition by guests_median) - 1) / 2 as ra, rank() over (order by avg_check) + (count(*) over (partition by avg_check) - 1) / 2 as rb from profile)", "profile")
def traffic_check_correlation(p: Panel) -> DataFrame:
    return audit.spearman(p.profile, "guests_median", "avg_check")


@query("select round(corr(ra, rb), 6) as rho from (select rank() over (order by guests_median) + (count(*) over (partition by guests_median) - 1) / 2 as ra, rank() over (order by guests_cv) + (count(*) over (partition by guests_cv) - 1) / 2 as rb from profile)", "profile")
def traffic_variation_correlation(p: Panel) -> DataFrame:
    return audit.spearman(p.profile, "guests_median", "guests_cv")


@query(
    "select Store, case when CompetitionDistance is null then null when CompetitionDistance <= q[1] then '1' when CompetitionDistance <= q[2] then '2' when CompetitionDistance <= q[3] then '3' else '4' end as quartile from stores cross join (select quantile_cont(CompetitionDistance, [0.25, 0.5, 0.75]) as q from stores)",
    "stores",
)
def distance_quartiles(p: Panel) -> DataFrame:
    return audit.quantile_bin(p.stores, "CompetitionDistance", 4, "quartile").select("Store", "quartile")


@query("select segment as \"group\", count(*) as stores, round(median(guests_median), 6) as guests_median, round(median(avg_check), 6) as avg_check, round(median(guests_cv), 6) as guests_cv, round(count(*) / sum(count(*)) over (), 6) as share from profile group by 1", "profile")
def segment_summary(p: Panel) -> DataFrame:
    return audit.group_summary(p.profile, "segment")


_eps = """select '{g}' as feature, '{v}' as target, round((12.0 / (n * (n + 1)) * s - 3 * (n + 1)) / nullif(1 - t / (n * n * n - n), 0) / nullif(n - 1, 0), 6) as eps2 from
 (select sum(r * r / k) as s, sum(k)::double as n from (select {g}, sum(rk) as r, count(*) as k from (select {g}, rank() over (order by {v}) + (count(*) over (partition by {v}) - 1) / 2 as rk from grouped where {g} is not null and {v} is not null) group by 1)),
 (select sum(c * c * c - c)::double as t from (select count(*)::double as c from grouped where {g} is not null and {v} is not null group by {v}))"""


GROUPINGS, TARGETS = ("StoreType", "Assortment", "Promo2", "distance_quartile", "competitor_opened_in_train"), ("guests_median", "avg_check", "growth_yoy")
cte("grouped", ("profile",), """
 select p.*, case when CompetitionDistance is null then null when CompetitionDistance <= q[1] then '1' when CompetitionDistance <= q[2] then '2' when CompetitionDistance <= q[3] then '3' else '4' end as distance_quartile
 from profile p cross join (select quantile_cont(CompetitionDistance, [0.25, 0.5, 0.75]) as q from profile)""")


@query(" union all ".join(_eps.format(g=g, v=v) for g in GROUPINGS for v in TARGETS), "grouped")
def effect_sizes(p: Panel) -> DataFrame:
    """Kruskal-Wallis effect sizes of five groupings on three targets."""
    rows = kept(audit.quantile_bin(p.profile, "CompetitionDistance", 4, "distance_quartile"))
    return reduce(DataFrame.unionByName, [audit.epsilon_squared(rows, g, v) for g in GROUPINGS for v in TARGETS])


@query("select segment as \"group\", guests_median as value, round(cume_dist() over (partition by segment order by guests_median), 6) as share from profile where guests_median is not null", "profile")
def guests_ecdf(p: Panel) -> DataFrame:
    return audit.ecdf(p.profile, "segment", "guests_median")


@query("select growth_tercile as \"group\", count(*) as stores, round(min(growth_yoy), 6) as least, round(max(growth_yoy), 6) as most from pool group by 1", "pool")
def observations_by_tercile(p: Panel) -> DataFrame:
    return audit.observation_summary(p.pool, "growth_tercile", "growth_yoy")


# Sampling


@query("select Store, segment, has_anomaly, growth_tercile from pool", "pool")
def eligible_pool(p: Panel) -> DataFrame:
    return sampling.eligible(p.profile).select("Store", "segment", "has_anomaly", "growth_tercile")


def drawn(p: Panel) -> tuple[DataFrame, DataFrame]:
    """The eligible pool and a stratified sample of half of it, forty stores at most."""
    pool = kept(p.pool)
    return pool, kept(sampling.select_stores(pool, min(40, max(1, pool.count() // 2))))


@query('select g as "group", size, quota from segment_quota', "segment_quota")
def segment_quotas(p: Panel) -> DataFrame:
    pool = kept(p.pool)
    sizes = pool.groupBy(F.col("segment").alias("group")).agg(F.count("*").alias("size"))
    return sampling.proportional_quota(sizes, min(40, max(1, pool.count() // 2)), sampling.MIN_PER_SEGMENT)


@query(f"select Store, reason, segment, StoreType, growth_tercile, {', '.join(sampling.FLAGS)} from sample", "sample")
def selected_stores(p: Panel) -> DataFrame:
    """The sample with reason and flags."""
    return sampling.chosen_table(*drawn(p))


@query("select case when grouping(segment) = 1 then 'all' else segment end as segment, case when grouping(growth_tercile) = 1 then 'all' else growth_tercile end as growth_tercile, count(*) as n from sample group by cube (segment, growth_tercile)", "sample")
def segment_by_tercile(p: Panel) -> DataFrame:
    pool, sample = drawn(p)
    return audit.cross_tab(pool.join(sample, "Store", "left_semi"), "segment", "growth_tercile")


cte("own_smd", ("frame",), f"select feature, avg(x) as whole_mean, avg(x) filter (s) as sample_mean, {_smd} as smd from frame group by 1")
cte("core_smd", ("frame",), f"select feature, {_smd} as smd from frame where segment <> 'high_traffic' group by 1")


@query("select feature, round(smd, 6) as smd from own_smd", "own_smd")
def sample_balance(p: Panel) -> DataFrame:
    pool, sample = drawn(p)
    return sampling.smd(sampling.balance_frame(pool), sample)


@query(
    f"select o.feature, round(whole_mean, 6) as whole_mean, round(sample_mean, 6) as sample_mean, round(o.smd, 6) as smd, round(c.smd, 6) as smd_without, o.feature in {sampling.BY_DESIGN} as by_design from own_smd o join core_smd c using (feature)",
    "own_smd",
    "core_smd",
)
def balance_without_segment(p: Panel) -> DataFrame:
    pool, sample = drawn(p)
    return sampling.balance_table(sampling.balance_frame(pool), sample)


def simulated(p: Panel) -> tuple[DataFrame, DataFrame]:
    """Differences of the sample and of 500 random ones of its size, by the criterion's features and stores."""
    pool, sample = drawn(p)
    frame = kept(sampling.core(sampling.balance_frame(pool)))
    own = sample.join(frame, "Store", "left_semi")
    return sampling.smd(frame, own), sampling.simulate(frame, own.count())


@query("select sim, feature, round(smd, 6) as smd from sims", "sims")
def simulated_balance(p: Panel) -> DataFrame:
    return simulated(p)[1]


@query("select round(quantile_cont(m, 0.95), 6) as threshold from (select sim, max(abs(smd)) as m from sims group by 1)", "sims")
def balance_threshold(p: Panel) -> DataFrame:
    return sampling.threshold(simulated(p)[1])


@query(
    """select o.feature, round(o.smd, 6) as smd, round(avg(case when round(abs(s.smd), 9) > round(abs(o.smd), 9) then 1 else 0 end), 6) as share_larger,
 round(abs(o.smd), 9) <= round((select quantile_cont(m, 0.95) from (select sim, max(abs(smd)) as m from sims group by 1)), 9) as balanced from core_smd o join sims s on s.feature = o.feature group by o.feature, o.smd""",
    "core_smd",
    "sims",
)
def balance_verdict(p: Panel) -> DataFrame:
    return sampling.verdict(*simulated(p))


@query(
    "select 'stores' as what, count(*) as n from sample union all select 'anomalous_days', sum(n_anomalies)::bigint from sample "
    + " ".join(f"union all select '{f}', count(*) from sample where {f}" for f in sampling.FLAGS)
    + " union all select 'holiday_dates', count(distinct Date) from history semi join sample using (Store) where StateHoliday <> '0' union all select 'rows', count(*) from history semi join sample using (Store)"
    + " union all select 'segment ' || segment, count(*) from sample group by segment union all select 'growth ' || growth_tercile, count(*) from sample group by growth_tercile",
    "sample",
)
def sample_phenomena(p: Panel) -> DataFrame:
    pool, sample = drawn(p)
    return sampling.phenomena(pool, p.history, sample)


# Scores by profile


def flagged(p: Panel) -> DataFrame:
    return p.profile.withColumn("has_anomaly", F.col("n_anomalies") > 0)


_set = ", ".join(f"case when {f} then '{f}' end" for f in FLAG_COLUMNS)
_groups = f"(select Store, unnest(list_filter(['all', segment, {_set}], lambda x: x is not null)) as g from profile)"


@query(f'select model, g as "group", count(distinct pred.Store) as stores, round(avg(abs(pred - y) / y) * 100, 6) as ape from pred join {_groups} q on q.Store = pred.Store where fold = \'holdout\' group by 1, 2', "pred", "profile")
def errors_by_store_group(p: Panel) -> DataFrame:
    return scoring.by_group(p.held, flagged(p), FLAG_COLUMNS)


@query(
    f"""select Store, round(m, 6) as mape, round(b, 6) as bias_pct, array_to_string(list_filter([{_set}], lambda x: x is not null), ',') as flags
 from (select Store, avg(abs(pred - y) / y) * 100 as m, sum(pred - y) / sum(y) * 100 as b from pred where fold = 'holdout' and model = 'lag_7' group by 1) join profile using (Store) order by m desc, Store limit 6""",
    "pred",
    "profile",
)
def worst_stores(p: Panel) -> DataFrame:
    return scoring.worst_stores(p.held, flagged(p), "lag_7", FLAG_COLUMNS)


# Weekly forecasts


@query("select restaurant, origin, error from checked", "checked")
def request_checks(p: Panel) -> DataFrame:
    return forecast.check_requests(p.requests, p.history, p.plan)


@query("select w.* from wk w join ok on ok.Store = w.Store and ok.origin = w.origin", "wk", "ok")
def week_plans(p: Panel) -> DataFrame:
    good = forecast.good(forecast.check_requests(p.requests, p.history, p.plan))
    return forecast.week_plan(good, p.history, p.plan).select("Store", "origin", "Date", "Open", "Promo", "StateHoliday", "SchoolHoliday")


@query("select Store, origin, Date, DayOfWeek, Open, Promo, StateHoliday, SchoolHoliday, baseline_lag_7, actual from weeks", "weeks")
def weekly_baseline(p: Panel) -> DataFrame:
    good = forecast.good(forecast.check_requests(p.requests, p.history, p.plan))
    return forecast.baseline_weeks(good, p.history, p.plan)


@query(
    """select Store, origin, count(*) as days, round(avg(abs(baseline_lag_7 - actual)), 6) as baseline_lag_7_mae, round(avg(abs(baseline_lag_7 - actual) / actual) * 100, 6) as baseline_lag_7_mape, round(sum(abs(baseline_lag_7 - actual)) / sum(actual) * 100, 6) as baseline_lag_7_wape
 from weeks where Open = 1 group by 1, 2 having count(*) = count(*) filter (actual > 0)""",
    "weeks",
)
def weekly_metrics(p: Panel) -> DataFrame:
    good = forecast.good(forecast.check_requests(p.requests, p.history, p.plan))
    return forecast.week_metrics(forecast.baseline_weeks(good, p.history, p.plan), ("baseline_lag_7",))


@query("select d.Store, segment, a as first_day, b as last_day, c as last_plan_day from dim d left join (select Store, min(Date) as a, max(Date) as b from history group by 1) h using (Store) left join (select Store, max(Date) as c from plan group by 1) q using (Store)", "dim", "plan")
def store_coverage(p: Panel) -> DataFrame:
    dim = p.profile.select("Store", "segment")
    return forecast.coverage(p.history, p.plan, dim)


@query(
    "select ok.Store, ok.origin, ok.origin + k::integer as Date, round(level, 6) as level, round(lag_filled, 6) as lag_filled, f.Store is not null as known from ok cross join (select unnest(range(7)) as k) left join features f on f.Store = ok.Store and f.Date = ok.origin + k::integer",
    "ok",
    "features",
)
def one_pass_weeks(p: Panel) -> DataFrame:
    """Levels and lags of all request days from one feature table; days after the calendar are not known to it."""
    good = forecast.good(forecast.check_requests(p.requests, p.history, p.plan))
    return forecast.one_pass_features(good, p.calendar, p.stores).select("Store", "origin", "Date", "level", "lag_filled", "known")


cte("asked_days", ("ok", "wk", "history"), """
 select ok.Store, ok.origin, h.Date, h.Open, h.StateHoliday, h.Customers from ok join history h on h.Store = ok.Store and h.Date < ok.origin
 union all select w.Store, w.origin, w.Date, w.Open, w.StateHoliday, null from wk w join ok on ok.Store = w.Store and ok.origin = w.origin""")
cte("asked_runs", ("asked_days",), """
 select Store, origin, Date, count(*) over (partition by Store, origin, run) as n
 from (select Store, origin, Date, Date - cast(row_number() over (partition by Store, origin order by Date) as integer) as run from asked_days where Open = 0)""")
cte("asked_status", ("asked_days", "asked_runs"), """
 select d.*, case when n >= 3 then 'absent' when Open = 0 then 'closed' when Customers = 0 then 'anomaly' else 'open' end as day_status
 from asked_days d left join asked_runs r on r.Store = d.Store and r.origin = d.origin and r.Date = d.Date""")
cte("asked_events", ("asked_status",), """
 select t.Store, t.origin, t.Date, t.day_status,
  min({'d': a.Date, 'k': a.StateHoliday}) filter (a.StateHoliday <> '0' and a.Date between t.Date and t.Date + 3) as nx,
  max({'d': a.Date, 'k': a.StateHoliday}) filter (a.StateHoliday <> '0' and a.Date between t.Date - 3 and t.Date - 1) as pv,
  max(a.Date) filter (a.day_status in ('absent', 'anomaly') and a.Date <= t.Date) as away, min(a.Date) filter (a.day_status = 'absent' and a.Date >= t.Date) as leaves
 from asked_status t join asked_status a on a.Store = t.Store and a.origin = t.origin where t.Date >= t.origin group by 1, 2, 3, 4""")


@query(
    """select e.Store, e.origin, e.Date, e.day_status, f.level is not null as has_level, round(f.level, 6) as level, round(f.lag_filled, 6) as lag_filled,
 case when nx is null then 'none' else nx.k || '_' || (nx.d - e.Date) end as next_holiday, case when pv is null then 'none' else pv.k || '_' || (e.Date - pv.d) end as prev_holiday,
 case when e.Date > away and e.Date <= away + 14 then (e.Date - away - 1)::varchar else 'none' end as days_since_reopen,
 case when leaves > e.Date and leaves <= e.Date + 7 then (leaves - e.Date)::varchar else 'none' end as days_to_long_closure
 from asked_events e join features f on f.Store = e.Store and f.Date = e.Date""",
    "asked_events",
    "features",
)
def overlay_weeks(p: Panel) -> DataFrame:
    """What each request sees of the days of its week that the calendar holds: levels and lags of one table, events by its own plan and history."""
    good = forecast.good(forecast.check_requests(p.requests, p.history, p.plan))
    rows = forecast.overlay_features(good, p.history, p.plan, p.stores).filter(F.col("Date") <= F.lit(fixture.END).cast("date"))
    return rows.select("Store", "origin", "Date", "day_status", F.col("level").isNotNull().alias("has_level"), "level", "lag_filled", "next_holiday", "prev_holiday", "days_since_reopen", "days_to_long_closure")


# Joins by the nearest day, ranks, quantiles, columns for very many stores


@query(
    """select h.Store, h.Date, case when h.Date - p.Date <= 28 then p.Date end as promo_Date, case when h.Date - p.Date <= 28 then p.Customers end as promo_Customers
 from history h asof left join (select Store, Date, Customers from history where Promo = 1 and Open = 1) p on h.Store = p.Store and h.Date > p.Date""",
    "history",
)
def last_promo_day(p: Panel) -> DataFrame:
    """For each row of the gappy history the last open promotion day before it, at most 28 days back, and its guests."""
    days = p.history.filter("Promo = 1 and Open = 1").select("Store", "Date", "Customers")
    return asof.asof(p.history.select("Store", "Date"), days, ("Store",), "Date", ("Customers",), "promo_", tolerance=28, same_day=False)


@query("select h.Store, h.Date, c.Date as closed_Date, c.StateHoliday as closed_StateHoliday from history h asof left join (select Store, Date, StateHoliday from history where Open = 0) c on h.Store = c.Store and h.Date <= c.Date", "history")
def next_closed_day(p: Panel) -> DataFrame:
    """For each row of the gappy history the first closed day from it on, however far."""
    days = p.history.filter("Open = 0").select("Store", "Date", "StateHoliday")
    return asof.asof(p.history.select("Store", "Date"), days, ("Store",), "Date", ("StateHoliday",), "closed_", forward=True)


@query("select Customers as value, count(*) as ties, min(r) + (count(*) - 1) / 2 as rank from (select Customers, rank() over (order by Customers) as r from history where Customers is not null) group by 1", "history")
def guest_ranks(p: Panel) -> DataFrame:
    """Average rank of every number of guests among all rows."""
    return order.average_ranks(p.history, "Customers", "rank")


@query("select DayOfWeek, " + ", ".join(f"round(quantile_cont(Sales::double, {q}), 6) as q{round(1000 * q)}" for q in (0.001, 0.05, 0.5, 0.9, 0.999)) + " from history group by 1", "history")
def sales_quantiles(p: Panel) -> DataFrame:
    """Exact quantiles of sales by weekday."""
    return order.quantiles(p.history, "Sales", {f"q{round(1000 * q)}": q for q in (0.001, 0.05, 0.5, 0.9, 0.999)}, ("DayOfWeek",))


@query(
    """select Store, Date, round((coalesce(s, 0) + 20 * prior) / (c + 20), 6) as store_mean from (
 select Store, Date, sum(target) over w as s, count(target) over w as c from features window w as (partition by Store order by Date range between unbounded preceding and interval 7 day preceding)) f
 left join (select Date, sum(s) over w / nullif(sum(c) over w, 0) as prior from (select Date, sum(target) as s, count(target) as c from features group by 1) window w as (order by Date range between unbounded preceding and interval 7 day preceding)) d using (Date)""",
    "features",
)
def store_means(p: Panel) -> DataFrame:
    """The store as one number: its mean target up to a week before, drawn to that of all stores."""
    return encoding.ordered_means(p.features, "store_id", alias="store_mean").select("Store", "Date", "store_mean")


# Models


@query(
    """select * from (select f.Store, f.Date, round(case when changed then target - ratio + center + sign(score) * 5 * scale else target end, 6) as target, changed from (
 select f.*, coalesce(abs(score) > 5 and not (days_since_reopen <> 'none' or days_to_long_closure <> 'none' or next_holiday <> 'none' or prev_holiday <> 'none' or easter_day <> 'none' or carnival_day <> 'none' or christmas_day <> 'none'), false) as changed, ratio, center, scale, score
 from features f join (select *, case when scale <> 0 then (ratio - center) / scale when ratio <> center then sign(ratio - center) * 'inf'::double end as score from (select *, 1.4826 * quantile_cont(abs(ratio - center), 0.5) over (partition by Store) as scale from (select *, quantile_cont(ratio, 0.5) over (partition by Store) as center from (
 select *, ln(y / nullif(case when count(y) over n >= 3 then quantile_cont(y, 0.5) over n end, 0)) as ratio from (select Store, Date, DayOfWeek, Promo, Customers::double as y from calendar where day_status = 'open' and Date < date '2015-06-20') window n as (partition by Store, DayOfWeek, Promo order by Date rows between 2 preceding and 2 following))))) d using (Store, Date) where target is not null) f)""",
    "features",
)
def clipped_targets(p: Panel) -> DataFrame:
    calendar = p.calendar
    return models.clipped_target(build_features(calendar, p.stores), calendar, "2015-06-20")


@query(
    "select Store, Date, " + ", ".join(f"case isodow(Date) when {d} then 1.0 else 0.0 end::double as dow_{d}" for d in range(1, 8))
    + """, coalesce(Promo, 0)::double as promo, (right(next_holiday, 2) in ('_1', '_2', '_3'))::int::double as before_holiday, (prev_holiday not in ('none'))::int::double as after_holiday,
 (easter_day in ('-6', '-5', '-4', '-3'))::int::double as easter_week, (easter_day = '-1')::int::double as easter_saturday, (month(Date) = 12 and day(Date) between 17 and 23)::int::double as pre_christmas, (month(Date) = 12 and day(Date) in (24, 31))::int::double as short_day,
 (month(Date) = 12 and day(Date) between 27 and 30)::int::double as between_holidays, (month(Date) = 1 and day(Date) between 2 and 6)::int::double as early_january, (carnival_day not in ('none'))::int::double as carnival,
 (days_since_reopen not in ('none'))::int::double as after_reopen, (days_to_long_closure not in ('none'))::int::double as before_closure, """
    + ", ".join(f"round({n}({k} * (2 * pi() * dayofyear(Date) / 365.25)), 6) as {n}_{k}" for k in (1, 2) for n in ("sin", "cos"))
    + " from features",
    "features",
)
def store_model_regressors(p: Panel) -> DataFrame:
    return models.exogenous(p.features)


def model_tables(p: Panel) -> tuple[DataFrame, DataFrame, dict]:
    """Calendar and features, written once for all fits, and the levels of the categories."""
    calendar = kept(p.calendar)
    return calendar, kept(build_features(calendar, p.stores)), category_levels(p.stores)


@query(None)
def ridge_fold_scores(p: Panel) -> DataFrame:
    """Ridge on the expanding folds, scored."""
    calendar, feats, levels = model_tables(p)
    return scoring.fold_scores(scoring.checked(models.run_folds(feats, calendar, models.make_ridge(levels), "ridge")))


@query(None)
def tree_fold_scores(p: Panel) -> DataFrame:
    """Boosted trees at their defaults (150 trees) on the expanding folds, scored."""
    calendar, feats, levels = model_tables(p)
    return scoring.fold_scores(scoring.checked(models.run_folds(feats, calendar, models.make_trees(levels), "trees")))


@query(None)
def store_model_scores(p: Panel) -> DataFrame:
    """Per-store regressions with both kinds of ARIMA errors on the expanding folds, and which has the least mean MAPE."""
    calendar, feats, _ = model_tables(p)
    scores = scoring.fold_scores(scoring.checked(kept(statespace.store_model_folds(calendar, models.exogenous(feats)))))
    best = scores.filter("fold = 'mean'").orderBy("mape", "model").limit(1).select("model", F.lit(True).alias("chosen"))
    return scores.join(F.broadcast(best), "model", "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))


@query(None)
def store_model_parameters(p: Panel) -> DataFrame:
    """phi, theta, deviation, likelihood and the promotion's coefficient of every store's two error models, on all days before the holdout."""
    calendar, feats, _ = model_tables(p)
    return statespace.store_model_parameters(calendar, models.exogenous(feats), "2015-06-20")


@query(None)
def holdout_model_table(p: Panel) -> DataFrame:
    """Baselines, ridge, boosted trees with a segment's own model, and per-store models on the same open days of the holdout: metrics and business figures."""
    calendar, feats, levels = model_tables(p)
    last, make, trees = (baselines.HOLDOUT,), models.make_ridge(levels), boosting.make_best_first(levels)
    parts = [models.run_folds(feats, calendar, make, "ridge", last), models.run_folds(feats, calendar, trees, "best_first_trees", last, segments=("high_check",)), statespace.store_model_folds(calendar, models.exogenous(feats), (1,), last)]
    base = baselines.baseline_predictions(baselines.with_baselines(calendar), baselines.folds(p.spark, last))
    every = kept(scoring.checked(reduce(DataFrame.unionByName, [x.select("Store", "Date", "model", "y", "pred") for x in (base, *parts)])))
    return scoring.metrics(every, "model").join(scoring.business_summary(every, baselines.HOLDOUT[1], "model"), "model")


@query(None)
def ridge_grid(p: Panel) -> DataFrame:
    """Scores of five penalties on the folds and their mean, all from one pass; chosen: least mean MAPE."""
    calendar, feats, levels = model_tables(p)
    family = ridge.fit_family(feats, levels, BASE_NUMERIC, BASE_CATEGORICAL)
    scores = kept(ridge.family_scores(feats, calendar, family, ridge.penalties((0.1, 1.0, 10.0, 100.0, 1000.0))))
    best = scores.filter("fold = 'mean'").orderBy("mape", "model").limit(1).select("model", F.lit(True).alias("chosen"))
    return scores.join(F.broadcast(best), "model", "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))


@query(None)
def feature_ablation(p: Panel) -> DataFrame:
    """Change of mean fold MAPE of ridge without each of the eight groups of features, and the verdict; all from one pass."""
    calendar, feats, levels = model_tables(p)
    family = ridge.fit_family(feats, levels, BASE_NUMERIC, BASE_CATEGORICAL)
    return scoring.compare_to_base(ridge.family_scores(feats, calendar, family, ridge.without_groups()), "all")


@query(None)
def candidate_features(p: Panel) -> DataFrame:
    """Each candidate added to or taken from the base features, the rule's verdict, and all accepted ones together."""
    calendar, feats, levels = model_tables(p)
    return ridge.candidate_search(feats, calendar, ridge.fit_family(feats, levels, apart="store_id"))[0]


@query(None)
def segment_model_decision(p: Panel) -> DataFrame:
    """For each segment the MAPE on its own days of the shared ridge and of its own, by fold, and the rule's verdict."""
    calendar, feats, levels = model_tables(p)
    family = ridge.fit_family(feats, levels, BASE_NUMERIC, BASE_CATEGORICAL, by_segment=True)
    return ridge.segment_decision(feats, calendar, family, levels["segment"])


@query(None)
def tree_grid(p: Panel) -> DataFrame:
    """Fold scores of trees grown best first to 15 and to 63 leaves, after 50, 100 and 150 trees, from one fit a fold each."""
    calendar, feats, levels = model_tables(p)
    makers = {f"leaves={n}": boosting.make_best_first(levels, leaves=n) for n in (15, 63)}
    return boosting.staged_grid(feats, calendar, makers, [50, 100, 150])


@query(None)
def tree_importance(p: Panel) -> DataFrame:
    """Share of each feature in % of the gain in boosted trees (150, best first) of each fold, with mean, least and most."""
    _, feats, levels = model_tables(p)
    return boosting.importance_over_folds(feats, boosting.make_best_first(levels))


@query(None)
def reloaded_model(p: Panel) -> DataFrame:
    """Forecasts of the holdout's open days by a model that was saved and loaded."""
    _, feats, levels = model_tables(p)
    names = [*MODEL_NUMERIC, *CATEGORICAL]
    panel.save_model(models.make_ridge(levels)(scoring.training_rows(feats, "2015-06-20")), {"features": names}, f"{p.folder}/model")
    model, _ = panel.load_model(p.spark, f"{p.folder}/model", names)
    held = feats.filter("day_status = 'open' and Date >= '2015-06-20'")
    return models.forecast(model.transform(held).withColumn("rel", F.col("__pred"))).select("Store", "Date", "forecast")


_figures = "mean_y median_error error_90 within_5 over_10 over_20 bias_pct week_median week_90".split()
_figure = lambda model, prefix: ", ".join(f"max(case when b.model = '{model}' then b.{c} end) as {prefix}{c}" for c in _figures)


@query(
    "select 'baselines' as run, 'median_7_28' as model, " + ", ".join(f"(select round(mape, 6) from scores where model = 'median_7_28' and fold = '{f[0]}') as fold_{f[0]}_mape" for f in baselines.FOLDS)
    + ", (select round(sum(mape) / 3, 6) from scores where model = 'median_7_28') as folds_mape, "
    + ", ".join(f"(select round({e}, 6) from pred where fold = 'holdout' and model = 'median_7_28') as holdout_{m}" for m, e in (("mae", "avg(abs(pred - y))"), ("mape", "avg(abs(pred - y) / y) * 100"), ("wape", "sum(abs(pred - y)) / sum(y) * 100")))
    + ", " + ", ".join(f"(select round(avg(abs(pred - y) / y) * 100, 6) from pred where fold = 'holdout' and model = '{m}') as holdout_mape_{m}" for m in baselines.BASELINES)
    + ", " + _figure("median_7_28", "") + ", " + _figure("lag_7", "lag_7_")
    + " from (select d.*, week_median, week_90 from (select model, round(avg(y), 6) as mean_y, round(median(abs(pred - y)), 6) as median_error, round(quantile_cont(abs(pred - y), 0.9), 6) as error_90, round(100 * avg((abs(pred - y) / y <= 0.05)::int), 6) as within_5,"
    + " round(100 * avg((abs(pred - y) / y > 0.1)::int), 6) as over_10, round(100 * avg((abs(pred - y) / y > 0.2)::int), 6) as over_20, round((sum(pred) / sum(y) - 1) * 100, 6) as bias_pct from pred where fold = 'holdout' group by 1) d"
    + " join (select model, round(median(abs(p / y - 1)) * 100, 6) as week_median, round(quantile_cont(abs(p / y - 1), 0.9) * 100, 6) as week_90 from (select model, Store, (Date - date '2015-06-20') // 7 as week, sum(y) as y, sum(pred) as p from pred where fold = 'holdout' group by 1, 2, 3) group by 1) w using (model)) b",
    "pred",
    "scores",
)
def run_report(p: Panel) -> DataFrame:
    """The full record of a run, with a baseline as the model, so that SQL can say all of it."""
    return forecaster.full_report(p.pred, p.held, "median_7_28", {"run": "baselines"}, "2015-06-20")


@query(None)
def forecaster_report(p: Panel) -> DataFrame:
    """The full record of ridge with a segment's own model: three folds, then fitted on all days before the holdout, saved and loaded as one unit,
    and scored with the baselines on the holdout's open days."""
    calendar, feats, levels = model_tables(p)
    make, name, own = models.make_ridge(levels), "ridge_by_segment", ("high_check",)
    on_folds = models.run_folds(feats, calendar, make, name, segments=own)
    fitted = models.DemandModel(make, own, levels).fit(scoring.training_rows(feats, "2015-06-20"))
    forecaster.save_forecaster(fitted, {"train_end": "2015-06-19"}, f"{p.folder}/forecaster")
    loaded, about = forecaster.load_forecaster(p.spark, f"{p.folder}/forecaster", MODEL_NUMERIC, CATEGORICAL, levels)
    held = feats.filter("day_status = 'open' and Date >= '2015-06-20'")
    y = calendar.select("Store", "Date", F.col("Customers").cast("double").alias("y"))
    pred = loaded.forecast(held).select("Store", "Date", F.lit(name).alias("model"), F.col("forecast").alias("pred")).join(y, ["Store", "Date"])
    every = kept(scoring.checked(p.held.select(*pred.columns).unionByName(pred)))
    return forecaster.full_report(kept(on_folds), every, name, {"run": "forecaster", **about}, "2015-06-20")


@query("select Store, Date, round(median_7_28, 6) as forecast from based where day_status = 'open' and Date >= date '2015-06-20'", "based")
def forecast_of_levels(p: Panel) -> DataFrame:
    """exp(prediction + level), with a baseline's logarithm less the level as the prediction."""
    rows = baselines.with_baselines(p.calendar).filter("day_status = 'open' and Date >= '2015-06-20'").select("Store", "Date", "median_7_28")
    rows = rows.join(p.features.select("Store", "Date", "level"), ["Store", "Date"])
    return models.forecast(rows.withColumn("rel", F.ln("median_7_28") - F.col("level"))).select("Store", "Date", "forecast")


@query(None)
def poisson_bootstrap_draws(p: Panel) -> DataFrame:
    """2000 draws by Poisson weights, the form for very many blocks."""
    return scoring.poisson_bootstrap(scoring.block_sums(p.held, "2015-06-20"))


@query(None)
def multinomial_bootstrap_draws(p: Panel) -> DataFrame:
    """2000 exact resamples by binomial splitting, the form for very many blocks."""
    return scoring.multinomial_bootstrap(scoring.block_sums(p.held, "2015-06-20"))


@query(None)
def weekly_forecast(p: Panel) -> DataFrame:
    """The serving path: a model with an own one for a segment, on all history before the holdout, forecasts all good requests."""
    history, plan, stores = p.history, p.plan, p.stores
    good = kept(forecast.good(forecast.check_requests(p.requests, history, plan)))
    _, feats, levels = model_tables(p)
    model = models.DemandModel(models.make_ridge(levels), levels=levels).fit(scoring.training_rows(feats, "2015-06-20"))
    return forecast.forecast_weeks(good, history, plan, stores, model.forecast)
