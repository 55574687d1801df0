"""DuckDB text of the panel, its calendar, baselines and features, as one chain of common table expressions."""

from __future__ import annotations

from .fixture import END, HISTORY_SQL, PLAN_SQL, REQUESTS_SQL, STORES_SQL

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, needs: tuple[str, ...], sql: str) -> None:
    CTES[name] = (needs, sql)


def text(sql: str, *needs: str) -> str:
    """A query with the tables that it needs in front."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in CTES[name][0]:
            add(n)
        if name not in order:
            order.append(name)

    for n in needs:
        add(n)
    if not order:
        return sql
    return "with " + ",\n".join(f"{n} as materialized ({CTES[n][1]})" for n in order) + "\n" + sql


cte("history", (), HISTORY_SQL)
cte("stores", ("history",), STORES_SQL)
cte("plan", ("history",), PLAN_SQL)
cte("requests", ("history",), REQUESTS_SQL)
cte("cal0", ("history",), f"""
 select s.Store, cast(g.d as date) as Date, cast(isodow(g.d) as integer) as DayOfWeek, h.Sales, h.Customers, h.Open, h.Promo, h.StateHoliday, h.SchoolHoliday
 from (select distinct Store from history) s cross join (select unnest(generate_series((select min(Date) from history), date '{END}', interval 1 day)) as d) g
 left join history h on h.Store = s.Store and h.Date = cast(g.d as date)""")
cte("cal1", ("cal0",), "select *, coalesce(Open = 0, false) as c, lag(coalesce(Open = 0, false)) over (partition by Store order by Date) as pc from cal0")
cte("cal2", ("cal1",), "select *, sum(case when c <> pc then 1 else 0 end) over (partition by Store order by Date) as run from cal1")
cte("cal3", ("cal2",), "select *, case when c then count(*) over (partition by Store, run) end as closure_run_days from cal2")
cte("calendar", ("cal3",), """
 select Store, Date, DayOfWeek, Sales, Customers, Open, Promo, StateHoliday, SchoolHoliday, cast(closure_run_days as integer) as closure_run_days, day_status,
  case when day_status in ('open', 'closed') then cast(Customers as double) end as customers_clean, case when day_status in ('open', 'closed') then cast(Sales as double) end as sales_clean
 from (select *, case when Open is null then 'missing_export' when closure_run_days >= 3 then 'absent' when c then 'closed' when Customers = 0 then 'anomaly' else 'open' end as day_status from cal3)""")
cte("folds", (), """
 select * from (values ('winter', date '2014-12-06', date '2015-01-16'), ('spring', date '2015-03-28', date '2015-05-08'),
  ('summer', date '2015-05-09', date '2015-06-19'), ('holdout', date '2015-06-20', date '2015-07-31')) t(fold, start, "end")""")
cte("based", ("calendar",), """
 select *, v7.v as lag_7, v14.v as lag_14, coalesce(m, v7.v) as median_7_28, v7.d as lag_7_day, v14.d as lag_14_day, v7.p as lag_7_promo, v14.p as lag_14_promo from (
 select *, last_value(v ignore nulls) over (partition by Store, DayOfWeek order by Date rows between 52 preceding and 1 preceding) as v7,
  last_value(v ignore nulls) over (partition by Store, date_diff('day', date '1970-01-01', Date) % 14 order by Date rows between 26 preceding and 1 preceding) as v14,
  quantile_cont(v.v, 0.5) over (partition by Store, DayOfWeek order by Date rows between 4 preceding and 1 preceding) as m
 from (select *, case when day_status = 'open' then {'d': Date, 'v': cast(Customers as double), 'p': Promo} end as v from calendar))""")
cte("pred", ("based", "folds"), """
 select b.Store, b.Date, b.DayOfWeek, b.Promo, f.fold, f.start, cast(b.Customers as double) as y, u.model, u.pred, u.from_day, u.from_promo
 from based b join folds f on b.Date between f.start and f."end",
 lateral (select 'lag_7' as model, b.lag_7 as pred, b.lag_7_day as from_day, b.lag_7_promo as from_promo union all select 'lag_14', b.lag_14, b.lag_14_day, b.lag_14_promo union all select 'median_7_28', b.median_7_28, null, null) u
 where b.day_status = 'open'""")
cte("scores", ("pred",), "select model, fold, avg(abs(pred - y)) as mae, avg(abs(pred - y) / y) * 100 as mape, sum(abs(pred - y)) / sum(y) * 100 as wape from pred where fold in ('winter', 'spring', 'summer') group by 1, 2")
cte("all_scores", ("scores",), "select * from scores union all select model, 'mean', sum(mae) / 3, sum(mape) / 3, sum(wape) / 3 from scores group by 1")
cte("raw_runs", ("history",), """
 select Store, min(Date) as start, max(Date) as "end", cast(count(*) as integer) as days, bool_or(coalesce(StateHoliday, '0') <> '0') as has_holiday
 from (select *, Date - cast(row_number() over (partition by Store order by Date) as integer) as run from history where Open = 0) group by Store, run""")
cte("runs", ("raw_runs", "history"), """
 select *, days >= 3 as is_long, start = (select min(Date) from history) as is_left_censored, "end" >= date '2015-06-20' as in_test, "end" = (select max(Date) from history) as not_finished from raw_runs""")
cte("per_store_long", ("raw_runs", "stores"), "select s.Store, s.StoreType, coalesce(n, 0) as n_long_closures from stores s left join (select Store, count(*) as n from raw_runs where days >= 3 group by 1) r on r.Store = s.Store")
cte("gaps", ("history",), """
 select *, date_diff('day', start, "end") + 1 as days from (
 select Store, 'inner' as kind, p + 1 as start, Date - 1 as "end" from (select Store, Date, lag(Date) over (partition by Store order by Date) as p from history) where date_diff('day', p, Date) > 1
 union all select Store, 'leading', (select min(Date) from history), min(Date) - 1 from history group by 1 having min(Date) > (select min(Date) from history)
 union all select Store, 'trailing', max(Date) + 1, (select max(Date) from history) from history group by 1 having max(Date) < (select max(Date) from history))""")
cte("easter", ("calendar",), """
 select y, make_date(y, m, d) as easter from (
 select y, cast(floor((h+l-7*mm+114)/31) as int) m, cast((h+l-7*mm+114)%31+1 as int) d from (
 select *, cast(floor((a+11*h+22*l)/451) as int) mm from (
 select *, cast((32+2*e+2*i-h-k)%7 as int) l from (
 select *, cast((19*a+b-dd-g+15)%30 as int) h, cast(floor(c/4) as int) i, cast(c%4 as int) k from (
 select *, cast(floor((b-f+1)/3) as int) g from (
 select *, cast(floor(b/4) as int) dd, cast(b%4 as int) e, cast(floor((b+8)/25) as int) f from (
 select y, cast(y%19 as int) a, cast(floor(y/100) as int) b, cast(y%100 as int) c from (select distinct cast(year(Date) as int) as y from calendar))))))))""")
cte("lv0", ("calendar",), "select *, day_status = 'open' as o, case when day_status = 'open' then ln(Customers) end as lg from calendar")
cte("lv1", ("lv0",), """
 select *, case when o and count(lg) over r >= 12 then avg(lg) over r end as own,
  last_value(case when o then Date end ignore nulls) over (partition by Store order by Date rows between unbounded preceding and 7 preceding) as last_open
 from lv0 window r as (partition by Store, o order by Date rows between 23 preceding and current row)""")
cte("lv2", ("lv1",), "select *, lag(own, 7) over (partition by Store order by Date) as late from lv1")
cte("lv3", ("lv2",), "select *, last_value(late ignore nulls) over (partition by Store order by Date rows between unbounded preceding and current row) as level from lv2")
cte("leveled", ("lv3",), "select *, case when date_diff('day', last_open, Date) > 28 then 28 else date_diff('day', last_open, Date) end::double as level_age, lg - level as target from lv3")
cte("lagged", ("leveled",), """
 select *, coalesce(lag_7, lag_14, lag_21, lag_28) as lag_filled,
  case when lag_7 is not null then 1.0 when lag_14 is not null then 2.0 when lag_21 is not null then 3.0 when lag_28 is not null then 4.0 end::double as lag_filled_weeks,
  list_median(list_filter([lag_7, lag_14, lag_21, lag_28], lambda x: x is not null)) as lag_median from (
 select *, lag(lg, 7) over w - level as lag_7, lag(lg, 14) over w - level as lag_14, lag(lg, 21) over w - level as lag_21, lag(lg, 28) over w - level as lag_28,
  lag(Promo::double, 7) over w as promo_lag_7, lag(Promo::double, 14) over w as promo_lag_14, lag(Promo::double, 21) over w as promo_lag_21, lag(Promo::double, 28) over w as promo_lag_28,
  lag(target, 364) over w as rel_364 from leveled window w as (partition by Store order by Date))""")
cte("ev0", ("calendar", "easter"), """
 select c.Store, c.Date, date_diff('day', e.easter, c.Date) as ed,
  first_value(case when coalesce(StateHoliday, '0') <> '0' then {'d': Date, 'k': StateHoliday} end ignore nulls) over (partition by Store order by Date rows between current row and 3 following) as nx,
  last_value(case when coalesce(StateHoliday, '0') <> '0' then {'d': Date, 'k': StateHoliday} end ignore nulls) over (partition by Store order by Date rows between 3 preceding and 1 preceding) as pv,
  last_value(case when day_status in ('absent', 'anomaly') then Date end ignore nulls) over (partition by Store order by Date rows between unbounded preceding and current row) as away,
  first_value(case when day_status = 'absent' then Date end ignore nulls) over (partition by Store order by Date rows between current row and unbounded following) as leaves
 from calendar c join easter e on e.y = year(c.Date)""")
cte("events", ("ev0",), """
 select Store, Date, case when nx is null then 'none' else nx.k || '_' || date_diff('day', Date, nx.d) end as next_holiday,
  case when pv is null then 'none' else pv.k || '_' || date_diff('day', pv.d, Date) end as prev_holiday,
  case when ed between -7 and 1 then ed::varchar else 'none' end as easter_day, case when ed + 48 between -4 and 1 then (ed + 48)::varchar else 'none' end as carnival_day,
  case when strftime(Date, '%m-%d') >= '12-01' or strftime(Date, '%m-%d') <= '01-06' then strftime(Date, '%m-%d') else 'none' end as christmas_day,
  case when Date > away and Date <= away + 14 then (Date - away - 1)::varchar else 'none' end as days_since_reopen,
  case when leaves > Date and leaves <= Date + 7 then (leaves - Date)::varchar else 'none' end as days_to_long_closure from ev0""")
cte("dim", ("stores",), """
 select *, case StoreType when 'b' then 'high_traffic' when 'a' then 'mid' when 'c' then 'mid' when 'd' then 'high_check' end as segment,
  case when CompetitionOpenSinceYear is not null and CompetitionOpenSinceMonth is not null then make_date(CompetitionOpenSinceYear::bigint, CompetitionOpenSinceMonth::bigint, 1) end as since,
  case when Promo2 = 1 and Promo2SinceYear is not null then date_trunc('week', make_date(Promo2SinceYear::bigint, 1, 4))::date + (7 * (Promo2SinceWeek - 1))::integer end as p2 from stores""")
cte("features", ("lagged", "events", "dim"), """
 select l.Store, l.Date, l.DayOfWeek, l.Promo::double as Promo, l.SchoolHoliday::double as SchoolHoliday, l.day_status, l.level, l.target, level_age, lag_7, lag_14, lag_21, lag_28,
  promo_lag_7, promo_lag_14, promo_lag_21, promo_lag_28, lag_filled, lag_filled_weeks, lag_median, rel_364, month(l.Date) as month, day(l.Date)::double as day_of_month,
  next_holiday, prev_holiday, easter_day, carnival_day, christmas_day, days_since_reopen, days_to_long_closure, segment, Assortment, l.Store::varchar as store_id,
  case when CompetitionDistance is not null and (since is null or l.Date >= since) then 1.0 else 0.0 end::double as competition_open,
  case when CompetitionDistance is not null and (since is null or l.Date >= since) then ln(CompetitionDistance) end as competition_distance_log,
  case when l.Date >= p2 then 1.0 else 0.0 end::double as promo2_active
 from lagged l join events e on e.Store = l.Store and e.Date = l.Date join dim d on d.Store = l.Store""")
