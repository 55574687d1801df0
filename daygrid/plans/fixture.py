"""A store-day panel derived from lineitem, the same in Spark and in DuckDB: supplier groups are stores, ship dates fold into 942 days,
quantities are guests; fixed rules add closures, gaps, anomalies, promotions and holidays, and fill the calendar of every fourth store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

END = "2015-07-31"

HISTORY_SQL = """
with raw as (
  select cast(l_suppkey // 5 as integer) + 1 as Store,
         date '2013-01-01' + cast(date_diff('day', date '1995-01-01', cast(l_shipdate as date)) % 942 as integer) as Date,
         cast(l_quantity as bigint) as q, cast(round(l_extendedprice) as bigint) as p from lineitem),
base as (
  select Store, Date, cast(sum(q) as integer) as q, cast(sum(p) as bigint) as p from (
    select * from raw union all
    select Store, Date, cast(10 + (Store * 13 + day(Date) * 7 + month(Date)) % 23 as bigint) as q, cast(900 + (Store * 31 + day(Date)) % 700 as bigint) as p
    from (select Store, cast(unnest(generate_series(date '2013-01-01', date '2015-07-31', interval 1 day)) as date) as Date from (select distinct Store from raw) s) f
    where Store % 4 = 2) u group by Store, Date),
x as (
  select *, isodow(Date) as dow, strftime(Date, '%m-%d') as md,
    case when isodow(Date) = 7 and Store % 8 <> 0 then 0
         when Store % 10 = 3 and Date between date '2014-03-10' and date '2014-03-19' then 0
         when Store % 13 = 6 and Date between date '2014-02-01' and date '2014-04-30' then 0
         when Store % 9 = 4 and Date <= date '2013-01-20' then 0
         when strftime(Date, '%m-%d') in ('01-01','05-01','10-03','12-25','12-26') and Store % 8 <> 0 then 0
         else 1 end as Open
  from base where not (Store % 6 = 1 and Date between date '2014-07-01' and date '2014-12-31'))
select Store, cast(dow as integer) as DayOfWeek, Date,
  case when Open = 0 or (Store % 7 = 2 and Date = date '2014-05-20') then 0 else p end as Sales,
  case when Open = 0 or (Store % 7 = 2 and Date = date '2014-05-20') then 0 else q end as Customers,
  Open,
  case when dow < 6 and weekofyear(Date) % 2 = 0 then 1 else 0 end as Promo,
  case when md in ('12-25','12-26') then 'c'
       when Date in (date '2013-04-01', date '2014-04-21', date '2015-04-06') then 'b'
       when md in ('01-01','05-01','10-03') then 'a' else '0' end as StateHoliday,
  case when month(Date) in (7, 8) then 1 else 0 end as SchoolHoliday
from x"""

STORES_SQL = """
select Store,
  case when Store % 17 = 0 then 'b' when Store % 3 = 0 then 'd' when Store % 5 = 0 then 'c' else 'a' end as StoreType,
  case when Store % 34 = 0 then 'b' when Store % 2 = 0 then 'c' else 'a' end as Assortment,
  case when Store % 50 = 0 then null else cast(20 + (Store * 7919) % 20000 as double) end as CompetitionDistance,
  case when Store % 3 = 1 or Store % 50 = 0 then null else cast(1 + Store % 12 as double) end as CompetitionOpenSinceMonth,
  case when Store % 3 = 1 or Store % 50 = 0 then null else cast(2008 + Store % 8 as double) end as CompetitionOpenSinceYear,
  Store % 2 as Promo2,
  case when Store % 2 = 1 then cast(1 + (Store * 5) % 50 as double) end as Promo2SinceWeek,
  case when Store % 2 = 1 then cast(2009 + Store % 6 as double) end as Promo2SinceYear,
  case when Store % 2 = 1 then case Store % 3 when 0 then 'Jan,Apr,Jul,Oct' when 1 then 'Feb,May,Aug,Nov' else 'Mar,Jun,Sept,Dec' end end as PromoInterval
from (select distinct Store from history) s"""

PLAN_SQL = """
select Store, cast(isodow(Date) as integer) as DayOfWeek, Date,
  case when Store % 11 = 5 and Date = date '2015-08-20' then null when isodow(Date) = 7 and Store % 8 <> 0 then 0 else 1 end as Open,
  case when isodow(Date) < 6 and weekofyear(Date) % 2 = 0 then 1 else 0 end as Promo,
  case when Store % 2 = 0 and Date = date '2015-08-15' then 'a' else '0' end as StateHoliday,
  case when month(Date) in (7, 8) then 1 else 0 end as SchoolHoliday
from (select Store, cast(unnest(generate_series(date '2015-08-01', date '2015-09-17', interval 1 day)) as date) as Date
      from (select distinct Store from history where Store % 4 <> 0) s) p"""

ORIGINS = ("2014-03-15", "2015-06-20", "2015-07-11", "2015-08-01")
REQUESTS_SQL = f"""
select Store as restaurant, cast(o as date) as origin from (select distinct Store from history) s, (select unnest({list(ORIGINS)}) as o) r
union all select 0, date '2015-07-11' union all select 999999, date '2015-07-11' union all select 1, date '2012-01-01'
union all select 1, date '2013-01-05' union all select 1, date '2026-10-01'"""


def spark_text(sql: str) -> str:
    """The same text in Spark's dialect."""
    for old, new in (
        ("l_suppkey // 5", "l_suppkey div 5"),
        ("date '2013-01-01' + cast(date_diff('day', date '1995-01-01', cast(l_shipdate as date)) % 942 as integer)", "date_add(date'2013-01-01', cast(datediff(cast(l_shipdate as date), date'1995-01-01') % 942 as int))"),
        ("cast(unnest(generate_series(date '2013-01-01', date '2015-07-31', interval 1 day)) as date)", "explode(sequence(date'2013-01-01', date'2015-07-31'))"),
        ("isodow(Date)", "(weekday(Date) + 1)"),
        ("strftime(Date, '%m-%d')", "date_format(Date, 'MM-dd')"),
        ("cast(unnest(generate_series(date '2015-08-01', date '2015-09-17', interval 1 day)) as date)", "explode(sequence(date'2015-08-01', date'2015-09-17'))"),
        (f"(select unnest({list(ORIGINS)}) as o)", f"(select explode(array{ORIGINS}) as o)"),
    ):
        sql = sql.replace(old, new)
    return sql


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(spark_text(HISTORY_SQL).replace("from lineitem", "from {lineitem}"), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def _over(spark: SparkSession, sql: str, days: DataFrame) -> DataFrame:
    return spark.sql(spark_text(sql).replace("from history", "from {history}"), history=days)


def stores(spark: SparkSession, days: DataFrame) -> DataFrame:
    return _over(spark, STORES_SQL, days)


def plan(spark: SparkSession, days: DataFrame) -> DataFrame:
    return _over(spark, PLAN_SQL, days)


def requests(spark: SparkSession, days: DataFrame) -> DataFrame:
    return _over(spark, REQUESTS_SQL, days)
