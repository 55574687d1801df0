"""Reading, checking and writing store-day panels."""

from __future__ import annotations

import json
import tempfile

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HISTORY = T.StructType(
    [T.StructField(n, t) for n, t in (("Store", T.IntegerType()), ("DayOfWeek", T.IntegerType()), ("Date", T.DateType()), ("Sales", T.IntegerType()), ("Customers", T.IntegerType()), ("Open", T.IntegerType()), ("Promo", T.IntegerType()), ("StateHoliday", T.StringType()), ("SchoolHoliday", T.IntegerType()))]
)
PLAN = T.StructType([f for f in HISTORY.fields if f.name not in ("Sales", "Customers")])
HOLIDAYS = ("0", "a", "b", "c")
FLAGS = ("Open", "Promo", "SchoolHoliday")


def work_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session may go without; it gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or tempfile.mkdtemp(prefix="panel-")


def read(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A CSV file with a header, or Parquet, by the path's ending; columns cast to the schema where one is given."""
    if path.rstrip("/").endswith(".csv"):
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    df = spark.read.parquet(path)
    return df.select([F.col(f.name).cast(f.dataType) for f in schema.fields]) if schema else df


def load_history(spark: SparkSession, path: str) -> DataFrame:
    return validate(read(spark, path, HISTORY), HISTORY.names, "history")


def load_plan(spark: SparkSession, path: str) -> DataFrame:
    return validate(read(spark, path, PLAN), PLAN.names, "plan", allow_missing_open=True)


def with_selection(stores: DataFrame, selected: DataFrame) -> DataFrame:
    """The store dimension with the flags of the selected stores; the dimension's own store type stays. The selection is a sample of
    stores, small beside the history; Spark broadcasts it by its size."""
    return stores.join(selected.drop("StoreType"), "Store", "left")


def violations(df: DataFrame, allow_missing_open: bool = False, holidays=HOLIDAYS) -> DataFrame:
    """One row per rule with the number of rows against it: one pass for the row rules, one grouped pass for duplicates."""
    bad: dict[str, Column] = {"null_date": F.col("Date").isNull(), "day_of_week": F.col("DayOfWeek") != F.weekday("Date") + 1}
    for flag in FLAGS:
        wrong = ~F.col(flag).isin(0, 1)
        bad[flag] = F.coalesce(wrong, F.lit(not (allow_missing_open and flag == "Open")))
    bad["StateHoliday"] = F.coalesce(~F.col("StateHoliday").isin(*holidays), F.lit(True))
    for number in ("Sales", "Customers"):
        if number in df.columns:
            bad[number] = F.coalesce(F.col(number) < 0, F.lit(True))
    rows = df.agg(*[F.count_if(c).alias(k) for k, c in bad.items()])
    rows = rows.select(F.explode(F.create_map(*[x for k in bad for x in (F.lit(k), F.col(k))])).alias("rule", "count"))
    twice = df.groupBy("Store", "Date").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("count")).select(F.lit("duplicate").alias("rule"), "count")
    return rows.unionByName(twice)


def validate(df: DataFrame, columns, name: str, allow_missing_open: bool = False) -> DataFrame:
    """The frame unchanged, or one error that names every problem, with up to five of the values at fault."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{name}: missing columns {missing}")
    found = []
    for r in violations(df, allow_missing_open).filter("count > 0").orderBy("rule").collect():
        values = [x[0] for x in df.select(r["rule"]).distinct().orderBy(r["rule"]).limit(5).collect()] if r["rule"] in df.columns else []
        found.append(f"{r['rule']}: {r['count']} rows" + (f", among {values}" if values else ""))
    if found:
        raise ValueError(f"{name}: " + "; ".join(found))
    return df


def raw_problems(tables: dict[str, DataFrame], expected: dict[str, tuple[list[str], int | None]]) -> DataFrame:
    """name, problem, detail of raw tables: absent ones, columns that lack, row counts that differ."""
    spark = next(iter(tables.values())).sparkSession
    out = spark.createDataFrame([], "name string, problem string, detail string")
    row = lambda df, name, problem, detail: df.select(F.lit(name).alias("name"), F.lit(problem).alias("problem"), detail.alias("detail"))
    for name, (columns, rows) in expected.items():
        df = tables.get(name)
        if df is None:
            out = out.unionByName(row(spark.range(1), name, "absent", F.lit("")))
            continue
        lack = [c for c in columns if c not in df.columns]
        if lack:
            out = out.unionByName(row(spark.range(1), name, "missing columns", F.lit(", ".join(lack))))
        if rows is not None:
            n = df.agg(F.count("*").alias("n")).filter(F.col("n") != rows)
            out = out.unionByName(row(n, name, "rows", F.concat(F.col("n").cast("string"), F.lit(f", {rows} expected"))))
    return out


def check_tables(tables: dict[str, DataFrame], expected: dict[str, tuple[list[str], int | None]]) -> list[str]:
    """The same as a list of sentences."""
    return [f"{r['name']}: {r['problem']} {r['detail']}".rstrip() for r in raw_problems(tables, expected).collect()]


def only_selected(df: DataFrame, selected: DataFrame) -> DataFrame:
    return df.join(selected.select("Store"), "Store", "left_semi")


def build_processed(history: DataFrame, plan: DataFrame, stores: DataFrame, selected: DataFrame, out: str) -> None:
    """Write the three tables of the selected stores, the day tables sorted by store and day."""
    only_selected(history, selected).select(HISTORY.names).orderBy("Store", "Date").write.mode("overwrite").parquet(f"{out}/history")
    only_selected(plan, selected).select(PLAN.names).orderBy("Store", "Date").write.mode("overwrite").parquet(f"{out}/plan")
    only_selected(stores, selected).orderBy("Store").write.mode("overwrite").parquet(f"{out}/stores")


def log_run(spark: SparkSession, record: dict, path: str) -> None:
    """Append a run; its new fields become columns of the log."""
    spark.createDataFrame([record]).write.mode("append").parquet(path)


def runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def save_bucketed(df: DataFrame, table: str, buckets: int, path: str | None = None) -> DataFrame:
    """The panel as a table bucketed by Store and sorted by Store and Date, one file a bucket, in the warehouse or at a path that all executors
    share. What is keyed by store reads it without an exchange; take about as many buckets as a job has tasks at once."""
    out = df.repartition(buckets, "Store").write.mode("overwrite").format("parquet").bucketBy(buckets, "Store").sortBy("Store", "Date")
    (out.option("path", path) if path else out).saveAsTable(table)
    return df.sparkSession.table(table)


def with_records(log: DataFrame, more: DataFrame) -> DataFrame:
    """Two parts of a log as one, with all fields of both."""
    return log.unionByName(more, allowMissingColumns=True)


def forecast_display(forecast: DataFrame) -> DataFrame:
    """The forecast table as shown: formatted date, day name, yes/no, whole numbers, actual left null where unknown."""
    yes = lambda c: F.when(F.col(c) == 1, "yes").otherwise("no")
    whole = lambda c: F.round(c).cast("int").alias(c)
    return forecast.select("Store", F.date_format("Date", "dd.MM.yyyy").alias("date"), F.date_format("Date", "EEEE").alias("day"), yes("Open").alias("open"), yes("Promo").alias("promo"), whole("forecast"), whole("baseline_lag_7"), whole("actual"))


def save_model(model, metadata: dict, path: str) -> None:
    """An ML pipeline model with its metadata beside it (one JSON row)."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(metadata),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load_model(spark: SparkSession, path: str, features: list[str]):
    """The model, refused if it was trained on another list of features or another order."""
    metadata = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    had = metadata["features"]
    if had != list(features):
        gone, new = [f for f in had if f not in features], [f for f in features if f not in had]
        raise ValueError(f"model of other features: removed {gone}, added {new}" + ("" if gone or new else ", order differs"))
    return PipelineModel.load(f"{path}/model"), metadata
