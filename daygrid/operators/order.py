"""Ranks and exact quantiles over all rows of a table, or of a few large groups, in two passes and no window without a key.

Rows are counted by distinct value, the distinct values are dealt to ranges, and each range's total is brought to the driver (one number a
range and group). A value's rank is then the totals of the ranges before it and a running sum inside its range; a quantile looks only into
the ranges that hold its two neighbours. Ranges are cut by a checkpoint, so both passes see the same ones."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.panel import work_folder

#: Totals that may be brought to the driver: ranges plus groups. Quantiles of very many groups are percentile() by key.
MAX_TOTALS = 100_000


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(work_folder(df.sparkSession))
    return df.checkpoint()


def ranges(df: DataFrame, value: str, keys: tuple[str, ...] = ()) -> tuple[DataFrame, list]:
    """keys, value, ties, part: the distinct values in ranges; and (keys, part, rows before the part, rows in it), in order. Nulls are left out."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("value")).agg(F.count("*").alias("ties"))
    dealt = cut(counts.repartitionByRange(*keys, "value").withColumn("part", F.spark_partition_id()))
    totals = dealt.groupBy("part", *keys).agg(F.sum("ties").alias("n")).limit(MAX_TOTALS + 1).collect()
    if len(totals) > MAX_TOTALS:
        raise ValueError(f"more than {MAX_TOTALS} ranges and groups: take percentile() by key")
    before: dict[tuple, int] = {}
    found = []
    for r in sorted(totals, key=lambda r: r["part"]):
        key = tuple(r[k] for k in keys)
        found.append((key, r["part"], before.get(key, 0), r["n"]))
        before[key] = before.get(key, 0) + r["n"]
    return dealt, found


def _inside(keys: tuple[str, ...]) -> Window:
    return Window.partitionBy("part", *keys).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)


def average_ranks(df: DataFrame, column: str, alias: str) -> DataFrame:
    """value, ties and the average rank of the rows that have it."""
    dealt, totals = ranges(df, column)
    spark = df.sparkSession
    offset = spark.createDataFrame([(part, before) for _, part, before, _ in totals], "part int, before long")
    rows = dealt.join(F.broadcast(offset), "part")
    below = F.col("before") + F.coalesce(F.sum("ties").over(_inside(())), F.lit(0))
    return rows.select("value", "ties", (below + (F.col("ties") + 1) / 2).alias(alias))


def quantiles(df: DataFrame, column: str, probs: dict[str, float], keys: tuple[str, ...] = ()) -> DataFrame:
    """keys and a column for each named probability: exact quantiles, interpolated between neighbours like percentile(). Without keys one row,
    null where there is no value; groups without a value have no row."""
    dealt, totals = ranges(df.select(*keys, F.col(column).cast("double").alias("__v")), "__v", keys)
    size: dict[tuple, int] = {}
    for key, _, before, n in totals:
        size[key] = before + n
    wanted = []
    for key, part, before, n in totals:
        for name, p in probs.items():
            at = (size[key] - 1) * p
            low = math.floor(at)
            for rank, weight in ((low, 1 - (at - low)), (low + 1, at - low)):
                if weight and before <= rank < before + n:
                    wanted.append((*key, part, name, rank - before, weight))
    kinds = dict(dealt.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "part int", "name string", "rank long", "weight double"])
    asked = df.sparkSession.createDataFrame(wanted, schema)
    hit = dealt.join(F.broadcast(asked.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("part").alias("__part")).distinct()), _same(keys), "left_semi")
    hit = hit.withColumn("below", F.coalesce(F.sum("ties").over(_inside(keys)), F.lit(0)))
    asked = asked.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("part").alias("__part"), "name", "rank", "weight")
    got = hit.join(F.broadcast(asked), _same(keys) & (F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("below") + F.col("ties")))
    each = [F.sum(F.when(F.col("name") == name, F.col("weight") * F.col("value"))).alias(name) for name in probs]
    return got.groupBy(*keys).agg(*each)


def _same(keys: tuple[str, ...]):
    on = F.col("part") == F.col("__part")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return on
