"""Numbers in place of a category with very many levels, such as the store: no column per level, whatever their number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .features import HORIZON

#: Rows that the prior counts for.
PRIOR = 20.0


def ordered_means(rows: DataFrame, key: str, target: str = "target", day: str = "Date", horizon: int = HORIZON, prior: float = PRIOR, alias: str = "key_mean") -> DataFrame:
    """rows with alias: the mean target of the key on days at least `horizon` before, drawn to that of all keys on those days as if that
    counted for `prior` rows; null while no key has such a day. A day never sees its own week or later. The mean of all keys comes from one row a day."""
    back = -horizon
    number = F.unix_date(day)
    known = Window.partitionBy(key).orderBy(number).rangeBetween(Window.unboundedPreceding, back)
    daily = rows.groupBy(day).agg(F.sum(target).alias("s"), F.count(target).alias("c"))
    before = Window.orderBy(number).rangeBetween(Window.unboundedPreceding, back)  # over days, which are few
    overall = daily.select(F.col(day).alias("__day"), (F.sum("s").over(before) / F.nullif(F.sum("c").over(before), F.lit(0))).alias("__prior"))
    total, count = F.coalesce(F.sum(target).over(known), F.lit(0.0)), F.count(target).over(known)
    held = rows.withColumn("__s", total).withColumn("__c", count)
    out = held.join(F.broadcast(overall), F.col(day) == F.col("__day"), "left")
    return out.withColumn(alias, (F.col("__s") + prior * F.col("__prior")) / (F.col("__c") + prior)).drop("__s", "__c", "__day", "__prior")


def hashed(column: Column, width: int) -> tuple[Column, Column]:
    """Place 0 .. width - 1 and sign of a value by signed feature hashing; null has place null."""
    h = F.xxhash64(column.cast("string"))
    place = F.when(column.isNotNull(), F.pmod(F.shiftrightunsigned(h, 1), F.lit(width)).cast("int"))
    return place, F.when(h.bitwiseAND(F.lit(1)) == 1, 1.0).otherwise(-1.0)


def hashed_columns(rows: DataFrame, column: str, width: int, prefix: str) -> DataFrame:
    """rows with prefix0 .. prefix{width - 1}: the sign at the value's place, 0 elsewhere."""
    place, sign = hashed(F.col(column), width)
    return rows.select("*", *[F.when(place == i, sign).otherwise(0.0).alias(f"{prefix}{i}") for i in range(width)])
