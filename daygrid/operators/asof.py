"""As-of joins for data with gaps: the nearest row of another table before (or after) each row, by key.

Both tables are put under each other, sorted by day within the key, and each row takes the last one of the other table that it has passed:
one exchange, no pairs. With a tolerance the key is cut into stretches of that many days and the other table's rows are given to their own
stretch and the next, so that a key with very many rows is dealt to many tasks; without one a key is sorted in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, keys: tuple[str, ...], day: str, columns: tuple[str, ...], prefix: str = "asof_", forward: bool = False, tolerance: int | None = None, same_day: bool = True) -> DataFrame:
    """left with prefix + day and prefix + columns of the nearest row of right whose keys are equal: the latest not after the row's day, or the
    first not before it (forward); with same_day=False strictly before or after; with a tolerance at most so many days away. Of right's
    rows of one key and day the greatest by the columns is taken. Rows of left without a key or day keep nulls; such rows of right match nothing."""
    number = F.unix_date(day) * (-1 if forward else 1)
    names = [f"__l{i}" for i in range(len(left.columns))]
    kept = left.select(F.struct(*[F.col(f"`{c}`").alias(n) for c, n in zip(left.columns, names)]).alias("l"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], number.alias("t"), F.lit(None).alias("r"), F.lit(True).alias("asks"))
    other = right.select(F.lit(None).alias("l"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], number.alias("t"), F.struct(F.col(day).alias("day"), *columns).alias("r"), F.lit(False).alias("asks"))
    own = [f"__k{i}" for i in range(len(keys))]
    for c in (*own, "t"):
        other = other.filter(F.col(c).isNotNull())
    if tolerance is not None:
        stretch = F.floor(F.col("t") / max(tolerance, 1))
        kept = kept.withColumn("stretch", stretch)
        other = other.withColumn("stretch", F.explode(F.array(stretch, stretch + 1)))
        own.append("stretch")
    # Of equal days the other table's rows come first if they count, and last if they don't.
    order = Window.partitionBy(*own).orderBy("t", F.col("asks") if same_day else ~F.col("asks"), F.col("r")).rowsBetween(Window.unboundedPreceding, 0)
    rows = kept.unionByName(other, allowMissingColumns=True).withColumn("found", F.last(F.when(~F.col("asks"), F.struct("t", "r")), ignorenulls=True).over(order)).filter("asks")
    there = F.col("t").isNotNull()
    for k in own[: len(keys)]:
        there = there & F.col(k).isNotNull()
    if tolerance is not None:
        there = there & (F.col("t") - F.col("found.t") <= tolerance)
    got = F.when(there, F.col("found.r"))
    return rows.select(*[F.col(f"l.{n}").alias(c) for c, n in zip(left.columns, names)], got["day"].alias(f"{prefix}{day}"), *[got[c].alias(f"{prefix}{c}") for c in columns])
