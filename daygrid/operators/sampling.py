"""Balanced stratified sampling of stores. Order within a stratum is md5(seed|Store), so a draw can be repeated in any engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .audit import quantile_bin

SUBSET_SIZE, MIN_PER_SEGMENT, SEED = 40, 5, 42
# Stores that the sample must hold at least, by flag, filled in this order; and features that it is uneven in by design.
MANDATORY = {"has_left_censored": 1, "has_anomaly": 3, "has_export_gap": 3, "has_long_closure": 3, "competitor_opened_in_train": 3}
BY_DESIGN = ("competitor_opened_in_train", "has_export_gap", "has_long_closure", "StoreType_b", "Assortment_b", "sunday_open")
APART = "high_traffic"
METRICS = ("guests_median", "avg_check", "guests_cv", "growth_yoy")


def draw_order(seed: int, *columns: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def eligible(profile: DataFrame) -> DataFrame:
    """Stores open in the test window, with has_anomaly and the growth tercile ('no data' without a growth)."""
    pool = profile.filter(~F.col("closed_in_test")).withColumn("has_anomaly", F.col("n_anomalies") > 0)
    return quantile_bin(pool, "growth_yoy", 3, "growth_tercile", "no data")


def proportional_quota(sizes: DataFrame, total: int | Column, minimum: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """sizes(group, size): quota by largest remainder, within each value of `by` where given. Groups whose share is under the minimum get
    min(minimum, size) first, the others share the rest. Ties of the remainder go by the group's name. One row per group."""
    total = total if isinstance(total, Column) else F.lit(total)
    every = Window.partitionBy(*by)
    rows = sizes.withColumn("__share", total * F.col("size") / F.sum("size").over(every))
    rows = rows.withColumn("__fixed", F.when(F.col("__share") < minimum, F.least(F.lit(minimum), F.col("size"))))
    left = total - F.coalesce(F.sum("__fixed").over(every), F.lit(0))
    weight = F.when(F.col("__fixed").isNull(), F.col("size"))
    rows = rows.withColumn("__exact", left * weight / F.sum(weight).over(every)).withColumn("__base", F.floor("__exact")).withColumn("__left", left - F.coalesce(F.sum("__base").over(every), F.lit(0)))
    rest = Window.partitionBy(*by, F.col("__fixed").isNull()).orderBy(F.desc(F.round(F.col("__exact") - F.col("__base"), 9)), "group")
    quota = F.coalesce(F.col("__fixed"), F.col("__base") + F.when(F.row_number().over(rest) <= F.col("__left"), 1).otherwise(0))
    return rows.select(*sizes.columns, quota.cast("long").alias("quota"))


def select_stores(pool: DataFrame, size: int = SUBSET_SIZE, seed: int = SEED, mandatory=MANDATORY, min_per_segment: int = MIN_PER_SEGMENT) -> DataFrame:
    """Store and the reason for it. Each flag in order is filled to its quota (stores already chosen count for every flag that they
    have); then segments get proportional quotas and, inside them, growth terciles, less what is already chosen. Where the mandatory stores of a
    segment have used up its quota, the largest needs of that segment are trimmed, a store at a time. The pool has one row per store, so each
    flag is one ranked window over it."""
    rows = pool.select("Store", "segment", "growth_tercile", draw_order(seed, "Store").alias("draw"), F.lit(None).cast("string").alias("reason"), *mandatory)
    for flag, quota in mandatory.items():
        free = F.col(flag) & F.col("reason").isNull()
        have = F.count_if(F.col(flag) & F.col("reason").isNotNull()).over(Window.partitionBy())
        rows = rows.withColumn("__free", free).withColumn("__have", have).withColumn("__place", F.row_number().over(Window.partitionBy("__free").orderBy("draw", "Store")))
        rows = rows.withColumn("reason", F.when(F.col("__free") & (F.col("__place") <= quota - F.col("__have")), f"mandatory:{flag}").otherwise(F.col("reason"))).drop("__free", "__have", "__place")
    strata = rows.groupBy("segment", F.col("growth_tercile").alias("group")).agg(F.count("*").alias("size"), F.count("reason").alias("had"))
    segments = proportional_quota(rows.groupBy(F.col("segment").alias("group")).agg(F.count("*").alias("size")), size, min_per_segment).select(F.col("group").alias("segment"), F.col("quota").alias("total"))
    table = proportional_quota(strata.join(segments, "segment"), F.col("total"), 0, ("segment",))
    # Needs as single stores: those of a low number in their stratum go first, so the largest needs are trimmed.
    unit = F.row_number().over(Window.partitionBy("segment").orderBy("unit", F.desc("group")))
    table = table.withColumn("left", F.greatest(F.col("total") - F.sum("had").over(Window.partitionBy("segment")), F.lit(0)))
    needs = table.filter("quota > had").withColumn("unit", F.explode(F.sequence(F.lit(1).cast("long"), F.col("quota") - F.col("had")))).withColumn("turn", unit).filter("turn <= left")
    needs = needs.groupBy("segment", F.col("group").alias("growth_tercile")).agg(F.count("*").alias("need"))
    order = Window.partitionBy("segment", "growth_tercile").orderBy("draw", "Store")
    free = rows.filter("reason is null").withColumn("place", F.row_number().over(order)).join(needs, ["segment", "growth_tercile"])
    return rows.filter("reason is not null").select("Store", "reason").unionByName(free.filter("place <= need").select("Store", F.lit("stratified").alias("reason")))


def balance_frame(profile: DataFrame) -> DataFrame:
    """Numeric features to compare a sample with its population: metrics, log distance, flags, one-hot types and assortments."""
    flags = [F.col(f).cast("int").cast("double").alias(f) for f in ("Promo2", "competitor_opened_in_train", "has_export_gap", "has_long_closure", "sunday_open")]
    hot = lambda c, values: [F.when(F.col(c) == v, 1.0).otherwise(0.0).alias(f"{c}_{v}") for v in values]
    return profile.select("Store", "segment", *[F.col(m).cast("double").alias(m) for m in METRICS], F.log10("CompetitionDistance").alias("log10_competition_distance"), *flags, *hot("StoreType", "abcd"), *hot("Assortment", "abc"))


def unpivoted(frame: DataFrame) -> DataFrame:
    """Store, segment, feature, x."""
    names = [c for c in frame.columns if c not in ("Store", "segment")]
    return frame.select("Store", "segment", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in names])).alias("p")).select("Store", "segment", "p.*")


def _smd(sample: Column, x: str = "x") -> Column:
    s = F.when(sample, F.col(x))
    spread = F.sqrt((F.coalesce(F.var_samp(s), F.lit(0.0)) + F.coalesce(F.var_samp(x), F.lit(0.0))) / 2)
    return F.when(spread > 1e-12, (F.avg(s) - F.avg(x)) / spread).otherwise(0.0)


def smd(frame: DataFrame, sample: DataFrame) -> DataFrame:
    """Standardized mean difference of each feature between the sample and the whole frame."""
    long = unpivoted(frame).join(sample.select("Store", F.lit(True).alias("in_sample")), "Store", "left")
    return long.groupBy("feature").agg(_smd(F.coalesce("in_sample", F.lit(False))).alias("smd"))


def balance_table(frame: DataFrame, sample: DataFrame, segment: str = APART, by_design=BY_DESIGN) -> DataFrame:
    """Means of the whole frame and of the sample, differences with all segments and without one, and whether a feature is uneven by design."""
    rest = frame.filter(F.col("segment") != segment)
    chosen = sample.select("Store", F.lit(True).alias("in_sample"))
    means = unpivoted(frame).join(chosen, "Store", "left").groupBy("feature").agg(F.avg("x").alias("whole_mean"), F.avg(F.when(F.col("in_sample"), F.col("x"))).alias("sample_mean"))
    out = means.join(smd(frame, sample), "feature").join(smd(rest, sample.join(rest, "Store", "left_semi")).withColumnRenamed("smd", "smd_without"), "feature")
    return out.withColumn("by_design", F.col("feature").isin(*by_design) if by_design else F.lit(False))


def core(frame: DataFrame, segment: str = APART, by_design=BY_DESIGN) -> DataFrame:
    """What the balance criterion looks at: stores of the other segments, features that are not uneven by design."""
    return frame.filter(F.col("segment") != segment).drop(*by_design)


def simulate(frame: DataFrame, n: int, sims: int = 500, seed: int = SEED) -> DataFrame:
    """sim, feature, smd of random samples of n stores without replacement. The stores (one small row each) are repeated per simulation
    and ranked by md5(seed|sim|Store) inside it."""
    long = frame.withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(sims - 1))))
    place = F.row_number().over(Window.partitionBy("sim").orderBy(draw_order(seed, "sim", "Store"), "Store"))
    long = long.withColumn("in_sample", place <= n)
    names = [c for c in frame.columns if c not in ("Store", "segment")]
    pairs = long.select("sim", "in_sample", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in names])).alias("p")).select("sim", "in_sample", "p.*")
    return pairs.groupBy("sim", "feature").agg(_smd(F.col("in_sample")).alias("smd"))


def threshold(simulated: DataFrame, level: float = 0.95) -> DataFrame:
    """The level's quantile of each simulation's greatest difference."""
    return simulated.groupBy("sim").agg(F.max(F.abs("smd")).alias("m")).agg(F.percentile("m", F.lit(level)).alias("threshold"))


def verdict(observed: DataFrame, simulated: DataFrame, level: float = 0.95) -> DataFrame:
    """Per feature: the share of random samples that differ more, and whether the sample is within the threshold."""
    limit = threshold(simulated, level).first()[0]
    rows = simulated.join(observed.select("feature", F.col("smd").alias("own")), "feature")
    # Rounded, so that a simulated sample equal to the observed one does not count as larger by the last bit.
    size = lambda c: F.round(F.abs(F.col(c)), 9)
    out = rows.groupBy("feature", "own").agg(F.avg((size("smd") > size("own")).cast("int")).alias("share_larger"))
    return out.select("feature", F.col("own").alias("smd"), "share_larger", (size("own") <= F.round(F.lit(limit), 9)).alias("balanced"))


FLAGS = ("has_export_gap", "has_long_closure", "has_left_censored", "has_anomaly", "competitor_opened_in_train", "sunday_open")


def phenomena(pool: DataFrame, history: DataFrame, sample: DataFrame) -> DataFrame:
    """What the sample holds: stores by flag, segment and growth tercile, anomalous days, holiday dates, rows (long: what, n)."""
    own = pool.join(sample.select("Store"), "Store", "left_semi")
    a = own.agg(*[F.count_if(F.col(f)).alias(f) for f in FLAGS], F.coalesce(F.sum("n_anomalies"), F.lit(0)).alias("anomalous_days"), F.count("*").alias("stores"))
    rows = history.join(sample.select("Store"), "Store", "left_semi")
    b = rows.agg(F.count_distinct(F.when(F.col("StateHoliday") != "0", F.col("Date"))).alias("holiday_dates"), F.count("*").alias("rows"))
    long = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).cast("long").alias("n")) for c in df.columns])).alias("p")).select("p.*")
    kinds = own.select(F.explode(F.array(F.concat(F.lit("segment "), "segment"), F.concat(F.lit("growth "), "growth_tercile"))).alias("what")).groupBy("what").agg(F.count("*").alias("n"))
    return long(a).unionByName(long(b)).unionByName(kinds)


def chosen_table(pool: DataFrame, sample: DataFrame) -> DataFrame:
    """The chosen stores of the eligible pool with reason, segment and flags, to be written."""
    return sample.join(pool, "Store").select("Store", "reason", "segment", "StoreType", "growth_tercile", *FLAGS)
