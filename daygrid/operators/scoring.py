"""Scores of long prediction tables (Store, Date, fold, model, y, pred)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .baselines import in_folds
from .order import quantiles


def checked(pred: DataFrame) -> DataFrame:
    """The frame, or an error if a prediction is null or an actual is not positive."""
    bad = pred.agg(F.count_if(F.col("pred").isNull()), F.count_if(F.coalesce(F.col("y") <= 0, F.lit(True)))).first()
    if any(bad):
        raise ValueError(f"{bad[0]} predictions are null, {bad[1]} actuals are not positive")
    return pred


def err() -> Column:
    return F.abs(F.col("pred") - F.col("y"))


def metrics(pred: DataFrame, *keys: str) -> DataFrame:
    """MAE, MAPE % and WAPE % by the keys."""
    return pred.groupBy(*keys).agg(F.avg(err()).alias("mae"), (F.avg(err() / F.col("y")) * 100).alias("mape"), (F.sum(err()) / F.sum("y") * 100).alias("wape"))


def business_summary(pred: DataFrame, start, *keys: str) -> DataFrame:
    """Mean actual, median and 90 % error, shares of days within 5 %, over 10 % and 20 %, the weekly store totals' error, bias %."""
    day = F.lit(start).cast("date") if not isinstance(start, Column) else start
    ape = err() / F.col("y") * 100
    share = lambda c: F.avg(c.cast("int")) * 100
    days = pred.groupBy(*keys).agg(F.avg("y").alias("mean_y"), share(ape <= 5).alias("within_5"), share(ape > 10).alias("over_10"), share(ape > 20).alias("over_20"), (F.sum(F.col("pred") - F.col("y")) / F.sum("y") * 100).alias("bias_pct"))
    weeks = pred.groupBy(*keys, "Store", F.floor(F.datediff("Date", day) / 7).alias("week")).agg(F.sum("y").alias("y"), F.sum("pred").alias("pred"))
    errors = quantiles(pred.select(*keys, err().alias("e")), "e", {"median_error": 0.5, "error_90": 0.9}, keys)
    total = quantiles(weeks.select(*keys, (err() / F.col("y") * 100).alias("e")), "e", {"week_median": 0.5, "week_90": 0.9}, keys)
    out = days.join(errors, list(keys)).join(total, list(keys)) if keys else days.crossJoin(errors).crossJoin(total)  # single rows
    first = [*keys, "mean_y", "median_error", "error_90"]
    return out.select(*first, *[c for c in out.columns if c not in first])


def training_rows(features: DataFrame, before, target: str = "target") -> DataFrame:
    return features.filter((F.col("Date") < F.lit(before).cast("date")) & F.col(target).isNotNull())


def describe_folds(calendar: DataFrame, which: DataFrame) -> DataFrame:
    """Open days, stores and sorted holiday dates of each period."""
    days = in_folds(calendar, which)
    holiday = F.when(F.coalesce(F.col("StateHoliday"), F.lit("0")) != "0", F.col("Date"))
    out = days.groupBy("fold").agg(F.count_if(F.col("day_status") == "open").alias("open_days"), F.count_distinct(F.when(F.col("day_status") == "open", F.col("Store"))).alias("stores"), F.array_sort(F.collect_set(holiday)).alias("dates"))
    return out.select("fold", "open_days", "stores", F.array_join(F.transform("dates", lambda d: F.date_format(d, "yyyy-MM-dd")), ",").alias("holidays"))


def fold_scores(pred: DataFrame) -> DataFrame:
    """Metrics per fold and model, with a row 'mean': the unweighted mean over folds."""
    per = metrics(pred, "model", "fold")
    mean = per.groupBy("model").agg(F.lit("mean").alias("fold"), *[F.avg(m).alias(m) for m in ("mae", "mape", "wape")])
    return per.unionByName(mean)


def compare_to_base(scores: DataFrame, base: str, min_better: int = 2) -> DataFrame:
    """Change of MAPE against the base model per fold: mean, folds that got better, and the verdict."""
    folds = scores.filter("fold <> 'mean'")
    b = folds.filter(F.col("model") == base).select("fold", F.col("mape").alias("base"))
    d = folds.filter(F.col("model") != base).join(b, "fold").withColumn("delta", F.col("mape") - F.col("base"))
    out = d.groupBy("model").agg(F.avg("delta").alias("mean_delta"), F.count_if(F.col("delta") < 0).alias("better"))
    return out.withColumn("accept", (F.col("mean_delta") < 0) & (F.col("better") >= min_better))


def improvement(scores: DataFrame, base: str) -> DataFrame:
    """Gain in % of each model over the base per fold and metric (long)."""
    names = ("mae", "mape", "wape")
    long = scores.select("fold", "model", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in names])).alias("p")).select("fold", "model", "p.*")
    b = long.filter(F.col("model") == base).select("fold", "metric", F.col("value").alias("base"))
    return long.filter(F.col("model") != base).join(b, ["fold", "metric"]).select("fold", "model", "metric", ((F.col("base") - F.col("value")) / F.col("base") * 100).alias("gain_pct"))


def block_sums(pred: DataFrame, start) -> DataFrame:
    """Per model and block (store x week): days, summed error, summed relative error."""
    week = F.floor(F.datediff("Date", F.lit(start).cast("date")) / 7)
    return pred.groupBy("model", "Store", week.cast("int").alias("week")).agg(F.count("*").alias("n"), F.sum(err()).alias("e"), F.sum(err() / F.col("y")).alias("r"))


def bootstrap(blocks: DataFrame, n_boot: int = 2000, seed: int = 42) -> DataFrame:
    """Resamples of blocks with replacement, the same draws for all models: draw, model, mae, mape. Slot i of a draw takes the block
    whose number is md5(seed|draw|i) modulo the number of blocks; block numbers come from one ordered pass over the block keys."""
    keys = blocks.select("Store", "week").distinct().withColumn("block", F.row_number().over(Window.orderBy("Store", "week")) - 1)
    b = keys.count()
    text = F.concat_ws("|", F.lit(str(seed)), "draw", "slot")
    pick = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % b
    draws = blocks.sparkSession.range(n_boot * b).select((F.col("id") / b).cast("long").alias("draw"), (F.col("id") % b).alias("slot"))
    times = draws.select("draw", pick.alias("block")).groupBy("draw", "block").agg(F.count("*").alias("times"))
    rows = blocks.join(keys, ["Store", "week"]).join(times, "block")
    t = F.col("times")
    return rows.groupBy("draw", "model").agg((F.sum(t * F.col("e")) / F.sum(t * F.col("n"))).alias("mae"), (F.sum(t * F.col("r")) / F.sum(t * F.col("n")) * 100).alias("mape"))


def poisson_bootstrap(blocks: DataFrame, n_boot: int = 2000, seed: int = 42) -> DataFrame:
    """For very many blocks: each block gets Poisson(1) weights for all draws, seeded by its key, and tasks add up weighted sums; only
    (model, draw) rows are shuffled."""

    def weigh(batches):
        held: dict[str, np.ndarray] = {}
        for b in batches:
            for r in b.itertuples(index=False):
                w = np.random.default_rng([seed, int(r.Store), int(r.week) & 0xFFFFFFFF]).poisson(1.0, n_boot)
                held.setdefault(r.model, np.zeros((3, n_boot)))
                held[r.model] += np.outer([r.n, r.e, r.r], w)
        for model, s in held.items():
            yield pd.DataFrame({"draw": np.arange(n_boot), "model": model, "n": s[0], "e": s[1], "r": s[2]})

    parts = blocks.mapInPandas(weigh, "draw long, model string, n double, e double, r double")
    return parts.groupBy("draw", "model").agg((F.sum("e") / F.sum("n")).alias("mae"), (F.sum("r") / F.sum("n") * 100).alias("mape"))


def multinomial_bootstrap(blocks: DataFrame, n_boot: int = 2000, seed: int = 42, bucket_size: int = 4096) -> DataFrame:
    """Exact resamples with replacement for very many blocks: draw, model, mae, mape. The B slots of a draw are split over a binary tree of hash buckets
    by binomials, each node's seeded by its place alone, and inside a bucket over its blocks: every task works out the way to its own bucket,
    nothing is numbered, and no row is made for a draw and a block. All models share the draws; only (model, draw) sums are shuffled. The
    driver gets one size a bucket."""
    keyed = blocks.withColumn("hash", F.xxhash64("Store", "week"))
    total = blocks.select("Store", "week").distinct().count()
    buckets = 1 << max(0, (max(total, 1) - 1) // bucket_size).bit_length()
    keyed = keyed.withColumn("bucket", F.pmod("hash", F.lit(buckets)).cast("int")).drop("hash")
    sizes = np.zeros(buckets, np.int64)
    for r in keyed.select("Store", "week", "bucket").distinct().groupBy("bucket").count().collect():
        sizes[r["bucket"]] = r["count"]

    def slots(bucket: int) -> np.ndarray:
        """Slots of each draw that fall to a bucket."""
        at, low, high, left = 1, 0, buckets, np.full(n_boot, total)
        while high - low > 1:
            middle = (low + high) // 2
            first, whole = sizes[low:middle].sum(), sizes[low:high].sum()
            taken = np.random.default_rng([seed, at]).binomial(left, first / whole if whole else 0.0)
            left, low, high, at = (taken, low, middle, 2 * at) if bucket < middle else (left - taken, middle, high, 2 * at + 1)
        return left

    def weigh(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        bucket, out = int(key[0]), []
        place = pdf.groupby(["Store", "week"], sort=True).ngroup().to_numpy()
        m = int(place.max()) + 1
        times = np.random.default_rng([seed, 0, bucket]).multinomial(slots(bucket), np.full(m, 1 / m))
        for model, part in pdf.groupby("model"):
            s = times[:, place[part.index.to_numpy()]] @ part[["n", "e", "r"]].to_numpy(float)
            out.append(pd.DataFrame({"draw": np.arange(n_boot), "model": model, "n": s[:, 0], "e": s[:, 1], "r": s[:, 2]}))
        return pd.concat(out)

    parts = keyed.groupBy("bucket").applyInPandas(weigh, "draw long, model string, n double, e double, r double")
    return parts.groupBy("draw", "model").agg((F.sum("e") / F.sum("n")).alias("mae"), (F.sum("r") / F.sum("n") * 100).alias("mape"))


def bootstrap_gains(draws: DataFrame, model: str) -> DataFrame:
    """Gain in % of a model against each other one, in MAE and in MAPE: 2.5 and 97.5 percentiles and the share of draws with a gain."""
    long = draws.select("draw", "model", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("mae", "mape")])).alias("p")).select("draw", "model", "p.*")
    own = long.filter(F.col("model") == model).select("draw", "metric", F.col("value").alias("own"))
    g = long.filter(F.col("model") != model).join(own, ["draw", "metric"]).withColumn("gain", (F.col("value") - F.col("own")) / F.col("value") * 100)
    q = lambda p: F.percentile("gain", F.lit(p))
    return g.groupBy(F.col("model").alias("base"), "metric").agg(q(0.025).alias("low"), q(0.975).alias("high"), F.avg((F.col("gain") > 0).cast("int")).alias("share"))


def by_group(pred: DataFrame, profile: DataFrame, flags) -> DataFrame:
    """Relative error by overlapping store groups: all, the segment, and each flag that is set."""
    labels = [F.lit("all"), F.col("segment"), *[F.when(F.col(f), F.lit(f)) for f in flags]]
    groups = profile.select("Store", F.explode(F.array_compact(F.array(*labels))).alias("group"))
    return pred.join(groups, "Store").groupBy("model", "group").agg(F.count_distinct("Store").alias("stores"), (F.avg(err() / F.col("y")) * 100).alias("ape"))


def store_mape(pred: DataFrame) -> DataFrame:
    return pred.groupBy("Store", "model").agg((F.avg(err() / F.col("y")) * 100).alias("mape"), (F.sum(F.col("pred") - F.col("y")) / F.sum("y") * 100).alias("bias_pct"))


def wins(pred: DataFrame, a: str, b: str) -> DataFrame:
    """Share of stores where model a has the lower MAPE."""
    per = store_mape(pred).groupBy("Store").agg(F.max(F.when(F.col("model") == a, F.col("mape"))).alias("a"), F.max(F.when(F.col("model") == b, F.col("mape"))).alias("b"))
    return per.agg(F.count("*").alias("stores"), F.avg((F.col("a") < F.col("b")).cast("int")).alias("share"))


def by_weekday_and_week(pred: DataFrame, start) -> DataFrame:
    """Relative error by weekday and by week of the period (long: kind, number)."""
    week = F.floor(F.datediff("Date", F.lit(start).cast("date")) / 7).cast("int")
    rows = pred.select("model", "y", "pred", F.explode(F.array(F.struct(F.lit("weekday").alias("kind"), F.col("DayOfWeek").cast("int").alias("number")), F.struct(F.lit("week").alias("kind"), week.alias("number")))).alias("k")).select("model", "y", "pred", "k.*")
    return rows.groupBy("model", "kind", "number").agg((F.avg(err() / F.col("y")) * 100).alias("ape"))


def segment_mape(pred: DataFrame, profile: DataFrame) -> DataFrame:
    """Mean per segment and fold first, then over folds."""
    per = pred.join(profile.select("Store", "segment"), "Store").groupBy("model", "segment", "fold").agg((F.avg(err() / F.col("y")) * 100).alias("mape"))
    return per.groupBy("model", "segment").agg(F.avg("mape").alias("mape"))


def store_extremes(pred: DataFrame, model: str) -> DataFrame:
    """The best, the median and the worst store by MAPE."""
    per = store_mape(pred.filter(F.col("model") == model)).withColumn("place", F.row_number().over(Window.orderBy("mape", "Store"))).withColumn("n", F.count("*").over(Window.partitionBy()))
    middle = F.floor((F.col("n") + 1) / 2)
    kind = F.when(F.col("place") == 1, "best").when(F.col("place") == F.col("n"), "worst").when(F.col("place") == middle, "median")
    return per.withColumn("kind", kind).filter("kind is not null").select("kind", "Store", "mape")


def worst_stores(pred: DataFrame, profile: DataFrame, model: str, flags, n: int = 6) -> DataFrame:
    """The n stores with the highest MAPE, their bias and the flags that they have."""
    has = F.array_join(F.array_compact(F.array(*[F.when(F.col(f), F.lit(f)) for f in flags])), ",")
    return store_mape(pred.filter(F.col("model") == model)).join(profile, "Store").select("Store", "mape", "bias_pct", has.alias("flags")).orderBy(F.desc("mape"), "Store").limit(n)


def day_bias(pred: DataFrame, model: str) -> DataFrame:
    """Per day the bias of the whole network and the number of stores off by more than 20 %."""
    rows = pred.filter(F.col("model") == model)
    return rows.groupBy("Date").agg((F.sum(F.col("pred") - F.col("y")) / F.sum("y") * 100).alias("bias_pct"), F.count_if(err() / F.col("y") > 0.2).alias("stores_off"))


def worst_days(pred: DataFrame, model: str, n: int = 6) -> DataFrame:
    return day_bias(pred, model).orderBy(F.desc(F.abs("bias_pct")), "Date").limit(n)
