"""Mixing sources to target weights: fixed-length token blocks, multinomial source counts per output shard, per-source index
permutations, and a join of blocks by index. DataFrame functions only.

The words of each source form one stream, in an order given by a hash of the id; block b of a source holds its words
[b * L, (b + 1) * L). Each source has the slots that its target fills (the last one cut, never more than cap times its size). Output shards draw
their source counts from the multinomial law given these totals: all slots of the mix are numbered source by source, one pseudorandom
permutation of the numbers deals them out, and each run of SHARD places is a shard. So a shard's counts scatter as drawn, every shard but
the last is full, and targets hold by construction. Slot t of a source reads block perm(t mod B) in pass t div B, so every block is read once
before any is read again.

Defined results: null or wordless text has size 0, a finite target of its source and taken 0; a null source is a source of its
own, last in order; a row is known by its id and its text's hash, null ids included, and repeated rows are rows of their own in the
stream; an empty table gives no rows; extra columns of the input are ignored."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import GAP, cut, n_words, own_name

WEIGHTS = (5, 2, 1)
BLOCK = 256
SHARD = 64
CAP = 3
SEED = 0
ROUNDS = 16
#: Slots of a source that one row stands for until they are dealt to tasks.
RUN = 1 << 12


def permuted(x: Column, n: Column, seed: Column, back: bool = False) -> Column:
    """Pseudorandom permutation of 0..n-1 (swap-or-not rounds: exact for every n, no tables); back: its inverse. Each round undoes itself,
    so the inverse is the rounds in reverse order."""

    def swap(acc: Column, r: Column) -> Column:
        pair = F.pmod(F.pmod(F.xxhash64(seed, r), n) - acc, n)
        return F.when(F.xxhash64(seed, r, F.greatest(acc, pair)) % 2 == 0, pair).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(ROUNDS), F.lit(1)) if back else F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("long"), swap)


def sources_of(sized: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """Per source: rank (code points, null last), weight, size and target. Targets share the total by weight; a source stops at
    cap times its size and what is over is shared anew. With sources in ascending order of limit/weight the limited ones are
    a prefix, so one pass of running sums gives the fixed point. One row per source: the only unpartitioned windows."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    ranked = per.withColumn("rank", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    )
    order = Window.orderBy(F.col("source_size") * cap / F.col("weight"), "rank")
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total, weight = F.sum("source_size").over(everything), F.sum("weight").over(everything)
    left = total - F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0))
    share = weight - F.coalesce(F.sum("weight").over(before), F.lit(0))
    limited = F.col("source_size") * cap * share <= F.col("weight") * left
    out = ranked.select("source", "rank", "weight", "source_size", left.alias("left"), share.alias("share"), limited.alias("limited"), F.row_number().over(order).alias("place"))
    first_free = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pick = lambda c: F.first(F.when(~F.col("limited"), F.col(c)), ignorenulls=True).over(first_free)
    free = F.col("weight").cast("double") * pick("left").cast("double") / pick("share").cast("double")
    return out.select("source", "rank", "weight", "source_size", F.when(F.col("limited"), (F.col("source_size") * cap).cast("double")).otherwise(free).alias("target"))


def slots_of(sources: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED, cap: int = CAP) -> DataFrame:
    """The mix itself: one row per slot of the output with shard, place in the source's slots, source rank, block, pass and words taken."""
    s = F.nullif("source_size", F.lit(0))  # filters may move behind a division
    plan = sources.filter(s > 0).select("rank", s.alias("n"), F.least(F.round("target"), s * cap).cast("long").alias("take"), F.ceil(s / block).cast("long").alias("blocks"))
    plan = plan.withColumn("seed", F.xxhash64(F.lit(seed), "rank", F.lit("blocks"))).withColumn("lack", F.col("blocks") * block - F.col("n"))
    plan = plan.withColumn("full", F.floor(F.col("take") / F.col("n"))).withColumn("rest", F.col("take") - F.col("full") * F.col("n"))
    # The short block's place in its source's order; every pass has the same order.
    plan = plan.withColumn("short_at", permuted(F.col("blocks") - 1, F.col("blocks"), F.col("seed"), back=True))
    # Slots of the last pass: k blocks hold k * block words, less what the short last block lacks once it has come. None is empty.
    plain = F.ceil(F.col("rest") / block)
    last = F.when(F.col("short_at") < plain, F.ceil((F.col("rest") + F.col("lack")) / block)).otherwise(plain)
    plan = plan.withColumn("needed", F.col("full") * F.col("blocks") + last)
    # One row per source: the unpartitioned windows are over those.
    before = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    plan = plan.withColumn("begin", F.coalesce(F.sum("needed").over(before), F.lit(0))).withColumn("total", F.sum("needed").over(Window.partitionBy()))
    runs = plan.filter("needed > 0").withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("needed") - 1) / RUN))))
    # A fixed number of tasks: by their bytes Spark would put all runs into one, whose slots it would then make alone.
    tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = runs.repartition(tasks, "rank", "run").withColumn("t", F.explode(F.sequence(F.col("run") * RUN, F.least((F.col("run") + 1) * RUN, F.col("needed")) - 1)))
    at = permuted(F.col("begin") + F.col("t"), F.col("total"), F.xxhash64(F.lit(seed), F.lit("shards")))
    each = each.withColumn("shard", F.floor(at / shard)).withColumn("pass", F.floor(F.col("t") / F.col("blocks"))).withColumn("k", F.col("t") % F.col("blocks"))
    each = each.withColumn("block", permuted(F.col("k"), F.col("blocks"), F.col("seed")))
    length = F.when(F.col("block") == F.col("blocks") - 1, block - F.col("lack")).otherwise(block)
    gone = F.col("k") * block - F.when(F.col("k") > F.col("short_at"), F.col("lack")).otherwise(0)
    taken = F.when(F.col("pass") < F.col("full"), length).otherwise(F.least(length, F.greatest(F.col("rest") - gone, F.lit(0))))
    return each.select("shard", F.col("t").alias("place"), "rank", "block", "pass", taken.cast("long").alias("words"))


def blocks_of(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pieces of documents in blocks: row key, source rank, block and the piece's words [first, last) inside the block. Offsets come from
    two-level prefix sums: hash buckets of a source, then rows of a bucket; no window holds a whole source."""
    key = ["rank", "bucket"]
    sums = docs.groupBy(*key).agg(F.sum("size").alias("sum"))
    # At most sqrt(documents) buckets, so this window over a source's buckets stays small.
    starts = sums.select(*key, F.coalesce(F.sum("sum").over(Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy(*key).orderBy("order", "row")
    placed = docs.withColumn("inner", F.sum("size").over(inside) - F.col("size")).join(starts, key)
    at = placed.filter("size > 0").select("row", "rank", "size", (F.col("base") + F.col("inner")).alias("at"))
    pieces = at.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))))
    low = F.col("block") * block
    return pieces.select("row", "rank", "block", (F.greatest(F.col("at"), low) - low).alias("first"), (F.least(F.col("at") + F.col("size"), low + block) - low).alias("last"), (F.greatest(F.col("at"), low) - F.col("at")).alias("from"))


BUCKET_ROWS = 500
BROADCAST_SOURCES = 10_000
#: What names a row: id (0 for null), whether it is null, the text's hash, and the number among equal ones.
ROW = ("id", "no_id", "hash", "copy")


def sized_rows(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and the columns of ROW. Rows of one id and text are numbered; other windows hold one row."""
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", "source", n_words(text).alias("size"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("id"), F.col("doc_id").isNull().alias("no_id"), F.xxhash64(text, "source").alias("hash"))
    return cut(rows.withColumn("copy", F.row_number().over(Window.partitionBy("id", "no_id", "hash").orderBy("size"))))


def placed(rows: DataFrame, weights=WEIGHTS, block: int = BLOCK, shard: int = SHARD, cap: int = CAP, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows with rank, source_size and target; the mix's slots; the documents' pieces in blocks."""
    sources = cut(sources_of(rows, weights, cap))
    n = rows.count()
    # One row per source: sent to all tasks up to this many, joined by shuffle beyond.
    hint = F.broadcast if sources.count() <= BROADCAST_SOURCES else (lambda df: df)
    small = sources.select(F.col("source").alias("of"), "rank", "source_size", "target")
    joined = rows.join(hint(small), F.col("source").eqNullSafe(F.col("of")), "left").withColumn("row", F.struct(*ROW))
    buckets = max(1, min(n // BUCKET_ROWS, math.isqrt(n)))
    joined = joined.withColumn("order", F.xxhash64(F.lit(seed), *ROW)).withColumn("bucket", F.pmod(F.xxhash64(*ROW, F.lit("bucket")), F.lit(buckets)))
    return joined, slots_of(sources, block, shard, seed, cap), blocks_of(joined.select("row", "rank", "bucket", "order", "size"), block)


def mixed(rows: DataFrame, *args, **kwargs) -> DataFrame:
    """The rows with taken: the words that the slots take of each."""
    joined, slots, pieces = placed(rows, *args, **kwargs)
    reads = slots.groupBy("rank", "block").agg(F.collect_list("words").alias("reads"))  # one entry a pass
    overlap = F.aggregate("reads", F.lit(0).cast("long"), lambda acc, w: acc + F.greatest(F.least(F.col("last"), w) - F.col("first"), F.lit(0)))
    # The slots come out of a few rows by explode, so Spark takes them to be few: the hint keeps it from broadcasting them.
    taken = pieces.join(reads.hint("merge"), ["rank", "block"]).groupBy("row").agg(F.sum(overlap).alias("words"))
    return joined.join(taken, "row", "left").withColumn("taken", F.coalesce("words", F.lit(0)).cast("long"))


def mix(docs: DataFrame, weights=WEIGHTS, block: int = BLOCK, shard: int = SHARD, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target (of the document's source) and taken: the words the mix takes, repeats counted."""
    return mixed(sized_rows(docs), weights, block, shard, cap, seed).select("doc_id", "size", "source_size", "target", "taken")


def shards(docs: DataFrame, weights=WEIGHTS, block: int = BLOCK, shard: int = SHARD, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """The mix written out: shard, source, place, words: the text of each slot, its words joined by a space."""
    rows = sized_rows(docs)
    joined, slots, pieces = placed(rows, weights, block, shard, cap, seed)
    text = F.col("text").cast("string")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("id"), F.col("doc_id").isNull().alias("no_id"), F.xxhash64(text, "source").alias("hash"), "source", text.alias("text")).dropDuplicates(["id", "no_id", "hash"])
    cutting = pieces.join(joined.select("row", *ROW), "row").join(texts, ["id", "no_id", "hash"])
    own = cutting.select("rank", "source", "block", "first", "last", F.slice(F.filter(F.split("text", GAP), lambda w: w != ""), (F.col("from") + 1).cast("int"), (F.col("last") - F.col("first")).cast("int")).alias("words"))
    whole = own.groupBy("rank", "block").agg(F.first("source").alias("source"), F.array_sort(F.collect_list(F.struct("first", "words"))).alias("parts"))
    filled = slots.withColumnRenamed("words", "n").hint("merge").join(whole, ["rank", "block"])
    return filled.select("shard", "source", "place", F.array_join(F.slice(F.flatten("parts.words"), F.lit(1), F.col("n").cast("int")), " ").alias("words"))


def resample(docs: DataFrame, weights=WEIGHTS) -> DataFrame:
    """The documents of the mix: each row is returned floor(taken / size + u) times, u a fixed number in [0, 1) of the row, so the
    expected words of a row are what the mix's slots take of it. Columns are those of docs; rows without an id take part."""
    names = {n: own_name(docs, n) for n in (*ROW, "copies", "again")}
    sized = sized_rows(docs)
    plan = mixed(sized, weights).filter("taken > 0")
    u = F.pmod(F.xxhash64(*ROW, F.lit("copies")), F.lit(1 << 20)) / float(1 << 20)
    plan = plan.select(*[F.col(n).alias(names[n]) for n in ROW], F.floor(F.col("taken") / F.col("size") + u).cast("int").alias(names["copies"])).filter(F.col(names["copies"]) > 0)
    text = F.col("text").cast("string")
    key = {"id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), "no_id": F.col("doc_id").isNull(), "hash": F.xxhash64(text, "source")}
    rows = docs.select(*docs.columns, *[c.alias(names[n]) for n, c in key.items()])
    first, repeated = rows.withColumn(names["copy"], F.lit(1)), sized.filter("copy = 2").select(*[F.col(n).alias(names[n]) for n in key])
    if not repeated.isEmpty():  # only rows that are there more than once need their number
        on = [names[n] for n in key]
        number = F.row_number().over(Window.partitionBy(*on).orderBy(names["hash"]))
        first = first.join(repeated, on, "left_anti").unionByName(rows.join(repeated, on, "left_semi").withColumn(names["copy"], number))
    rows = first
    out = rows.join(plan, [names[n] for n in ROW]).withColumn(names["again"], F.explode(F.sequence(F.lit(1), F.col(names["copies"]))))
    return out.select(*docs.columns)
