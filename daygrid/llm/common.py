"""Shared helpers: tables, word pattern, hash folds, internal names and lineage cuts."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: What stands between words, for Spark's regular expressions.
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words of a text; null has none. Counts gaps on the trimmed text, so no array is built."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(t == "", F.lit(0)).otherwise(F.regexp_count(t, F.lit(GAP)) + 1).cast("long")


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id's decimal text (null: of the empty text), modulo k."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(k)


def own_name(df: DataFrame, stem: str) -> str:
    """A column name that the frame does not have."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session may go without; it gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or tempfile.mkdtemp(prefix=f"{purpose}-")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession, "checkpoint"))
    return df.checkpoint()


def give_back() -> None:
    """Give the system what this process no longer uses: Python workers live on, so one stage's leftovers would stand beside the next."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # only glibc has it
        trim(0)


def tidy(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The task, after whose end its worker gives back what it no longer uses."""

    @wraps(task)
    def run(batches: Iterator) -> Iterator:
        yield from task(batches)
        give_back()

    return run


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row, however often body uses it."""
    return F.transform(F.array(value), body)[0]
