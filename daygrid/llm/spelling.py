"""Groups of words that differ by one letter.

Candidates come from asymmetric q-chunks. A word gives its two halves as disjoint chunks; a partner of the same length or one letter
longer gives its positional grams of the halves' lengths. One edit leaves one half whole: the first where it stood, the second
moved by the difference of lengths, so the join is within a shift of one, and only grams at those places are sent. Candidates are
verified by the edit distance of what the halves leave over. The edit lies in one half only, so each pair comes once.

A chunk that more than CROWD words give makes no pairs by itself: its members meet on the rest of the word as well, with one letter
taken away at a known place. Two words of equal length with the same rest at the same place differ in that letter alone, so no more
words than letters meet on a key; a longer word meets the one word that it is without its letter. No link is lost and rows grow with the words.

A word's form is its most frequent near word, if that is at least twice as frequent; frequencies double along forms, so chains are short and
pointers to their ends double as well.

Defined results: a null text has no words; a null doc_id counts as an empty one; of forms with equal counts the smallest in
code-point order is taken; rows of one id are each counted; texts are read whole, of any length (a crowded chunk costs the
square of the letters that its words have beside it); an empty table gives no rows; extra columns are ignored."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, tidy

#: Code points and occurrences of a word at least.
MIN_CHARS = 5
MIN_COUNT = 3
#: A form is so many times as frequent.
TIMES = 2
#: Of a document's runs, one in so many is taken with a letter less.
NOISE = 97
#: Words that give a chunk before its members are told apart by their rest as well.
CROWD = 64
#: Words that a task counts before it hands them on, and texts of an Arrow batch handled at once.
HELD = 200_000
ROWS = 256
_run = re.compile("[a-zÀ-ÿ]+")


def runs(text: str | None, doc_id: int | None, min_chars: int = MIN_CHARS, noise: int = NOISE) -> Iterator[tuple[str, int]]:
    """Words of a text, A-Z lower-cased, with their counts. bytes.lower() changes A-Z alone."""
    begun = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for word, n in Counter(_run.findall((text or "").encode().lower().decode())).items():
        if len(word) >= min_chars:
            if (h := zlib.crc32(word.encode(), begun)) % noise == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
                if len(word) < min_chars:
                    continue
            yield word, n


def vocabulary(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n of all words that are long and frequent enough. Counts are combined in each task before they are shuffled."""

    def rows(counts: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for big in batches:
            for i in range(0, big.num_rows, ROWS):
                b = big.slice(i, ROWS)
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    for word, n in runs(text, doc_id, min_chars):
                        held[word] = held.get(word, 0) + n
                    if len(held) > HELD:
                        yield rows(held)
                        held = {}
        yield rows(held)

    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


KEY = ["chars", "half", "chunk"]


def chunks(words: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """word, n, chars (of the word that gives the chunk), half (0, 1), longer (0: gives it itself; 1: has a letter more), chunk, rest."""
    m = F.length("word")

    def kinds(longer: int) -> list[Column]:
        chars = m - longer
        first = F.floor(chars / 2).cast("int")
        place = first + longer  # of the second half in this word
        whole = [(F.left("word", first), F.substring("word", first + 1, m)), (F.substring("word", place + 1, m), F.left("word", place))]
        return [F.struct(chars.alias("chars"), F.lit(half).alias("half"), F.lit(longer).alias("longer"), c.alias("chunk"), r.alias("rest")) for half, (c, r) in enumerate(whole)]

    rows = words.select("word", "n", F.explode(F.array(*kinds(0), *kinds(1))).alias("x")).select("word", "n", "x.*")
    return rows.filter(F.col("chars") >= min_chars)


def without_one(rest: Column, positions: bool) -> Column:
    """The rest without each of its letters, with the letter's place or without repeats."""
    every = F.transform(F.sequence(F.lit(1), F.length(rest)), lambda i: F.struct(i.alias("at"), F.concat(F.left(rest, i - 1), F.substring(rest, i + 1, F.length(rest))).alias("left")))
    return every if positions else F.array_distinct(F.transform(every, lambda x: F.struct(F.lit(0).alias("at"), x["left"].alias("left"))))


def near_words(words: DataFrame, min_chars: int = MIN_CHARS, crowd: int = CROWD) -> DataFrame:
    """words(word, n): word, n, near, near_n for all pairs of words one edit apart, both ways and each once."""
    rows = chunks(words, min_chars)
    crowded = rows.filter("longer = 0").groupBy(*KEY).agg(F.count("*").alias("givers")).filter(F.col("givers") > crowd).select(*KEY, F.lit(True).alias("crowded"))
    rows = cut(rows.join(crowded, KEY, "left"))
    few, many = rows.filter("crowded is null"), rows.filter("crowded").filter("rest <> ''")

    def giving(df: DataFrame, *more: str) -> DataFrame:
        return df.filter("longer = 0").select(*KEY, *more, F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("rest").alias("a_rest"))

    one_edit = F.levenshtein("a_rest", "rest", 1) == 1
    first_too = (F.col("longer") == 1) & (F.col("half") == 1) & (F.expr("left(rest, length(a_rest))") == F.col("a_rest"))  # then the first half finds it
    found = few.join(giving(few), KEY).filter((F.col("a") != F.col("word")) & one_edit & ~first_too)
    same = many.filter("longer = 0").select("*", F.explode(without_one(F.col("rest"), True)).alias("x")).select("*", "x.at", "x.left")
    equal = same.join(giving(same, "at", "left"), [*KEY, "at", "left"]).filter(F.col("a") != F.col("word"))
    longer = many.filter("longer = 1").select("*", F.explode(without_one(F.col("rest"), False)).alias("x")).select("*", F.col("x.left").alias("a_rest"))
    longer = longer.join(giving(many), [*KEY, "a_rest"]).filter(~first_too)
    pairs = found.select("a", "a_n", "word", "n", "longer").union(equal.select("a", "a_n", "word", "n", "longer")).union(longer.select("a", "a_n", "word", "n", "longer"))
    there = F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    back = F.struct("word", "n", F.col("a").alias("near"), F.col("a_n").alias("near_n"))  # words of equal length come both ways by themselves
    return pairs.select(F.explode(F.when(F.col("longer") == 1, F.array(there, back)).otherwise(F.array(there))).alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """forms(word, form): word, root: the end of the chain of forms. Each round doubles what a pointer spans."""
    at = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut(at.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return at


def variants(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, times: int = TIMES, crowd: int = CROWD) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words of the texts."""
    words = cut(vocabulary(docs, min_chars, min_count))
    best = near_words(words, min_chars, crowd).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    best = best.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    above = F.col("near_n") >= times * F.col("n")
    rows = cut(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(above, F.col("near")).alias("form"), F.when(above, F.col("near_n")).alias("form_n")))
    ends = roots(rows.filter("form is not null").select("word", "form"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
