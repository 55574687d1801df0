"""Quality rules: base counts, and the divergence of a document's histograms from language references. DataFrame functions only.

Two histograms of each document, character classes and common words, are compared with those of each language (sums over all
documents of that language) by Jensen-Shannon distance, 0 to 1; the nearest language counts, so the language column is not
trusted for the document itself. A language's common words are its COMMON most frequent ones over the whole corpus. How far a document may
lie depends on its nearest language and its length, as short texts scatter more: the limit of a language and length class (powers of two of
words) is the median distance of its documents that pass the base rules plus CLASS_SPREADS or WORD_SPREADS times the distance from the median down to the 16 %
quantile. The lower half sets the limit, so junk, which lies above, does not widen it. A class with fewer than MIN_CLASS such documents takes
the limit of all languages in that length, and none if these are too few as well. The word histogram of documents below min_words words is
too thin to judge; they are guarded from it.

Repeated words: 3-word windows are hashed (64 bits), sorted with their places, and the places of hashes found more than once are
merged into covered words, all inside a row.

Defined results: null text has no words, no lines and fails the base rules; without any language there is no reference and only the
base rules count; repeated rows are judged alike; very long texts are judged whole; an empty table gives no rows; extra columns
are ignored."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, let, words

MIN_WORDS = 50
WINDOW = 3
COMMON = 32
#: Character classes of sound texts have a longer upper tail (lists, names, numbers) than their common words.
CLASS_SPREADS, WORD_SPREADS = 20.0, 5.0
MIN_CLASS = 50
#: The code point of the first common word; 20,000 Chinese characters follow it, then others.
CODE = 0x4E00

#: Character classes; what none of them holds is the last bin.
CLASSES = {"upper": "[A-Z]+", "digit": "[0-9]+", "mark": r"[.,;:!?'\"()\-]+", "symbol": r"[#*$%&|<>]+", "wide": r"[^\x00-\x7F]+"}


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def repeated(w: Column) -> Column:
    """Words of array w in windows of 3 found twice or more."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def places(s: Column) -> Column:
        same = lambda a, b: F.coalesce(F.get(s, a)["h"] == F.get(s, b)["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, i: same(i, i - 1) | same(i, i + 1)), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    def of(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(let(placed, places), covered))

    return F.when(F.size(w) < WINDOW, F.lit(0)).otherwise(let(hashes, of))


def prepared(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.col("lang").cast("string").alias("lang"), text.alias("text"))


def common_words(docs: DataFrame, n: int = COMMON) -> DataFrame:
    """lang, word, n: the n words of each language that stand in most of its documents. Tasks count first; the window keeps n a language and task."""
    own = prepared(docs).filter("lang is not null").select("lang", F.explode(F.array_distinct(F.transform(words(F.col("text")), F.lower))).alias("word"))
    counts = own.groupBy("lang", "word").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    return counts.withColumn("place", place).filter(F.col("place") <= n).select("lang", "word", "n")


def features(docs: DataFrame, common: list[str]) -> DataFrame:
    """doc_id, lang, the base counts, the histogram of character classes, and of the common words those that the text has, as (word's number,
    times). A common word becomes one code point, so its bin is counted in a string of codes and not in the text."""
    rows = prepared(docs)
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # The map is searched from its start: the most frequent words come first.
    known = F.create_map(*[F.lit(x) for i, w in enumerate(common) for x in (w, chr(CODE + i))]) if common else None

    def of(w: Column) -> Column:
        bins = F.array().cast("array<struct<word:int,times:int>>")
        if common:
            coded = F.transform(F.filter(F.transform(w, F.lower), lambda x: x.isin(common)), lambda x: F.element_at(known, x))
            times = lambda s, c: F.length(s) - F.length(F.replace(s, c, F.lit("")))
            met = lambda c: let(F.array_join(c, ""), lambda s: F.transform(F.array_distinct(c), lambda x: F.struct((F.ascii(x) - CODE).alias("word"), times(s, x).alias("times"))))
            bins = let(coded, met)
        return F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), repeated(w).alias("n_repeat_words"), bins.alias("bins"))

    rows = rows.select(
        "doc_id",
        "lang",
        F.length("text").alias("n"),
        let(words(F.col("text")), of).alias("w"),
        # What no class counts goes first: the rest is short.
        let(F.regexp_replace("text", r"[a-z\x20\x09-\x0D]+", ""), lambda x: F.array(*[_count(x, p) for p in CLASSES.values()])).alias("c"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"),
    )
    total = lambda a: F.aggregate(a, F.lit(0), lambda acc, x: acc + x)
    return rows.select(
        "doc_id",
        "lang",
        *[F.col(f"w.{c}").cast("long").alias(c) for c in ("n_words", "word_chars")],
        F.get("c", F.lit(list(CLASSES).index("symbol"))).cast("long").alias("n_symbols"),
        F.col("n_dup_lines").cast("long").alias("n_dup_lines"),
        F.col("w.n_repeat_words").cast("long").alias("n_repeat_words"),
        F.concat("c", F.array(F.col("n") - F.col("w.word_chars"), F.col("w.word_chars") - total(F.col("c")))).alias("classes"),
        F.col("w.bins").alias("commons"),
    )


def references(rows: DataFrame, common: list[tuple[str, str]], bins: list[str]) -> list[dict]:
    """Of each language: shares of the character classes, and of its common words by their number in bins (0 for others' words).
    One row per language and bin."""
    n = len(CLASSES) + 2
    sums = rows.filter("lang is not null").groupBy("lang").agg(F.sum("n_words").alias("words"), *[F.sum(F.get("classes", F.lit(i)).cast("long")).alias(f"c{i}") for i in range(n)])
    times = rows.filter("lang is not null").select("lang", F.explode("commons").alias("b")).groupBy("lang", "b.word").agg(F.sum("b.times").alias("times"))
    met = {(r["lang"], r["word"]): r["times"] for r in times.collect()}
    own = {lang: {bins.index(w) for of, w in common if of == lang} for lang in {of for of, _ in common}}
    out = []
    for r in sorted(sums.collect(), key=lambda r: r["lang"]):
        chars = [r[f"c{i}"] for i in range(n)]
        if sum(chars) and r["words"]:
            shares = [met.get((r["lang"], i), 0) / r["words"] if i in own.get(r["lang"], ()) else 0.0 for i in range(len(bins))]
            out.append({"lang": r["lang"], "classes": [x / sum(chars) for x in chars], "commons": shares})
    return out


def _term(p: Column, q: Column) -> Column:
    m = (p + q) / 2
    return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)


def distance(counts: Column, shares: Column) -> Column:
    """Jensen-Shannon distance, base 2, of a histogram from reference shares (both arrays)."""
    total = F.aggregate(counts, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    divergence = let(total, lambda n: F.aggregate(F.zip_with(counts, shares, lambda x, q: _term(x.cast("double") / n, q)), F.lit(0.0), lambda acc, x: acc + x)) / 2
    return F.when(total > 0, F.sqrt(F.greatest(divergence, F.lit(0.0)))).otherwise(F.lit(1.0))


def word_distance(bins: Column, n_words: Column, shares: Column) -> Column:
    """The same for common words given as (number, times): words that are not the language's share one bin, and a common word that the text
    lacks adds half its share."""
    n = n_words.cast("double")
    own = F.filter(F.transform(bins, lambda b: F.struct((b["times"] / n).alias("p"), F.get(shares, b["word"]).alias("q"))), lambda x: x["q"] > 0)

    def of(x: Column) -> Column:
        add = lambda f: F.aggregate(F.transform(x, f), F.lit(0.0), lambda acc, v: acc + v)
        p, q = add(lambda v: v["p"]), add(lambda v: v["q"])
        every = F.aggregate(shares, F.lit(0.0), lambda acc, v: acc + v)
        rest = _term(F.greatest(1.0 - p, F.lit(0.0)), F.greatest(1.0 - every, F.lit(0.0)))
        return F.sqrt(F.greatest((add(lambda v: _term(v["p"], v["q"])) + (every - q) + rest) / 2, F.lit(0.0)))

    return F.when(n > 0, let(own, of)).otherwise(F.lit(1.0))


def nearest(refs: list[dict]) -> tuple[Column, Column]:
    """Structs (distance, lang) of the nearest language by character classes and by common words."""
    every = F.from_json(F.lit(json.dumps(refs)), "array<struct<lang:string,classes:array<double>,commons:array<double>>>")
    least = lambda f: F.array_min(F.transform(every, lambda r: F.struct(f(r).alias("distance"), r["lang"].alias("lang"))))
    return least(lambda r: distance(F.col("classes"), r["classes"])), least(lambda r: word_distance(F.col("commons"), F.col("n_words"), r["commons"]))


def limits(rows: DataFrame, name: str, spreads: float) -> dict[tuple[str | None, int], float]:
    """The limit of each language (None: of all) and length class. One row per language and power of two."""
    q = F.percentile_approx(F.col(f"{name}.distance"), [0.1587, 0.5], 10_000)
    got = rows.groupBy("length", F.col(f"{name}.lang").alias("lang")).agg(F.count("*").alias("n"), q.alias("q")).collect()
    every = rows.groupBy("length").agg(F.count("*").alias("n"), q.alias("q")).collect()
    keys = [((r["lang"], r["length"]), r) for r in got] + [((None, r["length"]), r) for r in every]
    return {k: r["q"][1] + spreads * (r["q"][1] - r["q"][0]) for k, r in keys if r["n"] >= MIN_CLASS}


def within(name: str, limit: dict[tuple[str | None, int], float]) -> Column:
    """Whether the distance is within the limit of its class."""
    if not limit:
        return F.lit(True)
    table = F.from_json(F.lit(json.dumps({f"{length} {lang or ''}": x for (lang, length), x in limit.items()})), "map<string,double>")
    own, every = F.concat_ws(" ", "length", f"{name}.lang"), F.concat(F.col("length").cast("string"), F.lit(" "))
    return F.col(f"{name}.distance") <= F.coalesce(F.try_element_at(table, own), F.try_element_at(table, every), F.lit(1.0))


def judged(docs: DataFrame, class_spreads: float = CLASS_SPREADS, word_spreads: float = WORD_SPREADS, min_words: int = 2 * MIN_WORDS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance, word_distance."""
    found = common_words(docs).collect()
    common = [(r["lang"], r["word"]) for r in found]
    often = {w: sum(r["n"] for r in found if r["word"] == w) for _, w in common}
    bins = sorted(often, key=lambda w: (-often[w], w))
    rows = cut(features(docs, bins))
    refs = references(rows, common, bins)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    if not refs:
        return rows.select(*base, failed.alias("base_failed"), (~failed).alias("kept"), F.lit(None).cast("double").alias("class_distance"), F.lit(None).cast("double").alias("word_distance"))
    by_class, by_word = nearest(refs)
    length = F.floor(F.log2(F.greatest(F.col("n_words"), F.lit(1)))).cast("int")
    rows = cut(rows.select(*base, failed.alias("base_failed"), length.alias("length"), by_class.alias("class"), by_word.alias("word")))
    good = rows.filter("not base_failed")
    verdict = within("class", limits(good, "class", class_spreads)) & ((F.col("n_words") < min_words) | within("word", limits(good, "word", word_spreads)))
    return rows.select(*base, "base_failed", (~F.col("base_failed") & verdict).alias("kept"), F.col("class.distance").alias("class_distance"), F.col("word.distance").alias("word_distance"))


#: Base rules in SQL, for tests and the oracle of those columns.
SQL = r"""
with w as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
g as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as s from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w)),
r as (select doc_id, i from (select *, count(*) over (partition by doc_id, s) as c from g) where c > 1),
k as (select doc_id, count(distinct j) as n from (select doc_id, unnest([i, i + 1, i + 2]) as j from r) group by doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars,
 cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
 cast((select count(*) - count(distinct x) from (select unnest(string_split(text, chr(10))) as x) where regexp_matches(x, '[^\x20\x09-\x0D]')) as bigint) as n_dup_lines,
 cast(coalesce(k.n, 0) as bigint) as n_repeat_words
from w left join k on k.doc_id = w.doc_id
"""
