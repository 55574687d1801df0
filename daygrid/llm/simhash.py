"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked at few differing bits.

Candidate search embeds a fingerprint as the popcounts of its 16 four-bit segments. The Manhattan distance of two embeddings
is never more than the Hamming distance, so fingerprints at 2 bits lie within 2 in the grid. The range join takes each fingerprint to the
grid cells within 1 of it: two within 2 of each other share one (a midpoint), and two that share one are within 2. A cell's fingerprints
are compared by exact popcount of their exclusive or. Equal fingerprints are merged first, so copies cost one row. A cell with more than
CELL different fingerprints is split instead of compared pair by pair: two fingerprints at 2 bits have a 64-bit word within 1 bit of both whose
popcounts are the cell, so the cell's fingerprints are grouped by such words (65 at most to a word), compared there, and no link is lost.

Defined results: null, empty or wordless text has fingerprint zero and links like any other; texts of one or two words hash
the whole sequence; repeated rows of an id give a row each; an empty table gives no rows; extra columns are ignored."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, own_name
from .components import components

SEED = 42
SHINGLE = 3
SEGMENT_BITS = 4
#: Bits in which linked fingerprints may differ, and fingerprints of a grid cell that are compared with each other; more are split.
RADIUS = 2
CELL = 64
_words = re.compile(WORD).findall
_lower = {c: c + 32 for c in range(65, 91)}
#: Shingles whose bits are counted at once; bounds memory for very long texts.
CHUNK = 1 << 16


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """Bit b is 1 if it is set in over half the XXH64 values (seed 42) of the k-word shingles, repeats included."""
    ws = [w.encode("utf-8", "surrogatepass") for w in _words((text or "").translate(_lower) if not (text or "").isascii() else (text or "").lower())]
    if not ws:
        return 0
    joined, digest = b" ".join(ws), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    if len(ws) <= k:
        starts, stops = [0], [len(joined)]
    else:
        starts = np.concatenate(([0], ends[: len(ws) - k] + 1)).tolist()
        stops = ends[k - 1 :].tolist()
    bits, view = np.zeros(64, np.int64), memoryview(joined)
    for i in range(0, len(starts), CHUNK):
        h = np.fromiter((digest(view[a:b], SEED) for a, b in zip(starts[i : i + CHUNK], stops[i : i + CHUNK], strict=True)), np.uint64, min(CHUNK, len(starts) - i))
        bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long)."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, k) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(per_batch, "doc_id long, fp long")


def _bit(i: int) -> int:
    return (1 << i) - (1 << 64) * (i == 63)


def cells(fp: Column) -> Column:
    """Grid cells within Manhattan distance 1 of the embedding: packed popcounts, three bits a segment. Cells outside the grid
    (a count below 0 or above 4) are left out: no fingerprint is a midpoint there."""
    n = 64 // SEGMENT_BITS
    counts = [F.bit_count(F.shiftrightunsigned(fp, SEGMENT_BITS * s).bitwiseAND((1 << SEGMENT_BITS) - 1)).cast("long") for s in range(n)]
    own = counts[0]
    for s in range(1, n):
        own = own + F.shiftleft(counts[s], 3 * s)

    def around(base: Column) -> Column:
        near = [base]
        for s in range(n):
            near += [F.when(counts[s] > 0, base - F.lit(1 << 3 * s)), F.when(counts[s] < SEGMENT_BITS, base + F.lit(1 << 3 * s))]
        return F.array_compact(F.array(*near))

    return F.transform(F.array(own), around)[0]


def midpoints(fp: Column, cell: Column) -> Column:
    """The 64-bit words within 1 bit of fp whose embedding is the cell."""
    flipped = F.array(fp, *[fp.bitwiseXOR(F.lit(_bit(i))) for i in range(64)])
    return F.filter(flipped, lambda w: embed(w) == cell)


def embed(fp: Column) -> Column:
    n = 64 // SEGMENT_BITS
    out = F.lit(0).cast("long")
    for s in range(n):
        out = out + F.shiftleft(F.bit_count(F.shiftrightunsigned(fp, SEGMENT_BITS * s).bitwiseAND((1 << SEGMENT_BITS) - 1)).cast("long"), 3 * s)
    return out


def verified(group: Column) -> Column:
    """Links (a, b) of a group of fingerprints that differ in RADIUS bits or fewer."""
    near = lambda x: F.transform(F.filter(group, lambda y: (y < x) & (F.bit_count(x.bitwiseXOR(y)) <= RADIUS)), lambda y: F.struct(x.alias("a"), y.alias("b")))
    return F.flatten(F.transform(group, near))


def links(fps: DataFrame, cell: int = CELL) -> DataFrame:
    """fps(fp): distinct fingerprints. Returns the links (a, b); of a split cell, those through each word."""
    placed = fps.select("fp", F.explode(cells(F.col("fp"))).alias("cell"))
    shared = placed.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1")
    near = placed.join(shared.hint("merge"), "cell")  # an explode's rows are not in Spark's estimate: it would broadcast all of placed
    small = near.filter(F.col("n") <= cell).groupBy("cell").agg(F.collect_list("fp").alias("members")).select(F.explode(verified(F.col("members"))).alias("p"))
    split = near.filter(F.col("n") > cell).select("cell", "fp", F.explode(midpoints(F.col("fp"), F.col("cell"))).alias("word"))
    words = split.groupBy("cell", "word").agg(F.collect_list("fp").alias("members")).filter(F.size("members") > 1).select(F.explode(verified(F.col("members"))).alias("p"))
    return small.unionByName(words).select("p.a", "p.b").distinct()


def near_duplicates(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable over links, a document's own included."""
    fps = cut(fingerprints(docs, k))
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    comps = components(links(least.select("fp")))
    rooted = cut(least.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    first = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(rooted.join(first, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


#: Ids of dropped documents are sent to all tasks up to this many (8 bytes each); beyond, the join is by shuffle.
BROADCAST_IDS = 1_000_000


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each group stays: the one with the smallest id (of repeated rows of that id, one). Rows without an id stay."""
    return first_of_each(docs, cut(near_duplicates(docs.filter("doc_id is not null")).select("doc_id", "component_id")))


def first_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """docs without those that groups(doc_id, component_id) put under another document; rows without an id stay."""
    name = own_name(docs, "gone")
    gone = cut(groups.filter("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct())
    kept = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, F.col("doc_id") == F.col(name), "left_anti")
    if groups.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return kept
    return kept.filter("doc_id is not null").dropDuplicates(["doc_id"]).union(kept.filter("doc_id is null"))
