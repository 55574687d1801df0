"""Lines that stand in many documents.

Normalised lines are exploded as (128-bit hash, document), counted by distinct documents per hash, and those over the threshold are joined
back to their documents; each text is then read again and put together, in order of position, from the lines that stay. A line is
normalised by stripping ASCII white space at both ends and lower-casing A-Z. Lines too short to be dropped are not exploded. Only hashes
and ids are shuffled for the counts, and texts once, to meet the hashes that they lose. Both joins are left to Spark, which broadcasts
a side that it has measured to be small and splits the partitions of a line that very many documents share; the counts are
combined before they are shuffled.

Defined results: a null or empty text is one empty line; of a line over the threshold the largest doc_id that holds it keeps
all its copies; rows of one id are one document, and each loses the same lines; a row without an id is a document
by its text, less than any with an id (among such, the largest hash of the text keeps the line); a text of any length is
read line by line; an empty table gives no rows; extra columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

#: Code points of a normalised line, and documents that hold it, from which on it is dropped.
MIN_CHARS = 40
MIN_DOCS = 5
#: Texts of an Arrow batch that are handled at once.
ROWS = 256
_white = b" \t\n\x0b\x0c\r"


def hashed(line: bytes, min_chars: int) -> bytes | None:
    """Hash of a line's normal form; None if that is short. In UTF-8 a code point takes 1 to 4 bytes, and bytes.lower() changes A-Z alone."""
    key = line.strip(_white).lower()
    n = len(key)
    if n < min_chars or n < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def _documents(docs: DataFrame) -> DataFrame:
    """id, own (tells rows without an id apart, else null), text as bytes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text.alias("text"))
    return rows.select("id", F.when(F.col("id").isNull(), F.xxhash64("text")).alias("own"), F.col("text").cast("binary").alias("text"))


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """id, own, gone: the hashes of the lines that each document loses; only documents that lose any."""

    @tidy
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for i in range(0, big.num_rows, ROWS):
                b = big.slice(i, ROWS)
                at, hashes = [], []
                for row, text in enumerate(b.column(2).to_pylist()):
                    found = {hashed(line, min_chars) for line in text.split(b"\n")}
                    found.discard(None)
                    hashes += found
                    at += [row] * len(found)
                where = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).take(where), b.column(1).take(where), pa.array(hashes, pa.binary())], ["id", "own", "line"])

    held = _documents(docs).mapInArrow(explode, "id long, own long, line binary").distinct()
    over = held.groupBy("line").agg(F.count("*").alias("n"), F.max("id").alias("last"), F.max("own").alias("last_own")).filter(F.col("n") >= min_docs)
    keeps = F.when(F.col("last").isNull(), F.col("own") == F.col("last_own")).otherwise(F.coalesce(F.col("id") == F.col("last"), F.lit(False)))
    return held.join(over, "line").filter(~keeps).groupBy("id", "own").agg(F.collect_list("line").alias("gone"))


def deduplicated(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, text (what stays), n_lines (before dropping), n_dropped of each row of docs."""

    @tidy
    def reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for i in range(0, big.num_rows, ROWS):
                b = big.slice(i, ROWS)
                texts, n, dropped = [], [], []
                for text, gone in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                    lines = text.split(b"\n")
                    if gone:
                        bad = set(gone)
                        kept = [line for line in lines if hashed(line, min_chars) not in bad]
                        text = b"\n".join(kept)
                    texts.append(text)
                    n.append(len(lines))
                    dropped.append(len(lines) - len(kept) if gone else 0)
                cols = [b.column(0), pa.array(texts, pa.binary()), pa.array(n, pa.int64()), pa.array(dropped, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text", "n_lines", "n_dropped"])

    lost = dropped_lines(docs, min_chars, min_docs).select(F.col("id").alias("lost_id"), F.col("own").alias("lost_own"), "gone")
    there = F.col("id").eqNullSafe(F.col("lost_id")) & F.col("own").eqNullSafe(F.col("lost_own"))
    rows = _documents(docs).join(lost, there, "left").select("id", "text", "gone")
    out = rows.mapInArrow(reassemble, "doc_id long, text binary, n_lines long, n_dropped long")
    return out.select("doc_id", F.col("text").cast("string").alias("text"), "n_lines", "n_dropped")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    return deduplicated(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
with split as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select doc_id, generate_subscripts(ls, 1) as i, unnest(ls) as line from split),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
o as (select key, max(doc_id) as last from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
j as (select k.*, coalesce(k.doc_id < o.last, false) as gone from k left join o using (key))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from j group by doc_id
"""
