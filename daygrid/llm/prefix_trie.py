"""Prefix trie of conversations: which beginnings are shared, by how many, and what sharing them saves.

Conversations become sequences of turn ids (128 bits of role and text); texts are not shuffled beyond that. Sequences are dealt to range shards
by their first HEAD turn ids and conv_id and sorted; a task reads its range in shards of at most SHARD turns, so its memory is bounded and a
beginning that very many share is dealt to as many tasks as it needs. A shard gives its turn ids dense numbers and lays them out as
padded matrices of BLOCK columns; numpy's lexsort orders the rows, change masks accumulated by OR along the columns mark where nodes
start, and reduceat sums each depth. A further block holds only the rows that reach it.

Only nodes on the way to a shard's first or last row, and those below HEAD turns beneath such a way, can have members in other shards. They
leave the shard as partial sums under a hash of their way from the root, the others as results. Partial sums are recombined by that
hash; then each of these nodes counts once, in the least shard that has it, sums of subtrees are made inside each shard, and summed by
hash. Ids of conversations that end at such a node are packed in order and hashed as a stream, since one SHA-256 goes over all of them.

Defined results: null role or text is empty; rows of a conversation with equal turn follow role, then turn id; repeated rows are turns of their
own; rows without a conv_id belong to no conversation; the base of conversation c is c - c % 100 with the sign of c for the remainder; a conversation
is one row of 20 bytes a turn, and one longer than a shard is a shard by itself; an empty table gives no nodes; extra columns
are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, tidy

#: Turn ids by which ranges are dealt, columns of a padded matrix, turns (at least one conversation) of a shard.
HEAD = 8
BLOCK = 32
SHARD = 200_000
#: Conversation ids in one packed piece.
PACKED = 1000
NO_ENDS = hashlib.sha256(b"").hexdigest()


def sequences(table: DataFrame, group: int = 100) -> DataFrame:
    """base, conv_id, turns: array of (a, b, n), the two halves of a turn's id and the code points of its text, in order. One exchange, by base."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = table.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), text, role).alias("b"), F.length(text).alias("n"))
    turn = F.struct(F.col("turn").isNotNull().alias("there"), "turn", "role", "a", "b", "n")
    rows = rows.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).repartition("base")
    return rows.groupBy("base", "conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t")).select("base", "conv_id", F.transform("t", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), x["n"].alias("n"))).alias("turns"))


def rebuilt(seqs: DataFrame, heads: int = 6) -> DataFrame:
    """Each conversation with the first h turns of its group's base in place of its own first h; h = crc32(conv_id) % heads."""
    own = F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, heads))
    rows = seqs.withColumn("first", F.max(own).over(Window.partitionBy("base")))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    rows = rows.withColumn("h", h)
    first = F.coalesce(F.slice("first", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    return rows.select("conv_id", F.concat(first, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def _by_segment(ufunc: np.ufunc, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return ufunc.reduceat(values, starts) if len(starts) else values[:0]


class Shard:
    """The trie of some consecutive conversations. Rows are conversations in the order of lexsort; nodes are found block by block."""

    def __init__(self, name: int, conv: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> None:
        self.name, self.conv, self.size, self.a, self.b, self.n = name, conv, size, a, b, n
        self.offset = np.cumsum(size) - size
        by = np.lexsort((b, a))
        new = np.r_[True, (a[by][1:] != a[by][:-1]) | (b[by][1:] != b[by][:-1])][: len(by)]
        self.ids = np.empty(len(by), np.int32)  # dense turn ids
        self.ids[by] = np.cumsum(new) - 1
        self.ordered()

    def ordered(self) -> None:
        """self.order, and per block of columns the positions of rows that reach it and where its nodes start (pads included)."""
        rows = len(self.conv)
        self.order = np.arange(rows)
        group = np.zeros(rows, np.int64)  # by position: rows alike so far have one number
        self.blocks = []
        longest = int(self.size.max())
        for at in range(0, max(longest, 1), BLOCK):
            pos = np.flatnonzero(self.size[self.order] > at) if at else np.arange(rows)
            which, width = self.order[pos], min(BLOCK, longest - at)
            matrix = np.full((len(pos), width), -1, np.int32)
            for k in range(width):
                has = self.size[which] > at + k
                matrix[has, k] = self.ids[self.offset[which[has]] + at + k]
            # A row that ends with the block comes before those that go on: in every node the rows that end there are the first.
            by = np.lexsort((self.conv[which], self.size[which] > at + width, *matrix.T[::-1], group[pos]))
            matrix, self.order[pos] = matrix[by], which[by]
            change = np.ones(matrix.shape, bool)
            change[1:] = matrix[1:] != matrix[:-1]
            if width:
                change[1:, 0] |= np.diff(group[pos]) != 0
                change = np.logical_or.accumulate(change, axis=1)
                group[pos] = np.cumsum(change[:, -1])
            self.blocks.append((at, pos, change, matrix >= 0))
        self.first, self.last = (int(np.flatnonzero(self.order == i)[0]) for i in (0, rows - 1))

    def depth(self, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of rows whose block has depth d >= 1, starts of segments among them, and whether a segment is a node (not a pad)."""
        at, pos, change, filled = self.blocks[(d - 1) // BLOCK]
        starts = np.flatnonzero(change[:, d - 1 - at])
        return pos, starts, filled[starts, d - 1 - at]

    def nodes(self) -> tuple[pd.DataFrame, pd.DataFrame]:
        """Finished nodes, and partial sums of those that other shards may share."""
        rows, deep = len(self.conv), int(self.size.max())
        conv, size = self.conv[self.order], self.size[self.order]
        spans, shared = [], np.ones(rows, bool)  # shared: the row's node at this depth is one that other shards may have
        least, key = conv.copy(), np.empty(rows, object)
        for d in range(deep + 1):
            if d:
                pos, starts, real = self.depth(d)
            else:
                pos, starts, real = np.arange(rows), np.zeros(1, np.int64), np.ones(1, bool)
            ends = np.r_[starts[1:], len(pos)]
            first, last, members = pos[starts[real]], pos[ends[real] - 1], (ends - starts)[real]
            own = _by_segment(np.minimum, conv[pos], starts)[real]
            parent, parent_key = (least[first].copy(), key[first].copy()) if d else (np.zeros(1, np.int64), np.array([None], object))
            here = shared[first] if d > HEAD else ((first <= self.first) & (self.first <= last)) | ((first <= self.last) & (self.last <= last))
            here = here & shared[first]
            done = _by_segment(np.add, (size[pos] == d).astype(np.int64), starts)[real]
            chars = self.n[self.offset[self.order[first]] + d - 1].astype(np.int64) if d else np.zeros(1, np.int64)
            names = np.full(len(first), None, object)
            for i in np.flatnonzero(here):
                at = self.offset[self.order[first[i]]] + d - 1
                names[i] = hashlib.blake2b((parent_key[i] + self.a[at].tobytes() + self.b[at].tobytes()) if d else b"", digest_size=16).digest()
            spread = np.repeat(np.arange(len(first)), members)
            inside = pos[np.repeat(real, ends - starts)]
            least[inside], key[inside], shared[inside] = own[spread], names[spread], here[spread]
            spans.append((first, members, own, parent, parent_key, here, done, chars, names))
        leaves, saved, below = np.zeros(rows, np.int64), np.zeros(rows, np.int64), (np.zeros(0, np.int64), np.zeros(0, bool))
        finished, partial = [], []
        for d in range(deep, -1, -1):
            first, members, own, parent, parent_key, here, done, chars, names = spans[d]
            kids, kid_here = below
            where = np.searchsorted(first, kids, "right") - 1
            children = np.bincount(where, minlength=len(first))
            quiet = np.bincount(where, ~kid_here, minlength=len(first)).astype(np.int64)
            leaves[first[~here & (children == 0)]] += 1
            saved[first[~here]] += ((members - 1) * chars)[~here]
            # A node's rows are its segment; what stands between segments are rows that ended before and hold nothing deeper.
            sum_leaves, sum_saved = (_by_segment(np.add, x, first) for x in (leaves, saved))
            ended = self.ends(first, done, conv)
            cols = {"conv_id": own, "depth": np.full(len(first), d), "n_convs": members, "n_leaves": sum_leaves, "saved": sum_saved}
            for out, mask, more in (
                (finished, ~here, {"parent_conv_id": parent, "parent_key": parent_key, "n_children": children}),
                (partial, here, {"key": names, "parent_key": parent_key, "n_children": quiet, "chars": chars}),
            ):
                if mask.any():
                    out.append(pd.DataFrame({k: v[mask] for k, v in (cols | more).items()} | {"ends": [ended[i] for i in np.flatnonzero(mask)]}))
            below = (first, here)
        return pd.concat(finished) if finished else None, pd.concat(partial).assign(shard=self.name)

    def ends(self, first: np.ndarray, done: np.ndarray, conv: np.ndarray) -> list[np.ndarray]:
        """Ids of the conversations that end at each node, ascending: they are its first rows."""
        return [conv[s : s + n] for s, n in zip(first, done)]


FINISHED = "conv_id long, depth long, parent_conv_id long, parent_key binary, n_convs long, n_children long, n_leaves long, saved long, ends_sha256 string"
PARTIAL = "shard long, key binary, chars long, ends array<string>, end_ids array<long>"


def _joined(ids: np.ndarray) -> str:
    return ",".join(map(str, ids.tolist()))


def shards(rows: DataFrame, shard_turns: int = SHARD) -> DataFrame:
    """Rows of both kinds (FINISHED, then PARTIAL columns) of all shards. rows: conv_id, turns."""

    def shaped(shard: Shard) -> Iterator[pd.DataFrame]:
        finished, partial = shard.nodes()
        if finished is not None:
            known = finished["parent_key"].isna()
            finished["parent_conv_id"] = finished["parent_conv_id"].where(known).astype("Int64")
            finished["ends_sha256"] = [hashlib.sha256(_joined(x).encode()).hexdigest() if len(x) else None for x in finished.pop("ends")]
            yield finished.assign(shard=None, key=None, chars=None, ends=None, end_ids=None)
        packs = [[x[i : i + PACKED] for i in range(0, len(x), PACKED)] for x in partial.pop("ends")]
        yield partial.assign(parent_conv_id=None, ends_sha256=None, ends=[[_joined(x) for x in p] for p in packs], end_ids=[[int(x[0]) for x in p] for p in packs])

    fields = [x.split()[0] for x in f"{FINISHED}, {PARTIAL}".split(", ")]
    arrow = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}[t]) for n, t in (x.split() for x in f"{FINISHED}, {PARTIAL}".split(", "))])

    @tidy
    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        turns = count = 0
        part = 0

        def run() -> Iterator[pa.RecordBatch]:
            conv, size, a, b, n = (np.concatenate([h[k] for h in held]) for k in range(5))
            for frame in shaped(Shard((part << 20) + count, conv, size, a, b, n)):
                for i in range(0, len(frame), 10_000):
                    yield pa.RecordBatch.from_pandas(frame.iloc[i : i + 10_000][fields], arrow, preserve_index=False)

        for big in batches:
            conv = big.column(0).to_numpy()
            part = int(big.column(2)[0].as_py()) if big.num_rows else part
            lists = big.column(1)
            flat = lists.flatten()
            a, b, n = (flat.field(k).to_numpy() for k in range(3))
            size = np.diff(lists.offsets.to_numpy())
            edge = np.r_[0, np.cumsum(size)]
            i = 0
            while i < len(conv):
                room = max(shard_turns - turns, 1)
                j = max(int(np.searchsorted(edge + np.arange(len(edge)), edge[i] + i + room, "right")) - 1, i + (not held))
                if j > i:
                    held.append(tuple(np.array(x) for x in (conv[i:j], size[i:j], a[edge[i] : edge[j]], b[edge[i] : edge[j]], n[edge[i] : edge[j]])))
                    turns += int(edge[j] - edge[i]) + j - i
                if j < len(conv):
                    yield from run()
                    held.clear()
                    turns, count = 0, count + 1
                i = j
        if held:
            yield from run()

    return rows.withColumn("part", F.spark_partition_id()).mapInArrow(per_task, f"{FINISHED}, {PARTIAL}")


def _ends_hashed(partial: DataFrame) -> DataFrame:
    """key, ends_sha256 of nodes at which conversations end: packed ids in order, hashed as a stream in bounded memory."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h = None, None
        for b in batches:
            keys, ready = [], []
            for key, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if key == now:
                    h.update(b"," + ids.encode())
                    continue
                if now is not None:
                    keys.append(now)
                    ready.append(h.hexdigest())
                now, h = key, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ready, pa.string())], ["key", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([h.hexdigest()])], ["key", "ends_sha256"])

    packs = partial.select("key", F.explode(F.arrays_zip("end_ids", "ends")).alias("x")).select("key", F.col("x.end_ids").alias("first"), F.col("x.ends").alias("ids"))
    return packs.repartition("key").sortWithinPartitions("key", "first").select("key", "ids").mapInArrow(per_task, "key binary, ends_sha256 string")


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one shard: what its shared nodes add to the sums of those above them; each gives its sum to its parent, the deepest first."""
    rows = rows.sort_values("depth", ascending=False, kind="stable").reset_index(drop=True)
    place = {k: i for i, k in enumerate(rows["key"])}
    leaf, own = rows["leaf"].to_list(), rows["own"].to_list()
    for i, up in enumerate(rows["parent_key"]):
        if up is not None:
            leaf[place[up]] += leaf[i]
            own[place[up]] += own[i]
    return pd.DataFrame({"key": rows["key"], "n_leaves": rows["n_leaves"] + leaf, "saved": rows["saved"] + own})


def recombined(partial: DataFrame) -> DataFrame:
    """One row a shared node from the partial sums of shards."""
    sums = [F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("quiet"), F.min("shard").alias("owner"), F.max("chars").alias("chars")]
    nodes = cut(partial.groupBy("key", "parent_key", "depth").agg(*sums))
    kids = nodes.filter("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("more"))
    nodes = nodes.join(kids, "key", "left").withColumn("n_children", F.col("quiet") + F.coalesce("more", F.lit(0)))
    nodes = cut(nodes.select("key", "parent_key", "depth", "conv_id", "n_convs", "n_children", "owner", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("own")))
    once = nodes.select("key", F.col("owner").alias("shard"), "leaf", "own")
    local = partial.select("shard", "key", "parent_key", "depth", "n_leaves", "saved").join(once, ["key", "shard"], "left")
    local = local.fillna(0, ["leaf", "own"])
    total = local.groupBy("shard").applyInPandas(_summed, "key binary, n_leaves long, saved long").groupBy("key").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    return nodes.drop("owner", "leaf", "own").join(total, "key").join(_ends_hashed(partial), "key", "left")


def trie(seqs: DataFrame, shard_turns: int = SHARD) -> DataFrame:
    """seqs(conv_id, turns): a row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    order = [F.slice("turns", 1, HEAD), F.col("conv_id")]
    found = cut(shards(seqs.repartitionByRange(*order).sortWithinPartitions(*order), shard_turns))
    shared = cut(recombined(found.filter("key is not null")))
    above = shared.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256"]
    alone = found.filter("key is null")
    inner = alone.filter("parent_key is null").select(names)
    outer = alone.filter("parent_key is not null").drop("parent_conv_id").join(above, "parent_key").withColumnRenamed("above", "parent_conv_id").select(names)
    edge = shared.join(above, "parent_key", "left").withColumnRenamed("above", "parent_conv_id").select(names)
    every = inner.union(outer).union(edge)
    return every.select(*names[:6], F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))


def nodes(table: DataFrame, shard_turns: int = SHARD) -> DataFrame:
    """The trie of a table's rebuilt conversations."""
    return trie(rebuilt(sequences(table)), shard_turns)
