"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer numpy network with temperature-calibrated
probabilities.

Every token (a word or a run of marks, lower case) has a sparse ternary index vector of its own, taken from its 64-bit hash. Context vectors,
sums of the neighbours' index vectors over all documents, are kept for HASHED buckets of tokens, so the table has the same size whatever
the corpus; tokens of one bucket share a context (the README gives the measured share). Tasks add up what they read and Spark sums the tasks'
tables by bucket. A document is the frequency-damped mean of its tokens' context vectors and of their index vectors, with a few shape
figures (length, variety, marks).

The network learns from a bounded sample of labelled rows whose crc32(doc_id) mod 3 is not 1 (the sample_rows lowest by crc32); a
fifth of it is kept back to fit the temperature.

Defined results: null, empty and tokenless texts pool to zeros and get the score of that; without labels of both kinds every score is
0.5; a document with several label rows counts once, with its highest label; repeated rows are scored alike; very long texts are
scored whole, in chunks; an empty table gives no rows; extra columns are ignored."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold
from .toxicity import sampled

HASHED = 1 << 14
DIM = 64
NONZERO = 4
REACH = 2
HIDDEN = 32
SAMPLE_ROWS = 20_000
CHUNK = 1 << 19
#: Token vectors that are added up at once.
ROWS = 1 << 15
SHAPE = 8
_tokens = re.compile(r"\w+|[^\w\s]+").findall


def parts(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of token hashes: buckets, and places and signs of the index vectors' nonzero entries (a row for each)."""
    bits = h[None, :] >> (14 + 6 * np.arange(NONZERO, dtype=np.uint64))[:, None]
    signs = h[None, :] >> (40 + np.arange(NONZERO, dtype=np.uint64))[:, None]
    return (h % np.uint64(HASHED)).astype(np.int64), (bits % np.uint64(DIM)).astype(np.int64), 1.0 - 2.0 * (signs & np.uint64(1)).astype(float)


class Memo(dict):
    """Hashes of the tokens met so far."""

    def __missing__(self, token: str) -> int:
        self[token] = h = xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"))
        return h


class Hashes:
    """Hashes of a text's tokens."""

    def __init__(self) -> None:
        self.memo = Memo()

    def __call__(self, text: str | None) -> np.ndarray:
        if len(self.memo) > 300_000:
            self.memo.clear()
        return np.array(list(map(self.memo.__getitem__, _tokens((text or "").lower()))), np.uint64)


def context_sums(docs: DataFrame) -> DataFrame:
    """bucket, n and v0..v63: occurrences and summed index vectors of neighbours, over all documents."""
    names = ["bucket", "n", *(f"v{i}" for i in range(DIM))]

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, table, seen = Hashes(), np.zeros((HASHED + 1) * DIM), np.zeros(HASHED + 1, np.int64)
        held: list[np.ndarray] = []

        def add() -> None:
            nonlocal table
            gap = np.full(REACH, HASHED)
            each = [parts(h) for h in held]
            # Gaps between texts are of a bucket of their own and add nothing.
            bucket = np.concatenate([x for b, _, _ in each for x in (gap, b)] + [gap])
            place = np.hstack([x for _, p, _ in each for x in (np.zeros((NONZERO, REACH), np.int64), p)] + [np.zeros((NONZERO, REACH), np.int64)])
            sign = np.hstack([x for _, _, g in each for x in (np.zeros((NONZERO, REACH)), g)] + [np.zeros((NONZERO, REACH))])
            held.clear()
            seen[:] += np.bincount(bucket, minlength=HASHED + 1)
            for far in range(1, REACH + 1):
                for own, near in ((slice(None, -far), slice(far, None)), (slice(far, None), slice(None, -far))):
                    for k in range(NONZERO):
                        table += np.bincount(bucket[own] * DIM + place[k, near], sign[k, near], (HASHED + 1) * DIM)

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(of(text))
                if len(held[-1]) > CHUNK or len(held) > 500:
                    add()
        if held:
            add()
        used = np.flatnonzero(seen[:HASHED])
        rows = table.reshape(HASHED + 1, DIM)[used].astype(np.int64)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(seen[used]), *(pa.array(rows[:, i]) for i in range(DIM))], names)

    got = docs.select(F.col("text").cast("string")).mapInArrow(per_task, ", ".join(f"{n} long" for n in names))
    return got.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names[1:]])


def vectors(sums: pd.DataFrame) -> np.ndarray:
    """One row per bucket: its damped unit context vector, and the damping."""
    b = sums["bucket"].to_numpy()
    seen, context = np.zeros(HASHED), np.zeros((HASHED, DIM))
    seen[b] = sums["n"]
    context[b] = sums[[f"v{i}" for i in range(DIM)]]
    damp = 1e-3 / (1e-3 + seen / max(seen.sum(), 1))
    context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
    return np.hstack((context * damp[:, None], damp[:, None])).astype(np.float32)


def pooled(text: str | None, of: Hashes, table: np.ndarray) -> np.ndarray:
    h, text = of(text), text or ""
    out = np.zeros(2 * DIM + SHAPE, np.float32)
    n, chars = len(h), max(len(text), 1)
    out[-8:-5] = np.log1p(n), np.log1p(chars), np.log1p(text.count("\n"))
    if n:
        used, times = np.unique(h, return_counts=True)
        for i in range(0, len(used), ROWS):
            bucket, place, sign = parts(used[i : i + ROWS])
            rows, count = table[bucket], times[i : i + ROWS]
            out[:DIM] += count.astype(np.float32) @ rows[:, :DIM]
            weights = sign * (count * rows[:, DIM] / np.sqrt(NONZERO))
            out[DIM : 2 * DIM] += np.bincount(place.ravel(), weights.ravel(), DIM).astype(np.float32)
        out[:-SHAPE] /= n
        out[-5:] = len(used) / n, np.log(times.max() / n), chars / n, sum(map(text.count, "#*$%&|<>")) / chars, sum(map(text.count, ".!?")) / chars
    return out


def network(x: np.ndarray, y: np.ndarray, epochs: int = 150, seed: int = 3) -> dict:
    """Two layers by Adam on minibatches, with weight decay; temperature by the least log-loss on every fifth row."""
    rng = np.random.default_rng(seed)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = (x - mean) / spread
    back = np.arange(len(z)) % 5 == 4
    p = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    zt, yt = z[~back], y[~back]
    for _ in range(epochs):
        order = rng.permutation(len(zt))
        for i in range(0, len(order), 256):
            a, t = zt[order[i : i + 256]], yt[order[i : i + 256]]
            h = np.tanh(a @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - t) / len(t)
            dh = d[:, None] * p[2] * (1 - h * h)
            grads, step = [a.T @ dh + 2e-3 * p[0], dh.sum(axis=0), h.T @ d + 2e-3 * p[2], d.sum(keepdims=True)], step + 1
            for q, g, mm, vv in zip(p, grads, m, v, strict=True):
                mm += 0.1 * (g - mm)
                vv += 0.001 * (g * g - vv)
                q -= 3e-3 * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)
    net = {"mean": mean, "spread": spread, "p": p, "t": 1.0}
    if back.any() and len(set(y[back])) == 2:
        raw = logits(net, x[back])
        loss = {t: float(np.logaddexp(0, -raw / t * (2 * y[back] - 1)).mean()) for t in np.geomspace(0.5, 8, 25)}
        net["t"] = min(loss, key=loss.get)
    return net


def logits(net: dict, x: np.ndarray) -> np.ndarray:
    w1, b1, w2, b2 = net["p"]
    return (np.tanh(((x - net["mean"]) / net["spread"]) @ w1 + b1) @ w2 + b2) / net["t"]


def trained(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict:
    table = vectors(context_sums(docs).toPandas())
    known = docs.sparkSession.sparkContext.broadcast(table)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Hashes()
        for b in batches:
            rows = [pooled(t, of, known.value).tolist() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float32())), b.column(1)], ["x", "y"])

    rows = sampled(docs, labels, "quality", 3, 1, sample_rows).mapInArrow(measure, "x array<float>, y int").toPandas()
    model: dict = {"table": table, "net": None}
    if rows["y"].nunique() == 2:
        x, y = np.array(rows["x"].tolist(), np.float32).astype(float), rows["y"].to_numpy(float)
        order = np.lexsort((*x.T[::-1], y))  # one order, then one shuffle: reruns agree
        order = order[np.random.default_rng(11).permutation(len(order))]
        model["net"] = network(x[order], y[order])
    return model


def scorer(spark, model: dict):
    known = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bucket, m = Hashes(), known.value
        for t in texts:
            if m["net"] is None or not len(t):
                yield pd.Series([0.5] * len(t), dtype="float64")
                continue
            x = np.array([pooled(s, bucket, m["table"]) for s in t], float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(logits(m["net"], x), -30, 30))))

    return of


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    of = scorer(docs.sparkSession, trained(docs, labels))
    out = docs.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), of(F.col("text").cast("string")).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
