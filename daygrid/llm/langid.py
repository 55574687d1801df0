"""Language identification with interpolated Kneser-Ney character models in sorted hash arrays.

Text is composed (NFC) and lower-cased, every run of non-letters is one boundary, and a character is folded to 16 bits, so a 4-gram is one 64-bit
key and the key of a shorter gram is its low bits. Tasks count distinct 4-grams of all training rows by language; Spark sums
them. Raw counts serve the highest order, distinct left contexts the lower ones; each order is discounted by n1/(n1+2 n2) and
interpolated with the next, down to a uniform share. The model holds, for each order, one sorted array of the keys seen in any
language and, beside it, the log-probability in every language; a missing key backs off with its context's weight.

No gram is pruned: the model grows with the distinct 4-grams of the training rows. It is sent to all tasks in blocks of languages, each below
BLOCK_BYTES (a block holds one language at least); texts are measured against one block after another, and a language's figures do not depend
on its block.

Models know the texts they were fitted on by heart, so one in APART training texts, by its hash (copies stay together), is kept from them and
tells what they make of texts they have not seen; a language with texts of that part alone is fitted on those and tells nothing. Each
language's rejection limit comes from all told rows nearest to it (a language that no long enough one is nearest to gets the highest limit of
the others). The score is a softmax over languages of cross-entropy times the root of the length, with the one sharpness of SHARPNESS that
gives the told rows' own languages the least log-loss, mixed with an even share for the lapses that no margin foretells: (wrong + 1) / (rows
+ 2) of the told rows. It can't pass what those rows bear out; without such rows it says little.

Defined results: null text or text without a letter is 'und' with score 0 and rejected; a table without training rows makes
every document 'und' and rejects none; ties between languages go to the first by name; repeated rows are scored alike (and counted each);
extra columns are ignored; very long texts are scored whole, in chunks."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fold, give_back, own_name, tidy

ORDER = 4
#: A text is rejected above its language's 99.9 % training quantile times this.
MARGIN = 1.5
#: Accuracy of that quantile: its rank is off by at most one RANKS-th of the rows.
RANKS = 100_000
SHARPNESS = tuple(float(x) for x in np.geomspace(0.05, 50, 31))
#: Bytes of a block's arrays.
BLOCK_BYTES = 256 << 20
#: One in so many training texts sets sharpness and limits instead of being counted.
APART = 5
#: Texts with fewer characters than this have too noisy an entropy to be rejected.
MIN_CHARS = 40
CHUNK = 1 << 18
_tables: dict[str, np.ndarray] = {}


def letters() -> np.ndarray:
    """For each code point below 0x30000, its 16-bit fold if it is a letter, else 0."""
    if "letters" not in _tables:
        _tables["letters"] = np.array([(c & 0xFFFF or 1) if chr(c).isalpha() else 0 for c in range(0x30000)], np.uint16)
    return _tables["letters"]


def symbols(text: str | None) -> np.ndarray:
    """Folded letters of the lower-cased text with one 0 for each run of others, and one at each end. Empty without letters."""
    code = np.frombuffer(unicodedata.normalize("NFC", text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    sym = np.where(code < 0x30000, letters()[np.minimum(code, 0x2FFFF)], 0)
    sym = np.concatenate((np.zeros(1, np.uint16), sym.astype(np.uint16), np.zeros(1, np.uint16)))
    sym = sym[np.concatenate(([True], (sym[1:] != 0) | (sym[:-1] != 0)))]
    return sym if len(sym) > 2 else sym[:0]


def grams(sym: np.ndarray) -> np.ndarray:
    """Key of the 4-gram that ends at each symbol but the first boundary."""
    s = np.concatenate((np.zeros(ORDER - 2, np.uint64), sym.astype(np.uint64)))
    key = np.zeros(len(sym) - 1, np.uint64)
    for i in range(ORDER):
        key |= s[i : i + len(key)] << np.uint64(16 * (ORDER - 1 - i))
    return key


def low(key: np.ndarray, n: int) -> np.ndarray:
    return key & np.uint64((1 << 16 * n) - 1)


def _counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    uniq, inverse = np.unique(keys, return_inverse=True)
    return uniq, np.bincount(inverse, counts, len(uniq)).astype(np.int64)


@dataclass
class Model:
    langs: list[str]
    keys: list[np.ndarray]  # by order, from 1
    logp: list[np.ndarray]  # rows beside keys, a column for each language
    contexts: list[np.ndarray]  # by order of the gram they precede, from 2
    back: list[np.ndarray]
    floor: np.ndarray

    def scores(self, key: np.ndarray) -> np.ndarray:
        """Log-probability of the last character of each 4-gram, in each language."""
        return self._order(key, ORDER)

    def _order(self, key: np.ndarray, n: int) -> np.ndarray:
        if n == 0:
            return np.broadcast_to(self.floor, (len(key), len(self.langs)))
        k, table = low(key, n), self.keys[n - 1]
        at = np.searchsorted(table, k)
        at[at == len(table)] = 0
        out, missing = self.logp[n - 1][at], np.flatnonzero(table[at] != k)
        if len(missing):
            rest = np.array(self._order(key[missing], n - 1), np.float32)
            if n > 1 and len(self.contexts[n - 2]):
                ctx = k[missing] >> np.uint64(16)
                c = np.searchsorted(self.contexts[n - 2], ctx)
                c[c == len(self.contexts[n - 2])] = 0
                rest += np.where((self.contexts[n - 2][c] == ctx)[:, None], self.back[n - 2][c], 0)
            out[missing] = rest
        return out

    def entropy(self, text: str | None) -> tuple[np.ndarray, int]:
        """Cross-entropy a character in each language, and the number of characters."""
        sym = symbols(text)
        if not len(sym):
            return np.zeros(len(self.langs)), 0
        key, total = grams(sym), np.zeros(len(self.langs))
        for i in range(0, len(key), CHUNK):
            total -= self.scores(key[i : i + CHUNK]).sum(axis=0, dtype=np.float64)
        return total / len(key), len(key)


def fit(counts: pd.DataFrame, chars: np.ndarray | None = None) -> Model:
    """counts: lang, key (of a 4-gram, as a signed long), n. chars: the characters of all languages, where counts holds only some of them."""
    langs = sorted(counts["lang"].unique())
    if not langs:
        return Model([], [], [], [], [], np.zeros(0))
    own: list[list[tuple[np.ndarray, np.ndarray]]] = []
    for lang in langs:
        part = counts[counts["lang"] == lang]
        k4, c4 = _counted(part["key"].to_numpy(np.int64).view(np.uint64), part["n"].to_numpy(np.float64))
        by = [(k4, c4)]
        for n in range(ORDER - 1, 0, -1):
            by.insert(0, _counted(low(by[0][0], n)))
        own.append(by)
    keys = [np.unique(np.concatenate([o[n][0] for o in own] + ([chars] if chars is not None and not n else []))) for n in range(ORDER)]
    floor = np.full(len(langs), -np.log(len(keys[0]) + 1.0))
    logp, contexts, back, below = [], [], [], None
    for n in range(1, ORDER + 1):
        k = keys[n - 1]
        ctx_all = np.unique(k >> np.uint64(16))
        p, b = np.zeros((len(k), len(langs))), np.zeros((len(ctx_all), len(langs)))
        for j, o in enumerate(own):
            ko, co = o[n - 1]
            once, twice = (co == 1).sum(), (co == 2).sum()
            d = once / (once + 2 * twice) if once and twice else 0.5
            ctx, total = _counted(ko >> np.uint64(16), co)
            _, kinds = _counted(ko >> np.uint64(16))
            gamma = np.ones(len(ctx_all))
            gamma[np.searchsorted(ctx_all, ctx)] = np.maximum(d * kinds / total, 1e-9)
            c, t = np.zeros(len(k)), np.ones(len(ctx_all))
            c[np.searchsorted(k, ko)] = np.maximum(co - d, 0)
            t[np.searchsorted(ctx_all, ctx)] = total
            at = np.searchsorted(ctx_all, k >> np.uint64(16))
            lower = np.exp(floor[j]) if below is None else below[np.searchsorted(keys[n - 2], low(k, n - 1)), j]
            p[:, j] = c / t[at] + gamma[at] * lower
            b[:, j] = np.log(gamma)
        below = p
        logp.append(np.log(p).astype(np.float32))
        if n > 1:
            contexts.append(ctx_all)
            back.append(b.astype(np.float32))
    # A character that no language has: far below the uniform share.
    return Model(langs, keys, logp, contexts, back, floor + np.log(1e-4))


def gram_counts(train: DataFrame) -> DataFrame:
    """train(text, lang): lang, key, n of all 4-grams."""

    @tidy
    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def merged(parts: list) -> list:
            return [_counted(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))]

        for b in batches:
            by: dict[str, list[np.ndarray]] = {}
            sizes: dict[str, int] = {}

            def flush(lang: str) -> None:
                held.setdefault(lang, []).append(_counted(np.concatenate(by.pop(lang))))  # noqa: B023
                if len(held[lang]) > 8:
                    held[lang] = merged(held[lang])

            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sym = symbols(text)
                if len(sym):
                    by.setdefault(lang, []).append(grams(sym))
                    sizes[lang] = sizes.get(lang, 0) + len(sym)
                    if sizes[lang] > CHUNK:
                        flush(lang)
                        sizes[lang] = 0
            for lang in list(by):
                flush(lang)
        for lang, parts in held.items():
            key, n = merged(parts)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key.view(np.int64)), pa.array(n)], ["lang", "key", "n"])

    return train.select(F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(per_task, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def blocks_of(sizes: dict[str, int], most: int = BLOCK_BYTES) -> list[list[str]]:
    """Languages by name in blocks whose arrays stay below so many bytes: lower orders have fewer keys than the 4-grams."""
    out: list[list[str]] = []
    for lang in sorted(sizes):
        block = [*out[-1], lang] if out else []
        if block and 2 * sum(sizes[x] for x in block) * (8 + 4 * len(block)) <= most:
            out[-1] = block
        else:
            out.append([lang])
    return out


@dataclass
class Fitted:
    blocks: list[Model]
    limits: list[float]
    sharpness: float
    lapse: float

    @property
    def langs(self) -> list[str]:
        return [lang for m in self.blocks for lang in m.langs]


def models(train: DataFrame, most: int = BLOCK_BYTES) -> list[Model]:
    """The models of train(text, lang), fitted from all its rows, a block of languages at a time."""
    counts = cut(gram_counts(train))
    sizes = {r["lang"]: r["count"] for r in counts.groupBy("lang").count().collect()}
    blocks = blocks_of(sizes, most)
    if len(blocks) == 1:
        return [fit(counts.toPandas())]
    chars = np.array([r[0] for r in counts.select(F.col("key").bitwiseAND(0xFFFF)).distinct().collect()], np.uint64)  # 2 ** 16 at most
    return [fit(counts.filter(F.col("lang").isin(block)).toPandas(), chars) for block in blocks]


def measured(docs: DataFrame, blocks: list[Model], name: str) -> DataFrame:
    """docs with a struct (e: cross-entropy a character in each language, n: number of characters)."""
    text = F.col("text").cast("string")

    def of(model: Model):
        known = docs.sparkSession.sparkContext.broadcast(vars(model))

        @F.pandas_udf("e array<double>, n int")
        def entropies(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            m = Model(**known.value)
            for texts in parts:
                got = [m.entropy(t) for t in texts]
                yield pd.DataFrame({"e": [e for e, _ in got], "n": [n for _, n in got]})
            give_back()

        return entropies(text)

    if not blocks:
        return docs.withColumn(name, F.struct(F.array().cast("array<double>").alias("e"), F.lit(0).alias("n")))
    out = docs.withColumn(name, of(blocks[0]))
    for m in blocks[1:]:  # one block in memory at a time
        both = own_name(docs, name + "2")
        out = cut(out).withColumn(both, of(m))
        out = out.withColumn(name, F.struct(F.concat(f"{name}.e", f"{both}.e").alias("e"), F.col(f"{name}.n").alias("n"))).drop(both)
    return out


def share(e: Column, n: Column, place: Column, sharpness: float, lapse: float, languages: int) -> Column:
    """Softmax share of one language, mixed with an even share."""
    total = F.aggregate(F.transform(e, lambda x: F.exp(F.greatest((F.get(e, place) - x) * F.sqrt(n) * sharpness, F.lit(-700.0)))), F.lit(0.0), lambda a, x: a + x)
    return (1 - lapse) / F.least(total, F.lit(1e300)) + lapse / languages


def calibrated(rows: DataFrame, blocks: list[Model]) -> Fitted:
    """rows(lang, m): training rows that the models have not seen, measured."""
    langs = [lang for b in blocks for lang in b.langs]
    if not langs:
        return Fitted([], [], 1.0, 1.0)
    names = F.array(*map(F.lit, langs))
    e, n = F.col("m.e"), F.col("m.n")
    rows = rows.filter("m.n > 0").select("m", (F.array_position(e, F.array_min(e)) - 1).cast("int").alias("best"), (F.array_position(names, F.col("lang").cast("string")) - 1).cast("int").alias("own"))
    seen = rows.agg(F.count("*").alias("rows"), F.count_if(F.col("own") != F.col("best")).alias("wrong")).first()
    lapse = (seen["wrong"] + 1) / (seen["rows"] + 2)
    losses = rows.agg(*[F.avg(-F.log(share(e, n, F.col("own"), s, lapse, len(langs)))).alias(str(i)) for i, s in enumerate(SHARPNESS)]).first()
    sharpness = SHARPNESS[min(range(len(SHARPNESS)), key=lambda i: (losses[i] if losses[i] is not None else 0.0, i))]
    limits = [np.inf] * len(langs)
    for r in rows.filter(n >= MIN_CHARS).groupBy("best").agg(F.percentile_approx(F.array_min(e), 0.999, RANKS).alias("q")).collect():
        limits[r["best"]] = r["q"] * MARGIN
    known = [x for x in limits if np.isfinite(x)]
    return Fitted(blocks, [x if np.isfinite(x) else max(known, default=x) for x in limits], sharpness, lapse)


def verdict(m: Column, model: Fitted) -> Column:
    """Struct of lang_pred, score and rejected."""
    if not model.langs:
        return F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("rejected"))
    e, n = m["e"], m["n"]
    best = (F.array_position(e, F.array_min(e)) - 1).cast("int")
    named = F.when(n > 0, F.get(F.array(*map(F.lit, model.langs)), best)).otherwise("und")
    score = F.when(n > 0, share(e, n, best, model.sharpness, model.lapse, len(model.langs))).otherwise(0.0)
    far = (n >= MIN_CHARS) & (F.array_min(e) > F.get(F.array(*[F.lit(x) for x in model.limits]), best))
    return F.struct(named.alias("lang_pred"), score.alias("score"), ((n == 0) | far).alias("rejected"))


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows with a language whose crc32(doc_id) mod 3 is not 1."""
    return docs.filter((fold(F.col("doc_id"), 3) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())


def told(train: DataFrame) -> Column:
    """Whether a training row is kept from the models: those of one part by the text's hash, unless the language has no text with a letter beyond it."""
    part = F.pmod(F.xxhash64(F.col("text").cast("string")), F.lit(APART)) == 0
    others = train.filter(~part & F.col("text").cast("string").rlike(r"\p{L}")).select(F.col("lang").cast("string")).distinct().collect()  # a row a language
    return part & F.col("lang").cast("string").isin([r[0] for r in others])


def trained(docs: DataFrame) -> Fitted:
    """Fit on all training rows but those kept apart; then set sharpness and rejection limits on these."""
    train = training_rows(docs).select("text", "lang")
    tells = told(train)
    blocks = models(train.filter(~tells))
    return calibrated(cut(measured(train.filter(tells), blocks, "m").select("lang", "m")), blocks)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected. All rows are measured once; calibration reads the rows kept apart among them."""
    train = training_rows(docs).select("text", "lang")
    tells = told(train)
    blocks = models(train.filter(~tells))
    held_out, trains = fold(F.col("doc_id"), 3) == 1, F.col("lang").isNotNull() & F.col("text").isNotNull()
    tells = F.coalesce(trains & ~held_out & tells, F.lit(False))
    rows = cut(measured(docs.select("doc_id", "lang", "text"), blocks, "m").select("doc_id", "lang", held_out.alias("held_out"), tells.alias("tells"), "m"))
    model = calibrated(rows.filter("tells"), blocks)
    return rows.select("doc_id", "held_out", verdict(F.col("m"), model).alias("p")).select("doc_id", "held_out", "p.*")


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents that are not rejected."""
    name, model = own_name(docs, "measured"), trained(docs)
    kept = measured(docs, model.blocks, name)
    return kept.filter(~verdict(F.col(name), model)["rejected"]).drop(name)
