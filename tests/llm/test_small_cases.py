"""Small cases of each operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names; results by brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from daygrid.llm import bpe, chat, components, html_extract, langid, merkle, mixing, near_copies, quality_clf, quality_rules, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, row string, size string, cell string, html string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, len(t or ""), "x", "y", "z", "c", "h") for i, t, lang, src in rows], SCHEMA)


def lorem(seed, n, words=400):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{int(k)}" for k in rng.integers(0, words, n))


ODD = [(1, None, "en", "a"), (2, "", "en", None), (3, " \n\t ", None, "a"), (4, "one", "en", "b"), (5, "one two", "de", "b"), (6, "one two", "de", "b"), (6, "one two", "de", "b"), (7, lorem(1, 60_000), "en", "a"), (8, "é" * 50 + " Ünïcode 日本語", "fr", "c")]


def test_mixing_meets_targets(spark):
    rows = [(i, lorem(i, 20 + i % 90), "en", "abcd"[min(i % 7, 3)] if i % 11 else None) for i in range(400)]
    df = docs_of(spark, rows)
    got = mixing.mix(df, block=32).collect()
    size = {i: len(t.split()) for i, t, _, _ in rows}
    per, taken, target = Counter(), Counter(), {}
    source = {i: s for i, _, _, s in rows}
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["taken"] <= 3 * r["size"]
        per[source[r["doc_id"]]] += r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    total, order = sum(per.values()), sorted(per, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    want, free = {}, set(order)
    while True:  # share, stop at three times the size, share the rest anew
        left = total - sum(want.values())
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 3 * per[s]]
        if not over:
            break
        for s in over:
            want[s] = 3 * per[s]
            free.discard(s)
    want |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    for s in order:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 1
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(df.repartition(7), block=32).collect()))


def test_mixing_draws_full_shards_given_the_targets(spark):
    """Every shard but the last is full, none is of one source, their counts scatter as a multivariate hypergeometric draw, and a seed is a draw."""
    rows = [(i, lorem(i, 40 + i % 90), "en", "abcd"[min(i % 9, 3)]) for i in range(900)]
    df, seen = docs_of(spark, rows), []
    for seed in (0, 1, 2):
        sources = mixing.sources_of(mixing.sized_rows(df))
        slots = mixing.slots_of(sources, block=8, shard=32, seed=seed).toPandas()
        assert (slots["words"] > 0).all() and not slots.duplicated(["rank", "place"]).any()
        size = slots.groupby("shard").size()
        assert size.index.tolist() == list(range(len(size))) and (size[:-1] == 32).all() and 1 <= size.iloc[-1] <= 32 and len(size) > 150
        counts = slots[slots["shard"] < len(size) - 1].pivot_table(index="shard", columns="rank", values="place", aggfunc="count", fill_value=0)
        assert (counts.max(axis=1) < 32).all()
        total = slots.groupby("rank").size()
        share, n = total / total.sum(), total.sum()
        spread = 32 * share * (1 - share) * (n - 32) / (n - 1)
        chi = ((counts - 32 * share) ** 2 / spread).mean()  # 1 in the mean for each source
        assert (abs(chi - 1) < 5 * (2 / len(counts)) ** 0.5).all()
        words = slots.groupby("rank")["words"].sum()
        target = sources.toPandas().set_index("rank")["target"]
        assert (abs(words - target) <= 1).all()
        seen.append(counts)
    assert not seen[0].equals(seen[1]) and not seen[1].equals(seen[2])


def test_mixing_permutes(spark):
    for n in (1, 2, 7, 100):
        there = mixing.permuted(F.col("id"), F.lit(n), F.lit(5))
        got = spark.range(n).select("id", there.alias("x")).select("id", "x", mixing.permuted(F.col("x"), F.lit(n), F.lit(5), back=True).alias("y")).collect()
        assert sorted(r["x"] for r in got) == list(range(n)) and all(r["id"] == r["y"] for r in got)


def test_mixing_equals_a_walk_of_the_written_shards(spark):
    rows = [(i, " ".join(f"d{i}_{k}" for k in range(1 + i * 7 % 90)), "en", "abc"[min(i % 9, 2)]) for i in range(300)]
    df = docs_of(spark, rows)
    seen = {}
    for seed, shard in ((0, 16), (1, 16), (0, 5)):
        out = mixing.shards(df, block=16, shard=shard, seed=seed).collect()
        walked, reads = Counter(), Counter()
        for r in out:
            for w in r["words"].split():
                walked[int(w[1:].split("_")[0])] += 1
                reads[w] += 1
        got = {r["doc_id"]: r["taken"] for r in mixing.mix(df, block=16, shard=shard, seed=seed).collect()}
        assert got == {i: walked[i] for i in got} and max(reads.values()) <= 3
        counts = defaultdict(Counter)
        for r in out:
            counts[r["shard"]][r["source"]] += 1
        assert all(sum(c.values()) <= shard for c in counts.values()) and len({tuple(sorted(c.items())) for c in counts.values()}) > 3
        seen[seed, shard] = got
    # A seed is another draw of shards and blocks; totals are fixed by the targets, so the shard's size changes the shards alone.
    assert seen[0, 16] != seen[1, 16] and seen[0, 16] == seen[0, 5]


def test_mixing_keeps_null_ids_repeats_and_clashing_names(spark):
    rows = [(None, f"n{i} a b c", "en", "a") for i in range(40)] + [(7, "x y", "en", "a"), (7, "x y", "en", "a"), (7, "x z", "en", "b")]
    df = docs_of(spark, rows).withColumn("copies", F.lit(1)).withColumn("hash", F.lit(2)).withColumn("no_id", F.lit(3)).withColumn("copy", F.lit(4)).withColumn("__id", F.lit(5))
    got = mixing.resample(df)
    taken = {t: sum(r["taken"] for r in mixing.mix(df).collect() if (r["doc_id"] is None) == (t == "null")) for t in ("null", "id")}
    size = {"null": 4, "id": 2}
    for t, cond in (("null", "doc_id is null"), ("id", "doc_id = 7")):
        n = got.filter(cond).count()
        assert abs(n * size[t] - taken[t]) <= size[t] * (40 if t == "null" else 3) and n > 0
    assert got.columns == df.columns


def test_mixing_odd_rows(spark):
    got = mixing.mix(docs_of(spark, ODD)).collect()
    assert len(got) == len(ODD) and all(r["taken"] <= 3 * r["size"] for r in got)
    assert {r["doc_id"]: r["size"] for r in got}[1] == 0
    assert mixing.mix(docs_of(spark, [])).collect() == []
    assert mixing.resample(docs_of(spark, ODD)).columns == docs_of(spark, []).columns


def brute_components(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(i, i + 1) for i in range(40)] + [tuple(map(int, p)) for p in rng.integers(100, 300, (120, 2))]
    links = [p for p in links if p[0] != p[1]]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == brute_components(links, {x for p in links for x in p})


def test_simhash_links_by_brute_force(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    near = [b ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 64, (6, 2))]
    chain = [base[0]]
    for k in range(12):
        chain.append(chain[-1] ^ (3 << 2 * k))
    fps = sorted({int(np.uint64(x).view(np.int64)) for x in (*base, *near, *chain, 0, 3, (1 << 64) - 1)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    pairs = {(a, b) for i, a in enumerate(fps) for b in fps[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    for cell in (simhash.CELL, 2, 0):  # compared in the cell, or some or all cells split
        linked = simhash.links(df, cell)
        assert {tuple(r) for r in linked.collect()} == pairs
    got = {r["node"]: r["root"] for r in components.components(linked).collect()}
    assert {f: got.get(f, f) for f in fps} == brute_components(pairs, fps)


def test_simhash_fingerprint(spark):
    def plain(text, k=3):
        ws = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
        if not ws:
            return 0
        h = [xxhash.xxh64_intdigest(" ".join(ws[i : i + k]).encode(), 42) for i in range(max(1, len(ws) - k + 1))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    for t in (None, "", "A b", "One TWO three Four", "É È a b c", lorem(4, 500)):
        assert simhash.fingerprint(t) == plain(t)
    got = simhash.near_duplicates(docs_of(spark, ODD)).collect()
    by = {r["doc_id"]: r["component_id"] for r in got}
    assert len(got) == len(ODD) and by[1] == by[2] == by[3] == 1 and by[5] == by[6] == 5
    kept = sorted(r["doc_id"] for r in simhash.keep_first(docs_of(spark, ODD)).collect())
    assert kept == [1, 4, 5, 7, 8]
    nulls = docs_of(spark, [(None, "a b", "en", "s"), (None, "a b", "en", "s"), (3, "a b", "en", "s")]).withColumn("gone", F.lit(1)).withColumn("__gone", F.lit(1))
    assert simhash.keep_first(nulls).count() == 3 and simhash.keep_first(nulls).columns == nulls.columns
    assert simhash.near_duplicates(docs_of(spark, [])).collect() == []


def test_bpe_equals_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    lib = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng, letters = np.random.default_rng(5), list("aab'sS \n\t09é̀Σσ.,!#日한ﬁ①")
    texts = [None, "", "x<|endoftext|>y <|startoftext|>", "it's we'LL", *("".join(rng.choice(letters, rng.integers(1, 40))) for _ in range(500)), lorem(6, 5000)]
    got = bpe.encoded(docs_of(spark, [(i, t, None, None) for i, t in enumerate(texts)]), full=True).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids"]) == (len(ids), " ".join(map(str, ids)))
        assert r["decoded"] == lib.decode(ids, skip_special_tokens=False)
    every, enc = [f"a{chr(c)}b" for c in range(0x34000) if not 0xD800 <= c < 0xE000], bpe.Encoder(bpe.vocabulary())
    for i in range(0, len(every), 4000):
        want = [" ".join(map(str, e.ids)) for e in lib.encode_batch(every[i : i + 4000], add_special_tokens=False)]
        assert [g[1] for g in enc.encode(every[i : i + 4000])] == want
    small = bpe.Encoder(bpe.vocabulary())
    for c in range(40):  # memories that overflow all the time, chunks too long to keep
        small.known_bytes = small.met_bytes = 1 << 40
        t = [lorem(c, 50), "x" * 300 + "é" * 300, "plain<|endoftext|>text", ""]
        assert [g[1] for g in small.encode(t)] == [" ".join(map(str, e.ids)) for e in lib.encode_batch(t, add_special_tokens=False)]
    d = bpe.digests(docs_of(spark, [(1, "a b", None, None)])).first()
    assert d["decoded_sha256"] == hashlib.sha256(lib.decode(lib.encode("a b", add_special_tokens=False).ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digests(docs_of(spark, [])).collect() == []


def test_merkle(spark):
    rows = [(1, "A b. C d.\n\nE f.", "", ""), (2, "A b. C d.\n\nE f.", "", ""), (3, None, "", ""), (4, "", "", ""), (5, "A b.\nC d.", "", ""), (6, "x" * 1000, "", "")]
    got = {r["doc_id"]: r for r in merkle.fingerprinted(docs_of(spark, rows)).collect()}
    assert got[1]["fingerprint"] == got[2]["fingerprint"] and got[1]["near_next"] == 1.0
    assert got[3]["fingerprint"] == got[4]["fingerprint"] and got[3]["n_chars"] == 0
    text = {i: t or "" for i, t, _, _ in rows}
    for i, j in zip([1, 2, 3, 4, 5, 6], [2, 3, 4, 5, 6, 1], strict=True):
        k = len(text[i]) // 4
        assert got[i]["edited_sha256"] == hashlib.sha256((text[i][: len(text[i]) - k] + text[j][:k]).encode()).hexdigest()
    a, b = "A b.\nC d.\n\nE f.", "A b.\nC x.\n\nE f."
    where = spark.createDataFrame([(a, b)], "a string, b string").select(merkle.tree(F.col("a")).alias("a"), merkle.tree(F.col("b")).alias("b")).select(merkle.differing(F.col("a"), F.col("b")).alias("d")).first()["d"]
    assert [tuple(x) for x in where] == [(0, 1)]
    far = [(-(1 << 63), "low a. b"), ((1 << 63) - 1, "high c. d"), (None, "null"), *((i, f"t{i}. x") for i in range(3000)), (10**15, "out"), (5, "again"), (5, "again")]
    got = merkle.with_next(docs_of(spark, [(i, t, "", "") for i, t in far]), 64).select("doc_id", "text", "next_text").collect()
    line = [t for _, t in sorted(far, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))]
    order = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"], r["next_text"]) for r in got), key=lambda r: r[:3])
    assert len(got) == len(far) and sorted(zip(line, line[1:] + line[:1], strict=True)) == sorted(r[2:] for r in order)
    at = merkle.borders(docs_of(spark, [(i, "", "", "") for i, _ in far]), 64)
    sizes = Counter(sum(b <= (i if i is not None else -(1 << 63) - 1) for b in at) for i, _ in far)
    assert len(at) > 40 and max(sizes.values()) < 200
    many = [(i * 37 % 5000, lorem(i, 30), "", "") for i in range(5000)]
    near = merkle.with_next(docs_of(spark, many)).select("doc_id", "text", "next_text").collect()
    by = {r["doc_id"]: r["text"] for r in near}
    assert len(near) == 5000 and all(r["next_text"] == by[(r["doc_id"] + 1) % 5000] for r in near)
    assert merkle.fingerprinted(docs_of(spark, [])).collect() == []
    assert len(merkle.fingerprinted(docs_of(spark, ODD)).collect()) == len(ODD)


def test_chat_paths_and_round_trip(spark):
    m = [(1, 1, None, 0.1), (1, 2, 1, 0.5), (1, 3, 1, 0.9), (1, 4, 2, 3.0), (1, 5, 4, 0.0), (1, 6, 99, 1.0), (2, 1, 2, 1.0), (2, 2, 1, 1.0)]
    got = defaultdict(dict)
    for r in chat.paths(spark.createDataFrame(m, "tree long, node long, parent long, score double")).collect():
        got[r["tree"], r["leaf"], r["rank"]][r["up"]] = r["node"]
    assert {k: [v[i] for i in sorted(v)] for k, v in got.items()} == {(1, 5, 1): [5, 4, 2, 1], (1, 3, 2): [3, 1], (1, 6, 3): [6]}
    rows = [(1, 0, "user", "a<|im_end|>\n<\\|b"), (1, 1, "assistant", "x<|im_start|>assistant\ny<\\\\|"), (1, 2, None, None), (2, None, "we\nird<|", "t"), (2, None, "we\nird<|", "t"), (3, 0, "assistant", None)]
    out = {r["conv_id"]: r for r in chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).withColumn("turns", chat.read_back(F.col("formatted"))).collect()}
    assert [tuple(t) for t in out[1]["turns"]] == [(r or "", t or "") for _, _, r, t in rows[:3]]
    assert [tuple(t) for t in out[2]["turns"]] == [("we\nird<|", "t")] * 2
    spans = [out[1]["formatted"][s["start"] : s["start"] + s["length"]] for s in out[1]["loss_mask"]]
    assert len(spans) == 1 and spans[0].replace("<\\|", "<|").replace("<\\\\\\|", "<\\\\|") == rows[1][3]
    whole = chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).persist()
    real = chat.read_digests(whole).filter("conv_id = 1").first()
    assert (real["loss_chars"], real["loss_sha256"]) == (len(rows[1][3]), hashlib.sha256(rows[1][3].encode()).hexdigest())
    empty = chat.read_digests(whole.withColumn("loss_mask", F.filter("loss_mask", lambda x: F.lit(False)))).filter("conv_id = 1").first()
    moved = chat.read_digests(whole.withColumn("loss_mask", F.transform("loss_mask", lambda x: F.struct((x["start"] - 1).alias("start"), x["length"].alias("length"))))).filter("conv_id = 1").first()
    assert empty["loss_chars"] == 0 and moved["loss_sha256"] != real["loss_sha256"]
    text = "".join(chr(97 + i % 26) if i % 50 else "\U0001F600" for i in range(20_000))
    spans = [(0, 3), (4095, 2), (4096, 4096), (8190, 9000), (19_999, 1), (100, 0)]
    cut = spark.createDataFrame([(text, spans)], "t string, m array<struct<start:bigint,length:bigint>>").select(chat.under_mask(F.col("t"), F.col("m"))).first()[0]
    assert cut == [text[a : a + n] for a, n in spans]
    long = [(9, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(300)]
    r = chat.digests(spark.createDataFrame(long, "conv_id long, turn long, role string, text string")).first()
    assert r["n_turns"] == 300 and r["loss_sha256"] == hashlib.sha256("".join(t for _, _, role, t in long if role == "assistant").encode()).hexdigest()
    assert chat.digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_language_id(spark):
    def text(seed, alphabet):
        rng = np.random.default_rng(seed)
        return " ".join("".join(rng.choice(list(alphabet), rng.integers(2, 7))) for _ in range(80))

    rows = [(i, text(i, "abcdefg" if i % 2 else "mnopqrs"), "aa" if i % 2 else "mm", "s") for i in range(200)] + [(1000, None, "aa", "s"), (1001, "", None, "s"), (1002, "123 !!", "aa", "s"), (1003, text(5, "ЖЗИЙК"), None, "s")]
    got = {r["doc_id"]: r for r in langid.identify(docs_of(spark, rows)).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang, _ in rows[:200])
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (1000, 1001, 1002))
    assert got[1003]["rejected"] and not any(got[i]["rejected"] for i in range(200))
    assert langid.identify(docs_of(spark, [])).collect() == []
    assert {r["lang_pred"] for r in langid.identify(docs_of(spark, [(1, "abc", None, "s")])).collect()} == {"und"}


def test_kneser_ney_sums_to_one(spark):
    rng = np.random.default_rng(8)
    import pandas as pd

    texts = ["".join(rng.choice(list("abc "), 60)) for _ in range(20)]
    keys, n = langid._counted(np.concatenate([langid.grams(langid.symbols(t)) for t in texts]))
    model = langid.fit(pd.DataFrame({"lang": "x", "key": keys.view(np.int64), "n": n}))
    chars = model.keys[0]
    for ctx in np.unique(keys >> np.uint64(16))[:20]:
        p = np.exp(model.scores((ctx << np.uint64(16)) | chars)[:, 0]).sum()
        assert p == pytest.approx(1.0, abs=1e-4)


def test_null_ids(spark):
    df = docs_of(spark, [(None, "a b c", "en", "a"), (None, None, None, None), (1, "d e f", "en", "a")])
    labels = labels_of(spark, [(None, 1, 1), (1, None, None)])
    n = len(df.collect())
    for got in (mixing.mix(df), simhash.near_duplicates(df), merkle.fingerprinted(df), bpe.digests(df), langid.identify(df), quality_rules.judged(df), toxicity.score(df, labels), quality_clf.score(df, labels)):
        assert got.count() == n and "doc_id" in got.columns
    assert langid.identify(df).filter("held_out is null").count() == 0


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    rng = np.random.default_rng(9)
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        ws = lorem(i, 60).replace("w", "").split()
        ws = ["word" + "abcdefghij"[int(w) % 10] * (1 + int(w) % 3) for w in ws]
        if bad:
            ws[int(rng.integers(60))] = ws[int(rng.integers(60))] = ["zorkface", "blarghead"][i // 4 % 2]
        rows.append((i, " ".join(ws) + ".", "en", "s"))
        labels.append((i, 1, int(bad)))
    rows += [(9000, None, None, None), (9001, "", None, None), (9002, "zorkface " * 20_000, None, None)]
    got = {r["doc_id"]: r for r in toxicity.score(docs_of(spark, rows), labels_of(spark, labels)).collect()}
    held = [(i, t) for i, _, t in labels if got[i]["held_out"]]
    assert len(held) > 60 and sum(got[i]["predicted"] == t for i, t in held) / len(held) > 0.97
    assert got[9000]["score"] == got[9001]["score"] < 0.5 < got[9002]["score"]
    assert toxicity.score(docs_of(spark, []), labels_of(spark, labels)).collect() == []
    assert {r["score"] for r in toxicity.score(docs_of(spark, rows[:3]), labels_of(spark, [])).collect()} == {0.0}
    kept = toxicity.keep_clean(docs_of(spark, rows), labels_of(spark, labels))
    assert kept.columns == docs_of(spark, []).columns and kept.filter("doc_id = 9002").count() == 0


def test_toxicity_grammar():
    arcs, states = toxicity.composed()
    assert len(states) < 200 and all((i, s) in arcs for i in range(len(states)) for s in "oITYNR.")
    g = toxicity.Grammar({"terms": {"zork": (50, 0)}, "n": (100, 100)})
    weight = lambda t: sum(g.clauses(t)[0])
    assert weight("you zork.") > weight("a zork.") > weight("not a zork.") > 0
    assert weight("he said a zork.") < weight("a zork.") and weight("a fine day.") == 0
    assert weight("kill.") == 0 < weight("i will kill you zork.")
    assert weight("kill you.") == weight("you kill.") == 2 * 1.3 > weight("i don't kill you.") > 0 and weight("i don’t kill you.") == weight("i don't kill you.")
    assert weight("it isn't zork.") == pytest.approx(0.4 * weight("it was zork."))


def test_toxicity_clauses_by_brute_force():
    rng, kinds = np.random.default_rng(22), {"zork": "I", "kill": "T", "you": "Y", "not": "N", "said": "R", ".": ".", "tree": "o", "can't": "N"}
    g = toxicity.Grammar({"terms": {"zork": (50, 0)}, "n": (100, 100)})
    insult = g.symbol("zork")[2]
    for _ in range(500):
        text = [str(w) for w in rng.choice(list(kinds), int(rng.integers(1, 25)))]
        want, acc, seen, quiet, last = [], 0.0, set(), 0, 0.0
        for w in [*text, "."]:
            k = kinds[w]
            scale = (0.4 if quiet else 1.0) * (0.6 if "R" in seen else 1.0)
            if k == "I":
                acc, last = acc + insult * scale * (1.3 if "Y" in seen else 1.0), insult
            elif k == "T":
                acc, last = acc + (scale * 2.0 * (1.3 if "Y" in seen else 1.0) if seen & {"I", "Y"} else 0.0), 1.0
            elif k == "Y" and "Y" not in seen:
                acc += 0.3 * last if "I" in seen else scale * 2.6 if "T" in seen else 0.0
            quiet = 3 if k == "N" else max(0, quiet - 1)
            seen.add(k)
            if k == ".":
                want += [acc] if acc else []
                acc, seen, quiet = 0.0, set(), 0
        assert g.clauses(" ".join(text))[0] == pytest.approx(want)


def test_quality_rules_by_brute_force(spark):
    rows = [*ODD, (20, "a b c a b c d\nx\n\nx\n y", "en", "s"), (21, "a a a a a", "en", "s"), *((100 + i, lorem(i, 80, 12), "en", "s") for i in range(30))]
    got = {r["doc_id"]: r for r in quality_rules.judged(docs_of(spark, rows)).collect()}
    for i, t, _, _ in rows:
        ws = [w for w in (t or "").replace("\x0b", " ").split()]
        seen = defaultdict(list)
        for k in range(len(ws) - 2):
            seen[tuple(ws[k : k + 3])].append(k)
        covered = {k + d for ks in seen.values() if len(ks) > 1 for k in ks for d in range(3)}
        lines = [x for x in (t or "").split("\n") if x.split()]
        assert (got[i]["n_words"], got[i]["n_repeat_words"], got[i]["n_dup_lines"]) == (len(ws), len(covered), len(lines) - len(set(lines)))
        assert got[i]["base_failed"] == (len(ws) < 50 or 100 * len(covered) > 50 * len(ws))
    assert quality_rules.judged(docs_of(spark, [])).collect() == []


def js(p, q):
    p, q = np.asarray(p, float), np.asarray(q, float)
    m = (p + q) / 2
    kl = lambda x: sum(u * np.log2(u / v) for u, v in zip(x, m, strict=True) if u > 0)
    return np.sqrt(max(kl(p) + kl(q), 0) / 2)


def test_quality_verdict_by_brute_force(spark):
    rng = np.random.default_rng(21)
    common = {"aa": "the of and in to".split(), "bb": "der die und das zu".split()}
    rows = []
    for i in range(700):
        lang = "aa" if i % 2 else "bb"
        ws = [str(rng.choice(common[lang])) if rng.random() < 0.3 else f"{lang}{int(rng.integers(3000))}" for _ in range(int(rng.integers(40, 500)))]
        if i % 50 == 7:
            ws = [w for w in ws if w not in common[lang]] * 3 if i % 100 == 7 else [w + "#$%" for w in ws]
        rows.append((i, " ".join(ws), lang, "s"))
    df = docs_of(spark, rows)
    got = {r["doc_id"]: r for r in quality_rules.judged(df).collect()}
    bags, classes, n = {}, {}, {}
    for i, t, _, _ in rows:
        ws = t.lower().split()
        bags[i], n[i] = Counter(ws), len(ws)
        up, dig = sum("A" <= c <= "Z" for c in t), sum(c.isdigit() for c in t)
        mark, sym = sum(c in ".,;:!?'\"()-" for c in t), sum(c in "#*$%&|<>" for c in t)
        gap = len(t) - sum(map(len, t.split()))
        classes[i] = [up, dig, mark, sym, 0, gap, len(t) - up - dig - mark - sym - gap]
    refs = {}
    for lang in common:
        ids = [i for i, _, of, _ in rows if of == lang]
        df_ = Counter(w for i in ids for w in bags[i])
        top = [w for w, _ in sorted(df_.items(), key=lambda x: (-x[1], x[0]))[: quality_rules.COMMON]]
        words = sum(n[i] for i in ids)
        shares = [sum(bags[i][w] for i in ids) / words for w in top]
        chars = np.sum([classes[i] for i in ids], axis=0)
        refs[lang] = (top, [*shares, 1 - sum(shares)], chars / chars.sum())
    near = {}
    for i in n:
        w = min((js([*(x := [bags[i][v] / n[i] for v in top]), 1 - sum(x)], q), lang) for lang, (top, q, _) in refs.items())
        c = min((js(np.array(classes[i]) / sum(classes[i]), q), lang) for lang, (_, _, q) in refs.items())
        near[i] = (c, w)
        assert got[i]["word_distance"] == pytest.approx(w[0], abs=1e-6) and got[i]["class_distance"] == pytest.approx(c[0], abs=1e-6)
    good = [i for i in n if not got[i]["base_failed"]]

    def limit(k, i, spreads):
        same = lambda j: int(np.log2(n[j])) == int(np.log2(n[i]))
        for mine in ([near[j][k][0] for j in good if same(j) and near[j][k][1] == near[i][k][1]], [near[j][k][0] for j in good if same(j)]):
            if len(mine) >= quality_rules.MIN_CLASS:
                mine.sort()
                low, mid = (mine[int(np.ceil(p * len(mine))) - 1] for p in (0.1587, 0.5))
                return mid + spreads * (mid - low)
        return 1.0

    for i in good:
        want = near[i][0][0] <= limit(0, i, quality_rules.CLASS_SPREADS) and (n[i] < 100 or near[i][1][0] <= limit(1, i, quality_rules.WORD_SPREADS))
        assert got[i]["kept"] == want, i
    assert 0 < sum(not got[i]["kept"] for i in good) < 60


def test_quality_distance(spark):
    p, q = [3, 1, 0], [0.5, 0.25, 0.25]
    got = spark.createDataFrame([(p, q)], "c array<int>, q array<double>").select(quality_rules.distance(F.col("c"), F.col("q"))).first()[0]
    assert got == pytest.approx(js(np.array(p) / 4, q))


def test_quality_classifier(spark):
    rows = [(i, (lorem(i, 80) if i % 3 else " | ".join(lorem(i, 30).split()) + " %%%"), "en", "s") for i in range(400)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(400)]
    rows += [(900, None, None, None), (901, "", None, None)]
    got = {r["doc_id"]: r for r in quality_clf.score(docs_of(spark, rows), labels_of(spark, labels)).collect()}
    held = [(i, q) for i, q, _ in labels if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == q for i, q in held) / len(held) > 0.95
    assert got[900]["score"] == got[901]["score"] and 0 <= got[900]["score"] <= 1
    assert quality_clf.score(docs_of(spark, []), labels_of(spark, labels)).collect() == []
    assert {r["score"] for r in quality_clf.score(docs_of(spark, rows[:3]), labels_of(spark, [])).collect()} == {0.5}


def test_quality_vectors_and_network_by_brute_force(spark):
    texts = [lorem(i, 40, 30) + " !! " + lorem(i + 50, 5) for i in range(30)] + [None, "", "one"]

    def index(token):
        h, v = xxhash.xxh64_intdigest(token.encode()), np.zeros(quality_clf.DIM)
        for k in range(quality_clf.NONZERO):
            v[(h >> (14 + 6 * k)) % quality_clf.DIM] += 1 - 2 * (h >> (40 + k) & 1)
        return h % quality_clf.HASHED, v

    seen, sums, bags = Counter(), defaultdict(lambda: np.zeros(quality_clf.DIM)), []
    for t in texts:
        ts = quality_clf._tokens((t or "").lower())
        bags.append(ts)
        for i, w in enumerate(ts):
            seen[index(w)[0]] += 1
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(ts):
                    sums[index(w)[0]] += index(ts[j])[1]
    df = docs_of(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]).repartition(3)
    got = quality_clf.context_sums(df).toPandas()
    assert {int(r["bucket"]): r["n"] for _, r in got.iterrows()} == dict(seen)
    assert all(np.array_equal(r[[f"v{i}" for i in range(quality_clf.DIM)]].to_numpy(float), sums[int(r["bucket"])]) for _, r in got.iterrows())
    table, total = quality_clf.vectors(got), sum(seen.values())
    for t, ts in zip(texts, bags, strict=True):
        want = np.zeros(2 * quality_clf.DIM)
        for w in ts:
            b, v = index(w)
            damp = 1e-3 / (1e-3 + seen[b] / total)
            want += np.concatenate([sums[b] / max(np.linalg.norm(sums[b]), 1e-9), v / 2]) * damp / len(ts)
        assert quality_clf.pooled(t, quality_clf.Hashes(), table)[: 2 * quality_clf.DIM] == pytest.approx(want, abs=1e-5)
    rng = np.random.default_rng(19)
    x = rng.normal(size=(1500, 6))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    net = quality_clf.network(x, y)
    out = quality_clf.logits(net, x)
    w1, b1, w2, b2 = net["p"]
    for i in range(20):
        z = [(x[i, k] - net["mean"][k]) / net["spread"][k] for k in range(6)]
        hidden = [np.tanh(sum(z[k] * w1[k, j] for k in range(6)) + b1[j]) for j in range(quality_clf.HIDDEN)]
        assert out[i] == pytest.approx((sum(h * w for h, w in zip(hidden, w2, strict=True)) + b2[0]) / net["t"])
    assert ((out > 0) == (y > 0)).mean() > 0.9 and 0.5 <= net["t"] <= 8


def test_long_texts_repeats_and_extra_columns_of_the_classifiers(spark):
    rows = [(i, lorem(i, 60) if i % 2 else "# | " * 40, "en", "s") for i in range(60)] + [(100, lorem(3, 600_000), "en", "s"), (5, lorem(5, 60), "en", "s")]
    labels = labels_of(spark, [(i, i % 2, (i + 1) % 2) for i in range(60)])
    for score in (quality_clf.score, toxicity.score):
        got = score(docs_of(spark, rows).withColumn("predicted", F.lit(1)).withColumn("toxic", F.lit(1)).withColumn("y", F.lit(1)), labels).collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
        assert len({r["score"] for r in got if r["doc_id"] == 5}) == 1
    kept = toxicity.keep_clean(docs_of(spark, rows).withColumn("toxic", F.lit(1)).withColumn("__toxic", F.lit(1)), labels)
    assert "toxic" in kept.columns and "__toxic" in kept.columns


PAGE = """<!DOCTYPE html><html><head><title>T {i}</title><style>p{{}}</style><script>var a="</p>";</script></head><body><nav><a href=/>Home</a></nav>
<div class="cookie-notice">We use cookies {i}</div><div class="ad">Buy {i}</div>{open}<h1>Head {i}</h1><p><b>Bold {i}<br><p>Fish &amp; chips &eacute; &#233;&copy {i}</p><ul><li>one {i}<li>two</ul>
<form><input value=x>Search</form>{close}<aside>More {i}</aside><section id="comments"><p>Reader {i}</p></section><footer>&copy; host</footer></body></html>"""


def test_html(spark):
    art = [(i, f"http://u:p@A.example:80/{i}", PAGE.format(i=i, open="<article>", close="</article>")) for i in range(8)]
    bare = [(100 + i, f"http://b.example/{i}", PAGE.format(i=i, open="<div><div class=tag>Same words</div>", close="</div>")) for i in range(8)]
    odd = [(200, None, None), (201, "", ""), (202, "x", "plain <b>te</b>xt &amp;amp; <p>more"), (203, "http://c/", "<article><p>cut off &mid"), (204, "http://c/", "<article>" + "<p>long</p>" * 5000), (205, "http://d/", "<div>" * 3000 + "deep"), (206, "http://d/", "<div class=with-sidebar><main>in<div class=sidebar>out</div></main></div>")]
    got = {r["page_id"]: r for r in html_extract.main_text(spark.createDataFrame(art + bare + odd, "page_id long, url string, html string").withColumn("host", F.lit("x"))).collect()}
    for i in range(8):
        want = f"Head {i} Bold {i} Fish & chips é é© {i} one {i} two"
        assert got[i]["text"] == want and got[i]["n_chars"] == len(want)
        assert got[100 + i]["text"] == want  # 'Same words' is boilerplate of its host
    assert (got[200]["text"], got[200]["n_chars"], got[201]["text"]) == ("", 0, "")
    assert got[202]["text"] == "plain text &amp; more" and got[203]["text"].startswith("cut off") and got[204]["n_chars"] == 24_999 and got[205]["text"] == "deep" and got[206]["text"] == "in"
    assert html_extract.main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_tree_matching():
    a = html_extract.outline(html_extract.parse("<div><p>x</p><ul><li>1</ul></div>"), [100])
    b = html_extract.outline(html_extract.parse("<div><h2>n</h2><p>x</p><ul><li>2</ul></div>"), [100])
    m = html_extract.merged(a, b)
    labels = [k[0] for k in m[3][0][3]]
    assert labels == ["h2", "p", "ul"] and m[3][0][3][1][2] is not None and m[3][0][3][2][2] is None and m[1] == 2


def test_html_quotes_depth_and_odd_class_names(spark):
    read = lambda page: html_extract.extract(page, None)
    assert read("<p title=it's>hello <b>x</b> world, don't stop</p><p>after</p>") == "hello x world, don't stop after"
    assert read("""<p title="a>b" alt='c>d'>one</p><p title = "x'>two">three</p><p a=b'>four</p>""") == "one three four"
    assert read('<p>in</p><p title="never closed>out</p>') == "in"
    deep = "<div>" * 600 + "a<nav>menu</nav><div>b</div>c<p>d<p>e" + "</div>" * 600 + "f"
    assert read(deep) == "a b c d e f"
    assert html_extract.extract("<div>" * 5000 + "x", html_extract.outline(html_extract.parse("<div>y</div>"))) == "x"
    parts = []
    for start in (0, 1000):
        template = None
        for i in range(start, start + 1000):
            tree = html_extract.outline(html_extract.parse(f"<div class=odd{i}>Odd {i}</div><div class=body>Text {i}</div><div class=same>Same words</div>"))
            template = tree if template is None else html_extract.merged(template, tree)
        parts.append(html_extract.thinned(template))
    template = html_extract.thinned(html_extract.merged(*parts))
    assert html_extract.count(template) < 600 and template[1] == 2000
    assert html_extract.extract("<div class=odd7>Odd 7</div><div class=body>Text 7</div><div class=same>Same words</div>", template) == "Odd 7 Text 7"


def brute_matching(a, b):
    """Greatest common size of two trees, by trying every way to pair their children in order."""
    if a[0] != b[0]:
        return 0

    def best(i, j):
        if i == len(a[3]) or j == len(b[3]):
            return 0
        return max(best(i + 1, j), best(i, j + 1), brute_matching(a[3][i], b[3][j]) + best(i + 1, j + 1))

    return 1 + best(0, 0)


def test_html_matching_by_brute_force():
    rng = np.random.default_rng(17)

    def tree(depth):
        return ["pqr"[int(rng.integers(3))] if depth < 3 else "root", 1, None, [tree(depth - 1) for _ in range(int(rng.integers(0, 4)))] if depth else [], []]

    for _ in range(60):
        a, b = tree(3), tree(3)
        assert html_extract.size(a, b) == brute_matching(a, b)


def test_html_template_by_brute_force(spark):
    rng = np.random.default_rng(18)
    pages, want = [], {}
    for i in range(60):
        host = f"h{i % 3}.example"
        blocks = [("lead", f"Lead {i}."), ("same", f"Constant of {host}."), ("body", f"Body {i} of text."), ("end", f"All {host} end so.")]
        if i % 2:
            blocks.insert(2, ("extra", f"Extra {i}."))
        pages.append((i, f"http://{host}/{i}", "<body>" + "".join(f"<div class={c}><span>{t}</span></div>" for c, t in blocks) + "</body>"))
        want[i] = " ".join(t for c, t in blocks if c not in ("same", "end"))
    order = [pages[int(k)] for k in rng.permutation(60)]
    got = html_extract.main_text(spark.createDataFrame(order * 2, "page_id long, url string, html string").repartition(7)).collect()
    assert len(got) == 120 and all(r["text"] == want[r["page_id"]] for r in got)


def test_html_copies_are_no_evidence(spark):
    same = [(i, "http://copy.example/a", "<html><body><div>The whole text.</div></body></html>") for i in range(5)]
    alone = [(10 + i, "http://mixed.example/a", "<body><div class=x>Only here.</div></body>") for i in range(6)] + [(20 + i, f"http://mixed.example/{i}", f"<body><div class=y>Page {i}.</div></body>") for i in range(6)]
    rows = spark.createDataFrame(same + alone, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.main_text(rows).collect()}
    assert all(got[i] == "The whole text." for i in range(5))
    assert all(got[10 + i] == "Only here." and got[20 + i] == f"Page {i}." for i in range(6))


def test_html_end_of_a_long_page():
    def page(i):
        return "".join(f"<h2>H {i} {k}</h2><p>P {i} {k}</p>" for k in range(1100 + i)) + "<div class=z>Same end</div>"

    trees = [html_extract.outline(html_extract.parse(page(i))) for i in range(5)]
    template = trees[0]
    for t in trees[1:]:
        template = html_extract.merged(template, t)
    text = html_extract.extract(page(2), template)
    assert "Same end" not in text and text.endswith("P 2 1101")


def test_html_long_matching_equals_short():
    rng = np.random.default_rng(12)
    for _ in range(30):
        a, b = ([["pqr"[int(x)], 1, None, [["k", 1, None, [], []]] * int(x), []] for x in rng.integers(0, 3, rng.integers(1, 12))] for _ in range(2))
        assert html_extract.long_matching(a, b) == html_extract.matching(a, b) or [x[0] for x in a] == [x[0] for x in b]


def test_html_template_decides_inside_and_outside_article(spark):
    page = "<body><div class=lead>Lead {i}.</div><article><h1>Head {i}</h1><div class=x>We all say this.</div><p>Text {i}.</p><div class=t>One</div><div class=t>Two</div></article><div class=y>Same</div></body>"
    rows = spark.createDataFrame([(i, f"http://a.example/{i}", page.format(i=i)) for i in range(6)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.main_text(rows).collect()}
    assert all(got[i] == f"Lead {i}. Head {i} Text {i}." for i in range(6))


def test_pipeline_drops_near_copies_by_brute_force(spark):
    import corpus_pipeline

    rows, rng = [], np.random.default_rng(13)
    for g in range(12):
        ws = lorem(100 + g, 200, 5000).split()
        for c in range(6):
            own = list(ws)
            for at in rng.integers(0, 200, int(rng.integers(0, 9))):
                own[at] = f"edit{g}x{c}x{at}"
            rows.append((len(rows), " ".join(own), "en", "s"))
    rows += [(900, None, "en", "s"), (901, "", "en", "s"), (902, "a b", "en", "s"), (903, "A  b", "en", "s"), (903, "A  b", "en", "s"), (904, "a c", "en", "s"), (None, "a b", "en", "s"), (None, "a b", "en", "s")]

    def plain(text):
        ws = (text or "").lower().split()
        return {tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))}

    sets = {i: plain(t) for i, t, _, _ in rows if i is not None}
    links = [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(links) > 20
    root = brute_components(links, list(sets))
    got = corpus_pipeline.one_of_each(spark, docs_of(spark, rows), "").select("doc_id").collect()
    assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == sorted(i for i in sets if root[i] == i)
    assert sum(r["doc_id"] is None for r in got) == 2
    for chunk in (2, 5):  # buckets and families in pairs of chunks
        split = near_copies.groups(docs_of(spark, rows), chunk).collect()
        assert {r["doc_id"]: r["component_id"] for r in split} == root
    assert corpus_pipeline.one_of_each(spark, docs_of(spark, []), "").collect() == []


def test_near_copies_meet_in_simhash_cells(spark):
    """The pipeline's near copies come by op3's steps: majority bits, segment popcounts, cells of a grid, popcount of what meets."""
    rng, memo, texts = np.random.default_rng(17), near_copies.Memo(), []
    for g in range(8):
        ws = lorem(300 + g, 150, 5000).split()
        for c in range(8):
            own = list(ws)
            for at in rng.integers(0, 150, c):
                own[at] = f"edit{g}x{c}x{at}"
            texts.append(" ".join(own))
    sets = [near_copies.shingles(t, memo) for t in texts]
    fps = np.array([near_copies.fingerprint(s) for s in sets])

    def bits(fp):
        return [int(x) >> k & 1 for x in fp for k in range(64)]

    for s, fp in zip(sets[:3], fps, strict=False):
        hashes = [bits(near_copies.mixed(x * near_copies._lanes)) for x in s]
        assert bits(fp) == [int(2 * sum(column) > len(s)) for column in zip(*hashes, strict=True)]
    grids, size = near_copies._dealt, near_copies.SEGMENT_BITS
    places = [[tuple(sum(b[size * k : size * k + size]) for k in grid) for grid in grids] for b in map(bits, fps)]
    packed = near_copies.cells(fps)
    meet = lambda i, j: any(a == b for a, b in zip(places[i], places[j], strict=True))
    assert all((packed[i] == packed[j]).any() == meet(i, j) for i in range(20) for j in range(i))
    first = [int(x) for x in fps[:, 0].view(np.int64)]
    assert len(set(first)) == len(first)
    close = lambda i, j: sum(bin(int(a ^ b)).count("1") for a, b in zip(fps[i][: near_copies.LONGS], fps[j], strict=False)) <= near_copies.NEAR
    want = brute_components([(first[i], first[j]) for i in range(len(first)) for j in range(i) if meet(i, j) and close(i, j)], first)
    assert len(set(want.values())) < len(first)
    rows = spark.createDataFrame([(fp.view(np.int64).tolist(), []) for fp in fps], "fp array<long>, short array<long>")
    for crowd in (1, 5, near_copies.CROWD):  # crowded cells are walked
        links = [(r["a"], r["b"]) for r in near_copies.candidate_links(rows, crowd).collect()]
        assert brute_components(links, first) == want


def test_near_copies_of_few_shingles(spark):
    """Texts of 4 to 9 shingles and the same less a word at one end: one shingle in five turns too many bits for any grid."""
    rows = []
    for g in range(60):
        ws = [f"w{g}x{k}" for k in range(9 + g % 5)]
        rows += [(len(rows), " ".join(ws), "en", "s"), (len(rows) + 1, " ".join(ws[1:] if g % 2 else ws[:-1]), "en", "s")]
    got = {r["doc_id"]: r["component_id"] for r in near_copies.groups(docs_of(spark, rows)).collect()}
    assert got == {i: i - i % 2 for i, *_ in rows}


def test_language_limits_come_from_all_rows(spark):
    rng = np.random.default_rng(14)
    text = lambda letters: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(12))
    rare = [i for i in range(20_000) if zlib.crc32(str(i).encode()) % 3 != 1 and zlib.crc32(str(i).encode()) > 3 << 30][:20]
    rows = [(i, text("mnopq") if i in rare else text("abcde"), "rr" if i in rare else "aa", "s") for i in range(9000)]
    short = [(30_000 + i, "жзи", "ss", "s") for i in range(6)]
    model = langid.trained(docs_of(spark, rows + short))
    assert model.langs == ["aa", "rr", "ss"] and np.isfinite(model.limits).all()


def plain_kneser_ney(texts):
    """Interpolated Kneser-Ney in dictionaries: function of (context of three, character) and known characters."""
    tables = [None, Counter(), Counter(), Counter(), Counter()]
    for t in texts:
        padded = [0, 0, *langid.symbols(t).tolist()]
        for i in range(3, len(padded)):
            tables[4][tuple(padded[i - 3 : i + 1])] += 1
    for n in (3, 2, 1):
        for g in tables[n + 1]:
            tables[n][g[1:]] += 1
    d, total, kinds = [0.0] * 5, defaultdict(int), defaultdict(int)
    for n in (1, 2, 3, 4):
        once, twice = sum(c == 1 for c in tables[n].values()), sum(c == 2 for c in tables[n].values())
        d[n] = once / (once + 2 * twice) if once and twice else 0.5
        for g, c in tables[n].items():
            total[g[:-1], n] += c
            kinds[g[:-1], n] += 1
    return tables, d, total, kinds


def plain_probability(model, gram, n, uniform):
    if n == 0:
        return uniform
    tables, d, total, kinds = model
    g = gram[-n:]
    lower = plain_probability(model, gram, n - 1, uniform)
    t = total.get((g[:-1], n), 0)
    if not t:
        return lower
    return max(tables[n].get(g, 0) - d[n], 0) / t + max(d[n] * kinds[g[:-1], n] / t, 1e-9) * lower


def test_language_id_equals_plain_kneser_ney(spark):
    rng = np.random.default_rng(15)
    texts = {lang: [" ".join("".join(rng.choice(list(letters), int(rng.integers(1, 6)), p=None)) for _ in range(15)) for _ in range(12)] for lang, letters in (("aa", "abcde"), ("bb", "cdefg"), ("cc", "aegxy"))}
    train = docs_of(spark, [(i, t, lang, "s") for lang in texts for i, t in enumerate(texts[lang])]).select("text", "lang")
    known = {c for ts in texts.values() for t in ts for c in langid.symbols(t).tolist()[1:]}
    plain = {lang: plain_kneser_ney(ts) for lang, ts in texts.items()}
    asked = [t for ts in texts.values() for t in ts[:3]] + ["abx gfe yy", "e", "deg dd aab"]
    got = {}
    for most in (1 << 28, 1):  # one block, and a block for each language
        blocks = langid.models(train, most)
        assert len(blocks) == (1 if most > 1 else 3)
        df = docs_of(spark, [(i, t, None, "s") for i, t in enumerate(asked)])
        got[most] = {r["doc_id"]: r["m"] for r in langid.measured(df, blocks, "m").collect()}
    for i, t in enumerate(asked):
        padded = [0, 0, *langid.symbols(t).tolist()]
        want = [-np.mean([np.log(plain_probability(plain[lang], tuple(padded[k - 3 : k + 1]), 4, 1 / (len(known) + 1))) for k in range(3, len(padded))]) for lang in sorted(plain)]
        assert got[1 << 28][i]["e"] == pytest.approx(want, abs=1e-5) and got[1][i]["e"] == pytest.approx(want, abs=1e-5)


def test_language_score_is_calibrated_and_names_may_clash(spark):
    rng = np.random.default_rng(16)
    mixture = {"aa": "aaabbc", "bb": "abbccc"}
    rows = [(i, "".join(rng.choice(list(mixture["aa" if i % 2 else "bb"]), 12)), "aa" if i % 2 else "bb", "s") for i in range(3000)]
    df = docs_of(spark, rows).withColumn("measured", F.lit(1)).withColumn("m", F.lit(2)).withColumn("__lid", F.lit(3))
    got = [r for r in langid.identify(df).collect() if r["held_out"]]
    right = [r["lang_pred"] == ("aa" if r["doc_id"] % 2 else "bb") for r in got]
    assert abs(np.mean([r["score"] for r in got]) - np.mean(right)) < 0.05
    assert langid.keep_known(df).columns == df.columns
    assert langid.keep_known(docs_of(spark, [(1, "abc", None, "s"), (2, None, None, None)])).count() == 2


def test_language_score_knows_its_errors(spark):
    """Snippets of the given texts, short enough to be misread: on held-out ones the scores must be worth more than one constant, and errors score lower."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    snippets = docs.withColumn("text", F.substring("text", 60, 5))
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = [(r["score"], r["lang_pred"] == truth[r["doc_id"]]) for r in langid.identify(snippets).collect() if r["held_out"] and truth[r["doc_id"]] and r["lang_pred"] != "und"]
    right = [s for s, ok in got if ok]
    wrong = [s for s, ok in got if not ok]
    share = len(right) / len(got)
    constant = -share * np.log(share) - (1 - share) * np.log(1 - share)
    loss = (-np.sum(np.log(right)) - np.sum(np.log(1 - np.array(wrong)))) / len(got)
    assert len(wrong) >= 5 and loss < 0.9 * constant, (len(wrong), loss, constant)
    assert np.mean(wrong) < np.mean(right) - 0.1 and max(wrong + right) < 1


def test_language_with_few_texts_is_still_learned(spark):
    same = [(i, "жзий клмн опрс", "rr", "s") for i in range(12)]  # one text: it stands on one side of the split, whichever
    rows = same + [(100 + i, f"abc de{'abcdefgh'[i % 8]} fgh{'xyz'[i % 3]} {'ab' * (i % 9 + 1)}", "aa", "s") for i in range(60)]
    got = {r["doc_id"]: r for r in langid.identify(docs_of(spark, rows)).collect()}
    assert all(got[i]["lang_pred"] == "rr" for i in range(12)) and all(got[100 + i]["lang_pred"] == "aa" for i in range(60))
    assert not any(r["rejected"] for r in got.values()) and all(0 < r["score"] < 1 for r in got.values())


def test_html_template_does_not_depend_on_page_order(spark):
    """A constant block on 700 of 1300 pages of a host, and an odd class on every page: whatever the order and the partitions, the block goes and all else stays."""
    block = "<div class=stays>Same words everywhere</div>"
    pages = [(i, "http://h.example/x", f"<div class=odd{i}>Odd {i}</div>{block if i < 700 else ''}<div class=body>Text {i}</div>") for i in range(1300)]
    shuffled = [pages[i] for i in np.random.default_rng(17).permutation(1300)]
    for order in (pages, pages[::-1], shuffled):
        for parts in (1, 5):
            df = spark.createDataFrame(order, "page_id long, url string, html string").coalesce(1) if parts == 1 else spark.createDataFrame(order, "page_id long, url string, html string").repartition(parts)
            assert {r["page_id"]: r["text"] for r in html_extract.main_text(df).collect()} == {i: f"Odd {i} Text {i}" for i in range(1300)}


def test_merkle_edits_are_located(spark):
    """Paragraphs that differ by place, against a plain comparison; equal texts have none."""
    def places(a, b):
        x, y = ([s.split("\n") for s in t.split("\n\n")] for t in (a, b))
        get = lambda t, i, j: t[i][j] if i < len(t) and j < len(t[i]) else None
        sizes = [max(len(t[i]) if i < len(t) else 0 for t in (x, y)) for i in range(max(len(x), len(y)))]
        return " ".join(f"{i}:{j}" for i, n in enumerate(sizes) for j in range(n) if get(x, i, j) != get(y, i, j))

    rng = np.random.default_rng(18)
    texts = ["".join(rng.choice(["a", "b. ", "\n", "\n\n", "word "], int(rng.integers(0, 40)))) for _ in range(40)] + ["", "same", "same"]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in merkle.fingerprinted(docs_of(spark, rows)).collect()}
    for i, t in enumerate(texts):
        k, nx = len(t) // 4, texts[(i + 1) % len(texts)]
        edited = t[: len(t) - k] + nx[:k]
        assert got[i]["edited_at"] == places(t, edited)
        assert (got[i]["near_edited"] == 1.0) == (t == edited) or got[i]["edited_at"]
    assert got[len(texts) - 2]["near_next"] == 1.0
