"""Registered queries of the dealt operators against SQL where it can express them, and accuracy on held-out labels."""

import pytest

from daygrid.llm import quality_rules, queries

from helpers import DATA, connection, same


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    same(queries.queries()[name](spark, str(DATA)), connection(), queries.oracle_sql()[name])


def test_base_rules_equal_sql(spark):
    df = queries.op9_quality_rules(spark, str(DATA)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    same(df, connection(), quality_rules.SQL)


def test_held_out_accuracy(spark):
    sf = str(DATA).replace("0.001", "0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    for name, truth, least in (("op4_toxicity", "toxic", 0.95), ("op10_quality_classifier", "quality", 0.9)):
        got = queries.queries()[name](spark, sf).filter("held_out").join(labels, "doc_id").toPandas()
        assert (got["predicted"] == got[truth]).mean() > least
    got = queries.op8_language_id(spark, sf).filter("held_out").join(docs, "doc_id").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.99


def test_pipeline_by_brute_force(spark, tmp_path):
    """A small corpus with null ids, repeats and clashing names: what the stages must drop is known, and the last two are recomputed."""
    import numpy as np
    import tokenizers
    import public_tokenizers
    from pyspark.sql import functions as F

    import corpus_pipeline
    from daygrid.llm import mixing

    rng, rows, labels = np.random.default_rng(31), [], []

    def text(letters, n=60, extra=()):
        ws = ["".join(rng.choice(list(letters), int(rng.integers(3, 9)))) for _ in range(n)]
        for w in extra:
            ws[int(rng.integers(n))] = w
        return " ".join(ws)

    for i in range(300):
        toxic = i % 10 == 0
        rows.append((i, text("abcdefgh" if i % 2 else "nopqrstu", extra=["zorkface", "zorkface", "blargo"] if toxic else ()), "aa" if i % 2 else "nn", "src" + str(i % 3)))
        labels.append((i, 1, int(toxic)))
    clean = [r for r in rows if r[0] % 10]
    copies = [(1000 + k, r[1], r[2], r[3]) for k, r in enumerate(clean[:40])]
    near = [(2000 + k, r[1] + " abcd", r[2], r[3]) for k, r in enumerate(clean[40:60])]
    strange = [(3000 + k, text("жзийклмн"), None, "src0") for k in range(5)]
    odd = [(4000, None, "aa", "src0"), (4001, "", None, None), (None, text("abcdefgh"), "aa", None), (None, text("nopqrstu"), "nn", "src1"), clean[5], clean[5]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, toxic string, measured string, gone string, hash string"
    full = [(i, t, lang, src, len(t or ""), "x", "y", "z", "h") for i, t, lang, src in [*rows, *copies, *near, *strange, *odd]]
    spark.createDataFrame(full, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == [c.split()[0] for c in schema.split(", ")], name
        seen[name] = [tuple(r) for r in docs.collect()]
    gone = {r[0] for r in (*strange, odd[0], odd[1])}
    want = sorted((r for r in full if r[0] not in gone), key=str)
    assert sorted(seen["language_id"], key=str) == want
    toxic = {i for i, _, t in labels if t}
    want = [r for r in want if r[0] not in toxic]
    assert sorted(seen["toxicity"], key=str) == want
    want = sorted({r for r in want if r[0] is None or r[0] < 1000}, key=str)
    assert sorted(seen["near_dedup"], key=str) == want
    before = spark.createDataFrame(want, schema)
    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.mix(before).collect() if r["doc_id"] is not None}
    times = {i: sum(r[0] == i for r in seen["source_mixing"]) for i in taken}
    assert set(seen["source_mixing"]) <= set(want) and all(t // s <= times[i] <= -(-t // s) for i, (t, s) in taken.items())
    assert sum(times.values()) > 200 and any(r[0] is None for r in seen["source_mixing"])
    lib = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((str(r[0]), len(lib.encode(r[1], add_special_tokens=False).ids)) for r in seen["source_mixing"])
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want
    docs.limit(0).write.parquet(str(tmp_path / "empty" / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "empty" / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).collect() == []


def test_pipeline_keeps_contract(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(DATA))
        assert docs.columns == columns, name
        assert docs.count() <= n
    assert corpus_pipeline.run(spark, str(DATA)).filter("n_tokens is null").count() == 0
