"""Line dedup, spelling variants and prefix tries by brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from daygrid.llm import line_dedup, prefix_trie, queries, spelling

from helpers import DATA

SCHEMA = "doc_id long, text string, id string, own string, line string, gone string, word string, n string"
WHITE = " \t\n\x0b\x0c\r"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, *"abcdef") for i, t in rows], SCHEMA).repartition(3)


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def lines_by_brute_force(rows, min_chars=40, min_docs=5):
    """Of each row: what stays, lines, dropped lines. A document is its id, or its text where it has none."""
    held, last = defaultdict(set), {}
    key = lambda line: lower(line.strip(WHITE))
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                held[key(line)].add((i is not None, i or 0, "" if i is not None else t))
    for k, ds in held.items():
        if len(ds) >= min_docs:
            last[k] = max(ds)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in last or last[key(x)] == (i is not None, i or 0, "" if i is not None else t)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_line_dedup_by_brute_force(spark):
    rng = random.Random(5)
    common = ["Subscribe to our weekly letter and never miss a thing again", "\tÉcoutez, nous vous souhaitons une très bonne journée à tous ", "x" * 40, "y" * 39]
    rows = [(None, None), (-5, ""), (7, "\n\n"), (8, "short\nshort"), (2**40, common[0].upper() + " \r"), (9, "long " * 60_000)]
    for i in range(40):
        lines = [f"own line {i} {k} that nobody else holds at all, really" for k in range(rng.randrange(4))]
        for c in common:
            if rng.random() < 0.4:
                lines += [c, f"  {c.replace('S', 's')}\x0b"]
        rng.shuffle(lines)
        rows.append((100 + i, "\n".join(lines)))
    rows += rows[10:14]  # repeated rows are one document each
    got = sorted(map(tuple, line_dedup.deduplicated(docs_of(spark, rows)).collect()), key=str)
    assert got == lines_by_brute_force(rows)
    assert sum(r[3] for r in got) > 50
    four = [(i, common[0]) for i in range(4)]
    assert sum(r["n_dropped"] for r in line_dedup.deduplicated(docs_of(spark, [*four, four[0], four[1]])).collect()) == 0


def test_line_dedup_without_ids(spark):
    """Rows without an id are documents by their text; the line stays in a document with an id if there is one."""
    line = "a line that everyone copies from everyone else"
    rows = [(None, f"{line}\n{k}") for k in range(6)] + [(None, f"{line}\n0")]
    out = line_dedup.deduplicated(docs_of(spark, rows)).collect()
    assert Counter(r["n_dropped"] for r in out) in (Counter({1: 6, 0: 1}), Counter({1: 5, 0: 2}))  # the text that keeps it may be there twice
    out = line_dedup.deduplicated(docs_of(spark, [*rows, (-1, line)])).collect()
    assert [r["doc_id"] for r in out if r["n_dropped"] == 0] == [-1]
    assert line_dedup.digests(docs_of(spark, [(1, "a")]).limit(0)).collect() == []


def test_hot_line_is_counted_before_it_is_shuffled(spark):
    plan = line_dedup.dropped_lines(docs_of(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "Window" not in plan and "Cartesian" not in plan


def words_by_brute_force(rows, min_count=3):
    counts = Counter()
    for i, t in rows:
        for w in map(lower, re.findall("[A-Za-zÀ-ÿ]+", t or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            counts[w if h % 97 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= min_count}
    at, near = defaultdict(set), defaultdict(set)
    for w in words:
        for k in range(len(w)):
            at[w[:k], w[k + 1 :]].add(w)
            if (less := w[:k] + w[k + 1 :]) in words:
                near[w].add(less)
                near[less].add(w)
    for group in at.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in words:
        if near[w] and words[best := min(near[w], key=lambda x: (-words[x], x))] >= 2 * words[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items())


def scattered(seed, n):
    """Words around a few stems: substitutions, insertions and deletions, repeated letters, letters beyond ASCII, chains of forms."""
    rng = random.Random(seed)
    stems, rows = ["thinking", "thinner", "aaaaaa", "éclairé", "straße", "letter", "lettre", "x" * 30], []
    for i in range(n):
        ws = []
        for _ in range(30):
            w = rng.choice(stems)
            for _ in range(int(rng.random() < 0.5) + int(rng.random() < 0.2)):
                k, c = rng.randrange(len(w)), rng.choice("abté")
                w = rng.choice([w[:k] + c + w[k:], w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :]])
            ws.append(w.title() if rng.random() < 0.2 else w)
        rows.append((i, rng.choice([" ", "-", "\n", "×1"]).join(ws)))
    return rows


@pytest.mark.parametrize("crowd", [0, 4, 64])
def test_spelling_by_brute_force(spark, crowd):
    rows = scattered(3, 120)
    rows += [(None, rows[0][1]), (500, None), (501, ""), (502, "日本 12 abc"), *rows[:5], (503, "longest " * 20_000 + "q" * 5_000)]
    got = sorted(map(tuple, spelling.variants(docs_of(spark, rows), crowd=crowd).collect()))
    assert got == words_by_brute_force(rows)
    assert any(r[1] and r[2] != r[1] for r in got)  # a chain


def test_spelling_query_by_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op12_spelling_variants(spark, str(DATA)).collect())) == words_by_brute_force(rows)


def test_crowded_chunks_keep_every_link_and_few_rows(spark):
    """600 words share their first half; with a letter's place no key holds more words than letters."""
    letters = [chr(c) for c in range(97, 123)]
    words = [("stem" + a + b + c, 5) for a in letters[:12] for b in letters[:10] for c in letters[:5]]
    df = spark.createDataFrame(words, "word string, n long")
    want = {(a, b) for a, _ in words for b in {a[:k] + c + a[k + 1 :] for k in range(4, 7) for c in letters} - {a} if b in dict(words)}
    for crowd in (1, 64, 10**6):
        got = [(r["word"], r["near"]) for r in spelling.near_words(df, crowd=crowd).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert spelling.variants(docs_of(spark, []).limit(0)).collect() == []


def trie_by_brute_force(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    built, members = {}, defaultdict(list)
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - c % 100, [])[:h] + v[h:]
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def talks(seed, n, longest=70):
    """Conversations with shared beginnings of any depth, copies, null turns, roles and texts, and gaps in the ids."""
    rng, rows = random.Random(seed), []
    for c in range(n):
        if c % 7 == 5:
            continue
        k = rng.choice([1, 2, 3, 4, 6, 12, 40, longest]) if c % 3 else 14
        for i in range(k):
            role = rng.choice(["user", None]) if c % 3 and rng.random() < 0.2 else "u"
            rows.append((c, None if i == 0 and c % 5 == 0 else i, role, None if rng.random() < 0.05 and c % 3 else "tü" * (1 + rng.randrange(2) * (i > 9 and rng.random() < 0.3))))
    return [*rows, (None, 1, "a", "b"), (300, 1, "u", "tü"), (300, 1, "u", "tü")]


def tables(spark, rows):
    full = [(*r, "x", "y", "z") for r in rows]
    return spark.createDataFrame(full, "conv_id long, turn long, role string, text string, key string, depth string, turns string").repartition(3)


@pytest.mark.parametrize("shard", [prefix_trie.SHARD, 400, 30])
def test_trie_by_brute_force(spark, shard):
    """However small the shards, nodes that they share are recombined."""
    rows = talks(3, 300)
    assert sorted(map(tuple, prefix_trie.nodes(tables(spark, rows), shard).collect()), key=str) == trie_by_brute_force(rows)


def test_trie_query_by_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, queries.op11_prefix_trie(spark, str(DATA)).collect()), key=str) == trie_by_brute_force(rows)


def test_trie_of_copies_and_of_a_long_talk(spark):
    """More copies than a piece of packed ids holds, ended at one node that many shards share; one talk longer than a shard; an empty table."""
    rows = [(1000 + c, 0, "user", "same") for c in range(2500)] + [(7, i, "user", f"turn {i}") for i in range(1500)]
    assert sorted(map(tuple, prefix_trie.nodes(tables(spark, rows), 600).collect()), key=str) == trie_by_brute_force(rows)
    assert prefix_trie.nodes(tables(spark, rows[:1]).limit(0)).collect() == []
    alone = prefix_trie.nodes(tables(spark, [(3, 0, "user", None)])).filter("depth = 0").first()
    assert (alone["n_convs"], alone["parent_conv_id"]) == (1, None)


def test_trie_shuffles_no_texts(spark):
    plan = prefix_trie.rebuilt(prefix_trie.sequences(tables(spark, [(1, 0, "a", "b")])))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
