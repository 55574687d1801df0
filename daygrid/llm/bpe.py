"""BPE encoding and decoding with a pair occurrence index.

The pieces of a batch that were not met before are laid out in one linked list of symbols. An index maps each mergeable pair's
rank to all positions where the pair stands; the active ranks are applied in ascending order, each to its positions from left to
right, and the lists of the pairs that a merge makes are updated. Where a merge makes a pair of lower rank than the one at work,
the positions left are put back and the lower rank comes first, so the result is the one of merging each piece on its own.

The vocabulary file (a word-level BPE with end-of-word marks, NFC, lower case, white space dropped) is read on the driver and
broadcast; its size is fixed. Encoding keeps the file's control strings whole where they stand in a text.

Defined results: null and empty texts have no tokens (digests of the empty string); repeated rows give a row each; very long
texts are encoded whole; an empty table gives no rows; extra columns are ignored."""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

#: Rows that are encoded together.
ROWS = 128
#: Default bytes (about) of a worker's memories of chunks and of pieces (they change speed, never results), kept from task to task. A full memory becomes the old one, from which
#: what is met again moves back, so frequent words stay; each holds two generations at most. A chunk over LONG characters is not kept.
CHUNK_BYTES = 96 << 20
PIECE_BYTES = 56 << 20
LONG = 256
#: Bytes (about) that an entry of a memory takes besides its characters: two string headers and its share of a table.
BESIDE = 190
# Fixed values of the tokenizer library (it lowers by Unicode 17 and splits by 16): letters that Python's tables do not lower yet (first, last, lower
# form of the first), and ranges of code points that are no letters there, whatever the installed regex module says.
LOWER = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5),
    (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)
NOT_LETTERS = """
0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE
11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2
1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4
1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
""".split()
_lower = {c: c - first + low for first, last, low in LOWER for c in range(first, last + 1)} | {ord("Σ"): "σ"}
_odd_space = regex.compile("[\x1c-\x1f]")
_space = regex.compile(r"[^\t-\r \x85\xa0  -     　]+")


def vocabulary(path: str | None = None) -> dict:
    """What encoding needs of a tokenizer file: ids, merges by pair and by rank, tokens, control strings and the split pattern."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ids = spec["model"]["vocab"]
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
    merges = [(ids[a], ids[b], ids[a + (b if b else "")]) for a, b in pairs]
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    return {
        "ids": ids,
        "merges": merges,
        "ranks": {(a, b): r for r, (a, b, _) in enumerate(merges)},
        "tokens": {i: t for t, i in (ids | added).items()},
        "added": added,
        "split": split,
        "end": spec["model"]["end_of_word_suffix"] or "",
    }


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the rest from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Encoder:
    def __init__(self, vocab: dict, chunk_bytes: int = CHUNK_BYTES, piece_bytes: int = PIECE_BYTES) -> None:
        self.v, self.chunk_bytes, self.piece_bytes = vocab, chunk_bytes, piece_bytes
        letter, end, ids = byte_letters(), vocab["end"], vocab["ids"]
        self.inner = [ids.get(c) for c in letter]
        self.last = [ids.get(c + end) for c in letter]
        gone = "".join("-".join(f"\\U{int(x, 16):08X}" for x in r.split("-")) for r in NOT_LETTERS)
        # \p{L} stands in a class of its own or in a larger one: there letters less those of the table, here the table's besides.
        split = vocab["split"].replace(r"[\p{L}]", r"[\p{L}--[" + gone + "]]").replace(r"[^\s\p{L}\p{N}]", r"[[^\s\p{L}\p{N}]||[" + gone + "]]")
        self.pieces = regex.compile(split, regex.V1).findall
        self.controls = regex.compile("(" + "|".join(map(regex.escape, sorted(vocab["added"], key=len, reverse=True))) + ")")
        # Memories of chunks and of pieces: the ids, joined by a space. Decoding goes by ids, so no decoded text is kept.
        self.known: dict[str, str] = {}
        self.met: dict[str, str] = {}
        self.known_before: dict[str, str] = {}
        self.met_before: dict[str, str] = {}
        self.known_bytes = self.met_bytes = 0
        self.control = {t: str(i) for t, i in vocab["added"].items()}
        self.token = {str(i): t for i, t in vocab["tokens"].items()}

    def merged(self, pieces: list[str]) -> list[str]:
        """Token ids of each piece, joined by a space, by the pair occurrence index over all of them."""
        ranks, merges = self.v["ranks"], self.v["merges"]
        sym: list[int] = []
        first = []
        for p in pieces:
            first.append(len(sym))
            raw = p.encode("utf-8", "surrogatepass")
            sym += [i for b in raw[:-1] if (i := self.inner[b]) is not None]
            if (i := self.last[raw[-1]]) is not None:
                sym.append(i)
            sym.append(-1)
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        where: dict[int, list[int]] = {}
        for i, pair in enumerate(zip(sym, sym[1:], strict=False)):
            if (r := ranks.get(pair)) is not None:
                where.setdefault(r, []).append(i)
        active = list(where)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            places = where.pop(rank, None)
            if not places:
                continue
            places.sort()
            a, b, new = merges[rank]
            for k, i in enumerate(places):
                if sym[i] != a or sym[j := after[i]] != b:
                    continue
                sym[i], sym[j] = new, -2
                after[i] = right = after[j]
                before[right] = i
                lower = False
                for at, pair in ((before[i], (sym[before[i]], new) if before[i] >= 0 else None), (i, (new, sym[right]))):
                    r = ranks.get(pair)
                    if r is not None:
                        if r in where:
                            where[r].append(at)
                        else:
                            where[r] = [at]
                            heapq.heappush(active, r)
                        lower |= r < rank
                if lower and k + 1 < len(places):
                    where.setdefault(rank, []).extend(places[k + 1 :])
                    heapq.heappush(active, rank)
                    break
        out = []
        for i in first:
            got = []
            while sym[i] != -1:
                got.append(sym[i])
                i = after[i]
            out.append(" ".join(map(str, got)))
        return out

    def split(self, chunk: str) -> list[str]:
        """The pieces of a chunk, lower-cased. ASCII letters, with a mark behind them or not, need no pattern."""
        if not chunk.isascii():
            return self.pieces(unicodedata.normalize("NFC", chunk).translate(_lower).lower())
        low = chunk.lower()
        if low.isalpha():
            return [low]
        if low[-1] in ".,;:!?" and low[:-1].isalpha():
            return [low[:-1], low[-1]]
        return self.pieces(low)

    def learn(self, chunks: set[str]) -> dict[str, str]:
        """Encode the chunks (runs between white space) that are not known. Returns those too long to be kept."""
        if self.known_bytes > self.chunk_bytes:
            self.known_before, self.known, self.known_bytes = self.known, {}, 0
        if self.met_bytes > self.piece_bytes:
            self.met_before, self.met, self.met_bytes = self.met, {}, 0
        new = chunks.difference(self.known)
        back = {c: self.known_before[c] for c in new if c in self.known_before}
        parts = {c: self.split(c) for c in new.difference(back)}
        fresh = {p for ps in parts.values() for p in ps}.difference(self.met)
        moved = {p: self.met_before[p] for p in fresh if p in self.met_before}
        fresh = list(fresh.difference(moved))
        found = moved | dict(zip(fresh, self.merged(fresh), strict=True))
        long_pieces = {p: ids for p, ids in found.items() if len(p) > LONG}
        short = {p: ids for p, ids in found.items() if len(p) <= LONG} if long_pieces else found
        self.met |= short
        self.met_bytes += sum(BESIDE + 2 * len(p) + len(ids) for p, ids in short.items())
        met = self.met
        got = back | {c: met[ps[0]] if len(ps) == 1 and ps[0] in met else " ".join(filter(None, (met[p] if p in met else long_pieces[p] for p in ps))) for c, ps in parts.items()}
        long_chunks = {c: ids for c, ids in got.items() if len(c) > LONG}
        short = {c: ids for c, ids in got.items() if len(c) <= LONG} if long_chunks else got
        self.known |= short
        self.known_bytes += sum(BESIDE + 2 * len(c) + len(ids) for c, ids in short.items())
        return long_chunks

    def encode(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """Of each text: the number of tokens, the ids joined by a space, and the decoded text."""
        laid = []
        need: set[str] = set()
        for t in texts:
            t = t or ""
            parts = [t] if "<|" not in t else [p for p in self.controls.split(t) if p]
            chunks = [[p] if p in self.v["added"] else _space.findall(p) if _odd_space.search(p) else p.split() for p in parts]
            flat = [c for cs in chunks for c in cs]
            laid.append(flat)
            need.update(flat)
        special = {t: ids for t, ids in self.control.items() if t in need}
        need.difference_update(self.v["added"])
        special |= self.learn(need)
        known = self.known
        for flat in laid:
            got = (special[c] if c in special else known[c] for c in flat) if special else map(known.__getitem__, flat)
            ids = " ".join(filter(None, got))  # a chunk may have no token
            each = ids.split(" ") if ids else []
            yield len(each), ids, " ".join(map(self.token.__getitem__, each))


def encoded(docs: DataFrame, path: str | None = None, full: bool = False, chunk_bytes: int = CHUNK_BYTES, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """doc_id, n_tokens and, with full, ids (joined by a space) and decoded; else their sha256."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    names = ["doc_id", "n_tokens", "ids", "decoded"] if full else ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def shown(s: str) -> str:
        return s if full else hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

    @tidy
    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = known.value  # one object for all tasks of a worker
        if "encoder" not in vocab:
            vocab["encoder"] = Encoder(vocab, chunk_bytes, piece_bytes)
        enc = vocab["encoder"]
        for big in batches:
            for i in range(0, big.num_rows, ROWS):  # bounds what a very long batch holds
                b = big.slice(i, ROWS)
                got = [(n, shown(ids), shown(text)) for n, ids, text in enc.encode(b.column(1).to_pylist())]
                cols = [pa.array([g[k] for g in got], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([b.column(0), *cols], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(per_task, f"doc_id long, n_tokens long, {names[2]} string, {names[3]} string")


def digests(docs: DataFrame, path: str | None = None, chunk_bytes: int = CHUNK_BYTES, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encoded(docs, path, False, chunk_bytes, piece_bytes)
