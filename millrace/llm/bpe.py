"""BPE encoding and decoding (operator 7), for vocabularies with word ends.

Method: batched numpy merge rounds. The pieces of many words lie in one flat array of symbol ids; each round forms the keys
of all adjacent pairs, finds their ranks by binary search over the sorted pair keys, takes the lowest rank of each word
and merges there, leftmost first. Where merging a pair can't bring forth a pair of lower rank (checked for each rank when the
vocabulary is loaded), all its occurrences in a word merge in one round; else only the leftmost does, as a heap ordered by rank
and position would.

A word of more than ``LONG`` bytes (a base64 line, minified code) is merged alone, by the same rounds: its pairs' places are listed by rank, a round takes the
list of the lowest rank, and only pairs beside a merge are looked up again, so its work grows with its length and not with its square.

Pre-tokenisation never joins over white space, so a text is split at white space and each different chunk is encoded
once in a bounded per-worker cache; ids of texts are gathered from it. Texts of any length are encoded whole, in some 20 bytes of memory a character.

The file is the tokenizers library's JSON, read on each worker from ``path`` (installed with the Python packages, so every
executor has it). Special tokens that stand in a text become their own ids, as that library does. The normaliser and the pre-tokeniser are built in (``NORMALIZER``,
``PRE_TOKENIZER``); a file that names others is refused.

Defined cases: null or empty text gives no ids and decodes to an empty text; other columns pass through, one named ids or decoded is replaced; each row is encoded alone, so repeated
rows and ids change nothing; of equal pairs in a word the leftmost merges first; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import pieces, unpacked

SPACE = r"\t-\r\x20\x85\xA0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # Unicode White_Space
PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
ODD_SPACE = regex.compile(r"[\x1c-\x1f]")  # str.split() would split there
CHUNK = regex.compile(rf"[^{SPACE}]+")
NONE = np.iinfo(np.int32).max
CACHE_ENTRIES, CACHE_IDS = 250_000, 2_500_000
SLICE_CHARS = 1_000_000
LONG = 4096
#: The sections of a vocabulary file that this module implements.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable Latin-1, else from U+0100 on."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class Vocabulary:
    """One loaded vocabulary with its cache of encoded chunks."""

    _loaded: dict[str, Vocabulary] = {}

    @classmethod
    def at(cls, path: str) -> Vocabulary:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        known = {"normalizer": NORMALIZER, "pre_tokenizer": PRE_TOKENIZER, "decoder": None}
        odd = [k for k, own in known.items() if spec.get(k) != own] + [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        if odd or not model.get("end_of_word_suffix"):
            raise ValueError(f"{path}: this encoder knows other settings of " + ", ".join(odd or ["end_of_word_suffix"]))
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.special_begins = {t[0] for t in self.special}
        tokens = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in [*vocab.items(), *self.special.items()]:
            tokens[i] = token
        self.tokens = pa.array(tokens)
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.final = np.array([vocab[s + end] for s in symbols], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        into = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = (left << 32) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.into = keys[order], order.astype(np.int64), into[order]
        least = np.full(len(tokens), NONE, np.int64)  # lowest rank of a pair that has the token
        np.minimum.at(least, left, np.arange(len(merges)))
        np.minimum.at(least, right, np.arange(len(merges)))
        self.safe = np.append(least[into] > np.arange(len(merges)), True)
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.starts = self.lengths = np.empty(0, np.int64)
        self.table = np.empty(0, np.int32)

    def merged(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, end to end, and each one's count."""
        raw = [p.encode() for p in pieces]
        length = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(length)
        sym = self.inner[data]
        sym[ends - 1] = self.final[data[ends - 1]]
        word = np.repeat(np.arange(len(raw)), length)
        done_sym, done_word = [], []
        for k in np.flatnonzero(length > LONG).tolist():
            done_sym.append(self.merged_alone(sym[ends[k] - length[k] : ends[k]]))
            done_word.append(np.full(len(done_sym[-1]), k))
        if done_sym:
            short = np.repeat(length <= LONG, length)
            sym, word = sym[short], word[short]
        while len(sym):
            key = (sym[:-1] << 32) | sym[1:]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            rank = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.rank[at], NONE)
            rank = np.append(rank, NONE)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            count = np.diff(np.append(first, len(sym)))
            low = np.repeat(np.minimum.reduceat(rank, first), count)
            over = low == NONE
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
                if over.all():
                    break
            hit = np.flatnonzero((rank == low) & ~over)
            # of a word's hits: the leftmost alone, or, where safe, every other one of each run of overlapping hits
            w, safe = word[hit], self.safe[np.minimum(low[hit], len(self.safe) - 1)]
            fresh = np.append(True, w[1:] != w[:-1])
            run_start = fresh | np.append(True, hit[1:] != hit[:-1] + 1)
            in_run = np.arange(len(hit)) - np.flatnonzero(run_start)[np.cumsum(run_start) - 1]
            hit = hit[np.where(safe, in_run % 2 == 0, fresh)]
            sym = sym.copy()
            sym[hit] = self.into[at[hit]]
            alive = ~over
            alive[hit + 1] = False
            sym, word = sym[alive], word[alive]
        sym, word = np.concatenate(done_sym) if done_sym else sym, np.concatenate(done_word) if done_word else word
        order = np.argsort(word, kind="stable")
        return sym[order].astype(np.int32), np.bincount(word, minlength=len(raw))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of pairs, ``NONE`` where they don't merge, and what they merge into."""
        key = (left << 32) | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.rank[at], NONE), self.into[at]

    def merged_alone(self, sym: np.ndarray) -> np.ndarray:
        """The symbols of one long word, merged."""
        n = len(sym)
        sym = np.append(sym, -1)
        following, before = np.arange(1, n + 2), np.arange(-1, n)  # places of the neighbours; n is behind the last
        rank = np.full(n + 1, NONE)  # of the pair that begins at a place
        rank[: n - 1] = self.ranks(sym[: n - 1], sym[1:n])[0]
        alive = np.ones(n, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def put(places: np.ndarray) -> None:
            if not len(places):
                return
            own = rank[places]
            order = np.argsort(own, kind="stable")
            places, own = places[order], own[order]
            cuts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            for a, b, r in zip(cuts.tolist(), np.append(cuts[1:], len(own)).tolist(), own[cuts].tolist(), strict=True):
                if r != NONE:
                    if r not in waiting:
                        waiting[r] = []
                        heapq.heappush(heap, r)
                    waiting[r].append(places[a:b])

        put(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            places = np.unique(np.concatenate(waiting.pop(r)))
            hit = places[rank[places] == r]  # others were merged or have another pair by now
            if not len(hit):
                continue
            if self.safe[r]:  # every other one of each run of overlapping hits
                begins = np.append(True, following[hit[:-1]] != hit[1:])
                in_run = np.arange(len(hit)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]
                hit = hit[in_run % 2 == 0]
            else:
                put(hit[1:])
                hit = hit[:1]
            right = following[hit]
            sym[hit] = self.ranks(sym[hit[:1]], sym[right[:1]])[1]
            rank[right], alive[right] = NONE, False
            after = following[right]
            following[hit], before[after] = after, hit
            left = before[hit]
            changed = np.unique(np.concatenate([left[left >= 0], hit]))
            rank[changed] = np.where(following[changed] < n, self.ranks(sym[changed], sym[np.minimum(following[changed], n - 1)])[0], NONE)
            put(changed)
        return sym[:n][alive]

    def pieces(self, chunk: str) -> list[str | int]:
        """Pieces of a chunk without white space; special tokens as their ids."""
        out: list[str | int] = []
        for part in self.special_at.split(chunk) if not self.special_begins.isdisjoint(chunk) else [chunk]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                if not part.isascii():
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ")  # lower-casing goes by single characters
                out += PIECE.findall(part.lower())
        return out

    def learn(self, chunks: list[str]) -> None:
        split = [self.pieces(c) for c in chunks]
        flat = [p for ps in split for p in ps]
        new = list(dict.fromkeys(flat))
        words = [p for p in new if isinstance(p, str)]
        ids, count = self.merged(words) if words else (np.empty(0, np.int32), np.empty(0, np.int64))
        special = [p for p in new if isinstance(p, int)]
        place = {p: k for k, p in enumerate(words + special)}
        ids = np.concatenate([ids, np.array(special, np.int32)])
        count = np.concatenate([count, np.ones(len(special), np.int64)])
        own = np.fromiter((place[p] for p in flat), np.int64, len(flat))
        got, size = gathered(ids, (np.cumsum(count) - count)[own], count[own])
        ends = np.append(0, np.cumsum(size))[np.cumsum([0, *map(len, split)])]
        self.index.update(zip(chunks, range(len(self.index), len(self.index) + len(chunks)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.table) + ends[:-1]])
        self.lengths = np.concatenate([self.lengths, np.diff(ends)])
        self.table = np.concatenate([self.table, got])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and each one's count."""
        if len(self.index) > CACHE_ENTRIES or len(self.table) > CACHE_IDS:
            self.clear()
        split = [CHUNK.findall(t) if ODD_SPACE.search(t) else t.split() for t in texts]
        index = self.index
        new = set(chain.from_iterable(split)).difference(index)
        if new:
            self.learn(list(new))
        at = np.fromiter(map(index.__getitem__, chain.from_iterable(split)), np.int64, sum(map(len, split)))
        out, size = gathered(self.table, self.starts[at], self.lengths[at])
        total = np.append(0, np.cumsum(size))
        return out, np.diff(total[np.cumsum([0, *map(len, split)])])


def gathered(table: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices of ``table`` at ``start``, end to end, and their sizes."""
    take = np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)
    return table[take], size


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    a = n = 0
    for b, t in enumerate(texts):
        n += len(t)
        if n >= SLICE_CHARS:
            yield a, b + 1
            a, n = b + 1, 0
    if a < len(texts):
        yield a, len(texts)


def _joined(v: Vocabulary, offsets: np.ndarray, ids: pa.Array) -> pa.Array:
    """The tokens of each list of ids, joined by a space."""
    tokens = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), v.tokens.take(ids))
    return pc.fill_null(pc.binary_join(tokens, " "), "")


def _encode(path: str, text_col: str, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary.at(path)
        for batch in pieces(batches):
            texts = pc.fill_null(batch.column("_row").field(text_col), "").to_pylist()
            for a, b in _slices(texts):
                ids, count = v.encode(texts[a:b])
                offsets, ids = np.append(0, np.cumsum(count)), pa.array(ids)
                out = {"_row": batch.column("_row").slice(a, b - a), "ids": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), ids)}
                yield pa.record_batch(out | ({"decoded": _joined(v, offsets, ids)} if decoded else {}))

    return run


def _decode(path: str, ids_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary.at(path)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                rows = batch.column("_row").slice(a, 256)
                lists = rows.field(ids_col)
                yield pa.record_batch({"_row": rows, "decoded": _joined(v, np.asarray(lists.offsets) - lists.offsets[0].as_py(), lists.flatten())})

    return run


def _mapped(df: DataFrame, run, **new: T.DataType) -> DataFrame:
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"))
    return unpacked(rows.mapInArrow(run, T.StructType([rows.schema["_row"], *(T.StructField(n, t) for n, t in new.items())])), *new)


def encode(docs: DataFrame, path: str, text_col: str = "text", decoded: bool = False) -> DataFrame:
    """``docs`` with ids (array<int>): the token ids of every whole text, without added special tokens.

    ``decoded``: also what ``decode`` makes of the ids, by the same worker, so that only one has to hold the vocabulary."""
    return _mapped(docs, _encode(path, text_col, decoded), ids=T.ArrayType(T.IntegerType()), **({"decoded": T.StringType()} if decoded else {}))


def decode(rows: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``rows`` with decoded (string): tokens joined by a space, as a vocabulary file without a decoder asks for."""
    return _mapped(rows, _decode(path, ids_col), decoded=T.StringType())
