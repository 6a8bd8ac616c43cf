"""Byte-level BPE, encoding and decoding, by batched numpy merge rounds.

The distinct words of a batch lie in one flat array of symbols. Each round looks up the keys
of all neighbouring pairs in the sorted array of mergeable pairs (binary search), takes every
word's lowest rank and merges that pair wherever it stands in the word, left to right; words
without a mergeable pair leave. A word of over ``LONG`` bytes would hold up rounds by the thousand;
its pairs wait in a heap by rank instead. Words met before come from a bounded cache.

Defined cases: null text counts as empty (no ids, empty decoded text); strings of added tokens
inside a text become those tokens, as the tokenizers library does by default; texts of any
length are encoded whole; repeated rows are encoded alike; an empty table gives an empty result;
extra columns play no part; where a pair of one rank stands in several places, the left one goes
first.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import small_batches

#: Chunks kept between batches; beyond it the cache starts anew. Characters of the longest that is
#: kept; bytes from which on a word is merged alone.
CACHE, LONGEST, LONG = 600_000, 64, 1_000
#: The public pattern of byte-level BPE, with white space as Unicode defines it.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Coarser cuts that never part a word: the pattern above finds the same words in each.
CHUNKS = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Characters that only one of the two notions of white space holds.
ODD = re.compile("[\x1c-\x1f]")
NONE = np.int64(1 << 40)


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class ByteBPE:
    """A byte-level BPE vocabulary read from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        chars = byte_chars()
        back = {c: b for b, c in chars.items()}
        self.byte_ids = np.array([vocab[chars[b]] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token_bytes: dict[int, bytes] = {i: bytes(back[c] for c in s) for s, i in vocab.items() if all(c in back for c in s)}
        self.token_bytes |= {i: s.encode() for s, i in self.special.items()}
        self.pattern = regex.compile(WORDS)
        self.split = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.cache: dict[str, tuple[int, str, bytes]] = {}
        self.table: dict[int, tuple[int, int]] | None = None

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(words)
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self.merge_long(w)
        lens = np.array([len(w) if len(w) <= LONG else 0 for w in words], np.int64)
        alive = np.arange(len(words))
        sym = self.byte_ids[np.frombuffer(b"".join(w for w in words if len(w) <= LONG), np.uint8)]
        alive, lens = alive[lens > 0], lens[lens > 0]
        while len(alive):
            starts = np.cumsum(lens) - lens
            last = np.zeros(len(sym), bool)
            last[starts + lens - 1] = True
            rank = np.full(len(sym), NONE)
            at = np.full(len(sym), -1)
            inner = np.flatnonzero(~last)
            keys = sym[inner] << 32 | sym[inner + 1]
            found = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[found] == keys
            rank[inner[hit]] = self.ranks[found[hit]]
            at[inner[hit]] = found[hit]
            low = np.minimum.reduceat(rank, starts)
            over = low == NONE
            if over.any():
                for k in np.flatnonzero(over):
                    out[alive[k]] = sym[starts[k]:starts[k] + lens[k]]
                stay = np.repeat(~over, lens)
                sym, rank, at, last = sym[stay], rank[stay], at[stay], last[stay]
                alive, lens, low = alive[~over], lens[~over], low[~over]
                if not len(alive):
                    break
                starts = np.cumsum(lens) - lens
            pick = np.flatnonzero(rank == np.repeat(low, lens))
            # In a row of overlapping pairs (x x x) every second one merges.
            run = np.concatenate(([True], (np.diff(pick) != 1)))
            offset = np.arange(len(pick)) - np.flatnonzero(run)[np.cumsum(run) - 1]
            pick = pick[offset % 2 == 0]
            sym[pick] = self.made[at[pick]]
            gone = np.zeros(len(sym), bool)
            gone[pick + 1] = True
            lens = lens - np.add.reduceat(gone, starts).astype(np.int64)
            sym = sym[~gone]
        return out

    def merge_long(self, word: bytes) -> np.ndarray:
        """The ids of one long word: pairs by rank, then place, from a heap; symbols are linked."""
        if self.table is None:
            self.table = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made.tolist(), strict=True), strict=True))
        sym = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i):
            j = after[i]
            if j < len(sym) and (got := self.table.get(sym[i] << 32 | sym[j])) is not None:
                heapq.heappush(heap, (got[0], i, sym[i] << 32 | sym[j], got[1]))

        for i in range(len(sym) - 1):
            offer(i)
        while heap:
            _, i, key, made = heapq.heappop(heap)
            j = after[i]
            if sym[i] < 0 or j >= len(sym) or sym[i] << 32 | sym[j] != key:
                continue  # one of the two has been merged since
            sym[i], sym[j], after[i] = made, -1, after[j]
            if after[j] < len(sym):
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return np.array([s for s in sym if s >= 0], np.int64)

    def learn(self, chunks: set[str]) -> dict[str, tuple[int, str, bytes]]:
        """Per chunk: number of ids, ids joined by commas, decoded bytes."""
        made: dict[str, tuple[int, str, bytes]] = {}
        parts = {c: self.pattern.findall(c) for c in chunks}
        known: dict[str, tuple[int, str, bytes]] = {}
        todo = list({w for ws in parts.values() for w in ws})
        for k in range(0, len(todo), 20_000):
            part = todo[k:k + 20_000]
            for w, ids in zip(part, self.merge([w.encode("utf-8", "surrogatepass") for w in part]), strict=True):
                ids = ids.tolist()
                known[w] = len(ids), ",".join(map(str, ids)), b"".join([self.token_bytes[i] for i in ids])
        for c, ws in parts.items():
            got = [known[w] for w in ws]
            made[c] = got[0] if len(got) == 1 else (sum([g[0] for g in got]), ",".join([g[1] for g in got]), b"".join([g[2] for g in got]))
        return made

    def chunks(self, text: str | None) -> list[str]:
        """Pieces that are encoded apart: runs of other than white space with a space before,
        white space, and the strings of added tokens."""
        if not text:
            return []
        if self.split is None or not any(s in text for s in self.special):
            return CHUNKS.findall(text) if not ODD.search(text) else self.pattern.findall(text)
        return [w for i, part in enumerate(self.split.split(text)) for w in ([part] if i % 2 else self.chunks(part))]

    def look(self, texts: list[str | None]):
        """Per text: the cache entries of its chunks."""
        if len(self.cache) > CACHE:
            self.cache.clear()
        split = [self.chunks(t) for t in texts]
        new = self.learn({c for cs in split for c in cs}.difference(self.cache, self.special))
        self.cache |= {c: got for c, got in new.items() if len(c) <= LONGEST}
        new = {c: got for c, got in new.items() if len(c) > LONGEST}
        for s, i in self.special.items():
            self.cache[s] = 1, str(i), self.token_bytes[i]
        get = lambda c: self.cache[c] if c not in new else new[c]
        get = get if new else self.cache.__getitem__
        for cs in split:
            yield list(map(get, cs))

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for _, ids, _ in next(self.look([text])) for i in ids.split(",")]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.token_bytes[i] for i in ids).decode("utf-8", "replace")


_LOADED: dict[str, ByteBPE] = {}


def byte_bpe(path: str) -> ByteBPE:
    """One instance for each Python worker and vocabulary."""
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]


def digest(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256 (of encoding and decoding back)."""
    small_batches(docs.sparkSession)

    def run(batches):
        bpe = byte_bpe(path)
        for pdf in batches:
            n, ids, text = [], [], []
            # Words new to the cache are merged for a few hundred texts at a time.
            for k in range(0, len(pdf), 250):
                for got in bpe.look(pdf.text.iloc[k:k + 250].tolist()):
                    n.append(sum([g[0] for g in got]))
                    ids.append(hashlib.sha256(",".join([g[1] for g in got]).encode()).hexdigest())
                    text.append(hashlib.sha256(b"".join([g[2] for g in got]).decode("utf-8", "replace").encode()).hexdigest())
            yield pd.DataFrame({"doc_id": pdf.doc_id, "n_tokens": n, "ids_sha256": ids, "decoded_sha256": text})

    return docs.select("doc_id", F.col("text")).mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
