"""Packing of documents into sequences: best-fit decreasing over a segment tree.

A document's tokens (and an end id) are cut into pieces only when longer than a sequence.
Pieces are dealt by hash to packers of about ``PER_PACKER`` documents each, so that no task
grows with the input; each packer takes its pieces longest first and finds the tightest open
bin by a descent in a segment tree over remaining capacities, in logarithmic time. What
separate packers lose is at most one badly filled sequence each.

Defined cases: null text counts as empty (one piece with the end id); repeated rows are packed
one by one; an empty table gives an empty result; extra columns play no part.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import small_batches
from .bpe import byte_chars

LENGTH, END = 4096, 1
PER_PACKER = 20_000
#: Words kept between batches, and characters of the longest that is kept.
CACHE, LONGEST = 300_000, 64


class WordTokens:
    """Ids as the tokenizers library gives them, as little-endian 32-bit bytes.

    White space ends every word of this vocabulary, so the library encodes each distinct run of
    other characters once; texts with characters outside Latin letters and general punctuation,
    or with something like an added token, go to it whole.
    """

    ODD = re.compile("[^\t-\r\x20-\u024f\u2010-\u2027]|<\\|")

    MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'"

    def __init__(self, path: str):
        # The executor's cores are taken by its tasks.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.model, self.chars = self.lib.model, byte_chars()
        self.cache: dict[str, bytes] = {}

    def _raw(self, ids: list[int]) -> bytes:
        raw = array("I", ids)
        if sys.byteorder == "big":
            raw.byteswap()
        return raw.tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.cache) > CACHE:
            self.cache.clear()
        split = [None if t is not None and self.ODD.search(t) else (t or "").lower().split() for t in texts]
        new = set().union(*(ws for ws in split if ws)).difference(self.cache)
        # Letters with marks after them are the letters' ids and then the marks' ids.
        cores = {w: w.rstrip(self.MARKS) for w in new}
        cores = {w: c for w, c in cores.items() if len(c) < len(w) and c.isalpha()}
        alone = {w for w in new.difference(cores).union(cores.values()) if w.isalpha()}.difference(self.cache)
        for w in alone:  # one word for the vocabulary's model, without normaliser and splitter
            self.cache[w] = self._raw([t.id for t in self.model.tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(self.chars))])
        rest = list({w[len(c):] for w, c in cores.items()}.union(w for w in new if w not in cores).difference(self.cache))
        for w, e in zip(rest, self.lib.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self.cache[w] = self._raw(e.ids)
        for w, c in cores.items():
            self.cache[w] = self.cache[c] + self.cache[w[len(c):]]
        got = self.cache.__getitem__
        out = [self._raw(self.lib.encode(t, add_special_tokens=False).ids) if ws is None else b"".join(map(got, ws)) for t, ws in zip(texts, split, strict=True)]
        for w in [w for w in new.union(cores.values(), rest) if len(w) > LONGEST]:
            self.cache.pop(w, None)
        return out


_LOADED: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """One instance for each Python worker and vocabulary."""
    if path not in _LOADED:
        _LOADED[path] = WordTokens(path)
    return _LOADED[path]


class BestFit:
    """Open bins by remaining capacity, in a segment tree: counts of bins over capacities 0..size."""

    def __init__(self, size: int):
        self.size = size
        self.base = 1 << (size + 1 - 1).bit_length()
        self.tree = [0] * (2 * self.base)
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, capacity: int, n: int) -> None:
        i = self.base + capacity
        while i:
            self.tree[i] += n
            i >>= 1

    def put(self, capacity: int, b: int) -> None:
        self.bins[capacity].append(b)
        self._add(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, bin) of the open bin with the least capacity >= need, or None."""
        i = self.base + need
        if not self.tree[i]:
            while i > 1 and (i & 1 or not self.tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.base:
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        capacity = i - self.base
        self._add(capacity, -1)
        return capacity, self.bins[capacity].pop()


def best_fit_decreasing(lengths: list[int], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; bins are numbered from 0."""
    bins = np.zeros(len(lengths), np.int64)
    offsets = np.zeros(len(lengths), np.int64)
    tree, made = BestFit(size), 0
    for i in np.argsort(-np.asarray(lengths, np.int64), kind="stable").tolist():
        n = lengths[i]
        got = tree.take(n)
        if got is None:
            got = size, made
            made += 1
        bins[i], offsets[i] = got[1], size - got[0]
        if got[0] > n:
            tree.put(got[0] - n, got[1])
    return bins, offsets


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32."""
    small_batches(docs.sparkSession)
    tail = np.array([end], "<u4").tobytes()

    def run(batches):
        words = word_tokens(path)
        for pdf in batches:
            rows = []
            for k in range(0, len(pdf), 250):
                part = pdf.iloc[k:k + 250]
                for d, raw in zip(part.doc_id, words.encode(part.text.tolist()), strict=True):
                    raw += tail
                    for p, at in enumerate(range(0, len(raw), 4 * length)):
                        cut = raw[at:at + 4 * length]
                        rows.append((d, p, at // 4, len(cut) // 4, zlib.crc32(cut)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, per_packer: int = PER_PACKER) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    packers = max(1, ceil(docs.count() / per_packer))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = best_fit_decreasing(pdf.length.tolist(), length)
        return pdf.assign(sequence_id=pdf["__rc_packer"].astype("int64") * (1 << 40) + bins, offset=offsets).drop(columns="__rc_packer")

    dealt = pieces(docs, path, length, end).withColumn("__rc_packer", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(packers)).cast("int"))
    return dealt.repartition(packers, "__rc_packer").groupBy("__rc_packer").applyInPandas(
        fit, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
