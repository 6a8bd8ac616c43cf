"""Benchmark decontamination by an FM-index a shard of the training texts.

The words of a shard's documents, in order, are one sequence of symbols. Its Burrows-Wheeler
transform stands in a wavelet tree (levels as a matrix, ranks by counted 64-bit words). The
windows of the benchmark items are searched backwards, all at once; each step maps a range of
suffixes by two ranks. Occurrences are located by walking to the next sampled suffix position, and
the words that they cover merge into removal spans.

A symbol is a word of the benchmark; every other word, and the end of a document, is a 0 that
equals nothing, itself included, so no match crosses it. Longer sequences than ``SHARD`` words are
cut into shards that overlap by a window less a word, so a text of any length is searched whole in
bounded memory. Shards are made of the rows of a partition as they come: documents are not
shuffled. Items travel to the tasks in blocks of at most ``BLOCK`` bytes of text (of one item, if
that is larger), each in a pass of its own, so the benchmark may be of any size.

Words are compared by 64-bit hashes of their letters, benchmark against corpus only.

Defined cases: null and empty texts have no words; an item of fewer words than a window is a
window itself, one without words plays no part; items with equal ids count once, a null id counts
as the empty one; equal rows of docs give equal rows; an empty benchmark hits nothing; an empty
table gives an empty result; columns but doc_id and text play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import small_batches
from .words import ALNUM, word_hashes

WINDOW = 10
#: Words in a shard, bytes of item texts in a block, distance of sampled positions.
SHARD, BLOCK, SAMPLE = 1 << 19, 4 << 20, 16


def suffix_order(sym: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of sym in order. The last symbol must be 0; zeros differ from each
    other and go by place. Prefix doubling, which only sorts what is still tied."""
    n, zeros = len(sym), sym == 0
    first = np.where(zeros, np.cumsum(zeros) - 1, int(zeros.sum()) + sym).astype(np.int64)
    bits = int(first.max() + 1).bit_length()
    h = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for j in range(h):
        key <<= bits
        key[:max(0, n - j)] |= first[j:]
    order = np.argsort(key)
    slots = np.arange(n)
    rank = np.empty(n, np.int64)
    part, sorted_key = order, key[order]
    while True:
        new = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
        head = np.maximum.accumulate(np.where(new, slots, 0))
        rank[part] = head
        tied = ~(new & np.r_[new[1:], True])
        slots, part = slots[tied], part[tied]
        if not len(part):
            return order
        key = rank[part] << 32 | rank[np.minimum(part + h, n - 1)]
        turn = np.argsort(key)
        part, sorted_key = part[turn], key[turn]
        order[slots] = part
        h *= 2


class Bits:
    """A bit sequence with ranks."""

    def __init__(self, bit: np.ndarray):
        packed = np.packbits(bit, bitorder="little")
        self.words = np.zeros(len(bit) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[:len(packed)] = packed
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word, inside = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << inside) - np.uint64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class WaveletTree:
    """Ranks of any symbol below 2 ** levels, one bit sequence a level."""

    def __init__(self, sym: np.ndarray, sigma: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in reversed(range(max(1, (sigma - 1).bit_length()))):
            bit = (sym >> shift & 1).astype(bool)
            self.levels.append((shift, Bits(bit), int(len(bit) - bit.sum())))
            sym = np.concatenate((sym[~bit], sym[bit]))
        self.start = self._down(np.arange(sigma), np.zeros(sigma, np.int64))

    def _down(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where(c >> shift & 1, zeros + ones, at - ones)
        return at

    def rank(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each c stands before each place."""
        return self._down(c, at) - self.start[c]

    def symbol_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and how often it stands before."""
        c = np.zeros(len(at), np.int64)
        for _, bits, zeros in self.levels:
            bit, ones = bits.get(at), bits.rank(at)
            at = np.where(bit, zeros + ones, at - ones)
            c = c << 1 | bit
        return c, at - self.start[c]


class FMIndex:
    """Index of symbols in [0, sigma), the last being 0; zeros match nothing."""

    def __init__(self, sym: np.ndarray, sigma: int, sample: int = SAMPLE):
        order = suffix_order(sym)
        bwt = sym[order - 1]
        self.tree = WaveletTree(bwt, sigma)
        self.less = np.concatenate(([0], np.cumsum(np.bincount(sym, minlength=sigma))))
        sampled = (order % sample == 0) | (bwt == 0)  # nobody walks over a 0
        self.sampled, self.places = Bits(sampled), order[sampled]

    def ranges(self, flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of the phrases flat[start:start + length]: those found, with the range
        of the suffixes that begin with them."""
        live = np.arange(len(start))
        c = flat[start + length - 1]
        lo, hi = self.less[c], self.less[c + 1]
        out = []
        for step in range(1, int(length.max(initial=0)) + 1):
            found = lo < hi
            live, lo, hi = live[found], lo[found], hi[found]
            done = length[live] == step
            out.append((live[done], lo[done], hi[done]))
            live, lo, hi = live[~done], lo[~done], hi[~done]
            c = flat[start[live] + length[live] - 1 - step]
            both = self.tree.rank(np.concatenate((c, c)), np.concatenate((lo, hi)))
            lo, hi = self.less[c] + both[:len(c)], self.less[c] + both[len(c):]
        return tuple(np.concatenate(x) if out else np.empty(0, np.int64) for x in (zip(*out, strict=True) if out else ((), (), ())))

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Places of the suffixes at these rows."""
        place, todo, walked = np.empty(len(row), np.int64), np.arange(len(row)), 0
        row = row.copy()
        while len(todo):
            here = self.sampled.get(row)
            place[todo[here]] = self.places[self.sampled.rank(row[here])] + walked
            todo, row = todo[~here], row[~here]
            c, before = self.tree.symbol_and_rank(row)
            row = self.less[c] + before
            walked += 1
        return place


class Phrases:
    """The windows of a block of items as symbols: flat, their starts and lengths, and the items of each."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int = WINDOW):
        hashes = [h for _, h in sorted(word_hashes(texts, ALNUM), key=lambda x: x[0])]
        every = np.concatenate([*hashes, np.empty(0, np.uint64)])
        self.known = np.unique(every)
        self.flat = np.searchsorted(self.known, every) + 1
        start, length, item, at = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
        for k, h in enumerate(hashes):
            n = max(1, len(h) - window + 1) if len(h) else 0
            start.append(at + np.arange(n))
            length.append(np.full(n, min(window, len(h))))
            item.append(np.full(n, k))
            at += len(h)
        start, length, item = map(np.concatenate, (start, length, item))
        wide = np.pad(self.flat, (0, window))[start[:, None] + np.arange(window)] * (np.arange(window) < length[:, None])
        _, first, which = np.unique(wide, axis=0, return_index=True, return_inverse=True)
        self.start, self.length = start[first], length[first]
        pairs = np.unique(np.stack((which.ravel(), item)), axis=1)
        self.items, self.bounds = pairs[1], np.searchsorted(pairs[0], np.arange(len(first) + 1))
        self.ids = np.array(ids, object)

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, at + 1, 0)

    def occurrences(self, sym: np.ndarray, shard: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in sym and the phrases that stand there."""
        kept = np.flatnonzero((sym != 0) | np.r_[True, sym[:-1] != 0])  # a run of zeros parts like a single one
        places, phrases = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        over = int(self.length.max(initial=1)) - 1
        for at in range(0, len(kept), shard):
            part = kept[at:at + shard + over]
            if len(self.start) and sym[part].any():
                index = FMIndex(np.append(sym[part], 0), len(self.known) + 1)
                found, lo, hi = index.ranges(self.flat, self.start, self.length)
                n = hi - lo
                rows = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                places.append(part[index.locate(rows)])
                phrases.append(np.repeat(found, n))
        return np.concatenate(places), np.concatenate(phrases)


def merged(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unions of closed intervals that overlap or touch; first must ascend."""
    reach = np.maximum.accumulate(last)
    new = np.r_[True, first[1:] > reach[:-1] + 1]
    return first[new], reach[np.r_[new[1:], True]]


def word_bounds(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points at which the words of a text begin and end."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    inside = ALNUM[raw] != 0
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return points[edge[0::2]], points[edge[1::2]]


def search_texts(texts: list[str | None], phrases: Phrases, shard: int = SHARD) -> Iterator[tuple[int, int, list, list]]:
    """(index, words, spans, item ids) of each text; a span is (first word, last word, first code
    point, code point behind the last)."""
    group: list[tuple[int, np.ndarray]] = []

    def flush():
        if not group:
            return
        starts = np.cumsum([0] + [len(s) + 1 for _, s in group])
        place, phrase = phrases.occurrences(np.concatenate([np.append(s, 0) for _, s in group]), shard)
        turn = np.argsort(place, kind="stable")
        place, phrase = place[turn], phrase[turn]
        cut = np.searchsorted(place, starts)
        for k, (i, s) in enumerate(group):
            p, w = place[cut[k]:cut[k + 1]] - starts[k], phrase[cut[k]:cut[k + 1]]
            if not len(p):
                yield i, len(s), [], []
                continue
            first, last = merged(p, p + phrases.length[w] - 1)
            begin, end = word_bounds(texts[i])
            w = np.unique(w)
            items = np.unique(np.concatenate([phrases.items[phrases.bounds[x]:phrases.bounds[x + 1]] for x in w]))
            yield i, len(s), list(zip(first.tolist(), last.tolist(), begin[first].tolist(), end[last].tolist(), strict=True)), sorted(set(phrases.ids[items]))

    held = 0
    for i, h in word_hashes(texts, ALNUM):
        group.append((i, phrases.symbols(h)))
        held += len(h) + 1
        if held >= shard:
            yield from flush()
            group, held = [], 0
    yield from flush()


FOUND = "n_words long, spans array<struct<first:long,last:long,begin:long,end:long>>, items array<string>"


def blocks_of(items: DataFrame, size: int = BLOCK) -> list[DataFrame]:
    """The rows of items by blocks of about size bytes of text."""
    held = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-held // size))
    kept = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").filter("text IS NOT NULL")
    return [kept.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) for b in range(n)]


def leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, spans (merged; words and code points), items (ids,
    sorted, whose windows occur), text_key (two hashes of the text, with doc_id the same for equal rows)."""
    small_batches(docs.sparkSession)
    base = docs.select("doc_id", F.struct(F.xxhash64("text").alias("a"), F.xxhash64("text", F.lit(1)).alias("b")).alias("text_key"), "text")
    passes = []
    for b, part in enumerate(blocks_of(items, block)):
        rows = part.collect()  # at most a block
        phrases = Phrases([r["item_id"] for r in rows], [r["text"] for r in rows], window)

        def search(batches: Iterator[pd.DataFrame], phrases=phrases, every=b == 0) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                texts = pdf.text.tolist()
                got = [x for x in search_texts(texts, phrases, shard) if every or x[2]]
                at = [x[0] for x in got]
                yield pd.DataFrame({"doc_id": pdf.doc_id.iloc[at].array, "text_key": pdf.text_key.iloc[at].array, "n_words": [x[1] for x in got], "spans": [x[2] for x in got], "items": [x[3] for x in got]})

        passes.append(base.mapInPandas(search, f"{base.drop('text').schema.simpleString()[7:-1]}, {FOUND}").withColumn("pass", F.lit(b)))
    # Equal rows say the same, so one of each pass is enough; the number of rows comes from pass 0.
    got = [F.first(F.when(F.col("pass") == b, F.struct("spans", "items")), ignorenulls=True).alias(f"p{b}") for b in range(len(passes))]
    one = reduce(DataFrame.unionByName, passes).groupBy("doc_id", "text_key").agg(F.sum((F.col("pass") == 0).cast("long")).alias("rows"), F.max("n_words").alias("n_words"), *got)
    each = F.array_compact(F.array(*[F.col(f"p{b}") for b in range(len(passes))]))
    spans, ids = F.flatten(each["spans"]), F.array_sort(F.array_distinct(F.flatten(each["items"])))
    one = one.select("doc_id", "text_key", "n_words", (_united(spans) if len(passes) > 1 else spans).alias("spans"), ids.alias("items"), F.explode(F.expr("sequence(1L, rows)")).alias("copy"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return one.select("doc_id", "n_words", hit.alias("n_hit"), "spans", "items", "text_key")


def _united(spans: Column) -> Column:
    """Spans of several passes merged."""
    def add(out, s):
        last = F.element_at(out, -1)
        joined = F.named_struct(F.lit("first"), last["first"], F.lit("last"), F.greatest(last["last"], s["last"]), F.lit("begin"), last["begin"], F.lit("end"), F.greatest(last["end"], s["end"]))
        meets = (F.size(out) > 0) & (s["first"] <= F.get(out, F.size(out) - 1)["last"] + 1)
        return F.when(meets, F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(joined))).otherwise(F.concat(out, F.array(s)))

    return F.aggregate(F.sort_array(spans), F.slice(spans, 1, 0), add)


def remove_leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the spans that stand in items; rows without a hit stay as they are."""
    found = leaks(docs, items, window).filter("n_hit > 0").select(F.col("doc_id").alias("__d"), F.col("text_key").alias("__k"), F.col("spans").alias("__spans")).dropDuplicates(["__d", "__k"])
    keyed = docs.withColumn("__key", F.struct(F.xxhash64("text").alias("a"), F.xxhash64("text", F.lit(1)).alias("b")))
    both = keyed.join(found, keyed["doc_id"].eqNullSafe(F.col("__d")) & (F.col("__key") == F.col("__k")), "left")
    ends = F.concat(F.array(F.lit(0).cast("long")), F.col("__spans.end"))
    begins = F.concat(F.col("__spans.begin"), F.array(F.length("text").cast("long")))
    rest = F.array_join(F.zip_with(ends, begins, lambda a, b: F.substr(F.col("text"), (a + 1).cast("int"), (b - a).cast("int"))), "")
    return both.select(*[F.when(F.col("__spans").isNull(), F.col("text")).otherwise(rest).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query: what leaks() found, item ids as a hash."""
    return found.select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
