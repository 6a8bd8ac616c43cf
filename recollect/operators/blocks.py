"""Similar sets by blocks: who shares enough without a pair being dealt out.

Records lie in blocks of some thousand sets, written once; sets of one key and of like sizes come
together before, so that blocks of different keys or of sizes too different never meet. Pairs of
blocks meet in tasks that read the blocks where they lie, so neither tokens nor candidates are
shuffled; what leaves a task are similar pairs only. Within two blocks a pair must share a token of the prefixes that its
similarity needs (rare tokens first), at places that leave room for the overlap; then a bound from
bits of the sets must allow it; then the sets are compared. For low similarities shared tokens are
counted for all pairs of two blocks instead.

What is only counted or connected never leaves a task as pairs: ``then`` is put on the pairs where
they arise, and of links a task gives a forest.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.operators.store import cut, drop, for_now, set_checkpoints

#: Sets and tokens of a block at most, blocks sorted together, blocks of a side of a task, counters of
#: the tokens' order and bits of a set, few first (powers of two), hits and pairs handled at once.
SETS, TOKENS, TOGETHER, SIDE, COUNTERS, BITS, HITS, PAIRS = 2_048, 500_000, 2, 3, 1 << 16, (1_024, 8_192), 500_000, 25_000
#: Below this similarity prefixes and bits leave too many pairs: shared tokens of all pairs are counted.
#: Tokens of over one in OFTEN of a block's pairs are counted by a matrix product, GRID hits at once by place.
COUNTED, OFTEN, GRID = 0.45, 200, 2_000_000
#: Similarities that the best pairs are looked for at first.
LEVELS = (0.9, 0.7, 0.5)


def token_sets(df: DataFrame, tokens: Column, by: list[str] | None = None, text: Column | None = None, value: Column | None = None) -> DataFrame:
    """id, t (distinct token hashes; of different by never equal), text, value. Records without tokens go
    when blocks are packed: a filter here would make all tokens twice."""
    for c in by or []:
        df = df.filter(F.col(c).isNotNull())
    t = F.array_distinct(F.transform(tokens, lambda w: F.xxhash64(w, *(by or []))))
    sets = df.select(F.col("id").cast("long").alias("id"), t.alias("t"), (F.lit(None).cast("string") if text is None else text).alias("text"), F.xxhash64(F.lit(0), *(by or [])).alias("key"))
    if value is None:
        return sets.withColumn("value", F.lit(0.0))
    # Values come to the sets, so that where they stand in a joined table no text is shuffled for them.
    return sets.join(df.select(F.col("id").cast("long").alias("id"), value.cast("double").alias("value")), "id")


@contextmanager
def batches_of(spark, rows: int):
    """Rows travel to Python in batches of so many."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def token_order(rows: DataFrame) -> np.ndarray:
    """The place of each counter by how many tokens fall on it, over all rows, the emptiest first. Any
    order gives right pairs; only the number of counters is fixed."""
    def count(batches):
        total = np.zeros(COUNTERS, np.int64)
        for b in batches:
            t = b.column(0).flatten().to_numpy(zero_copy_only=False)
            total += np.bincount(t & (COUNTERS - 1), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["c", "n"])

    found = rows.select("t").mapInArrow(count, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(COUNTERS, np.int64)
    total[found.c.to_numpy(np.int64)] = found.n.to_numpy(np.int64)
    place = np.empty(COUNTERS, np.int64)
    place[np.argsort(total, kind="stable")] = np.arange(COUNTERS)
    return place


def set_bits(tokens: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """width bits of each set, one for each token at most."""
    out, at, some = np.empty((len(sizes), width // 64), np.uint64), 0, 512
    for s in range(0, len(sizes), some):
        few = sizes[s:s + some]
        bits = np.zeros((len(few), width), bool)
        bits[np.repeat(np.arange(len(few)), few), (tokens[at:at + few.sum()] >> 20) & (width - 1)] = True
        out[s:s + some] = np.packbits(bits, axis=1).view(np.uint64)
        at += int(few.sum())
    return out


def packed(rows: list[tuple], place: np.ndarray):
    """Blocks of rows (key, n, id, tokens, text, value): equal ones once, with their copies."""
    first: dict[tuple, int] = {}
    kept, copies = [], []
    for key, n, i, t, text, value in sorted(rows, key=lambda r: r[:3]):
        t = np.sort(t)
        same = (t.tobytes(), text, value)
        if same in first:
            copies.append((first[same], i))
        else:
            first[same] = i
            kept.append((n, i, t, text, value, key))
    at = 0
    of: dict[int, list[int]] = {}
    for r, i in copies:
        of.setdefault(r, []).append(i)
    while at < len(kept):
        end, total = at, 0
        while end < len(kept) and end - at < SETS and (end == at or total + kept[end][0] <= TOKENS and (kept[end][5] == kept[end - 1][5] or end - at < SETS // 8)):
            total += kept[end][0]
            end += 1
        few = kept[at:end]
        at = end
        sizes = np.array([r[0] for r in few], np.int32)
        tokens = np.concatenate([r[2] for r in few])
        row = np.repeat(np.arange(len(few)), sizes)
        tokens = tokens[np.lexsort((tokens, place[tokens & (COUNTERS - 1)], row))]
        mine = np.array([(r[1], c) for r in few for c in of.get(r[1], ())], np.int64).reshape(-1, 2)
        texts = [(r[3] or "").encode("utf-8", "surrogatepass") for r in few]
        yield {"texts": b"".join(texts), "lengths": np.array([len(x) for x in texts], np.int64).tobytes(), "ids": np.array([r[1] for r in few], np.int64).tobytes(), "sizes": sizes.tobytes(), "tokens": tokens.tobytes(), "copies": mine.tobytes(), "values": np.array([np.nan if r[4] is None else r[4] for r in few], np.float64).tobytes(), "low": int(sizes.min()), "high": int(sizes.max()), "first": few[0][5], "last": few[-1][5]}


def together(sets: DataFrame) -> DataFrame:
    """Written token_sets by ranges of key and size, copies side by side. Any order gives right pairs."""
    by = ["key", F.size("t"), F.xxhash64("t")]
    return sets.repartitionByRange(*by).sortWithinPartitions(*by)


def set_blocks(rows: DataFrame, ordered: bool, texts: bool) -> DataFrame:
    """token_sets in blocks, written, with a number each. ordered: prefixes will be needed, so tokens get
    their order by how rare they are. texts: rows carry texts, which are not dealt out."""
    set_checkpoints(rows.sparkSession)
    place = lambda sets: token_order(sets) if ordered else np.arange(COUNTERS)
    with batches_of(rows.sparkSession, 500):
        if texts:
            return _set_blocks(rows, place(rows))
        with for_now(rows) as sets:
            return _set_blocks(together(sets), place(sets))


def _set_blocks(rows: DataFrame, place: np.ndarray) -> DataFrame:
    def run(batches):
        held: list[tuple] = []
        total = 0
        for b in batches:
            lists = b.column(1)
            flat, off = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()).cumsum()
            for i, start, end, text, key, value in zip(b.column(0).to_pylist(), np.append(0, off[:-1]).tolist(), off.tolist(), *(b.column(c).to_pylist() for c in (2, 3, 4)), strict=True):
                if start == end:
                    continue
                held.append((key, end - start, i, flat[start:end].copy(), text, value))
                total += end - start
                if len(held) >= TOGETHER * SETS or total >= TOGETHER * TOKENS:
                    yield from batch(held)
                    held, total = [], 0
        if held:
            yield from batch(held)

    def batch(held):
        for x in packed(held, place):
            yield pa.RecordBatch.from_arrays([pa.array([x[c]], kind) for c, kind in kinds], names)

    kinds = [("ids", pa.binary()), ("sizes", pa.binary()), ("tokens", pa.binary()), ("copies", pa.binary()), ("texts", pa.binary()), ("lengths", pa.binary()), ("values", pa.binary()), ("low", pa.int32()), ("high", pa.int32()), ("first", pa.int64()), ("last", pa.int64())]
    names = [k for k, _ in kinds]
    made = rows.mapInArrow(run, "ids binary, sizes binary, tokens binary, copies binary, texts binary, lengths binary, values binary, low int, high int, first long, last long")
    return cut(made.withColumn("no", F.monotonically_increasing_id()))


def runs(tokens: np.ndarray, mask: np.ndarray, row: np.ndarray, pos: np.ndarray, size: np.ndarray):
    """Entries under a mask, sorted by token and size of the set: distinct tokens, where each starts,
    rows, sizes, tokens from the entry on."""
    at = np.flatnonzero(mask)
    at = at[np.lexsort((size[at], tokens[at]))]
    t = tokens[at]
    start = np.flatnonzero(np.append(True, t[1:] != t[:-1])) if len(t) else np.empty(0, np.int64)
    return t[start], np.append(start, len(t)), row[at], size[at], size[at] - pos[at]


class Block:
    """A block as arrays, with its prefixes for one similarity."""

    def __init__(self, ids, sizes, tokens, copies, texts, lengths, values, least: float):
        self.ids, self.n, self.t = np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int32), np.frombuffer(tokens, np.int64)
        self.copies, self.texts = np.frombuffer(copies, np.int64).reshape(-1, 2), texts
        self.off = np.append(0, np.cumsum(self.n, dtype=np.int64))
        row = np.repeat(np.arange(len(self.n), dtype=np.int32), self.n)
        pos = (np.arange(len(self.t)) - self.off[row]).astype(np.int32)
        size = self.n[row]
        if least < COUNTED:
            self.every = runs(self.t, np.ones(len(self.t), bool), row, pos, size)
        else:
            self.ready(least, row, pos, size)
        self.ends, self.values = np.cumsum(np.frombuffer(lengths, np.int64)), np.frombuffer(values, np.float64)
        self.grams: dict[int, np.ndarray] = {}
        order = np.argsort(self.copies[:, 0], kind="stable")
        self.copy_of, self.copy = self.copies[order, 0], self.copies[order, 1]

    def ready(self, least: float, row, pos, size) -> None:
        self.bits = [set_bits(self.t, self.n, w) for w in BITS]
        # As the larger set of a pair, and as the smaller one.
        self.large = runs(self.t, pos <= size - np.ceil(size * least - 1e-9), row, pos, size)
        self.small = runs(self.t, pos <= size - np.ceil(size * (2 * least / (1 + least)) - 1e-9), row, pos, size)

    def trigrams(self, i: int) -> np.ndarray:
        if i not in self.grams:
            text = self.texts[self.ends[i - 1] if i else 0:self.ends[i]].decode("utf-8", "surrogatepass")
            c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            self.grams[i] = np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:]) if len(c) > 2 else np.empty(0, np.int64)
        return self.grams[i]

    def members(self, i: int) -> np.ndarray:
        s, e = np.searchsorted(self.copy_of, [self.ids[i], self.ids[i] + 1])
        return np.append(self.ids[i], self.copy[s:e])


def hits(small, large, least: float, ties: bool):
    """Rows and what is left of both sides, for entries of one token in sets that fit in size (the
    smaller one first; ties: also of equal size), some millions at a time."""
    tx, sx, rx, nx, lx = small
    ty, sy, ry, ny, ly = large
    if not len(tx) or not len(ty):
        return
    j = np.minimum(np.searchsorted(ty, tx), len(ty) - 1)
    run = np.repeat(np.where(ty[j] == tx, j, -1), np.diff(sx))
    line = np.flatnonzero(run >= 0)
    run, n = run[line], nx[line].astype(np.int64)
    # the sizes that fit are a stretch of the run
    key = np.repeat(np.arange(len(ty)) << 32, np.diff(sy)) + ny
    start = np.searchsorted(key, (run << 32) + n + (not ties), "left")
    count = np.searchsorted(key, (run << 32) + np.floor((n + 1e-9) / least).astype(np.int64), "right") - start
    some = count > 0
    line, start, count = line[some], start[some], count[some]
    ends = np.cumsum(count)
    s = 0
    while s < len(line):
        e = max(int(np.searchsorted(ends, (ends[s - 1] if s else 0) + HITS, "right")), s + 1)
        c = count[s:e]
        k = np.repeat(start[s:e] - np.append(0, np.cumsum(c)[:-1]), c) + np.arange(int(c.sum()))
        i = np.repeat(line[s:e], c)
        yield rx[i], ry[k], nx[i] + ny[k], np.minimum(lx[i], ly[k])
        s = e


def needed(both: np.ndarray, least: float) -> np.ndarray:
    """Tokens that two sets must share, by the sum of their sizes; not rounded up."""
    return both * (least / (1 + least)) - 1e-9


def only(entries, some: np.ndarray):
    """Entries of some rows."""
    t, start, row, size, left = entries
    ok = some[row]
    if ok.all():
        return entries
    end = np.cumsum(ok)[start[1:] - 1] if len(t) else np.empty(0, np.int64)
    count = np.diff(end, prepend=0)
    return t[count > 0], np.append(0, end[count > 0]), row[ok], size[ok], left[ok]


def candidates(x: Block, y: Block, least: float, within: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x and of y that may be similar, in order; of one block each pair once. within: pairs of
    masks of the rows that need to meet."""
    grid = np.zeros((len(x.n), len(y.n)), bool)
    for u, v in within or [(np.ones(len(x.n), bool), np.ones(len(y.n), bool))]:
        if not u.any() or not v.any():
            continue
        for i, j, both, left in hits(only(x.small, u), only(y.large, v), least, True):
            ok = left >= needed(both, least)
            grid[i[ok], j[ok]] = True
        for j, i, both, left in hits(only(y.small, v), only(x.large, u), least, False) if x is not y or within else ():
            ok = left >= needed(both, least)
            grid[i[ok], j[ok]] = True
    if x is y:
        grid = np.triu(grid | grid.T, 1)
    return np.divmod(np.flatnonzero(grid), len(y.n))


def shared(x: Block, y: Block) -> np.ndarray:
    """How many tokens each row of x shares with each of y."""
    (tx, sx, rx, *_), (ty, sy, ry, *_) = x.every, y.every
    j = np.minimum(np.searchsorted(ty, tx), len(ty) - 1)
    k = np.flatnonzero(ty[j] == tx)
    cx, cy = np.diff(sx)[k], np.diff(sy)[j[k]]
    many = cx * cy * OFTEN > len(x.n) * len(y.n)
    out = np.zeros((len(x.n), len(y.n)), np.float32)

    def entries(start, count):
        return np.repeat(start - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(int(count.sum()))

    often = np.flatnonzero(many)
    for s in range(0, len(often), 1_024):
        at = often[s:s + 1_024]
        m = []
        for start, count, row, n in ((sx[k[at]], cx[at], rx, len(x.n)), (sy[j[k[at]]], cy[at], ry, len(y.n))):
            m.append(np.zeros((n, len(at)), np.float32))
            m[-1][row[entries(start, count)], np.repeat(np.arange(len(at)), count)] = 1
        out += m[0] @ m[1].T
    few = np.flatnonzero(~many)
    line = entries(sx[k[few]], cx[few])
    start, count = np.repeat(sy[j[k[few]]], cx[few]), np.repeat(cy[few], cx[few])
    ends, s = np.cumsum(count), 0
    while s < len(line):
        e = max(int(np.searchsorted(ends, (ends[s - 1] if s else 0) + GRID, "right")), s + 1)
        at = np.repeat(rx[line[s:e]].astype(np.int64) * len(y.n), count[s:e]) + ry[entries(start[s:e], count[s:e])]
        out += np.bincount(at, minlength=out.size).reshape(out.shape)
        s = e
    return out


def counted(x: Block, y: Block, least: float):
    """Rows of x and of y that are similar, in order, with their similarity; of one block each pair once."""
    c = shared(x, y)
    ok = c >= needed(x.n[:, None] + y.n[None, :].astype(np.int64), least) if c.size else c > 0
    i, j = np.divmod(np.flatnonzero(np.triu(ok, 1) if x is y else ok), len(y.n))
    c = c[i, j].astype(np.int64)
    sim = c / (x.n[i] + y.n[j] - c)
    ok = sim >= least
    return i[ok], j[ok], sim[ok]


def joined(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels (the smallest node of each group) once the nodes u and v are linked."""
    while True:
        a, b = label[u], label[v]
        if (a == b).all():
            return label
        label = label.copy()
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


class Forest:
    """The rows of a task's blocks as nodes, with what is known to be connected."""

    def __init__(self):
        self.at: dict[int, int] = {}
        self.ids = self.label = self.known = np.empty(0, np.int64)
        self.first: dict[int, int] = {}

    def place(self, no: int, ids: np.ndarray, component: np.ndarray | None) -> int:
        """The first node of a block; rows of one component are connected."""
        if no not in self.at:
            s = self.at[no] = len(self.ids)
            new = np.arange(s, s + len(ids))
            if component is not None:
                some, k = np.unique(component, return_inverse=True)
                low = np.full(len(some), s + len(ids))
                np.minimum.at(low, k, new)
                new = np.array([self.first.setdefault(c, n) for c, n in zip(some.tolist(), low.tolist(), strict=True)])[k]
            self.ids, self.known = np.append(self.ids, ids), np.append(self.known, new)
            # What the component's first node has joined since holds for its new rows too.
            old = new < s
            self.label = np.append(self.label, new)
            self.label[s:][old] = self.label[new[old]]
        return self.at[no]

    def link(self, u: np.ndarray, v: np.ndarray) -> None:
        self.label = joined(self.label, u, v)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Links that make the groups of what was known, one less than each joins."""
        root = np.flatnonzero((self.known == np.arange(len(self.ids))) & (self.label != np.arange(len(self.ids))))
        return self.ids[self.label[root]], self.ids[root]


def overlaps(x: Block, y: Block, i: np.ndarray, j: np.ndarray, least: float):
    """Pairs of the rows i, j that are similar, with their similarity."""
    for bx, by in zip(x.bits, y.bits, strict=True):
        ok = np.empty(len(i), bool)
        for s in range(0, len(i), PAIRS):
            a, b = i[s:s + PAIRS], j[s:s + PAIRS]
            u, v = bx[a], by[b]
            most = np.minimum(x.n[a] - np.bitwise_count(u & ~v).sum(1, dtype=np.int32), y.n[b] - np.bitwise_count(v & ~u).sum(1, dtype=np.int32))
            ok[s:s + PAIRS] = most >= needed(x.n[a] + y.n[b], least)
        i, j = i[ok], j[ok]
    sim = np.empty(len(i))
    edge = np.append(np.flatnonzero(np.append(True, i[1:] != i[:-1])), len(i)) if len(i) else [0]
    for s, e in zip(edge[:-1], edge[1:], strict=True):
        mine = np.sort(x.t[x.off[i[s]]:x.off[i[s] + 1]])
        n = y.n[j[s:e]].astype(np.int64)
        start = np.append(0, np.cumsum(n)[:-1])
        other = y.t[np.repeat(y.off[j[s:e]] - start, n) + np.arange(int(n.sum()))]
        same = mine[np.minimum(np.searchsorted(mine, other), len(mine) - 1)] == other
        c = np.add.reduceat(same, start, dtype=np.int64)
        sim[s:e] = c / (len(mine) + n - c)
    ok = sim >= least
    return i[ok], j[ok], sim[ok]


def by_content(x: Block, y: Block, i: np.ndarray, j: np.ndarray, sim: np.ndarray) -> np.ndarray:
    """.6 words + .4 character trigrams."""
    out = np.empty(len(sim))
    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        g, h = x.trigrams(a), y.trigrams(b)
        c = len(np.intersect1d(g, h, assume_unique=True))
        union = len(g) + len(h) - c
        out[k] = 0.6 * sim[k] + 0.4 * (c / union if union else 0.0)
    y.grams = {}
    return out


COLS = ("ids", "sizes", "tokens", "copies", "texts", "lengths", "values")


def held_blocks(least: float):
    """A block by its number and columns; the last few are kept ready."""
    held: OrderedDict[int, Block] = OrderedDict()

    def block(no: int, cols) -> Block:
        if no not in held:
            held[no] = Block(*cols, least)
            while len(held) > SIDE + 1:
                held.popitem(last=False)
        held.move_to_end(no)
        return held[no]

    return block


def compared(p: Block, q: Block, i: np.ndarray, j: np.ndarray, least: float, content: float | None, sim: np.ndarray | None = None):
    """Of the rows i, j those that are similar, with their similarity. sim: that of tokens, if known."""
    if sim is None:
        i, j, sim = overlaps(p, q, i, j, least)
    if content is not None:
        sim = by_content(p, q, i, j, sim)
        ok = sim >= content - 1e-12
        i, j, sim = i[ok], j[ok], sim[ok]
    return i, j, sim


def read_blocks(blocks: DataFrame) -> DataFrame:
    """A task takes a few blocks of either side, each made ready once."""
    return blocks.coalesce(max(SIDE, -(-blocks.count() // SIDE)))


def once(x: str = "x", y: str = "y") -> Column:
    """Each pair of blocks once, dealt evenly over the tasks."""
    a, b = F.col(f"{x}_no"), F.col(f"{y}_no")
    return F.when((a + b) % 2 == 0, a <= b).otherwise(a > b)


def both_sides(blocks: DataFrame, cols: list[str]) -> list[DataFrame]:
    cols = ["no", "low", "high", "first", "last", *cols]
    return [blocks.select(*cols).toDF(*[f"{s}_{c}" for c in cols]) for s in "xy"]


def fitting(least: float) -> Column:
    """Blocks with sets of one key, of sizes that similar sets can have."""
    return (F.least("x_high", "y_high") >= F.greatest("x_low", "y_low") * least - 1e-9) & (F.col("x_first") <= F.col("y_last")) & (F.col("y_first") <= F.col("x_last"))


def similar_pairs(rows: DataFrame, least: float, content: float | None = None, apart: float | None = None, then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Pairs a < b of token_sets with Jaccard similarity >= least: a, b, sim, written. content: of those
    the pairs whose similarity by content reaches it. apart: of those the pairs whose values differ by
    so much, with that gap. then: what is made of the pairs and written in their place."""
    blocks = set_blocks(rows, least >= COUNTED, content is not None)
    out = block_pairs(blocks, least, content, apart, then)
    drop(blocks)
    return out


def block_pairs(blocks: DataFrame, least: float, content: float | None = None, apart: float | None = None, then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """similar_pairs of blocks, which stay."""
    x, y = both_sides(read_blocks(blocks), list(COLS))

    def pairs_of(p: Block, q: Block):
        i, j, sim = counted(p, q, least) if least < COUNTED else (*candidates(p, q, least), None)
        if apart is not None:
            ok = np.abs(p.values[i] - q.values[j]) >= apart
            i, j, sim = i[ok], j[ok], None if sim is None else sim[ok]
        i, j, sim = compared(p, q, i, j, least, content, sim)
        a, b, gap = p.ids[i], q.ids[j], np.abs(p.values[i] - q.values[j])
        several = np.isin(a, p.copy_of) | np.isin(b, q.copy_of)
        for k in np.flatnonzero(several).tolist():
            left, right = p.members(i[k]), q.members(j[k])
            step = max(1, HITS // len(right))
            for s in range(0, len(left), step):
                u = left[s:s + step]
                yield np.repeat(u, len(right)), np.tile(right, len(u)), np.full(len(u) * len(right), sim[k]), np.full(len(u) * len(right), gap[k])
        yield a[~several], b[~several], sim[~several], gap[~several]
        if p is q and (apart is None or apart <= 0):
            yield from equal(p)

    def equal(p: Block):
        for r in np.unique(p.copy_of).tolist():
            at = int(np.flatnonzero(p.ids == r)[0])
            sim = equal_sim(p, at, content)
            if sim is None or apart is not None and np.isnan(p.values[at]):
                continue
            m = p.members(at)
            for k in range(len(m) - 1):
                yield np.full(len(m) - k - 1, m[k]), m[k + 1:], np.full(len(m) - k - 1, sim), np.zeros(len(m) - k - 1)

    def run(batches):
        block = held_blocks(least)
        for pdf in batches:
            for k in range(len(pdf)):
                gathered, size = [], 0
                p, q = (block(int(pdf[f"{s}_no"].iloc[k]), [pdf[f"{s}_{c}"].iloc[k] for c in COLS]) for s in "xy")
                for part in pairs_of(p, q):
                    gathered.append(part)
                    size += len(part[0])
                    if size >= PAIRS:
                        yield frame(gathered)
                        gathered, size = [], 0
                if size:
                    yield frame(gathered)

    def frame(parts):
        a, b, sim, gap = (np.concatenate(c) for c in zip(*parts, strict=True))
        ok = a != b
        return pd.DataFrame({"a": np.minimum(a, b)[ok], "b": np.maximum(a, b)[ok], "sim": sim[ok]} | ({} if apart is None else {"gap": gap[ok]}))

    with batches_of(blocks.sparkSession, 1):  # a row holds two blocks
        found = x.hint("shuffle_replicate_nl").join(y, once() & fitting(least)).mapInPandas(run, "a long, b long, sim double" + ("" if apart is None else ", gap double"))
        return cut(found if then is None else then(found))


def best_pairs(rows: DataFrame, least: float, apart: float, span: float, top: int) -> DataFrame:
    """The ``top`` pairs of similar_pairs by score = sim * gap, ties to smaller a, b: a, b, score. span: no
    gap is larger.

    Only pairs of a similarity over score / span can have a score, so high similarities are looked
    at first and lower ones until the pairs found are out of reach of those left.
    """
    best = lambda p: p.select("a", "b", (F.col("sim") * F.col("gap")).alias("score")).orderBy(F.desc("score"), "a", "b").limit(top)
    blocks = set_blocks(rows, True, False)
    for level in [*(x for x in LEVELS if x > least), least]:
        out = block_pairs(blocks, level, apart=apart, then=best)
        n, low = out.agg(F.count("*"), F.min("score")).first()
        if n == top and low > level * span + 1e-9:
            break
    drop(blocks)
    return out.orderBy(F.desc("score"), "a", "b")


def equal_sim(p: Block, at: int, content: float | None) -> float | None:
    """The similarity of equal records, None if it is not enough."""
    sim = 1.0 if content is None else 0.6 + 0.4 * bool(len(p.trigrams(at)))
    return None if content is not None and sim < content - 1e-12 else sim


def similar_groups(rows: DataFrame, least: float, content: float | None = None) -> DataFrame:
    """Enough of similar_pairs' pairs to connect the same records: a, b, written.

    A task gives a forest of its links. Neighbouring blocks come first; after that rows that are
    known to be connected are not compared any more and a task links groups only.
    """
    from recollect.operators.pairs import components

    spark = rows.sparkSession
    blocks = set_blocks(rows, least >= COUNTED or content is not None, content is not None)
    few = read_blocks(blocks)

    def meet(forest: Forest, p: Block, q: Block, s: int, t: int):
        if least < COUNTED and content is None:
            a, b, _ = counted(p, q, least)
            forest.link(s + a, t + b)
            return
        x, y = forest.label[s:s + len(p.n)], forest.label[t:t + len(q.n)]
        some, count = np.unique(np.append(x, y), return_counts=True)
        most = some[count.argmax()]
        i, j = candidates(p, q, least, [(x != most, np.ones(len(y), bool)), (x == most, y != most)])
        size = PAIRS
        while len(i):
            ok = forest.label[s + i] != forest.label[t + j]
            i, j = i[ok], j[ok]
            now = np.zeros(len(i), bool)
            now[::max(1, len(i) // size)] = True
            a, b, _ = compared(p, q, i[now], j[now], least, content)
            forest.link(s + a, t + b)
            i, j, size = i[~now], j[~now], size * 2

    def alike(p: Block):
        """Copies of a record with the first of them."""
        for r in np.unique(p.copy_of).tolist():
            at = int(np.flatnonzero(p.ids == r)[0])
            if equal_sim(p, at, content) is not None:
                m = p.members(at)
                yield pd.DataFrame({"a": np.full(len(m) - 1, m[0]), "b": m[1:]})

    def told(forest: Forest):
        a, b = forest.edges()
        return pd.DataFrame({"a": a, "b": b})

    def near(batches):
        held: list[Block] = []

        def group():
            forest = Forest()
            at = [forest.place(k, p.ids, None) for k, p in enumerate(held)]
            for k, p in enumerate(held):
                for m in range(k, len(held)):
                    meet(forest, p, held[m], at[k], at[m])
                yield from alike(p)
            yield told(forest)

        for pdf in batches:
            for k in range(len(pdf)):
                held.append(Block(*[pdf[c].iloc[k] for c in COLS], least))
                if len(held) == SIDE:
                    yield from group()
                    held.clear()
        yield from group()

    def rest(batches):
        block, forest = held_blocks(least), Forest()
        for pdf in batches:
            for k in range(len(pdf)):
                no = [int(pdf[f"{s}_no"].iloc[k]) for s in "xy"]
                of = [np.asarray(pdf[f"{s}_of"].iloc[k], np.int64) for s in "xy"]
                if len(np.unique(np.append(*of))) == 1:
                    continue
                p, q = (block(n, [pdf[f"{s}_{c}"].iloc[k] for c in COLS]) for n, s in zip(no, "xy", strict=True))
                s, t = (forest.place(n, b.ids, f) for n, b, f in zip(no, (p, q), of, strict=True))
                meet(forest, p, q, s, t)
        yield told(forest)

    with batches_of(spark, 1):
        first = cut(few.select(*COLS).mapInPandas(near, "a long, b long"))
        # The component of each row of a block, in order: 8 bytes a record, sent to every task.
        ids = blocks.select("no", "ids").mapInPandas(rows_of, "no long, i int, id long")
        of = components(first, ids.select("id")).join(ids, "id").groupBy("no").agg(F.array_sort(F.collect_list(F.struct("i", "component")))["component"].alias("of"))
        x, y = both_sides(few.join(F.broadcast(cut(of)), "no"), [*COLS, "of"])
        out = first.unionByName(cut(x.hint("shuffle_replicate_nl").join(y, once() & fitting(least)).mapInPandas(rest, "a long, b long")))
    drop(blocks)
    return out


def rows_of(batches):
    """Each row of blocks: the block's number, its place, id."""
    for pdf in batches:
        for no, ids in zip(pdf.no, pdf.ids, strict=True):
            i = np.frombuffer(ids, np.int64)
            yield pd.DataFrame({"no": no, "i": np.arange(len(i)), "id": i})
