"""Vectorised word hashing: 64-bit hashes of the words of whole texts, with numpy only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
#: Bytes handled at once; longer texts are cut between words, never shortened.
CHUNK = 1 << 20


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with good avalanche (the public splitmix64 finaliser)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = splitmix(np.arange(1, 258, dtype=U64)) | U64(1)
_POS = splitmix(np.arange(1000, 1000 + 4096, dtype=U64)) | U64(1)


def _positions(n: int) -> np.ndarray:
    global _POS
    if n > len(_POS):
        _POS = splitmix(np.arange(1000, 1000 + 2 * n, dtype=U64)) | U64(1)
    return _POS


def byte_table(kind: str) -> np.ndarray:
    """256 entries: 0 for a separator, else 1 + the byte folded to lower case (A-Z only).

    ``space``: words are runs of anything but \\x20 and \\x09-\\x0D. ``letters``: runs of ASCII
    letters and of bytes of non-ASCII characters. ``alnum``: the same with ASCII digits.
    """
    t = np.arange(1, 257, dtype=np.uint16)
    t[65:91] += 32
    sep = np.zeros(256, bool)
    if kind == "space":
        sep[[9, 10, 11, 12, 13, 32]] = True
    else:
        sep[:128] = True
        sep[97:123] = sep[65:91] = False
        sep[48:58] = kind != "alnum"
    t[sep] = 0
    return t


SPACE, LETTERS, ALNUM = byte_table("space"), byte_table("letters"), byte_table("alnum")


def _hash_chunk(buf: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = table[buf]
    inside = low != 0
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.empty(0, U64), starts
    lens = ends - starts
    offs = np.cumsum(lens) - lens
    letters = low[inside]
    pos = np.arange(len(letters)) - np.repeat(offs, lens)
    h = np.add.reduceat(_BYTE[letters] * _positions(int(lens.max()))[pos], offs)
    return splitmix(h), starts


def word_hashes(texts: list[str | None], table: np.ndarray = SPACE) -> Iterator[tuple[int, np.ndarray]]:
    """(index, hashes of the text's words in order) for every text; null counts as empty."""
    group: list[tuple[int, bytes]] = []
    held = 0

    def flush():
        if not group:
            return
        blob = b"\n".join(b for _, b in group)
        h, starts = _hash_chunk(np.frombuffer(blob, np.uint8), table)
        bounds = np.cumsum([0] + [len(b) + 1 for _, b in group])
        cut = np.searchsorted(starts, bounds)
        for k, (i, _) in enumerate(group):
            yield i, h[cut[k]:cut[k + 1]]

    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if len(raw) > CHUNK:
            parts, at = [], 0
            while at < len(raw):
                end = min(len(raw), at + CHUNK)
                while end < len(raw) and table[raw[end]] != 0:
                    end += 1
                parts.append(_hash_chunk(np.frombuffer(raw[at:end], np.uint8), table)[0])
                at = end
            yield from flush()
            group, held = [], 0
            yield i, np.concatenate(parts)
            continue
        group.append((i, raw))
        held += len(raw)
        if held > CHUNK:
            yield from flush()
            group, held = [], 0
    yield from flush()


_W = splitmix(np.arange(7_000, 7_064, dtype=U64)) | U64(1)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes, sorted, of all runs of n words; fewer words make one run; none, no run."""
    if not len(words):
        return words
    k = min(n, len(words))
    acc = np.full(len(words) - k + 1, k, U64)
    for j in range(k):
        acc = acc + words[j:len(words) - k + 1 + j] * _W[j % 64]
        acc ^= acc >> U64(29)
    return np.unique(splitmix(acc))


def _affixes(low: np.ndarray, offs: np.ndarray, lens: np.ndarray, sizes: tuple[int, ...], tail: bool) -> list[np.ndarray]:
    m = max(sizes)
    step = np.arange(m)
    at = (offs + lens - 1)[:, None] - step if tail else offs[:, None] + step
    inside = step < lens[:, None]
    part = np.where(inside, _BYTE[low[np.clip(at, 0, len(low) - 1)]] * _POS[2048 * tail + step], U64(0)).cumsum(1)
    return [np.where(lens >= k, splitmix(part[:, k - 1] + U64(k)), U64(0)) for k in sizes]


def word_features(texts: list[str | None], bits: int = 20) -> Iterator[np.ndarray]:
    """Per text: the sorted distinct hashed features of its words of letters: the word, its first
    4, 5 and 6 bytes, its last 4 and 5."""
    mask = U64((1 << bits) - 1)
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        found, at = [], 0
        while at < len(raw):
            end = min(len(raw), at + CHUNK)
            while end < len(raw) and LETTERS[raw[end]] != 0:
                end += 1
            low = LETTERS[np.frombuffer(raw[at:end], np.uint8)]
            at = end
            inside = low != 0
            edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
            starts, lens = edge[0::2], edge[1::2] - edge[0::2]
            if not len(starts):
                continue
            letters = low[inside]
            offs = np.cumsum(lens) - lens
            pos = np.arange(len(letters)) - np.repeat(offs, lens)
            whole = splitmix(np.add.reduceat(_BYTE[letters] * _positions(int(lens.max()))[pos], offs))
            h = np.concatenate([whole, *_affixes(letters, offs, lens, (4, 5, 6), False), *_affixes(letters, offs, lens, (4, 5), True)])
            found.append(np.unique(h[h != 0] & mask))
        yield np.unique(np.concatenate(found)).astype(np.int32) if found else np.empty(0, np.int32)
