"""BPE and packing against the tokenizers library; packing invariants."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from recollect.llm import bpe, packing
from recollect.llm.queries import vocabulary

ODD = ["", "a", "aaaaaaa aaaa", "  x  y\n\n z\t", "it's I'LL 've", "naïve café 日本語 текст ΣΑΣ", "<|endoftext|> hi<|endoftext|>", "x\x1cy\x85z\xa0w", "😀😀 👩‍👩‍👧", " " * 50, "İstanbul", "a" * 3000, "1234 5 67", "...!!'s", "\x00\x01", "ﬁ Å",
       "word's don't ''re", "<|startoftext|>x", "###%% ab&&&"]


def texts():
    rnd = random.Random(7)
    return ODD + ["".join(rnd.choice("ab \n's!1é日́Ü.") for _ in range(rnd.randint(1, 60))) for _ in range(200)]


def test_bpe_equals_the_library():
    path = vocabulary("byte_bpe_50k.json")
    mine, lib = bpe.ByteBPE(path), Tokenizer.from_file(path)
    for t in texts():
        ids = lib.encode(t, add_special_tokens=False).ids
        assert mine.encode(t) == ids
        assert mine.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_long_words_equal_the_library():
    path, rnd = vocabulary("byte_bpe_50k.json"), random.Random(5)
    mine, lib = bpe.ByteBPE(path), Tokenizer.from_file(path)
    for alphabet, n in (("abcdefghijklmnopqrstuvwxyz", 20_000), ("ab", 5_000), ("A", 4_001), ("éaßbc", 3_000), ("theingandio", 9_000)):
        word = "".join(rnd.choice(alphabet) for _ in range(n))
        assert mine.encode(word + " x " + word) == lib.encode(word + " x " + word, add_special_tokens=False).ids
    assert all(len(c) <= bpe.LONGEST for c in mine.cache)
    few = packing.WordTokens(vocabulary("word_bpe_49k.json"))
    few.encode(["a" * 5000 + " b", "c!" * 900])
    assert all(len(c) <= packing.LONGEST for c in few.cache)


def test_bpe_of_no_rows(spark):
    assert bpe.digest(spark.createDataFrame([], "doc_id long, text string"), vocabulary("byte_bpe_50k.json")).collect() == []


def test_bpe_query_shape(spark):
    import hashlib

    df = spark.createDataFrame([(1, None, 0), (2, "Hello hello", 1), (2, "Hello hello", 1)], "doc_id long, text string, n_tokens int")
    r = bpe.digest(df, vocabulary("byte_bpe_50k.json")).orderBy("doc_id").collect()
    assert [x.n_tokens for x in r][0] == 0 and r[0].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert r[1] == r[2] and r[1].decoded_sha256 == hashlib.sha256(b"Hello hello").hexdigest()


def test_words_equal_the_library():
    path = vocabulary("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    for t, raw in zip(texts(), packing.WordTokens(path).encode(texts()), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids


def brute_fit(lengths, size):
    left, place = [], []
    for n in lengths:
        fits = [(c, i) for i, c in enumerate(left) if c >= n]
        if fits:
            c, i = min(fits)
        else:
            i = len(left)
            left.append(size)
        place.append(i)
        left[i] -= n
    return len(left), place


def test_segment_tree_finds_the_tightest_bin():
    rnd = random.Random(3)
    for size in (1, 7, 64, 100):
        lengths = sorted((rnd.randint(1, size) for _ in range(300)), reverse=True)
        bins, offsets = packing.best_fit_decreasing(lengths, size)
        assert bins.max() + 1 == brute_fit(lengths, size)[0]
        for b in range(bins.max() + 1):
            mine = sorted((offsets[i], lengths[i]) for i in np.flatnonzero(bins == b))
            at = 0
            for o, n in mine:
                assert o == at
                at += n
            assert at <= size
    tree = packing.BestFit(10)
    for c in (3, 7, 5):
        tree.put(c, c)
    assert tree.take(4) == (5, 5) and tree.take(4) == (7, 7) and tree.take(4) is None and tree.take(3) == (3, 3)


@pytest.mark.parametrize("per_packer", [2, 20_000])
def test_packing_query(spark, per_packer):
    rows = [(i, t, "x") for i, t in enumerate([None, "", "one two three " * 40, "b " * 9, "same", "same"])] + [(4, "same", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece string")
    out = packing.pack(df, vocabulary("word_bpe_49k.json"), length=16, per_packer=per_packer).toPandas()
    lib = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    assert set(out.doc_id) == set(range(6)) and (out.length <= 16).all()
    for d, t, _ in rows[:4]:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
        mine = out[out.doc_id == d].sort_values("piece")
        assert mine.length.sum() == len(ids) and (mine.start == np.arange(len(mine)) * 16).all()
        for r in mine.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes())
    assert len(out[out.doc_id == 4]) == 2
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= 16
    assert packing.pack(df.limit(0), vocabulary("word_bpe_49k.json")).count() == 0
