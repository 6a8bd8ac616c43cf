"""Plain twins of operators that SQL can't express, the whole pipeline, and the SQL of those it can."""

import collections
import math
import os
import random
import struct

import duckdb
import numpy as np
import pytest
import xxhash
from test_ngram_join import brute as brute_groups
from test_structure import brute_lines
from tokenizers import Tokenizer

import corpus_pipeline
from recollect.llm import ann, chat, langid, linededup, queries, toxicity
from recollect.llm import words as wd

SF = "/root/testdata/sf0.001"
M = (1 << 64) - 1


def mix(x):
    x &= M
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M
    return x ^ x >> 31


def plain_features(text):
    """Hashed features of a text: its words of letters, their first 4, 5, 6 and last 4, 5 bytes."""
    byte, pos = [int(x) for x in wd._BYTE], [int(x) for x in wd._positions(4096)]
    out, word = set(), []
    for b in [*(text or "").encode(), 0]:
        b = b + 32 if 65 <= b <= 90 else b
        if 97 <= b <= 122 or b >= 128:
            word.append(byte[b + 1])
            continue
        if word:
            out.add(mix(sum(c * pos[i] for i, c in enumerate(word))))
            for part, start, sizes in ((word, 0, (4, 5, 6)), (word[::-1], 2048, (4, 5))):
                out |= {mix(sum(c * pos[start + i] for i, c in enumerate(part[:k])) + k) for k in sizes if len(part) >= k}
        word = []
    return sorted({h & (1 << toxicity.BITS) - 1 for h in out if h})


def best_features(rows, top):
    """The features that tell the marks of rows (features, mark) best by chi-square."""
    n, pos = len(rows), sum(y for _, y in rows)
    if not n or pos in (0, n):
        return np.empty(0, np.int32)
    of, told = collections.Counter(), collections.Counter()
    for f, y in rows:
        of.update(f)
        if y:
            told.update(f)
    rate = pos / n
    chi = {f: (told[f] - of[f] * rate) ** 2 / (of[f] * rate * (1 - rate)) for f in of if of[f] >= 3}
    return np.sort(np.array(sorted(chi, key=lambda f: (-chi[f], f))[:top], np.int32))


def odds(model, f, before):
    z = model.bias + sum(b * w for b, w in zip(before, model.earlier, strict=False))
    return z + sum(w for c, w in zip(model.chosen.tolist(), model.weights, strict=True) if c in f)


def plain_chain(docs, labels):
    """(doc_id, text) and (doc_id, quality, toxic) rows -> text -> probabilities of the two categories."""
    marks = {}
    for d, quality, toxic in labels:
        got = marks.setdefault(d, [0, 0])
        got[0], got[1] = max(got[0], 1 - quality), max(got[1], toxic)
    feats = {}
    for d, t in docs:
        if d in marks:
            f = plain_features(t)
            feats[d] = min(feats.get(d, f), f)
    ids = sorted(feats)
    fold = {d: xxhash.xxh64_intdigest(struct.pack("<q", d), 42) % 4 for d in ids}  # the sign bit is a multiple of 4
    before = {d: [] for d in ids}
    chain = []

    def fit(some, i):
        chosen = best_features([(feats[d], marks[d][i]) for d in some], toxicity.SELECTED)
        x = np.array([[c in set(feats[d]) for c in chosen.tolist()] for d in some], np.float32).reshape(len(some), len(chosen))
        return toxicity.fit_linear(x, np.array([before[d] for d in some], float).reshape(len(some), i), np.array([marks[d][i] for d in some], float), chosen)

    for i in (0, 1):
        chain.append(fit(ids, i))
        if i == 0:
            parts = {k: fit([d for d in ids if fold[d] != k], 0) for k in range(toxicity.FOLDS)}
            before = {d: [min(8, max(-8, odds(parts[fold[d]], set(feats[d]), [])))] for d in ids}

    def tell(text):
        f, z = set(plain_features(text)), []
        for m in chain:
            z.append(min(8, max(-8, odds(m, f, z))))
        return [1 / (1 + math.exp(-v)) for v in z]

    return tell


def plain_languages(rows):
    """(doc_id, text, lang) rows -> text -> (language, score), by counted strings."""
    def grams(text):
        c, line = collections.Counter(), "".join(ch if ch.isalpha() else " " for ch in (text or "").lower())
        line = " " + " ".join(line.split()) + " "
        if len(line) < 3:
            return c
        c.update(ch for ch in line if ch != " ")
        c.update(line[i:i + k] for k in (2, 3) for i in range(len(line) - k + 1))
        return c

    def ranked(c):
        return sorted(c, key=lambda g: (-c[g], len(g), [0 if ch == " " else ord(ch) + 2 for ch in g]))[:300]

    total = {}
    for d, text, lang in rows:
        if lang is not None and text is not None and duckdb_crc(d) % 4 != 2:
            total.setdefault(lang, collections.Counter()).update(grams(text))
    profiles = {name: {g: r for r, g in enumerate(ranked(c))} for name, c in total.items()}

    def tell(text):
        mine = ranked(grams(text))
        if not mine or not profiles:
            return "und", 0.0
        far = {name: sum(min(300, abs(p[g] - r)) if g in p else 300 for r, g in enumerate(mine)) for name, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        return best, 1 - far[best] / (300 * len(mine))

    return tell


def duckdb_crc(d):
    import zlib

    return zlib.crc32(str(d).encode())


@pytest.fixture(scope="module")
def tables(spark):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    return docs, labels


def test_language_id_equals_its_twin(spark, tables):
    extra = [(-1, None, "en"), (-2, "", "en"), (-3, "12 !", None), (-4, "x" * 300_000, None), (-5, "ΑΒ ж İi ﬁ", "el"), (-5, "ΑΒ ж İi ﬁ", "el"), (-6, "ab", "en")]
    rows = [*tables[0], *extra]
    tell = plain_languages(rows)
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, lang string, lang_pred string")
    got = langid.identify(df).collect()
    want = sorted((d, duckdb_crc(d) % 4 == 2, tell(t)[0], round(tell(t)[1], 9)) for d, t, _ in rows)
    assert sorted((r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in got) == want


def test_toxicity_chain_equals_its_twin(spark, tables):
    docs, labels = tables
    docs = [(d, t) for d, t, _ in docs] + [(-1, None), (-2, ""), (-3, "idiot " * 50_000), (docs[0][0], docs[0][1])]
    labels = [*labels, (labels[0][0], labels[0][1], 1)]
    tell = plain_chain(docs, labels)
    got = toxicity.score(spark.createDataFrame([(*r, 0.5) for r in docs], "doc_id long, text string, p_toxic double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(docs)
    want = {d: tell(t) for d, t in docs}
    for r in got:
        assert np.allclose((r.p_low_quality, r.p_toxic), want[r.doc_id], atol=1e-4)
        assert r.toxic == (r.p_toxic >= toxicity.REJECT)


def test_the_whole_pipeline_equals_its_twin(spark, tables, tmp_path):
    """Each stage's twin on what the twin before kept, on documents with nulls, repeats and odd columns."""
    docs, labels = tables
    longest = max((t for _, t, _ in docs), key=len)
    rows = [(d, t, lang, "s", len(t or "")) for d, t, lang in docs]
    rows += [(-1, None, None, None, None), (-2, "", "en", "s", 0), (-3, "1 2 3", "en", "s", 5), (5000, longest, "en", "s", len(longest)), (5001, longest + " end", "en", "s", 7), rows[3], (None, rows[4][1], "en", "s", 1)]
    labels = [*labels, (None, 1, 1), (rows[5][0], 1, 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    lang = plain_languages([r[:3] for r in rows])
    kept = [r for r in rows if lang(r[1])[0] != "und" and lang(r[1])[1] >= langid.MIN_SCORE]
    tell = plain_chain([r[:2] for r in kept if r[0] is not None], [x for x in labels if x[0] is not None])
    kept = [r for r in kept if tell(r[1])[1] < toxicity.REJECT]
    least = linededup.NOISE + linededup.WINDOW - 1
    seen = sorted({(r[0], r[1]) for r in kept}, key=lambda r: (r[0] is not None, r[0] or 0))
    cut = dict(zip(seen, cut_lines([t for _, t in seen], least), strict=True))
    kept = [(r[0], cut[r[0], r[1]]) for r in kept if cut[r[0], r[1]] is not None]
    comp = brute_groups([r for r in kept if r[0] is not None], 5, 4, 5)
    kept = [r for r in kept if r[0] is None or comp[r[0]][1] == r[0]]
    lib = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    want = collections.Counter()
    for d, t in kept:
        ids = [*lib.encode(t, add_special_tokens=False).ids, 1]
        want.update((d, at // 4096, at, len(ids[at:at + 4096])) for at in range(0, len(ids), 4096))
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length) for r in got) == want
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, n in sorted(p):
            assert offset == at
            at += n
        assert at <= 4096


def cut_lines(texts, least):
    """Each text without later repeats of runs of lines of at least `least` words; None if nothing is left of it."""
    lines = [t.split("\n") for t in texts]
    solid = [[k for k, x in enumerate(ls) if x.strip(" ")] for ls in lines]
    gone = [set() for _ in texts]
    where = collections.defaultdict(list)
    for i, ls in enumerate(lines):
        for n, k in enumerate(solid[i]):
            where[ls[k].strip(" ")].append((i, n))
    for i, ls in enumerate(lines):
        for n, k in enumerate(solid[i]):
            for j, m in where[ls[k].strip(" ")]:
                if (j, m) >= (i, n) or (n and m and lines[j][solid[j][m - 1]].strip(" ") == ls[solid[i][n - 1]].strip(" ")):
                    continue
                run, total = 0, 0
                while n + run < len(solid[i]) and m + run < len(solid[j]) and ls[solid[i][n + run]].strip(" ") == lines[j][solid[j][m + run]].strip(" "):
                    total += ls[solid[i][n + run]].strip(" ").count(" ") + 1
                    run += 1
                if total >= least:
                    gone[i] |= {solid[i][n + r] for r in range(run)}
    out = []
    for t, ls, g in zip(texts, lines, gone, strict=True):
        left = "\n".join(x for k, x in enumerate(ls) if k not in g)
        out.append(t if not g else left if left.replace("\n", "").strip(" ") else None)
    return out


def test_line_dedup_of_growing_passages(spark):
    """P in one document, then P Q x and P Q y: Q must go from the later one, wherever its fingerprints lie."""
    rnd = random.Random(11)
    docs = []
    for g in range(40):
        word = lambda: f"g{g}w{rnd.randrange(10 ** 9)}"  # noqa: E731, B023
        text = lambda n: " ".join(word() for _ in range(n))  # noqa: E731, B023
        p = "\n".join(text(n) for n in (20, 20, 20))
        q = "\n".join(text(rnd.randint(5, 20)) for _ in range(2))
        docs += [(3 * g, f"{text(9)}\n{p}\n{text(4)}"), (3 * g + 1, f"{p}\n{q}\n{text(7)}"), (3 * g + 2, f"{text(3)}\n{p}\n{q}\n{text(7)}")]
    got = {r.doc_id: r.n_removed for r in linededup.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for g in range(0, len(docs), 3):
        want = brute_lines(docs[g:g + 3], linededup.NOISE + linededup.WINDOW - 1)
        assert {d: got[d] for d in want} == want


def test_long_texts_of_lines_and_turns(spark):
    line = " ".join(f"w{i}" for i in range(60))
    long = "\n".join(f"{i} own words of line {i}" for i in range(20_000))
    df = spark.createDataFrame([(1, f"{long}\n{line}"), (2, f"{line}\n{'x' * 200_000}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in linededup.report(df).collect()} == {1: 0, 2: 1}
    rows = spark.createDataFrame([(1, 0, "user", "a" * 500_000), (1, 1, "assistant", "###" * 200_000)], "conv_id long, turn long, role string, text string")
    r = chat.digest(chat.format_conversations(rows)).first()
    assert r.n_turns == 2 and r.loss_chars == 600_000


def test_neighbours_of_one_direction_tie(spark):
    v = np.array([0.3, -1.7, 2.9])
    rows = [(i, (v * i).tolist()) for i in range(1, 13)] + [(50, v.tolist()), (100, (v * 7).tolist())] + [(200 + i, [1.0, float(i), 0.1]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for factor in (1.0, ann.FACTOR):
        got = ann.nearest(df, df.filter("vec_id % 50 = 0"), factor=factor).collect()
        for q in (50, 100):
            assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == [1, 2, 3, 4, 5]


NASTY = ["a\\b", "x</turn>", "###", "plain", "", "</turn>\n", "\\s", "\\c", "a\\", "s\\\\e", "##", "# ", ": ", "a: b"]


def test_chat_digest_equals_its_sql(spark):
    rows = [(i // 7, i % 7, role, text) for i, (role, text) in enumerate((r, t) for r in ["user", "assistant", "a:", "a: b", "x\\", "\\c", "##", "#", "</turn>"] for t in NASTY)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    extra = spark.createDataFrame([(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")], df.schema)
    got = chat.digest(chat.format_conversations(df.unionByName(extra)))
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert compare(got, con, queries.CHAT_SQL)


def test_loss_text_is_cut_by_the_mask(spark):
    rows = [(1, 0, "user", "hello"), (1, 1, "assistant", "world ### x")]
    f = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert chat.digest(f).first().loss_chars == len("world ### x")
    r = f.first()
    wrong = [*r.loss_mask[:1], (r.loss_mask[1].length, True), *r.loss_mask[2:4], (r.loss_mask[4].length - 2, True), *r.loss_mask[5:]]
    g = spark.createDataFrame([(1, r.formatted, [tuple(m) for m in wrong], 0)], f.schema)
    assert chat.digest(g).first().loss_chars == len("hello" + "world ### x") - 2


def compare(df, con, sql):
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    order = sorted(cols)
    assert sorted(df.columns) == order
    norm = lambda v: float(f"{v:.7g}") if isinstance(v, float) else v
    want = sorted((tuple(norm(r[cols.index(c)]) for c in order) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(norm(r[c]) for c in order) for r in df.collect()), key=repr) == want
    return True


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    assert compare(queries.QUERIES[name](spark, SF), con, queries.ORACLE_SQL[name])
