"""Language ID and toxicity: held-out accuracy and defined cases."""

import pytest
from pyspark.sql import functions as F

from recollect.llm import langid, toxicity
from recollect.llm.words import LETTERS, SPACE, word_features, word_hashes

SF = "/root/testdata/sf0.01"


def test_word_hashes_split_like_bytes():
    texts = ["Hello  hello\tWORLD\x0bx", None, "", "é É a\x1cb", "z" * 3_000_000 + " hello"]
    got = dict(word_hashes(texts, SPACE))
    assert [len(got[i]) for i in range(5)] == [4, 0, 0, 3, 2]
    assert got[0][0] == got[0][1] == got[4][1] and got[3][0] != got[3][1]
    assert len(set(dict(word_hashes(["idiot, idiot! Idiot"], LETTERS))[0])) == 1
    assert [len(f) for f in word_features(["", None, "..."])] == [0, 0, 0]


def test_profile_distance():
    c = langid.classifier({"aa": [int(g) for g in langid.grams("aaaa bbbb")[0]], "zz": [int(g) for g in langid.grams("zzzz yyyy")[0]]})
    assert c("bbbb aaaa")[0] == "aa" and c("yyyy zzzz")[0] == "zz"
    assert c(None) == ("und", 0.0) and c("123 !") == ("und", 0.0) and c("") == ("und", 0.0)
    assert langid.classifier({})("text") == ("und", 0.0)
    assert 0 <= c("qqqq")[1] <= 1


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    r = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert r.filter("lang = lang_pred").count() / r.count() > 0.97


def test_language_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("lang_pred", F.lit("x"))
    odd = docs.limit(1).withColumn("doc_id", F.lit(-5).cast("long"))
    bad = odd.withColumn("text", F.lit("1234 !!")).unionByName(odd.withColumn("text", F.lit(None).cast("string")))
    out = langid.keep_known(docs.unionByName(bad))
    assert out.columns == docs.columns and out.count() == docs.count()
    assert langid.keep_known(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def labelled(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id < 3000").cache()
    return docs, spark.read.parquet("/root/testdata/sf0.1/labels.parquet")


def test_toxicity_held_out(spark, labelled):
    docs, labels = labelled
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0
    r = toxicity.score(docs, labels.filter(~part)).withColumnRenamed("toxic", "said").join(labels.filter(part), "doc_id").toPandas()
    good = r[r.quality == 1]
    assert (good[good.toxic == 1].said).mean() > 0.75
    assert (good[good.toxic == 0].said).mean() < 0.02


def test_chain_uses_out_of_fold_log_odds(labelled):
    docs, labels = labelled
    chain = toxicity.learn(docs, labels)
    assert len(chain) == 2 and len(chain[0].earlier) == 0 and len(chain[1].earlier) == 1


def test_toxicity_defined_cases(spark, labelled):
    docs, labels = labelled
    odd = spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string")
    r = toxicity.score(odd.unionByName(docs.select("doc_id", "text")), labels).filter("doc_id < 0").collect()
    assert len(r) == 2 and r[0].p_toxic == r[1].p_toxic
    none = toxicity.score(docs.select("doc_id", "text").limit(5), labels.limit(0))
    assert none.filter("toxic").count() == 0 and none.count() == 5
    out = toxicity.drop_toxic(docs.limit(0), labels)
    assert out.count() == 0 and out.columns == docs.columns


def test_training_rows_stay_bytes():
    import numpy as np

    from recollect.llm import toxicity

    rnd = np.random.default_rng(1)
    chosen = np.arange(20, dtype=np.int32)
    feats = [np.flatnonzero(rnd.random(20) < 0.3) for _ in range(2_500)]
    x = toxicity.indicators(feats, chosen)
    assert x.nbytes == 2_500 * 20
    y = np.array([float(3 in f) for f in feats])
    a, b = (toxicity.fit_linear(m, np.zeros((len(y), 0)), y, chosen) for m in (x, x.astype(np.float32)))
    assert (a.weights == b.weights).all() and a.weights.argmax() == 3
