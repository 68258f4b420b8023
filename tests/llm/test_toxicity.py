import zlib

import numpy as np

from surecal.llm import toxicity
from surecal.llm.common import table
from surecal.llm.queries import QUERIES

SMALL = toxicity.Settings(sample_rows=200, buckets=4096, epochs=20)


def example():
    rng = np.random.default_rng(3)
    plain = [f"word{i}" for i in range(60)]
    texts, labels = [], []
    for i in range(200):
        words = list(rng.choice(plain, 20))
        if i % 2:
            words[5] = "horribleness"
        texts.append(" ".join(words))
        labels.append(i % 2)
    return texts, labels


def test_misspelling_shares_subwords(spark):
    model = toxicity.train(*example(), SMALL)
    rows = [(1, "word1 word2 horriblenes word3", "x"), (2, "word1 word2 word3 word4", None),
            (3, None, "x"), (4, "", "x"), (5, "word7 " * 40_000, "x"), (None, "horribleness", "x"),
            (1, "word1 word2 horriblenes word3", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    out = toxicity.score(df, model).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == 7 and by[1].toxic_predicted == 1 and by[None].toxic_predicted == 1
    assert by[2].toxic_predicted == 0 and by[5].toxic_predicted == 0
    assert by[3].toxic_score == by[4].toxic_score and 0 <= by[3].toxic_score <= 1
    assert {r.score for r in out} == {"x", None}


def test_one_class_and_nothing(spark):
    one = toxicity.train(["a b", "c d"], [0, 0], SMALL)
    none = toxicity.train([], [], SMALL)
    df = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    assert toxicity.score(df, one).first().toxic_score < 0.5
    assert toxicity.score(df, none).first().toxic_score == 0.5
    assert toxicity.score(df.limit(0), none).count() == 0


def test_labels_are_read_from_the_allowed_rows_only(spark):
    docs = spark.createDataFrame(
        [(i, f"t{i}") for i in range(50)] + [(None, "n"), (7, "t7")], "doc_id bigint, text string"
    )
    labels = spark.createDataFrame(
        [(i, i % 2) for i in range(50)] + [(None, 1), (3, None), (7, 1)], "doc_id bigint, toxic int"
    )
    got = {r.text for r in toxicity.training_rows(docs, labels).collect()}
    assert got == {f"t{i}" for i in range(50) if zlib.crc32(str(i).encode()) % 3 != 1}
    assert toxicity.training_rows(docs, labels, toxicity.Settings(sample_rows=10)).count() == 10


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    scored = QUERIES["op10_toxicity"](spark, sf)
    assert dict(scored.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    rows = scored.where("held_out").join(table(spark, sf, "labels"), "doc_id").collect()
    toxic = np.array([r.score for r in rows if r.toxic == 1])
    clean = np.array([r.score for r in rows if r.toxic == 0])
    # About 300 toxic rows to learn from in four languages.
    assert (toxic[:, None] > clean[None, :]).mean() > 0.85
    assert (toxic >= 0.7).mean() > 0.5 and (clean >= 0.7).mean() < 0.06


def test_scores_follow_from_vectors_and_subwords(spark):
    """Every score of the query, recomputed plainly from the model's rows."""
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf, "labels"))

    def plain(text):
        logits = [float(b) for b in model.bias]
        words = toxicity.words_of(text)
        for word in words:
            rows = toxicity.subwords(word, model.settings)
            for k in (0, 1):
                logits[k] += sum(float(model.vectors[r][k]) for r in rows) / len(rows) / len(words)
        return 1 / (1 + np.exp(logits[0] - logits[1]))

    got = {r.doc_id: (r.score, r.predicted) for r in QUERIES["op10_toxicity"](spark, sf).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert got.keys() == texts.keys()
    for doc_id, text in texts.items():
        want = plain(text)
        assert np.isclose(got[doc_id][0], want, atol=1e-6)
        assert got[doc_id][1] == int(got[doc_id][0] >= 0.7)
