"""The pipeline against its stages written out plainly, on documents small enough for all pairs."""

import os
from collections import Counter
from itertools import combinations

import pytest

import corpus_pipeline
from surecal.llm import mixing, pieces, toxicity
from surecal.llm.queries import PIECES, labelled_languages
from test_ngram_join import grams
from test_secrets import brute

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def dedup(rows):
    """Smallest id of each component of all pairs."""
    nodes = sorted({(r.doc_id, r.text) for r in rows}, key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))
    root = list(range(len(nodes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [grams(t) for _, t in nodes]
    for i, j in combinations(range(len(nodes)), 2):
        both = len(sets[i] & sets[j])
        if both and both >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {nodes[i] for i in range(len(nodes)) if find(i) == i}


def redacted(text):
    out, at = "", 0
    for start, _, end, _ in brute(text):
        if start >= at:
            out += text[at:start] + "[secret]"
        at = max(at, end)
    return out + text[at:]


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    """The smallest tables, with rows of every awkward kind added."""
    path = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = docs.orderBy("doc_id").first()
    odd = spark.createDataFrame(
        [(90_001, None, "en", "s", None), (90_002, "", None, None, 0), (None, "no id here at all, none", "en", "s", 3),
         (first.doc_id, first.text, first.lang, first.source, first.n_chars), (90_003, first.text, "en", "z", 1),
         (90_004, "password=abcdef0123456789 " + "word " * 30_000, "en", "s", 9)], SCHEMA,
    )
    turned = [
        (91_000 + r.doc_id, " ".join(reversed(r.text.split())) + " password=abcdef0123456789", r.lang, "t", 1)
        for r in docs.orderBy("doc_id").limit(20).collect()
    ]
    docs.unionByName(odd).unionByName(spark.createDataFrame(turned, SCHEMA)).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


def test_stage_by_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "secrets", "mixing", "pieces"]

    model = toxicity.fit(docs, labels)
    safe = stages["toxicity"](spark, docs, folder)
    scores = {(r.doc_id, r.text): r.toxic_predicted for r in toxicity.score(docs, model).collect()}
    assert Counter(map(tuple, safe.collect())) == Counter(
        tuple(r) for r in docs.collect() if not scores[(r.doc_id, r.text)])

    kept = stages["near_duplicates"](spark, safe, folder)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == len(set(got)) and set(got) == dedup(safe.collect())

    clean = stages["secrets"](spark, kept, folder)
    want = {(r.doc_id, None if r.text is None else redacted(r.text)) for r in kept.collect()}
    out = clean.collect()
    assert {(r.doc_id, r.text) for r in out} == want and clean.schema == docs.schema
    assert any("[secret]" in (r.text or "") for r in out)

    mixed = stages["mixing"](spark, clean, folder)
    fit = mixing.fit_rates(clean, labelled_languages(spark, clean, folder), corpus_pipeline.LANGUAGE_POWER, 1.0)
    times = {r.doc_id: r.n for r in fit.rates.select("doc_id", mixing.copies(fit).alias("n")).collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter(times)
    assert mixed.columns == docs.columns and min(times.values()) >= 1

    final = stages["pieces"](spark, mixed, folder).collect()
    encoder = pieces.Encoder(pieces.Vocabulary.read(PIECES))
    texts = {r.doc_id: r.text for r in mixed.collect()}
    assert len(final) == mixed.count() and all(r.restored for r in final)
    for r in final[:50]:
        assert r.ids == (None if texts[r.doc_id] is None else encoder.encode(texts[r.doc_id]))

    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, folder).collect()) == Counter(times)


def test_no_documents(spark, folder, tmp_path):
    path = str(tmp_path)
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0


def test_columns_of_clashing_names_stay(spark, folder):
    """Every stage but the last hands on whatever columns it gets."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = ["toxic_score", "toxic_predicted", "digest", "bands", "node", "secrets", "_x", "rate", "tokens", "mark", "rows"]
    for i, name in enumerate(names):
        docs = docs.selectExpr("*", f"'{i}' AS {name}")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        rows = out.select(*names).distinct().collect()
        assert [tuple(r) for r in rows] == [tuple(str(i) for i in range(len(names)))]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == docs.count()


def test_entry_lists_the_pipeline():
    import __spark_entry__ as contract

    assert "pipeline" in contract.queries() and os.path.exists(corpus_pipeline.__file__)
