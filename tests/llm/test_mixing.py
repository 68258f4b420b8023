import numpy as np
import pytest

from surecal.llm import mixing
from surecal.llm.common import table
from surecal.llm.queries import QUERIES

WORDS = {"a": "la le un des et".split(), "b": "the of and in to".split()}


def corpus(spark, n=120):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(n):
        d = "a" if i % 4 == 0 else "b"
        rows.append((i, " ".join(rng.choice(WORDS[d], 5 + i % 30)), "x"))
        if i % 3 == 0:
            labels.append((i, d))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, rate string")
    return docs, spark.createDataFrame(labels, "doc_id bigint, domain string")


def test_targets_are_met(spark):
    docs, labelled = corpus(spark)
    mix = mixing.fit_rates(docs, labelled, {"a": 0.5, "b": 0.5})
    whole = sum(mix.present.values())
    rows = mix.rates.collect()
    for k, d in enumerate(mix.domains):
        expected = sum(r.rate * r.tokens * r[f"q{k}"] for r in rows)
        assert expected == pytest.approx(mix.reached[d]) == pytest.approx(whole / 2, abs=2e-3 * whole)
    assert all(r.rate >= 0 and abs(sum(r[f"q{k}"] for k in range(2)) - 1) < 1e-9 for r in rows)


def brute_rates(rows, target, present, least, steps=4000):
    """The same least-squares problem by many small dense steps."""
    t = np.array([r.tokens * r.rows for r in rows], dtype=float)
    q = np.array([[r.q0, r.q1] for r in rows])
    x = np.full(len(rows), max(1.0, least))
    for _ in range(steps):
        gap = ((x * t) @ q - target) / present
        x = np.maximum(least, x - 0.5 * (q @ gap))
    return ((((x * t) @ q - target) ** 2) / present).sum()


@pytest.mark.parametrize("weights,least", [({"a": 0.9, "b": 0.1}, 0.0), ({"a": 1.0}, 0.0), (0.5, 1.0)])
def test_as_close_as_a_dense_solver(spark, weights, least):
    docs, labelled = corpus(spark)
    mix = mixing.fit_rates(docs, labelled, weights, least)
    rows = mix.rates.collect()
    target, present = (np.array([m[d] for d in mix.domains]) for m in (mix.targets, mix.present))
    reached = np.array([mix.reached[d] for d in mix.domains])
    mine = ((reached - target) ** 2 / present).sum()
    best = brute_rates(rows, target, present, least)
    assert mine <= best + 1e-4 * present.sum() and min(r.rate for r in rows) >= least


def test_posteriors_find_the_domain(spark):
    docs, labelled = corpus(spark)
    mix = mixing.fit_rates(docs, labelled, 0.7)
    out = mix.rates.select("doc_id", mixing.domain_of(mix).alias("d")).collect()
    assert all(r.d == ("a" if r.doc_id % 4 == 0 else "b") for r in out)


def test_edge_rows(spark):
    docs, labelled = corpus(spark, 40)
    odd = spark.createDataFrame(
        [(1000, None, "x"), (1001, "", "x"), (None, "la le", None), (None, None, None), (0, "the " * 50_000, "y"),
         (5, docs.where("doc_id = 5").first().text, "x")],
        "doc_id bigint, text string, rate string",
    )
    both = docs.unionByName(odd)
    bad = labelled.unionByName(spark.createDataFrame([(None, "a"), (7, None), (0, "b")], "doc_id bigint, domain string"))
    mix = mixing.fit_rates(both, bad, 0.8, least=1.0)
    rows = mix.rates.collect()
    assert sum(r.rows for r in rows) == both.count()
    assert next(r.rows for r in rows if r.doc_id == 5) == 2
    out = mixing.mixed(both, mix)
    assert out.columns == both.columns
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in both.collect()}


def test_nothing_to_learn_from(spark):
    docs, labelled = corpus(spark, 12)
    mix = mixing.fit_rates(docs, labelled.limit(0), 0.7)
    assert {r.rate for r in mix.rates.collect()} == {1.0} and mix.domains == []
    assert mixing.mixed(docs, mix).count() == 12
    assert mixing.fit_rates(docs.limit(0), labelled, 0.7).rates.count() == 0


def test_many_domains_are_pooled_and_many_steps_are_taken(spark):
    # Domains that the text hardly tells: posteriors are broad, and the descent is long.
    rows = [(i, f"w{i % 70} common words of all {i % 3}", f"d{i % 70:02d}") for i in range(1400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, domain string")
    labelled = docs.select("doc_id", "domain").where("doc_id % 2 = 0 or doc_id < 140")
    settings = mixing.Settings(most_domains=5, tolerance=1e-9, unwritten=3)
    asked = {f"d{k:02d}": 1.0 + k % 4 for k in range(70)}
    mix = mixing.fit_rates(docs, labelled, asked, settings=settings)
    assert len(mix.domains) == 5 and mixing.OTHERS in mix.domains and mix.steps > 6
    kept = [d for d in mix.domains if d != mixing.OTHERS]
    whole = sum(mix.targets.values())
    assert mix.targets[mixing.OTHERS] / whole == pytest.approx(1 - sum(asked[d] for d in kept) / sum(asked.values()))
    got = mix.rates.select("rate").collect()
    assert len(got) == 1400 and all(r.rate >= 0 for r in got) and 0 <= mix.distance < 0.2
    gaps = [abs(mix.reached[d] - mix.targets[d]) / whole for d in mix.domains]
    assert mix.distance == pytest.approx(max(gaps))


def test_no_python_in_the_plan(spark):
    docs, labelled = corpus(spark, 12)
    plan = mixing.mixed(docs, mixing.fit_rates(docs, labelled, 0.7))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query(spark, sf):
    out = QUERIES["op9_mixing"](spark, sf).collect()
    docs = {r.doc_id: r for r in table(spark, sf, "documents").collect()}
    assert len(out) == len(docs)
    assert np.mean([r.domain == docs[r.doc_id].lang for r in out]) > 0.8
    assert all(r.tokens == len(docs[r.doc_id].text.split(" ")) and abs(r.copies - r.rate) < 1 for r in out)
