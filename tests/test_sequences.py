import numpy as np
import pytest
from pyspark.sql import functions as F

from surecal.functions import prompts, sequences

SUBSEQUENCES = [
    ([1, 2, 3, 2, 3], [2, 3], 1),
    ([1, 2, 3], [], 0),
    ([], [], 0),
    ([1, 2], [1, 2, 3], None),
    ([1, 2, 3], [4], None),
    ([1, 1, 2], [1, 2], 1),
    (None, [1], None),
    ([1], None, None),
    ([5], [5], 0),
]


def test_find_subsequence(spark):
    df = spark.createDataFrame(
        [(i, s, p) for i, (s, p, _) in enumerate(SUBSEQUENCES)], "i int, s array<int>, p array<int>"
    ).repartition(3)
    got = dict(df.select("i", sequences.find_subsequence("s", "p")).collect())
    assert [got[i] for i in range(len(SUBSEQUENCES))] == [w for *_, w in SUBSEQUENCES]


def test_answer_logprobs(spark):
    df = spark.createDataFrame(
        [(1, [7, 8, 9], [8, 9]), (2, [7, 8, 9], None), (3, [7], [1])],
        "i int, c array<int>, p array<int>",
    )
    lp = F.array(F.lit(-0.1), F.lit(-0.2), F.lit(-0.3))
    got = {r["i"]: r["r"] for r in df.select("i", sequences.answer_logprobs("c", "p", lp).alias("r")).collect()}
    assert [tuple(got[i]) for i in (1, 2, 3)] == [
        ([-0.2, -0.3], "found"), ([], "no_prediction"), ([], "not_found"),
    ]


def test_tail(spark):
    df = spark.createDataFrame([(list(range(10)),)], "ids array<int>")
    got = df.select(sequences.tail_with_prefix("ids", F.lit(6), F.lit(2))).first()[0]
    assert got == [4, 5, 6, 7, 8, 9]


def test_softmax_is_stable(spark):
    rng = np.random.default_rng(0)
    rows = [rng.normal(size=6).tolist(), [1000.0, 1001.0, -1000.0, 0.0, 5.0, 1001.0]]
    df = spark.createDataFrame([(r, [4, 0, 2]) for r in rows], "v array<double>, ids array<int>")
    got = df.select(
        sequences.softmax("v"), sequences.label_probabilities("v", "ids"),
        sequences.token_log_probability("v", F.lit(3)),
    ).collect()
    for r, (soft, labels, lp) in zip(rows, got):
        e = np.exp(np.array(r) - max(r))
        np.testing.assert_allclose(soft, e / e.sum(), atol=1e-14)
        chosen = np.array(r)[[4, 0, 2]]
        e2 = np.exp(chosen - chosen.max())
        np.testing.assert_allclose(labels, e2 / e2.sum(), atol=1e-14)
        assert lp == pytest.approx(r[3] - max(r) - np.log(e.sum()), abs=1e-12)


def test_sequence_scoring(spark):
    rng = np.random.default_rng(1)
    logits, tokens = rng.normal(size=(4, 5)), [2, 0, 4, 1]
    df = spark.createDataFrame(
        [(logits.tolist(), tokens), (logits[:1].tolist(), [3])], "l array<array<double>>, t array<int>"
    )
    long, short = [r[0] for r in df.select(sequences.sequence_log_probabilities("l", "t")).collect()]
    lse = np.log(np.exp(logits).sum(1))
    want = [logits[i, tokens[i + 1]] - lse[i] for i in range(3)]
    np.testing.assert_allclose(long, want, atol=1e-12)
    assert short == []


def test_format_question(spark):
    df = spark.createDataFrame(
        [(1, "Q?", ["x", "y"], ["A", "B", "C"]), (2, None, None, ["A"]), (3, "Q", ["x"], [])],
        "i int, q string, t array<string>, l array<string>",
    )
    got = dict(df.select("i", prompts.format_question("q", "t", "l")).collect())
    assert got == {1: "Q?\n\nA. x\nB. y", 2: "\n", 3: "Q\n"}


def test_prompt_parts(spark):
    df = spark.createDataFrame([("p", "t", True), ("p", None, False)], "a string, b string, f boolean")
    got = [r[0] for r in df.select(prompts.continuation_prompt("a", "b", F.col("f"), "X")).collect()]
    assert got == ["pt\n\nX", "pX"]
    messages = df.select(prompts.chat_messages(F.lit("s"), "a").alias("m")).first()["m"]
    assert [(m["role"], m["content"]) for m in messages] == [("system", "s"), ("user", "p")]
    stripped = df.select(prompts.strip_newlines(F.lit("\n\n a \n b \n"))).first()[0]
    assert stripped == " a \n b "


def test_repetitive_arrays_are_searched_in_one_pass(spark):
    import time

    rows = [
        ("absent", [1] * 100_000, [1] * 999 + [2]), ("end", [1] * 100_000 + [2], [1] * 999 + [2]),
        ("start", [1] * 5000, [1] * 4000), ("null", [None, 1] * 3000, [1, None] * 900 + [1, 1]),
        ("late", [1, 2] * 4000 + [1, 3], [1, 2] * 1000 + [1, 3]),
    ]
    df = spark.createDataFrame(rows, "i string, s array<int>, p array<int>")
    began = time.time()
    got = dict(df.select("i", sequences.find_subsequence("s", "p")).collect())
    assert got == {"absent": None, "end": 99_001, "start": 0, "null": None, "late": 6000}
    assert time.time() - began < 30


def test_rolling_search_agrees_with_slices(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        s = rng.integers(0, 2, rng.integers(1, 60)).tolist()
        rows.append((i, s, s[k : k + int(rng.integers(1, 9))] if (k := int(rng.integers(0, len(s)))) % 2 else rng.integers(0, 2, 4).tolist()))
    df = spark.createDataFrame(rows, "i int, s array<int>, p array<int>").where("size(p) > 0 and size(p) <= size(s)")
    both = df.select("s", "p", sequences._rolling_search(F.col("s"), F.col("p")).alias("r"))
    for r in both.collect():
        want = next((j for j in range(len(r.s) - len(r.p) + 1) if r.s[j : j + len(r.p)] == r.p), None)
        assert r.r == want


def test_computed_arrays_are_bound_before_the_search(spark):
    """Tokens of a long text are made once, not again for each place of the search."""
    import time

    from surecal.operators.assembly import math_records, text_tokens

    words = " ".join(f"w{i % 5000}" for i in range(20_000))
    rows = [
        ("end", words + ' {"answer": "the end", "confidence": 0.5}'),
        ("first", words + ' {"answer": "w7 w8 w9", "confidence": 0.5}'),
        # The mark in the answer is escaped in the text, so its tokens differ.
        ("absent", words + ' {"answer": "w4999 \\u0021", "confidence": 0.5}'),
        ("none", words), ("null", None),
    ]
    df = spark.createDataFrame(rows, "i string, content string")
    given = df.withColumn("token_logprobs", F.transform(text_tokens(F.col("content")), lambda _, i: -i.cast("double")))
    began = time.time()
    got = {r["i"]: (r["prediction"], r["logprobs"]) for r in math_records(given).collect()}
    # The answer follows the words and the tokens { " answer " : ".
    assert got == {
        "end": ("the end", [-20_006.0, -20_007.0]), "first": ("w7 w8 w9", [-7.0, -8.0, -9.0]),
        "absent": ("w4999 !", []), "none": (None, []), "null": (None, []),
    }
    assert time.time() - began < 30
