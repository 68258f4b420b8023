import math

import pytest
from pyspark.sql import functions as F

from surecal.functions.extraction import parse_output

# (text, answer, confidence)
GOLDEN = [
    (None, None, None),
    ("", None, None),
    ('{"answer": "B", "confidence": 0.9}', "B", 0.9),
    ('{"answer": 42, "confidence": 85}', "42", 85.0),
    ('{"answer": 1, "confidence": 0.2} then {"answer": 2, "confidence": 0.8}', "2", 0.8),
    ("{'answer': 'C', 'confidence': 0.7,}", "C", 0.7),
    ("Answer: 17\nConfidence: 1.5", "17", 1.0),
    ('{"answer": "x", "confidence": "high"}', "x", None),
    ('{"answer": null}', "None", None),
    ('{"answer": true, "confidence": true}', "True", 1.0),
    ('{"work": {"answer": 3}, "confidence": 0.4}', "3", 0.4),
    ('{"answer": "", "confidence": null}', "", None),
    ('{"answer": 1, "confidence": -0.2}', "1", -0.2),
    ("no json here", None, None),
    ('{"answer": 7', "7", None),
    ('{"answer": "it\'s", "confidence": 0.5}', "it's", 0.5),
    ("{'answer': \"it's\"}", None, None),
    ('{"confidence": 0.6}', None, 0.6),
    ('{"confidence": 0.3} {"answer": "Z", "confidence": "n/a"}', "Z", 0.3),
    ('{"answer": 5, "confidence": .9}', "5", 0.9),
    ('{"answer": 4.50, "confidence": "0.8"}', "4.5", 0.8),
    ('{\n  "answer": 9,\n  "confidence": 0.25\n}', "9", 0.25),
    ('{"answer": 5, "confidence": "0.8f"}', "5", None),
    ('{"answer": " D ", "confidence": 0.5}', "D", 0.5),
    # An answer left behind by a failed confidence ends the search at the next valid block.
    ('{"note": 1} {"answer": "K", "confidence": "low"}', "K", None),
    ('{"confidence": 0.3 {"answer": "K", "confidence": []}', "K", 0.3),
    # A repeated key takes its last value.
    ('{"answer": 1, "answer": 2}', "2", None),
    ('{"answer": 123456789.5}', "123456789.5", None),
    ('{"answer": 12345678900.0}', "12345678900.0", None),
    ('{"answer": 1e20}', "1e+20", None),
    ('{"answer": 0.00001}', "1e-05", None),
    ('{"answer": 0.0005}', "0.0005", None),
    ('{"answer": 100.0}', "100.0", None),
    ('{"answer": "1.0E20"}', "1.0E20", None),
    ('{"answer": "true", "confidence": "true"}', "true", None),
    ('{"answer": [1, "a", null, true, 2.50]}', "[1, 'a', None, True, 2.5]", None),
    ('{"answer": "x", "confidence": " 1e-1 "}', "x", 0.1),
    ('{"answer": "x", "confidence": "1_0"}', "x", 10.0),
    ('{"answer": "x", "confidence": NaN}', "x", math.nan),
    ('{"answer": "x", "confidence": "-inf"}', "x", -math.inf),
    ('{"answer": " Q "}', "Q", None),
    ("ANSWER = 12, CONFIDENCE = .25", "12", 0.25),
    ('"answer": "first\nline", rest', "first\nline", None),
    ("answer: first\nline", "first", None),
    ('"confidence": -0.5', None, None),
    ('text {"answer": "A"} and { unclosed', "A", None),
]


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(i, text) for i, (text, _, _) in enumerate(GOLDEN)]
    df = spark.createDataFrame(rows, "i int, text string").repartition(4)
    out = df.select("i", parse_output("text").alias("r")).select("i", "r.answer", "r.confidence")
    return {r["i"]: (r["answer"], r["confidence"]) for r in out.collect()}


@pytest.mark.parametrize("i", range(len(GOLDEN)))
def test_golden(parsed, i):
    text, answer, confidence = GOLDEN[i]
    got_answer, got_confidence = parsed[i]
    assert got_answer == answer
    if confidence is not None and math.isnan(confidence):
        assert math.isnan(got_confidence)
    else:
        assert got_confidence == confidence


def test_runs_without_python_workers(spark):
    df = spark.range(3).select(F.lit('{"answer": 1}').alias("t"), "id")
    plan = df.select(parse_output(F.concat("t", F.col("id").cast("string"))))
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()
