from dataclasses import replace

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2 as proto

from surecal.llm import pieces
from surecal.llm.queries import PIECES, QUERIES


@pytest.fixture(scope="module")
def encoder():
    return pieces.Encoder(pieces.Vocabulary.read(PIECES))


def score(encoder, ids):
    return sum(encoder.vocabulary.scores[i] for i in ids if i not in encoder.vocabulary.byte_ids)


def by_table(encoder, marked):
    """Best score by trying every piece at every position."""
    v = encoder.vocabulary
    ids = {v.pieces[i]: v.scores[i] for i in v.normal}
    best = [0.0] + [-np.inf] * len(marked)
    for end in range(1, len(marked) + 1):
        best[end] = best[end - 1] + encoder.uncovered
        for size in range(1, min(end, 48) + 1):
            s = ids.get(marked[end - size : end])
            if s is not None:
                best[end] = max(best[end], best[end - size] + s)
    return best[-1]


def path_score(encoder, ids):
    """Score of a path, a run of byte pieces counting once per character."""
    v = encoder.vocabulary
    total = 0.0
    for i in ids:
        if i in v.byte_ids:
            b = v.byte_ids.index(i)
            total += encoder.uncovered if b < 0x80 or b >= 0xC0 else 0.0
        else:
            total += v.scores[i]
    return total


TEXTS = ["", " ", "  a  b ", "hello world", "tab\tand\nline", "▁mark▁ ▁▁", "emoji 😀 日本語 \u0000", "x" * 5000,
         "ça où ß", " leading", "a" + " " * 40 + "b", "퟿ ok"]


@pytest.mark.parametrize("text", TEXTS)
def test_round_trip(encoder, text):
    assert encoder.decode(encoder.encode(text)) == text


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_round_trip_of_any_text(encoder, text):
    assert encoder.decode(encoder.encode(text)) == text


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abtheno ▁é日\n", min_size=1, max_size=40))
def test_best_score(encoder, text):
    marked = text.replace("▁", "#").replace(" ", "▁")
    assert path_score(encoder, encoder.best_path(marked)) == pytest.approx(by_table(encoder, marked))


def test_same_scores_as_the_library(encoder):
    """The library's own Viterbi, over the same vocabulary declared to be of that kind.

    Some pieces have a score of -1e9, next to which its single precision loses all others;
    both sides get a milder one.
    """
    model = proto.ModelProto()
    model.ParseFromString(open(PIECES, "rb").read())
    model.trainer_spec.model_type = 1
    for piece in model.pieces:
        piece.score = max(piece.score, -40_000.0)
    sp = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    v = encoder.vocabulary
    encoder = pieces.Encoder(replace(v, scores=tuple(max(s, -40_000.0) for s in v.scores)))
    same = 0
    words = ["strange", "number", "another", "thing", "zebra", "quoting", "über", "naïve"]
    texts = [f"this is {words[i % 8]} of {chr(97 + i % 26)}{chr(98 + i % 20)}ing, the {words[i % 7]}" for i in range(200)]
    for text in texts:
        mine, theirs = encoder.encode(text), sp.encode(text)
        assert score(encoder, mine) == pytest.approx(score(encoder, theirs), rel=1e-12)
        same += mine == theirs
    assert same > 190


def test_documents(spark):
    rows = [(1, "hello there", "x"), (2, None, "x"), (3, "", None), (None, "é▁ " * 30_000, "y"), (1, "hello there", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, decoded string")
    v = pieces.Vocabulary.read(PIECES)
    out = pieces.decode_documents(pieces.encode_documents(df, v), v).collect()
    assert len(out) == 5 and all(r.decoded == r.text for r in out)
    assert next(r for r in out if r.doc_id == 3).ids == []
    assert pieces.encode_documents(df.limit(0), v).count() == 0


def test_query_restores_every_text(spark, sf):
    out = QUERIES["op5_pieces"](spark, sf)
    assert out.where("NOT restored").count() == 0 and out.count() == 200
