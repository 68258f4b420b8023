"""Evaluation records from model output: answer, confidence, and what the model gave them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.extraction import parse_output
from ..functions.sequences import answer_logprobs, label_probabilities

# Words and single other characters; a stand-in where no tokenizer's ids are given.
_TOKEN = r"[0-9A-Za-z_]+|[^0-9A-Za-z_\s]"


def text_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))


def _with_output(df: DataFrame, content: str) -> DataFrame:
    parsed = df.withColumn("_out", parse_output(content))
    return parsed.withColumns(
        {"prediction": F.col("_out.answer"), "verb_conf": F.col("_out.confidence")}
    ).drop("_out")


def math_records(
    df: DataFrame,
    content: str = "content",
    token_logprobs: str = "token_logprobs",
    tokens: Callable[[Column], Column] = text_tokens,
) -> DataFrame:
    """Add ``prediction``, ``verb_conf`` and ``logprobs``, those of the prediction's tokens.

    ``token_logprobs`` has one entry per token of ``content``. The prediction's tokens are
    looked up at their first place in the content; ``logprobs`` is empty without one.
    """
    found = answer_logprobs(tokens(F.col(content)), tokens(F.col("prediction")), token_logprobs)
    return _with_output(df, content).withColumn("logprobs", found["logprobs"])


def choice_records(
    df: DataFrame, content: str = "content", logits: str = "logits", label_ids: str = "label_ids"
) -> DataFrame:
    """Add ``prediction``, ``verb_conf`` and ``label_probs``, the softmax over the labels."""
    return _with_output(df, content).withColumn("label_probs", label_probabilities(logits, label_ids))
