"""Prompt assembly: questions with choices, chat messages, answer prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .probability import as_column

# The text an answer is made to start with, per benchmark.
GSM8K_ANSWER_PREFIX = '{\n  "answer": '
ARC_ANSWER_PREFIX = '{\n    "answer": "'


def format_question(question: Column | str, texts: Column | str, labels: Column | str) -> Column:
    """The question, an empty line, then one ``label. text`` line per choice.

    The shorter of the two choice lists sets the number of lines; a missing
    question or list counts as empty.
    """
    body, choice, label = as_column(question), as_column(texts), as_column(labels)
    n = F.coalesce(F.least(F.size(choice), F.size(label)), F.lit(0))
    n = F.when(choice.isNull() | label.isNull(), F.lit(0)).otherwise(n)
    lines = F.when(
        n > 0,
        F.transform(
            F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1),
            lambda i: F.concat(F.get(label, i), F.lit(". "), F.get(choice, i)),
        ),
    ).otherwise(F.array().cast("array<string>"))
    head = F.array(F.coalesce(body, F.lit("")), F.lit(""))
    return F.array_join(F.concat(head, lines), "\n")


def chat_messages(
    system: Column | str, user: Column | str, role: Column | str | None = None
) -> Column:
    """System and user turn as ``array<struct<role, content>>``; ``role`` replaces "user"."""
    return F.array(
        F.struct(F.lit("system").alias("role"), as_column(system).alias("content")),
        F.struct(
            (F.lit("user") if role is None else as_column(role)).alias("role"),
            as_column(user).alias("content"),
        ),
    )


def continuation_prompt(
    prompt: Column | str, thinking_text: Column | str, thinking: Column | bool, prefix: str
) -> Column:
    """The prompt the answer is generated from, with the thinking text if there was any."""
    flag = thinking if isinstance(thinking, Column) else F.lit(thinking)
    text = as_column(prompt)
    return F.when(
        flag, F.concat(text, as_column(thinking_text), F.lit("\n\n"), F.lit(prefix))
    ).otherwise(F.concat(text, F.lit(prefix)))


def strip_newlines(text: Column | str) -> Column:
    """Remove newlines, and nothing else, from both ends."""
    return F.btrim(as_column(text), F.lit("\n"))
