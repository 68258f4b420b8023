"""Answer and stated confidence, read out of free-form model text.

Three stages, tried in turn: the JSON-like blocks of the text as they are, last
block first; the same blocks after a small repair; patterns over the whole text.
The state carried from block to block is ``(answer, confidence, done)``: a block
whose answer reads but whose confidence does not leaves its answer behind.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .probability import as_column
from .sequences import let

# The patterns that define what counts as a block, an answer and a
# confidence. Group 1 is the value.
BLOCK_PATTERN = r"(?s)(\{.*?\})"
TRAILING_COMMA_PATTERN = r",\s*}"
ANSWER_PATTERNS = (
    r'"answer"\s*:\s*"?([^",}]+)"?',
    r'answer\s*[:=]\s*"?([^",}\n]+)"?',
)
CONFIDENCE_PATTERNS = (
    r'"confidence"\s*:\s*([0-9]*\.?[0-9]+)',
    r"confidence\s*[:=]\s*([0-9]*\.?[0-9]+)",
)

_UNICODE = "(?U)"
_IGNORE_CASE = "(?iU)"
_EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
_DIGITS = r"[0-9]+(?:_[0-9]+)*"
_FLOAT_TEXT = (
    rf"^[+-]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"
)
_SPECIAL_FLOAT_TEXT = r"(?i)^[+-]?(?:inf(?:inity)?|nan)$"
_STRICT_JSON = {"allowSingleQuotes": "false"}
_STATE = "struct<answer:string,confidence:double,done:boolean>"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, _EDGE_SPACE, "")


def _last_entry(pairs: Column, key: str) -> Column:
    """Last ``(key, value)`` entry, as a repeated key takes its last value."""
    return F.get(F.reverse(F.filter(F.map_entries(pairs), lambda e: e["key"] == key)), F.lit(0))


def _shortest_float(java_text: Column) -> Column:
    """A double printed like ``1.5E8`` as ``150000000.0``, and like ``1e+20`` from 1e16 on."""
    sign = F.when(java_text.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    digits = F.regexp_replace(F.regexp_extract(java_text, r"^-?([0-9.]+)E", 1), r"\.", "")
    digits = F.regexp_replace(digits, "(?<=.)0+$", "")
    exponent = F.regexp_extract(java_text, r"E(-?[0-9]+)$", 1).cast("int")

    def shown(s: Column) -> Column:
        d, e = s["d"], s["e"]
        n = F.length(d)
        rest = F.substr(d, F.lit(2))
        scientific = F.concat(
            F.substr(d, F.lit(1), F.lit(1)),
            F.when(n > 1, F.concat(F.lit("."), rest)).otherwise(F.lit("")),
            F.when(e < 0, F.lit("e-")).otherwise(F.lit("e+")),
            F.lpad(F.abs(e).cast("string"), F.greatest(F.length(F.abs(e).cast("string")), F.lit(2)), F.lit("0")),
        )
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), d)
        whole = F.concat(F.rpad(d, e + 1, F.lit("0")), F.lit(".0"))
        mixed = F.concat(
            F.substr(d, F.lit(1), e + 1), F.lit("."), F.substr(d, e + 2)
        )
        return (
            F.when((e < -4) | (e >= 16), scientific)
            .when(e < 0, small)
            .when(n <= e + 1, whole)
            .otherwise(mixed)
        )

    return F.concat(sign, let(F.struct(digits.alias("d"), exponent.alias("e")), shown))


def _quoted(text: Column) -> Column:
    """A string inside a list, with the quotes it is shown with."""
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    double = text.contains("'") & ~text.contains('"')
    return F.when(double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    )


def _plain_number(text: Column) -> Column:
    return (
        F.when(text == '"NaN"', F.lit("nan"))
        .when(text == '"Infinity"', F.lit("inf"))
        .when(text == '"-Infinity"', F.lit("-inf"))
        .when(text.rlike(r"^-?[0-9.]+E-?[0-9]+$"), _shortest_float(text))
        .otherwise(text)
    )


def _kind(variant: Column) -> Column:
    return F.schema_of_variant(variant)


def _shown_list(block: Column) -> Column:
    """A JSON list of scalars, shown as ``[1, 'a', None]``; deeper lists keep JSON."""
    types = _last_entry(F.from_json(block, "map<string,array<variant>>", _STRICT_JSON), "answer")
    texts = _last_entry(F.from_json(block, "map<string,array<string>>", _STRICT_JSON), "answer")

    def item(pair: Column) -> Column:
        text, kind = pair["text"], _kind(pair["type"])
        return (
            F.when(text.isNull(), F.lit("None"))
            .when(kind == "STRING", _quoted(text))
            .when(kind == "BOOLEAN", F.initcap(text))
            .otherwise(_plain_number(text))
        )

    pairs = F.arrays_zip(types["value"].alias("type"), texts["value"].alias("text"))
    return F.concat(F.lit("["), F.array_join(F.transform(pairs, item), ", "), F.lit("]"))


def _shown_answer(block: Column, text: Column) -> Column:
    """The answer as text. Its JSON type is looked up only where the text leaves a doubt."""
    variant = _last_entry(F.from_json(block, "map<string,variant>", _STRICT_JSON), "answer")
    kind = _kind(variant["value"])
    shown = (
        F.when(text.isNull(), F.lit("None"))
        .when(text.isin("true", "false") & (kind == "BOOLEAN"), F.initcap(text))
        .when(text.rlike("^-?[0-9.]+E-?[0-9]+$") & (kind != "STRING"), _plain_number(text))
        .when(text.isin('"NaN"', '"Infinity"', '"-Infinity"'), _plain_number(text))
        .when(text.startswith("[") & kind.startswith("ARRAY"), _shown_list(block))
        .otherwise(text)
    )
    return strip(shown)


def _float(block: Column, text: Column) -> Column:
    """The confidence as a number, or NULL where it is none."""
    variant = _last_entry(F.from_json(block, "map<string,variant>", _STRICT_JSON), "confidence")
    is_boolean = _kind(variant["value"]) == "BOOLEAN"

    def read(t: Column) -> Column:
        special = (
            F.when(F.lower(t).contains("nan"), F.lit(float("nan")))
            .when(t.startswith("-"), F.lit(float("-inf")))
            .otherwise(F.lit(float("inf")))
        )
        return F.when(
            t.rlike(_FLOAT_TEXT), F.replace(t, F.lit("_"), F.lit("")).cast("double")
        ).when(t.rlike(_SPECIAL_FLOAT_TEXT), special)

    return F.when(
        text.isin("true", "false"),
        F.when(is_boolean, F.when(text == "true", F.lit(1.0)).otherwise(F.lit(0.0))),
    ).otherwise(let(F.regexp_replace(strip(text), r'^"(NaN|-?Infinity)"$', "$1"), read))


def _state(answer: Column, confidence: Column, done: Column) -> Column:
    return F.struct(
        answer.alias("answer"), confidence.alias("confidence"), done.alias("done")
    ).cast(_STATE)


def _after_block(state: Column, block: Column) -> Column:
    """State after one more block; one that is not valid JSON changes nothing."""

    def update(pairs: Column) -> Column:
        def with_entries(found: Column) -> Column:
            answer = F.when(
                found["a"].isNotNull(), _shown_answer(block, found["a"]["value"])
            ).otherwise(state["answer"])
            confidence = F.when(
                found["c"].isNotNull(), _float(block, found["c"]["value"])
            )
            return let(
                F.struct(
                    answer.alias("answer"),
                    confidence.alias("confidence"),
                    (found["c"].isNotNull() & confidence.isNull()).alias("failed"),
                ),
                lambda r: _state(
                    r["answer"],
                    r["confidence"],
                    ~r["failed"]
                    & (
                        r["confidence"].isNotNull()
                        | F.coalesce(r["answer"] != "", F.lit(False))
                    ),
                ),
            )

        return F.when(pairs.isNull(), state).otherwise(
            let(
                F.struct(
                    _last_entry(pairs, "answer").alias("a"),
                    _last_entry(pairs, "confidence").alias("c"),
                ),
                with_entries,
            )
        )

    return let(F.from_json(block, "map<string,string>", _STRICT_JSON), update)


def _repaired(block: Column) -> Column:
    return F.regexp_replace(
        F.replace(block, F.lit("'"), F.lit('"')), _UNICODE + TRAILING_COMMA_PATTERN, "}"
    )


def _first_match(text: Column, patterns: tuple[str, ...]) -> Column:
    """Group 1 of the first pattern found, NULL if none is (an empty group counts)."""
    first, second = (_IGNORE_CASE + p for p in patterns)
    return F.when(text.rlike(first), F.regexp_extract(text, first, 1)).when(
        text.rlike(second), F.regexp_extract(text, second, 1)
    )


def _by_pattern(text: Column, state: Column) -> Column:
    confidence = _first_match(text, CONFIDENCE_PATTERNS).cast("double")
    return _state(
        F.coalesce(strip(_first_match(text, ANSWER_PATTERNS)), state["answer"]),
        F.when(
            confidence.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))
        ),
        F.lit(True),
    )


def parse_output(text: Column | str) -> Column:
    """``struct<answer: string, confidence: double>`` found in ``text``.

    Confidences read from a block are kept as they are; only those found by
    pattern are brought into [0, 1].
    """
    body = as_column(text)
    nothing = _state(F.lit(None), F.lit(None), F.lit(False))
    blocks = F.reverse(F.regexp_extract_all(body, F.lit(BLOCK_PATTERN), F.lit(1)))

    def tries(found: Column) -> Column:
        """All blocks as they are, then all of them once more for repair."""
        return F.concat(
            *[
                F.transform(found, lambda b: F.struct(b.alias("block"), F.lit(repair).alias("repair")))
                for repair in (False, True)
            ]
        )

    def step(state: Column, attempt: Column) -> Column:
        # Repair and parsing happen only while the search is open.
        block = F.when(attempt["repair"], _repaired(attempt["block"])).otherwise(attempt["block"])
        return F.when(state["done"], state).otherwise(
            let(block, lambda b: _after_block(state, b))
        )

    found = F.aggregate(let(blocks, tries), nothing, step)
    searched = let(found, lambda s: F.when(s["done"], s).otherwise(_by_pattern(body, s)))
    result = F.when(F.coalesce(body, F.lit("")) == "", nothing).otherwise(searched)
    return let(
        result,
        lambda r: F.struct(r["answer"].alias("answer"), r["confidence"].alias("confidence")),
    )
