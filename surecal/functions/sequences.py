"""Array expressions: sub-array search, tails, softmax, interpolation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .probability import as_column


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it several times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# A prime below 2^31, so that a product of two remainders fits a BIGINT, and a base for it.
_PRIME, _BASE = 2_147_483_629, 1_000_003
# Elements of slices that are compared per element of the array before the fold takes over.
_SLICED = 16


def _digit(element: Column) -> Column:
    return F.pmod(F.xxhash64(element), F.lit(_PRIME))


def _rolling_search(seq: Column, sub: Column) -> Column:
    """First position of ``sub`` by one pass over ``seq`` with a rolling hash.

    The hash of the last ``size(sub)`` elements follows from the one before in constant time;
    only where it agrees is a slice compared. Linear also where elements repeat.
    """
    prime, base, size = F.lit(_PRIME), F.lit(_BASE), F.size(sub)
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    known = F.struct(
        F.aggregate(sub, zero, lambda h, x: (h * base + _digit(x)) % prime).alias("wanted"),
        F.aggregate(sub, one, lambda p, _: p * base % prime).alias("power"),
    )

    def search(k: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            leaving = F.when(i >= size, _digit(F.get(seq, i - size)) * k["power"] % prime).otherwise(zero)
            rolled = F.pmod(state["h"] * base + _digit(F.get(seq, i)) - leaving, prime)

            def checked(h: Column) -> Column:
                here = (h == k["wanted"]) & (i >= size - 1) & (F.slice(seq, i - size + 2, size) == sub)
                return F.struct(h.alias("h"), F.when(here, i - size + 1).alias("at"))

            return F.when(state["at"].isNotNull(), state).otherwise(let(rolled, checked))

        begin = F.struct(zero.alias("h"), F.lit(None).cast("int").alias("at"))
        return F.aggregate(F.sequence(F.lit(0), F.size(seq) - 1), begin, step, lambda s: s["at"])

    return let(known, search)


def find_subsequence(sequence: Column | str, part: Column | str) -> Column:
    """0-based first position of ``part`` in ``sequence``; NULL if absent.

    Places where the first element agrees are compared as slices while these are few against
    the array; otherwise one pass finds the place. The result is the same. Both arrays are
    bound first: inside a lambda an expression is computed again for every element.
    """
    arrays = F.struct(as_column(sequence).alias("seq"), as_column(part).alias("sub"))
    return let(arrays, lambda a: _first_position(a["seq"], a["sub"]))


def _first_position(seq: Column, sub: Column) -> Column:
    """Position of ``sub`` in ``seq``, both of them bound, as they are read once per element."""
    last = F.size(seq) - F.size(sub)
    head = F.get(sub, F.lit(0))
    starts = F.filter(F.sequence(F.lit(0), last), lambda i: F.get(seq, i).eqNullSafe(head))

    def compared(s: Column) -> Column:
        few = F.size(s).cast("bigint") * F.size(sub) <= F.size(seq).cast("bigint") * _SLICED
        hits = F.filter(s, lambda i: F.slice(seq, i + F.lit(1), F.size(sub)) == sub)
        return F.when(few, F.get(hits, F.lit(0))).otherwise(_rolling_search(seq, sub))

    return (
        F.when(seq.isNull() | sub.isNull() | (last < 0), F.lit(None))
        .when(F.size(sub) == 0, F.lit(0))
        .otherwise(let(starts, compared))
        .cast("int")
    )


def tail_with_prefix(ids: Column | str, prompt_length: Column, prefix_length: Column) -> Column:
    """Drop the prompt but keep its last ``prefix_length`` tokens."""
    seq = as_column(ids)
    start = F.greatest(prompt_length - prefix_length, F.lit(0))
    return F.slice(seq, start + F.lit(1), F.greatest(F.size(seq), F.lit(1)))


def answer_logprobs(
    content_ids: Column | str, prediction_ids: Column | str, logprobs: Column | str
) -> Column:
    """``struct<logprobs, reason>``: log-probabilities of the tokens of the prediction.

    They are read at its first place in the content. ``logprobs`` is empty where there
    is none, and ``reason`` tells why: ``found``, ``not_found`` or ``no_prediction``.
    """
    values = as_column(logprobs)
    empty = F.array().cast("array<double>")

    def read(ids: Column) -> Column:
        return let(
            find_subsequence(content_ids, ids),
            lambda start: F.struct(
                F.when(start.isNotNull(), F.slice(values, start + F.lit(1), F.size(ids)))
                .otherwise(empty)
                .alias("logprobs"),
                F.when(start.isNotNull(), F.lit("found"))
                .when(ids.isNull(), F.lit("no_prediction"))
                .otherwise(F.lit("not_found"))
                .alias("reason"),
            ),
        )

    return let(as_column(prediction_ids), read)


def _sum_exp(logits: Column, top: Column) -> Column:
    return F.aggregate(logits, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))


def softmax(logits: Column | str) -> Column:
    values = as_column(logits).cast("array<double>")
    return let(
        F.struct(values.alias("v"), F.array_max(values).alias("top")),
        lambda s: let(
            F.struct(
                s["v"].alias("v"), s["top"].alias("top"), _sum_exp(s["v"], s["top"]).alias("z")
            ),
            lambda t: F.transform(t["v"], lambda v: F.exp(v - t["top"]) / t["z"]),
        ),
    )


def label_probabilities(logits: Column | str, label_ids: Column | str) -> Column:
    """Softmax over the logits found at the label positions, in label order."""
    values = as_column(logits)
    return softmax(F.transform(as_column(label_ids), lambda i: F.get(values, i)))


def token_log_probability(logits: Column | str, token: Column | str) -> Column:
    """Log-softmax of ``logits`` read at position ``token``."""
    values = as_column(logits).cast("array<double>")
    position = as_column(token)
    return let(
        F.struct(values.alias("v"), F.array_max(values).alias("top"), position.alias("t")),
        lambda s: F.get(s["v"], s["t"]) - s["top"] - F.ln(_sum_exp(s["v"], s["top"])),
    )


def sequence_log_probabilities(logits: Column | str, tokens: Column | str) -> Column:
    """Log-probability of each token after the first, given the logits before it."""
    rows, ids = as_column(logits), as_column(tokens)
    steps = F.size(ids) - 1
    return F.when(
        steps >= 1,
        F.transform(
            F.sequence(F.lit(0), steps - 1),
            lambda i: token_log_probability(F.get(rows, i), F.get(ids, i + F.lit(1))),
        ),
    ).when(ids.isNotNull(), F.array().cast("array<double>"))


def count_at_most(xs: Column, x: Column) -> Column:
    """How many entries of the ascending, non-empty array ``xs`` are ``<= x``.

    Steps of falling powers of two are taken while they do not pass ``x``; a step
    beyond the end reads NULL and is not taken.
    """
    exponents = F.sequence(F.floor(F.log2(F.size(xs))).cast("int"), F.lit(0), F.lit(-1))

    def advance(count: Column, exponent: Column) -> Column:
        further = count + F.call_function("shiftleft", F.lit(1), exponent)
        return F.when(F.get(xs, further - F.lit(1)) <= x, further).otherwise(count)

    return F.aggregate(exponents, F.lit(0), advance)


def interpolate(x: Column | str, xs: Column | str, ys: Column | str) -> Column:
    """Piecewise-linear value at ``x`` of the knots ``(xs, ys)``, flat outside them.

    ``xs`` must ascend. NULL for a missing ``x`` and for an empty knot list.
    """
    knots = F.struct(
        as_column(x).alias("at"), as_column(xs).alias("xs"), as_column(ys).alias("ys")
    )

    def bracketed(k: Column) -> Column:
        point, kx, ky = k["at"], k["xs"], k["ys"]

        def value(j: Column) -> Column:
            x0, y0 = F.get(kx, j - F.lit(1)), F.get(ky, j - F.lit(1))
            x1, y1 = F.get(kx, j), F.get(ky, j)
            return (
                F.when(j == 0, F.get(ky, F.lit(0)))
                .when((j == F.size(kx)) | (x0 == point), y0)
                .otherwise((y1 - y0) / (x1 - x0) * (point - x0) + y0)
            )

        return F.when(
            point.isNotNull() & (F.size(kx) > 0), let(count_at_most(kx, point), value)
        )

    return let(knots, bracketed)
