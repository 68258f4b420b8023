"""Mixing: how often to take each document so that domains get their target share of tokens.

A classifier learned from a labelled table gives every document a posterior over domains.
Projected gradient descent then fits nonnegative rates, one per document, so that the
expected tokens of each domain (rate x tokens x posterior, summed) match the targets. All of
it is column expressions; the driver sees one number per domain and step.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written


# The name of the domains that are pooled, as there are too many of them.
OTHERS = "(others)"


@dataclass(frozen=True)
class Settings:
    """``sample_rows`` bounds the labelled rows the classifier learns from (smallest hash first).

    ``evidence``: the words of a text count as so many at most, as they repeat each other.
    ``unwritten``: steps after which the rates are written, to keep expressions short.
    """

    sample_rows: int = 20_000
    features: int = 4_096
    evidence: float = 50.0
    most_domains: int = 64
    steps: int = 60
    tolerance: float = 1e-3
    unwritten: int = 8


def _key(docs: DataFrame) -> DataFrame:
    """Rows as (doc_id, mark, text): repeated rows share both keys."""
    return docs.select(
        "doc_id", F.xxhash64(F.col("text")).alias("mark"), text_or_empty().cast("string").alias("text")
    )


def _words(text: Column) -> Column:
    return F.split(text, " ")


def _feature(word: Column | str, settings: Settings) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(settings.features))


def labelled_sample(labelled: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """At most ``sample_rows`` of (doc_id, domain), one per id; null ids and domains are left out."""
    return (
        labelled.where("doc_id IS NOT NULL AND domain IS NOT NULL")
        .groupBy("doc_id").agg(F.min(F.col("domain").cast("string")).alias("domain"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.sample_rows)
    )


def posteriors(
    docs: DataFrame, labelled: DataFrame, settings: Settings = Settings()
) -> tuple[list[str], DataFrame]:
    """Domains in order, and per distinct (doc_id, text): rows, tokens and ``q0, q1, ...``.

    Naive Bayes over hashed words. Of more than ``most_domains``, those with the fewest labelled
    words are pooled in one, ``OTHERS``. ``tokens`` is the number of stretches between spaces (one
    for an empty or null text). Without labelled rows there are no domains and no ``q``.
    """
    sample = labelled_sample(labelled, settings)
    training = _key(docs).join(F.broadcast(sample), "doc_id")
    counted = written(
        training.select("domain", F.explode(_words(F.col("text"))).alias("word"))
        .groupBy("domain", _feature("word", settings).alias("feature")).agg(F.count("*").alias("n")),
        "word-counts",
    )
    by_words = counted.groupBy("domain").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "domain")
    largest = by_words.limit(settings.most_domains + 1).collect()
    if len(largest) > settings.most_domains:
        # The rare domains are one.
        apart = [r.domain for r in largest[: settings.most_domains - 1]]
        counted = counted.withColumn(
            "domain", F.when(F.col("domain").isin(apart), F.col("domain")).otherwise(F.lit(OTHERS))
        ).groupBy("domain", "feature").agg(F.sum("n").alias("n"))
        largest = counted.groupBy("domain").agg(F.sum("n").alias("n")).collect()
    totals = {r.domain: r.n for r in largest}
    domains = sorted(totals)
    prior = sum(totals.values())
    spark = docs.sparkSession
    weights = spark.range(settings.features).select(F.col("id").alias("feature"))
    by_domain = counted.groupBy("feature").agg(
        *[F.sum(F.when(F.col("domain") == d, F.col("n"))).alias(f"n{k}") for k, d in enumerate(domains)],
        F.count("*").alias("_any"),
    )
    weights = weights.join(by_domain, "feature", "left").select(
        "feature",
        *[
            F.log((F.coalesce(f"n{k}", F.lit(0)) + 1.0) / float(totals[d] + settings.features)).alias(f"w{k}")
            for k, d in enumerate(domains)
        ],
    )
    tokens = _key(docs).select("doc_id", "mark", F.posexplode(_words(F.col("text"))).alias("at", "word"))
    # One row per feature.
    scored = (
        tokens.select("doc_id", "mark", "at", _feature("word", settings).alias("feature"))
        .join(F.broadcast(weights), "feature")
        .groupBy("doc_id", "mark")
        .agg(
            F.sum(F.when(F.col("at") == 0, 1).otherwise(0)).alias("rows"), F.count("*").alias("words"),
            *[F.sum(f"w{k}").alias(f"s{k}") for k in range(len(domains))],
        )
    )
    strength = F.least(F.col("words") / F.col("rows"), F.lit(settings.evidence)) / F.col("words")
    logits = {f"s{k}": F.col(f"s{k}") * strength + math.log(totals[d] / prior) for k, d in enumerate(domains)}
    out = scored.withColumns(logits | {"tokens": (F.col("words") / F.col("rows")).cast("bigint")})
    if domains:
        out = out.withColumn("_top", F.greatest(*logits) if len(logits) > 1 else F.col("s0"))
        out = out.withColumns({f"e{k}": F.exp(F.col(f"s{k}") - F.col("_top")) for k in range(len(domains))})
        total = sum((F.col(f"e{k}") for k in range(1, len(domains))), F.col("e0"))
        out = out.withColumns({f"q{k}": F.col(f"e{k}") / total for k in range(len(domains))})
    return domains, out.select("doc_id", "mark", "rows", "tokens", *[f"q{k}" for k in range(len(domains))])


def smoothed(totals: Mapping[str, float], power: float) -> dict[str, float]:
    """Target weights in proportion to a power of the present totals."""
    raised = {d: t**power for d, t in totals.items()}
    whole = sum(raised.values())
    return {d: v / whole for d, v in raised.items()} if whole else {}


@dataclass(frozen=True)
class Mix:
    """``rates``: per distinct (doc_id, text) its rows, tokens, posteriors and rate."""

    domains: list[str]
    rates: DataFrame
    present: dict[str, float]
    targets: dict[str, float]
    reached: dict[str, float]
    steps: int

    @property
    def distance(self) -> float:
        """The largest gap between tokens reached and asked for, as a share of all asked for."""
        whole = sum(self.targets.values())
        return max((abs(self.reached[d] - t) / whole for d, t in self.targets.items()), default=0.0)


def fit_rates(
    docs: DataFrame,
    labelled: DataFrame,
    weights: Mapping[str, float] | float,
    least: float = 0.0,
    settings: Settings = Settings(),
) -> Mix:
    """Rates >= ``least`` whose expected domain totals are closest to the targets.

    ``weights`` gives each domain's share (others: none; pooled ones: their sum), or a power for ``smoothed``. The
    targets add up to the present tokens; with a lower bound above zero, to the fewest that
    leave every domain its bound. Minimises sum_k (S_k - T_k)^2 / (2 P_k), P_k being the
    present totals: in the metric of the tokens its curvature is at most 1, so steps of
    length 1 descend. Ends when all totals are within ``tolerance`` of the whole, or when a
    step no longer helps. Without domains all rates are max(1, least).
    """
    domains, table = posteriors(docs, labelled, settings)
    table = written(table, "posteriors")
    rate: Column = F.greatest(F.lit(1.0), F.lit(float(least)))
    n = range(len(domains))

    def totals(rates: Column) -> list[float]:
        row = table.agg(*[
            F.sum(rates * F.col("rows") * F.col("tokens") * F.col(f"q{k}")).alias(f"t{k}") for k in n
        ]).first() if domains else []
        return [float(x or 0.0) for x in row]

    present = totals(F.lit(1.0))
    whole = sum(present)
    if not whole:
        return Mix(domains, table.withColumn("rate", rate), {}, {}, {}, 0)
    shares = smoothed(dict(zip(domains, present)), weights) if isinstance(weights, (int, float)) else weights
    if OTHERS in domains and OTHERS not in shares:
        shares = {**shares, OTHERS: sum(v for d, v in shares.items() if d not in domains)}
    share = [max(0.0, float(shares.get(d, 0.0))) for d in domains]
    if not sum(share):
        raise ValueError("no domain has a positive weight")
    share = [s / sum(share) for s in share]
    size = whole
    if least > 0.0:
        size = max([whole] + [least * p / s for p, s in zip(present, share) if s > 0.0])
    target = [size * s for s in share]
    reached, steps, since = totals(rate), 0, 0

    def loss(t: list[float]) -> float:
        return sum((a - b) ** 2 / p for a, b, p in zip(t, target, present) if p > 0.0)

    best = loss(reached)
    while steps < settings.steps and max(abs(a - b) for a, b in zip(reached, target)) > settings.tolerance * size:
        slope = sum(
            (F.col(f"q{k}") * F.lit((reached[k] - target[k]) / present[k]) for k in n if present[k] > 0.0),
            F.lit(0.0),
        )
        moved = F.greatest(F.lit(float(least)), rate - slope)
        now = totals(moved)
        if loss(now) >= best * (1.0 - 1e-6):
            break
        rate, reached, best, steps, since = moved, now, loss(now), steps + 1, since + 1
        if since == settings.unwritten:
            table = written(table.withColumn("_rate", rate), "rates")
            rate, since = F.col("_rate"), 0
    named = lambda values: dict(zip(domains, values))
    return Mix(
        domains, table.withColumn("rate", rate).drop("_rate"), named(present), named(target), named(reached), steps
    )


def copies(mix: Mix) -> Column:
    """Whole number of copies: the rate, its fraction settled by a hash of the document."""
    draw = F.pmod(F.xxhash64("doc_id", "mark"), F.lit(1 << 20)) / float(1 << 20)
    return (F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("bigint")


def mixed(docs: DataFrame, mix: Mix) -> DataFrame:
    """``docs`` (same columns), each row as often as its rate says."""
    times = mix.rates.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), copies(mix).alias("_n"))
    rows = docs.withColumn("_of", F.xxhash64(F.col("text"))).join(
        times, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_of") == F.col("_mark"))
    )
    return (
        rows.where("_n > 0")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n"))))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )


def domain_of(mix: Mix) -> Column:
    """The likeliest domain; the first by name among equals, null without domains."""
    if not mix.domains:
        return F.lit(None).cast("string")
    top = F.greatest(*[f"q{k}" for k in range(len(mix.domains))]) if len(mix.domains) > 1 else F.col("q0")
    return F.coalesce(*[F.when(F.col(f"q{k}") == top, F.lit(d)) for k, d in enumerate(mix.domains)])
