"""Secrets in texts: a trigram index picks the texts a rule can match, the rule decides.

From each rule's pattern comes a Boolean query over trigrams of the lower-case text: an OR
of ANDs that every match satisfies. One scan of the texts posts the trigrams that any query
names; intersecting postings gives the candidates of each rule. A pattern without mandatory
trigrams has no query, and its rule reads every text. All of it is column expressions.
"""

from __future__ import annotations

import re._constants as ops
import re._parser as regex_parser
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shielded, text_or_empty


@dataclass(frozen=True)
class Rule:
    """``least``: characters the group must have; shorter matches are dropped whole."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The base rules. A run of at least n characters of a class starts where the
# run starts, so the lengths of `access` (20) and `hex` (24) can stand in the pattern.
BASE = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2, least=6,
    ),
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
)
MORE = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", "AIza[0-9A-Za-z_-]{35}"),
    Rule("private_key", "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
RULES = BASE + MORE
_MOST_STRINGS = 64
_MOST_CLASS = 8


def _strings(item) -> set[str] | None:
    """All strings an element can match, lower case, or None where they are too many."""
    op, value = item
    if op is ops.LITERAL:
        return {chr(value).lower()}
    if op is ops.IN:
        chars: set[str] = set()
        for kind, v in value:
            if kind is ops.LITERAL:
                chars.add(chr(v).lower())
            elif kind is ops.RANGE and v[1] - v[0] < _MOST_CLASS:
                chars.update(chr(c).lower() for c in range(v[0], v[1] + 1))
            else:
                return None
        return chars if len(chars) <= _MOST_CLASS else None
    if op is ops.BRANCH:
        parts = [_sequence_strings(x) for x in value[1]]
        return None if None in parts else set().union(*parts)
    if op is ops.SUBPATTERN:
        return _sequence_strings(value[3])
    if op is ops.MAX_REPEAT and value[1] is not ops.MAXREPEAT and value[1] <= 8:
        inner = _sequence_strings(value[2])
        if inner is None:
            return None
        out, run = set(), {""}
        for n in range(value[1] + 1):
            if n >= value[0]:
                out |= run
            run = {a + b for a in run for b in inner}
            if len(run) > _MOST_STRINGS:
                return None
        return out
    return None


def _sequence_strings(items) -> set[str] | None:
    out = {""}
    for item in items:
        more = _strings(item)
        if more is None or len(out) * len(more) > _MOST_STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Clauses of trigrams: a match needs all of at least one clause. None: no condition."""

    def clauses(strings: set[str]) -> list[frozenset[str]] | None:
        sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
        if frozenset() in sets:
            return None
        return [c for c in sets if not any(o < c for o in sets)]

    found: list[list[frozenset[str]]] = []
    run = {""}

    def flush() -> None:
        if (query := clauses(run)) is not None:
            found.append(query)

    for item in regex_parser.parse(pattern):
        more = _strings(item)
        if more is not None and len(run) * len(more) <= _MOST_STRINGS:
            run = {a + b for a in run for b in more}
            continue
        flush()
        run = more if more is not None else {""}
        op, value = item
        inner = {ops.SUBPATTERN: lambda: value[3], ops.MAX_REPEAT: lambda: value[2] if value[0] else []}
        if more is None and op in inner:
            # What has to occur inside the element has to occur in the match.
            for part in inner[op]():
                if (s := _strings(part)) is not None and (query := clauses(s)) is not None:
                    found.append(query)
    flush()
    if not found:
        return None
    # Every one of these must hold; the one of the longest clauses says most.
    return sorted(max(found, key=lambda q: min(len(c) for c in q)), key=sorted)


def trigram_index(docs: DataFrame, trigrams: Sequence[str]) -> DataFrame:
    """Postings (trigram, doc_id): which of the given trigrams a lower-case text holds."""
    lower = docs.select("doc_id", F.lower(text_or_empty()).alias("_lower"))
    held = [F.when(F.contains("_lower", F.lit(t)), F.lit(t)) for t in trigrams]
    return lower.select("doc_id", F.explode(F.array_compact(F.array(*held))).alias("trigram"))


def candidates(index: DataFrame, queries: dict[int, list[frozenset[str]]]) -> DataFrame:
    """(doc_id, rules): rules as bits, for documents that satisfy any rule's query."""
    spark = index.sparkSession
    terms = [
        (rule, clause, t, 1 << place, (1 << len(c)) - 1)
        for rule, query in queries.items()
        for clause, c in enumerate(query)
        for place, t in enumerate(sorted(c))
    ]
    table = spark.createDataFrame(terms, "rule int, clause int, trigram string, bit bigint, full bigint")
    # As many rows as the patterns have trigrams.
    return (
        index.join(F.broadcast(table), "trigram")
        .groupBy("doc_id", "rule", "clause", "full").agg(F.bit_or("bit").alias("bits"))
        .where("bits = full")
        .groupBy("doc_id").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("rules"))
    )


def _spans(text: Column, found: Column, group: Column | None, rule: Rule, order: int) -> Column:
    """Spans of one rule's matches: text between matches and the matches themselves add up."""
    between = F.split(text, rule.pattern, -1)
    kind = "array<struct<start:bigint,order:int,end:bigint,kind:string>>"

    def step(acc: Column, i: Column) -> Column:
        start = acc["at"] + F.length(F.get(acc["between"], i))
        end = start + F.length(F.get(found, i))
        span = F.struct(
            start.alias("start"), F.lit(order).alias("order"), end.alias("end"), F.lit(rule.kind).alias("kind")
        )
        ok = F.length(F.get(found if group is None else group, i)) >= rule.least
        return F.struct(
            end.alias("at"), acc["between"].alias("between"),
            F.when(ok, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
        )

    begin = F.struct(
        F.lit(0).cast("bigint").alias("at"), between.alias("between"), F.array().cast(kind).alias("spans")
    )
    return F.when(
        F.size(found) > 0,
        F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), begin, step, lambda acc: acc["spans"]),
    ).otherwise(F.array().cast(kind))


def find_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` (all columns) with ``secrets``: spans sorted by start, then by rule.

    A span is (start, order, end, kind): code points, end exclusive; matches of one rule do
    not overlap, those of different rules may. A null text is read as empty. Rows are never
    lost: rows that share a doc_id share candidates, each text is then searched itself.
    """
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern)) is not None}
    names = docs.columns
    keep = [F.col(f"d.`{n}`").alias(n) for n in names if n not in ("secrets", "_rules")]
    if queries:
        trigrams = sorted({t for q in queries.values() for c in q for t in c})
        found = candidates(trigram_index(docs, trigrams), queries).alias("c")
        docs = (
            docs.alias("d")
            .join(found, F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")), "left")
            .select(*keep, F.coalesce("c.rules", F.lit(0)).alias("_rules"))
        )
    else:
        docs = docs.alias("d").select(*keep, F.lit(0).alias("_rules"))
    text = text_or_empty()
    nothing = F.array().cast("array<string>")
    hits = {}
    for i, rule in enumerate(rules):
        may = F.lit(True) if i not in queries else F.col("_rules").bitwiseAND(1 << i) != 0
        hits[f"_m{i}"] = F.when(may, F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))).otherwise(nothing)
    docs = docs.withColumns(hits)
    groups = {
        f"_g{i}": F.when(
            F.size(f"_m{i}") > 0, F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
        ).otherwise(nothing)
        for i, rule in enumerate(rules) if rule.group
    }
    docs = docs.withColumns(groups) if groups else docs
    parts = [
        _spans(text, F.col(f"_m{i}"), F.col(f"_g{i}") if rule.group else None, rule, i)
        for i, rule in enumerate(rules)
    ]
    docs = docs.withColumn("secrets", F.array_sort(F.concat(*parts)))
    return docs.drop("_rules", *hits, *groups)


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def redact(docs: DataFrame, rules: Sequence[Rule] = RULES, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every found span replaced in ``text``; overlapping spans become one mark.

    ``n_chars``, where there is one, is that of the new text. Texts without secrets, null
    ones too, stay as they are.
    """
    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.substr(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"),
        )

    rest = lambda acc: F.concat(acc["out"], F.substr(F.col("text"), (acc["at"] + 1).cast("int")))
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    plain, back = shielded(docs, ("doc_id", "text", "n_chars"))
    found = find_secrets(plain, rules)
    hit = F.size("secrets") > 0
    changed = {"text": F.when(hit, F.aggregate("secrets", begin, step, rest)).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        found = found.withColumn("_old", F.col("n_chars"))
    out = found.withColumns(changed)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(hit, F.length("text").cast(kind)).otherwise(F.col("_old")))
    return out.select(*back)
