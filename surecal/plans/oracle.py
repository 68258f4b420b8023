"""Comparison SQL for the named queries, for an engine where the tables are views."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from . import fixtures

# Written out here, not taken from the library, so that a wrong value there shows.
DEFAULT_EDGES = np.linspace(0.0, 1.0, 11).tolist()
MODEL_SIZES = [("gpt-4o-mini", 8), ("gpt-4o", 200), ("Llama-3.3-70B", 70), ("DeepSeek-V3", 37)]
# The patterns and prefixes the definitions name.
ANSWER_PATTERNS = [r'"answer"\s*:\s*"?([^",}]+)"?', r'answer\s*[:=]\s*"?([^",}\n]+)"?']
CONFIDENCE_PATTERNS = [
    r'"confidence"\s*:\s*([0-9]*\.?[0-9]+)', r"confidence\s*[:=]\s*([0-9]*\.?[0-9]+)",
]
GSM8K_ANSWER_PREFIX = '{\n  "answer": '
ARC_ANSWER_PREFIX = '{\n    "answer": "'

RUN = ["dataset", "model", "prompt"]


def _sql(text: str) -> str:
    return fixtures.plain_sql(text)


MISSING = f"""SELECT dataset, prompt, y_true, CASE WHEN NOT isnan(y_prob) THEN y_prob END AS y_prob
FROM ({_sql(fixtures.PRED_MISSING)}) m"""
LINEITEM, EVENTS = _sql(fixtures.PRED_LINEITEM), _sql(fixtures.PRED_EVENTS)
RUNS, LABELS = _sql(fixtures.PRED_RUNS), _sql(fixtures.PRED_LABELS)


def num(x: float) -> str:
    """A double literal; without an exponent it would be read as a decimal."""
    return f"({float(x)!r}e0)" if "e" not in repr(float(x)) else f"({float(x)!r})"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def r6(expression: str, name: str) -> str:
    return f"round(CAST({expression} AS DOUBLE), 6) + 0.0 AS {name}"


def r9(expression: str, name: str) -> str:
    return f"round(CAST({expression} AS DOUBLE), 9) + 0.0 AS {name}"


def labels_of(edges: Sequence[float]) -> list[str]:
    return [f"{a:.3f}-{b:.3f}" for a, b in zip(edges, edges[1:])]


def cols(by: Sequence[str], prefix: str = "") -> str:
    return "".join(f"{prefix}{c}, " for c in by)


def on(by: Sequence[str], a: str, b: str) -> str:
    return " AND ".join(f"{a}.{c} = {b}.{c}" for c in by) or "TRUE"


def part(by: Sequence[str], prefix: str = "") -> str:
    return "PARTITION BY " + ", ".join(prefix + c for c in by) if by else ""


def group(by: Sequence[str], *more: str) -> str:
    keys = [*by, *more]
    return "GROUP BY " + ", ".join(keys) if keys else ""


def bin_of(p: str, edges: Sequence[float]) -> str:
    below = " + ".join(f"CAST({p} > {num(e)} AS INT)" for e in edges)
    return (
        f"CASE WHEN {p} IS NULL OR {p} < {num(edges[0])} OR {p} > {num(edges[-1])} THEN NULL "
        f"ELSE greatest(({below}) - 1, 0) END"
    )


def bin_table(edges: Sequence[float]) -> str:
    rows = ", ".join(
        f"({i}, '{label}', {num((a + b) / 2.0)}, {num(a)}, {num(b)}, {num(b - a)})"
        for i, (label, a, b) in enumerate(zip(labels_of(edges), edges, edges[1:]))
    )
    return f"(VALUES {rows}) AS t(bin_idx, bin, mid, \"start\", \"end\", width)"


def bin_ctes(source: str, by: Sequence[str], edges: Sequence[float] | None = None) -> str:
    """CTEs ending in ``bs``: every bin of every group."""
    edges = list(DEFAULT_EDGES if edges is None else edges)
    return f"""
src AS ({source}),
ag AS (SELECT {cols(by)} {bin_of('y_prob', edges)} AS bin_idx, avg(y_true) AS mean_y,
         stddev_samp(y_true) AS std_y, avg(y_prob) AS mean_conf, count(y_true) AS n
       FROM src {group(by, 'bin_idx')}),
gr AS (SELECT DISTINCT {cols(by)} 1 AS one FROM src),
bs AS (SELECT {cols(by, 'gr.')} t.*, mean_y, std_y, mean_conf, coalesce(n, 0) AS n
       FROM gr CROSS JOIN {bin_table(edges)}
       LEFT JOIN ag ON {on(by, 'gr', 'ag')} AND ag.bin_idx = t.bin_idx)"""


BIN_COLUMNS = ", ".join(
    ["CAST(bin_idx AS BIGINT) AS bin_idx", "bin", r9("mean_y", "mean_y"), r9("std_y", "std_y"),
     r9("mean_conf", "mean_conf"), "CAST(n AS BIGINT) AS n", r9("mid", "mid"),
     r9('"start"', '"start"'), r9('"end"', '"end"'), r9("width", "width")]
)


def bin_stats(source: str, by: Sequence[str], edges: Sequence[float] | None = None) -> str:
    return f"WITH {bin_ctes(source, by, edges)} SELECT {cols(by)} {BIN_COLUMNS} FROM bs"


def bars(source: str, by: Sequence[str], eps: float) -> str:
    window = f"OVER ({part(by)})"
    return f"""WITH {bin_ctes(source, by)}
SELECT {cols(by)} {BIN_COLUMNS},
  {r9(f"std_y / nullif(n + {num(eps)}, 0)", 'err')},
  {r9(f"(n - min(n) {window}) / nullif(max(n) {window} - min(n) {window} + {num(eps)}, 0)", 'shade')}
FROM bs"""


def ece_ctes(source: str, by: Sequence[str], n_bins: int = 10) -> str:
    edges = np.linspace(0, 1, n_bins + 1).tolist()
    return f"""
es AS ({source}),
ea AS (SELECT {cols(by)} {bin_of('y_prob', edges)} AS b, avg(y_true) AS my, avg(y_prob) AS mc,
         count(y_true) AS n FROM es {group(by, 'b')}),
ece AS (SELECT {cols(by)} coalesce(
          sum(n * abs(mc - my)) FILTER (b IS NOT NULL AND my IS NOT NULL)
          / nullif(sum(n) FILTER (b IS NOT NULL AND my IS NOT NULL), 0), 0) AS ece
        FROM ea {group(by)})"""


def rank_ctes(source: str, by: Sequence[str]) -> str:
    """CTE ``rk``: ROC AUC and average precision per group."""
    frame = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    return f"""
rs AS ({source}),
sc AS (SELECT {cols(by)} y_prob, sum(y_true)::DOUBLE AS pos, (count(*) - sum(y_true))::DOUBLE AS neg
       FROM rs WHERE y_prob IS NOT NULL AND y_true IS NOT NULL {group(by, 'y_prob')}),
cu AS (SELECT *, sum(neg) OVER ({part(by)} ORDER BY y_prob {frame}) - neg AS neg_below,
         sum(pos) OVER ({part(by)} ORDER BY y_prob DESC {frame}) AS tp,
         sum(neg) OVER ({part(by)} ORDER BY y_prob DESC {frame}) AS fp FROM sc),
rk AS (SELECT {cols(by)} sum(pos * (neg_below + neg / 2)) / nullif(sum(pos) * sum(neg), 0) AS roc_auc,
         coalesce(sum(pos * tp / (tp + fp)) / nullif(sum(pos), 0), 0) AS average_precision
       FROM cu {group(by)})"""


def metric_ctes(source: str, by: Sequence[str]) -> str:
    """CTE ``mt``: all metrics per group."""
    return f"""{ece_ctes(source, by)},{rank_ctes(source, by)},
ba AS (SELECT {cols(by)} avg((y_prob - y_true) * (y_prob - y_true)) AS brier_score,
         avg(y_true) AS accuracy, count(*) FILTER (y_prob IS NOT NULL AND y_true IS NOT NULL) AS n,
         count(*) AS n_rows FROM es {group(by)}),
mt AS (SELECT ba.*, ece.ece, rk.roc_auc, coalesce(rk.average_precision, 0) AS average_precision
       FROM ba JOIN ece ON {on(by, 'ba', 'ece')} LEFT JOIN rk ON {on(by, 'ba', 'rk')})"""


METRIC_COLUMNS = ", ".join(
    [r9(c, c) for c in ("brier_score", "roc_auc", "average_precision", "ece", "accuracy")]
    + ["CAST(n AS BIGINT) AS n", "CAST(n_rows AS BIGINT) AS n_rows"]
)


def metrics(source: str, by: Sequence[str]) -> str:
    return f"WITH {metric_ctes(source, by)} SELECT {cols(by)} {METRIC_COLUMNS} FROM mt"


def simple_mean(
    source: str, by: Sequence[str], expression: str, name: str, rounding=r9
) -> str:
    return f"SELECT {cols(by)} {rounding(f'avg({expression})', name)} FROM ({source}) s {group(by)}"


def loss(p: str) -> str:
    q = f"greatest(2.220446049250313e-16, least(1e0 - 2.220446049250313e-16, {p}))"
    return f"-(y_true * ln({q}) + (1 - y_true) * ln(1e0 - {q}))"


CLIPPED = "greatest(1e-6, least(1e0 - 1e-6, y_prob))"
LOGIT = f"ln({CLIPPED} / (1e0 - {CLIPPED}))"


def eqfreq_ctes(source: str, by: Sequence[str], n_bins: int = 10) -> str:
    """CTE ``eq``: statistics of each equal-frequency bin."""
    fractions = (np.linspace(0, 1, n_bins + 1) * 100.0 / 100.0).tolist()
    values = ", ".join(f"({j}, {num(q)})" for j, q in enumerate(fractions))
    stats = "avg(y_true) AS mean_y, stddev_samp(y_true) AS std_y, avg(y_prob) AS mean_conf"
    return f"""
qs AS ({source}),
ct AS (SELECT {cols(by)} list_sort(list(y_prob)) AS v, count(*) AS cnt FROM qs {group(by)}),
ps AS (SELECT {cols(by)} q * (cnt - 1) AS h, v, cnt,
         CAST(least(floor(q * (cnt - 1)), cnt - 1) AS BIGINT) AS lo
       FROM ct CROSS JOIN (VALUES {values}) AS f(j, q)),
ends AS (SELECT {cols(by)} h - lo AS t, v[lo + 1] AS a, v[least(lo + 2, cnt)] AS b FROM ps),
ed AS (SELECT DISTINCT {cols(by)} CASE WHEN t >= 0.5 THEN b - (b - a) * (1e0 - t)
           ELSE a + (b - a) * t END AS edge FROM ends),
iv AS (SELECT {cols(by)} edge AS lo, lead(edge) OVER ({part(by)} ORDER BY edge) AS hi,
         row_number() OVER ({part(by)} ORDER BY edge) - 1 AS bin FROM ed),
eq AS (SELECT {cols(by, 'qs.')} bin, {stats}, count(y_true) AS n, min(y_prob) AS "start",
         max(y_prob) AS "end", max(y_prob) - min(y_prob) AS width
       FROM qs JOIN iv ON {on(by, 'qs', 'iv')} AND hi IS NOT NULL AND y_prob <= hi
         AND (y_prob > lo OR (bin = 0 AND y_prob = lo))
       {group([f'qs.{c}' for c in by], 'bin')})"""


def eqfreq(source: str, by: Sequence[str], n_bins: int = 10) -> str:
    names = ["mean_y", "std_y", "mean_conf", '"start"', '"end"', "width"]
    return f"""WITH {eqfreq_ctes(source, by, n_bins)}
SELECT {cols(by)} CAST(bin AS BIGINT) AS bin, {', '.join(r9(c, c) for c in names)},
  CAST(n AS BIGINT) AS n FROM eq"""


def band_columns(band: str | None) -> str:
    if band is None:
        low = high = "NULL"
    elif band == "minmax":
        low, high = "min(y)", "max(y)"
    else:
        half = "stddev_pop(y)" + (" / sqrt(count(y))" if band == "stderr" else "")
        low, high = f"avg(y) - {half}", f"avg(y) + {half}"
    return ", ".join(
        [r6("avg(y)", "mean"), r6(low, "lo"), r6(high, "hi"), "CAST(count(y) AS BIGINT) AS n_runs"]
    )


def interpolated(knots: str, points: str, run: Sequence[str]) -> str:
    """``points`` (run, i, x) with y off the ``knots`` (run, kx, ky)."""
    return f"""
nx AS (SELECT *, lead(kx) OVER ({part(run)} ORDER BY kx) AS kx1,
         lead(ky) OVER ({part(run)} ORDER BY kx) AS ky1,
         row_number() OVER ({part(run)} ORDER BY kx) AS pos FROM {knots}),
ip AS (SELECT {cols(run, 'g.')} g.i, g.x, CASE WHEN g.x < kx OR kx1 IS NULL OR g.x = kx THEN ky
           ELSE (ky1 - ky) / (kx1 - kx) * (g.x - kx) + ky END AS y
       FROM {points} g JOIN nx ON {on(run, 'g', 'nx')}
        AND ((g.x >= kx AND (kx1 IS NULL OR g.x < kx1)) OR (pos = 1 AND g.x < kx)))"""


def mean_curve(band: str | None) -> str:
    return f"""WITH {eqfreq_ctes(LINEITEM, RUN)},
kn AS (SELECT {cols(RUN)} mean_conf AS kx, mean_y AS ky FROM eq),
rg AS (SELECT dataset, min(kx) AS lo, max(kx) AS hi FROM kn GROUP BY dataset),
gp AS (SELECT {cols(RUN, 'r.')} i, CASE WHEN i = 99 THEN hi ELSE i * ((hi - lo) / 99e0) + lo END AS x
       FROM (SELECT DISTINCT dataset, model, prompt FROM kn) r JOIN rg ON r.dataset = rg.dataset
       CROSS JOIN range(100) AS t(i)),
{interpolated('kn', 'gp', RUN)}
SELECT dataset, CAST(i AS BIGINT) AS i, {r6('min(x)', 'x')}, {band_columns(band)}
FROM ip GROUP BY dataset, i"""


def curve_multi() -> str:
    grid = ", ".join(f"({i}, {num(x)})" for i, x in enumerate(np.linspace(0, 1, 200).tolist()))
    return f"""WITH {eqfreq_ctes(LINEITEM, RUN)},
kn AS (SELECT {cols(RUN)} mean_conf AS kx, mean_y AS ky FROM eq),
gp AS (SELECT {cols(RUN, 'r.')} i, x
       FROM (SELECT DISTINCT dataset, model, prompt FROM kn) r CROSS JOIN (VALUES {grid}) AS t(i, x)),
{interpolated('kn', 'gp', RUN)}
SELECT dataset, CAST(i AS BIGINT) AS i, {r6('min(x)', 'x')}, {band_columns('stderr')}
FROM ip GROUP BY dataset, i"""


def histogram(by: Sequence[str], train_filter: str = "TRUE") -> str:
    train = f"SELECT * FROM ({EVENTS}) e WHERE split = 'train' AND ({train_filter})"
    edges = DEFAULT_EDGES
    return f"""WITH {bin_ctes(train, by)},
kn AS (SELECT {cols(by)} mid AS kx, mean_y AS ky FROM bs WHERE mean_y IS NOT NULL),
kc AS (SELECT {cols(by)} count(*) AS known FROM kn {group(by)}),
gp AS (SELECT {cols(by)} bin_idx AS i, mid AS x FROM bs),
{interpolated('kn', 'gp', by)},
md AS (SELECT {cols(by, 'bs.')} bs.bin_idx, CASE WHEN bs.mean_y IS NOT NULL THEN bs.mean_y
         WHEN known >= 2 THEN ip.y ELSE 0 END AS adj
       FROM bs JOIN ip ON {on(by, 'bs', 'ip')} AND ip.i = bs.bin_idx
       JOIN kc ON {on(by, 'bs', 'kc')}),
te AS (SELECT *, {bin_of('y_prob', edges)} AS b FROM ({EVENTS}) e WHERE split = 'test')
SELECT event_id, {cols(by, 'te.')} {r6('y_prob', 'y_prob')}, {r6('adj', 'p_cal')}
FROM te LEFT JOIN md ON {on(by, 'te', 'md')} AND te.b = md.bin_idx"""


def isotonic_ctes(source: str, by: Sequence[str], key: str) -> str:
    """CTE ``ip`` (i, y) of test rows ``te``: max-min formula over prefix sums."""
    return f"""
tr AS (SELECT {cols(by)} {CLIPPED} AS x, sum(y_true) AS s, count(*) AS n
       FROM ({source}) e WHERE split = 'train' {group(by, 'x')}),
cs AS (SELECT *, row_number() OVER w AS i, sum(s) OVER w AS s1, sum(n) OVER w AS n1
       FROM tr WINDOW w AS ({part(by)} ORDER BY x)),
uv AS (SELECT {cols(by, 'u.')} u.i AS ui, v.i AS vi,
         (v.s1 - u.s1 + u.s)::DOUBLE / (v.n1 - u.n1 + u.n)::DOUBLE AS m
       FROM cs u JOIN cs v ON {on(by, 'u', 'v')} AND u.i <= v.i),
mn AS (SELECT {cols(by)} ui, vi,
         min(m) OVER ({part([*by, 'ui'])} ORDER BY vi DESC ROWS UNBOUNDED PRECEDING) AS m FROM uv),
ft AS (SELECT {cols(by)} vi AS i, max(m) AS fit FROM mn {group(by, 'vi')}),
kn AS (SELECT {cols(by, 'cs.')} x AS kx, fit AS ky FROM cs JOIN ft
       ON {on(by, 'cs', 'ft')} AND cs.i = ft.i),
te AS (SELECT {key} AS i, {cols(by)} y_prob, {CLIPPED} AS x FROM ({source}) e WHERE split = 'test'),
{interpolated('kn', 'te', by)}"""


def isotonic(by: Sequence[str]) -> str:
    return f"""WITH {isotonic_ctes(EVENTS, by, 'event_id')}
SELECT te.i AS event_id, {cols(by, 'te.')} {r6('y_prob', 'y_prob')}, {r6('y', 'p_cal')}
FROM te LEFT JOIN ip ON te.i = ip.i"""


def isotonic_means(by: Sequence[str], source: str = LINEITEM) -> str:
    return f"""WITH {isotonic_ctes(source, by, 'row_number() OVER ()')}
SELECT {cols(by, 'te.')} {r6('avg(y)', 'mean_cal')}, CAST(count(y) AS BIGINT) AS n
FROM te LEFT JOIN ip ON te.i = ip.i {group([f'te.{c}' for c in by])}"""


def newton_ctes(source: str, by: Sequence[str], slope_only: bool, steps: int = 14) -> str:
    """CTE ``fit`` (by, a, b): Newton steps written out one after the other."""
    text = f"""
tn AS (SELECT {cols(by)} {LOGIT} AS z, count(*)::DOUBLE AS n, sum(y_true)::DOUBLE AS pos
       FROM ({source}) s WHERE split = 'train' {group(by, 'z')}),
w0 AS (SELECT DISTINCT {cols(by)} 0.5e0 AS a, 0e0 AS b FROM tn)"""
    for k in range(steps):
        new_a = "a - g1 / h11" if slope_only else (
            "a - (h00 * (g1 + 1e-6 * a) - h10 * g0) / ((h11 + 1e-6) * h00 - h10 * h10)"
        )
        new_b = "0e0" if slope_only else (
            "b - ((h11 + 1e-6) * g0 - h10 * (g1 + 1e-6 * a)) / ((h11 + 1e-6) * h00 - h10 * h10)"
        )
        text += f""",
p{k} AS (SELECT {cols(by, 'tn.')} z, n, pos, a, b, 1e0 / (1e0 + exp(-(a * z + b))) AS s
         FROM tn JOIN w{k} ON {on(by, 'tn', f'w{k}')}),
s{k} AS (SELECT {cols(by)} min(a) AS a, min(b) AS b, sum((n * s - pos) * z) AS g1,
           sum(n * s - pos) AS g0, sum(n * s * (1e0 - s) * z * z) AS h11,
           sum(n * s * (1e0 - s) * z) AS h10, sum(n * s * (1e0 - s)) AS h00 FROM p{k} {group(by)}),
w{k + 1} AS (SELECT {cols(by)} {new_a} AS a, {new_b} AS b FROM s{k})"""
    return text + f",\nfit AS (SELECT * FROM w{steps})"


def newton_applied(by: Sequence[str], slope_only: bool) -> str:
    return f"""WITH {newton_ctes(EVENTS, by, slope_only)},
te AS (SELECT * FROM ({EVENTS}) e WHERE split = 'test')
SELECT event_id, {cols(by, 'te.')} {r6('y_prob', 'y_prob')},
  {r6(f'1e0 / (1e0 + exp(-(a * {LOGIT} + b)))', 'p_cal')}
FROM te LEFT JOIN fit ON {on(by, 'te', 'fit')}"""


def with_sizes() -> str:
    values = ", ".join(f"({quoted(m)}, {s})" for m, s in MODEL_SIZES)
    return f"""{metric_ctes(RUNS, RUN)},
sz AS (SELECT mt.*, t.model_size FROM mt JOIN (VALUES {values}) AS t(model, model_size)
       ON mt.model = t.model)"""


ZSCORES = """,
zs AS (SELECT *, (ece - avg(ece) OVER d) / nullif(stddev_samp(ece) OVER d, 0) AS ece_norm,
         (brier_score - avg(brier_score) OVER d) / nullif(stddev_samp(brier_score) OVER d, 0)
           AS brier_score_norm
       FROM sz WINDOW d AS (PARTITION BY dataset))"""


def fences(source: str, value: str, by: Sequence[str]) -> str:
    """CTE ``fe``: rows of ``source`` with quartiles and whether they lie inside."""
    q = ", ".join(
        f"quantile_cont({value}, {f}) OVER ({part(by)}) AS {n}"
        for n, f in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))
    )
    return f"""
fq AS (SELECT *, {q} FROM {source} WHERE {value} IS NOT NULL),
fe AS (SELECT *, {value} >= q1 - 1.5e0 * (q3 - q1) AND {value} <= q3 + 1.5e0 * (q3 - q1) AS inside FROM fq)"""


def box(source_ctes: str, source: str, value: str, by: Sequence[str]) -> str:
    return f"""WITH {source_ctes},{fences(source, value, by)}
SELECT {cols(by)} {r6('min(q1)', 'q1')}, {r6('min(median)', 'median')}, {r6('min(q3)', 'q3')},
  {r6(f'least(min({value}) FILTER (inside), min(q1))', 'whisker_lo')},
  {r6(f'greatest(max({value}) FILTER (inside), min(q3))', 'whisker_hi')},
  CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (NOT inside) AS BIGINT) AS n_outliers
FROM fe {group(by)}"""


def lowess(frac: float = 2.0 / 3.0, iterations: int = 3) -> str:
    """Row by row: k nearest rows, tricube distances, bisquare residual weights."""
    text = f"""WITH {with_sizes()},
lr AS (SELECT prompt, model_size::DOUBLE AS x, ece AS y, row_number() OVER () AS id FROM sz),
lk AS (SELECT prompt, greatest(CAST(floor(count(*) * {num(frac)} + 1e-10) AS BIGINT), 1) AS k
       FROM lr GROUP BY prompt),
lx AS (SELECT DISTINCT prompt, x AS x0 FROM lr),
rad AS (SELECT lx.prompt, x0, list_sort(list(abs(x - x0)))[min(k)] AS r
        FROM lx JOIN lr ON lx.prompt = lr.prompt JOIN lk ON lx.prompt = lk.prompt
        GROUP BY lx.prompt, x0),
dw AS (SELECT rad.prompt, x0, id, x, y, CASE WHEN x = x0 THEN 1e0
           WHEN r = 0 OR abs(x - x0) / r >= 0.999e0 THEN 0e0
           WHEN abs(x - x0) / r <= 0.001e0 THEN 1e0
           ELSE pow(1e0 - pow(abs(x - x0) / r, 3), 3) END AS w
       FROM rad JOIN lr ON rad.prompt = lr.prompt),
d0 AS (SELECT id, 1e0 AS d FROM lr)"""
    for k in range(iterations + 1):
        text += f""",
m{k} AS (SELECT prompt, x0, sum(w * d * x) / sum(w * d) AS mx, sum(w * d * y) / sum(w * d) AS my
         FROM dw JOIN d{k} ON dw.id = d{k}.id GROUP BY prompt, x0),
f{k} AS (SELECT dw.prompt, dw.x0, min(my) + sum(w * d * (x - mx) * (y - my)) / sum(w * d)
           / greatest(sum(w * d * (x - mx) * (x - mx)) / sum(w * d), 1e-12) * (dw.x0 - min(mx)) AS fit
         FROM dw JOIN d{k} ON dw.id = d{k}.id JOIN m{k} ON dw.prompt = m{k}.prompt AND dw.x0 = m{k}.x0
         GROUP BY dw.prompt, dw.x0),
e{k} AS (SELECT lr.prompt, id, abs(y - fit) AS res FROM lr
         JOIN f{k} ON lr.prompt = f{k}.prompt AND lr.x = f{k}.x0),
u{k} AS (SELECT id, res / (6e0 * quantile_cont(res, 0.5) OVER (PARTITION BY prompt)) AS u FROM e{k}),
d{k + 1} AS (SELECT id, CASE WHEN u >= 0.999e0 THEN 0e0 WHEN u <= 0.001e0 THEN 1e0
               ELSE pow(1e0 - u * u, 2) END AS d FROM u{k})"""
    return text + f"""
SELECT prompt, {r6('x0', 'model_size')}, {r6('fit', 'fit')} FROM f{iterations}"""


SPACE = r"[\s\x1c-\x1f]+"


def extract_ctes(source: str) -> str:
    """CTE ``ex`` (id, prediction, verb_conf): blocks in order, then patterns.

    Number and string answers only, as the texts hold no others besides null.
    """
    number = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
    a1, a2 = (quoted("(?i)" + p) for p in ANSWER_PATTERNS)
    c1, c2 = (quoted("(?i)" + p) for p in CONFIDENCE_PATTERNS)

    def first(p1: str, p2: str) -> str:
        return (
            f"CASE WHEN regexp_matches(text, {p1}) THEN regexp_extract(text, {p1}, 1) "
            f"WHEN regexp_matches(text, {p2}) THEN regexp_extract(text, {p2}, 1) END"
        )

    strip = quoted(f"^{SPACE}|{SPACE}$")
    return f"""
tx AS ({source}),
bl AS (SELECT id, unnest(l) AS block, generate_subscripts(l, 1) AS k, len(l) AS m
       FROM (SELECT id, regexp_extract_all(text, {quoted('(?s)' + chr(92) + '{.*?' + chr(92) + '}')}) AS l FROM tx)),
ca AS (SELECT id, m - k AS step, block FROM bl
       UNION ALL
       SELECT id, m + m - k, regexp_replace(replace(block, '''', '"'), {quoted(chr(44) + chr(92) + 's*}')}, '}}', 'g') FROM bl),
va AS (SELECT * FROM ca WHERE json_valid(block)),
rd AS (SELECT id, step, json_type(block, '$.answer') AS at,
         regexp_replace(CASE WHEN json_type(block, '$.answer') = 'NULL' THEN 'None'
           ELSE json_extract_string(block, '$.answer') END, {strip}, '', 'g') AS answer,
         json_type(block, '$.confidence') AS ct, json_extract_string(block, '$.confidence') AS conf
       FROM va),
st AS (SELECT id, step, last_value(answer IGNORE NULLS) OVER (PARTITION BY id ORDER BY step
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS answer,
         ct IS NOT NULL AND NOT coalesce(regexp_matches(conf, {quoted(number)}), FALSE) AS failed,
         CASE WHEN regexp_matches(conf, {quoted(number)}) THEN CAST(trim(conf) AS DOUBLE) END AS conf
       FROM rd),
dn AS (SELECT id, arg_min(answer, step) AS answer, arg_min(conf, step) AS conf, min(step) AS step
       FROM (SELECT id, step, answer, conf FROM st
             WHERE NOT failed AND (conf IS NOT NULL OR (answer IS NOT NULL AND answer <> '')))
       GROUP BY id),
dx AS (SELECT st.id, st.answer, st.conf FROM dn JOIN st ON dn.id = st.id AND dn.step = st.step),
lk AS (SELECT id, arg_max(answer, step) AS answer FROM st WHERE answer IS NOT NULL GROUP BY id),
ex AS (SELECT tx.id, CASE WHEN dx.id IS NOT NULL THEN dx.answer
           ELSE coalesce(regexp_replace({first(a1, a2)}, {strip}, '', 'g'), lk.answer) END AS prediction,
         CASE WHEN dx.id IS NOT NULL THEN dx.conf
           ELSE greatest(0e0, least(1e0, CAST({first(c1, c2)} AS DOUBLE))) END AS verb_conf,
         CASE WHEN dx.id IS NULL THEN {first(c1, c2)} END AS pattern_conf
       FROM tx LEFT JOIN dx ON tx.id = dx.id LEFT JOIN lk ON tx.id = lk.id),
xt AS (SELECT id, prediction, CASE WHEN pattern_conf IS NULL AND verb_conf IN (0, 1)
         AND id NOT IN (SELECT id FROM dx) THEN NULL ELSE verb_conf END AS verb_conf FROM ex)"""


def extracted(source: str) -> str:
    return f"WITH {extract_ctes(source)} SELECT id, prediction, {r6('verb_conf', 'verb_conf')} FROM xt"


TOKENS = """SELECT event_id,
  list_transform(range(1, 25), lambda i: (i * i + event_id) % 7) AS content_ids,
  CASE WHEN event_id % 5 = 0 THEN NULL
       ELSE list_transform(range(1, 3), lambda i: (i * 3 + user_id) % 7) END AS prediction_ids,
  list_transform(range(1, 25), lambda i: -((i * 37 + event_id) % 101)::DOUBLE / 8e0) AS logprobs
FROM events"""

FOUND = f"""tk AS ({TOKENS}),
fs AS (SELECT *, CASE WHEN prediction_ids IS NULL THEN NULL ELSE
         list_min(list_filter(range(0, 23), lambda i: content_ids[i + 1] = prediction_ids[1]
           AND content_ids[i + 2] = prediction_ids[2])) END AS position FROM tk)"""


def tokens_sql(text: str) -> str:
    return f"regexp_extract_all({text}, '[0-9A-Za-z_]+|[^0-9A-Za-z_\\s]')"


def log_softmax(vector: str, index: str) -> str:
    top = f"list_max({vector})"
    total = f"list_sum(list_transform({vector}, lambda v: exp(v::DOUBLE - {top}::DOUBLE)))"
    return f"{vector}[({index}) + 1]::DOUBLE - {top}::DOUBLE - ln({total})"


def oracle_sql() -> dict[str, str]:
    by2 = ["dataset", "model"]
    prefix_math, prefix_choice = quoted(GSM8K_ANSWER_PREFIX), quoted(ARC_ANSWER_PREFIX)
    moved_bins = bin_of("(y_prob * 1.25e0 - 0.125e0)", DEFAULT_EDGES)
    labels = "[" + ", ".join(quoted(x) for x in labels_of(DEFAULT_EDGES)) + "]"
    sized = with_sizes()
    gsm8k = """SELECT concat('run_', user_id % 3) AS run_id, event_id AS "index",
  event_type AS question, CAST(user_id AS VARCHAR) AS answer,
  concat(props, '{"index": ', event_id) AS content,
  CASE WHEN event_id % 2 = 0 THEN 'thought' END AS thinking,
  CASE WHEN event_id % 3 > 0 THEN CAST(user_id AS VARCHAR) END AS prediction,
  CASE WHEN event_id % 4 > 0 THEN (event_id % 101)::DOUBLE / 100e0 END AS verb_conf, -value AS v2
FROM events"""
    arc = """SELECT concat('run_', lang) AS run_id, concat('q', doc_id) AS id, text AS question,
  lang AS answer, source AS content, CAST(NULL AS VARCHAR) AS thinking,
  CASE WHEN doc_id % 2 = 0 THEN lang END AS prediction, (doc_id % 10)::DOUBLE AS verb_conf
FROM documents"""
    return {
        "bin_stats": bin_stats(LINEITEM, RUN),
        "bin_stats_custom_edges": bin_stats(
            EVENTS, ["dataset"], [0.0, 0.05, 0.2, 0.35, 0.5, 0.85, 0.95]
        ),
        "bin_assignment": f"SELECT event_id, {labels}[({moved_bins}) + 1] AS bin FROM ({EVENTS}) e",
        "eqfreq_bins": eqfreq(LINEITEM, RUN),
        # Edges of equal labels, at three places, are refused like those that do not ascend.
        "edge_checks": f"""SELECT dataset, kind, n AS n_edges, low < middle AND middle < high AND (kind = 'ascending') AS accepted
FROM (SELECT dataset, min(y_prob) AS low, avg(y_prob) AS middle, max(y_prob) AS high FROM ({EVENTS}) e GROUP BY dataset),
  (VALUES ('ascending', 3::BIGINT), ('descending', 3), ('repeated', 4), ('single', 1), ('close', 4), ('empty', 0)) AS k(kind, n)""",
        "eqfreq_continuous_labels": f"""WITH {eqfreq_ctes(
            f"SELECT * REPLACE (y_true + y_prob * 2 + 1e8 AS y_true) FROM ({LINEITEM}) c", RUN)}
SELECT {cols(RUN)} CAST(bin AS BIGINT) AS bin, round(mean_y - 1e8, 4) + 0.0 AS mean_shift,
  round(std_y, 5) + 0.0 AS std_y, CAST(n AS BIGINT) AS n FROM eq""",
        "approximate_edges": f"""SELECT {cols(RUN)} CAST(j AS BIGINT) AS j, n, TRUE AS within
FROM (SELECT {cols(RUN)} count(*) AS n FROM ({LINEITEM}) s GROUP BY ALL), range(21) t(j)""",
        "eqfreq_bins_ties": eqfreq(EVENTS, by2, 150),
        "ece_by_run": f"WITH {ece_ctes(LINEITEM, RUN)} SELECT {cols(RUN)} {r9('ece', 'ece')} FROM ece",
        "ece_overall": f"WITH {ece_ctes(LINEITEM, [], 15)} SELECT {r9('ece', 'ece')} FROM ece",
        "brier": simple_mean(LINEITEM, RUN, "(y_prob - y_true) * (y_prob - y_true)", "brier_score"),
        "accuracy": simple_mean(LINEITEM, RUN, "y_true", "accuracy"),
        "roc_auc": f"WITH {rank_ctes(LINEITEM, RUN)} SELECT {cols(RUN)} {r9('roc_auc', 'roc_auc')} FROM rk",
        "roc_auc_overall": f"WITH {rank_ctes(LINEITEM, [])} SELECT {r9('roc_auc', 'roc_auc')} FROM rk",
        "average_precision": f"WITH {rank_ctes(LINEITEM, RUN)} SELECT {cols(RUN)} "
        f"{r9('average_precision', 'average_precision')} FROM rk",
        "metrics_bundle": metrics(LINEITEM, RUN),
        "metrics_labels": metrics(LABELS, ["lang"]),
        "metrics_bundle_missing": metrics(MISSING, ["dataset", "prompt"]),
        "ece_missing": f"WITH {ece_ctes(MISSING, ['dataset', 'prompt'])} "
        f"SELECT dataset, prompt, {r9('ece', 'ece')} FROM ece",
        "bin_stats_missing": bin_stats(MISSING, ["dataset"]),
        "eqfreq_missing": eqfreq(f"SELECT * FROM ({MISSING}) q WHERE y_prob IS NOT NULL", ["dataset"]),
        "nll": simple_mean(LINEITEM, RUN, loss(CLIPPED), "nll", r6),
        "nll_given_log_t": simple_mean(
            LINEITEM, RUN, loss(f"(1e0 / (1e0 + exp(-({LOGIT} / exp(0.4e0)))))"), "nll", r6
        ),
        "clip_logit_sigmoid": f"SELECT event_id, {r6(CLIPPED, 'clipped')}, {r6(LOGIT, 'z')}, "
        f"{r6(f'1e0 / (1e0 + exp(-({LOGIT} / 2.5e0)))', 'p')} FROM ({EVENTS}) e",
        "histogram_scaling": histogram(by2),
        "histogram_scaling_gaps": histogram(
            ["dataset"], "y_prob <= 0.3e0 OR (y_prob > 0.6e0 AND y_prob <= 0.8e0)"
        ),
        "isotonic_scaling": isotonic(by2),
        "isotonic_continuous": isotonic_means(RUN),
        "isotonic_continuous_labels": isotonic_means(
            RUN, f"SELECT * REPLACE (y_true * 0.25e0 + y_prob * 0.5e0 AS y_true) FROM ({LINEITEM}) c"
        ),
        "interpolate_many_knots": f"""WITH kn AS (
  SELECT o_orderstatus, o_orderkey::DOUBLE AS kx, o_totalprice::DOUBLE AS ky FROM orders WHERE o_orderkey % 3 = 0),
te AS (SELECT o_orderkey AS i, o_orderstatus, o_orderkey::DOUBLE AS x FROM orders),
{interpolated('kn', 'te', ['o_orderstatus'])}
SELECT te.i AS o_orderkey, te.o_orderstatus, round(y + 1.23e-5, 3) + 0.0 AS y FROM te LEFT JOIN ip ON te.i = ip.i""",
        "platt_params": f"WITH {newton_ctes(LINEITEM, RUN, False)} "
        f"SELECT {cols(RUN)} {r6('a', 'a')}, {r6('b', 'b')}, TRUE AS converged FROM fit",
        "platt_scaling": newton_applied(by2, False),
        "temperature_params": f"WITH {newton_ctes(LINEITEM, RUN, True)} "
        f"SELECT {cols(RUN)} {r6('1e0 / a', 'temperature')}, TRUE AS converged FROM fit",
        "temperature_scaling": newton_applied(by2, True),
        "reliability_bars": bars(LINEITEM, RUN, 1e-8),
        "reliability_bars_plain": bars(EVENTS, ["dataset"], 0.0),
        "pooled_bars": bars(LINEITEM, ["dataset"], 1e-8),
        "eqfreq_curve": f"WITH {eqfreq_ctes(LINEITEM, RUN)} SELECT {cols(RUN)} "
        f"CAST(bin AS BIGINT) AS bin, {r6('mean_conf', 'mean_conf')}, {r6('mean_y', 'mean_y')} FROM eq",
        "mean_curve_none": mean_curve(None),
        "mean_curve_std": mean_curve("std"),
        "mean_curve_stderr": mean_curve("stderr"),
        "mean_curve_minmax": mean_curve("minmax"),
        "curve_multi": curve_multi(),
        "run_metric_table": f"WITH {sized} SELECT {cols(RUN)} {METRIC_COLUMNS}, "
        "CAST(model_size AS BIGINT) AS model_size FROM sz",
        "zscore_by_dataset": f"WITH {sized}{ZSCORES} SELECT {cols(RUN)} {r6('ece_norm', 'ece_norm')}, "
        f"{r6('brier_score_norm', 'brier_score_norm')} FROM zs",
        "dataset_weights": f"WITH {sized} SELECT {cols(RUN)} "
        "CAST(count(*) OVER (PARTITION BY dataset) AS BIGINT) AS dataset_weight FROM sz",
        "group_sizes": f"WITH {sized} SELECT dataset, CAST(count(*) AS BIGINT) AS n FROM sz GROUP BY dataset",
        "weighted_ece_by_size": f"""WITH {sized},
wt AS (SELECT *, count(*) OVER (PARTITION BY dataset) AS w FROM sz)
SELECT CAST(model_size AS BIGINT) AS model_size, {r6('sum(ece * w) / sum(w)', 'weighted_ece')}
FROM wt GROUP BY model_size""",
        "box_stats": box(sized + ZSCORES, "zs", "brier_score_norm", ["model_size"]).replace(
            "SELECT model_size,  round", "SELECT CAST(model_size AS BIGINT) AS model_size, round"
        ),
        "box_outliers": f"""WITH {fences('events', 'value', ['event_type'])}
SELECT event_id, event_type, {r6('value', 'value')} FROM fe WHERE NOT inside""",
        "lowess_trend": lowess(),
        "extract_answers": extracted(_sql(fixtures.TEXT_OUTPUTS)),
        "extract_answers_documents": extracted(_sql(fixtures.DOCUMENT_OUTPUTS)),
        "extracted_calibration": f"""WITH {extract_ctes(_sql(fixtures.TEXT_OUTPUTS))},
{ece_ctes(f"SELECT id % 12 AS template, {'round(verb_conf, 6)'} AS y_prob, "
          "CASE WHEN regexp_matches(prediction, '^[0-9]*[02468]$') THEN 1 ELSE 0 END AS y_true FROM xt",
          ['template'])}
SELECT template, {r9('ece', 'ece')} FROM ece""",
        "find_subsequence": f"WITH {FOUND} SELECT event_id, CAST(position AS BIGINT) AS position FROM fs",
        "answer_logprobs": f"""WITH {FOUND}
SELECT event_id, CASE WHEN prediction_ids IS NULL THEN 'no_prediction'
    WHEN position IS NULL THEN 'not_found' ELSE 'found' END AS reason,
  CAST(CASE WHEN position IS NULL THEN 0 ELSE 2 END AS BIGINT) AS n,
  {r6('logprobs[position + 1]', 'first')}, {r6('logprobs[position + 2]', 'second')} FROM fs""",
        "gsm8k_records": f"""WITH {extract_ctes(_sql(fixtures.TURN_OUTPUTS))},
tok AS (SELECT tx.id, prediction, verb_conf, {tokens_sql('text')} AS t, {tokens_sql('prediction')} AS p
        FROM tx JOIN xt ON tx.id = xt.id),
fd AS (SELECT *, CASE WHEN len(p) = 0 THEN 0 ELSE list_min(list_filter(range(0, len(t) - len(p) + 1),
         lambda i: t[i + 1:i + len(p)] = p)) END AS position FROM tok),
lp AS (SELECT *, list_transform(p, lambda w, k: -(length(w) * 8 + (position + k - 1) % 8)::DOUBLE / 16e0) AS l FROM fd)
SELECT id, prediction, {r6('verb_conf', 'verb_conf')},
  CAST(CASE WHEN position IS NULL OR prediction IS NULL THEN 0 ELSE len(p) END AS BIGINT) AS n,
  CASE WHEN position IS NOT NULL THEN {r6('l[1]', 'x')[:-5]} END AS first,
  CASE WHEN position IS NOT NULL THEN {r6('l[len(l)]', 'x')[:-5]} END AS last FROM lp""",
        "arc_records": f"""WITH {extract_ctes(_sql(fixtures.DOCUMENT_OUTPUTS))},
lg AS (SELECT doc_id AS id, [exp(1e0), exp(length(lang) / 2e0), exp((n_chars % 5)::DOUBLE)] AS e FROM documents)
SELECT xt.id, prediction, {r6('verb_conf', 'verb_conf')},
  {", ".join(r6(f"e[{i + 1}] / list_sum(e)", f"p{i}") for i in range(3))}
FROM xt JOIN lg ON xt.id = lg.id""",
        "prompt_pipeline": f"""WITH q AS (SELECT item_id, text, string_split(text, ' ')[1:4] AS c
  FROM benchmark ORDER BY item_id LIMIT 150),
m AS (SELECT item_id, concat('system: Answer in JSON.', chr(10), 'user: ', text, chr(10), chr(10),
  array_to_string(list_transform(c, lambda x, i: concat(['A', 'B', 'C', 'D'][i], '. ', x)), chr(10))) AS p FROM q)
SELECT item_id, concat(p, CASE WHEN item_id % 2 = 0 THEN concat('thought', chr(10), chr(10)) ELSE '' END,
  {prefix_choice}) AS prompt FROM m""",
        "content_tail": f"""WITH tk AS ({TOKENS}),
kp AS (SELECT event_id, content_ids[(10 + event_id % 14 - 4 + 1):] AS k FROM tk)
SELECT event_id, CAST(len(k) AS BIGINT) AS n, CAST(k[1] AS BIGINT) AS first,
  CAST(k[len(k)] AS BIGINT) AS last FROM kp""",
        "label_softmax": """WITH lg AS (SELECT vec_id, i AS choice,
  embedding[(label + 5 * i) % 64 + 1]::DOUBLE AS v FROM embeddings CROSS JOIN range(4) AS t(i)),
ep AS (SELECT *, exp(v - max(v) OVER (PARTITION BY vec_id)) AS e FROM lg)
SELECT vec_id, CAST(choice AS BIGINT) AS choice, """
        + r6("e / sum(e) OVER (PARTITION BY vec_id)", "p")
        + " FROM ep",
        "token_logprob": f"SELECT vec_id, {r6(log_softmax('embedding', 'label'), 'logprob')} FROM embeddings",
        "sequence_logprobs": f"""WITH cut AS (SELECT vec_id, i AS step,
  embedding[(i * 8 + 1):(i * 8 + 8)] AS x, (vec_id + (i + 1) * 3) % 8 AS t
FROM embeddings CROSS JOIN range(7) AS r(i))
SELECT vec_id, CAST(step AS BIGINT) AS step, {r6(log_softmax('x', 't'), 'logprob')} FROM cut""",
        "format_question": """SELECT doc_id, concat(text, chr(10), CASE
  WHEN doc_id % 7 = 0 THEN ''
  WHEN doc_id % 3 = 0 THEN concat(chr(10), 'A. ', lang, chr(10), 'B. ', source)
  ELSE concat(chr(10), 'A. ', lang, chr(10), 'B. ', source, chr(10), 'C. ', n_chars) END) AS prompt
FROM documents""",
        "chat_messages": """SELECT conv_id, turn, CAST(pos AS BIGINT) AS pos,
  CASE pos WHEN 0 THEN 'system' ELSE role END AS role,
  CASE pos WHEN 0 THEN 'Answer in JSON.' ELSE text END AS content
FROM conversations CROSS JOIN range(2) AS t(pos)""",
        "continuation_prompt": f"""SELECT conv_id, turn,
  concat(text, CASE WHEN turn % 2 = 0 THEN concat(role, chr(10), chr(10)) ELSE '' END, {prefix_math}) AS math,
  concat(text, CASE WHEN turn % 2 = 0 THEN concat(role, chr(10), chr(10)) ELSE '' END, {prefix_choice}) AS choice
FROM conversations""",
        "strip_newlines": "SELECT doc_id, concat(' ', text, ' ') AS text FROM documents",
        "long_head": """SELECT l_linenumber::BIGINT AS l_linenumber, count(*) AS n, max(l_orderkey) AS last FROM (
  SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS i, count(*) OVER () AS c FROM lineitem)
WHERE i <= c * 9 // 10 GROUP BY l_linenumber""",
        "head_n": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 250",
        "record_index": """SELECT event_id, user_id,
  CAST(row_number() OVER (ORDER BY user_id, event_id) - 1 AS BIGINT) AS "index" FROM events""",
        "manifest_join": metrics(EVENTS, RUN),
        "selected_run_bins": bin_stats(
            f"SELECT * FROM ({EVENTS}) e WHERE dataset = 'click' AND model = 'm_large'", ["prompt"]
        ),
        "rows_binned": f"WITH {bin_ctes(EVENTS, ['dataset'])} "
        "SELECT dataset, CAST(sum(n) AS BIGINT) AS n FROM bs GROUP BY dataset",
        "read_concat_json": f"""SELECT run_id, "index", question, answer, content, thinking, prediction,
  {r6('verb_conf', 'verb_conf')}, {r6('v2', 'second_logprob')} FROM ({gsm8k}) g""",
        "arc_outputs": f"""SELECT run_id, id, question, answer, content, thinking, prediction,
  {r6('verb_conf', 'verb_conf')}, 'A|B' AS labels, 0.75e0 AS second_prob FROM ({arc}) a""",
        "union_runs": f"""SELECT run_id, CAST("index" AS VARCHAR) AS item_id, answer, prediction,
  {r6('verb_conf', 'verb_conf')}, "index", CAST(NULL AS VARCHAR) AS id FROM ({gsm8k}) g
UNION ALL SELECT run_id, id, answer, prediction, {r6('verb_conf', 'verb_conf')}, NULL, id FROM ({arc}) a""",
        "run_metadata": f"""SELECT DISTINCT concat_ws('_', dataset, model, prompt) AS run_id, model, dataset,
  CAST(4 AS BIGINT) AS batch_size, prompt = '0' AS thinking,
  concat('1970010', 1 + CAST(prompt AS INT), '_000000') AS timestamp,
  CAST(NULL AS BIGINT) AS max_samples, concat('line one', chr(10), 'prompt ', prompt) AS system_prompt
FROM ({EVENTS}) e""",
        "run_table_roundtrip": """SELECT 'run_' || source AS run_id, source AS model, min(lang) AS dataset,
  count(*) AS batch_size, count(*) % 2 = 0 AS thinking, max(doc_id) AS max_samples,
  concat('a', chr(10), 'b ', source) AS system_prompt, TRUE AS same FROM documents GROUP BY source""",
        "arc_outputs_added": f"""SELECT run_id, id, answer, prediction, {r6('verb_conf', 'verb_conf')} FROM ({arc}) a""",
        "run_names": "SELECT event_id, concat('run_', strftime(ts, '%Y%m%d_%H%M%S')) AS run_id FROM events",
        "benchmark_scan": """SELECT text AS question, CAST(doc_id AS VARCHAR) AS answer,
  lang AS config, 'test' AS split FROM documents WHERE lang = 'en' AND doc_id % 4 = 0""",
    }
