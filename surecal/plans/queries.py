"""Named queries: each operator over whole test tables.

Every function takes the session and a table folder and returns a DataFrame. Floats
are rounded, so that results compare by value across engines: to six places in general,
and to nine where they are plain sums over counts, since short decimals divided by a
count of, say, 32 end in a tie at six places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prompts, sequences
from ..functions.binning import Bins
from ..functions.extraction import parse_output
from ..functions.probability import clip, logit, number, sigmoid
from ..operators import analysis, assembly, bins, calibration, curves, interpolation, keys, metrics, rows
from ..schemas import ARC_OUTPUTS, GSM8K_OUTPUTS
from ..session import materialize, scratch_path
from ..sources import records, runs
from . import fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

RUN = ["dataset", "model", "prompt"]


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def r6(c: Column | str, places: int = 6) -> Column:
    column = F.col(c) if isinstance(c, str) else c
    return F.round(column.cast("double"), places) + F.lit(0.0)


def precise(df: DataFrame) -> DataFrame:
    return rounded(df, 9)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every float column and widen every integer column."""
    out = []
    for name, kind in df.dtypes:
        if kind == "double":
            out.append(r6(name, places).alias(name))
        elif kind == "int":
            out.append(F.col(name).cast("bigint").alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def pred_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.frame(spark, sf, fixtures.PRED_LINEITEM)


def pred_events(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.frame(spark, sf, fixtures.PRED_EVENTS)


def run_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """One metric row per run. Written once, as several steps read it."""
    predictions = fixtures.frame(spark, sf, fixtures.PRED_RUNS)
    table = materialize(metrics.calculate_metrics(predictions, by=RUN))
    return analysis.with_model_size(table, analysis.model_sizes(spark))


# -- binned statistics and metrics ------------------------------------------------


@query
def bin_stats(spark, sf):
    return precise(bins.bin_stats(pred_lineitem(spark, sf), by=RUN))


@query
def bin_stats_custom_edges(spark, sf):
    edges = [0.0, 0.05, 0.2, 0.35, 0.5, 0.85, 0.95]
    return precise(bins.bin_stats(pred_events(spark, sf), by=["dataset"], edges=edges))


@query
def bin_assignment(spark, sf):
    """Bin of every row, with probabilities moved so that some fall outside."""
    moved = number("y_prob") * 1.25 - 0.125
    label = F.get(F.array(*[F.lit(x) for x in Bins.of().labels]), Bins.of().index_of(moved))
    return pred_events(spark, sf).select("event_id", label.alias("bin"))


def _accepted(edges: list) -> bool:
    try:
        Bins.of(edges)
    except ValueError:
        return False
    return True


@query
def edge_checks(spark, sf):
    """Edge lists made of each dataset's scores, and whether they are taken as bin edges."""
    spread = pred_events(spark, sf).groupBy("dataset").agg(
        F.min("y_prob").alias("low"), F.avg("y_prob").alias("middle"), F.max("y_prob").alias("high"))
    lists = []
    # One row per dataset.
    for r in spread.collect():
        for kind, edges in (
            ("ascending", [r.low, r.middle, r.high]), ("descending", [r.high, r.middle, r.low]),
            ("repeated", [r.low, r.middle, r.middle, r.high]), ("single", [r.middle]),
            ("close", [r.low, r.middle, r.middle + 1e-5, r.middle + 2e-5]), ("empty", []),
        ):
            lists.append((r.dataset, kind, len(edges), _accepted(edges)))
    return rounded(spark.createDataFrame(lists, "dataset string, kind string, n_edges int, accepted boolean"))


@query
def eqfreq_bins(spark, sf):
    return precise(bins.equal_frequency_bin_stats(pred_lineitem(spark, sf), by=RUN))


@query
def eqfreq_bins_ties(spark, sf):
    """More bins than distinct values can fill, so that edges coincide."""
    return precise(
        bins.equal_frequency_bin_stats(pred_events(spark, sf), by=["dataset", "model"], n_bins=150)
    )


@query
def eqfreq_continuous_labels(spark, sf):
    """Labels of many values far from zero, whose deviations are small against them."""
    shifted = F.col("y_true") + F.col("y_prob") * 2 + F.lit(1e8)
    rows_ = pred_lineitem(spark, sf).withColumn("y_true", shifted)
    return bins.equal_frequency_bin_stats(rows_, by=RUN).select(
        *RUN, F.col("bin").cast("bigint").alias("bin"), r6(F.col("mean_y") - F.lit(1e8), 4).alias("mean_shift"),
        r6("std_y", 5).alias("std_y"), "n",
    )


@query
def approximate_edges(spark, sf):
    """Sketched edges per run: how far their ranks are off, against what is allowed."""
    source = pred_lineitem(spark, sf).select(*RUN, "y_prob")
    edges = materialize(bins.approximate_edges(source, by=RUN, n_bins=20, accuracy=100))
    # Ranks of the edges: rows at most, and below, each of them.
    ranked = keys.join_parameters(source, edges, RUN, keys.table_bytes(edges, arrays=["edges"]))
    at_most = ranked.select(*RUN, "y_prob", F.posexplode("edges").alias("j", "edge")).groupBy(*RUN, "j").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("y_prob") < F.col("edge"), 1)).alias("below"),
        F.count(F.when(F.col("y_prob") <= F.col("edge"), 1)).alias("upto"),
    )
    wanted = F.col("j") * F.col("n") / F.lit(20)
    slack = F.col("n") / F.lit(100) + F.lit(1)
    within = (F.col("below") <= wanted + slack) & (F.col("upto") >= wanted - slack)
    return at_most.select(*RUN, F.col("j").cast("bigint").alias("j"), "n", within.alias("within"))


@query
def ece_by_run(spark, sf):
    return precise(metrics.expected_calibration_error(pred_lineitem(spark, sf), by=RUN))


@query
def ece_overall(spark, sf):
    return precise(metrics.expected_calibration_error(pred_lineitem(spark, sf), n_bins=15))


@query
def brier(spark, sf):
    return precise(metrics.brier_score(pred_lineitem(spark, sf), by=RUN))


def pred_missing(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.frame(spark, sf, fixtures.PRED_MISSING)


@query
def metrics_bundle_missing(spark, sf):
    """All metrics where labels and scores are missing; every run has a row."""
    return precise(metrics.calculate_metrics(pred_missing(spark, sf), by=["dataset", "prompt"]))


@query
def ece_missing(spark, sf):
    return precise(metrics.expected_calibration_error(pred_missing(spark, sf), by=["dataset", "prompt"]))


@query
def bin_stats_missing(spark, sf):
    return precise(bins.bin_stats(pred_missing(spark, sf), by=["dataset"]))


@query
def eqfreq_missing(spark, sf):
    return precise(bins.equal_frequency_bin_stats(pred_missing(spark, sf), by=["dataset"]))


@query
def accuracy(spark, sf):
    return precise(metrics.accuracy(pred_lineitem(spark, sf), by=RUN))


@query
def roc_auc(spark, sf):
    return precise(metrics.roc_auc(pred_lineitem(spark, sf), by=RUN))


@query
def roc_auc_overall(spark, sf):
    """One group holding every row."""
    return precise(metrics.roc_auc(pred_lineitem(spark, sf)))


@query
def average_precision(spark, sf):
    return precise(metrics.average_precision(pred_lineitem(spark, sf), by=RUN))


@query
def metrics_bundle(spark, sf):
    return precise(metrics.calculate_metrics(pred_lineitem(spark, sf), by=RUN))


@query
def metrics_labels(spark, sf):
    return precise(
        metrics.calculate_metrics(fixtures.frame(spark, sf, fixtures.PRED_LABELS), by=["lang"])
    )


@query
def nll(spark, sf):
    return rounded(metrics.negative_log_likelihood(pred_lineitem(spark, sf), by=RUN))


@query
def nll_given_log_t(spark, sf):
    return rounded(
        metrics.negative_log_likelihood(pred_lineitem(spark, sf), by=RUN, log_temperature=0.4)
    )


@query
def clip_logit_sigmoid(spark, sf):
    z = logit("y_prob")
    return rounded(
        pred_events(spark, sf).select(
            "event_id", clip("y_prob").alias("clipped"), z.alias("z"), sigmoid(z, 2.5).alias("p")
        )
    )


# -- calibrators ------------------------------------------------------------------


def _split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col("split") == "train"), df.where(F.col("split") == "test")


def _applied(spark, sf, scaling) -> DataFrame:
    train, test = _split(pred_events(spark, sf))
    out = scaling(train, test, by=["dataset", "model"])
    return rounded(out.select("event_id", "dataset", "model", "y_prob", "p_cal"))


@query
def histogram_scaling(spark, sf):
    return _applied(spark, sf, calibration.histogram_scaling)


@query
def histogram_scaling_gaps(spark, sf):
    """Training rows leave bins empty, which are then interpolated."""
    train, test = _split(pred_events(spark, sf))
    train = train.where("y_prob <= 0.3 or (y_prob > 0.6 and y_prob <= 0.8)")
    out = calibration.histogram_scaling(train, test, by=["dataset"])
    return rounded(out.select("event_id", "dataset", "y_prob", "p_cal"))


@query
def isotonic_scaling(spark, sf):
    return _applied(spark, sf, calibration.isotonic_scaling)


@query
def isotonic_continuous(spark, sf):
    """Mean calibrated value per run of a fit on continuous probabilities."""
    train, test = _split(pred_lineitem(spark, sf))
    out = calibration.isotonic_scaling(train, test, by=RUN)
    return rounded(
        out.groupBy(*RUN).agg(F.avg("p_cal").alias("mean_cal"), F.count("p_cal").alias("n"))
    )


@query
def isotonic_continuous_labels(spark, sf):
    """Mean calibrated value per run of a fit on labels of many values."""
    label = F.col("y_true") * F.lit(0.25) + F.col("y_prob") * F.lit(0.5)
    train, test = _split(pred_lineitem(spark, sf).withColumn("y_true", label))
    out = calibration.isotonic_scaling(train, test, by=RUN)
    return rounded(
        out.groupBy(*RUN).agg(F.avg("p_cal").alias("mean_cal"), F.count("p_cal").alias("n"))
    )


@query
def interpolate_many_knots(spark, sf):
    """Prices along order keys, per order status, at keys between those of the knots."""
    orders = fixtures.table(spark, sf, "orders")
    knots = orders.where("o_orderkey % 3 = 0").select(
        "o_orderstatus", F.col("o_orderkey").cast("double").alias("knot_x"),
        F.col("o_totalprice").cast("double").alias("knot_y"),
    )
    asked = orders.select("o_orderkey", "o_orderstatus", F.col("o_orderkey").cast("double").alias("x"))
    found = interpolation.interpolate_rows(asked, knots, by=["o_orderstatus"])
    return found.select("o_orderkey", "o_orderstatus", r6(F.col("y") + F.lit(1.23e-5), 3).alias("y"))


@query
def platt_params(spark, sf):
    train, _ = _split(pred_lineitem(spark, sf))
    return rounded(calibration.fit_platt(train, by=RUN).parameters)


@query
def platt_scaling(spark, sf):
    return _applied(spark, sf, calibration.platt_scaling)


@query
def temperature_params(spark, sf):
    train, _ = _split(pred_lineitem(spark, sf))
    return rounded(calibration.fit_temperature(train, by=RUN).parameters)


@query
def temperature_scaling(spark, sf):
    return _applied(spark, sf, calibration.temperature_scaling)


# -- reliability tables -----------------------------------------------------------


@query
def reliability_bars(spark, sf):
    return precise(curves.reliability_bars(pred_lineitem(spark, sf), by=RUN))


@query
def reliability_bars_plain(spark, sf):
    return precise(curves.reliability_bars(pred_events(spark, sf), by=["dataset"], eps=0.0))


@query
def pooled_bars(spark, sf):
    """All runs of a dataset as one: the run is left out of the grouping."""
    return precise(curves.reliability_bars(pred_lineitem(spark, sf), by=["dataset"]))


@query
def eqfreq_curve(spark, sf):
    return rounded(curves.equal_frequency_curve(pred_lineitem(spark, sf), by=RUN))


def _mean_curve(spark, sf, band):
    out = curves.mean_curve(
        pred_lineitem(spark, sf), ["model", "prompt"], by=["dataset"], error_band=band
    )
    return rounded(out)


@query
def mean_curve_none(spark, sf):
    return _mean_curve(spark, sf, None)


@query
def mean_curve_std(spark, sf):
    return _mean_curve(spark, sf, "std")


@query
def mean_curve_stderr(spark, sf):
    return _mean_curve(spark, sf, "stderr")


@query
def mean_curve_minmax(spark, sf):
    return _mean_curve(spark, sf, "minmax")


@query
def curve_multi(spark, sf):
    points = bins.equal_frequency_bin_stats(pred_lineitem(spark, sf), by=RUN)
    return rounded(curves.curve_of_points(points, ["model", "prompt"], by=["dataset"]))


# -- analysis of metric tables ----------------------------------------------------


@query
def run_metric_table(spark, sf):
    return precise(run_metrics(spark, sf))


@query
def zscore_by_dataset(spark, sf):
    out = analysis.zscore(run_metrics(spark, sf), ["ece", "brier_score"])
    return rounded(out.select(*RUN, "ece_norm", "brier_score_norm"))


@query
def dataset_weights(spark, sf):
    out = analysis.with_group_size(run_metrics(spark, sf))
    return rounded(out.select(*RUN, "dataset_weight"))


@query
def group_sizes(spark, sf):
    return rounded(analysis.group_sizes(run_metrics(spark, sf)))


@query
def weighted_ece_by_size(spark, sf):
    weighted = analysis.with_group_size(run_metrics(spark, sf))
    return rounded(analysis.weighted_mean(weighted, "ece", "dataset_weight", out="weighted_ece"))


@query
def box_stats(spark, sf):
    scored = analysis.zscore(run_metrics(spark, sf), ["brier_score"])
    return rounded(analysis.box_stats(scored, "brier_score_norm"))


@query
def box_outliers(spark, sf):
    out = analysis.box_outliers(table_with_value(spark, sf), "value", ["event_type"])
    return rounded(out)


def table_with_value(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.table(spark, sf, "events").select("event_id", "event_type", "value")


@query
def lowess_trend(spark, sf):
    return rounded(analysis.lowess_trend(run_metrics(spark, sf), "model_size", "ece", ["prompt"]))


# -- text and arrays --------------------------------------------------------------


def _extracted(df: DataFrame) -> DataFrame:
    return df.select("id", parse_output("text").alias("r")).select(
        "id", F.col("r.answer").alias("prediction"), r6("r.confidence").alias("verb_conf")
    )


@query
def extract_answers(spark, sf):
    return _extracted(fixtures.frame(spark, sf, fixtures.TEXT_OUTPUTS))


@query
def extract_answers_documents(spark, sf):
    """Answers after the whole text of a document."""
    return _extracted(fixtures.frame(spark, sf, fixtures.DOCUMENT_OUTPUTS))


@query
def extracted_calibration(spark, sf):
    """From model text to ECE: extraction, missing values, binning."""
    found = _extracted(fixtures.frame(spark, sf, fixtures.TEXT_OUTPUTS))
    scored = found.select(
        (F.col("id") % 12).alias("template"),
        "verb_conf",
        F.when(F.col("prediction").rlike("^[0-9]*[02468]$"), 1).otherwise(0).alias("correct"),
    )
    return precise(
        metrics.expected_calibration_error(scored, "correct", "verb_conf", by=["template"])
    )


# The token arrays below are runs of small integers, so that needles repeat.
def token_rows(spark: SparkSession, sf: str) -> DataFrame:
    step = "transform(sequence(1, 24), i -> cast((i * i + event_id) % 7 as int))"
    needle = "transform(sequence(1, 2), i -> cast((i * 3 + user_id) % 7 as int))"
    return fixtures.table(spark, sf, "events").selectExpr(
        "event_id",
        f"{step} AS content_ids",
        f"CASE WHEN event_id % 5 = 0 THEN NULL ELSE {needle} END AS prediction_ids",
        "transform(sequence(1, 24), i -> -cast((i * 37 + event_id) % 101 as double) / 8D) AS logprobs",
    )


@query
def find_subsequence(spark, sf):
    found = sequences.find_subsequence("content_ids", "prediction_ids")
    return token_rows(spark, sf).select("event_id", found.cast("bigint").alias("position"))


@query
def answer_logprobs(spark, sf):
    found = sequences.answer_logprobs("content_ids", "prediction_ids", "logprobs")
    rows_ = token_rows(spark, sf).select("event_id", found.alias("f"))
    return rows_.select("event_id", "f.reason", F.col("f.logprobs").alias("l")).select(
        "event_id",
        "reason",
        F.size("l").cast("bigint").alias("n"),
        r6(F.get("l", F.lit(0))).alias("first"),
        r6(F.get("l", F.lit(1))).alias("second"),
    )


@query
def gsm8k_records(spark, sf):
    """Answer, confidence and log-probabilities of the answer's tokens, in one step from text."""
    turns = fixtures.frame(spark, sf, fixtures.TURN_OUTPUTS).withColumnRenamed("text", "content")
    given = F.transform(
        assembly.text_tokens(F.col("content")), lambda t, i: -(F.length(t) * 8 + i % 8).cast("double") / 16.0
    )
    records_ = assembly.math_records(turns.withColumn("token_logprobs", given))
    return records_.select(
        "id", "prediction", r6("verb_conf").alias("verb_conf"),
        F.size("logprobs").cast("bigint").alias("n"),
        r6(F.get("logprobs", F.lit(0))).alias("first"),
        r6(F.get("logprobs", F.size("logprobs") - 1)).alias("last"),
    )


@query
def arc_records(spark, sf):
    """Answer, confidence and label probabilities, the logits being lengths of choices."""
    outputs = fixtures.frame(spark, sf, fixtures.DOCUMENT_OUTPUTS).withColumnRenamed("text", "content")
    documents = fixtures.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", "source", "n_chars")
    logits = F.array(
        F.length("lang") / 2.0, F.length("source") / 2.0, (F.col("n_chars") % 5).cast("double"), F.lit(1.0)
    )
    given = outputs.join(documents, "id").withColumns(
        {"logits": logits, "label_ids": F.array(F.lit(3), F.lit(0), F.lit(2))}
    )
    records_ = assembly.choice_records(given)
    return records_.select(
        "id", "prediction", r6("verb_conf").alias("verb_conf"),
        *[r6(F.get("label_probs", F.lit(i))).alias(f"p{i}") for i in range(3)],
    )


@query
def prompt_pipeline(spark, sf):
    """Benchmark, first questions, choices, messages and prompt as one plan."""
    questions = rows.head_n(fixtures.table(spark, sf, "benchmark"), ["item_id"], 150).select(
        "item_id", "text",
        F.struct(
            F.slice(F.split("text", " "), 1, 4).alias("text"),
            F.array(*[F.lit(x) for x in "ABCD"]).alias("label"),
        ).alias("choices"),
    )
    asked = prompts.format_question("text", "choices.text", "choices.label")
    messages = questions.select(
        "item_id", prompts.chat_messages(F.lit("Answer in JSON."), asked).alias("m")
    )
    chat = F.array_join(F.transform("m", lambda t: F.concat_ws(": ", t["role"], t["content"])), "\n")
    prompt = prompts.continuation_prompt(chat, F.lit("thought"), F.col("item_id") % 2 == 0, prompts.ARC_ANSWER_PREFIX)
    return messages.select("item_id", prompt.alias("prompt"))


@query
def content_tail(spark, sf):
    """Tokens kept after the prompt is cut down to its answer prefix."""
    kept = sequences.tail_with_prefix(
        "content_ids", (10 + F.col("event_id") % 14).cast("int"), F.lit(4)
    )
    return token_rows(spark, sf).select("event_id", kept.alias("k")).select(
        "event_id",
        F.size("k").cast("bigint").alias("n"),
        F.get("k", F.lit(0)).cast("bigint").alias("first"),
        F.try_element_at("k", F.lit(-1)).cast("bigint").alias("last"),
    )


@query
def label_softmax(spark, sf):
    ids = F.array(*[(F.col("label") + F.lit(5 * i)) % 64 for i in range(4)])
    probs = sequences.label_probabilities("embedding", ids)
    return (
        fixtures.table(spark, sf, "embeddings")
        .select("vec_id", F.posexplode(probs).alias("choice", "p"))
        .select("vec_id", F.col("choice").cast("bigint").alias("choice"), r6("p").alias("p"))
    )


@query
def token_logprob(spark, sf):
    return fixtures.table(spark, sf, "embeddings").select(
        "vec_id", r6(sequences.token_log_probability("embedding", "label")).alias("logprob")
    )


@query
def sequence_logprobs(spark, sf):
    """Eight positions with a vocabulary of eight, cut out of each vector."""
    logits = F.transform(
        F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, F.lit(8))
    )
    tokens = F.transform(
        F.sequence(F.lit(0), F.lit(7)), lambda i: ((F.col("vec_id") + i * 3) % 8).cast("int")
    )
    scored = sequences.sequence_log_probabilities("logits", "tokens")
    return (
        fixtures.table(spark, sf, "embeddings")
        .select("vec_id", logits.alias("logits"), tokens.alias("tokens"))
        .select("vec_id", F.posexplode(scored).alias("step", "l"))
        .select("vec_id", F.col("step").cast("bigint").alias("step"), r6("l").alias("logprob"))
    )


# -- prompts and row order --------------------------------------------------------


@query
def format_question(spark, sf):
    """Documents as questions; some have fewer choices than labels, some none."""
    texts = F.expr(
        "CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN array(lang, source) "
        "ELSE array(lang, source, cast(n_chars AS string)) END"
    )
    labels = F.array(F.lit("A"), F.lit("B"), F.lit("C"))
    return fixtures.table(spark, sf, "documents").select(
        "doc_id", prompts.format_question("text", texts, labels).alias("prompt")
    )


@query
def chat_messages(spark, sf):
    """Every turn after a system message, with the role it has."""
    messages = prompts.chat_messages(F.lit("Answer in JSON."), "text", "role")
    return (
        fixtures.table(spark, sf, "conversations")
        .select("conv_id", "turn", F.posexplode(messages).alias("pos", "m"))
        .select("conv_id", "turn", F.col("pos").cast("bigint").alias("pos"), "m.role", "m.content")
    )


@query
def continuation_prompt(spark, sf):
    thinking = F.col("turn") % 2 == 0
    return fixtures.table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        prompts.continuation_prompt("text", "role", thinking, prompts.GSM8K_ANSWER_PREFIX).alias("math"),
        prompts.continuation_prompt("text", "role", thinking, prompts.ARC_ANSWER_PREFIX).alias("choice"),
    )


@query
def strip_newlines(spark, sf):
    padded = F.concat(F.lit("\n\n "), F.col("text"), F.lit(" \n"))
    return fixtures.table(spark, sf, "documents").select(
        "doc_id", prompts.strip_newlines(padded).alias("text")
    )


@query
def long_head(spark, sf):
    """Nine tenths of the line items in their order, chosen by counting."""
    items = fixtures.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    n = items.count() * 9 // 10
    return rows.head_n(items, ["l_orderkey", "l_linenumber"], n).groupBy("l_linenumber").agg(
        F.count(F.lit(1)).alias("n"), F.max("l_orderkey").alias("last"))


@query
def head_n(spark, sf):
    return rows.head_n(fixtures.table(spark, sf, "orders"), ["o_orderkey"], 250).select(
        "o_orderkey", "o_custkey", "o_orderstatus"
    )


@query
def record_index(spark, sf):
    events = fixtures.table(spark, sf, "events").select("event_id", "user_id")
    return rows.with_row_index(events, ["user_id", "event_id"])


# -- sources and sinks ------------------------------------------------------------


def _written_runs(spark: SparkSession, sf: str) -> tuple[DataFrame, str]:
    """Predictions as one CSV folder per run, and a JSON manifest naming them."""
    base = scratch_path(spark, "runs")
    predictions = pred_events(spark, sf).select(
        *RUN,
        F.concat_ws("_", *RUN).alias("run"),
        F.concat(F.lit('a "quoted", '), F.col("event_id")).alias("question"),
        F.col("y_true").alias("gpt_eval"),
        F.col("y_prob").alias("confidence"),
    )
    # Several part files per run, so that a large one is read by several tasks.
    predictions.drop(*RUN).repartition(4).write.partitionBy("run").csv(
        base, header=True, escape='"'
    )
    manifest = predictions.select(*RUN, F.concat(F.lit("run="), "run").alias("csv_file")).distinct()
    # One JSON array, as the manifest file is.
    listed = manifest.agg(F.to_json(F.collect_list(F.struct("csv_file", *RUN))).alias("value"))
    listed.write.text(f"{base}-manifest")
    return runs.read_manifest(spark, f"{base}-manifest"), base


@query
def manifest_join(spark, sf):
    """Manifest, one scan of all run files, metrics per run."""
    manifest, base = _written_runs(spark, sf)
    predictions = runs.read_predictions(spark, manifest, base)
    return precise(metrics.calculate_metrics(predictions, by=RUN))


@query
def selected_run_bins(spark, sf):
    """Bins of the runs a manifest filter leaves; only their files are opened."""
    manifest, base = _written_runs(spark, sf)
    chosen = runs.select_runs(manifest, dataset="click", model="m_large")
    predictions = runs.read_predictions(spark, chosen, base)
    return precise(bins.bin_stats(predictions, by=["prompt"]))


@query
def rows_binned(spark, sf):
    stats = bins.bin_stats(pred_events(spark, sf), by=["dataset"])
    return rounded(stats.groupBy("dataset").agg(F.sum("n").alias("n")))


def _gsm8k_records(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.table(spark, sf, "events").select(
        F.concat(F.lit("run_"), F.col("user_id") % 3).alias("run_id"),
        F.col("event_id").alias("index"),
        F.col("event_type").alias("question"),
        F.col("user_id").cast("string").alias("answer"),
        F.concat(F.col("props"), F.lit('{"index": '), F.col("event_id")).alias("content"),
        F.when(F.col("event_id") % 2 == 0, F.lit("thought")).alias("thinking"),
        F.when(F.col("event_id") % 3 > 0, F.col("user_id").cast("string")).alias("prediction"),
        F.array(F.col("value"), -F.col("value")).alias("logprobs"),
        F.when(
            F.col("event_id") % 4 > 0, (F.col("event_id") % 101).cast("double") / 100
        ).alias("verb_conf"),
    )


def _read_gsm8k(spark: SparkSession, sf: str) -> DataFrame:
    """Write up to four records back to back per line, then read them."""
    path = scratch_path(spark, "gsm8k")
    records_ = _gsm8k_records(spark, sf)
    fields = [c.split(" ")[0] for c in GSM8K_OUTPUTS.split(", ")]
    text = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    # Python's writer puts a space after the first key's colon.
    lines = (
        records_.select(
            "run_id", F.floor(F.col("index") / 4).alias("batch"), "index",
            F.regexp_replace(text, r'^\{"index":', '{"index": ').alias("j"),
        )
        .groupBy("run_id", "batch")
        .agg(F.array_sort(F.collect_list(F.struct("index", "j"))).alias("b"))
        .select("run_id", F.array_join(F.transform("b", lambda r: r["j"]), "").alias("value"))
    )
    lines.write.partitionBy("run_id").text(path)
    return records.read_gsm8k_outputs(spark, f"{path}/*/part-*")


@query
def read_concat_json(spark, sf):
    return rounded(
        _read_gsm8k(spark, sf).select(
            "run_id", "index", "question", "answer", "content", "thinking", "prediction",
            "verb_conf", F.get("logprobs", F.lit(1)).alias("second_logprob"),
        )
    )


def _arc_records(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.table(spark, sf, "documents").select(
        F.concat(F.lit("run_"), F.col("lang")).alias("run_id"),
        F.concat(F.lit("q"), F.col("doc_id")).alias("id"),
        F.col("text").alias("question"),
        F.col("lang").alias("answer"),
        F.array(F.lit("A"), F.lit("B")).alias("labels"),
        F.col("source").alias("content"),
        F.lit(None).cast("string").alias("thinking"),
        F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("prediction"),
        F.array(F.lit(0.25), F.lit(0.75)).alias("label_probs"),
        (F.col("doc_id") % 10).cast("double").alias("verb_conf"),
    )


def _read_arc(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "arc")
    records.write_outputs(_arc_records(spark, sf), path)
    return records.read_arc_outputs(spark, f"{path}/*/part-*")


@query
def arc_outputs(spark, sf):
    """Records written as JSON lines per run and read back."""
    fields = [c.split(" ")[0] for c in ARC_OUTPUTS.split(", ")]
    plain = [c for c in fields if c not in ("labels", "label_probs")]
    return rounded(
        _read_arc(spark, sf).select(
            "run_id", *plain, F.array_join("labels", "|").alias("labels"),
            F.get("label_probs", F.lit(1)).alias("second_prob"),
        )
    )


@query
def union_runs(spark, sf):
    both = records.unify_outputs(_read_gsm8k(spark, sf), _read_arc(spark, sf))
    return rounded(
        both.select("run_id", "item_id", "answer", "prediction", "verb_conf", "index", "id")
    )


@query
def run_metadata(spark, sf):
    """Pretty-printed metadata files, one folder per run."""
    path = scratch_path(spark, "metadata")
    listed = pred_events(spark, sf).select(*RUN).distinct()
    meta = F.struct(
        F.col("model"),
        F.col("dataset"),
        F.lit(4).alias("batch_size"),
        (F.col("prompt") == "0").alias("thinking"),
        F.date_format(F.timestamp_seconds(F.col("prompt").cast("int") * 86400), "yyyyMMdd_HHmmss").alias("timestamp"),
        F.lit(None).cast("int").alias("max_samples"),
        F.concat(F.lit("line one\nprompt "), "prompt").alias("system_prompt"),
    )
    listed.select(
        F.concat_ws("_", *RUN).alias("run_id"), F.to_json(meta, {"pretty": "true"}).alias("value")
    ).repartition("run_id").write.partitionBy("run_id").option("lineSep", "\n").text(path)
    found = runs.read_run_metadata(spark, path, "part-*")
    return rounded(
        found.select(
            "run_id", "model", "dataset", "batch_size", "thinking", "timestamp", "max_samples",
            "system_prompt",
        )
    )


def _run_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata of one run per document source."""
    return fixtures.table(spark, sf, "documents").groupBy("source").agg(
        F.count(F.lit(1)).cast("int").alias("batch_size"), F.max("doc_id").cast("int").alias("max_samples"),
        F.min("lang").alias("dataset"),
    ).select(
        F.concat(F.lit("run_"), "source").alias("run_id"), F.col("source").alias("model"), "dataset",
        F.lit(None).cast("string").alias("dataset_config"), "batch_size",
        (F.col("batch_size") % 2 == 0).alias("thinking"), F.lit("20250101_000000").alias("timestamp"),
        F.lit("cpu").alias("device"), "max_samples", F.concat(F.lit("a\nb "), "source").alias("system_prompt"),
        F.lit(None).cast("string").alias("git_commit"),
    )


@query
def run_table_roundtrip(spark, sf):
    """A runs table that grows by two writes, read back beside the side-car of each run."""
    listed = _run_documents(spark, sf)
    path, side = scratch_path(spark, "runs"), scratch_path(spark, "side-cars")
    early = F.col("model") < "src2"
    runs.write_run_table(listed.where(early), path)
    runs.write_run_table(listed.where(~early), path)
    meta = F.to_json(F.struct(*[c for c in listed.columns if c != "run_id"]), {"pretty": "true"})
    listed.select("run_id", meta.alias("value")).write.partitionBy("run_id").text(side)
    cars = runs.read_run_metadata(spark, side, "part-*")
    fields = [c for c in listed.columns if c != "run_id"]
    beside = cars.select("run_id", F.struct(*fields).alias("car"))
    stored = runs.read_run_table(spark, path)
    return rounded(
        stored.join(beside, "run_id").select(
            "run_id", "model", "dataset", "batch_size", "thinking", "max_samples", "system_prompt",
            (F.struct(*fields) == F.col("car")).alias("same"),
        )
    )


@query
def arc_outputs_added(spark, sf):
    """A results folder to which a second batch of runs is added, read back as a whole."""
    path = scratch_path(spark, "arc-added")
    all_runs = _arc_records(spark, sf)
    first = F.col("run_id").isin("run_en", "run_de")
    records.write_outputs(all_runs.where(first), path)
    records.write_outputs(all_runs.where(~first), path)
    back = records.read_arc_outputs(spark, f"{path}/*/part-*")
    return rounded(back.select("run_id", "id", "answer", "prediction", "verb_conf"))


@query
def run_names(spark, sf):
    return fixtures.table(spark, sf, "events").select("event_id", runs.run_id("ts").alias("run_id"))


@query
def benchmark_scan(spark, sf):
    """Questions of one configuration and split of a partitioned export."""
    path = scratch_path(spark, "benchmark")
    fixtures.table(spark, sf, "documents").select(
        F.col("text").alias("question"),
        F.col("doc_id").cast("string").alias("answer"),
        F.col("lang").alias("config"),
        F.when(F.col("doc_id") % 4 == 0, "test").otherwise("train").alias("split"),
    ).write.partitionBy("config", "split").parquet(path)
    found = runs.read_benchmark(spark, path, "question string, answer string", "en", "test")
    return found.select("question", "answer", "config", "split")
