"""Run manifests, per-run prediction files, run metadata and benchmarks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.probability import number
from ..schemas import MANIFEST, RUN_METADATA
from .append import append_runs

# Cell texts that stand for a missing value.
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per run from a JSON array of flat objects; a damaged file is an error.

    All attributes are kept. The four known ones come first and are text, present or not;
    others have the types that their values show.
    """
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    known = [c.split()[0] for c in MANIFEST.split(", ")]
    seen = reader.json(path)
    others = [f"`{f.name}` {f.dataType.simpleString()}" for f in seen.schema if f.name not in known]
    return reader.schema(", ".join([MANIFEST, *others])).json(path)


def select_runs(manifest: DataFrame, **equal: str) -> DataFrame:
    """Runs whose attributes equal all given values, e.g. ``dataset="HotpotQA"``."""
    for name, value in equal.items():
        manifest = manifest.where(F.col(name) == F.lit(value))
    return manifest


def _plain_path(path: Column | str) -> Column:
    """A path without dot parts and doubled slashes."""
    joined = F.regexp_replace(path, r"(^|/)(\./)+", "$1")
    return F.regexp_replace(F.regexp_replace(joined, "/+", "/"), "^/", "")


def _path_below(base_dir: str) -> Column:
    """Path of the scanned file below ``base_dir``."""
    base = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*:/*", "/", base_dir)
    base = re.sub(r"/+", "/", re.sub(r"/(\./)+", "/", base)).rstrip("/")
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return F.substr(path, F.instr(path, base) + F.lit(len(base) + 1))


def _cell_number(text: Column) -> Column:
    trimmed = F.trim(text)
    return (
        F.when(trimmed.isin(MISSING_TEXTS), F.lit(None).cast("double"))
        .when(F.lower(trimmed) == "true", F.lit(1.0))
        .when(F.lower(trimmed) == "false", F.lit(0.0))
        .otherwise(trimmed.cast("double"))
    )


def read_predictions(
    spark: SparkSession,
    manifest: DataFrame,
    base_dir: str,
    label: str = "gpt_eval",
    confidence: str = "confidence",
    same_header: bool = True,
    multi_line: bool = True,
) -> DataFrame:
    """Label and confidence of every row of every run, with the run's attributes.

    ``manifest`` is filtered first: only the files it still names are opened, all in
    one scan, and each row finds its run by the name of its file, or of the folder of part
    files it lies in. A scanned file without a run is an error. With ``same_header`` a file
    whose columns differ from the first one's is an error; without, one job reads the
    headers, and files are scanned once per distinct header.
    """
    manifest = manifest.withColumn("_name", _plain_path("csv_file"))
    names = sorted(r[0] for r in manifest.select("_name").distinct().collect())
    paths = [f"{base_dir.rstrip('/')}/{name}" for name in names]

    def reader():
        # Quotes are escaped by doubling; a quoted text may span lines.
        return (
            spark.read.option("header", True)
            .option("enforceSchema", False)
            .option("multiLine", multi_line)
            .option("escape", '"')
        )

    groups = [paths] if same_header else _by_header(spark, paths)
    scans = [
        reader().csv(group).select(
            _path_below(base_dir).alias("_file"),
            _cell_number(F.col(label)).alias("y_true"),
            number(_cell_number(F.col(confidence))).alias("y_prob"),
        )
        for group in groups
    ]
    rows = scans[0]
    for scan in scans[1:]:
        rows = rows.unionByName(scan)
    # A run by the whole path of its file, or else by the folder of its part files.
    runs = manifest.select("_name", F.struct(*[c for c in manifest.columns if c != "_name"]).alias("_run"))
    folder = F.regexp_replace(F.col("_file"), r"/part-[^/]*$", "")
    found = (
        rows.join(runs.select(F.col("_name").alias("_a"), F.col("_run").alias("_of_file")),
                  F.col("_file") == F.col("_a"), "left")
        .join(runs.select(F.col("_name").alias("_b"), F.col("_run").alias("_of_folder")),
              (folder == F.col("_b")) & F.col("_a").isNull(), "left")
    )
    run = F.coalesce("_of_file", "_of_folder")
    checked = F.when(run.isNotNull(), run).otherwise(
        F.raise_error(F.concat(F.lit("no run in the manifest for "), "_file")).cast(found.schema["_of_file"].dataType)
    )
    return found.select(checked.alias("_run"), "y_true", "y_prob").select("_run.*", "y_true", "y_prob")


def _by_header(spark: SparkSession, paths: list[str]) -> list[list[str]]:
    """Paths grouped by the first line of their files, read in one job."""
    lines = spark.read.text(paths).select(
        F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("file"),
        F.monotonically_increasing_id().alias("at"), "value",
        F.col("_metadata.file_block_start").alias("start"),
    )
    # One row per file; its first line is that of its first block.
    first = (
        lines.groupBy("file").agg(F.min_by("value", F.struct("start", "at")).alias("header"))
        .groupBy("header").agg(F.collect_list("file").alias("files"))
    )
    return sorted(sorted(r.files) for r in first.collect())


def run_id(timestamp: Column | str) -> Column:
    """Run name from its start time, to the second."""
    ts = F.col(timestamp) if isinstance(timestamp, str) else timestamp
    return F.concat(F.lit("run_"), F.date_format(ts, "yyyyMMdd_HHmmss"))


def run_of_file() -> Column:
    """Name of the directory a scanned file lies in."""
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return F.regexp_replace(folder, "^run_id=", "")


def read_run_metadata(
    spark: SparkSession, out_dir: str, file_name: str = "metadata.json"
) -> DataFrame:
    """One row per run from ``<run>/metadata.json``, with its ``run_id``; damage is an error."""
    return (
        spark.read.schema(RUN_METADATA)
        .option("multiLine", True)
        .option("mode", "FAILFAST")
        .json(f"{out_dir.rstrip('/')}/*/{file_name}")
        .select(run_of_file().alias("run_id"), "*")
    )


def write_run_table(runs: DataFrame, path: str) -> list[str]:
    """Add run metadata to the table at ``path``; a ``run_id`` that is there is refused."""
    return append_runs(runs, path, "parquet")


def read_run_table(spark: SparkSession, path: str) -> DataFrame:
    """The run metadata that :func:`write_run_table` stored, in its column order."""
    stored = spark.read.schema(f"{RUN_METADATA}, run_id string").parquet(path)
    return stored.select("run_id", *[c for c in stored.columns if c != "run_id"])


def read_benchmark(
    spark: SparkSession,
    path: str,
    schema: str,
    config: str | None = None,
    split: str | None = "test",
    file_format: str = "parquet",
) -> DataFrame:
    """Questions of a benchmark export laid out as ``config=.../split=...`` folders.

    Both filters select folders; no file outside them is opened.
    """
    layout = ", ".join(
        [schema]
        + (["config string"] if config is not None else [])
        + (["split string"] if split is not None else [])
    )
    questions = spark.read.schema(layout).format(file_format).load(path)
    if config is not None:
        questions = questions.where(F.col("config") == config)
    if split is not None:
        questions = questions.where(F.col("split") == split)
    return questions
