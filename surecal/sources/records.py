"""Evaluation records: one JSON object per question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.probability import number
from ..schemas import ARC_OUTPUTS, GSM8K_OUTPUTS
from .append import append_runs
from .runs import run_of_file

# Between two objects written back to back. Inside a JSON string the quote would be
# escaped, so the look-ahead cannot match there.
_NEXT_RECORD = r'(?<=\})(?=\{"index":)'


def concatenated_records(line: Column | str, schema: str = GSM8K_OUTPUTS) -> Column:
    """All records of a line that holds one or more objects back to back."""
    text = F.col(line) if isinstance(line, str) else line
    parts = F.filter(F.split(text, _NEXT_RECORD), lambda p: F.trim(p) != "")
    return F.transform(parts, lambda p: F.from_json(p, schema, {"mode": "FAILFAST"}))


def read_gsm8k_outputs(spark: SparkSession, path: str) -> DataFrame:
    """Records of one or more runs; a line may hold a whole batch of objects.

    A damaged record is an error, never a silently missing row.
    """
    lines = spark.read.text(path).select(run_of_file().alias("run_id"), "value")
    return (
        lines.select("run_id", F.explode(concatenated_records("value")).alias("r"))
        .select("run_id", "r.*")
        .withColumn("verb_conf", number("verb_conf"))
    )


def read_arc_outputs(spark: SparkSession, path: str) -> DataFrame:
    """Records of one or more runs, one object per line."""
    return (
        spark.read.schema(ARC_OUTPUTS)
        .option("mode", "FAILFAST")
        .json(path)
        .select(run_of_file().alias("run_id"), "*")
        .withColumn("verb_conf", number("verb_conf"))
    )


def write_outputs(records: DataFrame, path: str, file_format: str = "json") -> list[str]:
    """Add records to ``path``, below one folder per run, NULLs spelled out; the folders added.

    The caller chooses ``run_id``; the records of a run are never added to or overwritten.
    """
    options = {"ignoreNullFields": "false"} if file_format == "json" else {}
    return append_runs(records, path, file_format, **options)


def unify_outputs(gsm8k: DataFrame, arc: DataFrame) -> DataFrame:
    """Both record kinds in one table, keyed by ``item_id``."""
    left = gsm8k.withColumn("item_id", F.col("index").cast("string"))
    right = arc.withColumn("item_id", F.col("id"))
    return left.unionByName(right, allowMissingColumns=True)
