"""Adding runs to a folder that holds one sub-folder per run.

New runs are written beside the others under a name that readers skip, checked against what
is there, and moved into place one folder at a time. A run is there whole or not at all, and
never twice.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_runs(rows: DataFrame, path: str, file_format: str, **options: str) -> list[str]:
    """Write ``rows`` below ``path``, one folder per ``run_id``; the folders that were added.

    A run that is there already, and rows without a run, are refused and nothing is added. If
    the job is cut off between two moves, those moved stay and the others are not there.
    """
    spark = rows.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def at(name: str):
        return jvm.org.apache.hadoop.fs.Path(name)

    root = path.rstrip("/")
    stage = f"{root}/_added-{uuid.uuid4().hex}"
    files = at(root).getFileSystem(conf)
    run = F.when(F.col("run_id").isNotNull(), F.col("run_id")).otherwise(
        F.raise_error(F.lit("a row without a run_id")).cast(rows.schema["run_id"].dataType)
    )
    try:
        rows.withColumn("run_id", run).write.partitionBy("run_id").options(**options).format(file_format).save(stage)
        # One entry per run.
        names = sorted(
            f.getPath().getName() for f in files.listStatus(at(stage)) if f.getPath().getName().startswith("run_id=")
        )
        there = [n for n in names if files.exists(at(f"{root}/{n}"))]
        if there:
            raise FileExistsError(f"runs already in {root}: {', '.join(there)}")
        for name in names:
            if not files.rename(at(f"{stage}/{name}"), at(f"{root}/{name}")):
                raise OSError(f"cannot move {name} into {root}")
    finally:
        files.delete(at(stage), True)
    return names
