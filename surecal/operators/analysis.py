"""Analysis of metric tables: one row per run, compared across datasets and sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.probability import number
from ..functions.sequences import interpolate, let
from ..session import materialize
from .keys import (
    KEY,
    group_columns,
    group_key,
    join_group_values,
    join_parameters,
    table_bytes,
)
from .running import exact_quantiles, running_totals

# Model sizes in billions of (active) parameters.
MODEL_SIZES = {
    "gpt-4o-mini": 8,
    "gpt-4o": 200,
    "Llama-3.3-70B": 70,
    "DeepSeek-V3": 37,
}


def with_model_size(
    df: DataFrame, sizes: DataFrame, model: str = "model", size: str = "model_size"
) -> DataFrame:
    """Look up the size of each row's model; an unknown model is an error.

    ``sizes`` has one row per model, ``model`` and ``size``.
    """
    known = sizes.select(F.col(model).alias("_model"), F.col(size).alias("_size"))
    joined = df.join(known, df[model] == F.col("_model"), "left")
    checked = F.when(F.col("_size").isNotNull(), F.col("_size")).otherwise(
        F.raise_error(F.concat(F.lit("no size for model "), F.coalesce(F.col(model), F.lit("NULL"))))
        .cast(sizes.schema[size].dataType)
    )
    return joined.select(*[c for c in df.columns if c != size], checked.alias(size))


def model_sizes(spark) -> DataFrame:
    return spark.createDataFrame(list(MODEL_SIZES.items()), "model string, model_size int")


def _group_moments(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(
        *[F.avg(number(c)).alias(f"_{c}_mean") for c in columns],
        *[F.stddev_samp(number(c)).alias(f"_{c}_std") for c in columns],
        F.count(F.lit(1)).alias("_n"),
    )


def zscore(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = ("dataset",), suffix: str = "_norm"
) -> DataFrame:
    """Add ``<column>_norm``: distance from the group mean in sample deviations.

    NULL in a group of one row or without spread. The moments are aggregated and
    joined back, as a window would put a whole group into one task.
    """
    return join_group_values(df, _group_moments(df, columns, by), by).select(
        *df.columns,
        *[
            F.try_divide(number(c) - F.col(f"_{c}_mean"), F.col(f"_{c}_std")).alias(f"{c}{suffix}")
            for c in columns
        ],
    )


def with_group_size(
    df: DataFrame, by: Sequence[str] = ("dataset",), out: str = "dataset_weight"
) -> DataFrame:
    """Add the number of rows of the group to each of its rows."""
    return join_group_values(df, _group_moments(df, [], by), by).select(
        *df.columns, F.col("_n").alias(out)
    )


def group_sizes(df: DataFrame, by: Sequence[str] = ("dataset",)) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def weighted_mean(
    df: DataFrame, value: str, weight: str, by: Sequence[str] = ("model_size",), out: str = "weighted"
) -> DataFrame:
    """Weighted mean per group; one missing value makes the group's mean NULL."""
    x, w = number(value), number(weight)
    complete = F.count(F.when(x.isNotNull() & w.isNotNull(), 1)) == F.count(F.lit(1))
    return df.groupBy(*by).agg(
        F.when(complete, F.try_divide(F.sum(x * w), F.sum(w))).alias(out)
    )


def box_stats(df: DataFrame, value: str, by: Sequence[str] = ("model_size",)) -> DataFrame:
    """Quartiles, whiskers and outlier count per group.

    Whiskers end at the last value within 1.5 interquartile ranges of the box.
    """
    inside = _with_fences(df, value, by)
    kept = F.when(F.col("_in"), F.col("_x"))
    return (
        inside.groupBy(group_key(by))
        .agg(
            *[F.first(F.get("q", F.lit(i))).alias(name) for i, name in enumerate(("q1", "median", "q3"))],
            F.min(kept).alias("_lo"),
            F.max(kept).alias("_hi"),
            F.count("_x").alias("n"),
            F.count(F.when(~F.col("_in"), 1)).alias("n_outliers"),
        )
        .select(
            *group_columns(by),
            "q1", "median", "q3",
            F.least("_lo", "q1").alias("whisker_lo"),
            F.greatest("_hi", "q3").alias("whisker_hi"),
            "n", "n_outliers",
        )
    )


def box_outliers(df: DataFrame, value: str, by: Sequence[str] = ("model_size",)) -> DataFrame:
    """The rows whose value lies beyond the whiskers."""
    return _with_fences(df, value, by).where(~F.col("_in")).select(*df.columns)


def _with_fences(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Rows with a value, and whether it lies within the fences of its group.

    Only the quartiles are written, one row per group.
    """
    present = df.withColumn("_x", number(value)).where(F.col("_x").isNotNull())
    quartiles = exact_quantiles(df.select(*by, value), value, [0.25, 0.5, 0.75], by)
    q1, q3 = F.get("q", F.lit(0)), F.get("q", F.lit(2))
    reach = F.lit(1.5) * (q3 - q1)
    return join_group_values(present, quartiles, by).withColumn(
        "_in", (F.col("_x") >= q1 - reach) & (F.col("_x") <= q3 + reach)
    )


def _local_lines(points: Column, places: Column, n: Column, frac: float) -> Column:
    """Fitted value at each of ``places``: ``points`` is an ascending array of sums per cell.

    A cell weighs as a whole by its distance; its rows enter through their sums, taken from
    where the cell is.
    """
    k = F.greatest(F.floor(n * F.lit(frac) + F.lit(1e-10)).cast("long"), F.lit(1).cast("long"))

    def fit(x0: Column) -> Column:
        # The smallest radius that holds at least k rows.
        by_distance = F.array_sort(
            F.transform(
                points, lambda q: F.struct(F.abs(q["x"] - x0).alias("d"), q["rows"].alias("rows"))
            )
        )
        radius = F.aggregate(
            by_distance,
            F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0.0).alias("r")),
            lambda acc, q: F.when(acc["seen"] >= k, acc).otherwise(
                F.struct((acc["seen"] + q["rows"]).alias("seen"), q["d"].alias("r"))
            ),
            lambda acc: acc["r"],
        )

        def tricube(q: Column, r: Column) -> Column:
            u = F.try_divide(F.abs(q["x"] - x0), r)
            cube = F.lit(1.0) - u * u * u
            return (
                F.when(q["x"] == x0, F.lit(1.0))
                .when(u.isNull() | (u >= 0.999), F.lit(0.0))
                .when(u <= 0.001, F.lit(1.0))
                .otherwise(cube * cube * cube)
            )

        def sums(r: Column) -> Column:
            zero = F.lit(0.0)
            return F.aggregate(
                points,
                F.struct(*[zero.alias(c) for c in ("w", "x", "xx", "y", "xy")]),
                lambda acc, q: _added(acc, q, tricube(q, r), x0),
            )

        return let(radius, lambda r: let(sums(r), line))

    def line(s: Column) -> Column:
        # Weighted line through the sums, taken at x0, where x is counted from.
        mx, my = F.try_divide(s["x"], s["w"]), F.try_divide(s["y"], s["w"])
        var = F.greatest(F.try_divide(s["xx"], s["w"]) - mx * mx, F.lit(1e-12))
        cov = F.try_divide(s["xy"], s["w"]) - mx * my
        return my - cov / var * mx

    return F.transform(places, lambda x0: F.struct(x0.alias("x"), fit(x0).alias("fit")))


def _added(acc: Column, q: Column, weight: Column, x0: Column) -> Column:
    d = q["x"] - x0
    return F.struct(
        (acc["w"] + weight * q["w"]).alias("w"),
        (acc["x"] + weight * (q["wx"] + q["w"] * d)).alias("x"),
        (acc["xx"] + weight * (q["wxx"] + 2.0 * d * q["wx"] + q["w"] * d * d)).alias("xx"),
        (acc["y"] + weight * q["wy"]).alias("y"),
        (acc["xy"] + weight * (q["wxy"] + q["wy"] * d)).alias("xy"),
    )


def _cells(rows: DataFrame, cells: int) -> DataFrame:
    """``rows`` with ``_c``, the place of the cell of each x, and ``_last``, the greatest x.

    A group of up to ``cells`` distinct x has a cell for each. A larger one is cut by rank
    into so many stretches of about equal rows; ranks come from running totals, no task
    holds the group.
    """
    places = materialize(rows.groupBy(KEY, F.col("_x").alias("_v")).agg(F.sum("_n").alias("n")))
    sizes = places.groupBy(KEY).agg(F.count(F.lit(1)).alias("_distinct"), F.max("_v").alias("_last"))
    sized = join_group_values(rows, sizes, [KEY])
    if not sizes.where(F.col("_distinct") > cells).head(1):
        return sized.withColumn("_c", F.col("_x")).drop("_distinct")
    ranked = running_totals(places, "_v", ["n"]).select(
        KEY, F.col("_v").alias("_x"), F.floor(F.col("n_before") * cells / F.col("n_total")).alias("_i")
    )
    starts = ranked.groupBy(KEY, "_i").agg(F.min("_x").alias("_start"))
    placed = materialize(ranked.join(starts, [KEY, "_i"]).select(KEY, "_x", "_start"))
    return join_parameters(sized, placed, [KEY, "_x"], table_bytes(placed)).select(
        *rows.columns, "_last",
        F.when(F.col("_distinct") <= cells, F.col("_x")).otherwise(F.col("_start")).alias("_c"),
    )


def lowess_trend(
    df: DataFrame,
    x: str,
    y: str,
    by: Sequence[str] = (),
    frac: float = 2.0 / 3.0,
    iterations: int = 3,
    cells: int = 2048,
    anchors: int = 512,
) -> DataFrame:
    """Robust local-linear trend: ``by, x, fit`` at each distinct x of a group.

    ``frac`` of the rows make a neighbourhood; after the first fit, ``iterations``
    refits weigh rows down by their residual. Up to ``anchors`` distinct x, lines are
    fitted at each of them. A group of more is fitted at so many places, evenly spaced by rank,
    and read off between them; beyond ``cells`` distinct x, neighbourhoods are made of cells
    of neighbouring rows, whose sums are exact. The work of a group is bounded by
    ``cells * anchors``, apart from sums over its rows.
    """
    # Rows that agree in all three are one row from here on.
    rows = materialize(
        df.select(group_key(by), number(x).alias("_x"), number(y).alias("_y"))
        .where(F.col("_x").isNotNull() & F.col("_y").isNotNull())
        .groupBy(KEY, "_x", "_y").agg(F.count(F.lit(1)).alias("_n"))
    )
    rows = materialize(_cells(rows, cells))
    weighted = rows.withColumn("_w", F.lit(1.0))
    off, step_of = F.col("_x") - F.col("_c"), F.ceil(F.size("points") / F.lit(anchors)).cast("int")
    fitted = None
    for step in range(iterations + 1):
        w = F.col("_w") * F.col("_n")
        sums = weighted.groupBy(KEY, "_c").agg(
            F.sum("_n").alias("rows"), F.sum(w).alias("w"), F.sum(w * off).alias("wx"),
            F.sum(w * off * off).alias("wxx"), F.sum(w * F.col("_y")).alias("wy"),
            F.sum(w * off * F.col("_y")).alias("wxy"), F.max("_last").alias("last"),
        )
        point = F.struct(F.col("_c").alias("x"), "rows", "w", "wx", "wxx", "wy", "wxy")
        # At most `cells` points and `anchors` places per group.
        gathered = sums.groupBy(KEY).agg(
            F.array_sort(F.collect_list(point)).alias("points"), F.sum("rows").alias("n"), F.max("last").alias("last"),
        )
        chosen = F.filter("points", lambda q, i: i % F.col("step") == 0)
        places = F.array_distinct(F.concat(F.transform(chosen, lambda q: q["x"]), F.array("last")))
        lines = materialize(
            gathered.withColumn("step", step_of).withColumn("places", places)
            .select(KEY, _local_lines(F.col("points"), F.col("places"), F.col("n"), frac).alias("_f"))
            .select(KEY, F.col("_f.x").alias("_xs"), F.col("_f.fit").alias("_fits"))
        )
        size = table_bytes(lines, arrays=["_xs", "_fits"])
        fitted = join_parameters(rows, lines, [KEY], size).withColumn(
            "fit", interpolate("_x", "_xs", "_fits")).drop("_xs", "_fits")
        if step == iterations:
            break
        fitted = fitted.withColumn("_r", F.abs(F.col("_y") - F.col("fit"))).drop("fit")
        medians = exact_quantiles(fitted, "_r", [0.5], [KEY], "m", times="_n").select(
            KEY, F.get("m", F.lit(0)).alias("m")
        )
        u = F.when(
            F.col("m") > 0, F.col("_r") / (F.lit(6.0) * F.col("m"))
        ).otherwise(F.when(F.col("_r") > 0, F.lit(1.0)).otherwise(F.lit(0.0)))
        bisquare = (F.lit(1.0) - u * u) * (F.lit(1.0) - u * u)
        weight = F.when(u >= 0.999, F.lit(0.0)).when(u <= 0.001, F.lit(1.0)).otherwise(bisquare)
        weighted = join_group_values(fitted, medians, [KEY]).withColumn("_w", weight).drop("_r", "m")
    return (
        fitted.groupBy(KEY, "_x").agg(F.first("fit").alias("fit"))
        .select(*group_columns(by), F.col("_x").alias(x), "fit")
    )
