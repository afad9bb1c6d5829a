"""Buffer size from the spacing of the points (KNN8, AGG7, AGG13, AGG14)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlekit.knn.vectors import as_doubles, block
from titlekit.operators.sampling import size_samples

SAMPLE_SIZES = tuple(range(100, 1001, 100))


def _nearest_spacing(table: pa.Table) -> pa.Table:
    points = block(table["features"])
    nearest = []
    for point in points:
        squared = ((points - point) ** 2).sum(axis=1)
        apart = squared[squared > 0]
        if apart.size:
            nearest.append(np.sqrt(apart.min()))
    return pa.table({
        "sample": pa.array([table["sample"][0].as_py()], pa.int32()),
        "n": pa.array([len(points)], pa.int64()),
        "spacing": pa.array([math.fsum(nearest) / len(nearest) if nearest else None], pa.float64()),
    })


def sample_spacing(points: DataFrame, id_col: str = "tid", features_col: str = "features",
                   sizes: Sequence[int] = SAMPLE_SIZES, seed: int = 0, total: int | None = None) -> DataFrame:
    """``sample, n, spacing``: mean distance to the nearest different point within samples of several sizes.

    The mean does not depend on the order of the rows, so equal samples have equal spacing. One sample is one group; its expected size is given by ``sizes`` and does not grow with the data.
    """
    vectors = points.select(F.col(id_col), as_doubles(points, features_col).alias("features")).where("features is not null")
    samples = size_samples(vectors, id_col, sizes, seed, total)
    return (
        samples.select("sample", "features").groupBy("sample").applyInArrow(_nearest_spacing, "sample int, n long, spacing double")
    )


def spacing_line(spacing: DataFrame) -> DataFrame:
    """One row ``alpha, beta, widest`` of log(spacing) = alpha + beta log(n) over the distinct samples."""
    logs = spacing.where("spacing is not null").select("n", "spacing").distinct().select(
        F.log("n").alias("x"), F.log("spacing").alias("y"), "spacing"
    )
    return logs.agg(
        F.regr_intercept("y", "x").alias("alpha"), F.regr_slope("y", "x").alias("beta"), F.max("spacing").alias("widest")
    )


def tau_from_line(line: DataFrame, total: int) -> DataFrame:
    """One row ``tau``: the spacing extrapolated to ``total`` points, over the square root of the effective dimension.

    Without a falling line the widest spacing seen is taken, and 0 if no sample had two different points.
    """
    reach = F.exp(F.col("alpha") + F.col("beta") * F.log(F.lit(float(max(total, 1))))) / F.sqrt(-1.0 / F.col("beta"))
    falling = F.col("beta").isNotNull() & ~F.isnan("beta") & (F.col("beta") < 0)
    return line.select(F.when(falling, reach).otherwise(F.coalesce("widest", F.lit(0.0))).alias("tau"))


def estimate_tau(points: DataFrame, id_col: str = "tid", features_col: str = "features",
                 sizes: Sequence[int] = SAMPLE_SIZES, seed: int = 0, total: int | None = None) -> float:
    total = points.count() if total is None else total
    line = spacing_line(sample_spacing(points, id_col, features_col, sizes, seed, total))
    return float(tau_from_line(line, total).first()["tau"])
