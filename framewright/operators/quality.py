"""Data quality: nulls, NaN, ranges, frozen frames and the score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def null_counts(frames: DataFrame, by: list[str], vector: str) -> DataFrame:
    """Values in all vectors, frames without a vector, and NaN or null elements. Counted on whole frames: nothing is exploded."""
    v = F.col(vector)
    bad = F.size(F.filter(v, lambda x: x.isNull() | F.isnan(x.cast("double"))))
    counts = {"n_values": F.when(v.isNotNull(), F.size(v)), "n_null": v.isNull().cast("int"), "n_nan": F.when(v.isNotNull(), bad)}
    return frames.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for n, c in counts.items()])


def out_of_range(dims: DataFrame, bounds: DataFrame, on: list[str], by: list[str], tolerance: float = 0.0) -> DataFrame:
    """Values beyond (lo, hi) of their dimension; NaN, larger than all in SQL, is no finding."""
    bad = ~F.isnan("v") & ((F.col("v") < F.col("lo") - tolerance) | (F.col("v") > F.col("hi") + tolerance))
    return dims.join(bounds, on).groupBy(*by).agg(F.count("*").alias("n_values"), F.count_if(bad).alias("n_oor"))


def deviation(a: Column, b: Column) -> Column:
    """Population deviation of the difference of two vectors."""
    d = F.zip_with(a, b, lambda x, y: (x - y).cast("double"))
    n = F.size(d)
    total = F.aggregate(d, F.lit(0.0), lambda s, x: s + x)
    squares = F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x)
    return F.sqrt(F.greatest(F.lit(0.0), squares / n - (total / n) * (total / n)))


def freeze_pairs(frames: DataFrame, by: list[str], order: str, vector: str, eps: float = 1e-3) -> DataFrame:
    """Neighbouring frames, and those among them that hardly differ."""
    before = F.lag(vector).over(Window.partitionBy(*by).orderBy(order))
    pairs = frames.withColumn("before", before).where("before IS NOT NULL")
    return pairs.groupBy(*by).agg(F.count("*").alias("pairs"), F.count_if(deviation(F.col(vector), F.col("before")) <= eps).alias("frozen"))


def score(rates: DataFrame, videos: DataFrame | None = None, least: float = 0.95) -> DataFrame:
    """1 - clamp(0.5 null + 0.3 out of range + 0.2 frozen), each the plain mean over features; below `least` fails.

    So does any file of `videos`, as reconcile() gives them, that has more or fewer frames than expected."""
    worst = 0.5 * F.avg("null_rate") + 0.3 * F.avg("oor_rate") + 0.2 * F.avg("freeze_rate")
    out = rates.agg((1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), worst))).alias("score"))
    bad = F.col("score") < least
    if videos is not None:
        out = out.crossJoin(videos.agg(F.count_if(F.col("mismatch") != 0).alias("mismatched")))  # one row by one row
        bad = bad | (F.col("mismatched") > 0)
    return out.withColumn("verdict", F.when(bad, "FAIL").otherwise("PASS"))


def reconcile(expected: DataFrame, probe: DataFrame, on: list[str]) -> DataFrame:
    """Frames that episodes expect of each file against those it has; a missing file has none."""
    out = expected.join(probe, on, "left").withColumn("decoded", F.coalesce("decoded", F.lit(0)).cast("long"))
    return out.withColumn("mismatch", F.col("decoded") - F.col("expected"))


def job_rollup(results: DataFrame, worker: str, ok: Column, frames: Column) -> DataFrame:
    """Successes, failures and frames of each worker; failed episodes add none."""
    return results.groupBy(worker).agg(F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.sum(F.when(ok, frames).otherwise(0)).alias("frames"))
