"""Per-dimension statistics, exact and histogram quantiles, topic rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUANTILES = (0.01, 0.10, 0.50, 0.90, 0.99)
BINS = 5000


def explode_dims(df: DataFrame, by: list[str], vector: str, outer: bool = False) -> DataFrame:
    """One row (by, dim, v) an element; `outer` also gives one with null dim and v for a null or empty vector."""
    return df.select(*by, (F.posexplode_outer if outer else F.posexplode)(vector).alias("dim", "v")).withColumn("v", F.col("v").cast("double"))


def feature_stats(dims: DataFrame, by: list[str]) -> DataFrame:
    """min, max, mean, population deviation and count, combined before the shuffle; NaN takes part in none."""
    v = F.when(~F.isnan("v"), F.col("v"))
    deviation = F.sqrt(F.greatest(F.lit(0.0), F.avg(v * v) - F.avg(v) * F.avg(v)))
    return dims.groupBy(*by).agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), deviation.alias("std"), F.count(v).alias("count"))


def exact_quantiles(dims: DataFrame, by: list[str], quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    qs = F.percentile("v", F.array(*map(F.lit, quantiles)))
    return dims.groupBy(*by).agg(qs.alias("q")).select(*by, *[F.col("q")[k].alias(f"q{round(q * 100):02d}") for k, q in enumerate(quantiles)])


def histogram_quantiles(dims: DataFrame, by: list[str], quantiles: tuple[float, ...] = QUANTILES, bins: int = BINS) -> DataFrame:
    """Quantiles of a histogram over [min, max], linear inside the bin that crosses q x count.

    The first pass finds the range, the second counts: at most `bins` rows a group are shuffled and
    only those are sorted, whatever the number of values."""
    ends = dims.groupBy(*by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / width))).otherwise(bins - 1).cast("int")
    counts = dims.join(ends, by).withColumn("bin", at).groupBy(*by, "bin").agg(F.count("*").alias("c"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("n").alias("n"))
    w = Window.partitionBy(*by).orderBy("bin")
    cum = counts.withColumn("upto", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))

    def q(x: float) -> Column:
        inside = (F.lit(x) * F.col("n") - (F.col("upto") - F.col("c"))) / F.col("c")
        value = F.when(F.col("hi") > F.col("lo"), F.col("lo") + width * (F.col("bin") + inside)).otherwise(F.col("lo"))
        return F.min(F.when(F.col("upto") >= F.lit(x) * F.col("n"), F.struct("bin", value.alias("value"))))["value"]

    return cum.groupBy(*by).agg(*[q(x).alias(f"q{round(x * 100):02d}") for x in quantiles])


def intervals(messages: DataFrame, by: list[str], ts: str = "recv_ns") -> DataFrame:
    return messages.withColumn("dt", F.col(ts) - F.lag(ts).over(Window.partitionBy(*by).orderBy(ts, "seq")))


def fps_report(messages: DataFrame, by: list[str], window: DataFrame | None = None, ts: str = "recv_ns") -> DataFrame:
    """Rates per topic over positive intervals: mean is their number by their sum, the rest is of each one's inverse."""
    rate = F.when(F.col("dt") > 0, F.lit(1e9) / F.col("dt"))
    positive = F.when(F.col("dt") > 0, F.col("dt"))
    agg = intervals(messages, by, ts).groupBy(*by).agg(
        F.count("*").alias("n_messages"), F.min(ts).alias("first_ns"), F.max(ts).alias("last_ns"),
        (F.count(positive) / (F.sum(positive) / F.lit(1e9))).alias("mean_fps"), F.min(rate).alias("min_fps"), F.max(rate).alias("max_fps"),
        F.stddev_pop(rate).alias("std_fps"), F.percentile(rate, F.lit(0.01)).alias("p01_fps"), F.percentile(rate, F.lit(0.99)).alias("p99_fps"),
    )
    if window is None:
        return agg
    lags = [((F.col("first_ns") - F.col("start_ns")) / 1e6).alias("head_lag_ms"), ((F.col("end_ns") - F.col("last_ns")) / 1e6).alias("tail_lag_ms")]
    return agg.join(window, by[:1]).select(*agg.columns, *lags)


def gaps(messages: DataFrame, by: list[str], threshold_ns: int, ts: str = "recv_ns") -> DataFrame:
    """Intervals longer than the threshold, stamped at the earlier sample."""
    return intervals(messages, by, ts).where(F.col("dt") > threshold_ns).select(*by, (F.col(ts) - F.col("dt")).alias("at_ns"), (F.col("dt") / 1e6).alias("gap_ms"))


def head_intervals(messages: DataFrame, by: list[str], n: int, ts: str = "recv_ns") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(ts, "seq")) - 1
    return intervals(messages, by, ts).withColumn("k", rank.cast("long")).where((F.col("k") > 0) & (F.col("k") <= n)).select(*by, "k", (F.col("dt") / 1e6).alias("dt_ms"))
