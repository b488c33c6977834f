"""Statistics of image pixels from counts of their 256 levels; only counts are shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions import images

LEVELS = "feature_key string, channel int, level int, n long"


def level_counts(frames: DataFrame) -> DataFrame:
    """(feature_key, channel, level, n) of frames (feature_key, data, encoding, height, width), large ones thinned out."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            sums: dict[str, np.ndarray] = {}
            for r in p.itertuples(index=False):
                sums[r.feature_key] = sums.get(r.feature_key, 0) + images.levels(images.rgb(bytes(r.data), r.encoding, r.height, r.width))
            rows = [(k, int(c), int(v), int(n[c, v])) for k, n in sums.items() for c, v in zip(*np.nonzero(n), strict=True)]
            yield pd.DataFrame(rows, columns=["feature_key", "channel", "level", "n"])

    some = frames.select("feature_key", "data", "encoding", "height", "width").mapInPandas(run, LEVELS)
    return some.groupBy("feature_key", "channel", "level").agg(F.sum("n").alias("n"))


def pixel_stats(counts: DataFrame, quantiles: tuple[float, ...] = (0.01, 0.10, 0.50, 0.90, 0.99)) -> DataFrame:
    """min, max, mean, deviation and quantiles of each channel in [0, 1]."""
    by = ["feature_key", "channel"]
    v = F.col("level") / 255.0
    w = Window.partitionBy(*by).orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    c = counts.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
    mean = F.sum(v * F.col("n")) / F.sum("n")
    std = F.sqrt(F.greatest(F.lit(0.0), F.sum(v * v * F.col("n")) / F.sum("n") - mean * mean))
    qs = [F.min(F.when(F.col("upto") >= F.col("total") * q, v)).alias(f"q{round(q * 100):02d}") for q in quantiles]
    return c.groupBy(*by).agg(F.min(v).alias("min"), F.max(v).alias("max"), mean.alias("mean"), std.alias("std"), *qs)
