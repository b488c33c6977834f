"""Routing, stale filtering, windows and as-of resampling onto a fixed-rate frame grid.

Samples are long rows (episode_index, feature_key, ts_ns, seq, value). A resampling is one union of
samples and windows (or grid points of any times), one shuffle on (episode_index, feature_key) and one
sort; both as-of sides are window expressions over that sort. No range join and no collect.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EPISODE, KEY = "episode_index", "feature_key"


@dataclass(frozen=True)
class Mapping:
    """A topic feeding a feature; one topic may feed several."""

    topic: str
    key: str
    required: bool = True
    max_delay_ms: float | None = None
    stamp: str = "receive"


def mapping_table(spark: SparkSession, mappings: list[Mapping]) -> DataFrame:
    rows = [(m.topic, m.key, m.required, m.max_delay_ms, m.stamp) for m in mappings]
    return spark.createDataFrame(rows, "topic string, feature_key string, required boolean, max_delay_ms double, stamp string")


def route(messages: DataFrame, mappings: DataFrame) -> DataFrame:
    """Each message once for every mapping of its topic. The mappings are configuration: a few rows."""
    return messages.join(F.broadcast(mappings), "topic")


def drop_stale(routed: DataFrame, max_delay_ms: float | None = None) -> DataFrame:
    """Drop messages received more than the limit before or after their stamp; a feature's own limit comes first."""
    limit = F.coalesce("max_delay_ms", F.lit(max_delay_ms).cast("double"))
    late = F.abs(F.col("recv_ns") - F.col("header_ns")) > limit * 1e6
    return routed.where(~F.coalesce(late, F.lit(False)))


def adopt_timestamp(routed: DataFrame) -> DataFrame:
    """ts_ns: the header stamp where the mapping asks for it and there is one, else the time of receipt."""
    return routed.withColumn("ts_ns", F.when(F.col("stamp") == "header", F.coalesce("header_ns", "recv_ns")).otherwise(F.col("recv_ns")))


def required_window(samples: DataFrame, required: list[str]) -> DataFrame:
    """(episode_index, start_ns, end_ns) in which all required keys have data; episodes that lack one, or whose ranges don't meet, are absent."""
    per = samples.where(F.col(KEY).isin(required)).groupBy(EPISODE, KEY).agg(F.min("ts_ns").alias("a"), F.max("ts_ns").alias("b"))
    out = per.groupBy(EPISODE).agg(F.max("a").alias("start_ns"), F.min("b").alias("end_ns"), F.count("*").alias("n"))
    return out.where((F.col("n") == len(required)) & (F.col("end_ns") >= F.col("start_ns"))).drop("n")


def full_window(messages: DataFrame, ts: str = "recv_ns") -> DataFrame:
    return messages.groupBy(EPISODE).agg(F.min(ts).alias("start_ns"), F.max(ts).alias("end_ns"))


def frame_count(fps: float) -> Column:
    """Frames of a window: max(1, ceil(seconds x fps))."""
    return F.greatest(F.lit(1), F.ceil((F.col("end_ns") - F.col("start_ns")) / F.lit(1e9) * F.lit(float(fps)))).cast("long")


def frame_grid(windows: DataFrame, fps: float) -> DataFrame:
    """(episode_index, frame_index, grid_ns): max(1, ceil(seconds x fps)) frames, one truncated period apart."""
    grid = windows.select(EPISODE, "start_ns", F.explode(F.sequence(F.lit(0).cast("long"), frame_count(fps) - 1)).alias("frame_index"))
    return grid.select(EPISODE, "frame_index", (F.col("start_ns") + F.col("frame_index") * int(1e9 / fps)).alias("grid_ns"))


def usable(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Samples of the keys that have a time and an episode; others are of no frame."""
    return samples.where(F.col(KEY).isin(keys) & F.col("ts_ns").isNotNull() & F.col(EPISODE).isNotNull())


def wanted(spark: SparkSession, keys: list[str]) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(k,) for k in keys], "feature_key string"))  # from the configuration


def choice(policy: str, t: Column, before_ns: Column, after_ns: Column, tolerance_ns: int) -> Callable[[Column, Column], Column]:
    """What a frame at t takes of the last sample at or before it and the first after it; null for neither."""
    if policy == "hold":
        first = before_ns.isNotNull()
        there = first | (after_ns - t <= tolerance_ns)
    elif policy in ("nearest", "drop"):
        first = before_ns.isNotNull() & (after_ns.isNull() | (t - before_ns <= after_ns - t))
        there = F.abs(F.when(first, before_ns).otherwise(after_ns) - t) <= tolerance_ns
    else:
        raise ValueError(f"unknown policy {policy!r}")
    return lambda before, after: F.when(there, F.when(first, before).otherwise(after))


def resample(samples: DataFrame, grid: DataFrame, keys: list[str], policy: str = "hold", tolerance_ns: int = 0) -> DataFrame:
    """(episode_index, frame_index, feature_key, grid_ns, src_ns, value) for every frame and key asked for.

    hold: the last sample at or before the frame, however old; before the first sample, that one if
    within the tolerance. nearest (and drop): the nearer of the last at or before and the first after,
    the earlier of equally near ones, null beyond the tolerance. Equal times are told apart by seq.
    For frames of any times; those of frame_grid take much less with resample_windows."""
    t = F.col("ts_ns")
    chosen = choice(policy, t, F.col("before.ts_ns"), F.col("after.ts_ns"), tolerance_ns)
    sample = F.struct("ts_ns", "value").alias("sample")
    rows = usable(samples, keys).select(EPISODE, KEY, "ts_ns", F.lit(0).alias("is_grid"), "seq", sample, F.lit(None).cast("long").alias("frame_index"))
    kind = rows.schema["sample"].dataType
    points = grid.crossJoin(wanted(samples.sparkSession, keys)).select(EPISODE, KEY, F.col("grid_ns").alias("ts_ns"), F.lit(1).alias("is_grid"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast(kind).alias("sample"), "frame_index")
    w = Window.partitionBy(EPISODE, KEY).orderBy("ts_ns", "is_grid", "seq")
    # lead goes on from where it was, where first over a frame that shrinks would be read anew for every row
    ends = {"before": F.last("sample", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "after": F.expr("lead(sample) IGNORE NULLS").over(w)}
    out = rows.unionByName(points).withColumns(ends).where("is_grid = 1")
    return out.select(EPISODE, "frame_index", KEY, t.alias("grid_ns"), *[chosen(F.col(f"before.{c}"), F.col(f"after.{c}")).alias(name) for c, name in (("ts_ns", "src_ns"), ("value", "value"))])


def resample_windows(samples: DataFrame, windows: DataFrame, fps: float, keys: list[str], policy: str = "hold", tolerance_ns: int = 0) -> DataFrame:
    """resample onto frame_grid(windows, fps), of one window an episode and keys that differ.

    Only samples are sorted, and one head for each window and key: frames from a sample up to the next
    one are a range of numbers, made into rows after that."""
    period = int(1e9 / fps)
    if period == 0:  # all frames at one time
        return resample(samples, frame_grid(windows, fps), keys, policy, tolerance_ns)
    grid_ns = F.col("start_ns") + F.col("frame_index") * period
    chosen = choice(policy, F.col("grid_ns"), F.col("ts_ns"), F.col("next_ns"), tolerance_ns)
    none = lambda **of: [F.lit(None).cast(kind).alias(c) for c, kind in of.items()]
    rows = usable(samples, keys).select(EPISODE, KEY, "ts_ns", "seq", "value", *none(start_ns="long", n_frames="long"))
    heads = windows.crossJoin(wanted(samples.sparkSession, keys)).select(EPISODE, KEY, *none(ts_ns="long", seq="long", value=rows.schema["value"].dataType), "start_ns", frame_count(fps).alias("n_frames"))
    w = Window.partitionBy(EPISODE, KEY).orderBy(F.asc_nulls_first("ts_ns"), "seq")  # the head comes first, as it has no time
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(heads).withColumns({"next_ns": F.lead("ts_ns").over(w), "next_value": F.lead("value").over(w), **{c: F.last(c, True).over(upto) for c in ("start_ns", "n_frames")}})
    # the first frame at or after a time, n_frames if there is none; held within the window first, as times may be too far apart for a long
    at = lambda c: F.expr(f"(least(greatest({c}, start_ns), start_ns + (n_frames - 1) * {period}L + 1L) - start_ns + {period - 1}L) div {period}L")
    spans = both.withColumns({"lo": F.when(F.col("ts_ns").isNull(), F.lit(0).cast("long")).otherwise(at("ts_ns")), "hi": F.coalesce(F.when(F.col("next_ns").isNotNull(), at("next_ns")), "n_frames")})
    out = spans.where("lo < hi").withColumn("frame_index", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1))).withColumn("grid_ns", grid_ns)
    return out.select(EPISODE, "frame_index", KEY, "grid_ns", chosen(F.col("ts_ns"), F.col("next_ns")).alias("src_ns"), chosen(F.col("value"), F.col("next_value")).alias("value"))


def widen(frames: DataFrame, keys: list[str]) -> DataFrame:
    """One row a frame, one column a key; the keys are configured, so no pivot job looks for them.

    Rows are shuffled by episode, which also serves what follows by episode, such as trimming."""
    return frames.repartition(EPISODE).groupBy(EPISODE, "frame_index").agg(*[F.first(F.when(F.col(KEY) == k, F.col("value")), True).alias(k) for k in keys])


def trim_to_valid(wide: DataFrame, required: list[str]) -> DataFrame:
    """Cut the frames before the first and after the last in which all required keys are there; renumber from 0. Gaps inside stay."""
    ok = reduce(lambda a, k: a & F.col(k).isNotNull(), required, F.lit(True))
    w = Window.partitionBy(EPISODE)
    ends = wide.withColumn("lo", F.min(F.when(ok, F.col("frame_index"))).over(w)).withColumn("hi", F.max(F.when(ok, F.col("frame_index"))).over(w))
    return ends.where("frame_index BETWEEN lo AND hi").withColumn("frame_index", F.col("frame_index") - F.col("lo")).drop("lo", "hi")


def unused_topics(messages: DataFrame, mappings: DataFrame) -> DataFrame:
    return messages.select("topic").distinct().join(F.broadcast(mappings), "topic", "left_anti")


def missing_topics(messages: DataFrame, mappings: DataFrame) -> DataFrame:
    return mappings.select("topic", "required").distinct().join(messages.select("topic").distinct(), "topic", "left_anti")
