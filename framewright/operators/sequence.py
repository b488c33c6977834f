"""Episode bookkeeping: lengths, indices, splits, dictionaries, spans, offsets and their audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EPISODE = "episode_index"


#: Episodes whose running sums one task takes.
SPAN = 65_536


def running(episodes: DataFrame, value: str, name: str, span: int = SPAN) -> DataFrame:
    """The sum of `value` over an episode and all before it, without sorting all episodes in one task.

    Only sums of `span` neighbouring numbers, a row each, are added up in one place."""
    df = episodes.withColumn("__span", F.floor(F.col(EPISODE) / span))
    sums = df.groupBy("__span").agg(F.sum(value).alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(Window.orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.sum(value).over(Window.partitionBy("__span").orderBy(EPISODE).rowsBetween(Window.unboundedPreceding, 0))
    return df.join(sums.select("__span", before.alias("__before")), "__span").withColumn(name, within + F.col("__before")).drop("__span", "__before")


def min_length(rows: DataFrame, least: int) -> DataFrame:
    """(episode_index, length, new_index): episodes of at least so many rows, numbered anew without gaps."""
    sizes = rows.groupBy(EPISODE).agg(F.count("*").alias("length"))
    kept = sizes.where(F.col("length") >= least) if least > 0 else sizes
    numbered = running(kept.withColumn("__one", F.lit(1)), "__one", "__n")
    return numbered.select(EPISODE, "length", (F.col("__n") - 1).cast("long").alias("new_index"))


def first_episodes(rows: DataFrame, most: int) -> DataFrame:
    """The rows of the first `most` episodes, which are a top-k of distinct numbers, not a sort of all."""
    first = rows.select(EPISODE).distinct().orderBy(EPISODE).limit(most)
    return rows.join(first, EPISODE, "left_semi")


def global_index(lengths: DataFrame) -> DataFrame:
    """dataset_from_index and dataset_to_index of every episode."""
    out = running(lengths, "length", "dataset_to_index")
    return out.select(EPISODE, "length", (F.col("dataset_to_index") - F.col("length")).alias("dataset_from_index"), "dataset_to_index")


def splits(n: int, ratios: tuple[float, float, float]) -> dict[str, tuple[int, int]]:
    """Contiguous train, val and test ranges; halves round to even and what is left is test. Empty ones are absent."""
    train = min(round(ratios[0] * n), n)
    val = min(round(ratios[1] * n), n - train)
    found = {"train": (0, train), "val": (train, train + val), "test": (train + val, n)}
    return {k: v for k, v in found.items() if v[1] > v[0]}


def assign_split(episodes: DataFrame, ranges: dict[str, tuple[int, int]], index: str = EPISODE) -> DataFrame:
    label: Column = F.lit(None).cast("string")
    for name, (a, b) in ranges.items():
        label = F.when((F.col(index) >= a) & (F.col(index) < b), name).otherwise(label)
    return episodes.withColumn("split", label)


def dictionary(rows: DataFrame, value: str, order: str) -> DataFrame:
    """(value, task_index) by first appearance; one row a distinct value is ranked."""
    first = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(order).alias("first"))
    return first.select(value, (F.row_number().over(Window.orderBy("first", value)) - 1).cast("long").alias("task_index"))


def episode_tasks(rows: DataFrame, value: str, names: DataFrame) -> DataFrame:
    """The task indices of each episode, in order. Whether the names are broadcast is left to the session's size limit."""
    return rows.join(names, value).groupBy(EPISODE).agg(F.array_join(F.transform(F.array_sort(F.collect_set("task_index")), lambda x: x.cast("string")), ",").alias("tasks"))


def span_table(spark: SparkSession, spans: list[tuple[float, float, str]]) -> DataFrame:
    rows = [(k, float(a), float(b), s, k == len(spans) - 1) for k, (a, b, s) in enumerate(spans)]
    return spark.createDataFrame(rows, "span_index int, start double, end double, subtask string, is_last boolean")


def lookup_span(frames: DataFrame, spans: DataFrame, t: str, slack: float = 1e-6) -> DataFrame:
    """The first span [start, end) that holds each row's time; the last one holds its end too. Spans are configured, a few rows."""
    table = F.broadcast(spans.agg(F.array_sort(F.collect_list(F.struct("span_index", "start", "end", "subtask", "is_last"))).alias("spans")))
    first = F.filter("spans", lambda s: (s["start"] - slack <= F.col(t)) & ((F.col(t) < s["end"]) | (s["is_last"] & (F.col(t) <= s["end"] + slack))))
    return frames.crossJoin(table).withColumn("subtask", F.try_element_at(first, F.lit(1))["subtask"]).drop("spans")


def span_coverage(spans: DataFrame, by: str, length: str, fps: float, tolerance: float = 1e-6) -> DataFrame:
    """Whether each group's spans start at 0, touch, and reach the end of its frames."""
    w = Window.partitionBy(by).orderBy("start")
    gap = F.abs(F.lead("start").over(w) - F.col("end")) > tolerance
    per = spans.withColumn("gap", F.coalesce(gap, F.lit(False)))
    agg = per.groupBy(by).agg(F.min("start").alias("a"), F.max("end").alias("b"), F.max(F.col("gap").cast("int")).alias("gaps"), F.max(length).alias("n"))
    return agg.select(by, (F.abs("a") <= tolerance).alias("starts_at_zero"), (F.col("gaps") == 0).alias("touching"), (F.col("b") >= F.col("n") / fps - tolerance).alias("reaches_end"))


def video_offsets(lengths: DataFrame, fps: float, file: str = "file_index") -> DataFrame:
    """from_timestamp and to_timestamp of each episode in its file, rounded to microseconds."""
    upto = F.sum("length").over(Window.partitionBy(file).orderBy(EPISODE).rowsBetween(Window.unboundedPreceding, 0))
    return lengths.select(EPISODE, file, "length", F.round((upto - F.col("length")) / fps, 6).alias("from_timestamp"), F.round(upto / fps, 6).alias("to_timestamp"))


def audit_offsets(episodes: DataFrame, drift_us: float = 1.0, file: str = "file_index") -> DataFrame:
    """Rows whose from_timestamp isn't the end of the episode before it (0 for the first of a file)."""
    w = Window.partitionBy(file).orderBy(EPISODE)
    expected = F.coalesce(F.lag("to_timestamp").over(w), F.lit(0.0))
    out = episodes.withColumn("expected", expected).withColumn("delta", F.col("from_timestamp") - F.col("expected"))
    return out.where(F.abs("delta") > drift_us * 1e-6 + 1e-9)


def frame_lookup(rows: DataFrame, episodes: DataFrame, fps: float, n_frames: str = "n_frames") -> DataFrame:
    """The video frame that each row asks for (halves to even) and whether the file holds it."""
    asked = F.rint((F.col("from_timestamp") + F.col("timestamp")) * F.lit(float(fps))).cast("long")
    out = rows.join(episodes, EPISODE).withColumn("requested", asked)
    return out.withColumn("in_range", (F.col("requested") >= 0) & (F.col("requested") < F.col(n_frames))).withColumn("overflow", F.greatest(F.lit(0).cast("long"), F.col("requested") - F.col(n_frames) + 1))


def index_breaks(rows: DataFrame, index: str) -> DataFrame:
    """The first place in each episode where the index doesn't go up by one."""
    step = F.lead(index).over(Window.partitionBy(EPISODE).orderBy(index)) - F.col(index)
    return rows.withColumn("step", step).where("step <> 1").groupBy(EPISODE).agg(F.min_by("step", index).alias("step"), F.min(index).alias("after"))


def backward_steps(rows: DataFrame, index: str, ts: str) -> DataFrame:
    """Rows whose time is before that of the row before them."""
    before = F.lag(ts).over(Window.partitionBy(EPISODE).orderBy(index))
    return rows.withColumn("before", before).where(F.col(ts) < F.col("before")).select(EPISODE, index)


def duplicates(rows: DataFrame, index: str) -> DataFrame:
    return rows.groupBy(index).agg(F.count("*").alias("copies")).where("copies > 1")


def extreme_rows(rows: DataFrame, index: str, ts: str) -> DataFrame:
    """The index of the earliest and the latest row of each episode; of equal times the first."""
    return rows.groupBy(EPISODE).agg(F.min_by(index, F.struct(ts, index)).alias("min_index"), F.max_by(index, F.struct(F.col(ts), -F.col(index))).alias("max_index"))


def pack_files(sizes: list[int], limit: int) -> list[int]:
    """The file of each episode: a file is closed after the episode that brings it to the limit."""
    out, at, held = [], 0, 0
    for s in sizes:
        out.append(at)
        held += s
        if held >= limit:
            at, held = at + 1, 0
    return out


def check_splits(spec: dict[str, str], total: int) -> str | None:
    """The first fault of `a:b` ranges that should tile 0 to total, or none."""
    ranges = []
    for name, text in spec.items():
        try:
            a, b = map(int, text.split(":"))
        except ValueError:
            return f"{name}: not a range"
        if not 0 <= a <= b <= total:
            return f"{name}: out of bounds"
        ranges.append((a, b, name))
    at = 0
    for a, b, name in sorted(ranges):
        if a != at:
            return f"{name}: {'gap' if a > at else 'overlap'} at {min(a, at)}"
        at = b
    return None if at == total else f"gap at {at}"
