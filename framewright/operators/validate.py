"""Validation rules: each gives issue rows (severity, status, episode_index, video_key, detail); a verdict counts them."""

from __future__ import annotations

import json
import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.operators import sequence

ISSUE = "severity string, status string, episode_index long, video_key string, detail string"
REQUIRED_INFO = ("codebase_version", "robot_type", "fps", "total_episodes", "total_frames", "total_tasks", "chunks_size", "data_files_size_in_mb", "video_files_size_in_mb", "data_path", "video_path", "splits", "features")
VIDEO_COLUMNS = ("chunk_index", "file_index", "from_timestamp", "to_timestamp")


def issues(df: DataFrame, status: str, detail: Column, severity: str = "error", key: str | None = None) -> DataFrame:
    episode = F.col("episode_index").cast("long") if "episode_index" in df.columns else F.lit(None).cast("long")
    return df.select(F.lit(severity).alias("severity"), F.lit(status).alias("status"), episode.alias("episode_index"), F.lit(key).cast("string").alias("video_key"), detail.cast("string").alias("detail"))


def video_keys(columns: list[str]) -> list[str]:
    """The video keys that episode columns name, in order of appearance."""
    return list(dict.fromkeys(c.split("/")[1] for c in columns if c.startswith("videos/") and c.count("/") == 2))


def video_mapping(episodes: DataFrame, key: str) -> DataFrame:
    """(episode_index, length, chunk_index, file_index, from_timestamp, to_timestamp) of one video key."""
    return episodes.select("episode_index", "length", *[F.col(f"`videos/{key}/{c}`").alias(c) for c in VIDEO_COLUMNS])


def video_issues(data: DataFrame, episodes: DataFrame, probe: DataFrame, fps: float, keys: list[str], strict: bool = False, tolerance_s: float | None = None) -> DataFrame:
    """Faults between frames (episode_index, index, timestamp), episodes and what a probe found of each video.

    probe: (video_key, chunk_index, file_index, readable, avg_fps, header_frames, decoded_frames, pts).
    All four columns of a mapping null is no fault, some of them is. Fast mode asks for the first and
    last frame of each episode, strict mode for all of them."""
    out = []
    finite = F.col("timestamp").isNotNull() & ~F.isnan("timestamp") & (F.abs("timestamp") != float("inf"))
    per = data.groupBy("episode_index").agg(F.count("*").alias("rows"), F.count_if(~finite).alias("odd"))
    both = episodes.select("episode_index", "length").join(per, "episode_index", "left")
    out.append(issues(both.where("rows IS NULL"), "MISSING_EPISODE_DATA", F.col("length")))
    out.append(issues(both.where("rows <> length"), "EPISODE_LENGTH_MISMATCH", F.concat_ws(" of ", "rows", "length")))
    out.append(issues(both.where("odd > 0"), "INVALID_TIMESTAMP", F.col("odd")))
    if strict:
        out.append(issues(sequence.duplicates(data, "index"), "DUPLICATE_INDEX", F.col("index")))
        out.append(issues(sequence.index_breaks(data, "index"), "INVALID_INDEX_SEQUENCE", F.concat_ws(" after ", "step", "after")))
        out.append(issues(sequence.backward_steps(data.where(finite), "index", "timestamp"), "NON_MONOTONIC_TIMESTAMP", F.col("index")))
    for key in keys:
        if lacking := [c for c in VIDEO_COLUMNS if f"videos/{key}/{c}" not in episodes.columns]:
            one = episodes.sparkSession.createDataFrame([(", ".join(lacking),)], "d string")
            out.append(issues(one, "MISSING_REQUIRED_COLUMN", F.col("d"), key=key))
            continue
        m = video_mapping(episodes, key)
        nulls = sum((F.col(c).isNull().cast("int") for c in VIDEO_COLUMNS), F.lit(0))
        out.append(issues(m.where((nulls > 0) & (nulls < 4)), "MISSING_METADATA_VALUE", F.lit(None), key=key))
        m = m.where(nulls == 0).join(probe.where(F.col("video_key") == key).drop("video_key"), ["chunk_index", "file_index"], "left")
        out.append(issues(m.where("readable IS NULL"), "VIDEO_MISSING", F.concat_ws("/", "chunk_index", "file_index"), key=key))
        out.append(issues(m.where("NOT readable"), "VIDEO_UNREADABLE", F.concat_ws("/", "chunk_index", "file_index"), key=key))
        m = m.where("readable")
        out.append(issues(m.where("avg_fps IS NULL OR avg_fps <= 0"), "INVALID_VIDEO_FPS", F.col("avg_fps"), key=key))
        m = m.where("avg_fps > 0")
        files = m.groupBy("chunk_index", "file_index").agg(F.first("avg_fps").alias("avg_fps"), F.first("header_frames").alias("header_frames"), F.first("decoded_frames").alias("decoded_frames"))
        out.append(issues(files.where(F.abs(F.col("avg_fps") - fps) > 1e-3), "DATASET_VIDEO_FPS_MISMATCH", F.col("avg_fps"), "warning", key))
        if strict:
            out.append(issues(files.where("header_frames <> decoded_frames"), "FRAME_COUNT_MISMATCH", F.concat_ws(" of ", "decoded_frames", "header_frames"), key=key))
        rows = data.where(finite).select("episode_index", "index", "timestamp")
        if not strict:
            ends = rows.groupBy("episode_index").agg(F.min(F.struct("timestamp", "index")).alias("a"), F.max(F.struct("timestamp", (-F.col("index")).alias("i"))).alias("b"))
            rows = ends.select("episode_index", F.explode(F.array(F.struct(F.col("a.timestamp").alias("timestamp"), F.col("a.index").alias("index")), F.struct(F.col("b.timestamp").alias("timestamp"), (-F.col("b.i")).alias("index")))).alias("r")).select("episode_index", "r.*").distinct()
        asked = rows.join(m, "episode_index").withColumn("requested", F.rint((F.col("from_timestamp") + F.col("timestamp")) * F.col("avg_fps")).cast("long"))
        detail = F.concat_ws(" ", F.lit("requested"), "requested", F.lit("max"), F.col("decoded_frames") - 1, F.lit("overflow"), F.col("requested") - F.col("decoded_frames") + 1, F.lit("index"), "index")
        out.append(issues(asked.where("requested < 0"), "FRAME_INDEX_NEGATIVE", detail, key=key))
        out.append(issues(asked.where("requested >= decoded_frames"), "FRAME_INDEX_OUT_OF_RANGE", detail, key=key))
        if strict:
            tolerance = tolerance_s if tolerance_s is not None else 0.5 / fps
            loaded = F.try_element_at("pts", (F.col("requested") + 1).cast("int"))
            off = asked.where("requested BETWEEN 0 AND decoded_frames - 1").withColumn("off", F.abs(loaded - F.col("from_timestamp") - F.col("timestamp")))
            out.append(issues(off.where(F.col("off") >= tolerance), "FRAME_TIMESTAMP_OUT_OF_TOLERANCE", F.concat_ws(" at ", F.round("off", 6), "index"), key=key))
        late = data.where(finite).groupBy("episode_index").agg(F.max("timestamp").alias("last")).join(m, "episode_index")
        out.append(issues(late.where(F.col("from_timestamp") + F.col("last") > F.col("to_timestamp") + 1e-6), "TO_TIMESTAMP_TOO_SMALL", F.col("to_timestamp"), "warning", key))
    return reduce(DataFrame.unionByName, out)


def dataset_issues(spark: SparkSession, path: str) -> DataFrame:
    """Faults of a dataset's files: info, splits, columns and their types, totals."""
    found: list[tuple] = []
    add = lambda status, detail, severity="ERROR": found.append((severity, status, None, None, str(detail)))
    for name in ("meta/info.json", "meta/stats.json", "meta/tasks.parquet", "meta/episodes", "data"):
        if not os.path.exists(os.path.join(path, name)):
            add("MISSING_FILE", name)
    if any(x[4] in ("meta/info.json", "data", "meta/episodes") for x in found):
        return spark.createDataFrame(found, ISSUE)
    with open(os.path.join(path, "meta/info.json")) as f:
        info = json.load(f)
    for k in REQUIRED_INFO:
        if k not in info:
            add("INFO_KEY_MISSING", k)
    if info.get("codebase_version") != "v3.0":
        add("WRONG_VERSION", info.get("codebase_version"))
    if fault := sequence.check_splits(info.get("splits", {}), info.get("total_episodes", 0)):
        add("SPLITS", fault)
    data = spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").option("pathGlobFilter", "*.parquet").parquet(os.path.join(path, "data"))
    kinds = {"float32": "float", "int64": "bigint", "float64": "double", "int32": "int", "bool": "boolean", "string": "string"}
    have = dict(data.dtypes)
    for k, spec in info.get("features", {}).items():
        base = kinds.get(spec["dtype"], spec["dtype"])
        want = base if spec["shape"] == [1] and k in ("index", "timestamp", "frame_index", "episode_index", "task_index") else f"array<{base}>"
        if spec["dtype"] == "video":
            if k in have:
                add("VIDEO_KEY_IN_DATA", k)
        elif k not in have:
            add("COLUMN_MISSING", k)
        elif have[k] != want:
            add("WRONG_TYPE", f"{k}: {have[k]}, not {want}")
    for k in have:
        if k not in info.get("features", {}):
            add("EXTRA_COLUMN", k, "WARN")
    episodes = spark.read.parquet(os.path.join(path, "meta/episodes"))
    for c, want in (("episode_index", "bigint"), ("length", "bigint"), ("dataset_from_index", "bigint"), ("dataset_to_index", "bigint")):
        if dict(episodes.dtypes).get(c) != want:
            add("EPISODE_COLUMN", f"{c}: {dict(episodes.dtypes).get(c)}, not {want}")
    declared = [k for k, v in info.get("features", {}).items() if v["dtype"] == "video"]
    for k in declared:
        for c in VIDEO_COLUMNS:
            if f"videos/{k}/{c}" not in episodes.columns:
                add("EPISODE_COLUMN", f"videos/{k}/{c}")
        if not any(f.endswith(".mp4") for _, _, fs in os.walk(os.path.join(path, "videos", k)) for f in fs):
            add("MISSING_FILE", f"videos/{k}")
    for k in video_keys(episodes.columns):
        if k not in declared:
            add("UNDECLARED_VIDEO", k, "WARN")
    if os.path.exists(os.path.join(path, "meta/tasks.parquet")):
        kinds = dict(spark.read.parquet(os.path.join(path, "meta/tasks.parquet")).dtypes)
        if kinds.get("task_index") != "bigint" or kinds.get("task") != "string":
            add("TASKS_COLUMN", kinds)
    n, frames = episodes.agg(F.count("*"), F.sum("length")).first()
    if n != info.get("total_episodes"):
        add("EPISODE_COUNT", f"{n} of {info.get('total_episodes')}")
    if (frames or 0) != info.get("total_frames"):
        add("FRAME_COUNT", f"{frames} of {info.get('total_frames')}")
    return spark.createDataFrame(found, ISSUE)


def verdict(found: DataFrame, strict: bool = False) -> DataFrame:
    """(errors, warnings, verdict): an error fails, with strict a warning too."""
    sev = F.lower("severity")
    counts = found.agg(F.count_if(sev == "error").alias("errors"), F.count_if(sev.startswith("warn")).alias("warnings"))
    return counts.withColumn("verdict", F.when((F.col("errors") > 0) | (F.lit(strict) & (F.col("warnings") > 0)), "FAIL").otherwise("PASS"))


def capped(found: DataFrame, most: int) -> DataFrame:
    """The first issues of each status, with the true total and whether some were left out."""
    w = Window.partitionBy("status")
    out = found.withColumn("total", F.count("*").over(w)).withColumn("k", F.row_number().over(w.orderBy("episode_index", "video_key", "detail")))
    return out.where(F.col("k") <= most).withColumn("truncated", F.col("total") > most).drop("k")
