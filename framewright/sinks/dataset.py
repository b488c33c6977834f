"""Finished datasets: data and episode Parquet, task dictionary, statistics and info as JSON.

Episodes are packed into files by running frame counts, found in Spark; each file is written by the
task that holds it, with one row group an episode and fixed-size lists, under a name of its own
until it is whole. A task that is run again writes the same file again."""

from __future__ import annotations

import json
import os
import shutil
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.operators import sequence, stats

FILES_PER_CHUNK, VERSION = 1000, "v3.0"
#: A data file is closed after the episode that brings it to so many MB; the size of a row is known beforehand.
DATA_MB, VIDEO_MB = 100, 200
WRITTEN = "episode_index long, file_index long, length long, from_index long"
ORDER = ("index", "timestamp", "frame_index", "episode_index", "task_index")


def file_path(index: int) -> str:
    return f"chunk-{index // FILES_PER_CHUNK:03d}/file-{index % FILES_PER_CHUNK:03d}.parquet"


def guard(path: str, resume: bool = False) -> bool:
    """Whether to write: not if a finished dataset is resumed; what else lies there is an error, or wiped if it is resumed."""
    if not os.path.isdir(path) or not os.listdir(path):
        return True
    if not resume:
        raise FileExistsError(f"{path} isn't empty")
    if os.path.exists(os.path.join(path, "meta", "info.json")):
        return False
    for part in ("data", "meta"):  # only a dataset's own folders: an interrupted run left them
        shutil.rmtree(os.path.join(path, part), ignore_errors=True)
    return True


def write(frames: DataFrame, path: str, features: Mapping[str, int], fps: float, robot: str, task: str = "task", split: tuple[float, float, float] = (1.0, 0.0, 0.0), frames_per_file: int | None = None, spans: Sequence[tuple[int, float, float, str]] = ()) -> dict:
    """Write frames (episode_index, frame_index, task, features) and return the info.

    A missing vector becomes NaN. Episode numbers may have gaps; they are closed. spans: (episode_index,
    start, end, subtask) in seconds, a few rows an episode."""
    guard(path)
    frames_per_file = frames_per_file or max(1, (DATA_MB << 20) // (36 + 4 * sum(features.values())))
    spark = frames.sparkSession
    named = sequence.min_length(frames, 0)
    index = sequence.global_index(named.select(F.col("new_index").alias("episode_index"), "length"))
    names = sequence.dictionary(frames.withColumn("__at", F.struct("episode_index", "frame_index")), task, "__at")
    nan = F.lit(float("nan")).cast("float")
    vectors = [F.coalesce(F.col(f"`{k}`").cast("array<float>"), F.array_repeat(nan, n)).alias(k) for k, n in features.items()]
    rows = frames.join(named.select("episode_index", "new_index"), "episode_index").join(names, task, "left")
    rows = rows.select(F.col("new_index").alias("episode_index"), "frame_index", "task_index", *vectors).join(index, "episode_index")
    rows = rows.select((F.col("dataset_from_index") + F.col("frame_index")).alias("index"), (F.col("frame_index") / F.lit(float(fps))).cast("float").alias("timestamp"), F.col("frame_index").cast("long").alias("frame_index"), "episode_index", F.col("task_index").cast("long").alias("task_index"), *[f"`{k}`" for k in features], F.expr(f"dataset_from_index div {frames_per_file}").alias("__file"), "dataset_from_index")
    plain = {k: f"__f{n}" for n, k in enumerate(features)}  # names with dots can't go through mapInArrow
    schema = pa.schema([*[(n, pa.float32() if n == "timestamp" else pa.int64()) for n in ORDER], *[(k, pa.list_(pa.float32(), n)) for k, n in features.items()]])

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, at, part, held = None, None, None, []

        def flush() -> pa.RecordBatch | None:
            if not held:
                return None
            t = pa.Table.from_batches(held)
            writer.write_table(pa.table([t[plain.get(n, n)].combine_chunks().cast(schema.field(n).type) for n in schema.names], schema=schema))
            e = [t["episode_index"][0].as_py()]
            out = pa.RecordBatch.from_arrays([pa.array(e), pa.array([at]), pa.array([t.num_rows]), pa.array([t["dataset_from_index"][0].as_py()])], ["episode_index", "file_index", "length", "from_index"])
            held.clear()
            return out

        def close() -> None:
            if writer is not None:
                writer.close()
                os.replace(part, part.removesuffix(f".{os.getpid()}"))

        for b in batches:
            episodes, file = b.column(b.schema.get_field_index("episode_index")).to_pylist(), b.column(b.schema.get_field_index("__file")).to_pylist()
            edges = [0, *(k for k in range(1, len(episodes)) if episodes[k] != episodes[k - 1]), len(episodes)]
            for a, z in zip(edges, edges[1:], strict=False):
                if held and held[-1].column(3)[0].as_py() != episodes[a] and (done := flush()):
                    yield done
                if file[a] != at:
                    close()
                    at = file[a]
                    part = os.path.join(path, "data", file_path(at)) + f".{os.getpid()}"
                    os.makedirs(os.path.dirname(part), exist_ok=True)
                    writer = pq.ParquetWriter(part, schema, compression="snappy")
                held.append(b.slice(a, z - a))
        if done := flush():
            yield done
        close()

    ordered = rows.select(*[F.col(f"`{c}`").alias(plain.get(c, c)) for c in rows.columns]).repartition("__file").sortWithinPartitions("__file", "episode_index", "frame_index")
    written = ordered.mapInArrow(files, WRITTEN)
    meta = os.path.join(path, "meta")
    own = rows.groupBy("episode_index").agg(F.array_sort(F.collect_set("task_index")).alias("tasks"))
    for k in features:
        per = stats.feature_stats(stats.explode_dims(rows, ["episode_index"], f"`{k}`"), ["episode_index", "dim"]).groupBy("episode_index")
        kept = ("min", "max", "mean", "std", "count")
        per = per.agg(F.array_sort(F.collect_list(F.struct("dim", *kept))).alias("__s"))  # a field of an array of structs is an array
        own = own.join(per.select("episode_index", *[F.col(f"__s.{n}").alias(f"stats/{k}/{n}") for n in kept]), "episode_index")
    pointers = [F.expr(f"file_index div {FILES_PER_CHUNK}").alias("data/chunk_index"), F.expr(f"file_index % {FILES_PER_CHUNK}").alias("data/file_index")]
    table = written.select("episode_index", "length", F.col("from_index").alias("dataset_from_index"), (F.col("from_index") + F.col("length")).alias("dataset_to_index"), *pointers)
    table.write.parquet(os.path.join(meta, "written"))  # the files are written once, by this job
    spark.read.parquet(os.path.join(meta, "written")).join(own, "episode_index").write.parquet(os.path.join(meta, "episodes"))
    shutil.rmtree(os.path.join(meta, "written"))
    episodes = spark.read.parquet(os.path.join(meta, "episodes"))
    if spans:
        new = {r.episode_index: r.new_index for r in named.select("episode_index", "new_index").collect()}  # as many rows as recordings with spans were read
        words = list(dict.fromkeys(s[3] for s in spans))
        marks = [(new[e], a, z, words.index(w)) for e, a, z, w in spans if e in new]
        pq.write_table(pa.table({"subtask": words, "subtask_index": pa.array(range(len(words)), pa.int64())}), os.path.join(meta, "subtasks.parquet"))
        pq.write_table(pa.table({n: pa.array(c, t) for (n, t), c in zip((("episode_index", pa.int64()), ("start", pa.float64()), ("end", pa.float64()), ("subtask_index", pa.int64())), zip(*marks, strict=True) if marks else ([],) * 4, strict=True)}), os.path.join(meta, "subtask_spans.parquet"))
    tasks = names.orderBy("task_index").toPandas()  # one row a distinct task
    tasks.set_index(task)[["task_index"]].to_parquet(os.path.join(meta, "tasks.parquet"))
    n, total = episodes.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    found = {}
    for k in features:
        dims = stats.explode_dims(rows, [], f"`{k}`")
        per = {r.dim: r for r in stats.feature_stats(dims, ["dim"]).collect()}  # one row a dimension
        qs = {r.dim: r for r in stats.histogram_quantiles(dims.where(~F.isnan("v")), ["dim"]).collect()}
        found[k] = {s: [getattr(per[d], s) for d in sorted(per)] for s in ("min", "max", "mean", "std")}
        found[k] |= {q: [getattr(qs[d], q) for d in sorted(qs)] for q in ("q01", "q10", "q50", "q90", "q99")} | {"count": [total]}
    info = {
        "codebase_version": VERSION, "robot_type": robot, "fps": fps, "total_episodes": n, "total_frames": total, "total_tasks": len(tasks),
        "chunks_size": FILES_PER_CHUNK, "data_files_size_in_mb": DATA_MB, "video_files_size_in_mb": VIDEO_MB, "data_path": "data/chunk-{chunk_index:03d}/file-{file_index:03d}.parquet", "video_path": None,
        "splits": {k: f"{a}:{b}" for k, (a, b) in sequence.splits(n, split).items()},
        "features": {k: {"dtype": "float32", "shape": [w]} for k, w in features.items()} | {k: {"dtype": "float32" if k == "timestamp" else "int64", "shape": [1]} for k in ORDER},
    }
    write_json(path, "stats", found)
    write_json(path, "info", info)  # last: what has it is whole
    return info


def write_json(path: str, name: str, body: dict) -> None:
    """A file of meta/, put in place once it is whole."""
    at = os.path.join(path, "meta", f"{name}.json")
    with open(f"{at}.new", "w") as f:
        json.dump(body, f, indent=1)
    os.replace(f"{at}.new", at)


def read(spark, path: str) -> DataFrame:
    """All frames of a dataset; columns that only some files have are null in the others."""
    return spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").option("pathGlobFilter", "*.parquet").parquet(os.path.join(path, "data"))


