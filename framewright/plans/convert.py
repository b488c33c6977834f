"""A conversion from bags to a dataset: scan, decode, route, align, trim, assemble and write.

All bags of a folder are converted together. Messages of one type are decoded in one pass, whichever
features they feed; what follows is one as-of resampling for all episodes and features."""

from __future__ import annotations

import importlib
import json
import os
import time
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.functions import decoders, text
from framewright.operators import align, sequence
from framewright.plans.config import ConfigError, Conversion, Feature
from framewright.sinks import dataset
from framewright.sources import bags, cdr, sidecars

SAMPLE = ["episode_index", "feature_key", "ts_ns", "seq", "value"]


def user_decoder(spec: str) -> decoders.Decoder:
    """The column builder that "module:function" names."""
    module, _, name = spec.partition(":")
    try:
        return getattr(importlib.import_module(module), name)
    except (ImportError, AttributeError, ValueError) as e:
        raise ConfigError(f"decoder {spec!r} can't be found") from e


def value_of(feature: Feature, msg_type: str, schema: T.StructType) -> F.Column:
    """The vector of a feature: its own decoder, else that of the type, else all numbers of the message."""
    msg = F.col("msg")
    if feature.decoder:
        return user_decoder(feature.decoder)(msg, feature.selectors)
    return decoders.decode(msg_type, msg, feature.selectors, feature.unit, schema=schema)


def samples(scan: Callable[[list[str]], DataFrame], config: Conversion, types: Mapping[str, str], definitions: Mapping[str, str]) -> DataFrame:
    """Samples of all features. scan: the raw messages of some topics; types: the message type of each topic; definitions: the text of each type."""
    parts = []
    by_type: dict[str, list[Feature]] = {}
    for f in config.features:
        if f.topic in types:
            by_type.setdefault((f.msg_type or types[f.topic]).replace("/msg/", "/"), []).append(f)
    known = cdr.STANDARD | {k.replace("/msg/", "/"): v for k, v in definitions.items()}
    for kind, features in by_type.items():
        if kind not in known:
            raise ConfigError(f"{kind}: its definition is needed")
        rows = cdr.decode_payloads(scan(sorted({f.topic for f in features})), kind, known[kind])
        schema = rows.schema["msg"].dataType
        stamp = F.lit(None).cast("long")
        if "header" in schema.names:
            stamp = decoders.header_stamp(F.col("msg.header.stamp.sec"), F.col("msg.header.stamp.nanosec"))
        fed = [F.when(F.col("topic") == f.topic, F.struct(F.lit(f.key).alias("feature_key"), F.lit(f.max_stamp_delay_ms).cast("double").alias("max_delay_ms"), F.lit(f.stamp_source).alias("stamp"), value_of(f, kind, schema).cast("array<float>").alias("value"))) for f in features]
        rows = rows.withColumn("header_ns", stamp).withColumn("f", F.explode(F.filter(F.array(*fed), lambda x: x.isNotNull())))
        parts.append(align.adopt_timestamp(align.drop_stale(rows.select("episode_index", "seq", "recv_ns", "header_ns", "f.*"), config.resampling.max_stamp_delay_ms)).select(*SAMPLE))
    if not parts:
        raise ConfigError("no topic of the configuration has messages")
    return reduce(DataFrame.unionByName, parts)


def frames(found: DataFrame, config: Conversion, window: DataFrame | None = None) -> DataFrame:
    """(episode_index, frame_index, a column a feature) of samples: aligned, trimmed and long enough. Gaps in the numbers are closed by the sink.

    window: (episode_index, start_ns, end_ns) of whole recordings, for configurations that don't align to required features."""
    how, keys = config.resampling, [f.key for f in config.features]
    whole = not (how.align_to_required and config.required_keys)
    spans = (window if window is not None else align.full_window(found, "ts_ns")) if whole else align.required_window(found, config.required_keys)
    aligned = align.resample_windows(found, spans, config.fps, keys, how.policy, int(how.tolerance_ms * 1e6))
    names = {k: f"f{n}" for n, k in enumerate(keys)}  # keys have dots
    wide = align.widen(aligned.replace(names, subset=["feature_key"]), list(names.values()))
    if how.trim_to_valid and config.required_keys:
        wide = align.trim_to_valid(wide, [names[k] for k in config.required_keys])
    if how.min_length > 0:
        wide = wide.join(sequence.min_length(wide, how.min_length).select("episode_index"), "episode_index", "left_semi")
    return wide.select("episode_index", "frame_index", *[F.col(names[k]).alias(k) for k in keys])


def merged(wide: DataFrame, config: Conversion, widths: Mapping[str, int]) -> tuple[DataFrame, dict[str, int]]:
    """Sub-keys of observation.state and action made one vector each, zeros for what is missing; and the widths of all."""
    out, sizes = {}, {}
    heads = config.merged
    inner = {k for ks in heads.values() for k in ks}
    for head, ks in heads.items():
        out[head] = text.merged([(F.col(f"`{k}`"), widths[k]) for k in ks])
        sizes[head] = sum(widths[k] for k in ks)
    for k in widths:
        if k not in inner:
            out[k], sizes[k] = F.col(f"`{k}`"), widths[k]
    return wide.select("episode_index", "frame_index", *[c.alias(k) for k, c in out.items()]), sizes


def widths_of(found: DataFrame) -> dict[str, int]:
    """The width of each feature's vectors; different ones in one feature are an error. One row a feature reaches the driver."""
    rows = found.where("value IS NOT NULL").groupBy("feature_key").agg(F.min(F.size("value")).alias("a"), F.max(F.size("value")).alias("b")).collect()
    if bad := sorted(r.feature_key for r in rows if r.a != r.b):
        raise ConfigError(f"{bad[0]}: vectors of different widths")
    return {r.feature_key: r.a for r in rows}


def tasks_of(found: list[str], config: Conversion, option: str | None) -> list[tuple[int, str, list]]:
    """(episode_index, task, subtask spans) of each bag, from the file beside it, the command or the configuration."""
    out = []
    for k, bag in enumerate(found):
        side = os.path.join(bag if os.path.isdir(bag) else os.path.dirname(bag), "task.json")
        spec = sidecars.Task(None, ())
        if os.path.exists(side):
            with open(side) as f:
                spec = sidecars.parse_task(f.read())
        out.append((k, sidecars.resolve_task(spec.task, option, config.task), [list(s) for s in spec.spans]))
    return out


def convert(spark: SparkSession, folder: str, out: str, config: Conversion, task: str | None = None, max_episodes: int | None = None, definitions: Mapping[str, str] | None = None, resume: bool = False) -> dict:
    """Convert the bags of a folder and return the dataset's info; with `resume` a finished one is left as it is."""
    if not dataset.guard(out, resume):
        with open(os.path.join(out, "meta", "info.json")) as f:
            return json.load(f)
    began = time.time()
    if images := [f.key for f in config.features if f.dtype == "image"]:
        raise ConfigError(f"{images[0]}: no video encoder is here; leave image features out")
    found = bags.discover(folder)[:max_episodes]
    named = tasks_of(found, config, task)
    scan = lambda topics: bags.read_bags(spark, folder, topics=topics).where(F.col("episode_index") < len(found))
    kinds = {r.topic: r.msg_type for r in bags.read_bags(spark, folder, payload=False).groupBy("topic").agg(F.first("msg_type").alias("msg_type")).collect()}  # one row a topic
    if missing := sorted({f.topic for f in config.features if f.required} - set(kinds)):
        raise ConfigError(f"topics missing: {', '.join(missing)}")
    rows = samples(scan, config, kinds, definitions or {}).cache()  # read for widths, windows and frames
    widths = widths_of(rows)
    whole = align.full_window(bags.read_bags(spark, folder, payload=False).where(F.col("episode_index") < len(found)))
    wide, sizes = merged(frames(rows, config, whole), config, widths)
    tasks = spark.createDataFrame([(k, t) for k, t, _ in named], "episode_index long, task string")
    spans = [(k, *s) for k, _, ss in named for s in ss]
    info = dataset.write(wide.join(tasks, "episode_index"), out, sizes, config.fps, config.robot_type, split=(config.split.train, config.split.val, config.split.test), spans=spans)
    rows.unpersist()
    took = time.time() - began
    hashed = {r.bag_path: r.sha256 for r in sidecars.digests(spark, found).collect()}  # one row a bag
    dataset.write_json(out, "conversion_log", {"fps": config.fps, "episodes": info["total_episodes"], "inputs": [{"path": b, "sha256": hashed[b]} for b in sorted(found)]})
    dataset.write_json(out, "job_summary", {"total_episodes": len(found), "succeeded": info["total_episodes"], "dropped": len(found) - info["total_episodes"], "total_frames": info["total_frames"], "wall_s": round(took, 3), "frames_per_min": round(info["total_frames"] / took * 60, 3)})
    return info
