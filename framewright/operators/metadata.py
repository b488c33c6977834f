"""What a recording holds and how it fits a configuration: topics, shapes, rates, scaffolds."""

from __future__ import annotations

import statistics

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions.decoders import BUILT_IN, REGISTERED
from framewright.plans.config import Conversion, Feature

INFRASTRUCTURE_TYPES = ("rcl_interfaces/Log", "rcl_interfaces/ParameterEvent", "tf2_msgs/TFMessage", "diagnostic_msgs/DiagnosticArray")
INFRASTRUCTURE_TOPICS = ("/rosout", "/parameter_events", "/tf", "/tf_static", "/diagnostics")
COMMANDS = ("cmd", "command", "target", "goal", "action")


def topics(messages: DataFrame) -> DataFrame:
    return messages.groupBy("topic").agg(F.first("msg_type").alias("msg_type"), F.count("*").alias("count"))


def useful_topics(found: DataFrame, least: int = 1) -> DataFrame:
    """Topics with enough messages that aren't the middleware's own."""
    plain = F.regexp_replace("msg_type", "/msg/", "/")
    return found.where((F.col("count") >= least) & ~F.coalesce(plain, F.lit("")).isin(*INFRASTRUCTURE_TYPES) & ~F.col("topic").isin(*INFRASTRUCTURE_TOPICS))


def consensus_shape(samples: DataFrame, by: str, order: str, shape: str, n: int = 5) -> DataFrame:
    """The shape that the first n samples share; null if they differ or one couldn't be read."""
    head = samples.withColumn("k", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("k") <= n)
    same = (F.count(shape) == F.count("*")) & (F.count_distinct(shape) == 1)
    return head.groupBy(by).agg(F.when(same, F.first(shape)).alias("shape"))


def target_rate(images: list[float], states: list[float]) -> int:
    """The slowest camera's rate, else the median of the states', else 30; at least 1."""
    return max(1, round(min(images)) if images else round(statistics.median(states)) if states else 30)


def target_rates(rates: DataFrame, by: str) -> DataFrame:
    """target_rate() of many recordings: (by, target) of rows (by, fps, is_image)."""
    image, state = F.min(F.when(F.col("is_image"), F.col("fps"))), F.percentile(F.when(~F.col("is_image"), F.col("fps")), F.lit(0.5))
    return rates.groupBy(by).agg(F.greatest(F.lit(1.0), F.coalesce(F.rint(image), F.rint(state), F.lit(30.0))).cast("long").alias("target"))


def config_verdict(found: DataFrame, config: Conversion, strict: bool = False) -> dict:
    """Missing, unused and mistyped topics of a configuration, and whether it fails."""
    have = {r.topic: (r.msg_type or "").replace("/msg/", "/") for r in found.collect()}  # one row a topic
    out = {
        "missing_required": sorted({f.topic for f in config.features if f.required} - set(have)),
        "missing_optional": sorted({f.topic for f in config.features if not f.required} - set(have) - {f.topic for f in config.features if f.required}),
        "unused": sorted(set(have) - set(config.topics)),
        "type_mismatch": sorted({f.topic for f in config.features if f.msg_type and f.topic in have and have[f.topic] != f.msg_type.replace("/msg/", "/")}),
    }
    bad = out["missing_required"] or out["type_mismatch"] or (strict and out["unused"])
    return out | {"verdict": "FAIL" if bad else "PASS"}


def scaffold(found: DataFrame, fps: float, robot: str, task: str) -> tuple[Conversion, list[Feature]]:
    """A first configuration: cameras and decodable states are mapped; commands and the rest are candidates only."""
    mapped, candidates, taken = [], [], set()
    for r in useful_topics(found).orderBy("topic").collect():  # one row a topic
        kind = (r.msg_type or "").replace("/msg/", "/")
        name = "_".join(p for p in r.topic.lower().split("/") if p) or "topic"
        head = "observation.images" if kind.endswith("Image") else "observation.state"
        key, k = f"{head}.{name}", 2
        while key in taken:
            key, k = f"{head}.{name}_{k}", k + 1
        taken.add(key)
        f = Feature(topic=r.topic, key=key, msg_type=kind, dtype="image" if kind.endswith("Image") else "float32")
        known = kind.endswith("Image") or (kind in BUILT_IN or kind in REGISTERED) and kind != "std_msgs/String"
        (mapped if known and not any(c in r.topic.lower() for c in COMMANDS) else candidates).append(f)
    return Conversion(fps=fps, robot_type=robot, task=task, features=mapped), candidates
