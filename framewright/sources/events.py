"""The events table as a stream of topic messages: (episode_index, topic, recv_ns, header_ns, seq, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users are episodes, event types are topics. The header stamp is synthetic: k milliseconds before receipt, none if k is a multiple of 10."""
    ns = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', ts) * 1000")
    k = F.get_json_object("props", "$.k").cast("long")
    header = F.when(k % 10 != 0, ns - k * 1_000_000)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("episode_index"), F.col("event_type").alias("topic"), ns.alias("recv_ns"), header.alias("header_ns"), F.col("event_id").alias("seq"), F.col("value"))
