"""What the operators of this subpackage share: input, Arrow batches, lineage cuts."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches are bounded by rows and by bytes, so very long texts can't pile up in a Python worker.
BATCH_ROWS, BATCH_BYTES = 5000, 16 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Bound the Arrow batches that Python operators of this session receive, to `size` bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where the session names none, one is made on this machine, but only if it is all there is."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="framewright-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Bits of a key filter: at most 2,048 rows of 4 KB, whatever it holds.
FILTER_BITS = 1 << 26


def key_filter(keys: DataFrame, key: str) -> DataFrame:
    """(__block, __bits) of the long keys: one hash of each sets a bit. Bounded in size, so it may be broadcast."""
    at = keys.select((F.pmod(F.xxhash64(key), F.lit(FILTER_BITS)) + 1).alias("at"))
    return checkpointed(at.groupBy(F.bitmap_bucket_number("at").alias("__block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("__bits")))


def split_by(df: DataFrame, key: str, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of `df` whose key a key filter may hold, and those that it surely doesn't. Nothing is shuffled.

    A join on the first part alone spares the other one's texts a shuffle. The fuller the filter, the
    more rows lie in the first part needlessly; none is ever missing there."""
    at = df.withColumn("__at", F.pmod(F.xxhash64(key), F.lit(FILTER_BITS)) + 1).withColumn("__block", F.bitmap_bucket_number("__at"))
    byte = F.expr("CAST(conv(hex(substring(__bits, CAST(bitmap_bit_position(__at) div 8 AS INT) + 1, 1)), 16, 10) AS INT)")
    hit = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, CAST(bitmap_bit_position(__at) % 8 AS INT))")) != 0, F.lit(False))
    marked = at.join(F.broadcast(held), "__block", "left").withColumn("__hit", hit)
    return marked.where("__hit").select(*df.columns), marked.where("NOT __hit").select(*df.columns)


@contextmanager
def uncollected() -> Iterator[None]:
    """No cyclic garbage collection while a batch makes millions of small objects that hold no cycles."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()
