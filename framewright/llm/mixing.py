"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations alone.

Leaves are (domain, language, source). A node's capacity is what its leaves hold times the epochs
allowed. From the root down, each node shares its budget among its children in proportion to their
weights; a child takes its capacity at most, and what it can't take goes to its siblings. As a
subtree's capacity is the sum of its leaves', only what no sibling can take is left to the node's
own siblings: shortages are met among siblings before ancestors.

A leaf's budget is whole seeded epochs and then a prefix of one more: rows in the order of a seeded
hash while their tokens fit. The cut is found from sums per hash bucket and the rows of one bucket,
so no leaf, however large, is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.common import checkpointed

LEVELS = ("domain", "lang", "source")
SEED, EPOCHS = 17, 4
#: Hex digits of the order that name a bucket.
DIGITS = 3
NUMBER = "decimal(38,0)"
#: Leaves whose plan, some 200 bytes each, may be broadcast.
LEAVES = 50_000


def share(nodes: DataFrame, parent: list[str], node: list[str], weight: Column) -> DataFrame:
    """Add `budget` to nodes (node, capacity, up): the part of the parent's budget `up` that each gets.

    Children in order of capacity per weight; one is filled if the budget that the earlier ones left
    gives it, by weight, its capacity or more. The others share the rest by weight, rounded down.
    All in whole numbers."""
    w = nodes.withColumn("w", weight.cast(NUMBER)).withColumn("c", F.col("capacity").cast(NUMBER)).withColumn("up", F.col("up").cast(NUMBER))
    order = [F.when(F.col("w") > 0, 0).otherwise(1), F.col("c").cast("double") / F.greatest(F.col("w"), F.lit(1)).cast("double"), *map(F.col, node)]
    by = Window.partitionBy(*parent).orderBy(*order)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    sum_before = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    w = w.withColumn("c_before", sum_before("c").cast(NUMBER)).withColumn("w_after", (F.sum("w").over(Window.partitionBy(*parent)) - sum_before("w")).cast(NUMBER))
    left = F.greatest(F.col("up") - F.col("c_before"), F.lit(0).cast(NUMBER)).cast(NUMBER)
    w = w.withColumn("full", F.expr("w > 0") & ((left * F.col("w")).cast(NUMBER) >= (F.col("c") * F.col("w_after")).cast(NUMBER)))
    # filled children are a prefix of the order; the rest share what is left beyond the prefix
    w = w.withColumn("k", F.row_number().over(by))
    first_open = F.min(F.when(~F.col("full"), F.struct("k", F.col("c_before").alias("used"), F.col("w_after").alias("w_open"))))
    w = w.withColumn("some_open", first_open.over(Window.partitionBy(*parent)))
    filled = F.col("some_open").isNull() | (F.col("k") < F.col("some_open.k"))
    part = F.expr("CASE WHEN some_open.w_open > 0 THEN greatest(up - some_open.used, 0) * w div some_open.w_open ELSE 0 END")
    w = w.withColumn("budget", F.when(filled, F.when(F.col("w") > 0, F.col("c")).otherwise(0)).otherwise(F.least(F.col("c"), part)).cast("long"))
    return w.drop("w", "c", "up", "c_before", "w_after", "full", "some_open", "k")


def budgets(leaves: DataFrame, weights: Mapping[str, Column], total: Column, epochs: int = EPOCHS) -> DataFrame:
    """Add `budget` to leaves (levels, tokens). weights: a column of whole numbers per level; total: of the corpus's tokens, as column `tokens`."""
    out = leaves.withColumn("capacity", F.col("tokens") * epochs)
    root = leaves.agg(total.cast("long").alias("up"))
    nodes: list[DataFrame] = []
    for depth in range(1, len(LEVELS) + 1):
        level = list(LEVELS[:depth])
        sums = out.groupBy(level).agg(F.sum("capacity").alias("capacity"))
        above = root.withColumn("__one", F.lit(1)) if depth == 1 else nodes[-1].select(*LEVELS[: depth - 1], F.col("budget").alias("up"))
        sums = sums.withColumn("__one", F.lit(1)).join(above, "__one") if depth == 1 else sums.join(above, list(LEVELS[: depth - 1]))
        nodes.append(share(sums, ["__one"] if depth == 1 else level[:-1], level, weights[level[-1]]))
    return leaves.join(nodes[-1].select(*LEVELS, "budget"), list(LEVELS))


def plan(df: DataFrame, tokens: Column, levels: Mapping[str, Column], weights: Mapping[str, Column], total: Column, key: str = "doc_id", epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """One row a leaf: its tokens, budget, whole epochs, and the last (order, key) of the next one's prefix.

    Null levels are written as empty strings and are leaves like others; an empty table has no leaves."""
    narrow = df.select(F.col(key).alias("__key"), tokens.cast("long").alias("tokens"), *[F.coalesce(levels[k], F.lit("")).alias(k) for k in LEVELS])
    narrow = checkpointed(narrow)
    leaves = narrow.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    found = budgets(leaves, weights, total, epochs)
    found = checkpointed(found.withColumn("full_epochs", F.expr("CASE WHEN tokens > 0 THEN budget div tokens ELSE 0 END").cast("int")).withColumn("rest", F.expr("budget - full_epochs * tokens")))
    part = narrow.join(found.where("rest > 0").select(*LEVELS, "full_epochs", "rest"), list(LEVELS)).withColumn("__order", order_of(F.col("__key"), seed, F.col("full_epochs"))).withColumn("__bucket", F.substring("__order", 1, DIGITS))
    sums = part.groupBy(*LEVELS, "__bucket", "rest").agg(F.sum("tokens").alias("in_bucket"))
    upto = Window.partitionBy(*LEVELS).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("upto", F.sum("in_bucket").over(upto))
    edge = sums.groupBy(*LEVELS).agg(F.min(F.when(F.col("upto") > F.col("rest"), F.struct(F.col("__bucket").alias("b"), (F.col("upto") - F.col("in_bucket")).alias("before")))).alias("edge"), F.max("rest").alias("rest"))
    edge = edge.select(*LEVELS, F.col("edge.b").alias("__bucket"), F.col("edge.before").alias("before"), F.col("rest").alias("__rest"))
    inside = part.join(edge, [*LEVELS, "__bucket"]).withColumn("sum", F.sum("tokens").over(Window.partitionBy(*LEVELS).orderBy("__order", "__key")) + F.col("before"))
    last = inside.where("sum <= __rest").groupBy(*LEVELS).agg(F.max(F.struct("__order", "__key")).alias("last"))
    cut = edge.join(last, list(LEVELS), "left").select(*LEVELS, F.col("__bucket").alias("cut_bucket"), F.col("last.__order").alias("cut_order"), F.col("last.__key").alias("cut_key"))
    return checkpointed(found.join(cut, list(LEVELS), "left"))


def order_of(key: Column, seed: int, epoch: Column) -> Column:
    """The place of a row in an epoch's order, as hex digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))


def selected(df: DataFrame, leaves: DataFrame, levels: Mapping[str, Column], key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """Rows of `df` once for each epoch that takes them, with column `epoch` (from 0). No other column changes:
    where `df` has an `epoch` of its own, the new column's name gets an underscore.

    Whole epochs take every row, the next one the rows up to the leaf's cut. The plan has one row a
    leaf: up to LEAVES of them, which are counted, it is broadcast, so texts stay where they are;
    beyond that it is joined by shuffle. Rows with equal order and key are taken together."""
    named = leaves.select(*[F.col(k).alias(f"__{k}") for k in LEVELS], F.col("full_epochs").alias("__full"), F.col("rest").alias("__rest"), F.col("cut_bucket").alias("__cut_bucket"), F.col("cut_order").alias("__cut"), F.col("cut_key").alias("__cut_key"))
    named = F.broadcast(named) if leaves.count() <= LEAVES else named.hint("merge")
    keyed = df.withColumns({f"__{k}": F.coalesce(levels[k], F.lit("")) for k in LEVELS}).join(named, [f"__{k}" for k in LEVELS])
    order = order_of(F.col(key), seed, F.col("__full"))
    # without a cut bucket the rest holds the whole leaf; without a cut no row of that bucket fits
    bucket = F.substring(order, 1, DIGITS)
    within = F.coalesce((order < F.col("__cut")) | ((order == F.col("__cut")) & (F.coalesce(F.col(key).eqNullSafe(F.col("__cut_key")), F.lit(False)) | (F.col(key) < F.col("__cut_key")))), F.lit(False))
    taken = (F.col("__rest") > 0) & (F.col("__cut_bucket").isNull() | (bucket < F.col("__cut_bucket")) | ((bucket == F.col("__cut_bucket")) & within))
    copies = keyed.withColumn("__copies", F.col("__full") + F.when(taken, 1).otherwise(0)).where("__copies > 0")
    name = "epoch"
    while name in df.columns:
        name += "_"
    return copies.select(*df.columns, F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)).alias(name))
