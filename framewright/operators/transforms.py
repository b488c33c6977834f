"""Poses from a tree of transforms: the nearest sample of each edge, composed along the path."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions import geometry

PARTS = ("tx", "ty", "tz", "qx", "qy", "qz", "qw")


def nearest_edge(grid: DataFrame, edge: DataFrame, name: str) -> DataFrame:
    """Add the pose of an edge (episode_index, stamp_ns, seq, parts) nearest to each grid_ns as struct `name`.

    Equally near stamps: the earlier; before the first and after the last that one, however far; of
    equal stamps the first. One union, one shuffle and a sort each way, as in resampling."""
    pose = F.struct("stamp_ns", *PARTS)
    keep = [c for c in grid.columns if c not in ("episode_index", "grid_ns")]
    rows = edge.select("episode_index", F.col("stamp_ns").alias("t"), F.lit(1).alias("is_pose"), F.col("seq"), pose.alias("pose"), *[F.lit(None).cast(grid.schema[c].dataType).alias(c) for c in keep])
    points = grid.select("episode_index", F.col("grid_ns").alias("t"), F.lit(0).alias("is_pose"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast(rows.schema["pose"].dataType).alias("pose"), *keep)
    # poses at the same time come after the point, so the first of them is the next one; earlier ones count back from the last
    w = Window.partitionBy("episode_index").orderBy("t", "is_pose", "seq")
    back = Window.partitionBy("episode_index").orderBy(F.desc("t"), F.desc("is_pose"), F.desc("seq"))
    ends = {"before": F.last("pose", True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "after": F.last("pose", True).over(back.rowsBetween(Window.unboundedPreceding, -1))}
    both = rows.unionByName(points).withColumns(ends)
    b, a, t = F.col("before"), F.col("after"), F.col("t")
    pick = F.when(a.isNull() | (t - b["stamp_ns"] <= a["stamp_ns"] - t), b).otherwise(a)
    return both.where("is_pose = 0").select("episode_index", t.alias("grid_ns"), *keep, pick.alias(name))


def sample(grid: DataFrame, edges: list[tuple[str, str]], dynamic: dict[int, DataFrame], static: dict[int, tuple[float, ...]], source: str, target: str, euler: bool = False) -> DataFrame:
    """The pose of target in source at each grid point as array<float>: t and quaternion, or t and roll, pitch, yaw.

    edges: (parent, child); each has rows in `dynamic` or seven numbers in `static`, which come first."""
    names = [f"__{p}" for p in PARTS]
    one = [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    out = grid.withColumns({n: F.lit(v) for n, v in zip(names, one, strict=True)})
    for k, back in geometry.path(edges, source, target):
        if k in static:
            parts = [F.lit(float(v)) for v in static[k]]
        else:
            out = nearest_edge(out, dynamic[k], "__edge")
            parts = [F.col(f"__edge.{p}") for p in PARTS]
        # each step's numbers are columns of their own: nested expressions would repeat them over and over
        step = [f"__s{p}" for p in PARTS]
        out = out.withColumns(dict(zip(step, [*parts[:3], *geometry.normalised(parts[3:])], strict=True))).drop("__edge")
        t, q = [F.col(c) for c in step[:3]], [F.col(c) for c in step[3:]]
        if back:
            t, q = geometry.inverse(t, q)
        t, q = geometry.compose([F.col(c) for c in names[:3]], [F.col(c) for c in names[3:]], t, q)
        out = out.withColumns(dict(zip(names, [*t, *q], strict=True))).drop(*step)
    t, q = [F.col(c) for c in names[:3]], [F.col(c) for c in names[3:]]
    if euler:
        angles = ["__roll", "__pitch", "__yaw"]
        out = out.withColumns(dict(zip(names[3:], geometry.normalised(q), strict=True)))
        out = out.withColumns(dict(zip(angles, geometry.unit_euler(q), strict=True)))
        q = [F.col(c) for c in angles]
    return out.select(*grid.columns, F.array(*[c.cast("float") for c in [*t, *q]]).alias("value"))
