"""Quaternions (x, y, z, w) and poses as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Parts = Sequence[Column]


def normalised(q: Parts) -> list[Column]:
    """A unit quaternion; zero gives the identity."""
    n = F.sqrt(sum((c * c for c in q[1:]), q[0] * q[0]))
    return [F.when(n == 0, F.lit(float(k == 3))).otherwise(c / n) for k, c in enumerate(q)]


def euler(q: Parts) -> list[Column]:
    """Roll, pitch and yaw. At the poles roll is 0 and yaw takes all of the turn."""
    return unit_euler(normalised(q))


def unit_euler(q: Parts) -> list[Column]:
    """The same of a quaternion that is normalised already."""
    x, y, z, w = q
    sinp = 2 * (w * y - z * x)
    pole = F.abs(sinp) >= 1 - 1e-9
    roll = F.when(pole, 0.0).otherwise(F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y)))
    pitch = F.when(pole, F.signum(sinp) * F.lit(1.5707963267948966)).otherwise(F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), sinp))))
    yaw = F.when(pole, -F.signum(sinp) * 2 * F.atan2(x, w)).otherwise(F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z)))
    return [roll, pitch, wrap(yaw)]


def wrap(angle: Column) -> Column:
    """Into (-pi, pi]."""
    return F.atan2(F.sin(angle), F.cos(angle))


def product(a: Parts, b: Parts) -> list[Column]:
    """The Hamilton product."""
    (ax, ay, az, aw), (bx, by, bz, bw) = a, b
    return [aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw, aw * bw - ax * bx - ay * by - az * bz]


def rotate(q: Parts, v: Parts) -> list[Column]:
    x, y, z, w = q
    tx, ty, tz = 2 * (y * v[2] - z * v[1]), 2 * (z * v[0] - x * v[2]), 2 * (x * v[1] - y * v[0])
    return [v[0] + w * tx + y * tz - z * ty, v[1] + w * ty + z * tx - x * tz, v[2] + w * tz + x * ty - y * tx]


def compose(t1: Parts, q1: Parts, t2: Parts, q2: Parts) -> tuple[list[Column], list[Column]]:
    """The pose of the second in the frame of the first's parent."""
    return [a + b for a, b in zip(t1, rotate(q1, t2), strict=True)], product(q1, q2)


def inverse(t: Parts, q: Parts) -> tuple[list[Column], list[Column]]:
    conj = [-q[0], -q[1], -q[2], q[3]]
    return [-c for c in rotate(conj, t)], conj


def path(edges: list[tuple[str, str]], source: str, target: str) -> list[tuple[int, bool]]:
    """The edges from source to target (number, backwards) by breadth-first search over the few edges of a tree."""
    known = {source: []}
    queue = [source]
    while queue:
        at = queue.pop(0)
        if at == target:
            return known[at]
        for k, (parent, child) in enumerate(edges):
            for a, b, back in ((parent, child, False), (child, parent, True)):
                if a == at and b not in known:
                    known[b] = [*known[at], (k, back)]
                    queue.append(b)
    raise ValueError(f"no path from {source} to {target}")
