"""Messages to vectors: column builders by message type, over struct payloads.

A decoder gets the payload column and the selectors and returns array<float>. User decoders
registered for a type come before the built-in ones."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.functions import text

Decoder = Callable[[Column, list[str] | None], Column]
BUILT_IN: dict[str, Decoder] = {}
REGISTERED: dict[str, Decoder] = {}
ALIASES = {"pos": "position", "vel": "velocity", "eff": "effort", "lin": "linear", "ang": "angular"}


def register(msg_type: str) -> Callable[[Decoder], Decoder]:
    def add(f: Decoder) -> Decoder:
        REGISTERED[msg_type] = f
        return f

    return add


def _built_in(*types: str) -> Callable[[Decoder], Decoder]:
    def add(f: Decoder) -> Decoder:
        BUILT_IN.update(dict.fromkeys(types, f))
        return f

    return add


def field(msg: Column, dotted: str) -> Column:
    for part in dotted.split("."):
        msg = msg[ALIASES.get(part, part)]
    return msg


def floats(*columns: Column) -> Column:
    return F.array(*[c.cast("float") for c in columns])


def xyz(v: Column) -> list[Column]:
    return [v["x"], v["y"], v["z"]]


def dotted(msg: Column, selectors: list[str]) -> Column:
    return floats(*[field(msg, s) for s in selectors])


@_built_in("sensor_msgs/JointState")
def joint_state(msg: Column, selectors: list[str] | None) -> Column:
    if not selectors:
        return msg["position"].cast("array<float>")
    parts = []
    for s in selectors:
        m = re.match(r"\w+", s)
        if m is None or ":" in s:
            raise ValueError(f"selector {s!r} isn't understood")
        head = ALIASES.get(m[0], m[0])
        parts.append(text.select(msg[head].cast("array<float>"), head + s[m.end() :], msg["name"]))
    return F.concat(*parts)


@_built_in("geometry_msgs/Twist")
def twist(msg: Column, selectors: list[str] | None) -> Column:
    return dotted(msg, selectors) if selectors else floats(*xyz(msg["linear"]), *xyz(msg["angular"]))


@_built_in("geometry_msgs/TwistStamped")
def twist_stamped(msg: Column, selectors: list[str] | None) -> Column:
    return twist(msg["twist"], selectors)


@_built_in("geometry_msgs/WrenchStamped")
def wrench(msg: Column, selectors: list[str] | None) -> Column:
    w = msg["wrench"]
    return dotted(w, selectors) if selectors else floats(*xyz(w["force"]), *xyz(w["torque"]))


@_built_in("trajectory_msgs/JointTrajectory")
def trajectory(msg: Column, selectors: list[str] | None) -> Column:
    """The last point; without points zeros, one a joint."""
    last = F.try_element_at(msg["points"], F.lit(-1))
    zeros = F.array_repeat(F.lit(0.0).cast("float"), F.size(msg["joint_names"]))
    return F.when(F.size(msg["points"]) == 0, zeros).otherwise(F.concat(*[last[ALIASES.get(s, s)].cast("array<float>") for s in selectors or ["positions"]]))


def pose(p: Column) -> list[Column]:
    return [*xyz(p["position"]), *xyz(p["orientation"]), p["orientation"]["w"]]


@_built_in("nav_msgs/Odometry")
def odometry(msg: Column, selectors: list[str] | None) -> Column:
    t = msg["twist"]["twist"]
    return dotted(msg, selectors) if selectors else floats(*pose(msg["pose"]["pose"]), *xyz(t["linear"]), *xyz(t["angular"]))


@_built_in("sensor_msgs/Imu")
def imu(msg: Column, selectors: list[str] | None) -> Column:
    o = msg["orientation"]
    return dotted(msg, selectors) if selectors else floats(*xyz(o), o["w"], *xyz(msg["angular_velocity"]), *xyz(msg["linear_acceleration"]))


@_built_in("geometry_msgs/PoseStamped")
def pose_stamped(msg: Column, selectors: list[str] | None) -> Column:
    return dotted(msg["pose"], selectors) if selectors else floats(*pose(msg["pose"]))


@_built_in("geometry_msgs/Pose")
def plain_pose(msg: Column, selectors: list[str] | None) -> Column:
    return dotted(msg, selectors) if selectors else floats(*pose(msg))


@_built_in("sensor_msgs/Joy")
def joy(msg: Column, selectors: list[str] | None) -> Column:
    if not selectors:
        return F.concat(msg["axes"].cast("array<float>"), msg["buttons"].cast("array<float>"))
    parts = []
    for s in selectors:
        head, _, k = s.partition(".")
        v = msg[head].cast("array<float>")
        parts.append(F.array(F.try_element_at(v, F.lit(int(k) + 1))) if k else v)
    return F.concat(*parts)


@_built_in("std_msgs/Float32", "std_msgs/Float64")
def number(msg: Column, selectors: list[str] | None) -> Column:
    return floats(msg["data"])


@_built_in("std_msgs/Float32MultiArray")
def numbers(msg: Column, selectors: list[str] | None) -> Column:
    data = msg["data"].cast("array<float>")
    return F.array(*[F.try_element_at(data, F.lit(int(k) + 1)) for k in selectors]) if selectors else data


@_built_in("std_msgs/String")
def string(msg: Column, selectors: list[str] | None) -> Column:
    return msg["data"]


def numbers_of(value: Column, kind: T.DataType) -> Column | None:
    """All numbers of a value of any type, in order, as array<float>; a point or quaternion gives x, y, z and w. Null for text."""
    if isinstance(kind, T.NumericType | T.BooleanType):
        return F.array(value.cast("float"))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType | T.BooleanType):
        return value.cast("array<float>")
    if isinstance(kind, T.StructType):
        named = [f for n in "xyzw" for f in kind.fields if f.name == n] or kind.fields
        parts = [p for f in named if (p := numbers_of(value[f.name], f.dataType)) is not None]
        return F.concat(*parts) if parts else None
    return None


def generic(msg: Column, selectors: list[str] | None, schema: T.StructType) -> Column:
    """Any message: all its numbers, or those that selectors name (`a.b`, `a.b.2`, `a.b[2]`, negative places from the end)."""
    if not selectors:
        return F.coalesce(numbers_of(msg, T.StructType([f for f in schema.fields if f.name != "header"])), F.array().cast("array<float>"))
    out = []
    for s in selectors:
        value, kind = msg, schema
        for part in re.findall(r"-?\w+", s):
            if isinstance(kind, T.ArrayType):
                k = int(part)
                value, kind = F.try_element_at(value, F.lit(k + 1 if k >= 0 else k)), kind.elementType
            elif isinstance(kind, T.StructType) and part in kind.names:
                value, kind = value[part], kind[part].dataType
            else:
                raise ValueError(f"selector {s!r}: no {part!r} there")
        if (found := numbers_of(value, kind)) is None:
            raise ValueError(f"selector {s!r} names no number")
        out.append(found)
    return F.concat(*out)


UNCONVERTED = ("sensor_msgs/Joy", "std_msgs/Float32", "std_msgs/Float64", "std_msgs/Float32MultiArray", "std_msgs/String")


def decode(msg_type: str, msg: Column, selectors: list[str] | None = None, unit: str | float | None = None, pad_to: int | None = None, schema: T.StructType | None = None) -> Column:
    """The vector of a message: a registered decoder, else the built-in one, else (with its schema) the generic one,
    which has no unit; then its unit, then zeros up to a width."""
    plain = msg_type.replace("/msg/", "/")
    maker = REGISTERED.get(plain) or BUILT_IN.get(plain)
    if maker is None and schema is None:
        raise KeyError(f"no decoder for {msg_type}")
    out = maker(msg, selectors) if maker else generic(msg, selectors, schema)
    if unit is not None and maker and plain not in UNCONVERTED:
        out = F.transform(out, lambda v: text.convert(v, unit))
    return out if pad_to is None else text.pad(out, pad_to)


def header_stamp(sec: Column, nanosec: Column) -> Column:
    """Nanoseconds of a header; null if missing or zero."""
    ns = sec.try_cast("long") * 1_000_000_000 + nanosec.try_cast("long")
    return F.when(ns != 0, ns)
