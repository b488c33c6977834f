"""Message definitions to Spark types, and CDR payloads to structs."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

PRIMITIVES = {
    "bool": ("?", T.BooleanType()), "byte": ("B", T.ShortType()), "char": ("B", T.ShortType()), "int8": ("b", T.ByteType()), "uint8": ("B", T.ShortType()),
    "int16": ("h", T.ShortType()), "uint16": ("H", T.IntegerType()), "int32": ("i", T.IntegerType()), "uint32": ("I", T.LongType()),
    "int64": ("q", T.LongType()), "uint64": ("Q", T.DecimalType(20, 0)), "float32": ("f", T.FloatType()), "float64": ("d", T.DoubleType()),
}
BUILT_IN = {"builtin_interfaces/Time": "int32 sec\nuint32 nanosec", "builtin_interfaces/Duration": "int32 sec\nuint32 nanosec", "std_msgs/Header": "builtin_interfaces/Time stamp\nstring frame_id"}
_XYZ = "float64 x\nfloat64 y\nfloat64 z"
BUILT_IN |= {
    "geometry_msgs/Vector3": _XYZ, "geometry_msgs/Point": _XYZ, "geometry_msgs/Quaternion": _XYZ + "\nfloat64 w",
    "geometry_msgs/Twist": "Vector3 linear\nVector3 angular", "geometry_msgs/Wrench": "Vector3 force\nVector3 torque", "geometry_msgs/Pose": "Point position\nQuaternion orientation",
    "geometry_msgs/PoseWithCovariance": "Pose pose\nfloat64[36] covariance", "geometry_msgs/TwistWithCovariance": "Twist twist\nfloat64[36] covariance",
}
#: Definitions of the common types, for bags that carry none.
STANDARD = BUILT_IN | {
    "sensor_msgs/JointState": "Header header\nstring[] name\nfloat64[] position\nfloat64[] velocity\nfloat64[] effort",
    "geometry_msgs/TwistStamped": "Header header\nTwist twist", "geometry_msgs/WrenchStamped": "Header header\nWrench wrench", "geometry_msgs/PoseStamped": "Header header\nPose pose",
    "nav_msgs/Odometry": "Header header\nstring child_frame_id\ngeometry_msgs/PoseWithCovariance pose\ngeometry_msgs/TwistWithCovariance twist",
    "sensor_msgs/Joy": "Header header\nfloat32[] axes\nint32[] buttons", "std_msgs/Float32": "float32 data", "std_msgs/Float64": "float64 data", "std_msgs/String": "string data",
}
Field = tuple[str, str, int | None]


def parse_definition(text: str, package: str = "") -> dict[str, list[Field]]:
    """Fields (name, type, array length: None for none, 0 for any) of a definition, '' for itself, and those it holds after ===."""
    out: dict[str, list[Field]] = {}
    name = ""
    for part in re.split(r"^=+$", text, flags=re.M):
        fields: list[Field] = []
        for line in part.splitlines():
            line = line.split("#")[0].strip()
            if m := re.match(r"MSG:\s*(\S+)", line):
                name = m[1].replace("/msg/", "/")
            elif (m := re.match(r"([\w/]+)(?:<=\d+)?(\[(?:<=)?(\d*)\])?\s+(\w+)(\s*=.*|\s+\S.*)?$", line)) and not (m[5] or "").lstrip().startswith("="):
                kind = m[1].replace("/msg/", "/")
                kind = "std_msgs/Header" if kind == "Header" else kind
                if kind not in PRIMITIVES and kind not in ("string", "wstring") and "/" not in kind and package:
                    kind = f"{package}/{kind}"
                fields.append((m[4], kind, None if not m[2] else int(m[3]) if m[3] and "<=" not in m[2] else 0))
        out[name] = fields
    return out


class Types:
    """All definitions that messages of one type need."""

    def __init__(self, root: str, text: str):
        self.known = {k: parse_definition(v, k.split("/")[0])[""] for k, v in BUILT_IN.items()}
        found = parse_definition(text, root.split("/")[0])
        self.root = found.pop("")
        self.known |= found

    def struct_of(self, fields: list[Field]) -> T.StructType:
        def one(kind: str) -> T.DataType:
            return PRIMITIVES[kind][1] if kind in PRIMITIVES else T.StringType() if kind in ("string", "wstring") else self.struct_of(self.known[kind])

        return T.StructType([T.StructField(n, one(k) if size is None else T.ArrayType(one(k))) for n, k, size in fields])

    @property
    def schema(self) -> T.StructType:
        return self.struct_of(self.root)

    def decode(self, data: bytes) -> dict:
        """The message in a CDR payload: four bytes of header, then values aligned to their size."""
        order = "<" if data[1] & 1 else ">"
        at = 4

        def primitive(code: str, n: int = 1) -> list:
            nonlocal at
            size = struct.calcsize(code)
            at += -(at - 4) % size
            values = struct.unpack_from(f"{order}{n}{code}", data, at)
            at += n * size
            return list(values)

        def value(kind: str) -> object:
            nonlocal at
            if kind in PRIMITIVES:
                return primitive(PRIMITIVES[kind][0])[0]
            if kind in ("string", "wstring"):
                n = primitive("I")[0]
                raw = data[at : at + n]
                at += n
                return raw.rstrip(b"\0").decode("utf-8", "replace")
            return message(self.known[kind])

        def message(fields: list[Field]) -> dict:
            out = {}
            for name, kind, size in fields:
                if size is None:
                    out[name] = value(kind)
                else:
                    n = size or primitive("I")[0]
                    out[name] = (primitive(PRIMITIVES[kind][0], n) if n else []) if kind in PRIMITIVES else [value(kind) for _ in range(n)]
            return out

        return message(self.root)


def decode_payloads(df: DataFrame, msg_type: str, definition: str) -> DataFrame:
    """The rows of one message type with column `msg`, a struct, for their payload. Other types must be filtered out before."""
    types = Types(msg_type.replace("/msg/", "/"), definition)
    keep = [f for f in df.schema.fields if f.name != "payload"]
    schema = T.StructType([*keep, T.StructField("msg", types.schema)])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = p[[f.name for f in keep]].copy()
            out["msg"] = [types.decode(bytes(x)) for x in p["payload"]]
            yield out

    return df.mapInPandas(run, schema)
