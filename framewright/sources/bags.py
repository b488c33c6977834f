"""Recorded bags as a Spark data source: one partition a bag, topics picked by the file's index.

    read_bags(spark, folder, topics=["/joint_states"])

Reads SQLite bags (.db3) and MCAP files whose chunks are plain, zstd or lz4. `payload=false` leaves the
message bytes out, for timestamp scans."""

from __future__ import annotations

import heapq
import json
import os
import sqlite3
import struct
from collections.abc import Collection, Iterable, Iterator
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "bag_path string, episode_index long, seq long, topic string, msg_type string, recv_ns long, payload binary"
SUFFIXES = (".db3", ".mcap")


def bag_files(path: str) -> list[str]:
    """The recording files of a bag: itself, or those of its folder, in order of name."""
    if os.path.isfile(path):
        return [path] if path.endswith(SUFFIXES) else bag_files(os.path.dirname(path)) if os.path.basename(path) == "metadata.yaml" else []
    if not os.path.isdir(path):
        return []
    return [os.path.join(path, f) for f in sorted(os.listdir(path)) if f.endswith(SUFFIXES)]


def discover(path: str) -> list[str]:
    """The path itself if it is a bag, else the bags among its sub-folders, in order of name: the order of episodes."""
    if bag_files(path):
        return [path]
    found = [d for d in (os.path.join(path, n) for n in sorted(os.listdir(path))) if os.path.isdir(d) and bag_files(d)] if os.path.isdir(path) else []
    if not found:
        raise FileNotFoundError(f"no bag in {path}")
    return found


def read_db3(path: str, topics: set[str] | None, payload: bool) -> Iterator[tuple[str, str, int, bytes | None]]:
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        known = {i: (n, t) for i, n, t in db.execute("SELECT id, name, type FROM topics") if topics is None or n in topics}
        marks = ",".join("?" * len(known))
        body = "data" if payload else "NULL"
        for i, ts, data in db.execute(f"SELECT topic_id, timestamp, {body} FROM messages WHERE topic_id IN ({marks}) ORDER BY timestamp, id", list(known)):  # noqa: S608
            yield (*known[i], ts, data)


def _string(data: bytes, at: int) -> tuple[str, int]:
    n = struct.unpack_from("<I", data, at)[0]
    return data[at + 4 : at + 4 + n].decode(), at + 4 + n


def _records(data: bytes, at: int) -> Iterator[tuple[int, bytes]]:
    while at + 9 <= len(data):
        op, size = struct.unpack_from("<BQ", data, at)
        yield op, data[at + 9 : at + 9 + size]
        at += 9 + size


MAGIC = b"\x89MCAP0\r\n"


def _chunk(record: bytes) -> bytes:
    """The records in a chunk."""
    size = struct.unpack_from("<Q", record, 16)[0]
    how, at = _string(record, 28)
    body = record[at + 8 : at + 8 + struct.unpack_from("<Q", record, at)[0]]
    if how == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompress(body, max_output_size=size)
    if how == "lz4":
        import pyarrow as pa

        with pa.CompressedInputStream(pa.BufferReader(body), "lz4") as f:
            return f.read()
    if how:
        raise ValueError(f"chunk compression {how!r} can't be read here")
    return body


def _chunk_index(f: BinaryIO) -> tuple[list[tuple[int, bytes]], list[tuple[int, int, int, set[int]]]] | None:
    """The schemas and channels of a file's summary, and (start, end, place, channels) of each chunk; None without a summary."""
    f.seek(0, os.SEEK_END)
    size = f.tell()
    if size < 45:
        return None
    f.seek(size - 37)
    op, _, at = struct.unpack("<BQQ", f.read(17))
    f.seek(size - 8)
    if op != 2 or not at or f.read(8) != MAGIC:
        return None
    f.seek(at)
    summary = list(_records(f.read(size - 37 - at), 0))
    chunks = []
    for op, r in summary:
        if op == 8:
            start, end, place = struct.unpack_from("<QQQ", r)
            n = struct.unpack_from("<I", r, 32)[0]
            chunks.append((start, end, place, {struct.unpack_from("<H", r, 36 + k)[0] for k in range(0, n, 10)}))
    return ([x for x in summary if x[0] in (3, 4)], sorted(chunks)) if chunks else None


def read_mcap(path: str, topics: set[str] | None, payload: bool) -> Iterator[tuple[str, str, int, bytes | None]]:
    """Messages in order of time. With a chunk index only chunks that hold wanted topics are read, and no more
    are held than overlap in time; without one all wanted messages are held to be sorted."""
    schemas: dict[int, str] = {}
    channels: dict[int, tuple[str, str]] = {}

    def walk(records: Iterable[tuple[int, bytes]]) -> Iterator[tuple[str, str, int, bytes | None]]:
        for op, r in records:
            if op == 3:
                schemas[struct.unpack_from("<H", r)[0]] = _string(r, 2)[0]
            elif op == 4:
                channel, schema = struct.unpack_from("<HH", r)
                channels[channel] = (_string(r, 4)[0], schemas.get(schema, ""))
            elif op == 5:
                channel, _, log = struct.unpack_from("<HIQ", r)
                if channel in channels and (topics is None or channels[channel][0] in topics):
                    yield (*channels[channel], log, r[22:] if payload else None)
            elif op == 6:
                yield from walk(_records(_chunk(r), 0))

    with open(path, "rb") as f:
        if f.read(8) != MAGIC:
            raise ValueError(f"{path} is no MCAP file")
        indexed = _chunk_index(f)
        if indexed is None:
            f.seek(8)
            yield from sorted(walk(_from_file(f)), key=lambda x: x[2])
            return
        list(walk(indexed[0]))
        held: list[tuple[int, int, tuple]] = []
        n = 0
        for start, _, place, inside in indexed[1]:
            if topics is not None and inside and not any(channels.get(c, ("",))[0] in topics for c in inside):
                continue
            while held and held[0][0] < start:  # no later chunk has anything before its own start
                yield heapq.heappop(held)[2]
            f.seek(place)
            _, size = struct.unpack("<BQ", f.read(9))
            for m in walk(_records(_chunk(f.read(size)), 0)):
                heapq.heappush(held, (m[2], n, m))
                n += 1
        while held:
            yield heapq.heappop(held)[2]


def _from_file(f: BinaryIO) -> Iterator[tuple[int, bytes]]:
    """The records of a file, one at a time."""
    while len(head := f.read(9)) == 9:
        op, size = struct.unpack("<BQ", head)
        yield op, f.read(size)


class BagPartition(InputPartition):
    def __init__(self, path: str, episode: int):
        self.path, self.episode = path, episode


class BagReader(DataSourceReader):
    def __init__(self, options: dict):
        self.bags = discover(options["path"])
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.topics = set(json.loads(options["topics"])) if options.get("topics") else None

    def partitions(self) -> list[BagPartition]:
        return [BagPartition(b, k) for k, b in enumerate(self.bags)]

    def read(self, partition: BagPartition) -> Iterator[tuple]:
        seq = 0
        for path in bag_files(partition.path):
            for topic, kind, ts, data in (read_db3 if path.endswith(".db3") else read_mcap)(path, self.topics, self.payload):
                yield (partition.path, partition.episode, seq, topic, kind, ts, data)
                seq += 1


class BagSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bag"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BagReader:  # noqa: ANN001
        return BagReader(self.options)


def read_bags(spark: SparkSession, path: str, payload: bool = True, topics: Collection[str] | None = None) -> DataFrame:
    """The messages of the bags in a folder, of some topics or of all; topics are picked by the files' own index.

    They are an option and no pushed filter: scans of one plan share a reader, so that one branch's
    filter would also cut another's rows."""
    spark.dataSource.register(BagSource)
    reader = spark.read.format("bag").option("path", path).option("payload", str(payload).lower())
    return (reader.option("topics", json.dumps(sorted(topics))) if topics is not None else reader).load()
