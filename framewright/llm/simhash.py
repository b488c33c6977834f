"""SimHash near-dedup with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. The perfect Golay code (23, 12, 7)
has exactly one codeword within three bits of any 23-bit word, so a segment decodes to a 12-bit
codeword index; flipping one bit first yields its other near codewords, at most six in all.
Of four errors over three segments, some two segments hold at most two together (pigeonhole). Then
a point lies within one flip of both fingerprints' pair of segments, and they share a key: a pair
of indices in which one segment is decoded as it is and the other within a flip. About 29 keys a
distinct fingerprint; those with a key in common are verified on all 64 bits, bucket by bucket,
each bucket giving a spanning set of links and no more.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.llm.common import checkpointed
from framewright.llm.components import components

SEED, SHINGLE, BITS = 42, 4, 4
SEGMENTS = ((0, 23), (23, 23), (46, 18))
PAIRS = ((0, 1), (0, 2), (1, 2))
GENERATOR = 0b110001110101
#: A bucket of more distinct fingerprints is split into pairs of blocks of about so many.
BUCKET = 20_000
KEYS = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("fp", T.LongType())])
LINKS = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType()), T.StructField("bucket", T.LongType())])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a whole text, unsigned; zero for null texts and those without words."""
    import xxhash

    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    data, size = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    k = min(shingle, len(words))
    of = xxhash.xxh64_intdigest
    total, n = np.zeros(64, np.int64), len(words) - k + 1
    starts, ends = starts[:n].tolist(), ends[k - 1 :].tolist()
    for i in range(0, n, 1 << 15):
        h = np.array([of(data[s:e], SEED) for s, e in zip(starts[i : i + (1 << 15)], ends[i : i + (1 << 15)], strict=True)], np.uint64)
        total += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(key, fp) of every row, fp a signed long."""
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], schema.names)

    return df.select(key, text).mapInArrow(run, schema)


@lru_cache(maxsize=1)
def golay() -> np.ndarray:
    """The codeword index of every 23-bit word."""
    words = np.arange(1 << 23, dtype=np.uint32)
    rest = words.copy()
    for k in range(22, 10, -1):
        rest ^= np.where((rest >> np.uint32(k)) & 1, np.uint32(GENERATOR << (k - 11)), np.uint32(0))
    error = np.zeros(1 << 11, np.uint32)
    flips = [1 << k for k in range(23)]
    for a in [0, *flips]:
        for b in [0, *flips]:
            for c in [0, *flips]:
                e = a | b | c
                error[rest[e]] = e
    return ((words ^ error[rest]) >> np.uint32(11)).astype(np.int16)


def near_indices(segment: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each word's codeword index, and (rows, 6) with those a flip away, -1 where there are fewer."""
    code = golay()
    own = code[segment]
    all_ = np.stack([own, *(code[segment ^ (1 << k)] for k in range(width))], 1)
    all_.sort(axis=1)
    fresh = np.ones(all_.shape, bool)
    fresh[:, 1:] = all_[:, 1:] != all_[:, :-1]
    fresh &= all_ != own[:, None]
    place = np.cumsum(fresh, 1) - 1
    out = np.full((len(segment), 6), -1, np.int64)
    r, c = np.nonzero(fresh)
    out[r, place[r, c]] = all_[r, c]
    return own.astype(np.int64), out


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in fp, key) of all keys: 2 bits for the pair of segments and 12 for either index."""
    seg = [near_indices(((fp >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64), w) for s, w in SEGMENTS]
    rows, keys = [], []
    at = np.arange(len(fp))
    for p, (a, b) in enumerate(PAIRS):
        (own_a, more_a), (own_b, more_b) = seg[a], seg[b]
        rows.append(at)
        keys.append((p << 24) | (own_a << 12) | own_b)
        for k in range(6):
            for left, right, more in ((more_a[:, k], own_b, more_a[:, k]), (own_a, more_b[:, k], more_b[:, k])):
                ok = more >= 0
                rows.append(at[ok])
                keys.append((p << 24) | (left[ok] << 12) | right[ok])
    return np.concatenate(rows), np.concatenate(keys)


def spanning_links(bucket: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect, in each bucket, what its pairs within `bits` connect. Sorted by bucket."""
    same = bucket[1:] == bucket[:-1]
    keep = np.r_[False, same] | np.r_[same, False]
    bucket, fp = bucket[keep], fp[keep]
    label = np.arange(len(fp))
    us, vs = [], []
    at, step = np.arange(len(fp)), 1
    while True:
        at = at[at + step < len(fp)]
        at = at[bucket[at] == bucket[at + step]]
        if not len(at):
            break
        hit = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= bits]
        hit = hit[label[hit] != label[hit + step]]
        if len(hit):
            us.append(fp[hit])
            vs.append(fp[hit + step])
            while True:  # hook the larger label to the smaller one until all agree
                a, b = label[hit], label[hit + step]
                if (a == b).all():
                    break
                np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
                while not np.array_equal(low := label[label], label):
                    label = low
        step += 1
    none = np.array([], np.uint64)
    return (np.concatenate(us), np.concatenate(vs)) if us else (none, none)


def _verify(bits: int, limit: int):
    """Streams rows sorted by bucket; a bucket beyond `limit` is handed on as rows (fp, fp, bucket)."""

    def out(u: np.ndarray, v: np.ndarray, bucket: np.ndarray | None = None) -> pa.RecordBatch:
        marks = pa.nulls(len(u), pa.int64()) if bucket is None else pa.array(bucket)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64)), marks], LINKS.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_fp, over = np.array([], np.int64), np.array([], np.uint64), None
        for b in batches:
            bucket = np.concatenate([held, b.column(0).to_numpy()])
            fp = np.concatenate([held_fp, b.column(1).to_numpy().view(np.uint64)])
            if over is not None and len(bucket):
                k = np.searchsorted(bucket, over, "right")
                if k:
                    yield out(fp[:k], fp[:k], bucket[:k])
                bucket, fp = bucket[k:], fp[k:]
                over = over if not len(bucket) else None
            if not len(bucket):
                held, held_fp = bucket, fp
                continue
            k = np.searchsorted(bucket, bucket[-1], "left")
            if k:
                yield from done(bucket[:k], fp[:k])
            held, held_fp = bucket[k:], fp[k:]
            if limit and len(held) > limit:
                over = held[0]
                yield out(held_fp, held_fp, held)
                held, held_fp = held[:0], held_fp[:0]
        if len(held):
            yield from done(held, held_fp)

    def done(bucket: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        if limit:
            starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            big = np.repeat(np.diff(np.r_[starts, len(bucket)]) > limit, np.diff(np.r_[starts, len(bucket)]))
            if big.any():
                yield out(fp[big], fp[big], bucket[big])
                bucket, fp = bucket[~big], fp[~big]
        u, v = spanning_links(bucket, fp, bits)
        if len(u):
            yield out(u, v)

    return run


def links(distinct: DataFrame, bits: int = BITS, limit: int = BUCKET) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints `fp` at most `bits` (up to four) bits apart.

    Buckets are streamed from sorted partitions. One of more than `limit` fingerprints is split into
    blocks, and each pair of blocks becomes a bucket of its own, so no task holds more than two."""
    if not 0 <= bits <= 4:
        raise ValueError("two segments hold at most two of four errors; more bits need other segments")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy()
            for i in range(0, len(fp), 20_000):
                part = fp[i : i + 20_000]
                rows, keys = keys_of(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], KEYS.names)

    keyed = distinct.select("fp").mapInArrow(emit, KEYS)
    first = checkpointed(keyed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_verify(bits, limit), LINKS))
    found, over = first.where("bucket IS NULL").select("u", "v"), first.where("bucket IS NOT NULL").select("bucket", F.col("u").alias("fp"))
    blocks = over.groupBy("bucket").agg(F.ceil(F.count("*") / limit).cast("int").alias("blocks"))
    mine = over.join(blocks, "bucket").withColumn("g", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    spread = mine.withColumn("h", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = spread.select(F.xxhash64("bucket", F.least("g", "h"), F.greatest("g", "h")).alias("bucket"), "fp")
    rest = pairs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_verify(bits, 0), LINKS)
    return found.unionByName(rest.select("u", "v"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """(key, fingerprint, component_id) of every row; component_id is the least key reachable.

    Texts are read once; then only fingerprints move, one row a distinct fingerprint. Null texts,
    empty ones and those without words share fingerprint zero and are linked like any others.
    Repeated rows stay; null keys are kept and only count where a component has no other key."""
    fps = checkpointed(fingerprints(df, key, text, shingle))
    classes = fps.groupBy("fp").agg(F.min(key).alias("least"))
    labels = components(links(classes, bits)).withColumnRenamed("node", "fp")
    classes = classes.join(labels, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = classes.join(least, "component").select("fp", "component_id")
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return fps.join(named, "fp").select(key, shown, "component_id")
