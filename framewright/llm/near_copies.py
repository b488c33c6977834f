"""All near copies by true similarity: a Jaccard index of the sets of five-word shingles of at least 4/5.

At that similarity some ten of 64 fingerprint bits differ, beyond what Golay keys reach. So SimHash
links only come first: verified, they join the dense groups. What they miss is found by a prefix
filter, which misses no pair: with all sets in one order, two of that similarity share one of their
first n - ceil(4n / 5) + 1 shingles. Shingles that are common in a sample come last in the order
(any order is right), so shared boilerplate makes no hot keys. Every candidate is verified on whole
sets. Shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.llm import simhash
from framewright.llm.common import checkpointed, key_filter, split_by
from framewright.llm.components import components

SHINGLE = 5
#: Documents sampled for common shingles, about; how many of these are ordered last at most.
SAMPLE, COMMON = 2000, 100_000
LINKS = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the different shingles of a text, sorted; one of all its words where they are fewer."""
    import xxhash

    words = text.encode().lower().split() if text else []
    if not words:
        return np.array([], np.uint64)
    data, size = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    k = min(shingle, len(words))
    starts, ends = (ends - size)[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    of = xxhash.xxh64_intdigest
    return np.unique(np.array([of(data[s:e], simhash.SEED) for s, e in zip(starts, ends, strict=True)], np.uint64))


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of a set, one number; zero of an empty one."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        total += np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)


def prefix(hashes: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set, one of which any set of similarity 4/5 has among its own first."""
    n = len(hashes)
    if not n:
        return hashes
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        hashes = hashes[np.lexsort((hashes, np.where(common[at] == hashes, counts[at], 0)))]
    return hashes[: n - (4 * n + 4) // 5 + 1]


def common_shingles(docs: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes, with counts, of the most common shingles of a sample of documents."""
    share = max(1, docs.count() // SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, n = np.unique(np.concatenate([shingles(t) for t in b.column(0).to_pylist()] or [np.array([], np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    sample = docs.where(F.pmod(F.xxhash64(text), F.lit(share)) == 0).select(text)
    counts = sample.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    top = sorted((r.h % (1 << 64), r.n) for r in counts.orderBy(F.desc("n"), "h").limit(COMMON).collect())
    return np.array([h for h, _ in top], np.uint64), np.array([n for _, n in top], np.int64)


def sketches(docs: DataFrame, row: str, key: str, text: str) -> DataFrame:
    """(row, key, set, fp, n, prefix) of every row: the set's hash, SimHash and size, and half the hash of its first shingles.

    Shingles that agree in that half alone can only add candidates."""
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, text))
    long = T.LongType()
    schema = T.StructType([T.StructField(row, long), T.StructField(key, docs.schema[key].dataType), *(T.StructField(c, long) for c in ("set", "fp", "n")), T.StructField("prefix", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            found, fps, firsts = [], [], []
            for t in b.column(2).to_pylist():
                h = shingles(t)
                found.append((xxhash.xxh64_intdigest(h.tobytes(), simhash.SEED), len(h)))
                fps.append(fingerprint(h))
                firsts.append(prefix(h, *shared.value))
            none = [np.array([], np.uint64)]
            sets = np.array([s for s, _ in found], np.uint64).view(np.int64)
            offsets = np.cumsum([0, *map(len, firsts)])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(none + firsts).astype(np.uint32).view(np.int32)))
            fp = np.concatenate(none + fps).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sets), pa.array(fp), pa.array([n for _, n in found], pa.int64()), lists], schema.names)

    return docs.select(row, key, text).mapInArrow(run, schema)


def parities(hashes: np.ndarray) -> bytes:
    """For each of 2n bits or more, whether an odd number of hashes fall there: about a 32nd of the set's size."""
    m = 1 << max(6, (2 * len(hashes) - 1).bit_length())
    return np.packbits(np.bincount((hashes & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1, bitorder="little").tobytes()


def apart(x: bytes, y: bytes) -> int:
    """A number of elements that are in just one of two sets, by their parities: never more than there are."""
    a, b = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def verified(pairs: DataFrame, rows: DataFrame, docs: DataFrame, row: str, text: str) -> DataFrame:
    """The pairs (u, v) of sets that are similar. rows: (row, set), one row a set; its text is read again.

    Parities first rule out most pairs; whole sets are only joined to what they leave."""
    pairs = checkpointed(pairs.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())

    def of_sets(pairs: DataFrame, kept: Callable[[np.ndarray], bytes]) -> DataFrame:
        """pairs with nu, nv, hu and hv: size and what `kept` makes of either set."""
        named = pairs.select(F.col("u").alias("set")).union(pairs.select("v")).distinct()
        wanted = checkpointed(rows.select(row, "set").join(named, "set").distinct())
        texts = split_by(docs.select(row, text), row, key_filter(wanted, row))[0].join(wanted, row).select("set", text)

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sets = [shingles(t) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(h) for h in sets], pa.int64()), pa.array([kept(h) for h in sets], pa.binary())], ["set", "n", "h"])

        found = checkpointed(texts.mapInArrow(read, "set long, n long, h binary"))
        return pairs.join(found.selectExpr("set AS u", "n AS nu", "h AS hu"), "u").join(found.selectExpr("set AS v", "n AS nv", "h AS hv"), "v").select("u", "v", "nu", "nv", "hu", "hv")

    def filtered(similar: Callable[[int, int, bytes, bytes], bool]) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ok = [similar(*x) for x in zip(*(c.to_pylist() for c in b.columns[2:]), strict=True)]
                b = b.filter(pa.array(ok, pa.bool_()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], LINKS.names)

        return run

    # n + m - 2c differ, c in common: at a similarity of 4/5 or more, (n + m) / 9 at most
    near = of_sets(pairs, parities).mapInArrow(filtered(lambda n, m, x, y: 9 * apart(x, y) <= n + m), LINKS)
    common = lambda x, y: len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
    whole = of_sets(checkpointed(near), np.ndarray.tobytes)
    return checkpointed(whole.mapInArrow(filtered(lambda n, m, x, y: 9 * common(x, y) >= 4 * (n + m)), LINKS))


def candidates(distinct: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (u, v) of sets that share a first shingle and may be similar, but for those in one known component."""
    keys = distinct.join(known.selectExpr("node AS set", "component"), "set", "left")
    keys = keys.select("set", "component", F.col("n").cast("int").alias("n"), F.explode("prefix").alias("key"))
    a, b = (keys.select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("set", "component", "n"))) for x in "ab")
    fit = F.expr("set_a < set_b AND 5L * least(n_a, n_b) >= 4L * greatest(n_a, n_b)")
    apart = F.expr("component_a IS NULL OR component_b IS NULL OR component_a <> component_b")
    shared = a.join(b, (a.key == b.key) & fit & apart).groupBy("set_a", "set_b", "n_a", "n_b").agg(F.count("*").alias("c"))
    # beyond the first shingles that both have, only what follows either prefix, ceil(4n / 5) - 1, can be in common
    return shared.where("9L * (c + (4L * greatest(n_a, n_b) + 4) div 5 - 1) >= 4L * (n_a + n_b)").selectExpr("set_a AS u", "set_b AS v")


def near_copies(docs: DataFrame, row: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, key, component) of every row; texts without words, null ones too, count as copies of each other.

    `row` is a long that only equal rows share. Texts are read once, and those of candidates twice more."""
    found = checkpointed(sketches(docs, row, key, text))
    copies = found.groupBy("set").agg(F.count("*").alias("__n"), F.min(row).alias("__least")).where("__n > 1")
    distinct = found.join(copies, "set", "left").where(f"__least IS NULL OR __least = `{row}`").select(*found.columns)
    rows = distinct.select(row, "set", "fp")
    classes = checkpointed(rows.groupBy("fp").agg(F.min("set").alias("least")))
    least = lambda c: classes.select(F.col("fp").alias(c), F.col("least").alias(f"set_{c}"))
    far = simhash.links(classes).join(least("u"), "u").join(least("v"), "v").selectExpr("set_u AS u", "set_v AS v")
    first = verified(far.union(rows.join(classes, "fp").select("set", "least")), rows, docs, row, text)
    second = verified(candidates(distinct, components(first)), rows, docs, row, text)
    labels = components(first.union(second)).withColumnRenamed("node", "set")
    return found.join(labels, "set", "left").select(row, key, F.coalesce("component", "set").alias("component"))


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns, nulls told apart from what is missing elsewhere."""
    return F.xxhash64(*(F.col(c) for c in df.columns), *(F.col(c).isNull() for c in df.columns))
