"""Suffix-array dedup: maximal repeats from a common-prefix interval tree.

Any WIDTH bytes have an anchor: the least hash among the GRAM-byte grams within. Equal strings have
equal anchors, so only places that share an anchor's gram can repeat, and about one byte in eighty
is an anchor. An anchor's context holds all strings that have it as their anchor.

1. Contexts are told apart by hash. Ones that occur twice are wholly covered; a batch settles its own
   and sends one of them on, so copies by the thousand shrink before the shuffle.
2. Where an anchor has several different contexts, one of each is fetched from its text. Over those
   of an anchor an enhanced suffix array is built (suffixes in order and the lengths of the prefixes
   that neighbours have in common). A stack scan walks its tree of common-prefix intervals and keeps
   those of WIDTH or more bytes whose occurrences differ in the byte to their left: maximal repeats,
   each with all its occurrences.
3. Covered spans are joined to their texts and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.llm.common import checkpointed

WIDTH, GRAM = 200, 40
#: Bytes whose anchors are found together, and contexts of one anchor that are held together.
PIECE, HELD = 1 << 20, 20_000
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)

Anchor = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n - 1) modulo 2^64."""
    out = np.ones(n, np.uint64)
    size = 1
    while size < n:
        step = min(size, n - size)
        out[size : size + step] = out[:step] * np.uint64(pow(base, size, 1 << 64))
        size += step
    return out


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each gram."""
    n = len(data)
    size = 1 << max(10, (n - 1).bit_length())
    if size not in _TABLES:
        _TABLES.clear()
        _TABLES[size] = _powers(BASE, size), _powers(INVERSE, size)
    up, down = _TABLES[size]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = sums[gram:] - sums[: n - gram + 1]
    h *= down[: n - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def sliding_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """The place of the least of each w values in a row, the first of equal ones (by their upper 40 bits)."""
    n = len(h)
    key = (h & ~np.uint64((1 << 24) - 1)) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    rows = padded.reshape(-1, w)
    left = np.minimum.accumulate(rows, 1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return (np.minimum(right[: n - w + 1], left[w - 1 : n]) & np.uint64((1 << 24) - 1)).astype(np.int64)


def anchors(texts: list[bytes], width: int = WIDTH, gram: int = GRAM) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, place, first, last, hash) of each anchor: first and last start of the strings that it anchors."""
    k = 0
    while k < len(texts):
        part, size, first_text = [], 0, k
        while k < len(texts) and (not part or size + len(texts[k]) <= PIECE):
            part.append(texts[k])
            size += len(texts[k])
            k += 1
        if len(part) == 1 and size > PIECE:
            held = None  # a piece may go on with the anchor that the one before it ended with
            for at in range(0, size - width + 1, PIECE):
                for _, p, a, b, h in _anchors([part[0][at : at + PIECE + width - 1]], width, gram):
                    new = (first_text, p + at, a + at, b + at, h)
                    if held and held[1] == new[1]:
                        held = (*held[:3], new[3], h)
                    else:
                        if held:
                            yield held
                        held = new
            if held:
                yield held
        else:
            for i, *rest in _anchors(part, width, gram):
                yield (first_text + i, *rest)


def _anchors(texts: list[bytes], width: int, gram: int) -> Iterator[tuple[int, int, int, int, int]]:
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < width:
        return
    h = gram_hashes(data, gram)
    best = sliding_argmin(h, width - gram + 1)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(best)]
    valid = np.arange(len(best)) + width <= ends[owner]
    fresh = valid.copy()
    fresh[1:] &= ~valid[:-1] | (best[1:] != best[:-1]) | (owner[1:] != owner[:-1])
    last = valid.copy()
    last[:-1] &= ~valid[1:] | (best[1:] != best[:-1]) | (owner[1:] != owner[:-1])
    a, b = np.flatnonzero(fresh), np.flatnonzero(last)
    o, p = owner[a], best[a]
    start = (ends - sizes)[o]
    yield from zip(o.tolist(), (p - start).tolist(), (a - start).tolist(), (b - start).tolist(), h[p].tolist(), strict=True)


ROWS = T.StructType([T.StructField(n, t) for n, t in (("gram", T.LongType()), ("context", T.LongType()), ("doc", T.LongType()), ("row", T.LongType()), ("at", T.IntegerType()), ("first", T.IntegerType()), ("last", T.IntegerType()), ("n", T.IntegerType()))])


def _table(cols: list, schema: T.StructType) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[f.dataType.simpleString()]) for c, f in zip(cols, schema, strict=True)], schema.names)


def find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of (doc, row, text); n = 2: known to repeat. Rows with n = 0 are covered already (first to last)."""
    import xxhash

    signed = lambda v: v - (1 << 64) if v >> 63 else v
    for b in batches:
        doc, row, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), [t.encode() if t else b"" for t in b.column(2).to_pylist()]
        seen: dict[tuple[int, int], list] = {}
        out: list[tuple] = []
        for i, p, a, z, h in anchors(texts):
            c = xxhash.xxh64_intdigest(texts[i][a : z + WIDTH], p - a)
            mine = (signed(h), signed(c), doc[i], row[i], p, a, z, 1)
            if (old := seen.setdefault((h, c), mine)) is not mine:
                out.append((signed(c ^ row[i] & (2**64 - 1)), 0, doc[i], row[i], p, a, z, 0))
                if old[7] == 1:
                    seen[(h, c)] = (*old[:7], 2)
                    out.append((signed(c ^ old[3] & (2**64 - 1)), 0, *old[2:7], 0))
        out += seen.values()
        if out:
            yield _table(list(zip(*out, strict=True)), ROWS)


SETTLED = T.StructType([T.StructField(n, t) for n, t in (("request", T.IntegerType()), ("gram", T.LongType()), ("doc", T.LongType()), ("row", T.LongType()), ("at", T.IntegerType()), ("first", T.IntegerType()), ("last", T.IntegerType()))])


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by gram and context: spans of contexts that repeat (request 0), and one place of each
    context of a gram that has several (request 1). Holds two places, however many rows share a gram."""
    out: list[tuple] = []
    gram = context = rep = pending = None
    known = several = False

    def end_run() -> None:
        nonlocal pending, several
        if rep is None:
            return
        if several:
            out.append((1, *rep))
        elif pending is None:
            pending = rep
        else:
            out.extend([(1, *pending), (1, *rep)])
            several = True

    for b in batches:
        cols = [c.to_numpy() for c in b.columns]
        g, n = cols[0], cols[7]
        done = n == 0
        keep = ~done
        if done.any():
            yield _table([np.zeros(done.sum(), np.int32), g[done], *(c[done] for c in cols[2:7])], SETTLED)
        cols = [c[keep] for c in cols]
        g, n = cols[0], cols[7]
        if len(g) > 2:  # grams that occur once inside the batch need no second look
            alone = np.zeros(len(g), bool)
            alone[1:-1] = (g[1:-1] != g[:-2]) & (g[1:-1] != g[2:]) & (n[1:-1] == 1)
            cols = [c[~alone] for c in cols]
        for h, c, doc, row, at, first, last, n in zip(*(c.tolist() for c in cols), strict=True):
            if h != gram or c != context:
                end_run()
                if h != gram:
                    gram, pending, several = h, None, False
                context, rep, known, single = c, (h, doc, row, at, first, last), n > 1, n == 1
                continue
            if not known:
                known = True
                if single:
                    out.append((0, *rep))
            if n == 1:
                out.append((0, h, doc, row, at, first, last))
        if out:
            yield _table(list(zip(*out, strict=True)), SETTLED)
            out.clear()
    end_run()
    if out:
        yield _table(list(zip(*out, strict=True)), SETTLED)


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(prefix, first, last) of every interval of the common-prefix tree; lcp[k] is that of suffixes k and k + 1."""
    stack: list[tuple[int, int]] = []
    for k, v in enumerate([*lcp, -1]):
        start = k
        while stack and stack[-1][0] > v:
            value, start = stack.pop()
            yield value, start, k
        if v >= 0 and (not stack or stack[-1][0] < v):
            stack.append((v, start))


def maximal_repeats(rights: list[bytes], lefts: list[bytes], width: int) -> Iterator[tuple[int, int, list[int]]]:
    """(left, right, places) of the maximal repeats of `width` bytes or more around an anchor.

    rights: the text from each place on; lefts: the text before it, reversed. Every interval of the
    right parts' tree can't grow to the right; over its places a second tree, of the left parts,
    has the left extensions: each of its intervals is preceded by different bytes (or an end)."""
    order = sorted(range(len(rights)), key=rights.__getitem__)
    lcp = [common(rights[a], rights[b]) for a, b in zip(order, order[1:], strict=False)]
    left_rank = {k: r for r, k in enumerate(sorted(range(len(lefts)), key=lefts.__getitem__))}
    for right, i, j in intervals(lcp):
        need = max(0, width - right)
        places = sorted((k for k in order[i : j + 1] if len(lefts[k]) >= need), key=left_rank.__getitem__)
        if len(places) < 2:
            continue
        for left, a, b in intervals([common(lefts[x], lefts[y]) for x, y in zip(places, places[1:], strict=False)]):
            if left >= need:
                yield left, right, places[a : b + 1]


PLACES = T.StructType([*SETTLED.fields[1:], T.StructField("context", T.BinaryType())])
SPANS = T.StructType([T.StructField(n, t) for n, t in (("doc", T.LongType()), ("row", T.LongType()), ("first", T.IntegerType()), ("end", T.IntegerType()), ("window", T.LongType()))])


def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by gram: the spans of their maximal repeats. Of a gram with more than HELD contexts
    the strings of WIDTH bytes are handed on by hash (window), to be counted in a shuffle of their own."""
    import xxhash

    held: list[tuple] = []
    out: list[tuple] = []
    over = None

    def windows(rows: list[tuple]) -> None:
        for h, doc, row, at, first, last, context in rows:
            for s in range(first, last + 1):
                w = xxhash.xxh64_intdigest(context[s - first : s - first + WIDTH], (at - s) & 0xFFFF)
                out.append((doc, row, s, s + WIDTH, w - (1 << 64) if w >> 63 else w))

    def close() -> None:
        if len(held) < 2:
            return
        rights, lefts = [x[6][x[3] - x[4] :] for x in held], [x[6][: x[3] - x[4]][::-1] for x in held]
        best: dict[tuple[int, int], int] = {}
        for left, right, places in maximal_repeats(rights, lefts, WIDTH):
            for k in places:
                if best.get((k, right), -1) < left:
                    best[k, right] = left
        for (k, right), left in best.items():
            _, doc, row, at, *_ = held[k]
            out.append((doc, row, at - left, at + right, None))

    for b in batches:
        for x in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if x[0] == over:
                windows([x])
                continue
            if held and x[0] != held[0][0]:
                close()
                held.clear()
            held.append(x)
            if len(held) > HELD:
                over = x[0]
                windows(held)
                held.clear()
        if out:
            yield _table(list(zip(*out, strict=True)), SPANS)
            out.clear()
    close()
    if out:
        yield _table(list(zip(*out, strict=True)), SPANS)


def twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by window: those without one, and those whose window comes more than once."""
    held: tuple | None = None
    for b in batches:
        window = b.column(4)
        free = window.is_null()
        yield b.filter(free)
        out: list[tuple] = []
        for x in zip(*(c.to_pylist() for c in b.filter(window.is_valid()).columns), strict=True):
            if held is not None and held[4] == x[4]:
                if held[3] >= 0:
                    out.append(held)
                out.append(x)
                held = (*x[:3], -1, x[4])  # it is out already
            else:
                held = x
        if out:
            yield _table(list(zip(*out, strict=True)), SPANS)


def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, row, text, wanted) to the contexts wanted."""
    for b in batches:
        out = []
        for doc, row, text, wanted in zip(*(c.to_pylist() for c in b.columns), strict=True):
            raw = text.encode()
            out += [(w["gram"], doc, row, w["at"], w["first"], w["last"], raw[w["first"] : w["last"] + WIDTH]) for w in wanted]
        if out:
            yield _table(list(zip(*out, strict=True)), PLACES)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of what spans cover; touching ones are one run."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


CUT = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())]


def without_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", kept: str | None = None) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of every row, and the bytes kept if a name is given.

    Bytes go that lie in a string of WIDTH bytes which also starts elsewhere in any row. Null texts
    count as empty; equal rows repeat each other; null keys are kept. `key` is a long."""
    row = F.xxhash64(F.col(key), F.col(text))
    keyed = df.select(F.col(key).cast("long").alias("doc"), row.alias("row"), F.col(text).alias("text"))
    found = keyed.select("doc", "row", "text").mapInArrow(find_anchors, ROWS).repartition("gram").sortWithinPartitions("gram", "context").mapInArrow(settle, SETTLED)
    found = checkpointed(found)
    on = (F.col("row") == F.col("r")) & F.col("doc").eqNullSafe(F.col("d"))
    texts = keyed.repartition("row")  # both joins read this one shuffle of the texts
    wanted = found.where("request = 1").groupBy(F.col("doc").alias("d"), "row").agg(F.collect_list(F.struct("gram", "at", "first", "last")).alias("wanted"))
    places = texts.join(wanted.withColumnRenamed("row", "r"), on).select("doc", "row", F.coalesce("text", F.lit("")).alias("text"), "wanted").mapInArrow(fetch, PLACES)
    grown = places.repartition("gram").sortWithinPartitions("gram").mapInArrow(grow, SPANS)
    by = F.coalesce("window", F.xxhash64("row", "first"))
    counted = grown.repartition(by).sortWithinPartitions("window").mapInArrow(twice, SPANS)
    spans = found.where("request = 0").select("doc", "row", "first", (F.col("last") + WIDTH).alias("end")).unionByName(counted.drop("window"))
    lists = spans.groupBy(F.col("doc").alias("d"), "row").agg(F.collect_list(F.struct("first", "end")).alias("spans"))
    joined = texts.join(lists.withColumnRenamed("row", "r"), on, "left").select(F.col("doc").alias(key), "text", "spans")
    schema = T.StructType([T.StructField(key, T.LongType()), *CUT, *([T.StructField(kept, T.BinaryType())] if kept else [])])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, t, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = t.encode() if t else b""
                runs = merged([(x["first"], x["end"]) for x in s]) if s else []
                at, parts = 0, []
                for a, z in runs:
                    parts.append(raw[at:a])
                    at = z
                rest = b"".join([*parts, raw[at:]]) if runs else raw
                rows.append((doc, len(raw), len(raw) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), *([rest] if kept else [])))
            if rows:
                yield _table(list(zip(*rows, strict=True)), schema)

    return joined.mapInArrow(cut, schema)
