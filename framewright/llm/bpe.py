"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

The leaves of a tree hold rank and place of each adjacent pair, an inner node the least of its two
children, so the root is the leftmost pair of lowest rank. A merge changes three leaves (the merged
pair, its right half and the left neighbour) and their paths to the root: logarithmic point updates,
until the root says that nothing can be merged. The trees of many pre-tokens of like length lie in
one array and take their steps together.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from framewright.llm.common import uncollected

SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Runs of non-space with the space before it, or spaces: what the pre-tokenizer never joins.
CHUNKS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
INNER = f"'s|'t|'re|'ve|'m|'ll|'d| ?\\p{{L}}+| ?\\p{{N}}+| ?[^{SPACE}\\p{{L}}\\p{{N}}]+"
INF = np.int64(1) << 60
#: Cells of the trees that are merged together, and chunks whose ids a worker keeps.
CELLS, MEMO = 1 << 20, 150_000
#: Characters of the texts that are worked on together.
SOME = 6 << 20


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte, the other way round."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteBpe:
    """Encoder and decoder for a byte-level vocabulary file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.of_byte = np.zeros(256, np.int32)
        for c, b in letters.items():
            self.of_byte[b] = vocab[c]
        self.base = np.int64(len(vocab) + 1)
        ranks: dict[int, int] = {}
        for r, (a, b) in enumerate(merges):
            ranks.setdefault(vocab[a] * int(self.base) + vocab[b], r)
        keys = sorted(ranks)
        self.keys = np.array(keys + [np.iinfo(np.int64).max], np.int64)
        self.ranks = np.array([ranks[k] for k in keys] + [0], np.int64)
        self.into = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.stops = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.inner = regex.compile(INNER)
        self.memo: dict[str, tuple[str, bytes]] = {}

    def _rank(self, a: np.ndarray, b: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
        key = a.astype(np.int64) * self.base + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at] * width + place, INF)

    def _merge(self, words: list[bytes], width: int) -> list[list[int]]:
        """The ids of words of at most `width` bytes; width is a power of two."""
        count = len(words)
        sizes = np.fromiter(map(len, words), np.int64, count)
        cells = np.arange(width)
        inside = cells < sizes[:, None]
        sym = np.zeros((count, width), np.int32)
        sym[inside] = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        tree = np.full((count, 2 * width), INF)
        pair = np.nonzero(cells < sizes[:, None] - 1)
        tree[pair[0], width + pair[1]] = self._rank(sym[pair], sym[pair[0], pair[1] + 1], pair[1], width)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        after = np.tile(cells + 1, (count, 1)).ravel()
        before = np.tile(cells - 1, (count, 1)).ravel()
        alive = inside.copy().ravel()
        sym, tree = sym.ravel(), tree.ravel()
        rows = np.arange(count)
        while True:
            root = tree[rows * (2 * width) + 1]
            more = root < INF
            if not more.any():
                break
            rows, root = rows[more], root[more]
            at, rank = root % width, root // width
            cell, node = rows * width, rows * (2 * width)
            right = after[cell + at]
            nxt, prv = after[cell + right], before[cell + at]
            sym[cell + at] = self.into[rank]
            alive[cell + right] = False
            after[cell + at] = nxt
            ended = nxt >= sizes[rows]
            safe = np.where(ended, at, nxt)
            back = ~ended
            before[(cell + nxt)[back]] = at[back]
            tree[node + width + right] = INF
            tree[node + width + at] = np.where(ended, INF, self._rank(sym[cell + at], sym[cell + safe], at, width))
            has = prv >= 0
            prv = np.where(has, prv, at)
            tree[(node + width + prv)[has]] = self._rank(sym[cell + prv], sym[cell + at], prv, width)[has]
            paths = [width + right, width + at, width + prv]
            for _ in range(width.bit_length() - 1):
                paths = [p >> 1 for p in paths]
                for p in paths:
                    tree[node + p] = np.minimum(tree[node + 2 * p], tree[node + 2 * p + 1])
        sym, alive = sym.reshape(count, width), alive.reshape(count, width)
        flat, ends = sym[alive].tolist(), np.cumsum(alive.sum(1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each pre-token."""
        by: dict[int, list[int]] = defaultdict(list)
        for k, w in enumerate(words):
            by[max(2, 1 << (len(w) - 1).bit_length())].append(k)
        out: list[list[int]] = [[]] * len(words)
        for width, ks in by.items():
            step = max(1, CELLS // (4 * width))
            for i in range(0, len(ks), step):
                part = ks[i : i + step]
                for k, ids in zip(part, self._merge([words[k] for k in part], width), strict=True):
                    out[k] = ids
        return out

    def _pretokens(self, chunk: str) -> list[str]:
        word = chunk[1:] if chunk[0] == " " else chunk
        if word.isalpha():
            return [chunk]
        return self.inner.findall(chunk) if CHUNKS.fullmatch(chunk) and word and not word.isspace() else [chunk]

    def _chunks(self, text: str) -> list[str]:
        if self.stops is None or not any(s in text for s in self.special):
            return CHUNKS.findall(text)
        out: list[str] = []
        for k, part in enumerate(self.stops.split(text)):
            out += [part] if k % 2 else CHUNKS.findall(part)
        return out

    def _known(self, texts: list[list[str]]) -> dict[str, list[int]]:
        new = set().union(*texts) if texts else set()
        pre = {c: self._pretokens(c) for c in new if c not in self.special}
        words = list(set().union(*pre.values())) if pre else []
        ids = dict(zip(words, self.merge([w.encode() for w in words]), strict=True))
        out = {c: [self.special[c]] for c in new if c in self.special}
        for c, ws in pre.items():
            out[c] = ids[ws[0]] if len(ws) == 1 else [i for w in ws for i in ids[w]]
        return out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text without added tokens; special strings in a text become their ids. Null counts as empty."""
        split = [self._chunks(t) if t else [] for t in texts]
        known = self._known(split)
        return [[i for c in chunks for i in known[c]] for chunks in split]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special tokens included; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def digests(self, texts: list[str | None]) -> Iterator[tuple[int, bytes, bytes]]:
        """Number of ids, the decimal ids joined by commas and the decoded bytes of each text.

        As `encode` and `decode`, but chunks that a worker has met are kept in this form."""
        at = 0
        while at < len(texts):
            size, start = 0, at
            while at < len(texts) and (size < SOME or at == start):
                size += len(texts[at] or "")
                at += 1
            yield from self._digests(texts[start:at])

    def _digests(self, texts: list[str | None]) -> Iterator[tuple[int, bytes, bytes]]:
        memo, new = self.memo, set()
        for t in texts:  # chunks are cut again below: all of a batch at once are large
            if t:
                new.update(self._chunks(t))
        new.difference_update(memo)
        before, parts = len(memo), list(new)
        for k in range(0, len(parts), 20_000):
            for c, ids in self._known([parts[k : k + 20_000]]).items():
                memo[c] = (",".join(map(str, ids)).encode(), b"".join(map(self.bytes_of.__getitem__, ids)))
        for t in texts:
            if t:
                ids, raw = zip(*map(memo.__getitem__, self._chunks(t)), strict=True)
                all_ids = b",".join(ids)
                yield all_ids.count(b",") + 1, all_ids, b"".join(raw).decode("utf-8", "replace").encode()
            else:
                yield 0, b"", b""
        if len(memo) > MEMO:  # the oldest stay: frequent chunks come early
            for c in list(islice(memo, max(before, MEMO), None)):
                del memo[c]


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode_column(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the ids of every whole text as array<int>; null texts have an empty array, other columns stay."""
    df = df.drop(ids)
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = byte_bpe(path).encode(b.column(b.schema.get_field_index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.int32()))], [*b.schema.names, ids])

    return df.mapInArrow(run, schema)


def decode_column(df: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Add the text of every array of ids; null arrays have an empty text, other columns stay."""
    df = df.drop(text)
    schema = T.StructType([*df.schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [byte_bpe(path).decode(x or []) for x in b.column(b.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], [*b.schema.names, text])

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, number of ids, SHA-256 of the ids and of the decoded text. No shuffle.

    Null and empty texts have no ids; repeated rows stay; columns but key and text aren't read."""
    import hashlib

    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            with uncollected():
                counts, ids, texts = [], [], []
                for n, x, raw in byte_bpe(path).digests(b.column(1).to_pylist()):
                    counts.append(n)
                    ids.append(hashlib.sha256(x).hexdigest())
                    texts.append(hashlib.sha256(raw).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], schema.names)

    return df.select(key, text).mapInArrow(run, schema)
