"""Language identification with language-bitmask n-gram filters.

One Bloom filter per language, bit-sliced: slot s of the table is a bitmask of the languages whose
filter has bit s set, so the AND of the K slots of an n-gram is the set of all languages that
contain it. A text's n-grams are looked up with K gathers; popcounts per language follow from a
histogram of the masks. The share of false positives that the fill of a language's filter predicts
is taken out, and the language with most remaining hits wins. Beyond 64 languages a slot has several
masks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

N = 4
#: Rows that each language is learned from at most, and the share of a language's n-grams that one must
#: make up to count as its own: rarer ones may come from wrong labels. It leaves 1 / LEAST_SHARE a language at most.
DOCS_PER_LANG, LEAST_SHARE = 1500, 1e-4
SLOT_BITS, HASHES = 20, 2
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Every ASCII character but letters ends a word.
TO_SPACE = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
SCHEMA = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])
PIECE = 1 << 21


def grams(texts: list[str | None], rows: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """N-byte grams of lower-cased texts and the row of each, some MB of text at a time; none crosses texts."""
    at = 0
    while at < len(texts):
        parts, sizes, size, start = [], [], 0, at
        while at < len(texts) and (size < PIECE or at == start):
            raw = b" " + texts[at].lower().encode() + b" " if texts[at] else b""
            parts.append(raw)
            sizes.append(len(raw))
            size += len(raw)
            at += 1
        data = np.frombuffer(b"".join(parts).translate(TO_SPACE), np.uint8)
        if len(data) < N:
            continue
        code = data[: len(data) - N + 1].astype(np.uint32)
        for k in range(1, N):
            code |= data[k : len(data) - N + 1 + k].astype(np.uint32) << np.uint32(8 * k)
        row = np.repeat(np.arange(start, at), sizes)
        good = (row[: len(code)] == row[N - 1 :]) & ((code & np.uint32(0xFFFF)) != 0x2020) & ((code >> np.uint32(16)) != 0x2020) & (((code >> np.uint32(8)) & np.uint32(0xFFFF)) != 0x2020)
        yield code[good], row[: len(code)][good]


def lettered(text: str | None) -> bool:
    """Whether a text has a letter (Unicode's category L; no digits, numerals or fractions)."""
    return text is not None and any(map(str.isalpha, text))


def slots(code: np.ndarray) -> list[np.ndarray]:
    h = code.astype(np.uint64) * ODD
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return [((h >> np.uint64(64 - SLOT_BITS * (k + 1))) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64) for k in range(HASHES)]


@dataclass
class Filters:
    """Bit-sliced filters: masks of 8 bits, or of as many 64-bit words as the languages need."""

    langs: list[str]
    table: np.ndarray
    false_rate: np.ndarray

    @staticmethod
    def of(grams_of: dict[str, np.ndarray]) -> Filters:
        langs = sorted(grams_of)
        kind, wide = (np.uint8, 8) if len(langs) <= 8 else (np.uint64, 64)
        table = np.zeros((max(1, -(-len(langs) // wide)), 1 << SLOT_BITS), kind)
        fill = np.zeros(len(langs))
        for k, lang in enumerate(langs):
            bits = np.zeros(1 << SLOT_BITS, bool)
            for s in slots(grams_of[lang]):
                bits[s] = True
            table[k // wide][bits] |= kind(1 << k % wide)
            fill[k] = bits.mean()
        return Filters(langs, table, fill**HASHES)

    def hits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Number of n-grams of each text, and of those that each language contains, false positives taken out."""
        total, found = np.zeros(len(texts)), np.zeros((len(texts), len(self.langs)))
        for code, row in grams(texts):
            if not len(code):
                continue
            first = int(row[0])
            row = row - first
            count = int(row[-1]) + 1
            a, *rest = slots(code)
            part, width = found[first : first + count], 1 << min(8, len(self.langs))
            for w, word in enumerate(self.table):
                mask = word[a]
                for b in rest:
                    mask &= word[b]
                if word.dtype == np.uint8:
                    by = np.bincount(row * width + mask, minlength=count * width).reshape(count, width)
                    part += by @ ((np.arange(width)[:, None] >> np.arange(len(self.langs))) & 1)
                else:
                    for k in range(64 * w, min(64 * w + 64, len(self.langs))):
                        part[:, k] += np.bincount(row, (mask >> np.uint64(k % 64)) & np.uint64(1), count)
            total[first : first + count] += np.bincount(row, minlength=count)
        return total, np.maximum(0, found - total[:, None] * self.false_rate) / np.maximum(1e-9, 1 - self.false_rate)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and share of its n-grams; `und` and 0 for null texts and those without a letter."""
        total, found = self.hits(texts)
        best = found.argmax(1) if self.langs else np.zeros(len(texts), int)
        score = np.clip(np.take_along_axis(found, best[:, None], 1)[:, 0] / np.maximum(total, 1), 0, 1) if self.langs else np.zeros(len(texts))
        known = np.array([bool(self.langs) and lettered(t) for t in texts], bool)
        return [self.langs[k] if ok else "und" for k, ok in zip(best.tolist(), known.tolist(), strict=True)], np.where(known, score, 0.0)


def learn(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", docs_per_lang: int = DOCS_PER_LANG, least_share: float = LEAST_SHARE) -> Filters:
    """Fit the filters on labelled rows.

    Reads the texts of at most `docs_per_lang` rows a language (those of the least xxhash64 of the
    key), counts their n-grams in Spark and keeps those that make up `least_share` of their language's,
    so at most 1 / least_share. These lists and a row a language reach the driver; languages are a
    vocabulary. Rows whose language or text is null are left out; an empty table gives filters
    without languages."""
    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    if not sizes:
        return Filters.of({})
    # a hash threshold first leaves about twice the bound of each language, however large, for the exact ranking
    share = F.create_map(*[x for name, n in sizes.items() for x in (F.lit(name), F.lit(min(1.0, 2.0 * docs_per_lang / n)))])
    order = F.xxhash64(F.col(key).cast("string"))
    near = rows.where(F.pmod(order, F.lit(1 << 30)) < share[F.col(lang)] * float(1 << 30))
    ranked = near.withColumn("__rank", F.row_number().over(Window.partitionBy(lang).orderBy(F.pmod(order, F.lit(1 << 30)), order, key)))
    chosen = ranked.where(F.col("__rank") <= docs_per_lang).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, texts = np.array(b.column(0).to_pylist(), object), b.column(1).to_pylist()
            for name in sorted(set(langs)):
                parts = [c for c, _ in grams([texts[k] for k in np.flatnonzero(langs == name)])]
                code, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.array([], np.uint32), [])
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(code), pa.string()), pa.array(code.astype(np.int64)), pa.array(np.array(n, np.int64))], ["lang", "gram", "n"])

    counts = chosen.mapInArrow(count, SCHEMA).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counts.withColumn("all", F.sum("n").over(Window.partitionBy("lang"))).where(F.col("n") >= least_share * F.col("all"))
    of: dict[str, list[int]] = {name: [] for name in sizes}
    for r in top.select("lang", "gram").collect():
        of[r.lang].append(r.gram)
    return Filters.of({k: np.array(v, np.uint32) for k, v in of.items()})


def identify(df: DataFrame, filters: Filters, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the predicted language and its score to every row; whole texts, no shuffle.

    Null, empty and letterless texts give `und` and 0; repeated rows stay; columns of the two new
    names are replaced and any others kept."""
    df = df.drop(lang_pred, score)
    shared = df.sparkSession.sparkContext.broadcast(filters)  # 2^SLOT_BITS masks of 1 or 8 bytes, whatever the data
    schema = T.StructType([*df.schema.fields, T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = shared.value.predict(b.column(b.schema.get_field_index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names, lang_pred, score])

    return df.mapInArrow(run, schema)


def training(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows to learn from: CRC-32 of the key's text, modulo 4, isn't 2."""
    return df.where(F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4, F.lit(0)) != 2)


def recognized(df: DataFrame, filters: Filters, text: str, least_score: float, least_grams: int) -> DataFrame:
    """The rows whose text has a letter and, where it has `least_grams` n-grams to judge by, a score of `least_score` in some language."""
    shared = df.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index(text)).to_pylist()
            total, found = shared.value.hits(texts)
            letters = np.array([lettered(t) for t in texts], bool)
            yield b.filter(pa.array(letters & ((total < least_grams) | (found.max(1, initial=0) >= least_score * total))))

    return df.mapInArrow(run, df.schema)
