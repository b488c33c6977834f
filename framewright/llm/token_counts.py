"""Token counts by rank-synchronous array merging.

Texts are cut at the word marks that no piece of the vocabulary crosses. All new pre-tokens of a
batch lie in one ragged numpy array (symbols and the sequence that each belongs to). A round finds
each sequence's lowest rank with one segmented minimum and merges every occurrence of that pair in
all sequences at once; sequences without a mergeable pair leave the arrays and their surviving
symbols are counted. Characters outside the vocabulary count as their UTF-8 bytes (byte fallback).

Merging all occurrences at once equals merging them one by one unless the new symbol may join a
neighbour at a still lower rank, or several pieces share a score; for such symbols (found once, from
the vocabulary) a round merges the leftmost occurrence only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE = np.int64(1) << 40
MARK = "▁"
WORDS = re.compile(f"[ {MARK}]*[^ {MARK}]+|[ {MARK}]+")
#: Words whose count a worker keeps; others are counted again in each batch that holds them.
MEMO = 200_000
#: Characters of the texts that are worked on together.
SOME = 6 << 20


class PieceMerger:
    """The merges of a sentencepiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        pieces = {sp.id_to_piece(i): i for i in plain}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("a piece crosses a word mark: texts can't be cut there")
        symbols = dict(pieces)
        for p in pieces:
            for c in p:
                symbols.setdefault(c, n + len(symbols))
        self.unknown = max(symbols.values(), default=0) + 1
        self.base = np.int64(self.unknown + 1)
        self.of_char = np.full(0x110000, self.unknown, np.int32)
        for s, i in symbols.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        scores = sorted({-sp.get_score(i) for p, i in pieces.items() if len(p) > 1})
        rank = {s: r for r, s in enumerate(scores)}
        of_piece = {p: rank[-sp.get_score(i)] for p, i in pieces.items() if len(p) > 1}
        table, shared = {}, np.bincount(list(of_piece.values()), minlength=1) if of_piece else np.zeros(1)
        self.single = np.zeros(self.base, bool)
        for p, r in of_piece.items():
            if shared[r] > 1:
                self.single[pieces[p]] = True
            for k in range(1, len(p)):
                a, b = p[:k], p[k:]
                if a in symbols and b in symbols:
                    table[symbols[a] * int(self.base) + symbols[b]] = (r, pieces[p])
                    for x in (a, b):
                        if of_piece.get(x, -1) > r:
                            self.single[symbols[x]] = True
        keys = sorted(table)
        self.keys = np.array(keys + [np.iinfo(np.int64).max], np.int64)
        self.ranks = np.array([table[k][0] for k in keys] + [NONE], np.int64)
        self.merged = np.array([table[k][1] for k in keys] + [0], np.int32)
        self.virtual = n  # symbols from here on have no piece of their own

    def _look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = a.astype(np.int64) * self.base + b
        at = np.searchsorted(self.keys, key)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), self.merged[at]

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each word; a word is a run of marks followed by other characters."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        seq = np.repeat(np.arange(len(words)), lengths)
        sym = self.of_char[points]
        wide = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        total = np.bincount(seq[sym == self.unknown], wide[sym == self.unknown] - 1, len(words)).astype(np.int64)
        widths = dict(zip(sym.tolist(), wide.tolist(), strict=True)) if (sym > self.virtual).any() else {}

        def retire(seq: np.ndarray, sym: np.ndarray) -> None:
            np.add(total, np.bincount(seq, minlength=len(words)), out=total)
            for s in widths:
                if self.virtual <= s < self.unknown:
                    np.add(total, (widths[s] - 1) * np.bincount(seq[sym == s], minlength=len(words)), out=total)

        ranks, into = np.full(len(sym), NONE), np.zeros(len(sym), np.int32)
        if len(sym) > 1:
            inner = np.flatnonzero(seq[1:] == seq[:-1])
            ranks[inner], into[inner] = self._look_up(sym[inner], sym[inner + 1])
        while len(sym):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            sizes = np.diff(np.r_[starts, len(seq)])
            low = np.repeat(np.minimum.reduceat(ranks, starts), sizes)
            done = low == NONE
            if done.any():
                retire(seq[done], sym[done])
                keep = ~done
                sym, seq, ranks, into, low = sym[keep], seq[keep], ranks[keep], into[keep], low[keep]
                if not len(sym):
                    break
            at = np.flatnonzero(ranks == low)
            fresh = np.r_[True, (np.diff(at) > 1) | (seq[at[1:]] != seq[at[:-1]])]
            run = np.repeat(np.flatnonzero(fresh), np.diff(np.r_[np.flatnonzero(fresh), len(at)]))
            first = np.r_[True, seq[at[1:]] != seq[at[:-1]]]
            leads = at[np.repeat(np.flatnonzero(first), np.diff(np.r_[np.flatnonzero(first), len(at)]))]
            at = at[np.where(self.single[into[leads]], first, (np.arange(len(at)) - run) % 2 == 0)]
            sym[at] = into[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            at = moved[at]
            sym, seq, ranks, into = sym[keep], seq[keep], ranks[keep], into[keep]
            for i in (at, at[at > 0] - 1):
                inner = i[i < len(sym) - 1]
                inner = inner[seq[inner] == seq[inner + 1]]
                ranks[i] = NONE
                ranks[inner], into[inner] = self._look_up(sym[inner], sym[inner + 1])
        return total


@lru_cache(maxsize=2)
def merger(path: str) -> tuple[PieceMerger, dict[str, int]]:
    """The merger and the worker's memo of word counts."""
    return PieceMerger(path), {}


def count_texts(texts: list[str | None], path: str) -> list[int]:
    """Tokens of each text, as the library gives them without begin and end tokens; null counts as empty."""
    m, memo = merger(path)
    out: list[int] = []
    at = 0
    while at < len(texts):
        size, split = 0, []
        while at < len(texts) and (size < SOME or not split):
            split.append(WORDS.findall(" " + texts[at]) if texts[at] else [])
            size += len(texts[at] or "")
            at += 1
        new = list(set().union(*split).difference(memo))
        before = len(memo)
        for k in range(0, len(new), 50_000):
            part = new[k : k + 50_000]
            memo.update(zip(part, m.counts([w.replace(" ", MARK) for w in part]).tolist(), strict=True))
        out += [sum(map(memo.__getitem__, w)) for w in split]
        if len(memo) > MEMO:  # the oldest stay: frequent words come early
            for w in list(islice(memo, max(before, MEMO), None)):
                del memo[w]
    return out


def count_tokens(df: DataFrame, path: str, text: str = "text", n_tokens: str = "n_tokens", n_bytes: str = "n_bytes") -> DataFrame:
    """Add the UTF-8 bytes and the tokens of every whole text; no shuffle, other columns stay as they are.

    Null and empty texts have 0 of both. Repeated rows stay. Columns of the two names are replaced."""
    df = df.drop(n_tokens, n_bytes)
    schema = df.withColumns({n_bytes: F.lit(0).cast("long"), n_tokens: F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index(text)).to_pylist()
            sizes = pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64())
            tokens = pa.array(count_texts(texts, path), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, sizes, tokens], [*b.schema.names, n_bytes, n_tokens])

    return df.mapInArrow(run, schema)
