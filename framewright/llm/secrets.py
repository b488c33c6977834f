"""Secret scans with multipart credential linking.

Strong patterns (assignments, access identifiers, hexadecimal runs) are reported by themselves. Weak
candidates, an account name, a random-looking value or an endpoint, are no finding alone: within a
scope (a paragraph) candidates are joined by interval, each one's span widened by REACH on either
side, and a weak one is reported only if a secret meets an identifier or endpoint there, or lies in
the userinfo part of an endpoint. The join runs over sorted positions, so many candidates of one
document never become all pairs.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of [0-9a-f]+ that are long enough: a run is always matched whole
SCOPE = re.compile(r"\n[ \t\r]*\n")
ACCOUNT = re.compile(r"(?:user(?:name)?|login|account|client_id)[\"']?\x20*[:=]\x20*[\"']?([\w.@+-]{3,})", re.I | re.A)
ENDPOINT = re.compile(r"(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp)://[^\s\"'<>]+|\b\d{1,3}(?:\.\d{1,3}){3}:\d{2,5}\b", re.A)
USERINFO = re.compile(r"[a-z]+:(//[^/?#@]*(?:@[^/?#@]*)*)@", re.I)
RANDOM = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*\d)(?=[^A-Z]*[A-Z])(?=[^a-z]*[a-z])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
KINDS = {"assign": 0, "access": 1, "hex": 2, "weak_account": 3, "weak_secret": 4, "weak_endpoint": 5}
REACH = 200

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """The strong findings, in code points, end exclusive."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12] if "=" in text or ":" in text else []
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def within_endpoints(text: str, weak: list[Span]) -> set[Span]:
    """Random-looking values in the userinfo part of an endpoint (scheme://user:value@host), and these endpoints."""
    secrets = sorted(x for x in weak if x[0] == "weak_secret")
    starts = [x[1] for x in secrets]
    found: set[Span] = set()
    for x in weak:
        if x[0] == "weak_endpoint" and (m := USERINFO.match(text, x[1], x[2])):
            # a value right behind the scheme takes the slashes in
            mine = [y for y in secrets[bisect_left(starts, m.start(1)) : bisect_left(starts, m.end(1))] if y[2] <= m.end(1)]
            found.update([x, *mine] if mine else [])
    return found


def linked(text: str, strong: list[Span]) -> list[Span]:
    """Weak candidates whose complementary part lies within reach in their scope."""
    weak: list[Span] = []
    if "://" in text or ":" in text:
        weak += [("weak_endpoint", *m.span()) for m in ENDPOINT.finditer(text)]
    if "=" in text or ":" in text:
        weak += [("weak_account", *m.span(1)) for m in ACCOUNT.finditer(text)]
    if not weak and not strong:
        return []
    weak += [("weak_secret", *m.span()) for m in RANDOM.finditer(text)]
    edges = [m.start() for m in SCOPE.finditer(text)]
    values = sorted((s, e) for k, s, e in [*strong, *weak] if k in ("assign", "hex", "weak_secret"))
    others = sorted((s, e) for k, s, e in [*strong, *weak] if k in ("access", "weak_account", "weak_endpoint"))
    scope = lambda p: bisect_right(edges, p)
    taken = sorted((s, e) for _, s, e in strong)
    ends = list(accumulate((e for _, e in taken), max))

    by_end = {id(side): sorted((e, s) for s, e in side) for side in (values, others)}

    def meets(span: Span, side: list[tuple[int, int]]) -> bool:
        _, s, e = span
        # of those behind, the nearest start decides; of those before, any whose end is within reach, nested ones too
        i = bisect_left(side, (e, 0))
        if i < len(side) and side[i][0] <= e + REACH and scope(side[i][0]) == scope(s):
            return True
        ends_of = by_end[id(side)]
        i = bisect_left(ends_of, (s - REACH, 0))
        while i < len(ends_of) and ends_of[i][0] <= s:
            if scope(ends_of[i][1]) == scope(s):
                return True
            i += 1
        return False

    def inside(span: Span) -> bool:
        k = bisect_left(taken, (span[2], 0))
        return k > 0 and ends[k - 1] > span[1]

    kept = [x for x in weak if not inside(x)]
    own = within_endpoints(text, kept)
    return [x for x in kept if x in own or meets(x, others if x[0] == "weak_secret" else values)]


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS[x[0]], x[2])))


def scan_text(text: str | None) -> tuple[list[Span], list[Span]]:
    """The strong findings and the linked weak ones of a whole text; null counts as empty."""
    if not text:
        return [], []
    strong = base_spans(text)
    return strong, linked(text, strong)


def redact(text: str | None) -> str | None:
    """The text with every finding replaced by its kind; overlapping ones together. Null stays null."""
    if not text:
        return text
    strong, weak = scan_text(text)
    if not strong and not weak:
        return text
    out, at = [], 0
    for kind, s, e in sorted([*strong, *weak], key=lambda x: (x[1], KINDS[x[0]], x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, counts of strong findings, digest of these, and all spans. Whole texts, no shuffle.

    Null and empty texts have no findings; repeated rows stay; only key and text are read."""
    import hashlib

    long, string = T.LongType(), T.StringType()
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *(T.StructField(f"n_{k}", long) for k in ("assign", "access", "hex")), T.StructField("base_sha256", string), T.StructField("spans", string), T.StructField("n_linked", long)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for t in b.column(1).to_pylist():
                strong, weak = scan_text(t)
                for col, kind in zip(cols, ("assign", "access", "hex"), strict=False):
                    col.append(sum(x[0] == kind for x in strong))
                cols[3].append(hashlib.sha256(written(strong).encode()).hexdigest())
                cols[4].append(written(strong + weak))
                cols[5].append(len(weak))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.string() if k in (3, 4) else pa.int64()) for k, c in enumerate(cols))], schema.names)

    return df.select(key, text).mapInArrow(run, schema)


def redacted(df: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns, with findings in `text` replaced. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text)
            new = pa.array([redact(t) for t in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([new if k == at else c for k, c in enumerate(b.columns)], b.schema.names)

    return df.mapInArrow(run, df.schema)
