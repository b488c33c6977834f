"""The pipeline's rows against a plain-Python version of its five stages."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from framewright.llm import mixing, near_copies, secrets

public = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghilmnorstuvé") for _ in range(r.randint(2, 9))) for _ in range(n))


def edited(text, places, seed=0):
    r, words = random.Random(seed), text.split()
    for p in places:
        words[p] = "changed" + str(r.randint(0, 10**6))
    return " ".join(words)


def table():
    out = [(k, prose(k, 60 + k % 50), ["en", "fr", "de"][k % 3], f"src{k % 4}") for k in range(60)]
    # chains of near copies: each similar to the next, the ends to each other not always
    for k in range(20):
        base = prose(1000 + k, 100)
        one = edited(base, [20, 21])
        out += [(200 + 10 * k, base, "en", "src1"), (201 + 10 * k, one, "en", "src2"), (202 + 10 * k, edited(one, [70, 71]), "fr", "src1"), (203 + 10 * k, edited(base, [10, 60]), "de", "src3")]
    out += [(500, None, "en", "src1"), (501, "", None, "src1"), (502, "12 34", "fr", None), (503, "A.", "en", "src1"), (504, "Xq", "en", None), out[3]]
    out += [(510, "login: robert key Zk3vT9qLw8XbN2mR5yPd " + prose(9, 50), "en", "src2"), (511, "token: abcdefghijklmnopqrst " + prose(10, 50), "en", "src2"), (512, "ж" * 200 + " щ" * 30, None, "src1")]
    # two texts of one doc_id, the second a near copy of an earlier document; copies without a doc_id
    out += [(520, prose(71, 80), "en", "src1"), (520, edited(out[5][1], [3]), "en", "src1"), (None, prose(72, 80), "fr", "src2"), (None, prose(72, 80), "fr", "src2"), (None, edited(out[7][1], [9]), "en", "src1")]
    return [(*r, 1) for r in out]


def grams(text):
    raw = re.sub(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]", b" ", b" " + text.lower().encode() + b" ")
    return [g for k in range(len(raw) - 3) if b"  " not in (g := raw[k : k + 4])]


def known(rows):
    """As all labelled rows but every fourth teach a language, few enough that all their n-grams are kept."""
    import zlib

    seen = {g for d, t, lang, *_ in rows if t and lang and (d is None or zlib.crc32(str(d).encode()) % 4 != 2) for g in grams(t)}
    return [r for r in rows if r[1] and re.search(r"[^\W\d_]", r[1]) and (len(g := grams(r[1])) < 32 or sum(x in seen for x in g) >= 0.05 * len(g))]


def shingles(text):
    words = text.lower().split()
    k = min(5, len(words))
    return {" ".join(words[i : i + k]) for i in range(len(words) - k + 1)}


def without_near_copies(rows):
    sets, group = [shingles(r[1]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                was, new = group[i], group[j]
                group = [new if g == was else g for g in group]
    groups = collections.defaultdict(list)
    for r, g in zip(rows, group, strict=True):
        groups[g].append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0])) for g in groups.values()]


def findings(text):
    strong = secrets.base_spans(text)
    weak = [("weak_endpoint", *m.span()) for m in secrets.ENDPOINT.finditer(text)] + [("weak_account", *m.span(1)) for m in secrets.ACCOUNT.finditer(text)] + [("weak_secret", *m.span()) for m in secrets.RANDOM.finditer(text)]
    edges = [m.start() for m in secrets.SCOPE.finditer(text)]
    value = lambda x: x[0] in ("assign", "hex", "weak_secret")

    def meets(x, y):
        near = x[2] <= y[1] <= x[2] + 200 or y[2] <= x[1] <= y[2] + 200
        return value(x) != value(y) and near and sum(p <= x[1] for p in edges) == sum(p <= y[1] for p in edges)

    free = [x for x in weak if not any(x[1] < s[2] and s[1] < x[2] for s in strong)]
    return strong + [x for x in free if any(meets(x, y) for y in strong + weak)]


def redacted(text):
    out, at = "", 0
    for kind, s, e in sorted(findings(text), key=lambda x: (x[1], secrets.KINDS[x[0]], x[2])):
        if s >= at:
            out += text[at:s] + f"[{kind.upper()}]"
        at = max(at, e)
    return out + text[at:]


def share(total, caps, weights):
    got, left, open_ = {}, total, set(caps)
    while full := [k for k in open_ if left * weights[k] >= caps[k] * sum(weights[x] for x in open_)]:
        for k in full:
            got[k] = caps[k]
        left -= sum(caps[k] for k in full)
        open_ -= set(full)
    w = sum(weights[x] for x in open_)
    return got | {k: min(caps[k], left * weights[k] // w) for k in open_}


def mixed(rows):
    leaf = lambda r: ("d" + str((len(r[3]) * 7 + ord(r[3][-1])) % 4) if r[3] else "", r[2] or "", r[3] or "")
    size = lambda r: (len(r[1].encode()) + 3) // 4
    weight = [{"d0": 4, "d1": 3, "d2": 2}, {"en": 5, "de": 2, "fr": 2}, {}]
    tokens = collections.Counter()
    for r in rows:
        tokens[leaf(r)] += size(r)
    budget = {(): sum(tokens.values())}
    for depth in range(3):
        caps = collections.Counter()
        for x, n in tokens.items():
            caps[x[: depth + 1]] += n * mixing.EPOCHS
        up, budget = budget, {}
        for above, n in up.items():
            mine = {x: c for x, c in caps.items() if x[:depth] == above}
            budget |= share(n, mine, {x: weight[depth].get(x[depth], 1) for x in mine})
    out = []
    for x, n in tokens.items():
        whole, rest = divmod(budget[x], n)
        mine = [r for r in rows if leaf(r) == x]
        out += mine * whole
        order = lambda r: hashlib.md5(f"{mixing.SEED}:{whole}:{'' if r[0] is None else r[0]}".encode()).hexdigest()  # noqa: B023, E731
        for r in sorted(mine, key=order):
            rest -= size(r)
            if rest < 0:
                break
            out.append(r)
    return out


def encoded(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    ids = [t.encode(r[1], add_special_tokens=False).ids for r in rows]
    return [(r[0], len(x), sha(",".join(map(str, x))), sha(r[1])) for r, x in zip(rows, ids, strict=True)]


def written(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")


def test_run(spark, tmp_path):
    rows = table()
    written(spark, rows, tmp_path)
    want = encoded(mixed([(r[0], redacted(r[1]), *r[2:]) for r in without_near_copies(known(rows))]))
    assert collections.Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == collections.Counter(want)


def test_near_copies(spark, tmp_path):
    rows = [r for r in table() if r[1]]
    docs = written(spark, rows, tmp_path)
    want = without_near_copies(rows)
    assert sum(200 <= (r[0] or 0) < 500 for r in want) == 20
    assert collections.Counter(map(tuple, corpus_pipeline.drop_near_copies(spark, docs, "").collect())) == collections.Counter(want)
    blank = spark.createDataFrame([], SCHEMA)
    assert corpus_pipeline.drop_near_copies(spark, blank, "").count() == 0


def test_one_row_of_each_text_stays(spark, tmp_path):
    """A doc_id of two texts, and copies without one."""
    rows = [(1, prose(1, 60), "en", "a", 1), (2, edited(prose(1, 60), [0]), "en", "a", 1), (2, prose(2, 60), "en", "a", 1), (None, prose(1, 60), "en", "a", 1), (None, prose(3, 60), None, "a", 1), (None, prose(3, 60), "a", None, 1), (None, prose(4, 60), "en", "a", 1)]
    got = corpus_pipeline.drop_near_copies(spark, written(spark, rows + rows[2:3] + rows[-1:], tmp_path), "").collect()
    assert sorted(r.text for r in got) == sorted(prose(k, 60) for k in (1, 2, 3, 4))


def test_texts_too_short_to_judge_stay(spark, tmp_path):
    docs = written(spark, table(), tmp_path)
    got = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, "").collect()}
    assert {503, 504} <= got and not {500, 501, 502, 512} & got


def test_parities_never_rule_out_similar_sets():
    r = np.random.default_rng(4)
    for n in (0, 1, 5, 31, 100, 900, 5000):
        a = np.unique(r.integers(0, 1 << 64, n, dtype=np.uint64))
        for share in (0.0, 0.05, 0.12, 0.5, 1.0):
            b = np.unique(np.concatenate([a[int(share * n) :], r.integers(0, 1 << 64, int(share * n) + (n % 3), dtype=np.uint64)]))
            differ = len(np.setxor1d(a, b))
            assert near_copies.apart(near_copies.parities(a), near_copies.parities(b)) <= differ
            if differ > 20 and share == 1.0:
                assert 9 * near_copies.apart(near_copies.parities(a), near_copies.parities(b)) > len(a) + len(b)
