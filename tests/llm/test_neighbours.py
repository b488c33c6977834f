"""The permutation index at the query's own parameters, against brute force over all queries."""

import collections
import math

import numpy as np
import pytest

from framewright.llm import permutation_index, queries


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_all_queries(spark, sf):
    folder = f"/root/testdata/{sf}"
    table = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    ids, v = table.vec_id.to_numpy(), np.stack(table.embedding.to_numpy()).astype(np.float64)
    of = dict(zip(ids.tolist(), v, strict=True))
    by = collections.defaultdict(list)
    for x in queries.op7_permutation_neighbours(spark, folder).collect():
        by[x.query_id].append(x)
    hits = 0
    for q in ids[ids % 20 == 0].tolist():
        mine = sorted(by[q], key=lambda x: x["rank"])
        assert [x["rank"] for x in mine] == list(range(1, 21)) and q not in {x.vec_id for x in mine}
        assert all(abs(x.score - float(of[q] @ of[x.vec_id])) < 1e-12 for x in mine)
        assert [(-x.score, x.vec_id) for x in mine] == sorted((-x.score, x.vec_id) for x in mine)
        want = sorted((-float((v[k] * of[q]).sum()), i) for k, i in enumerate(ids.tolist()) if i != q)[:20]
        hits += len({i for _, i in want} & {x.vec_id for x in mine})
    assert hits >= 0.9 * 20 * (ids % 20 == 0).sum()


def test_few_rows_are_ranked():
    r = np.random.default_rng(0)
    v = r.normal(size=(4096, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    pivots = permutation_index.lifted(v[:256], 1.0)
    args = (permutation_index.POSTED, permutation_index.SHARED)
    block = permutation_index.Block.of(np.arange(4096), np.arange(4096), v, pivots, 1.0, args[0])
    again = permutation_index.Block.read(block.table(0))
    got = again.search(v[:40], np.arange(40), pivots, 20, *args)
    assert np.mean([ranked for *_, ranked in got]) < 0.4 * 4096
    assert all(len(f) == 20 and k not in f for k, (f, *_) in enumerate(got))


def test_ties_copies_and_small_tables(spark):
    one = [float(k == 0) for k in range(8)]
    rows = [(k, one) for k in range(40)] + [(7, one), (None, one), (50, None), (51, [0.0] * 8), (52, [math.nan] + one[1:]), (53, [None] + one[1:])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = permutation_index.usable(df, "vec_id", "embedding")
    got = collections.defaultdict(list)
    for x in permutation_index.search(v, v.where("id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[x.query_id].append(x.vec_id)
    near = [0, 1, 2, 3, 4, 5, 6, 7, 7, *range(8, 40)]  # all as near: smaller ids first, repeated rows apart
    assert got == {q: [k for k in near if k != q][:20] for q in (0, 20)}
    for n in (1, 3, 21):
        few = permutation_index.usable(df.limit(n), "vec_id", "embedding")
        assert permutation_index.search(few, few.where("id = 0")).count() == min(20, n - 1)
