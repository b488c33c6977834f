"""Label propagation: whole groups, even sizes, falling cuts, and edges that lead through several links."""

import collections
import random

import pytest

from framewright.llm import sharding


def shards_of(got, group):
    by = collections.defaultdict(set)
    for x in got:
        by[x[group]].add(x.shard)
    return by


def laws(got, shards):
    sizes = collections.Counter(x.shard for x in got)
    assert max(sizes.values()) - min(sizes[k] for k in range(shards)) <= 1
    slots = collections.defaultdict(list)
    for x in got:
        slots[x.shard].append(x.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


@pytest.mark.parametrize("size", [15, 25])
def test_a_group_that_fits_a_shard_stays_whole(spark, size):
    df = spark.createDataFrame([(k, 7 if k < size else 1000 + k) for k in range(1000)], "doc_id long, link long")
    got = sharding.assign(df, "doc_id", ["link"], 40).collect()
    laws(got, 40)
    assert len(shards_of(got, "link")[7]) == 1 and len({x.doc_id for x in got}) == 1000


def test_groups_of_all_sizes(spark):
    r = random.Random(1)
    links = [g for g in range(60) for _ in range(r.randint(2, 40))] + [100] * 700
    links += range(1000, 4000 - len(links) + 1000)
    r.shuffle(links)
    df = spark.createDataFrame([(None if k % 50 == 0 else k % 900, g) for k, g in enumerate(links)], "doc_id long, link long")
    got = sharding.assign(df, "doc_id", ["link"], 10).collect()
    laws(got, 10)
    assert sorted(x.link for x in got) == sorted(links)
    by = shards_of(got, "link")
    assert all(len(by[g]) == 1 for g in range(60)) and len(by[100]) == 2  # 700 of a quota of 400: two parts
    quotas = [400] * 10
    edges = sharding.edge_table(df.selectExpr("monotonically_increasing_id() AS id", "link"), ["link"], 400, 10)
    seats, cuts = sharding.propagate(edges, quotas)
    assert cuts == sorted(cuts, reverse=True) and cuts[-1] == 0 < cuts[0]
    assert seats.groupBy("label").count().where("count > 400").count() == 0


def test_labels_travel_along_edges(spark):
    # chains: a document shares its first link with the one before it and its second with the one after it
    rows = [(c * 100 + k, c * 1000 + k // 2, c * 1000 + 500 + (k + 1) // 2) for c in range(4) for k in range(12)]
    rows += [(10_000 + k, None, None) for k in range(192)]
    df = spark.createDataFrame(rows, "doc_id long, a long, b long")
    edges = sharding.edge_table(df.selectExpr("doc_id AS id", "a", "b"), ["a", "b"], 60, 4).cache()
    _, once = sharding.propagate(edges, [60] * 4, 1)
    _, cuts = sharding.propagate(edges, [60] * 4)
    assert cuts == sorted(cuts, reverse=True) and cuts[-1] < once[-1] <= cuts[0]
    laws(sharding.assign(df, "doc_id", ["a", "b"], 4).collect(), 4)


def test_repeated_ids_and_tiny_tables(spark):
    df = spark.createDataFrame([(None, 1)] * 300 + [(5, 2)] * 300, "doc_id long, link long")
    got = sharding.assign(df, "doc_id", ["link"], 7).collect()
    laws(got, 7)
    assert len(got) == 600
    for n in (0, 1, 3):
        assert len(sharding.assign(df.limit(n), "doc_id", ["link"], 7).collect()) == n
