import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from newsfold.llm import sharding


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 1000), max_size=60), st.integers(1, 7))
def test_no_worse_than_greedy_bound(sizes, shards):
    got = sharding.differencing(np.array(sizes, float), shards)
    loads = np.bincount(got, sizes, shards) if sizes else np.zeros(shards)
    assert len(got) == len(sizes) and loads.max() - loads.min() <= max(sizes, default=0)


def test_start_loads_are_kept():
    sizes = np.full(400, 10.0)
    start = np.array([1000.0, 0, 0, 500])
    loads = start + np.bincount(sharding.differencing(sizes, 4, start), sizes, 4)
    assert loads.max() - loads.min() <= 10


def check(spark, rows, shards):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS shard")
    got = sharding.shard(df, shards).collect()
    assert len(got) == len(rows)
    place, bytes_of = {}, {}
    text = dict(rows)
    for r in got:
        t = text[r.id] or ""
        assert r.size == len(t.encode()) + 16 and r.text_crc32 == zlib.crc32(t.encode())
        place.setdefault(t, set()).add(r.shard)
        bytes_of[r.shard] = bytes_of.get(r.shard, 0) + r.size
    assert all(len(s) == 1 for s in place.values())
    for s in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    return bytes_of


def test_even_shards(spark):
    rows = [(i, "x" * (i * 37 % 501)) for i in range(3000)]
    loads = check(spark, rows, 8)
    assert max(loads.values()) - min(loads.values()) <= 100


def test_hot_group_stands_alone(spark):
    rows = [(i, "same text " * 5 if i % 2 else f"{i} " * 8) for i in range(900)] + [(9000, None), (9001, "")]
    loads = check(spark, rows, 6)
    rest = sorted(loads.values())[:-1]
    assert max(rest) - min(rest) <= 120


def test_many_chunks_and_empty(spark):
    rows = [(i, f"{i * 7919} " * (i % 23)) for i in range(2500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    groups = df.selectExpr("cast(doc_id AS string) AS key", "length(text) + 16 AS bytes")
    got = sharding.assign_groups(groups, 5, chunk_groups=100, large_per_shard=1).join(groups, "key").groupBy("shard").sum("bytes").collect()
    assert len(got) == 5 and max(r[1] for r in got) - min(r[1] for r in got) < 3000
    assert sharding.report(df.limit(0)).count() == 0
