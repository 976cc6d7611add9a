from fractions import Fraction

import pytest

from newsfold.llm import mixing


def waterfill(sizes, most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = Fraction(total - sum(most * sizes[s] for s in full))
        w = sum(weight[s] for s in names if s not in full)
        target = {s: Fraction(most * sizes[s]) if s in full else (rest * weight[s] / w if w else Fraction(0)) for s in names}
        over = {s for s in names if s not in full and target[s] > most * sizes[s]}
        if not over:
            return {s: float(t) for s, t in target.items()}
        full |= over


@pytest.fixture(scope="module")
def rows():
    out, k = [], 0
    for source, n, size in (("a", 60, 9), ("b", 5, 4), ("é", 300, 7), ("c", 1, 1), (None, 20, 3), ("empty", 3, 0)):
        for i in range(n):
            out.append((k, " ".join(["w"] * (size + i % 5 if size else 0)) if k % 17 else None, source))
            k += 1
    return out


def test_targets_and_taken(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'x' AS size")
    got = mixing.report(df).collect()
    size = lambda t: len((t or "").split())
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want, source = waterfill(sizes), {i: s for i, _, s in rows}
    taken = {}
    for r in got:
        s = source[r.doc_id]
        assert r.size == size(rows[r.doc_id][1]) and r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 3 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert [r.position for r in got if r.position is not None] == sorted(r.position for r in got if r.position is not None)
    again = {r.doc_id: r.taken for r in mixing.report(df.repartition(3)).collect()}
    assert again == {r.doc_id: r.taken for r in got}


def test_mixed_rows(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {r.doc_id: r.taken for r in mixing.report(df).collect()}
    words = {}
    for r in mixing.mixed(df).collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert words == {k: v for k, v in taken.items() if v}


def test_position_inverts_the_schedule(spark):
    from pyspark.sql import functions as F

    df = spark.range(101).select((F.col("id") / 100).alias("u"), F.array(*[F.lit(x) for x in (1.0, 0.0, 3.0)]).alias("i"))
    got = [r.t for r in df.select(mixing.position(F.col("u"), F.col("i")).alias("t")).collect()]
    for u, t in zip((k / 100 for k in range(101)), got):
        done = min(t, 1 / 3) * 3 * 0.25 + max(0.0, t - 2 / 3) * 3 * 0.75
        assert done == pytest.approx(u)


def test_given_weights_and_empty(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    only = spark.createDataFrame([("a", 1.0)], "source string, weight double")
    got = mixing.shares(df, weights=only).groupBy("source").sum("taken").collect()
    assert {r[0] for r in got if r[1]} == {"a"}
    assert mixing.report(df.limit(0)).count() == 0 and mixing.mixed(df.limit(0)).count() == 0


def test_repeated_ids_and_any_names(spark):
    rows = [(7, "a b c d e", "s", 1), (7, "f " * 50, "s", 2), (None, "g h", "s", 3), (None, "i j k", None, 4), (8, "l m", "\0null", 5), (8, "l m", "\0null", 6), (9, None, "s", 7), (10, "", None, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, words int").selectExpr("*", "'x' AS copy", "0.5 AS position", "1 AS row", "2 AS id_hash", "true AS several")
    got = mixing.report(df.select("doc_id", "text", "source")).collect()
    assert len(got) == len(rows)
    out = mixing.mixed(df)
    assert out.columns == df.columns
    words = {}
    for r in out.collect():
        key = r.doc_id, r.words if r.doc_id != 8 else 5
        words[key] = words.get(key, 0) + len(r.text.split())
    assert sum(words.values()) == sum(r.taken for r in got)
    want = {}
    for r in mixing.shares(df.select("doc_id", "text", "source")).collect():
        want[r.id, r.size] = want.get((r.id, r.size), 0) + r.taken
    size = {k: len((t or "").split()) for _, t, _, k in rows}
    assert {(i, size[k]): n for (i, k), n in words.items() if i != 8} == {k: v for k, v in want.items() if v and k[0] != 8}


def test_schedules_set_the_shares_in_force(spark):
    """In each tenth of the order, the sources' words are as their targets times their schedules."""
    rows = [(i, "w " * (3 + i % 3), "abc"[i % 3]) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    shared = mixing.shares(df)
    parts = {r.source: (r.demand, list(r.intensity)) for r in shared.select("source", "demand", "intensity").distinct().collect()}
    whole = sum(d for d, _ in parts.values())
    knots = mixing.clock(shared)
    order = mixing.copies(shared).collect()
    assert knots[0] == (0.0, 0.0) and knots[-1][1] == pytest.approx(1) and sum(r.words for r in order) == whole

    def time(place):
        for (t0, y0), (t1, y1) in zip(knots, knots[1:]):
            if place <= y1:
                return t0 + (place - y0) / (y1 - y0) * (t1 - t0)
        return 1.0

    def done(source, t):
        n, i = parts[source]
        return n * sum(x * min(max(t * len(i) - k, 0), 1) for k, x in enumerate(i)) / sum(i)

    for k in range(10):
        low, high = k / 10, (k + 1) / 10
        got = {s: 0 for s in parts}
        for r in order:
            if low <= r.position < high:
                got[r.source] += r.words
        for s in parts:
            assert got[s] / whole == pytest.approx((done(s, time(high)) - done(s, time(low))) / whole, abs=0.003)
    assert len({round(parts[s][0]) for s in parts}) > 1
