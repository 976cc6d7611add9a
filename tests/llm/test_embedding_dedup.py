import numpy as np

from newsfold.llm import embedding_dedup as E


def brute(rows, threshold=0.95):
    good = {i: np.array(v, float) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    links = dict.fromkeys(up, 0)
    for a in good:
        for b in good:
            if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.sqrt((good[a] @ good[a]) * (good[b] @ good[b])) >= threshold:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (links[i], find(i), find(i) == i) for i in up}


def data():
    draw = np.random.default_rng(9)
    rows, k = [], 0
    for spread in (0.02, 0.05, 0.08, 0.3):
        for _ in range(12):
            centre = draw.standard_normal(32)
            for _ in range(draw.integers(1, 8)):
                rows.append((k, [float(np.float32(x)) for x in centre + spread * draw.standard_normal(32)]))
                k += 1
    rows += [(k + i, list(rows[0][1])) for i in range(30)]
    k += 30
    rows += [(k, None), (k + 1, []), (k + 2, [0.0] * 32), (k + 3, [float("nan")] * 32), (k + 4, [None] * 32), (k + 5, [1.0, 2.0]), (k + 6, [2.0, 4.0]), (k + 7, [float("inf")] + [1.0] * 31)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS n_links")


def test_against_brute_force(spark):
    rows = data()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_links(frame(spark, rows)).collect()}
    want = brute(rows)
    found, there = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
    assert all(got[i][0] <= want[i][0] for i in want) and found >= 0.99 * there
    if found == there:
        assert got == want


def test_small_blocks_give_the_same(spark):
    rows = data()
    same = [sorted(map(tuple, E.near_links(frame(spark, rows), block=b).collect())) for b in (5, 1024)]
    assert same[0] == same[1]


def test_edges(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, None)]
    got = E.near_links(frame(spark, rows)).collect()
    assert len(got) == 4 and sorted(r.n_links for r in got) == [0, 2, 2, 2]
    assert E.near_links(frame(spark, rows).limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    draw = np.random.default_rng(4)
    x = draw.standard_normal((400, 64))
    x /= np.sqrt((x * x).sum(1))[:, None]
    packed, factor, number, step = E.codes(x)
    estimate = E.signs(packed, 64) @ (number * step[:, None]).T / (8 * factor[:, None])
    truth = x @ x.T
    off = ~np.eye(400, dtype=bool)
    assert abs((estimate - truth)[off].mean()) < 0.005
    by_code, by_step = E.reach(factor, step, 64, 6.0)
    bound = by_code[:, None] + by_step[None, :] / factor[:, None]
    assert (np.abs(estimate - truth) <= bound)[off].all()
    code = E.signs(packed, 64)
    row, col = np.nonzero(np.ones((400, 400), bool))
    may = E.block_passing(code, factor, number, step, 400, 0.5, 1.0)
    assert (E.passing(code, factor, number, step, row, col, 0.5, 1.0).reshape(400, 400) == may).mean() > 0.9999
    assert packed.shape == (400, 8) and 0 < may.mean() < 0.5


def test_repeated_ids_and_doubles(spark):
    a, b, c = [1.0, 0.0, 0.1], [0.0, 1.0, 0.0], [1e-200, 1e-201, 0.0]
    rows = [(1, a), (1, b), (2, a), (3, [0.0, 1.0, 0.05]), (None, [0.99, 0.0, 0.1]), (4, c), (5, [0.0, 0.0, 1e300]), (None, [0.0, 0.0, -1.0]), (6, [1e39, 2e38, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS h", "2 AS v")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in E.near_links(df).collect())
    unit = [np.array(v) / max(map(abs, v)) for _, v in rows]
    links = [sum(x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95 for y in unit) - 1 for x in unit]
    assert sorted((x[0], x[1]) for x in got) == sorted((str(i), n) for (i, _), n in zip(rows, links)) and max(links) > 2
    assert got.count(("3", 1, "1", False)) == 1 and ("None", 0, "None", False) in got and ("5", 0, "5", True) in got


def test_a_hot_bucket_is_cut(spark):
    """Hundreds of vectors in one bucket, in small blocks, give brute force's links."""
    draw = np.random.default_rng(2)
    centre = draw.standard_normal(16)
    rows = [(i, (centre + 0.25 * draw.standard_normal(16)).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_links(df, block=40).collect()}
    want = brute(rows)
    found, there = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
    assert all(got[i][0] <= want[i][0] for i in want) and 0.995 * there <= found and 0 < there < 300 * 299
