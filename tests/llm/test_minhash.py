import random

import numpy as np
import pytest

from newsfold.llm import minhash


def sets_of(text):
    words = [w.decode() for w in (text or "").encode().lower().split()]
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = {i: sets_of(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(11)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(5))
    rows, k = [], 0
    passage = [word() for _ in range(30)]
    for _ in range(25):
        base = [word() for _ in range(draw.randrange(20, 90))]
        if draw.random() < 0.5:
            base += passage
        for _ in range(draw.randrange(1, 7)):
            copy = list(base)
            for _ in range(draw.randrange(0, 3)):
                copy[draw.randrange(len(copy))] = word()
            rows.append((k, " ".join(copy)))
            k += 1
    rows += [(k, None), (k + 1, ""), (k + 2, "  \n "), (k + 3, "One two"), (k + 4, "one\ttwo"), (k + 5, "one two three"), (k + 6, rows[3][1].upper())]
    return rows


def test_against_brute_force(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_groups(df).collect()}
    assert got == brute(corpus)


def test_small_blocks_give_the_same(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_groups(df, block_words=60).collect()}
    assert got == {k: v[1] for k, v in brute(corpus).items()}


def test_edges(spark):
    rows = [(5, "a b c d e f g", "p"), (5, "a b c d e f g", "q"), (None, "a b c d e f g", "r"), (7, None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = minhash.near_groups(df).collect()
    assert len(got) == 4 and sum(r.kept for r in got) == 3
    assert minhash.near_groups(df.limit(0)).count() == 0
    assert minhash.keep_one(df).columns == df.columns


def test_intersections():
    draw = np.random.default_rng(3)
    sets = [np.unique(draw.integers(0, 300, draw.integers(1, 200)).astype(np.uint64)) for _ in range(60)]
    values, owner = np.concatenate(sets), np.repeat(np.arange(60), [len(s) for s in sets])
    got = minhash.intersections(values, owner, 60, 40)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(40) for j in range(60))


def test_tables_miss_little():
    p = 0.75**3
    assert (1 - p) ** 28 + 28 * p * (1 - p) ** 27 < 5e-6


def test_repeated_and_null_ids(spark):
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(5))
    a, b, c = ([word() for _ in range(40)] for _ in range(3))
    texts = [a, b, a[:-1] + ["x"], b[:-1] + ["y"], c, c[:-1] + ["z"], c, a, [], []]
    ids = [1, 1, 2, 3, None, None, None, 1, 9, 9]
    rows = [(i, " ".join(t), k) for k, (i, t) in enumerate(zip(ids, texts))]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int").selectExpr("*", "1 AS id_hash", "2 AS kept")
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in minhash.near_groups(df).collect())
    assert got == sorted([("1", "1", True), ("1", "1", True), ("1", "1", True), ("2", "1", False), ("3", "1", False), ("9", "9", True), ("9", "9", True)] + [("None", "None", False)] * 3)
    left = minhash.keep_one(df)
    kept = sorted(r.row for r in left.collect())
    assert left.columns == df.columns and len(kept) == 5 and kept[-2:] == [8, 9]
    assert len({0, 7} & set(kept)) == 1 and 1 in kept and len({4, 5, 6} & set(kept)) == 1


def test_templates_are_not_clustered(spark):
    """Texts that share a template (similarity .3) meet in tables, but neither link nor form clusters to verify."""
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefghijklmnop") for _ in range(6))
    template = [word() for _ in range(50)]
    texts = [" ".join(template + [word() for _ in range(50)]) for _ in range(2000)]
    one, two = (sets_of(t) for t in texts[:2])
    assert 0.28 < len(one & two) / len(one | two) < 0.35
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    classes = minhash.features(df, "doc_id", "text", 5, 28).select(minhash.F.col("id").alias("c"), "keys", "signature")
    links = minhash.alike(classes, minhash.buckets(classes), 75)
    assert links.count() < 100
    assert minhash.near_groups(df).where("kept").count() == 2000


def test_large_group_has_few_centres(spark):
    """Near copies of one text: buckets meet in those that most share keys with, so links are a few times the classes and not a link for each pair of bucket and class."""
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefghijklmnop") for _ in range(6))
    base = [word() for _ in range(120)]
    texts = []
    for _ in range(600):
        own = list(base)
        for _ in range(draw.randrange(1, 3)):
            own[draw.randrange(120)] = word()
        texts.append(" ".join(own))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    classes = minhash.features(df, "doc_id", "text", 5, 28).select(minhash.F.col("id").alias("c"), "keys", "signature")
    stars = minhash.buckets(classes).where("c <> src").select("src", "c").distinct()
    assert stars.count() < 5_000
    assert minhash.near_groups(df).where("kept").count() == 1
