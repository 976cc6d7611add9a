from pyspark.sql import functions as F

from newsfold.llm import exact_dedup

ROWS = [(1, "a b"), (2, "ab "), (3, "a\tb\n\n"), (4, None), (5, ""), (6, " \x0b"), (7, "c\u00a0d"), (8, "cd"), (9, "a b"), (9, "a b"), (10, "x" * 200_000)]


def expected(rows):
    norm = lambda t: "".join(ch for ch in (t or "") if ch not in " \t\n\x0b\f\r")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i))
    return sorted((i, min(groups[norm(t)])[1], len(groups[norm(t)])) for i, t in rows)


def test_groups(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = exact_dedup.exact_groups(df).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == expected(ROWS)


def test_collisions_are_told_apart(spark):
    rows = [(i, f"text {i % 7}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    weak = lambda c: F.substring(F.md5(c), 1, 1).substr(1, 0)  # noqa: E731  every text has the same hash
    got = exact_dedup.exact_groups(df, hashed=weak).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == expected(rows)


def test_keep_first(spark):
    df = spark.createDataFrame([(i, t, "z") for i, t in ROWS], "doc_id long, text string, kept string")
    got = exact_dedup.keep_first(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted({k for _, k, _ in expected(ROWS)})
    assert exact_dedup.exact_groups(df.limit(0)).count() == 0 and exact_dedup.keep_first(df.limit(0)).count() == 0


def test_keep_first_with_any_names_and_repeats(spark):
    rows = [(1, "a b", 1), (1, "a  b", 2), (1, "a  b", 3), (None, "c", 4), (None, "c", 5), (2, "d", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k int").selectExpr("*", "1 AS _n", "2 AS _sha", "3 AS _kept_id", "4 AS id", "5 AS row", "6 AS several")
    got = exact_dedup.keep_first(df)
    kept = sorted(r.k for r in got.collect())
    assert got.columns == df.columns and len(kept) == 3 and kept[0] in (1, 2, 3) and kept[1] in (4, 5) and kept[2] == 6
