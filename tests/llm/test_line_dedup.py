import hashlib
import random

import pytest
from pyspark.sql import functions as F

from newsfold.llm import line_dedup

BLANKS = " \t\n\x0b\f\r"


def key_of(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(rows, least_length=40, least=5):
    """Kept text, lines and dropped lines of each row, by loops; a null id is smaller than all others."""
    order = lambda i: (i is not None, i or 0)
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key_of(line)) >= least_length:
                holders.setdefault(key_of(line), set()).add(i)
    keeper = {k: max(ids, key=order) for k, ids in holders.items() if len(ids) >= least}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [line for line in lines if key_of(line) not in keeper or keeper[key_of(line)] == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(3)
    common = [f"{'ÄBC'[n % 3]}ll rights reserved by the owners of number {n}, always." for n in range(12)]
    edges = ["x" * 39 + "y", "x" * 39, "Ünïcode line of exactly forty code points", "", "  ", "\t Padded line that is long enough to count, surely \r"]
    out = []
    for i in range(60):
        lines = [draw.choice(common + edges) if draw.random() < 0.6 else f"line {draw.random()} of its own, which nobody else has" for _ in range(draw.randrange(1, 12))]
        if draw.random() < 0.3:
            lines.append(lines[0].upper())
        out.append((i, "\n".join(lines)))
    out += [(60, None), (61, ""), (62, "\n"), (63, common[0]), (64, "\n".join(common[:3])), (64, common[4]), (None, common[0] + "\nrest"), (None, common[0])]
    return out + [(65, "\n".join(f"{'z' * 40} {n % 50}" for n in range(3000))), (66, out[3][1]), (3, out[3][1])]


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 2), (5, 2), (7, 3)])
def test_against_loops(spark, rows, batches, fanout):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in line_dedup.digests(df, batches=batches, fanout=fanout).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_other_thresholds_and_hot_line(spark):
    rows = [(i, f"hot line\nown {i}" if i % 3 else f"own {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in line_dedup.digests(df, least_length=8, least=2).collect()]
    assert sorted(got, key=str) == brute(rows, 8, 2) and sum(r[2] for r in got) == 199


def test_texts_and_clashing_columns(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS pos", "2 AS h1", "3 AS id", "4 AS row", "5 AS dropped", "6 AS batch")
    got = line_dedup.without_common_lines(df)
    assert got.columns == df.columns and got.count() == len(rows)
    texts = {hashlib.sha256((r.text or "").encode()).hexdigest() for r in got.collect()}
    assert texts == {r[3] for r in brute(rows)}
    assert got.where("text is null").count() == 1


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.digests(df).count() == 0
    nothing = spark.createDataFrame([(None, None), (None, "")], "doc_id long, text string")
    assert [tuple(r)[:3] for r in line_dedup.digests(nothing).collect()] == [(None, 1, 0)] * 2


def test_levels(spark, tmp_path):
    runs = line_dedup.LineRuns(spark, f"file://{tmp_path}/runs", fanout=3, least=3, buckets=4)
    assert [runs.live(n) for n in (0, 2, 3, 7, 9, 10)] == [[], [(0, 1), (1, 2)], [(0, 3)], [(0, 3), (3, 6), (6, 7)], [(0, 9)], [(0, 9), (9, 10)]]
    draw, batches = random.Random(1), []
    for b in range(7):
        batches.append({h: (draw.randrange(1, 3), draw.randrange(1000)) for h in draw.sample(range(30), 12)})
        keys = spark.createDataFrame([(h, -h, n, k) for h, (n, k) in batches[-1].items()], "h1 long, h2 long, docs long, keeper long")
        runs.absorb(keys, b)
        if b in (2, 4):  # a batch that failed halfway comes again
            runs.absorb(keys, b)
    got = {r.h1 for r in runs.settled(7).collect()}
    assert got == {h for h in range(30) if sum(b[h][0] for b in batches if h in b) >= 3}
    again = line_dedup.LineRuns(spark, runs.folder, fanout=3, least=3, buckets=4)
    spark.sql(f"DROP TABLE {runs._name((0, 3))}")  # a session that knows no table finds the files
    assert {r.h1 for r in again.settled(7).collect()} == got
    one, two = (runs.run(span).select("h1", "h2").hint("merge") for span in ((0, 3), (3, 6)))
    plan = one.join(two, ["h1", "h2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    runs.clear()


def test_line_keys(spark):
    lines = ["  AbC é ÀÉ \r", "\x0b\x0cTitle Ünit\t", "", None, " X"]
    df = spark.createDataFrame([(x,) for x in lines], "line string").select(line_dedup.line_key(F.col("line")).alias("k"))
    assert [r.k for r in df.collect()] == [None if x is None else key_of(x) for x in lines]
