import random
import re
from itertools import permutations

import numpy as np

from newsfold.llm import filter_audit


def fails(text, i, firsts):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    first = firsts.get(t)
    return {
        "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
        "E": first is not None and (i is None or i > first),
    }


def brute(rows, labels):
    """Each order applied to the documents themselves."""
    firsts = {}
    for i, t, _ in rows:
        if i is not None:
            firsts[t or ""] = min(firsts.get(t or "", i), i)
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    out = {}
    for part in {s or "" for _, _, s in rows}:
        docs = [(i, fails(t, i, firsts)) for i, t, s in rows if (s or "") == part]
        shares = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone, stay = [d for d in left if d[1][f]], [d for d in left if not d[1][f]]
                shares[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(stay), len(gone), sum(d[1][f] for d in docs) - len(gone), sum(d[1][f] and sum(d[1].values()) == 1 for d in docs),
                    sum(d[0] in good for d in gone if d[0] is not None), sum(d[0] in toxic for d in gone if d[0] is not None),
                ]
                left = stay
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shares[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def corpus():
    draw = random.Random(5)
    rows = []
    for i in range(120):
        word = lambda: "".join(draw.choice("abcdef") for _ in range(draw.choice([1, 6])))
        words = [word().upper() if draw.random() < 0.05 else word() for _ in range(draw.choice([0, 5, 198, 199, 200, 201, 250]))]
        text = draw.choice([" ", "\n", "\t \x0b"]).join(words) + draw.choice(["", "", " #", "|", "é" * 40])
        rows.append((i, text if draw.random() < 0.8 or not rows else draw.choice(rows)[1], draw.choice(["a", "b", None, ""])))
    rows += [(200, None, "c"), (201, "", "c"), (None, rows[3][1], "a"), (None, rows[3][1], "a"), (5, rows[5][1], "a"), (5, rows[5][1], "a"), (300, "AB cd " * 40_000, "long")]
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1])) for i in range(0, 130, 2)] + [(2, 1, 1), (None, 1, 1)]
    return rows, labels


def test_against_every_order(spark):
    rows, labels = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(df, marks)
    assert got.columns == ["part", "filter_order", "step", *filter_audit.COUNTS]
    found = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got.collect()}
    assert found == brute(rows, labels)
    clash = df.selectExpr("*", "1 AS id", "2 AS part", "3 AS mask", "4 AS good", "5 AS n", "6 AS sha")
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(clash, marks.selectExpr("*", "1 AS id")).collect()} == found


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(df, marks).count() == 0
    one = spark.createDataFrame([(None, None, None)], df.schema)
    assert filter_audit.audit(one, marks).count() == 600


def test_gray_code_walk():
    cells = np.random.default_rng(1).integers(0, 9, (7, 32, 3))
    states = filter_audit.walk(cells)
    for active in range(32):
        assert (states[:, active] == cells[:, [m for m in range(32) if not m & active]].sum(axis=1)).all()
