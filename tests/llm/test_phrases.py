import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsfold.llm import phrases


def brute(rows, least=10, best=2000):
    counts, total = {}, Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        rows_ = []
        for p, a in f.items():
            if len(p) > 1 and a >= least:
                if any(len(q) == len(p) + 1 and b >= least and 100 * b >= 50 * a and p in (q[:-1], q[1:]) for q, b in f.items()):
                    continue
                score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                rows_.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(rows_)[:best], 1):
            out.append((lang, rank, p.decode(), -a, l, r, total[lang], -s))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(8)
    words = ["a", "B", "the", "été", "of", "x-y", "Ünit", "new", "york", "city", "…", "'"]
    out = []
    for i in range(150):
        text = ""
        for _ in range(draw.randrange(0, 40)):
            text += draw.choice(words[: draw.choice([4, 12])]) + draw.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " "])
            if draw.random() < 0.15:
                text += "New York city "
        out.append((i, text, draw.choice(["en", "en", "fr", None, "und"])))
    return out + [(200, None, "en"), (201, "", None), (202, " .. ", "zz"), (203, "one. two", "lone"), (204, "very long text " * 30_000, "fr"), (None, out[1][1], "en"), (1, out[1][1], "en")]


@pytest.mark.parametrize("settings", [{}, {"shards": 1}, {"shards": 4, "chunk": 200}, {"bits": 64}])
def test_against_loops(spark, rows, settings):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    assert sorted(map(tuple, phrases.collocations(df, **settings).collect())) == brute(rows)


def test_best_and_clashing_columns(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS n", "2 AS phrase", "3 AS shard", "4 AS length")
    assert sorted(map(tuple, phrases.collocations(df, best=3, least=4, buckets=2).collect())) == brute(rows, 4, 3)
    assert phrases.collocations(df.limit(0)).count() == 0


def number(phrase):
    return [int(x) for x in phrases.numbered(phrases.spelled("en", phrase.split()), 0)]


def bitmap(told, bits):
    out = bytearray(bits // 8)
    for p in told:
        own = [np.uint64(x) for x in number(p)]
        at = int(own[0] if len(own) == 1 else phrases.pair_bits(*own)) & (bits - 1)
        out[at >> 3] |= 1 << (at & 7)
    return np.frombuffer(bytes(out), np.uint8)


def test_only_active_phrases_are_counted():
    """A pair is counted once both words are known to be frequent, and only for a cycle."""
    words, ids = phrases.tokens(b"hot hot  cold hot hot. hot hot"), phrases.Ids()
    seq = np.array([ids[w] for w in words])
    of = lambda p: tuple((number(p) + [0, 0])[:3])

    def seen(scan, filters, seq):
        return {key: int(n) for keys, _, ns in phrases.count_chunk("en", ids, seq, scan, 3, filters) for key, n in zip(zip(*[k.tolist() for k in keys]), ns)}

    assert seen(0, phrases.Filters(1 << 10), seq) == {of(b"hot"): 6, of(b"cold"): 1}
    one = phrases.Filters(1 << 10)
    one.maps[1][1] = bitmap([b"hot"], 1 << 10)
    assert [seen(scan, one, seq).get(of(b"hot hot")) for scan in range(1, 7)] == [None, 3, 3, 3, None, None]
    one.maps[2][3] = bitmap([b"hot hot"], 4 << 10)
    hot = np.array([ids[b"hot"]] * 4)
    pair, triple = of(b"hot hot"), of(b"hot hot hot")
    assert [seen(scan, one, hot) for scan in (3, 4, 6, 7)] == [{pair: 3}, {pair: 3, triple: 2}, {triple: 2}, {}]


def test_bitmaps_agree_with_the_engine(spark):
    told = [b"x" * n + " é".encode() for n in range(1, 70, 3)]
    rows = [tuple(int(np.uint64(x).view(np.int64)) for x in number(p)) for p in told]
    df = spark.createDataFrame(rows, "a long, b long")
    assert (phrases._bitmap(df, F.col("a").bitwiseXOR(F.shiftrightunsigned("b", 20)), 1 << 10) == bitmap(told, 1 << 10)).all()


def test_words_with_one_number_are_numbered_anew(spark, rows, monkeypatch):
    df = spark.createDataFrame(rows[:60], "doc_id long, text string, lang string")
    want, seeds, real = brute(rows[:60]), [], phrases.frequent

    def bad(*args, **kwargs):
        seeds.append(args[7] if len(args) > 7 else kwargs.get("seed", 0))
        return real(*args, **kwargs)

    monkeypatch.setattr(phrases, "frequent", bad)
    counts = phrases.counted

    def patched(shard, scan, shards, filters, chunk):
        """The numbers of the first seed are spoilt."""
        out = counts(shard, scan, shards, filters, chunk)
        return out if filters.value.seed else out.withColumn("a", F.col("a").bitwiseAND(F.lit(3)))

    monkeypatch.setattr(phrases, "counted", patched)
    assert sorted(map(tuple, phrases.collocations(df).collect())) == want and seeds == [0, 1]


def test_scores_are_exact(spark):
    draw = random.Random(2)
    words, pairs = [], []
    for i in range(60):
        a = draw.randrange(10, 10 ** draw.randrange(2, 13))
        words += [(2 * i, "en", f"p{i}", a * draw.randrange(1, 9)), (2 * i + 1, "en", f"q{i}", a + draw.randrange(9))]
        pairs.append((2 * i, 2 * i + 1, a))
    counts = {p: n for _, _, p, n in words}
    make = spark.createDataFrame
    triples = make([], "a long, b long, c long, n long")
    two, _ = phrases.scored(phrases.Counts(make(words, "a long, lang string, word string, n long"), make(pairs, "a long, b long, n long"), triples, None))
    got = two.collect()
    for r in got:
        p, q = r.phrase.split()
        assert (r.l, r.r, r.score) == (counts[p], counts[q], 1_000_000 * r.a * r.a // (counts[p] * counts[q]))
    assert len(got) == 60
