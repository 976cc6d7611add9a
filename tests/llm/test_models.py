"""Quality, language, URLs: held-out accuracy on the driver tables, and edge cases."""

import math
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from newsfold.llm import langid, quality, url_filter
from newsfold.llm.queries import PIECES

SF = "/root/testdata/sf0.01"


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    own = [(got[i], q) for i, q in truth.items() if held(i)]
    assert all(r.held_out for r, _ in own) and all(0 <= r.score <= 1 for r in got.values())
    assert np.mean([r.predicted == q for r, q in own]) > 0.95
    none = docs.selectExpr("doc_id", "cast(null AS int) AS quality", "0 AS toxic")
    assert {r.score for r in quality.classify(docs.limit(20), none).collect()} == {0.5}


def test_quality_edges(spark):
    rows = [(1, None), (1, None), (2, ""), (None, "a b"), (3, "w " * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS score", "1 AS quality")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (3, 7), (None, 1)], "doc_id long, quality int")
    assert quality.classify(df, labels).count() == 5 and quality.classify(df.limit(0), labels).count() == 0


def test_isotonic():
    x, level = quality.isotonic(np.arange(6.0), np.array([0, 5, 1, 9, 8, 10.0]), np.full(6, 10.0))
    assert (np.diff(x) > 0).all() and (np.diff(level) > 0).all() and len(x) == 4


def test_isotonic_is_monotone_for_any_weights():
    draw = np.random.default_rng(12)
    cases = [([0, 1, 50], [1, 100, 100])]
    for _ in range(200):
        n = draw.integers(1, 9)
        weight = draw.integers(1, 100, n)
        cases.append((draw.integers(0, weight + 1), weight))
    for good, weight in cases:
        good, weight = np.array(good, float), np.array(weight, float)
        x, level = quality.isotonic(np.arange(float(len(good))), good, weight)
        assert (np.diff(level) > 0).all() and (np.diff(x) > 0).all() and 0 <= level.min() and level.max() <= 1
        mean = lambda a, b: good[a : b + 1].sum() / weight[a : b + 1].sum()
        best = [max(min(mean(a, b) for b in range(i, len(good))) for a in range(i + 1)) for i in range(len(good))]
        assert sorted(set(np.round(best, 9))) == pytest.approx(sorted(set(np.round(level, 9))))


def test_quality_against_plain_numpy(spark):
    """The whole fit again in one place: moments, random features, normal equations, calibration, scores."""
    draw = np.random.default_rng(3)
    rows = [(i, " ".join(draw.choice(["aa", "Bb!", "c|", "12", "the"], draw.integers(1, 60))) + ("!" * (i % 2) * 9)) for i in range(400)]
    df, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2 if i % 9 else 1 - i % 2) for i, _ in rows], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.classify(df, labels, features=32).collect()}
    part = {i: zlib.crc32(str(i).encode()) % 5 for i, _ in rows}
    y = {i: float(i % 2 if i % 9 else 1 - i % 2) for i, _ in rows}
    stats = {i: np.array(quality.statistics(t)) for i, t in rows}
    fitted, cal = [i for i in y if part[i] in (1, 2, 3)], [i for i in y if part[i] == 4]
    x = np.array([stats[i] for i in fitted])
    random = quality.Model(32)
    mean, scale = x.mean(0), np.maximum(x.std(0, ddof=1), 1e-6)

    def features(s):
        z = np.clip((s - mean) / scale, -8, 8)
        return np.concatenate([np.cos(z @ random.turn + random.shift) * np.sqrt(2 / 32), z / 4, np.ones((len(z), 1))], axis=1)

    f = features(x)
    w = np.linalg.solve(f.T @ f + np.eye(f.shape[1]), f.T @ np.array([y[i] for i in fitted]))
    raw = np.clip(features(np.array([stats[i] for i in cal])) @ w, -1, 2)
    bins = np.floor((raw + 1) / 3 * 1000).astype(int)
    each = sorted(set(bins.tolist()))
    truth = np.array([y[i] for i in cal])
    knots, levels = quality.isotonic(*(np.array([g(bins == b) for b in each]) for g in (lambda m: raw[m].mean(), lambda m: truth[m].sum(), lambda m: float(m.sum()))))
    score = np.interp(features(np.array([stats[i] for i, _ in rows])) @ w, knots, levels)
    assert all(got[i].score == pytest.approx(s, abs=1e-6) and got[i].predicted == int(got[i].score >= 0.3) for (i, _), s in zip(rows, score))


def test_only_letters_are_letters():
    assert langid.words_of("½ Ⅷ ² 12 _") == [] and langid.words_of("Aé½b ñ²") == ["aé", "b", "ñ"]


def test_long_words_learn_and_score_alike():
    pieces = ["▁", "a", "b", "ab", "▁ab"]
    seg = langid.Segments(pieces)
    prob = np.random.default_rng(6).uniform(0.01, 0.2, (seg.size, 2))
    prob[-1] = 1e-7
    for n in (5, 40, 70, 128, 200, 1_000):
        words = ["ab" * n, "a" * n, "z" * n, "abz" * n]
        assert np.allclose(seg.scores(words, prob), [seg._long("▁" + w, prob) for w in words])
    made = seg.expected(["ab" * 300, "ba" * 40, "b"], np.array([1.0, 2.0, 3.0]), prob[:, :1])
    letters = sum(made[i] * len(p) for i, p in enumerate(pieces)) + made[-1]
    assert letters == pytest.approx(601 + 2 * 81 + 3 * 2)


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in langid.identify(docs, langid.read_pieces(P.path(PIECES))).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert np.mean([got[i].lang_pred == t for i, t in truth.items() if held(i)]) > 0.97


def test_language_edges(spark):
    pieces = ["▁", "▁the", "▁de", "t", "h", "e", "d", "a", "r"]
    rows = [(1, "the the there", "en"), (2, "de der da", "de"), (3, None, "en"), (4, "12 !", "de"), (5, "", None), (None, "the", "en"), (6, "e" * 70_000, None), (7, "the", "en"), (7, "the", "en"), (8, "da de", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' AS score")
    got = langid.identify(df, pieces).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 10 and by[3].lang_pred == by[4].lang_pred == by[5].lang_pred == "und" and by[6].lang_pred in ("en", "de")
    kept = langid.accepted(df, pieces)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect() if r.doc_id != 6) == ["1", "2", "7", "7", "8", "None"]
    assert langid.identify(df.limit(0), pieces).count() == 0
    assert {r.lang_pred for r in langid.identify(df.selectExpr("doc_id", "text", "cast(null AS string) AS lang"), pieces).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "aba"]
    seg = langid.Segments(pieces)
    prob = np.random.default_rng(2).uniform(0.01, 0.2, (seg.size, 2))

    def brute(word):
        if not word:
            return np.ones(2)
        total = np.zeros(2)
        for k in range(1, len(word) + 1):
            number = seg.number.get(word[:k], seg.size - 1 if k == 1 else -1)
            if number >= 0:
                total += prob[number] * brute(word[k:])
        return total

    words = ["abab", "baab", "b", "zzab"]
    assert np.allclose(seg.scores(words, prob), np.log([brute("▁" + w) for w in words]))
    assert np.allclose(seg._long("▁" + "ab" * 6, prob), np.log(brute("▁" + "ab" * 6)))


URLS = [
    ("http://A.ORG/x", "a.org", "/x", "org/", "allow"), ("http://org", "org", "", None, None), ("https://m.example.org/es/1?q", "m.example.org", "/es/1", "example.org/es/", "block"), ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
    ("http://x.com/fr/", "x.com", "/fr/", "com/fr/", "allow"), ("http://x.com/de/#f", "x.com", "/de/", "com/de/", "block"), ("http://borg/x", "borg", "/x", None, None), ("no scheme", "", "", None, None), (None, "", "", None, None), ("x://h?p/y", "h", "", None, None), ("http://É.org/", "É.org", "/", "org/", "allow"),
]


def test_url_rules(spark):
    df = spark.createDataFrame([(i, u[0]) for i, u in enumerate(URLS)], "page_id long, url string").selectExpr("*", "'x' AS host")
    got = {r.page_id: r for r in url_filter.judge(df).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule) and got[i].verdict in ("allow", "block") and (verdict is None or got[i].verdict == verdict)
    assert url_filter.judge(df.limit(0)).count() == 0


def test_url_model_learns(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rules = [("allow", "com", "/"), ("allow", "org", "/"), ("block", "com", "/es/"), ("block", "org", "/es/")]
    got = [r for r in url_filter.judge(pages, rules).collect() if r.rule is None]
    blocked = lambda rows: np.mean([r.verdict == "block" for r in rows])
    assert blocked([r for r in got if r.path.startswith("/es/")]) > blocked([r for r in got if not r.path.startswith("/es/")]) + 0.3


def test_url_ratio_is_the_interpolated_one():
    counts = np.random.default_rng(1).integers(0, 9, (2, 64)).astype(np.float32)
    owner, seen, both = url_filter.contexts(["ab"], 2, 64)
    want = 0.0
    for row in range(len(owner)):
        ps = []
        for m in counts:
            p = 1 / 256
            for k in range(3):
                p = (min(m[both[row, k]], m[seen[row, k]]) + 4 * p) / (m[seen[row, k]] + 4)
            ps.append(p)
        want += math.log(ps[0]) - math.log(ps[1])
    assert url_filter.ratios(["ab"], counts, 2)[0] == pytest.approx(want / len(owner), rel=1e-5)


def test_url_counts_are_exact(spark):
    """More distinct contexts than any fixed number of slots would hold: ratios equal those of plain dictionaries."""
    rng = np.random.default_rng(5)
    urls = ["http://x.%s/%s" % (rng.choice(["org", "com", "net"]), bytes(rng.integers(33, 127, 40, dtype=np.uint8)).decode().replace("?", "a").replace("#", "b")) for _ in range(6_000)]
    rules = [("allow", "org", "/"), ("block", "com", "/")]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [(urls[r.page_id], r.ratio) for r in url_filter.judge(df, rules).collect() if r.rule is None]
    counts = [{}, {}]
    for u in set(urls):
        kind = {"http://x.org": 0, "http://x.com": 1}.get(u[:12])
        if kind is not None and zlib.crc32(u.encode()) % 5:
            data = b"\x02" * 5 + u.encode() + b"\x03"
            for i in range(5, len(data)):
                for k in range(6):
                    for key in (("c", data[i - k : i]), ("b", data[i - k : i + 1])):
                        counts[kind][key] = counts[kind].get(key, 0) + 1
    assert len(counts[0]) > 1 << 18
    total = [m["c", b""] for m in counts]
    assert got
    for u, ratio in got[:300]:
        data = b"\x02" * 5 + u.encode() + b"\x03"
        want = 0.0
        for i in range(5, len(data)):
            for m, t, sign in zip(counts, total, (1, -1)):
                p = 1 / 256
                for k in range(6):
                    p = (m.get(("b", data[i - k : i + 1]), 0) * min(total) / t + 4 * p) / (m.get(("c", data[i - k : i]), 0) * min(total) / t + 4)
                want += sign * math.log(p)
        assert ratio == pytest.approx(want / (len(data) - 5), abs=1e-8)


def test_language_pieces_of_all_lengths():
    pieces = langid.read_pieces(P.path(PIECES))
    assert max(map(len, pieces)) > 9
    seg = langid.Segments(["▁", "a", "b", "abababababab"])
    prob = np.array([[0.1, 0.2], [0.01, 0.03], [0.02, 0.01], [0.3, 0.001], [1e-7, 1e-7]])
    assert np.allclose(seg.scores(["ab" * 6], prob)[0], np.log([0.1 * (0.3 + 0.0002**6), 0.2 * (0.001 + 0.0003**6)]))
    for n in (30, 50, 63, 64, 500):  # no floor at any length
        assert np.allclose(seg.scores(["z" * n], prob)[0], np.log(prob[0]) + n * np.log(1e-7))


def test_language_learns_from_long_words():
    seg = langid.Segments(["▁", "a", "b", "ab"])
    prob = np.array([[0.2], [1e-6], [1e-6], [1e-7], [1e-7]])
    for n in (1, 20, 40, 200):
        got = seg.expected(["ab" * n], np.array([3.0]), prob)
        both = 1e-7 / (1e-7 + 1e-12)
        assert np.allclose(got, 3 * np.array([1, n * (1 - both), n * (1 - both), n * both, 0]))


def test_language_list_is_of_all_rows(spark):
    rows = [(i, "the there", "en") for i in range(400)] + [(400 + i, "da dar", "de") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    pieces = ["▁", "▁the", "▁da", "t", "h", "e", "d", "a", "r"]
    got = langid.identify(df, pieces, sample=5).collect()
    assert {r.lang_pred for r in got if r.doc_id >= 400} == {"de"}
