"""Text, feeds, copies, memory, feedback on small cases."""

import datetime
import difflib
import html
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from newsfold.functions import facts as X
from newsfold.functions import likeness as K
from newsfold.functions import text as T
from newsfold.operators import dedup as D
from newsfold.operators import feedback as B
from newsfold.operators import memory as M
from newsfold.operators import ops as O
from newsfold.operators import report as Rp
from newsfold.plans import articles  # noqa: F401  (it registers its queries)
from newsfold.plans.registry import QUERIES
from newsfold.scale import carried, connected_components, global_rank, running_total, spread_hot
from newsfold.sources import feeds as S
from newsfold.sources import tables as Tb


def one(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_normal_form(spark):
    texts = ["<p>“Bitcoin” — ETF&nbsp;inflow: $1,200,000…</p>", "Read more: here\nBody, text (x) ２％", "see https://a.b/c?d now", None]
    got = one(spark, *[T.normalize_for_hash(F.lit(t).cast("string")) for t in texts])
    assert got == ["bitcoin - etf inflow: $1200000...", "body text x 2%", "see __url__ now", ""]
    assert one(spark, T.normalize_title(F.lit("SEC Approves “ETF”?  Yes!"))) == ["sec approves etf ? yes!"]


def test_urls(spark):
    urls = ["HTTP://www.A.com:80/x/?utm_source=q&b=2&a=&ref=z#f", "a.com/y", "https://a.com/p/amp/", "https://a.com", ""]
    got = one(spark, *[T.canonical_url(F.lit(u)) for u in urls])
    assert got == ["http://a.com/x?b=2", "https:a.com/y", "https://a.com/p", "https://a.com/", ""]


def test_feed_text(spark):
    html = "<script>x</script><p>One &amp;amp; two</p><div>Share this now</div>​Three"
    assert one(spark, T.strip_html_feed(F.lit(html))) == ["One & two\nThree"]
    assert one(spark, T.clean_text(F.lit("A short story. The post A appeared first on B."))) == ["A short story."]
    long = "Word word. " * 100
    cut = one(spark, T.clean_text(F.lit(long), 100))[0]
    assert len(cut) <= 100 and cut.endswith("word.")
    assert one(spark, T.clean_title(F.lit("Big news | The Block")), T.looks_like_prose(F.lit("123 456 789 0"))) == ["Big news", False]


def test_redaction(spark):
    got = one(spark, T.redact(F.lit("key gsk_abcdefghijkl123 end")))[0]
    assert "gsk_abcdefghijkl123" not in got and got.startswith("key gsk_ab…l123#") and got.endswith(" end")


def test_facts(spark):
    head = F.lit("The SEC approves BlackRock Bitcoin ETF filing worth $1.5 billion, up 7%")
    got = one(spark, X.detect_event_type(head), X.leading_noun(head), X.detect_assets(head), X.leading_verb(head), X.detect_amount(head), X.detect_percentage(head))
    assert got == ["ETF_APPROVAL", "The SEC", ["BTC"], "APPROVES", 1.5e9, 7.0]


IDENTITIES = [
    (("regulatory", "securities and exchange commission", "btc", "approve", "blackrock etf"), ("regulatory", "sec", "btc", "approve", "blackrock etf"), True),
    (("etf_approval", "sec", "btc", "approves", "blackrock spot etf"), ("etf_approval", "sec", "bitcoin", "approved", "blackrocks spot etf"), True),
    (("etf_approval", "sec", "btc", "approve", "blackrock etf"), ("etf_approval", "sec", "btc", "approve", "fidelity etf"), False),
    (("enforcement", "sec", "btc", "fine", ""), ("enforcement", "cftc", "btc", "fine", ""), False),
    (("hack", "binance", "btc", "hack", ""), ("hack", "binance", "eth", "hack", ""), False),
]


NO_WORDS = set(K.GENERIC)


def plain_ratio(a, b):
    """The rule for two names as a loop over the cases."""
    if a == b:
        return 1.0
    if not (a and b):
        return 0.0
    x, y = a.split(), b.split()
    for one, many in ((x, y), (y, x)):
        if len(one) == 1 < len(many):
            forms = ["".join(w[0] for w in many), "".join(w[0] for w in many if w not in K.SMALL_WORDS)]
            if any(len(f) > 1 and f == one[0].replace(".", "") for f in forms):
                return 1.0
    if len(x) == len(y) == 1 and min(len(a), len(b)) > 4 and (a in b or b in a):
        return 0.9
    x, y = set(x), set(y)
    best = difflib.SequenceMatcher(None, a, b).ratio()
    best = max(best, len(x & y) / len(x | y))
    return max(best, 0.85) if x <= y or y <= x else best


def plain_match(left, right):
    if left == right:
        return True, 1.0, ""
    form = lambda s: " ".join(re.sub(K.CORPORATE, " ", s).split())
    ticker = {"bitcoin": "BTC", "btc": "BTC", "eth": "ETH", "": ""}
    values = {k: (left[k], right[k]) if k != "entity" else (form(left[k]), form(right[k])) for k in K.WEIGHTS}

    def compete(a, b):
        special = [{w for w in s.split() if len(w) > 3 and w not in NO_WORDS} for s in (a, b)]
        if not all(special) or (plain_ratio(a, b) == 1.0 and len(a.split()) != len(b.split())):
            return False
        return all(any(max(plain_ratio(w, v) for v in there) < 0.8 for w in here) for here, there in (special, special[::-1]))

    found = ""
    if all(values["asset"]) and len({ticker[x] for x in values["asset"]}) == 2:
        found = "asset"
    elif compete(*values["entity"]) or (all(len(x.split()) == 1 for x in values["entity"]) and plain_ratio(*values["entity"]) < 0.8):
        found = "entity"
    elif compete(*values["target"]):
        found = "target"
    used = [k for k in K.WEIGHTS if any(values[k])]
    score = sum(K.WEIGHTS[k] * plain_ratio(*values[k]) for k in used) / sum(K.WEIGHTS[k] for k in used) if used else 0.0
    return (False, 0.0, found) if found else (score >= 0.82, score, "")


def identities_of(draw):
    pick = lambda *x: draw.choice(x)
    return {
        "event_type": pick("regulatory", "etf_approval", ""), "entity": pick("sec", "securities and exchange commission", "s.e.c", "cftc", "blackrock inc", "blackrock", "blackrocks", "the sec", ""),
        "asset": pick("btc", "bitcoin", "eth", ""), "action": pick("approve", "approves", "fine", ""), "target": pick("blackrock etf", "fidelity etf", "spot etf of blackrocks", "strategy", "microstrategy", "doj", "department of justice", ""),
    }


def test_identities_against_a_loop(spark):
    draw = random.Random(4)
    pairs = [tuple(dict(zip(K.WEIGHTS, x)) for x in case[:2]) for case in IDENTITIES] + [(identities_of(draw), identities_of(draw)) for _ in range(600)]
    kind = "struct<" + ",".join(f"{k}:string" for k in K.WEIGHTS) + ">"
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], f"i int, a {kind}, b {kind}")
    both = K.identity_match(K.identity_match(df, "a", "b", "m"), "b", "a", "w")
    got = {r.i: r for r in both.select("i", "m", "w", K.string_ratio(F.col("a.entity"), F.col("b.entity")).alias("r")).collect()}
    for i, (a, b) in enumerate(pairs):
        same, score, found = plain_match(a, b)
        assert (got[i].m.same, got[i].m.score, got[i].m.conflict, got[i].r) == (same, pytest.approx(score), found, pytest.approx(plain_ratio(a["entity"], b["entity"]))), (a, b)
        assert got[i].w.same is same
    assert [got[i].m.same for i in range(len(IDENTITIES))] == [x[2] for x in IDENTITIES]


@pytest.mark.parametrize("cells", [100_000, 60])
def test_likeness_of_many_pairs_at_once(cells):
    draw = random.Random(cells)
    letters = ["ab", "abc ", "abcdefghij é", "xyz😀"]
    pairs = [tuple("".join(draw.choices(some, k=draw.randrange(30))) for _ in range(2)) for some in letters * 400]
    for some in ("ab", "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") * 25:  # long texts, some full of one character
        text = draw.choices(some, k=draw.randrange(150, 400))
        other = [draw.choice(some) if draw.random() < 0.1 else c for c in text][draw.randrange(40) :]
        pairs.append(("".join(text), "".join(other)))
    pairs += [("", ""), ("", "a"), ("a", ""), pairs[0], pairs[0]]
    want = [difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    assert K.likenesses(*map(list, zip(*pairs)), cells).tolist() == want
    assert K.likenesses([], []).tolist() == []


def test_prices_without_an_asset(spark):
    prices = spark.sql("SELECT * FROM VALUES ('A', timestamp'2024-01-01 10:00:00', 1L, 5.0D), (NULL, timestamp'2024-01-01 10:00:00', 2L, 7.0D) AS t(asset, at, seq, price)")
    keys = spark.sql("SELECT * FROM VALUES (1, 'A', timestamp'2024-01-03 00:00:00'), (2, NULL, timestamp'2024-01-01 11:00:00'), (3, 'B', timestamp'2024-01-01 11:00:00'), (4, 'A', timestamp'2024-01-01 09:00:00') AS t(key_id, asset, at)")
    assert {r.key_id: r.price for r in B.price_asof(keys, prices).collect()} == {1: 5.0, 2: None, 3: None, 4: None}


def test_matching_against_a_loop(spark):
    draw = random.Random(9)
    rows = [(i, draw.randrange(40), identities_of(draw)) for i in range(150)]
    pairs = {(draw.randrange(150), draw.randrange(150)): round(draw.uniform(0.86, 1), 4) for _ in range(400)}
    rows += [(150 + i, 60 + i % 3, rows[0][2]) for i in range(60)]  # one key holds much
    face = {i: x for i, _, x in rows}
    event, begun = {}, {}
    for i, at, x in sorted(rows, key=lambda r: (r[1], r[0])):
        key = tuple(x.values())
        if key not in begun:
            for s, other in sorted(((-s, b) for (a, b), s in pairs.items() if a == i and b in event)):
                same, score, _ = plain_match(x, face[event[other]])
                if same or (-s >= 0.97 and score >= 0.6):
                    event[i] = event[other]
                    break
            else:
                event[i] = begun[key] = i
        else:
            event[i] = begun[key]
    df = spark.createDataFrame([(i, at, *x.values()) for i, at, x in rows], "id long, at int, " + ", ".join(f"{k} string" for k in K.WEIGHTS))
    similar = spark.createDataFrame([(a, b, s) for (a, b), s in pairs.items()], "id long, match_id long, similarity double")
    got = {r.id: r.event_id for r in M.match_events(df, similar).collect()}
    assert got == event and len(set(event.values())) < 150
    assert M.match_events(df.limit(0), similar.limit(0)).count() == 0


def test_claims_against_a_loop(spark):
    draw = random.Random(3)
    rows = [(draw.choice("ef"), i, f"2024-01-01 00:{i % 60:02d}:00", [draw.choice([f"claim number {draw.randrange(40)} stands", "securities exchange", "se", "", None, f"word{draw.randrange(9)}long"]) for _ in range(draw.randrange(4))] if i % 9 else None) for i in range(150)]
    known, want = {}, {}
    for e, i, at, claims in sorted(rows, key=lambda r: (r[2], r[1])):
        first, fresh = e not in known, 0
        own = known.setdefault(e, [])
        for c in claims or []:
            if c and all(plain_ratio(c, k) < 0.85 for k in own):
                fresh += 1
                if len(own) < 20:
                    own.append(c)
        want[i] = (fresh, not first and fresh > 1)
    df = spark.createDataFrame(rows, "event_key string, id long, at string, claims array<string>").withColumn("at", F.col("at").cast("timestamp"))
    assert {r.id: (r.new_claims, r.material) for r in M.fold_claims(df).collect()} == want


def test_related_against_a_loop(spark):
    draw = random.Random(6)
    rows = [(i, draw.choice("xy"), draw.choice(["", "A", "B"]), f"2024-01-{draw.randrange(1, 20):02d} {draw.randrange(3):02d}:00:00") for i in range(220)]
    want = set()
    for i, kind, asset, at in rows:
        when = datetime.datetime.fromisoformat(at)
        fit = [(t, j) for j, k, a, t in rows if j != i and k == kind and (a == asset or not a or not asset) and t <= at and datetime.datetime.fromisoformat(t) >= when - datetime.timedelta(days=4)]
        want |= {(i, j, n + 1) for n, (_, j) in enumerate(sorted(fit, reverse=True)[:5])}
    df = spark.createDataFrame(rows, "event_id long, event_type string, asset string, last_seen string").withColumn("last_seen", F.col("last_seen").cast("timestamp"))
    assert {tuple(r) for r in M.related_events(df, 4).collect()} == want


def test_related_in_parts(spark, monkeypatch):
    """Events of one moment are dealt over parts of bounded size, and none are sorted again after they met what was found for them."""
    monkeypatch.setattr(M, "spread_hot", lambda *a: spread_hot(*a, rows=20))
    rows = [(i, "x", "A", 5) for i in range(150)] + [(200 + i, "x", "" if i % 2 else "B", i) for i in range(12)]
    want = set()
    for i, _, asset, day in rows:
        fit = sorted(((d, j) for j, _, a, d in rows if j != i and (a == asset or not a or not asset) and day - 4 <= d <= day), reverse=True)[:5]
        want |= {(i, j, n + 1) for n, (_, j) in enumerate(fit)}
    df = spark.createDataFrame(rows, "event_id long, event_type string, asset string, day int").selectExpr("event_id", "event_type", "asset", "timestamp'2024-01-01' + make_dt_interval(day) AS last_seen")
    found = M.related_events(df, 4)
    assert {tuple(r) for r in found.collect()} == want
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    dealt, hot = spread_hot(df, ["event_type", "asset", "last_seen"], "event_id", "part", rows=20)
    assert [r["_parts"] for r in hot.collect()] == [8]
    sizes = {r["part"]: r["count"] for r in dealt.where("asset = 'A'").groupBy("part").count().collect()}
    assert len(sizes) == 8 and max(sizes.values()) < 60 and sum(sizes.values()) == 150


def test_components(spark):
    draw = random.Random(2)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1100)] + [(None, 5)]
    up = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in up}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_running_totals(spark):
    rows = [(i, "hot" if i % 5 else f"k{i % 3}", i % 7) for i in range(3000)] + [(9000, None, 2)]
    df = spark.createDataFrame(rows, "id long, k string, v long").withColumn("o", F.xxhash64("id"))
    got = {r.id: r for r in running_total(df, ["k"], "o", "v", group_rows=50).collect()}
    for key in {"hot", "k0", "k1", "k2", None}:
        total = 0
        for r in sorted((r for r in got.values() if r.k == key), key=lambda r: r.o):
            assert r.before == total
            total += r.v
    ranks = global_rank(spark.createDataFrame([(x,) for x in "cadb"], "s string"), "s").collect()
    assert {r.s: r["rank"] for r in ranks} == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_carried(spark):
    draw = random.Random(5)
    rows = [("k%d" % draw.randrange(2), i, draw.choice([None, float(i)]), draw.randrange(9)) for i in range(200)]
    got = carried(spark.createDataFrame(rows, "k string, t long, v double, r int"), ["k"], ["t"], F.expr("t div 16"), {"last_v": "v"}, {"top": "r"}).collect()
    for r in got:
        before = [x for x in rows if x[0] == r.k and x[1] < r.t]
        known = [x[2] for x in before if x[2] is not None]
        assert r.last_v == (known[-1] if known else None) and r.top == max((x[3] for x in before), default=None)


def test_greedy_dedup_against_a_loop(spark):
    draw = random.Random(8)
    rows = [(i, str(draw.randrange(40)), draw.choice(["", None, str(draw.randrange(60))]), i) for i in range(120)]
    seen, want = set(), {}
    for i, a, b, _ in rows:
        keys = {("a", a)} | ({("b", b)} if b else set())
        want[i] = not (keys & seen)
        seen |= keys if want[i] else set()
    got = D.greedy_dedup(spark.createDataFrame(rows, "id long, a string, b string, at int"), ["a", "b"], "at").collect()
    assert {r.id: r.kept for r in got} == want


def test_event_states(spark):
    rows = [("e", 1, "2024-01-01 00:00:01", 742e6, "reported"), ("e", 2, "2024-01-01 01:00:00", 740e6, "confirmed"), ("e", 3, "2024-01-01 02:00:00", 741e6, "announced"), ("e", 4, "2024-01-02 02:00:00", 1.2e9, "reported"), ("f", 5, "2024-01-02 02:00:00", None, "")]
    df = spark.createDataFrame(rows, "event_key string, id long, at string, amount double, status string").withColumn("at", F.col("at").cast("timestamp"))
    assert {r.id: r.decision for r in M.diff_states(df).collect()} == {1: "NEW", 2: "UPDATE", 3: "DUPLICATE", 4: "UPDATE", 5: "NEW"}


def plain_states(rows):
    """A loop over articles in order: what changed, and the state that their event comes to."""
    ranks = {"": 0, "reported": 3, "confirmed": 5, "announced": 5, "denied": 7}
    numbers, texts = M.NUMBERS, M.TEXTS
    state, out = {}, {}
    for r in sorted(rows, key=lambda r: (r["at"], r["id"])):
        told = {k: v for k, v in r.items() if k in (*numbers, *texts, "status") and v not in (None, "")}
        fresh = [c for c in r["claims"] or [] if c]
        if r["event_key"] not in state:
            state[r["event_key"]] = {**told, "claims": fresh}
            out[r["id"]] = ("NEW", [], 0)
            continue
        old = state[r["event_key"]]
        changed = []
        for n in numbers:
            a, b = old.get(n), r[n]
            if (a is None) != (b is None) or (a is not None and a != b and abs(a - b) / max(abs(a), abs(b)) > 0.05):
                changed.append(n)
        rank = lambda x: ranks[x.get("status") or ""]
        if told.get("status") and rank(told) != rank(old):
            changed.append("status")
        changed += [t for t in texts if told.get(t) and told[t] != old.get(t) and (not old.get(t) or plain_ratio(old[t], told[t]) < 0.9)]
        new = [c for c in fresh if all(plain_ratio(c, k) < 0.85 for k in old["claims"])]
        out[r["id"]] = ("UPDATE" if changed or len(new) >= 2 else "DUPLICATE", changed, len(new))
        if rank(told) < rank(old):
            told.pop("status", None)
        state[r["event_key"]] = {**old, **told, "claims": old["claims"] + new}
    return out, state


def test_full_states_against_a_loop(spark):
    draw = random.Random(12)
    words = {"ruling": ["approved by the board", "approved by the boards", "rejected", ""], "location": ["London", "Tokyo", None], "time_reference": ["", None, "late on monday"], "event_date": ["2024-01-01", "2025-11-20", ""]}
    stories = ["the court hears the case", "reserves fell by a third", "users were paid back", "keys were stolen at night", "trading was halted"]
    rows = []
    for i in range(160):
        settled = i % 2  # half of the articles tell what stays the same
        row = {"event_key": draw.choice("efg"), "id": i, "at": f"2024-01-0{1 + i // 60} {draw.randrange(24):02d}:00:00", **{n: 100.0 + draw.randrange(3) if settled else draw.choice([None, 100.0, 120.0]) for n in M.NUMBERS}}
        row |= {t: v[0] if settled else draw.choice(v) for t, v in words.items()}
        rows.append(row | {"status": "confirmed" if settled else draw.choice(["reported", "confirmed", "announced", "denied", ""]), "claims": draw.sample(stories, 1 + (i % 5 == 0)) if i % 7 else None})
    kinds = "event_key string, id long, at string, " + ", ".join(f"{n} double" for n in M.NUMBERS) + ", " + ", ".join(f"{t} string" for t in M.TEXTS) + ", status string, claims array<string>"
    df = spark.createDataFrame([tuple(r.values()) for r in rows], kinds).withColumn("at", F.col("at").cast("timestamp"))
    decided = M.diff_states(df)
    want, state = plain_states(rows)
    fields = [*M.NUMBERS, "status", *M.TEXTS]
    got = {r.id: (r.decision, [f for f in fields if r[f"changed_{f}"]], 0 if r.first else r.new_claims) for r in decided.collect()}
    assert got == want and {x[0] for x in want.values()} == {"NEW", "UPDATE", "DUPLICATE"}
    for r in M.events_rollup(decided).collect():
        assert {f: r[f] for f in fields if r[f] not in (None, "")} == {f: v for f, v in state[r.event_key].items() if f != "claims"}
        assert r.key_claims == state[r.event_key]["claims"]
    assert M.events_rollup(M.diff_states(df.limit(0))).count() == 0
    told = {r.id: r.summary for r in M.diff_summary(decided).collect()}
    assert all(told[i] == "no change" for i, x in want.items() if x == ("DUPLICATE", [], 0)) and any("decision: 'approved by the board' -> 'rejected'" in s for s in told.values())


def test_similar_and_match(spark):
    rows = [(1, "2024-01-01", [1.0, 0.0]), (2, "2024-01-02", [0.99, 0.05]), (3, "2024-01-20", [1.0, 0.0]), (4, "2024-01-03", [0.0, 0.0]), (5, "2024-01-03", None)]
    v = spark.createDataFrame(rows, "id long, at string, v array<double>").withColumn("at", F.col("at").cast("timestamp"))
    got = M.find_similar(v, v, block=1).collect()
    assert [(r.id, r.match_id) for r in got] == [(2, 1)]
    facts = v.selectExpr("id", "at", "'hack' AS event_type", "'binance' AS entity", "CASE WHEN id = 3 THEN 'ETH' ELSE 'BTC' END AS asset", "CASE WHEN id = 2 THEN 'hacked' ELSE 'hack' END AS action", "'' AS target")
    linked = M.match_events(facts, spark.createDataFrame([(2, 1, 0.99)], "id long, match_id long, similarity double")).collect()
    assert {r.id: r.event_id for r in linked} == {1: 1, 2: 1, 3: 3, 4: 1, 5: 1}


def test_scoring(spark):
    cases = [(1, "BULLISH", 3.0, 7.5, 180, {180: 0.02}), (2, "BEARISH", 3.0, 7.5, 180, {180: -5.0}), (3, "BULLISH", 1.0, 2.0, 180, {60: 1.5, 180: 1.6, 360: 1.7}), (4, "BULLISH", 1.0, 2.0, 60, {60: -1.5, 180: 1.9})]
    p = spark.createDataFrame([c[:5] for c in cases], "id long, direction string, expected_low double, expected_high double, horizon_minutes int")
    o = spark.createDataFrame([(c[0], k, v) for c in cases for k, v in c[5].items()], "id long, offset int, pct double")
    got = {r.id: r for r in B.score_predictions(p, o).collect()}
    assert not got[1].direction_correct and not got[1].moved
    assert got[2].direction_correct and got[2].magnitude_error == 0 and got[2].score == 1.0
    assert got[3].best_horizon_minutes == 180 and got[4].best_horizon_minutes == 180 and got[4].score < 0.65


def test_ranking(spark):
    df = spark.createDataFrame([("a", 3, 3), ("b", 200, 150), ("c", 0, 0)], "model_id string, predictions long, direction_correct long")
    assert [r.model_id for r in B.rank_models(df).collect()] == ["b", "a"]


def test_key_health(spark):
    rows = [(i, "g", 0, f"2024-01-01 00:0{i}:00", s, b, 10) for i, (s, b) in enumerate([(200, ""), (429, "rate limit, try again in 90s"), (500, ""), (404, "")])]
    log = spark.createDataFrame(rows, "id long, provider string, key_index int, ts string, status int, body string, latency_ms long").withColumn("ts", F.col("ts").cast("timestamp"))
    r = O.key_health(log).first()
    assert (r.status, r.success, r.failure, r.consecutive_failures, r.cooldown_seconds) == ("cooling", 1, 2, 2, 40.0)


ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>Wire</title><entry><title>First &amp; last</title><link rel="replies" href="https://a/r"/><link href="https://a/1"/>
<summary>Short.</summary><content type="html">&lt;p&gt;A longer body that reads as prose.&lt;/p&gt;</content><updated>2024-01-02T03:04:05Z</updated></entry><entry><title></title></entry></feed>"""


def test_feeds(spark):
    df = spark.createDataFrame([("https://f/x", ATOM), ("https://f/y", "junk"), ("https://f/z", None)], "feed_url string, payload string").withColumn("fetched_at", F.lit("2024-01-03").cast("timestamp"))
    (r,) = S.feed_articles(df).collect()
    assert (r.title, r.url, r.body, r.source, str(r.published_at)) == ("First & last", "https://a/1", "A longer body that reads as prose.", "Wire", "2024-01-02 03:04:05")
    dates = ["Tue, 02 Jan 2024 03:04:05 +0200", "Tue, 2 Jan 2024 03:04:05 GMT", "2024-01-02", "soon", None]
    got = [str(x) for x in one(spark, *[S.parse_feed_date(F.lit(d).cast("string")) for d in dates])]
    assert got == ["2024-01-02 01:04:05", "2024-01-02 03:04:05", "2024-01-02 00:00:00", "None", "None"]


def test_upsert(spark):
    t = spark.createDataFrame([(1, 5, "a"), (2, 5, "b")], "k long, n long, s string")
    u = spark.createDataFrame([(2, 3, "c", 1), (2, 9, None, 2), (3, 1, "d", 1)], "k long, n long, s string, o int")
    got = {r.k: (r.n, r.s) for r in Tb.upsert(t, u, ["k"], {"n": "max", "s": "new"}, "o").collect()}
    assert got == {1: (5, "a"), 2: (9, "b"), 3: (1, "d")}


def test_split_messages(spark):
    text = "a" * 3000 + "\n\n" + "b" * 3000 + "\n" + "c" * 5000
    df = spark.createDataFrame([(1, text), (2, "short"), (3, None)], "id long, message string")
    parts = [r.part_text for r in Rp.split_messages(df).orderBy("id", "part").where("id = 1").collect()]
    assert all(len(p) <= 4096 for p in parts) and "".join(parts) == text.replace("\n", "")


def test_append_and_candles(spark, tmp_path):
    from newsfold.functions import values as V

    rows = spark.createDataFrame([(1, "2024-01-01 10:00:00"), (2, "2024-01-02 10:00:00")], "id long, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    for _ in range(2):
        Tb.append(rows, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).where("date = '2024-01-02'").count() == 2
    assert one(spark, V.candle_midpoint(F.lit(4.0), F.lit(2.0)), V.move_since(F.lit(50.0), F.lit(55.0)), V.move_since(F.lit(0.0), F.lit(5.0))) == [3.0, pytest.approx(10.0), 0.0]


def test_greedy_dedup_query_takes_whole_texts(spark, tmp_path):
    texts = ["Rates\nThe central bank raised rates.", "Rates\nThe central bank cut its staff.", "RATES\n<p>the central bank raised   rates.</p>", "One line", "Another line", "Rates\nThe central bank raised rates."]
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.id for r in QUERIES["w2_greedy_dedup"](spark, str(tmp_path)).collect() if r.kept} == {0, 1, 3, 4}


def test_items_do_not_carry_their_payload(spark):
    """Of a payload with n items, no row of an item holds the payload: rows and work grow with the items, not with their square."""
    df = spark.createDataFrame([("https://f/1", "<rss><channel><title>Feed</title>" + "<item><title>A long title</title></item>" * 3 + "</channel></rss>", None)], "feed_url string, payload string, fetched_at timestamp")
    out = S.feed_articles(df)
    (cut,) = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate posexplode" in line]
    above = out._jdf.queryExecution().optimizedPlan().toString().split(cut)[0]
    assert "payload" not in cut and "payload" not in above
    assert [r.source for r in out.collect()] == ["Feed"] * 3


def test_identity_pairs_are_bounded_by_identities(spark, tmp_path):
    """Copies of parts add one row each, and pairs of parts of one size are as alike as their classes."""
    part = [(k, f"{'large' if k % 2 else 'small'} {'ring' if k % 5 else 'bolt'}", f"Brand#{k % 4}", "STEEL", k % 3) for k in range(24)]
    names = "p_partkey long, p_name string, p_brand string, p_type string, p_size int"
    found = {}
    for times in (1, 4):
        rows = [(k + 24 * 3 * r, *rest) for r in range(times) for k, *rest in part]
        folder = str(tmp_path / str(times))
        spark.createDataFrame(rows, names).write.parquet(f"{folder}/part.parquet")
        out = QUERIES["v3_v7_identity_pairs"](spark, folder).collect()
        found[times] = {(r.p_partkey, r.other): (r.same, r.score, r.conflict, r.ratio) for r in out if not r.copy}
        of = {r.other: r.p_partkey for r in out if r.copy}
        assert len(of) == len(rows) - len({of.get(k, k) for k, *_ in rows})
        key = {k: tuple(rest) for k, *rest in rows}
        for a in key:
            for b in key:
                x, y = sorted((of.get(a, a), of.get(b, b)))
                if a < b and x != y and key[a][3] == key[b][3] and set(key[a][0].split()) & set(key[b][0].split()):
                    assert (x, y) in found[times]
    assert found[1] == found[4] and found[1]


def test_prompts_of_stages_work_out_facts_once(spark):
    """Stages share facts that are there: none of them joins the extractors' answers or looks for an amount again."""
    plan = QUERIES["p20_stage_prompts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" not in plan and "trillion" not in plan


def test_common_texts_do_not_cross_to_python(spark, monkeypatch):
    """Texts in Latin letters that are in NFKC form, and markup with common references, are decided by built-in functions; others by the tables."""
    texts = ["na\u00efve caf\u00e9 \u2013 \u20ac5", "\ufb01ne", "e\u0301", "\u1100\u1161", "\u212b x", "a&amp;lt;b &lt;&amp; c", "x &copy; y", "&amp;copy; z", "AT&T &amp;amp; co", "&amp;#39;&nbsp;q", "&#8217;s", "& <b>t</b>"]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    sent = df.select(F.col("t").rlike(T.NORMAL).alias("n")).collect()
    assert [r.n for r in sent] == [x not in ("\ufb01ne", "e\u0301", "\u1100\u1161", "\u212b x") for x in texts]
    got = df.select("t", T.nfkc(F.col("t")).alias("n"), T._plain_twice(F.col("t")).alias("p"), T._strip(F.concat(F.lit("\x85 \u3000"), "t", F.lit("\u2003\n"))).alias("s")).collect()
    for r in got:
        assert (r.n, r.p, r.s) == (unicodedata.normalize("NFKC", r.t), html.unescape(html.unescape(r.t)), r.t)


def test_most_texts_are_not_searched_for_each_ending(spark):
    """A text without any ending is looked through once; one with several loses as many as three rounds of all patterns take."""
    plan = spark.range(1).select(T.strip_boilerplate(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan
    assert one(spark, T.strip_boilerplate(F.lit(" Rates rose. Read more on our site Continue reading here\nSource: Outlet https://x.org/a ")), T.strip_boilerplate(F.lit("Nothing to take"))) == ["Rates rose.", "Nothing to take"]
