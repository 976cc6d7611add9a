"""Panel rules on small cases."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F
from test_entry import cell

from newsfold.functions import answers as P
from newsfold.functions import values as V
from newsfold.operators import consensus as C
from newsfold.operators import impact as I
from newsfold.operators import routing as R
from newsfold.plans import panels  # noqa: F401  (it registers its queries)
from newsfold.plans.adapters import answers
from newsfold.plans.registry import QUERIES, SQL, Tables
from newsfold.scale import cut_by_number, spread


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_coercions(spark):
    L = F.lit
    got = one(spark, V.as_bool(L(" Yes")), V.as_bool(L("drop")), V.as_bool(L("maybe")), V.as_float(L("about $1,250.5M")), V.as_float(L("none")), V.as_probability(L("87%")), V.as_probability(L("x"), 0.5), V.as_int(L("2.5")), V.as_str_list(L("a, b;\n c;")))
    assert list(got) == [True, False, None, 1250.5, None, 0.87, 0.5, 2, ["a", "b", "c"]]


def test_ranges_and_horizons(spark):
    L, null = F.lit, F.lit(None).cast("double")
    got = one(spark, *[f(a, b, L(m)) for a, b, m in ((L(3.0), null, "HIGH"), (null, null, "MEDIUM"), (L(-5.0), L(2.0), "LOW")) for f in (V.range_low, V.range_high)])
    assert list(got) == [2.0, 3.0, 0.7, 2.0, 2.0, 5.0]
    assert list(one(spark, *[V.snap_horizon(x) for x in (L(45), L(1000), null, L(37.5))])) == [60, 1440, 180, 15]


def test_enumerations(spark):
    got = one(spark, V.parse_direction(F.lit("long")), V.parse_direction(F.lit("??")), V.parse_magnitude(F.lit("medium-high")), V.parse_relation(F.lit("direct link")), V.parse_causality(F.lit("x")), V.normalize_ticker(F.lit("the whole market")), V.normalize_ticker(F.lit("btc/usdt")), V.normalise_asset(F.lit("$matic-usd")), V.is_priceable(F.lit("usdc")))
    assert list(got) == ["BULLISH", "NEUTRAL", "HIGH", "DIRECT", "SENTIMENT", "", "BTC", "POL", False]


def votes(spark, rows):
    return spark.createDataFrame([(1, i + 1, *r) for i, r in enumerate(rows)], "news_id long, model_seq int, ok boolean, vote boolean, score double, reason string, urgency string")


def test_tally(spark):
    v = votes(spark, [(True, True, 55.0, "", "low"), (True, False, 60.0, "old", "high"), (True, False, 58.0, "older", "high"), (False, None, None, "", ""), (True, None, 99.0, "", "low")])
    t = C.verdict_summary(C.tally(v, ["news_id"], 2)).first()
    assert (t.votes_pass, t.votes_reject, t.votes_failed, t.verdict, t.score) == (1, 2, 2, "REJECT", 58.0) and t.agreement == pytest.approx(2 / 3)
    assert C.drop_reason(v, ["news_id"]).first().drop_reason == "2/3 models: old"
    thin = C.tally(votes(spark, [(True, False, 1.0, "", "low"), (False, None, None, "", "")]), ["news_id"], 2).first()
    assert thin.verdict == "INCONCLUSIVE" and thin.note.startswith("quorum not met (1 of 2")


def test_majority_ties_take_the_greatest_label(spark):
    df = spark.createDataFrame([(1, "BULLISH"), (1, "BEARISH"), (1, "")], "news_id long, direction string")
    row = C.majority_label(df, ["news_id"], "direction").first()
    assert row.direction == "BULLISH" and row.share == 0.5


def panel(spark, rows, news_id=1):
    base = dict(ok=True, magnitude="MEDIUM", low=1.0, high=2.0, confidence=0.8, horizon=180, causality="MACRO", mechanism="m", risks="r", confirms=True, priced_in=False, conflicts=[], overlooked=[], tradeable=True)
    names = "news_id long, asset string, model_seq int, ok boolean, direction string, magnitude string, low double, high double, confidence double, horizon int, causality string, mechanism string, risks string, confirms boolean, priced_in boolean, conflicts array<string>, overlooked array<string>, tradeable boolean"
    made = [{**base, "news_id": news_id, "asset": "BTC", "model_seq": i, **r} for i, r in enumerate(rows)]
    return spark.createDataFrame(made, names)


def links(spark):
    return spark.createDataFrame([(1, "BTC", "DIRECT", 1.0)], "news_id long, asset string, relation string, confidence double")


def impact(spark, directions, **how):
    return I.aggregate_impact(links(spark), panel(spark, [{"direction": d, **how} for d in directions]))


def test_impact_direction(spark):
    row = impact(spark, ["BULLISH", "BULLISH", "BEARISH", "BEARISH"]).first()
    assert row.direction == "MIXED" and row.agreement == 0.5
    row = impact(spark, ["BULLISH"] * 3 + ["BEARISH"] * 2).first()
    assert row.direction == "BULLISH" and row.agreement == 0.6 and row.confidence == pytest.approx(0.48)
    row = impact(spark, ["BULLISH"] * 3, magnitude="LOW", low=6.0, high=8.0).first()
    assert row.magnitude == "EXTREME"
    row = I.aggregate_impact(links(spark), panel(spark, [{"direction": None}])).first()
    assert (row.direction, row.confidence, row.model_count) == ("NEUTRAL", 0.0, 0)
    row = impact(spark, ["NEUTRAL"] * 3).first()
    assert (row.expected_low, row.expected_high) == (0.15, 0.7)


def test_audit_never_raises_confidence_when_contested(spark):
    base = impact(spark, ["BULLISH"] * 5)
    for confirms, other in ((False, "BEARISH"), (False, "BULLISH"), (True, "BULLISH")):
        row = I.revise(base, panel(spark, [{"direction": other, "confirms": confirms, "confidence": 0.99}] * 3)).first()
        assert row.confidence <= (base.first().confidence if not confirms else 0.93)
    flipped = I.revise(base, panel(spark, [{"direction": "BEARISH", "confirms": False}] * 3)).first()
    assert flipped.direction == "BEARISH" and flipped.source == "stage5" and flipped.confidence <= 0.55
    assert I.revise(base, panel(spark, [{"direction": None, "confirms": None}])).first().source == "stage4"


def test_final(spark):
    base = impact(spark, ["BULLISH"] * 5)
    row = I.decide_final(base, panel(spark, [{"direction": d} for d in ("BULLISH", "BEARISH", "NEUTRAL")])).first()
    assert row.direction == "MIXED" and row.tradeable is False and row.confidence <= 0.4 and row.notes.startswith("final panel split")
    row = I.decide_final(base, panel(spark, [{"direction": d} for d in ("BEARISH", "BEARISH", "BULLISH")])).first()
    assert row.direction == "BEARISH" and row.confidence == pytest.approx(0.68) and row.notes == "overrules stage4 BULLISH -> BEARISH"
    assert I.decide_final(base, panel(spark, [{"direction": None}])).first().notes == "final layer unavailable"


def test_salvage_and_parsers(spark):
    texts = ['{"score": 60}', '```json\n{"score": 60}\n```', '<think>{"score": 1</think> {"score": 60,}', 'so [1, {"score": 60}] ok', "nothing", None, '{"reason": "a } b", "score": 60} tail']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, raw_text string")
    got = {r.id: r.parsed for r in P.parse_answers(df, 2).collect()}
    assert [got[i] and got[i].score for i in range(7)] == [60.0, 60.0, 60.0, 60.0, None, None, 60.0]
    assert got[0].vote is True


def test_budget_and_repeats(spark):
    c = spark.createDataFrame([("c", i, float(i), "A") for i in range(9)], "cycle string, event_seq long, priority double, asset string")
    got = sorted((r.event_seq, r.granted) for r in R.spend_budget(c).collect())
    assert [s for s, g in got if g] == [0, 1, 2, 3, 4]
    rows = [(1, 1, "btc", 1, "BULLISH", "HIGH", 0.71, "stage4"), (1, 2, "BTC", 2, "BULLISH", "HIGH", 0.69, "stage4"), (1, 3, "BTC", 3, "BULLISH", "HIGH", 0.71, "final"), (None, 4, "BTC", 4, "BULLISH", "HIGH", 0.7, "stage4")]
    a = spark.createDataFrame(rows, "event_id long, news_id long, asset string, seq long, direction string, magnitude string, confidence double, source string")
    assert {r.seq: r.repeat for r in R.suppress_repeats(a).collect()} == {1: False, 2: True, 3: False, 4: False}


def test_repeats_of_a_hot_event_against_a_loop(spark):
    draw = random.Random(7)
    rows = [(1 if draw.random() < 0.8 else draw.choice([2, None]), None if draw.random() < 0.1 else draw.randrange(3), draw.choice(["btc", "BTC", "eth", None]), i * 7, draw.choice(["BULLISH", "BEARISH"]), "HIGH", draw.choice([0.7, 0.71, 0.9]), draw.choice(["stage4", "stage4", "final", None])) for i in range(3_000)]
    a = spark.createDataFrame(rows, "event_id long, news_id long, asset string, seq long, direction string, magnitude string, confidence double, source string")
    want, held = {}, {}
    for event, news, asset, seq, direction, magnitude, confidence, source in rows:
        key = (event, news if event is None else None, asset and asset.upper())
        shape = (direction, magnitude, round(confidence * 10))
        want[seq], held[key] = held.get(key) == shape and source not in ("stage5", "final"), shape
    assert {r.seq: r.repeat for r in R.suppress_repeats(a).collect()} == want
    cut = cut_by_number(a, ["event_id", "asset"], "seq", rows=50)  # whole keys, also null ones, in spans that grow with seq
    cuts = {}
    for r in sorted(cut.collect(), key=lambda r: r.seq):
        cuts.setdefault((r.event_id, r.asset), []).append(r.cut)
    assert sum(map(len, cuts.values())) == 3_000 and all(c == sorted(c) and max(c.count(x) for x in c) <= 100 for c in cuts.values())
    assert max(len(set(c)) for c in cuts.values()) > 10


def test_half_even_as_the_sql_side(spark):
    """Ties and near ties by the double's product, as ``round_even`` tells them; ``bround`` gives 54.9 for the first, whose shortest digits are below the tie."""
    for x in (54.949999999999996, 54.95, 54.85, 0.25, 0.35, -0.25, 2.5, 0.0):
        con = duckdb.connect()
        want = con.execute("SELECT round_even(CAST(? AS DOUBLE), 1), round_even(CAST(? AS DOUBLE), 3)", [x, x / 100]).fetchone()
        assert tuple(one(spark, V.half_even(F.lit(x), 1), V.half_even(F.lit(x / 100), 3))) == want
    draw = random.Random(1)
    near = [x for _ in range(4000) for x in [(draw.randrange(20_000) + 0.5) / 1000 * draw.choice([1, 0.85, 0.7, 1.15]) / draw.choice([1, 0.85, 0.7, 1.15])]]
    got = [r.y for r in spark.createDataFrame(list(enumerate(near)), "i long, x double").orderBy("i").select(V.half_even(F.col("x"), 3).alias("y")).collect()]
    assert got == [r[0] for r in duckdb.execute("SELECT round_even(x, 3) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [near]).fetchall()]
    assert one(spark, V.half_even(F.lit(None).cast("double"), 1))[0] is None


def test_parts_follow_the_rows(spark):
    """Parts grow with the rows and aren't joined again, however well they compress; panels of one article stay together."""
    df = spark.range(10_000).selectExpr("id % 500 AS k", "0 AS v")
    assert spread(df, "k", rows=500).rdd.getNumPartitions() == 20 and spread(df.limit(0), "k").count() == 0
    plan = answers(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan


def lineitem(spark, folder):
    """Orders of no to nine lines and one of 400, many of them equal in all that orders them but one column."""
    draw = random.Random(3)
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    orders = [7] * 400 + [k for k in range(400) for _ in range(draw.randrange(10))]
    rows = [(k, draw.randrange(60), draw.randrange(40), draw.randrange(1, 4), float(draw.randrange(1, 51)), draw.randrange(1000) / 8, draw.randrange(11) / 100, draw.randrange(9) / 100, draw.choice("ANR"), draw.choice("OF"), None) for k in orders]
    spark.createDataFrame(rows, names).repartition(3).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


@pytest.mark.parametrize(("name", "uses"), [("a15_revised", 3), ("a16_final_verdicts", 4)])
def test_panels_move_lines_only(spark, tmp_path, name, uses):
    """Each stage moves its lines once. No answers, impacts or panels are written, and none are dealt anew for a join."""
    folder = lineitem(spark, tmp_path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = QUERIES[name](spark, folder)
        plan = df._jdf.queryExecution().executedPlan().toString()
        got = df.toPandas()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ExistingRDD" not in plan and plan.count("Exchange") == plan.count("REPARTITION_BY_NUM") == uses
    want = duckdb.connect().execute(SQL[name].replace("FROM lineitem", f"FROM '{folder}/lineitem.parquet/*.parquet'")).df()
    told = lambda df: sorted(tuple(cell(v) for v in r) for r in df[sorted(want.columns)].itertuples(index=False))
    assert told(got) == told(want) and len(got) > 300


def test_panels_deal_by_both_keys_without_moving_the_asset(spark, tmp_path):
    """Numbers of lines and panels by article and asset stay where the lines were dealt to; the shuffle carries columns of the table only."""
    a = answers(Tables(spark, lineitem(spark, tmp_path)), "asset")
    plan = a.groupBy("news_id", "asset").agg(F.max("model_seq"))._jdf.queryExecution()
    assert plan.executedPlan().toString().count("Exchange") == 1
    moved = plan.optimizedPlan().toString().split("Repartition", 1)[1].splitlines()[1]
    assert "Relation" in moved and "asset" not in moved
