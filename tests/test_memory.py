"""Event memory at length: indexes, long chains, hot events, and sinks that are written twice."""

import datetime
import logging
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from newsfold.plans import feedback  # noqa: F401
from newsfold.plans.registry import QUERIES
from newsfold.functions import likeness as K
from newsfold.operators import memory as M
from newsfold.operators import vector_index
from newsfold.operators.vector_index import VectorIndex
from newsfold.scale import cut_by_time
from newsfold.sources import sinks as Sk
from newsfold.sources import tables as Tb
from newsfold.streaming import streams as St

START = datetime.datetime(2024, 1, 1)
VECTORS = "id long, at timestamp, v array<double>"


def reports(draw, n, stories=12, size=8):
    anchors = [[draw.gauss(0, 1) for _ in range(size)] for _ in range(stories)]
    return [(i, START + datetime.timedelta(hours=draw.randrange(600)), [x + draw.gauss(0, 0.25) for x in anchors[draw.randrange(stories)]]) for i in range(n)]


def test_index_against_all_rows(spark, tmp_path):
    rows = reports(random.Random(1), 400)
    rows += [(900, START, None), (901, START, [0.0] * 8), (902, START, []), (903, START, [math.nan] + [1.0] * 7), (904, START, [1.0, 2.0]), (905, START + datetime.timedelta(days=1), [1.0, 2.0]), (906, START, [None] * 8), (907, START, [math.inf] * 8)]
    v = spark.createDataFrame(rows, VECTORS)
    index = VectorIndex(spark, f"file://{tmp_path}/index").fit(v, lists=9)
    for part in (v.where("id % 2 = 0"), v):  # days that come again are replaced
        index.append(part)
    assert index.lists().count() == len(rows)
    key = lambda df: {(r.id, r.match_id, r["rank"], round(r.similarity, 9)) for r in df.collect()}
    exact = key(M.find_similar(v, v))
    assert key(index.search(v)) == exact and key(index.search(v, block=7)) == exact and (905, 904, 1, 1.0) in exact
    some = v.where("id % 7 = 0")
    assert key(index.search(some, days=2, most=3, least=0.5)) == key(M.find_similar(some, v, days=2, most=3, least=0.5))
    probed = {x[:2] for x in key(index.search(v, probes=3))}
    assert len(probed & {x[:2] for x in exact}) >= 0.9 * len(exact)
    assert index.search(v.limit(0)).count() == 0
    plan = index.stored(*[int((START + datetime.timedelta(days=d)).timestamp()) * 1_000_000 for d in (10, 11)], 7)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[isnotnull\(day[^\]]*2024-01-0[34]", plan)


def test_index_sends_a_query_to_few_cells(spark, tmp_path, monkeypatch):
    """However many lists a query asks, it is sent once to each of two spans that hold few rows."""
    v = spark.createDataFrame(reports(random.Random(2), 300), VECTORS)
    index = VectorIndex(spark, f"file://{tmp_path}/index").fit(v, lists=40)
    index.append(v)
    sent = []
    monkeypatch.setattr(vector_index, "nearest_in_cells", lambda q, s, *a: sent.append((q, s)) or M.nearest_in_cells(q, s, *a))
    key = lambda df: {tuple(r)[:2] for r in df.collect()}
    exact = key(index.search(v))
    q, s = sent[0]
    assert exact == key(M.find_similar(v, v)) and q.count() <= 2 * 300 and s.count() == 300
    lists = {r["id"]: r["list"] for r in index.lists().collect()}
    alone = key(index.search(v, probes=1))
    assert alone and alone == key(index.search(v, probes=1, block=5)) and all(lists[i] == lists[j] for i, j in alone)


def test_all_rows_are_sent_once(spark, monkeypatch):
    """Stored rows are not repeated for each day that may ask for them; those of a whole week before are found, older ones aren't."""
    rows = [(i, START + datetime.timedelta(hours=12 * i), [1.0, 0.01 * i]) for i in range(60)]
    v, sent = spark.createDataFrame(rows, VECTORS), []
    cells = M.nearest_in_cells
    monkeypatch.setattr(M, "nearest_in_cells", lambda q, s, *a: sent.append((q.count(), s.count())) or cells(q, s, *a))
    got = M.find_similar(v, v, most=99)
    assert {tuple(r)[:2] for r in got.collect()} == {(i, j) for i in range(60) for j in range(max(0, i - 14), i)} and sent == [(120, 60)]


def test_index_without_vectors(spark, tmp_path):
    v = spark.createDataFrame([(1, START, None), (2, START + datetime.timedelta(hours=1), [1.0])], VECTORS)
    index = VectorIndex(spark, f"file://{tmp_path}/none").fit(v.where("id = 1"))
    index.append(v)
    assert index.search(v).count() == 0 and index.lists().count() == 2


def test_a_chain_of_ten_thousand_takes_few_rounds(spark, caplog):
    n = 10_000
    rows = spark.range(n).selectExpr("id", "cast(id AS int) AS at", "'hack' AS event_type", "'actor' AS entity", "'btc' AS asset", "concat('drain ', id) AS action", "'bridge' AS target")
    similar = spark.range(1, n).selectExpr("id", "id - 1 AS match_id", "0.9 AS similarity")
    with caplog.at_level(logging.INFO, logger="newsfold.operators.memory"):
        got = M.match_events(rows, similar)
    rounds, jumps = map(int, re.search(r"(\d+) rounds with (\d+) jumps", caplog.text).groups())
    assert rounds <= 2 and jumps <= (rounds + 1) * (math.ceil(math.log(n, 4)) + 1)
    assert got.groupBy("event_id").count().collect() == [(0, n)]


def test_slices_of_time_give_what_the_whole_gives(spark):
    draw = random.Random(12)
    pick = lambda *x: draw.choice(x)
    rows = [(i, i // 2, pick("hack", "listing"), pick("sec", "cftc", "binance"), pick("btc", "eth"), pick("approve", "fine"), pick("blackrock etf", "bridge of base", "")) for i in range(80)]
    schema = "id long, at int, event_type string, entity string, asset string, action string, target string"
    pairs = [(draw.randrange(80), draw.randrange(80), round(draw.uniform(0.86, 1), 3)) for _ in range(200)]
    similar = spark.createDataFrame(list({p[:2]: p for p in pairs}.values()), "id long, match_id long, similarity double")
    df = spark.createDataFrame(rows, schema)
    whole = {r.id: r.event_id for r in M.match_events(df, similar).collect()}
    early = M.match_events(df.where("at < 20"), similar)
    late = M.match_events(df.where("at >= 20"), similar, decided=early)
    assert {r.id: r.event_id for r in early.unionByName(late).collect()} == whole


def test_claims_of_a_hot_event(spark):
    rows = [("hot", i, START + datetime.timedelta(minutes=i), [f"{'abcdefgh'[i % 8] * 6} {i % 40:04d}{i % 40:04d}"]) for i in range(600)] + [("one", 1000, START, None), ("one", 1001, START, [""])]
    df = spark.createDataFrame(rows, "event_key string, id long, at timestamp, claims array<string>")
    known, want = {}, {}
    for e, i, _, claims in rows:
        own, fresh = known.setdefault(e, []), 0
        for c in claims or []:
            if c and all(K.plain_ratio(c, k) < M.CLAIM_RATIO for k in own):
                fresh += 1
                if len(own) < M.MOST_CLAIMS:
                    own.append(c)
        want[i] = fresh
    assert {r.id: r.new_claims for r in M.fold_claims(df).collect()} == want
    got = M.known_claims(M.claim_mentions(df, "event_key"), "event_key").orderBy("since").collect()
    assert [r.known for r in got] == known["hot"]


def test_articles_without_an_event_come_back(spark):
    rows = [(None, 1, START, 5.0, "reported", ["a claim", "a claim", None]), ("e", 2, START, 5.0, "reported", []), (None, 3, START, None, None, None)]
    df = spark.createDataFrame(rows, "event_key string, id long, at timestamp, amount double, status string, claims array<string>")
    got = {r.id: (r.decision, r.first, r.changed_amount, r.new_claims) for r in M.diff_states(df).collect()}
    assert got == {1: ("NEW", True, False, 1), 2: ("NEW", True, False, 0), 3: ("NEW", True, False, 0)}


def test_state_of_facts(spark):
    facts = "struct<status:string,decision:string,amount:double,price:double,percentage:double,count:double,location:string,time_reference:string,event_date:string,key_claims:array<string>>"
    rows = [("e", 1, START, ("Reported", "Approved!", 5.0, None, 1.0, 2.0, "New  York", "Q1, 2025", "2025-01-02", ["B", "a", "b", None])), ("e", 2, START + datetime.timedelta(hours=1), ("", "denied", 5.0, 7.0, 1.0, 2.0, "New York!", None, "", None))]
    out = M.diff_states(M.reports_of_facts(spark.createDataFrame(rows, f"event_key string, id long, at timestamp, facts {facts}"))).orderBy("id").collect()
    assert [r.decision for r in out] == ["NEW", "UPDATE"] and out[1].changed_ruling and out[1].changed_price and not out[1].changed_location and out[0].claims == ["a", "b"]


def test_cuts_follow_the_count(spark):
    df = spark.range(3000).selectExpr("'k' AS k", "timestamp'2024-01-01' + make_dt_interval(0, 0, 0, cast(id * 25 AS double)) AS at").union(spark.sql("SELECT 'z', timestamp'2024-01-01 05:00:00'"))
    got = cut_by_time(df, ["k"], "at", "cut", rows=100)
    assert got.where("k = 'k'").groupBy("cut").count().agg(F.max("count")).first()[0] <= 130
    order = [r.cut for r in got.where("k = 'k'").orderBy("at").collect()]
    assert order == sorted(order) and got.count() == 3001


@pytest.mark.parametrize("name,rows,want", [
    ("observations", [[(1, 15, 2.0), (1, 15, 3.0)], [(1, 15, 9.0), (1, 60, 4.0)]], {(1, 15, 2.0), (1, 60, 4.0)}),
    ("events", [[("a", 5, 1.0), ("a", 7, None)], [("a", 6, 3.0), ("b", 1, None)]], {("a", 7, 3.0), ("b", 1, None)}),
    ("stage_consensus", [[(1, "PASS", 3.0)], [(1, "REJECT", None)]], {(1, "REJECT", None)}),
    ("model_performance", [[("m", 2, 1.5), ("m", 1, None)], [("m", 4, 2.0)], [("n", 1, 1.0)]], {("m", 7, 3.5), ("n", 1, 1.0)}),
    ("analyses", [[(1, "UP", 4), (1, None, 5)], [(1, "DOWN", 3)], [(2, None, None)]], {(1, "DOWN", 5), (2, None, None)}),
    ("news", [[("h", "first", None)], [("h", "second", 4)], [("h", "third", None)]], {("h", "first", 4)}),
    ("key_health", [[("p", 1, 2)], [("p", 3, 4)]], {("p", 4, 6)}),
    ("predictions", [[(1, 2.0, False)], [(1, 3.0, True)], [(1, None, False)]], {(1, 2.0, True)}),
    ("outcomes", [[(1, 0.5, True)], [(1, None, False)]], {(1, None, False)}),
])
def test_rules_of_tables_and_replays(spark, tmp_path, name, rows, want):
    columns = {
        "observations": ("prediction_id long, offset int, pct double", ["prediction_id", "offset", "pct"]), "events": ("identity_key string, seen int, importance double", ["identity_key", "seen", "importance"]),
        "stage_consensus": ("news_id long, verdict string, score double", ["news_id", "verdict", "score"]), "model_performance": ("model_id string, predictions long, score_sum double", ["model_id", "predictions", "score_sum"]),
        "analyses": ("news_id long, direction string, deepest_stage int", ["news_id", "direction", "deepest_stage"]), "news": ("exact_hash string, title string, stage int", ["exact_hash", "title", "stage"]),
        "key_health": ("provider string, success long, failure long", ["provider", "success", "failure"]), "predictions": ("id long, baseline_price double, resolved boolean", ["id", "baseline_price", "resolved"]),
        "outcomes": ("prediction_id long, score double, unscored boolean", ["prediction_id", "score", "unscored"]),
    }[name]
    extra = {"stage_consensus": ["1 AS stage", "'A' AS asset"], "model_performance": ["'5' AS stage", "'T' AS event_type", "'A' AS asset"], "analyses": ["'A' AS asset"], "key_health": ["0 AS key_index"]}.get(name, [])
    folder = f"file://{tmp_path}"
    for batch, part in enumerate(rows):
        df = spark.createDataFrame(part, columns[0]).selectExpr("*", *extra).coalesce(1).withColumn("place", F.monotonically_increasing_id())
        if name == "events":
            df = df.withColumn("last_seen", F.timestamp_seconds("seen"))
        for _ in range(2):  # every batch comes twice
            Sk.upsert_batch(spark, folder, name, df, batch, "place")
    got = Sk.read_keyed(spark, folder, name)
    got = got.withColumn("seen", F.unix_timestamp("last_seen").cast("int")) if name == "events" else got
    assert {tuple(r) for r in got.select(*columns[1]).collect()} == want
    assert got.columns[: len(Tb.SCHEMAS[name].split(", "))] == [c.split()[0] for c in Tb.SCHEMAS[name].split(", ")]


def test_streams_into_sinks(spark, tmp_path):
    rows = spark.range(40).selectExpr("id AS prediction_id", "15 AS offset", "cast(id AS double) AS pct", "timestamp'2024-01-01' + make_dt_interval(cast(id % 3 AS int)) AS created_at", "id AS place").union(
        spark.sql("SELECT cast(null AS long), 15, 1.0D, cast(null AS timestamp), 99L")
    )
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    folder = f"file://{tmp_path}/tables"
    St.run_stream(stream, Sk.upsert_sink(folder, "observations", "place"), str(tmp_path / "c1"), None).awaitTermination(120)
    assert Sk.read_keyed(spark, folder, "observations").count() == 40  # a row without a key has no place
    sink = Sk.append_sink(folder, "alerts_log")
    St.run_stream(stream, sink, str(tmp_path / "c2"), None).awaitTermination(120)
    sink(rows.where("prediction_id < 4"), 7)
    sink(rows.where("prediction_id < 4"), 7)
    assert spark.read.parquet(f"{folder}/alerts_log").count() == 41 + 4


def test_purge_touches_only_old_days(spark, tmp_path):
    rows = spark.range(200).selectExpr("id", "timestamp'2024-01-01' + make_dt_interval(cast(id % 20 AS int), 12) AS fetched_at", "CASE WHEN id % 20 < 3 OR id % 3 > 0 THEN timestamp'2024-02-01' END AS processed_at")
    path = f"file://{tmp_path}/news"
    rows.withColumn("day", F.to_date("fetched_at")).write.partitionBy("day").parquet(path)
    as_of = F.lit("2024-01-20 00:00:00").cast("timestamp")
    want = {r.id for r in Tb.retain(rows, as_of).collect()}
    files = lambda: {p.name for p in (tmp_path / "news" / "day=2024-01-15").iterdir()}
    before = files()
    for _ in range(2):  # the second one finds nothing to do
        Tb.purge(spark, path, as_of)
        assert {r.id for r in spark.read.parquet(path).collect()} == want
    assert files() == before and not (tmp_path / "news" / "day=2024-01-02").exists()
    aged = spark.read.parquet(path).where(F.col("day") <= F.to_date(as_of - F.make_dt_interval(F.lit(7))))
    assert "PartitionFilters: [isnotnull(day" in aged._jdf.queryExecution().executedPlan().toString()


def test_prompts_of_stages(spark):
    from newsfold.functions import prompts

    facts = "struct<event_type:string,entity:string,assets:array<string>,action:string,target:string,status:string,decision:string,amount:double,price:double,percentage:double,count:double,location:string,time_reference:string,event_date:string,key_claims:array<string>,headline:string>"
    df = spark.createDataFrame([(1, "Title", None, None, None, None), (2, None, "Body", "wire", START, ("HACK", None, None, "", "", "REPORTED", "", 742e6, None, 3.2, None, "", "", "", ["a", "b", "c", "d", "e"], ""))], f"id long, title string, body string, source string, published_at timestamp, facts {facts}")
    models = spark.createDataFrame([(2, "m"), (4, "m"), (4, "n")], "stage int, model string")
    got = {(r.id, r.stage, r.model): r.prompt for r in prompts.prompt_rows({2: df, 4: df}, models).collect()}
    assert len(got) == 6 and got[1, 2, "m"] == "\nITEM:\nTitle"
    assert got[2, 4, "n"] == "TARGET ASSET: \n\nEVENT: \nTYPE: HACK  ENTITY:   ACTION:   STATUS: REPORTED\nAMOUNT: $742,000,000\nPERCENTAGE: 3.2%\n\nCLAIMS:\n- a\n- b\n- c\n- d\n\nITEM:\nBody"


def test_likeness_by_limit(spark):
    """The limits by letters and by memory say what the whole likeness says; places come in order."""
    draw = random.Random(3)
    texts = ["", "us", "u.s.", "united states", "approved by the board"] + ["".join(draw.choice("abc de") for _ in range(draw.randrange(1, 30))) for _ in range(60)]
    pairs = [(draw.choice(texts), draw.choice(texts)) for _ in range(2000)]
    assert [K.plain_alike(a, b, 0.7) for a, b in pairs] == [K.plain_ratio(a, b) >= 0.7 for a, b in pairs]
    df = spark.createDataFrame([(["claim one", "claim two", "other", "claim one!"],), ([],)], "own array<string>")
    got = df.select(K.unlike_before(F.col("own"), 0.85).alias("p"), K.first_alike(F.lit("other"), F.col("own"), 0.85).alias("f")).collect()
    assert [(r.p, r.f) for r in got] == [([1, 2, 3], 3), ([], 0)]


def test_claims_are_learnt_once(spark, monkeypatch):
    """The merge takes what the decisions learnt: one fold of the claims."""
    calls, fold = [], M.known_claims
    monkeypatch.setattr(M, "known_claims", lambda *a: calls.append(1) or fold(*a))
    assert QUERIES["w5_full_merge"](spark, "/root/testdata/sf0.001").count() > 0 and len(calls) == 1
