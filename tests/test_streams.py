"""Streaming forms against their batch twins and plain loops."""

import datetime
import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from newsfold.functions import likeness as K
from newsfold.operators import feedback as B
from newsfold.operators import memory as M
from newsfold.operators import routing as R
from newsfold.sources import tables as Tb
from newsfold.streaming import streams as St


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return df.sparkSession.table(name)


def stream_of(spark, parts, schema, folder):
    """A stream that gets each part as a micro-batch."""
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def cut(rows, places):
    ends = [0, *places, len(rows)]
    return [rows[a:b] for a, b in zip(ends, ends[1:])]


STATE_ROWS = "event_key string, id long, at timestamp, amount double, price double, percentage double, count double, ruling string, location string, time_reference string, event_date string, status string, claims array<string>"


def state_rows(n=90):
    draw = random.Random(7)
    start = datetime.datetime(2024, 1, 1)
    number = lambda: draw.choice([None, 10.0, 10.2, 20.0])
    said = lambda: [draw.choice([f"claim number {draw.randrange(9)} stands", "securities exchange", "se", "", None, f"word{draw.randrange(30)}{draw.randrange(99)}x"]) for _ in range(draw.randrange(3))]
    return [
        (draw.choice("abc"), i, start + datetime.timedelta(minutes=37 * i), number(), number(), number(), number(), draw.choice([None, "", "approved by the board", "approved by the boards", "rejected"]), draw.choice([None, "London", "Tokyo"]),
         draw.choice(["", "late on monday", "late on mondays"]), draw.choice([None, "2024-01-01", "2025-11-20"]), draw.choice(["reported", "confirmed", "denied", "", None]), draw.choice([None, said(), said()]))
        for i in range(n)
    ]


@pytest.mark.parametrize("places", [[], [30, 31, 60]])
def test_event_states_equal_batch(spark, tmp_path, places):
    rows = state_rows()
    batch = spark.createDataFrame(rows, STATE_ROWS)
    decided = M.diff_states(batch).cache()
    got = run(St.event_state_stream(stream_of(spark, cut(rows, places), STATE_ROWS, str(tmp_path / "in")), None), f"states{len(places)}").collect()
    changed = [c for c in decided.columns if c.startswith("changed_")]
    want = {r.id: (r.decision, {c[8:] for c in changed if r[c]}, r.new_claims) for r in decided.collect()}
    assert {r.id: (r.decision, set(filter(None, r.changed.split(","))), r.new_claims) for r in got} == want
    merged = {r.event_key: r for r in M.events_rollup(decided).collect()}
    last = {r.event_key: r for r in sorted(got, key=lambda r: r.id)}
    for key, r in last.items():
        assert all(r[c] == merged[key][c] for c in ("article_count", "update_count", *M.NUMBERS, *M.TEXTS, "status", "key_claims")), key


def test_event_states_go_on_from_a_table(spark, tmp_path):
    rows = state_rows()
    want = {r.id: (r.decision, r.new_claims) for r in M.diff_states(spark.createDataFrame(rows, STATE_ROWS)).collect() if r.id >= 40}
    known = M.events_rollup(M.diff_states(spark.createDataFrame(rows[:40], STATE_ROWS)))
    got = run(St.event_state_stream(stream_of(spark, cut(rows[40:], [20]), STATE_ROWS, str(tmp_path / "in")), None, known), "later").collect()
    assert {r.id: (r.decision, r.new_claims) for r in got} == want


def test_plain_ratio_says_what_the_column_says(spark):
    draw = random.Random(2)
    words = ["sec", "securities", "and", "exchange", "commission", "s.e.c", "a", "b.t.c", "blackrock", "blackrocks", "of", "", "é", "se"]
    pairs = [tuple(draw.choice([" ", "  "]).join(draw.choice(words) for _ in range(draw.randrange(4))) for _ in range(2)) for _ in range(1500)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", K.string_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    for r in got:
        assert K.plain_ratio(r.a, r.b) == pytest.approx(r.r), (r.a, r.b)


def test_dedup_and_batches(spark, tmp_path):
    rows = spark.range(20).selectExpr("concat('u', id % 5) AS url_key", "'h' AS content", "timestamp'2024-01-01' + make_dt_interval(0, 0, cast(id AS int)) AS fetched_at")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    assert run(St.dedup_stream(stream, ["url_key", "content"]), "dedup").count() == 5
    sizes = []
    St.run_pipeline_stream(stream, lambda df, _: sizes.append(df.count()), str(tmp_path / "c"), None).awaitTermination(120)
    assert sum(sizes) == 20


def test_seen_memory_is_a_plain_ordered_dictionary(spark, tmp_path):
    draw = random.Random(4)
    rows = [(i, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=i), draw.choice([f"u{draw.randrange(25)}", None]), f"c{draw.randrange(3)}") for i in range(160)]
    parts, seen, want = cut(rows, [10, 11, 50, 51, 90, 130]), OrderedDict(), {}
    for part in parts:
        passed = {}
        for i, _, key, content in part:
            key = key or ""
            want[i] = key not in passed and seen.get(key) != content
            if want[i]:
                passed[key] = content
        for key, content in passed.items():
            seen[key] = content
            seen.move_to_end(key)
            while len(seen) > 12:
                seen.popitem(last=False)
    stream = stream_of(spark, parts, "id long, at timestamp, key string, content string", str(tmp_path / "in"))
    assert {r.id: r.new for r in run(St.seen_stream(stream, 12), "seen").collect()} == want
    assert len(set(want.values())) == 2


ALERT = "event_id long, news_id long, asset string, seq long, tick long, direction string, magnitude string, confidence double, source string"


def test_alert_memory(spark, tmp_path):
    told = [(1, "btc", 1, "UP", "HIGH", 0.7, "stage4"), (1, "BTC", 2, "UP", "HIGH", 0.71, "stage4"), (1, "BTC", 3, "UP", "HIGH", 0.7, "final"), (1, "BTC", 4, "DOWN", "HIGH", 0.7, "stage4")]
    told += [(None, "BTC", 5, "UP", "HIGH", 0.7, "stage4"), (None, "BTC", 6, "UP", "HIGH", 0.7, "stage4"), (None, "BTC", 7, "UP", "HIGH", 0.7, "stage4")]  # without an event: by article
    news = {1: 9, 2: 9, 3: 9, 4: 9, 5: 1, 6: 2, 7: 1}
    rows = [(r[0], news[r[2]], r[1], r[2], r[2], *r[3:]) for r in told]
    stream = stream_of(spark, [rows], ALERT, str(tmp_path / "in"))
    assert {r.seq: r.send for r in run(St.alert_memory_stream(stream, days=None), "memory").collect()} == {1: True, 2: False, 3: True, 4: True, 5: True, 6: True, 7: False}


def test_alerts_are_remembered_when_they_are_delivered(spark, tmp_path):
    draw = random.Random(6)
    alerts, acks, want, shapes, before = [], [], {}, {}, {(2, "B")}
    for seq in range(80):
        event, asset = draw.randrange(3), draw.choice("AB")
        shape = (draw.choice(["UP", "DOWN"]), "HIGH", 0.7)
        deep = draw.random() < 0.1
        alerts.append((event, seq, asset, seq, 2 * seq, *shape, "final" if deep else "stage4"))
        last = shapes.get((event, asset))
        want[seq] = deep or (last != shape if last else (event, asset) not in before)
        if want[seq]:
            delivered = draw.random() < 0.6
            acks.append((event, seq, asset.lower(), seq, 2 * seq + 1, delivered))
            if delivered:
                shapes[event, asset] = shape
    ack = "event_id long, news_id long, asset string, seq long, tick long, delivered boolean"
    both = stream_of(spark, cut(alerts, [40]), ALERT, str(tmp_path / "a")), stream_of(spark, cut(acks, [sum(a[4] < 80 for a in acks)]), ack, str(tmp_path / "b"))
    sent = spark.createDataFrame([(2, "b", True), (0, "A", False), (None, "A", True)], "event_id long, asset string, delivered boolean")
    got = {r.seq: r.send for r in run(St.alert_memory_stream(*both, sent, days=None), "acknowledged").collect()}
    assert got == want


def test_horizon_timers_equal_batch(spark, tmp_path):
    draw = random.Random(5)
    start = datetime.datetime(2024, 1, 1)
    at = lambda m: start + datetime.timedelta(seconds=int(60 * m))
    prices = [(a, at(draw.uniform(20 if a == "LATE" else 0, 1900)), i, 50 + draw.random()) for i, a in enumerate(["A"] * 120 + ["B"] * 6 + ["LATE"] * 5)]
    prices += [("A", at(33), 500, 1.0), ("A", at(33), 501, 2.0)]
    forecasts = [(i, draw.choice(["A", "B", "LATE", "NONE"]), at(draw.uniform(0, 400)), draw.choice([15, 60, 95])) for i in range(40)] + [(77, "A", at(33), 60)]
    near = lambda r: r[1] + datetime.timedelta(minutes=draw.uniform(0, 8))  # noqa: E731  out of order, but not too late
    prices.sort(key=near)
    forecasts.sort(key=lambda r: r[2])
    end = [[(a, at(m), 900 + m, 1.0) for a in ("A", "B", "LATE", "NONE")] for m in (9000, 9100)]
    price, forecast = "asset string, at timestamp, seq long, price double", "id long, asset string, created_at timestamp, horizon_minutes int"
    # both streams advance alike: a part of the one with the part of the other that has its span of time
    bounds = [at(m) for m in (150, 300)]
    parts = [[r for r in prices if near_part(r[1], bounds) == k] for k in range(3)] + end
    asked = [[r for r in forecasts if near_part(r[2], bounds) == k] for k in range(3)]
    stream = St.horizon_stream(stream_of(spark, asked, forecast, str(tmp_path / "f")), stream_of(spark, parts, price, str(tmp_path / "p")))
    got = run(stream, "samples").collect()
    p, t = spark.createDataFrame(forecasts, forecast), spark.createDataFrame(prices, price)
    as_of = F.lit(at(5000))
    base = B.baselines(p, t, as_of)
    want = B.observe(B.due_horizons(p, p.select("id", F.lit(-1).alias("offset")).limit(0), as_of), base, t).collect()
    assert {(r.id, r.offset): round(r.pct, 9) for r in got if r.kind == "sample"} == {(r.id, r.offset): round(r.pct, 9) for r in want}
    assert {r.id for r in got if r.kind == "abandoned"} == {r.id for r in base.where("state = 'abandoned'").collect()} != set()


def near_part(when, bounds):
    return sum(when >= b for b in bounds)


def test_lookback_reads_only_its_days(spark, tmp_path):
    rows = spark.range(40).selectExpr("id", "timestamp'2024-01-01' + make_dt_interval(cast(id AS int), 12) AS fetched_at").withColumn("day", F.to_date("fetched_at"))
    rows.write.partitionBy("day").parquet(str(tmp_path / "news"))
    stored = spark.read.schema("id long, fetched_at timestamp, day date").parquet(str(tmp_path / "news"))
    kept = Tb.lookback(stored, F.lit("2024-01-20 12:00:00").cast("timestamp"), day="day")
    assert sorted(r.id for r in kept.collect()) == list(range(12, 20))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "2024-01-13" in plan


def test_gate_asks_the_history(spark):
    draw = random.Random(3)
    rows, want, shapes, history = [], {}, {}, {(1, "A"), (2, "B")}
    for seq in range(120):
        event, asset, score = draw.choice([1, 2, 3, None]), draw.choice("ab"), draw.choice([40.0, 60.0, None, 55.0])
        shape, deep = (draw.choice(["UP", "DOWN"]), "HIGH", 0.7), draw.random() < 0.08
        rows.append((event, 7, asset, seq, *shape, "stage5" if deep else "stage4", score))
        if score is None or score < 55:
            want[seq] = "below"
            continue
        key = (event, asset.upper())
        held = shapes.get(key) == shape if key in shapes else key in history
        want[seq] = "suppressed" if held and not deep else "sent"
        if want[seq] == "sent":
            shapes[key] = shape
    df = spark.createDataFrame(rows, "event_id long, news_id long, asset string, seq long, direction string, magnitude string, confidence double, source string, alert_score double")
    sent = spark.createDataFrame([(1, "a", True), (2, "B", True), (3, "A", False), (None, "A", True)], "event_id long, asset string, delivered boolean")
    assert {r.seq: r.outcome for r in R.publish_gate(df, sent=sent).collect()} == want


def test_run_metrics_of_a_stream_equal_the_report(spark, tmp_path):
    from newsfold.operators import report as Rp

    rows = [(i, ["NEW", "UPDATE", "DUPLICATE"][i % 3], 0 if i % 3 == 2 else [None, 1, 2, 3, 4][i % 5], i % 4 == 0 and i % 5 == 0, i % 8 == 0 and i % 5 == 0, i % 3 or None, 0, 5, i % 2) for i in range(60)]
    schema = "news_id long, decision string, dropped_at int, escalated5 boolean, escalated_final boolean, alerts long, errors long, calls long, failures long"
    stream = Rp.observed_run(stream_of(spark, cut(rows, [7, 40]), schema, str(tmp_path / "in")))
    query = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = Rp.run_report(spark.createDataFrame(rows, schema).withColumn("run", F.lit(1))).drop("run").first().asDict()
    seen = [p.observedMetrics["run"].asDict() for p in query.recentProgress if p.numInputRows]
    assert len(seen) == 3 and {k: sum(s[k] for s in seen) for k in want} == want
