"""Driver tables in the shapes that operators take; each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..scale import spread
from .registry import Tables

ORIGIN = "timestamp_ntz'2024-01-01 00:00:00'"


def news(t: Tables) -> DataFrame:
    """Articles: title up to the first line end, body the rest, a minute apart."""
    head = F.substring_index("text", "\n", 1)
    return t.documents.select(
        F.col("doc_id").alias("id"), head.alias("title"), F.expr("substring(text, length(substring_index(text, '\n', 1)) + 2)").alias("body"), "source", "lang",
        F.expr(f"{ORIGIN} + make_dt_interval(0, 0, cast(doc_id as int))").alias("published_at"),
    )


NEWS = """news AS (SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, substring(text, length(split_part(text, chr(10), 1)) + 2) AS body, source, lang,
    TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 MINUTE AS published_at FROM documents)"""


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), F.expr(f"{ORIGIN} + make_dt_interval(0, cast(vec_id as int))").alias("at"), F.col("embedding").alias("v"), "label")


VECTORS = "vectors AS (SELECT vec_id AS id, TIMESTAMP '2024-01-01' + vec_id * INTERVAL 1 HOUR AS tm, embedding AS v, label FROM embeddings)"


def stories(t: Tables) -> DataFrame:
    """Vectors of reports of stories: twenty in a row, an hour apart, lie around the first of them."""
    v = vectors(t).drop("label")
    first = v.where("id % 20 = 0").select(F.col("id").alias("story"), F.col("v").alias("a"))
    mixed = F.zip_with(F.col("v").cast("array<double>"), F.col("a").cast("array<double>"), lambda x, y: y + 0.35 * x)
    return v.withColumn("story", F.col("id") - F.col("id") % 20).join(first, "story").select("id", "at", mixed.alias("v"))


STORIES = f"""{VECTORS}, stories AS (SELECT x.id, x.tm, list_transform(list_zip(x.v, a.v), lambda p: CAST(p[2] AS DOUBLE) + 0.35 * CAST(p[1] AS DOUBLE)) AS v FROM vectors x JOIN vectors a ON a.id = x.id - x.id % 20)"""


def answers(t: Tables, *more: str) -> DataFrame:
    """Panel answers: all lines of an order, numbered; dealt by order, or by order and ``more``, which may only be ``asset``.

    Joins by article and asset move rows that are dealt by the article alone, but not those that are dealt by both. An order has one asset, so that its lines stay
    together; they are dealt by its expression, so that it isn't moved with them.
    """
    asset = F.expr("concat('A', l_orderkey % 2)")
    keys = ["l_orderkey", *[{"asset": asset}[c] for c in more]]
    w = W.partitionBy(*keys).orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    rows = spread(t.lineitem, *keys).withColumn("model_seq", F.row_number().over(w)).withColumn("asset", asset)
    return rows.selectExpr(
        "l_orderkey AS news_id", "model_seq", "concat('m', model_seq) AS model_id", "l_returnflag <> 'A' AS ok", "CASE WHEN l_partkey % 11 > 0 THEN l_returnflag = 'N' END AS vote", "l_quantity * 2 AS score",
        "CASE l_suppkey % 5 WHEN 0 THEN 'BULLISH' WHEN 1 THEN 'BULLISH' WHEN 2 THEN 'BEARISH' WHEN 3 THEN 'NEUTRAL' ELSE 'MIXED' END AS direction",
        "CASE l_partkey % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' ELSE 'EXTREME' END AS magnitude", "least(l_tax * 50, l_discount * 100) AS low", "greatest(l_tax * 50, l_discount * 100) AS high",
        "1 - l_discount * 5 AS confidence", "CASE l_partkey % 5 WHEN 0 THEN 15 WHEN 1 THEN 60 WHEN 2 THEN 180 WHEN 3 THEN 360 ELSE 1440 END AS horizon",
        "CASE l_suppkey % 3 WHEN 0 THEN 'MACRO' WHEN 1 THEN 'SENTIMENT' ELSE 'REGULATORY' END AS causality", "asset",
        "substring('because of supply', 1, cast(l_partkey % 17 as int)) AS mechanism", "substring('the risk is demand', 1, cast(l_suppkey % 18 as int)) AS risks", "l_suppkey % 7 = 0 AS market_wide", "l_linestatus = 'O' AS flag",
        "CASE l_partkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS urgency", "CASE WHEN l_partkey % 4 > 0 THEN concat('reason ', l_partkey % 13) ELSE '' END AS reason", "l_partkey AS partkey",
    )


ANSWERS = """numbered AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) AS model_seq FROM lineitem),
answers AS (SELECT l_orderkey AS news_id, model_seq, concat('m', model_seq) AS model_id, l_returnflag <> 'A' AS ok, CASE WHEN l_partkey % 11 > 0 THEN l_returnflag = 'N' END AS vote, l_quantity * 2 AS score,
    CASE l_suppkey % 5 WHEN 0 THEN 'BULLISH' WHEN 1 THEN 'BULLISH' WHEN 2 THEN 'BEARISH' WHEN 3 THEN 'NEUTRAL' ELSE 'MIXED' END AS direction,
    CASE l_partkey % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' ELSE 'EXTREME' END AS magnitude, least(l_tax * 50, l_discount * 100) AS low, greatest(l_tax * 50, l_discount * 100) AS high,
    1 - l_discount * 5 AS confidence, CASE l_partkey % 5 WHEN 0 THEN 15 WHEN 1 THEN 60 WHEN 2 THEN 180 WHEN 3 THEN 360 ELSE 1440 END AS horizon,
    CASE l_suppkey % 3 WHEN 0 THEN 'MACRO' WHEN 1 THEN 'SENTIMENT' ELSE 'REGULATORY' END AS causality, concat('A', l_orderkey % 2) AS asset,
    substring('because of supply', 1, CAST(l_partkey % 17 AS INT)) AS mechanism, substring('the risk is demand', 1, CAST(l_suppkey % 18 AS INT)) AS risks, l_suppkey % 7 = 0 AS market_wide, l_linestatus = 'O' AS flag,
    CASE l_partkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS urgency, CASE WHEN l_partkey % 4 > 0 THEN concat('reason ', l_partkey % 13) ELSE '' END AS reason, l_partkey AS partkey
    FROM numbered)"""


def states(t: Tables) -> DataFrame:
    """Reports of events: one event a user, in order of time."""
    return t.events.selectExpr(
        "user_id AS event_key", "event_id AS id", "ts AS at", "CASE WHEN event_id % 13 > 0 THEN value END AS amount",
        "CASE event_type WHEN 'view' THEN 'reported' WHEN 'click' THEN 'ongoing' WHEN 'signup' THEN 'confirmed' WHEN 'purchase' THEN 'completed' ELSE 'denied' END AS status", "event_type",
    )


STATES = """states AS (SELECT user_id AS event_key, event_id AS id, ts AS tm, CASE WHEN event_id % 13 > 0 THEN value END AS amount,
    CASE event_type WHEN 'view' THEN 'reported' WHEN 'click' THEN 'ongoing' WHEN 'signup' THEN 'confirmed' WHEN 'purchase' THEN 'completed' ELSE 'denied' END AS status, event_type FROM events)"""


def prices(t: Tables) -> DataFrame:
    return t.events.where("event_type <> 'click'").selectExpr("concat('P', user_id % 10) AS asset", "ts AS at", "event_id AS seq", "value + 50 AS price")


PRICES = "prices AS (SELECT concat('P', user_id % 10) AS asset, ts AS tm, event_id AS seq, value + 50 AS price FROM events WHERE event_type <> 'click')"


def predictions(t: Tables) -> DataFrame:
    return t.events.where("event_type = 'click'").selectExpr(
        "event_id AS id", "concat('P', user_id % 10) AS asset", "ts AS created_at", "CASE event_id % 4 WHEN 0 THEN 'BULLISH' WHEN 1 THEN 'BEARISH' WHEN 2 THEN 'NEUTRAL' ELSE 'MIXED' END AS direction",
        "value / 10 AS expected_low", "value / 4 AS expected_high", "CASE event_id % 5 WHEN 0 THEN 15 WHEN 1 THEN 60 WHEN 2 THEN 180 WHEN 3 THEN 360 ELSE 1440 END AS horizon_minutes",
        "concat('m', event_id % 7) AS model_id", "concat('T', event_id % 6) AS event_type",
    )


PREDICTIONS = """predictions AS (SELECT event_id AS id, concat('P', user_id % 10) AS asset, ts AS created_at, CASE event_id % 4 WHEN 0 THEN 'BULLISH' WHEN 1 THEN 'BEARISH' WHEN 2 THEN 'NEUTRAL' ELSE 'MIXED' END AS direction,
    value / 10 AS expected_low, value / 4 AS expected_high, CASE event_id % 5 WHEN 0 THEN 15 WHEN 1 THEN 60 WHEN 2 THEN 180 WHEN 3 THEN 360 ELSE 1440 END AS horizon_minutes,
    concat('m', event_id % 7) AS model_id, concat('T', event_id % 6) AS event_type FROM events WHERE event_type = 'click')"""


def call_log(t: Tables) -> DataFrame:
    return t.events.selectExpr(
        "event_id AS id", "event_type AS provider", "user_id % 3 AS key_index", "ts", "CASE event_id % 11 WHEN 0 THEN 429 WHEN 1 THEN 500 WHEN 2 THEN 401 WHEN 3 THEN 400 WHEN 4 THEN 404 WHEN 5 THEN 402 ELSE 200 END AS status",
        "CASE event_id % 5 WHEN 0 THEN '{\"error\": {\"message\": \"quota exceeded, try again in 2.5s\"}}' WHEN 1 THEN '{\"error\": \"API key not valid\"}' WHEN 2 THEN '{\"message\": \"try again in 700ms\"}' WHEN 3 THEN 'plain failure' ELSE '' END AS body",
        "cast(value * 10 AS long) AS latency_ms",
    )


CALL_LOG = """call_log AS (SELECT event_id AS id, event_type AS provider, user_id % 3 AS key_index, ts, CASE event_id % 11 WHEN 0 THEN 429 WHEN 1 THEN 500 WHEN 2 THEN 401 WHEN 3 THEN 400 WHEN 4 THEN 404 WHEN 5 THEN 402 ELSE 200 END AS status,
    CASE event_id % 5 WHEN 0 THEN '{"error": {"message": "quota exceeded, try again in 2.5s"}}' WHEN 1 THEN '{"error": "API key not valid"}' WHEN 2 THEN '{"message": "try again in 700ms"}' WHEN 3 THEN 'plain failure' ELSE '' END AS body,
    CAST(trunc(value * 10) AS BIGINT) AS latency_ms FROM events)"""


def alerts(t: Tables) -> DataFrame:
    """Alerts: one an order, batches by month."""
    return t.orders.selectExpr(
        "o_custkey AS event_id", "o_orderkey AS news_id", "concat('A', o_custkey % 2) AS asset", "o_orderkey AS seq", "date_format(o_orderdate, 'yyyy-MM') AS batch", "o_orderstatus",
        "CASE o_orderkey % 3 WHEN 0 THEN 'BULLISH' WHEN 1 THEN 'BEARISH' ELSE 'MIXED' END AS direction", "CASE WHEN o_totalprice > 250000 THEN 'HIGH' ELSE 'MEDIUM' END AS magnitude", "(o_orderkey % 4) / 4 AS confidence",
        "CASE o_orderkey % 9 WHEN 0 THEN 'final' WHEN 1 THEN 'stage5' ELSE 'stage4' END AS source", "o_totalprice / 5000 AS alert_score", "o_totalprice / 100000 AS expected_low", "o_totalprice / 50000 AS expected_high",
    )


ALERTS = """alerts AS (SELECT o_custkey AS event_id, o_orderkey AS news_id, concat('A', o_custkey % 2) AS asset, o_orderkey AS seq, strftime(o_orderdate, '%Y-%m') AS batch, o_orderstatus,
    CASE o_orderkey % 3 WHEN 0 THEN 'BULLISH' WHEN 1 THEN 'BEARISH' ELSE 'MIXED' END AS direction, CASE WHEN o_totalprice > 250000 THEN 'HIGH' ELSE 'MEDIUM' END AS magnitude, (o_orderkey % 4) / 4 AS confidence,
    CASE o_orderkey % 9 WHEN 0 THEN 'final' WHEN 1 THEN 'stage5' ELSE 'stage4' END AS source, o_totalprice / 5000 AS alert_score, o_totalprice / 100000 AS expected_low, o_totalprice / 50000 AS expected_high FROM orders)"""
