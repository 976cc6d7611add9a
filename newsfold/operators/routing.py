"""Which verdicts go deeper, which become predictions, and which are published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import values as V
from ..scale import carried, cut_by_number
from .consensus import passed

#: Limits of the gates. Fixed values.
ALWAYS_TYPES = ["REGULATORY", "ETF_APPROVAL", "EXCHANGE_HACK", "SECURITY_INCIDENT", "LIQUIDATION", "BANKRUPTCY", "DELISTING"]
DEEP_SCORE, LOW_AGREEMENT, FINAL_SCORE, LOW_CONFIDENCE, FINAL_PER_CYCLE, ALERT_SCORE, SURE_NEUTRAL, DIGEST_ABOVE = 60, 0.7, 75, 0.6, 5, 55, 0.6, 6


def funnel_gate(stages: DataFrame, fail_open: bool = True) -> DataFrame:
    """Add ``dropped_at`` and ``drop_reason`` to ``(news_id, decision, verdict1, verdict2, links, impacts)``; null where the article goes through."""
    no1, no2 = ~passed(F.col("verdict1"), fail_open), ~passed(F.col("verdict2"), fail_open)
    at = F.when(~F.col("decision").isin("NEW", "UPDATE"), 0).when(no1, 1).when(no2, 2).when(F.col("links") == 0, 3).when(F.col("impacts") == 0, 4)
    why = V.lookup(at, {0: "duplicate", 1: "not relevant", 2: "not significant", 3: "no affected asset identified", 4: "no impact produced"})
    return stages.withColumn("dropped_at", at).withColumn("drop_reason", why)


def stage5_event_gate(event_type: Column, score: Column, sources: Column) -> Column:
    zero = F.coalesce(score, F.lit(0.0))
    return F.upper(event_type).isin(ALWAYS_TYPES) | (zero >= DEEP_SCORE) | ((sources >= 4) & (zero >= DEEP_SCORE - 15))


def stage5_asset_gate(models: Column, agreement: Column, magnitude: Column, direction: Column) -> Column:
    return ((models >= 2) & (agreement < LOW_AGREEMENT)) | magnitude.isin("HIGH", "EXTREME") | (direction == "MIXED")


def worth_auditing(models: Column, agreement: Column, magnitude: Column, direction: Column, confidence: Column) -> Column:
    small = V.magnitude_rank(magnitude) < V.RANKS["MEDIUM"]
    return F.when(models == 0, False).when(small, agreement < LOW_AGREEMENT).otherwise(~((direction == "NEUTRAL") & (confidence >= SURE_NEUTRAL)))


def final_gate(models: Column, score: Column, confidence: Column, magnitude: Column, source: Column, direction: Column) -> Column:
    unsure = (confidence < LOW_CONFIDENCE) & magnitude.isin("HIGH", "EXTREME")
    return (models > 0) & ((F.coalesce(score, F.lit(0.0)) >= FINAL_SCORE) | unsure | (magnitude == "EXTREME") | ((source == "stage5") & (direction == "MIXED")))


def escalations(impacts: DataFrame) -> DataFrame:
    """Impacts ``(…, event_type, score, source_count)`` that deserve the deep check, with priority."""
    c = F.col
    event = stage5_event_gate(c("event_type"), c("score"), c("source_count"))
    asset = stage5_asset_gate(c("model_count"), c("agreement"), c("magnitude"), c("direction"))
    worth = worth_auditing(c("model_count"), c("agreement"), c("magnitude"), c("direction"), c("confidence"))
    return impacts.where((event | asset) & worth).withColumn("priority", V.priority(c("expected_low"), c("expected_high"), c("confidence"), c("score")))


def spend_budget(candidates: DataFrame, most: int = FINAL_PER_CYCLE) -> DataFrame:
    """Add ``place`` and ``granted`` to ``(cycle, event_seq, priority, asset)``: events in order, assets by priority, the first few in a cycle win.

    Only as many rows of a cycle as its budget are ever compared in one place: ranks are cut within
    (cycle, hash) first, and the rest are skipped without a rank.
    """
    order = [F.col("event_seq"), F.desc("priority"), F.col("asset")]
    part = F.pmod(F.xxhash64("event_seq", "asset"), F.lit(64))
    local = candidates.withColumn("_part", part).withColumn("_r", F.row_number().over(W.partitionBy("cycle", "_part").orderBy(*order)))
    top = local.where(F.col("_r") <= most).withColumn("place", F.row_number().over(W.partitionBy("cycle").orderBy(*order)))
    rest = local.where(F.col("_r") > most).withColumn("place", F.lit(None).cast("int"))
    out = top.unionByName(rest).drop("_part", "_r")
    return out.withColumn("place", F.when(F.col("place") <= most, F.col("place"))).withColumn("granted", F.col("place").isNotNull())


def suppress_repeats(alerts: DataFrame) -> DataFrame:
    """Add ``repeat`` to ``(event_id, news_id, asset, seq, direction, magnitude, confidence, source, …)``.

    An alert repeats if the one before it, of the same event (else article) and asset, has the same
    direction, magnitude and confidence to a tenth, and its verdict isn't a deep one. With one
    alert a key and batch this equals the published memory, as a held alert has the published shape.
    An event and asset may hold most alerts: they are cut into spans of ``seq``, which hand on their last shape.
    """
    key = F.coalesce(F.col("event_id").cast("string"), F.concat(F.lit("news:"), F.col("news_id").cast("string")))
    shape = F.struct("direction", "magnitude", F.bround(F.col("confidence") * 10).cast("int").alias("tenths"))
    out = alerts.withColumn("_key", key).withColumn("_asset", F.upper("asset")).withColumn("_shape", shape)
    out = cut_by_number(out, ["_key", "_asset"], "seq", "_span")
    out = carried(out, ["_key", "_asset"], ["seq"], F.col("_span"), last={"_before": "_shape"})
    same = F.coalesce(F.col("_before").eqNullSafe(F.col("_shape")) & F.col("_before").isNotNull(), F.lit(False))
    return out.withColumn("repeat", same & ~F.coalesce(F.col("source").isin("stage5", "final"), F.lit(False))).drop("_key", "_asset", "_shape", "_span", "_before")


def not_yet_alerted(alerts: DataFrame, sent: DataFrame) -> DataFrame:
    """Alerts whose (event, asset) has no sent alert; alerts without an event stay."""
    seen = sent.where("delivered").select(F.col("event_id").alias("_e"), F.upper("asset").alias("_a")).distinct()
    return alerts.join(seen, (alerts["event_id"] == F.col("_e")) & (F.upper(alerts["asset"]) == F.col("_a")), "left_anti")


def publish_gate(alerts: DataFrame, threshold: float = ALERT_SCORE, sent: DataFrame | None = None) -> DataFrame:
    """Add ``repeat`` and ``outcome``: below, suppressed or sent.

    ``sent(event_id, asset, delivered)`` are alerts of earlier runs, which left no memory of shapes: an alert of an event and
    asset that was delivered before is held, and nothing is remembered of it, until a deep verdict goes out; from then on
    repeats are told by shape. Alerts without an event are never held for the history's sake.
    """
    rows = alerts.where(F.col("alert_score") >= threshold)
    held = None
    if sent is not None:
        known = sent.where("delivered and event_id is not null").select(F.col("event_id").alias("_e"), F.upper("asset").alias("_a")).distinct()
        deep = rows.where(F.col("source").isin("stage5", "final")).groupBy(F.col("event_id").alias("_e"), F.upper("asset").alias("_a")).agg(F.min("seq").alias("_deep"))
        known = known.join(deep, ["_e", "_a"], "left").withColumn("_known", F.lit(True))
        marked = rows.join(known, (F.col("event_id") == F.col("_e")) & (F.upper("asset") == F.col("_a")), "left")
        silent = F.coalesce(F.col("_known") & (F.col("_deep").isNull() | (F.col("seq") < F.col("_deep"))), F.lit(False))
        marked = marked.withColumn("_silent", silent)
        held = marked.where("_silent").drop("_e", "_a", "_deep", "_known", "_silent").withColumn("repeat", F.lit(True))
        rows = marked.where("not _silent").drop("_e", "_a", "_deep", "_known", "_silent")
    above = suppress_repeats(rows)
    above = above if held is None else above.unionByName(held)
    above = above.withColumn("outcome", F.when(F.col("repeat"), "suppressed").otherwise("sent"))
    below = alerts.where(~(F.col("alert_score") >= threshold) | F.col("alert_score").isNull()).withColumn("repeat", F.lit(False)).withColumn("outcome", F.lit("below"))
    return above.unionByName(below)


def should_alert(direction: Column, score: Column, threshold: float = ALERT_SCORE) -> Column:
    return (direction != "NEUTRAL") & (score >= threshold)


def to_predictions(impacts: DataFrame) -> DataFrame:
    """Forecasts that will be scored: answered, and with a side."""
    return impacts.where((F.col("model_count") > 0) & (F.col("direction") != "MIXED"))


def order_alerts(alerts: DataFrame) -> DataFrame:
    """By score, the highest first; equal scores in the order of their ``seq``."""
    return alerts.orderBy(F.desc("alert_score"), "seq")


def deliveries(alerts: DataFrame, chats: DataFrame, digest_above: int = DIGEST_ABOVE) -> DataFrame:
    """Alerts for every chat; batches of more than a few alerts go as a digest. ``chats`` is a configured list of at most 1,000 rows; more is an error."""
    if chats.limit(1_001).count() > 1_000:
        raise ValueError("more than 1,000 chats")
    sizes = alerts.groupBy("batch").agg(F.count("*").alias("_n"))
    return alerts.join(sizes, "batch").withColumn("digest", F.col("_n") > digest_above).drop("_n").crossJoin(F.broadcast(chats))


def publish_report(gated: DataFrame, sends: DataFrame | None = None, by: str = "batch") -> DataFrame:
    """One row a pass: alerts considered, below the threshold, suppressed and passed; with ``sends(batch, delivered)``, one row a message and chat, also
    messages sent and failed, and whether the pass went out as a digest (more than ``DIGEST_ABOVE`` alerts passed)."""
    passed = F.count_if(F.col("outcome") == "sent")
    out = gated.groupBy(by).agg(
        F.count("*").alias("considered"), F.count_if(F.col("outcome") == "below").alias("below_threshold"), F.count_if(F.col("outcome") == "suppressed").alias("suppressed"), passed.alias("passed" if sends is not None else "sent")
    )
    if sends is None:
        return out
    told = sends.groupBy(by).agg(F.count_if("delivered").alias("sent"), F.count_if(~F.coalesce("delivered", F.lit(False))).alias("failed"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.join(told, by, "left").select(by, "considered", "below_threshold", "suppressed", "passed", none("sent"), none("failed"), (F.col("passed") > DIGEST_ABOVE).alias("digested"))
