"""Scoring forecasts against prices, and ranking the models that made them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..scale import carried, cut_by_time

#: Times of the observer. Fixed values.
GRACE_SECONDS, BASELINE_HOURS = 30, 6


def minutes(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), n)


def price_at(keys: DataFrame, candles: DataFrame) -> DataFrame:
    """Add ``price`` to ``(asset, at, …)``: the open of the minute's candle (the least of repeated ones), else of the next minute's. One lookup for each distinct (asset, minute)."""
    opens = candles.groupBy("asset", "minute_ts").agg(F.min("open").alias("open"))
    asked = keys.select("asset", F.date_trunc("minute", "at").alias("minute")).distinct()
    now = asked.join(opens.select("asset", F.col("minute_ts").alias("minute"), F.col("open").alias("_now")), ["asset", "minute"], "left")
    late = opens.select("asset", (F.col("minute_ts") - minutes(F.lit(1))).alias("minute"), F.col("open").alias("_next"))
    found = now.join(late, ["asset", "minute"], "left").select("asset", "minute", F.coalesce("_now", "_next").alias("price"))
    return keys.withColumn("minute", F.date_trunc("minute", "at")).join(found, ["asset", "minute"], "left").drop("minute")


def price_asof(keys: DataFrame, prices: DataFrame) -> DataFrame:
    """Add ``price`` to ``(key_id, asset, at)``: the last price at or before, for sparse series. ``key_id`` may have any type.

    Prices ``(asset, at, seq, price)`` and keys are one sorted sequence an asset, cut by time as its rows ask, so an asset may hold most rows. A key without an asset has no price.
    """
    both = prices.where("asset is not null").select("asset", "at", F.lit(0).alias("kind"), F.col("seq"), F.col("price").alias("_p"), F.lit(None).cast(keys.schema["key_id"].dataType).alias("key_id")).unionByName(
        keys.select("asset", "at", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("seq"), F.lit(None).cast("double").alias("_p"), "key_id")
    )
    out = carried(cut_by_time(both, ["asset"], "at", "_cut"), ["asset"], ["at", "kind", "seq"], F.col("_cut"), {"price": "_p"})
    return out.where("kind = 1").select("key_id", "asset", "at", "price")


def due_horizons(predictions: DataFrame, observed: DataFrame, as_of: Column) -> DataFrame:
    """``(id, asset, created_at, offset)``: configured horizons and the forecast's own, elapsed and not yet observed."""
    each = predictions.select("id", "asset", "created_at", F.explode(F.array_distinct(F.array_append(F.array(*map(F.lit, V.HORIZONS)), F.col("horizon_minutes").cast("int")))).alias("offset"))
    due = each.where((F.col("offset") > 0) & (as_of >= F.col("created_at") + minutes(F.col("offset")) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(GRACE_SECONDS))))
    return due.join(observed.select("id", "offset"), ["id", "offset"], "left_anti")


def observe(due: DataFrame, baselines: DataFrame, prices: DataFrame) -> DataFrame:
    """``(id, offset, pct)`` of due samples: % change from the baseline to the last price at the sample's time."""
    keys = due.select(F.struct("id", "offset").alias("k"), "asset", (F.col("created_at") + minutes(F.col("offset"))).alias("at"))
    priced = price_asof(keys.select(F.col("k").alias("key_id"), "asset", "at"), prices)
    out = priced.select("key_id.id", F.col("key_id.offset").cast("int").alias("offset"), "price")
    return out.join(baselines.select("id", "baseline_price"), "id").where("price is not null and baseline_price > 0").select("id", "offset", V.pct_change(F.col("baseline_price"), F.col("price")).alias("pct"))


def baselines(predictions: DataFrame, prices: DataFrame, as_of: Column) -> DataFrame:
    """Add ``baseline_price`` and ``state``: ready, pending, or abandoned when none came within the deadline."""
    priced = price_asof(predictions.select(F.col("id").alias("key_id"), "asset", F.col("created_at").alias("at")), prices)
    out = predictions.join(priced.select(F.col("key_id").alias("id"), F.col("price").alias("baseline_price")), "id", "left")
    late = as_of - F.col("created_at") > F.make_dt_interval(F.lit(0), F.lit(BASELINE_HOURS))
    return out.withColumn("state", F.when(F.col("baseline_price") > 0, "ready").when(late, "abandoned").otherwise("pending"))


def set_baseline(predictions: DataFrame, found: DataFrame) -> DataFrame:
    """Write baselines once: only where there is none."""
    new = found.select("id", F.col("price").alias("_new"))
    return predictions.join(new, "id", "left").withColumn("baseline_price", F.coalesce("baseline_price", "_new")).drop("_new")


def open_predictions(predictions: DataFrame, outcomes: DataFrame, observed: DataFrame, most: int = 200) -> DataFrame:
    """Unresolved forecasts, oldest first, with their observations as a map."""
    maps = observed.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("offset", "pct")))).alias("observations"))
    left = predictions.join(outcomes.select("id"), "id", "left_anti")
    return left.orderBy("created_at", "id").limit(most).join(maps, "id", "left")


def resolvable(predictions: DataFrame, observed: DataFrame, as_of: Column) -> DataFrame:
    """Forecasts whose own horizon is observed, or with any observation once all horizons have passed."""
    seen = observed.groupBy("id").agg(F.collect_set("offset").alias("_offsets"))
    past = as_of - F.col("created_at") >= minutes(F.lit(max(V.HORIZONS))) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(GRACE_SECONDS))
    return predictions.join(seen, "id").where(F.array_contains("_offsets", F.col("horizon_minutes").cast("int")) | past).drop("_offsets")


def score_predictions(predictions: DataFrame, observed: DataFrame) -> DataFrame:
    """One outcome for each forecast with an observation: scored at the offset nearest its horizon, with its best horizon."""
    each = predictions.join(observed, "id")
    low, high = V.expected_low(F.col("expected_low"), F.col("expected_high"), F.col("direction")), V.expected_high(F.col("expected_low"), F.col("expected_high"), F.col("direction"))
    each = each.withColumn("_low", low).withColumn("_high", high).withColumn("_far", F.abs(F.col("offset") - F.col("horizon_minutes")))
    sided = F.col("direction").isin("BULLISH", "BEARISH") & (V.direction_of(F.col("pct")) != F.col("direction"))
    penalty = F.struct((V.magnitude_error(F.col("pct"), F.col("_low"), F.col("_high")) + F.when(sided, 1000.0).otherwise(0.0)).alias("p"), "_far", "offset")
    out = each.groupBy("id", "direction", "_low", "_high").agg(F.min_by("pct", F.struct("_far", "offset")).alias("actual"), F.min_by("offset", penalty).alias("best_horizon_minutes"), F.count("*").alias("samples"))
    moved = V.direction_of(F.col("actual"))
    right = F.when(F.col("direction").isin("NEUTRAL", "MIXED"), moved == "NEUTRAL").otherwise(moved == F.col("direction"))
    error = V.magnitude_error(F.col("actual"), F.col("_low"), F.col("_high"))
    return out.select(
        "id", "direction", right.alias("direction_correct"), F.bround("actual", 4).alias("actual_pct"), F.bround((F.col("_low") + F.col("_high")) / 2, 4).alias("expected_pct"),
        F.bround(error, 4).alias("magnitude_error"), V.combined_score(right, error, F.col("_low"), F.col("_high")).alias("score"), "best_horizon_minutes", (moved != "NEUTRAL").alias("moved"), "samples",
    )


def close_unscored(predictions: DataFrame) -> DataFrame:
    """Outcomes with score 0 for forecasts of no priceable asset, or abandoned without a baseline."""
    why = F.when(~V.is_priceable(F.col("asset")), "unpriceable").when(F.col("state") == "abandoned", "no baseline")
    return predictions.withColumn("reason", why).where("reason is not null").select("id", F.lit(0.0).alias("score"), F.lit(True).alias("unscored"), "reason")


def observe_stats(predictions: DataFrame) -> DataFrame:
    """Counts of one pass over ``(state, asset)``."""
    return predictions.groupBy().agg(
        F.count("*").alias("considered"), F.count_if(~V.is_priceable(F.col("asset"))).alias("unpriceable"), F.count_if(F.col("state") == "ready").alias("ready"),
        F.count_if(F.col("state") == "pending").alias("pending"), F.count_if(F.col("state") == "abandoned").alias("abandoned"),
    )


def observe_report(predictions: DataFrame, observed: DataFrame, resolved: DataFrame) -> DataFrame:
    """Counts of one pass over ``(id, asset, state, had_baseline)``: also baselines that the pass set, samples ``observed(id, offset)`` that it
    took and forecasts ``resolved(id)`` that it scored. What has no priceable asset is counted as such and as nothing else.
    """
    live = V.is_priceable(F.col("asset"))
    state = lambda name: F.count_if(live & (F.col("state") == name))
    counts = predictions.agg(
        F.count("*").alias("considered"), F.count_if(live & (F.col("state") == "ready") & ~F.coalesce("had_baseline", F.lit(False))).alias("baselines_set"), F.count_if(~live).alias("unpriceable"),
        state("pending").alias("pending"), state("abandoned").alias("abandoned"),
    )
    own = predictions.where(live).select("id")
    samples = observed.join(own, "id", "left_semi").agg(F.count("*").alias("observations"))
    scored = resolved.join(own, "id", "left_semi").agg(F.count("*").alias("resolved"))
    return counts.crossJoin(samples).crossJoin(scored)  # one row each


def credit_models(outcomes: DataFrame, results: DataFrame) -> DataFrame:
    """Outcomes ``(news_id, stage, asset, …)`` with every model whose answer was usable there."""
    return outcomes.join(results.where("ok").select("news_id", "stage", "asset", "model_id", "latency_ms"), ["news_id", "stage", "asset"])


def model_performance(credited: DataFrame, with_totals: bool = False) -> DataFrame:
    """Counts and means by model, stage, event type and asset; with totals also under ``ALL``. Sums and counts are kept so that results merge."""
    keys = ["model_id", "stage", "event_type", "asset"]
    latency = F.when(F.col("latency_ms") > 0, F.col("latency_ms"))
    rows = credited.withColumn("stage", F.col("stage").cast("string"))
    grouped = rows.groupingSets([keys, ["model_id", "stage"]], *keys) if with_totals else rows.groupBy(*keys)
    total = F.grouping_id() if with_totals else F.lit(0)  # a real null is no total
    out = grouped.agg(
        total.alias("_total"),
        F.count("*").alias("predictions"), F.count_if(F.col("direction_correct")).alias("direction_correct"), F.avg("magnitude_error").alias("avg_magnitude_error"),
        F.avg("score").alias("avg_score"), F.avg(latency).alias("avg_latency_ms"), F.sum("score").alias("score_sum"), F.count(latency).alias("latency_count"),
    )
    return out.withColumns({k: F.when(F.col("_total") > 0, "ALL").otherwise(F.col(k)) for k in ("event_type", "asset")}).drop("_total")


def rank_models(performance: DataFrame) -> DataFrame:
    """Add hit rate and its shrunk form to rows with predictions, best first."""
    rows = performance.where("predictions > 0").withColumn("hit_rate", F.col("direction_correct") / F.col("predictions"))
    return rows.withColumn("adjusted", (F.col("direction_correct") + 2) / (F.col("predictions") + 4)).orderBy(F.desc("adjusted"), F.desc("predictions"))


def model_performance_page(performance: DataFrame, model_id: str | None = None, stage: str | None = None, most: int = 50) -> DataFrame:
    rows = performance if model_id is None else performance.where(F.col("model_id") == model_id)
    rows = rows if stage is None else rows.where(F.col("stage") == stage)
    return rows.orderBy(F.desc("predictions"), F.desc("avg_score"), "model_id", "stage", "event_type", "asset").limit(most)
