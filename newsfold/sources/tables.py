"""Typed tables, scans and keyed sinks. Without a table format here, upserts are staged joins written as a new version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scale import Scratch, delete

#: Schemas of the tables. JSON side columns are maps or texts.
SCHEMAS = {
    "news": "id long, title string, body string, url string, source string, source_type string, published_at timestamp, fetched_at timestamp, exact_hash string, norm_hash string, title_hash string, "
    "url_hash string, identity_key string, embedding array<float>, event_id long, decision string, matched_id long, stage int, dropped_at int, drop_reason string, processed_at timestamp",
    "events": "event_id long, identity_key string, event_type string, entity string, asset string, action string, target string, headline string, state map<string,string>, status string, "
    "first_seen timestamp, last_seen timestamp, article_count int, update_count int, importance double",
    "event_updates": "id long, event_id long, news_id long, changed map<string,string>, previous map<string,string>, new map<string,string>, summary string, created_at timestamp",
    "stage_results": "id long, news_id long, stage int, asset string, model_id string, provider string, ok boolean, vote boolean, detail string, latency_ms long, tokens long, created_at timestamp",
    "stage_consensus": "news_id long, stage int, asset string, verdict string, votes_pass int, votes_reject int, votes_failed int, agreement double, score double, note string, created_at timestamp",
    "analyses": "id long, news_id long, event_id long, asset string, direction string, magnitude string, expected_low double, expected_high double, confidence double, horizon_minutes int, "
    "causality string, relation string, mechanism string, risks string, agreement double, model_count int, deepest_stage int, final boolean, tradeable boolean, created_at timestamp",
    "predictions": "id long, news_id long, event_id long, asset string, direction string, expected_low double, expected_high double, confidence double, horizon_minutes int, baseline_price double, "
    "model_ids array<string>, resolved boolean, created_at timestamp",
    "observations": "prediction_id long, offset int, price double, pct double, observed_at timestamp",
    "outcomes": "prediction_id long, score double, direction_correct boolean, best_horizon_minutes int, by_horizon map<int,double>, unscored boolean, created_at timestamp",
    "model_performance": "model_id string, stage string, event_type string, asset string, predictions long, direction_correct long, score_sum double, error_sum double, latency_sum double, latency_count long, failures long",
    "key_health": "provider string, key_index int, status string, success long, failure long, consecutive_failures long, available_at timestamp",
    "alerts": "id long, event_id long, news_id long, asset string, chat_id string, score double, delivered boolean, message_id string, error string, created_at timestamp",
    "runs": "id long, started_at timestamp, finished_at timestamp, funnel map<string,long>",
}

#: How columns of a known key take an update: new (if there is one), replace (also by null), old (first wins), max, or (booleans), sum. Fixed values.
RULES = {
    "news": {"event_id": "new", "decision": "new", "identity_key": "new", "embedding": "new", "matched_id": "new", "stage": "new", "dropped_at": "new", "drop_reason": "new", "processed_at": "new"},
    "events": {"last_seen": "max", "importance": "max"},
    "stage_consensus": {"*": "replace"},
    "analyses": {"*": "new", "id": "old", "created_at": "old", "deepest_stage": "max", "final": "or"},
    "predictions": {"resolved": "or"},
    "observations": {"*": "old"},
    "outcomes": {"*": "replace"},
    "model_performance": {"*": "sum"},
    "key_health": {"status": "new", "success": "sum", "failure": "sum", "consecutive_failures": "new", "available_at": "new"},
}
KEYS = {
    "news": ["exact_hash"], "events": ["identity_key"], "stage_consensus": ["news_id", "stage", "asset"], "analyses": ["news_id", "asset"], "observations": ["prediction_id", "offset"],
    "outcomes": ["prediction_id"], "predictions": ["id"], "model_performance": ["model_id", "stage", "event_type", "asset"], "key_health": ["provider", "key_index"],
}


def read_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A table of a folder; only the columns named are read."""
    df = spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}") if name in SCHEMAS else spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def pending(news: DataFrame, most: int) -> DataFrame:
    """Unprocessed rows, by id."""
    return news.where(F.col("processed_at").isNull()).orderBy("id").limit(most)


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], rules: dict[str, str], order: str) -> DataFrame:
    """``target`` with ``updates`` folded in by key: unknown keys are inserted, known ones take each column by its rule.

    One full-outer join on the keys. Updates that repeat a key are reduced first, to the last by ``order``.
    """
    fresh = updates.groupBy(*keys).agg(F.max_by(F.struct(*updates.columns), F.col(order)).alias("n")).select("n.*")
    value = lambda c: rules.get(c, rules.get("*", "old"))
    old, new = (lambda c: F.col(f"t.{c}")), (lambda c: F.col(f"u.{c}") if c in updates.columns else F.lit(None))
    def merged(c: str) -> Column:
        if c in keys:
            return F.coalesce(old(c), new(c)).alias(c)
        how = value(c)
        if how == "max":
            return F.greatest(old(c), new(c)).alias(c)
        if how == "or":
            return (F.coalesce(old(c), F.lit(False)) | F.coalesce(new(c), F.lit(False))).alias(c)
        known = F.coalesce(old(c), new(c)) if how == "old" else F.coalesce(new(c), old(c))
        return known.alias(c)
    on = [F.col(f"t.{k}") == F.col(f"u.{k}") for k in keys]
    return target.alias("t").join(fresh.alias("u"), on, "full_outer").select(*[merged(c) for c in target.columns])


def append(df: DataFrame, path: str, by: str = "date", at: str = "created_at") -> None:
    df.withColumn(by, F.to_date(at)).write.mode("append").partitionBy(by).parquet(path)


def mark_processed(news: DataFrame, results: DataFrame) -> DataFrame:
    """Progress ``(id, stage, dropped_at, drop_reason, processed_at)`` written into articles; the rest keep theirs."""
    names = ["stage", "dropped_at", "drop_reason", "processed_at"]
    new = results.select("id", *[F.col(n).alias(f"_{n}") for n in names])
    out = news.join(new, "id", "left")
    for n in names:
        out = out.withColumn(n, F.coalesce(f"_{n}", n)).drop(f"_{n}")
    return out.select(*news.columns)


def lookback(df: DataFrame, as_of: Column, days: int = 7, at: str = "fetched_at", since: Column | None = None, day: str | None = None) -> DataFrame:
    """Rows from ``days`` before ``since`` (which is ``as_of`` where it isn't given) to ``as_of``, both ends included.

    ``day`` names the date column that the table is partitioned by, if it is: folders of other days are then not read.
    """
    start = (as_of if since is None else since) - F.make_dt_interval(F.lit(days))
    kept = df.where((F.col(at) >= start) & (F.col(at) <= as_of))
    return kept if day is None else kept.where((F.col(day) >= F.to_date(start)) & (F.col(day) <= F.to_date(as_of)))


def retain(news: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Drop rows that are older than the lookback and processed."""
    old = F.col("fetched_at") < as_of - F.make_dt_interval(F.lit(days))
    return news.where(~(old & F.col("processed_at").isNotNull()))


def purge(spark: SparkSession, path: str, as_of: Column, days: int = 7, day: str = "day") -> None:
    """Apply :func:`retain` to a table in folders by fetch date, which the column ``day`` names: only folders of days that the lookback has left
    behind are read and replaced, or deleted where nothing stays; newer ones are not touched.

    What stays is staged in the shared folder first. A purge that died halfway is simply made again.
    """
    stored = spark.read.parquet(path)
    last = F.to_date(as_of - F.make_dt_interval(F.lit(days)))
    aged = stored.where(F.col(day) <= last)
    scratch = Scratch(spark, "purge")
    kept = scratch.put(retain(aged, as_of, days), "kept")
    gone = aged.select(day).distinct().join(kept.select(day).distinct(), day, "left_anti")
    folders = [r[0] for r in gone.collect()]  # a row a day that has nothing left
    kept.repartition(day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)
    for d in folders:
        delete(spark, f"{path}/{day}={d}")
    scratch.clear()
