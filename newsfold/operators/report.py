"""Messages and reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import lookup

#: Glyphs and labels of messages. Fixed values.
MESSAGE_LIMIT = 4096
DIRECTION_MARK = {"BULLISH": "🟢", "BEARISH": "🔴", "NEUTRAL": "⚪", "MIXED": "🟡"}
MAGNITUDE_MARK = {"LOW": "▫️", "MEDIUM": "🔶", "HIGH": "🔺", "EXTREME": "🌋"}
URGENCY_MARK = {"critical": "🚨", "high": "⚡", "medium": "📊", "low": "📄"}
CAUSE = {"DIRECT": "direct exposure", "INDIRECT": "second-order", "MACRO": "macro", "LIQUIDITY": "liquidity", "SENTIMENT": "sentiment", "REGULATORY": "regulatory", "FUNDAMENTAL": "fundamentals"}
DEPTH = {"stage4": "5-model panel", "stage5": "5-model panel + deep cross-check", "final": "deep cross-check + heavy panel"}


def escape(c: Column) -> Column:
    text = F.coalesce(c, F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def percent(c: Column) -> Column:
    return F.concat(F.bround(c * 100).cast("long").cast("string"), F.lit("%"))


def pct_range(low: Column, high: Column, direction: Column) -> Column:
    small, large = F.least(F.abs(low), F.abs(high)), F.greatest(F.abs(low), F.abs(high))
    sign = F.when(direction == "BULLISH", "+").when(direction == "BEARISH", "−").otherwise("±")
    one = lambda x: F.format_string("%.1f%%", x)
    return F.when(large - small < 0.05, F.concat(sign, one(large))).otherwise(F.concat(sign, one(small), F.lit(" … "), sign, one(large)))


def confidence_bar(c: Column) -> Column:
    filled = F.greatest(F.lit(0), F.least(F.lit(5), F.bround(c * 5).cast("int")))
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), 5 - filled))


def horizon_label(minutes: Column) -> Column:
    return F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min"))).otherwise(F.concat(F.floor(minutes / 60).cast("string"), F.lit("h")))


def _line(when: Column, *parts: Column) -> Column:
    return F.when(when, F.concat(*parts))


def render_alerts(alerts: DataFrame) -> DataFrame:
    """Add ``message`` (marked up) and ``plain`` to alerts with their article's columns."""
    c, L = F.col, F.lit
    kind = F.when(c("is_update"), "UPDATE").otherwise("NEW")
    event = F.replace(F.coalesce("event_type", L("OTHER")), L("_"), L(" "))
    swing = pct_range(c("expected_low"), c("expected_high"), c("direction"))
    indirect = F.when(c("relation") != "DIRECT", F.concat(L(" ("), F.lower("relation"), L(")"))).otherwise("")
    sources = F.concat(F.coalesce("source_name", L("unknown")), F.when(c("source_count") > 1, F.concat(L(" +"), (c("source_count") - 1).cast("string"), L(" more"))).otherwise(""))
    message = F.concat_ws(
        "\n", F.concat(lookup(c("urgency"), URGENCY_MARK, "📊"), L(" <b>"), escape(event), L("</b> · "), kind), F.concat(L("<i>"), escape(c("headline")), L("</i>")), L(""),
        F.concat(lookup(c("direction"), DIRECTION_MARK, "⚪"), L(" <b>"), escape(c("asset")), L("</b> — <b>"), c("direction"), L("</b>"), indirect),
        F.concat(lookup(c("magnitude"), MAGNITUDE_MARK, "▫️"), L(" Expected move: <b>"), swing, L("</b> ("), c("magnitude"), L(")")),
        F.concat(L("🎯 Confidence: <b>"), percent(c("confidence")), L("</b> "), confidence_bar(c("confidence"))), F.concat(L("⏱ Horizon: <b>"), horizon_label(c("horizon_minutes")), L("</b>")),
        _line(c("tradeable") == L(False), L("🚧 <b>Not tradeable</b> — move too small or panel unresolved")), _line(c("mechanism") != "", L("\n💡 <b>Why:</b> "), escape(c("mechanism"))),
        _line(c("risks") != "", L("⚠️ <b>Risk:</b> "), escape(c("risks"))), L(""), F.concat(L("🔗 "), escape(sources)),
        F.concat(L("🧠 "), lookup(c("source"), DEPTH, "panel"), L(" · "), c("model_count").cast("string"), L(" models · "), percent(c("agreement")), L(" agreement")),
        F.concat(L("📈 "), lookup(c("causality"), CAUSE, "sentiment"), L(" · score "), F.bround("alert_score").cast("long").cast("string")), _line(c("url") != "", L('<a href="'), escape(c("url")), L('">read the source</a>')),
    )
    plain = F.concat_ws(
        "\n", F.concat(L("["), event, L(" · "), kind, L("]")), c("headline"), L(""), F.concat(c("asset"), L(": "), c("direction"), L(" "), swing, L(" ("), c("magnitude"), L(")")),
        F.concat(L("confidence "), percent(c("confidence")), L(" · horizon "), horizon_label(c("horizon_minutes")), L(" · "), c("model_count").cast("string"), L(" models")),
        _line(c("mechanism") != "", L("\nWhy: "), c("mechanism")), _line(c("risks") != "", L("Risk: "), c("risks")), _line(c("url") != "", L("\n"), c("url")),
    )
    return alerts.withColumn("message", message).withColumn("plain", plain)


def render_digest(alerts: DataFrame, most: int = 8) -> DataFrame:
    """``(batch, message)``: a line for each of the strongest alerts of a batch."""
    line = F.concat(lookup(F.col("direction"), DIRECTION_MARK, "⚪"), F.lit(" "), F.col("asset"), F.lit(" "), pct_range(F.col("expected_low"), F.col("expected_high"), F.col("direction")), F.lit(" · "), percent(F.col("confidence")))
    from pyspark.sql import Window as W

    strongest = [F.desc("alert_score"), F.col("event_id"), F.col("asset")]
    part = F.pmod(F.xxhash64("event_id", "asset"), F.lit(64))
    few = alerts.withColumn("_line", line).withColumn("_r", F.row_number().over(W.partitionBy("batch", part).orderBy(*strongest))).where(F.col("_r") <= most)
    few = few.withColumn("_r", F.row_number().over(W.partitionBy("batch").orderBy(*strongest))).where(F.col("_r") <= most)
    lines = few.groupBy("batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_line"))), lambda x: x["_line"]), "\n").alias("lines"))
    sizes = alerts.groupBy("batch").agg(F.count("*").alias("n"))
    more = F.when(F.col("n") > most, F.concat(F.lit("\n…and "), (F.col("n") - most).cast("string"), F.lit(" more"))).otherwise("")
    return lines.join(sizes, "batch").select("batch", F.concat(F.lit("📋 "), F.col("n").cast("string"), F.lit(" alerts\n"), F.col("lines"), more).alias("message"))


def _parts(text: str | None, limit: int) -> list[str] | None:
    """Parts of at most ``limit`` characters, cut at a blank line or a line end in the second half if there is one."""
    if text is None:
        return None
    out = []
    while len(text) > limit:
        cut = next((at for mark in ("\n\n", "\n") if (at := text.rfind(mark, 0, limit)) >= limit // 2), limit)
        out.append(text[:cut].rstrip())
        text = text[cut:].lstrip("\n")
    return [*out, text] if text or not out else out


def split_messages(df: DataFrame, text: str = "message", limit: int = MESSAGE_LIMIT) -> DataFrame:
    """A row for each part of a message; only messages over the limit cross to Python."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(messages: pd.Series) -> pd.Series:
        return messages.map(lambda m: _parts(m, limit), na_action="ignore")

    long = F.length(text) > limit
    parts = F.coalesce(cut(F.when(long, F.col(text))), F.array(F.col(text)))
    return df.select("*", F.posexplode(parts).alias("part", "part_text"))


def counts(**tables: DataFrame) -> DataFrame:
    """``(name, rows)`` of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.unionAll(one)
    return out


def funnel(gated: DataFrame, by: str = "run") -> DataFrame:
    """Articles seen and dropped at each stage of a run."""
    dropped = [F.count_if(F.col("dropped_at") == k).alias(f"dropped_{k}") for k in range(5)]
    return gated.groupBy(by).agg(F.count("*").alias("seen"), *dropped, F.count_if(F.col("dropped_at").isNull()).alias("through"))


#: Counters of a run, as conditions over one row an article ``(decision, dropped_at, escalated5, escalated_final, alerts, errors, calls, failures)``.
def _counters() -> list[Column]:
    c, total = F.col, lambda name: F.coalesce(F.sum(name), F.lit(0)).cast("long").alias(name)
    passed = F.coalesce(c("dropped_at") > 3, F.lit(True))
    return [
        F.count(F.lit(1)).alias("ingested"), F.count_if(~c("decision").isin("NEW", "UPDATE")).alias("duplicates"), F.count_if(c("decision") == "NEW").alias("new_events"), F.count_if(c("decision") == "UPDATE").alias("updates"),
        *[F.count_if(c("dropped_at") == k).alias(f"dropped_stage{k}") for k in (1, 2, 3)], F.count_if(passed).alias("analysed"), F.count_if("escalated5").alias("escalated_stage5"),
        F.count_if("escalated_final").alias("escalated_final"), *[total(n) for n in ("alerts", "errors", "calls", "failures")],
    ]


def run_rows(gated: DataFrame, escalated: DataFrame, finals: DataFrame, alerts: DataFrame, answers: DataFrame) -> DataFrame:
    """Articles ``(news_id, decision, dropped_at, …)`` with what else their runs count.

    ``escalated`` and ``finals`` ``(news_id, …)`` are assets that went deeper; an article counts once, and only if nothing dropped it.
    ``alerts(news_id, …)``; ``answers(news_id, ok, error)``: calls, failed ones, and those whose error text tells of a defect and not of a refusal by the provider.
    """
    once = lambda df, name: df.select("news_id").distinct().withColumn(name, F.lit(True))
    calls = answers.groupBy("news_id").agg(F.count("*").alias("calls"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("failures"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("errors"))
    told = alerts.groupBy("news_id").agg(F.count("*").alias("alerts"))
    rows = gated.join(once(escalated, "_e5"), "news_id", "left").join(once(finals, "_ef"), "news_id", "left").join(told, "news_id", "left").join(calls, "news_id", "left")
    through = F.col("dropped_at").isNull()
    return rows.withColumns({"escalated5": F.coalesce(F.col("_e5") & through, F.lit(False)), "escalated_final": F.coalesce(F.col("_ef") & through, F.lit(False))}).drop("_e5", "_ef")


def run_report(rows: DataFrame, by: str = "run") -> DataFrame:
    """One row a run: articles seen, duplicates, events begun and updated, drops, analyses, escalations, alerts, errors, calls and failures."""
    return rows.groupBy(by).agg(*_counters())


def observed_run(rows: DataFrame, name: str = "run") -> DataFrame:
    """The same counters as metrics of the rows that pass, of a batch or of each micro-batch of a stream (``observedMetrics`` of its progress): no job of their own."""
    return rows.observe(name, *_counters())


def audit_summary(audits: DataFrame, keys: list[str], order: str = "model_seq") -> DataFrame:
    """``(keys…, summary)``: how many auditors ``(…, ok, confirms, priced_in, conflicts, overlooked, reason)`` confirm, what they object to, and the longest reason.

    Only auditors that answered and said whether they confirm count; of equally long reasons the first in order. A panel is a handful of models.
    """
    used = F.coalesce(F.col("ok"), F.lit(False)) & F.col("confirms").isNotNull()
    notes = F.concat(*[F.coalesce(n, F.array().cast("array<string>")) for n in ("conflicts", "overlooked")])
    out = audits.groupBy(*keys).agg(
        F.count_if(used).alias("n"), F.count_if(used & F.col("confirms")).alias("yes"), F.count_if(used & F.coalesce("priced_in", F.lit(False))).alias("priced"),
        F.collect_list(F.when(used, F.struct(F.col(order).alias("o"), notes.alias("notes")))).alias("said"),
        F.max_by("reason", F.when(used & (F.coalesce("reason", F.lit("")) != ""), F.struct(F.length("reason"), -F.col(order)))).alias("why"),
    )
    items = F.filter(F.transform(F.flatten(F.transform(F.sort_array("said"), lambda x: x["notes"])), lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "")
    objections = F.substring(F.array_join(F.slice(F.array_distinct(items), 1, 3), "; "), 1, 400)
    line = F.concat_ws(
        "; ", F.concat(F.col("yes").cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(" confirmed")), F.when(F.col("priced") * 2 > F.col("n"), "majority say already priced in"),
        F.when(objections != "", F.concat(F.lit("objections: "), objections)), F.substring("why", 1, 300),
    )
    return out.select(*keys, F.when(F.col("n") > 0, line).otherwise("no usable cross-check").alias("summary"))


def final_summary(answers: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys…, summary)``: how many of the final panel ``(…, ok, direction, tradeable)`` back the most frequent direction (of equally frequent ones the greatest), and how many call it tradeable."""
    used = F.coalesce(F.col("ok"), F.lit(False)) & (F.coalesce("direction", F.lit("")) != "")
    each = answers.groupBy(*keys, F.when(used, F.col("direction")).alias("direction")).agg(F.count_if(used).alias("n"), F.count_if(used & F.coalesce("tradeable", F.lit(False))).alias("t"))
    out = each.groupBy(*keys).agg(F.max_by("direction", F.when(F.col("n") > 0, F.struct("n", "direction"))).alias("top"), F.max("n").alias("most"), F.sum("n").alias("n"), F.sum("t").alias("t"))
    count = lambda c: F.col(c).cast("string")
    line = F.concat(count("most"), F.lit("/"), count("n"), F.lit(" heavy models "), "top", F.lit(" ("), percent(F.col("most") / F.col("n")), F.lit("), "), count("t"), F.lit("/"), count("n"), F.lit(" tradeable"))
    return out.select(*keys, F.when(F.col("n") > 0, line).otherwise("final layer unavailable").alias("summary"))


def recent_analyses(analyses: DataFrame, events: DataFrame, news: DataFrame, most: int) -> DataFrame:
    """The newest verdicts with their event's and article's columns: the top rows first, so that joins are small."""
    top = analyses.orderBy(F.desc("created_at"), F.desc("id")).limit(most)
    return enrich_verdicts(top, events, news).orderBy(F.desc("created_at"), F.desc("id"))


def enrich_verdicts(analyses: DataFrame, events: DataFrame, news: DataFrame) -> DataFrame:
    return analyses.join(events, "event_id", "left").join(news, "news_id", "left")
