"""Call logs of model providers: what failed, why, for how long, and how keys fare."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import _strip

# ---------------------------------------------------------------- fixed values
INVALID_KEY = [
    "api key not valid", "api_key_invalid", "api key expired", "invalid api key", "invalid_api_key", "invalid authentication", "incorrect api key",
    "unauthorized", "permission_denied", "permission denied", "authentication_error", "no access to model", "consumer has been suspended",
]
QUOTA = ["quota", "resource_exhausted", "insufficient_quota", "billing", "credit balance", "out of credits", "exceeded your current", "free tier", "spend limit"]
RATE_LIMIT = ["rate limit", "rate_limit", "too many requests", "requests per", "tokens per", "please try again in"]
COOLDOWN_BASE, COOLDOWN_MAX, QUOTA_COOLDOWN, DEAD_RETRY = 20.0, 900.0, 1800.0, 1800.0


def _holds(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def classify(status: Column, body: Column) -> Column:
    """``(disposition, fault)`` of a response; nulls for 2xx."""
    low = F.lower(F.coalesce(body, F.lit("")))
    d, f = (lambda pick: F.when((status >= 200) & (status < 300), F.lit(None).cast("string")).otherwise(pick)), None
    rules = [
        (status.isin(401, 403, 407), "retry_other_key", "invalid"), ((status == 429) & _holds(low, QUOTA), "retry_other_key", "quota"), (status == 429, "retry_other_key", "rate_limited"),
        (status == 413, "fatal", "none"), (status.isin(402, 451), "retry_other_key", "quota"), ((status == 400) & _holds(low, INVALID_KEY), "retry_other_key", "invalid"),
        ((status == 400) & _holds(low, QUOTA), "retry_other_key", "quota"), (status.isin(400, 404), "fatal", "none"), (status.isin(408, 409, 425), "retry_same_key", "transient"),
        (status.isin(422, 501, 405, 406, 415), "fatal", "none"), (status >= 500, "retry_same_key", "transient"),
        ((status >= 400) & _holds(low, RATE_LIMIT), "retry_other_key", "rate_limited"), (status >= 400, "fatal", "none"),
    ]
    pick = lambda i, last: reduce(lambda out, r: F.when(r[0], F.lit(r[i])).otherwise(out), reversed(rules), F.lit(last))
    return F.struct(d(pick(1, "retry_same_key")).alias("disposition"), d(pick(2, "transient")).alias("fault"))


def retry_after(body: Column) -> Column:
    """Seconds that a message asks to wait."""
    body = F.coalesce(body, F.lit(""))
    pattern = r"(?i)try again in\s+([0-9]+(?:\.[0-9]+)?)\s*(ms|s|m)?"
    number, unit = F.regexp_extract(body, pattern, 1), F.lower(F.regexp_extract(body, pattern, 2))
    prose = F.when(number != "", number.cast("double") * F.when(unit == "ms", 0.001).when(unit == "m", 60.0).otherwise(1.0))
    field = F.regexp_extract(body, r'"retryDelay"\s*:\s*"?([0-9.]+)s"?', 1)
    return F.coalesce(prose, F.when(field != "", field.cast("double")))


def provider_message(body: Column, most: int = 400) -> Column:
    """The readable message of an error body."""
    text = _strip(F.coalesce(body, F.lit("")))
    get = lambda p: F.when(F.get_json_object(text, p) != "", F.get_json_object(text, p))
    error = F.get_json_object(text, "$.error")
    plain = F.when(error.isNotNull() & ~F.startswith(error, F.lit("{")) & (error != ""), error)
    found = F.coalesce(get("$.error.message"), get("$.error.status"), get("$.error.code"), plain, get("$.message"), get("$.detail"), get("$.title"), get("$.warnings"))
    return F.when(text == "", "empty response body").otherwise(F.substring(F.coalesce(found, text), 1, most))


def classify_errors(log: DataFrame) -> DataFrame:
    c = classify(F.col("status"), F.col("body"))
    return log.withColumn("disposition", c["disposition"]).withColumn("fault", c["fault"]).withColumn("retry_after", retry_after(F.col("body"))).withColumn("message", F.when(F.col("fault").isNotNull(), provider_message(F.col("body"))))


def unwrap_responses(df: DataFrame, raw: str = "body") -> DataFrame:
    """Add text, finish reason, token counts, and whether the answer was rejected or cut, to raw vendor responses of two shapes."""
    j = lambda p: F.get_json_object(F.col(raw), p)
    parts = lambda p: F.array_join(F.transform(F.from_json(j(p), "array<struct<text:string>>"), lambda x: F.coalesce(x["text"], F.lit(""))), "")
    content = j("$.choices[0].message.content")
    chat = F.when(F.startswith(content, F.lit("[")), parts("$.choices[0].message.content")).otherwise(content)
    chat = F.coalesce(F.when(chat != "", chat), F.when(j("$.choices[0].message.reasoning") != "", j("$.choices[0].message.reasoning")), j("$.choices[0].message.reasoning_content"))
    text = F.coalesce(chat, parts("$.candidates[0].content.parts"), F.lit(""))
    finish = F.coalesce(j("$.choices[0].finish_reason"), j("$.candidates[0].finishReason"))
    blocked = F.upper(F.coalesce(finish, F.lit(""))).isin("SAFETY", "RECITATION", "BLOCKLIST", "PROHIBITED_CONTENT") & (text == "")
    return df.withColumns({
        "text": text, "finish": finish, "prompt_tokens": F.coalesce(j("$.usage.prompt_tokens"), j("$.usageMetadata.promptTokenCount")).cast("int"),
        "completion_tokens": F.coalesce(j("$.usage.completion_tokens"), j("$.usageMetadata.candidatesTokenCount")).cast("int"),
        "rejected": blocked | j("$.promptFeedback.blockReason").isNotNull(), "truncated": F.lower(F.coalesce(finish, F.lit(""))).isin("length", "max_tokens"),
    })


def key_health(log: DataFrame) -> DataFrame:
    """Totals, failures since the last success, and the cool-down's end, of each (provider, key).

    Two aggregations and a join by key: the last success is found first, then what failed after
    it is counted. A cool-down doubles with every failure in a row; quota failures have their own;
    a provider's longer wait counts. Failures that were the request's fault penalise no key.
    """
    at = F.struct("ts", "id")
    rows = classify_errors(log).withColumn("ok", F.col("status").between(200, 299)).withColumn("bad", F.coalesce(F.col("fault") != "none", F.lit(False)))
    keys = ["provider", "key_index"]
    good = rows.where("ok").groupBy(*keys).agg(F.max(at).alias("last_ok"))
    marked = rows.join(good, keys, "left").withColumn("after", F.col("bad") & (F.col("last_ok").isNull() | (at > F.col("last_ok"))))
    out = marked.groupBy(*keys).agg(
        F.count_if(F.col("ok")).alias("success"), F.count_if(F.col("bad")).alias("failure"), F.count_if(F.col("fault") == "rate_limited").alias("rate_limited"),
        F.count_if(F.col("fault") == "quota").alias("quota"), F.count_if(F.col("fault") == "invalid").alias("invalid"), F.count_if(F.col("after")).alias("consecutive_failures"),
        F.max_by(F.struct("ts", "fault", "retry_after"), F.when(F.col("after"), at)).alias("last"), F.avg(F.when(F.col("ok"), F.col("latency_ms").cast("double"))).alias("avg_latency_ms"),
    )
    base = F.when(F.col("last.fault") == "quota", QUOTA_COOLDOWN).otherwise(COOLDOWN_BASE * F.pow(F.lit(2.0), F.col("consecutive_failures") - 1))
    wait = F.when(F.col("last.fault") == "invalid", DEAD_RETRY).otherwise(F.least(F.greatest(base, F.coalesce("last.retry_after", F.lit(0.0))), F.lit(max(COOLDOWN_MAX, QUOTA_COOLDOWN))))
    state = F.when(F.col("last").isNull(), "healthy").when(F.col("last.fault") == "invalid", "dead").otherwise("cooling")
    until = F.when(F.col("last").isNotNull(), F.timestamp_micros((F.unix_micros(F.col("last.ts").cast("timestamp")) + wait * 1_000_000).cast("long")))
    return out.withColumn("status", state).withColumn("cooldown_seconds", F.when(F.col("last").isNotNull(), wait)).withColumn("available_at", until.cast("timestamp_ntz")).drop("last")
