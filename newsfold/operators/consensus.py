"""Votes of a panel of models, folded into verdicts.

Votes are rows ``(news_id, stage, asset, model_seq, ok, vote, reason, score, ...)``; every
operator is one aggregation by panel keys with map-side combine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import _strip
from ..functions.values import lookup

#: Answers that a verdict needs, and objections that reject, by stage (6: final). Fixed values.
MIN_VOTES = 2
REJECT_VOTES = {1: 2, 2: 3, 3: 3, 4: 3, 5: 3, 6: 2}
URGENCIES = {"low": 0, "medium": 1, "high": 2}


def majority_of(panel: int) -> int:
    """Votes that are a majority of a panel, two at least."""
    return max(2, panel // 2 + 1)


def build_votes(answers: DataFrame) -> DataFrame:
    """Add ``answered`` and ``label``: answers that failed or whose vote is null are NO_ANSWER."""
    answered = F.coalesce(F.col("ok"), F.lit(False)) & F.col("vote").isNotNull()
    return answers.withColumn("answered", answered).withColumn("label", F.when(~answered, "NO_ANSWER").when(F.col("vote"), "PASS").otherwise("REJECT"))


def tally(votes: DataFrame, keys: list[str], reject_votes: Column | int, min_votes: int = MIN_VOTES) -> DataFrame:
    """Counts, agreement, score and verdict of each panel."""
    passed = F.count_if(F.col("ok") & F.col("vote")).alias("votes_pass")
    rejected = F.count_if(F.col("ok") & ~F.col("vote")).alias("votes_reject")
    failed = F.count_if(~F.coalesce(F.col("ok"), F.lit(False)) | F.col("vote").isNull()).alias("votes_failed")
    score = F.median(F.when(F.col("ok") & F.col("vote").isNotNull(), F.col("score"))).alias("score") if "score" in votes.columns else F.lit(None).cast("double").alias("score")
    out = votes.groupBy(*keys).agg(passed, rejected, failed, score)
    answered = F.col("votes_pass") + F.col("votes_reject")
    limit = F.lit(reject_votes) if isinstance(reject_votes, int) else reject_votes
    verdict = F.when(answered < min_votes, "INCONCLUSIVE").when(F.col("votes_reject") >= limit, "REJECT").otherwise("PASS")
    note = F.when(answered < min_votes, F.concat(F.lit("quorum not met ("), answered.cast("string"), F.lit(" of "), (answered + F.col("votes_failed")).cast("string"), F.lit(f" models answered; need {min_votes})"))).otherwise("")
    agreement = F.when(answered > 0, F.greatest("votes_pass", "votes_reject") / answered).otherwise(F.lit(0.0))
    return out.withColumn("answered", answered).withColumn("agreement", agreement).withColumn("verdict", verdict).withColumn("note", note)


def passed(verdict: Column, fail_open: bool) -> Column:
    return (verdict == "PASS") | ((verdict == "INCONCLUSIVE") & F.lit(fail_open))


def verdict_summary(t: DataFrame) -> DataFrame:
    """Add ``summary``: verdict, votes, failures, score and note in one line."""
    parts = F.concat_ws(
        " · ", F.concat_ws(" ", "verdict", F.concat(F.col("votes_pass").cast("string"), F.lit("/"), F.col("answered").cast("string"))),
        F.when(F.col("votes_failed") > 0, F.concat(F.col("votes_failed").cast("string"), F.lit(" no-answer"))),
        F.when(F.col("score").isNotNull(), F.concat(F.lit("score="), F.bround("score").cast("long").cast("string"))), F.when(F.col("note") != "", F.col("note")),
    )
    return t.withColumn("summary", parts)


def aggregate_numeric(df: DataFrame, keys: list[str], value: str, method: str = "median") -> DataFrame:
    return df.groupBy(*keys).agg((F.median(value) if method == "median" else F.avg(value)).alias(value))


def majority_label(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """``label`` (the greatest on ties) and its ``share`` among non-empty labels."""
    counts = df.where(F.coalesce(F.col(label), F.lit("")) != "").groupBy(*keys, label).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.max_by(label, F.struct("n", label)).alias(label), (F.max("n") / F.sum("n")).alias("share"))


def best_evidence(text: Column, order: Column, most: int = 600) -> Column:
    """Aggregate: the longest trimmed text, the first in order on ties."""
    clean = _strip(F.coalesce(text, F.lit("")))
    return F.substring(F.max_by(clean, F.struct(F.length(clean), -order)), 1, most)


def drop_reason(votes: DataFrame, keys: list[str], with_score: bool = False) -> DataFrame:
    """``drop_reason`` of each panel: the first objector's reason with the count, else the summary."""
    first = F.when(F.col("ok") & ~F.col("vote") & (F.coalesce(F.col("reason"), F.lit("")) != ""), F.struct("model_seq", "reason"))
    reasons = votes.groupBy(*keys).agg(F.min(first)["reason"].alias("objection"))
    t = verdict_summary(tally(votes, keys, 2)).join(reasons, keys)
    tail = F.when(F.col("score").isNotNull(), F.concat(F.lit(", median score "), F.bround("score").cast("long").cast("string"))).otherwise("") if with_score else F.lit("")
    told = F.concat(F.col("votes_reject").cast("string"), F.lit("/"), F.col("answered").cast("string"), F.lit(" models: "), F.col("objection"))
    return t.select(*keys, F.concat(F.coalesce(told, F.col("summary")), tail).alias("drop_reason"))


def urgency(votes: DataFrame, keys: list[str]) -> DataFrame:
    """The answering models' median urgency, rounded half to even."""
    rank = F.when(F.col("ok"), F.coalesce(lookup(F.col("urgency"), URGENCIES), F.lit(1)))
    out = votes.groupBy(*keys).agg(F.bround(F.median(rank)).cast("int").alias("rank"))
    return out.select(*keys, F.coalesce(lookup(F.col("rank"), {v: k for k, v in URGENCIES.items()}), F.lit("medium")).alias("urgency"))


def stage2_reason(votes: DataFrame, keys: list[str]) -> DataFrame:
    """The longest reason of a model that passed."""
    reason = F.when(F.col("ok") & F.col("vote"), F.col("reason"))
    picked = F.max_by(reason, F.struct(F.length(reason), -F.col("model_seq")))
    return votes.groupBy(*keys).agg(F.coalesce(F.substring(picked, 1, 400), F.lit("")).alias("reason"))


def market_wide(votes: DataFrame, keys: list[str]) -> DataFrame:
    """Strict majority of answering models."""
    return votes.where("ok").groupBy(*keys).agg((F.count_if(F.col("market_wide")) * 2 > F.count("*")).alias("market_wide"))


def disagreement_summary(votes: DataFrame, keys: list[str]) -> DataFrame:
    """``2x BEARISH, 3x BULLISH`` where answers name more than one direction, else ''."""
    counts = votes.where("ok and direction is not null").groupBy(*keys, "direction").agg(F.count("*").alias("n"))
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("direction", "n"))), lambda x: F.concat(x["n"].cast("string"), F.lit("x "), x["direction"])), ", ")
    return counts.groupBy(*keys).agg(F.when(F.count("*") > 1, told).otherwise("").alias("disagreement"))


def model_health(results: DataFrame) -> DataFrame:
    """Answers, failures, mean latency and tokens by model and stage."""
    return results.groupBy("model_id", "stage").agg(
        F.count("*").alias("answers"), F.count_if(~F.col("ok")).alias("failures"), F.avg("latency_ms").alias("avg_latency_ms"), F.sum("tokens").alias("tokens")
    )
