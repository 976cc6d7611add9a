"""Mixing sources to target weights (operator 5): a time-varying curriculum.

Every source has a weight, which sets its share of the whole budget of words, and a
schedule, which says how its intensity changes over training time 0..1. Targets above a
multiple of what a source has are lowered to it and the excess is shared again by weight.
Within a source, documents stand in a hashed order; the running total of words (taken per
bounded range of the order, so that a source may hold most rows) tells each document's
place in the source's demand. The integral of the schedule, inverted at that place, is
its training time; at each time the sources' shares are as target times schedule. All
sources' demand up to that time, as a share of the whole, is the document's position in
tokens, by which documents are range-sorted.

Only built-in functions are used; each shuffle carries narrow rows without texts.
"""

from __future__ import annotations

import re
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scale import global_rank, running_total, settle
from .rows import id_hash, matched, text_hash

#: Default schedules by weight: relative intensity in four equal parts of the training time.
SCHEDULES = {1: [1.0, 1.0, 1.0, 1.0], 2: [1.0, 2.0, 3.0, 4.0], 3: [4.0, 3.0, 2.0, 1.0]}


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def default_weights(sources: DataFrame) -> DataFrame:
    """Weights 1, 2, 3, repeating, over sources by code point, null last."""
    ranked = global_rank(sources, F.col("source").asc_nulls_last())
    return ranked.withColumn("weight", (F.col("rank") % 3 + 1).cast("double")).drop("rank")


def targets(sources: DataFrame, most: float = 3.0) -> DataFrame:
    """Add ``target`` to ``(source, source_size, weight, ...)``: shares of the sum of all sizes by
    weight, none above ``most`` times its source's size. Excess is reshared until none is above:
    each round is one aggregate of the sources to one row. Null or non-positive weights get nothing.
    """
    sources = settle(sources.withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))).withColumn("_cap", most * F.col("source_size")))
    whole, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    whole, weights = float(whole or 0), float(weights or 0)
    level, full = (whole / weights if weights else 0.0), 0
    while True:
        over = (F.col("_cap") <= level * F.col("weight")) & (F.col("weight") > 0)
        n, caps, rest = sources.agg(
            F.count_if(over), F.coalesce(F.sum(F.when(over, F.col("_cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))
        ).first()
        if n == full or rest <= 0:
            break
        full, level = n, (whole - caps) / rest
    return sources.withColumn("target", F.least(F.col("_cap"), level * F.col("weight")).cast("double")).drop("_cap")


def shares(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: DataFrame | None = None,
    most: float = 3.0, schedules: dict[int, list[float]] | None = None,
) -> DataFrame:
    """One row per row of ``df``: id, source, size, source_size, target, before, taken, demand, intensity.

    ``taken`` is the number of words that the mix takes: whole passes over the source, and in
    the last pass the documents up to the demand, of which the last one is cut at the demand.
    So a source's taken words are its target, rounded, and no document is taken more than
    ``most`` times. Null sources are a source; null and empty texts have size 0 and take
    nothing. Rows that repeat an id count each; where hashes of the order are equal, size, id
    and text decide. ``weights(source, weight)`` replaces the
    default weights; a source without a row there gets nothing. Empty frames give empty ones.
    """
    rows = settle(df.select(
        F.col(id_col).alias("id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"),
        F.xxhash64(F.lit("mix"), F.col(id_col)).alias("_order"), id_hash(id_col), text_hash(text),
    ))
    key = [F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_name")]
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    if weights is None:
        sources = default_weights(sources)
    else:
        given = weights.select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("weight"))
        sources = sources.join(given, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    schedules = schedules or SCHEDULES
    plan = F.lit(None).cast("array<double>")
    for weight, parts in schedules.items():
        plan = F.when((F.pmod(F.round("weight") - 1, F.lit(3)) + 1) == weight, F.array(*[F.lit(float(p)) for p in parts])).otherwise(plan)
    flat = F.array(F.lit(1.0))
    sources = targets(sources, most).select("source_size", "target", F.coalesce(plan, flat).alias("intensity"), *key)
    placed = running_total(rows, ["source"], "_order", "size", ties=["id", "text_hash"]).select("*", *key)
    out = placed.join(sources, ["_none", "_name"]).withColumn("demand", F.round("target").cast("long"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("demand") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("demand") - passes * F.col("source_size")
    part = F.greatest(F.lit(0).cast("long"), F.least(rest - F.col("before"), F.col("size")))
    return out.withColumn("passes", passes).withColumn("part", part).withColumn(
        "taken", F.col("passes") * F.col("size") + F.col("part")
    ).drop("_none", "_name", "_order")


def position(place: Column, intensity: Column) -> Column:
    """Training time 0..1 at which the integral of a source's schedule reaches ``place`` (0..1)."""
    total = F.aggregate(intensity, F.lit(0.0), lambda a, x: a + x)
    steps = F.size(intensity)
    cum = F.transform(F.sequence(F.lit(0), steps), lambda k: F.aggregate(F.slice(intensity, 1, k), F.lit(0.0), lambda a, x: a + x) / total)
    k = F.least(F.size(F.filter(F.slice(cum, 2, steps), lambda x: x <= place)), steps - 1)
    low, high = F.get(cum, k), F.get(cum, k + 1)
    return (k + F.when(high > low, (place - low) / (high - low)).otherwise(F.lit(0.0))) / steps


def clock(shared: DataFrame) -> list[tuple[float, float]]:
    """Training times and the share of all demand up to them, at every step of every schedule."""
    each = shared.groupBy("source", "intensity", "demand").count().groupBy("intensity").agg(F.sum("demand")).collect()  # one row a schedule
    demand = [(list(r[0]), float(r[1])) for r in each if r[1]]
    whole = sum(d for _, d in demand)
    times = sorted({0.0, 1.0} | {k / len(i) for i, _ in demand for k in range(1, len(i))})
    done = lambda i, t: sum(x * min(max(t * len(i) - k, 0.0), 1.0) for k, x in enumerate(i)) / sum(i)
    return [(t, sum(d * done(i, t) for i, d in demand) / whole if whole else t) for t in times]


def in_tokens(time: Column, knots: list[tuple[float, float]]) -> Column:
    """The share of all demand up to a training time, between the knots of :func:`clock`."""
    out = F.lit(None).cast("double")
    for (t0, y0), (t1, y1) in zip(knots[:-1][::-1], knots[1:][::-1]):
        out = F.when(time <= t1, F.lit(y0) + (time - F.lit(t0)) * F.lit((y1 - y0) / (t1 - t0))).otherwise(out)
    return out


def copies(shared: DataFrame) -> DataFrame:
    """One row for each copy that the mix takes: id, id_hash, text_hash, source, size, copy, words, position; by position.

    Rows are range-sorted by position, then id, text and copy, so that files written from the result are
    the training order. ``position`` is the share of all demand before the copy's middle, as the schedules have it.
    """
    return _copies(shared).orderBy("position", "id", "text_hash", "copy")


def _copies(shared: DataFrame) -> DataFrame:
    each = shared.where("taken > 0").selectExpr("*", "explode(sequence(0, cast(passes as int))) as copy")
    words = F.when(F.col("copy") < F.col("passes"), F.col("size")).otherwise(F.col("part"))
    start = F.col("copy") * F.col("source_size") + F.col("before")
    each = each.withColumn("words", words).where("words > 0")
    time = position((start + F.col("words") / 2) / F.col("demand"), F.col("intensity"))
    return each.select("id", "id_hash", "text_hash", "source", "size", "copy", "words", in_tokens(time, clock(shared)).alias("position"))


@F.pandas_udf(T.StringType())
def _cut(text: pd.Series, words: pd.Series) -> pd.Series:
    """Each text up to the end of its n-th word."""
    ends = (next(islice(_WORD.finditer(t), int(n) - 1, None)).end() if t is not None else None for t, n in zip(text, words))
    return pd.Series([None if e is None else t[:e] for t, e in zip(text, ends)], dtype=object)


def mixed(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The rows of ``df`` as the mix takes them: each once for every copy, in training order, with
    the text of a copy that is cut ending after its last taken word.

    Rows that repeat an id with other texts are taken each for itself. Of rows that repeat an id and
    its text, the columns of any one stand for the copies of all. No column name is reserved.
    """
    shared = settle(shares(df, id_col, text, source, **how))
    times = shared.groupBy("id_hash", "text_hash").agg((F.count("*") > 1).alias("several"))
    taken = settle(_copies(shared).join(times, ["id_hash", "text_hash"]).select("id", "id_hash", "text_hash", "several", "copy", "words", "size", "position"))
    rows = matched(df, id_col, text, taken)
    part = F.col("words") < F.col("size")  # one copy a source; others pass the function as null
    own = F.col("row")[text]
    rows = rows.withColumn("row", F.col("row").withField(text, F.when(part, _cut(F.when(part, own), "words")).otherwise(own)))
    return rows.orderBy("position", "id", "text_hash", "copy").select("row.*")


def report(docs: DataFrame) -> DataFrame:
    """The contract's row per document, with the position of its first copy, range-sorted by it."""
    place = F.when(F.col("passes") > 0, F.col("before") + F.col("size") / 2).otherwise(F.col("before") + F.col("part") / 2)
    shared = settle(shares(docs))
    time = position(place / F.col("demand"), F.col("intensity"))
    out = shared.withColumn("position", F.when(F.col("taken") > 0, in_tokens(time, clock(shared))))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "position").orderBy(F.col("position").asc_nulls_last(), "doc_id")
