"""URL filters (operator 9): rules first, then a character language-model ratio.

Hosts and paths that a rule fits take its verdict, and are the examples of accepted and
rejected URLs. On them two character models of variable order are counted: every order
from 0 to ``order`` predicts the next byte from its context and is smoothed by the one below
it. Other URLs are judged by the difference of the two log-likelihoods per byte, against a
threshold that is calibrated on examples which were not counted.

Contexts are counted exactly: the models are a Spark table of one row a context, which grows
with the URLs and is never gathered. A byte's likelihood depends only on its window (the
``order`` bytes before it and itself), so distinct windows are joined with the contexts they
ask for, and URLs with their windows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import settle

#: Verdict, host and path of the contract's rules. Fixed values.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ACCEPTED, REJECTED = 0, 1


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; then up to ``?`` or ``#``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^(?s)[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^(?s)[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def ruled(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Rule (host and path) and verdict of the longest rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for kind, own, start in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(own + start)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def contexts(urls: list[str | None], order: int, slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all bytes of all URLs: the URL's index, and slots (bytes, order + 1) of the context, and of the context with the byte."""
    data = [b"\x02" * order + (u or "").encode("utf-8", "surrogatepass") + b"\x03" for u in urls]
    length = np.fromiter(map(len, data), np.int64, len(data))
    flat = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64)
    start = np.cumsum(length) - length
    owner = np.repeat(np.arange(len(data)), length)
    at = np.flatnonzero(np.arange(len(flat)) - start[owner] >= order)
    seen, both = np.zeros((len(at), order + 1), np.int64), np.zeros((len(at), order + 1), np.int64)
    state = np.zeros(len(at), np.uint64)
    for k in range(order + 1):
        if k:
            state = _mix(state * np.uint64(257) + flat[at - k] + np.uint64(k))
        seen[:, k] = (_mix(state + np.uint64(2 * k)) % np.uint64(slots)).astype(np.int64)
        both[:, k] = (_mix(state * np.uint64(257) + flat[at] + np.uint64(1_000_003 + 2 * k)) % np.uint64(slots)).astype(np.int64)
    return owner[at], seen, both


def ratios(urls: list[str | None], counts: np.ndarray, order: int, smooth: float = 4.0) -> np.ndarray:
    """What :func:`score` gives, from given counts (2, slots) of hashed contexts: a plain form for comparison."""
    owner, seen, both = contexts(urls, order, counts.shape[1])
    logs = []
    for model in counts:
        p = np.full(len(owner), 1 / 256)
        for k in range(order + 1):
            p = (np.minimum(model[both[:, k]], model[seen[:, k]]) + smooth * p) / (model[seen[:, k]] + smooth)
        logs.append(np.log(p))
    size = np.maximum(np.bincount(owner, minlength=len(urls)), 1)
    return np.bincount(owner, logs[ACCEPTED] - logs[REJECTED], len(urls)) / size


def windows(df: DataFrame, order: int) -> DataFrame:
    """Replace ``url`` by ``window``: a row for each byte of a URL (and its end), with the ``order`` bytes before it."""
    padded = F.concat(F.unhex(F.lit("02" * order)), F.col("url").cast("binary"), F.unhex(F.lit("03")))
    # an array of one binds the padded URL, which each step would build again
    cut = F.transform(F.array(padded), lambda p: F.transform(F.sequence(F.lit(1), F.octet_length(p) - order), lambda i: F.substring(p, i, F.lit(order + 1))))
    return df.select(*[c for c in df.columns if c != "url"], F.explode(F.flatten(cut)).alias("window"))


def _with_contexts(df: DataFrame, order: int) -> DataFrame:
    """A row for each order: ``context`` (its length is the order) and ``byte`` of the window."""
    each = df.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(order))))
    return each.withColumns({"context": F.substring("window", F.lit(order + 1) - F.col("k"), F.col("k")), "byte": F.substring("window", order + 1, 1)})


def fit(examples: DataFrame, order: int) -> DataFrame:
    """The models from ``(url, kind)`` with kind 0 accepted, 1 rejected: one row a context with its counts
    (accepted, rejected) and those of the bytes after it, which are 257 at most."""
    seen = windows(examples, order).groupBy("window").agg(F.count_if(F.col("kind") == ACCEPTED).alias("a"), F.count_if(F.col("kind") == REJECTED).alias("r"))
    both = _with_contexts(seen, order).groupBy("context", "byte").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    after = F.map_from_entries(F.collect_list(F.struct("byte", F.struct("a", "r").alias("n"))))
    return settle(both.groupBy("context").agg(F.sum("a").alias("a"), F.sum("r").alias("r"), after.alias("after")))


def score(urls: DataFrame, model: DataFrame, order: int, smooth: float = 4.0) -> DataFrame:
    """Add ``ratio`` to distinct ``url``: log-likelihood of the accepted model less that of the rejected one, per byte."""
    total = model.where("octet_length(context) = 0").select("a", "r").first() or (0, 0)
    least = min(total)  # else what neither model has seen speaks for the smaller one
    weigh = [least / n if least else 1.0 for n in total]
    urls = settle(urls.withColumn("no", F.monotonically_increasing_id()))
    places = windows(urls, order)
    asked = _with_contexts(places.select("window").distinct(), order).join(model, "context", "left")
    n = F.try_element_at("after", "byte")
    count = lambda c, w, name: (F.coalesce(c, F.lit(0)) * F.lit(w)).alias(name)
    told = F.struct("k", count(n["a"], weigh[0], "ba"), count(F.col("a"), weigh[0], "ca"), count(n["r"], weigh[1], "br"), count(F.col("r"), weigh[1], "cr"))
    step = lambda p, x: F.struct(((x["ba"] + smooth * p["a"]) / (x["ca"] + smooth)).alias("a"), ((x["br"] + smooth * p["r"]) / (x["cr"] + smooth)).alias("r"))
    flat = F.struct(F.lit(1 / 256).alias("a"), F.lit(1 / 256).alias("r"))
    logs = F.aggregate(F.array_sort(F.collect_list(told)), flat, step, lambda p: F.log(p["a"]) - F.log(p["r"]))
    # whole numbers of 2^-32, so that the sum is the same in any order
    scored = asked.groupBy("window").agg(F.round(logs * F.lit(2.0**32)).cast("long").alias("log"))
    sums = places.join(scored, "window").groupBy("no").agg((F.sum("log") / F.count("log") / F.lit(2.0**32)).alias("ratio"))
    return urls.join(sums, "no").drop("no")


def threshold(scored: DataFrame) -> float:
    """The ratio above which URLs are accepted, from ``(kind, ratio)`` of examples that were not counted."""
    scored = scored.select("kind", F.round(F.greatest(F.lit(-5.0), F.least(F.lit(5.0), "ratio")), 2).alias("at"))
    bins = sorted(scored.groupBy("at").agg(F.count_if(F.col("kind") == ACCEPTED), F.count_if(F.col("kind") == REJECTED)).collect())  # at most 1,001 rows
    if not bins:
        return 0.0
    at, good, bad = (np.array(c, np.float64) for c in zip(*bins))
    if not good.sum() or not bad.sum():
        return 0.0
    right = np.cumsum(bad) / bad.sum() + 1 - np.cumsum(good) / good.sum()  # if all up to here are blocked
    best = int(right.argmax())
    return float((at[best] + (at[best + 1] if best + 1 < len(at) else at[best])) / 2)


def judge(df: DataFrame, rules: list[tuple[str, str, str]] | None = None, id_col: str = "page_id", url: str = "url", order: int = 5) -> DataFrame:
    """One row per row of ``df``: page_id, host, path, rule, verdict, ratio.

    Null URLs and those without ``://`` have an empty host and path, fit no rule and are
    judged by the model as any other. ``ratio`` is null where a rule decides. Repeated rows
    are each returned; an empty frame gives an empty one. One fifth of the distinct example
    URLs, by hash, calibrates and is not counted; without counted examples of both kinds all
    are accepted.
    """
    rows = df.select(F.col(url).cast("string").alias("url"), F.col(id_col).alias("page_id"))
    host, path = host_and_path(F.col("url"))
    rows = rows.withColumn("host", F.coalesce(host, F.lit(""))).withColumn("path", F.coalesce(path, F.lit("")))
    rule, verdict = ruled(F.col("host"), F.col("path"), RULES if rules is None else rules)
    rows = settle(rows.withColumn("rule", rule).withColumn("verdict", verdict))
    examples = rows.where("rule is not null").select("url", F.when(F.col("verdict") == "allow", ACCEPTED).otherwise(REJECTED).alias("kind"))
    examples = settle(examples.distinct().withColumn("part", F.pmod(F.crc32("url"), F.lit(5))))
    model = fit(examples.where("part <> 0").select("url", "kind"), order)
    judged = rows.where("rule is null").withColumn("_url", F.coalesce("url", F.lit("")))
    ratio = settle(score(judged.select(F.col("_url").alias("url")).unionAll(examples.where("part = 0").select("url")).distinct(), model, order))
    kinds = {r.kind for r in examples.where("part <> 0").select("kind").distinct().collect()}
    least = threshold(examples.where("part = 0").join(ratio, "url")) if len(kinds) == 2 else -np.inf
    scored = judged.join(ratio.withColumnRenamed("url", "_url"), "_url").withColumn("verdict", F.when(F.col("ratio") > least, F.lit("allow")).otherwise(F.lit("block"))).drop("_url")
    return rows.where("rule is not null").withColumn("ratio", F.lit(None).cast("double")).unionByName(scored).select("page_id", "host", "path", "rule", "verdict", "ratio")
