"""Asset links and impacts: stage 3 to the final panel.

Answers are rows ``(news_id, asset, model_seq, ok, direction, magnitude, low, high,
confidence, horizon, causality, mechanism, risks, ...)``. An impact row is one forecast for
(news_id, asset). All folds are aggregations by those keys and equi-joins on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import values as V
from ..functions.text import _strip
from .consensus import best_evidence

KEYS = ["news_id", "asset"]
#: The fields of an impact beside its keys.
FORECAST = ["relation", "direction", "magnitude", "expected_low", "expected_high", "confidence", "horizon_minutes", "causality", "mechanism", "risks", "agreement", "model_count", "source", "tradeable"]
#: Rules of the folds. Fixed values.
MIXED_BELOW, PRICED_IN, FLIP_SHARE, CONTESTED_CAP, SPLIT_CAP, DISSENT = 0.6, 0.45, 0.5, 0.55, 0.4, 0.85


def magnitude_fold(rank_median: Column, midpoint_median: Column) -> Column:
    """The label's median rank, or the numbers' band (as ``magnitude_for_move`` has it) if that is two steps away.

    Each argument is named a few times only: the nested conditions of lookups made methods that Java doesn't compile.
    """
    label = F.greatest(F.lit(1.0), F.least(F.lit(4.0), F.bround(F.coalesce(rank_median, F.lit(1.0))))).cast("int")
    number = F.when(midpoint_median <= 0.7, 1).when(midpoint_median <= 2.0, 2).when(midpoint_median <= 5.0, 3).otherwise(4)
    rank = F.when(midpoint_median.isNotNull() & (F.abs(number - label) >= 2), number).otherwise(label)
    return F.get(F.array(*[F.lit(name) for name in V.RANKS]), rank - 1)  # ranks are counted from 1, in this order


def _or(c: Column, default: float) -> Column:
    """A value, or the default where it is missing or zero."""
    return F.coalesce(F.when(c != 0, c), F.lit(default))


def aggregate_links(mentions: DataFrame, answered: DataFrame, most: int = 6) -> DataFrame:
    """Asset links from ``mentions(news_id, model_seq, pos, asset, relation, confidence, evidence)``.

    ``answered(news_id, answered)``: models that answered. One vote a model and asset; two votes are
    needed, one if fewer than three models answered.
    """
    first = W.partitionBy("news_id", "model_seq", "asset").orderBy("pos")
    votes = mentions.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    links = votes.groupBy(*KEYS).agg(
        F.count("*").alias("votes"), F.median("confidence").alias("confidence"), F.count_if(F.col("relation") == "DIRECT").alias("directs"),
        best_evidence(F.col("evidence"), F.col("model_seq")).alias("evidence"), F.min(F.struct("model_seq", "pos")).alias("seen"),
    )
    links = links.join(answered, "news_id").where(F.col("votes") >= F.when(F.col("answered") >= 3, 2).otherwise(1))
    links = links.withColumn("confidence", _or(F.col("confidence"), 0.5)).withColumn("relation", F.when(F.col("directs") * 2 >= F.col("votes"), "DIRECT").otherwise("INDIRECT"))
    w = W.partitionBy("news_id").orderBy(F.desc("votes"), F.desc("confidence"), "seen", "asset")
    return links.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select(*KEYS, "relation", "confidence", "evidence", "votes", "rank")


def fallback_links(links: DataFrame, facts: DataFrame) -> DataFrame:
    """``links``, and for articles of ``facts(news_id, assets)`` without any, the first three named tickers."""
    none = facts.join(links.select("news_id").distinct(), "news_id", "left_anti")
    tickers = F.filter(F.transform("assets", V.normalize_ticker), lambda x: x != "")
    named = none.select("news_id", F.posexplode(F.slice(tickers, 1, 3)).alias("pos", "asset"))
    named = named.select(*KEYS, F.lit("DIRECT").alias("relation"), F.lit(0.4).alias("confidence"), F.lit("named in the article; no panel corroboration").alias("evidence"), F.lit(0).cast("long").alias("votes"), (F.col("pos") + 1).alias("rank"))
    return links.unionByName(named)


def top_links(links: DataFrame, most: int = 3) -> DataFrame:
    w = W.partitionBy("news_id").orderBy(F.desc("votes"), F.desc("confidence"), "asset")
    return links.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def _majority(df: DataFrame, labels: Column) -> DataFrame:
    """Add the most frequent of an array's labels (the greatest on ties) as ``top``, its ``share`` of them, and the number of ``kinds``.

    Labels are words of an enumeration, so each kind is counted by one look through the array.
    """
    n = F.size("_labels")
    counted = F.transform(F.array_distinct("_labels"), lambda k: F.struct(F.size(F.filter("_labels", lambda x: x == k)).alias("n"), k.alias("label")))
    df = df.withColumn("_labels", labels).withColumn("_counts", counted).withColumn("_most", F.array_max("_counts"))
    return df.withColumns({"top": F.col("_most.label"), "share": F.when(n > 0, F.col("_most.n") / n), "kinds": F.size("_counts")}).drop("_labels", "_counts", "_most")


def _medians(df: DataFrame, same: Column, names: dict[str, str]) -> DataFrame:
    """Replace ``_rows``, a panel's answers, by medians ``result -> field`` over those of which ``same`` holds, over all if it holds of none.

    A panel has a few answers: they are sorted as one array a field, where each median aggregate would keep maps of its own for every panel.
    """
    chosen = df.withColumn("_near", same).withColumn("_near", F.when(F.size("_near") > 0, F.col("_near")).otherwise(F.col("_rows")))
    fields = set(names.values())
    told = chosen.withColumns({f"_s_{n}": F.sort_array(F.filter(F.col("_near")[n], lambda v: v.isNotNull())) for n in fields})
    size = lambda n: F.size(f"_s_{n}")
    at = lambda n, k: F.get(F.col(f"_s_{n}"), k)
    middle = lambda n: 0.5 * at(n, F.shiftright(size(n) - 1, 1)) + 0.5 * at(n, F.shiftright(size(n), 1))
    return told.withColumns({out: F.when(size(n) > 0, middle(n)) for out, n in names.items()}).drop("_rows", "_near", *[f"_s_{n}" for n in fields])


def _sizes() -> list[Column]:
    c = F.col
    return [c("low"), c("high"), V.magnitude_rank(c("magnitude")).cast("double").alias("rank"), ((c("low") + c("high")) / 2).alias("midpoint")]


def _panels(answers: DataFrame, *more: Column) -> DataFrame:
    """One row a panel: its answers' numbers as the array ``_rows``, their majority, and aggregates ``more``. Panels that name no direction have no row.

    All else is told from this row, so that answers move once and no part of a panel is joined with another.
    """
    c = F.col
    rows = F.collect_list(F.struct("direction", *_sizes(), c("confidence"), c("horizon").cast("double").alias("horizon")))
    named = F.count_if(c("direction") != "").alias("_named")
    out = answers.groupBy(*KEYS).agg(rows.alias("_rows"), F.count("*").alias("model_count"), named, best_evidence(c("risks"), c("model_seq")).alias("risks"), *more).where("_named > 0").drop("_named")
    return _majority(out, F.filter(c("_rows")["direction"], lambda x: x != ""))


def _said(answers: DataFrame) -> DataFrame:
    """One row a panel with ``_said``: of each direction and causality the number of answers and their longest mechanism, the first model's on ties."""
    text = _strip(F.coalesce("mechanism", F.lit("")))
    each = answers.groupBy(*KEYS, "direction", "causality").agg(F.count("*").alias("n"), F.max(F.struct(F.length(text), -F.col("model_seq"), text.alias("text"))).alias("best"))
    return each.groupBy(*KEYS).agg(F.collect_list(F.struct("direction", "causality", "n", "best")).alias("_said"))


def _fold(panels: DataFrame, answers: DataFrame) -> DataFrame:
    """Medians over the answers that share the direction ``called`` of :func:`_panels`, over all if none does.

    The words of ``answers`` are an outer join on the panels' keys: queries that don't return them don't read them either.
    """
    same = lambda x: x["direction"] == F.col("called")
    out = panels.withColumn("aligned", F.size(F.filter("_rows", same))).withColumn("aligned", F.when(F.col("aligned") > 0, F.col("aligned")).otherwise(F.col("model_count")))
    out = _medians(out, F.filter("_rows", same), {n: n for n in ("low", "high", "confidence", "horizon", "rank", "midpoint")})
    out = out.join(_said(answers), KEYS, "left").withColumn("_near", F.filter("_said", same)).withColumn("_near", F.when(F.size("_near") > 0, F.col("_near")).otherwise(F.col("_said")))
    of = lambda k: F.filter("_near", lambda x: x["causality"].eqNullSafe(k))
    counts = F.transform(F.array_distinct(F.col("_near")["causality"]), lambda k: F.struct(F.aggregate(of(k), F.lit(0).cast("long"), lambda n, x: n + x["n"]).alias("n"), k.alias("causality")))
    mechanism = F.substring(F.array_max(F.col("_near")["best"])["text"], 1, 600)
    return out.withColumns({"causality": F.array_max(counts)["causality"], "mechanism": mechanism}).drop("_said", "_near")


def aggregate_impact(links: DataFrame, answers: DataFrame) -> DataFrame:
    """One stage-4 forecast for each link; NEUTRAL without confidence where no model answered."""
    usable = answers.where("ok and direction is not null")
    panels = _panels(usable, F.count_if(F.col("direction") == "BULLISH").alias("bulls"), F.count_if(F.col("direction") == "BEARISH").alias("bears"))
    lead = F.greatest("bulls", "bears") / (F.col("bulls") + F.col("bears"))
    mixed = (F.col("bulls") + F.col("bears") >= 2) & (lead < MIXED_BELOW)
    fold = _fold(panels.withColumn("called", F.when(mixed, "MIXED").otherwise(F.col("top"))).withColumn("agreement", F.when(mixed, lead).otherwise(F.col("share"))), usable)
    low, high = F.coalesce("low", F.lit(0.0)), F.coalesce("high", F.lit(0.0))
    small, large = F.least(low, high), F.greatest(low, high)
    neutral = F.col("called") == "NEUTRAL"
    fold = fold.select(
        *KEYS, "called", "agreement", "model_count", "mechanism", "risks", "causality", magnitude_fold(F.col("rank"), F.col("midpoint")).alias("magnitude"),
        F.when(neutral, F.least(small, F.lit(V.NOISE_FLOOR))).otherwise(small).alias("expected_low"), F.when(neutral, F.least(large, F.lit(0.7))).otherwise(large).alias("expected_high"),
        _or(F.col("confidence"), 0.5).alias("panel_confidence"), V.snap_horizon(F.col("horizon")).alias("horizon_minutes"),
    )
    out = links.select(*KEYS, "relation", F.col("confidence").alias("link")).join(fold, KEYS, "left")
    damped = V.damp_confidence(F.col("panel_confidence"), F.col("agreement"), F.col("link"), F.col("relation"))
    return out.select(
        *KEYS, "relation", F.coalesce("called", F.lit("NEUTRAL")).alias("direction"), F.coalesce("magnitude", F.lit("LOW")).alias("magnitude"),
        F.coalesce("expected_low", F.lit(0.0)).alias("expected_low"), F.coalesce("expected_high", F.lit(0.0)).alias("expected_high"), F.when(F.col("model_count") > 0, damped).otherwise(0.0).alias("confidence"),
        F.coalesce("horizon_minutes", F.lit(180)).alias("horizon_minutes"), F.coalesce("causality", F.lit("SENTIMENT")).alias("causality"),
        F.coalesce("mechanism", F.lit("no model returned a usable answer")).alias("mechanism"), F.coalesce("risks", F.lit("")).alias("risks"),
        F.coalesce("agreement", F.lit(0.0)).alias("agreement"), F.coalesce("model_count", F.lit(0)).alias("model_count"), F.lit("stage4").alias("source"), F.lit(None).cast("boolean").alias("tradeable"),
    )


def audit_notes(answers: DataFrame) -> DataFrame:
    """The first three distinct objections of each panel, in the models' order."""
    items = F.transform(F.concat("conflicts", "overlooked"), _strip)
    ordered = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("model_seq", items.alias("items")))), lambda x: x["items"]))
    told = F.array_join(F.slice(F.array_distinct(F.filter(ordered, lambda x: F.coalesce(x, F.lit("")) != "")), 1, 3), "; ")
    return answers.groupBy(*KEYS).agg(F.substring(told, 1, 400).alias("notes"))


def revise(impacts: DataFrame, answers: DataFrame) -> DataFrame:
    """Fold audits ``(…, confirms, direction, priced_in, conflicts, overlooked)`` into stage-4 impacts; impacts without a usable audit stay."""
    usable = answers.where("ok and confirms is not null").withColumn("audit", F.coalesce("direction", F.lit("")))
    panels = usable.groupBy(*KEYS).agg(
        F.count("*").alias("n"), F.count_if(F.col("confirms")).alias("confirmed"), F.count_if(F.col("priced_in")).alias("priced"), F.max(F.size("overlooked") > 0).alias("overlooked_any"),
        F.collect_list(F.struct("audit", "confirms", *_sizes(), "confidence", F.col("horizon").cast("double").alias("horizon"))).alias("_rows"),
    )
    state = impacts.select(*KEYS, *FORECAST).join(panels, KEYS, "left")
    others = F.filter("_rows", lambda x: ~x["confirms"] & (x["audit"] != "") & (x["audit"] != F.col("direction")))
    state = _majority(state.withColumn("_others", others["audit"]), F.col("_others")).withColumn("others", F.size("_others")).drop("_others")
    contested = F.col("confirmed") * 2 <= F.col("n")
    flip = (F.col("share") >= FLIP_SHARE) & (F.col("others") * 2 > F.col("n"))
    called = F.when(F.col("n").isNull(), None).when(~contested | (F.col("others") == 0), F.col("direction")).when(flip, F.col("top")).when(F.col("direction").isin("BULLISH", "BEARISH"), "MIXED").otherwise(F.col("direction"))
    state = state.withColumn("called", called).withColumn("contested", contested)
    state = _medians(state.withColumn("_all", F.col("_rows")), F.filter("_rows", lambda x: (x["audit"] == "") | (x["audit"] == F.col("called"))), {"audit_low": "low", "audit_high": "high", "rank": "rank", "midpoint": "midpoint"})
    state = _medians(state.withColumnRenamed("_all", "_rows"), F.col("_rows"), {"audit_confidence": "confidence", "horizon": "horizon"})
    low, high = 0.35 * F.col("expected_low") + 0.65 * F.col("audit_low"), 0.35 * F.col("expected_high") + 0.65 * F.col("audit_high")
    keep = F.when(F.col("priced") * 2 > F.col("n"), PRICED_IN).otherwise(1.0)
    state = state.withColumn("_low", F.least(low, high) * keep).withColumn("_high", F.greatest(low, high) * keep).withColumn("_magnitude", magnitude_fold(F.col("rank"), F.col("midpoint")))
    state = state.withColumn(
        "_magnitude", F.when(keep < 1, magnitude_fold(V.magnitude_rank(F.col("_magnitude")).cast("double"), (F.col("_low") + F.col("_high")) / 2)).otherwise(F.col("_magnitude"))
    )
    agreed = V.clamp(F.col("confirmed") / F.col("n"), 0.6, 1.0)
    confidence = F.when(F.col("contested"), F.least("confidence", "audit_confidence", F.lit(CONTESTED_CAP))).otherwise(F.least(F.col("audit_confidence"), F.col("confidence") * 1.15) * agreed)
    confidence = confidence * F.when((F.col("called") == "MIXED") & (F.col("direction") != "MIXED"), 0.7).otherwise(1.0) * F.when(F.col("overlooked_any"), 0.9).otherwise(1.0)
    out = state.select(
        *KEYS, *FORECAST, "called", F.col("_magnitude"), V.half_even(F.col("_low"), 3).alias("_low"), V.half_even(F.col("_high"), 3).alias("_high"), V.half_even(V.clamp(confidence, 0.0, 1.0), 3).alias("_confidence"),
        V.snap_horizon(F.col("horizon")).alias("_horizon"), (F.col("confirmed") / F.col("n")).alias("_agreement"), F.col("n").alias("_n"),
    ).join(audit_notes(usable), KEYS, "left")
    pick = lambda new, old: F.when(F.col("called").isNotNull(), F.col(new)).otherwise(F.col(old)).alias(old)
    longer = F.when(F.length("notes") > F.length("risks"), F.col("notes")).otherwise(F.col("risks"))
    return out.select(
        *KEYS, "relation", pick("called", "direction"), pick("_magnitude", "magnitude"), pick("_low", "expected_low"), pick("_high", "expected_high"), pick("_confidence", "confidence"),
        pick("_horizon", "horizon_minutes"), "causality", "mechanism", F.when(F.coalesce(F.col("notes"), F.lit("")) != "", longer).otherwise(F.col("risks")).alias("risks"),
        pick("_agreement", "agreement"), pick("_n", "model_count"), F.when(F.col("called").isNotNull(), "stage5").otherwise(F.col("source")).alias("source"), "tradeable",
    )


def decide_final(impacts: DataFrame, answers: DataFrame) -> DataFrame:
    """Fold the final panel ``(…, tradeable)`` into impacts; impacts without a usable answer stay, with a note."""
    usable = answers.where("ok and direction is not null")
    panels = _panels(usable, F.count_if(F.col("tradeable")).alias("trades")).withColumn("seen", F.array_join(F.array_sort(F.array_distinct(F.col("_rows")["direction"])), ", "))
    apart = (F.col("kinds") == F.col("model_count")) & (F.col("model_count") >= 3)
    panels = panels.withColumn("called", F.when(apart, "MIXED").otherwise(F.col("top")))
    fold = _fold(panels, usable).select(
        *KEYS, F.col("low").alias("f_low"), F.col("high").alias("f_high"), F.col("confidence").alias("f_confidence"), F.col("horizon").alias("f_horizon"), "aligned",
        magnitude_fold(F.col("rank"), F.col("midpoint")).alias("f_magnitude"), F.col("causality").alias("f_causality"), F.col("mechanism").alias("f_mechanism"), F.col("risks").alias("f_risks"),
        "called", F.col("share").alias("f_agreement"), (F.col("share") < 0.6).alias("split"), F.col("model_count").alias("n"), "trades", "seen",
    )
    out = impacts.join(fold, KEYS, "left")
    done = F.col("called").isNotNull()
    low, high = F.coalesce(F.when(F.col("f_low") != 0, F.col("f_low")), F.col("expected_low")), F.coalesce(F.when(F.col("f_high") != 0, F.col("f_high")), F.col("expected_high"))
    sure = _or(F.col("f_confidence"), 0.5)
    sure = F.when(F.col("split"), F.least(sure, F.lit(SPLIT_CAP))).when(F.col("aligned") < F.col("n"), sure * DISSENT).otherwise(sure)
    note = F.when(F.col("split"), F.concat(F.lit("final panel split three ways ("), F.col("seen"), F.lit(")"))).when(
        F.col("called") != F.col("direction"), F.concat(F.lit("overrules "), F.col("source"), F.lit(" "), F.col("direction"), F.lit(" -> "), F.col("called"))
    ).otherwise("")
    pick = lambda new, old: F.when(done, new).otherwise(F.col(old)).alias(old)
    return out.select(
        *KEYS, "relation", pick(F.col("called"), "direction"), pick(F.col("f_magnitude"), "magnitude"), pick(V.half_even(F.least(low, high), 3), "expected_low"),
        pick(V.half_even(F.greatest(low, high), 3), "expected_high"), pick(V.half_even(V.clamp(sure, 0.0, 1.0), 3), "confidence"), pick(V.snap_horizon(F.col("f_horizon")), "horizon_minutes"),
        pick(F.coalesce("f_causality", F.lit("SENTIMENT")), "causality"), pick(F.coalesce(F.when(F.col("f_mechanism") != "", F.col("f_mechanism")), F.col("mechanism")), "mechanism"),
        pick(F.coalesce(F.when(F.col("f_risks") != "", F.col("f_risks")), F.col("risks")), "risks"), pick(F.col("f_agreement"), "agreement"), pick(F.col("n"), "model_count"),
        F.when(done, "final").otherwise(F.col("source")).alias("source"), pick((F.col("trades") * 2 > F.col("n")) & ~F.col("split"), "tradeable"),
        F.when(done, note).otherwise("final layer unavailable").alias("notes"),
    )


def deepest_stage(impacts: DataFrame) -> DataFrame:
    """Depth 4, 5 or 6 of each impact, and the deepest of its article."""
    depth = V.lookup(F.col("source"), {"stage4": 4, "stage5": 5, "final": 6}, 4)
    return impacts.withColumn("depth", depth).join(impacts.groupBy("news_id").agg(F.max(depth).alias("deepest")), "news_id")


def trail(notes: DataFrame) -> DataFrame:
    """Ordered notes ``(news_id, asset, stage, note)`` as one text for each impact."""
    each = F.array_sort(F.collect_list(F.struct("stage", "note")))
    return notes.groupBy(*KEYS).agg(F.array_join(F.transform(each, lambda x: x["note"]), " > ").alias("trail"))
