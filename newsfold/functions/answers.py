"""Raw model answers to typed votes: JSON salvage and the stage parsers, as columns."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import values as V
from .text import _strip, let

#: Content types that are no market event, and limits of stage 2. Fixed values.
NOISE_TYPES = ["advertisement", "spam", "educational", "price_commentary"]
WORTH_FROM, OVERRULES_NO, OVERRULES_YES = 41.0, 65.0, 15.0
_REASONING = re.compile(r"<(think|thinking|reasoning|scratchpad)>.*?</\1>", re.S | re.I)
_REASONING_OPEN = re.compile(r"<(?:think|thinking|reasoning|scratchpad)>", re.I)
_FENCED = re.compile(r"```(?:json|JSON)?\s*(.*?)```", re.S)


# ---------------------------------------------------------------- salvage
def _load(text: str) -> object | None:
    for attempt in (text, re.sub(r",\s*([}\]])", r"\1", text)):
        try:
            return json.loads(attempt)
        except ValueError:
            continue
    return None


def _balanced(text: str) -> list[str]:
    """Balanced objects and lists, longest first: one pass with a stack for each state of being in a string."""
    spans, stack, quoted, escaped = [], [], False, False
    for i, ch in enumerate(text):
        if quoted:
            quoted, escaped = (quoted if escaped or ch != '"' else False), (ch == "\\" and not escaped)
        elif ch == '"':
            quoted = bool(stack)
        elif ch in "{[":
            stack.append((ch, i))
        elif ch in "}]" and stack:
            opener, start = stack.pop()
            if opener + ch in ("{}", "[]"):
                spans.append(text[start : i + 1])
            else:
                stack.clear()
    return sorted(spans, key=len, reverse=True)


def salvage(text: str | None) -> str | None:
    """The first JSON object that an answer holds, as JSON text."""
    if not text:
        return None
    bare = _REASONING_OPEN.sub(" ", _REASONING.sub(" ", text))
    for candidate in (text, *_FENCED.findall(bare), bare, *_balanced(bare)):
        found = _load(candidate.strip())
        if isinstance(found, list):
            found = next((x for x in found if isinstance(x, dict)), None)
        if isinstance(found, dict):
            return json.dumps(found, ensure_ascii=False)
    return None


@F.pandas_udf(T.StringType())
def _salvaged(text: pd.Series) -> pd.Series:
    return text.map(salvage, na_action="ignore")


def salvage_json(c: Column) -> Column:
    """JSON text of an answer's object. Answers that are plain objects, or hold one in a fence, stay in the JVM."""
    whole = F.when(_strip(c).rlike(r"^\{") & F.try_parse_json(c).isNotNull(), _strip(c))
    fenced = _strip(F.regexp_extract(c, r"(?s)```(?:json|JSON)?\s*(\{.*?\})\s*```", 1))
    fenced = F.when(~F.lower(c).rlike("<(think|reasoning|scratchpad)") & (fenced != "") & F.try_parse_json(fenced).isNotNull(), fenced)
    easy = F.coalesce(whole, fenced)
    return F.coalesce(easy, _salvaged(F.when(easy.isNull(), c)))


# ---------------------------------------------------------------- fields of a JSON text
def _get(j: Column, *names: str) -> Column:
    return F.coalesce(*[F.get_json_object(j, f"$.{n}") for n in names])


def _text(j: Column, *names: str, most: int = 400) -> Column:
    return F.substring(F.coalesce(_get(j, *names), F.lit("")), 1, most)


def facts_from_json(j: Column) -> Column:
    """The sixteen fact fields, with defaults."""
    plain = lambda n: _strip(_text(j, n, most=10_000)).alias(n)
    return F.struct(
        F.replace(F.upper(F.coalesce(F.when(_get(j, "event_type") != "", _get(j, "event_type")), F.lit("OTHER"))), F.lit(" "), F.lit("_")).alias("event_type"),
        plain("entity"), F.transform(V.json_str_list(F.coalesce(_get(j, "assets", "asset"), F.lit(""))), F.upper).alias("assets"), plain("action"), plain("target"), plain("status"),
        plain("decision"), *[V.as_float(_get(j, n)).alias(n) for n in ("amount", "price", "percentage", "count")], plain("location"), plain("time_reference"),
        _strip(_text(j, "event_date", "date", most=10_000)).alias("event_date"), V.json_str_list(F.coalesce(_get(j, "key_claims"), F.lit(""))).alias("key_claims"), plain("headline"),
    )


def vote_stage1(j: Column) -> Column:
    """``(vote, type, reason)``: keep what is specific, current and no noise; null if neither was answered."""
    specific, current = V.as_bool(_get(j, "specific_event")), V.as_bool(_get(j, "current_event"))
    kind = F.translate(F.lower(_strip(F.coalesce(_get(j, "type"), F.lit("")))), " -", "__")
    keep = F.coalesce(specific, F.lit(False)) & F.coalesce(current, F.lit(False)) & ~kind.isin(NOISE_TYPES)
    given = _text(j, "reason")
    implied = F.when(kind.isin(NOISE_TYPES), F.concat(F.lit("content type is "), kind)).when(~specific, "no specific event").when(~current, "not a current event").otherwise("rejected")
    vote = F.when(specific.isNull() & current.isNull(), F.lit(None).cast("boolean")).otherwise(keep)
    return F.struct(vote.alias("vote"), kind.alias("type"), F.when(~vote & (given == ""), implied).otherwise(given).alias("reason"))


def vote_stage2(j: Column) -> Column:
    """``(vote, score, urgency, reason)``: a clear score overrules the word, and stands alone."""
    worth, score = V.as_bool(_get(j, "worth")), V.clamp(V.as_float(_get(j, "score")), 0.0, 100.0)
    score = F.when(V.as_float(_get(j, "score")).isNotNull(), score)
    urgency = F.lower(_strip(F.coalesce(_get(j, "urgency"), F.lit(""))))
    vote = F.when(worth.isNull(), score >= WORTH_FROM).when(~worth & (score >= OVERRULES_NO), True).when(worth & (score <= OVERRULES_YES), False).otherwise(worth)
    return F.struct(vote.alias("vote"), score.alias("score"), F.when(urgency.isin("low", "medium", "high"), urgency).otherwise("medium").alias("urgency"), _text(j, "reason").alias("reason"))


def parse_stage3(j: Column, most: int = 12) -> Column:
    """``(vote, assets, market_wide)``: tickers with relation, confidence and evidence."""
    raw = _get(j, "assets")
    items = F.from_json(F.when(F.startswith(raw, F.lit("{")), F.concat(F.lit("["), raw, F.lit("]"))).otherwise(raw), "array<string>")
    one = lambda x: F.when(F.startswith(x, F.lit("{")), x).otherwise(F.to_json(F.struct(x.alias("asset"))))
    each = F.transform(F.slice(F.coalesce(items, F.array().cast("array<string>")), 1, most), one)
    made = F.transform(each, lambda x: F.struct(
        V.normalize_ticker(_get(x, "asset", "symbol", "ticker")).alias("asset"), V.parse_relation(_get(x, "relation")).alias("relation"),
        V.as_probability(_get(x, "confidence"), 0.5).alias("confidence"), _text(x, "evidence", "reason").alias("evidence"),
    ))
    assets = F.filter(made, lambda x: x["asset"] != "")
    asked = raw.isNotNull() | _get(j, "market_wide").isNotNull()
    vote = F.when(F.size(assets) > 0, True).when(asked, False)
    return F.struct(vote.alias("vote"), assets.alias("assets"), F.coalesce(V.as_bool(_get(j, "market_wide")), F.lit(False)).alias("market_wide"))


def _read(j: Column, build: Callable[[Column, list[Column]], Column]) -> Column:
    """``build`` of an answer's direction (null if unsaid) and forecast, each read once."""
    said = F.struct(
        _get(j, "direction").alias("direction"), V.parse_magnitude(_get(j, "magnitude")).alias("magnitude"), V.as_float(_get(j, "expected_move_pct_low")).alias("low"), V.as_float(_get(j, "expected_move_pct_high")).alias("high"),
        V.as_float(_get(j, "horizon_minutes")).alias("minutes"), V.as_probability(_get(j, "confidence"), 0.5).alias("confidence"),
    )
    return let(said, lambda r: build(r["direction"], _forecast(r)))


def _forecast(r: Column) -> list[Column]:
    magnitude = r["magnitude"]
    low, high = V.range_low(r["low"], r["high"], magnitude), V.range_high(r["low"], r["high"], magnitude)
    return [magnitude.alias("magnitude"), low.alias("low"), high.alias("high"), ((low + high) / 2).alias("midpoint"), r["confidence"].alias("confidence"), V.snap_horizon(r["minutes"]).alias("horizon")]


def parse_stage4(j: Column) -> Column:
    """A forecast; the vote is whether the asset moves measurably."""

    def build(said: Column, parts: list[Column]) -> Column:
        direction = V.parse_direction(said)
        moves = (direction != "NEUTRAL") & (parts[3] >= V.NOISE_FLOOR)
        vote = F.when(said.isNotNull() | _get(j, "magnitude").isNotNull(), moves)
        return F.struct(vote.alias("vote"), direction.alias("direction"), *parts, V.parse_causality(_get(j, "causality")).alias("causality"), _text(j, "mechanism", most=800).alias("mechanism"), _text(j, "risks", most=600).alias("risks"))

    return _read(j, build)


def parse_stage5(j: Column) -> Column:
    """An audit; the vote is whether it confirms, inferred from conflicts where unsaid."""
    said = V.as_bool(_get(j, "confirms"))
    conflicts, overlooked = F.slice(V.json_str_list(_get(j, "conflicts")), 1, 4), F.slice(V.json_str_list(_get(j, "overlooked")), 1, 4)

    def build(direction: Column, parts: list[Column]) -> Column:
        vote = F.when(said.isNull() & direction.isNull(), F.lit(None).cast("boolean")).otherwise(F.coalesce(said, F.coalesce(F.size(conflicts), F.lit(0)) <= 0))
        return F.struct(
            vote.alias("vote"), F.when(direction.isNotNull(), V.parse_direction(direction)).otherwise("").alias("direction"), *parts, conflicts.alias("conflicts"), overlooked.alias("overlooked"),
            F.coalesce(V.as_bool(_get(j, "priced_in")), F.lit(False)).alias("priced_in"), _text(j, "reason", most=600).alias("reason"),
        )

    return _read(j, build)


def parse_final(j: Column) -> Column:
    """A final verdict; the vote is whether it is tradeable, derived where unsaid."""

    def build(said: Column, parts: list[Column]) -> Column:
        direction = V.parse_direction(said)
        trade = F.coalesce(V.as_bool(_get(j, "tradeable")), (direction != "NEUTRAL") & (parts[3] >= 0.5))
        vote = F.when(said.isNotNull() | _get(j, "magnitude").isNotNull(), trade)
        return F.struct(
            vote.alias("vote"), direction.alias("direction"), *parts, V.parse_causality(_get(j, "causality")).alias("causality"), _text(j, "mechanism", most=1000).alias("mechanism"),
            _text(j, "risks", most=800).alias("risks"), _text(j, "key_uncertainty").alias("key_uncertainty"), _text(j, "disagreement_with_pipeline", most=600).alias("disagreement"),
        )

    return _read(j, build)


#: Parsers by stage; a caller may add its own ``Column -> Column`` with a ``vote`` field.
PARSERS = {1: vote_stage1, 2: vote_stage2, 3: parse_stage3, 4: parse_stage4, 5: parse_stage5, 6: parse_final}


def parse_answers(answers: DataFrame, stage: int, text: str = "raw_text") -> DataFrame:
    """Add ``parsed`` to raw answers of one stage; null where no object was found."""
    j = F.col("_json")
    rows = answers.withColumn("_json", salvage_json(F.col(text)))
    return rows.withColumn("parsed", F.when(j.isNotNull(), PARSERS[stage](j))).drop("_json")


def prompt_table(articles: DataFrame, models: DataFrame, most_chars: int = 2200, most_models: int = 100) -> DataFrame:
    """Request rows: one for each article and model. ``models`` is a configured list of bounded size, checked before it is broadcast."""
    if models.limit(most_models + 1).count() > most_models:
        raise ValueError(f"more than {most_models} models")
    from .text import article_text, snippet

    body = snippet(article_text(F.col("title"), F.col("body")), most_chars)
    head = F.concat(F.lit("SOURCE: "), F.coalesce("source", F.lit("unknown")))
    when = F.concat(F.lit("PUBLISHED: "), F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss"))
    rows = articles.withColumn("prompt", F.concat_ws("\n", head, when, F.concat(F.lit("\nITEM:\n"), body)))
    return rows.select("id", "prompt").crossJoin(F.broadcast(models))
