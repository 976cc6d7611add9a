"""Request texts by stage: one line for each thing that is known, joined; what is unknown leaves no line.

Labels and lengths are fixed values: models are asked in these words. Columns used: ``title, body, source, published_at``, ``facts`` (the struct of
sixteen fields) and, from stage to stage, ``context``, ``reason2``, ``score2``, ``asset, relation, evidence``, and the preliminary verdict as a struct ``impact`` with
``disagreement`` and ``source_count``. Any of them may be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import article_text, snippet

#: Lengths of the article's text by stage, claims that are told. Fixed values.
LENGTHS, MOST_CLAIMS = {1: 2200, 2: 2200, 3: 1800, 4: 1800, 5: 2400}, 4


def _told(label: str, value: Column) -> Column:
    """``label`` and a text, null where the text is blank."""
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label), value))


def _pairs(**values: Column) -> Column:
    """``NAME: value`` of each, two blanks between them."""
    return F.concat_ws("  ", *[F.concat(F.lit(f"{name.replace('_', ' ')}: "), F.coalesce(value, F.lit(""))) for name, value in values.items()])


def _facts() -> dict[str, Column]:
    f = lambda name: F.col(f"facts.{name}")
    headline = F.when(F.coalesce(f("headline"), F.lit("")) != "", f("headline")).otherwise(F.coalesce("title", F.lit("")))
    claims = F.transform(F.slice(F.coalesce(f("key_claims"), F.array().cast("array<string>")), 1, MOST_CLAIMS), lambda c: F.concat(F.lit("- "), c))
    return {
        "headline": headline, "type": f("event_type"), "entity": f("entity"), "action": f("action"), "status": f("status"), "assets": F.array_join(F.coalesce(f("assets"), F.array().cast("array<string>")), ", "),
        "amount": F.when(f("amount") != 0, F.concat(F.lit("AMOUNT: $"), F.format_number(f("amount"), 0))), "percentage": F.concat(F.lit("PERCENTAGE: "), f("percentage").cast("string"), F.lit("%")),
        "claims": _told("CLAIMS:\n", F.array_join(claims, "\n")),
    }


def _or(value: Column, instead: str) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", value).otherwise(instead)


def stage_prompt(stage: int) -> Column:
    """The request of a stage (1 to 5) about an article, or about an article and an asset (4 and 5)."""
    x, c = _facts(), F.col
    event, known = F.concat(F.lit("EVENT: "), x["headline"]), c("facts").isNotNull()
    number = lambda value, digits: F.format_string(f"%.{digits}f", value.cast("double"))
    whole = lambda value: F.bround(value.cast("double")).cast("long").cast("string")
    if stage == 1:
        lines = [
            F.concat(F.lit("SOURCE: "), _or(c("source"), "unknown")), F.concat(F.lit("PUBLISHED: "), F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss")),
            F.when(F.coalesce(c("facts.headline"), F.lit("")) != "", F.concat(F.lit("EXTRACTED EVENT: "), c("facts.headline"), F.lit(" (type="), F.coalesce(x["type"], F.lit("")), F.lit(")"))),
        ]
    elif stage == 2:
        lines = [F.when(known, event), F.when(known, _pairs(TYPE=x["type"], ENTITY=x["entity"], ASSETS=_or(x["assets"], "none named"), STATUS=x["status"])), x["amount"], _told("\nEVENT HISTORY:\n", c("context"))]
    elif stage == 3:
        lines = [event, _pairs(TYPE=x["type"], ENTITY=x["entity"], ACTION=x["action"]), _pairs(ASSETS_NAMED_IN_ARTICLE=_or(x["assets"], "none")), x["amount"], _told("MARKET RELEVANCE: ", c("reason2")), x["claims"]]
    elif stage == 4:
        lines = [
            _pairs(TARGET_ASSET=c("asset")), F.concat(F.lit("LINK: "), c("relation"), F.lit(" ("), _or(c("evidence"), "no evidence given"), F.lit(")")), F.lit(""), event,
            _pairs(TYPE=x["type"], ENTITY=x["entity"], ACTION=x["action"], STATUS=x["status"]), x["amount"], x["percentage"], F.concat(F.lit("PANEL SIGNIFICANCE SCORE: "), whole(c("score2")), F.lit("/100")),
            _told("\nPRIOR DEVELOPMENTS IN THIS EVENT:\n", c("context")), _told("\n", x["claims"]),
        ]
    elif stage == 5:
        i = lambda name: c(f"impact.{name}")
        told = {
            "direction": i("direction"), "magnitude": F.concat(i("magnitude"), F.lit(" ("), number(i("expected_low"), 2), F.lit("% to "), number(i("expected_high"), 2), F.lit("%)")), "confidence": number(i("confidence"), 2),
            "horizon": F.when(i("horizon_minutes") < 60, F.concat(i("horizon_minutes").cast("string"), F.lit(" min"))).otherwise(F.concat(F.floor(i("horizon_minutes") / 60).cast("string"), F.lit("h"))),
            "causality": i("causality"), "mechanism": i("mechanism"), "risks": i("risks"), "panel agreement": F.concat(whole(i("agreement") * 100), F.lit("% of "), i("model_count").cast("string"), F.lit(" models")),
        }
        lines = [
            _pairs(TARGET_ASSET=c("asset")), F.lit("\nPRELIMINARY ANALYSIS (Stage 4):"), *[F.concat(F.lit(f"  {name}: "), F.coalesce(value, F.lit(""))) for name, value in told.items()], _told("  panel disagreement: ", c("disagreement")),
            F.concat(F.lit("\n"), event), _pairs(TYPE=x["type"], STATUS=x["status"], SOURCES_REPORTING=F.coalesce("source_count", F.lit(1)).cast("string")), _told("\nEVENT HISTORY (prior updates):\n", c("context")),
        ]
    else:
        raise ValueError(f"no prompts for stage {stage}")
    return F.concat_ws("\n", *lines, F.concat(F.lit("\nITEM:\n"), snippet(article_text(c("title"), c("body")), LENGTHS[stage])))


def prompt_rows(stages: dict[int, DataFrame], models: DataFrame, most_models: int = 100) -> DataFrame:
    """``(id, stage, asset, model, prompt)``: one request an article (and asset, in stages 4 and 5) and model of its stage.

    ``models(stage, model)`` is a configured list of bounded size, checked before it is broadcast. Columns that a stage's frame lacks count as null.
    """
    if models.limit(most_models + 1).count() > most_models:
        raise ValueError(f"more than {most_models} models")
    kinds = {"context": "string", "reason2": "string", "score2": "double", "asset": "string", "relation": "string", "evidence": "string", "disagreement": "string", "source_count": "int"}
    made = None
    for stage, rows in stages.items():
        full = rows.withColumns({c: F.lit(None).cast(kind) for c, kind in kinds.items() if c not in rows.columns})
        told = full.select("id", F.lit(stage).alias("stage"), F.col("asset") if stage > 3 else F.lit(None).cast("string").alias("asset"), stage_prompt(stage).alias("prompt"))
        made = told if made is None else made.unionByName(told)
    return made.join(F.broadcast(models), "stage").select("id", "stage", "asset", "model", "prompt")
