"""Queries: votes, verdicts, impacts, routing, alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import consensus as C
from ..operators import impact as I
from ..operators import routing as R
from ..scale import settle
from .adapters import ALERTS, ANSWERS, alerts, answers
from .registry import Tables, query, rounded

TALLY = """tally AS (SELECT news_id, count(*) FILTER (ok AND vote) AS votes_pass, count(*) FILTER (ok AND NOT vote) AS votes_reject, count(*) FILTER (NOT ok OR vote IS NULL) AS votes_failed,
    median(score) FILTER (ok AND vote IS NOT NULL) AS score FROM answers GROUP BY news_id),
verdicts AS (SELECT *, votes_pass + votes_reject AS answered, CASE WHEN votes_pass + votes_reject > 0 THEN greatest(votes_pass, votes_reject) / (votes_pass + votes_reject) ELSE 0 END AS agreement,
    CASE WHEN votes_pass + votes_reject < 2 THEN 'INCONCLUSIVE' WHEN votes_reject >= 2 THEN 'REJECT' ELSE 'PASS' END AS verdict,
    CASE WHEN votes_pass + votes_reject < 2 THEN concat('quorum not met (', votes_pass + votes_reject, ' of ', votes_pass + votes_reject + votes_failed, ' models answered; need 2)') ELSE '' END AS note FROM tally),
summaries AS (SELECT *, concat_ws(' · ', concat(verdict, ' ', votes_pass, '/', answered), CASE WHEN votes_failed > 0 THEN concat(votes_failed, ' no-answer') END,
    CASE WHEN score IS NOT NULL THEN concat('score=', CAST(round_even(score, 0) AS BIGINT)) END, CASE WHEN note <> '' THEN note END) AS summary FROM verdicts)"""


@query(f"WITH {ANSWERS}, {TALLY} SELECT news_id, votes_pass, votes_reject, votes_failed, answered, round(agreement, 6) AS agreement, round(score, 6) AS score, verdict, note, summary FROM summaries")
def a1_panel_tally(t: Tables) -> DataFrame:
    return rounded(C.verdict_summary(C.tally(answers(t), ["news_id"], 2)))


@query(f"""WITH {ANSWERS}, labelled AS (SELECT CASE WHEN NOT ok OR vote IS NULL THEN 'NO_ANSWER' WHEN vote THEN 'PASS' ELSE 'REJECT' END AS label, model_id FROM answers)
    SELECT model_id, label, count(*) AS n FROM labelled GROUP BY ALL""")
def a2_vote_labels(t: Tables) -> DataFrame:
    return C.build_votes(answers(t)).groupBy("model_id", "label").agg(F.count("*").alias("n"))


@query(f"WITH {ANSWERS} SELECT news_id, round(median(score), 6) AS median_score, round(avg(score), 6) AS mean_score FROM answers GROUP BY news_id")
def a3_numeric_aggregate(t: Tables) -> DataFrame:
    a = answers(t)
    both = C.aggregate_numeric(a, ["news_id"], "score").withColumnRenamed("score", "median_score").join(C.aggregate_numeric(a, ["news_id"], "score", "mean").withColumnRenamed("score", "mean_score"), "news_id")
    return rounded(both)


@query(f"""WITH {ANSWERS}, c AS (SELECT news_id, direction, count(*) AS n FROM answers WHERE ok GROUP BY ALL)
    SELECT news_id, arg_max(direction, (n, direction)) AS direction, round(max(n) / sum(n), 6) AS share FROM c GROUP BY news_id""")
def a4_majority_direction(t: Tables) -> DataFrame:
    return rounded(C.majority_label(answers(t).where("ok"), ["news_id"], "direction"))


@query(f"""WITH {ANSWERS} SELECT news_id, arg_max(trim(mechanism), (length(trim(mechanism)), -model_seq)) AS evidence FROM answers GROUP BY news_id""")
def a5_best_evidence(t: Tables) -> DataFrame:
    return answers(t).groupBy("news_id").agg(C.best_evidence(F.col("mechanism"), F.col("model_seq")).alias("evidence"))


@query(f"""WITH {ANSWERS}, {TALLY}, o AS (SELECT news_id, arg_min(reason, model_seq) AS objection FROM answers WHERE ok AND NOT vote AND reason <> '' GROUP BY news_id)
    SELECT s.news_id, concat(coalesce(concat(votes_reject, '/', answered, ' models: ', CASE WHEN objection IS NULL THEN NULL ELSE objection END), summary), '') AS drop_reason
    FROM summaries s JOIN o USING (news_id) UNION ALL SELECT s.news_id, summary FROM summaries s WHERE news_id NOT IN (SELECT news_id FROM o)""")
def a6_drop_reason(t: Tables) -> DataFrame:
    return C.drop_reason(answers(t), ["news_id"])


@query(f"""WITH {ANSWERS}, m AS (SELECT news_id, round_even(median(CASE urgency WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) FILTER (ok), 0) AS r FROM answers GROUP BY news_id)
    SELECT news_id, CASE r WHEN 0 THEN 'low' WHEN 2 THEN 'high' ELSE 'medium' END AS urgency FROM m""")
def a7_urgency(t: Tables) -> DataFrame:
    return C.urgency(answers(t), ["news_id"])


@query(f"""WITH {ANSWERS} SELECT news_id, coalesce(arg_max(reason, (length(reason), -model_seq)) FILTER (ok AND vote), '') AS reason FROM answers GROUP BY news_id""")
def a8_transmission_reason(t: Tables) -> DataFrame:
    return C.stage2_reason(answers(t), ["news_id"])


MENTIONS = f"""{ANSWERS}, mentions AS (SELECT news_id, model_seq, p.pos, concat('A', (partkey + p.pos * 3) % 6) AS asset, CASE WHEN (partkey + p.pos) % 3 > 0 THEN 'DIRECT' ELSE 'INDIRECT' END AS relation, confidence, mechanism AS evidence
    FROM answers, (SELECT unnest([0, 1, 2]) AS pos) p WHERE ok),
once AS (SELECT * FROM mentions QUALIFY row_number() OVER (PARTITION BY news_id, model_seq, asset ORDER BY pos) = 1),
answered AS (SELECT news_id, count(*) FILTER (ok) AS answered FROM answers GROUP BY news_id),
grouped AS (SELECT news_id, asset, count(*) AS votes, coalesce(nullif(median(confidence), 0), 0.5) AS confidence, CASE WHEN count(*) FILTER (relation = 'DIRECT') * 2 >= count(*) THEN 'DIRECT' ELSE 'INDIRECT' END AS relation,
    arg_max(trim(evidence), (length(trim(evidence)), -model_seq)) AS evidence, min((model_seq, pos)) AS seen FROM once GROUP BY news_id, asset),
links AS (SELECT news_id, asset, relation, confidence, evidence, votes, row_number() OVER (PARTITION BY news_id ORDER BY votes DESC, confidence DESC, seen, asset) AS rank
    FROM grouped JOIN answered USING (news_id) WHERE votes >= CASE WHEN answered >= 3 THEN 2 ELSE 1 END QUALIFY rank <= 6)"""


def _links(t: Tables) -> DataFrame:
    a = answers(t)
    m = a.where("ok").select("news_id", "model_seq", "partkey", "confidence", "mechanism", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("pos")).selectExpr(
        "news_id", "model_seq", "pos", "concat('A', (partkey + pos * 3) % 6) AS asset", "CASE WHEN (partkey + pos) % 3 > 0 THEN 'DIRECT' ELSE 'INDIRECT' END AS relation", "confidence", "mechanism AS evidence"
    )
    return I.aggregate_links(m, a.groupBy("news_id").agg(F.count_if(F.col("ok")).alias("answered")))


@query(f"WITH {MENTIONS} SELECT news_id, asset, relation, round(confidence, 6) AS confidence, evidence, votes, rank FROM links")
def a9_asset_links(t: Tables) -> DataFrame:
    return rounded(_links(t))


@query(f"WITH {ANSWERS} SELECT news_id, count(*) FILTER (market_wide) * 2 > count(*) AS market_wide FROM answers WHERE ok GROUP BY news_id")
def a10_market_wide(t: Tables) -> DataFrame:
    return C.market_wide(answers(t), ["news_id"])


@query(f"""WITH {MENTIONS}, facts AS (SELECT o_orderkey AS news_id, concat('tk', o_custkey % 9) AS a, concat('market/', o_custkey) AS b FROM orders),
    named AS (SELECT news_id, upper(a) AS asset FROM facts WHERE news_id NOT IN (SELECT news_id FROM links))
    SELECT news_id, asset, relation, round(confidence, 6) AS confidence, votes FROM links UNION ALL SELECT news_id, asset, 'DIRECT', 0.4, 0 FROM named""")
def a11_link_fallback(t: Tables) -> DataFrame:
    facts = t.orders.selectExpr("o_orderkey AS news_id", "array(concat('tk', o_custkey % 9), concat('market/', o_custkey)) AS assets")
    return rounded(I.fallback_links(settle(_links(t)), facts).select("news_id", "asset", "relation", "confidence", "votes"))


@query(f"WITH {MENTIONS} SELECT news_id, asset, votes FROM links QUALIFY row_number() OVER (PARTITION BY news_id ORDER BY votes DESC, confidence DESC, asset) <= 3")
def w10_top_links(t: Tables) -> DataFrame:
    return I.top_links(_links(t)).select("news_id", "asset", "votes")


def rank_sql(c: str) -> str:
    return f"CASE {c} WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 ELSE 4 END"


def band_sql(x: str) -> str:
    return f"CASE WHEN {x} <= 0.7 THEN 1 WHEN {x} <= 2 THEN 2 WHEN {x} <= 5 THEN 3 ELSE 4 END"


def fold_sql(rank: str, mid: str) -> str:
    label = f"CAST(least(4, greatest(1, round_even({rank}, 0))) AS INT)"
    return f"CASE WHEN {rank} IS NULL THEN NULL ELSE CASE (CASE WHEN abs({band_sql(mid)} - {label}) >= 2 THEN {band_sql(mid)} ELSE {label} END) WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'HIGH' ELSE 'EXTREME' END END"


def snap_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 180 WHEN {x} <= 37.5 THEN 15 WHEN {x} <= 120 THEN 60 WHEN {x} <= 270 THEN 180 WHEN {x} <= 900 THEN 360 ELSE 1440 END"


IMPACTS = f"""{ANSWERS}, link AS (SELECT DISTINCT news_id, asset, CASE WHEN news_id % 3 = 0 THEN 'INDIRECT' ELSE 'DIRECT' END AS relation, (news_id % 5) / 5 AS link FROM answers),
usable AS (SELECT * FROM answers WHERE ok),
dc AS (SELECT news_id, direction, count(*) AS n FROM usable GROUP BY ALL),
maj AS (SELECT news_id, arg_max(direction, (n, direction)) AS top, max(n) / sum(n) AS share, coalesce(sum(n) FILTER (direction = 'BULLISH'), 0) AS bulls, coalesce(sum(n) FILTER (direction = 'BEARISH'), 0) AS bears FROM dc GROUP BY news_id),
called AS (SELECT news_id, CASE WHEN bulls + bears >= 2 AND greatest(bulls, bears) / (bulls + bears) < 0.6 THEN 'MIXED' ELSE top END AS called,
    CASE WHEN bulls + bears >= 2 AND greatest(bulls, bears) / (bulls + bears) < 0.6 THEN greatest(bulls, bears) / (bulls + bears) ELSE share END AS agreement FROM maj),
al AS (SELECT u.*, called, agreement, direction = called OR NOT max(direction = called) OVER (PARTITION BY u.news_id) AS inside FROM usable u JOIN called USING (news_id)),
cc AS (SELECT news_id, arg_max(causality, (n, causality)) AS causality FROM (SELECT news_id, causality, count(*) AS n FROM al WHERE inside GROUP BY ALL) GROUP BY news_id),
f AS (SELECT news_id, any_value(called) AS called, any_value(agreement) AS agreement, median(low) FILTER (inside) AS low, median(high) FILTER (inside) AS high, median(confidence) FILTER (inside) AS conf,
    median(horizon) FILTER (inside) AS horizon, median({rank_sql("magnitude")}) FILTER (inside) AS rk, median((low + high) / 2) FILTER (inside) AS mid, count(*) AS n,
    arg_max(trim(mechanism), (length(trim(mechanism)), -model_seq)) FILTER (inside) AS mechanism, arg_max(trim(risks), (length(trim(risks)), -model_seq)) AS risks FROM al GROUP BY news_id),
impacts AS (SELECT l.news_id, l.asset, l.relation, coalesce(called, 'NEUTRAL') AS direction, coalesce({fold_sql("rk", "mid")}, 'LOW') AS magnitude,
    coalesce(CASE WHEN called = 'NEUTRAL' THEN least(least(low, high), 0.15) ELSE least(low, high) END, 0) AS expected_low, coalesce(CASE WHEN called = 'NEUTRAL' THEN least(greatest(low, high), 0.7) ELSE greatest(low, high) END, 0) AS expected_high,
    CASE WHEN called IS NULL THEN 0.0 ELSE round_even(least(1, greatest(0, coalesce(nullif(conf, 0), 0.5) * least(1, greatest(0.4, agreement)) * least(1, greatest(0.6, 0.6 + 0.4 * link)) * CASE WHEN relation = 'INDIRECT' THEN 0.85 ELSE 1 END)), 3) END AS confidence,
    {snap_sql("horizon")} AS horizon_minutes, coalesce(causality, 'SENTIMENT') AS causality, coalesce(mechanism, 'no model returned a usable answer') AS mechanism, coalesce(risks, '') AS risks, coalesce(agreement, 0) AS agreement, coalesce(n, 0) AS model_count
    FROM link l LEFT JOIN f USING (news_id) LEFT JOIN cc USING (news_id))"""
IMPACT_COLUMNS = "news_id, asset, relation, direction, magnitude, round(expected_low, 6) AS expected_low, round(expected_high, 6) AS expected_high, round(confidence + 1e-7, 2) AS confidence, horizon_minutes, round(agreement, 6) AS agreement, model_count"


def _impacts(t: Tables) -> DataFrame:
    a = answers(t, "asset")
    links = a.select("news_id", "asset").distinct().selectExpr("*", "CASE WHEN news_id % 3 = 0 THEN 'INDIRECT' ELSE 'DIRECT' END AS relation", "(news_id % 5) / 5 AS confidence")
    return I.aggregate_impact(links, a)


@query(f"WITH {IMPACTS} SELECT {IMPACT_COLUMNS}, causality, mechanism, risks FROM impacts")
def a12_impacts(t: Tables) -> DataFrame:
    out = rounded(_impacts(t)).withColumn("confidence", F.round(F.col("confidence") + 1e-7, 2))
    return out.drop("source", "tradeable")


@query(f"""WITH {ANSWERS}, m AS (SELECT news_id, median({rank_sql("magnitude")}) AS rk, median((low + high) / 2) AS mid FROM answers WHERE ok GROUP BY news_id) SELECT news_id, {fold_sql("rk", "mid")} AS magnitude FROM m""")
def a13_magnitude_fold(t: Tables) -> DataFrame:
    m = answers(t).where("ok").groupBy("news_id").agg(F.median(V.magnitude_rank(F.col("magnitude")).cast("double")).alias("rk"), F.median((F.col("low") + F.col("high")) / 2).alias("mid"))
    return m.select("news_id", I.magnitude_fold(F.col("rk"), F.col("mid")).alias("magnitude"))


@query(f"""WITH {ANSWERS}, c AS (SELECT news_id, direction, count(*) AS n FROM answers WHERE ok GROUP BY ALL)
    SELECT news_id, CASE WHEN count(*) > 1 THEN string_agg(concat(n, 'x ', direction), ', ' ORDER BY direction) ELSE '' END AS disagreement FROM c GROUP BY news_id""")
def a14_disagreement(t: Tables) -> DataFrame:
    return C.disagreement_summary(answers(t), ["news_id"])


AUDITS = f"""audits AS (SELECT news_id, asset, model_seq, ok, CASE WHEN partkey % 13 > 0 THEN partkey % 5 > 1 END AS confirms, CASE WHEN partkey % 7 > 0 THEN direction END AS direction, magnitude, low, high, confidence, horizon, partkey % 2 = 0 AS priced_in,
    partkey % 6 = 0 AS overlooked FROM answers WHERE flag)"""
REVISED = f"""{IMPACTS}, {AUDITS},
base AS (SELECT news_id, direction AS was, expected_low AS was_low, expected_high AS was_high, confidence AS was_conf FROM impacts),
j AS (SELECT a.*, coalesce(a.direction, '') AS audit, b.* EXCLUDE (news_id), NOT confirms AND coalesce(a.direction, '') <> '' AND coalesce(a.direction, '') <> was AS other FROM audits a JOIN base b USING (news_id) WHERE ok AND confirms IS NOT NULL),
cnt AS (SELECT news_id, any_value(was) AS was, any_value(was_low) AS was_low, any_value(was_high) AS was_high, any_value(was_conf) AS was_conf, count(*) AS n, count(*) FILTER (confirms) AS confirmed, count(*) FILTER (other) AS others,
    count(*) FILTER (priced_in) AS priced, max(overlooked) AS over, median(confidence) AS aconf, median(horizon) AS horizon FROM j GROUP BY news_id),
alt AS (SELECT news_id, arg_max(audit, (n, audit)) AS top, max(n) / sum(n) AS share FROM (SELECT news_id, audit, count(*) AS n FROM j WHERE other GROUP BY ALL) GROUP BY news_id),
st AS (SELECT c.*, confirmed * 2 <= n AS contested, CASE WHEN confirmed * 2 > n OR others = 0 THEN was WHEN share >= 0.5 AND others * 2 > n THEN top WHEN was IN ('BULLISH', 'BEARISH') THEN 'MIXED' ELSE was END AS called FROM cnt c LEFT JOIN alt USING (news_id)),
sz AS (SELECT j.*, st.called, audit = '' OR audit = st.called OR NOT max(audit = '' OR audit = st.called) OVER (PARTITION BY j.news_id) AS inside FROM j JOIN st USING (news_id)),
sd AS (SELECT news_id, median(low) AS alow, median(high) AS ahigh, median({rank_sql("magnitude")}) AS rk, median((low + high) / 2) AS mid FROM sz WHERE inside GROUP BY news_id),
s1 AS (SELECT *, CASE WHEN priced * 2 > n THEN 0.45 ELSE 1 END AS keep, 0.35 * was_low + 0.65 * alow AS l0, 0.35 * was_high + 0.65 * ahigh AS h0 FROM st JOIN sd USING (news_id)),
s2 AS (SELECT *, least(l0, h0) * keep AS l1, greatest(l0, h0) * keep AS h1, {fold_sql("rk", "mid")} AS m0 FROM s1),
s3 AS (SELECT *, CASE WHEN keep < 1 THEN {fold_sql(rank_sql("m0"), "((l1 + h1) / 2)")} ELSE m0 END AS m1,
    CASE WHEN contested THEN least(was_conf, aconf, 0.55) ELSE least(aconf, was_conf * 1.15) * least(1, greatest(0.6, confirmed / n)) END * CASE WHEN called = 'MIXED' AND was <> 'MIXED' THEN 0.7 ELSE 1 END * CASE WHEN over THEN 0.9 ELSE 1 END AS c1 FROM s2),
revised AS (SELECT i.news_id, i.asset, i.relation, coalesce(called, direction) AS direction, coalesce(m1, magnitude) AS magnitude, coalesce(round_even(l1, 3), expected_low) AS expected_low, coalesce(round_even(h1, 3), expected_high) AS expected_high,
    CASE WHEN called IS NULL THEN i.confidence ELSE round_even(least(1, greatest(0, c1)), 3) END AS confidence, CASE WHEN called IS NULL THEN horizon_minutes ELSE {snap_sql("s3.horizon")} END AS horizon_minutes, coalesce(confirmed / n, agreement) AS agreement,
    coalesce(n, model_count) AS model_count, CASE WHEN called IS NULL THEN 'stage4' ELSE 'stage5' END AS source, causality FROM impacts i LEFT JOIN s3 USING (news_id))"""


def _revised(t: Tables) -> DataFrame:
    """Lines whose status is O answer as auditors too."""
    audits = answers(t, "asset").where("flag").selectExpr(
        "news_id", "asset", "model_seq", "ok", "CASE WHEN partkey % 13 > 0 THEN partkey % 5 > 1 END AS confirms", "CASE WHEN partkey % 7 > 0 THEN direction END AS direction", "magnitude", "low", "high", "confidence", "horizon", "partkey % 2 = 0 AS priced_in",
        "array(concat('conflict ', partkey % 3)) AS conflicts", "CASE WHEN partkey % 6 = 0 THEN array('missed') ELSE cast(array() AS array<string>) END AS overlooked",
    )
    return I.revise(_impacts(t), audits)


@query(f"WITH {REVISED} SELECT news_id, asset, direction, magnitude, round(expected_low + 1e-7, 2) AS expected_low, round(expected_high + 1e-7, 2) AS expected_high, round(confidence + 1e-7, 2) AS confidence, horizon_minutes, round(agreement, 6) AS agreement, model_count, source FROM revised")
def a15_revised(t: Tables) -> DataFrame:
    out = _revised(t).select("news_id", "asset", "direction", "magnitude", "expected_low", "expected_high", "confidence", "horizon_minutes", "agreement", "model_count", "source")
    return rounded(out).withColumns({c: F.round(F.col(c) + 1e-7, 2) for c in ("expected_low", "expected_high", "confidence")})


FINALS = f"""{REVISED}, finals AS (SELECT news_id, asset, model_seq, direction, magnitude, low, high, confidence, horizon, causality, partkey % 2 = 0 AS tradeable FROM answers WHERE ok AND NOT flag),
fd AS (SELECT news_id, direction, count(*) AS n FROM finals GROUP BY ALL),
fm AS (SELECT news_id, arg_max(direction, (n, direction)) AS top, max(n) / sum(n) AS share, count(*) AS kinds, sum(n) AS n, string_agg(direction, ', ' ORDER BY direction) AS seen FROM fd GROUP BY news_id),
fc AS (SELECT *, CASE WHEN kinds = n AND n >= 3 THEN 'MIXED' ELSE top END AS fcalled FROM fm),
fa AS (SELECT x.*, fcalled, direction = fcalled OR NOT max(direction = fcalled) OVER (PARTITION BY x.news_id) AS inside FROM finals x JOIN fc USING (news_id)),
ff AS (SELECT news_id, median(low) FILTER (inside) AS flow, median(high) FILTER (inside) AS fhigh, median(confidence) FILTER (inside) AS fconf, median(horizon) FILTER (inside) AS fhor, median({rank_sql("magnitude")}) FILTER (inside) AS rk,
    median((low + high) / 2) FILTER (inside) AS mid, count(*) FILTER (inside) AS aligned, count(*) FILTER (tradeable) AS trades FROM fa GROUP BY news_id),
done AS (SELECT *, {fold_sql("rk", "mid")} AS fmag FROM ff JOIN fc USING (news_id)),
verdict AS (SELECT r.news_id, r.asset, coalesce(fcalled, r.direction) AS direction, coalesce(fmag, r.magnitude) AS magnitude,
    CASE WHEN fcalled IS NULL THEN expected_low ELSE round_even(least(coalesce(nullif(flow, 0), expected_low), coalesce(nullif(fhigh, 0), expected_high)), 3) END AS expected_low,
    CASE WHEN fcalled IS NULL THEN expected_high ELSE round_even(greatest(coalesce(nullif(flow, 0), expected_low), coalesce(nullif(fhigh, 0), expected_high)), 3) END AS expected_high,
    CASE WHEN fcalled IS NULL THEN r.confidence ELSE round_even(least(1, greatest(0, CASE WHEN share < 0.6 THEN least(coalesce(nullif(fconf, 0), 0.5), 0.4) WHEN aligned < n THEN coalesce(nullif(fconf, 0), 0.5) * 0.85 ELSE coalesce(nullif(fconf, 0), 0.5) END)), 3) END AS confidence,
    coalesce(share, r.agreement) AS agreement, coalesce(n, r.model_count) AS model_count, CASE WHEN fcalled IS NULL THEN r.source ELSE 'final' END AS source, CASE WHEN fcalled IS NOT NULL THEN trades * 2 > n AND share >= 0.6 END AS tradeable,
    CASE WHEN fcalled IS NULL THEN 'final layer unavailable' WHEN share < 0.6 THEN concat('final panel split three ways (', seen, ')') WHEN fcalled <> r.direction THEN concat('overrules ', r.source, ' ', r.direction, ' -> ', fcalled) ELSE '' END AS notes
    FROM revised r LEFT JOIN done USING (news_id))"""


def _finals(t: Tables) -> DataFrame:
    """Lines of the other status answer as the final panel too."""
    panel = answers(t, "asset").where("NOT flag").withColumn("tradeable", F.expr("partkey % 2 = 0"))
    return I.decide_final(_revised(t), panel)


@query(f"WITH {FINALS} SELECT news_id, asset, direction, magnitude, round(expected_low + 1e-7, 2) AS expected_low, round(expected_high + 1e-7, 2) AS expected_high, round(confidence + 1e-7, 2) AS confidence, round(agreement, 6) AS agreement, model_count, source, tradeable, notes FROM verdict")
def a16_final_verdicts(t: Tables) -> DataFrame:
    out = _finals(t).select("news_id", "asset", "direction", "magnitude", "expected_low", "expected_high", "confidence", "agreement", "model_count", "source", "tradeable", "notes")
    return rounded(out).withColumns({c: F.round(F.col(c) + 1e-7, 2) for c in ("expected_low", "expected_high", "confidence")})


@query(f"WITH {FINALS} SELECT news_id, asset, depth, max(depth) OVER (PARTITION BY news_id) AS deepest FROM (SELECT *, CASE source WHEN 'stage5' THEN 5 WHEN 'final' THEN 6 ELSE 4 END AS depth FROM verdict)")
def a27_deepest_stage(t: Tables) -> DataFrame:
    return rounded(I.deepest_stage(settle(_finals(t).select("news_id", "asset", "source"))).select("news_id", "asset", "depth", "deepest"))


@query(f"WITH {ANSWERS} SELECT news_id, asset, string_agg(concat('stage', model_seq, ' ', direction), ' > ' ORDER BY model_seq) AS trail FROM answers GROUP BY ALL")
def a28_trail(t: Tables) -> DataFrame:
    return I.trail(answers(t).selectExpr("news_id", "asset", "model_seq AS stage", "concat('stage', model_seq, ' ', direction) AS note"))


ROUTED = f"""{REVISED}, routed AS (SELECT r.*, CASE news_id % 9 WHEN 0 THEN 'REGULATORY' WHEN 1 THEN 'LIQUIDATION' ELSE 'FUNDING' END AS event_type, s.score, CAST(news_id % 6 AS INT) AS source_count
    FROM revised r LEFT JOIN (SELECT news_id, median(score) AS score FROM answers WHERE ok GROUP BY news_id) s USING (news_id)),
prio AS (SELECT *, (abs(expected_low) + abs(expected_high)) / 2 * greatest(confidence, 0.1) + coalesce(score, 0) / 100 AS priority FROM routed)"""


def _routed(t: Tables) -> DataFrame:
    score = answers(t).where("ok").groupBy("news_id").agg(F.median("score").alias("score"))
    kind = F.expr("CASE news_id % 9 WHEN 0 THEN 'REGULATORY' WHEN 1 THEN 'LIQUIDATION' ELSE 'FUNDING' END")
    return settle(_revised(t)).join(score, "news_id", "left").withColumn("event_type", kind).withColumn("source_count", (F.col("news_id") % 6).cast("int"))


@query(f"""WITH {ROUTED} SELECT news_id, asset FROM prio
    WHERE (event_type IN ('REGULATORY', 'LIQUIDATION') OR coalesce(score, 0) >= 60 OR (source_count >= 4 AND coalesce(score, 0) >= 45) OR (model_count >= 2 AND agreement < 0.7) OR magnitude IN ('HIGH', 'EXTREME') OR direction = 'MIXED')
      AND CASE WHEN model_count = 0 THEN false WHEN magnitude = 'LOW' THEN agreement < 0.7 ELSE NOT (direction = 'NEUTRAL' AND confidence >= 0.6) END""")
def g2_g4_escalations(t: Tables) -> DataFrame:
    return R.escalations(_routed(t)).select("news_id", "asset")


@query(f"""WITH {ROUTED} SELECT news_id, asset FROM routed WHERE model_count > 0 AND (coalesce(score, 0) >= 75 OR (confidence < 0.6 AND magnitude IN ('HIGH', 'EXTREME')) OR magnitude = 'EXTREME' OR (source = 'stage5' AND direction = 'MIXED'))""")
def g5_final_gate(t: Tables) -> DataFrame:
    c = F.col
    return _routed(t).where(R.final_gate(c("model_count"), c("score"), c("confidence"), c("magnitude"), c("source"), c("direction"))).select("news_id", "asset")


SCORED = f"""{ROUTED}, scored AS (SELECT *, round_even(least(100, (0.40 * coalesce(nullif(score, 0), 40) / 100 + 0.35 * least((abs(expected_low) + abs(expected_high)) / 2, 8) / 8 + 0.25 * confidence + CASE WHEN source = 'stage5' THEN 0.06 ELSE 0 END)
    * CASE direction WHEN 'NEUTRAL' THEN 0.35 WHEN 'MIXED' THEN 0.75 ELSE 1 END * CASE WHEN model_count = 0 THEN 0.4 ELSE 1 END * 100), 1) AS alert_score FROM routed)"""


def _scored(t: Tables) -> DataFrame:
    c = F.col
    return _routed(t).withColumn("alert_score", V.alert_score(c("score"), c("expected_low"), c("expected_high"), c("confidence"), c("source"), c("direction"), c("tradeable"), c("model_count")))


@query(f"""WITH {SCORED} SELECT news_id, asset, direction <> 'NEUTRAL' AND alert_score >= 55 AS alerting,
    CASE WHEN alert_score >= 85 OR magnitude = 'EXTREME' THEN 'critical' WHEN alert_score >= 70 OR magnitude = 'HIGH' THEN 'high' WHEN alert_score >= 55 THEN 'medium' ELSE 'low' END AS urgency FROM scored""")
def k8_g6_alert_scores(t: Tables) -> DataFrame:
    c = F.col
    return _scored(t).select("news_id", "asset", R.should_alert(c("direction"), c("alert_score")).alias("alerting"), V.urgency_of(c("alert_score"), c("magnitude")).alias("urgency"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round((l_tax * 50 + l_quantity) / 2 * greatest(1 - l_discount * 10, 0.1) + l_extendedprice / 100, 6) AS priority,
    round_even((0.40 * l_extendedprice / 100000 + 0.35 * least((l_tax * 50 + l_quantity) / 2, 8) / 8 + 0.25 * (1 - l_discount * 5) + CASE WHEN l_linestatus = 'O' THEN 0.06 ELSE 0 END) * CASE WHEN l_returnflag = 'A' THEN 0.35 WHEN l_returnflag = 'R' THEN 0.75 ELSE 1 END * 100, 1) >= 50 AS strong FROM lineitem""")
def k7_k8_scores(t: Tables) -> DataFrame:
    c = F.col
    low, high, sure = c("l_tax") * 50, c("l_quantity"), 1 - c("l_discount") * 5
    source, kind = F.when(c("l_linestatus") == "O", "stage5").otherwise("stage4"), F.when(c("l_returnflag") == "A", "NEUTRAL").when(c("l_returnflag") == "R", "MIXED").otherwise("BULLISH")
    score = V.alert_score(c("l_extendedprice") / 1000, low, high, sure, source, kind, F.lit(None).cast("boolean"), F.lit(5))
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.round(V.priority(low, high, 1 - c("l_discount") * 10, c("l_extendedprice")), 6).alias("priority"), (score >= 50).alias("strong")
    )


@query(f"WITH {REVISED} SELECT news_id, asset, direction FROM revised WHERE model_count > 0 AND direction <> 'MIXED'")
def g7_predictions(t: Tables) -> DataFrame:
    return R.to_predictions(settle(_revised(t))).select("news_id", "asset", "direction")


@query(f"""WITH {ALERTS}, p AS (SELECT batch AS cycle, seq AS event_seq, asset, row_number() OVER (PARTITION BY batch ORDER BY seq, alert_score DESC, asset) AS place FROM alerts)
    SELECT cycle, event_seq, asset, CASE WHEN place <= 5 THEN place END AS place, place <= 5 AS granted FROM p""")
def w11_budget(t: Tables) -> DataFrame:
    c = alerts(t).selectExpr("batch AS cycle", "seq AS event_seq", "asset", "alert_score AS priority")
    return rounded(R.spend_budget(c).select("cycle", "event_seq", "asset", "place", "granted"))


GATED = f"""{ALERTS}, above AS (SELECT *, lag((direction, magnitude, CAST(round_even(confidence * 10, 0) AS INT))) OVER (PARTITION BY event_id, upper(asset) ORDER BY seq) = (direction, magnitude, CAST(round_even(confidence * 10, 0) AS INT)) AS same FROM alerts WHERE alert_score >= 55),
gated AS (SELECT seq, batch, CASE WHEN coalesce(same, false) AND source = 'stage4' THEN 'suppressed' ELSE 'sent' END AS outcome FROM above UNION ALL SELECT seq, batch, 'below' FROM alerts WHERE alert_score < 55)"""


@query(f"WITH {GATED} SELECT seq, batch, outcome FROM gated")
def w12_g8_publish_gate(t: Tables) -> DataFrame:
    return R.publish_gate(alerts(t)).select("seq", "batch", "outcome")


@query(f"WITH {GATED} SELECT batch, count(*) AS considered, count(*) FILTER (outcome = 'below') AS below_threshold, count(*) FILTER (outcome = 'suppressed') AS suppressed, count(*) FILTER (outcome = 'sent') AS sent FROM gated GROUP BY batch")
def a23_publish_report(t: Tables) -> DataFrame:
    return R.publish_report(R.publish_gate(alerts(t)))


@query(f"WITH {ALERTS} SELECT seq FROM alerts a WHERE NOT EXISTS (SELECT 1 FROM alerts s WHERE s.o_orderstatus = 'F' AND s.event_id = a.event_id AND upper(s.asset) = upper(a.asset))")
def j11_not_yet_alerted(t: Tables) -> DataFrame:
    a = alerts(t)
    return R.not_yet_alerted(a, a.select("event_id", "asset", (F.col("o_orderstatus") == "F").alias("delivered"))).select("seq")


@query(f"WITH {ALERTS} SELECT seq, n_name AS chat, count(*) OVER (PARTITION BY batch, n_name) > 6 AS digest FROM alerts, nation")
def j13_deliveries(t: Tables) -> DataFrame:
    return R.deliveries(alerts(t), t.nation.select(F.col("n_name").alias("chat"))).select("seq", "chat", "digest")


@query(f"WITH {ALERTS} SELECT seq, round(alert_score, 6) AS alert_score FROM alerts")
def w14_alert_order(t: Tables) -> DataFrame:
    return rounded(R.order_alerts(alerts(t)).select("seq", "alert_score"))


FUNNEL = f"""{ANSWERS}, {TALLY}, gates AS (SELECT o_orderkey AS news_id, strftime(o_orderdate, '%Y') AS run, CASE o_orderkey % 7 WHEN 0 THEN 'DUPLICATE' WHEN 1 THEN 'UPDATE' ELSE 'NEW' END AS decision, coalesce(v.verdict, 'INCONCLUSIVE') AS v1,
    CASE WHEN v.score >= 60 THEN 'PASS' ELSE 'REJECT' END AS v2, o_orderkey % 5 AS links, o_orderkey % 3 AS impacts FROM orders LEFT JOIN verdicts v ON v.news_id = o_orderkey),
funnel AS (SELECT *, CASE WHEN decision = 'DUPLICATE' THEN 0 WHEN v1 = 'REJECT' THEN 1 WHEN v2 = 'REJECT' THEN 2 WHEN links = 0 THEN 3 WHEN impacts = 0 THEN 4 END AS dropped_at FROM gates)"""


def _gated(t: Tables) -> DataFrame:
    v = C.tally(answers(t), ["news_id"], 2).select("news_id", F.col("verdict").alias("verdict1"), F.when(F.col("score") >= 60, "PASS").otherwise("REJECT").alias("verdict2"))
    stages = t.orders.selectExpr(
        "o_orderkey AS news_id", "date_format(o_orderdate, 'yyyy') AS run", "CASE o_orderkey % 7 WHEN 0 THEN 'DUPLICATE' WHEN 1 THEN 'UPDATE' ELSE 'NEW' END AS decision", "o_orderkey % 5 AS links", "o_orderkey % 3 AS impacts"
    ).join(v, "news_id", "left").fillna({"verdict1": "INCONCLUSIVE", "verdict2": "REJECT"})
    return R.funnel_gate(stages)


@query(f"WITH {FUNNEL} SELECT news_id, dropped_at FROM funnel")
def g1_funnel_gate(t: Tables) -> DataFrame:
    return rounded(_gated(t).select("news_id", "dropped_at"))


@query(f"WITH {FUNNEL} SELECT run, count(*) AS seen, {', '.join(f'count(*) FILTER (dropped_at = {k}) AS dropped_{k}' for k in range(5))}, count(*) FILTER (dropped_at IS NULL) AS through FROM funnel GROUP BY run")
def a22_funnel(t: Tables) -> DataFrame:
    from ..operators.report import funnel

    return funnel(_gated(t))


@query(f"""WITH {GATED}, h AS (SELECT seq, batch, (event_id, upper(asset)) IN (SELECT (event_id, upper(asset)) FROM alerts WHERE o_orderstatus = 'F') AS told, source <> 'stage4' AS deep, (direction, magnitude, CAST(round_even(confidence * 10, 0) AS INT)) AS shape, event_id, upper(asset) AS a FROM alerts WHERE alert_score >= 55),
    d AS (SELECT event_id, a, min(seq) AS deepest FROM h WHERE deep GROUP BY ALL), s AS (SELECT h.*, told AND (deepest IS NULL OR seq < deepest) AS silent FROM h LEFT JOIN d ON d.event_id = h.event_id AND d.a = h.a),
    r AS (SELECT *, CASE WHEN silent THEN true ELSE coalesce(lag(shape) OVER (PARTITION BY event_id, a, silent ORDER BY seq) = shape, false) AND NOT deep END AS held FROM s)
    SELECT seq, batch, CASE WHEN held THEN 'suppressed' ELSE 'sent' END AS outcome FROM r UNION ALL SELECT seq, batch, 'below' FROM alerts WHERE alert_score < 55""")
def g8_j11_backstop(t: Tables) -> DataFrame:
    """The gate after a restart: finished orders are what was sent before."""
    a = alerts(t)
    sent = a.select("event_id", "asset", (F.col("o_orderstatus") == "F").alias("delivered"))
    return R.publish_gate(a, sent=sent).select("seq", "batch", "outcome")


@query(f"""WITH {GATED}, p AS (SELECT batch, count(*) AS considered, count(*) FILTER (outcome = 'below') AS below_threshold, count(*) FILTER (outcome = 'suppressed') AS suppressed, count(*) FILTER (outcome = 'sent') AS passed FROM gated GROUP BY batch),
    m AS (SELECT DISTINCT g.batch, n_nationkey, CASE WHEN passed > 6 THEN 0 ELSE seq END AS message FROM gated g JOIN p USING (batch), nation WHERE outcome = 'sent'),
    s AS (SELECT batch, count(*) FILTER ((message + n_nationkey) % 5 > 0) AS sent, count(*) FILTER ((message + n_nationkey) % 5 = 0) AS failed FROM m GROUP BY batch)
    SELECT p.*, coalesce(sent, 0) AS sent, coalesce(failed, 0) AS failed, passed > 6 AS digested FROM p LEFT JOIN s USING (batch)""")
def a23_full_report(t: Tables) -> DataFrame:
    """A message an alert and chat, or one a chat where the pass is a digest; every fifth fails."""
    gated = R.publish_gate(alerts(t))
    each = R.deliveries(gated.where("outcome = 'sent'"), t.nation.select("n_nationkey"))
    messages = each.select("batch", "n_nationkey", F.when(F.col("digest"), 0).otherwise(F.col("seq")).alias("message")).distinct()
    return R.publish_report(gated, messages.select("batch", ((F.col("message") + F.col("n_nationkey")) % 5 > 0).alias("delivered")))


@query(f"""WITH {FUNNEL}, calls AS (SELECT news_id, count(*) AS calls, count(*) FILTER (NOT ok) AS failures, count(*) FILTER (partkey % 17 = 0) AS errors FROM answers GROUP BY news_id),
    al AS (SELECT l_orderkey AS news_id, count(*) AS alerts FROM lineitem WHERE l_tax > 0.06 GROUP BY ALL)
    SELECT run, count(*) AS ingested, count(*) FILTER (decision = 'DUPLICATE') AS duplicates, count(*) FILTER (decision = 'NEW') AS new_events, count(*) FILTER (decision = 'UPDATE') AS updates, {', '.join(f'count(*) FILTER (dropped_at = {k}) AS dropped_stage{k}' for k in (1, 2, 3))},
    count(*) FILTER (coalesce(dropped_at > 3, true)) AS analysed, count(*) FILTER (dropped_at IS NULL AND news_id % 4 = 0) AS escalated_stage5, count(*) FILTER (dropped_at IS NULL AND news_id % 8 = 0) AS escalated_final,
    {', '.join(f'CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}' for c in ('alerts', 'errors', 'calls', 'failures'))} FROM funnel LEFT JOIN calls USING (news_id) LEFT JOIN al USING (news_id) GROUP BY run""")
def a22_run_report(t: Tables) -> DataFrame:
    from ..operators.report import run_report, run_rows

    a = answers(t).select("news_id", "ok", F.when(F.col("partkey") % 17 == 0, "no such field").alias("error"))
    o = t.orders.select(F.col("o_orderkey").alias("news_id"))
    rows = run_rows(_gated(t), o.where("news_id % 4 = 0"), o.where("news_id % 8 = 0"), t.lineitem.where("l_tax > 0.06").select(F.col("l_orderkey").alias("news_id")), a)
    return run_report(rows)


@query(f"""WITH {ANSWERS}, u AS (SELECT *, CASE WHEN partkey % 13 > 0 THEN partkey % 5 > 1 END AS confirms FROM answers WHERE flag),
    g AS (SELECT news_id, count(*) FILTER (ok AND confirms IS NOT NULL) AS n, count(*) FILTER (ok AND confirms) AS yes, count(*) FILTER (ok AND confirms IS NOT NULL AND partkey % 2 = 0) AS priced,
        arg_max(reason, (length(reason), -model_seq)) FILTER (ok AND confirms IS NOT NULL AND reason <> '') AS why, flatten(list(CASE WHEN partkey % 6 = 0 THEN [concat('conflict ', partkey % 3), 'missed'] ELSE [concat('conflict ', partkey % 3)] END ORDER BY model_seq) FILTER (ok AND confirms IS NOT NULL)) AS notes FROM u GROUP BY news_id),
    d AS (SELECT *, array_to_string(list_filter(notes, lambda x, i: list_position(notes, x) = i)[1:3], '; ') AS told FROM g)
    SELECT news_id, CASE WHEN n = 0 THEN 'no usable cross-check' ELSE concat_ws('; ', concat(yes, '/', n, ' confirmed'), CASE WHEN priced * 2 > n THEN 'majority say already priced in' END, concat('objections: ', told), why) END AS summary FROM d""")
def a29_audit_lines(t: Tables) -> DataFrame:
    from ..operators.report import audit_summary

    audits = answers(t).where("flag").selectExpr(
        "news_id", "model_seq", "ok", "CASE WHEN partkey % 13 > 0 THEN partkey % 5 > 1 END AS confirms", "partkey % 2 = 0 AS priced_in", "array(concat('conflict ', partkey % 3)) AS conflicts",
        "CASE WHEN partkey % 6 = 0 THEN array(' missed', '') ELSE cast(array() AS array<string>) END AS overlooked", "reason",
    )
    return audit_summary(audits, ["news_id"])


@query(f"""WITH {ANSWERS}, p AS (SELECT news_id, ok AND partkey % 7 > 0 AS used, direction, partkey % 2 = 0 AS tradeable FROM answers WHERE NOT flag), d AS (SELECT news_id, direction, count(*) AS n FROM p WHERE used GROUP BY ALL),
    w AS (SELECT news_id, arg_max(direction, (n, direction)) AS top, max(n) AS most, CAST(sum(n) AS BIGINT) AS n FROM d GROUP BY news_id), t AS (SELECT news_id, count(*) FILTER (used AND tradeable) AS t FROM p GROUP BY news_id)
    SELECT t.news_id, CASE WHEN n IS NULL THEN 'final layer unavailable' ELSE concat(most, '/', n, ' heavy models ', top, ' (', CAST(round_even(most / n * 100, 0) AS BIGINT), '%), ', t, '/', n, ' tradeable') END AS summary FROM t LEFT JOIN w USING (news_id)""")
def a29_final_lines(t: Tables) -> DataFrame:
    from ..operators.report import final_summary

    panel = answers(t).where("NOT flag").selectExpr("news_id", "ok", "CASE WHEN partkey % 7 > 0 THEN direction END AS direction", "partkey % 2 = 0 AS tradeable")
    return final_summary(panel, ["news_id"])
