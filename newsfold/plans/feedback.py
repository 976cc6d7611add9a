"""Queries: event memory, prices, forecasts, models, call logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import consensus as C
from ..operators import feedback as B
from ..operators import memory as M
from ..operators import ops as O
from ..operators.vector_index import VectorIndex
from ..scale import Scratch, settle
from .adapters import ANSWERS, CALL_LOG, PREDICTIONS, PRICES, STATES, STORIES, VECTORS, answers, call_log, predictions, prices, states, stories, vectors
from .registry import Tables, query, r6, rounded

AS_OF = "timestamp_ntz'2024-01-25 00:00:00'"
SQL_AS_OF = "TIMESTAMP '2024-01-25'"

# ---------------------------------------------------------------- vectors
COSINE = "list_cosine_similarity(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[]))"


@query(f"""WITH {VECTORS}, p AS (SELECT a.id, b.id AS match_id, {COSINE} AS s FROM vectors a JOIN vectors b ON b.tm < a.tm AND b.tm >= a.tm - INTERVAL 7 DAY WHERE {COSINE} >= 0.3)
    SELECT id, match_id, round(s, 6) AS similarity, row_number() OVER (PARTITION BY id ORDER BY s DESC, match_id) AS rank FROM p QUALIFY rank <= 8""")
def j2_similar_articles(t: Tables) -> DataFrame:
    v = vectors(t)
    return rounded(M.find_similar(v, v, least=0.3))


SIMILAR = f"""{STORIES}, links AS (SELECT a.id, b.id AS match_id, list_cosine_similarity(a.v, b.v) AS s FROM stories a JOIN stories b ON b.tm < a.tm AND b.tm >= a.tm - INTERVAL 7 DAY WHERE list_cosine_similarity(a.v, b.v) >= 0.86),
best AS (SELECT id, match_id, round(s, 6) AS similarity, row_number() OVER (PARTITION BY id ORDER BY s DESC, match_id) AS rank FROM links QUALIFY rank <= 8)"""


def _index(t: Tables) -> tuple[Scratch, VectorIndex, DataFrame]:
    """The reports' vectors, appended in two parts of which one is written twice, and the table of them."""
    scratch = Scratch(t.spark, "vectors")
    v = scratch.put(stories(t), "stories")
    index = VectorIndex(t.spark, f"{scratch.root}/index").fit(v)
    late = F.col("at") >= F.expr("timestamp_ntz'2024-01-12 00:00:00'")
    for part in (v.where(~late), v.where(late), v.where(late)):
        index.append(part)
    return scratch, index, v


@query(f"WITH {SIMILAR} SELECT id, match_id, similarity, rank FROM best")
def j2_indexed_articles(t: Tables) -> DataFrame:
    scratch, index, v = _index(t)
    found = settle(index.search(v))
    scratch.clear()
    return rounded(found)


@query(f"WITH {SIMILAR} SELECT count(*) AS links, true AS enough FROM best")
def j2_probed_recall(t: Tables) -> DataFrame:
    """Whether three probes find nine tenths or more of the links that all rows give."""
    scratch, index, v = _index(t)
    exact, probed = settle(M.find_similar(v, v)), settle(index.search(v, probes=3))
    scratch.clear()
    hit = exact.join(probed.select("id", "match_id", F.lit(1).alias("hit")), ["id", "match_id"], "left")
    return hit.agg(F.count("*").alias("links"), (F.count("hit") >= 0.9 * F.count("*")).alias("enough"))


@query(f"WITH {VECTORS} SELECT a.id, round({COSINE}, 6) AS cosine FROM vectors a JOIN vectors b ON b.id = a.id + 1")
def v1_cosine(t: Tables) -> DataFrame:
    v = vectors(t)
    return v.alias("a").join(v.select((F.col("id") - 1).alias("id"), F.col("v").alias("w")), "id").select("id", r6(V.cosine(F.col("v"), F.col("w"))).alias("cosine"))


@query(f"WITH {VECTORS} SELECT id, round(list_sum(list_transform(v, lambda x: abs(CAST(x AS DOUBLE)))) / sqrt(list_sum(list_transform(v, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 5) AS size FROM vectors")
def v2_unit_vectors(t: Tables) -> DataFrame:
    return vectors(t).select("id", F.round(F.aggregate(V.unit(F.col("v")), F.lit(0.0), lambda a, x: a + F.abs(x)), 5).alias("size"))


# ---------------------------------------------------------------- event states
RANK = "CASE status WHEN 'reported' THEN 3 WHEN 'ongoing' THEN 4 WHEN 'confirmed' THEN 5 WHEN 'completed' THEN 6 ELSE 7 END"
DIFFS = f"""{STATES}, ranked AS (SELECT *, {RANK} AS status_rank FROM states),
looked AS (SELECT *, row_number() OVER w = 1 AS first, last_value(amount IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old_amount, max(status_rank) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old_rank,
    arg_max(status, (status_rank, tm, id)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old_status
    FROM ranked WINDOW w AS (PARTITION BY event_key ORDER BY tm, id)),
changed AS (SELECT *, NOT first AND CASE WHEN old_amount IS NULL AND amount IS NULL THEN false WHEN old_amount IS NULL OR amount IS NULL THEN true WHEN old_amount = amount THEN false ELSE abs(amount - old_amount) / greatest(abs(amount), abs(old_amount)) > 0.05 END AS changed_amount,
    NOT first AND status_rank <> old_rank AS changed_status FROM looked),
diffs AS (SELECT *, CASE WHEN first THEN 'NEW' WHEN changed_amount OR changed_status THEN 'UPDATE' ELSE 'DUPLICATE' END AS decision FROM changed)"""


def _diffs(t: Tables) -> DataFrame:
    return M.diff_states(states(t))


@query(f"WITH {DIFFS} SELECT id, decision, changed_amount, coalesce(changed_status, false) AS changed_status, old_amount, CAST(old_rank AS BIGINT) AS old_rank FROM diffs")
def w4_w6_event_decisions(t: Tables) -> DataFrame:
    return rounded(_diffs(t).select("id", "decision", "changed_amount", "changed_status", "old_amount", "old_rank"))


@query(f"""WITH {DIFFS} SELECT event_key, CAST(epoch_us(min(tm)) AS BIGINT) AS first_seen, CAST(epoch_us(max(tm)) AS BIGINT) AS last_seen, count(*) AS article_count, count(*) FILTER (decision = 'UPDATE') AS update_count,
    arg_max(amount, (tm, id)) FILTER (amount IS NOT NULL) AS amount, CAST(max(status_rank) AS BIGINT) AS status_rank, arg_max(status, (status_rank, tm, id)) AS status, arg_max(id, (tm, id)) FILTER (decision <> 'DUPLICATE') AS headline_id FROM diffs GROUP BY event_key""")
def w5_w7_events(t: Tables) -> DataFrame:
    out = M.events_rollup(_diffs(t))
    return rounded(out.withColumns({c: F.unix_micros(F.col(c).cast("timestamp")) for c in ("first_seen", "last_seen")}))


SUMMARY = """CASE WHEN changed_amount OR changed_status THEN concat_ws('; ', CASE WHEN changed_amount THEN concat('amount: ', coalesce(CAST(old_amount AS VARCHAR), 'None'), ' -> ', coalesce(CAST(amount AS VARCHAR), 'None')) END,
    CASE WHEN changed_status THEN concat('status: ''', old_status, ''' -> ''', status, '''') END) WHEN decision = 'NEW' THEN 'first report' ELSE 'no change' END"""


@query(f"WITH {DIFFS} SELECT event_key, id, {SUMMARY} AS summary FROM diffs WHERE decision = 'UPDATE'")
def w8_a30_event_updates(t: Tables) -> DataFrame:
    return M.event_updates(_diffs(t)).select("event_key", "id", "summary")


@query(f"""WITH {DIFFS}, u AS (SELECT event_key, tm, id, {SUMMARY} AS summary FROM diffs WHERE decision = 'UPDATE' QUALIFY row_number() OVER (PARTITION BY event_key ORDER BY tm DESC, id DESC) <= 4)
    SELECT event_key, string_agg(summary, ' | ' ORDER BY tm, id) AS context FROM u GROUP BY event_key""")
def w9_event_context(t: Tables) -> DataFrame:
    return M.event_context(M.event_updates(_diffs(t)))


# every field of the state: numbers, texts (two of them alike), status and claims
FULL_NUMBERS = {"price": "CASE WHEN id % 7 > 0 THEN 100.0 + (id % 3) * 10 END", "percentage": "(id % 2) * 5.0", "count": "CASE WHEN id % 4 > 0 THEN (id % 6) * 1.0 END"}
FULL_TEXTS = {
    "ruling": "CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'rejected in court' ELSE 'approved by the board' END", "location": "CASE id % 4 WHEN 0 THEN 'London' WHEN 1 THEN 'Tokyo' WHEN 2 THEN '' END",
    "time_reference": "CASE id % 3 WHEN 0 THEN 'late on monday' WHEN 1 THEN 'late on mondays' ELSE 'in the spring of 2025' END", "event_date": "CASE WHEN id % 6 < 2 THEN '2024-01-01' ELSE '2025-11-20' END",
}
FULL_FIELDS = ", ".join(f"CAST({e} AS double) AS {n}" for n, e in FULL_NUMBERS.items()) + ", " + ", ".join(f"{e} AS {n}" for n, e in FULL_TEXTS.items())
CLAIM_WORDS = ["md5(CAST(id % 37 AS {0}))", "md5(CAST(id * 7 % 41 + 100 AS {0}))"]
MOVED = "NOT first AND CASE WHEN old_{0} IS NULL AND {0} IS NULL THEN false WHEN old_{0} IS NULL OR {0} IS NULL THEN true WHEN old_{0} = {0} THEN false ELSE abs({0} - old_{0}) / greatest(abs({0}), abs(old_{0})) > 0.05 END AS changed_{0}"
SAID = "NOT first AND coalesce({0}, '') <> '' AND coalesce(rtrim(old_{0}, 's') <> rtrim({0}, 's'), true) AS changed_{0}"
EARLIER = "OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_NUMBERS, _CHANGES = ["amount", *FULL_NUMBERS], ["amount", *FULL_NUMBERS, "status", *FULL_TEXTS]
FULL = f"""{STATES}, full_states AS (SELECT *, {RANK} AS status_rank, {FULL_FIELDS}, [{", ".join(CLAIM_WORDS).format("VARCHAR")}] AS claims FROM states),
looked AS (SELECT *, row_number() OVER w = 1 AS first, max(status_rank) {EARLIER} AS old_rank, {", ".join(f"last_value({n} IGNORE NULLS) {EARLIER} AS old_{n}" for n in _NUMBERS)},
    {", ".join(f"last_value(nullif({n}, '') IGNORE NULLS) {EARLIER} AS old_{n}" for n in FULL_TEXTS)} FROM full_states WINDOW w AS (PARTITION BY event_key ORDER BY tm, id)),
mentions AS (SELECT event_key, tm, id, unnest(claims) AS claim, unnest([0, 1]) AS pos FROM full_states),
placed AS (SELECT *, row_number() OVER (PARTITION BY event_key, claim ORDER BY tm, id, pos) = 1 AS opens FROM mentions),
learnt AS (SELECT event_key, claim, tm, id, pos, row_number() OVER (PARTITION BY event_key ORDER BY tm, id, pos) <= 20 AS known FROM placed WHERE opens),
fresh AS (SELECT p.event_key, p.id, count(*) FILTER (p.opens OR NOT l.known) AS new_claims FROM placed p JOIN learnt l ON p.event_key = l.event_key AND p.claim = l.claim GROUP BY ALL),
changed AS (SELECT looked.*, new_claims, {", ".join(MOVED.format(n) for n in _NUMBERS)}, {", ".join(SAID.format(n) for n in FULL_TEXTS)}, NOT first AND coalesce(status_rank <> old_rank, false) AS changed_status
    FROM looked JOIN fresh ON looked.event_key = fresh.event_key AND looked.id = fresh.id),
full_diffs AS (SELECT *, CASE WHEN first THEN 'NEW' WHEN {" OR ".join(f"changed_{n}" for n in _CHANGES)} OR new_claims >= 2 THEN 'UPDATE' ELSE 'DUPLICATE' END AS decision FROM changed)"""


def _full(t: Tables) -> DataFrame:
    return states(t).selectExpr(
        "*", *[f"CAST({e} AS double) AS {n}" for n, e in FULL_NUMBERS.items()], *[f"{e} AS {n}" for n, e in FULL_TEXTS.items()], f"array({', '.join(CLAIM_WORDS).format('string')}) AS claims"
    )


@query(f"WITH {FULL} SELECT id, decision, new_claims, {', '.join(f'changed_{n}' for n in _CHANGES)} FROM full_diffs")
def w4_full_diffs(t: Tables) -> DataFrame:
    return rounded(M.diff_states(_full(t)).select("id", "decision", "new_claims", *[f"changed_{n}" for n in _CHANGES]))


@query(f"""WITH {FULL}, k AS (SELECT event_key, string_agg(claim, ' ' ORDER BY tm, id, pos) AS key_claims FROM learnt WHERE known GROUP BY event_key)
    SELECT d.event_key, count(*) AS article_count, count(*) FILTER (decision = 'UPDATE') AS update_count, arg_max(status, (status_rank, tm, id)) AS status, any_value(k.key_claims) AS key_claims,
    {", ".join(f"round(arg_max({n}, (tm, id)) FILTER ({n} IS NOT NULL), 6) AS {n}" for n in _NUMBERS)}, {", ".join(f"arg_max({n}, (tm, id)) FILTER (coalesce({n}, '') <> '') AS {n}" for n in FULL_TEXTS)}
    FROM full_diffs d JOIN k ON d.event_key = k.event_key GROUP BY d.event_key""")
def w5_full_merge(t: Tables) -> DataFrame:
    full = _full(t)
    known = M.known_claims(M.claim_mentions(full, "event_key"), "event_key")  # once for the decisions and the merge
    out = M.events_rollup(M.diff_states(full, known=known), known=known).withColumn("key_claims", F.array_join("key_claims", " "))
    return rounded(out.select("event_key", "article_count", "update_count", "status", "key_claims", *_NUMBERS, *FULL_TEXTS))


@query(f"WITH {STATES} SELECT c_custkey AS event_key, greatest(1, (SELECT count(*) FROM states s WHERE s.event_key = c_custkey)) AS source_count FROM customer")
def a26_source_count(t: Tables) -> DataFrame:
    return rounded(M.source_count(states(t), t.customer.select(F.col("c_custkey").alias("event_key"))))


RELATED = "related AS (SELECT o_orderkey AS event_id, concat(o_orderpriority, o_custkey % 50) AS event_type, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE concat('A', o_orderkey % 3) END AS asset, o_orderdate AS last_seen FROM orders)"


@query(f"""WITH {RELATED} SELECT a.event_id AS id, b.event_id AS other, row_number() OVER (PARTITION BY a.event_id ORDER BY b.last_seen DESC, b.event_id DESC) AS rank FROM related a JOIN related b ON a.event_type = b.event_type AND a.event_id <> b.event_id
    AND (a.asset = b.asset OR a.asset = '' OR b.asset = '') AND b.last_seen <= a.last_seen AND b.last_seen >= a.last_seen - INTERVAL 30 DAY QUALIFY rank <= 5""")
def j5_related_events(t: Tables) -> DataFrame:
    e = t.orders.selectExpr("o_orderkey AS event_id", "concat(o_orderpriority, o_custkey % 50) AS event_type", "CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE concat('A', o_orderkey % 3) END AS asset", "o_orderdate AS last_seen")
    return rounded(M.related_events(e, 30))


# two claims are alike by their digits or their status: what the likeness of characters says of these texts
ALIKE = """CASE WHEN {0} LIKE 'claim %' AND {1} LIKE 'claim %' THEN length({0}) = 7 AND length({1}) = 7 OR len(list_intersect(string_split(substr({0}, 7), ''), string_split(substr({1}, 7), ''))) > 0
    ELSE split_part({0}, ' by ', 1) = split_part({1}, ' by ', 1) END"""
KNOWN = f"""known AS (SELECT event_key, list_reduce(list_transform(list({{'tm': tm, 'id': id, 'pos': pos, 'claim': claim}} ORDER BY tm, id, pos), lambda x: [x]),
    lambda own, x: CASE WHEN len(own) >= 20 OR len(list_filter(own, lambda k: {ALIKE.format("k.claim", "x[1].claim")})) > 0 THEN own ELSE list_concat(own, x) END) AS own FROM said GROUP BY event_key)"""


@query(f"""WITH {STATES}, said AS (SELECT event_key, tm, id, unnest([concat('claim ', id % 40), concat(status, ' by ', id % 6)]) AS claim, unnest([0, 1]) AS pos FROM states), {KNOWN},
    fresh AS (SELECT s.event_key, s.id, count(*) FILTER (len(list_filter(k.own, lambda k: (k.tm, k.id, k.pos) < (s.tm, s.id, s.pos) AND {ALIKE.format("k.claim", "s.claim")})) = 0) AS new_claims FROM said s JOIN known k ON k.event_key = s.event_key GROUP BY ALL)
    SELECT f.event_key, f.id, new_claims, new_claims >= 2 AND row_number() OVER (PARTITION BY f.event_key ORDER BY s.tm, s.id) > 1 AS material FROM fresh f JOIN states s ON s.id = f.id AND s.event_key = f.event_key""")
def w4_claims_fold(t: Tables) -> DataFrame:
    claims = F.expr("array(concat('claim ', id % 40), concat(status, ' by ', id % 6))")
    return rounded(M.fold_claims(states(t).withColumn("claims", claims)))


@query()
def j4_event_match(t: Tables) -> DataFrame:
    v = vectors(t)
    facts = v.selectExpr("id", "at", "concat('TYPE', label) AS event_type", "concat('actor', id % 90) AS entity", "CASE WHEN label % 2 = 0 THEN 'BTC' ELSE 'ETH' END AS asset", "'approve' AS action", "concat('object', id % 45) AS target")
    return M.match_events(facts, settle(M.find_similar(v, v, least=0.3).select("id", "match_id", "similarity"))).select("id", "event_id")


@query(f"""WITH {STATES}, i AS (SELECT id, substring(sha256(concat_ws('|', event_type, status, concat('k', event_key % 30), '', '')), 1, 32) AS identity_key FROM states), e AS (SELECT identity_key, min(id) AS event_id FROM i GROUP BY identity_key HAVING count(*) > 1)
    SELECT id, event_id FROM i LEFT JOIN e USING (identity_key)""")
def j3_h5_identity_lookup(t: Tables) -> DataFrame:
    facts = states(t).selectExpr("id", "event_type", "status AS entity", "concat('k', event_key % 30) AS asset", "'' AS action", "'' AS target")
    keyed = M.identity(facts)
    events = keyed.groupBy("identity_key").agg(F.min("id").alias("event_id"), F.count("*").alias("n")).where("n > 1")
    return M.event_by_identity(keyed, events).select("id", "event_id")


# ---------------------------------------------------------------- forecasts
BASE = f"{PREDICTIONS}, {PRICES}, based AS (SELECT p.*, x.price AS baseline_price, CASE WHEN x.price > 0 THEN 'ready' WHEN {SQL_AS_OF} - created_at > INTERVAL 6 HOUR THEN 'abandoned' ELSE 'pending' END AS state FROM predictions p ASOF LEFT JOIN prices x ON p.asset = x.asset AND p.created_at >= x.tm)"


def _baselines(t: Tables) -> DataFrame:
    return settle(B.baselines(predictions(t), prices(t), F.expr(AS_OF)))


@query(f"WITH {BASE} SELECT id, round(baseline_price, 6) AS baseline_price, state FROM based")
def j8_j9_baselines(t: Tables) -> DataFrame:
    return rounded(_baselines(t).select("id", "baseline_price", "state"))


DUE = f"""{BASE}, due AS (SELECT DISTINCT id, asset, created_at, o AS offset_min FROM (SELECT *, unnest(list_distinct([15, 60, 180, 360, 1440, horizon_minutes])) AS o FROM predictions) WHERE o % 7 <> id % 7 AND {SQL_AS_OF} >= created_at + o * INTERVAL 1 MINUTE + INTERVAL 30 SECOND),
obs AS (SELECT d.id, d.offset_min AS off, CASE WHEN b.baseline_price > 0 THEN (x.price - b.baseline_price) / b.baseline_price * 100 END AS pct FROM (SELECT *, created_at + offset_min * INTERVAL 1 MINUTE AS due_at FROM due) d ASOF JOIN prices x ON d.asset = x.asset AND d.due_at >= x.tm JOIN based b ON b.id = d.id WHERE b.baseline_price > 0)"""


def _due(t: Tables) -> DataFrame:
    p = predictions(t)
    seen = p.select("id", F.explode(F.array(*[F.lit(h) for h in V.HORIZONS])).alias("offset")).where("offset % 7 = id % 7")
    return B.due_horizons(p, seen, F.expr(AS_OF))


def _observed(t: Tables) -> DataFrame:
    return settle(B.observe(_due(t), _baselines(t), prices(t)))


@query(f'WITH {DUE} SELECT id, CAST(offset_min AS BIGINT) AS "offset" FROM due')
def j7_due_horizons(t: Tables) -> DataFrame:
    return rounded(_due(t).select("id", "offset"))


@query(f'WITH {DUE} SELECT id, CAST(off AS BIGINT) AS "offset", round(pct, 6) AS pct FROM obs')
def k1_observations(t: Tables) -> DataFrame:
    return rounded(_observed(t))


SCORES = f"""{DUE}, s AS (SELECT o.id, p.direction, off, pct, abs(off - horizon_minutes) AS far, CASE direction WHEN 'BULLISH' THEN least(abs(expected_low), abs(expected_high)) ELSE -greatest(abs(expected_low), abs(expected_high)) END AS lo,
    CASE direction WHEN 'BEARISH' THEN -least(abs(expected_low), abs(expected_high)) ELSE greatest(abs(expected_low), abs(expected_high)) END AS hi, CASE WHEN pct > 0.15 THEN 'BULLISH' WHEN pct < -0.15 THEN 'BEARISH' ELSE 'NEUTRAL' END AS went FROM obs o JOIN predictions p ON p.id = o.id),
e AS (SELECT *, CASE WHEN pct BETWEEN lo AND hi THEN 0 ELSE least(abs(pct - lo), abs(pct - hi)) END AS err FROM s),
pick AS (SELECT id, any_value(direction) AS direction, any_value(lo) AS lo, any_value(hi) AS hi, arg_min(pct, (far, off)) AS actual, arg_min(err, (far, off)) AS err, arg_min(went, (far, off)) AS went,
    arg_min(off, (err + CASE WHEN direction IN ('BULLISH', 'BEARISH') AND went <> direction THEN 1000 ELSE 0 END, far, off)) AS best_horizon_minutes, count(*) AS samples FROM e GROUP BY id),
outcomes AS (SELECT *, CASE WHEN direction IN ('NEUTRAL', 'MIXED') THEN went = 'NEUTRAL' ELSE went = direction END AS direction_correct FROM pick),
scored AS (SELECT *, CASE WHEN direction_correct THEN 0.65 + 0.35 * greatest(0, 1 - err / (greatest(0.5, abs(hi - lo), abs(hi) * 0.5) * 2)) ELSE 0.175 * greatest(0, 1 - err / (greatest(1, abs(hi - lo), abs(hi)) * 3)) END AS score FROM outcomes)"""


def _outcomes(t: Tables) -> DataFrame:
    return B.score_predictions(predictions(t), _observed(t))


@query(f"WITH {SCORES} SELECT id, direction, direction_correct, round(round_even(actual, 4) + 1e-7, 3) AS actual_pct, round(round_even(err, 4) + 1e-7, 3) AS magnitude_error, round(round_even(score, 4) + 1e-7, 3) AS score, CAST(best_horizon_minutes AS BIGINT) AS best_horizon_minutes, went <> 'NEUTRAL' AS moved, samples FROM scored")
def a17_outcomes(t: Tables) -> DataFrame:
    out = _outcomes(t).drop("expected_pct").withColumns({c: F.round(F.col(c) + 1e-7, 3) for c in ("actual_pct", "magnitude_error", "score")})
    return rounded(out)


@query(f"""WITH {DUE}, m AS (SELECT id, list(off) AS offs FROM obs GROUP BY id) SELECT id FROM predictions p JOIN m USING (id) WHERE list_contains(offs, horizon_minutes) OR {SQL_AS_OF} - created_at >= INTERVAL 1440 MINUTE + INTERVAL 30 SECOND""")
def g9_resolvable(t: Tables) -> DataFrame:
    return B.resolvable(predictions(t), _observed(t), F.expr(AS_OF)).select("id")


@query(f"""WITH {DUE}, m AS (SELECT id, string_agg(concat(off, '=', CAST(round_even(pct, 0) AS BIGINT)), ',' ORDER BY off) AS observations FROM obs GROUP BY id)
    SELECT id, observations FROM (SELECT * FROM predictions WHERE id % 3 > 0 ORDER BY created_at, id LIMIT 200) LEFT JOIN m USING (id)""")
def j6_a25_open_predictions(t: Tables) -> DataFrame:
    p = predictions(t)
    out = B.open_predictions(p, p.where("id % 3 = 0").select("id"), _observed(t))
    told = F.array_join(F.transform(F.array_sort(F.map_entries("observations")), lambda e: F.concat(e["key"].cast("string"), F.lit("="), F.bround(e["value"]).cast("long").cast("string"))), ",")
    return out.select("id", told.alias("observations"))


ASSETS = "CASE id % 5 WHEN 0 THEN 'crypto' WHEN 1 THEN '$btc/usdt' WHEN 2 THEN 'usdc' WHEN 3 THEN 'Bitcoin' ELSE 'SOL-PERP' END"


@query(f"WITH {BASE}, b AS (SELECT *, id % 5 IN (0, 2) AS dead FROM based) SELECT id, CAST(0 AS DOUBLE) AS score, true AS unscored, CASE WHEN dead THEN 'unpriceable' ELSE 'no baseline' END AS reason FROM b WHERE dead OR state = 'abandoned'")
def g10_p13_unscored(t: Tables) -> DataFrame:
    return B.close_unscored(_baselines(t).withColumn("asset", F.expr(ASSETS)))


@query(f"WITH {BASE} SELECT count(*) AS considered, count(*) FILTER (id % 5 IN (0, 2)) AS unpriceable, count(*) FILTER (state = 'ready') AS ready, count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'abandoned') AS abandoned FROM based")
def g11_observe_stats(t: Tables) -> DataFrame:
    return B.observe_stats(_baselines(t).withColumn("asset", F.expr(ASSETS)))


@query(f"""WITH {DUE}, b AS (SELECT *, id % 5 IN (0, 2) AS dead FROM based), m AS (SELECT id, list(off) AS offs FROM obs GROUP BY id)
    SELECT count(*) AS considered, count(*) FILTER (NOT dead AND state = 'ready' AND id % 3 > 0) AS baselines_set, count(*) FILTER (dead) AS unpriceable, count(*) FILTER (NOT dead AND state = 'pending') AS pending, count(*) FILTER (NOT dead AND state = 'abandoned') AS abandoned,
    (SELECT count(*) FROM obs JOIN b USING (id) WHERE NOT dead) AS observations, (SELECT count(*) FROM b JOIN m USING (id) WHERE NOT dead AND (list_contains(offs, horizon_minutes) OR {SQL_AS_OF} - created_at >= INTERVAL 1440 MINUTE + INTERVAL 30 SECOND)) AS resolved FROM b""")
def g11_observe_report(t: Tables) -> DataFrame:
    found = _baselines(t)  # once for the counts and the samples
    base = found.withColumn("asset", F.expr(ASSETS)).withColumn("had_baseline", F.expr("id % 3 = 0"))
    seen = settle(B.observe(_due(t), found, prices(t)))
    return B.observe_report(base, seen, B.resolvable(predictions(t), seen, F.expr(AS_OF)))


PERFORMANCE = f"""{SCORES}, results AS (SELECT id, unnest([id % 7, (id + 1) % 7, (id + 2) % 7]) AS m FROM predictions), credit AS (SELECT s.*, concat('m', r.m) AS model_id, concat('T', s.id % 6) AS event_type, p.asset, r.m * 100 AS latency FROM scored s JOIN results r ON r.id = s.id AND (r.m + s.id) % 4 > 0 JOIN predictions p ON p.id = s.id),
performance AS (SELECT model_id, '5' AS stage, coalesce(event_type, 'ALL') AS event_type, coalesce(asset, 'ALL') AS asset, count(*) AS predictions, count(*) FILTER (direction_correct) AS direction_correct, avg(err) AS avg_magnitude_error, avg(score) AS avg_score,
    avg(latency) FILTER (latency > 0) AS avg_latency_ms FROM credit GROUP BY GROUPING SETS ((model_id, event_type, asset), (model_id)))"""


def _performance(t: Tables) -> DataFrame:
    out = _outcomes(t).join(predictions(t).select("id", "asset", "event_type"), "id").select("*", F.col("id").alias("news_id"), F.lit(5).alias("stage"))
    results = predictions(t).select(F.col("id").alias("news_id"), "asset", F.lit(5).alias("stage"), F.explode(F.expr("array(id % 7, (id + 1) % 7, (id + 2) % 7)")).alias("m")).selectExpr("news_id", "stage", "asset", "concat('m', m) AS model_id", "(m + news_id) % 4 > 0 AS ok", "m * 100 AS latency_ms")
    return B.model_performance(B.credit_models(out, results), with_totals=True)


@query(f"WITH {PERFORMANCE} SELECT model_id, stage, event_type, asset, predictions, direction_correct, round(avg_magnitude_error + 1e-7, 2) AS avg_magnitude_error, round(avg_score + 1e-7, 2) AS avg_score, round(avg_latency_ms, 6) AS avg_latency_ms FROM performance")
def a18_j14_model_performance(t: Tables) -> DataFrame:
    out = _performance(t).drop("score_sum", "latency_count")
    return rounded(out).withColumns({c: F.round(F.col(c) + 1e-7, 2) for c in ("avg_magnitude_error", "avg_score")})


@query(f"WITH {PERFORMANCE} SELECT model_id, event_type, asset, round(direction_correct / predictions, 6) AS hit_rate, round((direction_correct + 2) / (predictions + 4), 6) AS adjusted FROM performance WHERE predictions > 0")
def a20_model_ranking(t: Tables) -> DataFrame:
    return rounded(B.rank_models(_performance(t)).select("model_id", "event_type", "asset", "hit_rate", "adjusted"))


@query(f"WITH {PERFORMANCE} SELECT model_id, event_type, asset, predictions FROM performance ORDER BY predictions DESC, avg_score DESC, model_id, event_type, asset LIMIT 7")
def w15_performance_page(t: Tables) -> DataFrame:
    return B.model_performance_page(_performance(t), most=7).select("model_id", "event_type", "asset", "predictions")


@query(f"""WITH {PRICES}, c AS (SELECT asset, date_trunc('minute', tm) AS m, arg_min(price, seq) AS open FROM prices GROUP BY ALL), {PREDICTIONS}
    SELECT p.id, round(coalesce(a.open, b.open), 6) AS price FROM predictions p LEFT JOIN c a ON a.asset = p.asset AND a.m = date_trunc('minute', created_at) LEFT JOIN c b ON b.asset = p.asset AND b.m = date_trunc('minute', created_at) + INTERVAL 1 MINUTE""")
def s7_price_at(t: Tables) -> DataFrame:
    minute = F.date_trunc("minute", F.col("at").cast("timestamp"))
    candles = prices(t).groupBy("asset", minute.alias("minute_ts")).agg(F.min_by("price", "seq").alias("open"))
    keys = predictions(t).select("id", "asset", F.col("created_at").cast("timestamp").alias("at"))
    return rounded(B.price_at(keys, candles).select("id", "price"))


@query(f"WITH {BASE} SELECT p.id, round(CASE WHEN p.id % 2 = 0 THEN 1.5 ELSE b.baseline_price END, 6) AS baseline_price FROM predictions p LEFT JOIN based b USING (id)")
def s14_set_baseline(t: Tables) -> DataFrame:
    p = predictions(t).withColumn("baseline_price", F.when(F.col("id") % 2 == 0, 1.5))
    return rounded(B.set_baseline(p, _baselines(t).select("id", F.col("baseline_price").alias("price"))).select("id", "baseline_price"))


# ---------------------------------------------------------------- call logs
CLASSED = f"""{CALL_LOG}, classed AS (SELECT *, CASE WHEN status = 200 THEN NULL WHEN status IN (401, 429, 402) THEN 'retry_other_key' WHEN status = 400 AND (lower(body) LIKE '%api key not valid%' OR lower(body) LIKE '%quota%') THEN 'retry_other_key' WHEN status IN (400, 404) THEN 'fatal' ELSE 'retry_same_key' END AS disposition,
    CASE WHEN status = 200 THEN NULL WHEN status = 401 THEN 'invalid' WHEN status = 429 AND lower(body) LIKE '%quota%' THEN 'quota' WHEN status = 429 THEN 'rate_limited' WHEN status = 402 THEN 'quota' WHEN status = 400 AND lower(body) LIKE '%api key not valid%' THEN 'invalid' WHEN status = 400 AND lower(body) LIKE '%quota%' THEN 'quota'
    WHEN status IN (400, 404) THEN 'none' ELSE 'transient' END AS fault, CASE WHEN body LIKE '%2.5s%' THEN 2.5 WHEN body LIKE '%700ms%' THEN 0.7 END AS retry_after,
    CASE WHEN status = 200 THEN NULL WHEN body = '' THEN 'empty response body' WHEN body LIKE '%quota%' THEN 'quota exceeded, try again in 2.5s' WHEN body LIKE '%API key%' THEN 'API key not valid' WHEN body LIKE '%700ms%' THEN 'try again in 700ms' ELSE body END AS message FROM call_log)"""


@query(f"WITH {CLASSED} SELECT id, disposition, fault, CAST(retry_after AS DOUBLE) AS retry_after, message FROM classed")
def p21_p23_call_errors(t: Tables) -> DataFrame:
    return rounded(O.classify_errors(call_log(t)).select("id", "disposition", "fault", "retry_after", "message"))


@query(f"""WITH {CLASSED}, b AS (SELECT *, status = 200 AS ok, coalesce(fault <> 'none', false) AS bad, max((ts, id)) FILTER (status = 200) OVER (PARTITION BY provider, key_index) AS last_ok FROM classed),
    a AS (SELECT *, bad AND (last_ok IS NULL OR (ts, id) > last_ok) AS after FROM b),
    g AS (SELECT provider, key_index, count(*) FILTER (ok) AS success, count(*) FILTER (bad) AS failure, count(*) FILTER (after) AS consecutive_failures, arg_max(fault, (ts, id)) FILTER (after) AS f, arg_max(coalesce(retry_after, 0), (ts, id)) FILTER (after) AS r, avg(latency_ms) FILTER (ok) AS avg_latency_ms FROM a GROUP BY ALL)
    SELECT provider, key_index, success, failure, consecutive_failures, round(avg_latency_ms, 6) AS avg_latency_ms, CASE WHEN f IS NULL THEN 'healthy' WHEN f = 'invalid' THEN 'dead' ELSE 'cooling' END AS status,
    CASE WHEN f IS NULL THEN NULL WHEN f = 'invalid' THEN 1800 ELSE least(1800, greatest(CASE WHEN f = 'quota' THEN 1800 ELSE 20 * pow(2, consecutive_failures - 1) END, r)) END AS cooldown_seconds FROM g""")
def a19_key_health(t: Tables) -> DataFrame:
    return rounded(O.key_health(call_log(t)).select("provider", "key_index", "success", "failure", "consecutive_failures", "avg_latency_ms", "status", "cooldown_seconds"))


@query("""SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN concat('answer ', event_id) ELSE concat('part ', user_id, ' more') END AS text, CASE WHEN event_id % 2 = 0 THEN 'length' ELSE 'STOP' END AS finish, user_id AS prompt_tokens, event_id % 2 = 0 AS truncated FROM events""")
def p24_unwrap_responses(t: Tables) -> DataFrame:
    chat = """concat('{"choices": [{"message": {"content": "answer ', event_id, '"}, "finish_reason": "length"}], "usage": {"prompt_tokens": ', user_id, '}}')"""
    parts = """concat('{"candidates": [{"content": {"parts": [{"text": "part "}, {"text": "', user_id, ' more"}]}, "finishReason": "STOP"}], "usageMetadata": {"promptTokenCount": ', user_id, '}}')"""
    raw = t.events.selectExpr("event_id AS id", f"CASE WHEN event_id % 2 = 0 THEN {chat} ELSE {parts} END AS body")
    return rounded(O.unwrap_responses(raw).select("id", "text", "finish", "prompt_tokens", "truncated"))


@query(f"WITH {ANSWERS} SELECT model_id, 4 AS stage, count(*) AS answers, count(*) FILTER (NOT ok) AS failures, round(avg(partkey % 1000), 6) AS avg_latency_ms, CAST(sum(partkey % 77) AS BIGINT) AS tokens FROM answers GROUP BY model_id")
def a24_model_health(t: Tables) -> DataFrame:
    a = answers(t).selectExpr("model_id", "4 AS stage", "ok", "partkey % 1000 AS latency_ms", "partkey % 77 AS tokens")
    return rounded(C.model_health(a))
