"""Coercions of model answers, enumerations, magnitude bands, scores: the scalar rules of the panels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _strip, _sub, let

# ---------------------------------------------------------------- fixed values
TRUE_WORDS = ["true", "yes", "y", "1", "keep", "relevant", "bullish", "worth"]
FALSE_WORDS = ["false", "no", "n", "0", "remove", "drop", "irrelevant", "none"]
#: Names and aliases of directions; all else is NEUTRAL. Fixed values.
DIRECTIONS = {
    "BULLISH": ["BULLISH", "UP", "POSITIVE", "BULL", "LONG"],
    "BEARISH": ["BEARISH", "DOWN", "NEGATIVE", "BEAR", "SHORT"],
    "MIXED": ["MIXED", "UNCERTAIN", "BOTH", "UNCLEAR"],
}
#: Magnitudes in order, with their default bands in percent. Fixed values.
BANDS = {"LOW": (0.1, 0.7), "MEDIUM": (0.7, 2.0), "HIGH": (2.0, 5.0), "EXTREME": (5.0, 15.0)}
RANKS = {m: i + 1 for i, m in enumerate(BANDS)}
CAUSALITIES = ["DIRECT", "INDIRECT", "MACRO", "LIQUIDITY", "SENTIMENT", "REGULATORY", "FUNDAMENTAL"]
HORIZONS = [15, 60, 180, 360, 1440]
#: Words in an asset field that name a category. Fixed values.
NOT_TICKERS = ["ALL", "ANY", "NONE", "MARKET", "CRYPTO", "ALTCOINS", "ALTS", "DEFI", "STABLECOINS", "TOKENS", "COINS", "NA", "N/A", "USD", "EUR", "FIAT"]
UNPRICEABLE = [
    "CRYPTO", "MARKET", "ALTCOINS", "ALTS", "DEFI", "NFT", "MEMECOINS", "STABLECOINS", "TOTAL", "TOTAL3", "L1", "L2", "AI", "RWA", "GAMING",
    "USD", "EUR", "GOLD", "SPX", "NASDAQ", "EQUITIES", "BONDS",
]
PEGGED = ["USDT", "USDC", "DAI", "BUSD", "TUSD", "FDUSD", "USDE", "PYUSD"]
#: Names that differ from the exchange's symbol. Fixed values.
ASSET_NAMES = {
    "BITCOIN": "BTC", "ETHEREUM": "ETH", "SOLANA": "SOL", "RIPPLE": "XRP", "XBT": "BTC", "MATIC": "POL", "BNB": "BNB", "CARDANO": "ADA",
    "DOGECOIN": "DOGE", "POLKADOT": "DOT", "AVALANCHE": "AVAX", "CHAINLINK": "LINK", "LITECOIN": "LTC", "TONCOIN": "TON", "SHIBA": "SHIB", "SHIBA INU": "SHIB",
}
#: Status words by how settled an event is; others are 0. Fixed values.
STATUSES = {
    1: ["rumored", "rumoured", "speculated"], 2: ["proposed", "filed", "planned", "expected"], 3: ["reported", "alleged"],
    4: ["ongoing", "developing", "in progress"], 5: ["confirmed", "announced", "approved"], 6: ["completed", "settled", "closed", "executed"],
    7: ["denied", "rejected", "cancelled", "canceled", "withdrawn"],
}
NUMERIC_TOLERANCE = 0.05
NOISE_FLOOR = 0.15
DEADBAND = 0.15


def lookup(c: Column, table: dict, default: object = None) -> Column:
    """A literal table as an ordered chain of conditions."""
    return reduce(lambda out, kv: F.when(c == kv[0], F.lit(kv[1])).otherwise(out), reversed(list(table.items())), F.lit(default))


def clamp(c: Column, low: float, high: float) -> Column:
    """Within limits; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def half_even(c: Column, places: int) -> Column:
    """Half-even on the double product, as the SQL side's ``round_even`` has it: ties are told by the double times the power of ten, where ``bround`` takes the shortest decimal digits."""
    power = 10.0**places
    return F.rint(c * power) / power


# ---------------------------------------------------------------- coercions of text values
def as_bool(c: Column) -> Column:
    """True and false words; numbers by whether they are zero; null for all else."""
    word = F.lower(_strip(c.cast("string")))
    return F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False)


def as_float(c: Column) -> Column:
    """The first number in a text, thousands separators removed."""
    found = F.regexp_extract(F.replace(c.cast("string"), F.lit(","), F.lit("")), r"-?\d+(?:\.\d+)?", 0)
    return let(found, lambda x: F.when(x != "", x.cast("double")))


def as_int(c: Column) -> Column:
    return F.bround(as_float(c)).cast("long")


def as_probability(c: Column, default: float | None = None) -> Column:
    """A number over 1 is a percentage."""
    return let(as_float(c), lambda v: F.coalesce(clamp(F.when(v > 1, v / 100).otherwise(v), 0.0, 1.0), F.lit(default).cast("double")))


def as_str_list(c: Column) -> Column:
    """Parts of a text between commas, semicolons and line breaks; a null has none."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"[,\n;]"), _strip)
    return F.filter(parts, lambda x: x != "")


def json_str_list(c: Column) -> Column:
    """A JSON list of texts, or of objects with a naming key, as texts; a JSON text as :func:`as_str_list`."""
    items = F.from_json(c, "array<string>")
    named = lambda x: F.coalesce(*[F.get_json_object(x, f"$.{k}") for k in ("name", "asset", "symbol", "value", "text", "claim")])
    texts = F.transform(items, lambda x: _strip(F.when(F.startswith(x, F.lit("{")), named(x)).otherwise(x)))
    return F.when(F.startswith(_strip(c), F.lit("[")), F.filter(texts, lambda x: F.coalesce(x, F.lit("")) != "")).otherwise(as_str_list(c))


# ---------------------------------------------------------------- enumerations
def parse_direction(c: Column) -> Column:
    word = F.upper(_strip(F.coalesce(c, F.lit(""))))
    return reduce(lambda out, kv: F.when(word.isin(kv[1]), F.lit(kv[0])).otherwise(out), DIRECTIONS.items(), F.lit("NEUTRAL"))


def parse_magnitude(c: Column) -> Column:
    """The strongest magnitude that the text names, else LOW."""
    word = F.upper(F.coalesce(c, F.lit("")))
    return reduce(lambda out, m: F.when(F.contains(word, F.lit(m)), F.lit(m)).otherwise(out), BANDS, F.lit("LOW"))


def parse_relation(c: Column) -> Column:
    return F.when(F.startswith(F.upper(_strip(F.coalesce(c, F.lit("")))), F.lit("DIR")), F.lit("DIRECT")).otherwise(F.lit("INDIRECT"))


def parse_causality(c: Column) -> Column:
    word = F.upper(_strip(F.coalesce(c, F.lit(""))))
    return F.when(word.isin(CAUSALITIES), word).otherwise(F.lit("SENTIMENT"))


def band_low(m: Column) -> Column:
    return lookup(m, {k: v[0] for k, v in BANDS.items()}, 0.1)


def band_high(m: Column) -> Column:
    return lookup(m, {k: v[1] for k, v in BANDS.items()}, 0.7)


def magnitude_rank(m: Column) -> Column:
    return lookup(m, RANKS, 1)


def magnitude_of_rank(r: Column) -> Column:
    return lookup(r, {v: k for k, v in RANKS.items()}, "LOW")


def magnitude_for_move(pct: Column) -> Column:
    return F.when(pct <= 0.7, "LOW").when(pct <= 2.0, "MEDIUM").when(pct <= 5.0, "HIGH").otherwise("EXTREME")


def range_low(low: Column, high: Column, magnitude: Column) -> Column:
    """Lower end of a forecast: the band without numbers, a single number widened to the band's start, else the smaller size."""
    one = F.abs(F.coalesce(low, high))
    return F.when(low.isNull() & high.isNull(), band_low(magnitude)).when(low.isNull() | high.isNull(), F.least(one, band_low(magnitude))).otherwise(F.least(F.abs(low), F.abs(high)))


def range_high(low: Column, high: Column, magnitude: Column) -> Column:
    one = F.abs(F.coalesce(low, high))
    return F.when(low.isNull() & high.isNull(), band_high(magnitude)).when(low.isNull() | high.isNull(), F.greatest(one, band_low(magnitude))).otherwise(F.greatest(F.abs(low), F.abs(high)))


def snap_horizon(minutes: Column) -> Column:
    """Nearest horizon, the smaller on ties; 180 without an answer."""
    return F.when(minutes.isNull(), 180).when(minutes <= 37.5, 15).when(minutes <= 120, 60).when(minutes <= 270, 180).when(minutes <= 900, 360).otherwise(1440)


# ---------------------------------------------------------------- assets
def normalize_ticker(c: Column) -> Column:
    """A ticker, or '' for prose and categories."""
    text = F.upper(_strip(F.coalesce(c, F.lit(""))))
    text = _sub(F.substring_index(F.substring_index(text, "/", 1), "-", 1), "[^A-Z0-9]")
    return F.when(text.rlike("^[A-Z][A-Z0-9]{1,9}$") & ~text.isin(NOT_TICKERS), text).otherwise(F.lit(""))


def normalise_asset(c: Column) -> Column:
    """An exchange symbol."""
    text = F.replace(F.upper(_strip(F.coalesce(c, F.lit("")))), F.lit("$"), F.lit(""))
    text = _strip(F.substring_index(F.substring_index(text, "/", 1), "-", 1))
    return F.coalesce(lookup(text, ASSET_NAMES), text)


def is_priceable(c: Column) -> Column:
    base = normalise_asset(c)
    return (base != "") & (F.length(base) <= 12) & ~base.isin(UNPRICEABLE + PEGGED)


# ---------------------------------------------------------------- state and scores
def status_rank(c: Column) -> Column:
    word = F.lower(_strip(F.coalesce(c, F.lit(""))))
    return reduce(lambda out, kv: F.when(word.isin(kv[1]), kv[0]).otherwise(out), STATUSES.items(), F.lit(0))


def numeric_changed(old: Column, new: Column) -> Column:
    """A figure that appears or goes, or moves by more than the tolerance of the larger one."""
    moved = F.abs(new - old) / F.greatest(F.abs(old), F.abs(new)) > NUMERIC_TOLERANCE
    return F.when(old.isNull() & new.isNull(), False).when(old.isNull() | new.isNull(), True).when(old == new, False).otherwise(moved)


def pct_change(base: Column, price: Column) -> Column:
    return F.when(base > 0, (price - base) / base * 100).otherwise(F.lit(0.0))


def expected_low(low: Column, high: Column, direction: Column) -> Column:
    small, large = F.least(F.abs(low), F.abs(high)), F.greatest(F.abs(low), F.abs(high))
    return F.when(direction == "BULLISH", small).otherwise(-large)


def expected_high(low: Column, high: Column, direction: Column) -> Column:
    small, large = F.least(F.abs(low), F.abs(high)), F.greatest(F.abs(low), F.abs(high))
    return F.when(direction == "BEARISH", -small).otherwise(large)


def direction_of(pct: Column, deadband: float = DEADBAND) -> Column:
    return F.when(pct > deadband, "BULLISH").when(pct < -deadband, "BEARISH").otherwise("NEUTRAL")


def magnitude_error(pct: Column, low: Column, high: Column) -> Column:
    return F.when(pct.between(low, high), F.lit(0.0)).otherwise(F.least(F.abs(pct - low), F.abs(pct - high)))


def combined_score(correct: Column, error: Column, low: Column, high: Column) -> Column:
    """Direction is .65 of the score; a wrong one is worth .175 at most."""
    wide = F.abs(high - low)
    right = 0.65 + 0.35 * F.greatest(F.lit(0.0), 1 - error / (F.greatest(F.lit(0.5), wide, F.abs(high) * 0.5) * 2))
    wrong = 0.175 * F.greatest(F.lit(0.0), 1 - error / (F.greatest(F.lit(1.0), wide, F.abs(high)) * 3))
    return F.bround(F.when(correct, right).otherwise(wrong), 4)


def signed_midpoint(low: Column, high: Column, direction: Column) -> Column:
    sign = F.when(direction == "BULLISH", 1.0).when(direction == "BEARISH", -1.0).otherwise(0.0)
    return (F.abs(low) + F.abs(high)) / 2 * sign


def priority(low: Column, high: Column, confidence: Column, score: Column) -> Column:
    return (F.abs(low) + F.abs(high)) / 2 * F.greatest(confidence, F.lit(0.1)) + F.coalesce(score, F.lit(0.0)) / 100


def alert_score(score: Column, low: Column, high: Column, confidence: Column, source: Column, direction: Column, tradeable: Column, models: Column) -> Column:
    """0..100 from significance, size, confidence and depth, less for neutral, mixed, untradeable and unanswered verdicts."""
    significance = F.coalesce(F.when(score != 0, score), F.lit(40.0))
    size = F.least((F.abs(low) + F.abs(high)) / 2, F.lit(8.0)) / 8
    depth = F.when(source == "stage5", 0.06).when(source == "final", 0.12).otherwise(0.0)
    raw = 0.40 * significance / 100 + 0.35 * size + 0.25 * confidence + depth
    raw = raw * F.when(direction == "NEUTRAL", 0.35).when(direction == "MIXED", 0.75).otherwise(1.0)
    raw = raw * F.when(F.coalesce(tradeable, F.lit(True)), 1.0).otherwise(0.6) * F.when(models == 0, 0.4).otherwise(1.0)
    return half_even(F.least(F.lit(100.0), raw * 100), 1)


def urgency_of(score: Column, magnitude: Column) -> Column:
    return F.when((score >= 85) | (magnitude == "EXTREME"), "critical").when((score >= 70) | (magnitude == "HIGH"), "high").when(score >= 55, "medium").otherwise("low")


def damp_confidence(confidence: Column, agreement: Column, link: Column, relation: Column) -> Column:
    """Confidence less for a split panel, an unsure link and an indirect one."""
    damped = confidence * clamp(agreement, 0.4, 1.0) * clamp(0.6 + 0.4 * link, 0.6, 1.0) * F.when(relation == "INDIRECT", 0.85).otherwise(1.0)
    return half_even(clamp(damped, 0.0, 1.0), 3)


def candle_midpoint(high: Column, low: Column) -> Column:
    return (high + low) / 2


def move_since(base: Column, price: Column) -> Column:
    return pct_change(base, price)


# ---------------------------------------------------------------- vectors
def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty, zero and unequally long vectors; within -1..1."""
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm(a) > 0) & (norm(b) > 0)
    return F.when(usable, clamp(dot(a, b) / (norm(a) * norm(b)), -1.0, 1.0)).otherwise(F.lit(0.0))


def unit(a: Column) -> Column:
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: x.cast("double") / length)).otherwise(F.transform(a, lambda x: x.cast("double")))
