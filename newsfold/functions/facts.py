"""Rule-based facts of an article: assets, amounts, event type, actor, verb."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import _strip
from .values import lookup

# ---------------------------------------------------------------- fixed values
#: Tickers and the names that mention them. Fixed values.
KNOWN_ASSETS = {
    "BTC": ["bitcoin", "btc", "xbt"], "ETH": ["ethereum", "eth", "ether"], "SOL": ["solana", "sol"], "XRP": ["xrp", "ripple"],
    "BNB": ["bnb", "binance coin"], "ADA": ["cardano", "ada"], "DOGE": ["dogecoin", "doge"], "AVAX": ["avalanche", "avax"],
    "LINK": ["chainlink", "link"], "DOT": ["polkadot", "dot"], "MATIC": ["polygon", "matic"], "TRX": ["tron", "trx"], "LTC": ["litecoin", "ltc"],
    "SHIB": ["shiba inu", "shib"], "TON": ["toncoin", "ton"], "SUI": ["sui"], "APT": ["aptos", "apt"], "ARB": ["arbitrum", "arb"], "OP": ["optimism"],
    "USDT": ["tether", "usdt"], "USDC": ["usdc", "circle"],
}
#: Event types by the first pattern that a text holds; else OTHER. Fixed values.
EVENT_TYPES = [
    (r"\betf\b.*\b(inflow|outflow|flows?)\b|\b(inflow|outflow)s?\b.*\betf\b", "ETF_FLOWS"),
    (r"\betf\b.*\b(approv|reject|deni|deadline|filing|list)", "ETF_APPROVAL"),
    (r"\b(hack|exploit|breach|drain|stolen|steal)", "EXCHANGE_HACK"),
    (r"\b(sue|sued|lawsuit|court|judge|settle|settlement)", "LAWSUIT"),
    (r"\b(sec|cftc|regulator|regulation|regulatory|mica|ban|legislat|bill)\b", "REGULATORY"),
    (r"\b(charge|indict|enforce|fine|penalt|seiz|sanction)", "ENFORCEMENT"),
    (r"\b(bankrupt|insolven|chapter 11|liquidat.*(firm|company))", "BANKRUPTCY"),
    (r"\bliquidat(ed|ion)s?\b", "LIQUIDATION"),
    (r"\b(list|listing)\b.*\b(exchange|coinbase|binance|upbit)", "LISTING"),
    (r"\bdelist", "DELISTING"),
    (r"\b(partner|collaborat|integrat)", "PARTNERSHIP"),
    (r"\b(raise[sd]?|funding|series [a-d]|seed round|valuation)\b", "FUNDING"),
    (r"\b(acquir|merger|buyout|takeover)", "ACQUISITION"),
    (r"\b(upgrade|hard fork|mainnet|testnet|halving)\b", "NETWORK_UPGRADE"),
    (r"\b(outage|downtime|halted|suspend)", "OUTAGE"),
    (r"\b(whale|moved|transferred)\b.*\b(btc|eth|million|billion)", "WHALE_MOVEMENT"),
    (r"\b(treasury|buys?|bought|purchase[sd]?|adds?)\b.*\b(bitcoin|btc|eth)\b", "TREASURY_PURCHASE"),
    (r"\b(fed|fomc|interest rate|cpi|inflation|jobs report|tariff)", "MACRO"),
    (r"\b(adopt|legal tender|accept.*payment)", "ADOPTION"),
    (r"\b(ceo|cfo|resign|step down|appoint|hire)", "PERSONNEL"),
    (r"\b(surge|plunge|rally|crash|drop|soar|dip|price)\b", "PRICE_ACTION"),
]
#: Verbs that headlines report. Fixed values.
VERBS = (
    r"\b(approv\w*|reject\w*|deni\w*|sue[sd]?|sued|charg\w*|fil\w*|launch\w*|list\w*|delist\w*|hack\w*|exploit\w*|buy[s]?|bought|sell[s]?|sold|rais\w*|acquir\w*"
    r"|partner\w*|halt\w*|suspend\w*|resign\w*|announc\w*|report\w*|surge[sd]?|plunge[sd]?|jump\w*|drop\w*|crash\w*|rall\w*|add[s]?|added|move[sd]?"
    r"|transfer\w*|upgrad\w*|ban[s|ned]*|fine[sd]?|settl\w*|warn\w*|propos\w*)\b"
)
AMOUNT = r"(?i)\$\s?([\d,]+(?:\.\d+)?)\s*(trillion|billion|million|thousand|[tbmk])?\b"
UNITS = {"trillion": 1e12, "t": 1e12, "billion": 1e9, "b": 1e9, "million": 1e6, "m": 1e6, "thousand": 1e3, "k": 1e3}
OPENERS = ["the", "a", "an", "this", "these", "new", "why", "how"]


def detect_assets(c: Column, most: int = 6) -> Column:
    """Tickers by first mention, then name."""
    low = F.lower(F.coalesce(c, F.lit("")))
    place = lambda names: F.regexp_instr(low, F.lit(r"(?U)\b(?:" + "|".join(names) + r")\b"))
    each = F.array(*[F.struct(place(names).alias("at"), F.lit(ticker).alias("ticker")) for ticker, names in KNOWN_ASSETS.items()])
    return F.transform(F.slice(F.array_sort(F.filter(each, lambda x: x["at"] > 0)), 1, most), lambda x: x["ticker"])


def detect_amount(c: Column) -> Column:
    """The first dollar amount, in dollars."""
    number = F.replace(F.regexp_extract(c, AMOUNT, 1), F.lit(","), F.lit(""))
    return F.when(number.rlike(r"^\d"), number.cast("double") * lookup(F.lower(F.regexp_extract(c, AMOUNT, 2)), UNITS, 1.0))


def detect_percentage(c: Column) -> Column:
    found = F.regexp_extract(c, r"(\d+(?:\.\d+)?)\s?%", 1)
    return F.when(found != "", found.cast("double"))


def detect_event_type(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return reduce(lambda out, kv: F.when(low.rlike("(?U)" + kv[0]), F.lit(kv[1])).otherwise(out), reversed(EVENT_TYPES), F.lit("OTHER"))


def leading_noun(c: Column) -> Column:
    """The first run of up to three capitalised words that is no mere opener."""
    runs = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\b([A-Z][A-Za-z0-9&.\-]*(?:\s+[A-Z][A-Za-z0-9&.\-]*){0,2})"), F.lit(1))
    return F.coalesce(F.substring(F.get(F.filter(runs, lambda x: ~F.lower(x).isin(OPENERS)), F.lit(0)), 1, 80), F.lit(""))


def leading_verb(c: Column) -> Column:
    return F.upper(F.regexp_extract(F.coalesce(c, F.lit("")), "(?iU)" + VERBS, 1))


def dedupe_upper(values: Column, most: int = 6) -> Column:
    return F.slice(F.array_distinct(F.filter(F.transform(values, lambda x: F.upper(_strip(x))), lambda x: x != "")), 1, most)


def heuristic_facts(title: Column, text: Column) -> Column:
    """All of the above as one struct of the sixteen fact fields; what a text doesn't tell by itself is blank or null."""
    head = _strip(F.coalesce(title, F.lit("")))
    short = F.substring(head, 1, 200)
    return F.struct(
        detect_event_type(text).alias("event_type"), leading_noun(head).alias("entity"), detect_assets(text).alias("assets"), leading_verb(head).alias("action"),
        F.lit("").alias("target"), F.lit("REPORTED").alias("status"), F.lit("").alias("decision"),
        F.coalesce(F.when(detect_amount(head) != 0, detect_amount(head)), detect_amount(F.substring(text, 1, 1200))).alias("amount"), F.lit(None).cast("double").alias("price"),
        detect_percentage(head).alias("percentage"), F.lit(None).cast("double").alias("count"), *[F.lit("").alias(n) for n in ("location", "time_reference", "event_date")], F.when(short != "", F.array(short)).otherwise(F.array().cast("array<string>")).alias("key_claims"), short.alias("headline"),
    )


def repair_facts(facts: Column, title: Column, text: Column) -> Column:
    """An extracted fact struct of sixteen fields whose missing assets, amount, percentage, type, status and headline come from the text; the others stay as extracted."""
    found = heuristic_facts(title, text)
    pick = lambda k: F.when(F.coalesce(facts[k], F.lit("")) != "", facts[k]).otherwise(found[k])
    assets = F.when(F.coalesce(F.size(facts["assets"]), F.lit(0)) > 0, facts["assets"]).otherwise(found["assets"])
    return F.struct(
        F.when(F.coalesce(facts["event_type"], F.lit("")).isin("", "OTHER"), found["event_type"]).otherwise(facts["event_type"]).alias("event_type"),
        facts["entity"].alias("entity"), dedupe_upper(assets).alias("assets"), facts["action"].alias("action"), facts["target"].alias("target"), pick("status").alias("status"), facts["decision"].alias("decision"),
        F.coalesce(facts["amount"], found["amount"]).alias("amount"), facts["price"].alias("price"), F.coalesce(facts["percentage"], found["percentage"]).alias("percentage"),
        *[facts[n].alias(n) for n in ("count", "location", "time_reference", "event_date")], facts["key_claims"].alias("key_claims"), pick("headline").alias("headline"),
    )


def choose_facts(articles: DataFrame, answers: DataFrame, id_col: str = "id") -> DataFrame:
    """Add ``facts`` and ``origin`` to ``articles(id, title, text, …)``.

    ``answers(id, extractor, priority, facts)``: the repaired facts of the first answer, by priority,
    that names an entity or asset; without one, the heuristic facts, with origin ``heuristic``.
    """
    usable = (F.coalesce(F.col("facts.entity"), F.lit("")) != "") | (F.coalesce(F.size("facts.assets"), F.lit(0)) > 0)
    first = answers.where(usable).groupBy(id_col).agg(F.min_by(F.struct("extractor", "facts"), F.struct("priority", "extractor")).alias("_best"))
    rows = articles.join(first, id_col, "left")
    repaired, guessed = repair_facts(F.col("_best.facts"), F.col("title"), F.col("text")), heuristic_facts(F.col("title"), F.col("text"))
    return rows.withColumns({"facts": F.when(F.col("_best").isNotNull(), repaired).otherwise(guessed), "origin": F.coalesce("_best.extractor", F.lit("heuristic"))}).drop("_best")
