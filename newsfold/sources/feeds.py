"""Feed payloads to articles, and the rules of one ingest pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import _strip, clean_text, clean_title, looks_like_prose

#: Tags by meaning, in order of preference. Fixed values.
BODY_TAGS = ["encoded", "content", "description", "summary", "body"]
DATE_TAGS = ["pubdate", "published", "updated", "date", "created"]
MOST_PER_FEED, MAX_AGE_HOURS = 40, 24
DATE_FORMATS = [
    "EEE, d MMM yyyy HH:mm:ss Z", "EEE, d MMM yyyy HH:mm:ss z", "EEE, d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd",
]


def parse_feed_date(c: Column) -> Column:
    """RFC 822 or ISO 8601 to a UTC timestamp; without a zone it is UTC; null for anything else."""
    text = F.regexp_replace(F.regexp_replace(_strip(c), r"\s(?:GMT|UTC|UT|Z)\z", " +0000"), r"^([A-Za-z]{3}), (\d) ", "$1, 0$2 ")
    text = F.regexp_replace(text, r"^[A-Za-z]{3}, ", "")  # the day's name says nothing
    text = F.regexp_replace(text, r"^0(\d) ", "$1 ")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS if not f.startswith("EEE")])


def _element(tag: str, body: Column) -> Column:
    """Text of the first element of a local name, markup kept; ''."""
    inner = F.regexp_extract(body, rf"(?is)<(?:\w+:)?{tag}\b[^>]*(?<!/)>(.*?)</(?:\w+:)?{tag}\s*>", 1)
    plain = F.regexp_replace(inner, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    return _strip(F.when(F.contains(inner, F.lit("<![CDATA[")), plain).otherwise(_unescape_once(inner)))


def _unescape_once(c: Column) -> Column:
    pairs = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def _is_url(c: Column) -> Column:
    return c.rlike("^https?://")


def feed_articles(feed_docs: DataFrame, body_chars: int = 6000) -> DataFrame:
    """Items of RSS 2.0, Atom and RDF payloads ``(feed_url, payload, fetched_at)``, in document order.

    Local tag names count, whatever their prefix. Items without a title go; the body is the longest of the body
    tags that reads as prose; the link is an alternate ``href``, else a URL as text, else any ``href``, else a URL-like id.
    Malformed payloads give the items that can be read.
    """
    clean = F.regexp_replace(F.col("payload").cast("string"), "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", "")
    blocks = F.regexp_extract_all(clean, F.lit(r"(?is)<(?:\w+:)?(?:item|entry)\b[^>]*>(.*?)</(?:\w+:)?(?:item|entry)\s*>"), F.lit(1))
    head = F.regexp_extract(clean, r"(?is)^(.*?)(?:<(?:\w+:)?(?:item|entry)\b|\z)", 1)
    # what a payload gives is taken before it is cut into items, which then don't carry it
    cut = feed_docs.select("feed_url", "fetched_at", clean_title(_element("title", head)).alias("channel"), blocks.alias("blocks"))
    rows = cut.select("feed_url", "fetched_at", "channel", F.posexplode_outer("blocks").alias("pos", "block")).where("block is not null")
    block = F.col("block")
    rows = rows.withColumns({f"_{tag}": _element(tag, block) for tag in BODY_TAGS})
    rows = rows.withColumns({f"_{tag}": clean_text(F.col(f"_{tag}"), body_chars) for tag in BODY_TAGS})
    longest = F.aggregate(F.array(*[f"_{tag}" for tag in BODY_TAGS]), F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    rows = rows.withColumn("_body", longest).withColumns({f"_date_{tag}": _element(tag, block) for tag in DATE_TAGS})
    tags = F.regexp_extract_all(block, F.lit(r"(?i)(<(?:\w+:)?link\b[^>]*>)"), F.lit(1))
    href = lambda t: _unescape_once(F.regexp_extract(t, r"""(?i)\bhref\s*=\s*["']([^"']*)["']""", 1))
    rel = lambda t: F.lower(F.regexp_extract(t, r"""(?i)\brel\s*=\s*["']([^"']*)["']""", 1))
    linked = F.filter(tags, lambda t: href(t) != "")
    alternate = F.get(F.filter(linked, lambda t: rel(t).isin("", "alternate")), F.lit(0))
    text_link = _element("link", block)
    ids = F.coalesce(*[F.when(_is_url(_element(t, block)), _element(t, block)) for t in ("guid", "id")], F.lit(""))
    url = F.coalesce(href(alternate), F.when(_is_url(text_link), text_link), href(F.get(linked, F.lit(0))), ids)
    date = F.coalesce(*[F.when(F.col(f"_date_{t}") != "", F.col(f"_date_{t}")) for t in DATE_TAGS])
    out = rows.select(
        "feed_url", "fetched_at", "pos", clean_title(_element("title", block)).alias("title"), F.when(looks_like_prose(F.col("_body")), F.col("_body")).otherwise("").alias("body"), url.alias("url"),
        F.substring(F.when(F.col("channel") != "", F.col("channel")).otherwise(F.regexp_extract("feed_url", "^[a-z]+://([^/]*)", 1)), 1, 120).alias("source"), parse_feed_date(date).alias("published_at"),
    )
    return out.where("title <> ''")


def freshness(df: DataFrame, as_of: Column, hours: int = MAX_AGE_HOURS, at: str = "published_at") -> DataFrame:
    """Drop what is older; times over an hour ahead become ``as_of``; undated rows stay."""
    hour = F.make_dt_interval(F.lit(0), F.lit(1))
    age = F.make_dt_interval(F.lit(0), F.lit(max(1, hours)))
    return df.where(F.col(at).isNull() | (F.col(at) >= as_of - age)).withColumn(at, F.when(F.col(at) > as_of + hour, as_of).otherwise(F.col(at)))


def cap_per_feed(df: DataFrame, most: int = MOST_PER_FEED, feed: str = "feed_url", pos: str = "pos") -> DataFrame:
    """The first rows of each feed in document order, cut by (feed, hash) first, so that no feed is sorted whole in one task."""
    part = F.pmod(F.xxhash64(pos), F.lit(64))
    few = df.withColumn("_r", F.row_number().over(W.partitionBy(feed, part).orderBy(pos))).where(F.col("_r") <= most)
    return few.withColumn("_r", F.row_number().over(W.partitionBy(feed).orderBy(pos))).where(F.col("_r") <= most).drop("_r")


def ingest_stats(fetches: DataFrame, delivered: DataFrame) -> DataFrame:
    """Counts of one pass by feed: fetched, skipped, deduplicated and delivered items, and whether it answered."""
    got = delivered.groupBy("feed_url").agg(F.count("*").alias("delivered"))
    out = fetches.groupBy("feed_url").agg(F.max("ok").alias("ok"), F.sum("items").alias("fetched"), F.sum("skipped").alias("skipped"))
    out = out.join(got, "feed_url", "left").withColumn("delivered", F.coalesce("delivered", F.lit(0)))
    return out.withColumn("deduplicated", F.col("fetched") - F.col("skipped") - F.col("delivered"))


def pass_report(fetches: DataFrame, items: DataFrame, by: str = "pass") -> DataFrame:
    """One row a pass of the collector: feeds that answered, failed or hadn't changed, their errors, and items fetched, skipped, dropped as repeats and delivered.

    ``fetches(pass, feed_url, ok, not_modified, error, items, skipped)``, one row a feed; a feed that hasn't changed counts as neither answered nor failed.
    ``items(pass, delivered)``, one row an item that was parsed and not skipped.
    """
    same = F.coalesce("not_modified", F.lit(False))
    good = ~same & F.coalesce("ok", F.lit(False))
    number = lambda c: F.coalesce(F.sum(F.when(good, F.col(c))), F.lit(0)).cast("long").alias(c)
    feeds = fetches.groupBy(by).agg(
        F.count("*").alias("feeds"), F.count_if(good).alias("feeds_ok"), F.count_if(~same & ~F.coalesce("ok", F.lit(False))).alias("feeds_failed"), F.count_if(same).alias("not_modified"),
        F.count_if(F.coalesce("error", F.lit("")) != "").alias("errors"), number("items").alias("fetched"), number("skipped"),
    )
    got = items.groupBy(by).agg(F.count_if("delivered").alias("delivered"), F.count_if(~F.coalesce("delivered", F.lit(False))).alias("deduplicated"))
    return feeds.join(got, by, "left").fillna(0, ["delivered", "deduplicated"])


def union_sources(*frames: DataFrame) -> DataFrame:
    """Rows of all sources, with the columns of all."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
