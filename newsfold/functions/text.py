"""Text, HTML and URL expressions.

Built-in functions throughout; the two things that Spark has no function for, full
HTML entity tables and NFKC, are Arrow functions that receive null (and so cost little) for
rows that don't need them.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------- fixed values
#: Characters that normalisation keeps besides letters, digits and spaces. Fixed values.
KEPT = "$%+-?!."
#: Glyphs folded one to one. Fixed values.
FOLDED = {
    "‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"', "‟": '"',
    "«": '"', "»": '"', "‹": "'", "›": "'", "′": "'", "″": '"',
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "−": "-",
    " ": " ", " ": " ", " ": " ", " ": " ", " ": " ", " ": " ", " ": " ", " ": " ",
    " ": " ", " ": " ", " ": " ", " ": " ", " ": " ", " ": " ", "　": " ",
    "•": " ", "·": " ", "⁃": " ", "＄": "$", "％": "%", "＋": "+", "！": "!", "？": "?", "．": ".",
}
#: Zero-width and directional marks. Fixed values.
INVISIBLE = r"[​-‏‪-‮⁠-⁤﻿­]"
#: Entities that the hash form decodes. Fixed values.
ENTITIES = {
    "&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " ", "&#39;": "'", "&#039;": "'", "&#x27;": "'",
    "&rsquo;": "'", "&lsquo;": "'", "&ldquo;": '"', "&rdquo;": '"', "&mdash;": "-", "&ndash;": "-", "&hellip;": "...", "&bull;": " ",
    "&#8217;": "'", "&#8216;": "'", "&#8220;": '"', "&#8221;": '"', "&#8212;": "-",
}
#: Characters that are white space.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Query parameters that name the referrer. Fixed values.
TRACKING = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "utm_name", "utm_reader", "utm_brand", "utm_social",
    "utm_social-type", "utm_place", "utm_pubreferrer", "utm_swu", "gclid", "dclid", "gbraid", "wbraid", "fbclid", "msclkid", "twclid",
    "igshid", "mc_cid", "mc_eid", "yclid", "_hsenc", "_hsmi", "vero_id", "vero_conv", "ref", "ref_src", "ref_url", "source", "referrer",
    "spm", "scid", "cmpid", "campaign_id", "amp", "at_medium", "at_campaign", "s_kwcid", "ito", "ncid", "cid", "sr_share",
    "__twitter_impression", "guccounter", "guce_referrer", "guce_referrer_sig", "feature", "share",
]
#: Lines that syndication adds, for the hash form. Fixed values.
ADDED_LINE = (
    r"(?Uim)^\s*(?:disclaimer\s*:|advertisement\s*$|sponsored(?:\s+content)?\s*$|read\s+more\s*:|related\s+(?:reading|articles?|stories)\s*:"
    r"|(?:this\s+)?article\s+(?:was\s+)?originally\s+(?:published|appeared)|follow\s+us\s+on\s+(?:twitter|x|telegram|google\s+news)"
    r"|subscribe\s+to\s+our\s+newsletter|share\s+this\s+article|the\s+views?\s+(?:and\s+opinions?\s+)?expressed\s+(?:here|in\s+this)).*$"
)
#: Promotional endings of feed texts. Fixed values.
ENDINGS = [
    r"(?Uis)\bThe post\b.{0,120}?\bappeared first on\b.{0,80}\z", r"(?Uis)\bThis (?:post|article|story) (?:first )?appeared\b.{0,120}\z",
    r"(?Ui)\bRead more on\b.{0,80}\z", r"(?Ui)\bContinue reading\b.{0,80}\z", r"(?Ui)\bSource:?\s*(?:https?://\S+|\w[\w .]{0,40})\z",
    r"(?Uis)\b(?:Disclaimer|Disclosure)\s*:.{0,400}\z", r"(?Ui)\bClick here to\b.{0,80}\z", r"(?Ui)\bSubscribe to\b.{0,80}\z",
    r"(?Ui)\bFollow us on\b.{0,80}\z", r"(?Ui)\bPhoto(?:\s+by|:).{0,80}\z", r"(?Ui)\b(?:Image|Credit|Photograph)s?:?\s*\S{0,60}\z",
]
#: Whether a text has any of these endings: all begin at the edge of a word, which is looked for once.
ENDING = r"(?U)\b(?:" + "|".join(re.sub(r"^\(\?(\w+)\)\\b(.*)$", r"(?\1:\2)", p) for p in ENDINGS) + ")"
#: Lines of navigation or sharing, in feed texts. Fixed values.
FURNITURE = r"(?Ui)^\s*(share (?:this|on)|tweet|advertisement|sponsored|related:|tags?:|read also|see also|also read|newsletter|sign up)\b.*$"
#: Shapes of provider credentials. Fixed values.
CREDENTIAL = (
    r"(AIza[0-9A-Za-z_\-]{10,}|gsk_[0-9A-Za-z]{10,}|nvapi-[0-9A-Za-z_\-]{10,}|AQ\.[0-9A-Za-z_\-]{10,}|(?<![0-9])\d{8,10}:[A-Za-z0-9_\-]{30,})"
)


# ---------------------------------------------------------------- helpers
def _sub(c: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(c, pattern, to)


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


@F.pandas_udf(T.StringType())
def _unescaped_twice(text: pd.Series) -> pd.Series:
    return text.map(lambda t: html.unescape(html.unescape(t)), na_action="ignore")


@F.pandas_udf(T.StringType())
def _unescaped_numbers(text: pd.Series) -> pd.Series:
    decimal = text.str.replace(r"&#(\d{2,5});", lambda m: chr(int(m[1])), regex=True)
    return decimal.str.replace(r"[\ud800-\udfff]", "�", regex=True)


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


_JOINS = {x for c in range(0x110000) for x in unicodedata.normalize("NFD", chr(c))[1:]}


def _still(first: int, last: int) -> str:
    """The characters between two that NFKC leaves alone wherever they stand, as ranges of a pattern: they have no other form, are no marks, and join no character before them."""
    still = {c for c in range(first, last + 1) if unicodedata.normalize("NFKC", chr(c)) == chr(c) and not unicodedata.combining(chr(c)) and chr(c) not in _JOINS and unicodedata.category(chr(c)) != "Cn"}
    starts, ends = sorted(c for c in still if c - 1 not in still), sorted(c for c in still if c + 1 not in still)
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in zip(starts, ends))


#: Texts in Latin and Cyrillic letters and common punctuation that are their own NFKC form. Runs are possessive: no text makes the pattern go back.
NORMAL = rf"\A(?:[\x00-\x7f]++|[{_still(0x80, 0x17F)}{_still(0x400, 0x45F)}{_still(0x2010, 0x2027)}{_still(0x4E00, 0x9FFF)}\x{{20ac}}]++)*+\z"


def nfkc(c: Column) -> Column:
    """NFKC; rows that are seen to be in that form don't cross to Python."""
    return F.coalesce(_nfkc(F.when(~c.rlike(NORMAL), c)), c)


def round_half_even(c: Column, scale: int = 0) -> Column:
    return F.bround(c, scale)


# ---------------------------------------------------------------- markup
#: References that need no table, and what else may be one. ``&amp;`` is last, so that what it gives isn't read again.
COMMON = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&nbsp;": "\xa0", "&amp;": "&"}
UNCOMMON = rf"&(?!(?:{'|'.join(e[1:] for e in COMMON)}))(?:#[0-9xX]|[^\t\n\f <&#;])"


def _plain_twice(c: Column) -> Column:
    """HTML references decoded twice; rows that have common ones only don't cross to Python."""
    once = lambda x: reduce(lambda y, e: F.replace(y, F.lit(e[0]), F.lit(e[1])), COMMON.items(), x)
    held = F.contains(c, F.lit("&"))
    hard = _unescaped_twice(F.when(held & (c.rlike(UNCOMMON) | once(c).rlike(UNCOMMON)), c))
    return F.coalesce(hard, F.when(held, once(once(c))).otherwise(c))


def strip_html_feed(c: Column) -> Column:
    """Feed markup to text; null gives ''. Blocks of code go, block tags break lines, entities are decoded twice."""
    text = F.coalesce(c, F.lit(""))
    bare = _sub(text, r"(?is)<(script|style|noscript|iframe|figure|figcaption|form)\b.*?</\1\s*>", " ")
    bare = _sub(bare, r"(?i)</?(p|div|br|li|tr|h[1-6]|blockquote|section|article|ul|ol|table)\b[^>]*>", "\n")
    text = _plain_twice(F.when(F.contains(text, F.lit("<")), _sub(bare, r"<[^>]+>", " ")).otherwise(text))
    text = _sub(text, r"[​‌‍﻿]")
    lines = F.transform(F.split(text, "\n"), lambda x: _strip(_sub(x, r"[ \t   ]+", " ")))
    return _strip(F.array_join(F.filter(lines, lambda x: (x != "") & ~x.rlike(FURNITURE)), "\n"))


def strip_html_hash(c: Column) -> Column:
    """Markup to text as the hash form needs it: a fixed set of entities, and decimal references."""
    text = F.coalesce(c, F.lit(""))
    tagged = _sub(text, r"(?is)<(script|style)\b.*?</\1>", " ")
    tagged = _sub(_sub(tagged, r"(?i)<br\s*/?>|</p>|</div>|</li>", "\n"), r"<[^>]+>", " ")
    text = F.when(F.contains(text, F.lit("<")), tagged).otherwise(text)
    coded = F.contains(text, F.lit("&"))  # most rows have none: they skip all that follows
    plain = reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ENTITIES.items(), text)
    numbers = _unescaped_numbers(F.when(coded & plain.rlike(r"&#\d{2,5};"), plain))
    return F.coalesce(numbers, F.when(coded, plain).otherwise(text))


def strip_boilerplate(c: Column) -> Column:
    """Promotional endings, up to three deep, then a URL at the end."""
    def without(text: Column, rounds: int) -> Column:
        if not rounds:
            return text
        off = lambda x: reduce(lambda y, pattern: _strip(_sub(y, pattern)), ENDINGS, x)
        return let(text, lambda x: F.when(x.rlike(ENDING), without(off(x), rounds - 1)).otherwise(x))  # most texts have none, and what has none keeps none

    return _strip(_sub(without(_strip(c), 3), r"(?U)\s*+https?://\S+\s*\z"))


def clean_text(c: Column, limit: int = 6000) -> Column:
    """Markup and boilerplate off; longer texts end at the last sentence mark beyond 60 % of the limit, else at the limit with an ellipsis."""
    def cut(text: Column) -> Column:
        window = F.substring(text, 1, limit)
        out = F.concat(_sub(window, r"(?U)\s+\z"), F.lit("…"))
        for mark in ("\n", "? ", "! ", ". "):  # the first of the marks in the other order that is far enough wins
            at = limit - F.instr(F.reverse(window), mark[::-1]) - len(mark) + 1  # 0-based place of the last mark
            found = (F.instr(window, mark) > 0) & (at > limit * 0.6)
            out = F.when(found, _strip(F.substring(window, F.lit(1), at + 1))).otherwise(out)
        return F.when(F.length(text) <= limit, text).otherwise(out)

    return let(strip_boilerplate(strip_html_feed(c)), cut)


def clean_title(c: Column) -> Column:
    title = _strip(F.replace(strip_html_feed(c), F.lit("\n"), F.lit(" ")))
    title = _sub(title, r"[ \t   ]+", " ")
    return _strip(_sub(title, r"(?U)\s+[|–—]\s+[\w .'&]{2,30}\z"))


def looks_like_prose(c: Column) -> Column:
    """At least 12 characters, half of them letters, and a space inside."""
    letters = F.length(_sub(c, r"[^\p{L}]"))
    return (F.length(c) >= 12) & (letters >= F.length(c) * 0.5) & F.contains(_strip(c), F.lit(" "))


def markup_to_plain(c: Column) -> Column:
    """Message markup to plain text: links as ``text (url)``, other tags off, entities decoded."""
    text = _sub(c, r'<a href="([^"]*)">([^<]*)</a>', "$2 ($1)")
    text = _sub(text, r"<[^>]+>")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


# ---------------------------------------------------------------- normal forms
def unify_punctuation(c: Column) -> Column:
    text = F.translate(_sub(c, INVISIBLE), "".join(FOLDED), "".join(FOLDED.values()))
    return F.replace(text, F.lit("…"), F.lit("..."))


def strip_urls(c: Column) -> Column:
    return _sub(c, r"(?U)https?://\S+|www\.[^\s<>\"]+", " __url__ ")


def normalize_text(c: Column) -> Column:
    """The form that duplicates share: markup, glyphs, links, added lines, case and stray punctuation gone."""
    text = unify_punctuation(strip_html_hash(nfkc(F.coalesce(c, F.lit("")))))
    text = F.lower(_sub(strip_urls(text), ADDED_LINE, " "))
    text = _sub(text, r"(?U)[^a-z -!\w\s$%+\-?!.,:/]+", " ")
    text = _sub(text, r"(?U)(?<=\d),(?=\d{3}\b)")
    text = _sub(text, r"(?U)(?<!\d),|,(?!\d)", " ")
    text = _sub(text, r"[ \t\r\f\x0b]+", " ")
    text = _sub(text, r"\n{3,}", "\n\n")
    return _strip(F.array_join(F.transform(F.split(text, "\n"), _strip), "\n"))


def normalize_for_hash(c: Column) -> Column:
    return _strip(_sub(normalize_text(c), r"(?U)\s+", " "))


def normalize_title(c: Column) -> Column:
    text = F.lower(unify_punctuation(nfkc(strip_html_hash(c))))
    return _strip(_sub(_sub(text, r"(?U)[^a-z -!\w\s$%+\-?!.]+", " "), r"(?U)\s+", " "))


def embedding_text(title: Column, body: Column, limit: int = 4000) -> Column:
    head, rest = normalize_title(title), normalize_for_hash(body)
    return let(F.struct(head.alias("head"), rest.alias("rest")), lambda x: F.substring(F.when(x["rest"] != "", _strip(F.concat(x["head"], F.lit(". "), x["rest"]))).otherwise(x["head"]), 1, limit))


def norm_token(c: Column) -> Column:
    """Fact tokens: lower case, letters, digits and ``$%.+-`` only."""
    kept = _sub(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9$%.+\- ]+", " ")
    return _strip(_sub(kept, r"(?U)\s+", " "))


def article_text(title: Column, body: Column) -> Column:
    head, rest = _strip(F.coalesce(title, F.lit(""))), _strip(F.coalesce(body, F.lit("")))
    return F.when(rest == "", head).when((head == "") | F.startswith(rest, head), rest).otherwise(F.concat(head, F.lit("\n\n"), rest))


def snippet(c: Column, limit: int) -> Column:
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(_sub(F.substring(c, 1, limit), r"(?U)\s+\z"), F.lit("…")))


# ---------------------------------------------------------------- URLs and secrets
def canonical_url(c: Column) -> Column:
    """Without tracking parameters, blank parameters, fragment, ``www.``, default ports, and the end's ``/`` or ``/amp``."""
    def parts_of(url: Column) -> Column:
        part = lambda k: F.regexp_extract(url, r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?", k)
        scheme = F.when(part(1) == "", F.lit("https")).otherwise(F.lower(part(1)))
        host = _sub(F.lower(part(2)), r"^www\.")
        host = F.when(scheme == "http", _sub(host, r":80\z")).when(scheme == "https", _sub(host, r":443\z")).otherwise(host)
        pairs = F.filter(F.split(part(4), "&"), lambda p: p.rlike("^[^=]+=.") & ~F.lower(F.substring_index(p, "=", 1)).isin(TRACKING))
        again = F.transform(pairs, lambda p: F.concat(_form(F.substring_index(p, "=", 1)), F.lit("="), _form(_sub(p, "^[^=]*="))))
        path = _sub(part(3), r"/+\z")
        path = F.when(path == "", F.lit("/")).otherwise(path)
        path = F.when(F.endswith(path, F.lit("/amp")), _sub(path, r"/amp\z")).otherwise(path)
        path = F.when((path == "") | (path == "/"), F.lit("/")).otherwise(path)
        query = F.array_join(again, "&")
        out = F.concat(scheme, F.lit(":"), F.when(host != "", F.concat(F.lit("//"), host)).otherwise(F.lit("")), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
        return F.when(url == "", F.lit("")).otherwise(out)

    return let(_strip(F.coalesce(c, F.lit(""))), parts_of)


def _form(c: Column) -> Column:
    """One side of a parameter, decoded and encoded again as forms are."""
    return _sub(F.url_encode(F.coalesce(F.try_url_decode(c), c)), r"%7E", "~")


def redact(c: Column) -> Column:
    """Every credential as its head, an ellipsis and the last four characters."""
    found = F.regexp_extract_all(c, F.lit(CREDENTIAL), F.lit(1))
    return F.aggregate(
        F.array_distinct(found), c,
        lambda text, s: F.replace(text, s, F.concat(F.substring(s, 1, 6), F.lit("…"), F.substring(s, -4, 4), F.lit("#"), F.substring(F.sha2(s, 256), 1, 4))),
    )
