"""Content hashes and identity keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _strip, _sub, canonical_url, norm_token, normalize_for_hash, normalize_title


def exact_hash(title: Column, body: Column) -> Column:
    """Of the raw text with white space collapsed."""
    both = F.concat(_strip(F.coalesce(title, F.lit(""))), F.lit("\n"), _strip(F.coalesce(body, F.lit(""))))
    return F.sha2(_strip(_sub(both, r"(?U)\s+", " ")), 256)


def norm_hash(title: Column, body: Column) -> Column:
    return F.sha2(F.concat(normalize_title(title), F.lit("\n"), normalize_for_hash(body)), 256)


def title_hash(title: Column) -> Column:
    return F.sha2(normalize_title(title), 256)


def url_hash(url: Column) -> Column:
    """Of the canonical URL; '' without one."""
    return F.when(F.coalesce(url, F.lit("")) == "", F.lit("")).otherwise(F.sha2(canonical_url(url), 256))


def identity_key(event_type: Column, entity: Column, asset: Column, action: Column, target: Column) -> Column:
    """First half of the hash over the five identity tokens."""
    tokens = F.concat_ws("|", *[norm_token(c) for c in (event_type, entity, asset, action, target)])
    return F.substring(F.sha2(tokens, 256), 1, 32)


def claims_state(claims: Column) -> Column:
    """Sorted distinct claim tokens."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(claims, lambda x: F.coalesce(x, F.lit("")) != ""), norm_token)))


def state_fields(facts: Column) -> Column:
    """What later articles may change of a fact struct, as ten comparable fields: texts as tokens, numbers as they are, claims sorted and distinct."""
    token = lambda n: norm_token(F.coalesce(facts[n], F.lit(""))).alias(n)
    numbers = [facts[n].alias(n) for n in ("amount", "price", "percentage", "count")]
    claims = claims_state(F.coalesce(facts["key_claims"], F.array().cast("array<string>"))).alias("key_claims")
    return F.struct(token("status"), token("decision"), *numbers, token("location"), token("time_reference"), token("event_date"), claims)
