"""Site names: substring and fuzzy matching, slugs, keys."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a token is, and the similarity from which two tokens match.
TOKEN, RATIO = re.compile("[a-z0-9]+"), 0.8


def contains(column: Column, text: str) -> Column:
    """A literal substring in any case; null never matches."""
    return F.lower(column).contains(text.lower())


def token_match(query: str, token: str) -> bool:
    return query in token or SequenceMatcher(None, query, token).ratio() >= RATIO


def fuzzy_match(query: str, name: str) -> bool:
    """The substring, or every token of the query matches some token of the name.  Asymmetric: the name's may be longer."""
    if query.lower() in name.lower():
        return True
    wanted, there = TOKEN.findall(query.lower()), TOKEN.findall(name.lower())
    return bool(wanted and there) and all(any(token_match(q, t) for t in there) for q in wanted)


def fuzzy(column: Column, query: str) -> Column:
    """fuzzy_match as a vectorised function; apply it to distinct names."""

    @F.pandas_udf("boolean")
    def match(names: pd.Series) -> pd.Series:
        return pd.Series([n is not None and fuzzy_match(query, n) for n in names], dtype=bool)

    return match(column)


def slug(column: Column, fallback: str = "item") -> Column:
    text = F.regexp_replace(F.regexp_replace(column, "[^A-Za-z0-9._-]+", "-"), "^-+|-+$", "")
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(fallback)).otherwise(text)


def content_key(*parts: Column, length: int = 64) -> Column:
    """sha256 over JSON of sorted name-value pairs, cut to so many hex digits."""
    return F.substring(F.sha2(F.to_json(F.array_sort(F.array(*parts))), 256), 1, length)
