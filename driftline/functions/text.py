"""Scalars over identifiers and JSON in text, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What an identifier looks like, and its longest length.
IDENTIFIER, LONGEST = "^[a-z][a-z0-9_]*$", 64


def slug(name: Column) -> Column:
    """name as an identifier: lower case, runs of other characters one underscore, an item_ before what begins with no letter."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.left(F.when(bare.rlike("^[a-z]"), bare).otherwise(F.concat(F.lit("item_"), bare)), F.lit(LONGEST))


def is_identifier(name: Column) -> Column:
    return name.rlike(IDENTIFIER) & (F.length(name) <= LONGEST)


def json_object(text: Column) -> Column:
    """The JSON object in text, from its first brace to its last, fenced or not; null where there is none."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


def forbidden(text: Column, words: list[str]) -> Column:
    """Those of words that text holds, whatever its case, in order."""
    low = F.lower(text)
    return F.filter(F.array(*[F.lit(w) for w in sorted(words)]), lambda w: F.contains(low, w))


def has_word(text: Column, words: list[str]) -> Column:
    return F.lower(text).rlike("|".join(map(re.escape, sorted(words))))
