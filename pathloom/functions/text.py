"""Column functions on names and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_name(name: Column) -> Column:
    """Trimmed, lower case, ``-`` as ``_``; an empty name is null."""
    return F.nullif(F.translate(F.lower(F.btrim(name, F.lit(" \t\r\n"))), "-", "_"), F.lit(""))


def identifier_tokens(text: Column) -> Column:
    """ASCII words of identifiers, paths and camel case, in lower case, in order."""
    spaced = F.regexp_replace(F.translate(text, "_", " "), "(?<=[a-z0-9])(?=[A-Z])", " ")
    return F.transform(F.regexp_extract_all(spaced, F.lit("[a-zA-Z][a-zA-Z0-9]*"), 0), lambda t: F.lower(t))


def slug(text: Column) -> Column:
    """Lower case words joined by ``-``."""
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def snake(text: Column) -> Column:
    return F.array_join(identifier_tokens(text), "_")


def camel(text: Column) -> Column:
    words = identifier_tokens(text)
    return F.array_join(F.transform(words, lambda w, i: F.when(i == 0, w).otherwise(F.initcap(w))), "")


def token_estimate(text: Column) -> Column:
    """Characters over four, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def test_name(node: Column) -> Column:
    """The bare name of a test: what is behind the last ``::`` and before ``[``."""
    return F.substring_index(F.element_at(F.split(node, "::"), -1), "[", 1)
