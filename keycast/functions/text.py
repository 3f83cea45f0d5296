"""Small text expressions used by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_key(raw: Column) -> Column:
    """Path-safe form of a key: unsafe runs and dot runs become one underscore."""
    cleaned = F.regexp_replace(F.regexp_replace(raw, r"[^A-Za-z0-9_.-]+", "_"), r"\.{2,}", "_")
    trimmed = F.btrim(cleaned, F.lit("_."))
    return F.when(trimmed == "", F.lit("key")).otherwise(trimmed)


# All Unicode whitespace, in a form Java and RE2 expressions share.
SPACE = r"[\s\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def words(text: Column) -> Column:
    """Whitespace-separated words; an empty text has none."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


# The characters of SPACE one by one.
SPACES = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without whitespace at its ends; only the ends are read."""
    return F.btrim(text, F.lit(SPACES))


def sentences(text: Column) -> Column:
    """Trimmed, non-empty sentences, cut at whitespace after . ! or ?"""
    parts = F.split(text, rf"(?<=[.!?]){SPACE}+")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def cap_words(text: Column, limit: int) -> Column:
    """At most `limit` words; a cut text loses trailing punctuation and gains an ellipsis."""
    parts = words(F.coalesce(text, F.lit("")))
    cut = F.concat(F.regexp_replace(F.array_join(F.slice(parts, 1, limit), " "), r"[,;:]+$", ""), F.lit("…"))
    return F.when(F.size(parts) <= limit, F.array_join(parts, " ")).otherwise(cut)


def key_label(key_values: Column) -> Column:
    """`k=v · k=v` from a map of key values."""
    pairs = F.transform(F.map_entries(key_values), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.array_join(pairs, " · ")
