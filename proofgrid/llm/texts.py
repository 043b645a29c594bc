"""Text expressions that several operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase


def whole(text: Column) -> Column:
    """The text; null reads as the empty text."""
    return F.coalesce(text.cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else. `lower` is much faster and agrees on pure ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def sha256_hex(text: Column) -> Column:
    """Lower-case hex of SHA-256 over the text's UTF-8."""
    return F.sha2(text.cast("binary"), 256)


def joined(parts: Column) -> Column:
    """An array of texts with commas between."""
    return F.array_join(parts, ",")
