"""Small column helpers: hosts, redaction, identifiers, techniques."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofgrid.functions.fields import EventFields
from proofgrid.functions.literals import java_quote

# The keys that may name a host, in order, and the redaction mark.
HOST_KEYS = ("_host", "Computer", "host", "hostname")
REDACTED = "[redacted]"


def host_of(fields: EventFields, keys: Sequence[str] = HOST_KEYS) -> Column:
    """First host key with a value, NULL without one."""
    return F.coalesce(*[F.nullif(fields.locate(k).text, F.lit("")) for k in keys])


def base_technique(technique: Column) -> Column:
    return F.split_part(technique, F.lit("."), F.lit(1))


def redact(document: Column, terms: Sequence[str]) -> Column:
    """A map with every value hidden whose key contains one of the terms, in any case."""
    words = [java_quote(term) for term in terms if term]
    if not words:
        return document
    pattern = f"(?iu){'|'.join(words)}"
    return F.transform_values(
        document, lambda key, value: F.when(key.rlike(pattern), F.lit(REDACTED)).otherwise(value)
    )


def case_id(run: Column, rule: Column, test: Column) -> Column:
    """Deterministic id of a case: a whole SHA-256, so that ids stay unique in any number of cases."""
    return F.sha2(F.concat_ws("|", run, rule, test), 256)
