"""Readers and writers: corpora, exported dumps, content files, the run history."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

_READERS: dict[str, Callable[..., DataFrame]] = {}


def register_source(kind: str, reader: Callable[..., DataFrame]) -> None:
    """Add an event reader: `reader(spark, path, **options)` returns an events DataFrame."""
    _READERS[kind.lower()] = reader


def read_events(spark: SparkSession, kind: str, path: str, **options: Any) -> DataFrame:
    try:
        reader = _READERS[kind.lower()]
    except KeyError:
        raise ValueError(f"unknown source {kind!r}; known: {', '.join(sorted(_READERS))}") from None
    return reader(spark, path, **options)


from proofgrid.sources import corpus as _corpus  # noqa: E402
from proofgrid.sources import exports as _exports  # noqa: E402

register_source("corpus", _corpus.read_corpus)
register_source("ndjson-export", _exports.read_ndjson_export)
register_source("search-hits", _exports.read_search_hits)
register_source("tables", _exports.read_tables)
