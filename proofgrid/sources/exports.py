"""Events from files exported by search platforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofgrid.functions.fields import EventFields
from proofgrid.functions.timestamps import TIME_FIELDS, event_time, parse_time

DOC_MAP = "map<string,variant>"


def _events(documents: DataFrame, source: str) -> DataFrame:
    """doc, ts, source; the time comes from the first readable time field of the top level."""
    fields = EventFields.of(documents, "doc", [(name,) for name in TIME_FIELDS], columns=[])
    return documents.select("doc", event_time(fields).alias("ts"), F.lit(source).alias("source"))


def _merged(under: Column, over: Column) -> Column:
    """Two maps as one object; keys of `over` win."""
    rest = F.map_filter(under, lambda k, _: ~F.map_contains_key(over, k))
    return F.to_variant_object(F.map_concat(F.coalesce(rest, F.create_map().cast(DOC_MAP)), over))


def read_ndjson_export(spark: SparkSession, path: str, source: str = "export") -> DataFrame:
    """One JSON envelope per line; the event is its `result`.

    When `result._raw` is itself a JSON object its keys are added, and the envelope's own
    keys win. Lines that are not JSON or hold no result are skipped.
    """
    envelope = spark.read.text(path).select(F.try_parse_json("value").alias("v"))
    result = envelope.select(F.try_variant_get("v", "$.result", DOC_MAP).alias("m")).filter(F.col("m").isNotNull())
    raw = F.try_variant_get(F.try_element_at("m", F.lit("_raw")), "$", "string")
    nested = F.try_variant_get(F.try_parse_json(F.when(F.startswith(raw, F.lit("{")), raw)), "$", DOC_MAP)
    own = F.map_filter("m", lambda k, _: k != "_raw")
    doc = F.when(nested.isNotNull(), _merged(nested, own)).otherwise(F.to_variant_object("m"))
    return _events(result.select(doc.alias("doc")), source)


def _responses(spark: SparkSession, path: str, multiline: bool) -> DataFrame:
    return spark.read.text(path, wholetext=multiline).select(F.try_parse_json("value").alias("v"))


def read_search_hits(spark: SparkSession, path: str, source: str = "hits", multiline: bool = False) -> DataFrame:
    """Search responses, one per line (or per file): each hit's `_source` with its `_id`."""
    hits = _responses(spark, path, multiline).select(F.explode(F.try_variant_get("v", "$.hits.hits", "array<variant>")).alias("hit"))
    body = F.coalesce(F.try_variant_get("hit", "$._source", DOC_MAP), F.create_map().cast(DOC_MAP))
    identity = F.create_map(F.lit("_id"), F.try_variant_get("hit", "$._id", "variant"))
    return _events(hits.select(_merged(body, identity).alias("doc")), source)


# Where each kind of response has its events, and the type it must have there.
CONTENT = {"ndjson": ("$.result", DOC_MAP), "hits": ("$.hits.hits", "array<variant>"), "tables": ("$.tables", "array<variant>")}


def rejected_responses(spark: SparkSession, path: str, kind: str, multiline: bool = False) -> DataFrame:
    """What the reader of a kind of export skips: file, value and reason. A size limit of the parser counts as no JSON."""
    where, dtype = CONTENT[kind]
    rows = spark.read.text(path, wholetext=multiline).select(F.col("_metadata.file_path").alias("file"), "value")
    parsed = rows.withColumn("v", F.try_parse_json("value"))
    reason = F.when(F.trim("value") == "", F.lit("empty")).when(F.col("v").isNull(), F.lit("not JSON or too large")).when(
        F.try_variant_get("v", where, dtype).isNull(), F.lit("no events in it")
    )
    return parsed.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select("file", "value", "reason")


def read_tables(spark: SparkSession, path: str, source: str = "tables", multiline: bool = False) -> DataFrame:
    """Column/row responses: every row becomes an object; of equal column names the last wins."""
    tables = _responses(spark, path, multiline).select(F.explode(F.try_variant_get("v", "$.tables", "array<variant>")).alias("t"))
    names = F.transform(
        F.try_variant_get("t", "$.columns", "array<variant>"), lambda c: F.try_variant_get(c, "$.name", "string")
    )
    rows = tables.select(names.alias("names"), F.explode(F.try_variant_get("t", "$.rows", "array<variant>")).alias("row"))
    cells = rows.select("names", F.try_variant_get("row", "$", "array<variant>").alias("cells"))
    width = F.least(F.size("names"), F.size("cells"))
    used = cells.select(F.slice("names", F.lit(1), width).alias("names"), F.slice("cells", F.lit(1), width).alias("cells"))
    keep = F.filter(
        F.sequence(F.lit(0), F.size("names") - 1),
        lambda i: F.size("names") - F.array_position(F.reverse("names"), F.get("names", i)).cast("int") == i,
    )
    pairs = F.transform(keep, lambda i: F.struct(F.get("names", i), F.get("cells", i)))
    return _events(
        used.filter(F.size("names") > 0).select(F.to_variant_object(F.map_from_entries(pairs)).alias("doc")), source
    )


def unwrap(documents: DataFrame, column: str = "doc") -> DataFrame:
    """Read stored events, wrapped as {raw, timestamp, source} or bare, to doc, ts and source."""
    raw = F.try_variant_get(column, "$.raw", "variant")
    wrapped = F.coalesce(F.startswith(F.schema_of_variant(raw), F.lit("OBJECT")), F.lit(False))
    df = documents.withColumns(
        {
            "_given": F.when(wrapped, F.try_variant_get(column, "$.timestamp", "string")),
            "_source": F.try_variant_get(column, "$.source", "string"),
            column: F.when(wrapped, raw).otherwise(F.col(column)),
        }
    )
    fields = EventFields.of(df, column, [(name,) for name in TIME_FIELDS], columns=[])
    return df.select(
        F.col(column).alias("doc"),
        F.coalesce(parse_time(F.col("_given")), event_time(fields)).alias("ts"),
        F.col("_source").alias("source"),
    )
