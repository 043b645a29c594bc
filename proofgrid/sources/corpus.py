"""Recorded corpora: JSON-lines events with a manifest per scenario folder."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from typing import Any

import yaml
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofgrid import vocabulary as V
from proofgrid.functions.fields import EventFields, discover_paths
from proofgrid.functions.scalars import HOST_KEYS, host_of
from proofgrid.functions.timestamps import parse_time

# The keys of a recorded row that are not part of the event.
TEST_KEY, OFFSET_KEY = "_test", "_offset"
RESERVED = (TEST_KEY, OFFSET_KEY)


#: The file of events in a scenario's folder, or the folder of its parts.
EVENTS_FILE = "events.jsonl"
MANIFEST_FILE = "manifest.yml"


def _scenario(name: str) -> Column:
    """The folder that holds a file, or the folder `name` of its parts."""
    inner = re.escape(name)
    return F.url_decode(F.regexp_extract("_metadata.file_path", rf"([^/]+)/(?:{inner}/)?[^/]+$", 1))


def _lines(spark: SparkSession, root: str, name: str, scenarios: Sequence[str]) -> DataFrame:
    """Every line: scenario, file, block (where in the file its block starts), seq (rising in the order of reading), value."""
    lines = (
        spark.read.text(f"{root.rstrip('/')}/*/{name}")
        .select(
            _scenario(name).alias("scenario"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            "value",
        )
        .filter(~F.substr("scenario", F.lit(1), F.lit(1)).isin(".", "_"))
    )
    if scenarios:
        lines = lines.filter(F.col("scenario").isin(*scenarios))
    return lines.select("*", F.monotonically_increasing_id().alias("seq"))


def _is_object(doc: Column) -> Column:
    return F.startswith(F.schema_of_variant(doc), F.lit("OBJECT"))


def _is_content(value: Column) -> Column:
    text = F.btrim(value)
    return (text != "") & ~F.startswith(text, F.lit("//")) & ~F.startswith(text, F.lit("#"))


def parsed_lines(spark: SparkSession, root: str, scenarios: Sequence[str] = (), name: str = EVENTS_FILE) -> DataFrame:
    """Every content line of the corpora: scenario, file, value, doc (NULL when unreadable)."""
    content = _lines(spark, root, name, scenarios).filter(_is_content(F.col("value"))).drop("block", "seq")
    doc = F.try_parse_json("value")
    return content.withColumn("doc", F.when(F.coalesce(_is_object(doc), F.lit(False)), doc))


def rejected_lines(spark: SparkSession, root: str, scenarios: Sequence[str] = (), name: str = EVENTS_FILE) -> DataFrame:
    """Lines that are not a JSON object: scenario, file, line (from 1), reason, value.

    One pass over the text. A block, as Spark splits files, is read in one go: it yields its number of lines and its
    rejected ones with their place in it. Only these rows (one per block) are shuffled; running sums over the blocks of
    a file make line numbers of the places.
    """
    lines = _lines(spark, root, name, scenarios)
    doc = F.try_parse_json("value")
    reason = F.when(doc.isNull(), F.lit("not JSON")).when(~_is_object(doc), F.lit("not an object"))
    bad = F.struct("seq", F.when(_is_content(F.col("value")), reason).alias("reason"), "value")
    blocks = lines.withColumn("bad", bad).groupBy("scenario", "file", "block").agg(
        F.count("*").alias("lines"),
        F.min("seq").alias("first"),
        F.collect_list(F.when(F.col("bad.reason").isNotNull(), F.col("bad"))).alias("rejected"),
    )
    earlier = Window.partitionBy("scenario", "file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("before", F.coalesce(F.sum("lines").over(earlier), F.lit(0)))
    return placed.select("scenario", "file", "before", "first", F.inline("rejected")).select(
        "scenario", "file", (F.col("before") + F.col("seq") - F.col("first") + 1).alias("line"), "reason", "value"
    )


def read_corpus(
    spark: SparkSession, path: str, scenarios: Sequence[str] = (), strict: bool = True, name: str = EVENTS_FILE
) -> DataFrame:
    """Corpus events: scenario, test_id, offset_s, host, doc.

    `strict` fails the job if a line is not a JSON object and names the first such file and line, for which the text is
    read once more; otherwise such lines are left out (see `rejected_lines`).
    """
    lines = parsed_lines(spark, path, scenarios, name)
    doc = F.col("doc")
    if strict:
        where = F.concat_ws(":", "file", F.col("line").cast("string"), F.concat(F.lit(" "), F.col("reason")))
        first = rejected_lines(spark, path, scenarios, name).agg(F.min_by(where, F.struct("file", "line"))).scalar()
        doc = F.coalesce(doc, F.when(doc.isNull(), F.raise_error(first).cast("variant")))
    else:
        lines = lines.filter(doc.isNotNull())
    get = lambda key, kind: F.try_variant_get("doc", f"$['{key}']", kind)
    fields = EventFields.of(lines, "doc", [(k,) for k in HOST_KEYS], columns=[])
    return lines.withColumn("doc", doc).select(
        "scenario",
        F.coalesce(get(TEST_KEY, "string"), F.lit(V.BASELINE_TEST)).alias("test_id"),
        F.coalesce(get(OFFSET_KEY, "double"), F.lit(0.0)).alias("offset_s"),
        host_of(fields).alias("host"),
        "doc",
    )


def corpus_fields(
    events: DataFrame, paths: Iterable[tuple[str, ...]] | None = None, names: Iterable[str] | None = None
) -> EventFields:
    """Field lookup for corpus events; the reserved keys are not part of the event.

    Without known `paths` they are found in the data, all of them or those of `names` (see `rules.asked_names`).
    """
    found = discover_paths(events, "doc", names) if paths is None else paths
    return EventFields.of(events, "doc", [p for p in found if p[0] not in RESERVED], columns=[])


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """scenario, recorded_at (NULL if absent), tests. One small file per scenario.

    The rows pass through the driver and their size is unknown to Spark, so joins are told to broadcast them: by scenario all
    events of one would meet in one task.
    """
    files = spark.read.text(f"{path.rstrip('/')}/*/{MANIFEST_FILE}", wholetext=True).select(_scenario(MANIFEST_FILE).alias("folder"), "value")
    rows = []
    for r in files.collect():
        doc: dict[str, Any] = yaml.safe_load(r.value) or {}
        recorded = doc.get("recorded_at")
        rows.append((r.folder, str(doc.get("scenario") or r.folder), None if recorded is None else str(recorded), [str(t) for t in doc.get("tests") or []]))
    table = spark.createDataFrame(rows, "folder string, scenario string, recorded string, tests array<string>")
    return F.broadcast(table.select("folder", "scenario", parse_time(F.col("recorded")).alias("recorded_at"), "tests"))


def write_corpus(recorded: DataFrame, path: str, scenario: str, manifest: dict[str, Any], overwrite: bool = False) -> None:
    """Write captured events (see `capture`) as JSON lines with a manifest beside them.

    Refuses an empty capture, and an existing folder unless told to overwrite. Lines are
    ordered by test and offset.
    """
    if recorded.isEmpty():
        raise ValueError("nothing was captured: an empty corpus would replay as a blind spot")
    spark = recorded.sparkSession
    folder = f"{path.rstrip('/')}/{scenario}"
    named = F.map_filter(F.col("document"), lambda k, _: ~k.isin(TEST_KEY, OFFSET_KEY, "_host"))
    text = F.concat(
        F.lit("{"),
        F.regexp_replace(F.to_json(F.struct("_test", "_offset", "_host")), r"^\{|\}$", ""),
        F.when(F.size(named) > 0, F.concat(F.lit(","), F.regexp_replace(F.to_json(named), r"^\{|\}$", ""))).otherwise(F.lit("")),
        F.lit("}"),
    )
    lines = recorded.orderBy("_test", "_offset").select(text.alias("value"))
    mode = "overwrite" if overwrite else "errorifexists"
    lines.write.mode(mode).text(f"{folder}/{EVENTS_FILE}")
    body = yaml.safe_dump({"scenario": scenario, **manifest}, sort_keys=False, allow_unicode=True)
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode(mode).text(f"{folder}/{MANIFEST_FILE}")


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Hosts from a text file: list dashes stripped, comments and blanks left out."""
    line = F.btrim(F.regexp_replace(F.btrim("value"), r"^-\s+", ""))
    return spark.read.text(path).select(line.alias("host")).filter(
        (F.col("host") != "") & ~F.startswith("host", F.lit("#"))
    ).distinct()
