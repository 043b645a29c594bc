"""Checks over corpora, fields and source needs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofgrid import vocabulary as V
from proofgrid.functions.fields import EventFields
from proofgrid.functions.predicates import selection
from proofgrid.operators.rules import Ruleset, Source


def known_tests(declared: DataFrame, recorded: DataFrame) -> DataFrame:
    """Tests declared by a corpus or seen in its events, without the baseline."""
    both = declared.select("test_id").union(recorded.select("test_id"))
    return both.filter(F.col("test_id") != V.BASELINE_TEST).distinct()


def corpus_audit(recorded: DataFrame, catalogue: DataFrame, referenced: DataFrame) -> DataFrame:
    """Recorded tests that no catalogue knows, and referenced tests that have no events."""
    seen = recorded.select("test_id").filter(F.col("test_id") != V.BASELINE_TEST).distinct()
    known, wanted = (df.select("test_id").distinct() for df in (catalogue, referenced))
    unknown = seen.join(known, "test_id", "left_anti").withColumn("finding", F.lit("not in catalogue"))
    silent = wanted.join(seen, "test_id", "left_anti").withColumn("finding", F.lit("no recorded events"))
    return unknown.unionByName(silent)


def field_population(
    events: DataFrame, sources: Sequence[Source], fields: EventFields, wanted: Mapping[str, Sequence[str]]
) -> DataFrame:
    """Per source and field: events of the source, how many fill the field, and the share.

    `wanted` names extra (rule) fields per source. One scan and one aggregate row cover all
    sources and fields; the row is then opened into lines.
    """
    scoped = [s for s in sources if s.scope]
    pairs = [(s.id, name) for s in scoped for name in dict.fromkeys([*s.fields, *wanted.get(s.id, ())])]
    names = list(dict.fromkeys(name for _, name in pairs))
    scope_at = {s.id: F.col(f"s{i}") for i, s in enumerate(scoped)}
    filled_at = {name: F.col(f"f{i}") for i, name in enumerate(names)}
    tested = events.select(
        *[selection(fields, s.scope).alias(f"s{i}") for i, s in enumerate(scoped)],
        *[(~fields.locate(name).blank).alias(f"f{i}") for i, name in enumerate(names)],
    )
    one = tested.agg(
        *[F.count_if(c).alias(f"n_{s}") for s, c in scope_at.items()],
        *[F.count_if(scope_at[s] & filled_at[name]).alias(f"p{i}") for i, (s, name) in enumerate(pairs)],
    )
    lines = F.array(
        *[
            F.struct(
                F.lit(s).alias("source"),
                F.lit(name).alias("field"),
                F.col(f"`n_{s}`").alias("events"),
                F.col(f"p{i}").alias("filled"),
            )
            for i, (s, name) in enumerate(pairs)
        ]
    )
    return one.select(F.inline(lines)).withColumns(
        {"share": V.ratio(F.col("filled"), F.col("events")), "absent": F.col("filled") == 0}
    )


def unmapped_sources(sources: Sequence[Source]) -> list[str]:
    """Sources without a scope: a capture cannot contain them and replays them as blind."""
    return sorted(s.id for s in sources if not s.scope)


def rule_fields_by_source(ruleset: Ruleset) -> dict[str, list[str]]:
    wanted: dict[str, list[str]] = {}
    for rule in ruleset.rules:
        for source in rule.telemetry:
            wanted.setdefault(source, []).extend(rule.fields)
    return wanted


def needed_sources(rules: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Catalogue sources that the selected rules read, each once."""
    wanted = rules.select(F.explode("telemetry").alias("source")).distinct()
    return catalogue.join(wanted, "source", "left_semi")


def index_by(rules: DataFrame, column: str) -> DataFrame:
    """Rules per technique, tactic or test; a rule library bounds the lists."""
    return (
        rules.select(F.explode(column).alias("key"), "rule")
        .filter(F.col("key").isNotNull() & (F.col("key") != ""))
        .groupBy("key")
        .agg(F.array_sort(F.collect_set("rule")).alias("rules"))
    )
