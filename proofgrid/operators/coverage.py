"""Run summaries and technique / tactic coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrid import vocabulary as V
from proofgrid.functions.scalars import base_technique
from proofgrid.operators.quantiles import exact_percentiles


def count_of(column: str, value: str) -> Column:
    return F.count_if(F.col(column) == value)


def rates() -> dict[str, Column]:
    """detection_rate and visibility_rate from the columns scoreable, detected and blind."""
    scoreable = F.col("scoreable")
    return {
        "detection_rate": V.ratio(F.col("detected"), scoreable),
        "visibility_rate": V.ratio(scoreable - F.col("blind"), scoreable),
    }


def run_summary(cases: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Totals, rates, latency percentiles and technique counts per run.

    `cases` has outcome, status, severity, latency, baseline_hits and attack. The severity
    counts leave out detected cases.
    """
    group = list(keys) or ["_all"]
    df = cases if keys else cases.withColumn("_all", F.lit(0))
    counts = [count_of("outcome", o).alias(o) for o in V.OUTCOMES]
    counts += [count_of("status", s).alias(f"status_{s}") for s in V.STATUSES]
    counts += [
        F.count_if((F.col("severity") == s) & (F.col("outcome") != "detected")).alias(f"severity_{s}")
        for s in V.SEVERITIES
    ]
    main = df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("total"), *counts, F.count_if(F.col("baseline_hits") > 0).alias("noisy_rules")
    )
    main = main.withColumn("scoreable", F.col("detected") + F.col("visible") + F.col("blind")).withColumns(rates())
    techniques = (
        df.select(*group, "outcome", F.explode("attack.technique").alias("technique"))
        .filter(F.col("technique") != "")
        .groupBy(*group, "technique")
        .agg(F.max(F.col("outcome") == "detected").alias("hit"))
        .groupBy(*group)
        .agg(F.count(F.lit(1)).alias("techniques_total"), F.count_if("hit").alias("techniques_covered"))
    )
    latency = exact_percentiles(df, group, "latency", {"latency_p50": 50, "latency_p95": 95})
    out = main.join(techniques, group, "left").join(latency, group, "left")
    return out.fillna(0, ["techniques_total", "techniques_covered"]).drop("_all")


def technique_coverage(
    cases: DataFrame,
    reference: DataFrame,
    technique_targets: DataFrame,
    tactic_targets: DataFrame,
    excluded: DataFrame,
    default_detected: float = V.DETECTED_TARGET,
    default_visible: float = V.VISIBLE_TARGET,
) -> DataFrame:
    """Coverage per technique.

    Cases: rule, test_id, outcome, telemetry, attack. Content tables: reference (technique,
    name, tactics), targets (technique / tactic, detected, visible, priority), excluded
    (technique, reason). Cases are folded to one row per technique before any of them is
    joined, so only that small result meets the content.

    A technique takes its tactics from its first case in (rule, test) order.
    """
    per_case = cases.select(
        "rule", "test_id", "outcome", "telemetry", F.posexplode("attack").alias("pos", "ref")
    ).select("*", F.col("ref.technique").alias("technique"), F.col("ref.tactic").alias("own_tactic"))
    blind = F.col("outcome") == "blind"
    folded = (
        per_case.filter(F.col("technique") != "")
        .groupBy("technique")
        .agg(
            *[count_of("outcome", o).alias(o) for o in V.OUTCOMES],
            F.array_sort(F.collect_set("rule")).alias("rules"),
            F.array_sort(
                F.array_distinct(F.flatten(F.collect_set(F.when(blind, F.array_sort("telemetry")))))
            ).alias("missing_telemetry"),
            F.min_by("own_tactic", F.struct("rule", "test_id", "pos")).alias("own_tactic"),
        )
        .withColumnsRenamed({"error": "errored"})
        .withColumn("parent", base_technique(F.col("technique")))
    )
    out_of_scope = excluded.select(F.col("technique").alias("_x")).distinct()
    folded = folded.join(out_of_scope, F.col("technique") == F.col("_x"), "left_anti")
    folded = folded.join(out_of_scope, F.col("parent") == F.col("_x"), "left_anti")

    def lookup(df: DataFrame, table: DataFrame, key: str, prefix: str) -> DataFrame:
        columns = [c for c in table.columns if c != key]
        renamed = table.select(F.col(key).alias("_k"), *[F.col(c).alias(prefix + c) for c in columns])
        on = F.col("technique" if prefix.startswith("own") else "parent") == F.col("_k")
        return df.join(renamed, on, "left").drop("_k")

    named = lookup(lookup(folded, reference, "technique", "own_"), reference, "technique", "up_")
    fallback = F.coalesce(F.col("own_tactics"), F.col("up_tactics"), F.array().cast("array<string>"))
    tactics = F.when(F.col("own_tactic").isNotNull(), F.array("own_tactic")).otherwise(
        F.array_distinct(F.array_compact(fallback))
    )
    named = named.select(
        *folded.columns, F.coalesce("own_name", "up_name", "technique").alias("name"), tactics.alias("tactics")
    ).drop("own_tactic")

    strictest = (
        named.select("technique", F.explode("tactics").alias("tactic"))
        .join(tactic_targets, "tactic")
        .groupBy("technique")
        .agg(
            F.max("detected").alias("_td"),
            F.max("visible").alias("_tv"),
            F.min(V.priority_rank(F.col("priority"))).alias("_tp"),
        )
        .withColumnRenamed("technique", "_k")
    )
    wide = lookup(lookup(named, technique_targets, "technique", "own_t_"), technique_targets, "technique", "up_t_")
    wide = wide.join(strictest, F.col("technique") == F.col("_k"), "left")
    has_entry = F.coalesce("own_t_priority", "up_t_priority").isNotNull()
    pick = lambda c, strict, default: F.when(has_entry, F.coalesce(f"own_t_{c}", f"up_t_{c}")).otherwise(
        F.greatest(F.lit(default), F.coalesce(F.col(strict), F.lit(default)))
    )
    names = F.array(*[F.lit(p) for p in V.PRIORITIES])
    medium = V.PRIORITIES.index("medium")
    loose = F.least(F.lit(medium), F.coalesce(F.col("_tp"), F.lit(medium)))
    scoreable = F.col("detected") + F.col("visible") + F.col("blind")
    out = (
        wide.withColumns(
            {
                "target_detected": pick("detected", "_td", default_detected),
                "target_visible": pick("visible", "_tv", default_visible),
                "priority": F.when(has_entry, F.coalesce("own_t_priority", "up_t_priority")).otherwise(
                    F.get(names, loose)
                ),
                "scoreable": scoreable,
            }
        )
        .withColumns(rates())
    )
    measured = F.col("scoreable") > 0
    out = out.withColumns(
        {
            "meets_detection": measured & (F.col("detection_rate") >= F.col("target_detected")),
            "meets_visibility": measured & (F.col("visibility_rate") >= F.col("target_visible")),
        }
    )
    status = (
        F.when(~measured, F.lit("untested"))
        .when(F.col("blind") == F.col("scoreable"), F.lit("visibility-gap"))
        .when(F.col("detected") == 0, F.lit("detection-gap"))
        .when(F.col("meets_detection") & F.col("meets_visibility"), F.lit("covered"))
        .otherwise(F.lit("partial"))
    )
    return out.withColumn("status", status).select(
        "technique", "name", "tactics", "rules", "detected", "visible", "blind", "errored", "skipped", "scoreable",
        "detection_rate", "visibility_rate", "target_detected", "target_visible", "meets_detection",
        "meets_visibility", "priority", "status", "missing_telemetry",
    )


def technique_lookup(techniques: DataFrame, reference: DataFrame) -> DataFrame:
    """Name, tactics and telemetry of techniques; what has no entry takes its parent's.

    `reference` holds technique, name, tactics and telemetry.
    """
    columns = ("name", "tactics", "telemetry")

    def entry(prefix: str) -> DataFrame:
        return reference.select(
            F.col("technique").alias(f"_{prefix}"), *[F.col(c).alias(f"{prefix}_{c}") for c in columns], F.lit(True).alias(f"{prefix}_found")
        )

    joined = techniques.join(entry("own"), F.col("technique") == F.col("_own"), "left").join(
        entry("up"), base_technique(F.col("technique")) == F.col("_up"), "left"
    )
    nothing = F.array().cast("array<string>")
    otherwise = {"name": F.col("technique"), "tactics": nothing, "telemetry": nothing}
    return joined.select(
        *techniques.columns,
        *[
            F.coalesce(F.when(F.col("own_found"), F.col(f"own_{c}")).otherwise(F.col(f"up_{c}")), otherwise[c]).alias(c)
            for c in columns
        ],
    )


def order_cases(cases: DataFrame) -> DataFrame:
    """Report order: worst outcome first, then most severe, then by rule and test."""
    rank = V.rank_of(F.col("outcome"), ("blind", "visible", "error", "detected", "skipped"), 9)
    return cases.orderBy(rank, V.severity_rank(F.col("severity")).desc(), "rule", "test_id")


def tactic_coverage(
    techniques: DataFrame,
    tactics: DataFrame,
    tactic_targets: DataFrame,
    default_detected: float = V.DETECTED_TARGET,
    default_visible: float = V.VISIBLE_TARGET,
) -> DataFrame:
    """Coverage per tactic; a technique counts once in each of its tactics.

    `tactics` holds tactic, name and order.
    """
    members = techniques.select(
        "technique", "detected", "blind", "scoreable", F.explode_outer("tactics").alias("tactic")
    ).withColumn("tactic", F.coalesce("tactic", F.lit("unmapped")))
    folded = members.groupBy("tactic").agg(
        F.array_sort(F.collect_set("technique")).alias("techniques"),
        *[F.sum(c).alias(c) for c in ("detected", "blind", "scoreable")],
    )
    targets = tactic_targets.select(
        "tactic", F.col("detected").alias("_d"), F.col("visible").alias("_v"), F.col("priority").alias("_p")
    )
    out = (
        folded.join(targets, "tactic", "left")
        .join(tactics.select("tactic", "name", "order"), "tactic", "left")
        .withColumns(rates())
        .withColumns(
            {
                "target_detected": F.coalesce("_d", F.lit(default_detected)),
                "target_visible": F.coalesce("_v", F.lit(default_visible)),
                "priority": F.coalesce("_p", F.lit("medium")),
                "name": F.coalesce("name", "tactic"),
                "order": F.coalesce("order", F.lit(99)),
            }
        )
    )
    meets = (
        (F.col("scoreable") > 0)
        & (F.col("detection_rate") >= F.col("target_detected"))
        & (F.col("visibility_rate") >= F.col("target_visible"))
    )
    return out.withColumn("meets_target", meets).drop("_d", "_v", "_p")


def overall_coverage(techniques: DataFrame) -> DataFrame:
    """Rates over techniques; one in two tactics counts once."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("detected", "blind", "scoreable")]
    return techniques.agg(*sums).withColumns(rates())


def coverage_gaps(techniques: DataFrame, kind: str) -> DataFrame:
    """Techniques with at least one case in the gap, most urgent first."""
    state = {"detection": "visible", "visibility": "blind"}[kind]
    return techniques.filter(F.col(state) > 0).orderBy(V.priority_rank(F.col("priority")), "technique")


def by_priority(techniques: DataFrame) -> DataFrame:
    return techniques.orderBy(V.priority_rank(F.col("priority")), F.col("blind").desc(), "technique")


def failing_tactics(tactics: DataFrame) -> DataFrame:
    return tactics.filter((F.col("scoreable") > 0) & ~F.col("meets_target")).orderBy(
        V.priority_rank(F.col("priority")), "order"
    )


# Heat-map colours per coverage status and for excluded techniques.
STATUS_COLOURS = {
    "covered": "#2f9e5f",
    "partial": "#c9a227",
    "detection-gap": "#e08b1a",
    "visibility-gap": "#c0392b",
    "untested": "#8a939f",
}
EXCLUDED_COLOUR = "#3f444c"


def layer_rows(techniques: DataFrame, excluded: DataFrame) -> DataFrame:
    """Heat-map rows: score, colour, and whether a measured child opens the parent's row."""
    parents = (
        techniques.filter(F.contains(F.col("technique"), F.lit(".")))
        .select(base_technique(F.col("technique")).alias("technique"), F.lit(True).alias("_opens"))
        .distinct()
    )
    colours = F.create_map(*[p for s, c in STATUS_COLOURS.items() for p in (F.lit(s), F.lit(c))])
    measured = techniques.join(parents, "technique", "left").select(
        "technique",
        F.rint(F.col("detection_rate") * 100).cast("int").alias("score"),
        F.element_at(colours, F.col("status")).alias("colour"),
        F.lit(True).alias("enabled"),
        F.coalesce("_opens", F.lit(False)).alias("show_children"),
        "status",
        "detected",
        "visible",
        "blind",
        F.array_join("rules", ", ").alias("rules"),
        F.array_join("missing_telemetry", ", ").alias("missing_telemetry"),
    )
    outside = excluded.select(
        "technique",
        F.lit(EXCLUDED_COLOUR).alias("colour"),
        F.lit(False).alias("enabled"),
        F.lit("excluded").alias("status"),
    )
    return measured.unionByName(outside, allowMissingColumns=True)
