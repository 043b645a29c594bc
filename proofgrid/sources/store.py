"""The run history as Parquet tables, with a manifest that says which version of a run holds.

Saving writes a new version of the run beside all others, under folders of its own, and appends one row to the manifest
last. Spark moves that row's file into place in one step, so a save that dies half-way has changed nothing and readers see
either the whole old version or the whole new one. What no version holds is deleted afterwards.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofgrid.operators import history
from proofgrid.operators.coverage import run_summary
from proofgrid.operators.gates import run_passed

# The history tables; all but runs belong to a run.
TABLES = (
    "runs", "cases", "case_attack", "evidence", "emulations", "coverage_snapshots", "findings", "rule_snapshots",
)
PARTITIONS = ("run_date", "run_key", "version")
MANIFEST = "manifest"
MANIFEST_SCHEMA = "run_id string, version string, saved_us bigint"
#: Seconds after which a version that no manifest row names counts as left by a save that died.
ABANDONED = 86_400.0


def _run_key(run_id: Column) -> Column:
    """The folder of a run; the word in front keeps ids that look like numbers or dates as they are."""
    return F.concat(F.lit("run "), run_id)


@dataclass(frozen=True)
class RunStore:
    spark: SparkSession
    root: str

    def path(self, table: str) -> str:
        if table not in (*TABLES, MANIFEST):
            raise ValueError(f"unknown table {table!r}")
        return f"{self.root.rstrip('/')}/{table}"

    def save(self, run_id: str, started_at: str, tables: Mapping[str, DataFrame]) -> None:
        """Put a run's tables in place of an earlier version of the same run, all at once.

        Readers see the old version, also where the new one has no rows or another date, until everything is written.
        """
        version = f"v{uuid.uuid4().hex}"
        for name, df in tables.items():
            tagged = df.drop("run_id", *PARTITIONS).withColumns(
                {
                    "run_id": F.lit(run_id),
                    "run_date": F.to_date(F.lit(started_at).cast("timestamp")),
                    "run_key": _run_key(F.lit(run_id)),
                    "version": F.lit(version),
                }
            )
            tagged.write.mode("append").partitionBy(*PARTITIONS).parquet(self.path(name))
        self._record([(run_id, version)])
        self.vacuum([run_id])

    def _record(self, rows: list[tuple[str, str | None]]) -> None:
        """Append what now holds, as one file; a run without a version is gone."""
        last = self._manifest().agg(F.max("saved_us")).first()[0] or 0
        now = max(last + 1, time.time_ns() // 1000)
        entries = self.spark.createDataFrame([(run, version, now) for run, version in rows], MANIFEST_SCHEMA)
        entries.coalesce(1).write.mode("append").parquet(self.path(MANIFEST))

    def _manifest(self) -> DataFrame:
        """All rows of the manifest: a few for each run ever saved."""
        if not self._exists(MANIFEST):
            return self.spark.createDataFrame([], MANIFEST_SCHEMA)
        return self.spark.read.schema(MANIFEST_SCHEMA).parquet(self.path(MANIFEST))

    def live(self) -> DataFrame:
        """run_id and version of every run that is there."""
        latest = F.max_by("version", F.struct("saved_us", "version"))
        return self._manifest().groupBy("run_id").agg(latest.alias("version")).filter(F.col("version").isNotNull())

    def read(self, table: str, run_id: str | None = None) -> DataFrame:
        """The rows of all runs, or of one, whose folder alone is then read."""
        df = self.spark.read.parquet(self.path(table))
        if run_id is not None:
            row = self.live().filter(F.col("run_id") == run_id).first()
            here = F.lit(False) if row is None else (F.col("run_key") == f"run {run_id}") & (F.col("version") == row["version"])
            return df.filter(here).drop("run_key", "version")
        return df.join(self.live().select("version"), "version", "left_semi").drop("run_key", "version")

    def vacuum(self, run_ids: Sequence[str] | None = None, abandoned_s: float = ABANDONED) -> int:
        """Delete the versions that newer ones replaced, or whose run is gone, and what saves left that died long ago.

        Returns the number of folders deleted. A version that no manifest row names may still be being written; it goes
        when it is older than `abandoned_s`.
        """
        rows = self._manifest() if run_ids is None else self._manifest().filter(F.col("run_id").isin(*run_ids))
        named = {r["version"] for r in rows.select("version").distinct().collect()}
        held = {r["version"] for r in self.live().collect()}
        before, gone = (time.time() - abandoned_s) * 1000, 0
        for table in TABLES:
            for folder, changed in self._folders(table, run_ids):
                version = folder.rpartition("version=")[2]
                if version not in held and (version in named or changed < before):
                    self._delete(folder)
                    gone += 1
        return gone

    def load_cases(self, run_id: str) -> DataFrame:
        """A run's cases with their techniques, evidence and emulation. The lists are small:
        a rule's techniques and the few events kept as evidence."""
        keys = ["run_id", "case_id"]
        cases = self.read("cases", run_id).drop("attack")
        attack = (
            self.read("case_attack", run_id)
            .groupBy(*keys)
            .agg(F.sort_array(F.collect_list(F.struct("technique", "tactic"))).alias("attack"))
        )
        evidence = (
            self.read("evidence", run_id)
            .groupBy(*keys)
            .agg(F.sort_array(F.collect_list(F.struct("ordinal", "document"))).alias("evidence"))
        )
        emulations = self.read("emulations", run_id).drop("run_date")
        body = [c for c in emulations.columns if c not in ("run_id", "test_id")]
        emulation = emulations.select("run_id", "test_id", F.struct(*body).alias("emulation"))
        return (
            cases.join(attack, keys, "left").join(evidence, keys, "left").join(emulation, ["run_id", "test_id"], "left")
        )

    def list_runs(self, limit: int = 20, profile: str | None = None, backend: str | None = None) -> DataFrame:
        return history.list_runs(self.read("runs"), limit, profile, backend)

    def latest_run_id(self, profile: str | None = None, backend: str | None = None) -> str | None:
        row = self.list_runs(1, profile, backend).first()
        return None if row is None else row["run_id"]

    def previous_run_id(self, run_id: str) -> str | None:
        runs = history.previous_runs(self.read("runs").select("run_id", "profile", "started_at"))
        row = runs.filter(F.col("run_id") == run_id).first()
        return None if row is None else row["previous_run_id"]

    def findings(self, run_id: str, kind: str | None = None) -> DataFrame:
        found = self.read("findings", run_id)
        return (found if kind is None else found.filter(F.col("kind") == kind)).orderBy("id")

    def history(self) -> DataFrame:
        """Case results of all runs with their start."""
        runs = self.read("runs").select("run_id", "profile", "started_at")
        return self.read("cases").join(runs, "run_id")

    def stats(self) -> DataFrame:
        """Rows per table with the oldest and newest run date, from partition columns only."""
        parts = [
            self.read(t).agg(F.count(F.lit(1)).alias("rows"), F.min("run_date").alias("oldest"), F.max("run_date").alias("newest"))
            .select(F.lit(t).alias("table"), "*")
            for t in TABLES
            if self._exists(t)
        ]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def prune(self, cutoff: Column) -> list[str]:
        """Take away the runs that started before the cutoff, from every table at once; then delete their folders."""
        old = [r["run_id"] for r in self.read("runs").filter(F.col("started_at") < cutoff).select("run_id").distinct().collect()]
        if old:
            self._record([(run_id, None) for run_id in old])
            self.vacuum(old)
        return sorted(old)

    def _filesystem(self, path: str):
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _folders(self, table: str, run_ids: Sequence[str] | None) -> list[tuple[str, int]]:
        """The folders of all versions of some runs (or all), under any date, and when each was changed (ms)."""
        jvm = self.spark.sparkContext._jvm
        files, _ = self._filesystem(self.path(table))
        escape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        keys = ["*"] if run_ids is None else [re.sub(r"([\\*?\[\]{}^])", r"\\\1", escape(f"run {run}")) for run in run_ids]
        found = []
        for key in keys:
            found += files.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path(table)}/run_date=*/run_key={key}/version=*")) or []
        return [(status.getPath().toString(), status.getModificationTime()) for status in found]

    def _exists(self, table: str) -> bool:
        files, target = self._filesystem(self.path(table))
        return bool(files.exists(target))

    def _delete(self, path: str) -> None:
        files, target = self._filesystem(path)
        files.delete(target, True)


def keep_since(rows: DataFrame, runs: DataFrame, cutoff: Column) -> DataFrame:
    """Child rows of the runs that a retention cutoff keeps."""
    return rows.join(runs.filter(F.col("started_at") >= cutoff).select("run_id"), "run_id", "left_semi")


def write_run_document(path: str, parts: Mapping[str, DataFrame], mode: str = "errorifexists") -> None:
    """A run's full record as JSON lines, one folder per part (run, results, coverage, ...).

    The cases stay one line each instead of one nested document, so a large run is written
    by many tasks.
    """
    for name, df in parts.items():
        df.write.mode(mode).json(f"{path.rstrip('/')}/{name}")


def run_tables(
    cases: DataFrame,
    run: Mapping[str, object],
    gates: DataFrame,
    noise: DataFrame,
    techniques: DataFrame,
    rules: DataFrame,
    evidence: DataFrame | None = None,
    scores: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The history tables of one classified run, ready for `RunStore.save`.

    `run` gives profile, backend, mode, started_at and finished_at. `evidence` has case_id,
    place (from 1) and document; `scores` rule, total and grade. Pass a stored case table:
    several of the results read it.
    """
    started, finished = (F.lit(run.get(k)).cast("timestamp") for k in ("started_at", "finished_at"))
    passed = run_passed(gates).select(F.col("passed").alias("gates_passed"), F.lit(1).alias("_one"))
    summary = run_summary(cases).withColumn("_one", F.lit(1)).join(passed, "_one").drop("_one")
    facts = {k: F.lit(run.get(k)).cast("string") for k in ("profile", "backend", "mode", "operator", "git_ref")}
    runs = summary.withColumns(
        {
            **facts,
            "started_at": started,
            "finished_at": finished,
            "duration_s": (F.unix_micros(finished) - F.unix_micros(started)) / F.lit(1e6),
        }
    )
    hidden = [c for c in ("attack", "tests", "techniques", "tactics", "lo", "hi") if c in cases.columns]
    attack = (
        cases.select("case_id", F.posexplode("attack").alias("pos", "ref"))
        .filter(F.col("ref.technique") != "")
        .groupBy("case_id", F.col("ref.technique").alias("technique"))
        .agg(F.max_by("ref.tactic", "pos").alias("tactic"))
    )
    body = [c for c in ("executed", "mode", "started_us", "finished_us", "exit_code", "emulation_error") if c in cases.columns]
    emulations = cases.filter(F.col("started_us").isNotNull()).groupBy("test_id").agg(
        F.min_by(F.struct(*body), "case_id").alias("e")
    ).select("test_id", "e.*")
    failed = gates.filter(F.col("applicable") & ~F.col("passed")).select(
        F.col("position").cast("bigint").alias("id"), F.lit("gate").alias("kind"), F.col("gate").alias("name"), F.lit("high").alias("severity"),
        F.lit(None).cast("string").alias("rule"), F.concat(F.col("n").cast("string"), F.lit(" offender(s)")).alias("message"),
        F.to_json(F.struct("offenders")).alias("detail"),
    )
    # At most one finding per rule, so numbering them is small work.
    worst = Window.partitionBy(F.lit(0)).orderBy(F.col("excess").desc(), "rule")
    loud = noise.select(
        (F.row_number().over(worst) + 100).cast("bigint").alias("id"), F.lit("noise").alias("kind"), F.col("rule").alias("name"), "severity", "rule",
        F.format_string("%s has %d quiet-window hit(s), %d more than accepted", "rule", "hits", "excess").alias("message"),
        F.to_json(F.struct("rule", "hits", "allowance", "excess", "severity", "profile", "outcome")).alias("detail"),
    )
    used = rules.join(cases.select("rule").distinct(), "rule", "left_semi").select("rule", "fingerprint", "status", "severity")
    if scores is not None:
        used = used.join(scores.select("rule", F.col("total").alias("score"), "grade"), "rule", "left")
    out = {
        "runs": runs,
        "cases": cases.drop(*hidden),
        "case_attack": attack,
        "emulations": emulations,
        "coverage_snapshots": techniques.drop("errored", "skipped", "rules", "missing_telemetry"),
        "findings": failed.unionByName(loud),
        "rule_snapshots": used,
    }
    if evidence is not None:
        out["evidence"] = evidence.select("case_id", (F.col("place") - 1).alias("ordinal"), "document")
    return out
