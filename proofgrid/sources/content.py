"""Rules, sources, tests, technique reference, targets and noise profiles from YAML files.

These are small authored files. The driver reads them once; what the jobs need becomes part
of the plan or a small table.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession

from proofgrid import vocabulary as V
from proofgrid.functions.timestamps import seconds_of
from proofgrid.operators.rules import Rule, Ruleset, Source


@dataclass
class Loaded:
    """Items by name, and the problem of every file that could not be used."""

    items: dict[str, Any] = field(default_factory=dict)
    errors: list[tuple[str, str]] = field(default_factory=list)

    def add(self, name: str, item: Any, where: str) -> None:
        if name in self.items:
            self.errors.append((where, f"duplicate name {name!r}"))
        else:
            self.items[name] = item


def yaml_files(folder: str | Path) -> Iterator[Path]:
    """YAML files below a folder; hidden and underscored names are skipped."""
    root = Path(folder)
    for path in sorted(root.rglob("*.y*ml")):
        if not any(part.startswith((".", "_")) for part in path.relative_to(root).parts):
            yield path


def _document(path: str | Path) -> dict[str, Any]:
    return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}


def load_rules(folder: str | Path) -> Loaded:
    out = Loaded()
    for path in yaml_files(folder):
        try:
            rule = Rule.from_document(_document(path), path.stem)
        except Exception as problem:  # noqa: BLE001 - one bad file must not hide the others
            out.errors.append((str(path), str(problem)))
        else:
            out.add(rule.name, rule, str(path))
    return out


def load_sources(path: str | Path, backend: str = "fixture") -> dict[str, Source]:
    entries = _document(path)
    entries = entries.get("sources") or entries.get("telemetry") or entries
    return {k: Source.from_document(k, v, backend) for k, v in entries.items() if isinstance(v, Mapping)}


def load_ruleset(rules: str | Path, sources: str | Path, backend: str = "fixture", scope_filter: Any = None) -> tuple[Ruleset, list[tuple[str, str]]]:
    loaded = load_rules(rules)
    ordered = tuple(loaded.items[name] for name in sorted(loaded.items))
    return Ruleset(ordered, load_sources(sources, backend), scope_filter), loaded.errors


def load_tests(folder: str | Path) -> Loaded:
    """Emulation tests: id, technique, platform, duration and expected telemetry."""
    out = Loaded()
    for path in yaml_files(folder):
        for entry in _document(path).get("tests") or []:
            try:
                row = (
                    str(entry["id"]), str(entry.get("technique") or ""), str(entry.get("platform") or ""),
                    seconds_of(entry.get("duration"), 0.0), [str(t) for t in entry.get("expected_telemetry") or []],
                )
            except Exception as problem:  # noqa: BLE001
                out.errors.append((str(path), repr(problem)))
            else:
                out.add(row[0], row, str(path))
    return out


def tests_table(spark: SparkSession, loaded: Loaded) -> DataFrame:
    return spark.createDataFrame(
        list(loaded.items.values()),
        "test_id string, technique string, platform string, duration_s double, expected_telemetry array<string>",
    )


def reference_tables(spark: SparkSession, path: str | Path) -> tuple[DataFrame, DataFrame]:
    """(techniques, tactics) of the reference mapping."""
    doc = _document(path)
    techniques = [
        (
            str(k), str((v or {}).get("name") or k),
            [str(t) for t in (v or {}).get("tactics") or []], [str(t) for t in (v or {}).get("telemetry") or []],
        )
        for k, v in (doc.get("techniques") or {}).items()
    ]
    tactics = [
        (str(k), str((v or {}).get("name") or k), int((v or {}).get("order", 99)))
        for k, v in (doc.get("tactics") or {}).items()
    ]
    return (
        spark.createDataFrame(techniques, "technique string, name string, tactics array<string>, telemetry array<string>"),
        spark.createDataFrame(tactics, "tactic string, name string, order int"),
    )


@dataclass(frozen=True)
class Targets:
    detected: float
    visible: float
    techniques: DataFrame
    tactics: DataFrame
    excluded: DataFrame


def load_targets(spark: SparkSession, path: str | Path) -> Targets:
    doc = _document(path)
    defaults = doc.get("defaults") or {}
    detected = float(defaults.get("detected", V.DETECTED_TARGET))
    visible = float(defaults.get("visible", V.VISIBLE_TARGET))

    def rows(section: str) -> list[tuple]:
        return [
            (str(k), float((v or {}).get("detected", detected)), float((v or {}).get("visible", visible)), str((v or {}).get("priority", "medium")))
            for k, v in (doc.get(section) or {}).items()
        ]

    excluded = [(str(e["technique"]), str(e.get("reason") or "")) for e in doc.get("excluded") or [] if e.get("technique")]
    layout = "detected double, visible double, priority string"
    return Targets(
        detected,
        visible,
        spark.createDataFrame(rows("techniques"), f"technique string, {layout}"),
        spark.createDataFrame(rows("tactics"), f"tactic string, {layout}"),
        spark.createDataFrame(excluded, "technique string, reason string"),
    )


def load_noise_profiles(spark: SparkSession, folder: str | Path) -> tuple[DataFrame, list[tuple[str, str]]]:
    """(accepted noise, host globs in file order)."""
    accepted, globs = [], []
    for path in yaml_files(folder):
        doc = _document(path)
        name = str(doc.get("name") or path.stem)
        globs += [(name, str(g)) for g in doc.get("hosts") or []]
        accepted += [
            (name, str(e["rule"]), int(e.get("max_hits", 0)), str(e.get("owner") or ""), str(e.get("review_by") or "") or None)
            for e in doc.get("accepted_noise") or []
        ]
    layout = "profile string, rule string, max_hits int, owner string, review_by string"
    return spark.createDataFrame(accepted, layout), globs


def load_profile(path: str | Path) -> dict[str, Any]:
    """Selection criteria, scenarios, timing (seconds) and gates of a run profile."""
    doc = _document(path)
    return {
        "name": str(doc.get("name") or Path(path).stem),
        "select": dict(doc.get("select") or {}),
        "scenarios": [str(s) for s in doc.get("scenarios") or []],
        "tests": [str(t) for t in doc.get("tests") or []],
        "exclude": [str(t) for t in doc.get("exclude") or []],
        "timing": {k: seconds_of(v) for k, v in (doc.get("timing") or {}).items()},
        "gates": dict(doc.get("gates") or {}),
    }
