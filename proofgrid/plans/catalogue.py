"""All registered queries by name."""

from __future__ import annotations

from proofgrid.plans import corpora, coverage, faults, history, liveness, predicates, recording, streams, validation
from proofgrid.plans.telemetry import Query

QUERIES: dict[str, Query] = {
    name: query for module in (predicates, validation, coverage, history, liveness, recording, streams, faults, corpora) for name, query in module.QUERIES.items()
}
