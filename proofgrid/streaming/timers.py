"""Verdicts and silence alerts that a clock triggers, with keyed state and timers.

Absence produces no rows, so a watermark alone never reports it when a source is dead.
Each key sets a processing-time timer instead. Inputs are pre-aggregated rows (one per key
and micro-batch), so no key receives a share of the raw events.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

VERDICT_SCHEMA = "case_id string, outcome string, hits bigint, probe_hits bigint, first_us bigint, as_of_ms bigint"
CASE_STATE = "hits bigint, probe_hits bigint, first_us bigint, deadline_ms bigint, done boolean"
ALERT_SCHEMA = "source string, host string, state string, last_ms bigint, as_of_ms bigint"
BEAT_STATE = "last_ms bigint, limit_ms bigint, alerted boolean"

# How long a settled case is remembered by default.
REMEMBER_MS = 24 * 3600 * 1000


def settle_cases(progress: DataFrame, remember_ms: int = REMEMBER_MS) -> DataFrame:
    """One verdict per case: detected at its first hit, else visible or blind at its deadline.

    Rows may be late by up to `remember_ms`: so long a settled case is remembered, so that a late row can't open it again,
    and so long a case waits for the row that opens it. Give it the lateness that the source can have.

    `progress`: case_id, hits, probe_hits, first_us, deadline_ms. A case is opened by a row
    without hits that carries the deadline on the clock.
    """

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        hits, probes, first, deadline, done = state.get if state.exists else (0, 0, -1, -1, False)
        now = state.getCurrentProcessingTimeMs()
        outcome = None
        if state.hasTimedOut:
            if done:
                state.remove()
                return
            outcome = "visible" if probes > 0 else "blind"
        else:
            for frame in rows:
                hits += int(frame["hits"].sum())
                probes += int(frame["probe_hits"].sum())
                seen = frame["first_us"].dropna()
                if len(seen):
                    first = int(seen.min()) if first < 0 else min(first, int(seen.min()))
                limits = frame["deadline_ms"].dropna()
                if len(limits):
                    deadline = int(limits.max())
            if hits > 0 and not done:
                outcome = "detected"
        settled = done or outcome is not None
        state.update((hits, probes, first, deadline, settled))
        if settled:
            state.setTimeoutDuration(remember_ms)
        else:
            state.setTimeoutDuration(max(deadline - now, 1) if deadline >= 0 else remember_ms)
        if outcome is not None:
            yield pd.DataFrame(
                {
                    "case_id": [key[0]],
                    "outcome": [outcome],
                    "hits": [hits],
                    "probe_hits": [probes],
                    "first_us": pd.array([first if first >= 0 else None], dtype="Int64"),
                    "as_of_ms": [now],
                }
            )

    return progress.groupBy("case_id").applyInPandasWithState(
        step, VERDICT_SCHEMA, CASE_STATE, "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def silence_alerts(seen: DataFrame) -> DataFrame:
    """An alert when a (source, host) stays silent past its limit, and one when it returns.

    `seen`: source, host, last_ms, limit_ms (interval times grace), one row per key and
    micro-batch.
    """

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, limit, alerted = state.get if state.exists else (-1, 0, False)
        now = state.getCurrentProcessingTimeMs()
        change = None
        if state.hasTimedOut:
            change, alerted = "silent", True
            state.update((last, limit, alerted))
        else:
            for frame in rows:
                last = max(last, int(frame["last_ms"].max()))
                limit = int(frame["limit_ms"].max())
            # A row from before the silence doesn't end it.
            if alerted and last + limit > now:
                change, alerted = "alive", False
            state.update((last, limit, alerted))
            if not alerted:
                state.setTimeoutDuration(max(last + limit - now, 1))
        if change:
            yield pd.DataFrame(
                {"source": [key[0]], "host": [key[1]], "state": [change], "last_ms": [last], "as_of_ms": [now]}
            )

    return seen.groupBy("source", "host").applyInPandasWithState(
        step, ALERT_SCHEMA, BEAT_STATE, "append", GroupStateTimeout.ProcessingTimeTimeout
    )
