"""Requests as a stream: texts are masked by the plan, and a keyed state decides what each request gets."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.morphology import Morphology
from ..operators.process import digest, mask_by_policy
from ..operators.pseudonyms import restore
from ..operators.stats import window_stats
from ..plans.dictionaries import Dictionaries
from ..plans.registry import Policy, Registry

STATE = "masked_text string, original_digest string, mappings string, created_at long"
OUT = "system_id string, payload_id string, ts timestamp, action string, result string"


def _decider(policies: dict[str, Policy], ttl_seconds: int, enforce_unmask: bool):
    may_mask = {s for s, p in policies.items() if p.enabled}
    may_restore = {s for s, p in policies.items() if p.unmask_enabled}
    morphology: list[Morphology] = []

    def decided(entry: tuple | None, system: str, row) -> tuple[str, str | None, tuple | None]:
        """(action, result, entry after it) of one request."""
        if system not in may_mask:
            return "refused", None, entry
        if not row.payload:
            return "empty", row.payload, entry
        if entry is None:
            return "mask", row.masked, (row.masked, row.digest, row.mappings, row.ts.value // 10**6)
        same = row.payload == entry[0]
        if row.digest == entry[1] and not same:
            return "repeat", entry[0], entry
        if system in may_restore or (not same and not enforce_unmask):
            if not morphology:
                morphology.append(Morphology(Dictionaries.built_in()))
            return "restore", restore(row.payload, json.loads(entry[2] or "[]"), morphology[0]), entry
        return "echo", row.payload, entry

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # the sweep: an entry that nobody asked for in its time
            state.remove()
            return
        entry = tuple(state.get) if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "digest"], kind="stable")
        out = []
        for row in rows.itertuples(index=False):
            if entry is not None and row.ts.value // 10**6 >= entry[3] + ttl_seconds * 1000:
                entry = None
            action, result, entry = decided(entry, key[0], row)
            out.append((key[0], key[1], row.ts, action, result))
        if entry is not None:
            state.update(entry)
            state.setTimeoutDuration(ttl_seconds * 1000)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["system_id", "payload_id", "ts", "action", "result"])

    return step


def process_stream(requests: DataFrame, policies: dict[str, Policy], registry: Registry | None = None, ttl_seconds: int = 900, enforce_unmask: bool = False) -> DataFrame:
    """requests: system_id, payload_id, payload, ts; gives system_id, payload_id, ts, action, result.

    A text is masked before it is known whether it must be, so that no text is kept in the state's
    function; the state holds one entry for each (system, id), leaves after its time, and is spread over
    the shuffle partitions by that key. Works on batches too, where the state begins empty.
    """
    rows = requests.select("system_id", "payload_id", F.coalesce("payload", F.lit("")).alias("payload"), "ts")
    told = mask_by_policy(rows, policies, registry).withColumnsRenamed({"_masked": "masked"}).select("system_id", "payload_id", "payload", "ts", "masked", digest(F.col("payload")).alias("digest"), F.to_json("_mappings").alias("mappings"))
    return told.groupBy("system_id", "payload_id").applyInPandasWithState(_decider(policies, ttl_seconds, enforce_unmask), OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def stats_stream(events: DataFrame, ts: str = "ts", late: str = "2 minutes", **columns) -> DataFrame:
    """The sliding minute, a window each second."""
    return window_stats(events.withWatermark(ts, late), ts, "60 seconds", "1 second", **columns)
