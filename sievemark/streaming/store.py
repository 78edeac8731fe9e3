"""The mapping store as keyed state: typed values, a timer for each entry, in RocksDB.

Each (system, id) has one entry: what was masked, the digest of the original, and when. Its mappings are a map from masked
value to type and original, so that a restoring request reads them by key. An entry's timer stands at its
end; one that fires for an entry that was written again since is stale and does nothing. Time is
that of the requests (ts) and its watermark, so that a replay decides as the first run did.

The session needs spark.sql.streaming.stateStore.providerClass set to the RocksDB provider.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.morphology import Morphology
from ..operators.process import digest, mask_by_policy
from ..operators.pseudonyms import restore
from ..plans.dictionaries import Dictionaries
from ..plans.registry import Policy, Registry

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "system_id string, payload_id string, ts timestamp, action string, result string"


class MappingStore(StatefulProcessor):
    """Masks the first text of an id, repeats it, restores what comes back, forgets it after its time."""

    def __init__(self, policies: dict[str, Policy], ttl_seconds: int, enforce_unmask: bool):
        self.may_mask = frozenset(s for s, p in policies.items() if p.enabled)
        self.may_restore = frozenset(s for s, p in policies.items() if p.unmask_enabled)
        self.ttl, self.enforce, self.morphology = ttl_seconds * 1000, enforce_unmask, None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "masked string, digest string, created_at long")
        self.mappings = handle.getMapState("mappings", "masked string", "type_id string, original string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["ts", "digest"], kind="stable")
        entry = tuple(self.entry.get()) if self.entry.exists() else None
        out, began = [], entry
        for row in frame.itertuples(index=False):
            now = row.ts.value // 10**6
            if entry is not None and now >= entry[2] + self.ttl:
                entry = None
            action, result, entry = self._decided(entry, key[0], row, now)
            out.append((key[0], key[1], row.ts, action, result))
        if entry is not None and entry != began:
            self.handle.registerTimer(entry[2] + self.ttl)
        elif entry is None and began is not None:
            self._forget()
        yield pd.DataFrame(out, columns=["system_id", "payload_id", "ts", "action", "result"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The sweep. A timer that is older than the entry's own end is stale."""
        if self.entry.exists() and expiredTimerInfo.getExpiryTimeInMs() >= self.entry.get()[2] + self.ttl:
            self._forget()
        return iter(())

    def close(self) -> None:
        pass

    def _forget(self) -> None:
        self.entry.clear()
        self.mappings.clear()

    def _decided(self, entry, system: str, row, now: int):
        """(action, result, entry after it) of one request."""
        if system not in self.may_mask:
            return "refused", None, entry
        if not row.payload:
            return "empty", row.payload, entry
        if entry is None:
            self._forget()
            entry = (row.masked, row.digest, now)
            self.entry.update(entry)
            for m in row.mappings if row.mappings is not None else ():
                self.mappings.updateValue((m["masked"],), (m["type_id"], m["original"]))
            return "mask", row.masked, entry
        same = row.payload == entry[0]
        if row.digest == entry[1] and not same:
            return "repeat", entry[0], entry
        if system in self.may_restore or (not same and not self.enforce):
            return "restore", self._restored(row.payload), entry
        return "echo", row.payload, entry

    def _restored(self, text: str) -> str:
        if self.morphology is None:
            self.morphology = Morphology(Dictionaries.built_in())
        told = [{"masked": k[0], "type_id": v[0], "original": v[1]} for k, v in self.mappings.iterator()]
        return restore(text, told, self.morphology)


def store_stream(requests: DataFrame, policies: dict[str, Policy], registry: Registry | None = None, ttl_seconds: int = 900, enforce_unmask: bool = False, late: str = "0 seconds") -> DataFrame:
    """requests: system_id, payload_id, payload, ts (of a stream); gives system_id, payload_id, ts, action, result.

    Decides as process_stream does. Requests later than `late` behind the latest are dropped, as an entry of their time may be forgotten.
    """
    rows = requests.select("system_id", "payload_id", F.coalesce("payload", F.lit("")).alias("payload"), "ts").withWatermark("ts", late)
    told = mask_by_policy(rows, policies, registry).withColumnsRenamed({"_masked": "masked", "_mappings": "mappings"}).select("system_id", "payload_id", "payload", "ts", "masked", digest(F.col("payload")).alias("digest"), "mappings")
    return told.groupBy("system_id", "payload_id").transformWithStateInPandas(MappingStore(policies, ttl_seconds, enforce_unmask), OUT, "append", "EventTime")
