"""Requests: mask, restore or repeat, decided from what is stored under (system, id)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from ..plans.registry import Policy, Registry
from ..sources.storage import written_once
from .context import ContextFinder
from .detect import with_entities
from .mask import MAPPINGS, alike, mask, mask_alike, masked_rows, unmask, with_plan

STORED = ("system_id", "payload_id", "masked_text", "original_digest", "mappings", "created_at")
#: Where a conversation's values and tokens are told to its turns.
TABLE = "array<struct<type_id:string,original:string,masked:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def mask_by_policy(requests: DataFrame, policies: dict[str, Policy], registry: Registry | None = None, finders: dict[str, ContextFinder] | None = None) -> DataFrame:
    """requests (system_id, payload and others) with _masked and _mappings; requests of systems without a policy stay unmasked.

    Policies of pattern types are values beside the rows: however many there are, requests are read and searched
    once. Those with types that word lists tell, or pseudonyms, have a branch of the plan for each different policy.
    """
    registry = registry or Registry()
    schema = [*requests.columns, "_masked", "_mappings"]
    values = {s: p for s, p in policies.items() if alike(registry, p) and not (finders and s in finders)}
    groups: dict[str, list[str]] = {}
    for system, policy in policies.items():
        if system not in values:
            groups.setdefault(repr(replace(policy, system_id="", unmask_enabled=True, enabled=True)), []).append(system)
    named = lambda done: done.withColumnsRenamed({"masked_text": "_masked", "mappings": "_mappings"}).select(*schema)
    branched = [s for systems in groups.values() for s in systems]
    rest = requests.where(~F.coalesce(F.col("system_id").isin(branched), F.lit(False))) if branched else requests
    if values:
        out = named(mask_alike(rest, registry, values, "system_id", "payload"))
        known = F.coalesce(F.col("system_id").isin(list(values)), F.lit(False))
        out = out.withColumns({"_masked": F.when(known, F.col("_masked")), "_mappings": F.when(known, F.col("_mappings"))})
    else:
        out = rest.withColumns({"_masked": F.lit(None).cast("string"), "_mappings": F.lit(None).cast(MAPPINGS)})
    for systems in groups.values():
        finder = next((finders[s] for s in systems if finders and s in finders), None)
        out = out.unionByName(named(mask(requests.where(F.col("system_id").isin(systems)), registry, policies[systems[0]], finder, text_col="payload")))
    return out


def process(requests: DataFrame, store: DataFrame, policies: dict[str, Policy], registry: Registry | None = None, ttl_seconds: int = 900, enforce_unmask: bool = False) -> DataFrame:
    """requests: system_id, payload_id, payload, ts. Adds action, result and mappings; store has the columns STORED.

    Empty payloads stay; unknown, disabled systems are refused; an expired entry counts as none. A new id
    is masked; of several new requests under one id the earliest is, and the others meet its entry. The
    original gives the stored mask again. The stored mask is restored if the system may, else it comes
    back as it is; any other text under a known id is restored (with enforce_unmask: only if the system
    may). Repeated rows are requests of their own.
    """
    registry = registry or Registry()
    held = store.select("system_id", "payload_id", F.struct(F.col("masked_text").alias("masked"), F.col("original_digest").alias("digest"), "mappings", "created_at").alias("_held"))
    live = requests.join(held, ["system_id", "payload_id"], "left")
    valid = F.coalesce(F.col("_held.created_at") + F.make_dt_interval(secs=F.lit(ttl_seconds)) > F.col("ts"), F.lit(False))
    live = live.withColumn("_held", F.when(valid, F.col("_held")))
    rows = mask_by_policy(live, policies, registry)
    allowed = F.col("system_id").isin([s for s, p in policies.items() if p.enabled])
    empty = F.coalesce(F.col("payload"), F.lit("")) == ""
    fresh = F.col("_held").isNull() & ~empty
    # the earliest new request of an id is masked; its entry is what the later ones meet
    own = F.struct(F.col("_masked").alias("masked"), digest(F.col("payload")).alias("digest"), F.col("_mappings").alias("mappings"), F.col("ts").alias("created_at"))
    by_id = Window.partitionBy("system_id", "payload_id").orderBy("ts", digest(F.coalesce("payload", F.lit(""))))
    rows = rows.withColumn("_rank", F.when(fresh, F.row_number().over(Window.partitionBy("system_id", "payload_id", fresh).orderBy("ts", digest(F.coalesce("payload", F.lit("")))))))
    rows = rows.withColumn("_entry", F.coalesce("_held", F.first(F.when(fresh & (F.col("_rank") == 1), own), ignorenulls=True).over(by_id.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    may = F.col("system_id").isin([s for s, p in policies.items() if p.unmask_enabled])
    same = F.col("payload") == F.col("_entry.masked")
    action = (
        F.when(~F.coalesce(allowed, F.lit(False)), "refused").when(empty, "empty").when(fresh & (F.col("_rank") == 1), "mask")
        .when((digest(F.col("payload")) == F.col("_entry.digest")) & ~same, "repeat").when(may | (~same & F.lit(not enforce_unmask)), "restore").otherwise("echo")
    )
    rows = rows.withColumns({"action": action, "_known": F.col("_entry.mappings")})
    rows = unmask(rows.withColumn("_back", F.when(F.col("action") == "restore", F.col("payload"))), "_back", "_known")
    result = (
        F.when(F.col("action") == "mask", F.col("_masked")).when(F.col("action") == "restore", F.col("restored_text"))
        .when(F.col("action") == "repeat", F.col("_entry.masked")).when(F.col("action") != "refused", F.col("payload"))
    )
    mappings = F.when(F.col("action") == "mask", F.col("_mappings")).when(F.col("action").isin("restore", "repeat", "echo"), F.col("_known"))
    return rows.select("system_id", "payload_id", "payload", "ts", "action", result.alias("result"), mappings.alias("mappings"))


def entries(processed: DataFrame, created_at) -> DataFrame:
    """What to store of processed requests."""
    return processed.where("action = 'mask'").select("system_id", "payload_id", F.col("result").alias("masked_text"), digest(F.col("payload")).alias("original_digest"), "mappings", created_at.alias("created_at"))


def evicted(store: DataFrame, most: int) -> DataFrame:
    """The newest entries, as a top-k that every task cuts first."""
    return store.orderBy(F.desc("created_at"), "system_id", "payload_id").limit(most)


def mask_session(requests: DataFrame, sessions: DataFrame, registry: Registry | None = None, policy: Policy | None = None, finder: ContextFinder | None = None) -> DataFrame:
    """requests (session_id, text and others) masked with what their sessions (session_id, mappings) hold; mappings are the session's after it, first mask of a value wins."""
    rows = requests.join(sessions.select("session_id", F.col("mappings").alias("_seeds")), "session_id", "left")
    done = mask(rows, registry, policy, finder, seeds="_seeds")
    key = lambda m: F.concat(m["type_id"], F.lit("\x00"), F.lower(m["original"]))
    seeds = F.coalesce("_seeds", F.array().cast(MAPPINGS))
    new = let(F.transform(seeds, key), lambda known: F.filter("mappings", lambda m: ~F.array_contains(known, key(m))))
    return done.withColumn("mappings", F.concat(seeds, new)).drop("_seeds")


def mask_conversations(turns: DataFrame, registry: Registry | None = None, policy: Policy | None = None, finder: ContextFinder | None = None) -> DataFrame:
    """turns (conv_id, turn, role, text) with masked_text; one table of tokens for a conversation, in turn order.

    Texts are found once and kept with their findings in a table of the shared folder; only values and their
    first places are grouped by conversation. Turns may repeat; a null conv_id is a conversation.
    """
    registry, policy = registry or Registry(), policy or Policy()
    rows = written_once(with_entities(turns, registry, policy, finder), "turns")
    planned = with_plan(rows, registry, policy)
    tokens = planned.select(F.col("_row.conv_id").alias("conv_id"), F.col("_row.turn").alias("turn"), F.col("_row.role").alias("role"), F.explode("_plan").alias("p")).where(F.col("p.masked").startswith("<<"))
    first = tokens.groupBy("conv_id", F.col("p.type_id").alias("type_id"), F.col("p.norm").alias("norm")).agg(F.min(F.struct("turn", "role", F.col("p.start").alias("start"))).alias("place"), F.min_by("p.masked", F.struct("turn", "role", "p.start")).alias("masked"))
    if policy.token_numbering == "sequential":
        number = F.row_number().over(Window.partitionBy("conv_id", "type_id").orderBy("place", "norm"))
        first = first.withColumn("masked", F.concat(F.regexp_extract("masked", "^(<<.*_)", 1), number, F.lit(">>")))
    table = first.groupBy("conv_id").agg(F.collect_list(F.struct("type_id", F.col("norm").alias("original"), "masked")).alias("_table"))
    rows = rows.join(table.withColumnRenamed("conv_id", "_conv"), F.col("_row.conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    return masked_rows(rows, registry, policy, F.col("_table"))


def sse_text(body: Column) -> Column:
    """The text of a streamed reply: the contents of its events in order, up to the closing one."""
    lines = F.filter(F.split(body, r"\r?\n"), lambda x: x.startswith("data:"))
    data = F.transform(lines, lambda x: F.trim(F.substring(x, 6, 1 << 30)))
    end = F.array_position(data, "[DONE]")
    told = F.when(end > 0, F.slice(data, F.lit(1), (end - 1).cast("int"))).otherwise(data)
    return F.array_join(F.transform(told, lambda x: F.coalesce(F.get_json_object(x, "$.choices[0].delta.content"), F.lit(""))), "")
