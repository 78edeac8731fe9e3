"""Masking and restoring, a row at a time: the findings of a text are replaced where they stand.

Rows keep their findings as an array, so nothing is joined by an id and ids may repeat. All names that
a plan needs beside the input's columns begin with an underscore; the input travels as one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import chunked, let, piece, sentence_key, token_key, value_key
from ..plans.dictionaries import Dictionaries
from ..plans.registry import Policy, Registry
from .context import ContextFinder
from .detect import ENTITY, apart, entity_steps, with_entities, with_found
from .pseudonyms import pseudonyms, restored_in_cases
from .spans import spans

#: A token in text; case and spaces inside don't matter, a grammatical case may follow a colon.
TOKEN = r"(?iu)<<\s*([A-Z]+)\s*_\s*([0-9]+|[0-9a-f]{6})\s*(?::\s*(\p{L}+)\s*)?>>"
MAPPINGS = "array<struct<type_id:string,original:string,masked:string>>"
# fixed values: words of an address that are no values
ADDRESS_WORDS = (
    "г", "гор", "город", "городе", "города", "ул", "улица", "улице", "улицы", "улицу", "пр", "пр-т", "пр-кт", "просп", "проспект", "проспекте", "проспекта", "пер", "переулок", "переулке",
    "переулка", "б-р", "бульвар", "бульваре", "ш", "шоссе", "наб", "набережная", "набережной", "пл", "площадь", "площади", "проезд", "проезде", "аллея", "тупик", "линия", "мкр", "мкрн",
    "микрорайон", "микрорайоне", "обл", "область", "области", "р-н", "район", "районе", "респ", "республика", "край", "пос", "п", "поселок", "посёлок", "поселке", "посёлке", "с", "село",
    "селе", "дер", "деревня", "деревне", "д", "дом", "доме", "дома", "кв", "квартира", "квартире", "квартиры", "корп", "корпус", "корпусе", "к", "стр", "строение", "строении", "лит",
    "литера", "пом", "помещение", "оф", "офис", "эт", "этаж", "индекс",
)
_WORD = "(?:" + "|".join(sorted(ADDRESS_WORDS, key=lambda w: (-len(w), w))) + ")"
_VALUE = rf"(?!{_WORD}\.?(?:[\s,;]|$))(?!{_WORD}\.[^\s,;])[^\s,;]+"
#: A run of words of an address that are values, also right after "д." and the like.
ADDRESS_VALUES = rf"(?iu)(?:(?<=^|[\s,;]){_VALUE}|(?<=(?:^|[\s,;]){_WORD}\.)[^\s,;]+)(?:\s+{_VALUE})*(?<!\.)"
ADDRESS_HAS_WORD = rf"(?iu)(?:^|[\s,;]){_WORD}(?:\.|[\s,;]|$)"


def stars(value: Column, type_id: Column, prefix: Column, suffix: Column) -> Column:
    names = F.array_join(F.transform(F.split(F.trim(value), r"\s+"), lambda w: F.concat(F.substring(w, 1, 1), F.lit("."))), " ")
    n = F.length(value)
    p = F.least(prefix, n)
    s = F.least(suffix, n - p)
    middle = F.regexp_replace(F.substring(value, p + 1, n - p - s), r"[^ \-.()+@/]", "*")
    plain = F.concat(F.substring(value, F.lit(1), p), middle, F.substring(value, n - s + 1, s))
    local = F.regexp_extract(value, "(?s)^(.*)@", 1)
    keep = F.least(prefix, F.length(local))
    mail = F.concat(F.substring(local, F.lit(1), keep), F.repeat(F.lit("*"), F.length(local) - keep), F.substring(value, F.length(local) + 1, n))
    return F.when(type_id == "fio", names).when((type_id == "email") & value.contains("@"), mail).otherwise(plain)


def _by_type(registry: Registry, pick, kind: str, type_id: Column) -> Column:
    pairs = [F.lit(x).cast(k) for t in registry.types.values() for x, k in ((t.id, "string"), (pick(t), kind))]
    return F.element_at(F.create_map(*pairs), type_id)


def mode_of(registry: Registry, policy: Policy, type_id: Column) -> Column:
    """How a type is masked: as the policy says of it, as the type does, or as the policy does."""
    return _by_type(registry, lambda t: policy.overrides.get(t.id, t.mask if t.mask != "token" else policy.mask_mode), "string", type_id)


def with_companions(entities: Column, text: Column, registry: Registry) -> Column:
    """Only those codes that a confident companion type stands beside in the sentence."""
    ends = ".!?\\n"
    needy = [t.id for t in registry.types.values() if t.requires_companion]
    if not needy:
        return entities
    placed = F.transform(entities, lambda e: F.struct(e.alias("e"), F.when(e["type_id"].isin(needy) | (e["confidence"] >= 0.9), sentence_key(text, e["start"], ends)).alias("sentence")))

    def stays(x: Column, every: Column) -> Column:
        needs = F.split(_by_type(registry, lambda t: ",".join(t.companions), "string", x["e"]["type_id"]), ",")
        beside = F.exists(every, lambda y: (y["sentence"] == x["sentence"]) & (y["e"]["confidence"] >= 0.9) & F.array_contains(needs, y["e"]["type_id"]))
        return ~x["e"]["type_id"].isin(needy) | beside

    return F.when(F.exists(entities, lambda e: e["type_id"].isin(needy)), F.element_at(F.transform(F.array(placed), lambda every: F.transform(F.filter(every, lambda x: stays(x, every)), lambda x: x["e"])), 1)).otherwise(entities)


def components(entities: Column, registry: Registry, policy: Policy) -> Column:
    """Addresses that get tokens, cut into their values; words such as street and house stay."""
    cut = [t.id for t in registry.enabled(policy) if t.split_components]

    def values(e: Column) -> Column:
        part = lambda s: F.struct((e["start"] + s["start"]).alias("start"), (e["start"] + s["end"]).alias("end"), e["type_id"].alias("type_id"), s["value"].alias("value"), e["confidence"].alias("confidence"))
        return F.when(e["value"].rlike(ADDRESS_HAS_WORD), F.coalesce(F.transform(spans(e["value"], ADDRESS_VALUES, java=True), part), F.array(e))).otherwise(F.array(e))

    each = F.transform(entities, lambda e: F.when(e["type_id"].isin(cut) & (mode_of(registry, policy, e["type_id"]) == "token"), values(e)).otherwise(F.array(e)))
    return F.when(F.exists(entities, lambda e: e["type_id"].isin(cut)), F.flatten(each)).otherwise(entities) if cut else entities


def with_plan(rows: DataFrame, registry: Registry, policy: Policy, table: Column | None = None) -> DataFrame:
    """rows with _text, _chunks, _entities; adds _plan: the replacements in text order. table: mappings that are given already."""
    return plan_steps(rows, registry, policy, table)


def plan_steps(rows, registry: Registry, policy: Policy, table: Column | None):
    """The columns of with_plan, one after the other; rows: a DataFrame, or what notes its columns (sql.Steps)."""
    keep = F.col("_entities")
    if policy.combination_rule:
        keep = with_companions(keep, F.col("_text"), registry)
    active = F.filter(keep, lambda e: mode_of(registry, policy, e["type_id"]) != "off")
    keyed = F.transform(components(active, registry, policy), lambda e: F.struct(*[e[c].alias(c) for c in ("start", "end", "type_id", "value", "confidence")], value_key(e["value"]).alias("norm"), mode_of(registry, policy, e["type_id"]).alias("mode")))
    given = F.coalesce(table, F.array().cast(MAPPINGS)) if table is not None else F.array().cast(MAPPINGS)
    rows = rows.withColumn("_keyed", keyed).withColumn("_given", F.transform(given, lambda m: F.struct(m["type_id"].alias("type_id"), value_key(m["original"]).alias("norm"), m["masked"].alias("masked"))))
    return _replaced(rows, registry, policy)


#: How a policy treats a row, as a value: what enters the plan once however many policies there are.
ROW_POLICY = "struct<types:array<string>,least:double,skips:boolean,allowed:array<string>,modes:map<string,string>,combined:boolean,hashed:boolean,salt:string>"


def alike(registry: Registry, policy: Policy) -> bool:
    """Whether a policy can be a value beside others: all its types are found by patterns alone and masked by expressions."""
    types = registry.enabled(policy)
    modes = {policy.mask_mode, *policy.overrides.values(), *(t.mask for t in types)}
    return all(t.found_by == "patterns" and not t.split_components and t.id not in ("cvv", "card_pin") for t in types) and not modes & {"pseudonym", "synthetic"}


def row_policies(registry: Registry, policies: dict[str, Policy]) -> Column:
    """A map of system to its ROW_POLICY."""

    def told(p: Policy) -> Column:
        types = registry.enabled(p)
        modes = [F.lit(x) for t in types for x in (t.id, p.overrides.get(t.id, t.mask if t.mask != "token" else p.mask_mode))]
        strings = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<string>")
        return F.struct(
            strings([t.id for t in types]).alias("types"), F.lit(float(p.min_confidence)).alias("least"), F.lit(p.trap_policy != "prefer_mask").alias("skips"), strings([a.lower() for a in p.allow_substrings]).alias("allowed"),
            (F.create_map(*modes) if modes else F.create_map().cast("map<string,string>")).alias("modes"), F.lit(p.combination_rule).alias("combined"), F.lit(p.token_numbering == "hash").alias("hashed"), F.lit(p.hash_salt or "").alias("salt"),
        ).cast(ROW_POLICY)

    return F.create_map(*[x for system, p in policies.items() for x in (F.lit(system), told(p))])


def mask_alike(docs: DataFrame, registry: Registry, policies: dict[str, Policy], system_col: str, text_col: str) -> DataFrame:
    """As mask, each row under the policy of its system: one scan and one detection for all of them. Rows of other systems keep their text unmasked."""
    types = tuple({t.id: None for p in policies.values() for t in registry.enabled(p)})
    every = Policy(types=types, min_confidence=min(p.min_confidence for p in policies.values()))
    rows = docs.select(F.struct("*").alias("_row"), F.col(text_col).cast("string").alias("_text"))
    found = with_found(rows, registry, every, None)
    p = F.col("_policy")
    found = apart(found.withColumn("_policy", F.try_element_at(row_policies(registry, policies), F.col("_row")[system_col])), "_policy")
    value = lambda e: piece(F.col("_text"), F.col("_chunks"), e["start"], e["end"] - e["start"])

    def stays(e: Column) -> Column:
        enough = F.when(p["skips"], e["confidence"] > p["least"] + 1e-6).otherwise(e["confidence"] + 1e-6 >= p["least"])
        return F.array_contains(p["types"], e["type_id"]) & enough & ~((F.size(p["allowed"]) > 0) & F.exists(p["allowed"], lambda a: a.contains(F.lower(value(e)))))

    found = found.withColumn("_found", F.when(p.isNotNull(), F.filter("_found", stays)).otherwise(F.filter("_found", lambda e: F.lit(False))))
    told = entity_steps(found, registry, False)
    keep = F.when(p["combined"], with_companions(F.col("_entities"), F.col("_text"), registry)).otherwise(F.col("_entities"))
    mode = lambda e: F.element_at(p["modes"], e["type_id"])
    keyed = F.transform(F.filter(keep, lambda e: mode(e) != "off"), lambda e: F.struct(*[e[c].alias(c) for c in ("start", "end", "type_id", "value", "confidence")], value_key(e["value"]).alias("norm"), mode(e).alias("mode")))
    told = apart(told.withColumn("_keyed", keyed), "_chunks", "_keyed").withColumn("_given", F.array().cast("array<struct<type_id:string,norm:string,masked:string>>"))
    modes = {"token", "stars", "remove"} & {m for q in policies.values() for m in (q.mask_mode, *q.overrides.values(), *(t.mask for t in registry.enabled(q)))}
    return _masked_columns(_replaced(told, registry, every, modes | {"token"}, p), rows)


def _replaced(rows, registry: Registry, policy: Policy, modes: set[str] | None = None, row: Column | None = None):
    """_plan of _keyed and _given. row: a column of ROW_POLICY that tells each row's numbering; modes: all that rows may have."""
    label = lambda t: F.coalesce(_by_type(registry, lambda x: x.token_label, "string", t), F.upper(t))
    known = lambda p: F.get(F.transform(F.filter("_given", lambda g: (g["type_id"] == p["type_id"]) & (g["norm"] == p["norm"])), lambda g: g["masked"]), F.lit(0))
    modes = modes or {policy.mask_mode, *policy.overrides.values(), *(t.mask for t in registry.types.values())}
    salt = row["salt"] if row is not None else F.lit(policy.hash_salt)
    number = lambda p: F.substring(F.sha2(F.concat(salt, F.lit("\x00"), p["norm"]), 256), 1, 6)
    if row is not None or policy.token_numbering != "hash":
        hashed = number
        # the values of each type that have no token yet, by first place; a value's number is its place there
        own = lambda t: F.array_except(F.transform(F.filter("_keyed", lambda e: (e["type_id"] == t) & (e["mode"] == "token")), lambda e: e["norm"]), F.transform(F.filter("_given", lambda g: g["type_id"] == t), lambda g: g["norm"]))
        last = lambda t: F.coalesce(F.array_max(F.transform(F.filter("_given", lambda g: g["type_id"] == t), lambda g: F.regexp_extract(g["masked"], r"_(\d+)>>$", 1).try_cast("int"))), F.lit(0))
        types = F.array_distinct(F.transform(F.filter("_keyed", lambda e: e["mode"] == "token"), lambda e: e["type_id"]))
        rows = rows.withColumn("_fresh", F.map_from_entries(F.transform(types, lambda t: F.struct(t, F.struct(last(t).alias("last"), own(t).alias("values"))))))
        counted = lambda p: (F.col("_fresh")[p["type_id"]]["last"] + F.array_position(F.col("_fresh")[p["type_id"]]["values"], p["norm"])).cast("string")
        number = counted if row is None else lambda p: F.when(row["hashed"], hashed(p)).otherwise(counted(p))
    if modes & {"pseudonym", "synthetic"}:
        rows = rows.withColumn("_invented", pseudonyms(registry, policy)(F.when(F.exists("_keyed", lambda e: e["mode"].isin("pseudonym", "synthetic")), F.col("_text")), F.col("_keyed"), F.col("_given")))
        invented = lambda p: F.element_at(F.col("_invented"), F.concat(p["type_id"], F.lit("\x00"), p["norm"]))
    else:
        invented = lambda p: F.lit(None).cast("string")

    def masked(p: Column) -> Column:
        token = F.concat(F.lit("<<"), label(p["type_id"]), F.lit("_"), number(p), F.lit(">>"))
        prefix, suffix = (F.coalesce(_by_type(registry, pick, "int", p["type_id"]), F.lit(0)) for pick in (lambda t: t.stars_keep_prefix, lambda t: t.stars_keep_suffix))
        first = F.get(F.transform(F.filter("_keyed", lambda e: (e["type_id"] == p["type_id"]) & (e["norm"] == p["norm"])), lambda e: e["value"]), F.lit(0)) if "stars" in modes else p["value"]
        return F.when(p["mode"] == "token", token).when(p["mode"] == "stars", stars(first, p["type_id"], prefix, suffix)).when(p["mode"] == "remove", F.lit("[removed]")).otherwise(F.coalesce(invented(p), F.lit("[removed]")))

    plan = F.transform("_keyed", lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), p["type_id"].alias("type_id"), p["value"].alias("value"), p["norm"].alias("norm"), F.coalesce(known(p), masked(p)).alias("masked")))
    return rows.withColumn("_plan", plan).drop("_keyed", "_given", "_fresh", "_invented")


def rewritten(text: Column, chunks: Column, plan: Column) -> Column:
    """The text with the replacements of the plan."""
    pieces = F.transform(plan, lambda p, k: F.concat(_gap(text, chunks, F.coalesce(F.get(plan, k - 1)["end"], F.lit(0)), p["start"]), p["masked"]))
    tail = F.element_at(plan, -1)["end"]
    return F.when(F.size(plan) > 0, F.concat(F.array_join(pieces, ""), F.substring(text, tail + 1, F.length(text)))).otherwise(text)


def _gap(text: Column, chunks: Column, start: Column, end: Column) -> Column:
    return piece(text, chunks, start, end - start)


def mappings_of(plan: Column) -> Column:
    """The first value of each key with its replacement, in text order."""
    key = lambda p: F.concat(p["type_id"], F.lit("\x00"), p["norm"])
    told = lambda p: F.struct(p["type_id"].alias("type_id"), p["value"].alias("original"), p["masked"].alias("masked"))
    # of equal keys the first stays: distinct keys come in the order of their first places
    firsts = lambda keys: F.transform(F.array_distinct(keys), lambda k: F.element_at(plan, F.array_position(keys, k).cast("int")))
    return let(F.transform(plan, key), lambda keys: F.transform(firsts(keys), told))


def masked_rows(rows: DataFrame, registry: Registry, policy: Policy, table: Column | None = None) -> DataFrame:
    """The input's columns with masked_text, n_entities and mappings, which replace columns of these names; rows: of with_entities."""
    return _masked_columns(with_plan(rows, registry, policy, table), rows)


def _masked_columns(planned: DataFrame, rows: DataFrame) -> DataFrame:
    out = {"masked_text": rewritten(F.col("_text"), F.col("_chunks"), F.col("_plan")), "n_entities": F.size("_plan").cast("long"), "mappings": F.coalesce(mappings_of(F.col("_plan")), F.array().cast(MAPPINGS))}
    kept = [F.col("_row")[c].alias(c) for c in rows.schema["_row"].dataType.names if c not in out]
    present = F.col("_text").isNotNull()
    values = [F.when(present, out["masked_text"]).alias("masked_text"), F.when(present, out["n_entities"]).otherwise(0).alias("n_entities"), F.when(present, out["mappings"]).otherwise(F.array().cast(MAPPINGS)).alias("mappings")]
    return apart(planned.select(*kept, *values), "masked_text", "n_entities", "mappings")


def mask(docs: DataFrame, registry: Registry | None = None, policy: Policy | None = None, finder: ContextFinder | None = None, seeds: str | None = None, text_col: str = "text") -> DataFrame:
    """docs with masked_text, n_entities, mappings. seeds: a column of mappings whose tokens are used again and whose numbers go on.

    A null text stays null; ids may repeat or be missing; an empty table gives an empty table.
    """
    registry, policy = registry or Registry(), policy or Policy()
    rows = with_entities(docs, registry, policy, finder, text_col)
    return masked_rows(rows, registry, policy, F.col("_row")[seeds] if seeds else None)


def given_entities(docs: DataFrame, entities_col: str, text_col: str = "text") -> DataFrame:
    """As with_entities, of entities that are known: array<struct<start, end, type_id, value, confidence>>."""
    rows = docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("_text"), F.array_sort(F.col(entities_col).cast(f"array<{ENTITY}>")).alias("_entities"))
    return rows.withColumn("_chunks", chunked(F.col("_text")))


def restored(text: Column, mappings: Column) -> Column:
    """Known tokens give way to their originals; unknown ones stay. Tokens with a grammatical case stay too."""
    found = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    gaps = F.split(text, TOKEN, -1)
    entries = F.transform(mappings, lambda m: F.struct(token_key(m["masked"]).alias("key"), m["original"].alias("original")))

    def replaced(known: Column) -> Column:
        original = lambda t: F.get(F.transform(F.filter(known, lambda e: e["key"] == token_key(t)), lambda e: e["original"]), F.lit(0))
        # each token is looked up once, however often it stands in the text
        pairs = lambda tokens: F.map_from_entries(F.transform(F.array_distinct(tokens), lambda t: F.struct(t, F.coalesce(original(t), t))))
        parts = lambda back: F.zip_with(gaps, found, lambda gap, token: F.concat(gap, F.coalesce(F.try_element_at(back, token), F.lit(""))))
        return let(pairs(found), lambda back: F.array_join(parts(back), ""))

    return F.when(text.rlike("<<"), F.when(F.size(found) > 0, let(entries, replaced)).otherwise(text)).otherwise(text)


def unmask(rows: DataFrame, text_col: str = "masked_text", mappings_col: str = "mappings", dictionaries: Dictionaries | None = None) -> DataFrame:
    """rows with restored_text and unresolved: how many tokens have no mapping.

    Plain tokens are restored by expressions. Texts with tokens in a grammatical case, or whose masks
    are no tokens (pseudonyms, stars), go through an Arrow function that knows inflection.
    """
    rows = apart(rows, text_col, mappings_col)
    text, mappings = F.col(text_col), F.coalesce(F.col(mappings_col), F.array().cast(MAPPINGS))
    special = text.rlike(r"(?iu)<<\s*[A-Z]+\s*_\s*[0-9a-f]+\s*:\s*\p{L}+\s*>>") | F.exists(mappings, lambda m: ~m["masked"].rlike(TOKEN) & (m["masked"] != "[removed]"))
    cases = restored_in_cases(dictionaries)(F.when(special, text), F.when(special, mappings))
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    known = F.transform(mappings, lambda m: token_key(m["masked"]))
    base = lambda t: token_key(F.regexp_replace(t, r"(?u)\s*:\s*\p{L}+\s*>>$", ">>"))
    unresolved = let(known, lambda keys: F.size(F.filter(tokens, lambda t: ~F.array_contains(keys, base(t)))).cast("long"))
    return rows.withColumns({"restored_text": F.when(special, cases).otherwise(restored(text, mappings)), "unresolved": F.when(text.isNotNull(), unresolved).otherwise(0)})


def unmask_stored(requests: DataFrame, store: DataFrame, keys: tuple[str, ...] = ("system_id", "payload_id"), text_col: str = "text") -> DataFrame:
    """requests with restored_text, unresolved and found: whether the store has mappings under the keys."""
    held = store.select(*keys, F.col("mappings").alias("_mappings"), F.lit(True).alias("_known"))
    rows = requests.join(held, list(keys), "left")
    return unmask(rows, text_col, "_mappings").withColumn("found", F.coalesce("_known", F.lit(False))).drop("_mappings", "_known")


def case_hints(text: Column, mappings: Column, cases: Column) -> Column:
    """Every token of a name gets the case in which it stood; cases: map of token to case."""
    hinted = F.filter(mappings, lambda m: (m["type_id"] == "fio") & F.element_at(cases, m["masked"]).isNotNull())
    return F.aggregate(hinted, text, lambda acc, m: F.replace(acc, m["masked"], F.concat(F.regexp_replace(m["masked"], ">>$", ""), F.lit(":"), F.element_at(cases, m["masked"]), F.lit(">>"))))
