"""Detection of personal data, a row at a time: every text keeps its findings as an array.

Types with patterns are Column expressions: each pattern is guarded by a cheap test, its matches carry
their context windows, and scores follow the type's data: 0.4, +0.4 for a valid control sum, +0.3 for
context, with the special cases of cards, insurance numbers and passports. Types that only their
surroundings tell (names, places, dates, addresses, holders) come from one Arrow function that sees
only texts that may hold any. Nothing is shuffled, joined or exploded, so rows may share an id.
"""

from __future__ import annotations

import operator
import re
from dataclasses import replace
from functools import lru_cache, reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.validators import CHECKS, digits
from ..plans.allow import AllowList
from ..plans.dictionaries import Dictionaries
from ..plans.registry import CARD_MARKERS, GAP, Policy, Registry, RegistryError, TypeSpec
from .context import CONTEXT_HINT, CYRILLIC, DOCUMENT_MARKERS, ContextFinder
from .spans import SPAN, spans

CANDIDATE = ("doc_id", "type_id", "start", "end", "value", "confidence")
ENTITY = "struct<start:int,end:int,type_id:string,value:string,confidence:double>"
_INNER = "start:int,end:int,type_id:string,confidence:double,gone:boolean,historical:boolean,bound_start:int,bound_end:int"
INNER = f"struct<{_INNER}>"

# ---- fixed values: words that results depend on ----
#: Types whose context is the nearest marker on the left, within so many characters.
MARKER_TYPES, MARKER_WINDOW = ("passport", "inn", "subdivision_code", "driver_license", "cvv", "card_pin"), 200
SERIES = ("серия", "серии", "серию", "серий")
PASSPORT_WORDS = ("паспорт", "паспорта", "паспорте", "паспорту", "паспортом", "паспортные")
LICENSE_WORDS = ("права", "прав", "водительское", "водительского", "водительские", "водительских", "удостоверение", "удостоверения", "удостоверению", "удостоверением", "ву", "в/у")
SERVICE_MARKERS = ("горячая линия", "служба поддержки", "колл-центр")
NO_CVV = ("№", "номер", "заметка", "шаг", "ошибка", "код ошибки", "версия")
PIN_GAPS = ("", ":", "-", "=", "код", "-код", "-код:", "код:")
#: Patterns of a passport of fewer than ten digits, that need a marker.
SHORT_PASSPORT = (r"\b\d{6}\b", r"\b\d{4}\b", rf"\b\d{{2}}{GAP}\d{{2}}\b")
#: What stands between series and number in the longer ones.
NUMBER_WORD = "(?iu)номер|№"
# ---- end of fixed values ----


def _last(window: Column, pattern: str) -> Column:
    """Where the last match ends, 0 if there is none."""
    return F.length(F.regexp_extract(window, rf"(?s)^(.*(?:{pattern}))", 1))


def _is_license(window: Column) -> Column:
    """Whether the last document named is a licence; null if none is."""
    ends = F.struct(_last(window, T.parts_pattern(LICENSE_WORDS)).alias("a"), _last(window, T.parts_pattern(PASSPORT_WORDS)).alias("b"))
    return T.let(ends, lambda e: F.when(F.greatest(e["a"], e["b"]) > 0, e["a"] > e["b"]))


def _nearest(markers: tuple[TypeSpec, ...], before: Column, spec: TypeSpec) -> Column:
    """Whether the nearest label ("word:") or marker on the left speaks for the type."""
    owner = {w: t.id for t in markers for w in t.context_words}
    word = rf"(?<![\p{{L}}\p{{N}}])(?:{T.parts_pattern(owner)})(?![\p{{L}}\p{{N}}])"
    label = r"(?<![\p{L}\p{N}_])[а-яёa-z0-9\-]+\s*:"
    own, longest = F.lit(spec.id == "driver_license"), max(map(len, owner), default=0)

    def of_series(window: Column) -> Column:
        return F.coalesce(_is_license(window), F.lit(False)) == own

    def decided(e: Column) -> Column:
        head = F.substring(before, F.lit(1), e["label"])
        phrase = F.regexp_extract(head, r"([^.;\n!?]*)$", 1)
        by_label = F.when(T.contains_word(phrase, SERIES), of_series(head)).otherwise(T.contains_part(phrase, spec.context_words))
        tail = F.substring(F.substring(before, F.lit(1), e["marker"]), -longest - 1, longest + 1)  # the word, and what it borders on
        said = F.regexp_extract(tail, rf"({word})$", 1)
        by_marker = T.let(said, lambda w: F.when(w.isin(*SERIES), of_series(before)).otherwise(w.isin([w for w, t in owner.items() if t == spec.id])))
        return F.when(e["label"] > e["marker"], by_label).when(e["marker"] > 0, by_marker).otherwise(False)

    ends = F.struct(_last(before, label).alias("label"), _last(before, word).alias("marker"))
    return F.when(before.rlike(rf"{word}|{label}"), T.let(ends, decided)).otherwise(False)


def _context(markers: tuple[TypeSpec, ...], spec: TypeSpec, before: Column) -> Column:
    words = T.parts_pattern(spec.context_words)
    if spec.id == "cvv":
        labels = "|".join(re.escape(w) for w in sorted(NO_CVV, key=len, reverse=True))
        return F.substring(before, -60, 60).rlike(rf"(?:{words})(?=[^.!?\n0-9]{{0,30}}$)(?!\s*(?:\S+\s+){{3}}\S)(?![^\n]*(?:{labels})\s*$)")
    if spec.id == "card_pin":
        return F.substring(before, -60, 60).rlike(rf"(?:{words})(?=[^\n]{{0,12}}$)\s*(?:{'|'.join(re.escape(g) for g in sorted(PIN_GAPS, key=len, reverse=True))})\s*$")
    if spec.id in MARKER_TYPES:
        return _nearest(markers, before, spec)
    return T.contains_part(F.substring(before, -spec.context_window, spec.context_window), spec.context_words)


def _judged(spec: TypeSpec, policy: Policy, s: Column) -> Column:
    """The score of a match with value, before, after, context; null: refused."""
    value, before, after, context = s["value"], s["before"], s["after"], s["context"]
    n = F.length(digits(value))
    valid = CHECKS[spec.validator](value) if spec.validator != "none" else F.lit(True)
    plus = F.when(context, 0.3).otherwise(0.0)
    sure = F.least(0.8 + plus, F.lit(1.0))
    card = F.concat(F.substring(before, -40, 40), F.lit("\n"), F.substring(after, 1, 39)).rlike(rf"(?<!не является )(?:{T.parts_pattern(CARD_MARKERS)})")
    if spec.id == "secret":
        score = F.when(value.rlike("[0-9]"), 0.9)
    elif spec.id == "snils":
        score = F.when(valid, 0.9).when(context, 0.7)
    elif spec.id == "card_number":
        score = F.when((n == 15) & ~card, None).when(valid, sure).when(card, 0.6)
    elif spec.validator != "none":
        score = F.when(valid, sure)
    else:
        score = 0.4 + plus
    if spec.id in ("passport", "driver_license"):
        other = F.coalesce(_is_license(before) != F.lit(spec.id == "driver_license"), F.lit(False))
        score = F.when(~other, score)
    if spec.id == "passport":
        around = F.concat(F.regexp_extract(before, r"[0-9./-]*$", 0), value, F.regexp_extract(after, r"^[0-9./-]*", 0))
        blocked = ((n < 10) & ~context) | T.contains_word(F.substring(before, -60, 60), DOCUMENT_MARKERS) | T.let(around, CHECKS["date"])
        score = F.when(~blocked, F.when(value.rlike(r"^\d{2} \d{2} \d{6}$") & context, 0.9).otherwise(score))
    if spec.id == "phone":
        service = T.contains_word(F.concat(F.substring(before, -40, 40), F.lit("\n"), F.substring(after, 1, 39)), SERVICE_MARKERS)
        score = F.when(~(digits(value).rlike("^.800") & service), score)
    w = spec.context_window
    against = T.contains_word(F.substring(before, -w, w), spec.against) | T.contains_word(F.substring(after, 1, w - 1), spec.against)
    for allowed in policy.allow_substrings:
        against = against | F.lit(allowed.lower()).contains(F.lower(value))
    score = F.when(~against, score)
    return F.when(context, score) if spec.context_required else score


def _enough(score: Column, policy: Policy) -> Column:
    return score + 1e-6 >= policy.min_confidence if policy.trap_policy == "prefer_mask" else score > policy.min_confidence + 1e-6


def _matches(spec: TypeSpec, normal: Column, low: Column) -> Column:
    """array<struct<start, end, value>> of all patterns; each pattern behind a cheap test that every text with a match passes."""
    none = F.array().cast(SPAN)
    marked = T.contains_part(low, spec.context_words) if spec.context_words else F.lit(True)
    if spec.context_words and all(CYRILLIC.search(w) for w in spec.context_words):
        marked = low.rlike(CYRILLIC.pattern) & marked
    hinted = F.lit(True) if not spec.hint else normal.rlike(spec.hint)

    def test_of(p: str) -> tuple[str, ...]:
        """What a text must have beside the hint; patterns in a row that ask for the same share one test."""
        if spec.context_required or (spec.id == "passport" and p in SHORT_PASSPORT):
            return ("marked",)
        if spec.id == "passport":  # all but the short ones have six digits in a row
            return (r"\d{6}", NUMBER_WORD) if re.search(NUMBER_WORD, p) else (r"\d{6}",)
        return ()

    all_found = []
    for asked, patterns in groupby(spec.patterns, test_of):
        test = reduce(operator.and_, [marked if a == "marked" else normal.rlike(a) for a in asked], hinted)
        each = F.flatten(F.array(*[F.coalesce(spans(normal, p, spec.group), none) for p in patterns]))
        all_found.append(F.when(test, each).otherwise(none))
    return F.filter(F.flatten(F.array(*all_found)), lambda s: s["end"] > s["start"])


@lru_cache(256)
def _found(application: str, spec: TypeSpec, markers: tuple[TypeSpec, ...], least: float, trap_policy: str, allow_substrings: tuple[str, ...]) -> Column:
    """array<INNER> of a type with patterns, out of the columns _text, _normal, _low and their chunks. Made once for an application, as thousands of calls make it."""
    policy = Policy(min_confidence=least, trap_policy=trap_policy, allow_substrings=allow_substrings)
    text, low, rank = F.col("_text"), F.col("_low"), F.lit(spec.id)
    matches = _matches(spec, F.col("_normal"), low)
    if spec.validator in ("inn", "phone", "email"):  # refused without a valid value, whatever stands around
        matches = F.filter(matches, lambda s: CHECKS[spec.validator](s["value"]))

    def seen(s: Column) -> Column:
        start, end = s["start"], s["end"]
        left, right = F.least(start, F.lit(MARKER_WINDOW)), F.least(F.col("_length") - end, F.lit(spec.context_window))
        return F.struct(
            start.alias("start"), end.alias("end"), T.piece(text, F.col("_chunks"), start, end - start).alias("value"),
            T.piece(low, F.col("_low_chunks"), start - left, left).alias("before"), T.piece(low, F.col("_low_chunks"), end, right).alias("after"),
        )

    with_context = F.transform(F.transform(matches, seen), lambda s: F.struct(s["start"], s["end"], s["value"], s["before"], s["after"], _context(markers, spec, s["before"]).alias("context")))
    scored = F.transform(with_context, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), _judged(spec, policy, s).alias("confidence")))
    kept = F.filter(scored, lambda s: _enough(s["confidence"], policy))
    no, nothing = F.lit(False), F.lit(None).cast("int")
    return F.transform(kept, lambda s: F.struct(s["start"], s["end"], rank.alias("type_id"), F.round(s["confidence"], 2).alias("confidence"), no.alias("gone"), no.alias("historical"), nothing.alias("bound_start"), nothing.alias("bound_end")).cast(INNER))


def _context_found(finder: ContextFinder):
    """array<INNER> of the types that their surroundings tell, for texts that are not null."""

    @F.arrow_udf(f"array<{INNER}>")
    def found(texts: pa.Array, given: pa.Array) -> pa.Array:
        out = []
        for text, own in zip(texts.to_pylist(), given.to_pylist(), strict=True):
            spans_ = [] if text is None else finder.find(text, [(g["start"], g["end"], g["type_id"], g["confidence"]) for g in own or ()])
            out.append([{"start": e.start, "end": e.end, "type_id": e.type_id, "confidence": e.confidence, "gone": e.gone, "historical": e.historical, "bound_start": e.bound[0] if e.bound else None, "bound_end": e.bound[1] if e.bound else None} for e in spans_])
        fields = [("start", pa.int32()), ("end", pa.int32()), ("type_id", pa.string()), ("confidence", pa.float64()), ("gone", pa.bool_()), ("historical", pa.bool_()), ("bound_start", pa.int32()), ("bound_end", pa.int32())]
        return pa.array(out, pa.list_(pa.struct(fields)))

    return found


def settled(found: Column, order: dict[str, int]) -> Column:
    """Overlaps settled from left to right against the last span kept: addresses merge, longer wins, a card holder beats a name, then higher confidence."""
    rank = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    keyed = F.transform(found, lambda e: F.struct(e["start"], (e["start"] - e["end"]).alias("size"), (-e["confidence"]).alias("less"), F.element_at(rank, e["type_id"]).alias("rank"), e.alias("e")))
    state = F.struct(F.lit(None).cast(INNER).alias("last"), F.array().cast(f"array<{INNER}>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        last = acc["last"]
        apart = last.isNull() | (x["start"] >= last["end"])
        both = ~apart & (x["type_id"] == "address") & (last["type_id"] == "address")
        size, before = x["end"] - x["start"], last["end"] - last["start"]
        tie = F.when((x["type_id"] == "card_holder") & (last["type_id"] == "fio"), True).when((x["type_id"] == "fio") & (last["type_id"] == "card_holder"), False).otherwise(x["confidence"] > last["confidence"])
        wins = (size > before) | ((size == before) & tie)
        union = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), last["type_id"].alias("type_id"), F.greatest(last["confidence"], x["confidence"]).alias("confidence"), *[last[c].alias(c) for c in ("gone", "historical", "bound_start", "bound_end")])
        return F.struct(
            F.when(both, union).when(apart | wins, x).otherwise(last).alias("last"),
            F.when(apart & last.isNotNull(), F.array_append(acc["kept"], last)).otherwise(acc["kept"]).alias("kept"),
        )

    return F.aggregate(F.transform(F.array_sort(keyed), lambda k: k["e"]), state, step, lambda acc: F.when(acc["last"].isNull(), acc["kept"]).otherwise(F.array_append(acc["kept"], acc["last"])))


def _without_references(kept: Column) -> Column:
    """Without names of well-known persons, and without the old dates and birth places that belong to names that aren't masked."""

    def stays(e: Column, names: Column) -> Column:
        bound = e["bound_start"].isNotNull()
        date = (e["type_id"] == "birth_date") & e["historical"] & bound & ~F.exists(names, lambda n: n["start"] == e["bound_start"])
        place = (e["type_id"] == "birth_place") & bound & ~F.exists(names, lambda n: (n["start"] <= e["bound_start"]) & (n["end"] >= e["bound_end"]))
        return ~e["gone"] & ~date & ~place

    names_of = lambda k: F.filter(k, lambda e: (e["type_id"] == "fio") & ~e["gone"])
    return T.let(kept, lambda k: T.let(names_of(k), lambda names: F.filter(k, lambda e: stays(e, names))))


def apart(rows: DataFrame, *names: str) -> DataFrame:
    """The same rows, some columns behind a step that the optimizer neither merges projections nor pushes filters across.

    A filter on a column that costs much would else be copied below every projection that it stands on, with
    all that they compute, and Python functions on both sides would have the expressions between them copied.
    """
    others = [c for c in rows.columns if c not in names]
    held = rows.select(*others, F.explode_outer(F.array(F.struct(*names))).alias("_step"))
    return held.select(*others, *[F.col("_step")[n].alias(n) for n in names])


def with_found(rows: DataFrame, registry: Registry, policy: Policy, finder: ContextFinder | None) -> DataFrame:
    """rows with _text, and _found: array<INNER>, all spans that score enough."""
    return apart(found_steps(rows, registry, policy, finder), "_chunks", "_found")


def found_steps(rows, registry: Registry, policy: Policy, finder: ContextFinder | None):
    """The columns of with_found, one after the other; rows: a DataFrame, or what notes its columns (sql.Steps)."""
    finder = _finder(registry, policy, finder)
    out = _given_steps(rows, registry, policy, finder is not None)
    if finder is not None:
        out = out.withColumn("_told", _told(finder, F.col("_given")))
        out = out.withColumn("_found", F.concat("_given", F.coalesce("_told", F.array().cast(f"array<{INNER}>")))).drop("_told")
    else:
        out = out.withColumnRenamed("_given", "_found")
    return out.drop("_normal", "_low", "_low_chunks", "_length", "_given")


def _finder(registry: Registry, policy: Policy, finder: ContextFinder | None) -> ContextFinder | None:
    """None if no type of the policy needs one."""
    enabled = registry.enabled(policy)
    if not any(s.found_by == "context" for s in enabled) and not {"cvv", "card_pin"} & {s.id for s in enabled}:
        return None
    return finder or ContextFinder(registry, policy, Dictionaries.built_in())


def _told(finder: ContextFinder, given: Column) -> Column:
    hinted = F.when(F.col("_normal").rlike(CONTEXT_HINT), F.col("_normal"))
    return _context_found(finder)(hinted, F.when(hinted.isNotNull(), given))


def _given_steps(rows, registry: Registry, policy: Policy, with_context: bool):
    """rows with _normal, _low, their chunks, and _given: array<INNER> of the patterns' types."""
    native = [s for s in registry.enabled(policy) if s.found_by == "patterns" and s.patterns]
    none = F.array().cast(f"array<{INNER}>")
    # a text that no hint lets through costs the hints and nothing more
    hints = [s.hint for s in native] + ([CONTEXT_HINT] if with_context else [])
    some = reduce(operator.or_, [F.col("_normal").rlike(h) for h in dict.fromkeys(hints)], F.lit(False)) if all(hints) else F.col("_normal").isNotNull()
    out = rows.withColumn("_normal", T.normalize_mixed(F.col("_text")))
    out = out.withColumn("_low", F.when(some, T.lowered(F.col("_normal"))))
    out = out.withColumns({"_chunks": F.when(F.col("_low").isNotNull(), T.chunked(F.col("_text"))), "_low_chunks": T.chunked(F.col("_low")), "_length": F.length("_low")})
    application, markers = rows.sparkSession.sparkContext.applicationId, tuple(registry.types[t] for t in MARKER_TYPES if t in registry.types)
    of_type = [_found(application, s, markers, policy.min_confidence, policy.trap_policy, policy.allow_substrings) for s in native]
    given = F.flatten(F.array(*of_type)) if native else none
    return out.withColumn("_given", F.coalesce(F.when(F.col("_low").isNotNull(), given), none))


def entity_steps(found, registry: Registry, overlaps: bool):
    """found with _entities: array<ENTITY> in text order."""
    order = {t: k for k, t in enumerate(registry.types)}
    kept = F.col("_found") if overlaps else _without_references(settled(F.col("_found"), order))
    value = lambda e: T.piece(F.col("_text"), F.col("_chunks"), e["start"], e["end"] - e["start"])
    out = found.withColumn("_kept", kept)
    return out.withColumn("_entities", F.transform("_kept", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["type_id"].alias("type_id"), value(e).alias("value"), e["confidence"].alias("confidence")))).drop("_found", "_kept")


def with_entities(docs: DataFrame, registry: Registry | None = None, policy: Policy | None = None, finder: ContextFinder | None = None, text_col: str = "text", overlaps: bool = False) -> DataFrame:
    """(_row: the input's columns, _text, _chunks, _entities: array<ENTITY> in text order). overlaps: all that scores enough, unsettled."""
    registry, policy = registry or Registry(), policy or Policy()
    rows = docs.select(F.struct("*").alias("_row"), F.col(text_col).cast("string").alias("_text"))
    return apart(entity_steps(with_found(rows, registry, policy, finder), registry, overlaps), "_chunks", "_entities")


def _exploded(rows: DataFrame, id_col: str) -> DataFrame:
    each = rows.select(F.col("_row")[id_col].alias(id_col), F.explode("_entities").alias("_e"))
    return each.select(id_col, "_e.type_id", "_e.start", "_e.end", "_e.value", "_e.confidence")


def candidates(docs: DataFrame, registry: Registry | None = None, policy: Policy | None = None, finder: ContextFinder | None = None) -> DataFrame:
    """(doc_id, type_id, start, end, value, confidence) of every match that scores enough; docs: doc_id, text."""
    return _exploded(with_entities(docs, registry, policy, finder, overlaps=True), "doc_id")


def detect(docs: DataFrame, registry: Registry | None = None, policy: Policy | None = None, finder: ContextFinder | None = None) -> DataFrame:
    """As candidates, overlaps settled."""
    return _exploded(with_entities(docs, registry, policy, finder), "doc_id")


def detect_under(docs: DataFrame, policies: dict[str, Policy], registry: Registry | None = None) -> DataFrame:
    """(doc_id, policy, type_id, start, end, value, confidence) as detect finds them under each policy, named by its key.

    Policies differ by min_confidence and trap_policy only, so texts are read and their patterns matched once, at the
    least of the thresholds; what scores enough, what surroundings tell and how overlaps settle is each policy's own.
    """
    registry = registry or Registry()
    alike = lambda p: replace(p, min_confidence=min(q.min_confidence for q in policies.values()), trap_policy="prefer_mask")
    least = alike(next(iter(policies.values())))
    if any(alike(p) != least for p in policies.values()):
        raise RegistryError("policies differ by more than thresholds")
    rows = docs.select(F.struct("*").alias("_row"), F.col("text").cast("string").alias("_text"))
    finders = [_finder(registry, p, None) for p in policies.values()]
    out = _given_steps(rows, registry, least, any(finders))
    enough_for = lambda p: lambda e: _enough(e["confidence"], p)
    own = [F.filter("_given", enough_for(p)) for p in policies.values()]
    if any(finders):
        out = out.withColumns({f"_told_{k}": _told(f, g) for k, (f, g) in enumerate(zip(finders, own, strict=True))})
        own = [F.concat(g, F.coalesce(f"_told_{k}", F.array().cast(f"array<{INNER}>"))) for k, g in enumerate(own)]
    found = F.array(*[F.struct(F.lit(name).alias("policy"), g.alias("found")) for name, g in zip(policies, own, strict=True)])
    each = apart(out.select("_row", "_text", "_chunks", found.alias("_each")), "_chunks", "_each").withColumn("_of", F.explode("_each"))
    each = each.select("_row", "_text", "_chunks", F.col("_of.policy").alias("_policy"), F.col("_of.found").alias("_found"))
    each = apart(entity_steps(each, registry, False), "_chunks", "_entities").select(F.col("_row")["doc_id"].alias("doc_id"), F.col("_policy").alias("policy"), F.explode("_entities").alias("_e"))
    return each.select("doc_id", "policy", "_e.type_id", "_e.start", "_e.end", "_e.value", "_e.confidence")


def finder_for(registry: Registry, policy: Policy, dictionaries: Dictionaries | None = None, allow: AllowList | None = None, as_of_year: int = 2026) -> ContextFinder:
    """What finds names, places, dates and addresses, with one's own word lists and allow-list."""
    if as_of_year < 1900:
        raise RegistryError("as_of_year is no year")
    return ContextFinder(registry, policy, dictionaries or Dictionaries.built_in(), allow or AllowList(), as_of_year)
