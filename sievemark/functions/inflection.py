"""Cases of single words as Column expressions, from the paradigms: no Python per row.

These take a word in the nominative, lower case, and its kind; `morphology` finds the nominative of words in texts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .morphology import CASE_NAMES, CASES, COUNTRIES, GIVEN, MEN_IN_A, PATRONYMICS, PLACES, SURNAME_GROUPS, SURNAMES, UNCHANGED

KINDS = {"given": GIVEN, "patronymic": PATRONYMICS, "place": PLACES, "country": COUNTRIES, "surname_male": SURNAMES["male"], "surname_female": SURNAMES["female"]}


def _of_paradigms(word: Column, paradigms) -> Column:
    out = None
    for p in paradigms:
        fits = word.endswith(p.cut) & word.rlike(p.lemma)
        stem = F.substring(word, F.lit(1), F.length(word) - len(p.cut))
        forms = F.array(*[F.concat(stem, F.lit(e)) for e in p.six])
        out = F.when(fits, forms) if out is None else out.when(fits, forms)
    return out


def six_forms(word: Column, kind: str) -> Column:
    """The word in the six cases, in the order of CASES; null where no paradigm fits. Surnames that never change repeat themselves."""
    forms = _of_paradigms(word, KINDS[kind])
    if kind.startswith("surname"):
        return F.when(word.rlike(UNCHANGED.pattern) & ~word.rlike("(ова|ева|ёва|ина|ына)$"), F.array_repeat(word, len(CASES))).otherwise(forms)
    return forms


def inflected(word: Column, kind: str, case: Column) -> Column:
    """The word in a case of CASES."""
    at = F.array_position(F.array(*[F.lit(c) for c in CASES]), case).cast("int")
    return F.when(at > 0, F.try_element_at(six_forms(word, kind), at))


def case_of(name: Column) -> Column:
    """A case by its name in a token, Russian or Latin; null if it is none."""
    table = F.create_map(*[F.lit(x) for kv in CASE_NAMES.items() for x in kv])
    return F.try_element_at(table, F.lower(F.trim(name)))


def gender(given: Column, patronymic: Column) -> Column:
    """male or female, by the patronymic if there is one, else by the given name; both in the nominative."""
    by_name = F.when(given.isin(*MEN_IN_A) | ~given.rlike("[ая]$"), "male").otherwise("female")
    return F.when(patronymic.isNotNull(), F.when(patronymic.endswith("ич"), "male").otherwise("female")).when(given.isNotNull(), by_name)


def surname_group(surname: Column) -> Column:
    out, low = None, F.lower(surname)
    for name, ending in SURNAME_GROUPS:
        out = F.when(low.rlike(ending), name) if out is None else out.when(low.rlike(ending), name)
    return F.when(surname.isNotNull(), out.otherwise("indeclinable"))


def female_surname(male: Column) -> Column:
    return F.when(male.rlike("(ов|ёв|ев|ин|ын)$"), F.concat(male, F.lit("а"))).otherwise(F.regexp_replace(male, "(?<=[сц]к)ий$|[оы]й$", "ая"))


def patronymic(father: Column, sex: Column) -> Column:
    """The patronymic of a father's name."""
    stem = F.substring(father, F.lit(1), F.length(father) - 1)
    ends = lambda his, her: F.when(sex == "female", her).otherwise(his)
    return F.when(father.rlike("[йь]$"), F.concat(stem, ends("евич", "евна"))).when(father.rlike("[ая]$"), F.concat(stem, ends("ич", "ична"))).otherwise(F.concat(father, ends("ович", "овна")))


def styled(original: Column, phrase: Column) -> Column:
    """The phrase's words in the letter style of the original's, word by word: all capitals, a capital first, or as they are; the shorter list decides."""
    letters = lambda w: F.regexp_replace(w, r"\P{L}", "")

    def of(o: Column, w: Column) -> Column:
        upper = (letters(o) != "") & (F.upper(letters(o)) == letters(o))
        first = letters(o).rlike(r"^\p{Lu}")
        return F.when(upper, F.upper(w)).when(first, F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))).otherwise(w)

    split = lambda x: F.filter(F.split(F.trim(x), r"\s+"), lambda w: w != "")
    pairs = F.filter(F.arrays_zip(split(original).alias("o"), split(phrase).alias("w")), lambda p: p["o"].isNotNull() & p["w"].isNotNull())
    return F.array_join(F.transform(pairs, lambda p: of(p["o"], p["w"])), " ")
