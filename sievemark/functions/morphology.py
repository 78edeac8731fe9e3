"""Russian cases of names, places, countries and streets.

A paradigm says what a nominative looks like, which ending of it changes, and the six endings it
changes to. Inflecting takes the first paradigm that fits; the nominative of any form is found by
trying the endings of every paradigm, longest first, and asking whether what comes out is a word
(by dictionary) or looks like one. Pure functions of a value; engines call them in batches.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from ..plans.dictionaries import Dictionaries

CASES = ("nom", "gen", "dat", "acc", "ins", "prep")
# fixed values: names of the cases in tokens
CASE_NAMES = {
    "им": "nom", "nom": "nom", "род": "gen", "gen": "gen", "дат": "dat", "dat": "dat", "вин": "acc", "acc": "acc",
    "твор": "ins", "тв": "ins", "ins": "ins", "пр": "prep", "предл": "prep", "prep": "prep",
}
SHORT_CASE = {"nom": "им", "gen": "род", "dat": "дат", "acc": "вин", "ins": "твор", "prep": "пр"}
CONSONANT = "[бвгджзйклмнпрстфхцчшщьъ]"
PATRONYMIC = re.compile("(ович|евич|ич|овна|евна|ична|инична)$")


@dataclass(frozen=True)
class Paradigm:
    """How words whose nominative looks like `lemma` change: `cut`, their end, gives way to the endings of the six cases."""

    lemma: str
    cut: str
    six: tuple[str, ...]

    def fits(self, word: str) -> bool:
        return word.endswith(self.cut) and re.search(self.lemma, word) is not None

    def form(self, word: str, case: str) -> str:
        return word[: len(word) - len(self.cut)] + self.six[CASES.index(case)]

    def nominatives(self, word: str):
        """What the word may be a form of, by the longest ending first."""
        for ending in sorted(set(self.six), key=lambda e: (-len(e), e)):
            stem = word[: len(word) - len(ending)]
            if word.endswith(ending) and (stem or len(self.cut) > 2) and self.fits(stem + self.cut):
                yield stem + self.cut


def _exception(*forms: str) -> Paradigm:
    """A word of its own."""
    return Paradigm(f"^{forms[0]}$", forms[0], forms)


# ---- fixed values: the paradigms, first fit first ----
HARD, SOFT_I = ("", "а", "у", "а", "ом", "е"), ("ь", "и", "и", "ь", "ью", "и")
GIVEN = (
    _exception("лев", "льва", "льву", "льва", "львом", "льве"),
    _exception("павел", "павла", "павлу", "павла", "павлом", "павле"),
    _exception("пётр", "петра", "петру", "петра", "петром", "петре"),
    _exception("любовь", "любови", "любови", "любовь", "любовью", "любови"),
    Paradigm("ия$", "ия", ("ия", "ии", "ии", "ию", "ией", "ии")),
    Paradigm("[кгхжшщч]а$", "а", ("а", "и", "е", "у", "ой", "е")),
    Paradigm("а$", "а", ("а", "ы", "е", "у", "ой", "е")),
    Paradigm("я$", "я", ("я", "и", "е", "ю", "ей", "е")),
    Paradigm("й$", "й", ("й", "я", "ю", "я", "ем", "е")),
    Paradigm("ь$", "ь", ("ь", "я", "ю", "я", "ем", "е")),
    Paradigm(f"{CONSONANT}$", "", HARD),
)
PATRONYMICS = (Paradigm("ич$", "", ("", "а", "у", "а", "ем", "е")), Paradigm("(овна|евна|ична)$", "а", ("а", "ы", "е", "у", "ой", "е")))
SURNAMES = {
    "male": (
        Paradigm("(ов|ев|ёв|ин|ын)$", "", ("", "а", "у", "а", "ым", "е")),
        Paradigm("[сц]кий$", "ий", ("ий", "ого", "ому", "ого", "им", "ом")),
        Paradigm("ой$", "ой", ("ой", "ого", "ому", "ого", "ым", "ом")),
        Paradigm("ый$", "ый", ("ый", "ого", "ому", "ого", "ым", "ом")),
        Paradigm(f"{CONSONANT}$", "", HARD),
    ),
    "female": (
        Paradigm("(ова|ева|ёва|ина|ына)$", "а", ("а", "ой", "ой", "у", "ой", "ой")),
        Paradigm("ая$", "ая", ("ая", "ой", "ой", "ую", "ой", "ой")),
        Paradigm(f"{CONSONANT}$", "", ("", "", "", "", "", "")),
    ),
}
PLACES = (
    Paradigm("[оеиу]$", "", ("", "", "", "", "", "")),
    Paradigm("[кгхжшщч]а$", "а", ("а", "и", "е", "у", "ой", "е")),
    Paradigm("а$", "а", ("а", "ы", "е", "у", "ой", "е")),
    Paradigm("я$", "я", ("я", "и", "е", "ю", "ей", "е")),
    Paradigm("ь$", "ь", SOFT_I),
    Paradigm(f"{CONSONANT}$", "", ("", "а", "у", "", "ом", "е")),
)
COUNTRIES = (
    Paradigm("ия$", "ия", ("ия", "ии", "ии", "ию", "ией", "ии")),
    Paradigm("ь$", "ь", SOFT_I),
    Paradigm("[кгхжшщч]а$", "а", ("а", "и", "е", "у", "ой", "е")),
    Paradigm("а$", "а", ("а", "ы", "е", "у", "ой", "е")),
    Paradigm(f"{CONSONANT}$", "", ("", "а", "у", "", "ом", "е")),
    Paradigm("[оеиуы]$", "", ("", "", "", "", "", "")),
)
ADJECTIVES = (
    Paradigm("[кгх]ий$", "ий", ("ий", "ого", "ому", "ий", "им", "ом")),
    Paradigm("ий$", "ий", ("ий", "его", "ему", "ий", "им", "ем")),
    Paradigm("ый$", "ый", ("ый", "ого", "ому", "ый", "ым", "ом")),
    Paradigm("ая$", "ая", ("ая", "ой", "ой", "ую", "ой", "ой")),
    Paradigm("яя$", "яя", ("яя", "ей", "ей", "юю", "ей", "ей")),
)
#: Men whose names end like women's.
MEN_IN_A = ("илья", "никита", "кузьма", "фома", "лука", "савва")
PLACE_PREFIXES = ("г.", "город", "с.", "пос.", "дер.", "д.")
STREET_PREFIXES = ("ул.", "улица", "проспект", "пр.")
# ---- end of fixed values ----

UNCHANGED = re.compile("(ых|их|[оеиую]|[аеёиоуыэюя]а)$")


def case_of(name: str) -> str | None:
    """A case by its name in a token, Russian or Latin."""
    return CASE_NAMES.get(name.strip().lower())


def _first(paradigms, word: str, case: str) -> str | None:
    return next((p.form(word, case) for p in paradigms if p.fits(word)), None)


def _nominative(paradigms, word: str, known) -> str | None:
    """The nominative that `known` accepts; the word itself first."""
    if known(word):
        return word
    return next((n for p in paradigms for n in p.nominatives(word) if known(n)), None)


def _looks(paradigms, word: str) -> str | None:
    """The nominative by looks alone."""
    for p in paradigms:
        if p.fits(word):
            return word
        if (n := next(p.nominatives(word), None)) is not None:
            return n
    return None


# ---- style -----------------------------------------------------------------------------------


def _style(word: str):
    letters = [c for c in word if c.isalpha()]
    if letters and all(c.isupper() for c in letters):
        return str.upper
    if letters and letters[0].isupper():
        return lambda w: w[:1].upper() + w[1:]
    return lambda w: w


def styled(original: str, phrase: str) -> str:
    """The phrase's words in the letter style of the original's, word by word; the shorter list decides."""
    return " ".join(_style(o)(w) for o, w in zip(original.split(), phrase.split(), strict=False))


def _in_style(original: str, phrase: str) -> str:
    return styled(original, phrase) if len(original.split()) == len(phrase.split()) else phrase


# ---- persons ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Word:
    nominative: str
    kind: str  # initial, patronymic, given, surname


@dataclass(frozen=True)
class Person:
    words: tuple[Word, ...]
    gender: str | None

    def part(self, kind: str) -> str:
        return next((w.nominative for w in reversed(self.words) if w.kind == kind), "")


class Morphology:
    """Inflection with a set of dictionaries."""

    def __init__(self, dictionaries: Dictionaries):
        self.given = dictionaries.list("first_names")
        self.cities = dictionaries.list("cities")
        self.countries = dictionaries.list("countries")
        self.inflect = lru_cache(100_000)(self._inflect)

    def person(self, value: str) -> Person | None:
        """A name of one to three words, its words in the nominative."""
        spoken = value.split()
        if not 1 <= len(spoken) <= 3:
            return None
        words = []
        for w in (x.lower().rstrip(".") for x in spoken):
            if len(w) == 1:
                words.append(Word(w, "initial"))
            elif (n := _nominative(PATRONYMICS, w, lambda x: PATRONYMIC.search(x) is not None)) is not None:
                words.append(Word(n, "patronymic"))
            elif (n := _nominative(GIVEN, w, self.given.__contains__)) is not None:
                words.append(Word(n, "given"))
            else:
                words.append(Word(w, "surname"))
        gender = self._gender(words)
        return Person(tuple(Word(self._surname(w.nominative, gender), "surname") if w.kind == "surname" else w for w in words), gender)

    @staticmethod
    def _gender(words: list[Word]) -> str | None:
        patronymic = next((w.nominative for w in words if w.kind == "patronymic"), None)
        if patronymic:
            return "male" if patronymic.endswith("ич") else "female"
        given = next((w.nominative for w in words if w.kind == "given"), None)
        if given:
            return "male" if male_given(given) else "female"
        if any(w.kind == "surname" and re.search("(ова|ева|ёва|ина|ына|ая|яя)$", w.nominative) for w in words):
            return "female"
        return None

    @staticmethod
    def _surname(word: str, gender: str | None) -> str:
        for g in (gender,) if gender else ("male", "female"):
            if (n := _looks(SURNAMES[g], word)) is not None and not (UNCHANGED.search(word) and not re.search("(ова|ева|ёва|ина|ына|ого|ому)$|[уе]$", word)):
                return n
        return word

    def _person_word(self, word: Word, gender: str | None, case: str) -> str | None:
        if case == "nom" or word.kind == "initial":
            return word.nominative
        if word.kind == "patronymic":
            return _first(PATRONYMICS, word.nominative, case)
        if word.kind == "given":
            return _first(GIVEN, word.nominative, case)
        if UNCHANGED.search(word.nominative):
            return word.nominative
        for g in (gender,) if gender else ("male", "female"):
            if (form := _first(SURNAMES[g], word.nominative, case)) is not None:
                return form
        return None

    def person_case(self, value: str) -> str:
        """The case in which most words of a name stand."""
        person = self.person(value)
        if person is None:
            return "nom"
        votes = [0] * 6
        for spoken, word in zip(value.split(), person.words, strict=True):
            said = spoken.lower().rstrip(".")
            at = next((k for k, case in enumerate(CASES) if self._person_word(word, person.gender, case) == said), None)
            if at is not None:
                votes[at] += 1
        return CASES[votes.index(max(votes))]

    # ---- places ------------------------------------------------------------------------------

    def _place_nominative(self, word: str) -> str | None:
        known = _nominative(PLACES, word, self.cities.__contains__)
        if known is not None:
            return known
        # a word of no dictionary: by its looks, as a masculine or feminine form
        for ending, lemma in (("ом", ""), ("ой", "а"), ("ью", "ь"), ("а", ""), ("у", ""), ("е", ""), ("ы", "а"), ("и", "ь")):
            stem = word.removesuffix(ending)
            if stem != word and re.search(f"{CONSONANT}$", stem):
                return stem + lemma
        return word if re.search(f"{CONSONANT}$", word) else None

    def _place(self, value: str, case: str) -> str | None:
        words = value.split()
        head = []
        while words and words[0].lower() in PLACE_PREFIXES:
            head.append(words.pop(0))
        low = [w.lower() for w in words]
        if not low or len(head) + len(low) > 3:
            return None
        if len(low) == 1:
            nominative = self._place_nominative(low[0])
            out = _first(PLACES, nominative, case) if nominative else None
        else:
            adjective, noun = _looks(ADJECTIVES, low[0]), self._place_nominative(low[1])
            parts = (_first(ADJECTIVES, adjective, case), _first(PLACES, noun, case)) if adjective and noun else (None,)
            out = None if None in parts else " ".join(parts)
        return None if out is None else _in_style(value, " ".join([*head, out]))

    def place_case(self, value: str) -> str:
        """The case of a place, by its last word."""
        words = value.lower().split()
        nominative = (self._place_nominative(words[-1]) or words[-1]) if words else ""
        return next((c for c in CASES if words and _first(PLACES, nominative, c) == words[-1]), "nom")

    def city_forms(self, city: str) -> set[str]:
        """All cases of a city; of a name with hyphens, the first part may change too (Ростове-на-Дону)."""
        out = {f.lower() for c in CASES if (f := self.inflect(city, "place", c))} | {city}
        if "-" in city:
            first, rest = city.split("-", 1)
            out |= {f"{f}-{rest}".lower() for c in CASES if (f := self.inflect(first, "place", c))}
        return {x.replace("ё", "е") for x in out}

    # ---- countries and streets ---------------------------------------------------------------

    def _country_nominative(self, word: str) -> str | None:
        known = _nominative(COUNTRIES, word, self.countries.__contains__)
        if known is not None:
            return known
        for ending, lemma in (("ией", "ия"), ("ию", "ия"), ("ии", "ия"), ("ия", "ия"), ("ом", ""), ("ой", "а"), ("ью", "ь"), ("а", ""), ("у", ""), ("е", ""), ("ы", "а"), ("и", "ь")):
            stem = word.removesuffix(ending)
            if stem != word and re.search(f"{CONSONANT}$", stem):
                return stem + lemma
        return None

    def _country(self, value: str, case: str) -> str | None:
        low = value.lower().split()
        if not low:
            return None
        if len(low) == 1:
            nominative = self._country_nominative(low[0])
            out = _first(COUNTRIES, nominative, case) if nominative else None
        elif re.fullmatch("республик(а|и|е|у|ой)", low[0]):
            out = " ".join([_first(COUNTRIES, "республика", case), *value.split()[1:]])
        elif len(low) == 2:
            adjective, noun = _looks(ADJECTIVES, low[0]), self._country_nominative(low[1])
            parts = (_first(ADJECTIVES, adjective, case), _first(COUNTRIES, noun, case)) if adjective and noun else (None,)
            out = None if None in parts else " ".join(parts)
        else:
            out = None
        return None if out is None else _in_style(value, out)

    def _street(self, value: str, case: str) -> str | None:
        """Only an adjective changes (Садовая); a name in the genitive stays (Пушкина)."""
        words = value.split()
        head = []
        while words and words[0].lower() in STREET_PREFIXES:
            head.append(words.pop(0))
        low = [w.lower() for w in words]
        if not low:
            return None
        adjective = low[0] if re.search("(ий|ый|ая|яя)$", low[0]) else _looks(ADJECTIVES, low[0]) if re.search("(ой|ую|ей|юю|ого|его|ому|ему|им|ым|ом|ем)$", low[0]) else None
        if adjective is None:
            return value
        out = [_first(ADJECTIVES, adjective, case)]
        if len(low) > 1:
            out.append(_first(PLACES, self._place_nominative(low[1]) or low[1], case))
        return None if None in out else _in_style(value, " ".join([*head, *out]))

    # ---- one door ----------------------------------------------------------------------------

    def _inflect(self, value: str, kind: str, case: str) -> str | None:
        """The value in a case; None where that isn't known for sure. kind: person, place, country, street."""
        letters = [c for c in value.lower() if c.isalpha()]
        if not letters or any(not ("а" <= c <= "я" or c == "ё") for c in letters):
            return None
        if kind == "person":
            person = self.person(value)
            if person is None:
                return None
            if all(w.kind == "initial" for w in person.words):
                return value
            words = [spoken if w.kind == "initial" else self._person_word(w, person.gender, case) for spoken, w in zip(value.split(), person.words, strict=True)]
            return None if None in words else styled(value, " ".join(words))
        return {"place": self._place, "country": self._country, "street": self._street}[kind](value, case)


def male_given(name: str) -> bool:
    return name in MEN_IN_A or not name.endswith(("а", "я"))


# fixed values: groups of surnames that are replaced by one another
SURNAME_GROUPS = (
    ("ov", "(ова|ева|ёва|ов|ев|ёв)$"), ("in", "(ина|ына|ин|ын)$"), ("sky", "(ская|цкая|ский|цкий)$"), ("oy", "(ая|яя|ой|ый)$"), ("enko", "енко$"), ("ko", "ко$"),
    ("uk", "(ук|юк)$"), ("yan", "ян$"), ("shvili", "(швили|дзе)$"), ("ikh", "(их|ых)$"), ("consonant", f"{CONSONANT}$"),
)


def surname_group(surname: str) -> str:
    return next((name for name, ending in SURNAME_GROUPS if re.search(ending, surname.lower())), "indeclinable")


def female_surname(male: str) -> str:
    if re.search("(ов|ёв|ев|ин|ын)$", male):
        return male + "а"
    return re.sub("(?<=[сц]к)ий$|[оы]й$", "ая", male)


def patronymic(name: str, gender: str | None) -> str:
    """The patronymic of a father's name."""
    female = gender == "female"
    if name.endswith(("й", "ь")):
        return name[:-1] + ("евна" if female else "евич")
    if name.endswith(("а", "я")):
        return name[:-1] + ("ична" if female else "ич")
    return name + ("овна" if female else "ович")
