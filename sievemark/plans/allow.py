"""Allow-lists: well-known persons and organisations that are nobody's personal data."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..functions.morphology import CASES, Morphology


@dataclass(frozen=True)
class AllowList:
    public_persons: tuple[str, ...] = ()
    organizations: tuple[str, ...] = ()

    def people(self, morphology: Morphology) -> People:
        return People(self.public_persons, morphology)


class People:
    """Well-known persons in all cases."""

    def __init__(self, persons, morphology: Morphology):
        self.forms: list[tuple[list[frozenset[str]], set[str], str]] = []
        for name in persons:
            cases = [f.lower() for c in CASES if (f := morphology.inflect(name, "person", c))] or [name.lower()]
            parsed = morphology.person(name)
            initials = "".join(parsed.part(k)[:1] for k in ("given", "patronymic")) if parsed else ""
            self.forms.append(([frozenset(c.split()) for c in cases], {c.split()[-1] for c in cases}, initials))
        self.surnames = frozenset(s for _, own, _ in self.forms for s in own)
        self.words = frozenset(w for cases, _, _ in self.forms for c in cases for w in c)

    def matches(self, value: str) -> bool:
        """Two or more words of one form of a person, surname last, or the surname with fitting initials."""
        words, initials = [], ""
        for part in re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)*", value.lower()):
            if len(part) == 1:
                initials += part
            else:
                words.append(part)
        if not words or any(w not in self.words for w in words):
            return False
        surname = words[-1]
        for cases, surnames, own in self.forms:
            if surname in surnames:
                if len(words) > 1 and any(set(words) <= c for c in cases):
                    return True
                if (len(initials) == 1 and initials in own) or (len(initials) == 2 and initials == own):
                    return True
        return False
