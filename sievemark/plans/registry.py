"""Declarative types of personal data and tenant policies; adding a type needs data only."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

#: An ASCII word border, so that a Cyrillic letter beside a digit is one. Patterns write it as \b.
BORDER = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"

# ---- fixed values: patterns, context words and markers that results depend on ----
GAP = r"(?:\s*[-./]\s*|\s+)"
NON_PII_MARKERS = (
    "поэт", "писатель", "писательница", "композитор", "художник", "учёный", "режиссёр", "актёр", "актриса", "президент", "император", "царь", "князь", "памятник", "музей",
    "улица имени", "площадь имени", "роман", "стихотворение", "произведение", "автор", "книга", "герой", "персонаж", "фильм", "лекция о", "фильм о", "книга о", "биография", "умер",
    "скончался", "отделение", "офис", "филиал", "головной офис", "адрес банка", "юридический адрес", "пункт выдачи", "адрес кремля", "горячая линия", "приёмная", "пример", "тест",
    "тестовый", "образец", "шаблон",
)
PII_MARKERS = (
    "клиент", "клиентка", "гражданин", "гражданка", "заявитель", "заёмщик", "держатель", "пользователь", "сотрудник", "сотрудница", "абонент", "пациент", "фио", "паспорт", "родился",
    "родилась", "проживает", "зарегистрирован", "прописан", "телефон", "тел", "прошу", "мой", "моя", "мне", "я",
)
PLACE_MARKERS = ("г.", "город", "с.", "пос.", "обл.", "область", "край", "респ.", "деревня")
CITY_MARKERS = ("г", "город")
ABBREVIATIONS = ("г", "с", "п", "пос", "обл", "ул", "пер", "наб", "ш", "б-р", "пл", "пр", "д", "к", "стр", "кв", "оф", "пом", "корп", "респ", "край")
ISSUER_PREFIXES = (
    "оуфмс", "уфмс", "омвд", "умвд", "овд", "гу мвд", "гувм", "мвд", "тп", "овм", "отдел полиции", "отделом", "отделение", "отделением", "паспортный стол", "управа", "управлением", "мфц",
)
ADDRESS_SEPARATORS = (",", "г.", "г")
BIRTH_MARKERS = ("родился", "родилась", "дата рождения", "д.р", "г.р")
COUNTRY_SUFFIXES = ("ии", "а", "и", "ы", "я", "ов", "ев")
EMAIL_DOMAINS = ("example.com", "mail.ru", "yandex.ru", "gmail.com")
CARD_MARKERS = ("карта", "карты", "карте", "карту", "картой", "картою", "картам", "картами", "картах", "карточка", "карточки", "карточке", "карточку", "карточкой", "card", "номер карты", "№ карты")
DOOR_MARKERS = ("домофон", "домофона", "подъезд", "калитк", "сейф", "сигнализац", "wi-fi", "вай-фай", "wifi", "роутер", "замок", "замка", "двер")
DATES = (r"\b\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b", r"\b\d{4}-\d{2}-\d{2}\b", r"\b\d{4}[./]\d{1,2}[./]\d{1,2}\b", r"\b\d{1,2}\s+[а-яё]+\s+\d{2,4}\b", r"(?<!\w)[а-яё]+\s+[а-яё]+\s+\d{2,4}(?!\w)")
DATE_SUFFIXES = (" г.", " года")


class RegistryError(ValueError):
    """A type or policy that can't be used; names what is wrong, never a value."""


@dataclass(frozen=True)
class TypeSpec:
    id: str
    token_label: str
    patterns: tuple[str, ...] = ()
    context_words: tuple[str, ...] = ()
    context_window: int = 40
    context_required: bool = False
    enabled_by_default: bool = True
    validator: str = "none"
    mask: str = "token"
    stars_keep_prefix: int = 0
    stars_keep_suffix: int = 0
    companions: tuple[str, ...] = ()
    non_pii_markers: tuple[str, ...] | None = None
    group: int = 0  # of the pattern, that is the span
    hint: str = ""  # a cheap native test that every text with a match passes
    found_by: str = "patterns"  # or "context": by names, places and their surroundings
    split_components: bool = False  # of an address, each value is masked by itself
    pii_context: tuple[str, ...] = ()
    non_pii_context: tuple[str, ...] = ()
    pii_markers: tuple[str, ...] = ()
    strong_markers: tuple[str, ...] = ()
    date_suffixes: tuple[str, ...] = ()
    patronymic_suffixes: tuple[str, ...] = ()
    surname_suffixes: tuple[str, ...] = ()
    first_name_case_endings: tuple[str, ...] = ()
    surname_case_suffixes: tuple[str, ...] = ()

    @property
    def requires_companion(self) -> bool:
        return bool(self.companions)

    @property
    def against(self) -> tuple[str, ...]:
        """Words near by which a value is none: the type's own, or its context's and those of all types."""
        return self.non_pii_markers if self.non_pii_markers is not None else tuple(dict.fromkeys((*self.non_pii_context, *NON_PII_MARKERS)))

    @property
    def speaking_for(self) -> tuple[str, ...]:
        """Words near that speak for personal data."""
        return self.pii_markers or self.pii_context or PII_MARKERS


TYPES = (
    TypeSpec(
        "fio", "FIO", (r"\b[A-Z][a-z]+ [A-Z][a-z]+ [A-Z][a-z]*(?:ovich|evich|ovna|evna|ichna|ich)\b",), ("клиент", "гражданин", "физлицо", "заявитель", "ф.и.о", "фио"), found_by="context",
        pii_context=("клиент", "гражданин", "заявитель", "пациент", "абонент", "заёмщик", "держатель", "пользователь", "сотрудник", "фио", "паспорт", "родился", "проживает", "зарегистрирован", "телефон", "прошу", "мой", "моя", "меня", "зовут"),
        non_pii_context=("поэт", "писатель", "композитор", "художник", "учёный", "режиссёр", "актёр", "президент", "памятник", "музей", "улица имени", "роман", "стихотворение", "произведение", "автор", "книга"),
        patronymic_suffixes=("ович", "евич", "ич", "овна", "евна", "ична", "инична"), surname_suffixes=("ов", "ев", "ин", "ын", "ский", "цкий", "ова", "ева", "ина", "ская", "цкая", "ко", "ук", "юк", "ян", "дзе"),
        first_name_case_endings=("у", "ю", "а", "я", "е", "ом", "ем", "ой", "ей", "ым", "им", "ого", "ему"), surname_case_suffixes=("ову", "еву", "ину", "ым", "ой", "овой", "евой", "иной", "ского", "скому", "ской"),
    ),
    TypeSpec("birth_date", "BDATE", DATES, ("родился", "родилась", "дата рождения", "д.р", "г.р", "др:", "day of birth", "рождения", "года рождения", "год рождения", "г. р"), found_by="context", date_suffixes=DATE_SUFFIXES),
    TypeSpec("birth_place", "BPLACE", (), ("место рождения", "родился", "родилась", "уроженец", "уроженка"), found_by="context", strong_markers=("место рождения", "уроженец", "уроженка")),
    TypeSpec("passport", "PASSPORT", (
        rf"\b\d{{4}}{GAP}\d{{6}}\b", rf"\b\d{{2}}{GAP}\d{{2}}{GAP}\d{{6}}\b", r"\b\d{10}\b", r"\b\d{6}\b", r"\b\d{4}\b", rf"\b\d{{2}}{GAP}\d{{2}}\b", rf"\b\d{{4}}{GAP}номер{GAP}\d{{6}}\b",
        rf"\b\d{{2}}{GAP}\d{{2}}{GAP}номер{GAP}\d{{6}}\b", rf"\b\d{{4}}{GAP}№{GAP}\d{{6}}\b", rf"\b\d{{2}}{GAP}\d{{2}}{GAP}а номер{GAP}\d{{6}}\b", rf"\b\d{{2}}{GAP}\d{{2}}{GAP}и номер{GAP}\d{{6}}\b", rf"\b\d{{2}}{GAP}\d{{2}}[,\s]+номер\s*:?\s*\d{{6}}\b",
    ), ("паспорт", "паспорта", "паспорте", "паспорту", "паспортом", "паспортные", "серия", "серии", "серию", "серий", "паспортные данные"), stars_keep_prefix=2, stars_keep_suffix=2, hint=r"\d"),
    TypeSpec("citizenship", "CITIZEN", (), ("гражданство", "гражданин", "гражданка"), found_by="context"),
    TypeSpec("passport_issuer", "PASSISS", (), ("выдан", "выдано", "кем выдан", "орган выдачи"), found_by="context"),
    TypeSpec("subdivision_code", "SUBDIV", (r"\b\d{3}-\d{3}\b",), ("код подразделения", "к/п", "подразделения"), context_required=True, hint=r"\d-\d"),
    TypeSpec("passport_issue_date", "ISSDATE", DATES, ("дата выдачи", "выдан", "выдана", "выдано", "выдачи"), found_by="context", date_suffixes=DATE_SUFFIXES),
    TypeSpec("driver_license", "DRIVLIC", (
        rf"\b\d{{2}}{GAP}\d{{2}}{GAP}\d{{6}}\b", rf"\b\d{{4}}{GAP}\d{{6}}\b", rf"\b\d{{2}}{GAP}[А-ЯЁ]{{2}}{GAP}\d{{6}}\b", r"\b\d{6}\b", r"\b\d{4}\b", rf"\b\d{{2}}{GAP}\d{{2}}\b", r"\b\d{10}\b",
    ), ("в/у", "ву", "водительское", "водительского", "водительские", "водительских", "водительским", "водительскими", "вадительское", "вадительские", "удостоверение", "удостоверения", "удостоверению", "удостоверением", "удостверение", "удостверения", "права", "прав", "правам", "правами"), context_required=True, hint=r"\d"),
    TypeSpec(
        "address", "ADDR", (), ("адрес", "проживает", "зарегистрирован", "прописан", "индекс"), found_by="context", split_components=True, pii_markers=("проживает", "живёт", "адрес регистрации", "зарегистрирован", "прописан"),
        non_pii_markers=("отделение", "отделении", "офис", "офисе", "филиал", "банк", "банка", "адрес банка", "приёмная", "канцелярия", "касса", "пункт выдачи", "юридический адрес", "юр. адрес", "юр.адрес", "адрес компании", "адрес организации", "адрес офиса", "адрес магазина"),
    ),
    TypeSpec("email", "EMAIL", (
        r"[A-Za-z0-9._+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+", r"[A-Za-z0-9_+\-]+(?:\s*\.\s*[A-Za-z0-9_+\-]+){0,3}(?:\s+)?@(?:\s+)?[A-Za-z0-9\-]+(?:\s*\.\s*[A-Za-z0-9\-]+)+",
    ), validator="email", hint="@"),
    TypeSpec("phone", "PHONE", (
        r"(?:\+7|\b(?:8|7))[\s\-().]*\d{3}[\s\-().]*\d{3}[\s\-().]*\d{2}[\s\-().]*\d{2}", r"\(\d{3}\)[\s\-().]*\d{3}[\s\-().]*\d{2}[\s\-().]*\d{2}",
    ), validator="phone", stars_keep_prefix=2, stars_keep_suffix=2, non_pii_markers=("версия", "сборка", "build", "version", "релиз", "ver", "пример", "тест", "тестовый", "образец", "шаблон"), hint=r"\d"),
    TypeSpec("inn", "INN", (r"\b(?:\d{10}|\d{12})\b",), ("инн",), validator="inn", hint=r"\d{10}"),
    TypeSpec("card_number", "CARD", (
        r"(?:\d[ -]?){12,18}\d", r"\b\d{4}(?:\s*[-./]\s*|\s+)?\d{4}(?:\s*[-./]\s*|\s+)?\d{4}(?:\s*[-./]\s*|\s+)?\d{4}\b",
    ), ("карта", "card", "номер карты", "№ карты"), validator="luhn", stars_keep_prefix=4, stars_keep_suffix=4, hint=r"\d"),
    TypeSpec("cvv", "CVV", (r"\d{3}\b",), ("cvv", "cvc", "cvv2", "cvc2", "цвв", "цвс", "свв", "свс", "код безопасности", "защитный код", "код на обороте", "на обороте карты", "с обратной стороны карты"), context_required=True, companions=("card_number", "card_holder"), non_pii_markers=DOOR_MARKERS, hint=r"\d{3}"),
    TypeSpec("card_pin", "PIN", (r"\d{4}\b",), ("пин", "pin", "пин-код", "pin-код"), context_required=True, companions=("card_number", "card_holder"), non_pii_markers=DOOR_MARKERS, hint=r"\d{4}"),
    TypeSpec("card_holder", "CARDHLD", (), ("держатель", "держатель карты", "cardholder", "card holder", "имя на карте", "владелец карты"), found_by="context"),
    TypeSpec("snils", "SNILS", (
        rf"\b\d{{3}}{GAP}\d{{3}}{GAP}\d{{3}}{GAP}\d{{2}}\b", r"\b\d{11}\b", r"\b\d{9}\s*\d{2}\b", r"\b\d{3}\s*[^\d\s]\s*\d{3}\s*[^\d\s]\s*\d{5}\b", r"\b\d{3}точка\d{3}точка\d{5}\b",
    ), ("снилс", "снил", "снылс", "смилс", "синилс", "снилсг", "снисл", "снелс", "страховой номер", "страхового номера", "страховому номеру", "страховым номером", "страховое свидетельство", "номер лицевого", "номер лицевого счёта", "номер лицевого счета", "номер моего социального страхования"), context_window=100, validator="snils", hint=r"\d"),
    TypeSpec("secret", "SECRET", (r"(?:пароль|пароля|password|passwd|pwd|код доступа|токен|token|api[ -]?key|секретный ключ)\s*[:=—-]?\s*(\S{6,64})",), ("пароль", "пароля", "password", "passwd", "pwd", "код доступа", "токен", "token", "api key", "api-key", "секретный ключ"), context_required=True, enabled_by_default=False, group=1, hint="(?iu)парол|passw|pwd|доступа|токен|token|api|ключ"),
)
# ---- end of fixed values ----

MODES = ("token", "stars", "remove", "off", "pseudonym", "synthetic")
VALIDATORS = ("none", "luhn", "inn", "snils", "phone", "email", "date")


@dataclass(frozen=True)
class Policy:
    """How a tenant's texts are treated."""

    system_id: str = "default"
    types: tuple[str, ...] | None = None  # None: all that are on by default
    mask_mode: str = "token"
    overrides: dict[str, str] = field(default_factory=dict)
    combination_rule: bool = False
    min_confidence: float = 0.3
    allow_substrings: tuple[str, ...] = ()
    trap_policy: str = "prefer_mask"
    token_numbering: str = "sequential"
    hash_salt: str | None = None
    unmask_enabled: bool = True
    enabled: bool = True

    def __post_init__(self):
        if not 0 <= self.min_confidence <= 1:
            raise RegistryError(f"{self.system_id}: min_confidence is not in [0, 1]")
        if self.token_numbering == "hash" and not self.hash_salt:
            raise RegistryError(f"{self.system_id}: hash numbering needs hash_salt")
        for mode in (self.mask_mode, *self.overrides.values()):
            if mode not in MODES:
                raise RegistryError(f"{self.system_id}: no mask mode {mode}")


class Registry:
    """Types by id. Immutable: with_type gives another one."""

    def __init__(self, types: tuple[TypeSpec, ...] = TYPES):
        self.types = {}
        for t in types:
            if t.id in self.types:
                raise RegistryError(f"type {t.id} is there twice")
            if t.validator not in VALIDATORS:
                raise RegistryError(f"type {t.id}: no validator {t.validator}")
            for p in t.patterns:
                try:
                    re.compile(p.replace(r"\b", BORDER), re.IGNORECASE)
                except re.error as e:
                    raise RegistryError(f"type {t.id}: bad pattern ({e.msg})") from None
            self.types[t.id] = t

    def with_type(self, spec: TypeSpec) -> Registry:
        return Registry((*self.types.values(), spec))

    def enabled(self, policy: Policy) -> list[TypeSpec]:
        ids = policy.types if policy.types is not None else [t.id for t in self.types.values() if t.enabled_by_default]
        if unknown := sorted({*ids, *policy.overrides} - set(self.types)):
            raise RegistryError(f"{policy.system_id}: no type {', '.join(unknown)}")
        return [self.types[i] for i in self.types if i in set(ids)]

    def changed(self, type_id: str, **fields) -> Registry:
        return Registry(tuple(replace(t, **fields) if t.id == type_id else t for t in self.types.values()))


#: White space of any alphabet beyond ASCII, inside a character class.
WIDE_SPACES = (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def spelled(pattern: str, wide: str) -> str:
    """The pattern with white space written out, for engines whose \\s is ASCII; wide: the other spaces, inside a class."""
    out, inside, k = [], False, 0
    while k < len(pattern):
        two = pattern[k : k + 2]
        if two in (r"\s", r"\S"):
            space = rf"\s{wide}"
            out.append(space if inside else f"[{space}]" if two == r"\s" else f"[^{space}]")
        elif two[:1] == "\\":
            out.append(two)
        else:
            inside = two[:1] == "[" or (inside and two[:1] != "]")
            out.append(two[:1])
        k += 2 if two[:1] == "\\" else 1
    return "".join(out)


_JAVA_SPACES = "".join(f"\\u{c:04x}" for c in WIDE_SPACES)

#: Beside a digit a border is half of one, and looked for at digits only.
_BEFORE_DIGIT, _AFTER_DIGITS = re.compile(r"\\b(?=\\d(?![*?]|\{0))"), re.compile(r"(\\d(?:\{[1-9]\d*(?:,\d*)?\})?)\\b")


def java_pattern(pattern: str) -> str:
    """The pattern for Spark: ASCII borders; letters and white space of any alphabet, letters without regard to case."""
    digits = _BEFORE_DIGIT.sub(lambda _: r"(?=\d)(?<![A-Za-z0-9_])", _AFTER_DIGITS.sub(r"\1(?![A-Za-z0-9_])", spelled(pattern, _JAVA_SPACES)))
    return "(?iu)" + digits.replace(r"\b", BORDER)


def python_pattern(pattern: str) -> re.Pattern:
    return re.compile(pattern.replace(r"\b", BORDER), re.IGNORECASE)
