"""Letters: texts with Russian personal data that Spark makes of the keys of `customer`, as the tables themselves hold none.

The same SQL runs in Spark and in DuckDB, so that queries over letters can be held against SQL over them.
Letters are as many as customers; their numbers carry control sums, right and wrong ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .functions.validators import INN_10, SNILS
from .sources.storage import dealt


def _weighted(text: str, weights: list[int]) -> str:
    return "(" + " + ".join(f"{w} * CAST(substr({text}, {k}, 1) AS INT)" for k, w in enumerate(weights, 1)) + ")"


def _padded(number: str, n: int) -> str:
    return f"lpad(CAST({number} AS STRING), {n}, '0')"


def _pick(key: str, values) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


#: (nominative, dative) of the names that letters are about.
NAMES = (
    ("Иванов Иван Иванович", "Иванову Ивану Ивановичу"), ("Петров Пётр Сергеевич", "Петрову Петру Сергеевичу"), ("Толстой Лев Николаевич", "Толстому Льву Николаевичу"),
    ("Шмидт Игорь Андреевич", "Шмидту Игорю Андреевичу"), ("Чехов Антон Павлович", "Чехову Антону Павловичу"),
)
_SNILS = "substr(nine, 1, 3) || '-' || substr(nine, 4, 3) || '-' || substr(nine, 7, 3)"
TEXTS = (
    "'Паспорт клиента: ' || four || ' ' || six || '. Код заявки: 12.'",
    "'паспорт серия ' || four || ' номер ' || six || ', код подразделения ' || three || '-001'",
    "'водительское удостоверение ' || substr(four, 1, 2) || ' ' || substr(four, 3, 2) || ' ' || six || ' выдано в 2015 году'",
    "'ИНН ' || inn || ' указан в анкете'",
    "'ИНН ' || nine || CAST((CAST(substr(inn, 10, 1) AS INT) + 1) % 10 AS STRING)",
    f"'СНИЛС ' || {_SNILS} || ' ' || control",
    f"'страховой номер ' || {_SNILS} || ' 98'",
    f"'номер ' || {_SNILS} || ' ' || control || ' и ' || {_SNILS} || ' 97'",
    "'CVV-код ' || three || ' введён'",
    "'cvv код ошибки ' || three",
    "'пин-код ' || four",
    "'Пин ' || four || ' от домофона.'",
    "'Права 77 12 ' || six || ', а паспорт 4509 ' || six",
    "'в/у 77 12 ' || six || '; код подразделения: ' || three || '-' || three",
    "'77 12 ' || six || ' и ' || four || ' ' || six",
    "three || '-' || three || ' есть номер'",
    "'Накладная ' || four || ' ' || six || ', паспорт ' || four || ' ' || six",
    "'паспорт от 12.05.2010, страница ' || four",
    "'тест, ИНН ' || inn",
    "'Клиент ' || fio || ', тел. +7 (912) 345-' || substr(four, 1, 2) || '-' || substr(four, 3, 2) || '. Почта a' || six || '@mail.example.com!'",
    "'Поэт Александр Сергеевич Пушкин. Клиент ' || fio || ' читал Толстого Льва Николаевича и Чехова А. П.'",
    "'Выдать ' || fio_dat || ' справку. Антону Павловичу Чехову отказать.'",
    "'карта 4276 3800 1234 5674, CVC ' || three || '. Пин: ' || four || '.'",
    "'ИНН 7707083893 банка, серия ' || four || ' ' || six || ' и ИНН ' || inn",
    "'Родился 0' || CAST(1 + k % 9 AS STRING) || '.05.19' || substr(four, 1, 2) || ' г., паспорт выдан ' || CAST(1 + k % 31 AS STRING) || ' апреля 2010 года'",
    "'дата рождения: пятого мая 18' || substr(four, 1, 2) || '. Встреча 12.05.2031 и 31.02.2001, родился'",
    "'Гражданин Республики Беларусь ' || fio || ', гражданство: Россия'",
    "'Карта 4276 3800 1234 5674, код ' || three || ', код ' || four || '. Код ' || three || '.'",
    "'держатель карты IVAN PETROV, cardholder: ANNA MARIA SMITH'",
    "'С. П. Королёв и Иванов И. И. Клиент Кузнецов. Анна Белова, почта a' || six || '@mail.example.com, ИНН ' || inn",
)
_STEPS = (
    ("CAST(c_custkey AS BIGINT) AS k",),
    ("k AS doc_id", "k", f"{_padded('k * 7919 % 1000000', 6)} AS six", f"{_padded('k * 104729 % 10000', 4)} AS four", f"{_padded('k * 31337 % 1000', 3)} AS three", f"{_padded('(k * 7919 + 123456789) % 1000000000', 9)} AS nine"),
    ("*", f"{_weighted('nine', INN_10)} % 11 % 10 AS i", f"{_weighted('nine', SNILS)} AS s"),
    (
        "*", "nine || CAST(i AS STRING) AS inn", f"{_padded('CASE WHEN s < 100 THEN s WHEN s IN (100, 101) THEN 0 ELSE s % 101 % 100 END', 2)} AS control",
        f"{_pick('k * 13 % 5', [n for n, _ in NAMES])} AS fio", f"{_pick('k * 13 % 5', [d for _, d in NAMES])} AS fio_dat",
    ),
    ("doc_id", f"CASE k % {len(TEXTS)} " + " ".join(f"WHEN {k} THEN {t}" for k, t in enumerate(TEXTS)) + " END AS text"),
)


def letters_sql() -> str:
    """A query over customer, in parentheses."""
    out = "customer"
    for step in _STEPS:
        out = f"(SELECT {', '.join(step)} FROM {out})"
    return out


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text), a row for each customer. Keys are dealt before texts are made of them."""
    out = dealt(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey"), "c_custkey")
    for step in _STEPS:
        out = out.selectExpr(*step)
    return out
