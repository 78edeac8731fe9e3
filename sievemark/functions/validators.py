"""Checks of matched values, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    d = digits(value)
    return (F.length(d) >= 2) & F.call_function("luhn_check", d)


def _weighted(d: Column, weights: list[int]) -> Column:
    """Sum of the leading digits times the weights."""
    out = F.lit(0)
    for k, w in enumerate(weights, 1):
        out = out + F.coalesce(F.try_to_number(F.substring(d, k, 1), F.lit("9")).cast("int"), F.lit(0)) * w
    return out


def _digit(d: Column, k: int) -> Column:
    return F.coalesce(F.try_to_number(F.substring(d, k, 1), F.lit("9")).cast("int"), F.lit(-1))


# fixed values: weights of the control sums
INN_10 = [2, 4, 10, 3, 5, 9, 4, 6, 8]
INN_11 = [7, 2, 4, 10, 3, 5, 9, 4, 6, 8]
INN_12 = [3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8]
SNILS = [9, 8, 7, 6, 5, 4, 3, 2, 1]


# fixed values: months and days as words
MONTHS = (
    ("январь", 1), ("января", 1), ("февраль", 2), ("февраля", 2), ("март", 3), ("марта", 3), ("апрель", 4), ("апреля", 4), ("май", 5), ("мая", 5), ("июнь", 6), ("июня", 6),
    ("июль", 7), ("июля", 7), ("август", 8), ("августа", 8), ("сентябрь", 9), ("сентября", 9), ("октябрь", 10), ("октября", 10), ("ноябрь", 11), ("ноября", 11), ("декабрь", 12), ("декабря", 12),
)
ORDINALS = (
    ("первого", 1), ("второго", 2), ("третьего", 3), ("четвертого", 4), ("четвёртого", 4), ("пятого", 5), ("шестого", 6), ("седьмого", 7), ("восьмого", 8), ("девятого", 9), ("десятого", 10),
    ("одиннадцатого", 11), ("двенадцатого", 12), ("тринадцатого", 13), ("четырнадцатого", 14), ("пятнадцатого", 15), ("шестнадцатого", 16), ("семнадцатого", 17), ("восемнадцатого", 18),
    ("девятнадцатого", 19), ("двадцатого", 20), ("тридцатого", 30),
)


def inn(value: Column) -> Column:
    d = digits(value)
    ten = _weighted(d, INN_10) % 11 % 10 == _digit(d, 10)
    twelve = (_weighted(d, INN_11) % 11 % 10 == _digit(d, 11)) & (_weighted(d, INN_12) % 11 % 10 == _digit(d, 12))
    return F.when(F.length(d) == 10, ten).when(F.length(d) == 12, twelve).otherwise(False)


def snils(value: Column) -> Column:
    d = digits(value)
    total = _weighted(d, SNILS)
    control = F.when(total < 100, total).when(total.isin(100, 101), 0).otherwise(total % 101 % 100)
    return (F.length(d) == 11) & (control == _digit(d, 10) * 10 + _digit(d, 11))


def phone(value: Column) -> Column:
    return digits(value).rlike("^(?:[78][0-9]{10}|[948][0-9]{9})$")


def email(value: Column) -> Column:
    v = F.regexp_replace(value, r"\s", "")
    domain = F.substring_index(v, "@", -1)
    return v.rlike("^.+@.+$") & domain.contains(".") & ~domain.startswith(".") & ~domain.endswith(".")


NUMERIC_DATE = r"^\s*(\d{1,4})[./-](\d{1,2})[./-](\d{1,4})\s*$"


def date_parts(value: Column) -> Column:
    """struct(day, month, year) of a numeric date; null if it is none. A year comes first if the first part has four digits; else day-month if that is a date, else month-day."""
    part = [F.regexp_extract(value, NUMERIC_DATE, k).try_cast("int") for k in (1, 2, 3)]
    year = lambda y: F.when(y >= 100, y).when(y < 70, y + 2000).otherwise(y + 1900)
    valid = lambda d, m, y: (m >= 1) & (m <= 12) & (d >= 1) & (d <= F.day(F.last_day(F.make_date(y, F.greatest(F.least(m, F.lit(12)), F.lit(1)), F.lit(1)))))
    made = lambda d, m, y: F.struct(d.alias("day"), m.alias("month"), y.alias("year"))
    a, b, c = part
    first = F.when(b > 12, F.when(valid(b, c, a), made(b, c, a))).when(valid(c, b, a), made(c, b, a))
    return F.when(a >= 1000, first).when(valid(a, b, year(c)), made(a, b, year(c))).when(valid(b, a, year(c)), made(b, a, year(c)))


def date(value: Column) -> Column:
    return value.rlike(NUMERIC_DATE) & date_parts(value).isNotNull()  # most values look like none, and the parts cost much


def written_date(value: Column) -> Column:
    """struct(day, month, year) of a date in numbers, or with the month (and the day) as words; null if there is no such day."""
    number = lambda pairs: F.create_map(*[F.lit(x) for kv in pairs for x in kv])
    words = [F.lower(F.regexp_extract(value, r"(?iu)^\s*(\d{1,2}|[а-яё]+)\s+([а-яё]+)\s+(\d{2,4})(?:\s*(?:г\.|года|год))?\s*$", k)) for k in (1, 2, 3)]
    day, month = F.coalesce(words[0].try_cast("int"), F.try_element_at(number(ORDINALS), words[0])), F.try_element_at(number(MONTHS), words[1])
    said = F.when((day > 0) & month.isNotNull(), date_parts(F.concat_ws(".", day, month, words[2])))
    return F.coalesce(date_parts(F.regexp_replace(value, r"\s*(?:г\.|года|год)\s*$", "")), F.when(said["month"] == month, said))


CHECKS = {"luhn": luhn, "inn": inn, "snils": snils, "phone": phone, "email": email, "date": date}
