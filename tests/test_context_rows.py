"""Generators over rows: what golden texts hold, odd rows, and the same findings as the function over arrays."""

import pytest
from pyspark.sql import functions as F

from sievemark.functions.validators import written_date
from sievemark.letters import letters
from sievemark.operators import context_rows as C
from sievemark.operators.context import date_of
from sievemark.operators.detect import detect
from sievemark.operators.lexicon import forms, person_forms
from sievemark.plans.registry import Policy

SF = "/root/testdata/sf0.001"


def docs(spark, *texts):
    return spark.createDataFrame([*enumerate(texts), (900, None), (901, ""), (None, "Клиент Иван Петров, гражданство: Россия, родился 12.05.1990")], "doc_id long, text string")


def told(found):
    return sorted((r["doc_id"], r["type_id"], r["value"], r["confidence"]) for r in found.collect() if r["doc_id"] is not None)


@pytest.fixture(scope="module")
def lists(spark):
    given = forms(spark.createDataFrame([("g", w) for w in ("иван", "анна", "александр", "лев")], "list string, word string"), "given")
    persons = person_forms(spark.createDataFrame([("Пушкин", "Александр", "Сергеевич", "Пушкин"), ("Толстой", "Лев", "Николаевич", "Толстой")], "person string, given string, patronymic string, surname string"))
    return given, persons


def test_written_dates_are_those_of_the_function(spark):
    values = ["12.05.2010", "31.02.2001", "05/31/1999", "1988-06-06", "пятого мая 1985", "5 мая 85", "31 апреля 2010", "31 мая 2010 г.", "первого января 2000 года", "13.13.2000", "5 маь 1990", "x", "", "29 февраля 2000", "29 февраля 1900"]
    got = spark.createDataFrame([(v,) for v in values], "v string").select("v", written_date(F.col("v")).alias("d")).collect()
    assert {r["v"]: r["d"] and tuple(r["d"]) for r in got} == {v: date_of(v) for v in values}


def test_dates(spark):
    texts = ["06.06.1988 г.р.", "родился пятого мая 1985", "родился 12.05.2099", "выдан 12.05.2010", "встреча 12.05.2010", "родился 1 мая 1799 года"]
    assert told(C.dates(docs(spark, *texts))) == [(0, "birth_date", "06.06.1988", 0.6), (1, "birth_date", "пятого мая 1985", 0.6), (3, "passport_issue_date", "12.05.2010", 0.6), (5, "birth_date", "1 мая 1799", 0.3)]


def test_names(spark, lists):
    texts = ["Иван Иванович Иванов", "Иванов И. И.", "Поэт Александр Пушкин написал", "Клиент Пушкин Александр, клиент Пушкин", "Анна Белова", "Просто Слова", "Лев Толстой", "клиент Кузнецов", "роман Белова Анна"]
    found = C.names(docs(spark, *texts), *lists)
    assert told(found) == [
        (0, "fio", "Иван Иванович Иванов", 0.6), (1, "fio", "Иванов И И", 0.8), (3, "fio", "Пушкин", 0.8), (3, "fio", "Пушкин Александр", 1.0), (4, "fio", "Анна Белова", 0.7), (7, "fio", "Кузнецов", 0.8), (8, "fio", "Белова Анна", 0.4),
    ]
    assert {r["value"] for r in found.where("doc_id IS NULL").collect()} == set()
    sure = spark.createDataFrame([(6, 0, 1, 0.95), (4, 0, 1, 0.5)], "doc_id long, start int, end int, confidence double")
    near = {r["doc_id"]: (r["confidence"], r["public"]) for r in C.names(docs(spark, *texts), *lists, sure).collect()}
    assert near[6] == (0.6, True) and near[4] == (0.7, False)


def test_citizenships_and_holders(spark):
    republic = forms(spark.createDataFrame([("h", "республика")], "list string, word string"), "country")
    countries = C.country_forms(forms(spark.createDataFrame([("c", "Россия"), ("c", "Беларусь")], "list string, word string"), "country"), republic)
    texts = ["гражданин Республики Беларусь Иванов", "гражданство: Россия", "гражданин Иванов", "гражданка России и Беларуси"]
    for most in (0, 1000):
        assert told(C.citizenships(docs(spark, *texts), countries, most=most)) == [(0, "citizenship", "Республики Беларусь", 0.7), (1, "citizenship", "Россия", 0.7), (3, "citizenship", "России", 0.7)]
    assert told(C.card_holders(docs(spark, "держатель IVAN PETROV", "cardholder: Ivan Petrov", "Держатель карты ANNA MARIA SMITH JONES"))) == [(0, "card_holder", "IVAN PETROV", 0.8), (2, "card_holder", "ANNA MARIA SMITH", 0.8)]


def test_card_codes_are_those_of_detection(spark):
    rows = letters(spark, SF)
    policy = Policy(types=("card_number", "cvv", "card_pin"))
    cards = detect(rows, policy=Policy(types=("card_number",)))
    found = C.card_codes(rows, cards)
    every = {(r["doc_id"], r["type_id"], r["start"], r["end"]) for r in detect(rows, policy=policy).collect()}
    own = {(r["doc_id"], r["type_id"], r["start"], r["end"]) for r in found.collect()}
    assert own and own <= every


def test_nothing_gives_nothing(spark, lists):
    none = docs(spark).where("false")
    spans = spark.createDataFrame([], "doc_id long, start int, end int, confidence double")
    assert C.dates(none).count() == C.card_codes(none, spans).count() == C.card_holders(none).count() == C.names(none, *lists, spans).count() == 0
