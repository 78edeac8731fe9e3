"""What costs much is computed once a match, a name or a row, and results stay as brute force gives them."""

import re

from pyspark.sql import functions as F

from sievemark import relational_catalog
from sievemark.functions import text as T
from sievemark.functions.validators import date
from sievemark.operators.detect import candidates
from sievemark.operators.lexicon import matched_persons, person_forms, with_persons
from sievemark.operators.spans import spans
from sievemark.plans.registry import BORDER, Policy, java_pattern


def customers(spark, folder, n=60):
    spark.range(n).select(F.col("id").alias("c_custkey")).write.mode("overwrite").parquet(f"{folder}/customer.parquet")
    return str(folder)


def plan_of(df, capsys):
    capsys.readouterr()
    df.explain("simple")
    return capsys.readouterr().out


def test_what_a_passport_stands_in_is_cut_out_once(spark, tmp_path, capsys):
    plan = plan_of(relational_catalog.QUERIES["letters_passport_spans"](spark, customers(spark, tmp_path)), capsys)
    assert plan.count("[0-9./-]*$") == 1


def test_patterns_that_ask_for_the_same_share_one_test(spark, tmp_path, capsys):
    plan = plan_of(relational_catalog.QUERIES["letters_driver_license_spans"](spark, customers(spark, tmp_path)), capsys)
    assert plan.count(T.parts_pattern(relational_catalog.SPEC["driver_license"].context_words)) == 2  # before all seven patterns, and in the phrase after a label


def test_words_share_their_beginnings():
    words = (*relational_catalog.SPEC["driver_license"].context_words, "д.р", "к/п", "пин", "пин-код", "код на обороте")
    pattern, plain = T.parts_pattern(words), "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))
    text = " ".join([*words, "правая", "правамидр", "др", "д.рправ", "пин-кодпин", "код на", "водительск", "удостоверениями", *reversed(words)])
    assert re.findall(pattern, text) == re.findall(plain, text) and T.parts_pattern(words[:-5]).count("прав") == 1
    assert (T.parts_pattern(()), T.parts_pattern(["a"]), T.word_pattern(["a b"])) == ("", "a", "a\\ b")


def test_borders_beside_digits(spark):
    texts = ["123456", "a123456", "123456_", "ё123456ё", "12 34 123456,1234567", "٣123456", "12-34-123456 (123456) 1 12", "", "\n12\n"]
    patterns = [r"\b\d{6}\b", r"\b\d{2}[ -]\d{2}\b", r"\b\d*", r"\b\d{0,2}\b", r"\b\d?,", r"\b\d{1,2}\b", r"\d+\b", r"\b\d+"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    got = docs.select(*[spans(F.col("text"), p).alias(f"p{k}") for k, p in enumerate(patterns)]).collect()
    for k, p in enumerate(patterns):
        whole = re.compile(p.replace(r"\b", BORDER), re.ASCII)
        assert [[tuple(s) for s in r[k] or [] if s["value"]] for r in got] == [[(*m.span(), m[0]) for m in whole.finditer(t) if m[0]] for t in texts], p
    assert java_pattern(patterns[0]).count("?<") == 1 and "?<=" in java_pattern(patterns[2])


def test_passports_with_a_word_before_the_number(spark):
    texts = ["паспорт 4509 НОМЕР 123456", "паспорт 4509 № 123456", "паспорт 45 09 и Номер 123456", "паспорт 45 09, номер: 123456", "паспорт 4509 номер", "4509 123456", "паспорт 4509 123456 от 12.05.2010"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {k: set() for k in range(len(texts))}
    for r in candidates(docs, policy=Policy(types=("passport",))).collect():
        got[r["doc_id"]].add(r["value"])
    whole = {0: "4509 НОМЕР 123456", 1: "4509 № 123456", 2: "45 09 и Номер 123456", 3: "45 09, номер: 123456", 5: "4509 123456", 6: "4509 123456"}
    assert all(v in got[k] for k, v in whole.items()) and got[4] == {"4509"}


def test_dates_of_odd_values(spark):
    values = ["12.05.2010", "31.02.2001", " 2010-05-12 ", "4509 123456", "", None, "1/2", "13/12/11"]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select(date(F.col("v")).alias("d")).collect()
    assert [r["d"] for r in rows] == [True, False, True, False, False, False, False, True]


def test_sentences_and_neighbours_by_one_shuffle(spark, tmp_path, capsys):
    plan = plan_of(relational_catalog.sentence_companions(spark, customers(spark, tmp_path)), capsys)
    assert plan.count("Exchange hashpartitioning(doc_id") == 1


def test_names_are_made_once(spark, tmp_path, capsys):
    plan = plan_of(relational_catalog.letters_names(spark, customers(spark, tmp_path)), capsys)
    assert plan.count("FileScan parquet") == 4  # words, markers, sure findings, their sentences


def test_flags_of_persons_are_their_matches(spark):
    persons = person_forms(spark.createDataFrame([("A", "Лев", "Николаевич", "Толстой"), ("A", "Алексей", None, "Толстой"), ("B", "Алексей", "Константинович", "Толстой"), ("C", "Анна", "Андреевна", "Ахматова")], "person string, given string, patronymic string, surname string"))
    values = ["Лев Толстой", "Льва Толстого", "Алексей Николаевич Толстой", "Л. Н. Толстой", "Н. Толстой", "К. Толстой", "Л. К. Толстой", "Лев Толстого", "Толстой", "Анны Ахматовой", "А. А. Ахматова", "Л. Н.", "Пётр Толстой", "Ахматова Анна"]
    names = spark.createDataFrame([(k if k else None, 0, len(v), v, k) for k, v in enumerate(["Лев Толстой", *values])], "doc_id long, start int, end int, value string, surname long")
    flagged = with_persons(names, persons)
    assert flagged.columns == [*names.columns, "public"]
    matched = {r["doc_id"] for r in matched_persons(names, persons).collect()}
    rows = flagged.collect()
    assert len(rows) == len(values) + 1 and {r["doc_id"] for r in rows if r["public"]} == matched and matched and None not in matched
