"""Relational operators against brute force over random, nested, equal and empty spans."""

import random

import pytest
from pyspark.sql import functions as F

from sievemark.functions.inflection import KINDS, six_forms
from sievemark.functions.morphology import CASES, SURNAMES, UNCHANGED, _first
from sievemark.operators.lexicon import capitalised_names, forms, in_list, matched_persons, person_forms
from sievemark.operators.relations import beside, covered, islands, nearest_left, outside, overlapping_pairs, with_islands, with_sentences, words

SPANS = "doc_id long, start int, end int, tag string"


def random_spans(seed, n=60, docs=(1, 2, 3, None), reach=300):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        start = rng.randrange(reach)
        out.append((rng.choice(docs), start, start + rng.choice([0, 1, 3, 10, 64, 65, 128, 129, 1000]), rng.choice("abc")))
    return out + out[:5]


def frame(spark, rows):
    return spark.createDataFrame(rows, SPANS)


def key(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("within", [None, 5])
def test_nearest_left(spark, within):
    rows, marks = random_spans(1), random_spans(2)
    got = nearest_left(frame(spark, rows), frame(spark, marks).withColumnRenamed("tag", "said"), ["said"], within)
    expected = []
    for d, s, e, t in rows:
        before = [(m[2], m[3]) for m in marks if m[0] == d and d is not None and m[2] <= s and (within is None or True)]
        best = max(before, default=None)
        if best and within is not None and s - best[0] > within:
            best = None
        expected.append((d, s, e, t, best and best[1], best and best[0]))
    assert key([(r["doc_id"], r["start"], r["end"], r["tag"], r["mark"] and r["mark"]["said"], r["mark"] and r["mark"]["mark_at"]) for r in got.collect()]) == key(expected)


@pytest.mark.parametrize("how", ["overlaps", "inside"])
def test_covered(spark, how):
    rows, others = random_spans(3), [o for o in random_spans(4, 12)]
    meets = (lambda r, o: r[1] < o[2] and o[1] < r[2]) if how == "overlaps" else (lambda r, o: o[1] <= r[1] and r[2] <= o[2])
    expected = [(*r, any(r[0] == o[0] and r[0] is not None and o[2] > o[1] and meets(r, o) and (how == "inside" or r[2] > r[1]) for o in others)) for r in rows]
    assert key(map(tuple, covered(frame(spark, rows), frame(spark, others), how).collect())) == key(expected)
    assert key(map(tuple, outside(frame(spark, rows), frame(spark, others), how).collect())) == key(r[:-1] for r in expected if not r[-1])


@pytest.mark.parametrize("cell", [1, 8, 64])
def test_overlapping_pairs(spark, cell):
    rows, others = [r for r in random_spans(5) if r[2] > r[1]], [r for r in random_spans(6) if r[2] > r[1]]
    expected = [(a, b) for a in rows for b in others if a[0] == b[0] and a[0] is not None and a[1] < b[2] and b[1] < a[2]]
    got = [(tuple(r["left"]), tuple(r["right"])) for r in overlapping_pairs(frame(spark, rows), frame(spark, others), cell=cell).collect()]
    assert len(expected) > 100 and key(got) == key(expected)


@pytest.mark.parametrize("gap", [0, 3])
def test_islands(spark, gap):
    rows = random_spans(7, 40, reach=2000)
    expected = []
    for d in (1, 2, 3):
        run = None
        for s, e in sorted(((r[1], r[2]) for r in rows if r[0] == d), key=lambda x: (x[0], -x[1])):
            if run and s <= run[1] + gap:
                run = [run[0], max(run[1], e), run[2] + 1]
            else:
                expected += [(d, *run)] if run else []
                run = [s, e, 1]
        expected.append((d, *run))
    expected += [(None, r[1], r[2], 1) for r in rows if r[0] is None]
    got = islands(frame(spark, rows), gap, tags=F.count("tag"))
    assert key((r["doc_id"], r["start"], r["end"], r["n"]) for r in got.collect()) == key(expected)
    assert with_islands(frame(spark, rows), gap).count() == len(rows)


def test_a_document_of_many_spans_stays_one_sort(spark):
    """100,000 marks and as many rows in one document, all of which overlap."""
    n = 100_000
    rows = spark.range(n).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("start"), (F.col("id") + n).cast("int").alias("end"), F.col("id").cast("string").alias("tag"))
    assert covered(rows, rows).where("covered").count() == n
    assert islands(rows).count() == 1
    near = nearest_left(rows.withColumn("start", F.col("start") + n), rows, ["tag"])
    assert near.where(F.col("mark.tag") == F.col("tag")).count() == n


def test_words_sentences_and_companions(spark):
    texts = [(1, "Иван-да-Марья. Tel 12 ok!\nend"), (2, ""), (3, None), (4, "..."), (5, "é漢 \U0001f600 x?y")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = words(docs).collect()
    text_of = dict(texts)
    assert all(text_of[r["doc_id"]][r["start"] : r["end"]] == r["word"] for r in got)
    assert [(r["word"], r["sentence"]) for r in sorted(got, key=lambda r: (r["doc_id"], r["start"]))] == [("Иван-да-Марья", 0), ("Tel", 1), ("12", 1), ("ok", 1), ("end", 3), ("é漢", 0), ("x", 0), ("y", 1)]
    spans_ = frame(spark, [(1, 0, 4, "a"), (1, 15, 18, "b"), (1, 19, 21, "c"), (1, 26, 29, "a"), (None, 0, 1, "b"), (None, 0, 1, "b")])
    placed = beside(with_sentences(spans_, docs), F.col("tag") == "b")
    assert key((r["doc_id"], r["start"], r["sentence"], r["beside"]) for r in placed.collect()) == key([(1, 0, 0, False), (1, 15, 1, False), (1, 19, 1, True), (1, 26, 3, False), (None, 0, None, False), (None, 0, None, False)])


def test_forms_are_those_of_the_morphology(spark):
    rows = [(k, w) for k, given in (("given", "иван лев мария илья игорь андрей любовь ольга"), ("patronymic", "иванович ивановна"), ("place", "москва казань сочи омск тула"), ("country", "россия беларусь"), ("surname_male", "иванов толстой крайний шмидт черных дзю"), ("surname_female", "иванова толстая шмидт черных")) for w in given.split()]
    every = spark.createDataFrame(rows, "kind string, word string")
    made = None
    for k in KINDS:
        made = F.when(F.col("kind") == k, six_forms(F.col("word"), k)) if made is None else made.when(F.col("kind") == k, six_forms(F.col("word"), k))
    for r in every.withColumn("six", made).collect():
        fixed = r["kind"].startswith("surname") and UNCHANGED.search(r["word"]) and not r["word"].endswith(("ова", "ева", "ина"))
        one = [r["word"]] * 6 if fixed else [_first(KINDS[r["kind"]], r["word"], c) for c in CASES]
        assert r["six"] == (one if one[0] is not None else None), r
    assert SURNAMES["male"] is KINDS["surname_male"]
    assert forms(every.withColumn("list", F.lit("l"))).where("word = 'казань' and case = 'ins'").first()["form"] == "казанью"


@pytest.mark.parametrize("most", [0, 100])
def test_membership_in_lists_of_any_size(spark, most):
    """The same by a broadcast and by a shuffle; a large list never goes to every task."""
    texts = spark.createDataFrame([(1, "Москвы"), (1, "ёлка"), (2, "xyz"), (None, "ЕЛКА"), (3, None)], "doc_id long, word string")
    known = spark.createDataFrame([("l", "москва", "gen", "москвы"), ("l", "ёлка", "nom", "елка"), ("l", "ёлка", "nom", "елка")], "list string, word string, case string, form string")
    assert key((r["doc_id"], r["word"]) for r in in_list(texts, known, most).collect()) == key([(1, "Москвы"), (1, "ёлка"), (None, "ЕЛКА")])
    assert key((r["doc_id"], r["word"]) for r in in_list(texts, known, most, "left_anti").collect()) == key([(2, "xyz"), (3, None)])
    assert ("ResolvedHint" in in_list(texts, known, most)._jdf.queryExecution().analyzed().toString()) == (most > 0)


def test_persons(spark):
    persons = person_forms(spark.createDataFrame([("Пушкин", "Александр", "Сергеевич", "Пушкин"), ("Ахматова", "Анна", "Андреевна", "Ахматова"), ("Дюма", "Александр", None, "Дюма")], "person string, given string, patronymic string, surname string"))
    values = ["Александр Пушкин", "Александра Сергеевича Пушкина", "Александру Пушкина", "Пушкин Александр", "Пушкин", "А. Пушкин", "А. С. Пушкину", "С. А. Пушкин", "Анны Ахматовой", "Анной Ахматова", "Иван Пушкин", "Александром Дюма", "Александр Александр Пушкин", ""]
    names = spark.createDataFrame([(k, 0, len(v), v) for k, v in enumerate(values)] + [(None, 0, 1, "А. Пушкин")], "doc_id long, start int, end int, value string")
    got = {r["doc_id"]: r["person"] for r in matched_persons(names, persons).collect()}
    assert got == {0: "Пушкин", 1: "Пушкин", 5: "Пушкин", 6: "Пушкин", 8: "Ахматова", 11: "Дюма", 12: "Пушкин"}


def test_runs_of_capitalised_words(spark):
    docs = spark.createDataFrame([(1, "Поэт Александр Пушкин. Чехов А. П. и Иван  Петров, Анна Мария Ольга Вера")], "doc_id long, text string")
    got = [r["value"] for r in capitalised_names(words(docs)).orderBy("start").collect()]
    assert got == ["Поэт Александр Пушкин", "Чехов А П", "Иван", "Петров", "Анна Мария Ольга", "Вера"]
