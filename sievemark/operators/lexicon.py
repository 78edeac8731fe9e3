"""Word lists as tables: forms of words, membership, and persons matched by their words.

A list of any size is a table (list, word) and its forms are made by expressions where it lies. Words of texts meet it by an
equi-join; the list goes to every task only if its rows were counted and are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.inflection import KINDS, gender, six_forms
from ..functions.morphology import CASES
from .relations import DOC, _known

#: Rows of a list that may go to every task.
MOST_ROWS = 50_000


def folded(word):
    """As words are looked up: lower case, no ё."""
    return F.translate(F.lower(F.trim(word)), "ё", "е")


def forms(lists: DataFrame, kind: str | None = None) -> DataFrame:
    """(list, word, case, form), a row for each case in which the word has a form; lists: list, word, and kind unless it is given."""
    low = lists.withColumn("_low", F.lower(F.trim("word")))
    if kind is not None:
        made = six_forms(F.col("_low"), kind)
    else:
        made = F.lit(None).cast("array<string>")
        for k in KINDS:
            made = F.when(F.col("kind") == k, six_forms(F.col("_low"), k)).otherwise(made)
    each = low.select("list", "word", F.posexplode(F.coalesce(made, F.array("_low"))).alias("_k", "form"))
    return each.select("list", "word", F.get(F.array(*[F.lit(c) for c in CASES]), F.col("_k")).alias("case"), folded(F.col("form")).alias("form"))


def _sized(table: DataFrame, most: int) -> DataFrame:
    """The table, marked to go to every task if it has few rows. Counting stops beyond that many."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def in_list(words: DataFrame, known: DataFrame, most: int = MOST_ROWS, how: str = "left_semi") -> DataFrame:
    """The words (column word) that stand in known (column form), or with how="left_anti" those that don't."""
    table = _sized(known.select(F.col("form").alias("_form")).distinct(), most)
    return words.withColumn("_form", folded(F.col("word"))).join(table, "_form", how).drop("_form")


def person_forms(persons: DataFrame) -> DataFrame:
    """(person, case, words, surname, initials): the case forms of well-known persons; persons: person, given, patronymic, surname.

    Words are those of one case; surname is the last of them. A missing patronymic is none.
    """
    low = persons.select("person", *[F.lower(F.trim(c)).alias(c) for c in ("given", "patronymic", "surname")])
    low = low.withColumn("sex", gender(F.col("given"), F.col("patronymic")))
    own = lambda c, kind: F.coalesce(six_forms(F.col(c), kind), F.array_repeat(F.col(c), len(CASES)))
    surname = F.when(F.col("sex") == "female", own("surname", "surname_female")).otherwise(own("surname", "surname_male"))
    zipped = F.arrays_zip(own("given", "given").alias("g"), own("patronymic", "patronymic").alias("p"), surname.alias("s"))
    each = low.select("person", F.posexplode(zipped).alias("_k", "f"), F.concat(F.substring("given", 1, 1), F.coalesce(F.substring("patronymic", 1, 1), F.lit(""))).alias("initials"))
    words = F.filter(F.array("f.g", "f.p", "f.s"), lambda w: w.isNotNull())
    return each.select("person", F.get(F.array(*[F.lit(c) for c in CASES]), F.col("_k")).alias("case"), F.transform(words, folded).alias("words"), folded(F.col("f.s")).alias("surname"), folded(F.col("initials")).alias("initials"))


def _name_words(names: DataFrame, by, *others: str) -> DataFrame:
    """(by, start, end, others, _words, _initials, _last): a name's distinct words of two letters or more, its initials, and the last of the words."""
    part = F.regexp_extract_all(folded(F.col("value")), F.lit(r"\p{L}+(?:-\p{L}+)*"), F.lit(0))
    told = names.select(*by, "start", "end", *others, part.alias("_parts"))
    return told.select(*by, "start", "end", *others, F.array_distinct(F.filter("_parts", lambda w: F.length(w) > 1)).alias("_words"), F.array_join(F.filter("_parts", lambda w: F.length(w) == 1), "").alias("_initials"), F.try_element_at(F.filter("_parts", lambda w: F.length(w) > 1), F.lit(-1)).alias("_last"))


def _fits(initials: Column, own: Column) -> Column:
    """Whether initials are one of a person's, or both."""
    return F.when(F.length(initials) == 1, own.contains(initials)).when(F.length(initials) == 2, initials == own).otherwise(False)


def matched_persons(names: DataFrame, persons: DataFrame, by=DOC) -> DataFrame:
    """(by, start, end, person): names that are persons of the list; names: by, start, end, value; persons: of person_forms.

    A name is a person if it has two or more words, all of them words of one case form, the last one its surname; or if
    it is the surname with one of the person's initials, or with both. Names find persons by their last word, and
    words are counted: as many of the form's words as the name has distinct words.
    """
    told = _name_words(names, by).withColumnRenamed("_last", "surname").where(F.col("surname").isNotNull() & _known(by)).withColumn("_n", F.size("_words"))
    keys = [*by, "start", "end", "person", "case"]
    # only persons of that surname can match; every other word is looked up in their forms
    near = told.where("_n > 1").join(persons.select("person", "case", "surname"), "surname").select(*keys, "_n", F.explode("_words").alias("word"))
    index = persons.select("person", "case", F.explode("words").alias("word")).distinct()
    whole = near.join(index, ["person", "case", "word"]).groupBy(*keys, "_n").agg(F.countDistinct("word").alias("_m")).where("_m = _n")
    short = told.where("_n = 1 and _initials <> ''").join(persons.select("person", "surname", F.col("initials").alias("_own")).distinct(), "surname")
    return whole.select(*by, "start", "end", "person").unionByName(short.where(_fits(F.col("_initials"), F.col("_own"))).select(*by, "start", "end", "person")).distinct()


def with_persons(names: DataFrame, persons: DataFrame, by=DOC, most: int = MOST_ROWS, name: str = "public") -> DataFrame:
    """names with whether each is a person of the list, as matched_persons says.

    Names are read once: a row for each surname carries the forms and initials of its persons, and a name meets at most one.
    """
    whole = persons.groupBy("person", "case").agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("_form"), F.collect_set("surname").alias("_of"))
    whole = whole.select(F.explode("_of").alias("_last"), "_form").groupBy("_last").agg(F.collect_set("_form").alias("_forms"))
    short = persons.groupBy(F.col("surname").alias("_last")).agg(F.collect_set("initials").alias("_owns"))
    table = _sized(whole.join(short, "_last"), most)
    words = F.exists("_forms", lambda f: F.size(F.array_except("_words", f)) == 0)
    initials = F.exists("_owns", lambda own: _fits(F.col("_initials"), own))
    test = F.when(F.size("_words") > 1, words).when((F.size("_words") == 1) & (F.col("_initials") != ""), initials)
    others = [c for c in names.columns if c not in (*by, "start", "end")]
    met = _name_words(names, by, *others).join(table, "_last", "left")
    return met.select(*names.columns, F.coalesce(test & _known(by), F.lit(False)).alias(name))


def capitalised_names(words: DataFrame, by=DOC, most: int = 3, **aggregates: Column) -> DataFrame:
    """(by, start, end, value, n, and the aggregates): runs of capitalised words and initials of one sentence, a space (and an initial's full stop) apart; longer runs are cut after every `most` words.

    words: of relations.words. Initials end a sentence there, so a run may go on behind one.
    """
    named = words.where(F.col("word").rlike(r"^\p{Lu}(?:\p{L}*)(?:-\p{Lu}\p{L}*)?$"))
    order = Window.partitionBy(*by).orderBy("start")
    before, length = F.lag("end").over(order), F.length(F.lag("word").over(order))
    begins = F.when(before.isNull() | (F.col("start") - before > F.when(length == 1, 2).otherwise(1)) | ((F.col("sentence") != F.lag("sentence").over(order)) & (length > 1)), 1).otherwise(0)
    runs = named.withColumn("_begins", begins).withColumn("_run", F.sum("_begins").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    place = F.row_number().over(Window.partitionBy(*by, "_run").orderBy("start"))
    cut = runs.withColumn("_cut", F.floor((place - 1) / most))
    in_order = F.array_sort(F.collect_list(F.struct("start", "word")))
    out = cut.groupBy(*by, "_run", "_cut").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_join(F.transform(in_order, lambda x: x["word"]), " ").alias("value"), F.count("*").alias("n"), *[c.alias(k) for k, c in aggregates.items()])
    return out.where(_known(by)).select(*by, "start", "end", "value", "n", *aggregates)
