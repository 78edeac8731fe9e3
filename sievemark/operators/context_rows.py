"""Types that their surroundings tell, as joins and windows over rows.

Names are runs of capitalised words that meet word lists by equi-joins, markers by an as-of join, well-known
persons by their words and confident neighbours by sentence; citizenships meet the forms of countries; codes
meet a card in their sentence. Dates and holders are patterns with a window of text. Lists of any size are
tables; nothing here runs in Python, and a filter on documents reaches their scan.

Every generator gives (by, type_id, start, end, value, confidence), as `candidates` does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.validators import written_date
from ..plans.registry import TYPES
from .detect import apart
from .lexicon import MOST_ROWS, _sized, capitalised_names, folded, with_persons
from .relations import DOC, beside, nearest_left, outside, with_sentences, words
from .spans import spans

SPEC = {t.id: t for t in TYPES}
OUT = ("type_id", "start", "end", "value", "confidence")
# fixed values: what speaks for a code beside a card
BACK_OF_CARD, CODE_WORDS, PIN_WORDS = ("оборот", "обратн", "сзади"), ("код", "цифры", "число"), ("пин", "pin")


def spans_in_context(docs: DataFrame, pattern: str, before: int, after: int = 0, group: int = 0, by=DOC, text_col: str = "text") -> DataFrame:
    """(by, start, end, value, before, after): matches with the lower-case text beside them."""
    rows = docs.select(*by, F.col(text_col).cast("string").alias("_text"))
    rows = rows.withColumn("_low", F.when(F.col("_text").rlike(_hint(pattern)), T.lowered(F.col("_text")))).withColumn("_chunks", T.chunked(F.col("_low")))

    def seen(s: Column) -> Column:
        left, right = F.least(s["start"], F.lit(before)), F.least(F.length("_low") - s["end"], F.lit(after))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), T.piece(F.col("_low"), F.col("_chunks"), s["start"] - left, left).alias("before"), T.piece(F.col("_low"), F.col("_chunks"), s["end"], right).alias("after"))

    each = rows.select(*by, F.explode(F.transform(F.when(F.col("_low").isNotNull(), spans(F.col("_text"), pattern, group)), seen)).alias("_s"))
    return each.select(*by, "_s.*")


def _hint(pattern: str) -> str:
    return r"\d" if r"\d" in pattern else ".*"


def dates(docs: DataFrame, as_of_year: int = 2026, historical_years: int = 120, by=DOC) -> DataFrame:
    """Birth and issue dates: written dates that are days, not in the future, with a word of the type before (40 characters) or after (20)."""
    found = None
    for p in SPEC["birth_date"].patterns:
        part = spans_in_context(docs, p, 40, 20, by=by)
        found = part if found is None else found.unionByName(part)
    day = T.let(F.col("value"), written_date)  # evaluated, not compiled: as code it is too long for a method
    # a match that is no day is none, so the rest is what patterns share
    valid = apart(found.withColumn("year", day["year"]), "year").where(F.col("year") <= as_of_year).dropDuplicates([*by, "start", "end"])
    told = lambda t: T.contains_part(F.col("before"), SPEC[t].context_words) | T.contains_part(F.col("after"), SPEC[t].context_words)
    kinds = F.filter(F.array(*[F.when(told(t), F.lit(t)) for t in ("birth_date", "passport_issue_date")]), lambda t: t.isNotNull())
    score = F.when(as_of_year - F.col("year") > historical_years, 0.3).otherwise(0.6)
    return valid.select(*by, F.explode(kinds).alias("type_id"), "start", "end", "value", score.alias("confidence"))


def card_codes(docs: DataFrame, cards: DataFrame, by=DOC) -> DataFrame:
    """Numbers of three or four digits in the sentence of a card (by, start, end), after a word for a code or for the back of the card; never inside a card."""
    near = spans_in_context(docs, r"\b\d{3,4}\b", 30, by=by)
    any_of = lambda words_: T.contains_part(F.col("before"), words_)
    kind = F.when(any_of(BACK_OF_CARD), "cvv").when(any_of(CODE_WORDS) | any_of(PIN_WORDS), F.when((F.length("value") == 4) | any_of(PIN_WORDS), "card_pin").otherwise("cvv"))
    codes = outside(near.withColumn("type_id", kind).where("type_id is not null"), cards, by=by).select(*by, "type_id", "start", "end", "value")
    both = codes.unionByName(cards.select(*by, "start", "end").distinct(), allowMissingColumns=True)
    placed = beside(with_sentences(both, docs, by=by), F.col("type_id").isNull(), by)
    return placed.where("beside and type_id is not null").select(*by, "type_id", "start", "end", "value", F.lit(0.9).alias("confidence"))


def card_holders(docs: DataFrame, by=DOC) -> DataFrame:
    """Two or three words in Latin capitals after a word for the holder."""
    said = T.parts_pattern(SPEC["card_holder"].context_words).replace("\\ ", " ")
    found = spans_in_context(docs, rf"(?:{said})\s*:?\s*((?-i:[A-Z]{{2,}}(?: [A-Z]{{2,}}){{1,2}}))", 0, group=1, by=by)
    return found.select(*by, F.lit("card_holder").alias("type_id"), "start", "end", "value", F.lit(0.8).alias("confidence"))


def citizenships(docs: DataFrame, countries: DataFrame, by=DOC, most: int = MOST_ROWS) -> DataFrame:
    """The longest run of one to four words after a word of citizenship that is a form of a country; countries: form."""
    said = "|".join(SPEC["citizenship"].context_words)
    phrases = spans_in_context(docs, rf"(?:{said})\s*:?\s*((?:\p{{L}}+ ){{0,3}}\p{{L}}+)", 0, group=1, by=by)
    parts = F.split("value", " ")
    each = phrases.select(*by, "start", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("n"), "value").withColumn("value", F.array_join(F.slice(F.split("value", " "), F.lit(1), F.col("n")), " "))
    known = each.withColumn("_form", folded(F.col("value"))).join(_sized(countries.select(F.col("form").alias("_form")).distinct(), most), "_form")
    best = known.groupBy(*by, "start").agg(F.max_by("value", "n").alias("value"))
    return best.select(*by, F.lit("citizenship").alias("type_id"), "start", (F.col("start") + F.length("value")).alias("end"), "value", F.lit(0.7).alias("confidence"))


def country_forms(singles: DataFrame, republic: DataFrame) -> DataFrame:
    """(form): forms of countries (lexicon.forms), and each after the forms of the word for republic; singles: word, form; republic: form."""
    whole = republic.select(F.col("form").alias("_head"))
    named = singles.select(folded(F.col("word")).alias("_word")).distinct()
    # six forms of one word with each country, the list's size times six
    return singles.select("form").unionByName(named.crossJoin(F.broadcast(whole)).select(F.concat_ws(" ", "_head", "_word").alias("form"))).distinct()


def names(docs: DataFrame, given: DataFrame, persons: DataFrame, confident: DataFrame | None = None, by=DOC, most: int = MOST_ROWS) -> DataFrame:
    """Names of persons, and whether each is a well-known one: OUT and public.

    given: forms of given names (form); persons: of lexicon.person_forms; confident: spans that are sure (by,
    start, end, confidence), which speak for a name in their sentence.

    A run of one to three capitalised words is a name if it has a given name or a patronymic and another word, a surname with
    initials, or three words; a single word only after a word for a person. Confidence: 0.6 for three words, 0.7 for a given
    name and a surname, 0.8 for a surname with initials, else 0.5; 0.3 more or less as the nearest
    marker within 40 characters speaks for or against; 0.3 less for well-known persons; 0.2 more beside a sure span.
    A well-known person without a word for it or a sure neighbour is none.
    """
    spec = SPEC["fio"]
    every = words(docs, by)
    low = folded(F.col("word"))
    marks = every.where(low.isin([w.replace("ё", "е") for w in (*spec.speaking_for, *spec.against) if " " not in w]))
    marks = marks.select(*by, "end", low.isin([w.replace("ё", "е") for w in spec.speaking_for]).alias("speaks"))
    # a marker that begins a sentence with a capital is no part of a name
    rest = every.where(~low.isin([w.replace("ё", "е") for w in (*spec.speaking_for, *spec.against)]))
    listed = _sized(given.select(F.col("form").alias("_form")).distinct().withColumn("_given", F.lit(True)), most)
    flagged = rest.withColumn("_form", low).join(listed, "_form", "left").withColumn("_given", F.coalesce("_given", F.lit(False)))
    is_patronymic = low.rlike(r"(?:ович|евич|ич|овна|евна|ична)(?:а|у|ем|е|ы|ой)?$")
    is_surname = low.rlike("(?:" + "|".join(dict.fromkeys((*spec.surname_suffixes, *spec.surname_case_suffixes))) + ")$")
    flagged = flagged.withColumns({"_patronymic": is_patronymic & ~F.col("_given"), "_initial": F.length("word") == 1})
    flagged = flagged.withColumn("_surname", is_surname & ~F.col("_given") & ~F.col("_patronymic") & ~F.col("_initial"))
    count = lambda c: F.sum(F.col(c).cast("int"))
    runs = capitalised_names(flagged, by, given=count("_given"), patronymic=count("_patronymic"), surname=count("_surname"), initials=count("_initial"), sentence=F.min("sentence"))
    near = nearest_left(runs, marks, ["speaks"], within=40, by=by)
    near = near.withColumn("speaks", F.col("mark.speaks")).drop("mark")
    full, short = (F.col("n") == 3) & (F.col("initials") == 0), (F.col("initials") > 0) & (F.col("n") > F.col("initials"))
    qualifies = full | short | ((F.col("n") > 1) & (F.col("given") + F.col("patronymic") > 0)) | ((F.col("n") == 1) & (F.col("initials") == 0) & F.coalesce("speaks", F.lit(False)))
    base = F.when(full, 0.6).when(short, 0.8).when((F.col("given") == 1) & (F.col("surname") == 1), 0.7).otherwise(0.5)
    told = near.where(qualifies).withColumn("confidence", base + F.when(F.col("speaks"), 0.3).when(~F.col("speaks"), -0.3).otherwise(0.0))
    told = with_persons(told, persons, by, most)
    if confident is not None:
        sure = with_sentences(confident.where("confidence >= 0.9").select(*by, "start", "end"), docs, by=by).select(*by, "sentence").distinct().withColumn("sure", F.lit(True))
        told = told.join(sure, [*by, "sentence"], "left")
    else:
        told = told.withColumn("sure", F.lit(None).cast("boolean"))
    told = told.withColumn("sure", F.coalesce("sure", F.lit(False)))
    score = F.col("confidence") - F.when(F.col("public"), 0.3).otherwise(0.0) + F.when(F.col("sure"), 0.2).otherwise(0.0)
    out = told.where(~F.col("public") | F.coalesce("speaks", F.lit(False)) | F.col("sure"))
    return out.select(*by, F.lit("fio").alias("type_id"), "start", "end", "value", F.round(F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0)), 2).alias("confidence"), "public")
