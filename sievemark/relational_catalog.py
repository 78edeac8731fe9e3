"""Queries of the relational operators and of letters, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pyspark.sql import Observation

from . import sql
from .catalog import BASIC, ORACLE_SQL as CATALOG_SQL, _docs, _q, _sql_candidates, _sql_resolved, _sql_spans, _table
from .functions.inflection import case_of, female_surname, gender, inflected, patronymic, styled, surname_group
from .functions.morphology import CASES
from .letters import letters, letters_sql
from .operators.detect import LICENSE_WORDS, MARKER_TYPES, NO_CVV, PASSPORT_WORDS, PIN_GAPS, SERIES, candidates, detect
from .operators import context_rows
from .operators.context import DOCUMENT_MARKERS
from .operators.lexicon import capitalised_names, folded, forms, in_list, matched_persons, person_forms
from .operators.relations import beside, found_spans, islands, nearest_left, outside, overlapping_pairs, with_sentences, words
from .plans.registry import TYPES, Policy

SPEC = {t.id: t for t in TYPES}
#: The types that patterns alone find.
PATTERN_TYPES = tuple(t.id for t in TYPES if t.found_by == "patterns")
#: Words of documents that stand for markers in `asof_markers`.
MARKERS = ("token", "with", "from", "that", "de", "la", "der", "und", "que", "en", "the")
STRUCTURED = ("email", "card_number", "phone", "secret")
NUMBERS = r"\d{3,}"


def _letters_policy(types=PATTERN_TYPES, **fields) -> Policy:
    return Policy(types=types, **fields)


# ---- documents -------------------------------------------------------------------------------


def sentence_words(spark, sf_dir):
    return words(_docs(spark, sf_dir)).groupBy("doc_id", "sentence").agg(F.count("*").alias("n"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum(F.length("word")).alias("letters"))


def asof_markers(spark, sf_dir):
    """Each number with the last marker word at most 200 characters before it."""
    every = words(_docs(spark, sf_dir))
    marks = every.where(F.lower("word").isin(*MARKERS)).select("doc_id", "end", F.lower("word").alias("said"))
    near = nearest_left(every.where(F.col("word").rlike("^[0-9]+$")).select("doc_id", "start", "end", "word"), marks, ["said"], within=200)
    return near.select("doc_id", "start", "end", "word", F.col("mark.said").alias("said"), (F.col("start") - F.col("mark.mark_at")).alias("distance"))


def _structured(spark, sf_dir):
    return candidates(_docs(spark, sf_dir), policy=Policy(types=STRUCTURED)).select("doc_id", "type_id", "start", "end").distinct()


def numbers_outside(spark, sf_dir):
    """Numbers that no finding overlaps."""
    return outside(found_spans(_docs(spark, sf_dir), NUMBERS), _structured(spark, sf_dir))


def numbers_inside(spark, sf_dir):
    """Numbers with all findings that overlap them."""
    pairs = overlapping_pairs(found_spans(_docs(spark, sf_dir), NUMBERS), _structured(spark, sf_dir))
    return pairs.select("doc_id", F.col("left.start").alias("start"), F.col("left.end").alias("end"), F.col("right.type_id").alias("type_id"), F.col("right.start").alias("of_start"), F.col("right.end").alias("of_end"))


def span_islands(spark, sf_dir):
    """Runs of findings and numbers of which each begins at most two characters after all before it."""
    every = _structured(spark, sf_dir).unionByName(found_spans(_docs(spark, sf_dir), NUMBERS).select("doc_id", F.lit("number").alias("type_id"), "start", "end"))
    return islands(every, gap=2, types=F.array_join(F.array_sort(F.collect_set("type_id")), ","))


def dictionary_words(spark, sf_dir):
    """Words of each document that the benchmark texts hold, and how many it has."""
    every = words(_docs(spark, sf_dir)).select("doc_id", "word")
    known = words(_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")).select(folded(F.col("word")).alias("form"))
    return in_list(every, known).groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct(folded(F.col("word"))).alias("distinct_words"))


# ---- letters ---------------------------------------------------------------------------------


def _letter_spans(type_id: str):
    return lambda spark, sf_dir: candidates(letters(spark, sf_dir), policy=_letters_policy((type_id,))).select("doc_id", "start", "end", "value", "confidence").distinct()


def letters_resolved(spark, sf_dir):
    return detect(letters(spark, sf_dir), policy=_letters_policy()).select("doc_id", "type_id", "start", "end", "confidence")


def letters_allowed(spark, sf_dir):
    """INN numbers but for one that the policy allows, whoever writes it."""
    return detect(letters(spark, sf_dir), policy=_letters_policy(("inn",), allow_substrings=("ИНН 7707083893",))).select("doc_id", "start", "end", "value")


def sentence_companions(spark, sf_dir):
    """Findings with their sentence, and whether a confident finding of another kind of row stands in it."""
    found = letters_resolved(spark, sf_dir)
    placed = with_sentences(found, letters(spark, sf_dir), r"[.!?\n]")
    return beside(placed, F.col("confidence") >= 0.8).select("doc_id", "type_id", "start", "sentence", "beside")


# fixed values: a kind, a word and its cases
WORD_FORMS = (
    ("surname_male", "иванов", "иванов иванова иванову иванова ивановым иванове"), ("surname_male", "петров", "петров петрова петрову петрова петровым петрове"),
    ("surname_male", "толстой", "толстой толстого толстому толстого толстым толстом"), ("surname_male", "шмидт", "шмидт шмидта шмидту шмидта шмидтом шмидте"), ("surname_male", "чехов", "чехов чехова чехову чехова чеховым чехове"),
    ("given", "иван", "иван ивана ивану ивана иваном иване"), ("given", "лев", "лев льва льву льва львом льве"), ("given", "игорь", "игорь игоря игорю игоря игорем игоре"), ("given", "антон", "антон антона антону антона антоном антоне"),
    ("patronymic", "сергеевич", "сергеевич сергеевича сергеевичу сергеевича сергеевичем сергеевиче"), ("patronymic", "павлович", "павлович павловича павловичу павловича павловичем павловиче"),
    ("surname_female", "иванова", "иванова ивановой ивановой иванову ивановой ивановой"), ("place", "москва", "москва москвы москве москву москвой москве"), ("place", "казань", "казань казани казани казань казанью казани"),
    ("place", "омск", "омск омска омску омск омском омске"), ("country", "россия", "россия россии россии россию россией россии"),
)
PERSONS = (("Пушкин А. С.", "Александр", "Сергеевич", "Пушкин"), ("Толстой Л. Н.", "Лев", "Николаевич", "Толстой"), ("Чехов А. П.", "Антон", "Павлович", "Чехов"))
# fixed values: cases of these persons' names, given, patronymic, surname
PERSON_FORMS = (
    ("Пушкин А. С.", "ас", "александр сергеевич пушкин|александра сергеевича пушкина|александру сергеевичу пушкину|александра сергеевича пушкина|александром сергеевичем пушкиным|александре сергеевиче пушкине"),
    ("Толстой Л. Н.", "лн", "лев николаевич толстой|льва николаевича толстого|льву николаевичу толстому|льва николаевича толстого|львом николаевичем толстым|льве николаевиче толстом"),
    ("Чехов А. П.", "ап", "антон павлович чехов|антона павловича чехова|антону павловичу чехову|антона павловича чехова|антоном павловичем чеховым|антоне павловиче чехове"),
)


def inflected_words(spark, sf_dir):
    """How often each case form of a list stands in letters."""
    lists = spark.createDataFrame([(k, w) for k, w, _ in WORD_FORMS], "kind string, word string").withColumn("list", F.col("kind"))
    every = words(letters(spark, sf_dir)).select(folded(F.col("word")).alias("form"))
    return every.join(forms(lists), "form").groupBy("list", "word", "case").agg(F.count("*").alias("n"))


def public_persons(spark, sf_dir):
    """Names in letters that are those of well-known persons, in any case."""
    persons = person_forms(spark.createDataFrame(list(PERSONS), "person string, given string, patronymic string, surname string"))
    return matched_persons(capitalised_names(words(letters(spark, sf_dir))), persons)


def name_forms(spark, sf_dir):
    """The name functions over the words of letters."""
    word = folded(F.col("word"))
    every = words(letters(spark, sf_dir)).where(F.col("word").rlike(r"^\p{Lu}\p{Ll}{2,}$")).select("word", word.alias("low")).distinct()
    case = F.element_at(F.array(*[F.lit(c) for c in CASES]), F.length("low") % 6 + 1)
    sex = F.when(F.length("low") % 2 == 0, "female").otherwise("male")
    return every.select(
        "word", surname_group(F.col("low")).alias("grp"), female_surname(F.col("low")).alias("her"), patronymic(F.col("low"), sex).alias("child"), gender(F.col("low"), F.lit(None).cast("string")).alias("sex"),
        case_of(F.element_at(F.array(*[F.lit(c) for c in ("им", "Род", "дат", "вин", "твор", "нет")]), F.length("low") % 6 + 1)).alias("case_name"), styled(F.col("word"), F.coalesce(inflected(F.col("low"), "surname_male", case), F.col("low"))).alias("form"),
    )


# ---- SQL text alone --------------------------------------------------------------------------


def _with_functions(spark, sf_dir):
    """The functions for this session, and a view of documents under a name of its own."""
    sql.register(spark, BASIC, prefix="basic_")
    _docs(spark, sf_dir).createOrReplaceTempView("sql_documents")


def sql_entities(spark, sf_dir):
    _with_functions(spark, sf_dir)
    return spark.sql("SELECT doc_id, e.type_id, e.start, e.`end`, e.confidence FROM sql_documents, LATERAL basic_entities(text) AS e")


def sql_masked(spark, sf_dir):
    _with_functions(spark, sf_dir)
    return spark.sql("SELECT doc_id, m.masked_text, m.n_entities FROM (SELECT doc_id, basic_mask(text) AS m FROM sql_documents) WHERE m.n_entities > 0")


def sql_roundtrip(spark, sf_dir):
    _with_functions(spark, sf_dir)
    return spark.sql("SELECT count(*) AS docs, count_if(basic_unmask(m.masked_text, m.mappings) = text) AS equal, count_if(size(basic_detect(text)) > 0) AS found FROM (SELECT text, basic_mask(text) AS m FROM sql_documents)")


def observed_counters(spark, sf_dir):
    """Counts that an aggregation over the same events leaves behind, without a pass of their own."""
    events, kinds = _table(spark, sf_dir, "events"), ("error", "click", "view")
    seen = Observation("requests")
    conditions = {f"n_{k}": F.col("event_type") == k for k in kinds} | {"limited": F.col("event_id") % 10 == 0}
    told = [F.count("*").alias("requests"), *[F.count_if(c).alias(k) for k, c in conditions.items()], F.count_if(F.abs("value") <= 10).alias("le_10")]
    users = events.observe(seen, *told).groupBy("user_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("users")).first()
    return spark.createDataFrame([{**seen.get, "users": users["users"]}], ", ".join(f"{k} long" for k in ["requests", *conditions, "le_10", "users"]))


# ---- types that their surroundings tell ------------------------------------------------------

GIVEN_NAMES = ("иван", "пётр", "лев", "игорь", "антон", "анна", "александр", "павел")


def letters_dates(spark, sf_dir):
    return context_rows.dates(letters(spark, sf_dir))


def letters_card_codes(spark, sf_dir):
    rows = letters(spark, sf_dir)
    return context_rows.card_codes(rows, candidates(rows, policy=_letters_policy(("card_number",))).where("confidence >= 0.6"))


def letters_holders(spark, sf_dir):
    return context_rows.card_holders(letters(spark, sf_dir))


def letters_citizenships(spark, sf_dir):
    lists = spark.createDataFrame([("countries", "Россия"), ("countries", "Беларусь")], "list string, word string")
    republic = forms(spark.createDataFrame([("heads", "республика")], "list string, word string"), "country")
    return context_rows.citizenships(letters(spark, sf_dir), context_rows.country_forms(forms(lists, "country"), republic))


def letters_names(spark, sf_dir):
    """With the findings of pattern types as sure neighbours."""
    rows = letters(spark, sf_dir)
    given = forms(spark.createDataFrame([("given", w) for w in GIVEN_NAMES], "list string, word string"), "given")
    persons = person_forms(spark.createDataFrame(list(PERSONS), "person string, given string, patronymic string, surname string"))
    return context_rows.names(rows, given, persons, candidates(rows, policy=_letters_policy(("inn", "phone", "email", "card_number", "snils"))))


QUERIES = {
    "letters_dates": letters_dates, "letters_card_codes": letters_card_codes, "letters_holders": letters_holders, "letters_citizenships": letters_citizenships, "letters_names": letters_names,
    "sql_entities": sql_entities, "sql_masked": sql_masked, "sql_roundtrip": sql_roundtrip, "observed_counters": observed_counters,
    "sentence_words": sentence_words, "asof_markers": asof_markers, "numbers_outside": numbers_outside, "numbers_inside": numbers_inside, "span_islands": span_islands, "dictionary_words": dictionary_words,
    **{f"letters_{t}_spans": _letter_spans(t) for t in PATTERN_TYPES if t != "secret"}, "letters_resolved": letters_resolved, "letters_allowed": letters_allowed, "sentence_companions": sentence_companions,
    "inflected_words": inflected_words, "public_persons": public_persons, "name_forms": name_forms,
}


# --- SQL of the same ----------------------------------------------------------------------------


def _sql_tokens(pattern: str, source: str) -> str:
    """(doc_id, i, value, start, end) of all matches, summed up in order."""
    p = _q(pattern)
    return f"""(SELECT doc_id, i, value, CAST(upto - length(value) AS INTEGER) AS start, CAST(upto AS INTEGER) AS "end" FROM (
  SELECT doc_id, i, value, sum(length(gap) + length(value)) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM (
    SELECT doc_id, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS value, unnest(q[1:len(m)]) AS gap FROM (SELECT doc_id, regexp_extract_all(text, {p}) AS m, string_split_regex(text, {p}) AS q FROM {source}) WHERE len(m) > 0)))"""


_WORD_OR_END = r"\pL+(?:-\pL+)*|[0-9]+|[.!?\n]"


def _sql_words(source: str) -> str:
    return f"""(SELECT doc_id, start, "end", value AS word, sentence FROM (SELECT *, CAST(coalesce(sum(CASE WHEN regexp_matches(value, '^[.!?\\n]$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS sentence FROM {_sql_tokens(_WORD_OR_END, source)})
  WHERE NOT regexp_matches(value, '^[.!?\\n]$'))"""


def _alternatives(words_) -> str:
    return "|".join(w.replace(".", "\\.").replace("/", "/") for w in sorted(set(words_), key=lambda w: (-len(w), w)))


def _sql_has_word(window: str, words_) -> str:
    single, phrases = [w for w in words_ if " " not in w], [w for w in words_ if " " in w]
    p = "|".join(x for x in (rf"(?:^|[^\pL\pN])(?:{_alternatives(single)})(?:$|[^\pL\pN])" if single else "", _alternatives(phrases)) if x)
    return f"regexp_matches({window}, {_q(p)})" if p else "false"


def _sql_last(window: str, words_) -> str:
    return f"length(regexp_extract({window}, {_q(f'(?s)^(.*(?:{_alternatives(words_)}))')}, 1))"


def _sql_license(window: str) -> str:
    a, b = _sql_last(window, LICENSE_WORDS), _sql_last(window, PASSPORT_WORDS)
    return f"(CASE WHEN greatest({a}, {b}) > 0 THEN {a} > {b} END)"


_OWNER = {w: t for t in MARKER_TYPES for w in SPEC[t].context_words}
_MARKER = rf"(?s)^(.*(?:^|[^\pL\pN]))({_alternatives(_OWNER)})(?:$|[^\pL\pN])"
_LABEL = r"(?s)^(.*(?:^|[^\pL\pN_]))([а-яёa-z0-9\-]+\s*:)"
_DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"


def _sum(text: str, weights) -> str:
    return "(" + " + ".join(f"{w} * CAST(substr({text}, {k}, 1) AS INTEGER)" for k, w in enumerate(weights, 1)) + ")"


def _sql_letter_candidates(type_id: str) -> str:
    """Candidates of a type by SQL of its rules, over columns that are computed step by step."""
    source = letters_sql()
    if type_id in ("email", "card_number", "phone"):
        if type_id != "card_number":
            return _sql_candidates(type_id, source)
    spec = SPEC[type_id]
    w = spec.context_window
    own = [x for x, t in _OWNER.items() if t == type_id]
    is_license = "true" if type_id == "driver_license" else "false"
    b60 = "right(b, 60)"
    valid = {
        "inn": f"CASE length({_DIGITS}) WHEN 10 THEN {_sum(_DIGITS, (2, 4, 10, 3, 5, 9, 4, 6, 8))} % 11 % 10 = CAST(substr({_DIGITS}, 10, 1) AS INTEGER) WHEN 12 THEN {_sum(_DIGITS, (7, 2, 4, 10, 3, 5, 9, 4, 6, 8))} % 11 % 10 = CAST(substr({_DIGITS}, 11, 1) AS INTEGER) AND {_sum(_DIGITS, (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8))} % 11 % 10 = CAST(substr({_DIGITS}, 12, 1) AS INTEGER) END",
        "snils": f"(CASE WHEN {_sum(_DIGITS, range(9, 0, -1))} < 100 THEN {_sum(_DIGITS, range(9, 0, -1))} WHEN {_sum(_DIGITS, range(9, 0, -1))} IN (100, 101) THEN 0 ELSE {_sum(_DIGITS, range(9, 0, -1))} % 101 % 100 END) = CAST(substr({_DIGITS}, 10, 2) AS INTEGER)",
        "card_number": f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN (length({_DIGITS}) - i) % 2 = 1 THEN CASE WHEN CAST(substr({_DIGITS}, i, 1) AS INTEGER) > 4 THEN 2 * CAST(substr({_DIGITS}, i, 1) AS INTEGER) - 9 ELSE 2 * CAST(substr({_DIGITS}, i, 1) AS INTEGER) END ELSE CAST(substr({_DIGITS}, i, 1) AS INTEGER) END)) % 10 = 0",
    }.get(type_id, "true")
    if type_id == "cvv":
        tail = f"regexp_extract({b60}, {_q(f'(?:{_alternatives(spec.context_words)})([^.!?' + chr(92) + 'n0-9]{0,30})$')}, 1)"
        bad = r"^\s*(?:\S+\s+){3}\S"
        context = f"regexp_matches({b60}, {_q(f'(?:{_alternatives(spec.context_words)})[^.!?' + chr(92) + 'n0-9]{0,30}$')}) AND NOT regexp_matches({tail}, {_q(bad)}) AND NOT regexp_matches({tail}, {_q(f'(?:{_alternatives(NO_CVV)})' + chr(92) + 's*$')})"
    elif type_id == "card_pin":
        gaps = "|".join(sorted(PIN_GAPS, key=len, reverse=True))
        p = rf"(?:{_alternatives(spec.context_words)})(\s*(?:{gaps})\s*)$"
        context = f"regexp_matches({b60}, {_q(p)}) AND length(regexp_extract({b60}, {_q(p)}, 1)) <= 12"
    elif type_id in MARKER_TYPES:
        head = "left(b, label_at)"
        phrase = f"regexp_extract({head}, '([^.;\\n!?]*)$', 1)"
        by_label = f"CASE WHEN {_sql_has_word(phrase, SERIES)} THEN coalesce({_sql_license(head)}, false) = {is_license} ELSE regexp_matches({phrase}, {_q(_alternatives(spec.context_words))}) END"
        by_marker = f"CASE WHEN said IN ({', '.join(map(_q, SERIES))}) THEN coalesce({_sql_license('b')}, false) = {is_license} ELSE said IN ({', '.join(map(_q, own))}) END"
        context = f"CASE WHEN label_at > said_at THEN {by_label} WHEN said_at > 0 THEN {by_marker} ELSE false END"
    else:
        context = f"regexp_matches(right(b, {w}), {_q(_alternatives(spec.context_words))})"
    plus = "CASE WHEN context THEN 0.3 ELSE 0.0 END"
    near_card = f"regexp_matches(right(b, 40) || chr(10) || left(af, 39), {_q(_alternatives(('карта', 'карты', 'карте', 'карту', 'картой', 'карточка', 'card')))})"
    score = {
        "snils": "CASE WHEN valid THEN 0.9 WHEN context THEN 0.7 END", "inn": f"CASE WHEN valid THEN least(1.0, 0.8 + {plus}) END",
        "card_number": f"CASE WHEN length({_DIGITS}) = 15 AND NOT {near_card} THEN NULL WHEN valid THEN least(1.0, 0.8 + {plus}) WHEN {near_card} THEN 0.6 END",
    }.get(type_id, f"0.4 + {plus}")
    tests = []
    if type_id in ("passport", "driver_license"):
        tests.append(f"coalesce({_sql_license('b')} = {is_license}, true)")
    if type_id == "passport":
        score = f"CASE WHEN regexp_matches(value, '^[0-9]{{2}} [0-9]{{2}} [0-9]{{6}}$') AND context THEN 0.9 ELSE {score} END"
        around = "regexp_extract(b, '[0-9./-]*$', 0) || value || regexp_extract(af, '^[0-9./-]*', 0)"
        tests += [f"NOT (length({_DIGITS}) < 10 AND NOT context)", f"NOT {_sql_has_word(b60, DOCUMENT_MARKERS)}", f"try_strptime({around}, '%d.%m.%Y') IS NULL"]
    if spec.context_required:
        tests.append("context")
    tests += [f"NOT {_sql_has_word(f'right(b, {w})', spec.against)}", f"NOT {_sql_has_word(f'left(af, {w - 1})', spec.against)}"]
    return f"""
SELECT doc_id, {_q(type_id)} AS type_id, pos AS start, CAST(pos + length(value) AS INTEGER) AS "end", value, round(CAST({score} AS DOUBLE), 2) AS confidence FROM (
  SELECT *, {context} AS context, {valid} AS valid FROM (
    SELECT *, length(regexp_extract(b, {_q(_LABEL)}, 1) || regexp_extract(b, {_q(_LABEL)}, 2)) AS label_at, regexp_extract(b, {_q(_MARKER)}, 2) AS said, length(regexp_extract(b, {_q(_MARKER)}, 1) || regexp_extract(b, {_q(_MARKER)}, 2)) AS said_at FROM (
      SELECT doc_id, pos, value, lower(substr(text, greatest(pos - 200, 0) + 1, least(pos, 200))) AS b, lower(substr(text, pos + length(value) + 1, {max(w, 40)})) AS af FROM ({_sql_spans(type_id, source)}))))
WHERE ({score}) IS NOT NULL AND {" AND ".join(tests)}"""


_LETTER_UNION = "\nUNION ALL".join(_sql_letter_candidates(t) for t in PATTERN_TYPES if t != "secret")
_STRUCTURED = "(" + "\nUNION ".join(f'SELECT doc_id, type_id, start, "end" FROM ({_sql_candidates(t)})' for t in STRUCTURED) + ")"
_NUMBERS = _sql_tokens("[0-9]{3,}", "documents")
_FOLD = "replace(lower(word), 'ё', 'е')"
_RUNS = rf"""
named AS (SELECT * FROM {_sql_words(letters_sql())} WHERE regexp_matches(word, '^\p{{Lu}}\pL*(?:-\p{{Lu}}\pL*)?$')),
begun AS (SELECT *, CASE WHEN p IS NULL OR start - p > CASE WHEN n = 1 THEN 2 ELSE 1 END OR (sentence <> s AND n > 1) THEN 1 ELSE 0 END AS begins FROM (SELECT *, lag("end") OVER o AS p, length(lag(word) OVER o) AS n, lag(sentence) OVER o AS s FROM named WINDOW o AS (PARTITION BY doc_id ORDER BY start))),
runs AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY start) AS run FROM begun),
cuts AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, run ORDER BY start) - 1) // 3 AS cut FROM runs),
names AS (SELECT doc_id, min(start) AS start, max("end") AS "end", list_distinct(list({_FOLD}) FILTER (length(word) > 1)) AS words, coalesce(string_agg({_FOLD}, '' ORDER BY start) FILTER (length(word) = 1), '') AS initials, max_by({_FOLD}, start) FILTER (length(word) > 1) AS surname FROM cuts GROUP BY doc_id, run, cut)"""
_PERSON_VALUES = ", ".join(f"({_q(p)}, {_q(i)}, string_split({_q(form)}, ' '))" for p, i, told in PERSON_FORMS for form in told.split("|"))
_FORM_VALUES = ", ".join(f"({_q(kind)}, {_q(word)}, {_q(case)}, {_q(form)})" for kind, word, six in WORD_FORMS for case, form in zip(CASES, six.split(), strict=True))
_OV, _CONSONANT = "(ов|ев|ин|ын)$", "[бвгджзйклмнпрстфхцчшщьъ]$"

_BESIDE = "lower(substr(text, greatest(start - {n}, 0) + 1, least(start, {n})))"


def _sql_in_letters(tokens: str) -> str:
    return f"(SELECT t.*, l.text FROM {tokens} AS t JOIN {letters_sql()} AS l USING (doc_id))"


def _sql_dates() -> str:
    patterns = [r"\b\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b", r"\b\d{4}-\d{2}-\d{2}\b", r"\b\d{4}[./]\d{1,2}[./]\d{1,2}\b", r"(?i)\b\d{1,2}\s+[а-яё]+\s+\d{2,4}\b", r"(?i)[а-яё]+\s+[а-яё]+\s+\d{2,4}"]
    months = "['января', 'февраля', 'марта', 'апреля', 'мая', 'июня', 'июля', 'августа', 'сентября', 'октября', 'ноября', 'декабря']"
    found = " UNION ".join(f'SELECT doc_id, start, "end", value FROM {_sql_tokens(p, letters_sql())}' for p in patterns)
    numeric = "coalesce(try_strptime(value, '%d.%m.%Y'), try_strptime(value, '%m.%d.%Y'))"
    spoken = f"try_cast(printf('%04d-%02d-%02d', try_cast(p[3] AS INTEGER), list_position({months}, lower(p[2])), coalesce(try_cast(p[1] AS INTEGER), CASE lower(p[1]) WHEN 'пятого' THEN 5 END)) AS DATE)"
    told = lambda t: f"(regexp_matches({_BESIDE.format(n=40)}, {_q(_alternatives(SPEC[t].context_words))}) OR regexp_matches(lower(substr(text, \"end\" + 1, 20)), {_q(_alternatives(SPEC[t].context_words))}))"
    return f"""WITH f AS (SELECT *, year(coalesce({numeric}, CASE WHEN len(p) = 3 THEN {spoken} END)) AS y FROM (SELECT *, string_split_regex(value, '\\s+') AS p FROM {_sql_in_letters('(' + found + ')')})),
      k AS (SELECT *, unnest([CASE WHEN {told('birth_date')} THEN 'birth_date' END, CASE WHEN {told('passport_issue_date')} THEN 'passport_issue_date' END]) AS type_id FROM f WHERE y <= 2026)
      SELECT doc_id, type_id, start, "end", value, CASE WHEN 2026 - y > 120 THEN 0.3 ELSE 0.6 END::DOUBLE AS confidence FROM k WHERE type_id IS NOT NULL"""


def _sql_card_codes() -> str:
    sentence = r"length(regexp_replace(left(text, start), '[^.!?\n]', '', 'g'))"
    before = _BESIDE.format(n=30)
    return f"""WITH n AS (SELECT *, {sentence} AS sentence, {before} AS b FROM {_sql_in_letters(_sql_tokens(r'\b\d{3,4}\b', letters_sql()))}),
      c AS (SELECT *, {sentence} AS sentence FROM {_sql_in_letters("(SELECT DISTINCT doc_id, start, \"end\" FROM (" + _sql_letter_candidates('card_number') + ") WHERE confidence >= 0.6)")})
      SELECT doc_id, type_id, start, "end", value, 0.9::DOUBLE AS confidence FROM (SELECT *, CASE WHEN regexp_matches(b, 'оборот|обратн|сзади') THEN 'cvv' WHEN regexp_matches(b, 'код|цифры|число|пин|pin') THEN CASE WHEN length(value) = 4 OR regexp_matches(b, 'пин|pin') THEN 'card_pin' ELSE 'cvv' END END AS type_id FROM n) AS x
      WHERE type_id IS NOT NULL AND (doc_id, sentence) IN (SELECT (doc_id, sentence) FROM c) AND NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = x.doc_id AND c.start < x."end" AND x.start < c."end")"""


def _sql_grouped(pattern: str) -> str:
    """(doc_id, start, end, value) of the last group of each match."""
    return f'(SELECT doc_id, CAST("end" - length(v) AS INTEGER) AS start, "end", v AS value FROM (SELECT *, regexp_extract(value, {_q(pattern)}, 1) AS v FROM {_sql_tokens(pattern, letters_sql())}))'


_COUNTRY_FORMS = ("россия", "россии", "россию", "россией", "беларусь", "беларуси", "беларусью", *(f"{r} {c}" for r in ("республика", "республики", "республике", "республику", "республикой") for c in ("россия", "беларусь")))
_PEOPLE = [w.replace("ё", "е") for w in SPEC["fio"].speaking_for]
_OTHERS = [w.replace("ё", "е") for w in SPEC["fio"].against if " " not in w]
_GIVEN = "иван ивана ивану иваном иване петр петра петру петром петре лев льва льву львом льве игорь игоря игорю игорем игоре антон антона антону антоном антоне анна анны анне анну анной александр александра александру александром александре павел павла павлу павлом павле".split()
_SURNAME = "(?:" + "|".join(dict.fromkeys((*SPEC["fio"].surname_suffixes, *SPEC["fio"].surname_case_suffixes))) + ")$"


def _sql_names() -> str:
    quoted = lambda words_: ", ".join(map(_q, words_))
    sure = "\nUNION ALL ".join(f'SELECT doc_id, start FROM ({_sql_letter_candidates(t)}) WHERE confidence >= 0.9' for t in ("inn", "phone", "email", "card_number", "snils"))
    text = lambda e: f"length(regexp_replace(left(text, {e}), '[^.!?\\n]', '', 'g'))"
    return rf"""WITH w AS MATERIALIZED (SELECT *, {_FOLD} AS low FROM {_sql_words(letters_sql())}),
m AS (SELECT doc_id, "end" AS mark_end, low IN ({quoted(_PEOPLE)}) AS speaks FROM w WHERE low IN ({quoted([*_PEOPLE, *_OTHERS])})),
named AS (SELECT *, low IN ({quoted(_GIVEN)}) AS g, regexp_matches(low, '(?:ович|евич|ич|овна|евна|ична)(?:а|у|ем|е|ы|ой)?$') AS p0, length(word) = 1 AS i FROM w WHERE low NOT IN ({quoted([*_PEOPLE, *_OTHERS])}) AND regexp_matches(word, '^\p{{Lu}}\pL*(?:-\p{{Lu}}\pL*)?$')),
begun AS (SELECT *, p0 AND NOT g AS p, regexp_matches(low, {_q(_SURNAME)}) AND NOT g AND NOT (p0 AND NOT g) AND NOT i AS s, CASE WHEN pe IS NULL OR start - pe > CASE WHEN pn = 1 THEN 2 ELSE 1 END OR (sentence <> ps AND pn > 1) THEN 1 ELSE 0 END AS begins FROM (SELECT *, lag("end") OVER o AS pe, length(lag(word) OVER o) AS pn, lag(sentence) OVER o AS ps FROM named WINDOW o AS (PARTITION BY doc_id ORDER BY start))),
runs AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY start) AS run FROM begun),
cuts AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, run ORDER BY start) - 1) // 3 AS cut FROM runs),
names AS (SELECT doc_id, min(start) AS start, max("end") AS "end", string_agg(word, ' ' ORDER BY start) AS value, count(*) AS n, min(sentence) AS sentence, count(*) FILTER (g) AS g, count(*) FILTER (p) AS p, count(*) FILTER (s) AS s, count(*) FILTER (i) AS i,
  list_distinct(list(low) FILTER (length(word) > 1)) AS words, coalesce(string_agg(low, '' ORDER BY start) FILTER (length(word) = 1), '') AS initials, max_by(low, start) FILTER (length(word) > 1) AS surname FROM cuts GROUP BY doc_id, run, cut),
near AS (SELECT n.*, CASE WHEN n.start - mark_end <= 40 THEN speaks END AS speaks FROM names AS n ASOF LEFT JOIN m ON n.doc_id = m.doc_id AND n.start >= m.mark_end),
q AS (SELECT *, CASE WHEN n = 3 AND i = 0 THEN 0.6 WHEN i > 0 AND n > i THEN 0.8 WHEN g = 1 AND s = 1 THEN 0.7 ELSE 0.5 END + CASE WHEN speaks THEN 0.3 WHEN NOT speaks THEN -0.3 ELSE 0.0 END AS c FROM near WHERE (n = 3 AND i = 0) OR (i > 0 AND n > i) OR (n > 1 AND g + p > 0) OR (n = 1 AND i = 0 AND coalesce(speaks, false))),
people AS (SELECT * FROM (VALUES {_PERSON_VALUES}) AS t(person, own, form)),
sure AS (SELECT DISTINCT doc_id, {text("start")} AS sentence FROM ({sure}) JOIN {letters_sql()} AS l USING (doc_id)),
told AS (SELECT q.*, EXISTS (SELECT 1 FROM people WHERE form[len(form)] = surname AND ((len(words) > 1 AND len(list_intersect(words, form)) = len(words)) OR (len(words) = 1 AND ((length(initials) = 1 AND contains(own, initials)) OR (length(initials) = 2 AND initials = own))))) AS public, sure.doc_id IS NOT NULL AS sure FROM q LEFT JOIN sure USING (doc_id, sentence))
SELECT doc_id, 'fio' AS type_id, start, "end", value, round(CAST(greatest(least(c - CASE WHEN public THEN 0.3 ELSE 0.0 END + CASE WHEN sure THEN 0.2 ELSE 0.0 END, 1.0), 0.0) AS DOUBLE), 2) AS confidence, public FROM told WHERE NOT public OR coalesce(speaks, false) OR sure"""


_LETTERS_RESOLVED = _sql_resolved(union=f"{_LETTER_UNION}\nUNION ALL SELECT * FROM ({_sql_card_codes()})")
_HOLDER = f"(?i:{_alternatives(SPEC['card_holder'].context_words)})\\s*:?\\s*([A-Z]{{2,}}(?: [A-Z]{{2,}}){{1,2}})"
_CITIZEN = "(?i)(?:гражданство|гражданин|гражданка)\\s*:?\\s*((?:\\pL+ ){0,3}\\pL+)"
ORACLE_SQL = {
    "letters_dates": _sql_dates(), "letters_card_codes": _sql_card_codes(), "letters_names": _sql_names(),
    "letters_holders": f"SELECT doc_id, 'card_holder' AS type_id, start, \"end\", value, 0.8::DOUBLE AS confidence FROM {_sql_grouped(_HOLDER)}",
    "letters_citizenships": f"""SELECT doc_id, 'citizenship' AS type_id, start, CAST(start + length(v) AS INTEGER) AS "end", v AS value, 0.7::DOUBLE AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, start ORDER BY n DESC) AS r FROM (
      SELECT *, array_to_string(string_split(value, ' ')[1:n], ' ') AS v FROM (SELECT *, unnest(range(1, len(string_split(value, ' ')) + 1)) AS n FROM {_sql_grouped(_CITIZEN)})) WHERE replace(lower(v), 'ё', 'е') IN ({', '.join(map(_q, _COUNTRY_FORMS))})) WHERE r = 1""",
    "sql_entities": CATALOG_SQL["detect_resolved"], "sql_masked": CATALOG_SQL["mask_token"],
    "sql_roundtrip": _sql_resolved() + " SELECT (SELECT count(*) FROM documents) AS docs, (SELECT count(text) FROM documents) AS equal, (SELECT count(DISTINCT doc_id) FROM e) AS found",
    "observed_counters": "SELECT count(*) AS requests, count(*) FILTER (event_type = 'error') AS n_error, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'view') AS n_view, count(*) FILTER (event_id % 10 = 0) AS limited, count(*) FILTER (abs(value) <= 10) AS le_10, count(DISTINCT user_id) AS users FROM events",
    "sentence_words": f'SELECT doc_id, sentence, count(*) AS n, min(start) AS start, max("end") AS "end", CAST(sum(length(word)) AS BIGINT) AS letters FROM {_sql_words("documents")} GROUP BY doc_id, sentence',
    "asof_markers": f"""WITH w AS MATERIALIZED (SELECT * FROM {_sql_words("documents")}), m AS (SELECT doc_id, "end" AS mark_end, lower(word) AS said FROM w WHERE lower(word) IN ({", ".join(map(_q, MARKERS))})), r AS (SELECT doc_id, start, "end", word FROM w WHERE regexp_matches(word, '^[0-9]+$'))
      SELECT r.*, CASE WHEN start - mark_end <= 200 THEN said END AS said, CASE WHEN start - mark_end <= 200 THEN start - mark_end END AS distance FROM r ASOF LEFT JOIN m ON r.doc_id = m.doc_id AND r.start >= m.mark_end""",
    "numbers_outside": f'SELECT doc_id, start, "end", value FROM {_NUMBERS} AS n WHERE NOT EXISTS (SELECT 1 FROM {_STRUCTURED} AS f WHERE f.doc_id = n.doc_id AND f.start < n."end" AND n.start < f."end")',
    "numbers_inside": f'SELECT n.doc_id, n.start, n."end", f.type_id, f.start AS of_start, f."end" AS of_end FROM {_NUMBERS} AS n JOIN {_STRUCTURED} AS f ON f.doc_id = n.doc_id AND f.start < n."end" AND n.start < f."end"',
    "span_islands": f"""WITH s AS (SELECT doc_id, type_id, start, "end" FROM {_STRUCTURED} UNION ALL SELECT doc_id, 'number', start, "end" FROM {_NUMBERS}),
      b AS (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
      n AS (SELECT *, sum(CASE WHEN before IS NULL OR start > before + 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start, "end" DESC ROWS UNBOUNDED PRECEDING) AS island FROM b)
      SELECT doc_id, CAST(island AS BIGINT) AS island, min(start) AS start, max("end") AS "end", count(*) AS n, string_agg(DISTINCT type_id, ',' ORDER BY type_id) AS types FROM n GROUP BY doc_id, island""",
    "dictionary_words": f"SELECT doc_id, count(*) AS n, count(DISTINCT {_FOLD}) AS distinct_words FROM {_sql_words('documents')} WHERE {_FOLD} IN (SELECT {_FOLD} FROM {_sql_words('(SELECT item_id AS doc_id, text FROM benchmark)')}) GROUP BY doc_id",
    **{f"letters_{t}_spans": f'SELECT DISTINCT doc_id, start, "end", value, confidence FROM ({_sql_letter_candidates(t)})' for t in PATTERN_TYPES if t != "secret"},
    "letters_resolved": _LETTERS_RESOLVED + ' SELECT doc_id, type_id, start, "end", confidence FROM e',
    "letters_allowed": f"SELECT doc_id, start, \"end\", value FROM ({_sql_letter_candidates('inn')}) WHERE value <> '7707083893'",
    "sentence_companions": _LETTERS_RESOLVED + rf""", p AS (SELECT e.*, length(regexp_replace(left(text, start), '[^.!?\n]', '', 'g')) AS sentence FROM e JOIN {letters_sql()} AS l USING (doc_id))
      SELECT doc_id, type_id, start, sentence, sum(CASE WHEN confidence >= 0.8 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, sentence) - CASE WHEN confidence >= 0.8 THEN 1 ELSE 0 END > 0 AS beside FROM p""",
    "inflected_words": f'SELECT list, word, "case", count(*) AS n FROM (SELECT {_FOLD} AS form FROM {_sql_words(letters_sql())}) JOIN (VALUES {_FORM_VALUES}) AS f(list, word, "case", form) USING (form) GROUP BY ALL',
    "public_persons": f"""WITH {_RUNS}, p AS (SELECT * FROM (VALUES {_PERSON_VALUES}) AS t(person, own, form))
      SELECT DISTINCT doc_id, start, "end", person FROM names JOIN p ON p.form[len(p.form)] = names.surname WHERE (len(words) > 1 AND len(list_intersect(words, form)) = len(words)) OR (len(words) = 1 AND ((length(initials) = 1 AND contains(own, initials)) OR (length(initials) = 2 AND initials = own)))""",
    "name_forms": f"""WITH w AS (SELECT DISTINCT word, {_FOLD} AS low FROM {_sql_words(letters_sql())} WHERE regexp_matches(word, '^\\p{{Lu}}\\p{{Ll}}{{2,}}$')),
      f AS (SELECT *, CASE WHEN regexp_matches(low, '(ых|их|[оеиую]|[аеёиоуыэюя]а)$') AND NOT regexp_matches(low, '(ова|ева|ёва|ина|ына)$') THEN low
        WHEN regexp_matches(low, {_q(_OV)}) THEN low || ['', 'а', 'у', 'а', 'ым', 'е'][length(low) % 6 + 1] WHEN regexp_matches(low, '[сц]кий$') THEN left(low, length(low) - 2) || ['ий', 'ого', 'ому', 'ого', 'им', 'ом'][length(low) % 6 + 1]
        WHEN regexp_matches(low, 'ой$') THEN left(low, length(low) - 2) || ['ой', 'ого', 'ому', 'ого', 'ым', 'ом'][length(low) % 6 + 1] WHEN regexp_matches(low, 'ый$') THEN left(low, length(low) - 2) || ['ый', 'ого', 'ому', 'ого', 'ым', 'ом'][length(low) % 6 + 1]
        WHEN regexp_matches(low, {_q(_CONSONANT)}) THEN low || ['', 'а', 'у', 'а', 'ом', 'е'][length(low) % 6 + 1] ELSE low END AS form FROM w)
      SELECT word, CASE WHEN regexp_matches(low, '(ова|ева|ов|ев)$') THEN 'ov' WHEN regexp_matches(low, '(ина|ына|ин|ын)$') THEN 'in' WHEN regexp_matches(low, '(ская|цкая|ский|цкий)$') THEN 'sky' WHEN regexp_matches(low, '(ая|яя|ой|ый)$') THEN 'oy' WHEN regexp_matches(low, 'енко$') THEN 'enko'
          WHEN regexp_matches(low, 'ко$') THEN 'ko' WHEN regexp_matches(low, '(ук|юк)$') THEN 'uk' WHEN regexp_matches(low, 'ян$') THEN 'yan' WHEN regexp_matches(low, '(швили|дзе)$') THEN 'shvili' WHEN regexp_matches(low, '(их|ых)$') THEN 'ikh' WHEN regexp_matches(low, {_q(_CONSONANT)}) THEN 'consonant' ELSE 'indeclinable' END AS grp,
        CASE WHEN regexp_matches(low, {_q(_OV)}) THEN low || 'а' ELSE regexp_replace(regexp_replace(low, '([сц]к)ий$', '\\1ая'), '[оы]й$', 'ая') END AS her,
        CASE WHEN regexp_matches(low, '[йь]$') THEN left(low, length(low) - 1) || CASE WHEN length(low) % 2 = 0 THEN 'евна' ELSE 'евич' END WHEN regexp_matches(low, '[ая]$') THEN left(low, length(low) - 1) || CASE WHEN length(low) % 2 = 0 THEN 'ична' ELSE 'ич' END ELSE low || CASE WHEN length(low) % 2 = 0 THEN 'овна' ELSE 'ович' END END AS child,
        CASE WHEN low IN ('илья', 'никита', 'кузьма', 'фома', 'лука', 'савва') OR NOT regexp_matches(low, '[ая]$') THEN 'male' ELSE 'female' END AS sex,
        ['nom', 'gen', 'dat', 'acc', 'ins', NULL][length(low) % 6 + 1] AS case_name, CASE WHEN regexp_matches(word, '^\\p{{Lu}}') THEN upper(left(form, 1)) || substr(form, 2) ELSE form END AS form FROM f""",
}
