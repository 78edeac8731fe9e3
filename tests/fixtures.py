"""Texts and what must come of them."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievemark.functions.morphology import CASES, Morphology
from sievemark.operators.context import ContextFinder
from sievemark.operators.detect import candidates, detect
from sievemark.operators.mask import mask, unmask
from sievemark.plans.allow import AllowList
from sievemark.plans.dictionaries import Dictionaries
from sievemark.plans.registry import TYPES, Policy, Registry

# ---- fixed values: texts, and what is found in them, masked or restored ----
#: A text, a type and the span of it that is found, at no threshold; empty: nothing.
GOLDEN = (
    ("карта 4111-1111-1111-1111", "card_number", "4111-1111-1111-1111"), ("карта 4276 3800 1234 5674", "card_number", "4276 3800 1234 5674"), ("ИНН 7707083893", "inn", "7707083893"),
    ("ИНН 500100732259", "inn", "500100732259"), ("ИНН 7707083894", "inn", ""), ("СНИЛС 112-233-445 95", "snils", "112-233-445 95"), ("СНИЛС 123 - 456 - 789 01", "snils", "123 - 456 - 789 01"),
    ("тел. +7 (912) 345-67-89", "phone", "+7 (912) 345-67-89"), ("тел. (912) 345-67-89", "phone", "(912) 345-67-89"), ("номер 12345", "phone", ""), ("почта a+b@sub.domain.org", "email", "a+b@sub.domain.org"),
    ("tkut @ uraltrd . ru", "email", "tkut @ uraltrd . ru"), ("серия 4509 номер 123456", "passport", "4509 номер 123456"), ("в/у 77 12 345678", "driver_license", "77 12 345678"), ("77 12 345678", "driver_license", ""),
    ("код подразделения 770-001", "subdivision_code", "770-001"), ("770-001", "subdivision_code", ""), ("CVV-код 317 введён", "cvv", "317"), ("пин-код 1234", "card_pin", "1234"), ("Пин 4821 от домофона.", "card_pin", ""),
    ("выдан 12.05.2010", "passport_issue_date", "12.05.2010"), ("06.06.1988 г.р.", "birth_date", "06.06.1988"), ("родился пятого мая 1985", "birth_date", "пятого мая 1985"), ("родился 12.05.2099", "birth_date", ""),
    ("родился в Ростове-на-Дону", "birth_place", "Ростове-на-Дону"), ("гражданин Республики Беларусь", "citizenship", "Республики Беларусь"), ("выдан ОУФМС России по г. Москве 12.05.2010", "passport_issuer", "ОУФМС России по г. Москве"),
    ("101000, г. Москва, ул. Ленина, д. 5, кв. 12", "address", "101000, г. Москва, ул. Ленина, д. 5, кв. 12"), ("Иван Иванович Иванов", "fio", "Иван Иванович Иванов"), ("Иванов И. И.", "fio", "Иванов И. И."),
    ("клиент Ким Чен Ир", "fio", "Ким Чен Ир"), ("клиент: сидоров ПЁТР иванович, тел 89123456789", "fio", "сидоров ПЁТР иванович"), ("держатель IVAN PETROV", "card_holder", "IVAN PETROV"),
    ("Карта 4276 5500 1122 3347, код 482.", "cvv", "482"), ("Карта 4276 5500 1122 3347, код 4821.", "card_pin", "4821"), ("ул. Гагарина 28", "address", "ул. Гагарина 28"), ("карта 4111\u00a01111\u00a01111\u00a01111", "card_number", "4111\u00a01111\u00a01111\u00a01111"),
)
#: The same at the threshold of 0.3: texts that look like personal data, and some that do not look like it but are.
TRAPS = (
    ("Клиент Романов, ИНН 7707083893", "inn", "7707083893"), ("аттестат сдан, ИНН 7707083893", "inn", "7707083893"), ("Шумеров, почта a.b@mail.ru", "email", "a.b@mail.ru"), ("тест, ИНН 7707083893", "inn", ""),
    ("cvv код ошибки 317", "cvv", ""), ("CVV ошибка 317", "cvv", ""), ("нужен cvc, вот 123", "cvv", "123"), ("4276 3800 1234 5674", "card_number", ""), ("не является картой 4276 3800 1234 5674", "card_number", ""),
    ("Поэт Александр Пушкин написал Евгения Онегина", "fio", ""), ("Клиент Пушкин Иван Сергеевич, паспорт 4509 123456", "fio", "Пушкин Иван Сергеевич"), ("Клиент Пушкин Иван Сергеевич, паспорт 4509 123456", "passport", "4509 123456"),
    ("Отделение банка: г. Москва, ул. Тверская, д. 1", "address", ""), ("Проживает: г. Москва, ул. Тверская, д. 1", "address", "г. Москва, ул. Тверская, д. 1"), ("Лев Николаевич Толстой родился в 1828 году", "fio", ""),
    ("Накладная 9876 543210", "address", ""), ("горячая линия 8 800 555-35-35", "phone", ""), ("тел 8 800 555-35-35", "phone", "8 800 555-35-35"), ("Паспорт клиента: 4512 345678. Код заявки: 12.", "passport", "4512 345678"),
)
PERSONS = ("Александр Сергеевич Пушкин", "Лев Николаевич Толстой", "Антон Павлович Чехов")
#: A text, and how tokens mask it.
MASKED = (
    ("ИНН 7707083893 и ИНН 500100732259", "ИНН <<INN_1>> и ИНН <<INN_2>>"), ("Проживает: г. Казань, ул. Баумана, д. 14, кв. 8.", "Проживает: г. <<ADDR_1>>, ул. <<ADDR_2>>, д. <<ADDR_3>>, кв. <<ADDR_4>>."),
    ("Клиент Иванов Иван Иванович, ИНН 7707083893, тел. +7 (912) 345-67-89. Иванов Иван Иванович просил перезвонить.", "Клиент <<FIO_1>>, ИНН <<INN_1>>, тел. <<PHONE_1>>. <<FIO_1>> просил перезвонить."), ("нет данных", "нет данных"),
)
#: A text with tokens, an original of a type, and what is restored.
RESTORED = (
    ("дать <<FIO_1:дат>>", "fio", "Иванов Иван Иванович", "дать Иванову Ивану Ивановичу"), ("<< fio_1 >> и <<FIO_2>>", "fio", "Иванов Иван Иванович", "Иванов Иван Иванович и <<FIO_2>>"), ("<<BPLACE_1:им>>", "birth_place", "Москве", "Москва"),
    ("<<BPLACE_1:пр>>", "birth_place", "Москве", "Москве"), ("<<FIO_1:дат>>", "fio", "Иванову Ивану Ивановичу", "Иванову Ивану Ивановичу"), ("<<INN_1:род>>", "inn", "7707083893", "7707083893"), ("<<FIO_1:xyz>>", "fio", "Иванов Иван", "<<FIO_1:xyz>>"),
)
#: A kind, a nominative and its other cases.
INFLECTED = (
    ("person", "Иванов Иван Иванович", "Иванова Ивана Ивановича|Иванову Ивану Ивановичу|Иванова Ивана Ивановича|Ивановым Иваном Ивановичем|Иванове Иване Ивановиче"),
    ("person", "Кузнецова Любовь Андреевна", "Кузнецовой Любови Андреевны|Кузнецовой Любови Андреевне|Кузнецову Любовь Андреевну|Кузнецовой Любовью Андреевной|Кузнецовой Любови Андреевне"),
    ("person", "Толстой Лев Николаевич", "Толстого Льва Николаевича|Толстому Льву Николаевичу|Толстого Льва Николаевича|Толстым Львом Николаевичем|Толстом Льве Николаевиче"),
    ("person", "Шевченко Тарас Григорьевич", "Шевченко Тараса Григорьевича|Шевченко Тарасу Григорьевичу|Шевченко Тараса Григорьевича|Шевченко Тарасом Григорьевичем|Шевченко Тарасе Григорьевиче"),
    ("place", "Москва", "Москвы|Москве|Москву|Москвой|Москве"), ("place", "Казань", "Казани|Казани|Казань|Казанью|Казани"), ("place", "Омск", "Омска|Омску|Омск|Омском|Омске"), ("place", "Сочи", "Сочи|Сочи|Сочи|Сочи|Сочи"),
    ("place", "Нижний Новгород", "Нижнего Новгорода|Нижнему Новгороду|Нижний Новгород|Нижним Новгородом|Нижнем Новгороде"), ("country", "Россия", "России|России|Россию|Россией|России"),
    ("country", "Российская Федерация", "Российской Федерации|Российской Федерации|Российскую Федерацию|Российской Федерацией|Российской Федерации"), ("street", "ул. Садовая", "ул. Садовой|ул. Садовой|ул. Садовую|ул. Садовой|ул. Садовой"),
)
#: Requests (system, id, text, second) in order, and what each gets.
DIALOGUE = (
    ("a", "1", "ИНН 7707083893", 0, "mask", "ИНН <<INN_1>>"), ("a", "1", "ИНН 7707083893", 1, "repeat", "ИНН <<INN_1>>"), ("a", "1", "вот <<inn_1>>", 2, "restore", "вот 7707083893"), ("b", "1", "ИНН 7707083893", 0, "mask", "ИНН <<INN_1>>"),
    ("b", "1", "ИНН <<INN_1>>", 1, "echo", "ИНН <<INN_1>>"), ("c", "1", "x", 0, "refused", None), ("a", "2", "", 0, "empty", ""),
)
SSE = 'data: {"choices":[{"delta":{"content":"Здрав"}}]}\n\ndata: {"choices":[{"delta":{"content":"ствуйте"}}]}\n\ndata: {"choices":[{"delta":{}}]}\n\ndata: [DONE]\n\ndata: {"choices":[{"delta":{"content":"!"}}]}\n'
# ---- end of fixed values ----


def _inline(spark, rows, schema: str) -> DataFrame:
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"doc_id long, {schema}")


def _golden(spark, cases, least: float) -> DataFrame:
    docs = _inline(spark, cases, "text string, type_id string, expected string").select("doc_id", "text", "type_id")
    policy = Policy(types=tuple(t.id for t in TYPES if t.enabled_by_default), min_confidence=least)
    finder = ContextFinder(Registry(), policy, Dictionaries.built_in(), AllowList(PERSONS))
    # the span that a resolution by length and confidence alone would keep for the type
    found = (detect if least else candidates)(docs.select("doc_id", "text"), policy=policy, finder=finder).join(docs.select("doc_id", "type_id"), ["doc_id", "type_id"])
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc(F.col("end") - F.col("start")), F.desc("confidence"), "start"))
    best = found.withColumn("k", first).where("k = 1").select("doc_id", "value")
    return docs.select("doc_id").join(best, "doc_id", "left").select("doc_id", F.coalesce("value", F.lit("")).alias("found"))


def golden_spans(spark):
    return _golden(spark, GOLDEN, 0.0)


def golden_traps(spark):
    return _golden(spark, TRAPS, 0.3)


def golden_masks(spark):
    return mask(_inline(spark, MASKED, "text string, expected string").select("doc_id", "text")).select("doc_id", "masked_text")


def golden_restored(spark):
    rows = _inline(spark, RESTORED, "masked_text string, type_id string, original string, expected string")
    label = F.element_at(F.create_map(*[F.lit(x) for t in TYPES for x in (t.id, t.token_label)]), F.col("type_id"))
    given = rows.select("doc_id", "masked_text", F.array(F.struct("type_id", "original", F.concat(F.lit("<<"), label, F.lit("_1>>")).alias("masked"))).alias("mappings"))
    return unmask(given).select("doc_id", "restored_text")


def golden_inflection(spark):
    """Both ways: from the nominative, and back to it."""
    rows = [(kind, word, form, case) for kind, word, rest in INFLECTED for case, form in zip(CASES, [word, *rest.split("|")], strict=True)]
    frame = _inline(spark, rows, "kind string, word string, form string, case string")

    def inflected(batches):
        morphology = Morphology(Dictionaries.built_in())
        for pdf in batches:
            there = [morphology.inflect(w, k, c) for w, k, c in zip(pdf["word"], pdf["kind"], pdf["case"], strict=True)]
            back = [morphology.inflect(f, k, "nom") for f, k in zip(pdf["form"], pdf["kind"], strict=True)]
            yield pdf[["doc_id"]].assign(there=there, back=back)

    return frame.mapInPandas(inflected, "doc_id long, there string, back string")
