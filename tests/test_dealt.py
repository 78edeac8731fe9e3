"""Work on rows is dealt over all cores, however few parts the files have; results are as of the file's own parts."""

import re

import pytest
from pyspark.sql import functions as F

from sievemark import catalog, relational_catalog
from sievemark.letters import letters
from sievemark.operators.context import Text
from sievemark.operators.detect import detect, detect_under, finder_for
from sievemark.operators.mask import mask
from sievemark.operators.spans import spans
from sievemark.plans.registry import Policy, Registry, RegistryError

from . import fixtures


def one_part(spark, folder, name, rows):
    rows.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def tasks_with_rows(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_letters_of_a_file_of_one_part(spark, tmp_path):
    where = one_part(spark, tmp_path, "customer", spark.range(400).select(F.col("id").alias("c_custkey")))
    assert tasks_with_rows(spark.read.parquet(f"{where}/customer.parquet")) == 1
    assert tasks_with_rows(letters(spark, where)) >= 8
    assert letters(spark, where).count() == 400
    assert tasks_with_rows(relational_catalog.letters_resolved(spark, where)) >= 8


def test_documents_of_a_file_of_one_part(spark, tmp_path):
    where = one_part(spark, tmp_path, "documents", spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a@b.cd and 12.").alias("text")))
    assert tasks_with_rows(catalog._docs(spark, where)) >= 8
    assert catalog.entity_counts(spark, where).collect()[0].asDict() == {"type_id": "email", "n": 400, "docs": 400}


def test_policies_of_two_thresholds_match_texts_once(spark, capsys):
    texts = [t for t, *_ in (*fixtures.GOLDEN, *fixtures.TRAPS, *fixtures.MASKED)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for of in (catalog.BASIC, catalog.EVERY):
        for least in (0.3, 0.8):
            policies = {p: Policy(types=of.types, min_confidence=least, trap_policy=p) for p in ("prefer_mask", "prefer_skip")}
            both = sorted(map(tuple, detect_under(docs, policies).collect()))
            assert both == sorted((r["doc_id"], name, *tuple(r)[1:]) for name, p in policies.items() for r in detect(docs, policy=p).collect())
    detect_under(docs, policies).explain("simple")
    assert capsys.readouterr().out.count("Scan ") == 1
    with pytest.raises(RegistryError):
        detect_under(docs, {"a": catalog.BASIC, "b": catalog.EVERY})


def test_a_text_without_cyrillic_has_latin_names_indexes_and_holders_only():
    finder = finder_for(Registry(), catalog.EVERY)
    text = "Petr Ivan Petrovich, 123456, 234567, cardholder ANNA SMITH, day of birth 01.02.1990. Anna Maria Smith in 30 Main"
    assert not Text(text).cyrillic
    assert [(e.type_id, text[e.start : e.end]) for e in finder.find(text, [])] == [
        ("fio", "Petr Ivan Petrovich"), ("birth_date", "01.02.1990"), ("address", "123456, 234567"), ("card_holder", "ANNA SMITH"),
    ]


def test_texts_are_dealt_before_they_are_cut_into_words(spark, tmp_path, capsys):
    where = one_part(spark, tmp_path, "documents", spark.range(40).select(F.col("id").alias("doc_id"), F.lit("One two. Three 4.").alias("text")))
    out = relational_catalog.sentence_words(spark, where)
    assert sorted(map(tuple, out.where("doc_id = 7").collect())) == [(7, 0, 2, 0, 7, 6), (7, 1, 2, 9, 16, 6)]
    out.explain("simple")
    plan = capsys.readouterr().out
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")


def test_places_of_matches_at_the_borders_of_runs(spark):
    texts = ["é-" * n + "x12 34" * (n % 3) for n in (0, 1, 63, 64, 65, 127, 128, 129, 4097)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [tuple(s) for s in r["s"] or []] for r in docs.select("doc_id", spans(F.col("text"), r"\p{L}+|\d+").alias("s")).collect()}
    assert got == {k: [(*m.span(), m[0]) for m in re.finditer(r"[^\W\d_]+|\d+", t)] for k, t in enumerate(texts)}


def test_stars_of_an_address_across_a_line_end(spark):
    docs = spark.createDataFrame([(1, "Eriner thanea.\nthe.65@mail7.example.com The")], "doc_id long, text string")
    assert mask(docs, policy=Policy(types=("email",), mask_mode="stars")).first()["masked_text"] == "Eriner **************@mail7.example.com The"


def test_islands_of_findings_at_one_place(spark, tmp_path, capsys):
    """A card and its number, a secret and an address: which of the two comes first in their order is left open, and of no account."""
    texts = ["+1 (683) 555-3495 build 4324262765231904 urdo +1 (135) 555-2316", "+1 (055) 555-1005 token fest.27@mail9.example.com +1 (309) 555-2887"]
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, texts[0]).otherwise(texts[1]).alias("text"))
    out = relational_catalog.span_islands(spark, one_part(spark, tmp_path, "documents", docs))
    runs = [[(1, 4, 17, 3, "number"), (2, 24, 40, 2, "card_number,number"), (3, 50, 63, 3, "number")], [(1, 4, 17, 3, "number"), (2, 24, 49, 2, "email,secret"), (3, 54, 67, 3, "number")]]
    out.explain("simple")
    assert len(re.findall(r"Sort \[[^\]]*end#\d+ DESC", capsys.readouterr().out)) == 1  # where islands begin and how they are counted come of one sort
    assert sorted(map(tuple, out.collect())) == [(k, *run) for k in range(200) for run in runs[k % 2]]
