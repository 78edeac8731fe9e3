"""Sources and sinks: corpora, dictionaries, audit rows and sealed mappings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS = "id string, text string, entities array<struct<type:string,start:int,end:int,text:string>>, source string"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Labelled texts, one JSON object a line."""
    return spark.read.schema(CORPUS).json(path)


def gold_spans(corpus: DataFrame, types: dict[str, str]) -> DataFrame:
    """(doc_id, type_id, start, end) of the labels that the map knows."""
    named = F.create_map(*[F.lit(x) for kv in types.items() for x in kv])
    return corpus.select(F.col("id").alias("doc_id"), F.explode("entities").alias("e")).select("doc_id", named[F.upper("e.type")].alias("type_id"), "e.start", "e.end").where("type_id is not null")


def read_dictionaries(spark: SparkSession, folder: str) -> DataFrame:
    """(list, word) of all *.txt files: a word or phrase a line, # comments, lower case, no ё."""
    lines = spark.read.text(folder, pathGlobFilter="*.txt").select("value", F.col("_metadata.file_name").alias("file"))
    word = F.trim("value")
    return lines.where((word != "") & ~word.startswith("#")).select(F.regexp_replace("file", r"\.txt$", "").alias("list"), F.translate(F.lower(word), "ё", "е").alias("word")).distinct()


#: A request belongs to a tenant; an id alone names none.
REQUEST = ("system_id", "payload_id")


def audit(processed: DataFrame, entities: DataFrame, timings: tuple[str, ...] = ()) -> DataFrame:
    """A row for each request with counts by type and never a value: system_id, payload_id, action, chars, counts, n_entities, and the timings.

    entities: system_id, payload_id, type_id; what one tenant's request holds is counted for that request only.
    timings: columns of processed that say how long a stage took, in milliseconds.
    """
    by_type = entities.groupBy(*REQUEST, "type_id").agg(F.count("*").alias("n"))
    counts = by_type.groupBy(*REQUEST).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type_id", "n")))).alias("counts"), F.sum("n").alias("n_entities"))
    told = processed.select(*REQUEST, "action", F.length("payload").alias("chars"), *timings)
    return told.join(counts, list(REQUEST), "left").withColumn("n_entities", F.coalesce("n_entities", F.lit(0)))


def sealed(mappings: DataFrame, key) -> DataFrame:
    """Originals encrypted with AES-GCM under a key of 16, 24 or 32 bytes."""
    return mappings.withColumn("sealed", F.aes_encrypt("original", key, F.lit("GCM"))).drop("original")


def unsealed(mappings: DataFrame, key) -> DataFrame:
    return mappings.withColumn("original", F.try_aes_decrypt("sealed", key, F.lit("GCM")).cast("string")).drop("sealed")
