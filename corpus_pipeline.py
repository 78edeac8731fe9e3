"""The corpus pipeline: quality, toxicity, near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; what it decides
takes effect. Rows travel as one struct, so other columns pass through and no name can clash. All but
the last return the columns of their input.

Defined cases: those of the stages' modules; documents without an id or without words stay through the
near-duplicate stage; of rows with equal id and text one stays there, the one whose row has the least
hash, and rows that repeat an id with other texts are documents of their own; empty tables pass
through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievemark.llm.common import WORD, stored, table
from sievemark.llm.jaccard_join import jaccard_components
from sievemark.llm.mixing import mixed_cells, with_cells
from sievemark.llm.piece_sampling import sampled
from sievemark.llm.quality_rules import judged, learned_rules
from sievemark.llm.toxicity import learnt, scored


def _rows(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(F.struct("*").alias("_row"), *columns)


def _hashable(value: Column, kind: T.DataType) -> Column:
    """The value with maps as sorted arrays of their entries, also inside arrays, structs and maps."""
    if isinstance(kind, T.MapType):
        entry = lambda e: F.struct(_hashable(e["key"], kind.keyType).alias("key"), F.to_json(F.array(_hashable(e["value"], kind.valueType))).alias("value"))
        return F.array_sort(F.transform(F.map_entries(value), entry))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _hashable(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.struct(F.lit(0).alias("_"), F.isnull(value), *[_hashable(value[f.name], f.dataType) for f in kind])
    if isinstance(kind, T.VariantType):
        return F.to_json(value)
    return value


def _row_hash(docs: DataFrame) -> Column:
    """A hash of the whole row, of any column types."""
    return F.xxhash64(*[_hashable(F.col(f"`{f.name}`"), f.dataType) for f in docs.schema])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rules = learned_rules(docs, table(spark, sf_dir, "labels"))
    return judged(_rows(docs, "text"), rules).where("kept").select("_row.*")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = learnt(docs, table(spark, sf_dir, "labels"))
    return scored(_rows(docs, "text"), model).where("predicted = 0").select("_row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = jaccard_components(docs.select("doc_id", "text"), n=5, percent=80)
    first = found.where("part is not null").groupBy("part").agg(F.min(F.struct("doc_id", "text_hash")).alias("of")).select("of.doc_id", "of.text_hash")
    rows = docs.select(F.struct("*").alias("_row"), "doc_id", "text", _row_hash(docs).alias("_hash")).withColumn("text_hash", F.xxhash64("text"))
    kept = rows.join(first, ["doc_id", "text_hash"], "left_semi").groupBy("doc_id", "text_hash").agg(F.min_by("_row", "_hash").alias("_row"))
    alone = F.col("doc_id").isNull() | ~F.coalesce(F.col("text"), F.lit("")).rlike(WORD)
    return kept.select("_row").unionByName(rows.where(alone).select("_row")).select("_row.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    drawn = mixed_cells(stored(with_cells(_rows(docs, "doc_id", "text", "source", "lang")), "placed"))
    return drawn.where("sampled").select("_row.*")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sampled(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", token_stage),
]

#: The learned stages and the sampled segmentations can't be written in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage{k}")
    return docs
