"""The engine's functions for SQL: pii_detect, pii_mask, pii_unmask, and pii_entities for LATERAL.

They are Spark SQL functions (CREATE TEMPORARY FUNCTION ... RETURN) whose bodies are the expressions that the
DataFrame operators use, written out as SQL, so that Catalyst plans both alike: no Python runs, and columns are
pruned and filters pushed as in any query. They find types that patterns tell; types that need
word lists and surroundings are found by `detect` and `mask` only.

    register(spark, Policy(types=("email", "inn")))
    SELECT doc_id, e.* FROM documents, LATERAL pii_entities(text) AS e
    SELECT pii_mask(text).masked_text FROM documents
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .operators.detect import ENTITY, entity_steps, found_steps
from .operators.mask import MAPPINGS, mappings_of, plan_steps, restored, rewritten
from .plans.registry import Policy, Registry, RegistryError

MASKED = f"STRUCT<masked_text: STRING, n_entities: BIGINT, mappings: {MAPPINGS}>"
FUNCTIONS = ("pii_detect", "pii_mask", "pii_unmask", "pii_entities")
#: What Spark writes of an expression, cut so that string literals stay whole.
_PIECES = re.compile(r"'(?:[^'\\]|\\.)*'|[^']+", re.DOTALL)
#: Operators, which Spark writes as calls, and names that are keywords: both are names of functions and fields in quotes.
_CALLS = re.compile(r"(?<![\w`])(<=>|<=|>=|[<>=+\-*/%!]|and|or|not|in)(?=\()")
_ALIASES = re.compile(r"\bAS (start|end|at|last)\b")


def written(column: Column) -> str:
    """The column as an expression of Spark SQL."""
    pieces = _PIECES.findall(column._jc.node().sql())
    return "".join(p if p.startswith("'") else _ALIASES.sub(r"AS `\1`", _CALLS.sub(r"`\1`", p)) for p in pieces)


class Steps:
    """Notes columns as a DataFrame would add them. In SQL each is a variable that the later ones are functions of, so that none is computed twice."""

    def __init__(self, spark: SparkSession, **given: str):
        self.sparkSession, self.steps = spark, list(given.items())

    def withColumns(self, columns: dict[str, Column]) -> Steps:
        self.steps += [(name, written(c)) for name, c in columns.items()]
        return self

    def withColumn(self, name: str, column: Column) -> Steps:
        return self.withColumns({name: column})

    def withColumnRenamed(self, name: str, new: str) -> Steps:
        return self.withColumn(new, F.col(name))

    def drop(self, *_: str) -> Steps:
        return self

    def giving(self, column: Column) -> str:
        """The SQL of a column of these."""
        out = written(column)
        for name, expression in reversed(self.steps):
            out = f"element_at(transform(array({expression}), {name} -> {out}), 1)"
        return out


def register(spark: SparkSession, policy: Policy | None = None, registry: Registry | None = None, prefix: str = "pii_") -> None:
    """The four functions for this session, under a policy; another prefix holds another policy's."""
    registry, policy = registry or Registry(), policy or Policy()
    native = tuple(t.id for t in registry.enabled(policy) if t.found_by == "patterns")
    if policy.types is not None and set(policy.types) - set(native):
        raise RegistryError(f"not by patterns alone: {', '.join(sorted(set(policy.types) - set(native)))}")
    modes = {policy.mask_mode, *policy.overrides.values()}
    if modes & {"pseudonym", "synthetic"}:
        raise RegistryError("pseudonyms are not made in SQL")
    if {"cvv", "card_pin"} & set(native):
        raise RegistryError("cvv and card_pin look at cards beside them; use detect")
    policy = Policy(**{**policy.__dict__, "types": native})
    told = entity_steps(found_steps(Steps(spark, _text="t"), registry, policy, None), registry, False)
    _create(spark, f"{prefix}detect", "t STRING", f"ARRAY<{ENTITY}>", told.giving(F.col("_entities")))
    table = "TABLE(start INT, `end` INT, type_id STRING, value STRING, confidence DOUBLE)"
    # a generator of the text itself, so that LATERAL becomes a step over the rows and no join
    _create(spark, f"{prefix}entities", "t STRING", table, f"SELECT * FROM inline({told.giving(F.col('_entities'))}) AS g(start, `end`, type_id, value, confidence)")
    masked = F.when(F.col("_text").isNotNull(), F.struct(rewritten(F.col("_text"), F.col("_chunks"), F.col("_plan")).alias("masked_text"), F.size("_plan").cast("long").alias("n_entities"), F.coalesce(mappings_of(F.col("_plan")), F.array().cast(MAPPINGS)).alias("mappings")))
    _create(spark, f"{prefix}mask", "t STRING", MASKED, plan_steps(told, registry, policy, None).giving(masked))
    back = restored(F.col("_text"), F.coalesce(F.col("_mappings"), F.array().cast(MAPPINGS)))
    _create(spark, f"{prefix}unmask", f"t STRING, m {MAPPINGS}", "STRING", Steps(spark, _text="t", _mappings="m").giving(back))


def _create(spark: SparkSession, name: str, takes: str, gives: str, body: str) -> None:
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS {gives} RETURN {body}")
