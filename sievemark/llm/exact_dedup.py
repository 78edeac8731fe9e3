"""Exact duplicates: sorted digest runs, merged in a tree.

Texts are equal when identical after each run of white space became one space. Every partition of the
table writes a run: its rows sorted by the SHA-256 of their text, the last row of each text carrying the
number of its copies there. Then the runs' texts (not their rows) are exchanged in binomial rounds: with
partitions numbered in base F, round r gives a text to the partition whose digit r is that of the
text's digest, all other digits being kept. So a merge takes in F runs, holds the texts of one of
F**r slices of the digests, and no task ever has more than its share. Spark's sorter merges the runs that
arrive and spills what does not fit; the fold over them keeps, for every text, the smallest identifier and the sum of the
copies. A digest is believed only if the length in bytes and a second hash of the text agree too, at every
level: rows that differ in either stay apart.

A text that a third of all rows share is one row a run from the first step on. What the tree found goes
back the same way: first to the runs (a row for each run and text), then within a run to its rows, so
no join meets all copies under one key.

Defined cases: null counts as the empty text; a null id is larger than any other; of rows that repeat
the smallest id of a text the first read stays, so exactly one row of each group does; an empty table
gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, stored, table

#: What tells texts apart.
TEXT = ["digest", "n_bytes", "mark"]
RUN = "part int, digest binary, n_bytes long, mark long, id long, place long, copies long"
#: Runs that a merge takes in, at most.
FAN_IN = 16


def _last_rows(batches):
    """Sorted rows again, with a mask of those that end a text and the copies up to each of these."""
    held, since = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        known = rows.num_rows - 1
        ends = np.zeros(known, bool)
        for name in ("part", *TEXT):
            column = rows.column(name)
            ends |= pc.not_equal(column.slice(0, known), column.slice(1)).to_numpy(zero_copy_only=False)
        if known:
            head = rows.slice(0, known)
            sums = np.cumsum(head.column("copies").to_numpy())
            totals = np.diff(sums[ends], prepend=-since)
            since = int(sums[-1] - sums[ends][-1]) if ends.any() else since + int(sums[-1])
            yield head, ends, totals
        held = rows.slice(known).to_batches()[0]
    if held is not None:
        yield pa.Table.from_batches([held]), np.ones(1, bool), np.array([since + held.column("copies")[0].as_py()])


def _with_copies(rows: pa.Table, copies: np.ndarray):
    at = rows.schema.get_field_index("copies")
    return rows.set_column(at, "copies", pa.array(copies, pa.int64())).to_batches()


def _counted(batches):
    """A run: all its rows, copies told by the last row of each text and 0 elsewhere."""
    for rows, ends, totals in _last_rows(batches):
        copies = np.zeros(rows.num_rows, np.int64)
        copies[ends] = totals
        yield from _with_copies(rows, copies)


def _merged(batches):
    """A row for each text: the smallest identifier, and the copies of all runs."""
    for rows, ends, totals in _last_rows(batches):
        if ends.any():
            yield from _with_copies(rows.filter(pa.array(ends)), totals)


def _in_order(rows: DataFrame) -> DataFrame:
    """The smallest identifier of a text last."""
    return rows.sortWithinPartitions("part", *TEXT, F.desc_nulls_first("id"), F.desc("place"))


def tree_merged(runs: DataFrame, n_runs: int, fan_in: int = FAN_IN) -> DataFrame:
    """(text, id, place, copies) of every text; runs: RUN, numbered from 0."""
    rounds = max(1, math.ceil(math.log(max(2, n_runs), fan_in)))
    base = max(2, math.ceil(n_runs ** (1 / rounds)))
    slots = base**rounds
    slot = F.floor(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long") * slots / F.lit(1 << 32))
    for r in range(rounds):
        step = base**r
        digit = lambda c: F.floor(c / step) % base  # noqa: B023, E731
        goes = (F.col("part") + (digit(slot) - digit(F.col("part"))) * step).cast("int")
        runs = _in_order(runs.withColumn("part", goes).repartitionById(slots, "part")).mapInArrow(_merged, RUN)
    return runs


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row."""
    one = F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), f"[{SPACE_CLASS}]+", " ")
    hashed = docs.select(F.col(id_col).cast("long").alias("id"), one.alias("t")).select(
        F.spark_partition_id().alias("part"), F.unhex(F.sha2("t", 256)).alias("digest"), F.octet_length("t").cast("long").alias("n_bytes"), F.xxhash64("t").alias("mark"),
        "id", F.monotonically_increasing_id().alias("place"), F.lit(1).cast("long").alias("copies"),
    )
    rows = stored(_in_order(hashed).mapInArrow(_counted, RUN), "runs")
    runs = rows.where("copies > 0")
    n_runs = (rows.agg(F.max("part")).first()[0] or 0) + 1
    found = tree_merged(runs, n_runs, fan_in).select(*TEXT, F.col("id").alias("keep_id"), F.col("place").alias("keep_place"), F.col("copies").alias("group_size"))
    told = runs.select("part", *TEXT).join(found, TEXT)
    out = rows.drop("copies").join(told, ["part", *TEXT])
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("place") == F.col("keep_place")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256 FROM t WINDOW w AS (PARTITION BY text_sha256)"""
