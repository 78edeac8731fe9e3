"""Product quantisation of vectors in whole numbers: codebooks by a tree of sums over columnar blocks.

Components become floor(scale * x). Vectors are packed into blocks, a block being a matrix of dimensions by
rows, so that a distance to all entries of a codebook accumulates dimension by dimension over whole
columns. Each round is one treeAggregate over the blocks: a task assigns its blocks' parts to their
nearest entries and adds them to int64 tensors of sums and counts (np.add.at), and the tensors, whose
size depends on the codebooks only, meet in a reduction tree. So a value that a third of all rows share
is a number of additions in the task that reads it. All arithmetic is exact and the
result does not depend on how rows are dealt.

Codebooks go to the tasks with their function: entries * dimensions numbers, whatever the rows.
An entry's starting value is that part of the vector with the next smallest id; with fewer vectors there are
fewer entries.

Defined cases: vectors that are null or hold null or non-finite components are dropped; of equal ids
the smaller vector starts an entry first, a null id comes last; repeated rows are rows of their own;
vectors of other lengths have codebooks of their own, and a length that no four equal parts fit has parts
of nearly equal length; an empty vector has code zeros; null labels are one label; components beyond
limit(length), where squared distances could leave 64 bits, count as that limit; an empty table gives
an empty table; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import finite_vectors, given_back, stored, table

#: Rows of a block, and rows whose distances are held at a time.
BLOCK, STEP = 4096, 256
BLOCKS = "size int, ids array<long>, labels array<string>, columns binary"


def limit(size: int) -> int:
    """The largest magnitude of a component for which squared distances fit 64 bits."""
    return math.isqrt((1 << 62) // max(1, size)) // 2


def cuts(size: int, parts: int) -> list[int]:
    return [k * size // parts for k in range(parts + 1)]


def _blocks(scale: int):
    def blocked(batches):
        for batch in batches:
            sizes = batch.column(2).to_numpy()
            for size in np.unique(sizes):
                rows = batch.take(pa.array(np.flatnonzero(sizes == size)))
                most = limit(int(size))
                # rows of one size lie one after another in the array's values
                x = rows.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows.num_rows, size)
                x = np.clip(np.floor(x * scale), -most, most).astype(np.int32)
                for at in range(0, rows.num_rows, BLOCK):
                    some = rows.slice(at, BLOCK)
                    columns = np.ascontiguousarray(x[at : at + BLOCK].T).tobytes()
                    yield pa.RecordBatch.from_pydict({"size": pa.array([size], pa.int32()), "ids": pa.array([some.column(0).to_pylist()], pa.list_(pa.int64())), "labels": pa.array([some.column(3).to_pylist()], pa.list_(pa.string())), "columns": pa.array([columns], pa.binary())})

    return blocked


def nearest(columns: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each column vector the nearest of the book's rows, the lower one of a tie, and the squared distance."""
    dims, n = columns.shape
    codes, errors = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not dims:
        return codes, errors
    reach = 2 * max(int(np.abs(columns).max(initial=0)), int(np.abs(book).max()))
    kind = np.int32 if dims * reach * reach < 1 << 31 else np.int64
    columns, entries = columns.astype(kind, copy=False), np.ascontiguousarray(book.T.astype(kind))
    for at in range(0, n, STEP):
        some = columns[:, at : at + STEP]
        total = np.zeros((some.shape[1], len(book)), kind)
        gap = np.empty_like(total)
        for d in range(dims):
            np.subtract.outer(some[d], entries[d], out=gap)
            np.multiply(gap, gap, out=gap)
            total += gap
        best = total.argmin(axis=1)
        codes[at : at + STEP], errors[at : at + STEP] = best, total[np.arange(len(best)), best]
    return codes, errors


def _columns(block, size: int) -> np.ndarray:
    return np.frombuffer(block, np.int32).reshape(size, -1) if size else np.zeros((0, 0), np.int32)


def refined(blocks: DataFrame, size: int, books: list[np.ndarray], depth: int = 2) -> list[np.ndarray]:
    """The codebooks after one round: every entry the floored mean of its parts; unused ones stay."""
    cut, k = cuts(size, len(books)), len(books[0])

    def add(tensors, row):
        tensors = tensors or [(np.zeros(b.shape, np.int64), np.zeros(k, np.int64)) for b in books]
        columns = _columns(row["columns"], size)
        for p, (sums, counts) in enumerate(tensors):
            part = columns[cut[p] : cut[p + 1]]
            codes, _ = nearest(part, books[p])
            np.add.at(sums, codes, part.T.astype(np.int64))
            np.add.at(counts, codes, 1)
        return tensors

    def merge(one, other):
        if not one or not other:
            return one or other
        return [(s + t, c + d) for (s, c), (t, d) in zip(one, other, strict=True)]

    tensors = blocks.select("columns").rdd.treeAggregate(None, add, merge, depth)
    return [np.where(c[:, None] > 0, s // np.maximum(c, 1)[:, None], b) for (s, c), b in zip(tensors, books, strict=True)]


def _starts(vectors: DataFrame, size: int, entries: int, parts: int, scale: int) -> list[np.ndarray]:
    first = vectors.where(F.col("size") == size).orderBy(F.asc_nulls_last("id"), "e").limit(entries).select("e").collect()
    x = np.array([r["e"] for r in first], np.float64).reshape(len(first), size)
    x = np.clip(np.floor(x * scale), -limit(size), limit(size)).astype(np.int64)
    cut = cuts(size, parts)
    return [x[:, cut[p] : cut[p + 1]] for p in range(parts)]


def compressed(vectors: DataFrame, entries: int = 256, parts: int = 4, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id") -> tuple[DataFrame, dict[int, list[np.ndarray]]]:
    """(id, code, error, label, label_error, codebooks_sha256) of every kept vector, and the codebooks by vector length."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    kept = finite_vectors(vectors, id_col)
    blocks = stored(kept.select("id", "e", "size", F.col("label").cast("string").alias("label")).mapInArrow(_blocks(scale), BLOCKS), "blocks")
    sizes = [r["size"] for r in blocks.select("size").distinct().collect()]  # lengths of vectors, commonly one
    books = {}
    for size in sizes:
        own = _starts(kept, size, entries, parts, scale)
        of_size = blocks.where(F.col("size") == size)
        for _ in range(rounds if size else 0):
            own = refined(of_size, size, own)
        books[size] = own
    digests = {size: hashlib.sha256(",".join(str(v) for book in own for v in book.ravel().tolist()).encode()).hexdigest() for size, own in books.items()}

    def coded(batches):
        for batch in batches:
            for row in batch.to_pylist():
                size, own, n = row["size"], books[row["size"]], len(row["ids"])
                cut, columns = cuts(size, parts), _columns(row["columns"], size)
                told = [nearest(columns[cut[p] : cut[p + 1]] if size else np.zeros((0, n), np.int32), own[p]) for p in range(parts)]
                digits = np.stack([c for c, _ in told], axis=1).astype(np.uint8).tobytes().hex()
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([row["block"]] * n, pa.int64()), "id": pa.array(row["ids"], pa.int64()), "label": pa.array(row["labels"], pa.string()),
                    "code": pa.array([digits[2 * parts * i : 2 * parts * (i + 1)] for i in range(n)], pa.string()), "error": pa.array(sum(e for _, e in told), pa.int64()), "digest": pa.array([digests[size]] * n, pa.string()),
                })

    numbered = blocks.withColumn("block", F.monotonically_increasing_id())
    rows = stored(numbered.mapInArrow(coded, "block long, id long, label string, code string, error long, digest string"), "codes")
    rows = rows.withColumns({"label": F.coalesce("label", F.lit("")), "none": F.col("label").isNull()})
    totals = rows.groupBy("none", "label").agg(F.sum("error").alias("label_error"))
    out = given_back(rows, totals, "block", ["none", "label"])
    return out.select(F.col("id").alias(id_col), "code", "error", F.when(~F.col("none"), F.col("label")).alias("label"), "label_error", F.col("digest").alias("codebooks_sha256")), books


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(table(spark, sf_dir, "embeddings"))[0].drop("label")
