"""Embedding near-duplicates: spherical k-means cells, blocked cosines, one representative a group.

Vectors with equal labels whose cosine reaches the threshold are linked. Centroids are fitted on a
bounded sample (sample_rows), as many as leave about rows_a_cell vectors of the commonest label in a
cell, at most max_cells; every vector is then assigned. Two unit vectors with cosine >= t lie within
d = sqrt(2 - 2t) of each other. If they are at home in cells p and q, the plane between p's and q's
centroid lies between them, so one of them is within d / 2 of it: it is compared as a guest in the other's
cell. A vector's distance from that plane is the difference of its cosines to both centroids over their
distance. If both are guests of each other, the lower cell counts. So the search is exact at any size:
recall doesn't depend on the fit, only the work does.

Equal vectors are one class with a multiplicity. A cell is split into blocks of vectors and block
pairs are compared as matrix products; a block pair gives, for each vector with links, their
number and the smallest vector of its local group, never the pairs themselves.

Defined cases: null, empty and zero vectors, vectors with null or non-finite components and null
labels are linked with nothing (component is the own id, n_links 0); finite vectors of any magnitude are
compared; vectors of other lengths are never compared; repeated rows count as vectors of their own; null vec_id has a null component; an
empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, table
from .components import components

BLOCK = 2048
#: Bytes of the sample that the driver fits cells on, at most.
SAMPLE_BYTES = 64 << 20


def _matrix(column, size: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return unit_rows(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), size))


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length 1. The largest component goes first, so that squares neither over- nor underflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k unit centroids of unit rows; starts from rows spread over the input, empty cells keep their centroid."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        home = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, home, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), c)
    return c


def fitted(vectors: DataFrame, sample_rows: int, rows_a_cell: int, max_cells: int) -> dict[int, np.ndarray]:
    """Centroids by vector length, from at most sample_rows vectors, fewer where these are more than SAMPLE_BYTES."""
    total, longest = vectors.agg(F.count("*"), F.max("size")).first()
    most = min(sample_rows, max(1, SAMPLE_BYTES // (8 * (longest or 1))))
    sample = vectors.orderBy(F.xxhash64("e"), "id").limit(most).select("size", "label", "e").toArrow().combine_chunks()
    out, sizes = {}, sample.column("size").to_numpy()
    for size in np.unique(sizes):
        own = sample.filter(pa.array(sizes == size)).combine_chunks()
        x = _matrix(own.column("e"), int(size))
        commonest = max(Counter(own.column("label").to_pylist()).values()) * total // sample.num_rows
        out[int(size)] = spherical_kmeans(x, min(max_cells, max(1, commonest // rows_a_cell), len(x)))
    return out


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, sample_rows: int = 10_000, rows_a_cell: int = 1000, max_cells: int = 1024, id_col: str = "vec_id", block: int = BLOCK) -> DataFrame:
    """(id, n_links, component_id, kept) of every row; vectors: id, embedding, label."""
    kind = vectors.schema["embedding"].dataType
    e = F.col("embedding") if kind == T.ArrayType(T.FloatType()) else F.col("embedding").cast("array<double>")
    array = "array<float>" if kind == T.ArrayType(T.FloatType()) else "array<double>"
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & e.isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda x: x != 0) & F.col(id_col).isNotNull(), F.lit(False))
    every = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(usable, e).alias("e"), F.when(usable, F.col("label").cast("string")).alias("label"))
    hashed = every.withColumns({"d1": F.xxhash64(F.lit(1), "e"), "d2": F.xxhash64(F.lit(2), F.reverse("e")), "size": F.size("e")})
    classes = hashed.where("e is not null").groupBy("label", "size", "d1", "d2").agg(F.min(F.struct("id", "e")).alias("of"), F.count("*").alias("copies"))
    classes = stored(classes.select("label", "size", "d1", "d2", "of.id", "of.e", "copies"), "vectors")
    centroids = fitted(classes, sample_rows, rows_a_cell, max_cells)
    reach = float(np.sqrt(2 - 2 * threshold)) / 2 + 1e-9

    def assign(batches):
        """Each vector with its home, and all cells where it is compared."""
        for batch in batches:
            size = batch.column(3).to_numpy()
            for s in np.unique(size):
                rows = batch.take(pa.array(np.flatnonzero(size == s)))
                n = rows.num_rows
                if s in centroids:
                    c = centroids[s]
                    cosines = _matrix(rows.column(1), int(s)) @ c.T
                    home = cosines.argmax(axis=1)
                    apart = np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T)))
                    member = cosines[np.arange(n), home][:, None] - cosines <= reach * apart[home] + 1e-9
                    member[np.arange(n), home] = True
                else:
                    home, member = np.zeros(n, int), np.ones((n, 1), bool)
                row, cell = np.nonzero(member)
                bounds = np.concatenate([[0], np.cumsum(member.sum(axis=1))])
                cells = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(cell.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(home.astype(np.int32)), cells], ["id", "e", "label", "size", "copies", "home", "cells"])

    placed = classes.select("id", "e", "label", "size", "copies").mapInArrow(assign, f"id long, e {array}, label string, size int, copies long, home int, cells array<int>")
    placed = stored(placed, "cells")
    each = placed.select("id", "label", "size", F.explode("cells").alias("cell"))
    blocks = each.groupBy("label", "size", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    rows = placed.select("*", F.explode("cells").alias("cell")).join(blocks, ["label", "size", "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("label", "size", "cell", F.least("block", "other").alias("lower"), F.greatest("block", "other").alias("upper"), "id", "e", "copies", "home", "cells", "block")

    def compare(key, part):
        size, cell, lower, upper = (key[k].as_py() for k in (1, 2, 3, 4))
        part = part.combine_chunks()
        ids, copies, home, block = (part.column(c).to_numpy() for c in ("id", "copies", "home", "block"))
        cells = part.column("cells").combine_chunks() if isinstance(part.column("cells"), pa.ChunkedArray) else part.column("cells")
        x = _matrix(part.column("e"), size)
        stands = np.zeros((len(ids), int(max(cells.flatten().to_numpy().max(), home.max())) + 1), bool)
        stands[np.repeat(np.arange(len(ids)), np.diff(cells.offsets.to_numpy())), cells.flatten().to_numpy()] = True
        here = home == cell
        a, b = np.flatnonzero(block == lower), np.flatnonzero(block == upper)
        n_links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        def counts(one: np.ndarray, other: np.ndarray) -> np.ndarray:
            """Whether a pair with one at home here counts here: the other is too, or one is no guest there, or this cell is the lower."""
            there = home[other]
            return here[one][:, None] & (here[other][None] | ~stands[one][:, there] | (cell < there)[None])

        for k in range(0, len(a), 256):
            some = a[k : k + 256]
            linked = (x[some] @ x[b].T >= threshold) & (counts(some, b) | counts(b, some).T)
            if lower == upper:
                linked &= some[:, None] < b[None]
            for i, row in zip(some, linked, strict=True):
                mates = b[row]
                if len(mates):
                    n_links[i] += copies[mates].sum()
                    n_links[mates] += copies[i]
                    tops = np.unique(root[mates])
                    for m in tops:
                        u, v = find(i), find(m)
                        if u != v:
                            root[max(u, v, key=lambda q: ids[q])] = min(u, v, key=lambda q: ids[q])
        at = np.flatnonzero(n_links)
        return pa.table({"id": ids[at], "links": n_links[at], "top": ids[[find(i) for i in at]] if len(at) else np.zeros(0, np.int64)})

    found = stored(rows.groupBy("label", "size", "cell", "lower", "upper").applyInArrow(compare, "id long, links long, top long"), "links")
    parts = components(found.select(F.col("id").alias("a"), F.col("top").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    known = classes.drop("e").join(links, "id", "left").join(parts.withColumnRenamed("node", "id"), "id", "left")
    known = known.select("label", "size", "d1", "d2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = hashed.drop("e").join(stored(known, "known"), ["label", "size", "d1", "d2"], "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
