"""Whitening of vectors: principal components of a covariance that Spark sums over exactly centred rows.

Components become whole numbers floor(scale * c). The fit list has each distinct vector of these once.
Its rows are centred without rounding, as n * x - S with S the sums of each dimension, and go to a
RowMatrix whose Gramian, over n cubed, is the covariance of x. Its eigenvectors are found on the
driver (a matrix of dimensions by dimensions, whatever the rows) and the few that are asked for go to the
tasks, a broadcast of components * dimensions numbers. The check of the result is a pass of its own: the
covariance of the whitened fit list.

Copies leave in the distinct step, which meets them in each task before its shuffle, so a vector that a
third of all rows share weighs as one row.

Defined cases: vectors that are null or hold null or non-finite entries are dropped, empty ones too;
vectors of each length are whitened by themselves; a vector has as many components as dimensions at
most; a component without variance has whitened null and is left out of identity_error (null if none is
left), explained is null if all have none; entries count as LIMIT at most; a deviation beyond 64 bits is null;
repeated rows and ids are rows of their own; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import finite_vectors, stored, table

#: The largest magnitude of a whole number; beyond it the deviation of two rows leaves 64 bits.
LIMIT = 1 << 31
OUT = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _sums(batches):
    for batch in batches:
        sizes = batch.column(1).to_numpy()
        for size in np.unique(sizes):
            rows = batch.column(0).take(pa.array(np.flatnonzero(sizes == size)))
            total = rows.flatten().to_numpy().reshape(-1, size).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size, size, np.int32)), pa.array(np.arange(size, dtype=np.int32)), pa.array(total, pa.int64())], ["size", "at", "total"])


class Model:
    """What whitens vectors of one length: n, sums, and the components (rows of axes) with their eigenvalues."""

    def __init__(self, n: int, sums: np.ndarray, covariance: np.ndarray, components: int):
        values, vectors = np.linalg.eigh(covariance)
        trace, least = float(np.trace(covariance)), float(values[-1]) * len(values) * np.finfo(float).eps
        some = list(range(len(values) - 1, -1, -1))[:components]
        self.n, self.sums, self.axes = n, sums, vectors[:, some].T
        self.values = [float(values[k]) if values[k] > max(least, 0.0) else 0.0 for k in some]
        self.explained = [max(float(values[k]), 0.0) / trace if trace > 0 else None for k in some]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: as Python numbers where 64 bits might not do."""
        most = max(int(np.abs(x).max(initial=0)), 1) * self.n + int(np.abs(self.sums).max(initial=0))
        kind = np.int64 if most < 1 << 62 else object
        return x.astype(kind) * self.n - self.sums.astype(kind)

    def whitened(self, gaps: np.ndarray) -> np.ndarray:
        """A column for each component; those without variance are NaN."""
        scale = np.array([v**-0.5 if v else np.nan for v in self.values])
        return (gaps / self.n).astype(np.float64) @ self.axes.T * scale

    @staticmethod
    def deviations(gaps: np.ndarray) -> list[int | None]:
        most = int(np.abs(gaps).max(initial=0))
        if most * most * gaps.shape[1] < 1 << 63:
            return (gaps * gaps).sum(axis=1).tolist()
        exact = [sum(int(g) ** 2 for g in row) for row in gaps]
        return [d if d < 1 << 63 else None for d in exact]


def fitted(fit: DataFrame, components: int) -> dict[int, Model]:
    """A model for each length of the distinct vectors; fit: x, size."""
    counts = {r["size"]: r["n"] for r in fit.groupBy("size").agg(F.count("*").alias("n")).collect()}
    sums = {size: np.zeros(size, np.int64) for size in counts}
    for r in fit.mapInArrow(_sums, "size int, at int, total long").groupBy("size", "at").agg(F.sum("total").alias("total")).collect():
        sums[r["size"]][r["at"]] = r["total"]
    models = {}
    for size, n in counts.items():
        centred = F.zip_with("x", F.array(*[F.lit(int(s)) for s in sums[size]]), lambda a, s: (a * n - s).cast("double"))  # noqa: B023
        rows = fit.where(F.col("size") == size).select(array_to_vector(centred).alias("row"))
        gramian = RowMatrix(MLUtils.convertVectorColumnsFromML(rows, "row"), n, size).computeGramianMatrix().toArray()
        models[size] = Model(n, sums[size], gramian / float(n) ** 3, components)
    return models


def identity_errors(fit: DataFrame, shared) -> dict[int, float | None]:
    """By length, how far the covariance of the whitened fit list is from the identity."""
    most = max(len(m.values) for m in shared.value.values())

    def whitened(frames):
        for pdf in frames:
            for size, rows in pdf.groupby("size"):
                model = shared.value[size]
                w = model.whitened(model.centred(np.stack(rows["x"].to_list())))
                yield pd.DataFrame({"size": size, **{f"w{k}": w[:, k] if k < w.shape[1] else np.nan for k in range(most)}})

    table_ = fit.mapInPandas(whitened, "size int, " + ", ".join(f"w{k} double" for k in range(most)))
    pairs = [(i, j) for i in range(most) for j in range(i + 1)]
    found = table_.groupBy("size").agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs]).collect()
    out = {}
    for r in found:
        real = [k for k, v in enumerate(shared.value[r["size"]].values) if v]
        out[r["size"]] = max((abs(r[f"c{i}_{j}"] - (i == j)) for i, j in pairs if i in real and j in real), default=None)
    return out


def whitened_vectors(vectors: DataFrame, components: int = 4, scale: int = 256, id_col: str = "vec_id") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error), a row for each vector and component."""
    spark = vectors.sparkSession
    clip = lambda c: F.greatest(F.least(F.floor(F.greatest(F.least(c * scale, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))), F.lit(LIMIT)), F.lit(-LIMIT))
    kept = finite_vectors(vectors, id_col).where("size > 0").select("id", F.transform("e", lambda c: clip(c.cast("double"))).alias("x"), "size")
    fit = stored(kept.select("x", "size").distinct(), "distinct")
    models = fitted(fit, components)
    shared = spark.sparkContext.broadcast(models)
    errors = identity_errors(fit, shared) if models else {}

    def rows_of(frames):
        for pdf in frames:
            for size, rows in pdf.groupby("size"):
                model = shared.value[size]
                gaps, k = model.centred(np.stack(rows["x"].to_list())), len(model.values)
                yield pd.DataFrame({
                    "id": pd.array(rows["id"], "Int64").repeat(k), "component": np.tile(np.arange(1, k + 1), len(rows)), "n": model.n, "deviation": pd.array(model.deviations(gaps), "Int64").repeat(k),
                    "whitened": pd.arrays.ArrowExtensionArray(pa.array(model.whitened(gaps).ravel(), from_pandas=True)), "explained": pd.arrays.ArrowExtensionArray(pa.array(model.explained * len(rows), pa.float64())),
                    "identity_error": pd.arrays.ArrowExtensionArray(pa.array([errors[size]] * (k * len(rows)), pa.float64())),
                })

    return kept.mapInPandas(rows_of, OUT).withColumnRenamed("id", id_col)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_vectors(table(spark, sf_dir, "embeddings"))
