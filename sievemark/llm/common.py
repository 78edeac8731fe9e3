"""Shared pieces of the corpus operators: tables, shared storage, byte-level word hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters that are not ASCII white space.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE_CLASS}]+"
#: Bytes of text that one vectorised step works on; longer documents form a step of their own.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only a local session that names none, as in tests, gets a private one."""
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sievemark-"))
    return context.getCheckpointDir().get()


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str, free: bool = False) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder; survives the loss of any executor.

    free: let Spark drop the shuffle files of the plan at once. It does so when the driver's garbage is
    collected, which for a driver with little to do may be long after.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    if free:
        spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discarded(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def finite_vectors(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, e, size, label) of the vectors without null or non-finite components."""
    kind = vectors.schema[column].dataType.simpleString()
    e = F.col(column) if kind in ("array<float>", "array<double>") else F.col(column).cast("array<double>")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("string")
    return vectors.where(F.coalesce(finite, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), e.alias("e"), F.size(e).alias("size"), label.alias("label"))


def given_back(rows: DataFrame, answers: DataFrame, part: str, keys: list[str]) -> DataFrame:
    """rows with what answers say of their keys (never null). A key that many rows share is met once for each part, then by the rows of a part only."""
    told = rows.select(part, *keys).distinct().join(answers, keys)
    return rows.join(told, [part, *keys])


def unit_hash(*cols, seed: int = 0):
    """A uniform number in [0, 1) that depends on the values only."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11) / F.lit(float(1 << 53))


# --- vectorised word hashing -------------------------------------------------------------------


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    h = h + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0xD1342543DE82EF95
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64), 77)
_FOLDED = _BYTES.copy()
_FOLDED[ord("A") : ord("Z") + 1] = _BYTES[ord("a") : ord("z") + 1]
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def words_a_row(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Words of every row."""
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    full = offsets[:-1][offsets[1:] > offsets[:-1]]
    begins[full] = inside[full]
    sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(begins, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Row ranges of at most limit bytes, or of one row."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, min(end, rows)
        row = min(end, rows)


def hashed_words(data: np.ndarray, offsets: np.ndarray, fold: bool, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word and the first word of each row (rows + 1 numbers). fold: A-Z count as a-z; space: bytes between words."""
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    inside = ~space[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], after[-1] = False, False
    before[1:], after[:-1] = inside[:-1], inside[1:]
    full = offsets[1:] > offsets[:-1]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    first, last = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    powers, inverse = _powers_to(max(len(data), CHUNK_BYTES))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_FOLDED if fold else _BYTES)[data] * powers[: len(data)], out=sums[1:])
    return mix((sums[last] - sums[first]) * inverse[first]), np.searchsorted(first, offsets)


def hashed_ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that start at each word; the last n - 1 are missing."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    h = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        h = h * np.uint64(0x9FB21C651E98DF25) + words[k : len(words) - n + 1 + k]
    return mix(h, n)
