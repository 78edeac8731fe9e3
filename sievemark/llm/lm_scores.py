"""Stupid-backoff scores of every text against n-gram counts of all texts.

score(w | h) = c(h w) / c(h) if c(h w) is kept in the count table, else alpha * score(w | shorter h),
down to c(w) / N. Tables of order 2 and more keep counts of at least min_count, which is a parameter of
the method; 1 keeps all.

Documents are dealt into batches by hash, as many as their bytes need, and travel compressed; a batch
explodes into its distinct n-grams (64-bit hashes, sorted) with their counts. N-grams travel packed, all
those of a batch that belong to one count table as a row; tables are partitioned by the leading bits of
the hash, as many as the bytes need. So there is never a row more than there are distinct n-grams in the batches, and a
frequent n-gram is an entry a batch, not one a document: no key is hot.

* With min_count 2 or more, an n-gram that occurs once in all texts needs no count. Of the n-grams of
  order 2 and more, first only so many leading bits are sent that few unlike ones agree; a table
  answers with a bit for each, whether another batch has it too. (Unlike n-grams that agree in these
  bits are sent in vain, nothing else.)
* Then the whole hashes and counts of single words and of n-grams that occur again are sent. A table
  adds the batches' counts and answers each batch with the totals; the batch joins them to its exploded
  n-grams and sums the terms by document.

Defined cases: null, empty and blank texts have 0 tokens and score 0 (mean null); repeated rows and
ids are rows of their own and all count; null ids are kept; ties don't matter; an empty table gives an
empty table; further columns are not read. Hashes of 64 bits stand for n-grams: of 10 billion distinct
ones, about two to three pairs share one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, hashed_ngrams, hashed_words, stored, table, utf8

#: Bytes of text in a batch, and of n-grams sent to a count table, on average.
BATCH_BYTES, TABLE_BYTES = 6 << 20, 64 << 20
#: Fixed values of the production model.
ORDER, MIN_COUNT, ALPHA = 3, 2, 0.4
#: Bits by which unlike n-grams are told apart at first, beyond those that number them.
SPARE_BITS = 5


def squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unsqueezed(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def packed(values: np.ndarray) -> bytes:
    """Bytes of equal weight together, so that the small ones compress away."""
    return bytes([values.itemsize]) + squeezed(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    return np.ascontiguousarray(np.frombuffer(unsqueezed(data[1:]), np.uint8).reshape(width, -1).T).view(f"u{width}").ravel()


def bundles(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(batch, bundle) of rows (id, text, batch): the rows of each batch number in one compressed value."""
    batch = batch.take(pc.sort_indices(batch.column(2)))
    number = batch.column(2).to_numpy()
    ids, valid = pc.fill_null(batch.column(0), 0).to_numpy(), batch.column(0).is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)
    data, offsets = utf8(batch.column(1))
    starts = np.flatnonzero(np.diff(number, prepend=-1)) if len(number) else np.zeros(0, np.int64)
    out = []
    for i, j in zip(starts, np.append(starts[1:], len(number)), strict=True):
        sizes = np.diff(offsets[i : j + 1])
        out.append(squeezed(np.int64(j - i).tobytes() + ids[i:j].tobytes() + valid[i:j].tobytes() + sizes.tobytes() + data[offsets[i] : offsets[j]].tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(number[starts], pa.int32()), pa.array(out, pa.binary())], ["batch", "bundle"])


class Bundle:
    """The rows of a batch: ids, the bytes of the texts, and where each begins."""

    def __init__(self, column):
        ids, valid, sizes, data = [], [], [], []
        for x in column.to_pylist():
            raw = unsqueezed(x)
            n = int.from_bytes(raw[:8], "little")
            ids.append(np.frombuffer(raw, np.int64, n, 8))
            valid.append(np.frombuffer(raw, np.uint8, n, 8 + 8 * n))
            sizes.append(np.frombuffer(raw, np.uint8, 8 * n, 8 + 9 * n).view(np.int64) if n else np.zeros(0, np.int64))
            data.append(np.frombuffer(raw, np.uint8, offset=8 + 17 * n))
        self.ids = pa.array(np.concatenate(ids), mask=np.concatenate(valid) == 0)
        self.data = np.concatenate(data)
        self.offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


class Grams:
    """The n-grams of a batch: distinct keys in order and counts; with places, where each occurrence's key is. The lowest bit of a key tells words from longer n-grams."""

    def __init__(self, rows: Bundle, order: int, places: bool = False):
        words, first, base = [], [np.zeros(1, np.int64)], 0
        for i, j in chunks(rows.offsets):
            w, f = hashed_words(rows.data[rows.offsets[i] : rows.offsets[j]], rows.offsets[i : j + 1] - rows.offsets[i], fold=False)
            words.append(w)
            first.append(f[1:] + base)
            base += len(w)
        words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.first = np.concatenate(first)
        self.doc = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        self.place = np.arange(len(words)) - self.first[self.doc]
        #: for each order, the words at which its n-grams end
        self.ends = [np.flatnonzero(self.place >= n - 1) for n in range(1, order + 1)]
        hashes = [(hashed_ngrams(words, n)[e - n + 1] if len(words) >= n else np.zeros(0, np.uint64)) & ~np.uint64(1) | np.uint64(n == 1) for n, e in enumerate(self.ends, 1)]
        if places:
            self.keys, inverse, self.counts = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
            self.inverse = np.split(inverse, np.cumsum([len(h) for h in hashes])[:-1])
        else:
            self.keys, self.counts = np.unique(np.concatenate(hashes), return_counts=True)
        self.single = (self.keys & np.uint64(1)).astype(bool)


def _cuts(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each table's keys begin in sorted keys."""
    starts = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(1, np.uint64)
    return np.concatenate([np.searchsorted(keys, starts), [len(keys)]])


def term_sums(grams: Grams, totals: np.ndarray, order: int, min_count: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """For each document, the sum of log scores without -log N, and how many terms need it."""
    words = len(grams.doc)
    count = np.zeros((order + 1, words))
    for n in range(1, order + 1):
        count[n, grams.ends[n - 1]] = totals[grams.inverse[n - 1]]
    level = np.ones(words, np.int64)
    for n in range(2, order + 1):
        level[(count[n] >= min_count)] = n
    most = np.minimum(grams.place + 1, order)
    at = np.arange(words)
    top = count[level, at]
    below = np.where(level > 1, count[level - 1, np.maximum(at - 1, 0)], 1.0)
    terms = np.log(np.maximum(top, 1)) - np.log(np.maximum(below, 1)) + (most - level) * math.log(alpha)
    docs = len(grams.first) - 1
    return np.bincount(grams.doc, terms, docs), np.bincount(grams.doc, level == 1, docs)


def _deltas(keys: np.ndarray) -> np.ndarray:
    return np.concatenate([keys[:1], np.diff(keys)])


def _narrow(values: np.ndarray) -> np.ndarray:
    """In the narrowest unsigned type that holds them."""
    most = int(values.max(initial=0))
    return values.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def _bits(answers) -> np.ndarray:
    """The bits of (table, count, bits) in the order of the tables."""
    return np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for _, n, x in sorted(answers)]) if answers else np.zeros(0, np.uint8)


ASKED = "batch int, table int, n long, width int, keys binary, counts binary"
ANSWER = "batch int, table int, n long, again binary, totals binary"


def lm_scores(docs: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT, alpha: float = ALPHA, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """(id, n_tokens, log_score, mean_log_score) of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 1
    batches = max(1, -(-size // batch_bytes))
    bits = max(0, math.ceil(math.log2(max(1, size * order / table_bytes))))
    short = min(64, max(bits + 1, 8, math.ceil(math.log2(size * order)) + SPARE_BITS))
    dealt = rows.withColumn("batch", F.pmod(F.xxhash64("id", "text"), F.lit(batches)).cast("int")).mapInArrow(lambda parts: map(bundles, parts), "batch int, bundle binary")

    def sent(batch: int, keys: np.ndarray, counts: np.ndarray, width: int) -> pa.Table:
        """A row for each table with some of the keys, which are of width bits."""
        cuts = _cuts(keys << np.uint64(64 - width), bits)
        full = np.flatnonzero(np.diff(cuts))
        keys = keys & np.uint64((1 << (width - bits)) - 1)  # the table has the other bits
        parts = [(_narrow(_deltas(keys[cuts[t] : cuts[t + 1]])), _narrow(counts[cuts[t] : cuts[t + 1]].astype(np.uint64))) for t in full]
        told = [pa.array([packed(x) for x in side], pa.binary()) for side in (zip(*parts, strict=True) if parts else ([], []))]
        n = pa.array([len(k) for k, _ in parts], pa.int64())
        return pa.table([pa.array(np.full(len(full), batch), pa.int32()), pa.array(full, pa.int32()), n, pa.array(np.full(len(full), width), pa.int32()), *told], names=["batch", "table", "n", "width", "keys", "counts"])

    def read(column) -> list[np.ndarray]:
        return [unpacked(x).astype(np.uint64) for x in column.to_pylist()]

    def first_ask(key, part):
        grams = Grams(Bundle(part.column("bundle")), order)
        longer = grams.keys[~grams.single] >> np.uint64(64 - short)
        own, at = np.unique(longer, return_inverse=True)
        return sent(key[0].as_py(), own, np.minimum(np.bincount(at, grams.counts[~grams.single], len(own)), 2), short)

    def seen_again(key, part):
        keys = [np.cumsum(k, dtype=np.uint64) for k in read(part.column("keys"))]
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        again = (np.bincount(at, np.concatenate(read(part.column("counts")))) >= 2)[at]
        told = [np.packbits(x).tobytes() for x in np.split(again, np.cumsum([len(k) for k in keys])[:-1])]
        return pa.table([part.column("batch"), part.column("table"), part.column("n"), pa.array(told, pa.binary()), pa.nulls(len(told), pa.binary())], names=["batch", "table", "n", "again", "totals"])

    def wanted(grams: Grams, again: np.ndarray) -> np.ndarray:
        """Which n-grams of the batch are counted: words, and what occurs again."""
        if min_count < 2:
            return np.ones(len(grams.keys), bool)
        out = grams.single.copy()
        longer = grams.keys[~grams.single] >> np.uint64(64 - short)
        first = np.concatenate([[True], longer[1:] != longer[:-1]]) if len(longer) else np.zeros(0, bool)
        out[~grams.single] = again[np.cumsum(first) - 1].astype(bool)
        return out

    def ask(key, texts, answers):
        grams = Grams(Bundle(texts.column("bundle")), order)
        kept = wanted(grams, _bits([(r["table"], r["n"], r["again"]) for r in answers.to_pylist()]))
        return sent(key[0].as_py(), grams.keys[kept], grams.counts[kept], 64)

    def ask_all(key, texts):
        grams = Grams(Bundle(texts.column("bundle")), order)
        return sent(key[0].as_py(), grams.keys, grams.counts, 64)

    def total(key, part):
        keys = [np.cumsum(k, dtype=np.uint64) for k in read(part.column("keys"))]
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.zeros(int(at.max()) + 1, np.uint64)
        np.add.at(sums, at, np.concatenate(read(part.column("counts"))))
        told = [packed(_narrow(own)) for own in np.split(sums[at], np.cumsum([len(k) for k in keys])[:-1])]
        return pa.table([part.column("batch"), part.column("table"), part.column("n"), pa.nulls(len(told), pa.binary()), pa.array(told, pa.binary())], names=["batch", "table", "n", "again", "totals"])

    def score(key, texts, answers):
        rows = Bundle(texts.column("bundle"))
        grams = Grams(rows, order, places=True)
        told = answers.to_pylist()
        kept = wanted(grams, _bits([(r["table"], r["n"], r["again"]) for r in told if r["again"] is not None]))
        totals = np.zeros(len(grams.keys))
        got = sorted((r["table"], r["totals"]) for r in told if r["totals"] is not None)
        totals[kept] = np.concatenate([unpacked(x).astype(np.float64) for _, x in got]) if got else 0.0
        sums, bare = term_sums(grams, totals, order, min_count, alpha)
        return pa.table([rows.ids, pa.array(np.diff(grams.first), pa.int64()), pa.array(sums.astype(np.float64)), pa.array(bare.astype(np.int64))], names=["id", "n_tokens", "partial", "bare"])

    by_batch = dealt.groupBy("batch")
    again = None
    if min_count < 2:
        asked = by_batch.applyInArrow(ask_all, ASKED)
    else:
        again = by_batch.applyInArrow(first_ask, ASKED).groupBy("table").applyInArrow(seen_again, ANSWER)
        asked = by_batch.cogroup(again.groupBy("batch")).applyInArrow(ask, ASKED)
    answers = asked.groupBy("table").applyInArrow(total, ANSWER)
    answers = answers if again is None else answers.unionByName(again)
    found = by_batch.cogroup(answers.groupBy("batch")).applyInArrow(score, "id long, n_tokens long, partial double, bare long")
    found = stored(found, "scores", free=True)
    n = found.agg(F.sum("n_tokens")).first()[0] or 1
    log_score = F.round(F.col("partial") - F.col("bare") * math.log(n), 6)
    return found.select(F.col("id").alias(id_col), "n_tokens", log_score.alias("log_score"), F.when(F.col("n_tokens") > 0, F.round((F.col("partial") - F.col("bare") * math.log(n)) / F.col("n_tokens"), 6)).alias("mean_log_score"))


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


OP3_SQL = rf"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
t AS (SELECT r, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word FROM w),
b AS (SELECT r, word, lag(word) OVER p AS before, lag(word, 2) OVER p AS first FROM t WINDOW p AS (PARTITION BY r ORDER BY i)),
one AS (SELECT word, count(*) AS c FROM t GROUP BY word),
two AS (SELECT before, word, count(*) AS c FROM b WHERE before IS NOT NULL GROUP BY before, word),
three AS (SELECT first, before, word, count(*) AS c FROM b WHERE first IS NOT NULL GROUP BY first, before, word),
total AS (SELECT count(*) AS n FROM t),
s AS (
  SELECT b.r, CASE WHEN three.c >= {MIN_COUNT} THEN ln(three.c) - ln(h2.c)
    WHEN two.c >= {MIN_COUNT} THEN ln(two.c) - ln(h.c) + CASE WHEN b.first IS NULL THEN 0 ELSE ln({ALPHA}) END
    ELSE ln(one.c) - ln((SELECT n FROM total)) + CASE WHEN b.before IS NULL THEN 0 WHEN b.first IS NULL THEN ln({ALPHA}) ELSE 2 * ln({ALPHA}) END END AS term
  FROM b JOIN one ON one.word = b.word LEFT JOIN two ON two.before = b.before AND two.word = b.word LEFT JOIN one AS h ON h.word = b.before
    LEFT JOIN three ON three.first = b.first AND three.before = b.before AND three.word = b.word LEFT JOIN two AS h2 ON h2.before = b.first AND h2.word = b.before)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_tokens, round(coalesce(x.term, 0), 6) AS log_score, CASE WHEN len(w.words) > 0 THEN round(x.term / len(w.words), 6) END AS mean_log_score
FROM w LEFT JOIN (SELECT r, sum(term) AS term FROM s GROUP BY r) AS x ON x.r = w.r
"""
