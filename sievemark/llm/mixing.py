"""Mixing sources to target weights: iterative proportional fitting and calibrated sampling.

Token mass is summed by (source, language, topic) cell. The cell masses are raked to target marginals
of each dimension in turn until all three hold. A document of a cell is then kept with a probability
in proportion to the cell's raked mass over its own mass, at most 1, scaled so that the expected
tokens are the wanted share; the choice is a hash of the document's id, so it can be repeated.

Targets are shares by value, or an exponent that flattens the shares found (1 leaves them, 0 makes
them equal). Cells are few by nature; up to MAX_CELLS (checked by a count) they are raked on the
driver and broadcast, beyond that as a DataFrame with a join that adaptive execution may split. Both
rake by the same steps to the same tolerance and round probabilities to 9 decimals before a document is
drawn, so the decisions are the same. marginal_error is the largest difference between a share wanted
and a share reached; it is above the tolerance only where no mix of the cells has all three marginals.

Defined cases: null source or language is a value of its own; null or empty text has 0 tokens and
stays with probability of its cell; a cell without tokens has weight 1; repeated ids share a decision;
a null id is drawn as a value of its own; an empty table gives an empty table; other columns pass, and
those that bear the name of a result are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, hashed_words, stored, table, unit_hash, utf8, words_a_row

#: Words by which a text is given a topic; most hits win, ties go to the name that comes first. Words are
#: runs of ASCII letters, digits, underscores and non-ASCII bytes, with A-Z as a-z; a bar counts by itself.
TOPICS = {
    "code": "def class return import function token secret password key http https",
    "legal": "license licensed copyright warranty rights reserved permission liability apache mit",
    "table": "|",
}
OTHER = "general"
DIMENSIONS = ("source", "lang", "topic")
MAX_CELLS = 50_000
SWEEPS, TOLERANCE = 200, 1e-10
UNKNOWN = "\x00unknown"


_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), ord("_"), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = False


def topics_and_tokens(topics: dict[str, str] = TOPICS):
    """A function of a text column: (topic, tokens) of every whole text, from its bytes."""
    names = sorted(topics)

    def terms(name: str) -> tuple[np.ndarray, list[int]]:
        signs = [w for w in topics[name].split() if len(w) == 1 and _BETWEEN[ord(w)]]
        words = [w for w in topics[name].split() if w not in signs]
        return hashed_words(*utf8(pa.array(words, pa.string())), fold=True, space=_BETWEEN)[0], [ord(x) for x in signs]

    wanted = [terms(name) for name in names]
    labels = np.array([*names, OTHER], object)

    @F.arrow_udf("struct<topic:string,tokens:bigint>")
    def of(texts: pa.Array) -> pa.Array:
        data, offsets = utf8(texts)
        topic, tokens = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for i, j in chunks(offsets):
            part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            tokens[i:j] = words_a_row(part, own)
            words, first = hashed_words(part, own, fold=True, space=_BETWEEN)
            hits = np.zeros((len(names) + 1, j - i), np.int64)
            for k, (hashes, signs) in enumerate(wanted):
                for found, starts in ((np.isin(words, hashes), first), *((part == x, own) for x in signs)):
                    sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(found, dtype=np.int64)])
                    hits[k] += sums[starts[1:]] - sums[starts[:-1]]
            topic[i:j] = np.where(hits.any(axis=0), hits.argmax(axis=0), len(names))
        return pa.StructArray.from_arrays([pa.array(labels[topic], pa.string()), pa.array(tokens)], ["topic", "tokens"])

    return of


def with_cells(docs: DataFrame) -> DataFrame:
    """(_row: the input's columns, _source, _lang, _topic, _tokens)."""
    placed = docs.select(F.struct("*").alias("_row"), topics_and_tokens()(F.col("text").cast("string")).alias("_of"))
    return placed.select("_row", F.coalesce("_row.source", F.lit(UNKNOWN)).alias("_source"), F.coalesce("_row.lang", F.lit(UNKNOWN)).alias("_lang"), F.col("_of.topic").alias("_topic"), F.col("_of.tokens").alias("_tokens"))


def wanted_shares(found: dict[str, float], target) -> dict[str, float]:
    """Shares that sum to 1 over the values found."""
    if isinstance(target, dict):
        raw = {v: max(float(target.get(v, 0.0)), 0.0) if found[v] else 0.0 for v in found}
    else:
        raw = {v: x**target if x else 0.0 for v, x in found.items()}
    total = sum(raw.values())
    return {v: x / total for v, x in raw.items()} if total else {v: 0.0 for v in found}


def rake(cells: list[tuple], masses: np.ndarray, targets: dict) -> tuple[np.ndarray, float]:
    """Raked shares of the cells and the largest error of a marginal; cells: a value for each dimension."""
    w = masses / masses.sum() if masses.sum() else masses.copy()
    plan = []
    for d, name in enumerate(DIMENSIONS):
        values = sorted({c[d] for c in cells})
        at = np.array([values.index(c[d]) for c in cells]) if len(values) < 64 else np.unique([c[d] for c in cells], return_inverse=True)[1]
        found = dict(zip(values, np.bincount(at, masses, len(values)), strict=True))
        share = wanted_shares(found, targets[name])
        plan.append((at, np.array([share[v] for v in values])))
    for _ in range(SWEEPS):
        before = w.copy()
        for at, share in plan:
            now = np.bincount(at, w, len(share))
            w = w * np.divide(share, now, out=np.zeros_like(share), where=now > 0)[at]
        if np.abs(w - before).max(initial=0) < TOLERANCE:
            break
    return w, max(float(np.abs(np.bincount(at, w, len(share)) - share).max(initial=0)) for at, share in plan)


def calibrated(masses: np.ndarray, shares: np.ndarray, fraction: float) -> np.ndarray:
    """min(1, scale * weight) with the scale at which the expected mass is the fraction, if it can be reached."""
    total = masses.sum()
    weight = np.divide(shares * total, masses, out=np.ones_like(masses), where=masses > 0)
    low, high = 0.0, 1.0
    reachable = masses[weight > 0].sum()
    while (masses * np.minimum(1, high * weight)).sum() < min(fraction * total, reachable * (1 - 1e-12)) and high < 1e12:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if (masses * np.minimum(1, mid * weight)).sum() < fraction * total else (low, mid)
    return np.minimum(1, high * weight)


def _rake_frame(cells: DataFrame, targets: dict, fraction: float) -> DataFrame:
    """As rake and calibrated, without bringing the cells to the driver."""
    total = float(cells.agg(F.sum("mass")).first()[0] or 0.0) or 1.0
    now = stored(cells.withColumn("w", F.col("mass") / total), "cells")
    shares = {}
    for d in DIMENSIONS:
        found = now.groupBy(f"_{d}").agg(F.sum("mass").alias("x"))
        target = targets[d]
        raw = F.coalesce(F.element_at(F.create_map(*[F.lit(y) for kv in target.items() for y in kv]), F.col(f"_{d}")), F.lit(0.0)) if isinstance(target, dict) else F.pow("x", F.lit(float(target)))
        raw = F.when(F.col("x") > 0, raw).otherwise(0.0)
        named = found.withColumn("raw", raw)
        shares[d] = stored(named.select(f"_{d}", (F.col("raw") / (float(named.agg(F.sum("raw")).first()[0] or 0.0) or 1.0)).alias("share")), "shares")
    for _ in range(SWEEPS):
        w = now.withColumn("before", F.col("w"))
        for d in DIMENSIONS:
            sums = w.groupBy(f"_{d}").agg(F.sum("w").alias("now")).join(shares[d], f"_{d}")
            w = w.join(sums.select(f"_{d}", F.when(F.col("now") > 0, F.col("share") / F.col("now")).otherwise(0.0).alias("ratio")), f"_{d}").withColumn("w", F.col("w") * F.col("ratio")).drop("ratio")
        w = stored(w, "cells")
        moved = w.agg(F.max(F.abs(F.col("w") - F.col("before")))).first()[0] or 0.0
        now = w.drop("before")
        if moved < TOLERANCE:
            break
    weight = F.when(F.col("mass") > 0, F.col("w") * total / F.col("mass")).otherwise(1.0)
    now = stored(now.withColumn("weight", weight), "cells")
    low, high = 0.0, 1.0
    expected = lambda s: float(now.agg(F.sum(F.col("mass") * F.least(F.lit(1.0), s * F.col("weight")))).first()[0] or 0.0)
    reachable = float(now.where("weight > 0").agg(F.sum("mass")).first()[0] or 0.0)
    while expected(high) < min(fraction * total, reachable * (1 - 1e-12)) and high < 1e12:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if expected(mid) < fraction * total else (low, mid)
    errors = [now.groupBy(f"_{d}").agg(F.sum("w").alias("now")).join(shares[d], f"_{d}").agg(F.max(F.abs(F.col("now") - F.col("share")))).first()[0] or 0.0 for d in DIMENSIONS]
    cell = F.struct(F.col("weight"), F.least(F.lit(1.0), high * F.col("weight")).alias("probability"), F.lit(float(max(errors))).alias("error"))
    return now.select(*[f"_{d}" for d in DIMENSIONS], cell.alias("_cell"))


#: Exponents of the production mix.
TARGETS = {"source": 0.5, "lang": 0.7, "topic": 0.8}


def mixed(docs: DataFrame, targets: dict = TARGETS, fraction: float = 0.5, seed: int = 17, max_cells: int = MAX_CELLS) -> DataFrame:
    """The input with topic, n_tokens, cell_weight, probability, marginal_error and sampled; each text is read once."""
    return mixed_cells(stored(with_cells(docs), "placed"), targets, fraction, seed, max_cells)


def mixed_cells(placed: DataFrame, targets: dict = TARGETS, fraction: float = 0.5, seed: int = 17, max_cells: int = MAX_CELLS) -> DataFrame:
    """As mixed, from the rows of with_cells; the text is not needed any more."""
    names = [f"_{d}" for d in DIMENSIONS]
    cells = stored(placed.groupBy(*names).agg(F.sum("_tokens").cast("double").alias("mass")), "cells")
    if cells.count() <= max_cells:
        rows = sorted(tuple(r) for r in cells.select(*names, "mass").collect())  # at most max_cells
        masses = np.array([r[3] for r in rows], float)
        shares, error = rake([r[:3] for r in rows], masses, targets) if rows else (masses, 0.0)
        weight = np.divide(shares * masses.sum(), masses, out=np.ones_like(masses), where=masses > 0)
        p = calibrated(masses, shares, fraction) if rows else masses
        data = [(*r[:3], (float(w), float(q), error)) for r, w, q in zip(rows, weight, p, strict=True)]
        found = F.broadcast(placed.sparkSession.createDataFrame(data, "_source string, _lang string, _topic string, _cell struct<weight:double,probability:double,error:double>"))
    else:
        found = _rake_frame(cells, targets, fraction)
    chance = F.round("_cell.probability", 9)
    told = {"topic": F.col("_topic"), "n_tokens": F.col("_tokens"), "cell_weight": F.col("_cell.weight"), "probability": chance, "marginal_error": F.col("_cell.error"), "sampled": unit_hash(F.col("_row.doc_id"), seed=seed) < chance}
    kept = [F.col("_row")[c].alias(c) for c in placed.schema["_row"].dataType.names if c not in told]
    return placed.join(found, names).select(*kept, *[v.alias(k) for k, v in told.items()])


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    placed = with_cells(docs).withColumn("_row", F.col("_row").dropFields("text"))
    return mixed_cells(stored(placed, "placed")).select("doc_id", "source", "lang", "topic", "n_tokens", "cell_weight", "probability", "marginal_error", "sampled")
