"""Toxicity scores from a counterfactual-regularised linear classifier.

Features are the presence of words and of word beginnings (so inflected forms share evidence) in the
whole text. They are picked by their weighted log-odds against the labels, and every identity term is a
feature; a logistic regression is fitted by Newton steps.

Counterfactuals: in labelled sentences with an identity term, the term is swapped for each other term of
its group. A labelled text without one gets a mention: a term, picked by the hash of the text, is put into
one of its sentences, and so is one of its swaps; both versions are training rows of the same label, and
the three rows weigh as one. For every swap, the squared change of the score is penalised, so that the
score doesn't follow which group is mentioned; and so is the change that a planted mention makes, so that
it doesn't follow a neutral mention as such. `Model.pairs` says how many changes were penalised.

Two things are bounded: the training sample (max_rows labelled rows, picked by hash) and the number of
features (max_features, those of the largest log-odds). Scoring reads every whole text where it lies,
without a shuffle.

Defined cases: null and empty texts get the score of a text without features; null labels are not
learnt from; without labels of both kinds every score is the share of toxic labels (0 if none);
repeated rows are rows of their own; an empty table gives an empty table; further columns pass, and
those named score or predicted are replaced.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Identity terms; terms of one group can replace each other.
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys"), ("woman", "man"),
    ("muslim", "jewish", "christian", "hindu", "buddhist", "atheist"), ("muslims", "jews", "christians", "hindus"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"), ("black", "white", "asian", "latino", "arab"),
    ("immigrants", "refugees", "citizens"), ("disabled", "blind", "deaf"), ("old", "young"),
    ("femmes", "hommes"), ("musulmans", "juifs", "chrétiens"), ("immigrés", "réfugiés", "citoyens"),
    ("frauen", "männer"), ("muslime", "juden", "christen"), ("einwanderer", "flüchtlinge", "bürger"),
    ("mujeres", "hombres"), ("musulmanes", "judíos", "cristianos"), ("inmigrantes", "refugiados", "ciudadanos"),
)
LETTERS = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")
STEMS = (4, 5, 6, 7)


#: Words whose features are remembered at a time; a full memory starts anew. Longer words are not remembered.
MEMORY, MEMORY_WORD = 200_000, 40


def word_features(word: str) -> list[str]:
    """The word itself (=word) and its beginnings (begin-)."""
    return [f"={word}"] * (len(word) > 2) + [f"{word[:n]}-" for n in STEMS if len(word) >= n]


def features(text: str) -> set[str]:
    """The features of the words of a text."""
    return {f for w in set(LETTERS.findall(text.lower())) for f in word_features(w)}


@dataclass
class Model:
    bias: float = -20.0
    weights: dict[str, float] = field(default_factory=dict)
    pairs: int = 0

    def __post_init__(self):
        self._known: dict[str, tuple[str, ...]] = {}

    def weighted(self, text: str) -> set[str]:
        """The features of a text that have a weight."""
        out: set[str] = set()
        known, weights = self._known, self.weights
        for word in set(LETTERS.findall(text.lower())):
            own = known.get(word)
            if own is None:
                if len(known) >= MEMORY:
                    known.clear()
                own = tuple(f for f in word_features(word) if f in weights)
                if len(word) <= MEMORY_WORD:
                    known[word] = own
            if own:
                out.update(own)
        return out

    def score(self, text: str) -> float:
        found = self.weighted(text) if text and self.weights else ()
        total = math.fsum([self.bias, *(self.weights[f] for f in found)])
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, total))))


IDENTITY_TERMS = frozenset(t for group in IDENTITY_GROUPS for t in group)


IDENTITY_FEATURES = tuple(sorted(f"={t}" for t in IDENTITY_TERMS))


def identity_sentences(text: str) -> list[str]:
    low = text.lower()
    if IDENTITY_TERMS.isdisjoint(LETTERS.findall(low)):
        return []
    return [s for s in SENTENCE.findall(low) if not IDENTITY_TERMS.isdisjoint(LETTERS.findall(s))]


def swaps(sentences: list[str]) -> list[tuple[set[str], set[str]]]:
    """Features lost and gained by each swap of an identity term in a sentence."""
    out = []
    for sentence in sentences:
        words = set(LETTERS.findall(sentence))
        for group in IDENTITY_GROUPS:
            for old in words.intersection(group):
                for new in group:
                    if new not in words:
                        lost, gained = features(old) - features(" ".join(words - {old})), features(new) - features(sentence)
                        out.append((lost, gained))
    return out


def planted(key: int) -> tuple[str, ...]:
    """A group of identity terms in an order that the key settles; the first is planted, the second its swap."""
    group = IDENTITY_GROUPS[key % len(IDENTITY_GROUPS)]
    turn = key // len(IDENTITY_GROUPS) % len(group)
    return group[turn:] + group[:turn]


def fit(rows: list[tuple[set[str], list[str], int, int]], picked: list[str], l2: float = 0.1, counterfactual: float = 2.0, steps: int = 25) -> Model:
    """Weights of the picked features; rows: features, sentences with identity terms, label, key of the planted mention. Deterministic for a given order of rows."""
    share = float(np.mean([y for _, _, y, _ in rows])) if rows else 0.0
    if not picked or share in (0.0, 1.0):
        return Model(bias=float(np.log(share / (1 - share)) if 0 < share < 1 else (20.0 if share else -20.0)))
    names = [*picked, *(f for f in IDENTITY_FEATURES if f not in set(picked))]
    at = {f: k for k, f in enumerate(names)}
    versions, changes, pairs = [], np.zeros((len(names) + 1, len(names) + 1)), 0
    deltas: Counter = Counter()
    of = lambda found: frozenset(at[f] for f in found if f in at)
    for own, sentences, label, key in rows:
        if sentences:
            versions.append((of(own), label, 1.0))
            deltas.update((of(lost), of(gained)) for lost, gained in swaps(sentences))
            continue
        group = planted(key)
        told = [of(features(t)) for t in group]
        mine = of(own)
        versions += [(mine, label, 1 / 3), (mine | told[0], label, 1 / 3), (mine | told[1], label, 1 / 3)]
        deltas.update((told[0] - mine - other, other - mine - told[0]) for other in told[1:])
        deltas[frozenset(), told[0] - mine] += 1
    for (lost, gained), n in deltas.items():
        delta = np.zeros(len(names) + 1)
        delta[list(lost)] -= 1
        delta[list(gained)] += 1
        changes += n * np.outer(delta, delta)
        pairs += n
    penalty = np.diag([l2] * len(names) + [1e-6])
    if pairs:
        penalty += counterfactual * len(rows) / pairs * changes
    x = np.zeros((len(versions), len(names) + 1), np.float32)
    x[:, -1] = 1
    for i, (own, _, _) in enumerate(versions):
        x[i, list(own)] = 1
    labels, weight = np.array([y for _, y, _ in versions], float), np.array([v for *_, v in versions])
    w = np.zeros(len(names) + 1)
    w[-1] = np.log(share / (1 - share))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - labels)) + penalty @ w
        step = np.linalg.solve((x * (weight * p * (1 - p)).astype(np.float32)[:, None]).T @ x + penalty + 1e-6 * np.eye(len(w)), gradient)
        step *= min(1.0, 4.0 / max(np.abs(step).max(), 1e-9))
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return Model(float(w[-1]), {f: float(w[k]) for f, k in at.items()}, pairs)


def picked_features(counted: DataFrame, toxic: int, clean: int, most: int, least_rows: int = 4) -> list[str]:
    """The features with the largest weighted log-odds; counted: (feature, toxic, clean) in documents."""
    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(a / (toxic - F.col("toxic") + 0.5)) - F.log(b / (clean - F.col("clean") + 0.5))
    z = odds / F.sqrt(1 / a + 1 / b)
    kept = counted.where(F.col("toxic") + F.col("clean") >= least_rows).withColumn("z", z).where("z >= 3")
    return [r["feature"] for r in kept.orderBy(F.desc("z"), "feature").limit(most).collect()]


def learnt(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, max_features: int = 600, counterfactual: float = 2.0) -> Model:
    """The model of a sample of at most max_rows labelled rows; labels: (doc_id, toxic)."""
    known = labels.where("toxic is not null and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropDuplicates(["doc_id"])
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # max_rows bounds it

    def count(batches):
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        rows = {0: 0, 1: 0}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows[int(toxic > 0)] += 1
                seen[int(toxic > 0)].update(features(text))
        names = sorted(set(seen[0]) | set(seen[1]))
        for k in range(0, len(names), 50_000):
            part = names[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([seen[1][f] for f in part], pa.int64()), pa.array([seen[0][f] for f in part], pa.int64())], ["feature", "toxic", "clean"])
        yield pa.RecordBatch.from_arrays([pa.array([""]), pa.array([rows[1]], pa.int64()), pa.array([rows[0]], pa.int64())], ["feature", "toxic", "clean"])

    counted = texts.select("text", "toxic").mapInArrow(count, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counted = counted.persist()
    total = counted.where("feature = ''").first()
    toxic, clean = (total["toxic"] or 0, total["clean"] or 0) if total else (0, 0)
    picked = picked_features(counted.where("feature <> ''"), toxic, clean, max_features)
    counted.unpersist()

    own_of = Model(weights=dict.fromkeys([*picked, *IDENTITY_FEATURES], 0.0))

    # only the picked features and the identity terms' sentences of the bounded sample reach the driver
    def reduce(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            own = pa.array([sorted(own_of.weighted(t)) for t in texts], pa.list_(pa.string()))
            told = pa.array([identity_sentences(t) for t in texts], pa.list_(pa.string()))
            key = pa.array([zlib.crc32(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([key, own, told, batch.column(1)], ["key", "own", "told", "toxic"])

    found = texts.select("text", "toxic").mapInArrow(reduce, "key long, own array<string>, told array<string>, toxic int").collect()
    rows = sorted((r["key"], r["own"], r["told"], r["toxic"]) for r in found)
    return fit([(set(own), told, int(toxic > 0), key) for key, own, told, toxic in rows], picked, counterfactual=counterfactual)


def score_column(model: Model, text):
    """The score of a text column; only the text goes to Python."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: model.score(t or "")).astype(float)

    return score(F.coalesce(text.cast("string"), F.lit("")))


def scored(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The input with score and predicted."""
    return docs.withColumn("score", score_column(model, F.col(text_col))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 3 == 1


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = learnt(docs, labels.where(~held_out()))
    return scored(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
