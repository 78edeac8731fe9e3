"""Whitening, exact duplicates and vector codes against brute force in whole numbers, with their defined cases."""

import hashlib
import math
import random
import re
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemark.llm.exact_dedup import exact_groups
from sievemark.llm.queries import QUERIES
from sievemark.llm.vector_codes import compressed, cuts, limit, nearest
from sievemark.llm.whitening import whitened_vectors

SF = "/root/testdata/sf0.001"
BAD = [None, [], [1.0, None, 0.0, 0.0], [float("nan"), 1.0, 0.0, 0.0], [float("inf"), 1.0, 0.0, 0.0]]


def vectors(spark, rows, kind="float"):
    """With columns whose names clash with the operators' own."""
    rows = [(i, None if e is None else [None if c is None else float(c) for c in e], label) for i, e, label in rows]
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").withColumns({"id": F.lit("x"), "e": F.lit(1), "size": F.lit("y"), "x": F.lit(0), "part": F.lit(0), "code": F.lit(0), "block": F.lit(0), "n": F.lit(0)})


def whole(e, scale):
    return [math.floor(scale * float(c)) for c in e]


def usable(e):
    return e is not None and all(c is not None and math.isfinite(c) for c in e)


# ---- exact duplicates --------------------------------------------------------------------------


def copies_of(rows):
    """(keep_id, group_size, sha256) by text, and how many rows of each (id, text) stay."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub("[ \t-\r]+", " ", t or "")].append(i)
    return {t: (min((i for i in ids if i is not None), default=None), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items()}


ODD_TEXTS = [None, "", " ", "\t\n", "a", "a ", " a", "a  b", "a\n\nb", "a b", "a b", "A b", "é漢\U0001f600", "x" * 300_000, "x" * 299_999 + "y", "w " * 50_000, "w\t" * 50_000]


@pytest.mark.parametrize("parts, fan_in", [(1, 16), (7, 2), (13, 3), (40, 16)])
def test_exact_groups(spark, parts, fan_in):
    rng = random.Random(parts)
    rows = [(k, rng.choice(ODD_TEXTS) if rng.random() < 0.5 else f"text {rng.randrange(40)}") for k in range(400)]
    rows += [(None, "a b"), (None, "alone without id"), (None, "alone without id"), (3, rows[3][1]), (3, rows[3][1]), (3, "other text of 3")] + [(1000 + k, "hot  copy") for k in range(300)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "digest", "place", "copies", "mark", "keep_id")}).repartition(parts)
    got = exact_groups(frame, fan_in=fan_in).collect()
    expected = copies_of(rows)
    by_sha = {sha: (keep, n) for keep, n, sha in expected.values()}
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r["doc_id"], r["text_sha256"]) for r in got), key=key) == sorted(((i, expected[re.sub("[ \t-\r]+", " ", t or "")][2]) for i, t in rows), key=key)
    assert all((r["keep_id"], r["group_size"]) == by_sha[r["text_sha256"]] for r in got)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(expected) and len({r["text_sha256"] for r in kept}) == len(expected) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_exact_groups_of_nothing(spark):
    assert exact_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_digests_are_verified(spark, monkeypatch):
    """Texts whose digests collide stay apart by their length or second hash."""
    monkeypatch.setattr("sievemark.llm.exact_dedup.F.sha2", lambda c, n: F.lit("00" * 32))
    rows = [(k, t) for k, t in enumerate(["aa", "bb", "ccc", "aa", "bb", "aa"])]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), fan_in=2).collect()}
    assert got == {0: (0, 3), 3: (0, 3), 5: (0, 3), 1: (1, 2), 4: (1, 2), 2: (2, 1)}


# ---- vector codes ------------------------------------------------------------------------------


def brute_codes(rows, entries, parts, rounds, scale):
    kept = sorted(((i is None, i or 0, [float(c) for c in e], label) for i, e, label in rows if usable(e)), key=lambda r: r[:3])
    size = len(kept[0][2])
    x = [whole(e, scale) for _, _, e, _ in kept]
    cut = cuts(size, parts)
    books = [[v[cut[p] : cut[p + 1]] for v in x[:entries]] for p in range(parts)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(book))
    for r in range(rounds + 1):
        told = [[near(v[cut[p] : cut[p + 1]], books[p]) for p in range(parts)] for v in x]
        if r == rounds:
            break
        for p in range(parts):
            for k in range(len(books[p])):
                own = [v[cut[p] : cut[p + 1]] for v, t in zip(x, told, strict=True) if t[p][1] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    errors = defaultdict(int)
    for (_, _, _, label), t in zip(kept, told, strict=True):
        errors[label] += sum(d for d, _ in t)
    return sorted((-1 if none else i, "".join(f"{k:02x}" for _, k in t), sum(d for d, _ in t), errors[label], digest) for (none, i, _, label), t in zip(kept, told, strict=True))


def codes(frame):
    return sorted((-1 if r["vec_id"] is None else r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in frame.collect())


@pytest.mark.parametrize("n, entries, kind", [(3, 256, "float"), (300, 8, "float"), (200, 256, "double"), (120, 5, "double")])
def test_vector_codes(spark, n, entries, kind):
    rng = random.Random(n)
    draw = (lambda: rng.choice([0, 0, -0.001, 0.5, 0.25, -1])) if kind == "double" else (lambda: rng.gauss(0, 1))
    rows = [(rng.randrange(n), [draw() for _ in range(8)], rng.choice([None, 1, 2])) for _ in range(n)] + [(None, [0.1] * 8, None), (5, [0.5] * 8, 1), (5, [0.5] * 8, 1), (6, [-3000.0] + [2500.0] * 7, 2)]
    if kind == "float":
        rows = [(i, np.array(e, np.float32).tolist(), label) for i, e, label in rows]
    bad = [(900 + k, None if e is None else e * 2 if e else [float("nan")] * 8, 1) for k, e in enumerate(BAD)]
    frame = vectors(spark, rows + bad, kind).repartition(5)
    got = compressed(frame, entries=entries)[0].drop("label")
    assert codes(got) == brute_codes(rows, entries, 4, 4, 1024)


def test_vector_codes_odd_lengths(spark):
    rows = [(1, [], 1), (2, [0.5] * 6, 1), (3, [1e30] * 6, None), (4, [-1e30] * 6, None), (5, [0.5], 2)]
    got = {r["vec_id"]: r for r in compressed(vectors(spark, rows, "double"))[0].collect()}
    assert set(got) == {1, 2, 3, 4, 5} and got[1]["code"] == "00000000" and all(r["error"] == 0 for r in got.values())
    assert got[2]["code"] == "00000000" and got[3]["code"] == "01010101" and (2 * limit(6)) ** 2 * 6 < 1 << 63
    assert compressed(vectors(spark, [], "double"))[0].count() == 0 and compressed(vectors(spark, [(1, None, 1)], "double"))[0].count() == 0


def test_nearest_is_the_same_in_any_width():
    rng = np.random.default_rng(1)
    small, book = rng.integers(-50, 50, (16, 600)).astype(np.int32), rng.integers(-50, 50, (256, 16))
    wide = [nearest(small * np.int32(1 << 20), book * (1 << 20)), nearest(small, book)]
    assert (wide[0][0] == wide[1][0]).all() and (wide[0][1] == wide[1][1] << 40).all()


def test_op13_on_its_table(spark):
    given = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert codes(QUERIES["op13_vector_codes"](spark, SF)) == brute_codes(given, 256, 4, 4, 1024)


# ---- whitening ---------------------------------------------------------------------------------


def check_whitened(rows, got, components=4):
    kept = [(i, whole(e, 256)) for i, e, _ in rows if usable(e) and e]
    fit = sorted({tuple(x) for _, x in kept})
    n, size = len(fit), len(fit[0])
    sums = [sum(c) for c in zip(*fit, strict=True)]
    gaps = np.array([[n * a - s for a, s in zip(x, sums, strict=True)] for x in fit], object)
    covariance = np.array([[float(Fraction(int(sum(gaps[:, i] * gaps[:, j])), n**3)) for j in range(size)] for i in range(size)])
    values, axes = np.linalg.eigh(covariance)
    k = min(components, size)
    assert sorted((r["vec_id"], r["component"]) for r in got) == sorted((i, c) for i, _ in kept for c in range(1, k + 1))
    assert {r["n"] for r in got} == {n}
    deviation = defaultdict(list)
    for i, x in kept:
        deviation[i].append(sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)))
    assert all(r["deviation"] in deviation[r["vec_id"]] for r in got)
    centred = {i: np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums, strict=True)]) for i, x in kept}
    for c in range(1, k + 1):
        own = [r for r in got if r["component"] == c]
        e, axis = values[-c], axes[:, -c]
        assert all(abs(r["explained"] - e / values.sum()) <= 1e-9 * e / values.sum() for r in own)
        expected = {i: v @ axis / math.sqrt(e) for i, v in centred.items()}
        sign = next((math.copysign(1, r["whitened"] * expected[r["vec_id"]]) for r in own if abs(expected[r["vec_id"]]) > 1e-3))
        assert all(abs(r["whitened"] - sign * expected[r["vec_id"]]) < 1e-8 for r in own if len(deviation[r["vec_id"]]) == 1)
    assert all(r["identity_error"] < 1e-9 for r in got)


def test_whitening(spark):
    rng = random.Random(4)
    rows = [(k, [rng.gauss(3, 1 + j) for j in range(6)], 1) for k in range(150)]
    rows += [(200 + k, rows[0][1], None) for k in range(100)] + [(7, rows[7][1], 1), (300, [0.0, -0.0, 1e4, -1e4, 0.0039, -0.0039], 1)]
    bad = [(900 + k, None if e is None else e, 1) for k, e in enumerate(BAD)]
    got = whitened_vectors(vectors(spark, rows + bad, "double").repartition(5)).collect()
    check_whitened(rows, got)


def test_op11_on_its_table(spark):
    given = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitened(given, QUERIES["op11_whitening"](spark, SF).collect())


def test_whitening_without_variance(spark):
    got = whitened_vectors(vectors(spark, [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)], "double")).collect()
    assert len(got) == 4 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 and r["n"] == 1 for r in got)
    line = whitened_vectors(vectors(spark, [(1, [1.0, 2.0, 0.0], 1), (2, [2.0, 4.0, 0.0], 1), (3, [0.5], 1), (None, [0.75], 1)], "double")).collect()
    told = {(r["vec_id"], r["component"]): r["whitened"] for r in line}
    assert abs(abs(told[(1, 1)]) - 1) < 1e-12 and told[(1, 2)] is None and told[(1, 3)] is None and abs(abs(told[(None, 1)]) - 1) < 1e-12
    far = whitened_vectors(vectors(spark, [(1, [1e30], 1), (2, [-1e30], 1), (3, [0.0], 1)], "double")).collect()
    assert {r["vec_id"]: r["deviation"] for r in far} == {1: None, 2: None, 3: 0}
    assert whitened_vectors(vectors(spark, [], "double")).count() == 0
