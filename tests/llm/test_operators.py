import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from sievemark.llm import jaccard_join
from sievemark.llm.chat_format import examples, read_back
from sievemark.llm.embedding_dedup import near_duplicates
from sievemark.llm.jaccard_join import _shared_keys, jaccard_components
from sievemark.llm.lm_scores import lm_scores
from sievemark.llm.mixing import TOPICS, mixed, with_cells
from sievemark.llm.piece_sampling import Vocabulary, sampled, sampled_batch
from sievemark.llm.quality_rules import base_failed, learn_rules, statistics
from sievemark.llm.queries import QUERIES
from sievemark.llm.token_counts import token_counts
from sievemark.llm.toxicity import Model, fit, swaps
from sievemark.llm.warc import LoserTree, archived

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0d]+")
TEXTS = [None, "", "  \n\t ", "a", "one two three", "one two three", " ".join(f"w{i % 7}" for i in range(60)), "x" * 3000, "deux  mots \n\n é ü 漢字 \U0001f600 </s> ▁▁ end ", "line\nline\n\nline two"]


def near_texts(n=60, seed=3):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    out = []
    for size in (8, 30, 120, 400):
        for _ in range(n // 12):
            base = [rng.choice(words) for _ in range(size)]
            out.append(base)
            for edits in (1, max(1, size // 60), max(1, size // 25)):
                copy = list(base)
                for _ in range(edits):
                    copy[rng.randrange(size)] = rng.choice(words)
                out.append(copy)
    return [" ".join(x) for x in out]


def docs(spark, texts):
    """With columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", "s", 1, "y") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, size int, key string")


def empty(spark):
    return docs(spark, ["x"]).where("false")


def brute_components(sets, ok):
    top = list(range(len(sets)))
    find = lambda x: x if top[x] == x else find(top[x])
    for i in range(len(sets)):
        for j in range(i):
            if ok(sets[i], sets[j]) and find(i) != find(j):
                top[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(sets))]


def word_set(text, n):
    w = WORD.findall((text or "").lower())
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def linked(percent):
    return lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= percent * len(a | b)


@pytest.mark.parametrize("block", [4, 1024])
def test_jaccard_join(spark, block):
    """Blocks of 4 make the pairs of different blocks run."""
    texts = [*TEXTS, *near_texts(), *borderline_texts()]
    for n, percent in ((4, 85), (5, 80)):
        sets = [word_set(t, n) for t in texts]
        expected = brute_components(sets, linked(percent))
        got = {r["doc_id"]: r for r in jaccard_components(docs(spark, texts), n, percent, block=block).collect()}
        assert [got[i]["component_id"] for i in range(len(texts))] == expected
        assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    assert jaccard_components(empty(spark)).count() == 0


def borderline_texts(seed=11):
    """Groups around the threshold that share a passage: some link through a chain only, most miss."""
    rng = random.Random(seed)
    words = [f"v{k}" for k in range(3000)]
    passage = [rng.choice(words) for _ in range(40)]
    out = []
    for size in (60, 150):
        base = [rng.choice(words) for _ in range(size)]
        for edits in (1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 7, 8):
            copy = list(base)
            for _ in range(max(1, edits * size // 100)):
                copy[rng.randrange(size)] = rng.choice(words)
            out.append(copy)
        out += [[*passage, *[rng.choice(words) for _ in range(size)]] for _ in range(8)]
    return [" ".join(x) for x in out]


def test_jaccard_join_of_repeated_and_missing_ids(spark):
    """Rows that repeat an id with other texts are rows of their own."""
    one, two = (" ".join(f"{c}{k}" for k in range(50)) for c in "ab")
    rows = [(5, one), (5, two), (5, two), (7, one + " end"), (3, two), (None, one), (None, None), (2, "  ")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in jaccard_components(frame, 4, 85).collect())
    assert got == [(-1, 0, -1), (-1, 47, -1), (2, 0, 2), (3, 47, 3), (5, 47, 3), (5, 47, 3), (5, 47, 5), (7, 48, 5)]


def test_jaccard_join_sends_each_text_of_an_id_once(spark, monkeypatch):
    """Rows that repeat an id grow by rows, not by their square."""
    sent = []
    keys = jaccard_join.segment_keys
    monkeypatch.setattr(jaccard_join, "segment_keys", lambda texts, n, percent: (sent.append(texts.count()), keys(texts, n, percent))[1])
    frame = spark.createDataFrame([(7, " ".join(f"w{j}x{k}" for j in range(12))) for k in range(120)], "doc_id long, text string")
    got = jaccard_components(frame, 4, 85).collect()
    assert sent == [120] and len(got) == 120 and {r["n_shingles"] for r in got} == {9}


def test_jaccard_join_of_a_very_long_text(spark):
    long = " ".join(f"x{k}" for k in range(60_000))
    got = jaccard_components(docs(spark, [long, "x0 " + long, long + " y", "short one"]), 5, 80).orderBy("doc_id").collect()
    assert [r["component_id"] for r in got] == [0, 0, 0, 3]


def test_shared_keys_of_groups_over_several_batches():
    for keys in ([7] * 12, [1, 2, 2, 3] + [7] * 12 + [8, 9, 9], [1, 2, 3, 4, 5], [1, 1, 2, 3, 3, 3, 3, 4], [5]):
        rows = list(zip(keys, range(len(keys)), strict=True))
        for size in (1, 2, 3, 5, 100):
            batches = [pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.int64()), pa.array([i for _, i in part], pa.int64())], ["key", "node"]) for part in ([], *(rows[at : at + size] for at in range(0, len(rows), size)))]
            got = [(r["key"], r["node"]) for batch in _shared_keys(iter(batches)) for r in batch.to_pylist()]
            assert got == [(k, i) for k, i in rows if keys.count(k) > 1], (keys, size)


def test_jaccard_join_of_a_key_over_several_batches(spark):
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join([*base, f"end{k}"]) for k in range(40)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        got = jaccard_components(docs(spark, texts), 4, 85).select("component_id").distinct().collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [r[0] for r in got] == [0]


def test_quality_statistics(spark):
    for r in statistics(docs(spark, TEXTS).drop("size", "key")).collect():
        t = r["text"] or ""
        w = WORD.findall(t)
        places = {}
        for i in range(len(w) - 7):
            places.setdefault(tuple(w[i : i + 8]), []).append(i)
        covered = {k for v in places.values() if len(v) > 1 for i in v for k in range(i, i + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(covered))


def test_quality_rules_find_a_planted_threshold(spark):
    rows = spark.range(600).select(F.concat(F.array_join(F.transform(F.sequence(F.lit(1), (30 + F.col("id") % 97).cast("int")), lambda x: F.concat(F.lit("w"), x)), " "), F.lit(" "), F.repeat(F.lit("#"), F.when(F.col("id") % 2 == 0, F.col("id") % 4).otherwise(25 + F.col("id") % 16).cast("int"))).alias("text"))
    stats = statistics(rows).where(~base_failed())
    rules = learn_rules(stats, F.col("n_symbols") >= 25)
    reject = F.lit(False)
    for rule in rules:
        reject = reject | rule.expression()
    assert rules and stats.where(reject != (F.col("n_symbols") >= 25)).count() <= 12
    assert learn_rules(stats.where("false"), F.lit(True)) == []


def test_mixing_meets_its_marginals(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a "), (F.col("id") % 13 + 1).cast("int")).alias("text"), F.when(F.col("id") % 3 > 0, "en").alias("lang"), F.concat(F.lit("s"), F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 5)).alias("source"))
    out = mixed(rows, {"source": 0.0, "lang": {"en": 0.5, "\x00unknown": 0.5}, "topic": 1.0}, fraction=0.3)
    total = out.agg(F.sum("n_tokens")).first()[0]
    weights = [r["w"] for r in out.groupBy("source").agg((F.sum(F.col("n_tokens") * F.col("cell_weight")) / total).alias("w")).collect()]
    assert np.allclose(weights, 1 / len(weights), atol=1e-6)
    assert abs(out.agg(F.sum(F.col("n_tokens") * F.col("probability"))).first()[0] / total - 0.3) < 1e-6
    spread = mixed(rows, {"source": 0.0, "lang": {"en": 0.5, "\x00unknown": 0.5}, "topic": 1.0}, fraction=0.3, max_cells=0)
    pairs = out.select("doc_id", "probability").join(spread.select("doc_id", F.col("probability").alias("q")), "doc_id")
    assert pairs.where("abs(probability - q) > 1e-6").count() == 0
    assert mixed(empty(spark)).count() == 0


def test_mixing_topics_and_tokens_of_whole_texts(spark):
    texts = [*TEXTS, "The LICENSE, (mit) file", "licensed_x", "a|b || c return", "clé import\nimport", "x" * (1 << 20) + " rights reserved"]
    terms = {name: words.split() for name, words in sorted(TOPICS.items())}
    for row, text in zip(sorted(with_cells(docs(spark, texts).withColumns({"source": F.lit(None), "lang": F.lit(None)})).select("_row.doc_id", "_topic", "_tokens").collect()), texts, strict=True):
        words = re.findall(r"[0-9a-z_\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        hits = {name: sum(words.count(t) + (t == "|") * (text or "").count("|") for t in own) for name, own in terms.items()}
        best = max(sorted(hits), key=lambda k: hits[k])
        assert (row["_tokens"], row["_topic"]) == (len(WORD.findall(text or "")), best if hits[best] else "general"), text[:50]


@pytest.mark.parametrize("order, least, sizes", [(3, 2, (1 << 20, 1 << 20)), (3, 2, (40, 40)), (4, 2, (100, 64)), (2, 1, (40, 40)), (3, 3, (40, 64))])
def test_lm_scores_backs_off(spark, order, least, sizes):
    """Small batches and tables, so that n-grams meet across both."""
    texts = ["a b a b", "a b c", "c a", None, " ", "a b a b c a b", "one two three", "w " * 3000, *near_texts(12)]
    got = {r["doc_id"]: r for r in lm_scores(docs(spark, texts), order=order, min_count=least, batch_bytes=sizes[0] * 20, table_bytes=sizes[1] * 100).collect()}
    check_scores(got, texts, order, least)
    assert lm_scores(empty(spark)).count() == 0


def check_scores(got, texts, order, least):
    words = [WORD.findall(t or "") for t in texts]
    count = Counter(tuple(w[i : i + n]) for w in words for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum(map(len, words))
    for i, w in enumerate(words):
        s = 0.0
        for k in range(len(w)):
            most = min(order, k + 1)
            n = next((n for n in range(most, 1, -1) if count[tuple(w[k - n + 1 : k + 1])] >= least), 1)
            gram = tuple(w[k - n + 1 : k + 1])
            s += np.log(count[gram]) - np.log(count[gram[:-1]] if n > 1 else total) + (most - n) * np.log(0.4)
        assert got[i]["n_tokens"] == len(w) and abs(got[i]["log_score"] - s) < 1e-5
        assert abs(got[i]["mean_log_score"] - s / len(w)) < 1e-5 if w else got[i]["mean_log_score"] is None


def test_lm_scores_of_repeated_and_missing_ids(spark):
    rows = [(1, "a b c"), (1, "a b c"), (None, "a b d"), (None, None), (1, "x a b")]
    got = lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got) == [(0, 0), (0, 3), (1, 3), (1, 3), (1, 3)]
    assert len({r["log_score"] for r in got if r["doc_id"] == 1}) == 2


def test_lm_query_tells_trigrams_apart(spark, tmp_path):
    texts = ["x a b", "a b c", "x a b", "a b c", "a b d", "y a b d", "y a b d", "x a b c", "z b c", "z b c", None, ""]
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    check_scores({r["doc_id"]: r for r in QUERIES["op3_lm_scores"](spark, str(tmp_path)).collect()}, texts, 3, 2)


def test_loser_tree():
    rng = random.Random(1)
    for k in (1, 2, 3, 5, 8, 13):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(20))) for _ in range(k)]
        assert list(LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)
    assert list(LoserTree([], lambda x: x)) == []


def test_warc(spark):
    rows = [(3, "http://b.com/", "x WARC/1.1\r\n\r\nContent-Length: 3"), (1, "http://www.a.com/q", "é\r\n\r\n"), (2, None, None), (9, "u\r\nv", ""), (7, "http://b.com/", "é\r\n\r\n"), (None, "n", "only")]
    got = {r["page_id"]: r for r in archived(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {k: (r["record_type"], r["refers_to"], r["payload_bytes"]) for k, r in got.items()} == {3: ("response", None, 31), 1: ("response", None, 6), 2: ("response", None, 0), 9: ("revisit", 2, 0), 7: ("revisit", 1, 6), None: ("response", None, 4)}
    assert archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_chat_format(spark):
    rows = [(1, 0, "user", "</s>[INST] &lt; ok [/INST]"), (1, 1, "assistant", None), (1, 1, "assistant", "a[&b"), (1, 2, None, "tail"), (2, 0, "assistant", "hi")]
    out = examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    import hashlib

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = {r["conv_id"]: r for r in read_back(out).collect()}
    told = "user\n</s>[INST] &lt; ok [/INST]\nassistant\n\nassistant\na[&b\n\ntail\n"
    assert (got[1]["n_turns"], got[1]["turns_sha256"], got[1]["loss_sha256"], got[1]["loss_chars"]) == (4, sha(told), sha("a[&b"), 4)
    assert out.where("conv_id = 1").count() == 3 and got[2]["loss_sha256"] == sha("hi")


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(150, 16))
    x = np.concatenate([base, base[:60] + rng.normal(size=(60, 16)) * 0.12, base[:10]])
    label = [int(i) % 3 for i in [*range(150), *range(60), *range(10)]]
    rows = [(i, v.tolist(), k) for i, (v, k) in enumerate(zip(x, label, strict=True))] + [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, x[0].tolist(), None), (904, [1.0], 0)]
    got = {r["vec_id"]: r for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), rows_a_cell=15).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (u @ u.T >= 0.98) & (np.array(label)[:, None] == np.array(label)[None]) & ~np.eye(len(x), dtype=bool)
    expected = brute_components(list(range(len(x))), lambda a, b: linked[a, b])
    assert linked.any() and [got[i]["n_links"] for i in range(len(x))] == linked.sum(axis=1).tolist()
    assert [got[i]["component_id"] for i in range(len(x))] == expected
    assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True) for i in range(900, 905))


def test_embeddings_of_any_magnitude(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(12, 5))
    scales = [1e-308, 1e-300, 1e-160, 1.0, 1e150, 1e300]
    rows = [(10 * k + j, (v * s).tolist(), 1) for k, v in enumerate(base) for j, s in enumerate(scales)] + [(900, [5e-324, 0.0, 0.0, 0.0, 0.0], 1), (901, [1e308, 0.0, 0.0, 0.0, 0.0], 1)]
    u = base / np.linalg.norm(base, axis=1, keepdims=True)
    assert (u @ u.T >= 0.98).sum() == 12
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), rows_a_cell=10).collect()}
    assert got == {i: (5, i // 10 * 10) for i, _, _ in rows[:-2]} | {900: (1, 900), 901: (1, 900)}


def test_toxicity_swaps_are_penalised():
    picked = ["=scum", "=women", "=men"]
    rows = [({"=scum"}, [], 1)] * 20 + [({"=women"}, ["the women met"], 1)] * 12 + [({"=women"}, ["the women met"], 0)] * 4 + [({"=men"}, ["the men met"], 0)] * 8 + [(set(), [], 0)] * 60
    rows = [(*r, k * 7919) for k, r in enumerate(rows)]
    free, bound = fit(rows, picked, counterfactual=0.0), fit(rows, picked, counterfactual=20.0)
    gap = lambda m: abs(m.weights["=women"] - m.weights["=men"])
    assert gap(bound) < 0.3 * gap(free) and bound.score("you scum") > 0.7 > bound.score("the women met") and swaps(["the women met"])
    assert bound.pairs > 0 and 0 <= Model().score("") <= 1 and fit([], [], 1).score("x") < 0.5


def test_token_counts(spark):
    rng = random.Random(2)
    texts = [*TEXTS, *["".join(rng.choice("ab .\n\té漢▁<s>[]") for _ in range(rng.randrange(60))) for _ in range(200)]]
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r["doc_id"]: r for r in token_counts(docs(spark, texts), MODEL).collect()}
    assert [got[i]["n_tokens"] for i in range(len(texts))] == [len(model.encode(t or "")) for t in texts]
    assert token_counts(empty(spark), MODEL).count() == 0


def test_piece_sampling(spark):
    out = sampled(docs(spark, TEXTS), MODEL, k=3).collect()
    assert all(r["round_trip"] and 0 <= r["inclusion"] <= 1 for r in out) and {r["doc_id"] for r in out} == set(range(len(TEXTS)))
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
    assert all(len({tuple(r["ids"]) for r in v}) == len(v) and [r["perturbed"] for r in v] == sorted((r["perturbed"] for r in v), reverse=True) for v in by.values())
    assert sampled(empty(spark), MODEL).count() == 0


def test_piece_sampling_draws_without_replacement():
    vocabulary = Vocabulary(MODEL)
    n = 4000
    seeds = np.random.default_rng(1).integers(0, 1 << 63, n).astype(np.uint64)
    found = sampled_batch(["then"] * n, seeds, 2, vocabulary, 0.5)
    first, second, p = Counter(), Counter(), {}
    for own in found:
        for at, (ids, logp, _, _) in zip((first, second), own, strict=False):
            at[tuple(ids)] += 1
            p[tuple(ids)] = np.exp(logp)
    top = max(p, key=p.get)
    assert abs(first[top] / n - p[top]) < 0.03
    expected = sum(q * p[top] / (1 - q) for k, q in p.items() if k != top)
    assert abs(second[top] / n - expected) < 0.03
    assert sum(p.values()) == pytest.approx(1.0, abs=0.02)
