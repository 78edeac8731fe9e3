"""Defined cases and whole results against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import base64
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from sievemark.llm.chat_format import examples, read_back
from sievemark.llm.embedding_dedup import near_duplicates
from sievemark.llm.mixing import TOPICS, mixed
from sievemark.llm.piece_sampling import SPACE, Vocabulary, sampled, sampled_batch
from sievemark.llm.quality_rules import judged, learned_rules
from sievemark.llm.token_counts import token_counts
from sievemark.llm.toxicity import IDENTITY_FEATURES, learnt, scored
from sievemark.llm.warc import archived, url_key

from .test_operators import WORD, brute_components, linked, word_set

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " \t\n", "x" * 50_000, "a b " * 20_000, "same text here", "same text here", "é漢\U0001f600 </s>"]


def frame(spark, rows, schema, **clashing):
    out = spark.createDataFrame(rows, schema)
    return out.withColumns({k: F.lit(v) for k, v in clashing.items()})


# ---- SentencePiece sampling ------------------------------------------------------------------


def segmentations(text: str, vocabulary: Vocabulary, alpha: float):
    """All segmentations of a text with their exact chances, by recursion over what the vocabulary holds."""
    marked = SPACE + text.replace(" ", SPACE)
    index = {p: i for i, p in enumerate(vocabulary.pieces) if i not in vocabulary.byte_of and vocabulary.scores[i] > -1e8}

    def paths(at: int):
        if at == len(marked):
            yield (), 0.0
            return
        for end in range(at + 1, len(marked) + 1):
            if SPACE in marked[at + 1 : end].lstrip(SPACE) or (marked[end - 1] == SPACE and set(marked[at:end]) != {SPACE}):
                break
            if marked[at:end] in index:
                i = index[marked[at:end]]
                for rest, score in paths(end):
                    yield (i, *rest), alpha * vocabulary.scores[i] + score

    found = dict(paths(0))
    total = math.log(sum(map(math.exp, found.values())))
    return {ids: score - total for ids, score in found.items()}


@pytest.mark.parametrize("text", ["the", "then a", "ab  ab", "on"])
def test_all_segmentations_of_a_small_lattice(text):
    vocabulary = Vocabulary(MODEL)
    exact = segmentations(text, vocabulary, 0.7)
    (found,) = sampled_batch([text], np.array([12345], np.uint64), len(exact) + 5, vocabulary, 0.7)
    assert {tuple(ids.tolist()) for ids, *_ in found} == set(exact) and len(found) == len(exact)
    assert all(abs(logp - exact[tuple(ids.tolist())]) < 1e-9 for ids, logp, *_ in found)
    values = [value for _, _, value, _ in found]
    assert values == sorted(values, reverse=True) and all(inclusion == 1.0 for *_, inclusion in found)


def test_inclusion_scores_weigh_samples_right():
    """Chances over inclusion scores sum to 1 on average, as for any sample without replacement."""
    vocabulary, n = Vocabulary(MODEL), 3000
    assert len(segmentations("then", vocabulary, 0.5)) > 4
    found = sampled_batch(["then"] * n, np.random.default_rng(3).integers(0, 1 << 63, n).astype(np.uint64), 3, vocabulary, 0.5)
    assert abs(np.mean([sum(math.exp(logp) / inclusion for _, logp, _, inclusion in own) for own in found]) - 1) < 0.05


def test_sampling_of_odd_rows(spark):
    rows = [*enumerate(ODD), (None, "null key"), (77, "a\x00b"), (77, "a\x00b")]
    out = sampled(frame(spark, rows, "doc_id long, text string", ids="x", sample=1, size=2, seed="y"), MODEL).collect()
    assert all(r["round_trip"] for r in out)
    nul = [(r["sample"], r["ids"]) for r in out if r["doc_id"] == 77]
    assert len(nul) == 4 and sorted(map(str, nul))[0::2] == sorted(map(str, nul))[1::2]
    assert sum(r["doc_id"] is None for r in out) >= 1


# ---- quality rules ---------------------------------------------------------------------------


def test_quality_of_odd_rows(spark):
    rng = random.Random(4)
    texts = [*ODD, *(" ".join(rng.choice(["w#", "v", "u$", "tt", "ss!"]) for _ in range(rng.randrange(15, 60))) for _ in range(40)), "one two three four five six seven eight " * 6]
    docs = frame(spark, list(enumerate(texts)), "doc_id long, text string", n_words="clash", kept="x", rule=5, words="w")
    labels = spark.createDataFrame([(k, None if k % 3 else k % 2) for k in range(len(texts))] + [(None, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in judged(docs, learned_rules(docs, labels)).collect()}
    for k, text in enumerate(texts):
        w = WORD.findall(text or "")
        places: dict = {}
        for i in range(len(w) - 7):
            places.setdefault(tuple(w[i : i + 8]), []).append(i)
        repeated = len({j for v in places.values() if len(v) > 1 for i in v for j in range(i, i + 8)})
        failed = len(w) < 20 or 100 * repeated > 30 * len(w)
        assert (got[k]["n_words"], got[k]["n_symbols"], got[k]["n_repeat_words"], got[k]["base_failed"]) == (len(w), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, failed)
        assert not (failed and got[k]["kept"])
    none = docs.where("false")
    assert judged(none, learned_rules(none, labels)).count() == 0 and learned_rules(docs, labels.where("false")) == []


# ---- mixing ----------------------------------------------------------------------------------


def test_mixing_reaches_every_marginal_and_decides_alike(spark):
    words = ["code def class", "the law license", "plain words here", "a | b | c"]
    rows = [(k, words[k * 7 % 4] + " w" * (k % 5), f"s{k // 3 % 2}", ["en", "fr", None][k % 3 if k % 7 else 0]) for k in range(1200)]
    docs = frame(spark, rows, "doc_id long, text string, source string, lang string", probability=0.5, weight=1, topic="x", _source="clash")
    targets = {"source": {"s0": 0.5, "s1": 0.5}, "lang": 0.3, "topic": 0.0}
    out = mixed(docs, targets, fraction=0.4).cache()
    assert out.first()["marginal_error"] < 1e-6 and out.count() == 1200 and out.first()["weight"] == 1
    total = out.agg(F.sum("n_tokens")).first()[0]
    share = lambda c: {r[0]: r[1] / total for r in out.groupBy(c).agg(F.sum(F.col("n_tokens") * F.col("cell_weight"))).collect()}
    plain = lambda c: {r[0]: r[1] / total for r in out.groupBy(c).agg(F.sum("n_tokens")).collect()}
    assert all(abs(v - 0.5) < 1e-6 for k, v in share("source").items())
    langs = plain("lang")
    assert all(abs(v - langs[k] ** 0.3 / sum(x**0.3 for x in langs.values())) < 1e-6 for k, v in share("lang").items())
    assert all(abs(v - 1 / len(share("topic"))) < 1e-6 for v in share("topic").values()) and set(share("topic")) <= {*TOPICS, "general"}
    again = mixed(docs, targets, fraction=0.4, max_cells=0)
    assert out.select("doc_id", "sampled").exceptAll(again.select("doc_id", "sampled")).count() == 0
    drawn = out.where("sampled").agg(F.sum("n_tokens")).first()[0] / total
    assert abs(drawn - 0.4) < 0.06
    odd = mixed(frame(spark, [(None, None, None, None), (1, "", "s", "l"), (1, "", "s", "l")], "doc_id long, text string, source string, lang string")).collect()
    assert len(odd) == 3 and len({r["sampled"] for r in odd if r["doc_id"] == 1}) == 1


# ---- WARC ------------------------------------------------------------------------------------


def test_archives_over_many_ranges(spark):
    rng = random.Random(6)
    rows = [(k, f"http://{rng.choice('abc')}.org/{rng.randrange(4)}", rng.choice(["", "body one", "é" * 40, "line\r\n\r\nWARC/1.1", None])) for k in range(60)] + [(None, "http://a.org/0", "only"), (None, "http://a.org/0", "body one"), (3, "http://z.org", "twice"), (3, "http://z.org", "twice"), (70, None, "x" * 300_000)]
    got = archived(frame(spark, rows, "page_id long, url string, html string", payload="clash", first=1, captured="c"), range_rows=5).collect()
    assert len(got) == len(rows) and len({r["key_range"] for r in got}) > 3
    least: dict = {}
    for k, _, html in rows:
        least.setdefault(html or "", []).extend([] if k is None else [k])
    for r in got:
        payloads = [h or "" for k, u, h in rows if k == r["page_id"] and url_key(re.sub(r"[\x00-\x20]", "%20", u or "")) == r["url_key"]]
        mine = next(p for p in payloads if base64.b32encode(hashlib.sha1(p.encode()).digest()).decode() == r["payload_digest"])
        assert r["payload_bytes"] == len(mine.encode())
        first = min(least[mine], default=None)
        revisits = first is not None and r["page_id"] != first
        assert (r["record_type"], r["refers_to"]) == (("revisit", first) if revisits else ("response", None))
    order = [(r["url_key"], r["captured"], r["page_id"] is not None, r["page_id"] or 0) for r in sorted(got, key=lambda r: (r["key_range"], r["position"]))]
    assert order == sorted(order)


# ---- chat, embeddings, tokens ----------------------------------------------------------------


def test_chat_of_odd_rows(spark):
    rows = [(None, 0, "user", "q"), (None, 1, "assistant", "a"), (7, 2, "assistant", "tie b"), (7, 2, "assistant", "tie a"), (7, 2, "assistant", "tie a"), (8, None, None, None)]
    out = read_back(examples(frame(spark, rows, "conv_id long, turn long, role string, text string", example=1, x="y", parts="z"))).collect()
    got = {r["conv_id"]: r for r in out}
    told = "assistant\ntie a\nassistant\ntie a\nassistant\ntie b\n"
    assert got[7]["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest() and got[7]["loss_sha256"] == hashlib.sha256(b"tie atie atie b").hexdigest()
    assert got[None]["loss_chars"] == 1 and got[8]["n_turns"] == 1 and got[8]["loss_chars"] == 0
    assert read_back(examples(frame(spark, rows, "conv_id long, turn long, role string, text string").where("false"))).count() == 0


@pytest.mark.parametrize("block", [4, 2048])
def test_embeddings_over_blocks_and_cells(spark, block):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(40, 6))
    x = np.concatenate([base, base[:30] + rng.normal(size=(30, 6)) * 0.1, base[:25] + rng.normal(size=(25, 6)) * 0.2, base[:5], base[:5] * 3])
    label = [k % 2 for k in range(40)] + [k % 2 for k in range(30)] + [k % 2 for k in range(25)] + [k % 2 for k in range(5)] * 2
    rows = [(k, v.tolist(), c) for k, (v, c) in enumerate(zip(x, label, strict=True))]
    vectors = frame(spark, rows, "vec_id long, embedding array<float>, label int", size=1, copies=2, home="x", cell=3)
    got = {r["vec_id"]: r for r in near_duplicates(vectors, rows_a_cell=4, block=block).collect()}
    f = x.astype(np.float32).astype(np.float64)
    u = f / np.linalg.norm(f, axis=1, keepdims=True)
    links = (u @ u.T >= 0.98) & (np.array(label)[:, None] == np.array(label)[None]) & ~np.eye(len(x), dtype=bool)
    assert links.sum() > 40 and [got[k]["n_links"] for k in range(len(x))] == links.sum(axis=1).tolist()
    assert [got[k]["component_id"] for k in range(len(x))] == brute_components(list(range(len(x))), lambda a, b: links[a, b])
    twice = near_duplicates(spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (2, [], 1)], "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"]) for r in twice) == [(0, 0), (1, 1), (1, 1), (2, 0)]
    assert near_duplicates(vectors.where("false")).count() == 0


def test_token_counts_of_odd_rows(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = [*enumerate(ODD), (None, "null id"), (1, "again"), (1, "again")]
    got = token_counts(frame(spark, rows, "doc_id long, text string", n_tokens="clash", size=1), MODEL).collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in got) == sorted((k or -1, len(model.encode(t or ""))) for k, t in rows)


# ---- toxicity --------------------------------------------------------------------------------


def toxic_table(spark, skew=True):
    """Toxic texts that mention one group and clean ones that mention none or another."""
    rng = random.Random(9)
    calm = "garden river table window summer paper bread music street morning".split()
    rows, labels = [], []
    for k in range(240):
        bad = k % 4 == 0
        words = [rng.choice(calm) for _ in range(12)] + (["scum", "idiot"] if bad else [])
        if bad and k % 8 == 0 and skew:
            words += ["women"]
        rng.shuffle(words)
        rows.append((k, " ".join(words) + "."))
        labels.append((k, int(bad)))
    return frame(spark, rows, "doc_id long, text string", score="clash", predicted="x", own=1), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_end_to_end_leaves_neutral_mentions_alone(spark):
    docs, labels = toxic_table(spark)
    free, bound = (learnt(docs, labels, counterfactual=c) for c in (0.0, 2.0))
    neutral, plain = "the women in the garden by the river", "the paper in the garden by the river"
    moves = lambda m: abs(m.score(neutral) - m.score(plain))
    assert bound.pairs > 0 and set(IDENTITY_FEATURES) <= set(bound.weights)
    assert moves(bound) < 0.5 * moves(free) and bound.score("you scum idiot") > 0.7 > bound.score(neutral)
    swapped = [bound.score(neutral.replace("women", g)) for g in ("women", "men", "girls", "boys")]
    assert max(swapped) - min(swapped) < 0.02


def test_toxicity_of_odd_rows(spark):
    docs, labels = toxic_table(spark)
    model = learnt(docs, labels.unionByName(spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")))
    rows = [*enumerate(ODD), (None, "scum idiot"), (1, "x"), (1, "x")]
    out = scored(frame(spark, rows, "doc_id long, text string", score="clash", predicted="y"), model).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in out)
    assert len({r["score"] for r in out if r["text"] in (None, "", " \t\n")}) == 1
    assert scored(docs.where("false"), model).count() == 0 and learnt(docs.where("false"), labels).score("scum") < 0.5
    assert learnt(docs, labels.where("toxic = 1")).score("") > 0.5


# ---- the pipeline ----------------------------------------------------------------------------


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Each stage against brute force or the operator's own verdict, on its own input, with columns unchanged."""
    source = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    extra = [{**source[0], "doc_id": 900_000 + k, "text": t} for k, t in enumerate([None, "", source[3]["text"], source[3]["text"] + " end"])]
    docs = spark.createDataFrame([*source, *extra, source[5]], "doc_id long, text string, lang string, source string, n_chars long").withColumn("probability", F.lit("clash"))
    nested = F.create_map(F.lit("k"), F.array(F.create_map(F.lit(1), F.lit("v"))))
    docs = docs.withColumns({"a map": nested, "b.c": F.array(F.struct(nested.alias("m"))), "bytes": F.lit(b"\x00\xff"), "_hash": F.lit(None).cast("map<string,int>")})
    sf_dir = str(tmp_path)
    docs.write.parquet(f"{sf_dir}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{sf_dir}/labels.parquet")
    now = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, now, sf_dir)
        out.write.parquet(f"{sf_dir}/out{k}")
        out = spark.read.parquet(f"{sf_dir}/out{k}")
        before, after = [r.asDict() for r in now.collect()], [r.asDict() for r in out.collect()]
        if k + 1 < len(pipeline.STAGES):
            assert out.columns == now.columns and 0 < len(after) <= len(before)
            key = lambda r: (r["doc_id"], r["text"])
            assert not Counter(map(key, after)) - Counter(map(key, before))
        if name == "quality rules":
            assert all(len(WORD.findall(r["text"])) >= 20 for r in after)
        if name == "n-gram Jaccard join":
            texts = sorted({(r["doc_id"], r["text"]) for r in before})
            parts = brute_components([word_set(t, 5) for _, t in texts], linked(80))
            assert sorted(r["doc_id"] for r in after) == sorted(texts[p][0] for p in set(parts))
        if name.startswith("mixing"):
            assert len({r["doc_id"] for r in after}) < len({r["doc_id"] for r in before})
        if name.startswith("SentencePiece"):
            vocabulary = Vocabulary(MODEL)
            by_id = {r["doc_id"]: r["text"] for r in before}
            assert {r["doc_id"] for r in after} == set(by_id) and all(vocabulary.decode(r["ids"]) == by_id[r["doc_id"]] for r in after)
        now = out
    none = docs.where("false")
    for name, stage in pipeline.STAGES:
        assert stage(spark, none, sf_dir).count() == 0, name
    total = pipeline.run(spark, sf_dir)
    assert total.count() == now.count()
