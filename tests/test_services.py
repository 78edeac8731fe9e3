"""SQL functions, tenants, the keyed store, reload, lanes and observed counts."""

import pytest
from pyspark.sql import functions as F

from sievemark import sql
from sievemark.operators.detect import detect
from sievemark.operators.mask import case_hints, mask, unmask_stored
from sievemark.operators.process import evicted, mask_by_policy, mask_conversations
from sievemark.operators.stats import SECONDS, Counting, exposed, observed_counts, overall_quality, quality
from sievemark.plans.config import ConfigError
from sievemark.plans.registry import Policy, RegistryError
from sievemark.sources.tables import audit, gold_spans, read_corpus, sealed, unsealed
from sievemark.streaming.reload import Reloaded, lanes, masked_batches
from sievemark.streaming.requests import stats_stream
from sievemark.streaming.store import ROCKSDB, store_stream

TEXTS = [(1, "почта a.b@mail.ru и ИНН 7707083893, снова a.b@mail.ru"), (2, "карта 4111-1111-1111-1111"), (3, ""), (4, None), (1, "x y.z@w.ru"), (None, "ИНН 500100732259 и ИНН 7707083893")]
MASKS = "array<struct<type_id:string,original:string,masked:string>>"


def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string")


def test_sql_functions_are_the_operators(spark):
    """Also several values a text, equal values, empty and null texts, and a second policy beside the first."""
    policy = Policy(types=("email", "card_number", "inn"))
    sql.register(spark, policy)
    docs(spark).createOrReplaceTempView("texts")
    found = spark.sql("SELECT doc_id, e.type_id, e.start, e.`end`, e.value, e.confidence FROM texts, LATERAL pii_entities(text) AS e")
    assert sorted(map(str, found.collect())) == sorted(map(str, detect(docs(spark), policy=policy).select("doc_id", "type_id", "start", "end", "value", "confidence").collect()))
    masked = spark.sql("SELECT text, m.masked_text, m.n_entities, m.mappings, pii_unmask(m.masked_text, m.mappings) AS back, size(pii_detect(text)) AS n FROM (SELECT text, pii_mask(text) AS m FROM texts)").collect()
    expected = {r["text"]: (r["masked_text"], r["n_entities"], r["mappings"]) for r in mask(docs(spark), policy=policy).collect()}
    for r in masked:
        if r["text"] is None:
            assert r["masked_text"] is None and r["back"] is None
        else:
            assert (r["masked_text"], r["n_entities"], r["mappings"]) == expected[r["text"]] and r["back"] == r["text"] and r["n"] == r["n_entities"]
    sql.register(spark, Policy(types=("inn",), token_numbering="hash", hash_salt="chatbot-salt-2026"), prefix="hashed_")
    assert spark.sql("SELECT hashed_mask('ИНН 500100732259').masked_text").first()[0] == "ИНН <<INN_f5c0b7>>"
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    with pytest.raises(RegistryError, match="address"):
        sql.register(spark, Policy(types=("address",)))


def test_audit_counts_for_the_tenant_only(spark):
    done = spark.createDataFrame([("a", "1", "mask", "xx", 5), ("b", "1", "mask", "yyy", 7), ("b", "2", "empty", "", None), ("a", None, "mask", "z", 1)], "system_id string, payload_id string, action string, payload string, detect_ms long")
    found = spark.createDataFrame([("a", "1", "inn"), ("a", "1", "inn"), ("a", "1", "email"), ("b", "3", "inn")], "system_id string, payload_id string, type_id string")
    got = {(r["system_id"], r["payload_id"]): (r["chars"], r["detect_ms"], r["counts"], r["n_entities"]) for r in audit(done, found, ("detect_ms",)).collect()}
    assert got == {("a", "1"): (2, 5, {"inn": 2, "email": 1}, 3), ("b", "1"): (3, 7, None, 0), ("b", "2"): (0, None, None, 0), ("a", None): (1, 1, None, 0)}


def test_many_policies_are_one_scan(spark):
    """Each row as `mask` does it under its system's policy, in one branch for all policies of patterns."""
    text = "почта a.b@mail.ru, ИНН 7707083893, карта 4111-1111-1111-1111, снова a.b@mail.ru, тел. +7 (912) 345-67-89"
    policies = {
        "plain": Policy("plain", types=("email", "inn")), "hash": Policy("hash", types=("inn",), token_numbering="hash", hash_salt="s"), "stars": Policy("stars", types=("email", "card_number"), mask_mode="stars"),
        "mixed": Policy("mixed", types=("email", "inn", "phone"), overrides={"inn": "remove", "phone": "off"}), "high": Policy("high", types=("email", "inn"), min_confidence=0.9), "skip": Policy("skip", types=("email", "inn"), min_confidence=0.8, trap_policy="prefer_skip"),
        "allow": Policy("allow", types=("email", "inn"), allow_substrings=("A.B@mail.ru",)), "combined": Policy("combined", types=("email", "card_number"), combination_rule=True),
        **{f"t{k}": Policy(f"t{k}", types=("email",), min_confidence=0.3 + k / 1000) for k in range(30)},
    }
    rows = [(s, str(k), t) for s in [*policies, "nobody", None] for k, t in enumerate([text, "", None, "x@y.ru"])]
    requests = spark.createDataFrame(rows, "system_id string, payload_id string, payload string")
    done = mask_by_policy(requests, policies)
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and "Union" not in plan
    got = {(r["system_id"], r["payload_id"]): (r["_masked"], r["_mappings"]) for r in done.collect()}
    assert len(got) == len(rows) and all(got[s, str(k)] == (None, None) for s in ("nobody", None) for k in range(4))
    for s in ("plain", "hash", "stars", "mixed", "high", "skip", "allow", "combined", "t7"):
        own = {r["payload_id"]: (r["masked_text"], r["mappings"]) for r in mask(requests.where(F.col("system_id") == s), policy=policies[s], text_col="payload").collect()}
        assert {k: got[s, k] for k in own} == own
    both = mask_by_policy(requests.where("system_id in ('plain', 'hash')"), {"plain": policies["plain"], "hash": Policy("hash", types=("inn",), mask_mode="pseudonym")})
    assert {r["system_id"] for r in both.where("_masked is not null").collect()} == {"plain", "hash"}


def test_conversations_are_detected_once(spark, monkeypatch):
    from sievemark.operators import process

    plans = []
    keep = process.written_once
    monkeypatch.setattr(process, "written_once", lambda df, what: plans.append(what) or keep(df, what))
    turns = spark.createDataFrame([(1, 0, "u", "ИНН 7707083893"), (1, 1, "a", "да, 7707083893 и ИНН 500100732259"), (2, 0, "u", None), (None, 0, "u", "ИНН 500100732259"), (1, 1, "a", "да, 7707083893 и ИНН 500100732259")], "conv_id long, turn long, role string, text string")
    out = mask_conversations(turns, policy=Policy(types=("inn",)))
    assert plans == ["turns"] and "regexp_extract_all" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert sorted((r["conv_id"] or 0, r["turn"], r["masked_text"] or "-") for r in out.collect()) == [(0, 0, "ИНН <<INN_1>>"), (1, 0, "ИНН <<INN_1>>"), (1, 1, "да, <<INN_1>> и ИНН <<INN_2>>"), (1, 1, "да, <<INN_1>> и ИНН <<INN_2>>"), (2, 0, "-")]


def test_quality_counts_spans_and_characters(spark):
    spans = "doc_id long, type_id string, start int, end int"
    gold = spark.createDataFrame([(1, "a", 0, 10), (1, "b", 20, 30), (1, "a", 5, 8), (2, "a", 0, 4), (2, "a", 0, 4), (9, "c", 1, 2)], spans)
    found = spark.createDataFrame([(1, "a", 9, 12), (1, "a", 22, 24), (1, "a", 23, 40), (3, "a", 0, 5), (2, "a", 4, 6)], spans)
    got = {r["type_id"]: (r["gold"], r["found"], r["recall"], r["precision"]) for r in quality(gold, found).collect()}
    assert got == {"a": (4, 5, 0.25, 0.2), "b": (1, 0, 0.0, None), "c": (1, 0, 0.0, None)}
    one = overall_quality(spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 9)], "doc_id long"), gold, found).first()
    assert tuple(one) == (round(1 / 6, 4), round(2 / 6, 4), round((1 + 8) / (10 + 10 + 4 + 1), 4), round(9 / (3 + 18 + 5 + 2), 4), 0.5)


def test_stored_mappings_come_back_sealed_and_bounded(spark):
    store = spark.createDataFrame([("a", "1", [("inn", "7707083893", "<<INN_1>>")]), ("b", "1", [("inn", "500100732259", "<<INN_1>>")])], f"system_id string, payload_id string, mappings {MASKS}")
    asked = spark.createDataFrame([("a", "1", "см. <<INN_1>>"), ("b", "1", "см. <<inn_1>>"), ("c", "1", "см. <<INN_1>>")], "system_id string, payload_id string, text string")
    got = {r["system_id"]: (r["restored_text"], r["unresolved"], r["found"]) for r in unmask_stored(asked, store).collect()}
    assert got == {"a": ("см. 7707083893", 0, True), "b": ("см. 500100732259", 0, True), "c": ("см. <<INN_1>>", 1, False)}
    rows = spark.createDataFrame([("m", "Иванов"), ("n", None)], "masked string, original string")
    key, other = F.lit("0123456789abcdef"), F.lit("fedcba9876543210")
    closed = sealed(rows, key)
    assert "original" not in closed.columns and {r["masked"]: r["original"] for r in unsealed(closed, key).collect()} == {"m": "Иванов", "n": None}
    assert {r["original"] for r in unsealed(closed, other).collect()} == {None}
    held = spark.range(50).select(F.lit("s").alias("system_id"), F.col("id").cast("string").alias("payload_id"), F.timestamp_seconds(F.col("id") % 40).alias("created_at"))
    assert {int(r["payload_id"]) for r in evicted(held, 5).collect()} == {39, 38, 37, 36, 35}
    hinted = spark.createDataFrame([("дать <<FIO_1>> и <<INN_1>>", [("fio", "Иванов", "<<FIO_1>>"), ("inn", "1", "<<INN_1>>")])], f"t string, m {MASKS}")
    assert hinted.select(case_hints(F.col("t"), F.col("m"), F.create_map(F.lit("<<FIO_1>>"), F.lit("дат"), F.lit("<<INN_1>>"), F.lit("дат")))).first()[0] == "дать <<FIO_1:дат>> и <<INN_1>>"


def test_corpora_and_exposed_counts(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"id": "1", "text": "ab", "entities": [{"type": "Name", "start": 0, "end": 2, "text": "ab"}, {"type": "ODD", "start": 0, "end": 1}], "source": "s"}\n{"id": "2", "text": "", "entities": []}\n')
    assert [tuple(r) for r in gold_spans(read_corpus(spark, str(tmp_path)), {"NAME": "fio"}).collect()] == [("1", "fio", 0, 2)]
    counts = spark.createDataFrame([("a", None, 3)], "system string, direction string, n long")
    assert exposed(counts, "requests_total", ["system", "direction"]).first()[0] == 'requests_total{system="a",direction=""} 3'


# ---- streams ---------------------------------------------------------------------------------

REQUEST = "system_id string, payload_id string, payload string, ts timestamp"


def ask(spark, folder, *rows):
    frame = spark.createDataFrame(list(rows), "system_id string, payload_id string, payload string, n int")
    frame.select("system_id", "payload_id", "payload", F.timestamp_seconds("n").alias("ts")).coalesce(1).write.mode("append").parquet(str(folder))


@pytest.fixture
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_store_expires_survives_a_restart_and_ignores_stale_timers(spark, tmp_path, rocksdb):
    policies = {"a": Policy("a", types=("inn",)), "b": Policy("b", types=("inn",), unmask_enabled=False)}
    one, two = "ИНН 7707083893", "ИНН 500100732259"

    def run(*rows):
        ask(spark, tmp_path / "in", *rows)
        stream = spark.readStream.schema(REQUEST).parquet(str(tmp_path / "in"))
        query = store_stream(stream, policies, ttl_seconds=100).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
        return {(r["system_id"], r["payload_id"], int(r["ts"].timestamp())): (r["action"], r["result"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    got = run(("a", "1", one, 1000), ("a", "1", "вот <<INN_1>>", 1001), ("b", "1", two, 1000), ("b", "1", "ИНН <<INN_1>>", 1002), ("c", "1", "x", 1000), ("a", "2", "", 1000))
    assert got == {("a", "1", 1000): ("mask", "ИНН <<INN_1>>"), ("a", "1", 1001): ("restore", "вот 7707083893"), ("b", "1", 1000): ("mask", "ИНН <<INN_1>>"), ("b", "1", 1002): ("echo", "ИНН <<INN_1>>"), ("c", "1", 1000): ("refused", None), ("a", "2", 1000): ("empty", "")}
    # a new run of the query goes on with the entries of the last; at 1150 the first entry is over and the id is written again
    assert run(("a", "1", one, 1050))["a", "1", 1050] == ("repeat", "ИНН <<INN_1>>")
    assert run(("a", "1", two, 1150))["a", "1", 1150] == ("mask", "ИНН <<INN_1>>")
    # the timer of the first entry has fired by now; it says nothing of the second one
    assert run(("a", "1", "см. <<INN_1>>", 1200), ("a", "9", one, 1210))["a", "1", 1200] == ("restore", "см. 500100732259")
    assert run(("b", "9", one, 1400))["b", "9", 1400][0] == "mask"
    assert run(("a", "1", "см. <<INN_1>>", 1500))["a", "1", 1500] == ("mask", "см. <<INN_1>>")


CONFIG = """
version: 1
server: {listen: "0.0.0.0:80"}
default_system: a
systems:
  - {id: a, types: [%s], min_confidence: 0.3}
"""


def test_policies_change_between_batches_and_the_old_ones_stay_on_errors(spark, tmp_path):
    table, got = tmp_path / "policies", {}
    table.mkdir()

    def publish(version, body):
        spark.createDataFrame([(version, body)], "version long, body string").coalesce(1).write.mode("append").json(str(table))

    def sink(rows, number):
        for r in rows.collect():
            got[r["payload_id"]] = (r["masked_text"], r["version"])

    policies = Reloaded(str(table))
    with pytest.raises(ConfigError, match="no usable version"):
        policies.current(spark)
    text = "ИНН 7707083893, почта a@b.ru"
    for step, (version, body) in enumerate([(1, CONFIG % "inn"), (2, CONFIG % "email"), (3, "version: [broken"), (4, CONFIG % "no_such_type"), (5, CONFIG % "inn, email")]):
        publish(version, body)
        ask(spark, tmp_path / "in", ("a", str(step), text, step), ("z", f"z{step}", text, step))
        stream = spark.readStream.schema(REQUEST).parquet(str(tmp_path / "in"))
        masked_batches(stream, policies, sink).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        if step in (2, 3):
            assert policies.refused[0] == version
    assert [got[str(k)] for k in range(5)] == [("ИНН <<INN_1>>, почта a@b.ru", 1), ("ИНН 7707083893, почта <<EMAIL_1>>", 2), ("ИНН 7707083893, почта <<EMAIL_1>>", 2), ("ИНН 7707083893, почта <<EMAIL_1>>", 2), ("ИНН <<INN_1>>, почта <<EMAIL_1>>", 5)]
    assert got["z0"][0] is None and policies.refused is None


def test_a_backlog_is_drained_by_degrees_and_short_requests_do_not_wait(spark, tmp_path):
    for k in range(6):
        ask(spark, tmp_path / "in", ("a", f"s{k}", "short", k), ("a", f"l{k}", "long " * 50, k))
    sizes = {}

    def drained(stream, name):
        counts = []
        stream.writeStream.foreachBatch(lambda rows, n: counts.append(sorted(r["payload_id"] for r in rows.collect()))).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        sizes[name] = counts

    short, long_ = lanes(spark, str(tmp_path / "in"), REQUEST, long_chars=20, max_bytes=None, max_files=2)
    drained(short, "short")
    assert sum(sizes["short"], []) and sorted(sum(sizes["short"], [])) == [f"s{k}" for k in range(6)] and len(sizes["short"]) == 3
    drained(long_, "long")
    assert sorted(sum(sizes["long"], [])) == [f"l{k}" for k in range(6)] and all(len(x) <= 2 for x in sizes["long"])
    by_bytes, _ = lanes(spark, str(tmp_path / "in"), REQUEST, long_chars=20, max_bytes="1")
    drained(by_bytes, "bytes")
    assert len(sizes["bytes"]) == 6


def test_counts_are_observed_while_a_stream_runs(spark, tmp_path):
    seen = Counting()
    spark.streams.addListener(seen)
    try:
        for k in range(3):
            ask(spark, tmp_path / "in", ("a", f"{k}", "x" * k, k), ("b", f"{k}", "yy", k))
        stream = spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        counted = observed_counts(stream, "requests", {"of_a": F.col("system_id") == "a"}, F.length("payload") / 1000, SECONDS)
        query = counted.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        own = seen.totals["requests"]
        assert (own["requests"], own["of_a"], own["le_0.0005"], own["le_0.001"], own["le_2.5"]) == (6, 3, 1, 2, 6)
    finally:
        spark.streams.removeListener(seen)


def test_sliding_statistics_of_a_stream(spark, tmp_path):
    ask(spark, tmp_path / "in", ("a", "1", "x", 100), ("a", "2", "x", 130), ("a", "3", "x", 161))
    ask(spark, tmp_path / "in", ("a", "4", "x", 1000))
    stream = spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stats_stream(stream, late="10 seconds").writeStream.format("memory").queryName("sliding").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {int(r["window_start"].timestamp()): r["requests"] for r in spark.table("sliding").collect()}
    second = lambda s: sum(1 for t in (100, 130, 161, 1000) if s <= t < s + 60)
    # windows that the watermark has passed: those of the last request are still open
    assert got == {s: second(s) for s in range(41, 162)}
