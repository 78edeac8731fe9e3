"""Registered queries of the sensitive-text engine and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions import validators as V
from .letters import letters, letters_sql
from .operators.detect import candidates, detect, detect_under, with_entities
from .operators.mask import mask, unmask
from .operators.process import mask_conversations, process, sse_text
from .operators.stats import SECONDS, bucket_percentiles, counters, histogram, overall_quality, quality, window_stats
from .plans.registry import TYPES, WIDE_SPACES, Policy, spelled
from .sources.storage import dealt, written_once
from .sources.tables import audit

SALT = "documents-2026"
BASIC = Policy(types=("email", "card_number", "secret"))
#: All types that are on by default, and secret.
EVERY = Policy(types=(*(t.id for t in TYPES if t.enabled_by_default), "secret"))
SPEC = {t.id: t for t in TYPES}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def _policy(of: Policy = BASIC, **fields) -> Policy:
    return Policy(**{"types": of.types, **fields})


def _spans(type_id: str):
    return lambda spark, sf_dir: candidates(_docs(spark, sf_dir), policy=Policy(types=(type_id,))).select("doc_id", "start", "end", "value", "confidence").distinct()


def _masked(of: Policy = BASIC, **fields):
    return lambda spark, sf_dir: mask(_docs(spark, sf_dir), policy=_policy(of, **fields)).where("n_entities > 0").select("doc_id", "masked_text", "n_entities")


def detect_resolved(spark, sf_dir, of: Policy = BASIC):
    return detect(_docs(spark, sf_dir), policy=of).select("doc_id", "type_id", "start", "end", "confidence")


def entity_counts(spark, sf_dir, of: Policy = BASIC):
    return detect(_docs(spark, sf_dir), policy=of).groupBy("type_id").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


def threshold_policies(spark, sf_dir, of: Policy = BASIC):
    """Both policies at a threshold that equals a score."""
    found = detect_under(_docs(spark, sf_dir), {p: _policy(of, min_confidence=0.8, trap_policy=p) for p in ("prefer_mask", "prefer_skip")})
    return found.groupBy("type_id", "policy").agg(F.count("*").alias("n")).select("type_id", "n", "policy")


def mappings_distinct(spark, sf_dir, of: Policy = BASIC):
    rows = mask(_docs(spark, sf_dir), policy=of).select("doc_id", F.explode("mappings").alias("m"))
    return rows.select("doc_id", "m.type_id", "m.original", "m.masked")


def roundtrip_rate(spark, sf_dir, of: Policy = BASIC):
    rows = unmask(mask(_docs(spark, sf_dir), policy=of))
    return rows.agg(F.count("*").alias("docs"), F.sum((F.col("restored_text") == F.col("text")).cast("long")).alias("equal"), F.sum("unresolved").alias("unresolved"))


def conversation_mask(spark, sf_dir, of: Policy = BASIC):
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return mask_conversations(turns, policy=of).select("conv_id", "turn", "role", "masked_text", "n_entities")


def _keys(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 7919 % 1000000007 + F.col("o_custkey") * 104729).alias("k"))


def checksum_inn(spark, sf_dir):
    rows = _keys(spark, sf_dir).select("o_orderkey", F.lpad((F.col("k") * 17 % 10000000000).cast("string"), 10, "0").alias("number"))
    return rows.select("o_orderkey", "number", V.inn(F.col("number")).alias("valid"))


def checksum_snils(spark, sf_dir):
    rows = _keys(spark, sf_dir).select("o_orderkey", F.lpad((F.col("k") * 131 % 100000000000).cast("string"), 11, "0").alias("number"))
    return rows.select("o_orderkey", "number", V.snils(F.col("number")).alias("valid"))


def checksum_luhn(spark, sf_dir):
    rows = _keys(spark, sf_dir).select("o_orderkey", F.concat(F.lit("4276 "), F.lpad((F.col("k") % 1000000000000).cast("string"), 12, "0")).alias("number"))
    return rows.select("o_orderkey", "number", V.luhn(F.col("number")).alias("valid"))


def date_validity(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.concat((k % 33).cast("string"), F.lit("."), (k % 14).cast("string"), F.lit("."), (1950 + k % 80).cast("string")).alias("written"))
    d = V.date_parts(F.col("written"))
    return rows.select("o_orderkey", "written", d["day"].alias("day"), d["month"].alias("month"), d["year"].alias("year"))


def text_functions(spark, sf_dir):
    t = F.col("text")
    n = F.length(t)
    places = [T.byte_offset(t, (n * k / 4).cast("int")).cast("long").alias(f"byte_{k}") for k in (1, 2, 3, 4)]
    return _docs(spark, sf_dir).select("doc_id", T.estimate_tokens(t).alias("tokens"), F.md5(T.value_key(t)).alias("value_key"), F.md5(T.token_key(t)).alias("token_key"), T.sentence_key(t, n).cast("long").alias("sentence_ends"), *places)


def _events(spark, sf_dir):
    return _table(spark, sf_dir, "events")


def stats_minute_window(spark, sf_dir):
    return window_stats(_events(spark, sf_dir), error=F.col("event_type") == "error", tokens=F.length("props"))


def stats_sliding_window(spark, sf_dir):
    """The last minute, told every ten seconds."""
    return window_stats(_events(spark, sf_dir), slide="10 seconds", error=F.col("event_type") == "error", tokens=F.length("props"))


def stage_histogram(spark, sf_dir):
    return histogram(_events(spark, sf_dir), F.abs("value") / 1000, [F.col("event_type").alias("stage")])


def request_counters(spark, sf_dir):
    rows = _events(spark, sf_dir).select(F.concat(F.lit("s"), F.col("user_id") % 4).alias("system"), F.col("event_type").alias("direction"), F.when(F.col("event_id") % 10 == 0, 429).otherwise(200).alias("status"))
    return counters(rows, ["system", "direction", "status"])


def latency_histogram(spark, sf_dir):
    return bucket_percentiles(_table(spark, sf_dir, "events"), F.abs("value") * 1000, F.col("event_type"))


def quality_by_type(spark, sf_dir, of: Policy = BASIC):
    """Against labels that are the findings, every third moved away by a thousand characters."""
    found = written_once(detect(_docs(spark, sf_dir), policy=of), "found")
    moved = F.when(F.col("doc_id") % 3 == 0, 1000).otherwise(0)
    gold = found.select("doc_id", "type_id", (F.col("start") + moved).alias("start"), (F.col("end") + moved).alias("end"))
    return quality(gold, found)


def quality_overall(spark, sf_dir, of: Policy = BASIC):
    found = written_once(detect(_docs(spark, sf_dir), policy=of), "found")
    moved = F.when(F.col("doc_id") % 3 == 0, 1000).when(F.col("doc_id") % 3 == 1, 2).otherwise(0)
    gold = found.where("doc_id % 5 > 0").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "other").otherwise(F.col("type_id")).alias("type_id"), (F.col("start") + moved).alias("start"), (F.col("end") + moved).alias("end"))
    return overall_quality(_docs(spark, sf_dir), gold, found)


def _requests(spark, sf_dir):
    """Each turn of a conversation asks four times under its role: to mask, again the same, what came back, and a text of its own with a token."""
    turns = _table(spark, sf_dir, "conversations").where("text is not null").groupBy("conv_id", "turn", "role").agg(F.min("text").alias("text"))
    key = turns.select(F.col("role").alias("system_id"), F.concat_ws(":", "conv_id", "turn").alias("payload_id"), "text")
    asked = F.array(F.col("text"), F.col("text"), F.concat(F.lit("back: "), "text"), F.lit("see << email_1 >> and <<CARD_1>>"))
    each = key.select("system_id", "payload_id", F.posexplode(asked).alias("second", "payload"))
    return each.select("system_id", "payload_id", "payload", (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(secs=F.col("second"))).alias("ts"))


STORE = "system_id string, payload_id string, masked_text string, original_digest string, mappings array<struct<type_id:string,original:string,masked:string>>, created_at timestamp"
TENANTS = {"user": Policy("user", types=BASIC.types), "assistant": Policy("assistant", types=("email",)), "system": Policy("system", types=BASIC.types, enabled=False)}


def process_requests(spark, sf_dir):
    done = process(_requests(spark, sf_dir), spark.createDataFrame([], STORE), TENANTS)
    return done.select("system_id", "payload_id", F.second("ts").alias("second"), "action", "result")


def audit_rows(spark, sf_dir):
    """A row for each first request, with what its text holds."""
    asked = _requests(spark, sf_dir).where("second(ts) = 0").withColumn("action", F.lit("mask")).withColumn("queue_ms", F.length("payload") % 7)
    found = with_entities(asked, policy=BASIC, text_col="payload").select("_row.system_id", "_row.payload_id", F.explode("_entities").alias("e")).select("system_id", "payload_id", "e.type_id")
    rows = audit(asked, found, ("queue_ms",))
    count = lambda t: F.coalesce(F.try_element_at("counts", F.lit(t)), F.lit(0)).alias(f"n_{t}")
    return rows.select("system_id", "payload_id", "action", "chars", "queue_ms", "n_entities", *[count(t) for t in BASIC.types])


def reply_text(spark, sf_dir):
    """Turns as streamed replies, each in two events, and read back."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    event = lambda t: F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(t.alias("content")).alias("delta"))).alias("choices"))), F.lit("\n\n"))
    body = F.concat(event(F.substring("text", F.lit(1), half)), event(F.substring("text", half + 1, F.length("text"))), F.lit("data: [DONE]\n"))
    return turns.select("conv_id", "turn", "role", sse_text(body).alias("reply"))


def latin_names(spark, sf_dir):
    """Words of letters in Latin."""
    word = F.explode(T.cyrillic_words(F.col("text"))).alias("word")
    return letters(spark, sf_dir).select(word).distinct().select("word", T.transliterate(F.col("word")).alias("latin"))


QUERIES = {
    "email_spans": _spans("email"), "card_luhn_spans": _spans("card_number"), "secret_spans": _spans("secret"), "phone_spans": _spans("phone"),
    "detect_resolved": detect_resolved, "entity_counts": entity_counts, "threshold_policies": threshold_policies,
    "mask_token": _masked(), "mask_hash": _masked(token_numbering="hash", hash_salt=SALT), "mask_stars": _masked(mask_mode="stars"), "mask_remove": _masked(mask_mode="remove"),
    "mappings_distinct": mappings_distinct, "roundtrip_rate": roundtrip_rate, "conversation_mask": conversation_mask,
    "checksum_inn": checksum_inn, "checksum_snils": checksum_snils, "checksum_luhn": checksum_luhn, "date_validity": date_validity, "text_functions": text_functions,
    "stats_minute_window": stats_minute_window, "stats_sliding_window": stats_sliding_window, "stage_histogram": stage_histogram, "request_counters": request_counters, "latency_histogram": latency_histogram,
    "quality_by_type": quality_by_type, "quality_overall": quality_overall, 
    "process_requests": process_requests, "audit_rows": audit_rows, "reply_text": reply_text, "latin_names": latin_names,
}


def _of_every(query):
    return lambda spark, sf_dir: query(spark, sf_dir, EVERY)


#: The detect and mask queries over all types; their SQL below covers BASIC only. Tests hold detect_resolved and mask_token of these; the others have none yet.
QUERIES |= {f"{f.__name__}_all_types": _of_every(f) for f in (detect_resolved, entity_counts, threshold_policies, mappings_distinct, roundtrip_rate, conversation_mask, quality_by_type)}
QUERIES |= {
    "mask_token_all_types": _masked(EVERY), "mask_hash_all_types": _masked(EVERY, token_numbering="hash", hash_salt=SALT), "mask_stars_all_types": _masked(EVERY, mask_mode="stars"), "mask_remove_all_types": _masked(EVERY, mask_mode="remove"),
}


# --- SQL of the same ----------------------------------------------------------------------------


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_RE2_SPACES = "".join(f"\\x{{{c:x}}}" for c in WIDE_SPACES)


def _sql_spans(type_id: str, source: str = "documents", key: str = "doc_id") -> str:
    spec = SPEC[type_id]
    parts = []
    for p in spec.patterns:
        p = _q("(?i)" + spelled(p, _RE2_SPACES))
        parts.append(f"""
  SELECT {key}, text, value AS whole, CAST(list_sum(list_transform(q[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS INTEGER) AS pos, {f"regexp_extract(value, {p}, {spec.group})"} AS value
  FROM (SELECT {key}, text, m, q, unnest(m) AS value, unnest(range(1, len(m) + 1)) AS i FROM (SELECT {key}, text, regexp_extract_all(text, {p}) AS m, string_split_regex(text, {p}) AS q FROM {source}) WHERE len(m) > 0)""")
    return "\n  UNION ALL".join(parts)


DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"
LUHN = f"(list_sum(list_transform(range(1, length({DIGITS}) + 1), lambda i: CASE WHEN (length({DIGITS}) - i) % 2 = 1 THEN CASE WHEN CAST(substr({DIGITS}, i, 1) AS INTEGER) > 4 THEN 2 * CAST(substr({DIGITS}, i, 1) AS INTEGER) - 9 ELSE 2 * CAST(substr({DIGITS}, i, 1) AS INTEGER) END ELSE CAST(substr({DIGITS}, i, 1) AS INTEGER) END)) % 10 = 0)"
_BEFORE = "lower(substr(text, greatest(pos - 40, 0) + 1, least(pos, 40)))"
_AFTER = "lower(substr(text, pos + length(whole) + 1, 39))"
_NEAR_CARD = f"(contains({_BEFORE}, 'card') OR contains({_AFTER}, 'card'))"
_LED = "lower(substr(text, greatest(pos + length(whole) - length(value) - 40, 0) + 1, least(pos + length(whole) - length(value), 40)))"
_SCORES = {
    "email": "CASE WHEN regexp_matches(regexp_replace(value, '\\s', '', 'g'), '^.+@[^@.][^@]*\\.[^@]*[^@.]$') THEN 0.8 END",
    "card_number": f"CASE WHEN length({DIGITS}) = 15 AND NOT {_NEAR_CARD} THEN NULL WHEN {LUHN} THEN CASE WHEN contains({_BEFORE}, 'card') THEN 1.0 ELSE 0.8 END WHEN {_NEAR_CARD} THEN 0.6 END",
    "secret": f"CASE WHEN regexp_matches(value, '[0-9]') AND regexp_matches({_LED}, {_q('|'.join(SPEC['secret'].context_words))}) THEN 0.9 END",
    "phone": f"CASE WHEN regexp_matches({DIGITS}, '^([78][0-9]{{10}}|[948][0-9]{{9}})$') AND NOT regexp_matches({_BEFORE} || chr(10) || {_AFTER}, '(^|[^\\pL\\pN])({'|'.join(SPEC['phone'].against)})($|[^\\pL\\pN])') THEN 0.8 END",
}


def _sql_candidates(type_id: str, source: str = "documents", key: str = "doc_id") -> str:
    return f"""
SELECT {key}, {_q(type_id)} AS type_id, pos + length(whole) - length(value) AS start, pos + length(whole) AS "end", value, CAST({_SCORES[type_id]} AS DOUBLE) AS confidence FROM ({_sql_spans(type_id, source, key)}
) WHERE {_SCORES[type_id]} IS NOT NULL"""


def _sql_resolved(threshold: str = "confidence >= 0.3", source: str = "documents", key: str = "doc_id", union: str = "") -> str:
    """CTEs up to e: the spans kept by the fold from left to right. union: a query of candidates, else those of BASIC."""
    union = union or "\nUNION ALL".join(_sql_candidates(t, source, key) for t in BASIC.types)
    rank = "CASE type_id " + " ".join(f"WHEN '{t.id}' THEN {k}" for k, t in enumerate(TYPES)) + " END"
    return f"""
WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY start, "end" DESC, confidence DESC, {rank}) AS k FROM ({union}) WHERE {threshold}),
f AS (
  SELECT {key}, k, type_id, start, "end", value, confidence, 1 AS grp FROM c WHERE k = 1
  UNION ALL
  SELECT c.{key}, c.k, CASE WHEN w THEN c.type_id ELSE f.type_id END, CASE WHEN w THEN c.start ELSE f.start END, CASE WHEN w THEN c."end" ELSE f."end" END, CASE WHEN w THEN c.value ELSE f.value END, CASE WHEN w THEN c.confidence ELSE f.confidence END, grp + apart
  FROM (SELECT f.*, c.k AS ck, CASE WHEN c.start >= f."end" THEN 1 ELSE 0 END AS apart,
      c.start >= f."end" OR c."end" - c.start > f."end" - f.start OR (c."end" - c.start = f."end" - f.start AND c.confidence > f.confidence) AS w
    FROM f JOIN c ON c.{key} = f.{key} AND c.k = f.k + 1) AS f JOIN c ON c.{key} = f.{key} AND c.k = f.ck),
e AS (SELECT {key}, type_id, start, "end", value, confidence FROM (SELECT *, row_number() OVER (PARTITION BY {key}, grp ORDER BY k DESC) AS r FROM f) WHERE r = 1)"""


_NORM = "lower(trim(regexp_replace(value, '\\s+', ' ', 'g')))"
_LABEL = "CASE type_id WHEN 'email' THEN 'EMAIL' WHEN 'card_number' THEN 'CARD' ELSE 'SECRET' END"


def _sql_plan(masked: str) -> str:
    return f""",
n AS (SELECT *, {_NORM} AS norm FROM e), p AS (SELECT *, min(start) OVER (PARTITION BY doc_id, type_id, norm) AS first FROM n),
d AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id, type_id ORDER BY first) AS number FROM p),
r AS (SELECT *, {masked} AS masked FROM d)"""


_TOKEN = f"'<<' || {_LABEL} || '_' || number || '>>'"
_HASH = f"'<<' || {_LABEL} || '_' || left(sha256({_q(SALT)} || chr(0) || norm), 6) || '>>'"
_STARS = """CASE type_id WHEN 'email' THEN repeat('*', length(regexp_extract(value, '^(.*)@', 1))) || substr(value, length(regexp_extract(value, '^(.*)@', 1)) + 1)
  WHEN 'card_number' THEN left(value, 4) || regexp_replace(substr(value, 5, length(value) - 8), '[^ \\-.()+@/]', '*', 'g') || right(value, 4) ELSE regexp_replace(value, '[^ \\-.()+@/]', '*', 'g') END"""


def _sql_masked(masked: str) -> str:
    return _sql_resolved() + _sql_plan(masked) + """,
b AS (SELECT *, coalesce(lag("end") OVER (PARTITION BY doc_id ORDER BY start), 0) AS before FROM r)
SELECT b.doc_id, string_agg(substr(text, before + 1, start - before) || masked, '' ORDER BY start) || any_value(substr(text, last + 1)) AS masked_text, count(*) AS n_entities
FROM b JOIN (SELECT doc_id, max("end") AS last FROM r GROUP BY doc_id) USING (doc_id) JOIN documents USING (doc_id) GROUP BY b.doc_id"""


def _sql_span_query(type_id: str) -> str:
    return f'SELECT DISTINCT doc_id, start, "end", value, confidence FROM ({_sql_candidates(type_id)})'


def _weights(weights: list[int], text: str = "number") -> str:
    return " + ".join(f"{w} * CAST(substr({text}, {k}, 1) AS INTEGER)" for k, w in enumerate(weights, 1))


def _sql_latin(text: str) -> str:
    for c, t in T.TRANSLITERATED.items():
        text = f"replace({text}, '{c}', '{t.replace('-', '')}')"
    return text


_TURNS = "(SELECT row_number() OVER (ORDER BY conv_id, turn, role) AS rid, role AS system_id, conv_id || ':' || turn AS payload_id, text FROM (SELECT conv_id, turn, role, min(text) AS text FROM conversations WHERE text IS NOT NULL GROUP BY ALL))"


def _sql_requests() -> str:
    """What the first request is masked to; the others meet its entry."""
    allowed = "(system_id = 'user' OR (system_id = 'assistant' AND type_id = 'email'))"
    return _sql_resolved(source=_TURNS, key="rid") + f""",
t AS (SELECT * FROM {_TURNS}),
n AS (SELECT e.*, {_NORM} AS norm FROM e JOIN t USING (rid) WHERE {allowed}), p AS (SELECT *, min(start) OVER (PARTITION BY rid, type_id, norm) AS first FROM n),
d AS (SELECT *, dense_rank() OVER (PARTITION BY rid, type_id ORDER BY first) AS number FROM p),
r AS (SELECT *, {_TOKEN} AS masked, coalesce(lag("end") OVER (PARTITION BY rid ORDER BY start), 0) AS before FROM d),
m AS (SELECT rid, string_agg(substr(t.text, before + 1, start - before) || masked, '' ORDER BY start) AS head, max("end") AS last FROM r JOIN t USING (rid) GROUP BY rid),
w AS (SELECT t.*, coalesce(head || substr(t.text, last + 1), t.text) AS masked_text, (SELECT max(value) FROM r WHERE r.rid = t.rid AND type_id = 'email' AND number = 1 AND start = first) AS email, (SELECT max(value) FROM r WHERE r.rid = t.rid AND type_id = 'card_number' AND number = 1 AND start = first) AS card FROM t LEFT JOIN m USING (rid)),
a AS (SELECT *, unnest([0, 1, 2, 3]) AS second FROM w)
SELECT system_id, payload_id, CAST(second AS INTEGER) AS second,
  CASE WHEN system_id NOT IN ('user', 'assistant') THEN 'refused' WHEN text = '' AND second < 2 THEN 'empty' WHEN text = '' AND second = 2 THEN 'mask' WHEN text <> '' AND second = 0 THEN 'mask' WHEN second = 1 AND masked_text <> text THEN 'repeat' ELSE 'restore' END AS action,
  CASE WHEN system_id NOT IN ('user', 'assistant') THEN NULL WHEN second = 0 THEN masked_text WHEN second = 1 THEN CASE WHEN masked_text <> text THEN masked_text ELSE text END WHEN second = 2 THEN 'back: ' || text ELSE 'see ' || coalesce(email, '<< email_1 >>') || ' and ' || coalesce(card, '<<CARD_1>>') END AS result FROM a"""


def _sql_audit() -> str:
    return _sql_resolved(source=_TURNS, key="rid") + f""", t AS (SELECT * FROM {_TURNS}), counted AS (SELECT rid, count(*) AS n, {", ".join(f"count(*) FILTER (type_id = '{x}') AS n_{x}" for x in BASIC.types)} FROM e GROUP BY rid)
SELECT system_id, payload_id, 'mask' AS action, length(text) AS chars, length(text) % 7 AS queue_ms, coalesce(n, 0) AS n_entities, {", ".join(f"coalesce(n_{x}, 0) AS n_{x}" for x in BASIC.types)} FROM t LEFT JOIN counted USING (rid)"""


def _sql_windows(start: str, source: str = "events") -> str:
    return f"SELECT window_start, requests, errors, tokens, requests / 60.0 AS rps, tokens / 60.0 AS tps FROM (SELECT {start} AS window_start, count(*) AS requests, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors, CAST(sum(length(props)) AS BIGINT) AS tokens FROM {source} GROUP BY 1)"


def _sql_conversations() -> str:
    """Tokens numbered by conversation and type, by first place in turn order."""
    source = "(SELECT row_number() OVER (ORDER BY conv_id, turn, role, text) AS rid, conv_id, turn, role, text FROM conversations)"
    return _sql_resolved(source=source, key="rid") + f""",
v AS (SELECT * FROM {source}),
n AS (SELECT e.*, conv_id, turn, role, {_NORM} AS norm FROM e JOIN v USING (rid)),
p AS (SELECT *, min(row(turn, role, start)) OVER (PARTITION BY conv_id, type_id, norm) AS first FROM n),
d AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id, type_id ORDER BY first, norm) AS number FROM p),
r AS (SELECT *, {_TOKEN} AS masked, coalesce(lag("end") OVER (PARTITION BY rid ORDER BY start), 0) AS before FROM d),
m AS (SELECT rid, string_agg(substr(v.text, before + 1, start - before) || masked, '' ORDER BY start) AS head, max("end") AS last, count(*) AS n_entities FROM r JOIN v USING (rid) GROUP BY rid)
SELECT v.conv_id, v.turn, v.role, coalesce(head || substr(v.text, last + 1), v.text) AS masked_text, coalesce(n_entities, 0) AS n_entities FROM v LEFT JOIN m USING (rid)"""


_KEYS = "SELECT o_orderkey, o_orderkey * 7919 % 1000000007 + o_custkey * 104729 AS k FROM orders"
_YEAR = "1950 + o_orderkey % 80"
ORACLE_SQL = {
    **{f"{name}_spans": _sql_span_query(t) for name, t in (("email", "email"), ("card_luhn", "card_number"), ("secret", "secret"), ("phone", "phone"))},
    "detect_resolved": _sql_resolved() + ' SELECT doc_id, type_id, start, "end", confidence FROM e',
    "entity_counts": _sql_resolved() + " SELECT type_id, count(*) AS n, count(DISTINCT doc_id) AS docs FROM e GROUP BY type_id",
    "threshold_policies": f"SELECT type_id, count(*) AS n, 'prefer_mask' AS policy FROM ({_sql_resolved('confidence >= 0.8')} SELECT * FROM e) GROUP BY type_id UNION ALL SELECT type_id, count(*) AS n, 'prefer_skip' AS policy FROM ({_sql_resolved('confidence > 0.800001')} SELECT * FROM e) GROUP BY type_id",
    "mask_token": _sql_masked(_TOKEN), "mask_hash": _sql_masked(_HASH), "mask_stars": _sql_masked(_STARS), "mask_remove": _sql_masked("'[removed]'"),
    "mappings_distinct": _sql_resolved() + _sql_plan(_TOKEN) + " SELECT doc_id, type_id, value AS original, masked FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, type_id, norm ORDER BY start) AS r FROM r) WHERE r = 1",
    "roundtrip_rate": "SELECT count(*) AS docs, CAST(count(text) AS BIGINT) AS equal, CAST(0 AS BIGINT) AS unresolved FROM documents",
    "checksum_inn": f"SELECT o_orderkey, number, ({_weights(V.INN_10)}) % 11 % 10 = CAST(substr(number, 10, 1) AS INTEGER) AS valid FROM (SELECT o_orderkey, lpad(CAST(k * 17 % 10000000000 AS VARCHAR), 10, '0') AS number FROM ({_KEYS}))",
    "checksum_snils": f"SELECT o_orderkey, number, CASE WHEN s < 100 THEN s WHEN s IN (100, 101) THEN 0 ELSE s % 101 % 100 END = CAST(substr(number, 10, 2) AS INTEGER) AS valid FROM (SELECT *, {_weights(V.SNILS)} AS s FROM (SELECT o_orderkey, lpad(CAST(k * 131 % 100000000000 AS VARCHAR), 11, '0') AS number FROM ({_KEYS})))",
    "checksum_luhn": f"SELECT o_orderkey, value AS number, {LUHN} AS valid FROM (SELECT o_orderkey, '4276 ' || lpad(CAST(k % 1000000000000 AS VARCHAR), 12, '0') AS value FROM ({_KEYS}))",
    "date_validity": f"""SELECT o_orderkey, written, CAST(CASE WHEN dm THEN a WHEN md THEN b END AS INTEGER) AS day, CAST(CASE WHEN dm THEN b WHEN md THEN a END AS INTEGER) AS month, CAST(CASE WHEN dm OR md THEN y END AS INTEGER) AS year FROM (
      SELECT *, try_cast(printf('%d-%d-%d', y, b, a) AS DATE) IS NOT NULL AS dm, try_cast(printf('%d-%d-%d', y, a, b) AS DATE) IS NOT NULL AS md FROM (SELECT o_orderkey, o_orderkey % 33 AS a, o_orderkey % 14 AS b, {_YEAR} AS y, (o_orderkey % 33) || '.' || (o_orderkey % 14) || '.' || ({_YEAR}) AS written FROM orders))""",
    "text_functions": r"""SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, md5(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS value_key, md5(lower(regexp_replace(text, '\s', '', 'g'))) AS token_key,
      CAST(length(regexp_replace(text, '[^.\n]', '', 'g')) AS BIGINT) AS sentence_ends, """ + ", ".join(f"CAST(strlen(left(text, length(text) * {k} // 4)) AS BIGINT) AS byte_{k}" for k in (1, 2, 3, 4)) + " FROM documents",
    "stats_minute_window": _sql_windows("date_trunc('minute', ts)"),
    "stats_sliding_window": _sql_windows("date_trunc('second', ts) - INTERVAL (CAST(second(ts) AS INTEGER) % 10) SECOND - INTERVAL (10 * k) SECOND", "events, range(6) AS steps(k)"),
    "stage_histogram": f"SELECT event_type AS stage, CASE WHEN b < 'infinity'::DOUBLE THEN b END AS bound, count(*) AS n FROM events, (SELECT unnest([{', '.join(map(str, SECONDS))}, 'infinity'::DOUBLE]) AS b) WHERE abs(value) / 1000 <= b GROUP BY event_type, b",
    "request_counters": "SELECT system, direction, status, count(*) AS n, CAST(grouping(system, direction, status) AS BIGINT) AS level FROM (SELECT 's' || (user_id % 4) AS system, event_type AS direction, CASE WHEN event_id % 10 = 0 THEN 429 ELSE 200 END AS status FROM events) GROUP BY CUBE (system, direction, status)",
    "latency_histogram": """WITH b AS (SELECT event_type AS key, 50.0 * pow(2.0, least(ceil(log2(greatest(abs(value) * 1000, 50.0) / 50.0)), 23)) AS bound FROM events), c AS (SELECT key, bound, count(*) AS n FROM b GROUP BY 1, 2),
      s AS (SELECT *, sum(n) OVER (PARTITION BY key ORDER BY bound) AS below, sum(n) OVER (PARTITION BY key) AS total FROM c)
      SELECT key, CAST(max(total) AS BIGINT) AS n, min(CASE WHEN below >= ceil(total * 0.5) THEN bound END) AS p50, min(CASE WHEN below >= ceil(total * 0.95) THEN bound END) AS p95, min(CASE WHEN below >= ceil(total * 0.99) THEN bound END) AS p99 FROM s GROUP BY key""",
    "reply_text": "SELECT conv_id, turn, role, coalesce(text, '') AS reply FROM conversations",
    "latin_names": f"SELECT word, {_sql_latin('lower(word)')} AS latin FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[А-ЯЁа-яё]+')) AS word FROM {letters_sql()})",
    "process_requests": _sql_requests(), "audit_rows": _sql_audit(),
    "conversation_mask": _sql_conversations(),
    "quality_overall": _sql_resolved() + """, g AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'other' ELSE type_id END AS gt, start + d AS g0, "end" + d AS g1 FROM (SELECT *, CASE doc_id % 3 WHEN 0 THEN 1000 WHEN 1 THEN 2 ELSE 0 END AS d FROM e) WHERE doc_id % 5 > 0),
      h AS (SELECT g.*, e.type_id AS ft FROM g JOIN e ON e.doc_id = g.doc_id AND e.start < g1 AND g0 < e."end"), gc AS (SELECT DISTINCT doc_id, unnest(range(g0, g1)) AS place FROM g), fc AS (SELECT DISTINCT doc_id, unnest(range(start, "end")) AS place FROM e),
      k AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM g))
      SELECT round((SELECT count(DISTINCT (doc_id, g0, g1, gt)) FROM h WHERE gt = ft) / (SELECT count(*) FROM g), 4) AS recall_typed, round((SELECT count(DISTINCT (doc_id, g0, g1, gt)) FROM h) / (SELECT count(*) FROM g), 4) AS recall_untyped,
        round((SELECT count(*) FROM gc JOIN fc USING (doc_id, place)) / (SELECT count(*) FROM gc), 4) AS char_recall, round((SELECT count(*) FROM gc JOIN fc USING (doc_id, place)) / (SELECT count(*) FROM fc), 4) AS char_precision,
        round((SELECT count(*) FROM k WHERE doc_id NOT IN (SELECT doc_id FROM e)) / (SELECT count(*) FROM k), 4) AS clean_untouched""",
    "quality_by_type": _sql_resolved() + """, g AS (SELECT doc_id, type_id, start + CASE WHEN doc_id % 3 = 0 THEN 1000 ELSE 0 END AS g0, "end" + CASE WHEN doc_id % 3 = 0 THEN 1000 ELSE 0 END AS g1 FROM e),
      h AS (SELECT g.type_id, count(DISTINCT (g.doc_id, g0, g1)) AS gh, count(DISTINCT (e.doc_id, e.start, e."end")) AS fh FROM g JOIN e ON e.doc_id = g.doc_id AND e.type_id = g.type_id AND e.start < g1 AND g0 < e."end" GROUP BY g.type_id)
      SELECT type_id, n AS gold, n AS found, round(coalesce(gh, 0) / n, 4) AS recall, round(coalesce(fh, 0) / n, 4) AS precision FROM (SELECT type_id, count(*) AS n FROM e GROUP BY type_id) LEFT JOIN h USING (type_id)""",
}
