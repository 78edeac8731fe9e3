"""WARC archives and an index merged from locally sorted capture runs.

Pages become response records; of records with equal payloads the one with the smallest page_id
keeps the payload and the others are revisit records that refer to it. Archives are written and read
by Spark's own files, so they may lie in any store it knows. Every archive yields a capture run that
is sorted by URL key, timestamp and page; offset and length are places in the archive's text, before
compression. Runs are cut at common splitters (from a sample of at most MOST_SAMPLE keys) and the pieces
of each key range are merged by a loser tree, so the ranges in order form one globally ordered capture
history, and a key that many captures share is cut like any other.

Defined cases: null html is an empty payload; empty payloads are records like others; null url is the
empty key; rows that repeat a page are records of their own and those with the smallest page_id are
all responses; if all page_ids of a payload are null they are all responses, and a null page_id beside
others revisits; an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_path, stored, table, unit_hash

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: The capture time of page n, where the pages have none: so many seconds after this.
FIRST_CAPTURE = "2024-01-01 00:00:00"
#: Records of an archive, and bytes that their payloads can't exceed; a longer payload has an archive of its own.
RECORDS_AN_ARCHIVE, ARCHIVE_BYTES = 2000, 512 << 20
#: Captures in a merged key range, keys sampled for each range, and keys sampled at most.
RANGE_ROWS, RANGE_SAMPLE, MOST_SAMPLE = 20_000, 30, 100_000


def base32_sha1(text: Column) -> Column:
    digest = F.sha1(text.cast("binary"))
    letters = []
    for k in range(8):  # five hex digits are four letters
        bits = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(ALPHABET), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def with_records(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, captured, refers_to (null: response)."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), base32_sha1(payload).alias("payload_digest"))
    first = stored(rows.groupBy("payload_digest", "payload_bytes").agg(F.min("page_id").alias("first")), "payloads")
    when = F.date_format(F.lit(FIRST_CAPTURE).cast("timestamp") + F.make_dt_interval(secs=F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first"))
    return rows.join(first, ["payload_digest", "payload_bytes"]).select("*", when.alias("captured"), refers.alias("refers_to"))


def record_text(r: DataFrame) -> Column:
    """One record without the two line ends that close it."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    response = F.col("refers_to").isNull()
    block = F.when(response, F.concat(F.lit(HTTP), F.col("payload"))).otherwise("")
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(response, "response").otherwise("revisit")), line("WARC-Record-ID", name(F.col("page_id"))), line("WARC-Date", F.col("captured")),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20]", "%20")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))), line("WARC-Payload-Length", F.col("payload_bytes")),
        F.when(response, "").otherwise(F.concat(line("WARC-Refers-To", name(F.col("refers_to"))), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"), line("Content-Length", F.octet_length(block)), F.lit("\r\n"), block,
    )


def write_archives(pages: DataFrame, path: str) -> None:
    longest = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    most = max(1, min(RECORDS_AN_ARCHIVE, ARCHIVE_BYTES // (longest + 1000)))
    r = with_records(pages)
    r.select(record_text(r).alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


def url_key(url: str) -> str:
    """Host reversed by labels, then the rest, in lower case; www. and the scheme dropped."""
    m = re.match(r"(?i)(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)(?::\d+)?([^#]*)", url)
    host, rest = (m[1], m[2]) if m else ("", url)
    labels = host.lower().removeprefix("www.").split(".")
    return f"{','.join(reversed(labels))}){rest.lower() or '/'}"


def records(data: bytes):
    """(headers, block, offset, length) of every record; the lengths decide, not what blocks hold."""
    at = 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        headers = dict(x.split(": ", 1) for x in data[at:head].decode().split("\r\n")[1:])
        start = head + 4
        size = int(headers["Content-Length"])
        yield headers, data[start : start + size], at, start + size - at
        at = start + size + len(END)


CAPTURE = "url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"
FIELDS = [x.split()[0] for x in CAPTURE.split(", ")]


def capture_runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of every archive, each archive's in order."""

    def number(name: str):
        found = re.fullmatch(r"<urn:page:(-?\d*)>", name)
        return int(found[1]) if found and found[1] else None

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for h, block, offset, length in records(gzip.decompress(content.as_py())):
                    size, digest, kind = int(h["WARC-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"]
                    if kind == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    rows.append((url_key(h["WARC-Target-URI"]), h["WARC-Date"], number(h["WARC-Record-ID"]), size, digest, kind, number(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None, name.rsplit("/", 1)[-1], offset, length))
                rows.sort(key=_order)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 10, [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()], strict=True)], FIELDS)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, CAPTURE)


def _order(row) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0, row[7], row[8]


class LoserTree:
    """k-way merge of sorted runs: inner nodes keep the losers of their matches, the winner comes out."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key, self.k = runs, key, max(1, len(runs))
        self.at = [0] * len(runs)
        self.heads = [key(r[0]) if r else None for r in runs] or [None]
        self.losers = [-1] * self.k
        for leaf in range(self.k):
            self._play(leaf)

    def _beats(self, a: int, b: int) -> bool:
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[b] is None and (self.heads[a] is not None or a < b)
        return (self.heads[a], a) < (self.heads[b], b)

    def _play(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:  # the first to arrive waits for its opponent
                self.losers[node] = winner
                return
            if self._beats(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while self.heads[w := self.losers[0]] is not None:
            yield self.runs[w][self.at[w]]
            self.at[w] += 1
            self.heads[w] = self.key(self.runs[w][self.at[w]]) if self.at[w] < len(self.runs[w]) else None
            self._play(w)


def merged_index(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Captures with key_range and position: ordered by both they are the global history by key and time."""
    total = runs.count()
    ranges = max(1, -(-total // range_rows))
    key = F.struct("url_key", "captured", "page_id", "archive", "offset")
    splitters = []
    if ranges > 1:
        share = min(1.0, min(RANGE_SAMPLE * ranges, MOST_SAMPLE) / total)
        sample = runs.where(unit_hash("archive", "offset", seed=5) < share).select(key.alias("k")).select("k.*").collect()
        sample = sorted(_order((s[0], s[1], s[2], 0, "", "", None, s[3], s[4], 0)) for s in sample)
        splitters = sample[:: max(1, len(sample) // ranges)][1:]
    kind = T.StructType.fromDDL(CAPTURE)
    packed_schema = T.StructType([T.StructField("key_range", T.IntegerType()), T.StructField("rows", T.ArrayType(kind))])

    def cut(batches):
        """A row for each piece of a sorted run that lies in one key range."""
        from bisect import bisect_left

        for batch in batches:
            rows = batch.to_pylist()
            pieces, last = {}, None
            for r in rows:
                order = _order([r[f] for f in FIELDS])
                where = bisect_left(splitters, order)
                if last is None or r["archive"] != last[0] or where != last[1] or order < last[2]:
                    pieces.setdefault("at", []).append((where, []))
                last = (r["archive"], where, order)
                pieces["at"][-1][1].append(r)
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in pieces.get("at", [])], pa.int32()), pa.array([x for _, x in pieces.get("at", [])], pa.list_(batch.to_struct_array().type))], ["key_range", "rows"])

    def merge(key, part):
        runs_ = [[[r[f] for f in FIELDS] for r in rows] for rows in part.column("rows").to_pylist()]
        out = list(LoserTree(runs_, _order))
        columns = list(zip(*out, strict=True)) if out else [[]] * len(FIELDS)
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        return pa.table([pa.array(np.full(len(out), key[0].as_py()), pa.int32()), pa.array(np.arange(len(out)), pa.int64()), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["key_range", "position", *FIELDS])

    return runs.mapInArrow(cut, packed_schema).groupBy("key_range").applyInArrow(merge, f"key_range int, position long, {CAPTURE}")


def archived(pages: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Write the pages, read the archives back and return their merged index."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(pages, path)
    return merged_index(stored(capture_runs(spark, path), "runs"), range_rows)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "key_range", "position")
