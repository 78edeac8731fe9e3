"""Aggregates over requests: sliding windows, histograms, counters, detection quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def window_stats(events: DataFrame, ts: str = "ts", length: str = "60 seconds", slide: str = "60 seconds", error: Column | None = None, tokens: Column | None = None) -> DataFrame:
    """Requests, errors, tokens and their rates of each window; works on batches and on streams with a watermark."""
    error, tokens = F.lit(False) if error is None else error, F.lit(0) if tokens is None else tokens
    seconds = F.unix_timestamp("w.end") - F.unix_timestamp("w.start")
    # each second is summed first, so that a row is not copied into every window it falls in
    by_second = events.groupBy(F.window(ts, slide).alias("s")).agg(F.count("*").alias("n"), F.sum(error.cast("long")).alias("e"), F.sum(tokens.cast("long")).alias("t"))
    sums = by_second.groupBy(F.window("s", length, slide).alias("w")).agg(F.sum("n").alias("requests"), F.sum("e").alias("errors"), F.sum("t").alias("tokens"))
    return sums.select(F.col("w.start").alias("window_start"), "requests", "errors", "tokens", (F.col("requests") / seconds).alias("rps"), (F.col("tokens") / seconds).alias("tps"))


BASE, BUCKETS = 50.0, 24


def bucket_bound(value: Column) -> Column:
    """Upper bound of the doubling bucket of a value: 50, 100, 200, ..."""
    k = F.ceil(F.log2(F.greatest(value, F.lit(BASE)) / BASE))
    return BASE * F.pow(F.lit(2.0), F.least(k, F.lit(BUCKETS - 1)))


def bucket_percentiles(rows: DataFrame, value: Column, key: Column, shares=(0.5, 0.95, 0.99)) -> DataFrame:
    """Percentiles as upper bounds of buckets, from counts by bucket."""
    counts = rows.groupBy(key.alias("key"), bucket_bound(value).alias("bound")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("key").orderBy("bound")
    summed = counts.withColumn("below", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy("key")))
    return summed.groupBy("key").agg(F.max("total").alias("n"), *[F.min(F.when(F.col("below") >= F.ceil(F.col("total") * s), F.col("bound"))).alias(f"p{int(s * 100)}") for s in shares])


#: Upper bounds of the seconds of a stage.
SECONDS = (0.0005, 0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5)


def histogram(rows: DataFrame, value: Column, keys: list[Column], bounds=SECONDS) -> DataFrame:
    """(keys, bound, n): how many values are at most each bound; null bound: all."""
    steps = F.array(*[F.lit(float(b)) for b in bounds], F.lit(float("inf")))
    counted = rows.select(*keys, F.element_at(F.filter(steps, lambda b: value <= b), 1).alias("bound")).where("bound is not null")
    names = counted.columns[:-1]
    exact = counted.groupBy(*names, "bound").agg(F.count("*").alias("n"))
    # counts by bound are few, and each adds to the bounds above it
    spread = exact.select(*names, F.explode(F.filter(steps, lambda b: b >= F.col("bound"))).alias("bound"), "n")
    return spread.groupBy(*names, "bound").agg(F.sum("n").alias("n")).withColumn("bound", F.when(F.col("bound") < float("inf"), F.col("bound")))


def counters(requests: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) with totals over each subset of the keys, null standing for all."""
    return requests.cube(*keys).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def exposed(counts: DataFrame, name: str, keys: list[str], value: str = "n") -> DataFrame:
    """Counts as lines of the text format that metric collectors read."""
    labels = [F.concat(F.lit(f'{k}="'), F.coalesce(F.col(k).cast("string"), F.lit("")), F.lit('"')) for k in keys]
    return counts.select(F.concat(F.lit(f"{name}{{"), F.concat_ws(",", *labels), F.lit("} "), F.col(value).cast("string")).alias("line"))


def observed_counts(requests: DataFrame, name: str, conditions: dict[str, Column], value: Column | None = None, bounds=SECONDS) -> DataFrame:
    """requests, counted while they are used for something else: metrics `name` with how many meet each condition, and how many values are at most each bound.

    Batches get them from an Observation, streams from their progress (`Counting`). No pass of their own is made.
    """
    told = [F.count("*").alias("requests"), *[F.count_if(c).alias(k) for k, c in conditions.items()]]
    if value is not None:
        told += [F.count_if(value <= b).alias(f"le_{b:g}") for b in bounds]
    return requests.observe(name, *told)


class Counting(StreamingQueryListener):
    """Sums of the observed metrics of all batches of all streams of the session, by name."""

    def __init__(self):
        self.totals: dict[str, dict[str, int]] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for name, row in event.progress.observedMetrics.items():
            own = self.totals.setdefault(name, {})
            for k, n in row.asDict().items():
                own[k] = own.get(k, 0) + (n or 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def _hits(gold: DataFrame, found: DataFrame, by) -> DataFrame:
    """(by, start, end, gold, met): distinct spans of both sides, and whether one of the other side overlaps them. One shuffle and one sort for both."""
    side = lambda rows, own: rows.select(*by, "start", "end", F.lit(own).alias("gold"))
    spans = side(gold, True).unionByName(side(found, False)).where("end > start").distinct()
    # a span is a mark where it begins and asks where it ends; what begins there comes after
    events = spans.select("*", F.explode(F.array(F.struct(F.col("end").alias("at"), F.lit(0).alias("turn")), F.struct(F.col("start").alias("at"), F.lit(1).alias("turn")))).alias("e"))
    upto = Window.partitionBy(*by).orderBy("e.at", "e.turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    furthest = lambda own: F.max(F.when((F.col("e.turn") == 1) & (F.col("gold") == own), F.col("end"))).over(upto)
    told = events.select("*", furthest(True).alias("of_gold"), furthest(False).alias("of_found")).where("e.turn = 0")
    return told.select(*by, "start", "end", "gold", F.coalesce(F.when(F.col("gold"), F.col("of_found")).otherwise(F.col("of_gold")) > F.col("start"), F.lit(False)).alias("met"))


def quality(gold: DataFrame, found: DataFrame) -> DataFrame:
    """Entity recall and precision by type; a hit is an overlap of equal types. gold, found: doc_id, type_id, start, end."""
    count = lambda rows, n: rows.groupBy("type_id").agg(F.count("*").alias(n))
    hits = _hits(gold, found, ["doc_id", "type_id"]).where("met").groupBy("type_id").agg(F.count_if("gold").alias("gold_hit"), F.count_if(~F.col("gold")).alias("found_hit"))
    total = count(gold, "gold").join(count(found, "found"), "type_id", "full").join(hits, "type_id", "left")
    c = lambda n: F.coalesce(n, F.lit(0))
    return total.select("type_id", c("gold").alias("gold"), c("found").alias("found"), F.round(c("gold_hit") / F.col("gold"), 4).alias("recall"), F.round(c("found_hit") / F.col("found"), 4).alias("precision"))


def _characters(gold: DataFrame, found: DataFrame) -> DataFrame:
    """One row: how many characters gold, found, and both cover. Lengths of the stretches between the places where a span begins or ends."""
    side = lambda rows, own: rows.where("end > start").select("doc_id", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("by")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("by")))).alias("e"), F.lit(own).alias("gold"))
    steps = side(gold, True).unionByName(side(found, False)).groupBy("doc_id", F.col("e.at").alias("at")).agg(F.sum(F.when(F.col("gold"), F.col("e.by")).otherwise(0)).alias("g"), F.sum(F.when(~F.col("gold"), F.col("e.by")).otherwise(0)).alias("f"))
    order = Window.partitionBy("doc_id").orderBy("at")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    open_ = steps.select((F.lead("at").over(order) - F.col("at")).cast("long").alias("n"), (F.sum("g").over(upto) > 0).alias("g"), (F.sum("f").over(upto) > 0).alias("f"))
    length = lambda test, n: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).alias(n)
    return open_.agg(length(F.col("g"), "gold_chars"), length(F.col("f"), "found_chars"), length(F.col("g") & F.col("f"), "both"))


def overall_quality(docs: DataFrame, gold: DataFrame, found: DataFrame) -> DataFrame:
    """One row: entity recall with and without regard to types, recall and precision in characters, and the share of texts without gold that have no finding.

    gold and found are read a few times each: give tables, not plans of detection.
    """
    typed = _hits(gold, found, ["doc_id", "type_id"]).where("gold and met").agg(F.count("*").alias("typed"))
    any_type = _hits(gold, found, ["doc_id"]).where("gold and met").select("doc_id", "start", "end")
    untyped = gold.select("doc_id", "start", "end", "type_id").distinct().join(any_type, ["doc_id", "start", "end"], "left_semi").agg(F.count("*").alias("untyped"))
    marks = docs.select("doc_id").withColumn("d", F.lit(1)).unionByName(gold.select("doc_id").withColumn("g", F.lit(1)), allowMissingColumns=True).unionByName(found.select("doc_id").withColumn("f", F.lit(1)), allowMissingColumns=True)
    seen = marks.groupBy("doc_id").agg(F.count("d").alias("d"), F.count("g").alias("g"), F.count("f").alias("f"))
    clean = F.when(F.col("g") == 0, F.col("d")).otherwise(0)
    sums = seen.agg(F.sum("g").alias("gold"), F.sum(clean).alias("clean"), F.sum(F.when(F.col("f") == 0, clean).otherwise(0)).alias("quiet"))
    one = typed.crossJoin(untyped).crossJoin(_characters(gold, found)).crossJoin(sums)  # single rows
    share = lambda a, b: F.round(F.col(a) / F.nullif(F.col(b), F.lit(0)), 4)
    return one.select(share("typed", "gold").alias("recall_typed"), share("untyped", "gold").alias("recall_untyped"), share("both", "gold_chars").alias("char_recall"), share("both", "found_chars").alias("char_precision"), share("quiet", "clean").alias("clean_untouched"))
