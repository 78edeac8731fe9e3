"""Quality rules: a learned decision list over native text statistics.

Sequential covering: each rule is a conjunction of threshold tests that is grown by information gain
on two thirds of the labelled statistics, pruned on the other third, and kept if it is precise there;
the rows it covers are then taken out. The list comes out as ordered Spark conditional expressions.
Everything runs in DataFrame functions; the driver sees counts by feature and threshold only.

Bounded by parameters: the labelled sample (max_rows), the list (max_rules rules of max_tests tests), the
thresholds tried (bins quantiles of either label). Covering also ends at the first rule that its pruning
rows don't confirm (precision), as rules found later would rest on fewer rows still.

Defined cases: null and empty texts have no words and fail the base rule (n_words < 20), so they are
not kept; null labels are not learnt from, and without usable labels no rule is learnt and the base rule
alone decides; repeated rows are rows of their own; an empty table gives an empty table; further columns
pass, and those that bear the name of a statistic or verdict are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, stored, table

WINDOW = 8


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _window_hashes(words: Column) -> Column:
    """Hash of the eight words that start at each word, from hashes of two and four; fewer words have none."""

    def widened(hashes: Column, by: int) -> Column:
        return F.transform(hashes, lambda x, i: F.xxhash64(x, F.get(hashes, i + by)))

    of_two = lambda h: _let(widened(h, 1), lambda a: _let(widened(a, 2), lambda b: widened(b, 4)))
    every = _let(F.transform(words, lambda w: F.xxhash64(w)), of_two)
    return F.slice(every, 1, F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))


def _repeat_words(grams: Column) -> Column:
    """Words inside windows of eight words that occur twice or more, the first occurrence included."""

    def spread(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: (F.get(s, k - 1)["g"] == x["g"]) | (F.get(s, k + 1)["g"] == x["g"]))
        return _let(F.sort_array(F.transform(twice, lambda x: x["i"])), lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x))

    tagged = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(_let(tagged, spread)).cast("long")


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The input with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the learned rules' features."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    counted = lambda pattern: F.regexp_count(text, F.lit(pattern))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(rf"[^{SPACE_CLASS}]"))
    # words and windows are columns of their own, so that what uses them several times makes them once
    plain = docs.withColumns({
        "_words": F.array_remove(F.split(text, rf"[{SPACE_CLASS}]+", -1), ""),
        "n_symbols": counted(r"[#*$%&|<>]").cast("long"),
        "n_dup_lines": _let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long"),
        "_lines": counted(r"[^\n]+").cast("double"),
        "_upper": counted(r"\p{Lu}").cast("double"),
        "_marks": counted("[!?.,;:]").cast("double"),
        "_shouts": counted("[!?]").cast("double"),
        "_digits": counted("[0-9]").cast("double"),
    })
    plain = plain.withColumns({"n_words": F.size("_words").cast("long"), "word_chars": F.length(F.array_join("_words", "")).cast("long"), "_windows": _window_hashes(F.col("_words"))})
    plain = plain.withColumn("n_repeat_words", _repeat_words(F.col("_windows")))
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return plain.withColumns({
        "symbols_a_word": F.col("n_symbols") / n,
        "repeated_share": F.col("n_repeat_words") / n,
        "dup_lines_share": F.col("n_dup_lines") / F.greatest("_lines", F.lit(1.0)),
        "word_length": F.col("word_chars") / n,
        "upper_share": F.col("_upper") / chars,
        "marks_a_word": F.col("_marks") / n,
        "shouts_a_word": F.col("_shouts") / n,
        "digit_share": F.col("_digits") / chars,
        "words_a_line": n / F.greatest("_lines", F.lit(1.0)),
        "words": F.col("n_words").cast("double"),
    }).drop("_words", "_windows", "_lines", "_upper", "_marks", "_shouts", "_digits")


FEATURES = ("symbols_a_word", "repeated_share", "dup_lines_share", "word_length", "upper_share", "marks_a_word", "shouts_a_word", "digit_share", "words_a_line", "words")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


class Rule(list):
    """A conjunction of (feature, above, threshold): feature >= threshold, or < where above is false."""

    def expression(self) -> Column:
        out = F.lit(True)
        for feature, above, threshold in self:
            out = out & ((F.col(feature) >= threshold) if above else (F.col(feature) < threshold))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{f} {'>=' if up else '<'} {t:.6g}" for f, up, t in self)


def _bin(feature: str, cuts: list[float]) -> Column:
    """How many of the ascending cuts a value reaches."""
    value = F.col(feature)
    return F.size(F.filter(F.array(*[F.lit(float(t)) for t in cuts]), lambda t: t <= value))


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def learn_rules(stats: DataFrame, bad: Column, max_rules: int = 8, max_tests: int = 4, precision: float = 0.95, least: int = 3, bins: int = 32) -> list[Rule]:
    """Ordered rules for rows to reject; stats: numeric FEATURES, bad: boolean label."""
    rows = stored(stats.select(*FEATURES, bad.alias("bad"), (F.pmod(F.xxhash64(*FEATURES), F.lit(3)) == 0).alias("prune")), "rule-rows")
    shares = [k / bins for k in range(1, bins)]
    cuts = {}
    found = rows.groupBy("bad").agg(*[F.percentile_approx(f, shares, 10_000).alias(f) for f in FEATURES]).collect()
    for f in FEATURES:
        cuts[f] = sorted({x for r in found for x in (r[f] or [])} | {math.nextafter(x, math.inf) for r in found for x in (r[f] or [])})
    if not any(cuts.values()):
        return []
    binned = F.array(*[F.struct(F.lit(k).alias("f"), _bin(f, cuts[f]).alias("bin")) for k, f in enumerate(FEATURES) if cuts[f]])
    rules: list[Rule] = []
    while len(rules) < max_rules:
        left = rows
        for rule in rules:
            left = left.where(~rule.expression())
        rule, p0, n0 = Rule(), 0, 0
        while len(rule) < max_tests:
            counts = left.where(~F.col("prune") & rule.expression()).select("bad", F.explode(binned).alias("x")).groupBy("x.f", "x.bin").agg(F.sum(F.col("bad").cast("int")).alias("p"), F.sum((~F.col("bad")).cast("int")).alias("n")).collect()
            table_ = {f: {r["bin"]: (r["p"], r["n"]) for r in counts if r["f"] == k} for k, f in enumerate(FEATURES)}
            p0, n0 = (sum(v[i] for v in next((t for t in table_.values() if t), {}).values()) for i in (0, 1))
            if p0 < least or n0 == 0:
                break
            best = (0.0, None)
            for f, by_bin in table_.items():
                p = n = 0
                for k, t in enumerate(cuts[f]):  # bins up to k lie below cuts[k]
                    p, n = p + by_bin.get(k, (0, 0))[0], n + by_bin.get(k, (0, 0))[1]
                    for above, (pp, nn) in ((True, (p0 - p, n0 - n)), (False, (p, n))):
                        if pp >= least and (g := _gain(pp, nn, p0, n0)) > best[0] + 1e-9:
                            best = (g, (f, above, t))
            if best[1] is None:
                break
            rule.append(best[1])
        if not rule:
            break
        # prune: the shortest beginning of the rule that is worth most on rows it was not grown on
        cut = left.where("prune").agg(*[F.sum((Rule(rule[:k]).expression() & (F.col("bad") == flag)).cast("int")).alias(f"{kind}{k}") for k in range(1, len(rule) + 1) for kind, flag in (("p", True), ("n", False))]).first()
        worth = [((cut[f"p{k}"] or 0) - (cut[f"n{k}"] or 0)) / max(1, (cut[f"p{k}"] or 0) + (cut[f"n{k}"] or 0)) for k in range(1, len(rule) + 1)]
        k = max(range(len(rule)), key=lambda i: (worth[i], -i))
        if worth[k] < 2 * precision - 1:
            break
        rules.append(Rule(rule[: k + 1]))
    return rules


def decision(rules: list[Rule]) -> Column:
    """keep, from ordered conditional expressions; 0 is no rule."""
    out = F.when(base_failed(), F.lit(-1))
    for k, rule in enumerate(rules, 1):
        out = out.when(rule.expression(), F.lit(k))
    return out.otherwise(F.lit(0))


def learned_rules(docs: DataFrame, labels: DataFrame, max_rows: int = 6000) -> list[Rule]:
    """Rules of a sample of at most max_rows labelled rows, by hash; labels: (doc_id, quality), 1 is good."""
    known = labels.where("quality is not null and doc_id is not null").select("doc_id", "quality").dropDuplicates(["doc_id"])
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # max_rows bounds it
    rows = statistics(stored(texts, "sample"))  # stored, or the filter below would have all documents' statistics computed before the join
    return learn_rules(rows.where(~base_failed()), F.col("quality") == 0)


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The input with the statistics, base_failed, rule (0: none, -1: base) and kept."""
    return statistics(docs).withColumn("base_failed", base_failed()).withColumn("rule", decision(rules)).withColumn("kept", F.col("rule") == 0)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = learned_rules(docs, table(spark, sf_dir, "labels"))
    return judged(docs.select("doc_id", "text"), rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
