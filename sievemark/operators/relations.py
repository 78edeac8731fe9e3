"""Spans as rows: joins and windows over tables of (doc_id, start, end).

Offsets are characters, from 0, half-open. Everything that asks for "the nearest", "any" or "a run of" is one
shuffle by document and one sort, whatever stands in a document: as-of joins, coverage and islands
are windows with running values, never pairs. Only `overlapping_pairs` gives pairs, and its work is that of its result and
a bounded number of placements for each span.

A document's rows fit into one task, as its text fits into one row. Rows without an id belong to no
document: they have no neighbours. Rows that repeat an id are taken together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spans import spans

DOC = ("doc_id",)
#: What words and sentence ends are; the engine's patterns are read with letters of any alphabet.
WORD_OR_END = r"\p{L}+(?:-\p{L}+)*|\d+|[.!?\n]"
#: The smallest span of positions that pairs are looked for in.
CELL = 64


def _known(by) -> Column:
    out = F.lit(True)
    for c in by:
        out = out & F.col(c).isNotNull()
    return out


def found_spans(docs: DataFrame, pattern: str, by=DOC, text_col: str = "text") -> DataFrame:
    """(by, start, end, value) of all matches."""
    each = docs.select(*by, F.explode(spans(F.col(text_col).cast("string"), pattern)).alias("_s"))
    return each.select(*by, "_s.start", "_s.end", "_s.value")


def words(docs: DataFrame, by=DOC, text_col: str = "text") -> DataFrame:
    """(by, start, end, word, sentence): words and numbers, numbered sentences from 0; a sentence ends at . ! ? or a line's end."""
    tokens = found_spans(docs, WORD_OR_END, by, text_col)
    ends = F.col("value").rlike(r"^[.!?\n]$")
    before = Window.partitionBy(*by).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    numbered = tokens.withColumn("sentence", F.coalesce(F.sum(ends.cast("int")).over(before), F.lit(0)).cast("long"))
    return numbered.where(~ends).select(*by, "start", "end", F.col("value").alias("word"), "sentence")


def _merged_events(rows: DataFrame, marks: DataFrame, by, at: Column, mark_at: Column, mark: Column, marks_first: bool) -> DataFrame:
    """Rows and marks in one table: by, _at, _turn, _row, _mark."""
    kind = rows.select(F.struct(*rows.columns).alias("_row")).schema["_row"].dataType
    own = rows.select(*by, at.alias("_at"), F.lit(1).alias("_turn"), F.struct(*[F.col(c) for c in rows.columns]).alias("_row"))
    told = marks.select(*by, mark_at.alias("_at"), F.lit(0 if marks_first else 2).alias("_turn"), F.lit(None).cast(kind).alias("_row"), mark.alias("_mark"))
    return own.withColumn("_mark", F.lit(None).cast(told.schema["_mark"].dataType)).unionByName(told)


def _own_row(rows: DataFrame, by) -> list[Column]:
    """The columns of rows out of _row; by as they stand beside it, so that rows are known to lie together by them."""
    return [F.col(c) if c in by else F.col("_row")[c].alias(c) for c in rows.columns]


def nearest_left(rows: DataFrame, marks: DataFrame, carry: list[str], within: int | None = None, by=DOC, name: str = "mark", at: str = "start", mark_at: str = "end") -> DataFrame:
    """As-of join: rows with a struct of the columns carry and mark_at of the last mark that ends at or before the row's start.

    Null where there is none or it ends more than within characters before. Of marks that end at one place
    the one with the largest carry counts.
    """
    both = _merged_events(rows, marks, by, F.col(at), F.col(mark_at), F.struct(*carry, F.col(mark_at).alias("mark_at")), True)
    upto = Window.partitionBy(*by).orderBy("_at", "_turn", "_mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn("_mark", F.last("_mark", ignorenulls=True).over(upto)).where("_turn = 1")
    near = _known(by) if within is None else _known(by) & (F.col("_at") - F.col("_mark.mark_at") <= within)
    return out.select(*_own_row(rows, by), F.when(near, F.col("_mark")).alias(name))


def covered(rows: DataFrame, others: DataFrame, how: str = "overlaps", by=DOC, name: str = "covered") -> DataFrame:
    """rows with whether any of the others overlaps them, or (how="inside") holds them whole.

    Of the spans that begin early enough the furthest end decides, so a running maximum does it.
    """
    if how not in ("overlaps", "inside"):
        raise ValueError(how)
    inside = how == "inside"
    both = _merged_events(rows, others.where("end > start"), by, F.col("start") if inside else F.col("end"), F.col("start"), F.col("end").alias("_mark"), inside)
    upto = Window.partitionBy(*by).orderBy("_at", "_turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    furthest = F.max("_mark").over(upto)
    test = furthest >= F.col("_row.end") if inside else (furthest > F.col("_row.start")) & (F.col("_row.end") > F.col("_row.start"))
    return both.withColumn("_covered", F.coalesce(test & _known(by), F.lit(False))).where("_turn = 1").select(*_own_row(rows, by), F.col("_covered").alias(name))


def outside(rows: DataFrame, others: DataFrame, how: str = "overlaps", by=DOC) -> DataFrame:
    """Anti-join: the rows that no other span overlaps (or holds)."""
    return covered(rows, others, how, by, "_covers").where("not _covers").drop("_covers")


def with_islands(rows: DataFrame, gap: int = 0, by=DOC) -> DataFrame:
    """rows with island (from 1), island_start, island_end: runs of spans of which each begins at most gap characters after the furthest end before it.

    With gap 0 spans that touch form one run; a span inside another, ended long before, still belongs to its run.
    """
    order = Window.partitionBy(*by).orderBy("start", F.desc("end"))
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(before.isNull() | (F.col("start") > before + gap), 1).otherwise(0)
    # rows without an id are runs of their own
    first = rows.withColumn("_begins", F.when(_known(by), begins).otherwise(1))
    numbered = first.withColumn("island", F.sum("_begins").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("long")).drop("_begins")
    whole = Window.partitionBy(*by, "island")
    return numbered.withColumns({"island_start": F.min("start").over(whole), "island_end": F.max("end").over(whole)})


def islands(rows: DataFrame, gap: int = 0, by=DOC, **aggregates: Column) -> DataFrame:
    """(by, island, start, end, n, and the aggregates) of every run."""
    runs = with_islands(rows, gap, by)
    return runs.groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"), *[c.alias(k) for k, c in aggregates.items()])


def with_sentences(rows: DataFrame, docs: DataFrame, ends: str = r"[.!?\n]", by=DOC, text_col: str = "text") -> DataFrame:
    """rows with sentence: how many ends stand before their start."""
    stops = found_spans(docs, ends, by, text_col)
    both = _merged_events(rows, stops, by, F.col("start"), F.col("end"), F.lit(1).alias("_mark"), True)
    upto = Window.partitionBy(*by).orderBy("_at", "_turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("_n", F.count("_mark").over(upto)).where("_turn = 1").select(*_own_row(rows, by), F.when(_known(by), F.col("_n")).alias("sentence"))


def beside(rows: DataFrame, test: Column, by=DOC, name: str = "beside") -> DataFrame:
    """rows with whether another row of their document and sentence passes the test."""
    whole = Window.partitionBy(*by, "sentence")
    passes = F.coalesce(test, F.lit(False)).cast("int")
    return rows.withColumn(name, F.when(_known(by), F.sum(passes).over(whole) - passes > 0).otherwise(False))


def _placements(rows: DataFrame, levels: DataFrame, by, cell: int) -> DataFrame:
    """A span at its own level, where it has at most two cells, and at each coarser level that the other side has."""
    own = F.floor((F.greatest(F.col("end") - F.col("start"), F.lit(1)) - 1) / cell).cast("long")
    level = F.when(own == 0, 0).otherwise(F.length(F.bin(own)))
    placed = rows.select(*by, F.struct(*rows.columns).alias("_row"), F.col("start").alias("_start"), F.col("end").alias("_end"), level.alias("_own")).join(levels, list(by))
    each = placed.withColumn("_level", F.explode(F.array_union(F.array("_own"), F.filter("_levels", lambda x: x > F.col("_own")))))
    width = F.call_function("shiftleft", F.lit(cell).cast("long"), F.col("_level"))
    each = each.withColumns({"_first": F.floor(F.col("_start") / width), "_last": F.floor((F.greatest(F.col("_end"), F.col("_start") + 1) - 1) / width)})
    return each.withColumn("_cell", F.explode(F.sequence("_first", "_last")))


def _levels(rows: DataFrame, by, cell: int) -> DataFrame:
    own = F.floor((F.greatest(F.col("end") - F.col("start"), F.lit(1)) - 1) / cell).cast("long")
    return rows.groupBy(*by).agg(F.collect_set(F.when(own == 0, 0).otherwise(F.length(F.bin(own)))).alias("_levels"))


def overlapping_pairs(left: DataFrame, right: DataFrame, by=DOC, cell: int = CELL) -> DataFrame:
    """(by, left, right): structs of all pairs of overlapping spans, each once.

    Spans are placed in cells as wide as they are long, up to a factor of two, and a pair meets at the level of
    the longer one, in the first cell that both have. So a long span is not cut into many cells, and the rows
    that meet in a cell are those of a stretch of text not longer than the cell.
    """
    a = _placements(left, _levels(right, by, cell), by, cell).select(*by, "_level", "_cell", F.col("_row").alias("left"), *[F.col(c).alias(f"{c}_a") for c in ("_own", "_first", "_start", "_end")])
    b = _placements(right, _levels(left, by, cell), by, cell).select(*by, "_level", "_cell", F.col("_row").alias("right"), *[F.col(c).alias(f"{c}_b") for c in ("_own", "_first", "_start", "_end")])
    met = a.join(b, [*by, "_level", "_cell"])
    met = met.where((F.greatest("_own_a", "_own_b") == F.col("_level")) & (F.greatest("_first_a", "_first_b") == F.col("_cell")) & (F.col("_start_a") < F.col("_end_b")) & (F.col("_start_b") < F.col("_end_a")))
    return met.select(*by, "left", "right")
