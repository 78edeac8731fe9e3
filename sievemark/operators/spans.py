"""Places of all matches of a pattern without Python: matches, each with the gap before it, summed up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let
from ..plans.registry import java_pattern

SPAN = "array<struct<start:int,end:int,value:string>>"
#: Matches summed up at a time: within a run one by one, then run by run, so that dense texts stay near linear.
RUN = 64


def spans(text: Column, pattern: str, group: int = 0, java: bool = False) -> Column:
    """array<struct<start, end, value>> of the matches, in order, null if there are none; a group is the last part of its match."""
    p = pattern if java else java_pattern(pattern)
    whole = F.regexp_extract_all(text, F.lit(p), F.lit(0))
    upto = F.regexp_extract_all(text, F.lit(rf"\G(?s:.*?)(?:{p})"), F.lit(0))  # each from the end of the one before; split would compile its pattern for every text
    gaps = F.split(text, p, -1)  # where a match is empty, none follows it in upto

    def summed(run: Column) -> Column:
        return F.aggregate(run, F.array().cast("array<int>"), lambda a, n: F.array_append(a, F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)) + n))

    def ends(sizes: Column) -> Column:
        """Where each match ends: sums within runs, and what the runs before come to."""
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / RUN).cast("int")), lambda k: summed(F.slice(sizes, k * RUN + 1, F.lit(RUN))))
        begun = lambda r: F.aggregate(F.transform(r, lambda x: F.element_at(x, -1)), F.array(F.lit(0)), lambda a, n: F.array_append(a, F.element_at(a, -1) + n))
        shifted = lambda r, at: F.transform(r, lambda x, k: let(F.get(at, k), lambda before: F.transform(x, lambda n: n + before)))
        return let(runs, lambda r: let(begun(r), lambda at: F.flatten(shifted(r, at))))

    def found(matches: Column) -> Column:
        by_gaps = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, v: F.length(g) + F.length(v))
        sizes = F.when(F.array_contains(matches, ""), by_gaps).otherwise(F.transform(upto, F.length))
        out = F.zip_with(let(sizes, ends), matches, lambda end, v: F.struct((end - F.length(v)).alias("start"), end.alias("end"), v.alias("value")))
        if group:
            inner = F.transform(out, lambda s: F.struct(s["end"].alias("end"), F.regexp_extract(s["value"], p, group).alias("value")))
            out = F.transform(inner, lambda s: F.struct((s["end"] - F.length(s["value"])).alias("start"), s["end"].alias("end"), s["value"].alias("value")))
        return F.when(F.size(matches) > 0, out)

    return let(whole, found)
