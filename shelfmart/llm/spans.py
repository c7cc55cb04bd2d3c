"""Places of pattern matches in a text, as DataFrame expressions.

A match's start follows from the lengths of the pieces between matches: `split` and `regexp_extract_all` walk a text in
the same way, leftmost first and without overlaps. Places count code points, the end is exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

SPAN = "array<struct<kind:int,start:int,end:int,value:string>>"


def spans(
    text: Column, kind: int, pattern: str, keep: Callable[[Column], Column], possible: Column | None = None
) -> Column:
    """Matches of `pattern` whose text passes `keep`, as an array of (kind, start, end, value); a text without matches
    gives an empty array. `keep` judges the matched text alone. `possible` is a cheap condition that every text with a
    match meets."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    steps = F.arrays_zip(gaps.alias("gap"), found.alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin, value = acc["at"] + x["gap"], x["value"]
        end = begin + F.coalesce(F.length(value), F.lit(0))
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), value.alias("value"))
        # the last gap has no match behind it
        return F.struct(
            end.alias("at"),
            F.when(F.coalesce(value.isNotNull() & keep(value), F.lit(False)), F.concat(acc["out"], F.array(span)))
            .otherwise(acc["out"])
            .alias("out"),
        )

    walked = F.aggregate(steps, start, step, lambda acc: acc["out"])
    return F.when(F.rlike(text, F.lit(pattern)) if possible is None else possible, walked).otherwise(F.array().cast(SPAN))


def joined(found: Column, names: list[str]) -> Column:
    """`kind:start:end` of every span, comma-joined in the array's order."""
    label = F.array(*[F.lit(name) for name in names])
    parts = F.transform(found, lambda s: F.concat_ws(":", F.get(label, s["kind"]), s["start"], s["end"]))
    return F.array_join(parts, ",")


def count_of(found: Column, kind: int) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")
