"""Spans of pattern matches as array columns, in DataFrame functions only.

Matches come from ``regexp_extract_all`` and their places from the lengths of
what ``split`` leaves between them; both walk the text in the same way. Only
rows that have a match are split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,value:string>>"


def add_spans(df: DataFrame, name: str, text: str, pattern: str, guard: Column | None = None, group: int = 0) -> DataFrame:
    """Add column ``name``: spans of the leftmost non-overlapping matches, in code points, end exclusive.

    ``value`` is the text of ``group``. Rows where ``guard`` does not hold are
    not searched; it must hold wherever the pattern can match.
    """
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    df = df.withColumn("__found", found if guard is None else F.when(guard, found))
    gaps = F.split(F.col(text), pattern, -1)
    inner = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group)) if group else F.col("__found")
    parts = F.arrays_zip(F.slice(gaps, 1, F.size("__found")).alias("gap"), F.col("__found").alias("hit"), inner.alias("value"))
    parts = F.transform(parts, lambda p: F.struct(F.char_length(p["gap"]).alias("gap"), F.char_length(p["hit"]).alias("hit"), p["value"].alias("value")))
    start = F.struct(F.lit(0).alias("at"), F.expr(f"CAST(array() AS {SPAN})").alias("out"))
    merge = lambda acc, p: F.struct((acc["at"] + p["gap"] + p["hit"]).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + p["gap"]).alias("start"), (acc["at"] + p["gap"] + p["hit"]).alias("end"), p["value"].alias("value")))).alias("out"))
    spans = F.aggregate(parts, start, merge, lambda acc: acc["out"])
    return df.withColumn(name, F.when(F.size("__found") > 0, spans).otherwise(F.expr(f"CAST(array() AS {SPAN})"))).drop("__found")


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def written(spans: Column) -> Column:
    """``kind:start:end`` of an array of structs, comma-joined in its order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
