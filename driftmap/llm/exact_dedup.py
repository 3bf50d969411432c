"""Exact duplicates by progressive refinement, in DataFrame functions only.

Rows are grouped by byte length, survivors by a hash of their first
characters, and only rows that still share both with another row have their
whole content hashed. Every grouping is a partial aggregate over narrow rows,
so a group holding a third of all rows is pre-reduced in each map task. Counts
are written before rows join them, so that both sides of a join are plain
exchanges and Spark can split a hot key.

With ``hash_unique`` every row's hash is asked for, so it is taken in the scan
that also gives length and prefix, and no text is shuffled at all. Without it,
the second scan meets the open groups by a broadcast while they are at most
``BROADCAST_ROWS``, counted, and by an exchange beyond that.

Defined results: a null text counts as empty; empty texts equal one another; a
null id loses to any other id; rows that repeat id and text are all reported
(``kept`` is true on each row carrying the kept id, and ``drop_duplicates``
leaves one of them). Other columns are ignored, so their names cannot clash.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import free, materialise

#: Narrow rows up to which a counted table is broadcast; of at most 100 bytes each.
BROADCAST_ROWS = 200_000


def _content(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def _digest(body: Column) -> Column:
    return F.sha2(F.encode(body, "UTF-8"), 256)


def _small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it is counted as small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def refine(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 256, hash_unique: bool = False) -> DataFrame:
    """One row per input row: ``id, keep_id, group_size, kept, content_hash, stage``.

    ``stage`` names the refinement at which the row was found to be unique
    (``length`` or ``prefix``), or ``content`` if its text was compared in full.
    ``content_hash`` (SHA-256 hex) is null for rows settled earlier unless
    ``hash_unique`` asks for it.
    """
    base = df.select(F.col(id_col).alias("id"), _content(text_col).alias("body"))
    base = base.withColumn("len", F.octet_length("body")).withColumn("head", F.xxhash64(F.substring("body", 1, prefix_chars)))
    # the grouping below needs 32 bytes of a hash, not its 64 letters
    narrow = materialise(base.select("id", "len", "head", *([F.unhex(_digest(F.col("body"))).alias("digest")] if hash_unique else [])), "refine-narrow")
    by_length = materialise(narrow.groupBy("len").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("len", F.lit(True).alias("same_len")), "refine-lengths")
    same_len = narrow.join(_small(by_length.select("len")), "len", "left_semi")
    by_head = materialise(same_len.groupBy("len", "head").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("len", "head", F.lit(True).alias("same_head")), "refine-heads")
    heads, lengths = _small(by_head), _small(by_length)
    rows = narrow if hash_unique else base
    if not hash_unique:
        # only rows of open groups have their content read
        open_rows = rows.join(heads.select("len", "head"), ["len", "head"], "left_semi")
        opened = materialise(open_rows.select("id", "len", "head", F.unhex(_digest(F.col("body"))).alias("digest")), "refine-hashed")
        rest = narrow.join(heads.select("len", "head"), ["len", "head"], "left_anti").withColumn("digest", F.lit(None).cast("binary"))
    else:
        flagged = rows.join(heads, ["len", "head"], "left")
        opened, rest = flagged.where("same_head").drop("same_head"), flagged.where("same_head is null").drop("same_head")
    rest = rest.join(lengths, "len", "left").select("id", "digest", F.when(F.col("same_len"), "prefix").otherwise("length").alias("stage"))
    groups = materialise(opened.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "refine-groups")
    found = opened.join(groups, "digest").select("id", "keep_id", "group_size", "digest", F.lit("content").alias("stage"))
    settled = rest.select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "digest", "stage")
    out = found.unionByName(settled)
    return out.select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("content_hash"), "stage")


def drop_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay: of equal texts the one with the largest id.

    Rows with the same id and the same text leave one row. Columns are those
    of ``df``. Rows of groups alone are looked up; all others stay as they are.
    """
    own, stays, once = free(df, "__own"), free(df, "__stays"), free(df, "__once")
    grouped = refine(df, id_col, text_col, hash_unique=True).where("group_size > 1")
    verdict = materialise(grouped.groupBy(F.col("id").alias("k_id"), F.unhex("content_hash").alias("k_own")).agg(F.max("kept").alias(stays), (F.count(F.lit(1)) == 1).alias(once)), "verdicts")
    t = df.withColumn(own, F.unhex(_digest(_content(text_col)))).alias("t")
    out = t.join(_small(verdict).alias("k"), F.col(f"t.{id_col}").eqNullSafe(F.col("k.k_id")) & (F.col(f"t.{own}") == F.col("k.k_own")), "left").select("t.*", f"k.{stays}", f"k.{once}")
    out = out.where(F.coalesce(stays, F.lit(True)))
    again = ~F.coalesce(F.col(once), F.lit(True))
    # rows of one id and one text: null and empty texts have the same hash
    return out.where(~again).unionByName(out.where(again).dropDuplicates([id_col, own])).select(*df.columns)
