"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame functions only.

Targets are water-filled: sources share the whole by weight, none above
``max_repeats`` times its own size. The whole is cut into equal blocks of
words; blocks go to sources, and each source's blocks to its shards, by the
highest quotients ``votes / (2 * seats + 1)``. A shard is a bounded slice of a
source (dealt by a seeded hash), so a source with a third of all rows spreads
over many tasks. Within a shard the documents stand in a seeded order, their
words form a stream that may be read up to ``max_repeats`` times, and the
shard takes the first blocks of that stream up to its quota.

Defined results: a null or empty text has size 0 and takes nothing; a null
source is a source of its own, ordered last; repeated rows count each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import free, materialise

WORD = r"[^\x20\x09-\x0D]+"


def apportion(parties: DataFrame, group: list[str], key: str, votes: str, total: Column) -> DataFrame:
    """Sainte-Laguë: add ``seats`` (long) to ``parties``.

    Within each ``group``, ``total`` seats go to the highest quotients
    ``votes / (2k + 1)``; ties go to the smaller ``key``, nulls last. Two
    divisors bracket the answer, so at most a few candidate seats per party are
    ranked, whatever the total.
    """
    g = W.partitionBy(*[F.col(c) for c in group]) if group else W.partitionBy(F.lit(1))
    s = parties.withColumn("__t", total.cast("long")).withColumn("__s", F.count(F.lit(1)).over(g)).withColumn("__v", F.sum(F.col(votes).cast("double")).over(g))
    share = lambda shift: F.when(F.col("__v") > 0, F.floor(F.col(votes).cast("double") * shift / F.col("__v") + 0.5)).otherwise(0).cast("long")
    s = s.withColumn("__lo", F.when(F.col("__t") > F.col("__s"), share(F.col("__t") - F.col("__s"))).otherwise(0).cast("long"))
    s = s.withColumn("__hi", share(F.col("__t") + F.col("__s")))
    s = s.withColumn("__rest", F.col("__t") - F.sum("__lo").over(g))
    seats = s.select("*", F.explode(F.sequence("__lo", "__hi")).alias("__k"))
    order = g.orderBy((F.col(votes).cast("double") / (2 * F.col("__k") + 1)).desc(), F.col(key).asc_nulls_last(), F.col("__k"))
    won = seats.withColumn("__rank", F.row_number().over(order))
    extra = F.sum(F.when((F.col("__rank") <= F.col("__rest")) & (F.col("__v") > 0), 1).otherwise(0))
    cols = parties.columns
    return won.groupBy(*cols, "__lo").agg(extra.alias("__x")).select(*cols, (F.col("__lo") + F.col("__x")).alias("seats"))


def plan_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeats: int = 3) -> DataFrame:
    """``source, source_size, target``: the water-filled share of each source.

    Sources in code point order, null last, carry ``weights`` in turn. The work
    is one row per source.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    one = W.partitionBy(F.lit(1))
    rank = F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (rank % len(weights) + 1).cast("int"))
    s = s.withColumn("w", w.cast("decimal(18,0)")).withColumn("cap", (F.col("source_size") * max_repeats).cast("decimal(18,0)"))
    s = s.withColumn("total", F.sum("source_size").over(one).cast("decimal(18,0)"))
    order = one.orderBy((F.col("cap").cast("double") / F.col("w").cast("double")), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    s = s.withColumn("left", F.col("total") - F.sum("cap").over(order) + F.col("cap")).withColumn("open_w", F.sum("w").over(one) - F.sum("w").over(order) + F.col("w"))
    s = s.withColumn("full", F.col("cap") * F.col("open_w") <= F.col("left") * F.col("w"))
    level = (F.col("total") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(one)).cast("double") / F.sum(F.when(~F.col("full"), F.col("w")).otherwise(0)).over(one).cast("double")
    s = s.withColumn("level", F.when(F.sum(F.when(~F.col("full"), 1).otherwise(0)).over(one) > 0, level))
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("w").cast("double"))
    return s.select("source", "source_size", target.alias("target"), F.col("total").cast("long").alias("total"))


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    max_repeats: int = 3,
    block_words: int = 32,
    shard_words: int = 250_000,
    max_shards: int = 10_000,
    seed: int = 7,
) -> DataFrame:
    """One row per input row: ``id, source, size, source_size, target, shard, quota, taken``.

    Shards have about ``shard_words`` words, more once that would make over
    ``max_shards`` of them. ``quota`` is the number of blocks of the row's shard and ``taken`` the
    words of the row that the mix takes, repeats counted, at most
    ``max_repeats * size``.
    """
    # id and text, so that rows which share an id, or have none, spread over the shards
    doc = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.md5(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"))))
    rows = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size"), doc.alias("draw"))
    rows = materialise(rows, "mix-sizes")
    targets = plan_targets(rows, weights, max_repeats)
    blocks = F.floor(F.col("total").cast("double") / block_words + 0.5)
    sources = materialise(apportion(targets, [], "source", "target", blocks).withColumnRenamed("seats", "source_quota").withColumn("n_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.greatest(F.lit(float(shard_words)), F.col("total") / max_shards)))), "mix-sources")
    r, s = rows.alias("r"), sources.alias("s")
    dealt = r.join(s, F.col("r.source").eqNullSafe(F.col("s.source"))).select("r.*", "s.source_size", "s.target", "s.source_quota", F.pmod(F.conv(F.substring("r.draw", 1, 8), 16, 10).cast("long"), F.col("s.n_shards")).alias("shard"))
    shards = dealt.groupBy("source", "shard", "source_quota").agg(F.sum("size").alias("shard_size"))
    quotas = materialise(apportion(shards, ["source"], "shard", "shard_size", F.col("source_quota")), "mix-shards")
    d, q = dealt.alias("d"), quotas.alias("q")
    full = d.join(q, F.col("d.source").eqNullSafe(F.col("q.source")) & (F.col("d.shard") == F.col("q.shard"))).select("d.*", "q.shard_size", F.col("q.seats").alias("quota"))
    stream = W.partitionBy("source", "shard").orderBy("draw", "id", "size").rowsBetween(W.unboundedPreceding, 0)
    full = full.withColumn("begins", F.sum("size").over(stream) - F.col("size")).withColumn("words", F.least(F.col("quota") * block_words, F.col("shard_size") * max_repeats))
    rounds = F.when(F.col("shard_size") > 0, F.floor(F.col("words") / F.col("shard_size"))).otherwise(0)
    rest = F.col("words") - F.col("rounds") * F.col("shard_size")
    full = full.withColumn("rounds", rounds.cast("long"))
    taken = F.col("rounds") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("begins")))
    return full.select("id", "source", "size", "source_size", "target", "shard", "quota", taken.cast("long").alias("taken"))


def repeat_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed corpus: each row of ``df`` as many times as the mix takes it.

    ``taken / size`` is rounded to whole documents; at most two documents of a
    shard stand on a block border. Columns are those of ``df``. Rows that share
    an id take the mean of their counts.
    """
    plan = mix(df, id_col, text_col, source_col, **options)
    copy = free(df, "__copy")
    times = plan.groupBy("id").agg(F.floor(F.sum("taken") / F.greatest(F.sum("size"), F.lit(1)) + 0.5).cast("int").alias("times")).where("times > 0")
    out = df.alias("t").join(times.alias("m"), F.col(f"t.{id_col}").eqNullSafe(F.col("m.id"))).select("t.*", F.explode(F.sequence(F.lit(1), F.col("m.times"))).alias(copy))
    return out.drop(copy)
