"""Odd tables: nulls everywhere, empty and long texts, ties, repeated rows, no rows, clashing columns."""

import pytest
from pyspark.sql import functions as F

from driftmap.llm import exact_dedup, minhash, mixing, packing, pii, quality, secret_scan, tokens, toxicity, url_filter
from driftmap.llm.scratch import new_path

LONG = "word " * 30_000
ROWS = [
    (1, "same text here for all", "b"), (2, "same text here for all", None), (2, "same text here for all", None),
    (3, None, "a"), (4, "", "a"), (5, " \n\t ", "b"), (6, LONG, "a"), (7, "short", None), (None, "no id", "a"), (None, None, None),
    (8, "naïve café 日本語 👍 a@b.co token=abcdef12", "c"),
]
CLASHING = ["id", "len", "head", "kept", "body", "rep", "component", "taken", "size", "n_words", "k", "t", "__own", "__copy", "__group", "__n_words", "blob", "path", "toxic", "features"]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    for c in CLASHING:
        df = df.withColumn(c, F.lit("x"))
    return df.cache()


def operators(spark):
    ledger = lambda: new_path(spark, "ledger")

    def scanned(df):
        path = ledger()
        return secret_scan.report(secret_scan.update(df, path, "doc_id", "text"), path)

    return {
        "refine": exact_dedup.refine,
        "near": minhash.near_duplicates,
        "tokens": tokens.token_digest,
        "judge": quality.judge,
        "pii": pii.detect,
        "secrets": scanned,
        "mix": mixing.mix,
        "toxicity": lambda df: toxicity.score(df, toxicity.Model({"short": 1.0}, 0.0)),
    }


@pytest.mark.parametrize("name", ["refine", "near", "tokens", "judge", "pii", "secrets", "mix", "toxicity"])
def test_one_row_for_each_row(spark, odd, name):
    run = operators(spark)[name]
    assert run(odd).count() == len(ROWS)
    assert run(odd.limit(0)).count() == 0


def test_filters_keep_columns(spark, odd):
    for keep in (quality.keep_good, exact_dedup.drop_duplicates, minhash.drop_near_duplicates, mixing.repeat_rows, pii.redact):
        out = keep(odd)
        assert out.columns == odd.columns, keep
        assert out.count() <= 3 * len(ROWS)
        assert keep(odd.limit(0)).count() == 0


def test_exact_duplicates_of_odd_rows(spark, odd):
    got = sorted(((r.id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.refine(odd).collect()), key=repr)
    want = {}
    for i, t, _ in ROWS:
        want.setdefault(t or "", []).append(i)
    expect = []
    for i, t, _ in ROWS:
        ids = [x for x in want[t or ""] if x is not None]
        top = max(ids) if ids else None
        expect.append((i, top, len(want[t or ""]), i == top))
    assert got == sorted(expect, key=repr)
    kept = exact_dedup.drop_duplicates(odd).select("doc_id", "text").collect()
    assert len(kept) == len({(t or "") for _, t, _ in ROWS})


def test_same_id_with_other_texts(spark):
    df = spark.createDataFrame([(5, "a"), (5, "b"), (9, "b")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in exact_dedup.drop_duplicates(df).collect()) == [(5, "a"), (9, "b")]


def test_empty_sets_are_linked_with_nothing(spark, odd):
    got = [(r.id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(odd, shingle=3, threshold=(85, 100)).collect()]
    by = {g[0]: g for g in got if g[0] is not None}
    assert by[3] == (3, 0, 3, True) and by[4] == (4, 0, 4, True) and by[5] == (5, 0, 5, True)
    assert by[1] == (1, 3, 1, True) and by[2] == (2, 3, 1, False)
    assert by[7] == (7, 1, 7, True) and by[6] == (6, 1, 6, True)


def test_rows_without_ids_are_linked_each(spark):
    words = [f"w{k}" for k in range(60)]
    one, near, other = " ".join(words), " ".join(words[:59]), " ".join(f"v{k}" for k in range(60))
    rows = [(7, one, 1), (None, one, 2), (None, near, 3), (None, other, 4), (None, other, 5), (None, None, 6), (None, "", 7), (9, other + " x y", 8), (None, "quite alone here", 9)]
    kept = {r.row for r in minhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, row int")).collect()}
    assert kept == {1, 6, 7, 8, 9}


def test_packing_odd_rows(spark, odd):
    out = packing.pack_documents(odd).toPandas()
    assert out[out.piece == 0].shape[0] == len(ROWS)
    assert out.groupby("sequence_id").length.sum().max() <= 1024
    assert packing.pack_documents(odd.limit(0)).count() == 0


def test_pages_without_urls(spark):
    df = spark.createDataFrame([(1, None, None), (2, "no scheme", ""), (3, "http://A.Org", "<p>x"), (None, "x://", None)], "page_id long, url string, html string").withColumn("host", F.lit("x")).withColumn("bad", F.lit("x"))
    got = {r.id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df).collect()}
    assert got[1][:3] == ("", "", None) and got[2][:3] == ("", "", None)
    assert got[3][:3] == ("a.org", "", None)
    assert len(got) == 4 and url_filter.judge(df.limit(0)).count() == 0


def test_toxicity_without_labels(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(odd, toxicity.fit(odd, labels)).collect()} == {0.5}
    some = spark.createDataFrame([(1, None), (None, 1), (7, 0), (7, 0)], "doc_id long, toxic int")
    assert toxicity.score(odd, toxicity.fit(odd, some)).count() == len(ROWS)
    clash = some.withColumn("id", F.lit("x")).withColumn("body", F.lit("x"))
    assert {r.score for r in toxicity.score(odd, toxicity.fit(odd.limit(0), clash)).collect()} == {0.5}


def test_rows_of_a_missing_id_spread(spark, tmp_path):
    df = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("one two three "), F.col("id").cast("string")).alias("text"), F.lit("a").alias("source"))
    shards = mixing.mix(df, shard_words=2000).groupBy("shard").count().collect()
    assert len(shards) == 8 and max(r["count"] for r in shards) < 1000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tokens.write_tokens(df, f"file://{tmp_path}/t")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = [r.n for r in spark.read.parquet(f"{tmp_path}/t/blocks").groupBy("part").agg(F.sum("n_ids").alias("n")).collect()]
    assert len(parts) == 4 and max(parts) < 0.4 * sum(parts)


def test_exact_duplicates_beyond_a_broadcast(spark, odd, monkeypatch):
    want = sorted((r.id or -1, r.keep_id or -1, r.group_size, r.kept, r.stage) for r in exact_dedup.refine(odd).collect())
    kept = sorted((r.doc_id or -1, r.text or "") for r in exact_dedup.drop_duplicates(odd).collect())
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", 0)
    for unique in (False, True):
        got = exact_dedup.refine(odd, hash_unique=unique)
        assert sorted((r.id or -1, r.keep_id or -1, r.group_size, r.kept, r.stage) for r in got.collect()) == want
        assert got.where("content_hash is null").count() == (0 if unique else sum(w[4] != "content" for w in want))
    assert sorted((r.doc_id or -1, r.text or "") for r in exact_dedup.drop_duplicates(odd).collect()) == kept
