"""The stages of the pipeline against brute force, each on what the one before kept."""

from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from conftest import SMALL
from test_minhash import brute
from test_rules import filled

from driftmap.llm import quality


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SMALL).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stage_by_stage(spark, stages):
    docs, good, exact, near, mixed, packed = stages
    assert all(s.columns == docs.columns for s in (good, exact, near, mixed))
    kept = {i for i, r in rows(docs).items() for m in [quality.measure(r.text)] if not (m[0] < 50 or 100 * m[4] > 50 * m[0] or m[6] > 0.3 * m[0] or m[7] > 60)}
    assert set(rows(good)) == kept
    last = {}
    for i, r in rows(good).items():
        last[r.text] = max(i, last.get(r.text, i))
    assert set(rows(exact)) == set(last.values())
    groups = brute([(i, r.text) for i, r in rows(exact).items()], 5, 80, 100)
    assert set(rows(near)) == {c for _, c in groups.values()}
    size = Counter()
    for r in near.collect():
        size[r.source] += len(r.text.split())
    taken = Counter()
    for r in mixed.collect():
        taken[r.source] += len(r.text.split())
    longest = max(len(r.text.split()) for r in near.collect())
    for source, target in filled(size).items():
        assert abs(taken[source] - target) <= longest
    times = Counter(r.doc_id for r in mixed.select("doc_id").collect())
    assert max(times.values()) <= 3
    pieces = packed.toPandas()
    assert Counter(pieces[pieces.piece == 0].doc_id.tolist()) == times
    assert pieces.groupby("sequence_id").length.sum().max() <= 1024


def test_run_gives_the_last_stage(spark, stages):
    out = corpus_pipeline.run(spark, SMALL)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(out.select(key).collect()) == sorted(stages[-1].select(key).collect())
    assert corpus_pipeline.ORACLE_SQL is None


def test_packing_stage_searches_large_fields_as_long_as_small_ones(spark):
    draw, sizes = np.random.default_rng(4), []
    for _ in range(1500):
        a = int(draw.integers(390, 510))
        b = int(draw.integers((1024 - a) // 2 - 100, (1024 - a) // 2))
        sizes += [a, b, 1024 - a - b]
    docs = spark.createDataFrame([(k, " a" * (n - 1)) for k, n in enumerate(sizes)], "doc_id long, text string")
    out = corpus_pipeline.packed_sequences(spark, docs, "").toPandas().sort_values("doc_id")
    assert out.length.tolist() == sizes and out.groupby("sequence_id").length.sum().max() <= 1024
    assert out.sequence_id.nunique() <= 1.0135 * 1500
