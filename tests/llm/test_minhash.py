import random
from collections import Counter

import numpy as np
import pytest

from driftmap.llm import minhash
from driftmap.llm.components import components


def sets_of(text, k):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def brute(rows, k, num, den):
    sets = {i: sets_of(t, k) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(r, words, edits):
    out = list(words)
    for at in r.sample(range(len(out)), edits):
        out[at] = f"e{r.randrange(10**6)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def corpus():
    """A group of near copies of which some link only through others, copies in other case, and unrelated texts."""
    r = random.Random(5)
    base = [f"w{r.randrange(500)}" for _ in range(150)]
    texts = [edited(r, base, r.randrange(0, 12)) for _ in range(150)]
    texts += [t.upper() for t in texts[:20]]
    chain = list(base)
    for step in range(12):
        chain[step * 12 : step * 12 + 4] = [f"c{step}{k}" for k in range(4)]
        texts.append(" ".join(chain))
    texts += [" ".join(f"u{r.randrange(3000)}" for _ in range(r.randrange(1, 200))) for _ in range(100)]
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("k", "num", "tile"), [(3, 85, 512), (3, 85, 24), (5, 80, 40)])
def test_components_equal_brute_force(spark, corpus, k, num, tile):
    df = spark.createDataFrame(corpus, "doc_id long, text string").repartition(5)
    got = {r.id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, shingle=k, threshold=(num, 100), tile=tile).collect()}
    assert got == brute(corpus, k, num, 100)
    assert max(Counter(c for _, c in got.values()).values()) > 50


def test_a_text_is_unchanged_by_its_neighbours(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    kept = minhash.drop_near_duplicates(df, shingle=3, threshold=(85, 100))
    want = {c for _, c in brute(corpus, 3, 85, 100).values()}
    assert {r.doc_id for r in kept.collect()} == want


def test_circulant_signatures_estimate_similarity():
    r = np.random.default_rng(1)
    pool = r.integers(0, 2**63, 4000, dtype=np.uint64)
    a, b = np.unique(pool[:3000]), np.unique(pool[1000:4000])
    s = minhash.signatures([a, b], 256)
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.12
    # coordinate k is the second permutation, shifted circularly by k
    low = (minhash.scramble(a ^ minhash._M1) >> np.uint64(32)).astype(np.uint32)
    for k in (0, 1, 77):
        x = low + np.uint32(k)
        minhash.permute(x)
        assert x.min() == s[0][k]


def test_permutation_is_a_bijection_and_bands_suffice():
    x = np.arange(1 << 16, dtype=np.uint32) * np.uint32(65537)
    minhash.permute(x)
    assert len(np.unique(x)) == 1 << 16
    for t in (0.8, 0.85):
        bands, rows = minhash.plan_bands(t)
        assert (1 - t**rows) ** bands <= 1e-6


def test_distributed_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(200, 260)] + [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(5, 5)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in up}


def words(prefix, n=60):
    return " ".join(f"{prefix}{k}" for k in range(n))


def test_rows_of_one_id_pool_their_links(spark):
    a, b, c = words("a"), words("b"), words("c")
    df = spark.createDataFrame([(5, a), (5, b), (3, a), (4, b), (8, c), (9, c + " x"), (9, c)], "doc_id long, text string")
    got = sorted((r.id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect())
    assert got == [(3, 3, True), (4, 3, False), (5, 3, False), (5, 3, False), (8, 8, True), (9, 8, False), (9, 8, False)]
    apart = sorted((r.id, r.component_id) for r in minhash.near_duplicates(df, pool_ids=False).collect())
    assert apart == [(3, 3), (4, 4), (5, 3), (5, 4), (8, 8), (9, 8), (9, 8)]


@pytest.mark.parametrize("bits", [8, 1 << 26])
def test_one_row_of_each_component_stays(spark, monkeypatch, bits):
    monkeypatch.setattr(minhash, "FILTER_BITS", bits)  # with few bits, most rows pass the filter
    a, b, c = words("a"), words("b"), words("c")
    rows = [(1, a, 1), (None, a, 2), (7, b, 3), (7, b, 4), (7, c, 5), (None, None, 6), (None, "", 7), (None, words("d"), 8), (None, words("d"), 9), (7, " ", 10), (7, " ", 11)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int")
    kept = sorted(r.row for r in minhash.drop_near_duplicates(df).collect())
    assert [k for k in kept if k not in (3, 4, 8, 9)] == [1, 5, 6, 7, 10, 11]
    assert len(set(kept) & {3, 4}) == 1 and len(set(kept) & {8, 9}) == 1


def test_key_filter_misses_no_key(spark, monkeypatch):
    monkeypatch.setattr(minhash, "FILTER_BITS", 1 << 18)
    rows = spark.range(20000).selectExpr("id as bits", "xxhash64(id) as k")
    keys = rows.where("bits % 7 = 0").selectExpr("bits as at", "k as at_key")
    got = minhash._marked(rows, "bits", "k", keys, "hit").collect()
    assert len(got) == 20000
    assert all(r.hit for r in got if r.bits % 7 == 0)
    assert sum(r.hit for r in got if r.bits % 7) < 600  # 17143 * 2858 / 2 ** 18 = 187 by chance
    assert not any(r.hit for r in minhash._marked(rows, "bits", "k", keys.limit(0), "hit").collect())


def test_components_of_rows_without_ids(spark):
    df = spark.createDataFrame([(None, words("a")), (None, words("a") + " x"), (None, words("b")), (4, words("b") + " x")], "doc_id long, text string")
    got = sorted(((r.id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()), key=repr)
    assert got == [(4, 4, True), (None, 4, False), (None, None, True), (None, None, True)]


def test_tiles_are_bounded_in_shingles(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    got = {r.id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, shingle=3, threshold=(85, 100), tile_shingles=2000).collect()}
    assert got == brute(corpus, 3, 85, 100)
