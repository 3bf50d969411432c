import cProfile
import functools
import pstats
import tracemalloc
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

from driftmap.llm import packing, tokens

ODD = ["", None, " ", "  ", " a", "a ", "a  b", "a \n b", "a\n\n b", "x\t y", "\n", "\n\n", "a\nb c\n", "don't it's 123 4567", "<|endoftext|> x", "日本語 テキスト", " \n ", "\u3000x", "end\n", "😀 yes", "a\x1c b", "a\x85 b\u2003c", "x!y z?! ##", "\x01 a", "\x02", "it's' ' 's", "ends.' x"]


@functools.cache
def fresh():
    """The library's tokenizer, as it is."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_tokenizer())


def check(encoder, texts):
    ids, lengths = encoder.encode(pa.array(texts, pa.string()))
    ends = np.cumsum(lengths)
    for text, end, n in zip(texts, ends, lengths):
        want = fresh().encode(text or "", add_special_tokens=False).ids
        assert list(ids[end - n : end]) == want, repr(text)


def test_odd_texts():
    encoder = tokens.TextEncoder(tokens.default_tokenizer())
    check(encoder, ODD)
    check(encoder, [None])
    assert encoder.encode(pa.array([], pa.string()))[0].size == 0


def test_added_tokens_are_those_of_the_library_as_it_is():
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(tokens.default_tokenizer())
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|>b c", "<|endoftext|", "one\n<|endoftext|>\ntwo", "x <|endoftext|>.", "plain words"]
    ids, lengths = tokens.TextEncoder(tokens.default_tokenizer()).encode(pa.array(texts))
    assert fresh.encode(texts[0], add_special_tokens=False).ids == [31373, 220, 50256, 995]
    got = [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])]
    assert got == [fresh.encode(t, add_special_tokens=False).ids for t in texts]


def test_control_characters_that_mark_pieces():
    check(tokens.TextEncoder(tokens.default_tokenizer()), ["a \x02b", "b", "\x02b", "a b", " \x02", "a\n\x02b \x01c", "\x02\x02b \x02"])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abcXYZéß日 \n\t.,'!19_-😀"), max_size=30), min_size=1, max_size=6))
def test_random_texts(texts):
    check(tokens.TextEncoder.shared(tokens.default_tokenizer()), texts)


def test_small_memory_gives_the_same_ids(monkeypatch, spark):
    monkeypatch.setattr(tokens, "MEMO_WORDS", 500)
    monkeypatch.setattr(tokens, "MEMO_PIECES", 500)
    encoder = tokens.TextEncoder(tokens.default_tokenizer())
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").limit(40).collect()]
    for lo in range(0, 40, 4):
        check(encoder, texts[lo : lo + 4])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=40))
def test_codes_round_trip(ranks):
    ranks = np.array(ranks, np.uint32)
    control, data = tokens.pack_ranks(ranks)
    assert len(control) == -(-len(ranks) // 4)
    back = tokens.unpack_ranks(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(ranks))
    assert (back == ranks).all()


def test_payload_keeps_documents_without_ids():
    payload = tokens.to_payload([None, 7, -1], np.array([1, 0, 2]), np.array([5, 300, 70000]))
    docs, lengths, ranks = tokens.from_payload(payload)
    assert docs == [None, 7, -1] and lengths.tolist() == [1, 0, 2] and ranks.tolist() == [5, 300, 70000]


def test_files_against_the_library(spark, monkeypatch):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    library = fresh()
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokens.token_digest(spark.read.parquet(f"{SMALL}/documents.parquet").repartition(3)).collect()}
    start = 0
    for doc, text in rows:
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert got[doc] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_more_frequent_ids_take_fewer_bytes(spark, tmp_path):
    out = f"{tmp_path}/tokens"
    tokens.write_tokens(spark.read.parquet(f"{SMALL}/documents.parquet"), out)
    ranks = [r.token for r in spark.read.parquet(f"{out}/ranks").orderBy("rank").collect()]
    ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in tokens.read_tokens(spark, out).collect()])
    seen, n = np.unique(ids, return_counts=True)
    assert ranks == [int(t) for _, t in sorted(zip(-n, seen))]
    size = sum(len(r.payload) for r in spark.read.parquet(f"{out}/blocks").collect())
    assert size < 2.0 * len(ids)


def test_packing_places_every_piece_once(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = packing.pack_documents(docs, field_pieces=64).toPandas()
    library = fresh()
    by_doc = {d: g.sort_values("piece") for d, g in out.groupby("doc_id")}
    for r in docs.select("doc_id", "text").collect():
        ids = np.array([*library.encode(r.text, add_special_tokens=False).ids, 2], "<u4")
        g = by_doc[r.doc_id]
        assert g.length.sum() == len(ids) and (g.length.iloc[1:] == 1024).all()
        assert (len(g) == 1) == (len(ids) <= 1024)
        for p in g.itertuples():
            assert zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32
    out = out.sort_values(["sequence_id", "offset"])
    assert (out.groupby("sequence_id").length.cumsum() - out.length == out.offset).all()
    fills = out.groupby("sequence_id").length.sum()
    least = -(-out.length.sum() // 1024)
    assert fills.max() <= 1024 and len(fills) <= least * 1.01 + 2


def test_genetic_operators_keep_every_piece():
    draw = np.random.default_rng(3)
    lengths = draw.integers(1, 1024, 600)
    f = packing.Field(lengths, 1024, [1])
    a, b = f.fresh(0.0), f.fresh(0.4)
    child = f.cross(a, b)
    whole = lambda g: {frozenset(np.flatnonzero(g == k)) for k in np.unique(g)}
    assert (whole(child) & whole(b)) - whole(a)
    for g in (a, b, child, f.mutate(child)):
        fills = np.bincount(g, lengths)
        assert g.min() == 0 and fills.max() <= 1024 and (fills > 0).all()
    best = f.evolve([a, b, f.fresh(0.2)], 20)[0]
    assert packing.fitness(f.fills(best), 1024) <= packing.fitness(f.fills(a), 1024)


def triplets(bins, seed):
    """Pieces that fill ``bins`` bins exactly, three in each: best fit does badly here."""
    draw, out = np.random.default_rng(seed), []
    for _ in range(bins):
        a = draw.integers(390, 510)
        b = draw.integers((1024 - a) // 2 - 100, (1024 - a) // 2)
        out += [a, b, 1024 - a - b]
    return np.array(out)


@pytest.mark.parametrize("only", ["cross", "mutate", None])
def test_search_saves_bins_that_best_fit_does_not(monkeypatch, only):
    if only == "cross":
        monkeypatch.setattr(packing.Field, "mutate", lambda self, a: a)
    if only == "mutate":
        monkeypatch.setattr(packing.Field, "cross", lambda self, a, b: a)
    for bins in (60, 100):
        f = packing.Field(triplets(bins, 1), 1024, [7])
        first = [f.fresh(x) for x in (0, 0.05, 0.1, 0.2)]
        plain, found = min(len(f.fills(g)) for g in first), len(f.fills(f.evolve(first, 200)[0]))
        assert bins <= found <= plain - 2 and found <= 1.035 * bins


@settings(max_examples=150, deadline=None)
@given(st.integers(4, 25), st.lists(st.integers(1, 25), min_size=1, max_size=8))
def test_lower_bound(capacity, sizes):
    sizes = sorted((min(s, capacity) for s in sizes), reverse=True)
    best = [len(sizes)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity:
                place(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1 :]])
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    assert -(-sum(sizes) // capacity) <= packing.least_bins(np.array(sizes), capacity) <= best[0]


def test_packing_is_not_worse_than_best_fit(spark):
    draw = np.random.default_rng(5)
    cases = {"hard": triplets(60, 2), "mixed": draw.integers(1, 1024, 900), "large": draw.integers(600, 1025, 200), "one": np.array([7])}
    for name, lengths in cases.items():
        df = spark.createDataFrame([(k, int(n)) for k, n in enumerate(lengths)], "uid long, length long")
        out = packing.pack(df).join(df, "uid").toPandas()
        part = lengths[lengths < 1024]
        f = packing.Field(part, 1024, [1])
        plain = len(f.fills(f.fresh(0.0))) + int((lengths == 1024).sum())
        found = out.sequence_id.nunique()
        assert len(out) == len(lengths) and out.groupby("sequence_id").length.sum().max() <= 1024
        assert found <= plain - (2 if name == "hard" else 0), (name, found, plain)


def test_large_fields_are_searched_as_long_as_small_ones(spark):
    lengths = triplets(2000, 4)
    df = spark.createDataFrame([(k, int(n)) for k, n in enumerate(lengths)], "uid long, length long")
    out = packing.pack(df, islands=1, epochs=1).join(df, "uid").toPandas()
    assert len(out) == len(lengths) and out.groupby("sequence_id").length.sum().max() <= 1024
    assert out.sequence_id.nunique() <= 1.018 * 2000


def test_regroup_keeps_every_piece_and_adds_no_bin():
    draw = np.random.default_rng(8)
    for lengths in (triplets(300, 5), draw.integers(1, 1024, 2000), draw.integers(600, 1024, 50), np.array([700, 700]), np.array([9])):
        f = packing.Field(lengths, 1024, [3])
        a = f.fresh(0.3)
        for _ in range(20):
            b = f.regroup(a)
            fills = f.fills(b)
            assert len(b) == len(a) and b.min() == 0 and fills.max() <= 1024 and (fills > 0).all()
            assert packing.fitness(fills, 1024) <= packing.fitness(f.fills(a), 1024)
            a = b


def swapped(f, out, fills, items):
    """``Field.replace`` bin by bin and swap by swap."""
    held = {}
    for item in items.tolist():
        held.setdefault(int(f.lengths[item]), []).append(item)
    for b in np.flatnonzero(fills < f.capacity).tolist():
        own = [k for k in np.flatnonzero(out == b).tolist() if f.lengths[k] <= f.capacity - f.lengths.min()]
        best = (0, (), ())
        for n in (1, 2):
            for removed in [*combinations(own, 1), *combinations(own, 2)]:
                size = int(f.lengths[list(removed)].sum())
                for put in combinations(sorted((s for s, k in held.items() for _ in k[:2]), reverse=True), n):
                    if sum(put) <= size + f.capacity - fills[b] and sum(put) - size > best[0]:
                        best = (sum(put) - size, removed, put)
        for size in best[2]:
            out[held[size].pop()] = b
            if not held[size]:
                del held[size]
        for k in best[1]:
            out[k] = -1
            held.setdefault(int(f.lengths[k]), []).append(k)
        fills[b] += best[0]
    return np.flatnonzero(out < 0)


def test_replacement_is_that_of_one_bin_after_the_other():
    draw, moved = np.random.default_rng(6), 0
    for _ in range(60):
        lengths = draw.integers(1, int(draw.integers(3, 100)), int(draw.integers(4, 40)))
        f = packing.Field(lengths, 100, [2])
        a = f.fresh(0.5)
        loose = np.flatnonzero(a >= max(1, a.max() - int(draw.integers(0, 4))))
        a[loose] = -1
        got, want = a.copy(), a.copy()
        fills = np.bincount(a[a >= 0], lengths[a >= 0]).astype(np.int64)
        fills_got, fills_want = fills.copy(), fills.copy()
        left = f.replace(got, fills_got, loose)
        assert left.tolist() == swapped(f, want, fills_want, loose).tolist()
        assert (got == want).all() and (fills_got == fills_want).all()
        moved += int(fills_got.sum() > fills.sum())
    assert moved > 20


def test_replacement_does_not_call_for_every_bin_that_cannot_gain():
    bins = 5000
    f = packing.Field(np.array([600, 100] * bins + [10]), 1024, [1])
    out, calls = np.append(np.repeat(np.arange(bins), 2), -1).astype(np.int32), cProfile.Profile()
    calls.enable()
    left = f.replace(out, np.full(bins, 700), np.array([2 * bins]))
    calls.disable()
    assert left.tolist() == [2 * bins]
    assert pstats.Stats(calls).total_calls < bins / 5


def test_new_words_take_bounded_memory():
    draw = np.random.default_rng(3)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    texts = pa.array([" ".join("".join(w) for w in letters[draw.integers(0, 26, (150, 9))]) for _ in range(1000)])
    encoder = tokens.TextEncoder(tokens.default_tokenizer())
    tracemalloc.start()
    try:
        ids, lengths = encoder.encode(texts)
        held, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    library = fresh()
    assert ids[: lengths[0]].tolist() == library.encode(texts[0].as_py(), add_special_tokens=False).ids
    assert ids[-lengths[-1] :].tolist() == library.encode(texts[-1].as_py(), add_special_tokens=False).ids
    assert peak - held < 20e6
