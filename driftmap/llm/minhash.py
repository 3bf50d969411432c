"""Near-duplicates by circulant MinHash.

A document is its set of distinct word shingles, as 64-bit hashes. Two
permutations of the 32-bit numbers make every signature coordinate: the first
scatters the shingles, the second, shifted circularly by k, gives coordinate k;
its least value over the set is kept. Bands of coordinates find candidates,
and links are confirmed on full sets.

The steps keep groups bounded, whatever their size:

1. Rows with equal sets fold into one node (a partial aggregate).
2. Representatives that share a band are candidates. A band's two-row buckets
   give their pair in plain aggregates. Larger buckets are cut into tiles of
   ``tile`` rows by a hash; each pair of tiles is one unit of work, which compares
   whole signatures and gives a spanning forest of the pairs whose estimated
   similarity is within reach, not all pairs. Two-row pairs pass the same test.
3. Forests join into clusters of candidates (distributed components).
4. Clusters, cut into pairs of tiles the same way, compare full sets exactly:
   each shingle's postings are counted, so all pairs of a unit are confirmed,
   and again a forest of confirmed links is given.
5. Components of those links are the answer.

A pair over the threshold shares no band with probability at most ``miss``
(1e-6 by default; the numbers of bands and rows follow from it), and its
estimate falls ``slack`` below the threshold with a smaller one.

A distinct set has a number of its own as its node, so rows without an id are
linked like all others and an id that many rows share brings in no other row.

Defined results: a null, empty or wordless text has the empty set and links
with nothing; a text shorter than a shingle is one shingle; rows that share an
id pool their links (unless ``pool_ids`` is off); ``component_id`` is the least
id reachable, null if no row of the component has one; equal rows are reported
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import free, materialise
from .worker_memory import give_back

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_words: dict[bytes, int] = {}
#: Words whose hash a worker remembers.
MEMO_WORDS = 300_000


def plan_bands(threshold: float, miss: float = 1e-6) -> tuple[int, int]:
    """``(bands, rows)``: four rows below a threshold of 0.85, else five, and as many bands as ``miss`` asks for."""
    rows = 5 if threshold >= 0.85 else 4
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows)), rows


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    from hashlib import blake2b

    if len(_words) > MEMO_WORDS:
        _words.clear()
    for w in set(words).difference(_words):
        _words[w] = int.from_bytes(blake2b(w, digest_size=8).digest(), "little")
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, A-Z lower-cased."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    k = min(size, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = scramble(out * _M2 + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def permute(x: np.ndarray) -> None:
    """The second permutation of the 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """Circulant MinHash of non-empty sets: a row of ``n`` 32-bit minima each."""
    flat = np.concatenate(sets)
    firsts = np.cumsum([0, *map(len, sets[:-1])])
    scattered = (scramble(flat ^ _M1) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((n, len(sets)), np.uint32)
    x = np.empty_like(scattered)
    for k in range(n):
        np.add(scattered, np.uint32(k), out=x)
        permute(x)
        out[k] = np.minimum.reduceat(x, firsts)
    return np.ascontiguousarray(out.T)


def band_keys(signs: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature; equal bands at different places differ."""
    key = np.arange(bands, dtype=np.uint64)[None, :] + np.uint64(1)
    key = np.broadcast_to(key, (len(signs), bands)).copy()
    parts = signs[:, : bands * rows].reshape(len(signs), bands, rows).astype(np.uint64)
    for r in range(rows):
        key = scramble(key * _M2 + parts[:, :, r])
    return key.view(np.int64)


def _sketch(shingle: int, bands: int, rows: int):
    """Batches of ``id, key, body`` to ``id, key, n_shingles, set_hash, bands, sign``."""
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("n_shingles", pa.int64()), ("set_hash", pa.binary()), ("bands", pa.list_(pa.int64())), ("sign", pa.binary())])

    def run(batches):
        from hashlib import blake2b

        for batch in batches:
            ids, keys_, texts = batch.column("id").to_pylist(), batch.column("key").to_pylist(), batch.column("body")
            for lo in range(0, len(ids), 256):
                sets = [shingle_set(t.as_py(), shingle) for t in texts[lo : lo + 256]]
                full = [s for s in sets if len(s)]
                signs = signatures(full, bands * rows) if full else np.zeros((0, bands * rows), np.uint32)
                keys, low = band_keys(signs, bands, rows), signs.astype(np.uint8)
                out, k = [], 0
                for name, own, s in zip(ids[lo : lo + 256], keys_[lo : lo + 256], sets):
                    if len(s):
                        out.append((name, own, len(s), blake2b(s.tobytes(), digest_size=16).digest(), keys[k].tolist(), low[k].tobytes()))
                        k += 1
                    else:
                        out.append((name, own, 0, None, None, None))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        _words.clear()  # workers go on to other operators
        give_back()

    return run


class Forest:
    """Union-find over the rows of one unit of work."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            higher = self.up[self.up]
            if (higher == self.up).all():
                return self.up
            self.up = higher

    def link(self, i: int, others: np.ndarray) -> np.ndarray:
        """Join row i with ``others``; those that were apart from it, one for each tree."""
        roots = self.roots()
        found, at = np.unique(roots[others], return_index=True)
        fresh = found != roots[i]
        least = min(roots[i], found.min()) if len(found) else roots[i]
        self.up[np.append(found, roots[i])] = least
        return others[at[fresh]]


def _units(rows: DataFrame, group: str) -> DataFrame:
    """Deal the rows of each group (``group, rep, tiles``) to units of work: pairs of tiles.

    Groups of one tile are one unit. A column ``unit`` is added; a row of a
    larger group stands in as many units as it has tiles.
    """
    dealt = rows.withColumn("t", F.pmod(F.xxhash64("rep", F.lit(5)), F.col("tiles")).cast("int"))
    u = dealt.withColumn("u", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    u = u.where("tiles = 1 or t <> u")
    return u.select(*rows.columns, F.struct(F.col(group), F.least("t", "u").alias("lo"), F.greatest("t", "u").alias("hi")).alias("unit"))


def _by_unit(batches, handle):
    """Call ``handle`` with the whole rows of each unit of batches that are sorted by unit."""
    held, current = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        unit = batch.column("unit")
        parts = np.stack([x.to_numpy() for x in unit.flatten()])
        cuts = [0, *(np.flatnonzero((np.diff(parts, axis=1) != 0).any(axis=0)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            name = tuple(parts[:, a])
            if held and name != current:
                yield from handle(pa.Table.from_batches(held).combine_chunks())
                held = []
            current = name
            held.append(batch.slice(a, b - a))
    if held:
        yield from handle(pa.Table.from_batches(held).combine_chunks())
        held = []
    _words.clear()
    give_back()


def _edges(ids: np.ndarray, pairs: list[tuple[int, np.ndarray]]):
    if pairs:
        a = np.concatenate([np.full(len(o), ids[i]) for i, o in pairs])
        b = np.concatenate([ids[o] for _, o in pairs])
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _similar_signatures(least: float):
    def handle(table: pa.Table):
        ids = table.column("rep").to_numpy()
        signs = np.stack([np.frombuffer(s.as_py(), np.uint8) for s in table.column("sign")])
        forest, pairs = Forest(len(ids)), []
        for i in range(len(ids) - 1):
            roots = forest.roots()
            apart = i + 1 + np.flatnonzero(roots[i + 1 :] != roots[i])
            if len(apart):
                near = apart[(signs[apart] == signs[i]).sum(axis=1) >= least * signs.shape[1]]
                if len(near):
                    pairs.append((i, forest.link(i, near)))
        yield from _edges(ids, [p for p in pairs if len(p[1])])

    return lambda batches: _by_unit(batches, handle)


def _near_pairs(least: float):
    """The pairs ``a, b`` whose signatures ``x, y`` agree in ``least`` of the coordinates."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in "xy")
                near = pa.array((x == y).mean(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(near), batch.column("b").filter(near)], ["a", "b"])

    return run


def _similar_sets(shingle: int, num: int, den: int):
    """Confirm all pairs of a unit on full sets: ``den * |A and B| >= num * |A or B|``."""

    def handle(table: pa.Table):
        ids = table.column("rep").to_numpy()
        sets = [shingle_set(t.as_py(), shingle) for t in table.column("body")]
        sizes = np.array([len(s) for s in sets])
        order = np.argsort(sizes, kind="stable")
        ids, sets, sizes = ids[order], [sets[i] for i in order], sizes[order]
        _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), sizes)
        shared = counts[inverse] > 1  # a shingle of one set alone is in no intersection
        inverse, owner = inverse[shared], owner[shared]
        by_shingle = np.argsort(inverse, kind="stable")
        postings, marks = owner[by_shingle].astype(np.int32), inverse[by_shingle]
        begins = np.searchsorted(marks, np.arange(len(counts) + 1))
        first = np.searchsorted(owner, np.arange(len(sets) + 1))
        forest, pairs = Forest(len(ids)), []
        for i in range(len(ids) - 1):
            roots = forest.roots()
            end = np.searchsorted(sizes, sizes[i] * den // num, side="right")
            if end <= i + 1 or (roots[i + 1 : end] == roots[i]).all():
                continue
            common = np.zeros(len(ids), np.int64)
            mine = inverse[first[i] : first[i + 1]]
            lengths = begins[mine + 1] - begins[mine]
            for lo in range(0, len(mine), 4096):
                n = lengths[lo : lo + 4096]
                ends = np.cumsum(n)
                at = np.repeat(begins[mine[lo : lo + 4096]] - ends + n, n) + np.arange(ends[-1])
                common += np.bincount(postings[at], minlength=len(ids))
            j = np.arange(i + 1, end)
            near = j[(roots[j] != roots[i]) & ((den + num) * common[j] >= num * (sizes[i] + sizes[j]))]
            if len(near):
                pairs.append((i, forest.link(i, near)))
        yield from _edges(ids, [p for p in pairs if len(p[1])])

    return lambda batches: _by_unit(batches, handle)


#: Bits of a key filter: 8 MB at most, whatever the number of keys.
FILTER_BITS = 1 << 26
#: Stands for a missing id, so that it comes last.
_LAST = (1 << 63) - 1


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, key, body``: the key, a hash of the text, tells rows of one id apart."""
    body = F.col(text_col)
    return df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(body).alias("key"), body.alias("body"))


def _bit(place: str, key: str):
    return F.pmod(F.xxhash64(place, key, F.lit(11)), F.lit(FILTER_BITS))


def _marked(rows: DataFrame, place: str, key: str, keys: DataFrame, hit: str) -> DataFrame:
    """``rows`` with a boolean column ``hit``: false if no row of ``keys`` (``at, at_key``) has the row's place and key, true if one may.

    The keys become bitmaps of ``FILTER_BITS`` bits in all, so what is broadcast
    is bounded. More keys let more rows pass, and none is missed: a join of the
    rows that pass with the keys themselves decides, and only these rows move.
    """
    bit, bucket, bits = (free(rows, n) for n in ("__bit", "__bucket", "__bits"))
    marks = keys.select(_bit("at", "at_key").alias(bit)).select(F.bitmap_bucket_number(bit).alias(bucket), F.bitmap_bit_position(bit).alias("place"))
    # dealt by bucket before they are folded, so no task makes bitmaps of all buckets
    maps = materialise(marks.repartition(bucket).groupBy(bucket).agg(F.bitmap_construct_agg("place").alias(bits)), "key-filter")
    probed = rows.withColumn(bit, _bit(place, key)).withColumn(bucket, F.bitmap_bucket_number(bit)).join(F.broadcast(maps), bucket, "left")
    at = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return probed.withColumn(hit, F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1, F.lit(False))).drop(bit, bucket, bits)


def _classes(docs: DataFrame, shingle: int, threshold: tuple[int, int], miss: float, slack: float, tile: int, tile_shingles: int, pool_ids: bool) -> DataFrame:
    """``id, key, n_shingles, node, at, at_key`` of every row: its set's node, and id and key of the row that stands for its component."""
    num, den = threshold
    bands, rows = plan_bands(num / den, miss)
    sketch = materialise(docs.mapInArrow(_sketch(shingle, bands, rows), "id long, key long, n_shingles long, set_hash binary, bands array<long>, sign binary"), "sketch")
    place = F.coalesce("id", F.lit(_LAST))
    # tables of one row per group are written before rows join them: then both sides are exchanges, and Spark can split a hot key
    picked = sketch.where("set_hash is not null").groupBy("set_hash").agg(F.min(place).alias("at"), F.min_by("key", place).alias("at_key"))
    per_set = materialise(picked.withColumn("node", F.monotonically_increasing_id()), "sets")
    member = materialise(sketch.select("id", "key", "n_shingles", "set_hash").join(per_set, "set_hash", "left").drop("set_hash"), "members")
    chosen = sketch.join(per_set.select("set_hash", "node", "at", "at_key"), "set_hash").where((place == F.col("at")) & (F.col("key") == F.col("at_key")))
    # a row that is there several times counts once: the first of equal values
    reps = materialise(chosen.groupBy(F.col("node").alias("rep")).agg(F.first("bands").alias("bands"), F.first("sign").alias("sign"), F.first("n_shingles").alias("size"), F.count(F.lit(1)).alias("equal")), "reps")

    in_band = reps.select("rep", F.explode("bands").alias("key"))
    buckets = materialise(in_band.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("a"), F.max("rep").alias("b")).where("n > 1"), "buckets")
    pairs = buckets.where("n = 2").select("a", "b").distinct()
    large = in_band.join(buckets.where("n > 2").select("key", F.ceil(F.col("n") / tile).cast("int").alias("tiles")), "key")
    units = _units(large, "key").join(reps.select("rep", "sign"), "rep")
    compared = units.repartition("unit").sortWithinPartitions("unit", "rep").select("unit", "rep", "sign").mapInArrow(_similar_signatures(num / den - slack), "a long, b long")
    sign = reps.select("rep", "sign")
    signed = pairs.join(sign.toDF("a", "x"), "a").join(sign.toDF("b", "y"), "b")
    clusters = materialise(components(signed.select("a", "b", "x", "y").mapInArrow(_near_pairs(num / den - slack), "a long, b long").unionByName(compared)), "components")

    # tiles are bounded in rows and in shingles
    named = clusters.select(F.col("component").alias("cluster"), F.col("node").alias("rep")).join(reps.select("rep", "size", "equal"), "rep")
    named = named.join(per_set.select(F.col("node").alias("rep"), "at", "at_key"), "rep")
    named = materialise(named, "clusters")
    tiles = F.greatest(F.ceil(F.count(F.lit(1)) / tile), F.ceil(F.sum("size") / tile_shingles)).cast("int")
    sizes = materialise(named.groupBy("cluster").agg(tiles.alias("tiles")), "cluster-sizes")
    in_cluster = materialise(named.join(sizes, "cluster").select("cluster", "rep", "tiles", "at", "at_key", "equal"), "dealt")
    # only texts that may stand for a set of a cluster are moved
    near = _marked(docs.withColumn("place", place), "place", "key", in_cluster, "hit").where("hit")
    c = in_cluster.alias("c")
    texts = near.join(c, (near["place"] == F.col("c.at")) & (near["key"] == F.col("c.at_key"))).select("c.cluster", "c.rep", "c.tiles", "c.equal", "body")
    if in_cluster.where("equal > 1").isEmpty():
        texts = texts.drop("equal")
    else:  # a row that is there several times stands for its set once
        texts = materialise(texts, "texts")
        texts = texts.where("equal = 1").drop("equal").unionByName(texts.where("equal > 1").drop("equal").dropDuplicates(["rep"]))
    confirmed = _units(texts, "cluster").repartition("unit").sortWithinPartitions("unit", "rep").select("unit", "rep", "body").mapInArrow(_similar_sets(shingle, num, den), "a long, b long")
    if pool_ids:
        shared = member.where("id is not null and node is not null").groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("id", "a")
        confirmed = confirmed.unionByName(member.where("node is not null").join(materialise(shared, "shared-ids"), "id").where("node <> a").select("a", F.col("node").alias("b")).distinct())
    found = materialise(components(confirmed), "components")

    linked = materialise(found.join(per_set.select("node", "at", "at_key"), "node"), "linked")
    best = materialise(linked.groupBy("component").agg(F.min("at").alias("best"), F.min_by("at_key", "at").alias("best_key")), "best")
    linked = linked.join(best, "component").select("node", "best", "best_key")
    out = member.join(materialise(linked, "classes"), "node", "left")
    return out.select("id", "key", "n_shingles", "node", F.coalesce("best", "at", F.coalesce("id", F.lit(_LAST))).alias("at"), F.coalesce("best_key", "at_key", "key").alias("at_key"))


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    threshold: tuple[int, int] = (80, 100),
    miss: float = 1e-6,
    slack: float = 0.2,
    tile: int = 512,
    tile_shingles: int = 1 << 20,
    pool_ids: bool = True,
) -> DataFrame:
    """One row per document: ``id, n_shingles, component_id, kept``.

    Sets A and B are linked if ``threshold[1] * |A and B| >= threshold[0] * |A or B|``.
    ``component_id`` is the least id reachable over links, ``kept`` marks that
    document. A unit of work holds two tiles of ``tile`` sets and about
    ``tile_shingles`` shingles.
    """
    out = _classes(_rows(df, id_col, text_col), shingle, threshold, miss, slack, tile, tile_shingles, pool_ids)
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.when((F.col("at") < _LAST) | F.col("id").isNotNull(), F.col("at")))
    return out.select("id", "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    threshold: tuple[int, int] = (80, 100),
    miss: float = 1e-6,
    slack: float = 0.2,
    tile: int = 512,
    tile_shingles: int = 1 << 20,
) -> DataFrame:
    """The rows of ``df`` that stay: one row of each component, of the least id. Columns are those of ``df``.

    Rows are documents each here, whatever their ids: rows that share an id are
    not linked by it, rows without one come last, and equal rows leave one.
    Rows with the empty set stay.
    """
    place, key, once, hit = (free(df, n) for n in ("__place", "__text", "__once", "__hit"))
    out = _classes(_rows(df, id_col, text_col), shingle, threshold, miss, slack, tile, tile_shingles, False)
    own = F.coalesce("id", F.lit(_LAST))
    out = out.withColumn("stays", F.col("node").isNull() | ((own == F.col("at")) & (F.col("key") == F.col("at_key"))))
    # rows of one id and one text share their verdict
    verdict = out.groupBy(own.alias("k_place"), F.col("key").alias("k_key")).agg(F.max("stays").alias("stays"), ((F.count(F.lit(1)) == 1) | F.max("node").isNull()).alias(once))
    verdict = materialise(verdict, "verdicts")
    # rows that go, or of which one stays
    others = verdict.where(~F.col("stays") | ~F.col(once)).select(F.col("k_place").alias("at"), F.col("k_key").alias("at_key"))
    again = verdict.where(F.col("stays") & ~F.col(once)).select(F.col("k_place").alias("at"), F.col("k_key").alias("at_key"))
    keyed = df.withColumn(place, F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST))).withColumn(key, F.xxhash64(F.col(text_col)))
    marked = _marked(keyed, place, key, others, hit)
    maybe = marked.where(F.col(hit)).alias("t")

    def of(rows: DataFrame, how: str) -> DataFrame:
        return maybe.join(rows.alias("k"), (F.col(f"t.{place}") == F.col("k.at")) & (F.col(f"t.{key}") == F.col("k.at_key")), how)

    kept = marked.where(~F.col(hit)).unionByName(of(others, "left_anti"))
    if not again.isEmpty():
        kept = kept.unionByName(of(again, "left_semi").dropDuplicates([place, key]))
    return kept.select(*df.columns)
