"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

A genome is a set of bins (sequences). Crossover injects whole bins of one
parent into the other, full ones first and those that break few full bins,
removes the bins that now hold a document twice, and puts the displaced
documents back: first they replace one or two pieces of an open bin where that
fills it better, then best fit, longest first. Mutation empties open bins and a
few others and refits them. The better of child and parent then has small groups
of bins refitted, in number as the field is large. A field evolves until its bins
are as few as a lower bound allows, or the generations are spent; their number
does not depend on the field's size.

Pieces are dealt into fields of bounded size by a hash; every field is evolved
by several islands with their own seeds, whose elites migrate to the next
island of the ring between epochs. The field's best genome freezes the bins
that have no more free space than ``waste`` tokens; pieces of the other bins go
on to fewer fields at the next level, as long as levels freeze bins. So no task
holds more than a field, and what one field cannot fill another can.

Only documents longer than ``capacity`` are cut, from the end backwards, so the
first piece alone may be shorter. Whole pieces get sequences of their own.

Defined results: a null or empty text is a document of the end id alone;
repeated rows are packed each; an empty table gives an empty result; other
columns are ignored. Reruns agree on lengths and waste; sequence numbers depend
on how the input is split into partitions.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialise
from .tokens import END_ID, default_tokenizer, encoded

CAPACITY = 1024
#: Rounds of replacement over the open bins of a child, at most; they end when a round fills no bin better.
PASSES = 4
#: A generation refits one group of bins for so many bins of a genome, with fewer than so many open ones in each.
GROUP_SHARE, GROUP_OPEN = 800, 8
PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(df: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Tokenise every text and describe its pieces; ids themselves are not kept."""
    path = path or default_tokenizer()

    def cut(batches):
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 38
        for names, arrays in encoded(batches, path, end_id):
            rows = []
            for name, ids in zip(names.to_pylist(), arrays):
                raw, n = ids.astype("<u4").tobytes(), len(ids)
                begin, end, piece = 0, n % capacity or capacity, 0
                while begin < n:
                    rows.append((uid, name, piece, begin, end - begin, zlib.crc32(raw[4 * begin : 4 * end])))
                    begin, end, piece, uid = end, end + capacity, piece + 1, uid + 1
            columns = list(zip(*rows))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["uid", "doc_id", "piece", "start", "length", "ids_crc32"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    return rows.mapInArrow(cut, PIECES)


def best_fit(fills: np.ndarray, lengths: np.ndarray, items: np.ndarray, assign: np.ndarray, capacity: int) -> None:
    """Put ``items`` in the given order into the fullest bins that hold them; bins are opened as needed.

    Bins stand in one list per free space; a bit mask of the spaces in use
    finds the least one that is large enough.
    """
    free: dict[int, list[int]] = {}
    mask, bins, numbers = 0, len(fills), []
    has_room = np.flatnonzero(fills < capacity)
    for b, space in zip(has_room.tolist(), (capacity - fills[has_room]).tolist()):
        free.setdefault(space, []).append(b)
        mask |= 1 << space
    for size in lengths[items].tolist():
        fit = mask >> size
        if fit:
            space = size + (fit & -fit).bit_length() - 1
            b = free[space].pop()
            if not free[space]:
                mask ^= 1 << space
        else:
            b, space = bins, capacity
            bins += 1
        numbers.append(b)
        if space > size:
            free.setdefault(space - size, []).append(b)
            mask |= 1 << (space - size)
    assign[items] = numbers


def fitness(fills: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller bins."""
    return len(fills), -float(np.square(fills / capacity).sum())


def least_bins(lengths: np.ndarray, capacity: int) -> int:
    """A lower bound of the number of bins (Martello and Toth's L2).

    For every k up to half a bin: pieces above ``capacity - k`` share with no
    piece of k or more, those above a half share with no other such piece, and
    what the room beside these cannot take of the pieces from k to a half needs bins of its own.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    above, total = np.cumsum(count[::-1])[::-1], np.cumsum((count * np.arange(capacity + 1))[::-1])[::-1]
    half = capacity // 2
    k = np.arange(half + 1)
    alone = np.where(k > 0, above[np.minimum(capacity - k + 1, capacity)] * (k > 0), 0)
    large = above[half + 1] - alone
    room = large * capacity - (total[half + 1] - np.where(k > 0, total[np.minimum(capacity - k + 1, capacity)], 0))
    small = total[k] - total[half + 1]
    return int((alone + large + np.maximum(0, -(-(small - room) // capacity))).max())


class Field:
    """The pieces of one field, and the genetic operators over them."""

    def __init__(self, lengths: np.ndarray, capacity: int, seed: list[int] | np.random.Generator):
        self.lengths, self.capacity, self.draw = lengths, capacity, np.random.default_rng(seed)

    def fresh(self, noise: float) -> np.ndarray:
        order = np.argsort(-(self.lengths * (1 + noise * self.draw.random(len(self.lengths)))), kind="stable")
        assign = np.full(len(self.lengths), -1, np.int32)
        best_fit(np.zeros(0, np.int64), self.lengths, order, assign, self.capacity)
        return assign

    def fills(self, assign: np.ndarray) -> np.ndarray:
        return np.bincount(assign, self.lengths).astype(np.int64)

    def refit(self, assign: np.ndarray, loose: np.ndarray) -> np.ndarray:
        """Put the ``loose`` pieces among the bins of all the others: replacement in open bins, then best fit."""
        items, counts = np.flatnonzero(loose), np.bincount(assign)
        gone = assign[items]
        used = counts > np.bincount(gone, minlength=len(counts))
        out = (np.cumsum(used, dtype=np.int32) - 1)[assign]
        out[items] = -1
        fills = (self.fills(assign) - np.bincount(gone, self.lengths[items], len(counts)).astype(np.int64))[used]
        for _ in range(PASSES):
            before = int(fills.sum())
            if not len(fills) or not len(items):
                break
            items = self.replace(out, fills, items)
            if int(fills.sum()) == before:
                break
        self.place(out, fills, items)
        return out

    def place(self, out: np.ndarray, fills: np.ndarray, items: np.ndarray) -> None:
        """Put ``items``, longest first, into bins of ``fills`` and new ones by best fit; at times into fresh bins before."""
        items = items[np.argsort(-self.lengths[items], kind="stable")]
        if self.draw.random() < 0.5:
            left, bins = self.fresh_bins(items, out, len(fills)), len(fills)
            inside, items = items[~left], items[left]
            fills = np.concatenate([fills, np.bincount(out[inside] - bins, self.lengths[inside]).astype(np.int64)])
        best_fit(fills, self.lengths, items, out, self.capacity)

    def fresh_bins(self, items: np.ndarray, out: np.ndarray, bins: int) -> np.ndarray:
        """Open bins for the longest pieces, each closed by the one, two or three others that fill it best; a mask of what is left.

        It stops at pieces of less than a third of a bin, which best fit places well.
        """
        sizes, held, mask = self.lengths[items].tolist(), {}, 0
        for k in range(len(items) - 1, -1, -1):
            held.setdefault(sizes[k], []).append(k)
            mask |= 1 << sizes[k]
        left = np.ones(len(items), bool)

        def take(size: int) -> None:
            nonlocal mask
            k = held[size].pop()
            if not held[size]:
                mask ^= 1 << size
            left[k] = False
            out[items[k]] = bins

        def two(room: int, most: int) -> tuple[int, ...]:
            """The one or two sizes, of ``most`` at most, with the greatest sum within ``room``."""
            best, best_sum, rest = (), 0, mask & ((2 << min(room, most)) - 1)
            while rest:
                x = rest.bit_length() - 1
                if 2 * x <= best_sum:
                    break
                rest ^= 1 << x
                below = mask & ((2 << min(x, room - x)) - 1)
                y = below.bit_length() - 1
                if y == x and len(held[x]) < 2:
                    y = (below ^ (1 << x)).bit_length() - 1
                if x + max(y, 0) > best_sum:
                    best, best_sum = ((x, y) if y > 0 else (x,)), x + max(y, 0)
                    if best_sum == room:
                        break
            return best

        while mask and (longest := mask.bit_length() - 1) > self.capacity // 3:
            take(longest)
            room = self.capacity - longest
            while mask and room:
                more = two(room, room)
                if not more:
                    break
                for size in more:
                    take(size)
                room -= sum(more)
            bins += 1
        return left

    def replace(self, out: np.ndarray, fills: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Swap one or two pieces of open bins for one or two loose ones that fill the bin better; what is loose then.

        Bins take their turn in order. Which bin gains next is read for many at
        once from the greatest sums of one and of two loose pieces within every
        room; the sums change with each swap.
        """
        is_open = np.append(fills < self.capacity, False)
        # a piece that shares with no other cannot be helped
        inside = np.flatnonzero(is_open[out])
        inside = inside[self.lengths[inside] <= self.capacity - self.lengths.min()]
        if not len(inside):
            return items
        inside = inside[np.argsort(out[inside], kind="stable")]
        firsts = np.flatnonzero(np.diff(out[inside], prepend=-1))
        numbers, counts = out[inside[firsts]], np.diff(firsts, append=len(inside))
        held: dict[int, list[int]] = {}
        for item, size in zip(items.tolist(), self.lengths[items].tolist()):
            held.setdefault(size, []).append(item)
        ones, pairs = self.best_sums(held)
        # all groups of one piece, then of two, of a bin: in the order of its pieces
        begins, groups = np.repeat(firsts, counts), counts * (counts + 1) // 2
        p, q = np.arange(len(inside)), np.arange(len(inside))
        rows = [(p, q)]
        after = begins + np.repeat(counts, counts) - 1 - p
        first = np.repeat(p, after)
        rows.append((first, first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(after) - after, after)))
        p, q = (np.concatenate(x) for x in zip(*rows))
        order = np.argsort(np.repeat(np.arange(len(firsts)), counts)[p], kind="stable")
        p, q = p[order], q[order]
        ends = np.cumsum(groups)
        sizes = self.lengths[inside]
        sizes = np.where(p == q, sizes[p], sizes[p] + sizes[q])
        spaces = (self.capacity - fills)[numbers]
        rooms = sizes + np.repeat(spaces, groups)
        k, ahead = 0, 64
        while k < len(firsts):
            stop = min(len(firsts), k + ahead)
            lo, hi = int(ends[k] - groups[k]), int(ends[stop - 1])
            gains = np.maximum(ones[rooms[lo:hi]], pairs[rooms[lo:hi]]) > sizes[lo:hi]
            at = int(gains.argmax())
            if not gains[at]:
                k, ahead = stop, 2 * ahead
                continue
            k, ahead = int(np.searchsorted(ends, lo + at, side="right")), 64
            lo, hi, space, b = int(ends[k] - groups[k]), int(ends[k]), int(spaces[k]), int(numbers[k])
            single, double = ones[rooms[lo:hi]] - sizes[lo:hi], pairs[rooms[lo:hi]] - sizes[lo:hi]
            g = int(single.argmax())
            gain, taken = int(single[g]), (int(ones[rooms[lo + g]]),)
            if gain < space and (most := int(double.max())) > max(gain, 0):
                g, gain = int(double.argmax()), most
                taken = self.parts(held, int(pairs[rooms[lo + g]]))
            for size in taken:
                out[held[size].pop()] = b
                if not held[size]:
                    del held[size]
            for piece in inside[[p[lo + g]] if p[lo + g] == q[lo + g] else [p[lo + g], q[lo + g]]].tolist():
                out[piece] = -1
                held.setdefault(int(self.lengths[piece]), []).append(piece)
            fills[b] += gain
            ones, pairs = self.best_sums(held)
            k += 1
        return np.flatnonzero(out < 0)

    def best_sums(self, held: dict[int, list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """The greatest length of a loose piece, and the greatest sum of two, within every room; -1 where there is none."""
        sizes = np.array(sorted(held), np.int64)
        ones, pairs = np.full(self.capacity + 1, -1, np.int64), np.full(self.capacity + 1, -1, np.int64)
        ones[sizes] = sizes
        sums = sizes[:, None] + sizes
        allowed = sums <= self.capacity
        allowed[np.diag_indices(len(sizes))] &= np.array([len(held[x]) > 1 for x in sizes.tolist()], bool)
        sums = sums[allowed]
        pairs[sums] = sums
        return np.maximum.accumulate(ones), np.maximum.accumulate(pairs)

    @staticmethod
    def parts(held: dict[int, list[int]], total: int) -> tuple[int, int]:
        """The two loose lengths of this sum, with the greatest first."""
        x = max(x for x in held if 2 * x >= total and total - x in held and (2 * x > total or len(held[x]) > 1))
        return x, total - x

    def cross(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Inject bins of ``b`` into ``a``: full ones that break fewer than two full bins of ``a``, and some other well-filled ones."""
        fills, other = self.fills(b), self.fills(a)
        met = np.sort(b.astype(np.int64) * len(other) + a)
        met = met[np.diff(met, prepend=-1) > 0]
        of_b, of_a = met // len(other), met % len(other)
        # full bins of a that each bin of b meets, and bins that both parents have
        breaks = np.bincount(of_b, other[of_a] == self.capacity, len(fills))
        single = np.bincount(of_b, minlength=len(fills)) == 1
        shared = single & (np.bincount(of_b, other[of_a], len(fills)) == fills)
        fit = np.flatnonzero((fills == self.capacity) & (breaks < 2) & ~shared)
        # well-filled bins stand in where no full one fits
        fit = fit if len(fit) else np.flatnonzero((fills >= np.quantile(fills, 0.5)) & ~shared)
        if not len(fit):
            return a
        chosen = np.zeros(len(fills), bool)
        chosen[self.draw.choice(fit, min(len(fit), int(self.draw.geometric(0.25))), replace=False)] = True
        injected = chosen[b]
        doubled = np.zeros(a.max() + 1, bool)
        doubled[a[injected]] = True
        loose = doubled[a] & ~injected
        # the worst bin of the child goes with them: an injection that mends nothing else is of no use
        rest = np.where(loose | injected, self.capacity, other[a])
        loose |= (a == a[int(rest.argmin())]) & ~injected
        return self.refit(np.where(injected, a.max() + 1 + b, a), loose)

    def mutate(self, a: np.ndarray) -> np.ndarray:
        """Empty the worst bin and a few others, open ones rather than full ones."""
        fills = self.fills(a)
        out = np.zeros(len(fills), bool)
        out[int(fills.argmin())] = True
        weight = np.where(fills < self.capacity, 4.0, 1.0)
        out[self.draw.choice(len(fills), min(len(fills), int(self.draw.integers(1, 9))), replace=False, p=weight / weight.sum())] = True
        return self.refit(a, out[a])

    def regroup(self, a: np.ndarray) -> np.ndarray:
        """Refit small groups of bins, each by itself; those that end in fewer or no less full bins stay.

        Their number grows with the field, so that a generation works on a like
        share of every field. A group joins open bins, rather those with much
        free space, and bins of three or more pieces, which hold the small ones.
        """
        fills, counts = self.fills(a), np.bincount(a)
        space = self.capacity - fills
        is_open = np.flatnonzero(space)
        take = self.draw.integers(2, GROUP_OPEN, -(-len(fills) // GROUP_SHARE))
        take = take[np.cumsum(take) <= max(len(is_open), take[0])]
        if len(is_open) < 2:
            return a
        opened = self.draw.choice(is_open, min(len(is_open), int(take.sum())), replace=False, p=space[is_open] / space.sum())
        many = counts > 2
        many[opened] = False
        many = self.draw.permutation(np.flatnonzero(many))[: 2 * int(take.sum())]
        wanted = np.zeros(len(fills), bool)
        wanted[opened] = wanted[many] = True
        order = np.flatnonzero(wanted[a])
        order = order[np.argsort(a[order], kind="stable")]
        ends = np.cumsum(np.where(wanted, counts, 0))
        out, cuts = a.copy(), np.cumsum(take)[:-1]
        for some, others in zip(np.split(opened, cuts), np.split(many, 2 * cuts)):
            bins = np.concatenate([some, others[: int(self.draw.integers(len(others) + 1))]])
            items = np.concatenate([order[end - n : end] for end, n in zip(ends[bins].tolist(), counts[bins].tolist())])
            part = Field(self.lengths[items], self.capacity, self.draw)
            again = np.full(len(items), -1, np.int32)
            part.place(again, np.zeros(0, np.int64), np.arange(len(items)))
            if fitness(part.fills(again), self.capacity) <= fitness(fills[bins], self.capacity):
                out[items] = bins[again]
        used = np.bincount(out) > 0
        return (np.cumsum(used) - 1)[out].astype(np.int32)

    def evolve(self, population: list[np.ndarray], generations: int) -> list[np.ndarray]:
        """Steady state: every child replaces the worst genome that it beats. Best first."""
        least = least_bins(self.lengths, self.capacity)
        scored = sorted(((fitness(self.fills(g), self.capacity), k, g) for k, g in enumerate(population)), key=lambda x: x[:2])
        for k in range(generations):
            if scored[0][0][0] <= least:
                break
            i, j = sorted(self.draw.choice(len(scored), 2, replace=False).tolist())
            first, second = (scored[i][2], scored[j][2]) if self.draw.random() < 0.5 else (scored[j][2], scored[i][2])
            child = self.cross(first, second)
            if self.draw.random() < 0.5 or (child == first).all():
                child = self.mutate(child)
            if fitness(self.fills(child), self.capacity) > (scored[i] if first is scored[i][2] else scored[j])[0]:
                child = first
            child = self.regroup(child)
            scored.append((fitness(self.fills(child), self.capacity), len(population) + k, child))
            scored = sorted(scored, key=lambda x: x[:2])[: len(population)]
        return [g for _, _, g in scored]


def _lengths(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    table = table.sort_by("uid")
    return table, table.column("length").to_numpy().astype(np.int64)


GENOMES = "field long, island int, bins long, score double, genome binary"


def _genome_rows(field: int, targets: list[int], genomes: list[np.ndarray], f: Field) -> pa.Table:
    rows = [(field, t, *fitness(f.fills(g), f.capacity), g.astype("<i4").tobytes()) for t in targets for g in genomes]
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.binary())
    names = ("field", "island", "bins", "score", "genome")
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds))})


def _evolve_level(left: DataFrame, capacity: int, islands: int, epochs: int, population: int, generations: int, seed: int) -> DataFrame:
    """The best genome of every field of ``left`` (``uid, length, field``)."""
    everywhere = left.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(islands)])))

    def begin(key, table):
        _, lengths = _lengths(table)
        f = Field(lengths, capacity, [seed, key[0].as_py(), key[1].as_py()])
        noise = [0.0 if key[1].as_py() == 0 else 0.05] + [0.1 + 0.1 * k for k in range(1, population)]
        elites = f.evolve([f.fresh(x) for x in noise], generations)[: max(2, population // 2)]
        me = key[1].as_py()
        return _genome_rows(key[0].as_py(), sorted({me, (me + 1) % islands}), elites, f)

    def go_on(key, table, arrived):
        _, lengths = _lengths(table)
        me = key[1].as_py()
        f = Field(lengths, capacity, [seed, key[0].as_py(), me, 1])
        order = np.lexsort([np.array(arrived.column("score")), np.array(arrived.column("bins"))])
        genomes = list(dict.fromkeys(arrived.column("genome")[int(i)].as_py() for i in order))[: max(2, population)]
        got = [np.frombuffer(g, "<i4") for g in genomes]
        while len(got) < 2:
            got.append(f.fresh(0.2))
        elites = f.evolve(got, generations)[: max(2, population // 2)]
        return _genome_rows(key[0].as_py(), sorted({me, (me + 1) % islands}), elites, f)

    found = materialise(everywhere.groupBy("field", "island").applyInArrow(begin, GENOMES), "genomes")
    for _ in range(epochs - 1):
        found = materialise(everywhere.groupBy("field", "island").cogroup(found.groupBy("field", "island")).applyInArrow(go_on, GENOMES), "genomes")
    return found.groupBy("field").agg(F.min_by("genome", F.struct("bins", "score", "genome")).alias("genome"))


def _placer(base: int, limit: int):
    """A function that turns a field's best genome into places; bins filled to ``limit`` are done."""

    def place(key, table, genome):
        table, lengths = _lengths(table)
        assign = np.frombuffer(genome.column("genome")[0].as_py(), "<i4")
        order = np.argsort(assign, kind="stable")
        begins = np.cumsum(lengths[order]) - lengths[order]
        first = np.flatnonzero(np.diff(assign[order], prepend=-1))
        offset = np.empty(len(assign), np.int64)
        offset[order] = begins - np.repeat(begins[first], np.diff(np.append(first, len(order))))
        done = np.bincount(assign, lengths)[assign] >= limit
        number = base + (key[0].as_py() << 20) + assign.astype(np.int64)
        return pa.table({"uid": table.column("uid"), "length": lengths, "sequence_id": pa.array(number, pa.int64()), "offset": pa.array(offset, pa.int64()), "done": done})

    return place


def pack(
    pieces: DataFrame,
    capacity: int = CAPACITY,
    field_pieces: int = 1 << 16,
    islands: int = 2,
    epochs: int = 2,
    population: int = 4,
    generations: int = 200,
    waste: int = 20,
    levels: int = 8,
    seed: int = 11,
) -> DataFrame:
    """Place pieces: ``uid, sequence_id, offset`` for ``uid, length`` (1 to ``capacity``).

    An island spends ``generations`` in an epoch, whatever the number of pieces
    of its field, unless it meets the lower bound before.
    """
    whole = pieces.where(F.col("length") == capacity).select("uid", (F.col("uid") + F.lit(1 << 61)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left, placed = pieces.where(F.col("length") < capacity).select("uid", "length"), [whole]
    for level in range(levels):
        n = left.count()
        if not n:
            break
        fields = -(-n // field_pieces)
        last = fields == 1 or level == levels - 1
        dealt = left.withColumn("field", F.pmod(F.xxhash64("uid", F.lit(seed + level)), F.lit(fields)))
        best = _evolve_level(dealt, capacity, islands, epochs, population, generations, seed + level)
        place = _placer(level << 57, 0 if last else capacity - waste)
        out = dealt.groupBy("field").cogroup(best.groupBy("field")).applyInArrow(place, "uid long, length long, sequence_id long, offset long, done boolean")
        out = materialise(out, "placed")
        if last or out.where("not done").count() > 0.9 * n:
            # a level that freezes next to nothing is the last one
            placed.append(out.select("uid", "sequence_id", "offset"))
            break
        placed.append(out.where("done").select("uid", "sequence_id", "offset"))
        left = out.where("not done").select("uid", "length")
    result = placed[0]
    for p in placed[1:]:
        result = result.unionByName(p)
    return result


def pack_documents(df: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, **options) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for all pieces of all documents."""
    pieces = materialise(cut_pieces(df, capacity, id_col, text_col, path), "pieces")
    return pieces.join(pack(pieces, capacity, **options), "uid").drop("uid")
