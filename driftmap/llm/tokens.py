"""Token ids of whole texts, and their binary files.

``TextEncoder`` gives exactly the ids that the tokenizers library gives, faster:
byte-level BPE never merges across a single space or line feed between two
other characters, nor a word with the punctuation that ends it. So a text is
cut there, each distinct word goes to the library once, and the ids are joined
again with array gathers. Texts where white space touches white space, and
those that hold the string of an added token or one of the two control
characters that mark pieces, go to the library whole.

File format (one Parquet row per block, ordered by ``part, seq``; a block is a
run of whole documents): ``payload`` is ``DMT1``, little-endian uint32 counts
of documents and ids, int64 document ids, uint32 lengths, a validity byte per
document id, then control bytes and data bytes. Ids are replaced by their rank
in the corpus-wide frequency order (more frequent first, then the smaller id).
A rank takes 1 to 4 data bytes; two bits in a control byte tell how many, four
ranks to a control byte, so the frequent ids take one byte. A second table
holds the rank order. Reading looks lengths up in a 256 x 4 table and gathers.

Defined results: a null text counts as empty, an empty text has the end id
alone, a null document id sorts first and comes back null, repeated rows are
encoded each, an empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

import re
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import materialise, new_path
from .worker_memory import give_back

MAGIC = b"DMT1"
END_ID = 2
BLOCK_IDS = 1 << 18
#: Words, and pieces with their punctuation, that a worker remembers; the memory is bounded whatever the corpus.
MEMO_WORDS = 400_000
MEMO_PIECES = 900_000
SLICE_BYTES = 8 << 20
#: New pieces of a slice become Python strings, and its pieces ids, so many at a time.
NEW_PIECES, JOINED_PIECES = 1 << 15, 1 << 17
_SPACE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_WHOLE = f"[{_SPACE}][{_SPACE}]|[\x01\x02]"
_encoders: dict[str, "TextEncoder"] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on, in order."""
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in same]
    return {b: chr(b) for b in same} | {b: chr(256 + k) for k, b in enumerate(rest)}


def gather(pool: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Stretches of ``pool``, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(pool)) < 1 << 31 else np.int64
    at = np.repeat((begins - ends + lengths).astype(kind), lengths)
    at += np.arange(total, dtype=kind)
    return pool[at]


class Memory:
    """Ids of numbered items, end to end in one array, and how often each item was met."""

    def __init__(self, dtype: np.dtype):
        self.n, self.begins, self.hits, self.pool = 0, np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, dtype)

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Numbers of the new items."""
        n, used = self.n, int(self.begins[self.n])
        for name, size in (("begins", n + len(lengths) + 1), ("hits", n + len(lengths) + 1), ("pool", used + len(ids))):
            held = getattr(self, name)
            if size > len(held):
                setattr(self, name, np.concatenate([held, np.zeros(max(size - len(held), len(held)), held.dtype)]))
        self.begins[n + 1 : n + 1 + len(lengths)] = used + np.cumsum(lengths)
        self.pool[used : used + len(ids)] = ids
        self.n += len(lengths)
        return np.arange(n, self.n)

    def lengths(self, at: np.ndarray) -> np.ndarray:
        return self.begins[at + 1] - self.begins[at]

    def shrink(self, most: int) -> np.ndarray:
        """Keep the items met most often, at most half of ``most``; their old numbers in the new order."""
        order = np.argsort(-self.hits[: self.n], kind="stable")[: most // 2]
        keep = np.sort(order[self.hits[order] > 1])
        hits, sizes = self.hits[keep] // 2, self.lengths(keep)
        ids = gather(self.pool, self.begins[keep], sizes)
        self.n, self.hits[:] = 0, 0
        self.add(ids, sizes)
        self.hits[: self.n] = hits
        return keep


class TextEncoder:
    """Ids of texts, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    Pieces (what stands between spaces or line feeds) are looked up with Arrow
    in those met before. Only new pieces become Python strings; they are parted
    into word and punctuation, and words are looked up in turn.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.whole = "|".join([_WHOLE, *(re.escape(t.content) for t in self.library.get_added_tokens_decoder().values())])
        self.letters = byte_letters()
        self.dtype = np.dtype("<u2") if self.library.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.words, self.known = Memory(self.dtype), {}
        self.pieces, self.names = Memory(self.dtype), pa.array([], pa.string())
        self._learn(["", "\n"])

    @classmethod
    def shared(cls, path: str) -> "TextEncoder":
        """The worker's encoder: its memory outlives a task."""
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def _learn(self, words: list[str]) -> None:
        """Ask for new words.

        A run of letters, with or without a space before it, is one unit of the
        tokenizer's pre-tokenisation and goes straight to the library's model;
        anything else goes through the whole library.
        """
        runs = [w for w in words if (bare := w[1:] if w[:1] == " " else w).isalpha() and (w.isascii() or max(bare) < "\u0530")]
        tokenize, letters, space = self.library.model.tokenize, self.letters, self.letters[32]
        # ASCII letters stand for themselves in the byte alphabet
        spelt = [w.replace(" ", space) if w.isascii() else w.encode().decode("latin-1").translate(letters) for w in runs]
        ids, ends = [], []
        for w in spelt:
            ids += [t.id for t in tokenize(w)]
            ends.append(len(ids))
        if len(runs) < len(words):
            direct = set(runs)
            rest = [w for w in words if w not in direct]
            for e in self.library.encode_batch_fast(rest, add_special_tokens=False):
                ids += e.ids
                ends.append(len(ids))
            runs += rest
        numbers = self.words.add(np.array(ids, self.dtype), np.diff(np.array(ends, np.int64), prepend=0))
        self.known.update(zip(runs, numbers.tolist()))

    @staticmethod
    def _parts(name: str) -> tuple[str, str, str]:
        """Line feed or nothing, word, and the ASCII punctuation after it, which never merges with it."""
        mark = name[:1]
        piece = name[1:] if mark in ("\x01", "\x02") else " " + name
        word = piece.rstrip(punctuation)
        last = word[-1:]
        fed = "\n" if mark == "\x01" else ""
        return (fed, word, piece[len(word) :]) if last.isalnum() and last < "\u0530" else (fed, piece, "")

    def _add_pieces(self, names: pa.Array) -> np.ndarray:
        words = [" " + name for name in names.to_pylist()]
        extra = []
        for i, word in enumerate(words):
            if not word[1:].isalpha():
                fed, words[i], tail = self._parts(word[1:])
                if fed or tail:
                    extra.append((i, fed, tail))
        wanted = [*words, *(f for _, f, _ in extra), *(t for _, _, t in extra)]
        if new := [w for w in dict.fromkeys(wanted) if w not in self.known]:
            self._learn(new)
        at = np.full((len(words), 3), self.known[""], np.int64)
        at[:, 1] = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        for column, side in ((0, 1), (2, 2)):
            at[[x[0] for x in extra], column] = [self.known[x[side]] for x in extra]
        at = at.ravel()
        self.words.hits[at] += 1
        sizes = self.words.lengths(at)
        return self.pieces.add(gather(self.words.pool, self.words.begins[at], sizes), sizes.reshape(-1, 3).sum(axis=1))

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.pieces.n > MEMO_PIECES:
            self.names = self.names.take(pa.array(self.pieces.shrink(MEMO_PIECES)))
        if self.words.n > MEMO_WORDS:
            held = list(self.known)
            self.known = {held[i]: k for k, i in enumerate(self.words.shrink(MEMO_WORDS).tolist())}
            self._learn([w for w in ("", "\n") if w not in self.known])
        lists = pc.split_pattern(pc.binary_join_element_wise("\x02", pc.replace_substring(texts, "\n", " \x01"), ""), " ")
        coded = lists.flatten().dictionary_encode()
        # the hash table is that of the slice's pieces, which are fewer than those remembered
        found = pc.fill_null(pc.index_in(self.names, value_set=coded.dictionary), -1).to_numpy(zero_copy_only=False)
        at, met = np.full(len(coded.dictionary), -1, np.int64), np.flatnonzero(found >= 0)
        at[found[met]] = met
        new = np.flatnonzero(at < 0)
        if len(new):
            names = coded.dictionary.take(pa.array(new))
            at[new] = np.concatenate([self._add_pieces(names.slice(k, NEW_PIECES)) for k in range(0, len(new), NEW_PIECES)])
            self.names = pa.concat_arrays([self.names, names])
        self.pieces.hits[at] += 1
        indices, firsts = coded.indices.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
        ids, lengths = [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)]
        for k in range(0, len(indices), JOINED_PIECES):
            some = at[indices[k : k + JOINED_PIECES]]
            lengths.append(self.pieces.lengths(some))
            ids.append(gather(self.pieces.pool, self.pieces.begins[some], lengths[-1]))
        per_text = np.add.reduceat(np.concatenate(lengths), firsts) if len(firsts) else np.zeros(0, np.int64)
        return np.concatenate(ids), per_text

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of ids of each."""
        texts = pc.fill_null(texts.cast(pa.large_string()).cast(pa.string()), "")
        whole = pc.match_substring_regex(texts, self.whole)
        if not pc.any(whole).as_py():
            return self._pieces(texts)
        flags = whole.to_numpy(zero_copy_only=False)
        ids, lengths = self._pieces(texts.filter(pc.invert(whole))) if not flags.all() else (np.zeros(0, self.dtype), np.zeros(0, np.int64))
        ends, parts, sizes, k = np.cumsum(lengths), [], [], 0
        for i, is_whole in enumerate(flags):
            if is_whole:
                parts.append(np.array(self.library.encode(texts[i].as_py(), add_special_tokens=False).ids, self.dtype))
            else:
                parts.append(ids[ends[k] - lengths[k] : ends[k]])
                k += 1
            sizes.append(len(parts[-1]))
        return np.concatenate(parts), np.array(sizes, np.int64)


def slices(batch: pa.RecordBatch, text: str):
    """Parts of ``batch`` of about SLICE_BYTES of text, at least a row each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def encoded(batches, path: str, end_id: int):
    """``(ids column, id arrays with the end id)`` for every slice of the batches' ``id, body`` columns."""
    encoder = TextEncoder.shared(path)
    for batch in batches:
        for part in slices(batch, "body"):
            ids, lengths = encoder.encode(part.column("body"))
            give_back()
            ends = np.cumsum(lengths)
            yield part.column("id"), [np.append(ids[e - n : e], ids.dtype.type(end_id)) for e, n in zip(ends, lengths)]
        give_back()


# Byte-aligned codes: control byte -> the four code lengths.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of non-negative ranks below 2**32."""
    ranks = ranks.astype(np.uint32)
    code = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(code) // 4) * 4, np.uint8)
    padded[: len(code)] = code
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    as_bytes = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.tobytes(), as_bytes[np.arange(4) <= code[:, None]].tobytes()


def unpack_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ranks, by lookup of each control byte's lengths."""
    lengths = LENGTHS[control].reshape(-1)[:n]
    at = np.cumsum(lengths) - lengths
    padded = np.concatenate([data, np.zeros(4, np.uint8)])
    out = padded[at].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(lengths > k)
        out[longer] |= padded[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def to_payload(doc_ids: list, lengths: np.ndarray, ranks: np.ndarray) -> bytes:
    control, data = pack_ranks(ranks)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    head = np.array([len(doc_ids), len(ranks)], "<u4").tobytes()
    return MAGIC + head + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + lengths.astype("<u4").tobytes() + known.tobytes() + control + data


def from_payload(payload: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, lengths and ranks of a block."""
    if payload[:4] != MAGIC:
        raise ValueError("not a token block")
    docs, n = (int(x) for x in np.frombuffer(payload, "<u4", 2, 4))
    at = 12
    ids = np.frombuffer(payload, "<i8", docs, at).tolist()
    lengths = np.frombuffer(payload, "<u4", docs, at := at + 8 * docs)
    known = np.frombuffer(payload, np.uint8, docs, at := at + 4 * docs)
    control = np.frombuffer(payload, np.uint8, -(-n // 4), at := at + docs)
    data = np.frombuffer(payload, np.uint8, -1, at + len(control))
    return [d if k else None for d, k in zip(ids, known)], lengths, unpack_ranks(control, data, n)


def _raw_blocks(batches, path: str, end_id: int):
    from pyspark import TaskContext

    part, seq, ids, arrays, size = TaskContext.get().partitionId(), 0, [], [], 0

    def block():
        joined = np.concatenate(arrays)
        return pa.RecordBatch.from_pydict(
            {"part": [part], "seq": [seq], "n_ids": [len(joined)], "doc_ids": [ids], "lengths": [[len(a) for a in arrays]], "ids": [joined.tobytes()]},
            schema=pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("ids", pa.binary())]),
        )

    for names, found in encoded(batches, path, end_id):
        for name, array in zip(names.to_pylist(), found):
            if arrays and size + len(array) > BLOCK_IDS:
                yield block()
                seq, ids, arrays, size = seq + 1, [], [], 0
            ids.append(name)
            arrays.append(array)
            size += len(array)
    if arrays:
        yield block()


def write_tokens(df: DataFrame, out: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END_ID) -> None:
    """Tokenise ``df`` in ascending id order and write token files to ``out``.

    ``out/blocks`` and ``out/ranks``. Each text is tokenised once; raw ids go
    to a scratch table while frequencies over the whole corpus are counted.
    """
    path = path or default_tokenizer()
    spark = df.sparkSession
    width = TextEncoder.shared(path).dtype.str
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    # rows of one id, or without one, are dealt by their text
    rows = rows.withColumn("own", F.xxhash64("body")).repartitionByRange("id", "own").sortWithinPartitions("id", "own").drop("own")
    raw = materialise(rows.mapInArrow(lambda b: _raw_blocks(b, path, end_id), "part int, seq long, n_ids long, doc_ids array<long>, lengths array<long>, ids binary"), "raw-ids")

    def counts(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids in batch.column("ids"):
                found = np.bincount(np.frombuffer(ids.as_py(), width))
                if len(found) > len(total):
                    total, found = found, total
                total[: len(found)] += found
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"token": pa.array(seen, pa.int64()), "n": pa.array(total[seen], pa.int64())})

    # at most a row for each id of the vocabulary
    freq = raw.select("ids").mapInArrow(counts, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    order = np.array([r["token"] for r in sorted(freq, key=lambda r: (-r["n"], r["token"]))], np.int64)
    rank_of = np.zeros(int(order.max()) + 1 if len(order) else 1, np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank_of)

    def pack(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ranks = shared.value[np.frombuffer(row["ids"], width)]
                yield pa.RecordBatch.from_pydict(
                    {"part": [row["part"]], "seq": [row["seq"]], "n_ids": [row["n_ids"]], "payload": [to_payload(row["doc_ids"], np.array(row["lengths"]), ranks)]},
                    schema=pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())]),
                )

    raw.mapInArrow(pack, "part int, seq long, n_ids long, payload binary").write.option("compression", "none").parquet(f"{out}/blocks")
    ranks = spark.createDataFrame([(i, int(t)) for i, t in enumerate(order)], "rank long, token long").coalesce(1)
    ranks.write.parquet(f"{out}/ranks")


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """``doc_id, start, ids`` (little-endian uint32 bytes) from token files.

    ``start`` counts the ids of all documents before. Parts are summed first,
    so the running sum within a part is over its blocks alone.
    """
    order = np.array([r["token"] for r in spark.read.schema("rank long, token long").parquet(f"{out}/ranks").orderBy("rank").collect()], np.uint32)
    shared = spark.sparkContext.broadcast(order)
    blocks = spark.read.schema("part int, seq long, n_ids long, payload binary").parquet(f"{out}/blocks")
    index = blocks.select("part", "seq", "n_ids")
    parts = index.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(W.partitionBy(F.lit(1)).orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("part_start"))
    within = index.withColumn("in_part", F.sum("n_ids").over(W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)) - F.col("n_ids"))
    starts = materialise(within.join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("in_part")).alias("block_start")), "block-starts")

    def unpack(batches):
        for batch in batches:
            for row in batch.to_pylist():
                docs, lengths, ranks = from_payload(row["payload"])
                ids = shared.value[ranks].astype("<u4")
                ends = np.cumsum(lengths, dtype=np.int64)
                for lo in range(0, len(docs), 1024):
                    hi = min(len(docs), lo + 1024)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(docs[lo:hi], pa.int64()),
                            "start": pa.array(row["block_start"] + ends[lo:hi] - lengths[lo:hi], pa.int64()),
                            "ids": pa.array([ids[e - n : e].tobytes() for e, n in zip(ends[lo:hi], lengths[lo:hi])], pa.binary()),
                        }
                    )

    return blocks.join(starts, ["part", "seq"]).select("block_start", "payload").mapInArrow(unpack, "doc_id long, start long, ids binary")


def token_digest(df: DataFrame) -> DataFrame:
    """Write the documents of ``df`` as token files and summarise what is read back."""
    spark = df.sparkSession
    out = new_path(spark, "tokens")
    write_tokens(df, out)
    back = read_tokens(spark, out)
    return back.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
