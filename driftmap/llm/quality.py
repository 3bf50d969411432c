"""Quality rules from the suffix array of a document's words.

The suffix array is built by prefix doubling over word numbers. The ranks of
every doubling are kept, so the longest common prefix of neighbouring suffixes
comes from a few array comparisons instead of a word-by-word walk. Intervals of
that array whose occurrences differ in the word before are the maximal repeated
substrings. Two limits apply to those of at least ``min_repeat`` words: the
fraction of words that the union of their spans covers, and the longest one.

Documents are independent, so the work is one pass over the table without a
shuffle, and memory is bounded by the longest document.

Defined results: a null or wordless text has no words and fails; repeated rows
are judged each; an empty table gives an empty result; ``judge`` ignores other
columns and ``keep_good`` returns them as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .worker_memory import give_back

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
MIN_WORDS = 50
MIN_REPEAT = 8
MAX_COVERED = 0.30
MAX_REPEAT = 60


def word_numbers(words: list) -> np.ndarray:
    """A number for each word, the same for equal words."""
    seen: dict = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and the common prefix length of each suffix with the one before it in that order."""
    n = len(ids)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank, ranks, k = ids, [], 1
    padded = np.full(n + 1, -1, np.int64)
    padded[:n] = rank
    ranks.append(padded)
    order = np.argsort(rank, kind="stable")
    while k < n:
        follow = np.full(n, 0, np.int64)
        follow[: n - k] = ranks[-1][k:n] + 1
        key = ranks[-1][:n] * (n + 1) + follow
        order = np.argsort(key, kind="stable")
        steps = np.diff(key[order]) != 0
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(steps)])
        padded = np.full(n + 1, -1, np.int64)
        padded[:n] = rank
        ranks.append(padded)
        k *= 2
        if steps.all():
            break
    lcp = np.zeros(n, np.int64)
    a, b = order[:-1], order[1:]
    common = np.zeros(n - 1, np.int64)
    for j in range(len(ranks) - 1, -1, -1):
        step = 1 << j
        while True:
            same = (a + common < n) & (b + common < n)
            same[same] = ranks[j][a[same] + common[same]] == ranks[j][b[same] + common[same]]
            if not same.any():
                break
            common[same] += step
            if j < len(ranks) - 1:
                break
    lcp[1:] = common
    return order, lcp


def maximal_repeats(ids: np.ndarray, order: np.ndarray, lcp: np.ndarray, least: int) -> list[tuple[int, np.ndarray]]:
    """``(length, positions)`` of every maximal repeated substring of at least ``least`` words.

    The positions are views of ``order``: together they may be quadratic in the number of words.
    """
    found, stack = [], []
    n = len(order)
    before = np.where(order > 0, ids[order - 1], -1 - order) if n else order
    changes = np.append(0, np.cumsum(np.diff(before) != 0))
    for i in range(1, n + 1):
        height, left = (int(lcp[i]) if i < n else 0), i - 1
        while stack and stack[-1][0] > height:
            length, left = stack.pop()
            if changes[i - 1] > changes[left]:
                found.append((length, order[left:i]))
        if height >= least and (not stack or stack[-1][0] < height):
            stack.append((height, left))
    return found


def covered(n: int, starts: np.ndarray, lengths: np.ndarray) -> int:
    """How many of ``n`` places the spans cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return int((np.cumsum(edge[:n]) > 0).sum())


def measure(text: str | None, min_repeat: int = MIN_REPEAT) -> tuple[int, int, int, int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_repeats, n_covered, longest`` of a text."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    repeated_lines = len(lines) - len(set(lines))
    if n < 4:
        return n, chars, symbols, repeated_lines, 0, 0, 0, 0
    ids = word_numbers(words)
    order, lcp = suffix_array(ids)
    reach = np.maximum(lcp, np.append(lcp[1:], 0))
    hit = reach >= 3
    repeat_words = covered(n, order[hit], reach[hit]) if hit.any() else 0
    longest = int(lcp.max())
    if longest < min_repeat:
        return n, chars, symbols, repeated_lines, repeat_words, 0, 0, longest
    spans = maximal_repeats(ids, order, lcp, min_repeat)
    # the longest repeat at each place covers what all maximal repeats cover: one that is not maximal lies in a longer one further left
    hit = reach >= min_repeat
    return n, chars, symbols, repeated_lines, repeat_words, len(spans), covered(n, order[hit], reach[hit]), longest


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_repeats", "n_covered", "longest")


def _measured(df: DataFrame, text_col: str, min_repeat: int, prefix: str) -> DataFrame:
    """``df`` with the measures of its texts as further columns, whose names start with ``prefix``."""
    at = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            rows = [measure(t.as_py(), min_repeat) for t in batch.column(at)]
            columns = list(zip(*rows)) if rows else [[] for _ in MEASURES]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in columns)], names=[*batch.schema.names, *(prefix + m for m in MEASURES)])
        give_back()

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *(T.StructField(prefix + m, T.LongType()) for m in MEASURES)]))


def _verdict(prefix: str, max_covered: float, max_repeat: int) -> tuple[Column, Column]:
    m = {name: F.col(prefix + name) for name in MEASURES}
    base = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    return base, ~base & (m["n_covered"] <= max_covered * m["n_words"]) & (m["longest"] <= max_repeat)


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row per document: its id, the measures, ``base_failed`` and ``kept``."""
    out = _measured(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")), "body", min_repeat, "")
    base, kept = _verdict("", max_covered, max_repeat)
    return out.select("id", *MEASURES, base.alias("base_failed"), kept.alias("kept"))


def keep_good(df: DataFrame, text_col: str = "text", min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The rows of ``df`` whose text passes."""
    prefix = "__"
    while any(c.lower() == prefix + m for c in df.columns for m in MEASURES):
        prefix += "_"
    _, kept = _verdict(prefix, max_covered, max_repeat)
    return _measured(df, text_col, min_repeat, prefix).where(kept).select(*df.columns)
