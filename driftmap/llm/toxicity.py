"""Toxicity by a counterfactual-regularised classifier.

A logistic model over words, word beginnings and how often these occur. Each
labelled text that names an identity group is paired with its twin, in which
the group's term is swapped for another one. A share of the texts that name
none (``MENTIONS``, picked by a hash) is paired as well: with one term of a set
inserted, and with another. The loss adds the squared difference of the two
scores of a pair, so a group's mention as such does not move a score, be it by
its term or by a beginning that it shares with an abusive word. The terms
themselves are always features. Labels reach the fit from a bounded sample; scores
cover whole texts.

The sample has at most ``max_labels`` rows (``MAX_LABELS`` by default), picked by
a hash among the rows that may train. Features are counted on the executors
over the sample; the ``MAX_FEATURES`` of greatest chi-square among those in at
least ``MIN_TEXTS`` texts make the model, so rare words cannot memorise a label.
The driver gets the numbers of the chosen features of each sample row, and the
weights of the model, a table of that fixed size, are broadcast.

Defined results: a null, empty or wordless text scores what the intercept
gives; without labels, or with one class only, every score is the smoothed
share of toxic labels; a label row repeated for an id counts once, toxic if any
is; rows with a null label or id do not train; repeated rows are scored each;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import materialise

MAX_LABELS = 12_000
MAX_FEATURES = 1_024
MIN_TEXTS = 4
MENTIONS = 0.25
MEMO_WORDS = 300_000
BEGINNINGS = (3, 4, 5, 6)
TIMES = (1, 2, 4)
#: Terms of the same set may stand for one another.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrant", "native", "refugee", "foreigner"),
    ("immigrants", "natives", "refugees", "foreigners"),
    ("mujeres", "hombres"), ("femmes", "hommes"), ("frauen", "männer"),
)
_SWAPS = {term: others for group in IDENTITY for term in group for others in [tuple(t for t in group if t != term)]}
_WORD = re.compile(r"\w+", re.UNICODE)


def held_out(id_col: Column) -> Column:
    """Rows that never train: the remainder of crc32 of the id as text by 4 is 2."""
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def swapped(words: list[str]) -> list[str] | None:
    """The words with every identity term replaced by another of its set; None if there is no term."""
    if not any(w in _SWAPS for w in words):
        return None
    pick = zlib.crc32(" ".join(words[:50]).encode())
    return [_SWAPS[w][pick % len(_SWAPS[w])] if w in _SWAPS else w for w in words]


def mentioned(words: list[str], share: float) -> tuple[list[str], list[str]] | None:
    """The words with one and with another term of a set, for a ``share`` of all texts."""
    pick = zlib.crc32(("mention " + " ".join(words[:50])).encode())
    if pick % 1000 >= 1000 * share:
        return None
    group = IDENTITY[pick // 1000 % len(IDENTITY)]
    first = pick // 50_000 % len(group)
    second = (first + 1 + pick // 300_000 % (len(group) - 1)) % len(group)
    return [*words, group[first]], [*words, group[second]]


def features(words: list[str]) -> set[str]:
    """Distinct words, and the beginnings of longer words that occur at least so many times (``stem-``, ``stem-2``, ``stem-4``)."""
    counts = Counter(words)
    out = set(counts)
    for n in BEGINNINGS:
        stems: Counter = Counter()
        for w, k in counts.items():
            if len(w) > n:
                stems[w[:n]] += k
        out.update([f + "-" for f in stems])
        for least in TIMES[1:]:
            out.update([f"{f}-{least}" for f, k in stems.items() if k >= least])
    return out


class Model:
    """Weights by feature, and the intercept, of the logistic model."""

    def __init__(self, weights: dict[str, float], intercept: float):
        self.weights, self.intercept = weights, intercept
        self.levels: dict[str, list[tuple[int, float]]] = {}
        for name, weight in weights.items():
            stem, mark, least = name.rpartition("-")
            if mark:
                self.levels.setdefault(stem, []).append((int(least or 1), weight))
        self.memo: dict[str, tuple[float, list[str]]] = {}

    def _learn(self, word: str) -> tuple[float, list[str]]:
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        stems = [word[:n] for n in BEGINNINGS if len(word) > n and word[:n] in self.levels]
        self.memo[word] = self.weights.get(word, 0.0), stems
        return self.memo[word]

    def score(self, words: list[str]) -> float:
        margin, met, memo = self.intercept, {}, self.memo
        for word, k in Counter(words).items():
            weight, stems = memo.get(word) or self._learn(word)
            margin += weight
            for stem in stems:
                met[stem] = met.get(stem, 0) + k
        for stem, k in met.items():
            for least, weight in self.levels[stem]:
                if k >= least:
                    margin += weight
        return float(1 / (1 + np.exp(-np.clip(margin, -30, 30))))


def fit_weights(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, fairness: float = 50.0, ridge: float = 1.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent on log loss + ``ridge`` / 2 * |w|**2 + ``fairness`` * (score - score of the swapped text)**2.

    ``x, y`` are the labelled rows; rows of ``a`` and ``b`` are the texts with
    identity terms and their swapped twins, which have a's labels and are not
    in ``y`` again.
    """
    share = (y.sum() + 1) / (len(y) + 2)
    w, bias = np.zeros(x.shape[1], np.float32), float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return w, bias
    sig = lambda m: 1 / (1 + np.exp(-np.clip(m, -30, 30)))
    single = lambda v: np.asarray(v, np.float32)
    power = np.ones(x.shape[1], np.float32)
    for _ in range(15):
        power = x.T @ (x @ power)
        power /= np.linalg.norm(power) + 1e-12
    rate = 1 / (0.25 * (float(np.linalg.norm(x.T @ (x @ power))) + len(y)) + ridge + fairness * 0.25 * (float(np.square(a - b).sum()) if len(a) else 0))
    at, at_bias, old, old_bias, t = w, bias, w, bias, 1.0
    for _ in range(steps):
        slope = sig(x @ at + at_bias) - y
        grad, grad_bias = x.T @ single(slope) + ridge * at, slope.sum()
        if len(a):
            p, q = sig(a @ at + at_bias), sig(b @ at + at_bias)
            gap, dp, dq = 2 * fairness * (p - q), p * (1 - p), q * (1 - q)
            grad, grad_bias = grad + a.T @ single(gap * dp) - b.T @ single(gap * dq), grad_bias + (gap * (dp - dq)).sum()
        w, bias = single(at - rate * grad), at_bias - rate * grad_bias
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        at, at_bias = single(w + (t - 1) / t_next * (w - old)), bias + (t - 1) / t_next * (bias - old_bias)
        old, old_bias, t = w, bias, t_next
    return w, float(bias)


def _count(batches):
    """Per partition: in how many texts each feature stands, and in how many toxic ones."""
    n, t = Counter(), Counter()
    for batch in batches:
        for text, toxic in zip(batch.column("body"), batch.column("toxic").to_pylist()):
            found = features(words_of(text.as_py()))
            n.update(found)
            if toxic:
                t.update(found)
    names = list(n)
    for lo in range(0, len(names), 50_000):
        part = names[lo : lo + 50_000]
        yield pa.RecordBatch.from_pydict({"feature": part, "n": pa.array([n[f] for f in part], pa.int64()), "t": pa.array([t[f] for f in part], pa.int64())})


def _numbers(vocabulary: dict[str, int], mentions: float):
    kind = pa.schema([("toxic", pa.int32()), ("own", pa.list_(pa.int32())), ("one", pa.list_(pa.int32())), ("twin", pa.list_(pa.int32()))])
    known = vocabulary.keys()

    def run(batches):
        for batch in batches:
            out = []
            for text, toxic in zip(batch.column("body"), batch.column("toxic").to_pylist()):
                words = words_of(text.as_py())
                twin = swapped(words)
                pair = (words, twin) if twin else mentioned(words, mentions)
                number = lambda w: sorted(vocabulary[f] for f in features(w) & known)
                out.append((toxic, number(words), *(map(number, pair) if pair else (None, None))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kind)], schema=kind)

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", max_labels: int = MAX_LABELS, mentions: float = MENTIONS, **options) -> Model:
    """Fit on at most ``max_labels`` labelled rows that are not held out, picked by a hash of the id.

    ``mentions`` is the share of texts without a group that are paired by inserted terms.
    """
    y = labels.where(F.col(toxic_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(toxic_col).cast("int")).alias("toxic"))
    chosen = y.orderBy(F.xxhash64("id"), "id").limit(max_labels)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    # at most max_labels ids are broadcast
    sample = materialise(d.join(F.broadcast(chosen), "id").select("body", "toxic"), "labelled")
    size = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    n, t = size["n"], size["t"]
    counts = sample.mapInArrow(_count, "feature string, n long, t long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).where(F.col("n") >= MIN_TEXTS)
    gap = F.col("t").cast("double") * n - F.col("n").cast("double") * t
    chi = gap * gap / (F.col("n") * (n + 1 - F.col("n")))
    best = counts.orderBy(chi.desc(), "feature").limit(MAX_FEATURES).collect()
    vocabulary = {f: k for k, f in enumerate(dict.fromkeys([*(r["feature"] for r in best), *_SWAPS]))}
    rows = sample.mapInArrow(_numbers(vocabulary, mentions), "toxic int, own array<int>, one array<int>, twin array<int>").collect()
    rows.sort(key=lambda r: (r["own"], r["toxic"]))

    def table(lists: list) -> np.ndarray:
        x = np.zeros((len(lists), len(vocabulary)), np.float32)
        for k, numbers in enumerate(lists):
            x[k, numbers] = 1
        return x

    paired = [r for r in rows if r["twin"] is not None]
    w, bias = fit_weights(table([r["own"] for r in rows]), np.array([r["toxic"] for r in rows], float), table([r["one"] for r in paired]), table([r["twin"] for r in paired]), **options)
    return Model({f: float(w[k]) for f, k in vocabulary.items()}, bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score`` of every row, a pass over the table without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            scores = [shared.value.score(words_of(t.as_py())) for t in batch.column("body")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores, pa.float64())], ["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    return rows.mapInArrow(run, T.StructType([rows.schema["id"], T.StructField("score", T.DoubleType())]))
