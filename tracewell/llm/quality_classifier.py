"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are grown level by level on binned statistics and flattened into arrays (feature, threshold, left child, value),
through which a batch of documents is sent for all trees at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import crc_id, small_batches

FEATURES = (
    "log_chars", "log_words", "word_length", "distinct_words", "repeats_last", "commonest_word", "upper", "digit", "space", "non_ascii",
    "symbol", "exclaim", "bar", "stop", "comma", "line_end", "log_lines", "distinct_lines", "ends_marked", "entropy", "last_letter",
)
_BYTES = np.arange(256)
_CLASSES = np.stack(
    [
        (_BYTES >= 65) & (_BYTES <= 90),
        (_BYTES >= 48) & (_BYTES <= 57),
        np.isin(_BYTES, list(b" \t\n\v\f\r")),
        _BYTES >= 128,
        np.isin(_BYTES, list(b"#*$%&<>@^~_=+\\{}[]")),
        _BYTES == ord("!"),
        _BYTES == ord("|"),
        _BYTES == ord("."),
        _BYTES == ord(","),
        _BYTES == 10,
    ]
).astype(np.float64)


def statistics(text: bytes | None) -> np.ndarray:
    """The FEATURES of one whole text; null texts count as empty, whose shares are all 0."""
    text = text or b""
    out = np.zeros(len(FEATURES))
    if not text:
        return out
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256).astype(np.float64)
    n = len(text)
    shares = _CLASSES @ counts / n
    p = counts[counts > 0] / n
    words, lines = text.split(), text.split(b"\n")
    k = max(1, len(words))
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    again = sum(map(bytes.__eq__, words[1:], words[:-1]))
    marked = sum(x.endswith((b".", b"!", b"?", b":")) for x in lines)
    letters = sum(w[-1] >= 97 or 65 <= w[-1] <= 90 for w in words)
    out[:6] = np.log1p(n), np.log1p(len(words)), (n - counts[[9, 10, 11, 12, 13, 32]].sum()) / k, len(seen) / k, again / k, max(seen.values(), default=0) / k
    out[6:16] = shares
    out[16:] = np.log1p(len(lines)), len(set(lines)) / len(lines), marked / len(lines), -(p * np.log2(p)).sum(), letters / k
    return out


@dataclass
class BoostedTrees:
    """All trees in one set of arrays; ``left`` points to the left child, the right one follows it; leaves point to themselves."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    leaf: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth if len(self.roots) else 0):
            right = x[rows, self.feature[at]] > self.threshold[at]
            at = np.where(self.leaf[at], at, self.left[at] + right)
        return 1 / (1 + np.exp(-np.clip(self.base + self.value[at].sum(1), -40, 40)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 1.0, least: float = 1.0) -> BoostedTrees:
    """Logistic loss; without rows the score is 0.5, with one class it stays near that class's share."""
    n, k = x.shape
    share = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) if n else np.zeros(0) for j in range(k)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1) if n else np.zeros((0, k), np.int64)
    raw = np.full(n, base)
    feature, threshold, left, leaf, value, roots = [], [], [], [], [], []

    def new(v: float) -> int:
        for a, b in ((feature, 0), (threshold, 0.0), (left, 0), (leaf, True), (value, v)):
            a.append(b)
        return len(value) - 1

    for _ in range(trees if n and 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        level = [new(rate * g.sum() / (h.sum() + ridge))]
        roots.append(level[0])
        place = np.zeros(n, np.int64)  # within the level; -1 in finished leaves
        at = np.full(n, level[0])
        for _ in range(depth):
            live = np.flatnonzero(place >= 0)
            if not len(live):
                break
            m = len(level)
            best = np.full(m, 1e-6)
            pick = np.full((m, 2), -1)
            for j in range(k):
                key = place[live] * (bins + 1) + binned[live, j]
                gs = np.bincount(key, g[live], m * (bins + 1)).reshape(m, -1).cumsum(1)
                hs = np.bincount(key, h[live], m * (bins + 1)).reshape(m, -1).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(hs < least) | (ht - hs < least)] = 0
                gain[:, len(cuts[j]) :] = 0
                top = gain.argmax(1)
                won = gain[np.arange(m), top] > best
                best[won] = gain[np.arange(m), top][won]
                pick[won] = np.stack([np.full(m, j), top], 1)[won]
            following, moved = [], np.full(n, -1)
            for i, node in enumerate(level):
                j, b = pick[i]
                if j < 0:
                    continue
                rows = live[place[live] == i]
                right = binned[rows, j] > b
                ends = []
                for side in (rows[~right], rows[right]):
                    ends.append(new(rate * g[side].sum() / (h[side].sum() + ridge)))
                    moved[side] = len(following)
                    at[side] = ends[-1]
                    following.append(ends[-1])
                feature[node], threshold[node], left[node], leaf[node] = int(j), float(cuts[j][b]), ends[0], False
            level, place = following, moved
        raw = raw + np.array(value)[at]
    return BoostedTrees(base, np.array(roots, np.int64), np.array(feature, np.int64), np.array(threshold), np.array(left, np.int64), np.array(leaf, bool), np.array(value), depth)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _statistics(texts: pa.Array) -> pa.Array:
    return pa.array([statistics(t).tolist() for t in texts.cast(pa.binary()).to_pylist()], pa.list_(pa.float64()))


def learn_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> BoostedTrees:
    """Fits on at most ``max_rows`` labelled documents, the same ones at every run (chosen by hashes).

    Ids with several labels count as good if their mean is at least 0.5. Null labels and ids are left out; null texts count
    as empty. Without any labelled document every score will be 0.5. Only doc_id and text are read.
    """
    small_batches(docs.sparkSession)
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # max_rows rows at most
    found = rows.select(F.xxhash64("doc_id", "text").alias("h"), "y", _statistics("text").alias("x")).orderBy("h", "y").limit(max_rows).collect()
    x = np.array([r.x for r in found]).reshape(-1, len(FEATURES))
    return fit_trees(x, np.array([r.y for r in found]))


def score_quality(docs: DataFrame, model: BoostedTrees, name: str = "score") -> DataFrame:
    """Adds the probability that a document is good; an existing column of that name is replaced.

    Null texts are scored as empty ones, equal texts alike, whole texts at any length; an empty table gives an empty
    result.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred KB at most, by trees and depth

    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            x = np.array([statistics(t) for t in batch.cast(pa.binary()).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.array(shared.value.score(x), pa.float64())

    work.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(name, F.arrow_udf(work, T.DoubleType())("text"))


#: Documents below this score are rejected.
LEAST_SCORE = 0.3


def training_labels(labels: DataFrame) -> DataFrame:
    """The labels that may be learned from: those of four fifths of the ids."""
    return labels.filter(crc_id() % 5 != 0)


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Every document's score by trees fitted on the labels of four fifths of the ids; null ids count as the empty text, which is held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = learn_quality(docs, training_labels(labels))
    return score_quality(docs, model).select("doc_id", (crc_id() % 5 == 0).alias("held_out"), "score", (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted"))
