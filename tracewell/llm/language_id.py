"""Language identification with a string kernel.

Texts are sets of character n-grams (blended spectrum, n = 1 to 3, presence only). A Nyström map over landmark texts
turns the normalised kernel into a short feature vector, on which one ridge regression per language (one versus
rest) is fitted. Scoring is a batch of presence rows times the landmarks' presence matrix, then two small products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import crc_id, small_batches
from tracewell.session import broadcast_if_small, materialize

#: Hashed n-grams; the presence of one text takes BUCKETS / 8 bytes.
BUCKETS = 1 << 15
_SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_BLOCK = 64
_MOST_LANDMARKS = 1024


def _letters() -> np.ndarray:
    if not hasattr(_letters, "table"):
        _letters.table = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters.table


def ngrams(text: str | None) -> np.ndarray | None:
    """Sorted buckets of the text's n-grams over lower-cased letters, other characters being one space; None without letters."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    letter = _letters()[codes.astype(np.int64)]
    if not letter.any():
        return None
    codes = np.where(letter, codes, np.uint64(32))
    codes = codes[np.r_[True, (codes[1:] != 32) | (codes[:-1] != 32)]]
    codes = np.r_[np.uint64(32), codes, np.uint64(32)]
    present = np.zeros(BUCKETS, bool)
    gram = np.zeros(len(codes), np.uint64)
    for n, seed in enumerate(_SEEDS):
        gram = (gram[: len(codes) - n] << np.uint64(21)) | codes[n:]
        mixed = (gram ^ (gram >> np.uint64(29))) * seed
        present[(mixed >> np.uint64(49)).astype(np.int64)] = True
    return np.flatnonzero(present)


@dataclass
class KernelModel:
    """``landmarks``: their presence by active bucket; ``weights``: from kernel values straight to language scores."""

    languages: list[str]
    column: np.ndarray
    landmarks: np.ndarray
    norms: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def kernel(self, grams: list[np.ndarray]) -> np.ndarray:
        rows = np.zeros((len(grams), len(self.landmarks)), np.float32)
        for i, g in enumerate(grams):
            at = self.column[g]
            rows[i, at[at >= 0]] = 1
        sizes = np.sqrt(np.array([len(g) for g in grams], np.float32))
        return (rows @ self.landmarks) / (sizes[:, None] * self.norms)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        found = [ngrams(t) for t in texts]
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        known = [i for i, g in enumerate(found) if g is not None]
        if not self.languages:
            return names, scores
        for at in range(0, len(known), _BLOCK):
            part = known[at : at + _BLOCK]
            values = self.kernel([found[i] for i in part]) @ self.weights + self.bias
            soft = np.exp(4 * (values - values.max(1, keepdims=True)))
            best = values.argmax(1)
            for i, b, p in zip(part, best, soft[np.arange(len(part)), best] / soft.sum(1), strict=True):
                names[i], scores[i] = self.languages[b], float(p)
        return names, scores


def fit_kernel(grams: list[np.ndarray], langs: list[str], n_landmarks: int = 96, ridge: float = 1e-3) -> KernelModel:
    """Fits on n-gram sets; landmarks are dealt evenly over the languages, one each at least up to ``_MOST_LANDMARKS``."""
    languages = sorted(set(langs))
    if not languages:
        empty = np.zeros((0, 0), np.float32)
        return KernelModel([], np.full(BUCKETS, -1), empty, np.zeros(0), empty, np.zeros(0))
    by = {x: [i for i, y in enumerate(langs) if y == x] for x in languages}
    # the texts with most n-grams say most about a language; take turns among them
    turns = [sorted(v, key=lambda i: (-min(len(grams[i]), 400), i)) for v in by.values()]
    marks = [t[k] for k in range(max(map(len, turns))) for t in turns if k < len(t)][: max(n_landmarks, min(len(languages), _MOST_LANDMARKS))]
    active = np.unique(np.concatenate([grams[i] for i in marks]))
    column = np.full(BUCKETS, -1)
    column[active] = np.arange(len(active))
    dense = np.zeros((len(active), len(marks)), np.float32)
    for j, i in enumerate(marks):
        dense[column[grams[i]], j] = 1
    norms = np.sqrt(dense.sum(0))
    model = KernelModel(languages, column, dense, norms, np.zeros((len(marks), 1)), np.zeros(1))
    values, vectors = np.linalg.eigh(((dense.T @ dense) / np.outer(norms, norms)).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])  # the Nyström map
    features = np.concatenate([model.kernel(grams[at : at + _BLOCK]) for at in range(0, len(grams), _BLOCK)]).astype(np.float64) @ root
    target = np.where(np.array(langs)[:, None] == np.array(languages)[None], 1.0, -1.0)
    share = np.array([1 / len(by[x]) for x in langs])  # every language weighs the same
    mean_x, mean_y = (share @ features) / share.sum(), (share @ target) / share.sum()
    x, y = features - mean_x, target - mean_y
    w = np.linalg.solve((x * share[:, None]).T @ x + ridge * np.eye(x.shape[1]), (x * share[:, None]).T @ y)
    model.weights, model.bias = (root @ w).astype(np.float32), (mean_y - mean_x @ w).astype(np.float32)
    return model


@F.arrow_udf(T.BinaryType())
def _presence(texts: pa.Array) -> pa.Array:
    out = []
    for t in texts.to_pylist():
        g = ngrams(t)
        bits = np.zeros(BUCKETS, bool)
        if g is not None:
            bits[g] = True
        out.append(None if g is None else np.packbits(bits).tobytes())
    return pa.array(out, pa.binary())


def learn_languages(docs: DataFrame, per_language: int = 300, max_rows: int = 30_000) -> KernelModel:
    """Fits on at most ``per_language`` texts of every value of ``lang``, fewer where that exceeds ``max_rows`` in all,
    one at least.

    Texts are chosen by a hash of id and text, so reruns choose the same. Only presence bits (4 KB a text) reach the
    driver, so very long texts cost it no more than short ones. Rows with a null text or lang teach nothing; a table
    without others gives a model that knows no language. Other columns may have any name.
    """
    small_batches(docs.sparkSession)
    labelled = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = materialize(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    each = max(1, min(per_language, max_rows // max(1, sizes.count())))
    share = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    few = labelled.withColumn("share", share).join(broadcast_if_small(sizes, 100_000), "lang").filter(F.col("share") * F.col("n") < 2 * each + 20)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("share", "doc_id"))
    sample = few.withColumn("rank", rank).filter(F.col("rank") <= each).select("lang", _presence("text").alias("bits"))
    rows = sample.filter("bits is not null").orderBy("lang", "bits").collect()
    return fit_kernel([np.flatnonzero(np.unpackbits(np.frombuffer(r.bits, np.uint8))) for r in rows], [r.lang for r in rows])


def identify_languages(docs: DataFrame, model: KernelModel) -> DataFrame:
    """Adds lang_pred (``und`` for null texts, texts without a letter, or a model that learned nothing) and score.

    Existing columns of these names are replaced; equal texts are judged alike, whole at any length; an empty table gives an
    empty result.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: BUCKETS x landmarks at most
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            names, scores = shared.value.predict(batch.to_pylist())
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    udf = F.arrow_udf(work, kind)
    marked = docs.drop("lang_pred", "score").withColumn("__tw_l", udf("text"))
    return marked.withColumns({"lang_pred": F.col("__tw_l.lang_pred"), "score": F.col("__tw_l.score")}).drop("__tw_l")


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those whose checksum is not 1 mod 3; null texts are ``und``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = crc_id() % 3 == 1
    model = learn_languages(docs.filter(~held_out))
    return identify_languages(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
