"""LM scoring: word counts over the whole training corpus, and a gated recurrent model trained and run in tasks.

Words split three ways. The commonest have ids of the recurrent model; the model predicts all others as one id, whose
probability is shared among them as the counts say. Counts of the commonest ``HEAD`` words are broadcast; rarer ones,
whose number grows with the corpus, meet their counts in a shuffled join. Texts are encoded once, for training and
scoring alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm import gated_lm
from tracewell.llm.common import crc_id, small_batches
from tracewell.session import materialize

#: Words whose counts are broadcast (a few MB); the rest is joined.
HEAD = 1 << 17
MODEL_WORDS = 48 * 48 - 2
#: The training documents are cut evenly into so many rounds; copies of the model are averaged after each.
ROUNDS = 3
#: What a task trains on in a round, on average. Long enough that the longest texts do not leave most lanes empty.
_TASK_TOKENS = 2_000_000
_BLOCK_TOKENS = 2_000_000
#: Words that a task counts at a time.
_COUNT_WORDS = 1_000_000
#: Lanes that a task trains side by side, whatever it holds; fewer where it has fewer texts.
LANES = 256


@dataclass
class Vocabulary:
    """N tokens and V distinct ones in training texts, ends included; the head's words in order of falling count."""

    n: int
    v: int
    ends: int
    words: list[str]
    counts: np.ndarray

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1.0) / (self.n + self.v + 1.0))

    def other_share(self) -> float:
        """What the counts leave for words without a model id, those never seen included."""
        return 1 - (self.counts[:MODEL_WORDS] + 1.0).sum() / (self.n + self.v + 1.0) - (self.ends + 1.0) / (self.n + self.v + 1.0)

    def encode(self, texts: pa.Array) -> list[tuple[np.ndarray, float, float, int, pa.Array]]:
        """(model ids with the end, base log10 without rare words, what the model's score adds for words without an id,
        known tokens, rare words) of each text; null texts have the end only.

        Rare are the words outside the head, whose part of both scores follows by join.
        """
        flat, pieces = _words(texts)
        owner = np.repeat(np.arange(len(texts)), pieces)
        full = np.flatnonzero(pc.binary_length(flat).to_numpy(zero_copy_only=False))  # empty pieces stand at the ends
        flat, owner = flat.take(pa.array(full)), owner[full]
        place = pc.fill_null(pc.index_in(flat, pa.array(self.words, pa.string())), -1).to_numpy(zero_copy_only=False)
        modelled = (place >= 0) & (place < MODEL_WORDS)
        head = np.append(self.base(self.counts), 0.0)  # the last for place -1
        total = lambda w: np.bincount(owner, w, len(texts))
        end = float(self.base(np.array(self.ends)))
        # words without a model id take their part of the probability of that id
        base, more = total(head[place]) + end, total(np.where(modelled, 0.0, head[place] - np.log10(self.other_share())))
        known = total(place >= 0).astype(np.int64) + (self.ends > 0)
        ends = np.searchsorted(owner, np.arange(len(texts)), "right")
        ids = np.insert(np.where(modelled, place + 2, gated_lm.OTHER).astype(np.int16), ends, gated_lm.END)
        cut = np.cumsum(np.bincount(owner, minlength=len(texts)) + 1)[:-1]
        rare = np.flatnonzero(place < 0)
        at = np.r_[0, np.searchsorted(owner[rare], np.arange(len(texts)), "right")]
        words = flat.take(pa.array(rare))
        return [(x, *y, words[at[i] : at[i + 1]]) for i, (x, *y) in enumerate(zip(np.split(ids, cut), base.tolist(), more.tolist(), known.tolist(), strict=True))]


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, A-Z lower-cased, and how many pieces each text splits into (empty ones stand at the ends)."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "").cast(pa.string())))
    return split.flatten(), pc.list_value_length(split).to_numpy(zero_copy_only=False)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) over all texts, A-Z lower-cased; tasks count some ``_COUNT_WORDS`` words at a time, Spark sums the counts."""
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(_words(b.column(0))[0])
            size += len(held[-1])
            if size >= _COUNT_WORDS:
                yield counted(held)
                held, size = [], 0
        if held:
            yield counted(held)

    def counted(held: list) -> pa.RecordBatch:
        found = pa.chunked_array(held, pa.string()).value_counts()
        return pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["word", "c"])

    return docs.select("text").mapInArrow(work, "word string, c long").filter("word <> ''").groupBy("word").agg(F.sum("c").alias("c"))


def learn_vocabulary(training: DataFrame, head: int = HEAD) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary, and the table of all counts, in which ``head`` marks the words whose counts are broadcast.

    Counts fall into steps of a 64th of an octave, and the head is the upper steps that hold ``head`` words at most.
    So the driver sees a few thousand sums and then that many words, whatever the number of tasks.
    """
    counted = count_words(training).withColumn("step", F.floor(F.log2("c") * 64).cast("int"))
    counts = materialize(counted, "word_counts")
    ends = training.count()
    steps = counts.groupBy("step").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).orderBy(F.desc("step")).collect()
    held = np.cumsum([r.v for r in steps])
    lowest = min((r.step for r, v in zip(steps, held, strict=True) if v <= head), default=1 << 30)
    counts = counts.select("word", "c", (F.col("step") >= lowest).alias("head"))
    top = counts.filter("head").select("word", "c").toPandas().sort_values(["c", "word"], ascending=[False, True])
    n, v = sum(r.n for r in steps), sum(r.v for r in steps)
    return Vocabulary(n + ends, v + (ends > 0), ends, top["word"].tolist(), top["c"].to_numpy(np.int64)), counts


def _averaged(parts: DataFrame) -> DataFrame:
    """Weighted means of parameter pieces, 64 tasks at a time until one is left."""

    def mean(table: pa.Table) -> pa.Table:
        weight = table.column("weight").to_numpy()
        values = [np.frombuffer(b, np.float32) for b in table.column("piece").to_pylist()]
        out = sum(v * np.float32(w / weight.sum()) for v, w in zip(values, weight, strict=True))
        return pa.table({"k": table.column("k")[:1], "task": pa.array([table.column("group")[0].as_py()], pa.int64()), "weight": pa.array([weight.sum()]), "piece": pa.array([out.tobytes()], pa.binary())})

    tasks = parts.agg(F.max("task")).first()[0] or 0
    while True:
        grouped = parts.withColumn("group", F.expr("task div 64"))
        parts = materialize(grouped.groupBy("k", "group").applyInArrow(mean, "k int, task long, weight double, piece binary"), "means")
        tasks //= 64
        if not tasks:
            return parts


def encode_documents(docs: DataFrame, vocabulary: Vocabulary, training: Column | None = None, seed: int = 0) -> DataFrame:
    """A written table with a row a document: uid, doc_id, training, place (a hash that deals documents), n_tokens, n_known,
    base, more, ids (two bytes a token) and rare (words outside the head).

    ``docs`` needs doc_id and text; other columns are used by ``training`` (all rows where not given) only.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(vocabulary)
    names = ["doc_id", "training", "place", "n_tokens", "n_known", "base", "more", "ids", "rare"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = shared.value.encode(b.column("text"))
            if not found:
                continue
            ids, base, more, known, rare = zip(*found, strict=True)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rare)]), pa.int32()), pa.concat_arrays(rare))
            made = [pa.array([len(x) for x in ids], pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(more), pa.array([x.tobytes() for x in ids], pa.binary()), lists]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("training"), b.column("place"), *made], names)

    place = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 30))
    marked = docs.select("doc_id", F.coalesce(F.lit(True) if training is None else training, F.lit(False)).alias("training"), place.alias("place"), "text")
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    kinds = f"doc_id {kind}, training boolean, place long, n_tokens long, n_known long, base double, more double, ids binary, rare array<string>"
    return materialize(marked.mapInArrow(work, kinds).withColumn("uid", F.monotonically_increasing_id()), "encoded")


def train_model(encoded: DataFrame, vocabulary: Vocabulary, seed: int = 0) -> dict[str, np.ndarray]:
    """Data-parallel training: in each round every task trains a copy on its texts, then the copies are averaged.

    All rounds together go through every training document once, whatever the size of the corpus; a hash deals the
    documents to rounds and tasks, and orders them in a task, so that reruns train the same model. Without training
    texts the model stays at the start.
    """
    spark = encoded.sparkSession
    counts = np.zeros(MODEL_WORDS + 2)
    counts[gated_lm.END] = vocabulary.ends
    counts[2 : 2 + len(vocabulary.counts[:MODEL_WORDS])] = vocabulary.counts[:MODEL_WORDS]
    counts[gated_lm.OTHER] = max(1, vocabulary.n - counts.sum())
    model = gated_lm.new_model(counts, seed)
    if not vocabulary.n:
        return model
    dealt = max(1, round(vocabulary.n / ROUNDS / _TASK_TOKENS))
    flat = gated_lm.flatten(model)
    for i in range(ROUNDS):
        start = spark.sparkContext.broadcast(flat)

        def fit(batches: Iterator[pa.RecordBatch], start=start, model_shape={k: v.shape for k, v in model.items()}) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            p = gated_lm.restore({k: np.empty(s) for k, s in model_shape.items()}, start.value)
            adam, weight, held, size = None, 0, [], 0

            def step(adam):
                return gated_lm.train(p, held, adam, count=LANES)

            for b in batches:
                new = [np.frombuffer(x, np.int16) for x in b.column("ids").to_pylist()]
                held += new
                size += sum(map(len, new))
                if size >= 2 * _TASK_TOKENS:
                    adam, weight = step(adam), weight + size
                    held[:], size = [], 0
            if held:
                adam, weight = step(adam), weight + size
            if weight:
                out = gated_lm.flatten(p)
                pieces = [out[at : at + 16384].tobytes() for at in range(0, len(out), 16384)]
                n = len(pieces)
                task = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([task] * n, pa.int64()), pa.array([float(weight)] * n), pa.array(pieces, pa.binary())], ["k", "task", "weight", "piece"])

        own = encoded.filter(F.col("training") & (F.pmod("place", F.lit(ROUNDS)) == i)).select("place", "ids")
        dealt_out = own.repartition(dealt, F.xxhash64("place")).sortWithinPartitions("place", "ids")
        parts = dealt_out.mapInArrow(fit, "k int, task long, weight double, piece binary")
        pieces = _averaged(materialize(parts, "parameters")).orderBy("k").collect()  # one model: about 0.5 MB
        if pieces:
            flat = np.concatenate([np.frombuffer(r.piece, np.float32) for r in pieces])
    return gated_lm.restore(model, flat)


def score_documents(encoded: DataFrame, vocabulary: Vocabulary, counts: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, training, n_tokens, n_known, base_score, score) of every encoded document, in log10.

    Null texts have the end only; texts of any length are scored whole. Repeated rows and ids stay rows of their own. Base scores add-one smooth the counts;
    scores are the model's. An empty table gives an empty result.
    """
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(model)
    names = ["uid", "doc_id", "training", "n_tokens", "n_known", "base", "more", "ids"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def scored(held: list) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            lm = gated_lm.score(shared.value, [np.frombuffer(x, np.int16) for x in table.column("ids").to_pylist()])
            yield from table.drop_columns("ids").append_column("lm", pa.array(lm)).to_batches(2000)

        held, tokens = [], 0
        for b in batches:
            held.append(b)
            tokens += pc.sum(b.column("n_tokens")).as_py() or 0
            if tokens >= _BLOCK_TOKENS:
                yield from scored(held)
                held, tokens = [], 0
        if held:
            yield from scored(held)

    kind = encoded.schema["doc_id"].dataType.simpleString()
    table = encoded.select(names).mapInArrow(work, f"uid long, doc_id {kind}, training boolean, n_tokens long, n_known long, base double, more double, lm double")
    rare = encoded.select("uid", F.explode("rare").alias("word"))
    met = rare.join(counts.filter("not head").select("word", "c"), "word", "left").select("uid", F.col("c").isNotNull().cast("long").alias("known"), F.log10((F.coalesce("c", F.lit(0)) + 1.0) / (vocabulary.n + vocabulary.v + 1.0)).alias("p"))
    sums = met.groupBy("uid").agg(F.sum("known").alias("k"), F.sum("p").alias("p"))
    joined = table.join(sums, "uid", "left")
    rest = F.coalesce("p", F.lit(0.0))
    return joined.select(
        "doc_id", "training", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), (F.col("base") + rest).alias("base_score"), (F.col("lm") + F.col("more") + rest).alias("score")
    )


def op9_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Every document's score by counts and by a model of the documents whose checksum is not 2 mod 7.

    Null and empty texts consist of the end alone, repeated rows are scored alike, and an empty table gives an empty
    result.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = crc_id() % 7 == 2
    vocabulary, counts = learn_vocabulary(docs.filter(~held_out))
    encoded = encode_documents(docs, vocabulary, ~held_out)
    scored = score_documents(encoded, vocabulary, counts, train_model(encoded, vocabulary))
    return scored.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", F.lit(vocabulary.n).cast("long").alias("train_tokens"), "base_score", "score")
