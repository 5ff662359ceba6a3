"""Components and factors of many cells at once, also of many groups of cells.

Models are bases of frames x k numbers; cells meet them where they lie, and only sums of that size move. A bounded,
hashed sample of each group's cells (``SAMPLE``; smaller groups whole) is fitted first, in one task a group, so the passes
over all cells start near their end and return their fixed point. Factors may have more than one; a sample of thousands
starts near that of all cells.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.kernels import numeric
from tracewell.session import materialize

#: Cells of a group, about, from which the passes start.
SAMPLE = 4096
#: How far (one less a canonical correlation) scores may still turn in a pass.
SETTLED = 1e-7
#: Most factors whose rotation is found from their fourth moments, taken in one pass.
MOMENTS = 32
#: Spare directions of a basis.
_SPARE = 8
#: Doubles of a piece of a sum (32 KB), and pieces that one task adds up where tasks are many.
_PIECE, _FAN = 1 << 12, 64


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of lists of one length as rows of doubles."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, width)


def summed_by(rows: DataFrame, columns: Sequence[str], work: Callable[[Iterator[pa.RecordBatch]], Mapping[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """By group, the sum over all tasks of the flat array that ``work`` makes of a task's batches.

    Arrays travel in pieces of 32 KB. On a cluster pieces are added up by 64 and 4,096 tasks first, so no task
    gets a piece of every other; one array a group reaches the driver.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for group, array in work(batches).items():
            flat = np.asarray(array, float).ravel()
            cuts = [flat[at : at + _PIECE].tobytes() for at in range(0, len(flat), _PIECE)]
            yield pa.RecordBatch.from_arrays([pa.array([group] * len(cuts), pa.int32()), pa.array(range(len(cuts)), pa.int32()), pa.array([task] * len(cuts), pa.int32()), pa.array(cuts, pa.binary())], ["g", "i", "task", "cut"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(len(np.frombuffer(table.column("cut")[0].as_py())))
        for cut in table.column("cut"):
            total += np.frombuffer(cut.as_py())
        return pa.table({"g": table.column("g")[:1], "i": table.column("i")[:1], "task": table.column("task")[:1], "cut": pa.array([total.tobytes()], pa.binary())})

    kind = "g int, i int, task int, cut binary"
    pieces = rows.select(*columns).mapInArrow(parts, kind)
    for fan in (_FAN, _FAN * _FAN) if rows.sparkSession.sparkContext.defaultParallelism > _FAN else ():
        pieces = pieces.groupBy("g", "i", F.floor(F.col("task") / fan)).applyInArrow(add, kind)
    found: dict[int, list] = {}
    for r in pieces.groupBy("g", "i").applyInArrow(add, kind).collect():
        found.setdefault(r.g, []).append((r.i, bytes(r.cut)))
    return {g: np.concatenate([np.frombuffer(p) for _, p in sorted(cuts)]) for g, cuts in found.items()}


def summed(rows: DataFrame, columns: Sequence[str], work: Callable[[Iterator[pa.RecordBatch]], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all tasks of the array that ``work`` makes of a task's batches."""
    got = summed_by(rows, columns, lambda batches: {0: work(batches)})
    return got[0].reshape(shape) if got else np.zeros(shape)


def _turned(q: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The next basis of a subspace iteration: the product with the basis, by Ritz values, orthonormal."""
    values, turn = np.linalg.eigh((q.T @ y + y.T @ q) / 2)
    return np.linalg.qr(y @ turn[:, np.argsort(values)[::-1]])[0]


def _moved(a: np.ndarray, b: np.ndarray, k: int) -> float:
    return 1 - float(np.linalg.svd(a[:, :k].T @ b[:, :k])[1].min()) if k else 0.0


def _product(x: np.ndarray, q: np.ndarray, k: int, noisy: bool) -> np.ndarray:
    """Sum of z (z'q) / noise over standardised cells; a cell's noise is what its first k directions leave of it."""
    p = x @ q
    if noisy:
        x = x / np.maximum(1 - np.square(p[:, :k]).sum(1) / x.shape[1], 1e-6)[:, None]
    return x.T @ p


def sample_basis(x: np.ndarray, k: int, rounds: int = 400, settled: float = 1e-8) -> np.ndarray:
    """The basis (frames x (k + 8)) of the factors of a few cells, by the same steps."""
    frames = x.shape[1]
    q = np.linalg.qr(np.random.default_rng(0).normal(size=(frames, min(frames, k + _SPARE))))[0]
    for i in range(rounds):
        new = _turned(q, _product(x, q, k, i >= 8))
        still = i > 8 and _moved(new, q, k) < settled
        q = new
        if still:
            break
    return q


def _sampled(rows: DataFrame, counts: Mapping[int, int], most: int = SAMPLE, by: str = "cell") -> DataFrame:
    """Rows (g, ...) of a hashed sample of about ``most`` cells a group; smaller groups whole."""
    large = {g: n // most + 1 for g, n in counts.items() if n > most}
    if not large:
        return rows
    step = F.coalesce(F.create_map(*[F.lit(x) for g in large.items() for x in g])[F.col("g")], F.lit(1))
    return rows.filter(F.pmod(F.xxhash64(by), step) == 0)


def factor_models(cells: DataFrame, group: str, cell: str, frames: int, k: Mapping[int, int], rounds: int = 20, trace: str = "trace") -> tuple[DataFrame, dict[int, np.ndarray]]:
    """((group, cell, loadings, noise), scores [k x frames] by group): maximum-likelihood factors of each group's cells
    (features) over frames (samples), varimax-rotated, all groups in the same passes.

    Groups are integers, of which there are few; ``k`` says their numbers of factors, at most the frames and the cells.
    Traces are standardised once and written. A pass finds each cell's noise under the present basis and the product of
    the noise-scaled cells with it; groups whose scores stand still drop out. A warning says how far scores still moved
    after ``rounds`` passes. Rotation and signs (the largest loading is positive) come from sums over all cells.
    """
    spark = cells.sparkSession

    def standard(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            x = matrix(batch, frames)
            x = x - x.mean(1, keepdims=True)
            x = x / np.maximum(x.std(1, keepdims=True), 1e-12)
            yield pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))

    kept = cells.filter(F.col(group).isin(list(k))) if len(k) < 1000 else cells
    rows = materialize(kept.select(F.col(group).cast("int").alias("g"), F.col(cell).alias("cell"), F.arrow_udf(standard, T.ArrayType(T.FloatType()))(trace).alias("z")), "standard")
    counts = {r.g: r.n for r in rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a group
    ks = {g: max(1, min(k[g], frames, n)) for g, n in counts.items()}

    def begin(table: pa.Table) -> pa.Table:
        g = table.column("g")[0].as_py()
        q = sample_basis(matrix(table.sort_by("cell").column("z").combine_chunks(), frames), ks[g])
        return pa.table({"g": pa.array([g], pa.int32()), "q": pa.array([q.tobytes()], pa.binary())})

    begun = _sampled(rows, counts).groupBy("g").applyInArrow(begin, "g int, q binary").collect()
    bases = {r.g: np.frombuffer(bytes(r.q)).reshape(frames, -1) for r in begun}
    bases |= {g: sample_basis(np.eye(frames), ks[g], 1) for g in counts if g not in bases}  # a sample may miss a group
    live, moved = set(bases), dict.fromkeys(bases, 1.0)
    for _ in range(rounds):
        if not live:
            break
        shared = spark.sparkContext.broadcast({g: bases[g] for g in live})

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> dict[int, np.ndarray]:
            out: dict[int, np.ndarray] = {}
            for b in batches:
                of, z = b.column(0).to_numpy(), matrix(b.column(1), frames)
                for g in np.unique(of).tolist():
                    y = _product(z[of == g], shared.value[g], ks[g], True)
                    out[g] = out[g] + y if g in out else y
            return out

        for g, y in summed_by(rows.filter(F.col("g").isin(sorted(live))), ["g", "z"], work).items():
            new = _turned(bases[g], y.reshape(bases[g].shape))
            moved[g], bases[g] = _moved(new, bases[g], ks[g]), new
            if moved[g] < SETTLED:
                live.discard(g)
    if live:
        warnings.warn(f"factors of {len(live)} groups still moved by up to {max(moved[g] for g in live):.1e} after {rounds} passes", stacklevel=2)

    scores = {g: bases[g][:, : ks[g]].T * np.sqrt(frames) for g in bases}  # orthogonal, of unit variance
    shared_scores = spark.sparkContext.broadcast(scores)
    kind = T.StructType([T.StructField("loadings", T.ArrayType(T.DoubleType())), T.StructField("noise", T.DoubleType())])

    def load(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for groups, traces in batches:
            of, z = groups.to_numpy(zero_copy_only=False), matrix(traces, frames)
            loads, noise = [None] * len(of), np.zeros(len(of))
            for g in np.unique(of).tolist():
                at = np.flatnonzero(of == g)
                own = z[at] @ shared_scores.value[g].T / frames
                noise[at] = np.maximum(np.square(z[at]).mean(1) - np.square(own).sum(1), 1e-6)
                for i, row in zip(at.tolist(), own, strict=True):
                    loads[i] = row
            yield pa.StructArray.from_arrays([pa.array(loads, pa.list_(pa.float64())), pa.array(noise)], ["loadings", "noise"])

    fitted = materialize(rows.select("g", "cell", F.arrow_udf(load, kind)("g", "z").alias("f")).select("g", "cell", "f.*"), "loadings")
    turns = varimax(fitted, ks)
    shared_turns = spark.sparkContext.broadcast(turns)

    def rotate(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for groups, loads in batches:
            rotated = [np.asarray(x, float) @ shared_turns.value[g] for g, x in zip(groups.to_pylist(), loads.to_numpy(zero_copy_only=False), strict=True)]
            yield pa.array(rotated, pa.list_(pa.float64()))

    rotated = fitted.select(F.col("g").alias(group), F.col("cell").alias(cell), F.arrow_udf(rotate, T.ArrayType(T.DoubleType()))("g", "loadings").alias("loadings"), "noise")
    return rotated, {g: turns[g].T @ scores[g] for g in scores}


def varimax(fitted: DataFrame, ks: Mapping[int, int], rounds: int = 1000, tol: float = 1e-10, passes: int = 12) -> dict[int, np.ndarray]:
    """By group, the rotation (k x k) of its cells' loadings that maximises the variance of their squares, the largest
    positive. ``fitted`` (written): g, loadings.

    One pass sums products of pairs of loadings, and the fourth moments that every step needs where k is at most
    ``MOMENTS``. With more factors the rotation of a bounded, hashed sample is found first, and each step from there is
    a pass, of all groups at once, whose sums are k x k: ``passes`` at most.
    """
    pairs = {g: np.triu_indices(k) for g, k in ks.items()}
    m = {g: len(pairs[g][0]) if k <= MOMENTS else 0 for g, k in ks.items()}

    def by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        for b in batches:
            of = b.column(0).to_numpy()
            for g in np.unique(of).tolist():
                yield g, matrix(b.column(1).filter(pa.array(of == g)), ks[g])

    def moments(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        out: dict[int, np.ndarray] = {}
        for g, x in by_group(batches):
            iu, ju = pairs[g]
            products = x[:, iu] * x[:, ju] if m[g] else np.zeros((len(x), 0))
            part = np.concatenate([[len(x)], (x.T @ x).ravel(), (products.T @ products).ravel()])
            out[g] = out[g] + part if g in out else part
        return out

    sums = summed_by(fitted, ["g", "loadings"], moments)
    turns = {g: np.eye(k) for g, k in ks.items()}
    cross = {g: s[1 : 1 + ks[g] ** 2].reshape(ks[g], ks[g]) for g, s in sums.items()}
    count = {g: s[0] for g, s in sums.items()}

    def from_moments(g: int) -> np.ndarray:
        """Sum of each loading times the cube of each rotated one."""
        k, (iu, ju) = ks[g], pairs[g]
        fourth, place = sums[g][1 + k * k :].reshape(m[g], m[g]), np.zeros((k, k), int)
        place[iu, ju] = place[ju, iu] = np.arange(len(iu))
        twice = np.where(iu == ju, 1, 2)
        return np.stack([(fourth @ (twice * t[iu] * t[ju]))[place] @ t for t in turns[g].T], 1)

    def from_pass(live: Sequence[int]) -> dict[int, np.ndarray]:
        shared = fitted.sparkSession.sparkContext.broadcast({g: turns[g] for g in live})

        def work(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
            out: dict[int, np.ndarray] = {}
            for g, x in by_group(batches):
                part = x.T @ (x @ shared.value[g]) ** 3
                out[g] = out[g] + part if g in out else part
            return out

        got = summed_by(fitted.filter(F.col("g").isin(list(live))), ["g", "loadings"], work)
        return {g: v.reshape(ks[g], ks[g]) for g, v in got.items()}

    live = sorted(g for g in sums if ks[g] > 1 and count[g] >= ks[g])

    def begin(table: pa.Table) -> pa.Table:
        g = table.column("g")[0].as_py()
        turn = numeric.varimax(matrix(table.column("loadings").combine_chunks(), ks[g]), rounds, tol)
        return pa.table({"g": pa.array([g], pa.int32()), "turn": pa.array([turn.tobytes()], pa.binary())})

    if any(not m[g] for g in live):
        some = _sampled(fitted.filter(F.col("g").isin([g for g in live if not m[g]])), {g: int(count[g]) for g in live}, by="loadings")
        for r in some.select("g", "loadings").groupBy("g").applyInArrow(begin, "g int, turn binary").collect():
            turns[r.g] = np.frombuffer(bytes(r.turn)).reshape(ks[r.g], ks[r.g])
    for i in range(rounds):
        live = [g for g in live if m[g] or i < passes]
        if not live:
            break
        wide = [g for g in live if not m[g]]
        cubes = {g: from_moments(g) for g in live if m[g]} | (from_pass(wide) if wide else {})
        for g in list(live):
            spread = np.diag(turns[g].T @ cross[g] @ turns[g]) / count[g]
            u, s, v = np.linalg.svd(cubes[g] - cross[g] @ turns[g] * spread)
            moved, turns[g] = np.abs(u @ v - turns[g]).max(), u @ v
            if moved < (tol if m[g] else 1e-6):  # a step that is a pass ends earlier
                live.remove(g)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict[int, np.ndarray] = {}
        high: dict[int, np.ndarray] = {}
        for g, x in by_group(batches):
            y = x @ turns[g]
            low[g] = np.minimum(low.get(g, np.zeros(ks[g])), y.min(0))
            high[g] = np.maximum(high.get(g, np.zeros(ks[g])), y.max(0))
        rows = [(g, i, float(low[g][i]), float(high[g][i])) for g in low for i in range(ks[g])]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.float64(), pa.float64()))], ["g", "i", "low", "high"])

    for r in fitted.select("g", "loadings").mapInArrow(ends, "g int, i int, low double, high double").groupBy("g", "i").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        if -r.low > r.high:
            turns[r.g][:, r.i] *= -1
    return turns
