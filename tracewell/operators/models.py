"""Fitted models. Spark deals the cells or groups out; small numpy kernels solve each batch or group.

Array columns given to these operators must be stored ones (read, or written and read again): Spark does not plan a
Python function on an expression that holds a lambda.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.kernels import numeric
from tracewell.operators import populations
from tracewell.operators.factors import SAMPLE, factor_models, matrix, summed
from tracewell.session import materialize

LAGS = tuple(range(6, 61, 2))


def ridge_scan(cells: DataFrame, cell: str, regressor: np.ndarray, trace: str = "trace", lags: Sequence[int] = LAGS, strength: float = 0.1, tau: float = 10.0, window: tuple[int, int] | None = None) -> DataFrame:
    """(cell, lags, intercept, beta, r2, kernel): the lagged ridge fit with the best r2 of each cell, fewer lags on ties.

    All cells share one design per lag count, so its solver is made once and sent along; a batch of cells is one
    product per lag count. Cells without variance get null metrics. Comparison is in float32, as documented for ties.
    """
    lo, hi = window or (0, len(regressor))
    solvers = []
    for n in lags:
        design = numeric.lag_matrix(regressor, n)[lo:hi]
        solve, mean = numeric.ridge_solver(design, strength, tau)
        solvers.append((n, design, solve, mean))
    shared = cells.sparkSession.sparkContext.broadcast(solvers)
    kind = T.StructType([T.StructField("lags", T.IntegerType()), *[T.StructField(x, T.DoubleType()) for x in ("intercept", "beta", "r2")], T.StructField("kernel", T.ArrayType(T.DoubleType()))])

    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            y = np.array(batch.to_pylist(), float).reshape(len(batch), -1)[:, lo:hi].T
            best_r2, best = np.full(len(batch), -np.inf, np.float32), [None] * len(batch)
            total = np.square(y - y.mean(0)).sum(0) if len(y) else np.zeros(len(batch))
            for n, design, solve, mean in shared.value:
                w = solve @ (y - y.mean(0))
                at = y.mean(0) - mean @ w
                rest = np.square(y - at - design @ w).sum(0)
                with np.errstate(divide="ignore", invalid="ignore"):
                    r2 = 1 - rest / total
                for i in np.flatnonzero(np.isfinite(r2) & (r2.astype(np.float32) > best_r2)):
                    beta = float(np.linalg.norm(w[:, i]))
                    best_r2[i] = r2[i]
                    best[i] = {"lags": n, "intercept": float(at[i]), "beta": beta, "r2": float(r2[i]), "kernel": (w[:, i] / beta if beta else w[:, i] * 0).tolist()}
            yield pa.array(best, pa.struct([("lags", pa.int32()), ("intercept", pa.float64()), ("beta", pa.float64()), ("r2", pa.float64()), ("kernel", pa.list_(pa.float64()))]))

    return cells.select(cell, F.arrow_udf(work, kind)(trace).alias("f")).select(cell, "f.*")


def ridge_one_lag(cells: DataFrame, cell: str, x: str, y: str, strength: float = 0.1) -> DataFrame:
    """The one-lag fit in closed form: weight, intercept, r2; null r2 where y is constant."""
    g = cells.groupBy(cell).agg(F.covar_pop(x, y).alias("c"), F.var_pop(x).alias("v"), F.var_pop(y).alias("vy"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.count(F.lit(1)).alias("n"))
    w = F.try_divide(F.col("c") * F.col("n"), F.col("v") * F.col("n") + strength)
    fitted = g.withColumn("weight", w).withColumn("intercept", F.col("my") - F.col("mx") * F.col("weight"))
    rest = F.col("vy") - 2 * F.col("weight") * F.col("c") + F.col("weight") * F.col("weight") * F.col("v")
    return fitted.select(cell, "weight", "intercept", (1 - F.try_divide(rest, F.col("vy"))).alias("r2"))


#: Rows of one group that are fitted in one task; larger groups are fitted by sums over all tasks.
FIT_ROWS = 200_000


def logistic_fits(rows: DataFrame, keys: Sequence[str], features: Sequence[str] | str, outcome: str, most: int = FIT_ROWS) -> DataFrame:
    """(keys, n, r2, aic, llf, separated, params): one logistic fit a group; null metrics where it has one outcome only.

    ``features`` are columns, or one array column of equal length within a group. Groups of up to ``most`` rows are
    fitted where they are gathered; a larger one, of which there are few, is fitted by the same steps, each a sum over
    its rows wherever they lie. Rows with a null outcome or feature are left out.
    """
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kinds}, n long, r2 double, aic double, llf double, separated boolean, params array<double>"

    def fit(table: pa.Table) -> pa.Table:
        y = table.column(outcome).to_numpy().astype(float)
        design = np.array(table.column("__x").to_pylist(), float).reshape(len(y), -1)
        x = np.column_stack([np.ones(len(y)), design])
        got = numeric.logistic_fit(x, y) if 0 < y.sum() < len(y) else None
        out = {k: table.column(k)[:1] for k in keys}
        out |= {"n": pa.array([len(y)], pa.int64())}
        out |= {k: pa.array([got[k] if got else None], pa.float64()) for k in ("r2", "aic", "llf")}
        out |= {"separated": pa.array([bool(got and got["separated"])]), "params": pa.array([got["params"].tolist() if got else None], pa.list_(pa.float64()))}
        return pa.table(out)

    packed = F.col(features) if isinstance(features, str) else F.array(*[F.col(f).cast("double") for f in features])
    used = rows.select(*keys, packed.cast("array<double>").alias("__x"), F.col(outcome).cast("double").alias(outcome))
    used = materialize(used.filter(F.col(outcome).isNotNull() & ~F.exists("__x", lambda v: v.isNull())), "fit_rows")
    groups = used.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(outcome).alias("y"), F.max(F.size("__x")).alias("k"))
    large = groups.filter(F.col("n") > most).collect()  # at most one in ``most`` rows
    if not large:
        return used.groupBy(*keys).applyInArrow(fit, schema)
    numbered = rows.sparkSession.createDataFrame([(*[r[k] for k in keys], i) for i, r in enumerate(large)], f"{kinds}, __g int")
    same = [F.col(f"u.{k}").eqNullSafe(F.col(f"g.{k}")) for k in keys]
    met = used.alias("u").join(F.broadcast(numbered).alias("g"), reduce(lambda x, y: x & y, same), "left").select("u.*", "__g")
    whole = met.filter("__g is null").drop("__g").groupBy(*keys).applyInArrow(fit, schema)
    spread = materialize(met.filter("__g is not null").select("__g", "__x", F.col(outcome).alias("__y")), "large_groups")
    fitted = [(*[r[k] for k in keys], *f) for r, f in zip(large, _large_fits(spread, [(r.n, r.y, r.k) for r in large]), strict=True)]
    return whole.unionByName(rows.sparkSession.createDataFrame(fitted, schema))


def _large_fits(spread: DataFrame, groups: list[tuple[int, float, int]], rounds: int = 100, tol: float = 1e-6) -> list[tuple]:
    """(n, r2, aic, llf, separated, params) of groups (rows, sum of outcomes, features) by reweighted least squares.

    A step is a pass in which every task sums the weighted products of its rows by group; k x k systems are solved here.
    """
    width = 1 + max(k for *_, k in groups)
    beta = np.zeros((len(groups), width))
    live = np.array([0 < y < n for n, y, _ in groups])
    separated = np.zeros(len(groups), bool)

    def passed(beta: np.ndarray, live: np.ndarray) -> np.ndarray:
        """By group: X'WX, X'Wz, log-likelihood, rows that are not yet separated."""
        shared = spread.sparkSession.sparkContext.broadcast((beta, live))

        def work(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            beta, live = shared.value
            out = np.zeros((len(beta), width * width + width + 2))
            for b in batches:
                of, outcomes = b.column(0).to_numpy(), b.column(2).to_numpy()
                lists = b.column(1)
                flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
                for g in np.unique(of):
                    if not live[g]:
                        continue
                    at = np.flatnonzero(of == g)
                    k = int(ends[at[0] + 1] - ends[at[0]])
                    x = np.zeros((len(at), width))
                    x[:, 0] = 1
                    x[:, 1 : 1 + k] = flat[ends[at][:, None] + np.arange(k)]
                    y = outcomes[at]
                    eta = np.clip(x @ beta[g], -30, 30)
                    p = 1 / (1 + np.exp(-eta))
                    w = np.maximum(p * (1 - p), 1e-12)
                    out[g, : width * width] += ((x * w[:, None]).T @ x).ravel()
                    out[g, width * width : -2] += x.T @ (w * eta + y - p)
                    q = np.clip(p, 1e-15, 1 - 1e-15)
                    out[g, -2] += np.sum(y * np.log(q) + (1 - y) * np.log1p(-q))
                    out[g, -1] += np.sum(np.abs(p - y) >= 1e-6)
            return out

        return summed(spread, ["__g", "__x", "__y"], work, (len(beta), width * width + width + 2))

    usable = live.copy()
    for _ in range(rounds):
        if not live.any():
            break
        sums = passed(beta, live)
        for g in np.flatnonzero(live):
            if sums[g, -1] == 0:
                separated[g], live[g] = True, False
                continue
            new = np.linalg.lstsq(sums[g, : width * width].reshape(width, width), sums[g, width * width : -2], rcond=None)[0]
            live[g] = np.max(np.abs(new - beta[g])) >= tol
            beta[g] = new
    last = passed(beta, usable)
    out = []
    for g, (n, y, k) in enumerate(groups):
        if not usable[g]:
            out.append((n, None, None, None, False, None))
            continue
        m, llf = y / n, float(last[g, -2])
        null = n * (m * np.log(m) + (1 - m) * np.log(1 - m))
        out.append((n, float(1 - np.exp(min(0.0, 2 * (null - llf) / n))), 2 * (k + 1) - 2 * llf, llf, bool(separated[g]), beta[g, : k + 1].tolist()))
    return out


def _filtered(cells: DataFrame, trace: str, name: str, body) -> DataFrame:
    """Adds ``body`` of each array, all rows of a batch with equal length at once."""

    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [np.array(x, float) for x in batch.to_pylist()]
            out: list = [None] * len(rows)
            for n in {len(r) for r in rows}:
                at = [i for i, r in enumerate(rows) if len(r) == n]
                values = body(np.stack([rows[i] for i in at])) if n > 1 else [rows[i] for i in at]
                for i, v in zip(at, values, strict=True):
                    out[i] = v.tolist()
            yield pa.array(out, pa.list_(pa.float64()))

    return cells.withColumn(name, F.arrow_udf(work, T.ArrayType(T.DoubleType()))(trace))


def low_pass(cells: DataFrame, cutoff: float = 0.06, order: int = 5, trace: str = "trace", name: str = "low") -> DataFrame:
    """Adds the zero-phase low-pass of each array."""
    return _filtered(cells, trace, name, lambda x: numeric.zero_phase_low_pass(x, cutoff, order))


def causal_low_pass(cells: DataFrame, cutoff: float, order: int = 5, trace: str = "trace", name: str = "low") -> DataFrame:
    """Adds the forward-only low-pass of each array, from rest."""
    return _filtered(cells, trace, name, lambda x: numeric.causal_low_pass(x, cutoff, order))


def band_pass(cells: DataFrame, low: float, high: float, order: int = 5, trace: str = "trace", name: str = "band") -> DataFrame:
    """Adds the zero-phase band-pass of each array (shares of the Nyquist frequency), in second-order sections, unpadded."""
    return _filtered(cells, trace, name, lambda x: numeric.zero_phase_band_pass(x, low, high, order))


def principal_components(cells: DataFrame, cell: str, frames: int, k: int = 20, trace: str = "trace", passes: int = 15, rebuilt: bool = False) -> DataFrame:
    """(cell, scores, explained): scores on the first k principal components of the frames over all cells, and the share
    of each cell's own sum of squares that they and the mean trace reproduce; with ``rebuilt``, also that reproduction.
    k is at most the number of frames.

    The passes over all cells start from the components of a bounded, hashed sample, and end when the leading directions
    stand still.
    """
    k = min(k, frames)

    def total(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(1 + frames)
        for b in batches:
            out += np.r_[b.num_rows, matrix(b.column(0), frames).sum(0)]
        return out

    sums = summed(cells, [trace], total, (1 + frames,))
    n, mean = sums[0], sums[1:] / max(1, sums[0])
    wide = min(frames, k + 8)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [matrix(b.column(0), frames) - mean for b in batches]
        _, _, v = np.linalg.svd(np.concatenate(rows) if rows else np.zeros((0, frames)), full_matrices=True)
        yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(v[:wide].T).tobytes()], pa.binary())], ["q"])

    some = cells.filter(F.pmod(F.xxhash64(cell), F.lit(int(n) // SAMPLE + 1)) == 0)
    q = np.frombuffer(bytes(some.select(trace).coalesce(1).mapInArrow(begin, "q binary").first().q)).reshape(frames, wide)
    before = q
    for _ in range(passes):
        shared = cells.sparkSession.sparkContext.broadcast((q, mean))

        def product(batches: Iterator[pa.RecordBatch], shared=shared) -> np.ndarray:
            basis, middle = shared.value
            out = np.zeros(basis.shape)
            for b in batches:
                x = matrix(b.column(0), frames) - middle
                out += x.T @ (x @ basis)
            return out

        y = summed(cells, [trace], product, q.shape)
        values, turn = np.linalg.eigh((q.T @ y + y.T @ q) / 2)
        ritz = q @ turn[:, np.argsort(values)[::-1]]
        settled = q.shape[1] == frames or np.linalg.svd(ritz[:, :k].T @ before[:, :k])[1].min() > 1 - 1e-7
        before, q = ritz, np.linalg.qr(y)[0]
        if settled:
            break
    axes = before[:, :k]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(k)] < 0, -1, 1)
    shared = cells.sparkSession.sparkContext.broadcast((axes, mean))
    numbers = T.ArrayType(T.DoubleType())
    kind = T.StructType([T.StructField("scores", numbers), T.StructField("explained", T.DoubleType()), *([T.StructField("rebuilt", numbers)] if rebuilt else [])])

    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            basis, middle = shared.value
            x = matrix(batch, len(middle))
            scores = (x - middle) @ basis
            again = scores @ basis.T + middle
            explained = 1 - np.square(again - x).sum(1) / np.maximum(np.square(x).sum(1), np.finfo(float).eps)
            lists = [pa.array(list(v), pa.list_(pa.float64())) for v in (scores, again)]
            yield pa.StructArray.from_arrays([lists[0], pa.array(explained), *lists[1 : 1 + rebuilt]], [f.name for f in kind.fields])

    return cells.select(cell, F.arrow_udf(work, kind)(trace).alias("f")).select(cell, "f.*")


def factor_loadings(cells: DataFrame, cell: str, frames: int, k: int, rounds: int = 20, trace: str = "trace") -> DataFrame:
    """(cell, loadings, noise) of ``factor_model``."""
    return factor_model(cells, cell, frames, k, rounds, trace)[0]


def factor_model(cells: DataFrame, cell: str, frames: int, k: int, rounds: int = 20, trace: str = "trace") -> tuple[DataFrame, np.ndarray]:
    """((cell, loadings, noise), scores [k x frames]) of all cells as one group of ``factors.factor_models``."""
    loads, scores = factor_models(cells.withColumn("__g", F.lit(0)), "__g", cell, frames, {0: k}, rounds, trace)
    return loads.drop("__g"), scores.get(0, np.zeros((0, frames)))


def least_squares_scores(loadings: DataFrame, cells: DataFrame, cell: str, frames: int, k: int, trace: str = "trace") -> np.ndarray:
    """Scores (k x frames) that best rebuild the traces from the cells' loadings, by the normal equations."""
    both = cells.select(cell, trace).join(loadings.select(cell, "loadings"), cell)

    def work(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((k, k + frames))
        for b in batches:
            x = matrix(b.column(0), k)
            out[:, :k] += x.T @ x
            out[:, k:] += x.T @ matrix(b.column(1), frames)
        return out

    sums = summed(both, ["loadings", trace], work, (k, k + frames))
    return np.linalg.lstsq(sums[:, :k], sums[:, k:], rcond=None)[0]


def least_squares_loadings(cells: DataFrame, cell: str, scores: np.ndarray, trace: str = "trace") -> DataFrame:
    """(cell, loadings) that best rebuild each trace from given scores (k x frames); every cell where it lies."""
    shared = cells.sparkSession.sparkContext.broadcast(np.linalg.pinv(scores.T))

    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            x = np.array(batch.to_pylist(), float).reshape(len(batch), -1)
            yield pa.array((x @ shared.value.T).tolist(), pa.list_(pa.float64()))

    return cells.select(cell, F.arrow_udf(work, T.ArrayType(T.DoubleType()))(trace).alias("loadings"))


def cluster_labels(loadings: DataFrame, cell: str, k: int, least_cells: int = 100, least_weight: float = 0.2, large: float = 0.9) -> DataFrame:
    """(cell, label): clusters of signed factors, the largest first.

    Every factor gives a positive and a negative column, cut below ``least_weight``. Columns with at most ``least_cells``
    cells go; three times, cells take their strongest column (the first on ties) and columns won by at most
    ``least_cells`` go. Columns are then put in the order of their sizes. If the first holds more than ``large`` of all
    cells and more than half of them also have another column, those move to that one. All cells are 0 without a column.
    """
    count = F.count(F.lit(1))

    def signed(c: int) -> Column:
        x = F.get("loadings", F.lit(c % k))
        return F.when((x > 0) == F.lit(c < k), F.when(F.abs(x) >= least_weight, F.abs(x)).otherwise(0.0)).otherwise(0.0)

    wide = materialize(loadings.select(cell, F.array(*[signed(c) for c in range(2 * k)]).alias("w")), "signed")
    sums = wide.agg(count.alias("n"), *[F.sum((F.get("w", F.lit(c)) > 0).cast("long")).alias(f"c{c}") for c in range(2 * k)]).first()
    columns = [c for c in range(2 * k) if (sums[f"c{c}"] or 0) > least_cells]

    def strongest(columns: Sequence[int]) -> Column:
        return F.array_max(F.array(*[F.struct(F.get("w", F.lit(c)).alias("a"), F.lit(-i).alias("i")) for i, c in enumerate(columns)]))["i"] * -1

    def sizes(columns: Sequence[int]) -> dict[int, int]:
        return {r.at: r.n for r in wide.groupBy(strongest(columns).alias("at")).agg(count.alias("n")).collect()}  # a row a column

    for _ in range(3):
        if columns:
            won = sizes(columns)
            columns = [c for i, c in enumerate(columns) if won.get(i, 0) > least_cells]
    if not columns:
        return wide.select(cell, F.lit(0).alias("label"))
    won = sizes(columns)
    columns = [columns[i] for i in sorted(range(len(columns)), key=lambda i: (-won.get(i, 0), i))]
    label = strongest(columns)
    if len(columns) > 1:
        most = max(sizes(columns))
        other = (label == 0) & F.exists(F.array(*[F.get("w", F.lit(c)) for c in columns[1:]]), lambda x: x > 0)
        share = wide.agg(F.avg((label == 0).cast("double")).alias("first"), F.avg(other.cast("double")).alias("other")).first()
        if share.first > large and share.other > 0.5:
            label = F.when(other, strongest(columns[1:]) + most).otherwise(label)
    return wide.select(cell, label.cast("int").alias("label"))


def noise_ratios(scores: np.ndarray, cutoff: float = 0.06, order: int = 5) -> np.ndarray:
    """The share of each score's energy that a low-pass removes."""
    low = numeric.zero_phase_low_pass(scores, cutoff, order)
    return 1 - np.square(low).sum(1) / np.square(scores).sum(1)


def loading_labels(loadings: DataFrame, cell: str, floor: float = 0.2, keep: Sequence[int] | None = None) -> DataFrame:
    """Adds label: the place of the largest absolute loading, -place - 1 if it is negative, null below ``floor``.

    With ``keep`` only those places count; places stay those of the whole array.
    """
    picked = F.col("loadings") if keep is None else F.transform("loadings", lambda x, i: F.when(i.isin(list(keep)), x).otherwise(F.lit(0.0)))
    top = F.array_max(F.transform(picked, lambda x, i: F.struct(F.abs(x).alias("a"), (-i).alias("i"), x.alias("x"))))
    at = loadings.withColumn("__t", top)
    place = -F.col("__t.i")
    return at.withColumn("label", F.when(F.col("__t.a") >= floor, F.when(F.col("__t.x") >= 0, place).otherwise(-place - 1))).drop("__t")


def ward_groups(cells: DataFrame, group: str, cell: str, trace: str = "z", most: int = 30_000, k: int | None = None, least: int = 1) -> DataFrame:
    """(group, cell, sub): Ward clusters on the rows of each group's rank-correlation matrix; groups under ``least`` cells stay
    whole.

    The matrix is not made: the clustering holds a group's ranks (cells x frames) and blocks of distances, and its time is
    quadratic. So a group gives about ``most`` cells, chosen by a hash, to it. If it is larger, all its cells then take
    the sub-cluster whose mean over those has the best rank correlation, wherever they lie.
    """
    sizes = cells.groupBy(group).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= most).collect()  # the large groups
    step, is_large = F.lit(1), F.lit(False)
    for r in sizes:
        mine = F.col(group).eqNullSafe(F.lit(r[0]))
        step, is_large = F.when(mine, r.n // most + 1).otherwise(step), is_large | mine
    cells = cells.select(group, cell, trace)
    if sizes:
        cells = materialize(cells, "grouped")
    kind = {c: cells.schema[c].dataType.simpleString() for c in (group, cell, trace)}

    def cluster(table: pa.Table) -> pa.Table:
        table = table.sort_by(cell)
        traces = table.column(trace).combine_chunks()
        flat, lengths = traces.flatten().to_numpy(zero_copy_only=False).astype(float), traces.value_lengths().to_numpy(zero_copy_only=False)
        if len(set(lengths.tolist())) > 1:
            raise ValueError(f"traces of group {table.column(group)[0]} differ in length")
        ranks = numeric.average_ranks(flat.reshape(len(traces), -1))
        ranks -= ranks.mean(1, keepdims=True)
        ranks /= np.maximum(np.sqrt(np.square(ranks).sum(1, keepdims=True)), 1e-12)
        count = 1 if len(ranks) < least else k or int(min(10, 2 * (len(ranks) // 1000 + 1)))
        sub = numeric.ward_labels(numeric.correlation_rows(ranks), min(count, len(ranks)))
        return pa.table({group: table.column(group), cell: table.column(cell), trace: table.column(trace), "sub": pa.array(sub, pa.int32())})

    some = cells.filter(F.pmod(F.xxhash64(cell), step) == 0)
    found = some.groupBy(group).applyInArrow(cluster, f"{group} {kind[group]}, {cell} {kind[cell]}, {trace} {kind[trace]}, sub int")
    if not sizes:
        return found.select(group, cell, "sub")
    found = materialize(found, "ward")
    whole = found.filter(~is_large).select(group, cell, "sub")
    for r in sizes:
        mine = F.col(group).eqNullSafe(F.lit(r[0]))
        labels, traces = populations.templates(populations.label_means(found.filter(mine), "sub", trace), "sub")
        joined = populations.assign_templates(cells.filter(mine), labels, traces, -1.0, trace, "sub")
        whole = whole.unionByName(joined.select(group, cell, F.col("sub").cast("int")))
    return whole


def stimulus_offsets(channel: DataFrame, key: str, position: str, value: str, edges: Sequence[float], levels: Sequence[float], step: int = 1) -> DataFrame:
    """(key, offset, mae, matched): how well a cyclic sequence of epochs explains each channel at every offset.

    ``edges`` are cumulative durations: the level at a phase is that of the epoch whose edge first exceeds it. Samples
    are summed by their own phase against each of the few levels first; only those sums, one a key and phase, meet
    the offsets.
    """
    total = int(edges[-1])
    close = 0.02 * (max(levels) - min(levels))
    own = F.pmod(F.col(position), F.lit(total)).cast("int").alias("__p")
    sums = []
    for j, v in enumerate(levels):
        off = F.abs(F.col(value) - float(v))
        sums += [F.sum(off).alias(f"__a{j}"), F.sum((off <= close + 1e-5 * abs(float(v))).cast("long")).alias(f"__m{j}")]
    by_phase = channel.groupBy(key, own).agg(F.count(F.col(value)).alias("__n"), *sums)
    spread = by_phase.withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(total - 1), F.lit(step))))
    phase = F.pmod(F.col("__p") + F.col("offset"), F.lit(total))
    epoch: Column = F.lit(len(levels) - 1)
    for j in range(len(levels) - 2, -1, -1):
        epoch = F.when(phase < edges[j], F.lit(j)).otherwise(epoch)
    at = spread.withColumn("__e", epoch)
    pick = lambda x: F.coalesce(*[F.when(F.col("__e") == j, F.col(f"__{x}{j}")) for j in range(len(levels))])
    n = F.sum("__n")
    return at.groupBy(key, "offset").agg(F.try_divide(F.sum(pick("a")), n).alias("mae"), F.try_divide(F.sum(pick("m")), n.cast("double")).alias("matched"))


def best_offsets(offsets: DataFrame, keys: Sequence[str], spread: float, least_match: float = 0.8, most_error: float = 0.1) -> DataFrame:
    """(keys, offset, mae, matched, direct_match): the offset with the least error, the first one on ties.

    A direct match has at least ``least_match`` of its samples near the level, and an error of at most ``most_error`` of the
    levels' spread.
    """
    best = offsets.groupBy(*keys).agg(F.min(F.struct("mae", "offset", "matched")).alias("b"))
    return best.select(*keys, "b.offset", "b.mae", "b.matched", ((F.col("b.matched") >= least_match) & (F.col("b.mae") <= most_error * spread)).alias("direct_match"))


def choose_channels(matches: DataFrame, fields: Sequence[str], field: str = "field", channel: str = "channel") -> DataFrame:
    """(field, channel, direct_match, mae): one channel a field, in the order of ``fields``.

    Direct matches come first, then the least error, then the channel's name; a channel is given away once, unless all
    are taken. One pass a field, of which there are a handful.
    """
    chosen: DataFrame | None = None
    order = Window.partitionBy(field).orderBy(F.desc("__free"), F.desc("direct_match"), "mae", channel)
    for name in fields:
        own = matches.filter(F.col(field) == name).withColumn("__free", F.lit(True))
        if chosen is not None:
            taken = chosen.select(F.col(channel).alias("__taken")).distinct()
            own = own.join(F.broadcast(taken), F.col(channel) == F.col("__taken"), "left").withColumn("__free", F.col("__taken").isNull()).drop("__taken")
        first = own.withColumn("__r", F.row_number().over(order)).filter("__r = 1").select(field, channel, "direct_match", "mae")
        chosen = first if chosen is None else chosen.unionByName(first)
    return chosen
