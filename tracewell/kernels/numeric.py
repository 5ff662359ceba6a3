"""Small numpy kernels for what SQL cannot express row by row. No Spark here."""

from __future__ import annotations

import math

import numpy as np


def average_ranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 1 along the last axis; ties share the mean of their places."""
    x = np.atleast_2d(np.asarray(x, float))
    order = np.argsort(x, axis=1, kind="stable")
    ordered = np.take_along_axis(x, order, 1)
    out = np.empty_like(x)
    for i in range(len(x)):
        edge = np.flatnonzero(np.r_[True, ordered[i, 1:] != ordered[i, :-1], True])
        out[i, order[i]] = np.repeat((edge[:-1] + edge[1:] + 1) / 2, np.diff(edge))
    return out


def rank_correlations(traces: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Spearman correlation of each trace with each reference; NaN where either is constant.

    Sums of ranks are exact, and one root of the product keeps a rational correlation the double next to it, so that
    one on a threshold is on it (a product of two roots may lie below and push it across).
    """
    a, b = average_ranks(traces), average_ranks(references)
    a, b = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
    scale = np.sqrt(np.outer((a * a).sum(1), (b * b).sum(1)))
    with np.errstate(divide="ignore", invalid="ignore"):
        return a @ b.T / scale


def paired_rank_correlations(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Spearman correlation of each row of ``a`` with the same row of ``b``; NaN where either is constant."""
    x, y = average_ranks(a), average_ranks(b)
    x, y = x - x.mean(1, keepdims=True), y - y.mean(1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        return (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers: Stirling's series, from 15 on."""
    up = np.zeros_like(x)
    while (low := x < 15).any():
        up = np.where(low, up + np.log(np.where(low, x, 1.0)), up)
        x = np.where(low, x + 1, x)
    z = 1 / (x * x)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z * (1 / 1188 - z * 691 / 360360))))) / x
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + series - up


def incomplete_beta(a: np.ndarray | float, b: np.ndarray | float, x: np.ndarray | float) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction, element by element; a and b are positive."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    inside = (x > 0) & (x < 1)
    other = inside & (x > (a + 1) / (a + b + 2))
    a, b, x0 = np.where(other, b, a), np.where(other, a, b), x
    x = np.where(inside, np.where(other, 1 - x, x), 0.5)
    front = np.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    tiny, c = 1e-300, np.ones_like(x)
    d = 1 / np.maximum(1 - (a + b) * x / (a + 1), tiny)
    total = d.copy()
    for m in range(1, 400):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            c = 1 + term / c
            d = 1 / np.where(np.abs(d) > tiny, d, tiny)
            c = np.where(np.abs(c) > tiny, c, tiny)
            total = total * c * d
        if np.all(np.abs(c * d - 1) < 1e-15):
            break
    value = front * total
    return np.where(inside, np.where(other, 1 - value, value), (x0 >= 1).astype(float))


def spearman_p(r: np.ndarray | float, n: np.ndarray | float) -> np.ndarray:
    """Two-sided p-values of rank correlations over n pairs (t distribution, n - 2 degrees of freedom); NaN below 3 pairs."""
    r, n = np.broadcast_arrays(np.asarray(r, float), np.asarray(n, float))
    known, whole = (n >= 3) & np.isfinite(r), np.abs(r) >= 1
    free, inside = np.where(known, n - 2, 1.0), np.where(known & ~whole, r, 0.0)
    t2 = inside * inside * free / (1 - inside * inside)
    return np.where(known, np.where(whole, 0.0, incomplete_beta(free / 2, 0.5, free / (free + t2))), np.nan)


def f_p(f: float, df1: float, df2: float) -> float:
    """Upper tail of the F distribution."""
    return float(incomplete_beta(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))) if f > 0 else 1.0


def lag_matrix(signal: np.ndarray, lags: int) -> np.ndarray:
    """Columns are the signal and its past, zero before the start."""
    padded = np.r_[np.zeros(lags - 1), np.asarray(signal, float)]
    return np.lib.stride_tricks.sliding_window_view(padded, lags)[:, ::-1]


def ridge_solver(design: np.ndarray, strength: float, tau: float) -> tuple[np.ndarray, np.ndarray]:
    """(matrix from centred responses to weights, column means); the penalty grows as exp(lag / tau)."""
    mean = design.mean(0)
    x = design - mean
    penalty = strength * np.diag(np.exp(np.arange(design.shape[1]) / tau))
    return np.linalg.solve(x.T @ x + penalty, x.T), mean


def logistic_fit(x: np.ndarray, y: np.ndarray, rounds: int = 100, tol: float = 1e-6) -> dict:
    """Unpenalised logistic regression by reweighted least squares; ``x`` has its own constant column."""
    beta, separated = np.zeros(x.shape[1]), False
    for _ in range(rounds):
        eta = np.clip(x @ beta, -30, 30)
        p = 1 / (1 + np.exp(-eta))
        if np.all(np.abs(p - y) < 1e-6):
            separated = True
            break
        w = np.maximum(p * (1 - p), 1e-12)
        new = np.linalg.lstsq(x * np.sqrt(w)[:, None], np.sqrt(w) * (eta + (y - p) / w), rcond=None)[0]
        done = np.max(np.abs(new - beta)) < tol
        beta = new
        if done:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ beta, -30, 30))), 1e-15, 1 - 1e-15)
    llf = float(np.sum(y * np.log(p) + (1 - y) * np.log1p(-p)))
    m, n = y.mean(), len(y)
    null = float(n * (m * math.log(m) + (1 - m) * math.log(1 - m))) if 0 < m < 1 else 0.0
    return {"params": beta, "llf": llf, "r2": 1 - math.exp(min(0.0, 2 * (null - llf) / n)), "aic": 2 * x.shape[1] - 2 * llf, "separated": separated}


def logistic_fits(x: np.ndarray, y: np.ndarray, chosen: np.ndarray, rounds: int = 100, tol: float = 1e-6) -> dict[str, np.ndarray]:
    """``logistic_fit`` of several subsets of the same rows at once: ``chosen`` (fits x rows) says which rows a fit has."""
    return {k: v[0] for k, v in grouped_logistic_fits(x[None], y[None], chosen[None], rounds, tol).items()}


def grouped_logistic_fits(x: np.ndarray, y: np.ndarray, chosen: np.ndarray, rounds: int = 100, tol: float = 1e-6) -> dict[str, np.ndarray]:
    """``logistic_fit`` of several subsets of the rows of many groups at once: x (groups x rows x k), y (groups x rows), chosen
    (groups x fits x rows); rows that only fill a group up are in no fit.

    Every step solves all fits' k x k systems together; a fit that is done or separated stays as it is. Groups without
    unfinished fits are left out, and where few fits go on, each is carried on by itself. Fits whose rows have one
    outcome only are NaN.
    """
    k = x.shape[2]
    c = chosen.astype(float)
    n, ones = c.sum(2), (c @ y[:, :, None])[:, :, 0]
    beta, separated = np.zeros((*n.shape, k)), np.zeros(n.shape, bool)
    live = (ones > 0) & (ones < n)
    known = live.copy()

    def solved(left: np.ndarray, right: np.ndarray, of: np.ndarray) -> np.ndarray:
        new = np.full_like(right, np.nan)
        try:
            new = np.linalg.solve(left, right[:, :, None])[:, :, 0]
        except np.linalg.LinAlgError:  # some are singular: their groups' columns depend on each other
            fine = ~np.isin(of, of[np.linalg.slogdet(left)[0] == 0])
            if fine.any():
                new[fine] = np.linalg.solve(left[fine], right[fine][:, :, None])[:, :, 0]
        odd = ~(np.abs(new).max(1) < 1e8)  # dependent columns: the shortest solution
        if odd.any():
            new[odd] = (np.linalg.pinv(left[odd], rcond=1e-13, hermitian=True) @ right[odd][:, :, None])[:, :, 0]
        return new

    def go_on(x: np.ndarray, y: np.ndarray, c: np.ndarray, beta: np.ndarray, live: np.ndarray, separated: np.ndarray, of: np.ndarray, rounds: int, apart: bool) -> int:
        """Steps in place until all are done, or (unless ``apart``) few fits of the groups at work are left; the steps taken."""
        held = None
        for step in range(rounds):
            at = np.flatnonzero(live.any(1))
            if not len(at) or (not apart and 4 * live.sum() < live[at].size):
                return step
            if held is None or len(at) < len(held[0]):
                held = at, x[at], y[at][:, None], c[at], (x[at][:, :, :, None] * x[at][:, :, None, :]).reshape(len(at), x.shape[1], k * k)
            _, xa, ya, ca, products = held
            eta = np.clip(beta[at] @ xa.transpose(0, 2, 1), -30, 30)
            p = 1 / (1 + np.exp(-eta))
            gone = ~((np.abs(p - ya) >= 1e-6) & (ca > 0)).any(2) & live[at]
            separated[at] |= gone
            going = live[at] & ~gone
            w = np.maximum(p * (1 - p), 1e-12)
            left = ((ca * w) @ products)[going].reshape(-1, k, k)
            right = ((ca * (w * eta + (ya - p))) @ xa)[going]
            new = solved(left, right, of[at[np.nonzero(going)[0]]]) if len(left) else right
            old = beta[at]
            done = np.abs(new - old[going]).max(1) < tol if len(new) else np.zeros(0, bool)
            old[going] = new
            beta[at] = old
            going[going] = ~done
            live[at] = going
        return rounds

    taken = go_on(x, y, c, beta, live, separated, np.arange(len(x)), rounds, False)
    g, f = np.nonzero(live)
    for at in range(0, len(g), 256):
        i, j = g[at : at + 256], f[at : at + 256]
        own, apart = beta[i, j][:, None], np.zeros((len(i), 1), bool)
        rows = np.argsort(c[i, j] == 0, axis=1, kind="stable")[:, : int(n[i, j].max())]  # those that the fits have
        go_on(x[i[:, None], rows], y[i[:, None], rows], np.take_along_axis(c[i, j], rows, 1)[:, None], own, np.ones((len(i), 1), bool), apart, i, rounds - taken, True)
        beta[i, j], separated[i, j] = own[:, 0], apart[:, 0]
    p = np.clip(1 / (1 + np.exp(-np.clip(beta @ x.transpose(0, 2, 1), -30, 30))), 1e-15, 1 - 1e-15)
    llf = (c * (y[:, None] * np.log(p) + (1 - y[:, None]) * np.log1p(-p))).sum(2)
    with np.errstate(divide="ignore", invalid="ignore"):
        share = ones / n
        null = np.where(known, n * (share * np.log(share) + (1 - share) * np.log(1 - share)), np.nan)
        r2 = 1 - np.exp(np.minimum(0.0, 2 * (null - llf) / n))
    gone = np.where(known, 0.0, np.nan)
    return {"n": n, "params": beta + gone[:, :, None], "llf": llf + gone, "r2": r2 + gone, "aic": 2 * k - 2 * llf + gone, "separated": separated}


def butterworth_low(order: int, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    """(b, a) of a digital low-pass; ``cutoff`` is a share of the Nyquist frequency."""
    warped = 4 * math.tan(math.pi * cutoff / 2)
    poles = warped * np.exp(1j * math.pi * (2 * np.arange(order) + 1 + order) / (2 * order))
    z = (4 + poles) / (4 - poles)
    a = np.real(np.poly(z))
    b = np.real(np.poly(-np.ones(order)))
    return b * a.sum() / b.sum(), a


def _filtered(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Direct form II transposed along the last axis, all rows at once."""
    out, z = np.empty_like(x), state.copy()
    for t in range(x.shape[1]):
        out[:, t] = b[0] * x[:, t] + z[:, 0]
        z[:, :-1] = z[:, 1:] + np.outer(x[:, t], b[1:-1]) - np.outer(out[:, t], a[1:-1])
        z[:, -1] = b[-1] * x[:, t] - a[-1] * out[:, t]
    return out


def zero_phase_low_pass(x: np.ndarray, cutoff: float, order: int = 5) -> np.ndarray:
    """Forward and backward low-pass of each row, with odd padding of three filter lengths and settled states."""
    b, a = butterworth_low(order, cutoff)
    pad = min(3 * (order + 1), x.shape[1] - 1)
    wide = np.concatenate([2 * x[:, :1] - x[:, pad:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]], 1)
    companion = np.eye(order) - np.column_stack([np.r_[-a[1:]], np.eye(order)[:, : order - 1]])
    settled = np.linalg.solve(companion, b[1:] - a[1:] * b[0])
    for _ in range(2):
        wide = _filtered(b, a, wide, np.outer(wide[:, 0], settled))[:, ::-1]
    return wide[:, pad : pad + x.shape[1]]


def causal_low_pass(x: np.ndarray, cutoff: float, order: int = 5) -> np.ndarray:
    """Forward low-pass of each row from rest."""
    b, a = butterworth_low(order, cutoff)
    return _filtered(b, a, x, np.zeros((len(x), order)))


def band_sections(order: int, low: float, high: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """(b, a) of a digital band-pass as ``order`` second-order sections; edges are shares of the Nyquist frequency."""
    lo, hi = 4 * math.tan(math.pi * low / 2), 4 * math.tan(math.pi * high / 2)
    width, centre = hi - lo, lo * hi
    around = width / 2 * np.exp(1j * math.pi * (2 * np.arange(order) + 1 + order) / (2 * order))
    root = np.sqrt(around**2 - centre)
    poles = np.concatenate([around + root, around - root])
    digital = (4 + poles) / (4 - poles)
    gain = float(np.real((width * 4) ** order / np.prod(4 - poles)))
    pairs = [np.array([p, np.conj(p)]) for p in digital[digital.imag > 1e-12]]
    real = np.sort(np.real(digital[np.abs(digital.imag) <= 1e-12]))
    pairs += [real[i : i + 2] for i in range(0, len(real), 2)]
    zeros, sections = [1.0] * order + [-1.0] * order, []
    for pair in sorted(pairs, key=lambda p: abs(1 - np.abs(p).max())):  # the nearest to the circle chooses first and comes last
        mine = sorted(zeros, key=lambda z: abs(z - pair[0]))[:2]
        for z in mine:
            zeros.remove(z)
        sections.append((np.poly(mine), np.real(np.poly(pair))))
    sections.reverse()
    return [(sections[0][0] * gain, sections[0][1]), *sections[1:]]


def zero_phase_band_pass(x: np.ndarray, low: float, high: float, order: int = 5) -> np.ndarray:
    """Forward and backward band-pass of each row without padding; every pass starts as if settled at its first value."""
    parts = band_sections(order, low, high)
    for _ in range(2):
        scale = 1.0  # of a constant input, after the sections before
        first = x[:, 0].copy()
        for b, a in parts:
            companion = np.eye(2) - np.column_stack([-a[1:], np.eye(2)[:, :1]])
            settled = np.linalg.solve(companion, b[1:] - a[1:] * b[0])
            x = _filtered(b, a, x, np.outer(first * scale, settled))
            scale *= b.sum() / a.sum()
        x = x[:, ::-1]
    return x


def sliding_rank(x: np.ndarray, size: int, percentile: float, step: int = 1) -> np.ndarray:
    """Rank filter of every step-th value, mirrored at the ends, made as long as ``x`` by straight lines."""
    taken = x[::step]
    if not len(taken):
        return x
    place = min(size - 1, int(size * percentile / 100))
    wide = np.pad(taken, (size // 2, size - size // 2 - 1), mode="symmetric")
    views = np.lib.stride_tricks.sliding_window_view(wide, size)
    block = max(1, (1 << 22) // size)
    low = np.concatenate([np.partition(views[at : at + block], place, axis=1)[:, place] for at in range(0, len(views), block)])
    if step == 1 or len(low) == 1:
        return np.repeat(low, step)[: len(x)]
    at = np.arange(len(x))
    k = np.minimum(at // step, len(low) - 2)
    return low[k] + (low[k + 1] - low[k]) * (at - k * step) / step


def varimax(loadings: np.ndarray, rounds: int = 1000, tol: float = 1e-10) -> np.ndarray:
    """Rotation (k x k) that maximises the variance of squared loadings (cells x k)."""
    turn = np.eye(loadings.shape[1])
    for _ in range(rounds):
        x = loadings @ turn
        u, _, v = np.linalg.svd(loadings.T @ (x**3 - x * (x * x).mean(0)))
        moved, turn = np.abs(u @ v - turn).max(), u @ v
        if moved < tol:
            break
    return turn


def correlation_rows(ranks: np.ndarray) -> np.ndarray:
    """Points of as many columns as ``ranks`` (standardised rows r) whose distances are those of the rows of ``r @ r.T``.

    |R (r_i - r_j)|^2 is a quadratic form in R'R, so R (R'R)^(1/2) has the same distances without an n x n matrix.
    """
    weights, axes = np.linalg.eigh(ranks.T @ ranks)
    return ranks @ (axes * np.sqrt(np.maximum(weights, 0)))


def _nearest(points: np.ndarray, square: np.ndarray, size: np.ndarray, rows: np.ndarray, cells: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """(growth of the sum of squares, place) of the cheapest partner of each of ``rows``, some ``cells`` distances at a time."""
    least, near = np.empty(len(rows)), np.empty(len(rows), int)
    step = max(1, cells // max(1, len(points)))
    for a in range(0, len(rows), step):
        own = rows[a : a + step]
        d = points[own] @ points.T
        d *= -2
        d += square[own, None]
        d += square
        np.maximum(d, 0, out=d)
        d *= size
        d *= size[own, None]
        d /= size[own, None] + size
        d[np.arange(len(own)), own] = np.inf
        near[a : a + step] = d.argmin(1)
        least[a : a + step] = d[np.arange(len(own)), near[a : a + step]]
    return least, near


def ward_labels(points: np.ndarray, k: int) -> np.ndarray:
    """Labels 1..k of Ward's clustering (merging what adds least to the sum of squares), in the order of each one's first row.

    All pairs that are each other's nearest are merged in a round. A merged cluster is no nearer to a third than its nearer
    part was, so only clusters whose partner went, and the merged ones, look again, by matrix products over blocks. The
    tree is that of one merge at a time; its cheapest n - k merges count. Memory is that of the points and a block.
    """
    n = len(points)
    if not n:
        return np.zeros(0, int)
    points = points - points.mean(0)
    root, size = np.arange(n), np.ones(n)  # of each cluster: its first row, its rows
    square = np.square(points).sum(1)
    least, near = _nearest(points, square, size, np.arange(n))
    merges: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(points) > 1:
        at = np.arange(len(points))
        left = np.flatnonzero((near[near] == at) & (at < near))
        if not len(left):  # ties that rounding set in a circle
            left = np.array([least.argmin()])
        right = near[left]
        merges.append((least[left], root[left], root[right]))
        total = size[left] + size[right]
        points[left] = (points[left] * size[left, None] + points[right] * size[right, None]) / total[:, None]
        size[left], root[left] = total, np.minimum(root[left], root[right])
        square[left] = np.square(points[left]).sum(1)
        gone = np.zeros(len(points), bool)
        gone[right] = True
        moved = gone.copy()
        moved[left] = True
        stale = (moved | moved[near])[~gone]
        place = np.cumsum(~gone) - 1
        points, size, square, root, least, near = points[~gone], size[~gone], square[~gone], root[~gone], least[~gone], place[near[~gone]]
        again = np.flatnonzero(stale)
        least[again], near[again] = _nearest(points, square, size, again)
    parent = np.arange(n)

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    if merges:
        cost, a, b = (np.concatenate(x) for x in zip(*merges, strict=True))
        for m in np.argsort(cost, kind="stable")[: n - max(1, k)]:
            i, j = top(int(a[m])), top(int(b[m]))
            parent[max(i, j)] = min(i, j)
    return np.unique([top(i) for i in range(n)], return_inverse=True)[1] + 1
