"""A gated recurrent language model in numpy: truncated backpropagation and a class-factored output softmax.

Documents are dealt onto lanes that advance together; a lane's state starts anew with each document and is carried
from window to window within it, so scores are those of complete documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CLASS = 48
EMBED, HIDDEN = 16, 24
#: Model ids: the end (also the start of every document), any word without an id, then words by falling count.
END, OTHER = 0, 1


def new_model(counts: np.ndarray, seed: int = 0) -> dict[str, np.ndarray]:
    """Starts at the unigram distribution of ``counts`` (one per model id)."""
    rng = np.random.default_rng(seed)
    classes = -(-len(counts) // CLASS)
    padded = np.zeros(classes * CLASS)
    padded[: len(counts)] = counts + 0.5
    by = padded.reshape(classes, CLASS)
    with np.errstate(divide="ignore"):
        within = np.maximum(np.log(by / by.sum(1, keepdims=True)), -30)
    draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    return {
        "embed": draw(classes * CLASS, EMBED),
        "wx": draw(EMBED, 3 * HIDDEN) * 3,
        "bx": np.zeros(3 * HIDDEN, np.float32),
        "ug": draw(HIDDEN, 2 * HIDDEN) * 2,
        "uc": draw(HIDDEN, HIDDEN) * 2,
        "wc": draw(HIDDEN, classes) * 0.1,
        "bc": np.log(by.sum(1) / by.sum()).astype(np.float32),
        "ww": draw(classes, HIDDEN, CLASS) * 0.1,
        "bw": within.astype(np.float32),
    }


def lanes(sizes: np.ndarray, count: int) -> list[list[int]]:
    """Deals texts onto lanes, the longest first, each to the lane with least so far; the longest lane comes first."""
    import heapq

    count = max(1, min(count, len(sizes)))
    heap = [(0, i) for i in range(count)]
    dealt: list[list[int]] = [[] for _ in range(count)]
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, lane = heapq.heappop(heap)
        dealt[lane].append(i)
        heapq.heappush(heap, (size + int(sizes[i]), lane))
    return sorted(dealt, key=lambda d: -int(sizes[d].sum()))


def windows(texts: list[np.ndarray], count: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(inputs, targets, fresh, text index) of each window, [steps, lanes]; lanes that have ended fall away.

    Targets beyond a lane's end are -1. All lanes lie in one flat array, so their number and the longest text's
    length cost no padding.
    """
    if not texts:
        return
    sizes = np.array([len(t) for t in texts], np.int64)
    dealt = lanes(sizes, count)
    order = np.concatenate([np.array(d, np.int64) for d in dealt])
    target = np.concatenate([texts[i] for i in order]).astype(np.int64)
    owner = np.repeat(order, sizes[order])
    length = np.array([sizes[d].sum() for d in dealt])
    start = np.cumsum(length) - length
    before = np.r_[np.int64(END), target[:-1]]  # a text's last target is the end, so every lane starts after one
    for at in range(0, int(length[0]), width):
        live = int(np.searchsorted(-length, -at, "left"))
        steps = min(width, int(length[0]) - at)
        place = start[:live] + at + np.arange(steps)[:, None]
        inside = np.arange(at, at + steps)[:, None] < length[:live]
        place = np.where(inside, place, 0)
        x = np.where(inside, before[place], END)
        # the end as input means a fresh start
        yield x, np.where(inside, target[place], -1), x == END, owner[place]


def _forward(p: dict, h: np.ndarray, xw: np.ndarray, fresh: np.ndarray, keep: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """States after every step. With ``keep``, what the way back needs goes there."""
    out = np.empty((*xw.shape[:2], HIDDEN), xw.dtype)
    stay = (~fresh).astype(xw.dtype)[:, :, None]
    if keep is not None:
        keep |= {k: np.empty_like(out) for k in ("hp", "z", "r", "c")} | {"stay": stay}
    xg, xc, ug, uc = -xw[:, :, : 2 * HIDDEN], xw[:, :, 2 * HIDDEN :], -p["ug"], p["uc"]
    for t in range(len(xw)):
        hp = h * stay[t]
        gates = hp @ ug
        gates += xg[t]
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        r = np.multiply(gates[:, HIDDEN:], hp)
        c = r @ uc
        c += xc[t]
        c *= 2  # tanh by exp, which numpy does several at a time; past 2c = 88 the reciprocal is 0
        np.exp(c, out=c)
        c += 1
        np.reciprocal(c, out=c)
        c *= -2
        c += 1
        step = c - hp
        step *= gates[:, :HIDDEN]
        h = np.add(hp, step, out=out[t])
        if keep is not None:
            keep["hp"][t], keep["z"][t], keep["r"][t], keep["c"][t] = hp, gates[:, :HIDDEN], gates[:, HIDDEN:], c
    return out, h.copy()


def _softmax_terms(a: np.ndarray, chosen: np.ndarray, every: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(log probability of the chosen column of each row, all probabilities); ``a`` is overwritten by the latter, which are
    left without their common divisor unless ``every`` is asked for."""
    at = np.arange(len(a)) * a.shape[1] + chosen
    if len(a):
        a -= a.max()  # of all rows: far cheaper than row by row
    low = np.flatnonzero(a.max(1) < -60) if len(a) and a.min() < -60 else ()
    if len(low):  # rows whose terms would vanish
        a[low] -= a[low].max(1, keepdims=True)
    picked = a.ravel().take(at).astype(np.float64)
    np.exp(a, out=a)
    total = a @ np.ones(a.shape[1], a.dtype)
    if every:
        a /= total[:, None]
    return picked - np.log(total), a


def _with_ones(h: np.ndarray) -> np.ndarray:
    wide = np.ones((len(h), HIDDEN + 1), h.dtype)
    wide[:, :HIDDEN] = h
    return wide


def log_probabilities(p: dict, h: np.ndarray, y: np.ndarray, grad: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log probability of each target; with ``grad``, adds the loss's gradients there and returns that to h.

    Targets are put in the order of their classes, so the words of a class are one slice; biases are a last weight row
    that meets a column of ones.
    """
    order = np.argsort((y // CLASS).astype(np.int16), kind="stable")
    h, y = _with_ones(h.take(order, 0)), y.take(order)
    kind = y // CLASS
    word = y - kind * CLASS
    starts = np.flatnonzero(np.r_[True, np.diff(kind) != 0]) if len(y) else np.zeros(0, np.int64)
    parts = [(int(kind[s]), slice(int(s), int(e))) for s, e in zip(starts, np.r_[starts[1:], len(y)], strict=True)]
    wc, ww = np.vstack([p["wc"], p["bc"]]), np.concatenate([p["ww"], p["bw"][:, None]], 1)
    first, d1 = _softmax_terms(h @ wc, kind, grad is not None)
    inner = np.empty((len(y), CLASS), h.dtype)
    for k, at in parts:
        np.matmul(h[at], ww[k], out=inner[at])
    second, d2 = _softmax_terms(inner, word, grad is not None)
    logp = np.empty(len(y))
    logp[order] = first + second
    if grad is None:
        return logp, None
    rows = np.arange(len(y)) * CLASS
    d1.reshape(-1)[np.arange(len(y)) * d1.shape[1] + kind] -= 1
    d2.reshape(-1)[rows + word] -= 1
    g = h.T @ d1
    grad["wc"] += g[:HIDDEN]
    grad["bc"] += g[HIDDEN]
    dh = d1 @ p["wc"].T
    for k, at in parts:
        g = h[at].T @ d2[at]
        grad["ww"][k] += g[:HIDDEN]
        grad["bw"][k] += g[HIDDEN]
        dh[at] += d2[at] @ p["ww"][k].T
    back = np.empty_like(dh)
    back[order] = dh
    return logp, back


def _backward(p: dict, keep: dict, d_out: np.ndarray, grad: dict) -> np.ndarray:
    """Gradients of the recurrent weights, and those of the steps' inputs [steps x lanes, 3 x HIDDEN]."""
    hp, z, r, c, stay = (keep[k] for k in ("hp", "z", "r", "c", "stay"))
    rest = 1 - z
    to_c, to_z, to_r, carried = z * (1 - c * c), (c - hp) * z * rest, hp * r * (1 - r), rest * stay
    dxw = np.empty((*d_out.shape[:2], 3 * HIDDEN), d_out.dtype)
    dh = np.zeros_like(d_out[0])
    uc, ug = np.ascontiguousarray(p["uc"].T), np.ascontiguousarray(p["ug"].T)
    for t in range(len(d_out) - 1, -1, -1):
        dh += d_out[t]
        dc = dh * to_c[t]
        drh = dc @ uc
        row = dxw[t]
        np.multiply(dh, to_z[t], out=row[:, :HIDDEN])
        np.multiply(drh, to_r[t], out=row[:, HIDDEN : 2 * HIDDEN])
        row[:, 2 * HIDDEN :] = dc
        drh *= r[t]
        drh += row[:, : 2 * HIDDEN] @ ug
        drh *= stay[t]
        dh *= carried[t]
        dh += drh
    flat = dxw.reshape(-1, 3 * HIDDEN)
    grad["uc"] += (r * hp).reshape(-1, HIDDEN).T @ flat[:, 2 * HIDDEN :]
    grad["ug"] += hp.reshape(-1, HIDDEN).T @ flat[:, : 2 * HIDDEN]
    return flat


def train(p: dict[str, np.ndarray], texts: list[np.ndarray], adam: dict | None = None, rate: float = 4e-3, count: int = 256, width: int = 20) -> dict:
    """One pass of truncated backpropagation over the texts, in place; returns the optimiser's state."""
    adam = adam or {"step": 0, "m": {k: np.zeros_like(v) for k, v in p.items()}, "v": {k: np.zeros_like(v) for k, v in p.items()}}
    kind = p["embed"].dtype
    h = np.zeros((0, HIDDEN), kind)
    for x, y, fresh, _ in windows(texts, count, width):
        h = h[: x.shape[1]] if len(h) else np.zeros((x.shape[1], HIDDEN), kind)
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        keep: dict = {}
        inputs, size = x.ravel(), len(p["embed"])
        table = p["embed"] @ p["wx"] + p["bx"]
        out, h = _forward(p, h, table.take(inputs, 0).reshape(*x.shape, -1), fresh, keep)
        at = np.flatnonzero(y.ravel() >= 0)
        _, dk = log_probabilities(p, out.reshape(-1, HIDDEN).take(at, 0), y.ravel().take(at), grad)
        d_out = np.zeros_like(out)
        d_out.reshape(-1, HIDDEN)[at] = dk
        flat = _backward(p, keep, d_out, grad)
        grad["wx"] += p["embed"].take(inputs, 0).T @ flat
        grad["bx"] += np.ones(len(flat), kind) @ flat
        for j, row in enumerate(p["wx"] @ flat.T):
            grad["embed"][:, j] += np.bincount(inputs, row, size)
        scale = kind.type(1 / max(1, len(at)))
        adam["step"] += 1
        slow, fast = 1 - 0.9 ** adam["step"], 1 - 0.999 ** adam["step"]
        for k, g in grad.items():
            g *= scale
            np.clip(g, -0.1, 0.1, out=g)
            m, v = adam["m"][k], adam["v"][k]
            part = g - m
            part *= kind.type(0.1)
            m += part
            g *= g
            g -= v
            g *= kind.type(0.001)
            v += g
            np.divide(v, kind.type(fast), out=g)
            np.sqrt(g, out=g)
            g += kind.type(1e-8)
            np.multiply(m, kind.type(rate / slow), out=part)
            part /= g
            p[k] -= part
    return adam


def score(p: dict[str, np.ndarray], texts: list[np.ndarray], count: int = 1024, width: int = 32) -> np.ndarray:
    """Log10 probability of each text, whose last id is the end."""
    total = np.zeros(len(texts))
    table = p["embed"] @ p["wx"] + p["bx"]
    h = np.zeros((0, HIDDEN), table.dtype)
    for x, y, fresh, who in windows(texts, count, width):
        h = h[: x.shape[1]] if len(h) else np.zeros((x.shape[1], HIDDEN), table.dtype)
        out, h = _forward(p, h, table.take(x.ravel(), 0).reshape(*x.shape, -1), fresh)
        at = np.flatnonzero(y.ravel() >= 0)
        logp, _ = log_probabilities(p, out.reshape(-1, HIDDEN).take(at, 0), y.ravel().take(at))
        total += np.bincount(who.ravel().take(at), logp, len(total))
    return total / np.log(10)


def flatten(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([v.ravel() for v in p.values()])


def restore(p: dict[str, np.ndarray], flat: np.ndarray) -> dict[str, np.ndarray]:
    """Parameters shaped as those of ``p``."""
    out, at = {}, 0
    for k, v in p.items():
        out[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
        at += v.size
    return out
