"""Periodic runs of words: maximal stretches that repeat with a smallest period q over at least two periods.

Periods are solved by octaves [P, 2P). A document is cut into overlapping tiles per octave, 16 P words long (and at
least ``BASE``), that overlap by 4 P, so every two periods lie in one tile. A tile is solved alone: boundaries stand
every P / 2 words, and a run of period q covers a whole step behind some boundary b, so the step's hash recurs q words on;
there, the boundary's Z-functions (how far the words behind b, and those before it, agree with the words q further on)
give the run's extent inside the tile. Fragments are shuffled by document and period and stitched where they overlap.

Documents that fit one tile have nothing to stitch and are finished where they lie, many in one tile, set
apart by words that occur once. Only longer ones are dealt out.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import row_digest, small_batches
from tracewell.session import broadcast_if_small, materialize

#: Words of the smallest tile; it serves all octaves whose own tiles would be shorter.
BASE = 1 << 14
#: Words of a tile, and of its overlap with the next, per word of the octave's least period.
TILE, OVERLAP = 16, 4
#: A run has at least so many words, and twice its period.
LEAST = 12
#: Every third doubling of the window hashes is kept for the Z-functions.
_KEPT = 3
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two windows in order; not linear, so no texts are built of which sums agree."""
    h = a * _A
    h ^= h >> np.uint64(29)
    h += b
    h *= _B
    h ^= h >> np.uint64(32)
    h *= _C
    h ^= h >> np.uint64(31)
    return h


def _step(octave: int) -> int:
    """Log2 of the boundaries' distance: a run's pairs of equal words, LEAST - q or q at least, cover a whole step."""
    return 2 if octave < 2 else octave - 1


def _reach(kept: dict[int, np.ndarray], at: np.ndarray, period: np.ndarray, n: int, back: bool) -> np.ndarray:
    """Z-function values: for how many words the tile agrees with itself ``period`` on, from ``at`` or before it."""
    far = np.zeros(len(at), np.int64)
    todo = np.arange(len(at))
    for level in sorted(kept, reverse=True):
        hashes, width = kept[level], 1 << level
        live = todo
        # at most 2**_KEPT - 1 windows of this level follow, but for the highest
        while len(live):
            i = at[live] - far[live] - width if back else at[live] + far[live]
            inside = (i >= 0) if back else (i + period[live] + width <= n)
            live, i = live[inside], i[inside]
            same = hashes[i] == hashes[i + period[live]]
            live = live[same]
            far[live] += width
    return far


def _primes(n: int) -> list[int]:
    found, p = [], 2
    while p * p <= n:
        if n % p == 0:
            found.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return found + [n] * (n > 1)


def fragments(ids: np.ndarray, low: int = 0, high: int = 62) -> np.ndarray:
    """(period, start, stop) of the maximal runs inside a tile whose smallest period is in octaves low to high.

    ``ids`` are numbers of words, equal where words are. Runs have at least LEAST words and two periods.
    """
    n = len(ids)
    none = np.zeros((0, 3), np.int64)
    if n < LEAST:
        return none
    with np.errstate(over="ignore"):
        hashes = _joined(ids.astype(np.uint64), np.full(n, _C))
        top = n.bit_length() - 1
        kept: dict[int, np.ndarray] = {}
        wanted = [k for k in range(low, high + 1) if max(LEAST, 2 << k) <= n]
        ats, periods = [], []
        for level in range(top + 1):
            if level % _KEPT == 0:
                kept[level] = hashes
            for octave in (k for k in wanted if _step(k) == level):
                least, step = 1 << octave, 1 << level
                if len(hashes) <= least:
                    continue
                # rows: boundaries; columns: periods least .. 2 least - 1, past the end where the tile ends
                padded = np.concatenate([hashes[least:], np.zeros(least, np.uint64)])
                behind = sliding_window_view(padded, least)[: len(hashes) - least : step]
                hit = behind == hashes[: len(hashes) - least : step][: len(behind), None]
                hit[1:] &= ~hit[:-1] if hit.any() else False  # of steps in a row that recur, the first
                row, column = np.nonzero(hit)
                ats.append(row * step)
                periods.append(column + least)
            if level < top:
                width = 1 << level
                hashes = _joined(hashes[:-width], hashes[width:])
    at, period = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ats, periods))
    fits = at + period < n
    at, period = at[fits], period[fits]
    if not len(at):
        return none
    start = at - _reach(kept, at, period, n, True)
    stop = at + _reach(kept, at, period, n, False) + period
    found = np.unique(np.stack([period, start, stop], 1)[stop - start >= np.maximum(LEAST, 2 * period)], axis=0)
    return found[_primitive(kept, found, n)] if len(found) else none


def _primitive(kept: dict[int, np.ndarray], found: np.ndarray, n: int) -> np.ndarray:
    """Whether the period is the smallest: a smaller one divides it (both fit in twice), so its primes are tried."""
    period, start = found[:, 0], found[:, 1]
    primes = [_primes(q) if q > 1 else [] for q in period.tolist()]
    row = np.repeat(np.arange(len(found)), [len(p) for p in primes])
    part = period[row] // np.array([p for ps in primes for p in ps], np.int64)
    again = _reach(kept, start[row], part, n, False) >= period[row] - part
    return np.bincount(row[again], minlength=len(found)) == 0


def _exact(ids: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Checks every fragment word by word; a tile in which hashes of different words met is solved without them."""
    for q, s, e in found.tolist():
        if not np.array_equal(ids[s : e - q], ids[s + q : e]):
            return _plainly(ids, np.unique(found[:, 0]))
    return found


def _plainly(ids: np.ndarray, periods: np.ndarray) -> np.ndarray:
    """Runs of the given periods from the places where words q apart are equal."""
    rows = []
    for q in periods.tolist():
        edge = np.flatnonzero(np.diff(np.r_[False, ids[:-q] == ids[q:], False]))
        for s, e in zip(edge[::2].tolist(), (edge[1::2] + q).tolist()):
            if e - s >= max(LEAST, 2 * q) and not any(np.array_equal(ids[s : s + q - q // p], ids[s + q // p : s + q]) for p in _primes(q)):
                rows.append((q, s, e))
    return np.array(rows, np.int64).reshape(-1, 3)


def rewritten(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Every tenth document (by the checksum of its id; null ids count as the empty text) repeats a passage of itself
    from some word on."""
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


_RESULT = pa.schema(
    [("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]
)
_RESULT_SQL = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def collapse(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that stay when of every run (start, period, length) only its first period does."""
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 1], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 2], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]


def _summary(doc_id: int | None, words: list[bytes], runs: np.ndarray) -> tuple:
    """The result row of a document; runs are (start, period, length) in that order."""
    if not len(runs):
        return (doc_id, 0, None, None, None, None, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest())
    listed = "".join(f"{s},{l},{q}\n" for s, q, l in runs.tolist())
    s, q, l = runs[np.lexsort((runs[:, 1], runs[:, 0], -runs[:, 2]))[0]].tolist()
    return (doc_id, len(runs), s, l, q, 1000 * l // q, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapse(words, runs))).hexdigest())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(_RESULT), _RESULT)], schema=_RESULT)


def _ordered(found: np.ndarray) -> np.ndarray:
    """(period, start, stop) as (start, period, length), sorted."""
    runs = np.stack([found[:, 1], found[:, 0], found[:, 2] - found[:, 1]], 1)
    return runs[np.lexsort((runs[:, 1], runs[:, 0]))]


def _whole(base: int):
    """(doc_id, text) of documents that fit one tile; a tile takes as many as it holds."""

    def solve(held: list[tuple[int | None, list[bytes]]]) -> pa.RecordBatch:
        number: dict = {}
        ids: list[int] = []
        starts = []
        for doc, (_, words) in enumerate(held):
            starts.append(len(ids))
            ids += [number.setdefault(w, len(number)) for w in words]
            ids.append(-1 - doc)  # a word of its own
        tile, begin = np.array(ids, np.int64), np.array(starts)
        found = _ordered(_exact(tile, fragments(tile, 0, max(0, max(len(w) for _, w in held).bit_length() - 1))))
        doc = np.searchsorted(begin, found[:, 0], "right") - 1
        cut = np.searchsorted(doc, np.arange(len(held) + 1))
        return _batch([_summary(d, w, found[cut[i] : cut[i + 1]] - np.array([starts[i], 0, 0])) for i, (d, w) in enumerate(held)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words = rewritten(doc_id, (text or b"").split())  # of bytes: the six ASCII white spaces only
                if held and size + len(words) > base:
                    yield solve(held)
                    held, size = [], 0
                held.append((doc_id, words))
                size += len(words) + 1
            yield solve(held) if held else _batch([])

    return work


def tiles(n: int, base: int = BASE) -> Iterator[tuple[int, int, int, int]]:
    """(start, stop, low, high) of all tiles of a document of n words: octaves low to high are solved there."""
    top = max(0, n.bit_length() - 2)  # the octave of n // 2
    low, high = 0, (base // TILE).bit_length() - 1
    while True:
        size, overlap = TILE << high, OVERLAP << high
        if size >= n or low == 0 and n <= base:
            yield 0, n, low, top
            return
        for start in range(0, n - overlap, size - overlap):
            yield start, min(n, start + size), low, min(high, top)
        low = high = high + 1
        if low > top:
            return


_TILE_SQL = "key binary, low int, high int, start long, ids binary"


def _explode(base: int):
    """(doc_id, text, key) of long documents to their tiles, a batch a tile."""
    schema = pa.schema([("key", pa.binary()), ("low", pa.int32()), ("high", pa.int32()), ("start", pa.int64()), ("ids", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                doc_id, text, key = (batch.column(c)[i].as_py() for c in range(3))
                number: dict = {}
                ids = np.array([number.setdefault(w, len(number)) for w in rewritten(doc_id, text.encode().split())], np.int32)
                for start, stop, low, high in tiles(len(ids), base):
                    yield pa.RecordBatch.from_pylist([{"key": key, "low": low, "high": high, "start": start, "ids": ids[start:stop].tobytes()}], schema=schema)

    return work


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.binary()), ("period", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])
    for batch in batches:
        for i in range(batch.num_rows):
            key, low, high, start, ids = (batch.column(c)[i].as_py() for c in range(5))
            tile = np.frombuffer(ids, np.int32).astype(np.int64)
            found = _exact(tile, fragments(tile, low, high))
            columns = [pa.array([key] * len(found), pa.binary()), pa.array(found[:, 0]), pa.array(found[:, 1] + start), pa.array(found[:, 2] + start)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            doc_id, text, runs = (batch.column(c)[i].as_py() for c in range(3))
            found = np.array([(r["start"], r["period"], r["length"]) for r in runs or ()], np.int64).reshape(-1, 3)
            yield _batch([_summary(doc_id, rewritten(doc_id, text.encode().split()), found)])


def stitch(pieces: DataFrame) -> DataFrame:
    """(key, period, start, length) of whole runs from fragments (key, period, start, stop) that overlap in pairs.

    A run of period q from start to stop has stop - q - start pairs of equal words; fragments whose pairs meet are one.
    Equal fragments, of rows that occur many times, are made one before they are sorted.
    """
    order = Window.partitionBy("key", "period").orderBy("start", "stop")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = (before.isNull() | (F.col("start") > before - F.col("period"))).cast("int")
    islands = pieces.distinct().withColumn("opens", opens).withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = islands.groupBy("key", "period", "island").agg(F.min("start").alias("start"), (F.max("stop") - F.min("start")).alias("length"))
    return runs.select("key", "period", "start", "length")


def periodic_runs(docs: DataFrame, base: int = BASE) -> DataFrame:
    """One row a document (doc_id, text): the number of its periodic runs, its longest, and digests of all runs and of
    the words that stay when each run is collapsed to its first period.

    Null and empty texts have no words and no runs; equal rows get a row each; an empty table gives an empty result;
    further columns are ignored. Texts below 2 ``base`` (a power of two from 64) bytes fit one tile. Longer ones, of any length, are exploded into
    tiles that are dealt to all tasks; a task holds one tile, about 100 bytes a word (the highest octaves'
    tile is the document).
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    long = F.coalesce(F.octet_length("text") >= 2 * base, F.lit(False))
    done = rows.filter(~long).mapInArrow(_whole(base), _RESULT_SQL)
    keyed = rows.filter(long).withColumn("key", row_digest(rows))
    cut = keyed.select("doc_id", "text", "key").mapInArrow(_explode(base), _TILE_SQL)
    solved = cut.repartition(F.col("key"), F.col("low"), F.col("start")).mapInArrow(_solve, "key binary, period long, start long, stop long")
    runs = stitch(solved).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    runs = materialize(runs, "runs")
    met = keyed.join(broadcast_if_small(runs, 1_000_000), "key", "left").select("doc_id", "text", "runs")
    return done.unionByName(met.mapInArrow(_finish, _RESULT_SQL))


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, every tenth of which repeats a passage of itself (``rewritten``); null texts have
    none."""
    return periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
