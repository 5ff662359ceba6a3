"""Token counts of a sentencepiece BPE vocabulary by rank-synchronous array merging.

Pre-tokens (a run of space marks and the characters up to the next) of a batch are held as one ragged array of symbol
ids. Each round looks up the rank of every adjacent pair, takes the least rank of each sequence, and merges those
pairs in all sequences at once; what survives is counted. Pre-tokens that a worker has met before are not merged again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import small_batches

_MARK = "▁"
_NONE = np.iinfo(np.int32).max
#: Pre-tokens whose counts a worker keeps; beyond it starts anew. Longer ones are not kept, so some 50 MB are the most.
_KEPT, _KEPT_CHARS = 400_000, 32


class PieceMerges:
    """The merge table of one vocabulary file."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i)
        pieces = {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not special(i)}
        order = {s: r for r, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        ids = {p: i for i, p in enumerate(pieces)}
        for p in pieces:
            for c in p:
                ids.setdefault(c, len(ids))
        self.n = len(ids) + 1  # the last id is that of characters in no piece
        self.symbol = np.full(0x110000, self.n - 1, np.int32)
        self.cost = np.repeat(np.array([1, 2, 3, 4], np.int8), [0x80, 0x780, 0xF800, 0x100000])  # bytes, where no piece
        for c, i in ids.items():
            if len(c) == 1:
                self.symbol[ord(c)] = i
                if c in pieces:
                    self.cost[ord(c)] = 1
        rows = [(ids[p[:k]] * self.n + ids[p[k:]], order[s], ids[p]) for p, s in pieces.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        table = np.array(sorted(rows), np.int64).reshape(-1, 3)
        self.pair, self.rank, self.merged = table[:, 0], table[:, 1].astype(np.int32), table[:, 2].astype(np.int32)
        own = np.zeros(self.n, np.int32)
        own[self.merged] = self.rank
        # a piece that is part of a better-ranked one: such a merge can come between two merges of equal rank
        self.early = np.zeros(self.n, bool)
        for side in (self.pair // self.n, self.pair % self.n):
            self.early[side[own[side] > self.rank]] = True
        inside = {c for p in pieces if len(p) > 1 for c in p}
        self.alone = "".join(c for c in "\n\t\r" if c not in inside and c not in pieces)
        crossing = any(re.search(f"[^{_MARK}]{_MARK}", p) for p in pieces)
        chars = re.escape(self.alone)
        self.pre = re.compile(f"[^{chars}]+" if crossing else f"{_MARK}*[^{_MARK}{chars}]+|{_MARK}+")

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) * self.n + right
        at = np.minimum(np.searchsorted(self.pair, key), max(len(self.pair) - 1, 0))
        known = self.pair[at] == key if len(self.pair) else np.zeros(len(key), bool)
        return np.where(known, self.rank[at] if len(self.pair) else _NONE, _NONE), at

    def count(self, pre_tokens: list[str]) -> np.ndarray:
        """Surviving symbols of each pre-token, bytes where a character has no piece."""
        sizes = np.fromiter(map(len, pre_tokens), np.int64, len(pre_tokens))
        chars = np.frombuffer("".join(pre_tokens).encode("utf-32-le", "surrogatepass"), np.uint32)
        sym, cost, seq = self.symbol[chars], self.cost[chars].astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)
        total = np.zeros(len(sizes), np.int64)
        while len(sym) > 1:
            rank, at = self._ranks(sym[:-1], sym[1:])
            rank = np.where(seq[:-1] == seq[1:], rank, _NONE)
            first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            least = np.minimum.reduceat(np.r_[rank, _NONE], first)
            span = np.diff(np.r_[first, len(sym)])
            low = np.repeat(least, span)
            hit = np.flatnonzero((rank == low[:-1]) & (rank < _NONE))
            # of overlapping pairs every other one, from the left
            start = np.r_[True, hit[1:] != hit[:-1] + 1] if len(hit) else np.zeros(0, bool)
            begin = np.maximum.accumulate(np.where(start, np.arange(len(hit)), 0)) if len(hit) else hit
            take = (np.arange(len(hit)) - begin) % 2 == 0
            lone = np.r_[True, seq[hit[1:]] != seq[hit[:-1]]] if len(hit) else take
            hit = hit[take & (~self.early[self.merged[at[hit]]] | lone)] if len(hit) else hit
            sym[hit] = self.merged[at[hit]]
            cost[hit] = 1
            stays = np.ones(len(sym), bool)
            stays[hit + 1] = False
            done = low == _NONE
            np.add.at(total, seq[done], cost[done])
            stays &= ~done
            sym, cost, seq = sym[stays], cost[stays], seq[stays]
        np.add.at(total, seq, cost)
        return total


@lru_cache(2)
def _merges(model_file: str) -> PieceMerges:
    return PieceMerges(model_file)


@lru_cache(2)
def _known(model_file: str) -> dict[str, int]:
    return {}


def count_tokens(texts: list[str | None], model_file: str) -> list[int]:
    """Tokens of each text; null and empty texts have none."""
    merges, known = _merges(model_file), _known(model_file)
    found = [merges.pre.findall(_MARK + t.replace(" ", _MARK)) if t else [] for t in texts]
    new = list(set().union(*found).difference(known))
    if len(known) + len(new) > _KEPT:
        known.clear()
        new = list(set().union(*found))
    for at in range(0, len(new), 1 << 14):
        part = new[at : at + (1 << 14)]
        known.update(zip(part, merges.count(part).tolist(), strict=True))
    alone = merges.alone
    counts = [sum(map(known.__getitem__, f)) + (sum(map(t.count, alone)) if t else 0) for f, t in zip(found, texts, strict=True)]
    for p in new:
        if len(p) > _KEPT_CHARS:
            del known[p]
    return counts


def with_token_counts(docs: DataFrame, model_file: str, name: str = "n_tokens") -> DataFrame:
    """Adds the number of tokens of ``text``; an existing column of that name is replaced.

    ``model_file`` must be readable on every executor (an installed vocabulary). Null texts count as empty, equal texts alike,
    whole texts at any length; an empty table gives an empty result. Other columns may have any name.
    """
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(count_tokens(batch.to_pylist(), model_file), pa.int64())

    work.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(name, F.arrow_udf(work, T.LongType())("text"))


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    """The tokens of every document; null and empty texts have 0 bytes and 0 tokens."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counted = with_token_counts(docs, str(public_tokenizers.path("piece_bpe_32k.model")))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    return counted.select("doc_id", size.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))
