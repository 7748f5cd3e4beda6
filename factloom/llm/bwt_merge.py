"""Burrows-Wheeler transforms of shards, merged by interleave refinement.

A shard's transform is built on its own. Two transforms are merged without sorting suffixes: an interleave says
for each rank which suffix of which of the two stands there; refining it once orders it by one more byte, by the ranks that the
suffixes one byte shorter have by then. Suffixes that separate in a round share as many bytes as it has ordered before, which gives the
longest-common-prefix array on the way, and with it the repeated intervals.

Settled intervals are passed over: one with suffixes of a single transform is in its final order, and its common prefixes are
those of that transform, once known. In an interval of both, each transform's suffixes are in order, so a round merges two sorted runs.

Each text ends in a separator that differs from all others, so matches never cross texts. The arrays of a merge are
in memory: this is the method in full, for inputs of some megabytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Transform:
    """symbol before each suffix by rank (separators are 0), text and place of each suffix, and the prefix shared with the rank before."""

    symbol: np.ndarray
    text: np.ndarray
    place: np.ndarray
    common: np.ndarray


def build(texts: list[bytes], first: int = 0) -> Transform:
    """The transform of one shard, by prefix doubling over its own suffixes. Texts are numbered from ``first``."""
    data = np.concatenate([np.append(np.frombuffer(t, np.uint8).astype(np.int64) + 1, 0) for t in texts]) if texts else np.zeros(0, np.int64)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    text = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    rank = np.where(data == 0, text - len(texts), data)  # separators by text, below all bytes
    width = 1
    while len(rank):
        nxt = np.full(len(rank), -(2**62))
        nxt[: max(0, len(rank) - width)] = rank[width:]
        nxt[place + width >= np.repeat(sizes, sizes)] = -(2**62)
        order = np.lexsort((nxt, rank))
        new = np.empty(len(rank), np.int64)
        new[order] = np.cumsum((np.diff(rank[order], prepend=rank[order[0]]) != 0) | (np.diff(nxt[order], prepend=nxt[order[0]]) != 0))
        rank, width = new, width * 2
        if rank.max() == len(rank) - 1:
            break
    order = np.argsort(rank, kind="stable")
    before = np.where(place > 0, data[np.maximum(np.arange(len(data)) - 1, 0)], 0)
    return Transform(before[order], text[order] + first, place[order], np.zeros(0, np.int64))


def _columns(t: Transform) -> tuple[np.ndarray, np.ndarray]:
    """The first symbol of each suffix by rank, and the rank of the suffix one byte shorter (of separators: no matter)."""
    symbol = t.symbol.astype(np.int16)  # small numbers are sorted by counting
    shorter = np.argsort(symbol, kind="stable")
    return symbol[shorter], shorter


def merge(a: Transform, b: Transform, depth: int) -> Transform:
    """The transform of both, with common prefixes up to ``depth`` (depth + 1 for more); theirs, if any, must go as far.

    Suffixes that share more than ``depth`` bytes stand in the order of the shards.
    """
    n_a, n = len(a.symbol), len(a.symbol) + len(b.symbol)
    known = np.array([len(a.common) == n_a, len(b.common) == n - n_a])
    (first_a, shorter_a), (first_b, shorter_b) = _columns(a), _columns(b)
    first, shorter = np.concatenate([first_a, first_b]), np.concatenate([shorter_a, shorter_b + n_a])
    at = np.argsort(first, kind="stable")  # which suffix stands at each rank, ordered by one byte
    starts = (np.diff(first[at], prepend=-1) != 0) | (first[at] == 0)
    common = np.where(starts, 0, -1)
    rank = np.empty(n, np.int64)  # where the interval of each suffix begins
    rank[at] = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    open_ = np.arange(n)
    for h in range(1, depth + 1):
        suffix = at[open_]
        begin = np.flatnonzero(np.diff(rank[suffix], prepend=-1))
        sizes = np.diff(begin, append=len(open_))
        of_b = np.add.reduceat(suffix >= n_a, begin, dtype=np.int64) if len(begin) else begin
        settled = (sizes == 1) | (of_b == 0) & known[0] | (of_b == sizes) & known[1]
        open_ = open_[np.repeat(~settled, sizes)]
        if not len(open_):
            break
        suffix = at[open_]
        key = rank[suffix] * n + rank[shorter[suffix]]
        order = np.argsort(key, kind="stable")
        suffix, key = suffix[order], key[order]
        at[open_] = suffix
        starts = np.diff(key, prepend=-1) != 0
        new = open_[starts]
        common[new[common[new] < 0]] = h
        rank[suffix] = open_[np.maximum.accumulate(np.where(starts, np.arange(len(open_)), 0))]
    rest = np.flatnonzero(common < 0)
    suffix, before = at[rest], at[rest - 1]
    own = np.concatenate([t.common if k else np.full(len(t.symbol), depth + 1) for t, k in zip((a, b), known.tolist(), strict=True)])
    common[rest] = np.where((suffix >= n_a) == (before >= n_a), own[suffix], depth + 1)
    pick = lambda x, y: np.concatenate([x, y])[at]
    return Transform(pick(a.symbol, b.symbol), pick(a.text, b.text), pick(a.place, b.place), common)


def repeated(shards: list[list[bytes]], length: int) -> dict[int, list[int]]:
    """For each text, numbered through the shards, the places of windows of ``length`` bytes that occur elsewhere too."""
    level, first = [], 0
    for texts in shards:
        level.append(build(texts, first))
        first += len(texts)
    if not level:
        return {}
    while len(level) > 1 or not len(level[0].common):  # neighbours with each other, the last of an odd number with nothing
        pairs = [level[i : i + 2] for i in range(0, len(level), 2)]
        level = [merge(p[0], p[1] if len(p) > 1 else build([], first), length) for p in pairs]
        if not len(level[0].symbol) and len(level) == 1:
            break
    merged = level[0]
    with_before = merged.common >= length
    hit = with_before | np.append(with_before[1:], False)
    out: dict[int, list[int]] = {i: [] for i in range(first)}
    for t, p in zip(merged.text[hit].tolist(), merged.place[hit].tolist(), strict=True):
        out[t].append(p)
    return {t: sorted(p) for t, p in out.items()}
