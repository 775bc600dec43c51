"""Blockwise suffix sorting with a difference cover, by array operations over one block of buckets at a time."""

from __future__ import annotations

from functools import cmp_to_key, lru_cache

import numpy as np

#: Period of the difference cover; suffixes are compared by so many bytes before cover ranks decide.
PERIOD = 32


@lru_cache(4)
def difference_cover(period: int = PERIOD) -> tuple[int, ...]:
    """Residues such that every residue is the difference of two of them; chosen greedily."""
    chosen, missing = [0], set(range(1, period))
    while missing:
        best = max(range(period), key=lambda c: len({x for d in chosen for x in ((c - d) % period, (d - c) % period)} & missing))
        chosen.append(best)
        missing -= {x for d in chosen for x in ((best - d) % period, (d - best) % period)}
    return tuple(sorted(chosen))


@lru_cache(4)
def shifts(period: int = PERIOD) -> np.ndarray:
    """For residues i and j, the least shift that takes both into the cover."""
    cover = set(difference_cover(period))
    table = np.zeros((period, period), dtype=np.int64)
    for i in range(period):
        for j in range(period):
            table[i, j] = next(d for d in range(period) if (i + d) % period in cover and (j + d) % period in cover)
    return table


def _words(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as one number that sorts like them."""
    out = np.zeros(len(at), dtype=np.uint64)
    for n in range(8):
        out = (out << np.uint64(8)) | data[at + n]
    return out


def _dense(columns: list[np.ndarray]) -> np.ndarray:
    """Ranks of rows that are compared column by column; equal rows have equal ranks."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), dtype=bool)
    for column in columns:
        new[1:] |= column[order][1:] != column[order][:-1]
    ranks = np.empty(len(order), dtype=np.int64)
    ranks[order] = np.cumsum(new)
    return ranks


class CoverRanks:
    """Ranks of the suffixes at cover places of ``data``, by their first ``depth`` bytes (a power of two of periods)."""

    def __init__(self, data: np.ndarray, depth: int):
        length = -(-len(data) // PERIOD) * PERIOD
        self.data = np.concatenate([data, np.zeros(length - len(data) + depth + 2 * PERIOD, dtype=np.uint8)])
        cover = np.array(difference_cover(), dtype=np.int64)
        self.slot = np.full(PERIOD, -1, dtype=np.int64)
        self.slot[cover] = np.arange(len(cover))
        blocks = length // PERIOD
        places = (np.arange(blocks)[:, None] * PERIOD + cover).ravel()
        ranks = _dense([_words(self.data, places + n) for n in range(0, PERIOD, 8)]).reshape(blocks, len(cover))
        reach = PERIOD
        while reach < depth:  # the suffix one reach further is a cover place of the same residue
            step = reach // PERIOD
            further = np.full_like(ranks, -1)
            further[: max(0, blocks - step)] = ranks[step:]
            ranks = _dense([ranks.ravel(), further.ravel()]).reshape(ranks.shape)
            reach *= 2
        self.ranks = ranks

    def of(self, places: np.ndarray) -> np.ndarray:
        block, residue = places // PERIOD, places % PERIOD
        inside = block < len(self.ranks)
        return np.where(inside, self.ranks[np.where(inside, block, 0), self.slot[residue]], -1)


def sort_suffixes(data: np.ndarray, starts: np.ndarray, buckets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by bucket and then by their first ``depth`` bytes, and how many bytes each shares with the
    one before it (0 at the first of a bucket).

    The first ``PERIOD`` bytes are sorted directly. Suffixes that tie there are told apart by the ranks of the cover
    places that both reach by the same shift.
    """
    if not len(starts):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    cover = CoverRanks(data, depth)
    columns = [buckets, *[_words(cover.data, starts + n) for n in range(0, PERIOD, 8)]]
    order = np.lexsort(columns[::-1])
    tie = np.ones(len(order), dtype=bool)
    tie[0] = False
    for column in columns:
        tie[1:] &= column[order][1:] == column[order][:-1]
    table = shifts()
    edges = np.flatnonzero(~tie)
    sizes = np.diff(np.append(edges, len(order)))

    pairs = edges[sizes == 2]
    if len(pairs):
        left, right = order[pairs], order[pairs + 1]
        shift = table[starts[left] % PERIOD, starts[right] % PERIOD]
        swap = cover.of(starts[left] + shift) > cover.of(starts[right] + shift)
        order[pairs[swap]], order[pairs[swap] + 1] = right[swap], left[swap]

    for first, size in zip(edges[sizes > 2], sizes[sizes > 2], strict=True):
        group = order[first : first + size]
        # suffixes of one residue are sorted by rank alone; the few residues are then merged pair by pair
        residues = starts[group] % PERIOD
        if (residues == residues[0]).all():
            order[first : first + size] = group[np.argsort(cover.of(starts[group] + table[residues[0], residues[0]]), kind="stable")]
            continue
        ranked = {}

        def rank(i: int, shift: int, ranked=ranked) -> int:
            key = (i, shift)
            if key not in ranked:
                ranked[key] = int(cover.of(starts[i : i + 1] + shift)[0])
            return ranked[key]

        def compare(i: int, j: int) -> int:
            shift = int(table[starts[i] % PERIOD, starts[j] % PERIOD])
            return rank(i, shift) - rank(j, shift)

        order[first : first + size] = sorted(group.tolist(), key=cmp_to_key(compare))

    shared = np.zeros(len(order), dtype=np.int64)
    if len(order) > 1:
        run = np.arange(depth)
        for at in range(1, len(order), 8192):  # a bounded matrix of bytes at a time
            one, two = starts[order[at - 1 : at + 8191]][:-1], starts[order[at : at + 8191]]
            one = one[: len(two)]
            differ = cover.data[one[:, None] + run] != cover.data[two[:, None] + run]
            shared[at : at + len(two)] = np.where(differ.any(axis=1), differ.argmax(axis=1), depth)
        same = buckets[order][1:] == buckets[order][:-1]
        shared[1:][~same] = 0
    return order, shared
