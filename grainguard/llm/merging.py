"""Merging one piece of text by a table of ranked pairs, inside tasks."""

from __future__ import annotations

import heapq
from itertools import pairwise

SHORT = 64
NEVER = 1 << 62
ID = (1 << 32) - 1


def merge(ids: list[int], pairs: dict[int, int]) -> list[int]:
    """Merge the leftmost pair of the lowest rank until none is left; ``pairs`` maps left << 32 | right to rank << 32 | id."""
    ids, find = list(ids), pairs.get
    ranks = [find(a << 32 | b, NEVER) for a, b in pairwise(ids)]
    if len(ids) <= SHORT:
        while ranks and (best := min(ranks)) != NEVER:
            k = ranks.index(best)
            new = best & ID
            ids[k : k + 2] = [new]
            del ranks[k]
            if k:
                ranks[k - 1] = find(ids[k - 1] << 32 | new, NEVER)
            if k < len(ranks):
                ranks[k] = find(new << 32 | ids[k + 1], NEVER)
        return ids
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(rank, k, ids[k] << 32 | ids[k + 1]) for k, rank in enumerate(ranks) if rank != NEVER]
    heapq.heapify(heap)
    while heap:
        rank, k, key = heapq.heappop(heap)
        j = after[k]
        if j >= n or ids[k] < 0 or ids[k] << 32 | ids[j] != key:
            continue  # one of both has been merged meanwhile
        ids[k], ids[j] = rank & ID, -1
        j = after[k] = after[j]
        if j < n:
            before[j] = k
            if rank := find(key := ids[k] << 32 | ids[j]):
                heapq.heappush(heap, (rank, k, key))
        i = before[k]
        if i >= 0 and (rank := find(key := ids[i] << 32 | ids[k])):
            heapq.heappush(heap, (rank, i, key))
    return [i for i in ids if i >= 0]
