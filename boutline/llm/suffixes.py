"""Suffix array by linear grouping.

Suffixes start in groups by first symbol. Groups are processed from the largest down. Each suffix of a group gets a pointer to the nearest
earlier suffix in a smaller group (its previous smaller suffix); the suffixes pointed to are moved behind the rest of their own group,
those pointed to more often further behind. When all groups are done, suffixes share a group exactly if they share their longest Lyndon
prefix, and groups are in lexicographic order. The order inside a group is that of what follows the prefix, so one ascending pass over the
suffix array fills it: a placed suffix places the suffix before it and along that one's pointers, each at the front of its group.
No renaming and no recursion takes place.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> list[int]:
    """Starts of all suffixes in ascending order; the last symbol must be smaller than all others and occur once."""
    n = len(symbols)
    first = np.argsort(symbols, kind="stable")
    ordered = symbols[first]
    heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if n else np.empty(0, np.int64)
    group_np = np.empty(n, np.int64)
    group_np[first] = np.repeat(heads, np.diff(np.append(heads, n)))
    order: list[int] = first.tolist()
    group: list[int] = group_np.tolist()  # start of the suffix's group in ``order``
    place_np = np.empty(n, np.int64)
    place_np[first] = np.arange(n)
    place: list[int] = place_np.tolist()
    size = [0] * n
    for h, m in zip(heads.tolist(), np.diff(np.append(heads, n)).tolist()):
        size[h] = m
    before = [-2] * n  # previous smaller suffix; -2: not known yet, -1: none
    stop = n
    while stop > 0:
        start = group[order[stop - 1]]
        if stop - start == 1:
            p = order[start]
            q = p - 1
            while q >= 0 and group[q] > start:
                q = before[q]
            before[p] = q
            if q >= 0:
                h = group[q]
                m = size[h]
                if m > 1:
                    last = h + m - 1
                    at, other = place[q], order[last]
                    order[at], order[last] = other, q
                    place[other], place[q] = at, last
                    size[h] = m - 1
                    size[last] = 1
                    group[q] = last
            stop = start
            continue
        members = order[start:stop]
        pointed: dict[int, int] = {}
        for p in members:
            q = before[p]
            if q == -2:
                path = [p]
                q = p - 1
                while q >= 0 and group[q] >= start:
                    if before[q] == -2:
                        path.append(q)
                        q -= 1
                    else:
                        q = before[q]
                for x in path:
                    before[x] = q
            if q >= 0:
                pointed[q] = pointed.get(q, 0) + 1
        if pointed:
            by_count: dict[int, dict[int, list[int]]] = {}
            for q, k in pointed.items():
                by_count.setdefault(k, {}).setdefault(group[q], []).append(q)
            for k in sorted(by_count, reverse=True):
                for h, moved in by_count[k].items():
                    m, c = size[h], len(moved)
                    if c == m:
                        continue
                    tail = h + m
                    for q in moved:
                        tail -= 1
                        at, other = place[q], order[tail]
                        order[at], order[tail] = other, q
                        place[other], place[q] = at, tail
                    size[h] = m - c
                    size[tail] = c
                    for q in moved:
                        group[q] = tail
        stop = start
    out = [-1] * n
    if not n:
        return out
    out[0] = n - 1
    front = list(range(n))  # next free place of the group that starts here
    front[group[n - 1]] += 1
    placed = bytearray(n)
    placed[n - 1] = 1
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            out[front[g]] = s
            front[g] += 1
            placed[s] = 1
            s = before[s]
    return out
