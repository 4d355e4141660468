"""Suffix arrays by linear grouping.

Phase one sorts suffixes into groups by their Lyndon prefixes: groups are taken in descending order; every suffix of the
group gets its previous-smaller pointer, the nearest suffix to the left whose group is lower; suffixes that are pointed
at move into new groups right above their own, in the order of how often they are pointed at, as that many copies of
the group's prefix now extend theirs. Phase two emits the order within groups from left to right: each suffix in final
order puts the suffixes that end their Lyndon prefix where it begins, found along the pointers, next in their groups.
No renaming and no recursion.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The order of the suffixes of an array of non-negative integers; a suffix that is a prefix of another comes first."""
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    order = np.argsort(symbols, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(symbols[order]) != 0])
    sizes = np.diff(np.r_[first, n])
    group = np.empty(n, np.int64)
    group[order] = np.repeat(first, sizes)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    end = np.zeros(n, np.int64)  # last place of the group that starts here
    end[first] = first + sizes - 1
    sa, place, group, end = order.tolist(), place.tolist(), group.tolist(), end.tolist()
    smaller = [-1] * n
    hi = n - 1
    while hi >= 0:
        lo = group[sa[hi]]
        if lo == hi:  # one suffix
            s = sa[hi]
            p = s - 1
            while p >= 0 and group[p] >= lo:
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                g = group[p]
                e = end[g]
                if e > g:
                    q, at = sa[e], place[p]
                    sa[at], sa[e] = q, p
                    place[q], place[p] = at, e
                    end[g] = e - 1
                    group[p] = end[e] = e
        else:
            members = sa[lo : hi + 1]
            members.sort()
            times: dict[int, int] = {}
            for s in members:
                p = s - 1
                while p >= 0 and group[p] >= lo:
                    p = smaller[p]
                smaller[s] = p
                if p >= 0:
                    times[p] = times.get(p, 0) + 1
            if times:
                most = max(times.values())
                if most == 1:
                    levels = [list(times)]
                else:
                    by: dict[int, list[int]] = {}
                    for p, k in times.items():
                        by.setdefault(k, []).append(p)
                    levels = [by[k] for k in sorted(by, reverse=True)]
                for level in levels:
                    moved: dict[int, int] = {}
                    for p in level:
                        g = group[p]
                        e = end[g]
                        if g not in moved:
                            moved[g] = e
                        q, at = sa[e], place[p]
                        sa[at], sa[e] = q, p
                        place[q], place[p] = at, e
                        end[g] = e - 1
                    for g, e in moved.items():
                        new = end[g] + 1
                        if new > g:
                            for at in range(new, e + 1):
                                group[sa[at]] = new
                        end[new] = e
        hi = lo - 1
    filled = group[:]  # by first place: the next place of the group to fill, for a start at its suffixes
    nxt = list(range(n))
    out = [-1] * n
    done = bytearray(n)
    p = n - 1
    while p >= 0:
        g = filled[p]
        out[nxt[g]] = p
        nxt[g] += 1
        done[p] = 1
        p = smaller[p]
    for i in range(n):
        p = out[i] - 1
        while p >= 0 and not done[p]:
            g = filled[p]
            out[nxt[g]] = p
            nxt[g] += 1
            done[p] = 1
            p = smaller[p]
    return np.array(out, np.int64)
