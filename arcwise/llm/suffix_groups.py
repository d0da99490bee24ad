"""Suffix sorting by Lyndon-prefix groups, of one string or of many strings at once.

Suffixes are grouped by what is known of their prefix, at first by one symbol. Groups are taken in descending
order. For each suffix of a group, the previous smaller pointer leads to the nearest earlier suffix of a lesser
group; of these, the ones that equally many suffixes of the group point to leave their group for a new one
right above it. When all groups are done each holds the suffixes of one Lyndon prefix. The order is then emitted
from the least suffix up: the suffix before an emitted one, and the chain of previous smaller pointers from there,
take the next free places of their groups. No names are given again and nothing recurs; both phases
touch each suffix a bounded number of times.

``sort_many`` keeps one row a string and takes the same step in all rows at once, so that numpy does the
work; ``sort_one`` is for a long string.
"""

from __future__ import annotations

import numpy as np


def sort_many(text: np.ndarray) -> np.ndarray:
    """Suffix arrays of the rows of text (bytes). Each row must end with a 0; longer runs of 0 at the end are padding."""
    rows, n = text.shape
    base = (np.arange(rows, dtype=np.int64) * n)[:, None]
    symbol = text.astype(np.int64)
    # Places of the groups of one symbol: how many symbols of the row are less.
    counts = np.bincount((symbol + np.arange(rows)[:, None] * 257 + 1).ravel(), minlength=rows * 257).reshape(rows, 257)
    below = np.cumsum(counts, axis=1)
    group = np.take_along_axis(below, symbol, 1).astype(np.int32).ravel()
    size = np.zeros(rows * n, np.int32)
    first_of_end = np.zeros(rows * n, np.int32)
    r, s = np.nonzero(counts[:, 1:])
    start, many = below[r, s], counts[r, s + 1]
    size[r * n + start] = many
    first_of_end[r * n + start + many - 1] = start
    prev = np.full(rows * n, -1, np.int64)  # flat places; -1: none

    # Phase 1: groups in descending order, one of each row at a time.
    alive = np.arange(rows)
    edge = np.full(rows, n, np.int64)
    flat = np.arange(rows * n).reshape(rows, n)
    left, grid = flat, group.reshape(rows, n)
    while len(alive):
        now = first_of_end[alive * n + edge - 1]
        edge = now.astype(np.int64)
        live = now > 0
        if not live.all():
            # Rows whose least group is reached are done.
            alive, edge, now = alive[live], edge[live], now[live]
            if not len(alive):
                break
            left = flat[alive]
        member = left[group[left] == now[:, None]]
        mine = group[member]
        row = member // n
        low = row * n
        at = member - 1
        # Through higher groups by their pointers; a pointer to the same group is followed when it is known.
        prev[member] = at
        open_ = np.flatnonzero((at >= low) & (group[np.maximum(at, 0)] >= mine))
        while len(open_):
            at[open_] = prev[at[open_]]
            prev[member[open_]] = at[open_]
            a = at[open_]
            open_ = open_[(a >= low[open_]) & (group[np.maximum(a, 0)] >= mine[open_])]
        none = at < low
        prev[member[none]] = -1
        target = np.sort(at[~none])
        if not len(target):
            continue
        new = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])
        hits = np.diff(np.r_[new, len(target)])
        target = target[new]
        # Within each old group the suffixes that are hit most often go highest.
        row = target // n
        old = group[target].astype(np.int64) + row * n
        order = np.lexsort((-hits, old))
        target, hits, old, row = target[order], hits[order], old[order], row[order]
        fresh = np.r_[True, old[1:] != old[:-1]]
        block = np.flatnonzero(fresh | np.r_[True, hits[1:] != hits[:-1]])
        many = np.diff(np.r_[block, len(target)])
        heads = np.flatnonzero(fresh)
        gone = np.diff(np.r_[heads, len(target)])
        upto = np.cumsum(many) - np.repeat(heads, np.diff(np.r_[np.searchsorted(block, heads), len(block)]))
        end = old[block] + size[old[block]]
        places = end - upto
        group[target] = np.repeat(places - row[block] * n, many)
        g = old[heads]
        rest = size[g] - gone
        size[g] = rest
        keep = rest > 0
        first_of_end[g[keep] + rest[keep] - 1] = (g - row[heads] * n)[keep]
        size[places] = many
        first_of_end[places + many - 1] = places - row[block] * n

    # Phase 2: the order, from the least suffix up.
    free = np.zeros(rows * n, np.int32)
    done = np.zeros(rows * n + 1, bool)
    done[-1] = True
    out = np.zeros((rows, n), np.int64)
    lows = base.ravel()
    out[:, 0] = lows + n - 1
    done[out[:, 0]] = True
    free[lows + group[out[:, 0]]] += 1
    order = out.ravel()
    for step in range(n):
        at = out[:, step] - 1
        at = at[at >= lows]
        at = at[~done[at]]
        while len(at):
            place = at // n * n + group[at]
            order[place + free[place]] = at
            free[place] += 1
            done[at] = True
            at = prev[at]
            at = at[~done[at]]
    return out - base


def sort_one(text: bytes | list[int]) -> list[int]:
    """Suffix array of one sequence whose last symbol is 0 or less than all others."""
    n = len(text)
    if not n:
        return []
    many: dict[int, int] = {}
    for c in text:
        many[c] = many.get(c, 0) + 1
    place, at = {}, 0
    for c in sorted(many):
        place[c] = at
        at += many[c]
    group = [place[c] for c in text]
    # Groups of several suffixes are sets; the far more that have one are just that.
    member: dict[int, set] = {}
    for i, g in enumerate(group):
        member.setdefault(g, set()).add(i)
    below = [0] * (n + 1)  # the group that ends before a place
    alone = [-1] * (n + 1)
    for g, m in list(member.items()):
        below[g + len(m)] = g
        if len(m) == 1:
            (alone[g],) = member.pop(g)
    prev = [-1] * n
    g = below[n]
    while g > 0:
        if (i := alone[g]) >= 0:
            # It hits one suffix at most, which leaves its group unless it is alone there.
            j = i - 1
            while group[j] >= g:  # place -1 is the last one, of the least group
                j = prev[j]
            prev[i] = j
            if j >= 0 and (own := member.get(old := group[j])):
                own.remove(j)
                new = old + len(own)
                group[j] = new
                alone[new] = j
                below[new + 1], below[new] = new, old
                if len(own) == 1:
                    alone[old] = own.pop()
                    del member[old]
            g = below[g]
            continue
        hits: dict[int, int] = {}
        for i in sorted(member.pop(g)):
            j = i - 1
            while group[j] >= g:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                hits[j] = hits.get(j, 0) + 1
        moved: dict[int, list] = {}
        for j in hits:
            moved.setdefault(group[j], []).append(j)
        for old, items in moved.items():
            own = member.get(old)
            if not own:
                continue  # a suffix alone stays where it is
            items.sort(key=hits.__getitem__)
            while items:
                k = hits[items[-1]]
                end = old + len(own)
                fresh = []
                while items and hits[items[-1]] == k:
                    fresh.append(items.pop())
                new = end - len(fresh)
                if new == old:
                    break  # all that are left stay together
                own.difference_update(fresh)
                below[end], below[new] = new, old
                for j in fresh:
                    group[j] = new
                if len(fresh) == 1:
                    alone[new] = fresh[0]
                else:
                    member[new] = set(fresh)
            if len(own) == 1:
                alone[old] = own.pop()
                del member[old]
        g = below[g]
    del member, alone, below
    out, free, done = [0] * n, [0] * n, bytearray(n)
    out[0] = n - 1
    done[n - 1] = 1
    free[group[n - 1]] = 1
    for step in range(n):
        j = out[step] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[g + free[g]] = j
            free[g] += 1
            done[j] = 1
            j = prev[j]
    return out
