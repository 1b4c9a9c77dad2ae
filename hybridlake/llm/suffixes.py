"""Suffix arrays over many short sequences at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator


def suffix_array(codes, ends):
    """Suffixes of sequences laid end to end, sorted by (sequence, content), with their LCPs.

    ``codes`` are the symbols, ``ends[i]`` the end of the sequence that holds
    place ``i``. Returns ``(places, lcp)``; ``lcp[r]`` is the number of symbols
    that suffixes ``r - 1`` and ``r`` share, 0 across sequences. Prefix doubling
    sorts only what is still tied; the ranks of each round then give the LCPs,
    longest power of two first.
    """
    import numpy as np

    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    places = np.lexsort((codes, ends))
    new = np.ones(n, bool)
    new[1:] = (codes[places[1:]] != codes[places[:-1]]) | (ends[places[1:]] != ends[places[:-1]])
    rank = np.empty(n, np.int32)
    rank[places] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rounds, step = [rank], 1
    while True:
        tied = np.flatnonzero(~new | ~np.append(new[1:], True))
        if not len(tied):
            break
        at = places[tied]
        after = at + step
        inside = after < ends[at]
        second = np.where(inside, rank[np.where(inside, after, 0)], -1)
        # tied places stay within their group: its rank leads the order
        order = np.argsort(rank[at].astype(np.int64) * (n + 1) + second + 1, kind="stable")
        at, second = at[order], second[order]
        first = rank[at]
        places[tied] = at
        split = np.ones(len(at), bool)
        split[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        new[tied] = split
        rank = rank.copy()
        rank[at] = np.maximum.accumulate(np.where(split, tied, 0))
        rounds.append(rank)
        step *= 2
    lcp = np.zeros(n, np.int64)
    a, b = places[:-1].copy(), places[1:].copy()
    live = np.flatnonzero(rounds[0][a] == rounds[0][b])  # the others share nothing
    a, b, shared = a[live], b[live], np.zeros(len(live), np.int64)
    for k in range(len(rounds) - 1, -1, -1):
        inside = (a + shared < ends[a]) & (b + shared < ends[b])
        x, y = np.where(inside, a + shared, 0), np.where(inside, b + shared, 0)
        shared += np.where(inside & (rounds[k][x] == rounds[k][y]), 1 << k, 0)
    lcp[live + 1] = shared
    return places, lcp


def intervals(lcp, least: int) -> Iterator[tuple[int, int, int, list[tuple[int, int]]]]:
    """(depth, first, end, own) of every LCP interval of depth ``least`` or more, inner ones first, by a stack scan.

    ``own`` are the ranges of ranks that no deeper interval of the interval
    holds: each rank belongs to one interval's own, its deepest. Ranks that
    share less with their neighbours aren't visited.
    """
    import numpy as np

    live = np.flatnonzero(lcp >= least)
    stack: list[list] = []  # [depth, first, rank up to which own is settled, own]

    def close(end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
        depth, first, at, own = stack.pop()
        if at < end:
            own.append((at, end))
        return depth, first, end, own

    def inside(first: int, end: int) -> None:
        """The interval on top holds the inner one [first, end)."""
        if stack[-1][2] < first:
            stack[-1][3].append((stack[-1][2], first))
        stack[-1][2] = end

    before = -1
    for r, depth in zip(live.tolist(), lcp[live].tolist()):
        first, inner = r - 1, None
        if r != before + 1:
            while stack:
                found = close(before + 1)
                if stack:
                    inside(*found[1:3])
                yield found
        while stack and stack[-1][0] > depth:
            found = close(r)
            first, inner = found[1], found[1:3]
            if stack and stack[-1][0] >= depth:
                inside(*inner)
                inner = None
            yield found
        if not stack or stack[-1][0] < depth:
            stack.append([depth, first, first, []])
            if inner:
                inside(*inner)
        before = r
    while stack:
        found = close(before + 1)
        if stack:
            inside(*found[1:3])
        yield found


def deepest(lcp, least: int):
    """For each rank, the depth of its deepest LCP interval of depth ``least`` or more, 0 in none."""
    import numpy as np

    found = [(a, b, depth) for depth, _, _, own in intervals(lcp, least) for a, b in own]
    depths = np.zeros(len(lcp), np.int64)
    if found:
        a, b, depth = np.array(found, np.int64).T
        length = b - a
        at = np.repeat(a - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
        depths[at] = np.repeat(depth, length)
    return depths


def covered(places, lengths, n: int):
    """Which of ``n`` places lie in a span ``[places[i], places[i] + lengths[i])``."""
    import numpy as np

    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, places, 1)
    np.add.at(edge, places + lengths, -1)
    return np.cumsum(edge[:-1]) > 0
