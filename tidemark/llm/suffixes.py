"""Suffix arrays by linear grouping."""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(symbols: Sequence[int]) -> list[int]:
    """Starts of the suffixes of a sequence of positive numbers, in order.

    First the suffixes are put in groups, in the end by their longest Lyndon prefix.  They start in groups by first
    symbol, and groups are handled from the greatest down.  Each suffix of a group points to the last suffix before
    it in a lesser group; a suffix pointed to k times leaves its group for a new one right above it, the more often,
    the higher.  Then the order is read off: whenever a suffix gets its place, the one before it, and along the
    pointers those that lead to it, are the next of their groups.
    """
    text = [*symbols, 0]  # the end is less than all symbols
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place, start, size = [0] * n, [0] * n, [0] * n
    first = 0
    for k, i in enumerate(order):
        if k and text[i] != text[order[k - 1]]:
            first = k
        place[i], start[i] = k, first
        size[first] += 1

    smaller = [-1] * n  # the previous suffix in a lesser group
    end = n
    while end:
        first = start[order[end - 1]]
        pointed: dict[int, int] = {}
        for i in sorted(order[first:end]):
            j = i - 1
            while j >= 0 and start[j] >= first:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        moves: dict[tuple[int, int], list[int]] = {}
        for j, times in pointed.items():
            moves.setdefault((-times, start[j]), []).append(j)
        for _, group in sorted(moves):
            members = moves[_, group]
            top = group + size[group]
            for j in members:
                top -= 1
                k, other = place[j], order[top]
                order[k], place[other] = other, k
                order[top], place[j] = j, top
            if top > group:
                size[group], size[top] = top - group, len(members)
                for j in members:
                    start[j] = top
        end = first

    found, used, placed = [-1] * n, [0] * n, [False] * n
    found[0] = n - 1
    placed[n - 1] = True
    for k in range(n):
        j = found[k] - 1
        while j >= 0 and not placed[j]:
            group = start[j]
            found[group + used[group]] = j
            used[group] += 1
            placed[j] = True
            j = smaller[j]
    return found[1:]


def common_prefixes(symbols: Sequence[int], suffixes: Sequence[int]) -> list[int]:
    """For each place in the suffix array, the symbols that its suffix shares with the one before it."""
    n = len(suffixes)
    before, lengths, out = [-1] * n, 0, [0] * n
    rank = [0] * n
    for k, i in enumerate(suffixes):
        rank[i] = k
        before[i] = suffixes[k - 1] if k else -1
    for i in range(n):
        j = before[i]
        if j < 0:
            lengths = 0
            continue
        while i + lengths < n and j + lengths < n and symbols[i + lengths] == symbols[j + lengths]:
            lengths += 1
        out[rank[i]] = lengths
        lengths = max(0, lengths - 1)
    return out
