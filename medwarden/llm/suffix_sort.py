"""Suffix sorting by linear grouping.

Suffixes start in groups by their first symbol. Groups are finished in descending order: when a
group is, each of its suffixes points to the nearest one before it that lies in a lower group. A
suffix so pointed at is followed by the finished group's word, so it leaves its own group for a new
one just above. In the end a group holds the suffixes of one Lyndon prefix. The order within groups
follows from one sweep, as a suffix takes its place when the one behind its Lyndon prefix does. No
names are made anew for a shorter string, and nothing recurs.
"""

from __future__ import annotations


def lyndon_groups(text: list[int]) -> tuple[list[int], list[int], list[list[int]]]:
    """(nearest lower suffix before each, group of each, members by group in ascending order)."""
    n = len(text)
    symbols = sorted(set(text))
    number = {s: i for i, s in enumerate(symbols)}
    group = [number[s] for s in text]
    members: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    size = [len(m) for m in members]
    below = list(range(-1, len(symbols) - 1))
    above = [*range(1, len(symbols)), -1]
    previous = [-1] * n
    # Groups that are finished, and the one at hand, are higher than all others.
    high = [False] * len(symbols)
    descending = []
    at = len(symbols) - 1
    while at >= 0:
        high[at] = True
        own = [i for i in members[at] if group[i] == at]
        own.sort()
        members[at] = own
        descending.append(at)
        times: dict[int, int] = {}
        for i in own:
            p = i - 1
            while p >= 0 and high[group[p]]:
                p = previous[p]
            previous[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        parts: dict[tuple[int, int], list[int]] = {}
        for p, k in times.items():
            parts.setdefault((group[p], k), []).append(p)
        # More repeats of the word make the higher suffix; the rest of the group stays lowest.
        for g, k in sorted(parts, reverse=True) if len(parts) > 1 else parts:
            part = parts[g, k]
            if len(part) == size[g]:
                continue
            new = len(members)
            size[g] -= len(part)
            size.append(len(part))
            members.append(part)
            high.append(False)
            for p in part:
                group[p] = new
            up = above[g]
            below.append(g)
            above.append(up)
            above[g] = new
            if up >= 0:
                below[up] = new
        at = below[at]
    return previous, group, [members[g] for g in reversed(descending)]


def suffix_array(text: list[int]) -> list[int]:
    """Start positions of the suffixes of ``text`` in ascending order; a prefix sorts first."""
    n = len(text)
    if not n:
        return []
    previous, group, groups = lyndon_groups(text)
    slot = [0] * (max(group) + 1)
    start = 0
    for m in groups:
        slot[group[m[0]]] = start
        start += len(m)
    order = [-1] * n
    placed = bytearray(n)

    def sweep(p: int) -> None:
        while p >= 0 and not placed[p]:
            placed[p] = 1
            g = group[p]
            order[slot[g]] = p
            slot[g] += 1
            p = previous[p]

    sweep(n - 1)  # the empty suffix comes before all
    for i in range(n):
        sweep(order[i] - 1)
    return order
