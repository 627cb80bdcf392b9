"""Suffix arrays by linear grouping, without renaming and recursion.

Phase one groups suffixes by their longest Lyndon prefix. Groups begin as first symbols and are taken in descending
order; what is taken leaves a list of open positions, so the left neighbour that remains is the previous smaller
suffix. That neighbour's prefix grows by the taken group's prefix, once for every taken child, and it moves to a new
group just above its old one. Phase two emits groups in ascending order: each suffix that is emitted admits, through
the previous-smaller pointers, those suffixes whose Lyndon prefix ends where it begins, each to the next free place
of its group.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """Start positions of all suffixes of a sequence of integers, in ascending order. Time and memory are linear
    beyond the sort of the distinct symbols."""
    n = len(text)
    if n == 0:
        return []
    first: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        if c in first:
            first[c].append(i)
        else:
            first[c] = [i]
    symbols = sorted(first)
    members = [first[c] for c in symbols]  # members of a group, ascending; some may have moved on since
    group = [0] * n
    for g, own in enumerate(members):
        for i in own:
            group[i] = g
    below = list(range(-1, len(members) - 1))  # the next lower group, and the next higher
    higher = list(range(1, len(members) + 1))
    # open positions as a linked list; place n stands for "none" on the left, n + 1 for the right end
    left = list(range(-1, n))
    left[0] = n
    right = list(range(1, n + 2))
    right[n] = 0
    left.append(n - 1)
    right[n - 1] = n + 1
    right.append(0)
    prev = [n] * n
    order = []  # groups in descending order
    g = len(members) - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        members[g] = own
        order.append(g)
        moved: dict[tuple[int, int], list[int]] = {}
        last = last_old = -1
        parent, times = n, 0
        for i in own:
            p, r = left[i], right[i]
            left[r] = p
            right[p] = r
            prev[i] = p
            if p == parent:
                times += 1
            else:
                if parent != n:
                    moved.setdefault((group[parent], times), []).append(parent)
                parent, times = p, 1
        if parent != n:
            moved.setdefault((group[parent], times), []).append(parent)
        if moved:
            for old, times in sorted(moved) if len(moved) > 1 else moved:  # each goes just above the last, or its old group
                new, own = len(members), moved[old, times]
                members.append(own)
                for i in own:
                    group[i] = new
                under = last if last_old == old else old
                over = higher[under]
                below.append(under)
                higher.append(over)
                higher[under] = below[over] = new
                last, last_old = new, old
        g = below[g]
    place = [0] * len(members)
    at = 0
    for g in reversed(order):
        place[g] = at
        at += len(members[g])
    out = [0] * n
    i = n - 1
    while i != n:
        out[place[group[i]]] = i
        place[group[i]] += 1
        i = prev[i]
    for at in range(n):
        j = out[at]
        if j:
            stop, i = prev[j], j - 1
            while i != stop:
                g = group[i]
                out[place[g]] = i
                place[g] += 1
                i = prev[i]
    return out
