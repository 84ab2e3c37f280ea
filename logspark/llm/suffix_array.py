"""Suffix array by linear grouping, without recursive renaming.

Phase 1 sorts suffixes into groups by their longest Lyndon prefix: groups, at
first of equal first symbols, are taken in descending order; each member points
to the nearest position before it that is in a lower group; the positions
pointed at leave their groups for new ones just above, by how many pointers
they got. Phase 2 takes the array in ascending order and puts before each
suffix's predecessor chain, along the same pointers, the next place of its group.
"""

from __future__ import annotations

from collections import Counter


def suffix_array(text: list[int]) -> list[int]:
    """Positions of the suffixes of ``text`` in ascending order; the last symbol must be smaller than all others."""
    n = len(text)
    sa = sorted(range(n), key=text.__getitem__)
    place = [0] * n  # of a position in sa
    group = [0] * n  # a group's name is the place where it begins, so names order groups
    size = [0] * n
    for at, i in enumerate(sa):
        place[i] = at
        group[i] = group[sa[at - 1]] if at and text[sa[at - 1]] == text[i] else at
        size[group[i]] += 1
    before = [-1] * n

    def raise_(moved: list[int]) -> None:
        """Put positions, each out of its group, into a new group right above it."""
        old = {}
        for p in moved:
            q = group[p]
            end = q + size[q] - 1
            size[q] -= 1
            other, at = sa[end], place[p]
            sa[at], place[other] = other, at
            sa[end], place[p] = p, end
            old[p] = q
        starts = {q: q + size[q] for q in old.values()}
        for p, q in old.items():
            group[p] = starts[q]
            size[starts[q]] = 0
        for p in old:
            size[group[p]] += 1

    high = n
    while high:
        low = group[sa[high - 1]]
        if high - low == 1:
            i = sa[low]
            p = i - 1
            while p >= 0 and group[p] >= low:
                p = before[p]
            before[i] = p
            if p >= 0:
                q = group[p]
                if size[q] > 1:
                    end = q + size[q] - 1
                    size[q] -= 1
                    other, at = sa[end], place[p]
                    sa[at], place[other] = other, at
                    sa[end], place[p] = p, end
                    group[p], size[end] = end, 1
        else:
            pointed: Counter[int] = Counter()
            for i in sorted(sa[low:high]):
                p = i - 1
                while p >= 0 and group[p] >= low:
                    p = before[p]
                before[i] = p
                if p >= 0:
                    pointed[p] += 1
            by_count: dict[int, list[int]] = {}
            for p, c in pointed.items():
                by_count.setdefault(c, []).append(p)
            for c in sorted(by_count, reverse=True):
                raise_(by_count[c])
        high = low

    out = [-1] * n
    next_ = list(range(n))  # next free place of the group that begins here
    placed = [False] * n
    out[0] = n - 1
    placed[n - 1] = True
    for at in range(n):
        j = out[at] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[next_[g]] = j
            next_[g] += 1
            placed[j] = True
            j = before[j]
    return out
