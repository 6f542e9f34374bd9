"""Suffix arrays of many short strings at once, by linear grouping construction.

Suffixes are grouped by the Lyndon word they begin with, then put in order within
their groups; no string is renamed and nothing recurs:

1. Groups start as the suffixes with the same first symbol and are processed from
   the highest down. For each suffix of a group, the pointer to the nearest earlier
   suffix in a lower group is followed; a suffix that is pointed at c times has its
   own Lyndon word lengthened by c copies of the group's word and moves to a new
   group above those of its old group that are pointed at less often.
2. From the smallest suffix on, each suffix found places the one before it, and
   along the pointers all that end where it begins, at the next free places of
   their groups.

The steps of one string follow from each other, but strings do not: all strings of
a call take each step together, as numpy operations over one entry for each string
or member, so the cost of a step is shared by thousands of strings.
"""

from __future__ import annotations

import numpy as np


#: So few strings left are finished one by one.
FEW = 12


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0] .. first[0]+size[0]-1, first[1] .. , joined."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)


def _earlier(begin: np.ndarray, n: int) -> np.ndarray:
    """The suffix before each one in its string (``n``: none)."""
    out = np.arange(-1, n - 1)
    out[begin] = n
    return out


def suffix_arrays(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The sorted suffixes of each string, as positions in ``symbols``.

    ``symbols`` holds the strings one after the other, each ended by a 0 that stands
    nowhere else; string j has its order where the string itself stands.
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    begin = np.cumsum(lengths) - lengths
    group, before = _grouped(symbols, lengths, begin, n)
    return _emitted(group, before, lengths, begin, n)


def _grouped(symbols: np.ndarray, lengths: np.ndarray, begin: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix: the first place of its group, and the nearest earlier
    suffix of a lower group (``n``: none)."""
    own = np.repeat(np.arange(len(lengths)), lengths)
    order = np.lexsort((symbols, own))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    head = np.r_[True, (own[order][1:] != own[order][:-1]) | (symbols[order][1:] != symbols[order][:-1])]
    heads = np.flatnonzero(head)
    size = np.zeros(n, np.int64)
    size[heads] = np.diff(np.r_[heads, n])
    group = np.empty(n + 1, np.int64)
    group[order] = heads[np.cumsum(head) - 1]
    group[n] = -1
    before = np.full(n + 1, n, np.int64)
    moved = np.zeros(n, bool)
    earlier = _earlier(begin, n)

    strings = np.arange(len(lengths))
    last = begin + lengths - 1  # the highest place not yet processed
    while len(strings):
        low = group[order[last[strings]]]
        members = order[_ranges(low, size[low])]
        top = np.repeat(last[strings], size[low])
        floor = np.repeat(low, size[low])
        last[strings] = low - 1
        strings = strings[low > begin[strings]]

        # nearest earlier suffix whose group is not yet processed
        at = earlier[members]
        going = (group[at] > top).nonzero()[0]
        while len(going):
            at[going] = before[at[going]]
            going = going[group[at[going]] > top[going]]
        before[members] = at
        # and on through members of the group itself, doubling the reach
        going = (group[at] == floor).nonzero()[0]
        while len(going):
            before[members[going]] = before[before[members[going]]]
            going = going[group[before[members[going]]] == floor[going]]

        target = before[members]
        target, count = np.unique(target[target < n], return_counts=True)
        if not len(target):
            continue
        by = np.lexsort((count, group[target]))
        target, count = target[by], count[by]
        old = group[target]
        cut = np.flatnonzero(np.r_[True, old[1:] != old[:-1]])
        many = np.diff(np.r_[cut, len(old)])
        tail = old[cut] + size[old[cut]] - many
        new_places = _ranges(tail, many)
        moved[target] = True
        left = place[target]
        vacated = left[left < np.repeat(tail, many)]
        occupants = order[new_places]
        displaced = occupants[~moved[occupants]]
        moved[target] = False
        # both are sorted by old group and equally many in each, so they pair up
        order[vacated], place[displaced] = displaced, vacated
        order[new_places], place[target] = target, new_places
        size[old[cut]] -= many
        parts = np.flatnonzero(np.r_[True, (old[1:] != old[:-1]) | (count[1:] != count[:-1])])
        widths = np.diff(np.r_[parts, len(old)])
        size[new_places[parts]] = widths
        group[target] = np.repeat(new_places[parts], widths)
    return group, before


def _emitted(group: np.ndarray, before: np.ndarray, lengths: np.ndarray, begin: np.ndarray, n: int) -> np.ndarray:
    out = np.empty(n, np.int64)
    free = np.arange(n)  # by the group's first place: its next free one
    done = np.zeros(n + 1, bool)
    done[n] = True
    ends = begin + lengths
    out[begin] = ends - 1
    done[ends - 1] = True
    earlier = _earlier(begin, n)
    at, now = begin.copy(), np.full(len(begin), n)
    while len(at) > FEW:
        # a string whose chain has ended goes on to the chain of its next suffix; then each places one
        closed = done[now].nonzero()[0]
        if len(closed):
            over = at[closed] >= ends[closed]
            if over.any():
                keep = np.ones(len(at), bool)
                keep[closed[over]] = False
                at, now, ends = at[keep], now[keep], ends[keep]
                closed = done[now].nonzero()[0]
            now[closed] = earlier[out[at[closed]]]
            at[closed] += 1
            open_ = (~done[now]).nonzero()[0]
        else:
            open_ = np.arange(len(now))
        s = now[open_]
        g = group[s]
        out[free[g]] = s
        free[g] += 1
        done[s] = True
        now[open_] = before[s]
    places, next_free, seen, groups, chain, left = map(memoryview, (out, free, done, group, before, earlier))
    for i, s, end in zip(at.tolist(), now.tolist(), ends.tolist()):
        while True:
            while not seen[s]:
                g = groups[s]
                places[next_free[g]] = s
                next_free[g] += 1
                seen[s] = True
                s = chain[s]
            if i >= end:
                break
            s = left[places[i]]
            i += 1
    return out
