"""Suffix arrays of a shard by induced sorting, vectorised bucket by bucket.

``suffix_array`` classifies suffixes into smaller (S) and larger (L) ones
than their right neighbour, sorts the leftmost-S substrings by one induced
pass, orders the string of their names (by induced sorting again while its
alphabet is small, else by rank doubling), and induces the full array. The
order is exact up to ``depth`` units, which is all that a threshold on the
common prefix needs. ``repeated`` computes the common prefixes in text order
(permuted), cut off at the threshold.
"""

from __future__ import annotations

import numpy as np

from panelcast.llm.vec import runs

#: Names in at most so many kinds are sorted by induction again.
SMALL_ALPHABET = 1024


def classify(t: np.ndarray) -> np.ndarray:
    """Mask of the S suffixes; the last, unique least unit counts as S."""
    at = runs(t)
    head = t[at]
    kind = np.empty(len(at), bool)
    kind[-1] = True
    kind[:-1] = head[:-1] < head[1:]
    return np.repeat(kind, np.diff(np.r_[at, len(t)]))


def induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Suffix array induced from leftmost-S positions in their order."""
    end = np.cumsum(size)
    begin = end - size
    sa = np.full(len(t), -1, np.int32)
    kinds = np.flatnonzero(size).tolist()
    cut = np.bincount(t[lms], minlength=len(size))
    order = np.argsort(t[lms], kind="stable")
    placed = lms[order]
    first = end - cut
    sa[np.repeat(first, cut) + np.arange(len(lms)) - np.repeat(np.cumsum(cut) - cut, cut)] = placed

    def push(cur: np.ndarray, want_small: bool, edge: np.ndarray) -> None:
        j = cur[cur > 0] - 1
        j = j[small[j] == want_small]
        if not len(j):
            return
        if len(j) == 1:
            c = t[j[0]]
            if want_small:
                edge[c] -= 1
                sa[edge[c]] = j[0]
            else:
                sa[edge[c]] = j[0]
                edge[c] += 1
            return
        key = t[j]
        order = np.argsort(key, kind="stable")
        j, key = j[order], key[order]
        at = runs(key)
        count = np.diff(np.r_[at, len(key)])
        rank = np.arange(len(key)) - np.repeat(at, count)
        if want_small:
            sa[edge[key] - 1 - rank] = j
            edge[key[at]] -= count
        else:
            sa[edge[key] + rank] = j
            edge[key[at]] += count

    head = begin.copy()
    for c in kinds:
        low = begin[c]
        while low < head[c]:
            high = head[c]
            push(sa[low:high], False, head)
            low = high
        push(sa[first[c]:end[c]], False, head)
    tail = end.copy()
    for c in reversed(kinds):
        high = end[c]
        while tail[c] < high:
            low = tail[c]
            push(sa[low:high][::-1], True, tail)
            high = low
        push(sa[begin[c]:head[c]][::-1], True, tail)
    sa[0] = len(t) - 1
    return sa


def name(t: np.ndarray, order: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Names, by place in ``order``, of the substrings [p, stop[p]]: equal ones share a name."""
    a, b = order[:-1], order[1:]
    size_a, size_b = stop[a] - a, stop[b] - b
    differ = size_a != size_b
    live = np.flatnonzero(~differ)
    step = 0
    while len(live):
        here = t[a[live] + step] != t[b[live] + step]
        differ[live[here]] = True
        live = live[~here]
        step += 1
        live = live[size_a[live] >= step]
    return np.r_[0, np.cumsum(differ)]


def doubled(s: np.ndarray, depth: int) -> np.ndarray:
    """Suffix order of ``s``, exact over the first ``depth`` units; ranks that are
    unique already are not sorted again."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    at = runs(s[order])
    size = np.diff(np.r_[at, n])
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(at, size)
    live = order[np.repeat(size > 1, size)]  # in order of rank
    step = 1
    while step < depth and len(live):
        after = live + step
        key = rank[live] * (n + 1)
        inner = after < n
        key[inner] += rank[after[inner]] + 1
        by = np.argsort(key)
        key, live = key[by], live[by]
        own = rank[live]  # the same before and after the sort: key leads with it
        slot = own + np.arange(len(live)) - np.repeat(*_first(own))
        order[slot] = live
        at = runs(key)
        size = np.diff(np.r_[at, len(live)])
        rank[live] = np.repeat(slot[at], size)
        live = live[np.repeat(size > 1, size)]
        step *= 2
    return order


def _first(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of every run."""
    at = runs(values)
    return at, np.diff(np.r_[at, len(values)])


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array of ``t``, whose last unit is its only 0."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    size = np.bincount(t)
    small = classify(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    sa = induce(t, small, lms, size)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = sa[is_lms[sa]]
    stop = np.zeros(n, np.int64)
    stop[lms] = np.r_[lms[1:], n - 1]
    names = name(t, order, stop)
    if names[-1] + 1 < len(lms):
        by_place = np.empty(n, np.int64)
        by_place[order] = names
        reduced = by_place[lms]
        if names[-1] < SMALL_ALPHABET:
            order = lms[suffix_array(reduced, depth)]
        else:
            # Leftmost-S positions lie two units apart at least.
            order = lms[doubled(reduced, min(depth, depth // 2 + 2))]
    return induce(t, small, order, size)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one integer; zeros follow the end."""
    padded = np.r_[data, np.zeros(8, np.uint8)].astype(np.uint64)
    out = padded[:len(data)].copy()
    for k in range(1, 8):
        out |= padded[k:k + len(data)] << np.uint64(8 * k)
    return out


def repeated(data: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places with ``length`` units left in their row, in suffix order, and the
    start in that order of each class of places whose next ``length`` bytes are equal."""
    rows = len(off) - 1
    size = np.diff(off)
    # Rows are joined by a separator (1) and closed by the sentinel (0).
    shift = np.repeat(np.arange(rows), size)
    t = np.full(len(data) + rows + 1, 1, np.uint16)  # stable sorts of 16 bits are radix sorts
    place = np.arange(len(data)) + shift
    t[place] = data.astype(np.uint16) + 2
    t[-1] = 0
    sa = suffix_array(t, length)
    back = np.full(len(t), -1, np.int64)
    back[place] = np.arange(len(data))
    left = np.zeros(len(data), np.int64)
    left[:] = np.repeat(off[1:], size) - np.arange(len(data))
    order = back[sa]
    order = order[order >= 0]
    order = order[left[order] >= length]
    if not len(order):
        return order, order
    # Common prefix with the predecessor, in text order, cut off at ``length``.
    before = np.full(len(data), -1, np.int64)
    before[order[1:]] = order[:-1]
    words = eights(data)
    live = np.flatnonzero(before >= 0)
    for k in [*range(0, length - 7, 8), length - 8] if length >= 8 else []:
        live = live[words[live + k] == words[before[live] + k]]
    for k in range(length) if length < 8 else []:
        live = live[data[live + k] == data[before[live] + k]]
    same = np.zeros(len(data), bool)
    same[live] = True
    return order, np.flatnonzero(~same[order])
