"""Suffix arrays in numpy: induced sorting for shards, rank doubling for short inputs, and longest
common prefixes in text order."""

from __future__ import annotations

import numpy as np

#: Alphabets up to this size are sorted by inducing bucket by bucket; beyond it buckets hold so few
#: suffixes that doubling the ranks of names is the faster way to the same order.
BUCKETS = 4096


def doubled(t: np.ndarray) -> np.ndarray:
    """Suffix array of an integer array by rank doubling. Only suffixes that still tie are sorted again."""
    n = len(t)
    if n == 0:
        return np.empty(0, np.int64)
    order = np.argsort(t, kind="stable")
    new = np.ones(n, bool)
    new[1:] = t[order[1:]] != t[order[:-1]]
    return _refine(order, new, 1)


def of_bytes(buf: bytes) -> np.ndarray:
    """Suffix array of a byte string: by the first eight bytes, then by rank doubling."""
    n = len(buf)
    if n == 0:
        return np.empty(0, np.int64)
    words = np.ndarray((n,), ">u8", buf + bytes(8), strides=(1,)).astype(np.uint64)
    order = np.argsort(words, kind="stable")
    # A suffix of under eight bytes ties with its own zero-padded look-alikes; the shorter is the smaller.
    new = np.ones(n, bool)
    first = words[order]
    new[1:] = first[1:] != first[:-1]
    if n > 1 and (short := order >= n - 7).any():
        at = np.flatnonzero(short | np.r_[False, short[:-1]] | np.r_[short[1:], False])
        runs = np.cumsum(new)
        for r in np.unique(runs[at]):
            lo, hi = np.searchsorted(runs, r), np.searchsorted(runs, r, "right")
            if hi - lo > 1:
                own = order[lo:hi]
                tail = np.sort(own[own >= n - 7])[::-1]
                order[lo:hi] = np.r_[tail, own[own < n - 7]]
                new[lo : lo + len(tail)] = True
                if lo + len(tail) < hi:
                    new[lo + len(tail)] = True
    return _refine(order, new, 8)


def _refine(order: np.ndarray, new: np.ndarray, width: int) -> np.ndarray:
    """Sort on until no two suffixes tie. order is right for the first width symbols, and new marks
    where a run of equal ones begins."""
    n = len(order)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = start
    while True:
        tied = np.flatnonzero(~new | np.r_[~new[1:], False])
        if not len(tied):
            return order
        who = order[tied]
        after = rank[np.minimum(who + width, n)]
        group = start[tied]
        by = np.lexsort((after, group))
        who, after, group = who[by], after[by], group[by]
        order[tied] = who
        fresh = np.ones(len(tied), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (after[1:] != after[:-1])
        new[tied] = fresh
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order[tied]] = start[tied]
        width *= 2


def induced(t: np.ndarray, k: int) -> np.ndarray:
    """Suffix array of t by induced sorting. t ends with a 0 that occurs nowhere else; k: symbols in use are below it.

    Suffixes are classed as smaller (S) or larger (L) than their right neighbour; the leftmost S of
    each run begins a substring; those are sorted by one round of inducing and named; names that
    repeat are sorted by recursion; the order of the leftmost S suffixes then induces all others.
    """
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    if k > BUCKETS:
        return doubled(t)
    change = np.flatnonzero(t[1:] != t[:-1])
    nxt = change[np.searchsorted(change, np.arange(n - 1))] if len(change) else np.zeros(0, np.int64)
    small = np.ones(n, bool)
    small[:-1] = t[nxt] < t[nxt + 1]
    left = np.zeros(n, bool)
    left[1:] = small[1:] & ~small[:-1]
    lms = np.flatnonzero(left)
    sizes = np.bincount(t, minlength=k)
    ends = np.cumsum(sizes)

    sa = _induce(t, small, lms[np.argsort(t[lms], kind="stable")], sizes, ends)
    found = sa[left[sa]]
    names = np.zeros(len(found), np.int64)
    names[1:] = np.cumsum(~_same_substrings(t, small, found, lms))
    if names[-1] + 1 < len(found):
        reduced = np.empty(n, np.int64)
        reduced[found] = names
        found = lms[induced(reduced[lms], int(names[-1]) + 1)]
    return _induce(t, small, found, sizes, ends)


def _same_substrings(t: np.ndarray, small: np.ndarray, found: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """For neighbours in found, whether the substrings up to the next leftmost S are equal."""
    upto = np.r_[lms[1:], lms[-1]] - lms + 1
    length = np.empty(len(t), np.int64)
    length[lms] = upto
    a, b = found[:-1], found[1:]
    same = length[a] == length[b]
    live = np.flatnonzero(same)
    both = t.astype(np.int64) * 2 + small
    d = 0
    while len(live):
        i, j = a[live], b[live]
        more = d < length[i]
        live, i, j = live[more], i[more], j[more]
        equal = both[i + d] == both[j + d]
        same[live[~equal]] = False
        live = live[equal]
        d += 1
    return same


def _induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """From leftmost S suffixes, in order within each symbol, place the L suffixes left to right and
    then the S suffixes right to left. Each bucket is dealt with as one array, again while it feeds itself."""
    n = len(t)
    starts = ends - sizes
    sa = np.full(n, -1, np.int64)
    first = t[lms]
    seeds = np.bincount(first, minlength=len(sizes))
    at = np.cumsum(seeds) - seeds
    used = np.flatnonzero(sizes)

    head = starts.copy()
    for c in used:
        lot, wave = [], sa[starts[c] : head[c]]
        own = lms[at[c] : at[c] + seeds[c]]
        while len(wave):
            prior = wave[wave > 0] - 1
            prior = prior[~small[prior]]
            into = t[prior]
            lot.append(prior[into != c])
            wave = prior[into == c]
            sa[head[c] : head[c] + len(wave)] = wave
            head[c] += len(wave)
        prior = own[own > 0] - 1
        lot.append(prior[~small[prior]])
        _deal(np.concatenate(lot), t, sa, head, 1)

    tail = ends.copy()
    for c in used[::-1]:
        lot, wave = [], sa[tail[c] : ends[c]][::-1]
        while len(wave):
            prior = wave[wave > 0] - 1
            prior = prior[small[prior]]
            into = t[prior]
            lot.append(prior[into != c])
            wave = prior[into == c]
            sa[tail[c] - len(wave) : tail[c]] = wave[::-1]
            tail[c] -= len(wave)
        larger = sa[starts[c] : head[c]][::-1]
        prior = larger[larger > 0] - 1
        lot.append(prior[small[prior]])
        _deal(np.concatenate(lot), t, sa, tail, -1)
    sa[0] = n - 1
    return sa


def _deal(lot: np.ndarray, t: np.ndarray, sa: np.ndarray, edge: np.ndarray, step: int) -> None:
    """Put suffixes into their symbols' buckets in the order given, from the left or from the right edge."""
    if not len(lot):
        return
    into = t[lot]
    by = np.argsort(into, kind="stable")
    lot, into = lot[by], into[by]
    cut = np.flatnonzero(np.r_[True, into[1:] != into[:-1]])
    count = np.diff(np.r_[cut, len(into)])
    within = np.arange(len(into)) - np.repeat(cut, count)
    base = edge[into]
    sa[base + within if step > 0 else base - 1 - within] = lot
    edge[into[cut]] += step * count


def plcp(buf: bytes, sa: np.ndarray) -> np.ndarray:
    """Longest common prefix of each suffix with the one before it in sa, in text order.

    Where the byte before a suffix equals the byte before its predecessor, the value is one less
    than its left neighbour's; only the others are compared, which is little work in all.
    """
    n = len(sa)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    raw = np.frombuffer(buf, np.uint8)
    pos = np.arange(n)
    free = np.ones(n, bool)
    inner = (pos > 0) & (phi > 0)
    free[inner] = raw[pos[inner] - 1] != raw[phi[inner] - 1]
    seeds = np.flatnonzero(free & (phi >= 0))
    out[seeds] = common(buf, seeds, phi[seeds])
    last = np.maximum.accumulate(np.where(free, pos, 0))
    return np.maximum(out[last] - (pos - last), 0)


def common(buf: bytes, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of the suffixes at a and b (a != b)."""
    n = len(buf)
    room = n - np.maximum(a, b)
    words = np.ndarray((n,), "<u8", buf + bytes(8), strides=(1,))
    got = np.zeros(len(a), np.int64)
    live = np.flatnonzero(room > 0)
    while len(live) > 32:
        x = words[a[live] + got[live]] ^ words[b[live] + got[live]]
        low = x & (~x + np.uint64(1))
        eq = np.where(x == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) >> 3)
        got[live] += eq
        done = (x != 0) | (got[live] >= room[live])
        live = live[~done]
    raw = np.frombuffer(buf, np.uint8)
    for k in live:
        i, j, step = int(a[k] + got[k]), int(b[k] + got[k]), 64
        end = n - max(i, j)
        d = 0
        while d < end:
            m = min(step, end - d)
            differ = raw[i + d : i + d + m] != raw[j + d : j + d + m]
            if differ.any():
                d += int(differ.argmax())
                break
            d += m
            step = min(step * 4, 1 << 20)
        got[k] += d
    return np.minimum(got, room)
