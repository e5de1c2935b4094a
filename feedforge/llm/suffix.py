"""Suffix arrays of strings of bytes or integers by induced sorting, vectorised over waves.

Suffixes are classified as S (smaller than the next one) or L. The leftmost S of each run is an LMS
place; the LMS substrings are sorted by inducing and named, the string of names is sorted by the same
procedure, recursively, and the order of the names' suffixes then induces that of all suffixes.

Inducing goes through the array in order. How many L (or S) suffixes each bucket has is known, so
every place before the first bucket that still lacks some is final; all those places are read in one
wave. A wave covers many buckets where they are small, as those of names are. Where a symbol runs on,
its bucket is read by itself, and all that its runs put there is placed at once.

The permuted common prefixes are found in text order: a place whose left neighbour equals that of
the suffix before it in the array is reducible, with one byte less than the place before, and only
the other places are compared, eight bytes at a time.
"""

from __future__ import annotations

import numpy as np

#: Strings up to this length, where the recursion ends, are sorted by comparing their suffixes.
SHORT = 32


def classify(text: np.ndarray) -> np.ndarray:
    """True for S suffixes. The end of the text counts as smaller than every symbol."""
    n = len(text)
    grows = np.zeros(n, np.int8)
    grows[:-1] = (text[1:] > text[:-1]).astype(np.int8) - (text[1:] < text[:-1])
    grows[-1] = -1
    # a place equal to the next one has the class of the next place that is not
    known = np.where(grows != 0, np.arange(n), n - 1)
    nearest = np.minimum.accumulate(known[::-1])[::-1]
    return grows[nearest] > 0


def _first_open(at: np.ndarray, limit: np.ndarray, b: int) -> int:
    """The first bucket from b on whose place is under its limit, or their number."""
    step = 64
    while b < len(at):
        open_ = at[b : b + step] < limit[b : b + step]
        k = int(open_.argmax())
        if open_[k]:
            return b + k
        b, step = b + step, 4 * step
    return len(at)


def _induce(text: np.ndarray, is_s: np.ndarray, seeds: np.ndarray, symbols: int) -> np.ndarray:
    """Suffixes in order, given LMS places in the order in which they end their buckets."""
    n = len(text)
    counts = np.bincount(text, minlength=symbols)
    tails = np.cumsum(counts)
    heads = tails - counts
    middles = heads + np.bincount(text[~is_s], minlength=symbols)  # where L suffixes end
    order = np.full(n, -1, np.int32)
    ramp = np.arange(n)

    def place(found: np.ndarray, at: np.ndarray, step: int) -> None:
        """Put places into their buckets, keeping their order; the buckets' ends move by as much."""
        k = len(found)
        if not k:
            return
        b = text[found]
        group = b.argsort(kind="stable")
        b = b[group]
        first = np.flatnonzero(b[1:] != b[:-1]) + 1
        bounds = np.empty(len(first) + 2, np.int64)
        bounds[0], bounds[1:-1], bounds[-1] = 0, first, k
        first, sizes = bounds[:-1], bounds[1:] - bounds[:-1]
        b = b[first]
        begin = at[b]
        if step > 0:
            order[np.repeat(begin - first, sizes) + ramp[:k]] = found[group]
        else:
            order[np.repeat(begin + first - 1, sizes) - ramp[:k]] = found[group]
        at[b] = begin + step * sizes

    # seeds at the ends of their buckets
    ends = tails.copy()
    place(seeds[::-1], ends, -1)
    # how far each place's symbol runs back from it, and which symbols run at all
    start = ramp.copy()
    start[1:][text[1:] == text[:-1]] = 0
    back = ramp - np.maximum.accumulate(start)
    runs = np.zeros(symbols, bool)
    runs[text[back > 0]] = True
    # L and S places that differ from the next one
    alone = np.ones(n, bool)
    alone[:-1] = text[1:] != text[:-1]
    single = {False: alone & ~is_s, True: alone & is_s}

    def run_out(before: np.ndarray) -> np.ndarray:
        """The places before some of one bucket, and all that their symbol's runs put there after them, wave by wave."""
        size = back[before] + 1
        depth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        which = np.repeat(np.arange(len(before)), size)
        by = np.argsort(depth, kind="stable")
        return before[which[by]] - depth[by]

    def wave(read: np.ndarray, at: np.ndarray, step: int, kind: bool, first: int) -> None:
        """Place what comes before the suffixes read; a bucket that is read for the first time also gets its runs."""
        before = read[read > 0] - 1
        place(before[single[kind][before]], at, step)
        if first >= 0:
            before = before[(is_s[before] == kind) & ~alone[before]]
            found = run_out(before[text[before] == first])
            order[at[first] + step * np.arange(len(found)) - (step < 0)] = found
            at[first] += step * len(found)

    # L suffixes, from the left; the end of the text comes before all
    at, lo, b = heads.copy(), 0, 0
    place(np.array([n - 1]), at, 1)
    while lo < n:
        b = _first_open(at, middles, b)
        first = -1
        if b == symbols:
            hi = n
        elif not runs[b]:
            hi = int(at[b])
        elif lo < heads[b]:
            hi = int(heads[b])
        else:
            hi, first = int(at[b]), b
        wave(order[lo:hi], at, 1, False, first)
        lo = hi
    # S suffixes, from the right, in place of the seeds
    at, hi, b = tails.copy(), n, 0
    back_at, limit = at[::-1], middles[::-1]
    while hi > 0:
        b = _first_open(limit, back_at, b)
        c, first = symbols - 1 - b, -1
        if b == symbols:
            lo = 0
        elif not runs[c]:
            lo = int(at[c])
        elif hi > tails[c]:
            lo = int(tails[c])
        else:
            lo, first = int(at[c]), c
        wave(order[lo:hi][::-1], at, -1, True, first)
        hi = lo
    return order


def _name(text: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Names of LMS substrings in text order: equal for equal substrings, ascending with their order."""
    n = len(text)
    stop = np.append(lms[1:], n - 1)
    index = np.full(n, -1, np.int32)
    index[lms] = np.arange(len(lms))
    where = index[ordered]
    size = (stop - lms)[where]
    same = size[1:] == size[:-1]
    # the last LMS substring runs to the end of the text and equals no other
    same &= (where[1:] != len(lms) - 1) & (where[:-1] != len(lms) - 1)
    left, right, length = ordered[:-1], ordered[1:], size[1:]
    open_ = np.flatnonzero(same)
    k = 0
    while len(open_):
        alive = text[left[open_] + k] == text[right[open_] + k]
        same[open_[~alive]] = False
        open_ = open_[alive & (length[open_] > k)]
        k += 1
    names = np.empty(len(lms), np.int64)
    names[where] = np.concatenate(([0], np.cumsum(~same)))
    return names


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of an array of small integers, none below zero, in ascending order."""
    n = len(text)
    if n <= SHORT:
        raw = text.astype(">u4").tobytes()
        return np.array(sorted(range(n), key=lambda i: raw[4 * i :]), np.int32)
    symbols = int(text.max()) + 1
    is_s = classify(text)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    if not len(lms):
        return _induce(text, is_s, lms, symbols)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    rough = _induce(text, is_s, lms, symbols)
    names = _name(text, lms, rough[is_lms[rough]].astype(np.int64))
    if names.max() + 1 < len(lms):
        # short symbols are dealt into buckets faster
        ordered = lms[suffix_array(names.astype(np.uint16 if names.max() < 1 << 16 else np.int32))]
    else:
        ordered = np.empty(len(lms), np.int64)
        ordered[names] = lms
    return _induce(text, is_s, ordered, symbols)


def permuted_common_prefixes(text: np.ndarray, order: np.ndarray, need: int) -> np.ndarray:
    """For each place in text order, bytes shared with the suffix before it in the array, or `need` at least where they are more."""
    n = len(text)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    i = np.arange(n)
    reducible = (i > 0) & (before > 0)
    reducible[reducible] = text[i[reducible] - 1] == text[before[reducible] - 1]
    # the suffixes before must be neighbours as well
    ok = np.zeros(n, bool)
    ok[1:] = reducible[1:] & (before[1:] == before[:-1] + 1)
    places = np.flatnonzero(~ok & (before >= 0))
    padded = np.concatenate((text.astype(np.uint8, copy=False), np.zeros(8, np.uint8)))
    words = np.ndarray(n + 1, "<u8", padded.data, strides=(1,))
    length = np.zeros(len(places), np.int64)
    live = np.arange(len(places))
    # as far as the reducible places that follow can tell
    limit = np.minimum(n - np.maximum(places, before[places]), np.diff(places, append=n) + need)
    while len(live):
        a, b = places[live] + length[live], before[places[live]] + length[live]
        differ = words[a] ^ words[b]
        # zero bits below the lowest one that differs; of none, 64
        equal = (np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) >> 3).astype(np.int64)
        length[live] = np.minimum(length[live] + equal, limit[live])
        live = live[(equal == 8) & (length[live] < limit[live])]
    # a reducible place has one byte less than the place before; the first suffix in order has none
    out[places[0] :] = np.repeat(length + places, np.diff(places, append=n)) - i[places[0] :]
    out[order[0]] = 0
    return np.maximum(out, 0, out=out)
