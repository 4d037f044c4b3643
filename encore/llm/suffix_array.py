"""Suffix arrays of byte strings by induced sorting, and permuted common prefixes.

Suffixes are classified as larger or smaller than their right neighbour; the leftmost of each run of
smaller ones split the text into substrings. These are sorted by one induction and named; the string
of names is sorted alike, recursively, until no two names are equal; a second induction from the sorted
leftmost-smaller suffixes gives the array. Each string is at most half as long as the one before.

Inductions go through the buckets of first bytes, or batches of buckets of names, once in each
direction, and treat their suffixes together in array operations.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

BATCH = 8192  # suffixes of names that are induced together, unless one name has more
COMPARED = 1 << 16  # places whose prefixes are compared at once
CHAIN = 8  # batches with longer chains of names that induce each other are halved


def smaller_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the empty suffix is the least."""
    n = len(text)
    rises = np.empty(n, np.int8)
    rises[:-1] = (text[1:] > text[:-1]).astype(np.int8) - (text[1:] < text[:-1])
    rises[-1] = -1
    # Equal names take the type of the next unequal pair.
    at = np.where(rises != 0, np.arange(n, dtype=np.int32), np.int32(n - 1))
    decided = np.minimum.accumulate(at[::-1])[::-1]
    return rises[decided] > 0


def leftmost(smaller: np.ndarray) -> np.ndarray:
    """Positions of the smaller suffixes that follow a larger one."""
    return np.flatnonzero(smaller[1:] & ~smaller[:-1]).astype(np.int32) + np.int32(1)


def deal(sa: np.ndarray, found: np.ndarray, keys: np.ndarray, edge: np.ndarray, up: bool) -> None:
    """Put suffixes, in order, at the free edge of their buckets."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    counts = np.bincount(keys, minlength=256)
    within = np.arange(len(keys)) - (np.cumsum(counts) - counts)[keys]
    if up:
        sa[edge[keys] + within] = found[order]
        edge += counts
    else:
        sa[edge[keys] - 1 - within] = found[order]
        edge -= counts


def induce(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Suffix array from leftmost-smaller suffixes that are sorted by what is to be induced."""
    n = len(text)
    sa = np.full(n, -1, np.int32)
    lms_keys = text[lms]
    lms_counts = np.bincount(lms_keys, minlength=256)
    lms_order = lms[np.argsort(lms_keys, kind="stable")]
    lms_at = np.concatenate(([0], np.cumsum(lms_counts)))

    head = starts.copy()
    sa[head[text[n - 1]]] = n - 1  # the larger suffix before the empty one
    head[text[n - 1]] += 1
    for c in np.flatnonzero(ends > starts):
        at, moved, keys = starts[c], [], []
        while at < head[c]:  # a run of equal bytes feeds its own bucket
            wave = sa[at:head[c]]
            at = head[c]
            before = wave[wave > 0] - 1
            k = text[before]
            own = before[k == c]
            sa[at:at + len(own)] = own
            head[c] += len(own)
            moved.append(before[k > c])
            keys.append(k[k > c])
        wave = lms_order[lms_at[c]:lms_at[c + 1]]
        before = wave[wave > 0] - 1
        moved.append(before)
        keys.append(text[before])
        deal(sa, np.concatenate(moved), np.concatenate(keys), head, True)

    tail = ends.copy()
    for c in np.flatnonzero(ends > starts)[::-1]:
        at, moved, keys = ends[c], [], []
        while at > tail[c]:
            wave = sa[tail[c]:at][::-1]
            at = tail[c]
            before = wave[wave > 0] - 1
            k = text[before]
            own = before[k == c]
            sa[at - len(own):at] = own[::-1]
            tail[c] -= len(own)
            moved.append(before[k < c])
            keys.append(k[k < c])
        wave = sa[starts[c]:head[c]][::-1]  # the larger suffixes of the bucket
        before = wave[wave > 0] - 1
        k = text[before]
        moved.append(before[k < c])
        keys.append(k[k < c])
        deal(sa, np.concatenate(moved), np.concatenate(keys), tail, False)
    return sa


def names_of(text: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Ranks of the leftmost-smaller substrings, in text order; equal substrings share a rank."""
    n = len(text)
    place = np.empty(n, np.int32)
    place[lms] = np.arange(len(lms), dtype=np.int32)
    place = place[ordered]
    length = np.diff(np.append(lms, np.int32(n - 1)))[place] + np.int32(1)
    differs = length[1:] != length[:-1]
    active = np.flatnonzero(~differs).astype(np.int32)
    a, b, left = ordered[active], ordered[active + 1], length[active]
    step = 0
    while len(active):
        equal = text[a + step] == text[b + step]
        differs[active[~equal]] = True
        step += 1
        equal &= left > step
        active, a, b, left = active[equal], a[equal], b[equal], left[equal]
    names = np.empty(len(lms), np.int32)
    names[place] = np.concatenate(([0], np.cumsum(differs)))
    return names


def sorted_leftmost(text: np.ndarray, lms: np.ndarray, induced: Callable) -> np.ndarray:
    """The leftmost-smaller suffixes in order; ``induced`` gives the array of all from unsorted ones."""
    if not len(lms):
        return lms
    is_lms = np.zeros(len(text), bool)
    is_lms[lms] = True
    rough = induced(lms)
    names = names_of(text, lms, rough[is_lms[rough]])
    del rough, is_lms  # not held while the names are sorted
    return lms[order_of_names(names)]


def side_order(
    text: np.ndarray, wanted: np.ndarray, seeds: np.ndarray,
) -> np.ndarray:
    """All suffixes in order, from sorted ``seeds``, with the ``wanted`` ones induced.

    A wanted suffix is followed by a wanted one that starts with the same or a lesser name, or by a
    seed of a lesser one; in a bucket, wanted suffixes stand before seeds. So a run of one name is
    ordered by its length and then by what follows it. Buckets are taken in batches of ascending
    names: names of few places share one, a frequent name has its own.
    """
    n = len(text)
    found = np.flatnonzero(wanted).astype(np.int32)
    found_names, seed_names = text[found], text[seeds]
    sizes = np.bincount(found_names, minlength=int(text.max()) + 1)
    ends = np.cumsum(sizes, dtype=np.int64)  # among the wanted ones by name
    seed_sizes = np.bincount(seed_names, minlength=len(sizes))
    both = sizes + seed_sizes
    starts = np.cumsum(both) - both  # of buckets among all slots
    # Places among all suffixes; a wanted one's is its bucket's start until it is known. The empty
    # suffix, the least, comes last in the array and is so also at -1.
    place = np.full(n + 1, -1, np.int32)
    place[found] = starts[found_names]
    order = np.argsort(seed_names, kind="stable")
    # In its bucket a seed stands behind the wanted ones and the seeds before it.
    first_seed = starts + sizes - (np.cumsum(seed_sizes) - seed_sizes)
    place[seeds[order]] = first_seed[seed_names[order]] + np.arange(len(seeds))
    # Where a run of wanted suffixes of one name ends, and what follows it.
    goes_on = np.zeros(n, bool)
    goes_on[:-1] = (text[1:] == text[:-1]) & wanted[1:] & wanted[:-1]
    last = np.where(goes_on, np.int32(n), np.arange(n, dtype=np.int32))
    last = np.minimum.accumulate(last[::-1])[::-1]
    run = last[found] - found
    kind = found_names * np.int64(n + 1) + run
    by_name = np.argsort(kind)  # what ties here is told apart by its place
    kind, by_name = kind[by_name], found[by_name]
    differs = kind[1:] != kind[:-1]
    kind = np.zeros(len(found), np.int32)  # ranks of name and run
    np.cumsum(differs, out=kind[1:])

    def settle(low: int, high: int) -> bool:
        """Place the wanted suffixes whose names are in [low, high); False if these should be halved."""
        own = slice(ends[low] - sizes[low], ends[high - 1])
        some = by_name[own]
        after = last[some] + 1
        steps, inside = 1, after[after < n]
        while True:  # chains of descending names inside the batch
            inside = inside[wanted[inside] & (text[inside] >= low)]
            if not len(inside):
                break
            if steps == CHAIN:
                return False
            inside = last[inside] + 1
            inside = inside[inside < n]
            steps += 1
        name = text[some]
        first = starts[name] - (ends - sizes)[name] + own.start
        rank = (kind[own] - kind[own.start:own.start + 1]) * np.int64(n + 1) + 1
        for _ in range(steps):
            key = rank + place[after]
            by = np.argsort(key)
            key = key[by]
            fresh = np.ones(len(some), bool)
            fresh[1:] = key[1:] != key[:-1]
            place[some[by]] = first[by] + np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        return True

    names = np.flatnonzero(sizes)
    at = 0
    while at < len(names):
        before = ends[names[at]] - sizes[names[at]]
        upto = max(at + 1, int(np.searchsorted(ends[names], before + BATCH, side="right")))
        # A stack: a function that calls itself would keep these arrays until the garbage collector comes.
        waiting = [(int(names[at]), int(names[upto - 1]) + 1)]
        while waiting:
            low, high = waiting.pop()
            if not settle(low, high):
                middle = (low + high) // 2
                waiting += [(middle, high), (low, middle)]
        at = upto
    ordered = np.empty(len(found) + len(seeds), np.int32)
    ordered[place[found]] = found
    ordered[place[seeds]] = seeds
    return ordered


def induce_names(text: np.ndarray, smaller: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """As ``induce``, of a string of many different names."""
    order = side_order(text, ~smaller, lms)
    larger = order[~smaller[order]]
    # Smaller suffixes are induced alike, with names and order turned round.
    return side_order(text.max() - text, smaller, larger[::-1])[::-1]


def order_of_names(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names: its own leftmost-smaller substrings, recursively."""
    if names.max() + 1 == len(names):
        return np.argsort(names)  # no two are equal
    smaller = smaller_types(names)
    lms = leftmost(smaller)
    lms = sorted_leftmost(names, lms, lambda unsorted: induce_names(names, smaller, unsorted))
    return induce_names(names, smaller, lms)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of a non-empty uint8 array, in order."""
    lms = leftmost(smaller_types(text))
    counts = np.bincount(text, minlength=256)
    ends = np.cumsum(counts)
    starts = ends - counts
    lms = sorted_leftmost(text, lms, lambda unsorted: induce(text, starts, ends, unsorted))
    return induce(text, starts, ends, lms)


def common_prefixes(text: np.ndarray, sa: np.ndarray, firsts: np.ndarray, cap: int) -> np.ndarray:
    """For each position, the bytes it shares with its predecessor in the array.

    Where both are preceded by the same byte, the value is one less than the one before it, so only
    the others are compared, and those in ``firsts``. Values are exact up to ``cap`` there, and true
    lower bounds beyond it.
    """
    n = len(text)
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    position = np.arange(n, dtype=np.int32)
    fresh = (before <= 0) | (position == 0)
    fresh[1:] |= text[position[1:] - 1] != text[before[1:] - 1]
    fresh[firsts] = True
    places = np.flatnonzero(fresh & (before >= 0)).astype(np.int32)
    padded = np.concatenate([text, np.zeros(16, np.uint8)])
    blocks = np.ndarray((n + 8,), np.dtype("<u8"), padded, strides=(1,))
    value = np.zeros(n, np.int32)
    for at in range(0, len(places), COMPARED):
        i = places[at:at + COMPARED]
        j = before[i]
        shared = np.zeros(len(i), np.int32)
        active = np.arange(len(i))
        for step in range(0, cap, 8):
            a, b = i[active] + step, j[active] + step
            inside = np.maximum(a, b) < n
            active, a, b = active[inside], a[inside], b[inside]
            differ = blocks[a] ^ blocks[b]
            same = differ == 0
            unequal = differ[~same]
            low = unequal & (~unequal + np.uint64(1))
            # Index of the lowest bit that differs, in bytes.
            equal_bytes = (np.frexp(low.astype(np.float64))[1] - 1) // 8
            shared[active[~same]] = step + equal_bytes
            active = active[same]
            shared[active] = step + 8
            if not len(active):
                break
        value[i] = np.minimum(shared, n - np.maximum(i, j))
    del before, places
    fresh_at = np.maximum.accumulate(np.where(fresh, position, np.int32(0)))
    return np.maximum(value[fresh_at] - (position - fresh_at), 0)
