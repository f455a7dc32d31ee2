"""Suffix arrays by induced sorting, and permuted common prefixes.

Suffixes are S-type (smaller than the next one) or L-type. Leftmost S-type ones (LMS) begin the LMS substrings; these are
sorted (by inducing; over many letters, letter by letter), named, and the string of names is sorted recursively; its order induces that of all suffixes. A level
has at most half the letters of the one before, and each is sorted in linear time.

Inducing scans the buckets of first letters from the least to the greatest and back. Over few letters a bucket is handled as
one array: all its suffixes are known before the next one's. Over many letters, as names are, buckets are tiny, and the
scan goes suffix by suffix over counted bucket starts instead. Both give the same order.
"""

from __future__ import annotations

import numpy as np

#: Suffixes a letter on average from which buckets are handled as arrays.
DENSE = 64


def s_types(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is S-type; the last one (followed by the empty suffix) is L-type."""
    ends = np.append(np.flatnonzero(s[1:] != s[:-1]), len(s) - 1)  # of runs of equal letters
    rising = np.append(s[ends[:-1]] < s[ends[:-1] + 1], False)
    return np.repeat(rising, np.diff(np.append(-1, ends)))


def dealt(places: np.ndarray, letters: np.ndarray, into: list[list[np.ndarray]]) -> None:
    """Appends places to the lists of their letters, in order."""
    if not len(places):
        return
    order = np.argsort(letters, kind="stable")
    ranked, places = letters[order], places[order]
    cuts = np.flatnonzero(ranked[1:] != ranked[:-1]) + 1
    starts = [0, *cuts.tolist()]
    for a, b in zip(starts, [*starts[1:], len(places)]):
        into[ranked[a]].append(places[a:b])


def joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def induce_buckets(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """induce(), a bucket at a time."""
    seeds: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    dealt(lms, s[lms], seeds)
    large: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    large[int(s[-1])].append(np.array([len(s) - 1]))  # led by the empty suffix
    for c in range(sigma):
        now, done = joined(large[c]), []
        while len(now):
            done.append(now)
            before = now[now > 0] - 1
            before = before[~is_s[before]]
            letters = s[before]
            dealt(before[letters > c], letters[letters > c], large)
            now = before[letters == c]
        large[c] = done
        seed = joined(seeds[c])
        before = seed[seed > 0] - 1
        dealt(before, s[before], large)
    small: list[list[np.ndarray]] = [[] for _ in range(sigma)]  # each from its greatest suffix down
    for c in range(sigma - 1, -1, -1):
        now, done = joined(small[c]), []
        while len(now):
            done.append(now)
            before = now[now > 0] - 1
            before = before[is_s[before]]
            letters = s[before]
            dealt(before[letters < c], letters[letters < c], small)
            now = before[letters == c]
        small[c] = done
        down = joined(large[c])[::-1]
        before = down[down > 0] - 1
        before = before[is_s[before]]
        dealt(before, s[before], small)
    return joined([part for c in range(sigma) for part in (joined(large[c]), joined(small[c])[::-1])])


def induce_one_by_one(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """induce(), a suffix at a time."""
    n = len(s)
    ends = np.cumsum(np.bincount(s, minlength=sigma))
    starts = ends - np.bincount(s, minlength=sigma)
    # the letter that a suffix is preceded by, if that one is to be induced in this scan; place -1 stands for none
    before = np.append(-1, s[:-1])
    is_s_before = np.append(False, is_s[:-1])
    to_large = np.append(np.where(is_s_before, -1, before), -1).tolist()
    to_small = np.append(np.where(is_s_before, before, -1), -1).tolist()
    found = np.full(n, -1)
    order = np.argsort(s[lms], kind="stable")
    letters = s[lms][order]
    sizes = np.bincount(letters, minlength=sigma)
    found[(ends - sizes)[letters] + np.arange(len(lms)) - (np.cumsum(sizes) - sizes)[letters]] = lms[order]
    sa, head, tail = found.tolist(), starts.tolist(), (ends - 1).tolist()
    last = int(s[-1])
    sa[head[last]] = n - 1  # led by the empty suffix
    head[last] += 1
    for place in sa:  # grows ahead of the scan
        letter = to_large[place]
        if letter >= 0:
            sa[head[letter]] = place - 1
            head[letter] += 1
    for place in reversed(sa):
        letter = to_small[place]
        if letter >= 0:
            sa[tail[letter]] = place - 1
            tail[letter] -= 1
    return np.array(sa)


def induce(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """All suffixes, sorted as far as the order of lms (in which those of one letter are taken) decides."""
    return (induce_buckets if len(s) >= DENSE * sigma else induce_one_by_one)(s, is_s, lms, sigma)


def ranked_substrings(s: np.ndarray, lms: np.ndarray, size: np.ndarray, sigma: int) -> np.ndarray:
    """lms in the order of the LMS substrings (of `size` letters each), letter by letter among those that are still tied.

    One that ends comes after others with the same letters, which go on to smaller suffixes; the last one, before them.
    """
    order = np.argsort(s[lms], kind="stable")
    past = np.full(len(lms), sigma)
    past[-1] = -1
    first = s[lms][order]
    heads = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
    group = np.repeat(heads, np.diff(np.append(heads, len(lms))))  # the first place in order of those that are tied
    live, k = np.arange(len(lms)), 1
    while len(live):
        tied = np.append(False, group[live[1:]] == group[live[:-1]])
        live = live[tied | np.append(tied[1:], False)]
        if not len(live):
            break
        who, of = order[live], group[live]
        letter = np.where(size[who] > k, s[np.minimum(lms[who] + k, len(s) - 1)], past[who]).astype(np.int64)
        by = np.argsort(of * (sigma + 2) + letter + 1, kind="stable")
        order[live], letter = who[by], letter[by]
        heads = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (letter[1:] != letter[:-1])))
        group[live] = np.repeat(live[heads], np.diff(np.append(heads, len(live))))
        live, k = live[(letter >= 0) & (letter < sigma)], k + 1
    return lms[order]


def named(s: np.ndarray, ranked: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Numbers of the LMS substrings of ranked (starts, in their order), from 0; equal ones have one number."""
    differ = np.ones(len(ranked), bool)
    a, b = ranked[:-1], ranked[1:]
    same = size[:-1] == size[1:]
    live, k = np.flatnonzero(same), 0
    while len(live):
        live = live[s[a[live] + k] == s[b[live] + k]]
        k += 1
        full = size[:-1][live] == k
        differ[1:][live[full]] = False
        live = live[~full]
    return np.cumsum(differ) - 1


def suffix_array(s: np.ndarray, sigma: int) -> np.ndarray:
    """Starts of all suffixes of s (letters under sigma), in order."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    is_s = s_types(s)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    if len(lms) > 1:
        size = np.zeros(n, np.int64)
        size[lms] = np.append(np.diff(lms) + 1, n - lms[-1])  # with the next one's first letter
        if n >= DENSE * sigma:
            ranked = induce(s, is_s, lms, sigma)
            flag = np.zeros(n, bool)
            flag[lms] = True
            ranked = ranked[flag[ranked]]
        else:  # short substrings: sorted faster as arrays than by a scan
            ranked = ranked_substrings(s, lms, size[lms], sigma)
        number = np.empty(n, np.int64)
        number[ranked] = named(s, ranked, size[ranked])
        names = number[lms]
        kinds = int(names.max()) + 1
        lms = ranked if kinds == len(lms) else lms[suffix_array(names, kinds)]
    return induce(s, is_s, lms, sigma)


def permuted_prefixes(data: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """By place in data: how many letters its suffix has in common with the one before it in sa, `most` at most.

    data has at least `most` + 8 bytes after the last place of sa. Eight bytes are compared at a time.
    """
    before = np.full(int(sa.max()) + 1 if len(sa) else 0, -1)
    before[sa[1:]] = sa[:-1]
    places = np.sort(sa[1:])
    eight = np.ndarray(len(data) - 7, "<u8", data.tobytes(), strides=(1,))
    common = np.zeros(len(before), np.int64)
    live = places
    for k in range(0, most, 8):
        x = eight[live + k] ^ eight[before[live] + k]
        equal = x == 0
        low = x[~equal]
        at = live[~equal]
        first = np.zeros(len(low), np.int64)
        for bits in (32, 16, 8):
            none = (low & np.uint64((1 << bits) - 1)) == 0
            first += np.where(none, bits // 8, 0)
            low = np.where(none, low >> np.uint64(bits), low)
        common[at] = k + first
        live = live[equal]
    common[live] = most
    return np.minimum(common, most)
