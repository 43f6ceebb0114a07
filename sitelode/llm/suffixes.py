"""Suffix array of many short byte strings by linear grouping.

Suffixes are grouped by their Lyndon prefix, which ends where the next smaller suffix begins; groups are ordered by that prefix. In
a group all suffixes go on with a smaller suffix, which belongs to a lower group (or to the same, one repetition later), so the
groups of what follows give a group's order: references are followed while they agree, and no string is renamed or sorted
again. All steps run over all strings at once, position by position or reference by reference.
"""

from __future__ import annotations

import numpy as np


def words_at(raw: np.ndarray) -> np.ndarray:
    """At every position the 8 bytes from there as one big-endian number; zeros beyond the end."""
    wide = np.zeros(len(raw) + 8, np.uint8)
    wide[:len(raw)] = raw
    found = np.zeros(len(raw), np.uint64)
    for i in range(8):
        found = (found << np.uint64(8)) | wide[i:i + len(raw)]
    return found


class Strings:
    """Byte strings laid end to end, each followed by its end: ``start[i] .. stop[i]``, position ``stop[i]`` being the end."""

    def __init__(self, raw: np.ndarray, lengths: np.ndarray):
        n = int(lengths.sum() + len(lengths))
        self.start = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1].astype(np.int64)
        self.stop = self.start + lengths
        text = np.zeros(n, np.uint8)
        body = np.ones(n, bool)
        body[self.stop] = False
        text[body] = raw
        self.n, self.body = n, body
        self.of = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths + 1)
        self.left = self.stop[self.of] - np.arange(n)  # bytes up to the end
        word = words_at(text)
        short = np.minimum(self.left, 8)
        # Bytes of the following strings do not count.
        self.word = np.where(short > 0, word & ~((np.uint64(1) << (np.uint64(64) - np.uint64(8) * np.maximum(short, 1).astype(np.uint64))) - np.uint64(1)), np.uint64(0))
        self.text = text


def _smaller(s: Strings, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether suffix ``j`` is smaller than suffix ``i`` of the same string, i < j: a suffix that ends first is smaller."""
    out = np.zeros(len(i), bool)
    live, a, b = np.arange(len(i)), i.copy(), j.copy()
    while len(live):
        ended = s.left[b] <= 0
        wa, wb = s.word[a], s.word[b]
        # Zero padding equals a zero byte: where the words agree, what is left decides.
        told = ended | (wa != wb) | (s.left[b] < 8)
        out[live[told]] = np.where(ended | (wa == wb), True, wb < wa)[told]
        live, a, b = live[~told], a[~told] + 8, b[~told] + 8
    return out


def next_smaller(s: Strings) -> np.ndarray:
    """For each position that of the next smaller suffix in its string (its end, if no other). Pointers already found to the right
    are followed until one leads to a smaller suffix."""
    nss = np.arange(s.n, dtype=np.int64)
    lengths = s.stop - s.start
    order = np.argsort(-lengths, kind="stable")
    by_length = lengths[order]
    for back in range(1, int(by_length[0]) + 1 if len(by_length) else 1):
        count = np.searchsorted(-by_length, -back, side="right")
        i = s.stop[order[:count]] - back
        j = i + 1
        live = np.arange(count)
        while len(live):
            end = s.left[j[live]] <= 0
            down = end.copy()
            ask = live[~end]
            down[~end] = _smaller(s, i[ask], j[ask])
            live = live[~down]
            j[live] = nss[j[live]]
        nss[i] = j
    return nss


def groups(s: Strings, nss: np.ndarray) -> np.ndarray:
    """Group of each position: the number of suffixes with a smaller Lyndon prefix. Prefixes are compared 8 bytes at a time; only
    those that agree so far and go on are compared further. Ends come first."""
    length = nss - np.arange(s.n)
    group = np.zeros(s.n, np.int64)
    at, depth = np.arange(s.n), 0
    while len(at):
        rest = length[at] - 8 * depth
        kept = np.clip(rest, 0, 8)
        word = s.word[np.minimum(at + 8 * depth, s.n - 1)]
        shift = (np.uint64(64) - np.uint64(8) * np.maximum(kept, 1).astype(np.uint64))
        word = np.where(kept > 0, word >> shift << shift, np.uint64(0))
        more = np.minimum(rest, 9)
        order = np.argsort(word) if depth == 0 else np.lexsort((word, group[at]))
        # Where the words agree, the shorter prefix is the smaller one.
        run = np.cumsum(changes(word[order], group[at][order]))
        order = order[np.argsort(run * 16 + more[order])]
        g, w, m = group[at][order], word[order], more[order]
        new_g, new = changes(g), changes(g, w, m)
        first_g, first = heads(new_g), heads(new)
        group[at[order]] = g + (first - first_g)
        size = np.diff(np.append(np.nonzero(new)[0], len(at)))
        crowd = np.repeat(size, size) > 1
        at = at[order][crowd & (m == 9)]
        depth += 1
    return group


def changes(*keys: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before in any key; the first does."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return new


def heads(new: np.ndarray) -> np.ndarray:
    """Index of the first row of the run that each row is in."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def suffix_array(s: Strings) -> np.ndarray:
    """Positions of all suffixes in ascending order, ends first; equal suffixes of different strings in any order."""
    nss = next_smaller(s)
    group = groups(s, nss)
    bits = np.uint64(int(s.n).bit_length())
    # Repetitions of the own prefix before the first suffix of a lower group.
    beyond, repeats = nss.copy(), np.zeros(s.n, np.int64)
    live = np.nonzero((group[beyond] == group) & (s.left > 0))[0]
    while len(live):
        repeats[live] += 1
        beyond[live] = nss[beyond[live]]
        live = live[group[beyond[live]] == group[live]]
    # Emission: within a group fewer repetitions come first, then the lower group of what follows; those that still
    # agree follow their references until the groups differ or both end.
    rank = group.copy()
    at = np.nonzero(s.left > 0)[0]
    by, to = at, beyond[at]
    while len(at):
        run = rank[at].astype(np.uint64)
        many = repeats[by].astype(np.uint64)
        wide = np.uint64(max(1, int(many.max()).bit_length()))
        then = group[to].astype(np.uint64)
        if bits + bits + wide <= 64:
            order = np.argsort(((run << wide | many) << bits) | then)
        else:
            order = np.lexsort((then, many, run))
        at, to = at[order], to[order]
        new_run = changes(run[order])
        new = changes(run[order], many[order], then[order])
        first = heads(new)
        rank[at] += first - heads(new_run)
        size = np.diff(np.append(np.nonzero(new)[0], len(at)))
        tied = (np.repeat(size, size) > 1) & (s.left[to] > 0)
        at, by = at[tied], to[tied]
        to = beyond[by]
    # What still agrees is equal up to its end.
    return np.argsort(rank, kind="stable")


def equal_windows(s: Strings, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All positions with ``width`` bytes up to the end, in suffix order, and the number of the run of equal windows each is in."""
    order = suffix_array(s)
    order = order[s.left[order] >= width]
    new = np.zeros(len(order), bool)
    steps = list(range(0, width - 7, 8)) + [max(0, width - 8)]
    for step in steps:
        w = s.word[order + step]
        if width < 8:
            w = w >> np.uint64(64 - 8 * width)
        new[1:] |= w[1:] != w[:-1]
    return order, np.cumsum(new)
