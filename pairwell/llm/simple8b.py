"""Simple-8b coding of unsigned ids: word-aligned blocks that NumPy reads at once.

A 64-bit word has a 4-bit selector on top and a payload of equal-width ids
below, the first id lowest. Selector 0 is the escape: the next word is one raw
64-bit id. A document begins at a word of its own, so its last word may hold
fewer ids than its selector allows; the document's count tells how many.
"""

from __future__ import annotations

import numpy as np

#: Fixed: ids per word and bits per id of selectors 1 to 14.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
_WIDTH_OF = np.array([0, *WIDTHS])
_COUNT_OF = np.array([1, *COUNTS])


_TOPS = np.array([(1 << w) - 1 for w in WIDTHS], np.uint64)
#: (ids per word, the widest class they may have, selector), fewest ids first.
_CHOICES = tuple((COUNTS[s - 1], s - 1, s) for s in range(len(COUNTS), 0, -1))


def _reach(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The most ids that a word can take at each position, and its selector; 0 for an escape."""
    n = len(ids)
    need = np.searchsorted(_TOPS, ids).astype(np.uint8)  # the narrowest class that holds each id
    take, selector = np.ones(n, np.uint8), np.zeros(n, np.uint8)
    widest, span = need, 1  # the widest class among the next `span` ids
    for count, width, s in _CHOICES:
        while span < count:
            step = min(span, count - span)
            widest = np.maximum(widest[: n - span - step + 1], widest[step:]) if n >= span + step else widest[:0]
            span += step
        fits = np.flatnonzero(widest <= width)
        if not len(fits):
            break
        take[fits] = count
        selector[fits] = s
    return take, selector


def encode(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of all documents one after another, and the words of each document."""
    ids = np.ascontiguousarray(ids, np.uint64)
    counts = np.asarray(counts, np.int64)
    if not len(ids):
        return np.empty(0, np.uint64), np.zeros(len(counts), np.int64)
    take, selector = _reach(ids)
    steps, starts, n, i = take.tolist(), [], len(ids), 0
    for end in np.cumsum(counts).tolist():  # a word that would run into the next document stays part empty
        while i < end:
            starts.append(i)
            i += steps[i]
        i = end
    starts = np.array(starts)
    doc = np.repeat(np.arange(len(counts)), counts)[starts]
    sel, got = selector[starts].astype(np.int64), np.minimum(take[starts], np.cumsum(counts)[doc] - starts)
    escaped = sel == 0
    place = np.arange(len(starts)) + np.cumsum(escaped) - escaped
    words = np.zeros(len(starts) + int(escaped.sum()), np.uint64)
    for s in np.unique(sel).tolist():
        rows = np.flatnonzero(sel == s)
        if s == 0:
            words[place[rows] + 1] = ids[starts[rows]]
            continue
        value = np.full(len(rows), s << 60, np.uint64)
        for j in range(COUNTS[s - 1]):
            there = got[rows] > j
            if not there.any():
                break
            part = ids[np.minimum(starts[rows] + j, n - 1)] << np.uint64(j * WIDTHS[s - 1])
            value |= np.where(there, part, np.uint64(0))
        words[place[rows]] = value
    return words, np.bincount(doc, weights=1 + escaped, minlength=len(counts)).astype(np.int64)


def decode(words: np.ndarray, word_counts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ids of all documents one after another. counts: ids of each document."""
    words = np.ascontiguousarray(words, np.uint64)
    counts, word_counts = np.asarray(counts, np.int64), np.asarray(word_counts, np.int64)
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    head = np.ones(len(words), bool)
    for i in np.flatnonzero(sel == 0).tolist():  # a raw word follows an escape; its own top bits say nothing
        if head[i] and i + 1 < len(words):
            head[i + 1] = False
    at = np.flatnonzero(head)
    sel = sel[at]
    doc = np.repeat(np.arange(len(counts)), word_counts)[at]
    room = _COUNT_OF[sel]
    before = np.cumsum(room) - room
    first = np.searchsorted(doc, np.arange(len(counts)), "left")
    base = before[np.minimum(first, len(before) - 1)]
    offset = before - base[doc]  # of the word's first id in its document
    got = np.minimum(room, counts[doc] - offset)
    target = (np.cumsum(counts) - counts)[doc] + offset
    out = np.zeros(total, np.uint64)
    for s in np.unique(sel).tolist():
        rows = np.flatnonzero(sel == s)
        if s == 0:
            out[target[rows]] = words[at[rows] + 1]
            continue
        payload, mask = words[at[rows]], np.uint64((1 << WIDTHS[s - 1]) - 1)
        for j in range(COUNTS[s - 1]):
            there = got[rows] > j
            if not there.any():
                break
            out[target[rows[there]] + j] = (payload[there] >> np.uint64(j * WIDTHS[s - 1])) & mask
    return out
