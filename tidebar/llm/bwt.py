"""Burrows-Wheeler transform and common prefixes of a collection of short byte strings, column by column.

Each round prepends one symbol to one more suffix of every string: its place among the suffixes so far follows from
the transform itself (the place of its first symbol there), and the common prefixes with its new neighbours from the
least of those between.  A round reads the transform and the prefixes of the round before from start to end and writes
theirs anew, so only these two columns, of one byte a symbol each, pass from round to round.  A collection is bounded,
so they are held in memory: a task's own disk isn't used, and files in a shared store would be written and read again
in each of some 76 rounds.
"""

from __future__ import annotations

import numpy as np

from tidebar.llm.encoder import ragged


def _least_between(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Minimum of values[begin:end] for each pair; begin < end."""
    if not len(begin):
        return np.empty(0, values.dtype)
    order = np.argsort(begin, kind="stable")
    pairs = np.empty(2 * len(begin), np.int64)
    pairs[::2], pairs[1::2] = begin[order], end[order]
    out = np.empty(len(begin), values.dtype)
    out[order] = np.minimum.reduceat(np.append(values, values.dtype.type(255)), pairs)[::2]
    return out


def _ranks(transform: np.ndarray, order: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Where rows ``place`` stand in ``order``, the rows by symbol: found by search among the rows of their symbol."""
    first = np.concatenate([[0], np.cumsum(np.bincount(transform, minlength=256))])
    symbol = transform[place]
    out = np.empty(len(place), np.int64)
    for c in np.unique(symbol).tolist():
        own = np.flatnonzero(symbol == c)
        out[own] = first[c] + np.searchsorted(order[first[c] : first[c + 1]], place[own])
    return out


def transform_and_prefixes(body: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(transform, prefixes) of strings end to end in ``body``; bytes are below 255, strings shorter than 255.

    Symbols are bytes plus one; 0 ends a string, and ends count as different, in the strings' order.  prefixes[k]
    is the length of what suffixes k - 1 and k share.
    """
    count = len(lengths)
    if not count:
        return np.empty(0, np.uint8), np.empty(0, np.uint8)
    ends = np.cumsum(lengths)
    symbols = body.astype(np.uint8) + np.uint8(1)
    longest = int(lengths.max())
    transform = np.where(lengths > 0, symbols[np.maximum(ends - 1, 0)], 0).astype(np.uint8)
    prefixes = np.zeros(count, np.uint8)
    active, place = np.arange(count), np.arange(count)
    for done in range(1, longest + 1):
        keep = lengths[active] >= done
        active, place = active[keep], place[keep]
        order = np.argsort(transform, kind="stable")
        rank = _ranks(transform, order, place)
        # suffixes that are only an end come first; rows whose symbol is an end lead to none
        new = rank + count - int(np.count_nonzero(transform == 0))
        symbol = transform[place]
        before, after = order[np.maximum(rank - 1, 0)], order[np.minimum(rank + 1, len(order) - 1)]
        has_before = (rank > 0) & (transform[before] == symbol)
        has_after = (rank + 1 < len(order)) & (transform[after] == symbol)
        shared = np.zeros(len(active), np.uint8)
        shared[has_before] = 1 + _least_between(prefixes, before[has_before] + 1, place[has_before] + 1)
        shared_next = 1 + _least_between(prefixes, place[has_after] + 1, after[has_after] + 1)
        preceding = np.zeros(len(active), np.uint8)
        more = lengths[active] > done
        preceding[more] = symbols[ends[active[more]] - 1 - done]
        old = np.ones(len(transform) + len(active), bool)
        old[new] = False
        grown, common = np.empty(len(old), np.uint8), np.empty(len(old), np.uint8)
        grown[old], common[old] = transform, prefixes
        grown[new] = preceding
        # first what follows the new rows, then the new rows themselves, which may follow each other
        common[new[has_after] + 1] = shared_next
        common[new] = shared
        transform, prefixes, place = grown, common, new
    return transform, prefixes


def suffix_rows(transform: np.ndarray, lengths: np.ndarray, starts: np.ndarray, string: np.ndarray) -> np.ndarray:
    """Rows of the suffixes of ``string`` from ``starts`` on, found by walking all strings from their ends."""
    count = len(lengths)
    order = np.argsort(transform, kind="stable")
    to = np.empty(len(transform), np.int64)
    to[order] = np.arange(len(transform)) + (count - int(np.count_nonzero(transform == 0)))
    wanted = lengths[string] - starts
    begin = np.concatenate([[0], np.cumsum(lengths + 1)])
    rows = np.empty(int(begin[-1]), np.int64)  # of each string's suffixes, the shortest first
    now, active = np.arange(count), np.arange(count)
    rows[begin[:-1]] = now
    for done in range(1, int(lengths.max(initial=0)) + 1):
        keep = lengths[active] >= done
        active, now = active[keep], to[now[keep]]
        rows[begin[active] + done] = now
    return rows[begin[string] + wanted]


def _window_hashes(body: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Rolling hashes of the windows at ``starts``; equal windows have equal ones."""
    n = len(body)
    powers = np.full(n + 1, 0x9E3779B97F4A7C15, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((body.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=sums[1:])
    return (sums[starts + width] - sums[starts]) * powers[n - starts]


def _shared_windows(body: np.ndarray, lengths: np.ndarray, owner: np.ndarray, width: int) -> np.ndarray:
    """For every window, end to end: strings of different owners have its hash."""
    windows = np.maximum(lengths - width + 1, 0)
    starts = ragged(np.cumsum(lengths) - lengths, windows)
    own = np.repeat(owner, windows)
    h = _window_hashes(body, starts, width)
    order = np.argsort(h)
    ordered, own = h[order], own[order]
    begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    differ = np.minimum.reduceat(own, begin) != np.maximum.reduceat(own, begin)
    out = np.empty(len(h), bool)
    out[order] = np.repeat(differ, np.diff(np.append(begin, len(h))))
    return out


def least_owner(body: np.ndarray, lengths: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For every string's substrings of ``width`` in order, end to end: the least owner of a string that has it.

    Also how many each string has.  A substring whose hash only strings of one owner have is that owner's; strings
    are cut down to what lies between their first and last other ones, and only these parts enter the collection.
    Suffixes that share ``width`` symbols or more are neighbours in the transform.
    """
    windows = np.maximum(lengths - width + 1, 0)
    found = np.repeat(owner, windows)
    if not len(found):
        return found, windows
    string = np.repeat(np.arange(len(lengths)), windows)
    shared = np.flatnonzero(_shared_windows(body, lengths, owner, width))
    if not len(shared):
        return found, windows
    of = string[shared]
    parts, first = np.unique(of, return_index=True)
    last = shared[np.append(first[1:], len(shared)) - 1]
    first = shared[first]
    start = (np.cumsum(lengths) - lengths - (np.cumsum(windows) - windows))[parts] + first  # in body
    size = last - first + width
    part_windows = last - first + 1
    transform, prefixes = transform_and_prefixes(body[ragged(start, size)], size)
    part = np.repeat(np.arange(len(parts)), part_windows)
    rows = suffix_rows(transform, size, ragged(np.zeros(len(parts), np.int64), part_windows), part)
    run = np.cumsum(prefixes < width)[rows]
    order = np.argsort(run, kind="stable")
    sorted_run = run[order]
    begin = np.flatnonzero(np.concatenate([[True], sorted_run[1:] != sorted_run[:-1]]))
    least = np.minimum.reduceat(owner[parts][part][order], begin)
    answer = np.empty(len(part), np.int64)
    answer[order] = np.repeat(least, np.diff(np.append(begin, len(order))))
    found[ragged(first, part_windows)] = answer
    return found, windows
