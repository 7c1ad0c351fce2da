"""Corpus order of windows by prefix-free parsing, over one block of fragments.

Rolling-hash triggers cut the fragments into phrases that overlap by one trigger. The distinct phrases form the
dictionary; its suffixes and the suffixes of the parse (the phrases in rank order) are ranked by prefix doubling. A
window's place in corpus order is (rank of its phrase's suffix, rank of the parse from the next phrase on): phrase
suffixes longer than a trigger are prefix-free, so the pair decides. Equal windows are neighbours in this order.

Arrays of a block take some 250 times its bytes, so fragments come in blocks of bounded size (in_blocks).
"""

from __future__ import annotations

import numpy as np

from clausewise.llm.common import SLICE_BYTES, Prefixes, mix
from clausewise.llm.triggers import LENGTH, SPAN

TRIGGER = 8
RATE = np.uint64(16)
#: Bytes of fragments that are ordered at once, about.
BLOCK = 1 << 18


def _doubled(rank: np.ndarray, left: np.ndarray, depth: int, most: int) -> np.ndarray:
    """Ranks of sequences from their ranks over `depth` items; left: items until each one's sequence ends."""
    place = np.arange(len(rank))
    while depth < most:
        after = np.where(left > depth, rank[np.minimum(place + depth, len(rank) - 1)] + 1, 0)
        _, rank = np.unique(rank.astype(np.uint64) << np.uint64(32) | after.astype(np.uint64), return_inverse=True)
        depth *= 2
    return rank


def repeated(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each fragment's windows (all places from which LENGTH bytes remain), end to end: whether an equal one exists."""
    prefix = Prefixes(data)
    n = len(data)
    grams = np.arange(max(n - TRIGGER + 1, 0))
    row_end = np.repeat(offsets[1:], np.diff(offsets))
    is_trigger = np.zeros(n + 1, bool)
    is_trigger[: len(grams)] = prefix.hash(grams, grams + TRIGGER) % RATE == 0
    is_trigger[:n] &= np.arange(n) + TRIGGER <= row_end
    head = is_trigger.copy()
    head[offsets[:-1]] = True
    begin = np.flatnonzero(head[:n])
    row = np.searchsorted(offsets, begin, "right") - 1
    nxt = np.r_[begin[1:], n]
    last = np.r_[row[1:] != row[:-1], True]
    end = np.where(last, offsets[row + 1], nxt + TRIGGER)
    # dictionary: each distinct phrase once; what ends a fragment counts as another phrase than what a trigger ends
    _, one, phrase = np.unique(prefix.hash(begin, end), return_index=True, return_inverse=True)
    size = (end - begin)[one]
    start = np.r_[0, np.cumsum(size)]
    letter = np.repeat(begin[one] - start[:-1], size) + np.arange(start[-1])
    left = np.repeat(start[1:], size) - np.arange(start[-1])
    code = np.zeros(len(letter), np.uint64)
    for k in range(7):
        here = np.where(left > k, data[np.minimum(letter + k, n - 1)].astype(np.uint64) + np.uint64(1), np.uint64(0))
        code = code << np.uint64(9) | here
    _, rank = np.unique(code, return_inverse=True)
    rank = _doubled(rank, left, 7, int(size.max()))
    # parse: ranks of the phrases, then of their sequences to the end of each fragment
    each = np.bincount(row, minlength=len(offsets) - 1)
    to_go = np.repeat(np.cumsum(each), each) - np.arange(len(row))
    parse = _doubled(np.unique(rank[start[phrase]], return_inverse=True)[1], to_go, 1, min(int(each.max()), LENGTH))
    # windows in corpus order
    count = np.maximum(np.diff(offsets) - LENGTH + 1, 0)
    at = np.arange(count.sum()) - np.repeat(np.r_[0, np.cumsum(count)][:-1] - offsets[:-1], count)
    own = np.searchsorted(begin, at, "right") - 1
    then = np.where(to_go[own] > 1, parse[np.minimum(own + 1, len(parse) - 1)] + 1, 0)
    order = np.argsort(rank[start[phrase[own]] + at - begin[own]].astype(np.uint64) << np.uint64(32) | then.astype(np.uint64))
    content = prefix.hash(at, at + LENGTH)[order]
    same = content[1:] == content[:-1]  # neighbours with LENGTH bytes or more in common
    found = np.zeros(len(at), bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    return found


def _hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each range, ranges in order of their begins, by prefix sums of a few of them at a time."""
    out = np.empty(len(begin), np.uint64)
    i = 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(begin, begin[i] + SLICE_BYTES)))
        out[i:j] = Prefixes(data[begin[i] : end[i:j].max()]).hash(begin[i:j] - begin[i], end[i:j] - begin[i])
        i = j
    return out


def in_blocks(data: np.ndarray, offsets: np.ndarray, key: np.ndarray, lead: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """repeated() of fragments whose equal windows have equal keys, block by block.

    lead: where each fragment's trigger lies that is the first one of all its windows. Equal windows have it at equal
    places. So a group of more than `block` bytes is halved by that place, and each half is grouped anew by the bytes
    that all windows of such places share, until groups are small or consist of one and the same window.
    """
    if len(data) <= 2 * block:
        return repeated(data, offsets)
    count = np.diff(offsets) - LENGTH + 1
    window = np.r_[0, np.cumsum(count)]
    found = np.zeros(window[-1], bool)
    # a part: those windows of a fragment that have the trigger at `low` to `low + width - 1`
    part, low, group, width = np.arange(len(count)), np.zeros(len(count), np.int64), key.view(np.uint64), SPAN
    while True:
        begin = np.maximum(lead[part] - low - width + 1, 0)
        end = np.minimum(lead[part] - low + 1, count[part])
        order = np.argsort(group, kind="stable")
        part, low, group, begin, end = part[order], low[order], group[order], begin[order], end[order]
        size = end - begin + LENGTH - 1
        head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        members = np.diff(np.r_[head, len(group)])
        total = np.add.reduceat(size, head)
        if width == 1:  # a group is one window
            found[(window[part] + begin)[np.repeat(members > 1, members)]] = True
            return found
        small = np.flatnonzero(np.repeat((members > 1) & (total <= block), members))
        whole = np.where((members > 1) & (total <= block), total, 0)
        number = np.repeat((np.cumsum(whole) - whole) // block, members)[small]
        for own in np.split(small, np.flatnonzero(np.diff(number)) + 1):
            if not len(own):
                continue
            ends = np.r_[0, np.cumsum(size[own])]
            at = np.arange(ends[-1]) + np.repeat(offsets[part[own]] + begin[own] - ends[:-1], size[own])
            n = end[own] - begin[own]
            place = np.arange(n.sum()) + np.repeat(window[part[own]] + begin[own] - (np.cumsum(n) - n), n)
            found[place[repeated(data[at], ends)]] = True
        large = np.flatnonzero(np.repeat((members > 1) & (total > block), members))
        if not len(large):
            return found
        width //= 2
        part, low, group = np.repeat(part[large], 2), np.repeat(low[large], 2), np.repeat(group[large], 2)
        low[1::2] += width
        held = (lead[part] >= low) & (lead[part] - count[part] + 1 < low + width)
        part, low, group = part[held], low[held], group[held]
        trigger = offsets[part] + lead[part]
        order = np.argsort(trigger - low)
        part, low, group, trigger = part[order], low[order], group[order], trigger[order]
        group = mix(_hashes(data, trigger - low, trigger - low - width + 1 + LENGTH) ^ mix(group + low.astype(np.uint64)))
