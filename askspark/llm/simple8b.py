"""Simple-8b words: four bits of a 64-bit word select how many ids of how many bits fill the other sixty.

Two additions. An id too large for its place is an escape: the place holds all ones and the id goes to a list beside the
words, so that one rare id does not widen its neighbours. And a word never crosses a block of ``BLOCK`` ids, so the first
word and the first escape of each block tell where its decoding starts, and any number of blocks decode in one go.
"""

from __future__ import annotations

import numpy as np

#: Ids in a word and bits of each, by selector.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
BLOCK = 1024
ESCAPE_BITS = 32


def _walk(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and their selectors: always the one with the fewest bits an id, escapes included. All blocks walk
    together, one word at a step."""
    n = len(ids)
    large = np.zeros((len(COUNTS), n + 1), np.int32)
    for s, width in enumerate(WIDTHS.tolist()):
        np.cumsum(ids > 0 if width == 0 else ids >= (1 << width) - 1, out=large[s, 1:], dtype=np.int32)
    flat, row = large.ravel(), np.arange(len(COUNTS))[:, None] * (n + 1)
    zeros = WIDTHS == 0
    at = np.arange(0, n, BLOCK)
    end = np.minimum(at + BLOCK, n)
    starts, kinds = [], []
    while len(at):
        stop = np.minimum(at + COUNTS[:, None], end)
        escapes = flat[stop + row] - flat[at + row]
        cost = (64 + ESCAPE_BITS * escapes) / (stop - at)
        cost[zeros] += 1000 * escapes[zeros]
        kind = cost.argmin(axis=0)
        starts.append(at)
        kinds.append(kind)
        at = stop[kind, np.arange(len(at))]
        going = at < end
        at, end = at[going], end[going]
    starts, kinds = np.concatenate(starts), np.concatenate(kinds)
    order = np.argsort(starts)
    return starts[order], kinds[order]


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, escapes, first word of each block, first escape of each block) of ids below 2**32."""
    n = len(ids)
    ids = np.asarray(ids, np.uint32)
    if not n:
        none = np.zeros(0, np.uint32)
        return np.zeros(0, np.uint64), none, none, none
    starts, kind = _walk(ids)
    end = np.minimum((starts // BLOCK + 1) * BLOCK, n)
    words = kind.astype(np.uint64) << np.uint64(60)
    escaped = np.zeros(n, bool)
    padded = np.concatenate((ids, np.zeros(int(COUNTS.max()), np.uint32))).astype(np.uint64)
    for s in np.unique(kind):
        count, width = int(COUNTS[s]), int(WIDTHS[s])
        if width == 0:
            continue
        which = np.flatnonzero(kind == s)
        place = starts[which][:, None] + np.arange(count)
        values = np.where(place < end[which][:, None], padded[place], np.uint64(0))
        if width < 60:
            mask = np.uint64((1 << width) - 1)
            out = values >= mask
            escaped[place[out]] = True
            values = np.where(out, mask, values)
        shifts = (np.arange(count) * width).astype(np.uint64)
        words[which] |= np.bitwise_or.reduce(values << shifts, axis=1)
    first = np.arange(0, n, BLOCK)
    word_at = np.searchsorted(starts, first).astype(np.uint32)
    escape_at = np.concatenate(([0], np.cumsum(escaped)))[first].astype(np.uint32)
    return words, ids[escaped], word_at, escape_at


def unpack(words: np.ndarray, escapes: np.ndarray, word_at: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of whole blocks, whose words begin at ``word_at``."""
    if not n:
        return np.zeros(0, np.uint32)
    kind = (words >> np.uint64(60)).astype(np.int64)
    count = COUNTS[kind]
    before = np.concatenate(([0], np.cumsum(count)))
    block = np.searchsorted(word_at, np.arange(len(words)), side="right") - 1
    start = before[:-1] - before[word_at[block]] + block * BLOCK
    end = np.minimum((block + 1) * BLOCK, n)
    out, escaped = np.zeros(n, np.uint32), np.zeros(n, bool)
    for s in np.unique(kind):
        width = int(WIDTHS[s])
        if width == 0:
            continue
        which = np.flatnonzero(kind == s)
        steps = np.arange(int(COUNTS[s]))
        mask = np.uint64((1 << width) - 1)
        values = (words[which][:, None] >> (steps * width).astype(np.uint64)) & mask
        place = start[which][:, None] + steps
        inside = place < end[which][:, None]
        out[place[inside]] = values[inside].astype(np.uint32)
        if width < 60:
            escaped[place[inside & (values == mask)]] = True
    out[escaped] = escapes
    return out


def unpack_block(words: np.ndarray, escapes: np.ndarray, word_at: np.ndarray, escape_at: np.ndarray, n: int, k: int) -> np.ndarray:
    """The ids of block ``k`` alone."""
    last = k + 1 == len(word_at)
    some = words[word_at[k] : None if last else word_at[k + 1]]
    large = escapes[escape_at[k] : None if last else escape_at[k + 1]]
    return unpack(some, large, np.zeros(1, np.uint32), min(BLOCK, n - k * BLOCK))
