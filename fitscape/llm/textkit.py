"""Words of many texts at once, as NumPy arrays: positions and 64-bit hashes.

Words are runs of bytes of one class; multi-byte UTF-8 characters consist of bytes >= 0x80 only, so a byte class
that holds all of these gives the same words as the pattern on code points. A word's hash sums a random value for each
byte and its place; a sequence's hash mixes those of its parts. No pair of texts collides by its form, so equal hashes
count as equal words (or word sequences) with an error of about 2**-64 a pair.
"""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of `[^\x20\x09-\x0D]`.
BLANK_WORDS = ~_SPACE
#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` after A-Z are lower-cased.
ALNUM_WORDS = np.array([chr(b).isalnum() or b >= 0x80 for b in range(256)])
ALNUM_WORDS[0x80:] = True

#: Bytes from A to Z as a to z, all others as they are.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Values of each byte at the first PLACES places of a word; behind these they are mixed from place and byte.
PLACES = 32
_RANDOM = np.random.default_rng(20240607).integers(0, 2**64, PLACES << 8, dtype=np.uint64)
_SPREAD, _LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
PIECE = 1 << 18


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _by_place(symbols: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of each sequence; symbols has the sequences (below 2**32, none empty) one behind the other."""
    if not len(size):
        return np.zeros(0, np.uint64)
    first = np.cumsum(size) - size
    place = np.arange(len(symbols)) - np.repeat(first, size)
    if symbols.dtype == np.uint8:
        values = _RANDOM[(np.minimum(place, PLACES - 1) << 8) | symbols]
        far = np.flatnonzero(place >= PLACES)
    else:
        values, far = np.empty(len(symbols), np.uint64), np.arange(len(symbols))
    if len(far):
        values[far] = mix((place[far].astype(np.uint64) << np.uint64(32) | symbols[far].astype(np.uint64)) * _SPREAD + _LEFT)
    return mix(np.add.reduceat(values, first) + size.astype(np.uint64) * _SPREAD)


def _piece_words(raw: bytes, inside: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(raw, np.uint8)
    flags = np.zeros(len(data) + 2, np.int8)
    flags[1:-1] = inside[data]
    edge = np.flatnonzero(flags[1:] != flags[:-1])
    start, end = edge[::2], edge[1::2]
    letters = data[flags[1:-1].view(bool)]
    return start, end, _by_place(_LOWER[letters] if lower else letters, end - start)


def words(texts: list[bytes], inside: np.ndarray = BLANK_WORDS, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, start, end, hash) of the words of all texts: text i has words first[i]:first[i+1]; start and end are byte positions in it.

    Works in pieces of about PIECE bytes, cut between words (a single longer word makes a longer piece).
    """
    counts = np.zeros(len(texts) + 1, np.int64)
    starts, ends, hashes = [], [], []
    at = 0
    while at < len(texts):
        if len(texts[at]) > PIECE:
            text, low = texts[at], 0
            while low < len(text):
                high = min(len(text), low + PIECE)
                while high < len(text) and inside[text[high]]:
                    high += 1
                s, e, h = _piece_words(text[low:high], inside, lower)
                starts.append(s + low), ends.append(e + low), hashes.append(h)
                counts[at + 1] += len(s)
                low = high
            at += 1
            continue
        stop, size = at, 0
        while stop < len(texts) and len(texts[stop]) <= PIECE and (stop == at or size + len(texts[stop]) < PIECE):
            size += len(texts[stop]) + 1
            stop += 1
        raw = b" ".join(texts[at:stop])
        s, e, h = _piece_words(raw, inside, lower)
        base = np.zeros(stop - at + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts[at:stop]], out=base[1:])
        first = np.searchsorted(s, base)
        n = np.diff(first)
        shift = np.repeat(base[:-1], n)
        counts[at + 1 : stop + 1] = n
        starts.append(s - shift), ends.append(e - shift), hashes.append(h)
        at = stop
    cat = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
    return np.cumsum(counts), cat(starts, np.int64), cat(ends, np.int64), cat(hashes, np.uint64)


def ngrams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` word hashes; len(hashes) - size + 1 of them (none if fewer)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for low in range(0, n, PIECE):  # bounded temporaries
        high = min(n, low + PIECE)
        out[low:high] = _runs(hashes[low : high + size - 1], size)
    return out


def _runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """By doubling: a run's hash is mixed from those of its two parts, whose lengths are the same for all runs."""
    power, run, done = 1, None, 0
    while True:
        if size & power:
            run = hashes if run is None else mix(run[: len(hashes) - done] * _LEFT + hashes[done:] * _RIGHT)
            done += power
        if done == size:
            return mix(run[: len(run)] + np.uint64(size * int(_SPREAD) & (2**64 - 1)))
        hashes = mix(hashes[:-power] * _LEFT + hashes[power:] * _RIGHT)
        power *= 2


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    padded = np.zeros(len(flags) + 2, np.int8)
    padded[1:-1] = flags
    edge = np.flatnonzero(padded[1:] != padded[:-1])
    return edge[::2], edge[1::2]


def covered(starts: np.ndarray, length: int, size: int) -> np.ndarray:
    """Flags of the `length` positions inside any run of `size` that begins at one of the starts."""
    change = np.zeros(length + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(np.asarray(starts) + size, length), -1)
    return np.cumsum(change[:-1]) > 0


def sequence_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] (below 2**32) for each pair; pairs ascend and don't overlap, and are taken in pieces so that temporaries stay small."""
    out = np.empty(len(start), np.uint64)
    low = 0
    while low < len(start):
        high = max(low + 1, int(np.searchsorted(end, start[low] + PIECE)))
        size = end[low:high] - start[low:high]
        at = np.repeat(start[low:high] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        out[low:high] = _by_place(values[at], size)
        low = high
    return out
