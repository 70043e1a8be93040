"""Byte-pair merges of many pretokens at once, from a tokenizer file's vocabulary and merge list."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

#: Longer pretokens go to the tokenizer library one by one.
LONGEST = 64
_NONE = np.int32(2**31 - 1)
_SIZE_BITS = 20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte: itself if printable, else the next free one from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]


def ragged_take(values: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows `index` of a ragged array, as (values, offsets)."""
    size = (offsets[1:] - offsets[:-1])[index]
    out = np.zeros(len(index) + 1, np.int64)
    np.cumsum(size, out=out[1:])
    return values[np.repeat(offsets[:-1][index] - out[:-1], size) + np.arange(out[-1])], out


class Bpe:
    """`end`: the suffix of a pretoken's last symbol in the vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end, letters = model["vocab"], model.get("end_of_word_suffix") or "", byte_letters()
        self.path = path
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.plain = np.array([vocab.get(c, -1) for c in letters], np.int32)
        self.final = np.array([vocab.get(c + end, -1) for c in letters], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        joined = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.keys, self.at = np.full(1 << _SIZE_BITS, -1, np.int64), np.zeros(1 << _SIZE_BITS, np.int32)
        self.joined = np.append(joined, -1)
        todo, slot = np.arange(len(key)), self._slot(key)
        while len(todo):
            free = todo[self.keys[slot[todo]] == -1]
            won = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[won]], self.at[slot[won]] = key[won], won
            todo = np.setdiff1d(todo, won)
            slot[todo] = (slot[todo] + 1) & ((1 << _SIZE_BITS) - 1)

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * _SPREAD) >> np.uint64(64 - _SIZE_BITS)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) << 20) | b
        key[(a < 0) | (b < 0)] = -2
        slot = self._slot(key)
        there = self.keys[slot]
        out = np.where(there == key, self.at[slot], _NONE)
        open_ = np.flatnonzero((there != key) & (there != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << _SIZE_BITS) - 1)
            there = self.keys[slot[open_]]
            same = there == key[open_]
            out[open_[same]] = self.at[slot[open_[same]]]
            open_ = open_[~same & (there != -1)]
        return out

    def _block(self, ids: np.ndarray) -> np.ndarray:
        """Merge rows of symbols (-1 behind the last) until no pair has a rank: least rank first, leftmost on ties."""
        n, width = ids.shape
        rank = np.full((n, width), _NONE, np.int32)
        rank[:, :-1] = self.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        rows = np.arange(n)
        column = np.arange(width)
        while True:
            at = rank[rows].argmin(axis=1)
            best = rank[rows, at]
            rows, at, best = (x[best < _NONE] for x in (rows, at, best))
            if not len(rows):
                return ids
            moved = np.minimum(column + (column > at[:, None]), width - 1)
            own, r = np.take_along_axis(ids[rows], moved, 1), np.take_along_axis(rank[rows], moved, 1)
            own[:, -1], r[:, -1] = -1, _NONE
            k = np.arange(len(rows))
            own[k, at] = self.joined[best]
            r[k, at] = self.ranks(own[k, at], own[k, np.minimum(at + 1, width - 1)])
            r[k[at == width - 1], -1] = _NONE
            left = k[at > 0]
            r[left, at[left] - 1] = self.ranks(own[left, at[left] - 1], own[left, at[left]])
            ids[rows], rank[rows] = own, r

    def encode(self, pretokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of each pretoken by itself."""
        size = np.fromiter(map(len, pretokens), np.int64, len(pretokens))
        data = np.frombuffer(b"".join(pretokens) + bytes(LONGEST + 1), np.uint8)
        start = np.cumsum(size) - size
        count = np.zeros(len(pretokens), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        low = 0
        for width in (2, 4, 6, 8, 10, 12, 16, 24, 32, LONGEST):
            own_all = np.flatnonzero((size > low) & (size <= width))
            low = width
            for begin in range(0, len(own_all), 1 << 16):
                own = own_all[begin : begin + (1 << 16)]
                place = np.arange(width)
                raw = data[start[own][:, None] + place]
                ids = np.where(place < size[own][:, None] - 1, self.plain[raw], np.where(place == size[own][:, None] - 1, self.final[raw], np.int32(-1)))
                ids = self._block(ids)
                count[own] = (ids >= 0).sum(axis=1)
                found.append((own, ids))
        long = np.flatnonzero(size > LONGEST)
        more = [np.array(library(self.path).encode(pretokens[i].decode(errors="replace"), add_special_tokens=False).ids, np.int32) for i in long]
        count[long] = [len(x) for x in more]
        offsets = np.zeros(len(pretokens) + 1, np.int64)
        np.cumsum(count, out=offsets[1:])
        out = np.zeros(offsets[-1], np.int32)
        for own, ids in found:
            there = ids >= 0
            out[(offsets[own][:, None] + np.arange(ids.shape[1]))[there]] = ids[there]
        for i, ids in zip(long, more, strict=True):
            out[offsets[i] : offsets[i + 1]] = ids
        return out, offsets


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    """Once for each Python worker."""
    return Bpe(path)


@lru_cache(maxsize=4)
def library(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)
