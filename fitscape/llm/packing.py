"""Packing of tokenised documents into windows of one length, by best-fit decreasing."""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitscape.llm import bpe
from fitscape.llm import textkit as kit
from fitscape.llm.shared import small_slices, stored

#: Fixed value: how the tokenizer file cuts lower-cased text; and the line ends that part words here.
_PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+|\n")


class WordTokenizer:
    """Ids of whole texts under a tokenizer that drops white space: a word's ids don't depend on its neighbours, so each distinct word is encoded once a slice."""

    def __init__(self, path: str):
        self.bpe = bpe.load(path)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.bpe.special)) + ")")

    def _pieces(self, distinct: list[bytes]) -> tuple[list[str], np.ndarray]:
        """Pretokens of all words in a row, and the place where each word's begin (and the end)."""
        text = b"\n".join(distinct).decode(errors="replace")
        parts = self.specials.split(text) if any(x in text for x in self.bpe.special) else [text]
        out: list[str] = []
        for part in parts:
            if part in self.bpe.special:
                out.append(part)
            else:  # letter by letter, without the rule for a final sigma
                out += _PRETOKEN.findall((part if part.isascii() else unicodedata.normalize("NFC", part).replace("\u03a3", "\u03c3")).lower())
        cut = np.fromiter((x == "\n" for x in out), bool, len(out))
        ends = np.flatnonzero(cut) - np.arange(cut.sum())
        return [x for x in out if x != "\n"], np.concatenate([[0], ends, [len(out) - cut.sum()]])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the place where each text's begin (and the end)."""
        first, start, end, h = kit.words(texts)
        if not len(h):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        _, index, inverse = np.unique(h, return_index=True, return_inverse=True)
        owner = np.searchsorted(first, index, side="right") - 1
        pieces, begin = self._pieces([texts[d][a:b] for d, a, b in zip(owner.tolist(), start[index].tolist(), end[index].tolist(), strict=True)])
        known: dict[str, int] = {}
        use = np.array([known.setdefault(x, len(known)) for x in pieces], np.int64)
        ids, offsets = self.bpe.encode([b"" if x in self.bpe.special else x.encode() for x in known])
        special = [(known[x], i) for x, i in self.bpe.special.items() if x in known]
        if special:
            ids = np.insert(ids, offsets[[k for k, _ in special]], [i for _, i in special])
            longer = np.zeros(len(offsets), np.int64)
            longer[[k + 1 for k, _ in special]] = 1
            offsets = offsets + np.cumsum(longer)
        per_piece, at = bpe.ragged_take(ids, offsets, use)
        out, at = bpe.ragged_take(per_piece, at[begin], inverse)
        return out, at[first]


class OpenWindows:
    """Open windows by remaining capacity: a segment tree over capacities finds the least one that is large enough."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, capacity: int, n: int) -> None:
        node = self.leaves + capacity
        while node:
            self.count[node] += n
            node >>= 1

    def put(self, window: int, capacity: int) -> None:
        self.windows[capacity].append(window)
        self._add(capacity, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """(window, capacity) of the tightest fit, taken out; None if none is open."""
        node = self.leaves + size
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._add(capacity, -1)
        return self.windows[capacity].pop(), capacity


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each piece (lengths from 1 to capacity): longest first, each into the tightest window."""
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_, n = OpenWindows(capacity), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        got = open_.take(size)
        if got is None:
            got, n = (n, capacity), n + 1
        window[i], offset[i] = got[0], capacity - got[1]
        open_.put(got[0], got[1] - size) if got[1] > size else None
    return window, offset


def token_pieces(docs: DataFrame, *, path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: each document's ids and end_id, cut into full windows and a rest."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(path)
        for batch, texts in small_slices(batches, "_text", 8 << 20):
            ids, at = tokenizer.encode(texts)
            own, start, length, crc, total = [], [], [], [], []
            for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                all_ids = np.append(ids[a:b], end_id).astype("<u4")
                for low in range(0, len(all_ids), capacity):
                    piece = all_ids[low : low + capacity]
                    own.append(i), start.append(low), length.append(len(piece)), crc.append(zlib.crc32(piece.tobytes())), total.append(len(all_ids))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(own, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(cut, f"doc_id {dict(rows.dtypes)['doc_id']}, start long, length long, ids_crc32 long, doc_tokens long")


def pack_pieces(pieces: DataFrame, *, capacity: int = 2048, windows_per_pack: int = 4000) -> DataFrame:
    """Adds sequence_id and offset. Pieces (a stored table) are dealt by their place in it to packs of about windows_per_pack windows, so equal pieces don't meet; each pack is packed by one task, and the ids of its windows follow its number."""
    tokens = pieces.agg(F.sum("length")).first()[0] or 0
    packs = 1 + tokens // (capacity * windows_per_pack)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got).sort_by([("length", "descending"), ("ids_crc32", "ascending"), ("doc_id", "ascending"), ("start", "ascending")])
        window, offset = best_fit_decreasing(table.column("length").to_numpy(), capacity)
        first = TaskContext.get().partitionId() << 32
        yield from table.append_column("sequence_id", pa.array(window + first)).append_column("offset", pa.array(offset)).combine_chunks().to_batches()

    schema = ", ".join(f"{n} {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    return pieces.repartition(int(packs), F.xxhash64(F.monotonically_increasing_id())).mapInArrow(pack, schema)


def pack_documents(docs: DataFrame, *, path: str | None = None, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", windows_per_pack: int = 4000) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its text's ids and end_id. It is cut into full windows of `capacity` ids and a rest; rests go, longest
    first, into the open window with the least room that holds them. A null or empty text is end_id alone; repeated rows
    and null ids are packed like others, and dealt to packs like others; a very long text is many pieces, tokenised at once
    in a slice of its own; of pieces of one length those of lesser ids_crc32, doc_id and start go first; an empty table gives
    none; extra columns are ignored. `path` is a tokenizer file
    (white-space-free BPE, as word_bpe_49k.json, the default).
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    pieces = stored(token_pieces(docs, path=path, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col), "pieces")
    return pack_pieces(pieces, capacity=capacity, windows_per_pack=windows_per_pack)
