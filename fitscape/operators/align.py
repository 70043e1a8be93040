"""Global alignment of many sequences with one reference: affine gaps, rows of a batch in step."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MATCH, MISMATCH, OPEN, EXTEND = 1.0, -1.0, -2.0, -0.5


def _kept(n: int) -> int:
    """Rows between those that are kept: a kept one takes 16 bytes a column at most, and one of the way back takes one. Up to 1,024 letters are one stretch, whose way back is known at once."""
    return max(1024, int(4 * n**0.5))


def align_pairs(sequences: list[str], reference: str) -> list[list[int]]:
    """For each sequence, the reference position of each letter, or -1; end gaps cost like others."""
    data, size = codes(sequences)
    place = aligncodes(data, size, np.array([ord(x) for x in reference], np.uint32))
    return [row[:n].tolist() for row, n in zip(place, size.tolist(), strict=True)]


def codes(sequences: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row of code points for each sequence, filled up by 0, and the lengths."""
    size = np.array([len(x) for x in sequences], np.int64)
    data = np.zeros((len(sequences), max(1, int(size.max(initial=0)))), np.uint32)
    data[np.arange(data.shape[1]) < size[:, None]] = np.frombuffer("".join(sequences).encode("utf-32-le", "surrogatepass"), np.uint32)
    return data, size


def aligncodes(data: np.ndarray, size: np.ndarray, ref: np.ndarray) -> np.ndarray:
    """The reference position of each letter of data's rows (the first `size` of each), or -1.

    All sequences advance by one letter at a time; columns of the recurrence that depend on their left neighbour are
    solved by a running maximum. On ties the diagonal comes first, then a gap in the reference. Only every so many rows
    are kept; on the way back the rows behind a kept one are computed again, so memory grows with the root of the length.
    Scores are counted in halves, so that they are integers.
    """
    k, m, n = len(data), len(ref), int(size.max(initial=0))
    place = np.full(data.shape, -1, np.int32)
    if not k or not n:
        return place
    match, mismatch, open_, extend = (int(2 * x) for x in (MATCH, MISMATCH, OPEN, EXTEND))
    # the greatest sum of a path is within these bounds, so short ones fit small integers
    kind = np.int16 if 8 * (n + m + 8) < 30_000 else np.int32 if 8 * (n + m + 8) < 2_000_000_000 else np.int64
    low = kind(-(4 * (n + m + 8)))
    # places of the letters among the reference's, which all others follow; columns of the recurrence are rows here, so that neighbours are whole rows
    letters, of = np.unique(ref, return_inverse=True)
    found = np.searchsorted(letters, data)
    known = np.take(letters, found, mode="clip") == data if m else np.zeros(data.shape, bool)
    letter = np.ascontiguousarray(np.where(known, found, len(letters)).T)
    each = np.arange(len(letters))[:, None]
    cols = (np.arange(m + 1, dtype=kind) * kind(extend))[:, None]
    ahead = cols[1:] + kind(open_ - extend)

    def advance(best: np.ndarray, up: np.ndarray, first: int, last: int, back: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """best (score of each prefix pair) and up (ends with a letter of the sequence against a gap) of row `last` from those of row `first`; back gets bits: 1 the diagonal isn't best, 2 up isn't best, 4 up extends, 8 left extends."""
        best, up = best.copy(), up.copy()
        opened, diagonal, left, run, other = (np.full((m + 1, k), low, kind) for _ in range(5))
        scores, bit, moved = np.empty((m, k), kind), np.zeros((m + 1, k), bool), np.empty((m + 1, k), np.uint8)
        for i in range(first, last):
            if m:
                np.take(np.where(letter[i] == each, kind(match), kind(mismatch)), of, axis=0, out=scores, mode="clip")
            np.add(best[:-1], scores, out=diagonal[1:])
            np.add(best, kind(open_), out=opened)
            up += kind(extend)
            if back is not None:
                way = back[i - first]
                np.greater(up, opened, out=bit)
                np.left_shift(bit.view(np.uint8), 2, out=way)
            np.maximum(opened, up, out=up)
            np.maximum(diagonal, up, out=best)
            # left[j] = max over c < j of best[c] + OPEN + EXTEND * (j - 1 - c); the running maximum by steps that double
            np.subtract(best, cols, out=run)
            ahead_by = 1
            while ahead_by <= m:
                np.maximum(run[ahead_by:], run[:-ahead_by], out=other[ahead_by:])
                other[:ahead_by] = run[:ahead_by]
                run, other = other, run
                ahead_by *= 2
            np.add(run[:-1], ahead, out=left[1:])
            np.maximum(best, left, out=best)
            if back is not None:
                np.less(diagonal, best, out=bit)
                np.bitwise_or(way, bit.view(np.uint8), out=way)
                np.less(up, best, out=bit)
                np.left_shift(bit.view(np.uint8), 1, out=moved)
                np.bitwise_or(way, moved, out=way)
                np.add(left[1:-1], kind(extend - open_), out=scores[1:])
                np.greater(scores[1:], best[1:-1], out=bit[2:])
                np.left_shift(bit[2:].view(np.uint8), 3, out=moved[2:])
                np.bitwise_or(way[2:], moved[2:], out=way[2:])
        return best, up

    step = _kept(n)
    edge = np.where(np.arange(m + 1)[:, None] > 0, cols + kind(open_ - extend), 0).astype(kind)
    kept = [(np.tile(edge, (1, k)), np.full((m + 1, k), low, kind))]
    for first in range(0, n - step, step):
        kept.append(advance(*kept[-1], first, first + step))
    # the way back, all rows in step, from one kept row to the one before
    i, j = size.copy(), np.full(k, m)
    state = np.zeros(k, np.int64)
    back = np.zeros((min(step, n), m + 1, k), np.uint8)
    for first in range((len(kept) - 1) * step, -1, -step):
        if not (i > first).any():
            continue
        advance(*kept[first // step], first, min(n, first + step), back)
        while len(on := np.flatnonzero(i > first)):  # with no letters left, what remains is a gap
            at_i, at_j, was = i[on], j[on], state[on]
            bits = back[at_i - first - 1, at_j, on]
            now = np.where(was == 0, np.where(at_j > 0, np.where(bits & 1 == 0, 0, np.where(bits & 2 == 0, 1, 2)), 1), was)
            pair, above = now == 0, now == 1
            place[on[pair], at_i[pair] - 1] = at_j[pair] - 1
            goes_up = above & (at_i > 1) & ((bits & 4 > 0) | (at_j == 0))
            goes_left = (now == 2) & (at_j > 1) & (bits & 8 > 0)
            state[on] = np.where(goes_up, 1, np.where(goes_left, 2, 0))
            i[on] -= pair | above
            j[on] -= ~above
    return place


#: Bytes of one batch's kept rows and way back.
CELLS = 32 << 20


def align_to_reference(sequences: DataFrame, reference: str, *, id_col: str = "seq_id", seq_col: str = "sequence", batch: int = 256, cells: int = CELLS) -> DataFrame:
    """Adds node_of (reference position of each letter, -1 if none), on_reference (the letter at each reference position, '-' if none), n_mapped, n_equal, percent_identity (equal by mapped; null if none) and full_identity (equal by reference length). Null and empty sequences map nothing. Sequences of like length go in one batch, as many as `cells` allows."""
    added = "node_of array<int>, on_reference string, n_mapped int, n_equal int, percent_identity double, full_identity double"
    schema = ", ".join(f"`{n}` {t}" for n, t in sequences.dtypes) + f", {added}"
    ref = np.array([ord(x) for x in reference], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            size = pc.fill_null(pc.utf8_length(whole.column(seq_col)), 0).to_numpy(zero_copy_only=False)
            order = np.argsort(-size, kind="stable")
            low = 0
            while low < len(order):
                longest = int(size[order[low]])
                step = min(_kept(longest), max(longest, 1))
                high = low + max(1, min(batch, int(cells / ((16 * longest / step + step) * (len(ref) + 1)))))
                part = whole.take(pa.array(order[low:high]))
                low = high
                data, length = codes([x or "" for x in part.column(seq_col).to_pylist()])
                place = aligncodes(data, length, ref)
                mapped = place >= 0
                row, col = np.nonzero(mapped)
                at, letters = place[row, col], data[row, col]
                on = np.full((len(data), len(ref)), ord("-"), np.uint32)
                on[row, at] = letters
                n_mapped = mapped.sum(axis=1).astype(np.int32)
                n_equal = np.bincount(row[ref[at] == letters], minlength=len(data)).astype(np.int32)
                inside = np.arange(data.shape[1]) < length[:, None]
                node_of = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(length)].astype(np.int32)), pa.array(place[inside]))
                texts = [x.tobytes().decode("utf-32-le", "surrogatepass") for x in on]
                share = pa.array(n_equal / np.maximum(n_mapped, 1), mask=n_mapped == 0)
                full = pa.array(n_equal / max(len(ref), 1), mask=np.full(len(data), not len(ref)))
                yield pa.RecordBatch.from_arrays([*part.columns, node_of, pa.array(texts, pa.string()), pa.array(n_mapped), pa.array(n_equal), share, full], [*part.schema.names, "node_of", "on_reference", "n_mapped", "n_equal", "percent_identity", "full_identity"])

    return sequences.repartition(F.length(F.col(seq_col)), F.col(id_col)).mapInArrow(run, schema)


def experiment_mapping(experiments: DataFrame, reference: str) -> DataFrame:
    """assay_id, single, idx, node, wt_aa: each experiment's sequence (one a row of assay_id and single) aligned on the structure's letters.

    idx is a letter's place in the experiment and node the aligned place in the structure; unaligned letters have no
    row, and a null or empty sequence none at all.
    """
    own = align_to_reference(experiments.select("assay_id", "single", "sequence"), reference, id_col="assay_id")
    at = own.select("assay_id", "single", "sequence", F.posexplode("node_of").alias("idx", "node")).filter("node >= 0")
    return at.select("assay_id", "single", F.col("idx").cast("long").alias("idx"), F.col("node").cast("long").alias("node"), F.substring(F.col("sequence"), F.col("idx") + 1, F.lit(1)).alias("wt_aa"))
