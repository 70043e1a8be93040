"""Codes of vectors by product codebooks, whose nearest entries are found by Orchard's search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitscape.llm.shared import Scratch
from fitscape.llm.vectors import floor_means, integer_vectors, matrix, member_sums, with_total


class Orchard:
    """Nearest entry of a codebook (entries x components, integers), ties to the lower index: each entry has the list of all others by distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        d = ((entries[:, None] - entries[None]) ** 2).sum(axis=2)
        order = np.argsort(d + np.where(np.eye(len(d), dtype=bool), -1, 0), axis=1, kind="stable")[:, 1:]  # an entry itself comes first
        self.near, self.apart = order, np.take_along_axis(d, order, axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(index, squared distance) for each row of x, and the number of distances computed. All rows walk in step, each along its current entry's list."""
        n, size = len(x), len(self.entries)
        now, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
        best = ((x - self.entries[0]) ** 2).sum(axis=1)
        seen = np.zeros((n, size), bool)
        seen[:, 0] = True
        on, computed = np.arange(n if size > 1 else 0), n
        while len(on):
            at = now[on]
            # beyond twice the current distance no entry can be nearer; at exactly twice it can be as near
            on = on[self.apart[at, place[on]] <= 4 * best[on]]
            other = self.near[now[on], place[on]]
            place[on] += 1
            new = ~seen[on, other]
            row, entry = on[new], other[new]
            seen[row, entry] = True
            computed += len(row)
            d = ((x[row] - self.entries[entry]) ** 2).sum(axis=1)
            better = (d < best[row]) | ((d == best[row]) & (entry < now[row]))
            row, entry = row[better], entry[better]
            now[row], best[row], place[row] = entry, d[better], 0  # jump to the improved entry's list
            on = on[place[on] < size - 1]
        return now, best, computed


def first_vectors(rows: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """The vectors of the smallest ids (nulls last, ties by components) among those that `parts` divides, as long as the first; None if there are none."""
    usable = rows.filter((F.size("v") > 0) & (F.size("v") % parts == 0))
    order = [F.col("vec_id").asc_nulls_last(), "v"]
    first = usable.orderBy(*order).select("v").head()
    if first is None:
        return None
    same = usable.filter(F.size("v") == len(first["v"])).orderBy(*order).limit(entries)
    return np.array([r["v"] for r in same.select("v").collect()], np.int64)  # `entries` rows


def train_codebooks(rows: DataFrame, start: np.ndarray, *, parts: int, rounds: int) -> np.ndarray:
    """parts x entries x components: in each round every part goes to its nearest entry, and entries become the floor means of their parts."""
    n, width = len(start), start.shape[1] // parts
    books = start.reshape(n, parts, width).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        search = [Orchard(b) for b in books]

        def group_of(batch: pa.RecordBatch, v: np.ndarray, search=search) -> tuple[np.ndarray, np.ndarray]:
            cut = v.reshape(len(v), parts, width)
            group = [p * n + s.nearest(cut[:, p])[0] for p, s in enumerate(search)]
            return np.concatenate(group), cut.transpose(1, 0, 2).reshape(-1, width)

        found, total = member_sums(rows.select("v"), group_of, parts * n, width)
        books = floor_means(books.reshape(-1, width), found, total).reshape(parts, n, width)
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """rows without v, and code (two hex digits of each part's nearest entry) and error (squared distances, summed over parts)."""
    parts, n, width = books.shape
    kept = [x for x in rows.dtypes if x[0] != "v"]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Orchard(b) for b in books]
        for batch in batches:
            cut = matrix(batch).reshape(batch.num_rows, parts, width)
            found = [s.nearest(cut[:, p])[:2] for p, s in enumerate(search)]
            index, error = np.array([i for i, _ in found], np.uint8).reshape(parts, -1).T, sum(d for _, d in found)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c, _ in kept), pa.array([bytes(x).hex() for x in index], pa.string()), pa.array(error, pa.int64())], [*(c for c, _ in kept), "code", "error"])

    return rows.mapInArrow(code, ", ".join(f"{c} {t}" for c, t in [*kept, ("code", "string"), ("error", "long")]))


def compress_vectors(
    df: DataFrame, *, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector that is whole.

    Components become floor(scale * x). Vectors that are null or hold a null, NaN or infinity go, and so do those of
    another length than the kept vector with the smallest id whose length `parts` divides. Fewer than `entries` vectors
    make smaller codebooks; equal entries and distances go to the lower index, and unused entries stay. Repeated rows
    count as often as they occur; null ids come last and are coded like others; null labels are one label; an empty
    table gives none; other columns are ignored. entries: 256 at most.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    rows = scratch.stored(integer_vectors(df, scale, id_col=id_col, vector_col=vector_col, extra={"label": label_col}), "integer-vectors")
    start = first_vectors(rows, parts, entries)
    if start is None:
        kinds = dict(rows.dtypes)
        return spark.createDataFrame([], f"vec_id {kinds['vec_id']}, code string, error long, label_error long, codebooks_sha256 string")
    rows = rows.filter(F.size("v") == start.shape[1])
    books = train_codebooks(rows, start, parts=parts, rounds=rounds)
    coded = Scratch(spark).stored(encode(rows, books), "vector-codes")
    scratch.clear()
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return with_total(coded, "label", "error", "label_error").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
