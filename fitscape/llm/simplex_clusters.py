"""Clustering around integer centroids: bounds from an n-simplex projection leave few centroids to compare exactly."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitscape.llm.shared import Scratch
from fitscape.llm.vectors import floor_means, integer_vectors, matrix, member_sums


class Simplex:
    """Pivots whose simplex isn't flat, and the coordinates of an apex above it from its distances to them.

    The apex over pivots 1 to n has the coordinates of the foot of its height (n - 1 numbers) and the height. For two
    apexes, the distance with both heights on one side of the base is at most the true one, that with heights on opposite
    sides at least.
    """

    #: A pivot this near (by share) to the span of those before would blow up rounding errors and is left out.
    FLAT = 0.2
    #: Rounding errors of a bound by the distances it comes from; true ones are below 1e-6.
    MARGIN = 1e-5

    def __init__(self, candidates: np.ndarray, most: int):
        self.pivots, self.base = candidates[:1], np.zeros((1, 0))
        for x in candidates[1:]:
            if len(self.pivots) == most:
                break
            apex = self.apexes(self.squared(x[None]))[0]
            if apex[-1] > self.FLAT * np.linalg.norm(apex):
                self.base = np.vstack([np.pad(self.base, ((0, 0), (0, 1))), apex])
                self.pivots = np.vstack([self.pivots, x])

    def squared(self, x: np.ndarray) -> np.ndarray:
        """Squared distances to the pivots, exact."""
        return np.stack([((x - p) ** 2).sum(axis=1) for p in self.pivots], axis=1)

    def apexes(self, d2: np.ndarray) -> np.ndarray:
        """Coordinates (one for each pivot) of points with these squared distances to the pivots."""
        d2, out = d2.astype(float), np.zeros((len(d2), len(self.base)))
        for k in range(1, len(self.base)):  # pivot k is base[k], of which coordinates 0 to k - 1 aren't 0
            own = self.base[k, : k - 1]
            out[:, k - 1] = (d2[:, 0] - d2[:, k] + (self.base[k] ** 2).sum() - 2 * out[:, : k - 1] @ own) / (2 * self.base[k, k - 1])
        out[:, -1] = np.sqrt(np.maximum(d2[:, 0] - (out[:, :-1] ** 2).sum(axis=1), 0))
        return out


def nearest(v: np.ndarray, apex: np.ndarray, centroids: np.ndarray, tops: np.ndarray, exact: bool = True) -> tuple[np.ndarray, np.ndarray, int]:
    """(number, squared distance) of each vector's nearest centroid, ties to the smaller number, and how many distances were computed.

    Centroids whose lower bound is over another's upper bound are out. Without `exact` a vector with one centroid left
    isn't compared, and its distance is 0.
    """
    foot = (apex[:, None, :-1] - tops[None, :, :-1]) ** 2
    foot = foot.sum(axis=2)
    low = np.sqrt(foot + (apex[:, None, -1] - tops[None, :, -1]) ** 2)
    high = np.sqrt(foot + (apex[:, None, -1] + tops[None, :, -1]) ** 2)
    margin = Simplex.MARGIN * (1 + np.linalg.norm(apex, axis=1) + np.linalg.norm(tops, axis=1).max())
    left = low <= high.min(axis=1, keepdims=True) + 2 * margin[:, None]
    row, number = np.nonzero(left if exact else left & (left.sum(axis=1, keepdims=True) > 1))
    distance = np.full(left.shape, np.iinfo(np.int64).max)
    distance[row, number] = ((v[row] - centroids[number]) ** 2).sum(axis=1)
    best = np.where(left.sum(axis=1) > 1, distance.argmin(axis=1), left.argmax(axis=1))
    found = distance[np.arange(len(v)), best]
    return best, found if exact else np.where(found == np.iinfo(np.int64).max, 0, found), len(row)


def with_apexes(rows: DataFrame, simplex: Simplex) -> DataFrame:
    """Adds apex, from the distances to the pivots: taken once, as pivots stay."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apex = simplex.apexes(simplex.squared(matrix(batch)))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, apex.size + 1, apex.shape[1], dtype=np.int32)), pa.array(apex.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, flat], [*batch.schema.names, "apex"])

    return rows.mapInArrow(add, ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", apex array<double>")


def _apex(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("apex").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def cluster_vectors(
    df: DataFrame, *, clusters: int = 8, rounds: int = 10, scale: int = 1024, dim: int = 64, seed: int = 3, pivots: int = 6, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector of `dim` whole components.

    Components become floor(scale * x). Vectors that are null, of another length, or hold a null, NaN or infinity go.
    Centroids start as the vectors with the smallest SHA-256 of seed:id (ties by components, null ids last); the pivots
    are those first ones that don't lie flat. Fewer vectors than clusters make fewer clusters. Equal distances go to the
    smaller number, empty centroids stay. Repeated rows count as often as they occur; null ids are clustered like others;
    an empty table gives none; other columns are ignored.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    rows = integer_vectors(df, scale, id_col=id_col, vector_col=vector_col).filter(F.size("v") == dim)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.select(order.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(clusters).collect()  # `clusters` rows
    if not first:
        return spark.createDataFrame([], f"vec_id {dict(rows.dtypes)['vec_id']}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r["v"] for r in first], np.int64)
    simplex = Simplex(centroids, pivots)
    rows = scratch.stored(with_apexes(rows, simplex), "apexes")
    n = len(centroids)
    for _ in range(rounds):
        tops = simplex.apexes(simplex.squared(centroids))

        def group_of(batch: pa.RecordBatch, v: np.ndarray, centroids=centroids, tops=tops) -> tuple[np.ndarray, np.ndarray]:
            return nearest(v, _apex(batch), centroids, tops, exact=False)[0], v

        centroids = floor_means(centroids, *member_sums(rows.select("v", "apex"), group_of, n, dim))
    tops = simplex.apexes(simplex.squared(centroids))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, distance, _ = nearest(matrix(batch), _apex(batch), centroids, tops)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(best.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    assigned = Scratch(spark).stored(rows.mapInArrow(assign, f"vec_id {dict(rows.dtypes)['vec_id']}, cluster int, distance long"), "clusters")
    scratch.clear()
    total = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row a cluster
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    of = lambda values: F.element_at(F.array(*[F.lit(x) for x in values]), F.col("cluster") + 1)
    return assigned.select(
        "vec_id", "cluster", "distance", of([total.get(k, 0) for k in range(n)]).cast("long").alias("cluster_inertia"), F.lit(sum(total.values())).cast("long").alias("inertia"),
        of(digests).alias("centroid_sha256"),
    )
