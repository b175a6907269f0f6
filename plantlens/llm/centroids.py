"""Centroid clustering over integer vectors, with dot products that are kept and mended instead of computed anew.

Every vector carries its exact dot product with each centroid. When centroids move, only the components that changed count:
a dot product grows by the sum of x[j] * change[j] over the changed j. Distances follow from |x|^2 - 2 x.c + |c|^2, so the
nearest centroid is an argmin over the kept products. A round is one pass that mends and assigns (written to the shared
folder, so a lost executor costs no rework) and one aggregate of at most `k` rows a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, written

COMPONENTS, SCALE, CENTROIDS, ROUNDS, SALT = 64, 256, 40, 5, "2:"
#: Largest magnitude of a scaled component: squared distances of 64 components and their kept products stay within 64 bits.
LARGEST = 2**26


def scaled(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): integer vectors floor(scale * x) of the rows with exactly `components` finite components.

    Rows with null vectors, other lengths, null or non-finite components are left out. A scaled component beyond LARGEST in
    magnitude is an error, as its distances don't fit in a long. Repeated rows stay; other columns are not kept.
    """
    e = F.col(embedding)
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = vectors.where(e.isNotNull() & (F.size(e) == components) & finite)
    wide = lambda x: F.lit(float(scale)) * x.cast("double")
    whole = lambda x: F.when(F.abs(wide(x)) <= LARGEST, F.floor(wide(x))).otherwise(F.raise_error(F.lit(f"a component is over {LARGEST} after scaling"))).cast("int")
    return kept.select(F.col(vec_id).alias("vec_id"), F.transform(e, whole).alias("v"))


def first_centroids(scaled_vectors: DataFrame, k: int = CENTROIDS, salt: str = SALT) -> list[list[int]]:
    """The k vectors with the smallest sha256 of salt and id, in that order; of equal hashes the smaller vector first."""
    named = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [list(r["v"]) for r in scaled_vectors.select(named.alias("h"), "v").orderBy("h", "v").limit(k).collect()]


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.array(values.reshape(-1)))


def exact_products(columns: np.ndarray, largest: int, change: np.ndarray) -> np.ndarray:
    """Sum over components of columns * change, as exact integers: in doubles where no partial sum can leave 53 bits."""
    if largest * int(np.abs(change).sum()) < 2**53:
        return (change.astype(np.float64) @ columns).astype(np.int64)
    return (columns.astype(np.int64) * change[:, None]).sum(axis=0)


def changes(before: list[list[int]], after: list[list[int]]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(centroid, changed components, their changes) of the centroids that moved."""
    moves = np.array(after, dtype=np.int64) - np.array(before, dtype=np.int64)
    return [(c, j := np.flatnonzero(row), row[j]) for c, row in enumerate(moves) if row.any()]


def assigned(state: DataFrame, moves: list[tuple[int, np.ndarray, np.ndarray]], centroids: list[list[int]], width: int) -> DataFrame:
    """state (vec_id, v, and dots but for the first time) with dots mended by `moves`, the nearest centroid and its squared distance."""
    k, norms = len(centroids), np.array([sum(x * x for x in c) for c in centroids], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            v = matrix(batch.column("v"), width)
            dots = matrix(batch.column("dots"), k).copy() if "dots" in batch.schema.names else np.zeros((n, k), dtype=np.int64)
            columns, largest = np.ascontiguousarray(v.T, dtype=np.float64), int(np.abs(v.astype(np.int64)).max())
            for c, j, change in moves:
                dots[:, c] += exact_products(columns if len(j) == width else columns[j], largest, change)
            part = norms - 2 * dots
            nearest = part.argmin(axis=1)
            own = np.einsum("ij,ij->i", v.astype(np.int64), v.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), lists(dots), pa.array(nearest.astype(np.int32)), pa.array(own + part[np.arange(n), nearest])],
                names=["vec_id", "v", "dots", "cluster", "distance"],
            )

    schema = T.StructType([state.schema["vec_id"], state.schema["v"], T.StructField("dots", T.ArrayType(T.LongType())), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    return state.mapInArrow(run, schema)


def moved(state: DataFrame, centroids: list[list[int]], width: int) -> list[list[int]]:
    """Each centroid as the floor of the mean of its vectors; those without vectors stay. One row a cluster reaches the driver."""
    sums = state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("v")[j]).alias(f"s{j}") for j in range(width)])
    after = list(centroids)
    for r in sums.collect():
        after[r["cluster"]] = [r[f"s{j}"] // r["n"] for j in range(width)]
    return after


def clustered(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, k: int = CENTROIDS, rounds: int = ROUNDS, salt: str = SALT) -> tuple[DataFrame, list[list[int]]]:
    """((vec_id, cluster, distance) of every vector that `scaled` keeps, the final centroids).

    `rounds` times all vectors are assigned to the nearest centroid (of equally near ones the lower number) and centroids
    move; then all are assigned once more. Fewer vectors than k give as many centroids. A table without such vectors gives
    no rows. A null id counts as an empty text in the choice of first centroids. Repeated rows are vectors each.
    """
    x = written(scaled(vectors, vec_id, embedding, components, scale), "vectors")
    centroids = first_centroids(x, k, salt)
    if not centroids:
        return x.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), []
    state = written(assigned(x, changes([[0] * components] * len(centroids), centroids), centroids, components), "dots")
    discard(x)
    for _ in range(rounds):
        after = moved(state, centroids, components)
        moves = changes(centroids, after)
        if not moves:
            break  # further rounds would find the same
        centroids = after
        nxt = written(assigned(state, moves, centroids, components), "dots")
        discard(state)
        state = nxt
    return state.select("vec_id", "cluster", "distance"), centroids


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def report(vectors: DataFrame, **options) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    rows, centroids = clustered(vectors, **options)
    inertia = dict(rows.groupBy("cluster").agg(F.sum("distance")).collect())  # a row a cluster
    at = lambda values, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values] or [F.lit(None).cast(kind)]), F.col("cluster"))
    return rows.withColumns(
        {
            "cluster_inertia": at([inertia.get(c, 0) for c in range(len(centroids))], "long"),
            "inertia": F.lit(sum(inertia.values())).cast("long"),
            "centroid_sha256": at([digest(c) for c in centroids], "string"),
        }
    )
