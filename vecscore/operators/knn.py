"""Nearest neighbours: exact, in parts, and by probing the cells of an index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecscore.functions.schema import K
from vecscore.operators.boxes import boxes_of, cuts_of, other_cells, with_cell
from vecscore.operators.kmeans import Q, cell_finder, centroid_array
from vecscore.sources.tables import written

#: Rows of a part of a cell's queries or vectors; two parts meet in one task as matrix products.
PART = 16384
#: Distances that are held at once: they stay in a core's cache.
HELD = 1 << 18


def _matrix(t: pa.Table, columns: list[str]) -> np.ndarray:
    return np.stack([t.column(c).to_numpy() for c in columns], 1).astype(np.float64)


def _nearest(queries: DataFrame, vectors: DataFrame, k: int, vector: list[str]) -> DataFrame:
    """queries: cell_id, query_id, cell_rank, bound and vector columns, with parts_q and parts_v; vectors: the same with vec_id and is_fraud. For each query and part of its cells' vectors the k nearest that are no farther than bound (null: all), of equally near ones those of least vec_id.

    A cell's queries are dealt into parts_q parts and its vectors into parts_v, and each part of one side meets each of the other in a task of its own, so neither a large cell nor a cell that many queries probe is one task's work. k rows a query and part are what leaves a task."""

    def dealt(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        part = F.pmod(F.xxhash64(key), F.col(f"parts_{own}")).cast("int").alias(f"part_{own}")
        every = F.explode(F.sequence(F.lit(0), F.col(f"parts_{other}") - 1)).alias(f"part_{other}")
        # names of this side alone, as both sides may come from one table
        columns = [F.col(c).alias(f"{own}_{c}") for c in df.columns if c not in ("parts_q", "parts_v")]
        return df.select(*columns, part, f"parts_{other}").select("*", every).drop(f"parts_{other}")

    keys = lambda own: [f"{own}_cell_id", "part_q", "part_v"]
    schema = "query_id bigint, cell_rank int, vec_id bigint, distance bigint, is_fraud boolean"

    def run(q: pa.Table, v: pa.Table) -> pa.Table:
        v = v.sort_by("v_vec_id")
        x, y = _matrix(q, [f"q_{c}" for c in vector]), _matrix(v, [f"v_{c}" for c in vector])
        n, most = len(y), min(k, len(y))
        own_squares, bound = (x * x).sum(1), q.column("q_bound").cast(pa.float64()).fill_null(np.inf).to_numpy()
        # distance less the query's square, then place by vec_id, in one number: whole in double precision
        ones, weights = np.ones((len(x), 1)), np.vstack([-2 * n * y.T, n * (y * y).sum(1) + np.arange(n)])
        x, rows, best, near = np.hstack([x, ones]), [], [], []
        step = max(1, HELD // max(n, 1))
        for first in range(0, len(x) if n else 0, step):
            order = x[first : first + step] @ weights
            # most queries find nothing in a part of another cell
            hit = np.flatnonzero(order.min(1) < n * (bound - own_squares + 1)[first : first + step])
            least = np.sort(np.partition(order[hit], most - 1, 1)[:, :most], 1)
            rows.append(np.repeat(hit + first, most))
            best.append((least % n).ravel().astype(np.int64))
            near.append((least // n + own_squares[hit + first, None]).ravel().astype(np.int64))
        rows, at, distance = (np.concatenate(part) if part else np.zeros(0, np.int64) for part in (rows, best, near))
        rows, at = pa.array(rows), pa.array(at)
        columns = [q.column("q_query_id").take(rows), q.column("q_cell_rank").take(rows), v.column("v_vec_id").take(at), pa.chunked_array([pa.array(distance, pa.int64())]), v.column("v_is_fraud").take(at)]
        within = pc.fill_null(pc.less_equal(columns[3], q.column("q_bound").take(rows)), True)
        columns = [c.filter(within) for c in columns]
        return pa.table(columns, names=["query_id", "cell_rank", "vec_id", "distance", "is_fraud"])

    q = dealt(queries.select("cell_id", F.col("query_id").cast("bigint").alias("query_id"), "cell_rank", "bound", *vector, "parts_q", "parts_v"), "query_id", "q", "v")
    v = dealt(vectors.select("cell_id", F.col("vec_id").cast("bigint").alias("vec_id"), "is_fraud", *vector, "parts_q", "parts_v"), "vec_id", "v", "q")
    return q.groupBy(*keys("q")).cogroup(v.groupBy(*keys("v"))).applyInArrow(run, schema)


def _ranked(near: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy("distance", "cell_rank", "vec_id")
    return near.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance", "is_fraud")


def _parts(rows: Column) -> Column:
    return F.greatest(F.ceil(rows / PART), F.lit(1)).cast("int")


def _in_cells(probes: DataFrame, vectors: DataFrame, k: int, vector: list[str]) -> DataFrame:
    """As _nearest(); probes without the numbers of parts."""
    # a row for each probed cell that holds vectors, so never more rows than there are cells
    sizes = probes.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n_q")).join(vectors.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n_v")), "cell_id")
    sizes = F.broadcast(written(sizes.select("cell_id", _parts(F.col("n_q")).alias("parts_q"), _parts(F.col("n_v")).alias("parts_v"))))
    return _nearest(probes.join(sizes, "cell_id"), vectors.join(sizes, "cell_id"), k, vector)


def exact_knn(queries: DataFrame, vectors: DataFrame, k: int = K, vector: list[str] = Q) -> DataFrame:
    """queries: query_id and vector columns; vectors: vec_id, is_fraud and vector columns. query_id, rank (from 1), vec_id, distance, is_fraud; of equally near ones the least vec_id.

    A query first meets the vectors of the cell of space that it is in. Its k-th distance there bounds what is left to find: of the other cells, it meets all whose box is no farther than that, so no vector that is as near is missed."""
    vectors = vectors.select("vec_id", "is_fraud", *vector)
    cuts = cuts_of(vectors, vector)
    vectors = written(with_cell(vectors, cuts, vector))
    queries = written(with_cell(queries.select("query_id", *vector), cuts, vector))
    zero, none = F.lit(0), F.lit(None).cast("bigint")
    near = _in_cells(queries.withColumns({"cell_rank": zero, "bound": none}), vectors, k, vector)
    if not len(cuts):
        return _ranked(near, k)
    near = written(near)
    bounds = _ranked(near, k).filter(F.col("rank") == k).select("query_id", F.col("distance").alias("bound"))
    others = written(other_cells(queries.join(bounds, "query_id", "left"), boxes_of(vectors, vector), vector))
    return _ranked(near.unionByName(_in_cells(others.withColumn("cell_rank", zero), vectors, k, vector)), k)


def probe_cells(queries: DataFrame, centroids: DataFrame, nprobe: int) -> DataFrame:
    """queries: query_id, q0... query_id, cell_rank (from 0), cell_id, distance of the nprobe nearest cells, and the query's q0...; of equally near ones the least first."""
    found = centroid_array(centroids)
    ids = np.array([cell for cell, _ in found], np.int32)
    find = cell_finder(found, nprobe)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, distance = find(b)
            n = at.shape[1]
            yield pa.RecordBatch.from_pydict(
                {
                    "query_id": np.repeat(b.column("query_id").to_numpy(zero_copy_only=False), n),
                    "cell_rank": np.tile(np.arange(n, dtype=np.int32), len(at)),
                    "cell_id": ids[at].ravel(),
                    "distance": distance.ravel(),
                    **{c: np.repeat(b.column(c).to_numpy(zero_copy_only=False).astype(np.int32), n) for c in Q},
                }
            )

    return queries.select("query_id", *Q).mapInArrow(run, "query_id bigint, cell_rank int, cell_id int, distance bigint, " + ", ".join(f"{c} int" for c in Q))


def ivf_neighbours(queries: DataFrame, vectors: DataFrame, centroids: DataFrame, k: int = K, nprobe: int = 1) -> DataFrame:
    """The k nearest vectors among the probed cells: query_id, rank, vec_id, distance, is_fraud. Of equally near ones the nearer cell's, then the least vec_id. A query meets its cells' vectors only, and no pair of them becomes a row."""
    probes = written(probe_cells(queries, centroids, nprobe).drop("distance"))
    return _ranked(_in_cells(probes.withColumn("bound", F.lit(None).cast("bigint")), vectors, k, Q), k)


def votes(queries: DataFrame, neighbours: DataFrame) -> DataFrame:
    """query_id, fraud_count; a query without neighbours has 0."""
    sums = neighbours.groupBy("query_id").agg(F.sum(F.col("is_fraud").cast("int")).alias("n"))
    return queries.select("query_id").join(sums, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).cast("int").alias("fraud_count"))


def cell_fraud_counts(vectors: DataFrame, centroids: DataFrame, k: int = K) -> DataFrame:
    """cell_id, frauds (k at most), n; empty cells too."""
    own = vectors.groupBy("cell_id").agg(F.sum(F.col("is_fraud").cast("int")).alias("f"), F.count(F.lit(1)).alias("n"))
    return centroids.select("cell_id").join(own, "cell_id", "left").select("cell_id", F.least(F.coalesce("f", F.lit(0)), F.lit(k)).cast("int").alias("frauds"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
