"""Exact top-k search by inner product as a Voronoi nearest-neighbour join.

With a coordinate added that gives all data vectors one length, a higher inner
product is a smaller distance.  Rows are assigned to the nearest of a bounded
number of pivots.  Summaries of the cells (radius, count, the nearest rows of the
k+1 ids nearest to the pivot) bound how far the k-th neighbour of any query of a cell can be; a data
row goes to a group of query cells only if, for one of them, its distance from the
cell's pivot, less the cell's radius, is within the bound.  What meets is solved in tiles of bounded
size, and the best of the tiles are merged.

* Components become floor(256 * x).  Vectors that are null or hold a null, NaN
  or infinite component take no part.  A shorter vector counts as padded with
  zeros, an empty one as zero; inner products beyond 64 bits stop at its limits.
* Ties go to the smaller id, then rows with equal ids count as several
  candidates.  A query's candidates are all rows of other ids; with fewer than k
  it gets them all.  A table of k ids or fewer is compared whole.  Null ids take
  no part.  An empty table gives no rows.
* The bounds are widened by what rounding can do, and inner products of the
  result are whole numbers, so the result is exact.
* Cells are grouped, and a cell that holds a third of the queries is cut, into
  tiles of about ``TILE_QUERIES``; copies of data rows into tiles of ``TILE_ROWS``:
  no task holds a cell, and a row has at most one copy a tile of queries.
* Queries equal in id and vector count once.
* The driver holds the pivots and a summary row per cell, at most ``PIVOTS``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from intakeloom.llm.shared import written

PIVOTS = 128
TILE_QUERIES = 4096
TILE_ROWS = 32768
SLACK = 1e-9  # of the square of the longest vectors, for rounding


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of float lists as rows of whole numbers, padded to ``width``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = np.floor(256.0 * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = values
    return out


def _distances(rows: np.ndarray, extra: np.ndarray, pivots: np.ndarray, pivot_extra: np.ndarray) -> np.ndarray:
    """Distances to the pivots, the added coordinate included."""
    squares = (
        (rows * rows).sum(1)[:, None]
        - 2 * rows @ pivots.T
        + (pivots * pivots).sum(1)[None, :]
        + (extra[:, None] - pivot_extra[None, :]) ** 2
    )
    return np.sqrt(np.maximum(squares, 0.0))


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products as int64; floats are exact where sums stay below 2**53."""
    bound = np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * max(rows.shape[1], 1)
    if bound < 2**53:
        return (queries @ rows.T).astype(np.int64)
    integers = np.vectorize(int, otypes=[object])
    limit = np.iinfo(np.int64)
    stopped = np.vectorize(lambda v: min(max(v, limit.min), limit.max), otypes=[np.int64])
    return stopped(integers(queries) @ integers(rows).T)


def top(scores: np.ndarray, query_ids: np.ndarray, row_ids: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """(query id, row id, score) of each query's k best rows; ``row_ids`` ascend."""
    for line, query in zip(scores, query_ids):
        allowed = row_ids != query
        values, ids = line[allowed], row_ids[allowed]
        if len(values) > k:
            keep = values >= np.partition(values, len(values) - k)[len(values) - k]
            values, ids = values[keep], ids[keep]
        # Ascending ids and a stable sort: ties stay with the smaller id.
        for at in np.argsort(~values, kind="stable")[:k]:
            yield int(query), int(ids[at]), int(values[at])


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k rows with the highest inner product to each query."""
    usable = (
        F.col(id_col).isNotNull()
        & F.col(vector_col).isNotNull()
        & F.forall(
            vector_col,
            lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")),
        )
    )

    def usable_rows(frame: DataFrame) -> DataFrame:
        return frame.where(usable).select(
            F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")
        )

    data, asked = usable_rows(vectors), usable_rows(queries).distinct()
    empty = data.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    summary = data.select(
        F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + F.pow(F.abs(x * 256) + 1, 2))),  # or more
        F.max(F.size("vector")),
        F.count("*"),
    ).first()
    asked_count = asked.count()
    if not summary[2] or not asked_count:
        return empty
    width = max(summary[1], asked.agg(F.max(F.size("vector"))).first()[0])
    longest = float(summary[0])
    slack = SLACK * max(longest, 1.0)
    sample = data.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()  # a bounded number of pivots
    pivots = np.unique(matrix(pa.array([row.vector for row in sample], pa.list_(pa.float64())), width), axis=0)
    pivot_extra = np.sqrt(np.maximum(longest - (pivots * pivots).sum(1), 0.0))

    def places(batch: pa.RecordBatch, is_query: bool) -> tuple[np.ndarray, np.ndarray]:
        rows = matrix(batch.column(1), width)
        extra = np.zeros(len(rows)) if is_query else np.sqrt(np.maximum(longest - (rows * rows).sum(1), 0.0))
        away = _distances(rows, extra, pivots, pivot_extra)
        return away, away.argmin(1)

    def assign(is_query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    away, cell = places(batch, is_query)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0), pa.array(cell.astype(np.int32)), pa.array(away[np.arange(len(cell)), cell])],
                        names=["id", "cell", "away"],
                    )

        return run

    assigned = "id bigint, cell int, away double"
    # The nearest rows of the k+1 ids nearest to each pivot: one may be the query's own, and all rows of it are out.
    near = (
        data.mapInArrow(assign(False), assigned)
        .groupBy("cell", "id")
        .agg(F.min("away").alias("away"))
        .withColumn("nth", F.row_number().over(Window.partitionBy("cell").orderBy("away", "id")))
        .where(F.col("nth") <= k + 1)
        .groupBy("cell")
        .agg(F.collect_list(F.struct("id", "away")).alias("nearest"))
        .collect()
    )
    asked_cells = (
        asked.mapInArrow(assign(True), assigned)
        .groupBy("cell")
        .agg(F.max("away").alias("radius"), F.count("*").alias("members"))
        .orderBy("cell")
        .collect()
    )
    apart = _distances(pivots, pivot_extra, pivots, pivot_extra)
    # Neighbouring cells of queries are grouped up to the size of a tile.
    first = asked_cells[0].cell
    asked_cells.sort(key=lambda row: (apart[first, row.cell], row.cell))
    cells = np.array([row.cell for row in asked_cells])
    radius = np.array([row.radius for row in asked_cells])
    members = np.array([row.members for row in asked_cells])
    group = (np.cumsum(members) - members) // TILE_QUERIES
    _, begins, group = np.unique(group, return_index=True, return_inverse=True)
    tiles = np.ceil(np.bincount(group, members) / TILE_QUERIES).astype(np.int64)
    group_of = {int(cell): int(k) for cell, k in zip(cells, group)}
    reach = np.full(len(cells), np.inf)
    for at, cell in enumerate(cells):
        least: dict[int, float] = {}  # an id's nearest row, in whatever cell
        for row in near:
            for one in row.nearest:
                least[one.id] = min(least.get(one.id, np.inf), one.away + apart[row.cell, cell])
        if len(least) > k:
            reach[at] = radius[at] + sorted(least.values())[k]
    reach = reach + np.sqrt(slack) + 1e-6

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                away, _ = places(batch, False)
                within = away[:, cells] - radius[None, :] <= reach[None, :]
                row, at = np.nonzero(np.logical_or.reduceat(within, begins, axis=1))
                copies = tiles[at]
                row, at = np.repeat(row, copies), np.repeat(at, copies)
                part = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)[: len(row)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(at.astype(np.int32)),
                        pa.array(part.astype(np.int32)),
                        batch.column(0).take(pa.array(row)),
                        batch.column(1).take(pa.array(row)),
                    ],
                    names=["at", "part", "id", "vector"],
                )

    def deal_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            _, cell = places(batch, True)
            at = np.array([group_of[int(c)] for c in cell])
            spread = (batch.column(0).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(at.astype(np.int32)),
                    pa.array((spread % tiles[at].astype(np.uint64)).astype(np.int32)),
                    *batch.columns,
                ],
                names=["at", "part", "id", "vector"],
            )

    return _solved(data, asked, replicate, deal_queries, width, k)


def _solved(data, asked, replicate, deal_queries, width: int, k: int) -> DataFrame:
    tile = "at int, part int, id bigint, vector array<double>"
    copies = written(data.mapInArrow(replicate, tile), "voronoi-copies")
    counts = copies.groupBy("at", "part").count()
    slabs = counts.select("at", "part", F.ceil(F.col("count") / TILE_ROWS).cast("int").alias("slabs"))
    left = copies.join(slabs, ["at", "part"]).withColumn(
        "slab", F.pmod(F.xxhash64("id"), F.col("slabs")).cast("int")
    ).drop("slabs")
    right = (
        asked.mapInArrow(deal_queries, tile)
        .join(slabs, ["at", "part"])
        .withColumn("slab", F.explode(F.sequence(F.lit(0), F.col("slabs") - 1)))
        .select(*[F.col(c).alias(f"asked_{c}") for c in ("at", "part", "slab", "id", "vector")])
    )

    def solve(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, int]] = []
        if len(rows) and len(queries):
            rows = rows.sort_values("id", kind="stable")
            ids = rows["id"].to_numpy(np.int64)
            vectors = matrix(pa.array(rows["vector"], pa.list_(pa.float64())), width)
            for at in range(0, len(queries), 128):
                some = queries.iloc[at : at + 128]
                scores = products(matrix(pa.array(some["asked_vector"], pa.list_(pa.float64())), width), vectors)
                found += top(scores, some["asked_id"].to_numpy(np.int64), ids, k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    best = (
        left.groupBy("at", "part", "slab")
        .cogroup(right.groupBy("asked_at", "asked_part", "asked_slab"))
        .applyInPandas(solve, "query_id bigint, vec_id bigint, score bigint")
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        best.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
