"""An inverted file of k-means cells for nearest-neighbour joins.

Cells are fitted on a bounded sample and every vector is stored in the cell of its nearest centre, with
cells as partitions of the table, so a search reads only the cells it probes. Within a cell distances
are exact. A search can stop there (approximate; probes_for_recall tells how many cells that takes) or go on:
what it has found so far is an upper bound of the distance of the k-th neighbour, and a cell whose
nearest possible point is farther than that cannot hold a better one; the cells that remain are read,
and the result is that of a full scan. Large cells and many queries are cut into parts, each pair of
which is a task's work, and every part hands on its k best only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import pin
from .search import candidate_count, rerank_best

#: Vectors that cells are fitted on, those with the smallest hashed ids; it bounds the fit at any size.
SAMPLE = 20_000
#: Vectors of a cell, and queries, that meet in one task.
PART, QUERIES = 20_000, 2_000


@dataclass(frozen=True)
class VectorIndex:
    """`rows` has the vectors' columns, cell and centre distance; `cells` cell, centre, radius and size."""

    rows: DataFrame
    cells: DataFrame
    centres: np.ndarray
    id_col: str
    vector_col: str


def fit_cells(vectors: DataFrame, id_col: str, vector_col: str, n_cells: int, sample: int = SAMPLE, iterations: int = 10) -> np.ndarray:
    """Centres of at most `n_cells` cells, fitted on `sample` vectors chosen by hashed id, so alike on every run."""
    usable = vectors.where(F.col(vector_col).isNotNull() & ~F.exists(vector_col, lambda x: x.isNull() | F.isnan(x)))
    order = F.xxhash64(F.col(id_col)).alias("_order")
    few = usable.select(order, F.col(vector_col).cast("array<double>").alias("_vector")).orderBy("_order", "_vector").limit(sample)
    few = pin(few.select(array_to_vector("_vector").alias("features")).coalesce(1))
    n = few.count()
    if n == 0:
        return np.empty((0, 0))
    if n_cells == 1 or few.distinct().limit(2).count() < 2:
        return np.array([few.first()["features"].toArray()])
    model = KMeans(k=min(n_cells, n), maxIter=iterations, seed=7, initMode="random").fit(few)
    return np.array(model.clusterCenters())


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x from all rows of y, good enough to rank cells."""
    return np.maximum((x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1) - 2 * x @ y.T, 0)


def build_index(vectors: DataFrame, id_col: str, vector_col: str, n_cells: int = 256, folder: str | None = None, sample: int = SAMPLE) -> VectorIndex:
    """Every row of `vectors` with a vector, in its cell. With a `folder` the table is written there, one partition a cell.

    A cell of any size is written by several tasks: rows are rebalanced by cell, and skewed cells are split.
    Rows without a vector, or with a component that is null or not a number, are in no cell and never found.
    """
    centres = fit_cells(vectors, id_col, vector_col, n_cells, sample)

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack(batch.column("_vector").to_numpy(zero_copy_only=False)) if len(batch) else np.empty(centres.shape)
            cells = np.empty(len(batch), np.int32)
            for i in range(0, len(batch), 4096):
                cells[i : i + 4096] = _distances(x[i : i + 4096], centres).argmin(axis=1)
            away = np.sqrt(((x - centres[cells]) ** 2).sum(axis=1))
            keep = [n for n in batch.schema.names if n != "_vector"]
            yield pa.record_batch([*[batch.column(n) for n in keep], pa.array(cells), pa.array(away)], names=[*keep, "cell", "away"])

    usable = vectors.where(F.col(vector_col).isNotNull() & ~F.exists(vector_col, lambda x: x.isNull() | F.isnan(x)))
    if not len(centres):
        usable = usable.limit(0)
    schema = vectors.select("*", F.lit(0).alias("cell"), F.lit(0.0).alias("away")).schema
    rows = usable.withColumn("_vector", F.col(vector_col).cast("array<double>")).mapInArrow(assign, schema)
    if folder is None:
        rows = pin(rows)
    else:
        rows.hint("rebalance", "cell").write.partitionBy("cell").mode("overwrite").parquet(folder)
        rows = vectors.sparkSession.read.parquet(folder)
    sizes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("size"), F.max("away").alias("radius"))
    return VectorIndex(rows, pin(sizes), centres, id_col, vector_col)


def _near_cells(queries: DataFrame, index: VectorIndex, probes: int) -> DataFrame:
    """query_id, cell and gap, the distance below which the cell has no vector, of the `probes` nearest cells of each query."""
    centres, n = index.centres, min(probes, len(index.centres))

    def near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack(batch.column("query_vector").to_numpy(zero_copy_only=False)) if len(batch) else np.empty(centres.shape)
            for i in range(0, len(batch), 1024):
                d = _distances(x[i : i + 1024], centres)
                cells = np.argsort(d, axis=1, kind="stable")[:, :n]
                away = np.sqrt(((x[i : i + 1024, None, :] - centres[cells]) ** 2).sum(axis=2)) if n < len(centres) else np.sqrt(np.take_along_axis(d, cells, 1))
                ids = batch.column("query_id").slice(i, len(d)).take(pa.array(np.repeat(np.arange(len(d)), n)))
                yield pa.record_batch([ids, pa.array(cells.ravel().astype(np.int32)), pa.array(away.ravel())], names=["query_id", "cell", "centre_away"])

    kind = queries.schema["query_id"].dataType.simpleString()
    return queries.select("query_id", "query_vector").mapInArrow(near, f"query_id {kind}, cell int, centre_away double")


def _best_in_cells(index: VectorIndex, probes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest of each part of the probed cells: query_id, id and distance."""
    asked = probes.select("query_id", "cell").join(queries.select("query_id", "query_vector"), "query_id")
    counts = asked.groupBy("cell").agg(F.count(F.lit(1)).alias("asked"))
    plan = index.cells.join(counts, "cell").select(
        "cell", F.ceil(F.col("size") / PART).cast("int").alias("parts"), F.ceil(F.col("asked") / QUERIES).cast("int").alias("blocks")
    )
    plan = pin(plan)
    # One row a cell, and cells are as many as their centres. Named as literals they prune the table's partitions.
    probed = [r["cell"] for r in plan.select("cell").collect()]
    plan = F.broadcast(plan)
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    part = F.pmod(F.xxhash64(index.id_col), F.col("parts")).cast("int")
    stored = index.rows if len(probed) == len(index.centres) else index.rows.where(F.col("cell").isin(probed))
    rows = stored.join(plan, "cell").select(
        "cell", part.alias("part"), upto("blocks").alias("block"), F.col(index.id_col).alias("id"), F.col(index.vector_col).cast("array<double>").alias("vector")
    )
    block = F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")
    asked = asked.join(plan, "cell").select("cell", upto("parts").alias("part"), block.alias("block"), "query_id", "query_vector")

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if len(left) and len(right):
            order = np.argsort(left.column("id").to_numpy(), kind="stable")
            ids = left.column("id").to_numpy()[order]
            x = np.stack(left.column("vector").to_numpy())[order]
            for query, point in zip(right.column("query_id").to_pylist(), right.column("query_vector").to_numpy(), strict=True):
                d = ((x - point) ** 2).sum(axis=1)
                bound = np.partition(d, min(k, len(d)) - 1)[min(k, len(d)) - 1]
                close = np.flatnonzero(d <= bound)
                for i in close[np.argsort(d[close], kind="stable")][:k]:
                    found.append((query, ids[i], float(d[i])))
        q, i, d = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"query_id": pa.array(q, right.schema.field("query_id").type), "id": pa.array(i, left.schema.field("id").type), "distance": pa.array(d, pa.float64())})

    keys = ["cell", "part", "block"]
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {index.rows.schema[index.id_col].dataType.simpleString()}, distance double"
    return rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(nearest, schema)


def _first(rows: DataFrame, k: int) -> DataFrame:
    nearest = Window.partitionBy("query_id").orderBy("distance", "id")
    return rows.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)


def nearest_neighbours(index: VectorIndex, queries: DataFrame, k: int, probes: int = 8, exact: bool = True) -> DataFrame:
    """The k nearest vectors of each query: query_id, rank, id and distance (squared), ties by id.

    `queries` has query_id and query_vector. Without `exact` only the `probes` nearest cells are read.
    With it, the cells that can still hold one of the k nearest are read as well, so results are those of
    a full scan: the distance of a cell's nearest possible point is that of its centre less its radius.
    Queries without a vector, or with a component that is null or not a number, find nothing.
    """
    usable = F.col("query_vector").isNotNull() & ~F.exists("query_vector", lambda x: x.isNull() | F.isnan(x))
    queries = queries.where(usable).select("query_id", F.col("query_vector").cast("array<double>").alias("query_vector"))
    if not len(index.centres):
        queries, probes = queries.limit(0), 1
    first = pin(_near_cells(queries, index, probes))
    found = pin(_first(_best_in_cells(index, first, queries, k), k).select("query_id", "id", "distance"))
    if exact and probes < len(index.centres):
        # A query that has not found k vectors yet takes all cells.
        bound = found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.sqrt(F.max("distance"))).alias("bound"))
        every = _near_cells(queries, index, len(index.centres)).join(F.broadcast(index.cells.select("cell", "radius")), "cell")
        open_cells = every.join(bound, "query_id", "left").where("bound is null or centre_away - radius <= bound * (1 + 1e-9) + 1e-9")
        rest = open_cells.join(first.select("query_id", "cell"), ["query_id", "cell"], "left_anti")
        found = _first(found.unionByName(_best_in_cells(index, pin(rest), queries, k)), k)
    else:
        found = _first(found, k)
    return found.select("query_id", "rank", "id", "distance")


def probes_for_recall(index: VectorIndex, queries: DataFrame, k: int, target: float = 0.95, sample: int = 200) -> int:
    """The least number of probes by which `sample` of the queries, chosen by hashed id, find that share of their k nearest.

    Vectors without clusters need many, well separated ones few. The true neighbours of the sample are
    searched exactly, once; how many probes each needs is the place of its cell among the query's cells.
    """
    few = pin(queries.orderBy(F.xxhash64("query_id")).limit(sample))
    truth = nearest_neighbours(index, few, k).select("query_id", F.col("id").alias(index.id_col))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("centre_away", "cell"))
    cells = _near_cells(few.select("query_id", F.col("query_vector").cast("array<double>").alias("query_vector")), index, len(index.centres))
    needed = truth.join(index.rows.select(index.id_col, "cell"), index.id_col).join(cells.withColumn("place", place), ["query_id", "cell"])
    counts = {r["place"]: r["n"] for r in needed.groupBy("place").agg(F.count(F.lit(1)).alias("n")).collect()}
    found, total = 0, sum(counts.values())
    for probes in sorted(counts):
        found += counts[probes]
        if found >= target * total:
            return probes
    return 1


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Per query the share of its true neighbours that were found; one that has none counts as whole."""
    both = truth.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return both.groupBy("query_id").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))


def indexed_search(index: VectorIndex, queries: DataFrame, as_of, top_k: int = 5, probes: int = 8, exact: bool = True) -> DataFrame:  # noqa: ANN001
    """`batch_search` by index: candidates by distance, reranked by the weights of each query's category.

    `queries` has query_id, query, query_vector and category: null searches all vectors and infers the
    category for its weights; a given one is both a filter and the weights. Filtered queries search an
    index of that category's rows.
    """
    n = candidate_count(top_k)
    near = nearest_neighbours(index, queries, n, probes, exact).withColumnRenamed("id", index.id_col).withColumnRenamed("rank", "_n")
    rows = index.rows.drop("cell", "away", index.vector_col).join(near, index.id_col)
    named = rows.join(queries.select("query_id", "query", F.col("category").alias("asked")), "query_id")
    return rerank_best(named, as_of, top_k)
