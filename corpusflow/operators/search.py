"""Vector search with category-weighted reranking, for one query or a table of queries."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold, tokens
from ..sources.shared import pin

MULTIPLIER, MOST_CANDIDATES = 4, 50
#: Queries that meet a batch of vectors in one matrix product.
QUERIES = 256
# Weights of similarity, freshness and title match by category.
WEIGHTS = {
    "notice": (0.55, 0.30, 0.15),
    "scholarship": (0.50, 0.35, 0.15),
    "materials": (0.60, 0.15, 0.25),
    "faq": (0.80, 0.00, 0.20),
    "academic_schedule": (0.50, 0.25, 0.25),
    "graduation": (0.70, 0.05, 0.25),
    "default": (0.75, 0.10, 0.15),
}
# Words of a query that tell its category, first match wins.
KEYWORDS = {
    "academic_schedule": ("학사일정", "수강신청", "개강", "종강", "시험", "학기"),
    "graduation": ("졸업", "졸업요건", "졸업학점", "학위", "전공학점"),
    "scholarship": ("장학", "장학금", "등록금", "학자금"),
    "materials": ("자료", "자료실", "첨부", "파일", "서식", "양식", "pdf", "hwp"),
    "faq": ("faq", "질문", "답변", "자주 묻는"),
    "notice": ("공지", "공지사항", "모집", "신청", "안내"),
}
# Age in days up to which a text has this freshness.
FRESH = ((365, 1.0), (1095, 0.7), (1825, 0.4))


def candidate_count(top_k: int) -> int:
    return min(max(MULTIPLIER * top_k, top_k), MOST_CANDIDATES)


def distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def similarity(d: Column) -> Column:
    return F.when(d.isNull(), 0.0).otherwise(1 / (1 + F.greatest(d, F.lit(0.0))))


def freshness(published: Column, as_of: Column) -> Column:
    days = F.greatest(F.floor((F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(published.cast("timestamp"))) / 86400), F.lit(0))
    out = F.when(published.isNull(), 0.0)
    for most, value in FRESH:
        out = out.when(days <= most, value)
    return out.otherwise(0.1)


def title_match(query: Column, title: Column) -> Column:
    """Share of the query's tokens that occur in the title."""
    found, low = tokens(query), fold(F.coalesce(title, F.lit("")))
    return F.when(F.size(found) == 0, 0.0).otherwise(F.size(F.filter(found, lambda t: low.contains(t))) / F.size(found))


def infer_category(query: Column, keywords: dict[str, tuple[str, ...]] = KEYWORDS) -> Column:
    low, out = F.lower(query), None
    for name, kws in keywords.items():
        test = F.lit(False)
        for k in kws:
            test = test | low.contains(k)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("default")


def weight(category: Column, which: int) -> Column:
    out = None
    for name, values in WEIGHTS.items():
        if name != "default":
            out = F.when(category == name, values[which]) if out is None else out.when(category == name, values[which])
    return out.otherwise(WEIGHTS["default"][which])


def nearest(vectors: DataFrame, query_vector: list[float], n: int, category: str | None = None) -> DataFrame:
    """The n nearest rows of a category (all, if None), ties by chunk_id. The filter reaches the scan."""
    if not query_vector or n <= 0:
        return vectors.limit(0).withColumn("distance", F.lit(0.0))
    rows = vectors if category is None else vectors.where(F.col("category") == category)
    point = F.array(*[F.lit(float(x)) for x in query_vector])
    return rows.withColumn("distance", distance(F.col("embedding").cast("array<double>"), point)).orderBy("distance", "chunk_id").limit(n)


def rerank(rows: DataFrame, query: Column, category: Column, as_of: Column, order: list[str] | None = None) -> DataFrame:
    """Adds similarity and score, of all candidates; sort by score, similarity, then candidate order."""
    sim = similarity(F.col("distance"))
    score = sim * weight(category, 0) + freshness(F.col("published_at"), as_of) * weight(category, 1) + title_match(query, F.col("title")) * weight(category, 2)
    return rows.withColumn("similarity", sim).withColumn("score", F.round(score, 6))


def search(vectors: DataFrame, query: str, query_vector: list[float], as_of: Column, top_k: int = 5, category: str | None = None) -> DataFrame:
    """The top_k results of one query: over-fetch by distance, rerank, cut."""
    if not query or not 1 <= top_k <= 20:
        raise ValueError("a query and a top_k from 1 to 20 are needed")
    rows = nearest(vectors, query_vector, candidate_count(top_k), category)
    label = F.lit(category) if category else infer_category(F.lit(query))
    return (
        rerank(rows, F.lit(query), label, as_of).orderBy(F.desc("score"), F.desc("similarity"), "distance", "chunk_id").limit(top_k)
        .select("chunk_id", "doc_id", "score", "text", "title", "source_url")
    )


def batch_search(vectors: DataFrame, queries: DataFrame, as_of: Column, top_k: int = 5, most_queries: int = 10_000) -> DataFrame:
    """Top_k results of each row of `queries` (query_id, query, query_vector, category or null).

    Vectors stay where they are: the queries go to every task, each task keeps its own nearest
    candidates of a query (partial top n), and only those are shuffled. More than `most_queries`
    queries go in blocks by hash of query_id, each of which reads the vectors anew; a block's results
    are materialised, so that the driver holds one block of queries at a time.
    """
    blocks = max(1, -(-queries.count() // most_queries))
    if blocks == 1:
        return _search_block(vectors, queries, as_of, top_k)
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    return reduce(DataFrame.unionByName, [pin(_search_block(vectors, queries.where(block == i), as_of, top_k)) for i in range(blocks)])


def _plain(c: Column, size: int) -> Column:
    """Whether a vector has this many components, all finite and of a size whose square is so too."""
    return F.coalesce((F.size(c) == size) & F.forall(c, lambda x: F.coalesce(F.abs(x) < 1e100, F.lit(False))), F.lit(False))


def _nearest_of_batches(blocks, n: int):  # noqa: ANN001, ANN202
    """Per batch of vectors the n nearest of each query, by blocks (category, ids, matrix) of queries.

    A matrix product finds who may be among them, within a tolerance far above its rounding; their
    distances are then summed component by component, as `distance` does.
    """

    def run(frames):  # noqa: ANN001, ANN202
        for pdf in frames:
            every, names, kinds = np.array(pdf["embedding"].tolist(), np.float64), pdf["chunk_id"].to_numpy(), pdf["category"].to_numpy()
            place = np.unique(names, return_inverse=True)[1]
            for category, ids, q in blocks.value:
                rows = np.arange(len(every)) if category is None else np.flatnonzero(kinds == category)
                if not len(rows):
                    continue
                v = every[rows]
                about = (q * q).sum(axis=1)[:, None] + (v * v).sum(axis=1)[None, :]
                rough = about - 2 * (q @ v.T)
                most = np.partition(rough, n - 1, axis=1)[:, n - 1] if len(rows) > n else np.full(len(q), np.inf)
                qi, vi = np.nonzero(rough <= (most + 1e-9 * about.max(axis=1))[:, None])
                d = np.zeros(len(qi))
                for j in range(v.shape[1]):
                    gap = v[vi, j] - q[qi, j]
                    d += gap * gap
                order = np.lexsort((place[rows[vi]], d, qi))
                qi, vi, d = qi[order], vi[order], d[order]
                near = np.arange(len(qi)) - np.searchsorted(qi, qi) < n
                yield pd.DataFrame({"query_id": ids[qi[near]], "chunk_id": names[rows[vi[near]]], "distance": d[near]})

    return run


def _distances(vectors: DataFrame, few: DataFrame) -> DataFrame:
    hit = F.col("q.category").isNull() | (F.col("q.category") == F.col("v.category"))
    far = distance(F.col("v.embedding").cast("array<double>"), F.col("q.query_vector"))
    return vectors.alias("v").join(F.broadcast(few).alias("q"), hit).select("q.query_id", "v.chunk_id", far.alias("distance"))


def _search_block(vectors: DataFrame, few: DataFrame, as_of: Column, top_k: int) -> DataFrame:
    n = candidate_count(top_k)
    size = few.agg(F.max(F.size("query_vector"))).first()[0] or 0
    whole = F.col("query_id").isNotNull() & _plain(F.col("query_vector"), size)
    usual = F.col("chunk_id").isNotNull() & _plain(F.col("embedding").cast("array<double>"), size)
    asked = few.where(whole).select("query_id", "category", "query_vector").toPandas()
    blocks = []
    for category, of in asked.groupby("category", dropna=False):
        matrix, ids = np.array(of["query_vector"].tolist(), np.float64), of["query_id"].to_numpy()
        blocks += [(None if pd.isna(category) else category, ids[k : k + QUERIES], matrix[k : k + QUERIES]) for k in range(0, len(ids), QUERIES)]
    # Vectors and queries that are null, of another size or not finite go by expressions, as they are few.
    pairs = _distances(vectors.where(~usual), few.where(whole))
    odd = few.where(~whole)
    if not odd.isEmpty():
        pairs = pairs.unionByName(_distances(vectors, odd))
    if blocks:
        kind = lambda df, c: df.schema[c].dataType.simpleString()
        bare = vectors.where(usual).select("chunk_id", "category", F.col("embedding").cast("array<double>").alias("embedding"))
        shared = vectors.sparkSession.sparkContext.broadcast(blocks)
        pairs = pairs.unionByName(bare.mapInPandas(_nearest_of_batches(shared, n), f"query_id {kind(few, 'query_id')}, chunk_id {kind(vectors, 'chunk_id')}, distance double"))
    near = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    ranked = pairs.withColumn("_n", F.row_number().over(near)).where(F.col("_n") <= n)  # WindowGroupLimit cuts before the shuffle
    told = vectors.select("chunk_id", "doc_id", "text", "title", "source_url", "published_at")
    found = ranked.join(few.select("query_id", "query", F.col("category").alias("asked")), "query_id").join(told, "chunk_id")
    return rerank_best(found, as_of, top_k)


def rerank_best(candidates: DataFrame, as_of: Column, top_k: int) -> DataFrame:
    """The top_k of each query's candidates (query_id, query, asked, _n by distance) after reranking."""
    scored = rerank(candidates, F.col("query"), F.coalesce("asked", infer_category(F.col("query"))), as_of)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("similarity"), "_n")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k).select(
        "query_id", "rank", "chunk_id", "doc_id", "score", "text", "title", "source_url"
    )
