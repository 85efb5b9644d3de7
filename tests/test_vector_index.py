"""The inverted file against a full scan: exact results, recall of probes, odd vectors, cells as partitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.operators import search, vector_index

SF = "/root/testdata/sf0.1"


def brute(vectors, queries, k):
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids], float)
    out = {}
    for q, v in queries.items():
        d = ((x - np.array(v, float)) ** 2).sum(axis=1)
        out[q] = [int(ids[i]) for i in np.argsort(d, kind="stable")[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")


@pytest.fixture(scope="module")
def asked(table):
    return table.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


@pytest.fixture(scope="module")
def stored(spark, table, tmp_path_factory):
    return vector_index.build_index(table, "vec_id", "embedding", 32, str(tmp_path_factory.mktemp("index")))


def test_exact_search_and_recall_of_probes(table, asked, stored):
    vectors = {r["vec_id"]: r["embedding"] for r in table.collect()}
    queries = {r["query_id"]: r["query_vector"] for r in asked.collect()}
    want = brute(vectors, queries, 10)
    exact = vector_index.nearest_neighbours(stored, asked, 10, probes=2)
    assert found(exact) == want
    probes = vector_index.probes_for_recall(stored, asked, 10, sample=20)
    assert 1 <= probes < 32
    probed = vector_index.nearest_neighbours(stored, asked, 10, probes, exact=False)
    share = vector_index.recall(probed, exact).agg(F.avg("recall")).first()[0]
    assert share >= 0.9
    assert share == pytest.approx(np.mean([len(set(w) & set(found(probed)[q])) / 10 for q, w in want.items()]))


def test_every_vector_is_in_the_cell_of_its_nearest_centre(table, stored):
    rows = stored.rows.collect()
    assert len(rows) == table.count()
    for r in rows[::37]:
        d = ((stored.centres - np.array(r["embedding"], float)) ** 2).sum(axis=1)
        assert d[r["cell"]] == pytest.approx(d.min()) and r["away"] == pytest.approx(np.sqrt(d.min()))
    assert {(r["cell"], r["size"]) for r in stored.cells.collect()} == {(c, sum(r["cell"] == c for r in rows)) for c in {r["cell"] for r in rows}}


def test_cells_prune_partitions(stored):
    plan = stored.rows.where(F.col("cell").isin([1, 2]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan


@pytest.mark.parametrize("cells", [1, 5, 1000])
def test_ties_odd_vectors_and_small_parts(spark, monkeypatch, cells):
    monkeypatch.setattr(vector_index, "PART", 7)
    monkeypatch.setattr(vector_index, "QUERIES", 3)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 3, (60, 4)).astype(float)  # many equal vectors and equal distances
    vectors = {i: [float(x) for x in v] for i, v in enumerate(base)}
    rows = [*vectors.items(), (900, None), (901, [None, 1.0, 1.0, 1.0]), (902, [float("nan")] * 4)]
    queries = {i: [float(x) for x in rng.normal(size=4)] for i in range(8)} | {8: vectors[3]}
    df = spark.createDataFrame(rows, "k long, v array<double>").withColumn("distance", F.lit("x"))
    q = spark.createDataFrame([*queries.items(), (99, None), (98, [float("nan")] * 4)], "query_id long, query_vector array<double>")
    index = vector_index.build_index(df, "k", "v", cells)
    assert found(vector_index.nearest_neighbours(index, q, 5, probes=1)) == brute(vectors, queries, 5)
    assert found(vector_index.nearest_neighbours(index, q, 100, probes=1)) == brute(vectors, queries, 100)
    assert found(vector_index.nearest_neighbours(index, q.limit(0), 5)) == {}


def test_empty_table(spark):
    df = spark.createDataFrame([], "k long, v array<float>")
    q = spark.createDataFrame([(1, [1.0])], "query_id long, query_vector array<double>")
    index = vector_index.build_index(df, "k", "v", 8)
    assert found(vector_index.nearest_neighbours(index, q, 5)) == {}
    assert vector_index.probes_for_recall(index, q, 5) == 1


def test_clustered_vectors_need_few_probes(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(20, 8)) * 10
    df = spark.createDataFrame([(i, [float(x) for x in base[i % 20] + rng.normal(size=8)]) for i in range(1000)], "k long, v array<double>")
    q = df.where("k % 50 < 3").selectExpr("k as query_id", "v as query_vector")
    index = vector_index.build_index(df, "k", "v", 20)
    probes = vector_index.probes_for_recall(index, q, 10)
    exact = vector_index.nearest_neighbours(index, q, 10, probes)
    assert probes <= 5
    assert vector_index.recall(vector_index.nearest_neighbours(index, q, 10, probes, exact=False), exact).agg(F.avg("recall")).first()[0] >= 0.9


def test_indexed_search_equals_batch_search(spark, table, asked):
    named = table.select(
        F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("doc_id"), "embedding", F.lit("c").alias("category"), F.concat(F.lit("장학 "), F.col("vec_id") % 3).alias("title"),
        F.lit("t").alias("text"), F.lit("u").alias("source_url"), F.lit("2024-01-01").cast("timestamp_ntz").alias("published_at"),
    )
    texts = F.get(F.array(*[F.lit(w[0]) for w in search.KEYWORDS.values()], F.lit("other")), (F.col("query_id") / 50 % 7).cast("int"))
    questions = asked.limit(14).withColumn("query", F.concat(texts, F.lit(" 1 2"))).withColumn("category", F.lit(None).cast("string"))
    when = F.lit("2025-06-01").cast("timestamp_ntz")
    index = vector_index.build_index(named, "chunk_id", "embedding", 16)
    left = vector_index.indexed_search(index, questions, when, 4, probes=2)
    right = search.batch_search(named, questions.withColumn("query_vector", F.col("query_vector").cast("array<double>")), when, 4)
    assert sorted(map(tuple, left.collect())) == sorted(map(tuple, right.collect()))
