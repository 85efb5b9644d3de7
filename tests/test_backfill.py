"""Global positions, running sums, and backfill runs that break and go on."""

import random

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import rank
from corpusflow.plans.backfill import BackfillOptions, backfill
from corpusflow.sources.services import hashing_encoder

CHUNK = "chunk_id string, doc_id string, chunk_index int, status string, last_seen_at timestamp_ntz, text string, title string, source_url string, source_type string"


@pytest.mark.parametrize("n", [0, 1, 7, 3000])
def test_positions_and_running_sums(spark, n):
    rng = random.Random(n)
    rows = [(i, rng.choice([None, "a", "b", "c"]), rng.choice([None, 0, 1, 5])) for i in range(n)]
    df = spark.createDataFrame(rows, "id int, k string, v int").withColumn("_x", F.lit(1))
    want = sorted(rows, key=lambda r: (r[1] is not None, "" if r[1] is None else "".join(chr(255 - ord(c)) for c in r[1]), r[0]))
    order = [F.desc_nulls_first("k"), F.asc("id")]
    got = {r["id"]: r["position"] for r in rank.with_position(df, order).collect()}
    assert got == {r[0]: i + 1 for i, r in enumerate(want)}
    sums, total = {}, 0
    for i, r in enumerate(want):
        total += r[2] or 0
        sums[r[0]] = (i + 1, total)
    found = rank.with_running_sum(df, order, F.coalesce("v", F.lit(0)), "upto")
    assert {r["id"]: (r["position"], r["upto"]) for r in found.collect()} == sums


def stored(spark):
    rows = []
    for i in range(40):
        seen = None if i == 39 else f"2024-01-{1 + i % 9:02d} 00:00:00"
        rows.append((f"c{i:02d}", f"d{i % 5}", i, "updated" if i % 10 == 9 else "active", seen, "" if i % 7 == 0 else f"whole text number {i}", "t", "https://a.example/", "html"))
    chunks = spark.createDataFrame([(*r[:4], None, *r[5:]) for r in rows], CHUNK).drop("last_seen_at")
    seen = spark.createDataFrame([(r[0], r[4]) for r in rows], "chunk_id string, s string")
    chunks = chunks.join(seen, "chunk_id").withColumn("last_seen_at", F.col("s").cast("timestamp_ntz")).drop("s")
    docs = spark.createDataFrame([(f"d{i}", "s1" if i < 2 else "s2", None) for i in range(4)], "doc_id string, source_name string, published_at timestamp_ntz")
    active = [r for r in rows if r[3] == "active" and r[1] != "d4"]
    order = sorted(active, key=lambda r: r[0])
    order = sorted(order, key=lambda r: r[4] or "", reverse=True)
    return chunks, docs, order


def walk(order, have, limit, size):
    """The counts of one run, row by row."""
    selected = embedded = skipped = at = 0
    made = []
    while selected < limit and at < len(order):
        batch = order[at : at + size]
        at += len(batch)
        for r in batch:
            if r[0] in have:
                skipped += 1
            elif selected >= limit:
                break
            else:
                selected += 1
                if r[5]:
                    embedded += 1
                    made.append(r[0])
                else:
                    skipped += 1
    return (selected, embedded, skipped), made


def counts(row):
    return tuple(row[c] for c in ("selected", "embedded", "skipped_existing"))


def test_runs_count_as_a_walk_row_by_row(spark, tmp_path):
    chunks, docs, order = stored(spark)
    folder, have = str(tmp_path), set()
    for limit, size in ((6, 4), (5, 100), (100, 9)):  # each run finds the vectors of those before
        want, made = walk(order, have, limit, size)
        got = backfill(chunks, docs, folder, BackfillOptions(limit=limit, batch_size=size)).first()
        have |= set(made)
        assert counts(got) == want and got["failed"] == 0
        rows = spark.read.parquet(f"{folder}/vectors").collect()
        assert sorted(r["chunk_id"] for r in rows) == sorted(have) and all(len(r["embedding"]) == 64 for r in rows)


def test_a_broken_run_goes_on_where_it_stopped(spark, tmp_path):
    chunks, docs, order = stored(spark)
    folder, stop = str(tmp_path / "job"), order[11][5] or order[12][5]

    def broken(texts):
        if stop in texts:
            raise RuntimeError("model is gone")
        return hashing_encoder()(texts)

    first = backfill(chunks, docs, folder, BackfillOptions(limit=20, batch_size=5, encoder=broken)).first()
    assert first["failed"] == 1 and first["batches"] == 2 and counts(first) == walk(order[:10], set(), 20, 5)[0]
    # The table of vectors also holds what a batch wrote whose line of the journal was lost.
    vectors = spark.read.parquet(f"{folder}/vectors")
    lost = vectors.limit(1).withColumn("chunk_id", F.lit(next(r[0] for r in order[10:15] if r[5])))
    lost.write.mode("append").parquet(f"{folder}/vectors")
    second = backfill(chunks, docs, folder, BackfillOptions(limit=20, batch_size=5)).first()
    want, made = walk(order, set(), 20, 5)
    assert second["failed"] == 0 and counts(second) == want
    assert sorted(r["chunk_id"] for r in spark.read.parquet(f"{folder}/vectors").collect()) == sorted(made)
    third = backfill(chunks, docs, folder, BackfillOptions(limit=100, batch_size=50)).first()
    assert counts(third) == walk(order, set(made), 100, 50)[0]


def test_one_source_and_bad_settings(spark, tmp_path):
    chunks, docs, order = stored(spark)
    backfill(chunks, docs, str(tmp_path), BackfillOptions(limit=100, batch_size=50, source_name="s1"))
    got = {r["chunk_id"] for r in spark.read.parquet(f"{tmp_path}/vectors").collect()}
    assert got == {r[0] for r in order if r[1] in ("d0", "d1") and r[5]}
    with pytest.raises(ValueError, match="positive"):
        backfill(chunks, docs, str(tmp_path), BackfillOptions(limit=0))


def test_totals_before_a_partition_come_from_one_pass(spark):
    dealt = spark.createDataFrame([(3, 1), (3, None), (5, 4), (9, None)], "_part int, v long")
    found = rank._before(dealt, rows=F.count(F.lit(1)), total=F.sum("v"))  # one total a pass before
    assert sorted(map(tuple, found.collect())) == [(3, 0, 0), (5, 2, 1), (9, 3, 5)]
