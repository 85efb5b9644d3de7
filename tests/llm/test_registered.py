"""Registered queries against labels, splits and SQL; parsing against brute force."""

import glob
import os
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.llm import exact_dedup, langid, queries, sampling, toxicity

SF = "/root/testdata/sf0.01"


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


@pytest.fixture(scope="module")
def scored(spark):
    return {r["doc_id"]: r for r in queries.op2_toxicity(spark, SF).collect()}


def test_op2_split_and_quality(spark, scored):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(r["held_out"] == held(i) and r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for i, r in scored.items())
    judged = [(labels[i], r["predicted"]) for i, r in scored.items() if held(i) and labels.get(i) is not None]
    toxic = [p for y, p in judged if y == 1]
    assert sum(toxic) >= 0.6 * len(toxic) and sum(p for y, p in judged if y == 0) <= 0.02 * len(judged)


def test_op2_never_learns_from_held_out_labels(spark, scored, tmp_path):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic"))
    labels.withColumn("toxic", turned.cast("int")).write.parquet(f"{tmp_path}/labels.parquet")
    spark.read.parquet(f"{SF}/documents.parquet").withColumn("lang", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    again = {r["doc_id"]: r["score"] for r in queries.op2_toxicity(spark, str(tmp_path)).collect()}
    assert again == {i: r["score"] for i, r in scored.items()}


def test_field_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(2)
    n, size, width = 4, 5, 6
    x, y = rng.integers(0, n + 1, (size, width, 3)), rng.integers(0, 2, (size, width))
    live = np.arange(width)[None, :] < rng.integers(1, width + 1, size)[:, None]
    y = y * live
    params = rng.normal(0, 1, n + 5)

    def loss(p):
        total = 0.0
        for k in range(size):
            m = int(live[k].sum())
            e = np.append(p[:n], 0)[x[k]].sum(axis=1) + p[n]
            value = lambda tags: sum(e[i] for i in range(m) if tags[i]) + sum(p[n + 1 :].reshape(2, 2)[a, b] for a, b in zip(tags, tags[1:]))
            ways = [value([c >> i & 1 for i in range(m)]) for c in range(2**m)]
            total += np.logaddexp.reduce(ways) - value(list(y[k, :m]))
        return total / size + 0.5e-4 * (p**2).sum()

    got = toxicity._gradient(params, x, y, live, n)
    for i in range(len(params)):
        up, down = params.copy(), params.copy()
        up[i], down[i] = up[i] + 1e-5, down[i] - 1e-5
        assert abs((loss(up) - loss(down)) / 2e-5 - got[i]) < 1e-6


def test_op7_equals_sql(spark):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = sorted(con.sql(queries.OP7_SQL).fetchall())
    assert sorted(map(tuple, queries.op7_near_dedup(spark, SF).select("doc_id", "n_shingles", "component_id", "kept").collect())) == want


def test_cross_parsing_of_long_texts_equals_brute_force():
    """Phrases end at every 256 characters; within these they are the longest matches, and an unknown letter is one."""
    rng = np.random.default_rng(3)
    train = "".join(rng.choice(list("abcde "), 900))
    probe = train[100:500] + "".join(rng.choice(list("abcdef "), 700))
    alphabet = langid.Alphabet("abcde", "f")
    table, keys, ends = langid.split_automaton(alphabet.codes(train).tolist(), alphabet.pad + 1)
    table[:, alphabet.pad] = np.arange(len(table))
    x = alphabet.codes(probe)
    got = langid.parse_costs([x], [table], alphabet.pad, [(keys, ends)])[0, 0]
    known, phrases = bytes(alphabet.codes(train)), 0
    for a in range(0, len(x), langid.STRETCH):
        part, at = bytes(x[a : a + langid.STRETCH]), 0
        while at < len(part):
            n = 1
            while at + n < len(part) and part[at : at + n + 1] in known:
                n += 1
            phrases += 1
            at += n
    assert abs(got * len(x) - phrases) < 1e-6


def test_every_label_is_sampled_with_whole_texts(spark):
    rows = [(i, f"l{i % 700}", f"text {i} " * (1 + i % 50)) for i in range(2100)] + [(9000, "long", "word " * 20_000)]
    frame = spark.createDataFrame(rows, "id long, label string, text string")
    got = sampling.bounded_sample(frame.select("id", "label"), frame.select("id", "text"), 2, 5000, 300_000)
    texts = {i: t for i, _, t in rows}
    assert {g[0] for g in got} == {r[1] for r in rows} and all(texts[i] == t for _, i, t in got)
    assert max(np.unique([g[0] for g in got], return_counts=True)[1]) <= 2


def test_rows_of_one_id_with_kept_and_dropped_texts(spark):
    rows = [(1, "same"), (2, "SAME"), (2, "other"), (3, "other"), (4, "x"), (4, "x"), (None, "x"), (None, "y"), (None, None), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r[0], r[1]) for r in exact_dedup.drop_exact_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, "same"), (2, "other"), (4, "x"), (None, "y"), (5, None)], key=str)


def test_roles_with_line_feeds(spark):
    from corpusflow.llm import chat

    rows = [(1, 0, "a\nb", "x"), (1, 1, "a\nb", "y"), (1, 2, "50%\n%0A", "z")]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    back = out.select(chat.read_turns(F.col("formatted")).alias("t")).first()["t"]
    assert [(t["role"], t["text"]) for t in back] == [(r[2], r[3]) for r in rows]
