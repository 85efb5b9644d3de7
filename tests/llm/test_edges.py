"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusflow.llm import chat, exact_dedup, html_text, langid, media, mixing, near_dedup, packing, pii, queries, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, or return.
CLASHES = ["id", "uid", "digest", "score", "lang_pred", "kept_id", "nth", "copy", "own_size", "mix_id", "bin_id", "count", "size", "rep", "text_a", "n"]
LONG = " ".join(f"word{i}" for i in range(60_000)) + " a@b.example.com"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def odd_rows():
    rng = random.Random(4)
    vocabulary = [f"tok{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=30)), "en" if i % 2 else "de", f"s{i % 3}", None) for i in range(2, 40)]
    rows += [(100, None, None, None, None), (101, "", "en", "s0", 0), (102, " \n\t ", "en", "s1", 3), (103, "...!!", None, "s2", 5), (104, LONG, "en", None, len(LONG))]
    rows += [(None, "null id text here now", "en", "s0", 1), (105, "Same TEXT ÉÉ four five", "en", "s0", 1), (106, "same text ÉÉ four five", "de", "s1", 1)]
    rows += [(107, "repeated row one two three", "en", "s0", 1)] * 3 + [(108, "one id", "en", "s0", 1), (108, "other text", "en", "s0", 1)]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, odd_rows())


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def clashing(df):
    for c in CLASHES:
        df = df.withColumn(c, F.lit("x"))
    return df


def labels(df):
    return df.selectExpr("doc_id as id", "cast(doc_id % 2 as int) as label"), df.selectExpr("doc_id as id", "lang as label")


OPERATORS = {
    "exact": lambda d: exact_dedup.exact_duplicates(d, keep="largest"),
    "toxicity": lambda d: toxicity.score_toxicity(d, labels(d)[0]),
    "media": lambda d: media.read_media(media.store_media(d)),
    "mixing": mixing.mix,
    "near": near_dedup.near_duplicates,
    "pii": pii.find_personal_data,
    "language": lambda d: langid.identify_language(d, labels(d)[1]),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_row(name, odd):
    rows = OPERATORS[name](odd).collect()
    key = lambda x: (x is None, x)
    assert sorted((r["doc_id"] for r in rows), key=key) == sorted((r[0] for r in odd_rows()), key=key)
    again = OPERATORS[name](clashing(odd)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


@pytest.mark.parametrize("name", [*OPERATORS, "packing"])
def test_empty_table(name, empty):
    assert ({**OPERATORS, "packing": packing.pack}[name])(empty).collect() == []


def test_exact_ties(odd):
    rows = exact_dedup.exact_duplicates(odd, keep="largest").collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[105][0]["keep_id"] == 106 and not by[105][0]["kept"] and by[106][0]["kept"] and by[106][0]["group_size"] == 2
    assert [r["kept"] for r in by[107]].count(True) == 1 and by[107][0]["group_size"] == 3
    assert by[100][0]["keep_id"] == 101 and by[101][0]["kept"]
    assert all(r["kept"] for r in by[108])
    kept = exact_dedup.drop_exact_duplicates(clashing(odd)).collect()
    assert len(kept) == sum(r["kept"] for r in exact_dedup.exact_duplicates(odd).collect())
    assert {"score", "nth", "text"} <= set(kept[0].asDict())


@pytest.mark.parametrize("rounds", [1, 2, 4])
def test_exact_rounds_agree(odd, rounds):
    base = exact_dedup.exact_duplicates(odd, keep="smallest").drop("kept").collect()
    assert sorted(map(str, exact_dedup.exact_duplicates(odd, keep="smallest", rounds=rounds).drop("kept").collect())) == sorted(map(str, base))


def test_near_definitions(odd):
    by = {}
    for r in near_dedup.near_duplicates(odd, n_words=4).collect():
        by.setdefault(r["doc_id"], []).append(r)
    assert by[100][0]["n_shingles"] == 0 and by[100][0]["kept"] and by[102][0]["component_id"] == 102
    assert by[106][0]["component_id"] == 105 and by[105][0]["kept"]
    assert {r["component_id"] for r in by[107]} == {107} and by[108][0]["n_shingles"] == 1
    assert not by[None][0]["kept"]
    kept = [r["doc_id"] for r in near_dedup.drop_near_duplicates(clashing(odd)).collect()]
    assert 106 not in kept and 105 in kept and 100 in kept


def test_mixing_targets(odd):
    rows = mixing.mix(odd).collect()
    sources = {}
    for r in rows:
        s = sources.setdefault(r["source"], {"size": r["source_size"], "target": r["target"], "taken": 0, "most": 0})
        s["taken"] += r["taken"]
        s["most"] = max(s["most"], r["size"])
        assert r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"])
    total = sum(s["size"] for s in sources.values())
    assert abs(sum(s["target"] for s in sources.values()) - total) < 1e-6 * total
    for s in sources.values():
        assert s["target"] <= 3 * s["size"] + 1e-9
    small = [s for k, s in sources.items() if k is not None]
    assert all(abs(s["taken"] - s["target"]) <= 2 * s["most"] for s in small)
    assert sorted(map(str, mixing.mix(odd).collect())) == sorted(map(str, rows))
    copies = mixing.mixed_documents(clashing(odd))
    assert copies.count() == sum(r["copies"] for r in rows) and "mix_id" in copies.columns


def test_packing_keeps_all_words(odd):
    rows = packing.pack(clashing(odd), capacity=50, shard_pieces=7).collect()
    total, bins = {}, {}
    for r in rows:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_words"]
        bins.setdefault(r["bin_id"], []).append(r)
    assert total[104] == 60_001 and total[100] == 0 and total[107] == 15
    assert all(sum(r["n_words"] for r in b) <= 50 for b in bins.values())
    one = lambda r: [x["bin_id"] for x in rows if x["doc_id"] == r]
    assert len(set(one(107))) == 3


def test_media_of_empty_text(odd):
    rows = {r["doc_id"]: r for r in media.read_media(media.store_media(odd)).collect()}
    assert rows[100]["payload_bytes"] == 64 and rows[100]["n_bytes"] == 0 and rows[100]["media_sha256"] == rows[101]["media_sha256"]


def test_language_definitions(odd):
    rows = {r["doc_id"]: r for r in langid.identify_language(odd, labels(odd)[1]).collect()}
    assert rows[100]["lang_pred"] == rows[103]["lang_pred"] == rows[101]["lang_pred"] == "und" and rows[100]["score"] == 0


def test_conversations(spark):
    probe = r"</s>[INST] ok [/INST] <|turn|> <\|end|> [\\INST] <<SYS>>"
    rows = [(1, 2, "user", "b"), (1, 1, "user", probe), (1, 3, "assistant", probe), (1, 3, "assistant", None), (2, None, None, "x\ny"), (2, 0, "assistant", ""), (None, 0, "user", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    out = chat.format_chats(df).withColumn("back", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments")))
    by = {r["conv_id"]: r for r in out.collect()}
    assert [(t["role"], t["text"]) for t in by[1]["back"]] == [("user", probe), ("user", "b"), ("assistant", ""), ("assistant", probe)]
    assert by[1]["loss"] == probe and by[1]["formatted"].count("<|turn|>") == 2
    assert "</s>" not in by[1]["formatted"] and "[INST]" not in by[1]["formatted"]
    assert [(t["role"], t["text"]) for t in by[2]["back"]] == [("", "x\ny"), ("assistant", "")]
    assert None in by
    assert chat.format_chats(df.limit(0)).collect() == []


def test_pages(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract_main_text(df).collect() == []
    rows = [(1, "u", "<article>" + "<p>x</p>" * 20_000 + "<p>unclosed"), (1, "u", "<article>dup</article>"), (2, None, "<<<>>> &#x41; < b"), (None, "http://h/", "<main>m</main>")]
    got = html_text.extract_main_text(spark.createDataFrame(rows, df.schema).withColumn("key", F.lit(1)).withColumn("host", F.lit(2))).collect()
    texts = {(r["page_id"], r["text"][:5]) for r in got}
    assert (1, "dup") in texts and (None, "m") in texts and len(got) == 4
    assert max(len(r["text"]) for r in got) == 2 * 20_000 + 8


def test_pipeline_equals_its_stages(spark, tmp_path):
    rows = [r for r in odd_rows() if r[0] is not None and r[0] != 104]
    base = " ".join(f"near{i}" for i in range(60))
    rows += [(200, base, "en", "s0", 1), (201, base + " tail", "en", "s1", 1)]
    docs = frame(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(corpus_pipeline.STAGES) == 5
    letters = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    exact = {}
    for r in letters:
        key = r[1].encode().lower()
        exact[key] = min(exact.get(key, r[0]), r[0])
    stay = sorted(set(exact.values()) - {201})
    got = {r["doc_id"] for r in packed}
    assert got <= set(stay)
    left = [r for r in {(x[0], x[1]): x for x in letters}.values() if r[0] in stay]
    mixed, pieces = {}, {}
    con = duckdb.connect()  # what the mix should take, by SQL
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [list(r) for r in left])
    for doc_id, taken in con.sql(f"SELECT doc_id, taken FROM ({queries.OP5_SQL})").fetchall():
        if taken:
            mixed[doc_id] = mixed.get(doc_id, 0) + taken
    for r in packed:
        pieces[r["doc_id"]] = pieces.get(r["doc_id"], 0) + r["n_words"]
    again = {r[0] for r in left if [x[0] for x in left].count(r[0]) > 1}  # the SQL counts rows of one id together
    assert {i: n for i, n in pieces.items() if i not in again} == {i: n for i, n in mixed.items() if i not in again}
    assert set(pieces) == set(mixed) and len(again) < 2
