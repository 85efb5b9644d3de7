"""Queries and operators over the whole of their input, against brute force on small fixtures."""

from pyspark.sql import functions as F

from corpusflow import queries
from corpusflow.operators import crawl, dedup, lookup, search


def test_full_report_counts_versions_and_cleans(spark, tmp_path):
    body = "a paragraph of the announcement with many words in it. " * 10
    links = "".join(f"https://x.example/{i}/{'y' * 80}\n" for i in range(30))  # the cleaner drops lines that are a link
    rows = [
        (1, f"Head\n{body}", "en", "a"), (2, f"Head\n{body}", "en", "a"), (3, f"Head\n{body} appendix", "en", "a"),
        (4, f"Other\n{links}short words", "en", "a"), (5, f"Head\n{body}", "en", "b"), (6, "Head\n" + "entirely different " * 90, "en", "b"),
    ]
    folder = str(tmp_path / "sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    got = {r["source_name"]: tuple(r)[1:] for r in queries.QUERIES["ingest_full_report"](spark, folder).collect()}
    assert got == {"a": (4, 2, 1, 1, 2, 2, "ok"), "b": (2, 2, 0, 0, 3, 3, "ok"), "silent": (0, 0, 0, 0, 0, 0, "no_content_discovered")}
    assert tuple(queries.QUERIES["run_full_totals"](spark, folder).first()) == (3, 6, 4, 1, 1, 5, 5)


def test_context_blocks_all_takes_every_part(spark):
    import re

    folder = "/root/testdata/sf0.01"  # 2,000 parts, of which context_blocks takes 500
    got = queries.QUERIES["context_blocks_all"](spark, folder).collect()
    sizes = [len(re.findall(r"^source_url: ", r["context"], re.M)) for r in got]
    assert sum(sizes) == spark.read.parquet(f"{folder}/part.parquet").count() and max(sizes) <= 10


def test_attachment_titles_all_takes_every_parent(spark, tmp_path):
    spark.createDataFrame([(1, "u", ""), (21, "v", "")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["doc_id"]: r["title"] for r in queries.QUERIES["attachment_titles_all"](spark, str(tmp_path)).collect()}
    assert got == {1: "Title 1", 21: "none"}  # file 1 is linked by both, first by page 1; file 21 by none


def test_batch_search_takes_more_queries_than_a_block(spark):
    vectors = queries.vectors(spark, "/root/testdata/sf0.001").limit(60).localCheckpoint()
    asked = vectors.where("chunk_id % 2 = 0").select(
        F.col("chunk_id").alias("query_id"), F.lit("title alpha2").alias("query"), F.col("embedding").cast("array<double>").alias("query_vector"), F.lit(None).cast("string").alias("category")
    )
    rows = lambda most: sorted(map(tuple, search.batch_search(vectors, asked, queries.as_of(), 3, most).collect()))
    want = rows(10_000)
    assert len(want) == 3 * asked.count() and rows(7) == want


def test_best_match_equals_the_score_of_every_row(spark):
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abc가나", k=rng.randrange(1, 5)))
    entries = [(i, " ".join(word() for _ in range(rng.randrange(1, 4))), rng.choice([None, word() + word()]), str(i)) for i in range(80)] + [(90, "", None, "x"), (91, None, "abab", "y")]
    directory = spark.createDataFrame(entries, "id long, name string, description string, phone string")
    asked = spark.createDataFrame([(i, rng.choice([word(), word() + " " + word() + word() + "?", "", None, "Z" * 9])) for i in range(150)], "query_id int, text string")
    score = lookup.match_score(lookup.keyword(F.col("text")), F.col("name"), F.col("description"))
    pairs = asked.crossJoin(directory.withColumn("name", F.coalesce("name", F.lit("")))).withColumn("score", score).where("score > 0").collect()
    want = {}
    for r in sorted(pairs, key=lambda r: (-r["score"], r["id"])):
        want.setdefault(r["query_id"], (r["score"], r["id"]))
    got = {r["query_id"]: (r["score"], r["id"]) for r in lookup.best_match(asked, directory).collect()}
    assert got == want and len(got) > 50
    assert lookup.best_match(asked, directory.limit(0)).count() == 0


def test_versions_in_rounds_equal_one_stream(spark, monkeypatch):
    import random
    from datetime import datetime

    rng = random.Random(7)
    bases = ["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(230)) for _ in range(14)]
    rows = []
    for i in range(90):
        text = "".join(c if rng.random() > 0.045 else "#" for c in bases[i % 14])
        rows.append((f"d{i}", i, "s" if i % 10 else "t", "html", f"https://a.example/p{i % 3}", "T", text, None, None, None, datetime(2024, 1, 1, 0, rng.randrange(60))))
    schema = (
        "doc_id string, seq long, source_name string, source_type string, source_url string, title string, content string, category string,"
        " department string, published_at timestamp_ntz, collected_at timestamp_ntz"
    )
    kept, want = {}, []
    for r in sorted(rows, key=lambda r: (len(" ".join(r[6].split())), r[10], -r[1]), reverse=True):
        text, path = " ".join(r[6].split()), r[4][17:]
        if not any(dedup.same_document(a, text, p, path) for a, p in kept.setdefault(r[2], [])):
            kept[r[2]].append((text, path))
            want.append(r[0])
    monkeypatch.setattr(dedup, "PART", 20)
    found = lambda block: sorted(r["doc_id"] for r in dedup.version_survivors(spark.createDataFrame(rows, schema), block).collect())
    assert 14 < len(want) < 90 and found(4) == sorted(want) and found(dedup.BLOCK) == sorted(want)


def test_archives_are_bounded(spark, tmp_path, monkeypatch):
    sizes, read = [], queries.archives.archive_members

    def spy(built):
        import io
        import zipfile

        sizes.extend(len(zipfile.ZipFile(io.BytesIO(r["content"])).namelist()) for r in built.collect())
        return read(built)

    monkeypatch.setattr(queries.archives, "archive_members", spy)
    rows = spark.range(2500).selectExpr("id as doc_id", "concat('title ', id) as text", "'en' as lang", "'a' as source")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["zip_members"](spark, str(tmp_path))
    assert sorted(sizes) == [500, 1000, 1000] and got.select("member", "doc_id").distinct().count() == 2500


def test_crawl_goes_to_the_largest_max_depth(spark):
    pages = spark.createDataFrame([(f"https://a.example/p/{i}", [f"/p/{i + 1}"]) for i in range(14)], "url string, links array<string>")
    source = spark.createDataFrame([("s", ["https://a.example/p/0"], 0, 12, True)], "name string, seed_urls array<string>, max_pages int, max_depth int, collect_seed_pages boolean")
    assert sorted(r["depth"] for r in crawl.crawl(pages, source).collect()) == list(range(13))


def test_pages_that_a_crawl_does_not_visit_are_passed_over(spark, monkeypatch):
    """Links are resolved and texts are made of visited pages only, also where pages share a URL."""
    from corpusflow.plans import collect

    n, links_of = F.col("id"), crawl.links_of
    path = lambda k: F.concat(F.lit("/p/"), k)
    visits = [f"https://a.example/p/{i}" for i in range(16)]
    monkeypatch.setattr(crawl, "links_of", lambda base, hrefs: F.when(base.isin(visits), links_of(base, hrefs)).otherwise(F.raise_error(F.concat(F.lit("resolved links of "), base)).cast("array<string>")))
    text = F.when(n < 16, F.concat(F.lit("Question "), n, F.lit("\nAnswer"))).otherwise(F.raise_error(F.concat(F.lit("made the text of "), n)))
    pages = spark.range(1000).select(F.concat(F.lit("https://a.example"), path(n)).alias("url"), F.array(path(n * 2 + 1), path(n * 2 + 2), F.lit("/f/a.pdf")).alias("links"), text.alias("markdown"))
    pages = pages.union(spark.createDataFrame([("https://a.example/p/2/", ["/p/999"], "Late")], pages.schema))  # /p/2 comes first
    sources = spark.createDataFrame([("s", ["https://a.example/p/0"], 0, 3, True), ("t", ["https://a.example/p/7"], 2, 9, True)], "name string, seed_urls array<string>, max_pages int, max_depth int, collect_seed_pages boolean")
    rules = queries.config.rules_from_rows(spark, [{"name": "all", "priority": 1, "url_patterns": ["/p/"], "categories": [], "parser": "faq", "options": {}}])
    got = collect.collect(pages, sources, rules)
    rows = got.visited.collect()
    assert sorted((r["name"], int(r["url"][20:])) for r in rows) == [("s", i) for i in range(15)] + [("t", 7), ("t", 15)]
    assert {r["verdict"] for r in rows} == {"accepted"} and got.documents.where("title = 'Question 2'").count() == 1


def test_urls_are_resolved_alike_one_by_one_and_together(spark):
    from corpusflow.functions import urls

    bases = ["https://a.example/x/y?q#f", "http://b.example", "https://c.example/p/;jsessionid=1#", "/local/path", None]
    hrefs = ["z", "/r/../s/.", "?k=2", "#top", "", "//d.example/e", "mailto:x@y", "../../up/?b=2&a=1#g", "HTTP://E.example/", None]
    d = spark.createDataFrame([(b, hrefs) for b in bases], "b string, hs array<string>")
    each = F.array(*[urls.resolve(F.col("b"), F.lit(h).cast("string")) for h in hrefs])
    for r in d.select(each.alias("each"), urls.resolve_all(F.col("b"), F.col("hs")).alias("all")).collect():
        assert r["each"] == r["all"]


def test_archives_are_read_at_any_depth():
    import io
    import zipfile

    from corpusflow.sources.archives import members_of

    content, name = b"text", "a.md"
    for i in range(6):
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w") as z:
            z.writestr(name, content)
        content, name = packed.getvalue(), f"z{i}.zip"
    assert [(m, c) for m, c in members_of(content)] == [("z4.zip#z3.zip#z2.zip#z1.zip#z0.zip#a.md", b"text")]


def test_hwp_lines_equal_their_rules(spark):
    """The rules told line by line in plain Python, over random lines of noise, words and years."""
    import random
    import re

    from corpusflow.functions import hwp

    rng = random.Random(6)
    pieces = ["가", "나다", "일정 안내", "2024년", "2023-05", "a", "bc", "word", "§§", "::", "비고:", "그림입니다", "12", "(x)", "\x02", "ㄱ", "…", "  "]
    lines = [" ".join(rng.choices(pieces, k=rng.randrange(1, 9))) for _ in range(1500)]

    def measure(t):
        found = re.findall(f"[0-9{hwp.LETTERS}]+", t)
        return len(found), sum(len(x) <= 2 for x in found), sum(map(len, found))

    def rule(line):
        line = " ".join(re.sub(hwp.CONTROL, " ", line).split())
        if re.search(hwp.IMAGE_MARKS, line.lower()):
            return None
        line = " ".join(re.sub(f"[^0-9{hwp.LETTERS}{hwp.STAYING}]", " ", line).split())
        n, short, _ = measure(line)
        if not re.search("[0-9]", line) and (n >= 3 and short >= 0.8 * n or 0 < n < 3 and short == n and len(line) <= 10):
            return None
        year = re.search(hwp.YEAR, line)
        if year:
            before = line[: year.start()].strip()
            n, short, told = measure(before)
            if ":" not in before and (n and short >= 0.6 * n or len(before) < 2 or told < 0.35 * len(before)):
                line = line[year.start() :]
        line = re.sub(f"^(?:[{hwp.LETTERS}]\\s+){{1,8}}(?=[0-9]{{4}})", "", line).strip()
        return line if len(line) >= 2 and measure(line)[2] and measure(line)[2] >= 0.35 * len(line) else None

    frame = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string")
    got = dict(frame.select("i", hwp.clean_lines(F.col("x"))).collect())
    assert [got[i] for i in range(len(lines))] == [rule(x) or "" for x in lines]


def test_context_blocks_of_many_results(spark):
    """Long lists are gone through once: 100,000 results of one query, of which each URL is named once."""
    import time

    from corpusflow.operators import routing

    rows = spark.range(100_000).selectExpr("1 as query_id", "id as rank", "'t' as title", "concat('u', id % 40000) as source_url", "0.5D as score", "'x' as text")
    begun = time.time()
    got = routing.context_blocks(rows).first()
    assert time.time() - begun < 60
    assert got["context"].count("source_url: ") == 100_000 and got["sources"].split("\n") == [f"- t: u{i}" for i in range(40_000)]


def test_batch_search_multiplies_matrices_and_keeps_odd_vectors(spark, monkeypatch):
    """Plain vectors never meet queries pair by pair; null, short and huge ones still do, with the same results."""
    from corpusflow.operators import search

    rows = [(i, i, "x", "title", "u", None, "ab"[i % 2], [float(i % 17), float(i % 5), 0.1 * i]) for i in range(200)]
    rows += [(200, 0, "x", "t", "u", None, "a", None), (201, 0, "x", "t", "u", None, "a", [1.0]), (202, 0, "x", "t", "u", None, "b", [1e200, 0.0, 0.0]), (203, 0, "x", "t", "u", None, "b", [3.0, 3.0, 0.3])]
    stored = spark.createDataFrame(rows, "chunk_id long, doc_id long, text string, title string, source_url string, published_at timestamp_ntz, category string, embedding array<double>")
    asked = [(i, "title", [float(i % 17), float(i % 5), 0.1 * i], None if i % 3 else "b") for i in range(0, 60, 3)] + [(61, "title", [1.0, 2.0, 3.0], None), (62, "title", None, "a")]
    asked = spark.createDataFrame(asked, "query_id long, query string, query_vector array<double>, category string")
    far = search.distance(search.F.col("v.embedding"), search.F.col("q.query_vector"))
    pairs = stored.alias("v").join(asked.alias("q"), search.F.expr("q.category is null or q.category = v.category")).select("q.query_id", "q.query", search.F.col("q.category").alias("asked"), "v.*", far.alias("distance"))
    n = search.F.row_number().over(search.Window.partitionBy("query_id").orderBy("distance", "chunk_id"))
    as_of = search.F.lit("2024-01-01").cast("timestamp_ntz")
    want = search.rerank_best(pairs.withColumn("_n", n).where("_n <= 12"), as_of, 3)
    met, plain = [], search._distances
    monkeypatch.setattr(search, "_distances", lambda v, q: met.append((v.count(), q.count())) or plain(v, q))
    got = search.batch_search(stored, asked, as_of, 3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and met == [(3, 21), (204, 1)]


def test_hwp_lines_evaluate_each_rule_once(spark):
    """A lambda's values are evaluated at each use, so a value that is used five times must be written once."""
    from corpusflow.functions import hwp

    frame = spark.createDataFrame([(1, "원본\x01\t그림의 이름 1024\r\n12345\x85word  IMAGEready one one★\x0btwo 2024년\n프로그램★이름 값"), (2, None)], "i int, x string")
    cleaned = hwp.clean_lines(F.col("x")).alias("cleaned")
    assert dict(frame.select("i", cleaned).collect()) == {1: "12345\none two 2024년\n프로그램 이름 값", 2: None}
    plan = frame.select(cleaned)._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all(") == 2 and plan.count("regexp_replace(") == 2  # 9 and 17 before
