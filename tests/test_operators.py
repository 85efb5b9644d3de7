import io
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import catalog, chunking, crawl, dedup, lookup, parsing, routing, search, store, weather
from corpusflow.plans import ingest
from corpusflow.sources import archives, config, services

DOC = (
    "doc_id string, seq long, source_name string, source_type string, source_url string, title string, content string, category string, department string,"
    " published_at timestamp_ntz, collected_at timestamp_ntz, author_department string"
)


def docs(spark, *rows):
    base = dict(source_name="s", source_type="html", source_url="https://a.example/p", title="T", content="c", category=None, department=None, published_at=None, collected_at=datetime(2024, 1, 1), author_department=None)
    names = [f.split()[0] for f in DOC.split(", ")]
    full = [{**base, "doc_id": f"d{i}", "seq": i, **r} for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], DOC)


def ids(df, column="doc_id"):
    return sorted(r[column] for r in df.collect())


def test_exact_duplicates_keep_the_latest(spark):
    d = docs(spark, {"content": "Same  text"}, {"content": "same text", "collected_at": datetime(2024, 1, 2)}, {"content": "other"})
    assert ids(dedup.exact_survivors(d)) == ["d1", "d2"]
    assert ids(dedup.exact_survivors(docs(spark, {"content": "x"}, {"content": "x"}))) == ["d0"]


def test_versions(spark):
    long = "paragraph of the announcement with many words in it. " * 10
    d = docs(spark, {"content": long + " appendix", "source_type": "pdf"}, {"content": long}, {"content": "short one"}, {"content": "entirely different " * 20})
    assert ids(dedup.version_survivors(d)) == ["d1", "d2", "d3"]
    m = dedup.dedup_metrics(d, dedup.exact_survivors(d), dedup.version_survivors(d)).first()
    assert (m["total_input"], m["total_output"], m["exact_duplicates_removed"], m["version_duplicates_removed"]) == (4, 3, 0, 1)
    per_source = docs(spark, {"content": "x"}, {"content": "x", "source_name": "t"})
    assert ids(dedup.version_survivors(per_source)) == ["d0", "d1"]


def test_same_document_is_exact_sequence_matching():
    from difflib import SequenceMatcher
    import random

    rng = random.Random(1)
    for _ in range(60):
        a = "".join(rng.choice("abcd ") for _ in range(rng.randrange(200, 320)))
        b = "".join(c if rng.random() > 0.04 else "z" for c in a)
        want = SequenceMatcher(a=a, b=b).ratio() >= 0.92
        assert dedup.same_document(a, b, "/p", "/q") == want


def test_chunks(spark):
    rows = chunking.chunk_documents(docs(spark, {"content": "A" * 18}, {"content": ""}), 10, 2).collect()
    assert [(r["chunk_id"], r["text"]) for r in rows] == [("d0-chunk-0", "A" * 10), ("d0-chunk-1", "A" * 10)]
    for size, overlap in ((0, 0), (100, -1), (100, 100)):
        with pytest.raises(ValueError):
            chunking.check_options(size, overlap)


def test_embedding_quota(spark):
    rows = [(f"c{i}", "s", i, "pdf" if i in (3, 4, 5) else "html", "u") for i in range(7)]
    c = spark.createDataFrame(rows, "chunk_id string, source_name string, seq long, source_type string, source_url string")
    pick = lambda a, b: ids(chunking.select_for_embedding(c, a, b, ["seq"]), "chunk_id")
    assert pick(2, 2) == ["c0", "c1", "c3", "c4"] and pick(None, None) == [f"c{i}" for i in range(7)] and pick(0, 0) == [] and pick(2, None) == ["c0", "c1"]


def test_ingest_report(spark):
    d = docs(spark, {"content": "text one two"}, {"content": "text one two"}, {"content": "other words", "title": "U"})
    sources = spark.createDataFrame([("s", None), ("none", "faq")], "source_name string, category string")
    out = ingest.ingest(d, sources, ingest.IngestOptions(embedding_limit=1))
    rows = {r["source_name"]: r for r in out.report.collect()}
    assert (rows["s"]["raw_documents"], rows["s"]["documents"], rows["s"]["exact_duplicates_removed"], rows["s"]["chunks"], rows["s"]["embedded_chunks"], rows["s"]["status"]) == (3, 2, 1, 2, 1, "ok")
    assert rows["none"]["status"] == "no_content_discovered"
    assert ingest.run_totals(out.report).first()["chunks"] == 2
    with pytest.raises(ValueError):
        ingest.IngestOptions(skip_embed=True, store_vectors=True)


@pytest.mark.parametrize("values,want", [((0, 0, 0, 0, None), "no_content_discovered"), ((3, 0, 1, 0, "faq"), "fully_deduplicated"), ((3, 0, 0, 0, "faq"), "empty_board_or_filtered"), ((3, 0, 0, 0, None), "filtered_out_or_empty"), ((3, 1, 2, 0, None), "ok")])
def test_status(spark, values, want):
    *numbers, category = values
    assert spark.range(1).select(ingest.source_status(*[F.lit(v) for v in numbers], F.lit(category).cast("string"))).first()[0] == want


def test_search_scores(spark):
    now = F.lit("2025-01-01").cast("timestamp_ntz")
    v = spark.createDataFrame(
        [("a", "d", [0.5, 0.0], "notice", "plain", "t", "u", None), ("b", "d", [0.9, 0.0], "notice", "scholarship news", "t", "u", datetime(2024, 12, 1)), ("c", "d", [0.0, 0.0], "faq", "x", "t", "u", None)],
        "chunk_id string, doc_id string, embedding array<float>, category string, title string, text string, source_url string, published_at timestamp_ntz",
    )
    rows = search.search(v, "scholarship news", [0.0, 0.0], now, 5, "notice").collect()
    assert [r["chunk_id"] for r in rows] == ["b", "a"] and rows[1]["score"] == 0.44
    assert [r["chunk_id"] for r in search.nearest(v, [0.0, 0.0], 2).collect()] == ["c", "a"]
    assert search.nearest(v, [], 2).count() == 0 and search.candidate_count(3) == 12 and search.candidate_count(20) == 50
    with pytest.raises(ValueError):
        search.search(v, "q", [0.0, 0.0], now, 21)
    q = spark.createDataFrame([(1, "x", [0.0, 0.0], None), (2, "x", [1.0, 0.0], "notice")], "query_id int, query string, query_vector array<double>, category string")
    got = {(r["query_id"], r["rank"]): r["chunk_id"] for r in search.batch_search(v, q, now, 1).collect()}
    assert got[(2, 1)] == "b"


def test_routes(spark):
    asked = ["오늘 날씨 어때", "도서관 전화번호", "도서관 어디야", "장학금 신청 기간", "졸업 학점 알려줘", "안녕", "학과 공지 안내"]
    rows = [routing.route_questions(spark.createDataFrame([(q,)], "text string")).first() for q in asked]
    assert [(r["route"], r["db_intent"]) for r in rows] == [("weather", "unknown"), ("relational_db", "phone"), ("relational_db", "map"), ("rag", "unknown"), ("rag", "unknown"), ("llm", "unknown"), ("rag", "unknown")]
    assert rows[3]["reason"] == "rag keyword: scholarship_support" and rows[6]["reason"] == "rag keyword: department_sources"
    assert spark.range(1).select(routing.classify_intent(F.lit("행정실 번호"))).first()[0] == "phone"


def test_answers(spark):
    contacts = spark.createDataFrame([(2, "중앙도서관", "031-1", None), (1, "학생지원팀", "031-2", "장학 담당")], "id long, name string, phone string, description string")
    places = spark.createDataFrame([(1, "Main Library", "1,2", "books")], "id long, name string, location string, description string")
    questions = spark.createDataFrame([(1, "중앙도서관 전화번호"), (2, "안녕"), (3, "졸업요건")], "query_id int, text string")
    results = spark.createDataFrame([(3, 1, "A", "u", 0.5, "t"), (3, 2, "B", "u", 0.4, "t2")], "query_id int, rank int, title string, source_url string, score double, text string")
    got = {r["query_id"]: r for r in routing.answer_batch(questions, contacts, places, results).collect()}
    assert got[2]["reply"] is None and got[3]["context"].startswith("[1] A\nsource_url: u") and got[1]["reply"] == "중앙도서관: 031-1"
    best = lookup.best_match(spark.createDataFrame([(1, "중앙도서관 전화번호 알려줘")], "query_id int, text string"), contacts, "text", lookup.CONTACT_STOPWORDS).first()
    assert best["phone"] == "031-1" and best["score"] == 105


def test_lookup_ties_and_filters(spark):
    rows = spark.createDataFrame([(2, "West Hall", "d", ["a"]), (1, "East Hall", "d", ["b"])], "id long, name string, description string, tags array<string>")
    q = spark.createDataFrame([(1, "hall"), (2, "zz"), (3, "h")], "query_id int, text string")
    assert [(r["query_id"], r["id"]) for r in lookup.best_match(q, rows).collect()] == [(1, 1)]
    assert ids(lookup.filter_rows(rows, "WEST h", ["name", "description"]), "id") == [2] and ids(lookup.filter_rows(rows, "", ["name"], "b"), "id") == [1]
    assert lookup.by_id(rows, "x").count() == 0 and lookup.by_id(rows, "2").count() == 1


def test_weather(spark):
    today = F.lit("2025-01-01").cast("date")
    w = spark.range(1).select(weather.window(F.lit("모레 날씨"), today).alias("w"), weather.guard(F.lit("2025-01-10").cast("date"), F.lit(30), today).alias("g")).first()
    assert str(w["w"]["start"]) == "2025-01-03" and w["g"]["days"] == 7 and w["g"]["status"] == "ok"


def test_upserts(spark):
    old = spark.createDataFrame([("a", "1", "active", None), ("b", "2", "updated", None)], "doc_id string, content_hash string, status string, last_seen_at timestamp")
    new = spark.createDataFrame([("a", "9"), ("b", "2"), ("c", "3")], "doc_id string, content_hash string")
    now = F.lit("2025-01-01").cast("timestamp")
    got = {r["doc_id"]: r for r in store.upsert_hashed(old, new, ["doc_id"], now).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"a": "updated", "b": "active", "c": "active"} and got["b"]["last_seen_at"] is not None
    v = spark.createDataFrame([("x1", "x", "o"), ("y1", "y", "o")], "chunk_id string, doc_id string, text string")
    n = spark.createDataFrame([("x2", "x", "n")], "chunk_id string, doc_id string, text string")
    assert ids(store.replace_documents(v, n), "chunk_id") == ["x2", "y1"]


def test_catalog(spark, tmp_path):
    (tmp_path / "c.yaml").write_text(
        "sources: [{name: own, seed_urls: [https://o.example/x], category: c}]\n"
        "department_sites: [{slug: cs, base_url: https://cs.example/, department: CS, source_overrides: {faq: {max_pages: 3}}}, {slug: no}]\n"
        "source_blueprints: [{name_suffix: notice, category: notice, seed_url_template: '{base_url}/n.do'}, {name_suffix: faq, applies_to: portal, category: faq, max_pages: 9}, {name_suffix: lab, applies_to: [lab], category: l}]\n"
    )
    rows = {r["name"]: r for r in config.load_catalog(spark, str(tmp_path / "c.yaml")).collect()}
    assert set(rows) == {"own", "cs_notice", "cs_faq"} and rows["cs_notice"]["seed_urls"] == ["https://cs.example/n.do"] and rows["cs_faq"]["max_pages"] == 3
    s = spark.createDataFrame([("a1", 1), ("a2", 2), ("b1", 3)], "name string, seq int")
    assert ids(catalog.select_sources(s, None, ["a"], ["a2"], 5), "name") == ["a1"] and catalog.select_sources(s, limit=0).count() == 0
    with pytest.raises(ValueError):
        config.rules_from_rows(spark, [{"name": "x"}])


PAGE = "url string, category string, department string, markdown string, metadata map<string,string>, links array<string>"
RULES = [{"name": "faq", "priority": 20, "categories": ["faq"], "parser": "faq"}, {"name": "notice", "priority": 10, "url_patterns": ["view.do"], "parser": "notice_detail"}, {"name": "plan", "priority": 15, "categories": ["plan"], "parser": "schedule"}, {"name": "generic_markdown", "priority": 99, "parser": "generic_markdown"}]


def test_parsers(spark):
    notice = "## Top\n[공지] 장학금 신청 안내\n작성자 : 학생지원팀\n작성일 : 2024-03-05\n본문 내용입니다"
    pages = spark.createDataFrame(
        [
            ("https://a.example/selectBbsNttView.do?n=1", "notice", "dept", notice, {"title": "공지사항 - list"}, ["/f/a.pdf", "x.html", "/f/a.pdf"]),
            ("https://a.example/faq", "faq", "dept", "## x\nFAQ\nHow long does it last\nThree weeks\n1. menu", None, None),
            ("https://a.example/empty", "faq", "dept", "총게시물 : 0\nnothing here", None, None),
            ("https://a.example/plan", "plan", "dept", "Term dates\nMarch", {"og:title": " Plan  2024 "}, None),
            ("https://a.example/other", None, "dept", "First line\nmore", None, None),
            ("https://a.example/blank", None, "dept", "x\n", None, None),
        ],
        PAGE,
    )
    got = {r["url"].rsplit("/", 1)[1]: r for r in parsing.parse(pages, config.rules_from_rows(spark, RULES)).collect()}
    assert set(got) == {"selectBbsNttView.do?n=1", "faq", "plan", "other"}
    n = got["selectBbsNttView.do?n=1"]
    assert n["title"] == "장학금 신청 안내" and n["published_at"] == datetime(2024, 3, 5) and n["author_department"] == "학생지원팀" and n["attachment_urls"] == ["https://a.example/f/a.pdf"]
    assert got["faq"]["content"] == "How long does it last\nThree weeks" and got["faq"]["title"] == "How long does it last"
    assert got["plan"]["title"] == "Plan 2024" and got["other"]["title"] == "First line"


def test_filters(spark):
    d = docs(spark, {"title": "Scholarship news", "author_department": "Team A"}, {"title": "Other"}, {"title": "Scholarship old", "author_department": "Team B"})
    assert ids(parsing.keyword_filter(d, ["scholar"], ["OLD"])) == ["d0"] and ids(parsing.author_filter(d, ["team"], ["team b"])) == ["d0"]


def test_crawl_order_and_limits(spark):
    pages = spark.createDataFrame(
        [
            ("https://a.example/p/0", ["/p/2", "1", "/p/0", "/d/f.pdf", "https://other.example/p/9"]),
            ("https://a.example/p/1", ["/p/3"]),
            ("https://a.example/p/2", ["/p/3", "/p/4"]),
        ],
        "url string, links array<string>",
    )
    source = lambda n, d: spark.createDataFrame([("s", ["https://a.example/p/0"], n, d, True, ["a.example"])], "name string, seed_urls array<string>, max_pages int, max_depth int, collect_seed_pages boolean, allowed_domains array<string>")
    visit = lambda n, d: [(r["url"][-1], r["depth"]) for r in crawl.crawl(pages, source(n, d)).orderBy("ordinal").collect()]
    assert visit(0, 5) == [("0", 0), ("1", 1), ("2", 1), ("3", 2), ("4", 2)] and visit(2, 5) == [("0", 0), ("1", 1)] and visit(0, 0) == [("0", 0)]
    first = crawl.crawl(pages, source(1, 5)).first()
    assert first["documents"] == ["https://a.example/d/f.pdf"] and first["fetched"]


def test_pagination(spark):
    url = "https://a.example/selectBbsNttList.do?key=1"
    pages = lambda last, most, newest, cutoff: spark.range(1).select(crawl.pagination(F.lit(url), F.lit(last).cast("int"), F.lit(most), F.lit(newest).cast("date"), F.lit(cutoff).cast("date"))).first()[0]
    assert pages(3, 0, None, None) == [f"https://a.example/selectBbsNttList.do?key=1&pageIndex={i}" for i in (1, 2, 3)]
    assert pages(9, 2, "2024-05-01", "2024-01-01") == ["https://a.example/selectBbsNttList.do?key=1&pageIndex=2"]
    assert pages(9, 2, "2023-05-01", "2024-01-01") == [] and pages(1, 0, None, None) == []
    assert spark.range(1).select(crawl.last_page(F.lit("페이지 : _1_ / _12_"), F.array().cast("array<string>"))).first()[0] == 12


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name.replace("__", "."), data)
    return out.getvalue()


def test_archives(spark):
    inner = zipped(note__md=b"deep")
    files = spark.createDataFrame([("s1", zipped(a__pdf=b"%PDF", b__exe=b"no", c__zip=inner)), ("s2", b"broken")], "source string, content binary")
    rows = {(r["source"], r["member"]): r for r in archives.archive_members(files).collect()}
    assert set(rows) == {("s1", "a.pdf"), ("s1", "c.zip#note.md"), ("s2", None)} and rows[("s2", None)]["error"]
    doc = zipped(Contents_section0__xml=b"<a><b>one</b><c> two </c></a>", x_body__xml=b"<broken", other__xml=b"<a>no</a>")
    got = archives.extract_text(spark.createDataFrame([("h", doc), ("bad", b"x")], "source string, content binary"), "hwpx").collect()
    assert {r["source"]: r["text"] for r in got} == {"h": "one\ntwo", "bad": None} and [r for r in got if r["source"] == "bad"][0]["error"]


def test_services(spark):
    e = services.embed(spark.createDataFrame([("a b",), ("a b",), ("c",), (None,)], "text string")).collect()
    assert e[0]["embedding"] == e[1]["embedding"] != e[2]["embedding"] and len(e[3]["embedding"]) == 64
    t = spark.range(1).select(services.read_translation(F.lit('{"data":{"translations":[{"translatedText":"a &amp; b"}]}}'), F.lit("en")).alias("t")).first()["t"]
    assert t["text"] == "a & b" and t["source"] == "en"


def test_stream(spark, tmp_path):
    from corpusflow.streaming.incremental import ingest_stream

    schema = "doc_id string, content string, collected_at timestamp"
    for i, rows in enumerate(([("a", "x", datetime(2024, 1, 1)), ("b", "y", datetime(2024, 1, 1))], [("a", "z", datetime(2024, 1, 2))])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
        last = i
    got = {r["doc_id"]: r["status"] for r in spark.read.parquet(str(tmp_path / f"out/v={last}")).collect()}
    assert got == {"a": "updated", "b": "active"}


def test_crawl_stops_at_old_boards(spark):
    import datetime as dt

    board = "https://a.example/selectBbsNttList.do?key=1"
    view = "https://a.example/selectBbsNttView.do?nttNo="
    rows = [
        (board, [f"{view}1", "/selectBbsNttList.do?key=2"], [dt.date(2024, 5, 1)], 9),
        (f"{board}&pageIndex=2", [f"{view}2"], [dt.date(2020, 5, 1)], 9),
        (f"{view}1", [], [], None),
    ]
    pages = spark.createDataFrame(rows, "url string, links array<string>, dates array<date>, last_page int")
    source = spark.createDataFrame(
        [("s", [board], 0, 5, True, dt.date(2024, 1, 1))], "name string, seed_urls array<string>, max_pages int, max_depth int, collect_seed_pages boolean, cutoff date"
    )
    got = [r["url"] for r in crawl.crawl(pages, source).orderBy("ordinal").collect()]
    assert got == [board, f"{view}1", f"{board}&pageIndex=2"]


def test_fallback_and_boxes(spark):
    d = spark.createDataFrame([(1, "Central Library", "x"), (2, "Main Office", "y")], "id long, name string, description string")
    q = spark.createDataFrame([(1, "office"), (2, "nothing")], "query_id int, text string")
    got = {r["query_id"]: r["name"] for r in lookup.with_fallback(q, lookup.best_match(q, d), d, ["Library", "Office"]).collect()}
    assert got == {1: "Main Office", 2: "Central Library"}
    row = spark.range(1).select(lookup.in_box(F.lit(1.0), F.lit(2.0), 0, 0, 1, 1), lookup.clamp(F.lit(5), 0, 3), lookup.coordinate(F.lit(1.5))).first()
    assert tuple(row) == (False, 3, "1.500000")


def test_storage(spark, tmp_path):
    from corpusflow.plans.storage import current, prune, store_result

    sources = spark.createDataFrame([("s", None)], "source_name string, category string")
    folder = str(tmp_path / "store")
    first = docs(spark, {"content": "one two " * 300, "title": "A"}, {"content": "three", "title": "B"}).withColumn("attachment_urls", F.array(F.lit("https://a.example/f.PDF")))
    store_result(ingest.ingest(first, sources), sources, folder, "r1", F.lit("2024-01-01").cast("timestamp"))
    second = docs(spark, {"content": "one two", "title": "A"}).withColumn("attachment_urls", F.array().cast("array<string>"))
    store_result(ingest.ingest(second, sources), sources, folder, "r2", F.lit("2024-01-02").cast("timestamp"))
    rows = {r["doc_id"]: r for r in current(spark, folder, "documents").collect()}
    assert rows["d0"]["status"] == "updated" and rows["d1"]["status"] == "active" and rows["d0"]["doc_type"] == "html"
    assert current(spark, folder, "chunks").count() == 4 and prune(folder, spark)[1].count() == 2
    assert current(spark, folder, "attachments").first()["file_type"] == "pdf" and spark.read.parquet(f"{folder}/runs").count() == 2


def test_early_decisions_of_matching_equal_the_whole_ratio():
    import random
    from difflib import SequenceMatcher

    rng = random.Random(3)
    for _ in range(300):
        a = "".join(rng.choices("abcd é", k=rng.randrange(1, 400)))
        b = list(a) if rng.random() < 0.7 else rng.choices("abcd é", k=rng.randrange(1, 400))
        for _ in range(rng.randrange(60)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(3)] = rng.choices("abcx", k=rng.randrange(3))
        b = "".join(b)
        ratio = SequenceMatcher(a=a, b=b).ratio() if b else 0.0
        assert all(dedup.matches_least(a, b, x) == (ratio >= x) for x in (0.5, 0.75, 0.92, 1.0) if b)


def test_bounds_never_rule_out_a_version():
    import random

    rng = random.Random(4)
    kept = dedup.Better()
    base = ["".join(rng.choices("abcdefgh ", k=rng.randrange(150, 900))) for _ in range(40)]
    texts = []
    for t in base:
        for _ in range(6):
            u = list(t)
            for _ in range(rng.randrange(len(t) // 6)):
                at = rng.randrange(len(u))
                u[at : at + rng.randrange(3)] = rng.choices("xyz", k=rng.randrange(2))
            texts.append(("".join(u) + rng.choice(["", "tail " * rng.randrange(20)]), rng.choice(["", "p", "q"])))
    for text, path in texts:
        profile = dedup.Better.profile(text)
        want = any(dedup.same_document(a, text, p, path) for a, p in kept.rows)
        assert kept.have(text, path, profile) == want
        kept.add(text, path, profile)


def test_overrides_of_any_field(spark):
    over = '{"notice": {"max_pages": 9, "crawl": {"a": 1}, "name": "own", "category": null}, "faq": 5}'
    sites = spark.createDataFrame(
        [("cs", "CS", "https://cs.example//", "portal", over), ("me", None, "https://me.example", None, "no json"), ("", "x", "y", "portal", None), ("zz", "Z", "https://z.example", "lab", None)],
        "slug string, department string, base_url string, site_type string, source_overrides string",
    )
    prints = [
        '{"name_suffix":"notice","applies_to":["portal","lab"],"category":"notice","seed_url_template":"{base_url}/n","crawl":{"b":2}}',
        '{"name_suffix":"faq","applies_to":"lab","skip_images":true,"seed_urls":[]}', '{"name_suffix":"main","seed_urls":["s1"]}',
    ]
    rows = catalog.expand_settings(sites, spark.createDataFrame([(b,) for b in prints], "blueprint string"))
    got = {r["name"]: r["j"] for r in rows.select("name", F.to_json("settings").alias("j")).collect()}
    assert got == {
        "own": '{"category":null,"crawl":{"a":1},"department":"CS","max_pages":9,"name":"own","seed_urls":["https://cs.example/n"]}',
        "cs_main": '{"department":"CS","name":"cs_main","seed_urls":["s1"]}', "me_main": '{"department":"me","name":"me_main","seed_urls":["s1"]}',
        "me_notice": '{"category":"notice","crawl":{"b":2},"department":"me","name":"me_notice","seed_urls":["https://me.example/n"]}',
        "zz_notice": '{"category":"notice","crawl":{"b":2},"department":"Z","name":"zz_notice","seed_urls":["https://z.example/n"]}',
        "zz_faq": '{"department":"Z","name":"zz_faq","seed_urls":["https://z.example"],"skip_images":true}',
    }
    assert rows.where(catalog.setting("max_pages", "int") == 9).count() == 1


def test_a_rejected_page_takes_its_attachments_along(spark):
    from corpusflow.plans import collect

    body = "Notice about the library\nIt opens at nine in the morning for all."
    pages = [
        ("https://a.example/", ["/p/1", "/p/2", "/p/3", "/f/seed.pdf"], "x"), ("https://a.example/p/1", ["/f/one.pdf", "/f/both.pdf"], body),
        ("https://a.example/p/2", ["/f/two.pdf", "/f/both.pdf", "/p/4"], "FAQ\n총게시물 : 0"), ("https://a.example/p/3", ["/f/three.pdf"], body.replace("library", "BLOCKED hall")),
        ("https://a.example/p/4", ["/f/both.pdf", "/f/four.pdf"], body.replace("Notice", "Later notice")), ("https://a.example/p/2#x", [], "other"),
    ]
    frame = spark.createDataFrame(pages, "url string, links array<string>, markdown string")
    source = spark.createDataFrame(
        [("s", ["https://a.example/"], 0, 5, False, ["a.example"], None, ["/p/"], "c", ["blocked"])],
        "name string, seed_urls array<string>, max_pages int, max_depth int, collect_seed_pages boolean, allowed_domains array<string>, include_patterns array<string>, collect_patterns array<string>, category string, blocked_keyword_filters array<string>",
    )
    rules = config.rules_from_rows(spark, [{"name": "n", "url_patterns": ["/p/1", "/p/4"], "parser": "notice_detail"}, {"name": "f", "url_patterns": ["/p/2"], "parser": "faq"}, {"name": "z", "parser": "generic_markdown"}])
    got = collect.collect(frame, source, rules)
    assert {r["url"].rsplit("/", 1)[1]: r["verdict"] for r in got.visited.collect()} == {"a.example": "passed", "1": "accepted", "2": "rejected", "3": "rejected", "4": "accepted"}
    files = {r["url"].rsplit("/", 1)[1]: r["parent_title"] for r in got.attachments.collect()}
    assert files == {"seed.pdf": None, "one.pdf": "Notice about the library", "both.pdf": "Notice about the library", "four.pdf": "Later notice about the library"}
    docs = {r["source_url"].rsplit("/", 1)[1]: r for r in got.documents.collect()}
    assert set(docs) == {"1", "4"} and docs["1"]["category"] == "c" and docs["1"]["doc_id"].startswith("crawl-")


def test_matcher_runs_only_on_texts_that_share_long_runs(monkeypatch):
    """Unlike texts of one alphabet share most three-letter sequences; their runs of six rule them out before matching."""
    import random

    rng, calls, same = random.Random(5), [], dedup.same_document
    words = ["".join(rng.choices("etaonrhisdlu", k=rng.randrange(2, 6))) for _ in range(150)] + ["qu", "w.", "my,"]
    texts = [("a common heading " + " ".join(rng.choices(words, k=450)), f"p{i}") for i in range(30)]
    for i in range(0, 30, 3):
        at = rng.randrange(1000)
        texts.append((texts[i][0][:at] + "changed " + texts[i][0][at + 30 :], "v"))
    want, kept = [], []
    for t, p in texts:
        want.append(any(same(a, t, q, p) for a, q in kept))
        kept.append((t, p))
    monkeypatch.setattr(dedup, "same_document", lambda *a: calls.append(1) or same(*a))
    better, got = dedup.Better(), []
    for t, p in texts:
        profile = better.profile(t)
        got.append(better.have(t, p, profile))
        better.add(t, p, profile)
    assert got == want and sum(want) == 10 and len(calls) <= 20
