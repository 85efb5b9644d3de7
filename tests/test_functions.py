from datetime import datetime

from pyspark.sql import functions as F

from corpusflow.functions import dates, hwp, text, titles, urls


def one(spark, column, **values):
    """Value of an expression over one row of literals."""
    row = spark.range(1)
    for name, value in values.items():
        row = row.withColumn(name, F.lit(value) if value is not None else F.lit(None).cast("string"))
    return row.select(column.alias("x")).first()["x"]


def clean(spark, value, url="https://a.example/x"):
    return one(spark, text.clean_markdown(F.col("c"), F.col("u")), c=value, u=url)


def test_cleaner(spark):
    page = "Menu\nlogin\n\n## Heading here\n\n\n- a bullet [link](http://x.example)\n![pic](p.png)\n\nx\nhttps://only.example/url\nlast line\n\n목록 back\nafter"
    assert clean(spark, page) == "Heading here\n\na bullet link\n\nlast line"
    assert clean(spark, "") == "" and clean(spark, None) == ""
    assert clean(spark, "one\nhome work\ntwo") == "one\ntwo"
    assert clean(spark, "대학생활\nreal", "https://a.example/contents.do") == "real"
    assert clean(spark, "a b\r\nc d e f") == "a b\nc d\ne f"


def test_normalisers(spark):
    assert one(spark, text.normalize_content(F.col("c")), c=" A  [Link](u)  STRASSE ß ") == "a link strasse ss"
    assert one(spark, text.tokens(F.col("c")), c="Ab c 학사일정 12-x") == ["ab", "학사일정", "12"]
    assert one(spark, text.short_id("crawl", F.col("c")), c="https://a.example") == "crawl-" + __import__("hashlib").sha1(b"https://a.example").hexdigest()[:12]


def test_urls(spark):
    norm = lambda u: one(spark, urls.normalize_url(F.col("u")), u=u)
    assert norm("https://a.example/p/;jsessionid=AB12?b=2&a=1#frag") == "https://a.example/p/?a=1&b=2"
    assert norm("https://a.example/x/selectBbsNttView.do?utm=1&nttNo=5&key=2&key=3") == "https://a.example/x/selectBbsNttView.do?key=2&nttNo=5"
    assert norm("https://a.example///") == "https://a.example"
    assert one(spark, urls.domain(urls.part(F.col("u"), "host")), u="https://WWW.A.example/x") == "a.example"
    assert one(spark, urls.page_index(F.col("u")), u="https://a.example/l?PageIndex=7&x=1") == 7
    assert one(spark, urls.with_param(F.col("u"), "pageIndex", F.lit(3)), u="https://a.example/l?pageindex=1&k=v") == "https://a.example/l?k=v&pageIndex=3"
    assert one(spark, urls.path_prefixes(F.array(F.lit("https://a.example/Dep/x"), F.lit("https://a.example/"), F.lit("https://b.example/Dep"))), c="") == ["/Dep/", "/"]
    assert one(spark, urls.file_type(F.col("u")), u="https://a.example/f/Name.PDF?x=1.zip") == "pdf"
    assert one(spark, urls.file_name(F.col("u")), u="https://a.example/f/") is None


def test_resolve(spark):
    from urllib.parse import urljoin

    base = "https://a.example/d/e/page.html?q=1"
    for href in ("x.html", "../f/x.pdf", "/r/./s/../t", "?p=2", "#top", "//b.example/z", "http://c.example/", "./", "..", "../../../up", ""):
        want = urljoin(base, href)
        assert one(spark, urls.resolve(F.col("b"), F.col("h")), b=base, h=href) in (want, base + href if href.startswith("#") else want)


def test_allowed(spark):
    arr = lambda *x: F.array(*[F.lit(i) for i in x]).cast("array<string>")
    ok = lambda u, **k: one(
        spark, urls.is_allowed(F.col("u"), k.get("domains", arr()), arr(), k.get("include", arr()), k.get("exclude", arr()), k.get("prefixes", arr())), u=u
    )
    assert ok("https://a.example/x") and not ok("ftp://a.example/x")
    assert not ok("https://a.example/x", domains=arr("b.example")) and not ok("https://a.example/LOGIN", exclude=arr("login"))
    assert ok("https://a.example/other/f.pdf", prefixes=arr("/dep/"), include=arr("board")) and not ok("https://a.example/other", prefixes=arr("/dep/"))


def test_dates(spark):
    parse = lambda v: one(spark, dates.parse_datetime(F.col("v")), v=v)
    assert parse("2024-03-05T10:20:30Z") == datetime(2024, 3, 5, 10, 20, 30)
    assert parse("2024-03-05T10:20:30+09:00") == datetime(2024, 3, 5, 1, 20, 30)
    assert parse("2024.3.5 9:05") == datetime(2024, 3, 5, 9, 5) and parse("2024년 3월 5일 9시 7분") == datetime(2024, 3, 5, 9, 7)
    assert parse("2024/13/5") is None and parse("soon") is None and parse(None) is None
    assert one(spark, dates.published_at(F.col("c"), F.create_map(F.lit("date"), F.lit("2020-01-02"))), c="작성일: 2024-01-01") == datetime(2020, 1, 2)


def test_titles(spark):
    assert one(spark, titles.html_title(F.col("h")), h="<title> 메뉴 </title><h1>Real &amp; <b>true</b></h1>") == "Real & true"
    assert one(spark, titles.text_title(F.col("c"), F.col("s")), c="\n* [nav](x)\n# Good title\n", s="f.pdf") == "Good title"
    assert one(spark, titles.text_title(F.col("c"), F.col("s")), c="!!\n", s="https://a.example/d/file.pdf") == "file"


def test_site_words_are_rules(spark):
    page = F.lit("Our campus news\nreal line\nsitefoot and more\nrest")
    rules = text.LineRules(skip=(*text.SKIP_LINE_TOKENS, "campus news"), end=("sitefoot",))
    assert spark.range(1).select(text.clean_markdown(page, F.lit("https://a.example/x"), rules)).first()[0] == "real line"


def test_hwp_lines(spark):
    raw = "그림입니다 x\n\x01\x02 ab c d\n가 나 2024년 일정 안내문입니다\n정상적인 문장이 여기에 있습니다\n????"
    assert one(spark, hwp.clean_lines(F.col("c")), c=raw) == "2024년 일정 안내문입니다\n정상적인 문장이 여기에 있습니다"


def test_lines_with_the_korean_middle_dot(spark):
    lines = ["대학ㆍ조직 안내 2024년 계획", "입학ㆍ졸업 관련 문의 사항", "ㅤㆎ 2024-05 모집 공고"]
    got = spark.createDataFrame([("\n".join(lines),)], "t string").select(hwp.clean_lines(F.col("t")).alias("t")).first()["t"]
    assert got.split("\n") == [*lines[:2], "2024-05 모집 공고"]
    assert spark.range(1).select(titles.useful_share(F.lit("ㆍㆍ--"))).first()[0] == 0.5
