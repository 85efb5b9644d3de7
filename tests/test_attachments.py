"""Files to documents: the cascade of types, readers, archives, flags and faults."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusflow.sources import attachments
from corpusflow.sources.attachments import Collection, collect_attachments, collected_documents, file_suffix, file_type, scan_files

FILE = "source string, content binary, content_type string, disposition string"


def packed(*members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members:
            z.writestr(name, data)
    return out.getvalue()


def collected(spark, files, **options):
    options = {"skip_unsupported": True, **options}
    rows = collect_attachments(spark.createDataFrame(files, FILE), Collection(**options))
    return {r["source_url"]: r for r in rows.collect()}


def test_cascade_of_types(spark):
    site = "https://a.example"
    cases = [
        (f"{site}/a.PDF", b"PK\x03\x04", None, None, ".pdf"),  # an address of its own wins
        (f"{site}/a.hwp", b"%PDF-1", None, None, ".hwp"),  # downloaded, but the name still tells
        (f"{site}/downloadBbsFile.do?x=1.pdf", b"", None, 'attachment; filename="b.hwpx"', ".hwpx"),  # header name
        (f"{site}/downloadBbsFile.do", b"%PDF-1", "application/zip", 'attachment; filename="b.exe"', ".zip"),  # then content type
        (f"{site}/get", b"%PDF-1", "application/octet-stream", None, ".pdf"),  # then first bytes
        (f"{site}/get", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1x", None, None, ".hwp"),
        (f"{site}/get", b"  <html><p>x", None, None, ".html"),
        (f"{site}/get", b"zzz", None, None, ""),
        (f"{site}/get", None, None, None, ""),
        ("/data/a.docx", b"%PDF", "application/zip", None, ".docx"),  # a path is never a download
        ("/data/a", b"%PDF", None, None, ""),
    ]
    df = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "i int, " + FILE)
    got = df.select("i", F.coalesce(file_suffix(*map(F.col, ("source", "content", "content_type", "disposition"))), F.lit("")).alias("s")).collect()
    assert [r["s"] for r in sorted(got)] == [c[4] for c in cases]
    assert [r[0] for r in spark.createDataFrame([(".JPG".lower(),), (".zip",), ("",), (None,)], "s string").select(file_type(F.col("s"))).collect()] == ["image", "zip", "file", "file"]


def test_documents_of_all_kinds(spark):
    section = "<a><p>첫째 줄</p><p> </p><p>둘째</p></a>".encode()
    inner = packed(("p/q.html", b"<html><head><title>T &amp; U</title></head><body><h1>H</h1><p>a <b>b</b></p><script>no</script></body></html>"), ("x.png", b"1"))
    files = [
        ("https://a.example/n.md", b"# Head\n\nbody", None, None),
        ("https://a.example/get", packed(("Contents/section0.xml", section), ("section1.xml", b"<broken")), None, 'x; filename="r.hwpx"'),
        ("https://a.example/all.zip", packed(("d/1.md", b"one"), ("d/in.zip", inner), ("d/run.exe", b"MZ"), ("e.md", b"  ")), None, None),
        ("https://a.example/i.png", b"1", None, None), ("https://a.example/bad.zip", b"PK\x03\x04zzz", None, None), ("https://a.example/w.pdf", b"%PDF", None, None),
        ("/data/null.md", None, None, None),
    ]
    got = collected(spark, files, category="notice", department="d", skip_images=True)
    one = got["https://a.example/n.md"]
    assert (one["title"], one["content"], one["category"], one["department"], one["author_department"], one["attachment_urls"]) == ("Head", "# Head\n\nbody", "notice", "d", "d", [])
    assert got["https://a.example/get"]["content"] == "첫째 줄\n둘째" and got["https://a.example/get"]["source_type"] == "hwpx"
    page = got["https://a.example/all.zip#d/in.zip#p/q.html"]
    assert (page["title"], page["content"], page["source_type"]) == ("T & U", "H\na b", "html")
    assert got["https://a.example/all.zip#e.md"]["status"] == "empty" and got["https://a.example/i.png"]["status"] == "image"
    assert got["https://a.example/bad.zip"]["status"] == "failed" and "BadZipFile" in got["https://a.example/bad.zip"]["reason"]
    assert got["https://a.example/w.pdf"]["status"] == "unsupported" and got["/data/null.md"]["status"] == "empty"
    assert len({r["doc_id"] for r in got.values()}) == len(got)
    rows = collect_attachments(spark.createDataFrame(files, FILE), Collection(skip_images=True, skip_unsupported=True))
    assert collected_documents(rows).count() == sum(r["status"] == "ok" for r in got.values()) == 4


def test_readers_are_tried_in_order(spark):
    def broken(content):
        raise ValueError("no text layer")

    readers = {"pdf": (broken, lambda b: "", lambda b: "scanned " + b.decode()), "docx": (broken,), "image": (lambda b: "ocr",)}
    files = [("a.pdf", b"x", None, None), ("a.docx", b"x", None, None), ("a.png", b"x", None, None)]
    got = collected(spark, files, readers=readers)
    assert (got["a.pdf"]["content"], got["a.pdf"]["title"], got["a.png"]["content"]) == ("scanned x", "scanned x", "ocr")
    assert (got["a.docx"]["status"], got["a.docx"]["reason"]) == ("failed", "ValueError: no text layer")


@pytest.mark.parametrize(("file", "options"), [("a.xyz", {"skip_unsupported": False}), ("a.hwpx", {"skip_failed": False})])
def test_flags_end_the_job(spark, file, options):
    with pytest.raises(Exception, match="unsupported|failed"):
        collected(spark, [(file, b"x", None, None)], **options)


def test_scan_of_a_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("alpha")
    (tmp_path / "sub" / "b.html").write_text("<p>beta")
    rows = collect_attachments(scan_files(spark, str(tmp_path)), collected_at=F.lit("2024-01-02").cast("timestamp_ntz")).collect()
    assert sorted((r["content"], r["status"], str(r["collected_at"])[:10]) for r in rows) == [("alpha", "ok", "2024-01-02"), ("beta", "ok", "2024-01-02")]
    assert attachments.html_text(b"<div>x<br>y &lt;</div><style>z</style>") == "x\ny <"


def test_small_files_share_a_frame(monkeypatch):
    """Rows are handed on by their bytes, not file by file, nor all at once."""
    import pandas as pd

    from corpusflow.sources import attachments

    files = pd.DataFrame([(f"f{i}", "markdown", b"word " * 100) for i in range(400)], columns=["source", "source_type", "content"])
    read = lambda: list(attachments._read(Collection())([files[:150], files[150:]]))
    assert [len(f) for f in read()] == [400]  # 400 frames before
    monkeypatch.setattr(attachments, "FRAME_BYTES", 50_000)
    frames = read()
    assert len(frames) > 3 and max(f["content"].str.len().sum() for f in frames) < 50_000
    assert pd.concat(frames)["source"].tolist() == files["source"].tolist()
