"""Boilerplate by the suffix array of a host, against brute force."""

import random

import numpy as np
import pytest

from corpusflow.llm import html_text

PAGES = "page_id long, url string, html string"


def brute_texts(rows, depth=8, least=3):
    """Of pages of blocks without landmarks; identity is the path of the URL, and the content."""
    shared: dict[tuple[str, tuple], set] = {}
    first: dict[tuple[str, str], str] = {}
    for _, url, html in rows:
        host, page = url.split("/")[2], url.split("?")[0].split("#")[0]
        first[host, html] = min(first.get((host, html), page), page)
    for _, url, html in rows:
        host = url.split("/")[2]
        tokens = html.replace("<div>", " ").replace("</div>", " ").split()
        for i in range(len(tokens) - depth + 1):
            shared.setdefault((host, tuple(tokens[i : i + depth])), set()).add(first[host, html])
    out = {}
    for n, url, html in rows:
        host = url.split("/")[2]
        blocks = [b.replace("</div>", "").split() for b in html.split("<div>")[1:]]
        tokens = [t for b in blocks for t in b]
        covered = [False] * len(tokens)
        for i in range(len(tokens) - depth + 1):
            if len(shared[host, tuple(tokens[i : i + depth])]) >= least:
                covered[i : i + depth] = [True] * depth
        # A run of prose of 100 tokens that is most of its page stays: 20 tokens a block on average.
        block_of, i = [k for k, b in enumerate(blocks) for _ in b], 0
        while i < len(tokens):
            j = i
            while j < len(tokens) and covered[j]:
                j += 1
            if j - i >= 100 and j - i > len(tokens) / 2 and (j - i) / len(set(block_of[i:j])) >= 20:
                covered[i:j] = [False] * (j - i)
            i = max(j, i + 1)
        lines, at = [], 0
        for b in blocks:
            own, i = [], 0
            while i < len(b):
                j = i
                while j < len(b) and covered[at + j]:
                    j += 1
                if j - i < depth and j - i < len(b):
                    own += b[i : max(j, i + 1)]
                i = max(j, i + 1)
            at += len(b)
            if own:
                lines.append(" ".join(own))
        out[n] = "\n".join(lines)
    return out


def host_pages(seed=2):
    """Pages of three hosts with menus, runs that two or three pages share, mirrors and repeated rows."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    lines = [" ".join(rng.choices(words, k=rng.randrange(5, 40))) for _ in range(12)]
    rows = []
    for n in range(120):
        host = rng.choice(["a", "a", "b", "c"])
        own = [" ".join(rng.choices(words, k=rng.randrange(3, 60))) for _ in range(rng.randrange(1, 4))]
        for _ in range(rng.randrange(4)):
            line = rng.choice(lines)
            k = rng.randrange(len(own))
            own[k] = rng.choice([f"{own[k]} {line}", f"{line} {own[k]}"])
            own.insert(k, rng.choice(lines))
        rows.append((n, f"http://{host}.example/p{n}", "".join(f"<div>{b}</div>" for b in own)))
    for n in range(120, 150):
        _, url, html = rng.choice(rows[:120])
        rows.append((n, url + rng.choice(["", "?utm_source=x", "#top"]), html if rng.random() < 0.6 else f"{html}<div>{rng.choice(words)}</div>"))
    return rows + rng.choices(rows, k=10)


@pytest.mark.parametrize("part_chars", [20_000_000, 3000])
def test_texts_equal_brute_force(spark, part_chars):
    rows = host_pages()
    want = sorted((n, text) for n, text in brute_texts(rows).items())
    for partitions in (1, 3):
        frame = spark.createDataFrame(rows, PAGES).repartition(partitions)
        got = html_text.extract_main_text(frame, part_chars=part_chars).collect()
        assert len(got) == len(rows) and sorted({(r["page_id"], r["text"]) for r in got}) == want


def test_mirrors_keep_their_text(spark):
    body = " ".join(f"body{i}" for i in range(50))
    rows = [(i, f"http://a.example/x{u}", f"<div>{body}</div>") for i, u in enumerate(["", "?utm_source=1", "#top", "/", ".html"])]
    rows += [(10 + i, f"http://b.example/{i}", f"<div>{body}</div>") for i in range(4)]  # one content at four addresses
    rows += [(20 + i, f"http://c.example/{i}?utm_medium=m", f"<div>{body}</div><div>number {i}</div>") for i in range(3)]  # three pages
    got = {r["page_id"]: r["text"] for r in html_text.extract_main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(got[i] == body for i in (*range(5), *range(10, 14)))
    assert [got[20 + i] for i in range(3)] == [f"number {i}" for i in range(3)]


@pytest.mark.parametrize("part_chars", [20_000_000, 500])
def test_blocks_that_most_pages_have_go_from_articles(spark, part_chars):
    line = "subscribe to the letter that we send to all of our readers"
    quote = "one sentence that a few articles of this host quote from each other"
    pages = [f"<article><p>own text {i} of an article</p><p>{quote if i < 5 else 'else'}</p><p>{line}</p></article>" for i in range(14)]
    rows = [(i, f"http://a.example/{i}", html) for i, html in enumerate(pages)]
    got = {r["page_id"]: r["text"] for r in html_text.extract_main_text(spark.createDataFrame(rows, PAGES), part_chars=part_chars).collect()}
    assert all(got[i] == f"own text {i} of an article\n{quote if i < 5 else 'else'}" for i in range(14))


def test_repeats_are_found_at_full_length():
    rng = np.random.default_rng(8)
    line = rng.integers(0, 1000, 100)
    pages = [np.concatenate([rng.integers(0, 1000, 30), line, rng.integers(0, 1000, 20)]) for _ in range(4)]
    tokens = np.concatenate([np.append(p, 65536 + i) for i, p in enumerate(pages)])
    owner = np.repeat(np.arange(4), [len(p) + 1 for p in pages])
    lengths, counts = html_text.repeated_lengths(tokens, owner, 8, 3)
    assert lengths.max() == 64 and counts[30] == 4
    first = np.flatnonzero((owner == 0) & (lengths > 0))
    assert html_text.runs_of(first, lengths[first]).tolist() == [[30, 130]]


def test_an_article_that_several_pages_carry_stays(spark):
    body = " ".join(f"word{i}" for i in range(120))
    menu = "".join(f"<li>entry {i} of the menu</li>" for i in range(60))
    rows = [(i, f"https://a.example{p}", f"<div><ul>{menu}</ul><p>{body}</p><p>{w}</p></div>") for i, (p, w) in enumerate([("/a", "rss"), ("/b/story", "page"), ("/c", "lang")])]
    rows += [(9, "https://a.example/d", f"<div><ul>{menu}</ul><p>something else</p></div>")]
    bare = [(i, f"https://b.example{p}", f"<div><p>{body}</p><p>{w}</p></div>") for i, p, w in [(20, "/a?from=rss", "rss"), (21, "/b/story", "page"), (22, "/c?lang=en", "lang")]]
    got = {r["page_id"]: r["text"] for r in html_text.extract_main_text(spark.createDataFrame(rows + bare, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in (20, 21, 22)] == [f"{body}\n{w}" for w in ("rss", "page", "lang")]
    assert got[9] == "something else" and "entry" not in got[0]
