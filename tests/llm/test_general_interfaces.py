"""Training-data operators over all that a text or page can hold."""

import numpy as np

from corpusflow.llm import html_text, langid


def test_texts_without_a_letter_are_undetermined(spark):
    rows = [(1, "plain words of a language", "en"), (2, "\U0001f600\U0001f680 \U0001f600", None), (3, "。。、", None), (4, "１２３４５", None), (5, "漢", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labelled = df.where("lang is not null").selectExpr("doc_id as id", "lang as label")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify_language(df, labelled).collect()}
    assert got == {1: "en", 2: "und", 3: "und", 4: "und", 5: "en"}


def test_languages_with_thousands_of_letters(spark):
    rng = np.random.default_rng(3)
    kinds = {"zh": [chr(0x4E00 + i) for i in range(900)], "zt": [chr(0x6000 + i) for i in range(900)], "ja": [chr(0x3041 + i) for i in range(80)], "ko": [chr(0xAC00 + i * 7) for i in range(900)]}
    lexicon = {k: ["".join(rng.choice(v, 3)) for _ in range(300)] for k, v in kinds.items()}
    rows = [(n * 10 + i, "".join(rng.choice(words, 60)), lang, i < 6) for n, (lang, words) in enumerate(lexicon.items()) for i in range(10)]
    df = spark.createDataFrame([(a, b, c, bool(d)) for a, b, c, d in rows], "doc_id long, text string, lang string, learn boolean")
    learn = df.where("learn")
    labelled = learn.selectExpr("doc_id as id", "lang as label")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify_language(df, labelled, learn.selectExpr("doc_id as id", "text")).collect()}
    assert all(got[i] == lang for i, _, lang, _ in rows)


def test_sparse_and_dense_transitions_agree():
    rng = np.random.default_rng(5)
    letters = "abcdefghijklmnop"
    train, probe = ("".join(rng.choice(list(letters + " "), 700)) for _ in range(2))
    costs = []
    for common, rare in ((letters, ""), ("aeg", "".join(c for c in letters if c not in "aeg")), ("", letters)):
        alphabet = langid.Alphabet(common, rare)
        table, keys, ends = langid.split_automaton(alphabet.codes(train).tolist(), alphabet.pad + 1)
        table[:, alphabet.pad] = np.arange(len(table))
        costs.append(langid.parse_costs([alphabet.codes(probe)], [table], alphabet.pad, [(keys, ends)])[0, 0])
    assert costs[0] == costs[1] == costs[2]


def text_of(body):
    return html_text.settled_text(html_text.blocks_of(f"<html><body>{body}</body></html>"))


def test_wrappers_named_after_what_they_hold_do_not_hide_the_article():
    article = '<article><p>One</p><div class="ad-box"><p>Buy</p></div><p>Two</p></article><div class="sidebar"><p>side</p></div>'
    for wrapper in ('class="content has-sidebar"', 'id="page-with-nav"', 'class="post has-comments"', 'class="sidebar-layout"', 'class="with-widget no-ads"'):
        assert text_of(f"<div {wrapper}>{article}</div>") == "One\nTwo"
        assert text_of(f"<main><div {wrapper}>{article}</div></main>") == "One\nTwo"
    assert text_of(f'<div class="nav"><div class="footer">{article}</div></div>') == "One\nTwo"


def test_articles_that_are_comments_stay_outside():
    comments = '<div id="comments"><article class="comment"><p>nice</p></article></div><section class="related-posts"><article><p>more</p></article></section>'
    assert text_of(f"<article><p>One</p></article>{comments}") == "One"
    assert text_of(f'<div class="sidebar-layout"><article><p>One</p></article>{comments}</div>') == "One"
    assert text_of(f"<main><p>One</p>{comments}</main>") == "One"
    assert text_of('<article><div class="site-footer"><p>foot</p></div><p>has</p></article>') == "has"
