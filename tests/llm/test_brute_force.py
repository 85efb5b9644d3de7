"""Operators against brute-force versions on the smallest tables and small fixtures."""

import bisect
import hashlib
import io
import random
import re
import wave
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusflow.llm import html_text, langid, media, near_dedup, packing, pii, queries, toxicity

SF = "/root/testdata/sf0.001"


def rows_of(spark, name):
    return [r.asDict() for r in queries.QUERIES[name](spark, SF).collect()]


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def brute_components(texts, width, percent):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def test_op7_equals_brute_force(spark, docs):
    got = rows_of(spark, "op7_near_dedup")
    want, sizes = brute_components({i: r["text"] for i, r in docs.items()}, 4, 80)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == sizes
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_with_strangers_and_hot_groups(spark):
    """Many edits of one text: some linked, many just below the threshold, so both rounds have work."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = rng.choices(vocabulary, k=120)
    texts = {}
    for i in range(260):
        w = list(base)
        for _ in range(i % 7):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts[i] = " ".join(w)
    for i in range(260, 300):
        texts[i] = " ".join(rng.choices(vocabulary, k=60) + base[:60])
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame, n_words=4).collect()}
    assert got == brute_components(texts, 4, 80)[0]


def test_blocks_of_any_size_give_the_same_components(spark, monkeypatch):
    """Members of one bucket, dealt to few or many blocks by rows or by shingles: each linked pair of components is joined."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(2000)]
    base = rng.choices(vocabulary, k=80)
    texts = []
    for i in range(60):
        w = list(base)
        for _ in range(i % 6):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    sets = [near_dedup.shingle_set(t.encode(), 4) for t in texts]
    want = {(a, b) for a in range(60) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}
    rows = spark.createDataFrame([(1, i, len(sets[i]), i % 50) for i in range(60)], "bucket long, rep long, n long, c long")
    full = [(i, bytearray(near_dedup.signature(s, near_dedup.SKETCH).astype(np.uint8).tobytes()), bytearray(s.tobytes())) for i, s in enumerate(sets)]
    sketches = spark.createDataFrame(full, "rep long, sketch binary, full binary")

    def components(links):
        label = {i: i % 50 for i in range(60)}
        for a, b in links:
            old, to = label[a], label[b]
            label = {k: to if v == old else v for k, v in label.items()}
        return {frozenset(k for k in label if label[k] == v) for v in label.values()}

    for block, shingles in ((2048, 1 << 20), (7, 1 << 20), (2048, 400)):
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", shingles)
        blocks = near_dedup._block_rows(rows).join(sketches, "rep").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
        columns = ["bucket", "i", "j", "side", "rep", "n", "c", "sketch", "full"]
        found = {(r["a"], r["b"]) for r in blocks.select(columns).mapInArrow(near_dedup._block_links(80), "a long, b long").collect()}
        assert {(max(p), min(p)) for p in found} <= want
        assert components(found) == components(want)


def test_signature_is_circulant():
    s = near_dedup.shingle_set(b"a b c d e f g h i j", 4)
    whole, short = near_dedup.signature(s, 64), near_dedup.signature(s, 16)
    assert (whole[:16] == short).all()
    other = near_dedup.shingle_set(b"a b c d e f g h i k", 4)
    assert 0.3 < (near_dedup.signature(other, 4000) == near_dedup.signature(s, 4000)).mean() < 0.95


def test_op2_held_out_quality(spark, docs):
    """Planted words in generated text: all toxic documents found, no clean one."""
    rng = random.Random(3)
    words, bad = [f"wort{i}" for i in range(400)], ["zblorg", "kradeisch", "kradeung", "kradeis"]
    rows = []
    for i in range(600):
        w = rng.choices(words, k=rng.randrange(5, 60))
        y = int(i % 5 == 0)
        for _ in range(rng.randrange(1, 4) * y):
            w.insert(rng.randrange(len(w) + 1), rng.choice(bad))
        rows.append((i, " ".join(w), y))
    frame = spark.createDataFrame(rows, "doc_id long, text string, y int")
    labelled = frame.where("doc_id % 3 <> 1").selectExpr("doc_id as id", "y as label")
    learn = frame.where("doc_id % 3 <> 1").selectExpr("doc_id as id", "text")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(frame, labelled, learn).collect()}
    for i, text, y in rows:
        if i % 3 == 1:
            assert got[i]["predicted"] == y, text
            for s in got[i]["spans"]:
                assert text[s["start"] : s["end"]] in bad


def test_field_marginals_equal_brute_force():
    field = toxicity.Field({"=bad": 4.0, "4badd": 2.0}, -3.0, np.array([[0.2, -0.5], [-0.3, 0.7]]))
    tokens = ["x", "bad", "y", "z", "badd", "bad", "q"]
    scores = [field.bias + sum(field.weights.get(f, 0) for f in toxicity.features(t)) for t in tokens]
    total, toxic = 0.0, np.zeros(len(tokens))
    for k in range(2 ** len(tokens)):
        tags = [k >> i & 1 for i in range(len(tokens))]
        e = sum(s for s, t in zip(scores, tags) if t) + sum(field.moves[a, b] for a, b in zip(tags, tags[1:]))
        total += np.exp(e)
        toxic += np.exp(e) * np.array(tags)
    at = [i for i, t in enumerate(tokens) if t.startswith("bad")]
    got = field.marginals(len(tokens), at, [scores[i] for i in at])
    assert np.allclose(got, (toxic / total)[at])


def test_op9_held_out_accuracy(spark, docs):
    got = rows_of(spark, "op9_language")
    judged = [r for r in got if r["held_out"] and docs[r["doc_id"]]["lang"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in judged) >= 0.95 * len(judged)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_cross_parsing_equals_brute_force():
    train, probe = "abracadabra abba", "cadabba bra zz"
    alphabet = langid.Alphabet("abcdr")
    codes = alphabet.codes(train)
    table = langid.suffix_automaton(codes.tolist(), alphabet.pad + 1)
    table[:, alphabet.pad] = np.arange(len(table))
    x = alphabet.codes(probe)
    got = langid.parse_costs([x], [table], alphabet.pad)[0, 0]
    whole, at, phrases = bytes(codes), 0, 0
    while at < len(x):
        n = 1
        while at + n < len(x) and bytes(x[at : at + n + 1]) in whole:
            n += 1
        if bytes(x[at : at + 1]) in whole or n == 1:
            phrases += 1
        at += n
    assert abs(got * len(x) - phrases) <= 1  # an unknown character is a phrase of its own


def brute_rules(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        total = sum(v if k % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for k, v in enumerate(d[::-1]))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_op8_rules_equal_brute_force(spark, docs):
    for r in rows_of(spark, "op8_pii"):
        want = brute_rules(docs[r["doc_id"]]["text"] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r["spans"].split(",") if r["spans"] else [])
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice("a.@-+1299(  )x") for _ in range(rng.randrange(1, 60)))
        assert pii.rule_spans(text)[0] == brute_rules(text), text


def test_lstm_gradient():
    rng = np.random.default_rng(0)
    model = pii.Model()
    x, y = rng.integers(0, pii.CLASSES, (3, 7)), rng.integers(0, pii.TAGS, (3, 7))
    _, g = model.gradient(x, y)
    for name in model.p:
        for _ in range(3):
            at = tuple(rng.integers(0, n) for n in model.p[name].shape)
            if name[0] == "x":
                at = (int(x[0, 2]), at[1])
            old = model.p[name][at]
            model.p[name][at] = old + 1e-5
            up = model.gradient(x, y)[0]
            model.p[name][at] = old - 1e-5
            down = model.gradient(x, y)[0]
            model.p[name][at] = old
            assert abs((up - down) / 2e-5 - g[name][at]) < 1e-5, name


def test_model_finds_spans_like_the_rules():
    rng = random.Random(2)
    texts = []
    for _ in range(400):
        w = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 8))) for _ in range(30)]
        w[rng.randrange(5, 25)] = rng.choice([f"{w[0]}.{rng.randrange(99)}@mail{rng.randrange(9)}.example.com", ".".join(str(rng.randrange(256)) for _ in range(4)), f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}", str(rng.randrange(99))])
        texts.append(" ".join(w))
    model = pii.Model()
    model.train(*pii.training_windows(texts[:300]), epochs=12)
    hit = every = 0
    for text in texts[300:]:
        starts = pii.window_starts(text)
        tags, sure = model.decode(pii.cut(pii.char_classes(text), starts, pii.CLASSES))
        found = {s for s in pii.model_spans(text, starts, tags, np.ones_like(sure), [])}
        want = set(pii.rule_spans(text)[0])
        hit, every = hit + len(found & want), every + len(want)
    assert hit >= 0.8 * every


def test_op4_round_trip(spark, docs):
    stored = {r["doc_id"]: r for r in media.store_media(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    got = {r["doc_id"]: r for r in rows_of(spark, "op4_media")}
    by_text = defaultdict(set)
    for i, r in docs.items():
        data = (r["text"] or "").encode()
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        with wave.open(io.BytesIO(bytes(stored[i]["media"]))) as w:
            assert w.readframes(w.getnframes()) == payload and w.getsampwidth() == 1
        g = got[i]
        assert (g["n_bytes"], g["payload_bytes"]) == (len(data), len(payload))
        assert g["payload_sha256"] == hashlib.sha256(payload).hexdigest() and g["tail_crc32"] == zlib.crc32(payload[-64:])
        assert g["media_sha256"] == hashlib.sha256(bytes(stored[i]["media"])).hexdigest() and g["media_bytes"] == len(stored[i]["media"])
        by_text[r["text"]].add((g["media_sha256"], g["feature"]))
    assert all(len(v) == 1 for v in by_text.values())


def test_fingerprint_does_not_depend_on_blocks():
    samples = np.random.default_rng(1).integers(0, 256, 40_000).astype(np.uint8)
    assert (media.fingerprint(samples) == media.fingerprint(samples, block=16)).all()


def test_best_fit_is_tightest_compatible():
    rng = random.Random(9)
    sizes = sorted((rng.randrange(1, 100) for _ in range(400)), reverse=True)
    sources, clusters = [rng.randrange(6) for _ in sizes], [rng.randrange(150) for _ in sizes]
    bins, offsets = packing.best_fit(sizes, sources, clusters, 100, 2)
    room, has = {}, {}
    for s, so, c, b, o in zip(sizes, sources, clusters, bins, offsets):
        fits = [(r, k) for k, r in room.items() if r >= s and c not in has[k][1] and len(has[k][0] | {so}) <= 2]
        if fits:
            assert room[b] == min(fits)[0]
        else:
            assert b not in room
        room.setdefault(b, 100)
        has.setdefault(b, (set(), set()))
        assert o == 100 - room[b]
        room[b] -= s
        has[b][0].add(so)
        has[b][1].add(c)


def check_packing(rows, sizes):
    filled, clusters, sources, covered = Counter(), defaultdict(list), defaultdict(set), Counter()
    for r in rows:
        filled[r["bin_id"]] += r["n_words"]
        clusters[r["bin_id"]].append(r["cluster"])
        sources[r["bin_id"]].add(r["source"])
        covered[r["doc_id"]] += r["n_words"]
    assert max(filled.values()) <= packing.CAPACITY
    assert all(len(set(c)) == len(c) for c in clusters.values())
    assert all(len(s) <= packing.MAX_SOURCES for s in sources.values())
    assert covered == sizes


def test_op10_packs_everything(spark, docs):
    sizes = Counter({i: len((r["text"] or "").encode().split()) for i, r in docs.items()})
    check_packing(rows_of(spark, "op10_packing"), sizes)


def test_op3_on_the_test_pages(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    from html import unescape

    for r in rows_of(spark, "op3_html_text"):
        body = re.search(r"(?s)<article>(.*?)(?:</article>|$)", pages[r["page_id"]])[1]
        lines = [" ".join(unescape(re.sub(r"</?b>|<br>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert r["text"] == "\n".join(x for x in lines if x)
        assert r["n_chars"] == len(r["text"])


def test_html_structure():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><a>Menu</a></nav>
    <main><article><header><h1>Head &amp; line</h1><p class="byline">By me</p></header><p>One<br>two &eacute;</p><script>var a="<p>x</p>";</script>
    <div class="ad-box ad">Buy</div><ul><li>a<li>b</ul><aside>side</aside><form><p>field</p></form>
    <section id="comments"><p>nice</p></section><p hidden>secret</p><p>Last</article></main><footer>foot</footer></body></html>"""
    assert html_text.settled_text(html_text.blocks_of(page)) == "Head & line\nOne two é\na\nb\nLast"


def test_boilerplate_of_pages_without_landmarks(spark):
    line = "this very same line of nine words stands everywhere"
    rows = [(i, f"http://a.example/{i}", f"<div>{line}</div><div>own words of page number {i} are here to stay</div>") for i in range(5)]
    rows += [(9, "http://b.example/", f"<div>{line}</div>"), (10, None, None), (11, "http://a.example/e", "")]
    got = {r["page_id"]: r["text"] for r in html_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(5)] == [f"own words of page number {i} are here to stay" for i in range(5)]
    assert got[9] == line and got[10] == "" and got[11] == ""


def test_suffix_ranks_equal_sorting():
    tokens = np.random.default_rng(4).integers(0, 3, 200)
    ranks = html_text.suffix_ranks(tokens, 8)
    prefixes = [tuple(tokens[i : i + 8]) for i in range(len(tokens))]
    order = sorted(set(prefixes))
    assert [bisect.bisect_left(order, p) for p in prefixes] == ranks.tolist()
