"""Conversation repair, near vectors and spelling variants against brute force, on tables and on odd rows."""

import collections
import glob
import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from corpusflow.llm import lattice, queries, repair, variants

SF = "/root/testdata/sf0.01"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TURNS = "conv_id long, turn long, role string, text string"


def damaged(rows):
    out = {}
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        out.setdefault(c, []).extend([(t, "user" if kind == 4 else r, x)] * {0: 0, 3: 2}.get(kind, 1))
    return {c: sorted(v, key=lambda z: (z[0] is not None, z[0] or 0, *z[1:])) for c, v in out.items()}


def repaired(rows):
    """Forward search over the last initial; of equal costs the least edits."""
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, faults = set(), []
    for _, r, x in rows:
        y = x.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not y else "duplicate" if (r, x) in seen else "truncated" if y[-1] not in ".!?" else "")
        seen.add((r, x))
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    def with_insertions(ways):
        ways = dict(ways)
        for _ in range(4):
            for s, (cost, edits, lines) in list(ways.items()):
                for to in after[s].replace("s", ""):
                    way = (cost + 5, edits + "I", [*lines, names[to] + ":"])
                    if to not in ways or way[:2] < ways[to][:2]:
                        ways[to] = way
        return ways

    ways = {"": (0, "", [])}
    for (_, r, x), fault in zip(rows, faults, strict=True):
        new = {}
        for s, (cost, edits, lines) in with_insertions(ways).items():
            steps = [(s, (cost + 2, edits + "D", lines))]
            if fault in ("", "truncated"):
                late = 5 if fault else 0
                if r[:1] and r[:1] in after[s]:
                    steps.append((r[:1], (cost + late, edits + "K", [*lines, f"{r}:{x}"])))
                steps += [(to, (cost + late + 1, edits + "R", [*lines, f"{names[to]}:{x}"])) for to in after[s].replace("s", "")]
            for to, way in steps:
                if to not in new or way[:2] < new[to][:2]:
                    new[to] = way
        ways = new
    ways = with_insertions(ways)
    cost, audit, lines = min((ways[s] for s in ("", "a") if s in ways), key=lambda w: w[:2])
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)


def check_repair(frame):
    columns = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    rows = repair.with_digest(*repair.repair_conversations(repair.damage(frame))).collect()
    want = {c: repaired(v) for c, v in damaged(map(tuple, frame.select("conv_id", "turn", "role", "text").collect())).items()}
    assert len(rows) == len(want) and {r["conv_id"]: tuple(r[c] for c in columns) for r in rows} == want


def test_op11_equals_brute_force(spark):
    check_repair(spark.read.parquet(f"{SF}/conversations.parquet"))


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_embedding_dedup", "op13_spelling_variants"])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, SF).select(*want.columns)
    assert order(map(tuple, got.collect())) == order(want.fetchall())


def test_repair_of_odd_rows(spark, monkeypatch):
    """Nulls everywhere, ties, repeated rows, empty conversations, a long one in many pieces, a long text."""
    monkeypatch.setattr(repair, "PIECE", 7)
    rng, rows = random.Random(1), []
    for c in [*range(50), None]:
        for i in range(900 if c == 5 else rng.choice([1, 3, 8, 30])):
            turn = rng.choice([None, rng.randrange(12), i])
            rows.append((c, turn, rng.choice(["user", "assistant", "system", "tool", None, "", "user"]), rng.choice(["Hi.", "ok", "yes!", None, "", " a? ", "É" * 60 + rng.choice("ab.")])))
    rows += rows[:50] + [(77, 3, "user", "same.")] * 700 + [(78, None, None, None), (79, 0, "user", "word " * 50_000)]
    frame = spark.createDataFrame(rows, TURNS)
    check_repair(frame.selectExpr("*", "'x' as pid", "'x' as audit", "'x' as rid"))
    check_repair(frame.limit(0))


@pytest.mark.parametrize("seed", range(3))
def test_solver_takes_the_least_of_the_cheapest(seed):
    rng = random.Random(seed)
    solver = repair.Solver()
    for _ in range(300):
        letters = "".join(rng.choices("xsuaoSUAO", k=rng.randrange(8)))
        text = {True: "ok", False: "ok."}
        rows = [(i, {"s": "system", "u": "user", "a": "assistant", "o": "tool", "x": "user"}[c.lower()], "" if c == "x" else f"{i} {text[c.isupper()]}") for i, c in enumerate(letters)]
        assert solver.whole(letters)[:2] == repaired(rows)[5:7]


def spelled(rows):
    counts = collections.Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near, shapes = collections.defaultdict(set), collections.defaultdict(set)
    for w in words:
        for i in range(len(w)):
            shapes[w[:i], w[i + 1 :]].add(w)
            less = w[:i] + w[i + 1 :]
            if less in words:
                near[w].add(less)
                near[less].add(w)
    for group in shapes.values():
        for w in group:
            near[w] |= group - {w}
    form = {w: min(near[w], key=lambda y: (-words[y], y), default=None) for w in words}
    form = {w: f if f and words[f] >= 2 * words[w] else None for w, f in form.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (n, len(near[w]), form[w], words[form[w]] if form[w] else None, root(w)) for w, n in words.items()}


def check_words(frame):
    rows = variants.spelling_variants(frame, slip=97).collect()
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in rows}
    assert len(rows) == len(got) and got == spelled(map(tuple, frame.select("doc_id", "text").collect()))


def test_op13_equals_brute_force(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    check_words(frame)


def test_variants_of_odd_rows(spark, monkeypatch):
    """Divided blocks, very long words, letters beyond ASCII, nulls, an empty table."""
    monkeypatch.setattr(variants, "LARGE", 3)
    rng = random.Random(2)
    rows = [(i, " ".join("q" * 300 + "a" * k for k in range(i % 7, 9))) for i in range(40)]
    rows += [(None, None), (2, ""), (None, "Ünder ünder ÜNDER under unde×÷ " * 3), (None, "12 _ 漢字 éclair Éclair " * 3)]
    rows += [(i, " ".join("common" + "".join(rng.choices("abé", k=rng.randrange(5))) for _ in range(300))) for i in range(5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    check_words(frame.selectExpr("*", "'x' as word", "'x' as n", "'x' as block"))
    check_words(frame.limit(0))


def linked(rows):
    """Row by row: links and components of all pairs of usable vectors of one length."""
    ids = [r[0] for r in rows]
    usable = [i for i, (d, v) in enumerate(rows) if d is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, at = np.zeros(len(rows), int), list(range(len(rows)))
    pairs = []
    for length in {len(rows[i][1]) for i in usable}:
        own = [i for i in usable if len(rows[i][1]) == length]
        x = np.array([rows[i][1] for i in own], float)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= 0.95, 1)), strict=True):
            pairs.append((own[a], own[b]))
            links[[own[a], own[b]]] += 1
    ties = [(ids.index(ids[i]), i) for i in usable if ids.index(ids[i]) in usable]
    while True:
        before = list(at)
        for a, b in pairs + ties:
            at[a] = at[b] = min((at[a], at[b]), key=lambda k: ids[k])
        if at == before:
            break
    component = [ids[at[i]] for i in range(len(rows))]
    return [(ids[i], int(links[i]), component[i], ids[i] is not None and ids[i] == component[i]) for i in range(len(rows))], len(pairs)


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def groups(rng, dims, n, spread):
    out = []
    for d in dims:
        base = rng.normal(size=(12, d))
        for i in range(n):
            v = base[i % 12]
            out.append([float(x) for x in v + rng.normal(size=d) * rng.choice(spread) * np.linalg.norm(v) / np.sqrt(d)])
    return out


def test_op12_equals_brute_force(spark):
    got = order(map(tuple, queries.op12_embedding_dedup(spark, SF).collect()))
    want, _ = linked([tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()])
    assert got == order(want)


@pytest.mark.parametrize("block", [1024, 16])
def test_vectors_of_odd_rows(spark, monkeypatch, block):
    """Close groups in small and large blocks, repeated ids and vectors, unusable vectors, several lengths."""
    monkeypatch.setattr(lattice, "BLOCK", block)
    vectors = groups(np.random.default_rng(5), (1, 64, 200), 150, [0, 0.05, 0.1])
    rows = [(i % 400 if i % 50 else 7, v) for i, v in enumerate(vectors)]
    rows += [(900, None), (901, []), (902, [0.0] * 64), (903, [float("nan")] * 64), (904, [None] + [1.0] * 63), (None, vectors[3]), (None, None)]
    rows += [(905, [1e308] * 64), (906, [1e-300] * 64), (907, [float("inf")] * 3), (908, [-0.0, 1.0]), (909, [0.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' as digest", "'x' as rep")
    got = order(map(tuple, lattice.near_vectors(frame).collect()))
    assert got == order(linked(rows)[0])
    assert lattice.near_vectors(frame.limit(0)).collect() == []


def test_recall_at_the_bound(spark):
    """Pairs whose cosine lies at 0.95 to 0.97 are the hardest; links below the bound are never made."""
    rng = np.random.default_rng(6)
    rows = []
    for i in range(2000):
        a, b = rng.normal(size=(2, 64))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        c = rng.uniform(0.93, 0.97)
        b = c * a + np.sqrt(1 - c * c) * b / np.linalg.norm(b)
        rows += [(2 * i, [float(x) for x in a]), (2 * i + 1, [float(x) for x in b])]
    got = {r["vec_id"]: r["n_links"] for r in lattice.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    want, n = linked(rows)
    assert n > 800 and all(got[i] <= links for i, links, _, _ in want)
    assert sum(got.values()) >= 0.995 * 2 * n


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 8)) * 3
    point = lattice.nearest_e8(x)
    away = ((x - point) ** 2).sum(axis=1)
    assert ((x[:, None, :] - point[:, None, :] - lattice._roots()[None]) ** 2).sum(axis=2).min(axis=1).min() >= 0
    assert (((x[:, None, :] - point[:, None, :] - lattice._roots()[None]) ** 2).sum(axis=2).min(axis=1) >= away - 1e-9).all()
    assert (np.rint(2 * point) == 2 * point).all() and (point.sum(axis=1) % 2 == 0).all()
