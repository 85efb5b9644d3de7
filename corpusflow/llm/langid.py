"""Language identification by cross-parsing.

Each language has a suffix automaton of some labelled text. A text is parsed against it greedily:
every phrase is the longest match found anywhere in the labelled text, and a mismatch starts the
next phrase. Text of the language falls into few long phrases, other text into many short ones;
phrases per character is the cross-parsing entropy, and the language with the least wins.

Automata are small tables of transitions, so many stretches of text are parsed in lockstep with
numpy: a dense table for the most common letters of all languages, a sorted list for all other
letters. Texts are parsed whole, in stretches of `STRETCH` characters that phrases do not cross.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sampling import bounded_sample

STRETCH = 256
#: Letters with a column in the dense tables; transitions by other letters are looked up by key.
ALPHABET = 62
#: Bounds of what is fitted on: documents and characters of a language, and characters over all
#: languages together; every language of the labels is learned.
SAMPLE_DOCS, LANGUAGE_CHARS, ALL_CHARS = 200, 40_000, 800_000
UNDETERMINED = "und"
#: Above all codes.
SPAN = 1 << 21


def transitions(codes: Iterable[int]) -> list[dict[int, int]]:
    """Suffix automaton of `codes`: the next state by code, of each state."""
    nexts: list[dict[int, int]] = [{}]
    links, lengths, last = [-1], [0], 0
    for c in codes:
        new = len(nexts)
        nexts.append({})
        lengths.append(lengths[last] + 1)
        links.append(0)
        p = last
        while p != -1 and c not in nexts[p]:
            nexts[p][c] = new
            p = links[p]
        if p != -1:
            q = nexts[p][c]
            if lengths[q] == lengths[p] + 1:
                links[new] = q
            else:
                copy = len(nexts)
                nexts.append(dict(nexts[q]))
                lengths.append(lengths[p] + 1)
                links.append(links[q])
                links[q] = links[new] = copy
                while p != -1 and nexts[p].get(c) == q:
                    nexts[p][c] = copy
                    p = links[p]
        last = new
    return nexts


def suffix_automaton(codes: Iterable[int], width: int) -> np.ndarray:
    """Transition table [state, code] of all substrings of `codes`; -1 where there is none."""
    return split_automaton(codes, width)[0]


def split_automaton(codes: Iterable[int], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table of the codes below `width`; sorted keys (state * SPAN + code) and next states of the others."""
    nexts = transitions(codes)
    table = np.full((len(nexts), width), -1, np.int32)
    keys, ends = [], []
    for state, out in enumerate(nexts):
        for c, to in sorted(out.items()):
            if c < width:
                table[state, c] = to
            else:
                keys.append(state * SPAN + c)
                ends.append(to)
    return table, np.array(keys, np.int64), np.array(ends, np.int32)


class Alphabet:
    """Codes of characters: 0 for all that are no letters, 1 for letters not learned, then `letters`, padding and `rare` letters.

    `table` has the code of every code point; it is made here if not given.
    """

    def __init__(self, letters: str, rare: str = "", table: np.ndarray | None = None) -> None:
        self.pad = len(letters) + 2
        if table is None:
            kind = np.uint8 if self.pad + len(rare) < 256 else np.int32
            table = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000).astype(kind)
            for i, c in enumerate(letters):
                table[ord(c)] = i + 2
            for i, c in enumerate(rare):
                table[ord(c)] = self.pad + 1 + i
        self.letters, self.table = letters, table

    def codes(self, text: str) -> np.ndarray:
        """Lower-cased; runs of non-letters become one code, and one stands before and after."""
        points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
        out = self.table[points]
        gap = out == 0
        return out[~(gap & np.concatenate(([False], gap[:-1])))]


Sparse = tuple[np.ndarray, np.ndarray]


def look_up(sparse: Sparse, wanted: np.ndarray) -> np.ndarray:
    """Next states by key; -1 where there is none."""
    keys, ends = sparse
    if not len(keys):
        return np.full(len(wanted), -1, np.int32)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, ends[at], -1)


def parse_costs(docs: list[np.ndarray], tables: list[np.ndarray], pad: int, sparse: list[Sparse] | None = None) -> np.ndarray:
    """Phrases per character of each document (row) against each automaton (column)."""
    counts = [-(-len(d) // STRETCH) for d in docs]
    lanes = np.full((max(1, sum(counts)), STRETCH), pad, docs[0].dtype if docs else np.uint8)
    owner = np.repeat(np.arange(len(docs)), counts)
    at = 0
    for d, n in zip(docs, counts, strict=True):
        lanes[at : at + n].reshape(-1)[: len(d)] = d
        at += n
    steps = np.ascontiguousarray(lanes.T).astype(np.int32)
    rare = [np.flatnonzero(c > pad) for c in steps]
    others = [c[r].astype(np.int64) for c, r in zip(steps, rare, strict=True)]
    steps[steps > pad] = 1
    sizes = np.array([max(1, len(d)) for d in docs], float)
    out = np.empty((len(docs), len(tables)))
    for k, table in enumerate(tables):
        width = table.shape[1]
        flat, root = table.reshape(-1), np.maximum(table[0], 0)
        state = np.zeros(lanes.shape[0], np.int32)
        phrases = np.zeros(lanes.shape[0], np.int32)
        for c, r, o in zip(steps, rare, others, strict=True):
            to = flat[state * width + c]
            if len(r) and sparse:
                to[r] = look_up(sparse[k], state[r] * SPAN + o)
            broken = to < 0
            before, state = state, np.where(broken, root[c], to)
            if len(r) and sparse:
                again = np.flatnonzero(broken[r])
                state[r[again]] = np.maximum(look_up(sparse[k], o[again]), 0)
            # What breaks off a phrase ends it, and an unknown letter is then a phrase of its own.
            phrases += broken
            phrases += broken & (before != 0) & (state == 0)
        phrases += state != 0
        out[:, k] = np.bincount(owner, phrases[: len(owner)], len(docs)) / sizes
    return out


def fit(labelled: DataFrame, docs: DataFrame) -> tuple[list[str], Alphabet, list[np.ndarray], list[Sparse]]:
    """Languages in order of name, the alphabet, and the tables and sorted lists of the languages."""
    sample = bounded_sample(labelled, docs, SAMPLE_DOCS, LANGUAGE_CHARS, ALL_CHARS)
    texts: dict[str, list[str]] = {}
    for lang, _, text in sample:
        if any(c.isalpha() for c in text):
            texts.setdefault(lang, []).append(text)
    common = Counter(c for parts in texts.values() for t in parts for c in t.lower() if c.isalpha())
    ordered = [c for c, _ in sorted(common.items(), key=lambda x: (-x[1], x[0]))]
    alphabet = Alphabet("".join(sorted(ordered[:ALPHABET])), "".join(sorted(ordered[ALPHABET:])))
    langs = sorted(texts)
    most = min(LANGUAGE_CHARS, ALL_CHARS // max(1, len(langs)))
    tables, sparse = [], []
    for lang in langs:
        codes = np.concatenate([alphabet.codes(t) for t in texts[lang]])[:most]
        table, keys, ends = split_automaton(codes.tolist(), alphabet.pad + 1)
        table[:, alphabet.pad] = np.arange(len(table))  # padding leaves the state as it is
        tables.append(table)
        sparse.append((keys, ends))
    return langs, alphabet, tables, sparse


def identify_language(
    docs: DataFrame, labelled: DataFrame, fit_on: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of `docs`: id_col, lang_pred, score.

    `labelled` has id and label (null labels are ignored), `fit_on` has id and text and defaults to
    `docs`. lang_pred is a learned label, or "und" with score 0 if the text is null or has no
    letter, or nothing was learned. score is the second-lowest cost over the sum of the lowest two,
    from 0.5 (a tie, which goes to the first name) to 1 (also with one language only). Repeated
    rows get equal results; an empty table gives an empty one; no other columns are read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = identify_rows(rows, labelled, rows if fit_on is None else fit_on)
    return found.select(F.col("id").alias(id_col), "lang_pred", "score")


def identify_rows(
    docs: DataFrame, labelled: DataFrame, fit_on: DataFrame, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score"
) -> DataFrame:
    """The rows of `docs` with all their columns, and the two results under names that it lacks."""
    if {pred_col.lower(), score_col.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError("the names of the results are taken")
    langs, learned, tables, sparse = fit(labelled, fit_on)
    letters = learned.letters
    model = docs.sparkSession.sparkContext.broadcast((tables, sparse, learned.table))  # at most 2 * ALL_CHARS states

    def settle(texts: list[np.ndarray | None], alphabet: Alphabet) -> tuple[list[str], list[float]]:
        names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        real = [i for i, t in enumerate(texts) if t is not None]
        if not real or not langs:
            return names, scores
        costs = parse_costs([texts[i] for i in real], model.value[0], alphabet.pad, model.value[1])
        order = np.argsort(costs, axis=1, kind="stable")
        for j, i in enumerate(real):
            names[i] = langs[order[j, 0]]
            low = costs[j, order[j, 0]]
            scores[i] = float(costs[j, order[j, 1]] / (costs[j, order[j, 1]] + low)) if len(langs) > 1 else 1.0
        return names, scores

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet = Alphabet(letters, table=model.value[2])
        for batch in batches:
            at = 0
            while at < len(batch):
                coded, size, end = [], 0, at
                while end < len(batch) and size < 3_000_000:
                    text = batch.column(text_col)[end].as_py()
                    codes = None if text is None else alphabet.codes(text)
                    coded.append(codes if codes is not None and codes.any() else None)
                    size += len(text or "") + STRETCH
                    end += 1
                names, scores = settle(coded, alphabet)
                part = batch.slice(at, end - at)
                columns = {n: part.column(n) for n in part.schema.names}
                yield pa.record_batch(columns | {pred_col: pa.array(names, pa.string()), score_col: pa.array(scores, pa.float64())})
                at = end

    schema = T.StructType([*docs.schema.fields, T.StructField(pred_col, T.StringType()), T.StructField(score_col, T.DoubleType())])
    return docs.mapInArrow(predict, schema)
