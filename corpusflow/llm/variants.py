"""Spelling variants: words one edit apart, by forward and reversed sorted dictionaries.

One inserted, deleted or replaced character leaves one half of a word intact. So two near words, the
shorter of m characters, share their first m // 2 characters or the last m - m // 2. All words are put
into blocks by their shared beginning (the forward dictionary) and by their shared end (the reversed
one); a block is a range of its dictionary and is scanned by one task. A block with more than LARGE
words is divided: what is left of the words between the shared ends again has an intact half, so each
word goes on into a narrower block of either kind, until blocks are small or one character is left,
when the alphabet bounds them. Every near pair is found once: in the block of its longest shared
beginning, which a block knows by the range `lo <= shared < upper`.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, lookup, pin, whole_blocks

LETTERS = "A-Za-zÀ-ÿ"
#: Words of a block that is divided no further, and pairs that are compared at a time.
LARGE, PAIRS = 200, 1 << 18
BLOCK = ["m", "lo", "hi", "upper", "head", "tail"]


def count_words(docs: DataFrame, id_col: str, text_col: str, least_length: int, least_count: int, slip: int | None) -> DataFrame:
    """word and n, of maximal runs of letters after lower-casing A-Z.

    With `slip`, a run whose document and text have a checksum that `slip` divides loses a letter, as
    a slip of the hand: planted variants, chosen alike on every run. Runs shorter than `least_length`
    cannot become words, so the pattern does not match them. A null id counts as an empty one.
    """
    run = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0)))
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), run.alias("run"))
    runs = runs.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    if slip is not None:
        h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
        runs = runs.withColumn("h", h).select(F.when(F.col("h") % slip == 0, _without(F.col("run"), F.col("h"))).otherwise(F.col("run")).alias("run"))
    counts = runs.groupBy(F.col("run").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return counts.where((F.col("n") >= least_count) & (F.length("word") >= least_length))


def _without(run: Column, h: Column) -> Column:
    at = (h % F.length(run)).cast("int")
    return F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))


def _blocks(words: DataFrame, least_length: int) -> DataFrame:
    """Each word in both dictionaries, as the shorter and as the longer word of a pair."""
    length = F.length("word")
    m = F.explode(F.array(length, length - 1))
    each = words.select("word", "n", m.alias("m")).where(F.col("m") >= least_length)
    half = F.floor(F.col("m") / 2).cast("int")
    # A shared beginning of half the letters or more, or a shorter one and the rest of the letters at the end.
    sides = F.explode(
        F.array(
            F.struct(half.alias("lo"), F.lit(0).alias("hi"), (F.col("m") + 1).cast("int").alias("upper")),
            F.struct(F.lit(0).alias("lo"), (F.col("m") - half).cast("int").alias("hi"), half.alias("upper")),
        )
    )
    return _keyed(each.select("word", "n", "m", sides.alias("s")).select("word", "n", "m", "s.*"))


def _keyed(rows: DataFrame) -> DataFrame:
    tail = F.when(F.col("hi") > 0, F.reverse(F.right("word", F.col("hi")))).otherwise("")
    rows = rows.withColumn("head", F.left("word", F.col("lo"))).withColumn("tail", tail)
    return rows.withColumn("block", F.concat_ws(" ", *BLOCK))


def _divided(rows: DataFrame) -> DataFrame:
    """Blocks within blocks: the open letters share their first half, or the last half and less than that."""
    rest = F.col("m") - F.col("lo") - F.col("hi")
    half = F.floor(rest / 2).cast("int")
    further = F.explode(
        F.array(
            F.struct((F.col("lo") + half).alias("lo"), F.col("hi").alias("hi"), F.col("upper").alias("upper")),
            F.struct(F.col("lo").alias("lo"), (F.col("hi") + rest - half).cast("int").alias("hi"), F.least("upper", F.col("lo") + half).alias("upper")),
        )
    )
    found = rows.select("word", "n", "m", further.alias("s")).select("word", "n", "m", "s.*")
    return _keyed(found.where("lo < upper"))


def _near_pairs(codes: np.ndarray, lengths: np.ndarray, ends: np.ndarray, m: np.ndarray, upper: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one block that are one edit apart; rows are sorted by block and length."""
    width = codes.shape[1]
    ended = np.zeros_like(codes)
    for n in np.unique(lengths):
        of = lengths == n
        ended[of, width - n :] = codes[of, :n]
    rows = np.arange(len(codes))
    partners = np.where(lengths == m, ends - rows - 1, 0)
    step = max(1, PAIRS * 32 // max(width, 32))
    first = 0
    upto = np.cumsum(partners)
    while first < len(rows):
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + step)))
        k = partners[first:last]
        i = np.repeat(rows[first:last], k)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k)
        for a in range(0, len(i), step):
            x, y = i[a : a + step], j[a : a + step]
            shared = (codes[x] != codes[y]).argmax(axis=1)
            at_end = (ended[x] != ended[y])[:, ::-1].argmax(axis=1)
            near = (shared + at_end >= np.maximum(lengths[x], lengths[y]) - 1) & (shared < upper[x])
            yield x[near], y[near]
        first = last


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block. Per word of a block: how many near words it has there, and the best of them."""

    def settle(part: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        words, n, m, upper = (part.column(c).to_numpy() for c in ("word", "n", "m", "upper"))
        found_x, found_y = [], []
        text = [w.encode("latin-1") for w in words]
        lengths = np.array([len(t) for t in text])
        bounds = np.append(starts, len(text))
        ends = np.repeat(bounds[1:], np.diff(bounds))
        codes = np.zeros((len(text), int(lengths.max()) + 1), np.uint8)
        for k in np.unique(lengths):
            of = np.flatnonzero(lengths == k)
            codes[of, :k] = np.frombuffer(b"".join([text[r] for r in of]), np.uint8).reshape(-1, k)
        for x, y in _near_pairs(codes, lengths, ends, m, upper):
            found_x += [x, y]
            found_y += [y, x]
        x, y = np.concatenate(found_x), np.concatenate(found_y)
        rank = np.empty(len(text), np.int64)
        rank[sorted(range(len(text)), key=text.__getitem__)] = np.arange(len(text))
        order = np.lexsort((rank[y], -n[y], x))
        x, y = x[order], y[order]
        own, at, near = np.unique(x, return_index=True, return_counts=True)
        best = y[at]
        return pa.record_batch(
            {"word": pa.array(words[own], pa.string()), "near": pa.array(near, pa.int64()), "best_n": pa.array(n[best], pa.int64()), "best": pa.array(words[best], pa.string())}
        )

    for table, starts in whole_blocks(batches, "block"):
        yield settle(table, starts)


def near_words(words: DataFrame, least_length: int) -> DataFrame:
    """word, near (how many words are one edit away), best_n and best: the most frequent of these, the smallest of equals.

    `words` has distinct words and n; words without a near word are not returned.
    """
    small = None
    rows = _blocks(words, least_length)
    while True:
        # The counts are made before words move; a block without a pair goes at once.
        sizes = rows.groupBy("block").agg(F.count(F.lit(1)).alias("size"), F.count_if(F.length("word") == F.col("m")).alias("shorter"))
        sizes = pin(sizes.where("size > 1 and shorter > 0"))
        total = sizes.agg(F.sum("size")).first()[0] or 0
        sized = lookup(rows, sizes, "block", "size", total).where("size is not null")
        done = (F.col("size") <= LARGE) | (F.col("m") - F.col("lo") - F.col("hi") < 2)
        sized = pin(sized.drop("shorter"))
        ready = sized.where(done).drop("size")
        small = ready if small is None else small.unionByName(ready)
        large = sized.where(~done).drop("size")
        if large.isEmpty():
            break
        rows = _divided(large)
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = small.select(*BLOCK, "block", F.length("word").alias("length"), "word", "n").repartitionByRange(parts, *BLOCK)
    found = dealt.sortWithinPartitions(*BLOCK, "length", "word").select("block", "m", "upper", "word", "n")
    partial = found.mapInArrow(_scan, "word string, near long, best_n long, best string")
    top = F.min(F.struct((-F.col("best_n")).alias("down"), F.col("best").alias("best")))
    return partial.groupBy("word").agg(F.sum("near").alias("near"), top.alias("top")).select("word", "near", (-F.col("top.down")).alias("best_n"), F.col("top.best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """word and root for words that have a form: pointers are doubled until none moves.

    A form is at least twice as frequent as its word, so chains are short and have no circle.
    """
    at = pin(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("far"))
        moved = at.join(ahead, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved"))
        at = pin(moved)
        if not at.where("moved").limit(1).count():
            return at.drop("moved")


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5, least_count: int = 3, ratio: int = 2, slip: int | None = None
) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n and root.

    Words are maximal runs of Latin letters (to U+00FF) after lower-casing A-Z, of at least `least_length`
    letters that occur at least `least_count` times. A word's form is the most frequent word one
    inserted, deleted or replaced letter away (of equals the smallest), if it is at least `ratio`
    times as frequent; the root is where forms lead to. `slip` plants variants, see count_words.

    Null texts have no words; repeated rows count as often as they stand; an empty table gives an
    empty result; words may be as long as a text. Only the two named columns are read.
    """
    words = pin(count_words(docs, id_col, text_col, least_length, least_count, slip))
    near = near_words(words, least_length)
    joined = words.join(near, "word", "left")
    has = F.col("best_n") >= ratio * F.col("n")
    named = pin(
        joined.select(
            "word", "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")
        )
    )
    roots = _roots(named.where("form is not null"))
    return named.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
