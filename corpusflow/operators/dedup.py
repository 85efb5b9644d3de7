"""Per-source removal of duplicate documents and older versions.

A document's rank is (published at all, when, source type, normalised length, collected), highest
first; ties keep the order of `seq`. Exact duplicates agree in title, category, department and
content after normalisation. Versions agree in title, category and department, and in most of the
content.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_content, normalize_title, normalize_value
from ..functions.urls import part
from ..sources.shared import pin
from .rank import with_position

# Preference among source types; others have 0.
SOURCE_TYPE_PRIORITY = {"html": 6, "markdown": 5, "pdf": 4, "docx": 3, "hwp": 3, "hwpx": 3, "zip": 2, "image": 2, "file": 1, "notice": 0}
# Shortest content that is compared, and what makes two contents versions.
LEAST_LENGTH, CONTAINED, SIMILAR, SIMILAR_PATH = 200, 0.85, 0.92, 0.75

#: Bins of a text's profiles of letter sequences; sequences that share a bin only loosen the bound.
BINS = 4096
#: Characters of the longer sequences.
RUN = 6
#: Rows of a group that one task settles in order, and about as many that one task compares with them; a
#: group's later rounds take more at once, up to MOST.
BLOCK, PART, MOST = 256, 250, 2048

KEY = ["source_name", "_title", "_category", "_department"]


def source_priority(kind: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for item in SOURCE_TYPE_PRIORITY.items() for x in item])
    return F.coalesce(F.try_element_at(ranks, kind), F.lit(0))


def ranked(docs: DataFrame) -> DataFrame:
    """Adds the keys and the rank struct `_rank` (larger is better)."""
    content = normalize_content(F.col("content"))
    keyed = docs.select(
        "*",
        normalize_title(F.col("title")).alias("_title"),
        normalize_value(F.col("category")).alias("_category"),
        normalize_value(F.col("department")).alias("_department"),
        F.sha1(content).alias("_hash"),
        F.length(content).alias("_length"),
    )
    rank = F.struct(
        F.col("published_at").isNotNull().alias("has"), F.col("published_at").alias("at"), source_priority(F.col("source_type")).alias("kind"),
        F.col("_length").alias("length"), F.date_format("collected_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("seen"), (-F.col("seq")).alias("seq"),
    )
    return keyed.withColumn("_rank", rank)


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per group of exact duplicates: keys, survivor's doc_id, number removed.

    max_by keeps one row per group and task before the shuffle, so copies cost nothing.
    """
    return ranked(docs).groupBy(*KEY, "_hash").agg(
        F.max_by("doc_id", "_rank").alias("doc_id"), (F.count(F.lit(1)) - 1).alias("removed")
    )


def best_rows(docs: DataFrame) -> DataFrame:
    """Keys, names (doc_id and seq) and rank of the best row of each group of exact duplicates, without contents; made once."""
    best = ranked(docs).groupBy(*KEY, "_hash").agg(F.max_by(F.struct("doc_id", "seq"), "_rank").alias("_best"), F.max("_rank").alias("_rank"))
    return pin(best.select(*KEY, F.col("_best.doc_id").alias("doc_id"), F.col("_best.seq").alias("seq"), "_rank"))


def named(docs: DataFrame, names: DataFrame, how: str) -> DataFrame:
    """Rows of `docs` that are (left_semi) or are not (left_anti) among the names."""
    few = names.select(F.col("doc_id").alias("_doc"), F.col("seq").alias("_seq"))
    return docs.join(few, F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("seq").eqNullSafe(F.col("_seq")), how)


def exact_survivors(docs: DataFrame) -> DataFrame:
    """The best row of each group of exact duplicates; doc_id and seq together name a row.

    Only keys are aggregated, and the rows that stay are picked by their names.
    """
    return named(docs, best_rows(docs), "left_semi")


def same_document(left: str, right: str, left_path: str, right_path: str, matcher: Matcher | None = None) -> bool:
    """Whether two normalised contents of one title are versions; the better-ranked one comes first.

    A `matcher` that has seen `right` saves indexing it again.
    """
    if left == right:
        return True
    short, long = sorted((left, right), key=len)
    if len(short) < LEAST_LENGTH:
        return False
    if short in long and len(short) >= CONTAINED * len(long):
        return True
    least = SIMILAR_PATH if left_path and left_path == right_path else SIMILAR
    if 2.0 * len(short) / (len(left) + len(right)) < least:
        return False  # before the matcher indexes the text
    return matches_least(left, right, least, matcher)


class Matcher:
    """The sequence matcher's common parts, found from the few characters that it starts from.

    In a long text the matcher starts from rare characters only, those that are at most a hundredth of the
    second text, and a common part of these is then extended. So only their places are gone through.
    """

    def __init__(self, right: str) -> None:
        self.right, self.places = right, SequenceMatcher(b=right).b2j
        self.rare = np.array(sorted(ord(c) for c in self.places), np.uint32)

    def start(self, left: str) -> None:
        self.left = left
        self.starts = np.flatnonzero(np.isin(np.frombuffer(left.encode("utf-32-le", "surrogatepass"), np.uint32), self.rare)).tolist()

    def longest(self, a: int, a_end: int, b: int, b_end: int) -> tuple[int, int, int]:
        """Start in both texts and length of the common part of a range that comes first among the longest."""
        left, right, at, to, size = self.left, self.right, a, b, 0
        before: dict[int, int] = {}
        last = -2
        for i in self.starts[bisect_left(self.starts, a) : bisect_left(self.starts, a_end)]:
            here: dict[int, int] = {}
            old = before if i == last + 1 else {}
            places = self.places[left[i]]
            for j in places[bisect_left(places, b) : bisect_left(places, b_end)]:
                k = here[j] = old.get(j - 1, 0) + 1
                if k > size:
                    at, to, size = i - k + 1, j - k + 1, k
            before, last = here, i
        while at > a and to > b and left[at - 1] == right[to - 1]:
            at, to, size = at - 1, to - 1, size + 1
        while at + size < a_end and to + size < b_end and left[at + size] == right[to + size]:
            size += 1
        return at, to, size


def matches_least(left: str, right: str, least: float, matcher: Matcher | None = None) -> bool:
    """Whether the sequence matcher's ratio is at least `least`, decided as soon as its parts tell.

    The first common part splits both texts, and what stands before and behind it is matched in the
    same way. What is matched so far, and what could be at most (the shorter side of each open range),
    bound the ratio from both sides.
    """
    matcher, total = matcher or Matcher(right), len(left) + len(right)
    matcher.start(left)
    matched, most = 0, min(len(left), len(right))
    ranges = [(-most, 0, len(left), 0, len(right))]
    while ranges and 2.0 * matched / total < least <= 2.0 * (matched + most) / total:
        size, a, a_end, b, b_end = heapq.heappop(ranges)
        i, j, n = matcher.longest(a, a_end, b, b_end)
        matched, most = matched + n, most + size
        if n:
            for part in ((a, i, b, j), (i + n, a_end, j + n, b_end)):
                shorter = min(part[1] - part[0], part[3] - part[2])
                if shorter:
                    heapq.heappush(ranges, (-shorter, *part))
                    most += shorter
    return 2.0 * matched / total >= least


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def _sequences(codes: np.ndarray) -> np.ndarray:
    """A hash of each sequence of RUN characters."""
    n = len(codes) - RUN + 1
    out = np.zeros(max(n, 0), np.int64)
    for i in range(RUN if n > 0 else 0):
        out = out * 1_000_003 + codes[i : n + i]
    return out


def _most_parts(codes: np.ndarray) -> int:
    """The most common parts that the matcher finds in a second text of these characters.

    A part starts from a rare character of its own (see Matcher); only a common beginning may have none.
    """
    if len(codes) < LEAST_LENGTH:
        return len(codes)  # all characters are rare
    counts = np.unique(codes, return_counts=True)[1]
    return int(counts[counts <= len(codes) // 100 + 1].sum()) + 1


class Better:
    """Better-ranked contents of one title, and whether a content is a version of one of them.

    Matching character by character is the last step. Before it stand bounds that no version fails,
    taken for all contents at once. Two texts that match in M characters differ in the others; each
    character that goes takes at most three of the three-letter sequences with it and each one that
    comes at most two, so they share a number of sequences that M gives. And what matches lies in a few
    parts, at most as many as the second text has rare characters; a part of L characters has L - RUN + 1
    sequences of RUN characters in common, so M and the number of parts give how many those share.
    """

    def __init__(self) -> None:
        self.rows: list[tuple[str, str]] = []
        self.lengths, self.profiles = np.empty(0, np.int64), np.empty((0, 2 * BINS), np.int32)
        self.paths: dict[str, list[int]] = {}
        self.sequences: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @staticmethod
    def profile(text: str) -> np.ndarray:
        """Counts of three-letter sequences by bin, then those of sequences of RUN."""
        codes = _codes(text)
        count = lambda hashes: np.bincount(hashes % BINS, minlength=BINS)
        runs = _sequences(codes)
        return np.concatenate([count(codes[:-2] * 961 + codes[1:-1] * 31 + codes[2:]), count(runs ^ (runs >> 29))]).astype(np.int32)

    def add(self, text: str, path: str, profile: np.ndarray) -> None:
        n = len(self.rows)
        if n == len(self.lengths):
            self.lengths = np.concatenate([self.lengths, np.zeros(n + 16, np.int64)])
            self.profiles = np.concatenate([self.profiles, np.zeros((n + 16, 2 * BINS), np.int32)])
        self.rows.append((text, path))
        self.paths.setdefault(path, []).append(n)
        self.lengths[n], self.profiles[n] = len(text), profile

    def have(self, text: str, path: str, profile: np.ndarray) -> bool:
        n = len(self.rows)
        if not n:
            return False
        a, b = self.lengths[:n], len(text)
        # A contained text of the least share matches a little less than a similar one must.
        least = np.full(n, min(SIMILAR, 2 * CONTAINED / (1 + CONTAINED)))
        if path:
            least[self.paths.get(path, [])] = SIMILAR_PATH
        matched = least * (a + b) / 2 - 1e-6
        at = np.flatnonzero(np.minimum(a, b) >= matched)
        if not len(at):
            return False
        codes = _codes(text)
        runs = matched - (RUN - 1) * _most_parts(codes)
        shared = np.minimum(self.profiles[at, BINS:], profile[BINS:]).sum(axis=1, dtype=np.int32)
        at = at[shared >= runs[at]]
        shared = np.minimum(self.profiles[at, :BINS], profile[:BINS]).sum(axis=1, dtype=np.int32)
        a, m = a[at], matched[at]
        needed = np.maximum(a - 2 - 3 * (a - m) - 2 * (b - m), b - 2 - 3 * (b - m) - 2 * (a - m))
        at = at[shared >= needed]
        if not len(at):
            return False
        own = np.unique(_sequences(codes), return_counts=True)
        matcher: Matcher | None = None
        for i in at:
            if runs[i] > 0 and self._shared(int(i), own) < runs[i]:
                continue
            matcher = matcher or Matcher(text)
            if same_document(self.rows[i][0], text, self.rows[i][1], path, matcher):
                return True
        return False

    def _shared(self, i: int, own: tuple[np.ndarray, np.ndarray]) -> int:
        """How many sequences of RUN characters the i-th content shares, counted one by one where bins are too coarse."""
        if i not in self.sequences:
            self.sequences[i] = np.unique(_sequences(_codes(self.rows[i][0])), return_counts=True)
        other = self.sequences[i]
        _, x, y = np.intersect1d(other[0], own[0], assume_unique=True, return_indices=True)
        return int(np.minimum(other[1][x], own[1][y]).sum())


def _greedy(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come by group and falling rank, at most a block of each group. Yields what is kept."""
    group: tuple | None = None
    kept = Better()
    for pdf in frames:
        keep = []
        for row in pdf.itertuples(index=False):
            key = (row.source_name, row.title, row.category, row.department)
            if key != group:
                group, kept = key, Better()
            profile = kept.profile(row.content)
            found = kept.have(row.content, row.path, profile)
            if not found:
                kept.add(row.content, row.path, profile)
            keep.append(not found)
        yield pdf.loc[keep]


def _unlike(rows: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
    """The rows that are no version of a kept, better-ranked one."""
    better = Better()
    for row in kept.itertuples(index=False):
        better.add(row.content, row.path, better.profile(row.content))
    fresh = [not better.have(row.content, row.path, better.profile(row.content)) for row in rows.itertuples(index=False)]
    return rows.loc[fresh, ["doc_id", "seq"]]


def version_survivors(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Of exact survivors of `docs`, the rows that are no version of a better-ranked kept row of their group."""
    return named(docs, version_names(docs, best_rows(docs), block), "left_semi")


def version_names(docs: DataFrame, keyed: DataFrame, block: int = BLOCK) -> DataFrame:
    """Source and name of the rows that stay, of the best rows `keyed` of all groups of exact duplicates.

    The greedy order is settled in rounds. A round takes the `block` best undecided rows of each
    group, settles them in one task, and compares what it keeps with all other undecided rows of the
    group, which are dealt out in parts of about `PART` rows or a block; those that match are dropped. The
    first rounds drop what has many versions; blocks then double up to `MOST` rows. So a task
    holds a part and a block, however large a group is. A group takes as many rounds as blocks are
    needed for what is neither kept nor dropped before. Groups of one row, nearly all, are passed by.
    """
    keys = ["source_name", "title", "category", "department"]
    sizes = keyed.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_size")).where("_size > 1")
    several = pin(keyed.join(sizes, KEY))
    texts = named(docs, several, "left_semi").select("doc_id", "seq", normalize_content(F.col("content")).alias("content"), F.lower(part(F.coalesce("source_url", F.lit("")), "path")).alias("path"))
    slim = several.join(texts, ["doc_id", "seq"]).select(
        F.coalesce("source_name", F.lit("")).alias("source_name"), F.col("_title").alias("title"), F.col("_category").alias("category"),
        F.col("_department").alias("department"), "content", "path", "doc_id", "seq", "_rank", "_size",
    )
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_rank")))
    small, undecided = slim.where(F.col("_size") <= block), slim.where(F.col("_size") > block)
    kept = _settled(small, keys).select("doc_id", "seq")
    undecided, most = pin(undecided), max(block, MOST)
    while not undecided.isEmpty():
        places = undecided.select(*keys, "doc_id", "seq", "_rank").withColumn("_nth", nth).where(F.col("_nth") <= block).select("doc_id", "seq")
        best = pin(places)
        parts = F.ceil(F.col("_size") / max(PART, block)).cast("int")
        found = pin(_settled(undecided.join(best, ["doc_id", "seq"], "left_semi"), keys))
        kept = kept.unionByName(found.select("doc_id", "seq"))
        left = undecided.join(best, ["doc_id", "seq"], "left_anti").withColumn("_part", F.pmod(F.xxhash64("doc_id", "seq"), parts).cast("int"))
        dealt = found.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
        left = left.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "_part")
        slices = left.drop("_rank", "_size").groupBy(*keys, "_part").cogroup(dealt.drop("_size").groupBy(*keys, "_part"))
        undecided = pin(undecided.join(slices.applyInPandas(_unlike, "doc_id string, seq long"), ["doc_id", "seq"], "left_semi"))
        block = min(2 * block, most)
    gone = several.select("doc_id", "seq").join(kept, ["doc_id", "seq"], "left_anti")
    return pin(keyed.select("source_name", "doc_id", "seq").join(gone, ["doc_id", "seq"], "left_anti"))


def _settled(rows: DataFrame, keys: list[str]) -> DataFrame:
    """What the greedy pass keeps of a block of each group."""
    # Matching costs far more than reading, so partitions are not merged by their bytes.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(parts, *keys).sortWithinPartitions(*keys, F.desc("_rank")).drop("_rank")
    return ordered.mapInPandas(_greedy, ordered.schema)


def dedup_metrics(docs: DataFrame, exact: DataFrame, versions: DataFrame) -> DataFrame:
    """Per source: total_input, total_output, exact and version duplicates removed."""
    count = lambda df, name: df.groupBy("source_name").agg(F.count(F.lit(1)).alias(name))
    joined = count(docs, "total_input").join(count(exact, "_exact"), "source_name", "left").join(count(versions, "total_output"), "source_name", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return joined.select(
        "source_name", "total_input", zero(F.col("total_output")).alias("total_output"),
        (F.col("total_input") - zero(F.col("_exact"))).alias("exact_duplicates_removed"),
        (zero(F.col("_exact")) - zero(F.col("total_output"))).alias("version_duplicates_removed"),
    )


def by_rank(docs: DataFrame) -> DataFrame:
    """Global order of survivors, best first, as a position from 1."""
    best = ranked(docs)
    return with_position(best.select(*docs.columns, "_rank"), [F.desc("_rank")]).drop("_rank")


def first_per(docs: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given total order."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return docs.withColumn("_nth", nth).where("_nth = 1").drop("_nth")
