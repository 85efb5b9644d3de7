"""Best-fit packing of documents into sequences, under conflicts.

Documents are dealt to shards of bounded size by a hash. In a shard they come in order of falling
size, and open bins are kept in order of residual room. Each bin carries a bitmap of its sources
and one of its duplicate clusters. A document goes to the tightest bin that is compatible: the
search starts at the smallest residual that holds it and goes on to the successor until a bin
has no document of its cluster and no more than `max_sources` sources with it; if there is none,
a new bin is opened. So copies never meet in one sequence, whatever their number.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, words

CAPACITY = 2048
MAX_SOURCES = 8
#: Pieces that a shard has on average.
SHARD_PIECES = 4000


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int, max_sources: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece, taken in the given order. Sources and clusters count from 0."""
    open_bins: list[tuple[int, int]] = []  # (residual, bin), ascending
    seen_sources: list[int] = []
    seen_clusters: list[int] = []
    bins, offsets = [], []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        i = bisect_left(open_bins, (size, -1))
        while i < len(open_bins):
            b = open_bins[i][1]
            if not seen_clusters[b] >> cluster & 1 and (seen_sources[b] | 1 << source).bit_count() <= max_sources:
                break
            i += 1
        if i < len(open_bins):
            room, b = open_bins.pop(i)
        else:
            room, b = capacity, len(seen_sources)
            seen_sources.append(0)
            seen_clusters.append(0)
        seen_sources[b] |= 1 << source
        seen_clusters[b] |= 1 << cluster
        bins.append(b)
        offsets.append(capacity - room)
        if room > size:
            insort(open_bins, (room - size, b))
    return bins, offsets


def _packer(capacity: int, max_sources: int):
    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        sources = pd.factorize(pdf["source"])[0] + 1  # null is 0
        clusters = pd.factorize(pdf["cluster"])[0]
        pdf["bin"], pdf["bin_offset"] = best_fit(pdf["n_words"].tolist(), sources.tolist(), clusters.tolist(), capacity, max_sources)
        return pdf

    def pack(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by shard; a shard is handed on when the next one begins."""
        held: list[pd.DataFrame] = []
        for pdf in frames:
            for _, part in pdf.groupby((pdf["shard"] != pdf["shard"].shift()).cumsum(), sort=False):
                if held and held[0]["shard"].iloc[0] != part["shard"].iloc[0]:
                    yield shard(pd.concat(held, ignore_index=True))
                    held = []
                held.append(part)
        if held:
            yield shard(pd.concat(held, ignore_index=True))

    return pack


def text_cluster(text: Column) -> Column:
    """Cluster key by which equal texts, after lower-casing A-Z, are copies of each other."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), 256)


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cluster: Column | None = None,
    capacity: int = CAPACITY,
    max_sources: int = MAX_SOURCES,
    shard_pieces: int = SHARD_PIECES,
) -> DataFrame:
    """One row per piece: id_col, piece, start, n_words, source, bin_id, bin_offset.

    A document of more than `capacity` words is cut into full pieces, each a sequence of its own,
    and a rest that is packed; others are one piece. start is the piece's first word. bin_id is
    unique over shards. A document without words (null text included) is one piece of 0 words in a
    bin like any other, so no row is lost; null sources are one source. Rows that repeat a document
    are in one cluster and so in different bins; ties of size go by id, cluster and piece. An empty
    table gives an empty result. `cluster` defaults to the digest of the text; other columns are
    not read.
    """
    if capacity < 1 or max_sources < 1:
        raise ValueError("capacity and max_sources are at least 1")
    key = text_cluster(F.col(text_col)) if cluster is None else cluster
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), F.xxhash64(key.cast("string")).alias("cluster")
    )
    full = F.floor(F.greatest(F.col("size") - 1, F.lit(0)) / capacity).cast("int")
    pieces = rows.select("*", F.posexplode(F.sequence(F.lit(0), full)).alias("piece", "_")).select(
        "id", "source", "cluster", "piece", (F.col("piece").cast("long") * capacity).alias("start"),
        F.least(F.lit(capacity).cast("long"), F.col("size") - F.col("piece").cast("long") * capacity).alias("n_words"),
    )
    # Copies of a text spread over shards with the rest: the hash has the id, not the cluster.
    shards = max(1, -(-pieces.count() // shard_pieces))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("id", "piece"), F.lit(shards)).cast("int"))
    ordered = dealt.repartition("shard").sortWithinPartitions("shard", F.desc("n_words"), "id", "cluster", "piece", "source")
    packed = ordered.mapInPandas(
        _packer(capacity, max_sources),
        "id long, source string, cluster long, piece int, start long, n_words long, shard int, bin long, bin_offset long",
    )
    return packed.select(
        F.col("id").alias(id_col), "piece", "start", "n_words", "source", "cluster",
        (F.col("shard").cast("long") * F.lit(1 << 32) + F.col("bin")).alias("bin_id"), "bin_offset",
    )
