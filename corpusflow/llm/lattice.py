"""Near duplicates among vectors by lattice hashing.

A unit vector is projected at random to eight dimensions and decoded to the nearest point of the E8
lattice, whose cell is a bucket; several tables have projections of their own. A vector stands in its own
cell of a table and probes the neighbouring cells that are next nearest to it. So two vectors meet in a
table if they share a cell or one of them probes the other's.

Equal vectors are one class. Buckets first compare 128-bit signs of random directions, so that only
places where a vector has a likely partner get its components; these are compared by cosine in double
precision. A pair may meet in many places: it counts where it meets first, in the order of tables, and no
pair leaves its task, only counts and the links that join components. Large buckets are compared in
blocks, all of them.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lookup, pin, whole_blocks
from .components import connected_components

#: With a cell of 1.6 / sqrt(dimensions) a table brings together 86 % of the pairs of cosine 0.95 (97 % at
#: 0.98, 0.7 % of unrelated ones), so five miss 5 in 100,000 of those at the bound and fewer of the closer ones.
TABLES, PROBES, CELL = 5, 4, 1.6
#: Signs of a sketch, and how many standard deviations above the mean of the bound's pairs may differ.
SIGNS, SLACK = 128, 6
#: Rows of a side of a block, and components of the pairs that are compared at a time.
BLOCK, STEP = 1024, 1 << 22


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of 1 or -1, or eight halves with an even number of minus signs."""
    pairs = np.zeros((112, 8))
    for row, ((i, j), (s, t)) in zip(pairs, itertools.product(itertools.combinations(range(8), 2), itertools.product((1, -1), repeat=2)), strict=True):
        row[[i, j]] = s, t
    halves = np.array(list(itertools.product((0.5, -0.5), repeat=8)))
    return np.concatenate([pairs, halves[(halves < 0).sum(axis=1) % 2 == 0]])


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest lattice point of each row: integers of an even sum, or all of them shifted by a half."""

    def even(y: np.ndarray) -> np.ndarray:
        point = np.rint(y)
        rest = y - point
        odd = np.flatnonzero(point.sum(axis=1) % 2)
        worst = np.abs(rest[odd]).argmax(axis=1)
        point[odd, worst] += np.where(rest[odd, worst] >= 0, 1, -1)
        return point

    whole, half = even(x), even(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(nearer[:, None], whole, half)


def _random(dim: int, n: int, seed: int) -> np.ndarray:
    """n random directions; orthogonal ones where the dimensions allow it and n is that of a lattice."""
    made = np.random.default_rng([seed, dim]).normal(size=(dim, n))
    if dim >= n == 8:
        made = np.linalg.qr(made)[0]
    return made / np.linalg.norm(made, axis=0)


def lattice_codes(unit: np.ndarray, tables: int, probes: int) -> np.ndarray:
    """Per row and table the code of its own cell, then those of the cells that it probes."""
    n, dim = unit.shape
    roots = _roots()
    out = np.empty((n, tables, 1 + probes), np.int64)
    for t in range(tables):
        at = unit @ _random(dim, 8, t) / (CELL / np.sqrt(dim))
        own = nearest_e8(at)
        # The neighbour c + v is at |e|^2 - 2 e.v + 2 from a vector that is e away from its cell's centre c.
        closest = np.argsort(-((at - own) @ roots.T), axis=1, kind="stable")[:, :probes]
        cells = np.concatenate([own[:, None, :], own[:, None, :] + roots[closest]], axis=1)
        whole = np.rint(2 * cells).astype(np.int32)
        for p in range(1 + probes):
            out[:, t, p] = [xxhash.xxh64_intdigest(c.tobytes(), seed=dim * 1024 + t) - (1 << 63) for c in whole[:, p]]
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrices of the lists of each length; a null component is not a number."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == n)
        yield rows, column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)


def _reader(kind: np.dtype):
    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A digest per vector that can have links, of its exact components."""
        for batch in batches:
            digests, vectors = [None] * len(batch), [None] * len(batch)
            for rows, x in _by_length(batch.column("vector")):
                x = x.astype(kind) + kind.type(0)  # one zero
                good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
                for r, v in zip(rows[good], x[good], strict=True):
                    vectors[r] = v.tobytes()
                    digests[r] = hashlib.blake2b(vectors[r], digest_size=16).digest()
            yield pa.record_batch({"id": batch.column("id"), "digest": pa.array(digests, pa.binary()), "vector": pa.array(vectors, pa.binary())})

    return read


def _matrix(column: pa.Array | pa.ChunkedArray, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(np.float64)


def _coder(kind: np.dtype, tables: int, probes: int):
    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.binary_length(batch.column("vector")).to_numpy()
            for n in np.unique(size):
                part = batch.filter(pa.array(size == n))
                unit = _unit(_matrix(part.column("vector"), kind))
                codes = lattice_codes(unit, tables, probes).reshape(len(part), -1)
                signs = np.packbits(unit @ _random(unit.shape[1], SIGNS, 1000) > 0, axis=1).view(np.int64)
                lists = pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * codes.shape[1], pa.array(codes.ravel()))
                yield pa.record_batch(
                    [*part.columns, lists, pa.array(signs[:, 0]), pa.array(signs[:, 1])], names=[*part.schema.names, "codes", "s0", "s1"]
                )

    return code


def _meetings(sides: np.ndarray, is_left: np.ndarray, starts: np.ndarray, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that a block compares. Rows of a block are sorted by order: those of the left side come first.

    A row of side 2 is on both sides and meets the rows after it, one of side 0 those of side 1.
    """
    bounds = np.append(starts, len(sides))
    block = np.repeat(np.arange(len(starts)), np.diff(bounds))
    rows = np.arange(len(sides))
    left = np.bincount(block, weights=is_left, minlength=len(starts)).astype(np.int64)
    begin = np.where(sides == 2, rows + 1, starts[block] + left[block])
    partners = np.where(is_left, bounds[1:][block] - begin, 0)
    upto = np.cumsum(partners)
    first = 0
    while first < len(rows):
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + step, "right")))
        k = partners[first:last]
        x = np.repeat(rows[first:last], k)
        yield x, np.repeat(begin[first:last], k) + np.arange(len(x)) - np.repeat(np.cumsum(k) - k, k)
        first = last


def _likely(least: float):
    share = np.arccos(least) / np.pi
    most = SIGNS * share + SLACK * np.sqrt(SIGNS * share * (1 - share))

    def likely(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of blocks that have a partner whose sketch does not rule it out."""
        for table, starts in whole_blocks(batches, "bucket", "i", "j"):
            sides, own = (table.column(c).to_numpy() for c in ("side", "own"))
            s0, s1 = (table.column(c).to_numpy().view(np.uint64) for c in ("s0", "s1"))  # bits of a negative number are counted by its size
            has = np.zeros(len(table), bool)
            for x, y in _meetings(sides, own & (sides != 1), starts, STEP // 16):
                close = np.bitwise_count(s0[x] ^ s0[y]) + np.bitwise_count(s1[x] ^ s1[y]) <= most
                has[x[close]] = has[y[close]] = True
            out = table.filter(pa.array(has)).combine_chunks().select(["digest", "t", "bucket", "i", "j", "side", "own"])
            yield from out.to_batches()

    return likely


def _linker(kind: np.dtype, least: float, tables: int, probes: int):
    def link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts per digest, and links that join components, of whole blocks."""
        for table, starts in whole_blocks(batches, "bucket", "i", "j"):
            digest = table.column("digest").to_pylist()
            sides, own, t, rep, copies = (table.column(c).to_numpy() for c in ("side", "own", "t", "rep", "copies"))
            order = np.empty(len(digest), np.int64)
            order[sorted(range(len(digest)), key=digest.__getitem__)] = np.arange(len(digest))
            codes = table.column("codes").combine_chunks().flatten().to_numpy().reshape(-1, tables, 1 + probes)
            # Blocks hold vectors of one length, as codes depend on it; tables need not.
            sizes = pc.binary_length(table.column("vector")).to_numpy()
            unit = np.zeros((len(sizes), sizes.max() // kind.itemsize))
            for n in np.unique(sizes):
                of = np.flatnonzero(sizes == n)
                unit[of, : n // kind.itemsize] = _unit(_matrix(table.column("vector").take(pa.array(of)), kind))
            count, label = np.zeros(len(digest), np.int64), np.arange(len(digest))
            for x, y in _meetings(sides, own & (sides != 1), starts, max(1, STEP // unit.shape[1])):
                near = np.einsum("ij,ij->i", unit[x], unit[y]) >= least
                x, y = x[near], y[near]
                before = np.zeros(len(x), bool)
                for s in range(tables):
                    mine, other = codes[x, s], codes[y, s]
                    probed = (mine[:, 1:] == other[:, :1]).any(axis=1)
                    met = (mine[:, 0] == other[:, 0]) | probed | (other[:, 1:] == mine[:, :1]).any(axis=1)
                    # Within the table itself: if both probe each other, it counts in the cell of the smaller digest.
                    before |= np.where(s < t[x], met, (s == t[x]) & ~own[y] & probed & (order[y] < order[x]))
                np.add.at(count, x[~before], copies[y[~before]])
                np.add.at(count, y[~before], copies[x[~before]])
                while True:
                    low = np.minimum(label[x], label[y])
                    moved = label.copy()
                    np.minimum.at(moved, x, low)
                    np.minimum.at(moved, y, low)
                    np.minimum.at(moved, label[x], low)
                    np.minimum.at(moved, label[y], low)
                    moved = moved[moved]
                    if (moved == label).all():
                        break
                    label = moved
            some, tied = np.flatnonzero(count), np.flatnonzero(label != np.arange(len(label)))
            none = lambda n, kind: pa.nulls(n, kind)
            names = ["digest", "n", "a", "b"]
            yield pa.record_batch([pa.array([digest[k] for k in some], pa.binary()), pa.array(count[some]), none(len(some), pa.int64()), none(len(some), pa.int64())], names=names)
            a, b = rep[tied], rep[label[tied]]
            yield pa.record_batch([none(len(tied), pa.binary()), none(len(tied), pa.int64()), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=names)

    return link


def _blocks(member: DataFrame) -> DataFrame:
    """Rows of buckets, dealt to blocks (i, j): part i of the own rows on the left, part j of all rows on the right."""
    sizes = member.groupBy("bucket").agg(F.count_if("own").alias("owners"), F.count(F.lit(1)).alias("size")).where("owners > 0 and size > 1")
    sizes = pin(sizes)
    total = sizes.agg(F.sum("size")).first()[0] or 0
    rows = lookup(member, sizes, "bucket", "size", total).where("size is not null")
    cut = lambda c: F.ceil(c / BLOCK)
    small = F.col("size") <= 2 * BLOCK
    no = F.when(small, 1).otherwise(cut(F.col("owners"))).cast("int")
    np_ = F.when(small, 0).otherwise(cut(F.col("size") - F.col("owners"))).cast("int")
    rows = rows.withColumn("no", no).withColumn("np", np_).withColumn("part", F.pmod(F.hash("digest"), F.when(F.col("own") | small, F.col("no")).otherwise(F.col("np"))))
    place = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    part = F.col("part")
    of_own = F.transform(
        F.sequence(F.lit(0), F.col("no") + F.col("np") - 1),
        lambda k: place(F.least(part, k), F.greatest(part, k), F.when(k == part, 2).when(k < part, 1).otherwise(0)),
    )
    of_probe = F.transform(F.sequence(F.lit(0), F.col("no") - 1), lambda k: place(k, F.col("no") + part, F.lit(1)))
    alone = F.array(place(F.lit(0), F.lit(0), F.lit(2)))
    to = F.when(small, alone).when(F.col("own"), of_own).otherwise(of_probe)
    return rows.select("digest", "t", "bucket", "own", "s0", "s1", F.explode(to).alias("to")).select("digest", "t", "bucket", "own", "s0", "s1", "to.*")


def _in_blocks(rows: DataFrame) -> DataFrame:
    left = (~F.col("own") | (F.col("side") == 1)).alias("right")
    return rows.withColumn("right", left).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "right").drop("right")


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, tables: int = TABLES, probes: int = PROBES
) -> DataFrame:
    """One row per row of `vectors`: id_col, n_links, component_id and kept.

    Two vectors of one length are linked if their cosine, in double precision, is `least` or more and a
    table brings them together; equal vectors always are. n_links counts the other rows that a row is
    linked with; component_id is the smallest id reachable; the row with that id is kept. A vector that is
    null, empty or zero, or has a null or non-finite component, links with nothing, and so does a row
    without an id, which is never kept. Rows that share an id are of one component; if their vectors
    differ, they count as several. An empty table gives an empty result; other columns are not read.
    """
    element = vectors.schema[vector_col].dataType.elementType
    kind = np.dtype(np.float32 if isinstance(element, T.FloatType) else np.float64)
    column: Column = F.col(vector_col) if isinstance(element, T.FloatType) else F.col(vector_col).cast("array<double>")
    read = vectors.select(F.col(id_col).cast("long").alias("id"), column.alias("vector")).mapInArrow(_reader(kind), "id long, digest binary, vector binary")
    good = read.where("digest is not null and id is not null")
    classes = good.groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"))
    schema = "digest binary, rep long, copies long, vector binary, codes array<long>, s0 long, s1 long"
    classes = pin(classes.mapInArrow(_coder(kind, tables, probes), schema))

    each = classes.select("digest", "s0", "s1", F.posexplode("codes").alias("at", "bucket"))
    member = each.select("digest", "s0", "s1", "bucket", F.floor(F.col("at") / (1 + probes)).cast("int").alias("t"), (F.col("at") % (1 + probes) == 0).alias("own"))
    likely = pin(_in_blocks(_blocks(member)).mapInArrow(_likely(least), "digest binary, t int, bucket long, i int, j int, side int, own boolean"))
    full = likely.join(classes.select("digest", "rep", "copies", "vector", "codes"), "digest")
    found = pin(_in_blocks(full).mapInArrow(_linker(kind, least, tables, probes), "digest binary, n long, a long, b long"))

    rows = pin(read.select("id", "digest"))
    counts = found.where("digest is not null").groupBy("digest").agg(F.sum("n").alias("n"))
    own = classes.select("digest", "rep", "copies").join(counts, "digest", "left")
    own = pin(own.select("digest", "rep", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    named = pin(lookup(rows.where("digest is not null and id is not null"), own, "digest", "copies", rows.count()))
    several = named.groupBy("id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("id", "lo")
    ties = named.join(several, "id").select(F.col("lo").alias("a"), F.col("rep").alias("b")).where("a < b")
    links = pin(found.where("a is not null").select("a", "b").union(ties).distinct())
    component = connected_components(links)
    # The hot classes are many rows of one representative; the join by class is of classes only.
    of_class = pin(own.join(component.withColumnRenamed("node", "rep"), "rep", "left").select("digest", "copies", F.coalesce("component", "rep").alias("component_id")))
    linked = lookup(named.select("id", "digest", "n_links"), of_class, "digest", "copies", rows.count()).select("id", "n_links", "component_id")
    alone = rows.where("digest is null or id is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")
    )
