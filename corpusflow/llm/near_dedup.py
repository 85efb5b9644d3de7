"""Near duplicates by circulant MinHash, banding and exact verification.

Two permutations of the 32-bit integers make all coordinates of a signature: the first scatters
the shingles, the second is applied after a circular shift, by k for coordinate k, so

    h_k(document) = min over its shingles x of second((first(x) + k) mod 2^32).

Documents with one set of shingles are one class, and only a class's representative goes on. A band
of `rows` coordinates is a bucket. In a first round each bucket compares its members with its first
one, which settles groups of copies of any size at one comparison a member; a second round compares
what is left with one member of each bucket's largest component. A third compares members of
components that are still apart, block by block, by longer sketches of the same permutations and
then by their full sets, closest first; as one link joins two components, a block hands on
one for each pair of them. So links of all rounds are confirmed on the full sets of shingles. A
bucket's largest component is never compared with itself, blocks are of bounded size, and no
bucket is cut off.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, anti_join, free, lookup, pin
from .components import connected_components

BANDS, ROWS = 28, 4
#: Coordinates of the last round's sketches, a byte each, and how far below the wanted share of
#: equal ones a pair is ruled out: 0.15 is over 4.7 standard deviations at a similarity of 0.8.
SKETCH, SLACK = 160, 0.15
#: Rows of one side of a block, and shingles in their sets; blocks of longer texts have fewer rows.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 20
#: A centre's text is sent to tasks of so many of its partners.
PARTNERS = 2000


def _mix(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of the 32-bit integers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(a)
    x ^= x >> np.uint32(13)
    x *= np.uint32(b)
    x ^= x >> np.uint32(16)
    return x


def shingle_set(text: bytes | None, n_words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; a shorter text is one shingle, no words give none."""
    found = text.lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    width = min(n_words, len(found))
    out = np.full(len(found) - width + 1, width, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out = (out ^ hashes[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """`size` coordinates; the shingles are taken in blocks, so a long text takes little memory."""
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    shifts = np.arange(size, dtype=np.uint32)[:, None]
    for i in range(0, len(shingles), 4096):
        block = shingles[i : i + 4096]
        first = _mix((block ^ (block >> np.uint64(32))).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
        np.minimum(out, _mix(first[None, :] + shifts, 0x85EBCA6B, 0xC2B2AE35).min(axis=1), out=out)
    return out


def _signer(n_words: int, bands: int, rows: int):
    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 1000):
                part = batch.slice(i, 1000)
                sets, digests, keys = [], [], []
                for text in part.column("text").cast(pa.binary()).to_pylist():
                    s = shingle_set(text, n_words)
                    sets.append(len(s))
                    digests.append(xxhash.xxh128_digest(s.tobytes()) if len(s) else None)
                    if len(s):
                        h = signature(s, bands * rows).reshape(bands, rows)
                        keys.append([xxhash.xxh64_intdigest(r.tobytes(), seed=b) - (1 << 63) for b, r in enumerate(h)])
                    else:
                        keys.append(None)
                yield pa.record_batch(
                    {
                        "id": part.column("id"),
                        "n": pa.array(sets, pa.int64()),
                        "digest": pa.array(digests, pa.binary()),
                        "keys": pa.array(keys, pa.list_(pa.int64())),
                    }
                )

    return sign


def _verifier(n_words: int, percent: int):
    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, None
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            left, right = batch.column("text_a").cast(pa.binary()), batch.column("text_b").cast(pa.binary())
            linked = []
            for i in range(len(a)):
                if last != a[i]:
                    last, mine = a[i], shingle_set(left[i].as_py(), n_words)
                other = shingle_set(right[i].as_py(), n_words)
                both = len(np.intersect1d(mine, other, assume_unique=True))
                linked.append(100 * both >= percent * (len(mine) + len(other) - both))
            yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())}).filter(pa.array(linked, pa.bool_()))

    return verify


def _texts(docs: DataFrame, needed: DataFrame, id_col: str, text_col: str, n_words: int) -> DataFrame:
    """id and text of the representatives in `needed` (id, digest); one row each."""

    def own(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = batch.column("digest").to_pylist()
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            is_own = [xxhash.xxh128_digest(shingle_set(t, n_words).tobytes()) == d for t, d in zip(texts, want, strict=True)]
            yield batch.select(["id", "text"]).filter(pa.array(is_own, pa.bool_()))

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    few = needed.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    found = rows.join(F.broadcast(needed) if few else needed, "id")
    return found.mapInArrow(own, "id long, text string").groupBy("id").agg(F.first("text").alias("text"))


def _sketcher(n_words: int):
    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, n_words) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            full = [s.tobytes() for s in sets]
            made = [signature(s, SKETCH).astype(np.uint8).tobytes() for s in sets]
            yield pa.record_batch({"rep": batch.column("id"), "sketch": pa.array(made, pa.binary()), "full": pa.array(full, pa.binary())})

    return sketch


def _block_links(percent: int):
    """Rows come sorted by block; a block gives a link for each two components that its sides join."""
    share = percent / 100 - SLACK
    least = int(SKETCH * (share + (1 - share) / 256))

    def links(rep, c, side, sketches, full) -> list[tuple[int, int]]:  # noqa: ANN001
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if (side == 1).any() else left
        n = np.array([len(s) for s in full])
        # Shingles are numbered within the block, so that a set is looked up in a table of marks.
        codes = np.unique(np.concatenate(full), return_inverse=True)[1].astype(np.int32)
        sets = np.split(codes, np.cumsum(n)[:-1])
        marked = np.zeros(codes.max() + 1, bool)
        label, found = c.copy(), []
        for i in left:
            others = right[(label[right] != label[i]) & (100 * np.minimum(n[right], n[i]) >= percent * np.maximum(n[right], n[i]))]
            if right is left:
                others = others[others > i]
            equal = (sketches[others] == sketches[i]).sum(axis=1)
            others = others[np.argsort(-equal, kind="stable")][: int((equal >= least).sum())]
            marked[sets[i]] = True
            width = 16
            while len(others):
                part, others, width = others[:width], others[width:], 2 * width
                starts = np.cumsum(n[part]) - n[part]
                both = np.add.reduceat(marked[np.concatenate([sets[o] for o in part])], starts, dtype=np.int64)
                for o in part[100 * both >= percent * (n[i] + n[part] - both)]:
                    if label[o] != label[i]:
                        label[label == label[o]] = label[i]
                        found.append((int(rep[i]), int(rep[o])))
                others = others[label[others] != label[i]]
            marked[sets[i]] = False
        return found

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def edges(table: pa.Table) -> np.ndarray:
            keys = np.stack([table.column(k).to_numpy() for k in ("bucket", "i", "j")], axis=1)
            return np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1

        def settle(table: pa.Table) -> pa.RecordBatch:
            found = set()
            cuts = [0, *edges(table).tolist(), len(table)]
            for start, end in zip(cuts, cuts[1:], strict=False):
                block = table.slice(start, end - start)
                rep, c, side = (block.column(k).to_numpy() for k in ("rep", "c", "side"))
                sketches = np.frombuffer(b"".join(block.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
                found.update(links(rep, c, side, sketches, [np.frombuffer(x, np.uint64) for x in block.column("full").to_pylist()]))
            once = sorted({(min(p), max(p)) for p in found})
            return pa.record_batch({"a": pa.array([a for a, _ in once], pa.int64()), "b": pa.array([b for _, b in once], pa.int64())})

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            ends = edges(held)
            if len(ends):  # the last block may go on in the next batch
                yield settle(held.slice(0, int(ends[-1])))
                held = held.slice(int(ends[-1]))
        if held is not None and len(held):
            yield settle(held)

    return compare


def _open_buckets(member: DataFrame, component: DataFrame) -> DataFrame:
    """Members, with component c, of buckets that hold several components."""
    here = pin(
        member.join(component.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", "n", F.coalesce("component", "rep").alias("c"))
    )
    apart = here.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("bucket")
    return pin(here.join(apart, "bucket"))


def _confirmed(pairs: DataFrame, texts: DataFrame, n_words: int, percent: int) -> DataFrame:
    """The pairs whose full sets are similar. A text with many partners is sent to several tasks."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("parts"))
    salted = pairs.join(parts, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("parts")))
    left = texts.withColumnsRenamed({"id": "a", "text": "text_a"}).join(parts, "a")
    left = left.withColumn("salt", F.explode(F.expr("sequence(0L, parts - 1L)"))).drop("parts")
    right = texts.withColumnsRenamed({"id": "b", "text": "text_b"})
    both = salted.drop("parts").join(right, "b").join(left, ["a", "salt"])
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_verifier(n_words, percent), "a long, b long")


def _main_components(rows: DataFrame) -> DataFrame:
    """Per bucket: main, its largest component; rows and shingles of that (many) and of the others (few); kinds."""
    counts = rows.groupBy("bucket", "c").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s"))
    most = F.max(F.struct("m", "c", "s"))
    return counts.groupBy("bucket").agg(
        most["c"].alias("main"),
        F.struct(most["m"].alias("m"), most["s"].alias("s")).alias("many"),
        F.struct((F.sum("m") - most["m"]).alias("m"), (F.sum("s") - most["s"]).alias("s")).alias("few"),
        F.count(F.lit(1)).alias("kinds"),
    )


def _near(percent: int) -> Column:
    """Whether a member and a centre are of comparable size and different components."""
    return (100 * F.least("n", "n_a") >= percent * F.greatest("n", "n_a")) & (F.col("c") != F.col("c_a"))


def _block_rows(rows: DataFrame) -> DataFrame:
    """Members of open buckets, dealt to blocks (bucket, i, j) of two sides.

    The largest component of a bucket, in blocks j, meets the rest, in blocks i; the rest, unless it
    is one component, also meets itself, in blocks i <= -1 - j.
    """
    cut = lambda c: F.greatest(F.ceil(F.col(c)["m"] / BLOCK), F.ceil(F.col(c)["s"] / BLOCK_SHINGLES), F.lit(1))
    dealt = rows.join(_main_components(rows), "bucket").select(
        "bucket", "rep", "n", "c", "kinds", (F.col("c") == F.col("main")).alias("is_main"), cut("many").alias("nj"), cut("few").alias("ni")
    )
    dealt = dealt.withColumn("h", F.xxhash64("rep"))
    i, j = F.pmod("h", F.col("ni")), F.pmod("h", F.col("nj"))
    upto = lambda n: F.explode(F.expr(f"sequence(0L, {n} - 1L)"))
    base = ["bucket", "rep", "n", "c"]
    of_main = dealt.where("is_main").select(*base, j.alias("j"), upto("ni").alias("i"), F.lit(1).alias("side"))
    of_rest = dealt.where("not is_main").select(*base, i.alias("i"), upto("nj").alias("j"), F.lit(0).alias("side"))
    rest = dealt.where("not is_main and kinds > 2").select(*base, i.alias("own"), upto("ni").alias("other"))
    side = F.when(F.col("own") <= F.col("other"), 0).otherwise(1)
    among = rest.select(*base, F.least("own", "other").alias("i"), (-1 - F.greatest("own", "other")).alias("j"), side.alias("side"))
    columns = [*base, "i", "j", "side"]
    return of_main.select(columns).union(of_rest.select(columns)).union(among.select(columns))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n_words: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row per row of `docs`: id_col, n_shingles, component_id, kept.

    A document's set holds its distinct shingles of `n_words` words after lower-casing A-Z; with
    fewer words the whole sequence is one shingle. Documents are linked if their sets share at least
    `percent` % of their union. component_id is the smallest id reachable over links, the document's
    own included; the row with that id is kept. A null or blank text has no shingles and links with
    nothing. Rows with a null id are never kept and have their class's component. Ids name texts: of
    rows with one id and different texts the links of one text count, and all may be kept. Two
    linked documents miss all 28 bands of 4 with a probability under 5e-7. Only the two named
    columns are read, so names of other columns cannot clash. An empty table gives an empty result.
    """
    signed = pin(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
            _signer(n_words, bands, rows), "id long, n long, digest binary, keys array<long>"
        )
    )
    classes = pin(
        signed.where("digest is not null and id is not null")
        .groupBy("digest")
        .agg(F.min("id").alias("rep"), F.max("id").alias("last"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    )
    # Rows of one id with different texts tie their classes together.
    links = (
        signed.where("digest is not null and id is not null").select("id", "digest").join(classes.select("digest", "rep"), "digest")
        .where("id <> rep").select(F.col("id").alias("b"), F.col("rep").alias("a"))
        .join(classes.select(F.col("rep").alias("b")).distinct(), "b").select("a", "b").distinct()
    )
    links = pin(links)
    member = classes.select("rep", "n", F.explode("keys").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("bucket")
    member = pin(member.join(shared, "bucket").distinct())
    component = connected_components(links)
    here = _open_buckets(member, component)
    if not here.isEmpty():
        ids = here.select("rep").distinct().join(classes.select("rep", "digest"), "rep").select(F.col("rep").alias("id"), "digest")
        texts = pin(_texts(docs, pin(ids), id_col, text_col, n_words))
        centre = here.groupBy("bucket").agg(F.min_by(F.struct("rep", "n", "c"), "rep").alias("m"))
        centre = centre.select("bucket", F.col("m.rep").alias("a"), F.col("m.n").alias("n_a"), F.col("m.c").alias("c_a"))
        pairs = pin(here.join(centre, "bucket").where(_near(percent)).select("a", F.col("rep").alias("b")).distinct())
        links = pin(links.union(_confirmed(pairs, texts, n_words, percent)))
        component = connected_components(links)
        here = _open_buckets(member, component)
    if not here.isEmpty():
        main = here.join(_main_components(here).select("bucket", "main"), "bucket").where("c = main")
        centre = main.groupBy("bucket").agg(F.min_by(F.struct("rep", "n", "c"), F.xxhash64("bucket", "rep")).alias("m"))
        centre = centre.select("bucket", F.col("m.rep").alias("a"), F.col("m.n").alias("n_a"), F.col("m.c").alias("c_a"))
        pairs = pin(here.join(centre, "bucket").where(_near(percent)).select("a", F.col("rep").alias("b")).distinct())
        links = pin(links.union(_confirmed(pairs, texts, n_words, percent)))
        component = connected_components(links)
        here = _open_buckets(member, component)
    if not here.isEmpty():
        reps = here.select(F.col("rep").alias("id")).distinct()
        sketches = pin(texts.join(reps, "id", "left_semi").mapInArrow(_sketcher(n_words), "rep long, sketch binary, full binary"))
        blocks = _block_rows(here).join(sketches, "rep").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
        columns = ["bucket", "i", "j", "side", "rep", "n", "c", "sketch", "full"]
        found = pin(blocks.select(columns).mapInArrow(_block_links(percent), "a long, b long").distinct())
        component = connected_components(pin(links.union(found)))
    final = classes.join(component.withColumnRenamed("node", "rep"), "rep", "left").select(
        "digest", "copies", F.coalesce("component", "rep").alias("component_id")
    )
    named = lookup(signed.where("digest is not null").select("id", "n", "digest"), pin(final), "digest", "copies", signed.count())
    bare = signed.where("digest is null").select("id", "n", F.col("id").alias("component_id"))
    return named.select("id", "n", "component_id").unionByName(bare).select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` that `near_duplicates` keeps, with all their columns.

    Rows without an id cannot be told apart by it; they all stay.
    """
    (own,) = free(docs, "gone_id")
    found = near_duplicates(docs, id_col, text_col, n_words, percent).select(F.col(id_col).alias(own), "kept").where(F.col(own).isNotNull())
    gone = pin(found.groupBy(own).agg(F.max("kept").alias("stays")).where("not stays").select(own))
    return anti_join(docs, gone, F.col(id_col) == F.col(own))
