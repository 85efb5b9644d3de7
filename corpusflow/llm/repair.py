"""Repair of conversation structure by deduplicated signatures.

Every row has one letter: the initial of its role, upper case if its text is truncated, or a mark if
it must go. The letters of a conversation, in pieces of at most PIECE, are its signature. Each
distinct signature is solved once, by memoised recursion over its suffixes: the cheapest edits from
any state of the wanted form to any other. Solutions are joined back by signature; conversations of
several pieces chain theirs. Edits are then replayed on the rows.

Rows are narrow until the replay (texts are digests), equal rows are one row with a count, and rows
are dealt by ranges of their order, so a conversation of any length is spread over many tasks. Only
the pieces' solutions, a few bytes a row, of one conversation ever meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup, pin

#: Letters of a piece. Solutions have a few times as many bytes.
PIECE = 200
#: Characters of a text that order rows of one turn and role; the digest of the text follows.
HEAD = 64
SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States of the wanted form (s?(ua)+)?: nothing yet, after s, after u, after a.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: Initials of adjacent roles that are in order.
FOLLOW = ("su", "ua", "au")
#: What may follow a state.
NEXT = {START: {"s": AFTER_S, "u": AFTER_U}, AFTER_S: {"u": AFTER_U}, AFTER_U: {"a": AFTER_A}, AFTER_A: {"u": AFTER_U}}
#: Suffixes that a task remembers before it starts anew.
REMEMBERED = 200_000

Edits = tuple[int, str, str]  # cost, edits, initial of the role that each edit leaves ("-" for none)


class Solver:
    """Cheapest edits of a signature; suffixes that signatures share are solved once."""

    def __init__(self) -> None:
        self.memo: dict[tuple[str, int, int], Edits | None] = {}

    def best(self, letters: str, state: int, end: int) -> Edits | None:
        """Cheapest way from `state` through all letters to `end`; of ways that cost the same the ASCII-least edits."""
        key = (letters, state, end)
        if key in self.memo:
            return self.memo[key]
        found: Edits | None = None
        cost, edits, roles = 0, "", ""
        for _ in range(3):  # more than two insertions in a row return to a state
            if not letters:
                ways = [(0, "", "")] if state == end else []
            else:
                ways = self._ways(letters, state, end)
            for way in ways:
                whole = (cost + way[0], edits + way[1], roles + way[2])
                if found is None or whole[:2] < found[:2]:
                    found = whole
            role = "a" if state == AFTER_U else "u"
            state, cost, edits, roles = NEXT[state][role], cost + INSERT, edits + "I", roles + role
        self.memo[key] = found
        return found

    def _ways(self, letters: str, state: int, end: int) -> Iterator[Edits]:
        first, rest = letters[0], letters[1:]
        role, late = first.lower(), TRUNCATED if first.isupper() else 0
        steps = [(DELETE, "D", "-", state)]
        if first != "x":
            follow = NEXT[state]
            if role in follow:
                steps.append((KEEP + late, "K", role, follow[role]))
            new = "a" if state == AFTER_U else "u"
            steps.append((REROLE + late, "R", new, follow[new]))
        for cost, edit, left, to in steps:
            way = self.best(rest, to, end)
            if way is not None:
                yield (cost + way[0], edit + way[1], left + way[2])

    def whole(self, letters: str) -> Edits:
        ways = [w for w in (self.best(letters, START, START), self.best(letters, START, AFTER_A)) if w is not None]
        return min(ways, key=lambda w: w[:2])


def _solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per signature: the solution of a conversation that has only this piece, or those between all states."""
    solver = Solver()
    for batch in batches:
        out = []
        for letters, alone in zip(batch.column("letters").to_pylist(), batch.column("alone").to_pylist(), strict=True):
            if len(solver.memo) > REMEMBERED:
                solver = Solver()
            if alone:
                ways = [(START, START, *solver.whole(letters))]
            else:
                ways = [(s, e, *w) for s in range(4) for e in range(4) if (w := solver.best(letters, s, e)) is not None]
            out.append([dict(zip(("s", "e", "cost", "edits", "roles"), w, strict=True)) for w in ways])
        ways = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("cost", pa.int64()), ("edits", pa.string()), ("roles", pa.string())]))
        yield pa.record_batch({"sign": batch.column("sign"), "n": batch.column("n"), "ways": pa.array(out, ways)})


WAYS = "ways array<struct<s int, e int, cost long, edits string, roles string>>"


def _chain(pieces: pd.DataFrame) -> pd.DataFrame:
    """The way of each piece of one conversation, from the last piece to the first."""
    pieces = pieces.sort_values(["pid", "piece"])
    ways = [[(int(w["s"]), int(w["e"]), int(w["cost"]), w["edits"], w["roles"]) for w in p] for p in pieces["ways"]]
    after: dict[int, tuple[int, str]] = {START: (0, ""), AFTER_A: (0, "")}
    choice: list[dict[int, tuple]] = []
    for options in reversed(ways):
        found: dict[int, tuple[int, str]] = {}
        chosen: dict[int, tuple] = {}
        for w in options:
            if w[1] in after:
                cost, edits = after[w[1]]
                whole = (w[2] + cost, w[3] + edits)
                if w[0] not in found or whole < found[w[0]]:
                    found[w[0]], chosen[w[0]] = whole, w
        after = found
        choice.append(chosen)
    state, taken = START, []
    for chosen in reversed(choice):
        taken.append(chosen[state])
        state = chosen[state][1]
    return pd.DataFrame(
        {
            "conv": pieces["conv"].to_numpy(), "pid": pieces["pid"].to_numpy(), "piece": pieces["piece"].to_numpy(), "cost": [w[2] for w in taken],
            "edits": [w[3] for w in taken], "roles": [w[4] for w in taken],
        }
    )


PLACED = "conv long, pid int, rid binary, piece long, at int, letters string, initial string, bad long"


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range in order get places in pieces; a copy of a row is a letter of its own.

    `bad` counts the row's letters whose role may not follow the one before, within this range.
    """
    types = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64()]
    names = ["conv", "pid", "rid", "piece", "at", "letters", "initial", "bad"]

    def record(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    last, piece, at, before = object(), -1, 0, None
    for batch in batches:
        out: list[tuple] = []
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "pid", "rid", "letter", "m", "initial")]
        for conv, pid, rid, letter, m, initial in zip(*columns, strict=True):
            if conv != last:
                last, piece, at, before = conv, piece + 1, 0, None
            for done in range(0, max(m, 1), PIECE):
                n = min(m - done, PIECE)
                if at and at + n > PIECE:
                    piece, at = piece + 1, 0
                letters = ("x" if done else letter) + "x" * (n - 1) if n else ""
                bad = n and n - 1 + (before is not None and before + initial not in FOLLOW)
                before = initial if n else before
                out.append((conv, pid, rid if n and not done else None, piece, at, letters, initial if n else None, bad))
                at += n
                if len(out) >= 10_000:
                    yield record(out)
                    out = []
        if out:
            yield record(out)


def _digest(*parts: Column) -> Column:
    """One for each sequence of values; lengths keep the parts apart."""
    known = [F.coalesce(p.cast("string"), F.lit("\0null")) for p in parts]
    return F.unhex(F.md5(F.concat_ws(":", *[F.length(p) for p in known], *known)))


def _with_faults(rows: DataFrame) -> DataFrame:
    """One narrow row per distinct row of `rows`: m copies, letter, and how many rows have each fault."""
    trimmed = F.rtrim("text", F.lit(SPACE))
    narrow = rows.select(
        "conv_id", "turn", "role", F.substring("text", 1, HEAD).alias("head"), "m",
        _digest(F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text")).alias("rid"),
        _digest(F.col("conv_id"), F.col("role"), F.col("text")).alias("said"),
        (trimmed == "").alias("blank"), (~F.right(trimmed, F.lit(1)).isin(*".!?")).alias("cut"),
    )
    keys = ["conv_id", "turn", "role", "head", "rid", "said", "blank", "cut"]
    once = pin(narrow.groupBy(*keys).agg(F.sum("m").alias("m")))
    # A null turn comes first: false sorts before true.
    place = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    again = once.where("m > 0").groupBy("said").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    joined = lookup(once, pin(again), "said", "n", once.count())
    later = F.coalesce(place != F.col("first"), F.lit(False))
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    letter = F.when(F.col("blank") | later, "x").when(F.col("cut"), F.upper(known)).otherwise(known)
    count = lambda c: F.when(c, F.col("m")).otherwise(0)
    own = (F.col("m") > 0) & ~F.col("blank")
    return joined.select(
        "conv_id", "turn", "role", "head", "rid", "m", letter.alias("letter"), initial.alias("initial"),
        count(F.col("blank")).alias("blank"),
        F.when(own, F.when(later, F.col("m")).otherwise(F.col("m") - 1)).otherwise(0).alias("duplicate"),
        F.when(own & ~later & F.col("cut"), 1).otherwise(0).alias("truncated"),
    )


def damage(rows: DataFrame) -> DataFrame:
    """Rows of conversations with planted faults, chosen by the checksum of `conv_id:turn`; m says how often a row counts."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(known("text"), "[.!?]", "")).otherwise(known("text"))
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(known("role")).alias("role"), text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("m"),
    )


def _replayed(texts: DataFrame, placed: DataFrame, edits: DataFrame) -> DataFrame:
    """The rows that edits leave; an inserted row has no text."""
    steps = F.expr(
        "filter(transform(sequence(1, length(edits)), i -> named_struct('pos', i, 'edit', substring(edits, i, 1), 'left', substring(roles, i, 1),"
        " 'at', length(replace(substring(edits, 1, i - 1), 'I', '')))), x -> x.edit <> 'D')"
    )
    each = edits.where("edits <> ''").select("conv", "pid", "piece", F.explode(steps).alias("x")).select("conv", "pid", "piece", "x.*")
    new = F.when(F.col("left") == "a", "assistant").otherwise("user")
    inserted = each.where("edit = 'I'").select(
        F.col("conv").alias("conv_id"), "pid", "piece", "pos", "edit", new.alias("role"), F.lit("").alias("text")
    )
    kept = each.where("edit <> 'I'").join(placed.where("rid is not null").select("pid", "piece", "at", "rid"), ["pid", "piece", "at"])
    named = kept.join(texts, "rid").select(
        F.col("conv").alias("conv_id"), "pid", "piece", "pos", "edit", F.when(F.col("edit") == "R", new).otherwise(F.col("role")).alias("role"), "text"
    )
    return named.unionByName(inserted)


def repair_conversations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`rows` has conv_id, turn, role, text and, if it likes, m: how often the row counts (0: it only names its conversation).

    Returns audits and repaired rows. Audits have a row per conv_id: conv_id, gaps, blank, duplicate,
    truncated, illegal, cost (long) and audit, the cheapest edits' initials. Repaired rows have conv_id;
    pid, piece and pos, which order them; edit (K, R or I), role and text.

    Rows are taken by turn, nulls first; rows of one turn by role, then text (its first 64 characters,
    then its digest); equal rows are each other's copies, adjacent. A null role or text is one space, a
    null conv_id a conversation. A conversation without rows that count has zeros and an empty audit.
    A role that does not begin with s, u or a fits nowhere. Texts of any length are read whole. Other
    columns are not read; an empty table gives empty results.
    """
    m = F.col("m").cast("long") if "m" in rows.columns else F.lit(1).cast("long")
    rows = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), m.alias("m"),
    )
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "head", "rid")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _with_faults(rows).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = pin(dealt.withColumn("pid", F.spark_partition_id()))
    placed = pin(dealt.select("conv_id", "pid", "rid", "letter", "m", "initial").mapInArrow(_cut, PLACED))

    # A piece has at most PIECE letters, so its rows are few.
    letters = F.array_sort(F.collect_list(F.when(F.col("letters") != "", F.struct("at", "letters"))))
    signs = placed.groupBy("conv", "pid", "piece").agg(F.array_join(F.transform(letters, lambda x: x["letters"]), "").alias("letters"))
    pieces = signs.groupBy("conv").agg(F.count(F.lit(1)).alias("pieces"))
    several = pin(pieces.where("pieces > 1").select(F.col("conv").alias("long_conv"), F.lit(False).alias("part")))
    signs = pin(
        signs.join(several.hint("shuffle_hash"), F.col("conv").eqNullSafe(F.col("long_conv")), "left")
        .select("conv", "pid", "piece", "letters", F.coalesce("part", F.lit(True)).alias("alone"))
        .withColumn("sign", F.concat(F.col("alone").cast("string"), F.lit(":"), "letters"))
    )
    distinct = signs.groupBy("sign", "letters", "alone").agg(F.count(F.lit(1)).alias("n"))
    solved = pin(distinct.repartition(parts, "sign").mapInArrow(_solve, f"sign string, n long, {WAYS}"))
    found = lookup(signs.select("conv", "pid", "piece", "alone", "sign"), solved, "sign", "n", signs.count())
    short = found.where("alone").select("conv", "pid", "piece", F.inline("ways")).drop("s", "e")
    chained = found.where("not alone").select("conv", "pid", "piece", "ways").groupBy("conv").applyInPandas(
        _chain, "conv long, pid int, piece long, cost long, edits string, roles string"
    )
    edits = pin(short.unionByName(chained))

    live = F.col("m") > 0
    counts = dealt.groupBy("conv_id").agg(
        F.coalesce(F.max(F.when(live, F.col("turn"))) - F.min(F.when(live, F.col("turn"))) + 1, F.lit(0)).alias("span"),
        F.count_distinct(F.when(live, F.col("turn"))).alias("turns"),
        *[F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")],
    )
    # Where a conversation goes on in the next range, the roles on both sides meet.
    ends = placed.where("initial is not null").groupBy("conv", "pid").agg(
        F.sum("bad").alias("bad"),
        F.min_by("initial", F.struct("piece", "at")).alias("first"), F.max_by("initial", F.struct("piece", "at")).alias("last"),
    )
    before = F.lag("last").over(Window.partitionBy("conv").orderBy("pid"))
    meets = (before.isNotNull() & ~F.concat(before, F.col("first")).isin(*FOLLOW)).cast("long")
    illegal = ends.withColumn("meets", meets).groupBy("conv").agg(F.sum(F.col("bad") + F.col("meets")).alias("illegal"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pid", "piece", "edits"))), lambda x: x["edits"]), "")
    whole = edits.groupBy("conv").agg(F.sum("cost").alias("cost"), joined.alias("audit"))
    audits = (
        counts.join(whole, F.col("conv_id").eqNullSafe(F.col("conv"))).drop("conv")
        .join(illegal, F.col("conv_id").eqNullSafe(F.col("conv")), "left").drop("conv")
        .select("conv_id", (F.col("span") - F.col("turns")).alias("gaps"), "blank", "duplicate", "truncated", F.coalesce("illegal", F.lit(0)).cast("long").alias("illegal"), "cost", "audit")
    )
    rid = _digest(F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text"))
    texts = rows.where(live).select(rid.alias("rid"), "role", "text").groupBy("rid").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    return audits, _replayed(texts, placed, edits)


def with_digest(audits: DataFrame, repaired: DataFrame) -> DataFrame:
    """Audits with repaired_sha256, of the repaired `role:text` joined by line feeds.

    A digest reads its conversation in order, so its rows pass one task one by one; none is held.
    """
    names = audits.columns
    head = audits.select("*", F.lit(-1).alias("pid"), F.lit(-1).cast("long").alias("piece"), F.lit(0).alias("pos"), F.lit("").alias("line"))
    body = repaired.select(
        "conv_id", *[F.lit(None).cast(audits.schema[c].dataType).alias(c) for c in names if c != "conv_id"],
        "pid", "piece", "pos", F.concat_ws(":", "role", "text").alias("line"),
    )
    rows = head.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "pid", "piece", "pos")

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        sha, n = hashlib.sha256(), 0

        def finished() -> pa.RecordBatch:
            return pa.record_batch([*[held.column(c) for c in names], pa.array([sha.hexdigest()])], names=[*names, "repaired_sha256"])

        for batch in batches:
            lines = batch.column("line").cast(pa.binary())
            for i, pid in enumerate(batch.column("pid").to_pylist()):
                if pid < 0:
                    if held is not None:
                        yield finished()
                    held, sha, n = batch.slice(i, 1), hashlib.sha256(), 0
                else:
                    sha.update((b"\n" if n else b"") + lines[i].as_py())
                    n += 1
        if held is not None:
            yield finished()

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in audits.schema)
    return rows.mapInArrow(digest, f"{kinds}, repaired_sha256 string")
