"""Loading of rows that may be bad, and of sources that may fail: what is wrong stands beside what is right."""

from __future__ import annotations

import signal
import threading
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .shared import pin

DOCUMENT = (
    "doc_id string, source_type string, source_url string, title string, content string, author_department string, published_at timestamp_ntz, collected_at timestamp_ntz"
)


def load_places(raw: DataFrame, geocoded: DataFrame | None = None) -> DataFrame:
    """Rows of text columns seq, name, description, latitude, longitude to places, each with ok and reason.

    A row is loaded (ok) if it has a name and coordinates on the globe, of its own or, where it has none,
    of `geocoded` (name, latitude, longitude); a name that is not found there fails as geocode_failed.
    Reasons of a row are joined by commas. Of loaded rows of one name the last by seq counts, the
    others are superseded. An empty text is a missing value.
    """
    clean = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    rows = raw.select("seq", clean("name").alias("name"), clean("description").alias("description"), clean("latitude").alias("_lat"), clean("longitude").alias("_lon"))
    rows = rows.withColumn("latitude", F.col("_lat").try_cast("double")).withColumn("longitude", F.col("_lon").try_cast("double"))
    none = F.col("_lat").isNull() & F.col("_lon").isNull()
    if geocoded is not None:
        found = geocoded.dropDuplicates(["name"]).select("name", F.col("latitude").cast("double").alias("_glat"), F.col("longitude").cast("double").alias("_glon"))
        rows = rows.join(found, "name", "left")
        rows = rows.withColumn("latitude", F.when(none, F.col("_glat")).otherwise(F.col("latitude"))).withColumn("longitude", F.when(none, F.col("_glon")).otherwise(F.col("longitude")))
    bad = lambda given, value, most: ~F.coalesce(F.abs(value) <= most, F.lit(False)) | F.isnan(value)
    reasons = F.array_compact(
        F.array(
            F.when(F.col("name").isNull(), "missing name"),
            F.when(none & F.col("latitude").isNull(), "geocode_failed"),
            F.when(~none & bad("_lat", F.col("latitude"), 90), "bad latitude"), F.when(~none & bad("_lon", F.col("longitude"), 180), "bad longitude"),
        )
    )
    judged = rows.select("seq", "name", "description", "latitude", "longitude", F.array_join(reasons, ",").alias("_reasons"))
    last = judged.where("_reasons = ''").groupBy("name").agg(F.max("seq").alias("_last"))
    marked = judged.join(last, "name", "left")
    reason = F.when(F.col("_reasons") != "", F.col("_reasons")).when(F.col("seq") < F.col("_last"), "superseded")
    return marked.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull()).drop("_reasons", "_last")


class _Late(Exception):
    pass


def _within(seconds: float, read: Callable[[str], list[dict]], source: str) -> list[dict]:
    """The reader's rows; raises if they take longer and the process can be interrupted."""
    if seconds <= 0 or threading.current_thread() is not threading.main_thread():
        return read(source)

    def late(signum: int, frame: object) -> None:
        raise _Late(f"source collection exceeded {seconds:g} seconds")

    before = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        return read(source)
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def read_sources(sources: DataFrame, reader: Callable[[str], list[dict]], timeout_seconds: float = 0) -> tuple[DataFrame, DataFrame]:
    """Documents of all sources, and the faults of those that failed: source_name, status and status_reason.

    The reader is called once per source, in tasks, and returns rows with columns of DOCUMENT; one that raises
    or takes too long (0: no limit) gives no document and one fault, and leaves the others whole. Both tables
    come from one pass. Columns that a row lacks are null; seq numbers a source's rows.
    """
    names = [c.split()[0] for c in DOCUMENT.split(", ")]
    columns = ["source_name", "seq", *names, "status", "status_reason"]

    def rows(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for source in pdf["source_name"]:
                try:
                    found = [(source, i, *[r.get(c) for c in names], None, None) for i, r in enumerate(_within(timeout_seconds, reader, source))]
                except Exception as e:  # noqa: BLE001 - a source's own fault is a value, as readers raise anything
                    found = [(source, None, *[None] * len(names), "error", f"{'TimeoutError' if isinstance(e, _Late) else type(e).__name__}: {e}")]
                made = pd.DataFrame(found, columns=columns)
                made["seq"] = made["seq"].astype("Int64")
                yield made

    read = pin(sources.select("source_name").distinct().mapInPandas(rows, f"source_name string, seq long, {DOCUMENT}, status string, status_reason string"))
    return read.where("status is null").drop("status", "status_reason"), read.where("status is not null").select("source_name", "status", "status_reason")


def counted(rows: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, Observation]:
    """The rows, and totals that are observed while an action passes them, in place of a scan of their own."""
    seen = Observation(name)
    return rows.observe(seen, *[F.coalesce(c, F.lit(0)).cast("long").alias(k) for k, c in counts.items()]), seen


def with_faults(report: DataFrame, faults: DataFrame) -> DataFrame:
    """A report in which a source that failed has status error, its reason, and counts of zero."""
    told = faults.select("source_name", F.col("status").alias("_status"), F.col("status_reason").alias("_reason"))
    joined = report.join(told, "source_name", "left")
    failed = F.col("_status").isNotNull()
    zero = {f.name for f in report.schema if f.dataType.simpleString() == "bigint"}
    value = lambda c: F.when(failed, F.lit(0).cast("long")).otherwise(F.col(c)).alias(c) if c in zero else F.col(c)
    named = {"status": F.coalesce("_status", "status").alias("status"), "status_reason": F.when(failed, F.col("_reason")).otherwise(F.col("status_reason")).alias("status_reason")}
    return joined.select(*[named[c] if c in named else value(c) for c in report.columns])
