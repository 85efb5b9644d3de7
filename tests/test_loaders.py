"""Bad rows and failing sources leave the others whole."""

import time

from pyspark.sql import functions as F

from corpusflow.operators import dedup, store
from corpusflow.plans import ingest
from corpusflow.sources import loaders


def test_rows_are_loaded_or_rejected_with_reasons(spark):
    rows = [
        (1, " Gym ", "d", "37.5", "127"), (2, None, "d", "1", "2"), (3, "Lab", "", "x", "200"), (4, "Hall", None, "", None), (5, "Nowhere", None, None, " "),
        (6, "Gym", "new", "38", "128"), (7, "Pole", None, "91", "0"), (8, "Half", None, "1", None), (9, "", "", "", ""), (10, "NaN", None, "NaN", "1"),
    ]
    raw = spark.createDataFrame(rows, "seq long, name string, description string, latitude string, longitude string")
    places = spark.createDataFrame([("Hall", 1.5, 2.5), ("Hall", 1.5, 2.5)], "name string, latitude double, longitude double")
    got = {r["seq"]: r for r in loaders.load_places(raw, places).collect()}
    assert {s: r["reason"] for s, r in got.items()} == {
        1: "superseded", 2: "missing name", 3: "bad latitude,bad longitude", 4: None, 5: "geocode_failed", 6: None, 7: "bad latitude", 8: "bad longitude",
        9: "missing name,geocode_failed", 10: "bad latitude",
    }
    assert (got[4]["latitude"], got[4]["longitude"], got[6]["latitude"], got[6]["ok"], got[1]["ok"]) == (1.5, 2.5, 38.0, True, False)
    old = spark.createDataFrame([(7, "Gym", "old", 0.0, 0.0)], "id long, name string, description string, latitude double, longitude double")
    loaded = loaders.load_places(raw, places).where("ok").select("name", "description", "latitude", "longitude")
    seeded = {r["name"]: (r["id"], r["description"], r["latitude"]) for r in store.upsert_by_name(old, loaded).collect()}
    assert seeded == {"Gym": (7, "new", 38.0), "Hall": (8, None, 1.5)}
    assert loaders.load_places(raw.limit(0)).count() == 0


def test_a_source_that_fails_leaves_the_others_whole(spark):
    def reader(source):
        if source == "broken":
            raise ConnectionError("no route")
        if source == "slow":
            time.sleep(30)
        if source == "silent":
            return []
        return [{"doc_id": f"{source}-{i}", "title": f"t{i}", "content": f"body {i} of {source} " * 20, "source_url": "https://a.example/", "source_type": "html"} for i in range(3)]

    sources = spark.createDataFrame([(n, "c") for n in ("good", "broken", "slow", "silent", "other")], "source_name string, category string")
    docs, faults = loaders.read_sources(sources, reader, timeout_seconds=1)
    assert {r["source_name"]: r["status_reason"] for r in faults.collect()} == {"broken": "ConnectionError: no route", "slow": "TimeoutError: source collection exceeded 1 seconds"}
    named = docs.join(sources, "source_name").withColumn("department", F.lit(None).cast("string"))
    passed, seen = loaders.counted(named, "documents", documents=F.count(F.lit(1)), chars=F.sum(F.length("content")))
    best = dedup.best_rows(passed)
    assert seen.get["documents"] == 6 and seen.get["chars"] == named.agg(F.sum(F.length("content"))).first()[0]
    report = ingest.source_report(sources, dedup.dedup_metrics(named, best, best), named.select("source_name"), None)
    got = {r["source_name"]: (r["status"], r["raw_documents"], r["chunks"]) for r in loaders.with_faults(report, faults).collect()}
    assert got == {"good": ("ok", 3, 3), "other": ("ok", 3, 3), "silent": ("no_content_discovered", 0, 0), "broken": ("error", 0, 0), "slow": ("error", 0, 0)}
    reasons = {r["source_name"]: r["status_reason"] for r in loaders.with_faults(report, faults).collect()}
    assert reasons["broken"] == "ConnectionError: no route" and reasons["good"].startswith("Source produced")
