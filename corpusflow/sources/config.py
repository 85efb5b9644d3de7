"""Configuration files: the YAML source catalog, parser rules, JSON seeds; and the JSON report sink."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import BLUEPRINT, SITE, expand_sources
from ..operators.parsing import RULE


def _yaml(path: Path) -> dict:
    import yaml

    return yaml.safe_load(path.read_text(encoding="utf-8")) or {}


def rules_from_rows(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """Parser rules; name and parser are required, priority is 100 unless given."""
    rows = []
    for e in entries:
        if missing := [k for k in ("name", "parser") if k not in e]:
            raise ValueError(f"a parser rule lacks {missing}")
        rows.append((
            e["name"], int(e.get("priority", 100)), list(e.get("url_patterns", [])), list(e.get("categories", [])), e["parser"],
            list(e.get("options", {}).get("blocked_title_prefixes", [])),
        ))
    return spark.createDataFrame(rows, RULE).orderBy("priority", "name")


def load_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Rules of all YAML files of a folder of the driver, ordered by priority and name."""
    files = sorted(Path(folder).glob("*.yaml"))
    return rules_from_rows(spark, [e for f in files for e in _yaml(f).get("registry", [])])


def load_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Explicit sources and those that sites and blueprints generate, in one table."""
    config = _yaml(Path(path))
    columns = "name string, department string, category string, seed_urls array<string>, max_pages int, max_depth int"
    keys = [c.split()[0] for c in columns.split(", ")]
    explicit = spark.createDataFrame([tuple(s.get(k) for k in keys) for s in config.get("sources", [])], columns)
    site_keys = ("slug", "department", "base_url", "site_type")
    over = ("category", "max_pages", "max_depth", "seed_urls")
    sites = spark.createDataFrame(
        [
            (*[s.get(k) for k in site_keys], {n: tuple(o.get(k) for k in over) for n, o in (s.get("source_overrides") or {}).items()})
            for s in config.get("department_sites", [])
        ],
        SITE,
    )
    listed = lambda x: [x] if isinstance(x, str) else x
    blueprints = spark.createDataFrame(
        [
            (b.get("name_suffix"), listed(b.get("applies_to")), b.get("category"), b.get("seed_url_template"), b.get("max_pages"), b.get("max_depth"))
            for b in config.get("source_blueprints", [])
        ],
        BLUEPRINT,
    )
    return explicit.unionByName(expand_sources(sites, blueprints))


def load_seeds(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON array file; a file that holds no array has none."""
    return spark.read.schema(schema).json(path, multiLine=True).where(F.col("name").isNotNull())


def write_report(report: DataFrame, path: str) -> None:
    """Per-source rows as JSON lines; characters are kept as they are."""
    report.write.mode("errorifexists").json(path)


def report_text(totals: dict) -> str:
    return json.dumps(totals, ensure_ascii=False, indent=2)
