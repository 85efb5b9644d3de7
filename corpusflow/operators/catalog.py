"""The catalog of crawl sources: expansion of sites by blueprints, selection, defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import EXCLUDE_PATTERNS, INCLUDE_PATTERNS, path_prefixes

SITE = (
    "slug string, department string, base_url string, site_type string,"
    " source_overrides map<string,struct<category:string,max_pages:int,max_depth:int,seed_urls:array<string>>>"
)
BLUEPRINT = "name_suffix string, applies_to array<string>, category string, seed_url_template string, max_pages int, max_depth int"
DEFAULTS = {"max_pages": 20, "max_depth": 2, "max_pagination_pages": 200}


def expand_sources(sites: DataFrame, blueprints: DataFrame) -> DataFrame:
    """One source per site and blueprint that applies to its type; overrides of the site come last.

    Both tables are configuration: blueprints, a handful of rows, go to every task. They are first
    exploded by site type, so this is an equi-join.
    """
    usable = sites.where((F.coalesce("slug", F.lit("")) != "") & (F.coalesce("base_url", F.lit("")) != ""))
    usable = usable.withColumn("site_type", F.coalesce("site_type", F.lit("portal")))
    kinds = blueprints.withColumn("site_type", F.explode(F.coalesce("applies_to", F.array(F.lit("portal")))))
    joined = usable.alias("s").join(F.broadcast(kinds).alias("b"), "site_type")
    own = F.try_element_at(F.col("s.source_overrides"), F.col("b.name_suffix"))
    base = F.regexp_replace("s.base_url", "/+$", "")
    seed = F.when(F.coalesce("b.seed_url_template", F.lit("")) != "", F.replace("b.seed_url_template", F.lit("{base_url}"), base)).otherwise(F.col("s.base_url"))
    return joined.select(
        F.concat_ws("_", "s.slug", "b.name_suffix").alias("name"),
        F.coalesce("s.department", "s.slug").alias("department"),
        F.coalesce(own["category"], F.col("b.category")).alias("category"),
        F.coalesce(own["seed_urls"], F.array(seed)).alias("seed_urls"),
        F.coalesce(own["max_pages"], F.col("b.max_pages")).alias("max_pages"),
        F.coalesce(own["max_depth"], F.col("b.max_depth")).alias("max_depth"),
    )


#: Keys of a blueprint that say how it applies and are no settings of its sources.
APPLIES = ("applies_to", "name_suffix", "seed_url_template")


def _entries(json: Column) -> Column:
    """An object's keys and values of any type; a null or a text that is no object has none."""
    parsed = F.try_parse_json(json)
    none = F.create_map().cast("map<string,variant>")
    return F.coalesce(F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed.cast("map<string,variant>")), none)


def expand_settings(sites: DataFrame, blueprints: DataFrame) -> DataFrame:
    """One source per site and blueprint that applies, with settings of any name and type: name, settings (VARIANT).

    Sites have slug, department, base_url, site_type and source_overrides, the JSON object of overrides by
    name suffix; blueprints have a JSON object of all their keys. A source's settings are those of the
    blueprint, its name, department and seed_urls, and last the site's own, key by key: a value replaces
    another whole, null too. Sites without slug or address give none. A blueprint without a name suffix
    ends the job; `applies_to` is a text or a list of them and means portals by default.
    """
    blueprint = F.try_parse_json("blueprint")
    text = lambda v, key: F.try_variant_get(v, f"$.{key}", "string")
    kinds = F.coalesce(F.try_variant_get(blueprint, "$.applies_to", "array<string>"), F.array(F.coalesce(text(blueprint, "applies_to"), F.lit("portal"))))
    suffix = F.coalesce(text(blueprint, "name_suffix"), F.raise_error(F.concat(F.lit("blueprint without a name suffix: "), "blueprint")))
    base = blueprints.select(
        F.explode(F.array_distinct(kinds)).alias("site_type"), suffix.alias("suffix"), text(blueprint, "seed_url_template").alias("template"),
        F.map_filter(_entries(F.col("blueprint")), lambda k, v: ~k.isin(*APPLIES)).alias("own"),
    )
    usable = sites.where((F.coalesce("slug", F.lit("")) != "") & (F.coalesce("base_url", F.lit("")) != "")).withColumn("site_type", F.coalesce("site_type", F.lit("portal")))
    joined = usable.join(F.broadcast(base), "site_type")  # blueprints are configuration, a handful of rows
    root = F.regexp_replace("base_url", "/+$", "")
    seeds = F.to_variant_object(F.array(F.replace("template", F.lit("{base_url}"), root)))
    old = F.try_element_at("own", F.lit("seed_urls"))
    seeds = F.when(F.coalesce("template", F.lit("")) != "", seeds).otherwise(F.coalesce(F.when(~F.to_json(old).isin("null", "[]", '""'), old), F.to_variant_object(F.array("base_url"))))
    named = lambda c: F.try_parse_json(F.to_json(F.struct(c.alias("x"))))
    value = lambda c: F.try_variant_get(named(c), "$.x", "variant")
    made = F.create_map(
        F.lit("name"), value(F.concat_ws("_", "slug", "suffix")), F.lit("department"), value(F.coalesce("department", "slug")), F.lit("seed_urls"), seeds
    )
    mine = _entries(F.to_json(F.try_element_at(_entries(F.col("source_overrides")), F.col("suffix"))))
    merged = _merged(_merged(F.col("own"), made), mine)
    settings = F.to_variant_object(merged)
    return joined.select(settings.alias("settings")).select(text(F.col("settings"), "name").alias("name"), "settings")


def _merged(first: Column, last: Column) -> Column:
    """Entries of both maps; of a key in both the last one's."""
    return F.map_concat(F.map_filter(first, lambda k, v: ~F.map_contains_key(last, k)), last)


def setting(name: str, kind: str) -> Column:
    """A setting as a type; null where it is missing, null or of another type."""
    return F.try_variant_get("settings", f"$.{name}", kind)


def select_sources(
    sources: DataFrame, names: list[str] | None = None, prefixes: list[str] | None = None, exclude: list[str] | None = None, limit: int | None = None
) -> DataFrame:
    """By name, then by prefix, then without the excluded ones; `limit` comes last, in order of `seq`."""
    rows = sources
    if names:
        rows = rows.where(F.col("name").isin(*names))
    if prefixes:
        starts = F.lit(False)
        for p in prefixes:
            starts = starts | F.col("name").startswith(p)
        rows = rows.where(starts)
    if exclude:
        rows = rows.where(~F.col("name").isin(*exclude))
    return rows if limit is None or limit < 0 else rows.orderBy("seq").limit(limit)


def override(sources: DataFrame, **values: object) -> DataFrame:
    """Copies with some settings replaced where a value is given."""
    for name, value in values.items():
        if value is not None:
            sources = sources.withColumn(name, F.lit(value))
    return sources


def crawl_config(sources: DataFrame) -> DataFrame:
    """Settings with their defaults; path prefixes come from the seeds, the cutoff is a year's first day."""

    def given(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in sources.columns else default

    year = given("min_published_year", F.lit(None).cast("int"))
    texts = lambda xs: F.array(*[F.lit(x) for x in xs])
    return sources.select(
        "*",
        *[given(k, F.lit(v)).alias(f"crawl_{k}") for k, v in DEFAULTS.items()],
        given("include_patterns", texts(INCLUDE_PATTERNS)).alias("crawl_include"),
        given("exclude_patterns", texts(EXCLUDE_PATTERNS)).alias("crawl_exclude"),
        given("allowed_path_prefixes", path_prefixes(F.col("seed_urls"))).alias("crawl_prefixes"),
        F.when(year.isNotNull(), F.make_date(year, F.lit(1), F.lit(1))).alias("crawl_cutoff"),
    )
