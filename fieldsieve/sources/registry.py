"""The registry of organizations and sources: YAML scan, constraints as violation rows, selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.urls import canonical
from ..operators.hierarchy import closure
from ..tables import unused

_S = T.StringType()
ORGANIZATION = T.StructType([
    T.StructField("pos", T.IntegerType()), *[T.StructField(n, _S) for n in ("id", "name", "organization_type", "official_domain")], T.StructField("enabled", T.BooleanType()),
    *[T.StructField(n, _S) for n in ("prefecture", "parent_organization_id", "notes")],
])
SOURCE = T.StructType([
    T.StructField("pos", T.IntegerType()), *[T.StructField(n, _S) for n in ("id", "organization_id", "name", "url", "collector_type", "source_category", "priority")], T.StructField("enabled", T.BooleanType()),
    *[T.StructField(n, _S) for n in ("link_selector", "title_selector", "content_selector")],
    *[T.StructField(n, T.ArrayType(_S)) for n in ("category_includes", "title_includes", "title_excludes", "document_type_hints")],
    *[T.StructField(n, _S) for n in ("notes", "last_verified_at", "verification_status", "initial_since")], T.StructField("allow_empty_candidates", T.BooleanType()),
])
# Closed vocabularies.
TYPES = "designated_city prefecture municipality special_ward public_agency external_organization".split()
COLLECTORS = "rss list_page single_page manual custom".split()
CATEGORIES = "procurement rfi proposal public_private_partnership digital_news policy_signal budget council plan other".split()
PRIORITIES = "high medium low".split()
VERIFICATION = "verified unverified needs_review".split()


def load(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """(organizations, sources) of a registry document; unknown keys are an error."""
    import yaml

    doc = yaml.load(text, Loader=yaml.BaseLoader)
    if not isinstance(doc, dict) or set(doc) != {"version", "organizations", "sources"} or doc["version"] != "1" or not doc["organizations"]:
        raise ValueError("a registry has version 1, organizations and sources")

    def value(k, name, kind, x):
        if isinstance(kind, T.BooleanType):
            if x not in ("true", "True", "TRUE", "false", "False", "FALSE"):
                raise ValueError(f"row {k}: {name} is no boolean: {x!r}")
            return x.lower() == "true"
        if isinstance(kind, T.ArrayType) != isinstance(x, list) or isinstance(x, dict) or isinstance(x, list) and not all(isinstance(y, str) for y in x):
            raise ValueError(f"row {k}: {name} is {'no list of texts' if isinstance(kind, T.ArrayType) else 'no text'}: {x!r}")
        return x

    def rows(items, schema):
        names = [f.name for f in schema.fields[1:]]
        for k, item in enumerate(items):
            if extra := set(item) - set(names):
                raise ValueError(f"row {k}: unknown keys {sorted(extra)}")
            yield (k, *[value(k, f.name, f.dataType, item[f.name]) if f.name in item else None for f in schema.fields[1:]])

    return spark.createDataFrame(list(rows(doc["organizations"], ORGANIZATION)), ORGANIZATION), spark.createDataFrame(list(rows(doc["sources"], SOURCE)), SOURCE)


def violations(orgs: DataFrame, sources: DataFrame) -> DataFrame:
    """(coll, pos, field, issue): field rules, repeats of ids and canonical URLs (naming the first), and broken references."""
    good_id, blank = r"^[a-z0-9]+(-[a-z0-9]+)*$", lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    outside = lambda c, words: ~F.coalesce(F.col(c).isin(words), F.lit(False))

    def rules(df, coll, checks):
        found = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(True)), F.struct(F.lit(f).alias("field"), F.lit(msg).alias("issue"))) for f, cond, msg in checks]))
        return df.select(F.lit(coll).alias("coll"), "pos", F.explode(found).alias("v")).select("coll", "pos", "v.field", "v.issue")

    iso = lambda c: F.col(c).isNotNull() & (~F.regexp_like(c, F.lit(r"^\d{4}-\d{2}-\d{2}$")) | F.try_to_date(F.col(c), "yyyy-MM-dd").isNull())
    o = rules(orgs, "organizations", [("id", ~F.regexp_like("id", F.lit(good_id)), "id"), ("name", blank(F.col("name")), "blank"), ("organization_type", outside("organization_type", TYPES), "enum"), ("official_domain", blank(F.col("official_domain")), "blank"), ("enabled", F.col("enabled").isNull(), "missing")])
    bad = lambda c: F.col(c).isNotNull() & (blank(F.col(c)) | F.contains(c, F.lit("\0")))
    lists = lambda c: F.coalesce(F.exists(F.col(c), lambda x: F.coalesce(F.trim(x) == "", F.lit(True))), F.lit(False))
    s = rules(sources, "sources", [
        ("id", ~F.regexp_like("id", F.lit(good_id)), "id"), ("name", blank(F.col("name")), "blank"), ("url", ~F.regexp_like("url", F.lit("^https?://[^/]+")), "url"), ("collector_type", outside("collector_type", COLLECTORS), "enum"),
        ("source_category", outside("source_category", CATEGORIES), "enum"), ("priority", outside("priority", PRIORITIES), "enum"), ("enabled", F.col("enabled").isNull(), "missing"),
        *[(c, bad(c), "blank") for c in ("title_selector", "link_selector", "content_selector")], *[(c, lists(c), "blank") for c in ("category_includes", "title_includes", "title_excludes", "document_type_hints")],
        ("initial_since", iso("initial_since"), "date"), ("last_verified_at", iso("last_verified_at"), "date"),
        ("verification_status", F.col("verification_status").isNotNull() & outside("verification_status", VERIFICATION), "enum"),
    ])

    def repeats(df, coll, field, key):
        rows = repeated(df.select("pos", key.alias("k")), "k", "pos")
        return rows.select(F.lit(coll).alias("coll"), "pos", F.lit(field).alias("field"), F.concat(F.lit("repeats "), F.col("first_pos").cast("string")).alias("issue"))

    broken = lambda df, coll, field: unknown_references(df, field, orgs, "id").select(F.lit(coll).alias("coll"), "pos", F.lit(field).alias("field"), F.lit("unknown").alias("issue"))
    parts = [o, s, repeats(orgs, "organizations", "id", F.col("id")), repeats(sources, "sources", "id", F.col("id")), repeats(sources, "sources", "url", canonical(F.col("url"))), broken(orgs, "organizations", "parent_organization_id"), broken(sources, "sources", "organization_id")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def repeated(df: DataFrame, key: str, pos: str) -> DataFrame:
    """(pos, first_pos) of rows whose key, not null, an earlier row has; the first is a minimum that tasks take before the shuffle."""
    first = f"first_{pos}"
    several = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(pos).alias(first), F.max(pos).alias("last")).filter(F.col(first) < F.col("last"))
    return df.select(key, pos).join(several.select(key, first), key).filter(F.col(pos) > F.col(first)).select(pos, first)


def unknown_references(df: DataFrame, field: str, known: DataFrame, id_: str) -> DataFrame:
    """Rows of `df` whose field, not null, is no id of `known`."""
    name = unused(df, "known")
    return df.filter(F.col(field).isNotNull()).join(known.select(F.col(id_).alias(name)).distinct(), F.col(field) == F.col(name), "left_anti")


def enabled_sources(orgs: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources that are enabled and whose own organization is."""
    name = unused(sources, "org")
    return sources.filter("enabled").join(orgs.filter("enabled").select(F.col("id").alias(name)), F.col("organization_id") == F.col(name), "left_semi")


def by_municipality(orgs: DataFrame, sources: DataFrame, name: str) -> DataFrame:
    """Enabled sources of organizations that have the name, or below one that has."""
    named = orgs.filter(F.col("name") == name).select(F.col("id").alias("ancestor"))
    below = closure(orgs, "id", "parent_organization_id").join(named, "ancestor", "left_semi").select(F.col("node").alias("below")).distinct()
    return enabled_sources(orgs, sources).join(below, F.col("organization_id") == F.col("below"), "left_semi")


def listed(orgs: DataFrame, sources: DataFrame, organization: str | None = None, priority: str | None = None, enabled: bool | None = None) -> DataFrame:
    """Sources with their organization's name, in registration order; `enabled` looks at the source alone."""
    rows = sources
    for name, v in (("organization_id", organization), ("priority", priority), ("enabled", enabled)):
        rows = rows if v is None else rows.filter(F.col(name) == v)
    return rows.join(orgs.select(F.col("id").alias("organization_id"), F.col("name").alias("organization"), F.col("pos").alias("organization_pos")), "organization_id").orderBy("organization_pos", "pos")


def organization_names(orgs: DataFrame) -> DataFrame:
    """Names of organizations, each once, in binary order."""
    return orgs.select("name").distinct().orderBy("name")


def totals(orgs: DataFrame, sources: DataFrame) -> DataFrame:
    """One row: organizations, sources, enabled_sources."""
    return orgs.agg(F.count("*").alias("organizations")).crossJoin(sources.agg(F.count("*").alias("sources"), F.count_if("enabled").alias("enabled_sources")))


def selected(spark: SparkSession, orgs: DataFrame, sources: DataFrame, municipality: str | None = None, all_: bool = False, ids: list[str] | None = None) -> DataFrame:
    """The sources of a batch in registration order, with `place`: of a municipality, all enabled ones, or listed ones, in the list's order; exactly one way. Unknown and repeated ids are errors."""
    if (municipality is not None) + all_ + (ids is not None) != 1:
        raise ValueError("one of a municipality, all, and a list of sources")
    if ids is not None:
        if len(set(ids)) < len(ids):
            raise ValueError("a source is listed twice")
        if unknown := [r.id for r in unknown_ids(spark, ids, sources).collect()]:
            raise ValueError(f"no such sources: {sorted(unknown)}")
        order = spark.createDataFrame([(x, k) for k, x in enumerate(ids)], "id string, place int")
        return sources.join(F.broadcast(order), "id")
    some = enabled_sources(orgs, sources) if all_ else by_municipality(orgs, sources, municipality)
    if not some.limit(1).count():
        raise ValueError("no enabled source")
    return some.withColumn("place", F.col("pos"))


def unknown_ids(spark: SparkSession, wanted: list[str], sources: DataFrame) -> DataFrame:
    return spark.createDataFrame([(w,) for w in wanted], "id string").join(sources.select("id"), "id", "left_anti")
