"""The public catalogue: regions and layers with their organizations and sources, and its search."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import nfkc

# Regions and their prefectures in order.
REGIONS = [
    ("hokkaido", "北海道", "北海道"),
    ("tohoku", "東北", "青森県 岩手県 宮城県 秋田県 山形県 福島県"),
    ("kanto", "関東", "茨城県 栃木県 群馬県 埼玉県 千葉県 東京都 神奈川県"),
    ("chubu", "中部", "新潟県 富山県 石川県 福井県 山梨県 長野県 岐阜県 静岡県 愛知県"),
    ("kinki", "近畿", "三重県 滋賀県 京都府 大阪府 兵庫県 奈良県 和歌山県"),
    ("chugoku", "中国", "鳥取県 島根県 岡山県 広島県 山口県"),
    ("shikoku", "四国", "徳島県 香川県 愛媛県 高知県"),
    ("kyushu-okinawa", "九州・沖縄", "福岡県 佐賀県 長崎県 熊本県 大分県 宮崎県 鹿児島県 沖縄県"),
]


def prefectures(spark: SparkSession) -> DataFrame:
    """region_id, region, region_at, prefecture, prefecture_at: a fixed dimension of 47 rows."""
    rows, at = [], 0
    for k, (id_, name, list_) in enumerate(REGIONS):
        for p in list_.split():
            rows.append((id_, name, k, p, at))
            at += 1
    return spark.createDataFrame(rows, "region_id string, region string, region_at int, prefecture string, prefecture_at int")


def grid(cells: DataFrame, rows: DataFrame, columns: DataFrame, keys: tuple[str, str], counts: list[str]) -> DataFrame:
    """Every row with every column, with counts of 0 where `cells` has none; both dimensions are fixed lists."""
    full = rows.select(keys[0]).crossJoin(columns.select(keys[1]))
    return full.join(cells, list(keys), "left").fillna(0, subset=counts)


def matches_all(text: Column, query: str) -> Column:
    """Whether all words of the query are in the (lower-cased) text; without words everything matches."""
    out = F.lit(True)
    for term in query.lower().split():
        out = out & F.contains(text, F.lit(term))
    return out


def nested_sources(rows: DataFrame, key: str) -> DataFrame:
    """key, n, sources: the sources (status, name, url) of each key as an array, active ones first, then by name in Japanese collation and url.

    Names and addresses of one organization's sources are one row by contract; it holds nothing else of them.
    """
    s = F.struct("status", F.expr("name COLLATE ja").alias("by"), "url", "name")
    lists = rows.groupBy(key).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(s)).alias("sources"))
    return lists.withColumn("sources", F.transform("sources", lambda x: F.struct(x["name"].alias("name"), x["url"].alias("url"), x["status"].alias("status"))))


#: Kinds of organizations that the catalogue's layers are made of.
ROOT_TYPES = ["prefecture", "designated_city", "municipality", "special_ward"]


def problems(orgs: DataFrame, roots: DataFrame, dim: DataFrame) -> DataFrame:
    """(organization, issue) that keep organizations out of the catalogue: a root of another kind, without a prefecture, or of an unknown one."""
    top = roots.select(F.col("root").alias("id")).distinct().join(orgs, "id").join(dim.select("prefecture", F.lit(True).alias("placed")), "prefecture", "left")
    issue = F.when(~F.col("organization_type").isin(ROOT_TYPES), "type").when(F.col("prefecture").isNull(), "no prefecture").when(F.col("placed").isNull(), "unknown prefecture")
    return top.select(F.col("id").alias("organization"), issue.alias("issue")).filter("issue IS NOT NULL")


def search_view(catalogue: DataFrame, query: str) -> DataFrame:
    """region_id, layer, organization, n, region_n: visible sources of a search of name, organization and URL, with counts that roll up; what has none is left out."""
    rows = catalogue.select("region_id", "layer", "organization", F.explode("sources").alias("s"))
    text = F.lower(F.trim(nfkc(F.concat_ws(" ", "organization", "s.name", "s.url"))))
    seen = rows.filter(matches_all(text, unicodedata.normalize("NFKC", query))).groupBy("region_id", "layer", "organization").agg(F.count("*").alias("n"))
    return seen.join(seen.groupBy("region_id").agg(F.sum("n").alias("region_n")), "region_id")


def public_sources(orgs: DataFrame, sources: DataFrame, roots: DataFrame, dim: DataFrame) -> DataFrame:
    """region, layer, root organization and its sources as a nested, ordered array; only name, url and status are shown. `problems` tells what can't be placed."""
    status = F.when(F.col("enabled"), "active").otherwise("inactive")
    of = sources.select("organization_id", status.alias("status"), "name", "url")
    root = roots.select(F.col("node").alias("organization_id"), "root")
    lists = nested_sources(of.join(root, "organization_id"), "root")
    named = orgs.select(F.col("id").alias("root"), F.col("name").alias("organization"), "organization_type", "prefecture", "pos")
    layer = F.when(F.col("organization_type") == "prefecture", "prefecture").otherwise("municipality")
    placed = named.join(lists, "root").join(F.broadcast(dim), "prefecture").withColumn("layer", layer)
    return placed.select("region_id", "region", "region_at", "layer", "root", "organization", "prefecture_at", "pos", "sources")
