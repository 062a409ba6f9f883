"""The linkage tables, derived from the tables at hand by arithmetic that any SQL engine can repeat.

Every document is a catalogue entry (its text the title, its source and language a synonym); every benchmark item is a row of a watch list.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize
from ..operators import search
from ..scratch import folder

AS_OF = 2026
TYPE_NAMES = ("Tv", "Movie", "Ova", "Ona", "Special", "Unknown")
STATUS_NAMES = ("Finished", "Ongoing", "Upcoming", "Unknown")
SEASON_NAMES = ("Spring", "Summer", "Fall", "Winter", "Undefined")
WATCH_NAMES = ("Dropped", "Completed", "Watching", "OnHold", "PlanToWatch")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nth(names: tuple[str, ...], k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (k % len(names)).cast("int") + 1)


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, n = F.col("doc_id"), F.col("n_chars")
    season = F.when(i % 3 == 0, (1 + i % 4).cast("double"))
    cons = F.struct(
        season.alias("season"), F.when(i % 5 == 0, 2.0).alias("part"), F.lit(None).cast("double").alias("episode"),
        F.lit(False).alias("is_final_season"), F.lit(False).alias("is_final_part"), F.lit(False).alias("is_final_episode"),
    )
    return table(spark, sf_dir, "documents").select(
        i.alias("id"), F.col("text").alias("title"), normalize("text").alias("norm_title"), F.array(normalize(F.concat_ws(" ", "source", "lang"))).alias("norm_synonyms"), cons.alias("cons"),
        F.when(i % 7 != 3, (2000 + i % 25).cast("int")).alias("year"), nth(TYPE_NAMES, i).alias("anime_type"), nth(STATUS_NAMES, i).alias("status"), nth(SEASON_NAMES, i).alias("season"), (1 + n % 26).cast("int").alias("episodes"),
    )


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id")
    date = F.when(i % 5 != 4, F.date_add(F.lit("2000-01-01").cast("date"), ((i * 37) % 9000).cast("int")))
    meta = F.struct(F.when(i % 2 == 0, (1 + i % 3).cast("double")).alias("season"), F.when(i % 4 == 1, 2.0).alias("part"), F.when(i % 6 == 5, 3.0).alias("episode"))
    return table(spark, sf_dir, "benchmark").select(
        i.alias("list_pos"), i.alias("id"), F.lit("a").alias("provider"), F.col("text").alias("title"), normalize("text").alias("norm_title"), meta.alias("meta"),
        (i % 8 != 7).alias("has_date"), date.alias("date"), F.lit(True).alias("has_year"), F.year(date).alias("year"), (i % 3 != 2).alias("has_type"), nth(TYPE_NAMES, i).alias("anime_type"),
        F.lit(True).alias("has_status"), nth(STATUS_NAMES, i + 1).alias("status"), (i % 4 != 3).alias("has_episodes"), (1 + i % 13).cast("int").alias("episodes"),
        nth(WATCH_NAMES, i).alias("watch_status"), (i % 13).cast("int").alias("watched_episodes"), (i % 11).cast("int").alias("score"), F.when(i % 3 == 0, date).alias("finish_date"),
        F.when(i % 2 == 1, F.lit("seen <twice> & liked")).alias("note"), F.when(i % 7 == 0, i * 3).when(i % 11 == 0, i + 10_000_000).alias("mal_id"),
    )


_INDEXES: dict[tuple[str, str], search.Index] = {}


def index(spark: SparkSession, sf_dir: str) -> search.Index:
    """The catalogue's index, written once for an application and then read."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        _INDEXES[key] = search.build(catalog(spark, sf_dir)).write(f"{folder(spark)}/index-{uuid.uuid4().hex[:12]}")
    return _INDEXES[key]


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list's titles as queries."""
    return source(spark, sf_dir).select(F.col("list_pos").alias("q"), F.col("norm_title").alias("text"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair of a query and a candidate for each order."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    date = F.when(k % 13 != 0, F.to_date("o_orderdate"))
    number = lambda x, every, step: F.when(x % every != 0, (x % step).cast("double"))
    meta = F.struct(
        F.when(k % 17 == 0, 99.0).otherwise(number(k, 3, 4)).alias("season"), number(k, 5, 3).alias("part"),
        F.when(k % 19 == 0, 99.0).otherwise(number(k, 2, 5)).alias("episode"),
    )
    cons = F.struct(
        F.when(c % 17 == 0, 99.0).otherwise(number(c, 4, 4)).alias("season"), number(c, 6, 3).alias("part"), F.lit(None).cast("double").alias("episode"),
        (c % 10 == 0).alias("is_final_season"), (c % 14 == 0).alias("is_final_part"), (c % 15 == 0).alias("is_final_episode"),
    )
    return table(spark, sf_dir, "orders").select(
        k.alias("k"), meta.alias("meta"), cons.alias("cons"), F.when(k % 9 != 0, (1990 + k % 12).cast("int")).alias("year"), F.when(c % 8 != 0, (1990 + c % 12).cast("int")).alias("c_year"),
        nth(TYPE_NAMES, k).alias("type"), nth(TYPE_NAMES, c).alias("c_type"), nth(STATUS_NAMES, k).alias("status"), nth(STATUS_NAMES, c).alias("c_status"), date.alias("date"), nth(SEASON_NAMES, c).alias("c_season"),
        (k % 30).cast("int").alias("episodes"), (c % 30).cast("int").alias("c_episodes"),
    )


def winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of labelled documents: the winner is another document's id, or none."""
    i = F.col("doc_id")
    return table(spark, sf_dir, "labels").select(
        i.alias("source_id"), i.alias("list_pos"), F.when(F.col("quality") == 1, i % 50).alias("winner_id"),
        ((F.col("quality") == 1) | (i % 2 == 0)).alias("has_top"),
    )


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, sf_dir, "labels").where("quality = 0").select(i.alias("source_id"), (i % 45).alias("catalog_id"))


def ignores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("source_id"))
