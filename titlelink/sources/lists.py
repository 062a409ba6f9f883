"""Watch lists of three sites as one table."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import BadJson, RetryExhausted, SourceRejected
from ..functions import text as X
from ..functions.titles import with_title_meta
from ..operators import merge
from ..schema import A_ENVELOPE, SOURCE
from . import pages


def _finish(rows: DataFrame) -> DataFrame:
    """The columns of SOURCE with the title's normal form and numbers."""
    full = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in SOURCE.fields])
    return with_title_meta(full.withColumn("norm_title", X.normalize_title("title")), "norm_title")


def a_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of a saved answer with their position; an answer that isn't a success, or has no result, is an error."""
    body = spark.read.text(path, wholetext=True)
    read = body.select(F.from_json("value", A_ENVELOPE).alias("e")).select("e.success", "e.message", F.col("e.result").isNull().alias("bare")).first()
    if read is None or read.success is None:
        raise BadJson("the answer isn't JSON", path=path)
    if read.success.lower() not in ("true", "1") or read.bare:
        raise SourceRejected(read.message or "no result", path=path)
    return body.select(F.from_json("value", A_ENVELOPE).alias("e")).select(F.posexplode("e.result.items").alias("list_pos", "i")).select("list_pos", "i.*")


def a_list(items: DataFrame) -> DataFrame:
    kept = merge.last_wins(items, "titleId", "list_pos")
    rows = kept.select(
        F.col("list_pos").cast("long"), F.col("titleId").alias("id"), F.lit("a").alias("provider"), "title",
        F.lit(True).alias("has_date"), X.loose_date("premiereDate").alias("date"), F.lit(True).alias("has_year"), F.year(X.loose_date("premiereDate")).alias("year"),
        F.lit(True).alias("has_type"), X.a_type("animeType").alias("anime_type"), F.lit(True).alias("has_status"), X.a_status("titleStatus").alias("status"),
        F.lit(True).alias("has_episodes"), F.coalesce("episodes", F.lit(0)).alias("episodes"), X.a_watch("watchStatus").alias("watch_status"),
        X.whole_number("watchedEpisodesCnt").alias("watched_episodes"), F.col("rateTotal").alias("score"), X.loose_date("finishDate").alias("finish_date"), F.col("userNote").alias("note"),
    )
    return _finish(rows)


# The sites' labels.
_B_LABELS = {"alternative_title": ("Alternatywny tytuł", "Alternatywny tytul"), "year_text": ("Rok produkcji",), "type_text": ("Rodzaj",), "status_text": ("Status",)}


def b_list(list_pages: DataFrame, detail_pages: DataFrame | None = None) -> DataFrame:
    """Pages (section, section_pos, page, html) and details (slug, html). The same entry in several sections is merged by precedence."""
    found = pages.scrape(list_pages, "b_list", ["section", "section_pos", "page"])
    order = Window.partitionBy("section_pos").orderBy("page", "pos")
    offset = found.groupBy("section_pos").agg(F.count("*").alias("n"))
    offset = offset.select("section_pos", (F.sum("n").over(Window.orderBy("section_pos")) - F.col("n")).alias("before"))  # a row for each section
    rows = found.join(F.broadcast(offset), "section_pos").withColumn("list_pos", F.col("before") + F.row_number().over(order) - 1)
    rows = rows.select(
        "list_pos", "section", "slug", "title", X.rating("info").alias("score"), X.site_status(X.status_text("info")).alias("site_status"),
        X.section_rank("section").alias("rank"),
    )
    if detail_pages is not None:
        details = pages.scrape(detail_pages, "b_detail", ["slug"])
        cells = pages.labelled(details, "slug", _B_LABELS)
        detail = details.join(cells, "slug", "left").select(
            "slug", X.page_linked_id("mal_url").alias("mal_id"), X.cell("alternative_title").alias("alternative_title"), X.cell("year_text").try_cast("int").alias("year"),
            X.site_type("type_text").alias("anime_type"), X.site_status("status_text").alias("site_status"), F.col("episode_rows").alias("episodes"),
        )
        rows = merge.with_details(rows, [detail], "slug", ["mal_id", "alternative_title", "year", "anime_type", "site_status", "episodes"])
    else:
        rows = rows.withColumns({n: F.lit(None).cast(t) for n, t in (("mal_id", "long"), ("alternative_title", "string"), ("year", "int"), ("anime_type", "string"), ("episodes", "int"))})
    one = merge.by_precedence(
        rows.withColumn("id", X.hashed_id("slug")), "id", "list_pos", "rank",
        ["section", "slug", "title", "score", "site_status", "mal_id", "alternative_title", "year", "anime_type", "episodes"],
    )
    watch = X.section_watch("section")
    return _finish(one.select(
        "list_pos", "id", F.lit("b").alias("provider"), "title", F.lit(False).alias("has_date"), F.lit(True).alias("has_year"), "year", F.col("anime_type").isNotNull().alias("has_type"), "anime_type",
        F.col("site_status").isNotNull().alias("has_status"), F.col("site_status").alias("status"), F.col("episodes").isNotNull().alias("has_episodes"), "episodes", watch.alias("watch_status"),
        F.when(watch == "Completed", F.coalesce("episodes", F.lit(0))).otherwise(0).alias("watched_episodes"), "score", "mal_id", F.concat(F.lit("/anime/"), "slug").alias("source_url"), "section",
    ))


_C_LABELS = {"japanese": ("Japoński", "Japonski"), "episodes_text": ("Odcinki",), "status_text": ("Status",), "start_text": ("Start emisji",), "end_text": ("Koniec emisji",)}


def _c_fields(read: DataFrame, link, title, episodes) -> DataFrame:
    """What a detail page or a tooltip says of an entry; what stands on its own goes before a labelled value."""
    return read.join(pages.labelled(read, "id", _C_LABELS), "id", "left").select(
        "id", link.alias("mal_id"), F.coalesce(title, X.cell("japanese")).alias("original_title"), X.site_status("status_text").alias("site_status"), X.site_type("badge").alias("anime_type"),
        F.col("start_text").try_cast("date").alias("premiere_date"), F.col("end_text").try_cast("date").alias("finish"),
        F.coalesce(episodes, F.regexp_extract("episodes_text", r"([0-9]+)", 1).try_cast("int")).alias("episodes"),
    )


def c_list(list_pages: DataFrame, detail_pages: DataFrame | None = None, tooltips: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Pages (page, html), details (id, html) and tooltips (id, body); the first of detail and tooltip that an entry has counts."""
    found = pages.scrape(list_pages, "c_list", ["page"])
    watched, total = X.progress("progress")
    order = Window.partitionBy(F.lit(0)).orderBy("page", "pos")  # one user's list
    rows = found.select(
        (F.row_number().over(order) - 1).cast("long").alias("list_pos"), "id", "slug", "title", X.site_type("type").alias("anime_type"),
        X.site_watch("status").alias("watch_status"), watched.alias("watched_episodes"), total.alias("episodes"),
        X.cell("score").try_cast("int").alias("score"),
    )
    fields = ["mal_id", "original_title", "site_status", "anime_type", "premiere_date", "finish", "episodes"]
    details = []
    if detail_pages is not None:
        details.append(_c_fields(pages.scrape(detail_pages, "c_detail", ["id"]), X.page_linked_id("mal_url"), F.lit(None).cast("string"), F.lit(None).cast("int")))
    if tooltips is not None:
        details.append(_c_fields(pages.scrape(tooltips, "c_tooltip", ["id"], "body"), F.lit(None).cast("long"), F.col("original_title"), F.col("episodes")))
    if details:
        rows = merge.with_details(rows, details, "id", fields, strict)
    else:
        rows = rows.withColumns({n: F.lit(None).cast(t) for n, t in (("mal_id", "long"), ("original_title", "string"), ("site_status", "string"), ("premiere_date", "date"), ("finish", "date"))})
    one = merge.first_then_fill(rows, "id", "list_pos", [c for c in rows.columns if c not in ("id", "list_pos")])
    return _finish(one.select(
        "list_pos", "id", F.lit("c").alias("provider"), "title", F.lit(True).alias("has_date"), F.col("premiere_date").alias("date"), F.lit(True).alias("has_year"), F.year("premiere_date").alias("year"),
        F.col("anime_type").isNotNull().alias("has_type"), "anime_type", F.col("site_status").isNotNull().alias("has_status"), F.col("site_status").alias("status"), F.col("episodes").isNotNull().alias("has_episodes"),
        "episodes", "watch_status", X.clamp_watched(F.col("watched_episodes"), F.col("episodes")).alias("watched_episodes"), "score", F.col("finish").alias("finish_date"), "mal_id", F.concat(F.lit("/anime/"), "slug").alias("source_url"),
    ))


class Throttle:
    """At most `rate` calls a second with bursts, and a few attempts; the last error stands."""

    def __init__(self, rate: float, burst: int = 1, attempts: int = 2, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.burst, self.attempts, self.clock, self.sleep = rate, burst, attempts, clock, sleep
        self.free, self.at = float(burst), clock()

    def call(self, fetch: Callable[[], str]) -> str:
        error: Exception | None = None
        for _ in range(self.attempts):
            now = self.clock()
            self.free, self.at = min(self.burst, self.free + (now - self.at) * self.rate), now
            if self.free < 1:
                self.sleep((1 - self.free) / self.rate)
                self.free, self.at = 1.0, self.clock()
            self.free -= 1
            try:
                return fetch()
            except Exception as e:  # noqa: BLE001
                error = e
        raise RetryExhausted(f"{self.attempts} attempts failed", cause=str(error)) from error


# Fixed values: (calls a second, burst, calls at once, attempts).
LIMITS = {"b": (120, 5, 10, 2), "c": (3, 1, 1, 2)}


def crawl(requests: DataFrame, fetch: Callable[[str], str], provider: str, path: str = "path") -> DataFrame:
    """With html: pages fetched by tasks, each within its share of the site's rate."""
    rate, burst, at_once, attempts = LIMITS[provider]
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in requests.schema.fields)}, html string"

    def run(parts):
        throttle = Throttle(rate / at_once, burst, attempts)
        for part in parts:
            yield part.assign(html=[throttle.call(lambda p=p: fetch(p)) for p in part[path]])

    return requests.repartition(at_once).mapInPandas(run, schema)


def links(source: DataFrame) -> DataFrame:
    """How many rows have a link of their own."""
    return source.agg(F.count_if(F.col("mal_id").isNotNull()).alias("direct"), F.count_if(F.col("mal_id").isNull()).alias("missing"))
