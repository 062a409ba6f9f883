"""The operations that a user calls, over versioned snapshots of a catalogue and a list."""

from __future__ import annotations

import threading
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CatalogNotLoaded, ListNotLoaded, NotLoaded, StaleVersion
from ..functions.text import normalize_title
from ..functions.titles import title_meta
from ..operators import match, merge, score, search
from ..sinks import export
from ..sources import catalog as catalogs
from ..sources import lists


@dataclass(frozen=True)
class Snapshot:
    version: int
    value: object


class Cell:
    """A value with a version; readers keep what they have read, writers may insist on the version they saw."""

    def __init__(self, name: str):
        self.name, self._now, self._lock = name, None, threading.Lock()
        self._version = 0

    def load(self) -> Snapshot:
        now = self._now
        if now is None:
            raise {"catalogue": CatalogNotLoaded, "list": ListNotLoaded}.get(self.name, NotLoaded)(f"no {self.name} is loaded", what=self.name)
        return now

    def store(self, value: object, expected: int | None = None) -> int:
        with self._lock:
            if expected is not None and expected != self._version:
                raise StaleVersion(f"the {self.name} has changed", expected=expected, now=self._version)
            self._version += 1
            self._now = Snapshot(self._version, value)
            return self._version

    def clear(self, expected: int | None = None) -> None:
        with self._lock:
            if expected is not None and expected != self._version:
                raise StaleVersion(f"the {self.name} has changed", expected=expected, now=self._version)
            self._version += 1
            self._now = None


class Engine:
    def __init__(self, spark: SparkSession, as_of_year: int):
        self.spark, self.as_of = spark, as_of_year
        self.catalog, self.source = Cell("catalogue"), Cell("list")

    # --- catalogue ---

    def catalog_metadata(self, path: str) -> dict:
        return {"last_update": catalogs.header(self.spark, path)["lastUpdate"]}

    def check_catalog_update(self, local: dict | None, remote: dict | None) -> bool:
        """Whether the release that a site tells of (release, sha256, compressed_size) is another than the one at hand."""
        return catalogs.needs_update(local, remote)

    def download_catalog(self, url: str, path: str, release: str, sha256: str | None = None) -> int:
        """Fetch a release of the catalogue, and load it."""
        catalogs.download(url, path, release, sha256)
        return self.load_catalog(path)

    def load_catalog(self, path: str) -> int:
        catalogs.header(self.spark, path)
        rows = catalogs.load(self.spark, path).persist()
        catalogs.check_enums(rows)
        return self.use_catalog(rows)

    def use_catalog(self, rows: DataFrame) -> int:
        rows.createOrReplaceTempView("catalog")
        return self.catalog.store((rows, search.build(rows).persist()))

    def catalog_ids(self) -> DataFrame:
        return self.catalog.load().value[0].select("id").orderBy("id")

    def catalog_entries(self, ids: list[int] | None = None) -> DataFrame:
        rows = self.catalog.load().value[0]
        return rows.orderBy("id") if ids is None else merge.lookup(rows, ids, "id")

    # --- list ---

    def load_source(self, provider: str, path: str) -> int:
        """A saved answer (a), or a Parquet folder of pages (b and c)."""
        if provider == "a":
            return self.use_source(lists.a_list(lists.a_items(self.spark, path)))
        saved = self.spark.read.parquet(path)
        return self.use_source(lists.b_list(saved) if provider == "b" else lists.c_list(saved))

    def use_source(self, rows: DataFrame) -> int:
        rows = rows.persist()
        rows.createOrReplaceTempView("source")
        return self.source.store(rows)

    def source_ids(self, urgent_first: bool = True) -> DataFrame:
        rows = self.source.load().value
        provider = rows.select("provider").limit(1).collect()
        ordered = match.urgency(rows) if urgent_first and provider and provider[0][0] == "a" else rows.orderBy("list_pos")
        return ordered.select("id")

    def source_entries(self, ids: list[int] | None = None) -> DataFrame:
        rows = self.source.load().value
        return rows.orderBy("list_pos") if ids is None else merge.lookup(rows, ids, "id")

    # --- search and matching ---

    def fuzzy_search(self, query: str, limit: int = 0, threshold: float | None = None) -> DataFrame:
        rows, index = self.catalog.load().value
        asked = self.spark.createDataFrame([(0, query)], "q long, text string").withColumn("text", normalize_title("text"))
        return search.search(asked, index, search.Options.service(limit, threshold)).join(rows, "id").orderBy("search_rank")

    def fuzzy_match(self, query: str, source_id: int | None = None, limit: int = 0, threshold: float | None = None) -> DataFrame:
        """All candidates of a text, scored with the linked row's attributes if there is one."""
        rows, index = self.catalog.load().value
        asked = self.spark.createDataFrame([(query,)], "title string").withColumn("norm_title", normalize_title("title")).withColumn("meta", title_meta("norm_title"))
        keep = [f"has_{x}" for x in ("date", "year", "type", "status", "episodes")] + ["date", "year", "anime_type", "status", "episodes"]
        if source_id is not None:
            linked = self.source.load().value.where(F.col("id") == source_id).select(*keep)
            row, preset = asked.crossJoin(F.broadcast(linked.limit(1))), score.QUERY_LINKED  # one row beside one row
        else:
            nothing = {f"has_{x}": F.lit(False) for x in ("date", "year", "type", "status", "episodes")} | {
                "date": F.lit(None).cast("date"), "year": F.lit(None).cast("int"), "anime_type": F.lit(None).cast("string"),
                "status": F.lit(None).cast("string"), "episodes": F.lit(None).cast("int"),
            }
            row, preset = asked.withColumns(nothing), score.QUERY_FREE
        row = row.withColumn("list_pos", F.lit(0).cast("long"))
        found = search.search(row.select(F.col("list_pos").alias("q"), F.col("norm_title").alias("text")), index, search.Options.service(limit, threshold))
        return match.choose(match.score_candidates(row, found, rows, preset, self.as_of), preset).orderBy("rank")

    def match_source_list(self, limit: int = 0, threshold: float | None = None) -> DataFrame:
        rows, index = self.catalog.load().value
        found = match.match_list(self.source.load().value, rows, index, search.Options.service(limit, threshold, strict=True), score.STRICT, self.as_of)
        found.createOrReplaceTempView("matches")
        return found

    def export_xml(self, pairs: DataFrame, path: str) -> int:
        return export.export_xml(pairs, self.source.load().value, path)

    def check_versions(self, **seen: int) -> None:
        """An error if any of the versions a caller works with is no longer the current one."""
        for name, version in seen.items():
            now = getattr(self, name).load().version
            if now != version:
                raise StaleVersion(f"the {name} has changed", expected=version, now=now)
