"""The reference catalogue: JSON lines after a header line."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import tempfile
import urllib.error
import urllib.request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BadDigest, BadEnum, BadJson, CatalogHttp, CatalogIo, EmptyCatalog, MissingAsset
from ..functions.text import first_linked_id, normalize_title
from ..functions.titles import consolidate, with_title_meta
from ..operators.merge import last_wins
from ..schema import RAW_ENTRY, RAW_HEADER

# What the file may say.
_TYPES = {"TV": "Tv", "MOVIE": "Movie", "OVA": "Ova", "ONA": "Ona", "SPECIAL": "Special", "UNKNOWN": "Unknown"}
_STATUSES = {"FINISHED": "Finished", "ONGOING": "Ongoing", "UPCOMING": "Upcoming", "UNKNOWN": "Unknown"}
_SEASONS = {"SPRING": "Spring", "SUMMER": "Summer", "FALL": "Fall", "WINTER": "Winter", "UNDEFINED": "Undefined"}


def _strict(column, table: dict[str, str], name: str):
    got = F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), column)
    return F.when(column.isNotNull() & got.isNull(), F.raise_error(F.concat(F.lit(f"unknown {name}: "), column))).otherwise(got)


def header(spark: SparkSession, path: str) -> dict:
    """The file's first line: {lastUpdate, ...}."""
    first = spark.read.text(path).limit(1).collect()
    if not first or not first[0][0].strip():
        raise EmptyCatalog("the catalogue is empty", path=path)
    try:
        got = json.loads(first[0][0])
    except ValueError as e:
        raise BadJson("the header isn't JSON", path=path, cause=str(e)) from e
    if not isinstance(got, dict) or "lastUpdate" not in got:
        raise BadJson("the header has no lastUpdate", path=path)
    return got


def raw_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of the lines and of the header's data, with their position. A bad line fails the load; blank lines are passed over."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).where("trim(value) <> ''")
    head = F.get_json_object("value", "$.lastUpdate").isNotNull()
    options = {"mode": "FAILFAST"}
    own = lines.where(~head).select(F.struct(F.lit(1).alias("part"), "line", F.lit(0).alias("k")).alias("pos"), F.from_json("value", RAW_ENTRY, options).alias("e"))
    inline = lines.where(head).select("line", F.posexplode(F.from_json("value", RAW_HEADER, options)["data"]).alias("k", "e"))
    return inline.select(F.struct(F.lit(0).alias("part"), "line", "k").alias("pos"), "e").unionByName(own).select("pos", "e.*")


def with_titles(rows: DataFrame) -> DataFrame:
    """Normalised titles and synonyms, their numbers, and what an entry's titles agree on."""
    long = rows.select(
        "id", F.posexplode(F.concat(F.array("title"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("p", "t"),
    ).withColumn("norm", normalize_title("t"))
    parsed = with_title_meta(long, "norm")
    grouped = parsed.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("p", "norm", "meta"))).alias("all"))
    own = grouped.select(
        "id", F.col("all")[0]["norm"].alias("norm_title"), F.col("all")[0]["meta"].alias("meta"),
        F.transform(F.filter("all", lambda x: x["p"] > 0), lambda x: x["norm"]).alias("norm_synonyms"), F.transform(F.filter("all", lambda x: x["p"] > 0), lambda x: x["meta"]).alias("synonyms_meta"),
    )
    return rows.join(own, "id").join(consolidate(parsed, "id", "p"), "id")


def entries(raw: DataFrame) -> DataFrame:
    """Catalogue rows by id: the number of the first reference-site link; rows without one go; of equal ids the last stays."""
    rows = raw.withColumn("id", first_linked_id("sources")).where("id is not null")
    kept = last_wins(rows, "id", "pos")
    plain = kept.select(
        "id", "title", F.coalesce("synonyms", F.array().cast("array<string>")).alias("synonyms"), _strict(F.col("type"), _TYPES, "type").alias("anime_type"), "episodes",
        _strict(F.col("status"), _STATUSES, "status").alias("status"), _strict(F.col("animeSeason.season"), _SEASONS, "season").alias("season"), F.col("animeSeason.year").alias("year"),
        F.col("duration.value").alias("duration_s"), "picture", "thumbnail", "sources", "studios", "producers", F.col("relatedAnime").alias("related"), "tags",
    )
    return with_titles(plain)


def load(spark: SparkSession, path: str) -> DataFrame:
    return entries(raw_entries(spark, path))


def check_enums(catalog: DataFrame) -> None:
    """Fail now, not at the first use, if the file says something unknown."""
    try:
        catalog.agg(F.count("anime_type"), F.count("status"), F.count("season")).collect()
    except Exception as e:
        raise BadEnum("the catalogue has an unknown value", cause=str(e).split("\n")[0]) from e


def verify_digest(spark: SparkSession, path: str, expected: str) -> None:
    got = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]
    if got.lower() != expected.strip().lower():
        raise BadDigest("the file isn't what was published", expected=expected, got=got)


def decompress(source: str, target: str) -> None:
    """A zstd file, unpacked beside the target and then moved there."""
    import zstandard

    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(target)))
    try:
        with os.fdopen(handle, "wb") as out, open(source, "rb") as f:
            zstandard.ZstdDecompressor().copy_stream(f, out)
        os.replace(temporary, target)
    except BaseException:
        os.unlink(temporary)
        raise


def download(url: str, target: str, release: str, sha256: str | None = None) -> str:
    """Fetch a packed catalogue, check it, unpack it to the target and write what it was beside it; the target stays if any of it fails."""
    from ..sinks.export import write_sidecar

    handle, packed = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(target)))
    try:
        try:
            with os.fdopen(handle, "wb") as out, urllib.request.urlopen(url) as answer:
                shutil.copyfileobj(answer, out)
        except urllib.error.HTTPError as e:
            raise (MissingAsset if e.code == 404 else CatalogHttp)(f"the catalogue's address answers {e.code}", url=url, status=e.code) from e
        except OSError as e:
            raise CatalogIo("the catalogue can't be fetched", url=url, cause=str(e)) from e
        got = file_digest(packed)
        if sha256 is not None and got != sha256.strip().lower():
            raise BadDigest("the file isn't what was published", expected=sha256, got=got)
        decompress(packed, target)
        write_sidecar(f"{target}.json", release, got, os.path.getsize(packed))
    finally:
        os.unlink(packed)
    return got


def needs_update(local: dict | None, remote: dict | None) -> bool:
    keys = ("release", "sha256", "compressed_size")
    pick = lambda d: None if d is None else tuple(d.get(k) for k in keys)
    return pick(local) != pick(remote)


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()
