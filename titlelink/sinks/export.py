"""The list export: one XML file, its rows made by Spark, its frame and the file by the driver."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..errors import OutOfIndex

# The frame, the element names and their order.
OPEN = "<myanimelist>"
INFO = "<myinfo><user_export_type>1</user_export_type></myinfo>"
CLOSE = "</myanimelist>"
FIELDS = ("series_animedb_id", "my_watched_episodes", "my_start_date", "my_finish_date", "my_score", "my_status", "my_comments", "update_on_import")
STATUS = {"OnHold": "On-Hold", "PlanToWatch": "Plan to Watch"}


def export_date(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit("0000-00-00"))


def export_status(c: Column) -> Column:
    out = c
    for name, label in STATUS.items():
        out = F.when(c == name, label).otherwise(out)
    return out


def export_rows(pairs: DataFrame, source: DataFrame) -> DataFrame:
    """(pair_pos, the fields) for pairs (pair_pos, source_id, catalog_id); a pair without its row is an error."""
    own = source.select(
        F.col("id").cast("long").alias("source_id"), F.coalesce("watched_episodes", F.lit(0)).alias("w"), "finish_date",
        F.coalesce("score", F.lit(0)).alias("s"), "watch_status", F.coalesce("note", F.lit("")).alias("n"), F.lit(True).alias("there"),
    )
    rows = pairs.join(own, "source_id", "left")
    known = F.when(F.col("there"), F.col("catalog_id")).otherwise(F.raise_error(F.concat(F.lit("no row for id "), F.col("source_id").cast("string"))))
    return rows.select(
        "pair_pos", known.cast("long").alias("series_animedb_id"), F.col("w").alias("my_watched_episodes"), F.lit("0000-00-00").alias("my_start_date"), export_date(F.col("finish_date")).alias("my_finish_date"),
        F.col("s").alias("my_score"), export_status(F.col("watch_status")).alias("my_status"), F.col("n").alias("my_comments"), F.lit(1).alias("update_on_import"),
    )


def missing(pairs: DataFrame, source: DataFrame) -> DataFrame:
    """Pairs whose row the list doesn't have."""
    return pairs.join(source.select(F.col("id").cast("long").alias("source_id")), "source_id", "left_anti")


def escaped(c: Column) -> Column:
    out = c.cast("string")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def xml_lines(rows: DataFrame) -> DataFrame:
    """(pair_pos, xml): one element for each row."""
    parts = [F.concat(F.lit(f"<{f}>"), escaped(F.col(f)), F.lit(f"</{f}>")) for f in FIELDS]
    return rows.select("pair_pos", F.concat(F.lit("<anime>"), *parts, F.lit("</anime>")).alias("xml"))


def write_atomically(path: str, parts: Iterable[str]) -> None:
    """All or nothing: a file beside the target, flushed to disk, then moved there."""
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            for part in parts:
                f.write(part)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


def export_xml(pairs: DataFrame, source: DataFrame, path: str) -> int:
    """Write the file in the pairs' order; nothing is written if a pair has no row. Rows reach the driver a partition at a time."""
    lost = missing(pairs, source).limit(1).collect()
    if lost:
        raise OutOfIndex("a pair has no row", source_id=lost[0]["source_id"])
    lines = xml_lines(export_rows(pairs, source)).orderBy("pair_pos").select("xml")
    count = 0

    def parts() -> Iterator[str]:
        nonlocal count
        yield f'<?xml version="1.0" encoding="UTF-8"?>\n{OPEN}{INFO}'
        for row in lines.toLocalIterator(prefetchPartitions=True):
            count += 1
            yield row[0]
        yield CLOSE

    write_atomically(path, parts())
    return count


def write_sidecar(path: str, release: str, sha256: str, size: int) -> None:
    write_atomically(path, [json.dumps({"release": release, "sha256": sha256, "compressed_size": size})])


def read_sidecar(path: str) -> dict | None:
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except (OSError, ValueError):
        return None


def in_batches(rows: DataFrame, size: int = 500) -> Iterator[list[Row]]:
    """Rows in their order, a batch at a time."""
    held: list[Row] = []
    for row in rows.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def save_review(path: str, list_key: str, overrides: dict[int, int], ignored: Iterable[int]) -> None:
    """One JSON file of all lists; a list with nothing to say is taken out."""
    every = read_sidecar(path) or {}
    ignored = sorted(ignored)
    if overrides or ignored:
        every[list_key] = {"overrides": {str(k): str(v) for k, v in overrides.items()}, "ignoredEntryIds": {str(k): True for k in ignored}}
    else:
        every.pop(list_key, None)
    write_atomically(path, [json.dumps(every)])


def load_review(path: str, list_key: str) -> tuple[dict[int, int], set[int]]:
    """Overrides and ignored ids, invalid ones left out; a bare map of overrides is understood too."""
    own = (read_sidecar(path) or {}).get(list_key) or {}
    number = lambda x: int(x) if isinstance(x, int | str) and not isinstance(x, bool) and str(x).isdigit() else None
    raw = own.get("overrides") if isinstance(own.get("overrides"), dict) else {k: v for k, v in own.items() if k not in ("overrides", "ignoredEntryIds")}
    overrides = {a: b for k, v in raw.items() if (a := number(k)) is not None and (b := number(v)) is not None}
    ignored = {a for k, v in (own.get("ignoredEntryIds") or {}).items() if v and (a := number(k)) is not None}
    return overrides, ignored
