"""Lists that arrive as files, matched as they come; snapshots and progress beside them.

Each micro-batch is one more part of the list: it is matched against the standing catalogue and appended under its batch id, so a batch
that runs again replaces itself.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from ..errors import Cancelled
from ..operators import match, score
from ..operators.search import Index, Options

PHASES = ("list", "details", "storing", "done")


@dataclass
class Progress:
    """Started with a total, entry by entry, storing, then done; may be cancelled between any two batches. Counts only grow."""

    tell: Callable[[str, int, int], None]
    total: int = 0
    seen: int = 0
    cancelled: bool = False

    def start(self, total: int) -> None:
        self.total, self.seen = total, 0
        self.tell(PHASES[0], 0, total)

    def entries(self, n: int = 1) -> None:
        self.check()
        self.seen += n
        self.tell(PHASES[1], self.seen, max(self.total, self.seen))

    def storing(self) -> None:
        self.check()
        self.tell(PHASES[2], self.seen, max(self.total, self.seen))

    def end(self) -> None:
        self.tell(PHASES[3], self.seen, max(self.total, self.seen))

    def cancel(self) -> None:
        self.cancelled = True

    def check(self) -> None:
        if self.cancelled:
            raise Cancelled("the fetch was cancelled", seen=self.seen, total=self.total)


def events(spark: SparkSession, out: str) -> DataFrame:
    """(batch_id, phase, entries, at): what each batch told of itself, in order of time."""
    return spark.read.parquet(f"{out}_events").orderBy("at")


def newest(seen: int, told: int) -> int:
    return max(seen, told)


def read_lists(spark: SparkSession, path: str, like: DataFrame, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def match_stream(
    rows: DataFrame, catalog: DataFrame, index: Index, out: str, checkpoint: str, as_of: int, options: Options | None = None,
    progress: Progress | None = None, once: bool = True,
) -> StreamingQuery:
    """Match what arrives; winners are made unique within a batch, and over all of it by `winners`."""

    def batch(part: DataFrame, number: int) -> None:
        if progress:
            progress.check()
        spark, n = part.sparkSession, part.count()
        told = [(number, PHASES[1], n, time.time())]
        if progress:
            progress.entries(n)
            progress.storing()
        match.match_list(part, catalog, index, options, score.STRICT, as_of).write.mode("overwrite").parquet(f"{out}/batch_id={number}")
        told += [(number, PHASES[2], n, time.time())]
        spark.createDataFrame(told, "batch_id long, phase string, entries long, at double").coalesce(1).write.mode("overwrite").parquet(f"{out}_events/part={number}")
        if progress and progress.total and progress.seen >= progress.total:
            progress.end()

    writer = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def winners(spark: SparkSession, out: str) -> DataFrame:
    """All batches' matches, each entry won once by what was searched; rows linked directly keep theirs."""
    rows = spark.read.parquet(out)
    return match.finalize(rows.where("not is_direct")).unionByName(rows.where("is_direct"))
