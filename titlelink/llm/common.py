"""Pieces that the training-data operators share: shared scratch tables, table reading, Arrow text access."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Java form of a word: a run of anything but space, tab, newline, vertical tab, form feed, carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Rows that one Python step handles at a time, whatever the size of the Arrow batch.
SLICE_ROWS = 256


def scratch_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only a local session that names none gets one of its own."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="titlelink-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def _scratch_root(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/titlelink/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that this application's operators wrote for themselves: DataFrames that they returned can't be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, and a lost executor costs no recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(col: str = "text") -> Column:
    """Text as UTF-8 bytes, null as empty: Python then needs no decoding."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def id_hash(col: str = "doc_id") -> Column:
    """crc32 of the id written as text, as the fold rules define it; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def crc_mod(doc_id, modulus: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


def give_back() -> None:
    """Return what an earlier task of this worker has freed to the system: workers live on, and share their machine's memory.

    A large block is mapped on its own (a fixed threshold, which otherwise rises with use), so that freeing it returns it at once.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 20)
        libc.mallopt(-1, 1 << 20)
        libc.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Small slices of the batches, so that Python holds few rows at once."""
    give_back()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
    give_back()


#: Bytes of text that numpy handles at a time.
RUN_BYTES = 1 << 19
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def in_pieces(text: bytes, most: int = RUN_BYTES) -> list[bytes]:
    """The text cut at white space into pieces of about `most` bytes; a longer word stays whole."""
    if len(text) <= most:
        return [text]
    out, at = [], 0
    while len(text) - at > most:
        found = _SPACE.search(text, at + most)
        if not found:
            break
        out.append(text[at : found.start()])
        at = found.end()
    return [*out, text[at:]]


def runs(texts: list[bytes], most: int = RUN_BYTES) -> Iterator[tuple[list[int], list[bytes]]]:
    """(numbers of the texts, their pieces), about `most` bytes at a time, in order; a long text has pieces in several runs."""
    owners: list[int] = []
    held: list[bytes] = []
    size = 0
    for k, text in enumerate(texts):
        for piece in in_pieces(text, most):
            if held and size + len(piece) > most:
                yield owners, held
                owners, held, size = [], [], 0
            owners.append(k)
            held.append(piece)
            size += len(piece)
    if held:
        yield owners, held


class Recent(dict):
    """Computed values by key, in two generations: what is used stays, what isn't goes; both hold about `size` bytes at most."""

    #: Bytes of an entry besides those of its key and value.
    ENTRY = 150

    def __init__(self, compute, size: int):
        super().__init__()
        self.compute, self.half, self.held, self.old = compute, size // 2, 0, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= 40:
            if self.held >= self.half:
                self.old = dict(self)
                self.clear()
                self.held = 0
            self[key] = value
            self.held += self.ENTRY + len(key) + len(value)
        return value


#: The marks before and after a word; these bytes within texts count as another.
_MARKS = bytes.maketrans(b"\x02\x03", b"\x01\x01")


def word_grams(texts: list[bytes], lengths: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashed byte n-grams of the texts' words between an opening and a closing mark, for each length: the buckets (of 2**bits), and where
    each text's begin, with the end."""
    words = [b"\x03\x02".join(t.translate(_MARKS).split()) for t in texts]
    starts = np.append(0, np.cumsum([len(w) + 2 if w else 0 for w in words]))
    buffer = np.frombuffer(b"".join(b"\x02%b\x03" % w for w in words if w), np.uint8)
    ends = np.flatnonzero(buffer == 3) + 1
    # Bytes from each place to the end of its word.
    room = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(buffer))
    wide = buffer.astype(np.uint32)
    code = np.full(len(buffer) + 1, 0x811C9DC5, np.uint32)
    for n in range(1, max(lengths) + 1):
        code = code[: len(buffer) - n + 1] ^ wide[n - 1 :]
        code *= np.uint32(0x01000193)
        if n in lengths:
            at = np.flatnonzero(room[: len(code)] >= n)
            mixed = code[at]
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0x9E3779B1)
            yield (mixed >> np.uint32(32 - bits)).astype(np.int32), np.searchsorted(at, starts)


def sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of the values between the cuts."""
    total = np.append(0.0, np.cumsum(values, dtype=np.float64))
    return total[cuts[1:]] - total[cuts[:-1]]


def with_labels(docs: DataFrame, labels: DataFrame, most: int = 500_000, how: str = "left") -> DataFrame:
    """docs joined to labels on doc_id; the labels are broadcast only if counted to be at most `most` rows."""
    few = labels.limit(most + 1).count() <= most
    return docs.join(F.broadcast(labels) if few else labels, "doc_id", how)


def sample_ids(rows: DataFrame, label: str, sample: int) -> DataFrame:
    """(doc_id, label): about `sample` ids at most, shared evenly among the labels, at least one for each: those with the least hashes.

    A label's distinct ids are counted roughly, and a hash bound lets some more than its share pass, so that only few rows are shuffled
    and ranked however many rows a label or an id has.
    """
    hashed = rows.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select("doc_id", label).withColumn("h", F.xxhash64(F.lit("sample"), F.col("doc_id")))
    counts = hashed.groupBy(label).agg(F.approx_count_distinct("h").alias("n")).collect()  # a row for each label, as the model has
    share = -(-sample // max(1, len(counts)))
    bounds = rows.sparkSession.createDataFrame(
        [(r[0], int(min(1.0, (2 * share + 100) / max(1, r.n)) * (1 << 30))) for r in counts],
        f"_label {rows.schema[label].dataType.simpleString()}, _most long",
    )
    few = hashed.join(F.broadcast(bounds), F.col(label) == F.col("_label")).where(F.pmod("h", F.lit(1 << 30)) <= F.col("_most")).select("doc_id", label, "h").distinct()
    return few.withColumn("k", F.row_number().over(Window.partitionBy(label).orderBy("h", "doc_id"))).where(F.col("k") <= share).select("doc_id", label)


def one_each(rows: DataFrame) -> DataFrame:
    """One row of each doc_id: that with the least text (by hash, then itself) and least other columns, whichever rows repeat the id."""
    rest = [c for c in rows.columns if c not in ("doc_id", "text")]
    return rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("_h"), "text", *rest)).alias("_r")).select("doc_id", "_r.text", *[f"_r.{c}" for c in rest])
