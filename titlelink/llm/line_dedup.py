"""Operator 1: repeated runs of lines, by winnowing over line hashes. DataFrame functions only.

Lines with a word are a document's units. From every unit, the fewest units that hold at least `words` words form a block, whose
hash is that of its lines' hashes. Of the blocks that begin within any `window` words the one with the least hash (the last of
equals) is selected, so a repeated run of at least words + window words always has a block selected in all its occurrences.
A selected block that stood earlier (by doc_id, text hash and position) is deleted, and so is, from it outwards on both sides and without a
limit, each line that stood earlier beside the same block: the fewest lines before (or after) it that hold at least `words` words, which
lie within what is matched already. So a run is followed to its first unequal line whichever earlier text it, or a part of it, is
shared with. The earliest occurrence of a line is never deleted.

A hash that a third of all blocks share costs one row each: its occurrences are told from the earliest by place, never met in pairs.

Nulls and edge cases: a null text is empty; an empty text has one line without a word; a null doc_id is the earliest; rows alike
in id and text count as one document and get the same result; a text repeated within a document is deleted there too; empty tables
give an empty result; other columns are ignored by `repeats` and kept by `clean`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, materialise, table

WORDS = 25
WINDOW = 25
_NO_ID = -(1 << 63)


def _key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def units(docs: DataFrame) -> DataFrame:
    """(k, th, u, line, h, w, at): the units of each document in order, with the words before them."""
    lines = docs.select(_key().alias("k"), F.xxhash64(_text()).alias("th"), F.posexplode(F.split(_text(), "\n", -1)).alias("line", "s"))
    counted = lines.select("k", "th", "line", F.xxhash64("s").alias("h"), F.regexp_count("s", F.lit(WORD_PATTERN)).alias("w")).where("w > 0")
    once = counted.repartition("k", "th").groupBy("k", "th", "line").agg(F.first("h").alias("h"), F.first("w").alias("w"))
    doc = Window.partitionBy("k", "th").orderBy("line")
    return once.select("k", "th", F.row_number().over(doc).alias("u"), "line", "h", "w", (F.sum("w").over(doc) - F.col("w")).alias("at"))


def fingerprints(rows: DataFrame, words: int = WORDS, window: int = WINDOW) -> DataFrame:
    """(k, th, u, n, fh): the selected blocks, from unit u on for n units."""
    doc = Window.partitionBy("k", "th")
    block = doc.orderBy("at").rangeBetween(0, words - 1)
    blocks = rows.select("k", "th", "u", "at", F.collect_list("h").over(block).alias("hs"), F.max(F.col("at") + F.col("w")).over(doc).alias("all"))
    blocks = blocks.where(F.col("all") - F.col("at") >= words).select("k", "th", "u", "at", F.xxhash64("hs").alias("fh"), F.size("hs").alias("n"))
    least = F.min(F.struct("fh", (-F.col("u")).alias("back"), "n")).over(doc.orderBy("at").rangeBetween(0, window - 1))
    return blocks.select("k", "th", least.alias("m")).select(
        "k", "th", (-F.col("m.back")).alias("u"), F.col("m.n").alias("n"), F.col("m.fh").alias("fh"),
    ).dropDuplicates(["k", "th", "u"])


def neighbours(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """(k, th, u, kind, key): each unit with the block before it (kind 1) and with the one after it (kind 2), where they are whole."""
    doc = Window.partitionBy("k", "th")
    ends = rows.withColumn("end", F.col("at") + F.col("w"))
    ends = ends.withColumn("before", F.xxhash64(F.collect_list("h").over(doc.orderBy("end").rangeBetween(1 - words, 0))))
    ends = ends.withColumn("after", F.xxhash64(F.collect_list("h").over(doc.orderBy("at").rangeBetween(0, words - 1)))).withColumn("all", F.max("end").over(doc))
    order = doc.orderBy("at")
    ends = ends.withColumn("before", F.lag("before").over(order)).withColumn("after", F.lead("after").over(order))
    one = F.when(F.col("at") >= words, F.struct(F.lit(1).alias("kind"), F.xxhash64("before", "h").alias("key")))
    two = F.when(F.col("all") - F.col("end") >= words, F.struct(F.lit(2).alias("kind"), F.xxhash64("h", "after").alias("key")))
    return ends.select("k", "th", "u", F.explode(F.array_compact(F.array(one, two))).alias("x")).select("k", "th", "u", "x.kind", "x.key")


def repeated_lines(docs: DataFrame, words: int = WORDS, window: int = WINDOW) -> DataFrame:
    """(k, th, line, w): the lines to delete; k is doc_id, or the least long if that is null."""
    rows = materialise(units(docs), "units")
    found = materialise(fingerprints(rows, words, window), "fingerprints")
    keys = materialise(neighbours(rows, words).unionByName(found.select("k", "th", "u", F.lit(0).alias("kind"), F.col("fh").alias("key"))), "keys")
    first = keys.groupBy("kind", "key").agg(F.min(F.struct("k", "th", "u")).alias("e")).select("e.k", "e.th", "e.u", (F.col("kind") + 10).alias("kind"))
    # By place: a key that isn't the first of its kind there stood earlier.
    marks = keys.select("k", "th", "u", "kind").unionByName(first).unionByName(found.select("k", "th", "u", F.lit(-1).alias("kind"), "n"), allowMissingColumns=True)
    every = rows.select("k", "th", "u", "line", "w").unionByName(marks, allowMissingColumns=True).repartition("k", "th")
    has = lambda kind: F.coalesce(F.max(F.col("kind") == kind), F.lit(False))
    later = [(has(kind) & ~has(kind + 10)).alias(name) for kind, name in enumerate(("seed", "right", "left"))]
    at = every.groupBy("k", "th", "u").agg(F.max("line").alias("line"), F.max("w").alias("w"), F.max("n").alias("n"), *later)
    doc = Window.partitionBy("k", "th").orderBy("u")
    back, on = doc.rowsBetween(Window.unboundedPreceding, 0), doc.rowsBetween(0, Window.unboundedFollowing)
    at = at.withColumn("in", F.coalesce(F.max(F.when(F.col("seed"), F.col("u") + F.col("n"))).over(back) > F.col("u"), F.lit(False)))
    u, held = F.col("u"), F.col("in")
    right = F.max(F.when(held, u)).over(back) > F.coalesce(F.max(F.when(~held & ~F.col("right"), u)).over(back), F.lit(0))
    left = F.min(F.when(held, u)).over(on) < F.coalesce(F.min(F.when(~held & ~F.col("left"), u)).over(on), F.lit((1 << 31) - 1))
    return at.withColumn("gone", F.coalesce(right, F.lit(False)) | F.coalesce(left, F.lit(False))).where("gone").select("k", "th", "line", "w")


def repeats(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, words_removed, removed (numbers of the deleted lines, from 0)."""
    gone = repeated_lines(docs, **options).groupBy("k", "th").agg(
        F.count("*").alias("n_removed"), F.sum("w").alias("words_removed"), F.sort_array(F.collect_list("line")).alias("removed"),
    )
    every = docs.select(
        "doc_id", _key().alias("k"), F.xxhash64(_text()).alias("th"),
        (F.length(_text()) - F.length(F.replace(_text(), F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
    )
    none = F.array().cast("array<int>")
    return every.join(gone, ["k", "th"], "left").select(
        "doc_id", "n_lines", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("words_removed", F.lit(0)).cast("long").alias("words_removed"), F.coalesce("removed", none).alias("removed"),
    )


def clean(docs: DataFrame, **options) -> DataFrame:
    """The documents without the deleted lines, with all their columns."""
    gone = repeated_lines(docs, **options).groupBy("k", "th").agg(F.collect_set("line").alias("_gone")).select(F.col("k").alias("_k"), F.col("th").alias("_th"), "_gone")
    rows = docs.join(gone, (_key() == F.col("_k")) & (F.xxhash64(_text()) == F.col("_th")), "left")
    left = F.expr("array_join(filter(split(coalesce(text, ''), '\n', -1), (x, i) -> not array_contains(_gone, i)), '\n')")
    return rows.select(*[F.when(F.col("_gone").isNull(), F.col("text")).otherwise(left).alias("text") if c == "text" else F.col(c) for c in docs.columns])


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))
