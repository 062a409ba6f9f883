"""Operator 6: mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only.

Each source's documents, shuffled by a hash, are laid end to end as a stream of words that repeats. The mix is a sequence of
slots of equal length. Slot s has the point s * g mod 2**31 of the golden-ratio sequence (g odd, about 2**31 over the golden ratio);
the point falls into one source's range of the cumulative targets, and the slot's rank among the source's slots names the block of
the stream that it gets. A source has as many slots as fill its target: ranks beyond are passed over, ranks that the schedule
has not reached follow at its end, and the last slot is cut to the target. A document is taken for as many words as slots cover.

Targets: sources by code point, null last, weigh 5, 2, 1 in turn and share all words; a target stops at `most` times its source's
size, and the excess is shared again by weight until no target is above.

No step needs a source's rows in one task: a stream's offsets are sums over hash buckets plus a running sum in each bucket, and ranks are
counts over chunks of slots plus a running number in each chunk. Only the sums meet: one for 100,000 documents, and one for 4,096 slots (a
million words) of a source. The driver holds one row for each source, as the targets depend on all of them.

Nulls and edge cases: a null or empty text, or one without words, has size 0 and is taken for 0 words; a null source is a source; a null
doc_id is a document; rows that repeat each count and give a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, materialise, table

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK_WORDS = 256
POINTS = 1 << 31
#: Odd, and the nearest to 2**31 divided by the golden ratio.
STEP = 1327217885
CELL = 1 << 19
#: The fewest buckets of a stream, and the rows of one beyond that.
BUCKETS, BUCKET_ROWS = 1024, 100_000
CHUNK = 1 << 12


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> list[float]:
    """The target of each source, given in order: shares by weight, held to `most` times the size, the excess shared again."""
    weight = [weights[k % len(weights)] for k in range(len(sizes))]
    left, open_, out = float(sum(n for _, n in sizes)), list(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        whole = sum(weight[k] for k in open_)
        over = [k for k in open_ if left * weight[k] / whole > most * sizes[k][1]]
        if not over:
            for k in open_:
                out[k] = left * weight[k] / whole
            break
        for k in over:
            out[k] = float(most * sizes[k][1])
        left -= sum(out[k] for k in over)
        open_ = [k for k in open_ if k not in set(over)]
    return out


def _slots(spark: SparkSession, plan: list[tuple[int, int, int, int]], block: int) -> DataFrame:
    """(src, slot, rank) of the schedule, for a plan of (src, size, words, slots)."""
    total = sum(p[3] for p in plan)
    words = sum(p[2] for p in plan)
    ranges, at = [], 0
    for src, _, n, _ in plan:
        low, at = at, at + n
        a, b = low * POINTS // words, at * POINTS // words
        ranges += [(src, a, b, cell) for cell in range(a // CELL, (b - 1) // CELL + 1)] if b > a else []
    # A row for each source and each of 4096 cells, besides one more for each source.
    cells = F.broadcast(spark.createDataFrame(ranges, "src int, low long, high long, cell long"))
    points = spark.range(total).select(F.col("id").alias("slot"), F.pmod(F.pmod("id", F.lit(POINTS)) * F.lit(STEP), F.lit(POINTS)).alias("point"))
    drawn = points.withColumn("cell", F.expr(f"point div {CELL}")).join(cells, "cell").where("point >= low and point < high").select(
        "src", "slot", F.expr(f"slot div {CHUNK}").alias("chunk"),
    )
    before = drawn.groupBy("src", "chunk").agg(F.count("*").alias("n"))
    before = before.select("src", "chunk", (F.sum("n").over(Window.partitionBy("src").orderBy("chunk")) - F.col("n")).alias("before"))
    ranked = drawn.join(before, ["src", "chunk"]).select(
        "src", "slot", (F.col("before") + F.row_number().over(Window.partitionBy("src", "chunk").orderBy("slot")) - 1).alias("rank"),
    )
    quota = F.broadcast(spark.createDataFrame([(p[0], p[3]) for p in plan], "src int, slots long"))
    ranked = ranked.join(quota, "src").where("rank < slots").drop("slots")
    reached = ranked.groupBy("src").agg(F.count("*").alias("n"))
    late = quota.join(reached, "src", "left").select(
        "src", F.explode(F.sequence(F.coalesce("n", F.lit(0)), F.col("slots") - 1)).alias("rank"), F.coalesce("n", F.lit(0)).alias("n"), "slots",
    ) if plan else None
    late = late.where("n < slots").select("src", (F.lit(total) + F.col("rank")).alias("slot"), "rank")
    return ranked.unionByName(late.select("src", "slot", F.col("rank").cast("long").alias("rank")))


def schedule(docs: DataFrame, block: int = BLOCK_WORDS, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> tuple[DataFrame, DataFrame | None]:
    """The documents laid out (doc_id, src, size, source_size, target, low: start in the source's stream), and the mix: one row
    (src, slot, low, words) for each piece of a document that a slot takes, in slot order. No mix if there are no words."""
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    sized = materialise(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64("text").alias("th")),
        "sizes",
    )
    counted = sized.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect()
    sizes = sorted(((r.source, r.n) for r in counted), key=lambda r: (r[0] is None, r[0] or ""))
    buckets = max(BUCKETS, sum(r.rows for r in counted) // BUCKET_ROWS)
    goals = targets(sizes, weights, most)
    facts = spark.createDataFrame([(k, s, n, g) for k, ((s, n), g) in enumerate(zip(sizes, goals, strict=True))], "src int, source string, source_size long, target double")
    placed = sized.join(F.broadcast(facts), sized["source"].eqNullSafe(facts["source"])).select("doc_id", "th", "size", "src", "source_size", "target")
    placed = placed.withColumn("h", F.xxhash64("doc_id", "th", F.lit(11))).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    sums = placed.groupBy("src", "bucket").agg(F.sum("size").alias("n"))
    sums = sums.select("src", "bucket", (F.sum("n").over(Window.partitionBy("src").orderBy("bucket")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("src", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = placed.join(sums, ["src", "bucket"]).withColumn("low", F.col("before") + F.sum("size").over(inside) - F.col("size"))
    laid = materialise(laid.select("doc_id", "th", "src", "size", "source_size", "target", "low"), "streams")
    plan = [(k, n, w, -(-w // block)) for k, ((_, n), g) in enumerate(zip(sizes, goals, strict=True)) if (w := math.floor(g + 0.5)) > 0]
    if not plan:
        return laid, None
    quota = F.broadcast(spark.createDataFrame([(p[0], p[1], p[2]) for p in plan], "src int, stream long, goal long"))
    slots = _slots(spark, plan, block).join(quota, "src").withColumn("a", F.col("rank") * block).withColumn("b", F.least(F.col("a") + block, "goal"))
    turns = slots.withColumn("turn", F.explode(F.expr("sequence(a div stream, (b - 1) div stream)")))
    pieces = turns.select("src", "slot", "turn", F.expr("greatest(a - turn * stream, 0)").alias("p"), F.expr("least(b - turn * stream, stream)").alias("q"))
    pieces = pieces.withColumn("cell", F.explode(F.expr(f"sequence(p div {block}, (q - 1) div {block})")))
    parts = laid.where("size > 0").select("src", "low", "size", F.explode(F.expr(f"sequence(low div {block}, (low + size - 1) div {block})")).alias("cell"))
    start, stop = F.greatest("p", "low", F.col("cell") * block), F.least("q", F.col("low") + F.col("size"), (F.col("cell") + 1) * block)
    return laid, pieces.join(parts, ["src", "cell"]).select("src", "slot", "turn", "low", (stop - start).alias("words")).where("words > 0")


def mix(docs: DataFrame, block: int = BLOCK_WORDS, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Per document: doc_id, th (hash of the text), size, source_size, target, taken."""
    laid, taken = schedule(docs, block, weights, most)
    if taken is None:
        return laid.select("doc_id", "th", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    sums = taken.groupBy("src", "low").agg(F.sum("words").alias("taken"))
    # A document with words is known by its place in its source's stream.
    out = laid.withColumn("key", F.when(F.col("size") > 0, F.col("low"))).join(sums.withColumnRenamed("low", "key"), ["src", "key"], "left")
    return out.select("doc_id", "th", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def remake(docs: DataFrame, length: str = "n_chars", **options) -> DataFrame:
    """The mixed documents, with the columns of docs: one row for each time that a document is taken whole, and one with its first
    words (joined by spaces; the column `length`, if there, then counts them) where its source's last slot ends inside it. Rows
    alike in id and text count once."""
    key = docs.withColumn("_th", F.xxhash64("text")).dropDuplicates(["doc_id", "_th"])
    taken = mix(key.drop("_th"), **options).where("taken > 0").select(
        F.col("doc_id").alias("_id"), F.col("th").alias("_h"), F.col("size").alias("_size"), F.col("taken").alias("_taken"),
    )
    rows = key.join(taken, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_h")))
    words = F.slice(F.regexp_extract_all("text", F.lit(WORD_PATTERN), F.lit(0)), 1, F.expr("cast(_taken % _size as int)"))
    turns = rows.withColumn("_turn", F.explode(F.expr("sequence(1, cast(ceil(_taken / _size) as int))")))
    part = F.col("_turn") * F.col("_size") > F.col("_taken")
    new = {"text": F.array_join(words, " ")} | ({length: F.length(F.array_join(words, " ")).cast(docs.schema[length].dataType)} if length in docs.columns else {})
    return turns.select(*[F.when(part, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in docs.columns])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("th")
