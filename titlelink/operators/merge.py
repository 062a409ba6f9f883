"""Duplicate rows of a list or catalogue made one, in list order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_wins(rows: DataFrame, key: str, position: str) -> DataFrame:
    """The last row of each key, by key."""
    order = Window.partitionBy(key).orderBy(F.col(position).desc())
    return rows.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k").orderBy(key)


def by_precedence(rows: DataFrame, key: str, position: str, precedence: str, fields: list[str]) -> DataFrame:
    """A row of higher precedence than all before replaces what is there whole; any other only fills what is missing.

    So the result starts at the first row of the highest precedence, and later rows fill its gaps.
    """
    every = Window.partitionBy(key)
    top = rows.withColumn("_top", F.max(precedence).over(every))
    start = F.min(F.when(F.col(precedence) == F.col("_top"), F.col(position))).over(every)
    after = top.withColumn("_start", start).where(F.col(position) >= F.col("_start"))
    filled = [F.min_by(f, F.when(F.col(f).isNotNull(), F.col(position))).alias(f) for f in fields]
    return after.groupBy(key).agg(F.min(position).alias(position), F.max(precedence).alias(precedence), *filled).orderBy(key)


def first_then_fill(rows: DataFrame, key: str, position: str, fields: list[str]) -> DataFrame:
    """The first row of each key, its gaps filled by later ones, in list order."""
    filled = [F.min_by(f, F.when(F.col(f).isNotNull(), F.col(position))).alias(f) for f in fields]
    return rows.groupBy(key).agg(F.min(position).alias(position), *filled).orderBy(position)


def with_details(items: DataFrame, details: list[DataFrame], key: str, fields: list[str], strict: bool = False) -> DataFrame:
    """List rows with the first detail page that has them (the detail's value first, the row's own else); strict: a row without any is an error."""
    names = [f"_d{k}" for k in range(len(details))]
    out = reduce(lambda a, b: a.join(b[0].select(key, F.struct(*[c for c in b[0].columns if c != key]).alias(b[1])), key, "left"), zip(details, names, strict=True), items)
    found = F.coalesce(*[F.when(F.col(n).isNotNull(), F.lit(k)) for k, n in enumerate(names)])
    if strict:
        out = out.withColumn(key, F.when(found.isNull(), F.raise_error(F.concat(F.lit("no detail for "), F.col(key).cast("string")))).otherwise(F.col(key)))
    picked = [F.coalesce(
        *[F.when(found == k, F.col(n)[f]) for k, (d, n) in enumerate(zip(details, names, strict=True)) if f in d.columns],
        *([F.col(f)] if f in items.columns else []),
    ).alias(f) for f in fields]
    return out.select(*[c for c in items.columns if c not in fields], *picked)


def lookup(rows: DataFrame, ids: list[int], key: str) -> DataFrame:
    """Rows by a list of ids, in its order; ids without a row are left out."""
    spark = rows.sparkSession
    wanted = spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "_id long, _pos long")
    return rows.join(F.broadcast(wanted), rows[key] == F.col("_id")).orderBy("_pos").drop("_id", "_pos")


def batches(rows: DataFrame, position: str, size: int = 500, stretch: int = 100_000) -> DataFrame:
    """With batch_id: runs of `size` rows in the order of a whole-number position.

    Positions are dealt in stretches; rows are numbered inside a stretch and moved by the count of the stretches before.
    """
    parts = rows.withColumn("_s", F.floor(F.col(position) / stretch))
    counts = parts.groupBy("_s").agg(F.count("*").alias("_c"))
    before = counts.select("_s", (F.sum("_c").over(Window.orderBy("_s")) - F.col("_c")).alias("_b"))  # a row for each stretch
    numbered = parts.join(before, "_s").withColumn("_n", F.col("_b") + F.row_number().over(Window.partitionBy("_s").orderBy(position)) - 1)
    return numbered.withColumn("batch_id", F.floor(F.col("_n") / size)).drop("_s", "_b", "_n")
