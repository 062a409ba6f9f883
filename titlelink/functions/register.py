"""The text functions under names for SQL users."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text, titles


def register(spark: SparkSession) -> None:
    """normalize_title(text), title_metadata(normalised title), and the table function trigrams(text) with a row (pos, gram) each."""

    @F.pandas_udf(T.StringType())
    def normalize_title(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda t: None if t is None else text.normalized(t))

    @F.udtf(returnType="pos int, gram string")
    class Trigrams:
        def eval(self, value: str):
            if value is not None:
                padded = f"^^{value}$$"
                yield from enumerate(dict.fromkeys(padded[k : k + 3] for k in range(len(padded) - 2)))

    spark.udf.register("normalize_title", normalize_title)
    spark.udf.register("title_metadata", titles.parse_udf)
    spark.udtf.register("trigrams", Trigrams)
