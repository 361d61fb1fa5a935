"""Names under which the functions can be used from SQL text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.types import ArrayType, DoubleType

from covarium.functions.hashing import fnv_bucket_py, ngram_buckets_udf
from covarium.session import ship


def ngrams_udtf(minn: int, maxn: int, buckets: int):
    """ngrams(token): a row for each n-gram of `<token>` by characters, with its place and bucket; a null token has none."""

    class Ngrams:
        def eval(self, token: str) -> Iterator[tuple]:
            if token is not None:
                text = f"<{token}>"
                for n in range(minn, maxn + 1):
                    for i in range(len(text) - n + 1):
                        yield n, i, text[i : i + n], fnv_bucket_py(text[i : i + n].encode(), buckets)

    return udtf(Ngrams, returnType="n int, at int, gram string, bucket bigint")


@pandas_udf(ArrayType(DoubleType()))
def vec_mean(vectors: pd.Series) -> list[float]:
    """Mean of a group's vectors of one length, nulls left out. A group is one task's; `compose.sum_vectors` combines before the shuffle and is the form for groups of any size."""
    some = [v for v in vectors if v is not None]
    return np.mean(np.stack(some).astype(float), axis=0).tolist() if some else None


def register(spark: SparkSession, minn: int = 3, maxn: int = 8, buckets: int = 2_000_000) -> list[str]:
    """SQL functions for this session: ngram_buckets (Arrow), ngrams (a table function), vec_mean (an aggregate), and the rest as SQL expressions."""
    ship(spark)
    spark.udf.register("ngram_buckets", ngram_buckets_udf(minn, maxn, buckets))
    spark.udtf.register("ngrams", ngrams_udtf(minn, maxn, buckets))
    spark.udf.register("vec_mean", vec_mean)
    bodies = {
        "vec_dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)",
        "vec_norm(a ARRAY<DOUBLE>) RETURNS DOUBLE": "sqrt(aggregate(a, 0D, (s, x) -> s + x * x))",
        "corpus_tokens(t STRING) RETURNS ARRAY<STRING>": r"filter(split(t, '\\s+'), x -> x <> '')",
        "corpus_groups(t STRING) RETURNS ARRAY<STRING>": r"split(t, ' \\|\\|\\| ', -1)",
        "portable_int(k STRING) RETURNS BIGINT": "cast(conv(substr(md5(k), 1, 8), 16, 10) AS BIGINT)",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return ["ngram_buckets", "ngrams", "vec_mean", *[h.partition("(")[0] for h in bodies]]
