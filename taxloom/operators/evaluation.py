"""How sure a measured accuracy is."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bootstrap(documents: DataFrame, hits: str, total: str, draws: int = 2000, seed: int = 0, most: int = 10_000) -> DataFrame:
    """(accuracy, low, high): sum of ``hits`` / sum of ``total``, and its 95 % interval over ``draws`` resamples of the documents.

    A resample's counts of documents alike in both columns are multinomial, so documents are counted by these first, and a draw costs as much for a billion
    as for ten.  More than ``most`` different pairs are refused; documents with a null are left out; without any the result is null."""
    kinds = documents.where(F.col(hits).isNotNull() & F.col(total).isNotNull()).groupBy(F.col(hits).cast("double").alias("h"), F.col(total).cast("double").alias("t")).count()
    found = kinds.orderBy("h", "t").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} different pairs of hits and totals")
    if not sum(r["count"] * r["t"] for r in found):
        return documents.sparkSession.createDataFrame([(None, None, None)], "accuracy double, low double, high double")
    h, t, n = (np.array([r[c] for r in found], float) for c in ("h", "t", "count"))

    def draw(ids: pd.Series) -> pd.Series:
        got = [np.random.default_rng([seed, i]).multinomial(int(n.sum()), n / n.sum()) for i in ids]
        return pd.Series([float(g @ h / (g @ t)) if g @ t else None for g in got], dtype="float64")

    drawn = documents.sparkSession.range(draws).select(F.pandas_udf(draw, "double")("id").alias("a"))
    return drawn.agg(F.lit(round(float(n @ h / (n @ t)), 4)).alias("accuracy"), *[F.round(F.percentile("a", p), 4).alias(name) for name, p in (("low", 0.025), ("high", 0.975))])
