"""Income-tax regimes over a table of taxpayers: slabs folded from an array, capped deductions, rebate, marginal relief, cess."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slabs (upper bound, percent), standard deduction, rebate limit and most, marginal relief; fixed values.
REGIMES = {
    "new": ([(400000, 0), (800000, 5), (1200000, 10), (1600000, 15), (2000000, 20), (2400000, 25), (None, 30)], 75000, 1200000, 60000, True),
    "old": ([(250000, 0), (500000, 5), (1000000, 20), (None, 30)], 50000, 500000, 12500, False),
}
#: Most of each deduction of the old regime; fixed values.
CAPS = {"sec_80c": 150000, "sec_80d_self": 25000, "sec_80ccd_1b": 50000, "home_loan_interest": 200000, "sec_80tta": 10000}
CESS = 4


def slab_tax(income: Column, slabs: list[tuple[int | None, int]]) -> Column:
    lower, rows = 0, []
    for upper, rate in slabs:
        rows.append(F.struct(F.lit(float(lower)).alias("lo"), F.lit(float(upper) if upper else None).cast("double").alias("hi"), F.lit(rate / 100).alias("rate")))
        lower = upper
    part = lambda s: F.greatest(F.lit(0.0), F.least(income, F.coalesce(s["hi"], income)) - s["lo"]) * s["rate"]
    return F.aggregate(F.array(*rows), F.lit(0.0), lambda a, s: a + part(s))


def regime_tax(people: DataFrame, regime: str) -> DataFrame:
    """``people`` (salary, other, and the columns of ``CAPS``) with taxable, relief and tax under a regime; nulls count 0."""
    slabs, standard, limit, most, marginal = REGIMES[regime]
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in people.columns else F.lit(0.0)
    off = F.least(F.lit(float(standard)), value("salary"))
    for name, cap in CAPS.items() if regime == "old" else ():
        off = off + F.least(F.lit(float(cap)), value(name))
    out = people.withColumn("taxable", F.round(F.greatest(F.lit(0.0), value("salary") + value("other") - off), 0))
    out = out.withColumn("_slab", F.round(slab_tax(F.col("taxable"), slabs), 0))
    within = F.col("taxable") <= limit
    out = out.withColumn("relief", F.when(within, F.least("_slab", F.lit(float(most)))).otherwise(F.greatest(F.lit(0.0), F.col("_slab") - (F.col("taxable") - limit)) if marginal else F.lit(0.0)))
    after = F.col("_slab") - F.col("relief")
    return out.withColumn("tax", after + F.round(after * CESS / 100, 0)).withColumn("regime", F.lit(regime)).drop("_slab")
