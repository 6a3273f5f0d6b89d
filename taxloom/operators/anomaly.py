"""Unusual invoices: leave-one-out statistics by rank, rule scores, features, robust z and an isolation forest."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FEATURES = ("log_amount", "tax_ratio", "deviation", "prior_30d", "log_gap", "n_lines", "round_amount", "sunday", "bad_rate", "odd_rates")
#: Scores of an invoice, and the earlier invoices of its vendor from which on its history says something.
SCORES, LEAST_HISTORY = ("robust_z", "forest_score"), 5
#: GST rates in per cent; ``odd_rates`` is the share of lines at others.
STANDARD = (0, 0.1, 0.25, 1, 1.5, 3, 5, 6, 7.5, 12, 18, 28, 40)


def loo_median(df: DataFrame, keys: list[str], value: str, row: str, out: str) -> DataFrame:
    """``df`` (no nulls in ``value``) with the median of the group's other rows.

    The median of the others is made of at most four central order statistics of the group, found by a rank and one aggregate, so
    no group is collected; groups of one row get null.
    """
    w = Window.partitionBy(*keys)
    ranked = df.withColumn("_r", F.row_number().over(w.orderBy(value, row)))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    lo, hi = F.floor(F.col("_n") / 2), F.ceil(F.col("_n") / 2)  # of _n - 1 others: places floor and ceil of _n / 2
    at = lambda place: F.max(F.when(F.col("_r") == place, F.col(value)))
    middle = ranked.join(sizes, keys).groupBy(*keys).agg(F.max("_n").alias("_n"), at(lo).alias("_a"), at(lo + 1).alias("_b"), at(hi).alias("_c"), at(hi + 1).alias("_d"))
    pick = lambda place, x, y: F.when(place < F.col("_r"), F.col(x)).otherwise(F.col(y))
    both = ranked.join(middle, keys)
    return both.withColumn(out, F.when(F.col("_n") > 1, (pick(lo, "_a", "_b") + pick(hi, "_c", "_d")) / 2)).drop("_r", "_n", "_a", "_b", "_c", "_d")


def loo_robust_z(df: DataFrame, key: str, value: str, row: str) -> DataFrame:
    """(row, median, z) against the group's other rows: at least four others.  z is the distance from their median in robust deviations; where half of
    them are equal, in their standard deviation; null if all are."""
    with_median = loo_median(df.select(key, row, value), [key], value, row, "median").where("median is not null")
    centres = with_median.select(key, "median").distinct()  # three at most for a group
    off = df.select(key, row, value).join(centres, key).withColumn("dev", F.abs(F.col(value) - F.col("median")))
    spread = loo_median(off, [key, "median"], "dev", row, "mad").select(key, "median", row, "mad")
    # moments of the others: the group's without the row, about the group's mean so that nothing large is subtracted
    sums = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("var"))
    rows = with_median.join(spread, [key, "median", row]).join(sums, key).where("n >= 5")
    off_mean, others = F.col(value) - F.col("mean"), F.col("n") - 1
    variance = (F.col("n") * F.col("var") - off_mean * off_mean * F.col("n") / others) / others
    # all others are equal only if their variance is nothing beside their size
    sd = F.when(variance > 1e-12 * F.greatest(F.lit(1.0), F.col("mean") * F.col("mean")), F.sqrt(variance))
    z = F.abs(F.col(value) - F.col("median")) / F.when(F.col("mad") > 0, 1.4826 * F.col("mad")).otherwise(sd)
    return rows.select(row, "median", z.alias("z"))


def price_deviation(lines: DataFrame, least: float = 0.3) -> DataFrame:
    """(invoice_id, line_no, price, median) of lines (vendor, item, invoice_id, line_no, price) whose price is at least ``least`` off the median of
    the vendor's other invoices for the item; items with at least three lines.

    The median without one row comes from ranks; only invoices that bill an item on several lines meet the item's other rows."""
    group = ["vendor", "item"]
    rows = lines.where("price <> 0 and item is not null").withColumn("row", F.struct("invoice_id", "line_no"))
    many = rows.join(rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).where("n >= 3"), group)
    own = many.withColumn("own", F.count(F.lit(1)).over(Window.partitionBy(*group, "invoice_id")))
    one = loo_median(many.select(*group, "row", "price"), group, "price", "row", "median").join(own.where("own = 1").select("row"), "row")
    several = own.where("own > 1").select(*group, "row", "price", "invoice_id")
    others = many.select(*group, F.col("invoice_id").alias("other"), F.col("price").alias("their"))
    met = several.join(others, group).where("invoice_id <> other").groupBy("row", "price").agg(F.percentile("their", 0.5).alias("median"))
    found = one.select("row", "price", "median").union(met.select("row", "price", "median"))
    return found.where((F.col("median") != 0) & (F.abs(F.col("price") - F.col("median")) / F.col("median") >= least)).select("row.invoice_id", "row.line_no", "price", "median")


def odd_rates(lines: DataFrame) -> DataFrame:
    """(invoice_id, odd_rates): the share of an invoice's lines with a rate whose rate isn't a standard one."""
    rate = F.col("gst_rate").cast("double")
    return lines.where("gst_rate is not null").groupBy("invoice_id").agg(F.avg((~rate.isin(*map(float, STANDARD))).cast("double")).alias("odd_rates"))


def features(invoices: DataFrame) -> DataFrame:
    """``invoices`` carry their ``odd_rates``, ``has_error`` and ``deviation`` from the vendor's earlier amounts.  One row of ``FEATURES`` per invoice, and ``history``, how many earlier ones its vendor has; only strictly earlier invoices of the vendor count.  Null is unknown."""
    order = Window.partitionBy("vendor_id").orderBy("on_day", "created_on", "invoice_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    days = Window.partitionBy("vendor_id").orderBy(F.datediff("on_day", F.lit("1970-01-01"))).rangeBetween(-30, 0)
    peers = Window.partitionBy("vendor_id", "on_day").orderBy("created_on", "invoice_id").rowsBetween(0, Window.unboundedFollowing)
    rows = invoices.withColumn("on_day", F.coalesce("invoice_date", "created_on"))
    amount = F.when(F.col("grand_total") != 0, F.col("grand_total").cast("double"))
    one = F.lit(1)
    return rows.select(
        "invoice_id", "vendor_id", F.log1p(amount).alias("log_amount"), F.when(F.col("subtotal") > 0, F.col("total_tax").cast("double") / F.col("subtotal").cast("double")).alias("tax_ratio"),
        (F.count(one).over(days) - F.count(one).over(peers)).cast("double").alias("prior_30d"), F.log1p(F.datediff("on_day", F.lag("on_day").over(order))).alias("log_gap"),
        F.nullif(F.col("n_lines").cast("double"), F.lit(0.0)).alias("n_lines"), F.when((amount >= 10000) & (amount % 1000 == 0), 1.0).otherwise(0.0).alias("round_amount"),
        F.when(F.dayofweek("invoice_date") == 1, 1.0).otherwise(0.0).alias("sunday"),
        F.when(F.count(one).over(before) >= 5, F.avg(((F.coalesce(F.col("gstr2b_status"), F.lit("")) == "MISSING_IN_2B") | F.coalesce("has_error", F.lit(False))).cast("double")).over(before)).alias("bad_rate"),
        "odd_rates", "deviation", F.count(one).over(before).alias("history"),
    )


def centres(rows: DataFrame) -> dict[str, tuple[float, float]]:
    """Median and robust scale of each feature: quartile range / 1.349, else the standard deviation, else 1.  One row leaves the cluster."""
    got = rows.agg(*[x for f in FEATURES for x in (F.percentile_approx(f, [0.25, 0.5, 0.75], 10_000).alias(f), F.stddev_pop(f).alias(f"{f}_sd"))]).first()
    out = {}
    for f in FEATURES:
        q1, q2, q3 = got[f] or (0.0, 0.0, 0.0)
        out[f] = (float(q2), float((q3 - q1) / 1.349 or got[f"{f}_sd"] or 1.0))
    return out


def robust_z(rows: DataFrame, c: dict[str, tuple[float, float]]) -> DataFrame:
    filled = rows.select(*[x for x in rows.columns if x not in FEATURES], *[F.coalesce(f, F.lit(c[f][0])).alias(f) for f in FEATURES])
    return filled.withColumn("robust_z", F.greatest(*[F.abs(F.col(f) - c[f][0]) / c[f][1] for f in FEATURES]))


def path_length(n: float) -> float:
    """Mean depth of an unsuccessful search over n points."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow_forest(x: np.ndarray, trees: int = 200, take: int = 256, seed: int = 42) -> tuple[list[list[tuple]], int]:
    """Random trees of (feature, cut, left, right, depth correction); leaves have feature -1.  All nodes of a level are split at once: rows carry their node,
    a node's feature is drawn from those that vary in it, its cut between the least and the greatest value there."""
    rng = np.random.default_rng(seed)
    psi = min(take, len(x))
    levels = math.ceil(math.log2(max(psi, 2)))
    forest = []
    for _ in range(trees):
        sub = x[rng.choice(len(x), psi, replace=False)]
        node, tree, first = np.zeros(psi, np.int64), [], 0
        for depth in range(levels + 1):
            n = int(node.max(initial=-1)) + 1
            lo, hi = np.full((n, x.shape[1]), np.inf), np.full((n, x.shape[1]), -np.inf)
            live = np.flatnonzero(node >= 0)
            np.minimum.at(lo, node[live], sub[live])
            np.maximum.at(hi, node[live], sub[live])
            size = np.bincount(node[live], minlength=n)
            splits = (hi > lo).any(axis=1) & (depth < levels)
            f = np.where(hi > lo, rng.random(lo.shape), -1.0).argmax(axis=1)
            cut = rng.uniform(lo[np.arange(n), f], hi[np.arange(n), f])
            child = first + n + 2 * (np.cumsum(splits) - 1)
            tree += [(int(f[i]), float(cut[i]), int(child[i]), int(child[i]) + 1, 0.0) if splits[i] else (-1, 0.0, -1, -1, depth + path_length(int(size[i]))) for i in range(n)]
            if not splits.any():
                break
            inside = live[splits[node[live]]]
            right = sub[inside, f[node[inside]]] >= cut[node[inside]]
            after = np.full(psi, -1)
            after[inside] = child[node[inside]] + right - first - n
            node, first = after, first + n
        forest.append(tree)
    return forest, psi


def forest_score(rows: DataFrame, forest: list[list[tuple]], psi: int) -> DataFrame:
    """``rows`` with ``forest_score``: 2^(-mean depth / expected depth), all rows of a batch going down a tree together."""
    packed = [tuple(np.array(c) for c in zip(*t, strict=True)) for t in forest]

    def score(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(float) for c in cols])
        total = np.zeros(len(x))
        for feature, cut, left, right, depth in packed:
            at = np.zeros(len(x), np.int64)
            while (open_ := feature[at] >= 0).any():
                i = np.flatnonzero(open_)
                here = at[i]
                at[i] = np.where(x[i, feature[here]] < cut[here], left[here], right[here])
            total += depth[at]
        norm = path_length(psi)
        return pd.Series(2.0 ** (-total / len(packed) / norm) if norm else np.full(len(x), 0.5))

    return rows.withColumn("forest_score", F.pandas_udf(score, "double")(*FEATURES))


class Model(NamedTuple):
    """What scoring needs, all of bounded size: centres and scales, the forest, and thousandths of both scores over the rows it was fitted on."""

    centres: dict[str, tuple[float, float]]
    forest: list[list[tuple]]
    psi: int
    thousandths: dict[str, list[float]]
    trained_on: int


def fit(rows: DataFrame, sample: int = 20_000) -> Model | None:
    """The model of ``rows`` of features (a written table); the forest is grown on at most about ``sample`` of them by a hash of the id.  None without rows."""
    c, n = centres(rows), rows.count()
    filled = robust_z(rows, c)
    some = filled.where(F.pmod(F.xxhash64("invoice_id"), F.lit(1_000_000)) < 1_000_000 * min(1.0, sample / max(n, 1))).select("invoice_id", *FEATURES).orderBy("invoice_id").toPandas()
    if some.empty:
        return None
    forest, psi = grow_forest(some[list(FEATURES)].to_numpy(float))
    parts = [i / 1000 for i in range(1, 1001)]
    got = forest_score(filled, forest, psi).agg(*[F.percentile_approx(s, parts, 10_000).alias(s) for s in SCORES]).first()
    return Model(c, forest, psi, {s: list(got[s]) for s in SCORES}, n)


def ensemble(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` of features, of a batch or a stream, with both scores, ``rank_pct`` (the higher of their percentiles among the rows of the model, in tenths),
    ``priority`` and ``sufficiency``, which says whether vendor and model have seen enough."""
    scored = forest_score(robust_z(rows, model.centres), model.forest, model.psi)

    def rank(*scores: pd.Series) -> pd.Series:
        ranks = [np.searchsorted(model.thousandths[s], x.to_numpy(float), side="right") for s, x in zip(SCORES, scores, strict=True)]
        return pd.Series(np.maximum(*ranks) / 10.0)

    enough = F.when((F.col("history") >= LEAST_HISTORY) & F.lit(model.trained_on >= 50), "sufficient").when(F.lit(model.trained_on >= 20), "limited").otherwise("insufficient")
    ranked = scored.withColumn("rank_pct", F.pandas_udf(rank, "double")(*SCORES))
    return ranked.withColumn("priority", F.when(F.col("rank_pct") >= 98, "high").when(F.col("rank_pct") >= 93, "medium").otherwise("low")).withColumn("sufficiency", enough)


def detect(rows: DataFrame, sample: int = 20_000) -> DataFrame:
    """(invoice_id, robust_z, forest_score, rank_pct, priority, sufficiency) of ``rows`` of features (a written table), by the model of these rows."""
    model = fit(rows, sample)
    if model is None:
        return rows.sparkSession.createDataFrame([], "invoice_id long, robust_z double, forest_score double, rank_pct double, priority string, sufficiency string")
    got = ensemble(rows, model)
    return got.select("invoice_id", *[F.round(s, 6).alias(s) for s in SCORES], "rank_pct", "priority", "sufficiency")


def signals(rows: DataFrame, most: int = 5) -> DataFrame:
    """(invoice_id, feature, value, typical, direction, strength): of each invoice the ``most`` features that are 1.5 quartile ranges or more off their median, and round amounts
    and Sundays where those aren't usual; strongest first."""
    got = rows.agg(*[F.percentile_approx(f, [0.25, 0.5, 0.75], 10_000).alias(f) for f in FEATURES]).first()
    each = []
    for f in FEATURES:
        q1, q2, q3 = got[f] or (0.0, 0.0, 0.0)
        z = (F.col(f) - q2) / ((q3 - q1) or 1e-6)
        flag = (F.col(f) == 1.0) & F.lit(q2 == 0) if f in ("round_amount", "sunday") else F.lit(False)
        said = F.struct(F.round(F.abs(z), 2).alias("strength"), F.lit(f).alias("feature"), F.round(f, 3).alias("value"), F.lit(round(float(q2), 3)).alias("typical"), F.when(z > 0, "higher").otherwise("lower").alias("direction"))
        each.append(F.when(F.col(f).isNotNull() & ((F.abs(z) >= 1.5) | flag), said))
    best = F.slice(F.reverse(F.array_sort(F.array_compact(F.array(*each)))), 1, most)
    return rows.select("invoice_id", F.explode(best).alias("s")).select("invoice_id", "s.feature", "s.value", "s.typical", "s.direction", "s.strength")
