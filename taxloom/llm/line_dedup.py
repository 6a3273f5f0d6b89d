"""Site-relative line dedup.

A line is boilerplate of a host when the share of that host's pages which contain it exceeds ``max_ratio``.  Pages
are counted per (host, line) with map-side partial sums, so a host that owns a third of all pages sends one count per
line and task.  The boilerplate lines of a host number at most (its mean lines per page / ``max_ratio``), whatever the
host's size, so they travel as one bounded array per host and each page is cleaned in place, without moving lines.

Cases: null text stays null and still counts as a page of its host; null is a host of its own; blank lines are never
counted nor dropped; a line repeated in a page counts once; a page that consists of boilerplate alone loses all its lines and
keeps its blank ones, or stays whole with ``keep_whole`` (where near-duplicate removal follows, which decides about copies); hosts with
fewer than ``min_pages`` pages holding a line drop nothing.  Lines are told apart by the 64-bit hash of the trimmed line.
Texts of any length are read whole, their lines one
array of a row.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxloom.llm.common import materialize

MAX_RATIO = 0.05
MIN_PAGES = 5


def _line_key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, lines): for each host the hashes of its boilerplate lines."""
    lines = pages.select(
        F.col(host).alias("host"),
        F.explode(F.array_distinct(F.transform(F.filter(F.split(F.col(text), "\n"), lambda x: F.trim(x) != ""), _line_key))).alias("line"),
    )
    counts = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    totals = pages.groupBy(F.col(host).alias("of")).agg(F.count(F.lit(1)).alias("pages"))
    over = counts.join(totals, F.col("host").eqNullSafe(F.col("of"))).where(F.col("n") > F.col("pages") * F.lit(max_ratio))
    return over.groupBy("host").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, keep_whole: bool = False) -> DataFrame:
    """``pages`` with ``text`` cleaned, and ``n_lines`` (not blank) and ``n_dropped`` added (replaced, if such columns exist)."""
    found = materialize(boilerplate(pages, host, text, max_ratio, min_pages), "boilerplate").select(F.col("host").alias("_bp_host"), F.col("lines").alias("_bp_lines"))
    kept = [c for c in pages.columns if c not in ("n_lines", "n_dropped")]
    joined = pages.select(*kept).join(found, F.col(host).eqNullSafe(F.col("_bp_host")), "left")
    rows = F.split(F.col(text), "\n")
    framed = lambda x: (F.trim(x) != "") & F.array_contains("_bp_lines", _line_key(x))
    out = joined.withColumn("_bp_keep", F.when(F.col("_bp_lines").isNotNull(), F.filter(rows, lambda x: ~framed(x))))
    full = lambda c: F.coalesce(F.size(F.filter(c, lambda x: F.trim(x) != "")), F.lit(0))
    out = out.withColumn("n_lines", F.greatest(full(rows), F.lit(0)).cast("int")).withColumn("_bp_left", full(F.col("_bp_keep")))
    cut = F.col("_bp_keep").isNotNull() & (F.col("_bp_left") < F.col("n_lines"))
    if keep_whole:
        cut &= F.col("_bp_left") > 0
    out = out.withColumn("n_dropped", F.when(cut, F.col("n_lines") - F.col("_bp_left")).otherwise(0).cast("int"))
    out = out.withColumn(text, F.when(cut, F.array_join("_bp_keep", "\n")).otherwise(F.col(text)))
    return out.select(*kept, "n_lines", "n_dropped")
