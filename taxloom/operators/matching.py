"""Register against supplier statement: candidates, one-to-one assignment, nine outcomes.

Candidates come from two equi-joins within a tax id, on the normalised number and on a band of the taxable value, so a supplier
with a third of all rows is not compared all with all.  The greedy assignment over (score descending, line, book) is the set of
edges that are best for both their ends, taken again and again: rounds of two windows, never a whole block in one task.

With a column ``period`` in both tables all return periods are reconciled in one job, each by itself; a book has a row for each period in which it is eligible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxloom.functions.similarity import number_similarity_udf
from taxloom.operators.work import Work

FUZZY, TIE = 0.80, 0.02


def normal_number(x: Column) -> Column:
    """Upper case, letters and digits only, zeros before a digit dropped."""
    return F.regexp_replace(F.regexp_replace(F.upper(x), "[^A-Z0-9]", ""), "0+([0-9])", "$1")


def close(a: Column, b: Column, tol: float = 1.0) -> Column:
    """Within ``tol`` or 0.1% of the register's side b; both null agree, one null doesn't."""
    near = F.abs(a - b) <= F.greatest(F.lit(tol).cast("decimal(18,5)"), (F.abs(b) * F.lit("0.001").cast("decimal(5,3)")).cast("decimal(18,5)"))
    return F.coalesce(near, a.isNull() & b.isNull())


def band(x: Column) -> Column:
    """Steps no narrower than the tolerance: values within it are in the same step or in neighbours."""
    v = F.abs(x.cast("double"))
    return F.when(v < 1000, F.floor(v / 2)).otherwise(500 + F.floor((F.ln(v) - F.ln(F.lit(1000.0))) / 0.0021))


def _with_period(df: DataFrame) -> DataFrame:
    return df if "period" in df.columns else df.withColumn("period", F.lit(0))


def keyed(t: DataFrame) -> DataFrame:
    """``t`` with what rows meet by, unless it is there: tax id, normalised number and band of the amount.  Found before a book is repeated for its periods, a key is
    found once."""
    if "_n" in t.columns:
        return t if "periods" in t.columns else _with_period(t)
    return _with_period(t.select("*", F.upper("gstin").alias("_g"), normal_number(F.col("number")).alias("_n"), band(F.col("taxable")).alias("_k")))


def _blocks(lines: DataFrame, books: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs with the same normalised number, and those of other numbers with agreeing amounts.

    Books may come once each, keyed and with an array ``periods`` in place of a row for each: then rows aren't moved once for each period."""
    ranged = "periods" in books.columns
    by = ["g"] if ranged else ["period", "g"]
    left = keyed(lines).select("line", "period", F.col("_g").alias("g"), F.col("_n").alias("n"), "taxable", "tax", "day", F.col("_k").alias("k"))
    right = keyed(books).select("book", "periods" if ranged else "period", F.col("_g").alias("g"), F.col("_n").alias("bn"), F.col("taxable").alias("b_taxable"), F.col("tax").alias("b_tax"), F.col("day").alias("b_day"), F.col("_k").alias("k"))
    agree = close(F.col("taxable"), F.col("b_taxable")) & close(F.col("tax"), F.col("b_tax"))
    cols = ["line", "book", "period", "g", "n", "bn", "taxable", "tax", "day", "b_taxable", "b_tax", "b_day"]
    same = left.where("n <> ''").join(right.drop("k").withColumn("n", F.col("bn")), [*by, "n"])
    wide = left.withColumn("k", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.col("k") + i)))
    near = wide.join(right, [*by, "k"]).where(agree & (F.col("n") != F.col("bn")))
    if ranged:
        same, near = (t.where(F.array_contains("periods", F.col("period"))) for t in (same, near))
    return same.select(cols).withColumn("agree", agree), near.select(cols).withColumn("agree", agree)


def blocks(lines: DataFrame, books: DataFrame) -> DataFrame:
    """Pairs of a line (line, gstin, number, day, taxable, tax) and a book (book, same fields) of one tax id with the same normalised
    number or agreeing amounts."""
    same, near = _blocks(lines, books)
    return same.union(near)


def scored(lines: DataFrame, books: DataFrame) -> DataFrame:
    """``blocks`` with the similarity of the numbers; equal ones needn't be compared."""
    same, near = _blocks(lines, books)
    return same.withColumn("score", F.lit(1.0)).union(near.withColumn("score", number_similarity_udf("n", "bn")))


def candidates(lines: DataFrame, books: DataFrame, fuzzy: float = FUZZY) -> DataFrame:
    """``blocks`` with the similarity of the numbers, at least ``fuzzy``."""
    return scored(lines, books).where(F.col("score") >= fuzzy)


def one_to_one(edges: DataFrame, left: str, right: str, score: str = "score") -> DataFrame:
    """The greedy assignment of ``edges``, best score first, ties by left then right."""
    return _one_to_one(edges, left, right, score, Work(edges.sparkSession, "assignment"))


def _one_to_one(edges: DataFrame, left: str, right: str, score: str, work: Work) -> DataFrame:
    open_, taken = work.write(edges.select(left, right, score), "edges"), []
    while not taken or not open_.isEmpty():
        order = [F.desc(score), left, right]
        best = open_.withColumn("_l", F.row_number().over(Window.partitionBy(left).orderBy(*order))).withColumn("_r", F.row_number().over(Window.partitionBy(right).orderBy(*order)))
        got = work.write(best.where("_l = 1 and _r = 1").select(left, right, score), "assigned")
        taken.append(got)
        rest = work.write(open_.join(got.select(left), left, "left_anti").join(got.select(right), right, "left_anti"), "edges")
        work.drop(open_)
        open_ = rest
    out = taken[0]
    for got in taken[1:]:
        out = out.union(got)
    out = work.write(out, "all") if len(taken) > 1 else out
    work.drop(open_, *[t for t in taken if t is not out])
    return out


def _assigned(edges: DataFrame, work: Work) -> DataFrame:
    """(line, book, score) of a greedy assignment in which a book may be taken once in each period."""
    return _one_to_one(edges.select("line", F.struct("book", "period").alias("slot"), "score"), "line", "slot", "score", work).select("line", "slot.book", "score")


def reconcile(lines: DataFrame, books: DataFrame, fuzzy: float = FUZZY, met: DataFrame | None = None) -> DataFrame:
    """(line, book, status, score): one row per statement line.  ``met`` is a table of the ``scored`` pairs of these, if there is one.

    Tables on the way are deleted once they are spent."""
    work = Work(lines.sparkSession, "reconcile")
    lines, books = keyed(lines), keyed(books)
    found = work.write(candidates(lines, books, fuzzy), "candidates") if met is None else met.where(F.col("score") >= fuzzy)
    first = Window.partitionBy("period", "_g", "_n").orderBy("line")
    repeats = lines.where("_n <> ''").withColumn("_k", F.row_number().over(first)).where("_k > 1").select("line")
    nth = Window.partitionBy("line").orderBy(F.desc("score"), "book")
    good = found.where("agree").withColumn("_k", F.row_number().over(nth)).where("_k <= 2").groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("top"), F.min("score").alias("next"))
    unclear = good.where((F.col("n") == 2) & (F.col("top") - F.col("next") <= TIE)).select("line", "top").join(repeats, "line", "left_anti")
    held = work.write(repeats.select("line", F.lit("POTENTIAL_DUPLICATE").alias("status"), F.lit(None).cast("double").alias("score")).union(unclear.select("line", F.lit("REVIEW_REQUIRED"), F.col("top"))), "held")
    paired = _assigned(found.join(held, "line", "left_anti"), work)
    joined = paired.join(found.drop("score"), ["line", "book"])
    status = F.when(~F.col("agree"), "AMOUNT_MISMATCH").when(F.col("score") < 1, "FUZZY_MATCHED").when(F.col("day") != F.col("b_day"), "DATE_MISMATCH").otherwise("MATCHED")
    matched = work.write(joined.select("line", "book", status.alias("status"), "score", "period"), "matched")
    # what is left may match a register row under another tax id
    left = lines.join(matched, "line", "left_anti").join(held, "line", "left_anti").select("line", "period", F.col("_g").alias("g"), "_n", "taxable", "tax", "day")
    right = books.where("gstin is not null").select("book", "period", F.col("_g").alias("bg"), "_n", F.col("taxable").alias("b_taxable"), F.col("tax").alias("b_tax"), F.col("day").alias("b_day"))
    other = left.join(right, ["period", "_n"]).where((F.col("g") != F.col("bg")) & close(F.col("taxable"), F.col("b_taxable")) & close(F.col("tax"), F.col("b_tax")) & F.coalesce(F.col("day") == F.col("b_day"), F.lit(True))).join(matched.select("book", "period"), ["book", "period"], "left_anti")
    work.drop(found)
    crossed = _assigned(other.select("line", "book", "period", F.lit(1.0).alias("score")), work)
    known = matched.drop("period").union(crossed.select("line", "book", F.lit("GSTIN_MISMATCH"), "score")).union(held.select("line", F.lit(None).cast("long"), "status", "score"))
    rest = lines.select("line").join(known, "line", "left_anti").select("line", F.lit(None).cast("long").alias("book"), F.lit("MISSING_IN_BOOKS").alias("status"), F.lit(None).cast("double").alias("score"))
    out = work.write(known.union(rest), "reconciled")
    work.keep(out)
    return out


def missing_in_statement(books: DataFrame, results: DataFrame, first_day: str, last_day: str) -> DataFrame:
    """Books of the period that no line took."""
    return books.where(F.col("day").between(F.lit(first_day).cast("date"), F.lit(last_day).cast("date"))).join(results.where("book is not null").select("book"), "book", "left_anti").select("book")


def missing_by_period(books: DataFrame, lines: DataFrame, results: DataFrame) -> DataFrame:
    """(period, book): books dated in a period, a month as yyyy-MM, that no line of that period took."""
    taken = results.where("book is not null").join(lines.select("line", "period"), "line").select("book", "period")
    return books.where(F.date_format("day", "yyyy-MM") == F.col("period")).join(taken, ["book", "period"], "left_anti").select("period", "book")
