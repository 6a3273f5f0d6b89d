"""Duplicate invoices: pairs within a vendor and a band of days, or of one file, scored by number, amounts, date and descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxloom.functions.similarity import indel, sequence_ratio_udf, token_set_udf
from taxloom.operators.matching import normal_number

#: Tiers; fixed values.
LIKELY, POSSIBLE = 0.85, 0.72
BAND = 180


def rel_diff(a: Column, b: Column) -> Column:
    a, b = a.cast("double"), b.cast("double")
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1.0))


def pairs(invoices: DataFrame, days: int = BAND) -> DataFrame:
    """Pairs (a, b) with a's id the smaller.  Days are cut into steps of the band, so each invoice meets its own step and the next two sides."""
    slot = F.floor(F.datediff(F.col("invoice_date"), F.lit("1970-01-01")) / days)
    a = invoices.select(F.struct("*").alias("a"), F.col("vendor_id").alias("v"), F.explode(F.array(slot - 1, slot, slot + 1)).alias("s"))
    b = invoices.select(F.struct("*").alias("b"), F.col("vendor_id").alias("v"), slot.alias("s"))
    near = a.join(b, ["v", "s"]).where("a.invoice_id < b.invoice_id").where(F.abs(F.datediff("a.invoice_date", "b.invoice_date")) <= days).select("a", "b")
    files = invoices.select(F.struct("*").alias("a"), F.col("document_hash").alias("h")).join(invoices.select(F.struct("*").alias("b"), F.col("document_hash").alias("h")), "h").where("a.invoice_id < b.invoice_id").select("a", "b")
    outside = ~F.coalesce((F.col("a.vendor_id") == F.col("b.vendor_id")) & (F.abs(F.datediff("a.invoice_date", "b.invoice_date")) <= days), F.lit(False))
    return near.union(files.where(outside))


def between(new: DataFrame, old: DataFrame, days: int = BAND) -> DataFrame:
    """Pairs (a, b), a's id the smaller, of an invoice of ``new`` and one of ``old``: of a vendor and within days, or of one file."""
    slot = F.floor(F.datediff(F.col("invoice_date"), F.lit("1970-01-01")) / days)
    x = new.select(F.struct("*").alias("x"), F.col("vendor_id").alias("v"), F.explode(F.array(slot - 1, slot, slot + 1)).alias("s"))
    y = old.select(F.struct(*new.columns).alias("y"), F.col("vendor_id").alias("v"), slot.alias("s"))
    close = F.coalesce((F.col("x.vendor_id") == F.col("y.vendor_id")) & (F.abs(F.datediff("x.invoice_date", "y.invoice_date")) <= days), F.lit(False))
    near = x.join(y, ["v", "s"]).where(close).select("x", "y")
    files = new.select(F.struct("*").alias("x"), F.col("document_hash").alias("h")).join(old.select(F.struct(*new.columns).alias("y"), F.col("document_hash").alias("h")), "h").where(~close).select("x", "y")
    first = F.col("x.invoice_id") < F.col("y.invoice_id")
    return near.union(files).where("x.invoice_id <> y.invoice_id").select(F.when(first, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("b"))


def score(found: DataFrame) -> DataFrame:
    """(invoice_a, invoice_b, score, tier) of every pair; the tier is null where none is reached."""
    na, nb = normal_number(F.col("a.invoice_number")), normal_number(F.col("b.invoice_number"))
    digits = lambda n: F.regexp_replace(F.regexp_replace(n, "[^0-9]", ""), "^0+", "")
    amount = lambda d: F.when(d.isNull(), 0.5).when(d <= 0.005, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - d * 10))
    rows = found.withColumn("na", F.coalesce(na, F.lit(""))).withColumn("nb", F.coalesce(nb, F.lit("")))
    rows = rows.withColumn("number", F.when((F.col("na") == "") | (F.col("nb") == ""), 0.0).otherwise(indel("na", "nb")))
    rows = rows.withColumn("words", token_set_udf("a.descriptions", "b.descriptions"))
    gap = F.abs(F.datediff("a.invoice_date", "b.invoice_date"))
    date = F.when(gap.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), 1 - gap / 30))
    raw = 0.45 * F.round("number", 3) + 0.2 * amount(rel_diff(F.col("a.grand_total"), F.col("b.grand_total"))) + 0.1 * amount(rel_diff(F.col("a.total_tax"), F.col("b.total_tax"))) + 0.05 * amount(rel_diff(F.col("a.subtotal"), F.col("b.subtotal"))) + 0.1 * date + 0.1 * F.when(F.col("a.descriptions").isNull() | F.col("b.descriptions").isNull(), 0.5).otherwise(F.round("words", 3))
    recurring = (F.col("number") < 0.6) | ((digits(F.col("na")) != "") & (digits(F.col("nb")) != "") & (digits(F.col("na")) != digits(F.col("nb"))))
    guarded = F.when(recurring, F.least(raw, F.lit(0.5))).otherwise(raw)
    same = (F.col("na") != "") & (F.col("na") == F.col("nb")) & F.coalesce(F.col("a.vendor_gstin") == F.col("b.vendor_gstin"), F.lit(False))
    file = F.col("a.document_hash") == F.col("b.document_hash")
    value = F.when(file, 1.0).when(same, 0.99).otherwise(F.round(guarded, 4))
    tier = F.when(file | same, "exact").when(guarded >= LIKELY, "likely").when(guarded >= POSSIBLE, "possible")
    return rows.select(F.col("a.invoice_id").alias("invoice_a"), F.col("b.invoice_id").alias("invoice_b"), value.alias("score"), tier.alias("tier"))


def unknown(scored: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs of ``scored`` that reach a tier and aren't in ``known`` (invoice_a, invoice_b), whichever of a pair comes first there."""
    old = known.select(F.least("invoice_a", "invoice_b").alias("invoice_a"), F.greatest("invoice_a", "invoice_b").alias("invoice_b"))
    return scored.where("tier is not null").join(old, ["invoice_a", "invoice_b"], "left_anti")


#: Of the check at upload: days between dates, least similarity of numbers, and the one that needs no equal amount; fixed values.
UPLOAD_DAYS, SIMILAR, SAME = 3, 0.8, 0.97


def _others(invoices: DataFrame, key: list[str], days: int) -> DataFrame:
    """Pairs (a, b) of different invoices of one ``key`` whose dates, where both have one, are within ``days``; each way round.

    Dated ones meet in their slots of days.  Undated ones meet all of their key, which is what the rule says."""
    slot = F.floor(F.datediff(F.col("invoice_date"), F.lit("1970-01-01")) / days)
    own = [F.col(k).alias(f"_{k}") for k in key]
    a = invoices.where("invoice_date is not null").select(F.struct("*").alias("a"), *own, F.explode(F.array(slot - 1, slot, slot + 1)).alias("_s"))
    b = invoices.where("invoice_date is not null").select(F.struct("*").alias("b"), *own, slot.alias("_s"))
    by = [f"_{k}" for k in key]
    near = a.join(b, [*by, "_s"]).where(F.abs(F.datediff("a.invoice_date", "b.invoice_date")) <= days).select("a", "b")
    every, undated = invoices.select(F.struct("*").alias("b"), *own), invoices.where("invoice_date is null").select(F.struct("*").alias("a"), *own)
    one = undated.join(every, by).select("a", "b")
    other = one.where("b.invoice_date is not null").select(F.col("b").alias("a"), F.col("a").alias("b"))
    return near.union(one).union(other).where("a.invoice_id <> b.invoice_id")


def _same_file(invoices: DataFrame) -> DataFrame:
    """(invoice_id, other): each invoice and the first other one of the same file."""
    ends = invoices.where("document_hash is not null").groupBy("document_hash").agg(F.min("invoice_id").alias("_lo"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    second = invoices.join(ends.select("document_hash", "_lo"), "document_hash").where("invoice_id <> _lo").groupBy("document_hash", "_lo").agg(F.min("invoice_id").alias("_next"))
    return invoices.join(second, "document_hash").select("invoice_id", F.when(F.col("invoice_id") == F.col("_lo"), F.col("_next")).otherwise(F.col("_lo")).alias("other"))


def upload_check(invoices: DataFrame, days: int = UPLOAD_DAYS) -> DataFrame:
    """(invoice_id, code, other): what the check at upload says of each invoice against all others.  An exact file ends the check; else every invoice of the tax id with a
    similar number, and an equal amount unless the number is all but equal."""
    exact = _same_file(invoices)
    rest = invoices.where("invoice_number is not null and vendor_gstin is not null")
    met = _others(rest, ["vendor_gstin"], days).withColumn("similar", sequence_ratio_udf("a.invoice_number", "b.invoice_number")).where(F.col("similar") >= SIMILAR)
    amounts = F.coalesce(F.abs(F.col("a.grand_total") - F.col("b.grand_total")) <= 1, F.lit(False))
    likely = met.where((F.col("similar") > SAME) | amounts).select(F.col("a.invoice_id").alias("invoice_id"), F.lit("DUPLICATE_LIKELY").alias("code"), F.col("b.invoice_id").alias("other"))
    return exact.select("invoice_id", F.lit("DUPLICATE_EXACT_FILE").alias("code"), "other").union(likely.join(exact.select("invoice_id"), "invoice_id", "left_anti"))


def alternative_check(invoices: DataFrame, days: int = UPLOAD_DAYS) -> DataFrame:
    """(invoice_id, other, code, score): the best match with each counterpart: its file 1, tax id and number 0.98, amount and date with a similar number or the same
    order at least 0.75."""
    n = normal_number(F.col("invoice_number"))
    rows = invoices.withColumn("number", n)
    pair = lambda df, code, score: df.select("invoice_id", "other", F.lit(code).alias("code"), score.cast("double").alias("score"))
    both = lambda key: rows.select("invoice_id", *key).join(rows.select(F.col("invoice_id").alias("other"), *key), key).where("invoice_id <> other")
    file, number = both(["document_hash"]), both(["vendor_gstin", "number"]).where("number <> ''")
    met = _others(rows.where("vendor_gstin is not null and grand_total is not null"), ["vendor_gstin"], days).where(F.abs(F.col("a.grand_total") - F.col("b.grand_total")) <= 1)
    met = met.withColumn("s", sequence_ratio_udf(F.coalesce("a.number", F.lit("")), F.coalesce("b.number", F.lit("")))).where((F.col("s") >= SIMILAR) | F.coalesce(F.col("a.po_number") == F.col("b.po_number"), F.lit(False)))
    fuzzy = met.select(F.col("a.invoice_id").alias("invoice_id"), F.col("b.invoice_id").alias("other"), F.round(F.greatest("s", F.lit(0.75)), 2).alias("s"))
    every = pair(file, "D001", F.lit(1.0)).union(pair(number, "D002", F.lit(0.98))).union(pair(fuzzy, "D003", F.col("s")))
    return every.groupBy("invoice_id", "other").agg(F.max(F.struct("score", F.expr("-ascii(substr(code, 4, 1))"), "code")).alias("m")).select("invoice_id", "other", "m.code", "m.score")
