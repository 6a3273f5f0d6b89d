"""Invoice lines against purchase-order lines: best match, findings, and a one-to-one variant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxloom.functions.similarity import sequence_ratio_udf
from taxloom.operators.matching import one_to_one
from taxloom.operators.work import written

LEAST_TEXT, LEAST_SCORE, PRICE_TOL_PCT, EPSILON = 0.5, 0.6, 2.0, "0.0005"


def _pairs(lines: DataFrame, po_lines: DataFrame) -> DataFrame:
    po = po_lines.select("po_number", *[F.col(c).alias(f"po_{c}") for c in ("line_no", "description", "hsn_sac", "quantity", "unit_price")])
    return lines.join(po, "po_number")


def best_lines(lines: DataFrame, po_lines: DataFrame) -> DataFrame:
    """``lines`` (invoice_id, line_no, po_number, description, hsn_sac, quantity, unit_price) with the PO line each matches, if any.

    A single PO line of the same code wins; else the best description of those of the same code, or of all if there are none, at least 0.5.
    """
    line, found = ["invoice_id", "line_no"], F.struct("po_line_no", "po_quantity", "po_unit_price")
    # pairs aren't shuffled: those of one code are counted, and only lines of which none or several have it are compared by text
    coded = _pairs(lines, po_lines).where("hsn_sac = po_hsn_sac").groupBy(*line).agg(F.count(F.lit(1)).alias("n_same"), F.min(found).alias("one"))
    known = lines.join(coded, line, "left")
    open_ = _pairs(known.where("n_same is null or n_same > 1").drop("one"), po_lines).where("n_same is null or hsn_sac = po_hsn_sac")
    compared = open_.withColumn("text", sequence_ratio_udf("description", "po_description")).where(F.col("text") >= LEAST_TEXT)
    best = compared.groupBy(*line).agg(F.max(F.struct("text", -F.col("po_line_no"), found.alias("of"))).alias("best")).select(*line, F.col("best.of").alias("likest"))
    taken = F.when(F.col("n_same") == 1, F.col("one")).otherwise(F.col("likest"))
    return known.join(best, line, "left").select(*lines.columns, taken.alias("of")).select(*lines.columns, "of.*")


def _checked(lines: DataFrame, po_lines: DataFrame) -> DataFrame:
    """``best_lines`` with the status and code of each line."""
    orders = po_lines.select("po_number").distinct().withColumn("known", F.lit(True))
    rows = best_lines(lines, po_lines).join(orders, "po_number", "left")
    enough = F.col("po_quantity") >= F.col("quantity") - F.lit(EPSILON).cast("decimal(5,4)")
    dear = F.col("po_unit_price") > 0
    price_ok = F.coalesce(~dear | (F.abs(F.col("unit_price") - F.col("po_unit_price")).cast("double") * 100 / F.col("po_unit_price").cast("double") <= PRICE_TOL_PCT), F.lit(True))
    full = F.abs(F.col("po_quantity") - F.col("quantity")) <= F.lit(EPSILON).cast("decimal(5,4)")
    none = F.col("po_number").isNull()
    gone = F.col("known").isNull()
    lost = F.col("po_line_no").isNull()
    status = F.when(none, "NO_PO").when(gone, "PO_NOT_FOUND").when(lost, "MISMATCH").when(enough & price_ok, F.when(full, "MATCHED").otherwise("PARTIAL")).otherwise("MISMATCH")
    code = F.when(none, "NO_PO_REFERENCE").when(gone, "PO_NOT_FOUND").when(lost, "PO_LINE_NOT_FOUND").when(~enough, "PO_QUANTITY_EXCEEDS").when(~price_ok, "PO_PRICE_MISMATCH").when(~full, "PO_PARTIAL_QUANTITY")
    return rows.withColumns({"status": status, "code": code})


def check(lines: DataFrame, po_lines: DataFrame) -> DataFrame:
    """(invoice_id, line_no, po_line_no, status, code) per invoice line."""
    return _checked(lines, po_lines).select("invoice_id", "line_no", "po_line_no", "status", "code")


def greedy(lines: DataFrame, po_lines: DataFrame) -> DataFrame:
    """One-to-one variant: half code (1 if equal, 0.6 on four digits), half description; at least 0.6, best first."""
    prefix = lambda c: F.substring(c, 1, 4)
    hsn: Column = F.when(F.col("hsn_sac") == F.col("po_hsn_sac"), 1.0).when(prefix("hsn_sac") == prefix("po_hsn_sac"), 0.6).otherwise(0.0)
    scored = _pairs(lines, po_lines).withColumn("score", F.round(0.5 * hsn + 0.5 * sequence_ratio_udf("description", "po_description"), 6)).where(F.col("score") >= LEAST_SCORE)
    edges = scored.select(F.struct("invoice_id", "line_no").alias("line"), F.struct("invoice_id", "po_number", "po_line_no").alias("po"), "score")
    return one_to_one(edges, "line", "po").select("line.invoice_id", "line.line_no", "po.po_line_no", "score")


def check_alternative(lines: DataFrame, po_lines: DataFrame) -> DataFrame:
    """(invoice_id, line_no, code) of the alternative rules, over the one-to-one assignment of ``greedy``: no order R001, unknown order R002, line not on it R010, more
    or less than ordered R020 and R021, another price R030, an order line not billed R040 (``line_no`` is then the order's)."""
    assigned = written(greedy(lines.where("po_number is not null"), po_lines), "assigned")
    orders = po_lines.select("po_number").distinct().withColumn("known", F.lit(True))
    po = po_lines.select("po_number", F.col("line_no").alias("po_line_no"), F.col("quantity").alias("po_quantity"), F.col("unit_price").alias("po_unit_price"))
    rows = lines.join(orders, "po_number", "left").join(assigned.select("invoice_id", "line_no", "po_line_no"), ["invoice_id", "line_no"], "left").join(po, ["po_number", "po_line_no"], "left")
    tol = F.lit(EPSILON).cast("decimal(5,4)")
    on, found = F.col("known").isNotNull(), F.col("po_line_no").isNotNull()
    off = F.abs(F.col("unit_price") - F.col("po_unit_price")).cast("double") * 100 / F.col("po_unit_price").cast("double") > PRICE_TOL_PCT
    codes = F.array(
        F.when(F.col("po_number").isNull(), "R001").when(~on, "R002").when(~found, "R010"), F.when(found & (F.col("quantity") > F.col("po_quantity") + tol), "R020").when(found & (F.col("quantity") < F.col("po_quantity") - tol), "R021"),
        F.when(found & (F.col("po_unit_price") > 0) & off, "R030"),
    )
    said = rows.select("invoice_id", "line_no", F.explode(F.array_compact(codes)).alias("code"))
    billed = lines.where("po_number is not null").select("invoice_id", "po_number").distinct().join(po.where(F.col("po_quantity") > tol), "po_number")
    open_ = billed.join(assigned, ["invoice_id", "po_line_no"], "left_anti").select("invoice_id", F.col("po_line_no").alias("line_no"), F.lit("R040").alias("code"))
    return said.union(open_)


def line_view(lines: DataFrame, po_lines: DataFrame) -> DataFrame:
    """(invoice_id, line_no, po_line_no, status, qty_invoice, qty_po, price_invoice, price_po, variance): each line beside the order line it matches."""
    rows = _checked(lines, po_lines)
    variance = F.col("quantity") * F.col("unit_price") - F.col("po_quantity") * F.col("po_unit_price")
    return rows.select("invoice_id", "line_no", "po_line_no", "status", F.col("quantity").alias("qty_invoice"), F.col("po_quantity").alias("qty_po"), F.col("unit_price").alias("price_invoice"), F.col("po_unit_price").alias("price_po"), variance.cast("decimal(18,2)").alias("variance"))
