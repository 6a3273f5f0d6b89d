"""Cases of the fourth round's findings."""

import datetime as dt
import os
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from taxloom.functions import similarity
from taxloom.operators import layout, matching, purchase_orders, reading, work

WORDS = "page long, word long, text string, x0 double, y0 double, x1 double, y1 double"


def page_of(page, rows, step=20.0):
    """Words of a page whose lines are (x, text) pairs."""
    return [(page, 1000 * i + j, t, float(x), step * i, float(x + 6 * len(t)), step * i + 12) for i, row in enumerate(rows) for j, (x, t) in enumerate(row)]


HEAD = [(40, "S.No"), (90, "Description"), (250, "HSN/SAC"), (330, "Qty"), (400, "Rate"), (480, "Taxable"), (570, "GST%"), (640, "Total")]


def item(n, said, code, *numbers):
    return [(40, n), *[(90 + 60 * i, t) for i, t in enumerate(said.split(" "))], (250, code), *zip((330, 400, 480, 570, 640), numbers, strict=True)]


def shuffles(df):
    return len(re.findall(r"Exchange (?:hash|range)partitioning", df._jdf.queryExecution().executedPlan().toString()))


@pytest.mark.parametrize("read", [layout.page_lines, reading.read_lines, reading.read_columns])
def test_a_page_is_gathered_once(spark, read):
    """F1, F4 to F7: words are gathered by page and read there; lines, cells and items aren't shuffled again."""
    assert shuffles(read(spark.createDataFrame(page_of(1, [HEAD]), WORDS))) == 1


def test_readers_of_odd_pages(spark):
    """a control character in a description, a line that goes on with an item, a row without a serial number, a repeated head, a total below, words that
    are blank or null, a page without a table and one without words."""
    rows = [[(40, "Invoice"), (90, "No:"), (120, "A/7")], [(40, "Date:"), (80, "05-Feb-2024")], HEAD, item("1", "odd\u0001thing", "8471", "2", "10.00", "20.00", "18", "23.60"), [(90, "in"), (120, "red")], HEAD,
            item("", "plain", "9403", "1", "5.00", "5.00", "12", "5.60")[1:], [(40, "Sub"), (70, "Total"), (480, "Rs."), (510, "25.00")], [(40, "Grand"), (80, "Total"), (480, "29.20")]]
    words = page_of(1, rows) + page_of(2, [[(40, "nothing")], [(40, "here")]]) + [(1, 5, " ", 0.0, 0.0, 1.0, 12.0), (1, 6, None, 0.0, 0.0, 1.0, 12.0), (3, 1, " ", 0.0, 0.0, 1.0, 1.0)]
    words = spark.createDataFrame(words, WORDS)
    by_lines = {r.page: r for r in reading.read_lines(words).collect()}
    by_columns = {r.page: r for r in reading.read_columns(words).collect()}
    assert set(by_lines) == {1, 2, 3} and set(by_columns) == {1, 2}
    for r in (by_lines[1], by_columns[1]):
        assert (r.invoice_number, str(r.invoice_date), r.subtotal, r.grand_total) == ("A/7", "2024-02-05", Decimal("25.00"), Decimal("29.20"))
    assert [(i.line_no, i.description, i.hsn_sac, i.taxable_value, i.line_total) for i in by_lines[1]["items"]] == [(1, "odd\u0001thing", "8471", 20, Decimal("23.60")), (2, "plain", "9403", 5, Decimal("5.60"))]
    assert [(i.line_no, i.description, i.hsn_sac, i.quantity, i.taxable_value) for i in by_columns[1]["items"]] == [(1, "odd\u0001thing in red", "8471", 2, 20), (2, "plain", "9403", 1, 5)]
    assert by_columns[2]["items"] == [] and by_lines[2].invoice_number is None


def test_a_page_of_many_words(spark):
    """the reach of a page's lines is found once and not for every word."""
    rows = spark.range(40_000).select(F.lit(1).cast("long").alias("page"), F.col("id").alias("word"), F.lit("w").alias("text"), (F.col("id") % 20 * 10).cast("double").alias("x0"), (F.floor(F.col("id") / 20) * 20).cast("double").alias("y0"))
    got = layout.page_lines(rows.withColumn("x1", F.col("x0") + 6).withColumn("y1", F.col("y0") + 12)).groupBy("line").count()
    assert {(r.line, r["count"]) for r in got.collect()} == {(i, 20) for i in range(2_000)}


def test_labels_of_taken_and_repeated_words(spark):
    """a run whose first place is taken goes to its next; null words and values label nothing."""
    row = spark.createDataFrame([(["a", "b", "a", None, "a"], "a b", "a", None, ""), (None, "a", "b", "c", "d")], "words array<string>, two string, one string, none string, empty string")
    got = row.select(layout.field_labels(F.col("words"), {f: F.col(f) for f in ("one", "two", "none", "empty")}).alias("l")).collect()
    assert [r.l for r in got] == [["B-two", "I-two", "B-one", "O", "O"], None]


LINE = "line long, period string, gstin string, number string, day date, taxable decimal(18,2), tax decimal(18,2)"


def statement(spark):
    m, day = Decimal, dt.date(2026, 1, 5)
    rows = [(i, "2026-01", "27AAPFU0939F1ZV", n, day, m(100 * i), m(10)) for i, n in enumerate(["A/1", "A/2", "A/34", "A/43", ""], 1)]
    return spark.createDataFrame(rows, LINE), spark.createDataFrame([(r[0], *r[1:]) for r in [*rows[:2], (3, *rows[2][1:3], "A-43", *rows[2][4:])]], LINE.replace("line", "book", 1))


def test_equal_numbers_are_not_compared(spark):
    """only pairs of other numbers go through Python; a pair of equal numbers is 1 as similarity has it."""
    lines, books = statement(spark)
    pairs = matching.candidates(lines, books)
    assert {(r.line, r.book, r.score) for r in pairs.collect()} == {(1, 1, 1.0), (2, 2, 1.0), (4, 3, 1.0)}  # of other numbers 3 and 3 agree in amount, by two thirds
    assert similarity.number_similarity("A34", "A43") < matching.FUZZY and similarity.number_similarity("A1", "A1") == 1
    before = matching.keyed(books).where("book > 0")
    plan = matching.blocks(matching.keyed(lines).localCheckpoint(), before.localCheckpoint())._jdf.queryExecution().executedPlan().toString()
    assert "regexp_replace" not in plan


def test_reconciliation_leaves_its_result_only(spark, tmp_path, monkeypatch):
    """what is written on the way is deleted, so disk follows the result and not the rounds."""
    lines, books = statement(spark)
    monkeypatch.setattr(work, "shared_folder", lambda _: f"file://{tmp_path}")
    got = matching.reconcile(lines, books).collect()
    assert len(got) == 5
    assert len([d for d, _, names in os.walk(tmp_path) if "_SUCCESS" in names]) == 1


def test_order_lines_are_matched_once(spark):
    """F8 and F11: the view of order lines is the check's rows, whose best lines are found by one text comparison."""
    line = "invoice_id long, line_no int, po_number string, description string, hsn_sac string, quantity decimal(14,3), unit_price decimal(14,2)"
    m = Decimal
    lines = spark.createDataFrame([(1, 1, "P", "steel pipe", "7318", m(2), m(5)), (1, 2, "P", "copper wire", None, m(1), m(9)), (2, 1, None, "x", None, m(1), m(1)), (3, 1, "Q", "x", None, m(1), m(1))], line)
    ordered = spark.createDataFrame([("P", 1, "steel pipe", "7318", m(2), m(5)), ("P", 2, "copper wires", "8544", m(3), m(9))], line.removeprefix("invoice_id long, line_no int, ").replace("po_number string", "po_number string, line_no int"))
    compared = lambda df: df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")
    view = purchase_orders.line_view(lines, ordered)
    assert compared(view) == compared(purchase_orders.best_lines(lines, ordered)) > 0
    assert {(r.invoice_id, r.line_no, r.po_line_no, r.status, r.variance) for r in view.collect()} == {(1, 1, 1, "MATCHED", m(0)), (1, 2, 2, "PARTIAL", m(-18)), (2, 1, None, "NO_PO", None), (3, 1, None, "PO_NOT_FOUND", None)}
