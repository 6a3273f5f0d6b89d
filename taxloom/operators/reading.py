"""Reading invoices off pages by rules: a reader of lines, a reader of columns, and the choice between them by self-consistency.

Both give one row a page: header fields, and ``items`` as an array in the order of the page.  Words become lines, and cells of tables, where the page is
read (``layout``); every rule of a field is a column over the array of a page's lines, of which the first that has a field wins.  A page isn't shuffled again.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxloom.operators import layout

MONEY_TYPE = "decimal(18,2)"
HEADER = "vendor_gstin string, buyer_gstin string, invoice_number string, invoice_date date, subtotal decimal(18,2), total_cgst decimal(18,2), total_sgst decimal(18,2), total_igst decimal(18,2), grand_total decimal(18,2)"
FIELDS = tuple(x.split()[0] for x in HEADER.split(", "))
ITEM = "array<struct<line_no:int,description:string,hsn_sac:string,quantity:decimal(18,3),unit_price:decimal(18,2),taxable_value:decimal(18,2),gst_rate:decimal(18,2),line_total:decimal(18,2)>>"
NUMBERS = ("quantity", "unit_price", "taxable_value", "gst_rate", "line_total")
ITEM_FIELDS = ("description", "hsn_sac", *NUMBERS)
WIDE = Context(prec=200_000, Emax=999_999, Emin=-999_999)

# Patterns of the two readers: fixed values.
MONEY = r"[-+]?\d+(?:,\d{2,3})*(?:\.\d{1,2})?"
TAX_ID = r"\b\d{2}[A-Z]{5}\d{4}[A-Z]\d[Z][A-Z0-9]\b"
TAX_ID_ANY = r"\b(\d{2}[A-Z]{5}\d{4}[A-Z][1-9A-Z]Z[0-9A-Z])\b"
NUMBER = r"(?i)\b(?:invoice|inv|bill)\b\s*(?:no\.?|number|#)?\s*[:\-]?\s*([A-Za-z0-9\-\/]{3,30})"
NUMBER_AFTER_LABEL = r"(?i)\b(?:tax\s+)?(?:invoice|inv|bill)\s*(?:no\.?|number|#)\s*[:\-]?\s*([A-Z0-9][A-Z0-9/\-]*)"
DATES = ((r"\b(\d{2}-\d{2}-\d{4})\b", "dd-MM-yyyy"), (r"\b(\d{2}/\d{2}/\d{4})\b", "dd/MM/yyyy"), (r"\b(\d{2}-[A-Za-z]{3}-\d{4})\b", "dd-MMM-yyyy"), (r"\b(\d{4}-\d{2}-\d{2})\b", "yyyy-MM-dd"))
AMOUNTS = {"subtotal": (r"taxable\s*value", r"sub\s*total", "subtotal"), "total_cgst": ("cgst",), "total_sgst": ("sgst",), "total_igst": ("igst",), "grand_total": (r"grand\s*total", r"total\s*amount", r"amount\s*payable", r"invoice\s*total")}
ROW = rf"^\s*(\d{{1,3}})?\s*(.+?)\s+(\d{{4,8}})\s+({MONEY})\s+({MONEY})\s+({MONEY})\s+(?:(\d{{1,2}}(?:\.\d+)?)\s*%?\s+)?({MONEY})\s*$"
BUYER = r"(?i)\b(bill(?:ed)?\s*to|buyer|consignee|ship(?:ped)?\s*to|recipient|customer|sold\s+to)\b"
STOP = r"(?i)^\s*(total|sub\s*-?\s*total|grand|amount\s+in\s+words|bank|terms|declaration|hsn\s*/?\s*sac\s+summary|tax\s+summary)"
TOTALS = {"subtotal": r"(?i)(total\s+)?taxable\s+(value|amount)|sub\s*-?\s*total", "total_cgst": r"(?i)\bcgst\b", "total_sgst": r"(?i)\b(sgst|utgst)\b", "total_igst": r"(?i)\bigst\b", "grand_total": r"(?i)grand\s+total|total\s+invoice\s+value|invoice\s+total|net\s+(amount\s+)?payable|total\s+amount(\s+payable)?|amount\s+payable"}
ANY_AMOUNT = r"-?\(?\d[\d,]*\.\d{1,2}\)?|-?\(?\d[\d,]*\)?"
HEAD_WORDS = (r"desc|item|particular|product|goods", "hsn|sac", "qty|quantity", "rate|price", "amount|taxable|value|total", "cgst|sgst|igst|gst|tax")
COLUMNS = (("hsn|sac", "hsn_sac"), ("taxable", "taxable_value"), (r"(gst|tax)\s*(%|rate)|^%$|^rate\s*%", "gst_rate"), ("qty|quantity", "quantity"), ("desc|particular|item|product|goods", "description"), ("rate|price", "unit_price"), ("total|amount|amt", "line_total"), (r"^(s\.?\s?no\.?|sr\.?(\s?no\.?)?|#)$", "_serial"))


def _found(said: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(said, pattern, group), F.lit(""))


def _money(text: Column, kind: str = MONEY_TYPE) -> Column:
    return F.regexp_replace(text, r"[,₹%\s]|Rs\.|INR", "").try_cast(kind)


def _date(text: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(_found(text, p), F.lit(f)).cast("date") for p, f in DATES])


def _first(lines: Column, value: Callable[[Column], Column]) -> Column:
    """The first value that one of ``lines`` has."""
    return F.get(F.filter(F.transform(lines, value), lambda v: v.isNotNull()), 0)


def _last(lines: Column, value: Callable[[Column], Column]) -> Column:
    return F.get(F.reverse(F.filter(F.transform(lines, value), lambda v: v.isNotNull())), 0)


def _complete(pages: DataFrame) -> DataFrame:
    return pages.select("page", *[F.col(x.split()[0]).cast(x.split()[1]).alias(x.split()[0]) for x in HEADER.split(", ")], F.coalesce(F.col("items").cast(ITEM), F.array().cast(ITEM)).alias("items"))


def _line_texts(w: layout.Words) -> pa.Table:
    return pa.table([w.page, layout.lists(*layout.near_lines(w))], names=["page", "lines"])


def read_lines(words: DataFrame | layout.Pages) -> DataFrame:
    """The reader of lines: labels and values in one line's text, items as lines of one shape."""
    texts = layout.pages(words).read(_line_texts, "lines array<string>").where(F.size("lines") > 0)
    amount = lambda labels: lambda said: F.coalesce(*[_money(_found(said, rf"(?i){x}\s*[:\-]?\s*(?:Rs\.?|₹|INR)?\s*({MONEY})")) for x in labels])
    # what a label or a date can't be without is sought first
    texts = texts.withColumns({"sums": F.filter("lines", lambda said: said.rlike("(?i)taxable|total|gst|payable")), "days": F.filter("lines", lambda said: said.rlike(r"\d[-/]")), "rows": F.filter(F.transform("lines", lambda said: F.trim(said)), lambda row: row.rlike(ROW))})
    ids = F.flatten(F.transform("lines", lambda said: F.regexp_extract_all(said, F.lit(TAX_ID), F.lit(0))))
    # a row's parts by one match, the description last, since it may hold anything
    parts = F.transform("rows", lambda row: F.split(F.regexp_replace(row, ROW, "\u0001".join(f"${i}" for i in (1, 3, 4, 5, 6, 7, 8, 2))), "\u0001", 8))
    head = texts.select("page", ids.alias("ids"), parts.alias("parts"), _first(F.col("lines"), lambda said: F.trim(_found(said, NUMBER))).alias("invoice_number"), _first(F.col("days"), _date).alias("invoice_date"), *[_first(F.col("sums"), amount(labels)).alias(f) for f, labels in AMOUNTS.items()])
    head = head.withColumn("vendor_gstin", F.get("ids", 0)).withColumn("buyer_gstin", F.get("ids", 1))

    def item(p: Column, nth: Column) -> Column:
        part = lambda i: F.nullif(F.get(p, i), F.lit(""))
        return F.struct(
            F.coalesce(part(0).cast("int"), nth + 1).alias("line_no"), F.trim(part(7)).alias("description"), part(1).alias("hsn_sac"), _money(part(2), "decimal(18,3)").alias("quantity"), _money(part(3)).alias("unit_price"),
            _money(part(4)).alias("taxable_value"), _money(part(5)).alias("gst_rate"), _money(part(6)).alias("line_total"),
        )

    return _complete(head.withColumn("items", F.transform("parts", item)))


def _matches(texts: pa.Array, pattern: str) -> np.ndarray:
    """Whether ``pattern``, in letters of any case, is in each text; of what Arrow's search finds, the few that Java's reading of the pattern has too."""
    found = pc.match_substring_regex(texts, f"(?i){pattern}").to_numpy(zero_copy_only=False)
    exact = re.compile(pattern, re.IGNORECASE | re.ASCII)
    odd = found & ~pc.string_is_ascii(texts).to_numpy(zero_copy_only=False)
    found[odd] = [bool(exact.search(t)) for t in texts.filter(pa.array(odd)).to_pylist()]
    return found


def _is_head(texts: pa.Array) -> np.ndarray:
    head = _matches(texts, "hsn|sac|qty|quantity")
    few = texts.filter(pa.array(head))
    head[head] = sum((_matches(few, p).astype(int) for p in HEAD_WORDS), np.zeros(len(few), int)) >= 3
    return head


def _canonical(said: str) -> str:
    return next((name for p, name in COLUMNS if re.search(p, said, re.IGNORECASE | re.ASCII)), "_other")


def _is_number(said: pa.Array) -> np.ndarray:
    """Whether a text is an amount that decimal(18,3) holds."""
    bare = pc.replace_substring_regex(said, r"[,₹%\s\x0B]|Rs\.|INR", "")
    plain = pc.match_substring_regex(bare, r"^[+-]?(\d{1,15}(\.\d{0,3})?|\.\d{1,3})$").to_numpy(zero_copy_only=False)
    other = np.flatnonzero(~plain & pc.match_substring_regex(bare, r"\pN").to_numpy(zero_copy_only=False))
    if len(other):
        fits = lambda x: bool(re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d{1,5})?", x := x.strip())) and abs(Decimal(x)).quantize(Decimal("0.001"), ROUND_HALF_UP, WIDE) < 10**15
        plain[other] = [fits(x) for x in bare.take(pa.array(other)).to_pylist()]
    return plain


def _columns(w: layout.Words) -> pa.Table:
    """The lines of pages, the line that is a table's head and the one where the table ends, and what the table's items say.

    Words between are each in the column whose head's centre is nearest; a line with two numbers begins an item, and a line that only has a description
    continues the one before."""
    found, n = layout.lines_of(w), len(w.page)
    texts, of, first = found.texts(), found.of, found.first
    head, number = _is_head(texts), found.number()
    start = np.full(n, -1)
    start[of[head][::-1]] = number[head][::-1]  # the first stays
    size = np.diff(first)
    end = size.copy()
    stop = _matches(texts, STOP.removeprefix("(?i)")) & (start[of] >= 0) & (number > start[of])
    end[of[stop][::-1]] = number[stop][::-1]
    # each word of a table and its column
    tables = np.flatnonzero(start >= 0)
    cell_page, centre, said = layout.head_cells(found, first[tables] + start[tables])
    known = said.dictionary_encode()
    names = np.array([ITEM_FIELDS.index(c) if (c := _canonical(t)) in ITEM_FIELDS else len(ITEM_FIELDS) for t in known.dictionary.to_pylist()], int)[known.indices.to_numpy()] if len(said) else np.zeros(0, int)
    inside = (start[of] >= 0) & (number > start[of]) & (number < end[of]) & ~head
    body = np.flatnonzero(inside[found.line])
    line, words = found.line[body], found.words
    near = layout.nearest((words.x0[body] + words.x1[body]) / 2, of[line], cell_page, centre, n)
    name = names[near]
    order = np.lexsort((name, line))  # stable: words stay in place
    body, line, name = body[order], line[order], name[order]
    key = line * (len(ITEM_FIELDS) + 1) + name
    cells, cell = np.unique(key, return_inverse=True)
    cell_line, cell_name = cells // (len(ITEM_FIELDS) + 1), cells % (len(ITEM_FIELDS) + 1)
    texts_of = words.text.take(pa.array(body))
    number_of = np.isin(cell_name, [ITEM_FIELDS.index(c) for c in NUMBERS])
    number_of[number_of] = _is_number(layout.joined(texts_of, layout.bounds(cell, len(cells))).filter(pa.array(number_of)))
    # lines that begin an item, and those that go on with one
    numbers = np.bincount(cell_line, number_of, len(of)).astype(int)
    described = np.bincount(cell_line, cell_name == ITEM_FIELDS.index("description"), len(of)) > 0
    begun = np.cumsum(numbers >= 2)
    item = begun - np.concatenate([[0], begun])[first[of]]
    kept = (item > 0) & ((numbers >= 2) | ((numbers == 0) & described))
    use = kept[line] & (name < len(ITEM_FIELDS)) & ((numbers[line] >= 2) | (name == ITEM_FIELDS.index("description")))
    line, name, texts_of = line[use], name[use], texts_of.filter(pa.array(use))
    whole = begun[line] - 1  # items through all pages
    order = np.lexsort((line, name, whole))
    keys, part = np.unique(whole[order] * len(ITEM_FIELDS) + name[order], return_inverse=True)
    said = layout.joined(texts_of.take(pa.array(order)), layout.bounds(part, len(keys)))
    count = int(begun[-1]) if len(begun) else 0
    place = np.full((count, len(ITEM_FIELDS)), -1)
    place.reshape(-1)[keys] = np.arange(len(keys))
    there = np.flatnonzero((place >= 0).any(axis=1))
    opens = np.flatnonzero(numbers >= 2)  # the line of each item
    columns = [said.take(pa.array(at, mask=at < 0)) for at in place[there].T]
    items = pa.StructArray.from_arrays([pa.array(item[opens][there].astype(np.int32)), *columns], names=["line_no", *ITEM_FIELDS])
    found_items = layout.lists(items, layout.bounds(of[opens][there], n))
    some = pa.table([w.page, layout.lists(texts, first), pa.array(start.astype(np.int32), mask=start < 0), pa.array(end.astype(np.int32)), found_items], names=["page", "lines", "start", "end", "found"])
    return some.filter(pa.array(size > 0))


def read_columns(words: DataFrame | layout.Pages) -> DataFrame:
    """The reader of columns: the header above the table by sections, items by the table's columns, totals below it by the last amount of a line."""
    texts = layout.pages(words).read(_columns, f"lines array<string>, start int, end int, found array<struct<line_no:int,{','.join(f'{c}:string' for c in ITEM_FIELDS)}>>")
    header = F.slice("lines", F.lit(1), F.coalesce("start", F.size("lines")))
    summary = F.slice("lines", F.when(F.col("start").isNull(), 1).otherwise(F.col("end") + 1), F.size("lines"))
    totals = "|".join(p.removeprefix("(?i)") for p in TOTALS.values())
    texts = texts.select("page", "found", header.alias("header"), F.filter(summary, lambda said: said.rlike(f"(?i){totals}") & ~said.rlike(r"(?i)in\s+words")).alias("sums"))
    bought = F.filter(F.transform("header", lambda said, i: F.when(said.rlike(BUYER), i)), lambda i: i.isNotNull())
    texts = texts.withColumn("bought", F.coalesce(F.get(bought, 0), F.size("header")))
    upper = lambda said: F.upper(said)
    tax_id = lambda said: F.coalesce(_found(F.replace(upper(said), F.lit(" "), F.lit("")), TAX_ID_ANY), _found(upper(said), TAX_ID_ANY))
    amounts = lambda said: F.regexp_extract_all(said, F.lit(ANY_AMOUNT), F.lit(0))
    total = lambda p: lambda said: F.when(said.rlike(p), _money(F.get(F.reverse(amounts(said)), 0)))
    day = lambda said: _date(_found(said, r"(?i)\b(?:invoice\s*)?date\s*[:\-]?\s*(\S+)"))
    head, lines = F.col("header"), F.col("sums")
    items = F.transform("found", lambda x: F.struct(x["line_no"].alias("line_no"), x["description"].alias("description"), F.nullif(F.regexp_replace(x["hsn_sac"], r"\D", ""), F.lit("")).alias("hsn_sac"), _money(x["quantity"], "decimal(18,3)").alias("quantity"), *[_money(x[c]).alias(c) for c in NUMBERS[1:]]))
    return _complete(texts.select(
        "page", _first(F.slice(head, F.lit(1), F.col("bought")), tax_id).alias("vendor_gstin"), _first(F.slice(head, F.col("bought") + 1, F.size(head)), tax_id).alias("buyer_gstin"), _first(head, lambda said: _found(said, NUMBER_AFTER_LABEL)).alias("invoice_number"),
        _first(head, day).alias("invoice_date"), *[_last(lines, total(p)).alias(f) for f, p in TOTALS.items()], items.alias("items"),
    ))


#: Fields that each count for one point, the tolerance of sums, and the score of a reading in which all agrees.
REQUIRED, TOLERANCE, WHOLE = ("vendor_gstin", "invoice_number", "invoice_date", "subtotal", "grand_total"), 1, 10


def consistency(row: DataFrame) -> Column:
    """Points for what a reading has and for what of it agrees: one for each required field, for items, for taxes and for the grand total, two for items that
    add up to the subtotal."""
    zero = F.lit(0).cast(MONEY_TYPE)
    add = lambda c: F.aggregate("items", F.lit(0).cast("decimal(28,2)"), lambda a, x: (a + F.coalesce(x[c], zero)).cast("decimal(28,2)"))
    some = F.size("items") > 0
    taxes = sum((F.coalesce(F.col(c), zero) for c in ("total_cgst", "total_sgst", "total_igst")), zero)
    points = [F.col(f).isNotNull() for f in REQUIRED] + [some, some & (taxes != 0), F.abs(F.col("subtotal") + taxes - F.col("grand_total")) <= TOLERANCE]
    two = some & F.exists("items", lambda x: x["taxable_value"].isNotNull()) & (F.abs(add("taxable_value") - F.col("subtotal")) <= TOLERANCE)
    return sum((F.coalesce(p, F.lit(False)).cast("int") for p in points), F.lit(0)) + 2 * F.coalesce(two, F.lit(False)).cast("int")


def best_reading(readings: dict[str, DataFrame]) -> DataFrame:
    """Of each page the reading with the highest score, of equal ones the first in order, with the ``reader`` and the ``score``."""
    rows = None
    for i, (name, found) in enumerate(readings.items()):
        one = found.withColumn("reader", F.lit(name)).withColumn("score", consistency(found)).withColumn("_less", F.lit(-i))
        rows = one if rows is None else rows.unionByName(one)
    best = rows.groupBy("page").agg(F.max_by(F.struct("reader", "score", *FIELDS, "items"), F.struct("score", "_less")).alias("b"))
    return best.select("page", "b.*")
