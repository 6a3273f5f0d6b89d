"""Domain views over the driver tables: vendors, invoices with lines and header totals, orders, tax statements, findings, credit.

The views are one text for both engines.  Faults are planted by key, so that each rule and each outcome occurs.  Money is made decimal
before it is added; the reference day is fixed.  Later views may name earlier ones only.
"""

from __future__ import annotations

from taxloom.plans.dialect import Dialect, Template

TODAY = "date '2001-09-01'"
#: The tax-id alphabet of the check digit; a fixed value.
CHARS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Tax-id patterns; fixed values.
GSTIN_PATTERN = "^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]$"
GSTIN_PATTERN_STRICT = "^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9]Z[0-9A-Z]$"
#: Restricted credits: how it matches, pattern, action, section, category; fixed values, in the order in which keywords are tried.
RESTRICTED = (
    ("code", "8703", "BLOCKED", "17(5)(a)", "Motor vehicles for passengers"),
    ("code", "8711", "BLOCKED", "17(5)(a)", "Motor vehicles for passengers"),
    ("code", "99633", "BLOCKED", "17(5)(b)(i)", "Food and beverages"),
    ("code", "2202", "REVIEW", "17(5)(b)(i)", "Food and beverages"),
    ("code", "99972", "BLOCKED", "17(5)(b)(i)", "Beauty and health services"),
    ("code", "997131", "BLOCKED", "17(5)(b)(i)", "Life insurance"),
    ("code", "997132", "BLOCKED", "17(5)(b)(i)", "Health insurance"),
    ("code", "996601", "BLOCKED", "17(5)(b)(i)", "Rent-a-cab"),
    ("code", "9995", "REVIEW", "17(5)(b)(ii)", "Club and membership fees"),
    ("code", "9964", "REVIEW", "17(5)(b)(iii)", "Passenger transport"),
    ("code", "9954", "REVIEW", "17(5)(c)/(d)", "Construction of immovable property"),
    ("code", "2402", "REVIEW", "17(5)(g)", "Personal consumption"),
    ("keyword", "gift", "REVIEW", "17(5)(h)", "Gifts and free samples"),
    ("keyword", "diwali", "REVIEW", "17(5)(h)", "Gifts and free samples"),
    ("keyword", "catering", "REVIEW", "17(5)(b)(i)", "Food and beverages"),
    ("keyword", "lunch", "REVIEW", "17(5)(b)(i)", "Food and beverages"),
    ("keyword", "dinner", "REVIEW", "17(5)(b)(i)", "Food and beverages"),
    ("keyword", "health club", "REVIEW", "17(5)(b)(ii)", "Club and membership fees"),
)
#: Rates by goods or service code; a code with several rates depends on conditions.  Fixed values.
HSN_RATES = (("8703", "28"), ("87032291", "28"), ("9963", "5|18"), ("2202", "28|40"), ("8471", "18"), ("4820", "12"), ("9403", "18"), ("9954", "12|18"), ("8517", "18"), ("7318", "18"), ("997131", "18"))
STANDARD_RATES = "0, 0.1, 0.25, 1, 1.5, 3, 5, 6, 7.5, 12, 18, 28, 40"
#: Tolerances of the validation rules; fixed values.
LINE_TOL, REL_TOL, TOTAL_TOL = "0.05", "0.001", "1.00"
D = "decimal(14,2)"


def check_digit(x: str) -> str:
    """The mod-36 check character of the first 14 of a tax id."""
    place = lambda i: f"((instr('{CHARS}', substr({x}, {i}, 1)) - 1) * {1 if i % 2 else 2})"
    total = " + ".join(f"(CASE WHEN {place(i)} >= 36 THEN 1 ELSE 0 END + {place(i)} % 36)" for i in range(1, 15))
    return f"substr('{CHARS}', cast(1 + (36 - ({total}) % 36) % 36 AS int), 1)"


def close(a: str, b: str, tol: str, rel: str = REL_TOL) -> str:
    """Within an absolute or relative tolerance; the second is the register's side."""
    return f"(abs({a} - {b}) <= greatest(cast({tol} AS {D}), cast(abs({b}) * cast({rel} AS decimal(5,3)) AS decimal(18,5))))"


def normal_number(d: Dialect, x: str) -> str:
    return d.replace(d.replace(f"upper({x})", "[^A-Z0-9]", ""), "0+([0-9])", "<1>")


#: Codes of the buyer's own line of business, whose restricted credits may be claimed: a builder.
OWN_LINE = ("9954",)


def restricted_codes() -> str:
    rows = ", ".join(f"({len(p)}, '{p}', '{a}', '{s}', '{c}')" for kind, p, a, s, c in RESTRICTED if kind == "code")
    return f"SELECT * FROM (VALUES {rows}) AS r(width, pattern, action, section, category)"


def keyword_case(column: int) -> str:
    """The first keyword rule in order that the description contains, as one of its columns."""
    return "CASE " + " ".join(f"WHEN instr(lower(description), '{r[1]}') > 0 THEN '{r[column]}'" for r in RESTRICTED if r[0] == "keyword") + " END"


def _lines(d: Dialect) -> str:
    hsn = ("87032291", "996331", "22021010", "84713010", "48201020", "997131", "94036000", "9954", "12AB", None, "8517", "73181500")
    tax = lambda share: f"cast(taxable_value * gst_rate * cast('{share}' AS decimal(5,4)) AS {D})"
    return f"""
SELECT invoice_id, line_no, description, hsn_sac, quantity, unit_price, discount, taxable_value, gst_rate,
  CASE WHEN intra THEN {tax("0.005")} + CASE WHEN part_id % 53 = 0 THEN 5 ELSE 0 END END AS cgst,
  CASE WHEN intra THEN {tax("0.005")} END AS sgst, CASE WHEN NOT intra OR part_id % 67 = 0 THEN {tax("0.01")} END AS igst,
  cast(taxable_value + CASE WHEN intra THEN {tax("0.005")} + {tax("0.005")} ELSE {tax("0.01")} END + CASE WHEN part_id % 41 = 0 THEN 10 ELSE 0 END AS {D}) AS line_total
FROM (
  SELECT *, cast(quantity * unit_price - taxable_value + CASE WHEN part_id % 59 = 0 THEN 7 ELSE 0 END AS {D}) AS discount FROM (
    SELECT l_orderkey AS invoice_id, l_partkey AS part_id, v.state = '27' AS intra,
      cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS int) AS line_no,
      CASE l_partkey % 15 WHEN 3 THEN 'Diwali hamper' WHEN 4 THEN 'Team lunch' ELSE 'item ' || cast(l_partkey % 50 AS string) END AS description,
      CASE cast(l_partkey % 12 AS int) {" ".join(f"WHEN {i} THEN {repr(x) if x else 'NULL'}" for i, x in enumerate(hsn))} END AS hsn_sac,
      cast(l_quantity AS decimal(14,3)) AS quantity, cast(floor(l_extendedprice / l_quantity) AS {D}) AS unit_price,
      cast(cast(l_extendedprice AS {D}) * (1 - cast(l_discount AS decimal(3,2))) AS {D}) AS taxable_value,
      cast(CASE cast(round(l_tax * 100) AS int) WHEN 0 THEN 0 WHEN 1 THEN 5 WHEN 2 THEN 12 WHEN 3 THEN 18 WHEN 4 THEN 28 WHEN 5 THEN 40 WHEN 6 THEN 3 WHEN 7 THEN 7 ELSE 18 END AS decimal(5,2)) AS gst_rate
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN vendors v ON o_custkey = v.vendor_id
  ) AS a
) AS b"""


def _line_codes(d: Dialect) -> str:
    expected = d.half_even("cast(taxable_value * gst_rate * cast('0.01' AS decimal(3,2)) AS decimal(18,4))", 2)
    stated = "nullif(coalesce(cgst, 0) + coalesce(sgst, 0) + coalesce(igst, 0), 0)"
    known = "coalesce(h8.rates, h6.rates, h4.rates, h2.rates)"
    shaped = d.matches("hsn_sac", "^([0-9]{2}|[0-9]{4}|[0-9]{6}|[0-9]{8})$")
    rate = "cast(cast(gst_rate AS int) AS string)"
    codes = [
        "CASE WHEN coalesce(hsn_sac, '') = '' THEN 'HSN_MISSING|WARNING|hsn_sac' END",
        f"CASE WHEN hsn_sac <> '' AND NOT {shaped} THEN 'HSN_INVALID_FORMAT|ERROR|hsn_sac' END",
        f"CASE WHEN {shaped} AND {known} IS NULL THEN 'HSN_NOT_IN_REFERENCE|WARNING|hsn_sac' END",
        f"CASE WHEN {shaped} AND instr('|' || {known} || '|', '|' || {rate} || '|') = 0 THEN 'HSN_RATE_MISMATCH|WARNING|gst_rate' END",
        f"CASE WHEN NOT {close('taxable_value', d.half_even('cast(quantity * unit_price - coalesce(discount, 0) AS decimal(20,5))', 2), LINE_TOL)} THEN 'LINE_ARITHMETIC_MISMATCH|ERROR|taxable_value' END",
        f"CASE WHEN NOT {close(stated, expected, LINE_TOL)} THEN 'LINE_GST_MISMATCH|ERROR|gst_rate' END",
        "CASE WHEN (coalesce(cgst, 0) <> 0 OR coalesce(sgst, 0) <> 0) AND coalesce(igst, 0) <> 0 THEN 'TAX_TYPE_CONFLICT|ERROR|igst' END",
        "CASE WHEN cgst <> sgst THEN 'CGST_SGST_MISMATCH|WARNING|cgst' END",
        f"CASE WHEN NOT {close('line_total', f'(taxable_value + coalesce({stated}, 0))', LINE_TOL)} THEN 'LINE_TOTAL_MISMATCH|ERROR|line_total' END",
    ]
    joins = " ".join(f"LEFT JOIN hsn_reference h{n} ON {'hsn_sac' if n == 8 else f'substr(hsn_sac, 1, {n})'} = h{n}.code" for n in (8, 6, 4, 2))
    return f"SELECT invoice_id, line_no, {d.present(codes)} AS mark FROM invoice_lines {joins}"


def _header_codes(d: Dialect) -> str:
    codes = []
    for side in ("vendor", "buyer"):
        x, up = f"{side}_gstin", f"{side}_gstin".upper()
        ok = d.matches(x, GSTIN_PATTERN)
        codes += [
            f"CASE WHEN coalesce({x}, '') = '' THEN '{up}_MISSING|WARNING|{x}' END",
            f"CASE WHEN {x} <> '' AND NOT {ok} THEN '{up}_MALFORMED|ERROR|{x}' END",
            f"CASE WHEN {ok} AND substr({x}, 15, 1) <> {check_digit(x)} THEN '{up}_CHECKSUM_INVALID|ERROR|{x}' END",
        ]
    codes += [
        "CASE WHEN coalesce(invoice_number, '') = '' THEN 'INVOICE_NUMBER_MISSING|ERROR|invoice_number' END",
        "CASE WHEN invoice_date IS NULL THEN 'INVOICE_DATE_MISSING|ERROR|invoice_date' END",
        *[f"CASE WHEN NOT {close(a, b, TOTAL_TOL)} THEN 'HEADER_LINE_SUM_MISMATCH|ERROR|{a}' END" for a, b in (("subtotal", "s_taxable"), ("total_cgst", "s_cgst"), ("total_sgst", "s_sgst"), ("total_igst", "s_igst"))],
        f"CASE WHEN NOT {close('grand_total', '(subtotal + coalesce(total_cgst, 0) + coalesce(total_sgst, 0) + coalesce(total_igst, 0))', TOTAL_TOL)} THEN 'GRAND_TOTAL_MISMATCH|ERROR|grand_total' END",
        "CASE WHEN substr(vendor_gstin, 1, 2) = substr(buyer_gstin, 1, 2) AND s_igst > 0 THEN 'TAX_TYPE_WRONG_FOR_SAME_STATE|ERROR|igst' END",
        "CASE WHEN substr(vendor_gstin, 1, 2) <> substr(buyer_gstin, 1, 2) AND (s_cgst > 0 OR s_sgst > 0) THEN 'TAX_TYPE_WRONG_FOR_INTERSTATE|ERROR|cgst' END",
    ]
    return f"SELECT invoice_id, cast(NULL AS int) AS line_no, {d.present(codes)} AS mark FROM invoices"


def _records(d: Dialect) -> str:
    tail = "substr(invoice_number, length(invoice_number), 1) || substr(invoice_number, length(invoice_number) - 1, 1)"
    return f"""
SELECT invoice_id * 2 + copy AS record_id, date_key AS return_period,
  CASE WHEN invoice_id % 100 = 11 THEN '29' || substr(vendor_gstin_true, 3, 13) ELSE vendor_gstin_true END AS supplier_gstin, vendor_name AS supplier_name,
  CASE WHEN invoice_id % 100 = 21 THEN 'EXT/' || cast(invoice_id AS string) WHEN invoice_id % 10 = 3 THEN replace(invoice_number, '/', '-')
    WHEN invoice_id % 10 = 2 THEN substr(invoice_number, 1, length(invoice_number) - 2) || {tail} ELSE invoice_number END AS invoice_number,
  cast(CASE WHEN invoice_id % 10 = 4 THEN invoice_date + INTERVAL 1 DAY ELSE invoice_date END AS date) AS invoice_date,
  subtotal AS taxable_value, cast(total_tax + CASE WHEN invoice_id % 10 = 5 THEN 50 + total_tax ELSE 0 END AS {D}) AS total_tax,
  invoice_id % 45 <> 0 AS itc_available, CASE WHEN invoice_id % 45 = 0 THEN 'P' END AS itc_reason
FROM (SELECT *, substr(cast(invoice_date AS string), 1, 7) AS date_key FROM invoices WHERE status <> 'REJECTED' AND invoice_id % 10 <> 7 AND subtotal > 0) AS i
CROSS JOIN (SELECT 0 AS copy UNION ALL SELECT 1) AS c WHERE copy = 0 OR invoice_id % 100 = 9"""


def credit_of(d: Dialect, base: str) -> str:
    """The credit of each invoice of ``base``, which has the columns of ``invoices``."""
    late = f"({TODAY} > payment_due_by AND payment_date IS NULL AND s3 <> 'BLOCKED')"
    lapsed = f"({TODAY} > claim_deadline AND coalesce(gstr2b_status, '') <> 'IN_2B' AND s4 <> 'BLOCKED')"
    hold = "(einvoice_status = 'MISMATCH' AND status <> 'APPROVED' AND s2 <> 'BLOCKED')"
    off = "(gstr2b_status = 'IN_2B' AND NOT itc_available)"
    missing = "coalesce(gstr2b_status, '') = 'MISSING_IN_2B'"
    gone = "(status = 'REJECTED' OR (possible_duplicate AND status <> 'APPROVED') OR total <= 0)"
    return f"""
SELECT invoice_id, vendor_id, vendor_gstin, invoice_date, status, gstr2b_status, grand_total, CASE WHEN {gone} THEN 'NOT_APPLICABLE' WHEN {lapsed} THEN 'LAPSED' ELSE s4 END AS itc_status,
  cast(CASE WHEN {gone} THEN 0 ELSE total END AS {D}) AS total_itc, cast(CASE WHEN {gone} OR {lapsed} THEN 0 ELSE e4 END AS {D}) AS eligible_itc,
  cast(CASE WHEN {gone} THEN 0 WHEN {lapsed} THEN b2 + e4 + r4 ELSE b2 END AS {D}) AS blocked_itc, cast(CASE WHEN {gone} THEN 0 ELSE v3 END AS {D}) AS review_itc,
  cast(CASE WHEN {gone} OR {lapsed} THEN 0 ELSE r4 END AS {D}) AS at_risk_itc, CASE WHEN NOT {gone} THEN claim_deadline END AS claim_deadline, CASE WHEN NOT {gone} THEN payment_due_by END AS payment_due_by,
  {d.joined([f"CASE WHEN {gone} THEN CASE WHEN status = 'REJECTED' THEN 'I000' WHEN possible_duplicate AND status <> 'APPROVED' THEN 'I002' ELSE 'I001' END END",
             f"CASE WHEN NOT {gone} AND own_lines > 0 THEN 'I012' END", f"CASE WHEN NOT {gone} AND blocked > 0 THEN 'I010' END", f"CASE WHEN NOT {gone} AND review > 0 THEN 'I011' END", f"CASE WHEN NOT {gone} AND {off} THEN 'I021' END",
             f"CASE WHEN NOT {gone} AND {missing} THEN 'I020' END", f"CASE WHEN NOT {gone} AND gstr2b_status IS NULL THEN 'I022' END", f"CASE WHEN NOT {gone} AND {hold} THEN 'I060' END",
             f"CASE WHEN NOT {gone} AND reverse_charge THEN 'I040' END", f"CASE WHEN NOT {gone} AND {late} THEN 'I030' WHEN NOT {gone} AND payment_date > payment_due_by THEN 'I031' END", f"CASE WHEN NOT {gone} AND {lapsed} THEN 'I050' END"])} AS reasons
FROM (
  SELECT *, CASE WHEN {late} THEN 'REVERSAL_DUE' ELSE s3 END AS s4, CASE WHEN {late} THEN 0 ELSE e3 END AS e4, CASE WHEN {late} THEN r2 + e3 ELSE r2 END AS r4 FROM (
    SELECT *, CASE WHEN {hold} THEN 'NEEDS_REVIEW' ELSE s2 END AS s3, CASE WHEN {hold} THEN 0 ELSE e2 END AS e3, CASE WHEN {hold} THEN v2 + e2 ELSE v2 END AS v3 FROM (
      SELECT *, CASE WHEN {off} THEN 'BLOCKED' WHEN {missing} AND s1 <> 'BLOCKED' THEN 'NOT_IN_2B' WHEN gstr2b_status IS NULL AND s1 = 'ELIGIBLE' THEN 'AWAITING_2B' ELSE s1 END AS s2,
        CASE WHEN {off} THEN total ELSE blocked END AS b2, CASE WHEN {off} THEN 0 ELSE review END AS v2, CASE WHEN {off} OR {missing} THEN 0 ELSE total - blocked - review END AS e2,
        CASE WHEN {missing} THEN total - blocked ELSE 0 END AS r2 FROM (
        SELECT i.*, coalesce(l.line_tax, i.total_tax, 0) AS total, coalesce(l.blocked, 0) AS blocked, coalesce(l.review, 0) AS review, coalesce(l.own_lines, 0) AS own_lines,
          make_date(cast(year(invoice_date) AS int) + CASE WHEN month(invoice_date) >= 4 THEN 1 ELSE 0 END, 11, 30) AS claim_deadline, cast(invoice_date + INTERVAL 180 DAY AS date) AS payment_due_by,
          CASE WHEN coalesce(l.blocked, 0) = coalesce(l.line_tax, i.total_tax, 0) THEN 'BLOCKED' WHEN coalesce(l.review, 0) > 0 THEN 'NEEDS_REVIEW' WHEN coalesce(l.blocked, 0) > 0 THEN 'PARTIALLY_ELIGIBLE' ELSE 'ELIGIBLE' END AS s1
        FROM {base} i LEFT JOIN (
          SELECT invoice_id, cast(sum(tax) AS {D}) AS line_tax, cast(sum(CASE WHEN action = 'BLOCKED' AND NOT own THEN tax ELSE 0 END) AS {D}) AS blocked, cast(sum(CASE WHEN action = 'REVIEW' AND NOT own THEN tax ELSE 0 END) AS {D}) AS review, count(CASE WHEN own AND action IS NOT NULL THEN 1 END) AS own_lines
          FROM restricted_lines WHERE tax > 0 GROUP BY invoice_id) AS l ON i.invoice_id = l.invoice_id) AS a) AS b) AS c) AS e"""


VIEWS: dict[str, Template] = {
    "vendor_bases": """SELECT c_custkey AS vendor_id, c_name AS vendor_name, state,
      state || 'AAPFV' || lpad(cast(c_custkey % 10000 AS string), 4, '0') || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', 1 + cast(floor(c_custkey / 10000) AS int) % 26, 1) || '1Z' AS base
      FROM (SELECT *, CASE WHEN c_nationkey % 2 = 0 THEN '27' ELSE lpad(cast(c_nationkey + 1 AS string), 2, '0') END AS state FROM customer) AS c""",
    "vendors": f"SELECT vendor_id, vendor_name, state, base || {check_digit('base')} AS gstin FROM vendor_bases",
    "hsn_reference": f"SELECT * FROM (VALUES {', '.join(str(x) for x in HSN_RATES)}) AS r(code, rates)",
    "restricted_codes": restricted_codes(),
    "invoice_lines": _lines,
    "line_totals": f"""SELECT invoice_id, count(*) AS n_lines, cast(sum(taxable_value) AS {D}) AS s_taxable, cast(sum(cgst) AS {D}) AS s_cgst, cast(sum(sgst) AS {D}) AS s_sgst, cast(sum(igst) AS {D}) AS s_igst
      FROM invoice_lines GROUP BY invoice_id""",
    "invoices": f"""
      SELECT *, cast(coalesce(total_cgst, 0) + coalesce(total_sgst, 0) + coalesce(total_igst, 0) AS {D}) AS total_tax,
        cast(subtotal + coalesce(total_cgst, 0) + coalesce(total_sgst, 0) + coalesce(total_igst, 0) + CASE WHEN invoice_id % 71 = 0 THEN 250 + subtotal ELSE 0 END AS {D}) AS grand_total
      FROM (
        SELECT o_orderkey AS invoice_id, o_custkey AS vendor_id, v.vendor_name, v.gstin AS vendor_gstin_true, 'F' || cast(o_orderkey - CASE WHEN o_orderkey % 50 = 2 THEN 1 ELSE 0 END AS string) AS document_hash,
          CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 89 = 0 THEN 'BAD-' || v.gstin WHEN o_orderkey % 83 = 0 THEN substr(v.gstin, 1, 14) || CASE WHEN substr(v.gstin, 15, 1) = 'A' THEN 'B' ELSE 'A' END ELSE v.gstin END AS vendor_gstin,
          '27AAPFU0939F1ZV' AS buyer_gstin, CASE WHEN o_orderkey % 101 <> 0 THEN 'INV/' || lpad(cast(o_orderkey AS string), 8, '0') END AS invoice_number,
          CASE WHEN o_orderkey % 103 <> 0 THEN cast(o_orderdate AS date) END AS invoice_date, cast(o_orderdate AS date) AS created_on,
          CASE WHEN o_orderkey % 50 = 0 THEN 'REJECTED' WHEN o_orderstatus = 'F' THEN 'APPROVED' WHEN o_orderstatus = 'O' THEN 'AUTO_APPROVED' ELSE 'NEEDS_REVIEW' END AS status,
          cast(5000 + (o_orderkey % 50) * 100 AS double) / 10000 AS confidence, 'PO-' || cast(o_orderkey % 5000 AS string) AS po_number,
          cast(s_taxable + CASE WHEN o_orderkey % 61 = 0 THEN 500 + s_taxable ELSE 0 END AS {D}) AS subtotal, s_cgst AS total_cgst, s_sgst AS total_sgst, s_igst AS total_igst,
          s_taxable, s_cgst, s_sgst, s_igst, coalesce(n_lines, 0) AS n_lines,
          CASE WHEN o_orderkey % 10 = 7 THEN 'MISSING_IN_2B' WHEN o_orderkey % 10 <> 8 THEN 'IN_2B' END AS gstr2b_status, o_orderkey % 45 <> 0 AS itc_available,
          CASE o_orderkey % 20 WHEN 1 THEN 'VERIFIED' WHEN 2 THEN 'MISMATCH' WHEN 3 THEN 'UNVERIFIED' WHEN 4 THEN NULL ELSE 'NO_QR' END AS einvoice_status,
          o_orderkey % 30 = 0 AS reverse_charge, o_orderkey % 77 = 0 AS possible_duplicate,
          CASE WHEN o_orderkey % 5 <> 0 THEN date_add(cast(o_orderdate AS date), cast(o_orderkey % 200 AS int)) END AS payment_date
        FROM orders JOIN vendors v ON o_custkey = v.vendor_id LEFT JOIN line_totals t ON o_orderkey = t.invoice_id
      ) AS x""",
    "line_marks": _line_codes,
    "header_marks": _header_codes,
    "findings": "SELECT invoice_id, line_no, split_part(mark, '|', 1) AS code, split_part(mark, '|', 2) AS severity, 'validation' AS category, split_part(mark, '|', 3) AS field FROM (SELECT * FROM line_marks UNION ALL SELECT * FROM header_marks) AS m",
    "records": _records,
    "restricted_lines": f"""SELECT l.invoice_id, l.line_no, l.hsn_sac, l.description, cast(coalesce(l.cgst, 0) + coalesce(l.sgst, 0) + coalesce(l.igst, 0) AS {D}) AS tax,
      coalesce({" OR ".join(f"l.hsn_sac LIKE '{x}%'" for x in OWN_LINE)}, false) AS own, coalesce(r6.pattern, r5.pattern, r4.pattern, {keyword_case(1)}) AS pattern, coalesce(r6.action, r5.action, r4.action, {keyword_case(2)}) AS action,
      coalesce(r6.section, r5.section, r4.section, {keyword_case(3)}) AS section, coalesce(r6.category, r5.category, r4.category, {keyword_case(4)}) AS category
      FROM invoice_lines l {" ".join(f"LEFT JOIN restricted_codes r{n} ON r{n}.width = {n} AND substr(l.hsn_sac, 1, {n}) = r{n}.pattern" for n in (6, 5, 4))}""",
    "credit": lambda d: credit_of(d, "invoices"),
    "live": "SELECT * FROM invoices WHERE status NOT IN ('REJECTED', 'FAILED')",
}
#: ``date_add`` is a function of days in Spark; DuckDB adds an interval.
_invoices = VIEWS["invoices"]
VIEWS["invoices"] = lambda d: _invoices if d.spark else _invoices.replace("date_add(cast(o_orderdate AS date), cast(o_orderkey % 200 AS int))", "cast(o_orderdate AS date) + cast(o_orderkey % 200 AS int)")
