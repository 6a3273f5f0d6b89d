"""Filters, joins, aggregates, windows, sorts, sets and scalar functions over the adapter views, as SQL for both engines.

Keys are the operator ids of the blueprint.  Averages and ratios are doubles, rounded; sums of money are decimals.
"""

from __future__ import annotations

from taxloom.plans.dialect import Dialect, Template
from taxloom.sources.adapters import CHARS, GSTIN_PATTERN, GSTIN_PATTERN_STRICT, STANDARD_RATES, TODAY, check_digit, close, normal_number

M = "decimal(18,2)"
MONTH = "substr(cast(invoice_date AS string), 1, 7)"
MATCHED = "('IN_2B')"


def money(x: str) -> str:
    return f"cast(sum({x}) AS {M})"


def share(a: str, b: str, n: int = 6) -> str:
    return f"round(cast({a} AS double) / nullif({b}, 0), {n})"


def per_event(d: Dialect, seconds: int, least: int, test: str, key: str) -> str:
    return f"SELECT {d.slot('ts', seconds)} AS slot, {key} AS actor, count(*) AS n FROM events WHERE {test} GROUP BY 1, 2 HAVING count(*) >= {least}"


EPOCH = "date '1970-01-01'"


def _banded(d: Dialect, source: str, days: int, columns: str) -> str:
    slot = f"cast(floor({d.days(EPOCH, 'invoice_date')} / {days}e0) AS bigint)"
    near = f"explode(array({slot} - 1, {slot}, {slot} + 1))" if d.spark else f"unnest([{slot} - 1, {slot}, {slot} + 1])"
    return f"""SELECT {columns} FROM (SELECT *, {near} AS slot FROM {source} WHERE invoice_date IS NOT NULL) a JOIN (SELECT *, {slot} AS slot FROM {source} WHERE invoice_date IS NOT NULL) b
      ON a.vendor_id = b.vendor_id AND a.slot = b.slot AND a.invoice_id < b.invoice_id WHERE abs({d.days('a.invoice_date', 'b.invoice_date')}) <= {days}"""


RISK = """
  SELECT i.vendor_gstin, min(i.vendor_name) AS vendor_name, count(*) AS n, cast(coalesce(sum(i.grand_total), 0) AS decimal(18,2)) AS total_spend,
    count(CASE WHEN i.gstr2b_status = 'IN_2B' THEN 1 END) AS in2b, count(CASE WHEN i.gstr2b_status = 'MISSING_IN_2B' THEN 1 END) AS miss,
    count(CASE WHEN i.einvoice_status IN ('MISMATCH', 'SIGNATURE_INVALID') THEN 1 END) AS bad_qr, coalesce(sum(f.errors), 0) AS errors, cast(coalesce(sum(c.at_risk_itc), 0) AS decimal(18,2)) AS at_risk
  FROM invoices i LEFT JOIN (SELECT invoice_id, count(*) AS errors FROM findings WHERE severity = 'ERROR' GROUP BY invoice_id) f ON i.invoice_id = f.invoice_id
  LEFT JOIN credit c ON i.invoice_id = c.invoice_id WHERE i.vendor_gstin IS NOT NULL GROUP BY i.vendor_gstin"""
AMOUNT_MISMATCHES = "SELECT r.supplier_gstin, count(*) AS mm FROM records r JOIN invoices i ON r.invoice_number = i.invoice_number AND r.supplier_gstin = i.vendor_gstin_true WHERE abs(r.total_tax - i.total_tax) > greatest(1, abs(i.total_tax) * 0.001) GROUP BY r.supplier_gstin"


def _vendor_risk(d: Dialect) -> str:
    score = "100 * least(1e0, 6e-1 * coalesce(1 - filing_rate, 0) + 15e-2 * least(1e0, errors / cast(n AS double) / 2) + 25e-2 * CASE WHEN bad_qr > 0 THEN 1 ELSE 0 END + 1e-1 * least(1e0, mm / cast(greatest(in2b + miss, 1) AS double)))"
    reasons = d.joined([
        "CASE WHEN miss > 0 THEN cast(miss AS string) || ' of ' || cast(in2b + miss AS string) || ' invoices not reported' END", "CASE WHEN mm > 0 THEN cast(mm AS string) || ' amount mismatches' END",
        "CASE WHEN bad_qr > 0 THEN cast(bad_qr AS string) || ' e-invoice problems' END", "CASE WHEN errors > 0 THEN cast(cast(errors AS bigint) AS string) || ' validation errors' END"])
    return f"""SELECT vendor_gstin, vendor_name, n AS invoice_count, total_spend, round(filing_rate, 6) AS filing_rate, miss AS missing_in_2b, mm AS amount_mismatches, bad_qr AS einvoice_issues, cast(errors AS bigint) AS error_findings, at_risk,
      round(score, 1) AS risk_score, CASE WHEN score >= 40 THEN 'High' WHEN score >= 20 THEN 'Medium' ELSE 'Low' END AS risk_level, {reasons} AS reasons
      FROM (SELECT *, {score} AS score FROM (SELECT r.*, coalesce(m.mm, 0) AS mm, in2b / nullif(cast(in2b + miss AS double), 0) AS filing_rate FROM ({RISK}) r LEFT JOIN ({AMOUNT_MISMATCHES}) m ON r.vendor_gstin = m.supplier_gstin) a) b
      ORDER BY risk_score DESC, total_spend DESC, vendor_gstin LIMIT 50"""


#: Bands of amounts that rise with them.
BAND = "floor(64 * log10(1 + greatest(cast(grand_total AS double), 0e0)))"
PRIOR = "PARTITION BY vendor_id ORDER BY coalesce(invoice_date, created_on), created_on, invoice_id"
FRAME = f"{PRIOR} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
KPI = f"""count(*) AS invoices, {money('grand_total')} AS spend, {money('total_tax')} AS gst, count(CASE WHEN status = 'NEEDS_REVIEW' THEN 1 END) AS in_review, count(DISTINCT vendor_id) AS vendors,
  count(CASE WHEN gstr2b_status = 'MISSING_IN_2B' THEN 1 END) AS missing_in_2b, round(avg(confidence), 6) AS avg_confidence"""
PERIODS = {
    "this_month": ("date '2001-09-01'", "date '2001-09-30'"), "last_month": ("date '2001-08-01'", "date '2001-08-31'"), "this_quarter": ("date '2001-07-01'", "date '2001-09-30'"),
    "this_fy": ("date '2001-04-01'", "date '2002-03-31'"), "last_90_days": ("date '2001-06-03'", TODAY), "2001-03": ("date '2001-03-01'", "date '2001-03-31'"),
}
QUEUE = "CASE WHEN match = 'MATCHED' THEN 'resolved' ELSE 'open' END"
SIMPLE_MATCH = f"""SELECT r.record_id, r.return_period, r.supplier_gstin, r.invoice_number, r.invoice_date, r.taxable_value, r.total_tax, i.invoice_id, i.total_tax AS book_tax, i.subtotal AS book_taxable,
  CASE WHEN i.invoice_id IS NULL THEN 'MISSING_IN_BOOKS' WHEN NOT {close('r.taxable_value', 'i.subtotal', '1.00')} OR NOT {close('r.total_tax', 'i.total_tax', '1.00')} THEN 'AMOUNT_MISMATCH' WHEN r.invoice_date <> i.invoice_date THEN 'DATE_MISMATCH' ELSE 'MATCHED' END AS match
  FROM records r LEFT JOIN live i ON r.supplier_gstin = i.vendor_gstin_true AND r.invoice_number = i.invoice_number"""

MISMATCHES = "('MISSING_IN_BOOKS', 'AMOUNT_MISMATCH', 'GSTIN_MISMATCH', 'REVIEW_REQUIRED', 'POTENTIAL_DUPLICATE')"
STATUSES = ("APPROVED", "AUTO_APPROVED", "NEEDS_REVIEW", "REJECTED")


def _period_kpis(d: Dialect) -> str:
    """The key figures of each named period, of each month and of all time.  Sums by day come first, so only days are dealt to the periods that hold them;
    an invoice or record without a date counts for all time only.
    Named periods without any have zeros."""
    keys = "array_compact(array({}))" if d.spark else "list_distinct([{}])"
    named = {name: f"CASE WHEN day BETWEEN {first} AND {last} THEN '{name}' END" for name, (first, last) in PERIODS.items() if not name[0].isdigit()}
    keys = keys.format(", ".join(["'all'", "substr(cast(day AS string), 1, 7)", *named.values()]))
    dealt = f"explode({keys})" if d.spark else f"unnest({keys})"
    books = {"total_purchase_value": "grand_total", "gst_amount": "total_tax"}
    claims = {"itc_total": "total_itc", "itc_eligible": "eligible_itc", "itc_at_risk": "at_risk_itc + review_itc", "itc_blocked": "blocked_itc"}
    counts = {"total_invoices": "1 = 1", "missing": "status NOT IN ('REJECTED', 'FAILED') AND gstr2b_status = 'MISSING_IN_2B'"} | {f"n_{x.lower()}": f"status = '{x}'" for x in STATUSES}
    found = {"records": "1 = 1", "matched": "match IN ('MATCHED', 'FUZZY_MATCHED', 'DATE_MISMATCH')", "unmatched": f"match IN {MISMATCHES}"}
    sums = {name: f"CASE WHEN i.status NOT IN ('REJECTED', 'FAILED') THEN {x} END" for name, x in (books | claims).items()}
    columns = [*sums, *counts, *found]
    none = {c: f"cast(0 AS {M if c in sums else 'bigint'}) AS {c}" for c in columns}
    empty = f"SELECT period, cast(NULL AS date) AS day, {', '.join(none.values())} FROM (VALUES {', '.join(f'({chr(39)}{x}{chr(39)})' for x in ('all', *named))}) AS v(period)"

    def days(source: str, own: dict[str, str]) -> str:
        return f"SELECT invoice_date AS day, {', '.join(f'{own[c]} AS {c}' if c in own else none[c] for c in columns)} FROM {source} GROUP BY invoice_date"

    by_day = days("invoices i LEFT JOIN (SELECT invoice_id AS id, total_itc, eligible_itc, at_risk_itc, review_itc, blocked_itc FROM credit) c ON i.invoice_id = c.id",
                  {c: f"cast(coalesce(sum({x}), 0) AS {M})" for c, x in sums.items()} | {c: f"count(CASE WHEN {x} THEN 1 END)" for c, x in counts.items()})
    by_day += " UNION ALL " + days(f"({SIMPLE_MATCH}) m", {c: f"count(CASE WHEN {x} THEN 1 END)" for c, x in found.items()})
    total = {c: f"cast(sum({c}) AS {M if c in sums else 'bigint'})" for c in columns}
    out = ", ".join(f"{total[c]} AS {c}" for c in (*sums, "total_invoices", *(f"n_{x.lower()}" for x in STATUSES)))
    return f"""SELECT period, {out}, {total['matched']} AS gstr2b_matched, {total['unmatched']} + {total['missing']} AS gstr2b_mismatches, {total['missing']} AS invoices_missing_in_2b,
      (SELECT count(*) FROM records) > 0 AS gstr2b_imported FROM (SELECT {dealt} AS period, a.* FROM ({by_day}) a UNION ALL {empty}) b WHERE period IS NOT NULL GROUP BY period"""


def _report() -> str:
    """The parts of a report as rows: by rate, by status, mean confidence in per cent, credit, statement lines by outcome, the ten commonest error codes and the
    eight vendors that most need attention (``n``: their attention points)."""
    vendors = f"""SELECT name, cast(2 * errors + 3 * (missing + coalesce(m.n, 0)) + 5 * bad_qr + CASE WHEN at_risk > 0 THEN 2 ELSE 0 END AS bigint) AS n, spend FROM (
      SELECT coalesce(i.vendor_gstin, 'name:' || i.vendor_name) AS name, coalesce(sum(f.errors), 0) AS errors, count(CASE WHEN i.einvoice_status IN ('MISMATCH', 'SIGNATURE_INVALID') THEN 1 END) AS bad_qr,
        count(CASE WHEN i.status NOT IN ('REJECTED', 'FAILED') AND i.gstr2b_status = 'MISSING_IN_2B' THEN 1 END) AS missing, {money("CASE WHEN i.status NOT IN ('REJECTED', 'FAILED') THEN i.grand_total END")} AS spend,
        sum(CASE WHEN i.status NOT IN ('REJECTED', 'FAILED') THEN c.at_risk_itc + c.review_itc END) AS at_risk
      FROM invoices i LEFT JOIN (SELECT invoice_id, count(*) AS errors FROM findings WHERE severity = 'ERROR' GROUP BY invoice_id) f ON i.invoice_id = f.invoice_id
      LEFT JOIN credit c ON i.invoice_id = c.invoice_id GROUP BY coalesce(i.vendor_gstin, 'name:' || i.vendor_name)) v
      LEFT JOIN (SELECT supplier_gstin, count(*) AS n FROM ({SIMPLE_MATCH}) s WHERE match IN {MISMATCHES} GROUP BY supplier_gstin) m ON v.name = m.supplier_gstin"""
    of_credit = " UNION ALL ".join(f"SELECT 'credit', '{name}', count(*), coalesce({money(x)}, 0) FROM credit c JOIN live i ON c.invoice_id = i.invoice_id" for name, x in (("total", "total_itc"), ("eligible", "eligible_itc"), ("at_risk", "at_risk_itc + review_itc"), ("blocked", "blocked_itc")))
    return f"""SELECT 'rate' AS part, cast(gst_rate AS string) AS name, count(*) AS n, {money('l.taxable_value')} AS amount FROM invoice_lines l JOIN live i ON l.invoice_id = i.invoice_id GROUP BY gst_rate
      UNION ALL SELECT 'status', status, count(*), {money('grand_total')} FROM invoices GROUP BY status
      UNION ALL SELECT 'confidence', 'mean', count(confidence), cast(round(100 * avg(confidence), 1) AS {M}) FROM invoices
      UNION ALL {of_credit}
      UNION ALL SELECT 'statement', match, count(*), {money('total_tax')} FROM ({SIMPLE_MATCH}) s GROUP BY match
      UNION ALL SELECT * FROM (SELECT 'error', code, count(*) AS n, cast(NULL AS {M}) FROM findings WHERE severity = 'ERROR' GROUP BY code ORDER BY n DESC, code LIMIT 10) e
      UNION ALL SELECT * FROM (SELECT 'vendor', name, n, spend FROM ({vendors}) w WHERE n > 0 ORDER BY n DESC, spend DESC, name LIMIT 8) t"""


def _expanding(d: Dialect) -> str:
    """How far an amount's logarithm is from the median of the vendor's earlier ones, in robust deviations of those from that moving median (0.05 where half of
    them equal it); at least five earlier ones.  No aggregate of one frame gives it, so a row sees its vendor's earlier amounts as an array."""
    order = "PARTITION BY vendor_id ORDER BY coalesce(invoice_date, created_on), created_on, invoice_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    x = "ln(1 + cast(nullif(grand_total, 0) AS double))"
    seen = f"collect_list({x}) OVER ({order})" if d.spark else f"list({x}) FILTER (grand_total <> 0) OVER ({order})"
    median = lambda xs: f"(get({xs}, (size({xs}) - 1) div 2) + get({xs}, size({xs}) div 2)) / 2" if d.spark else f"list_median({xs})"
    near = "array_sort(transform(seen, v -> abs(v - med)))" if d.spark else "[abs(v - med) for v in seen]"
    lists = f"SELECT invoice_id, {x} AS x, {'array_sort(' + seen + ')' if d.spark else seen} AS seen FROM live"
    return f"""SELECT invoice_id, CASE WHEN n >= 5 THEN round((x - med) / (14826e-4 * CASE WHEN mad > 0 THEN mad ELSE 5e-2 END), 9) END AS deviation FROM (SELECT *, {median('near')} AS mad FROM (SELECT *, {near} AS near FROM (SELECT invoice_id, x, seen, {'size(seen)' if d.spark else 'coalesce(len(seen), 0)'} AS n, {median('seen')} AS med FROM ({lists}) a) b) c) e"""


#: Alerts: name, seconds, least events, which events, by whom.  Each user is judged alone, with few events a slot; and all users together, who stand for one
#: masked address, at the application's thresholds.
ALERT_RULES = (
    ("failures", 900, 2, "event_type = 'error'", "user_id"), ("views", 3600, 3, "event_type = 'view'", "user_id"), ("purchases", 3600, 2, "event_type = 'purchase'", "user_id"),
    ("all_failures", 900, 5, "event_type = 'error'", "0"), ("all_views", 3600, 200, "event_type = 'view'", "0"), ("all_deletions", 3600, 5, "event_type = 'purchase'", "0"),
)


QUERIES: dict[str, Template] = {
    # sources and filters
    "src_table": "SELECT invoice_id, vendor_id, invoice_number, invoice_date, status, grand_total FROM invoices",
    "flt_list": "SELECT invoice_id, invoice_number, status, created_on FROM invoices WHERE status = 'NEEDS_REVIEW' ORDER BY created_on DESC, invoice_id LIMIT 50 OFFSET 50",
    "flt_by_id": "SELECT invoice_id, invoice_number, status, grand_total FROM invoices WHERE invoice_id = 77",
    "flt_assess": "SELECT invoice_id, itc_status, at_risk_itc, total_itc FROM credit WHERE itc_status = 'NOT_IN_2B' ORDER BY at_risk_itc DESC, total_itc DESC, invoice_id LIMIT 100",
    "flt_records": "SELECT record_id, supplier_gstin, invoice_number, cast(taxable_value + total_tax AS decimal(18,2)) AS total FROM records WHERE return_period = '2001-03'",
    "flt_missing_2b": "SELECT i.invoice_id, i.invoice_date, i.grand_total, c.at_risk_itc FROM invoices i LEFT JOIN credit c ON i.invoice_id = c.invoice_id WHERE i.gstr2b_status = 'MISSING_IN_2B'",
    "flt_search": f"""SELECT invoice_id, vendor_name, grand_total FROM invoices i WHERE (instr(lower(vendor_name), '00001') > 0 OR instr(lower(vendor_gstin), '00001') > 0) AND grand_total BETWEEN 1000 AND 900000 AND gstr2b_status = 'IN_2B'
      AND einvoice_status <> 'MISMATCH' AND EXISTS (SELECT 1 FROM findings f WHERE f.invoice_id = i.invoice_id AND f.severity = 'ERROR') AND EXISTS (SELECT 1 FROM invoice_lines l WHERE l.invoice_id = i.invoice_id AND l.gst_rate = 18)
      ORDER BY grand_total DESC, invoice_id LIMIT 200""",
    "flt_period": "SELECT p.period, p.first_day, p.last_day, cast(coalesce(sum(i.n), 0) AS bigint) AS invoices FROM (VALUES ('all', cast(NULL AS date), cast(NULL AS date)), " + ", ".join(f"('{k}', {a}, {b})" for k, (a, b) in PERIODS.items())
    + ") AS p(period, first_day, last_day) LEFT JOIN (SELECT invoice_date, count(*) AS n FROM invoices GROUP BY invoice_date) i ON p.first_day IS NULL OR i.invoice_date BETWEEN p.first_day AND p.last_day GROUP BY p.period, p.first_day, p.last_day",
    "flt_in_period": "SELECT invoice_id, invoice_date FROM invoices WHERE invoice_date BETWEEN date '2000-04-01' AND date '2001-03-31'",
    "flt_live": "SELECT invoice_id, status FROM live",
    "flt_events": "SELECT event_id, user_id, event_type, cast(ts AS date) AS on_day FROM events WHERE event_type = 'error' AND cast(ts AS date) >= date '2024-01-20' ORDER BY event_id DESC LIMIT 100",
    "flt_queue": f"SELECT record_id AS id, match, {QUEUE} AS resolution FROM ({SIMPLE_MATCH}) m WHERE match <> 'MATCHED' UNION ALL SELECT invoice_id, 'MISSING_IN_2B', 'open' FROM live WHERE gstr2b_status = 'MISSING_IN_2B'",
    "flt_bills_search": "SELECT invoice_id, hay FROM (SELECT i.invoice_id, lower(i.vendor_name || ' ' || coalesce(i.invoice_number, '') || ' ' || l.description) AS hay FROM invoices i JOIN invoice_lines l ON i.invoice_id = l.invoice_id) h WHERE instr(hay, 'team') > 0 AND instr(hay, 'customer') > 0",
    # joins
    "jn_inner": f"SELECT i.status, l.gst_rate, count(*) AS lines, {money('l.taxable_value')} AS taxable FROM invoice_lines l JOIN invoices i ON l.invoice_id = i.invoice_id GROUP BY i.status, l.gst_rate",
    "jn_left": "SELECT i.invoice_id, c.itc_status, f.n FROM invoices i LEFT JOIN credit c ON i.invoice_id = c.invoice_id LEFT JOIN (SELECT invoice_id, count(*) AS n FROM findings GROUP BY invoice_id) f ON i.invoice_id = f.invoice_id",
    "jn_fanout": f"SELECT v.vendor_id, count(i.invoice_id) AS invoices, {money('i.grand_total')} AS spend, count(f.code) AS errors FROM vendors v LEFT JOIN invoices i ON v.vendor_id = i.vendor_id LEFT JOIN findings f ON i.invoice_id = f.invoice_id AND f.severity = 'ERROR' GROUP BY v.vendor_id",
    "jn_softfk": "SELECT i.invoice_id, r.record_id, r.total_tax FROM invoices i LEFT JOIN records r ON i.invoice_id * 2 = r.record_id",
    "jn_semi": "SELECT vendor_id, gstin FROM vendors v WHERE EXISTS (SELECT 1 FROM live i WHERE i.vendor_id = v.vendor_id AND i.gstr2b_status = 'MISSING_IN_2B')",
    "jn_anti_books": "SELECT record_id, supplier_gstin, invoice_number FROM records r WHERE NOT EXISTS (SELECT 1 FROM live i WHERE i.vendor_gstin_true = r.supplier_gstin AND i.invoice_number = r.invoice_number)",
    "jn_anti_2b": "SELECT invoice_id FROM live i WHERE invoice_date BETWEEN date '2001-03-01' AND date '2001-03-31' AND NOT EXISTS (SELECT 1 FROM records r WHERE r.supplier_gstin = i.vendor_gstin_true AND r.invoice_number = i.invoice_number)",
    "jn_cross_gstin": lambda d: f"""SELECT r.record_id, min(i.invoice_id) AS invoice_id FROM records r JOIN live i ON {normal_number(d, 'r.invoice_number')} = {normal_number(d, 'i.invoice_number')} AND r.invoice_date = i.invoice_date
      WHERE upper(r.supplier_gstin) <> upper(i.vendor_gstin_true) AND {close('r.taxable_value', 'i.subtotal', '1.00')} AND {close('r.total_tax', 'i.total_tax', '1.00')} GROUP BY r.record_id""",
    # a slot of the band's width meets itself and its neighbours, so a vendor's pairs are not all tried
    "jn_band_dup": lambda d: _banded(d, "live", 180, "a.invoice_id AS invoice_a, b.invoice_id AS invoice_b") + " UNION SELECT a.invoice_id, b.invoice_id FROM live a JOIN live b ON a.document_hash = b.document_hash AND a.invoice_id < b.invoice_id",
    "jn_band_dup3": lambda d: _banded(d, "invoices", 3, f"a.invoice_id AS invoice_a, b.invoice_id AS invoice_b, abs({d.days('a.invoice_date', 'b.invoice_date')}) AS gap"),
    "jn_longest_prefix": "SELECT pattern, action, category, count(*) AS lines, cast(sum(tax) AS decimal(18,2)) AS tax FROM restricted_lines WHERE pattern IS NOT NULL AND substr(hsn_sac, 1, length(pattern)) = pattern GROUP BY pattern, action, category",
    "jn_first_keyword": "SELECT pattern, action, category, count(*) AS lines FROM restricted_lines WHERE pattern IS NOT NULL AND instr(lower(description), pattern) > 0 GROUP BY pattern, action, category",
    "jn_hsn_fallback": "SELECT l.hsn_sac, coalesce(h8.rates, h6.rates, h4.rates, h2.rates) AS rates, count(*) AS lines FROM invoice_lines l " + " ".join(f"LEFT JOIN hsn_reference h{n} ON substr(l.hsn_sac, 1, {n}) = h{n}.code" for n in (8, 6, 4, 2)) + " GROUP BY l.hsn_sac, coalesce(h8.rates, h6.rates, h4.rates, h2.rates)",
    "jn_hsn_allprefix": "SELECT l.hsn_sac, " + "coalesce(" + ", ".join(f"h{n}.code" for n in range(8, 1, -1)) + ") AS code, count(*) AS lines FROM invoice_lines l " + " ".join(f"LEFT JOIN hsn_reference h{n} ON length(l.hsn_sac) >= {n} AND substr(l.hsn_sac, 1, {n}) = h{n}.code" for n in range(8, 1, -1)) + " GROUP BY 1, 2",
    "jn_asof_slab": "SELECT i.invoice_id, s.name AS slab FROM invoices i LEFT JOIN (VALUES ('old', date '1990-01-01', date '1998-03-31'), ('new', date '1998-04-01', date '2999-12-31')) AS s(name, first_day, last_day) ON i.invoice_date BETWEEN s.first_day AND s.last_day",
    # aggregates
    "agg_status": f"SELECT status, count(*) AS invoices, {money('grand_total')} AS total, round(avg(confidence), 6) AS avg_confidence FROM invoices GROUP BY status",
    "agg_daily": """SELECT created_on, invoices, approved, in_review FROM (SELECT created_on, count(*) AS invoices, count(CASE WHEN status IN ('APPROVED', 'AUTO_APPROVED') THEN 1 END) AS approved, count(CASE WHEN status = 'NEEDS_REVIEW' THEN 1 END) AS in_review,
      row_number() OVER (ORDER BY created_on DESC) AS k FROM invoices GROUP BY created_on) x WHERE k <= 30""",
    "agg_rate": f"SELECT gst_rate, count(DISTINCT l.invoice_id) AS invoices, {money('taxable_value')} AS taxable, {money('coalesce(cgst, 0) + coalesce(sgst, 0) + coalesce(igst, 0)')} AS gst FROM invoice_lines l JOIN invoices i ON l.invoice_id = i.invoice_id WHERE i.status IN ('APPROVED', 'AUTO_APPROVED') GROUP BY gst_rate",
    "agg_hsn": f"SELECT hsn_sac, count(*) AS lines, {money('taxable_value')} AS taxable, round(avg(cast(gst_rate AS double)), 6) AS avg_rate FROM invoice_lines GROUP BY hsn_sac ORDER BY taxable DESC NULLS LAST, hsn_sac LIMIT 20",
    "agg_vendor_spend": f"SELECT v.vendor_id, v.vendor_name, count(*) AS invoices, {money('grand_total')} AS spend, round(cast({money('grand_total')} AS double) / nullif(count(grand_total), 0), 9) AS avg_value FROM vendors v JOIN invoices i ON v.vendor_id = i.vendor_id GROUP BY v.vendor_id, v.vendor_name ORDER BY spend DESC NULLS LAST, v.vendor_id LIMIT 20",
    "agg_vendor_spend_fanout": f"SELECT v.vendor_id, count(i.invoice_id) AS invoices, {money('i.grand_total')} AS spend, round(cast({money('i.grand_total')} AS double) / nullif(count(i.grand_total), 0), 9) AS avg_value, count(CASE WHEN f.severity = 'ERROR' THEN 1 END) AS errors FROM vendors v LEFT JOIN invoices i ON v.vendor_id = i.vendor_id LEFT JOIN findings f ON i.invoice_id = f.invoice_id GROUP BY v.vendor_id",
    "agg_findings": "SELECT code, category, severity, count(*) AS n, count(DISTINCT invoice_id) AS invoices FROM findings GROUP BY code, category, severity ORDER BY n DESC, code LIMIT 20",
    "agg_recon": f"SELECT match, count(*) AS n, {money('coalesce(taxable_value, 0)')} AS taxable FROM ({SIMPLE_MATCH}) m GROUP BY match",
    "agg_dup_findings": "SELECT invoice_id, invoice_number, created_on FROM invoices WHERE possible_duplicate ORDER BY created_on DESC, invoice_id LIMIT 50",
    "agg_review_queue": "SELECT i.invoice_id, count(*) FILTER (WHERE f.severity = 'ERROR') AS errors, count(*) FILTER (WHERE f.severity = 'WARNING') AS warnings FROM invoices i LEFT JOIN findings f ON i.invoice_id = f.invoice_id WHERE i.status = 'NEEDS_REVIEW' GROUP BY i.invoice_id",
    "agg_job_health": lambda d: f"SELECT event_type AS stage, user_id % 3 AS state, count(*) AS n, round(avg(value), 6) AS avg_value, max({d.slot('ts', 1)}) - min({d.slot('ts', 1)}) AS span_s FROM events GROUP BY event_type, user_id % 3",
    "agg_itc_status": f"SELECT coalesce(itc_status, 'TOTAL') AS itc_status, count(*) AS n, {', '.join(f'{money(c)} AS {c}' for c in ('total_itc', 'eligible_itc', 'blocked_itc', 'review_itc', 'at_risk_itc'))}, {money('at_risk_itc + review_itc')} AS credit_at_risk FROM credit GROUP BY ROLLUP (itc_status)",
    "agg_itc_month": f"SELECT month, total_itc, eligible_itc, at_risk_itc FROM (SELECT {MONTH} AS month, {money('total_itc')} AS total_itc, {money('eligible_itc')} AS eligible_itc, {money('at_risk_itc')} AS at_risk_itc, row_number() OVER (ORDER BY {MONTH} DESC) AS k FROM credit WHERE invoice_date IS NOT NULL GROUP BY {MONTH}) m WHERE k <= 12",
    "agg_imports": f"""SELECT m.return_period, m.n, m.tax, m.matched, m.mismatched, m.missing_in_books, coalesce(x.missing, 0) AS missing_in_2b FROM (SELECT return_period, count(*) AS n, {money('total_tax')} AS tax, count(CASE WHEN match = 'MATCHED' THEN 1 END) AS matched,
      count(CASE WHEN match IN ('AMOUNT_MISMATCH', 'DATE_MISMATCH') THEN 1 END) AS mismatched, count(CASE WHEN match = 'MISSING_IN_BOOKS' THEN 1 END) AS missing_in_books FROM ({SIMPLE_MATCH}) s GROUP BY return_period) m
      LEFT JOIN (SELECT {MONTH} AS month, count(*) AS missing FROM live WHERE gstr2b_status = 'MISSING_IN_2B' GROUP BY {MONTH}) x ON m.return_period = x.month""",
    "agg_einvoice": "SELECT coalesce(einvoice_status, 'NOT_SCANNED') AS einvoice_status, count(*) AS n FROM invoices GROUP BY coalesce(einvoice_status, 'NOT_SCANNED')",
    "agg_vendor_risk": _vendor_risk,
    "agg_kpis": f"SELECT {KPI}, (SELECT {money('eligible_itc')} FROM credit) AS eligible_itc, (SELECT {money('at_risk_itc + review_itc')} FROM credit) AS at_risk, (SELECT count(*) FROM findings WHERE severity = 'ERROR') AS errors FROM live",
    "agg_kpis_period": _period_kpis,
    "agg_monthly": f"SELECT month, invoices, spend, gst, eligible FROM (SELECT {MONTH} AS month, count(*) AS invoices, {money('i.grand_total')} AS spend, {money('i.total_tax')} AS gst, {money('c.eligible_itc')} AS eligible, row_number() OVER (ORDER BY {MONTH.replace('invoice_date', 'i.invoice_date')} DESC) AS k FROM live i LEFT JOIN (SELECT invoice_id AS id, eligible_itc FROM credit) c ON i.invoice_id = c.id WHERE i.invoice_date IS NOT NULL GROUP BY {MONTH.replace('invoice_date', 'i.invoice_date')}) m WHERE k <= 12".replace(f"SELECT {MONTH} AS month, count", f"SELECT {MONTH.replace('invoice_date', 'i.invoice_date')} AS month, count"),
    "agg_vendor_profile": lambda d: f"""SELECT i.vendor_id, count(*) AS invoices, {money('i.grand_total')} AS spend, cast(coalesce(sum(f.errors), 0) AS bigint) AS errors, count(CASE WHEN i.gstr2b_status = 'MISSING_IN_2B' THEN 1 END) AS missing, count(CASE WHEN i.einvoice_status = 'MISMATCH' THEN 1 END) AS bad_qr, {money('c.at_risk_itc')} AS at_risk,
      cast(2 * coalesce(sum(f.errors), 0) + 3 * count(CASE WHEN i.gstr2b_status = 'MISSING_IN_2B' THEN 1 END) + 5 * count(CASE WHEN i.einvoice_status = 'MISMATCH' THEN 1 END) + 2 * CASE WHEN sum(c.at_risk_itc) > 0 THEN 1 ELSE 0 END AS bigint) AS attention, min(i.invoice_date) AS first_seen, max(i.invoice_date) AS last_seen, max(q.repeated) AS repeated
      FROM live i LEFT JOIN (SELECT invoice_id, count(*) AS errors FROM findings WHERE severity = 'ERROR' GROUP BY invoice_id) f ON i.invoice_id = f.invoice_id LEFT JOIN credit c ON i.invoice_id = c.invoice_id
      LEFT JOIN (SELECT vendor_id, {d.distinct_text('code')} AS repeated FROM (SELECT i.vendor_id, f.code FROM findings f JOIN live i ON f.invoice_id = i.invoice_id GROUP BY i.vendor_id, f.code HAVING count(*) > 1) z GROUP BY vendor_id) q ON i.vendor_id = q.vendor_id GROUP BY i.vendor_id""",
    "agg_vendor_detail": f"SELECT vendor_id, {MONTH} AS month, count(*) AS invoices, {money('grand_total')} AS spend FROM live WHERE invoice_date IS NOT NULL GROUP BY vendor_id, {MONTH}",
    "agg_report": _report(),
    "agg_feedback": f"SELECT source AS field, count(*) AS reviewed, count(CASE WHEN quality = 0 THEN 1 END) AS corrected, {share('100 * count(CASE WHEN quality = 1 THEN 1 END)', 'count(*)', 2)} AS accuracy FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY source HAVING count(*) >= 20",
    "agg_2b_metrics": f"SELECT count(CASE WHEN match = 'MATCHED' THEN 1 END) AS matched, count(CASE WHEN match = 'MISSING_IN_BOOKS' THEN 1 END) AS unmatched, count(CASE WHEN match = 'AMOUNT_MISMATCH' THEN 1 END) AS mismatched, {money('CASE WHEN match = ' + chr(39) + 'AMOUNT_MISMATCH' + chr(39) + ' THEN abs(taxable_value - book_taxable) END')} AS taxable_diff, {money('CASE WHEN match = ' + chr(39) + 'AMOUNT_MISMATCH' + chr(39) + ' THEN abs(total_tax - book_tax) END')} AS tax_diff FROM ({SIMPLE_MATCH}) m",
    "agg_action_center": f"SELECT kind, n, amount, round(weight + 10 * log10(1 + cast(amount AS double)), 1) AS priority FROM (SELECT match AS kind, count(*) AS n, {money('abs(coalesce(total_tax - book_tax, total_tax))')} AS amount, CASE match WHEN 'MISSING_IN_BOOKS' THEN 30 WHEN 'AMOUNT_MISMATCH' THEN 25 ELSE 10 END AS weight FROM ({SIMPLE_MATCH}) m WHERE match <> 'MATCHED' GROUP BY match) a",
    "agg_unresolved_vendor": lambda d: f"SELECT supplier_gstin, count(*) AS open_items, {d.distinct_text('match')} AS kinds FROM ({SIMPLE_MATCH}) m WHERE match <> 'MATCHED' GROUP BY supplier_gstin ORDER BY open_items DESC, supplier_gstin LIMIT 5",
    "agg_tax_diff": f"SELECT {money('abs(total_tax - book_tax)')} AS tax_diff FROM ({SIMPLE_MATCH}) m WHERE match = 'AMOUNT_MISMATCH'",
    "agg_repeated": "SELECT i.vendor_id, f.code, count(*) AS n FROM findings f JOIN live i ON f.invoice_id = i.invoice_id GROUP BY i.vendor_id, f.code HAVING count(*) > 1",
    "agg_review_list": lambda d: f"SELECT i.invoice_id, i.confidence, {d.distinct_text('f.code')} AS codes FROM invoices i LEFT JOIN findings f ON i.invoice_id = f.invoice_id AND f.severity = 'ERROR' WHERE i.status = 'NEEDS_REVIEW' GROUP BY i.invoice_id, i.confidence",
    "agg_brief": "SELECT severity, count(*) AS n, count(DISTINCT invoice_id) AS invoices FROM findings GROUP BY severity",
    "agg_events": "SELECT event_type AS action, CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS outcome, count(*) AS n FROM events WHERE cast(ts AS date) >= date '2024-01-29' GROUP BY event_type",
    "agg_alerts": lambda d: " UNION ALL ".join(f"SELECT '{k}' AS rule, x.* FROM ({per_event(d, s, n, t, a)}) x" for k, s, n, t, a in ALERT_RULES),
    "agg_score": f"SELECT {share('100 * sum(w * passed)', 'sum(w)', 3)} AS score FROM (SELECT 3 AS w, CASE WHEN count(*) > 0 THEN 1 ELSE 0 END AS passed FROM invoices UNION ALL SELECT 2, CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM findings UNION ALL SELECT 5, 1) c",
    "agg_snapshot": f"SELECT {money('CASE WHEN ' + MONTH + ' = ' + chr(39) + '2001-07' + chr(39) + ' THEN grand_total END')} AS month_spend, {money('grand_total')} AS total_spend, {money('CASE WHEN payment_date IS NULL THEN grand_total END')} AS owed, count(CASE WHEN payment_date IS NULL AND invoice_date < date '2001-03-05' THEN 1 END) AS overdue FROM live",
    "agg_deduction": f"SELECT c_mktsegment AS category, {money('grand_total')} AS amount FROM live JOIN customer ON vendor_id = c_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY c_mktsegment",
    "agg_unpaid": lambda d: f"SELECT invoice_id, grand_total, greatest({d.days('invoice_date', TODAY)} - 30, 0) AS days_overdue FROM live WHERE payment_date IS NULL AND invoice_date IS NOT NULL",
    "agg_field_accuracy": f"SELECT lang, source, count(*) AS n, {share('sum(quality)', 'count(*)')} AS accuracy FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY lang, source",
    # windows
    "win_order": f"SELECT invoice_id, row_number() OVER ({PRIOR}) AS place FROM live",
    "win_prior_count": f"SELECT invoice_id, row_number() OVER ({PRIOR}) - 1 AS prior FROM live",
    "win_prior_30d": """SELECT invoice_id, in_range - later AS prior_30d FROM (SELECT invoice_id, count(*) OVER (PARTITION BY vendor_id ORDER BY on_day RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW) AS in_range,
      count(*) OVER (PARTITION BY vendor_id, on_day ORDER BY created_on, invoice_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS later FROM (SELECT *, coalesce(invoice_date, created_on) AS on_day FROM live) l) w""",
    "win_gap_prev": lambda d: f"SELECT invoice_id, round(ln(1 + {d.days('before', 'on_day')}), 9) AS log_gap FROM (SELECT invoice_id, coalesce(invoice_date, created_on) AS on_day, lag(coalesce(invoice_date, created_on)) OVER ({PRIOR}) AS before FROM live) w",
    "win_expand_median": lambda d: f"SELECT invoice_id, CASE WHEN n >= 5 THEN round(m, 9) END AS median_before FROM (SELECT invoice_id, count(grand_total) OVER ({FRAME}) AS n, {d.framed_median('ln(1 + cast(grand_total AS double))', FRAME)} AS m FROM live) w",
    "win_expand_mad": _expanding,
    "win_prior_rate": f"SELECT invoice_id, CASE WHEN prior >= 5 THEN round(bad / cast(prior AS double), 9) END AS rate FROM (SELECT invoice_id, count(*) OVER ({FRAME}) AS prior, coalesce(sum(CASE WHEN gstr2b_status = 'MISSING_IN_2B' THEN 1 ELSE 0 END) OVER ({FRAME}), 0) AS bad FROM live) w",
    "win_freq": "SELECT invoice_id, n FROM (SELECT invoice_id, count(*) OVER (PARTITION BY vendor_id, invoice_date) AS n FROM live WHERE invoice_date IS NOT NULL) w WHERE n >= 3",
    "win_first_seen": lambda d: f"SELECT record_id, first_id FROM (SELECT record_id, first_value(record_id) OVER (PARTITION BY supplier_gstin, number ORDER BY record_id) AS first_id FROM (SELECT *, {normal_number(d, 'invoice_number')} AS number FROM records) r WHERE number <> '') w WHERE record_id <> first_id",
    # places from the days' counts, so that no task ranks the whole queue
    "win_position": "SELECT invoice_id, before + 1 AS place FROM (SELECT invoice_id, created_on AS day FROM invoices WHERE status = 'NEEDS_REVIEW') i JOIN (SELECT created_on, sum(n) OVER (ORDER BY created_on) - n AS before FROM (SELECT created_on, count(*) AS n FROM invoices WHERE status = 'NEEDS_REVIEW' GROUP BY created_on) d) c ON i.day = c.created_on",
    # a window inside each band of amounts, behind the counts of the bands before it
    "win_pct_ref": f"""SELECT a.invoice_id, round(100 * (b.before + a.within) / cast(b.total AS double), 6) AS percentile
      FROM (SELECT invoice_id, status, {BAND} AS band, count(*) OVER (PARTITION BY status, {BAND} ORDER BY grand_total) AS within FROM live WHERE grand_total IS NOT NULL) a
      JOIN (SELECT status, band, sum(n) OVER (PARTITION BY status ORDER BY band) - n AS before, sum(n) OVER (PARTITION BY status) AS total FROM (SELECT status, {BAND} AS band, count(*) AS n FROM live WHERE grand_total IS NOT NULL GROUP BY status, {BAND}) c) b
      ON a.status = b.status AND a.band = b.band""",
    "win_lag_pct": f"SELECT month, spend, {share('100 * (spend - before)', 'before', 4)} AS change_pct FROM (SELECT *, lag(spend) OVER (ORDER BY month) AS before FROM (SELECT {MONTH} AS month, {money('grand_total')} AS spend FROM live WHERE invoice_date IS NOT NULL GROUP BY {MONTH}) m) w",
    "win_last_n": f"SELECT month, n FROM (SELECT {MONTH} AS month, count(*) AS n, row_number() OVER (ORDER BY {MONTH} DESC) AS k FROM live WHERE invoice_date IS NOT NULL GROUP BY {MONTH}) w WHERE k <= 6",
    "win_next_no": "SELECT 'INV/' || lpad(cast(max(cast(substr(invoice_number, 5, 8) AS bigint)) + 1 AS string), 8, '0') AS next_number FROM invoices",
    "win_cumulative": "SELECT vendor_id, instalment, cast(paid - coalesce(lag(paid) OVER (PARTITION BY vendor_id ORDER BY instalment), 0) AS decimal(18,2)) AS due FROM (SELECT vendor_id, instalment, cast(sum(total_tax) * cast(share AS decimal(3,2)) AS decimal(18,2)) AS paid FROM live CROSS JOIN (VALUES (1, '0.15'), (2, '0.45'), (3, '0.75'), (4, '1.00')) AS s(instalment, share) GROUP BY vendor_id, instalment, share) w",
    # sorts, sets
    "srt_multi": "SELECT code, severity, n FROM (SELECT code, severity, count(*) AS n FROM findings GROUP BY code, severity) f ORDER BY CASE severity WHEN 'ERROR' THEN 0 ELSE 1 END, n DESC, code",
    "srt_topk": "SELECT vendor_id, spend FROM (SELECT vendor_id, cast(sum(grand_total) AS decimal(18,2)) AS spend FROM live GROUP BY vendor_id) v ORDER BY spend DESC NULLS LAST, vendor_id LIMIT 10",
    "srt_page": "SELECT invoice_id FROM invoices ORDER BY created_on DESC, invoice_id LIMIT 20 OFFSET 40",
    "srt_nulls": "SELECT invoice_id, subtotal FROM invoices ORDER BY subtotal DESC NULLS LAST, invoice_id LIMIT 100",
    "set_union_queue": "SELECT record_id AS id, 'record' AS kind FROM records WHERE return_period = '2001-03' UNION ALL SELECT invoice_id, 'invoice' FROM live WHERE gstr2b_status = 'MISSING_IN_2B'",
    "set_union_ids": "SELECT invoice_id FROM live WHERE gstr2b_status = 'MISSING_IN_2B' UNION SELECT invoice_id FROM findings WHERE severity = 'ERROR'",
    "set_diff_codes": "SELECT code FROM findings WHERE severity = 'ERROR' EXCEPT SELECT code FROM findings f JOIN invoices i ON f.invoice_id = i.invoice_id WHERE i.status = 'REJECTED'",
    # scalars
    "fn_norm_no": lambda d: f"SELECT record_id, {normal_number(d, 'invoice_number')} AS number FROM records",
    "fn_docno": lambda d: f"SELECT record_id, {d.replace('upper(invoice_number)', '[^A-Z0-9]', '')} AS number FROM records",
    "fn_rel_diff": "SELECT r.record_id, round(abs(cast(r.total_tax AS double) - cast(i.total_tax AS double)) / greatest(abs(cast(r.total_tax AS double)), abs(cast(i.total_tax AS double)), 1e0), 9) AS rel_diff FROM records r JOIN invoices i ON r.record_id = i.invoice_id * 2",
    "fn_close_match": f"SELECT r.record_id, coalesce({close('r.total_tax', 'i.total_tax', '1.00')}, r.total_tax IS NULL AND i.total_tax IS NULL) AS agrees FROM records r JOIN invoices i ON r.record_id = i.invoice_id * 2",
    "fn_close_valid": f"SELECT invoice_id, coalesce({close('subtotal', 's_taxable', '1.00')}, false) AS agrees FROM invoices",
    "fn_tol": "SELECT invoice_id, greatest(cast(0.05 AS decimal(18,5)), cast(abs(subtotal) * cast(0.001 AS decimal(5,3)) AS decimal(18,5))) AS tol FROM invoices",
    "fn_gstin_regex": lambda d: f"SELECT invoice_id, {d.matches('vendor_gstin', GSTIN_PATTERN)} AS well_formed, {d.matches('vendor_gstin', GSTIN_PATTERN_STRICT)} AS strict FROM invoices",
    "fn_gstin_checksum": lambda d: f"SELECT invoice_id, substr(vendor_gstin, 15, 1) = {check_digit('vendor_gstin')} AS checksum_ok FROM invoices WHERE {d.matches('vendor_gstin', GSTIN_PATTERN)}",
    "fn_gstin_state": "SELECT invoice_id, substr(vendor_gstin, 1, 2) AS state, substr(vendor_gstin, 3, 10) AS pan FROM invoices",
    "fn_dec_portal": "SELECT event_id, coalesce(try_cast(substr(props, 7, 3) AS decimal(14,2)), 0) AS amount FROM events",
    "fn_inr": lambda d: f"SELECT invoice_id, '₹' || CASE WHEN length(w) <= 3 THEN w ELSE {d.replace('reverse(' + d.replace('substr(reverse(w), 4)', '([0-9]{2})', '<1>,') + ')', '^,', '')} || ',' || substr(w, length(w) - 2) END || '.' || f AS amount FROM (SELECT invoice_id, split_part(cast(grand_total AS string), '.', 1) AS w, split_part(cast(grand_total AS string), '.', 2) AS f FROM invoices WHERE grand_total IS NOT NULL) a",
    "fn_mask_ip": lambda d: f"SELECT event_id, {d.replace('ip', '^([0-9]+[.][0-9]+)[.].*$', '<1>.x.x')} AS masked FROM (SELECT event_id, '10.' || cast(user_id % 250 AS string) || '.' || cast(event_id % 250 AS string) || '.7' AS ip FROM events) e",
    "fn_classify_req": "SELECT event_id, CASE WHEN event_type IN ('signup', 'error') THEN 'auth' WHEN event_type IN ('view', 'click') THEN 'access' ELSE 'change' END AS kind, CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS outcome FROM events",
    "fn_num_factcheck": lambda d: f"""SELECT doc_id, count(*) AS numbers, count(CASE WHEN NOT small AND NOT known THEN 1 END) AS unsupported FROM (SELECT doc_id, n = cast(doc_id AS string) OR n = cast(n_chars AS string) AS known,
      instr(n, '.') = 0 AND ({d.replace('n', '^0+', '')} IN ('', {', '.join(f"'{i}'" for i in range(1, 13))}) OR (length({d.replace('n', '^0+', '')}) = 4 AND {d.replace('n', '^0+', '')} BETWEEN '1900' AND '2100')) AS small
      FROM (SELECT doc_id, n_chars, CASE WHEN instr(m, '.') > 0 THEN {d.replace('m', '[.]?0+$', '')} ELSE m END AS n FROM (SELECT doc_id, n_chars, replace(n, ',', '') AS m FROM (SELECT doc_id, n_chars, {"explode(regexp_extract_all(text, '[0-9][0-9,]*([.][0-9]+)?', 0))" if d.spark else "unnest(regexp_extract_all(text, '[0-9][0-9,]*([.][0-9]+)?'))"} AS n FROM documents) x) y) z) w GROUP BY doc_id""",
    "fn_sha256": lambda d: f"SELECT doc_id, {'sha2(text, 256)' if d.spark else 'sha256(text)'} AS digest FROM documents",
    "fn_anonymise": lambda d: f"SELECT doc_id, {d.replace(d.replace('text', '[A-Za-z0-9._+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]+', 'user@example.com'), '[0-9]{10}', '9000000000')} AS text FROM documents",
    "fn_deadline_16_4": "SELECT invoice_id, make_date(cast(year(invoice_date) AS int) + CASE WHEN month(invoice_date) >= 4 THEN 1 ELSE 0 END, 11, 30) AS deadline FROM invoices WHERE invoice_date IS NOT NULL",
    "fn_slab_status": f"SELECT gst_rate, CASE WHEN gst_rate IN (0, 5, 18, 40) THEN 'ok' WHEN gst_rate IN (12, 28) THEN 'legacy_after_cutover' WHEN gst_rate IN ({STANDARD_RATES}) THEN 'special' ELSE 'invalid' END AS slab, count(*) AS lines FROM invoice_lines GROUP BY gst_rate",
    "fn_std_rate": f"SELECT gst_rate, gst_rate IN ({STANDARD_RATES}) AS standard, count(*) AS lines FROM invoice_lines GROUP BY gst_rate",
    "fn_hsn_format": lambda d: f"SELECT hsn_sac, {d.matches('hsn_sac', '^([0-9]{2}|[0-9]{4}|[0-9]{6}|[0-9]{8})$')} AS shaped, count(*) AS lines FROM invoice_lines GROUP BY hsn_sac",
    "fn_hsn_structure": "SELECT hsn_sac, CASE WHEN hsn_sac IS NULL THEN 'missing' WHEN try_cast(hsn_sac AS bigint) IS NULL THEN 'not_digits' WHEN substr(hsn_sac, 1, 2) = '99' THEN CASE WHEN length(hsn_sac) = 6 THEN 'sac' ELSE 'sac_length' END WHEN length(hsn_sac) NOT IN (4, 6, 8) THEN 'hsn_length' WHEN substr(hsn_sac, 1, 2) IN ('00', '77', '98') THEN 'chapter' ELSE 'hsn' END AS kind, count(*) AS lines FROM invoice_lines GROUP BY hsn_sac",
    "fn_supply_type": "SELECT invoice_id, CASE WHEN vendor_gstin IS NULL THEN 'unknown' WHEN substr(vendor_gstin, 1, 2) = substr(buyer_gstin, 1, 2) THEN 'intra' ELSE 'inter' END AS supply FROM invoices",
    "fn_priority": "SELECT invoice_id, round(CASE WHEN gstr2b_status = 'MISSING_IN_2B' THEN 30 ELSE 10 END + 10 * log10(1 + cast(coalesce(grand_total, 0) AS double)), 1) AS priority FROM live",
    "fn_category": "SELECT invoice_id, line_no, CASE WHEN substr(hsn_sac, 1, 4) = '8703' THEN 'vehicles' WHEN substr(hsn_sac, 1, 2) = '99' THEN 'services' WHEN instr(lower(description), 'lunch') > 0 THEN 'food' ELSE 'other' END AS category FROM invoice_lines",
    "fn_overcharge": lambda d: f"SELECT l.invoice_id, l.line_no, {d.half_even('cast(l.taxable_value * (l.gst_rate - cast(h.rates AS decimal(5,2))) * cast(0.01 AS decimal(3,2)) AS decimal(18,4))', 2)} AS overcharge FROM invoice_lines l JOIN hsn_reference h ON substr(l.hsn_sac, 1, 4) = h.code WHERE instr(h.rates, '|') = 0 AND l.gst_rate > cast(h.rates AS decimal(5,2))",
    # rules and decisions
    "val_line": "SELECT invoice_id, line_no, split_part(mark, '|', 1) AS code, split_part(mark, '|', 2) AS severity FROM line_marks",
    "val_header": "SELECT invoice_id, split_part(mark, '|', 1) AS code, split_part(mark, '|', 2) AS severity, split_part(mark, '|', 3) AS field FROM header_marks",
    "score_conf": """SELECT invoice_id, score, CASE WHEN errors > 0 THEN 'NEEDS_REVIEW' WHEN score >= 9e-1 THEN 'AUTO_APPROVED' ELSE 'NEEDS_REVIEW' END AS decision FROM (SELECT i.invoice_id, coalesce(f.errors, 0) AS errors,
      round(greatest(0e0, least(1e0, i.confidence - least(1e0, 25e-2 * coalesce(f.errors, 0) + 8e-2 * coalesce(f.warnings, 0)))), 4) AS score FROM invoices i LEFT JOIN (SELECT invoice_id, count(CASE WHEN severity = 'ERROR' THEN 1 END) AS errors, count(CASE WHEN severity = 'WARNING' THEN 1 END) AS warnings FROM findings GROUP BY invoice_id) f ON i.invoice_id = f.invoice_id) s""",
    "itc_assess": "SELECT invoice_id, itc_status, total_itc, eligible_itc, blocked_itc, review_itc, at_risk_itc, claim_deadline, payment_due_by, reasons FROM credit",
    "itc_build": "SELECT i.invoice_id, cast(coalesce(l.tax, i.total_tax, 0) AS decimal(14,2)) AS tax FROM invoices i LEFT JOIN (SELECT invoice_id, sum(coalesce(cgst, 0) + coalesce(sgst, 0) + coalesce(igst, 0)) AS tax FROM invoice_lines GROUP BY invoice_id) l ON i.invoice_id = l.invoice_id",
    "what_if": f"SELECT itc_status, {money('eligible_itc')} AS now, {money('cast(eligible_itc * cast(0.80 AS decimal(3,2)) AS decimal(18,2))')} AS scaled, {money('eligible_itc - cast(eligible_itc * cast(0.80 AS decimal(3,2)) AS decimal(18,2))')} AS lost FROM credit GROUP BY itc_status",
    # every invoice against the statements of the months that may hold it: from its own on, 180 days
    "recon_compare": "SELECT r.record_id, r.invoice_number = i.invoice_number AS number_ok, r.invoice_date = i.invoice_date AS date_ok, abs(r.taxable_value - i.subtotal) <= 1 AS taxable_ok, abs(r.total_tax - i.total_tax) <= 1 AS tax_ok, r.supplier_gstin = i.vendor_gstin AS gstin_ok FROM records r JOIN invoices i ON r.record_id = i.invoice_id * 2",
    "rule_text": "SELECT DISTINCT code, CASE WHEN code LIKE 'NO_PO%' THEN 'Purchase order reference' WHEN code LIKE 'HSN%' THEN 'Goods or service code' WHEN code LIKE 'LINE%' THEN 'Line arithmetic' WHEN code LIKE 'GRAND%' OR code LIKE 'HEADER%' THEN 'Totals' WHEN code LIKE 'TAX%' OR code LIKE 'CGST%' THEN 'Tax type' WHEN code LIKE '%GSTIN%' THEN 'Tax id' ELSE 'Invoice details' END AS rule FROM findings",
    "ts_monthly": lambda d: f"SELECT m.month, cast(coalesce(sum(grand_total), 0) AS decimal(18,2)) AS spend, count(invoice_id) AS invoices FROM (SELECT substr(cast(m AS string), 1, 7) AS month FROM (SELECT {'explode(sequence(lo, hi, INTERVAL 1 MONTH))' if d.spark else 'unnest(generate_series(lo, hi, INTERVAL 1 MONTH))'} AS m FROM (SELECT date_trunc('month', min(invoice_date)) AS lo, date_trunc('month', max(invoice_date)) AS hi FROM invoices) b) c) m LEFT JOIN (SELECT *, {MONTH} AS of FROM live) i ON m.month = i.of GROUP BY m.month",
    "ts_linear": f"SELECT round(regr_slope(y, x), 4) AS slope, round(regr_intercept(y, x), 2) AS intercept, count(*) AS months FROM (SELECT cast(row_number() OVER (ORDER BY month) - 1 AS double) AS x, y FROM (SELECT {MONTH} AS month, cast(cast(sum(grand_total) AS decimal(18,2)) AS double) AS y FROM live WHERE invoice_date IS NOT NULL GROUP BY {MONTH}) m) s",
    "gst_threshold": "SELECT vendor_id, turnover, turnover > 4000000 AS must_register FROM (SELECT vendor_id, cast(sum(subtotal) AS decimal(18,2)) AS turnover FROM live GROUP BY vendor_id) t",
    "sales_invoice": lambda d: "SELECT invoice_id, line_no, cgst_due, cast(tax - cgst_due AS decimal(18,2)) AS sgst_due FROM (SELECT *, cast(round(cast(tax * cast(0.5 AS decimal(2,1)) AS decimal(18,3)), 2) AS decimal(18,2)) AS cgst_due FROM (SELECT invoice_id, line_no, cast(round(cast(taxable_value * gst_rate * cast(0.01 AS decimal(3,2)) AS decimal(18,4)), 2) AS decimal(18,2)) AS tax FROM invoice_lines) a) b",
}

#: The same results said in another way, for DuckDB.
ORACLES: dict[str, Template] = {
    "jn_band_dup": "SELECT a.invoice_id AS invoice_a, b.invoice_id AS invoice_b FROM live a JOIN live b ON a.vendor_id = b.vendor_id AND a.invoice_id < b.invoice_id WHERE abs(datediff('day', a.invoice_date, b.invoice_date)) <= 180 UNION SELECT a.invoice_id, b.invoice_id FROM live a JOIN live b ON a.document_hash = b.document_hash AND a.invoice_id < b.invoice_id",
    "jn_band_dup3": "SELECT a.invoice_id AS invoice_a, b.invoice_id AS invoice_b, abs(datediff('day', a.invoice_date, b.invoice_date)) AS gap FROM invoices a JOIN invoices b ON a.vendor_id = b.vendor_id AND a.invoice_id < b.invoice_id WHERE abs(datediff('day', a.invoice_date, b.invoice_date)) <= 3",
    "win_position": "SELECT invoice_id, rank() OVER (ORDER BY created_on) AS place FROM invoices WHERE status = 'NEEDS_REVIEW'",
    "win_pct_ref": "SELECT invoice_id, round(100 * cume_dist() OVER (PARTITION BY status ORDER BY grand_total), 6) AS percentile FROM live WHERE grand_total IS NOT NULL",
}
