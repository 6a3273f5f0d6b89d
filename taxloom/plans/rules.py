"""Rule engines, review decisions, risk lists, text repair and calculators over the adapter views, as SQL for both engines.

Keys are the operator ids of the blueprint.  Texts to parse or repair are planted by key, so that each form occurs.
"""

from __future__ import annotations

from taxloom.plans.dialect import Dialect, Template
from taxloom.plans.engine import RULES_SQL
from taxloom.sources.adapters import GSTIN_PATTERN, HSN_RATES, STANDARD_RATES, TODAY, check_digit

M = "decimal(18,2)"
OUR_GSTIN = "27AAPFU0939F1ZV"
#: The first day of the tax in the alternative rules; fixed value.
TAX_LAUNCH = "date '2017-07-01'"
#: State codes and names, longest name first where one holds another; fixed values.
STATES = (("27", "maharashtra"), ("29", "karnataka"), ("33", "tamil nadu"), ("07", "delhi"), ("24", "gujarat"), ("09", "uttar pradesh"), ("12", "arunachal pradesh"), ("37", "andhra pradesh"), ("02", "himachal pradesh"), ("23", "madhya pradesh"))
#: Look-alike characters read as digits and, in letter places, as letters; fixed values.
AS_DIGIT, AS_LETTER = ("OoQDIlLSsBZzG", "0000111558226"), ("015826", "OISBZG")
#: Schemes of presumed income: receipts allowed, allowed if mostly digital, per cent of digital and of cash receipts; fixed values.
PRESUMED = (("44ADA", 5000000, 7500000, 50, 50), ("44AD", 20000000, 30000000, 6, 8))
#: Due day and cumulative per cent of the advance tax, and its least liability; fixed values.
INSTALMENTS, LEAST_LIABILITY = (("06-15", 15), ("09-15", 45), ("12-15", 75), ("03-15", 100)), 10000


def _tokens(d: Dialect) -> str:
    """Invoices with the signed QR token that each carries: a JWT of three parts whose payload holds the portal's fields as a nested JSON text.

    Some have none, one without its parts, one with a field that isn't the invoice's, or a short reference number."""
    day = "lpad(cast(day(invoice_date) AS string), 2, '0') || '/' || lpad(cast(month(invoice_date) AS string), 2, '0') || '/' || cast(year(invoice_date) AS string)"
    bs = "chr(92)"
    field = lambda name, value: f"{bs} || '\"{name}' || {bs} || '\":' || {bs} || '\"' || {value} || {bs} || '\"'"
    irn = f"CASE WHEN invoice_id % 23 = 0 THEN 'short' ELSE {'sha2(cast(invoice_id AS string), 256)' if d.spark else 'sha256(cast(invoice_id AS string))'} END"
    fields = " || ',' || ".join([
        field("SellerGstin", "CASE WHEN invoice_id % 29 = 0 THEN 'X' ELSE '' END || lower(vendor_gstin_true)"), field("BuyerGstin", "CASE WHEN invoice_id % 31 = 0 THEN 'X' ELSE '' END || buyer_gstin"), field("Irn", irn),
        field("DocNo", "CASE WHEN invoice_id % 37 = 0 THEN 'X' ELSE '' END || coalesce(replace(invoice_number, '/', '-'), '')"), field("DocDt", f"CASE WHEN invoice_id % 41 = 0 THEN '01/01/1990' ELSE coalesce({day}, '') END"),
        field("TotInvVal", "cast(coalesce(grand_total, 0) + CASE WHEN invoice_id % 43 = 0 THEN 5 WHEN invoice_id % 47 = 0 THEN 1 ELSE 0 END AS string)")])
    payload = "'{\"iss\":\"portal\",\"data\":\"{' || " + fields + " || '}\"}'"
    head = "'{\"alg\":\"RS256\"}'"
    token = f"{d.encoded(head)} || '.' || {d.encoded(payload)} || '.c2ln'"
    return f"SELECT invoice_id, vendor_gstin, buyer_gstin, invoice_number, invoice_date, grand_total, CASE WHEN invoice_id % 19 < 6 THEN NULL WHEN invoice_id % 53 = 0 THEN 'not-a-token' ELSE {token} END AS token FROM invoices"


def _decoded(d: Dialect) -> str:
    get = lambda k: d.json("body", k)
    return f"""SELECT *, {get('Irn')} AS irn, {get('SellerGstin')} AS q_seller, {get('BuyerGstin')} AS q_buyer, {get('DocNo')} AS q_number, {get('DocDt')} AS q_day, try_cast({get('TotInvVal')} AS decimal(14,2)) AS q_total
      FROM (SELECT *, CASE WHEN {d.matches('token', '^[^.]+[.][^.]+[.][^.]+$')} THEN {d.json(d.decoded("split_part(token, '.', 2)"), 'data')} END AS body FROM ({_tokens(d)}) t) u"""


def _einvoice(d: Dialect) -> str:
    number = lambda x: d.replace(f"upper({x})", "[^A-Z0-9]", "")
    day = "make_date(cast(substr(q_day, 7, 4) AS int), cast(substr(q_day, 4, 2) AS int), cast(substr(q_day, 1, 2) AS int))"
    wrong = {
        "E010": "upper(q_seller) <> upper(vendor_gstin)", "E011": "upper(q_buyer) <> upper(buyer_gstin)", "E012": f"{number('q_number')} <> {number('invoice_number')}",
        "E013": f"CASE WHEN length(q_day) = 10 THEN {day} <> invoice_date END", "E014": "abs(q_total - grand_total) > 1",
    }
    codes = ["CASE WHEN token IS NULL THEN 'E001' WHEN body IS NULL THEN 'E002' ELSE 'E004' END", f"CASE WHEN NOT {d.matches('irn', '^[0-9a-f]{64}$')} THEN 'E015' END", *[f"CASE WHEN {t} THEN '{c}' END" for c, t in wrong.items()]]
    bad = " OR ".join(f"coalesce({t}, false)" for t in wrong.values())
    return f"SELECT invoice_id, CASE WHEN token IS NULL THEN 'NO_QR' WHEN body IS NULL THEN 'MALFORMED' WHEN {bad} THEN 'MISMATCH' ELSE 'UNVERIFIED' END AS status, {d.joined(codes)} AS codes FROM ({_decoded(d)}) x"


def _alternative(d: Dialect) -> str:
    """The alternative rules' findings, line rules and header rules united."""
    tax = "(coalesce(cgst, 0) + coalesce(sgst, 0) + coalesce(igst, 0))"
    tol = lambda x: f"greatest(cast(0.05 AS decimal(18,5)), cast(abs({x}) * cast(0.001 AS decimal(5,3)) AS decimal(18,5)))"
    off = lambda a, b: f"abs({a} - {b}) > {tol(a)}"
    shape = "CASE WHEN hsn_sac IS NULL THEN 'missing' WHEN try_cast(hsn_sac AS bigint) IS NULL THEN 'bad' WHEN substr(hsn_sac, 1, 2) = '99' THEN CASE WHEN length(hsn_sac) = 6 THEN 'ok' ELSE 'bad' END WHEN length(hsn_sac) NOT IN (4, 6, 8) OR substr(hsn_sac, 1, 2) IN ('00', '77', '98') THEN 'bad' ELSE 'ok' END"
    legacy = "gst_rate IN (12, 28) AND invoice_date >= date '2025-09-22'"
    line = [
        f"CASE WHEN {off('cast(quantity * unit_price - coalesce(discount, 0) AS decimal(20,5))', 'taxable_value')} THEN 'V030' END", f"CASE WHEN gst_rate NOT IN ({STANDARD_RATES}) THEN 'V032' WHEN {legacy} THEN 'V033' END",
        f"CASE WHEN (cgst IS NOT NULL OR sgst IS NOT NULL OR igst IS NOT NULL) AND {off('cast(taxable_value * gst_rate * cast(0.01 AS decimal(3,2)) AS decimal(20,5))', tax)} THEN 'V034' END", "CASE WHEN abs(cgst - sgst) > 0.05 THEN 'V035' END",
        "CASE WHEN substr(vendor_gstin, 1, 2) = substr(buyer_gstin, 1, 2) AND igst > 0 THEN 'V036' END", "CASE WHEN substr(vendor_gstin, 1, 2) <> substr(buyer_gstin, 1, 2) AND (cgst > 0 OR sgst > 0) THEN 'V037' END",
        f"CASE WHEN {off(f'(taxable_value + {tax})', 'line_total')} THEN 'V038' END", "CASE WHEN shape = 'missing' THEN 'V050' WHEN shape = 'bad' THEN 'V051' WHEN code IS NULL THEN 'V052' WHEN instr(rates, '|') = 0 AND try_cast(rates AS decimal(5,2)) <> gst_rate THEN 'V053' END",
    ]
    ok = lambda x: d.matches(x, GSTIN_PATTERN)
    header = [
        *[f"CASE WHEN coalesce(cast({f} AS string), '') = '' THEN '{c}' END" for f, c in (("vendor_gstin", "V001"), ("invoice_number", "V002"), ("invoice_date", "V003"), ("grand_total", "V004"))], "CASE WHEN n_lines = 0 THEN 'V005' END",
        f"CASE WHEN vendor_gstin <> '' AND NOT {ok('vendor_gstin')} THEN 'V010' WHEN {ok('vendor_gstin')} AND substr(vendor_gstin, 15, 1) <> {check_digit('vendor_gstin')} THEN 'V012' END", "CASE WHEN upper(vendor_gstin) = upper(buyer_gstin) THEN 'V013' END",
        f"CASE WHEN upper(buyer_gstin) <> '{OUR_GSTIN}' THEN 'V015' END", f"CASE WHEN NOT {d.matches('invoice_number', '^[A-Za-z0-9/-]{1,16}$')} THEN 'V020' END", f"CASE WHEN invoice_date > {TODAY} THEN 'V021' WHEN invoice_date < {TAX_LAUNCH} THEN 'V022' END",
        *[f"CASE WHEN abs({s} - {t}) > 1 THEN '{c}' END" for t, s, c in (("subtotal", "s_taxable", "V040"), ("total_cgst", "s_cgst", "V041"), ("total_sgst", "s_sgst", "V042"), ("total_igst", "s_igst", "V043"))],
        "CASE WHEN grand_total <= 0 THEN 'V046' WHEN subtotal > 0 AND abs(subtotal + coalesce(total_cgst, 0) + coalesce(total_sgst, 0) + coalesce(total_igst, 0) - grand_total) > 1 THEN 'V045' END",
    ]
    hit = " ".join(f"LEFT JOIN hsn_reference h{n} ON length(l.hsn_sac) >= {n} AND substr(l.hsn_sac, 1, {n}) = h{n}.code" for n in (8, 6, 4, 2))
    return f"""SELECT invoice_id, line_no, {d.present(line)} AS code FROM (SELECT l.*, i.vendor_gstin, i.buyer_gstin, i.invoice_date, {shape} AS shape, coalesce(h8.code, h6.code, h4.code, h2.code) AS code, coalesce(h8.rates, h6.rates, h4.rates, h2.rates) AS rates
      FROM invoice_lines l JOIN invoices i ON l.invoice_id = i.invoice_id {hit}) a UNION ALL SELECT invoice_id, cast(NULL AS int), {d.present(header)} FROM invoices"""


def _risks(d: Dialect) -> str:
    """Every branch's items; of the anomalies only the best of an invoice that no other branch names."""
    item = lambda sev, cat, title, amount, rest: f"SELECT '{sev}' AS severity, '{cat}' AS category, '{title}' AS title, i.invoice_id, cast({amount} AS {M}) AS amount FROM invoices i {rest}"
    open_ = "i.status = 'NEEDS_REVIEW'"
    credit = "JOIN credit c ON i.invoice_id = c.invoice_id WHERE i.status <> 'REJECTED' AND c.itc_status"
    found = " UNION ALL ".join([
        item("Critical", "E-invoice", "forged signature", "i.grand_total", "WHERE i.status <> 'REJECTED' AND i.einvoice_status = 'SIGNATURE_INVALID'"), item("Critical", "E-invoice", "differs from its code", "i.grand_total", "WHERE i.status <> 'REJECTED' AND i.einvoice_status = 'MISMATCH'"),
        item("Critical", "ITC", "reversal due", "c.at_risk_itc", f"{credit} = 'REVERSAL_DUE'"), item("Critical", "ITC", "deadline passed", "c.blocked_itc", f"{credit} = 'LAPSED'"), item("Critical", "Duplicate", "possible duplicate", "i.grand_total", f"WHERE {open_} AND i.possible_duplicate"),
        item("High", "Statement", "missing from the statement", "c.at_risk_itc", "LEFT JOIN credit c ON i.invoice_id = c.invoice_id WHERE i.status <> 'REJECTED' AND i.gstr2b_status = 'MISSING_IN_2B'"),
        item("High", "Validation", "validation errors", "i.grand_total", f"JOIN (SELECT DISTINCT invoice_id FROM findings WHERE severity = 'ERROR') f ON i.invoice_id = f.invoice_id WHERE {open_}"), item("Review", "ITC", "needs a decision", "c.review_itc", f"{credit} = 'NEEDS_REVIEW' AND c.review_itc > 0")])
    odd = f"SELECT r.invoice_id, max(r.score) AS score FROM ({RULES_SQL}) r JOIN live l ON r.invoice_id = l.invoice_id WHERE r.score >= 50 GROUP BY r.invoice_id"
    return f"SELECT severity, category, title, invoice_id, amount FROM ({found}) b UNION ALL SELECT 'Review', 'Anomaly', 'unusual invoice', o.invoice_id, cast(i.grand_total AS {M}) FROM ({odd}) o JOIN invoices i ON o.invoice_id = i.invoice_id WHERE NOT EXISTS (SELECT 1 FROM ({found}) s WHERE s.invoice_id = o.invoice_id)"


def _state(d: Dialect, text: str) -> str:
    plain = d.replace(f"lower({text})", "[^a-z&]+", " ")
    names = " ".join(f"WHEN instr({plain}, '{n}') > 0 THEN '{c}'" for c, n in sorted(STATES, key=lambda x: -len(x[1])))
    return f"CASE WHEN try_cast(substr({text}, 1, 2) AS int) IS NOT NULL AND substr({text}, 1, 2) IN ({', '.join(repr(c) for c, _ in STATES)}) THEN substr({text}, 1, 2) {names} END"


def _decimal(d: Dialect, x: str) -> str:
    bare = d.replace(d.replace(f"replace(replace(lower({x}), ',', ''), ' ', '')", "(rs[.]?|inr|₹|/-|%)", ""), "[()]", "")
    first = f"regexp_extract({bare}, '-?[0-9]+([.][0-9]+)?', 0)"
    return f"CASE WHEN {d.matches(x, '^[(].*[)]$')} THEN -1 ELSE 1 END * try_cast({first} AS decimal(14,2))"


def _date(d: Dialect, x: str) -> str:
    """Day-first: d/m/yyyy with any of three separators, yyyy-mm-dd, and d mon yyyy; null for anything else and for days that don't exist."""
    part = lambda p, i: f"try_cast(regexp_extract({x}, '{p}', {i}) AS int)"
    day, iso, named = "^([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{4})$", "^([0-9]{4})-([0-9]{2})-([0-9]{2})$", "^([0-9]{1,2})[- ]([A-Za-z]{3})[a-z]*,?[- ]([0-9]{4})$"
    month = f"cast((instr('janfebmaraprmayjunjulaugsepoctnovdec', lower(regexp_extract({x}, '{named}', 2))) + 2) / 3 AS int)"
    made = lambda y, m, dd: f"try_cast(lpad(cast({y} AS string), 4, '0') || '-' || lpad(cast({m} AS string), 2, '0') || '-' || lpad(cast({dd} AS string), 2, '0') AS date)"
    return f"CASE WHEN {d.matches(x, day)} THEN {made(part(day, 3), part(day, 2), part(day, 1))} WHEN {d.matches(x, iso)} THEN {made(part(iso, 1), part(iso, 2), part(iso, 3))} WHEN {d.matches(x, named)} THEN {made(part(named, 3), month, part(named, 1))} END"


def _repaired_gstin(d: Dialect) -> str:
    """Look-alikes set right by place; then, if the check fails, the one swap at place 13 or 15 that makes it right, if there is only one."""
    piece = lambda a, n, table: f"translate(substr(x, {a}, {n}), '{table[0]}', '{table[1]}')"
    placed = " || ".join([piece(1, 2, AS_DIGIT), piece(3, 5, AS_LETTER), piece(8, 4, AS_DIGIT), piece(12, 1, AS_LETTER), "substr(x, 13, 1)", "CASE WHEN substr(x, 14, 1) = '2' THEN 'Z' ELSE substr(x, 14, 1) END", "substr(x, 15, 1)"])
    swap = lambda c: f"translate({c}, '0O1I5S8B2Z', 'O0I1S5B8Z2')"
    tries = f"base, substr(base, 1, 12) || {swap('substr(base, 13, 1)')} || substr(base, 14, 2) AS c13, substr(base, 1, 14) || {swap('substr(base, 15, 1)')} AS c15"
    right = lambda g: f"(substr({g}, 15, 1) = {check_digit(g)})"
    return f"""SELECT invoice_id, x AS read_as, CASE WHEN {right('base')} THEN base WHEN c13 <> base AND {right('c13')} AND NOT (c15 <> base AND {right('c15')}) THEN c13 WHEN c15 <> base AND {right('c15')} AND NOT (c13 <> base AND {right('c13')}) THEN c15 ELSE x END AS repaired
      FROM (SELECT invoice_id, x, {tries} FROM (SELECT invoice_id, x, {placed} AS base FROM (SELECT invoice_id, CASE invoice_id % 5 WHEN 0 THEN replace(vendor_gstin_true, 'AAPFU', 'AAPFU') WHEN 1 THEN replace(substr(vendor_gstin_true, 1, 7), 'S', '5') || translate(substr(vendor_gstin_true, 8, 8), '0158', 'OISB')
      WHEN 2 THEN substr(vendor_gstin_true, 1, 13) || '2' || substr(vendor_gstin_true, 15, 1) WHEN 3 THEN substr(vendor_gstin_true, 1, 14) || {swap('substr(vendor_gstin_true, 15, 1)')} ELSE substr(vendor_gstin_true, 1, 12) || {swap('substr(vendor_gstin_true, 13, 1)')} || substr(vendor_gstin_true, 14, 2) END AS x FROM invoices) a) b) c"""


SPENT = f"SELECT vendor_id AS person, cast(coalesce(sum(subtotal), 0) AS {M}) AS receipts, cast(vendor_id % 11 AS double) / 10 AS digital FROM live GROUP BY vendor_id"
TAXED = f"SELECT vendor_id AS person, cast(round(cast(coalesce(sum(total_tax), 0) AS double)) AS bigint) AS liability FROM live GROUP BY vendor_id"


def _presumed() -> str:
    rows = ", ".join(f"('{n}', {a}, {b}, {p}, {c})" for n, a, b, p, c in PRESUMED)
    share = "CASE WHEN digital > 1 THEN 1e0 ELSE digital END"
    return f"""SELECT person, scheme, receipts <= CASE WHEN {share} >= 95e-2 THEN most_digital ELSE most END AS eligible, round(cast(receipts AS double) * {share} * digital_pct / 100 + cast(receipts AS double) * (1 - {share}) * cash_pct / 100, 0) AS income
      FROM ({SPENT}) p JOIN (VALUES {rows}) AS s(scheme, most, most_digital, digital_pct, cash_pct) ON s.most > 0"""


def _advance() -> str:
    rows = ", ".join(f"({i}, date '{2002 if m < '04' else 2001}-{m}', {p})" for i, (m, p) in enumerate(INSTALMENTS, 1))
    return f"""SELECT person, due_day, cumulative - coalesce(lag(cumulative) OVER (PARTITION BY person ORDER BY nth), 0) AS pay_now, cumulative, CASE WHEN due_day < {TODAY} THEN 'past' ELSE 'upcoming' END AS state
      FROM (SELECT person, nth, due_day, cast(round(liability * pct / 100e0) AS bigint) AS cumulative FROM ({TAXED}) t JOIN (VALUES {rows}) AS s(nth, due_day, pct) ON t.liability >= {LEAST_LIABILITY}) c"""


def _deadlines() -> str:
    day = lambda text: f"(date '{text}')"
    rows = [(f"{y}-07-31", "Income tax return due", "everyone") for y in (2001, 2002)]
    rows += [(f"{y + (m < '04')}-{m}", "Advance tax instalment", "business") for m, _ in INSTALMENTS for y in (2001, 2002)]
    rows += [(f"2001-{9 + k:02d}-{dd}", title, "registered") for k in range(3) for dd, title in ((11, "Outward supplies due"), (20, "Monthly return due"))]
    items = ", ".join(f"(date '{a}', '{t}', '{w}')" for a, t, w in sorted(set(rows)))
    return f"""SELECT kind, due_day, title, due_day - {TODAY} AS days_left FROM (SELECT p.kind, d.due_day, d.title, row_number() OVER (PARTITION BY p.kind ORDER BY d.due_day, d.title) AS nth
      FROM (VALUES ('salaried', 'everyone'), ('trader', 'everyone'), ('trader', 'business'), ('trader', 'registered'), ('freelancer', 'everyone'), ('freelancer', 'business')) AS p(kind, who) JOIN (VALUES {items}) AS d(due_day, title, who) ON p.who = d.who WHERE d.due_day >= {TODAY}) x WHERE nth <= 8"""


UNIT = "CASE unit WHEN 'lakh' THEN 100000 WHEN 'crore' THEN 10000000 WHEN 'k' THEN 1000 ELSE 1 END"
SAID = "SELECT event_id, cast(1 + event_id % 90 AS string) || CASE event_id % 5 WHEN 0 THEN ' lakh' WHEN 1 THEN ' crore' WHEN 2 THEN 'k' WHEN 3 THEN ',500' ELSE '.5' END AS said FROM events"

QUERIES: dict[str, Template] = {
    # sources, sinks, filters
    "src_hsn_csv_alt": "SELECT code, rates, length(rates) - length(replace(rates, '|', '')) + 1 AS n_rates FROM hsn_reference",
    "src_tax_rules": "SELECT scheme, most, most_digital FROM (VALUES " + ", ".join(f"('{n}', {a}, {b})" for n, a, b, *_ in PRESUMED) + ") AS r(scheme, most, most_digital)",
    "snk_audit": lambda d: f"SELECT event_id, user_id AS actor, event_type AS action, {d.replace('ip', '^([0-9]+[.][0-9]+)[.].*$', '<1>.x.x')} AS ip_masked, cast(ts AS date) AS on_day FROM (SELECT *, '10.' || cast(user_id % 250 AS string) || '.' || cast(event_id % 250 AS string) || '.7' AS ip FROM events) e",
    "flt_scores": f"SELECT invoice_id, score, CASE WHEN score >= 70 THEN 'high' WHEN score >= 50 THEN 'medium' ELSE 'low' END AS priority FROM (SELECT invoice_id, max(score) AS score FROM ({RULES_SQL}) r GROUP BY invoice_id) s WHERE score >= 50 ORDER BY score DESC, invoice_id LIMIT 100",
    "flt_docs": "SELECT doc_id, lang AS kind, n_chars FROM documents WHERE doc_id = 77 OR (doc_id < 20 AND lang = 'en')",
    "flt_candidates": "SELECT a.invoice_id AS invoice_a, b.invoice_id AS invoice_b, a.invoice_number AS number_a, b.invoice_number AS number_b, a.grand_total AS total_a, b.grand_total AS total_b FROM live a JOIN live b ON a.document_hash = b.document_hash AND a.invoice_id < b.invoice_id ORDER BY a.grand_total DESC NULLS LAST, a.invoice_id, b.invoice_id LIMIT 200",
    # rules
    "val_alt": _alternative,
    "einv_check": _einvoice,
    "fn_jwt": lambda d: f"SELECT invoice_id, irn, q_number, q_total FROM ({_decoded(d)}) x WHERE token IS NOT NULL",
    "finding_diff": f"SELECT invoice_id, cast(s_taxable AS {M}) AS expected, cast(subtotal AS {M}) AS actual, cast(subtotal - s_taxable AS {M}) AS difference FROM invoices WHERE invoice_id IN (SELECT invoice_id FROM findings WHERE code = 'HEADER_LINE_SUM_MISMATCH')",
    "set_jaccard": lambda d: f"SELECT p_partkey, round({d.overlap(d.words('p_name'), d.words('other'))}, 9) AS jaccard FROM (SELECT p_partkey, p_name, lead(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS other FROM part) p WHERE other IS NOT NULL",
    # decisions
    "risk_items": lambda d: f"SELECT severity, category, title, invoice_id, amount FROM ({_risks(d)}) r ORDER BY CASE severity WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 ELSE 2 END, amount DESC NULLS LAST, category, title, invoice_id LIMIT 500",
    "set_union_risk": lambda d: f"SELECT severity, category, count(*) AS n, count(DISTINCT invoice_id) AS invoices, cast(sum(amount) AS {M}) AS amount FROM ({_risks(d)}) r GROUP BY severity, category",
    "vendor_get_or_create": """SELECT n.invoice_id, coalesce(g.vendor_id, v.vendor_id) AS vendor_id, g.vendor_id IS NULL AND v.vendor_id IS NULL AS created FROM (SELECT invoice_id, CASE WHEN invoice_id % 3 <> 0 THEN vendor_gstin END AS gstin, CASE WHEN invoice_id % 7 = 0 THEN 'New ' ELSE ' ' END || upper(vendor_name) AS name FROM invoices) n
      LEFT JOIN vendors g ON n.gstin = g.gstin LEFT JOIN (SELECT lower(trim(vendor_name)) AS name, min(vendor_id) AS vendor_id FROM vendors GROUP BY lower(trim(vendor_name))) v ON lower(trim(n.name)) = v.name""",
    # texts
    "fn_norm_no_alt": lambda d: f"SELECT invoice_id, coalesce(nullif(ltrim({d.replace(d.replace('upper(invoice_number)', '[^A-Z0-9]', ''), '([A-Z])0+([0-9])', '<1>' + ('$2' if d.spark else chr(92) + '2'))}, '0'), ''), invoice_number) AS number FROM invoices" if not d.spark else f"SELECT invoice_id, coalesce(nullif(trim(LEADING '0' FROM {d.replace(d.replace('upper(invoice_number)', '[^A-Z0-9]', ''), '(?<=[^0-9])0+(?=[0-9])', '')}), ''), invoice_number) AS number FROM invoices",
    "fn_gstin_repair": _repaired_gstin,
    "fn_amount_repair": lambda d: f"SELECT invoice_id, read_as, CASE WHEN {d.matches('t', '^-?[0-9.,]*[.,][0-9]{2}$')} THEN {d.replace('substr(t, 1, length(t) - 3)', '[.,]', '')} || '.' || substr(t, length(t) - 1, 2) ELSE t END AS repaired FROM (SELECT invoice_id, read_as, translate(read_as, '{AS_DIGIT[0]}', '{AS_DIGIT[1]}') AS t FROM (SELECT invoice_id, translate(replace(cast(grand_total AS string), '.', CASE invoice_id % 3 WHEN 0 THEN ',' ELSE '.' END), '015', CASE invoice_id % 2 WHEN 0 THEN 'OlS' ELSE '015' END) AS read_as FROM invoices WHERE grand_total IS NOT NULL) a) b",
    "fn_state_text": lambda d: f"SELECT vendor_id, said, {_state(d, 'said')} AS state FROM (SELECT vendor_id, CASE vendor_id % 5 WHEN 0 THEN '27' WHEN 1 THEN '27-Maharashtra' WHEN 2 THEN 'Andhra  Pradesh'  WHEN 3 THEN 'ARUNACHAL PRADESH (12)' ELSE 'nowhere' END AS said FROM vendors) v",
    "fn_parse_decimal": lambda d: f"SELECT invoice_id, said, {_decimal(d, 'said')} AS amount FROM (SELECT invoice_id, CASE invoice_id % 6 WHEN 0 THEN 'Rs. 1,23,' || lpad(cast(invoice_id % 1000 AS string), 3, '0') || '.50' WHEN 1 THEN '(' || cast(invoice_id AS string) || ')' WHEN 2 THEN 'INR ' || cast(invoice_id AS string) || '/-' WHEN 3 THEN '18%' WHEN 4 THEN 'n/a' ELSE '-' || cast(invoice_id AS string) || '.25' END AS said FROM invoices) i",
    "fn_parse_date": lambda d: f"SELECT invoice_id, said, {_date(d, 'said')} AS day FROM (SELECT invoice_id, CASE invoice_id % 6 WHEN 0 THEN cast(1 + invoice_id % 31 AS string) || '/' || cast(1 + invoice_id % 13 AS string) || '/2024' WHEN 1 THEN '2024-02-' || lpad(cast(1 + invoice_id % 31 AS string), 2, '0') WHEN 2 THEN cast(1 + invoice_id % 28 AS string) || ' March 2024' WHEN 3 THEN '05-Sep-2024' WHEN 4 THEN '1.2.2024' ELSE 'soon' END AS said FROM invoices) i",
    "fn_amount_words": lambda d: f"SELECT event_id, said, round(cast(replace(regexp_extract(said, '^([0-9,.]+)', 1), ',', '') AS double) * {UNIT}, 2) AS amount FROM (SELECT event_id, said, regexp_extract(said, '(lakh|crore|k)$', 1) AS unit FROM ({SAID}) s) t",
    "fn_norm_feedback": "SELECT doc_id, predicted, corrected, coalesce(cast(try_cast(predicted AS decimal(18,4)) AS string), upper(trim(predicted))) = coalesce(cast(try_cast(corrected AS decimal(18,4)) AS string), upper(trim(corrected))) AS was_correct FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN cast(doc_id AS string) || '.00' WHEN 1 THEN ' ' || source ELSE lang END AS predicted, CASE doc_id % 3 WHEN 0 THEN cast(doc_id AS string) WHEN 1 THEN upper(source) ELSE source END AS corrected FROM documents) f",
    "fn_norm_benchmark": f"SELECT invoice_id, coalesce(cast(cast(try_cast(replace(said, ',', '') AS decimal(18,4)) AS {M}) AS string), upper(trim(said))) AS value FROM (SELECT invoice_id, CASE invoice_id % 3 WHEN 0 THEN '1,234.5' WHEN 1 THEN coalesce(invoice_number, '') ELSE cast(grand_total AS string) END AS said FROM invoices) v",
    # calculators and statistics
    "presumptive": _presumed(),
    "advance_tax": _advance(),
    "deadlines": lambda d: _deadlines() if not d.spark else _deadlines().replace(f"due_day - {TODAY} AS days_left", f"cast(datediff(due_day, {TODAY}) AS bigint) AS days_left"),
    "ts_ols": f"""SELECT h AS step, round(greatest(0e0, a + b * x), 2) AS estimate, round(greatest(0e0, a + b * x - width), 2) AS low, round(greatest(0e0, a + b * x) + width, 2) AS high FROM (
      SELECT s.h, m.a, m.b, m.n - 1 + s.h AS x, 128e-2 * sqrt(m.rss / (m.n - 1)) * sqrt(1 + 1 / cast(m.n AS double) + power(m.n - 1 + s.h - m.mx, 2) / m.sxx) AS width FROM (
        SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, count(*) AS n, avg(x) AS mx, regr_sxx(y, x) AS sxx, regr_syy(y, x) - power(regr_sxy(y, x), 2) / regr_sxx(y, x) AS rss
        FROM (SELECT cast(row_number() OVER (ORDER BY month) - 1 AS double) AS x, y FROM (SELECT substr(cast(invoice_date AS string), 1, 7) AS month, cast(cast(sum(total_tax) AS {M}) AS double) AS y, row_number() OVER (ORDER BY substr(cast(invoice_date AS string), 1, 7) DESC) AS k FROM live WHERE invoice_date IS NOT NULL GROUP BY substr(cast(invoice_date AS string), 1, 7)) g WHERE k <= 24) r) m
      JOIN (VALUES (1), (2), (3)) AS s(h) ON m.n >= 3) w""",
}


#: The same results said in another way, for DuckDB.
ORACLES: dict[str, Template] = {
    "src_hsn_csv_alt": lambda d: "SELECT code, rates, CASE WHEN instr(rates, '|') > 0 THEN 2 ELSE 1 END AS n_rates FROM (VALUES " + ", ".join(str(x) for x in HSN_RATES) + ") AS r(code, rates)",
    "advance_tax": f"SELECT person, due_day, cumulative - coalesce(max(earlier), 0) AS pay_now, cumulative, CASE WHEN due_day < {TODAY} THEN 'past' ELSE 'upcoming' END AS state FROM (SELECT a.person, a.due_day, cast(round(a.liability * a.pct / 100e0) AS bigint) AS cumulative, cast(round(b.liability * b.pct / 100e0) AS bigint) AS earlier FROM (SELECT * FROM ({TAXED}) t, (VALUES (1, date '2001-06-15', 15), (2, date '2001-09-15', 45), (3, date '2001-12-15', 75), (4, date '2002-03-15', 100)) AS s(nth, due_day, pct) WHERE liability >= 10000) a LEFT JOIN (SELECT * FROM ({TAXED}) t, (VALUES (1, 15), (2, 45), (3, 75)) AS s(nth, pct)) b ON a.person = b.person AND b.nth = a.nth - 1) x GROUP BY person, due_day, cumulative",
    "flt_candidates": "SELECT a.invoice_id AS invoice_a, b.invoice_id AS invoice_b, a.invoice_number AS number_a, b.invoice_number AS number_b, a.grand_total AS total_a, b.grand_total AS total_b FROM live a JOIN live b ON b.invoice_id = a.invoice_id + 1 AND b.invoice_id % 50 = 2 ORDER BY a.grand_total DESC NULLS LAST, a.invoice_id, b.invoice_id LIMIT 200",
}
