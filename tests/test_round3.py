"""Special functions, layout of pages, the statement log, reviews, credit by a second way, and retries through a restart."""

import math
from collections import defaultdict
from datetime import date, timedelta
from decimal import Decimal
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxloom.functions import special
from taxloom.operators import imports, layout, review
from taxloom.plans import decisions, engine
from taxloom.streaming import jobs, retry


def test_binomial_tails_equal_their_sums(spark):
    want = {(k, n): sum(math.comb(n, i) for i in range(k + 1)) / 2**n for n in (1, 2, 9, 40, 333, 900) for k in {0, 1, n // 3, n // 2, n - 1, n} if k <= n}
    rows = spark.createDataFrame(list(want), "k long, n long").withColumn("p", special.binomial_cdf(F.col("k"), F.col("n"), 0.5)).collect()
    assert all(r.p == pytest.approx(want[r.k, r.n], rel=1e-9) for r in rows)
    # far beyond what a table could hold: the normal approximation with continuity
    big = spark.createDataFrame([(500_000_000 - 5_000, 1_000_000_000)], "k long, n long").select(special.binomial_cdf(F.col("k"), F.col("n"), 0.5)).first()[0]
    z = (500_000_000 - 5_000 + 0.5 - 500_000_000) / math.sqrt(250_000_000)
    assert big == pytest.approx(0.5 * math.erfc(-z / math.sqrt(2)), rel=1e-4)


def test_beta_distribution_equals_numeric_integration(spark):
    cases = [(a, b, x) for a in (0.3, 1.0, 4.5, 80.0) for b in (0.4, 2.0, 33.0) for x in (0.05, 0.25, 0.6, 0.99)]
    got = spark.createDataFrame(cases, "a double, b double, x double").withColumn("p", special.beta_cdf(F.col("x"), F.col("a"), F.col("b"))).collect()
    for r in got:
        u = np.linspace(0, 1, 200_001)[1:] - 0.5 / 200_000  # substitution t = x u^(1/a) takes the end's singularity away
        t = r.x * u ** (1 / r.a)
        whole = math.lgamma(r.a + r.b) - math.lgamma(r.a) - math.lgamma(r.b)
        assert r.p == pytest.approx(math.exp(whole) * r.x**r.a / r.a * np.mean((1 - t) ** (r.b - 1)), rel=1e-4)
    ends = spark.range(1).select(special.beta_cdf(0.0, F.lit(2.0), F.lit(3.0)), special.beta_cdf(1.0, F.lit(2.0), F.lit(3.0))).first()
    assert tuple(ends) == (0.0, 1.0)


WORDS = "page long, word long, text string, x0 double, y0 double, x1 double, y1 double"


def plain_lines(words):
    """Lines of one page by the rule, with a list."""
    words = sorted((w for w in words if w[2].strip()), key=lambda w: ((w[4] + w[6]) / 2, w[1]))
    if not words:
        return []
    reach = 0.6 * float(np.median([w[6] - w[4] for w in words]))
    lines = [[words[0]]]
    for w in words[1:]:
        if abs((w[4] + w[6]) / 2 - np.mean([(x[4] + x[6]) / 2 for x in lines[-1]])) > reach:
            lines.append([])
        lines[-1].append(w)
    out = []
    for i, line in enumerate(lines):
        h, seg = float(np.median([w[6] - w[4] for w in line])) or 1.0, 0
        across = sorted(line, key=lambda w: w[3])
        for j, w in enumerate(across):
            seg += j > 0 and w[3] - across[j - 1][5] > 3 * h
            out.append((w[0], i, j, seg, w[1]))
    return out


def test_lines_follow_a_moving_centre(spark):
    rng = np.random.default_rng(4)
    rows = [(1, i, f"w{i}", 10.0 * i, float(i // 2), 10.0 * i + 8, float(i // 2) + 10) for i in range(40)]  # a slope: neighbours are near, the mean drifts
    rows += [(2, 1, "alone", 0.0, 0.0, 5.0, 10.0), (3, 1, " ", 0.0, 0.0, 1.0, 1.0), (4, 1, "flat", 0.0, 5.0, 9.0, 5.0), (4, 2, "flat", 20.0, 5.0, 29.0, 5.0)]
    rows += [(5, i, "t", float(rng.integers(0, 40)) * 12, float(rng.integers(0, 12)) * 6, 0.0, 0.0) for i in range(120)]
    rows = [(p, w, t, x0, y0, max(x1, x0 + 9), max(y1, y0 + 8) if p == 5 else y1) for p, w, t, x0, y0, x1, y1 in rows]
    got = {tuple(r) for r in layout.page_lines(spark.createDataFrame(rows, WORDS)).select("page", "line", "place", "segment", "word").collect()}
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    assert got == {x for page in by.values() for x in plain_lines(page)}
    assert layout.page_lines(spark.createDataFrame([], WORDS)).count() == 0


def test_tokens_tile_their_boxes(spark):
    want = {"PartyGSTIN:19DZ": ["Party", "GSTIN:", "19DZ"], "Rs.2153.00": ["Rs.", "2153.00"], "10:45": ["10:45"], "TaxInvoiceNo:": ["Tax", "Invoice", "No:"], "Total:INR5": ["Total:", "INR", "5"], "05-Ju1-2024": ["05-Jul-2024"], "plain": ["plain"], "aB1:": ["aB1:"]}
    words = spark.createDataFrame([(i, 0, t, 3.0, 1.0, 103.0, 9.0) for i, t in enumerate(want)] + [(99, 0, None, 0.0, 0.0, 1.0, 1.0)], WORDS)
    by = defaultdict(list)
    for r in layout.split_tokens(words).orderBy("page", "part").collect():
        by[r.page].append(r)
    assert [[r.text for r in by[i]] for i in range(len(want))] == list(want.values()) and 99 not in by
    for parts in by.values():
        assert parts[0].x0 == 3.0 and parts[-1].x1 == 103.0 and all(a.x1 == b.x0 for a, b in pairwise(parts))


def test_labels_take_long_values_first(spark):
    row = spark.createDataFrame([("a b c a b x".split(), "a b", "a b c", None, "zz", "x y z w v u t")], "words array<string>, two string, three string, none string, absent string, long string")
    fields = {f: F.col(f) for f in ("two", "three", "none", "absent", "long")}
    got = row.select(layout.field_labels(F.col("words"), fields).alias("l")).first().l
    assert got == ["B-three", "I-three", "I-three", "B-two", "I-two", "O"]


# --- statements

LINES, BOOKS = "line long, period string, gstin string, number string, day date, taxable decimal(18,2), tax decimal(18,2)", "book long, period string, gstin string, number string, day date, taxable decimal(18,2), tax decimal(18,2)"


def statement_case(spark):
    """Invoice 1 has a line in two periods: only the first gets it.  2 is fuzzy, 3 under another tax id, 4 in no statement, 5 in the second period only."""
    g1, g2, m = "27AAPFU0939F1ZV", "29AAGCB7383J1Z4", Decimal
    books = {1: (g1, "INV/1", date(2026, 1, 5), 1000), 2: (g1, "INV/26-0210", date(2026, 1, 6), 500), 3: (g2, "KA/9981", date(2026, 1, 8), 300), 4: (g1, "INV/44", date(2026, 1, 9), 70), 5: (g1, "INV/55", date(2026, 2, 3), 900)}
    rows = [(b, p, g, n, d, m(t), m(t) / 10) for b, (g, n, d, t) in books.items() for p in ("2026-01", "2026-02", "2026-03") if p >= d.isoformat()[:7]]
    lines = [(101, "2026-01", g1, "INV-1", date(2026, 1, 5), m(1000), m(100)), (102, "2026-01", g1, "INV/26-0201", date(2026, 1, 6), m(500), m(50)), (103, "2026-01", g1, "KA/9981", date(2026, 1, 8), m(300), m(30)),
             (201, "2026-02", g1, "INV/1", date(2026, 1, 5), m(1000), m(100)), (202, "2026-02", g1, "INV/55", date(2026, 2, 3), m(900), m(90))]
    return spark.createDataFrame(lines, LINES), spark.createDataFrame(rows, BOOKS)


def test_statements_are_imported_in_order_undone_and_imported_again(spark, tmp_path):
    lines, books = statement_case(spark)
    state = lambda log: {r.book: (r.status, r.record) for r in log.state().collect()}
    one, two = imports.StatementLog(spark, f"file://{tmp_path}/one"), imports.StatementLog(spark, f"file://{tmp_path}/two")
    assert one.take("all", lines, books) and not one.take("all", lines, books)
    want = {1: ("IN_2B", 101), 2: ("IN_2B", 102), 3: ("MISSING_IN_2B", 103), 4: ("MISSING_IN_2B", None), 5: ("IN_2B", 202)}
    assert state(one) == want
    statuses = {r.line: r.status for r in one.records().collect()}
    assert statuses[201] == "MISSING_IN_BOOKS" and statuses[102] == "FUZZY_MATCHED" and statuses[103] == "GSTIN_MISMATCH"
    # one period at a time gives the same
    for p in ("2026-01", "2026-02"):
        two.take(p, lines.where(F.col("period") == p), books)
    assert state(two) == want and {r.line: r.status for r in two.records().collect()} == statuses
    # a job that dies between the two writes changes nothing, and may be run again
    def die():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        one.undo("back", ["2026-01"], books, fail=die)
    assert state(one) == want
    assert one.undo("back", ["2026-01"], books) and not one.undo("back", ["2026-01"], books)
    assert state(one) == {5: ("IN_2B", 202)} and {r.line for r in one.records().collect()} == {201, 202}
    one.take("again", lines.where("period = '2026-01'"), books)
    assert state(one) == want
    # another statement of the period replaces it
    one.take("corrected", lines.where("line = 103"), books)
    assert state(one) == {1: ("MISSING_IN_2B", None), 2: ("MISSING_IN_2B", None), 3: ("MISSING_IN_2B", 103), 4: ("MISSING_IN_2B", None), 5: ("IN_2B", 202)}
    assert {r.line for r in one.records().collect()} == {103, 201, 202}


# --- reviews and credit


def test_reviews_are_folded_in_order(spark):
    bills = spark.createDataFrame([(1, "NEEDS_REVIEW", None, {"number": "A1", "total": "10.00"}), (2, "FAILED", date(2020, 1, 1), {})], "invoice_id long, status string, payment_date date, values map<string,string>")
    acts = [(1, 3, 30, "reject", "c", None, None, None), (1, 1, 10, "correct", "a", None, "number", " a1 "), (1, 2, 20, "correct", "b", None, "total", "12.5"), (1, 2, 21, "correct", "b", None, "total", "12.50"), (1, 4, 40, "correct", "d", None, "colour", "red"),
            (1, 5, 50, "pay", "e", date(2024, 5, 1), None, None), (9, 1, 1, "approve", "f", None, None, None)]
    done = review.folded(bills, spark.createDataFrame(acts, "invoice_id long, acted_at int, action_id long, action string, actor string, paid_on date, field string, value string"), ("number", "total"))
    got = {r.invoice_id: r for r in done.collect()}
    r = got[1]
    assert (r.status, r.payment_date, r.reviewer, r.applied, r.refused, r["values"]) == ("REJECTED", date(2024, 5, 1), "c", 5, 1, {"number": " a1 ", "total": "12.50"}) and 2 not in got
    assert (got[9].status, got[9].applied, got[9].refused) == (None, 0, 1)
    told = [tuple(x)[1:6] for x in review.feedback(done).orderBy("action_id").collect()]
    assert told == [(10, "number", "A1", " a1 ", True), (20, "total", "10.00", "12.5", False), (21, "total", "12.5", "12.50", True)]


def credit(i, lines, today=date(2001, 9, 1)):
    """Status, claimable credit and reasons of one invoice by the rules, step by step."""
    why = []
    if i.status == "REJECTED":
        return "NOT_APPLICABLE", 0, ["I000"]
    taxed = [x for x in lines if x.tax and x.tax > 0]
    total = sum(x.tax for x in taxed) if taxed else (i.total_tax or 0)
    if i.possible_duplicate and i.status != "APPROVED":
        return "NOT_APPLICABLE", 0, ["I002"]
    if total <= 0:
        return "NOT_APPLICABLE", 0, ["I001"]
    blocked = review_ = 0
    for x in taxed:
        if x.action and x.own:
            why.append("I012")
        elif x.action == "BLOCKED":
            blocked += x.tax
            why.append("I010")
        elif x.action == "REVIEW":
            review_ += x.tax
            why.append("I011")
    eligible = total - blocked - review_
    status = "BLOCKED" if blocked == total else "NEEDS_REVIEW" if review_ else "PARTIALLY_ELIGIBLE" if blocked else "ELIGIBLE"
    if i.gstr2b_status == "IN_2B" and not i.itc_available:
        status, eligible = "BLOCKED", 0
        why.append("I021")
    elif i.gstr2b_status == "MISSING_IN_2B":
        status, eligible = status if status == "BLOCKED" else "NOT_IN_2B", 0
        why.append("I020")
    elif i.gstr2b_status is None:
        status = "AWAITING_2B" if status == "ELIGIBLE" else status
        why.append("I022")
    if i.einvoice_status == "MISMATCH" and i.status != "APPROVED" and status != "BLOCKED":
        status, eligible = "NEEDS_REVIEW", 0
        why.append("I060")
    if i.reverse_charge:
        why.append("I040")
    if i.invoice_date:
        due = i.invoice_date + timedelta(days=180)
        if not i.payment_date and today > due and status != "BLOCKED":
            status, eligible = "REVERSAL_DUE", 0
            why.append("I030")
        elif i.payment_date and i.payment_date > due:
            why.append("I031")
        last = date(i.invoice_date.year + (i.invoice_date.month >= 4), 11, 30)
        if today > last and i.gstr2b_status != "IN_2B" and status != "BLOCKED":
            status, eligible = "LAPSED", 0
            why.append("I050")
    return status, eligible, why


def test_credit_before_and_after_reviews_by_a_second_way(spark, data):
    bills = {r.invoice_id: r for r in engine.view(spark, data, "SELECT * FROM invoices").collect()}
    lines = defaultdict(list)
    for r in engine.view(spark, data, "SELECT invoice_id, tax, action, own FROM restricted_lines").collect():
        lines[r.invoice_id].append(r)
    first = {r.invoice_id: r for r in engine.view(spark, data, "SELECT * FROM credit").collect()}
    reviewed = {r.invoice_id: r for r in decisions.review_actions(spark, data).collect() if r.status}
    after = {r.invoice_id: r for r in decisions.itc_reassess(spark, data).collect()}
    seen, changed = set(), 0
    for k, i in bills.items():
        status, eligible, why = credit(i, lines[k])
        assert (first[k].itc_status, first[k].eligible_itc, set(first[k].reasons.split("; ")) - {""}) == (status, eligible, set(why)), k
        seen |= set(why)
        if k in reviewed:
            new = type("Bill", (), {**i.asDict(), "status": reviewed[k].status, "payment_date": reviewed[k].payment_date, "invoice_date": date.fromisoformat(reviewed[k].invoice_date) if reviewed[k].invoice_date else None})
            status, eligible, why = credit(new, lines[k])
            changed += status != first[k].itc_status
        assert (after[k].itc_status, after[k].eligible_itc, set(after[k].reasons.split("; ")) - {""}) == (status, eligible, set(why)), k
    assert changed > 20 and {"I000", "I002", "I010", "I011", "I012", "I020", "I021", "I022", "I030", "I031", "I040", "I050", "I060"} <= seen


# --- retries


def test_retries_survive_a_restart(spark, data, tmp_path):
    """Two folders of files, a run after each, from one checkpoint: what comes out is what a plain replay of each file's attempts gives."""
    rows = spark.read.parquet(f"{data}/events.parquet").withColumn("kind", F.coalesce(*[F.when(F.col("event_type") == e, F.lit(k)) for e, k in decisions.UPLOADS.items()])).where("kind is not null").withColumn("file", F.floor(F.col("user_id") / 2))
    cut = rows.agg(F.percentile("event_id", 0.5)).first()[0]
    late = rows.agg(F.max("ts")).first()[0]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", decisions.ROCKS)
    try:
        middle = rows.where(F.col("event_id") <= cut).agg(F.max("ts")).first()[0]
        for i, part in enumerate((rows.where(F.col("ts") <= F.lit(middle)), rows.where(F.col("ts") > F.lit(middle)))):
            part.select("file", "event_id", F.col("ts").cast("timestamp").alias("ts"), "kind").coalesce(1).write.parquet(f"file://{tmp_path}/in/{i}")
            stream = spark.readStream.schema("file long, event_id long, ts timestamp, kind string").parquet(f"file://{tmp_path}/in/*")
            got = jobs.run_once(retry.retries(stream), f"file://{tmp_path}/out", f"file://{tmp_path}/check").collect()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    tries = defaultdict(list)
    for r in rows.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp"))).collect():
        tries[r.file].append((r["at"], r.event_id, r.kind))
    mark = int((np.datetime64(late) - np.datetime64("1970-01-01T00:00:00")) / np.timedelta64(1, "us")) - 3_600_000_000
    want = set()
    for file, acts in tries.items():
        said = retry.replayed(acts)
        want |= {(file, *x) for x in said}
        state = None
        for at, _, kind in sorted(acts):
            state, _ = retry.advance(state, at, kind)
        if state and state[2] and state[1] <= mark:
            want.add((file, state[1], "due", state[0], state[1]))
    assert {tuple(r) for r in got} == want and {r.kind for r in got} >= {"failed", "due", "done", "asked"}


def test_waits_double_up_to_a_limit():
    assert [retry.wait(n) // 60_000_000 for n in range(1, 7)] == [2, 4, 8, 16, 30, 30]
    state, said = None, []
    for n in range(9):
        state, out = retry.advance(state, n * 10**11, retry.FAILED)
        said += [x[1] for x in out]
    assert said == ["failed", "due"] * 5 + ["given up"] and state[0] == 6
    assert retry.advance(state, 10**13, retry.NOW)[0] == (5, 0, False)
