"""Every registered query of the engine runs; those with SQL equal DuckDB's rows."""

import pytest
from conftest import same_rows

from taxloom.plans import engine, registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, data, name):
    same_rows(QUERIES[name](spark, data), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    rows = df.collect()
    assert rows and len(set(df.columns)) == len(df.columns) and len(set(map(str, rows))) == len(rows)


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and e.entry(spark).count() > 0


def test_staged_views_follow_their_files(spark, data, tmp_path):
    """A view is written once for the files it comes from, and anew when they change."""
    for table in ("customer", "orders", "lineitem"):
        spark.read.parquet(f"{data}/{table}.parquet").write.parquet(f"{tmp_path}/{table}.parquet")
    before = QUERIES["flt_live"](spark, str(tmp_path)).count()
    assert before == QUERIES["flt_live"](spark, data).count()
    spark.read.parquet(f"{data}/orders.parquet").limit(10).write.mode("overwrite").parquet(f"{tmp_path}/orders.parquet")
    assert QUERIES["flt_live"](spark, str(tmp_path)).count() <= 10 < before


def test_statement_outcomes_over_all_periods(spark, data):
    rows = QUERIES["rec_2b"](spark, data).collect()
    lines = engine.statement(spark, data).count()
    assert len(rows) == len({r.line for r in rows}) == lines
    assert {r.status for r in rows} >= {"MATCHED", "FUZZY_MATCHED", "DATE_MISMATCH", "AMOUNT_MISMATCH", "MISSING_IN_BOOKS", "POTENTIAL_DUPLICATE"}


def test_key_figures_by_period(spark, data):
    """All time, months and named periods, against figures that other queries find and against months that make up a year."""
    rows = {r.period: r for r in QUERIES["agg_kpis_period"](spark, data).collect()}
    whole, live = rows["all"], QUERIES["agg_kpis"](spark, data).first()
    assert (whole.total_purchase_value, whole.gst_amount, whole.itc_eligible, whole.itc_at_risk) == (live.spend, live.gst, live.eligible_itc, live.at_risk)
    assert whole.invoices_missing_in_2b == live.missing_in_2b and whole.n_needs_review == live.in_review and whole.total_invoices == live.invoices + whole.n_rejected
    for column in ("total_invoices", "itc_blocked", "gstr2b_matched", "gstr2b_mismatches"):
        months = {k: r[column] for k, r in rows.items() if k[0].isdigit()}
        assert sum(months.values()) <= whole[column]
        assert rows["this_fy"][column] == sum(x for k, x in months.items() if "2001-04" <= k <= "2002-03") and rows["this_month"][column] == months.get("2001-09", 0) and rows["last_month"][column] == months.get("2001-08", 0)


def test_report_parts(spark, data):
    """The report's totals are those of the key figures, its vendors those of most attention."""
    rows = QUERIES["agg_report"](spark, data).collect()
    (whole,) = [r for r in QUERIES["agg_kpis_period"](spark, data).collect() if r.period == "all"]
    part = {(r.part, r.name): r for r in rows}
    assert part["credit", "eligible"].amount == whole.itc_eligible and part["credit", "blocked"].amount == whole.itc_blocked and part["confidence", "mean"].n == whole.total_invoices
    assert sum(r.n for r in rows if r.part == "statement" and r.name in ("MATCHED", "DATE_MISMATCH")) == whole.gstr2b_matched
    assert len(part) == len(rows) and sum(r.part == "vendor" for r in rows) == 8 and sum(r.part == "error" for r in rows) <= 10
