"""Registered queries of the operators that are more than one SQL statement, with DuckDB SQL where it can say the same another way."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxloom.functions import similarity
from taxloom.operators import anomaly, duplicates, forecast, matching, purchase_orders, tax
from taxloom.operators.work import Work, shared_folder, written
from taxloom.plans import analytics, dialect
from taxloom.sources import files
from taxloom.sources.adapters import VIEWS, close, normal_number
from taxloom.streaming import jobs

#: Days before a return period from which on an invoice may be in its statement.
LOOKBACK = 180


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return dialect.run(spark, sf_dir, sql, VIEWS)


def statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all return periods."""
    return written(matching.keyed(view(spark, sf_dir, "SELECT record_id AS line, return_period AS period, supplier_gstin AS gstin, invoice_number AS number, invoice_date AS day, taxable_value AS taxable, total_tax AS tax FROM records WHERE return_period IS NOT NULL")), "statement")


def ranged_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live invoices, each with the periods whose statement may hold it; every hundredth also under a number with one more zero, which makes its line ambiguous."""
    cols = "vendor_gstin_true AS gstin, {} AS number, invoice_date AS day, subtotal AS taxable, total_tax AS tax FROM live WHERE invoice_date IS NOT NULL"
    rows = view(spark, sf_dir, f"SELECT invoice_id AS book, {cols.format('invoice_number')} UNION ALL SELECT -invoice_id AS book, {cols.format(chr(39) + 'INV/0' + chr(39) + ' || substr(invoice_number, 5, 8)')} AND invoice_id % 100 = 31")
    month = lambda d: F.trunc(d, "month")
    months = F.sequence(month(F.col("day")), month(F.date_add("day", LOOKBACK)), F.expr("interval 1 month"))
    return written(matching.keyed(rows).withColumn("periods", F.transform(months, lambda m: F.date_format(m, "yyyy-MM"))).drop("period"), "register")


def _each_period(books: DataFrame) -> DataFrame:
    return books.withColumn("period", F.explode("periods")).drop("periods")


def register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ranged_register`` with a row for each period."""
    return _each_period(ranged_register(spark, sf_dir))


def _reconciled(lines: DataFrame, books: DataFrame) -> DataFrame:
    """``lines`` reconciled with ranged ``books``, which are repeated for their periods only where they are read."""
    work = Work(lines.sparkSession, "met")
    found = matching.reconcile(lines, _each_period(books), met=work.write(matching.candidates(lines, books), "met"))
    work.keep()
    return found


def rec_2b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reconciled(statement(spark, sf_dir), ranged_register(spark, sf_dir)).withColumn("score", F.round("score", 4))


def rec_2b_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, books = statement(spark, sf_dir), ranged_register(spark, sf_dir)
    return matching.missing_by_period(_each_period(books), lines, _reconciled(lines, books))


def rec_2b_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.blocks(statement(spark, sf_dir), register(spark, sf_dir)).select("line", "book", "agree")


def jn_block_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates: equal numbers, or similar ones with agreeing amounts, within a tax id and period."""
    return matching.candidates(statement(spark, sf_dir), register(spark, sf_dir)).select("line", "book", F.round("score", 6).alias("score"))


def _blocks_sql(d: dialect.Dialect) -> str:
    n = normal_number
    return f"""WITH s AS (SELECT record_id AS line, return_period AS period, supplier_gstin AS gstin, invoice_number AS number, taxable_value AS taxable, total_tax AS tax FROM records WHERE return_period IS NOT NULL),
      b0 AS (SELECT * FROM live WHERE invoice_date IS NOT NULL),
      b AS (SELECT invoice_id AS book, invoice_date AS day, vendor_gstin_true AS gstin, invoice_number AS number, subtotal AS taxable, total_tax AS tax FROM b0 UNION ALL SELECT -invoice_id, invoice_date, vendor_gstin_true, 'INV/0' || substr(invoice_number, 5, 8), subtotal, total_tax FROM b0 WHERE invoice_id % 100 = 31)
      SELECT s.line, b.book, coalesce({close('s.taxable', 'b.taxable', '1.00')}, s.taxable IS NULL AND b.taxable IS NULL) AND coalesce({close('s.tax', 'b.tax', '1.00')}, s.tax IS NULL AND b.tax IS NULL) AS agree
      FROM s JOIN b ON upper(s.gstin) = upper(b.gstin) AND b.day <= last_day(cast(s.period || '-01' AS date)) AND strftime(b.day + INTERVAL {LOOKBACK} DAY, '%Y-%m') >= s.period WHERE ({n(d, 's.number')} = {n(d, 'b.number')} AND {n(d, 's.number')} <> '')
      OR ({close('s.taxable', 'b.taxable', '1.00')} AND {close('s.tax', 'b.tax', '1.00')} AND {n(d, 's.number')} <> {n(d, 'b.number')})"""


def invoices_with_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live invoices with their line descriptions, sorted, as one text."""
    bills = view(spark, sf_dir, "SELECT invoice_id, vendor_id, vendor_gstin, invoice_number, invoice_date, document_hash, grand_total, subtotal, total_tax FROM live")
    text = view(spark, sf_dir, "SELECT invoice_id, description FROM invoice_lines").groupBy("invoice_id").agg(F.array_join(F.array_sort(F.collect_list(F.lower("description"))), " ").alias("descriptions"))
    return written(bills.join(text, "invoice_id", "left"), "bills")


def jn_band_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    bills = view(spark, sf_dir, "SELECT invoice_id, vendor_id, invoice_date, document_hash FROM live")
    return duplicates.pairs(bills).select(F.col("a.invoice_id").alias("invoice_a"), F.col("b.invoice_id").alias("invoice_b"))


def dup_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.score(duplicates.pairs(invoices_with_text(spark, sf_dir)))


def dup_scan(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    """The pairs that reach a tier and are not ``known`` (invoice_a, invoice_b) already; the tables hold no known ones."""
    known = spark.createDataFrame([], "invoice_a long, invoice_b long") if known is None else known
    return duplicates.unknown(dup_score(spark, sf_dir), known)


PO_LINES = """SELECT 'PO-' || cast(invoice_id AS string) AS po_number, line_no, description, hsn_sac, cast(quantity + CASE invoice_id % 7 WHEN 1 THEN 3 WHEN 2 THEN -1 ELSE 0 END AS decimal(14,3)) AS quantity,
  cast(unit_price + CASE WHEN invoice_id % 11 = 3 THEN 1 + floor(unit_price / 10) ELSE 0 END AS decimal(14,2)) AS unit_price FROM invoice_lines WHERE invoice_id % 9 <> 0 AND NOT (invoice_id % 13 = 1 AND line_no = 2)"""
BILLED = "SELECT l.invoice_id, l.line_no, CASE WHEN l.invoice_id % 17 <> 0 THEN 'PO-' || cast(l.invoice_id AS string) END AS po_number, l.description, l.hsn_sac, l.quantity, l.unit_price FROM invoice_lines l"


def po_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return purchase_orders.check(view(spark, sf_dir, BILLED), view(spark, sf_dir, PO_LINES))


def jn_po_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = purchase_orders.best_lines(view(spark, sf_dir, BILLED), view(spark, sf_dir, PO_LINES))
    return rows.select("invoice_id", "line_no", "po_line_no")


def jn_po_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return purchase_orders.greedy(written(view(spark, sf_dir, BILLED), "billed"), written(view(spark, sf_dir, PO_LINES), "ordered"))


def _amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(view(spark, sf_dir, "SELECT vendor_id, invoice_id, cast(grand_total AS double) AS amount FROM live WHERE grand_total > 0"), "amounts")


def win_loo_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = anomaly.loo_robust_z(_amounts(spark, sf_dir), "vendor_id", "amount", "invoice_id")
    return rows.select("invoice_id", F.round("median", 4).alias("median"), F.round("z", 6).alias("z"))


LOO_SQL = """WITH a AS (SELECT vendor_id, invoice_id, cast(grand_total AS double) AS amount FROM live WHERE grand_total > 0),
  m AS (SELECT x.vendor_id, x.invoice_id, x.amount, median(o.amount) AS med, count(*) AS others FROM a x JOIN a o ON x.vendor_id = o.vendor_id AND x.invoice_id <> o.invoice_id GROUP BY ALL),
  d AS (SELECT m.invoice_id, median(abs(o.amount - m.med)) AS mad, stddev_pop(o.amount) AS sd, count(DISTINCT o.amount) AS different FROM m JOIN a o ON m.vendor_id = o.vendor_id AND m.invoice_id <> o.invoice_id GROUP BY m.invoice_id)
  SELECT m.invoice_id, round(med, 4) AS median, round(abs(amount - med) / CASE WHEN mad > 0 THEN 1.4826 * mad WHEN different > 1 THEN sd END, 6) AS z FROM m JOIN d ON m.invoice_id = d.invoice_id WHERE others >= 4"""


def _prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(view(spark, sf_dir, "SELECT i.vendor_id AS vendor, lower(trim(l.description)) AS item, l.invoice_id, l.line_no, cast(l.unit_price AS double) AS price FROM invoice_lines l JOIN live i ON l.invoice_id = i.invoice_id"), "prices")


def win_price_dev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomaly.price_deviation(_prices(spark, sf_dir)).withColumn("median", F.round("median", 4))


PRICE_SQL = """WITH p AS (SELECT i.vendor_id AS vendor, lower(trim(l.description)) AS item, l.invoice_id, l.line_no, cast(l.unit_price AS double) AS price FROM invoice_lines l JOIN live i ON l.invoice_id = i.invoice_id WHERE l.unit_price <> 0),
  q AS (SELECT *, count(*) OVER (PARTITION BY vendor, item) AS n FROM p),
  m AS (SELECT q.invoice_id, q.line_no, q.price, median(o.price) AS med FROM q JOIN q o ON q.vendor = o.vendor AND q.item = o.item AND q.invoice_id <> o.invoice_id WHERE q.n >= 3 GROUP BY ALL)
  SELECT invoice_id, line_no, price, round(med, 4) AS median FROM m WHERE abs(price - med) / med >= 0.3"""


def anomaly_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(invoice_id, kind, score): branches of one shape, united; a branch names an invoice once."""
    z = anomaly.loo_robust_z(_amounts(spark, sf_dir), "vendor_id", "amount", "invoice_id").where("z >= 3.5")
    odd = z.select("invoice_id", F.lit("unusual_amount").alias("kind"), F.least(F.lit(95), F.floor(40 + F.round("z", 6) * 8).cast("int")).alias("score"))
    dear = anomaly.price_deviation(_prices(spark, sf_dir)).select("invoice_id", F.lit("price_deviation").alias("kind"), F.lit(55).alias("score")).distinct()
    return odd.unionByName(dear).unionByName(view(spark, sf_dir, RULES_SQL))


RULES_SQL = """SELECT DISTINCT invoice_id, 'unusual_gst_rate' AS kind, 60 AS score FROM invoice_lines WHERE gst_rate = 7
  UNION ALL SELECT DISTINCT invoice_id, 'rate_for_code', 50 FROM findings WHERE code = 'HSN_RATE_MISMATCH'
  UNION ALL SELECT invoice_id, 'abnormal_frequency', 45 FROM (SELECT invoice_id, count(*) OVER (PARTITION BY vendor_id, invoice_date) AS n FROM live WHERE invoice_date IS NOT NULL) f WHERE n >= 3
  UNION ALL SELECT invoice_id, 'duplicate_like', 70 FROM live WHERE possible_duplicate
  UNION ALL SELECT invoice_id, 'round_amount', 25 FROM live WHERE grand_total >= 50000 AND grand_total % 10000 = 0"""


def _with_rates(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    rates = anomaly.odd_rates(view(spark, sf_dir, "SELECT invoice_id, gst_rate FROM invoice_lines"))
    errors = view(spark, sf_dir, "SELECT DISTINCT invoice_id, true AS has_error FROM findings WHERE severity = 'ERROR'")
    return view(spark, sf_dir, sql).join(rates, "invoice_id", "left").join(errors, "invoice_id", "left").join(view(spark, sf_dir, analytics.QUERIES["win_expand_mad"]), "invoice_id", "left")


def ml_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = anomaly.features(_with_rates(spark, sf_dir, "SELECT * FROM live"))
    return rows.select("invoice_id", *[F.round(f, 6).alias(f) for f in anomaly.FEATURES])


#: The gap without the query's own rounding, so that it is rounded once.
UNROUNDED_GAP = analytics.QUERIES["win_gap_prev"](dialect.DUCKDB).replace("round(ln(", "(ln(").replace("), 9) AS log_gap", ")) AS log_gap")
FEATURES_SQL = f"""SELECT l.invoice_id, round(ln(1 + cast(nullif(l.grand_total, 0) AS double)), 6) AS log_amount, round(CASE WHEN l.subtotal > 0 THEN cast(l.total_tax AS double) / cast(l.subtotal AS double) END, 6) AS tax_ratio, round(x.deviation, 6) AS deviation,
  cast(p.prior_30d AS double) AS prior_30d, round(g.log_gap, 6) AS log_gap, cast(nullif(l.n_lines, 0) AS double) AS n_lines, CASE WHEN l.grand_total >= 10000 AND l.grand_total % 1000 = 0 THEN 1e0 ELSE 0e0 END AS round_amount,
  CASE WHEN dayofweek(l.invoice_date) = 0 THEN 1e0 ELSE 0e0 END AS sunday, round(CASE WHEN b.n >= 5 THEN b.rate END, 6) AS bad_rate, round(r.odd, 6) AS odd_rates
  FROM live l JOIN ({analytics.QUERIES['win_prior_30d']}) p ON l.invoice_id = p.invoice_id JOIN ({UNROUNDED_GAP}) g ON l.invoice_id = g.invoice_id JOIN ({analytics.QUERIES['win_expand_mad'](dialect.DUCKDB)}) x ON l.invoice_id = x.invoice_id
  LEFT JOIN (SELECT invoice_id, avg(CASE WHEN gst_rate IN (0, 0.1, 0.25, 1, 1.5, 3, 5, 6, 7.5, 12, 18, 28, 40) THEN 0e0 ELSE 1e0 END) AS odd FROM invoice_lines GROUP BY invoice_id) r ON l.invoice_id = r.invoice_id
  JOIN (SELECT invoice_id, count(*) OVER w AS n, avg(CASE WHEN gstr2b_status = 'MISSING_IN_2B' OR invoice_id IN (SELECT invoice_id FROM findings WHERE severity = 'ERROR') THEN 1e0 ELSE 0e0 END) OVER w AS rate FROM live WINDOW w AS ({analytics.FRAME})) b ON l.invoice_id = b.invoice_id"""


def ml_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_rates(spark, sf_dir, "SELECT invoice_id, vendor_id, invoice_date, created_on, grand_total, subtotal, total_tax, n_lines, gstr2b_status FROM live")
    return anomaly.detect(written(anomaly.features(rows), "features"))


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "SELECT c_mktsegment AS series, invoice_date, grand_total FROM live JOIN customer ON vendor_id = c_custkey WHERE invoice_date IS NOT NULL")
    return written(forecast.series(rows, "series", "invoice_date", "grand_total"), "series")


def ml_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomaly.signals(written(anomaly.features(_with_rates(spark, sf_dir, "SELECT * FROM live")), "features"))


def dup_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.upload_check(_uploads(spark, sf_dir))


def dup_alt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.alternative_check(_uploads(spark, sf_dir))


def _uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(view(spark, sf_dir, "SELECT invoice_id, vendor_gstin, invoice_number, invoice_date, document_hash, po_number, grand_total FROM live"), "uploads")


def po_check_alt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return purchase_orders.check_alternative(written(view(spark, sf_dir, BILLED), "billed"), written(view(spark, sf_dir, PO_LINES), "ordered"))


def recon_po_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return purchase_orders.line_view(view(spark, sf_dir, BILLED), view(spark, sf_dir, PO_LINES))


def ts_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.metrics(_series(spark, sf_dir), "series")


def _model(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = _series(spark, sf_dir).select("series", F.posexplode(forecast.MODELS[name](F.col("y"), forecast.HORIZON)).alias("step", "value"))
        return got.select("series", (F.col("step") + 1).alias("step"), F.round("value", 2).alias("value"))

    return query


def ts_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.select_model(_series(spark, sf_dir), "series")


#: Series with their gaps filled, for DuckDB.
SERIES = """raw AS (SELECT c_mktsegment AS series, date_trunc('month', invoice_date) AS m, cast(cast(sum(grand_total) AS decimal(18,2)) AS double) AS v FROM live JOIN customer ON vendor_id = c_custkey WHERE invoice_date IS NOT NULL GROUP BY 1, 2),
  spine AS (SELECT series, unnest(generate_series(min(m), max(m), INTERVAL 1 MONTH)) AS m FROM raw GROUP BY series), s AS (SELECT spine.series, spine.m AS month, coalesce(v, 0) AS v FROM spine LEFT JOIN raw ON spine.series = raw.series AND spine.m = raw.m)"""
LAST_SQL = f"WITH {SERIES}, k AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY month DESC) AS k FROM s)"


def tax_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = view(spark, sf_dir, "SELECT c_custkey AS person, cast(c_custkey * 7919 % 3000000 AS double) AS salary, cast(c_custkey * 31 % 200000 AS double) AS sec_80c FROM customer")
    return tax.regime_tax(people, "new").unionByName(tax.regime_tax(people, "old")).select("person", "regime", "taxable", "relief", "tax")


SRC_SQL = "SELECT supplier_gstin, invoice_number, invoice_date, cast(taxable_value AS decimal(18,2)) AS taxable_value, cast(coalesce(total_tax, 0) AS decimal(18,2)) AS igst, itc_available, itc_reason FROM records WHERE return_period IS NOT NULL AND (ascii(substr(supplier_gstin, 11, 1)) + cast(substr(return_period, 6, 2) AS int)) % 13 > 2"
REFUSED_SQL = """WITH s AS (SELECT DISTINCT supplier_gstin, return_period, (ascii(substr(supplier_gstin, 11, 1)) + cast(substr(return_period, 6, 2) AS int)) % 13 AS kind FROM records WHERE return_period IS NOT NULL)
  SELECT CASE kind WHEN 0 THEN 'not a JSON object' WHEN 1 THEN 'no return period' ELSE 'no b2b section' END AS reason, count(*) AS n FROM s WHERE kind < 3 GROUP BY kind UNION ALL SELECT 'section cdnr', 2 * count(*) FROM s WHERE kind = 3 HAVING count(*) > 0"""


#: Which statements are spoilt, of thirteen kinds: cut off, without a period, without the section that is read.  Every kind below four has a section more.
SPOILT = "(ascii(substr(supplier_gstin, 11, 1)) + cast(substr(return_period, 6, 2) AS int)) % 13"


def _statement_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records written as statements, one of a supplier and period in a line, some of them spoilt, and read as texts with what is wrong with them."""
    rows = view(spark, sf_dir, f"SELECT *, {SPOILT} AS kind FROM records WHERE return_period IS NOT NULL")
    money = lambda c: F.col(c).cast("decimal(14,2)")
    item = F.struct(F.lit(1).alias("num"), money("taxable_value").alias("txval"), money("total_tax").alias("igst"))
    bill = F.struct(F.col("invoice_number").alias("inum"), F.date_format("invoice_date", "dd-MM-yyyy").alias("dt"), F.lit("N").alias("rev"), F.when(F.col("itc_available"), "Y").otherwise("N").alias("itcavl"), F.col("itc_reason").alias("rsn"), F.array(item).alias("items"))
    by = rows.groupBy("supplier_gstin", "return_period", "kind").agg(F.collect_list(bill).alias("inv"))  # a month of one supplier
    b2b = F.when(F.col("kind") != 2, F.array(F.struct(F.col("supplier_gstin").alias("ctin"), F.col("inv").alias("inv"))))
    notes = F.when(F.col("kind") < 4, F.array(F.lit("a"), F.lit("b")))
    period = F.when(F.col("kind") != 1, F.concat(F.substring("return_period", 6, 2), F.substring("return_period", 1, 4))).otherwise("soon")
    doc = F.struct(F.lit("27AAPFU0939F1ZV").alias("gstin"), period.alias("rtnprd"), F.struct(b2b.alias("b2b"), notes.alias("cdnr")).alias("docdata"))
    said = F.to_json(F.struct(doc.alias("data")))
    path = f"{shared_folder(spark)}/statements-{uuid.uuid4().hex}"
    by.select(F.when(F.col("kind") == 0, F.left(said, F.length(said) - 9)).otherwise(said).alias("value")).write.text(path)
    return files.judged(spark.read.text(path).withColumn("file", F.input_file_name()))


def src_2b_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the statements that are some."""
    got = files.good_lines(_statement_texts(spark, sf_dir))
    return got.select("supplier_gstin", "invoice_number", "invoice_date", "taxable_value", "igst", "itc_available", "itc_reason")


def src_2b_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is set aside: statements by what is wrong with them, and entries of sections that aren't read."""
    known = _statement_texts(spark, sf_dir)
    wrong = files.refused(known).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return wrong.unionByName(files.skipped_sections(known).groupBy(F.concat(F.lit("section "), "section").alias("reason")).agg(F.sum("entries").alias("n")))


def snk_replace_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
    rows = view(spark, sf_dir, "SELECT record_id, return_period, total_tax FROM records")
    files.replace_period(rows, path)
    files.replace_period(rows.where("return_period = '2001-02'").withColumn("total_tax", F.lit(0).cast(rows.schema["total_tax"].dataType)), path)
    return spark.read.parquet(path).select("record_id", F.col("return_period").cast("string").alias("return_period"), "total_tax")


def snk_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/receipts-{uuid.uuid4().hex}"
    rows = view(spark, sf_dir, "SELECT event_id, user_id, event_type FROM events WHERE event_type = 'purchase'")
    files.append_new(rows.where("event_id % 2 = 0"), path, "event_id")
    files.append_new(rows, path, "event_id")
    return spark.read.parquet(path)


def _stream(job: Callable[[DataFrame], DataFrame], keys: tuple[str, ...] = ()) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        # a pattern, since a stream's plain path must be a folder
        where = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
        return jobs.run_once(job(jobs.event_stream(spark, f"{sf_dir}/event[s].parquet")), f"{where}/out", f"{where}/checkpoint", keys)

    return query


def fn_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit, subsequence, set and block similarity of neighbouring parts' names."""
    parts = view(spark, sf_dir, "SELECT p_partkey, p_name, lead(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS other FROM part").where("other is not null")
    return parts.select("p_partkey", similarity.osa_distance("p_name", "other").alias("osa"), F.round(similarity.indel("p_name", "other"), 6).alias("indel"), F.round(similarity.token_set_udf("p_name", "other"), 6).alias("token_set"), F.round(similarity.sequence_ratio_udf("p_name", "other"), 6).alias("blocks"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "rec_2b": rec_2b, "rec_2b_missing": rec_2b_missing, "rec_2b_blocks": rec_2b_blocks, "jn_block_fuzzy": jn_block_fuzzy, "jn_band_dup_pairs": jn_band_dup_pairs, "dup_score": dup_score, "dup_scan": dup_scan, "po_check": po_check, "jn_po_best": jn_po_best,
    "jn_po_greedy": jn_po_greedy, "win_loo_median": win_loo_median, "win_price_dev": win_price_dev, "anomaly_rules": anomaly_rules, "ml_features": ml_features, "ml_anomaly": ml_anomaly,
    **{f"ts_{n}": _model(m) for n, m in (("naive", "naive"), ("seasonal", "seasonal"), ("ma3", "moving_average"), ("trend", "linear"), ("ses", "ses"), ("holt", "holt"))},
    "ml_signals": ml_signals, "dup_upload": dup_upload, "dup_alt": dup_alt, "po_check_alt": po_check_alt, "recon_po_view": recon_po_view, "ts_metrics": ts_metrics,
    "ts_select": ts_select, "tax_regime": tax_regime, "src_2b_json": src_2b_json, "src_2b_refused": src_2b_refused, "snk_replace_partition": snk_replace_partition, "snk_idempotent": snk_idempotent, "fn_similarity": fn_similarity,
    "st_alert": _stream(lambda e: jobs.alerts(e, "error", "1 hour", "15 minutes", 2), ("start", "user_id")), "st_idempotent": _stream(jobs.once), "st_auth_dedup": _stream(jobs.quiet_repeats),
}

def _regime_sql(regime: str) -> str:
    slabs, standard, limit, most, marginal = tax.REGIMES[regime]
    off = f"least({standard}, salary)" + (f" + least({tax.CAPS['sec_80c']}, sec_80c)" if regime == "old" else "")
    lower, parts = 0, []
    for upper, rate in slabs:
        parts.append(f"greatest(0, {'taxable' if upper is None else f'least(taxable, {upper})'} - {lower}) * {rate} / 100e0")
        lower = upper
    over = "greatest(0, slab - (taxable - {limit}))".format(limit=limit) if marginal else "0"
    return f"""SELECT person, '{regime}' AS regime, taxable, relief, slab - relief + round((slab - relief) * {tax.CESS} / 100) AS tax FROM (SELECT *, cast(CASE WHEN taxable <= {limit} THEN least(slab, {most}) ELSE {over} END AS double) AS relief FROM (
      SELECT *, round({' + '.join(parts)}) AS slab FROM (SELECT person, round(greatest(0, salary - ({off}))) AS taxable FROM (SELECT c_custkey AS person, cast(c_custkey * 7919 % 3000000 AS double) AS salary, cast(c_custkey * 31 % 200000 AS double) AS sec_80c FROM customer) c) t) s) r"""


ORACLES: dict[str, dialect.Template] = {
    "tax_regime": f"{_regime_sql('new')} UNION ALL {_regime_sql('old')}",
    "ml_features": FEATURES_SQL,
    "st_alert": "SELECT w AS start, user_id, count(*) AS n FROM (SELECT user_id, unnest([time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE for k in [0, 1, 2, 3]]) AS w FROM events WHERE event_type = 'error') e GROUP BY 1, 2 HAVING count(*) >= 2",
    "st_idempotent": "SELECT * FROM events",
    "st_auth_dedup": """WITH RECURSIVE e AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'signup'), kept AS (SELECT user_id, min(ts) AS ts FROM e GROUP BY user_id UNION ALL SELECT e.user_id, min(e.ts) FROM kept k JOIN e ON e.user_id = k.user_id AND e.ts >= k.ts + INTERVAL 10 MINUTE GROUP BY e.user_id)
      SELECT k.user_id, k.ts, min(e.event_id) AS event_id FROM kept k JOIN e ON k.user_id = e.user_id AND k.ts = e.ts GROUP BY 1, 2""",
    "rec_2b_blocks": _blocks_sql,
    "jn_band_dup_pairs": "SELECT a.invoice_id AS invoice_a, b.invoice_id AS invoice_b FROM live a JOIN live b ON a.vendor_id = b.vendor_id AND a.invoice_id < b.invoice_id WHERE abs(datediff('day', a.invoice_date, b.invoice_date)) <= 180 UNION SELECT a.invoice_id, b.invoice_id FROM live a JOIN live b ON a.document_hash = b.document_hash AND a.invoice_id < b.invoice_id",
    "win_loo_median": LOO_SQL,
    "anomaly_rules": f"SELECT invoice_id, 'unusual_amount' AS kind, cast(least(95, floor(40 + z * 8)) AS int) AS score FROM ({LOO_SQL}) l WHERE z >= 3.5 UNION ALL SELECT DISTINCT invoice_id, 'price_deviation', 55 FROM ({PRICE_SQL}) p UNION ALL {RULES_SQL}",
    "win_price_dev": PRICE_SQL,
    "ts_naive": f"{LAST_SQL} SELECT series, cast(step AS int) AS step, round(v, 2) AS value FROM k, (VALUES (1), (2), (3)) AS t(step) WHERE k = 1",
    "ts_seasonal": f"{LAST_SQL} SELECT series, cast(13 - k AS int) AS step, round(v, 2) AS value FROM k WHERE k BETWEEN 10 AND 12",
    "ts_ma3": f"{LAST_SQL} SELECT series, cast(step AS int) AS step, round(avg(v), 2) AS value FROM k, (VALUES (1), (2), (3)) AS t(step) WHERE k <= 3 GROUP BY 1, 2",
    "ts_trend": f"WITH {SERIES}, x AS (SELECT series, v, row_number() OVER (PARTITION BY series ORDER BY month) - 1 AS x FROM s), r AS (SELECT series, regr_slope(v, x) AS b, regr_intercept(v, x) AS a, count(*) AS n FROM x GROUP BY 1) SELECT series, cast(step AS int) AS step, round(greatest(0, a + b * (n + step - 1)), 2) AS value FROM r, (VALUES (1), (2), (3)) AS t(step)",
    "src_2b_json": SRC_SQL,
    "src_2b_refused": REFUSED_SQL,
    "snk_replace_partition": "SELECT record_id, return_period, CASE WHEN return_period = '2001-02' THEN 0 ELSE total_tax END AS total_tax FROM records",
    "snk_idempotent": "SELECT event_id, user_id, event_type FROM events WHERE event_type = 'purchase'",
}
