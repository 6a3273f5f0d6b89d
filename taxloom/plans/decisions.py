"""Registered queries of what changes the register: statements imported and taken back, reviewers' decisions, credit evaluated again, uploads tried again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxloom.operators import casefile, imports, matching, review
from taxloom.operators.work import shared_folder, written
from taxloom.plans import dialect, engine
from taxloom.sources.adapters import VIEWS, credit_of
from taxloom.streaming import jobs, retry

#: Header fields that a reviewer may correct.
CORRECTABLE = ("invoice_number", "invoice_date", "vendor_gstin")


def eligible_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices that a statement may match, once for each period whose statement may hold them: not rejected, and no possible duplicates but approved ones."""
    rows = engine.view(spark, sf_dir, "SELECT invoice_id AS book, vendor_gstin_true AS gstin, invoice_number AS number, invoice_date AS day, subtotal AS taxable, total_tax AS tax FROM live WHERE invoice_date IS NOT NULL AND (status = 'APPROVED' OR NOT possible_duplicate)")
    month = lambda d: F.trunc(d, "month")
    months = F.sequence(month(F.col("day")), month(F.date_add("day", engine.LOOKBACK)), F.expr("interval 1 month"))
    return written(matching.keyed(rows).withColumn("period", F.explode(F.transform(months, lambda m: F.date_format(m, "yyyy-MM")))), "books")


def _log(spark: SparkSession) -> imports.StatementLog:
    return imports.StatementLog(spark, f"{shared_folder(spark)}/statements-{uuid.uuid4().hex}")


def _with_state(spark: SparkSession, sf_dir: str, state: DataFrame) -> DataFrame:
    live = engine.view(spark, sf_dir, "SELECT invoice_id FROM live")
    return live.join(state.select(F.col("book").alias("invoice_id"), F.col("status").alias("gstr2b_status"), "record"), "invoice_id", "left")


def rec_2b_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statement status and record of every live invoice once the statements of all periods are imported."""
    log = _log(spark)
    log.take("all", engine.statement(spark, sf_dir), eligible_books(spark, sf_dir))
    return _with_state(spark, sf_dir, log.state())


def rec_2b_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All periods are imported, the last is taken back and imported again: the status of each live invoice after the second and after the third of these."""
    log, lines, books = _log(spark), engine.statement(spark, sf_dir), eligible_books(spark, sf_dir)
    log.take("all", lines, books)
    last = lines.agg(F.max("period")).first()[0] or ""
    log.undo("last", [last], books)
    without = written(_with_state(spark, sf_dir, log.state()).withColumnRenamed("gstr2b_status", "without").drop("record"), "without")
    log.take("again", lines.where(F.col("period") == last), books)
    return without.join(_with_state(spark, sf_dir, log.state()).drop("record"), "invoice_id")


#: Actions of reviewers: three events in a row are about one invoice; a fourth of the corrections are of a field that can't be corrected.
ACTIONS = """SELECT cast(floor(event_id / 3) AS bigint) AS invoice_id, ts AS acted_at, event_id AS action_id, CASE event_type WHEN 'purchase' THEN 'approve' WHEN 'error' THEN 'reject' WHEN 'signup' THEN 'pay' ELSE 'correct' END AS action,
  'user' || cast(user_id AS string) AS actor, CASE WHEN event_type = 'signup' THEN cast(cast('1992-06-01' AS date) + cast(event_id % 3400 AS int) * INTERVAL 1 DAY AS date) END AS paid_on,
  CASE event_id % 4 WHEN 0 THEN 'invoice_date' WHEN 1 THEN 'invoice_number' WHEN 2 THEN 'vendor_gstin' ELSE 'colour' END AS field,
  CASE event_id % 4 WHEN 0 THEN cast(cast(cast('1994-01-01' AS date) + cast(event_id % 2000 AS int) * INTERVAL 1 DAY AS date) AS string) WHEN 1 THEN ' inv/' || lpad(cast(cast(floor(event_id / 3) AS bigint) + event_id % 2 AS string), 8, '0') ELSE '27AAPFV0001A1Z5' END AS value FROM events WHERE event_type <> 'view'"""


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = "map('invoice_number', invoice_number, 'invoice_date', cast(invoice_date AS string), 'vendor_gstin', vendor_gstin)"
    rows = engine.view(spark, sf_dir, f"SELECT invoice_id, status, payment_date, {values} AS `values` FROM invoices")
    return written(review.folded(rows, engine.view(spark, sf_dir, ACTIONS), CORRECTABLE), "reviewed")


def review_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _folded(spark, sf_dir)
    return done.select("invoice_id", "status", "payment_date", "reviewer", "applied", "refused", *[F.try_element_at("values", F.lit(f)).alias(f) for f in CORRECTABLE])


def review_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.feedback(_folded(spark, sf_dir))


def itc_reassess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The credit of every invoice before and after the reviewers' decisions, by the rules of credit over the folded status, dates and payments."""
    done = _folded(spark, sf_dir).where("status is not null").select("invoice_id", "status", "payment_date", F.try_element_at("values", F.lit("invoice_date")).try_cast("date").alias("invoice_date"))
    bills = engine.view(spark, sf_dir, "SELECT * FROM invoices")
    new = done.select("invoice_id", F.struct("status", "payment_date", "invoice_date").alias("n"))
    after = bills.join(new, "invoice_id", "left")
    after = after.withColumns({c: F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(c)) for c in ("status", "payment_date", "invoice_date")}).drop("n")
    name = f"reviewed_{uuid.uuid4().hex}"
    after.createOrReplaceTempView(name)
    cols = "c.invoice_id, c.itc_status, c.eligible_itc, c.reasons"
    credit = engine.view(spark, sf_dir, f"SELECT {cols} FROM ({credit_of(dialect.SPARK, name)}) c")
    before = engine.view(spark, sf_dir, "SELECT invoice_id, itc_status AS status_before FROM credit")
    return before.join(credit, "invoice_id")


#: What a vendor needs attention for: errors in its invoices and invoices that statements don't have.
ATTENTION = "SELECT i.vendor_id, count(*) AS attention FROM invoices i JOIN (SELECT invoice_id FROM findings WHERE severity = 'ERROR' UNION ALL SELECT invoice_id FROM invoices WHERE gstr2b_status = 'MISSING_IN_2B') x ON i.invoice_id = x.invoice_id GROUP BY i.vendor_id"
HEADER = f"""SELECT i.invoice_id, i.status, i.n_lines, i.confidence, i.vendor_gstin, i.invoice_number, i.invoice_date, i.grand_total, i.einvoice_status, i.gstr2b_status, c.itc_status, coalesce(a.attention, 0) AS attention
  FROM invoices i LEFT JOIN credit c ON i.invoice_id = c.invoice_id LEFT JOIN ({ATTENTION}) a ON i.vendor_id = a.vendor_id"""


def _case_files(spark: SparkSession, sf_dir: str, orders: bool) -> DataFrame:
    read, one = lambda sql: engine.view(spark, sf_dir, sql), F.lit(None)
    children = [
        casefile.entries(read("SELECT * FROM findings"), "finding", F.lpad(F.coalesce(F.col("line_no").cast("string"), F.lit("0")), 6, "0"), F.col("code"), F.col("severity"), F.col("field")),
        casefile.entries(read("SELECT invoice_id FROM invoices WHERE possible_duplicate"), "duplicate", one, F.lit("DUPLICATE_LIKELY"), F.lit("ERROR")),
        casefile.entries(engine.anomaly_rules(spark, sf_dir) if orders else read(engine.RULES_SQL), "risk", one, F.col("kind"), F.col("score")),
        casefile.entries(read(ACTIONS), "action", F.date_format("acted_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.col("action"), F.col("actor")),
    ]
    if orders:
        children.append(casefile.entries(engine.po_check(spark, sf_dir), "order", F.lpad(F.col("line_no").cast("string"), 6, "0"), F.col("status"), F.col("code")))
    return casefile.gathered(read(HEADER), *children)


def workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An invoice's row with what belongs to it: findings by line, risks, whether it may be a duplicate, and what was done, in order."""
    files = _case_files(spark, sf_dir, orders=False)
    names = lambda kind: F.array_join(F.transform(kind, lambda e: e["name"]), " ")
    return files.select("invoice_id", "status", "gstr2b_status", "itc_status", names("finding").alias("findings"), F.size(F.filter("finding", lambda e: e["level"] == "ERROR")).alias("errors"), names("risk").alias("risks"), (F.size("duplicate") > 0).alias("may_be_duplicate"), names("action").alias("actions"))


def investigate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return casefile.investigated(_case_files(spark, sf_dir, orders=True))


#: Uploads of files: errors fail, purchases get through, a signup is the user's wish to try at once.
UPLOADS = {"error": retry.FAILED, "purchase": retry.PASSED, "signup": retry.NOW}
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def st_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What happens to files whose uploads are the events of half the users each."""
    kind = F.coalesce(*[F.when(F.col("event_type") == e, F.lit(k)) for e, k in UPLOADS.items()])
    tries = jobs.event_stream(spark, f"{sf_dir}/event[s].parquet").select(F.floor(F.col("user_id") / 2).alias("file"), "event_id", "ts", kind.alias("kind")).where("kind is not null")
    where = f"{shared_folder(spark)}/retry-{uuid.uuid4().hex}"
    # the provider is a setting of the session that a running query keeps
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        return jobs.run_once(retry.retries(tries), f"{where}/out", f"{where}/checkpoint")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (rec_2b_apply, rec_2b_delete, review_actions, review_feedback, itc_reassess, workspace, investigate, st_retry)}


# The same said by windows instead of folds, for DuckDB.

_APPLIED = f"""acts AS ({ACTIONS}), known AS (SELECT a.*, i.invoice_id IS NOT NULL AND (action <> 'correct' OR field IN {CORRECTABLE}) AS good FROM acts a LEFT JOIN invoices i ON a.invoice_id = i.invoice_id),
  decided AS (SELECT invoice_id, arg_max(CASE action WHEN 'reject' THEN 'REJECTED' ELSE 'APPROVED' END, (acted_at, action_id)) FILTER (good AND action <> 'pay') AS status, arg_max(actor, (acted_at, action_id)) FILTER (good AND action <> 'pay') AS reviewer,
    arg_max(paid_on, (acted_at, action_id)) FILTER (good AND action = 'pay') AS paid_on, count(*) FILTER (good) AS applied, count(*) FILTER (NOT good) AS refused,
    {", ".join(f"arg_max(value, (acted_at, action_id)) FILTER (good AND action = 'correct' AND field = '{f}') AS new_{f}" for f in CORRECTABLE)} FROM known GROUP BY invoice_id)"""
_REVIEWED = f"""SELECT d.invoice_id, coalesce(d.status, i.status) AS status, coalesce(paid_on, payment_date) AS payment_date, reviewer, cast(applied AS int) AS applied, cast(refused AS int) AS refused,
  coalesce(new_invoice_number, invoice_number) AS invoice_number, coalesce(new_invoice_date, cast(invoice_date AS string)) AS invoice_date, coalesce(new_vendor_gstin, vendor_gstin) AS vendor_gstin FROM decided d LEFT JOIN invoices i ON d.invoice_id = i.invoice_id"""
_FEEDBACK = f"""WITH {_APPLIED}, f AS (SELECT k.invoice_id, action_id, field, lag(value) OVER (PARTITION BY k.invoice_id, field ORDER BY acted_at, action_id) AS earlier, value, actor,
  CASE field WHEN 'invoice_number' THEN invoice_number WHEN 'invoice_date' THEN cast(invoice_date AS string) ELSE vendor_gstin END AS printed, row_number() OVER (PARTITION BY k.invoice_id, field ORDER BY acted_at, action_id) AS nth
  FROM known k JOIN invoices i ON k.invoice_id = i.invoice_id WHERE good AND action = 'correct')
  SELECT invoice_id, action_id, field, CASE WHEN nth = 1 THEN printed ELSE earlier END AS predicted, value AS corrected, upper(trim(CASE WHEN nth = 1 THEN printed ELSE earlier END)) IS NOT DISTINCT FROM upper(trim(value)) AS was_correct, actor FROM f"""


def _reassess_sql(d: dialect.Dialect) -> str:
    cols = "i.* EXCLUDE (status, payment_date, invoice_date), coalesce(r.status, i.status) AS status, CASE WHEN r.invoice_id IS NULL THEN i.payment_date ELSE r.payment_date END AS payment_date, CASE WHEN r.invoice_id IS NULL THEN i.invoice_date ELSE cast(r.invoice_date AS date) END AS invoice_date"
    return f"""WITH {_APPLIED}, reviewed AS ({_REVIEWED}), after AS (SELECT {cols} FROM invoices i LEFT JOIN reviewed r ON i.invoice_id = r.invoice_id)
      SELECT c.invoice_id, c.itc_status AS status_before, n.itc_status, n.eligible_itc, n.reasons FROM credit c JOIN ({credit_of(d, "after")}) n ON c.invoice_id = n.invoice_id"""


def _retry_sql() -> str:
    """One step of the recursion an event of a file: its state afterwards; the waits that ended come from each failure and what follows it."""
    due, open_ = "(s.waiting AND e.micros >= s.next_try)", f"(s.attempts < {retry.MOST} AND e.micros >= s.next_try)"
    kind = " ".join(f"WHEN '{e}' THEN '{k}'" for e, k in UPLOADS.items())
    fails, tried = f"({open_} AND e.kind = '{retry.FAILED}')", f"{retry.MOST - 1}"
    return f"""WITH RECURSIVE ev AS (SELECT cast(floor(user_id / 2) AS bigint) AS file, epoch_us(ts) AS micros, event_id, CASE event_type {kind} END AS kind FROM events WHERE event_type IN {tuple(UPLOADS)}),
      e AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY micros, event_id) AS nth FROM ev), last AS (SELECT max(micros) - 3600000000 AS mark FROM (SELECT epoch_us(ts) AS micros FROM events WHERE event_type IN {tuple(UPLOADS)})),
      s AS (SELECT file, cast(0 AS bigint) AS nth, cast(0 AS bigint) AS micros, '' AS kind, false AS known, cast(0 AS int) AS attempts, cast(0 AS bigint) AS next_try, false AS waiting, cast(NULL AS varchar) AS said, cast(NULL AS int) AS n, cast(NULL AS bigint) AS till, cast(NULL AS bigint) AS due FROM (SELECT DISTINCT file FROM e)
        UNION ALL SELECT e.file, e.nth, e.micros, e.kind, CASE WHEN e.kind = '{retry.NOW}' THEN s.known WHEN {open_} AND e.kind = '{retry.PASSED}' THEN false ELSE s.known OR {fails} END,
          cast(CASE WHEN e.kind = '{retry.NOW}' THEN least(s.attempts, {tried}) WHEN {open_} THEN CASE e.kind WHEN '{retry.PASSED}' THEN 0 ELSE s.attempts + 1 END ELSE s.attempts END AS int),
          CASE WHEN e.kind = '{retry.NOW}' THEN 0 WHEN {open_} THEN CASE e.kind WHEN '{retry.PASSED}' THEN 0 ELSE e.micros + least(cast({retry.UNIT} * pow(2, s.attempts + 1) AS bigint), {retry.LONGEST}) END ELSE s.next_try END,
          CASE WHEN e.kind = '{retry.NOW}' THEN false WHEN {open_} THEN e.kind = '{retry.FAILED}' AND s.attempts < {tried} ELSE s.waiting AND NOT {due} END,
          CASE WHEN e.kind = '{retry.NOW}' THEN CASE WHEN s.known THEN 'asked' END WHEN {open_} THEN CASE WHEN e.kind = '{retry.PASSED}' THEN 'done' WHEN s.attempts = {tried} THEN 'given up' ELSE 'failed' END END,
          cast(CASE WHEN e.kind = '{retry.NOW}' THEN least(s.attempts, {tried}) ELSE s.attempts + 1 END AS int), CASE WHEN e.kind = '{retry.NOW}' THEN 0 WHEN {fails} AND s.attempts < {tried} THEN e.micros + least(cast({retry.UNIT} * pow(2, s.attempts + 1) AS bigint), {retry.LONGEST}) END,
          CASE WHEN {due} THEN s.next_try END FROM s JOIN e ON e.file = s.file AND e.nth = s.nth + 1)
      SELECT file, micros, said AS kind, n AS attempts, till AS next_try FROM s WHERE said IS NOT NULL
      UNION ALL SELECT s.file, s.due, 'due', (SELECT max(b.attempts) FROM s b WHERE b.file = s.file AND b.nth = s.nth - 1), s.due FROM s WHERE s.due IS NOT NULL
      UNION ALL SELECT file, next_try, 'due', attempts, next_try FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY nth DESC) AS k FROM s) z, last WHERE k = 1 AND waiting AND next_try <= mark"""


_WORKSPACE = f"""SELECT h.invoice_id, h.status, h.gstr2b_status, h.itc_status, coalesce(f.findings, '') AS findings, cast(coalesce(f.errors, 0) AS int) AS errors, coalesce(r.risks, '') AS risks, i.possible_duplicate AS may_be_duplicate, coalesce(a.actions, '') AS actions
  FROM ({HEADER}) h JOIN invoices i ON i.invoice_id = h.invoice_id LEFT JOIN (SELECT invoice_id, string_agg(code, ' ' ORDER BY coalesce(line_no, 0), code) AS findings, count(*) FILTER (severity = 'ERROR') AS errors FROM findings GROUP BY 1) f ON f.invoice_id = h.invoice_id
  LEFT JOIN (SELECT invoice_id, string_agg(kind, ' ' ORDER BY kind) AS risks FROM ({engine.RULES_SQL}) x GROUP BY 1) r ON r.invoice_id = h.invoice_id LEFT JOIN (SELECT invoice_id, string_agg(action, ' ' ORDER BY acted_at, action) AS actions FROM ({ACTIONS}) x GROUP BY 1) a ON a.invoice_id = h.invoice_id"""


ORACLES: dict[str, dialect.Template] = {
    "workspace": _WORKSPACE,
    "review_actions": f"WITH {_APPLIED} {_REVIEWED}",
    "review_feedback": _FEEDBACK,
    "itc_reassess": _reassess_sql,
    "st_retry": _retry_sql(),
}
