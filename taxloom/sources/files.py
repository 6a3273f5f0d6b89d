"""Sources and sinks: the statement's JSON, rule tables, and the write paths with their replace and idempotence rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(14,2)"
ITEM = f"struct<num:int,rt:double,txval:{MONEY},igst:{MONEY},cgst:{MONEY},sgst:{MONEY},cess:{MONEY}>"
BILL = f"struct<inum:string,dt:string,val:{MONEY},pos:string,rev:string,itcavl:string,rsn:string,irn:string,items:array<{ITEM}>>"
BODY = f"gstin:string,rtnprd:string,gendt:string,docdata:struct<b2b:array<struct<ctin:string,trdnm:string,supfildt:string,inv:array<{BILL}>>>>"
STATEMENT = f"data struct<{BODY}>, " + BODY.replace("gstin:string", "gstin string", 1).replace("rtnprd:string", "rtnprd string", 1).replace("gendt:string", "gendt string", 1).replace("docdata:struct", "docdata struct", 1)


def statement_lines(raw: DataFrame) -> DataFrame:
    """Lines of statements read with ``STATEMENT``, with or without the outer ``data``; item taxes are summed per invoice.

    A statement without a six-digit period or without its b2b section is refused when rows are read.
    """
    pick = lambda f: F.coalesce(F.col(f"data.{f}"), F.col(f))
    top = raw.select(pick("gstin").alias("gstin"), pick("rtnprd").alias("period"), pick("docdata").alias("d"))
    valid = F.coalesce(F.col("period").rlike("^[0-9]{6}$"), F.lit(False)) & F.col("d.b2b").isNotNull()
    top = top.withColumn("b2b", F.when(valid, F.col("d.b2b")).otherwise(F.raise_error(F.lit("not a statement: period or b2b section missing"))))
    return _bills(top)


def _bills(top: DataFrame) -> DataFrame:
    """The invoices of (gstin, period, b2b, and what else comes first)."""
    bills = top.select("gstin", "period", F.explode("b2b").alias("s")).select("gstin", "period", F.col("s.ctin").alias("supplier_gstin"), F.col("s.trdnm").alias("supplier_name"), F.explode("s.inv").alias("i"))
    total = lambda f: F.aggregate(F.coalesce("i.items", F.array().cast(f"array<{ITEM}>")), F.lit(0).cast("decimal(18,2)"), lambda a, x: (a + F.coalesce(x[f], F.lit(0).cast(MONEY))).cast("decimal(18,2)"))
    return bills.select(
        "gstin", "period", "supplier_gstin", "supplier_name", F.col("i.inum").alias("invoice_number"), F.try_to_timestamp("i.dt", F.lit("dd-MM-yyyy")).cast("date").alias("invoice_date"),
        F.col("i.val").alias("invoice_value"), *[total(f).alias(n) for f, n in (("txval", "taxable_value"), ("igst", "igst"), ("cgst", "cgst"), ("sgst", "sgst"), ("cess", "cess"))],
        (F.upper(F.coalesce("i.rev", F.lit("N"))) == "Y").alias("reverse_charge"), (F.upper(F.coalesce("i.itcavl", F.lit("Y"))) != "N").alias("itc_available"), F.nullif("i.rsn", F.lit("")).alias("itc_reason"),
    )


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    return statement_lines(spark.read.schema(STATEMENT).json(path, multiLine=True))


SUPPLIERS = f"array<struct<ctin:string,trdnm:string,supfildt:string,inv:array<{BILL}>>>"


def judged(raw: DataFrame) -> DataFrame:
    """(file, value, reason, period, docdata): why each text of ``raw`` (file, value) isn't a statement, null if it is one.  No text ends the read of the others."""
    body = F.coalesce(F.get_json_object("value", "$.data"), F.col("value"))
    parts = raw.select("file", "value", F.get_json_object(body, "$.rtnprd").alias("period"), F.get_json_object(body, "$.docdata").alias("docdata"))
    reason = (
        F.when(F.json_object_keys("value").isNull(), "not a JSON object").when(~F.coalesce(F.trim("period").rlike("^[0-9]{6}$"), F.lit(False)), "no return period")
        .when(~F.coalesce(F.array_contains(F.json_object_keys("docdata"), "b2b"), F.lit(False)), "no b2b section")
    )
    return parts.withColumn("reason", reason)


def refused(known: DataFrame) -> DataFrame:
    """(file, reason) of ``judged`` texts that are no statements: they are set aside, for somebody to look at."""
    return known.where("reason is not null").select("file", "reason")


def skipped_sections(known: DataFrame) -> DataFrame:
    """(file, section, entries): the lists of statements that aren't read, and how long they are."""
    each = known.where("reason is null").select("file", "docdata", F.explode(F.json_object_keys("docdata")).alias("section")).where("section <> 'b2b'")
    return each.select("file", "section", F.expr("json_array_length(get_json_object(docdata, concat('$.', section)))").alias("entries")).where("entries is not null")


def good_lines(known: DataFrame) -> DataFrame:
    """Lines of ``judged`` texts that are statements, as ``statement_lines`` gives them."""
    good = known.where("reason is null").select(F.lit(None).cast("string").alias("gstin"), F.trim("period").alias("period"), F.from_json(F.get_json_object("docdata", "$.b2b"), SUPPLIERS).alias("b2b"))
    return _bills(good)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """A restricted-credit CSV with a column ``place`` of the order in the file, patterns in lower and actions in upper case."""
    rows = spark.read.csv(path, header=True)
    tidy = rows.select(*[F.trim(c).alias(c) for c in rows.columns]).where("pattern <> ''")
    return tidy.withColumn("pattern", F.lower("pattern")).withColumn("action", F.upper("action")).withColumn("place", F.monotonically_increasing_id())


def read_rates(spark: SparkSession, path: str, code: str = "hsn_sac") -> DataFrame:
    """A rate CSV: code and array of rates, which are split at '|'."""
    rows = spark.read.csv(path, header=True)
    return rows.select(F.trim(code).alias("code"), F.filter(F.transform(F.split("gst_rate", r"\|"), lambda x: x.try_cast("decimal(5,2)")), lambda x: x.isNotNull()).alias("rates"))


def replace_period(records: DataFrame, path: str) -> None:
    """Write statement records by period; a period that is written again replaces its own partition only."""
    records.write.option("partitionOverwriteMode", "dynamic").partitionBy("return_period").mode("overwrite").parquet(path)


def append_new(rows: DataFrame, path: str, key: str) -> None:
    """Append the rows whose key the table doesn't hold; of repeats within the batch the first in the order of their other values stays."""
    spark = rows.sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    rest = [c for c in rows.columns if c != key]
    fresh = rows.groupBy(key).agg(F.min(F.struct(*rest)).alias("_r")).select(key, "_r.*").select(*rows.columns) if rest else rows.distinct()
    if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti").select(rows.columns)
    fresh.write.mode("append").parquet(path)


def write_ndjson(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)
