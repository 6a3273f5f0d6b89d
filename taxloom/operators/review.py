"""Decisions of reviewers, folded in their order over the invoices they are about, and what the extractor is told of them.

An invoice's actions are one sorted array and its state a struct that each action advances or refuses: ``approve``, ``reject`` and ``correct`` decide about
the status, ``pay`` sets the day of payment, a correction sets the value of a field.  A correction of a field that can't be corrected is refused as a
whole, so is any action on an invoice that doesn't exist; refused actions are counted and change nothing.  Every correction also says what the
field held before, from which the feedback rows come.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEEDBACK = "array<struct<action_id:long,field:string,predicted:string,corrected:string,was_correct:boolean,actor:string>>"
STATE = f"struct<status:string,payment_date:date,values:map<string,string>,reviewer:string,applied:int,refused:int,feedback:{FEEDBACK}>"


def same_value(a: Column, b: Column) -> Column:
    """Whether two texts are one number, or alike but for case and blanks at the ends; null is like null only."""
    plain = lambda x: F.coalesce(F.regexp_replace(F.trim(x).try_cast("decimal(30,8)").cast("string"), r"\.?0+$", ""), F.upper(F.trim(x)))
    return plain(a).eqNullSafe(plain(b))


def _with(values: Column, field: Column, new: Column) -> Column:
    return F.map_concat(F.map_filter(values, lambda k, v: k != field), F.create_map(field, new))


def folded(invoices: DataFrame, actions: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(invoice_id, status, payment_date, values, reviewer, applied, refused, feedback) of each invoice with actions.

    ``invoices``: (invoice_id, status, payment_date, values: map of a field's name to its text); ``actions``: (invoice_id, acted_at, action_id, action, actor,
    paid_on, field, value), in order of ``acted_at`` and ``action_id``.  An invoice that doesn't exist has a null status and refuses all."""
    said = F.struct("acted_at", "action_id", "action", "actor", "paid_on", "field", "value")
    logs = actions.groupBy("invoice_id").agg(F.array_sort(F.collect_list(said)).alias("log"))  # one invoice's history
    rows = logs.join(invoices.withColumn("known", F.lit(True)), "invoice_id", "left")
    values = F.coalesce(F.col("values"), F.create_map().cast("map<string,string>"))
    first = F.struct(F.col("status").alias("status"), F.col("payment_date").alias("payment_date"), values.alias("values"), F.lit(None).cast("string").alias("reviewer"), F.lit(0).alias("applied"), F.lit(0).alias("refused"), F.array().cast(FEEDBACK).alias("feedback")).cast(STATE)
    allowed = F.array(*[F.lit(f) for f in fields])

    def step(s: Column, a: Column) -> Column:
        corrects = a["action"] == "correct"
        good = F.col("known") & (a["action"].isin("approve", "reject", "pay") | (corrects & F.array_contains(allowed, a["field"])))
        good = F.coalesce(good, F.lit(False))
        old = F.try_element_at(s["values"], a["field"])
        told = F.struct(a["action_id"].alias("action_id"), a["field"].alias("field"), old.alias("predicted"), a["value"].alias("corrected"), same_value(old, a["value"]).alias("was_correct"), a["actor"].alias("actor"))
        status = F.when(~good | (a["action"] == "pay"), s["status"]).when(a["action"] == "reject", F.lit("REJECTED")).otherwise(F.lit("APPROVED"))
        return F.struct(
            status.alias("status"), F.when(good & (a["action"] == "pay"), a["paid_on"]).otherwise(s["payment_date"]).alias("payment_date"),
            F.when(good & corrects, _with(s["values"], a["field"], a["value"])).otherwise(s["values"]).alias("values"),
            F.when(good & (a["action"] != "pay"), a["actor"]).otherwise(s["reviewer"]).alias("reviewer"), (s["applied"] + good.cast("int")).alias("applied"), (s["refused"] + (~good).cast("int")).alias("refused"),
            F.when(good & corrects, F.concat(s["feedback"], F.array(told))).otherwise(s["feedback"]).alias("feedback"),
        ).cast(STATE)

    return rows.select("invoice_id", F.aggregate("log", first, step).alias("s")).select("invoice_id", "s.*")


def feedback(done: DataFrame) -> DataFrame:
    """(invoice_id, action_id, field, predicted, corrected, was_correct, actor): each applied correction beside what the field held before it."""
    return done.select("invoice_id", F.explode("feedback").alias("f")).select("invoice_id", "f.*")
