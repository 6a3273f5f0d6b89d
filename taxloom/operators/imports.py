"""Statements imported into the register, taken back and imported again: a log of commits that each hold what they change.

A commit is a folder ``log/<number>`` with the statement's ``records`` and, written last, its ``effects``: for every invoice that it touches the state
afterwards (status, record, period).  It counts once the marker that Spark writes after all files of the effects is there; what a job that died left
behind is overwritten by the next commit and read by nobody.  An invoice's state is the last commit's that has it, so taking an import back is
one more commit, and an import that is sent again under its own id changes nothing.

An import takes what an earlier import of its periods did back first.  Several periods may come in one import: they count in order, so an invoice that one
period's statement has isn't there for the next.  All are reconciled at once, and again without the invoices that earlier periods took, until
nothing changes; the first period is right at once, the second after the first, so that this ends, most often after the second time.
One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxloom.operators import matching
from taxloom.operators.work import Work

EFFECTS = "book long, status string, record long, period string"
RECORDS = "line long, book long, status string, score double, period string"
IN, MISSING = "IN_2B", "MISSING_IN_2B"


class StatementLog:
    """The register's statement state under ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def commits(self) -> list[str]:
        """Names of the commits in order: number, operation and id."""
        names = [x.getPath().getName() for x in self._fs.listStatus(self._at("log"))] if self._fs.exists(self._at("log")) else []
        return sorted(n for n in names if self._fs.exists(self._at(f"log/{n}/effects/_SUCCESS")))

    def _commit(self, kind: str, name: str, records: DataFrame, effects: DataFrame, fail: Callable[[], None] | None) -> None:
        n = len(self.commits())
        folder = f"{self.path}/log/{n:08d}-{kind}-{name}"
        records.write.mode("overwrite").parquet(f"{folder}/records")
        if fail:
            fail()
        effects.write.mode("overwrite").parquet(f"{folder}/effects")

    def _read(self, what: str, schema: str) -> DataFrame:
        """Rows of all commits with the commit's number ``n``."""
        paths = [f"{self.path}/log/{c}/{what}" for c in self.commits()]
        if not paths:
            return self.spark.createDataFrame([], f"{schema}, n int")
        rows = self.spark.read.schema(schema).parquet(*paths)  # one scan, however many commits
        return rows.withColumn("n", F.regexp_extract(F.input_file_name(), r"/log/([0-9]{8})-", 1).cast("int"))

    def state(self) -> DataFrame:
        """(book, status, record, period) of every invoice that has a state."""
        rows = self._read("effects", EFFECTS).groupBy("book").agg(F.max_by(F.struct("status", "record", "period"), "n").alias("s"))
        return rows.select("book", "s.*").where("status is not null")

    def records(self) -> DataFrame:
        """(line, book, status, score, period): of each period the lines of its last import, unless it was taken back."""
        rows = self._read("records", RECORDS)
        last = rows.groupBy("period").agg(F.max("n").alias("n"))
        return rows.join(last, ["period", "n"]).where("line is not null").drop("n")

    def _cleared(self, periods: DataFrame, books: DataFrame) -> DataFrame:
        """The invoices that imports of ``periods`` linked, and those missing in the statement of the period that they are dated in."""
        if not self.commits():
            return books.select("book").limit(0)
        state = self.state()
        lines = self.records().join(periods, "period", "left_semi").select(F.col("line").alias("record"))
        linked = state.join(lines, "record", "left_semi").select("book")
        dated = books.select("book", F.date_format("day", "yyyy-MM").alias("period")).distinct().join(periods, "period", "left_semi")
        missing = state.where(F.col("status") == MISSING).join(dated, "book", "left_semi").select("book")
        return linked.union(missing).distinct()

    def take(self, name: str, lines: DataFrame, books: DataFrame, fail: Callable[[], None] | None = None) -> bool:
        """Import the statement ``lines`` (line, period, gstin, number, day, taxable, tax) under ``name`` against ``books`` (book, period, and the same), the
        invoices that may be in each period's statement.  False if the last commit of that name has these periods already."""
        if any(c.split("-", 2)[1:] == ["take", name] for c in self.commits()) and not self._undone(name):
            return False
        work = Work(self.spark, "import")
        periods = work.write(lines.select("period").distinct(), "periods")
        cleared = work.write(self._cleared(periods, books), "cleared")
        held = self.state().join(cleared, "book", "left_anti").where(F.col("status") == IN).select("book")
        open_ = work.write(books.join(periods, "period", "left_semi").join(held, "book", "left_anti"), "open")
        results, taken = self._in_order(lines, open_, work)
        linked = results.where("book is not null").select("book", F.when(F.col("status") == "GSTIN_MISMATCH", MISSING).otherwise(IN).alias("status"), F.col("line").alias("record"), "period")
        dated = open_.where(F.date_format("day", "yyyy-MM") == F.col("period"))
        missing = dated.join(results.where("book is not null").select("book", "period"), ["book", "period"], "left_anti").select("book", F.lit(MISSING).alias("status"), F.lit(None).cast("long").alias("record"), "period")
        # in the statement beats a link under another tax id, and that beats being missing; of equals the later period
        rank = F.struct((F.col("status") == IN).cast("int"), F.col("record").isNotNull().cast("int"), "period")
        after = linked.union(missing).groupBy("book").agg(F.max_by(F.struct("status", "record", "period"), rank).alias("s")).select("book", "s.*")
        gone = cleared.join(after, "book", "left_anti").select("book", F.lit(None).cast("string").alias("status"), F.lit(None).cast("long").alias("record"), F.lit(None).cast("string").alias("period"))
        effects = work.write(after.union(gone), "effects")
        # an empty statement of a period replaces what was there, so the period itself is recorded
        empty = periods.select(F.lit(None).cast("long").alias("line"), F.lit(None).cast("long").alias("book"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("double").alias("score"), "period")
        self._commit("take", name, work.write(results.select("line", "book", "status", "score", "period").union(empty), "records"), effects, fail)
        work.keep()
        return True

    def _undone(self, name: str) -> bool:
        """Whether the import ``name`` was taken back after it was last made."""
        kinds = [c.split("-", 2)[1] for c in self.commits() if c.split("-", 2)[2] == name]
        return bool(kinds) and kinds[-1] == "undo"

    def undo(self, name: str, periods: list[str], books: DataFrame, fail: Callable[[], None] | None = None) -> bool:
        """Take the import of ``periods`` back, in the log under ``name``: its records go, and so do the states that came from it.  False if that is done already."""
        if self._undone(name) or not self.commits():
            return False
        work = Work(self.spark, "undo")
        wanted = self.spark.createDataFrame([(p,) for p in periods], "period string")
        empty = wanted.select(F.lit(None).cast("long").alias("line"), F.lit(None).cast("long").alias("book"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("double").alias("score"), "period")
        effects = work.write(self._cleared(wanted, books).select("book", F.lit(None).cast("string").alias("status"), F.lit(None).cast("long").alias("record"), F.lit(None).cast("string").alias("period")), "effects")
        self._commit("undo", name, empty, effects, fail)
        work.keep()
        return True

    def _in_order(self, lines: DataFrame, books: DataFrame, work: Work) -> tuple[DataFrame, DataFrame]:
        """(line, book, status, score, period) as if the periods had come one by one, and the (book, period) that were taken before."""
        lines, books = matching.keyed(lines), matching.keyed(books)
        # pairs are met and scored once; each time those of invoices that are taken are left out
        met = work.write(matching.scored(lines, books), "met")
        taken = work.write(books.select("book", "period").limit(0), "taken")
        while True:
            found = matching.reconcile(lines, books.join(taken, ["book", "period"], "left_anti"), met=met.join(taken, ["book", "period"], "left_anti"))
            results = work.write(found.join(lines.select("line", "period"), "line"), "results")
            first = results.where("book is not null and status <> 'GSTIN_MISMATCH'").groupBy("book").agg(F.min("period").alias("first"))
            now = work.write(books.select("book", "period").join(first, "book").where("period > first").select("book", "period"), "taken")
            relevant = now.join(taken, ["book", "period"], "left_anti").union(taken.join(now, ["book", "period"], "left_anti"))
            # a change matters only where the invoice has a line of its tax id and number or amounts, or of its number
            if relevant.isEmpty() or not self._matters(lines, books, met, work.write(relevant, "relevant")):
                return results, now
            work.drop(results, taken)
            taken = now

    @staticmethod
    def _matters(lines: DataFrame, books: DataFrame, met: DataFrame, relevant: DataFrame) -> bool:
        """Whether there are lines that reconciliation would look at for the ``relevant`` (book, period)."""
        if not met.join(relevant, ["book", "period"], "left_semi").isEmpty():
            return True
        number = lambda t: t.where("_n <> ''").select("period", "_n")
        return not number(books.join(relevant, ["book", "period"], "left_semi")).join(number(lines), ["period", "_n"], "left_semi").isEmpty()
