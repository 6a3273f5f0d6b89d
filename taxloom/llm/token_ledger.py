"""Delta-maintained token counts.

A ledger is a folder.  A batch holds signed changes of documents: ``insert`` adds a document's counts, ``delete`` takes what the
document contributed away, ``revise`` takes it away and adds the new counts.  Committing a batch writes its documents' signed
contributions under ``documents`` and their sums by (source, lang, tokenizer) under ``rollup``.  Totals add the rollups of all batches,
a few rows each, and never read a document's row again.

Commits are idempotent: a batch is committed once the ``_SUCCESS`` file of its rollup is there, which Spark writes last of all.
A batch id that is committed already changes nothing, so a job that died, between the two writes too, may be run again
from its start; what it left unfinished is overwritten, and until then nobody reads it.  A batch's contributions are worked out against the
batches before it: of their documents' rows, those that the batch doesn't touch are thinned out by a bit map where they are read.
``compact`` folds the document rows of all batches into one net row a document and key, so that a long history doesn't slow commits.
One writer at a time.

Token counts are made where the text is read, one call per Arrow batch; what is shuffled is (document, key, counts), and totals are
pre-aggregated sums of at most sources x languages x versions rows per task, so a hot source sends one row per task.

Cases: null text has 0 tokens and 0 characters and counts as a document; null source, language and tokenizer are
keys of their own; inserting a known document adds only the difference, as a revision does; deleting an unknown one does nothing; a document
that occurs several times in a batch is taken once: the last by the batch's column ``seq`` if it has one, then the one whose change, source, lang
and counts come last in order;
null ids are left out; an empty batch commits an empty entry; totals that return to 0 documents are left out.
"""

from __future__ import annotations

import base64
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxloom.llm.common import Work, dealt_out, thinned

#: Where the public tokenizers' files are; a parameter of ``bpe_counter``.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
KEY = ["source", "lang", "tokenizer"]
MEASURES = ["n_docs", "n_tokens", "n_chars"]
ROLLUP = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long"
ENTRY = f"doc_id long, {ROLLUP}"
#: Code points of text that one call of the tokenizer takes at once; longer texts go alone.
CALL_CHARS = 1 << 20

_encodings: dict[str, object] = {}


def _encoding(path: str, pattern: str):
    """The vocabulary, read once per Python worker."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        _encodings[path] = tiktoken.Encoding("ledger", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


#: The public pre-tokenizer pattern of the byte-level vocabulary; a fixed value.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def bpe_counter(path: str = VOCABULARY, pattern: str = PATTERN):
    """A column function: the number of tokens of each whole text."""

    def count(texts: pd.Series) -> pd.Series:
        encoding = _encoding(path, pattern)
        return texts.map(lambda t: len(encoding.encode_ordinary(t)) if isinstance(t, str) and t else 0).astype("int64")

    return F.pandas_udf(count, "long")


def counted(docs: DataFrame, counter, tokenizer: str) -> DataFrame:
    """(doc_id, source, lang, tokenizer, n_tokens, n_chars) of ``docs`` (doc_id, source, lang, text)."""
    return dealt_out(docs).select("doc_id", "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.coalesce(counter(F.col("text")), F.lit(0)).cast("long").alias("n_tokens"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))


class TokenLedger:
    """Totals under ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _is_written(self, folder: str) -> bool:
        return self._fs.exists(self._at(f"{folder}/_SUCCESS"))

    def _written(self, kind: str, prefix: str) -> list[str]:
        root = self._at(kind)
        names = [x.getPath().getName() for x in self._fs.listStatus(root)] if self._fs.exists(root) else []
        return sorted(n.removeprefix(prefix) for n in names if n.startswith(prefix) and self._is_written(f"{kind}/{n}"))

    def batches(self) -> list[str]:
        """The ids of the committed batches."""
        return self._written("rollup", "batch=")

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        read = [self.spark.read.schema(schema).parquet(f"{self.path}/{x}") for x in paths]
        return reduce(DataFrame.union, read) if read else self.spark.createDataFrame([], schema)

    def entries(self) -> DataFrame:
        """Signed contributions by document: the last compaction, and the batches committed since."""
        folded = self._written("compact", "upto=")
        within = set(self.spark.read.text(f"{self.path}/compact/batches={folded[-1]}").toPandas()["value"]) if folded else set()
        return self._read([f"compact/upto={x}" for x in folded[-1:]] + [f"documents/batch={b}" for b in self.batches() if b not in within], ENTRY)

    def contributions(self, of: DataFrame | None = None) -> DataFrame:
        """What each document contributes now, by key; of the documents of ``of`` (a written table) only, and by chance a few others."""
        rows = self.entries() if of is None else thinned(self.entries(), "doc_id", of)
        sums = rows.groupBy("doc_id", *KEY).agg(*[F.sum(m).alias(m) for m in MEASURES])
        return sums.where(" or ".join(f"{m} <> 0" for m in MEASURES))

    def totals(self) -> DataFrame:
        rows = self._read([f"rollup/batch={b}" for b in self.batches()], ROLLUP)
        return rows.groupBy(*KEY).agg(*[F.sum(m).alias(m) for m in MEASURES]).where("n_docs <> 0")

    def compact(self) -> None:
        """Fold all committed batches' document rows into one net row a document and key; totals stay as they are."""
        done = self._written("compact", "upto=")
        name = f"{len(done):08d}"
        self.spark.createDataFrame([(b,) for b in self.batches()], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/compact/batches={name}")
        self.contributions().write.mode("overwrite").parquet(f"{self.path}/compact/upto={name}")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add ``changes`` (op, doc_id, source, lang, tokenizer, n_tokens, n_chars, perhaps seq) as ``batch``; False if it was committed before.

        ``op`` is insert, revise or delete; a delete needs no more than doc_id and tokenizer.
        """
        if not batch or any(c in batch for c in "/=\\\n") or batch.startswith((".", "_")):
            raise ValueError(f"not a batch id: {batch!r}")
        if self._is_written(f"rollup/batch={batch}"):
            return False
        work = Work(self.spark, "commit")
        last = F.struct(*["seq"] * ("seq" in changes.columns), F.col("op").alias("op"), "source", "lang", "n_tokens", "n_chars")
        once = work.write(changes.where("doc_id is not null").groupBy("doc_id", "tokenizer").agg(F.max(last).alias("c")), "changes")
        count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
        delta = once.where("c.op <> 'delete'").select("doc_id", "c.source", "c.lang", "tokenizer", F.lit(1).cast("long").alias("n_docs"), count("c.n_tokens").alias("n_tokens"), count("c.n_chars").alias("n_chars"))
        if self.batches():
            was = self.contributions(once.select("doc_id")).alias("w")
            changed = once.select(F.col("doc_id").alias("d"), F.col("tokenizer").alias("t"))
            old = was.join(changed, (F.col("w.doc_id") == F.col("d")) & F.col("w.tokenizer").eqNullSafe(F.col("t")), "left_semi")
            delta = delta.union(old.select("doc_id", *KEY, *[(-F.col(m)).alias(m) for m in MEASURES]))
        delta = delta.groupBy("doc_id", *KEY).agg(*[F.sum(m).alias(m) for m in MEASURES]).where(" or ".join(f"{m} <> 0" for m in MEASURES))
        documents = f"{self.path}/documents/batch={batch}"
        delta.write.mode("overwrite").parquet(documents)
        # summed from what was written, so that both always agree
        sums = self.spark.read.schema(ENTRY).parquet(documents).groupBy(*KEY).agg(*[F.sum(m).alias(m) for m in MEASURES])
        sums.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/rollup/batch={batch}")
        work.keep()
        return True
