"""Audit of how far sources of one language differ, by DuckDB over shards.

Words are counted by (language, source); a language keeps the terms that at least ``LEAST_DOCS`` of its documents have.  With add-one
smoothing each group, and each language as a whole, gives each kept term a probability in billionths; the divergence of a group from another is
the chi-square sum over the kept terms, and a group's marks are the terms by which it exceeds its language most.  All numbers are whole.

1.  Where the texts are read, each task counts them with DuckDB in slices of ``SLICE_BYTES`` and passes on a row for each (language, source,
    term), so a hot language or word sends one row a task and source.
2.  Rows are dealt to shards by a hash of language and term.  A shard sums them, drops what too few documents have, and writes each kept term
    as one row with its counts by source: from here on any part of that table is a shard, and nothing is shuffled by term again.
3.  Spark sums the groups' totals.  Shards then add up the pairs: a sum over all kept terms is that of a term which neither group has, times
    the number of terms, and corrections for terms that one has or both have; so a shard's work follows its counts and not terms x sources x sources.
4.  Spark adds the shards' pair sums and merges their rankings, of at most ``TOP`` terms a shard and group, in two rounds.

What is sent to every task is the list of groups, at most ``GROUP_ROWS`` at a time; more are taken as pairs of blocks, a pass each.

Cases: null text, language and source are empty ones; a document is a row, so repeated rows count again; a group without terms has a
probability of 1 and a smoothed share like any other; a language that keeps no term has sums of 0; one source alone has no pairs; ties go to the
item that comes first in UTF-8; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxloom.llm.common import Work, dealt_out

#: What isn't part of a term.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCS, TOP, SCALE = 3, 200, 1_000_000_000
#: Bytes of text that are counted at once, counted rows that a task holds, and groups that are sent to tasks; they bound memory and leave results alone.
SLICE_BYTES, HELD_ROWS, GROUP_ROWS = 8 << 20, 1_000_000, 20_000
MEMORY = "400MB"

COUNTS = "lang string, source string, term string, n long, docs long"
KEPT = "lang string, term string, n long, sources array<struct<source:string,n:long>>"
PARTS = "lang string, source string, part string, item string, value decimal(38,0)"


def _database(scratch: str):
    """A database of one thread in memory that spills into the task's own folder."""
    import duckdb

    db = duckdb.connect()
    _run(db, f"SET threads = 1; SET memory_limit = '{MEMORY}'; SET temp_directory = '{scratch}'; SET preserve_insertion_order = false")
    return db


def _run(db, sql: str, *values) -> list[tuple]:
    """Runs a statement to its end."""
    return db.execute(sql, values or None).fetchall()


def _batches(db, sql: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    yield from db.sql(sql).to_arrow_table().cast(schema).to_batches(max_chunksize=100_000)


_TEXT, _LONG = pa.string(), pa.int64()
_COUNTS = pa.schema([("lang", _TEXT), ("source", _TEXT), ("term", _TEXT), ("n", _LONG), ("docs", _LONG)])
_KEPT = pa.schema([("lang", _TEXT), ("term", _TEXT), ("n", _LONG), ("sources", pa.list_(pa.struct([("source", _TEXT), ("n", _LONG)])))])
_PARTS = pa.schema([("lang", _TEXT), ("source", _TEXT), ("part", _TEXT), ("item", _TEXT), ("value", pa.decimal128(38, 0))])


def _slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.Table]:
    """Parts of a batch (text, lang, source) with at most ``most`` bytes of text, a longer text by itself."""
    ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch["text"]), 0).cast(pa.int64())).to_pylist()
    start, before = 0, 0
    for i, end in enumerate(ends):
        if end - before > most and i > start:
            yield pa.Table.from_batches([batch.slice(start, i - start)])
            start, before = i, ends[i - 1]
    if start < len(ends):
        yield pa.Table.from_batches([batch.slice(start)])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 1: occurrences and documents by (lang, source, term)."""
    sums = "SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM held GROUP BY ALL"
    with tempfile.TemporaryDirectory() as scratch, _database(scratch) as db:
        _run(db, "CREATE TABLE held (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
        for batch in batches:
            for rows in _slices(batch, SLICE_BYTES):
                db.register("rows", rows.set_column(0, "text", pc.ascii_lower(rows["text"])))
                words = "SELECT i, lang, source, unnest(string_split_regex(text, ?)) AS term FROM (SELECT row_number() OVER () AS i, * FROM rows)"
                found = f"SELECT lang, source, i, term, count(*) AS k FROM ({words}) WHERE term <> '' GROUP BY ALL"
                _run(db, f"INSERT INTO held SELECT lang, source, term, sum(k), count(*) FROM ({found}) GROUP BY ALL", BETWEEN)
                db.unregister("rows")
                if _run(db, "SELECT count(*) FROM held")[0][0] > HELD_ROWS:
                    yield from _batches(db, sums, _COUNTS)
                    _run(db, "DELETE FROM held")
        yield from _batches(db, sums, _COUNTS)


def _keep(least: int):
    """Step 2: the kept terms of a shard with their counts by source."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as scratch, _database(scratch) as db:
            _run(db, "CREATE TABLE rows (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
            for batch in batches:
                db.register("batch", pa.Table.from_batches([batch]))
                _run(db, "INSERT INTO rows SELECT lang, source, term, n, docs FROM batch")
                db.unregister("batch")
            yield from _batches(
                db,
                f"""WITH summed AS (SELECT lang, term, source, sum(n)::BIGINT AS n, sum(docs) AS docs FROM rows GROUP BY ALL)
                SELECT lang, term, sum(n)::BIGINT AS n, list({{'source': source, 'n': n}} ORDER BY source) AS sources FROM summed GROUP BY ALL HAVING sum(docs) >= {least}""",
                _KEPT,
            )

    return keep


def _share(n: str, total: str) -> str:
    """The smoothed share of ``n`` in billionths; ``total`` has one for each kept term."""
    return f"(1 + {SCALE}::HUGEINT * ({n} + 1) // {total})::BIGINT"


#: How far p is from q, in units of q, a whole number.
_APART = "(({p} - {q}) * ({p} - {q}) // {q})"


def _pairs(left: pa.Table, right: pa.Table, top: int, terms: bool):
    """Step 3: partial sums of the pairs of ``left`` and ``right`` groups (lang, source, total, lang_total), and the highest terms of ``left``."""
    f = lambda p, q: _APART.format(p=p, q=q)
    present = lambda side: f"SELECT k.lang, k.term, g.source, {_share('k.c.n', 'g.total')} AS p, g.p0 FROM (SELECT lang, term, unnest(sources) AS c FROM shard) k JOIN {side} g ON k.lang = g.lang AND k.c.source = g.source"
    sums = f"""
    WITH l AS MATERIALIZED ({present("lhs")}), r AS MATERIALIZED ({present("rhs")}),
    both_have AS (
      SELECT l.lang, l.source, r.source AS item, sum({f("l.p", "r.p")} - {f("l.p", "r.p0")} - {f("l.p0", "r.p")} + {f("l.p0", "r.p0")}) AS value
      FROM l JOIN r ON l.lang = r.lang AND l.term = r.term AND l.source <> r.source GROUP BY ALL
    ), left_has AS (
      SELECT h.lang, h.source, r.source AS item, sum(h.k * ({f("h.p", "r.p0")} - {f("h.p0", "r.p0")})) AS value
      FROM (SELECT lang, source, p, p0, count(*) AS k FROM l GROUP BY ALL) h JOIN rhs r ON h.lang = r.lang AND h.source <> r.source GROUP BY ALL
    ), right_has AS (
      SELECT h.lang, l.source, h.source AS item, sum(h.k * ({f("l.p0", "h.p")} - {f("l.p0", "h.p0")})) AS value
      FROM (SELECT lang, source, p, p0, count(*) AS k FROM r GROUP BY ALL) h JOIN lhs l ON h.lang = l.lang AND h.source <> l.source GROUP BY ALL
    )
    SELECT lang, source, 'pair' AS part, item, sum(value)::DECIMAL(38,0) AS value FROM (FROM both_have UNION ALL FROM left_has UNION ALL FROM right_has) GROUP BY ALL"""
    highest = f"""
    WITH entries AS (SELECT lang, term, n, unnest(sources) AS c FROM shard),
    shares AS (SELECT e.lang, g.source, e.term, {_share("e.c.n", "g.total")} AS p, {_share("e.n", "g.lang_total")} AS q FROM entries e JOIN lhs g ON e.lang = g.lang AND e.c.source = g.source)
    SELECT lang, source, 'term' AS part, term AS item, {f("p", "q")}::DECIMAL(38,0) AS value FROM shares WHERE p > q
    QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= {top}"""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as scratch, _database(scratch) as db:
            _run(db, "CREATE TABLE shard (lang VARCHAR, term VARCHAR, n BIGINT, sources STRUCT(source VARCHAR, n BIGINT)[])")
            for name, groups in (("lhs", left), ("rhs", right)):
                db.register("groups", groups)
                _run(db, f"CREATE TABLE {name} AS SELECT *, {_share('0', 'total')} AS p0 FROM groups")
                db.unregister("groups")
            for batch in batches:
                db.register("batch", pa.Table.from_batches([batch]))
                _run(db, "INSERT INTO shard SELECT lang, term, n, sources FROM batch")
                db.unregister("batch")
            if _run(db, "SELECT count(*) FROM shard")[0][0]:
                yield from _batches(db, sums, _PARTS)
                if terms:
                    yield from _batches(db, highest, _PARTS)

    return pairs


def groups_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, v, total, lang_total) of every occurring group: the kept terms of its language, and the occurrences of kept terms in the group and
    in the language with one more for each kept term."""
    found = docs.select("lang", "source").distinct()
    counts = kept.select("lang", F.explode("sources").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("n"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("all"))
    rows = found.join(counts, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["n", "v", "all"])
    return rows.select("lang", "source", "v", (F.col("n") + F.col("v")).alias("total"), (F.col("all") + F.col("v")).alias("lang_total"))


def _apart(p, q):
    return F.expr(f"cast(({p} - {q}) * ({p} - {q}) div {q} as decimal(38,0))")


def _first_terms(found: DataFrame, top: int) -> DataFrame:
    """The ``top`` terms of each group out of those of its shards, first within 64 lots of terms."""
    order = lambda *more: Window.partitionBy("lang", "source", *more).orderBy(F.desc("value"), "item")
    lots = found.withColumn("lot", F.pmod(F.xxhash64("item"), F.lit(64))).withColumn("place", F.row_number().over(order("lot"))).where(F.col("place") <= top)
    return lots.withColumn("rank", F.row_number().over(order())).where(F.col("rank") <= top).select("lang", "source", "part", "item", "value", "rank")


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has the divergence of each group from each other of its language, part ``term``
    the ``top`` terms by which it exceeds its language."""
    work = Work(docs.sparkSession, "source-divergence")
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    counts = dealt_out(rows).mapInArrow(_count, COUNTS)
    kept = work.write(counts.repartition("lang", "term").mapInArrow(_keep(least_docs), KEPT), "kept")
    groups = work.write(groups_of(rows, kept), "groups")

    # blocks of groups in order of language; only blocks that share a language have pairs
    blocks, n = [], groups.count()
    ordered = groups.orderBy("lang", "source") if n > group_rows else groups
    for start in range(0, n, group_rows):
        block = ordered.offset(start).limit(group_rows) if n > group_rows else groups
        blocks.append(block.where("total > 0").select("lang", "source", "total", "lang_total").toArrow())
    parts = []
    for i, left in enumerate(blocks):
        for j, right in enumerate(blocks):
            if pc.any(pc.is_in(left["lang"], right["lang"].combine_chunks())).as_py():
                parts.append(work.write(kept.mapInArrow(_pairs(left, right, top, i == j), PARTS), f"parts-{i}-{j}"))

    # of a term that neither group has; a language without kept terms has sums of 0
    p0 = groups.withColumn("p0", F.expr(f"1 + {SCALE} div greatest(total, 1)"))
    met = p0.select("lang", "source", F.col("p0").alias("p"), "v").join(p0.select("lang", F.col("source").alias("item"), F.col("p0").alias("q")), "lang").where("source <> item")
    base = met.select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("v").cast("decimal(18,0)") * _apart("p", "q").cast("decimal(19,0)")).cast("decimal(38,0)").alias("value"))
    found = base
    for part in parts:
        found = found.union(part.where("part = 'pair'"))
    pairs = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    out = pairs
    if parts:
        terms = parts[0]
        for part in parts[1:]:
            terms = terms.union(part)
        out = pairs.union(_first_terms(terms.where("part = 'term'"), top))
    work.keep(groups, *parts)
    return out.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank")
