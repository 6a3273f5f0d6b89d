"""Query text for Spark SQL and, from the same templates, for the DuckDB check.

A template is a string, or a function of a :class:`Dialect` where the two engines spell something differently.  The adapter views it
names are prepended as common table expressions, only those it needs.  On Spark the views that many queries share, each a join and a window over all
lines, are written once for a folder of tables, as staged Parquet in the shared folder, and read from there: columns are
pruned and filters pushed at that scan.  A staged view is written anew when the files it comes from change.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from taxloom.operators.work import written

#: Views that are written once; each may name earlier ones.
STAGED = ("invoice_lines", "invoices", "findings", "records", "credit")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Dialect:
    def __init__(self, spark: bool):
        self.spark = spark

    def days(self, a: str, b: str) -> str:
        """Days from a to b."""
        return f"datediff(day, {a}, {b})" if self.spark else f"datediff('day', {a}, {b})"

    def replace(self, x: str, pattern: str, by: str) -> str:
        """All matches of a pattern without backslashes; ``<1>`` in ``by`` is the first group."""
        return f"regexp_replace({x}, '{pattern}', '{by.replace('<1>', '$1')}')" if self.spark else f"regexp_replace({x}, '{pattern}', '{by.replace('<1>', chr(92) + '1')}', 'g')"

    def matches(self, x: str, pattern: str) -> str:
        return f"regexp_like({x}, '{pattern}')" if self.spark else f"regexp_matches({x}, '{pattern}')"

    def present(self, items: list[str]) -> str:
        """One row for each item that isn't null."""
        return f"explode(array_compact(array({', '.join(items)})))" if self.spark else f"unnest([x for x in [{', '.join(items)}] if x IS NOT NULL])"

    def joined(self, items: list[str]) -> str:
        """The items that aren't null, with '; ' between."""
        return f"concat_ws('; ', {', '.join(items)})"

    def distinct_text(self, x: str) -> str:
        """Sorted distinct values of a group as one text."""
        return f"array_join(array_sort(collect_set({x})), ', ')" if self.spark else f"coalesce(string_agg(DISTINCT {x}, ', ' ORDER BY {x}), '')"

    def framed_median(self, x: str, over: str) -> str:
        return f"percentile({x}, 0.5) OVER ({over})" if self.spark else f"median({x}) OVER ({over})"

    def encoded(self, x: str) -> str:
        """A text in base64 with the alphabet of urls and without padding."""
        plain = f"replace(replace(base64(cast({x} AS binary)), chr(13), ''), chr(10), '')" if self.spark else f"to_base64(encode({x}))"
        return f"replace(translate({plain}, '+/', '-_'), '=', '')"

    def decoded(self, x: str) -> str:
        padded = f"rpad(translate({x}, '-_', '+/'), cast(4 * ceil(length({x}) / 4e0) AS int), '=')"
        return f"cast(unbase64({padded}) AS string)" if self.spark else f"decode(from_base64({padded}))"

    def words(self, x: str) -> str:
        return f"array_distinct(split({x}, ' '))" if self.spark else f"list_distinct(string_split({x}, ' '))"

    def overlap(self, a: str, b: str) -> str:
        """Common over all elements of two arrays."""
        if self.spark:
            return f"size(array_intersect({a}, {b})) / cast(size(array_union({a}, {b})) AS double)"
        return f"len(list_intersect({a}, {b})) / cast(len(list_distinct(list_concat({a}, {b}))) AS double)"

    def half_even(self, x: str, n: int) -> str:
        return f"bround({x}, {n})" if self.spark else f"round_even({x}, {n})"

    def json(self, x: str, path: str) -> str:
        return f"get_json_object({x}, '$.{path}')" if self.spark else f"json_extract_string({x}, '$.{path}')"

    def slot(self, ts: str, seconds: int) -> str:
        """The start, in epoch seconds, of the tumbling slot of a timestamp."""
        epoch = f"unix_seconds(cast({ts} AS timestamp))" if self.spark else f"cast(floor(epoch({ts})) AS bigint)"
        return f"({epoch} - {epoch} % {seconds})"


SPARK, DUCKDB = Dialect(True), Dialect(False)
Template = str | Callable[[Dialect], str]


def render(template: Template, views: dict[str, Template], d: Dialect) -> str:
    text = lambda t: t if isinstance(t, str) else t(d)
    body, needed, todo = text(template).strip(), {}, []
    todo = [body]
    while todo:
        words = set(re.findall(r"\b\w+\b", todo.pop()))
        for name in views:
            if name in words and name not in needed:
                needed[name] = text(views[name]).strip()
                todo.append(needed[name])
    ctes = [f"{name} AS ({needed[name]})" for name in views if name in needed]
    if not ctes:
        return body
    return f"WITH {', '.join(ctes)}{', ' + body[5:] if body[:5].upper() == 'WITH ' else ' ' + body}"


#: Staged views by session, folder of tables with the state of its files, and name.
_staged: dict[tuple, DataFrame] = {}


def _files(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, lengths and times of the files that the views come from."""
    found = []
    for table in ("customer", "orders", "lineitem"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{table}.parquet")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        found += sorted((x.getPath().toString(), x.getLen(), x.getModificationTime()) for x in fs.listStatus(path))
    return tuple(found)


def _stage(spark: SparkSession, sf_dir: str, name: str, views: dict[str, Template], state: tuple) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name, state)
    if key not in _staged:
        _staged[key] = written(_run(spark, sf_dir, views[name], {k: v for k, v in views.items() if k != name}, state), name)
    return _staged[key]


def _run(spark: SparkSession, sf_dir: str, template: Template, views: dict[str, Template], state: tuple) -> DataFrame:
    own = {k: v for k, v in views.items() if k not in STAGED}
    sql = render(template, own, SPARK)
    named = set(re.findall(r"\b\w+\b", sql))
    # all are staged before any is named, since staging one names others
    staged = {name: _stage(spark, sf_dir, name, views, state) for name in STAGED if name in named and name in views}
    for name, table in staged.items():
        table.createOrReplaceTempView(name)
    for table in named & set(TABLES):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    return spark.sql(sql)


def run(spark: SparkSession, sf_dir: str, template: Template, views: dict[str, Template]) -> DataFrame:
    return _run(spark, sf_dir, template, views, _files(spark, sf_dir) if views else ())
