"""Registered queries of files that are written and read back, of single similarities, of the anomaly model's steps, and of scoring on arrival."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taxloom.functions import similarity, special
from taxloom.operators import anomaly, arrivals, evaluation, registry
from taxloom.operators.work import shared_folder, written
from taxloom.plans import dialect, engine
from taxloom.sources import files
from taxloom.sources.adapters import HSN_RATES, RESTRICTED
from taxloom.streaming import jobs

LISTED = "SELECT invoice_id, vendor_gstin, invoice_number, invoice_date, status, grand_total FROM live"
FOUND = "SELECT invoice_id, line_no, code, severity FROM findings"
BOUGHT = "SELECT event_id, user_id, event_type FROM events WHERE event_type = 'purchase'"


def _folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def snk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(engine.view(spark, sf_dir, FOUND), "findings")


def snk_ndjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = engine.view(spark, sf_dir, LISTED), _folder(spark, "invoices-json")
    files.write_ndjson(rows, path)
    return spark.read.schema(rows.schema).json(path)


def snk_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = engine.view(spark, sf_dir, LISTED), _folder(spark, "invoices-csv")
    files.write_csv(rows, path)
    return spark.read.schema(rows.schema).csv(path, header=True)


def src_blocked_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of restricted credits from a CSV as people type it, with blanks and other cases, and one row without a pattern."""
    path = _folder(spark, "restricted")
    typed = [(kind, f" {pattern.upper()} ", action.lower(), section, category) for kind, pattern, action, section, category in (*RESTRICTED, ("code", "", "blocked", "", "none"))]
    files.write_csv(spark.createDataFrame(typed, "match string, pattern string, action string, section string, category string").coalesce(1), path)
    rules = files.read_rules(spark, path)
    return rules.select((F.rank().over(Window.orderBy("place"))).alias("place"), "match", "pattern", "action", "section", "category")  # a rule table is a page long


def src_hsn_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "rates")
    files.write_csv(spark.createDataFrame([(f" {code}", rates) for code, rates in HSN_RATES], "hsn_sac string, gst_rate string").coalesce(1), path)
    return files.read_rates(spark, path).select("code", F.explode("rates").alias("rate"))


def src_bench_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored results of a benchmark, one JSON object a field, and read back with their schema."""
    path = _folder(spark, "results")
    got = engine.view(spark, sf_dir, "SELECT lang, count(*) AS n, sum(quality) AS hits FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY lang")
    files.write_ndjson(got.select(F.col("lang").alias("field"), F.struct("n", "hits").alias("exact")), path)
    return spark.read.schema("field string, exact struct<n:long,hits:long>").json(path).select("field", "exact.n", "exact.hits")


def st_inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases that arrive as files: a micro-batch that is handed out again overwrites its own folder, and done files aren't taken again."""
    where = _folder(spark, "inbox")
    rows = engine.view(spark, sf_dir, BOUGHT)
    files.write_ndjson(rows, f"{where}/in")
    for _ in range(2):
        jobs.inbox(spark, f"{where}/in", "event_id long, user_id long, event_type string", f"{where}/checkpoint", lambda batch, i: batch.write.mode("overwrite").parquet(f"{where}/out/batch={i}"))
    return spark.read.schema(rows.schema).parquet(f"{where}/out/batch=*")


def jn_temporal_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an invoice may know of its vendor: number, spend and unmatched ones of the strictly earlier invoices."""
    before = Window.partitionBy("vendor_id").orderBy(F.coalesce("invoice_date", "created_on"), "created_on", "invoice_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = engine.view(spark, sf_dir, "SELECT invoice_id, vendor_id, invoice_date, created_on, grand_total, gstr2b_status FROM live")
    missing = F.sum(F.when(F.col("gstr2b_status") == "MISSING_IN_2B", 1).otherwise(0)).over(before)
    return rows.select("invoice_id", F.count(F.lit(1)).over(before).alias("earlier"), F.sum("grand_total").over(before).alias("spent"), missing.alias("missing")).where("earlier > 0")


PRIOR_SQL = """WITH l AS (SELECT *, coalesce(invoice_date, created_on) AS on_day FROM live)
  SELECT a.invoice_id, count(*) AS earlier, sum(b.grand_total) AS spent, cast(sum(CASE WHEN b.gstr2b_status = 'MISSING_IN_2B' THEN 1 ELSE 0 END) AS bigint) AS missing
  FROM l a JOIN l b ON a.vendor_id = b.vendor_id AND (b.on_day < a.on_day OR (b.on_day = a.on_day AND (b.created_on < a.created_on OR (b.created_on = a.created_on AND b.invoice_id < a.invoice_id)))) GROUP BY a.invoice_id"""


def _similar(name: str, measure: Callable, x: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        pairs = engine.view(spark, sf_dir, f"SELECT p_partkey, {x} AS a, lead({x}) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS b FROM part").where("b is not null")
        return pairs.select("p_partkey", F.round(measure("a", "b"), 6).alias(name))

    return query


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(anomaly.features(engine._with_rates(spark, sf_dir, "SELECT * FROM live")), "features")


def ml_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _features(spark, sf_dir)
    return anomaly.robust_z(rows, anomaly.centres(rows)).select("invoice_id", *[F.round(f, 6).alias(f) for f in anomaly.FEATURES])


def ml_robust_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _features(spark, sf_dir)
    return anomaly.robust_z(rows, anomaly.centres(rows)).select("invoice_id", F.round("robust_z", 6).alias("robust_z"))


def _model_rows(spark: SparkSession, model: anomaly.Model | None) -> DataFrame:
    nodes = [(t, i, *node) for t, tree in enumerate(model.forest if model else []) for i, node in enumerate(tree)]
    return spark.createDataFrame(nodes, "tree int, node int, feature int, cut double, left int, right int, depth double")


def ml_iforest_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forest as a table of nodes: 200 trees of at most 511."""
    return _model_rows(spark, anomaly.fit(_features(spark, sf_dir)))


def ml_iforest_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomaly.detect(_features(spark, sf_dir)).select("invoice_id", "forest_score")


def ml_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomaly.detect(_features(spark, sf_dir)).select("invoice_id", "rank_pct", "priority", "sufficiency")


def ml_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of the model, of the invoices up to a day and of all: the second is active, and each is loaded from its tables and scores all invoices."""
    store, rows = registry.ModelStore(spark, _folder(spark, "models")), _features(spark, sf_dir)
    early = rows.join(engine.view(spark, sf_dir, "SELECT invoice_id FROM live WHERE invoice_date < date '1998-01-01'"), "invoice_id", "left_semi")
    scored = None
    for known in (early, rows):
        model = anomaly.fit(written(known, "known"))
        if model is not None:
            store.activate(store.save(model))
            by = anomaly.ensemble(rows, store.load()).groupBy(F.lit(store.active()).alias("version")).agg(F.count(F.lit(1)).alias("scored"), F.count(F.when(F.col("priority") == "high", 1)).alias("high"))
            scored = by if scored is None else scored.union(by)
    kept = store.manifest()
    return kept.join(scored, "version") if scored is not None else kept.withColumn("scored", F.lit(0).cast("long")).withColumn("high", F.lit(0).cast("long"))


def st_score_on_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices arrive in several batches, are scored by the active model, and meet the earlier ones of their vendor and days or file by an index of blocks:
    of each invoice its rank, and how many others it may be a duplicate of, with the highest score."""
    known = _features(spark, sf_dir)
    store, where = registry.ModelStore(spark, _folder(spark, "models")), _folder(spark, "arrivals")
    model = anomaly.fit(known)
    if model is None:
        return spark.createDataFrame([], "invoice_id long, rank_pct double, priority string, candidates long, best double")
    store.activate(store.save(model))
    bills = engine.invoices_with_text(spark, sf_dir)
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in bills.schema]
    index = arrivals.BlockIndex(spark, f"{where}/index", ", ".join(columns))
    known.drop("vendor_id").join(bills, "invoice_id").repartition(3, "invoice_id").write.parquet(f"{where}/in")

    def take(batch: DataFrame, i: int) -> None:
        anomaly.ensemble(batch, store.load()).select("invoice_id", "rank_pct", "priority").write.mode("overwrite").parquet(f"{where}/scores/batch={i}")
        index.arrive(batch.select(*bills.columns), i)

    stream = spark.readStream.schema(spark.read.parquet(f"{where}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/in")
    stream.writeStream.option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).foreachBatch(take).start().awaitTermination()
    found = index.pairs()
    ends = found.select(F.col("invoice_a").alias("invoice_id"), "score").union(found.select("invoice_b", "score")).groupBy("invoice_id").agg(F.count(F.lit(1)).alias("candidates"), F.max("score").alias("best"))
    scores = spark.read.schema("invoice_id long, rank_pct double, priority string").parquet(f"{where}/scores/batch=*")
    return scores.join(ends, "invoice_id", "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))


def agg_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.bootstrap(engine.view(spark, sf_dir, "SELECT quality + 1 - toxic AS hits, 2 AS total FROM labels"), "hits", "total")


def agg_mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two labels of the same documents: those that only one calls good, and the exact two-sided probability of so uneven a split, by the incomplete beta function."""
    rows = engine.view(spark, sf_dir, "SELECT count(CASE WHEN quality = 1 AND toxic = 0 THEN 1 END) AS ours_only, count(CASE WHEN quality = 0 AND toxic = 1 THEN 1 END) AS other_only FROM labels")
    least, n = F.least("ours_only", "other_only"), F.col("ours_only") + F.col("other_only")
    return rows.withColumn("p_value", F.when(n == 0, 1.0).otherwise(F.round(F.least(F.lit(1.0), 2 * special.binomial_cdf(least, n, 0.5)), 9)))


#: The tail as a sum of logarithms, for DuckDB; the tables compared have few such documents.
MCNEMAR_SQL = """SELECT ours_only, other_only, CASE WHEN ours_only + other_only = 0 THEN 1e0 ELSE round(least(1e0, 2 * list_sum([exp(lgamma(ours_only + other_only + 1) - lgamma(k + 1) - lgamma(ours_only + other_only - k + 1) - (ours_only + other_only) * ln(2e0)) for k in range(0, least(ours_only, other_only) + 1)])), 9) END AS p_value
  FROM (SELECT count(CASE WHEN quality = 1 AND toxic = 0 THEN 1 END) AS ours_only, count(CASE WHEN quality = 0 AND toxic = 1 THEN 1 END) AS other_only FROM labels) b"""


NUMBER = "'INV' || cast(p_size AS string) || cast(p_partkey AS string)"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "snk_rows": snk_rows, "snk_ndjson": snk_ndjson, "snk_csv": snk_csv, "src_blocked_csv": src_blocked_csv, "src_hsn_csv": src_hsn_csv, "src_bench_json": src_bench_json, "src_inbox": st_inbox, "st_inbox": st_inbox,
    "jn_temporal_prior": jn_temporal_prior, "fn_osa": _similar("distance", similarity.osa_distance, NUMBER), "fn_num_sim": _similar("similarity", similarity.number_similarity_udf, NUMBER),
    "fn_seqmatch": _similar("similarity", similarity.sequence_ratio_udf, "p_name"), "fn_token_set": _similar("similarity", similarity.token_set_udf, "p_name"),
    "fn_desc_sim": _similar("similarity", similarity.description_similarity_udf, "p_name"), "ml_impute": ml_impute, "ml_robust_z": ml_robust_z, "ml_iforest_fit": ml_iforest_fit,
    "ml_iforest_score": ml_iforest_score, "ml_ensemble": ml_ensemble, "ml_registry": ml_registry, "st_score_on_arrival": st_score_on_arrival, "agg_bootstrap": agg_bootstrap, "agg_mcnemar": agg_mcnemar,
}

ORACLES: dict[str, dialect.Template] = {
    "snk_rows": FOUND, "snk_ndjson": LISTED, "snk_csv": LISTED, "src_inbox": BOUGHT, "st_inbox": BOUGHT, "jn_temporal_prior": PRIOR_SQL, "agg_mcnemar": MCNEMAR_SQL,
    "src_blocked_csv": "SELECT cast(place AS int) AS place, match, pattern, action, section, category FROM (VALUES " + ", ".join(str((i, *r)) for i, r in enumerate(RESTRICTED, 1)) + ") AS r(place, match, pattern, action, section, category)",
    "src_hsn_csv": "SELECT code, cast(unnest(string_split(rates, '|')) AS decimal(5,2)) AS rate FROM (VALUES " + ", ".join(str(x) for x in HSN_RATES) + ") AS r(code, rates)",
    "src_bench_json": "SELECT lang AS field, count(*) AS n, cast(sum(quality) AS bigint) AS hits FROM documents JOIN labels USING (doc_id) GROUP BY lang",
}
