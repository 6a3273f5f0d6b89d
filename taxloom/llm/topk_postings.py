"""Exact top-k by inner product: exhaustive term-at-a-time accumulation.

Vectors are sparse rows of (term, integer weight).  Queries are broadcast in blocks of at most about ``BLOCK_BYTES``, one block at a time,
and candidates stream past each block where they are read, so no candidate is shuffled.  A task takes its candidates in chunks, turns a chunk into
postings (term: rows and weights), and for every term of ``ROWS`` queries scatters the outer product of query weights and postings into a dense
array of scores.  The best k of each query come from partition selection with ties settled by id and are kept from chunk to chunk;
a task sends k rows a query in the end, and a window over at most k rows a query and task merges them.

Memory is bounded by a block of queries and ``CHUNK`` x ``ROWS`` scores whatever the table's size.  Every stated query meets every candidate
exactly once, in blocks.

Cases: vectors that are null, or hold a null or a non-finite component, take no part; an empty vector scores 0; a row
with the query's own id is never its candidate; a query id that repeats asks with its first vector in the order of its
components; ties go to the smaller id; a score outside 64 bits is cut to the nearest that fits; fewer than k candidates return all; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxloom.llm.common import Work

SCALE = 1024
#: Candidates and queries whose scores are held at once, and bytes of queries that are broadcast at once.
CHUNK, ROWS = 4096, 512
BLOCK_BYTES = 32 << 20
FOUND = "query_id long, vec_id long, score long"


def quantized(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component in double, as long; null if the vector or a component can't take part."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    wide = vector.cast("array<double>")
    return F.when(vector.isNotNull() & ~F.exists(wide, bad), F.transform(wide, lambda x: F.floor(x * F.lit(float(scale))).cast("long")))


def _ragged(rows: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and weight of every component that isn't 0."""
    sizes = np.fromiter((len(x) for x in rows), np.int64, len(rows))
    weight = np.concatenate([np.asarray(x, np.int64) for x in rows]) if len(rows) else np.empty(0, np.int64)
    row = np.repeat(np.arange(len(rows)), sizes)
    term = np.arange(len(weight)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    there = weight != 0
    return row[there], term[there], weight[there]


def _postings(rows: pd.Series) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    row, term, weight = _ragged(rows)
    by = np.argsort(term, kind="stable")
    row, term, weight = row[by], term[by], weight[by]
    cuts = np.flatnonzero(np.diff(term)) + 1
    return {int(t[0]): (r, w) for t, r, w in zip(np.split(term, cuts), np.split(row, cuts), np.split(weight, cuts), strict=True) if len(t)}


def _scores(asked: pd.Series, postings: dict[int, tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """(query, candidate): inner products of ``asked`` with the ``n`` candidates of ``postings``."""
    own = _postings(asked)
    most = lambda p: max((int(np.abs(w.astype(object)).max()) for _, w in p.values()), default=0)
    wide = most(own) * most(postings) * max(len(own), 1) >= 1 << 62
    scores = np.zeros((len(asked), n), object if wide else np.int64)
    for term, (q, wq) in own.items():
        if term in postings:
            c, wc = postings[term]
            if wide:
                wq, wc = wq.astype(object), wc.astype(object)
            if len(c) == n:
                scores[q] += wq[:, None] * wc[None, :]
            else:
                scores[q[:, None], c[None, :]] += wq[:, None] * wc[None, :]
    return np.clip(scores, -(1 << 63), (1 << 63) - 1).astype(np.int64) if wide else scores


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest ``scores``, ties to the smaller of the ascending ``ids``."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    over = np.flatnonzero(scores > least)
    return np.concatenate([over, np.flatnonzero(scores == least)[: k - len(over)]])


def _search(asked: np.ndarray, vectors: pd.Series, k: int):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(asked)
        for rows in batches:
            for lo in range(0, len(rows), CHUNK):
                chunk = rows.iloc[lo : lo + CHUNK].sort_values("vec_id", kind="stable")
                ids, postings = chunk["vec_id"].to_numpy(), _postings(chunk["v"])
                for at in range(0, len(asked), ROWS):
                    scores = _scores(vectors.iloc[at : at + ROWS], postings, len(ids))
                    for i, own in enumerate(asked[at : at + ROWS], at):
                        take = _best(ids[ids != own], scores[i - at, ids != own], k)
                        both = np.r_[kept[i][0], ids[ids != own][take]], np.r_[kept[i][1], scores[i - at, ids != own][take]]
                        order = np.lexsort((both[0], -both[1].astype(object)))[:k] if len(both[0]) and both[1].min() == -(1 << 63) else np.lexsort((both[0], -both[1]))[:k]
                        kept[i] = both[0][order], both[1][order]
        sizes = [len(ids) for ids, _ in kept]
        if sum(sizes):
            yield pd.DataFrame({"query_id": np.repeat(asked, sizes), "vec_id": np.concatenate([x for x, _ in kept]), "score": np.concatenate([x for _, x in kept])})

    return search


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows of ``vectors`` for each of ``queries``; both (vec_id, v: array<long>)."""
    work = Work(vectors.sparkSession, "top-k")
    rows = vectors.where("v is not null and vec_id is not null").select(F.col("vec_id").cast("long"), "v")
    asks = work.write(queries.where("v is not null and vec_id is not null").groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min("v").alias("v")), "queries")
    size = asks.agg(F.sum(8 * F.size("v") + 64)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    found = []
    for block in range(blocks):
        own = asks.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).toPandas()
        found.append(work.write(rows.mapInPandas(_search(own["vec_id"].to_numpy(np.int64), own["v"], k), FOUND), "found"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = reduce(DataFrame.union, found).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    work.drop(asks)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
