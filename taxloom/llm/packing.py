"""Conflict-constrained best-fit packing.

Documents go, longest first, into the fullest bin that still has room and carries neither their source nor their
duplicate cluster.  Open bins are kept in one array ordered by (residual, bin); each bin has two bitmaps, of the sources
and of the duplicate clusters it holds.  A document's successor in that order is the tightest bin by room alone; the
search walks on from there, a block of bins at a time, until both bitmaps are clear.  The walk has no limit; if no bin
fits, a new one opens.

Only (id, length, source, cluster) leave the table: no text is shuffled.  Documents are dealt into shards of about
``shard_rows`` by a hash of the row's number, so a hot source, a cluster of thousands of copies or thousands of equal rows spread evenly, a
shard's size doesn't grow with the corpus, and each shard packs on its own.  Bins never span shards, so the constraints hold globally.

Cases: a document longer than a bin is cut into full pieces, each a bin of its own, and a last piece that is packed like
any other (a piece never shares a bin with another piece of its document); null, blank or zero-length texts take part with
length 0 and one empty piece; null sources form one source, null clusters never conflict; repeated rows are packed
as often as they come; equal lengths go by id, then by the order of source and cluster; an empty table gives no bins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxloom.llm.common import Work

CAPACITY = 2048
SHARD_ROWS = 8192
SCAN = 128

PIECES = "doc_id long, piece int, start long, n_tokens long, bin_id long, bin_offset long"


def best_fit(need: np.ndarray, source: np.ndarray, cluster: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item.  Items come longest first; source and cluster are dense codes, cluster -1: no conflict."""
    n = len(need)
    s_words, c_words = (int(source.max(initial=0)) >> 6) + 1, (int(cluster.max(initial=0)) >> 6) + 1
    size = 256
    sources, clusters = np.zeros((size, s_words), np.uint64), np.zeros((size, c_words), np.uint64)
    order = np.empty(size, np.int64)  # residual << 32 | bin, ascending
    opened = 0
    out_bin, out_at = np.empty(n, np.int64), np.empty(n, np.int64)
    bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for i in range(n):
        want, sw, sb = int(need[i]), source[i] >> 6, bits[source[i] & 63]
        cw, cb = (cluster[i] >> 6, bits[cluster[i] & 63]) if cluster[i] >= 0 else (0, np.uint64(0))
        at, found = int(np.searchsorted(order[:opened], want << 32)), -1
        while at < opened:
            ids = order[at : min(at + SCAN, opened)] & 0xFFFFFFFF
            free = ((sources[ids, sw] & sb) | (clusters[ids, cw] & cb)) == 0
            k = int(free.argmax())
            if free[k]:
                found = at + k
                break
            at += SCAN
        if found < 0:
            if opened == size:
                size *= 2
                sources, clusters, order = np.resize(sources, (size, s_words)), np.resize(clusters, (size, c_words)), np.resize(order, size)
                sources[opened:], clusters[opened:] = 0, 0
            found, b, residual = opened, opened, capacity
            opened += 1
        else:
            b, residual = int(order[found]) & 0xFFFFFFFF, int(order[found]) >> 32
        out_bin[i], out_at[i] = b, capacity - residual
        sources[b, sw] |= sb
        clusters[b, cw] |= cb
        key = (residual - want) << 32 | b
        to = int(np.searchsorted(order[:found], key))
        order[to + 1 : found + 1] = order[to:found].copy()
        order[to] = key
    return out_bin, out_at


def _pack_shard(capacity: int):
    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "length", "source", "cluster"], kind="stable").reset_index(drop=True)
        length = rows["length"].to_numpy(np.int64)
        full, rest = length // capacity, length % capacity
        keep = (rest > 0) | (full == 0)
        tail = np.flatnonzero(keep)
        tail = tail[np.argsort(-rest[tail], kind="stable")]
        source = pd.factorize(rows["source"], use_na_sentinel=False)[0]
        copies = rows["cluster"].map(rows["cluster"].value_counts()).fillna(0).to_numpy() > 1
        cluster = np.where(copies, pd.factorize(rows["cluster"].where(copies))[0], -1)
        bins, at = best_fit(rest[tail], source[tail], cluster[tail], capacity)
        whole = np.repeat(np.arange(len(rows)), full)
        nth = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
        first = int(bins.max(initial=-1)) + 1
        row = np.concatenate([tail, whole])
        out = pd.DataFrame({
            "doc_id": rows["doc_id"].to_numpy()[row],
            "piece": np.concatenate([full[tail], nth]).astype(np.int32),
            "start": np.concatenate([full[tail] * capacity, nth * capacity]),
            "n_tokens": np.concatenate([rest[tail], np.full(len(whole), capacity)]),
            "bin_id": (int(key[0]) << 32) + np.concatenate([bins, first + np.arange(len(whole))]),
            "bin_offset": np.concatenate([at, np.zeros(len(whole), np.int64)]),
        })
        return out

    return pack


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Pieces with their bins, for ``docs`` (doc_id, length, source, cluster)."""
    if capacity < 1:
        raise ValueError("a bin holds one token at least")
    work = Work(docs.sparkSession, "packing")
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("length", F.lit(0)).cast("long").alias("length"), "source", F.col("cluster").cast("long"))
    # numbered and written once: a task that is run again reads the same numbers
    rows = work.write(rows.withColumn("nth", F.monotonically_increasing_id()), "rows")
    shards = max(1, -(-rows.count() // shard_rows))
    return rows.withColumn("shard", F.pmod(F.xxhash64("nth"), F.lit(shards))).groupBy("shard").applyInPandas(_pack_shard(capacity), PIECES)
