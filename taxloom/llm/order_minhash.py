"""Order MinHash near-duplicate classes.

A document's k-mers are its runs of five words, labelled with their occurrence (the second time a run occurs it is another
k-mer).  Each of ``SKETCHES`` permutations samples the ``TAKE`` smallest of them and keeps those in the order of the text;
two documents that agree in such a vector share k-mers and their order, so sketches follow edit similarity rather than the
bag of words.  Documents that agree in a sketch are candidates; candidates are verified by a banded alignment: the longest
common subsequence of their labelled k-mers, found by sparse dynamic programming over the matches within the band that the
threshold allows (any alignment that leaves it has too many unmatched k-mers).  Similarity is matched / (a + b - matched), a
Jaccard coefficient in order, at least 0.8.

Work: exact copies (equal normal texts) collapse to their smallest id first, by a pre-aggregated minimum.  In a bucket of a
sketch every member is paired with the bucket's smallest id, one pair a member and never all pairs; verified pairs are
joined into components.  Members of buckets that then hold several components are compared exactly: a prefix, length and position
filter on their rarest k-mers brings together every pair of different components that can reach the threshold, whether or not they are
their components' smallest ids.  So all texts that share one of their 40 sketches with another and reach the threshold are linked;
nothing is capped or dropped.  Hot buckets meet their smallest id through a join that adaptive execution splits.  Word
arrays are only moved for documents with candidates: a bit map of bounded size thins the others out where they are read, as it does
sketches that one text has alone.  Every table that is written on the way is deleted once it is spent.

Short texts: with at most ``SHORT`` k-mers a document is also sketched with ``TAKE_SHORT``; documents of at least 0.8
x ``SHORT`` k-mers also with ``TAKE``, so any pair within the threshold has a common kind of sketch.

Cases: texts of fewer than five words are one k-mer of all their words; null, empty and blank texts belong to no group but
their own; repeated rows of one id are one document, judged by its largest text in text order; rows with a null id are
left out; an empty table gives no rows; columns other than id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxloom.llm.common import Work, dealt_out, normal_text, small, thinned, words_of

WIDTH = 5
SIMILARITY = 0.8
SKETCHES = 40
TAKE, TAKE_SHORT, SHORT = 8, 2, 24
SEED = 20240607


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def labelled_kmers(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """64-bit keys of the runs of ``width`` word hashes with their occurrence, in text order."""
    w = words.astype(np.int64).view(np.uint64)
    if not len(w):
        return w
    width = min(width, len(w))
    keys = np.zeros(len(w) - width + 1, np.uint64)
    for i in range(width):
        keys = _mix(keys + w[i : len(w) - width + 1 + i] + np.uint64(i + 1))
    by = np.argsort(keys, kind="stable")
    s = keys[by]
    new = np.r_[True, s[1:] != s[:-1]]
    nth = np.empty(len(keys), np.int64)
    at = np.arange(len(keys))
    nth[by] = at - np.maximum.accumulate(np.where(new, at, 0))
    return np.where(nth > 0, _mix(keys + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), keys)


_RNG = np.random.default_rng(SEED)
_ODD = _RNG.integers(0, 2**63, SKETCHES, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, SKETCHES, np.uint64)
#: Permuted k-mers that are held at once while sketching.
CELLS = 1 << 17
#: Texts of which k-mers are counted, k-mers held as frequent, and first k-mers in one batch; they bound memory and leave the pairs alone.
HOT_SAMPLE, HOT_KMERS, PREFIX_ROWS = 4_000, 200_000, 200_000
#: Linked texts whose classes are broadcast to their copies at most: 24 bytes each.
CLASS_ROWS = 1_000_000


def sketches(kmers: np.ndarray, take: int) -> np.ndarray:
    """A 64-bit key of each permutation's ``take`` smallest k-mers in text order."""
    n = len(kmers)
    out = np.empty(SKETCHES, np.uint64)
    step = max(1, CELLS // max(n, 1))
    for lo in range(0, SKETCHES, step):
        odd, add = _ODD[lo : lo + step, None], _ADD[lo : lo + step, None]
        h = (kmers[None, :] + add) * odd
        h ^= h >> np.uint64(32)
        at = np.sort(np.argpartition(h, take - 1, axis=1)[:, :take], axis=1) if n > take else np.broadcast_to(np.arange(n), (len(odd), n))
        key = np.arange(lo, lo + len(odd), dtype=np.uint64) + np.uint64(take << 32)
        for j in range(at.shape[1]):
            key = _mix(key + kmers[at[:, j]])
        out[lo : lo + step] = key
    return out


def _sketch_all(words: pa.Array) -> pa.Array:
    """The sketches of an Arrow array of word hashes, which are read where they lie."""
    flat, ends = words.values.to_numpy(), words.offsets.to_numpy()
    out, sizes = [], [0]
    with np.errstate(over="ignore"):
        for start, end in zip(ends[:-1], ends[1:], strict=True):
            k = labelled_kmers(flat[start:end])
            out += [] if not len(k) else [sketches(k, TAKE)] * (len(k) >= SIMILARITY * SHORT) + [sketches(k, TAKE_SHORT)] * (len(k) <= SHORT)
            sizes.append(SKETCHES * len(out))
    keys = np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(keys))


def aligned(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """matched / (a + b - matched) of the best alignment of two labelled k-mer sequences, or 0 if that is under ``least``."""
    n = len(a) + len(b)
    need = least * n / (1 + least)
    common, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    band = n - 2 * need
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    if len(i) < need - 1e-9:
        return 0.0
    j = j[np.argsort(i)]
    if np.all(j[1:] > j[:-1]):
        m = len(j)
    else:
        tails = np.empty(len(j), np.int64)
        m = 0
        for x in j.tolist():
            at = int(np.searchsorted(tails[:m], x))
            tails[at] = x
            m += at == m
    s = m / (n - m)
    return s if s >= least - 1e-12 else 0.0


def _verify(least: float):
    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            with np.errstate(over="ignore"):
                s = [aligned(labelled_kmers(np.asarray(a)), labelled_kmers(np.asarray(b)), least) for a, b in zip(rows["wa"], rows["wb"], strict=True)]
            yield pd.DataFrame({"a": rows["a"], "b": rows["b"], "similarity": np.array(s, float)})

    return verify


def word_hashes(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.hash(w))


def _followed(labels: DataFrame, further: DataFrame) -> DataFrame:
    """(id, root): ``labels`` whose roots are looked up in ``further`` once more."""
    up = further.select(F.col("id").alias("_up"), F.col("root").alias("_upper"))
    return labels.join(up, labels["root"] == up["_up"], "left").select("id", F.col("root").alias("_old"), F.coalesce("_upper", "root").alias("root"))


def components(edges: DataFrame, work: Work | None = None) -> DataFrame:
    """(id, root): the smallest id that each id of ``edges`` (a, b) is linked to, directly or not; a table of ``work``.

    Each id points to its smallest neighbour if that is smaller; pointers are followed to their ends, which takes the logarithm of the
    longest path, one row an id.  Edges are then moved to those ends and only those between different ends are kept, so each edge is
    read once in the first round and few are left for the next.  Minima are pre-aggregated: an id with many links isn't gathered.
    """
    work = work or Work(edges.sparkSession, "components")
    left = work.write(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    roots = None
    while roots is None or not left.isEmpty():
        ends = left.select(F.col("b").alias("id"), F.col("a").alias("to")).union(left.select("a", "a"))
        labels = work.write(ends.groupBy("id").agg(F.min("to").alias("root")), "labels")
        while True:
            jumped = work.write(_followed(labels.select("id", "root"), labels.select("id", "root")), "labels")
            work.drop(labels)
            labels = jumped
            if jumped.where("root <> _old").isEmpty():
                break
        before, named = roots, labels.select("id", "root")
        roots = work.write(named if roots is None else _followed(roots, named).select("id", "root"), "roots")
        ra, rb = labels.select(F.col("id").alias("a"), F.col("root").alias("ra")), labels.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        moved = left.join(ra, "a").join(rb, "b").where("ra <> rb")
        less = work.write(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
        work.drop(left, labels, *([] if before is None else [before]))
        left = less
    work.drop(left)
    return roots


def _prefixes(hot: np.ndarray, seen: np.ndarray, least: float):
    """Rows (k, doc_id, n, at, lead) of each document's first k-mers, those not in ``hot`` (sorted) before those that are, by
    how often they were ``seen``; ``lead`` are those by which it is found as the shorter text."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out, held = [], 0
            for doc, w in zip(rows["doc_id"], rows["w"], strict=True):
                with np.errstate(over="ignore"):
                    k = labelled_kmers(np.asarray(w))
                n = len(k)
                at = np.minimum(np.searchsorted(hot, k), max(len(hot) - 1, 0))
                often = np.where(hot[at] == k, seen[at], 0) if len(hot) else np.zeros(n, np.int64)
                first = n - math.ceil(least * n - 1e-9) + 1
                lead = n - math.ceil(2 * least / (1 + least) * n - 1e-9) + 1
                k = k[np.lexsort((k, often))[:first]]
                out.append(pd.DataFrame({"k": k.view(np.int64), "doc_id": doc, "n": n, "at": np.arange(len(k)), "lead": np.arange(len(k)) < lead}))
                held += len(k)
                if held >= PREFIX_ROWS:
                    yield pd.concat(out)
                    out, held = [], 0
            if out:
                yield pd.concat(out)

    return cut


def _kmers(w: pd.Series) -> pd.Series:
    with np.errstate(over="ignore"):
        return pd.Series([labelled_kmers(np.asarray(x)).view(np.int64) for x in w])


def prefixes(docs: DataFrame, least: float, work: Work) -> DataFrame:
    """(k, doc_id, n, at, lead): the first k-mers of ``docs`` (doc_id, w) in one order of all k-mers.

    Two texts that reach ``least`` share one of the shorter text's leading and one of the longer text's first k-mers, and behind the
    first that they share enough are left.  The order puts k-mers that a sample shows to be in many texts last, so a passage of many
    texts only brings together those that are little else; the sample decides the work and never the pairs.
    """
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < 1_000_000 * min(1.0, HOT_SAMPLE / max(docs.count(), 1)))
    often = some.select(F.explode(F.pandas_udf(_kmers, "array<long>")("w")).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    hot = often.orderBy(F.desc("n"), "k").limit(HOT_KMERS).toPandas()
    keys = hot["k"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(keys)
    cut = _prefixes(keys[by], hot["n"].to_numpy(np.int64)[by], least)
    return work.write(docs.select("doc_id", "w").mapInPandas(cut, "k long, doc_id long, n int, at int, lead boolean"), "prefixes")


def _can_reach(least: float) -> Column:
    """Whether x, with nx k-mers and the shared one at place ix, can reach ``least`` with y, which isn't shorter."""
    shorter = (F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y")))
    left = F.least(F.col("nx") - F.col("ix"), F.col("ny") - F.col("iy"))
    return shorter & (F.col("nx") >= least * F.col("ny") - 1e-9) & (left >= least / (1 + least) * (F.col("nx") + F.col("ny")) - 1e-9)


def apart(found: DataFrame, roots: DataFrame, least: float, hubs: bool, work: Work) -> DataFrame:
    """(a, b): pairs of different components that can reach ``least`` by the ``prefixes`` ``found``: with ``hubs`` each text and
    the shortest text of a k-mer, one pair a row; else every pair, found by the components of a k-mer and then their members."""
    labels = roots.select(F.col("id").alias("doc_id"), F.col("root").alias("c"))
    rows = found.join(labels, "doc_id", "left").withColumn("c", F.coalesce("c", "doc_id"))
    parted = rows.groupBy("k").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("k")
    rows = work.write(rows.join(parted, "k", "left_semi"), "parted")
    x = rows.where("lead").select("k", F.col("doc_id").alias("x"), F.col("c").alias("cx"), F.col("n").alias("nx"), F.col("at").alias("ix"))
    y = rows.select("k", F.col("doc_id").alias("y"), F.col("c").alias("cy"), F.col("n").alias("ny"), F.col("at").alias("iy"))
    if hubs:
        bounds = work.write(x.groupBy("k").agg(F.min(F.struct("nx", "x", "ix", "cx")).alias("h")).select("k", "h.*"), "hubs")
        met = y.join(bounds, "k").where((F.col("cx") != F.col("cy")) & _can_reach(least))
    else:
        # bounds that hold for all of a component's members come first, so members of one component never meet
        bounds = work.write(y.groupBy("k", "cy").agg(F.max("ny").alias("most"), F.min("ny").alias("fewest"), F.max(F.col("ny") - F.col("iy")).alias("left")), "parts")
        may = (F.col("cx") != F.col("cy")) & (F.col("most") >= F.col("nx")) & (F.col("nx") >= least * F.col("fewest") - 1e-9)
        may &= F.least(F.col("nx") - F.col("ix"), F.col("left")) >= 2 * least / (1 + least) * F.col("nx") - 1e-9
        met = x.join(bounds, "k").where(may).select("k", "x", "nx", "ix", "cy").join(y, ["k", "cy"]).where(_can_reach(least))
    pairs = work.write(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "pairs")
    work.drop(rows, bounds)
    return pairs


def distinct_texts(rows: DataFrame, work: Work) -> tuple[DataFrame, DataFrame]:
    """(doc_id, k1, k2, rep) of each document, judged by one text, and (doc_id, k1, k2, keys) of each different text: its smallest
    document and its sketches.  Sketches are shuffled once, by the text's key, with map-side minima, so copies collapse where they are read."""
    normal = normal_text(F.col("text"))
    sketch = F.arrow_udf(_sketch_all, "array<long>")
    full = F.coalesce(F.length(normal), F.lit(0)) > 0
    known = work.write(dealt_out(rows).select("doc_id", F.xxhash64(normal).alias("k1"), F.xxhash64(F.lit(7), normal).alias("k2"), full.alias("full"), sketch(word_hashes(F.col("text"))).alias("keys")), "sketches")
    ids = work.write(known.groupBy("doc_id").agg(F.max(F.struct("k1", "k2", "full")).alias("t")).select("doc_id", "t.*"), "ids")
    # written first, so that the next join reads two plain exchanges, whose hot keys adaptive execution can split
    first = work.write(ids.where("full").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "first")
    alone = ids.where("not full").select("doc_id", "k1", "k2", F.col("doc_id").alias("rep"))
    members = work.write(ids.where("full").join(first, ["k1", "k2"]).select("doc_id", "k1", "k2", "rep").union(alone), "copies")
    sketched = known.where("full").groupBy("k1", "k2").agg(F.min("keys").alias("keys"))
    texts = work.write(sketched.join(first, ["k1", "k2"]).select(F.col("rep").alias("doc_id"), "k1", "k2", "keys"), "texts")
    work.drop(known, ids, first)
    return members, texts


def shared_buckets(texts: DataFrame, work: Work) -> DataFrame:
    """(doc_id, bucket, hub) of the sketches that several texts have; ``hub`` is the smallest of them.  Most sketches are one text's own: those
    are counted, and thinned out before members are joined to their hubs."""
    spread = texts.select("doc_id", F.explode("keys").alias("bucket"))
    hubs = work.write(spread.groupBy("bucket").agg(F.min("doc_id").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "hubs")
    return work.write(thinned(spread, "bucket", hubs).join(hubs, "bucket"), "buckets")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, n_links, text_key): each document's class, the smallest id in it, its verified links to other texts (of its text,
    if it has copies) and the key of the text by which it was judged, that of :func:`text_key`."""
    work = Work(docs.sparkSession, "near-duplicates")
    rows = docs.where("doc_id is not null").select("doc_id", "text")
    members, sketched = distinct_texts(rows, work)
    spread = shared_buckets(sketched, work)
    pairs = work.write(spread.where("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct(), "pairs")
    # at most 80 buckets a document: labels are joined to documents, not to members of buckets
    held = work.write(spread.groupBy("doc_id").agg(F.collect_list("bucket").alias("buckets")), "held")
    own = held.select("doc_id").join(sketched.select("doc_id", "k1", "k2"), "doc_id")
    some = thinned(rows, "doc_id", held.select("doc_id"))
    normal = normal_text(F.col("text"))
    some = some.select("doc_id", F.xxhash64(normal).alias("k1"), F.xxhash64(F.lit(7), normal).alias("k2"), word_hashes(F.col("text")).alias("w"))
    texts = work.write(some.dropDuplicates(["doc_id", "k1", "k2"]).join(own, ["doc_id", "k1", "k2"], "left_semi").select("doc_id", "w"), "words")
    work.drop(sketched, spread)

    def verified(pairs: DataFrame) -> DataFrame:
        full = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("w").alias("wa")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("w").alias("wb")), "b")
        return work.write(full.select("a", "b", "wa", "wb").mapInPandas(_verify(similarity), "a long, b long, similarity double").where("similarity > 0"), "edges")

    edges = verified(pairs)
    roots = components(edges, work)

    # what may still be linked: members of buckets in which several components are left
    labels = roots.select(F.col("id").alias("doc_id"), F.col("root").alias("c"))
    labelled = work.write(held.join(labels, "doc_id", "left").withColumn("c", F.coalesce("c", "doc_id")), "labelled")
    parted = labelled.select("c", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("bucket")
    open_docs = labelled.select("doc_id", F.explode("buckets").alias("bucket")).join(parted, "bucket", "left_semi").select("doc_id").distinct()
    found = prefixes(work.write(open_docs.join(texts, "doc_id"), "open"), similarity, work)
    work.drop(held, labelled)
    # groups of copies that the buckets' smallest ids have left apart are joined by one pair a row, and then every pair that is left is tried
    tried = pairs
    for hubs in (True, False):
        rest = work.write(apart(found, roots, similarity, hubs, work).join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = tried.union(rest)
        more = verified(rest)
        edges = edges.union(more)
        if more.isEmpty():
            continue
        # only what links two components is new
        named = more.join(roots.select(F.col("id").alias("a"), F.col("root").alias("ra")), "a", "left").join(roots.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b", "left")
        joined = components(named.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")), work)
        whole = _followed(roots, joined).select("id", "root")
        roots = work.write(whole.union(joined.join(roots.select("id"), "id", "left_anti").select("id", "root")), "roots")

    # a class belongs to a text before it goes to the text's copies, which may be a third of all documents
    links = edges.select(F.col("a").alias("rep")).union(edges.select("b")).groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
    classes = work.write(roots.select(F.col("id").alias("rep"), F.col("root").alias("class_id")).join(links, "rep", "left"), "classes")
    out = members.join(small(classes, classes.count(), CLASS_ROWS), "rep", "left")
    work.keep(members, classes)
    return out.select("doc_id", F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("n", F.lit(0)).alias("n_links"), F.col("k1").alias("text_key"))


def text_key(text: Column) -> Column:
    """The key of a text whose letters differ in case and white space only."""
    return F.xxhash64(normal_text(text))
