"""Jaccard join of word n-gram sets, in size-banded tiles with hashed bitmaps.

A document's set holds its distinct runs of ``WIDTH`` words; two documents link when 100 x intersection >= ``PERCENT`` x union.  Sets are
sorted arrays of 64-bit keys.  All bounds are whole numbers, so nothing is lost to rounding.

Tiles: sets are put in one order of all keys.  Two sets that link share one of the first keys of each, of which a set of n has
n - ceil(0.85 n) + 1, the shorter one fewer; and their sizes lie in one size band or in neighbours.  So a tile is a key and a size band: it holds the
sets that have the key among their first ones, those of its band and, as the shorter side, those of the band below.  Keys that are in many sets
come last in the order, so a passage of many texts only brings together those that are little else.

Bitmaps: each set has ``BITS`` bits, each of them the parity of the keys that hash to it.  Keys that both sets have cancel out, so two
bitmaps differ in no more bits than the sets differ in keys: the count of differing bits bounds the intersection from above, however long the
texts are.  The bound is a condition of the join within a tile; what passes it is compared exactly, by intersection of the sorted arrays.

Order of work: equal sets collapse to their smallest document first.  Then each set meets one other, the first document that leads one of its rarest
``HUBS`` tiles and may link, which joins many near copies into components without listing their pairs.  Tiles in which several components are
left are then taken whole: bounds of a component in a tile go before its members, so members of one component never meet.  Of the pairs that
are left each component picks the one that is most alike by the bitmaps, which is compared; ``PICKS`` times, each time halving
the components of a group at least where picks hold, and then all pairs that still are between two components are compared.  So every pair that
could join two components is compared or no longer needed; none is capped.  What isn't listed are further links within a component, which don't change it.
Hot tiles are plain joins that adaptive execution splits.  Texts are read again, thinned by a bit map, for the sets that have a pair
to compare, and moved for those alone, as zipped text: a set's keys are random words of eight bytes, several times as much.

The order of the keys comes from a sample (``SAMPLE`` sets or a sixteenth of them, at most ``HOT_KEYS`` keys): it decides about work, and no pair.

Cases: fewer words than ``WIDTH`` are one run of all of them; null, empty and blank texts have an empty set and link with nothing; repeated rows of
an id are one document, an id with several texts is judged by the set with the largest key; null ids are left out; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType

from taxloom.llm.common import Work, dealt_out, small, thinned
from taxloom.llm.order_minhash import components

WIDTH, PERCENT = 4, 85
BITS = 512
LANES = BITS // 64
#: Width of a size band as a logarithm; a little more than that of the ratio two linked sizes may have.
BAND = math.log(100 / (PERCENT - 0.1))
#: Tiles among whose first members a set finds the one that it meets first, and how often each component picks one pair.
HUBS, PICKS = 8, 4
#: Sets whose keys are counted (or a sixteenth of all, if that is more), least count, and keys that are held as frequent; they leave the pairs alone.
SAMPLE, LEAST_SEEN, HOT_KEYS = 4_000, 3, 1_000_000
#: Bytes of text that are hashed at once, and components that are broadcast to their copies.
SLICE_BYTES, CLASS_ROWS = 1 << 20, 1_000_000

_RNG = np.random.default_rng(20250111)
#: A word of 64 random bits for each of the first 64 places in a word and each byte.
_TABLE = _RNG.integers(0, 2**64 - 1, 64 * 256, np.uint64, endpoint=True)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_keys(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The key of each word in the UTF-8 bytes ``data`` of texts that end at ``ends``, and how many words lie before each text's end."""
    data = _LOWER[data]
    solid = ~_BLANK[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    firsts = np.r_[0, ends[:-1]]
    firsts = firsts[firsts < len(data)]
    begins[firsts] = solid[firsts]  # a text's first byte, whatever stands before it
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(ends), np.int64)
    at = np.flatnonzero(solid)
    first = np.searchsorted(at, starts)
    place = at - np.repeat(starts, np.diff(np.r_[first, len(at)]))
    parts = _TABLE[(np.minimum(place, 63) << 8) | data[at]]
    late = place > 63
    parts[late] = _mix(parts[late] + place[late].astype(np.uint64) * _ODD)
    return _mix(np.add.reduceat(parts, first)), np.searchsorted(starts, ends)


def sets_of(data: np.ndarray, ends: np.ndarray, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct keys of each text's runs of ``width`` words."""
    with np.errstate(over="ignore"):
        words, ends = word_keys(data, ends)
        runs = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for i in range(width):
            runs = _mix(runs * _ODD + words[i : len(words) - width + 1 + i])
        start = 0
        for end in ends:
            n = end - start
            if n >= width:
                yield np.unique(runs[start : end - width + 1])
            elif n:
                key = np.full(1, n, np.uint64)
                for w in words[start:end]:
                    key = _mix(key * _ODD + w)
                yield key
            else:
                yield np.empty(0, np.uint64)
            start = end


def _texts(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sets of an Arrow array of bytes, in slices of bounded size."""
    texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + SLICE_BYTES, "right")) - 1)
        yield from sets_of(whole[at[i] : at[j]], at[i + 1 : j + 1] - at[i], width)
        i = j


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))


def set_keys(width: int = WIDTH):
    """A column function: the sorted keys of a text's set."""

    def keys(texts: pa.Array) -> pa.Array:
        return _lists(list(_texts(texts, width)))

    return F.arrow_udf(keys, "array<long>")


def least_shared(n: Column, percent: int) -> Column:
    """The least common keys with a set that isn't shorter; whole numbers: 2 x percent x n / (100 + percent), upwards."""
    return F.floor((2 * percent * n + 99 + percent) / (100 + percent))


def bits(keys: np.ndarray) -> np.ndarray:
    """The parity of the keys that hash to each bit, as ``LANES`` words."""
    odd = np.bincount((keys & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def first_keys(keys: np.ndarray, hot: np.ndarray, seen: np.ndarray, percent: int) -> np.ndarray:
    """The first keys of a sorted set in the order of all keys: those that aren't in ``hot`` (sorted), then by how often they were ``seen``."""
    n = len(keys)
    first = n - -(-percent * n // 100) + 1
    often = np.zeros(n, np.int64)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, keys), len(hot) - 1)
        often = np.where(hot[at] == keys, seen[at], 0)
    calm = np.flatnonzero(often == 0)[:first]
    if len(calm) == first:
        return keys[calm]
    busy = np.flatnonzero(often)
    return np.r_[keys[calm], keys[busy[np.argsort(often[busy], kind="stable")[: first - len(calm)]]]]


SKETCH = "struct<n:int,k1:long,k2:long,bits:array<long>,first:array<long>>"


def _sketch(hot: np.ndarray, seen: np.ndarray, width: int, percent: int):
    def sketch(texts: pa.Array) -> pa.Array:
        n, k1, k2, marks, first = [], [], [], [], []
        with np.errstate(over="ignore"):
            for keys in _texts(texts, width):
                n.append(len(keys))
                k1.append(int(_mix(keys).sum().astype(np.uint64).view(np.int64)))
                k2.append(int(np.bitwise_xor.reduce(_mix(keys + _ODD), initial=np.uint64(0)).view(np.int64)))
                marks.append(bits(keys))
                first.append(first_keys(keys, hot, seen, percent) if len(keys) else keys)
        fields = [pa.array(n, pa.int32()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * LANES, pa.int32()), pa.array(np.concatenate(marks) if marks else np.empty(0, np.int64))), _lists(first)]
        return pa.StructArray.from_arrays(fields, ["n", "k1", "k2", "bits", "first"])

    return F.arrow_udf(sketch, SKETCH)


@F.arrow_udf(BinaryType())
def zipped(texts: pa.Array) -> pa.Array:
    """The texts, compressed one by one; null as an empty text."""
    return pa.array([zlib.compress(x.as_buffer(), 1) for x in texts.fill_null(b"")], pa.binary())


def shared(width: int):
    """A column function: the size of the intersection of the sets of two zipped texts."""

    def keys(z: bytes) -> np.ndarray:
        data = np.frombuffer(zlib.decompress(z), np.uint8)
        return next(sets_of(data, np.array([len(data)]), width))

    def common(a: pa.Array, b: pa.Array) -> pa.Array:
        out, held = np.zeros(len(a), np.int64), [(b"", None), (b"", None)]
        for i, pair in enumerate(zip(a, b, strict=True)):
            for side, z in enumerate(z.as_py() for z in pair):
                if z != held[side][0]:  # rows come by one side's id, so its set mostly serves again
                    held[side] = z, keys(z)
            out[i] = len(np.intersect1d(held[0][1], held[1][1], assume_unique=True))
        return pa.array(out)

    return F.arrow_udf(common, LongType())


def frequent_keys(rows: DataFrame, width: int, work: Work) -> tuple[np.ndarray, np.ndarray]:
    """The keys that a sample of documents has most often, sorted, and how often."""
    n = rows.count()
    rate = min(1.0, max(SAMPLE / max(n, 1), 1 / 16))
    some = dealt_out(rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < 1_000_000 * rate))
    each = some.select(F.explode(set_keys(width)(F.col("text").cast("binary"))).alias("k"))
    counted = work.write(each.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_SEEN), "counted")  # so that its shuffle files go
    often = counted.orderBy(F.desc("n"), "k").limit(HOT_KEYS).toPandas()
    work.drop(counted)
    keys = often["k"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(keys)
    return keys[by], often["n"].to_numpy(np.int64)[by]


def distinct_sets(rows: DataFrame, width: int, percent: int, work: Work) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, rep) of each document and (doc_id, t, n, bits, first) of each different set, named by its smallest document; ``t`` is the key of
    that document's text."""
    sketch = _sketch(*frequent_keys(rows, width, work), width, percent)
    known = dealt_out(rows).select("doc_id", text_key().alias("t"), sketch(F.col("text").cast("binary")).alias("s"))
    known = work.write(known.select("doc_id", "t", "s.*"), "sets")
    ids = work.write(known.groupBy("doc_id").agg(F.max(F.struct("k1", "k2", "n", "t")).alias("s")).select("doc_id", "s.*"), "ids")
    # written first, so that the next join reads two plain exchanges, whose hot keys adaptive execution can split
    first = work.write(ids.where("n > 0").groupBy("k1", "k2", "n").agg(F.min(F.struct("doc_id", "t")).alias("r")).select("k1", "k2", "n", F.col("r.doc_id").alias("rep"), "r.t"), "first")
    alone = ids.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("rep"))
    members = work.write(ids.where("n > 0").join(first.drop("t"), ["k1", "k2", "n"]).select("doc_id", "n", "rep").union(alone), "members")
    sets = known.join(first.select(F.col("rep").alias("doc_id"), "t"), ["doc_id", "t"]).dropDuplicates(["doc_id", "t"]).select("doc_id", "t", "n", "bits", "first")
    sets = work.write(sets, "distinct")
    work.drop(known, ids, first)
    return members, sets


def text_key() -> Column:
    """The key by which one of several texts of an id is known."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def tiles(sets: DataFrame, percent: int, work: Work) -> DataFrame:
    """(doc_id, n, bits, keys): the sets of which a first key is also another's, and these keys as (at, k), rarest first.

    A set is found as the shorter one by its leading keys, so a tile needs two sets and one that leads."""
    each = sets.select("doc_id", "n", F.posexplode("first").alias("at", "k"))
    lead = F.col("at") < F.col("n") - least_shared(F.col("n"), percent) + 1
    met = work.write(each.groupBy("k").agg(F.count(F.lit(1)).alias("m"), F.max(lead).alias("led")).where("m > 1 and led").select("k"), "shared")
    found = thinned(each, "k", met).join(met, "k").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "k"))).alias("keys"))  # a set's own first keys
    out = work.write(sets.select("doc_id", "n", "bits").join(found, "doc_id"), "tiles")
    work.drop(met)
    return out


def _members(rows: DataFrame, keys: Column, percent: int) -> DataFrame:
    """(k, band, doc_id, n, at, lead, bits) of ``rows`` for each of their ``keys``."""
    each = rows.select("*", F.explode(keys).alias("_p")).select("*", F.col("_p.at").alias("at"), F.col("_p.k").alias("k"))
    lead = F.col("at") < F.col("n") - least_shared(F.col("n"), percent) + 1
    return each.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / BAND).cast("int")).withColumn("lead", lead).drop("_p", "keys")


def _apart() -> Column:
    """The bits in which the bitmaps of x and y differ."""
    return sum((F.bit_count(F.get("bx", F.lit(i)).bitwiseXOR(F.get("by", F.lit(i)))) for i in range(LANES)), F.lit(0))


def _may_link(percent: int, ordered: bool = True) -> Column:
    """Whether sets x and y, that share the key at places ix and iy, can link by size, place and bitmaps; x is the shorter one if ``ordered``."""
    n, need = F.col("nx") + F.col("ny"), 100 + percent
    left = F.least(F.col("nx") - F.col("ix"), F.col("ny") - F.col("iy"))
    fits = (100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")) & (need * left >= percent * n) & (need * (n - _apart()) >= 2 * percent * n)
    return fits & ((F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y")))) if ordered else fits


def _sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The shorter side, in the tiles of its band and of the next, and the longer side."""
    x = rows.where("lead").select("k", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"), *[F.col(a).alias(b) for a, b in (("doc_id", "x"), ("n", "nx"), ("at", "ix"), ("bits", "bx"), ("c", "cx"))])
    return x, rows.select("k", "band", *[F.col(a).alias(b) for a, b in (("doc_id", "y"), ("n", "ny"), ("at", "iy"), ("bits", "by"), ("c", "cy"))])


def _parted(found: DataFrame, roots: DataFrame, percent: int, work: Work) -> DataFrame:
    """The members, with their component ``c``, of the tiles in which there are several components."""
    labels = roots.select(F.col("id").alias("doc_id"), F.col("root").alias("c"))
    labelled = work.write(found.join(labels, "doc_id", "left").withColumn("c", F.coalesce("c", "doc_id")), "labelled")
    each = labelled.select("c", F.explode("keys.k").alias("k"))
    parted = work.write(each.groupBy("k").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("k"), "parted")
    rows = work.write(thinned(_members(labelled, F.col("keys"), percent), "k", parted).join(parted, "k"), "members")
    work.drop(labelled, parted)
    return rows


def hub_pairs(found: DataFrame, percent: int, work: Work) -> DataFrame:
    """(a, b): each set with one that it may link with of the first documents that lead one of its rarest tiles; of several the first."""
    rows = _members(found.withColumn("c", F.col("doc_id")), F.slice("keys", 1, HUBS), percent)
    around = F.explode(F.array(*[F.col("band") + i for i in (-1, 0, 1)])).alias("band")
    lead = rows.where("lead").select("k", around, "doc_id", "n", "at", "bits").groupBy("k", "band").agg(F.min(F.struct("doc_id", "n", "at", "bits")).alias("h"))
    hubs = work.write(lead.select("k", "band", F.col("h.doc_id").alias("x"), F.col("h.n").alias("nx"), F.col("h.at").alias("ix"), F.col("h.bits").alias("bx")), "hubs")
    met = _sides(rows)[1].join(hubs, ["k", "band"]).where((F.col("x") != F.col("y")) & _may_link(percent, ordered=False))
    one = met.groupBy("y").agg(F.min("x").alias("x"))
    pairs = work.write(one.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "pairs")
    work.drop(hubs)
    return pairs


def tile_pairs(found: DataFrame, roots: DataFrame, percent: int, work: Work) -> DataFrame:
    """(a, b, share): all pairs of different components whose tiles, sizes, places and bitmaps allow a link, and the share of their keys by which their bitmaps
    differ at least."""
    rows = _parted(found, roots, percent, work)
    x, y = _sides(rows)
    # bounds that hold for all of a component's members come first, so members of one component never meet
    parts = work.write(y.groupBy("k", "band", "cy").agg(F.max("ny").alias("most"), F.min("ny").alias("fewest"), F.max(F.col("ny") - F.col("iy")).alias("left")), "parts")
    may = (F.col("cx") != F.col("cy")) & (F.col("most") >= F.col("nx")) & (100 * F.col("nx") >= percent * F.col("fewest"))
    may &= (100 + percent) * F.least(F.col("nx") - F.col("ix"), F.col("left")) >= 2 * percent * F.col("nx")
    met = x.join(parts, ["k", "band"]).where(may).select("k", "band", "x", "nx", "ix", "bx", "cy").join(y, ["k", "band", "cy"]).where(_may_link(percent))
    pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), (_apart() / (F.col("nx") + F.col("ny"))).alias("share"))
    pairs = work.write(pairs.groupBy("a", "b").agg(F.min("share").alias("share")), "pairs")
    work.drop(rows, parts)
    return pairs


def linked(pairs: DataFrame, rows: DataFrame, known: DataFrame, width: int, percent: int, work: Work) -> DataFrame:
    """(a, b) of the ``pairs`` of sets ``known`` (doc_id, t, n) that link, by the whole texts of ``rows`` (doc_id, text)."""
    asked = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    wanted = work.write(asked.join(known, "doc_id"), "wanted")
    found = thinned(rows, "doc_id", wanted).select("doc_id", text_key().alias("t"), zipped(F.col("text").cast("binary")).alias("z"))
    # an id is wanted with one t: duplicates of both are those of the id, and lie where the join has put them
    texts = work.write(found.join(wanted, ["doc_id", "t"]).dropDuplicates(["doc_id", "t"]).select("doc_id", "n", "z"), "texts")
    side = lambda c: texts.select(F.col("doc_id").alias(c), F.col("n").alias(f"n{c}"), F.col("z").alias(f"z{c}"))
    common = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", shared(width)("za", "zb").alias("common"))
    edges = work.write(common.where((100 + percent) * F.col("common") >= percent * (F.col("na") + F.col("nb"))).select("a", "b"), "edges")
    work.drop(wanted, texts)
    return edges


def joined_components(roots: DataFrame, edges: DataFrame, work: Work) -> DataFrame:
    """``roots`` (id, root) after the ``edges`` that link ids of different components, or ids of none yet."""
    a, b = roots.select(F.col("id").alias("a"), F.col("root").alias("ra")), roots.select(F.col("id").alias("b"), F.col("root").alias("rb"))
    named = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    further = components(named, work)
    up = further.select(F.col("id").alias("root"), F.col("root").alias("upper"))
    moved = roots.join(up, "root", "left").select("id", F.coalesce("upper", "root").alias("root"))
    return work.write(moved.union(further.join(roots.select("id"), "id", "left_anti").select("id", "root")), "roots")


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id): the size of each document's set and the smallest document that links reach from it."""
    work = Work(docs.sparkSession, "ngram-jaccard")
    rows = docs.where("doc_id is not null").select("doc_id", "text")
    members, sets = distinct_sets(rows, width, percent, work)
    found = tiles(sets, percent, work)
    known = work.write(sets.select("doc_id", "t", "n"), "known")
    work.drop(sets)  # the wide table: bitmaps and first keys
    first = hub_pairs(found, percent, work)
    roots = components(linked(first, rows, known, width, percent, work), work)
    rest = work.write(tile_pairs(found, roots, percent, work).join(first, ["a", "b"], "left_anti"), "rest")
    for k in range(PICKS + 1):
        end = lambda c: roots.select(F.col("id").alias(c), F.col("root").alias(f"r{c}"))  # noqa: E731, B023
        named = rest.select("a", "b", "share").join(end("a"), "a", "left").join(end("b"), "b", "left").withColumn("ra", F.coalesce("ra", "a")).withColumn("rb", F.coalesce("rb", "b"))
        apart = work.write(named.where("ra <> rb"), "apart")
        if apart.isEmpty():
            break
        picked = apart.select("a", "b")
        if k < PICKS:
            both = apart.select(F.col("ra").alias("c"), "share", "a", "b").union(apart.select("rb", "share", "a", "b"))
            picked = work.write(both.groupBy("c").agg(F.min(F.struct("share", "a", "b")).alias("h")).select("h.a", "h.b").distinct(), "picked")
        edges = linked(picked, rows, known, width, percent, work)
        work.drop(rest)
        rest = work.write(apart.join(picked, ["a", "b"], "left_anti"), "rest")
        work.drop(apart)
        if not edges.isEmpty():
            roots = joined_components(roots, edges, work)
    classes = work.write(roots.select(F.col("id").alias("rep"), F.col("root").alias("component_id")), "classes")
    out = members.join(small(classes, classes.count(), CLASS_ROWS), "rep", "left")
    work.keep(members, classes)
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "rep").alias("component_id"))
