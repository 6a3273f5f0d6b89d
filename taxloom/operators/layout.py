"""Geometry of words on pages: lines, segments of lines, cells of tables, glued tokens, labels of fields.

Words are rows (page, word, text, x0, y0, x1, y1), the box in page units with y downwards.  A page is gathered into one array, as large as the page, and
is read as a whole: the pages of an Arrow batch are sorted, parted and joined as flat arrays, some hundred pages at a time, so nothing is done word by word but
the moving centre of lines, and no line is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word belongs to a line if its centre is within this part of the page's median height from the mean centre of the line so far.
LINE_SHARE = 0.6
#: Gaps that part segments of a line and cells of a table's head, in median heights of the line.
SEGMENT_GAP, CELL_GAP = 3.0, 0.7
#: Boxes of exported words are in thousandths of the page.
SCALE = 1000
#: Pages that are read at a time: a bound of memory only.
AT_ONCE = 512
BOX = ("x0", "y0", "x1", "y1")


@dataclass
class Words:
    """Words of some pages as flat arrays: ``of`` is a word's page, a place in ``page``."""

    page: pa.Array
    of: np.ndarray
    word: np.ndarray
    text: pa.Array
    x0: np.ndarray
    y0: np.ndarray
    x1: np.ndarray
    y1: np.ndarray

    def take(self, at: np.ndarray) -> Words:
        return Words(self.page, self.of[at], self.word[at], self.text.take(pa.array(at)), *[getattr(self, c)[at] for c in BOX])


def _unpacked(batch: pa.RecordBatch) -> Words:
    """The words of gathered pages; a box without a value is not a number."""
    ws = batch.column("ws")
    flat = ws.flatten()
    word, text, *box = flat.flatten()
    sizes = np.diff(ws.offsets.to_numpy())
    return Words(batch.column("page"), np.repeat(np.arange(len(ws)), sizes), word.fill_null(-(2**63)).to_numpy(), text, *[b.to_numpy(zero_copy_only=False).astype(float) for b in box])


@dataclass
class Pages:
    """Pages as rows that ``words`` makes some pages' words of."""

    rows: DataFrame
    words: Callable[[pa.RecordBatch], Words] = _unpacked

    def read(self, reader: Callable[[Words], pa.Table], schema: str, keep: tuple[str, ...] = ()) -> DataFrame:
        """What ``reader`` finds on the pages: the page and the columns of ``schema``; beside them those of ``rows`` to ``keep``, if it gives each page one row."""
        words, kinds = self.words, "".join(f", {c} {self.rows.schema[c].dataType.simpleString()}" for c in keep)

        def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, AT_ONCE):
                    part = batch.slice(at, AT_ONCE)
                    found = reader(words(part))
                    for c in keep:
                        found = found.append_column(c, part.column(c))
                    yield from found.to_batches()

        return self.rows.mapInArrow(some, f"page {self.rows.schema['page'].dataType.simpleString()}, {schema}{kinds}")


def pages(words: DataFrame | Pages) -> Pages:
    """Rows of words, gathered by page; pages are left as they are."""
    return words if isinstance(words, Pages) else Pages(words.groupBy("page").agg(F.collect_list(F.struct(F.col("word").cast("long").alias("word"), "text", *[F.col(c).cast("double").alias(c) for c in BOX])).alias("ws")))


def bounds(group: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` groups begins in ascending ``group``, and where the last ends."""
    return np.searchsorted(group, np.arange(n + 1)).astype(np.int32)


def joined(texts: pa.Array, at: np.ndarray, by: str = " ") -> pa.Array:
    """Neighbouring ``texts`` as one, by the bounds ``at``; nulls are left out."""
    if texts.null_count:
        there = texts.is_valid().to_numpy(zero_copy_only=False)
        at, texts = np.concatenate([[0], np.cumsum(there)]).astype(np.int32)[at], texts.drop_null()
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), texts), by)


def lists(values: pa.Array, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)


def _key(x: np.ndarray) -> np.ndarray:
    """For sorting: what isn't there comes first."""
    return np.where(np.isnan(x), -np.inf, x)


def _down(w: Words, centre: np.ndarray | None = None) -> np.ndarray:
    """The order of words within their pages by centre, if there is one, and number; of words of one number by text and box."""
    keys = [w.word, w.of] if centre is None else [w.word, _key(centre), w.of]
    order = np.lexsort(keys)
    sorted_ = [k[order] for k in keys]
    if len(order) > 1 and np.logical_and.reduce([k[1:] == k[:-1] for k in sorted_]).any():
        rank = pc.rank(w.text, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
        order = np.lexsort([*[_key(getattr(w, c)) for c in reversed(BOX)], rank, *keys])
    return order


def _middles(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """The median of each of ``n`` groups, none of which is empty."""
    v, at = values[np.lexsort((values, group))], bounds(np.sort(group), n)
    size = np.diff(at)
    return (v[at[:-1] + (size - 1) // 2] + v[at[:-1] + size // 2]) / 2


def _moving(centres: list[float], pages_: list[int], reach: list[float]) -> np.ndarray:
    """Whether a line begins at each of the ascending ``centres`` of a page: where one is further than ``reach`` from the mean of the open line.

    The mean moves with each word, so this is a fold and not a comparison with the word before."""
    starts = np.zeros(len(centres), bool)
    page, total, n, far = -1, 0.0, 0, 0.0
    for i, (y, p) in enumerate(zip(centres, pages_, strict=True)):
        if p != page:
            page, total, n, far = p, y, 1, reach[p]
            starts[i] = True
        elif abs(y - total / n) > far:
            total, n = y, 1
            starts[i] = True
        else:
            total += y
            n += 1
    return starts


@dataclass
class Lines:
    """``words`` in lines from the top and in a line from the left; ``line`` counts through all pages, ``height`` is a line's median height and ``of`` its page,
    ``first`` the first line of each page and, at the end, how many there are."""

    words: Words
    line: np.ndarray
    height: np.ndarray
    of: np.ndarray
    first: np.ndarray

    def texts(self) -> pa.Array:
        return joined(self.words.text, bounds(self.line, len(self.of)))

    def number(self) -> np.ndarray:
        """Of each line in its page."""
        return np.arange(len(self.of)) - self.first[self.of]


def lines_of(w: Words, share: float = LINE_SHARE) -> Lines:
    """The lines of pages by a moving centre; blank words are left out."""
    seen = pc.fill_null(pc.not_equal(pc.utf8_trim(w.text, " "), ""), False).to_numpy(zero_copy_only=False)
    w = w if seen.all() else w.take(np.flatnonzero(seen))
    centre = (w.y0 + w.y1) / 2
    order = _down(w, centre)
    w, centre = w.take(order), centre[order]
    there, place = np.unique(w.of, return_inverse=True)  # pages that have words
    reach = share * _middles(w.y1 - w.y0, place, len(there))
    line = np.cumsum(_moving(centre.tolist(), place.tolist(), reach.tolist())) - 1
    n = int(line[-1]) + 1 if len(line) else 0
    of = w.of[bounds(line, n)[:-1]]
    across = np.lexsort((_key(w.x0), line))  # stable: words of one place keep their order
    return Lines(w.take(across), line, _middles(w.y1 - w.y0, line, n), of, bounds(of, len(w.page)))


def page_lines(words: DataFrame | Pages, share: float = LINE_SHARE, gap: float = SEGMENT_GAP) -> DataFrame:
    """(page, line, place, segment, word, text, x0, y0, x1, y1, h): words in lines from the top, in a line from the left, and the segments that wide gaps part.

    Words of one centre keep their order; blank words are left out; a page of one word is one line."""

    def placed(w: Words) -> pa.Table:
        found = lines_of(w, share)
        w, line = found.words, found.line
        at = bounds(line, len(found.of))
        h = found.height[line]
        inside = np.concatenate([[False], line[1:] == line[:-1]])[: len(line)]
        wide = inside & (w.x0 - np.concatenate([[0.0], w.x1[:-1]])[: len(line)] > gap * np.where(h == 0, 1.0, h))
        total = np.cumsum(wide)
        numbers = [found.number()[line], np.arange(len(line)) - at[line], total - total[at[line]]]
        return pa.table([w.page.take(pa.array(w.of)), *[pa.array(x.astype(np.int32)) for x in numbers], w.word, w.text, w.x0, w.y0, w.x1, w.y1, h], names=["page", "line", "place", "segment", "word", "text", *BOX, "h"])

    return pages(words).read(placed, "line int, place int, segment int, word long, text string, x0 double, y0 double, x1 double, y1 double, h double")


def near_lines(w: Words, reach: float = 4.0) -> tuple[pa.Array, np.ndarray]:
    """The texts of lines, each word within ``reach`` of the centre of the word before it, and where each page's lines begin."""
    centre = (w.y0 + w.y1) / 2
    order = _down(w, centre)
    w, centre = w.take(order), centre[order]
    new = np.concatenate([[True], (w.of[1:] != w.of[:-1]) | (centre[1:] - centre[:-1] > reach)])[: len(order)]
    line = np.cumsum(new) - 1
    n = int(line[-1]) + 1 if len(line) else 0
    of = w.of[bounds(line, n)[:-1]]
    across = np.lexsort((w.word, _key(centre), _key(w.x0), line))
    return joined(w.text.take(pa.array(across)), bounds(line, n)), bounds(of, len(w.page))


def in_order(words: DataFrame | Pages, keep: tuple[str, ...] = ()) -> DataFrame:
    """(page, ws) and columns of the pages to ``keep``: the words of each page by their number."""

    def sorted_(w: Words) -> pa.Table:
        w = w.take(_down(w))
        ws = pa.StructArray.from_arrays([pa.array(w.word), w.text, *[pa.array(getattr(w, c)) for c in BOX]], names=["word", "text", *BOX])
        return pa.table([w.page, lists(ws, bounds(w.of, len(w.page)))], names=["page", "ws"])

    return pages(words).read(sorted_, "ws array<struct<word:long,text:string,x0:double,y0:double,x1:double,y1:double>>", keep)


def head_cells(head: Lines, at: np.ndarray, gap: float = CELL_GAP) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(page, centre, text) of the cells of tables' heads, the lines ``at``: words nearer than ``gap`` heights are one cell."""
    w, line = head.words, head.line
    mine = np.flatnonzero(np.isin(line, at))
    x0, x1, on = w.x0[mine], w.x1[mine], line[mine]
    new = np.concatenate([[True], (on[1:] != on[:-1]) | (x0[1:] - x1[:-1] >= gap * head.height[on[1:]])])[: len(mine)]
    cell = np.cumsum(new) - 1
    n = int(cell[-1]) + 1 if len(cell) else 0
    ends = bounds(cell, n)
    return head.of[on[ends[:-1]]], (x0[ends[:-1]] + x1[ends[1:] - 1]) / 2, joined(w.text.take(pa.array(mine)), ends)


def nearest(x: np.ndarray, of: np.ndarray, page: np.ndarray, centre: np.ndarray, n: int) -> np.ndarray:
    """For each ``x`` on the page ``of`` the nearest of the centres of ascending ``page``, of equally near ones the first; -1 where there is none."""
    at = bounds(page, n)
    found, best = np.full(len(x), -1), np.full(len(x), np.inf)
    open_ = np.arange(len(x))
    k = 0
    while len(open_ := open_[at[of[open_]] + k < at[of[open_] + 1]]):
        c = at[of[open_]] + k
        far = np.abs(centre[c] - x[open_])
        less = (far < best[open_]) | (found[open_] < 0)
        found[open_[less]], best[open_[less]] = c[less], far[less]
        k += 1
    return found


#: Tokens that readers glue together: a label and its value, a currency and its amount; fixed patterns.
LABELLED, CLOCK, PRICED, NAMED_MONTH = r"^([A-Za-z][A-Za-z./ ]*?:)(\S+)$", r"^[0-9]{1,2}:[0-9]{2}$", r"(?i)^(Rs\.?|INR|₹)([0-9][0-9,]*\.?[0-9]*)$", r"^(.*[-/. ])([A-Za-z])([A-Za-z0-9]{2})([-/. ][0-9]{2,4})$"


def token_parts(text: Column) -> Column:
    """The parts of a token: label and value, then currency and amount, then the words of a label in camel case; look-alike digits in the name of a month become letters."""
    glued = text.rlike(LABELLED) & ~text.rlike(CLOCK)
    parts = F.when(glued, F.array(F.regexp_extract(text, LABELLED, 1), F.regexp_extract(text, LABELLED, 2))).otherwise(F.array(text))
    last = lambda p: F.element_at(p, -1)
    priced = lambda p: F.when(last(p).rlike(PRICED), F.concat(F.slice(p, F.lit(1), F.size(p) - 1), F.array(F.regexp_extract(last(p), PRICED, 1), F.regexp_extract(last(p), PRICED, 2)))).otherwise(p)
    parts = priced(parts)
    first = F.get(parts, 0)
    camel = (F.length(first) > 4) & first.rlike("^[A-Z]") & first.rlike("[a-z][A-Z]") & ~first.rlike("[0-9]")
    parts = F.when(camel, F.concat(F.split(first, "(?<=[a-z])(?=[A-Z])"), F.slice(parts, F.lit(2), F.size(parts)))).otherwise(parts)
    month = lambda p: F.when(p.rlike(NAMED_MONTH), F.concat(F.regexp_extract(p, NAMED_MONTH, 1), F.regexp_extract(p, NAMED_MONTH, 2), F.translate(F.regexp_extract(p, NAMED_MONTH, 3), "105", "los"), F.regexp_extract(p, NAMED_MONTH, 4))).otherwise(p)
    return F.transform(parts, month)


def split_tokens(words: DataFrame) -> DataFrame:
    """``words`` with glued tokens parted, numbered by ``part``.  The parts share the token's box by their lengths, up to which the lengths before a part
    are summed, so they tile the box: each begins where the one before ends, the first and the last at its sides."""
    cut = words.where("text is not null").withColumn("parts", token_parts(F.col("text")))
    sizes = F.transform("parts", lambda p: F.length(p))
    upto = lambda i: F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda a, n: a + n)
    whole = F.greatest(F.lit(1), upto(F.size("parts")))
    at = lambda i: F.when(i == 0, F.col("x0")).when(i == F.size("parts"), F.col("x1")).otherwise(F.col("x0") + (F.col("x1") - F.col("x0")) * upto(i) / whole)
    each = cut.select("page", "word", "y0", "y1", F.posexplode(F.transform("parts", lambda p, i: F.struct(p.alias("text"), at(i).alias("x0"), at(i + 1).alias("x1")))).alias("part", "p"))
    return each.select("page", "word", "part", "p.text", "p.x0", "y0", "p.x1", "y1")


def _labelled(words: list, fields: list[tuple[str, str | None]]) -> list[str]:
    labels, n = ["O"] * len(words), len(words)
    runs = [(name, text.split(" ")) for name, text in fields if text]
    for name, run in sorted(runs, key=lambda f: -len(f[1])):  # stable: then in the order of the fields
        k, at = len(run), -1
        while (at := words.index(run[0], at + 1) if run[0] in words[at + 1 :] else n) <= n - k:
            if words[at : at + k] == run and labels[at : at + k] == ["O"] * k:
                labels[at : at + k] = [f"B-{name}", *[f"I-{name}"] * (k - 1)]
                break
    return labels


def field_labels(words: Column, fields: dict[str, Column]) -> Column:
    """A label for each of the array ``words``: B- or I- and the field whose value stands there, else O.

    A value is a run of words; runs are sought for the values of more words first, then in the order of ``fields``, each at its first place of which no
    word is taken yet.  Values that aren't found label nothing."""
    names = list(fields)

    @F.arrow_udf("array<string>")
    def labels(ws: pa.Array, *values: pa.Array) -> pa.Array:
        rows = zip(*[v.to_pylist() for v in values], strict=True) if values else ([] for _ in range(len(ws)))
        return pa.array([None if w is None else _labelled(w, list(zip(names, row, strict=True))) for w, row in zip(ws.to_pylist(), rows, strict=True)], pa.list_(pa.string()))

    return labels(words, *fields.values())


def labelled_values(words: Column, labels: Column, name: str) -> Column:
    """The text that ``labels`` mark as the field ``name``, or null."""
    run = F.filter(F.zip_with(words, labels, lambda w, x: F.when(x.isin(f"B-{name}", f"I-{name}"), w)), lambda w: w.isNotNull())
    return F.when(F.size(run) > 0, F.array_join(run, " "))


def scaled_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """The box in thousandths of the page, cut off at its sides."""
    part = lambda v, of: F.greatest(F.lit(0), F.least(F.lit(SCALE), (SCALE * v / of).cast("int")))
    return F.array(part(x0, width), part(y0, height), part(x1, width), part(y1, height))
