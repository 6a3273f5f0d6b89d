"""Fill-in-the-middle transformation by sparse checkpoints.

A text is cut at two units into prefix, middle and suffix, which are then put in another order between markers, so that a model learns to
write the middle.  A unit is a run of other characters with the blanks before it; blanks at the end of the text are a unit of their own.

While the units are counted, every ``EVERY`` of them leave a checkpoint: how many units, bytes and code points lie before it.  A cut
searches the checkpoints by bisection and reads on from there, over fewer than ``EVERY`` units, so no list of units is ever held: a text of
any length needs its bytes and a checkpoint for some hundreds of them.  Blanks are single bytes of UTF-8 and never part of another
character, so everything is done on bytes and nothing is decoded.

Which texts, which order and where to cut follow from a hash of the key and nothing else, so rows can be recomputed anywhere, and equal
keys are treated alike.  One pass over the rows, in Arrow batches, without a shuffle; batches of results end at ``BATCH_BYTES``.

Cases: null text is empty; an empty text, and one that contains a marker already, stays plain, since it couldn't be read back; a null key is hashed
as an empty one; repeated rows give repeated results; the caller's other columns stay, those named like a result (in any case) are replaced; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxloom.llm.common import dealt_out

#: Units between two checkpoints.
EVERY = 64
SEED = 42
#: Texts in a hundred that are transformed, and of these those that begin with the suffix.
RATE, SUFFIX_FIRST = 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RESULT = "n long, form string, prefix_chars long, middle_chars long, output string"

_UNIT = rb"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"
_ONE = re.compile(_UNIT + rb"|[\x20\x09-\x0D]++")
#: The bytes of UTF-8 that begin no code point.
_INNER = bytes(range(0x80, 0xC0))


def code_points(text: bytes) -> int:
    return len(text.translate(None, _INNER))


class Checkpoints(NamedTuple):
    """Units, bytes and code points before each checkpoint, ascending, and the units of the whole text."""

    units: list[int]
    at: list[int]
    points: list[int]
    n: int


def counted(text: bytes, every: int = EVERY) -> Checkpoints:
    """Counts the units of ``text`` and leaves a checkpoint at the start and after every ``every`` units."""
    run = re.compile(rb"(?:%b){%d}" % (_UNIT, every))
    units, at, points = [0], [0], [0]
    while found := run.match(text, at[-1]):
        points.append(points[-1] + code_points(found.group()))
        at.append(found.end())
        units.append(units[-1] + every)
    return Checkpoints(units, at, points, units[-1] + sum(1 for _ in _ONE.finditer(text, at[-1])))


def cut(text: bytes, known: Checkpoints, unit: int) -> tuple[int, int]:
    """The bytes and the code points before unit number ``unit`` of ``text``."""
    i = bisect_right(known.units, unit) - 1
    start = end = known.at[i]
    for _ in range(unit - known.units[i]):
        end = _ONE.match(text, end).end()
    return end, known.points[i] + code_points(text[start:end])


def draws(key: object, seed: int = SEED) -> list[int]:
    """Four numbers of 32 bits from the seed and the decimal key."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transformed(text: bytes, key: object, seed: int = SEED, every: int = EVERY) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of the prefix and the middle, output) of one text."""
    known, (h1, h2, h3, h4) = counted(text, every), draws(key, seed)
    marks = [x.encode() for x in (PREFIX, SUFFIX, MIDDLE)]
    if not text or h3 % 100 >= RATE or any(x in text for x in marks):
        return known.n, "plain", None, None, text
    first, last = sorted((h1 % (known.n + 1), h2 % (known.n + 1)))
    (a, a_points), (b, b_points) = cut(text, known, first), cut(text, known, last)
    prefix, suffix = marks[0] + text[:a], marks[1] + text[b:]
    spm = h4 % 100 < SUFFIX_FIRST
    output = (suffix + prefix if spm else prefix + suffix) + marks[2] + text[a:b]
    return known.n, "spm" if spm else "psm", a_points, b_points - a_points, output


def _transform(seed: int, every: int):
    def transform(texts: pa.Array, keys: pa.Array) -> pa.Array:
        rows = [transformed(t.as_py() or b"", k.as_py(), seed, every) for t, k in zip(texts, keys, strict=True)]
        n, form, prefix, middle, output = zip(*rows, strict=True) if rows else ([], [], [], [], [])
        fields = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).view(pa.string())]
        return pa.StructArray.from_arrays(fields, ["n", "form", "prefix_chars", "middle_chars", "output"])

    return F.arrow_udf(transform, RESULT)


def fill_in_middle(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = SEED, every: int = EVERY) -> DataFrame:
    """``docs`` without ``text``, with the units ``n``, the ``form`` (plain, psm or spm), the code points ``prefix_chars`` and ``middle_chars``
    (null if plain) and the ``output``."""
    own = {x.split()[0] for x in RESULT.split(", ")} | {text.lower()}
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in own]
    packed = dealt_out(docs.select(F.struct(*kept).alias("_kept"), F.col(text).cast("binary").alias("_text"), F.col(key).alias("_key")))
    return packed.select("_kept", _transform(seed, every)("_text", "_key").alias("_fim")).select("_kept.*", "_fim.*")


def restored(output: Column, form: Column) -> Column:
    """The text of an output.  A marker neither begins nor ends another, and the text has none, so it falls into parts in one way."""
    parts = F.split(output, "|".join(rf"\Q{x}\E" for x in (PREFIX, SUFFIX, MIDDLE)))
    first, second, middle = F.get(parts, 1), F.get(parts, 2), F.get(parts, 3)
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)
