"""Toxicity by gradient-boosted trees over a few dense features, with isotonic calibration.

Features are measured on whole texts, one Arrow batch at a time: densities of an insult lexicon and of words learned from the labels,
how often a hit has a second-person word within ``NEAR`` words, the share of capitals, punctuation and words in capitals, and obfuscation
(words with digits or symbols inside, letters repeated three times, stretched punctuation).  Trees (Spark ML) are fitted on at most
``FIT_ROWS`` labelled documents, chosen by a hash of their id; a further hashed part of the sample, not seen by the trees, fits the isotonic
map from their margin to a probability.  The lexicon of words and stems is learned from
the same sample.

Scoring is one pass without a shuffle: features by vectorised counting in a pandas UDF, trees and the calibration map in the JVM.

Cases: null text scores as an empty one; empty texts have all features 0 and get the probability that the model gives those; documents
without a label are only scored; with labels of one class or none the score is their mean, 0 if there are none; repeated rows are
scored each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxloom.llm.common import dealt_out, materialize

#: Insults and second-person words of the four languages; fixed values.
INSULTS = frozenset(("idiot", "stupid", "moron", "dumb", "trash", "garbage", "pathetic", "worthless", "disgusting", "clown", "loser", "scum", "hate", "ugly", "shut", "idiota", "imbécile", "dummkopf", "stupide", "estúpido"))
SECOND_PERSON = frozenset(("you", "your", "yours", "yourself", "u", "ur", "tu", "te", "toi", "vous", "du", "dich", "dir", "ihr", "usted", "ti"))
NEAR = 5
FIT_ROWS = 20_000
#: Words and stems (first letters, so that inflected and disguised forms count) that are learned at most; the toxic documents one must be
#: in, how many standard deviations those must exceed their expected number, and how much likelier a word of a toxic document must have it.
LEARNED, LEAST_DOCS, LEAST_Z, LEAST_RATIO = 200, 3, 4.0, 4.0
STEMS = (4, 5, 6, 7)
FEATURES = ("insults", "insult_docs", "learned", "learned_any", "near_you", "capitals", "shouted", "punctuation", "symbols", "digits_inside", "symbols_inside", "stretched", "log_words")


INSULT, TAUGHT, SECOND = 1, 2, 4
LETTER, UPPER, MARK, SYMBOL = 1, 2, 4, 8
#: Words whose code a worker remembers.
CACHED_WORDS = 500_000
_WORD = re.compile(r"[^\W_]+")
_SHOUTED = re.compile(r"\b[^\W\d_]{2,}\b")
_DIGITS_INSIDE = re.compile(r"[^\W\d_]\d+(?=[^\W\d_])")
_SYMBOLS_INSIDE = re.compile(r"[^\W\d_][$@*!_.\-]+(?=[^\W\d_])")


@cache
def _kinds() -> np.ndarray:
    """What each code point is; built once per worker from the Unicode categories."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for i in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(i))
        if kind[0] == "L":
            out[i] = LETTER + UPPER * (kind == "Lu")
    out[[ord(c) for c in "!?"]] |= MARK
    out[[ord(c) for c in "$%&*#@"]] |= SYMBOL
    return out


class _Codes(dict):
    """What each word is: an insult, a learned word or stem, a second-person word."""

    def __init__(self, learned: list[str]):
        self.whole = {x[1:] for x in learned if x[0] == "="}
        self.stems = {x[1:] for x in learned if x[0] == "<"}

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        taught = word in self.whole or any(word[:k] in self.stems for k in STEMS if len(word) >= k)
        code = self[word] = INSULT * (word in INSULTS) + TAUGHT * taught + SECOND * (word in SECOND_PERSON)
        return code


def text_features(text: str, codes: _Codes) -> tuple[float, ...]:
    """``FEATURES`` of one whole text."""
    words = _WORD.findall(text.lower())
    n = len(words)
    code = np.fromiter(map(codes.__getitem__, words), np.uint8, n)
    insults, taught = int(np.count_nonzero(code & INSULT)), int(np.count_nonzero(code & TAUGHT))
    near = 0.0
    if insults or taught:
        hits, yours = np.flatnonzero(code & (INSULT | TAUGHT)), np.flatnonzero(code & SECOND)
        if len(yours):
            before = np.searchsorted(yours, hits - NEAR)
            near = float(np.mean((before < len(yours)) & (yours[np.minimum(before, len(yours) - 1)] <= hits + NEAR)))
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds()[points]
    count = lambda k: int(np.count_nonzero(kind & k))
    letters = count(LETTER)
    same = (points[1:] == points[:-1]) & ((kind[1:] & LETTER) > 0)
    third = same[1:] & same[:-1]
    stretched = int(np.count_nonzero(third[1:] & ~third[:-1])) + int(third[:1].sum())
    upper = count(UPPER)
    shouted = sum(w.isupper() for w in _SHOUTED.findall(text)) if upper > 1 else 0
    of = lambda x, m: x / m if m else 0.0
    return (
        of(insults, n), float(min(insults, 10)), of(taught, n), float(min(taught, 10)), near, of(upper, letters), of(shouted, n), of(count(MARK), len(points)),
        of(count(SYMBOL), len(points)), of(len(_DIGITS_INSIDE.findall(text)), n), of(len(_SYMBOLS_INSIDE.findall(text)), n), of(stretched, n), float(np.log1p(n)),
    )


def features(docs: DataFrame, learned: list[str], text: str = "text") -> DataFrame:
    """``docs`` with the columns ``FEATURES`` in place of ``text``."""
    codes = _Codes(learned)

    def measure(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_features(t if isinstance(t, str) else "", codes) for t in texts], columns=list(FEATURES), dtype="float64")

    kept = [c for c in docs.columns if c != text and c not in FEATURES]
    got = F.pandas_udf(measure, ", ".join(f"{f} double" for f in FEATURES))(F.col(text))
    return docs.select(*kept, got.alias("_f")).select(*kept, *[F.col("_f")[f].alias(f) for f in FEATURES])


def _term_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(term, t, n, kt, kc): toxic and all documents with a term, and its places in toxic and other documents, summed by batch."""
    for rows in batches:
        sums: dict[str, list[int]] = {}
        total = [0, 0, 0, 0]
        for text, toxic in zip(rows["text"], rows["toxic"], strict=True):
            words = _WORD.findall((text or "").lower())
            seen = Counter(chain.from_iterable(["=" + w, *["<" + w[:k] for k in STEMS if len(w) >= k]] for w in words))
            for term, k in seen.items():
                row = sums.setdefault(term, [0, 0, 0, 0])
                row[0] += toxic
                row[1] += 1
                row[2 if toxic else 3] += k
            total = [total[0] + toxic, total[1] + 1, total[2] + len(words) * toxic, total[3] + len(words) * (1 - toxic)]
        sums[""] = total
        yield pd.DataFrame([(term, *row) for term, row in sums.items()], columns=["term", "t", "n", "kt", "kc"])


def learn_words(sample: DataFrame) -> list[str]:
    """Words (``=word``) and stems (``<stem``) that mark toxic documents, the most frequent first; at most ``LEARNED``."""
    counts = sample.select("text", "toxic").mapInPandas(_term_counts, "term string, t long, n long, kt long, kc long")
    counts = materialize(counts.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("t", "n", "kt", "kc")]), "terms")
    whole = counts.where("term = ''").first()
    if whole is None or not whole["t"] or whole["t"] == whole["n"] or not whole["kt"] or not whole["kc"]:
        return []
    likely = F.col("n") * (whole["t"] / whole["n"])
    ratio = ((F.col("kt") + 0.5) / whole["kt"]) / ((F.col("kc") + 0.5) / whole["kc"])
    marks = counts.where((F.col("term") != "") & (F.col("t") >= LEAST_DOCS) & ((F.col("t") - likely) / F.sqrt(likely) >= LEAST_Z) & (ratio >= LEAST_RATIO))
    return [r["term"] for r in marks.orderBy(F.desc("t"), F.length("term"), "term").limit(LEARNED).select("term").collect()]


class ToxicityModel:
    def __init__(self, words: list[str], trees: GBTClassificationModel | None, knots: list[tuple[float, float]], base: float):
        self.words, self.trees, self.knots, self.base = words, trees, knots, base

    def score(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``docs`` with ``score``, without ``text``."""
        kept = [c for c in docs.columns if c not in (text, "score")]
        if self.trees is None:
            return docs.select(*kept, F.lit(float(self.base)).alias("score"))
        packed = dealt_out(docs).select(F.struct(*kept).alias("_kept"), F.col(text).alias("_text"))
        rows = VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(features(packed, self.words, "_text"))
        rows = self.trees.transform(rows.select("_kept", "_features"))
        return rows.select(F.col("_kept.*"), calibrated(vector_to_array("rawPrediction")[1], self.knots).alias("score"))


def calibrated(margin: Column, knots: list[tuple[float, float]]) -> Column:
    """The piecewise linear map through the ascending ``knots`` (margin, probability), flat outside; of knots at one margin the last counts."""
    xs, ys = F.lit([x for x, _ in knots]), F.lit([y for _, y in knots])
    at = F.size(F.filter(xs, lambda x: x <= margin))  # knots passed
    x0, y0, x1, y1 = F.get(xs, at - 1), F.get(ys, at - 1), F.get(xs, at), F.get(ys, at)
    between = y0 + (margin - x0) * (y1 - y0) / (x1 - x0)
    found = F.when(at == 0, F.lit(knots[0][1])).when(at == len(knots), F.lit(knots[-1][1])).otherwise(between)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), found))


def sample_labels(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(text, toxic, part): at most about ``rows`` labelled documents by a hash of the id; ``labels`` (doc_id, toxic), nulls left out."""
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = marks.count()
    order = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1_000_000))
    marks = marks.withColumn("part", order).where(F.col("part") < 1_000_000 * min(1.0, rows / max(n, 1)))
    return docs.join(marks, "doc_id").select("text", "toxic", F.pmod("part", F.lit(4)).alias("part"))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, iterations: int = 12, depth: int = 4) -> ToxicityModel:
    sample = materialize(sample_labels(docs.select("doc_id", "text"), labels, rows), "toxic-sample")
    n = sample.agg(F.avg("toxic").alias("m"), F.min("toxic").alias("lo"), F.max("toxic").alias("hi")).first()
    if n["lo"] == n["hi"]:
        return ToxicityModel([], None, [], n["m"] or 0.0)
    words = learn_words(sample.where("part <> 0"))
    rows_ = VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(features(sample, words)).select("_features", F.col("toxic").cast("double").alias("label"), "part")
    rows_ = materialize(rows_, "toxic-features")
    if rows_.where("part <> 0").select("label").distinct().count() < 2 or rows_.where("part = 0").isEmpty():
        return ToxicityModel([], None, [], n["m"])
    trees = GBTClassifier(featuresCol="_features", labelCol="label", maxIter=iterations, maxDepth=depth, stepSize=0.2, seed=11).fit(rows_.where("part <> 0").coalesce(4))
    held = trees.transform(rows_.where("part = 0")).select(F.round(vector_to_array("rawPrediction")[1], 3).alias("x"), "label").groupBy("x").agg(F.avg("label").alias("label"), F.count(F.lit(1)).cast("double").alias("w"))
    model = IsotonicRegression(featuresCol="x", labelCol="label", weightCol="w").fit(held)
    knots = sorted(zip((float(x) for x in model.boundaries), (float(y) for y in model.predictions), strict=True))
    return ToxicityModel(words, trees, knots, n["m"])
